"""The alignment contract with plain loops over whole texts."""

import collections
import hashlib
import itertools
import re

import sentencepiece
from tokenizers import Tokenizer

from plumbline.llm.queries import TOKENIZERS


def tokens_of(text, a, b):
    if not text:
        return [], []
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    sign = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    ids = a.encode(" " + text, add_special_tokens=False).ids
    left = [(i, bytes(sign[c] for c in a.id_to_token(i))) for i in ids]
    right = []
    for i in b.encode(text):
        piece = b.id_to_piece(i)
        byte = re.fullmatch("<0x(..)>", piece)
        right.append((i, bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode()))
    whole = (" " + text).encode()
    if b"".join(x for _, x in left) != whole or b"".join(x for _, x in right) != whole:
        return [], []
    return left, right


def spans(tokens):
    ends = list(itertools.accumulate(len(x) for _, x in tokens))
    return [(i, e - len(x), e) for (i, x), e in zip(tokens, ends)]


def brute(docs):
    """Rows of op12 for (doc_id, text)."""
    a = Tokenizer.from_file(str(TOKENIZERS / "byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=str(TOKENIZERS / "piece_bpe_32k.model"))
    counts, found = collections.Counter(), []
    for doc_id, text in docs:
        left, right = (spans(x) for x in tokens_of(text, a, b))
        links, start = [], 0
        for i, s, e in left:
            while start < len(right) and right[start][2] <= s:
                start += 1
            for j, s2, e2 in right[start:]:
                if s2 >= e:
                    break
                links.append((i, j))
        counts.update(links)
        groups, low = [], 0
        for end in sorted({e for *_, e in left} & {e for *_, e in right}):
            inside = [[str(i) for i, s, e in x if low <= s and e <= end] for x in (left, right)] if len(left) < 300 else None
            groups.append((low, end, inside))
            low = end
        if len(left) >= 300:  # the same by walking on
            groups, p, q, low = [(g, e, None) for g, e, _ in groups], 0, 0, 0
            for k, (_, end, _) in enumerate(groups):
                own = [[], []]
                while p < len(left) and left[p][2] <= end:
                    own[0].append(str(left[p][0]))
                    p += 1
                while q < len(right) and right[q][2] <= end:
                    own[1].append(str(right[q][0]))
                    q += 1
                groups[k] = (0, end, own)
        text_of = ";".join(",".join(x) + "|" + ",".join(y) for *_, (x, y) in groups)
        found.append((doc_id, len(left), len(right), len(groups), links, text_of))
    best = collections.Counter()
    for (_, j), n in counts.items():
        best[j] = max(best[j], n)
    return [
        (d, n, m, g, len(links), sum(counts[x] == best[x[1]] for x in links), sum(counts[x] for x in links), hashlib.sha256(t.encode()).hexdigest() if t else "")
        for d, n, m, g, links, t in found
    ]
