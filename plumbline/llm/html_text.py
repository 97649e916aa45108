"""Main text of web pages: page structure, and a suffix array over the pages of a host.

A page is cut into blocks of text.  Structure decides where it is plain: what
lies in menus, footers, adverts and the like goes, and what lies in an article
stays, also if another page quotes it.  All other blocks are open.  The token
streams of the blocks outside of articles are concatenated over the pages of a
host, a suffix array brings equal substrings together, and tokens in long
substrings that distinct pages share are covered.  An open block that is mostly
covered is boilerplate; unique runs stay.
"""

from __future__ import annotations

import hashlib
import html
import re
from collections.abc import Iterator, Sequence, Set

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from plumbline.llm.shared import written

#: Tokens of a shared substring, and distinct pages that must have it.
RUN, PAGES = 8, 2
#: A block is boilerplate if more than this share of its tokens is covered.
COVERED = 0.5
#: HTML bytes of a host whose suffixes are sorted together; larger hosts are cut by a hash of the page,
#: and the runs that their parts share are found by a join.
PART_BYTES = 8_000_000
#: Large hosts up to this number are joined by broadcast; beyond it by a shuffle.
BROADCAST_HOSTS = 10_000

# Elements, class words and roles of page furniture, words that stand beside such a word in a class
# without changing its meaning, words that turn it around, elements that end a block, elements without text.
FURNITURE = set("nav header footer aside menu dialog button select template".split())
FURNITURE_WORDS = set(
    "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies footer header "
    "menu modal nav navbar navigation newsletter notice notices popup promo related share sidebar social sponsor sponsored".split()
)
ROLES = set("alertdialog banner complementary contentinfo dialog menu menubar navigation search".split())
BESIDE = set(
    "area articles author bar block blog body bottom box btn button buttons container content cookie entry fixed form "
    "global gdpr group icon icons inner item items left link links list main media message mobile news outer page panel "
    "policy post posts primary privacy reader right secondary section signup site slot sticky stories text title toggle "
    "top unit user widget wrap wrapper".split()
)
TURNED = set("has hide is no non not with without".split())
BLOCK = set(
    "address article aside blockquote body caption dd details div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
CONTENT = ("article", "main")

_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|svg|iframe|textarea|title|head)\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
# An svg ends at its end tag, or before an element of HTML that stands in no part of it that may hold HTML.
_SVG_END = re.compile(
    r"(?P<html><(?:foreignobject|desc|title)\b)|(?P<end></svg\s*>)"
    r"|<(?=(?:/?(?:article|main|p|div|body|table)|h[1-6]|ul|ol|li|dl|dd|dt|pre|blockquote|hr|img|span|section|aside|nav|header|footer)\b)",
    re.I,
)
_NAMED = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")
_FIELD = re.compile(r"<(?:input|select|textarea|button|label)\b", re.I)
_FIELDS = re.compile(r"<(script|style|select|textarea|button|label)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
#: Characters that a form may have for itself and for each field without holding content.
FORM_TEXT = 200

ARTICLE, OPEN, AROUND = 0, 1, 2


def blocks(page: str) -> list[tuple[int, str]]:
    """(kind, text) of the blocks of a page in order."""
    found: list[tuple[int, str]] = []
    parts: list[str] = []
    article = 0
    skipped: list[str] = []  # open elements from the first that is furniture
    endless: set[str] = set()  # elements that have no end tag in the rest of the page; only their tags are skipped

    def close() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            found.append((AROUND if skipped else ARTICLE if article else OPEN, text))
        parts.clear()

    at, search = 0, _MARKUP.search
    while match := search(page, at):
        parts.append(page[at : match.start()])
        at = match.end()
        if match[1]:
            # Content that is not text: go on behind its end, if it has one.
            name = match[1].lower()
            if name in ("head", "title"):
                close()
            if name in endless or name == "svg" and match[0].endswith("/>"):
                continue
            end = _behind_svg(page, at) if name == "svg" else _behind(name, page, at)
            if end is not None:
                at = end
            elif name in ("script", "style"):
                at = len(page)
            else:
                endless.add(name)
            continue
        if match[3] is None:
            continue
        name, leaving = match[3].lower(), match[2]
        if name in BLOCK or name in FURNITURE:
            close()
        elif name == "br":
            parts.append(" ")
        if name in VOID or match[4].endswith("/"):
            continue
        if leaving:
            if skipped:
                if name in skipped:
                    del skipped[len(skipped) - 1 - skipped[::-1].index(name) :]
            elif name in CONTENT:
                article = max(0, article - 1)
        elif name in CONTENT and not article:
            # An article begins, also where furniture was left open.
            skipped.clear()
            article += 1
        elif skipped:
            skipped.append(name)
        elif name in FURNITURE or _is_furniture(name, match[4]) or name == "form" and _is_input(page, at, endless):
            skipped.append(name)
        elif name in CONTENT:
            article += 1
    parts.append(page[at:])
    close()
    return found


def _behind(name: str, page: str, at: int) -> int | None:
    end = re.compile(rf"</{name}\s*>", re.I).search(page, at)
    return end.end() if end else None


def _behind_svg(page: str, at: int) -> int | None:
    """Where text goes on behind an svg whose start tag ends at ``at``."""
    end = _SVG_END.search(page, at)
    if end and end["html"]:
        return _behind("svg", page, at)
    return end and (end.end() if end["end"] else end.start())


def _is_furniture(name: str, attributes: str) -> bool:
    """Whether a class, id or role names furniture: by one word, or with words beside it that do not change it.

    ``has-sidebar`` or ``share-price`` says something about the content instead;
    so may anything on the body.
    """
    if not attributes or name in ("html", "body"):
        return False
    for found in _NAMED.finditer(attributes):
        for token in found[found.lastindex].split():
            parts = [p.lower() for p in _PART.findall(token)]
            if found[1].lower() == "role":
                if token.lower() in ROLES:
                    return True
            elif not TURNED.intersection(parts) and FURNITURE_WORDS.intersection(parts):
                if all(p in FURNITURE_WORDS or p in BESIDE or len(p) < 2 or p.isdigit() for p in parts):
                    return True
    return False


def _is_input(page: str, at: int, endless: set[str]) -> bool:
    """Whether a form whose start tag ends at ``at`` holds little but fields; one around a page does not."""
    end = None if "form" in endless else _behind("form", page, at)
    if end is None:
        endless.add("form")
        return False
    inside = page[at:end]
    if re.search(r"<(?:article|main)\b", inside, re.I):
        return False
    return len(" ".join(_FIELDS.sub(" ", inside).split())) <= FORM_TEXT * (1 + len(_FIELD.findall(inside)))


def content_of(page: list[tuple[int, str]]) -> int:
    """Hash of the tokens of a page outside of furniture.  Pages that are equal there are copies of one content."""
    text = "\n".join(text for kind, text in page if kind != AROUND)
    return int.from_bytes(hashlib.blake2b(" ".join(text.split()).encode(), digest_size=8).digest(), "big", signed=True)


def _shared_runs(streams: list[list[str]], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place, group, page) of every substring of ``run`` tokens in the joined streams; equal ones are one group, groups ascend.

    The suffixes are sorted by prefix doubling until their first ``run`` tokens
    decide; equal neighbours in that order are the shared substrings.
    """
    count = np.array([len(s) for s in streams], np.int64)
    number: dict[str, int] = {}
    token = np.fromiter((number.setdefault(w, len(number)) for s in streams for w in s), np.int64)
    page = np.repeat(np.arange(len(streams)), count)
    begin = np.cumsum(count) - count
    # Only suffixes with ``run`` tokens in their page; ranks beyond the page's end count as -1.
    rank, length = token, 1
    order = np.arange(len(token))
    left = np.repeat(begin + count, count) - np.arange(len(token))
    while length < run:
        step = min(length, run - length)
        ahead = np.full(len(rank), -1, np.int64)
        inside = left > step
        ahead[inside] = rank[np.flatnonzero(inside) + step]
        order = np.lexsort((ahead, rank))
        new = (np.diff(rank[order], prepend=-2) != 0) | (np.diff(ahead[order], prepend=-2) != 0)
        rank = np.empty_like(rank)
        rank[order] = np.cumsum(new) - 1
        length += step
    order = np.argsort(rank, kind="stable") if run == 1 else order
    order = order[left[order] >= run]
    return order, np.cumsum(np.diff(rank[order], prepend=-2) != 0) - 1, page[order]


def _group_contents(group: np.ndarray, page: np.ndarray, contents: Sequence[int] | None) -> tuple[np.ndarray, np.ndarray]:
    """(group, page) once for each distinct content of a group, in order of groups."""
    content = page if contents is None else np.unique(np.array(contents, np.int64), return_inverse=True)[1][page]
    pair, at = np.unique(np.stack([group, content]), axis=1, return_index=True)
    return pair[0], page[at]


def _digests(flat: list[str], place: np.ndarray, run: int) -> list[bytes]:
    """128-bit hashes of the substrings at ``place``; no token has white space inside."""
    return [hashlib.blake2b(" ".join(flat[i : i + run]).encode(), digest_size=16).digest() for i in place.tolist()]


def covered(
    streams: list[list[str]],
    run: int = RUN,
    pages: int = PAGES,
    contents: Sequence[int] | None = None,
    elsewhere: Set[bytes] = frozenset(),
) -> list[np.ndarray]:
    """For each page, which of its tokens lie in substrings of ``run`` tokens that ``pages`` distinct pages have.

    Pages of equal ``contents`` count as one page; without them all are distinct.
    Substrings whose hash is in ``elsewhere`` count as shared, too.
    """
    count = np.array([len(s) for s in streams], np.int64)
    cover = np.zeros(count.sum() + 1, np.int64)
    place, group, page = _shared_runs(streams, run)
    if len(place):
        many = np.bincount(_group_contents(group, page, contents)[0]) >= pages
        if elsewhere:
            first = place[np.flatnonzero(np.diff(group, prepend=-1))]
            many |= [x in elsewhere for x in _digests([w for s in streams for w in s], first, run)]
        shared = place[many[group]]
        np.add.at(cover, shared, 1)
        np.add.at(cover, shared + run, -1)
    return np.split(np.cumsum(cover)[:-1] > 0, (np.cumsum(count) - count)[1:]) if len(streams) else []


def runs_of_part(
    streams: list[list[str]], contents: Sequence[int], run: int, pages: int
) -> tuple[list[bytes], list[int]]:
    """(hash, content) for each substring of ``run`` tokens and each of its contents, of which ``pages`` are enough."""
    place, group, page = _shared_runs(streams, run)
    if not len(place):
        return [], []
    first = place[np.flatnonzero(np.diff(group, prepend=-1))]
    group, page = _group_contents(group, page, contents)
    begin = np.searchsorted(group, group)
    enough = np.arange(len(group)) - begin < pages
    digest = _digests([w for s in streams for w in s], first, run)
    return [digest[g] for g in group[enough].tolist()], [contents[p] for p in page[enough].tolist()]


def _words(page: list[tuple[int, str]]) -> list[list[str]]:
    """Tokens of the blocks outside of articles."""
    return [text.split() if kind != ARTICLE else [] for kind, text in page]


def main_texts(
    pages: list[list[tuple[int, str]]],
    run: int,
    least: int,
    contents: Sequence[int] | None = None,
    elsewhere: Set[bytes] = frozenset(),
) -> Iterator[str]:
    """Text of each page of a host from its blocks; for ``contents`` and ``elsewhere`` see ``covered``."""
    words = [_words(page) for page in pages]
    # The array is needed only where a block is open.
    anything = any(kind == OPEN for page in pages for kind, _ in page)
    streams = [[w for block in page for w in block] for page in words]
    marks = covered(streams, run, least, contents, elsewhere) if anything else None
    for p, page in enumerate(pages):
        at, kept = 0, []
        for (kind, text), own in zip(page, words[p]):
            if kind == ARTICLE or kind == OPEN and marks[p][at : at + len(own)].mean() <= COVERED:
                kept.append(text)
            at += len(own)
        yield "\n".join(kept)


def _parse_batches(batches):
    """Replace the last column, the HTML, by kinds and texts of its blocks."""
    for batch in batches:
        found = [blocks(x.as_py() or "") for x in batch.column(batch.num_columns - 1)]
        kinds = pa.array([[k for k, _ in page] for page in found], pa.list_(pa.int8()))
        texts = pa.array([[t for _, t in page] for page in found], pa.list_(pa.string()))
        yield pa.RecordBatch.from_arrays(
            [*batch.columns[:-1], kinds, texts], names=[*batch.schema.names[:-1], "kinds", "texts"]
        )


def _stream_batches(batches):
    """Replace the last column, the HTML, by the content and the tokens outside of articles."""
    for batch in batches:
        found = [blocks(x.as_py() or "") for x in batch.column(batch.num_columns - 1)]
        contents = pa.array([content_of(page) for page in found], pa.int64())
        streams = pa.array([" ".join(w for block in _words(page) for w in block) for page in found], pa.string())
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], contents, streams], names=[*batch.schema.names[:-1], "content", "stream"])


def _run_batches(run: int, least: int):
    """Rows sorted by (host, part) to the runs of each part and their contents."""

    def out(batches):
        key, held = None, []

        def runs():
            digests, contents = runs_of_part([s.split() for _, s in held], [c for c, _ in held], run, least)
            n = len(digests)
            values = [pa.array([key[0]] * n, pa.string()), pa.array([key[1]] * n, pa.int64()), pa.array(digests, pa.binary()), pa.array(contents, pa.int64())]
            return pa.RecordBatch.from_arrays(values, names=["host", "part", "run", "content"])

        for batch in batches:
            columns = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("host", "part", "content", "stream")]
            for host, part, content, stream in zip(*columns):
                if key != (host, part):
                    if held:
                        yield runs()
                    key, held = (host, part), []
                held.append((content, stream))
        if held:
            yield runs()

    return out


def _extract_batches(run: int, least: int):
    """Rows sorted by (host, part), runs that parts share first, to page_id, url, text."""

    def out(batches):
        key, held, elsewhere = None, [], set()

        def texts():
            ids, urls, pages = zip(*held)
            found = list(main_texts(pages, run, least, list(map(content_of, pages)), elsewhere))
            values = [pa.array(ids, id_type), pa.array(urls, pa.string()), pa.array(found, pa.string())]
            return pa.RecordBatch.from_arrays(values, names=["page_id", "url", "text"])

        for batch in batches:
            id_type = batch.schema.field("page_id").type
            columns = [batch.column(batch.schema.get_field_index(x)).to_pylist() for x in ("host", "part", "run", "page_id", "url", "kinds", "texts")]
            for host, part, shared, page_id, url, kinds, blocks_ in zip(*columns):
                if key != (host, part):
                    if held:
                        yield texts()
                    key, held, elsewhere = (host, part), [], set()
                if shared is not None:
                    elsewhere.add(shared)
                else:
                    held.append((page_id, url, list(zip(kinds, blocks_))))
        if held:
            yield texts()

    return out


def host_of(url: Column) -> Column:
    return F.lower(F.coalesce(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def extract(pages: DataFrame, run: int = RUN, least_pages: int = PAGES) -> DataFrame:
    """Main text of every page.  Columns: page_id, url, text.

    One row per row of ``pages`` (``page_id``, ``url``, ``html``; other columns
    are not read).  White space within a block becomes one space, blocks are
    joined by a line break.  Cases: null or empty HTML has an empty text; pages
    with a null url or none with a host are one host; cut-off markup is dropped;
    repeated rows have a text each, but copies of a content, under any url, are
    one page where pages that share a run are counted; an empty table gives no rows.
    """
    rows = pages.select("page_id", "url", host_of(F.col("url")).alias("host"), "html")
    sizes = rows.groupBy("host").agg(F.sum(F.coalesce(F.octet_length("html"), F.lit(0))).alias("bytes"))
    large = written(sizes.where(F.col("bytes") > PART_BYTES), "large-hosts").select(
        "host", F.ceil(F.col("bytes") / PART_BYTES).alias("parts")
    )
    n_large = large.count()
    large = F.broadcast(large) if n_large <= BROADCAST_HOSTS else large
    part = F.pmod(F.xxhash64("page_id", "url"), F.coalesce("parts", F.lit(1)))
    dealt = rows.join(large, "host", "left").select("page_id", "url", "host", part.alias("part"), "html")
    kind = dict(dealt.dtypes)
    parsed = dealt.mapInArrow(
        _parse_batches,
        f"page_id {kind['page_id']}, url string, host string, part long, kinds array<tinyint>, texts array<string>",
    ).withColumn("run", F.lit(None).cast("binary"))
    if n_large:
        cut = rows.join(large, "host").select("host", part.alias("part"), "html")
        parsed = parsed.unionByName(_runs_between_parts(cut, run, least_pages), allowMissingColumns=True)
    together = parsed.repartition("host", "part").sortWithinPartitions("host", "part", F.col("run").asc_nulls_last())
    return together.mapInArrow(_extract_batches(run, least_pages), f"page_id {kind['page_id']}, url string, text string")


def _runs_between_parts(cut: DataFrame, run: int, least: int) -> DataFrame:
    """Runs of large hosts that ``least`` distinct contents have, for each part that they are in.  Columns: host, part, run.

    ``cut`` has host, part, html.  A part hands on each of its runs with ``least``
    contents at most, as more decide nothing.
    """
    streams = cut.mapInArrow(_stream_batches, "host string, part long, content long, stream string")
    together = streams.repartition("host", "part").sortWithinPartitions("host", "part")
    found = written(together.mapInArrow(_run_batches(run, least), "host string, part long, run binary, content long"), "host-runs")
    shared = found.groupBy("host", "run").agg(F.count_distinct("content").alias("n")).where(F.col("n") >= least)
    return found.select("host", "part", "run").distinct().join(shared, ["host", "run"], "left_semi")
