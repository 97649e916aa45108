"""A small causal self-attention language model over subword ids, in numpy.

The text is a sequence of subword ids that ends with an end mark.  A bigram
distribution, counted over the whole training corpus, is the prior; one layer of
causal self-attention over the tokens before corrects it.  The correction is
made for classes of ids: frequent ids are classes of their own, the others share
classes, inside of which the bigram distribution holds.  So every step has a
distribution over all ids that sums to one.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from numpy.lib.stride_tricks import sliding_window_view

#: Tokens of a context window, and tokens at its end that are scored; windows overlap by the rest.
WINDOW, STRIDE = 48, 32
#: Sizes of embeddings and of the layer above attention.
WIDTH, HIDDEN = 32, 48
#: Frequent ids with an embedding and bigram counts of their own.
FREQUENT = 2048
#: Classes of a single id, and classes that share the others.
SINGLE, SHARED = 64, 16
#: Count that every id has in advance.
PRIOR = 0.01
#: Added to the moments of gradients.
TINY = 1e-30


@dataclass
class Bigrams:
    """Counts of the corpus as distributions.  Index ``len(frequent)`` stands for every other id."""

    index: np.ndarray  # of an id among the frequent ones
    unigram: np.ndarray  # log probability by id
    log_pair: np.ndarray  # log probability by index of the id before and index; last column: of the rest as a whole
    cls: np.ndarray  # class by index
    by_class: np.ndarray  # probability of classes by index of the id before
    log_class: np.ndarray
    log_unseen: float  # log probability of the ids that are not frequent, together

    @classmethod
    def of(cls, counts: np.ndarray, frequent: np.ndarray, pairs: np.ndarray) -> "Bigrams":
        """``counts`` by id; ``pairs`` by index of frequent ids, in order, and of the others together if there is one more."""
        m, size = len(frequent), len(counts)
        index = np.full(size, m, np.intp)
        index[frequent] = np.arange(m)
        unigram = (counts + PRIOR) / (counts + PRIOR).sum()
        own = np.append(unigram[frequent], max(1 - unigram[frequent].sum(), 1e-12))
        pair = np.zeros((m + 1, m + 1), np.float32)
        pair[: len(pairs), : len(pairs)] = pairs
        # Witten-Bell: as many virtual counts as there are kinds of followers go to the unigrams.
        kinds = np.maximum((pair > 0).sum(1, keepdims=True), 1).astype(np.float32)
        pair = (pair + kinds * own.astype(np.float32)) / (pair.sum(1, keepdims=True) + kinds)
        classes = _classes(pair, m)
        by_class = np.stack([pair[:, classes == c].sum(1) for c in range(classes.max() + 1)], 1)
        by_class = np.maximum(by_class, 1e-12).astype(np.float32)
        return cls(index, np.log(unigram), np.log(pair), classes, by_class, np.log(by_class), float(np.log(own[-1])))


def _classes(pair: np.ndarray, m: int) -> np.ndarray:
    """Single classes for the most frequent ids; the others by k-means on what they follow."""
    single = min(SINGLE, m)
    out = np.append(np.arange(m), m).astype(np.int32)
    rest = np.arange(single, m + 1)
    if len(rest) <= SHARED:
        return out
    place = pair[:single, rest].T / np.maximum(pair[:single, rest].sum(0)[:, None], 1e-12)
    centre = place[:SHARED].copy()
    for _ in range(8):
        near = ((place**2).sum(1)[:, None] - 2 * place @ centre.T + (centre**2).sum(1)).argmin(1)
        for c in np.unique(near):
            centre[c] = place[near == c].mean(0)
    out[rest] = single + np.unique(near, return_inverse=True)[1]
    return out


def windows(texts: list[np.ndarray], end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(before, wanted, text): contexts, the ids to score at their ends, and the number of the text.

    ``before`` has WINDOW ids per row, each the one before the position, and -1
    where there is none; ``wanted`` has the STRIDE ids to predict, -1 behind the
    end.  Every id of a text is wanted once, and has WINDOW - STRIDE ids of
    context at least, or all there are.
    """
    number = np.array([-(-len(t) // STRIDE) for t in texts], np.int64)
    text = np.repeat(np.arange(len(texts)), number)
    flat = np.concatenate([np.concatenate([np.full(WINDOW - STRIDE, -1, np.int32), [end], t[:-1], np.full(STRIDE, -1, np.int32)]) for t in texts]) if texts else np.zeros(0, np.int32)
    goal = np.concatenate([np.concatenate([t, np.full(STRIDE, -1, np.int32)]) for t in texts]) if texts else np.zeros(0, np.int32)
    length = np.array([len(t) for t in texts], np.int64)
    k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    first = (np.cumsum(length + WINDOW) - (length + WINDOW))[text] + k * STRIDE
    want = (np.cumsum(length + STRIDE) - (length + STRIDE))[text] + k * STRIDE
    if not len(text):
        return np.zeros((0, WINDOW), np.int32), np.zeros((0, STRIDE), np.int32), text
    return sliding_window_view(flat, WINDOW)[first], sliding_window_view(goal, STRIDE)[want], text


_CAUSAL = np.where(np.arange(WINDOW)[None, :] <= np.arange(WINDOW - STRIDE, WINDOW)[:, None], 0, -1e9).astype(np.float32)


def _rows(table: np.ndarray, index: np.ndarray) -> np.ndarray:
    return np.take(table, index, axis=0, mode="clip")


def _sums(rows: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values of ``index``, in order, and the sum of the rows of each)."""
    order = np.argsort(index, kind="stable")
    index = index[order]
    first = np.flatnonzero(np.append(True, index[1:] != index[:-1]))
    # Two numbers are added at once.
    return index[first], np.add.reduceat(_rows(rows, order).view(np.complex64), first).view(np.float32)


class AttentionModel:
    """Parameters, training, and batched masked attention."""

    def __init__(self, bigrams: Bigrams, seed: int = 7):
        draw = np.random.default_rng(seed)
        m, c = len(bigrams.log_pair), bigrams.log_class.shape[1]

        def normal(*shape, scale):
            return (draw.standard_normal(shape) * scale).astype(np.float32)

        self.bigrams = bigrams
        self.params = {
            "token": normal(m, WIDTH, scale=0.3),
            "place": normal(WINDOW, WIDTH, scale=0.3),
            "query": normal(WIDTH, WIDTH, scale=WIDTH**-0.5),
            "key": normal(WIDTH, WIDTH, scale=WIDTH**-0.5),
            "value": normal(WIDTH, WIDTH, scale=WIDTH**-0.5),
            "own": normal(WIDTH, HIDDEN, scale=WIDTH**-0.5),
            "seen": normal(WIDTH, HIDDEN, scale=WIDTH**-0.5),
            "bias": np.zeros(HIDDEN, np.float32),
            "out": normal(HIDDEN, c, scale=0.02),
        }
        self._tables = None

    def _projected(self, token: np.ndarray) -> dict[str, tuple[np.ndarray, np.ndarray]]:
        """Queries, keys with values, and inputs of the layer above, of the given embeddings and of the places."""
        p = self.params
        query = p["query"] * np.float32(WIDTH**-0.5)
        return {
            "q": (token @ query, p["place"][-STRIDE:] @ query),
            # Keys, values, and a one, so that the product with the weights has their sum.
            "kv": tuple(
                np.concatenate([x @ p["key"], x @ p["value"], np.full((len(x), 1), one, np.float32)], 1)
                for x, one in ((token, 1), (p["place"], 0))
            ),
            "o": (token @ p["own"], p["place"][-STRIDE:] @ p["own"] + p["bias"]),
        }

    def _forward(self, before: np.ndarray, t: dict, at: np.ndarray):
        """Corrections of class logits at the scored positions, and what the gradient needs.

        ``at`` has the rows of ``before`` in the tables ``t``.
        """
        p, last = self.params, at[:, -STRIDE:]
        q, kv, hidden = (_rows(t[n][0], x) for n, x in (("q", last), ("kv", at), ("o", last)))
        q += t["q"][1]
        kv += t["kv"][1]
        k, v = kv[:, :, :WIDTH], kv[:, :, WIDTH : 2 * WIDTH]
        weight = q @ k.transpose(0, 2, 1)
        weight += _CAUSAL
        start = np.flatnonzero(before[:, 0] < 0)
        weight[start] += np.where(before[start] >= 0, np.float32(0), np.float32(-1e9))[:, None, :]
        # Scores are small enough for plain exponentials; the limit keeps them finite at any parameters.
        np.exp(np.minimum(weight, np.float32(60), out=weight), out=weight)
        mixed = weight @ kv[:, :, WIDTH:]
        total = mixed[:, :, WIDTH:]
        mixed = mixed[:, :, :WIDTH] / total
        hidden += t["o"][1]
        hidden += (mixed.reshape(-1, WIDTH) @ p["seen"]).reshape(hidden.shape)
        np.maximum(hidden, np.float32(0), out=hidden)
        change = hidden.reshape(-1, HIDDEN) @ p["out"]
        np.clip(change, -60, 60, out=change)
        return change, (q, k, v, weight, total, mixed, hidden)

    def log_probability(self, before: np.ndarray, wanted: np.ndarray, rows: int = 64) -> np.ndarray:
        """Natural log probability of the wanted ids; 0 where none is wanted."""
        b, out = self.bigrams, np.zeros(wanted.shape)
        if self._tables is None:
            self._tables = self._projected(self.params["token"])
        for low in range(0, len(before), rows):
            part, goal = before[low : low + rows], wanted[low : low + rows]
            at = np.where(part >= 0, b.index[part], 0)
            change, _ = self._forward(part, self._tables, at)
            at, last = b.index[goal.reshape(-1)], at[:, -STRIDE:].reshape(-1)
            # Probabilities of classes are those of the bigrams times the exponentials of their changes.
            chosen = change[np.arange(len(at)), b.cls[at]]
            total = np.log(np.einsum("ij,ij->i", np.exp(change, out=change), _rows(b.by_class, last)))
            # The chosen class with the id inside of it by the bigrams, then the id among the others.
            found = chosen - total + b.log_pair[last, at]
            rest = at == len(b.log_pair) - 1
            found = found.astype(float)
            found[rest] += b.unigram[goal.reshape(-1)[rest]] - b.log_unseen
            out[low : low + rows] = np.where(goal >= 0, found.reshape(goal.shape), 0)
        return out

    def train(self, before: np.ndarray, wanted: np.ndarray, epochs: int = 2, rows: int = 64, rate: float = 3e-3, seed: int = 11) -> None:
        """Adam on the class cross-entropy, in a fixed random order."""
        draw = np.random.default_rng(seed)
        # One array has all parameters, so that a step is few operations.
        flat = np.concatenate([x.ravel() for x in self.params.values()])
        self.params, self._tables = self._parts(flat), None
        first, second, gradient, change = (np.zeros_like(flat) for _ in range(4))
        into = self._parts(gradient)
        steps = max(1, epochs * -(-len(before) // rows))
        step = 0
        for _ in range(epochs):
            order = draw.permutation(len(before))
            for low in range(0, len(order), rows):
                step += 1
                pick = order[low : low + rows]
                speed = rate * min(1, step / 50) * (1 - 0.9 * step / steps)
                scale = speed * (1 - 0.99**step) ** 0.5 / (1 - 0.9**step)
                self._gradient(before[pick], wanted[pick], into)
                # What is added keeps moments of ids that are not seen from becoming denormal, which is slow.
                first *= 0.9
                first += np.add(np.multiply(gradient, 0.1, out=change), TINY, out=change)
                second *= 0.99
                gradient *= gradient
                second += np.add(np.multiply(gradient, 0.01, out=change), TINY, out=change)
                np.sqrt(second, out=change)
                change += 1e-8
                np.divide(first, change, out=change)
                change *= scale
                flat -= change

    def _parts(self, flat: np.ndarray) -> dict[str, np.ndarray]:
        """The parts of an array that stand for the parameters."""
        cuts = np.cumsum([x.size for x in self.params.values()])[:-1]
        return {n: part.reshape(x.shape) for (n, x), part in zip(self.params.items(), np.split(flat, cuts))}

    def _gradient(self, before: np.ndarray, wanted: np.ndarray, into: dict[str, np.ndarray]) -> None:
        p, b = self.params, self.bigrams
        at = np.where(before >= 0, b.index[before], 0)
        by_class, goal = _rows(b.by_class, at[:, -STRIDE:].reshape(-1)), wanted.reshape(-1)
        # Embeddings are read and changed once for each id of the batch.
        used = np.zeros(len(p["token"]), bool)
        used[at] = True
        used = np.flatnonzero(used)
        place = np.zeros(len(p["token"]), np.uint16 if len(p["token"]) <= 1 << 16 else np.intp)
        place[used] = np.arange(len(used))
        at, token = place[at], p["token"][used]
        d, (q, k, v, weight, total, mixed, hidden) = self._forward(before, self._projected(token), at)
        # Probabilities of classes, as in log_probability, less one for the class that is wanted.
        np.exp(d, out=d)
        d *= by_class
        share = ((goal >= 0) / max(1, (goal >= 0).sum())).astype(np.float32)
        d *= (share / (d @ np.ones(d.shape[1], np.float32)))[:, None]
        d[np.arange(len(goal)), b.cls[b.index[goal]]] -= share
        flat = hidden.reshape(-1, HIDDEN)
        # Gradients of queries and inputs of the layer above side by side, and of keys and values.
        d_qo, d_kv = np.empty((len(d), WIDTH + HIDDEN), np.float32), np.empty((*at.shape, 2 * WIDTH), np.float32)
        d_hidden = d_qo[:, WIDTH:]
        np.matmul(d, p["out"].T, out=d_hidden)
        d_hidden *= flat > 0
        d_mixed = (d_hidden @ p["seen"].T).reshape(mixed.shape)
        mean = np.einsum("ijk,ijk->ij", d_mixed, mixed)[:, :, None] / total
        d_mixed /= total
        np.matmul(weight.transpose(0, 2, 1), d_mixed, out=d_kv[:, :, WIDTH:])
        d_score = d_mixed @ v.transpose(0, 2, 1)
        d_score -= mean
        d_score *= weight
        np.matmul(d_score, k, out=d_qo.reshape(len(at), STRIDE, -1)[:, :, :WIDTH])
        np.matmul(d_score.transpose(0, 2, 1), q, out=d_kv[:, :, :WIDTH])
        np.matmul(mixed.reshape(-1, WIDTH).T, d_hidden, out=into["seen"])
        np.matmul(flat.T, d, out=into["out"])
        # What is the same for all places of an id, and for all ids of a place, is added up first.
        _, by_id = _sums(d_kv.reshape(-1, 2 * WIDTH), at.reshape(-1))
        last, by_last = _sums(d_qo, at[:, -STRIDE:].reshape(-1))
        by_place, by_end = d_kv.sum(0), d_qo.reshape(len(at), STRIDE, -1).sum(0)
        scale = np.float32(WIDTH**-0.5)
        kv, qo = np.concatenate([p["key"], p["value"]], 1), np.concatenate([p["query"] * scale, p["own"]], 1)
        d_token = by_id @ kv.T
        d_token[last] += by_last @ qo.T
        into["token"][:] = 0
        into["token"][used] = d_token
        np.matmul(by_place, kv.T, out=into["place"])
        into["place"][-STRIDE:] += by_end @ qo.T
        d_kv = token.T @ by_id + p["place"].T @ by_place
        d_qo = token[last].T @ by_last + p["place"][-STRIDE:].T @ by_end
        into["key"][:], into["value"][:] = d_kv[:, :WIDTH], d_kv[:, WIDTH:]
        into["query"][:], into["own"][:] = d_qo[:, :WIDTH] * scale, d_qo[:, WIDTH:]
        into["bias"][:] = by_end[:, WIDTH:].sum(0)
