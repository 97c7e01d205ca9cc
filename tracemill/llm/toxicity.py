"""Toxicity: a bidirectional gated recurrent network with attention pooling, written and trained in numpy.

A word's input has three parts of ``WIDE`` numbers: an embedding of the word, if the sample used for fitting has it
``OFTEN`` times, the mean embedding of its hashed byte trigrams, and an embedding of its hashed first six bytes. Windows of ``WINDOW`` words, each ``STRIDE`` after
the one before, so that they overlap, and the last one ending with the text, run through a GRU in both directions; attention pools the states, and a
linear layer gives the window's logit. All windows of a text are scored. A logistic regression on the greatest logit, the mean of the greatest three, the mean, and
the number of windows gives the text's score.

Labels belong to texts, not windows, so training is by multiple instances: after some epochs on windows drawn at random,
the windows that the network itself finds most toxic stand for their texts. It is fitted on the driver with about
``LEARN`` labelled documents a label, of at most ``common.LEARN_BYTES`` together (the stated bounds of the sample); a fifth of them is kept for the last regression.

Nulls: a null text is an empty one; it has no window and is scored by the biases. Null labels teach nothing; of several labels of a document the
largest counts. With one label or none the score is that label's share, (n1 + 1) / (n + 2). Texts of any length are scored
whole, a part at a time. Repeated rows are each returned; other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytewords import bounds, chunks, hashed, mixed, pieces
from .common import fold, labelled_texts
from .decontam import TABLE

WINDOW, STRIDE = 32, 20
WIDE, UNITS = 8, 8
BUCKETS, VOCABULARY, OFTEN = 1 << 12, 1 << 12, 4
LEARN = 1500
CHUNK = 1 << 20
#: In texts of over ``CHUNK`` bytes a longer word is taken in parts of this many bytes.
_GIANT = re.compile(rb"[^ ]{4096}")


class Words:
    """The words of some texts: hash, prefix bucket, trigram codes (ragged), number of the text."""

    def __init__(self, texts: list[bytes]) -> None:
        raw, self.starts, since, self.owner = bounds([t.translate(TABLE) for t in texts])
        self.hashes = hashed(raw, self.starts, since)
        inside = (raw != 32) & (raw != 10)
        letters = np.where(inside, raw, 32).astype(np.int64)
        padded = np.concatenate([[32], letters, [32]])
        codes = ((padded[:-2] * 961 + padded[1:-1] * 31 + padded[2:]) * 40503 >> 4) & (BUCKETS - 1)
        self.codes = codes[inside].astype(np.int16)
        self.known: np.ndarray | None = None
        # A word's bytes stand together among the bytes inside words.
        self.first = np.cumsum(inside)[self.starts] - 1 if len(self.starts) else np.empty(0, np.int64)
        self.length = np.diff(np.concatenate([self.first, [len(self.codes)]]))
        prefix = np.zeros(len(self.starts), np.uint64)
        for k in range(6):
            at = np.minimum(self.starts + k, len(raw) - 1)
            prefix = prefix * np.uint64(1_000_003) + np.where(self.length > k, letters[at], 0).astype(np.uint64)
        self.prefix = (mixed(prefix) >> np.uint64(40)).astype(np.int64) & (BUCKETS - 1)

    @classmethod
    def joined(cls, texts: list[bytes]) -> Words:
        """Of more texts than are worked on at once: the same, piece by piece."""
        out, parts, codes = cls([b""]), [], 0
        for begin, end in chunks([len(t) for t in texts], CHUNK):
            part = cls(texts[begin:end])
            parts.append((part.hashes, part.prefix, part.length, part.first + codes, part.owner + begin, part.starts, part.codes))
            codes += len(part.codes)
        if parts:
            out.hashes, out.prefix, out.length, out.first, out.owner, out.starts, out.codes = (np.concatenate(c) for c in zip(*parts, strict=True))
        return out

    def part(self, begin: int, end: int) -> Words:
        """The words from ``begin`` to ``end``."""
        out = object.__new__(Words)
        out.hashes, out.prefix, out.length, out.owner, out.starts = (c[begin:end] for c in (self.hashes, self.prefix, self.length, self.owner, self.starts))
        low = int(self.first[begin]) if begin < len(self.first) else 0
        out.first, out.codes = self.first[begin:end] - low, self.codes[low : low + int(out.length.sum())]
        out.known = None if self.known is None else self.known[begin:end]
        return out


def window_starts(n_words: int) -> list[int]:
    if n_words <= WINDOW:
        return [0] if n_words else []
    out = list(range(0, n_words - WINDOW + 1, STRIDE))
    return out if out[-1] == n_words - WINDOW else [*out, n_words - WINDOW]


def windows(owner: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For every window its first word, its number of words and its text."""
    edges = np.searchsorted(owner, np.arange(texts + 1))
    begin, size, text = [], [], []
    for i in range(texts):
        n = int(edges[i + 1] - edges[i])
        mine = window_starts(n)
        begin += [int(edges[i]) + s for s in mine]
        size += [min(n, WINDOW)] * len(mine)
        text += [i] * len(mine)
    return np.array(begin, np.int64), np.array(size, np.int64), np.array(text, np.int64)


def _sigmoid(x):
    return np.float32(0.5) * (np.float32(1.0) + np.tanh(np.float32(0.5) * x))


class Network:
    def __init__(self, vocabulary: np.ndarray, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        normal = lambda *shape, scale: (rng.standard_normal(shape) * scale).astype(np.float32)
        d, u = 3 * WIDE, UNITS
        self.vocabulary = vocabulary
        self.p = {
            "word": normal(len(vocabulary) + 1, WIDE, scale=0.1), "char": normal(BUCKETS, WIDE, scale=0.3), "prefix": normal(BUCKETS, WIDE, scale=0.1),
            "w": normal(d, 6 * u, scale=d**-0.5), "b": np.zeros(6 * u, np.float32), "u0": normal(u, 3 * u, scale=u**-0.5), "u1": normal(u, 3 * u, scale=u**-0.5),
            "a": normal(2 * u, scale=0.1), "o": normal(2 * u, scale=0.3), "c": np.zeros(1, np.float32),
        }
        self.final = np.array([0.0, 1.0, 0.0, 0.0, 0.0])  # bias, and the weights of the text's four figures
        self.constant: float | None = None

    def number(self, words: Words) -> np.ndarray:
        if words.known is not None:
            return words.known
        at = np.searchsorted(self.vocabulary, words.hashes)
        at[at == len(self.vocabulary)] = 0
        return np.where(self.vocabulary[at] == words.hashes, at + 1, 0) if len(self.vocabulary) else np.zeros(len(words.hashes), np.int64)

    def inputs(self, words: Words) -> np.ndarray:
        """The input of every word, projected for both directions."""
        if not len(words.starts):
            return np.zeros((0, 6 * UNITS), np.float32)
        chars = np.add.reduceat(self.p["char"][words.codes], words.first, axis=0) / words.length[:, None].astype(np.float32)
        x = np.concatenate([self.p["word"][self.number(words)], chars, self.p["prefix"][words.prefix]], axis=1)
        return x @ self.p["w"] + self.p["b"]

    def recur(self, x: np.ndarray, keep: np.ndarray | None, direction: int, tape: list | None = None) -> np.ndarray:
        """x: (WINDOW, n, 3 units) to the states (WINDOW, n, units); ``keep`` is 0 where a window has no word."""
        u, k = self.p[f"u{direction}"], UNITS
        states = np.empty((WINDOW, x.shape[1], k), np.float32)
        h = np.zeros((x.shape[1], k), np.float32)
        for t in range(WINDOW) if direction == 0 else range(WINDOW - 1, -1, -1):
            hu = h @ u
            zr = _sigmoid(x[t, :, : 2 * k] + hu[:, : 2 * k])
            n = np.tanh(x[t, :, 2 * k :] + zr[:, k:] * hu[:, 2 * k :])
            new = n + zr[:, :k] * (h - n)
            if keep is not None:
                new = h + keep[t][:, None] * (new - h)
            if tape is not None:
                tape.append((t, h, zr, n, hu[:, 2 * k :]))
            states[t] = h = new
        return states

    def logits(self, projected: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
        out = np.empty(len(begin), np.float32)
        whole = size == WINDOW
        for full in (True, False):
            chosen = np.flatnonzero(whole == full)
            for s in range(0, len(chosen), 4096):
                part = chosen[s : s + 4096]
                steps = np.arange(WINDOW)[:, None]
                at = begin[part] + np.minimum(steps, size[part] - 1)
                keep = None if full else (steps < size[part]).astype(np.float32)
                x = projected[at]
                h = np.concatenate([self.recur(x[:, :, : 3 * UNITS], keep, 0), self.recur(x[:, :, 3 * UNITS :], keep, 1)], axis=2)
                out[part] = self.pool(h, keep)[0]
        return out

    def all_logits(self, words: Words, begin: np.ndarray, size: np.ndarray, text: np.ndarray, limit: int = 100_000) -> np.ndarray:
        """``logits`` of many texts, some texts at a time."""
        out, edges = np.empty(len(begin), np.float32), np.flatnonzero(np.concatenate([[True], text[1:] != text[:-1]]))
        sizes = [int(begin[e - 1] + size[e - 1] - begin[s]) for s, e in zip(edges, [*edges[1:], len(begin)], strict=True)]
        for a, b in chunks(sizes, limit):
            w = slice(edges[a], edges[b] if b < len(edges) else len(begin))
            low, high = int(begin[w][0]), int(begin[w][-1] + size[w][-1])
            out[w] = self.logits(self.inputs(words.part(low, high)), begin[w] - low, size[w])
        return out

    def pool(self, h: np.ndarray, keep: np.ndarray | None):
        score = h @ self.p["a"]
        if keep is not None:
            score = np.where(keep > 0, score, np.float32(-1e9))
        weight = np.exp(score - score.max(axis=0))
        weight /= weight.sum(axis=0)
        pooled = np.einsum("tn,tnk->nk", weight, h)
        return pooled @ self.p["o"] + self.p["c"], weight, pooled

    def step(self, words: Words, begin: np.ndarray, size: np.ndarray, y: np.ndarray, adam: dict, rate: float) -> None:
        """One Adam step on the windows' mean logistic loss, by back-propagation."""
        p, k, n = self.p, UNITS, len(begin)
        steps = np.arange(WINDOW)[:, None]
        at = begin + np.minimum(steps, size - 1)
        keep = (steps < size).astype(np.float32)
        unique, back = np.unique(at, return_inverse=True)
        back = back.reshape(at.shape)
        length = words.length[unique]
        spread = np.repeat(words.first[unique] - np.concatenate([[0], np.cumsum(length)[:-1]]), length) + np.arange(length.sum())
        codes, owner = words.codes[spread], np.repeat(np.arange(len(unique)), length)
        number, prefix = self.number(words)[unique], words.prefix[unique]
        chars = np.add.reduceat(p["char"][codes], np.concatenate([[0], np.cumsum(length)[:-1]]), axis=0) / length[:, None].astype(np.float32)
        ux = np.concatenate([p["word"][number], chars, p["prefix"][prefix]], axis=1)
        x = (ux @ p["w"] + p["b"])[back]
        tapes: tuple[list, list] = ([], [])
        h = np.concatenate([self.recur(x[:, :, 3 * k * i : 3 * k * (i + 1)], keep, i, tapes[i]) for i in (0, 1)], axis=2)
        logit, weight, pooled = self.pool(h, keep)
        g = {name: np.zeros_like(v) for name, v in p.items()}
        dlogit = (_sigmoid(logit) - y).astype(np.float32) / n
        g["o"], g["c"] = pooled.T @ dlogit, np.array([dlogit.sum()], np.float32)
        dpooled = dlogit[:, None] * p["o"]
        dweight = np.einsum("tnk,nk->tn", h, dpooled)
        dscore = weight * (dweight - (weight * dweight).sum(axis=0))
        g["a"] = np.einsum("tn,tnk->k", dscore, h)
        dh_all = weight[:, :, None] * dpooled + dscore[:, :, None] * p["a"]
        dx = np.zeros_like(x)
        for i in (0, 1):
            u, carry = p[f"u{i}"], np.zeros((n, k), np.float32)
            for t, before, zr, cand, hun in reversed(tapes[i]):
                total = dh_all[t, :, k * i : k * (i + 1)] + carry
                live = total * keep[t][:, None]
                z, r = zr[:, :k], zr[:, k:]
                dcand = live * (1 - z) * (1 - cand * cand)
                dz = live * (before - cand) * z * (1 - z)
                dr = dcand * hun * r * (1 - r)
                dhu = np.concatenate([dz, dr, dcand * r], axis=1)
                dx[t, :, 3 * k * i : 3 * k * (i + 1)] = np.concatenate([dz, dr, dcand], axis=1)
                g[f"u{i}"] += before.T @ dhu
                carry = total - live + live * z + dhu @ u.T
        dux = np.zeros((len(unique), 6 * k), np.float32)
        flat = dx.reshape(-1, 6 * k)
        for c in range(6 * k):
            dux[:, c] = np.bincount(back.ravel(), flat[:, c], len(unique))
        g["w"], g["b"] = ux.T @ dux, dux.sum(axis=0)
        din = dux @ p["w"].T
        dchar = (din[:, WIDE : 2 * WIDE] / length[:, None])[owner]
        for name, places, grad in (("word", number, din[:, :WIDE]), ("char", codes, dchar), ("prefix", prefix, din[:, 2 * WIDE :])):
            for c in range(WIDE):
                g[name][:, c] = np.bincount(places, grad[:, c], len(g[name]))
        adam["t"] = adam.get("t", 0) + 1
        for name, grad in g.items():
            m, v = adam.setdefault(name, (np.zeros_like(grad), np.zeros_like(grad)))
            m += 0.1 * (grad - m)
            v += 0.001 * (grad * grad - v)
            p[name] -= (rate * (m / (1 - 0.9 ** adam["t"])) / (np.sqrt(v / (1 - 0.999 ** adam["t"])) + 1e-6)).astype(np.float32)

    def figures(self, logits: np.ndarray, text: np.ndarray, texts: int) -> np.ndarray:
        """A text's greatest logit, mean of the greatest three, mean, and logarithm of one more than its windows."""
        out = np.tile(np.array([self.p["c"][0]] * 3 + [0.0]), (texts, 1))
        edges = np.searchsorted(text, np.arange(texts + 1))
        for i in np.flatnonzero(np.diff(edges)):
            mine = np.sort(logits[edges[i] : edges[i + 1]])
            out[i] = mine[-1], mine[-3:].mean(), mine.mean(), np.log1p(len(mine))
        return out

    def scores(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        figures = np.empty((len(texts), 4))
        for begin, end in chunks([len(t) for t in texts], CHUNK):
            long = end - begin == 1 and len(texts[begin]) > CHUNK
            logits, text = self.long_logits(texts[begin]) if long else self._logits(texts[begin:end])
            figures[begin:end] = self.figures(logits, text, end - begin)
        return 1 / (1 + np.exp(-np.clip(self.final[0] + figures @ self.final[1:], -30, 30)))

    def _logits(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        words = Words(texts)
        first, size, text = windows(words.owner, len(texts))
        return self.logits(self.inputs(words), first, size), text

    def long_logits(self, text: bytes, limit: int = CHUNK) -> tuple[np.ndarray, np.ndarray]:
        """The logits of all windows of one text, worked on in parts of about ``limit`` bytes. From a part's last window on its words go in front
        of the next part, so that every window, the text's last one included, has all its words."""
        out, held, done = [np.empty(0, np.float32)], b"", False
        parts = pieces(text.translate(TABLE), limit, whole_words=False)
        part = next(parts)
        while part is not None:
            following = next(parts, None)
            held += b" " + _GIANT.sub(rb"\g<0> ", part)
            words = Words([held])
            n = len(words.starts)
            starts = list(range(STRIDE if done else 0, n - WINDOW + 1, STRIDE))
            if following is None and not done and n <= WINDOW:
                starts = [0] if n else []
            elif following is None and (n - WINDOW) % STRIDE:
                starts.append(n - WINDOW)
            out.append(self.logits(self.inputs(words), np.array(starts, np.int64), np.full(len(starts), min(n, WINDOW))))
            if n >= WINDOW:
                held, done = held[int(words.starts[(n - WINDOW) // STRIDE * STRIDE]) :], True
            part = following
        logits = np.concatenate(out)
        return logits, np.zeros(len(logits), np.int64)


def train(texts: list[bytes], labels: list[int], shares: tuple[float, float] = (1.0, 1.0), seed: int = 11, batch: int = 256, epochs: int = 6, drawn: int = 16_000) -> Network:
    """``shares``: how many documents a sampled one of label 0 or 1 stands for."""
    y = np.array(labels, np.float32)
    if not len(y) or y.min() == y.max():
        blank = Network(np.empty(0, np.uint64), seed)
        blank.constant = float((y.sum() + 1) / (len(y) + 2))
        return blank
    rng = np.random.default_rng(seed)
    words = Words.joined(texts)
    once = np.unique(words.hashes ^ mixed(words.owner.astype(np.uint64)), return_index=True)[1]
    values, counts = np.unique(words.hashes[once], return_counts=True)
    frequent = values[counts >= OFTEN][np.argsort(-counts[counts >= OFTEN], kind="stable")][:VOCABULARY]
    net = Network(np.sort(frequent), seed)
    words.known = net.number(words)
    begin, size, text = windows(words.owner, len(texts))
    fitted = rng.random(len(texts)) >= 0.2
    of = y[text]
    adam: dict = {}
    for epoch in range(epochs):
        if epoch < 2:
            pools = [rng.permutation(np.flatnonzero((of == v) & fitted[text]))[: drawn // 2] for v in (0, 1)]
        else:
            logits = net.all_logits(words, begin, size, text) + 1e-6 * rng.random(len(begin))
            order = np.lexsort((-logits, text))
            nth = np.arange(len(order)) - np.searchsorted(text[order], text[order])
            each = np.bincount(text, minlength=len(texts))[text[order]]
            top = order[nth < np.where(of[order] == 1, np.maximum(1, np.minimum(4, each // 3)), 2)]
            top = top[fitted[text[top]]]
            pools = [top[of[top] == v] for v in (0, 1)]
            pools[0] = np.concatenate([pools[0], rng.permutation(np.flatnonzero((of == 0) & fitted[text]))[: len(pools[0]) // 2]])
        chosen = rng.permutation(np.concatenate(pools))
        for s in range(0, len(chosen), batch):
            part = chosen[s : s + batch]
            net.step(words, begin[part], size[part], of[part], adam, 0.015 if epoch < 4 else 0.005)
    figures = net.figures(net.all_logits(words, begin, size, text), text, len(texts))
    rest = ~fitted if len(set(y[~fitted])) == 2 else np.ones(len(y), bool)
    x = np.concatenate([np.ones((rest.sum(), 1)), figures[rest]], axis=1)
    share, w = np.where(y[rest] == 1, shares[1], shares[0]), np.zeros(5)
    share = share / share.mean()
    for _ in range(25):  # Newton steps of a ridge logistic regression
        q = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        ridge = np.diag([1e-3, 0.1, 0.1, 0.1, 0.1])
        w -= np.linalg.solve((x * (share * q * (1 - q))[:, None]).T @ x + ridge, x.T @ (share * (q - y[rest])) + ridge @ w)
    net.final = w
    return net


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", learn: int = LEARN, parts: int = 5, id_col="doc_id", text_col="text") -> Network:
    rows = labelled_texts(docs, labels, label, learn, parts, id_col, text_col)
    known = labels.where(fold(F.col(id_col), parts) != 0).groupBy(label).count().collect()
    have = {v: max(1, sum(r[2] == v for r in rows)) for v in (0, 1)}
    shares = tuple(max(1.0, sum(r["count"] for r in known if r[label] == v) / have[v]) for v in (0, 1))
    return train([(r[1] or "").encode("utf-8", "surrogatepass") for r in rows], [r[2] for r in rows], shares)


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [b"" if t is None else t for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.scores(texts), pa.float64())], ["id", "score"])

    return run


def score(docs: DataFrame, network: Network, id_col="doc_id", text_col="text") -> DataFrame:
    """(id, score) of every row."""
    chosen = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = chosen.schema["id"].dataType.simpleString()
    return chosen.mapInArrow(_scored(docs.sparkSession.sparkContext.broadcast(network)), f"id {kind}, score double")
