"""Toxicity by a bidirectional gated recurrent network with attention pooling over character and word inputs.

A text is cut into overlapping windows of words; a longer stretch without white space than LONGEST enters as
consecutive overlapping pieces, each a word of its own. Every word enters by itself and by its characters (edges
and trigrams); two recurrent passes read a window, attention pools their states into a logit, and a text is as
toxic as its most toxic window, however many others it has. Everything is trained in numpy.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame

from tidemark.llm.common import append_columns, values
from tidemark.llm.quality import Adam, bounded_sample

#: Words (or pieces) of a window, and from one window's start to the next.
WINDOW, STRIDE = 24, 16
#: Labelled documents of each label that the model is fitted on, about, and the bytes of their texts together.
SAMPLE_DOCS, SAMPLE_BYTES = 500, 16 << 20
BUCKETS, INPUT, HIDDEN = 1 << 15, 10, 8
#: Characters of a word, and of two neighbouring pieces of a longer one together.
LONGEST, OVERLAP = 24, 8
#: Words that a task keeps encoded; windows that are read at once; characters of a text that are split at once.
KNOWN_WORDS, HELD, PART = 200_000, 2_048, 1 << 18


def word_inputs(word: str) -> list[int]:
    """Buckets of a word: the word, its edges of 4 and 6 characters, its character trigrams."""
    w = word.strip(".,!?;:|#$%&*\"'()") or word
    keys = ["=" + w, "<" + w[:4], "[" + w[:6], ">" + w[-4:], *{w[i : i + 3] for i in range(len(w) - 2)}]
    return [zlib.crc32(k.encode()) % BUCKETS for k in keys]


def pieces(word: str) -> list[str]:
    """The word, or the overlapping pieces that cover it if it is longer than LONGEST."""
    return [word[i : i + LONGEST] for i in range(0, max(1, len(word) - OVERLAP), LONGEST - OVERLAP)]


def split(text: str | None) -> Iterator[list[str]]:
    """The words and pieces of a text, part by part."""
    text, left = (text or ""), ""
    for i in range(0, len(text), PART):
        left += text[i : i + PART].lower()
        last = i + PART >= len(text)
        if last:
            head, left = left, ""
        else:
            cut = max(left.rfind(" "), left.rfind("\n"))
            if cut >= 0:
                head, left = left[:cut], left[cut:]
            else:  # a stretch goes on: its pieces do too
                cut = (len(left) - OVERLAP) // (LONGEST - OVERLAP) * (LONGEST - OVERLAP)
                head, left = left[: cut + OVERLAP], left[cut:]
        yield [p for w in head.split() for p in (pieces(w) if len(w) > LONGEST else (w,))]


class WordTable:
    """Words of some texts as rows, with the buckets of each row."""

    def __init__(self) -> None:
        self.row: dict[str, int] = {}
        self.buckets: list[list[int]] = []

    def rows(self, words: list[str]) -> list[int]:
        ids = list(map(self.row.get, words))
        for i, w in enumerate(words):
            if ids[i] is None:
                ids[i] = self.row.get(w)
                if ids[i] is None:
                    ids[i] = self.row[w] = len(self.buckets)
                    self.buckets.append(word_inputs(w))
        return ids

    def windows(self, text: str | None) -> Iterator[np.ndarray]:
        """Rows of the words of all overlapping windows, part by part; -1 beyond the text's end. A text without words is one empty window."""
        left, first = [], True
        parts = split(text)
        words = next(parts, [])
        while words is not None:
            following = next(parts, None)
            left += words
            n = len(left)
            count = max(int(first), -(-(n - (WINDOW - STRIDE)) // STRIDE)) if following is None else max(0, (n - WINDOW) // STRIDE + 1)
            if count > 0:
                padded = np.full((count - 1) * STRIDE + WINDOW, -1, np.int64)
                ids = self.rows(left[: len(padded)])
                padded[: len(ids)] = ids
                left, first = left[count * STRIDE :], False
                yield padded[np.arange(count)[:, None] * STRIDE + np.arange(WINDOW)]
            words = following

    def sparse(self, first: int = 0) -> tuple[np.ndarray, np.ndarray]:
        """(row, bucket) of all inputs of the rows from first on, rows counted from there."""
        sizes = [len(b) for b in self.buckets[first:]]
        return np.repeat(np.arange(len(sizes)), sizes), np.array([x for b in self.buckets[first:] for x in b], np.int64)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 + 0.5 * np.tanh(0.5 * x)


class BiGRU:
    """Two GRUs over INPUT values a word, attention over their states, a logit for each window."""

    def __init__(self, seed: int = 3):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.embed = (0.1 * r.standard_normal((BUCKETS, INPUT))).astype(np.float32)
        self.p = {"embed": self.embed, "a": init(2 * HIDDEN, 1), "o": init(2 * HIDDEN, 1), "c": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": init(INPUT, 3 * HIDDEN), f"R{side}": init(HIDDEN, 2 * HIDDEN), f"S{side}": init(HIDDEN, HIDDEN), f"B{side}": np.zeros(3 * HIDDEN, np.float32)}

    def words(self, rows: np.ndarray, buckets: np.ndarray, n: int) -> np.ndarray:
        """Inputs of n words: the sum of their buckets' vectors over the root of their number; the last row, for -1, is zero."""
        out = np.zeros((n + 1, INPUT), np.float32)
        for k in range(INPUT):
            out[:n, k] = np.bincount(rows, self.embed[buckets, k], n)[:n]
        out[:n] /= np.sqrt(np.maximum(np.bincount(rows, minlength=n), 1))[:n, None]
        return out

    def _read(self, side: str, gates: np.ndarray, win: np.ndarray, keep: list | None) -> np.ndarray:
        """States of one direction, (WINDOW, windows, HIDDEN); the state stays where a window has no word."""
        R, S = self.p[f"R{side}"], self.p[f"S{side}"]
        h, out = np.zeros((len(win), HIDDEN), np.float32), np.empty((WINDOW, len(win), HIDDEN), np.float32)
        for t in range(WINDOW) if side == "f" else range(WINDOW - 1, -1, -1):
            g = gates[win[:, t]]
            zr = _sigmoid(g[:, : 2 * HIDDEN] + h @ R)
            z, r = zr[:, :HIDDEN] * (win[:, t] >= 0)[:, None], zr[:, HIDDEN:]
            n = np.tanh(g[:, 2 * HIDDEN :] + (r * h) @ S)
            if keep is not None:
                keep.append((t, h, z, zr, r, n))
            h = h + z * (n - h)
            out[t] = h
        return out

    def forward(self, x: np.ndarray, win: np.ndarray, keep: dict | None = None) -> np.ndarray:
        """Logits of the windows, whose entries are rows of x."""
        sides = []
        for side in "fb":
            steps = None if keep is None else keep.setdefault(side, [])
            sides.append(self._read(side, x @ self.p[f"W{side}"] + self.p[f"B{side}"], win, steps))
        states = np.concatenate(sides, 2)
        e = (states @ self.p["a"])[:, :, 0]
        e = np.where(win.T >= 0, e, -30)
        e = np.exp(e - e.max(0))
        e /= e.sum(0)
        pooled = np.einsum("tn,tnh->nh", e, states)
        if keep is not None:
            keep |= {"states": states, "e": e, "pooled": pooled}
        return (pooled @ self.p["o"])[:, 0] + self.p["c"]

    def gradients(self, x: np.ndarray, win: np.ndarray, keep: dict, dlogit: np.ndarray) -> tuple[dict, np.ndarray]:
        """Gradients of the parameters but embed, and of x."""
        p, states, e = self.p, keep["states"], keep["e"]
        grads = {"o": keep["pooled"].T @ dlogit[:, None], "c": dlogit.sum(keepdims=True)}
        dpool = dlogit[:, None] * p["o"].T
        de = np.einsum("nh,tnh->tn", dpool, states)
        ds = e * (de - (e * de).sum(0)) * (win.T >= 0)
        grads["a"] = np.einsum("tnh,tn->h", states, ds)[:, None]
        dstates = e[:, :, None] * dpool + ds[:, :, None] * p["a"][:, 0]
        dx = np.zeros_like(x)
        for side, part in (("f", slice(0, HIDDEN)), ("b", slice(HIDDEN, 2 * HIDDEN))):
            R, S = p[f"R{side}"], p[f"S{side}"]
            gR, gS, gB, steps = np.zeros_like(R), np.zeros_like(S), np.zeros(3 * HIDDEN, np.float32), []
            dh = np.zeros((len(win), HIDDEN), np.float32)
            for t, h, z, zr, r, n in reversed(keep[side]):
                dh = dh + dstates[t][:, part]
                dn = dh * z * (1 - n * n)
                dz = dh * (n - h) * z * (1 - zr[:, :HIDDEN])
                drh = dn @ S.T
                dr = drh * h * r * (1 - r)
                gS += (r * h).T @ dn
                dzr = np.concatenate([dz, dr], 1)
                gR += h.T @ dzr
                d = np.concatenate([dzr, dn], 1)
                gB += d.sum(0)
                steps.append((win[:, t], d))
                dh = dh * (1 - z) + drh * r + dzr @ R.T
            at, d = np.concatenate([w for w, _ in steps]), np.concatenate([d for _, d in steps])
            at = np.where(at < 0, len(x) - 1, at)
            dgates = np.stack([np.bincount(at, d[:, k], len(x)) for k in range(3 * HIDDEN)], 1).astype(np.float32)
            grads |= {f"R{side}": gR, f"S{side}": gS, f"B{side}": gB, f"W{side}": x.T @ dgates}
            dx += dgates @ p[f"W{side}"].T
        return grads, dx

    def fit(self, texts: list[str | None], labels: np.ndarray, epochs: int = 6, steps: int = 150, batch: int = 32, rate: float = 0.015) -> BiGRU:
        """Adam on the logistic loss of documents, at least `steps` steps: for the first half each as its windows' smooth maximum, then as its largest.

        A step sees all windows of its documents; what the gradients need is made anew for HELD of them at a time.
        """
        table = WordTable()
        bags = [np.concatenate(list(table.windows(t))) for t in texts]
        rows, buckets = table.sparse()
        ends = np.searchsorted(rows, np.arange(len(table.buckets) + 1))
        optimizer, r = Adam(self.p, rate), np.random.default_rng(2)
        epochs = max(epochs, -(-steps * batch // len(bags)))
        for epoch in range(epochs):
            order = r.permutation(len(bags))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                used, win = np.unique(np.concatenate([bags[k] for k in at]), return_inverse=True)
                win = win.reshape(-1, WINDOW) - (used[0] < 0)  # -1 sorts first
                used = used[used >= 0]
                sizes = ends[used + 1] - ends[used]
                own = np.repeat(np.arange(len(used)), sizes)
                take = np.arange(len(own)) + np.repeat(ends[used] - (np.cumsum(sizes) - sizes), sizes)
                x = self.words(own, buckets[take], len(used))
                logit = self.logits(x, win)
                doc, starts = np.repeat(np.arange(len(at)), [len(bags[k]) for k in at]), np.cumsum([0, *(len(bags[k]) for k in at[:-1])])
                weight = smooth_max(logit, doc, starts, 2 if 2 * epoch < epochs else 50)
                err = _sigmoid(np.add.reduceat(weight * logit, starts)) - labels[at]
                dlogit = (weight * err[doc] / len(at)).astype(np.float32)
                grads, dx = {}, np.zeros_like(x)
                for lo in range(0, len(win), HELD):
                    keep: dict = {}
                    self.forward(x, win[lo : lo + HELD], keep)
                    more, dmore = self.gradients(x, win[lo : lo + HELD], keep, dlogit[lo : lo + HELD])
                    grads, dx = {k: g + grads.get(k, 0) for k, g in more.items()}, dx + dmore
                scale = 1 / np.sqrt(np.maximum(sizes, 1))
                g = (dx[:-1] * scale[:, None])[own]
                grads["embed"] = np.stack([np.bincount(buckets[take], g[:, k], BUCKETS) for k in range(INPUT)], 1).astype(np.float32)
                optimizer.step(grads)
        return self

    def logits(self, x: np.ndarray, win: np.ndarray) -> np.ndarray:
        return np.concatenate([self.forward(x, win[i : i + HELD]) for i in range(0, len(win), HELD)])


def smooth_max(logit: np.ndarray, doc: np.ndarray, starts: np.ndarray, sharpness: float) -> np.ndarray:
    """Weights of the windows within their documents, on the largest logits."""
    w = np.exp(sharpness * (logit - np.maximum.reduceat(logit, starts)[doc]))
    return w / np.add.reduceat(w, starts)[doc]


class Scorer:
    """A model with the inputs of words that it has met."""

    def __init__(self, model: BiGRU):
        self.model = model
        self._clear()

    def _clear(self) -> None:
        self.table, self.x = WordTable(), np.zeros((0, INPUT), np.float32)

    def _logits(self, win: np.ndarray) -> np.ndarray:
        first, n = len(self.x), len(self.table.buckets)
        if n > first:
            self.x = np.concatenate([self.x, self.model.words(*self.table.sparse(first), n - first)[:-1]])
        used, at = np.unique(win, return_inverse=True)
        x = np.concatenate([self.x[used[used >= 0]], np.zeros((1, INPUT), np.float32)])
        logit = self.model.logits(x, at.reshape(-1, WINDOW) - (used[0] < 0))
        if n > KNOWN_WORDS:
            self._clear()
        return logit

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score of each whole text: that of its most toxic window. Of windows that were read only the largest logit is kept."""
        best, held, docs, n = np.full(len(texts), -np.inf), [], [], 0
        for d, text in enumerate(texts):
            for win in self.table.windows(text):
                held.append(win), docs.append(np.full(len(win), d))
                n += len(win)
                if n >= HELD:
                    np.maximum.at(best, np.concatenate(docs), self._logits(np.concatenate(held)))
                    held, docs, n = [], [], 0
        if held:
            np.maximum.at(best, np.concatenate(docs), self._logits(np.concatenate(held)))
        return _sigmoid(best)


def fit_toxicity(docs: DataFrame, labels: DataFrame, is_training: Column) -> BiGRU:
    """The model from about SAMPLE_DOCS labelled documents of each label, SAMPLE_BYTES at most; without both labels it keeps its first weights."""
    rows = bounded_sample(docs, labels, "toxic", is_training, SAMPLE_DOCS, SAMPLE_BYTES, per_label=True).toPandas().sort_values("doc_id")
    model = BiGRU()
    return model.fit(rows["text"].tolist(), rows["label"].to_numpy(np.float32)) if rows["label"].nunique() == 2 else model


def score_toxicity(docs: DataFrame, model: BiGRU, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score (0 to 1, higher: toxic 1 likelier) of every whole text; null and empty texts are one empty window.

    All other columns and rows stay; a column named score_col is replaced. Long texts are read part by part.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def start():
        scorer = Scorer(shared.value)
        return lambda batch: [pa.array(scorer.scores(values(batch, text_col)))]

    return append_columns(docs, {score_col: "double"}, start)
