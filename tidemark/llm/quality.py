"""Quality classifier by attention-based multiple-instance learning.

A document is a bag of passages. Every passage is encoded from its characters; gated attention, learned from
document labels alone, weighs the passages, and the weighted representation is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import append_columns, durable, ship, slices, values

#: Bytes of a passage.
PASSAGE = 1024
#: Labelled documents that the model is fitted on, about, and the bytes of their texts together.
SAMPLE_DOCS, SAMPLE_BYTES = 2_500, 16 << 20
#: Passages that are held as features at once, and characters of a text that are encoded at once.
HELD, PART = 256, 1 << 18
LAGS = 32
#: Classes of bytes: other control, newline, space, lower, upper, digit, beyond ASCII, and single frequent signs.
_SIGNS = b".,!?;:'\"-()|#$%&*<>/@+=[]{}_~^`\\"


def _classes() -> np.ndarray:
    table = np.zeros(256, np.uint8)
    table[128:], table[10], table[32] = 6, 1, 2
    for b in range(128):
        c = chr(b)
        table[b] = 3 if c.islower() else 4 if c.isupper() else 5 if c.isdigit() else table[b]
    for i, b in enumerate(_SIGNS):
        table[b] = 7 + i
    return table


_CLASS = _classes()
_KINDS = 7 + len(_SIGNS)
FEATURES = _KINDS + _KINDS * _KINDS + LAGS + 2


def passages(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of the passages of the texts, and the number of each one's text, in slices of HELD passages at most.

    A text without bytes is one empty passage. Long texts are encoded part by part.
    """
    raw, docs = [], []
    for d, text in enumerate(texts):
        text, left = text or "", b""
        for i in range(0, max(1, len(text)), PART):
            left += text[i : i + PART].encode("utf-8", "surrogatepass")
            last = i + PART >= len(text)
            ends = len(left) if last else len(left) - len(left) % PASSAGE
            for at in range(0, max(ends, last), PASSAGE):
                raw.append(left[at : min(at + PASSAGE, ends)]), docs.append(d)
                if len(raw) == HELD:
                    yield features(raw), np.array(docs)
                    raw, docs = [], []
            left = left[ends:]
    if raw:
        yield features(raw), np.array(docs)


def features(raw: list[bytes]) -> np.ndarray:
    """Features of passages: shares of byte classes and of their pairs, how often a byte returns after each of LAGS
    distances, the best of these, and how full the passage is."""
    x = np.frombuffer(b"".join(r.ljust(PASSAGE, b"\0") for r in raw), np.uint8).reshape(-1, PASSAGE)
    size = np.array([len(r) for r in raw], np.int64)
    live = np.arange(PASSAGE) < size[:, None]
    kind = np.where(live, _CLASS[x], _KINDS).astype(np.int64)
    row = np.arange(len(x))[:, None]
    one = np.bincount((row * (_KINDS + 1) + kind).ravel(), minlength=len(x) * (_KINDS + 1)).reshape(len(x), -1)[:, :_KINDS]
    wide = (_KINDS + 1) ** 2
    two = np.bincount((row * wide + kind[:, :-1] * (_KINDS + 1) + kind[:, 1:]).ravel(), minlength=len(x) * wide).reshape(len(x), _KINDS + 1, -1)[:, :_KINDS, :_KINDS]
    back = np.stack([((x[:, k:] == x[:, :-k]) & live[:, k:]).sum(1) for k in range(1, LAGS + 1)], 1)
    n = np.maximum(size, 1)[:, None]
    back = back / n
    return np.hstack([np.sqrt(one / n), np.sqrt(two.reshape(len(x), -1) / n), back, back.max(1, keepdims=True), n / PASSAGE]).astype(np.float32)


class GatedAttention:
    """Encoder tanh(xW), gated attention over a bag's passages, logistic score."""

    HIDDEN, GATE = 32, 16

    def __init__(self, seed: int = 5):
        r = np.random.default_rng(seed)
        init = lambda *s: (r.standard_normal(s) / np.sqrt(s[0])).astype(np.float32)
        self.p = {"W": init(FEATURES, self.HIDDEN), "b": np.zeros(self.HIDDEN, np.float32), "V": init(self.HIDDEN, self.GATE), "U": init(self.HIDDEN, self.GATE), "w": init(self.GATE, 1), "c": init(self.HIDDEN, 1), "d": np.zeros(1, np.float32)}
        self.mean, self.scale = np.zeros(FEATURES, np.float32), np.ones(FEATURES, np.float32)

    def encode(self, x: np.ndarray) -> tuple:
        """Representations and attention of passages, and what the gradients need."""
        p, z = self.p, (x - self.mean) * self.scale
        h = np.tanh(z @ p["W"] + p["b"])
        t, g = np.tanh(h @ p["V"]), 1 / (1 + np.exp(-(h @ p["U"])))
        return h, ((t * g) @ p["w"])[:, 0], (z, t, g)

    def pool(self, h: np.ndarray, a: np.ndarray, bag: np.ndarray, starts: np.ndarray) -> tuple:
        """Logits of bags whose passages follow each other, the passages' weights, the weighted representations."""
        a = np.exp(a - np.maximum.reduceat(a, starts)[bag])
        a /= np.add.reduceat(a, starts)[bag]
        m = np.add.reduceat(h * a[:, None], starts)
        return (m @ self.p["c"])[:, 0] + self.p["d"], a, m

    def forward(self, x: np.ndarray, ends: np.ndarray) -> tuple:
        starts = np.r_[0, ends[:-1]]
        bag = np.repeat(np.arange(len(ends)), ends - starts)
        h, a, (z, t, g) = self.encode(x)
        logit, a, m = self.pool(h, a, bag, starts)
        return logit, (z, h, t, g, a, m, bag, starts)

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Score of each whole text; of a passage only its representation and attention are kept."""
        if not texts:
            return np.zeros(0)
        parts = [(*self.encode(x)[:2], docs) for x, docs in passages(texts)]
        h, a, bag = (np.concatenate([p[i] for p in parts]) for i in range(3))
        logit, _, _ = self.pool(h, a, bag, np.searchsorted(bag, np.arange(len(texts))))
        return 1 / (1 + np.exp(-logit.astype(np.float64)))

    def gradients(self, x: np.ndarray, ends: np.ndarray, y: np.ndarray, weight: np.ndarray) -> dict:
        logit, (z, h, t, g, a, m, bag, starts) = self.forward(x, ends)
        p, e = self.p, (((1 / (1 + np.exp(-logit))) - y) * weight / len(y)).astype(np.float32)
        dm = e[:, None] * p["c"].T
        dh = dm[bag] * a[:, None]
        da = (dm[bag] * h).sum(1)
        ds = a * (da - np.add.reduceat(a * da, starts)[bag])
        dtg = ds[:, None] * p["w"].T
        dv, du = dtg * g * (1 - t * t), dtg * t * g * (1 - g)
        dh = (dh + dv @ p["V"].T + du @ p["U"].T) * (1 - h * h)
        return {"W": z.T @ dh, "b": dh.sum(0), "V": h.T @ dv, "U": h.T @ du, "w": (t * g).T @ ds[:, None], "c": m.T @ e[:, None], "d": e.sum(keepdims=True)}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 12, batch: int = 64, rate: float = 2e-3) -> GatedAttention:
        """Adam on the logistic loss, both labels weighing alike up to a factor of three. Without both labels it stays as it is."""
        x = np.concatenate(bags)
        self.mean, self.scale = x.mean(0), 1 / np.maximum(x.std(0), 0.02)
        share = min(max(labels.mean(), 0.125), 0.875)
        weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share)).astype(np.float32)
        optimizer, r = Adam(self.p, rate), np.random.default_rng(1)
        for _ in range(epochs):
            order = r.permutation(len(bags))
            for i in range(0, len(order), batch):
                at = order[i : i + batch]
                grads = self.gradients(np.concatenate([bags[k] for k in at]), np.cumsum([len(bags[k]) for k in at]), labels[at], weight[at])
                grads["W"] += 1e-4 * self.p["W"]
                optimizer.step(grads)
        return self


class Adam:
    def __init__(self, params: dict, rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = ({k: np.zeros_like(x) for k, x in params.items()} for _ in range(2))

    def step(self, grads: dict) -> None:
        self.t += 1
        for k, g in grads.items():
            m, v = self.m[k], self.v[k]
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            self.params[k] -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


def bounded_sample(docs: DataFrame, labels: DataFrame, label: str, is_training: Column, rows: int, most_bytes: int, per_label: bool = False) -> DataFrame:
    """(doc_id, text, label) of about `rows` labelled training documents, chosen by a hash of doc_id; per_label: so many of each label.

    is_training is on doc_id. Rows with a null doc_id or label, or a label other than 0 and 1, teach nothing;
    of repeated labels the larger holds, of repeated documents one row. The chosen ids are broadcast: about `rows` of
    them, for each label at most. If their texts together have more than most_bytes bytes, about so many are kept, and
    none of over a 64th of that.
    """
    known = labels.where(is_training & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    bound = {v: (rows if per_label else rows * n / sum(sizes.values())) / n for v, n in sizes.items()}
    part = lambda seed, share: F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 30)) < int(min(share, 1) * (1 << 30))
    take = F.lit(False)
    for v, share in bound.items():
        take |= (F.col("label") == v) & part(35, share)
    chosen = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").join(F.broadcast(known.where(take)), "doc_id")
    chosen = durable(chosen.groupBy("doc_id", "label").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("doc_id", "text", "label"))
    size = F.coalesce(F.octet_length("text"), F.lit(0))
    held = chosen.agg(F.sum(size)).first()[0] or 0
    return chosen if held <= most_bytes else chosen.where((size <= most_bytes // 64) & part(36, most_bytes / held))


def fit_quality(docs: DataFrame, labels: DataFrame, is_training: Column) -> GatedAttention:
    """The model from about SAMPLE_DOCS labelled documents of SAMPLE_BYTES at most, encoded on the executors. Without both labels it keeps its first weights."""
    ship(docs.sparkSession)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            for i, text in enumerate(batch.column(1).to_pylist()):
                x = np.concatenate([x for x, _ in passages([text])])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), batch.column(2).slice(i, 1), pa.array([x.astype(np.float16).tobytes()], pa.binary())], ["doc_id", "label", "x"])

    bags = bounded_sample(docs, labels, "quality", is_training, SAMPLE_DOCS, SAMPLE_BYTES).mapInArrow(encode, "doc_id bigint, label int, x binary").toPandas().sort_values("doc_id")
    model = GatedAttention()
    if bags["label"].nunique() == 2:
        model.fit([np.frombuffer(x, np.float16).astype(np.float32).reshape(-1, FEATURES) for x in bags["x"]], bags["label"].to_numpy(np.float32))
    return model


def score_quality(docs: DataFrame, model: GatedAttention, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score (0 to 1, higher: quality 1 likelier) of every whole text; null and empty texts are one empty passage.

    All other columns and rows stay; a column named score_col is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size
    return append_columns(docs, {score_col: "double"}, lambda: lambda batch: [pa.array(shared.value.scores(values(batch, text_col)))])
