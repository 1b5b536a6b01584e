"""Language identification with language-bitmask n-gram filters.

One bit-sliced Bloom filter holds the frequent n-grams of every language: a slot is a bitmask of languages, and
the masks of an n-gram's slots, and-ed, give all languages that contain it. A text counts its n-grams for each
language; the counts, corrected for each language's false positives, decide.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import append_columns, durable, ship, slices, values

#: Documents of each language that the filters are learned from, about.
SAMPLE_DOCS = 5_000
#: N-grams of a language: at least this share of its n-grams, and so often.
MIN_SHARE, MIN_COUNT = 2e-5, 2
SIZES = (3, 4)
PROBES = 3
#: Slots for each n-gram of the language with the most, at least.
SLOTS_A_GRAM = 8
#: Characters of a text that are held as arrays at once.
PART = 1 << 18
#: ASCII signs and digits count as spaces.
_FOLD = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in range(256))
_MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def grams(raw: bytes) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n-gram size: codes of all n-grams of folded bytes, and their first positions; those with two spaces in a row are left out."""
    x = np.frombuffer(raw, np.uint8).astype(np.uint64)
    blank = x == 32
    double = blank[:-1] & blank[1:]
    for n in SIZES:
        if len(x) < n:
            continue
        code = np.full(len(x) - n + 1, n, np.uint64)
        bad = np.zeros(len(code), bool)
        for k in range(n):
            code = code << np.uint64(8) | x[k : len(x) - n + 1 + k]
            if k < n - 1:
                bad |= double[k : len(double) - n + 2 + k]
        at = np.flatnonzero(~bad)
        yield code[at], at


def folded(text: str | None) -> Iterator[tuple[bytes, int]]:
    """The folded bytes of a text between two spaces, in parts that each repeat the last bytes of the one before, and how many they repeat.

    An n-gram belongs to the part in which it ends first.
    """
    text, last = text or "", b""
    for i in range(0, max(1, len(text)), PART):
        new = text[i : i + PART].lower().encode("utf-8", "surrogatepass").translate(_FOLD)
        part = last + (b"" if i else b" ") + new + (b" " if i + PART >= len(text) else b"")
        yield part, len(last)
        last = part[-(SIZES[-1] - 1) :]


def text_grams(text: str | None) -> Iterator[np.ndarray]:
    """Codes of all n-grams of a text, part by part and size by size."""
    for part, again in folded(text):
        for n, (code, at) in zip(SIZES, grams(part), strict=False):
            yield code[at + n > again]


def joined(codes: Iterable[np.ndarray], most: int = 1 << 20) -> Iterator[np.ndarray]:
    """Arrays joined to about so many codes at once; texts of any length go through, those without n-grams add nothing."""
    part, n = [], 0
    for code in codes:
        part.append(code)
        n += len(code)
        if n >= most:
            yield np.concatenate(part)
            part, n = [], 0
    if n:
        yield np.concatenate(part)


def slots(code: np.ndarray, size: int) -> list[np.ndarray]:
    """PROBES slots of each code in a table of `size`, a power of two."""
    shift = np.uint64(65 - size.bit_length())
    return [(code * m) >> shift for m in _MULTIPLIERS[:PROBES]]


@dataclass
class LanguageFilter:
    """languages, and table: the slots' bitmasks, slots x ceil(languages / 64) words; bit i % 64 of word i // 64 stands for languages[i]."""

    languages: list[str]
    table: np.ndarray

    def __post_init__(self) -> None:
        full = [np.count_nonzero(self.table[:, i // 64] >> np.uint64(i % 64) & np.uint64(1)) / len(self.table) for i in range(len(self.languages))]
        self.false = np.array(full) ** PROBES  # chance that a strange n-gram counts for the language

    def counts(self, code: np.ndarray, doc: np.ndarray, docs: int) -> np.ndarray:
        """For each text, so many in all, and each language the n-grams that the language may contain."""
        out = np.zeros((docs, len(self.languages)))
        first, *rest = slots(code, len(self.table))
        for w in range(self.table.shape[1]):
            masks = self.table[first, w]
            for s in rest:
                masks = masks & self.table[s, w]
            for i in range(64 * w, min(64 * w + 64, len(self.languages))):
                out[:, i] += np.bincount(doc, masks >> np.uint64(i % 64) & np.uint64(1), minlength=docs)
        return out

    def shares(self, texts: list[str | None]) -> np.ndarray:
        """For each text and language the share of n-grams that the language contains, corrected for false positives."""
        total, hits = np.zeros(len(texts)), np.zeros((len(texts), len(self.languages)))
        codes, docs, held = [], [], 0
        for d, text in enumerate([*texts, None]):
            for code in text_grams(text) if d < len(texts) else ():
                total[d] += len(code)
                codes.append(code), docs.append(np.full(len(code), d))
                held += len(code)
            if codes and (held >= 1 << 20 or d == len(texts)):
                hits += self.counts(np.concatenate(codes), np.concatenate(docs), len(texts))
                codes, docs, held = [], [], 0
        share = hits / np.maximum(total, 1)[:, None]
        return np.clip((share - self.false) / (1 - self.false), 0, 1)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Language and its corrected share; `und` and 0 for texts without a letter. Ties go to the first language by name."""
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        shares = self.shares(texts)
        best, letter = shares.argmax(1), np.array([any(map(str.isalpha, t or "")) for t in texts], bool)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, letter, strict=True)], np.where(letter, shares.max(1), 0.0)


def learn_filter(docs: DataFrame, is_training: Column, text_col: str = "text", lang_col: str = "lang", key_col: str = "doc_id") -> LanguageFilter:
    """A filter from about SAMPLE_DOCS rows of each language, by a hash of key_col, where is_training holds and text and lang aren't null.

    N-grams are counted and each language's bits set on the executors. A language has 1 / MIN_SHARE n-grams at most, so
    the driver gets 64 KB for each language at most (one bit a slot, 2^19 slots), whatever the rows. Any number of
    languages is told apart. Without training rows there are none.
    """
    ship(docs.sparkSession)
    rows = docs.where(is_training & F.col(text_col).isNotNull() & F.col(lang_col).isNotNull()).select(F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(key_col).cast("string"), F.lit(6)).alias("h"))
    share = rows.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.least(F.lit(1.0), SAMPLE_DOCS / F.col("n")) * (1 << 30)).cast("bigint").alias("upto"))
    share = durable(share)  # one row for each language
    sample = rows.join(F.broadcast(share), "lang").where(F.pmod("h", F.lit(1 << 30)) < F.col("upto")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            langs, texts = np.array(batch.column(0).to_pylist(), object), batch.column(1).to_pylist()
            for lang in sorted(set(langs)):
                for codes in joined(code for i in np.flatnonzero(langs == lang) for code in text_grams(texts[i])):
                    value, n = np.unique(codes, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(value), pa.string()), pa.array(value.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    counts = sample.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts = durable(counts)
    totals = counts.groupBy(F.col("lang").alias("of")).agg(F.greatest(F.lit(MIN_COUNT), MIN_SHARE * F.sum("n")).alias("need"))
    frequent = durable(counts.join(F.broadcast(totals), F.col("lang") == F.col("of")).where("n >= need").select("lang", "gram"))
    most = frequent.groupBy("lang").count().agg(F.max("count")).first()[0] or 0
    size = max(1 << 12, 1 << (SLOTS_A_GRAM * most - 1).bit_length()) if most else 1 << 12

    def bits(part: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros(size, bool)
        for s in slots(part["gram"].to_numpy(np.int64).view(np.uint64), size):
            full[s] = True
        return pd.DataFrame({"lang": part["lang"].iloc[:1], "bits": [np.packbits(full).tobytes()]})

    found = sorted(share.select("lang").join(frequent.groupBy("lang").applyInPandas(bits, "lang string, bits binary"), "lang", "left").collect(), key=lambda r: r["lang"])
    table = np.zeros((size, max(1, -(-len(found) // 64))), np.uint64)
    for i, r in enumerate(found):
        if r["bits"]:
            table[:, i // 64] |= np.unpackbits(np.frombuffer(r["bits"], np.uint8)).astype(np.uint64) << np.uint64(i % 64)
    return LanguageFilter([r["lang"] for r in found], table)


def identify(docs: DataFrame, model: LanguageFilter, text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """docs with lang_pred and score (0 to 1) for every whole text; null, empty and letterless texts are `und` with score 0.

    All other columns and rows stay; columns named as the two results are replaced. A text is read in parts of PART characters.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded as learn_filter states

    def told(batch: pa.RecordBatch) -> list[pa.Array]:
        langs, scores = shared.value.predict(values(batch, text_col))
        return [pa.array(langs, pa.string()), pa.array(scores)]

    return append_columns(docs, {lang_col: "string", score_col: "double"}, lambda: told)
