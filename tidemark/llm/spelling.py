"""Spelling variants of a corpus vocabulary by full neighbourhood generation.

All distinct deletions, replacements and insertions of every word over the observed alphabet are generated; those
that are words themselves are its neighbours, and no distance is computed. A neighbourhood is generated as an
array of hashes, a Bloom filter of the vocabulary lets few pass that aren't words, and the candidates that are left are
written out and joined to the vocabulary, which decides.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import durable, ship, slices, values

#: Bits of the filter for each word, at least, until it has MOST_BITS; a segment of it has SEGMENT bits.
BITS_A_WORD, MOST_BITS, SEGMENT = 16, 1 << 29, 1 << 18
PROBES = 4
#: Candidates that are generated at once; distinct words that a task holds before it hands their counts on.
CANDIDATES, HELD_WORDS = 1 << 20, 200_000
#: Characters of a text that are searched at once, about.
PART = 1 << 20
_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
_GAP = re.compile("[^A-Za-z\u00c0-\u00ff]")
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))


def runs(text: str, least: int) -> Iterator[list[str]]:
    """The maximal runs of letters, A-Z lower-cased, of at least so many code points of a text, part by part; no run is cut."""
    find = re.compile("[a-z\u00c0-\u00ff]{%d,}" % least).findall
    at = 0
    while at < len(text):
        edge = _GAP.search(text, at + PART) if len(text) - at > PART else None
        end = edge.start() if edge else len(text)
        yield find(text[at:end].encode("utf-8", "surrogatepass").translate(_LOWER).decode("utf-8", "surrogatepass"))
        at = end


def word_counts(docs: DataFrame, least_length: int = 5, drop_one_in: int = 97, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): how often each word of at least least_length code points occurs in all whole texts.

    Words are maximal runs of A-Z, a-z and U+00C0 to U+00FF with A-Z lower-cased. If drop_one_in divides the CRC-32 h of
    `<id>:<run>`, the run loses its code point at h % length. Null texts have none, a null id counts as empty. Tasks count before
    anything is shuffled.
    """
    ship(docs.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter = Counter()

        def flushed() -> pa.RecordBatch:
            words = [w for w, n in total.items() if n]
            batch = pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(list(map(total.__getitem__, words)), pa.int64())], ["word", "n"])
            total.clear()
            return batch

        for batch in slices(batches):
            for doc, text in zip(values(batch, "id"), values(batch, "text"), strict=True):
                seed = zlib.crc32(f"{doc}:".encode())
                for found in runs(text or "", least_length):
                    total.update(found)
                    dropping = [(run, h) for run in set(found) if not (h := zlib.crc32(run.encode(), seed)) % drop_one_in]
                    own = Counter(found) if dropping else {}
                    for run, h in dropping:
                        at = h % len(run)
                        total[run] -= own[run]
                        if len(run) > least_length:
                            total[run[:at] + run[at + 1 :]] += own[run]
                if len(total) >= HELD_WORDS:
                    yield flushed()
        yield flushed()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(32)) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(32)


def _powers(n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return np.cumprod(np.concatenate([[np.uint64(1)], np.full(n, _BASE)]).astype(np.uint64))


def hashes(letters: np.ndarray) -> np.ndarray:
    """For words of one length (a matrix of code points) the sum of (code point + 1) * base**place, modulo 2**64."""
    return ((letters.astype(np.uint64) + np.uint64(1)) * _powers(letters.shape[1])[:-1]).sum(1, dtype=np.uint64)


def by_length(words: list[str]) -> Iterator[np.ndarray]:
    """Matrices of the code points (below 256) of the words of each length."""
    lengths = np.array(list(map(len, words)))
    for n in np.unique(lengths[lengths > 0]).tolist():
        yield np.frombuffer("".join(words[i] for i in np.flatnonzero(lengths == n)).encode("latin-1"), np.uint8).reshape(-1, n)


class WordFilter:
    """A Bloom filter in segments: the top bits of a word's hash choose the segment, the others its bits."""

    def __init__(self, segments: int, bits: np.ndarray):
        self.segments, self.bits = segments, bits

    @staticmethod
    def segment(h: np.ndarray, segments: int) -> np.ndarray:
        return h >> np.uint64(40) & np.uint64(segments - 1)

    @staticmethod
    def place(h: np.ndarray, probe: int) -> np.ndarray:
        return h + np.uint64(probe) * (h >> np.uint64(20) | np.uint64(1)) & np.uint64(SEGMENT - 1)

    def has(self, h: np.ndarray) -> np.ndarray:
        """Where in h the hashes are that a word may have."""
        h = _mixed(h)
        left, base = np.arange(len(h)), self.segment(h, self.segments) * np.uint64(SEGMENT)
        for probe in range(PROBES):  # few pass the first probe, so the others cost little
            place = base + self.place(h, probe)
            ok = (self.bits[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8)) & np.uint8(1) == 1
            left, h, base = left[ok], h[ok], base[ok]
        return left


def word_filter(words: DataFrame) -> WordFilter:
    """A filter of all words (word): the driver gets its bits, MOST_BITS at most, whatever the words; each segment is set by one task."""
    n = words.count()
    segments = 1
    while segments * SEGMENT < min(MOST_BITS, n * BITS_A_WORD):
        segments *= 2

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for letters in by_length(values(batch, "word")):
                h = _mixed(hashes(letters))
                yield pa.RecordBatch.from_arrays([pa.array(WordFilter.segment(h, segments).astype(np.int64)), pa.array(h.view(np.int64))], ["segment", "h"])

    def set_bits(part: pd.DataFrame) -> pd.DataFrame:
        full = np.zeros(SEGMENT, bool)
        for probe in range(PROBES):
            full[WordFilter.place(part["h"].to_numpy(np.int64).view(np.uint64), probe)] = True
        return pd.DataFrame({"segment": part["segment"].iloc[:1], "bits": [np.packbits(full, bitorder="little").tobytes()]})

    bits = np.zeros(segments * SEGMENT // 8, np.uint8)
    for r in words.mapInArrow(hashed, "segment bigint, h bigint").groupBy("segment").applyInPandas(set_bits, "segment bigint, bits binary").toLocalIterator():
        bits[r["segment"] * SEGMENT // 8 :][: SEGMENT // 8] = np.frombuffer(r["bits"], np.uint8)
    return WordFilter(segments, bits)


def neighbours(letters: np.ndarray, alphabet: np.ndarray, known: WordFilter) -> tuple[np.ndarray, list[str]]:
    """Of the distinct deletions, replacements and insertions of words of one length those that the filter knows: (row, candidate).

    A deletion of the second of two equal letters repeats that of the first, and so does an insertion before or after the same letter.
    """
    n, size = letters.shape
    power, one = _powers(size + 1), np.uint64(1)
    code, extra = letters.astype(np.uint64) + one, alphabet.astype(np.uint64) + one
    ahead = np.zeros((n, size + 1), np.uint64)
    np.cumsum(code * power[:size], axis=1, dtype=np.uint64, out=ahead[:, 1:])
    whole, rows, found = ahead[:, -1:], [], []

    def kept(h: np.ndarray, keep: np.ndarray) -> list[np.ndarray]:
        at = known.has(h.ravel())
        return [i[keep.ravel()[at]] for i in np.unravel_index(at, h.shape)]

    word = letters.tobytes().decode("latin-1")
    spelled = lambda i: word[i * size : (i + 1) * size]

    new = np.ones((n, size), bool)
    new[:, 1:] = letters[:, 1:] != letters[:, :-1]
    for i, p in zip(*map(np.ndarray.tolist, kept(ahead[:, :-1] + (whole - ahead[:, 1:]) * _INVERSE, new)), strict=True):
        w = spelled(i)
        rows.append(i), found.append(w[:p] + w[p + 1 :])
    changed = whole[:, :, None] + (extra[None, None] - code[:, :, None]) * power[None, :size, None]
    for i, p, c in zip(*map(np.ndarray.tolist, kept(changed, letters[:, :, None] != alphabet)), strict=True):
        w = spelled(i)
        rows.append(i), found.append(f"{w[:p]}{chr(alphabet[c])}{w[p + 1 :]}")
    longer = (ahead + (whole - ahead) * _BASE)[:, :, None] + extra[None, None] * power[None, : size + 1, None]
    new = np.ones(longer.shape, bool)
    new[:, 1:] = letters[:, :, None] != alphabet
    for i, p, c in zip(*map(np.ndarray.tolist, kept(longer, new)), strict=True):
        w = spelled(i)
        rows.append(i), found.append(f"{w[:p]}{chr(alphabet[c])}{w[p:]}")
    return np.array(rows, np.int64), found


def near_words(words: DataFrame) -> DataFrame:
    """(word, near, near_n): every two words of (word, n) that differ by one inserted, deleted or replaced code point, both ways round.

    Words are of code points below 256. Every candidate is joined to the vocabulary, so what the filter lets through by chance goes.
    """
    ship(words.sparkSession)
    known = word_filter(words.select("word"))
    seen = words.select(F.explode(F.split("word", "")).alias("c")).distinct().collect()  # 256 at most
    alphabet = np.array(sorted(ord(r["c"]) for r in seen if r["c"]), np.uint8)
    shared = words.sparkSession.sparkContext.broadcast(known)

    def generate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for letters in by_length(values(batch, "word")):
                step = max(1, CANDIDATES // ((letters.shape[1] + 1) * len(alphabet)))
                for i in range(0, len(letters), step):
                    part = np.ascontiguousarray(letters[i : i + step])
                    rows, found = neighbours(part, alphabet, shared.value)
                    text = part.tobytes().decode("latin-1")
                    own = [text[r * part.shape[1] : (r + 1) * part.shape[1]] for r in rows.tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(own, pa.string()), pa.array(found, pa.string())], ["word", "near"])

    candidates = words.select("word").mapInArrow(generate, "word string, near string")
    return candidates.join(words.select(F.col("word").alias("near"), F.col("n").alias("near_n")), "near").select("word", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form), where forms lead to ever more frequent words: the last word that they lead to, by pointer doubling."""
    links = durable(forms.select("word", F.col("form").alias("root")))
    while True:
        on = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        stepped = durable(links.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        links = stepped.select("word", "root")
        if stepped.where("moved").isEmpty():
            return links


def spelling_variants(words: DataFrame, times: int = 2) -> DataFrame:
    """For each row of words (word, n): word, form, root, n, n_near, form_n.

    near words differ by exactly one inserted, deleted or replaced code point, n_near counts them. form is the one with the
    largest n (ties: the smallest in code-point order) if that is at least `times` n, else null; form_n is its n. root is
    the last word that forms lead to, the word itself without one. Words must be distinct; other columns are left out.
    """
    words = durable(words.select("word", "n"))
    best = F.min(F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("form")))
    near = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), best.alias("best"))
    takes = -F.col("best.minus") >= times * F.col("n")
    found = durable(words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), F.when(takes, F.col("best.form")).alias("form"), F.when(takes, -F.col("best.minus")).alias("form_n")))
    ends = roots(found.where("form is not null").select("word", "form"))
    return found.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
