"""Token counts of whole texts by rank-synchronous merging of arrays, for byte-level BPE files of the tokenizers library.

Pre-tokens of a batch are held together as one ragged array of symbols. In each round every pre-token finds the
lowest rank among its neighbouring pairs and applies that pair wherever it stands, all pre-tokens at once; those
without a known pair leave. What is left of a pre-token are its tokens.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from tidemark.llm.common import append_columns, values
from tidemark.llm.tokens import TABLE_ENTRIES, byte_chars, parts

#: Characters that are cut into pre-tokens at once, about, and bytes of new pre-tokens that are merged together.
PART, RAGGED = 1 << 18, 1 << 20
#: All of a run of white space but its last character, or all of it at the end; what Python calls white space and the library doesn't.
_RUNS, _CONTROL = re.compile(r"\s+(?=\s\S)|\s\s+\Z"), re.compile(r"[\x1c-\x1f]")
_NONE = np.iinfo(np.int32).max
_COUNTS: dict[str, dict[str, int]] = {}


class MergeTable:
    """The merges of a vocabulary over its token numbers: which pair has which rank, and what it becomes."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        self.first = np.array([vocab[c] for c in byte_chars()], np.int64)
        self.size = max(vocab.values(), default=0) + 1
        pairs = np.array([(vocab[a], vocab[b], vocab[a + b]) for a, b in merges], np.int64).reshape(-1, 3)
        key = pairs[:, 0] * self.size + pairs[:, 1]
        self.keys, at = np.unique(key[::-1], return_index=True)  # of a repeated pair the last rank stands
        self.ranks, self.becomes = (len(key) - 1 - at).astype(np.int32), pairs[:, 2]
        made = np.full(self.size, -1, np.int64)
        made[pairs[:, 2]] = np.arange(len(pairs))
        #: Whether every pair of a made token ranks after all that make it: then all places of a pair may merge at once.
        self.ordered = bool((np.maximum(made[pairs[:, 0]], made[pairs[:, 1]]) < np.arange(len(pairs))).all())

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(left), _NONE, np.int32)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NONE).astype(np.int32)

    def count(self, pieces: list[bytes]) -> np.ndarray:
        """The tokens of each piece, none of them empty."""
        out, size = np.zeros(len(pieces), np.int64), np.array(list(map(len, pieces)), np.int64)
        symbol, own = self.first[np.frombuffer(b"".join(pieces), np.uint8)], np.repeat(np.arange(len(pieces)), size)
        rank = np.full(len(symbol), _NONE, np.int32)  # of the pair that begins here
        inner = np.flatnonzero(own[1:] == own[:-1])
        rank[inner] = self.rank(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            lengths = np.diff(starts, append=len(symbol))
            lowest = np.minimum.reduceat(rank, starts)
            done = lowest == _NONE
            out[own[starts[done]]] = lengths[done]
            if done.any():
                keep = np.repeat(~done, lengths)
                symbol, own, rank = symbol[keep], own[keep], rank[keep]
                lowest, lengths = lowest[~done], lengths[~done]
                if not len(symbol):
                    break
            hit = np.flatnonzero(rank == np.repeat(lowest, lengths))
            if self.ordered:
                hit = hit[_every_other(hit)]
            else:  # one at a time, from the left
                hit = hit[np.concatenate([[True], own[hit[1:]] != own[hit[:-1]]])]
            symbol[hit] = self.becomes[rank[hit]]
            stay = np.ones(len(symbol), bool)
            stay[hit + 1] = False
            symbol, own, rank = symbol[stay], own[stay], rank[stay]
            at = hit - np.arange(len(hit))  # where the merged ones stand now
            for i in (at, at[at > 0] - 1):
                linked = (i + 1 < len(symbol)) & (own[i] == own[np.minimum(i + 1, len(own) - 1)])
                rank[i] = _NONE
                i = i[linked]
                rank[i] = self.rank(symbol[i], symbol[i + 1])
        return out


def _every_other(hit: np.ndarray) -> np.ndarray:
    """Of places in a row the first, third, fifth and so on, as a pair that overlaps itself merges from the left."""
    new = np.concatenate([[True], np.diff(hit) != 1])
    at = np.arange(len(hit))
    return (at - np.maximum.accumulate(np.where(new, at, 0))) % 2 == 0


def pieces_of(text: str, pattern, part: int = PART) -> Iterator[list[str]]:
    """The matches of a pattern in a text, part by part; only those that begin and end clear of a part's end are taken from it.

    A match that fills its part makes the next one twice as long.
    """
    at, size = 0, part
    while at < len(text):
        end = min(at + size, len(text))
        if end == len(text):
            yield pattern.findall(text, at)
            return
        found, upto = [], at
        for m in pattern.finditer(text, at, end):
            if m.end() > end - 3:  # what follows could still change it
                break
            found.append(m[0])
            upto = m.end()
        size = part if upto > at else 2 * size
        at = upto
        if found:
            yield found


class TokenCounter:
    """Counts a text's tokens as the library would with its defaults, strings of added tokens included.

    The counts of chunks are kept in a table for each worker, of TABLE_ENTRIES of them at most.
    """

    def __init__(self, path: str):
        import regex
        from public_tokenizers import PATTERN

        with open(path, encoding="utf-8") as f:
            whole = json.load(f)
        model, before = whole["model"], whole["pre_tokenizer"] or {}
        odd = [k for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        if model["type"] != "BPE" or odd or whole["normalizer"] or before.get("type") != "ByteLevel" or before.get("add_prefix_space") or not before.get("use_regex", True):
            raise ValueError(f"{path}: not a plain byte-level BPE file")
        added = [t for t in whole["added_tokens"] if t["content"]]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError(f"{path}: added tokens must be plain strings")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.merges, self.split = MergeTable(model["vocab"], merges), regex.compile(PATTERN)
        longest = sorted((t["content"] for t in added), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, longest))) if longest else None
        self.table = _COUNTS.setdefault(path, {})

    def _stretches(self, text: str) -> Iterator[tuple[str, int]]:
        """The text between added tokens, and how many of those follow it (0 or 1)."""
        at = 0
        for m in self.special.finditer(text) if self.special else ():
            yield text[at : m.start()], 1
            at = m.end()
        yield text[at:], 0

    def _chunks(self, text: str) -> Iterator[list[str]]:
        """A text in chunks at whose ends every pre-token ends too: they begin with a lone space, or hold all but the last of a run of white space."""
        if _CONTROL.search(text):
            yield from pieces_of(text, self.split)
            return
        at = 0
        for m in [*_RUNS.finditer(text), None]:
            first, *rest = text[at : m.start() if m else len(text)].split(" ")
            chunks = [" " + x for x in rest]
            if first:
                chunks.append(first)
            if m:
                chunks.append(m[0])
                at = m.end()
            yield chunks

    def counts(self, texts: Iterable[str | None]) -> np.ndarray:
        """Tokens of each whole text; null is empty. Chunks that the table lacks are gathered over texts and merged together."""
        out, waiting, held = [], [], 0  # waiting: (text, its chunks that aren't known yet)
        for d, text in enumerate(texts):
            out.append(0)
            for stretch, special in self._stretches(text or ""):
                out[d] += special
                for found in (c for part in parts(stretch) for c in self._chunks(part)):
                    known = list(map(self.table.get, found))
                    if None in known:
                        new = [p for p, n in zip(found, known, strict=True) if n is None]
                        waiting.append((d, new))
                        held += sum(map(len, new))
                        known = filter(None, known)
                    out[d] += sum(known)
                    if held >= RAGGED:
                        self._settle(out, waiting)
                        waiting, held = [], 0
        self._settle(out, waiting)
        return np.array(out, np.int64)

    def _settle(self, out: list[int], waiting: list[tuple[int, list[str]]]) -> None:
        new = list(dict.fromkeys(c for _, chunks in waiting for c in chunks))
        if not new:
            return
        if len(self.table) + len(new) > TABLE_ENTRIES:
            self.table.clear()
        split = [self.split.findall(c) if len(c) <= PART else [p for found in pieces_of(c, self.split) for p in found] for c in new]
        pieces = list(dict.fromkeys(p for ps in split for p in ps))
        of = dict(zip(pieces, self.merges.count([p.encode() for p in pieces]).tolist(), strict=True))
        found = {c: sum(map(of.__getitem__, ps)) for c, ps in zip(new, split, strict=True)}
        self.table.update((c, n) for c, n in found.items() if len(c) <= 64)
        for d, chunks in waiting:
            out[d] += sum(map(found.__getitem__, chunks))


def count_tokens(df: DataFrame, path: str, limit: int, text_col: str = "text", count_col: str = "n_tokens", bytes_col: str = "n_bytes", over_col: str = "over_limit") -> DataFrame:
    """df with the UTF-8 bytes and tokens (long) of each whole text, and whether the tokens exceed `limit`.

    Null and empty texts have none of either. Texts of any length are read in parts. Repeated rows and all other
    columns stay; columns named as the results are replaced. Without a shuffle; an empty table gives an empty one.
    """

    def start() -> Callable[[pa.RecordBatch], list[pa.Array]]:
        counter = TokenCounter(path)

        def made(batch: pa.RecordBatch) -> list[pa.Array]:
            size = pc.fill_null(pc.binary_length(batch.column(batch.schema.get_field_index(text_col))), 0).cast(pa.int64())
            n = counter.counts(values(batch, text_col))
            return [size, pa.array(n), pa.array(n > limit)]

        return made

    return append_columns(df, {bytes_col: "bigint", count_col: "bigint", over_col: "boolean"}, start)
