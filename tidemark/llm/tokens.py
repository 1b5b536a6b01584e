"""Token ids of whole texts with public vocabularies, inside Arrow batches.

A text is cut where every pattern used here always has a token boundary, the pieces are looked up in a
table that each Python worker keeps, and only pieces that it lacks reach the tokenizer. The ids are those
of the tokenizer on the whole text.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Callable, Iterable, Iterator

from tidemark.llm.common import slices

#: Entries that a worker keeps for each tokenizer; beyond that it starts anew.
TABLE_ENTRIES = 500_000
_SPACES = re.compile(r"\s\s")
#: White space besides space and newline, and what lies beyond the Latin blocks, go to the tokenizer as they are.
_ODD = re.compile(r"[^\n -~¡-į]")
#: Characters of a text that are encoded at once, about.
PART = 1 << 18
#: After what a text may be cut with no token, special string or normalisation across: what precedes a lone space, or a full-width mark before a letter of its scripts.
_CUT = re.compile(r"\S(?= \S)|[。，、！？；：](?=[一-龥ぁ-んァ-ヶ가-힣])")
_TABLES: dict[str, dict] = {}


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or the next free one from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


def parts(text: str, size: int = PART) -> Iterator[str]:
    """A text in consecutive parts of `size` characters or more, cut where encoding them one by one changes nothing."""
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size - 1)):
        yield text[at : cut.end()]
        at = cut.end()
    yield text[at:]


class PieceEncoder:
    """Encodes texts through a table of pieces.

    key names the table; encode gives the ids of any text, merge those of one stretch that the pattern keeps
    whole, split cuts a text by the pattern. Texts that hold one of the strings in whole go to encode.
    """

    def __init__(self, key: str, encode: Callable, split: Callable, merge: Callable, lower: bool = False, whole: Iterable[str] = ()):
        self.table, self.lower, self.whole = _TABLES.setdefault(key, {}), lower, tuple(whole)
        self.encode, self.split, self.merge = encode, split, merge

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as little-endian 32-bit integers."""
        return b"".join(map(self._part, parts(text))) if text else b""

    def _part(self, text: str) -> bytes:
        if _ODD.search(text) or any(w in text for w in self.whole):
            return pack(self.encode(text))
        if self.lower:
            return self._look_up(text.lower().split(), "")
        if _SPACES.search(text):
            return b"".join(pack(self.merge(x)) for x in self.split(text))
        first, *rest = text.replace("\n", " \n").split(" ")
        return b"".join(pack(self.merge(x)) for x in self.split(first)) + self._look_up(rest, " ")

    def _look_up(self, pieces: list[str], lead: str) -> bytes:
        """A piece stands for lead and itself, or, if it begins with a newline, for itself."""
        found = list(map(self.table.get, pieces))
        if None in found:
            if len(self.table) >= TABLE_ENTRIES:
                self.table.clear()
            found = [self.table.get(x) or self._add(x, lead) if y is None else y for x, y in zip(pieces, found, strict=True)]
        return b"".join(found)

    def _add(self, piece: str, lead: str) -> bytes:
        if piece.isalpha():
            got = pack(self.merge(lead + piece))
        elif (stem := piece[:-1]).isalpha():  # a letter run ends where a sign or digit begins
            got = (self.table.get(stem) or self._add(stem, lead)) + (self.table.get("\0" + piece[-1]) or self._add_sign(piece[-1]))
        else:
            got = b"".join(pack(self.merge(x)) for x in self.split(piece if piece[:1] == "\n" else lead + piece))
        self.table[piece] = got
        return got

    def _add_sign(self, sign: str) -> bytes:
        return self.table.setdefault("\0" + sign, pack(self.merge(sign)))


def pack(ids: Iterable[int]) -> bytes:
    return array("I", ids).tobytes()


#: How word_bpe vocabularies split a text, after lower-casing (fixed value of that file).
WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def hub_encoder(path: str, lower: bool) -> PieceEncoder:
    """For a byte-level BPE file of the tokenizers library. lower: its vocabulary is lower case and drops white space.

    Pieces are Latin text, for which normalisation is lower-casing; they are split by the file's pattern and
    merged by the library's model. All other text goes through the library's whole chain, and so does text with an
    added token, whose string becomes that token, as by the library's default.
    """
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    import regex
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    added = tok.get_added_tokens_decoder().values()
    if any(t.normalized or t.lstrip or t.rstrip or t.single_word or re.search(r"\s", t.content) for t in added):
        raise ValueError(f"{path}: added tokens must be plain strings without white space")
    split = regex.compile(WORD_PATTERN if lower else PATTERN).findall
    mapped, merge = str.maketrans(dict(enumerate(byte_chars()))), tok.model.tokenize

    def merged(stretch: str) -> list[int]:
        return [t.id for t in merge(stretch.encode().decode("latin-1").translate(mapped))]

    return PieceEncoder(path, lambda text: tok.encode_batch_fast([text], add_special_tokens=False)[0].ids, split, merged, lower, [t.content for t in added])


def encode_batches(batches: Iterator, make: Callable[[], PieceEncoder], text_col: str, finish: Callable) -> Iterator:
    """For mapInArrow: finish(batch, ids of each row as bytes) for every record batch; null texts count as empty."""
    encoder = make()
    for batch in slices(batches):
        texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
        yield from finish(batch, [encoder.ids(t) if t else b"" for t in texts])
