"""Problem 7: the token ids of every text in a public byte-level BPE vocabulary.

The exact merges in linear time.  A pretoken's bytes are read as Latin-1 and
run once through an Aho-Corasick automaton of the vocabulary, which gives the
longest token at every place.  The encoding is then found from the left: a
token is kept if it is compatible with the token before it (no merge across
their border would have come first); if not, the next shorter token that is a
prefix is tried, and if none is left the previous token is taken back.
Compatibility of two neighbours depends on the two tokens alone and is
remembered, as are the next shorter prefixes.

Texts are cut where one blank stands between two visible characters, which is
always a border of pretokens; the ids of the pieces are remembered per Python
worker, so a repeated word costs one dictionary look-up.  The memories have
fixed bounds and are emptied when full.  There is no shuffle.

Null and empty texts give an empty list.  Special tokens never occur: their
strings in a text are ordinary text.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the public pattern by which this vocabulary cuts texts into pretokens.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
REMEMBERED_PIECES, LONGEST_PIECE, REMEMBERED_PAIRS = 200_000, 40, 1_000_000


def _byte_alphabet() -> dict[str, int]:
    """How the vocabulary file writes bytes: visible Latin-1 as itself, the others from U+0100 on."""
    visible = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(hidden)}


class Encoder:
    """One vocabulary in one Python process."""

    _loaded: dict[str, Encoder] = {}

    def __init__(self, path: str) -> None:
        model = json.loads(Path(path).read_text(encoding="utf-8"))["model"]
        alphabet = _byte_alphabet()
        latin = lambda token: "".join(chr(alphabet[c]) for c in token)
        vocab: dict[str, int] = model["vocab"]
        self.text: dict[int, str] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        self.merged: dict[tuple[int, int], int] = {}
        for n, merge in enumerate(model["merges"]):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            one, two, both = vocab[left], vocab[right], vocab[left + right]
            self.merged[one, two] = both
            self.parts.setdefault(both, (one, two))
            self.rank.setdefault(both, n + 256)
        for token, number in vocab.items():
            if number in self.parts or (len(token) == 1 and token in alphabet):
                self.text[number] = latin(token)
                self.rank.setdefault(number, alphabet.get(token, 0))
                self.parts.setdefault(number, (number, number))
        self.number = {text: number for number, text in self.text.items()}
        self.automaton = ahocorasick.Automaton()
        for text, number in self.number.items():
            self.automaton.add_word(text, (number, len(text)))
        self.automaton.make_automaton()
        self.cut = regex.compile(PATTERN).findall
        self.fits: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int | None] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _prefix(self, token: int) -> int | None:
        """The longest other token that the token begins with."""
        if token not in self.shorter:
            text = self.text[token]
            self.shorter[token] = next((self.number[text[:n]] for n in range(len(text) - 1, 0, -1) if text[:n] in self.number), None)
        return self.shorter[token]

    def _compatible(self, one: int, two: int) -> bool:
        """Whether merging the bytes of both tokens would leave the border between them: undo the merges of
        both sides latest first; at no point may the two tokens at the border merge before the one undone."""
        key = one, two
        if key in self.fits:
            return self.fits[key]
        rank, parts, merged = self.rank, self.parts, self.merged
        limit, fine = 1 << 62, True
        while True:
            both = merged.get((one, two))
            if both is not None and rank[both] < limit:
                fine = False
                break
            whole_one, whole_two = parts[one][0] == one, parts[two][0] == two
            if whole_one and whole_two:
                break
            if not whole_one and (whole_two or rank[one] > rank[two]):
                limit, one = rank[one], parts[one][1]
            else:  # of equal merges the left one came first, so the right one is undone with its own rank allowed
                limit, two = rank[two] + 1, parts[two][0]
        if len(self.fits) >= REMEMBERED_PAIRS:
            self.fits.clear()
        self.fits[key] = fine
        return fine

    def pretoken(self, text: str) -> list[int]:
        raw = text.encode("utf-8", "surrogatepass").decode("latin-1")
        whole = self.number.get(raw)
        if whole is not None:
            return [whole]
        longest = [0] * len(raw)
        for end, (number, size) in self.automaton.iter(raw):
            longest[end - size + 1] = number  # ends rise, so the longest comes last
        dead = bytearray(len(raw) + 1)
        out: list[int] = []
        place, token = 0, longest[0]
        while True:
            last = out[-1] if out else None
            choice: int | None = token
            while choice is not None:
                end = place + len(self.text[choice])
                if not dead[end] and (last is None or self._compatible(last, choice)):
                    break
                choice = self._prefix(choice)
            if choice is None:
                dead[place] = 1
                token = out.pop()
                place -= len(self.text[token])
                continue
            out.append(choice)
            place += len(self.text[choice])
            if place == len(raw):
                return out
            token = longest[place]

    def encode(self, text: str) -> list[int]:
        return [number for piece in self.cut(text) for number in self.pretoken(piece)]

    def decode(self, ids: list[int]) -> str:
        return "".join(self.text[n] for n in ids).encode("latin-1").decode("utf-8", "replace")


class _Pieces(dict):
    def __init__(self, encoder: Encoder, before: str) -> None:
        super().__init__()
        self.encoder, self.before = encoder, before

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encoder.encode(self.before + piece))
        if len(piece) <= LONGEST_PIECE:
            if len(self) >= REMEMBERED_PIECES:
                self.clear()
            self[piece] = ids
        return ids


_between = re.compile(r"(?<=\S) (?=\S)").split


def _encoder(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        first, later = _Pieces(encoder, ""), _Pieces(encoder, " ")
        for batch in batches:
            flat, ends = array("i"), [0]
            for text in batch.column(1).to_pylist():
                if text:
                    pieces = _between(text)
                    flat.extend(first[pieces[0]])
                    flat.extend(chain.from_iterable(map(later.__getitem__, pieces[1:])))
                ends.append(len(flat))
            ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if len(flat) else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["id", "ids"])

    return run


def encode_table(df: DataFrame, id_col: str, text_col: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """``id, ids`` of every row.  ``vocabulary`` is the path of a byte-level BPE file that every executor can read."""
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_encoder(vocabulary), "id long, ids array<int>")
