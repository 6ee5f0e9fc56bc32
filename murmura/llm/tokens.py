"""Token ids of whole texts by the tokenizers library, with a memory of words.

Byte-level BPE cuts a text into pieces before it merges, and a single space or
line feed between other characters always begins such a piece.  So most texts
can be cut there, equal pieces share their ids, and only pieces not met before
go through the tokenizer, many at a time.  Texts with runs of white space,
where the cuts depend on what follows, go through it whole.

Arrow cuts, finds pieces among those remembered and puts their ids in a row;
Python meets only new ones.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Pieces remembered by a Python worker at most, but for those of one call; of more, the ones met last.
REMEMBERED = 500_000
_PUNCTUATION = frozenset(",.;:!?")
#: Letters below this one are letters for every version of Unicode.
_LATIN_END = "\u0250"
# A word, with the space before it if there is one.
_WORD = re.compile(r" ?\S+").fullmatch


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One per worker process and tokenizer file."""
    return Encoder(path)


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        # Pieces, their ids (NULL if cutting there is not safe) and the call that met them last.
        self._pieces = pa.array([], pa.large_string())
        self._ids = pa.array([], pa.large_binary())
        self._met, self._calls = np.zeros(0, np.int64), 0
        feed = self._whole("\n")
        # Only a tokenizer that keeps a lone line feed apart and cuts before a space may be fed pieces.
        probe = ["ab", " cd", "\n", "ef", ".", "\n", " gh", ",", " ij"]
        self._cuttable = len(feed) == 4 and self._whole("".join(probe)) == b"".join(map(self._whole, probe))
        self._feed = int(np.frombuffer(feed, "<u4")[0]) if self._cuttable else -1
        # How the tokenizer's model spells the letters of words that are one piece.
        self._spelling: dict[int, str] = {}
        if self._cuttable:
            cut = self._tokenizer.pre_tokenizer.pre_tokenize_str
            letters = [c for c in map(chr, range(ord(_LATIN_END))) if c.isalpha()]
            self._spelling = {ord(c): cut(c)[0][0] for c in letters} | {32: cut(" a")[0][0][:-1]}

    def _whole(self, text: str) -> bytes:
        # Without the places of ids in the text, which cost as much as the ids.
        return np.array(self._tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4").tobytes()

    def encode(self, texts: list[str] | pa.Array) -> list[bytes]:
        """The ids of each text, NULL as empty, as little-endian unsigned 32-bit integers."""
        column = pa.array(texts, pa.large_string()) if isinstance(texts, list) else texts.cast(pa.large_string())
        column = column.fill_null("")
        if not self._cuttable or not len(column):
            return [self._whole(x.as_py()) for x in column]
        pieces, firsts, whole = _cut(column)
        if not len(pieces):
            return [b""] * len(column)
        places = self._places(pieces)
        if self._ids.null_count:
            unsafe = self._ids.is_null().to_numpy(zero_copy_only=False)[places]
            whole[np.searchsorted(firsts, np.flatnonzero(unsafe), "right") - 1] = True
        joined = self._ids.take(pa.array(places))
        _, ends, ids = joined.buffers()
        ends, ids = np.frombuffer(ends, np.int64)[firsts].tolist(), memoryview(ids or b"")
        return [
            self._whole(column[k].as_py()) if whole[k] else ids[start:end].tobytes()
            for k, (start, end) in enumerate(zip(ends, ends[1:]))
        ]

    def _places(self, pieces: pa.LargeStringArray) -> np.ndarray:
        """Where each piece is among those remembered, which new ones join."""
        if len(self._pieces) > REMEMBERED:  # those met last stay
            kept = np.sort(np.argsort(-self._met, kind="stable")[: REMEMBERED * 3 // 4])
            self._pieces, self._ids, self._met = self._pieces.take(kept), self._ids.take(kept), self._met[kept]
        found = pc.index_in(pieces, value_set=self._pieces)
        places = found.fill_null(0).to_numpy().copy()
        if found.null_count:
            new, before = found.is_null(), len(self._pieces)
            learnt = pieces.filter(new).dictionary_encode()
            places[new.to_numpy(zero_copy_only=False)] = learnt.indices.to_numpy() + before
            ids = self._learn(learnt.dictionary.to_numpy(zero_copy_only=False).tolist())
            self._pieces = pa.concat_arrays([self._pieces, learnt.dictionary])
            self._ids = pa.concat_arrays([self._ids, pa.array(ids, pa.large_binary())])
            self._met = np.append(self._met, np.zeros(len(ids), np.int64))
        self._calls += 1
        self._met[places] = self._calls
        return places

    def _learn(self, pieces: list[str]) -> list[bytes | None]:
        """The ids of each of ``pieces``, None for those at which cutting is not safe.

        These are lone spaces, and pieces with other white space.
        A word's closing punctuation is looked up on its own.
        """
        found: dict[str, bytes | None] = {}
        ended, words, others = set(), [], list(_PUNCTUATION)
        for piece in pieces:
            core = piece
            if piece[-1] in _PUNCTUATION and piece[-2:-1].isalpha():
                core = piece[:-1]
                ended.add(piece)
            if core in found:
                continue
            found[core] = None
            if core[core[0] == " " :].isalpha() and (core.isascii() or max(core) < _LATIN_END):
                words.append(core)
            elif _WORD(core):
                others.append(core)
        tokenize = self._tokenizer.model.tokenize
        for word, spelled in zip(words, "\n".join(words).translate(self._spelling).split("\n")):
            ids = [x.id for x in tokenize(spelled)]
            found[word] = pack(f"<{len(ids)}I", *ids)
        # Between line feeds each piece is merged on its own.
        joined = np.frombuffer(self._whole("\n".join(others)), "<u4")
        ends = np.flatnonzero(joined == self._feed).tolist() + [len(joined)]
        start = 0
        for piece, end in zip(others, ends):
            found[piece] = joined[start:end].tobytes()
            start = end + 1
        found["\n"] = pack("<I", self._feed)
        for piece in ended:
            core = found[piece[:-1]]
            found[piece] = None if core is None else core + found[piece[-1]]
        return [found[x] for x in pieces]


def _cut(column: pa.LargeStringArray) -> tuple[pa.LargeStringArray, np.ndarray, np.ndarray]:
    """All pieces of the texts, the number of each text's first piece (and of all), and which texts are not safe to cut.

    A piece is a line feed, or begins with a space, behind a line feed, or with its text.
    Where two such beginnings meet, or a text ends with a line feed, cutting is not safe.
    """
    _, bounds, data = column.buffers()
    bounds = np.frombuffer(bounds, np.int64)[column.offset :][: len(column) + 1]
    data = np.frombuffer(data or b"", np.uint8)[bounds[0] : bounds[-1]]
    bounds = bounds - bounds[0]
    filled = np.flatnonzero(np.diff(bounds))
    feed = data == ord("\n")
    white, opened = feed | (data == ord(" ")), np.zeros(len(data), bool)
    opened[1:] = feed[:-1]
    opened[bounds[filled]] = True
    whole = np.zeros(len(column), bool)
    whole[np.searchsorted(bounds, np.flatnonzero(white & opened), "right") - 1] = True
    whole[filled] |= feed[bounds[filled + 1] - 1]
    starts = np.flatnonzero(white | opened)
    ends = np.append(starts, len(data)).astype(np.int64)
    pieces = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(data))
    return pieces, np.searchsorted(starts, bounds), whole


#: What of an Arrow batch is worked on at once, in bytes of text.
PART_BYTES = 4 << 20


def parts(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    """``batch`` in runs of rows with about ``PART_BYTES`` of text each."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(batch["text"]), 0).to_numpy(zero_copy_only=False))
    first = 0
    while first < batch.num_rows:
        before = int(sizes[first - 1]) if first else 0
        end = max(first + 1, int(np.searchsorted(sizes, before + PART_BYTES, "right")))
        yield batch.slice(first, end - first)
        first = end


def released() -> None:
    """Gives back what Arrow holds for later batches: workers are kept, and later stages run beside it."""
    pa.default_memory_pool().release_unused()


def texts(column: pa.Array) -> list[str]:
    """The texts of ``column``, NULL as empty."""
    return pc.fill_null(column, "").to_pylist()
