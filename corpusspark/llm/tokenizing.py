"""Encoding with a public byte-level BPE: a priority queue of merge ranks over a linked list of symbols."""

from __future__ import annotations

import base64
import heapq
import re
from collections.abc import Iterator
from itertools import chain
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabularies lie on every worker; a parameter everywhere.
TOKENIZERS = "/opt/tokenizers"
#: Pieces a worker remembers; when full it starts anew, which changes no result.
REMEMBERED = 400_000
#: Fixed value: the vocabulary's pattern of pieces that merges never cross.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: A run of what is not white space with the white space before it: no piece of PATTERN crosses its
#: ends, as no piece has white space after anything else, and the look-ahead sees only white space.
_STEPS = re.compile(r"\s*\S+|\s+")
#: White space to the module re but not to PATTERN; texts that have any are matched as a whole.
_ODD = re.compile("[\x1c-\x1f]")
#: Where an ASCII piece may come apart: before what follows its small letters.
_HUMPS = re.compile(r"[^a-z]*[a-z]+|[^a-z]+")


class _Memory(dict):
    """A dict that works out what it lacks and forgets everything when it is full."""

    def __init__(self, make, most: int = REMEMBERED) -> None:
        super().__init__()
        self.make, self.most = make, most

    def __missing__(self, key):
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class BytePairs:
    """A byte-level BPE given as ranks of byte strings; a string's rank is its id."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN) -> None:
        import regex

        self.ranks = ranks
        self.strings = {i: b for b, i in ranks.items()}
        self.single = [ranks[bytes([b])] for b in range(256)]
        self.width = max(ranks.values()).bit_length()
        self.find = regex.compile(pattern).findall
        self.pairs = self._pairs()
        self._short = {b.decode() for b in ranks if len(b) in (2, 3) and b.isascii()}
        self._fours = {b[k : k + 4].decode() for b in ranks for k in range(len(b) - 3) if b[k : k + 4].isascii()}
        self._apart = _Memory(self._parts_here)
        self._stretches = _Memory(lambda s: tuple(self.merged(s.encode("utf-8", "replace"))))
        self._pieces = _Memory(self._piece)
        self._steps = _Memory(lambda step: tuple(chain.from_iterable(map(self._pieces.__getitem__, self.find(step)))))

    @staticmethod
    def load(folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> BytePairs:
        lines = Path(folder, f"{name}.tiktoken").read_bytes().splitlines()
        return BytePairs({base64.b64decode(a): int(b) for a, b in (line.split() for line in lines if line)})

    def _pairs(self) -> dict[int, int]:
        """Of each pair of ids that can merge, the merged string's rank: every way to part a string counts."""
        ranks, width = self.ranks, self.width
        return {(ranks[b[:k]] << width) | ranks[b[k:]]: i for b, i in ranks.items() for k in range(1, len(b)) if b[:k] in ranks and b[k:] in ranks}

    def _parts_here(self, sides: tuple[str, str]) -> bool:
        """Whether no symbol can span the place between two strings, of which three characters each are looked at.

        A symbol of two or three characters that does is in the vocabulary; a longer one has four
        characters around the place that some string of the vocabulary has.
        """
        left, right = sides
        spans = lambda n: {left[len(left) - k :] + right[: n - k] for k in range(1, n) if k <= len(left) and n - k <= len(right)}
        return not (spans(2) | spans(3)) & self._short and not spans(4) & self._fours

    def _piece(self, piece: str) -> tuple[int, ...]:
        """The ids of a piece. Where no symbol can span a place, what is at either side of it merges by
        itself and is remembered by itself; compound names fall into their few parts that way."""
        if not piece.isascii():
            return self._stretches[piece]
        ids, held, apart = (), "", self._apart
        for hump in _HUMPS.findall(piece):
            if held and apart[held[-3:], hump[:3]]:
                ids += self._stretches[held]
                held = hump
            else:
                held += hump
        return ids + self._stretches[held]

    def merged(self, b: bytes) -> list[int]:
        """Ids of one piece. The queue holds rank and place of each pair that may merge; the pair of
        least rank, the leftmost of equals, merges first. An entry whose symbols have changed since is
        stale and is skipped."""
        single, get, width = self.single, self.pairs.get, self.width
        n = len(b)
        if n == 1:
            return [single[b[0]]]
        symbols = [single[x] for x in b]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        shift = n.bit_length()
        mask = (1 << shift) - 1
        queue = [(r << shift) | i for i in range(n - 1) if (r := get((symbols[i] << width) | symbols[i + 1])) is not None]
        heapq.heapify(queue)
        pop, push = heapq.heappop, heapq.heappush
        while queue:
            e = pop(queue)
            i, rank = e & mask, e >> shift
            left, j = symbols[i], after[i]
            if left < 0 or j >= n or get((left << width) | symbols[j]) != rank:
                continue
            symbols[i], symbols[j] = rank, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (r := get((rank << width) | symbols[k])) is not None:
                    push(queue, (r << shift) | i)
            p = before[i]
            if p >= 0 and (r := get((symbols[p] << width) | rank)) is not None:
                push(queue, (r << shift) | p)
        return [s for s in symbols if s >= 0]

    def parts(self, text: str) -> Iterator[tuple[int, ...]]:
        """The ids of text, in tuples."""
        if _ODD.search(text):
            return map(self._pieces.__getitem__, self.find(text))
        return map(self._steps.__getitem__, _STEPS.findall(text))

    def encode(self, text: str | None) -> list[int]:
        """The ids of text; no special tokens. Null and empty texts have none."""
        return list(chain.from_iterable(self.parts(text))) if text else []

    def decode(self, ids: list[int]) -> str:
        """The text of ids: their strings one after the other."""
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


_loaded: dict[tuple[str, str], BytePairs] = {}


def _bpe(folder: str, name: str) -> BytePairs:
    if (folder, name) not in _loaded:
        _loaded[folder, name] = BytePairs.load(folder, name)
    return _loaded[folder, name]


def encoded(texts: DataFrame, key: str = "doc_id", text: str = "text", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, ids): the token ids of every row's text, in the order of the rows.

    Null and empty texts have an empty list; blank and very long texts are encoded like others, whole;
    a null key stays null; repeated rows stay repeated. Other columns are not read. There is no shuffle.
    """
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(folder, name)
        for batch in batches:
            keys, rows = batch.column(0), batch.column(1)
            for at in range(0, max(1, batch.num_rows), 1000):
                ids, ends = [], [0]
                for t in rows.slice(at, 1000).to_pylist():
                    if t:
                        ids.append(np.fromiter(chain.from_iterable(bpe.parts(t)), np.int64))
                        ends.append(ends[-1] + len(ids[-1]))
                    else:
                        ends.append(ends[-1])
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int64)
                yield pa.RecordBatch.from_arrays([keys.slice(at, 1000), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], names=[key, "ids"])

    return texts.select(key, text).mapInArrow(run, f"{key} {kind}, ids array<bigint>")


def decoded(ids: DataFrame, key: str = "doc_id", folder: str = TOKENIZERS, name: str = "byte_bpe_50k") -> DataFrame:
    """(key, text) of encoded rows; an empty list gives an empty text, null ids a null one."""
    kind = ids.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _bpe(folder, name)
        for batch in batches:
            texts = [None if x is None else bpe.decode(x) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=[key, "text"])

    return ids.select(key, F.col("ids")).mapInArrow(run, f"{key} {kind}, text string")
