"""Near-duplicate texts by adaptive multi-match prefixes.

Texts are sets of word sequences. In one order of all sequences, the rarer first, two sets of which
`threshold` is in common share at least l of the sequences in prefixes that are l - 1 longer than the
shortest that must share one. Each text takes the l for which its estimated cost is least, so texts
with common sequences in their prefix get longer prefixes of which more must match.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusspark.llm.columns import pack, sliced, summed, unpack
from corpusspark.llm.words import words_of
from corpusspark.tables import let_go, written

WORDS, THRESHOLD, MIN_WORDS = 3, 0.6, 20
#: Counters of the sketch of document frequencies at least and at most, and the sequences a counter should hold on average
#: at most. All texts are counted; beyond the greatest sketch counters hold more. The sketch only gives the order of
#: sequences and the cost of prefixes; its noise blurs the order among rare sequences and changes no result.
SKETCH, LARGEST, LOAD = 1 << 21, 1 << 24, 16
#: Bytes of text that a sequence comes from, for that size: a word and what parts it from the next.
BYTES = 6
#: Bits of the set that screens texts for verification; what it lets through by mistake is verified like the rest.
SCREEN = 1 << 23
#: Prefix lengthenings that are tried, and the cost of verifying a candidate against that of scanning a posting.
LENGTHENINGS = (1, 2, 3, 4, 6, 8, 12, 16)
VERIFY_COST = 8
#: Postings that one range of sequences should hold.
RANGE_POSTINGS = 2_000_000
#: Postings (and pairs) a task gathers before it packs them by range, and the bits of ranges told apart in one shuffle:
#: packed rows hold some thousands whatever the number of ranges; more ranges are told apart in further shuffles.
GATHERED, FAN_BITS = 1_000_000, 9
#: Texts in whose prefix one sequence may be in one unit of work; those of a commoner one are split into blocks,
#: each pair of which is a unit.
HOT = 20_000
#: Rounds, a power of two, in which postings are made, matched and let go, each for its part of all items, and the ranges a
#: round has at least.
ROUNDS, ROUND_RANGES = 4, 8
#: Bits of a set's signature.
SIGN = 256
BITS = 40
_LOW = np.uint64((1 << BITS) - 1)
_SETS = "kind int, id bigint, key bigint, chunk_id string, doc_id string, n int, items binary, slice int, part binary"


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        v = self[word] = xxhash.xxh64_intdigest(word)
        return v


_ids = _Ids()


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result hangs on every bit of h. Wraps on purpose."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def shingle_sets(texts: list[str | None], words: int = WORDS, min_words: int = MIN_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) of each different word sequence of each text with min_words words, sorted; items have 40 bits."""
    ids, lens = [], np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        if t:
            w = words_of(t)
            if len(w) >= max(min_words, words):
                ids.append(np.fromiter(map(_ids.__getitem__, w), np.uint64, len(w)))
                lens[i] = len(w)
    if not ids:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    a, row = np.concatenate(ids), np.repeat(np.arange(len(texts)), lens)
    h = np.zeros(len(a) - words + 1, np.uint64)
    for k in range(words):
        h = _mix(h + a[k : len(a) - words + 1 + k])
    inside = row[: len(h)] == row[words - 1 :]
    both = np.unique((row[: len(h)][inside].astype(np.uint64) << np.uint64(BITS)) | (h[inside] & _LOW))
    return (both >> np.uint64(BITS)).astype(np.int64), both & _LOW


def _bytes5(h: np.ndarray) -> np.ndarray:
    return np.ascontiguousarray(h.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5])


def _from5(b: np.ndarray) -> np.ndarray:
    out = np.zeros((len(b) // 5, 8), np.uint8)
    out[:, :5] = b.reshape(-1, 5)
    return out.reshape(-1).view("<u8").astype(np.uint64)


def _binary(data: np.ndarray, ends: np.ndarray) -> pa.Array:
    """A binary column of consecutive stretches of data, which end at ends."""
    offsets = np.concatenate([[0], ends]).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(ends), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())])


def _spots(h: np.ndarray, counters: int) -> np.ndarray:
    return (_mix(h) & np.uint64(counters - 1)).astype(np.int64)


def _sets_and_sketch(chunks: DataFrame, words: int, min_words: int, times: float) -> DataFrame:
    """Kind 0: the set of each text, with a number and a key that equal sets share; kind 1: each task's part of the sketch of all texts.

    The sketch has SKETCH counters times `times`, a power of two. Numbers are those of the task and the row in it. They are short and hold once the rows are written.
    """
    counters = int(SKETCH * times)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sketch, done = np.zeros(counters, np.int32), TaskContext.get().partitionId() << 32
        schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("key", pa.int64()), ("chunk_id", pa.string()), ("doc_id", pa.string()), ("n", pa.int32()), ("items", pa.binary()), ("slice", pa.int32()), ("part", pa.binary())])
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                row, items = shingle_sets(part.column(2).to_pylist(), words, min_words)
                if not len(row):
                    continue
                rows, first, n = np.unique(row, return_index=True, return_counts=True)
                with np.errstate(over="ignore"):
                    key = np.add.reduceat(_mix(items + np.uint64(0x9E3779B97F4A7C15)), first)
                np.add.at(sketch, _spots(items, counters), 1)
                take = pa.array(rows)
                none = lambda t: pa.nulls(len(rows), t)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int32)), pa.array(done + np.arange(len(rows))), pa.array(key.view(np.int64)), part.column(0).take(take), part.column(1).take(take), pa.array(n.astype(np.int32)), _binary(_bytes5(items), 5 * np.cumsum(n)), none(pa.int32()), none(pa.binary())], schema=schema)
                done += len(rows)
        parts = sliced(sketch)
        none = lambda t: pa.nulls(len(parts), t)
        yield pa.RecordBatch.from_arrays([pa.array([1] * len(parts), pa.int32()), none(pa.int64()), none(pa.int64()), none(pa.string()), none(pa.string()), none(pa.int32()), none(pa.binary()), pa.array([i for i, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], schema=schema)

    return chunks.select("chunk_id", "doc_id", "text").mapInArrow(run, _SETS)


_POSTING = {"ids": np.int64, "keys": np.int64, "sizes": np.int32, "prefixes": np.int32, "items": np.uint64, "owners": np.uint32, "places": np.int32, "sides": np.uint8, "signs": np.uint64}
_PAIR = {"keys": np.int64, "firsts": np.int32, "seconds": np.int64, "needs": np.int32, "counts": np.int32}


def _schema(kinds: dict) -> str:
    return "range bigint, " + ", ".join(f"{k} binary" for k in kinds)


def _rows(packed: list[tuple], kinds: dict) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([x[0] for x in packed], pa.int64()), *[pa.array([x[i] for x in packed], pa.binary()) for i in range(1, len(kinds) + 1)]], names=["range", *kinds])


def _stretches(r: np.ndarray) -> list[tuple[int, int, int]]:
    """(value, start, end) of the stretches of equal values in a sorted array."""
    new = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else np.zeros(0, np.int64)
    return list(zip(r[new].tolist(), new.tolist(), [*new[1:].tolist(), len(r)], strict=False))


def _pack_postings(cols: tuple, bits: int) -> list[tuple]:
    """Packed rows of postings (h, id, key, size, prefix, place, side, signature), one for each range of h by its first bits."""
    order = np.argsort(cols[0], kind="stable")
    h, ids, keys, sizes, prefixes, places, sides = (c[order] for c in cols[:-1])
    signs = cols[-1]
    out = []
    for r, a, e in _stretches((h >> np.uint64(BITS - bits)).astype(np.int64)):
        own, first, idx = np.unique(ids[a:e], return_index=True, return_inverse=True)
        at = a + first
        out.append((r, pack(own), pack(keys[at]), pack(sizes[at].astype(np.int32)), pack(prefixes[at].astype(np.int32)), pack(np.diff(h[a:e], prepend=np.uint64(0))), pack(idx.astype(np.uint32)), pack(places[a:e].astype(np.int32)), pack(sides[a:e].astype(np.uint8)), pack(signs[order[at]].reshape(-1))))
    return out


def _unpack_postings(r: dict) -> tuple:
    x = {k: unpack(r[k], kind) for k, kind in _POSTING.items()}
    of = x["owners"]
    return np.cumsum(x["items"], dtype=np.uint64), x["ids"][of], x["keys"][of], x["sizes"][of].astype(np.int64), x["prefixes"][of].astype(np.int64), x["places"].astype(np.int64), x["sides"], x["signs"].reshape(-1, SIGN // 64)[of]


def _signatures(h: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """(n, SIGN / 64) words: bit k of a set's signature tells whether an odd number of its items fall on k.

    An item that two sets share changes both signatures alike, so they differ in no more bits than the sets in items.
    """
    spot = (_mix(h ^ np.uint64(0x5851F42D4C957F2D)) & np.uint64(SIGN - 1)).astype(np.int64)
    odd = np.bincount(owner * SIGN + spot, minlength=n * SIGN) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64).reshape(n, SIGN // 64)


def _near(signs: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs of rows of signs differ in at most so many bits."""
    out = np.empty(len(i), bool)
    for at in range(0, len(i), 65_536):
        own = slice(at, at + 65_536)
        out[own] = np.bitwise_count(signs[i[own]] ^ signs[j[own]]).sum(axis=1, dtype=np.int64) <= most[own]
    return out


def _part(a: np.ndarray, bits: int) -> np.ndarray:
    """The range that counts the pairs whose first key is a."""
    return (_mix(a.view(np.uint64)) >> np.uint64(64 - bits)).astype(np.int64)


def _pack_pairs(cols: tuple, bits: int) -> list[tuple]:
    """Packed rows of pairs (a, b, need, count), one for each range of a by the first bits of its hash."""
    part = _part(cols[0], bits)
    order = np.lexsort((cols[1], cols[0], part))
    a, b, need, count = (c[order] for c in cols)
    out = []
    for r, s, e in _stretches(part[order]):
        own, idx = np.unique(a[s:e], return_inverse=True)
        out.append((r, pack(own), pack(np.diff(idx, prepend=0).astype(np.int32)), pack(b[s:e]), pack(need[s:e].astype(np.int32)), pack(count[s:e].astype(np.int32))))
    return out


def _unpack_pairs(r: dict) -> tuple:
    x = {k: unpack(r[k], kind) for k, kind in _PAIR.items()}
    return x["keys"][np.cumsum(x["firsts"])], x["seconds"], x["needs"], x["counts"]


def _respread(rows: DataFrame, at: int, bits: int, kinds: dict, unpacked, packer) -> DataFrame:
    """Packed rows told apart by the first `at` bits, told apart by `bits`: further bits in further shuffles, FAN_BITS each.

    A task gathers rows before it packs them again, so rows stay some thousand entries long, and their
    number grows with the data, not with its square.
    """
    while at < bits:
        at = min(bits, at + FAN_BITS)

        def run(batches: Iterator[pa.RecordBatch], at: int = at) -> Iterator[pa.RecordBatch]:
            held, n = [], 0
            for batch in batches:
                for i in range(batch.num_rows):
                    held.append(unpacked(batch.slice(i, 1).to_pylist()[0]))
                    n += len(held[-1][0])
                    if n >= GATHERED:
                        yield _rows(packer(tuple(np.concatenate(c) for c in zip(*held, strict=True)), at), kinds)
                        held, n = [], 0
            if n:
                yield _rows(packer(tuple(np.concatenate(c) for c in zip(*held, strict=True)), at), kinds)

        rows = rows.repartition("range").mapInArrow(run, _schema(kinds))
    return rows


def _blocks(h: np.ndarray, keys: np.ndarray, met: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(posting, item, side) of postings of sequences that so many texts have, as estimated, spread over units of work.

    A sequence of more than HOT texts has as many blocks as HOT is in them, by hash of the set's key, and one
    unit for each two blocks and each block alone. In a unit of two, side 0 meets side 1 only, so two texts
    meet once; side 2 meets all. A unit's item is a hash of the sequence and the unit.
    """
    n = np.maximum(1, np.ceil(met / HOT)).astype(np.int64)
    hot = np.flatnonzero(n > 1)
    cold = np.flatnonzero(n == 1)
    posting, item, side = [cold], [h[cold]], [np.full(len(cold), 2, np.uint8)]
    block = (_mix(keys[hot].view(np.uint64)) % n[hot].astype(np.uint64)).astype(np.int64)
    for other in range(int(n.max(initial=1)) if len(hot) else 0):
        own = other < n[hot]
        i, b = hot[own], block[own]
        low, high = np.minimum(b, other), np.maximum(b, other)
        posting.append(i)
        item.append(_mix(h[i] + (low * (1 << 20) + high + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) & _LOW)
        side.append(np.where(b == other, 2, (b > other).astype(np.int64)).astype(np.uint8))
    return np.concatenate(posting), np.concatenate(item), np.concatenate(side)


def _levels(sketch: np.ndarray) -> np.ndarray:
    """Eight times the logarithm of how often a sequence on each counter occurs: what the counter has beyond the median one, which is chance."""
    middle = np.partition(sketch, len(sketch) // 2)[len(sketch) // 2] if len(sketch) else 0
    parts = np.array_split(sketch, max(1, len(sketch) >> 20))
    return np.concatenate([np.minimum(255, np.round(8 * np.log2(1.0 + np.maximum(0, x - middle)))).astype(np.uint8) for x in parts])


def prefix_postings(sets: DataFrame, sketch: np.ndarray, share: float, bits: int, threshold: float, turn: int = 0) -> DataFrame:
    """(range, ids, keys, sizes, prefixes, items, owners, places, sides, signs): the postings of all prefixes, packed by range of items.

    share: the part of the ranges that are made, one by a power of two; turn tells which of these parts.
    """
    seen, rounds = sets.sparkSession.sparkContext.broadcast(_levels(sketch)), round(1 / share)  # LARGEST bytes at most
    apart = min(bits, FAN_BITS + int(np.log2(rounds)))  # a round has 1 of so many rounds' ranges

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        level = seen.value
        cost_of = np.maximum(0.0, 2.0 ** (np.arange(256) / 8) - 2)
        held, gathered = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 16_000):
                part = batch.slice(at, 16_000)
                keys, pick = np.unique(part.column(1).to_numpy(zero_copy_only=False), return_index=True)
                pick = np.sort(pick)
                ids, keys, sizes = (part.column(i).to_numpy(zero_copy_only=False)[pick].astype(np.int64) for i in (0, 1, 2))
                items = part.column(3).take(pa.array(pick))
                h = _from5(np.frombuffer(b"".join(items.to_pylist()), np.uint8))
                owner = np.repeat(np.arange(len(keys)), sizes)
                code = np.sort((owner.astype(np.uint64) << np.uint64(BITS + 8)) | (level[_spots(h, len(level))].astype(np.uint64) << np.uint64(BITS)) | h)
                h, lev = code & _LOW, ((code >> np.uint64(BITS)) & np.uint64(255)).astype(np.int64)
                signs = _signatures(h, owner, len(keys))
                start = np.cumsum(sizes) - sizes
                place = np.arange(len(h)) - start[owner]
                shortest = sizes - np.ceil(threshold * sizes - 1e-9).astype(np.int64) + 1
                scan = np.concatenate([[0.0], np.cumsum(cost_of[lev])])
                costs = []
                for more in LENGTHENINGS:
                    reach = np.minimum(sizes, shortest + more - 1)
                    costs.append((scan[start + reach] - scan[start]) * (1 + VERIFY_COST / more))
                best = np.array(LENGTHENINGS)[np.argmin(np.stack(costs), axis=0)]
                prefix = np.minimum(sizes, shortest + best - 1)
                kept = place < prefix[owner]
                h, lev, owner, place = h[kept], lev[kept], owner[kept], place[kept]
                posting, h, side = _blocks(h, keys[owner], cost_of[lev])
                own = (h * np.uint64(rounds)) >> np.uint64(BITS) == turn
                posting, h, side = posting[own], h[own], side[own]
                owner, place = owner[posting], place[posting]
                held.append((h, ids[owner], keys[owner], sizes[owner].astype(np.int32), prefix[owner].astype(np.int32), place.astype(np.int32), side, signs[owner]))
                gathered += len(h)
                if gathered >= GATHERED:
                    yield _rows(_pack_postings(tuple(np.concatenate(c) for c in zip(*held, strict=True)), apart), _POSTING)
                    held, gathered = [], 0
        if gathered:
            yield _rows(_pack_postings(tuple(np.concatenate(c) for c in zip(*held, strict=True)), apart), _POSTING)

    first = sets.select("id", "key", "n", "items").mapInArrow(run, _schema(_POSTING))
    return _respread(first, apart, bits, _POSTING, _unpack_postings, _pack_postings)


def _match(h, key, n, p, place, side, of, signs, threshold: float, flush: int = 2_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(key, key, matches needed) of postings with equal items whose sizes, places and signatures still allow the threshold.

    of: the posting's row of signs. Most texts that meet by a common item are told apart by their signatures here, so
    the pairs that are counted and verified grow with the near-duplicates and not with the square of the data. An item's postings are in the order of their sets' sizes, so each meets those alone that are not too large for it.
    """
    order = np.lexsort((key, n, h))
    h, key, n, p, place, side, of = (x[order] for x in (h, key, n, p, place, side, of))
    fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (key[1:] != key[:-1])]) if len(h) else np.zeros(0, bool)
    h, key, n, p, place, side, of = (x[fresh] for x in (h, key, n, p, place, side, of))
    item = np.cumsum(np.concatenate([[0], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
    wide = int(n.max(initial=0)) * 2 + 2
    end = np.searchsorted(item * wide + n, item * wide + np.minimum(wide - 1, np.floor(n / threshold + 1e-9).astype(np.int64)), "right")
    at, step, held, size = np.arange(len(h)), 0, [], 0
    while True:
        step += 1
        at = at[at + step < end[at]]
        if not len(at):
            break
        i, j = at, at + step
        fits = (side[i] != side[j]) | (side[i] == 2)
        i, j = i[fits], j[fits]
        ni, nj = n[i], n[j]
        least = np.ceil(threshold / (1 + threshold) * (ni + nj) - 1e-9).astype(np.int64)
        fits = 1 + np.minimum(place[i], place[j]) + np.minimum(ni - place[i], nj - place[j]) - 1 >= least
        i, j, ni, nj, least = i[fits], j[fits], ni[fits], nj[fits], least[fits]
        fits = _near(signs, of[i], of[j], ni + nj - 2 * least)
        i, j, ni, nj, least = i[fits], j[fits], ni[fits], nj[fits], least[fits]
        need = np.maximum(1, least - np.maximum(ni - p[i], nj - p[j]))
        held.append((np.minimum(key[i], key[j]), np.maximum(key[i], key[j]), need.astype(np.int32)))
        size += len(i)
        if size > flush:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _counted(a: np.ndarray, b: np.ndarray, need: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.lexsort((b, a))
    a, b, need, count = a[order], b[order], need[order], count[order]
    new = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    return a[new], b[new], need[new], np.add.reduceat(count, new, dtype=np.int32) if len(a) else count


def met_pairs(postings: DataFrame, bits: int, threshold: float) -> DataFrame:
    """(range, keys, firsts, seconds, needs, counts): pairs of sets that share an item of these postings and may be alike, packed by range of the first.

    Of equal sets only the one with the least number takes part: their postings are the same, so each
    range that sees one of them sees them all.
    """

    def pair(t: pa.Table) -> pa.Table:
        h, own, key, n, p, place, side, signs = (np.concatenate(c) for c in zip(*(_unpack_postings(r) for r in t.to_pylist()), strict=True))
        _, first, of = np.unique(key, return_index=True, return_inverse=True)
        signs = signs[first]
        least = np.full(of.max() + 1, np.iinfo(np.int64).max)
        np.minimum.at(least, of, own)
        rows = []
        for a, b, need in _match(h, least[of], n, p, place, side, of, signs, threshold):
            rows += _pack_pairs(_counted(a, b, need, np.ones(len(a), np.int32)), min(bits, FAN_BITS))
        return pa.Table.from_batches([_rows(rows, _PAIR)])

    return postings.groupBy("range").applyInArrow(pair, _schema(_PAIR))


def candidates(pairs: DataFrame, bits: int) -> DataFrame:
    """(a, b) of sets that share as many prefix items as they must, from all rounds: what all items are rarer than must hold the rest."""

    def count(t: pa.Table) -> pa.Table:
        a, b, need, n = _counted(*[np.concatenate(c) for c in zip(*(_unpack_pairs(r) for r in t.to_pylist()), strict=True)])
        kept = n >= need
        return pa.table([pa.array(a[kept]), pa.array(b[kept])], names=["a", "b"])

    return _respread(pairs, min(bits, FAN_BITS), bits, _PAIR, _unpack_pairs, _pack_pairs).groupBy("range").applyInArrow(count, "a bigint, b bigint")


def _screened(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, key, items) of the sets that occur in pairs, and few others: no set is shuffled that no pair needs."""
    spot = lambda k: (_mix(k.view(np.uint64)) & np.uint64(SCREEN - 1)).astype(np.int64)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.zeros(SCREEN // 8, np.uint8)
        for batch in batches:
            for c in (0, 1):
                s = spot(batch.column(c).to_numpy(zero_copy_only=False))
                np.bitwise_or.at(bits, s >> 3, (1 << (s & 7)).astype(np.uint8))
        rows = sliced(bits)
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in rows], pa.int32()), pa.array([b for _, b in rows], pa.binary())], names=["slice", "part"])

    bits = summed(pairs.select("a", "b").mapInArrow(mark, "slice int, part binary"), np.uint8, np.bitwise_or)
    marked = sets.sparkSession.sparkContext.broadcast(bits)  # SCREEN bits

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(marked.value):
                s = spot(batch.column(0).to_numpy(zero_copy_only=False))
                yield batch.filter(pa.array((marked.value[s >> 3] >> (s & 7).astype(np.uint8)) & 1 == 1))

    return sets.select("id", "key", "items").mapInArrow(screen, "id bigint, key bigint, items binary")


def verified(sets: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """(a, b, similarity) of the pairs, as keys, whose sets have at least threshold of their union in common."""
    own = _screened(sets, pairs)
    side = lambda k: own.select(F.col("id").alias(k), F.col("key").alias(f"{k}_key"), F.col("items").alias(f"{k}_items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            score = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = _from5(np.frombuffer(x, np.uint8)), _from5(np.frombuffer(y, np.uint8))
                both = len(np.intersect1d(x, y, assume_unique=True))
                score.append(both / (len(x) + len(y) - both))
            kept = np.array(score) >= threshold - 1e-12
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score, pa.float64())], names=["a", "b", "similarity"]).filter(pa.array(kept))

    return pairs.join(side("a"), "a").join(side("b"), "b").select(F.least("a_key", "b_key"), F.greatest("a_key", "b_key"), "a_items", "b_items").mapInArrow(run, "a bigint, b bigint, similarity double")


def similar_sets(chunks: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, min_words: int = MIN_WORDS) -> tuple[DataFrame, DataFrame]:
    """(members, links): members (key, chunk_id, doc_id) of each different set, and links (a, b, similarity) between sets.

    chunks: chunk_id, doc_id, text. Texts with fewer than min_words words, null and blank ones among
    them, belong to no set. Repeated rows are one member. Texts whose sets are equal share a key and
    are compared with others once, however many they are. Keys have 64 bits, items 40.
    """
    size = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    times = 2.0 ** np.ceil(np.log2(np.clip(size / BYTES / LOAD / SKETCH, 1, LARGEST / SKETCH)))
    kinds = written(_sets_and_sketch(chunks, words, min_words, times), "p2-sets", ["kind"])
    sets = kinds.where("kind = 0").select("id", "key", "chunk_id", "doc_id", "n", "items")
    sketch = summed(kinds.where("kind = 1"), np.int32)
    postings = int(sketch.sum(dtype=np.int64)) * (1 - threshold)
    bits = max(int(np.log2(ROUNDS * ROUND_RANGES)), int(np.ceil(np.log2(max(1.0, postings / RANGE_POSTINGS)))))
    pairs = []
    for turn in range(ROUNDS):
        pairs.append(written(met_pairs(prefix_postings(sets, sketch, 1 / ROUNDS, bits, threshold, turn), bits, threshold), "p2-pairs"))
        let_go(chunks.sparkSession)
    found = written(candidates(reduce(DataFrame.unionByName, pairs), bits), "p2-candidates")
    let_go(chunks.sparkSession)
    links = written(verified(sets, found, threshold), "p2-links")
    return sets.select("key", "chunk_id", "doc_id").distinct(), links


def near_duplicate_pairs(chunks: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(chunk_id_a, chunk_id_b) of all chunks of different documents that are near-duplicates; the smaller id first.

    Every pair is listed, those of equal sets too, as its definition asks; near_duplicate_groups() is
    the form that does not grow with the square of a group of copies.
    """
    members, links = similar_sets(chunks, threshold, words, min_words)
    side = lambda x: members.select(F.col("key").alias(x), F.col("chunk_id").alias(f"chunk_{x}"), F.col("doc_id").alias(f"doc_{x}"))
    between = links.select("a", "b").join(side("a"), "a").join(side("b"), "b")
    within = members.select("key", "chunk_id", "doc_id").withColumnsRenamed({"chunk_id": "chunk_a", "doc_id": "doc_a"}).join(members.withColumnsRenamed({"chunk_id": "chunk_b", "doc_id": "doc_b"}), "key").where("chunk_a < chunk_b")
    cols = ["chunk_a", "chunk_b", "doc_a", "doc_b"]
    every = between.select(*cols).unionByName(within.select(*cols)).where("doc_a <> doc_b")
    return every.select(F.least("chunk_a", "chunk_b").alias("chunk_id_a"), F.greatest("chunk_a", "chunk_b").alias("chunk_id_b")).distinct()


def classes(edges: DataFrame) -> DataFrame:
    """(key, class): the least key of each connected component of edges (a, b), a < b.

    Each round takes the least label among a node's neighbours, then that label's own label; rounds
    are written tables and end when no label changes.
    """
    both = written(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "p2-edges")
    labels = written(both.groupBy(F.col("a").alias("key")).agg(F.least(F.min("b"), F.first("a")).alias("class")), "p2-labels")
    while True:
        seen = both.join(labels.withColumnRenamed("key", "b"), "b").groupBy(F.col("a").alias("key")).agg(F.min("class").alias("other"))
        better = labels.join(seen, "key").select("key", F.col("class").alias("was"), F.least("class", "other").alias("via"))
        up = labels.select(F.col("key").alias("via"), F.col("class").alias("up"))
        moved = written(better.join(up, "via", "left").select("key", F.coalesce(F.least("via", "up"), "via").alias("class"), "was"), "p2-labels")
        labels = moved.select("key", "class")
        if moved.where("class <> was").isEmpty():
            return labels


def near_duplicate_groups(chunks: DataFrame, threshold: float = THRESHOLD, words: int = WORDS, min_words: int = MIN_WORDS) -> DataFrame:
    """(chunk_id, doc_id, class_id, n_links, n_copies): one row for each chunk that has a near-duplicate in another document.

    class_id is the least chunk_id of the class; n_links is the number of different sets that the chunk's
    own is linked to; n_copies is the number of other chunks with an equal set. Sets that occur in one
    and the same document only are not linked to each other.
    """
    members, links = similar_sets(chunks, threshold, words, min_words)
    sets = members.groupBy("key").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.count(F.lit(1)).alias("n"))
    side = lambda x: sets.select(F.col("key").alias(x), F.col("low").alias(f"low_{x}"), F.col("high").alias(f"high_{x}"))
    across = links.join(side("a"), "a").join(side("b"), "b").where("not (low_a = high_a and low_b = high_b and low_a = low_b)").select("a", "b")
    across = written(across, "p2-across")
    degree = across.select("a").union(across.select("b")).groupBy(F.col("a").alias("key")).agg(F.count(F.lit(1)).alias("n_links"))
    labelled = sets.join(classes(across), "key", "left").join(degree, "key", "left").where("class is not null or low <> high")
    own = labelled.select("key", F.coalesce("class", "key").alias("class_id"), F.coalesce("n_links", F.lit(0).cast("bigint")).alias("n_links"), (F.col("n") - 1).alias("n_copies"))
    found = written(members.join(own, "key").select("chunk_id", "doc_id", "class_id", "n_links", "n_copies"), "p2-grouped")
    names = found.groupBy("class_id").agg(F.min("chunk_id").alias("name"))
    return found.join(names, "class_id").select("chunk_id", "doc_id", F.col("name").alias("class_id"), "n_links", "n_copies")
