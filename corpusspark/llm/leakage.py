"""Evaluation texts in training texts: latent semantic retrieval of passages, then checks of the words.

Passages of documents are windows of `span` consecutive words. For verbatim leaks all words must occur
in evaluation passages; for paraphrases so many as a paraphrase has in common with its passage, and
the other words stand for one unknown term without weight. A window that cannot be either is read but
not kept. Windows are TF-IDF vectors over the evaluation vocabulary, with document frequencies of all
documents, and are compared in the space of a randomised SVD of windows. There, the items' windows are in
lists around centres, and a document's window is compared with the lists whose centres are nearest. Equal windows
have equal vectors and so the same nearest centres: no verbatim run of `span` words can be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusspark.llm.columns import sliced, summed
from corpusspark.llm.words import words_of
from corpusspark.tables import written

SPAN = 10
#: Dimensions of the latent space, and more for the random projection; rounds of power iteration.
RANK, EXTRA, ROUNDS = 64, 16, 1
#: Cosine in the latent space from which a window is a candidate.
COSINE = 0.8
#: Windows of evaluation items handled at once (some 80 MB to each worker); more are handled slice by slice of the items.
WINDOWS_AT_ONCE = 1 << 18
#: Windows of documents, chosen by hash, that the SVD is made of, besides all those of the items.
FITTED = 200_000
#: Windows of items in one list of the index, and lists that a window is compared with. Fewer than so many lists are all searched.
LIST, PROBES = 128, 16
#: A paraphrase has so many words of the passage's window in the same order, and so many of its rarest three.
LEAST_COMMON, LEAST_ANSWERS = 7, 2
#: Windows of documents that a worker compares at once; bounds its memory, not its result.
AT_ONCE = 4096
#: Fixed: the random projection is the same in every run.
SEED = 20240304


@dataclass
class Evaluation:
    """Evaluation passages as windows of vocabulary ids; small, as evaluation sets are."""

    vocabulary: dict[str, int]
    windows: np.ndarray
    items: np.ndarray

    @staticmethod
    def of(rows: list, span: int) -> Evaluation:
        vocabulary: dict[str, int] = {}
        windows, items = [], []
        for item, passage in rows:
            w = [vocabulary.setdefault(x, len(vocabulary)) for x in words_of(passage or "")]
            for i in range(len(w) - span + 1):
                windows.append(w[i : i + span])
                items.append(item)
        return Evaluation(vocabulary, np.array(windows, np.int32).reshape(-1, span), np.array(items, np.int64))


def _runs_and_frequencies(docs: DataFrame, vocabulary: dict[str, int], span: int, known: int) -> DataFrame:
    """Kind 0: (doc_id, run) of the words of windows that have so many known words of span, unknown ones as the vocabulary's size; kind 1: each task's document frequencies, with the number of documents last."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)
    schema = pa.schema([("kind", pa.int32()), ("doc_id", pa.int64()), ("run", pa.list_(pa.int32())), ("slice", pa.int32()), ("part", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = shared.value.get
        n = len(shared.value)
        seen = np.zeros(n + 1, np.int64)
        for batch in batches:
            keys = batch.column(0)
            for at in range(0, batch.num_rows, 2000):
                texts = batch.column(1).slice(at, 2000).to_pylist()
                ids = [np.array([get(w, -1) for w in words_of(t)], np.int32) if t else np.zeros(0, np.int32) for t in texts]
                lens = np.array([len(x) for x in ids])
                seen[n] += int((lens > 0).sum())
                # a stop after each text keeps runs apart
                flat = np.concatenate([y for x in ids for y in (x, np.array([-2], np.int32))])
                row = np.repeat(np.arange(len(ids)), lens + 1)
                own = flat >= 0
                terms = np.unique(row[own].astype(np.int64) * n + flat[own]) % max(n, 1)
                seen[:n] += np.bincount(terms, minlength=n)[:n]
                at_span = lambda x: (c := np.concatenate([[0], np.cumsum(x)]))[span:] - c[:-span]
                fits = np.flatnonzero((at_span(own) >= known) & (at_span(flat == -2) == 0)) if len(flat) >= span else np.zeros(0, np.int64)
                inside = np.cumsum(np.bincount(fits, minlength=len(flat) + 1) - np.bincount(fits + span, minlength=len(flat) + 1))[:-1] > 0
                edge = np.diff(np.concatenate([[0], inside.astype(np.int8), [0]]))
                start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                if len(start):
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(end - start)]).astype(np.int32)), pa.array(np.where(own, flat, n).astype(np.int32)[inside]))
                    none = lambda t: pa.nulls(len(start), t)  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(start), np.int32)), keys.slice(at, 2000).take(pa.array(row[start])), lists, none(pa.int32()), none(pa.binary())], schema=schema)
        parts = sliced(seen)
        none = lambda t: pa.nulls(len(parts), t)
        yield pa.RecordBatch.from_arrays([pa.array([1] * len(parts), pa.int32()), none(pa.int64()), none(pa.list_(pa.int32())), pa.array([i for i, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], schema=schema)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "kind int, doc_id bigint, run array<int>, slice int, part binary")


def _windows(lists: pa.Array, span: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, window) of every window of each run in a column of runs."""
    lens = np.diff(lists.offsets.to_numpy())
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    if not len(flat):
        return np.zeros(0, np.int64), np.zeros((0, span), np.int32)
    start = np.cumsum(lens) - lens
    counts = np.maximum(0, lens - span + 1)
    row = np.repeat(np.arange(len(lens)), counts)
    at = start[row] + np.arange(counts.sum()) - (np.cumsum(counts) - counts)[row]
    return row, flat[at[:, None] + np.arange(span)]


def _answers(windows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """The three rarest words of each window."""
    rarest = np.argsort(-idf[windows], axis=1, kind="stable")[:, :3]
    return np.take_along_axis(windows, rarest, axis=1)


def _screened(runs: DataFrame, evaluation: Evaluation, idf: np.ndarray, span: int, known: int) -> DataFrame:
    """(doc_id, run) of the single windows that have so many known words, and two rarest words of some item's window.

    A paraphrase needs both, and a verbatim window has both, so none is lost; it only spares comparisons.
    """
    n = len(evaluation.vocabulary)
    a = _answers(evaluation.windows, idf).astype(np.int64)
    pairs = np.unique(np.concatenate([np.minimum(a[:, i], a[:, j]) * n + np.maximum(a[:, i], a[:, j]) for i in range(a.shape[1]) for j in range(i)]))
    shared = runs.sparkSession.sparkContext.broadcast(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = shared.value
        mask = np.zeros(1 << 22, bool)  # most pairs are told apart without a search
        mask[pairs % len(mask)] = True
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                lists = batch.column(1).slice(at, 500)
                flat, lens = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64), np.diff(lists.offsets.to_numpy())
                row = np.repeat(np.arange(len(lens)), lens)
                own, held = flat < n, np.zeros(len(flat) + 1, np.int64)
                for d in range(span):  # a word and the d-th after it; d = 0 for a window in which a rare word comes twice
                    x, y = flat[: len(flat) - d], flat[d:]
                    code = np.minimum(x, y) * n + np.maximum(x, y)
                    hit = np.flatnonzero(own[: len(flat) - d] & own[d:] & mask[code % len(mask)])
                    hit = hit[pairs[np.minimum(np.searchsorted(pairs, code[hit]), len(pairs) - 1)] == code[hit]]
                    held += np.bincount(np.maximum(0, hit + d - span + 1), minlength=len(held)) - np.bincount(hit + 1, minlength=len(held))
                start = np.arange(len(flat) - span + 1)
                total = np.concatenate([[0], np.cumsum(own)])
                start = start[(row[start] == row[start + span - 1]) & (total[start + span] - total[start] >= known) & (np.cumsum(held)[start] > 0)]
                if len(start):
                    windows = flat[start[:, None] + np.arange(span)].astype(np.int32)
                    offsets = pa.array(np.arange(len(start) + 1, dtype=np.int32) * span)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500).take(pa.array(row[start])), pa.ListArray.from_arrays(offsets, pa.array(windows.reshape(-1)))], names=["doc_id", "run"])

    return written(runs.select("doc_id", "run").mapInArrow(run, "doc_id bigint, run array<int>"), "p7-windows")


def _norms(windows: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Lengths of the windows' TF-IDF vectors: a word that comes twice weighs twice in one dimension."""
    w = idf[windows]
    total = np.zeros(len(windows))
    for i in range(windows.shape[1]):
        for j in range(windows.shape[1]):
            total += (windows[:, i] == windows[:, j]) * w[:, i] * w[:, j]
    return np.sqrt(np.maximum(total, 1e-300))


def _projected(windows: np.ndarray, idf: np.ndarray, basis: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """The windows' unit TF-IDF vectors times basis; summed in one order, so equal windows agree to the bit."""
    weighted = idf[:, None] * basis
    out = np.zeros((len(windows), basis.shape[1]))
    for i in range(windows.shape[1]):
        out += weighted[windows[:, i]]
    return out / norms[:, None]


def _scattered(windows: np.ndarray, idf: np.ndarray, norms: np.ndarray, y: np.ndarray, terms: int) -> np.ndarray:
    """The transposed matrix of the windows' unit vectors, times y."""
    out = np.zeros((terms, y.shape[1]))
    for i in range(windows.shape[1]):
        w = windows[:, i]
        order = np.argsort(w, kind="stable")
        new = np.flatnonzero(np.concatenate([[True], w[order][1:] != w[order][:-1]]))
        out[w[order][new]] += np.add.reduceat((y * (idf[w] / norms)[:, None])[order], new, axis=0)
    return out


def sampled(runs: DataFrame, span: int, most: int = FITTED) -> DataFrame:
    """The runs whose hash is low enough that they have some `most` windows; all, if there are no more."""
    total = runs.agg(F.sum(F.size("run") - span + 1)).first()[0] or 0
    if total <= most:
        return runs.select("run")
    share = F.pmod(F.xxhash64("doc_id", "run"), F.lit(1 << 30)) < int(most / total * (1 << 30))
    return written(runs.where(share).select("run").coalesce(16), "p7-fitted")


def latent_basis(runs: DataFrame, evaluation: Evaluation, idf: np.ndarray, span: int, rank: int = RANK) -> np.ndarray:
    """Right singular vectors of the TF-IDF matrix of the runs' windows and all the items', by a randomised SVD.

    The matrix stays distributed: each pass multiplies a task's rows with a thin matrix and back, and
    sums the products over tasks. Only those, of the vocabulary's size times rank + EXTRA, reach the driver.
    """
    spark, terms = runs.sparkSession, len(idf)
    width = min(rank + EXTRA, terms)

    def gram(q: np.ndarray) -> np.ndarray:
        shared = spark.sparkContext.broadcast((idf, q))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            idf, q = shared.value
            total = np.zeros((terms, q.shape[1]))
            for batch in batches:
                _, w = _windows(batch.column(0), span)
                if len(w):
                    norms = _norms(w, idf)
                    total += _scattered(w, idf, norms, _projected(w, idf, q, norms), terms)
            parts = sliced(total.reshape(-1))
            yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names=["slice", "part"])

        found = summed(runs.select("run").mapInArrow(run, "slice int, part binary"), np.float64)
        own = _norms(evaluation.windows, idf)
        total = _scattered(evaluation.windows, idf, own, _projected(evaluation.windows, idf, q, own), terms)
        return total + (found.reshape(terms, q.shape[1]) if len(found) else 0)

    q = np.linalg.qr(np.random.default_rng(SEED).standard_normal((terms, width)))[0]
    for _ in range(1 + ROUNDS):
        q = np.linalg.qr(gram(q))[0]
    values, vectors = np.linalg.eigh(q.T @ gram(q))
    return q @ vectors[:, np.argsort(-values)[: min(rank, width)]]


def _common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths of the longest common subsequences of paired windows."""
    n, span = a.shape
    last = np.zeros((span + 1, n), np.int8)
    for i in range(span):
        now = np.zeros_like(last)
        for j in range(span):
            now[j + 1] = np.where(a[:, i] == b[:, j], last[j] + 1, np.maximum(last[j + 1], now[j]))
        last = now
    return last[span]


@dataclass
class Index:
    """Unit vectors in lists around centres; vectors are in the order of their lists."""

    centres: np.ndarray
    starts: np.ndarray
    order: np.ndarray
    vectors: np.ndarray

    @staticmethod
    def of(vectors: np.ndarray, size: int = LIST, rounds: int = 4) -> Index:
        """Every vector is in the list of its nearest centre; centres are fitted on 32 vectors each, evenly chosen."""
        n = max(1, len(vectors) // size)
        fitted = vectors[np.unique(np.linspace(0, len(vectors) - 1, min(len(vectors), 32 * n)).astype(np.int64))]
        centres = fitted[np.linspace(0, len(fitted) - 1, n).astype(np.int64)]
        for _ in range(rounds if n > 1 else 0):
            near = np.argmax(fitted @ centres.T, axis=1)
            total = np.zeros_like(centres)
            np.add.at(total, near, fitted)
            length = np.linalg.norm(total, axis=1, keepdims=True)
            centres = np.where(length > 1e-9, total / np.maximum(length, 1e-9), centres)
        near = np.concatenate([np.argmax(vectors[i : i + 8192] @ centres.T, axis=1) for i in range(0, len(vectors), 8192)])
        order = np.argsort(near, kind="stable")
        return Index(centres, np.searchsorted(near[order], np.arange(n + 1)), order, vectors[order])

    def search(self, x: np.ndarray, least: float, probes: int = PROBES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row of x, vector, cosine) from that cosine on, in the lists of each row's nearest centres."""
        found: list[tuple] = []
        near = x @ self.centres.T
        probes = min(probes, len(self.centres))
        lists = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < len(self.centres) else np.tile(np.arange(probes), (len(x), 1))
        rows = np.repeat(np.arange(len(x)), probes)
        by_list = np.argsort(lists.reshape(-1), kind="stable")
        edges = np.searchsorted(lists.reshape(-1)[by_list], np.arange(len(self.centres) + 1))
        for k in np.flatnonzero(np.diff(edges)):
            own = rows[by_list[edges[k] : edges[k + 1]]]
            a, e = self.starts[k], self.starts[k + 1]
            score = x[own] @ self.vectors[a:e].T
            i, j = np.nonzero(score >= least)
            found.append((own[i], self.order[a + j], score[i, j]))
        return tuple(np.concatenate(c) for c in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32))


def _unit(windows: np.ndarray, idf: np.ndarray, basis: np.ndarray) -> np.ndarray:
    """The windows' vectors in the latent space, of length 1."""
    x = _projected(windows, idf, basis, _norms(windows, idf))
    return (x / np.maximum(np.linalg.norm(x, axis=1), 1e-12)[:, None]).astype(np.float32)


def _search(runs: DataFrame, evaluation: Evaluation, idf: np.ndarray, basis: np.ndarray, span: int, cosine: float, probes: int = PROBES) -> DataFrame:
    """(doc_id, item_id, verbatim, near, common, answers, cosine, windows) of the best candidate windows of each document and item; near ones come first after verbatim ones."""
    # a window that several items or places share is in the index once
    own_windows, which = np.unique(evaluation.windows, axis=0, return_inverse=True)
    which = which.reshape(-1)
    index = Index.of(_unit(own_windows, idf, basis))
    pairs = np.unique(np.stack([which, evaluation.items], axis=1), axis=0)
    item_starts = np.searchsorted(pairs[:, 0], np.arange(len(own_windows) + 1))
    answers = _answers(own_windows, idf)
    shared = runs.sparkSession.sparkContext.broadcast((idf, basis, index, own_windows, item_starts, pairs[:, 1], answers))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        idf, basis, index, own, item_starts, items, answers = shared.value
        for batch in batches:
            row, w = _windows(batch.column(1), span)
            docs = batch.column(0).to_numpy(zero_copy_only=False)[row]
            for at in range(0, len(w), AT_ONCE):
                own_w = w[at : at + AT_ONCE]
                i, j, score = index.search(_unit(own_w, idf, basis), cosine, probes)
                if not len(i):
                    continue
                verbatim = (own_w[i] == own[j]).all(axis=1)
                common = _common(own_w[i], own[j])
                held = (answers[j][:, :, None] == own_w[i][:, None, :]).any(axis=2).sum(axis=1)
                near = (common >= LEAST_COMMON) & (held >= LEAST_ANSWERS)  # of one and the same window
                n = np.diff(item_starts)[j]
                spread = np.repeat(np.arange(len(i)), n)
                item = items[np.repeat(item_starts[j], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)]
                i, score, verbatim, common, held, near = (c[spread] for c in (i, score, verbatim, common, held, near))
                doc = docs[at + i]
                order = np.lexsort((score, held, common, near, verbatim, item, doc))
                last = np.flatnonzero(np.append((doc[order][1:] != doc[order][:-1]) | (item[order][1:] != item[order][:-1]), True))
                best = order[last]
                yield pa.RecordBatch.from_arrays([pa.array(doc[best]), pa.array(item[best]), pa.array(score[best].astype(np.float64)), pa.array(common[best].astype(np.int32)), pa.array(held[best].astype(np.int32)), pa.array(verbatim[best]), pa.array(near[best]), pa.array(np.diff(last, prepend=-1))], names=["doc_id", "item_id", "cosine", "common", "answers", "verbatim", "near", "windows"])

    pairs = runs.select("doc_id", "run").mapInArrow(run, "doc_id bigint, item_id bigint, cosine double, common int, answers int, verbatim boolean, near boolean, windows bigint")
    best = F.max(F.struct(F.col("verbatim"), F.col("near"), F.col("common"), F.col("answers"), F.col("cosine")))
    return pairs.groupBy("doc_id", "item_id").agg(best.alias("r"), F.sum("windows").alias("windows")).select("doc_id", "item_id", "r.*", "windows")


def leaks(docs: DataFrame, items: DataFrame, span: int = SPAN, cosine: float = COSINE, rank: int = RANK, at_once: int = WINDOWS_AT_ONCE, known: int | None = None) -> DataFrame:
    """(doc_id, item_id, verbatim, near, common, answers, cosine, windows): documents with windows like an item's.

    docs: doc_id, text; items: item_id, passage. verbatim: at least span consecutive words of the
    passage stand consecutively in the text. Otherwise common (words in common, in order) and answers
    (of the window's three rarest words) of the best window tell how near it comes; near: some window
    has LEAST_COMMON and LEAST_ANSWERS of them at once, and the best is the best of such windows. Null, empty and
    short texts and passages have no windows; passages that share a stretch are all named; repeated
    documents give one row. Items with more than at_once windows together are searched slice by slice, each over
    all documents. Every verbatim leak is found; of the others those in the lists searched, see Index.
    known: windows need so many words that any passage has, all span by default; if it is less, only
    windows with at least two rarest words of some passage's window are kept, as paraphrases have them.
    """
    words = F.size(F.regexp_extract_all(F.lower("passage"), F.lit(r"[\p{L}\p{N}]+"), F.lit(0)))
    total = items.where("item_id is not null").select("item_id", "passage").distinct().agg(F.sum(words)).first()[0] or 0
    slices = max(1, -(-total // at_once))
    found, known = None, span if known is None else known
    for k in range(slices):
        part = items.where(F.col("item_id").isNotNull() & (F.pmod(F.xxhash64("item_id"), F.lit(slices)) == k))
        rows = sorted(((r[0], r[1] or "") for r in part.select(F.col("item_id").cast("bigint"), "passage").distinct().collect()))
        evaluation = Evaluation.of(rows, span)
        if not len(evaluation.windows):
            continue
        kinds = written(_runs_and_frequencies(docs, evaluation.vocabulary, span, known), "p7-runs", ["kind"])
        runs = kinds.where("kind = 0 and doc_id is not null").select("doc_id", "run")
        seen = summed(kinds.where("kind = 1"), np.int64)
        if not len(seen):  # no documents
            continue
        idf = np.log((1.0 + seen[-1]) / (1.0 + seen[:-1])) + 1.0
        if known < span:
            runs = _screened(runs, evaluation, idf, span, known)
            idf = np.append(idf, 0.0)  # the unknown term
        one = _search(runs, evaluation, idf, latent_basis(sampled(runs, span), evaluation, idf, span, rank), span, cosine)
        found = one if found is None else found.unionByName(one)
    empty = "doc_id bigint, item_id bigint, verbatim boolean, near boolean, common int, answers int, cosine double, windows bigint"
    cols = ["doc_id", "item_id", "verbatim", "near", "common", "answers", "cosine", "windows"]
    return docs.sparkSession.createDataFrame([], empty) if found is None else found.select(*cols)


def verbatim_leaks(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, item_id) of texts with span consecutive words of a passage."""
    return leaks(docs, items, span).where("verbatim").select("doc_id", "item_id")


def paraphrases(docs: DataFrame, items: DataFrame, span: int = SPAN) -> DataFrame:
    """(doc_id, item_id, common, answers) of texts with most words of a window in order, its rare words among them, but none verbatim."""
    return leaks(docs, items, span, known=LEAST_COMMON).where("near and not verbatim").select("doc_id", "item_id", "common", "answers")
