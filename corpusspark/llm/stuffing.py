"""Keyword-stuffed and link-list pages, found by their rank-frequency curves.

The words of a page, ordered by frequency, fall on a curve that is much alike for prose of one
language and length. Repeated keywords bend it down, tag lists flatten it, link lists lift its head,
and none of them has the language's common words where prose has them. Each page's curve is fitted with
windows over its frequency classes, and the curve's share in common with the language's prose is
measured; pages with extreme slope, residual or divergence from prose peers are candidates. Of these the
ones stay whose divergence shows that two thirds are no sentences. No kind of list is named anywhere; lines
can only take a page out, if they are code, tables, configuration, contracts or encoded data.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusspark.llm.columns import sliced, spread, summed
from corpusspark.tables import written

#: Share of the characters that makes a page a list.
SHARE = 2 / 3
#: Of the prose peers' mean share of common words, what a list has at most: a third where the rest is sentences, and more by chance.
LEFT = 0.5
#: Distances from the peers' mean, in standard deviations, that are extreme: of a slope either way, of
#: a residual upwards, of a share of common words downwards. The last one's is that by chance in so many words,
#: so that no page is called a list that is too short to be told from prose.
EXTREME = {"slope": 2.0, "residual": 2.0, "divergence": 2.0}
#: A group of fewer peers is too thin; pages are then measured against a wider one. Languages with fewer
#: pages of prose count as one language together.
LEAST_PEERS = 30
#: Counters of a language's words by hash, and how many of the greatest are its common words. Words that
#: fall together blur a counter by some 1e-5, where common words have 1e-3 and more.
COUNTERS, COMMON = 1 << 14, 64
#: Sentence ends per word from which a text can be prose: one in so many words.
SENTENCE = 40
#: Words; in scripts without spaces each character is one.
_TERM = re.compile(r"[぀-ヿ㐀-鿿฀-๿]|[^\W_぀-ヿ㐀-鿿฀-๿]+")
_END = re.compile(r"[.!?…؟]+[\"')\]]*(?=\s|$)|[。！？।]")
#: Lines that are neither sentences nor lists: tables, code, settings, markup and contracts, encoded data.
_TABLE = re.compile(r"\s*\|.*\|\s*$|\s*[|+:=-]{3,}[\s|+:=-]*$|(?:[^\t]+\t){2,}")
_CODE = re.compile(r"\s*(?:def|class|return|public|private|protected|static|package|if|for|while|else|try|catch|var|let|const)\b.*[({:;=]\s*$|\s*(?:import|from|package|using|namespace)\s+[\w.*]+\s*$|\s*[@}\])]|\s{2,}\S.*[(=]|\s*(?://|/\*|\*/)|\s*`[^`]+`\s*$|.*\b\w+\([^)]*\)\s*(?:[;{:]|=>)")
_SETTING = re.compile(r"\s*(?:- )?[\w.-]+\s*(?:[:=]\s*(?![^\s]*//)(?:[^\s,;|#]+\s?){0,3}$)|\s*\[[\w. -]+\]\s*$|\s*</?(?![aA]\b)[A-Za-z][^>]*>|\s*[-*] \w[\w ]*: ?`")
_MARKED = re.compile(r"[:=<\[({`@})\]/]|^\s*(?:import|from|package|using|namespace)\s")
_BLOB = re.compile(r"[\w+/=-]+")
_FENCE = re.compile(r"\s*(?:```|~~~)")
_FEATURES = "doc_id bigint, key bigint, lang string, n_words int, freqs array<int>, counts array<int>, spots array<int>, shares array<float>, prose boolean, other_share double"
_PAGE = ["doc_id", "key", "language", "length", "n_words", "overlap", "prose", "other_share"]


def sentence_ends(text: str) -> int:
    """How many sentences end in text: marks after a word, not after a number or a single letter."""
    n = 0
    for m in _END.finditer(text):
        at = m.start()
        n += m.group() in "。！？।" or at > 1 and (text[at - 1].isalpha() or text[at - 1] in ")\"'`" or text[at - 2 : at].isdigit()) and not text[at - 2].isspace()
    return n


def _is_blob(token: str) -> bool:
    """Whether a run of characters without space is encoded data, or one or two characters over and over."""
    return len(token) >= 16 and (len(set(token)) <= 2 or len(token) >= 40 and _BLOB.fullmatch(token) is not None and (len(token) >= 60 or any(c.isdigit() for c in token)))


def is_other_line(line: str) -> bool:
    """Whether a line is code, part of a table, configuration, a contract or encoded data: neither a sentence nor a list."""
    if line.rstrip().endswith((";", "{", "}")) or _TABLE.match(line) or _MARKED.search(line) and (_SETTING.match(line) or _CODE.match(line)):
        return True
    tokens = line.split()
    if len(tokens) >= 16 and all(len(t) == 2 for t in tokens):  # bytes in hexadecimal digits
        return True
    return 2 * sum(len(t) for t in tokens if len(t) >= 16 and _is_blob(t)) >= sum(map(len, tokens)) > 0


def other_share(text: str) -> float:
    """The share of the text's characters in lines that are code, tables, configuration, contracts or encoded data, code fences included."""
    total, inside, fenced, last = 0, 0, False, False
    for line in text.split("\n"):
        if _FENCE.match(line):
            fenced, last = not fenced, True
        elif line.strip():
            last = fenced or is_other_line(line)
        total += len(line) + 1
        inside += (len(line) + 1) * last
    return inside / total if total else 0.0


class _Spots(dict):
    def __missing__(self, term: str) -> int:
        import xxhash

        if len(self) > 300_000:
            self.clear()
        v = self[term] = xxhash.xxh64_intdigest(term) % COUNTERS
        return v


_spots = _Spots()


def page_features(docs: DataFrame) -> DataFrame:
    """(doc_id, key, lang, n_words, freqs, counts, spots, shares, prose, other_share): the words of each page by frequency.

    counts[i] words come freqs[i] times each; frequencies descend. spots are the counters of the page's
    words, shares what part of all words falls on each. prose: it has sentence ends as prose has, and is
    mostly no code or the like. lang: two letters of the column, where there is one, else nothing. key is
    the same for equal texts. Texts that are null or have no word are left out: they have no curve.
    """
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float32()), pa.bool_(), pa.float64()]
    names = [f.split()[0] for f in _FEATURES.split(", ")]
    code = F.regexp_extract(F.lower("lang"), r"^\s*([a-z]{2})(?![a-z])", 1) if "lang" in docs.columns else F.lit("")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for doc, key, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                terms = _TERM.findall(text.lower()) if text else []
                if not terms:
                    continue
                often = Counter(terms)
                classes = sorted(Counter(often.values()).items(), reverse=True)
                spots: dict[int, int] = {}
                for w, n in often.items():
                    s = _spots[w]
                    spots[s] = spots.get(s, 0) + n
                other = other_share(text)
                prose = other < 0.5 and sentence_ends(text) * SENTENCE >= len(terms)
                rows.append((doc, key, lang or "", len(terms), [f for f, _ in classes], [n for _, n in classes], list(spots), [n / len(terms) for n in spots.values()], prose, other))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    return spread(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.xxhash64("text").alias("key"), code.alias("lang"), "text")).mapInArrow(run, _FEATURES)


def language_models(features: DataFrame) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(languages, n, sums): how many texts of prose each language has, and the sums of their words' shares by counter.

    A text counts once in each part of the written features, however many copies there are, and as much as any
    other, however long: a group of copies weighs no more than a page for each task. Languages with fewer
    than LEAST_PEERS texts are one language, "". One array of fixed size for each language reaches the
    driver; codes have two letters.
    """
    langs = sorted({"", *(r[0] for r in features.select("lang").distinct().collect())})
    at = {x: i for i, x in enumerate(langs)}
    width = COUNTERS + 1  # the last counter is the number of texts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((len(langs), width)), np.zeros(0, np.int64)
        for batch in batches:
            keys, first = np.unique(batch.column(0).to_numpy(), return_index=True)
            first = np.sort(first[~np.isin(keys, seen)])
            seen = np.union1d(seen, keys)
            batch = batch.take(pa.array(first))
            own = np.array([at[x] for x in batch.column(1).to_pylist()], np.int64)
            lens = np.diff(batch.column(2).offsets.to_numpy())
            place = np.repeat(own, lens) * width + batch.column(2).flatten().to_numpy()
            total += np.bincount(place, batch.column(3).flatten().to_numpy(), total.size).reshape(total.shape)
            total[:, -1] += np.bincount(own, minlength=len(langs))
        parts = sliced(total.reshape(-1))
        yield pa.RecordBatch.from_arrays([pa.array([i for i, _ in parts], pa.int32()), pa.array([b for _, b in parts], pa.binary())], names=["slice", "part"])

    found = summed(features.where("prose").select("key", "lang", "spots", "shares").mapInArrow(run, "slice int, part binary"), np.float64)
    found = found.reshape(len(langs), width) if len(found) else np.zeros((len(langs), width))
    thin = np.array([x == "" or n < LEAST_PEERS for x, n in zip(langs, found[:, -1], strict=True)])
    found = np.concatenate([found[thin].sum(axis=0, keepdims=True), found[~thin]])
    return ["", *(x for x, t in zip(langs, thin, strict=True) if not t)], found[:, -1], found[:, :-1]


def measured(features: DataFrame) -> DataFrame:
    """features with overlap, the share of its words that a page has in common with a language's prose, and that language.

    Of a language its COMMON greatest counters count, each with the lesser of the page's share and
    the language's. The language is the one with which the page has most in common, as the column lang is
    often wrong. A text that is itself among the language's prose is taken out of it first.
    """
    known, n, sums = language_models(features)
    tops = np.argsort(-sums, axis=1, kind="stable")[:, :COMMON]
    common = np.zeros_like(sums)
    np.put_along_axis(common, tops, np.take_along_axis(sums, tops, 1), 1)
    shared = features.sparkSession.sparkContext.broadcast((known, n, common))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, n, common = shared.value
        at = {x: i for i, x in enumerate(known)}
        for whole in batches:
            for i in range(0, whole.num_rows, 1000):
                batch = whole.slice(i, 1000)
                spots, shares = batch.column("spots"), batch.column("shares").flatten().to_numpy()
                lens = np.diff(spots.offsets.to_numpy())
                flat, starts = spots.flatten().to_numpy(), np.cumsum(lens) - lens
                own = np.array([at.get(x, at[""]) for x in batch.column("lang").to_pylist()])
                inside = batch.column("prose").to_numpy(zero_copy_only=False)
                best, which = np.zeros(batch.num_rows), own.copy()
                for k in range(len(known)):
                    out = np.repeat((own == k) & inside, lens)
                    p = common[k][flat]
                    p = np.where(p > 0, np.maximum(0, p - out * shares), 0) / np.maximum(1, n[k] - out)
                    overlap = np.add.reduceat(np.minimum(p, shares), starts)
                    which, best = np.where(overlap > best, k, which), np.maximum(best, overlap)
                cols = {c: batch.column(c) for c in batch.schema.names if c not in ("spots", "shares", "lang")}
                yield pa.RecordBatch.from_pydict(cols | {"overlap": pa.array(best), "language": pa.array([known[k] for k in which])})

    kinds = {f.name: f.dataType.simpleString() for f in features.schema if f.name not in ("spots", "shares", "lang")}
    return features.mapInArrow(run, ", ".join(f"{c} {t}" for c, t in kinds.items()) + ", overlap double, language string")


def curves(features: DataFrame) -> DataFrame:
    """(doc_id, key, language, length, n_words, overlap, prose, other_share, slope, residual) of each page.

    slope and residual: of the least-squares line of log frequency on log rank, every word with its
    rank, words of one frequency class at the class's mean rank. length: the octave of the number of words.
    overlap and language: see measured().
    """
    by_rank = Window.partitionBy("doc_id", "key").orderBy(F.col("freq").desc()).rowsBetween(Window.unboundedPreceding, 0)
    pages = measured(features).withColumn("length", F.floor(F.log2("n_words")).cast("int"))
    classes = (
        pages.select(*_PAGE, F.explode(F.arrays_zip("freqs", "counts")).alias("c"))
        .select(*_PAGE, F.col("c.freqs").cast("double").alias("freq"), F.col("c.counts").cast("double").alias("n"))
        .distinct()  # repeated rows
        .withColumn("top", F.sum("n").over(by_rank))
        .withColumn("x", F.log(F.col("top") - (F.col("n") - 1) / 2))
        .withColumn("y", F.log("freq"))
    )
    n, x, y = F.col("n"), F.col("x"), F.col("y")
    return (
        classes.groupBy("doc_id", "key", *[c for c in _PAGE if c not in ("doc_id", "key")])
        .agg(*[F.sum(c).alias(name) for name, c in (("n", n), ("sx", n * x), ("sy", n * y), ("sxx", n * x * x), ("sxy", n * x * y), ("syy", n * y * y))])
        .withColumn("vx", F.col("sxx") - F.col("sx") ** 2 / F.col("n"))
        .withColumn("cxy", F.col("sxy") - F.col("sx") * F.col("sy") / F.col("n"))
        .withColumn("slope", F.when(F.col("vx") > 1e-9, F.col("cxy") / F.col("vx")).otherwise(0.0))
        .withColumn("residual", F.sqrt(F.greatest(F.lit(0.0), F.col("syy") - F.col("sy") ** 2 / F.col("n") - F.col("slope") * F.col("cxy")) / F.col("n")))
        .select(*_PAGE, "slope", "residual")
    )


def peer_groups(sizes: dict[tuple[str, int], int], wanted: list[tuple[str, int]]) -> list[tuple]:
    """(language, length, peer_language, peer_length): the groups of prose that each group of pages is measured against.

    sizes: different texts of prose by language and octave of length. The narrowest that has LEAST_PEERS
    together: the group itself, its language within one, two and more octaves, all languages within so many
    octaves; else all prose there is.
    """
    rows = []
    for language, length in wanted:
        far = max((abs(b - length) for _, b in sizes), default=0)
        within = lambda d, own: [(a, b) for a, b in sizes if abs(b - length) <= d and (a == language or not own)]  # noqa: E731, B023
        steps = (g for own in (True, False) for d in range(far + 1) for g in [within(d, own)] if sum(sizes[x] for x in g) >= LEAST_PEERS)
        rows += [(language, length, *x) for x in next(steps, list(sizes))]
    return rows


def extreme(pages: DataFrame, sd: dict[str, float] = EXTREME) -> DataFrame:
    """The pages whose slope, residual or divergence is far from their prose peers', with the reasons.

    Adds peer_overlap, the peers' mean overlap, divergence (1 less the page's share of it), and
    far_slope, far_residual, far_divergence. Peers are the different texts of prose of the same language
    and octave of length, or of more where these are few (peer_groups()). Peers are gathered as sums by
    group; only those, as many as there are languages and octaves, reach the driver. Without any prose there is no
    measure and every page is far.
    """
    cols = {"slope": F.col("slope"), "residual": F.col("residual"), "overlap": F.col("overlap")}
    prose = pages.where("prose").select("key", "language", "length", *cols).dropDuplicates(["key"])
    sums = [F.sum(x).alias(f"{p}_{c}") for c, v in cols.items() for p, x in (("t", v), ("q", v**2))]
    own = {(r["language"], r["length"]): r for r in prose.groupBy("language", "length").agg(F.count(F.lit(1)).alias("n"), *sums).collect()}
    wanted = [(r[0], r[1]) for r in pages.select("language", "length").distinct().collect()]
    table = []
    groups: dict[tuple, list] = {}
    for language, length, a, b in peer_groups({k: r["n"] for k, r in own.items()}, wanted):
        groups.setdefault((language, length), []).append(own[a, b])
    for (language, length), rows in groups.items():
        n = sum(r["n"] for r in rows)
        stats = []
        for c in cols:
            mean = sum(r[f"t_{c}"] for r in rows) / n
            stats += [mean, max(0.0, sum(r[f"q_{c}"] for r in rows) / n - mean**2) ** 0.5]
        table.append((language, length, *stats))
    peers = pages.sparkSession.createDataFrame(table, "language string, length int, " + ", ".join(f"m_{c} double, s_{c} double" for c in cols))
    found = pages.join(F.broadcast(peers), ["language", "length"], "left")
    off = lambda c: F.col(c) - F.col(f"m_{c}")
    chance = F.sqrt(F.col("m_overlap") * (1 - F.col("m_overlap")) / F.col("n_words"))
    far = {"slope": F.abs(off("slope")) >= sd["slope"] * F.col("s_slope"), "residual": off("residual") >= sd["residual"] * F.col("s_residual"), "divergence": -off("overlap") >= sd["divergence"] * chance}
    none = F.col("m_overlap").isNull()
    divergence = F.when(F.col("m_overlap") > 0, 1 - F.col("overlap") / F.col("m_overlap")).otherwise(1.0)
    found = found.select(*pages.columns, F.col("m_overlap").alias("peer_overlap"), divergence.alias("divergence"), *[(none | c).alias(f"far_{name}") for name, c in far.items()])
    return found.where("far_slope or far_residual or far_divergence")


def stuffed_pages(docs: DataFrame, share: float = SHARE, left: float = LEFT, sd: dict[str, float] = EXTREME) -> DataFrame:
    """(doc_id, language, length, n_words, slope, residual, divergence, other_share, far_...): pages that are lists instead of sentences.

    docs: doc_id, text, and lang if there is one; whole texts are read, other columns are not. Null, empty
    and blank texts are never such pages. Repeated rows with one doc_id count as one page if their texts
    are equal. Pages too short to be told from prose of their length are none; neither is a page of
    which more than 1 - share is code, tables, configuration, contracts or encoded data. Without any prose to
    measure against, every page that is not code or the like is a list.
    """
    return lists(measured_pages(docs, sd), share, left).drop("key", "overlap", "peer_overlap", "prose").distinct()


def measured_pages(docs: DataFrame, sd: dict[str, float] = EXTREME) -> DataFrame:
    """The extreme pages of docs; see extreme() and stuffed_pages()."""
    features = written(page_features(docs), "p8-pages")
    return extreme(curves(features), sd)


def lists(pages: DataFrame, share: float = SHARE, left: float = LEFT) -> DataFrame:
    """The extreme pages that are lists."""
    return pages.where(F.col("far_divergence") & (F.col("divergence") >= 1 - left) & (F.col("other_share") <= 1 - share))
