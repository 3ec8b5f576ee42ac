"""Measures of retrieval quality and time, as plans over ranked lists."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusspark.functions.scalars import cosine
from corpusspark.operators.order import placed

#: Bars of the gates on overlap, and seconds a reranked candidate costs.
DENSE_BAR, SPARSE_BAR, RERANK_SECONDS = 0.70, 0.60, 0.27


def vector_parity(pairs: DataFrame) -> DataFrame:
    """(n, min_cosine, mean_cosine, p5_cosine) of paired vectors a and b."""
    c = F.round(cosine(F.col("a"), F.col("b")), 9)
    return pairs.select(c.alias("c")).agg(F.count(F.lit(1)).alias("n"), F.round(F.min("c"), 6).alias("min_cosine"), F.round(F.avg("c"), 6).alias("mean_cosine"), F.round(F.percentile("c", F.lit(0.05)), 6).alias("p5_cosine"))


def set_parity(pairs: DataFrame) -> DataFrame:
    """(n, mean_jaccard) of paired arrays a and b; two empty ones are alike."""
    union = F.size(F.array_union("a", "b"))
    j = F.when(union == 0, 1.0).otherwise(F.size(F.array_intersect("a", "b")) / union)
    return pairs.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(j), 6).alias("mean_jaccard"))


def weight_parity(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """(n, mean_pearson): correlation of the weights of shared tokens by text, where two share and neither side is constant."""
    both = a.alias("a").join(b.alias("b"), [key, "token"]).groupBy(key).agg(F.count(F.lit(1)).alias("shared"), F.covar_pop("a.weight", "b.weight").alias("c"), F.stddev_pop("a.weight").alias("sa"), F.stddev_pop("b.weight").alias("sb"))
    varied = (F.col("shared") >= 2) & (F.col("sa") > 1e-12) & (F.col("sb") > 1e-12)
    kept = both.select(F.when(varied, F.col("c") / F.greatest(F.col("sa") * F.col("sb"), F.lit(1e-300))).alias("r")).where("r is not null")
    return kept.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("r"), 6).alias("mean_pearson"))


def overlap_at(ref: DataFrame, cand: DataFrame, probe: str, item: str, k: int, bar: float = DENSE_BAR) -> DataFrame:
    """(probes, mean_overlap, verdict): what share of the k first of ref cand has too, over all probes of ref."""
    both = ref.where(F.col("rank") <= k).select(probe, item, F.lit(1).alias("r")).join(cand.where(F.col("rank") <= k).select(probe, item, F.lit(1).alias("c")), [probe, item], "left")
    by = both.groupBy(probe).agg((F.count("c") / k).alias("o"))
    return by.agg(F.count(F.lit(1)).alias("probes"), F.round(F.avg("o"), 6).alias("mean_overlap")).withColumn("verdict", F.when(F.col("mean_overlap") >= bar, "PASS").otherwise("WARN"))


def self_matches(ranked: DataFrame, probe: str, item: str) -> DataFrame:
    """(probes, hits): probes that come first in their own list."""
    first = ranked.where("rank = 1")
    return first.agg(F.count(F.lit(1)).alias("probes"), F.count_if(F.col(probe) == F.col(item)).alias("hits"))


def latency(samples: DataFrame, stage: str, ms: str) -> DataFrame:
    """(stage, n, min, median, mean, p95, max): the median is the middle or the mean of two, p95 the nearest rank."""
    at = placed(samples.where(F.col(ms).isNotNull()).select(stage, ms), [stage], [ms], "i")
    ranked = at.withColumn("i", F.col("i") + 1).withColumnRenamed("_n", "n")
    at = lambda i: F.max(F.when(F.col("i") == i, F.col(ms)))
    n = F.col("n")
    return ranked.groupBy(stage, "n").agg(
        F.round(F.min(ms), 6).alias("min"), F.round((at(F.floor((n + 1) / 2)) + at(F.floor(n / 2) + 1)) / 2, 6).alias("median"), F.round(F.avg(ms), 6).alias("mean"), F.round(at(F.ceil(n * 0.95)), 6).alias("p95"), F.round(F.max(ms), 6).alias("max")
    )


def recall_by_depth(deep: DataFrame, sizes: list[int], k: int, top: int = 3) -> DataFrame:
    """(top_n, queries, same_top, min_jaccard, mean_jaccard, lossless, lost_positives, queries_with_loss).

    deep: query_id, chunk_id, pos, score of one deep retrieval; the answer for top_n is the k best by
    score of the first top_n, ties in the order of pos. Each is compared with the deepest's.
    """
    grid = F.explode(F.array(*[F.lit(s) for s in sizes]))
    cut = deep.withColumn("top_n", grid).where(F.col("pos") <= F.col("top_n"))
    w = Window.partitionBy("top_n", "query_id").orderBy(F.col("score").desc(), "pos")
    best = cut.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    ids = best.groupBy("top_n", "query_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("r", "chunk_id"))), lambda x: x.chunk_id).alias("ids"), F.transform(F.array_sort(F.collect_list(F.when(F.col("score") > 0, F.struct("r", "chunk_id")))), lambda x: x.chunk_id).alias("positive")
    )  # at most k ids a query
    base = ids.where(F.col("top_n") == max(sizes)).select("query_id", F.col("ids").alias("base"), F.col("positive").alias("base_positive"))
    both = ids.join(base, "query_id").select(
        "top_n",
        (F.slice("ids", 1, top) == F.slice("base", 1, top)).alias("same"),
        (F.size(F.array_intersect("ids", "base")) / F.size(F.array_union("ids", "base"))).alias("j"),
        F.size(F.array_except("base", "ids")).alias("missing"),
        F.size(F.array_except("base_positive", "ids")).alias("lost"),
    )
    return both.groupBy(F.col("top_n").cast("bigint").alias("top_n")).agg(
        F.count(F.lit(1)).alias("queries"), F.count_if("same").alias("same_top"), F.round(F.min("j"), 6).alias("min_jaccard"), F.round(F.avg("j"), 6).alias("mean_jaccard"), F.count_if(F.col("missing") == 0).alias("lossless"), F.sum("lost").alias("lost_positives"), F.count_if(F.col("lost") > 0).alias("queries_with_loss")
    )


def gold_ranks(gold: DataFrame, channel: DataFrame, depth: int) -> DataFrame:
    """(query_id, chunk_id, rank) of each gold answer in a channel; depth + 1 where it is not."""
    return gold.join(channel.select("query_id", "chunk_id", "rank"), ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", F.coalesce("rank", F.lit(depth + 1)).alias("rank"))


def channel_diagnosis(ranks: DataFrame, depth: int) -> DataFrame:
    """(channel, gold, upper_median, worst_hit, within_10, misses) of gold_ranks() rows with their channel."""
    w = Window.partitionBy("channel").orderBy("rank")
    at = ranks.withColumn("i", F.row_number().over(w) - 1).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("channel")))
    return at.groupBy("channel").agg(
        F.count(F.lit(1)).alias("gold"), F.max(F.when(F.col("i") == F.floor(F.col("n") / 2), F.col("rank"))).cast("bigint").alias("upper_median"), F.coalesce(F.max(F.when(F.col("rank") <= depth, F.col("rank"))), F.lit(0)).cast("bigint").alias("worst_hit"), F.count_if(F.col("rank") <= 10).alias("within_10"), F.count_if(F.col("rank") > depth).alias("misses")
    )


def coverage(pools: DataFrame, gold: DataFrame, strategies: list[str]) -> DataFrame:
    """(strategy, full_cover, missed, max_pool, seconds): whether pools (strategy, query_id, chunk_id) hold all gold.

    Each strategy is held against every query of gold, those for which its pool is empty too.
    """
    asked = gold.select("query_id", "chunk_id", F.explode(F.array(*[F.lit(s) for s in strategies])).alias("strategy"))
    held = asked.join(pools.select("strategy", "query_id", "chunk_id", F.lit(1).alias("hit")).distinct(), ["strategy", "query_id", "chunk_id"], "left")
    by = held.groupBy("strategy", "query_id").agg((F.count(F.lit(1)) - F.count("hit")).alias("missed"))
    size = pools.groupBy("strategy", "query_id").agg(F.count(F.lit(1)).alias("n")).groupBy("strategy").agg(F.max("n").alias("max_pool"))
    return by.groupBy("strategy").agg(F.count_if(F.col("missed") == 0).alias("full_cover"), F.sum("missed").alias("missed")).join(size, "strategy", "left").withColumn("max_pool", F.coalesce("max_pool", F.lit(0).cast("bigint"))).withColumn("seconds", F.round(F.col("max_pool") * RERANK_SECONDS, 6))
