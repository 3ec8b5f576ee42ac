"""Dependency graphs: resolving names, closures, what closures have in common."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusspark.functions.scalars import without_version
from corpusspark.tables import written


def symbols(bundles: DataFrame) -> DataFrame:
    """(symbol, file): which file a name stands for.

    bundles: file, sym. Of several files with one symbolic name the last by file name counts. Files
    without one go by their name, and by their name without its version, unless that is a symbolic name;
    of several the first counts.
    """
    own = bundles.where("coalesce(sym, '') <> ''").groupBy(F.col("sym").alias("symbol")).agg(F.max("file").alias("file")).withColumn("rank", F.lit(0))
    stem = F.regexp_replace("file", r"\.[^.]*$", "")
    alias = bundles.where("coalesce(sym, '') = ''").select("file", F.explode(F.array_distinct(F.array(without_version(stem), stem))).alias("symbol"))
    alias = alias.groupBy("symbol").agg(F.min("file").alias("file")).withColumn("rank", F.lit(1))
    return own.unionByName(alias).groupBy("symbol").agg(F.min_by("file", "rank").alias("file"))


def edges(bundles: DataFrame) -> DataFrame:
    """(src, symbol, dst): what each file requires; dst is null where nothing stands for the symbol. bundles: file, sym, req."""
    need = bundles.select(F.col("file").alias("src"), F.explode("req").alias("symbol")).distinct()
    return need.join(symbols(bundles), "symbol", "left").select("src", "symbol", F.col("file").alias("dst"))


def closure(graph: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(src, dst) of everything src leads to, by any number of steps; src itself if it lies on a cycle.

    graph: src, dst. Each round joins what the last one found first with all that is known, so known
    paths double in length and rounds grow with the logarithm of the longest path. With starts, where
    most pairs are not asked for, a round adds one step instead. A round's pairs are a written table;
    a round that finds nothing new is the last, so cycles do no harm.
    """
    step = written(graph.where("src is not null and dst is not null").select("src", "dst").distinct(), "edges")
    fresh = step if starts is None else step.join(starts.select("src").distinct(), "src", "left_semi")
    known = fresh = written(fresh, "closure")
    then = lambda a, b: a.alias("a").join(b.alias("b"), F.col("a.dst") == F.col("b.src")).select("a.src", "b.dst")
    while not fresh.isEmpty():
        grown = then(fresh, step) if starts is not None else then(fresh, known).union(then(known, fresh))
        fresh = written(grown.distinct().join(known, ["src", "dst"], "left_anti"), "closure")
        known = known.union(fresh)
    return known


def common(closures: DataFrame, starts: DataFrame) -> DataFrame:
    """(dst) that every start leads to. starts: src."""
    n = starts.select("src").distinct().count()
    return closures.join(starts.select("src").distinct(), "src", "left_semi").groupBy("dst").agg(F.count_distinct("src").alias("n")).where(F.col("n") == n).select("dst")


def extra(closures: DataFrame, shared: DataFrame) -> DataFrame:
    """(src, dst) without what is common and without src itself."""
    return closures.join(shared, "dst", "left_anti").where("src <> dst").select("src", "dst")


def last_of(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value) of the last row of each key."""
    return rows.groupBy(key).agg(F.max_by(value, order).alias(value))


def first_of(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The first row of each key, by order."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
