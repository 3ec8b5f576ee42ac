"""Keeping a target in step with a tagged source: selection, mirrors, orphans, tags."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusspark.operators.sync import inserted


def tagged(tags: DataFrame, mapping: DataFrame, files: DataFrame, mimes: DataFrame, names: list[str], folders: bool | None = None) -> DataFrame:
    """(path, mimetype) of the objects with one of the tags.

    tags: id, name; mapping: objectid (a number as text), systemtagid; files: fileid, path, mimetype;
    mimes: id, mimetype. folders: True for folders alone, False for files alone. Object ids that are no
    numbers are left out.
    """
    ids = tags.where(F.col("name").isin(names)).select(F.col("id").alias("systemtagid"))
    objects = mapping.join(ids, "systemtagid", "left_semi").select(F.expr("try_cast(objectid as bigint)").alias("fileid")).where("fileid is not null").distinct()
    found = files.join(objects, "fileid", "left_semi").select("path", F.col("mimetype").alias("id")).join(mimes, "id").select("path", "mimetype")
    is_folder = F.col("mimetype") == "httpd/unix-directory"
    return found if folders is None else found.where(is_folder if folders else ~is_folder)


def ancestors(path):
    """The path's folders, each a path without its slash at the end, and the path itself."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))


def orphans(target: DataFrame, wanted: DataFrame) -> DataFrame:
    """Paths of target that are not in wanted and lie under no folder of it.

    Each path is taken apart into its folders, so that an equality join finds prefixes: `api` keeps
    `api/x` and not `api2/x`.
    """
    keep = wanted.select(F.col("path").alias("up")).distinct()
    kept = target.select("path", F.explode(ancestors(F.col("path"))).alias("up")).join(keep, "up", "left_semi").select("path").distinct()
    return target.join(kept, "path", "left_anti").select("path").distinct()


def mirror(source: DataFrame, target: DataFrame, delete: bool = False) -> DataFrame:
    """(path, action) that bring target in step with source: `copy`, and `delete` if asked for. Both: path, content_hash."""
    s, t = source.select("path", F.col("content_hash").alias("s"), F.lit(1).alias("in_s")), target.select("path", F.col("content_hash").alias("t"), F.lit(1).alias("in_t"))
    action = F.when(F.col("in_s").isNull(), "delete").when(F.col("in_t").isNull() | ~F.col("s").eqNullSafe(F.col("t")), "copy")
    found = s.join(t, "path", "full_outer").select("path", action.alias("action")).where("action is not null")
    return found if delete else found.where("action = 'copy'")


def flipped(mapping: DataFrame, old: int, new: int) -> DataFrame:
    """mapping with tag `old` taken from every object that had it and `new` given to it, once."""
    moved = mapping.where(F.col("systemtagid") == old).withColumn("systemtagid", F.lit(new).cast(mapping.schema["systemtagid"].dataType))
    return inserted(mapping, moved, ["objectid", "objecttype", "systemtagid"]).where(F.col("systemtagid") != old)


def tag_id(tags: DataFrame, name: str) -> int | None:
    """The id of the tag of that name, the least if there are several, or None."""
    found = tags.where(F.col("name") == name).select("id").orderBy("id").limit(1).collect()
    return found[0][0] if found else None


def tag_counts(tags: DataFrame, mapping: DataFrame) -> DataFrame:
    """(name, objects) of every tag, those without objects too; an object counts once for a tag."""
    n = mapping.select("systemtagid", "objectid", "objecttype").distinct().groupBy(F.col("systemtagid").alias("id")).agg(F.count(F.lit(1)).alias("objects"))
    return tags.join(n, "id", "left").groupBy("name").agg(F.coalesce(F.sum("objects"), F.lit(0)).cast("bigint").alias("objects"))


def orphan_counts(target: DataFrame, wanted: DataFrame) -> DataFrame:
    """(paths, kept, orphans): one row."""
    found = target.select("path").distinct().join(orphans(target, wanted).withColumn("gone", F.lit(1)), "path", "left")
    return found.agg(F.count(F.lit(1)).alias("paths"), F.count_if(F.col("gone").isNull()).alias("kept"), F.count_if(F.col("gone").isNotNull()).alias("orphans"))
