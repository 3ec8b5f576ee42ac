"""Cutting documents into chunks: heading trails, packing by tokens."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corpusspark.functions.scalars import chunk_id, is_blank, section_path, tokens

MAX_TOKENS = 400


def lines(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs' subject and doc_id with line_no and line, one row a line; null texts have none."""
    return docs.select("subject", "doc_id", F.posexplode(F.split(text, "\r\n|\r|\n")).alias("line_no", "line"))


def _trail(w) -> Column:
    """The headings in force at a line, outermost first: of each level the last, if no higher one came after it."""
    at = lambda k: F.last(F.when(F.col("level") == k, F.struct("line_no", "title")), ignorenulls=True).over(w)
    shown, above = [], F.lit(-1)
    for k in range(1, 7):
        shown.append(F.when(at(k).line_no > above, at(k).title))
        above = F.greatest(above, F.coalesce(at(k).line_no, F.lit(-1)))
    return F.filter(F.array(*shown), lambda t: t.isNotNull())


def sections(docs: DataFrame) -> DataFrame:
    """lines() with the Markdown heading trail of each; headings themselves, and those in code fences, are told apart.

    The frame is a document's lines: a document is the unit that must fit in a task, and spills if long.
    """
    w = Window.partitionBy("subject", "doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    fence = F.col("line").rlike(r"^\s{0,3}(```|~~~)").cast("int")
    head = lines(docs).withColumn("fences", F.sum(fence).over(w)).withColumn("marks", F.when(F.col("fences") % 2 == 0, F.regexp_extract("line", r"^(#{1,6})\s+\S", 1)).otherwise(""))
    titled = head.withColumn("level", F.length("marks")).withColumn("title", F.trim(F.regexp_replace("line", r"^#{1,6}\s+|\s+#*\s*$", "")))
    return titled.withColumn("trail", _trail(w)).select("subject", "doc_id", "line_no", "line", (F.col("level") > 0).alias("is_heading"), section_path(F.col("trail")).alias("section"))


def packed(rows: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(subject, doc_id, section, pack, n_tokens, text): lines of a section packed into chunks by their running tokens.

    A pack takes the lines whose running count before them falls in one stretch of max_tokens. A line of
    more tokens than that is cut at words first, so no pack has more than twice max_tokens less one.
    """
    words = F.filter(F.split("line", r"(?<=\s)(?=\S)"), lambda x: x != "")
    slices = F.when(F.size(tokens(F.col("line"))) <= max_tokens, F.array("line")).otherwise(
        F.transform(F.sequence(F.lit(0), F.floor((F.size(words) - 1) / max_tokens).cast("int")), lambda i: F.array_join(F.slice(words, i * max_tokens + 1, max_tokens), ""))
    )
    parts = rows.select("subject", "doc_id", "section", "line_no", F.posexplode(slices).alias("part", "line")).withColumn("n", F.size(tokens(F.col("line"))))
    w = Window.partitionBy("subject", "doc_id", "section").orderBy("line_no", "part")
    before = F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return (
        parts.withColumn("pack", F.floor(before / max_tokens))
        .groupBy("subject", "doc_id", "section", "pack")
        .agg(F.sum("n").alias("n_tokens"), F.min(F.struct("line_no", "part")).alias("first"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "part", "line"))), lambda x: x.line), "\n").alias("text"))
    )


def chunked(docs: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(subject, doc_id, chunk_index, chunk_id, section_path, n_tokens, text) of Markdown documents.

    Chunks keep to their section and come in the order of the document. chunk_index counts blank chunks,
    which are then dropped, so its gaps are legal. Documents without text have no chunks.
    """
    place = F.row_number().over(Window.partitionBy("subject", "doc_id").orderBy("first")) - 1
    found = packed(sections(docs).where(~F.col("is_heading")), max_tokens).withColumn("chunk_index", place)
    return found.where(~is_blank(F.col("text"))).select("subject", "doc_id", "chunk_index", chunk_id(F.col("doc_id"), F.col("chunk_index")).alias("chunk_id"), F.col("section").alias("section_path"), "n_tokens", F.regexp_replace("text", r"^(\s*\n)+|\s+$", "").alias("text"))


def line_packs(docs: DataFrame, key: str, text: str, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """(key, pack, n_lines, n_tokens): the packing alone, of whole lines, without sections."""
    rows = docs.select(key, F.posexplode(F.split(text, "\n")).alias("line_no", "line")).withColumn("n", F.size(tokens(F.col("line"))))
    before = F.sum("n").over(Window.partitionBy(key).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    return rows.withColumn("pack", F.floor(before / max_tokens)).groupBy(key, "pack").agg(F.count(F.lit(1)).alias("n_lines"), F.sum("n").alias("n_tokens"))
