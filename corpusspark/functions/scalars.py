"""Scalar functions as column expressions; none leaves the JVM."""

from __future__ import annotations

import fnmatch

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the name space of point ids.
POINT_NAMESPACE = "6f9619ff-8b86-d011-b42d-00c04fc964ff"
SNIPPET_CHARS = 320
WHITE = r"[\s\p{Z}\x1c-\x1f\x85]"


def content_hash(c: Column) -> Column:
    """SHA-256 of a text or bytes, in lower-case hex."""
    return F.sha2(c.cast("binary"), 256)


def point_id(c: Column, namespace: str = POINT_NAMESPACE) -> Column:
    """The name-based UUID, version 5, of a string in a name space; null stays null."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(c, "UTF-8")))
    variant = F.lower(F.hex((F.conv(F.substring(h, 17, 1), 16, 10).cast("int").bitwiseAND(3)).bitwiseOR(8)))
    part = lambda a, n: F.substring(h, a, n)
    return F.when(c.isNotNull(), F.concat_ws("-", part(1, 8), part(9, 4), F.concat(F.lit("5"), part(14, 3)), F.concat(variant, part(18, 3)), part(21, 12)))


def chunk_id(doc_id: Column, index: Column) -> Column:
    return F.concat(doc_id, F.lit(":"), index.cast("string"))


def section_path(headings: Column) -> Column:
    return F.array_join(headings, " > ")


def collapse(c: Column) -> Column:
    """Runs of white space, no-break spaces among them, as one space; none at the ends."""
    return F.trim(F.regexp_replace(c, f"{WHITE}+", " "))


def is_blank(c: Column) -> Column:
    """Null, empty or white space alone, in the sense of Unicode."""
    return c.isNull() | ~c.rlike(f"[^{WHITE[1:]}")


def glob(c: Column, pattern: str) -> Column:
    """Whether a path matches a shell pattern, in which * also spans slashes."""
    return c.rlike(_java(fnmatch.translate(pattern)))


def _java(translated: str) -> str:
    body = translated.removesuffix(r"\Z").removesuffix(r"\z")
    return f"^{body}$" if body.startswith("(?s:") else body


def glob_pattern(c: Column) -> Column:
    """A regular expression of a shell pattern that is itself a column; [...] sets keep their meaning."""
    quoted = F.regexp_replace(c, r"([.+^$(){}|\\])", r"\\$1")
    return F.concat(F.lit("^(?s)"), F.replace(F.replace(F.replace(quoted, F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit("[!"), F.lit("[^")), F.lit("$"))


def included(path: Column, include: Column, exclude: Column) -> Column:
    """Whether path is let through: it matches one of include, if there are any, and none of exclude.

    include and exclude: arrays of shell patterns; null arrays count as empty.
    """
    hits = lambda patterns: F.exists(F.coalesce(patterns, F.array().cast("array<string>")), lambda p: F.rlike(path, glob_pattern(p)))
    return ((F.coalesce(F.size(include), F.lit(0)) <= 0) | hits(include)) & ~hits(exclude)


def snippet(c: Column) -> Column:
    return F.substring(c, 1, SNIPPET_CHARS)


def suffix(path: Column) -> Column:
    """The last suffix of the file name in lower case, with its dot; empty if there is none."""
    return F.lower(F.regexp_extract(path, r"[^/.][^/]*?(\.[^./]+)$", 1))


def basename(path: Column) -> Column:
    return F.regexp_replace(path, "^.*/", "")


def with_suffix(path: Column, new: str) -> Column:
    return F.concat(F.regexp_replace(path, r"\.[^./]*$", ""), F.lit(new))


def relative(path: Column, root: Column) -> Column:
    return F.when(F.startswith(path, F.concat(root, F.lit("/"))), F.substr(path, F.length(root) + 2))


def without_version(name: Column) -> Column:
    return F.regexp_replace(name, r"[-_]\d[\d.]*$", "")


def local_name(qname: Column) -> Column:
    return F.substring_index(qname, ":", -1)


def occurs(low: Column, high: Column) -> Column:
    """` [low..high]`, or nothing for exactly one."""
    low, high = F.coalesce(low, F.lit("1")), F.coalesce(high, F.lit("1"))
    return F.when((low == "1") & (high == "1"), "").otherwise(F.concat(F.lit(" ["), low, F.lit(".."), high, F.lit("]")))


def required_bundles(header: Column) -> Column:
    """Names in a requirement header; every comma parts entries, those in quotes too, and attributes are dropped."""
    names = F.transform(F.split(F.coalesce(header, F.lit("")), ","), lambda e: F.trim(F.substring_index(e, ";", 1)))
    return F.filter(names, lambda n: n != "")


def iso_utc(ts: Column) -> Column:
    """ISO 8601 with offset, without a fraction if it is zero. The session's zone must be UTC."""
    whole = F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss")
    micros = F.date_format(ts, "SSSSSS")
    return F.concat(whole, F.when(micros == "000000", "").otherwise(F.concat(F.lit("."), micros)), F.lit("+00:00"))


def elapsed(seconds: Column) -> Column:
    s = seconds.cast("bigint")
    return F.format_string("%dm%02ds", F.floor(s / 60), s % 60)


def stats_line(subject: Column, new: Column, changed: Column, deleted: Column, unchanged: Column, chunks: Column) -> Column:
    return F.format_string("[%s] new=%d changed=%d deleted=%d unchanged=%d chunks_embedded=%d", subject, new, changed, deleted, unchanged, chunks)


def rank_display(rank: Column, depth: int) -> Column:
    return F.when(rank.isNull() | (rank > depth), f">{depth}").otherwise(rank.cast("string"))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays as it is."""
    n = norm(a)
    return F.transform(a, lambda x: x.cast("double") / F.when(n == 0, 1.0).otherwise(n))


def cosine(a: Column, b: Column) -> Column:
    """Dot product of the unit vectors; 0 if one of them is zero."""
    return dot(a, b) / (F.when(norm(a) == 0, 1.0).otherwise(norm(a)) * F.when(norm(b) == 0, 1.0).otherwise(norm(b)))


def sparse_weight(hidden: Column, weights: Column, bias: float) -> Column:
    """A token's weight: the part of its linear head that is positive."""
    return F.greatest(F.lit(0.0), dot(hidden, weights) + F.lit(bias))


def quantized(a: Column) -> Column:
    """Eight-bit codes of a vector, scaled by its largest absolute value."""
    top = F.aggregate(a, F.lit(0.0), lambda s, x: F.greatest(s, F.abs(x.cast("double"))))
    return F.transform(a, lambda x: F.round(x.cast("double") * 127 / F.when(top == 0, 1.0).otherwise(top)).cast("tinyint"))


def tokens(text: Column) -> Column:
    """Runs of letters or digits in lower case; an empty list for null."""
    return F.coalesce(F.regexp_extract_all(F.lower(text), F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), F.array().cast("array<string>"))


def bucket(token: Column, buckets: int) -> Column:
    """A token's hash bucket, the same in every system that has MD5."""
    return F.conv(F.substring(F.md5(token.cast("binary")), 1, 8), 16, 10).cast("bigint") % buckets


def rate_and_eta(done: Column, total: Column, seconds: Column) -> tuple[Column, Column]:
    """(rows a second, seconds that are left); both null before anything is done."""
    rate = F.when((done > 0) & (seconds > 0), F.round(done / seconds, 6))
    return rate, F.round(F.greatest(total - done, F.lit(0)) / rate, 6)
