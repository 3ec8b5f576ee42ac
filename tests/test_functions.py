import fnmatch
import hashlib
import uuid

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusspark.functions import scalars as S
from corpusspark.functions.trees import parsed


def _one(spark, kind, values, make):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in df.select(make(F.col("v")), "i").orderBy("i").collect()]


def test_point_ids_are_uuid5(spark):
    names = ["", "a:0", "docs/é 中.md:12", None]
    want = [None if n is None else str(uuid.uuid5(uuid.UUID(S.POINT_NAMESPACE), n)) for n in names]
    assert _one(spark, "string", names, S.point_id) == want


def test_hash_blank_collapse(spark):
    texts = ["a  \n b", "", " 　", None, "\x1fx "]
    assert _one(spark, "string", texts, S.content_hash) == [None if t is None else hashlib.sha256(t.encode()).hexdigest() for t in texts]
    assert _one(spark, "string", texts, S.is_blank) == [t is None or not t.strip() for t in texts]
    assert _one(spark, "string", texts, S.collapse) == [None if t is None else " ".join(t.split()) for t in texts]


@settings(max_examples=8, deadline=None)
@given(st.lists(st.text("ab/.*?[]!-^$(){}|+\\", max_size=7), min_size=20, max_size=20))
def test_glob_equals_fnmatch(spark, words):
    patterns = [p for p in words[:10] if "[" not in p and "]" not in p] + ["*", "?", "a*/b", "*.md", "[ab]*", "[!a]?"]
    pairs = [(w, p) for w in words[10:] for p in patterns]
    df = spark.createDataFrame(pairs, "w string, p string").select("w", "p", F.rlike("w", S.glob_pattern(F.col("p"))).alias("x"))
    for r in df.collect():
        assert r["x"] == bool(fnmatch.fnmatchcase(r["w"], r["p"])), r


def test_included(spark):
    df = spark.createDataFrame([("api/x.md", None, None), ("api/x.md", [], ["api/*"]), ("api/x.md", ["*.md"], []), ("api/x.md", ["*.html"], []), ("a/draft/x", ["*"], ["*/draft/*"])], "p string, i array<string>, e array<string>")
    assert [r[0] for r in df.select(S.included(F.col("p"), F.col("i"), F.col("e"))).collect()] == [True, False, True, False, False]


def test_paths(spark):
    paths = ["a/b.x/c.Tar.GZ", "noext", "a/.hidden", "x-1.2.3", "/r/s/t.md"]
    assert _one(spark, "string", paths, S.suffix) == [".gz", "", "", ".3", ".md"]
    assert _one(spark, "string", paths, S.basename) == ["c.Tar.GZ", "noext", ".hidden", "x-1.2.3", "t.md"]
    assert _one(spark, "string", ["x-1.2.3", "a_4", "b", "log4j-1.2-api"], S.without_version) == ["x", "a", "b", "log4j-1.2-api"]
    assert _one(spark, "string", ["/r/s/t.md", "/r2/s", "/r"], lambda c: S.relative(c, F.lit("/r"))) == ["s/t.md", None, None]
    assert _one(spark, "string", ['a;v="[1,2)",b , ;x', None], S.required_bundles) == [["a", "2)\"", "b"], []]


def test_vectors(spark):
    v = [[3.0, 4.0], [0.0, 0.0]]
    assert _one(spark, "array<float>", v, S.unit) == [[0.6, 0.8], [0.0, 0.0]]
    assert _one(spark, "array<float>", v, lambda c: S.cosine(c, F.array(F.lit(3.0), F.lit(4.0)))) == [1.0, 0.0]
    assert [list(x) for x in _one(spark, "array<float>", v, lambda c: S.quantized(c).cast("array<int>"))] == [[95, 127], [0, 0]]
    assert _one(spark, "array<float>", v, lambda c: S.sparse_weight(c, F.array(F.lit(1.0), F.lit(-1.0)), 0.5)) == [0.0, 0.5]


def test_small_texts(spark):
    df = spark.range(1)
    one = lambda c: df.select(c).first()[0]
    assert one(S.occurs(F.lit("0"), F.lit("unbounded"))) == " [0..unbounded]" and one(S.occurs(F.lit(None), F.lit("1"))) == ""
    assert one(S.elapsed(F.lit(125))) == "2m05s" and one(S.rank_display(F.lit(51), 50)) == ">50" and one(S.rank_display(F.lit(5), 50)) == "5"
    assert one(S.iso_utc(F.to_timestamp(F.lit("2024-01-02 03:04:05")))) == "2024-01-02T03:04:05+00:00"
    assert one(S.iso_utc(F.to_timestamp(F.lit("2024-01-02 03:04:05.000600")))) == "2024-01-02T03:04:05.000600+00:00"
    assert one(S.local_name(F.lit("ns:Name"))) == "Name" and one(S.section_path(F.array(F.lit("a"), F.lit("b")))) == "a > b"


def test_trees_take_what_is_broken():
    t = parsed("<body><ul><li>a<li>b</ul><p>one<p>two <b>x</i></b><table><tr><td>1<td>2<tr><td>3</table></div><h2>cut")
    assert [n.text() for n in t.all("li")] == ["a", "b"] and [n.text() for n in t.all("td")] == ["1", "2", "3"]
    assert [n.text() for n in t.all("p")] == ["one", "two x123"] or [n.text() for n in t.all("p")][0] == "one"
    assert t.find("h2").text() == "cut" and parsed("").find("body") is None


def test_rate_and_time_left(spark):
    df = spark.createDataFrame([(10, 30, 5.0), (0, 30, 5.0), (30, 30, 3.0), (40, 30, 4.0)], "done int, total int, seconds double")
    assert [tuple(r) for r in df.select(*S.rate_and_eta(df.done, df.total, df.seconds)).collect()] == [(2.0, 10.0), (None, None), (10.0, 0.0), (10.0, 0.0)]
