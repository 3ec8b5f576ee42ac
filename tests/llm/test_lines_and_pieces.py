"""Repeated lines and splitting, against brute force."""

import random
import re
from collections import defaultdict

import pytest

from corpusspark.llm import repeated_lines, splitting
from corpusspark.tables import written
from tests.conftest import rows

CHUNK = "chunk_id string, doc_id string, subject string, section_path string, text string, staged_at timestamp, k1 string, line_no int"


def _frame(spark, data):
    return spark.createDataFrame([(c, d, s, None, t, None, "clash", 1) for c, d, s, t in data], CHUNK)


def _key(line):
    s = "".join(c if c.isalpha() else " " for c in line.lower())
    return "".join(s.split()) if len(s.split()) >= 3 else None


def _brute(data, least):
    docs, own = defaultdict(set), set()
    for c, d, s, t in data:
        for i, line in enumerate((t or "").split("\n") if t is not None else []):
            if k := _key(line):
                docs[s, k].add(d)
                own.add((c, i, s, k))
    return sorted({(c, i) for c, i, s, k in own if len(docs[s, k] - {None}) >= least}, key=str)


def _lines(seed):
    r = random.Random(seed)
    pool = ["Share this page now!", "SHARE this-page, now?", "all rights are reserved", "two words", "", "¡Äpfel und Öl für 5!", "a b c", "İ ß ﬁ x"]
    data = []
    for i in range(120):
        text = "\n".join(r.choice(pool) if r.random() < 0.7 else f"own line {'x' * i} q{'y' * r.randrange(9)}" for _ in range(r.randrange(0, 6)))
        data.append((f"c{i}", r.choice([None, f"d{i % 40}"]), r.choice(["s", "t", None]), r.choice([text, text, text, None, "", " \n "])))
    return data + data[:20]


@pytest.mark.parametrize("seed", [1, 2])
def test_repeated_lines_equal_brute_force(spark, seed):
    data = _lines(seed)
    found = sorted((tuple(r) for r in repeated_lines.repeated_lines(_frame(spark, data), 3).collect()), key=str)
    assert found == _brute(data, 3) and len(found) > 20


def test_hot_line_and_empty_table(spark):
    hot = [(f"c{i}", f"d{i}", "s", "the same line everywhere\nunique words number " + "z" * i) for i in range(50)]
    assert rows(repeated_lines.repeated_lines(_frame(spark, hot))) == sorted((f"c{i}", 0) for i in range(50))
    assert repeated_lines.repeated_lines(_frame(spark, [])).count() == 0


def test_sequences_grow(spark):
    block = "first of the block\n\nsecond of the block\nno\nthird of the block"  # blank and short lines part nothing
    data = [(f"c{i}", f"d{i}", "s", f"own words {'x' * i} here\n{block}") for i in range(6)] + [("p", "p", "s", "second of the block\nthird of the block")]
    found = repeated_lines.frequent_sequences(_frame(spark, data))
    assert sorted((r.length, r.n_docs) for r in found.select("length", "k1", "k2", "n_docs").distinct().collect()) == [(1, 6), (1, 7), (1, 7), (2, 6), (2, 7)]
    assert {(r.first_line, r.last_line) for r in found.where("length = 2 and chunk_id = 'c1'").collect()} == {(1, 3), (3, 5)}
    clean = {r.chunk_id: r.text for r in repeated_lines.without_repeated_lines(_frame(spark, data)).collect()}
    assert clean["p"] == "" and clean["c2"] == "own words xx here\n\nno"


def test_sequences_of_every_length_equal_brute_force(spark):
    r = random.Random(6)
    pool = [[f"line {chr(97 + i)}{chr(97 + j)} of it" for j in range(n)] for i, n in enumerate((1, 3, 5, 6, 7, 11))]
    data = []
    for i in range(60):
        own = [x for _ in range(r.randrange(1, 4)) for x in r.choice(pool)[r.choice([0, 0, 1]) :]]
        data.append((f"c{i}", r.choice([None, f"d{i % 25}"]), r.choice(["s", "t", None]), "\n\n".join(own)))
    docs, places = defaultdict(set), defaultdict(set)
    for c, d, s, t in data:
        at = [(k, x) for k, x in enumerate(t.split("\n")) if _key(x)]
        for i in range(len(at)):
            for j in range(i, len(at)):
                q = s, tuple(_key(x) for _, x in at[i : j + 1])
                docs[q] |= {d} - {None}
                places[q].add((j - i + 1, c, at[i][0], at[j][0]))
    want = sorted((n, len(docs[q]), c, a, b) for q, own in places.items() if len(docs[q]) >= 3 for n, c, a, b in own)
    found = repeated_lines.frequent_sequences(_frame(spark, data + data[:9]), 3, every=True)
    assert sorted((x.length, x.n_docs, x.chunk_id, x.first_line, x.last_line) for x in found.collect()) == want
    assert {n for n, *_ in want} >= {1, 2, 3, 4, 5, 6, 7, 11}
    assert found.select("length", "k1", "k2").distinct().count() == sum(len(x) >= 3 for x in docs.values())


def test_a_long_notice_takes_few_levels(spark, monkeypatch):
    notice = "\n\n".join(f"line {chr(97 + i // 26)}{chr(97 + i % 26)} of the notice" for i in range(500))
    data = [(f"c{i}", f"d{i}", "s", f"own words {'x' * i} here\n{notice}\nmore own words {'y' * i}") for i in range(6)]
    tables = []
    monkeypatch.setattr(repeated_lines, "written", lambda df, tag: tables.append(tag) or written(df, tag))
    found = repeated_lines.frequent_sequences(_frame(spark, data))
    assert {r.length: r["count"] for r in found.groupBy("length").count().collect()} == {2**k: 6 * (501 - 2**k) for k in range(9)}
    assert tables.count("p1-grown") == 9
    assert rows(repeated_lines.repeated_lines(_frame(spark, data))) == sorted(((f"c{i}", 1 + 2 * k) for i in range(6) for k in range(500)), key=lambda t: tuple(map(str, t)))


@pytest.mark.parametrize("seed", [1, 2])
@pytest.mark.parametrize("most", [10**6, 0])
def test_clean_equals_brute_force(spark, seed, most):
    data = _lines(seed)
    gone = set(_brute(data, 3))
    want = sorted(((c, None if t is None else "\n".join(x for i, x in enumerate(t.split("\n")) if (c, i) not in gone)) for c, _, _, t in data), key=str)
    got = repeated_lines.without_repeated_lines(_frame(spark, data), 3, broadcast_lines=most)
    assert got.columns == _frame(spark, data).columns
    assert sorted(((r.chunk_id, r.text) for r in got.collect()), key=str) == want


def test_clean_keeps_rows_columns_and_nulls(spark):
    data = [("a", "d", "s", None), ("b", "d", "s", ""), ("c", "d", "s", "x\n\ny"), ("c", "d", "s", "x\n\ny")]
    df = _frame(spark, data)
    found = repeated_lines.without_repeated_lines(df)
    assert found.columns == df.columns and rows(found, "chunk_id", "text") == [("a", None), ("b", ""), ("c", "x\n\ny"), ("c", "x\n\ny")]


# --- splitting


def _texts():
    r = random.Random(4)
    prose = lambda n: "".join(r.choice(["word ", "longer word. ", "line\n", "para\n\n", "crlf\r\n", "é", "👩‍🔬", "; ", "。", "x" * r.randrange(40)]) for _ in range(n))
    return [prose(900), prose(3000), "x" * 5000, "é" * 2001, "a" * 2000, "ab " * 1500, "\n" * 4500, prose(200) + "y" * 6000 + prose(300), "👩‍🔬" * 1500]


def _check(text, pieces, limit, overlap):
    assert pieces[0][0] == 0 and pieces[-1][1] == len(text)
    for i, (s, e) in enumerate(pieces):
        assert 0 < e - s <= limit
        if i:
            assert pieces[i - 1][1] - overlap <= s <= pieces[i - 1][1] < e
        natural = [m.end() for k in splitting.BOUNDARIES for m in k.finditer(text) if (pieces[i - 1][1] if i else 0) < m.end() <= s + limit]
        if e < len(text) and e not in natural:
            assert not natural or max(natural) <= (pieces[i - 1][1] if i else 0), "a hard cut beside a natural boundary"


@pytest.mark.parametrize("text", _texts())
def test_one_range_cuts_at_boundaries(text):
    _check(text, splitting.cut_range(text, 0, len(text), False, True), 2000, 200)


def test_ranges_give_whole_pieces(spark):
    data = [(f"c{i}", "d", "s", t) for i, t in enumerate(_texts())] + [("short", "d", "s", "x" * 2000), ("null", "d", "s", None), (None, "d", "s", "n " * 1500), (None, "d", "s", "m " * 1500)]
    df = _frame(spark, [*data, data[0]])
    for size in (1000, 4096, 65536):
        found = defaultdict(list)
        for r in splitting.split_chunks(df, size=size).orderBy("chunk_index").collect():
            found[r.chunk_id if r.chunk_id else r.text[0]].append(r)
        assert set(found) == {f"c{i}" for i, t in enumerate(_texts()) if len(t) > 2000} | {"n", "m"}
        for i, t in enumerate(_texts()):
            if len(t) > 2000:
                own = found[f"c{i}"]
                assert [r.chunk_index for r in own] == list(range(len(own))) and all(t[r.start : r.end] == r.text for r in own)
                places = [(r.start, r.end) for r in own]
                assert places[0][0] == 0 and places[-1][1] == len(t) and all(e - s <= 2000 for s, e in places) and all(b - 200 <= c <= b < d for (_, b), (c, d) in zip(places, places[1:]))
    assert splitting.split_chunks(df.limit(0)).count() == 0


def test_files_are_cut_as_texts_are(spark, tmp_path):
    texts = {f"{i}.txt": t for i, t in enumerate(_texts()[:3])}
    for n, t in texts.items():
        (tmp_path / n).write_bytes(t.encode())
    files = [(f"{tmp_path}/{n}", (tmp_path / n).stat().st_size) for n in texts]
    found = defaultdict(list)
    for r in splitting.split_files(spark, files, size=3000).orderBy("piece_no").collect():
        found[r.item.rpartition("/")[2]].append(r)
    for n, t in texts.items():
        own = found[n]
        assert all(t[r.start : r.end] == r.piece for r in own) and own[0].start == 0 and own[-1].end == len(t)
        assert all(len(r.piece) <= 2000 for r in own) and all(a.end - 200 <= b.start <= a.end for a, b in zip(own, own[1:]))
    assert re.sub(r"\s", "", "".join(r.piece for r in found["2.txt"]))  # a text without any boundary too


def test_one_long_text_is_cut_in_linear_time(spark):
    import time

    line = "The reader opens the key store, reads one page of it and closes it again. Ünïcödé 漢字 too.\n"
    took = []
    for n in (1, 8):
        text = line * (n * 20_000)
        t = time.time()
        found = splitting.split_chunks(_frame(spark, [("c", "d", "s", text)])).select("chunk_index", "start", "end").orderBy("chunk_index").collect()
        took.append(time.time() - t)
        assert found[0].start == 0 and found[-1].end == len(text) and [r.chunk_index for r in found] == list(range(len(found)))
        assert all(a.end - 200 <= b.start <= a.end < b.end and b.end - b.start <= 2000 for a, b in zip(found, found[1:]))
    assert took[1] < 16 * max(took[0], 1)
