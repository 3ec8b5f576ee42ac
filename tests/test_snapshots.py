"""Changes between snapshots and incremental runs, against brute force."""

import datetime as dt
import random

import pytest

from corpusspark.operators.snapshots import Snapshots, snapshot_changes
from corpusspark.operators.versions import Conflict, History, IncrementalRun, run_changes
from corpusspark.tables import put_file
from tests.conftest import rows

DOCS = "snap_no int, subject string, doc_id string, content_hash string, loaded_at timestamp, digest_a string, bucket string"
RUNS = "run_id bigint, subject string, snap_no int, started_at timestamp, status string, note string"
T0 = dt.datetime(2024, 1, 1)


def _docs(spark, data):
    return spark.createDataFrame([(*r, "clash", "clash") for r in data], DOCS)


def _norm(h):
    return None if h is None else h.strip().lower()


def _latest(data):
    best = {}
    for n, s, d, h, at in data:
        if n is None:
            continue
        rank = (at is not None, at or T0, h is not None, _norm(h) or "")
        k = (n, s, d)
        if k not in best or rank > best[k][0]:
            best[k] = (rank, _norm(h))
    return {k: v[1] for k, v in best.items()}


def _diff(a, b):
    out = []
    for k in a.keys() | b.keys():
        if k not in a:
            out.append((*k, "added"))
        elif k not in b:
            out.append((*k, "removed"))
        elif a[k] != b[k]:
            out.append((*k, "changed"))
    return out


def _expected(data):
    by = {}
    for (n, s, d), h in _latest(data).items():
        by.setdefault(n, {})[s, d] = h
    order = sorted(by)
    return sorted(((n, *c) for p, n in zip(order, order[1:]) for c in _diff(by[p], by[n])), key=str)


def _random(seed, n=400):
    r = random.Random(seed)
    at = lambda: r.choice([None, T0 + dt.timedelta(hours=r.randrange(5))])
    data = [(r.choice([1, 2, 4, 5, None]), r.choice(["s", "hot", None]), r.choice([None, "", *map(str, range(12))]), r.choice([None, "", "aa", "AA ", "b ", "c"]), at()) for _ in range(n)]
    data += [(2, "hot", "0", "aa", T0)] * (n // 2)  # one key with a third of all rows
    return data


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_equal_brute_force(spark, seed):
    data = _random(seed)
    found = sorted((tuple(r) for r in snapshot_changes(_docs(spark, data), leaf_rows=2).collect()), key=str)
    assert found == _expected(data)


def test_trees_are_kept_and_compared_at_the_lesser_depth(spark, tmp_path):
    data = _random(6)
    kept = Snapshots(spark, f"file://{tmp_path}/kept")
    of = lambda *n: _docs(spark, [r for r in data if r[0] in n])
    assert kept.add(of(1, 2), leaf_rows=1) == [1, 2] and kept.add(of(5), leaf_rows=100) == [5] and kept.add(of(4), leaf_rows=2) == [4]
    assert len({m["depth"] for m in kept.manifests()}) > 1 and [m["number"] for m in kept.manifests()] == [1, 2, 4, 5]
    assert sorted((tuple(r) for r in kept.changes().collect()), key=str) == _expected(data)
    with pytest.raises(ValueError, match="are there"):
        kept.add(of(2))


def test_changes_of_one_and_no_snapshot(spark):
    assert rows(snapshot_changes(_docs(spark, [(1, "s", "a", "x", T0)]))) == []
    assert rows(snapshot_changes(_docs(spark, []))) == []


def test_equal_snapshots_have_no_changes(spark):
    one = [(n, "s", str(i), f"h{i}", T0) for n in (1, 2) for i in range(50)]
    assert rows(snapshot_changes(_docs(spark, one))) == []


def _runs(spark, data):
    return spark.createDataFrame([(*r, None) for r in data], RUNS)


def _expected_runs(data, runs):
    by = {}
    for (n, s, d), h in _latest(data).items():
        by.setdefault(n, {})[s, d] = h
    known = sorted(by)
    ok = {}
    for run, s, n, at, status in runs:
        if status == "ok" and n is not None:
            ok.setdefault((run, s), []).append((at, n))
    per = {}
    for (run, s), x in ok.items():
        at, n = min(x, key=lambda y: (y[0] is not None, y[0] or T0, y[1]))
        per.setdefault(s, []).append(((at is not None, at or T0, run), run, n))
    out = []
    for s, x in per.items():
        x.sort()
        seen = [max([k for k in known if k <= n], default=None) for _, _, n in x]
        for (a, b), (_, run, _) in zip(zip(seen, seen[1:]), x[1:]):
            pick = lambda v: {k: h for k, h in by.get(v, {}).items() if k[0] == s}
            out += [(run, *c) for c in _diff(pick(a), pick(b))]
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", [3, 4])
def test_runs_equal_brute_force(spark, seed):
    data, r = _random(seed), random.Random(seed)
    runs = [(100 + i, r.choice(["s", "hot", None, "none"]), r.choice([1, 2, 3, 4, 5, None]), T0 + dt.timedelta(days=r.randrange(9)), r.choice(["ok", "ok", "failed", None])) for i in range(25)]
    runs += runs[:5]
    found = sorted((tuple(x) for x in run_changes(_docs(spark, data), _runs(spark, runs), file_rows=7).collect()), key=str)
    assert found == _expected_runs(data, runs)


def test_runs_of_empty_tables(spark):
    docs = _docs(spark, [(1, "s", "a", "x", T0)])
    assert rows(run_changes(docs, _runs(spark, []))) == []
    assert rows(run_changes(_docs(spark, []), _runs(spark, [(1, "s", 1, T0, "ok")]))) == []


def test_there_and_back_is_no_change(spark):
    data = [(1, "s", "a", "x", T0), (2, "s", "a", "y", T0), (3, "s", "a", "x", T0)]
    runs = [(1, "s", 1, T0, "ok"), (2, "s", 3, T0 + dt.timedelta(1), "ok"), (3, "s", 2, T0 + dt.timedelta(2), "ok")]
    assert rows(run_changes(_docs(spark, data), _runs(spark, runs))) == [(3, "s", "a", "changed")]


def _snapshots(n_files=1):
    snaps = ((1, {"a": "1", "b": "1"}), (2, {"a": "2", "c": "1"}), (3, {"a": "2", "c": "1", "d": "1"}))
    return [(n, "s", d, h, T0) for n, snap in snaps for d, h in snap.items()]


def test_incremental_run_survives_a_failure(spark, tmp_path):
    h = History.load(_docs(spark, _snapshots()), f"file://{tmp_path}/history")
    run = IncrementalRun(h, f"file://{tmp_path}/out")
    assert run.run(to=0)

    def broken(df):
        df.write.parquet(f"file://{tmp_path}/out/batches/half")  # written, never committed
        raise RuntimeError("lost")

    with pytest.raises(RuntimeError):
        run.run(broken, to=1)
    assert rows(run.positions()) == [("s", 0)] and run.output().count() == 2
    assert run.run(to=1) and run.run() and not run.run()
    assert rows(run.output(), "doc_id", "change_kind") == [("a", "added"), ("a", "changed"), ("b", "added"), ("b", "removed"), ("c", "added"), ("d", "added")]


def test_a_source_goes_on_from_its_position(spark, tmp_path):
    data = _random(5)
    h = History.load(_docs(spark, data), file_rows=9)
    wanted = lambda x: spark.createDataFrame(x, "span bigint, subject string, version_to int, turn int")
    at_once, steps = (IncrementalRun(h, f"file://{tmp_path}/{n}") for n in ("once", "steps"))
    runs = [(1, "s", 0, 1), (2, "s", 2, 2), (3, "s", 1, 3), (4, None, 1, 1), (5, None, 3, 2), (6, "hot", 3, 1)]
    at_once.advance(wanted(runs))
    for i in (1, 2, 3):
        steps.advance(wanted([r for r in runs if r[3] == i]))
    assert rows(at_once.output()) == rows(steps.output()) and len(rows(steps.output())) > 30
    assert rows(at_once.positions()) == rows(steps.positions()) == [(None, 3), ("hot", 3), ("s", 1)]


def test_of_two_runners_one_commits(spark, tmp_path):
    h = History.load(_docs(spark, _snapshots()), f"file://{tmp_path}/history")
    run, other = (IncrementalRun(h, f"file://{tmp_path}/out") for _ in range(2))

    def late(df):  # the other runner commits while this one works
        other.run(to=0)
        return df

    with pytest.raises(Conflict):
        run.run(late, to=0)
    assert len(run.commits()) == 1 and rows(run.output(), "doc_id") == [("a",), ("b",)]
    assert len(list((tmp_path / "out" / "batches").iterdir())) == 1


def test_of_many_writers_of_one_name_one_succeeds(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    with ThreadPoolExecutor(8) as pool:
        done = list(pool.map(lambda i: put_file(spark, f"file://{tmp_path}/x/name", str(i)), range(24)))
    assert done.count(True) == 1 and (tmp_path / "x" / "name").read_text() == str(done.index(True))
    assert [p.name for p in (tmp_path / "x").iterdir() if not p.name.endswith(".crc")] == ["name"]


def test_appended_versions_equal_loaded_ones(spark, tmp_path):
    data = _random(7, 200)
    numbers = [1, 2, 4, 5]
    whole = History.load(_docs(spark, data), file_rows=7)
    h = History.load(_docs(spark, [r for r in data if r[0] in numbers[:2]]), f"file://{tmp_path}/h", file_rows=7)
    for n in numbers[2:]:
        before = [m["added"] for m in h.manifests()]
        h.append(_docs(spark, [r for r in data if r[0] == n]).drop("snap_no"), n)
        assert [m["added"] for m in h.manifests()][:-1] == before
    assert h.numbers() == whole.numbers() == numbers
    for v in range(4):
        assert rows(h.live(v), "subject", "doc_id", "hash") == rows(whole.live(v), "subject", "doc_id", "hash")
    spans = spark.createDataFrame([(i, s, a, b) for i, (s, a, b) in enumerate((s, a, b) for s in ("s", "hot", None) for a, b in ((0, 3), (1, 2), (3, 1), (-1, 2)))], "span bigint, subject string, version_from int, version_to int")
    assert rows(h.changes(spans)) == rows(whole.changes(spans))


def test_a_writer_of_a_taken_version_leaves_nothing(spark, tmp_path):
    h = History.load(_docs(spark, _snapshots()), f"file://{tmp_path}/h")
    put_file(spark, f"file://{tmp_path}/h/versions/0000000003.json", '{"version": 3, "snap_no": 4, "buckets": 1, "added": [], "marked": []}')
    stale = History(spark, h.path)
    stale.manifests = lambda: History.manifests(stale)[:3]  # read before the other writer
    with pytest.raises(Conflict):
        stale.append(_docs(spark, [(9, "s", "z", "1", T0)]).drop("snap_no"), 9)
    assert h.numbers() == [1, 2, 3, 4] and not list((tmp_path / "h" / "appended").iterdir())


def test_only_touched_files_are_read(spark):
    data = [(n, "s", str(i), "x" if n < 3 or i else "y", T0) for n in (1, 2, 3, 4) for i in range(200)]
    h = History.load(_docs(spark, data), file_rows=10)
    spans = lambda a, b: spark.createDataFrame([(1, "s", a, b)], "span bigint, subject string, version_from int, version_to int")
    assert h.files().count() > 10 and len(h.touched(1, 2)) == 2 and h.touched(2, 3) == set()
    found = h.changes(spans(1, 2))
    read = {p.split("/data/")[1].rsplit("/", 1)[0] for p in found.inputFiles() if "/data/" in p}
    assert read == {f"add_version={a}/bucket={b}" for a, b in h.touched(1, 2)} and rows(found) == [(1, "s", "0", "changed")]
    assert h.changes(spans(2, 3)).inputFiles() == []
