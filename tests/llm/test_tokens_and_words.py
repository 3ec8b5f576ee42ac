"""Encoding, near-duplicates, leaks and stuffed pages, against brute force."""

import random
import string
from itertools import combinations

import numpy as np
import pytest

from corpusspark.llm import columns, leakage, near_duplicates, stuffing, tokenizing
from corpusspark.llm.words import words_of
from tests.conftest import rows


@pytest.fixture(scope="module")
def bpe():
    return tokenizing.BytePairs.load()


def _texts(bpe, n=3000):
    r = random.Random(9)
    strings = [b.decode("utf-8", "replace") for b in bpe.ranks]
    pick = lambda: r.choice(strings) if r.random() < 0.6 else r.choice(string.ascii_letters + " \n\t\r\x1c\x1f\x85 　é中👩‍")
    fixed = ["", " ", "  a", "a  b", "KoartIndexFactory HTTPServerError", "x\r\n\r\ny", "don't WE'LL", "\x1d!a", "e" * 3000, "<|endoftext|>", "½ⅷ²", "aB" * 500]
    return fixed + ["".join(pick() for _ in range(r.randrange(1, 10))) for _ in range(n)]


def test_ids_equal_the_public_tokenizer(bpe):
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=tokenizing.PATTERN, mergeable_ranks=bpe.ranks, special_tokens={})
    for t in _texts(bpe):
        assert bpe.encode(t) == ref.encode_ordinary(t), t
        assert bpe.decode(bpe.encode(t)) == t


def test_every_place_of_white_space_is_known():
    import regex

    space = {chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and regex.match(r"\s", chr(c))}
    assert {chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000 and tokenizing.re.match(r"\s", chr(c))} - space == set("\x1c\x1d\x1e\x1f")


def test_a_full_memory_changes_nothing(bpe):
    small = tokenizing.BytePairs(bpe.ranks)
    for m in (small._pieces, small._steps, small._stretches, small._apart):
        m.most = 3
    assert all(small.encode(t) == bpe.encode(t) for t in _texts(bpe, 200))


def test_encoded_frames(spark):
    df = spark.createDataFrame([(1, "a b", 0), (2, None, 0), (3, "", 0), (None, "a b", 0), (1, "a b", 0)], "doc_id bigint, text string, ids int")
    found = rows(tokenizing.encoded(df))
    assert found == [(None, [64, 275]), (1, [64, 275]), (1, [64, 275]), (2, []), (3, [])]
    assert rows(tokenizing.decoded(tokenizing.encoded(df)))[1] == (1, "a b") and tokenizing.encoded(df.limit(0)).count() == 0


def test_columns_pack(spark):
    for a in (np.array([], np.int64), np.array([-5, 2**40, 0]), np.arange(9, dtype=np.uint16)):
        assert columns.unpack(columns.pack(a), a.dtype).tolist() == a.tolist()
    big = np.arange(1000, dtype=np.int64)
    df = spark.createDataFrame([(i, bytearray(b)) for _ in range(3) for i, b in columns.sliced(big)], "slice int, part binary")
    assert columns.summed(df, np.int64).tolist() == (3 * big).tolist() and len(columns.summed(df.limit(0), np.int64)) == 0


# --- near-duplicates


def _similar(a, b):
    sets = [{tuple(w[i : i + 3]) for i in range(len(w) - 2)} for w in (words_of(a), words_of(b))]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


def _chunks(seed):
    r = random.Random(seed)
    base = [[f"w{r.randrange(400)}" for _ in range(r.randrange(15, 80))] for _ in range(25)]
    data = []
    for i in range(150):
        w = list(r.choice(base))
        for _ in range(r.choice([0, 0, 1, 2, 4, 8])):
            k, x = r.randrange(len(w)), f"w{r.randrange(400)}"
            w = r.choice([w[:k] + w[k + 1 :], w[:k] + [x] + w[k:], w[:k] + [x] + w[k + 1 :]])
        data.append((f"c{i:03}", r.choice([None] + [f"d{j}" for j in range(60)]), " ".join(w).upper() if i % 3 else "_".join(w)))
    data += [(f"h{i:03}", f"e{i % 4}", " ".join(base[0])) for i in range(60)]  # a group of copies
    return data + data[:30] + [("null", "d", None), ("empty", "d", ""), ("few", "d", "a b c")]


@pytest.mark.parametrize("seed", [1, 2])
def test_pairs_equal_brute_force(spark, seed):
    data = _chunks(seed)
    df = spark.createDataFrame([(*x, 1) for x in data], "chunk_id string, doc_id string, text string, key int")
    own = sorted({x for x in data if x[2] and len(words_of(x[2])) >= 20}, key=str)
    want = {tuple(sorted((a[0], b[0]))) for a, b in combinations(own, 2) if a[1] is not None and b[1] is not None and a[1] != b[1] and _similar(a[2], b[2]) >= 0.6}
    assert {tuple(r) for r in near_duplicates.near_duplicate_pairs(df).collect()} == want and len(want) > 100
    groups = near_duplicates.near_duplicate_groups(df).collect()
    assert {r.chunk_id for r in groups} >= {x for p in want for x in p}
    of = {r.chunk_id: r.class_id for r in groups}
    assert all(of[a] == of[b] for a, b in want)


def test_long_prefixes_lose_nothing(spark, monkeypatch):
    data = _chunks(5)
    df = spark.createDataFrame(data, "chunk_id string, doc_id string, text string")
    found = rows(near_duplicates.near_duplicate_pairs(df))
    monkeypatch.setattr(near_duplicates, "VERIFY_COST", 1000)
    monkeypatch.setattr(near_duplicates, "RANGE_POSTINGS", 50)
    monkeypatch.setattr(near_duplicates, "FAN_BITS", 3)
    monkeypatch.setattr(near_duplicates, "GATHERED", 300)
    assert rows(near_duplicates.near_duplicate_pairs(df)) == found  # many ranges, told apart in several shuffles
    monkeypatch.setattr(near_duplicates, "HOT", 3)
    assert rows(near_duplicates.near_duplicate_pairs(df)) == found  # common sequences in blocks
    monkeypatch.setattr(near_duplicates, "LOAD", 1e-4)
    assert rows(near_duplicates.near_duplicate_pairs(df)) == found  # an order from a part of the texts


def test_blocks_let_two_texts_meet_once():
    r = np.random.default_rng(3)
    h, keys = np.repeat(np.array([5, 9], np.uint64), 200), np.tile(r.integers(-(2**60), 2**60, 200), 2)
    met = np.where(h == 5, 7.5 * near_duplicates.HOT, 3.0)
    posting, item, side = near_duplicates._blocks(h, keys, met)
    seen = {}
    for x in np.unique(item):
        own = np.flatnonzero(item == x)
        for i, j in combinations(own, 2):
            if side[i] != side[j] or side[i] == 2:
                k = (int(h[posting[i]]), *sorted((int(keys[posting[i]]), int(keys[posting[j]]))))
                seen[k] = seen.get(k, 0) + 1
    assert set(seen.values()) == {1} and len(seen) == 2 * 199 * 100


def test_packed_rows_grow_with_the_data_not_with_the_ranges(spark, monkeypatch):
    data = [(f"c{i}", f"d{i}", " ".join(f"w{(i * 7919 + j * j) % 50021}" for j in range(60))) for i in range(2000)]
    df = spark.createDataFrame(data, "chunk_id string, doc_id string, text string").coalesce(2)
    kinds = near_duplicates._sets_and_sketch(df, 3, 20, 1.0).cache()
    sketch = columns.summed(kinds.where("kind = 1"), np.int32)
    sizes = {}
    monkeypatch.setattr(near_duplicates, "FAN_BITS", 4)
    for bits in (3, 6, 9):
        p = near_duplicates.prefix_postings(kinds.where("kind = 0"), sketch, 1.0, bits, 0.6)
        n, size, entries = 0, 0, 0
        for r in p.collect():
            n, size, entries = n + 1, size + sum(len(r[c]) for c in near_duplicates._POSTING), entries + len(columns.unpack(bytes(r["items"]), np.uint64))
        sizes[bits] = (n, size, entries)
    assert len({x[2] for x in sizes.values()}) == 1  # the same postings
    assert sizes[9][0] <= 2**9 * 4 and sizes[6][0] <= 2**6 * 4


def test_shuffles_grow_with_texts_that_share_sequences_and_not_with_their_pairs(spark):
    r = random.Random(11)
    pool = [" ".join(f"s{i}w{j}" for j in range(8)) for i in range(60)]
    data = [(f"c{i:04}", f"d{i}", " ".join(r.sample(pool, 12))) for i in range(2000)]
    total = lambda: spark.sparkContext._jsc.sc().statusStore().executorList(True).apply(0).totalShuffleWrite()
    grown = []
    for n in (500, 2000):
        before = total()
        near_duplicates.near_duplicate_pairs(spark.createDataFrame(data[:n], "chunk_id string, doc_id string, text string")).collect()
        grown.append(total() - before)
    assert grown[1] < 6 * grown[0]


def test_the_sketch_counts_all_texts(spark, monkeypatch):
    df = spark.createDataFrame(_chunks(8), "chunk_id string, doc_id string, text string")
    counted, summed = [], near_duplicates.summed
    monkeypatch.setattr(near_duplicates, "summed", lambda *x: counted.append(summed(*x)) or counted[-1])
    monkeypatch.setattr(near_duplicates, "LOAD", 1e-3)
    near_duplicates.similar_sets(df)
    shared = sum(len({tuple(w[i : i + 3]) for i in range(len(w) - 2)}) for _, _, t in _chunks(8) if t and len(w := words_of(t)) >= 20)
    assert counted[0].sum() == shared and len(counted[0]) > near_duplicates.SKETCH


def test_levels_tell_common_sequences_from_chance():
    sketch = np.random.default_rng(5).poisson(400, 1 << 16)
    sketch[:64] += 300
    assert near_duplicates._levels(sketch)[:64].min() > near_duplicates._levels(sketch)[64:].max() and len(near_duplicates._levels(sketch[:0])) == 0


def test_rounds_part_the_postings_and_find_the_same(spark, monkeypatch):
    df = spark.createDataFrame(_chunks(7), "chunk_id string, doc_id string, text string")
    found = rows(near_duplicates.near_duplicate_pairs(df))
    made, written = [], near_duplicates.written
    monkeypatch.setattr(near_duplicates, "written", lambda df, tag, *by: made.append(tag) or written(df, tag, *by))
    monkeypatch.setattr(near_duplicates, "RANGE_POSTINGS", 200)
    assert rows(near_duplicates.near_duplicate_pairs(df)) == found and made.count("p2-pairs") == near_duplicates.ROUNDS


def test_no_near_duplicates(spark):
    df = spark.createDataFrame([("a", "d", "x")], "chunk_id string, doc_id string, text string")
    for f in (near_duplicates.near_duplicate_pairs, near_duplicates.near_duplicate_groups):
        assert f(df).count() == 0 and f(df.limit(0)).count() == 0


# --- leaks


def _leak_world(seed=3):
    r = random.Random(seed)
    w = lambda n: [f"t{r.randrange(300)}" for _ in range(n)]
    items = [(i, w(r.choice([5, 9, 10, 40, 60]))) for i in range(12)]
    items.append((50, w(5) + items[4][1][:20]))
    docs = []
    for d in range(80):
        text = w(r.randrange(0, 60))
        if d % 2:
            p = r.choice(items)[1]
            k = r.randrange(len(p))
            text[len(text) // 2 : len(text) // 2] = p[k : k + r.choice([8, 9, 10, 15])]
        docs.append((d, " ".join(text)))
    return docs + [(100, None), (101, ""), (102, " ".join(items[5][1] * 30)), (0, docs[0][1])], [(i, " ".join(p)) for i, p in items] + [(60, None), (61, ""), (None, "x")]


@pytest.mark.parametrize("at_once", [1 << 18, 100])
def test_leaks_equal_brute_force(spark, at_once):
    docs, items = _leak_world()
    grams = lambda t: {tuple(x) for w in [words_of(t or "")] for x in (w[i : i + 10] for i in range(len(w) - 9))}
    want = sorted({(d, i) for d, t in docs for i, p in items if i is not None and grams(t) & grams(p)})
    found = leakage.leaks(spark.createDataFrame([(*x, 1) for x in docs], "doc_id bigint, text string, item_id int"), spark.createDataFrame(items, "item_id bigint, passage string"), at_once=at_once)
    assert rows(found.where("verbatim"), "doc_id", "item_id") == sorted(want, key=lambda t: (str(t[0]), str(t[1]))) and len(want) > 10


def test_no_items_and_no_documents(spark):
    docs, items = (spark.createDataFrame(x, k) for x, k in zip(_leak_world(), ("doc_id bigint, text string", "item_id bigint, passage string"), strict=True))
    assert leakage.leaks(docs, items.limit(0)).count() == 0 and leakage.leaks(docs.limit(0), items).count() == 0


def test_paraphrases_keep_order_and_rare_words(spark):
    passage = "the gateway flurbo rejects status zanti because brovel runs ahead of every quenched adapter route today"
    near = passage.replace("because", "since")
    items = spark.createDataFrame([(1, passage)], "item_id bigint, passage string")
    filler = [(10 + i, f"since the status of every route runs ahead of the adapter today because item {i}") for i in range(5)]
    docs = spark.createDataFrame([(1, passage), (2, near + " since"), *filler], "doc_id bigint, text string")
    assert rows(leakage.verbatim_leaks(docs, items)) == [(1, 1)]
    found = leakage.leaks(docs, items.unionByName(spark.createDataFrame([(2, "since " + near[::-1])], "item_id bigint, passage string")), cosine=0.5).where("item_id = 1")
    assert {r.doc_id for r in found.collect()} >= {1}


def test_paraphrases_with_words_of_their_own_are_found(spark):
    passage = "the gateway flurbo rejects status zanti because brovel runs ahead of every quenched adapter route today"
    items = spark.createDataFrame([(1, passage)], "item_id bigint, passage string")
    near = passage.replace("because", "since")  # since is in no passage
    filler = [(10 + i, f"since the status of every route runs ahead of the adapter today because item {i}") for i in range(5)]
    other = passage.replace("rejects", "refuses").replace("runs", "walks").replace("adapter", "plug")
    docs = spark.createDataFrame([(1, passage), (2, near + " since"), (3, other), (4, "short since"), (5, None), *filler], "doc_id bigint, text string")
    assert rows(leakage.paraphrases(docs, items), "doc_id", "item_id") == [(2, 1), (3, 1)]
    assert leakage.paraphrases(docs.limit(0), items).count() == 0


def test_a_nearer_window_with_fewer_rare_words_hides_no_paraphrase(spark):
    # rare words of the passage's only window: r1 to r3, as the others are in many documents
    # the second item keeps windows with r1 alone in the search
    items = spark.createDataFrame([(1, "a b c d e f g r1 r2 r3"), (2, "a b c d e f g r1 r1 a")], "item_id bigint, passage string")
    boilerplate, real = "a b c d e f g x r1 y", "a b c d u e v w r1 r2"
    assert [leakage._common(np.array([t.split()]), np.array(["a b c d e f g r1 r2 r3".split()]))[0] for t in (boilerplate, real)] == [8, 7]
    stop = " . ".join("zz" for _ in range(2100))  # apart, so that both orders and both aggregations are met
    docs = [(1, boilerplate + f" {stop} " + real), (2, real + f" {stop} " + boilerplate), (3, boilerplate)] + [(10 + i, "a b c d e f g") for i in range(40)] + [(60 + i, "r1 r2 r3") for i in range(30)]
    found = leakage.paraphrases(spark.createDataFrame(docs, "doc_id bigint, text string"), items).where("item_id = 1")
    assert rows(found) == [(1, 1, 7, 2), (2, 1, 7, 2)]


def test_paraphrases_are_found_at_production_parameters(spark):
    """Passages of which one word in eight is a new one, so that no ten words in a row are a passage's."""
    r = random.Random(12)
    common = ["the", "of", "a", "to", "is", "in", "for", "and", "that", "with"]
    word = lambda: r.choice(common) if r.random() < 0.4 else f"term{r.randrange(4000)}"
    items = [(i, [word() for _ in range(r.randrange(40, 90))]) for i in range(400)]
    docs, want = [], set()
    for i, p in items[:80]:
        own = [f"fresh{r.randrange(10**6)}" if k % 8 == 3 else w for k, w in enumerate(p)]
        docs.append((i, " ".join([word() for _ in range(60)] + own + [word() for _ in range(60)])))
        want.add((i, i))
    docs += [(1000 + k, " ".join(word() for _ in range(300))) for k in range(300)]
    found = leakage.paraphrases(spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame([(i, " ".join(p)) for i, p in items], "item_id bigint, passage string"))
    got = {(x.doc_id, x.item_id) for x in found.collect()}
    assert len(got & want) >= 0.9 * len(want)
    assert len({d for d, i in got if d >= 1000}) <= 6


def test_index_finds_what_a_full_search_finds():
    r = np.random.default_rng(5)
    v = r.standard_normal((6000, 24))
    v = (v / np.linalg.norm(v, axis=1, keepdims=True)).astype(np.float32)
    x = v[::7] + 0.1 * r.standard_normal((len(v[::7]), 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    index = leakage.Index.of(v)
    i, j = np.nonzero(x @ v.T >= 0.8)
    a, b, score = index.search(x, 0.8)
    found = set(zip(a.tolist(), b.tolist(), strict=True))
    assert found <= set(zip(i.tolist(), j.tolist(), strict=True)) and len(found) >= 0.9 * len(i) and np.allclose(score, (x[a] * v[b]).sum(axis=1), atol=1e-5)
    a, b, _ = index.search(v, 0.9999)  # a vector's own is never lost
    assert set(zip(range(len(v)), range(len(v)), strict=True)) <= set(zip(a.tolist(), b.tolist(), strict=True))


def test_a_sample_has_so_many_windows(spark):
    runs = spark.createDataFrame([(i, list(range(i, i + 19))) for i in range(2000)], "doc_id bigint, run array<int>")
    assert leakage.sampled(runs, 10, 10**6).count() == 2000 and 700 < leakage.sampled(runs, 10, 10_000).count() < 1300


def test_svd_finds_the_space(spark):
    r = np.random.default_rng(0)
    ev = leakage.Evaluation.of([(i, " ".join(f"x{j}" for j in r.integers(0, 40, 30))) for i in range(6)], 10)
    idf = np.ones(len(ev.vocabulary))
    lists = [[int(x) for x in r.integers(0, len(idf), 14)] for _ in range(40)]
    basis = leakage.latent_basis(spark.createDataFrame([(x,) for x in lists], "run array<int>"), ev, idf, 10, rank=30)
    w = np.array([x[i : i + 10] for x in lists for i in range(5)] + ev.windows.tolist())
    m = np.zeros((len(w), len(idf)))
    np.add.at(m, (np.repeat(np.arange(len(w)), 10), w.reshape(-1)), 1)
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    best = (np.linalg.svd(m, compute_uv=False)[:30] ** 2).sum()
    assert ((m @ basis) ** 2).sum() > 0.97 * best


def test_common_subsequences():
    a = np.array([[1, 2, 3, 4], [1, 1, 1, 1], [1, 2, 3, 4]])
    b = np.array([[1, 3, 2, 4], [2, 3, 4, 5], [1, 2, 3, 4]])
    assert leakage._common(a, b).tolist() == [3, 0, 4]


# --- stuffed pages


LINKS = "\n".join(f"- [page {i}](https://site.example/p/{i})" for i in range(20))
TAGS = " ".join(f"#tag{chr(97 + i % 26)}{i}" for i in range(60))
WORDS = ("license key tideline " * 60).strip()
OFFERS = ", ".join(f"{a} {b} {i}.0" for i in range(9) for a in ("plant", "volume quota") for b in ("jar", "pdf"))
PROSE = "The gateway sends the session token to the reader, which answers with a work order. " * 3 + "Each call returns at most ten entries of the page tree; the rest is read by the next run."
TABLE = "\n".join(f"| Jar{i}_1.{i}.jar | Reader{i}, Writer{i} |" for i in range(30))
CODE = "\n".join(f'    Tracker x{i} = Registry{i}.rotate("a.b", {i});' for i in range(30))
CONFIG = "\n".join(f"  queue{i}: {i} minutes\n  route{i}: true" for i in range(20))


CLOUD = " | ".join(f"{a} {b} ({i}{j})" for i, a in enumerate(("release", "read-only", "plant")) for j, b in enumerate(("note", "volume", "key", "jar", "cache", "unit", "task", "lock")))
LABELLED = "\n".join(f"Tags: {'; '.join(f'word{chr(97 + i)}{chr(97 + j)}-kit' for j in range(8))} / SKU PLANT-{i}" for i in range(9))
# two kinds of list that no rule names
ARROWS = " >> ".join(f"crib{chr(97 + i % 26)} sale{chr(97 + i % 7)}" for i in range(60))
COLUMN = "\n".join(f"{a} {b}" for a in ("cheap", "best", "free", "top", "new") for b in ("flights", "hotels", "loans", "phones", "casino", "poker", "pills", "shoes"))
LISTS = {"links": LINKS, "tags": TAGS, "words": WORDS, "offers": OFFERS, "cloud": CLOUD, "labelled": LABELLED, "arrows": ARROWS, "column": COLUMN}


def _prose(r, n):
    """Sentences with n words, as a language has them: common words between rare ones."""
    noun = lambda: f"noun{r.randrange(300)}"
    make = [lambda: f"The {noun()} of a {noun()} is read by the {noun()}.", lambda: f"If the {noun()} does not exist, {noun()} writes it to the {noun()} and returns.", lambda: f"Set {noun()} to {r.randrange(90)} for each {noun()} that is in the {noun()}."]
    words = []
    while len(words) < n:
        words += r.choice(make)().split()
    return " ".join(words[: max(1, n - 1)]) + " end."


def _world(r, n=300):
    return [(i, _prose(r, r.choice([20, 40, 80, 160, 320]))) for i in range(n)]


def _found(spark, docs):
    return sorted({r.doc_id for r in stuffing.stuffed_pages(spark.createDataFrame([(*x, 1.0, "en") for x in docs], "doc_id bigint, text string, slope double, lang string")).collect()})


def test_stuffed_pages_of_any_kind_are_found(spark):
    r = random.Random(2)
    pages = [(1000 + i, t) for i, t in enumerate(list(LISTS.values()) + [t.upper() for t in LISTS.values()])]
    mixed = [(1100 + i, _prose(r, len(words_of(t)) // 4) + "\n" + t) for i, t in enumerate(LISTS.values())]  # a fifth is prose
    clean = [(2000 + i, t) for i, t in enumerate((None, "", " ", "x", "short text", TABLE, CODE, CONFIG, "A" * 3000, "QmFzZTY0" * 60, _prose(r, 200) + "\n\n" + LINKS[:300], "Tags: a, b, c\n\n" + _prose(r, 100), "```\n" + COLUMN + "\n```"))]
    docs = _world(r) + pages + mixed + clean
    assert _found(spark, docs + docs[-30:]) == sorted(d for d, _ in pages + mixed)
    assert _found(spark, []) == []


def test_lines_that_are_neither_sentences_nor_lists():
    for t in (TABLE, CODE, CONFIG, "A" * 3000, "QmFzZTY0" * 60, "<element name='Ask' type='t:AskType'/>", "- soapAction: `find`", "a = b(c);", "{", "```\nfree text here\n```"):
        assert stuffing.other_share(t) > 1 / 3, t[:40]
    for t in [*LISTS.values(), *[t.upper() for t in LISTS.values()], PROSE, "", "import job (346) | mapping (283)", "- [namespace](https://a.example/b)"]:
        assert stuffing.other_share(t) <= 1 / 3, t[:40]


@pytest.mark.parametrize("page", ["links", "tags", "words", "offers", "arrows"])
def test_a_stuffed_page_copied_to_a_third_of_the_rows_is_found(spark, page):
    r = random.Random(6)
    docs = [(i, _prose(r, len(words_of(LISTS[page])) + r.randrange(-3, 4))) for i in range(80)] + [(1000 + i, LISTS[page]) for i in range(40)]
    assert _found(spark, docs) == [1000 + i for i in range(40)]


def test_other_languages_have_their_own_prose(spark):
    r = random.Random(4)
    other = [(500 + i, " ".join(f"Die Klasse wort{r.randrange(300)} schreibt den wort{r.randrange(300)} in das wort{r.randrange(300)} und wartet auf die Antwort." for _ in range(r.randrange(3, 20)))) for i in range(60)]
    chinese = [(600 + i, "".join(f"如果{r.choice('索引页面变更通知')}为{r.randrange(900)}，系统将{r.choice('跳过写入读取')}目录。" for _ in range(r.randrange(6, 20)))) for i in range(60)]
    docs = [(d, t, "en") for d, t in _world(r)] + [(d, t, r.choice(["de", "DE-at", "en"])) for d, t in other] + [(d, t, r.choice(["zh", "zh", None])) for d, t in chinese] + [(900, COLUMN, "de"), (901, TAGS, None)]
    found = stuffing.stuffed_pages(spark.createDataFrame(docs, "doc_id bigint, text string, lang string"))
    assert sorted(x.doc_id for x in found.collect()) == [900, 901]


def test_without_prose_there_is_no_measure(spark):
    assert _found(spark, [(1, TAGS), (2, LINKS), (3, CODE)]) == [1, 2]


def test_curves_equal_a_fit_by_hand(spark):
    text = "a a a a b b c c d e f g"
    got = stuffing.curves(stuffing.page_features(spark.createDataFrame([(1, text)], "doc_id bigint, text string"))).first()
    freq = np.array([4, 2, 2, 1, 1, 1, 1])
    rank = np.array([1, 2.5, 2.5, 5.5, 5.5, 5.5, 5.5])
    slope, at = np.polyfit(np.log(rank), np.log(freq), 1)
    assert abs(got.slope - slope) < 1e-9 and abs(got.residual - np.sqrt(np.mean((np.log(freq) - slope * np.log(rank) - at) ** 2))) < 1e-6
