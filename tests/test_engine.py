import math
import os
import random
import time
from collections import Counter
from decimal import Decimal
from difflib import SequenceMatcher

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from veranda import queries as engine
from veranda.functions import strings as S
from veranda.operators import kernels as K
from veranda.operators import layout as L
from veranda.operators import matching as M
from veranda.operators import rules as R
from veranda.plans import flows

SF = "/root/testdata/sf0.001"


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "x string").select(column.alias("y")).first()["y"]


@pytest.mark.parametrize("x, want", [("1,3-5", [1, 3, 4, 5]), ("5-4", []), ("1-14", []), ("1-13 7", [*range(1, 14), 7]), ("", [])])
def test_expand_numbers(spark, x, want):
    assert one(spark, x, S.expand_numbers("x")) == want


@pytest.mark.parametrize("x, want", [("REF-12 https://x", "ref12"), ("www.A.com/", "url:www.a.com"), ("<ALT tag: Big  Cat>", "alt:big cat"), ("free text", None), (None, None)])
def test_claim_key(spark, x, want):
    assert one(spark, x, S.claim_key("x")) == want


@pytest.mark.parametrize("x, want", [("12a", 12), ("", None), ("99999999999", None)])
def test_first_number(spark, x, want):
    assert one(spark, x, S.first_number("x")) == want


def test_clean_fingerprint_keeps_accents(spark):
    assert one(spark, " Été  (5%), “x”! ", S.clean_fingerprint("x")) == "été (5%), x"


@pytest.mark.parametrize("cov, n, want", [(0.59, 3, "check"), (0.6, 3, "found"), (0.9, 2, "check"), (0.249, 9, "not_in_piece")])
def test_grade(spark, cov, n, want):
    assert spark.range(1).select(R.grade(F.lit(cov), F.lit(n)).alias("g")).first()["g"] == want


def test_percent_rounds_half_to_even(spark):
    assert spark.range(1).select(S.percent(F.lit(0.125)).alias("p")).first()["p"] == "12%"


def test_a_dropped_twin_does_not_suppress_others():
    assert K.keep_apart([(0, 0, 0), (0, 100, 0), (0, 200, 0)]) == [True, False, True]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.floats(-1e3, 1e3), min_size=1, max_size=30))
def test_isotonic_is_the_min_max_formula(z):
    want = [max(min(np.mean(z[j : k + 1]) for k in range(i, len(z))) for j in range(i + 1)) for i in range(len(z))]
    assert np.allclose(K.isotonic(np.array(z)), want, atol=1e-6)


def test_spread_stays_in_order_and_within():
    y = K.spread([50, 50, 52, 400], [10, 10, 10, 10], 2, 0, 100)
    assert all(b - a >= 12 - 1e-9 for a, b in zip(y, y[1:])) and y[0] >= 0 and y[-1] + 10 <= 100 + 1e-9
    assert K.spread([], [], 1, 0, 9) == [] and K.spread([5, 5], [10, 10], 1, 0, 8) == [0, 11]


def test_align_skips_an_inserted_page():
    e = np.eye(3)
    assert K.align(e[[0, 1]] @ e[[0, 2, 1]].T) == [0, 2]
    assert K.align(np.zeros((2, 0))) == [None, None]


def test_rasters():
    a = np.full((30, 40), 200, np.uint8)
    a[10:15, 12:20] = 10
    s = K.match_template(a, a[8:18, 10:24])
    best, _, y, x = K.best_and_second(s, 4)
    assert math.isclose(best, 1.0) and (y, x) == (8, 10)


def test_long_rasters():
    g = np.random.default_rng(4)
    a = g.integers(0, 256, (700, 64)).astype(np.uint8)
    s = K.match_template(a, a[600:612, 8:40])
    assert s.shape == (689, 33) and K.best_and_second(s, 4)[2:] == (600, 8)
    assert np.allclose(s, K.match_template(a, a[600:612, 8:40], 10**6))


def test_raster_report_reads_whole_texts(spark):
    text = "a" * 40_000
    one, two = [flows.raster_report(spark.createDataFrame([(1, t)], "page_num long, text string")).first() for t in (text, text + "z" * 20_000)]
    assert one.hash != two.hash or one.thumb_max != two.thumb_max


def test_fit_line():
    u = np.arange(0, 100, 5.0)
    a, b, n = K.fit_line(u, 1.1 * u + 3, 1.0)
    assert math.isclose(a, 1.1) and math.isclose(b, 3, abs_tol=1e-9) and n == 20


def test_fit_line_uses_all_points():
    g = np.random.default_rng(2)
    u = np.arange(0, 1000, 1.0)
    v = np.where(u < 400, g.uniform(-5000, 5000, 1000), 1.1 * u + 3)
    a, b, n = K.fit_line(u, v, 1.0)
    assert math.isclose(a, 1.1, abs_tol=1e-3) and n >= 600
    x, y = g.uniform(0, 100, 40), g.uniform(0, 100, 40)
    lines = [(s, y[i] - s * x[i]) for i in range(40) for j in range(i + 1, 40) if abs(x[j] - x[i]) >= 10 and 0.7 < (s := (y[j] - y[i]) / (x[j] - x[i])) < 1.3]
    assert K.fit_line(x, y, 5.0)[2] == max(int((np.abs(s * x + c - y) < 5).sum()) for s, c in lines)


def test_as_of_takes_the_last_at_or_before(spark):
    left = spark.createDataFrame([("a", 5, 1), ("a", 1, 2), ("b", 9, 3)], "k string, at int, id int")
    right = spark.createDataFrame([("a", 2, 20.0), ("a", 5, 50.0)], "k string, at int, v double")
    assert {(r.id, r.v) for r in M.as_of(left, right, "k", "at", ["v"]).collect()} == {(1, 50.0), (2, None), (3, None)}


def test_place_pairs_in_order(spark):
    refs = spark.createDataFrame([(0, 1), (1, 1), (2, 2)], "idx int, num int")
    marks = spark.createDataFrame([(1, 0, 5.0, 1.0), (1, 0, 9.0, 1.0), (1, 1, 1.0, 1.0)], "num int, page int, x double, y double")
    got = {r.idx: (r.page, r.x, r.status) for r in flows.place(refs, marks).collect()}
    assert got == {0: (0, 5.0, "needs_look"), 1: (0, 9.0, "needs_look"), 2: (0, 26.0, "content_removed")}
    alone = flows.place(spark.createDataFrame([(0, 7, 3), (1, 8, 3), (2, 9, 4)], "idx int, num int, page int"), marks).collect()
    assert {r.idx: (r.page, r.x, r.y) for r in alone} == {0: (3, 26.0, 40.0), 1: (3, 26.0, 74.0), 2: (4, 26.0, 40.0)}


def test_edits(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "index int, content string")
    e = spark.createDataFrame([(1, True, None), (2, False, "z")], "index int, deleted boolean, content string")
    assert [tuple(r) for r in flows.apply_edits(a, e).collect()] == [(2, "z")]


def test_fuzzy_words_lose_no_match(spark):
    g = random.Random(1)
    vocabulary = sorted({"".join(g.choice("abcdez1é") for _ in range(g.randrange(3, 13))) for _ in range(500)} | {"abcdyefzgh"})
    tokens = sorted({"".join(x for x in w if g.random() > 0.06) + g.choice(["", "", "a", "z"]) for w in vocabulary} | {"abxcdefgh"})
    frame = lambda ws: spark.createDataFrame([(w,) for w in ws], "token string")
    got = {r.token: r.word for r in flows.fuzzy_words(frame(tokens), frame(vocabulary)).collect()}
    want = {t: t if t in vocabulary else K.close_word(t, vocabulary) if len(t) >= 5 else None for t in tokens}
    assert got == want and got["abxcdefgh"] == "abcdyefzgh" and sum(w not in (None, t) for t, w in want.items()) > 100


def test_ordered_claims_equal_a_plain_version(spark):
    g = random.Random(2)
    words = ["".join(g.choice("abcdefghilmnorst") for _ in range(g.randrange(4, 10))) for _ in range(60)]
    pages = [(p, " ".join(g.choice(words) for _ in range(80))) for p in range(12)]
    damage = lambda w: w[:3] + "x" + w[3:] if g.random() < 0.2 and len(w) > 6 else w
    claims = [(i, " ".join(map(damage, pages[i % 12][1].split()[5 : 5 + g.randrange(3, 20)]))) for i in range(15)] + [(99, "nothing here is known"), (100, "")]
    frame = lambda rows, key: spark.createDataFrame(rows, f"{key} long, text string")
    got = {r.id: r for r in flows.ordered_claims(frame(claims, "id"), frame(pages, "page_num")).collect()}
    tokens = lambda t: [w for w in t.split() if len(w) >= 3 and w not in S.CLAIM_STOP]
    read = {p: tokens(t) for p, t in pages}
    everything = [w for p in sorted(read) for w in read[p]]
    generic = {w for w, _ in sorted(Counter(everything).items(), key=lambda x: (-x[1], everything.index(x[0])))[:12]}
    for i, text in claims:
        own = tokens(text)
        near = [w if w in everything else (K.close_word(w, sorted(set(everything))) if len(w) >= 5 else None) or w for w in own]
        best = (0.0, None, None)
        total = sum(w not in generic for w in near)
        for p in sorted(read) if total else ():
            have, places = 0, []
            for m in SequenceMatcher(None, near, read[p], autojunk=False).get_matching_blocks():
                told = sum(w not in generic for w in near[m.a : m.a + m.size])
                if m.size >= 4 or (m.size >= 2 and told >= 2):
                    have += told
                    places += range(m.b, m.b + m.size)
            if have / total > best[0]:
                best = (have / total, p, places)
        assert (round(best[0], 9), best[1], best[2]) == (got[i].coverage, got[i].page_num, got[i].places)
        n = len(set(own))
        assert got[i].grade == ("not_in_piece" if best[1] is None else "check" if n < 3 else "found" if best[0] >= 0.6 else "check" if best[0] >= 0.25 else "not_in_piece")
    assert got[99].grade == "not_in_piece" and sum(r.coverage > 0.6 for r in got.values()) > 5


def test_drop_duplicates_equals_a_plain_version(spark):
    g = random.Random(3)
    rows = [(i, g.randrange(3), g.randrange(2), float(g.randrange(600)), float(g.randrange(600)), g.random()) for i in range(200)]
    df = spark.createDataFrame(rows, "id long, k int, page_num int, x double, y double, c double")
    kept: list = []
    for r in sorted(rows, key=lambda r: (r[5], r[0])):
        if not any(o[1:3] == r[1:3] and abs(o[3] - r[3]) < 150 and abs(o[4] - r[4]) < 150 for o in kept):
            kept.append(r)
    assert {r.id for r in K.drop_duplicates(df, "k", ["c", "id"]).where("kept").collect()} == {r[0] for r in kept}


def test_shrink_wrap(spark):
    rows = []
    for page, (w, h, box) in enumerate([(40, 30, (12, 10, 24, 20)), (40, 30, None), (20, 20, (0, 0, 20, 19)), (64, 9, (30, 4, 31, 9))]):
        for y in range(h):
            for x in range(w):
                inside = box and box[0] <= x < box[2] and box[1] <= y < box[3]
                rows.append((page, x, y, 10 if inside else 200))
    got = {r.page_num: tuple(r)[1:] for r in L.shrink_wrap(spark.createDataFrame(rows, "page_num int, x int, y int, v int"), pad=2.0).collect()}
    assert got[0] == (10.0, 8.0, 26.0, 22.0, True) and got[1] == (0.0, 0.0, 40.0, 30.0, False) and not got[2][4] and not got[3][4]


def test_reference_tables(spark):
    cells = lambda doc, table, rows: [(doc, table, r, c, v) for r, row in enumerate(rows) for c, v in enumerate(row)]
    data = cells(1, 0, [["Nothing", "here"]]) + cells(1, 1, [["Ref No", "Claim", "Source"], ["1a", " x ", "A\n b "], ["2", "y", " "]]) + cells(1, 2, [["3", "late"]]) + cells(2, 0, [["only"], ["two"]])
    got = {tuple(r) for r in L.reference_rows(spark.createDataFrame(data, "doc int, table_no int, row_no int, col_no int, text string")).collect()}
    assert got == {(1, 0, 0, None, "", "here", None), (2, 0, 0, None, "", "only", None), (2, 0, 1, None, "", "two", None)}
    got = {tuple(r) for r in L.reference_rows(spark.createDataFrame([d for d in data if d[:2] != (1, 0)], "doc int, table_no int, row_no int, col_no int, text string")).where("doc = 1").collect()}
    assert got == {(1, 1, 1, 1, "x", "A\nb", None)}


def test_key_pairs(spark):
    g = random.Random(4)
    keys = sorted({"".join(g.choice("ab") for _ in range(g.choice((1, 2, 3, 29, 30, 31, 40)))) for _ in range(80)} | {"a" * 30, "a" * 31, "a" * 30 + "b"})
    left, right = keys[::2], keys[1::2]
    frame = lambda ks, c: spark.createDataFrame([(k,) for k in ks], f"{c} string")
    got = {tuple(r) for r in M.key_pairs(frame(left, "a"), frame(right, "b")).collect()}
    assert got == {(a, b) for a in left for b in right if b.startswith(a[:30]) or a.startswith(b[:30])}


def norm(v):
    return "" if v is None else f"{v:.6g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", engine.oracle_sql())
def test_query_equals_sql(spark, name):
    df = engine.queries()[name](spark, SF)
    columns = sorted(df.columns)
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f[:-8]} as select * from '{SF}/{f}'")
    r = con.execute(engine.oracle_sql()[name])
    names = [d[0] for d in r.description]
    assert sorted(names) == columns
    plain = lambda v: float(v) if isinstance(v, Decimal) else v
    assert sorted("|".join(norm(x[c]) for c in columns) for x in df.collect()) == sorted("|".join(norm(plain(dict(zip(names, x))[c])) for c in columns) for x in r.fetchall())


def test_context_covers_every_word(spark):
    words = sum(len(r.ws) for r in spark.read.parquet(f"{SF}/documents.parquet").select(S.split_words("text").alias("ws")).collect())
    assert engine.queries()["win2_context"](spark, SF).count() == words


def test_entry_imports():
    import __spark_entry__ as e

    assert set(engine.queries()) <= set(e.queries())


def both(spark, name, path, **tables):
    """The sorted rows of a query and of its SQL on tables (lists of rows and their DDL) written under path."""
    con = duckdb.connect()
    for table, (rows, ddl) in tables.items():
        spark.createDataFrame(rows, ddl).write.parquet(f"{path}/{table}.parquet")
        con.execute(f"create view {table} as select * from '{path}/{table}.parquet/*.parquet'")
    df = engine.queries()[name](spark, str(path))
    r = con.execute(engine.oracle_sql()[name])
    names = [d[0] for d in r.description]
    return (sorted("|".join(norm(x[c]) for c in sorted(names)) for x in rows) for rows in (df.collect(), [dict(zip(names, x, strict=True)) for x in r.fetchall()]))


PART = "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double"


def test_fitting_size_of_texts_that_fit_just_so(spark, tmp_path):
    pairs = [(s, s * 10 * 8 * 0.9**k) for s in range(1, 51) for k in range(10)] + [(13, 936.0), (15, 972.0), (None, 9.0), (3, None)]
    got, want = both(spark, "geo12_fitting_size", tmp_path, part=([(i, "a", "b", "c", s, p) for i, (s, p) in enumerate(pairs)], PART))
    assert got == want


def test_nearest_places_equals_a_plain_search():
    g = np.random.default_rng(3)
    for t in range(60):
        m, n = int(g.integers(0, 60)), int(g.integers(0, 90))
        a, b, ids = g.integers(0, 3, m), g.integers(0, 3, n), g.permutation(n)
        x, y = (g.integers(0, 9, (k, 2)) * 1.0 if t % 3 == 0 else g.random((k, 2)) * [1000, 1] if t % 3 == 1 else np.concatenate([g.random((k // 2, 2)) * 1e-3, g.random((k - k // 2, 2)) * 1e4]) for k in (m, n))
        row, far = K.nearest_places(a, x, b, y, ids, block=int(g.integers(1, 50)), rings=int(g.integers(0, 17)))
        for i in range(m):
            near = [(((y[k] - x[i]) ** 2).sum(), ids[k], k) for k in np.flatnonzero(b == a[i])]
            assert (far[i], row[i]) == ((min(near)[0], min(near)[2]) if near else (np.inf, -1))


@pytest.mark.parametrize("name", ["jn20_evaluation", "agg9_evaluation_counts"])
def test_evaluation_of_one_key_of_many_places(spark, tmp_path, name):
    # 7,800 rows have one key: millions of pairs, of which many are equally near
    rows = [(6 * i + (4 if i % 30 else i // 30 % 6), f"{'blue' if i % 2 else 'red'} ring {i % 5}", f"B{i % 3}", "T", i * 7 % 50 + 1, 1.0) for i in range(15_000)]
    got, want = both(spark, name, tmp_path, part=(rows, PART))
    assert got == want


def test_evaluation_makes_no_row_for_each_pair(spark):
    n = 60_000
    frame = lambda key, k: spark.range(n).select(F.col("id").alias(key), F.lit("https://x.org").alias("content"), F.lit("url:https://x.org").alias("key"), (F.col("id") * k % 4001).cast("double").alias("x"), (F.col("id") * 31 % 3989).cast("double").alias("y"), F.lit("moved").alias("status"))
    began = time.time()
    assert M.match_truth(frame("id", 7), frame("index", 11)).agg(F.sum("distance")).first()[0] > 0
    assert time.time() - began < 150  # by pairs, 3.6 billion rows


def test_truth_and_places_without_a_place(spark):
    ddl = "x double, y double, status string, content string, key string"
    truth = spark.createDataFrame([(0, 1.0, 1.0, "", "", "ab"), (1, None, 1.0, "", "", "ab"), (2, 5.0, 5.0, "", "", "c" * 31), (3, 0.0, 0.0, "", "", "d")], f"id long, {ddl}")
    placed = spark.createDataFrame([(7, None, None, "moved", "", "ab"), (8, 9.0, 9.0, "moved", "", "ab"), (5, 4.0, 5.0, "content_removed", "", "c" * 30 + "d"), (6, 9.0, 5.0, "moved", "", "c" * 30), (4, None, 0.0, "moved", "", "dd")], f"index long, {ddl}")
    got = {r.id: (r.by_key, r.distance, r.good) for r in M.match_truth(truth, placed).collect()}
    assert got == {0: (8, math.sqrt(128), True), 1: (7, 9999.0, False), 2: (5, 1.0, False), 3: (4, 9999.0, False)}


def _plain_align(similarity, gap=0.25, floor=0.45):
    n, m = similarity.shape
    score, way = {(0, 0): 0.0}, {}
    for i in range(n + 1):
        for j in range(m + 1):
            ways = []
            if i and j and similarity[i - 1, j - 1] >= floor:
                ways.append((score[i - 1, j - 1] + similarity[i - 1, j - 1] - floor, 2, 0))
            if i:
                ways.append((score[i - 1, j] - gap, 1, 1))
            if j:
                ways.append((score[i, j - 1] - gap, 0, 2))
            if ways:
                score[i, j], _, way[i, j] = max(ways)
    out, i, j = [None] * n, n, m
    while i or j:
        k = way[i, j]
        if k == 0:
            out[i - 1] = j - 1
        i, j = i - (k != 2), j - (k != 1)
    return out


def test_align_equals_a_plain_version():
    g = np.random.default_rng(5)
    for n, m in ((0, 4), (4, 0), (1, 1), (30, 20), (20, 50), (150, 90)):
        assert K.align(s := g.random((n, m))) == _plain_align(s)
    for _ in range(20):  # many equal ways: halves and quarters, which both count exactly
        assert K.align(s := g.integers(0, 5, (25, 30)) / 4, 0.25, 0.5) == _plain_align(s, 0.25, 0.5)


def test_align_long_documents_in_little_memory():
    import tracemalloc

    g = np.random.default_rng(6)
    v = g.normal(size=(4000, 16))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    keep = np.flatnonzero(g.random(4000) < 0.9)
    tracemalloc.start()
    got = K.align_vectors(v, v[keep])
    assert tracemalloc.get_traced_memory()[1] < 60e6  # the whole table of scores has 115 MB
    tracemalloc.stop()
    assert np.mean([j is not None and keep[j] == i for i, j in enumerate(got) if i in set(keep.tolist())]) > 0.95
