"""Joins between records: spatial within a page, nearest, as-of, ordinal, n-gram. Each has an equality in its key (page, group, phrase), so
that it is a hash or sort-merge join with a residual condition, never a nested loop over all pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import overlaps, rect_distance
from . import kernels as K

RECT = ("x0", "y0", "x1", "y1")


def _rect(prefix: str) -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}.{c}") for c in RECT)


def outside_boxes(words: DataFrame, boxes: DataFrame, key: str = "page_num") -> DataFrame:
    """Words that meet no box of their page."""
    w, b = words.alias("w"), boxes.alias("b")
    return w.join(b, (F.col(f"w.{key}") == F.col(f"b.{key}")) & overlaps(_rect("w"), _rect("b")), "left_anti")


def inside_boxes(words: DataFrame, boxes: DataFrame, key: str = "page_num") -> DataFrame:
    """(word columns, box_id) of each word that meets a box of its page."""
    w, b = words.alias("w"), boxes.alias("b")
    return w.join(b, (F.col(f"w.{key}") == F.col(f"b.{key}")) & overlaps(_rect("w"), _rect("b"))).select("w.*", "b.box_id")


def smallest_box(points: DataFrame, boxes: DataFrame, most: float, near: float = 4.0, key: str = "page_num") -> DataFrame:
    """For each point (id, page, px, py) the smallest box of its page that it is in or nearer than `near` to, of less area than most."""
    p, b = points.alias("p"), boxes.alias("b")
    gap = rect_distance(*_rect("b"), F.col("p.px"), F.col("p.py"))
    met = p.join(b, (F.col(f"p.{key}") == F.col(f"b.{key}")) & (gap < near)).withColumn("area", (F.col("b.x1") - F.col("b.x0")) * (F.col("b.y1") - F.col("b.y0")))
    best = met.groupBy("p.id").agg(F.min(F.struct("area", "b.box_id")).alias("best"))
    return best.where(F.col("best.area") < most).select("id", "best.box_id", "best.area")


def ladder(points: DataFrame, words: DataFrame, radii: list[float], least: int, key: str = "page_num") -> DataFrame:
    """(id, radius): the smallest of the radii within which a point has `least` words of its page."""
    p, w = points.alias("p"), words.alias("w")
    far = rect_distance(*_rect("w"), F.col("p.px"), F.col("p.py"))
    near = p.join(w, (F.col(f"p.{key}") == F.col(f"w.{key}")) & (far <= max(radii))).select("p.id", far.alias("d"))
    counts = near.groupBy("id").agg(*[F.count_if(F.col("d") <= r).alias(f"n{i}") for i, r in enumerate(radii)])
    pick = F.coalesce(*[F.when(F.col(f"n{i}") >= least, F.lit(float(r))) for i, r in enumerate(radii)])
    return counts.select("id", pick.alias("radius")).where("radius is not null")


def nearest(left: DataFrame, right: DataFrame, key: str, value: str, within: float | None = None) -> DataFrame:
    """(left columns, right_id, gap): for each row (id, key, value) the nearest of the same key by value, the smallest right id of equals; left outer."""
    a, b = left.alias("a"), right.alias("b")
    gap = F.abs(F.col(f"a.{value}") - F.col(f"b.{value}"))
    cond = (F.col(f"a.{key}") == F.col(f"b.{key}")) if within is None else (F.col(f"a.{key}") == F.col(f"b.{key}")) & (gap <= within)
    best = a.join(b, cond).groupBy("a.id").agg(F.min(F.struct(gap.alias("gap"), F.col("b.id").alias("rid"))).alias("best"))
    return left.join(best, "id", "left").select(*left.columns, F.col("best.rid").alias("right_id"), F.col("best.gap").alias("gap"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, values: list[str]) -> DataFrame:
    """Backward as-of join: to each left row the values of the right row of its key with the last `at` not after its own.

    Both sides go through one sort by key and time (right rows first among equals) and the last right row is carried forward: one
    shuffle, linear in the rows, where a range join makes all earlier pairs."""
    carried = [c for c in left.columns if c not in (key, at)]
    l_ = left.select(key, at, F.lit(1).alias("__side"), *carried, F.lit(None).cast(right.select(F.struct(*values)).schema[0].dataType).alias("__v"))
    r_ = right.select(key, at, F.lit(0).alias("__side"), *[F.lit(None).cast(left.schema[c].dataType).alias(c) for c in carried], F.struct(*values).alias("__v"))
    w = Window.partitionBy(key).orderBy(at, "__side").rowsBetween(Window.unboundedPreceding, 0)
    return l_.unionByName(r_).withColumn("__v", F.last("__v", ignorenulls=True).over(w)).where("__side = 1").select(key, at, *carried, *[F.col(f"__v.{v}").alias(v) for v in values])


def ordinal_pairs(left: DataFrame, right: DataFrame, key: str, left_order: list[str], right_order: list[str], right_columns: list[str]) -> DataFrame:
    """The nth left row of a key with its nth right row, if there is one; exact where both have equally many."""
    number = lambda df, order: df.withColumn("rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).withColumn("n", F.count("*").over(Window.partitionBy(key)))
    b = number(right, right_order).select(F.col(key), "rn", F.col("n").alias("n_right"), *right_columns)
    return number(left, left_order).join(b, [key, "rn"], "left").withColumn("exact", F.coalesce(F.col("n") == F.col("n_right"), F.lit(False)))


def phrases(words: Column, sizes: list[int], least: int) -> Column:
    """array<struct(size, i, phrase)> of runs of words, of `least` characters at least."""
    def of(n: int) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.greatest(F.size(words) - n, F.lit(0))), lambda i: F.struct(F.lit(n).alias("size"), i.alias("i"), F.array_join(F.slice(words, i + 1, n), " ").alias("phrase")))
        return F.filter(F.when(F.size(words) >= n, runs).otherwise(F.array().cast("array<struct<size: int, i: int, phrase: string>>")), lambda r: F.length(r["phrase"]) >= least)

    return F.flatten(F.array(*[of(n) for n in sizes]))


def longest_phrase(claims: DataFrame, pages: DataFrame, sizes: list[int], least: int) -> DataFrame:
    """(id, page_num, size, i): for each claim(id, words) and page(page_num, words) that share a run of words the longest, of these the first.

    Runs of both sides meet by equality: an inverted index, in which only the runs of claims are of interest, so pages' runs are
    cut to those by a semi-join before anything else."""
    c = claims.select("id", F.explode(phrases(F.col("words"), sizes, least)).alias("r")).select("id", "r.size", "r.i", "r.phrase")
    wanted = c.select("phrase").distinct()
    p = pages.select("page_num", F.explode(F.array_distinct(F.transform(phrases(F.col("words"), sizes, least), lambda r: r["phrase"]))).alias("phrase")).join(wanted, "phrase", "left_semi")
    met = c.join(p, "phrase")
    best = met.groupBy("id", "page_num").agg(F.min(F.struct((-F.col("size")).alias("minus"), "i")).alias("best"))
    return best.select("id", "page_num", (-F.col("best.minus")).alias("size"), F.col("best.i").alias("i"))


def coverage(claims: DataFrame, pages: DataFrame, generic: DataFrame) -> DataFrame:
    """(id, page_num, shared, informative, coverage): the share of a claim's distinct informative tokens that a page has. claims(id, token) and
    pages(page_num, token) are distinct rows; an inverted index on tokens."""
    info = claims.join(generic, "token", "left_anti")
    total = info.groupBy("id").agg(F.count("*").alias("informative"))
    shared = info.join(pages, "token").groupBy("id", "page_num").agg(F.count("*").alias("shared"))
    return shared.join(total, "id").select("id", "page_num", "shared", "informative", (F.col("shared") / F.col("informative")).alias("coverage"))


def generic_tokens(positions: DataFrame, n: int = 12) -> DataFrame:
    """(token) of the n most common in positions(page_num, pos, token), of equals the first to occur."""
    counts = positions.groupBy("token").agg(F.count("*").alias("c"), F.min(F.struct("page_num", "pos")).alias("first"))
    return counts.orderBy(F.desc("c"), "first").limit(n).select("token")


def text_exists(claims: DataFrame, pages: DataFrame, sizes: tuple[int, ...] = (4, 3, 2), least: int = 6, keys: int = 6, enough: int = 3) -> DataFrame:
    """(id, by_phrase, by_keys): whether any page(page_num, words) has a run of the claim's words, or as many of its first key words as are enough;
    claims(id, words, keys). Claims without key words exist nowhere."""
    c = claims.where(F.size("keys") > 0)
    runs = c.select("id", F.explode(phrases(F.col("words"), list(sizes), least)).alias("r")).select("id", "r.phrase").distinct()
    there = pages.select(F.explode(F.array_distinct(F.transform(phrases(F.col("words"), list(sizes), least), lambda r: r["phrase"]))).alias("phrase")).join(runs.select("phrase").distinct(), "phrase", "left_semi").distinct()
    found = runs.join(there, "phrase").select("id").distinct().withColumn("by_phrase", F.lit(True))
    first = c.select("id", F.least(F.lit(enough), F.size("keys")).alias("need"), F.explode(F.slice("keys", 1, keys)).alias("word"))
    on = pages.select("page_num", F.explode(F.array_distinct("words")).alias("word"))
    hits = first.join(on, "word").groupBy("id", "page_num", "need").agg(F.count("*").alias("n")).where("n >= need").select("id").distinct().withColumn("by_keys", F.lit(True))
    return claims.select("id").join(found, "id", "left").join(hits, "id", "left").select("id", F.coalesce("by_phrase", F.lit(False)).alias("by_phrase"), F.coalesce("by_keys", F.lit(False)).alias("by_keys"))


def keyword_clusters(hits: DataFrame, dy: float = 200.0, dx: float = 400.0) -> DataFrame:
    """(id, page_num, hits, cluster): the number of hits(id, page_num, x, y) and of those around the one that most are near to, by bands of dy."""
    near = hits.withColumn("band", F.floor(F.col("y") / dy).cast("long")).withColumn("row", F.struct("x", "y"))
    # equal places count together, so that a common word's rows don't meet one by one
    spots = near.groupBy("id", "page_num", "band", "row").agg(F.count("*").alias("n"))
    a = spots.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1))).alias("a")
    b = spots.alias("b")
    met = a.join(b, (F.col("a.id") == F.col("b.id")) & (F.col("a.page_num") == F.col("b.page_num")) & (F.col("a.band") == F.col("b.band")) & (F.abs(F.col("a.row.y") - F.col("b.row.y")) < dy) & (F.abs(F.col("a.row.x") - F.col("b.row.x")) < dx))
    around = met.groupBy("a.id", "a.page_num", "a.row").agg(F.sum("b.n").alias("n")).groupBy("id", "page_num").agg(F.max("n").alias("cluster"))
    return spots.groupBy("id", "page_num").agg(F.sum("n").alias("hits")).join(around, ["id", "page_num"])


def find_text(claims: DataFrame, pages: DataFrame, words: DataFrame, keys: int = 10, context: int = 6, boost: float = 0.15) -> DataFrame:
    """(id, page_num, confidence, method): how surely each page has each claim(id, words, keys, context). By the longest run of words that the page has, with a
    boost for words of the context; without one by the claim's first key words: a cluster of them, a single one, or any. pages(page_num, words) and
    words(page_num, text, x, y) are the same pages. Only pairs that share a run or a key word have a row."""
    n = claims.select("id", F.size("words").alias("n"), F.size("keys").alias("k"))
    known = claims.where(F.size("keys") > 0)
    runs = longest_phrase(known.select("id", "words"), pages, [6, 5, 4, 3, 2], 8)
    near = known.select("id", F.explode(F.slice(F.filter("context", lambda w: F.length(w) >= 4), 1, context)).alias("word"))
    total = near.groupBy("id").agg(F.count("*").alias("all"))
    on = pages.select("page_num", F.explode(F.array_distinct("words")).alias("word"))
    met = runs.select("id", "page_num").join(near, "id").join(on, ["page_num", "word"]).groupBy("id", "page_num").agg(F.count("*").alias("met"))
    phrase = runs.join(n, "id").join(total, "id", "left").join(met, ["id", "page_num"], "left")
    score = F.least(F.lit(1.0), F.col("size") / F.greatest("n", "size") + F.coalesce(boost * F.col("met") / F.col("all"), F.lit(0.0)))
    by_phrase = phrase.select("id", "page_num", score.alias("confidence"), F.lit("phrase").alias("method"))
    first = known.select("id", F.explode(F.array_distinct(F.slice("keys", 1, keys))).alias("text"))
    hits = first.join(words, "text").join(runs.select("id", "page_num"), ["id", "page_num"], "left_anti").select("id", "page_num", "x", "y")
    found = keyword_clusters(hits).join(n, "id")
    method = F.when(F.col("hits") == 1, "single").when(F.col("cluster") >= 2, "cluster").otherwise("any")
    value = F.when(F.col("hits") == 1, 0.25).when(F.col("cluster") >= 2, F.least(F.col("cluster") / F.col("k"), F.lit(0.6))).otherwise(0.2)
    return by_phrase.unionByName(found.select("id", "page_num", value.alias("confidence"), method.alias("method")))


def first_good(found: DataFrame, claims: DataFrame, least: float = 0.15) -> DataFrame:
    """(id, page_num, confidence, method): of found() the claim's old page (id, old) if it is good enough, else the first page that is; not the best."""
    rows = found.where(F.col("confidence") > least).join(claims.select("id", "old"), "id")
    best = rows.groupBy("id").agg(F.min(F.struct((F.col("page_num") != F.col("old")).alias("other"), "page_num", "confidence", "method")).alias("b"))
    return best.select("id", "b.page_num", "b.confidence", "b.method")


def seed_lines(points: DataFrame, words: DataFrame, radii: tuple[float, ...] = (30, 60, 110, 170), least: int = 3, key: str = "page_num") -> DataFrame:
    """(id, radius, word columns): all words of the lines that hold a seed of the point(id, page, px, py), that is a word(page, line, ...) within the smallest
    of the radii that has `least` words."""
    p, w, r = points.alias("p"), words.alias("w"), ladder(points, words, list(radii), least, key).alias("r")
    far = rect_distance(*_rect("w"), F.col("p.px"), F.col("p.py"))
    seeds = p.join(r, F.col("p.id") == F.col("r.id")).join(w, (F.col(f"p.{key}") == F.col(f"w.{key}")) & (far <= F.col("r.radius"))).select("p.id", "r.radius", f"w.{key}", "w.line").distinct()
    return seeds.join(words, [key, "line"])


def key_pairs(left: DataFrame, right: DataFrame, n: int = 30) -> DataFrame:
    """(a, b) of keys left(a) and right(b) of which one begins with the other's first n characters. Beginnings meet by equality, so no key meets all others."""
    heads = lambda df, c: df.select(c, F.explode(F.transform(F.sequence(F.lit(1), F.least(F.length(c), F.lit(n))), lambda i: F.substring(F.col(c), F.lit(1), i))).alias("head"))
    a, b = left.where("a <> ''").distinct(), right.where("b <> ''").distinct()
    one = heads(a, "a").join(b.withColumn("head", F.substring("b", 1, n)), "head").select("a", "b")
    other = heads(b, "b").join(a.withColumn("head", F.substring("a", 1, n)), "head").select("a", "b")
    # a key begins with the other's first n characters, so these are among its own beginnings
    return one.unionByName(other).distinct()


def _heads(key: str, n: int = 30) -> Column:
    """The beginnings of a key, of 1 to n characters."""
    return F.transform(F.sequence(F.lit(1), F.least(F.length(key), F.lit(n))), lambda i: F.substring(F.col(key), F.lit(1), i))


def keys_alike(left: DataFrame, right: DataFrame, n: int = 30) -> DataFrame:
    """(key) of the distinct keys left(key) that begin with the first n characters of a key right(key), or the other way round; no pairs of keys are made."""
    a, b = (df.where("key <> ''").select("key").distinct() for df in (left, right))
    own = a.select("key", F.explode(_heads("key", n)).alias("head")).join(b.select(F.substring("key", 1, n).alias("head")).distinct(), "head", "left_semi")
    other = a.withColumn("head", F.substring("key", 1, n)).join(b.select(F.explode(_heads("key", n)).alias("head")).distinct(), "head", "left_semi")
    return own.select("key").unionByName(other.select("key")).distinct()


def nearest_of_group(points: DataFrame, groups: DataFrame, places: DataFrame, lost: float = 9999.0, most: int = 20_000) -> DataFrame:
    """(id, d, index, status): for each point(id, group, x, y) the nearest of the places(key, index, status, x, y) whose keys are in its groups(key, group), the smallest index of equals;
    what has no place counts as `lost` far away. Equal places of a key count once; points of a group with many of them are dealt over tasks, each of which holds the group's places."""
    parts = int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    spots = places.groupBy("key", "x", "y").agg(F.min(F.struct("index", "status")).alias("r"))
    shares = points.groupBy("group").agg(F.ceil(F.count("*") / most).cast("int").alias("shares"))
    bucket = F.pmod(F.xxhash64("group", "share"), F.lit(4 * parts)).cast("int")
    a = points.join(shares, "group").select("group", "id", "x", "y", F.pmod(F.xxhash64("id"), F.col("shares").cast("long")).cast("int").alias("share")).withColumn("bucket", bucket)
    b = spots.join(groups.join(shares, "group"), "key").select("group", "x", "y", "r.index", "r.status", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share")).withColumn("bucket", bucket)
    kinds = {f.name: f.dataType.simpleString() for f in (*points.schema, *places.schema)}

    def run(key, p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        if not len(p) or not len(q):
            return pd.DataFrame({c: np.zeros(0, object) for c in ("id", "d", "index", "status")})
        codes = pd.MultiIndex.from_frame(pd.concat([p[["group", "share"]], q[["group", "share"]]])).factorize()[0]
        mine, theirs, n = codes[: len(p)], codes[len(p) :], int(codes.max(initial=-1)) + 1
        at, to = (v[["x", "y"]].to_numpy(float) for v in (p, q))
        here, there, ids = ~np.isnan(at).any(1), ~np.isnan(to).any(1), q["index"].to_numpy(np.int64)
        row, far = np.full(len(p), -1), np.full(len(p), lost)
        kept = np.flatnonzero(there)
        got, square = K.nearest_places(mine[here], at[here], theirs[kept], to[kept], ids[kept])
        row[here], far[here] = np.where(got < 0, -1, kept[got]) if len(kept) else -1, np.sqrt(square)
        order = np.argsort(ids, kind="stable")[::-1]
        for points_, places_ in ((here, order[~there[order]]), (~here, order)):  # a placed point with what has no place, an unplaced one with all
            first = np.full(n, -1)
            first[theirs[places_]] = places_  # the last one written has the smallest index
            other = np.where(points_, first[mine], -1)
            closer = (other >= 0) & ((row < 0) | (far > lost) | ((far == lost) & (ids[other] < ids[row])))
            row[closer], far[closer] = other[closer], lost
        met = row >= 0
        hit = q.iloc[row[met]]
        return pd.DataFrame({"id": p["id"].to_numpy()[met], "d": far[met], "index": hit["index"].to_numpy(), "status": hit["status"].to_numpy(object)})

    near = a.groupBy("bucket").cogroup(b.groupBy("bucket")).applyInPandas(run, f"id {kinds['id']}, d double, index {kinds['index']}, status {kinds['status']}")
    return near.groupBy("id").agg(F.min(F.struct("d", "index", "status")).alias("b"))


def match_truth(truth: DataFrame, placed: DataFrame) -> DataFrame:
    """(id, by_content, how, by_key, distance, good) of each row of truth(id, content, key, x, y): the first of placed(index, content, key, x, y, status) with equal
    normalised content, else with the same first 40 characters; and of those with an equal key, else a key that begins alike, the nearest one. It is good
    if it is nearer than 80 and not removed."""
    norm = lambda df: df.withColumn("norm", F.trim(F.regexp_replace(F.lower("content"), r"\s+", " "))).withColumn("head", F.substring("norm", 1, 40))
    g, a = norm(truth), norm(placed)
    same = g.select("id", "norm").join(a.groupBy("norm").agg(F.min("index").alias("same")), "norm").select("id", "same")
    alike = g.select("id", "head").join(a.where("head <> ''").groupBy("head").agg(F.min("index").alias("alike")), "head").select("id", "alike")
    there = a.where("key is not null").select("key", "index", "status", F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    keys = there.select("key").distinct()
    # groups: a key's places; else those of keys with the same first 30 characters, and of keys of which a beginning is the key's first 30
    named = lambda kind, c: F.concat(F.lit(kind), c)
    head, heads = F.substring("key", 1, 30), _heads("key")
    alike_of = lambda all_, one: F.when(F.col("key") != "", F.concat(F.transform(heads, lambda h: named(all_, h)), F.array(named(one, head)))).otherwise(F.array().cast("array<string>"))
    asked = g.where("key is not null").join(keys.withColumn("exact", F.lit(True)), "key", "left")
    points = asked.select("id", F.explode(F.when(F.col("exact"), F.array(named("=", F.col("key")))).otherwise(alike_of("<", ">"))).alias("group"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    groups = keys.select("key", F.explode(F.concat(F.array(named("=", F.col("key"))), alike_of(">", "<"))).alias("group"))
    best = nearest_of_group(points, groups, there)
    rows = g.select("id").join(same, "id", "left").join(alike, "id", "left").join(best, "id", "left")
    return rows.select("id", F.coalesce("same", "alike").alias("by_content"), F.when(F.col("same").isNotNull(), "content").when(F.col("alike").isNotNull(), "prefix").alias("how"), F.col("b.index").alias("by_key"), F.col("b.d").alias("distance"), F.coalesce((F.col("b.d") < 80) & (F.col("b.status") != "content_removed"), F.lit(False)).alias("good"))


def score_truth(truth: DataFrame, placed: DataFrame) -> DataFrame:
    """One row of counts: matched by key and of these good; placed rows and of these kept (their key is the truth's, or begins alike), removed ones that were kept,
    each also by equal keys alone, and keys that are placed more than once."""
    m = match_truth(truth, placed).agg(F.count("by_key").alias("matched"), F.count_if("good").alias("good"))
    keys = truth.where("key is not null").select(F.col("key").alias("b")).distinct()
    pairs = keys_alike(placed, keys.withColumnRenamed("b", "key")).withColumn("kept", F.lit(True))
    equal = keys.select(F.col("b").alias("key")).withColumn("exact", F.lit(True))
    gone = F.col("status") == "content_removed"
    rows = placed.join(pairs, "key", "left").join(equal, "key", "left")
    counts = rows.agg(F.count_if(~gone).alias("placed"), F.count_if(~gone & F.col("kept")).alias("placed_kept"), F.count_if(gone & F.col("kept")).alias("removed_kept"), F.count_if(~gone & F.col("exact")).alias("placed_exact"), F.count_if(gone & F.col("exact")).alias("removed_exact"))
    twice = placed.where(~gone & F.col("key").isNotNull()).groupBy("key").agg(F.count("*").alias("c")).where("c > 1").agg(F.count("*").alias("repeated_keys"))
    return m.crossJoin(counts).crossJoin(twice)  # one row each
