"""MinHash near-dedup by bottom-k sketches.

A document is the set of its distinct 5-word shingles (lower-cased A-Z, words split at ASCII white space). One hash function
orders all shingles; the k smallest hashes of a set are its sketch. Of two sets with Jaccard similarity J, each of the k
smallest hashes of the union is common to both sketches with probability J. So:

1. documents with equal sets are collapsed to one representative (a 128-bit key of the whole set);
2. inverted lists of the retained values give the overlaps. A pair with J >= 0.75 shares some `least` retained values at the
   least (the binomial tail below that is about 1e-8 for k = 64), so it is enough to list each document under its k - least + 1
   rarest values: a common line or passage makes no list unless it makes up most of a document;
3. in each list the document with the most widely shared values is the hub, and the list's members form the hub's group.
   Two similar documents share a list, hence a group. Groups are dealt out in blocks of at most `block` documents together with the hub;
4. in each block the sketches meet first: overlaps of retained values are counted, pairs under `least` are dropped, the others' similarity is
   estimated by the union sketch, and only documents with a likely partner go on. Their full shingle sets are intersected exactly by a
   product of incidence matrices, which gives one link from each document to the smallest of its component in the block, never pairs.
   Members of a group of several blocks that did not join the hub's component then meet all other blocks in the same way.
   So all pairs of a list are judged, the likely ones exactly, in bounded memory;
5. connected components of the links by star contraction.

Contract of odd rows: a null or wordless text has the empty set and is linked with nothing. Rows with the same doc_id are one
node. Rows without doc_id are returned with a null component and are kept. Other columns are passed over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, ids_in_buckets, map_batches, map_groups, without
from .graph import components
from .kernels import U64, batches, mix, shingle_sets

K, LEAST, BLOCK, SALTS = 64, 26, 256, 64


def set_key(s: np.ndarray) -> tuple[int, int]:
    """128 bits of the whole set: sums of two mixes of its hashes (order does not matter), and its size."""
    with np.errstate(over="ignore"):
        a, b = mix(s ^ U64(0x5851F42D4C957F2D)).sum(dtype=U64), mix(s ^ U64(0x14057B7EF767814F)).sum(dtype=U64)
        return int(mix(np.array([a + U64(len(s))], U64)).view(np.int64)[0]), int(b.view(np.int64))


def sketches(docs: DataFrame, words: int = 5, k: int = K) -> DataFrame:
    """(doc_id, n_shingles, k1, k2, sketch) of each row."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, texts = batch.column(0), as_bytes(batch.column(1))
        for a, b in batches(texts):
            sets = shingle_sets(texts[a:b], words)
            keys = [set_key(s) for s in sets]
            low = [s[:k] for s in sets]
            flat = pa.array(np.concatenate(low).view(np.int64)) if low else pa.array([], pa.int64())
            at = pa.array(np.concatenate(([0], np.cumsum([len(x) for x in low]))).astype(np.int32))
            yield pa.RecordBatch.from_arrays([ids[a:b], pa.array([len(s) for s in sets], pa.int64()), pa.array([x for x, _ in keys], pa.int64()), pa.array([x for _, x in keys], pa.int64()), pa.ListArray.from_arrays(at, flat)], ["doc_id", "n_shingles", "k1", "k2", "sketch"])

    return map_batches(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_shingles long, k1 long, k2 long, sketch array<long>")


def union_estimate(a, b, k: int = K):
    """Jaccard similarity of two sets by the k smallest values of the union of their (ascending, unsigned) sketches."""
    key = lambda c: F.transform(c, lambda v: v.bitwiseXOR(F.lit(-(1 << 63))))  # noqa: E731  unsigned order
    low = F.slice(F.array_sort(F.array_union(key(a), key(b))), 1, k)
    return F.size(F.array_intersect(low, F.array_intersect(key(a), key(b)))) / F.greatest(F.size(low), F.lit(1))


def common_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many values each two sets share; by products of incidence matrices, some columns at a time."""
    n = len(sets)
    value = np.concatenate(sets) if n else np.zeros(0, U64)
    own = np.repeat(np.arange(n), [len(s) for s in sets])
    _, column, count = np.unique(value, return_inverse=True, return_counts=True)
    often = count >= 2
    place = np.cumsum(often) - 1
    keep = often[column]
    own, column = own[keep], place[column[keep]]
    order = np.argsort(column, kind="stable")
    own, column = own[order], column[order]
    common = np.zeros((n, n), np.int64)
    width = max(64, (1 << 22) // max(n, 1))
    for at in range(0, int(often.sum()), width):
        lo, hi = np.searchsorted(column, (at, at + width))
        part = np.zeros((n, min(width, int(often.sum()) - at)), np.float32)
        part[own[lo:hi], column[lo:hi] - at] = 1
        common += np.rint(part @ part.T).astype(np.int64)
    return common


def matched(sets: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of sets have 100 * intersection >= percent * union."""
    size = np.array([len(s) for s in sets], np.int64)
    common = common_counts(sets)
    union = size[:, None] + size[None, :] - common
    return (100 * common >= percent * union) & (union > 0)


def union_estimates(x: np.ndarray, y: np.ndarray, k: int = K) -> np.ndarray:
    """union_estimate() of rows of two arrays of ascending sketches, filled up with the largest value."""
    both = np.sort(np.concatenate((x, y), axis=1), axis=1)
    twice = both[:, 1:] == both[:, :-1]
    number = np.cumsum(np.concatenate((np.ones((len(both), 1), bool), ~twice), axis=1), axis=1)  # of each value among the union's
    real = both != np.iinfo(U64).max
    held = np.minimum((number * real).max(1, initial=0), k)
    return (twice & real[:, 1:] & (number[:, 1:] <= k)).sum(1) / np.maximum(held, 1)


def likely(sketches: list[np.ndarray], sizes: np.ndarray, asks: np.ndarray, percent: int, k: int, least: int, part: int = 1 << 12) -> np.ndarray:
    """Which sets may have 100 * intersection >= percent * union with one of those that ask (or ask and may have one themselves)."""
    n = len(sketches)
    exact = -(-sizes * percent // 100)
    need = np.where(sizes <= k * percent // 100, exact, np.minimum(least, np.minimum(sizes, k)))
    able = (common_counts(sketches) >= np.maximum(need[:, None], need[None, :])) & ~np.eye(n, dtype=bool) & (need > 0)[:, None]
    full = np.full((n, k), np.iinfo(U64).max, U64)
    for row, s in zip(full, sketches, strict=True):
        row[: len(s)] = s
    floor = percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / k) ** 0.5
    out = np.zeros(n, bool)
    for i in np.argsort(-able.sum(1), kind="stable"):  # whoever has been found likely with another need not be tried again, but by those that ask
        j = np.flatnonzero(able[i] & (~out if out[i] else np.ones(n, bool))) if asks[i] else np.zeros(0, np.int64)
        for at in range(0, len(j), part):
            some = j[at : at + part]
            ok = union_estimates(np.broadcast_to(full[i], (len(some), k)), full[some], k) >= floor
            out[some[ok]] = True
            out[i] |= bool(ok.any())
    return out


def _smallest(linked: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each row of the link matrix the smallest id of its component."""
    label = ids.copy()
    linked = linked | np.eye(len(ids), dtype=bool)
    while True:
        new = np.where(linked, label[None, :], np.iinfo(np.int64).max).min(1)
        if (new == label).all():
            return label
        label = new


def _verified(met: DataFrame, by: list[str], sketch: DataFrame, docs: DataFrame, words: int, percent: int, k: int, least: int) -> DataFrame:
    """(a, b): links of met(*by, id, ask): each block's members to the smallest one of their component in it, as far as they are linked
    with members that ask. sketch(id, n, sketch) has a row or more for each id. Full sets are made from the texts where a block meets, as they are larger."""

    def some(keys: tuple, columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        ids, asks, sizes = (c.to_numpy(zero_copy_only=False) for c in columns[:3])
        ok = likely([x.values.to_numpy().view(U64) for x in columns[3]], sizes, asks, percent, k, least)
        many = np.unique(ids[ok])
        yield pa.RecordBatch.from_arrays([pa.array([v] * len(many), pa.int64()) for v in keys] + [pa.array(many)], [*by, "id"])

    def links(keys: tuple, columns: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        ids = columns[0].to_numpy()
        low = _smallest(matched(shingle_sets(as_bytes(columns[1]), words), percent), ids)
        yield pa.RecordBatch.from_arrays([pa.array(ids[ids != low]), pa.array(low[ids != low])], ["a", "b"])

    keys = ", ".join(f"{c} long" for c in by)
    near = cut(map_groups(met.join(ids_in_buckets(sketch, "id", met.select("id")), "id").select(*[F.col(c).cast("long") for c in by], "id", "ask", "n", "sketch"), by, some, f"{keys}, id long"))
    texts = ids_in_buckets(docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("string").alias("text")), "id", near.select("id"))
    return cut(map_groups(near.join(texts, "id").select(*by, "id", "text"), by, links, "a long, b long"))


def _groups(reps: DataFrame, percent: int, k: int, least: int) -> DataFrame:
    """(hub, rep, m) of reps(rep, k1, n, sketch): who is in which hub's group, and the size of the largest of their lists."""
    # inverted lists of the rarest retained values; a set goes by 64 bits of its key
    values = reps.select("k1", F.explode("sketch").alias("v"))
    often = values.groupBy("v").agg(F.count("*").alias("c")).where("c > 1")
    shared = values.join(often, "v").groupBy("k1").agg(F.sort_array(F.collect_list(F.struct("c", "v"))).alias("vs"), F.sum(F.log("c")).alias("weight")).join(reps.select("k1", "rep", "n"), "k1")
    have = F.least(F.col("n"), F.lit(k))
    exact = F.ceil(F.col("n") * percent / 100)  # such a set and all that are similar to it are whole in their sketches
    need = F.when(F.col("n") <= k * percent // 100, exact).otherwise(F.least(F.lit(least), have))
    left = have - need + 1 - (have - F.size("vs"))
    lists = cut(shared.where(left > 0).select("rep", "weight", F.explode(F.slice("vs", 1, F.greatest(left, F.lit(1)).cast("int"))).alias("x")).select("rep", F.round("weight", 6).alias("weight"), F.col("x.v").alias("v")))
    hubs = lists.groupBy("v").agg(F.max(F.struct("weight", (-F.col("rep")).alias("minus"))).alias("top"), F.count("*").alias("m")).where("m > 1").select("v", (-F.col("top.minus")).alias("hub"), "m")
    return cut(lists.join(hubs, "v").where("rep <> hub").groupBy("hub", "rep").agg(F.max("m").alias("m")))


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 75, k: int = K, least: int = LEAST, block: int = BLOCK) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of docs(doc_id, text, ...); least is the smallest overlap of
    sketches of size k that a pair of the given similarity may have."""
    found = cut(sketches(docs, words, k))
    valid = found.where("n_shingles > 0 and doc_id is not null")
    copies = cut(valid.groupBy("k1", "k2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("c")).where("c > 1").drop("c"))
    # sets that occur once, by far the most, stay where they are; only those whose key may be among the copies are moved
    few = F.broadcast(copies.select(F.pmod("k1", F.lit(1 << 20)).alias("b")).distinct())
    keyed = valid.withColumn("b", F.pmod("k1", F.lit(1 << 20)))
    columns = ("rep", "k1", F.col("n_shingles").alias("n"), "sketch")
    once = keyed.join(few, "b", "left_anti").withColumn("rep", F.col("doc_id")).select(*columns)
    some = keyed.join(few, "b", "left_semi").join(copies, ["k1", "k2"], "left").where("rep is null or rep = doc_id").withColumn("rep", F.coalesce("rep", "doc_id")).dropDuplicates(["k1", "k2"]).select(*columns)
    reps = once.unionByName(some)

    groups = _groups(reps, percent, k, least)
    # groups of two: the union sketch decides in the same plan; each sketch is moved once
    sketch = reps.select(F.col("rep").alias("id"), "n", "sketch")
    ends = groups.where("m = 2").select("hub", "rep", F.explode(F.array("hub", "rep")).alias("id"))
    pair = ends.join(ids_in_buckets(sketch, "id", ends.select("id")), "id").groupBy("hub", "rep").agg(F.min_by("sketch", "id").alias("x"), F.max_by("sketch", "id").alias("y"), F.count("*").alias("sets"))
    # an id with several sets (repeated doc_id) goes to the exact comparison as it is
    two = pair.where((F.col("sets") > 2) | (union_estimate(F.col("x"), F.col("y"), k) >= percent / 100 - 5 * (percent / 100 * (1 - percent / 100) / k) ** 0.5)).select("hub", "rep")
    members = cut(groups.where("m > 2").select("hub", "rep").unionByName(two).distinct())
    sizes = cut(members.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("long").alias("blocks")))
    # only hubs of several blocks have to tell their members so, and a hub of very many members tells them in SALTS places
    salted = sizes.where("blocks > 1").withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = members.withColumn("salt", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).cast("int")).join(salted, ["hub", "salt"], "left")
    dealt = dealt.select("hub", F.coalesce(F.pmod(F.xxhash64("rep", F.lit(11)), F.col("blocks")), F.lit(0)).alias("block"), F.col("rep").alias("id"))
    heads = sizes.select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), "blocks")
    placed = cut(dealt.unionByName(heads.select("hub", "block", F.col("hub").alias("id"))))
    links = _verified(placed.withColumn("ask", F.lit(True)), ["hub", "block"], sketch, docs, words, percent, k, least)
    label = components(links)

    # groups of several blocks: what is not yet with the hub meets all other blocks
    wide = cut(heads.where("blocks > 1"))
    if not wide.isEmpty():
        label = cut(label)
        own = wide.join(label.select(F.col("id").alias("hub"), F.col("component").alias("with")), "hub", "left").withColumn("with", F.coalesce("with", "hub"))
        named = placed.where("id <> hub").join(own, ["hub", "block"]).join(label, "id", "left")
        named = cut(named.select("hub", "block", "blocks", "id", (F.coalesce("component", "id") != F.col("with")).alias("alone")))
        alone = named.where("alone")
        parts = wide.join(alone.groupBy("hub").agg(F.ceil(F.count("*") / block).cast("long").alias("parts")), "hub").select("hub", "block", "parts")
        asks = alone.join(parts, ["hub", "block"]).select("hub", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("id", F.lit(7)), F.col("parts")).alias("part"), "id", F.lit(True).alias("ask"))
        told = named.join(parts, ["hub", "block"]).select("hub", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"), "id", F.lit(False).alias("ask"))
        met = cut(asks.unionByName(told).groupBy("hub", "block", "part", "id").agg(F.max("ask").alias("ask")))
        label = components(links.unionByName(_verified(met, ["hub", "block", "part"], sketch, docs, words, percent, k, least)))

    same = found.select("doc_id", "n_shingles", "k1", "k2").join(copies, ["k1", "k2"], "left")
    node = F.when(F.col("n_shingles") > 0, F.coalesce("rep", "doc_id")).otherwise(F.col("doc_id"))
    ids = same.withColumn("rep", node)
    by_set = ids.join(label.withColumnRenamed("id", "rep"), "rep", "left")
    return by_set.select("doc_id", "n_shingles", F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "rep", "doc_id")).alias("component_id")).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs, all columns as they are, without those that have a near duplicate of smaller doc_id in their group."""
    gone = near_duplicates(docs, **options).where("not kept").select("doc_id").distinct()
    return without(docs, cut(gone))
