"""Removal of repeated passages: seed and extend.

A window is `length` consecutive words of one document. Every window has an anchor, its smallest hash of `seed` consecutive
words (the leftmost if it occurs twice). The choice depends on the window's words only, so equal windows have equal anchors
at equal places; consecutive windows mostly share theirs, and each anchor is stored once, with the run of windows around it
(about one for seven words).

1. seeds: anchors whose hash occurs once are dropped, by a count with partial sums;
2. extension: the run of windows around an anchor reaches from its first window's first word to its last window's last one.
   Occurrences with equal words all over that reach form a class; all but the earliest of a class repeat every window of it;
3. only where an anchor has several classes their windows are compared: the earliest occurrence of each class is fetched,
   its windows are hashed (128 bits) and each is tested for an earlier equal one;
4. the windows that repeat are joined to maximal runs in each document, and their words are removed.

No pair of occurrences is ever listed: classes and windows are reduced by minimum with partial sums, so a passage that a third
of the documents share costs no more than others. Word, seed and window hashes have 64 bits and are compared two at a time.

Joins by a seed, a span or a window have their keys from an exchange of their own, so that a very common one's rows may be split.

Odd rows: null text has no words; rows without doc_id are returned whole; rows that share doc_id and text count as the same place, so
repeated rows don't remove one another; texts that share a doc_id are documents of their own, in the order of a hash of the text. Other columns
are passed over."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, ids_in_buckets, map_batches
from .kernels import U64, WORD_POWERS, WORD_POWERS2, batches, mix, prefix_sums, ragged, range_hashes, window_hashes, words

LENGTH, SEED = 20, 8
#: A place is (variant << VARIANT | first window << 8 | number of windows); the variant tells texts of one doc_id apart.
VARIANT = 42


def variants(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text) with a column variant: 0, but for texts that share their doc_id with others, which are numbered."""
    several = cut(docs.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("c")).where("c > 1").select("doc_id"))
    none = docs.withColumn("variant", F.lit(0).cast("long"))
    if several.isEmpty():
        return none
    hashed = F.xxhash64(F.coalesce("text", F.lit("")))
    near = docs.join(several, "doc_id", "left_semi").withColumn("h", hashed)
    number = F.row_number().over(Window.partitionBy("doc_id").orderBy("h")) - 1  # of a doc_id's different texts
    numbered = cut(near.select("doc_id", "h").distinct().withColumn("variant", number.cast("long")))
    return none.join(several, "doc_id", "left_anti").unionByName(near.join(numbered, ["doc_id", "h"]).select("doc_id", "text", "variant"))


def _rekeyed(df: DataFrame, column: str) -> DataFrame:
    """df with another name for a column's values. What has been grouped by the column is dealt out anew for a join by this one, which
    lets Spark split the other side's large partitions."""
    return df.withColumn("key", F.col(column).bitwiseXOR(F.lit(1 << 40)))


def runs(h: np.ndarray, at: np.ndarray, length: int = LENGTH, seed: int = SEED):
    """Of the words of some texts (hashes h, text i from at[i] to at[i + 1]): for each anchor the first window that chose it,
    the number of windows that did, the anchor's distance from the first, the anchor's hash."""
    width = length - seed + 1
    g = window_hashes(h, seed)
    n = len(h) - length + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, U64),)
    best, place = g[:n].copy(), np.zeros(n, np.int64)
    for j in range(1, width):
        less = g[j : j + n] < best
        best[less] = g[j : j + n][less]
        place[less] = j
    place += np.arange(n)
    own = np.searchsorted(at, np.arange(n), "right") - 1
    whole = np.flatnonzero(np.arange(n) + length <= at[own + 1])
    p = place[whole]
    new = np.ones(len(whole), bool)
    new[1:] = (p[1:] != p[:-1]) | (own[whole[1:]] != own[whole[:-1]])
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(whole)))
    start = whole[first]
    return start, count, p[first] - start, g[p[first]]


def anchors(docs: DataFrame, length: int, seed: int, seeds_only: bool = False) -> DataFrame:
    """(g) or (g, span, doc_id, at) of each anchor: its hash, a hash of its windows' words and of its place among them, and
    where it is, as 256 * first window + number of windows."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, ids, variant = as_bytes(batch.column(1)), batch.column(0).to_numpy(), batch.column(2).to_numpy()
        for a, b in batches(texts):
            h, at, _, _ = words(texts[a:b])
            start, count, off, g = runs(h, at, length, seed)
            if seeds_only:
                yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64))], ["g"])
                continue
            own = np.searchsorted(at, start, "right") - 1
            span = range_hashes(prefix_sums(h, WORD_POWERS2), start, start + count - 1 + length, WORD_POWERS2)
            span = mix(span ^ mix((count << 8 | off).astype(U64)))
            place = variant[a:b][own] << VARIANT | ((start - at[own]) << 8) | count
            yield pa.RecordBatch.from_arrays([pa.array(g.view(np.int64)), pa.array(span.view(np.int64)), pa.array(ids[a:b][own]), pa.array(place)], ["g", "span", "doc_id", "at"])

    return map_batches(docs, run, "g long" if seeds_only else "g long, span long, doc_id long, at long")


def _windows(texts: DataFrame, length: int) -> DataFrame:
    """texts(doc_id, text, variant, picked array<at>) -> (w1, w2, doc_id, place) of the windows of the picked anchors: two hashes, and
    where the window is: its variant and number, and its number among the anchor's."""

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        ids, bodies, variant, picked = batch.column(0).to_numpy(), as_bytes(batch.column(1)), batch.column(2).to_numpy(), batch.column(3)
        for a, b in batches(bodies):
            h, at, _, _ = words(bodies[a:b])
            s1, s2 = prefix_sums(h, WORD_POWERS), prefix_sums(h, WORD_POWERS2)
            part = picked[a:b]
            place = part.flatten().to_numpy()
            own = np.repeat(np.arange(b - a), part.value_lengths().to_numpy())
            count, first = place & 255, at[own] + ((place & ((1 << VARIANT) - 1)) >> 8)
            s, j, of = ragged(first, count), ragged(np.zeros(len(count), np.int64), count), np.repeat(own, count)
            yield pa.RecordBatch.from_arrays([
                pa.array(range_hashes(s1, s, s + length, WORD_POWERS).view(np.int64)), pa.array(range_hashes(s2, s, s + length, WORD_POWERS2).view(np.int64)),
                pa.array(ids[a:b][of]), pa.array(variant[a:b][of] << VARIANT | (s - at[of]) << 8 | j)], ["w1", "w2", "doc_id", "place"])

    return map_batches(texts, run, "w1 long, w2 long, doc_id long, place long")


def repeated_windows(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, variant, first, windows) of variants(): of the windows first, first + 1, ... those repeat an earlier one whose bit is set in windows."""
    if not seed < length or length - seed > 48:
        raise ValueError("seed has to be less than length, by 48 at most")
    docs = docs.where("doc_id is not null")
    often = anchors(docs, length, seed, True).groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    found = cut(_rekeyed(anchors(docs, length, seed), "g").join(_rekeyed(often, "g").select("key"), "key", "left_semi").drop("key"))
    top = F.min(F.struct("doc_id", "at"))
    classes = cut(found.groupBy("g", "span").agg(top.alias("top")).select("g", "span", "top.doc_id", "top.at"))
    several = classes.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g")
    picked = _rekeyed(classes, "g").join(_rekeyed(several, "g").select("key"), "key", "left_semi")
    variant = F.shiftright("at", VARIANT).alias("variant")
    picked = cut(picked.select("doc_id", variant, "at").groupBy("doc_id", "variant").agg(F.collect_list("at").alias("picked")))
    near = ids_in_buckets(docs, "doc_id", picked.select("doc_id"))
    windows = cut(_windows(near.join(picked, ["doc_id", "variant"]).select("doc_id", "text", "variant", "picked"), length))
    low = windows.groupBy("w1", "w2").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", F.shiftright("place", 8).alias("s"))).alias("low")).where("c > 1").drop("c")
    later = _rekeyed(windows, "w1").join(_rekeyed(low, "w1").drop("w1"), ["key", "w2"]).where(F.struct("doc_id", F.shiftright("place", 8).alias("s")) > F.col("low"))
    number = F.col("place").bitwiseAND(255)
    masks = cut(later.select("doc_id", (F.shiftright("place", 8) - number).alias("first"), number.cast("int").alias("j")).distinct().groupBy("doc_id", "first").agg(F.sum(F.expr("shiftleft(1L, j)")).alias("mask")))
    tops = classes.withColumn("first", F.shiftright("at", 8)).join(masks, ["doc_id", "first"], "left").select("g", "span", F.col("doc_id").alias("top_id"), F.col("at").alias("top_at"), "mask")
    everything = F.expr("shiftleft(1L, cast(at & 255 as int)) - 1L")
    marked = found.join(tops, ["g", "span"]).withColumn("windows", F.when((F.col("doc_id") == F.col("top_id")) & (F.col("at") == F.col("top_at")), F.coalesce("mask", F.lit(0))).otherwise(everything))
    return marked.where("windows <> 0").select("doc_id", variant, F.shiftright(F.col("at").bitwiseAND((1 << VARIANT) - 1), 8).alias("first"), "windows")


def remove_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_text, spans) per row; spans are the removed [from, to) word ranges."""
    docs = variants(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")))
    gone = cut(repeated_windows(docs, length, seed).groupBy("doc_id", "variant").agg(F.collect_list(F.struct("first", "windows")).alias("gone")))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        texts, gone = as_bytes(batch.column(1)), batch.column(2)
        for a, b in batches(texts):
            n, removed, kept, spans = [], [], [], []
            for i in range(a, b):
                own, marks = texts[i].split(), gone[i].as_py() or ()
                ranges: list[list[int]] = []
                if marks:
                    hit = np.zeros(len(own) + 1, np.int64)
                    for m in marks:
                        bits, s = m["windows"], m["first"]
                        while bits:
                            if bits & 1 and s + length <= len(own):
                                hit[s] += 1
                                hit[s + length] -= 1
                            bits >>= 1
                            s += 1
                    edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(hit) > 0).astype(np.int8), [0]))))
                    ranges = edge.reshape(-1, 2).tolist()
                left, at = [], 0
                for lo, hi in ranges:
                    left += own[at:lo]
                    at = hi
                left += own[at:]
                n.append(len(own))
                removed.append(len(own) - len(left))
                kept.append(b" ".join(left))
                spans.append([{"from": lo, "to": hi} for lo, hi in ranges])
            yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())])))], ["doc_id", "n_words", "n_removed", "kept_text", "spans"])

    schema = "doc_id long, n_words long, n_removed long, kept_text string, spans array<struct<from: long, to: long>>"
    nothing = F.lit(None).cast("array<struct<first: long, windows: long>>")
    bucket = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    few = F.broadcast(gone.select(bucket.alias("__b")).distinct())  # 2**20 values at most
    keyed = docs.withColumn("__b", bucket)
    whole = keyed.join(few, "__b", "left_anti").select("doc_id", "text", nothing.alias("gone"))
    part = keyed.join(few, "__b", "left_semi").join(gone, ["doc_id", "variant"], "left").select("doc_id", "text", "gone")
    return map_batches(whole.unionByName(part), run, schema)


def digest(kept: str) -> str:
    return hashlib.sha256(kept.encode()).hexdigest()
