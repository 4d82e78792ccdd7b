"""Document fingerprints by consistent weighted sampling.

A text is a weighted set: its runs of `n` words (lower-cased A-Z) with their counts; a text of fewer words is one term. For sample k
each term has its own r ~ Gamma(2, 1), c ~ Gamma(2, 1) and b ~ U(0, 1); with t = floor(ln w / r + b) and y = exp(r (t - b)) the term's
rank is a = c / (y exp(r)), and the sample is the (term, t) of lowest rank. Two texts have equal samples with a probability that is
their generalised Jaccard similarity, sum of minima over sum of maxima of the weights. A fingerprint is `k` samples of 64 bits as hex.

r, ln c and b come from one table of 65,536 draws, indexed by the first 16 bits of a hash of the term and the sample; ranks that tie (from
equal draws, as in very long texts) are ordered by the other 48 bits, so that the choice stays consistent and fair, and these name the
sample as well. For a count of 1, t = 0 and ln a = ln c + r b - r, which the table has ready.

Odd rows: null counts as empty; a text without words has the fingerprint of zeros, alike (1.0) with its like and 0.0 with others;
rows that share a doc_id follow one another by text; rows without doc_id come last. Other columns are passed over."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow
from .kernels import SPACE, U64, mix, window_hashes, words

K, N = 64, 2
#: Text of a bucket, on average.
BUCKET_BYTES = 1 << 28


def _draws(size: int = 1 << 16, seed: int = 20240229) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    g = np.random.Generator(np.random.PCG64(seed))
    return g.gamma(2.0, 1.0, size).astype(np.float32), np.log(g.gamma(2.0, 1.0, size)).astype(np.float32), g.random(size, np.float32)


class Sampler:
    """The table is in ascending order of the rank of a term that occurs once, so that for such terms, by far the most, the
    16 bits of the hash are the rank, and no draw has to be looked up."""

    def __init__(self, k: int = K, n: int = N):
        self.k, self.n = k, n
        r, lnc, b = _draws()
        single = lnc + r * b - r
        order = np.argsort(single, kind="stable")
        self.r, self.lnc, self.b, self.single = r[order], lnc[order], b[order], single[order]
        g = np.random.Generator(np.random.PCG64(7))
        self.factors = g.integers(0, 1 << 63, k, dtype=U64) << U64(1) | U64(1)

    def terms(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Distinct term hashes and their counts."""
        h, _, _, _ = words([text], SPACE, lower=True)
        if not len(h):
            return h, np.zeros(0, np.int64)
        return np.unique(window_hashes(h, min(self.n, len(h))), return_counts=True)

    def sample(self, terms: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """The k samples of one weighted set, each 16 bits of its rank and 48 that name the term (and t); zeros if the set is empty."""
        best = np.full(self.k, np.iinfo(U64).max, U64)
        if not len(terms):
            return np.zeros(self.k, U64)
        one = counts == 1
        with np.errstate(over="ignore"):
            for kind in (True, False):
                some = np.flatnonzero(one == kind)
                for at in range(0, len(some), 1 << 11):  # long texts go some terms at a time
                    own = some[at : at + (1 << 11)]
                    h = terms[own][None, :] * self.factors[:, None]
                    if not kind:
                        i = (h >> U64(48)).astype(np.intp)
                        r, b = self.r[i], self.b[i]
                        t = np.floor(np.log(counts[own]).astype(np.float32)[None, :] / r + b)
                        rank = np.minimum(np.searchsorted(self.single, self.lnc[i] - r * (t - b) - r), 0xFFFF)
                        rank = np.where(t == 0, i, rank).astype(U64)
                        h = rank << U64(48) | ((h + t.astype(U64) * U64(0x9E3779B97F4B)) & U64((1 << 48) - 1))
                    best = np.minimum(best, h.min(1))
        return np.maximum(best, 1)

    def text(self, text: bytes) -> np.ndarray:
        return self.sample(*self.terms(text))


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def hexed(samples: np.ndarray) -> str:
    return samples.astype(">u8").tobytes().hex()


def fingerprints(docs: DataFrame, k: int = K, n: int = N) -> DataFrame:
    """(doc_id, fingerprint) of each row."""
    cache: list[Sampler] = []

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if not cache:
            cache.append(Sampler(k, n))
        for batch in source:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([hexed(cache[0].text(t)) for t in as_bytes(batch.column(1))], pa.string())], ["doc_id", "fingerprint"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, fingerprint string")


def estimate(a, b, k: int = K):
    """Column: the likeness of two fingerprint columns."""
    piece = lambda c, i: F.substring(c, i * 16 + 1, 16)
    return sum(((piece(a, i) == piece(b, i)).cast("double") for i in range(k)), F.lit(0.0)) / k


def neighbours(docs: DataFrame, bucket_bytes: int = BUCKET_BYTES) -> tuple[DataFrame, int]:
    """(bucket, doc_id, text, extra) and the number of buckets: every document in the bucket of its doc_id's range, and the first of the next bucket
    (the largest doc_id below) once more with extra set, so that each bucket holds its documents' successors in descending order.

    The buckets' bounds come from quantiles, the borrowed rows from one aggregated row per bucket; only texts in one shuffle move. A row's
    bucket is found by binary search. There are so many buckets that one holds bucket_bytes of text on average, and at least as many as partitions."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    parts = max(2, int(spark.conf.get("spark.sql.shuffle.partitions")), total // bucket_bytes)
    cuts = np.array(sorted(set(docs.where("doc_id is not null").approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.2 / parts))))
    # buckets count up as doc_ids go down; null ids have the last
    @F.pandas_udf("int")
    def bucket(ids: pd.Series) -> pd.Series:
        return pd.Series(np.where(ids.isna(), len(cuts) + 1, len(cuts) - np.searchsorted(cuts, ids.fillna(0).to_numpy(np.float64), "right")).astype(np.int32))

    keyed = docs.withColumn("bucket", bucket("doc_id"))
    tops = docs.select("doc_id", bucket("doc_id").alias("bucket")).groupBy("bucket").agg(F.max("doc_id").alias("top")).orderBy("bucket").collect()  # a row per bucket
    if not tops:
        return keyed.withColumn("extra", F.lit(False)), 1
    # the largest id of each bucket is lent to the bucket before it, the first bucket's to the last one
    lent = spark.createDataFrame([(r["top"], tops[i - 1]["bucket"]) for i, r in enumerate(tops)], "top long, to int")
    rows = keyed.join(F.broadcast(lent), F.col("doc_id").eqNullSafe(F.col("top")), "left")  # a row per bucket
    own = F.array(F.struct(F.col("bucket"), F.lit(False).alias("extra")))
    copies = F.when(F.col("to").isNotNull(), F.concat(own, F.array(F.struct(F.col("to").alias("bucket"), F.lit(True).alias("extra"))))).otherwise(own)
    return rows.withColumn("x", F.explode(copies)).select(F.col("x.bucket").alias("bucket"), "doc_id", "text", F.col("x.extra").alias("extra")), len(cuts) + 2


def compare_edited(docs: DataFrame, k: int = K, n: int = N) -> DataFrame:
    """For each document its fingerprint, that of its edited text (the last half replaced by the beginning of the next document in
    descending doc_id; after the last comes the first) and the likeness to the edited and to the next text."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
    cache: list[Sampler] = []

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows by bucket, not extra before extra, doc_id descending: each row's successor is the next row; the extra ones only end a bucket."""
        if not cache:
            cache.append(Sampler(k, n))
        s = cache[0]
        held = None
        for batch in source:
            rows = []
            for bucket, doc, text, extra in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                if extra and (held is None or held[0] != bucket):
                    continue  # rows that share the lent id: only the first is a successor
                now = (bucket, doc, text, s.text(text))
                if held is not None and held[0] == bucket:
                    rows.append(edited(s, held, now))
                held = None if extra else now
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    def edited(s: Sampler, own: tuple, following: tuple) -> tuple:
        text, other = own[2].decode(), following[2].decode()
        half = len(text) // 2
        new = (text[: len(text) - half] + other[:half]).encode()
        print_ = s.text(new)
        return own[1], len(text), hashlib.sha256(new).hexdigest(), hexed(own[3]), hexed(print_), likeness(own[3], print_), likeness(own[3], following[3])

    order = [F.col("bucket"), F.col("extra"), F.col("doc_id").desc_nulls_last(), F.col("text")]
    rows, n = neighbours(docs)
    return map_arrow(rows.repartitionById(n, "bucket").sortWithinPartitions(*order).select("bucket", "doc_id", "text", "extra"), run, schema)
