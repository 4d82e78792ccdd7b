"""Token ids in shards with a minimal perfect hash index.

write() encodes documents in ascending doc_id order and writes a table of shards, one row each, by Spark's own writer (so that any
store will do and a lost executor's task is simply run again):

    part, shard   the partition and the shard's number in it; ascending in both is ascending in doc_id
    before, n_ids ids of the partition before the shard, ids in it
    payload       the ids one after another, raw little-endian unsigned 16-bit or 32-bit integers (width)
    index         magic, number of keys and of buckets, salt, then uint32 seeds by bucket, uint64 fingerprints, uint64 offsets and uint32 lengths by slot

A document is found in constant time: its key's hash picks a bucket, the bucket's seed and the hash pick the slot, the slot's
fingerprint tells whether the key is there at all (a stranger passes with probability 2**-64), and the slot's offset and length
bound its ids; nothing is searched or sorted. The hash is minimal: n keys take n slots. It is built bucket by bucket, largest first, trying seeds until
the bucket's keys fall into free slots. Should two keys of a shard be equal, it takes another salt.

Odd rows: a null or empty text is its end id alone; rows that share a doc_id, or have none, are numbered in a shard by a hash of their text and
have keys by id and number; however many they are, they may go to several partitions; null ids come first; other columns are passed over."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow
from .kernels import U64, batches, mix
from .tokens import encoder

MAGIC, HEADER = b"VTO3", struct.Struct("<4sIIQ")


def keys_of(ids: np.ndarray, copies: np.ndarray, null: np.ndarray, salt: int) -> np.ndarray:
    """The 64-bit key of each (doc_id, copy, whether the id is null); a bijection of the id for each copy."""
    with np.errstate(over="ignore"):
        other = mix((copies.astype(U64) << U64(1) | null.astype(U64)) * U64(0x9E3779B97F4A7C15) + U64(salt))
        return mix(np.where(null, 0, ids).astype(np.int64).view(U64) ^ other)


def different_keys(ids: np.ndarray, copies: np.ndarray, null: np.ndarray, tries: int = 64) -> tuple[np.ndarray, int]:
    """Keys of different (doc_id, copy, null) that are different, and their salt."""
    for salt in range(tries):
        keys = keys_of(ids, copies, null, salt)
        if len(np.unique(keys)) == len(keys):
            return keys, salt
    raise ValueError("equal documents in a shard's index")


def _slot(keys: np.ndarray, seeds: np.ndarray, n: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return (mix(keys ^ mix(seeds.astype(U64) + U64(0x632BE59BD9B4E019))) % U64(n)).astype(np.int64)


def build_index(keys: np.ndarray, offsets: np.ndarray, lengths: np.ndarray, salt: int = 0) -> bytes:
    """keys: different 64-bit keys; offsets, lengths: where each one's ids begin, and their number."""
    n = len(keys)
    if len(np.unique(keys)) < n:
        raise ValueError("equal keys have no perfect hash")
    m = max(1, (n + 3) // 4)
    bucket = (mix(keys) % U64(m)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[order], np.arange(m + 1))
    size = np.diff(at)
    seeds, taken = np.zeros(m, np.uint32), np.zeros(n, bool)
    slots = np.zeros(n, np.int64)
    tries = np.arange(256)
    for b in np.argsort(-size, kind="stable"):
        own = order[at[b] : at[b + 1]]
        if not len(own):
            break
        base = 0
        while True:
            place = _slot(keys[own][None, :], (base + tries)[:, None], n)
            ok = ~taken[place].any(1)
            if len(own) > 1:
                ok &= (np.diff(np.sort(place, 1), axis=1) != 0).all(1)
            if ok.any():
                t = int(np.argmax(ok))
                seeds[b] = base + t
                taken[place[t]] = True
                slots[own] = place[t]
                break
            base += len(tries)
    prints, where, long = np.zeros(n, "<u8"), np.zeros(n, "<u8"), np.zeros(n, "<u4")
    prints[slots], where[slots], long[slots] = mix(keys + U64(1)), offsets, lengths
    return HEADER.pack(MAGIC, n, m, salt) + seeds.astype("<u4").tobytes() + prints.tobytes() + where.tobytes() + long.tobytes()


class Shard:
    """Keyed access to the ids of one shard."""

    def __init__(self, payload: bytes, index: bytes, width: int):
        magic, self.n, m, self.salt = HEADER.unpack_from(index)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        self.ids = np.frombuffer(payload, f"<u{width}")
        self.seeds = np.frombuffer(index, "<u4", m, HEADER.size)
        self.prints = np.frombuffer(index, "<u8", self.n, HEADER.size + 4 * m)
        self.offsets = np.frombuffer(index, "<u8", self.n, HEADER.size + 4 * m + 8 * self.n)
        self.lengths = np.frombuffer(index, "<u4", self.n, HEADER.size + 4 * m + 16 * self.n)

    def find(self, doc_ids: np.ndarray, copies: np.ndarray | None = None, null: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(from, to) of each document's ids in the shard; -1, -1 if it isn't there."""
        zeros = np.zeros(len(doc_ids), np.int64)
        keys = keys_of(doc_ids, zeros if copies is None else copies, zeros.astype(bool) if null is None else null, self.salt)
        slot = _slot(keys, self.seeds[(mix(keys) % U64(len(self.seeds))).astype(np.int64)], self.n)
        start = self.offsets[slot].astype(np.int64)
        there = self.prints[slot] == mix(keys + U64(1))
        return np.where(there, start, -1), np.where(there, start + self.lengths[slot], -1)

    def get(self, doc_id: int) -> np.ndarray | None:
        lo, hi = self.find(np.array([doc_id]))
        return None if lo[0] < 0 else self.ids[lo[0] : hi[0]]


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int) -> None:
    """Shards of docs(doc_id, text, ...) at path, about 2 MB of text each."""
    schema = "part int, shard int, before long, n_ids long, width int, first_id long, last_id long, doc_ids binary, payload binary, index binary"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, shard, before = context.partitionId() if context else 0, 0, 0
        enc = encoder(tokenizer)
        last, copy = None, 0
        for batch in source:
            doc_ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for a, b in batches(texts):
                ids, at = enc.encode(texts[a:b])
                n = b - a
                out = np.full(len(ids) + n, end_id, np.uint16)
                begin = at[:-1] + np.arange(n)
                out[np.delete(np.arange(len(out)), at[1:] + np.arange(n))] = ids
                null = np.array([x is None for x in doc_ids[a:b]], bool)
                own = np.array([0 if x is None else x for x in doc_ids[a:b]], np.int64)
                copies = np.zeros(n, np.int64)
                for i, x in enumerate(doc_ids[a:b]):  # repeated ids are neighbours
                    copy = copy + 1 if (shard or i) and x == last else 0
                    copies[i], last = copy, x
                keys, salt = different_keys(own, copies, null)
                known = own[~null]
                row = (part, shard, before, len(out), 2, int(known[0]) if len(known) else None, int(known[-1]) if len(known) else None, np.stack((own, copies, null), 1).astype("<i8").tobytes(), out.astype("<u2").tobytes(), build_index(keys, begin, np.diff(begin, append=len(out)), salt))
                yield pa.RecordBatch.from_arrays([pa.array([x], k) for x, k in zip(row, kinds, strict=True)], names)
                before += len(out)
                shard += 1

    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).withColumn("h", F.xxhash64("text")).withColumn("row", F.monotonically_increasing_id())
    order = ("doc_id", "h", "row")  # the row's number lets equal ids, and equal rows, be split
    map_arrow(texts.repartitionByRange(*order).sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text"), run, schema, encodes=True).write.parquet(path)


def documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of each document, read back through each shard's index. start counts the ids of all
    documents before it: the sum over earlier partitions (one row for each), the shard's own count, and the offset."""
    shards = spark.read.parquet(path)
    totals = shards.groupBy("part").agg(F.sum("n_ids").alias("n"))
    starts = totals.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("base"))

    def run(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        for base, width, listed, payload, index in zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True):
            s = Shard(payload, index, width)
            own = np.frombuffer(listed, "<i8").reshape(-1, 3)
            lo, hi = s.find(own[:, 0], own[:, 1], own[:, 2] != 0)
            if (lo < 0).any():
                raise ValueError("a document is missing from its shard's index")
            wide = s.ids.astype("<u4")
            crc = [zlib.crc32(wide[a:b]) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(own[:, 0], mask=own[:, 2] != 0), pa.array(lo + base), pa.array(hi - lo), pa.array(crc, pa.int64())], ["doc_id", "start", "n_tokens", "ids_crc32"])

    def each(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches_:
            for i in range(b.num_rows):
                yield from run(b.slice(i, 1))

    rows = shards.select("part", "before", "width", "doc_ids", "payload", "index").join(starts, "part")
    return map_arrow(rows.select((F.col("base") + F.col("before")).alias("base"), "width", "doc_ids", "payload", "index"), each, "doc_id long, start long, n_tokens long, ids_crc32 long")


def lookup(spark: SparkSession, path: str, doc_id: int) -> list[int] | None:
    """The ids of one document: only the shards whose id range holds it are read, and of these only their rows."""
    rows = spark.read.parquet(path).where((F.col("first_id") <= doc_id) & (F.col("last_id") >= doc_id)).select("payload", "index", "width").toLocalIterator()
    for payload, index, width in rows:
        if (ids := Shard(bytes(payload), bytes(index), width).get(doc_id)) is not None:
            return ids.tolist()
    return None
