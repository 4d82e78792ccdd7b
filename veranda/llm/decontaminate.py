"""Benchmark decontamination with suffix arrays of the training data.

Each shard of documents (about 1 MB of text, whole documents) gets a suffix array over its words, made by prefix doubling in
numpy: sort by the first two words, then re-sort only what is still tied by 4, 8 and 16 words. The suffixes of every benchmark item
are looked up by binary search, which yields the range of training suffixes that begin with them, the longest verbatim match and
its places. A document is always whole within its shard, so hits are summed in the same task and nothing is shuffled.
Benchmark items are handed out in blocks of at most block_bytes; a worker holds one block at a time, whatever the benchmark's size, and takes
each block to SHARDS shards before it lets go of it. Which windows are worth a search is told by their first words (four, or fewer in short items):
a shard's hashes of these are looked up in a block's sorted ones, so a shard costs its words times the logarithm of a block, whatever is in it.

Odd rows: null or wordless texts have no words and no hits; wordless items never occur; repeated rows and items count each by
itself (items with equal item_id count once in items); items without item_id count for hits and matches, but aren't in items; other columns are passed over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, cut, map_arrow, without
from .kernels import NOT_ALNUM, U64, batches, ragged, window_hashes, words

WINDOW, BLOCK_BYTES, SHARDS, LEAD = 10, 1 << 23, 8, 4


def suffix_array(token: np.ndarray, depth: int = WINDOW) -> np.ndarray:
    """The order of all suffixes of token (ranks from 0) by their first words, as many as the power of two at or over depth."""
    n = len(token)
    if n < 2:
        return np.arange(n)
    top = int(token.max()) + 2
    after = np.append(token[1:], -1) + 1
    key = token * top + after
    order = np.argsort(key, kind="stable")
    key = key[order]
    new = np.concatenate(([True], key[1:] != key[:-1]))
    place = np.maximum.accumulate(np.where(new, np.arange(n), 0))  # where a suffix's group begins
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = place, -1
    k = 2
    while k < depth:
        size_one = new & np.append(new[1:], True)
        slots = np.flatnonzero(~size_one)
        if not len(slots):
            break
        some = order[slots]
        key = rank[some] * (n + 1) + rank[np.minimum(some + k, n)] + 1
        o = np.argsort(key, kind="stable")
        some, key = some[o], key[o]
        order[slots] = some
        fresh = np.concatenate(([True], key[1:] != key[:-1]))
        new[slots] = fresh
        rank_of = slots[np.maximum.accumulate(np.where(fresh, np.arange(len(slots)), 0))]
        rank[some] = rank_of
        k *= 2
    return order


class Shard:
    """The words of some texts and their suffix array."""

    def __init__(self, texts: list[bytes], depth: int = WINDOW):
        h, at, _, _ = words(texts, NOT_ALNUM, lower=True)
        self.vocabulary, token = np.unique(h, return_inverse=True)
        n = np.diff(at)
        self.begin = at[:-1] + np.arange(len(texts))  # a stop of rank 0 follows each text
        self.token = np.zeros(len(h) + len(texts), np.int64)
        self.token[np.arange(len(h)) + np.repeat(np.arange(len(texts)), n)] = token + 1
        self.n_words, self.order = n, suffix_array(self.token, depth)
        self.hashes = h
        self.base = len(self.vocabulary) + 2
        self.two = self.token[self.order] * self.base + np.append(self.token, 0)[self.order + 1]

    def ranks(self, h: np.ndarray) -> np.ndarray:
        """The rank of each word here, -1 for words that don't occur."""
        if not len(self.vocabulary):
            return np.full(len(h), -1)
        i = np.minimum(np.searchsorted(self.vocabulary, h), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[i] == h, i + 1, -1)

    def _word(self, slot: np.ndarray, d: int) -> np.ndarray:
        i = self.order[slot] + d
        return np.where(i < len(self.token), self.token[np.minimum(i, len(self.token) - 1)], -1)

    def _bound(self, lo: np.ndarray, hi: np.ndarray, d: int, want: np.ndarray, right: bool) -> np.ndarray:
        """Binary search for word d of each query in its range of suffixes, which agree up to there."""
        lo, hi = lo.copy(), hi.copy()
        while (go := lo < hi).any():
            mid = (lo + hi) // 2
            have = self._word(np.minimum(mid, len(self.order) - 1), d)
            up = go & ((have <= want) if right else (have < want))
            lo = np.where(up, mid + 1, lo)
            hi = np.where(go & ~up, mid, hi)
        return lo

    def ranges(self, query: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """query: ranks (rows of words, -1 beyond the length or if unknown). The range of suffixes that begin with the longest
        prefix of each query that occurs, and that prefix's length."""
        lo, hi, best = (np.zeros(len(query), np.int64) for _ in range(3))
        if not len(self.order) or not len(query):
            return lo, hi, best
        first = np.searchsorted(self.token[self.order], query[:, 0], "left"), np.searchsorted(self.token[self.order], query[:, 0], "right")
        known = (query[:, 0] > 0) & (length > 0) & (first[0] < first[1])
        lo[known], hi[known], best[known] = first[0][known], first[1][known], 1
        go = np.flatnonzero(known & (length > 1))
        if len(go) and query.shape[1] > 1:
            key = query[go, 0] * self.base + query[go, 1]
            a, b = np.searchsorted(self.two, key, "left"), np.searchsorted(self.two, key, "right")
            ok = (a < b) & (query[go, 1] > 0)
            go, a, b = go[ok], a[ok], b[ok]
            lo[go], hi[go], best[go] = a, b, 2
            for d in range(2, query.shape[1]):
                go = go[(length[go] > d) & (query[go, d] > 0)]
                if not len(go):
                    break
                a = self._bound(lo[go], hi[go], d, query[go, d], False)
                b = self._bound(a, hi[go], d, query[go, d], True)
                ok = a < b
                go, a, b = go[ok], a[ok], b[ok]
                lo[go], hi[go], best[go] = a, b, d + 1
        return lo, hi, best


class Queries:
    """All windows of some items, each as its first word and length, sorted by the hash of its leading words."""

    def __init__(self, ids: list[int | None], texts: list[bytes], window: int):
        self.h, at, _, _ = words(texts, NOT_ALNUM, lower=True)
        self.window = window
        self.ids, self.named = np.array([0 if x is None else x for x in ids], np.int64), np.array([x is not None for x in ids], bool)
        n = np.diff(at)
        count = np.where(n >= window, n - window + 1, np.minimum(n, 1))
        self.own = np.repeat(np.arange(len(texts)), count)
        self.first = ragged(at[:-1], count)
        self.start = self.first - at[:-1][self.own]
        self.length = np.minimum(n[self.own], window)
        self.leads = []
        for k in range(1, LEAD + 1):
            some = np.flatnonzero(np.minimum(self.length, LEAD) == k)
            keys = window_hashes(self.h, k)[self.first[some]] if len(some) else np.zeros(0, U64)
            order = np.argsort(keys, kind="stable")
            self.leads.append((keys[order], some[order]))

    def near(self, shard: Shard) -> np.ndarray:
        """The windows whose leading words follow one another in the shard."""
        out = [np.zeros(0, np.int64)]
        for k, (keys, some) in enumerate(self.leads, 1):
            if len(keys):
                have = window_hashes(shard.hashes, k)  # also over bounds of texts, which does no harm
                at = np.searchsorted(keys, have)
                have = np.unique(have[keys[np.minimum(at, len(keys) - 1)] == have])
                lo, hi = np.searchsorted(keys, have, "left"), np.searchsorted(keys, have, "right")
                out.append(some[ragged(lo, hi - lo)])
        return np.sort(np.concatenate(out))

    def hashes(self, some: np.ndarray) -> np.ndarray:
        i = self.first[some][:, None] + np.arange(self.window)
        return np.append(self.h, np.zeros(1, U64))[np.minimum(i, len(self.h))]


def _ranks(shard: Shard, hashes: np.ndarray, length: np.ndarray) -> np.ndarray:
    flat = shard.ranks(hashes.ravel()).reshape(hashes.shape) if hashes.size else hashes.astype(np.int64)
    return np.where(np.arange(hashes.shape[1]) < length[:, None], flat, -1)


class Hits:
    """What has been found in a shard so far."""

    def __init__(self, ids: pa.Array, texts: list[bytes], window: int):
        self.ids, self.shard = ids, Shard(texts, window)
        self.hit = np.zeros(len(self.shard.token) + 1, np.int64)
        self.pair, self.found = [np.zeros((0, 2), np.int64)], [np.zeros((6, 0), np.int64)]

    def search(self, q: Queries) -> None:
        s, some = self.shard, q.near(self.shard)
        length = q.length[some]
        lo, hi, best = s.ranges(_ranks(s, q.hashes(some), length), length)
        k = np.flatnonzero((best == length) & (length > 0))
        at = s.order[ragged(lo[k], hi[k] - lo[k])]
        w = some[np.repeat(k, hi[k] - lo[k])]
        if not len(w):
            return
        np.add.at(self.hit, at, 1)
        np.add.at(self.hit, at + q.length[w], -1)
        of = np.searchsorted(s.begin, at, "right") - 1
        k = q.named[q.own[w]]
        self.pair.append(np.unique(np.stack((of[k], q.ids[q.own[w[k]]]), 1), axis=0))
        o = np.lexsort((q.start[w], at - q.start[w], q.own[w]))
        at, w, of = at[o], w[o], of[o]
        own, start = q.own[w], q.start[w]
        same = (own[1:] == own[:-1]) & (at[1:] == at[:-1] + 1) & (start[1:] == start[:-1] + 1)
        a0, a1 = np.flatnonzero(np.append(True, ~same)), np.flatnonzero(np.append(~same, True))
        self.found.append(np.stack((of[a0], at[a0] - s.begin[of[a0]], q.ids[own[a0]], q.named[own[a0]], start[a0], a1 - a0 + q.length[w[a0]])))

    def rows(self) -> pa.RecordBatch:
        s, n = self.shard, len(self.ids)
        cover = (np.cumsum(self.hit)[:-1] > 0).astype(np.int8)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], cover, [0])))).reshape(-1, 2)
        doc = np.searchsorted(s.begin, edge[:, 0], "right") - 1
        n_hit = np.bincount(doc, edge[:, 1] - edge[:, 0], n).astype(np.int64)
        ends = lambda of: pa.array(np.concatenate(([0], np.cumsum(np.bincount(of, minlength=n)))).astype(np.int32))
        edge = edge - s.begin[doc][:, None]
        spans = pa.ListArray.from_arrays(ends(doc), pa.StructArray.from_arrays([pa.array(edge[:, 0]), pa.array(edge[:, 1])], ["from", "to"]))
        both = np.unique(np.concatenate(self.pair), axis=0)
        m = np.concatenate(self.found, axis=1)
        m = m[:, np.lexsort(m[[4, 2, 1, 0]])]
        matches = pa.ListArray.from_arrays(ends(m[0]), pa.StructArray.from_arrays([pa.array(m[2], mask=m[3] == 0), pa.array(m[4]), pa.array(m[1]), pa.array(m[5])], ["item", "item_from", "from", "length"]))
        return pa.RecordBatch.from_arrays([self.ids, pa.array(s.n_words.astype(np.int64)), pa.array(n_hit), pa.ListArray.from_arrays(ends(both[:, 0]), pa.array(both[:, 1])), spans, matches], ["doc_id", "n_words", "n_hit", "items", "spans", "matches"])


def _blocks(benchmark: DataFrame, block_bytes: int) -> list:
    """Broadcasts of (item ids, texts), each of at most about block_bytes, read one after another."""
    sc, out, ids, texts, size = benchmark.sparkSession.sparkContext, [], [], [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), F.col("text").cast("string")).where("text is not null").toLocalIterator():
        body = r[1].encode()
        if ids and size + len(body) > block_bytes:
            out.append(sc.broadcast((ids, texts)))
            ids, texts, size = [], [], 0
        ids.append(r[0])
        texts.append(body)
        size += len(body)
    return [*out, sc.broadcast((ids, texts))] if ids else out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans, matches) per row of docs: the sorted item_ids of which a window occurs verbatim, the
    merged [from, to) word ranges that they cover, and each verbatim match of a window or more at its whole length (item, item_from, from, length in
    words). All windows of an item are looked up, so a longer match is a run of hits one word apart on both sides."""
    blocks = _blocks(benchmark, block_bytes)
    last: dict[int, Queries] = {}

    def queries(i: int) -> Queries:
        if i not in last:
            last.clear()
            last[i] = Queries(*blocks[i].value, window)
            blocks[i].__dict__.pop("_value", None)  # it can be read again from where the executor keeps it
        return last[i]

    def flush(held: list[Hits]) -> Iterator[pa.RecordBatch]:
        for i in range(len(blocks)):
            q = queries(i)
            for x in held:
                x.search(q)
        yield from (x.rows() for x in held)
        held.clear()

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[Hits] = []
        for batch in source:
            texts = as_bytes(batch.column(1))
            for a, b in batches(texts):  # a suffix array takes tens of bytes a word
                held.append(Hits(batch.column(0)[a:b], texts[a:b], window))
                if len(held) >= (SHARDS if len(blocks) > 1 else 1):
                    yield from flush(held)
        yield from flush(held)

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_words long, n_hit long, items array<long>, spans array<struct<from: long, to: long>>, matches array<struct<item: long, item_from: long, from: long, length: long>>")


def longest_matches(texts: list[bytes], items: list[bytes], limit: int | None = None) -> list[tuple[int, int, int, int, int]]:
    """For each suffix of each item its longest verbatim match in the texts (of at most limit words, if given):
    (item, first word, length, text, first word there). A plain function for reports on a few texts."""
    h, at, _, _ = words(items, NOT_ALNUM, lower=True)
    limit = limit or max(2, int(np.diff(at).max(initial=0)))
    s = Shard(texts, limit)
    own = np.repeat(np.arange(len(items)), np.diff(at))
    length = np.minimum(at[own + 1] - np.arange(len(h)), limit)
    i = np.arange(len(h))[:, None] + np.arange(limit)
    lo, _, best = s.ranges(_ranks(s, np.append(h, np.zeros(1, h.dtype))[np.minimum(i, len(h))], length), length)
    out = []
    for q in np.flatnonzero(best):
        place = int(s.order[lo[q]])
        t = int(np.searchsorted(s.begin, place, "right") - 1)
        out.append((int(own[q]), int(q - at[own[q]]), int(best[q]), t, place - int(s.begin[t])))
    return out


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs, all columns as they are, without documents that hold a window of an item."""
    bad = contamination(docs, benchmark, window).where("n_hit > 0").select("doc_id").distinct()
    return without(docs, cut(bad))
