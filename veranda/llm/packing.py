"""Cost-balanced packing of token ids into training sequences.

Documents are encoded and packed where they are read: nothing is shuffled. A document's ids (with its end id) are first cut into
whole sequences of `capacity` ids; what is left of each document waits in a block of at most `block` remainders. A block with T ids
fills T // capacity sequences exactly: in descending order each remainder goes to the sequence of lowest estimated cost that
still has room for it, where a piece of n ids costs n + attention * n * n / capacity (the linear layers, and attention within the piece).
A remainder that fits nowhere is cut at the room of the sequence of lowest cost. The T % capacity ids beyond that, the
end of the smallest remainders, become sequences whose lengths are powers of two. So no sequence has padding.

A sequence_id is the task's partition number times 2**33 plus the sequence's number there: a task that is run again gives the
same ids. Odd rows: a null or empty text is its end id alone; repeated rows and null ids are packed like others; other columns
are passed over; a document's offset in the corpus plays no part."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, map_arrow
from .kernels import batches
from .tokens import encoder

CAPACITY, BLOCK, ATTENTION = 1024, 1 << 13, 1.0
#: Bytes of text that are encoded together.
ENCODED = 1 << 19


def powers_of_two(n: int) -> list[int]:
    """Descending different powers of two whose sum is n."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def assign(lengths: list[int], capacity: int = CAPACITY, attention: float = ATTENTION) -> list[tuple[int, int, int, int, int]]:
    """(piece, start in it, length, sequence, offset) that covers each of the pieces (each shorter than capacity) without padding."""
    order = sorted(range(len(lengths)), key=lambda i: (-lengths[i], i))
    over = sum(lengths) % capacity
    whole = sum(lengths) // capacity
    room = np.full(whole, capacity, np.int64)
    cost = np.zeros(whole)
    heap: list[list[tuple[float, int]]] = [[] for _ in range(capacity + 1)]  # by room: sequences by cost
    heap[capacity] = [(0.0, s) for s in range(whole)]
    top = np.full(capacity + 1, np.inf)  # the lowest cost at each room
    if whole:
        top[capacity] = 0.0
    out = []
    spare: list[tuple[int, int, int]] = []
    # the ids over a multiple of capacity come off the end of the order
    rest = {}
    left = over
    for i in reversed(order):
        take = min(left, lengths[i])
        if take:
            rest[i] = take
            spare.append((i, lengths[i] - take, take))
        left -= take
        if not left:
            break

    from heapq import heappop, heappush

    def put(i: int, start: int, n: int, r: int) -> None:
        c, s = heappop(heap[r])
        top[r] = heap[r][0][0] if heap[r] else np.inf
        out.append((i, start, n, s, capacity - r))
        room[s] = r - n
        cost[s] = c + n + attention * n * n / capacity
        if r > n:
            heappush(heap[r - n], (cost[s], s))
            top[r - n] = heap[r - n][0][0]

    for i in order:
        start, n = 0, lengths[i] - rest.get(i, 0)
        while n:
            fits = int(np.argmin(top[n:])) + n
            if top[fits] < np.inf:
                put(i, start, n, fits)
                break
            r = int(np.argmin(top[1:])) + 1
            put(i, start, r, r)
            start, n = start + r, n - r
    s = whole
    for size in powers_of_two(over):
        offset = 0
        while offset < size:
            i, start, n = spare.pop()
            take = min(n, size - offset)
            out.append((i, start, take, s, offset))
            offset += take
            if take < n:
                spare.append((i, start + take, n - take))
        s += 1
    return out


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, block: int = BLOCK, attention: float = ATTENTION) -> DataFrame:
    """(doc_id, start, length, ids, doc_tokens, sequence_id, offset) of each piece of docs(doc_id, text, ...)."""
    schema = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"
    names = [x.split()[0] for x in schema.split(", ")]

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 33
        enc = encoder(tokenizer)
        count, rows, waiting = 0, [], []

        def flush():
            nonlocal count, waiting
            placed = assign([len(x[2]) for x in waiting], capacity, attention)
            for i, start, n, s, offset in placed:
                doc, before, ids, total = waiting[i]
                rows.append((doc, before + start, n, ids[start : start + n].astype("<u4").tobytes(), total, base + count + s, offset))
            count += max((x[3] for x in placed), default=-1) + 1
            waiting = []

        def emit():
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            rows.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if n == "ids" else pa.int64()) for c, n in zip(columns, names, strict=True)], names)

        for batch in source:
            doc_ids, texts = batch.column(0).to_pylist(), as_bytes(batch.column(1))
            for a, b in batches(texts, ENCODED):
                ids, at = enc.encode(texts[a:b])
                for i in range(a, b):
                    own = np.append(ids[at[i - a] : at[i - a + 1]], np.uint16(end_id))
                    n = len(own)
                    for start in range(0, n - n % capacity, capacity):
                        rows.append((doc_ids[i], start, capacity, own[start : start + capacity].astype("<u4").tobytes(), n, base + count, 0))
                        count += 1
                    if n % capacity:
                        waiting.append((doc_ids[i], n - n % capacity, own[n - n % capacity :].copy(), n))
                        if len(waiting) >= block:
                            flush()
                yield emit()
        if waiting:
            flush()
            yield emit()

    return map_arrow(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, schema, encodes=True)


def crc32(ids: bytes) -> int:
    return zlib.crc32(ids)
