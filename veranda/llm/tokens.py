"""Encoding whole texts with a public tokenizer, each different piece of text once.

Both file formats in use split a text before any merge is looked up, and no piece reaches over ASCII white space but for one
leading space (byte-level files). So a text is cut into chunks there, chunks are told apart by a 64-bit hash, and the
tokenizers library encodes each distinct chunk once per worker; ids of a text are put together by numpy. Texts where the cut could
differ (white space beyond ASCII next to byte-level pieces) are encoded whole. The memo of a worker is bounded."""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

from .kernels import BYTE_POWERS, U64, byte_sums, ragged, range_hashes, word_edges

#: White space that the pre-tokenizers know beyond ASCII.
_WIDE_SPACE = re.compile("[\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
#: Most chunks in a worker's memo; what comes later is encoded for its batch only. A chunk takes about 40 bytes.
MEMO = 1 << 20


class _Memo:
    """hash -> ids: an open-addressing table in numpy, at most half full."""

    def __init__(self, size: int = MEMO):
        self.size, self.mask = size, 2 * size - 1
        self.keys, self.slot = np.zeros(2 * size, U64), np.zeros(2 * size, np.int32)
        self.at, self.n, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int32), 0
        self.ids, self.used = np.zeros(1 << 14, np.uint16), 0

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return (keys >> U64(17)).astype(np.int64) & self.mask

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The slot of each key, -1 if it isn't there."""
        out, todo, i = np.full(len(keys), -1, np.int64), np.arange(len(keys)), self._home(keys)
        while len(todo):
            have = self.keys[i]
            hit = have == keys
            out[todo[hit]] = self.slot[i[hit]]
            on = ~hit & (have != 0)
            todo, keys, i = todo[on], keys[on], (i[on] + 1) & self.mask
        return out

    def add(self, keys: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        """Different keys that are not there."""
        first, new, total = self.count, len(keys), len(ids)
        while first + new > len(self.at):
            self.at, self.n = np.concatenate((self.at, np.zeros_like(self.at))), np.concatenate((self.n, np.zeros_like(self.n)))
        while self.used + total > len(self.ids):
            self.ids = np.concatenate((self.ids, np.zeros_like(self.ids)))
        self.ids[self.used : self.used + total] = ids
        self.at[first : first + new], self.n[first : first + new] = self.used + np.cumsum(n) - n, n
        self.used, self.count = self.used + total, first + new
        slot, i = np.arange(first, first + new, dtype=np.int32), self._home(keys)
        while len(keys):
            free = self.keys[i] == 0
            self.keys[i[free]] = keys[free]
            mine = free & (self.keys[i] == keys)
            self.slot[i[mine]] = slot[mine]
            keys, slot, i = keys[~mine], slot[~mine], (i[~mine] + 1) & self.mask


class Encoder:
    def __init__(self, path: str, special_as_text: bool = True):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core, and each thread would keep memory of its own
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        pre = json.loads(self.tokenizer.pre_tokenizer.__getstate__())
        self.byte_level = pre["type"] == "ByteLevel" and pre.get("use_regex", True)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError("ids of over 16 bits are not supported")
        self.memo = _Memo()
        # what is put behind each of many chunks in one text: a token of its own that no other characters give
        self.mark = "\n" if self.byte_level else " \x01 "
        alone = self._encode([self.mark, f"a{self.mark}b{self.mark}"])
        self.mark_id = alone[0][0] if len(alone[0]) == 1 and alone[1] == [*self._encode(["a"])[0], *alone[0], *self._encode(["b"])[0], *alone[0]] else None

    def _encode(self, texts: list[str], part: int = 1 << 16) -> list[list[int]]:
        """Ids of each text, so many characters at a time: an encoding holds some hundred bytes for each id until it is dropped."""
        out, lo, size = [], 0, 0
        for hi, t in enumerate(texts, 1):
            size += len(t)
            if size >= part or hi == len(texts):
                out += [e.ids for e in self.tokenizer.encode_batch_fast(texts[lo:hi], add_special_tokens=False)]
                lo, size = hi, 0
        return out

    def _chunks(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, chunks before each text and the total, buffer)."""
        at, edges, buf = word_edges(texts)
        if not self.byte_level:
            return edges[:, 0], edges[:, 1], at, buf
        lens = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        stop = np.cumsum(lens) - 1  # where the joining line feed is
        begin = stop + 1 - lens
        own = np.repeat(np.arange(len(texts)), np.diff(at))
        start, end = edges[:, 0], edges[:, 1]
        before = np.concatenate(([0], end[:-1])) if len(end) else end
        firsts = at[:-1][np.diff(at) > 0]
        before[firsts] = begin[own[firsts]]  # the gap before a word begins at the last word's end or at the text's start
        spaced = (start > before) & (buf[np.maximum(start - 1, 0)] == 32)
        word = np.where(spaced, start - 1, start)
        gap = before[before < word]
        lone = start[~spaced & (start - before >= 2)] - 1
        tail = begin.copy()
        has = np.diff(at) > 0
        tail[has] = end[at[1:][has] - 1]
        tail = tail[tail < stop]
        starts = np.sort(np.concatenate((word, gap, lone, tail, stop)))
        ends = np.append(starts[1:], len(buf))
        real = buf[starts] != 10
        real |= ~np.isin(starts, stop)
        return starts[real], ends[real], np.searchsorted(starts[real], np.append(begin, len(buf))), buf

    def encode(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, one text after another, and where each text's begin (with the total at the end)."""
        odd = {i: t.decode() for i, t in enumerate(texts) if self.byte_level and not t.isascii() and _WIDE_SPACE.search(t.decode())}
        plain = [b"" if i in odd else t for i, t in enumerate(texts)]
        starts, ends, at, buf = self._chunks(plain)
        keys = np.maximum(range_hashes(byte_sums(buf), starts, ends, BYTE_POWERS), U64(1))
        slot = self.memo.find(keys)
        miss = np.flatnonzero(slot < 0)
        pool, place, n = self.memo.ids, self.memo.at[slot], self.memo.n[slot]
        if len(miss):
            new, first, which = np.unique(keys[miss], return_index=True, return_inverse=True)
            got = self._encode_chunks(buf.tobytes(), starts[miss[first]].tolist(), ends[miss[first]].tolist())
            counts = np.fromiter(map(len, got), np.int64, len(got))
            flat = np.fromiter((x for ids in got for x in ids), np.uint16, int(counts.sum()))
            place[miss], n[miss] = (self.memo.used + np.cumsum(counts) - counts)[which], counts[which]
            pool = np.concatenate((pool[: self.memo.used], flat))
            if (room := self.memo.size - self.memo.count) > 0:
                self.memo.add(new[:room], flat[: counts[:room].sum()], counts[:room])
        ids = pool[ragged(place, n)]
        bounds = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))[at]
        return self._insert(ids, bounds, odd) if odd else (ids, bounds)

    def _encode_chunks(self, raw: bytes, starts: list[int], ends: list[int]) -> list[list[int]]:
        """Ids of each chunk. Chunks that don't end in white space and don't hold the mark are encoded many to a text, a mark behind each."""
        texts = [raw[a:b].decode() for a, b in zip(starts, ends, strict=True)]
        if self.mark_id is None:
            return self._encode(texts)
        out: list[list[int]] = [[]] * len(texts)
        single, many = [], []
        for i, t in enumerate(texts):
            (many if t[-1] not in "\x09\x0a\x0b\x0c\x0d " and "\x01" not in t else single).append(i)
        for i, ids in zip(single, self._encode([texts[i] for i in single]), strict=True):
            out[i] = ids
        parts = [many[k : k + 256] for k in range(0, len(many), 256)]
        for part, ids in zip(parts, self._encode([self.mark.join([texts[i] for i in part]) + self.mark for part in parts]), strict=True):
            at = 0
            for i in part:
                to = ids.index(self.mark_id, at)
                out[i] = ids[at:to]
                at = to + 1
        return out

    def _insert(self, ids: np.ndarray, bounds: np.ndarray, odd: dict[int, str]) -> tuple[np.ndarray, np.ndarray]:
        parts = [ids[bounds[i] : bounds[i + 1]] for i in range(len(bounds) - 1)]
        for i, got in zip(odd, self._encode(list(odd.values())), strict=True):
            parts[i] = np.array(got, np.uint16)
        return np.concatenate(parts), np.concatenate(([0], np.cumsum([len(p) for p in parts])))


@lru_cache(maxsize=4)
def encoder(path: str, special_as_text: bool = True) -> Encoder:
    """One encoder per worker process and file."""
    return Encoder(path, special_as_text)

