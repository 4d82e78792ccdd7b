"""Language identification of words in code-switched text by a linear-chain conditional random field.

A line of a text is a sequence of words, its hidden labels are languages. A word's score for a language sums learned weights of its
affixes (first and last one to three bytes), of its byte 3-grams (the word's bounds count as bytes) and of the word itself if it is in the
lexicon (the most common words of the training sample); neighbouring labels add learned transition weights. Forward-backward gives
each word's probability of each language. A document's language has the largest mean probability over its words, which is the score;
a text in several languages has a low one. How sure the field is of the words is another measure: the mean of each word's largest probability.

The field is fitted by gradient ascent of the conditional likelihood, on a bounded sample of labelled rows: at most `per_language`
documents of at most `longest` characters for each language, the first by a hash of doc_id. One task fits it and hands the driver the
model alone; it keeps some 10 bytes for each byte of the sample and works through the rest CHUNK words at a time. Half of the training
sequences are the documents' own lines, half are mixed from runs of words of different languages, so that transitions know switches.
Prediction sees text only and covers all words of all texts; the model is a few MB whatever the corpus. A long line costs no more steps
than a short one: it is cut into segments, whose products of transitions hand the messages over exactly.

Odd rows: null texts and texts without a letter are `und` with score 0; without any labelled row everything is `und`; rows without lang,
or without doc_id, are not learned from; repeated rows count each. Other columns are passed over."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, cut, map_arrow, without
from .kernels import SPACE, U64, batches, ragged, words

PER_LANGUAGE, LONGEST, LEXICON, BITS = 150, 20_000, 20_000, 16
#: Lines of so many bytes of text go through forward-backward together; features are looked up for PART bytes at a time, as those
#: take some hundred bytes for each byte of text. A longer text is a part of its own.
BATCH, PART = 1 << 21, 1 << 19
#: Words of training sequences that are worked through together; words of a segment of a line.
CHUNK, SEGMENT = 1 << 15, 64
_LETTER = regex.compile(r"\p{L}")


def lowered(buf: np.ndarray) -> np.ndarray:
    """UTF-8 with ASCII and Latin-1 capitals lower-cased, byte by byte; separators become spaces."""
    out = buf.copy()
    out[(buf >= 65) & (buf <= 90)] += 32
    after = np.flatnonzero(buf[:-1] == 0xC3) + 1 if len(buf) else np.zeros(0, np.int64)
    second = after[(buf[after] >= 0x80) & (buf[after] <= 0x9E) & (buf[after] != 0x97)]
    out[second] += 32
    out[SPACE[out]] = 32
    return out


def _bucket(code: np.ndarray, kind: int) -> np.ndarray:
    with np.errstate(over="ignore"):
        return ((code.astype(np.uint32) + np.uint32(kind * 0x01000193)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BITS)).astype(np.intp)


class Words:
    """The words of some texts as indices of features."""

    def __init__(self, texts: list[bytes], lexicon: np.ndarray):
        self.hash, self.at, edges, raw = words([lowered(np.frombuffer(t, np.uint8)).tobytes() for t in texts])
        self.raw = b"\n".join(texts) + b"\n" if texts else b""
        self.start, self.end = edges[:, 0], edges[:, 1]
        low = np.concatenate((np.full(1, 32, np.uint8), np.where(raw == 10, 32, raw), np.full(2, 32, np.uint8))).astype(np.uint32)
        self.grams = _bucket(low[:-2] << 16 | low[1:-1] << 8 | low[2:], 0)  # gram i is centred on byte i
        n = self.end - self.start
        self.affixes = []
        for k in (1, 2, 3):
            first, last = np.zeros(len(n), np.uint32), np.zeros(len(n), np.uint32)
            for j in range(k):
                first = first << 8 | np.where(n > j, low[np.minimum(self.start + 1 + j, len(low) - 1)], 0)
                last = last << 8 | np.where(n > j, low[np.maximum(self.end - j, 0)], 0)
            self.affixes += [_bucket(first, 2 * k), _bucket(last, 2 * k + 1)]
        i = np.minimum(np.searchsorted(lexicon, self.hash), max(len(lexicon) - 1, 0))
        self.lexical = np.where(lexicon[i] == self.hash, i, len(lexicon)) if len(lexicon) else np.zeros(len(n), np.int64)

    def scores(self, m: Model) -> np.ndarray:
        sums = np.concatenate((np.zeros((1, m.grams.shape[1])), np.cumsum(m.grams[self.grams], axis=0, dtype=np.float64)))
        out = sums[self.end] - sums[self.start]
        for table, i in zip(m.affixes, self.affixes, strict=True):
            out += table[i]
        return (out + m.words[self.lexical]).astype(np.float32)

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """First word and number of words of each line with words; a line ends at a line feed or where the text does."""
        if not len(self.start):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        feeds = np.cumsum(np.frombuffer(self.raw, np.uint8) == 10)
        line = feeds[self.start]
        first = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        return first, np.diff(np.append(first, len(line)))


class Model:
    def __init__(self, languages: list[str], lexicon: np.ndarray):
        n = len(languages)
        self.languages, self.lexicon = languages, lexicon
        self.grams = np.zeros((1 << BITS, n), np.float32)
        self.affixes = [np.zeros((1 << BITS, n), np.float32) for _ in range(6)]
        self.words = np.zeros((len(lexicon) + 1, n), np.float32)
        self.transition = np.zeros((n, n), np.float32)

    def tables(self) -> list[np.ndarray]:
        return [self.grams, *self.affixes, self.words, self.transition]


def _messages(e: np.ndarray, first: np.ndarray, count: np.ndarray, a: np.ndarray, head: np.ndarray | None = None, tail: np.ndarray | None = None):
    """Normalised forward and backward messages of each word of some runs of words, their norms' logarithms added up, and the runs'
    order by length. head and tail: what reaches a run's first word from before it and its last one from behind, ones if not given."""
    order = np.argsort(-count, kind="stable")
    first, count = first[order], count[order]
    alive = np.searchsorted(-count, -np.arange(1, int(count.max(initial=0)) + 1), "right")  # runs of over t words
    alpha, beta = np.zeros_like(e), np.zeros_like(e)
    norm, last = 0.0, None
    for t, m in enumerate(alive):
        i = first[:m] + t
        x = (e[i] if head is None else head[order[:m]] * e[i]) if t == 0 else (last[:m] @ a) * e[i]
        z = x.sum(1, keepdims=True)
        last = x / z
        alpha[i] = last
        norm += float(np.log(z).sum())
    back = np.ones((len(first), e.shape[1]), e.dtype) if tail is None else tail[order].copy()
    for t in range(len(alive) - 1, -1, -1):
        i = first[: alive[t]] + t
        if t + 1 < len(alive):
            k = alive[t + 1]
            y = (e[first[:k] + t + 1] * back[:k]) @ a.T
            back[:k] = y / y.sum(1, keepdims=True)
        beta[i] = back[: alive[t]]
    return alpha, beta, norm


def _segments(e: np.ndarray, first: np.ndarray, count: np.ndarray, a: np.ndarray, width: int):
    """Lines cut into segments of at most width words: their first words, lengths, and what reaches each from before and from behind."""
    parts = -(-count // width)
    line = np.repeat(np.arange(len(count)), parts)
    k = ragged(np.zeros(len(count), np.int64), parts)
    start, size = first[line] + k * width, np.minimum(count[line] - k * width, width)
    n = e.shape[1]
    product = np.zeros((len(start), n, n), e.dtype)  # from a segment's first message to its last one
    product[:, np.arange(n), np.arange(n)] = e[start]
    for t in range(1, int(size.max(initial=0))):
        on = np.flatnonzero(size > t)
        x = (product[on] @ a) * e[start[on] + t][:, None, :]
        product[on] = x / x.sum((1, 2), keepdims=True)
    head, tail = np.ones((len(start), n), e.dtype), np.ones((len(start), n), e.dtype)
    at = np.cumsum(parts) - parts
    for j in range(1, int(parts.max(initial=0))):
        i = at[parts > j] + j
        x = (head[i - 1][:, None, :] @ product[i - 1])[:, 0, :] @ a
        head[i] = x / x.sum(1, keepdims=True)
        i = at[parts > j] + parts[parts > j] - 1 - j
        y = (product[i + 1] @ tail[i + 1][:, :, None])[:, :, 0] @ a.T
        tail[i] = y / y.sum(1, keepdims=True)
    return start, size, head, tail


def forward_backward(scores: np.ndarray, first: np.ndarray, count: np.ndarray, transition: np.ndarray, width: int = SEGMENT) -> np.ndarray:
    """Marginals of each word."""
    e = np.exp(scores - scores.max(1, keepdims=True)) if len(scores) else scores
    a = np.exp(transition - transition.max())
    long = count > 4 * width
    alpha, beta, _ = _messages(e, first[~long], count[~long], a)
    p = alpha * beta
    if long.any():
        start, size, head, tail = _segments(e, first[long], count[long], a, width)
        alpha, beta, _ = _messages(e, start, size, a, head, tail)
        own = ragged(start, size)
        p[own] = alpha[own] * beta[own]
    return p / p.sum(1, keepdims=True)


def _expected(scores: np.ndarray, first: np.ndarray, count: np.ndarray, transition: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marginals of each word, and the expected numbers of transitions."""
    e = np.exp(scores - scores.max(1, keepdims=True))
    a = np.exp(transition - transition.max())
    alpha, beta, _ = _messages(e, first, count, a)
    inside = np.ones(len(e), bool)
    inside[first] = False
    j = np.flatnonzero(inside)
    left, right = alpha[j - 1], e[j] * beta[j]
    total = np.einsum("ij,jk,ik->i", left, a, right, optimize=True)
    p = alpha * beta
    return p / p.sum(1, keepdims=True), a * (left.T @ (right / total[:, None]))


def fit(texts: list[str], labels: list[str], rounds: int = 12, lexicon: int = LEXICON, seed: int = 5, chunk: int = CHUNK) -> Model:
    languages = sorted(set(labels))
    texts_b = [t.encode() for t in texts]
    parts = list(batches(texts_b, PART))
    found, number = np.zeros(0, U64), np.zeros(0, np.int64)
    for x, y in parts:
        u, c = np.unique(words([lowered(np.frombuffer(t, np.uint8)).tobytes() for t in texts_b[x:y]])[0], return_counts=True)
        found, at = np.unique(np.concatenate((found, u)), return_inverse=True)
        number = np.bincount(at, np.concatenate((number, c)), len(found)).astype(np.int64)
    model = Model(languages, np.sort(found[np.argsort(-number, kind="stable")[:lexicon]]))
    # features in narrow integers: of each byte its 3-gram, of each word its bytes, affixes and place in the lexicon
    grams, affixes, start, size, lexical, label, first, count, chars, total = [], [], [], [], [], [], [], [], 0, 0
    for x, y in parts:
        w = Words(texts_b[x:y], model.lexicon)
        f, c = w.lines()
        grams.append(w.grams.astype(np.uint16))
        affixes.append(np.stack(w.affixes, 1).astype(np.uint16))
        start.append(w.start + chars)
        size.append(w.end - w.start)
        lexical.append(w.lexical.astype(np.int32))
        label.append(np.repeat(np.array([languages.index(t) for t in labels[x:y]], np.int16), np.diff(w.at)))
        n = -(-c // SEGMENT)  # long lines are cut for training
        k = ragged(np.zeros(len(c), np.int64), n) * SEGMENT
        first.append(np.repeat(f, n) + k + total)
        count.append(np.minimum(np.repeat(c, n) - k, SEGMENT))
        chars, total = chars + len(grams[-1]), total + len(w.start)
    if not total:
        return model
    grams, affixes, start, size, lexical, label = (np.concatenate(z) for z in (grams, affixes, start, size, lexical, label))
    first, count = np.concatenate(first), np.concatenate(count)
    # mixed sequences: runs of 1 to 12 words from random places, 8 runs each
    g = np.random.Generator(np.random.PCG64(seed))
    run_n = g.integers(1, 13, max(1, total // 7))
    run_at = np.minimum(g.integers(0, total, len(run_n)), np.maximum(total - run_n, 0))
    run_n = np.minimum(run_n, total)
    token = np.concatenate((ragged(first, count), ragged(run_at, run_n))).astype(np.int32)
    count = np.concatenate((count, np.add.reduceat(run_n, np.arange(0, len(run_n), 8))))
    ends = np.cumsum(count)
    cuts = np.unique(np.searchsorted(ends, np.arange(chunk, ends[-1] + chunk, chunk)).clip(0, len(ends) - 1)) + 1  # sequences of each chunk
    step, rate = [np.zeros_like(t) for t in model.tables()], 0.5
    for _ in range(rounds):
        grads = [np.zeros(t.shape) for t in model.tables()]
        lo = 0
        for hi in cuts:
            begin = int(ends[lo - 1]) if lo else 0
            own, n = token[begin : ends[hi - 1]], count[lo:hi]
            at, cover = np.cumsum(n) - n, size[own]
            gram, of = grams[ragged(start[own], cover)], np.cumsum(cover)
            sums = np.concatenate((np.zeros((1, len(languages))), np.cumsum(model.grams[gram], axis=0, dtype=np.float64)))
            scores = sums[of] - sums[of - cover]
            for table, i in zip(model.affixes, affixes[own].T, strict=True):
                scores += table[i]
            p, expected = _expected((scores + model.words[lexical[own]]).astype(np.float32), at, n, model.transition)
            d = -p
            d[np.arange(len(own)), label[own]] += 1
            inside = np.ones(len(own), bool)
            inside[at] = False
            np.add.at(grads[-1], (label[own[:-1]][inside[1:]], label[own[1:]][inside[1:]]), 1)
            grads[-1] -= expected
            for grad, i, x in ((grads[0], gram, np.repeat(d, cover, axis=0)), *zip(grads[1:7], affixes[own].T, [d] * 6, strict=True), (grads[7], lexical[own], d)):
                for c in range(len(languages)):
                    grad[:, c] += np.bincount(i, x[:, c], len(grad))
            lo = hi
        for table, grad, acc in zip(model.tables(), grads, step, strict=True):
            grad = grad / len(token) - 1e-7 * table
            acc += grad * grad
            table += (rate * grad / (np.sqrt(acc) + 1e-8)).astype(np.float32)
    return model


def scored(texts: list[bytes], m: Model, part: int = PART) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(scores of all words, words before each text and the total, first word and number of words of each line)."""
    scores, at, first, count, before = [], [np.zeros(1, np.int64)], [], [], 0
    for a, b in batches(texts, part):
        w = Words(texts[a:b], m.lexicon)
        f, c = w.lines()
        scores.append(w.scores(m))
        at.append(w.at[1:] + before)
        first.append(f + before)
        count.append(c)
        before += int(w.at[-1])
    return np.concatenate(scores), np.concatenate(at), np.concatenate(first), np.concatenate(count)


def held_out(doc_id):
    """Column: crc32 of the doc_id as text, modulo 3, is 1."""
    return F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1


def training_sample(docs: DataFrame, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> DataFrame:
    """(lang, doc_id, text): per_language rows of each language at most, in no order."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & (F.length("text") <= longest) & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in rows.groupBy("lang").count().collect()}  # a row per language
    # first a share by hash that holds enough of each language almost surely, then exactly the first ones
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, (2 * per_language + 50) / n))]) if counts else F.create_map(F.lit(""), F.lit(0.0))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30)
    few = rows.where(place < share[F.col("lang")]).select("lang", "text", "doc_id", place.alias("place"))
    first = F.row_number().over(Window.partitionBy("lang").orderBy("place", "doc_id", "text"))
    return few.withColumn("n", first).where(F.col("n") <= per_language).select("lang", "doc_id", "text")


def fit_sample(sample: DataFrame) -> Model:
    """The model of training_sample()'s rows, which are few, fitted by one task; the driver gets its tables."""

    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(r for b in source for r in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
        m = fit([t for _, _, t in rows], [x for x, _, _ in rows])
        tables = [m.lexicon.view(np.int64), *m.tables()]
        yield pa.RecordBatch.from_arrays([pa.array([m.languages] * len(tables), pa.list_(pa.string())), pa.array(range(len(tables)), pa.int32()), pa.array([t.tobytes() for t in tables], pa.binary())], ["languages", "k", "table"])

    rows = sorted(map_arrow(sample.coalesce(1), run, "languages array<string>, k int, table binary").collect(), key=lambda r: r["k"])
    if not rows:
        return Model([], np.zeros(0, U64))
    m = Model(list(rows[0]["languages"]), np.frombuffer(rows[0]["table"], U64))
    for into, r in zip(m.tables(), rows[1:], strict=True):
        into[...] = np.frombuffer(r["table"], np.float32).reshape(into.shape)
    return m


def identify(docs: DataFrame, model: Model | None = None, per_language: int = PER_LANGUAGE, longest: int = LONGEST) -> DataFrame:
    """(doc_id, held_out, lang_pred, score, sure, shares, switches) of each row: shares is the mean probability of each language,
    sure the mean over words of the largest probability, switches the number of neighbouring words in a line with different most likely languages."""
    docs = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(fit_sample(training_sample(docs, per_language, longest)) if model is None else model)
    return _judged(docs, sent)


def _judged(docs: DataFrame, sent: Broadcast) -> DataFrame:
    def run(source: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        names = np.array([*m.languages, "und"], object)
        for batch in source:
            texts = as_bytes(batch.column(1))
            for a, b in batches(texts, BATCH):
                n, k = b - a, len(m.languages)
                letters = np.fromiter((bool(_LETTER.search(t.decode())) for t in texts[a:b]), bool, n)
                share, sure, switches = np.zeros((n, max(k, 1))), np.zeros(n), np.zeros(n, np.int64)
                if k:
                    scores, at, first, count = scored(texts[a:b], m)
                    p = forward_backward(scores, first, count, m.transition)
                    sums = np.concatenate((np.zeros((1, k)), np.cumsum(p, axis=0, dtype=np.float64)))
                    share = (sums[at[1:]] - sums[at[:-1]]) / np.maximum(np.diff(at), 1)[:, None]
                    largest = np.concatenate(([0.0], np.cumsum(p.max(1), dtype=np.float64)))
                    sure = (largest[at[1:]] - largest[at[:-1]]) / np.maximum(np.diff(at), 1)
                    best = p.argmax(1)
                    turn = np.zeros(len(best), np.int64)
                    turn[1:] = best[1:] != best[:-1]
                    turn[first] = 0
                    total = np.concatenate(([0], np.cumsum(turn)))
                    switches = total[at[1:]] - total[at[:-1]]
                known = letters & (k > 0)
                pred = names[np.where(known, share.argmax(1), k)]
                score = np.where(known, np.clip(share.max(1), 0, 1), 0.0)
                listed = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * k), pa.array(share[:, :k].ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(pred, pa.string()), pa.array(score), pa.array(np.where(known, np.clip(sure, 0, 1), 0.0)), listed, pa.array(switches)], ["doc_id", "lang_pred", "score", "sure", "shares", "switches"])

    out = map_arrow(docs.select("doc_id", "text"), run, "doc_id long, lang_pred string, score double, sure double, shares array<double>, switches long")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score", "sure", "shares", "switches")


def keep_identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs, all columns as they are, without those of no language: no letter, or words of which the field is unsure, with a mean of their largest
    probabilities under `least`. Texts in several languages stay if their words are clear."""
    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.col("lang").cast("string"))
    sent = docs.sparkSession.sparkContext.broadcast(fit_sample(training_sample(rows)))
    found = cut(_judged(rows, sent).where((F.col("lang_pred") == "und") | (F.col("sure") < least)).select("doc_id").distinct())
    sent.destroy()
    return without(docs, found)
