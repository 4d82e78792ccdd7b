"""PII surrogates against a plain version, on hostile texts and clashing columns."""

import re

import pytest
import regex
from pyspark.sql import functions as F

pytest.importorskip("veranda.llm")
from veranda.llm import pii  # noqa: E402

SF = "/root/testdata/sf0.001"


def luhn(s):
    return sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(re.sub("[^0-9]", "", s)))) % 10 == 0


def entities(text):
    """(from, to, kind) of each entity of a text."""
    out = []
    for m in regex.finditer(pii.PATTERN, text):
        kind = next(k for k, p in pii.KINDS.items() if regex.fullmatch(p, m[0]))
        if kind != "card" or luhn(m[0]):
            out.append((m.start(), m.end(), kind))
    return out


def aligned(text, new, found):
    """The surrogates of a text's entities: what stands between its unchanged pieces."""
    edges = [0, *(x for a, b, _ in found for x in (a, b)), len(text)]
    pieces = [text[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)]
    m = re.fullmatch("(.*?)".join(map(re.escape, pieces)), new, re.S)
    assert m, (text[:200], new[:200])
    return m.groups()


def test_all_and_only_entities_are_replaced(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    text = {r.doc_id: r.text for r in docs.collect()}
    got = pii.replace_entities(docs, "k").collect()
    assert sorted(r.doc_id for r in got) == sorted(text)
    surrogate, seen = {}, set()
    for r in got:
        old = text[r.doc_id] or ""
        found = entities(old)
        assert (r.n_entities, list(r.kinds)) == (len(found), [k for _, _, k in found])
        for (a, b, k), new in zip(found, aligned(old, r.text or "", found), strict=True):
            assert surrogate.setdefault((k, old[a:b]), new) == new  # coreference
            seen.add(old[a:b])
    assert surrogate and len(set(surrogate.values())) == len(surrogate) and not set(surrogate.values()) & seen
    plain = pii.replace_entities(docs, "k", report=False)
    assert plain.columns == docs.columns and {(r.doc_id, r.text) for r in plain.collect()} == {(r.doc_id, r.text) for r in got}
    other = {r.doc_id: r.text for r in pii.replace_entities(docs, "another").collect()}
    assert any(other[r.doc_id] != r.text for r in got if r.n_entities) and all(other[r.doc_id] == r.text for r in got if not r.n_entities)


def test_hostile_texts(spark):
    texts = [
        "write to a@" + "b." * 5000 + "com now", "x@" + "a" * 100_000, "1-" * 50_000, "+1 " * 40_000, "Mr. " + "A" * 100_000, "password=" + "é" * 100_000 + " end", "api_key = '" + "k" * 3000 + "'",
        "((((" * 25_000, "AB12" + " 1234" * 20_000, "1.2.3." * 20_000, "token" + " " * 100_000 + "x", "a." * 50_000 + "@x.org", "4111 1111 1111 1111 is, 4111 1111 1111 1112 is not",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.replace_entities(df, "k").collect()}
    assert "AAAA" not in got[4].text and "éé" not in got[5].text and got[5].text.endswith(" end") and "kkk" not in got[6].text and got[6].text.endswith("'")
    assert "4111 1111 1111 1112 is not" in got[12].text and "4111 1111 1111 1111" not in got[12].text and got[12].kinds == ["card"]
    for i in (1, 7, 10):
        assert got[i].text == texts[i] and got[i].n_entities == 0


def test_clashing_columns(spark):
    names = ["fake", "text_key", "n_entities", "kinds", "entity", "kind", "found", "surrogate", "attempt", "a", "p", "row", "key", "parts"]
    df = spark.createDataFrame([(1, "mail a.x@b.co"), (2, "none"), (2, None)], "doc_id long, text string").select("*", *[F.lit(n).alias(n) for n in names])
    got = pii.replace_entities(df, "k", report=False)
    assert got.columns == df.columns and all(r[n] == n for r in got.collect() for n in names)
    told = pii.replace_entities(df, "k")
    assert sorted(told.columns) == sorted(df.columns) and {(r.doc_id, r.n_entities) for r in told.collect()} == {(1, 1), (2, 0)}
