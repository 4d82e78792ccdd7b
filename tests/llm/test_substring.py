"""Repeated passages where doc_ids or texts repeat."""

import pytest

pytest.importorskip("veranda.llm")
from veranda.llm import substring_dedup  # noqa: E402


def test_texts_that_share_a_doc_id_keep_their_own_words(spark):
    one, two, base = (" ".join(f"{c}{i}" for i in range(40)) for c in "xyz")
    rows = [(1, base), (5, base + " " + base), (5, one), (5, one), (7, two), (7, one), (None, one)]
    got = sorted(((r.doc_id or 0, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()))
    assert got == sorted([(1, 40, 0), (5, 80, 80), (5, 40, 0), (5, 40, 0), (7, 40, 0), (7, 40, 40), (0, 40, 0)])


def test_a_passage_in_very_many_documents(spark):
    common = " ".join(f"c{i}" for i in range(25))
    rows = [(d, f"a{d} b{d} {common} e{d} f{d}") for d in range(300)]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 20, 8).collect()
    assert all((r.n_words, r.n_removed) == (29, 25 if r.doc_id else 0) for r in got)
