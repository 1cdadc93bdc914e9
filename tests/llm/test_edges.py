"""Every query of the subpackage on messy and on empty tables, with and without clashing columns."""

import pytest

from inkspan import llm
from tests import fixtures
from tests.llm.test_problems import brute_spans

CASES = [(q, kind) for q in llm.queries() for kind in ("messy", "clashing", "empty")]


@pytest.fixture(scope="module")
def dirs(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("edges")
    return {
        "messy": fixtures.write(spark, at / "messy", fixtures.messy()),
        "clashing": fixtures.write(spark, at / "clashing", fixtures.messy(), clashing=True),
        "empty": fixtures.write(spark, at / "empty", {}),
    }


@pytest.mark.parametrize("name,kind", CASES)
def test_runs(spark, dirs, name, kind):
    rows = llm.queries()[name](spark, dirs[kind]).collect()
    if kind == "empty" and name.endswith("_found"):
        assert rows == []


@pytest.mark.parametrize("name", [q for q in llm.queries() if q.endswith("_found")])
def test_clashing_columns_change_nothing(spark, dirs, name):
    a, b = (sorted(map(tuple, llm.queries()[name](spark, dirs[k]).collect()), key=str) for k in ("messy", "clashing"))
    assert a == b


def test_defined_results(spark, dirs):
    q = llm.queries()
    assert {tuple(r) for r in q["p6_found"](spark, dirs["messy"]).collect()} == {(5, 6), (5, 7), (6, 7)}
    assert {(r.field_name, r.key_a, r.key_b) for r in q["p2_found"](spark, dirs["messy"]).collect()} == {("query", 3, 4), ("original", 5, 7), ("original", 6, 7)}
    assert {(r.doc_no, r.field_name, r.cut) for r in q["p3_found"](spark, dirs["messy"]).collect()} == {(4, "original", "hard"), (4, "translation", "natural")}
    spans = {tuple(r) for r in q["p5_found"](spark, dirs["messy"]).collect()}
    assert spans == brute_spans({r.doc_no: r.original or "" for r in spark.read.parquet(f"{dirs['messy']}/corpus_doc.parquet").where("doc_no is not null").collect()}) and spans
    classes = {(r.field_name, r.key): (r.class_id, r.texts, r.spellings, r.links) for r in q["p2_classes"](spark, dirs["messy"]).collect()}
    assert classes["query", 3] == classes["query", 4] == (3, 2, 2, 1) and classes["original", 7] == (5, 3, 2, 2)
    assert [r.doc_id for r in q["p10_found"](spark, dirs["messy"]).collect()] == [7]
    themes = {(r.term, r.occurrences, r.records) for r in q["p1_terms"](spark, dirs["messy"]).collect() if r.field_name == "themes"}
    assert themes == {("守城", 2, 1)}


def test_paths_of_many_rows_are_spelled_out_at_once(monkeypatch):
    """Decoding expands the spans of all rows in one step, and finds the path: in order, with the last two the other way round."""
    import numpy as np

    from inkspan.llm import p04_alignment as p

    calls = []
    monkeypatch.setattr(p, "ranges", lambda a, b, f=p.ranges: calls.append(1) or f(a, b))
    odds = np.full((1, 8, len(p.SPANS), 8), -5.0)
    for j, i in enumerate([0, 1, 2, 3, 4, 5, 7, 6]):
        odds[0, j, 0, i] = 20.0
    for span in range(1, len(p.SPANS)):
        odds[0, :, span, -span:] = -np.inf
    r, i, j = p.decode(lambda lo, hi: odds[:, lo:hi], np.array([8]), np.array([8]))
    assert sorted(zip(j.tolist(), i.tolist())) == [*((k, k) for k in range(6)), (6, 7), (7, 6)]
    assert len(calls) == 1
