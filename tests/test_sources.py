"""JSON sources and sinks, the stream, and the shape of the entry points."""

import json

import pytest

import __spark_entry__ as entry
from inkspan.sources import corpus_json as cj
from inkspan.streaming import ingest


def put(path, value):
    path.write_text(value if isinstance(value, str) else json.dumps(value, ensure_ascii=False), encoding="utf-8")
    return str(path)


def test_corpus_files(spark, tmp_path):
    a = put(tmp_path / "a.json", "﻿" + json.dumps({"book": "甲志", "note": 1, "items": [{"title": "一", "text": "文", "verdict": "上策", "cast": ["某"], "odd": {}}, {"book": "乙志", "title": 5, "themes": None}]}, ensure_ascii=False))
    b = put(tmp_path / "b.json", {"items": [{"title": "三"}], "book": "丙志"})
    c = put(tmp_path / "c.json", [{"title": "四", "content": "c", "modern": "m"}])
    d = put(tmp_path / "d.json", "not json")
    docs = cj.numbered(cj.read_corpus(spark, a, b, c, d), 10)
    got = {r.doc_no: r for r in docs.collect()}
    assert sorted(got) == [10, 11, 12, 13]
    assert (got[10].book, got[10].original, got[10].verdict, got[10].cast_list, got[10].themes) == ("甲志", "文", "上", ["某"], [])
    assert got[11].book == "乙志" and got[12].book == "" and (got[13].original, got[13].translation) == ("c", "m")


def test_a_corpus_of_several_books(spark, tmp_path):
    path = put(tmp_path / "e.json", {"version": "1", "books": [{"book": "甲志", "items": [{"title": "一", "original": "文"}, {"title": "二"}]}, {"book": "丙志"}, None, {"book": "乙志", "items": [{"title": "三", "themes": ["守城"]}]}], "items": [{"title": "四"}]})
    none = put(tmp_path / "f.json", {"books": [], "items": [{"book": "丁志", "title": "五"}]})
    got = [(r.doc_no, r.book, r.title) for r in cj.numbered(cj.read_corpus(spark, path, none)).orderBy("doc_no").collect()]
    assert got == [(0, "甲志", "一"), (1, "甲志", "二"), (2, "乙志", "三"), (3, "丁志", "五")]


def test_small_files(spark, tmp_path):
    labels = put(tmp_path / "l.json", {"labels": [{"label": "守城", "triggers": ["怎么守"], "provenance": 1}, {"label": ""}]})
    assert [r.label for r in cj.read_labels(spark, labels).collect()] == ["守城"]
    assert [r.word for r in cj.read_stop_words(spark, put(tmp_path / "s.json", {"words": ["一个", "越来越", ""]})).collect()] == ["越来越", "一个"]
    assert cj.read_catalog(spark, put(tmp_path / "c.json", {"books": [{"slug": "a", "book": "甲", "docs": 2}, {"slug": ""}]})).count() == 1
    assert {tuple(r) for r in cj.read_manifest(spark, put(tmp_path / "m.json", {"version": "1", "books": {"甲": "aa"}, "files": {"f": "bb"}})).collect()} == {("books", "甲", "aa", "1"), ("files", "f", "bb", "1")}
    assert cj.read_manifest(spark, put(tmp_path / "n.json", "{broken")).count() == 0
    lines = put(tmp_path / "a.jsonl", '{"book":"甲","chapter":"一","index":3,"cast":["x"],"verdictWhy":"y"}\nbroken\n')
    assert [(r.item_index, r.cast_list, r.verdict_why) for r in cj.read_annotations(spark, lines).collect()] == [(3, ["x"], "y")]
    assert cj.read_selection(spark, put(tmp_path / "e.json", {"selected": []}), ["d"]).count() == 0
    assert [r.slug for r in cj.read_selection(spark, put(tmp_path / "f.json", {}), ["d"]).collect()] == ["d"]


def test_writing(spark, tmp_path):
    docs = spark.createDataFrame([("甲", "一", "文", "", "上")], "book string, title string, original string, translation string, verdict string")
    cj.write_corpus(docs, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).columns == ["original", "title", "translation", "verdict", "book"]
    with pytest.raises(ValueError):
        cj.write_corpus(docs.limit(0), str(tmp_path / "none"))


def test_stream(spark, tmp_path):
    from inkspan.sources.tables import DOCUMENT

    def deliver(n, title):
        values = [(n, *[title if f.name == "title" else None for f in DOCUMENT.fields[1:]])]
        spark.createDataFrame(values, DOCUMENT).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.index_stream(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()

    deliver(1, "甲乙")
    deliver(2, "甲乙丙")
    assert {r.term: r.df for r in ingest.frequencies_so_far(spark, str(tmp_path / "out")).collect()} == {"甲乙": 2, "乙丙": 1, "甲乙丙": 1}


def test_entry_points():
    assert set(entry.oracle_sql()) <= set(entry.queries()) and len(entry.queries()) > 50
