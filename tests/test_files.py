"""Files as rows, configuration with defaults, updates, page keys, and the reports on the library."""

import json

import pytest
from pyspark.sql import functions as F

from inkspan.operators import labels, merge, rank, shaping, stats
from inkspan.sources import corpus_json, files


def test_raw_documents_read_again(spark, tmp_path):
    (tmp_path / "a.json").write_text('﻿{"book":"甲","items":[{"title":"一","x":[1,{"y":"}"}]},{"title":"二"}]}', "utf-8")
    (tmp_path / "b.json").write_text('[{"title":"三"}]', "utf-8")
    (tmp_path / "c.json").write_text('{"books":[{"book":"丙","items":[{"title":"四"}]}]}', "utf-8")
    rows = [json.loads(r.json) for r in files.raw_documents(spark, str(tmp_path)).collect()]
    assert sorted(r["title"] for r in rows) == sorted("一二三四") and {"title": "一", "x": [1, {"y": "}"}]} in rows


def test_small_json_is_null_where_broken_or_deep(spark):
    deep = lambda n: "[" * n + "]" * n
    rows = spark.createDataFrame([('{"a":"x"}',), ("{",), ('{"a":"' + "[" * 80 + '"}',), ('{"a":"y","b":' + deep(64) + "}",), (None,)], "j string")
    assert [r.a if r else None for (r,) in rows.select(files.small_json(F.col("j"), "a string")).collect()] == ["x", None, "[" * 80, None, None]
    assert spark.createDataFrame([(deep(64),)], "j string").select(files.depth(F.col("j"))).first()[0] == 64


def test_pages_are_walked_in_order(spark, tmp_path):
    for rel in ("本纪/卷一-原文.html", "志/卷一-原文.html", "序.html", "志/注.txt"):
        (tmp_path / rel).parent.mkdir(exist_ok=True)
        (tmp_path / rel).write_text(f"<p>{rel}</p>", "utf-8")
    rows = files.read_pages(spark, str(tmp_path)).collect()
    assert [r.rel for r in rows] == sorted(["序.html", "志/卷一-原文.html", "本纪/卷一-原文.html"]) and {r.name for r in rows} == {"序.html", "卷一-原文.html"}


def test_translations_are_found_by_the_first_key_that_leads_to_one(spark):
    ours = [("o1", "本纪/卷一-原文.html"), ("o2", "志/第二章-礼乐-原文.html"), ("o3", "传/卷三-原文.html"), ("o4", "传/卷九-原文.html"), ("o5", "传/无-原文.html")]
    theirs = [("t1", "本纪/卷一-白话.html"), ("t2", "志/卷一-白话.html"), ("t3", "别/第五章-礼乐-白话.html"), ("t4", "传/其三卷三-白话.html"), ("t5", "传/甲卷九-白话.html"), ("t6", "传/乙卷九-白话.html")]
    a, b = (spark.createDataFrame(x, "page string, rel string") for x in (ours, theirs))
    got = {r.page: (r.other, r.level) for r in shaping.translations_of(a, b).collect()}
    assert got == {"o1": ("t1", 0), "o2": ("t3", 2), "o3": ("t4", 3)}


def test_configuration_falls_back_to_what_is_packaged(spark, tmp_path):
    assert "怎么办" not in files.stop_words(spark) and files.stop_words(spark)[0] == "越来越"
    own = tmp_path / "stop.json"
    own.write_text('{"version":"1","words":["甲乙","甲乙丙",""]}', "utf-8")
    assert files.stop_words(spark, str(own)) == ["甲乙丙", "甲乙"]
    assert files.stop_words(spark, str(tmp_path / "none.json")) == files.stop_words(spark)
    seed = corpus_json.read_corpus(spark, _corpus(tmp_path / "seed.json", "种"))
    assert [r.title for r in files.corpus_or_seed(spark, seed, str(tmp_path / "none")).collect()] == ["种"]
    (tmp_path / "broken.json").write_text("{", "utf-8")
    assert [r.title for r in files.corpus_or_seed(spark, seed, str(tmp_path / "broken.json")).collect()] == ["种"]
    assert [r.title for r in files.corpus_or_seed(spark, seed, _corpus(tmp_path / "new.json", "新")).collect()] == ["新"]


def _corpus(path, title):
    path.write_text(json.dumps({"book": "书", "items": [{"title": title, "original": "文"}]}), "utf-8")
    return str(path)


def test_selection_shards_and_catalog(spark, tmp_path):
    chosen = spark.createDataFrame([(1, "b"), (0, "a")], "place int, slug string")
    files.write_selection(chosen, str(tmp_path / "sel"))
    assert [r.slug for r in corpus_json.read_selection(spark, str(tmp_path / "sel"), ["z"]).orderBy("place").collect()] == ["a", "b"]
    files.write_selection(chosen.limit(0), str(tmp_path / "sel"))
    assert corpus_json.read_selection(spark, str(tmp_path / "sel"), ["z"]).count() == 0
    docs = spark.createDataFrame([("书", "甲乙", "译"), ("书", "丙", ""), ("外", "丁", "")], "book string, original string, translation string")
    catalog = spark.createDataFrame([("a", "书", "唐", 0, 0, 7, "x"), ("n", "无", "宋", 5, 5, 9, "y")], "slug string, book string, dynasty string, docs int, chars bigint, bytes bigint, pairing string")
    rows = {r.slug: r for r in files.write_shards(docs, catalog, str(tmp_path / "shards")).collect()}
    assert (rows["a"].docs, rows["a"].chars) == (2, 4) and rows["a"].bytes > 20 and (rows["n"].docs, rows["n"].bytes) == (0, 0)
    again = {r.slug: (r.docs, r.bytes) for r in files.with_bytes(catalog, files.file_sizes(spark, str(tmp_path / "shards"))).collect()}
    assert again == {"a": (0, rows["a"].bytes), "n": (5, 9)}
    files.write_catalog(catalog, str(tmp_path / "catalog"))
    assert corpus_json.read_catalog(spark, str(tmp_path / "catalog")).count() == 2


def test_gates_name_what_is_wrong(spark, tmp_path):
    good = '{"book":"书","items":[{"title":"一","original":"甲乙丙丁"}]}'
    texts = {"good": good, "small": "[]", "hash": good + " ", "shape": "x" * 40, "char": good.replace("甲", "�"), "broken": good[:-2] + " " * 9, "none": '{"book":"书","items":[]}' + " " * 20}
    for name, t in texts.items():
        (tmp_path / name).write_text(t, "utf-8")
    units = files.bytes_of(spark, str(tmp_path))
    manifest = units.select("name", F.when(F.col("name") == "hash", "0").otherwise(F.upper("sha256")).alias("sha256"))
    got = {r.name: r.reason for r in files.unit_gates(units, manifest).collect()}
    assert got == {"good": None, "small": "too small", "hash": "hash differs", "shape": "no JSON container", "char": "replacement character", "broken": "broken JSON", "none": "no document"}


def test_flat_files_and_the_whole_corpus_are_compared_by_what_is_there(spark):
    m = lambda rows: spark.createDataFrame(rows, "section string, name string, sha256 string")
    remote = m([("books", "corpus", "AA"), ("books", "书", "b1"), ("files", "../up/labels.json", "ff"), ("files", "x/", "00")])
    local = m([("books", "corpus", "zz"), ("books", "书", "B1"), ("files", "labels.json", "ff")])
    real = spark.createDataFrame([("corpus", "aa"), ("labels.json", "ee")], "name string, sha256 string")
    assert {(r.section, r.name) for r in merge.manifest_diff(local, remote, real).collect()} == {("files", "labels.json")}
    assert {(r.section, r.name, r.state) for r in merge.manifest_diff(local, remote).collect()} == {("books", "corpus", "changed")}
    with pytest.raises(ValueError):
        merge.readable(remote.limit(0))
    f = lambda rows: spark.createDataFrame(rows, "name string, sha256 string, content string")
    flat = files.flat_files(f([("a", "1", "x"), ("b", "2", "y")]), f([("a", "1", "x"), ("b", "3", "z"), ("c", "4", "w")]))
    assert {(r.name, r.content, r.changed) for r in flat.collect()} == {("a", "x", False), ("b", "z", True), ("c", "w", True)}
    assert files.must_reload(remote.limit(0), flat) and not files.must_reload(remote.limit(0), flat.where("not changed"))


def test_situation_strip(spark):
    concerns = spark.createDataFrame([(1, ["断粮", "疑忌", "断粮"])], "case_no long, concerns array<string>")
    why = "case_no long, slot int, why array<struct<said:string,label:string>>"
    reasons = spark.createDataFrame([(1, 2, [("粮尽", "断粮"), ("没粮", "断粮")]), (1, 1, [("粮尽", "断粮"), ("退走", "退兵"), ("退兵", "退兵"), ("吃光", "断粮"), ("饿了", "断粮")]), (2, 1, [("怕", "疑忌")])], why)
    got = {(r.case_no, r.place): (r.label, r.said) for r in rank.situation_strip(concerns, reasons).collect()}
    assert got == {(1, 0): ("断粮", ["粮尽", "吃光", "饿了"]), (1, 1): ("疑忌", []), (1, 2): ("退兵", ["退走"]), (2, 0): ("疑忌", ["怕"])}
    assert [rank.asked_top(n) for n in (-1, 0, 1, 10, 11)] == [3, 3, 1, 10, 3]


def test_library_reports(spark):
    catalog = spark.createDataFrame([("A", "书", 10), ("b", "外", 5), ("", "x", 99)], "slug string, book string, bytes bigint")
    chosen = spark.createDataFrame([("a",), ("A",), ("q",)], "slug string")
    assert stats.library_totals(catalog, chosen).first()[:] == (2, 15, 1, 10)
    docs = spark.createDataFrame([(i, "书", "章", 1 if i < 3 else i, "题", "文" * i, "") for i in range(1, 11)], "doc_no long, book string, chapter string, item_index int, title string, original string, translation string")
    assert stats.snapshot(docs, catalog, chosen, "9").first()[:] == (10, 1, True, "9")
    assert stats.body_lengths(docs).first()[:] == (10, 6.5, 7, 11, 11)
    assert [tuple(r) for r in stats.repeated_keys(docs).collect()] == [("书", "章", 1, 2)]
    assert stats.repeated_keys(docs.withColumn("book", F.lit(""))).count() == 0


def test_allow_list_patches_the_table(spark):
    ruled = spark.createDataFrame([("断粮", "粮尽", True), ("断粮", "没粮", True), ("退兵", "退走", False)], "label string, term string, allowed boolean")
    allowed = labels.allow_list(ruled)
    table = spark.createDataFrame([("断粮", ["x"], ["旧"]), ("退兵", ["y"], ["旧"])], "label string, triggers array<string>, short_triggers array<string>")
    assert {r.label: (r.triggers, r.short_triggers) for r in labels.patched(table, allowed).collect()} == {"断粮": (["x"], ["没粮", "粮尽"]), "退兵": (["y"], None)}


def test_heads_of_books_and_filters(spark):
    docs = spark.createDataFrame([(i, "甲" if i % 3 else "乙", "文" * i, "译" * i) for i in range(1, 40)], "doc_no long, book string, original string, translation string")
    assert sorted((r.book, r.doc_no) for r in shaping.head(docs, 2).collect()) == [("乙", 3), ("乙", 6), ("甲", 1), ("甲", 2)]
    assert shaping.head(docs, 0, ["乙"]).count() == 13 and shaping.head(docs, 5, ["丙"]).count() == 0
    kept = {r.doc_no: len(r.translation) for r in shaping.filtered_items(docs).collect()}
    assert min(kept) == 16 and kept[19] == 0 and kept[20] == 20
    modes = shaping.pairing(docs.withColumn("c", F.col("book") == "乙"), F.col("c")).collect()
    assert {r.book: r.pairing for r in modes} == {"甲": "段译配对", "乙": "整章对齐"}
