"""Small tables in the schemas of the test data, with every kind of dirt."""

from __future__ import annotations

from datetime import datetime
from pathlib import Path

from pyspark.sql import SparkSession

STRINGS = ["book", "chapter", "title", "original", "translation", "decision", "outcome", "cause", "process", "significance", "verdict", "verdict_why"]
ARRAYS = ["figures", "themes", "pros", "cons", "cast_list"]
CORPUS = "doc_no bigint, book string, chapter string, item_index int, title string, original string, translation string, decision string, outcome string, cause string, process string, significance string, verdict string, verdict_why string, figures array<string>, themes array<string>, pros array<string>, cons array<string>, cast_list array<string>, published_at timestamp, loaded_at timestamp"
#: Columns that no query asks for, named like those that plans make.
CLASHING = ", text string, v string, at string, a bigint, b bigint, block string, rep bigint, term string, part int, k int, n int"
SCHEMAS = {
    "corpus_doc": CORPUS,
    "annotation": "book string, chapter string, item_index int, cast_list array<string>, cause string, process string, decision string, outcome string, significance string, verdict string, verdict_why string, themes array<string>, annotated_at timestamp",
    "cases": "case_no bigint, id string, case_source string, query string, want array<string>, confidence string, note string, asked_at timestamp",
    "shard_catalog": "slug string, book string, dynasty string, docs int, chars bigint, bytes bigint, pairing string",
    "label_table": "label string, triggers array<string>, short_triggers array<string>",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint, book string, doc_kind string, fetched_at timestamp",
    "lexicon": "term string, modern string, english string, term_kind string",
    "mix_target": "source string, target_share double, max_repeat int",
}
T0, T1 = datetime(2024, 1, 1), datetime(2024, 2, 1)


def names(table: str) -> list[str]:
    return [f.split()[0] for f in SCHEMAS[table].replace("array<string>", "list").split(", ")]


def row(table: str, **values: object) -> tuple:
    return tuple(values.get(c) for c in names(table))


def record(doc_no: int | None, original: str | None = None, translation: str | None = None, **more: object) -> tuple:
    return row("corpus_doc", doc_no=doc_no, original=original, translation=translation, loaded_at=more.pop("loaded_at", T0), **more)


def write(spark: SparkSession, to: Path, rows: dict[str, list[tuple]], clashing: bool = False) -> str:
    """A data directory with these rows; tables not named are empty."""
    for name, schema in SCHEMAS.items():
        data = rows.get(name, [])
        if clashing:
            extra = CLASHING.replace(", text string", "" if name == "documents" else ", text string").replace(", term string", "" if name == "lexicon" else ", term string")
            schema, data = schema + extra, [r + (None,) * extra.count(", ") for r in data]
        spark.createDataFrame(data, schema).coalesce(2).write.mode("overwrite").parquet(str(to / f"{name}.parquet"))
    return str(to)


def messy() -> dict[str, list[tuple]]:
    """Nulls in any column, '' and blank texts, very long ones, ties, repeated and redelivered rows."""
    long_run, long_text = "天地玄黄" * 1500, "甲乙丙丁戊己庚辛壬癸，" * 3000
    docs = [
        record(None, "无号之文，不可称也。", "没有编号的文章，没法称呼。"),
        record(1, None, None),
        record(2, "", ""),
        record(3, " 　\n", "​"),
        record(4, long_run, long_text, book="甲志", title="长"),
        record(5, "某甲守某城，粟尽而降。" * 8, "某甲守城，粮尽投降。" * 8, book="甲志", chapter="卷一", item_index=0, title="守城", themes=["守城", " 守城 ", "", None], verdict="上策"),
        record(6, "某甲守某城，粟尽而降。" * 8, "某甲守城，粮尽投降。" * 8, book="甲志", chapter="卷一", item_index=1, title="守城", themes=[], verdict="怪"),
        record(7, "某甲守某城,粟尽而降。" + "某甲守某城，粟尽而降。" * 7, "A tale. It ends.", book=None, chapter=None, title=None, themes=None),
        record(7, "某甲守某城,粟尽而降。" + "某甲守某城，粟尽而降。" * 7, "A tale. It ends.", book=None, chapter=None, title=None, themes=None, loaded_at=T1),
    ]
    docs.append(docs[5])
    texts = [(1, None), (2, ""), (3, "  "), (4, long_text), (5, "Hello there."), (6, "Hello there."), (7, "书名：{{title}}"), (8, "守城之事。" * 40)]
    return {
        "corpus_doc": docs,
        "cases": [row("cases", case_no=n, query=q, want=w, asked_at=T0) for n, q, w in [(1, None, None), (2, "", []), (3, "守城粟尽怎么办", ["守城"]), (3, "守城粟尽怎么办", ["守城"]), (4, "守城​粟尽怎么办", None), (None, "x", None)]],
        "annotation": [row("annotation", book="甲志", chapter="卷一", item_index=0, cause="粟尽", verdict=None, annotated_at=T0), row("annotation"), row("annotation", book="甲志", chapter="卷一", item_index=0, cause="围久", verdict="中", themes=["断粮"], annotated_at=T1)],
        "label_table": [row("label_table", label="守城", triggers=["怎么守", "守住"], short_triggers=["守住"]), row("label_table", label="断粮", triggers=None, short_triggers=None), row("label_table")],
        "shard_catalog": [row("shard_catalog", slug="jiazhi", book="甲志", docs=3, chars=9, bytes=9), row("shard_catalog")],
        "documents": [row("documents", doc_id=i, text=t, source="src" if i % 2 else None, n_chars=len(t or "")) for i, t in texts],
        "lexicon": [row("lexicon", term="甲", modern="甲", english="Jia", term_kind="given"), row("lexicon")],
        "mix_target": [row("mix_target", source="src", target_share=0.5, max_repeat=2), row("mix_target", source="none", target_share=0.5, max_repeat=1), row("mix_target")],
    }
