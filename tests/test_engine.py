"""The retrieval engine on small tables of its own."""

import math
import random
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from inkspan.functions import text
from inkspan.operators import best, index, labels, merge, rank, shaping
from inkspan.operators import stats as reports
from inkspan.plans import catalog
from inkspan.plans.pipeline import Pipeline
from inkspan.sources import tables
from tests import fixtures
from tests.fixtures import record, row


def one(spark, column, **values):
    names = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items())
    return spark.createDataFrame([tuple(values.values())], names).select(column.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, text.normalize(F.col("q")), q="　ＡＢ，甲！é乙  丙") == "AB 甲 乙 丙"
    assert one(spark, text.normalize(F.col("q")), q=None) == ""
    assert one(spark, F.array_sort(text.grams(F.col("t"))), t="甲乙丙丁，x") == sorted(["甲乙", "乙丙", "丙丁", "甲乙丙", "乙丙丁", "甲乙丙丁"])
    assert one(spark, text.grams(F.col("t")), t=None) == []
    assert one(spark, text.mask(F.col("t")), t="已越来越经难") == "难" and one(spark, text.mask(F.col("t")), t="什么时候动手") == "动手"
    assert one(spark, text.verdict(F.col("v")), v="　上策 ") == "上" and one(spark, text.verdict(F.col("v")), v="好") == ""
    assert one(spark, text.estimated_tokens(F.col("t")), t="ab甲") == 2
    assert one(spark, text.version_key(F.col("v")), v="v0.12.x") == [0, 12, 0, 0]
    assert one(spark, text.without_fence(F.col("v")), v="```json\n{}\n```") == "{}"
    assert one(spark, text.truncated(F.col("v"), 2), v="甲乙丙") == "甲乙…"


@pytest.mark.parametrize("m,hay,found", [("信任", "不信任", False), ("不信任", "并不信任对方", True), ("信任", "不信任但信任他", True), ("信任", "信任没", False), ("信任", "不太信任", True), ("(", "a(b", True)])
def test_negation(spark, m, hay, found):
    assert one(spark, text.hit(F.col("m"), F.col("h")), m=m, h=hay) is found


@pytest.mark.parametrize("core,hay,found", [("骨干走", "骨干想走", True), ("骨干走", "骨x骨干想走", False), ("骨干走", "走骨干", False), ("骨干走", "骨一二干走", True), ("骨干走", "骨一二三干走", False), ("", "骨", False)])
def test_gap(spark, core, hay, found):
    assert one(spark, text.matches_with_gap(F.col("c"), F.col("h")), c=core, h=hay) is found


def corpus(spark, to):
    """Fillers with one common term, and passages with verdicts and themes of their own."""
    docs = [record(n, f"泛词之文{chr(0x4E00 + n)}", title="", themes=[]) for n in range(20)]
    docs += [
        record(100, "守城粟尽而援不至", title="守城记", themes=["守城", "断粮"], verdict="上"),
        record(101, "守城粟尽守城粟尽援至", title="又守城", themes=["守城"], verdict="中"),
        record(102, "骨干欲去而主不留", title="骨干", themes=["离心"], verdict="下"),
        record(103, "断粮之患", title="断粮", themes=["断粮"], verdict=""),
    ]
    asked = [("守城粟尽怎么办", ["守城记"]), ("骨干想走，怎么留", ["骨干"]), ("", []), ("全无所知", None)]
    return fixtures.write(
        spark, to,
        {
            "corpus_doc": docs,
            "cases": [row("cases", case_no=n, id=f"Q{n}", query=q, want=w, confidence="high", asked_at=fixtures.T0) for n, (q, w) in enumerate(asked)],
            "label_table": [
                row("label_table", label="守城", triggers=["怎么守", "守住"], short_triggers=["守住"]),
                row("label_table", label="断粮", triggers=["粟尽怎么办", "没粮"], short_triggers=None),
                row("label_table", label="离心", triggers=["骨干走", "人散"], short_triggers=["人散"]),
                row("label_table", label="无踪", triggers=["全无所知"], short_triggers=None),
            ],
        },
    )


@pytest.fixture(scope="module")
def pipe(spark, tmp_path_factory):
    return Pipeline(spark, corpus(spark, tmp_path_factory.mktemp("corpus")))


@pytest.mark.parametrize("slice_chars", [7, 1 << 20])
def test_terms_are_found_as_numbers_as_the_grams_are(monkeypatch, spark, tmp_path, slice_chars):
    monkeypatch.setattr(index, "SLICE_CHARS", slice_chars)
    docs = tables.documents(spark, fixtures.write(spark, tmp_path, fixtures.messy()))
    odd = spark.createDataFrame([(99, "ab\n甲乙Ａ甲乙𠀀丙丁龘鿿㐀䶿9Z", ["甲", "乙丙", None], "")], "doc_no long, title string, themes array<string>, cause string")
    for d in (docs, odd):
        post = index.postings(d)
        for terms in (post.select("term").distinct(), spark.createDataFrame([("守城",), ("甲乙丙丁戊",), ("ab\n",), ("，，",), ("9Z",), ("守城",), (None,)], "term string"), post.select("term").limit(0)):
            want = sorted(index.wanted_postings(d, terms).select("term", "doc_no").collect())
            assert sorted(index.unfolded(index.folded(d, terms)).collect()) == want
            assert sorted(index.counted(d, terms).collect()) == sorted(index.frequencies(index.wanted_postings(d, terms)).collect())
            with monkeypatch.context() as m:
                m.setattr(index, "SENT_TERMS", 1)
                assert sorted(index.unfolded(index.folded(d, terms)).collect()) == want


def test_only_the_terms_left_have_postings(pipe):
    """Grams of a query that no word of it is cut as are counted, but their postings are not kept."""
    assert "城粟" in {r.term for r in pipe.stats.collect()}
    assert {r.term for r in pipe.postings.collect()} <= {r.term for r in pipe.terms.collect()}


def test_segmentation(pipe):
    tokens = {r.case_no: r.tokens for r in pipe.tokens.collect()}
    assert tokens[0] == ["守城粟尽"] and tokens[2] == [] and "骨干" in tokens[1]


def test_bridge(pipe):
    found = {(r.case_no, r.label): r.said for r in pipe.expanded.collect()}
    assert found == {(0, "守城"): ["守城"], (0, "断粮"): ["粟尽怎么办"], (1, "离心"): ["骨干走"]}
    assert {r.case_no: r.concerns for r in pipe.concerns.collect()}[0] == sorted(["守城", "断粮"])


def test_tiers_and_reasons(pipe):
    tiers = {(r.case_no, r.slot): (r.verdict, r.doc_no, r.graded, r.coverage) for r in pipe.tiers.collect()}
    assert tiers[0, 1] == ("上", 100, True, 2) and tiers[0, 2][:2] == ("中", 101) and (2, 1) not in tiers
    why = {(r.case_no, r.doc_no): [(x.said, x.label) for x in r.why] for r in rank.why(pipe.tiers, pipe.expanded).collect()}
    assert all(said != label for pairs in why.values() for said, label in pairs)
    result = {r.case_no: r.result for r in rank.as_json(pipe.tiers, rank.why(pipe.tiers, pipe.expanded), pipe.docs, pipe.cases, pipe.concerns, F.lit(4)).collect()}
    assert '"tiers":[{"verdict":"上","hit":0},{"verdict":"中","hit":1},{"verdict":"下","hit":-1}]' in result[0] and result[2].endswith('"hits":[]}')
    assert '"tookMs":0,"graded":true,"verdictDocs":4,"concerns":["守城","断粮"' in result[0].replace('"断粮","守城"', '"守城","断粮"') and '"coverage":[' in result[0]


def test_without_verdicts_the_ranking_is_the_situated_one(pipe):
    bare = pipe.docs.withColumn("verdict", F.lit(""))
    tiers = {(r.case_no, r.slot, r.doc_no) for r in rank.tiered(pipe.pool, bare).collect()}
    assert tiers == {(r.case_no, r.rank, r.doc_no) for r in pipe.pool.where("rank <= 3").collect()}


@pytest.mark.parametrize("block_docs", [500, 40])
def test_first_lists_lose_no_passage(monkeypatch, spark, block_docs):
    """Lists cut at 200 or 5 against all hits ranked, in one block and in several, with many equal scores."""
    monkeypatch.setattr(best, "BLOCK_DOCS", block_docs)
    rng = random.Random(3)
    names = [chr(0x4E00 + i) * (2 + i % 2) for i in range(14)]
    post = [(t, d) for i, t in enumerate(names) for d in range(300) if rng.random() < (i + 1) / 18]
    terms = [(c, k, t, k > 3) for c in range(40) for k, t in enumerate(rng.sample(names, rng.randrange(1, 7)))]
    docs = [(d, rng.choice(["上", "中", "下", "", ""]), rng.sample(["甲", "乙", "丙"], rng.randrange(3))) for d in range(300)]
    post = spark.createDataFrame(post, "term string, doc_no long")
    terms = spark.createDataFrame(terms, "case_no long, term_ord int, term string, is_label boolean")
    docs = spark.createDataFrame(docs, "doc_no long, verdict string, themes array<string>")
    concerns = spark.createDataFrame([(c, ["甲", "乙", "丙"][: c % 3 + 1]) for c in range(0, 40, 2)], "case_no long, concerns array<string>")
    stats, n = index.frequencies(post), F.lit(300.0)
    hits = rank.scored(terms, post, stats, n)
    for top in (200, 5):
        for asked in (concerns, None):
            lists = best.lists(rank.weighted(terms, stats, n).select("case_no", "term", "w"), post, docs, asked, 300, top)
            columns = ["case_no", "doc_no", "score", "n_terms", "rank"] + ["coverage"] * (asked is not None)
            plain = rank.situated(hits, concerns, docs, top) if asked is not None else rank.ranked(hits, top)
            assert sorted(best.unfolded(lists).select(*columns).collect()) == sorted(plain.select(*columns).collect())
    lists = best.lists(rank.weighted(terms, stats, n).select("case_no", "term", "w"), post, docs, concerns, 300)
    columns = ["case_no", "slot", "doc_no", "score", "rank", "verdict", "graded"]
    assert sorted(best.tiered(lists).select(*columns).collect()) == sorted(rank.tiered(rank.situated(hits, concerns, docs, 200), docs).select(*columns).collect())


def test_scores(spark):
    terms = spark.createDataFrame([(1, 0, "甲乙", False), (1, 1, "丙丁戊", False), (1, 1000, "己庚", True)], "case_no long, term_ord int, term string, is_label boolean")
    post = spark.createDataFrame([("甲乙", 5), ("丙丁戊", 5), ("己庚", 6), ("甲乙", 7)], "term string, doc_no long")
    stats = spark.createDataFrame([("甲乙", 2), ("丙丁戊", 1), ("己庚", 1)], "term string, df long")
    hits = rank.with_terms(rank.scored(terms, post, stats, F.lit(9.0)), terms, post)
    import math

    w = [math.log(10 / 3) + 1, (math.log(10 / 2) + 1) * 1.35, (math.log(10 / 2) + 1) * 0.75]
    got = {r.doc_no: (r.score, r.n_terms, r.terms) for r in hits.collect()}
    assert got[5][0] == pytest.approx(w[1] + 0.3 * w[0]) and got[6] == (pytest.approx(w[2]), 1, ["己庚（同义）"]) and got[7][0] == pytest.approx(w[0])


def test_index(spark):
    docs = spark.createDataFrame([(1, "甲乙", ["丙"]), (2, "甲乙甲乙", None), (3, None, ["丁戊"])], "doc_no long, title string, themes array<string>")
    got = {r.term: r.df for r in index.frequencies(index.postings(tables.lenient(docs))).collect()}
    assert got == {"甲乙": 2, "乙甲": 1, "甲乙甲": 1, "乙甲乙": 1, "甲乙甲乙": 1, "丁戊": 1}


def docs_of(spark, rows):
    return spark.createDataFrame(rows, "doc_no long, original string")


def test_dedup(spark):
    rows = [(1, "Abc甲"), (2, "aBC甲"), (3, ""), (4, ""), (5, None), (6, "乙")]
    assert {r.doc_no for r in merge.keep_last(docs_of(spark, rows)).collect()} == {2, 3, 4, 5, 6}
    text_ = "".join(chr(0x4E00 + i) for i in range(200))
    curated = docs_of(spark, [(90, text_[5:100])])
    ours = docs_of(spark, [(1, text_[10:30]), (2, text_[10:21]), (3, text_), (4, "全不相干的一段文字，长逾十二字"), (5, None), (6, text_[100:140])])
    assert {r.doc_no for r in merge.contained(ours, curated).collect()} == {2, 4, 5, 6}


def test_merge(spark):
    d = "book string, title string, original string, translation string"
    local = spark.createDataFrame([("甲", "1", "x", None), ("乙", "2", "x", None), ("", "3", "x", None)], d)
    remote = spark.createDataFrame([("甲", "9", "x", None), ("甲", "8", "x", None)], d)
    assert sorted(r.title for r in merge.merge_by_book(local, remote).collect()) == ["2", "3", "8", "9"]
    assert merge.merge_by_book(local, remote, whole=True).count() == 2
    assert merge.gates(local).first().passes and not merge.gates(local.limit(0)).first().passes
    assert not merge.gates(spark.createDataFrame([("甲", "�", "x", None)], d)).first().passes


def test_chunks(spark):
    sentence = "甲" * 99 + "。"
    assert [len(x) for x in one(spark, shaping.chunked(F.col("t")), t=sentence * 7)] == [300, 400]
    assert [len(x) for x in one(spark, shaping.chunked(F.col("t")), t=sentence * 8)] == [300, 300, 200]
    assert [len(x) for x in one(spark, shaping.chunked(F.col("t")), t="乙" * 500 + "，" + "乙" * 800)] == [501, 600, 200]
    assert one(spark, shaping.chunked(F.col("t")), t="") == [] and one(spark, shaping.chunked(F.col("t")), t=None) == []
    assert shaping.shares("甲。乙乙。丙。丁丁丁。", 2) == ["甲。乙乙。", "丙。丁丁丁。"] and shaping.shares("甲。", 3) == ["甲。", "", ""] and shaping.shares("", 2) == [] and shaping.shares("甲。乙。", 1) == ["甲。乙。"]


def test_html(spark):
    html = "<h1>题</h1><style>a{}</style><p>原文原文原文一二&amp;lt;&#30002;&#x4e59;</p><p style='color:#967D63'>译文<br>次行（jiǎ）</p><p>短</p><p style='color:#967d63'>无</p><p>下一节</p>"
    pages = spark.createDataFrame([(1, html), (2, None), (3, "<p>未闭"), (4, "")], "page_id long, html string")
    assert [(r.page_id, r.pair_no, r.original, r.translation) for r in shaping.paragraph_pairs(pages).collect()] == [(1, 1, "原文原文原文一二&lt;甲乙", "译文\n次行")]
    assert one(spark, shaping.cleaned(F.col("h")), h="a<b") == "a" and one(spark, shaping.cleaned(F.col("h")), h="a > b") == "a b"
    assert one(spark, shaping.volume(F.col("c")), c="史卷一百零三·传") == 103 and one(spark, shaping.volume(F.col("c")), c="卷12") == 12 and one(spark, shaping.volume(F.col("c")), c="无") == -1
    assert one(spark, shaping.title_of(F.col("c")), c="第3章-卷二 某传-原文.html") == "卷二 某传"


def test_sample(spark):
    rows = [(i, "甲", "", "题" if i < 10 else "小") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_no long, book string, chapter string, title string")
    assert sorted(r.doc_no for r in shaping.stratified(docs, 3).collect()) == [1, 5, 8, 10, 11]


def test_labels(spark):
    pairs = spark.createDataFrame([("守城", "守住"), ("守城", "无有")], "label string, term string")
    post = spark.createDataFrame([("守住", i) for i in range(4)], "term string, doc_no long")
    docs = spark.createDataFrame([(i, ["守城"] if i < 3 else []) for i in range(4)], "doc_no long, themes array<string>")
    got = {r.term: (r.df, r.df_label, r.p) for r in labels.directedness(pairs, post, docs).collect()}
    assert got == {"守住": (4, 3, 0.75), "无有": (0, 0, 0.0)}
    assert [(r.term, r.allowed, r.edge) for r in labels.short_rule(labels.directedness(pairs, post, docs)).orderBy("term").collect()] == [("守住", True, False), ("无有", False, False)]


def test_report(spark):
    docs = tables.lenient(spark.createDataFrame([(i, "甲", "字" * n, "") for i, n in enumerate([5, 1, 3, 9])] + [(9, None, None, None)], "doc_no long, book string, original string, translation string"))
    r = {x.book: x for x in reports.shard_report(docs).collect()}
    assert (r["甲"].min_len, r["甲"].p50_len, r["甲"].p90_len, r["甲"].max_len, r["甲"].chars) == (1, 5, 9, 9, 18) and r[""].items == 1


@pytest.mark.parametrize("kind", ["clashing", "empty"])
def test_every_query_runs_on_messy_and_empty_tables(spark, tmp_path, kind):
    d = fixtures.write(spark, tmp_path, {} if kind == "empty" else fixtures.messy(), clashing=kind == "clashing")
    for name, q in catalog.queries().items():
        q(spark, d).collect()


def brute_offline(docs, query):
    """Of (number, fields run together, verdict) the numbers shown and whether they are graded."""
    grams = {n: {t[i : i + 2] for i in range(len(t) - 1)} for n, t, _ in docs}
    sums = {}
    for term in {query[i : i + 2] for i in range(len(query) - 1)}:
        have = [n for n in grams if term in grams[n]]
        for n in have:
            sums[n] = sums.get(n, 0.0) + math.log((len(docs) + 1) / (len(have) + 1)) + 1
    ranked = sorted(sums, key=lambda n: (-round(sums[n], 6), n))
    verdict = {n: v for n, _, v in docs}
    able = [n for n in ranked[:200] if sums[n] >= 0.35 * sums[ranked[0]]]
    firsts = [next((n for n in able if verdict[n] == v), None) for v in "上中下"]
    chosen = [n for n in firsts if n is not None]
    return [(n, math.floor(sums[n] * 10 + 0.5)) for n in chosen or ranked[:3]], bool(chosen)


@pytest.mark.parametrize("verdicts", ["上中下", " "])
def test_the_simplified_engine_reads_all_fields_and_grades(spark, tmp_path, verdicts):
    fields = ["book", "chapter", "title", "original", "translation", "decision", "outcome", "cause", "process", "significance", "figures", "themes", "cast_list"]
    rng = random.Random(3)
    rows, docs = [], []
    for n in range(240):
        value = {f: "".join(rng.choices("甲乙丙丁戊，", k=rng.randint(0, 3))) for f in fields}
        v = rng.choice(verdicts).strip() if n % 3 else ""
        if n < len(fields):  # a text that only one field holds
            value[fields[n]] = f"子{'丑寅卯辰巳午未申酉戌亥金木'[n]}"
        docs.append((n, "".join(value.values()), v))
        rows.append(record(n, verdict=v, **{f: [value[f]] if f in ("figures", "themes", "cast_list") else value[f] for f in fields}))
    asked = ["子丑", "子寅", "甲乙 丙", "子巳", "子金", "子木", "甲乙丙", "乙戊丁甲丙", "无此"]
    d = fixtures.write(spark, tmp_path, {"corpus_doc": rows, "cases": [row("cases", case_no=i, query=q, asked_at=fixtures.T0) for i, q in enumerate(asked)]})
    got = {}
    for r in catalog.queries()["bigram_offline_top3"](spark, d).orderBy("case_no", "rank").collect():
        got.setdefault(r.case_no, []).append(((r.doc_no, r.score_tenths), r.graded))
    for i, q in enumerate(asked):
        want, graded = brute_offline(docs, q) if q != "无此" else ([], False)
        assert got.get(i, []) == [(x, graded) for x in want]


def test_the_simplified_engine_makes_no_row_for_each_pair(monkeypatch, spark):
    """In blocks of a few passages, with equal scores; what it reads is packed lists, not sums of pairs."""
    monkeypatch.setattr(best, "BLOCK_DOCS", 60)
    rng = random.Random(4)
    docs = [(n, "".join(rng.choices("甲乙丙", k=rng.randint(0, 5))), rng.choice(["上", "中", ""])) for n in range(240)]
    asked = ["甲乙丙", "乙乙", "丙甲乙甲", "甲甲甲"]
    full = tables.lenient(spark.createDataFrame([(n, t, v, *[""] * 9, *[[]] * 3) for n, t, v in docs], "doc_no long, book string, verdict string, " + ", ".join(f"{c} string" for c in rank.OFFLINE[1:]) + ", " + ", ".join(f"{c} array<string>" for c in rank.OFFLINE_ARRAYS)))
    found = rank.offline(spark.createDataFrame(list(enumerate(asked)), "case_no long, query string"), full)
    assert "collect_list" not in found._jdf.queryExecution().toString()
    got = {}
    for r in found.orderBy("case_no", "rank").collect():
        got.setdefault(r.case_no, []).append(((r.doc_no, r.score_tenths), r.graded))
    for i, q in enumerate(asked):
        want, graded = brute_offline(docs, q)
        assert got[i] == [(x, graded) for x in want]


def test_phrases_are_mined_from_whole_texts_in_words(spark, tmp_path):
    rng = random.Random(5)
    words = ["粮尽", "援绝", "守城", "夜袭", "筑堤", "开仓", "求和", "辞官人", "大旱"]
    rows = [record(n, "，".join("".join(rng.choices(words, k=3)) for _ in range(30)), "开头" + rng.choice(words) + "一个译文", title="题" + words[n % 9], significance="末尾之语" if n % 2 else "", themes=["断粮"]) for n in range(30)]
    d = fixtures.write(spark, tmp_path, {"corpus_doc": rows})
    docs = tables.documents(spark, d)
    bodies = {r.doc_no: r.body for r in labels.mining_text(docs).collect()}
    df = {r.term: r.df for r in index.frequencies(index.postings(docs)).collect()}
    n = len(rows) + 2

    def cheapest(block):
        """All ways to cut a block, the cheapest first."""
        if not block:
            return 0.0, ()
        found = []
        for k in (1, 2, 3, 4):
            w = block[:k]
            if len(w) == k and (k == 1 or w in df):
                rest = cut(block[k:])
                found.append((rest[0] + (math.log(n / 2) + 4 if k == 1 else -math.log((df[w] + 1) / n)), (w, *rest[1])))
        return min(found, key=lambda x: round(x[0], 9))

    cut = lru_cache(None)(cheapest)
    got = {}
    for r in labels.phrases(docs).collect():
        got.setdefault(r.doc_no, set()).add(r.phrase)
    for no, body in bodies.items():
        blocks = [b for b in body.split(" ") if len(b) >= 2]
        known, single = {t: -math.log((c + 1) / n) for t, c in df.items()}, math.log(n / 2) + 4
        for b in blocks:
            pieces = labels.segmented(b, known, single)
            cost = sum(known[w] for w in pieces) + single * (len(b) - sum(map(len, pieces)))
            assert not pieces or pieces[0] not in known or abs(cost - cut(b)[0]) < 1e-9
        list_ = [w for b in blocks for w in labels.segmented(b, known, single)]
        want = {"".join(list_[i : i + k]) for k in (1, 2, 3) for i in range(len(list_) - k + 1)}
        assert got[no] == {p for p in want if 2 <= len(p) <= 6}
        assert len(list_) > 24 and any(p in body.split(" ")[-2] for p in got[no])
    few = tables.documents(spark, d)
    norm = labels.mining_text(few).limit(5).select(F.col("doc_no").alias("case_no"), F.substring("body", 1, 20).alias("norm"))
    from inkspan.operators import bridge

    for r in bridge.tokens(norm, index.frequencies(index.postings(docs)), F.lit(float(len(rows)))).join(norm, "case_no").collect():
        assert r.tokens == list(dict.fromkeys(labels.segmented(r.norm, known, single)))[:24]


def test_mining_holds_no_vocabulary_in_the_driver(monkeypatch, spark, tmp_path):
    """Messy texts, in several parts and slices, against the words cut one text after the other; nothing of the vocabulary is fetched."""
    monkeypatch.setattr(labels, "PART_DOCS", 2)
    monkeypatch.setattr(index, "SLICE_CHARS", 50)
    docs = tables.documents(spark, fixtures.write(spark, tmp_path, fixtures.messy()))
    n = docs.count() + 2
    known = {r.term: -math.log((r.df + 1) / n) for r in index.frequencies(index.postings(docs)).collect()}
    want = {(p, r.doc_no) for r in labels.mining_text(docs).collect() for p in labels.joined(labels.segmented(r.body, known, math.log(n / 2) + 4), 6)}

    def fetched(self, *_, **__):
        raise AssertionError("rows are fetched")

    monkeypatch.setattr(type(docs), "toLocalIterator", fetched)
    got = [(r.phrase, r.doc_no) for r in labels.phrases(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_drift_compares_the_curated_book_with_all_records(spark, tmp_path):
    rows = [record(n, "守城之法" if n < 4 else "别事", book="芦原书") for n in range(8)] + [record(10 + n, "守城粟尽援绝" if n < 2 else "粟尽援绝", book="旧记") for n in range(6)] + [record(20, "粟尽", book="")]
    d = fixtures.write(spark, tmp_path, {"corpus_doc": rows, "cases": [row("cases", case_no=1, query="守城粟尽", asked_at=fixtures.T0), row("cases", case_no=2, query="守城", asked_at=fixtures.T0), row("cases", case_no=3, query="无此", asked_at=fixtures.T0)]})
    got = {(r.case_no, r.doc_no): r for r in catalog.queries()["rank_drift_corpora"](spark, d).collect()}
    curated = {1: [0, 1, 2], 2: [0, 1, 2]}
    for case, docs in curated.items():
        assert [got[case, n].curated_rank for n in docs] == [1, 2, 3]
    evicted = [r for r in got.values() if r.evicted]
    assert len(evicted) >= 2 and all(r.loaded_rank > 3 for r in evicted)
    shown = [r for r in got.values() if (r.loaded_rank or 999) <= 3]
    assert sum(r.case_no == 1 for r in shown) == 3 and got[1, 10].from_shard and got[1, 10].loaded_rank == 1 and got[1, 10].curated_rank is None
    s = catalog.queries()["rank_drift_shares"](spark, d).first()
    assert (s.cases, s.hits, s.curated_docs, s.docs) == (2, 6, 8, 15) and s.shard_hits == sum(r.from_shard for r in shown) and s.lost_some >= 1


@pytest.mark.parametrize("block_postings", [20, 1 << 20])
def test_lists_of_a_folded_index_lose_no_passage_and_shuffle_none(monkeypatch, spark, block_postings):
    """Blocks made of the pieces of the index, one and several, against all hits ranked, with and without concerns."""
    monkeypatch.setattr(best, "BLOCK_POSTINGS", block_postings)
    monkeypatch.setattr(index, "SLICE_CHARS", 100)
    rng = random.Random(5)
    words = [chr(0x4E00 + i) * 2 for i in range(12)]
    docs = [(d, "，".join(rng.sample(words, rng.randrange(5))), rng.sample(["甲", "乙", "丙", "丁"], rng.randrange(3)), rng.choice(["上", "中", "下", "", ""])) for d in rng.sample(range(10**12), 300)]
    docs = spark.createDataFrame(docs, "doc_no long, original string, themes array<string>, verdict string").repartition(3)
    terms = [(c, k, t, k > 3) for c in range(40) for k, t in enumerate(rng.sample(words, rng.randrange(1, 7)))]
    terms = spark.createDataFrame(terms, "case_no long, term_ord int, term string, is_label boolean")
    concerns = spark.createDataFrame([(c, ["甲", "乙", "丙"][: c % 3 + 1]) for c in range(0, 40, 2)], "case_no long, concerns array<string>")
    post = index.wanted_postings(docs, terms)
    stats, n = index.frequencies(post), F.lit(300.0)
    hits = rank.scored(terms, post, stats, n)
    weighted = rank.weighted(terms, stats, n).select("case_no", "term", "w")
    pieces = index.folded(docs, terms, ["甲", "乙", "丙"]).checkpoint()
    assert sorted(index.unfolded(pieces).collect()) == sorted(post.select("term", "doc_no").collect())
    assert sorted(index.unfolded(pieces, [words[0], "甲", "甲乙丙丁戊"]).collect()) == sorted(post.select("term", "doc_no").where(F.col("term") == words[0]).collect())
    parts = -(-post.count() // block_postings)
    assert best.blocks(pieces, parts).count() >= (2 if parts > 1 else 1)
    monkeypatch.setattr(best, "cut", lambda df, parts, key, made, cut=best.cut: cut(df, parts, key, made) if made is best.grouped else pytest.fail("postings are shuffled"))
    for top in (200, 5):
        for asked in (concerns, None):
            lists = best.lists(weighted, pieces, None, asked, 300, top, n_postings=post.count())
            columns = ["case_no", "doc_no", "score", "n_terms", "rank"] + ["coverage"] * (asked is not None)
            plain = rank.situated(hits, concerns, docs, top) if asked is not None else rank.ranked(hits, top)
            assert sorted(best.unfolded(lists).select(*columns).collect()) == sorted(plain.select(*columns).collect())
    lists = best.lists(weighted, pieces, None, concerns, 300, n_postings=post.count())
    assert "MapInArrow" not in lists._jdf.queryExecution().toString()  # else all blocks come in one batch
    columns = ["case_no", "slot", "doc_no", "score", "rank", "verdict", "graded"]
    assert sorted(best.tiered(lists).select(*columns).collect()) == sorted(rank.tiered(rank.situated(hits, concerns, docs, 200), docs).select(*columns).collect())


@pytest.mark.parametrize("name", ["texts_tiers", "recall_by_confidence", "result_slots"])
def test_passages_without_their_terms_look_up_no_terms(monkeypatch, spark, tmp_path, name):
    monkeypatch.setattr(rank, "with_terms", lambda *_: pytest.fail("terms are looked up"))
    catalog.queries()[name](spark, corpus(spark, tmp_path)).collect()


def test_reasons_look_up_labels_only(monkeypatch, spark, tmp_path):
    looked = []
    monkeypatch.setattr(rank, "with_terms", lambda shown, terms, post, f=rank.with_terms: looked.append(post) or f(shown, terms, post))
    d = corpus(spark, tmp_path)
    p = Pipeline(spark, d)
    reasons = {(r.case_no, r.doc_no): r.why for r in p.reasons.collect()}
    assert {r.term for r in looked[0].select("term").distinct().collect()} <= set(p.names)
    assert reasons and reasons == {(r.case_no, r.doc_no): r.why for r in rank.why(p.tiers, p.expanded).collect()}


def test_pieces_of_many_documents_are_joined():
    """The places of a piece are short numbers, those of a block are not."""
    import numpy as np

    size, key = 40_000, np.array([7, 9])
    pieces = [(np.arange(size) * 3 + i, np.array([1, size - 1, 5], np.uint16), key, np.array([2, 1]), np.zeros(size, np.int8), np.array([2], np.int32), np.array([0]), ["甲"]) for i in range(3)]
    x = best.joined(pieces)
    found = {k: x["docs"][x["local"][a:b]].tolist() for k, a, b in zip(x["keys"].tolist(), x["first"], x["first"][1:])}
    assert found == {7: sorted(r * 3 + i for r in (1, size - 1) for i in range(3)), 9: [15, 16, 17]}
    assert x["docs"][x["themes"]["甲"]].tolist() == [6, 7, 8]


def test_a_block_is_joined_in_little_memory():
    """Besides the pieces, at most a number of eight bytes and one of four for each posting, and a piece's own."""
    import tracemalloc

    import numpy as np

    pieces = [(np.arange(1000) + 1000 * i, np.tile(np.arange(1000, dtype=np.uint16), 100), np.arange(100), np.full(100, 1000), np.zeros(1000, np.int8), np.zeros(0, np.int32), np.zeros(0, np.int64), []) for i in range(40)]
    tracemalloc.start()
    x = best.joined(pieces)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert x["local"].tolist() == list(range(40_000)) * 100
    assert peak < 16 * len(x["local"])


def test_bits_are_kept_only_where_they_take_less_than_the_list():
    import numpy as np

    lists = {"甲乙": np.array([3, 500, 999], np.int32), "丙丁": np.arange(0, 1000, 2, dtype=np.int32)}
    block = best.Block(np.arange(1000), [(0, t) for t in lists], np.array([0, 3]), np.concatenate(list(lists.values())))
    for ids in (np.arange(1000), np.array([3, 4, 999]), np.array([5]), np.zeros(0, np.int64)):
        for t, at in lists.items():
            assert block.has(t, ids).tolist() == np.isin(ids, at).tolist()
    assert list(block.bits) == ["丙丁"]


def test_terms_are_found_where_slots_are_crowded():
    """Many terms to a slot, terms of which others are the beginning, and none at all; terms lie by slot."""
    import numpy as np

    names = [a + b + c for a in "甲乙丙丁戊己庚辛" for b in "甲乙丙丁戊己庚辛" for c in ("", "甲", "乙丙")]
    body = "".join(random.Random(1).choices("甲乙丙丁戊己庚辛。", k=3000))
    cp = np.frombuffer(body.encode("utf-32-le"), np.uint32)
    known = index.Terms(index.keys_of(names))
    assert known.crowd > 1 and bool((np.diff(known.slot(known.keys).astype(np.int64)) >= 0).all())
    place, term = known.within(cp)
    found = index.terms_of(known.keys).to_pylist()
    assert sorted((p, found[t]) for p, t in zip(place.tolist(), term.tolist())) == sorted((p, t) for t in names for p in range(len(body)) if body.startswith(t, p))
    assert not len(index.Terms(np.zeros(0, np.int64)).within(cp)[0])


def test_packed_blocks_travel_in_parts(monkeypatch):
    """No row is larger than a part; the parts make the block again."""
    monkeypatch.setattr(best, "CHUNK", 100)
    x = list(range(1000))
    rows = [r for b in best.chunks(x) for r in b.to_pylist()]
    assert len(rows) > 2 and max(len(r["data"]) for r in rows) == 100
    assert best.opened(b"".join(r["data"] for r in rows)) == x and [r["last"] for r in rows] == [False] * (len(rows) - 1) + [True]
    assert [len(b) for b in best.chunks(x, whole=True)] == [1]
