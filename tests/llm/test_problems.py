"""Each operator against a plain version, an invariant or a hand-made case."""

import random
import re
import time
from collections import Counter, defaultdict
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from inkspan.llm import common, p02_lookalikes, p03_pieces, p04_alignment, p05_spans, p06_neardup, p08_packing, p09_mixing, p10_residue
from inkspan.llm.p01_terms import LastSeen, pair_counters
from inkspan.llm.p07_sentences import sentence_spans
from tests import fixtures
from tests.fixtures import record, row


def cut(text):
    return [text[a:b] for a, b in sentence_spans(text)]


def test_sentences():
    assert cut("甲退。乙进！？丙曰：「来乎？」，众默。") == ["甲退。", "乙进！？", "丙曰：「来乎？」，众默。"]
    assert cut("丙曰：「不可。」丁怒") == ["丙曰：「不可。」", "丁怒"]
    assert cut("曰：「谣云：『粟尽。』不可不备。」\n遂退；不追。") == ["曰：「谣云：『粟尽。』不可不备。」", "遂退；不追。"]
    assert cut("甲乙　丙丁\n戊己") == ["甲乙", "丙丁", "戊己"]
    assert cut("甲乙。　丙丁　戊") == ["甲乙。", "丙丁　戊"]
    assert cut("Gen. Li fell back 3.5 li... but Dr. Q. Wu (vol. 2, p. 7) stayed. “Come!” cried he. No. 5 burned.") == ["Gen. Li fell back 3.5 li... but Dr. Q. Wu (vol. 2, p. 7) stayed.", "“Come!” cried he.", "No. 5 burned."]
    assert cut("It ends.Next one.") == ["It ends.", "Next one."]
    assert cut("开而不闭「甲。乙。") == ["开而不闭「甲。", "乙。"]
    assert cut("") == [] and cut("  \n ") == [] and sentence_spans(None) == []


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="甲乙ab。.!?「」“”\n　 ,，1​", max_size=60))
def test_sentences_are_ordered_and_lose_only_blanks(text):
    spans = sentence_spans(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    kept = set(i for a, b in spans for i in range(a, b))
    assert all(text[i].isspace() for i in range(len(text)) if i not in kept)


def test_last_seen_counters():
    seen = LastSeen()
    for n, terms in enumerate([["a", "b", "a"], ["a"], ["c"]]):
        seen.add(terms, n)
    assert {k: v[:2] for k, v in seen.items()} == {"a": [3, 2], "b": [1, 1], "c": [1, 1]}


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="一二三鿿a，", max_size=12), max_size=6))
def test_pair_counters(texts):
    key, occ, recs = pair_counters(texts)
    plain, per = Counter(), defaultdict(set)
    for n, t in enumerate(texts):
        for x in (t[i : i + 2] for i in range(len(t) - 1)):
            if re.fullmatch("[一-鿿]{2}", x):
                plain[x] += 1
                per[x].add(n)
    got = {chr(k // 20992 + 0x4E00) + chr(k % 20992 + 0x4E00): (o, r) for k, o, r in zip(key.tolist(), occ.tolist(), recs.tolist())}
    assert got == {x: (n, len(per[x])) for x, n in plain.items()}


def test_lookalikes():
    texts = ["Ａ大е́ x…", "A⼤é x...", "A​大é x...", "‘A’", "'A'", "ab", "a b", "己", "已", "ё", "ë", "．…", "…．", "...."]
    canonical = p02_lookalikes.rewriter(*p02_lookalikes.rewriting(Counter("".join(texts))))
    a, b, c, curly, straight, none, blank, x, y, cyr, lat, d1, d2, d3 = map(canonical, texts)
    assert a == b == c and curly != straight and none != blank and x != y and cyr == lat and d1 == d2 == d3
    assert all(canonical(canonical(t)) == canonical(t) for t in texts)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["甲" * 37, "。", "，", "\n", "乙丙", "word ", "戊" * 1000, "「己。」", "己" * 850]), min_size=1, max_size=60))
def test_pieces(parts):
    text = "".join(parts)
    if len(text) <= 900:
        return
    own, start, end, hard = p03_pieces.pieces(["x。" * 500, text, "y" * 901])
    mine = [(int(a), int(b), bool(h)) for o, a, b, h in zip(own, start, end, hard) if o == 1]
    assert mine[0][0] == 0 and mine[-1][1] == len(text) and all(b - a <= 900 for a, b, _ in mine)
    assert all(a2 <= b1 < b2 and b1 - a2 <= 60 for (_, b1, _), (a2, b2, _) in zip(mine, mine[1:]))
    runs = max((len(m) for m in re.findall(r"[^\W_]+", text)), default=0)
    assert any(h for *_, h in mine) == (runs > 900)


def bare_tables(lexicon):
    return {x: p04_alignment.Table(*lexicon.answers) for x in (True, False)}


def test_alignment():
    lexicon = p04_alignment.Lexicon([("甲", "甲", "Jia", "given"), ("乙", "乙", "yi", "given"), ("城", "城", "Town", "suffix")])
    original = "王甲守东城三百日。李乙献白马二十匹。张丙筑城于西津。赵丁病卒于南陂。"
    merged = "王甲守卫东城300天；李乙献上白马20匹。以下据别本补。张丙在西津筑城。"
    pairs = set(p04_alignment.align(original, merged, lexicon, bare_tables(lexicon)))
    starts = [original.index(x) for x in ("王甲", "李乙", "张丙")]
    assert pairs == {(starts[0], 0), (starts[1], 0), (starts[2], merged.index("张丙"))}
    assert p04_alignment.align("", "甲。", lexicon, bare_tables(lexicon)) == [] and p04_alignment.number("九千零四十") == 9040 and p04_alignment.number("1,204.5") == 1204


def test_three_sentences_rendered_by_one():
    lexicon = p04_alignment.Lexicon([])
    original = "王甲守东城。李乙献白马。张丙筑石桥。赵丁卒南陂。"
    pairs = p04_alignment.align(original, "王甲守东城，李乙献白马，张丙筑石桥。赵丁卒于南陂。", lexicon, bare_tables(lexicon))
    assert pairs == [(0, 0), (6, 0), (12, 0), (18, 18)]


@pytest.mark.parametrize("cells", [1 << 21, 50])
def test_a_sentence_moved_five_hundred_places_is_found(monkeypatch, cells):
    """Also with the path decoded in blocks of rows."""
    monkeypatch.setattr(p04_alignment, "CELLS", cells * 40)
    chars = [chr(0x4E00 + i) for i in range(3000)]
    sentences = ["".join(random.Random(i).sample(chars, 9)) + "。" for i in range(900)]
    order = [*range(100), *range(101, 640), 100, *range(640, 900)]
    lexicon = p04_alignment.Lexicon([])
    pairs = p04_alignment.align("".join(sentences), "".join(sentences[i] for i in order), lexicon, bare_tables(lexicon))
    assert sorted(pairs) == sorted((i * 10, n * 10) for n, i in enumerate(order))


def slow_path(one, two, three):
    """The best value of a path over log odds [target][sentence] by trying every move."""
    m, n = one.shape
    best = {0: 0.0}
    for j in range(m):
        new = {}
        for last, v in best.items():
            new[last] = max(new.get(last, -1e9), v + p04_alignment.NULL)
            for start in range(n):
                jump = {0: p04_alignment.NEXT, -1: p04_alignment.SAME, 1: p04_alignment.OVER}.get(start - last, p04_alignment.ANY)
                for size, odds in enumerate((one, two, three)):
                    if start + size < n:
                        new[start + size + 1] = max(new.get(start + size + 1, -1e9), v + jump + p04_alignment.SPANS[size] + odds[j, start])
        best = new
    return max(best.values())


@pytest.mark.parametrize("seed", range(6))
def test_decoding_is_the_best_path(seed):
    rng = np.random.default_rng(seed)
    n, m = rng.integers(1, 8, 2)
    odds = rng.normal(0, 4, (1, m, 3, n)).round(3)
    costs = np.array(p04_alignment.SPANS)[:, None] + np.where(np.arange(n) + np.arange(1, 4)[:, None] <= n, 0.0, -np.inf)
    _, i, j = p04_alignment.decode(lambda lo, hi: odds[:, lo:hi] + costs, np.array([n]), np.array([m]))
    by = {t: sorted(i[j == t].tolist()) for t in set(j.tolist())}
    value, last = 0.0, 0
    for t in range(m):
        if t not in by:
            value += p04_alignment.NULL
            continue
        jump = {0: p04_alignment.NEXT, -1: p04_alignment.SAME, 1: p04_alignment.OVER}.get(by[t][0] - last, p04_alignment.ANY)
        size = len(by[t])
        value += jump + p04_alignment.SPANS[size - 1] + odds[0, t, size - 1, by[t][0]]
        last = by[t][-1] + 1
    assert abs(value - slow_path(odds[0, :, 0], odds[0, :, 1], odds[0, :, 2])) < 1e-6


WORDS = [("某甲守城", "guarded the town"), ("粟尽援绝", "grain ran out"), ("夜袭敌营", "raided the camp"), ("筑堤引水", "built a dike"), ("上表辞官", "resigned by letter"), ("开仓济民", "opened the granary"), ("大旱三年", "drought lasted"), ("遣使求和", "sent envoys")]


def fitted_on(spark, docs, lexicon):
    rows = spark.createDataFrame(docs, "doc_no long, original string, translation string").repartition(3)
    return p04_alignment.fitted(p04_alignment.prepared(rows, lexicon), lexicon)


def test_the_learned_table_answers_held_out_sentences(spark):
    rng = random.Random(1)
    docs = []
    for n in range(60):
        some = rng.sample(WORDS, 4)
        docs.append((n, "".join(f"{a}。" for a, _ in some), " ".join(f"He {b}." for _, b in some)))
    lexicon = p04_alignment.Lexicon([])
    tables = fitted_on(spark, docs, lexicon)
    right = total = 0
    for _ in range(40):
        some = rng.sample(WORDS, 5)
        order = some[1:] + some[:1]
        pairs = p04_alignment.align("".join(f"{a}。" for a, _ in some), " ".join(f"He {b}." for _, b in order), lexicon, tables)
        starts, at = {a: 5 * i for i, (a, _) in enumerate(some)}, 0
        for a, b in order:
            right += (starts[a], at) in pairs
            total += 1
            at += len(f"He {b}. ")
    assert right >= 0.9 * total


def test_the_table_is_learned_from_all_records_of_any_length(spark):
    """A word that only five of 4,000 records have, and one that only texts of more than 4,000 characters have, get their answers."""
    rng = random.Random(2)
    docs = []
    for n in range(4000):
        some = rng.sample(WORDS[:6], 3)
        if n % 800 == 7:
            some.insert(1, ("麒麟", "unicorn"))
        if n % 800 == 9:
            some = [*(some * 120), ("鸑鷟", "phoenix")]
        docs.append((n, "".join(f"{a}。" for a, _ in some), " ".join(f"He {b}." for _, b in some)))
    assert max(len(t) for _, _, t in docs) > 4000
    table = fitted_on(spark, docs, p04_alignment.Lexicon([]))[True]
    for a, b in (("麒麟", "unicorn"), ("鸑鷟", "phoenix")):
        _, t, w = table.of(p04_alignment.grams_of([a]) >> np.uint64(2))
        assert (p04_alignment.words_of([b])[0] >> np.uint64(2)) in t


def test_packed_texts_come_back():
    lexicon = p04_alignment.Lexicon([("甲", "甲", "Jia", "given")])
    for x in p04_alignment.read([(5, "王甲守。三千。", "Wang Jia held. 3,000."), (9, "王甲守。", "王甲守住。"), (7, "", "")], lexicon):
        for a, b in zip(x, p04_alignment.Texts.unpacked(x.packed())):
            assert np.array_equal(a, b)


def brute_spans(texts):
    where = defaultdict(set)
    for n, t in texts.items():
        for i in range(len(t) - 47):
            where[t[i : i + 48]].add(n)
    out = set()
    for n, t in texts.items():
        cover = sorted(i for i in range(len(t) - 47) if len(where[t[i : i + 48]]) > 1)
        while cover:
            a = e = cover[0]
            while cover and cover[0] <= e + 48:
                e = cover.pop(0)
            out.add((n, a, e + 48))
    return out


def test_shared_spans(spark):
    rng = random.Random(3)
    base = ["".join(rng.choice("甲乙丙丁戊己") for _ in range(300)) for _ in range(6)]
    texts = {n: rng.choice(base)[rng.randrange(150) :][: rng.randrange(40, 200)] + rng.choice(base)[: rng.randrange(120)] for n in range(40)}
    texts[50], texts[51], texts[52] = "天" * 200, "天" * 120 + "地", "甲乙" * 100
    docs = spark.createDataFrame(list(texts.items()), "doc_no long, text string")
    got = {tuple(r) for r in p05_spans.shared_spans(docs.unionAll(docs.limit(3))).collect()}
    assert got == brute_spans(texts)


def variants(rng, n):
    words = ["".join(rng.choice("甲乙丙丁戊己庚辛壬癸子丑寅卯") for _ in range(7)) for _ in range(60)]
    texts = {}
    for i in range(n):
        if texts and rng.random() < 0.6:
            parts = list(rng.choice(list(texts.values())))
            for _ in range(rng.randrange(0, len(parts) // 6 + 2)):
                parts[rng.randrange(len(parts))] = rng.choice("甲乙丙丁戊己天地")
            texts[i] = "".join(parts)
        else:
            texts[i] = "".join(rng.choice(words) for _ in range(rng.choice([1, 2, 3, 6, 20, 60])))
    return texts


@pytest.mark.parametrize("part_keys", [3_000_000, 100])
def test_near_duplicates(monkeypatch, spark, part_keys):
    """Also with many parts, several classes of sizes, and texts at the edges of the classes."""
    monkeypatch.setattr(p06_neardup, "PART_KEYS", part_keys)
    texts = variants(random.Random(5), 150) | {900: "甲乙", 901: "甲乙", 902: "甲乙丙", 903: "甲乙丙"}
    rng = random.Random(6)
    for k, size in enumerate((44, 47, 48, 50, 70, 80, 236, 239, 241, 260, 390, 410, 1210)):
        base = [chr(rng.randrange(0x4E00, 0x9000)) for _ in range(size)]
        texts[1000 + 10 * k] = "".join(base)
        for i, part in enumerate((0.0, 0.05, 0.08, 0.1, 0.3), 1):
            more = [c if rng.random() > part else chr(rng.randrange(0x4E00, 0x9000)) for c in base] + ["尾"] * rng.randrange(1, 9)
            texts[1000 + 10 * k + i] = "".join(more) + "".join(chr(rng.randrange(0x4E00, 0x9000)) for _ in range(rng.randrange(int(size * 0.3))))
    docs = spark.createDataFrame(list(texts.items()), "doc_no long, text string")
    pairs, members = p06_neardup.near_duplicates(docs)
    rep = {r.doc_no: r.rep for r in members.collect()}
    got = [(r.a, r.b) for r in pairs.collect()]
    reps = sorted(set(rep.values()))
    want = {(a, b) for a in reps for b in reps if a < b and p06_neardup.similar(texts[a], texts[b])}
    assert set(got) == want and len(got) == len(want) and sum(a >= 1000 for a, _ in want) > 40
    assert rep[901] == 900 and rep[903] == 902


def test_near_duplicates_keep_texts_compressed(spark):
    rng = random.Random(5)
    texts = {i: "".join(rng.choices("天地玄黄宇宙洪荒日月盈昃辰宿列张", k=2000)) for i in range(40)}
    at = spark.sparkContext._jsc.sc().getCheckpointDir().get()
    held = lambda: sum(p.stat().st_size for p in Path(at.removeprefix("file:")).rglob("part-*"))
    docs = spark.createDataFrame(list(texts.items()), "doc_no long, text string")
    before = held()
    pairs, _ = p06_neardup.near_duplicates(docs)
    assert pairs.count() == 0
    assert held() - before < sum(len(t.encode()) for t in texts.values()) / 2


def test_hot_keys_are_split_without_loss(monkeypatch):
    monkeypatch.setattr(p06_neardup, "BLOCK", 4)
    rng = random.Random(7)
    step = np.array([rng.randrange(100, 120) for _ in range(30)])
    key, text = np.repeat([7, 9], 30), np.tile(np.arange(30) * 2 + 1, 2)
    blob = p06_neardup.blob(key, text, np.tile(step, 2))
    found = {tuple(sorted(p)) for k, x, y in p06_neardup.met([blob]) for a, b in p06_neardup.opened(k, x, y) for p in zip(a.tolist(), b.tolist())}
    assert found == {(i, j) for i in range(30) for j in range(i + 1, 30) if abs(step[i] - step[j]) <= p06_neardup.STEPS}


def test_blobs_come_back():
    key, text, step = np.array([5, 5, 900, 1 << 50]), np.array([3, 1 << 40, (1 << 40) + 6, 8 + (1 << 33)]), np.array([0, 255, 3, 9])
    text = (1 << 40) + np.array([3, 0, 6, 1 << 31])
    for a, b in zip((key, text, step), p06_neardup.unpacked([p06_neardup.blob(key, text, step)])):
        assert np.array_equal(a, b)


def test_pairs_are_packed_each_once_and_meet_their_points_some_at_a_time(monkeypatch, spark):
    """Pairs come back from their blobs, a part of many pairs is opened in slices, and so are the points, with the same result."""
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 40, 5000)
    a, b = np.repeat(a, 3), np.repeat(a + rng.integers(1, 1 << 34, 5000), 3)
    monkeypatch.setattr(p06_neardup, "HELD", 700)
    got = [p for _, blobs in p06_neardup.dealt(iter([(a, b)]), 4) for x in blobs for y in p06_neardup.once([x, x], 4) for p in zip(*(z.tolist() for z in p06_neardup.pairs_of(y)))]
    assert len(got) == len(set(got)) and set(got) == set(zip(a.tolist(), b.tolist()))
    o = np.argsort(a)
    assert len(p06_neardup.pair_blob(a[o], b[o])) < 16 * len(a) * 0.5
    docs = spark.createDataFrame(list(variants(random.Random(8), 80).items()), "doc_no long, text string")
    want = {tuple(r) for r in p06_neardup.near_duplicates(docs)[0].collect()}
    monkeypatch.setattr(p06_neardup, "PAIRS_A_TEXT", 2)
    assert want and {tuple(r) for r in p06_neardup.near_duplicates(docs)[0].collect()} == want


def test_points_of_many_pairs_are_compared_at_once():
    texts = list(variants(random.Random(9), 60).values()) + ["".join(chr(0x4E00 + i % 7000) for i in range(9000))]
    points = p06_neardup.count_vector(texts)
    x, y = zip(*[(p, q) for p in points for q in points])
    for p, q, ok in zip(x, y, p06_neardup.may_match(list(x), list(y)).tolist()):
        n, a = int.from_bytes(p[:4], "little"), np.frombuffer(p, np.uint8, offset=4).astype(int)
        m, b = int.from_bytes(q[:4], "little"), np.frombuffer(q, np.uint8, offset=4).astype(int)
        least = min(len(a), len(b))
        shared = np.minimum(a.reshape(-1, least).sum(0), b.reshape(-1, least).sum(0)).sum()
        assert ok == (max(n, m) > 8192 or 8 * shared >= 3 * (n + m))


def test_files_of_finished_steps_are_freed(spark):
    """Asked once: a single collection leaves them."""
    sc = spark.sparkContext._jsc.sc()
    first = sc.newShuffleId()
    df = spark.range(100).repartition(3, "id").checkpoint()
    held = lambda: [i for i in range(first, last) if sc.env().mapOutputTracker().containsShuffle(i)]
    last = sc.newShuffleId()
    assert held()
    common.freed(spark)
    for _ in range(30):
        if not held():
            break
        time.sleep(0.1)
    assert not held() and df.count() == 100


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 4), (9, 8), (8, 7), (5, 6)], "a long, b long")
    assert {tuple(r) for r in p06_neardup.components(edges).collect()} == {(1, 1), (2, 1), (3, 1), (4, 1), (7, 7), (8, 7), (9, 7), (5, 5), (6, 5)}


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 2048), max_size=200))
def test_packing_keeps_limits(sizes):
    container, place = p08_packing.pack(np.array(sizes, np.int64), segments=8)
    load, count = Counter(), Counter()
    for c, s in zip(container.tolist(), sizes):
        load[c] += s
        count[c] += 1
    assert all(v <= 2048 for v in load.values()) and all(v <= 8 for v in count.values())
    assert len(set(zip(container.tolist(), place.tolist()))) == len(sizes)


def test_packing_round_trip(spark, tmp_path):
    docs = [row("documents", doc_id=i, text="some words of a text " * (1 + i * 37 % 900)) for i in range(60)]
    d = fixtures.write(spark, tmp_path, {"documents": docs})
    rows = p08_packing.p8_packed(spark, d).collect()
    spans = defaultdict(list)
    for r in rows:
        spans[r.doc_id].append((r.token_start, r.token_end))
    total = sum(r.token_end - r.token_start for r in rows)
    for s in spans.values():
        s.sort()
        assert s[0][0] == 0 and all(x[1] == y[0] for x, y in zip(s, s[1:])) and (len(s) == 1 or s[-1][1] > 2048)
    fill = p08_packing.p8_fill(spark, d).first()
    assert len(spans) == 60 and fill.tokens == total and fill.fullest <= 2048 and fill.containers <= total / 2048 * 1.1 + 1


def test_mixing(spark, tmp_path):
    docs = [row("documents", doc_id=1000 * k + i, text=f"{s} text {i} " * (5 + i % 11), source=s) for k, s in enumerate("abc") for i in range({"a": 300, "b": 60, "c": 300}[s])]
    docs += [row("documents", doc_id=9000 + i, text="a text 3 " * 8, source="a") for i in range(50)] + [row("documents", doc_id=9900, text="x", source="unwanted")]
    goal = [row("mix_target", source=s, target_share=w, max_repeat=m) for s, w, m in (("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.2, 2), ("gone", 0.1, 2))]
    d = fixtures.write(spark, tmp_path, {"documents": docs, "mix_target": goal})
    used = p09_mixing.p9_mix(spark, d).collect()
    total = sum(r.tokens * r.copies for r in used)
    for s, w, m in (("a", 0.3, 1), ("b", 0.4, 3), ("c", 0.2, 2)):
        mine = [r for r in used if r.source == s]
        assert abs(sum(r.tokens * r.copies for r in mine) / total - w / 0.9) < 0.01 and max(r.copies for r in mine) <= m
    assert sum(r.doc_id >= 9000 for r in used) == 0
    report = {r.source: r for r in p09_mixing.p9_shares(spark, d).collect()}
    assert report["gone"].tokens == 0 and set(report) == {"a", "b", "c", "gone"}


def test_residue():
    a = p10_residue._automaton()
    yes = ["书名：{{title}}", "城破。\n\n您没有权限查看该分片。", "Traceback (most recent call last):", "他说%s走了", "404 Not Found", "Lorem ipsum dolor sit amet sed.", "待补充……待补充……", "甲【此处填写译文】乙", "Please enable JS and disable any ad blocker."]
    no = [None, "", "凡例云：遇缺题则书「{{卷名}}」，校后补正。", "编者记：网页曾显示“页面不存在”，重新上传后可读。", "counted 404 households, and 502 were not found in either.", "今本{衍}字凡六，[补]者六，作□□。", "The lines [here the text is broken] end.", "mocks the habit of setting “lorem ipsum” when the copy came late"]
    assert [p10_residue.is_residue(t, a) for t in yes] == [True] * len(yes)
    assert [p10_residue.is_residue(t, a) for t in no] == [False] * len(no)


def test_dummy_latin_of_any_listed_words():
    a = p10_residue._automaton()
    yes = ["Quaero fossa mirum alta mirum limen sed mirum.", "城破。\nVelum ventis, fossa porta limen.\n遂降。", "Ut labore et dolore magna aliqua"]
    no = ["The porta of the town was shut at dusk, et cetera.", "Do sit, do sit.", "Sedimentary limens and altars of nostrand porters.", "The Magna Carta"]
    assert [p10_residue.is_residue(t, a) for t in yes] == [True] * len(yes)
    assert [p10_residue.is_residue(t, a) for t in no] == [False] * len(no)


def test_records_count_once(spark, tmp_path):
    d = fixtures.write(spark, tmp_path, {"corpus_doc": [record(1, "甲。乙。", "x"), record(1, "甲。乙。", "x", loaded_at=fixtures.T1)]})
    from inkspan.llm import queries

    assert queries()["p7_found"](spark, d).count() == 3
