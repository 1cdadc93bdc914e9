"""DuckDB SQL for the queries of the catalog, written independently of the Spark plans."""

from __future__ import annotations

# Written out here, not taken from the code that these queries check.
FULL = "".join(chr(c) for c in range(0xFF01, 0xFF5F))
HALF = "".join(chr(c) for c in range(0x21, 0x7F))
NEGATIONS = "不没无别勿莫"
STOPS = (
    "不断 互相 已经 有人 一直 可能 应该 需要 很多 时候 地方 事情 问题 情况 方面 这样 那样 这些 那些 一样 什么 怎么 如何 多少 几个 因为 所以 因此 因而 从而 但是 而且 如果 虽然 然后 还是 或者 还有 就是 只是 不过 甚至 "
    "尤其 反而 现在 当时 如今 之前 之后 以后 以前 目前 起来 还在 一起 一再 越来越 最重 我们 他们 你们 自己 对方 别人 大家 上面 下面 里面 外面 一个 一次 每次"
).split()
W = "一-鿿㐀-䶿0-9A-Za-z"
TRIM = r"[\s\p{Z}\x{1c}-\x{1f}]+"


def _list(c: str) -> str:
    stripped = rf"regexp_replace(regexp_replace(x, '^{TRIM}', ''), '{TRIM}$', '')"
    return f"list_filter(list_transform(coalesce({c}, []::VARCHAR[]), lambda x: {stripped}), lambda x: x IS NOT NULL AND x <> '')"


_STRINGS = ["book", "chapter", "title", "original", "translation", "decision", "outcome", "cause", "process", "significance", "verdict_why"]
_ARRAYS = ["figures", "themes", "pros", "cons", "cast_list"]
_one = ", ".join(f"max_by({c}, loaded_at) AS {c}" for c in [*_STRINGS, *_ARRAYS, "verdict", "item_index"])
DOC = (
    f"raw AS (SELECT doc_no, {_one} FROM corpus_doc WHERE doc_no IS NOT NULL GROUP BY doc_no),\n"
    f"doc AS MATERIALIZED (SELECT doc_no, item_index, {', '.join(f'coalesce({c}, chr(0)[1:0]) AS {c}' for c in _STRINGS)}, {', '.join(f'{_list(c)} AS {c}' for c in _ARRAYS)},\n"
    f"  CASE WHEN v IN ('上', '上策') THEN '上' WHEN v IN ('中', '中策') THEN '中' WHEN v IN ('下', '下策') THEN '下' ELSE '' END AS verdict\n"
    f"  FROM (SELECT *, regexp_replace(regexp_replace(coalesce(verdict, ''), '^{TRIM}', ''), '{TRIM}$', '') AS v FROM raw))"
).replace("chr(0)[1:0]", "''")


def _masked(c: str) -> str:
    for w in sorted(STOPS, key=lambda w: (-len(w), w)):
        c = f"replace({c}, '{w}', '')"
    return c


CASES = "ask AS (SELECT case_no, coalesce(max_by(query, asked_at), '') AS query, coalesce(max_by(want, asked_at), []::VARCHAR[]) AS want, coalesce(max_by(confidence, asked_at), '') AS confidence FROM cases WHERE case_no IS NOT NULL GROUP BY case_no)"
TEXTS = "ask AS (SELECT doc_no AS case_no, translation AS query FROM doc WHERE doc_no % 50 = 0)"
TITLES = "ask AS (SELECT doc_no AS case_no, title AS query FROM doc WHERE doc_no % 50 = 0)"
_full, _half = FULL + "　", (HALF + " ").replace("'", "''")
NORM = (
    f"n0 AS (SELECT case_no, trim(regexp_replace(translate(query, '{_full}', '{_half}'), '[^{W}]+', ' ', 'g')) AS norm FROM ask),\n"
    f"norm AS (SELECT case_no, norm, {_masked('norm')} AS masked FROM n0)"
)
GRAMS = (
    f"fld AS (SELECT doc_no, unnest([title, original, translation, decision, outcome, cause, process, significance, verdict_why] || figures || themes || cast_list) AS t FROM doc),\n"
    f"blk AS (SELECT doc_no, unnest(regexp_extract_all(t, '[{W}]+')) AS b FROM fld),\n"
    "gram AS MATERIALIZED (SELECT DISTINCT doc_no, substr(b, i, k) AS term FROM (SELECT doc_no, b, k, unnest(range(1, length(b) - k + 2)) AS i FROM blk, (VALUES (2), (3), (4)) v(k) WHERE length(b) >= k)),\n"
    "df AS MATERIALIZED (SELECT term, count(*) AS df FROM gram GROUP BY term),\n"
    "nd AS (SELECT count(*)::DOUBLE AS n FROM doc)"
)
LAB = (
    "lab0 AS (SELECT label, coalesce(any_value(short_triggers), []::VARCHAR[]) AS short, coalesce(any_value(triggers), []::VARCHAR[]) AS triggers FROM label_table WHERE label <> '' GROUP BY label),\n"
    "lab1 AS (SELECT label, (row_number() OVER (ORDER BY label))::INT AS label_ord, short, [label] || list_filter(triggers, lambda x: x <> '' AND x <> label) AS t FROM lab0),\n"
    "lab2 AS (SELECT label, label_ord, short, t, unnest(range(1, len(t) + 1)) AS p FROM lab1),\n"
    f"lab AS (SELECT label, label_ord, t[p] AS trigger, (row_number() OVER (PARTITION BY label ORDER BY p) - 1)::INT AS trigger_ord, list_contains(short, t[p]) AS is_short_allowed, {_masked('t[p]')} AS core FROM lab2 WHERE list_position(t, t[p]) = p)"
)
TRG = "trg AS (SELECT lab.*, coalesce(a.df, 0) AS trigger_df, coalesce(b.df, 0) AS core_df FROM lab LEFT JOIN df a ON a.term = trigger LEFT JOIN df b ON b.term = core)"
LABELS = LAB + ",\n" + TRG
_frames = "['近来' || trigger || '，该当如何？', '并不' || trigger, substr(trigger, 1, 1) || '一' || substr(trigger, 2) || '！', substr(trigger, 1, 2) || '三五七' || substr(trigger, 3), '已经' || substr(trigger, 1, 1) || '已经' || substr(trigger, 2) || '但是', '没有，' || trigger || '。再说']"
PHRASES = f"ask AS (SELECT label_ord * 10000 + trigger_ord * 10 + f - 1 AS case_no, q[f] AS query FROM (SELECT label_ord, trigger_ord, {_frames} AS q, unnest(range(1, 7)) AS f FROM lab))"


def _hit(m: str, hay: str) -> str:
    neg = f"contains('{NEGATIONS}', substr({hay}, i - 1, 1))"
    return f"len(list_filter(range(1, length({hay}) + 1), lambda i: substr({hay}, i, length({m})) = {m} AND NOT (i > 1 AND {neg}) AND NOT (i + length({m}) <= length({hay}) AND contains('{NEGATIONS}', substr({hay}, i + length({m}), 1))))) > 0"


_gap = "length(regexp_extract(masked, array_to_string(string_split(core, ''), '.*?'))) BETWEEN length(core) AND length(core) + 2"
BRIDGE = (
    f"mat AS (SELECT case_no, label, label_ord, trigger, trigger_ord FROM norm, trg WHERE CASE WHEN trigger_ord = 0 THEN {_hit('trigger', 'norm')}\n"
    f"  WHEN length(trigger) < 3 THEN is_short_allowed AND trigger_df <= 15 AND {_hit('trigger', 'masked')}\n"
    f"  WHEN length(core) < 2 OR core_df > 15 THEN {_hit('trigger', 'norm')} WHEN core = label THEN false\n"
    f"  WHEN length(core) = 2 THEN {_hit('core', 'masked')} ELSE {_gap} END),\n"
    "expd AS (SELECT case_no, label, label_ord, list(trigger ORDER BY trigger_ord) AS said FROM mat WHERE label IN (SELECT term FROM df) GROUP BY ALL),\n"
    "con AS (SELECT case_no, list(label ORDER BY label_ord)[1:6] AS concerns FROM expd GROUP BY case_no)"
)
_stops = "[" + ", ".join(f"'{w}'" for w in STOPS) + "]"
TOKENS = (
    "qb AS (SELECT case_no, p AS block_ord, b[p] AS block FROM (SELECT case_no, b, unnest(range(1, len(b) + 1)) AS p FROM (SELECT case_no, list_filter(string_split(norm, ' '), lambda x: length(x) >= 2) AS b FROM norm))),\n"
    "vit(block, i, best, back) AS (SELECT DISTINCT block, 0, [0.0::DOUBLE], []::INT[] FROM qb UNION ALL\n"
    "  SELECT block, i + 1, list_append(best, c4), list_append(back, k4) FROM (\n"
    "   SELECT *, CASE WHEN w4 < c3 THEN w4 ELSE c3 END AS c4, CASE WHEN w4 < c3 THEN 4 ELSE k3 END AS k4 FROM (\n"
    "    SELECT *, CASE WHEN w3 < c2 THEN w3 ELSE c2 END AS c3, CASE WHEN w3 < c2 THEN 3 ELSE k2 END AS k3 FROM (\n"
    "     SELECT *, CASE WHEN w2 < c1 THEN w2 ELSE c1 END AS c2, CASE WHEN w2 < c1 THEN 2 ELSE 1 END AS k2 FROM (\n"
    "      SELECT v.block, v.i, v.best, v.back, v.best[i + 1] - ln(2.0 / (n + 2)) + 4.0 AS c1,\n"
    "       CASE WHEN i >= 1 THEN v.best[i] - ln((d2.df + 1) / (n + 2)) END AS w2, CASE WHEN i >= 2 THEN v.best[i - 1] - ln((d3.df + 1) / (n + 2)) END AS w3, CASE WHEN i >= 3 THEN v.best[i - 2] - ln((d4.df + 1) / (n + 2)) END AS w4\n"
    "      FROM vit v CROSS JOIN nd LEFT JOIN df d2 ON d2.term = substr(block, i, 2) LEFT JOIN df d3 ON i >= 2 AND d3.term = substr(block, i - 1, 3) LEFT JOIN df d4 ON i >= 3 AND d4.term = substr(block, i - 2, 4)\n"
    "      WHERE i < length(block)))))),\n"
    "trace(block, e, out) AS (SELECT block, i, []::VARCHAR[] FROM vit WHERE i = length(block) UNION ALL\n"
    "  SELECT t.block, e - v.back[e], CASE WHEN v.back[e] >= 2 THEN list_prepend(substr(t.block, e - v.back[e] + 1, v.back[e]), out) ELSE out END\n"
    "  FROM trace t JOIN vit v ON v.block = t.block AND v.i = length(v.block) WHERE e > 0),\n"
    "pieces AS (SELECT block, out FROM trace WHERE e = 0),\n"
    "tk0 AS (SELECT case_no, block_ord, p, o[p] AS token FROM (SELECT case_no, block_ord, out AS o, unnest(range(1, len(out) + 1)) AS p FROM qb JOIN pieces USING (block))),\n"
    f"tk1 AS (SELECT case_no, token, min(block_ord * 1000 + p) AS o FROM tk0 WHERE NOT list_contains({_stops}, token) GROUP BY ALL),\n"
    "tk2 AS (SELECT case_no, list(token ORDER BY o) AS t FROM tk1 GROUP BY case_no),\n"
    "bg0 AS (SELECT case_no, substr(block, i, 2) AS token, block_ord * 1000 + i AS o FROM (SELECT case_no, block, block_ord, unnest(range(1, length(block))) AS i FROM qb)),\n"
    "bg AS (SELECT case_no, list(token ORDER BY o) AS t FROM (SELECT case_no, token, min(o) AS o FROM bg0 GROUP BY ALL) GROUP BY case_no),\n"
    "tok AS (SELECT case_no, coalesce(tk2.t, bg.t, []::VARCHAR[])[1:24] AS tokens FROM norm LEFT JOIN tk2 USING (case_no) LEFT JOIN bg USING (case_no))"
)
SCORES = (
    "tm0 AS (SELECT case_no, tokens[p] AS term, p AS o, false AS is_label FROM (SELECT case_no, tokens, unnest(range(1, len(tokens) + 1)) AS p FROM tok)),\n"
    "tm AS (SELECT * FROM tm0 UNION ALL SELECT case_no, label, 1000 + label_ord, true FROM expd e WHERE NOT EXISTS (SELECT 1 FROM tm0 WHERE tm0.case_no = e.case_no AND tm0.term = e.label)),\n"
    "wt AS (SELECT case_no, term, o, is_label, (ln((n + 1) / (df + 1)) + 1) * CASE WHEN length(term) >= 3 THEN 1.35 ELSE 1 END * CASE WHEN is_label THEN 0.75 ELSE 1 END AS w FROM tm JOIN df USING (term), nd),\n"
    "hit AS (SELECT case_no, doc_no, round(max(w) + 0.3 * (sum(w ORDER BY o) - max(w)), 9) AS score, count(*)::INT AS n_terms, list(term || CASE WHEN is_label THEN '（同义）' ELSE '' END ORDER BY o) AS terms FROM wt JOIN gram USING (term) GROUP BY ALL),\n"
    "sit0 AS (SELECT hit.*, coalesce(concerns, []::VARCHAR[]) AS concerns, len(list_distinct(list_intersect(themes, coalesce(concerns, []::VARCHAR[]))))::INT AS coverage FROM hit JOIN doc USING (doc_no) LEFT JOIN con USING (case_no)),\n"
    "sit1 AS (SELECT *, coverage >= CASE WHEN len(concerns) >= 2 THEN 2 ELSE 1 END AS q FROM sit0),\n"
    "sit AS (SELECT *, row_number() OVER (PARTITION BY case_no ORDER BY q DESC, CASE WHEN q THEN coverage ELSE 0 END DESC, score DESC, n_terms DESC, doc_no)::INT AS rank FROM sit1),\n"
    "pool AS (SELECT sit.*, verdict, max(score) OVER (PARTITION BY case_no) AS best FROM sit JOIN doc USING (doc_no) WHERE rank <= 200),\n"
    "gr AS (SELECT *, row_number() OVER (PARTITION BY case_no, verdict ORDER BY rank) AS k FROM pool WHERE verdict <> '' AND score >= best * 0.35),\n"
    "tier AS (SELECT case_no, row_number() OVER (PARTITION BY case_no ORDER BY list_position(['上', '中', '下'], verdict))::INT AS slot, verdict, doc_no, score, coverage, terms, true AS graded FROM gr WHERE k = 1\n"
    "  UNION ALL SELECT case_no, rank, verdict, doc_no, score, coverage, terms, false FROM pool WHERE rank <= 3 AND case_no NOT IN (SELECT case_no FROM gr)),\n"
    "why0 AS (SELECT case_no, doc_no, p, regexp_replace(terms[p], '（同义）$', '') AS label FROM (SELECT *, unnest(range(1, len(terms) + 1)) AS p FROM tier)),\n"
    "why1 AS (SELECT case_no, doc_no, p, label, s, said[s] AS said FROM (SELECT case_no, doc_no, p, label, said, unnest(range(1, len(said) + 1)) AS s FROM why0 JOIN expd USING (case_no, label))),\n"
    "why AS (SELECT case_no, doc_no, array_to_string((list(said || '>' || label ORDER BY p, s))[1:4], '|') AS why FROM why1 WHERE said <> label GROUP BY ALL)"
)


def _with(*parts: str, last: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts) + "\n" + last


def _search(last: str, asked: str = CASES) -> str:
    return _with(DOC, LAB, asked, NORM, GRAMS, TRG, BRIDGE, TOKENS, SCORES, last=last)


def _bridge(last: str, asked: str = CASES) -> str:
    return _with(DOC, LAB, asked, NORM, GRAMS, TRG, BRIDGE, last=last)


THEMED = "thm AS (SELECT DISTINCT doc_no, unnest(themes) AS label FROM doc)"
DIRECTED = (
    THEMED + ",\n"
    "dir AS (SELECT l.label, l.trigger AS term, count(g.doc_no) AS df, count(t.label) AS df_label FROM (SELECT DISTINCT label, trigger FROM lab) l LEFT JOIN gram g ON g.term = l.trigger LEFT JOIN thm t ON t.doc_no = g.doc_no AND t.label = l.label GROUP BY ALL),\n"
    "dirp AS (SELECT *, CASE WHEN df > 0 THEN round(df_label / df, 6) ELSE 0.0 END AS p FROM dir)"
)
MINE_TEXT = f"body0 AS (SELECT doc_no, trim(regexp_replace(translate(concat_ws(' ', title, original, translation, decision, outcome, cause, process, significance, array_to_string(themes, ' '), array_to_string(pros, ' '), array_to_string(cons, ' ')), '{_full}', '{_half}'), '[^{W}]+', ' ', 'g')) AS b FROM doc), body AS (SELECT doc_no, {_masked('b')} AS body FROM body0)"
ANN = (
    "ann0 AS (SELECT *, row_number() OVER (PARTITION BY book, chapter, item_index ORDER BY (verdict IS NOT NULL) DESC, annotated_at DESC NULLS LAST, cause DESC NULLS LAST, process DESC NULLS LAST, decision DESC NULLS LAST, outcome DESC NULLS LAST, significance DESC NULLS LAST, verdict DESC NULLS LAST, verdict_why DESC NULLS LAST) AS k FROM annotation),\n"
    "ann AS (SELECT * FROM ann0 WHERE k = 1)"
)


def _fill(a: str, b: str) -> str:
    """Fields of side a, else of side b."""
    s = ", ".join(f"coalesce(nullif({a}.{c}, ''), nullif({b}.{c}, ''), '') AS {c}" for c in ("cause", "outcome", "verdict"))
    t = f"coalesce(CASE WHEN len({a}.themes) > 0 THEN {a}.themes END, CASE WHEN len({b}.themes) > 0 THEN {b}.themes END, []::VARCHAR[])"
    return _with(DOC, ANN, last=f"SELECT raw.doc_no, {s}, array_to_string({t}, '|') AS themes FROM raw LEFT JOIN ann USING (book, chapter, item_index)")


_tokens10 = "CAST(ceil((3 * length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g')) + 6 * (length({0}) - length(regexp_replace({0}, '[^\\x00-\\x7F]', '', 'g')))) / 10.0) AS BIGINT)"
_cut4000 = "CASE WHEN length({0}) > 4000 THEN substr({0}, 1, 4000) || '…' ELSE {0} END"


def _dirty(c: str, as_: str = "::INT") -> dict[str, str]:
    return {
        "has_nav": f"regexp_matches({c}, '[上下]一[节章]'){as_}",
        "has_html": f"regexp_matches({c}, '</?[A-Za-z][^>]*>|&[a-z]+;|&#[0-9]+;'){as_}",
        "has_bad_char": f"contains({c}, '�'){as_}",
        "has_rare_char": f"regexp_matches({c}, '[\\x{{10000}}-\\x{{10FFFF}}]'){as_}",
    }


_dirty_doc = ", ".join(f"{e} AS {k}" for k, e in _dirty("t").items())
_dirty_book = ", ".join(f"count(*) FILTER ({e}) AS {k}" for k, e in _dirty("original", "").items())


STRIP = (
    "SELECT case_no, (row_number() OVER (PARTITION BY case_no ORDER BY c NULLS LAST, slot, p, s) - 1)::INT AS place, label, array_to_string(coalesce(said, []::VARCHAR[]), '|') AS said FROM ("
    "SELECT coalesce(a.case_no, b.case_no) AS case_no, coalesce(a.label, b.label) AS label, c, slot, p, s, said FROM (SELECT case_no, unnest(concerns) AS label, unnest(range(1, len(concerns) + 1)) AS c FROM con) a FULL JOIN ("
    "SELECT case_no, label, (list(said ORDER BY slot, p, s))[1:3] AS said, min((slot, p, s)) AS m, min(slot * 1000000 + p * 1000 + s) AS at, arg_min(slot, slot * 1000000 + p * 1000 + s) AS slot, arg_min(p, slot * 1000000 + p * 1000 + s) AS p, arg_min(s, slot * 1000000 + p * 1000 + s) AS s FROM ("
    "SELECT case_no, label, said, min(slot) AS slot, arg_min(p, slot * 1000000 + p * 1000 + s) AS p, arg_min(s, slot * 1000000 + p * 1000 + s) AS s FROM (SELECT * FROM (SELECT w.*, t.slot, row_number() OVER (PARTITION BY w.case_no, w.doc_no ORDER BY w.p, w.s) AS r FROM why1 w JOIN tier t USING (case_no, doc_no) WHERE w.said <> w.label) WHERE r <= 4) GROUP BY ALL) GROUP BY ALL) b ON a.case_no = b.case_no AND a.label = b.label)"
)


def oracle_sql() -> dict[str, str]:
    top = "ORDER BY score DESC, n_terms DESC, doc_no"
    return {
        "normalize_queries": _with(CASES, NORM, last="SELECT case_no, norm FROM norm"),
        "stop_mask": _with(CASES, NORM, last="SELECT case_no, masked FROM norm"),
        "token_estimate": _with(DOC, last=f"SELECT doc_no, {_tokens10.format('original')} AS original_tokens, {_tokens10.format('t')} AS translation_tokens FROM (SELECT doc_no, original, {_cut4000.format('translation')} AS t FROM doc)"),
        "dirty_text": _with(DOC, last=f"SELECT * FROM (SELECT doc_no, {_dirty_doc} FROM (SELECT doc_no, original || chr(10) || translation AS t FROM doc)) WHERE has_nav + has_html + has_bad_char + has_rare_char > 0"),
        "index_stats": _with(DOC, GRAMS, last="SELECT count(*) AS terms, sum(df)::BIGINT AS postings, max(df) AS max_df, any_value(n)::BIGINT AS docs, (sum(length(term) * 2 + 24 + df * 4 + 32) + any_value(n) * 80)::BIGINT AS bytes FROM df, nd"),
        "gram_df_top": _with(DOC, GRAMS, last="SELECT term, df FROM df ORDER BY df DESC, term LIMIT 100"),
        "tokenize_viterbi": _with(DOC, CASES, NORM, GRAMS, TOKENS, last="SELECT case_no, array_to_string(tokens, '|') AS tokens FROM tok"),
        "trigger_stats": _with(DOC, GRAMS, LABELS, last="SELECT label, trigger, core, is_short_allowed, trigger_df, core_df FROM trg"),
        "trigger_totals": _with(DOC, GRAMS, LABELS, last="SELECT count(*) AS triggers, count(*) FILTER (trigger_df > 0) AS in_index FROM trg WHERE trigger_ord > 0"),
        "bridge_matches": _bridge("SELECT case_no, label, trigger FROM mat"),
        "bridge_expanded": _bridge("SELECT case_no, label, array_to_string(said, '|') AS said FROM expd"),
        "bridge_concerns": _bridge("SELECT case_no, array_to_string(concerns, '|') AS concerns FROM con"),
        "explain_search": _search("SELECT case_no, norm, array_to_string(tokens, '|') AS tokens, coalesce(array_to_string(concerns, '|'), '') AS concerns FROM norm JOIN tok USING (case_no) LEFT JOIN con USING (case_no)"),
        "search_scored_top3": _search(f"SELECT case_no, rank, doc_no, round(score, 6) AS score, n_terms, array_to_string(terms, '|') AS terms FROM (SELECT *, row_number() OVER (PARTITION BY case_no {top})::INT AS rank FROM hit) WHERE rank <= 3"),
        "search_situated": _search("SELECT case_no, rank, doc_no, round(score, 6) AS score, coverage FROM sit WHERE rank <= 3"),
        "search_tiers": _search("SELECT case_no, slot, verdict, doc_no, round(score, 6) AS score, coverage, graded FROM tier"),
        "search_why": _search("SELECT case_no, doc_no, why FROM why"),
        "result_slots": _search("SELECT case_no, v.verdict, doc_no FROM (SELECT DISTINCT case_no FROM tier WHERE graded) CROSS JOIN (VALUES ('上'), ('中'), ('下')) v(verdict) LEFT JOIN (SELECT case_no, verdict, doc_no FROM tier WHERE graded) t USING (case_no, verdict)"),
        "recall_cases": _search("SELECT case_no, confidence, coalesce(len(list_filter(want, lambda w: len(list_filter(t, lambda x: contains(x, w))) > 0)) > 0, false) AS passed, coalesce(len(t), 0)::INT AS hits FROM ask LEFT JOIN (SELECT case_no, list(title) AS t FROM tier JOIN doc USING (doc_no) GROUP BY case_no) USING (case_no)"),
        "rank_drift": _search(f"SELECT case_no, len(list_intersect(a, b))::INT AS overlap, first, s.rank AS first_now FROM (SELECT case_no, list(doc_no) AS a, min_by(doc_no, r) AS first FROM (SELECT *, row_number() OVER (PARTITION BY case_no {top}) AS r FROM hit) WHERE r <= 3 GROUP BY case_no) JOIN (SELECT case_no, list(doc_no) AS b FROM sit WHERE rank <= 3 GROUP BY case_no) USING (case_no) LEFT JOIN (SELECT case_no, doc_no AS first, rank FROM sit WHERE rank <= 200) s USING (case_no, first)"),
        "titles_bridge": _bridge("SELECT case_no, label, trigger FROM mat", TITLES),
        "titles_concerns": _bridge("SELECT case_no, array_to_string(concerns, '|') AS concerns FROM con", TITLES),
        "titles_tiers": _search("SELECT case_no, slot, verdict, doc_no, round(score, 6) AS score, coverage, graded FROM tier", TITLES),
        "titles_why": _search("SELECT case_no, doc_no, why FROM why", TITLES),
        "texts_bridge": _bridge("SELECT case_no, label, trigger FROM mat", TEXTS),
        "texts_expanded": _bridge("SELECT case_no, label, array_to_string(said, '|') AS said FROM expd", TEXTS),
        "texts_concerns": _bridge("SELECT case_no, array_to_string(concerns, '|') AS concerns FROM con", TEXTS),
        "texts_tiers": _search("SELECT case_no, slot, verdict, doc_no, round(score, 6) AS score, coverage, graded FROM tier", TEXTS),
        "texts_why": _search("SELECT case_no, doc_no, why FROM why", TEXTS),
        "texts_strip": _search(STRIP, TEXTS),
        "phrases_bridge": _bridge("SELECT case_no, label, trigger FROM mat", PHRASES),
        "phrases_expanded": _bridge("SELECT case_no, label, array_to_string(said, '|') AS said FROM expd", PHRASES),
        "phrases_concerns": _bridge("SELECT case_no, array_to_string(concerns, '|') AS concerns FROM con", PHRASES),
        "phrases_tiers": _search("SELECT case_no, slot, verdict, doc_no, round(score, 6) AS score, coverage, graded FROM tier", PHRASES),
        "phrases_why": _search("SELECT case_no, doc_no, why FROM why", PHRASES),
        "phrases_strip": _search(STRIP, PHRASES),
        "theme_highlights": _search("SELECT case_no, doc_no, array_to_string(list_filter(themes, lambda x, i: list_position(themes, x) = i AND length(x) >= 2 AND contains(query, x)), '|') AS highlighted FROM tier JOIN doc USING (doc_no) JOIN ask USING (case_no)"),
        "recall_by_confidence": _search("SELECT confidence, count(*) AS cases, count(*) FILTER (coalesce(len(list_filter(want, lambda w: len(list_filter(t, lambda x: contains(x, w))) > 0)) > 0, false)) AS passed FROM ask LEFT JOIN (SELECT case_no, list(title) AS t FROM tier JOIN doc USING (doc_no) GROUP BY case_no) USING (case_no) GROUP BY confidence"),
        "library_totals": "SELECT count(*) AS books, sum(bytes)::BIGINT AS installed_bytes, count(*) FILTER (lower(slug) IN ('jiuji', 'yanlu', 'zhezhi')) AS selected, coalesce(sum(bytes) FILTER (lower(slug) IN ('jiuji', 'yanlu', 'zhezhi')), 0)::BIGINT AS selected_bytes FROM shard_catalog WHERE slug <> '' AND book <> ''",
        "library_snapshot": "SELECT (SELECT count(DISTINCT doc_no) FROM corpus_doc) AS docs, count(*) FILTER (lower(slug) IN ('jiuji', 'yanlu', 'zhezhi')) AS books, count(*) > 0 AS library_installed, '1' AS version FROM shard_catalog WHERE slug <> '' AND book <> ''",
        "body_lengths": _with(DOC, last="SELECT count(*) AS docs, round(avg(n), 6) AS mean_len, l[count(*) // 2 + 1] AS p50_len, l[count(*) * 9 // 10 + 1] AS p90_len, max(n) AS max_len FROM (SELECT length(title || original || translation)::INT AS n FROM doc), (SELECT list(length(title || original || translation)::INT ORDER BY length(title || original || translation)) AS l FROM doc) GROUP BY l"),
        "repeated_keys": "SELECT book, chapter, item_index, count(DISTINCT doc_no) AS docs FROM corpus_doc WHERE book <> '' AND doc_no IS NOT NULL GROUP BY ALL HAVING count(DISTINCT doc_no) > 1",
        "allow_list": _with(DOC, GRAMS, LABELS, DIRECTED, last="SELECT label, array_to_string(list(DISTINCT term ORDER BY term), '|') AS short_triggers FROM dirp WHERE length(term) < 3 AND df BETWEEN 2 AND 15 AND p >= 0.6 GROUP BY label"),
        "sample_titles": _with(DOC, GRAMS, LABELS, THEMED, last="SELECT label, term, positive, array_to_string(list(title ORDER BY doc_no), '|') AS titles FROM (SELECT *, row_number() OVER (PARTITION BY label, term, positive ORDER BY doc_no) AS k FROM (SELECT l.label, l.trigger AS term, doc_no, title, t.label IS NOT NULL AS positive FROM (SELECT DISTINCT label, trigger FROM lab) l JOIN gram g ON g.term = l.trigger JOIN doc USING (doc_no) LEFT JOIN thm t USING (doc_no, label))) WHERE k <= 3 GROUP BY ALL"),
        "filtered_items": _with(DOC, last="SELECT doc_no, length(translation) >= 20 AS translated FROM doc WHERE length(original) >= 16"),
        "head_of_books": _with(DOC, last="SELECT doc_no, book FROM (SELECT *, row_number() OVER (PARTITION BY book ORDER BY doc_no) AS k FROM doc WHERE book IN ('芦原书', '雁录', '柘志')) WHERE k <= 10"),
        "manifest_diff": _with(DOC, last="SELECT 'books' AS section, CASE WHEN book = '' THEN '史料' ELSE book END AS name, CASE WHEN book = '旧记' THEN 'new' ELSE 'changed' END AS state FROM doc WHERE book = '旧记' OR (doc_no % 7 = 0 AND book IN ('雁录', '柘志')) GROUP BY ALL"),
        "book_counts": _with(DOC, last="SELECT book, count(*) AS docs FROM doc GROUP BY book"),
        "annotation_coverage": _with(DOC, last="SELECT count(*) AS docs, count(*) FILTER (len(cast_list) > 0 OR len(themes) > 0 OR cause <> '' OR process <> '' OR significance <> '') AS annotated, count(*) FILTER (len(cast_list) > 0) AS with_cast, count(*) FILTER (len(themes) > 0) AS with_themes FROM doc"),
        "verdict_counts": _with(DOC, last="SELECT count(*) FILTER (verdict <> '') AS total, count(*) FILTER (verdict = '上') AS upper, count(*) FILTER (verdict = '中') AS middle, count(*) FILTER (verdict = '下') AS lower FROM doc"),
        "shard_report": _with(DOC, last=f"SELECT book, items, chars, no_translation, l[1] AS min_len, l[items // 2 + 1] AS p50_len, l[items * 9 // 10 + 1] AS p90_len, l[items] AS max_len, has_nav, has_html, has_bad_char, has_rare_char FROM (SELECT book, count(*) AS items, sum(length(original))::BIGINT AS chars, count(*) FILTER (translation = '') AS no_translation, list(length(original)::INT ORDER BY length(original)) AS l, {_dirty_book} FROM doc GROUP BY book)"),
        "duplicate_docs": _with(DOC, last="SELECT count(*) AS docs, count(DISTINCT (title, original)) AS distinct_docs, count(*) - count(DISTINCT (title, original)) AS duplicates FROM doc"),
        "catalog_totals": _with(DOC, last="SELECT slug, c.book, docs::BIGINT AS docs_declared, coalesce(n, 0) AS docs_now, chars AS chars_declared, coalesce(m, 0)::BIGINT AS chars_now FROM shard_catalog c LEFT JOIN (SELECT book, count(*) AS n, sum(length(original) + length(translation)) AS m FROM doc GROUP BY book) d ON d.book = c.book WHERE slug <> '' AND c.book <> ''"),
        "completeness": _with(DOC, last="SELECT doc_no, violation FROM (SELECT doc_no, unnest([CASE WHEN length(original) < 16 THEN 'short_original' END, CASE WHEN length(translation) < 20 THEN 'short_translation' END, CASE WHEN len(list_distinct(themes)) < 2 THEN 'few_themes' END, CASE WHEN NOT len(pros) BETWEEN 2 AND 3 OR len(list_filter(pros, lambda x: length(x) < 10)) > 0 THEN 'pros' END, CASE WHEN NOT len(cons) BETWEEN 2 AND 3 OR len(list_filter(cons, lambda x: length(x) < 10)) > 0 THEN 'cons' END, CASE WHEN book = '' THEN 'no_book' END]) AS violation FROM doc) WHERE violation IS NOT NULL"),
        "cost_estimate": _with(DOC, last=f"SELECT count(*) AS items, sum({_tokens10.format('t')})::BIGINT AS fresh_tokens, greatest(count(*) - 1, 0) * 900 AS cached_tokens, count(*) * 300 AS output_tokens FROM (SELECT {_cut4000.format('x')} AS t FROM (SELECT title || original || translation AS x FROM doc))"),
        "directedness": _with(DOC, GRAMS, LABELS, DIRECTED, last="SELECT label, term, df, df_label, p FROM dirp"),
        "trigger_allow": _with(DOC, GRAMS, LABELS, DIRECTED, last="SELECT label, term, df, df_label, p, df BETWEEN 2 AND 15 AND p >= 0.6 AS allowed, df = 1 OR (df > 0 AND df < 3) OR (df > 15 AND df <= 20) OR (df > 0 AND round(abs(p - 0.6), 9) <= 0.1) AS edge FROM dirp WHERE length(term) < 3"),
        "core_audit": _with(DOC, GRAMS, LABELS, last="SELECT label, trigger, core, core_df, CASE WHEN length(core) < 2 THEN 'literal: core too short' WHEN core_df > 15 THEN 'literal: core too general' WHEN core = label THEN 'skipped: core is the label' ELSE 'literal core of two' END AS verdict FROM trg WHERE trigger_ord > 0 AND length(trigger) >= 3 AND (length(core) < 3 OR core_df > 15)"),
        "label_effectiveness": _with(DOC, GRAMS, LABELS, DIRECTED, last="SELECT label, df, df_label, p, df = 0 AS dead, df > 0 AND p < 0.75 AS poor FROM dirp WHERE label = term"),
        "check_phrase": _with(DOC, THEMED, MINE_TEXT, last="SELECT phrase, docs, label, n, round(n * 100 / docs, 6) AS percent FROM (SELECT phrase, t.label, count(*) AS n FROM fnd JOIN thm t USING (doc_no) GROUP BY ALL) JOIN (SELECT phrase, count(*) AS docs FROM fnd GROUP BY phrase) USING (phrase)".replace("fnd", "(SELECT l.label AS phrase, doc_no FROM body JOIN (SELECT DISTINCT label FROM label_table WHERE label <> '') l ON contains(body, l.label))")),
        "keep_last_dedup": _with(DOC, last="SELECT doc_no FROM doc WHERE original = '' UNION ALL SELECT max(doc_no) FROM doc WHERE original <> '' GROUP BY translate(original, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"),
        "containment_dedup": _with(DOC, last="SELECT doc_no FROM doc d WHERE book <> '芦原书' AND NOT EXISTS (SELECT 1 FROM doc c WHERE c.book = '芦原书' AND least(length(c.original), length(d.original)) >= 12 AND (contains(substr(c.original, 1, 120), substr(d.original, 1, 120)) OR contains(substr(d.original, 1, 120), substr(c.original, 1, 120))))"),
        "merge_by_book": _with(DOC, last="SELECT book, count(*) AS docs, count(*) FILTER (r) AS replaced FROM (SELECT book, false AS r FROM doc WHERE book NOT IN ('旧记', '雁录') UNION ALL SELECT book, true FROM doc WHERE book IN ('旧记', '雁录')) GROUP BY book"),
        "backfill_overwrite": _fill("ann", "raw"),
        "backfill_additive": _fill("raw", "ann"),
        "annotate_todo": "SELECT doc_no FROM (SELECT DISTINCT doc_no, book, chapter, item_index FROM corpus_doc) d WHERE NOT EXISTS (SELECT 1 FROM annotation a WHERE verdict IS NOT NULL AND a.book = d.book AND a.chapter = d.chapter AND a.item_index = d.item_index)",
        "closed_themes": _with(DOC, last="SELECT doc_no, array_to_string(list_filter(t, lambda x, i: list_position(t, x) = i), '|') AS themes FROM (SELECT doc_no, list_filter(themes, lambda x: list_contains(names, x)) AS t FROM doc, (SELECT list(DISTINCT label) AS names FROM label_table WHERE label <> ''))"),
        "selection_sanitize": "SELECT (row_number() OVER (ORDER BY first) - 1)::INT AS place, slug FROM (SELECT c.slug, min(place) AS first FROM (VALUES (0, 'JIUJI'), (1, 'nosuch'), (2, 'yanlu'), (3, 'jiuji'), (4, 'Zhezhi')) a(place, s) JOIN shard_catalog c ON lower(c.slug) = lower(s) GROUP BY c.slug)",
        "selection_docs": _with(DOC, last="SELECT doc_no, book FROM doc WHERE book IN (SELECT book FROM shard_catalog WHERE lower(slug) IN ('jiuji', 'yanlu', 'zhezhi'))"),
        "pair_plausible": _with(DOC, last="SELECT doc_no, (length(original) > 0 AND length(translation) > 0 AND length(translation) <= length(original) * 5 + 400 AND length(translation) >= length(original) * 0.15 - 400)::INT AS plausible FROM doc"),
        "volume_numbers": _with(DOC, last="SELECT doc_no, coalesce(list_position(['一', '二', '三', '四', '五', '六', '七', '八', '九', '十', '十一', '十二', '十三', '十四', '十五', '十六', '十七', '十八', '十九', '二十'], nullif(regexp_extract(chapter, '^[^卷]*卷([零一二三四五六七八九十百千]+)', 1), '')), CASE WHEN chapter LIKE '%卷%' THEN try_cast(regexp_extract(chapter, '^[^卷]*卷([0-9]+)', 1) AS INT) END, -1)::INT AS volume FROM doc"),
        "pairing_modes": _with(DOC, last="SELECT book, count(*) AS docs, count(*) FILTER (translation <> '') AS translated, CASE WHEN count(*) FILTER (translation <> '') = 0 THEN '仅原文' WHEN count(*) FILTER (translation <> '') = count(*) THEN '段译配对' ELSE '部分对齐' END AS pairing FROM doc GROUP BY book"),
        "stratified_sample": _with(DOC, last="SELECT doc_no, book, stratum FROM (SELECT *, count(*) OVER (PARTITION BY book, stratum) AS n, row_number() OVER (PARTITION BY book, stratum ORDER BY doc_no) - 1 AS rn FROM (SELECT doc_no, book, CASE WHEN title <> '' THEN title ELSE string_split(chapter, ' · ')[1] END AS stratum FROM doc)) WHERE n <= 2 OR rn = n // 4 OR rn = 3 * n // 4"),
    }
