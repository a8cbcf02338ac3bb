"""DuckDB SQL of the text functions, for the queries' oracles."""

from __future__ import annotations

from ..functions import stopwords
from ..functions.text import ABBREVIATIONS, INVARIABLE, WORD


def in_list(words) -> str:
    return "(" + ", ".join(f"'{w}'" for w in sorted(words)) + ")"


STOP = in_list(stopwords.BASE)


def term_key(x: str) -> str:
    return f"regexp_replace(replace(strip_accents(replace(lower({x}), 'ñ', chr(1))), chr(1), 'ñ'), '[^a-z0-9ñ]', '', 'g')"


def trimmed(x: str) -> str:
    return rf"regexp_replace({x}, '^\s+|\s+$', '', 'g')"


def sentences(x: str) -> str:
    for _ in range(2):
        x = rf"regexp_replace({x}, '(?i)(^|[^A-Za-z0-9_])({ABBREVIATIONS})\.\s+', '\1\2.' || chr(3) || ' ', 'g')"
    x = rf"regexp_replace({x}, '([.!?…]+|\n{{2,}})(\s+|\z)', '\1' || chr(2), 'g')"
    return f"list_filter(list_transform(string_split({x}, chr(2)), lambda p: {trimmed('replace(p, chr(3), ' + chr(39) * 2 + ')')}), lambda p: p <> '')"


def language(x: str) -> str:
    words = f"regexp_extract_all(strip_accents(lower(substr({x}, 1, 20000))), '[a-zñ]{{2,}}')"
    es = f"len(list_filter({words}, lambda w: w IN {in_list(stopwords.SPANISH)}))"
    en = f"len(list_filter({words}, lambda w: w IN {in_list(stopwords.ENGLISH)}))"
    return f"CASE WHEN len({words}) < 20 OR ({es} = 0 AND {en} = 0) THEN 'indeterminado' WHEN {es} >= {en} * 1.3 THEN 'es' WHEN {en} >= {es} * 1.3 THEN 'en' ELSE 'mixto' END"


def lemma_es(p: str) -> str:
    cut = lambda n: f"left({p}, length({p}) - {n})"
    return f"""CASE WHEN regexp_matches({p}, '{INVARIABLE}') THEN {p}
        WHEN length({p}) > 7 AND ends_with({p}, 'mente') THEN {cut(5)}
        WHEN length({p}) > 7 AND ends_with({p}, 'ciones') THEN {cut(6)} || 'cion'
        WHEN length({p}) > 7 AND ends_with({p}, 'idades') THEN {cut(6)} || 'idad'
        WHEN length({p}) > 4 AND ends_with({p}, 'ces') THEN {cut(3)} || 'z'
        WHEN length({p}) > 4 AND ends_with({p}, 'es') THEN CASE WHEN regexp_matches({cut(2)}, '[lrndzjxy]$') THEN {cut(2)} ELSE {cut(1)} END
        WHEN length({p}) > 4 AND regexp_matches({p}, '[aeiou]s$') THEN {cut(1)} ELSE {p} END"""


def lemma_en(p: str) -> str:
    cut = lambda n: f"left({p}, length({p}) - {n})"
    doubled = f"length({p}) - 3 > 3 AND substr({p}, length({p}) - 3, 1) = substr({p}, length({p}) - 4, 1)"
    return f"""CASE WHEN regexp_matches({p}, '{INVARIABLE}') THEN {p}
        WHEN length({p}) > 4 AND ends_with({p}, 'ies') THEN {cut(3)} || 'y'
        WHEN length({p}) > 4 AND regexp_matches({p}, '(sses|shes|ches|xes|zes)$') THEN {cut(2)}
        WHEN length({p}) > 5 AND ends_with({p}, 'ing') THEN CASE WHEN {doubled} THEN {cut(4)} ELSE {cut(3)} END
        WHEN length({p}) > 4 AND ends_with({p}, 'ed') AND NOT ends_with({p}, 'eed') THEN {cut(2)}
        WHEN length({p}) > 3 AND ends_with({p}, 's') AND NOT ends_with({p}, 'ss') THEN {cut(1)} ELSE {p} END"""


def lemma_mixed(p: str) -> str:
    return f"CASE WHEN regexp_matches({p}, '{INVARIABLE}') THEN {p} WHEN length({p}) > 4 AND regexp_matches({p}, '[aeiou]s$') THEN left({p}, length({p}) - 1) ELSE {p} END"


def lemma(p: str, lang: str) -> str:
    return f"CASE WHEN {lang} = 'es' THEN {lemma_es(p)} WHEN {lang} = 'en' THEN {lemma_en(p)} ELSE {lemma_mixed(p)} END"


PATH = "source || '/' || lang || '/doc-' || doc_id || '.txt'"

#: CTEs from documents to tok(path, lang, sentence, k, form, key, lemma, pos): the token stream.
TOKENS = rf"""
    d AS (SELECT {PATH} AS path, text, {language('text')} AS detected FROM documents),
    s AS (SELECT path, detected, unnest(ss) AS s, generate_subscripts(ss, 1) - 1 AS sentence FROM (SELECT path, detected, {sentences('text')} AS ss FROM d)),
    w AS (SELECT path, detected, sentence, unnest(ws) AS form, generate_subscripts(ws, 1) AS k FROM (SELECT *, regexp_extract_all(s, '{WORD.replace("'", "''")}') AS ws FROM s)),
    y AS (SELECT *, {term_key('form')} AS key FROM w),
    l AS (SELECT *, {lemma('key', 'detected')} AS lemma FROM y WHERE length(key) >= 3 AND NOT regexp_matches(key, '^\d+$') AND key NOT IN {STOP}),
    tok AS (SELECT path, detected, sentence, form, lemma, row_number() OVER (PARTITION BY path ORDER BY sentence, k) - 1 AS pos FROM l WHERE length(lemma) >= 3 AND lemma NOT IN {STOP})"""

#: CTEs to edge(a, b, tenths, docs) and node(lemma, form, frequency, docs).
PAIRS = """
    pair AS (SELECT x.path, least(x.lemma, y.lemma) AS a, greatest(x.lemma, y.lemma) AS b, x.sentence, CASE WHEN x.sentence = y.sentence THEN 10 ELSE 4 END AS tenths
             FROM (SELECT path, pos, lemma, sentence, unnest([1, 2, 3]) AS d FROM tok) x JOIN tok y ON y.path = x.path AND y.pos = x.pos + x.d WHERE x.lemma <> y.lemma),
    edge AS (SELECT a, b, sum(tenths)::BIGINT AS tenths, count(DISTINCT path) AS docs FROM pair GROUP BY a, b)"""
NODES = """
    form AS (SELECT lemma, form, count(*) AS k, min((path, pos)) AS seen FROM tok GROUP BY lemma, form),
    best AS (SELECT lemma, form FROM (SELECT *, row_number() OVER (PARTITION BY lemma ORDER BY k DESC, seen) AS r FROM form) WHERE r = 1),
    node AS (SELECT t.lemma, any_value(b.form) AS form, count(*) AS frequency, count(DISTINCT path) AS docs FROM tok t JOIN best b ON t.lemma = b.lemma GROUP BY t.lemma)"""
CUT = """
    kept AS (SELECT *, row_number() OVER (ORDER BY frequency DESC, docs DESC, lemma) - 1 AS id FROM node WHERE frequency >= 2 AND docs >= 1 ORDER BY frequency DESC, docs DESC, lemma LIMIT 3000),
    cut AS (SELECT e.a, e.b, x.id AS a_id, y.id AS b_id, tenths, tenths / 10 AS weight, e.docs FROM edge e JOIN kept x ON x.lemma = e.a JOIN kept y ON y.lemma = e.b WHERE tenths >= 10)"""
