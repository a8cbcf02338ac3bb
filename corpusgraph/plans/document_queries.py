"""Queries over inventories, parsers and the document layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concepts as co
from ..operators import documents as do
from ..sources import inventory as inv
from ..sources import parsers as pr
from ..storage import materialize, spread
from .sql_text import CUT, NODES, PAIRS, PATH, TOKENS
from .tables import Registry, corpus, read

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_URL = "replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://', ''), 'https', 'https')"


def _urls(spark, sf):
    """pages as files: path, size."""
    path = F.regexp_replace(F.regexp_replace("url", r"[?#].*$", ""), "^[a-z]+://", "")
    return read(spark, sf, "pages").withColumn("path", path).withColumn("size", F.octet_length("html").cast("long"))


_P = f"p AS (SELECT *, {_URL} AS path, octet_length(encode(html))::BIGINT AS size FROM pages)"
_EXT = r"lower(regexp_extract(path, '\.([A-Za-z0-9]{1,10})$', 1))"


@R.add(f"WITH {_P} SELECT {_EXT} AS ext, count(*) AS n, sum(size)::BIGINT AS bytes FROM p GROUP BY 1")
def inventory_by_ext(spark, sf):
    return inv.summary(_urls(spark, sf))


_FOLDERS = ", ".join(f"'{x}'" for x in inv.IGNORED_FOLDERS)
_FILES = ", ".join(f"'{x}'" for x in inv.IGNORED_FILES)


@R.add(rf"""WITH {_P}, q AS (SELECT page_id, string_split(lower(v), '/') AS parts, v FROM (SELECT page_id, CASE page_id % 5 WHEN 0 THEN '.git/' || path WHEN 1 THEN path || '/.DS_Store' WHEN 2 THEN path || '/.note.md' WHEN 3 THEN path || '/.x' ELSE path END AS v FROM p))
    SELECT page_id, len(list_filter(parts[:-2], lambda x: x IN ({_FOLDERS}) OR starts_with(x, '.'))) > 0 OR parts[-1] IN ({_FILES}) OR (starts_with(parts[-1], '.') AND NOT regexp_matches(parts[-1], '\.(md|txt|json)$')) AS ignored,
    CASE WHEN contains(v, '/') THEN regexp_replace(v, '^[^/]*/', '') ELSE v END AS inner_path FROM q""")
def ignore_filter(spark, sf):
    k, p = F.col("page_id") % 5, F.col("path")
    v = F.when(k == 0, F.concat(F.lit(".git/"), p)).when(k == 1, F.concat(p, F.lit("/.DS_Store"))).when(k == 2, F.concat(p, F.lit("/.note.md"))).when(k == 3, F.concat(p, F.lit("/.x"))).otherwise(p)
    return _urls(spark, sf).select("page_id", inv.is_ignored(v).alias("ignored"), inv.without_root(v).alias("inner_path"))


_PARSER = "CASE " + " ".join(f"WHEN {_EXT} IN ({', '.join(repr(x) for x in e.split())}) THEN '{n}'" for n, e in inv.PARSERS.items()) + " ELSE 'binary' END"
_FAMILY = "CASE " + " ".join(f"WHEN {_EXT} IN ({', '.join(repr(x) for x in e.split())}) THEN '{n}'" for n, e in inv.FAMILIES.items()) + " ELSE 'other' END"


@R.add(f"WITH {_P} SELECT page_id, {_PARSER} AS parser, CASE WHEN size > {inv.MAX_BYTES} THEN 'error' WHEN {_PARSER} = 'binary' THEN 'metadata only' ELSE 'ok' END AS state, {_FAMILY} AS family, regexp_matches(path, '(?i)\\.zip$') AS zip FROM p")
def router_status(spark, sf):
    u = _urls(spark, sf)
    ext = inv.extension(F.col("path"))
    parser, state = inv.route(ext, F.col("size"))
    return u.select("page_id", parser.alias("parser"), state.alias("state"), inv.family(ext).alias("family"), inv.is_zip(F.col("path")).alias("zip"))


@R.add(r"WITH n AS (SELECT page_id, CASE WHEN page_id % 2 = 0 THEN '.file' || page_id || '.pdf.iCloud' ELSE 'file' || page_id || '.pdf' END AS name FROM pages) SELECT page_id, nullif(regexp_extract(name, '(?i)^\.(.+)\.icloud$', 1), '') AS real_name FROM n")
def cloud_placeholders(spark, sf):
    name = F.when(F.col("page_id") % 2 == 0, F.concat(F.lit(".file"), "page_id", F.lit(".pdf.iCloud"))).otherwise(F.concat(F.lit("file"), "page_id", F.lit(".pdf")))
    return read(spark, sf, "pages").select("page_id", inv.placeholder_name(name).alias("real_name"))


def _sql_entities(x: str) -> str:
    for name, value in pr.ENTITIES.items():
        if name != "amp":
            v = value.replace("'", "''")
            x = f"replace({x}, '&{name};', '{v}')"
    return f"replace({x}, '&amp;', '&')"


def _sql_body(x: str) -> str:
    x = rf"regexp_replace({x}, '<!--(.|\n)*?-->', ' ', 'g')"
    for tag in pr.HIDDEN:
        x = rf"regexp_replace({x}, '(?is)<{tag}\b[^>]*>.*?</{tag}>', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?is)<head\b[^>]*>.*?</head>', ' ', 'g')"
    x = rf"regexp_replace({x}, '(?i)</?(?:{pr.BLOCKS})\b[^>]*>', chr(10), 'g')"
    x = _sql_entities(rf"regexp_replace({x}, '<[^>]+>', ' ', 'g')")
    x = rf"regexp_replace({x}, '[ \t' || chr(160) || ']+', ' ', 'g')"
    x = rf"regexp_replace({x}, '\n\s*\n\s*\n+', chr(10) || chr(10), 'g')"
    return rf"regexp_replace(regexp_replace({x}, '(?m)^[ \t]+|[ \t]+$', '', 'g'), '^\s+|\s+$', '', 'g')"


_TITLE = f"trim({_sql_entities(chr(114) + 'egexp_extract(html, ' + chr(39) + '(?is)<title[^>]*>(.*?)</title>' + chr(39) + ', 1)')})"


@R.add(f"SELECT page_id, {_TITLE} AS title, CASE WHEN {_TITLE} <> '' THEN {_TITLE} || chr(10) || chr(10) ELSE '' END || {_sql_body('html')} AS visible FROM pages")
def html_visible_text(spark, sf):
    return read(spark, sf, "pages").select("page_id", pr.html_title(F.col("html")).alias("title"), pr.html_text(F.col("html")).alias("visible"))


_LINKS = f"""link AS (SELECT page_id, url, {_sql_entities('d')} AS target FROM (SELECT page_id, url, trim(unnest(regexp_extract_all(html, '(?i)<a\\b[^>]*href\\s*=\\s*["'']([^"'']+)["''][^>]*>', 1))) AS d FROM pages) WHERE NOT regexp_matches(d, '(?i)^(https?|mailto|tel|javascript|#)'))"""


@R.add(f"WITH {_LINKS} SELECT page_id, target, count(*) AS n FROM link GROUP BY ALL")
def html_local_links(spark, sf):
    return read(spark, sf, "pages").select("page_id", F.explode_outer(pr.html_links(F.col("html"))).alias("target")).where("target IS NOT NULL").groupBy("page_id", "target").agg(F.count("*").alias("n"))


_NOTE = "'# N' || doc_id || chr(10) || '> see [[doc-' || (doc_id + 1) || '|next]] and [x](../en/doc-' || (doc_id + 2) || '.txt) or [web](https://a.b/c)' || chr(10) || '* **item** `code` ' || text || chr(10) || '| a | b |' || chr(10) || '|---|---|'"


def _notes(spark, sf):
    """documents rewritten as Markdown notes that link to others, around their whole texts."""
    d = spread(corpus(spark, sf).select("doc_id", "text"))
    lit, n = F.lit, lambda k: (F.col("doc_id") + k).cast("string")
    note = F.concat(lit("# N"), n(0), lit("\n> see [[doc-"), n(1), lit("|next]] and [x](../en/doc-"), n(2), lit(".txt) or [web](https://a.b/c)\n* **item** `code` "), F.col("text"), lit("\n| a | b |\n|---|---|"))
    return d.withColumn("note", note)


@R.add(rf"""WITH n AS (SELECT doc_id, {_NOTE} AS note FROM documents)
    SELECT doc_id, array_to_string(list_transform(regexp_extract_all(note, '\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]', 1), lambda x: trim(x)), ' ') AS wiki,
    array_to_string(list_filter(regexp_extract_all(note, '\[[^\]]*\]\(([^)\s]+)(?:\s+"[^"]*")?\)', 1), lambda x: NOT regexp_matches(x, '(?i)^(https?|mailto|tel):')), ' ') AS plain FROM n""")
def note_links(spark, sf):
    return _notes(spark, sf).select("doc_id", F.array_join(pr.wiki_links(F.col("note")), " ").alias("wiki"), F.array_join(pr.markdown_links(F.col("note")), " ").alias("plain"))




_MD = "note"
for _p, _t in ((r"(?s)```.*?```", " "), (r"`[^`\n]*`", " "), (r"(?m)^\s{0,3}(#{1,6})\s+", ""), (r"!\[[^\]]*\]\([^)]*\)", " "), (r"\[([^\]]*)\]\([^)]*\)", r"\1"), (r"\[\[([^\]|#]+)(?:[#|][^\]]*)?\]\]", r"\1"), (r"(?m)^\s{0,3}>\s?", ""), (r"(\*\*|__|\*|_|~~)", ""), (r"(?m)^\s*[-*+]\s+", "")):
    _MD = f"regexp_replace({_MD}, '{_p}', '{_t}', 'g')"
_MD = rf"regexp_replace(array_to_string(list_transform(string_split({_MD}, chr(10)), lambda x: CASE WHEN regexp_matches(x, '^\s*\|.*\|\s*$') THEN replace(x, '|', ' ') ELSE x END), chr(10)), '(?m)^\s*[-:|\s]{{3,}}\s*$', ' ', 'g')"


@R.add(f"WITH n AS (SELECT doc_id, {_NOTE} AS note FROM documents) SELECT doc_id, {_MD} AS clean FROM n")
def markdown_text(spark, sf):
    return _notes(spark, sf).select("doc_id", pr.clean_markdown(F.col("note")).alias("clean"))




@R.add("SELECT event_id, unnest(json_keys(props)) AS key FROM events")
def json_keys(spark, sf):
    return read(spark, sf, "events").select("event_id", F.explode_outer(F.map_keys(pr.json_key_counts(F.col("props")))).alias("key")).where("key IS NOT NULL")


@R.add("WITH t AS (SELECT event_type, event_id || ';\"a \"\"b\"\"; c\";' || event_type || ';user_id' || chr(10) || '1;2;3' AS csv FROM events) SELECT event_type, count(*) AS n, max(event_type) AS third, 'a \"b\"; c' AS second FROM t GROUP BY event_type")
def csv_header_fields(spark, sf):
    e = read(spark, sf, "events").withColumn("csv", F.concat(F.col("event_id").cast("string"), F.lit(';"a ""b""; c";'), "event_type", F.lit(";user_id\n1;2;3")))
    h = e.select("event_type", pr.csv_headers(F.col("csv")).alias("h"))
    return h.groupBy("event_type").agg(F.count("*").alias("n"), F.max(F.col("h")[2]).alias("third"), F.max(F.col("h")[1]).alias("second"))


@R.add("SELECT page_id, 'sha256:' || sha256(html) AS hash FROM pages")
def content_hash(spark, sf):
    return read(spark, sf, "pages").select("page_id", inv.content_hash(F.col("html")).alias("hash"))


_OLD = "o AS (SELECT path, size + (page_id % 7 = 0)::INT AS size, page_id * 1000 + CASE WHEN page_id % 5 = 0 THEN 1501 WHEN page_id % 5 = 1 THEN 1499 ELSE 0 END AS modified_ms, CASE WHEN page_id % 4 = 0 THEN NULL WHEN page_id % 4 = 1 THEN 'sha256:0' ELSE 'sha256:' || sha256(html) END AS hash FROM one WHERE page_id % 3 <> 0)"
_ONE = "one AS (SELECT path, min(page_id) AS page_id, min_by(size, page_id) AS size, min_by(html, page_id) AS html FROM p GROUP BY path)"


def _states(spark, sf):
    """The pages as a listing, and an older index of them that differs by rule."""
    one = _urls(spark, sf).groupBy("path").agg(F.min("page_id").alias("page_id"), F.min_by("size", "page_id").alias("size"), F.min_by("html", "page_id").alias("html"))
    now = one.withColumn("modified_ms", F.col("page_id") * 1000).withColumn("hash", inv.content_hash(F.col("html")))
    k = F.col("page_id")
    late = F.when(k % 5 == 0, 1501).when(k % 5 == 1, 1499).otherwise(0)
    old = now.where(k % 3 != 0).select("path", (F.col("size") + (k % 7 == 0).cast("int")).alias("size"), (k * 1000 + late).alias("modified_ms"), F.when(k % 4 == 0, None).when(k % 4 == 1, "sha256:0").otherwise(F.col("hash")).alias("hash"))
    return now.where(k % 11 != 1), old


@R.add(f"WITH {_P}, {_ONE}, {_OLD}, n AS (SELECT path, size, page_id * 1000 AS modified_ms FROM one WHERE page_id % 11 <> 1), j AS (SELECT coalesce(n.path, o.path) AS path, CASE WHEN o.path IS NULL THEN 'new' WHEN n.path IS NULL THEN 'deleted' WHEN n.size <> o.size OR abs(n.modified_ms - o.modified_ms) > 1500 THEN 'candidate' ELSE 'same' END AS change, n.size <> o.size AS sized FROM n FULL JOIN o ON n.path = o.path) SELECT path, change, CASE WHEN change = 'candidate' THEN CASE WHEN sized THEN 'size' ELSE 'date' END END AS reason FROM j")
def inventory_diff(spark, sf):
    return inv.difference(*_states(spark, sf))


@R.add(f"WITH {_P}, {_ONE}, {_OLD} SELECT one.path, 'sha256:' || sha256(html) AS hash, o.hash AS old_hash FROM one JOIN o ON one.path = o.path WHERE one.page_id % 11 <> 1 AND (o.hash IS NULL OR o.hash <> 'sha256:' || sha256(html))")
def hash_change(spark, sf):
    return inv.changed(*_states(spark, sf))


@R.add(f"WITH {_P}, {_ONE}, {_OLD}, c AS (SELECT path, size, page_id * 1000 AS modified_ms, 'sha256:' || sha256(html) AS hash FROM one WHERE page_id % 11 <> 1) SELECT * FROM c UNION ALL SELECT * FROM o WHERE path NOT IN (SELECT path FROM c)")
def index_upsert(spark, sf):
    now, old = _states(spark, sf)
    return inv.upsert(old, now.select("path", "size", "modified_ms", "hash"))


@R.add("WITH s AS (SELECT event_type, date_trunc('hour', ts) AS date, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT date, sum(n)::BIGINT AS n FROM s GROUP BY date) SELECT date, n FROM t ORDER BY date DESC LIMIT 60")
def snapshot_prune(spark, sf):
    return inv.prune_snapshots(read(spark, sf, "events").groupBy(F.date_trunc("hour", "ts").alias("date")).agg(F.count("*").alias("n")))


_NAMED = "v(path) AS (SELECT 'd' || (doc_id // 3) || '/essay ' || CASE doc_id % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' ELSE 'final' END || '.md' FROM documents)"


@R.add(f"WITH {_NAMED} SELECT path AS b, replace(replace(path, 'v2', 'v1'), 'final', 'v2') AS a, regexp_extract(path, '^(.*/)', 1) || 'essay' AS version_key FROM v WHERE path NOT LIKE '%v1.md' AND replace(replace(path, 'v2', 'v1'), 'final', 'v2') IN (SELECT path FROM v)")
def version_chains(spark, sf):
    k = F.col("doc_id")
    mark = F.when(k % 3 == 0, "v1").when(k % 3 == 1, "v2").otherwise("final")
    paths = read(spark, sf, "documents").select(F.concat(F.lit("d"), F.floor(k / 3).cast("string"), F.lit("/essay "), mark, F.lit(".md")).alias("path"))
    return do.version_chains(paths)


@R.add("WITH k AS (SELECT DISTINCT doc_id::VARCHAR AS path, unnest(['doi:10.1234/a' || (doc_id // 5), 'doi:10.9999/b' || (doc_id // 7), 'cita:gomez:' || (2000 + doc_id % 17)]) AS key FROM documents), u AS (SELECT key FROM k GROUP BY key HAVING count(*) BETWEEN 2 AND 40), x AS (SELECT k.* FROM k JOIN u USING (key)) SELECT x.path AS a, y.path AS b, count(*) AS shared FROM x JOIN x y ON x.key = y.key AND x.path < y.path GROUP BY ALL HAVING count(*) >= 2")
def shared_references(spark, sf):
    k = F.col("doc_id")
    cited = F.concat(F.lit("see https://doi.org/10.1234/A"), F.floor(k / 5).cast("string"), F.lit("., 10.9999/B"), F.floor(k / 7).cast("string"), F.lit(" (Gómez, "), (2000 + k % 17).cast("string"), F.lit(") "))
    keys = read(spark, sf, "documents").select(k.cast("string").alias("path"), F.explode(do.bibliographic_keys(cited)).alias("key"))
    return do.shared_references(keys.withColumn("key", F.translate("key", "ó", "o")))


_RESOLVED = rf"""d AS (SELECT DISTINCT {PATH} AS path, lang, source, doc_id FROM documents),
    r AS (SELECT source || '/' || lang || '/doc-' || doc_id || '.txt' AS from_path, unnest(['doc-' || (doc_id + 1), '../en/doc-' || (doc_id + 2) || '.txt', 'doc-' || doc_id || '.txt#top']) AS target, source FROM documents),
    c AS (SELECT *, split_part(target, '#', 1) AS clean, regexp_replace(from_path, '[^/]*$', '') AS dir FROM r),
    f AS (SELECT *, CASE WHEN starts_with(clean, '../') THEN source || '/' || substr(clean, 4) WHEN ends_with(clean, '.txt') THEN dir || clean ELSE dir || clean || '.txt' END AS try FROM c)"""


@R.add(f"WITH {_RESOLVED} SELECT from_path, target, coalesce(d.path, n.path) AS resolved, CASE WHEN d.path IS NOT NULL THEN 'path' WHEN n.path IS NOT NULL THEN 'name' ELSE 'no target' END AS reason FROM f LEFT JOIN d ON d.path = try LEFT JOIN d n ON d.path IS NULL AND n.doc_id = try_cast(regexp_extract(f.try, 'doc-([0-9]+)', 1) AS BIGINT)")
def link_resolution(spark, sf):
    d, k = corpus(spark, sf), F.col("doc_id")
    named = [F.concat(F.lit("doc-"), (k + 1).cast("string")), F.concat(F.lit("../en/doc-"), (k + 2).cast("string"), F.lit(".txt")), F.concat(F.lit("doc-"), k.cast("string"), F.lit(".txt#top"))]
    links = d.select(F.col("path").alias("from_path"), F.explode(F.array(*named)).alias("target"))
    return do.resolve_links(links, d.select("path"))


@R.add(f"WITH {_RESOLVED}, l AS (SELECT from_path, coalesce(d.path, n.path) AS resolved FROM f LEFT JOIN d ON d.path = try LEFT JOIN d n ON d.path IS NULL AND n.doc_id = try_cast(regexp_extract(f.try, 'doc-([0-9]+)', 1) AS BIGINT)) SELECT least(from_path, resolved) AS a, greatest(from_path, resolved) AS b, 'link' AS kind, count(*) AS weight, count(*) AS times FROM l WHERE resolved IS NOT NULL AND resolved <> from_path GROUP BY ALL")
def dependency_fusion(spark, sf):
    found = link_resolution(spark, sf).where("resolved IS NOT NULL AND resolved <> from_path")
    return do.fused(found.select(F.col("from_path").alias("a"), F.col("resolved").alias("b"), F.lit("link").alias("kind"), F.lit(1).alias("weight")))


_TERMS = """f AS (SELECT path, lemma, form, count(*) AS k, min(pos) AS seen FROM tok GROUP BY ALL),
    t AS (SELECT path, lemma, sum(k)::BIGINT AS n FROM f GROUP BY path, lemma),
    term AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, lemma) AS rank FROM t) WHERE rank <= 400)"""
_IDF = "nd AS (SELECT count(*) AS nd FROM documents), df AS (SELECT lemma, count(*) AS df FROM term GROUP BY lemma), idf AS (SELECT lemma, df, ln(nd::DOUBLE / df) AS idf FROM df, nd WHERE df <= greatest(2, nd // 2) AND df < nd)"


def _terms(spark, sf):
    return co.document_terms(corpus(spark, sf), co.TOP_TERMS)


@R.add(f"WITH {TOKENS}, {_TERMS}, {_IDF} SELECT lemma, df, round(idf, 6) AS idf FROM idf")
def doc_freq_idf(spark, sf):
    n = read(spark, sf, "documents").count()
    df = _terms(spark, sf).groupBy("lemma").agg(F.count("*").alias("df")).where((F.col("df") <= max(2, n // 2)) & (F.col("df") < n))
    return df.withColumn("idf", F.round(F.log(F.lit(float(n)) / F.col("df")), 6))


_AFFINITY = f"{_IDF}, raw AS (SELECT path, lemma, (1 + ln(n)) * idf AS w FROM term JOIN idf USING (lemma)), vec AS (SELECT path, lemma, w / sqrt(sum(w * w) OVER (PARTITION BY path)) AS w FROM raw), dot AS (SELECT x.path AS a, y.path AS b, sum(x.w * y.w) AS cosine FROM vec x JOIN vec y ON x.lemma = y.lemma AND x.path < y.path GROUP BY ALL)"


@R.add(f"WITH {TOKENS}, {_TERMS}, {_AFFINITY} SELECT a, b, floor(cosine * 1000 + 0.5) / 1000 AS cosine FROM dot WHERE cosine >= 0.12")
def affinity_pairs(spark, sf, floor=do.FLOOR):
    pairs = do.affinity(materialize(_terms(spark, sf).select("path", "lemma", "n"), "terms"), read(spark, sf, "documents").count(), floor, max_pairs=None)
    return pairs.select("a", "b", (F.floor(F.col("cosine") * 1000 + 0.5) / 1000).alias("cosine"))


@R.add(f"WITH {TOKENS}, {_TERMS}, {NODES}, {PAIRS}, {CUT} SELECT path, id AS concept, n AS weight FROM term JOIN kept USING (lemma) WHERE rank <= 12")
def memberships(spark, sf):
    docs = corpus(spark, sf)
    return do.memberships(co.document_terms(docs, do.TERMS), co.cut_nodes(co.document_nodes(docs)))


@R.add(f"WITH {TOKENS}, {_TERMS}, {NODES}, {PAIRS}, {CUT} SELECT path FROM d WHERE path NOT IN (SELECT path FROM term JOIN kept USING (lemma) WHERE rank <= 12)")
def orphans(spark, sf):
    return do.orphans(corpus(spark, sf), memberships(spark, sf))


@R.add("SELECT lang, count(*) AS documents, sum(n_chars)::BIGINT AS chars, count(*) FILTER (quality = 1) AS good, count(*) FILTER (toxic = 1) AS toxic, sum(len(regexp_extract_all(text, '\\S+')))::BIGINT AS words FROM documents LEFT JOIN labels USING (doc_id) GROUP BY lang")
def corpus_stats(spark, sf):
    d = spread(read(spark, sf, "documents").select("doc_id", "lang", "n_chars", "text")).withColumn("words", F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))))
    return d.join(read(spark, sf, "labels"), "doc_id", "left").groupBy("lang").agg(F.count("*").alias("documents"), F.sum("n_chars").alias("chars"), F.count_if(F.col("quality") == 1).alias("good"), F.count_if(F.col("toxic") == 1).alias("toxic"), F.sum("words").alias("words"))


@R.add("SELECT item_id, count(doc_id) AS documents, min(doc_id) AS first_doc FROM benchmark LEFT JOIN documents ON contains(documents.text, benchmark.text) GROUP BY item_id")
def literal_leak(spark, sf):
    """Whole benchmark texts inside documents. The join runs on a rare word of each text, not on every pair."""
    from ..operators import lookup

    return lookup.literal_leaks(read(spark, sf, "benchmark"), read(spark, sf, "documents"))
