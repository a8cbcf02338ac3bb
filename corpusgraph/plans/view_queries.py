"""Queries over list views, filters, layers and differences between states."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concepts as co
from ..operators import documents as do
from ..operators import lookup, views
from ..sources import assembly
from ..storage import materialize, spread
from . import document_queries as dq
from . import graph_queries as gq
from .graph_queries import _ALL, _LABELS
from .sql_text import PATH, TOKENS
from .tables import Registry, corpus, read

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_WORDS = r"len(regexp_extract_all({0}, '\S+'))"
_STATE = "CASE WHEN size > 30000 THEN 'error' WHEN words < 3 THEN 'no text' WHEN words < 8 THEN 'metadata only' ELSE 'ok' END"
#: documents and pages as one index of files
_IX = rf"""f AS (SELECT {PATH} AS path, 'txt' AS ext, doc_id AS k, text FROM documents UNION ALL SELECT 'web/page-' || page_id || '.html', 'html', page_id, html FROM pages),
    m AS (SELECT path, regexp_extract(path, '[^/]*$') AS name, ext, k, octet_length(encode(text))::BIGINT AS size, (k * 7919) % 100000 * 1000 AS modified_ms, sha256(text) AS hash, {_WORDS.format('text')}::BIGINT AS words FROM f), ix AS (SELECT *, {_STATE} AS state FROM m)"""


def _index(spark, sf):
    d = corpus(spark, sf).select("path", F.lit("txt").alias("ext"), F.col("doc_id").alias("k"), "text")
    p = read(spark, sf, "pages").select(F.concat(F.lit("web/page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.lit("html").alias("ext"), F.col("page_id").alias("k"), F.col("html").alias("text"))
    f = spread(d.unionByName(p))
    words = F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).cast("long")
    m = f.select("path", do.base_name(F.col("path")).alias("name"), "ext", "k", F.octet_length("text").cast("long").alias("size"), ((F.col("k") * 7919) % 100000 * 1000).alias("modified_ms"), F.sha2("text", 256).alias("hash"), words.alias("words"))
    state = F.when(F.col("size") > 30000, "error").when(F.col("words") < 3, "no text").when(F.col("words") < 8, "metadata only").otherwise("ok")
    return m.withColumn("state", state)


@R.add(f"WITH {_IX} SELECT path, name, ext, size, modified_ms, hash, state, words FROM ix")
def light_index(spark, sf):
    return views.light(_index(spark, sf))


@R.add(f"WITH {_IX} SELECT count(*) AS documents, sum(words)::BIGINT AS words, sum(size)::BIGINT AS bytes, count(*) FILTER (state = 'ok') AS ok, count(*) FILTER (state = 'error') AS error, count(*) FILTER (state = 'no text') AS no_text, count(*) FILTER (state = 'metadata only') AS metadata_only FROM ix")
def index_statistics(spark, sf):
    return views.statistics(_index(spark, sf))


@R.add(f"WITH {_IX} SELECT path FROM ix WHERE ext = 'txt' AND modified_ms >= 20000000 AND contains(lower(path), '/en/doc-1')")
def map_filters(spark, sf):
    return views.filtered(_index(spark, sf), "txt", 20_000_000, "/EN/doc-1").select("path")


@R.add(f"WITH {_IX} SELECT min(modified_ms) AS oldest, max(modified_ms) AS newest, floor(min(modified_ms) + (max(modified_ms) - min(modified_ms)) * 0.37)::BIGINT AS cutoff FROM ix WHERE modified_ms > 0")
def date_slider(spark, sf):
    return views.slider(_index(spark, sf), 0.37)


@R.add(f"WITH {_IX} SELECT path, modified_ms FROM ix WHERE contains(lower(path), 'html') OR '.' || ext = 'html' OR ext = 'html' ORDER BY modified_ms DESC, path LIMIT 300")
def inventory_list(spark, sf):
    """The inventory's first 300 rows, as the list shows."""
    return views.listed(_index(spark, sf), " HTML ").select("path", "modified_ms")


@R.add(f"WITH {_IX} SELECT path, state, CASE state WHEN 'error' THEN 0 WHEN 'no text' THEN 1 ELSE 2 END AS rank FROM ix WHERE state <> 'ok'")
def problem_documents(spark, sf):
    return views.problems(_index(spark, sf)).select("path", "state", "rank")


_BEFORE = "bef AS (SELECT path, CASE WHEN k % 5 = 0 THEN 'x' ELSE hash END AS hash, words + k % 3 AS words FROM ix WHERE k % 7 <> 0), aft AS (SELECT path, hash, words FROM ix WHERE k % 11 <> 0)"


@R.add(f"WITH {_IX}, {_BEFORE} SELECT coalesce(a.path, b.path) AS path, CASE WHEN b.path IS NULL THEN 'new' WHEN a.path IS NULL THEN 'deleted' ELSE 'modified' END AS change, coalesce(a.words, 0) - coalesce(b.words, 0) AS delta FROM aft a FULL JOIN bef b ON a.path = b.path WHERE a.path IS NULL OR b.path IS NULL OR a.hash <> b.hash")
def document_delta(spark, sf):
    """Documents of two states of the index: new, modified with their words' change, deleted."""
    ix = materialize(_index(spark, sf).select("path", "k", "hash", "words"), "index")
    before = ix.where("k % 7 <> 0").select("path", F.when(F.col("k") % 5 == 0, "x").otherwise(F.col("hash")).alias("hash"), (F.col("words") + F.col("k") % 3).alias("words"))
    return views.state_delta(before, ix.where("k % 11 <> 0"))


@R.add(f"WITH {TOKENS}, o AS (SELECT DISTINCT lemma FROM tok WHERE path NOT LIKE '%7.txt'), n AS (SELECT DISTINCT lemma FROM tok WHERE path NOT LIKE '%3.txt') SELECT lemma, 'new' AS change FROM n WHERE lemma NOT IN (SELECT lemma FROM o) UNION ALL SELECT lemma, 'gone' FROM o WHERE lemma NOT IN (SELECT lemma FROM n)")
def snapshot_lemmas(spark, sf):
    """Lemmas that a state has and the other has not."""
    rows = materialize(co.token_rows(corpus(spark, sf)).select("path", "lemma").distinct(), "lemmas")
    return views.lemma_delta(rows.where(~F.col("path").endswith("7.txt")), rows.where(~F.col("path").endswith("3.txt")))


@R.add(f"WITH {_ALL}, {_LABELS}, g AS (SELECT id, lemma, form FROM lab), h AS (SELECT * FROM g WHERE contains(lower(form), 'tion') OR contains(lower(lemma), 'tion')) SELECT id, lemma, (SELECT count(*) FROM h) AS hits FROM h")
def search_highlight(spark, sf):
    nodes = materialize(co.cut_nodes(co.document_nodes(corpus(spark, sf))), "nodes")
    return views.search_hits(nodes, "Tion").select("id", "lemma", "hits")


_SCALES = "sc AS (SELECT * FROM (VALUES (0.2), (0.5), (1.0), (2.0)) t(scale))"


@R.add(f"WITH {_ALL}, {_SCALES} SELECT scale::DOUBLE AS scale, count(*) AS drawn FROM cut, sc, (SELECT count(*) AS v FROM kept) WHERE weight >= CASE WHEN v > 400 THEN CASE WHEN scale < 0.35 THEN 3 WHEN scale < 0.8 THEN 2 WHEN scale < 1.6 THEN 1.2 ELSE 0 END WHEN v > 120 THEN CASE WHEN scale < 0.5 THEN 1.5 ELSE 0 END ELSE 0 END GROUP BY scale")
def drawn_edges(spark, sf):
    """How many edges are drawn at four scales of the map."""
    nodes, edges = gq._cut(spark, sf)
    v = F.lit(nodes.count())
    scales = [0.2, 0.5, 1.0, 2.0]
    at = edges.withColumn("scale", F.explode(F.array(*[F.lit(s) for s in scales])))
    return at.where(F.col("weight") >= views.least_weight(v, F.col("scale"))).groupBy("scale").agg(F.count("*").alias("drawn"))


@R.add(f"WITH {_ALL}, m AS (SELECT DISTINCT path, lemma FROM tok), r AS (SELECT path, id, form, row_number() OVER (PARTITION BY path ORDER BY id) AS place FROM m JOIN kept USING (lemma)) SELECT path, place, id, form FROM r WHERE place <= 14")
def document_concepts(spark, sf):
    """Each document's first 14 concepts, as its panel shows."""
    rows = co.exploded(co.stored_analysis(corpus(spark, sf)))
    return views.concepts_of(rows.select("path", "lemma").distinct(), co.cut_nodes(co.concept_nodes(rows)))


@R.add(f"{dq.ORACLES['affinity_pairs'].replace('cosine >= 0.12', 'cosine >= 0.3')} ORDER BY cosine DESC, a, b LIMIT 200")
def affinity_threshold(spark, sf):
    """The first 200 pairs above a threshold, as the panel shows."""
    return views.affine(dq.affinity_pairs(spark, sf, 0.3), 0.3)


def _links(spark, sf):
    return materialize(dq.dependency_fusion(spark, sf), "links")


_DEP = dq.ORACLES["dependency_fusion"]
_LINKED = _DEP[: _DEP.index(" SELECT least(")].removeprefix("WITH ") + ", dep AS (SELECT" + _DEP[_DEP.index(" SELECT least(") + 7 :] + ")"


@R.add(f"WITH {_LINKED}, v AS (SELECT 'd' || (doc_id // 3) || '/essay ' || CASE doc_id % 3 WHEN 0 THEN 'v1' WHEN 1 THEN 'v2' ELSE 'final' END || '.md' AS path FROM documents) SELECT a, b, kind, weight, times FROM dep UNION ALL SELECT least(replace(replace(path, 'v2', 'v1'), 'final', 'v2'), path), greatest(replace(replace(path, 'v2', 'v1'), 'final', 'v2'), path), 'version', 1, 1 FROM v WHERE path NOT LIKE '%v1.md' AND replace(replace(path, 'v2', 'v1'), 'final', 'v2') IN (SELECT path FROM v)")
def all_dependencies(spark, sf):
    """Links and version chains in one, fused by pair and kind."""
    links = _links(spark, sf).select("a", "b", "kind", "weight", "times")
    chains = dq.version_chains(spark, sf).select("a", "b", F.lit("version").alias("kind"), F.lit(1).alias("weight"))
    return links.unionByName(do.fused(chains))


@R.add(f"WITH {TOKENS}, {dq._TERMS}, {dq._AFFINITY}, dep AS ({_DEP}) SELECT a, b, kind, floor(weight * 1000 + 0.5) / 1000 AS weight FROM (SELECT a, b, kind, weight::DOUBLE AS weight FROM dep UNION ALL SELECT a, b, 'affinity', cosine FROM dot WHERE cosine >= 0.12)")
def document_layer(spark, sf):
    return views.document_layer(_links(spark, sf), dq.affinity_pairs(spark, sf))


@R.add(f"WITH {_IX}, g AS (SELECT path, regexp_replace(regexp_extract(path, '^(.*/)?', 0), '/$', '') AS folder FROM ix), o AS (SELECT folder, row_number() OVER (ORDER BY min(path)) - 1 AS community FROM g GROUP BY folder) SELECT path, folder, community FROM g JOIN o USING (folder)")
def folder_colours(spark, sf):
    return views.folder_groups(_index(spark, sf))


_MIXED = f"{_ALL}, {dq._TERMS.replace('f AS (', 'tf AS (').replace('FROM f ', 'FROM tf ')}, mem AS (SELECT path, id AS concept FROM term JOIN kept USING (lemma) WHERE rank <= 12), num AS (SELECT path, row_number() OVER (ORDER BY path) - 1 + (SELECT count(*) FROM kept) AS id FROM d)"


@R.add(f"WITH {_MIXED} SELECT a_id AS a, b_id AS b, NULL AS kind, weight::DOUBLE AS weight FROM cut UNION ALL SELECT concept, num.id, 'member', 0.6 FROM mem JOIN num USING (path)")
def mixed_edges(spark, sf):
    """Edges of the mixed layer without links: concepts among themselves, and documents with their concepts."""
    docs = corpus(spark, sf)
    nodes, edges = gq._cut(spark, sf)
    members = do.memberships(co.document_terms(docs, do.TERMS), nodes)
    documents = lookup.numbered(docs.select("path"), "path", "id")
    none = spark.createDataFrame([], "a string, b string, kind string, weight double")
    return views.mixed_edges(edges, none, members, documents, nodes.count())


@R.add(f"WITH {_LINKED}, num AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS id FROM (SELECT DISTINCT path FROM d)) SELECT x.id AS a, y.id AS b, kind, weight::DOUBLE AS weight FROM dep JOIN num x ON x.path = a JOIN num y ON y.path = b")
def mixed_links(spark, sf):
    """The links of the mixed layer, by the documents' numbers."""
    documents = lookup.numbered(corpus(spark, sf).select("path").distinct(), "path", "id")
    none = spark.createDataFrame([], "a_id long, b_id long, weight double")
    return views.mixed_edges(none, _links(spark, sf), spark.createDataFrame([], "path string, concept long"), documents, 0)


@R.add(f"WITH {_LINKED} SELECT a AS from_path, b AS to_path, kind, weight FROM dep ORDER BY weight DESC, a, b LIMIT 60")
def summary_links(spark, sf):
    """The first 60 dependencies with the paths of both ends, as the summary shows; ends are looked up by number."""
    links = _links(spark, sf)
    names = materialize(lookup.numbered(corpus(spark, sf).select("path").distinct(), "path", "id"), "numbers")
    place = lambda x: names.select(F.col("path").alias(x), F.col("id").alias(f"{x}_id"))
    numbers = links.join(place("a"), "a").join(place("b"), "b").select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "kind", "weight")
    return views.named_partners(numbers, names).orderBy(F.desc("weight"), "from_path", "to_path").limit(60).select("from_path", "to_path", "kind", "weight")


@R.add(f"WITH {TOKENS}, p AS (SELECT DISTINCT url, unnest(regexp_extract_all(lower(url), '[a-z]{{3,}}')) AS lemma FROM pages) SELECT lemma FROM tok UNION SELECT lemma FROM p")
def corpus_lemmas(spark, sf):
    """The lemmas of texts and the words of addresses, each once."""
    words = read(spark, sf, "pages").select(F.explode(F.regexp_extract_all(F.lower("url"), F.lit("[a-z]{3,}"), F.lit(0))).alias("lemma"))
    return views.all_lemmas(co.token_rows(corpus(spark, sf)), words)


@R.add(f"WITH {TOKENS}, vocabulary AS (SELECT lemma, count(DISTINCT path) AS docs FROM tok GROUP BY lemma) SELECT lemma, docs FROM vocabulary ORDER BY docs DESC, lemma LIMIT 300")
def snapshot_vocabulary(spark, sf):
    """The 300 commonest lemmas that a snapshot keeps."""
    v = co.vocabulary(co.token_rows(corpus(spark, sf)))
    return v.orderBy(F.desc("doc_count"), "lemma").limit(views.SNAP_WORDS).select("lemma", F.col("doc_count").alias("docs"))


_SNAP = f"{_ALL}, {_LABELS}, few AS (SELECT *, row_number() OVER (ORDER BY betweenness DESC, frequency DESC, id) - 1 AS number FROM lab ORDER BY betweenness DESC, frequency DESC, id LIMIT 500)"


@R.add(f"WITH {_SNAP} SELECT number, lemma, form, frequency, community, betweenness FROM few")
def snapshot_nodes(spark, sf):
    """The 500 concepts that a snapshot keeps."""
    return views.snapshot_nodes(gq._labelled(spark, sf)[0]).select("number", "lemma", "form", "frequency", "community", "betweenness")


@R.add(f"WITH {_SNAP} SELECT x.number AS a, y.number AS b, weight FROM cut JOIN few x ON x.id = a_id JOIN few y ON y.id = b_id ORDER BY weight DESC, a_id, b_id LIMIT 2500")
def snapshot_edges(spark, sf):
    """The 2,500 heaviest edges between them."""
    lab, edges = gq._labelled(spark, sf)
    return views.snapshot_edges(edges, views.snapshot_nodes(lab))


@R.add("SELECT event_id, strftime(ts, '%Y-%m-%d %H:%M') AS stamp, strftime(ts, '%Y-%m-%d') AS day FROM events")
def date_stamps(spark, sf):
    return read(spark, sf, "events").select("event_id", views.stamp(F.col("ts")).alias("stamp"), views.stamp(F.col("ts"), False).alias("day"))


@R.add("SELECT page_id, regexp_replace(regexp_extract(url, '[^/]*$'), '\\.[A-Za-z0-9]{1,10}$', '') AS name FROM pages WHERE url <> ''")
def short_names(spark, sf):
    return read(spark, sf, "pages").where("url <> ''").select("page_id", views.short_name(F.col("url")).alias("name"))


_POINTS = "pt AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, 0.05 + vec_id % 5 * 0.01 AS radius, vec_id % 3 <> 0 AS visible FROM embeddings)"


def _points(spark, sf):
    k = F.col("vec_id")
    return read(spark, sf, "embeddings").select(k.alias("id"), F.col("embedding")[0].cast("double").alias("x"), F.col("embedding")[1].cast("double").alias("y"), (0.05 + k % 5 * 0.01).alias("radius"), (k % 3 != 0).alias("visible"))


@R.add(f"WITH {_POINTS} SELECT min(x) AS x0, min(y) AS y0, max(x) AS x1, max(y) AS y1 FROM pt WHERE visible")
def bounding_box(spark, sf):
    return views.bounding_box(_points(spark, sf))


@R.add(f"WITH {_POINTS}, q AS (SELECT id, round(x * x + y * y, 9) AS d2 FROM pt WHERE visible AND x * x + y * y <= pow(radius + 1, 2)) SELECT id, d2 FROM q ORDER BY d2, id LIMIT 1")
def nearest_point(spark, sf):
    """The point under a place of the map."""
    return views.nearest(_points(spark, sf), 0.0, 0.0, 1.0).withColumn("d2", F.round("d2", 9))


_FILES = rf"fl AS (SELECT source || '/' || lang || '/doc-' || doc_id || CASE WHEN doc_id % 50 = 7 THEN '.png' ELSE '.txt' END AS path, text, 'text' AS parser, doc_id % 40 = 3 AS away FROM documents UNION ALL SELECT 'web/page-' || page_id || '.html', CASE WHEN t <> '' THEN t || chr(10) || chr(10) ELSE '' END || b, 'html', false FROM (SELECT page_id, {dq._TITLE} AS t, {dq._sql_body('html')} AS b FROM pages))"
_INDEX = TOKENS.replace(f"SELECT {PATH} AS path, text, ", "SELECT path, text, ").replace("AS detected FROM documents)", "AS detected FROM ok)")


def _files(spark, sf):
    """documents and pages as files: some documents are images by name, some are still in the cloud."""
    k = F.col("doc_id")
    ext = F.when(k % 50 == 7, ".png").otherwise(".txt")
    d = read(spark, sf, "documents").select(F.concat("source", F.lit("/"), "lang", F.lit("/doc-"), k.cast("string"), ext).alias("path"), F.col("text").cast("binary").alias("content"), (k % 40 == 3).alias("placeholder"))
    p = read(spark, sf, "pages").select(F.concat(F.lit("web/page-"), F.col("page_id").cast("string"), F.lit(".html")).alias("path"), F.col("html").cast("binary").alias("content"), F.lit(False).alias("placeholder"))
    return spread(d.unionByName(p)).withColumn("size", F.length("content").cast("long"))


@R.add(rf"""WITH {_FILES}, st AS (SELECT *, CASE WHEN away THEN 'error' WHEN ends_with(path, '.png') THEN 'metadata only' WHEN trim(text) = '' THEN 'no text' ELSE 'ok' END AS state FROM fl), ok AS (SELECT path, text FROM st WHERE state = 'ok'), {_INDEX},
    tk AS (SELECT path, count(*) AS tokens, count(DISTINCT lemma) AS terms FROM tok GROUP BY path), sn AS (SELECT path, count(*) AS sentences FROM s GROUP BY path)
    SELECT st.path, state, CASE WHEN away THEN 'none' WHEN ends_with(st.path, '.png') THEN 'binary' ELSE st.parser END AS parser, CASE WHEN away THEN 'still in the cloud' WHEN state = 'metadata only' THEN 'no text in image' END AS error,
    coalesce(detected, 'indeterminado') AS language, coalesce(sentences, 0) AS sentences, coalesce(tokens, 0) AS tokens, least(coalesce(terms, 0), 400) AS terms, CASE WHEN state = 'ok' THEN len(regexp_extract_all(st.text, '\S+')) ELSE 0 END AS words FROM st LEFT JOIN d USING (path) LEFT JOIN tk USING (path) LEFT JOIN sn USING (path)""")
def document_index(spark, sf):
    """Files to index rows: states, language, sentences, tokens, terms and words of each."""
    index = assembly.assembled(assembly.parsed(_files(spark, sf)))
    return index.select("path", "state", "parser", "error", "language", "sentences", "tokens", F.size("terms").alias("terms"), "words")
