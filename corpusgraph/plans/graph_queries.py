"""Queries over the concept graph, its communities and gaps, lookups, exports and snapshots."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..functions import scalars as sc
from ..operators import concepts as co
from ..operators import export as ex
from ..operators import centrality, clustering, gaps, graph, lookup, tallies
from ..storage import materialize
from .sql_text import CUT, NODES, PAIRS, TOKENS
from .tables import Registry, corpus, read

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_ALL = f"{TOKENS}, {NODES}, {PAIRS}, {CUT}"
#: A fixed labelling: an id's remainder; and a stand-in for betweenness from degree.
_LABELS = "deg AS (SELECT id, count(*) AS degree, sum(weight) AS strength FROM (SELECT a_id AS id, weight FROM cut UNION ALL SELECT b_id, weight FROM cut) GROUP BY id), lab AS (SELECT kept.id, lemma, form, frequency, docs, kept.id % 7 AS community, coalesce(degree, 0) AS degree, coalesce(strength, 0) AS strength, coalesce(degree, 0) * (kept.id % 5) AS betweenness FROM kept LEFT JOIN deg USING (id))"


def _cut(spark, sf):
    """The cut concept graph, stored: at most 3,000 concepts and their edges."""
    return co.document_cut(corpus(spark, sf))


def _labelled(spark, sf):
    return _labelled_of(*_cut(spark, sf))


def _labelled_of(nodes, edges):
    deg = graph.degrees(edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "weight")).withColumnRenamed("node", "id")
    lab = nodes.join(deg, "id", "left").withColumn("degree", F.coalesce("degree", F.lit(0))).withColumn("strength", F.coalesce("strength", F.lit(0.0)))
    return lab.withColumn("community", F.col("id") % 7).withColumn("betweenness", F.col("degree") * (F.col("id") % 5)), edges


@R.add(f"WITH {_ALL}, {_LABELS} SELECT lemma, degree, round(strength, 4) AS strength FROM lab WHERE degree > 0")
def degree_strength(spark, sf):
    lab, _ = _labelled(spark, sf)
    return lab.where("degree > 0").select("lemma", "degree", F.round("strength", 4).alias("strength"))


@R.add(f"WITH {_ALL}, {_LABELS}, e AS (SELECT x.community AS ca, y.community AS cb, weight FROM cut JOIN lab x ON x.id = a_id JOIN lab y ON y.id = b_id), t AS (SELECT c, sum(w) AS total, sum(i) AS inner_w FROM (SELECT ca AS c, weight AS w, CASE WHEN ca = cb THEN weight ELSE 0 END AS i FROM e UNION ALL SELECT cb, weight, 0 FROM e) GROUP BY c), q AS (SELECT 2 * sum(inner_w) / sum(total) - sum(total * total) / (sum(total) * sum(total)) AS q FROM t) SELECT round(q, 8) AS modularity, CASE WHEN q < .2 THEN 'focused' WHEN q < .4 THEN 'medium' WHEN q < .6 THEN 'diverse' ELSE 'scattered' END AS diversity FROM q")
def modularity_fixed(spark, sf):
    lab, edges = _labelled(spark, sf)
    q = graph.modularity(edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "weight"), lab.select(F.col("id").alias("node"), "community"))
    return q.select(F.round("modularity", 8).alias("modularity"), graph.diversity(F.col("modularity")).alias("diversity"))


@R.add()
def louvain_communities(spark, sf):
    nodes, edges = _cut(spark, sf)
    return clustering.communities(nodes, edges).join(nodes.select("id", "lemma"), "id")


@R.add()
def betweenness(spark, sf):
    nodes, edges = _cut(spark, sf)
    return centrality.betweenness(nodes, edges).join(nodes.select("id", "lemma"), "id")


@R.add(f"WITH RECURSIVE {_ALL}, near AS MATERIALIZED (SELECT a_id AS s, b_id AS t FROM cut UNION SELECT b_id, a_id FROM cut), big AS (SELECT 0::BIGINT AS id UNION SELECT t FROM big JOIN near ON s = id), small AS (SELECT id AS s, id AS t FROM kept WHERE id NOT IN (SELECT id FROM big) UNION SELECT small.s, near.t FROM small JOIN near ON near.s = small.t), own AS (SELECT id, 0 AS component FROM big UNION ALL SELECT t, min(s) FROM small GROUP BY t) SELECT component, count(*) AS nodes FROM own GROUP BY component")
def components(spark, sf):
    nodes, edges = _cut(spark, sf)
    return graph.component_table(nodes, edges).groupBy("component").agg(F.count("*").alias("nodes"))


@R.add(f"WITH RECURSIVE {_ALL}, near AS MATERIALIZED (SELECT a_id AS s, b_id AS t FROM cut UNION SELECT b_id, a_id FROM cut), h AS (SELECT 0::BIGINT AS id, 0 AS hops UNION SELECT t, hops + 1 FROM h JOIN near ON s = h.id WHERE hops < 8) SELECT lemma, min(hops) AS hops FROM h JOIN kept USING (id) GROUP BY lemma")
def hop_distance(spark, sf):
    nodes, edges = _cut(spark, sf)
    found = graph.hops(edges.select(F.col("a_id").cast("long").alias("a"), F.col("b_id").cast("long").alias("b")), 0)
    return found.join(nodes.select(F.col("id").alias("node"), "lemma"), "node").select("lemma", "hops")


@R.add(f"WITH {_ALL}, {_LABELS}, m AS (SELECT max(betweenness) AS mb, max(frequency) AS mf FROM lab) SELECT id, lemma, frequency, betweenness, round((betweenness / mb) / (frequency / mf + 0.08), 9) AS ratio FROM lab, m WHERE betweenness > 0 ORDER BY (betweenness / mb) / (frequency / mf + 0.08) DESC, id LIMIT 20")
def connectors(spark, sf):
    """The report's 20 connecting concepts."""
    return gaps.connectors(_labelled(spark, sf)[0]).withColumn("ratio", F.round("ratio", 9))


@R.add(f"WITH {_ALL}, {_LABELS} SELECT id, lemma, betweenness FROM lab ORDER BY betweenness DESC, frequency DESC, id LIMIT 25")
def influencers(spark, sf):
    """The report's 25 influential concepts."""
    return gaps.influencers(_labelled(spark, sf)[0]).select("id", "lemma", "betweenness")


@R.add(f"WITH {_ALL}, {_LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY betweenness DESC, frequency DESC, id) AS r FROM lab) SELECT community, count(*) AS nodes, round(100 * count(*) / (SELECT count(*) FROM lab), 6) AS percentage, sum(frequency)::BIGINT AS frequency, string_agg(form, ' · ' ORDER BY r) FILTER (r <= 3) AS name FROM r GROUP BY community")
def community_summary(spark, sf):
    return gaps.summaries(_labelled(spark, sf)[0]).withColumn("percentage", F.round("percentage", 6))


_DENSE = """size AS (SELECT community AS c, count(*) AS n FROM lab GROUP BY 1 HAVING count(*) >= 3), ends AS (SELECT least(x.community, y.community) AS ca, greatest(x.community, y.community) AS cb FROM cut JOIN lab x ON x.id = a_id JOIN lab y ON y.id = b_id),
    k AS (SELECT ca, cb, count(*) AS k FROM ends GROUP BY ALL), inn AS (SELECT c, n, coalesce(k, 0) / (n * (n - 1) / 2) AS inn FROM size LEFT JOIN k ON ca = c AND cb = c),
    dens AS (SELECT x.c AS ca, y.c AS cb, x.n AS na, y.n AS nb, coalesce(k, 0) AS edges, coalesce(k, 0) / (x.n * y.n) AS density, x.inn AS inner_a, y.inn AS inner_b, (SELECT count(*) FROM cut) / ((SELECT count(*) FROM lab) * ((SELECT count(*) FROM lab) - 1) / 2) AS global_density FROM inn x JOIN inn y ON x.c < y.c LEFT JOIN k ON k.ca = x.c AND k.cb = y.c)"""
_ROUND = "ca, cb, na, nb, edges, round(density, 9) AS density, round(inner_a, 9) AS inner_a, round(inner_b, 9) AS inner_b, round(global_density, 9) AS global_density"


def _rounded(df):
    return df.withColumns({c: F.round(c, 9) for c in ("density", "inner_a", "inner_b", "global_density")})


@R.add(f"WITH {_ALL}, {_LABELS}, {_DENSE} SELECT {_ROUND} FROM dens")
def cross_density(spark, sf):
    lab, edges = _labelled(spark, sf)
    return _rounded(gaps.densities(lab, edges))


@R.add(f"WITH {_ALL}, {_LABELS}, {_DENSE} SELECT {_ROUND} FROM dens WHERE density <= (SELECT quantile_cont(density, 0.25) FROM dens) AND inner_a >= global_density AND inner_b >= global_density")
def structural_gaps(spark, sf):
    lab, edges = _labelled(spark, sf)
    return _rounded(gaps.structural(gaps.densities(lab, edges)))


_DOCS = "dt AS (SELECT path, count(DISTINCT lemma) AS terms FROM tok GROUP BY path)"


def _doc_terms(spark, sf):
    return materialize(co.lemma_counts(corpus(spark, sf)), "lemma-counts")


@R.add(f"WITH {TOKENS}, {_DOCS} SELECT path, terms FROM dt WHERE terms >= (SELECT quantile_cont(terms, 0.5) FROM dt WHERE terms > 0) AND path NOT LIKE 'src1/%'")
def isolated_docs(spark, sf):
    d = _doc_terms(spark, sf)
    return gaps.isolated(d, d.where(F.col("path").startswith("src1/")))


@R.add(f"WITH {TOKENS}, {_DOCS}, o AS (SELECT *, row_number() OVER (ORDER BY terms, path) AS r, count(*) OVER () AS n FROM dt) SELECT path, terms FROM dt WHERE terms >= (SELECT terms FROM o WHERE r = n // 2 + 1) AND path NOT LIKE 'src1/%'")
def isolated_quick(spark, sf):
    d = _doc_terms(spark, sf)
    return gaps.isolated_quick(d, d.where(F.col("path").startswith("src1/")))


@R.add(f"WITH {_ALL} SELECT b_id AS dst, b AS lemma FROM cut WHERE a_id = 0 UNION SELECT a_id, a FROM cut WHERE b_id = 0")
def neighbourhood(spark, sf):
    nodes, edges = _cut(spark, sf)
    e = edges.select(F.col("a_id").alias("a"), F.col("b_id").alias("b"), "weight")
    near = lookup.neighbours(e, nodes.where("id = 0").select(F.col("id").alias("src")))
    return near.join(nodes.select(F.col("id").alias("dst"), "lemma"), "dst").select("dst", "lemma")


@R.add(f"WITH {_ALL}, top AS (SELECT lemma FROM kept WHERE id = 0), t AS (SELECT path, sentence, CASE WHEN a = lemma THEN b ELSE a END AS p FROM pair, top WHERE a = lemma OR b = lemma) SELECT path, sentence, string_agg(DISTINCT p, ' ' ORDER BY p) AS partners FROM t GROUP BY ALL")
def trace_sentences(spark, sf):
    docs = corpus(spark, sf)
    top = co.cut_nodes(co.document_nodes(docs), max_nodes=1).first()
    return lookup.traces(tallies.partners(docs, top["lemma"] if top else None), F.lit(top["lemma"] if top else None))


@R.add(f"WITH {_ALL}, {_LABELS} SELECT id, lemma FROM lab ORDER BY betweenness DESC, frequency DESC, lemma LIMIT 320")
def visible_top(spark, sf):
    """The 320 concepts that a map shows."""
    return lookup.visible(_labelled(spark, sf)[0]).select("id", "lemma")


@R.add(f"WITH {_ALL}, {_LABELS} SELECT id || ',' || lemma || ',' || CASE WHEN regexp_matches(form, '[\",;]') THEN '\"' || form || '\"' ELSE form END || ',' || frequency || ',' || docs || ',' || community || ',' || degree || ',' || printf('%.2f', strength::DOUBLE) || ',' || printf('%.6f', betweenness::DOUBLE) AS line FROM lab")
def concept_csv(spark, sf):
    return ex.csv_lines(_labelled(spark, sf)[0])


@R.add("WITH c AS (SELECT lang AS community, list(DISTINCT source ORDER BY source) AS forms, count(DISTINCT source) AS nodes, count(*) AS docs FROM documents GROUP BY lang) SELECT community, '{\"tipo\":\"tema\",\"terminos\":[\"' || array_to_string(forms[:12], '\",\"') || '\"],\"conceptos\":' || nodes || ',\"documentos\":' || docs || '}' AS payload, array_to_string(forms[:3], ' · ') AS name FROM c")
def topic_payload(spark, sf):
    c = read(spark, sf, "documents").groupBy(F.col("lang").alias("community")).agg(F.array_sort(F.collect_set("source")).alias("forms"), F.countDistinct("source").alias("nodes"), F.count("*").alias("docs"))
    return ex.topic_payload(c)


@R.add(r"""SELECT doc_id, length(text) <= 120 AND NOT contains(text, chr(10)) AND NOT regexp_matches(text, '[.!?…][\s"''»)]+[A-ZÁÉÍÓÚÑ¿¡]') AS safe FROM documents""")
def payload_audit(spark, sf):
    sent = F.to_json(F.struct(F.lit("x").alias("tipo"), F.array("text").alias("terminos")))
    return read(spark, sf, "documents").select("doc_id", ex.audit_json(sent)["safe"].alias("safe"))


@R.add("WITH s AS (SELECT date_trunc('day', ts) AS date, count(*) AS events, count(DISTINCT user_id) AS users FROM events GROUP BY 1) SELECT date, events, users, events - lag(events) OVER w AS events_step, events - first_value(events) OVER w AS events_total, users - lag(users) OVER w AS users_step, users - first_value(users) OVER w AS users_total FROM s WINDOW w AS (ORDER BY date)")
def snapshot_timeline(spark, sf):
    s = read(spark, sf, "events").groupBy(F.date_trunc("day", "ts").alias("date")).agg(F.count("*").alias("events"), F.countDistinct("user_id").alias("users"))
    return ex.evolution(s)


@R.add("WITH e AS (SELECT regexp_extract(path, '[^.]*$') AS ext, n_chars, doc_id FROM (SELECT 'd.' || lang AS path, n_chars, doc_id FROM documents)) SELECT ext, count(*) AS n, min(doc_id) AS first_doc, max(doc_id) AS last_doc FROM e GROUP BY ext")
def facet_counts(spark, sf):
    return read(spark, sf, "documents").groupBy(F.col("lang").alias("ext")).agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))


@R.add(f"WITH {_ALL}, o AS (SELECT lemma FROM tok WHERE path NOT LIKE '%7.txt' GROUP BY lemma) SELECT id, lemma, lemma NOT IN (SELECT lemma FROM o) AS is_new FROM kept")
def time_travel_new(spark, sf):
    rows = co.exploded(co.stored_analysis(corpus(spark, sf)))
    kept = co.cut_nodes(co.document_nodes(corpus(spark, sf)))
    old = rows.where(~F.col("path").endswith("7.txt")).select("lemma").distinct().withColumn("was", F.lit(True))
    return kept.join(old, "lemma", "left").select("id", "lemma", F.col("was").isNull().alias("is_new"))


@R.add(f"WITH {_ALL}, n AS (SELECT count(*) AS n FROM kept) SELECT id, 'concept' AS kind, lemma AS name, community FROM (SELECT id, lemma, id % 7 AS community FROM kept) UNION ALL SELECT n + row_number() OVER (ORDER BY path) - 1, 'document', path, -1 FROM d, n")
def mixed_union(spark, sf):
    docs = corpus(spark, sf)
    kept = materialize(co.cut_nodes(co.document_nodes(docs)), "nodes")
    n = kept.count()
    numbered = lookup.numbered(docs.select("path"), "path").select((F.col("number") + n).alias("id"), F.lit("document").alias("kind"), F.col("path").alias("name"), F.lit(-1).cast("long").alias("community"))
    return kept.select(F.col("id").cast("long").alias("id"), F.lit("concept").alias("kind"), F.col("lemma").alias("name"), (F.col("id") % 7).cast("long").alias("community")).unionByName(numbered)


_L, _M, _S = (f"pow(0.72 + {p} * ca + {q} * cb, 3)" for p, q in ((0.3963377774, 0.2158037573), (-0.1055613458, -0.0638541728), (-0.0894841775, -1.2914855480)))


def _channel(p, q, r):
    x = f"({p} * {_L} + {q} * {_M} + {r} * {_S})"
    return f"floor(least(1.0, greatest(0.0, CASE WHEN {x} <= 0.0031308 THEN 12.92 * {x} ELSE 1.055 * pow(greatest({x}, 0.0), 1 / 2.4) - 0.055 END)) * 255 + 0.5)::BIGINT"


@R.add(f"WITH c AS (SELECT DISTINCT doc_id % 97 AS community FROM documents), h AS (SELECT community, 0.13 * cos(fmod(258 + community * 137.508, 360) * {math.pi} / 180) AS ca, 0.13 * sin(fmod(258 + community * 137.508, 360) * {math.pi} / 180) AS cb FROM c) SELECT community, {_channel(4.0767416621, -3.3077115913, 0.2309699292)} AS red, {_channel(-1.2684380046, 2.6097574011, -0.3413193965)} AS green, {_channel(-0.0041960863, -0.7034186147, 1.7076147010)} AS blue FROM h")
def community_rgb(spark, sf):
    c = read(spark, sf, "documents").select((F.col("doc_id") % 97).alias("community")).distinct()
    red, green, blue = sc.community_rgb(F.col("community").cast("double"))
    return c.select("community", red.alias("red"), green.alias("green"), blue.alias("blue"))


_BRIDGES = """ends AS (SELECT a_id AS id, b_id AS near FROM cut UNION ALL SELECT b_id, a_id FROM cut), central AS (SELECT id, lemma, betweenness FROM lab WHERE degree >= 2 AND betweenness > 0 ORDER BY betweenness DESC, id LIMIT 400),
    held AS (SELECT DISTINCT lemma, path || '#' || sentence AS path FROM tok), own AS (SELECT id, path FROM held JOIN central USING (lemma)),
    near AS (SELECT e.id, e.near, lab.lemma, lab.community FROM ends e JOIN central USING (id) JOIN lab ON lab.id = e.near),
    sides AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY n DESC, community) AS side FROM (SELECT id, community, count(*) AS n FROM near GROUP BY ALL)) WHERE side <= 2),
    seen AS (SELECT DISTINCT n.id, h.path, s.side FROM near n JOIN sides s ON s.id = n.id AND s.community = n.community JOIN held h ON h.lemma = n.lemma JOIN own o ON o.id = n.id AND o.path = h.path),
    per AS (SELECT id, count(*) FILTER (a AND b) AS joint, count(*) FILTER (a) AS docs_a, count(*) FILTER (b) AS docs_b FROM (SELECT id, path, bool_or(side = 1) AS a, bool_or(side = 2) AS b FROM seen GROUP BY ALL) GROUP BY id)"""


@R.add(f"WITH {_ALL}, {_LABELS}, {_BRIDGES} SELECT p.id, c.lemma, (SELECT community FROM sides s WHERE s.id = p.id AND side = 1) AS community_a, (SELECT community FROM sides s WHERE s.id = p.id AND side = 2) AS community_b, docs_a, docs_b, c.betweenness * (SELECT min(n) FROM sides s WHERE s.id = p.id) AS score FROM per p JOIN central c USING (id) WHERE joint = 0 AND docs_a > 0 AND docs_b > 0 AND (SELECT count(*) FROM own o WHERE o.id = p.id) >= 2 ORDER BY score DESC, p.id LIMIT 15")
def missing_bridges(spark, sf):
    """The report's 15 missing bridges, with sentences in the part of documents."""
    analysis = co.stored_analysis(corpus(spark, sf))
    lab, edges = _labelled(spark, sf)
    postings = co.exploded(analysis).select("lemma", F.concat("path", F.lit("#"), F.col("sentence").cast("string")).alias("path"))
    return gaps.missing_bridges(lab, edges, postings)
