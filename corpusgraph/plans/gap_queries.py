"""Queries over gaps, their questions and payloads, components and routes."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import concepts as co
from ..operators import documents as do
from ..operators import export as ex
from ..operators import centrality, clustering, gaps, graph
from ..sources import parsers as pr
from ..storage import materialize
from . import document_queries as dq
from . import graph_queries as gq
from .graph_queries import _ALL, _DENSE, _LABELS
from .sql_text import TOKENS
from .tables import Registry, corpus

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_GAPS = f"""{_ALL}, {_LABELS}, {_DENSE}, sg AS (SELECT * FROM dens WHERE density <= (SELECT quantile_cont(density, 0.25) FROM dens) AND inner_a >= global_density AND inner_b >= global_density),
    rk AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY betweenness DESC, frequency DESC, id) AS r FROM lab),
    cen AS (SELECT community, id, form FROM rk WHERE r = 1), term6 AS (SELECT community, string_agg(form, ' | ' ORDER BY r) AS terms FROM rk WHERE r <= 6 GROUP BY community),
    hit AS (SELECT community, path, count(*) AS n FROM (SELECT DISTINCT lemma, path FROM tok) JOIN lab USING (lemma) GROUP BY ALL), doc3 AS (SELECT community, string_agg(path, ' | ' ORDER BY r) AS docs FROM (SELECT *, row_number() OVER (PARTITION BY community ORDER BY n DESC, path) AS r FROM hit) WHERE r <= 3 GROUP BY community),
    near AS MATERIALIZED (SELECT a_id AS s, b_id AS t FROM cut UNION SELECT b_id, a_id FROM cut), h AS (SELECT id AS s, id AS t, 0 AS hops FROM cen UNION SELECT h.s, near.t, hops + 1 FROM h JOIN near ON near.s = h.t WHERE hops < 5),
    far AS (SELECT s, t, min(hops) AS distance FROM h GROUP BY s, t), fr AS (SELECT community, sum(frequency) AS f FROM lab GROUP BY community),
    gap AS (SELECT ca, cb, na, nb, edges, density, inner_a, inner_b, distance, (fa.f + fb.f) / (SELECT sum(frequency) FROM lab) AS weight, CASE WHEN distance IS NULL THEN 1 / 12 ELSE 1 / greatest(distance, 1) END AS ease, x.form AS central_a, y.form AS central_b, ta.terms AS terms_a, tb.terms AS terms_b, da.docs AS docs_a, db.docs AS docs_b
        FROM sg JOIN cen x ON x.community = ca JOIN cen y ON y.community = cb JOIN fr fa ON fa.community = ca JOIN fr fb ON fb.community = cb JOIN term6 ta ON ta.community = ca JOIN term6 tb ON tb.community = cb LEFT JOIN doc3 da ON da.community = ca LEFT JOIN doc3 db ON db.community = cb LEFT JOIN far ON far.s = x.id AND far.t = y.id)"""


def _analysed(spark, sf):
    """The labelled cut graph, and the postings it comes from."""
    analysis = co.stored_analysis(corpus(spark, sf))
    lab, edges = gq._labelled(spark, sf)
    return materialize(lab, "labelled"), edges, materialize(co.exploded(analysis).select("lemma", "path").distinct(), "postings")


def _structural(spark, sf):
    return gaps.structural_gaps(*_analysed(spark, sf))


@R.add(f"WITH RECURSIVE {_GAPS} SELECT ca, cb, na, nb, edges, round(density, 9) AS density, round(inner_a, 9) AS inner_a, round(inner_b, 9) AS inner_b, distance, round(weight, 9) AS weight, round(ease, 9) AS ease, round(weight * ease, 9) AS score, central_a, central_b, terms_a, terms_b, docs_a, docs_b FROM gap ORDER BY weight * ease DESC, ca, cb LIMIT 12")
def gaps_structural(spark, sf):
    """The report's 12 structural gaps, with distance, ease, weight, central concepts, terms and documents of both sides."""
    g = _structural(spark, sf)
    g = g.withColumns({c: F.array_join(c, " | ") for c in ("terms_a", "terms_b", "docs_a", "docs_b")})
    return g.withColumns({c: F.round(c, 9) for c in ("density", "inner_a", "inner_b", "weight", "ease", "score")})


_WRITTEN = """lnk AS (SELECT l.path AS a, t.path AS b FROM (SELECT path, unnest(list_concat(regexp_extract_all(text, '\\[\\[([^\\]|#]+)(?:[#|][^\\]]*)?\\]\\]', 1), regexp_extract_all(text, '\\[[^\\]]*\\]\\(([^)\\s]+)', 1))) AS target FROM d) l
    JOIN (SELECT path, lower(regexp_extract(path, '([^/]*)\\.txt$', 1)) AS name FROM d) t ON t.name = lower(regexp_extract(l.target, '([^/#]*?)(\\.txt)?(#.*)?$', 1)) WHERE t.path <> l.path)"""
_LINK4 = f"lnk AS (SELECT a, b FROM ({dq.ORACLES['dependency_fusion']}) WHERE regexp_extract(a, 'doc-([0-9]+)', 1)::BIGINT % 4 = 0)"
_ALONE_OF = f"""{TOKENS}, {dq._TERMS}, {dq._AFFINITY}, @LINKS@, aff AS (SELECT a, b, cosine FROM dot WHERE cosine >= 0.12),
    ix AS (SELECT d.path, coalesce(n, 0) AS terms, len(regexp_extract_all(text, '\\S+')) AS words FROM d LEFT JOIN (SELECT path, count(DISTINCT lemma) AS n FROM tok GROUP BY path) USING (path)),
    alone AS (SELECT path, terms, words FROM ix WHERE terms > 0 AND terms >= (SELECT quantile_cont(terms, 0.5) FROM ix WHERE terms > 0) AND path NOT IN (SELECT a FROM lnk UNION SELECT b FROM lnk)),
    ends AS (SELECT a AS path, b AS near, cosine FROM aff UNION ALL SELECT b, a, cosine FROM aff), top3 AS (SELECT path, string_agg(near, ' | ' ORDER BY r) AS affine FROM (SELECT *, row_number() OVER (PARTITION BY path ORDER BY round(cosine, 6) DESC, near) AS r FROM ends) WHERE r <= 3 GROUP BY path)"""
_ALONE, _ALONE_FOURTH = _ALONE_OF.replace("@LINKS@", _WRITTEN), _ALONE_OF.replace("@LINKS@", _LINK4)
_ISOLATED = "SELECT path, terms, words, coalesce(affine, '') AS affine, terms * CASE WHEN affine IS NULL THEN 1.5 ELSE 1.0 END AS score FROM alone LEFT JOIN top3 USING (path) ORDER BY score DESC, path LIMIT 20"


def _written_links(docs):
    """The links that the texts hold, resolved among their paths: a, b."""
    targets = F.concat(pr.wiki_links(F.col("text")), pr.markdown_links(F.col("text")))
    links = docs.select(F.col("path").alias("from_path"), F.explode(targets).alias("target"))
    return do.resolve_links(links, docs.select("path")).where("resolved IS NOT NULL AND resolved <> from_path").select(F.col("from_path").alias("a"), F.col("resolved").alias("b"))


def _alone_of(spark, sf, links=None):
    """What isolated documents are told from: the index, the dependencies (those written in the texts if none are given) and the affinities."""
    docs = corpus(spark, sf).select("path", "text")
    terms = materialize(co.document_terms(docs, co.TOP_TERMS).select("path", "lemma", "n"), "terms")
    own = co.lemma_counts(docs)
    ix = docs.select("path", F.lit("ok").alias("state"), F.size(F.regexp_extract_all("text", F.lit(r"\S+"), F.lit(0))).alias("words")).join(own, "path", "left").withColumn("terms", F.coalesce("terms", F.lit(0)))
    pairs = do.affinity(terms, docs.count(), max_pairs=None).withColumn("cosine", F.round("cosine", 6))
    return materialize(ix, "index"), _written_links(docs) if links is None else links, pairs


def _isolated(spark, sf, limit=gaps.MAX_ISOLATED):
    return gaps.isolated_documents(*_alone_of(spark, sf), limit)


@R.add(f"WITH {_ALONE} {_ISOLATED}")
def gaps_isolated(spark, sf):
    """The report's 20 isolated documents: of at least the median's terms, and without a link in either direction."""
    return _isolated(spark, sf).withColumn("affine", F.array_join("affine", " | "))


@R.add(f"WITH {_ALONE_FOURTH} {_ISOLATED}")
def gaps_isolated_fourth_linked(spark, sf):
    """As gaps_isolated, where only every fourth document's made-up links count as dependencies, so that SQL meets both cases."""
    links = dq.dependency_fusion(spark, sf).where(F.regexp_extract("a", "doc-([0-9]+)", 1).cast("long") % 4 == 0)
    return gaps.isolated_documents(*_alone_of(spark, sf, links)).withColumn("affine", F.array_join("affine", " | "))


_FINE = _LABELS.replace("kept.id % 7 AS community", "kept.id % 997 AS community")


def _fine(spark, sf):
    """The cut graph under a fine labelling, so that a concept's two sides are small and may lie in unlike sentences."""
    analysis = co.stored_analysis(corpus(spark, sf))
    lab, edges = gq._labelled(spark, sf)
    postings = co.exploded(analysis).select("lemma", F.concat("path", F.lit("#"), F.col("sentence").cast("string")).alias("path"))
    return gaps.missing_bridges(lab.withColumn("community", F.col("id") % 997), edges, postings, details=True)


@R.add(f"""WITH {_ALL}, {_FINE}, {gq._BRIDGES}, n5 AS (SELECT id, side, string_agg(form, ' | ' ORDER BY form) AS near FROM (SELECT *, row_number() OVER (PARTITION BY id, side ORDER BY form) AS r FROM (SELECT DISTINCT n.id, s.side, l.form FROM near n JOIN sides s ON s.id = n.id AND s.community = n.community JOIN lab l ON l.id = n.near)) WHERE r <= 5 GROUP BY id, side),
    d3 AS (SELECT id, side, string_agg(path, ' | ' ORDER BY path) AS docs FROM (SELECT *, row_number() OVER (PARTITION BY id, side ORDER BY path) AS r FROM seen) WHERE r <= 3 GROUP BY id, side)
    SELECT p.id, c.lemma, lab.form, (SELECT community FROM sides s WHERE s.id = p.id AND side = 1) AS community_a, (SELECT community FROM sides s WHERE s.id = p.id AND side = 2) AS community_b, x.near AS near_a, y.near AS near_b, u.docs AS docs_a, v.docs AS docs_b, c.betweenness * (SELECT min(n) FROM sides s WHERE s.id = p.id) AS score
    FROM per p JOIN central c USING (id) JOIN lab USING (id) JOIN n5 x ON x.id = p.id AND x.side = 1 JOIN n5 y ON y.id = p.id AND y.side = 2 JOIN d3 u ON u.id = p.id AND u.side = 1 JOIN d3 v ON v.id = p.id AND v.side = 2
    WHERE joint = 0 AND docs_a > 0 AND docs_b > 0 AND (SELECT count(*) FROM own o WHERE o.id = p.id) >= 2 ORDER BY score DESC, p.id LIMIT 15""")
def gaps_bridge(spark, sf):
    """The report's 15 missing bridges with neighbours and places of both sides; sentences stand for documents."""
    g = _fine(spark, sf)
    return g.withColumns({c: F.array_join(c, " | ") for c in ("near_a", "near_b", "docs_a", "docs_b")})


@R.add()
def gap_questions(spark, sf):
    """A question for each gap of the three kinds. Which wording is taken is tested against the rule."""
    return gaps.gap_questions(_structural(spark, sf), _isolated(spark, sf), _fine(spark, sf))


@R.add()
def corpus_gaps(spark, sf):
    """The gaps of the corpus itself, with their totals: Louvain communities, betweenness, all links that the texts hold, affinities."""
    analysis = co.stored_analysis(corpus(spark, sf))
    nodes, edges = gq._cut(spark, sf)
    labels, between = clustering.communities(nodes, edges), centrality.betweenness(nodes, edges)
    lab = materialize(nodes.join(labels, "id").join(between.select("id", "betweenness"), "id"), "labelled")
    postings = materialize(co.exploded(analysis).select("lemma", "path").distinct(), "postings")
    return gaps.gap_report(lab, edges, postings, *_alone_of(spark, sf))


@R.add(f"WITH {_ALL}, {_LABELS}, r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY betweenness DESC, frequency DESC, id) AS r FROM lab), t AS (SELECT community, list(form ORDER BY r) FILTER (r <= 16) AS f, count(*) AS n FROM r GROUP BY community) SELECT community, '{{\"tipo\":\"resumir-tema\",\"nombre\":\"' || array_to_string(f[:3], ' · ') || '\",\"terminos\":[\"' || array_to_string(f, '\",\"') || '\"],\"conceptos\":' || n || '}}' AS payload FROM t")
def topic_summary_payload(spark, sf):
    """What may be sent to have a topic summed up."""
    lab, _ = gq._labelled(spark, sf)
    size = lab.groupBy("community").agg(F.count("*").alias("nodes"))
    return ex.summary_payload(gaps.side_terms(lab, 16).join(size, "community"))


@R.add(f"WITH RECURSIVE {_GAPS} SELECT ca, cb, '{{\"tipo\":\"pregunta-puente\",\"terminosA\":[\"' || replace(terms_a, ' | ', '\",\"') || '\"],\"terminosB\":[\"' || replace(terms_b, ' | ', '\",\"') || '\"],\"distancia\":' || coalesce(distance, -1) || ',\"aristasCruzadas\":' || edges || '}}' AS payload FROM gap ORDER BY weight * ease DESC, ca, cb LIMIT 12")
def bridge_payload(spark, sf):
    """What may be sent to have a gap's question refined."""
    return ex.bridge_payload(_structural(spark, sf))


@R.add(f"WITH {_ALONE}, f14 AS (SELECT path, list(form ORDER BY rank) AS f FROM (SELECT path, form, row_number() OVER (PARTITION BY path ORDER BY n DESC, lemma) AS rank FROM (SELECT path, lemma, max_by(form, (k, -seen)) AS form, sum(k) AS n FROM f GROUP BY path, lemma)) WHERE rank <= 14 GROUP BY path), top20 AS (SELECT path, terms, words, affine FROM alone LEFT JOIN top3 USING (path) ORDER BY terms * CASE WHEN affine IS NULL THEN 1.5 ELSE 1.0 END DESC, path LIMIT 20) SELECT path, '{{\"tipo\":\"preguntas-aislado\",\"nombre\":\"' || regexp_extract(path, '(doc-[0-9]+)', 1) || '\",\"terminos\":[\"' || array_to_string(f, '\",\"') || '\"],\"palabras\":' || words || ',\"temas\":[]}}' AS payload FROM top20 JOIN f14 USING (path)")
def isolated_payload(spark, sf):
    """What may be sent to have questions for an isolated document: its name, never its path."""
    terms = co.document_terms(corpus(spark, sf), 14)
    forms = terms.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "form"))), lambda x: x["form"]).alias("terms"))
    return ex.isolated_payload(_isolated(spark, sf).select("path", "words").join(forms, "path"))


def _routes(spark, sf, nodes, edges):
    asked = nodes.where("id BETWEEN 2900 AND 2919").select(F.lit(0).cast("long").alias("start"), F.col("id").cast("long").alias("end"))
    links = edges.select(F.col("a_id").cast("long").alias("a"), F.col("b_id").cast("long").alias("b"), "weight")
    return graph.routes(links, asked)


@R.add()
def cheapest_routes(spark, sf):
    """Routes from the commonest concept to twenty rare ones; tested against Dijkstra's algorithm."""
    found = _routes(spark, sf, *gq._cut(spark, sf))
    return found.select("start", "end", F.array_join(F.transform("path", lambda x: x.cast("string")), " ").alias("path"), F.round("cost", 9).alias("cost"))


@R.add()
def reading_plan(spark, sf):
    """For each concept of these routes, the first document that the plan does not have yet."""
    analysis = co.stored_analysis(corpus(spark, sf))
    nodes, edges = gq._cut(spark, sf)
    held = co.exploded(analysis).select("lemma", F.col("path").alias("document")).distinct().join(F.broadcast(nodes.select("lemma", F.col("id").cast("long").alias("node"))), "lemma")
    return graph.reading_plans(_routes(spark, sf, nodes, edges), held.select("node", "document"))

