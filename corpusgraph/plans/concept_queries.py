"""Queries over text functions and the concept layer."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import stopwords
from ..functions import text as tx
from ..operators import concepts as co
from ..storage import materialize, spread
from .sql_text import CUT, NODES, PAIRS, PATH, STOP, TOKENS, in_list, language, lemma_en, lemma_es, lemma_mixed, sentences, term_key
from .tables import Registry, corpus, read

R = Registry()
QUERIES, ORACLES = R.queries, R.oracles

_KEYS = rf"k AS (SELECT DISTINCT {term_key('w')} AS key FROM (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS w FROM documents))"


def _tokens(spark, sf):
    return co.token_rows(corpus(spark, sf))


def _distinct_keys(spark, sf):
    words = spread(read(spark, sf, "documents").select("text")).select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w")).distinct()
    return words.select(tx.term_key(F.col("w")).alias("key")).distinct()


@R.add(rf"SELECT {term_key('w')} AS key, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '[\p{{L}}\p{{N}}]+')) AS w FROM documents) GROUP BY 1")
def term_keys(spark, sf):
    words = spread(read(spark, sf, "documents").select("text")).select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}]+"), F.lit(0))).alias("w"))
    return words.groupBy("w").agg(F.count("*").alias("n")).groupBy(tx.term_key(F.col("w")).alias("key")).agg(F.sum("n").alias("n"))


@R.add(f"SELECT doc_id, len(s) AS sentences, len(list_distinct(s)) AS different, list_sum(list_transform(s, lambda x: length(x)))::BIGINT AS chars FROM (SELECT doc_id, {sentences('text')} AS s FROM documents)")
def sentence_counts(spark, sf):
    s = spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", tx.sentences(F.col("text")).alias("s"))
    chars = F.when(F.size("s") > 0, F.aggregate("s", F.lit(0).cast("long"), lambda a, x: a + F.length(x)))
    return s.select("doc_id", F.size("s").alias("sentences"), F.size(F.array_distinct("s")).alias("different"), chars.alias("chars"))


@R.add(f"SELECT doc_id, {language('text')} AS language FROM documents")
def language_detect(spark, sf):
    return spread(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id", tx.language(F.col("text")).alias("language"))


@R.add(f"WITH {_KEYS} SELECT key, {lemma_es('key')} AS lemma FROM k")
def lemma_spanish(spark, sf):
    return _distinct_keys(spark, sf).select("key", tx.lemma_es(F.col("key")).alias("lemma"))


@R.add(f"WITH {_KEYS} SELECT key, {lemma_en('key')} AS lemma FROM k")
def lemma_english(spark, sf):
    return _distinct_keys(spark, sf).select("key", tx.lemma_en(F.col("key")).alias("lemma"))


@R.add(f"WITH {_KEYS} SELECT key, {lemma_mixed('key')} AS lemma FROM k")
def lemma_other(spark, sf):
    return _distinct_keys(spark, sf).select("key", tx.lemma_mixed(F.col("key")).alias("lemma"))


@R.add(f"WITH {TOKENS} SELECT path, any_value(detected) AS language, count(*) AS tokens, count(DISTINCT lemma) AS lemmas, max(sentence)::BIGINT AS last_sentence FROM tok GROUP BY path")
def token_stream_stats(spark, sf):
    per = _tokens(spark, sf).groupBy("path", "detected", "lemma").agg(F.count("*").alias("n"), F.max("sentence").alias("last"))
    return per.groupBy("path", F.col("detected").alias("language")).agg(F.sum("n").alias("tokens"), F.count("*").alias("lemmas"), F.max("last").cast("long").alias("last_sentence"))


_TERMS = """
    f AS (SELECT path, lemma, form, count(*) AS k, min(pos) AS seen FROM tok GROUP BY ALL),
    t AS (SELECT path, lemma, max_by(form, (k, -seen)) AS form, sum(k)::BIGINT AS n FROM f GROUP BY path, lemma),
    term AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY n DESC, lemma) AS rank FROM t)"""


@R.add(f"WITH {TOKENS}, {_TERMS} SELECT path, lemma, form, n, rank FROM term WHERE rank <= 400")
def term_freq_top(spark, sf):
    return co.document_terms(corpus(spark, sf), co.TOP_TERMS)


@R.add(rf"""WITH p AS (SELECT DISTINCT url FROM pages), x AS (SELECT url, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(url, '[/\\]', ' ', 'g'), '\.[A-Za-z0-9]{{1,5}}$', ' '), '[_\-.]+', ' ', 'g'), '([a-z])([A-Z])', '\1 \2', 'g'), '[\p{{L}}\p{{N}}]{{3,}}')) AS w FROM p),
    y AS (SELECT url, {term_key('w')} AS term FROM x) SELECT url, term, count(*) AS n FROM y WHERE length(term) >= 3 AND NOT regexp_matches(term, '^\d+$') AND term NOT IN {STOP} GROUP BY ALL""")
def path_terms(spark, sf):
    urls = read(spark, sf, "pages").select("url").distinct()
    return urls.select("url", F.explode_outer(tx.path_terms(F.col("url"))).alias("term")).where("term IS NOT NULL").groupBy("url", "term").agg(F.count("*").alias("n"))


@R.add(rf"WITH {TOKENS} SELECT key AS word, count(*) AS n FROM y WHERE key IN {STOP} GROUP BY key")
def stopword_hits(spark, sf):
    words = spread(corpus(spark, sf).select("text")).select(F.explode_outer(tx.sentences(F.col("text"))).alias("s")).select(F.explode_outer(F.regexp_extract_all("s", F.lit(tx.WORD), F.lit(0))).alias("w"))
    return words.select(tx.term_key(F.col("w")).alias("word")).where(F.col("word").isin(sorted(stopwords.BASE))).groupBy("word").agg(F.count("*").alias("n"))


@R.add(f"WITH {TOKENS}, {NODES} SELECT lemma, form, frequency, docs FROM node")
def concept_nodes(spark, sf):
    return co.document_nodes(corpus(spark, sf))


@R.add(f"WITH {TOKENS}, {NODES}, {PAIRS}, {CUT} SELECT lemma, form, frequency, docs, id FROM kept")
def concept_nodes_cut(spark, sf):
    return co.cut_nodes(co.document_nodes(corpus(spark, sf)))


@R.add(f"WITH {TOKENS}, {NODES}, {PAIRS}, {CUT} SELECT a, b, weight, docs FROM cut ORDER BY tenths DESC, a, b LIMIT 50")
def concept_edges_top(spark, sf):
    """The report's strongest 50 edges."""
    _, edges = co.document_cut(corpus(spark, sf))
    return edges.orderBy(F.desc("tenths"), "a", "b").limit(50).select("a", "b", "weight", "docs")


@R.add(f"WITH {TOKENS}, {PAIRS} SELECT a, b, tenths, docs FROM edge")
def concept_edges(spark, sf):
    return co.document_edges(corpus(spark, sf))


@R.add(f"WITH {TOKENS}, {PAIRS}, q AS (SELECT DISTINCT a, b, path, sentence FROM pair), r AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY path, sentence) AS sample FROM q) SELECT a, b, path, sentence, sample FROM r WHERE sample <= 3")
def edge_samples(spark, sf):
    return co.document_samples(corpus(spark, sf))


@R.add(f"""WITH p AS (SELECT DISTINCT url AS path FROM pages), t AS (SELECT path, unnest(regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(regexp_replace(path, '[/\\\\]', ' ', 'g'), '\\.[A-Za-z0-9]{{1,5}}$', ' '), '[_\\-.]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '[\\p{{L}}\\p{{N}}]{{3,}}')) AS w FROM p),
    k AS (SELECT DISTINCT path, {term_key('w')} AS t FROM t), g AS (SELECT * FROM k WHERE length(t) >= 3 AND NOT regexp_matches(t, '^\\d+$') AND t NOT IN {STOP})
    SELECT x.t AS a, y.t AS b, count(*) * 0.4 AS weight, count(*) AS docs FROM g x JOIN g y ON x.path = y.path AND x.t < y.t GROUP BY ALL""")
def path_clique_edges(spark, sf):
    pairs = co.path_cliques(read(spark, sf, "pages").select(F.col("url").alias("path")).distinct())
    return co.concept_edges(pairs).select("a", "b", (F.col("tenths") / 10).alias("weight"), "docs")


@R.add(f"""WITH {TOKENS}, {NODES}, {PAIRS}, {CUT} SELECT (SELECT count(*) FROM node) AS concepts, (SELECT count(*) FROM kept) AS kept_concepts, (SELECT count(*) FROM node WHERE frequency < 2) AS rare,
    (SELECT count(*) FROM edge) AS edges, (SELECT count(*) FROM cut) AS kept_edges, (SELECT count(*) FROM edge WHERE tenths < 10) AS light""")
def cut_totals(spark, sf):
    docs = corpus(spark, sf)
    nodes = materialize(co.document_nodes(docs), "nodes")
    edges = materialize(co.document_edges(docs), "edges")
    kept = materialize(co.cut_nodes(nodes), "kept")
    n = nodes.agg(F.count("*").alias("concepts"), F.count_if(F.col("frequency") < 2).alias("rare"))
    e = edges.agg(F.count("*").alias("edges"), F.count_if(F.col("tenths") < 10).alias("light"))
    k, c = kept.agg(F.count("*").alias("kept_concepts")), co.cut_edges(edges, kept).agg(F.count("*").alias("kept_edges"))
    one = F.lit(1)
    return n.withColumn("_", one).join(e.withColumn("_", one), "_").join(k.withColumn("_", one), "_").join(c.withColumn("_", one), "_").drop("_")


@R.add(f"WITH {TOKENS}, {_TERMS} SELECT lemma, count(*) AS doc_count FROM term WHERE rank <= 400 GROUP BY lemma")
def vocabulary(spark, sf):
    return co.vocabulary(co.document_terms(corpus(spark, sf), co.TOP_TERMS))


@R.add(f"WITH {TOKENS}, v AS (SELECT DISTINCT path, lemma FROM tok) SELECT lemma, count(*) AS doc_count FROM v GROUP BY lemma ORDER BY doc_count DESC, lemma LIMIT 200")
def vocabulary_top(spark, sf):
    """The report's 200 commonest concepts."""
    return co.vocabulary(_tokens(spark, sf)).orderBy(F.desc("doc_count"), "lemma").limit(200)


_STEPS = "vv AS (SELECT DISTINCT path, lemma FROM tok), o AS (SELECT lemma, count(*) AS n FROM vv WHERE path NOT LIKE '%7.txt' GROUP BY lemma), nw AS (SELECT lemma, count(*) AS n FROM vv WHERE path NOT LIKE '%3.txt' GROUP BY lemma)"


@R.add(f"WITH {TOKENS}, {_STEPS} SELECT lemma, n AS doc_count FROM nw")
def vocabulary_incremental(spark, sf):
    """Counts of an older state, with the documents that went and came since."""
    v = materialize(_tokens(spark, sf).select("path", "lemma").distinct(), "vocabulary")
    old = co.vocabulary(v.where(~F.col("path").endswith("7.txt")))
    return co.vocabulary_update(old, v.where(F.col("path").endswith("3.txt")), v.where(F.col("path").endswith("7.txt")))


@R.add(f"WITH {TOKENS}, {_STEPS} SELECT coalesce(o.lemma, nw.lemma) AS lemma, CASE WHEN o.n IS NULL THEN 'new' WHEN nw.n IS NULL THEN 'gone' ELSE 'grown' END AS change, coalesce(nw.n, 0) - coalesce(o.n, 0) AS delta FROM o FULL JOIN nw ON o.lemma = nw.lemma WHERE o.n IS NULL OR nw.n IS NULL OR nw.n - o.n >= 2")
def vocabulary_delta(spark, sf):
    v = _tokens(spark, sf)
    o = co.vocabulary(v.where(~F.col("path").endswith("7.txt"))).withColumnRenamed("doc_count", "o")
    w = co.vocabulary(v.where(~F.col("path").endswith("3.txt"))).withColumnRenamed("doc_count", "w")
    both = o.join(w, "lemma", "full_outer")
    change = F.when(F.col("o").isNull(), "new").when(F.col("w").isNull(), "gone").otherwise("grown")
    delta = F.coalesce("w", F.lit(0)) - F.coalesce("o", F.lit(0))
    return both.where("o IS NULL OR w IS NULL OR w - o >= 2").select("lemma", change.alias("change"), delta.alias("delta"))
