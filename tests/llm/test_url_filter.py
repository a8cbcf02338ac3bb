from corpusgraph.llm import url_filter

RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block")]
URLS = [
    None, "", "no scheme", "http://", "https://WWW.Example.COM/en/a?x#y", "http://example.com/en/", "http://example.com/en", "http://example.com", "http://a.b.example.com/en/x",
    "http://notexample.com/en/x", "ftp://x.net/es/1", "http://net/fr/", "http://x.NET/FR/", "http://x.org/en/://x", "a://b://c/d", "http://x.net?/es/", "http://x.net/es/#z", "http://xcom/", "http://com/", "http://ex ample.com/\n/en/", "http://x.net/es/",
]


def slow(url, rules, default="allow"):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h + p), h + p, v) for h, p, v in rules if host and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, *(max(fits)[1:] if fits else (None, default)))


def check(spark, urls, rules, **how):
    pages = spark.createDataFrame([(i, u) for i, u in enumerate(urls)] + [(0, urls[0])], "page_id long, url string").selectExpr("*", "'x' AS path", "'y' AS host", "1 AS key")
    listed = spark.createDataFrame([*rules, (None, "/", "block"), ("com", None, "block")], "host string, path string, verdict string")
    rows = url_filter.filter_urls(pages, listed, **how).collect()
    assert len(rows) == len(urls) + 1
    for r in rows:
        assert tuple(r)[1:] == slow(urls[r.page_id], rules), urls[r.page_id]


def test_rules(spark):
    check(spark, URLS, RULES)


def test_a_host_of_very_many_dots(spark):
    rules = [*RULES, ("x.example.com", "/en/deep", "block")]
    check(spark, ["http://" + "." * 60_000 + "a.example.com/en/" + "y" * 100_000, "http://" + "q." * 60_000 + "net/es/", "http://" + "x" * 200_000, "http://x.example.com/en/deeper"], rules)


def test_a_long_list_is_joined_by_shuffle(spark):
    rules = [(f"h{i}.example{i % 7}.org", "/" + "ab"[: i % 3], "block" if i % 2 else "allow") for i in range(3000)]
    urls = [f"http://{'w.' * (i % 3)}h{i}.example{i % 5}.org/abc{i}" for i in range(500)]
    check(spark, urls, rules, broadcast_entries=10)
    check(spark, urls, rules)


def test_filter_has_few_false_positives(spark):
    listed = spark.range(20_000).selectExpr("concat('k', id) AS k")
    blocks = 20_000 * 16 // 256
    table = {r.block: r.words for r in url_filter.bloom(listed, "k", blocks).collect()}
    other = spark.range(5000).selectExpr("concat('z', id) AS k")
    from pyspark.sql import functions as F

    for df, low, high in ((listed, 1, 1), (other, 0, 0.02)):
        rows = df.select(url_filter._block(F.col("k"), blocks).alias("block"), F.array(*url_filter._bits(F.col("k"))).alias("bits")).collect()
        hits = sum(all(w & b == b for w, b in zip(table.get(r.block, [0] * 8), r.bits)) for r in rows)
        assert low <= hits / len(rows) <= high


def test_empty(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert url_filter.filter_urls(pages, none).count() == 0
    assert url_filter.filter_urls(spark.createDataFrame([(1, "http://a.com/")], "page_id long, url string"), none).first().verdict == "allow"
