"""Graph algorithms over graphs of any size.

Sums and degrees are groupings; distances, components and routes are joins in
rounds, each written to the shared folder. Communities are in ``clustering``,
betweenness in ``centrality``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize
from .lookup import both_ways



def degrees(edges: DataFrame) -> DataFrame:
    """node, degree, strength."""
    return both_ways(edges).groupBy(F.col("src").alias("node")).agg(F.count("*").alias("degree"), F.sum("weight").alias("strength"))


def modularity(edges: DataFrame, labels: DataFrame) -> DataFrame:
    """edges (a, b, weight), labels (node, community) -> one row: modularity."""
    e = edges.join(labels.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(labels.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b")
    ends = e.select(F.col("ca").alias("c"), "weight", F.when(F.col("ca") == F.col("cb"), F.col("weight")).otherwise(0.0).alias("inner")).unionByName(e.select(F.col("cb").alias("c"), "weight", F.lit(0.0).alias("inner")))
    per = ends.groupBy("c").agg(F.sum("weight").alias("total"), F.sum("inner").alias("inner"))
    m = F.sum("total").alias("two_m")
    sums = per.agg(m, F.sum("inner").alias("inner"), F.sum(F.col("total") * F.col("total")).alias("squares"))
    return sums.select((2 * F.col("inner") / F.col("two_m") - F.col("squares") / (F.col("two_m") * F.col("two_m"))).alias("modularity"))


def diversity(q):
    return F.when(q < 0.2, "focused").when(q < 0.4, "medium").when(q < 0.6, "diverse").otherwise("scattered")


def distances(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """edges (a, b), sources (source) -> source, node, hops for all nodes that each source reaches; a join per hop, until none finds a new node."""
    w = materialize(both_ways(edges).select("src", "dst").distinct(), "both-ways")
    seen = front = materialize(sources.select("source", F.col("source").alias("node"), F.lit(0).alias("hops")).distinct(), "hops")
    step = 0
    while True:
        step += 1
        found = front.join(w, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        front = materialize(found.join(seen.select("source", "node"), ["source", "node"], "left_anti").withColumn("hops", F.lit(step)), "hops")
        if front.isEmpty():
            return seen
        seen = seen.unionByName(front)


def hops(edges: DataFrame, source) -> DataFrame:
    """edges (a, b) -> node, hops from one source."""
    one = edges.sparkSession.createDataFrame([(source,)], f"source {dict(edges.dtypes)['a']}")
    return distances(edges, one).select("node", "hops")


def components(edges: DataFrame) -> DataFrame:
    """edges (a, b) -> node, component: the smallest node reachable, for every node with a link; large and small stars in turn (Kiveris et al. 2014)."""
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    own = Window.partitionBy("u")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.withColumn("low", F.least(F.min("v").over(own), F.col("u"))).where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v")).where("u <> v")
        star = large.withColumn("low", F.min("v").over(own))
        links = star.select(F.explode(F.array(F.struct("u", F.col("low").alias("v")), F.struct(F.col("v").alias("u"), F.col("low").alias("v")))).alias("e")).select("e.*")
        e = materialize(links.where("u <> v").distinct(), "stars")
        roles = e.select(F.col("u").alias("node"), F.lit(1).alias("child"), F.lit(0).alias("parent")).unionByName(e.select(F.col("v").alias("node"), F.lit(0).alias("child"), F.lit(1).alias("parent")))
        crooked = roles.groupBy("node").agg(F.sum("child").alias("child"), F.max("parent").alias("parent")).where("child > 1 OR (child > 0 AND parent > 0)")
        if crooked.isEmpty():  # every link leads from a node with no other to the middle of its star
            return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def component_table(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes (id), edges (a_id, b_id) -> id, component: that of a node without edges is itself."""
    found = components(edges.select(F.col("a_id").cast("long").alias("a"), F.col("b_id").cast("long").alias("b")))
    ids = nodes.select(F.col("id").cast("long").alias("id"))
    return ids.join(found.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("component"))


def routes(edges: DataFrame, asked: DataFrame, visible: DataFrame | None = None) -> DataFrame:
    """Cheapest routes: edges (a, b, weight), asked (start, end) -> start, end, path, cost; path and cost are null where there is no route.

    An edge costs 1 / max(0.01, weight). Rounds of relaxation keep, for each
    start and node, the cheapest route found (ties: the smallest path), and end
    when no route gets cheaper. Routes dearer than one known to the end are
    dropped where every route asked of a start has its end.
    """
    w = both_ways(edges).select("src", "dst", (1 / F.greatest(F.col("weight").cast("double"), F.lit(0.01))).alias("c")).groupBy("src", "dst").agg(F.min("c").alias("c"))
    if visible is not None:
        keep = visible.select("node").distinct()
        w = w.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")
    w = materialize(w, "steps")
    best = front = materialize(asked.select("start", F.col("start").alias("node"), F.array("start").alias("path"), F.lit(0.0).alias("cost")).distinct(), "routes")
    ends = asked.select("start", "end").distinct()
    order = F.struct("cost", "path")
    while True:
        step = front.join(w, F.col("node") == F.col("src")).where(~F.array_contains("path", F.col("dst")))
        step = step.select("start", F.col("dst").alias("node"), F.array_append("path", F.col("dst")).alias("path"), (F.col("cost") + F.col("c")).alias("cost"))
        limit = ends.join(best, (ends["end"] == best["node"]) & (ends["start"] == best["start"]), "left").groupBy(ends["start"]).agg(F.max("cost").alias("dearest"), F.count_if(F.col("cost").isNull()).alias("open"))
        step = step.join(limit, "start").where("open > 0 OR cost <= dearest").drop("open", "dearest")
        cheapest = step.groupBy("start", "node").agg(F.min(order).alias("new")).join(best.select("start", "node", order.alias("old")), ["start", "node"], "left")
        front = materialize(cheapest.where("old IS NULL OR new < old").select("start", "node", "new.path", "new.cost"), "routes")
        if front.isEmpty():
            break
        best = materialize(best.unionByName(front).groupBy("start", "node").agg(F.min(order).alias("o")).select("start", "node", "o.path", "o.cost"), "routes")
    return ends.join(best.withColumnRenamed("node", "end"), ["start", "end"], "left")


def reading_plans(found: DataFrame, postings: DataFrame) -> DataFrame:
    """routes (start, end, path), postings (node, document) -> a row per node of a route: place, document (the first by name not yet used), covered (one that is used holds it), none.

    The fold over a route runs inside its row: a route is as long as its nodes, each with its documents.
    """
    longest = found.agg(F.max(F.size("path")).alias("n")).first()["n"] or 0
    on_route = found.where("path IS NOT NULL").select(F.explode("path").alias("node")).distinct()
    # a route uses at most as many documents as it has nodes, so each node's first ones are enough
    firsts = postings.join(on_route, "node", "left_semi").select("node", "document").distinct()
    firsts = firsts.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("document"))).where(F.col("r") <= max(1, longest))
    held = firsts.groupBy("node").agg(F.array_sort(F.collect_list("document")).alias("documents"))
    nodes = found.where("path IS NOT NULL").select("start", "end", F.posexplode("path").alias("place", "node")).join(held, "node", "left")
    rows = nodes.groupBy("start", "end").agg(F.array_sort(F.collect_list(F.struct("place", "node", F.coalesce("documents", F.array().cast("array<string>")).alias("documents")))).alias("nodes"))
    none = F.array().cast("array<struct<place: int, node: string, document: string, covered: boolean, none: boolean>>")

    def use(state, x):
        new = F.get(F.array_except(x["documents"], state["used"]), F.lit(0))
        row = F.struct(x["place"].cast("int").alias("place"), x["node"].cast("string").alias("node"), new.alias("document"), (new.isNull() & (F.size(x["documents"]) > 0)).alias("covered"), (F.size(x["documents"]) == 0).alias("none"))
        return F.struct(F.when(new.isNull(), state["used"]).otherwise(F.array_append(state["used"], new)).alias("used"), F.array_append(state["rows"], row).alias("rows"))

    start = F.struct(F.array().cast("array<string>").alias("used"), none.alias("rows"))
    return rows.select("start", "end", F.explode(F.aggregate("nodes", start, use)["rows"]).alias("x")).select("start", "end", "x.*")
