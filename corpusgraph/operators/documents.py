"""The document layer: links, versions, shared references, affinity, memberships."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..storage import materialize

EXTENSION = r"\.[A-Za-z0-9]{1,10}$"
# fixed values: extensions that are tried for a link without one
TRIED = (".md", ".txt", ".pdf", ".docx", ".html")
FLOOR, MAX_PAIRS, HUB, MIN_SHARED, TERMS = 0.12, 40_000, 40, 2, 12
# a word edge for ASCII letters, digits and _ only
_START, _END = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# fixed values: marks of versions in names, in the order in which they are taken out
MARKS = [
    (rf"(?iu)[ _-]*{_START}v(?:er|ers|ersion)?[ _-]?(\d{{1,3}}){_END}", None),
    (rf"(?iu)[ _-]*{_START}rev(?:isi[oó]n)?[ _-]?(\d{{1,3}}){_END}", None),
    (r"[ _-]*\((\d{1,3})\)\s*$", None),
    (rf"[ _-]*{_START}(\d{{4}})[-_.](\d{{2}})[-_.](\d{{2}}){_END}", "date"),
    (rf"(?iu)[ _-]*{_START}(copia|copy|borrador|draft){_END}", 0),
    (rf"(?iu)[ _-]*{_START}(final|definitiv[oa]){_END}", 9999),
]


def folder(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*/)?", 0)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def stem(path: Column) -> Column:
    return F.regexp_replace(base_name(path), EXTENSION, "")


def normalized(path: Column) -> Column:
    """Without ., .. and empty segments, but for an empty first one."""
    parts = F.split(F.translate(path, "\\", "/"), "/")
    step = lambda a, p: F.when(p == "..", F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0)))).when((p == ".") | (p == ""), a).otherwise(F.array_append(a, p))
    first = F.when(F.get(parts, F.lit(0)) == "", F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    return F.array_join(F.aggregate(parts, first, step), "/")


def resolve_links(links: DataFrame, paths: DataFrame) -> DataFrame:
    """links (from_path, target), paths (path) -> with resolved path and reason.

    Candidates are tried in order, by exact path and then in lower case; then
    the name without extension, if one path alone has it.
    """
    clean = F.trim(F.split_part(F.split_part(F.regexp_replace("target", "^<|>$", ""), F.lit("#"), F.lit(1)), F.lit("?"), F.lit(1)))
    l = links.withColumn("clean", F.coalesce(clean, F.lit(""))).withColumn("relative", normalized(F.concat(folder(F.col("from_path")), "clean"))).withColumn("root", normalized(F.col("clean")))
    both = [F.col("relative"), F.col("root")]
    more = F.when(F.col("clean").rlike(EXTENSION), F.array().cast("array<string>")).otherwise(F.array(*[F.concat(c, F.lit(x)) for x in TRIED for c in both]))
    tried = l.select("from_path", "target", "clean", F.posexplode(F.concat(F.array(*both), more)).alias("rank", "candidate"))
    by_path = paths.select(F.lower("path").alias("key"), "path")
    hits = tried.join(by_path, F.lower("candidate") == F.col("key")).groupBy("from_path", "target").agg(F.min_by("path", F.struct("rank", F.col("path") != F.col("candidate"), F.col("path"))).alias("by_path"))
    names = paths.groupBy(F.lower(stem(F.col("path"))).alias("name")).agg(F.count("*").alias("n"), F.min("path").alias("by_name"))
    l = l.select("from_path", "target", "clean").distinct().withColumn("name", F.lower(stem(F.col("clean"))))
    joined = l.join(hits, ["from_path", "target"], "left").join(names, "name", "left")
    reason = F.when(F.col("clean") == "", "empty").when(F.col("by_path").isNotNull(), "path").when(F.col("n") == 1, "name").when(F.col("n") > 1, "ambiguous").otherwise("no target")
    found = F.when(F.col("clean") != "", F.coalesce("by_path", F.when(F.col("n") == 1, F.col("by_name"))))
    return joined.select("from_path", "target", found.alias("resolved"), reason.alias("reason"))


def versions(paths: DataFrame) -> DataFrame:
    """path -> path, version_key, version: the largest mark's number; paths without a mark are left out."""
    rest, marks = stem(F.col("path")), []
    for pattern, kind in MARKS:
        hit = rest.rlike(pattern)
        number = F.regexp_extract(rest, pattern, 1) if kind is None else F.concat(*[F.regexp_extract(rest, pattern, i) for i in (1, 2, 3)]) if kind == "date" else F.lit(kind)
        marks.append(F.when(hit, F.expr("cast(null as long)") if number is None else number.cast("long")))
        rest = F.regexp_replace(rest, f"(?s)^(.*?){pattern}" if not pattern.startswith("(?iu)") else f"(?siu)^(.*?){pattern[5:]}", "$1 ")
    key = F.concat(folder(F.col("path")), F.lower(F.trim(F.regexp_replace(rest, "[ _-]+", " "))))
    return paths.select("path", key.alias("version_key"), F.greatest(*marks).alias("version")).where("version IS NOT NULL")


def version_chains(paths: DataFrame) -> DataFrame:
    """a, b, version_key: each version with the next."""
    w = Window.partitionBy("version_key").orderBy("version", "path")
    return versions(paths).withColumn("a", F.lag("path").over(w)).where("a IS NOT NULL").select("a", F.col("path").alias("b"), "version_key")


def bibliographic_keys(text: Column) -> Column:
    """DOIs and author-year citations of a text."""
    doi = F.transform(F.regexp_extract_all(text, F.lit(rf"{_START}(10\.\d{{4,9}}/[-._;()/:A-Za-z0-9]+)"), F.lit(1)), lambda d: F.concat(F.lit("doi:"), F.regexp_replace(F.lower(d), r"[.,;)]+$", "")))
    author, year = r"[A-ZÁÉÍÓÚÑ][a-záéíóúñü]{2,}", r"(?:19|20)\d{2}"
    cited = F.regexp_extract_all(text, F.lit(rf"{_START}((?=[A-Z]){author}(?:\s+(?:et\s+al\.?|y\s+{author}))?[,\s]+\(?{year})\)?"), F.lit(1))
    cites = F.transform(cited, lambda c: F.concat(F.lit("cita:"), F.lower(F.regexp_extract(c, f"^{author}", 0)), F.lit(":"), F.regexp_extract(c, r"\d{4}$", 0)))
    return F.array_distinct(F.concat(doi, cites))


def shared_references(keys: DataFrame, minimum: int = MIN_SHARED, hub: int = HUB) -> DataFrame:
    """path, key -> a, b, shared: keys of 2 to hub documents, so that a key gives a bounded number of pairs."""
    distinct = keys.distinct()
    useful = distinct.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n").between(2, hub)).select("key")
    k = distinct.join(useful, "key")
    pairs = k.select("key", F.col("path").alias("a")).join(k.select("key", F.col("path").alias("b")), "key").where("a < b")
    return pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= minimum)


def fused(edges: DataFrame) -> DataFrame:
    """a, b, kind, weight -> one row per unordered pair and kind: weight, times."""
    return edges.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "kind").agg(F.sum("weight").alias("weight"), F.count("*").alias("times"))


BLOCK, CHUNK = 4096, 64  # documents of a block, and of a step of its product
DENSE = 0.0067  # share of two blocks' pairs from which a term is cheaper multiplied as a column


def _blocks(terms: DataFrame, documents: int) -> DataFrame:
    """path, lemma, n -> a row for each block of documents: paths, and their unit vectors (sizes, the block's terms by hash, places among them, weights) as bytes."""
    df = terms.groupBy("lemma").agg(F.count("*").alias("df")).where((F.col("df") <= max(2, documents // 2)) & (F.col("df") < documents))
    raw = terms.where("path IS NOT NULL").join(df, "lemma")
    count = max(1, -(-documents // BLOCK))
    raw = raw.select(F.pmod(F.xxhash64("path"), F.lit(count)).alias("block"), "path", F.xxhash64("lemma").alias("k"), "df", ((1 + F.log("n")) * F.log(F.lit(float(documents)) / F.col("df"))).alias("w"))

    def packed(t: pa.Table) -> pa.Table:
        paths = t.column("path").combine_chunks().dictionary_encode()
        doc = paths.indices.to_numpy()
        k, w, df = (t.column(c).to_numpy() for c in ("k", "w", "df"))
        w = w / np.sqrt(np.bincount(doc, w * w))[doc]
        shared = df > 1  # other terms count for the length alone
        order = np.lexsort((k[shared], doc[shared]))
        doc, k, w = doc[shared][order], k[shared][order], w[shared][order]
        own, at = np.unique(k, return_inverse=True)
        sizes = np.bincount(doc, minlength=len(paths.dictionary)).astype(np.int32)
        return pa.table({"block": t.column("block")[:1], "paths": pa.array([paths.dictionary.to_pylist()], pa.list_(pa.string()))} | {c: pa.array([x.tobytes()], pa.binary()) for c, x in (("sizes", sizes), ("own", own), ("at", at.astype(np.int32)), ("w", w))})

    return raw.groupBy("block").applyInArrow(packed, "block long, paths array<string>, sizes binary, own binary, at binary, w binary")


def _products(a: dict, b: dict, same: bool, floor: float):
    """Places in two blocks of the pairs of at least floor, and their products; of one block, each pair once."""
    (na, nb), kinds = (len(a["paths"]), len(b["paths"])), {"sizes": np.int32, "own": np.int64, "at": np.int32, "w": np.float64}
    a, b = ({c: np.frombuffer(x[c], kind) for c, kind in kinds.items()} for x in (a, b))
    _, ia, ib = np.intersect1d(a["own"], b["own"], assume_unique=True, return_indices=True)
    sides = []
    for x, at in ((a, ia), (b, ib)):
        place = np.full(len(x["own"]), -1, np.int32)
        place[at] = np.arange(len(at))
        term, doc = place[x["at"]], np.repeat(np.arange(len(x["sizes"])), x["sizes"])
        met = term >= 0
        sides.append((term[met], doc[met], x["w"][met]))
    (ta, da, wa), (tb, db, wb) = sides
    ca, cb = (np.bincount(t, minlength=len(ia)) for t in (ta, tb))
    dense = np.flatnonzero(ca.astype(float) * cb > DENSE * na * nb)
    column = np.full(len(ia), -1)
    column[dense] = np.arange(len(dense))
    matrices = []
    for t, d, w, n in ((ta, da, wa, na), (tb, db, wb, nb)):
        of = column[t]
        m = np.zeros((n, len(dense)))
        m[d[of >= 0], of[of >= 0]] = w[of >= 0]
        matrices.append(m)
    rest = column[ta] < 0
    ta, da, wa = ta[rest], da[rest], wa[rest]
    order = np.argsort(tb, kind="stable")
    db, wb = db[order].astype(np.int64), wb[order]
    starts = np.cumsum(cb) - cb
    bounds = np.searchsorted(da, np.arange(0, na + CHUNK, CHUNK))
    for i, first in enumerate(range(0, na, CHUNK)):
        few = min(CHUNK, na - first)
        t, d, w = (x[bounds[i] : bounds[i + 1]] for x in (ta, da, wa))
        n = cb[t]
        ends = np.cumsum(n)
        at = np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[t] - ends + n, n)
        dots = np.bincount(db[at] + np.repeat((d - first) * np.int64(nb), n), wb[at] * np.repeat(w, n), few * nb).reshape(few, nb).astype(float, copy=False)  # of nothing, whole numbers
        if len(dense):
            dots += matrices[0][first : first + few] @ matrices[1].T
        x, y = np.nonzero(dots >= floor)
        if same:
            x, y = x[x + first < y], y[x + first < y]
        yield x + first, y, dots[x, y]


def affinity(terms: DataFrame, documents: int, floor: float = FLOOR, max_pairs: int | None = MAX_PAIRS) -> DataFrame:
    """a, b, cosine of at least floor.

    Documents lie in blocks, and each pair of blocks is one product of sparse
    matrices. Blocks are written once and read by the pairs, so that nothing
    grows with the square of the documents but the work. A task holds two blocks.
    """
    blocks = materialize(_blocks(terms, documents), "blocks")
    columns = ["block", "paths", "sizes", "own", "at", "w"]
    left, right = (blocks.select(*[F.col(c).alias(f"{c}_{x}") for c in columns]) for x in "ab")
    both = left.hint("shuffle_replicate_nl").join(right, F.col("block_a") <= F.col("block_b"))

    def pairs(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = ({c: batch.column(f"{c}_{x}")[k].as_py() for c in columns} for x in "ab")
                names = a["paths"] + b["paths"]
                rank = np.empty(len(names), np.int64)
                rank[np.array(sorted(range(len(names)), key=names.__getitem__), np.int64)] = np.arange(len(names))
                names, na = pa.array(names, pa.string()), len(a["paths"])
                for x, y, dot in _products(a, b, a["block"] == b["block"], floor):
                    y = y + na if a["block"] != b["block"] else y
                    swap = rank[x] > rank[y]
                    yield pa.RecordBatch.from_arrays([names.take(pa.array(np.where(swap, y, x))), names.take(pa.array(np.where(swap, x, y))), pa.array(dot)], ["a", "b", "cosine"])

    found = both.mapInArrow(pairs, "a string, b string, cosine double")
    return found if max_pairs is None else found.orderBy(F.desc("cosine"), "a", "b").limit(max_pairs)


def memberships(terms: DataFrame, concepts: DataFrame, top: int = TERMS) -> DataFrame:
    """Ranked terms (path, lemma, n, rank) and kept concepts (lemma, id) -> path, concept, weight."""
    return terms.where(F.col("rank") <= top).join(concepts.select("lemma", F.col("id").alias("concept")), "lemma").select("path", "concept", F.col("n").alias("weight"))


def path_memberships(rows: DataFrame, concepts: DataFrame, top: int = TERMS) -> DataFrame:
    """As memberships, for documents without terms: the first terms of their paths (path, pos, lemma), with a weight of one."""
    kept = rows.where(F.col("pos") < top).join(concepts.select("lemma", F.col("id").alias("concept")), "lemma")
    return kept.select("path", "concept", F.lit(1).cast("long").alias("weight"))


def orphans(paths: DataFrame, members: DataFrame) -> DataFrame:
    return paths.select("path").join(members.select("path").distinct(), "path", "left_anti")
