"""Quality classifier: perplexity under an interpolated modified Kneser-Ney model.

Trigram models are trained on all trusted documents and stay in shards
(``ngram_shards``). A document is kept if its perplexity lies between two thresholds
of its language. The upper one is a quantile of all trusted documents of the
language, each scored by the half of them that it is not in, so that the threshold
rests on no document's own counts; the lower one is the least of all trusted
documents under the model of all, as copies of these score low and are not bad. Both
have a tolerance, which is wider for short texts, whose mean varies more: without
it, one in a hundred trusted documents would go.

``train`` and ``log_probabilities`` are the same model for a collection whose
tables one process may hold.

Cases: null and empty texts consist of the end alone; a null label is not
trusted; a language without trusted documents takes the threshold of all
languages, and with no trusted document at all nothing is rejected; repeated
rows are scored each; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, materialize
from .ngram_shards import END, START, discounts, perplexities, word_hashes

QUANTILE, TOLERANCE, SEED = 0.99, 1.25, 11
TURN = 1000  # ids in whose order halves take turns
FEW = 1_000_000  # rows that may be broadcast
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_OWN = "__quality_"  # names of columns beside those of the caller


def _key(*parts: np.ndarray) -> np.ndarray:
    """One 64-bit key of an n-gram of word hashes."""
    key = parts[0] ^ np.uint64(len(parts))
    for p in parts[1:]:
        key = (key ^ (key >> np.uint64(29))) * _MULTIPLIER + p
    return key


def _trigrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        parts = []
        for text in as_bytes(b.column(0)):
            h = word_hashes(text.split())
            line = np.concatenate([np.array([START, START], np.uint64), h, np.array([END], np.uint64)])
            parts.append(np.stack([line[:-2], line[1:-1], line[2:]]))
        if parts:
            rows = np.concatenate(parts, axis=1).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(r) for r in rows], names=["u", "v", "w"])


def _discounts(counts: DataFrame) -> list[float]:
    """Modified Kneser-Ney's three discounts from the numbers of n-grams seen one to four times."""
    n = counts.agg(*[F.count_if(F.col("n") == k).alias(f"n{k}") for k in (1, 2, 3, 4)]).first()
    return discounts(*[float(x) for x in n])


def _discount(n: Column, d: list[float]) -> Column:
    return F.when(n == 1, d[0]).when(n == 2, d[1]).otherwise(d[2])


def _interpolated(counts: DataFrame, context: list[str], lower: DataFrame | None, lower_key: list[str], uniform: float | None = None) -> tuple[DataFrame, DataFrame]:
    """counts (context..., w, n) -> the same with p, and each context's mass for the lower order."""
    d = _discounts(counts)
    cut = _discount(F.col("n"), d)
    held = counts.groupBy(*context).agg(F.sum("n").alias("all_n"), F.sum(cut).alias("cut_n"))
    masses = held.select(*context, "all_n", (F.col("cut_n") / F.col("all_n")).alias("mass"))
    if context:
        joined = counts.join(masses, context)
    else:
        whole = masses.first()
        joined = counts.withColumn("all_n", F.lit(whole["all_n"])).withColumn("mass", F.lit(whole["mass"]))
    joined = joined.join(lower.withColumnRenamed("p", "lower_p"), lower_key) if lower is not None else joined.withColumn("lower_p", F.lit(uniform))
    p = (F.col("n") - cut) / F.col("all_n") + F.col("mass") * F.col("lower_p")
    return joined.select(*context, "w", p.alias("p")), masses.select(*context, "mass")


def train(texts: DataFrame) -> dict[str, np.ndarray]:
    """One text column -> the model's tables: sorted keys, log10 probabilities and masses per order."""
    grams = materialize(texts.mapInArrow(_trigrams, "u long, v long, w long").groupBy("u", "v", "w").agg(F.count("*").alias("n")), "trigrams")
    second = materialize(grams.groupBy("v", "w").agg(F.count("*").alias("n")), "bigrams")
    first = materialize(second.groupBy("w").agg(F.count("*").alias("n")), "unigrams")
    words = first.count()
    uniform = 1.0 / (words + 1)
    p1, mass1 = _interpolated(first, [], None, [], uniform)
    p1 = materialize(p1, "p1")
    p2, mass2 = _interpolated(second, ["v"], p1, ["w"])
    p2 = materialize(p2, "p2")
    p3, mass3 = _interpolated(grams, ["u", "v"], p2, ["v", "w"])

    def gathered(df: DataFrame, keys: list[str], value: str) -> tuple[np.ndarray, np.ndarray]:
        t = df.select(*keys, F.log10(value).cast("float").alias("x")).toArrow()
        key = _key(*(t.column(k).to_numpy().view(np.uint64) for k in keys))
        order = np.argsort(key)
        return key[order], t.column("x").to_numpy()[order]

    model = {}
    for name, df, keys, value in (("p1", p1, ["w"], "p"), ("p2", p2, ["v", "w"], "p"), ("p3", p3, ["u", "v", "w"], "p"), ("m2", mass2, ["v"], "mass"), ("m3", mass3, ["u", "v"], "mass")):
        model[f"{name}_key"], model[name] = gathered(df, keys, value)
    whole = mass1.first()
    model["unknown"] = np.log10(np.float64((whole["mass"] if whole and whole["mass"] is not None else 1.0) * uniform))
    return model


def _find(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return np.zeros(len(wanted), bool), np.zeros(len(wanted))
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    hit = keys[at] == wanted
    return hit, np.where(hit, values[at], 0.0)


def log_probabilities(model: dict[str, np.ndarray], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each text: the number of words, and the log10 probability of its words and its end."""
    words = [t.split() for t in texts]
    sizes = np.array([len(x) for x in words], dtype=np.int64)
    flat = word_hashes([y for x in words for y in x])
    ends = np.cumsum(sizes + 3)
    starts = ends - sizes - 3
    line = np.full(int(ends[-1]) if len(ends) else 0, START, dtype=np.uint64)
    inside = np.ones(len(line), bool)
    inside[starts] = inside[starts + 1] = inside[ends - 1] = False
    line[inside] = flat
    line[ends - 1] = END
    scored = np.ones(len(line), bool)
    scored[starts] = scored[starts + 1] = False
    at = np.flatnonzero(scored)
    u, v, w = line[at - 2], line[at - 1], line[at]
    hit1, p = _find(model["p1_key"], model["p1"], _key(w))
    p = np.where(hit1, p, model["unknown"])
    hit2, p2 = _find(model["p2_key"], model["p2"], _key(v, w))
    p = np.where(hit2, p2, p + _find(model["m2_key"], model["m2"], _key(v))[1])
    seen, mass = _find(model["m3_key"], model["m3"], _key(u, v))
    p += mass
    try_at = np.flatnonzero(seen & hit2)
    hit3, p3 = _find(model["p3_key"], model["p3"], _key(u[try_at], v[try_at], w[try_at]))
    p[try_at[hit3]] = p3[hit3]
    return sizes, np.add.reduceat(p, np.cumsum(sizes + 1) - sizes - 1) if len(sizes) else p


def halves(ids: DataFrame, id_column: str, lang_column: str, seed: int = SEED) -> DataFrame:
    """Distinct ids with languages -> id, fold: by turns 0 and 1 in seeded order within about ``TURN`` ids of a language, so that few documents of one are halved too."""
    drawn = F.xxhash64(F.lit(seed), F.col(id_column))
    groups = ids.groupBy(lang_column).agg(F.ceil(F.count("*") / TURN).cast("long").alias("groups"))
    turn = F.row_number().over(Window.partitionBy(lang_column, "group").orderBy(drawn, id_column)) % 2
    dealt = ids.join(groups, lang_column).withColumn("group", F.pmod(F.xxhash64(F.lit(seed + 1), F.col(id_column)), F.col("groups"))).withColumn("fold", turn)
    return dealt.groupBy(id_column).agg(F.max("fold").alias("fold"))


def _judged(docs: DataFrame, trusted: DataFrame, id_column: str, text_column: str, lang_column: str, train_docs: int | None, quantile: float, tolerance: float, seed: int) -> DataFrame:
    """A row per row of docs, in order: own columns uid, id, raw (the language), n (words), lp (log10 probability), ppl, cut and kept."""
    n, lp, lang, step, least = (f"{_OWN}{x}" for x in ("n", "lp", "lang", "step", "least"))
    sure = trusted.select(F.col(id_column).alias(f"{_OWN}id")).distinct()
    lang_key = F.coalesce(F.col(lang_column).cast("string"), F.lit(""))
    known = docs.select(F.col(id_column).alias(f"{_OWN}id"), F.col(lang_column).alias(f"{_OWN}raw"), lang_key.alias(lang), F.col(text_column).alias("text"), _row_key(id_column, lang_column, text_column).alias("uid"))
    rows = materialize(known.drop("text").withColumn(f"{_OWN}row", F.monotonically_increasing_id()), "rows")
    labelled = materialize(rows.select(f"{_OWN}id", lang).join(sure, f"{_OWN}id", "left_semi").distinct(), "trusted")
    drawn = labelled
    if train_docs is not None:  # a caller's bound: each half then trains on about so many documents of a language
        share = F.ceil(2_000_000 * train_docs / F.col("n"))
        quota = labelled.groupBy(lang).agg(F.count("*").alias("n")).select(lang, share.alias("quota"))
        draw = F.pmod(F.xxhash64(F.lit(seed + 2), F.col(f"{_OWN}id")), F.lit(1_000_000))
        drawn = labelled.join(quota, lang).where(draw < F.col("quota")).select(*labelled.columns)
    folds = materialize(halves(drawn, f"{_OWN}id", lang, seed), "folds")
    scored = perplexities(known.select(f"{_OWN}id", "uid", "text").join(_placed(folds), f"{_OWN}id", "left").select("uid", "fold", "text"))
    many = rows.groupBy("uid").agg(F.count("*").alias("many"))  # equal rows have one score
    one = scored.join(many, "uid").select("uid", (F.col("n") / F.col("many")).cast("long").alias("all"), (F.col("lp") / F.col("many")).alias(lp), (F.col("crossed") / F.col("many")).alias(f"{_OWN}crossed"))
    scores = rows.join(one, "uid").withColumn(n, F.col("all") - 1).drop("all")
    scores = materialize(scores.join(labelled.select(f"{_OWN}id").distinct().select(f"{_OWN}id", F.lit(True).alias(f"{_OWN}trusted")), f"{_OWN}id", "left"), "perplexities")
    level = -F.col(lp) / (F.col(n) + 1)
    # exact counts of the levels of all trusted documents under the halves that lack them, in steps of a thousandth
    sure = scores.where(f"{_OWN}trusted").select(lang, F.ceil(-F.col(f"{_OWN}crossed") / (F.col(n) + 1) * 1000).alias(step), F.ceil(level * 1000).alias(least))
    steps = materialize(sure.groupBy(lang, step).agg(F.count("*").alias("c"), F.min(least).alias(least)), "levels")
    steps = steps.unionByName(steps.groupBy(step).agg(F.sum("c").alias("c"), F.min(least).alias(least)).withColumn(lang, F.lit(None).cast("string")))
    up, whole = Window.partitionBy(lang).orderBy(step), Window.partitionBy(lang)
    counted = steps.withColumn("before", F.sum("c").over(up)).withColumn("all", F.sum("c").over(whole))
    high = F.col("before") >= quantile * F.col("all")
    cuts = counted.groupBy(lang).agg(F.min(F.when(high, F.col(step))).alias(step), F.min(least).alias(least))
    cuts = materialize(cuts, "thresholds")
    everywhere = cuts.where(F.col(lang).isNull()).first()
    joined = scores.join(_placed(cuts.where(F.col(lang).isNotNull())), lang, "left")
    or_all = lambda c: F.coalesce(c, F.lit(everywhere[c] if everywhere else None).cast("long")) / 1000
    wide = 1 / F.sqrt(F.col(n) + 1)
    high, low = F.pow(F.lit(10.0), or_all(step) + wide) * F.lit(tolerance), F.pow(F.lit(10.0), or_all(least) - wide) / F.lit(tolerance)
    ppl = F.pow(F.lit(10.0), level)
    kept = F.coalesce((F.col(f"{_OWN}ppl") <= F.col(f"{_OWN}cut")) & (F.col(f"{_OWN}ppl") >= F.col(f"{_OWN}floor")), F.lit(True))
    return joined.withColumns({f"{_OWN}ppl": ppl, f"{_OWN}cut": high, f"{_OWN}floor": low}).withColumn(f"{_OWN}kept", kept).orderBy(f"{_OWN}row")


def _row_key(*columns: str) -> Column:
    """A 64-bit key of a row's values; equal rows have one score."""
    return F.xxhash64(*[x for c in columns for x in (F.col(c).isNull(), F.col(c))])


def _placed(few: DataFrame) -> DataFrame:
    """Broadcast while it is few rows, joined by shuffle beyond."""
    return F.broadcast(few) if few.count() <= FEW else few


def classify(docs: DataFrame, trusted: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", train_docs: int | None = None, quantile: float = QUANTILE, tolerance: float = TOLERANCE, seed: int = SEED) -> DataFrame:
    """Scores every row of docs; trusted holds the ids of trusted documents.

    A row per document: id, language, n_tokens, log10_prob, perplexity, threshold, least_perplexity, kept.
    """
    found = _judged(docs, trusted, id_column, text_column, lang_column, train_docs, quantile, tolerance, seed)
    names = {"n": "n_tokens", "lp": "log10_prob", "ppl": "perplexity", "cut": "threshold", "floor": "least_perplexity", "kept": "kept"}
    return found.select(F.col(f"{_OWN}id").alias(id_column), F.col(f"{_OWN}raw").alias(lang_column), *[F.col(f"{_OWN}{k}").alias(v) for k, v in names.items()])


def accepted(docs: DataFrame, trusted: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang", train_docs: int | None = None, quantile: float = QUANTILE, tolerance: float = TOLERANCE, seed: int = SEED) -> DataFrame:
    """The rows of docs that the classifier keeps, with their own columns."""
    found = _judged(docs, trusted, id_column, text_column, lang_column, train_docs, quantile, tolerance, seed)
    gone = materialize(found.where(~F.col(f"{_OWN}kept")).select(F.col("uid").alias(f"{_OWN}uid")).distinct(), "rejected")
    return docs.withColumn(f"{_OWN}uid", _row_key(id_column, lang_column, text_column)).join(_placed(gone), f"{_OWN}uid", "left_anti").select(*docs.columns)
