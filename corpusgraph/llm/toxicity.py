"""Toxic spans by a linear-chain conditional random field.

Labels are given for documents, so tokens are labelled first: a token of a
toxic training document is toxic if its word, or its word's beginning of
``STARTS`` letters, is found in far more toxic than other training documents:
some languages build their words by compounding. On windows of ``WINDOW`` words
a two-state linear-chain CRF learns from these tokens with hashed features of
the word, its beginnings of ``SHAPES`` letters, and its neighbours. Shards of the sample train
on their own, and a feature's weight is the mean over the shards that saw it.

Forward-backward gives each word's probability of being toxic. A document's
score is a logistic function of its largest marginal, their sum and their
share, fitted on training documents that the CRF did not see. ``spans`` returns
the offending offsets.

The labelled sample is bounded by ``SAMPLE`` documents of each class; lexicon,
weights and calibration come from it. Labels, language, source and id are no
inputs of a score.

Cases: null text is empty, and empty texts get the score of no toxic word; rows
whose label is null train nothing; without labels of both classes all scores
are 0; repeated rows are scored each; no rows give no rows.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from .common import crc_mod, materialize

SAMPLE, SHARDS, WINDOW, BITS, EPOCHS, BATCH, SEED = 4000, 8, 64, 18, 3, 128, 5
MIN_DOCS, MIN_ODDS, MAX_LEXICON, STARTS, SHAPES = 6, 2.0, 20_000, (3, 4, 5, 6, 7, 8, 9), (3, 4, 5, 7)
MASK = (1 << BITS) - 1
_STRIP = ".,;:!?()[]{}\"'|%$&*#-_«»“”…"
_EDGE, _CHUNK, _KNOWN = 7, 1 << 20, 400_000
_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def _bucket(kind: str, s: str) -> int:
    return zlib.crc32(f"{kind}{s}".encode("utf-8", "surrogatepass")) & MASK


def _clean(word: str) -> str:
    return word.lower().strip(_STRIP)


def _keys(word: str) -> list[int]:
    """What the lexicon knows a word by: itself, and its beginnings."""
    own = [xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass")) - (1 << 63)]
    return own + [xxhash.xxh64_intdigest(word[:n].encode("utf-8", "surrogatepass"), n) - (1 << 63) for n in STARTS if len(word) > n]


class _Words(dict):
    """A word to its row in a table of buckets: of the word itself, and of its beginnings."""

    def __init__(self):
        super().__init__()
        self.table = np.zeros((_KNOWN, 1 + len(SHAPES)), np.int32)

    def __missing__(self, word: str) -> int:
        w, row = _clean(word), len(self)
        self.table[row] = [_bucket("w", w), *[_bucket(str(n), w[:n]) for n in SHAPES]]
        self[word] = row
        return row


def features(words: list[str], cache: _Words) -> np.ndarray:
    """Buckets (rows x words) of word, beginnings, previous and next word."""
    parts = []
    for i in range(0, len(words), _KNOWN // 2) or (0,):
        some = words[i : i + _KNOWN // 2]
        if len(cache) + len(some) > _KNOWN:
            cache.clear()
        parts.append(cache.table[np.fromiter(map(cache.__getitem__, some), dtype=np.int64, count=len(some))])
    own = np.concatenate(parts)
    out = np.empty((own.shape[1] + 2, len(words)), dtype=np.int32)
    out[:-2] = own.T
    out[-2, :1], out[-1, -1:] = _EDGE, _EDGE
    out[-2, 1:], out[-1, :-1] = (out[0, :-1] * 31 + 11) & MASK, (out[0, 1:] * 37 + 13) & MASK
    return out


def forward_backward(e: np.ndarray, real: np.ndarray, t: np.ndarray, pairs: bool = False):
    """Emissions e (windows x steps) of state 1 against 0, real steps, transition scores t[from, to] and t[2, 1] at the start.

    Returns the marginals of state 1 and, with pairs, the expected transition counts in the shape of t.
    """
    n, steps = e.shape
    x, m = np.exp(np.clip(e, -30, 30)), np.exp(t)
    a = np.empty((n, steps))  # of the words up to here: the probability of state 1
    one = m[2, 1] * x[:, 0]
    a[:, 0] = one / (one + m[2, 0])
    for i in range(1, steps):
        p = a[:, i - 1]
        one = ((1 - p) * m[0, 1] + p * m[1, 1]) * x[:, i]
        a[:, i] = np.where(real[:, i], one / (one + (1 - p) * m[0, 0] + p * m[1, 0]), p)
    b = np.empty((n, steps))  # of the words after this: the share of state 1
    b[:, -1] = 0.5
    expected = np.zeros((3, 2))
    for i in range(steps - 1, 0, -1):
        q = b[:, i] * x[:, i]
        r = 1 - b[:, i]
        one, zero = m[1, 0] * r + m[1, 1] * q, m[0, 0] * r + m[0, 1] * q
        b[:, i - 1] = np.where(real[:, i], one / (one + zero), b[:, i])
        if pairs:
            p = a[:, i - 1]
            joint = np.stack([(1 - p) * m[0, 0] * r, (1 - p) * m[0, 1] * q, p * m[1, 0] * r, p * m[1, 1] * q])
            joint = np.where(real[:, i], joint / joint.sum(axis=0), 0)
            expected[:2] += joint.sum(axis=1).reshape(2, 2)
    both = a * b
    marginal = both / (both + (1 - a) * (1 - b))
    if pairs:
        expected[2] = [(1 - marginal[:, 0]).sum(), marginal[:, 0].sum()]
        return marginal, expected
    return marginal


def _windows(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts of so many words, one after another -> positions (windows x steps) and which are real."""
    starts, each = np.cumsum(sizes) - sizes, -(-sizes // WINDOW)
    own = np.repeat(np.arange(len(sizes)), each)
    first = starts[own] + WINDOW * (np.arange(len(own)) - np.repeat(np.cumsum(each) - each, each))
    at = first[:, None] + np.arange(WINDOW)
    real = at < (starts + sizes)[own][:, None]
    return np.where(real, at, 0), real


def train_shard(texts: list[str], toxic: list[int], lexicon: set[int], seed: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adaptive-gradient ascent on the log-likelihood of a shard's labelled tokens: weights, which were seen, transitions."""
    cache, rng = _Words(), np.random.default_rng(seed)
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    f = features([y for x in words for y in x], cache)
    flat = [y for x in words for y in x]
    marked = {w: not lexicon.isdisjoint(_keys(_clean(w))) for w in set(flat)}
    y = np.fromiter(map(marked.__getitem__, flat), bool, len(flat)) & np.repeat(np.array(toxic, dtype=bool), sizes)
    at, real = _windows(sizes)
    w, g = np.zeros(MASK + 2), np.zeros(MASK + 2)  # the last is the bias
    t, tg = np.zeros((3, 2)), np.zeros((3, 2))
    for _ in range(EPOCHS):
        order = rng.permutation(len(at))
        for i in range(0, len(order), BATCH):
            pick = order[i : i + BATCH]
            a, r = at[pick], real[pick]
            e = w[f[:, a]].sum(axis=0) + w[-1]
            m, expected = forward_backward(e, r, t, True)
            yes = y[a] & r
            miss = np.where(r, yes - m, 0)
            grad = np.bincount(f[:, a].ravel(), weights=np.broadcast_to(miss, (len(f), *miss.shape)).ravel(), minlength=MASK + 2)
            grad[-1] = miss.sum()
            s = yes.astype(int)
            seen = np.zeros((3, 2))
            np.add.at(seen, (s[:, :-1][r[:, 1:]], s[:, 1:][r[:, 1:]]), 1)
            seen[2] = [(1 - s[:, 0]).sum(), s[:, 0].sum()]
            grad -= 1e-3 * w
            g += grad**2
            w += 0.2 * grad / np.sqrt(g + 1e-6)
            td = seen - expected - 1e-3 * t
            tg += td**2
            t += 0.1 * td / np.sqrt(tg + 1e-6)
    used = np.zeros(MASK + 2, bool)
    used[f.ravel()] = used[-1] = True
    return w, used, t


def _lexicon_rows(text_column: str, label_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for text, toxic in zip(b.column(b.schema.get_field_index(text_column)).to_pylist(), b.column(b.schema.get_field_index(label_column)).to_pylist(), strict=True):
                keys = {k for w in {_clean(w) for w in (text or "").split()} for k in _keys(w)}
                yield pa.RecordBatch.from_arrays([pa.array(list(keys), pa.int64()), pa.array([int(toxic)] * len(keys), pa.int64())], names=["key", "toxic"])

    return run


def _lexicon(sample: DataFrame, text_column: str, label_column: str) -> set[int]:
    sides = {r[label_column]: r["n"] for r in sample.groupBy(label_column).agg(F.count("*").alias("n")).collect()}
    counts = sample.mapInArrow(_lexicon_rows(text_column, label_column), "key long, toxic long").groupBy("key").agg(F.sum("toxic").alias("yes"), F.sum(1 - F.col("toxic")).alias("no"))
    odds = F.log((F.col("yes") + 0.5) / (sides.get(1, 0) + 1)) - F.log((F.col("no") + 0.5) / (sides.get(0, 0) + 1))
    best = counts.withColumn("odds", odds).where((F.col("yes") >= MIN_DOCS) & (F.col("odds") >= MIN_ODDS))
    return {r["key"] for r in best.orderBy(F.desc(F.col("odds") * F.sqrt("yes")), "key").limit(MAX_LEXICON).collect()}


def _shard_weights(lexicon: set[int], text_column: str, label_column: str):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["draw", text_column], na_position="first")
        w, used, t = train_shard(pdf[text_column].fillna("").tolist(), pdf[label_column].astype(int).tolist(), lexicon, int(pdf["shard"].iloc[0]))
        at = np.flatnonzero(used & (np.abs(w) > 1e-4))
        keys, values = np.concatenate([at, MASK + 10 + np.arange(6)]), np.concatenate([w[at], t.ravel()])
        return pd.DataFrame({"key": keys.astype("int64"), "value": values})

    return run


def marginals(texts: list[str], model: dict, cache: _Words) -> tuple[list[list[str]], np.ndarray, np.ndarray]:
    """The texts' words, their number, and each word's probability of being toxic."""
    words = [t.split() for t in texts]
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    flat = [y for x in words for y in x]
    if not flat:
        return words, sizes, np.zeros(0)
    f = features(flat, cache)
    w = model["w"]
    e = w[f[0]] + w[-1]
    for row in f[1:]:
        e += w[row]
    at, real = _windows(sizes)
    out = np.empty(len(flat))
    out[at[real]] = forward_backward(e[at], real, model["t"])[real]
    return words, sizes, out


def _summaries(sizes: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Per text: the largest marginal's log-odds, the log of their sum, their share, the log of the size."""
    out = np.zeros((len(sizes), 4))
    full = sizes > 0
    starts = (np.cumsum(sizes) - sizes)[full]
    top = np.zeros(len(sizes))
    total = np.zeros(len(sizes))
    if full.any():
        top[full], total[full] = np.maximum.reduceat(m, starts), np.add.reduceat(m, starts)
    top = np.clip(top, 1e-6, 1 - 1e-6)
    out[:, 0], out[:, 1], out[:, 2], out[:, 3] = np.log(top / (1 - top)) / 4, np.log1p(total), 10 * total / (sizes + 10), np.log1p(sizes) / 4
    return out


def _chunks(texts: list[str]) -> Iterator[list[str]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t)
        if held >= _CHUNK:
            yield part
            part, held = [], 0
    if part:
        yield part


def _toxic_spans(text: str, m: np.ndarray, least: float) -> list[tuple[int, int, float]]:
    """Runs of words of at least that marginal: their first and last character's place (the end excluded), and their largest marginal."""
    hit = np.flatnonzero(m >= least)
    if not len(hit):
        return []
    places = [x.span() for x in re.finditer(r"\S+", text)]
    return [(places[run[0]][0], places[run[-1]][1], float(m[run].max())) for run in np.split(hit, np.flatnonzero(np.diff(hit) > 1) + 1)]


def _scores(model, text_column: str, keep: list[str], summaries: bool, offsets: bool = False):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, cache = model.value, _Words()
        for b in batches:
            rows, found = [np.zeros((0, 4))], []
            for part in _chunks([x or "" for x in b.column(b.schema.get_field_index(text_column)).to_pylist()]):
                _, sizes, m = marginals(part, known, cache)
                rows.append(_summaries(sizes, m))
                if offsets:
                    told = rows[-1] @ known["c"][1:] + known["c"][0] >= 0
                    for t, n, e, toxic in zip(part, sizes.tolist(), np.cumsum(sizes).tolist(), told.tolist()):
                        own = m[e - n : e]
                        # a document that is called toxic names at least what made it so most
                        spans = _toxic_spans(t, own, 0.5) or (_toxic_spans(t, own, own.max()) if toxic and n else [])
                        found.append([{"start": i, "end": j} for i, j, _ in spans])
            x = np.concatenate(rows)
            kept = [b.column(b.schema.get_field_index(k)) for k in keep]
            if summaries:
                yield pa.RecordBatch.from_arrays([*kept, *[pa.array(x[:, k]) for k in range(4)]], names=[*keep, "x0", "x1", "x2", "x3"])
            else:
                z = np.clip(x @ known["c"][1:] + known["c"][0], -500, 500)
                more = [pa.array(found, _SPANS)] if offsets else []
                yield pa.RecordBatch.from_arrays([*kept, pa.array(1 / (1 + np.exp(-z))), *more], names=[*keep, "score", *(["spans"] if offsets else [])])

    return run


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Newton's method with a little ridge."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    c = np.zeros(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -30, 30)))
        ridge = 0.01 * np.eye(len(c))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ c)
        c += np.clip(step, -5, 5)
    return c


def train(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: int = SAMPLE, seed: int = SEED) -> dict | None:
    """Documents and labels of 0 or 1 by id -> the model: weights w, transitions t, calibration c.

    Ids are drawn from the labels alone; the sample, at most about twice ``sample`` ids, is broadcast to the documents.
    """
    draw = F.pmod(F.xxhash64(F.lit(seed), F.col(id_column)), F.lit(1_000_000))
    given = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).select(id_column, F.col(label_column).cast("int").alias(label_column), draw.alias("draw")).distinct()
    sides = {r[label_column]: r["n"] for r in given.groupBy(label_column).agg(F.count("*").alias("n")).collect()}
    if set(sides) != {0, 1}:
        return None
    share = {k: min(1.0, sample / n) for k, n in sides.items()}
    limit = F.when(F.col(label_column) == 1, F.lit(1e6 * share[1])).otherwise(F.lit(1e6 * share[0]))
    drawn = given.where(F.col("draw") < limit)
    rows = docs.select(id_column, text_column).join(F.broadcast(drawn), id_column).select("draw", text_column, label_column)
    rows = materialize(rows.withColumn("shard", F.pmod("draw", F.lit(SHARDS * 2))), "labelled")
    crf, rest = rows.where(F.col("shard") < SHARDS), rows.where(F.col("shard") >= SHARDS)
    lexicon = _lexicon(crf, text_column, label_column)
    parts = crf.groupBy("shard").applyInPandas(_shard_weights(lexicon, text_column, label_column), "key long, value double")
    w, t = np.zeros(MASK + 2, dtype=np.float64), np.zeros(6)
    for r in parts.groupBy("key").agg(F.avg("value").alias("value")).toPandas().itertuples():  # at most one row per bucket
        if r.key <= MASK + 1:
            w[r.key] = r.value
        else:
            t[r.key - MASK - 10] = r.value
    model = {"w": w, "t": t.reshape(3, 2)}
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([StructField(label_column, rows.schema[label_column].dataType), *[StructField(f"x{k}", DoubleType()) for k in range(4)]])
    table = rest.mapInArrow(_scores(known, text_column, [label_column], True), schema).toPandas().sort_values([label_column, "x0", "x1", "x2", "x3"])
    y = table[label_column].to_numpy(dtype=float)
    if len(set(y)) < 2:
        return None
    model["c"] = _logistic(table[["x0", "x1", "x2", "x3"]].to_numpy(), y, np.where(y == 1, 1 / share[1], 1 / share[0]))
    return model


def score(docs: DataFrame, model: dict | None, text_column: str = "text", columns: tuple[str, ...] = ("doc_id",), offsets: bool = False) -> DataFrame:
    """The columns and score of each row, and with offsets its toxic spans (start and end in characters)."""
    kinds = "spans array<struct<start: long, end: long>>"
    if model is None:
        more = [F.array().cast(kinds.split(" ", 1)[1]).alias("spans")] if offsets else []
        return docs.select(*columns, F.lit(0.0).alias("score"), *more)
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = StructType([*[docs.schema[c] for c in columns], StructField("score", DoubleType()), *(StructType.fromDDL(kinds).fields if offsets else [])])
    return docs.select(*dict.fromkeys([*columns, text_column])).mapInArrow(_scores(known, text_column, list(columns), False, offsets), schema)


def spans(docs: DataFrame, model: dict, id_column: str = "doc_id", text_column: str = "text", least: float = 0.5) -> DataFrame:
    """A row per toxic span (neighbouring toxic words): id, start and end in characters, its text, its largest marginal."""
    known = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = _Words()
        for b in batches:
            out = []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                _, _, m = marginals([text or ""], known.value, cache)
                out += [(doc, start, end, text[start:end], top) for start, end, top in _toxic_spans(text or "", m, least)]
            kinds = (b.schema.field(0).type, pa.int64(), pa.int64(), pa.string(), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["id", "start", "end", "span", "marginal"])

    schema = StructType([StructField("id", docs.schema[id_column].dataType), StructField("start", LongType()), StructField("end", LongType()), *StructType.fromDDL("span string, marginal double").fields])
    return docs.select(id_column, text_column).mapInArrow(run, schema)


def judge(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic") -> DataFrame:
    """Train on the labels outside the held-out fifth, score all: id, held_out, score, predicted, spans."""
    own = docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("body"))
    given = labels.select(F.col(id_column).alias("doc"), F.col(label_column).alias("label")).where(crc_mod(F.col("doc"), 5) != 0)
    model = train(own, given, "doc", "body", "label")
    scored = score(own, model, "body", ("doc",), offsets=True)
    return scored.select(F.col("doc").alias(id_column), (crc_mod(F.col("doc"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "spans")
