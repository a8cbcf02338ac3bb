"""Interpolated modified Kneser-Ney trigrams over all training texts, with tables that stay in shards.

Every trigram (u, v, w) goes to the shard of the hash of its middle word v, which
thereby holds what its probability needs: its count, those of its context (u, v),
and the distinct predecessors of (v, w) and of v's pairs. Only the last order, how
many distinct words precede w, takes counts of all shards: those of the
``VOCABULARY`` words that follow most are broadcast, another word's go to its own
shard and to those in which training texts have it as a last word. A pair (v, w)
that was not seen multiplies the last order's probability of w, which w's own shard
adds where w stands in the middle of the next trigram: it knows the pair as a context.

Three models share the shards: that of all training documents, which scores every
text, and those of two folds of them. A training document is scored a second time
by the fold that it is not in, without its own counts (by all, if that fold is empty).

Two passes over texts: training texts give the shards' counts; then all texts'
trigrams meet the shards, which return sums by document, so that texts are not
shuffled. Shards take turns in ``ROUNDS`` rounds, and all texts in ``PARTS`` parts
of each, so that a share of the trigrams is on disk at a time. A shard's counts are
held by its task, texts' trigrams pass by.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import partial
from itertools import product

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, materialize, release
from .lm_scoring import _numbers, _planes

VOCABULARY, PIECE, SHARD_BYTES, ROUNDS, PARTS = 1 << 17, 1 << 19, 1 << 24, 2, 3
CODED = 2_000  # texts whose words get short codes on their way to the counts; results do not depend on them
START, END, NO_FOLD = 1, 2, 2
_SUMS = 1 << 20  # sums by document that a task holds before it returns them
_BLOB = "shard int, kind int, codes long, common long, n long, uids binary, folds binary, data binary"
_NAMES = [x.split()[0] for x in _BLOB.split(", ")]
_KINDS = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary()]
MODELS = (0, 1, 2)  # the folds', and that of all training documents
_FOUND = "uid long, lp double, crossed double, n long"
_RARE, _COUNTS, _TEXTS = -1, 0, 1  # kinds of rows, in the order in which a shard meets them


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), dtype=np.uint64, count=len(words))


def discounts(n1: float, n2: float, n3: float, n4: float) -> list[float]:
    """Modified Kneser-Ney's three discounts from the numbers of n-grams seen one to four times."""
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    found = [1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5]
    return [min(max(d, 0.05), k + 0.95) for k, d in enumerate(found)]


def _cut(n: np.ndarray, d: list[float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(n, 3)]


def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The places of wanted in sorted keys; -1 for none."""
    if not len(keys):
        return np.full(len(wanted), -1, np.int64)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, at, -1)


def _packed(codes: np.ndarray, vocabulary: np.ndarray, numbers: list[np.ndarray]) -> tuple[int, int, int, bytes]:
    """Sorted word hashes (those of the vocabulary as their places) and rows of numbers below 2^32, ascending by the first two -> sizes and compressed bytes."""
    at = _at(vocabulary, codes)
    common = at >= 0
    v, u = numbers[:2]
    step = np.diff(v, prepend=0)
    u = np.where(step == 0, np.diff(u, prepend=0), u)
    data = [np.packbits(common).tobytes(), _planes(np.diff(at[common], prepend=0), 4), codes[~common].tobytes(), *[_planes(x, 4) for x in (step, u, *numbers[2:])]]
    return len(codes), int(common.sum()), len(numbers[0]), zstandard.ZstdCompressor(level=1).compress(b"".join(data))


def _unpacked(codes: int, common: int, n: int, data: bytes, vocabulary: np.ndarray, columns: int) -> tuple[np.ndarray, list[np.ndarray]]:
    raw, at = zstandard.ZstdDecompressor().decompress(data), (codes + 7) // 8
    is_common = np.unpackbits(np.frombuffer(raw, np.uint8, at), count=codes).astype(bool)
    words = np.empty(codes, np.uint64)
    if common:
        words[is_common] = vocabulary[np.cumsum(_numbers(raw, common, at, 4).astype(np.int64))]
    at += 4 * common
    words[~is_common] = np.frombuffer(raw, np.uint64, codes - common, at)
    at += 8 * (codes - common)
    rows = [_numbers(raw, n, at + 4 * n * k, 4).astype(np.int64) for k in range(columns)]
    total = np.cumsum(rows[1])
    rows[1] = total - (total - rows[1])[np.maximum.accumulate(np.where(rows[0] > 0, np.arange(n), 0))]
    rows[0] = np.cumsum(rows[0])
    return words, rows


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, list[tuple]]]:
    """Rows (uid, fold, text) -> sorted hashes of words, and lists of uid, fold and the places of a text's words with two starts and an end; long texts go in parts that overlap by two."""
    number: defaultdict = defaultdict()  # words in order of appearance: only distinct ones are held and hashed
    number.default_factory = number.__len__
    held, size = [], 0

    def ready() -> tuple[np.ndarray, list[tuple]]:
        hashes = np.fromiter((x if isinstance(x, int) else xxhash.xxh64_intdigest(x) for x in number), np.uint64, len(number))
        hashes, place = np.unique(hashes, return_inverse=True)
        return hashes, [(uid, fold, place[line]) for uid, fold, line in held]

    for b in batches:
        for uid, fold, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), strict=True):
            line = [START, START, *text.split(), END]
            for i in range(0, len(line) - 2, PIECE):
                part = line[i : i + PIECE + 2]
                held.append((uid, fold, np.fromiter(map(number.__getitem__, part), np.int32, len(part))))
                size += len(part)
                if size >= PIECE:
                    yield ready()
                    number.clear()
                    held, size = [], 0
    if held:
        yield ready()


def _texts_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found = [word_hashes(text.split()) for b in batches for text in as_bytes(b.column(0))]
    yield pa.RecordBatch.from_arrays([pa.array(np.unique(np.concatenate([np.array([START, END], np.uint64), *found])).view(np.int64))], names=["w"])


def _dealt(bits: int, shared, scored: bool, low: int, high: int):
    """Rows (uid, fold, text) -> the trigrams of each shard from low on and below high: with their documents (scored), or distinct with counts in both folds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = shared.value["words"]
        for words, held in _pieces(batches):
            sizes = np.array([len(x[2]) for x in held])
            ids = np.concatenate([x[2] for x in held])
            shard = words >> np.uint64(64 - bits) if bits else np.zeros(len(words), np.uint64)
            first, last = np.searchsorted(shard, np.array([low, high], np.uint64))  # the round's words
            inner = np.ones(len(ids), bool)
            ends = np.cumsum(sizes)
            inner[ends - 1] = inner[ends - 2] = False
            inner[:-1] &= (ids[1:] >= first) & (ids[1:] < last)
            at = np.flatnonzero(inner)
            if not len(at):
                continue
            key = ids[at + 1] << 42 | ids[at] << 21 | ids[at + 2]  # a piece has fewer than 2^21 words
            doc = np.repeat(np.arange(len(held)), sizes)[at]
            order = np.argsort(key)
            key, doc = key[order], doc[order]
            if scored:
                uids, folds = np.array([x[0] for x in held], np.int64), np.array([x[1] for x in held], np.uint8)
                extra = [doc]
            else:
                first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                own = np.array([x[1] for x in held])[doc]
                key, extra = key[first], [np.add.reduceat((own == f).astype(np.int64), first) for f in (0, 1)]
            parts = [key >> 42, key >> 21 & (1 << 21) - 1, key & (1 << 21) - 1]
            cuts = np.searchsorted(shard[parts[0]], np.arange((1 << bits) + 1, dtype=np.uint64))
            rows = []
            for k in np.flatnonzero(np.diff(cuts)).tolist():
                i, j = cuts[k], cuts[k + 1]
                used = np.zeros(len(words), bool)
                for p in parts:
                    used[p[i:j]] = True
                local = np.cumsum(used) - 1
                more = [x[i:j] for x in extra]
                tail = (b"", b"")
                if scored:
                    docs, more[0] = np.unique(more[0], return_inverse=True)
                    tail = (uids[docs].tobytes(), folds[docs].tobytes())
                codes, common, n, data = _packed(words[used], vocabulary, [*[local[p[i:j]] for p in parts], *more])
                rows.append((k, _TEXTS if scored else _COUNTS, codes, common, n, *tail, data))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _KINDS, strict=True)], names=_NAMES)
        release()

    return run


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for b in batches:
        for i in range(b.num_rows):
            yield tuple(c[i].as_py() for c in b.columns)


_COUNTED = _BLOB + ", w array<long>, c0 array<long>, c1 array<long>, c2 array<long>, stats array<long>"


def _counted(coding, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Training trigrams, sorted by shard -> a row per shard: distinct trigrams with their counts, each word's distinct predecessors, and how many counts are one to four (pairs', trigrams') by fold."""
    none = np.zeros(0, np.uint64)

    def emit(held: list[tuple]) -> pa.RecordBatch:
        blobs = [_unpacked(codes, common, n, data, coding.value["words"], 5) for _, _, codes, common, n, _, _, data in held]
        words = np.unique(np.concatenate([b[0] for b in blobs]))
        v, u, w, *n = [np.concatenate(x) for x in zip(*[[*[np.searchsorted(words, c)[x] for x in rows[:3]], *rows[3:]] for c, rows in blobs])]
        many = len(words)
        pairs, pair = np.unique(v * many + u, return_inverse=True)
        keys, own = np.unique(pair * many + w, return_inverse=True)
        n = [np.bincount(own, weights=x, minlength=len(keys)).astype(np.int64) for x in n]
        w, of = keys % many, pairs[keys // many]
        v, u = of // many, of % many
        before, stats = [], []
        for x in (*n, n[0] + n[1]):
            found, c = np.unique((v * many + w)[x > 0], return_counts=True)
            before.append(np.bincount(found % many, minlength=many))
            stats += [int((y == k).sum()) for y in (c, x) for k in (1, 2, 3, 4)]
        codes, common, size, data = _packed(words, none, [v, u, w, *n])
        kinds = [*_KINDS, *[pa.list_(pa.int64())] * 5]
        last = np.flatnonzero(before[2])
        row = (held[0][0], _COUNTS, codes, common, size, b"", b"", data, words[last].view(np.int64).tolist(), *[x[last].tolist() for x in before], stats)
        return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, kinds, strict=True)], names=[*_NAMES, "w", "c0", "c1", "c2", "stats"])

    held: list[tuple] = []
    for row in _rows(batches):
        if held and held[0][0] != row[0]:
            yield emit(held)
            held = []
        held.append(row)
    if held:
        yield emit(held)
    release()


def _apart(shared):
    """Rows (shard, w, c0, c1, c2) -> those of words outside the vocabulary, packed by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        held: list[np.ndarray] = []

        def emit() -> Iterator[pa.RecordBatch]:
            shard, w, *c = np.concatenate(held, axis=1)
            held.clear()
            order = np.lexsort((w.view(np.uint64), shard))
            order = order[_at(shared.value["words"], w[order].view(np.uint64)) < 0]
            if not len(order):
                return
            shard, w, c = shard[order], w[order], [x[order] for x in c]
            cuts = [*np.flatnonzero(np.diff(shard, prepend=-1)).tolist(), len(order)]
            rows = []
            for i, j in zip(cuts, cuts[1:]):
                data = press.compress(b"".join([w[i:j].tobytes(), *[_planes(x[i:j], 4) for x in c]]))
                rows.append((int(shard[i]), _RARE, j - i, 0, j - i, b"", b"", data))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), _KINDS, strict=True)], names=_NAMES)

        for b in batches:
            held.append(np.stack([np.asarray(x).astype(np.int64) for x in b.columns]))
            if sum(x.shape[1] for x in held) >= _SUMS:
                yield from emit()
        if held:
            yield from emit()
        release()

    return run


class _Model:
    """One model's probabilities in a shard, but for the last order."""

    def __init__(self, v: np.ndarray, w: np.ndarray, many: int, pair: np.ndarray, n: np.ndarray, d2: list[float], d3: list[float]):
        cut = _cut(n, d3)
        size = int(pair[-1]) + 1 if len(pair) else 0
        total = np.bincount(pair, weights=n, minlength=size)
        self.seen = total > 0
        self.mass3 = np.where(total > 0, np.bincount(pair, weights=cut, minlength=size) / np.maximum(total, 1), 1.0)
        self.own3 = (n - cut) / np.maximum(total[pair], 1)
        self.pairs, c = np.unique((v * many + w)[n > 0], return_counts=True)
        of = self.pairs // many
        cut, total = _cut(c, d2), np.bincount(of, weights=c, minlength=many)
        self.mass2 = np.where(total > 0, np.bincount(of, weights=cut, minlength=many) / np.maximum(total, 1), 1.0)
        self.own2 = (c - cut) / total[of]


class _Shard:
    def __init__(self, number: int, words: np.ndarray, rows: list[np.ndarray], rare: list[tuple], shared: dict):
        v, u, w, *n = rows
        self.number, self.words, self.many, self.shared = number, words, max(1, len(words)), shared
        self.pairs, pair = np.unique(v * self.many + u, return_inverse=True)
        self.keys = pair * self.many + w
        self.models = [_Model(v, w, self.many, pair, x, d2, d3) for x, d2, d3 in zip((*n, n[0] + n[1]), shared["d2"], shared["d3"], strict=True)]
        found = [np.concatenate(x) for x in zip(*rare)] if rare else [np.zeros(0, np.uint64)] + [np.zeros(0, np.int64)] * 3
        order = np.argsort(found[0])
        self.rare = found[0][order]
        self.last = [_last(c[order], *shared["last"][f]) for f, c in enumerate(found[1:])]

    def costs(self, words: np.ndarray, v: np.ndarray, u: np.ndarray, w: np.ndarray, needed: list[np.ndarray]) -> list[np.ndarray]:
        """For each model: its log10 probabilities of the trigrams that need it.

        Where a word outside the vocabulary follows another one for the first time, the last order's share is left to that word's shard;
        this one adds it for its own words, each as the middle of the next trigram.
        """
        vocabulary = self.shared["words"]
        common, rare = _at(vocabulary, words), _at(self.rare, words)
        own = (common < 0) & (words != START)
        known = _at(self.words, words)
        look = lambda values, at, other: np.where(at >= 0, values[np.maximum(at, 0)], other) if len(values) else np.full(len(at), other)
        kv, ku, kw = known[v], known[u], known[w]
        pair = np.where((kv >= 0) & (ku >= 0), _at(self.pairs, kv * self.many + ku), -1)
        whole = np.where((pair >= 0) & (kw >= 0), _at(self.keys, pair * self.many + kw), -1)
        out = []
        for f, (m, at) in enumerate(zip(self.models, needed, strict=True)):
            here, mid, word = pair[at], kv[at], w[at]
            mass3 = look(m.mass3, here, 1.0)
            two = np.where((mid >= 0) & (kw[at] >= 0), _at(m.pairs, mid * self.many + kw[at]), -1)
            higher, factor = look(m.own3, whole[at], 0.0) + mass3 * look(m.own2, two, 0.0), mass3 * look(m.mass2, mid, 1.0)
            last = np.where(common >= 0, self.shared["p"][f][np.maximum(common, 0)], look(self.last[f], rare, self.shared["last"][f][2]))
            p = np.where((higher == 0) & own[word], factor, higher + factor * last[word])
            later = np.where(own, np.log10(last), 0.0)[v[at]]
            out.append(np.log10(p) + np.where(look(m.seen, here, False), 0.0, later))
        return out


def _last(c: np.ndarray, d: list[float], total: float, base: float) -> np.ndarray:
    """The last order's probabilities by how many distinct words precede a word."""
    return (c - _cut(c, d)) / max(1.0, total) + base


def _scored(variables):
    """Each shard's words outside the vocabulary, then its counts, then the trigrams of texts in it -> sums by document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shared = variables.value
        vocabulary, other = shared["words"], np.array(shared["other"])
        model, sums, held = None, [], 0
        rare: list[tuple] = []
        rare_of = -1

        def summed() -> pa.RecordBatch:
            uid, own = np.unique(np.concatenate([s[0] for s in sums]), return_inverse=True)
            lp, crossed, n = (np.bincount(own, weights=np.concatenate([s[k] for s in sums]), minlength=len(uid)) for k in (1, 2, 3))
            sums.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (uid, lp, crossed, n.astype(np.int64))], names=["uid", "lp", "crossed", "n"])

        for number, kind, codes, common, n, uids, folds, data in _rows(batches):
            if rare_of != number:
                rare, rare_of = [], number
            if kind == _RARE:
                raw = zstandard.ZstdDecompressor().decompress(data)
                rare.append((np.frombuffer(raw, np.uint64, n), *[_numbers(raw, n, 8 * n + 4 * n * f, 4).astype(np.int64) for f in MODELS]))
                continue
            words, rows = _unpacked(codes, common, n, data, vocabulary if kind == _TEXTS else vocabulary[:0], 4 if kind == _TEXTS else 5)
            if kind == _COUNTS:
                model = None  # the one before goes first
                model = _Shard(number, words, rows, rare, shared)
                continue
            if model is None or model.number != number:
                model = _Shard(number, words[:0], [np.zeros(0, np.int64)] * 5, rare, shared)
            v, u, w, doc = rows
            uid, fold = np.frombuffer(uids, np.int64), np.frombuffer(folds, np.uint8)
            new = np.concatenate([[True], (v[1:] != v[:-1]) | (u[1:] != u[:-1]) | (w[1:] != w[:-1])])
            first, own = np.flatnonzero(new), np.cumsum(new) - 1
            second = other[fold][doc]  # the model of the second score
            needs = [np.flatnonzero(second == f) for f in (0, 1)]
            needed = []
            for at in needs:
                asked = np.zeros(len(first), bool)
                asked[own[at]] = True
                needed.append(np.flatnonzero(asked))
            *halves, whole = model.costs(words, v[first], u[first], w[first], [*needed, np.arange(len(first))])
            cost = whole[own]
            crossed = cost.copy()
            for at, asked, x in zip(needs, needed, halves, strict=True):
                crossed[at] = x[np.searchsorted(asked, own[at])]
            sums.append((uid, *[np.bincount(doc, weights=x, minlength=len(uid)) for x in (cost, crossed)], np.bincount(doc, minlength=len(uid))))
            held += len(uid)
            if held >= _SUMS:
                yield summed()
                held = 0
        if sums:
            yield summed()
        release()

    return run


def perplexities(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs (uid, fold, text); fold 0 or 1 trains, NO_FOLD does not -> uid, lp (log10 probability of words and ends), crossed (the same without the fold), n (words and ends), sums over the rows of one uid."""
    spark = docs.sparkSession
    docs = docs.select("uid", F.coalesce("fold", F.lit(NO_FOLD)).alias("fold"), "text")
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    bits = max(0, (int(size) // shard_bytes).bit_length())
    training = docs.where(F.col("fold") != NO_FOLD)
    some = training.select("text").limit(CODED).mapInArrow(_texts_words, "w long").toPandas()["w"].to_numpy(dtype=np.int64)
    coding = spark.sparkContext.broadcast({"words": np.unique(some.view(np.uint64))})
    train = training.mapInArrow(_dealt(bits, coding, False, 0, 1 << bits), _BLOB)
    counted = materialize(train.repartition("shard").sortWithinPartitions("shard").mapInArrow(partial(_counted, coding), _COUNTED), "shard-counts")
    last = counted.select("shard", F.explode(F.arrays_zip("w", "c0", "c1", "c2")).alias("x")).groupBy("x.w").agg(*[F.sum(f"x.c{f}").alias(f"c{f}") for f in MODELS], F.collect_list("shard").alias("shards"))
    last = materialize(last, "predecessors")
    sums = counted.select(F.posexplode("stats").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).collect()
    stats = np.zeros(24)
    for r in sums:
        stats[r["k"]] = r["x"]
    per = last.agg(*[g for f in MODELS for g in (F.sum(f"c{f}").alias(f"t{f}"), F.count_if(F.col(f"c{f}") > 0).alias(f"v{f}"), *[F.count_if(F.col(f"c{f}") == k).alias(f"n{f}{k}") for k in (1, 2, 3, 4)], F.count_if(F.col(f"c{f}") >= 3).alias(f"m{f}"))]).first()
    counts = last.select("w", *[f"c{f}" for f in MODELS])
    top = [tuple(r) for part in (counts.where(F.col("w") == END), counts.where(F.col("w") != END).orderBy(F.desc("c2"), "w").limit(VOCABULARY)) for r in part.collect()]
    if not top or top[0][0] != END:
        top.insert(0, (END, 0, 0, 0))  # no training text
    top = np.array(top, np.int64)
    words = top[:, 0].copy().view(np.uint64)
    order = np.argsort(words)
    shared = {"words": words[order], "p": [], "last": [], "d2": [discounts(*stats[8 * f : 8 * f + 4]) for f in MODELS], "d3": [discounts(*stats[8 * f + 4 : 8 * f + 8]) for f in MODELS]}
    for f in MODELS:
        d = discounts(*[float(per[f"n{f}{k}"]) for k in (1, 2, 3, 4)])
        total = float(per[f"t{f}"] or 0)
        mass = (d[0] * per[f"n{f}1"] + d[1] * per[f"n{f}2"] + d[2] * per[f"m{f}"]) / total if total else 1.0
        shared["last"].append((d, total, mass / (per[f"v{f}"] + 1)))
        shared["p"].append(_last(top[order, 1 + f], *shared["last"][f]))
    # the model of a document's second score, by its fold
    shared["other"] = [1 if per["t1"] else 2, 0 if per["t0"] else 2, 2]
    variables = spark.sparkContext.broadcast(shared)
    home = F.shiftrightunsigned("w", 64 - bits).cast("int") if bits else F.lit(0)
    homes = last.select(F.explode(F.array_union("shards", F.array(home))).alias("shard"), "w", *[f"c{f}" for f in MODELS])
    rare = materialize(homes.mapInArrow(_apart(variables), _BLOB), "rare-words")
    discard(last)
    found, shards = None, 1 << bits
    rounds = min(ROUNDS, shards)
    for k, part in product(range(rounds), range(PARTS)):
        low, high = k * shards // rounds, (k + 1) * shards // rounds
        mine = F.col("shard").between(low, high - 1)
        texts = docs.where(F.pmod(F.xxhash64("uid"), F.lit(PARTS)) == part).mapInArrow(_dealt(bits, variables, True, low, high), _BLOB)
        both = counted.select(*_NAMES).where(mine).unionByName(rare.where(mine)).unionByName(texts).repartition("shard").sortWithinPartitions("shard", "kind")
        more, before = both.mapInArrow(_scored(variables), _FOUND), found
        more = more if before is None else more.unionByName(before)
        found = materialize(more.groupBy("uid").agg(*[F.sum(c).alias(c) for c in ("lp", "crossed", "n")]), "shard-sums")
        if before is not None:
            discard(before)
    discard(counted, rare)
    return found
