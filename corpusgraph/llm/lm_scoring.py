"""Language-model scoring by online logistic context mixing.

A token (a word, or a text's end) is coded by binary decisions. The first asks
whether it is the one that followed its three tokens before most often, the
next ones whether it is one of the ``TOP`` that most often followed the two
before; a token that no context expects is named by its training count or, if
unseen, spelled bit by bit. Contexts know a token by 16 bits of its hash; where
one is expected rightly, the token itself is named among the training tokens of
those bits, by count or, if unseen, by spelling, so that all probabilities of a place
sum to one at most. Contexts are hashed, and all contexts of all
training documents are gathered: each document's contexts and tokens go, as
sorted hashes, to shards by hash, where they are counted and ranked, and what
the counts say about every token comes back.
The number of shards grows with the tokens, and so does the space of hashes.

A decision's probability is mixed from several predictors: one for the state
of each context (how often it was seen, and the expected token's share) and one
for both states, whose log-odds start from the hit rates of all training tokens
with each token's own occurrence left out. Weights, one set for each gate (how
many tokens before were expected, and which contexts agree), combine the
predictors and learn after every decision, from a document's start to its end,
and an adaptive map refines the result. Documents are mixed side by side.

Words that no training document has are spelled with contexts of one to three
bytes, whose hashed tables are of fixed size, as contexts that short are few;
the start weights of spelling come from all training words outside the vocabulary.

What is broadcast has fixed sizes: the ``VOCABULARY`` most frequent words, hit
rates and spelling tables. Counts of other words stay distributed and are joined.
A context of two words that are both very frequent is extended by the word
before, so that no shard has to hold all that follows it.

Cases: null text is empty and consists of its end; a null id counts as the
empty text in the held-out rule; repeated rows are scored each; without
training documents every word is spelled; no rows give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DataType, LongType, StructField, StructType

from .common import as_bytes, crc_mod, discard, materialize, release, with_row_id

VOCABULARY, SPELL_SLOTS = 1 << 17, 1 << 18
RATE, APM_RATE, APM_STEPS, PRIOR, LEVELS, INPUTS = 0.02, 0.02, 33, 0.4, 5, 4
BLOCK = 1 << 15
SHARD, CHECK, FREQUENT = 1 << 20, 8, 1 << 18
RUNS, KINDS, CELLS, TOP = 4, 4, 4096, 3
START_WEIGHTS = (0.2, 0.2, 0.6, 0.0)
_CHUNK, _SPELLED, _BODY, _NARROW = 1 << 22, 1 << 17, 1 << 21, 24  # bytes at a time: decisions, spelling (eight bits each), texts; sequences
LOG2 = np.log10(2.0)
_END = np.uint64(xxhash.xxh3_64_intdigest(b"\0end"))
_SYMBOL = np.uint64((1 << 16) - 1)


def _context(parts: list[np.ndarray]) -> np.ndarray:
    """One 64-bit hash of a context's parts."""
    h = np.full(len(parts[0]), len(parts), np.uint64)
    for p in parts:
        h = (h ^ p.astype(np.uint64)) * np.uint64(0xD6E8FEB86659FD93)
        h ^= h >> np.uint64(32)
    return h


def _slot(context: np.ndarray, node: np.ndarray, slots: int) -> np.ndarray:
    h = node.astype(np.uint64)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h += context
    h ^= h >> np.uint64(31)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h >>= np.uint64(65 - slots.bit_length())
    return h.view(np.int64)


def spelling_bits(words: list[bytes]) -> dict[str, np.ndarray]:
    """Words as bytes and a final zero, eight decisions each; contexts of one to three bytes."""
    flat = np.frombuffer(b"\0".join(words) + b"\0", np.uint8) if words else np.zeros(0, np.uint8)
    sizes = np.array([len(w) + 1 for w in words], dtype=np.int64)
    place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    before = [np.where(place >= k, np.concatenate([np.zeros(k, np.uint8), flat[:-k]])[: len(flat)], 0).astype(np.int64) for k in (1, 2, 3)]
    bits = np.unpackbits(flat[:, None], axis=1)
    node = np.ones((len(flat), 8), np.int64)
    for k in range(1, 8):
        node[:, k] = node[:, k - 1] * 2 + bits[:, k - 1]
    node, contexts = node.ravel(), [before[:1], before[:2], before]
    slots = [_slot(np.repeat(_context(c), 8), node, SPELL_SLOTS) for c in contexts]
    return {"y": bits.ravel(), "slots": slots, "prior": None, "own": np.arange(len(words)), "start": 8 * (np.cumsum(sizes) - sizes), "length": 8 * sizes}


def _seen_level(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.frexp(n.astype(np.float32))[1], LEVELS - 1)


def packed(table: np.ndarray) -> np.ndarray:
    """A table's log-odds in steps of 1/128, above three bits of how often the slot was seen."""
    n = table.astype(np.float64)
    odds = np.log((n[:, 1] + PRIOR) / (n[:, 0] + PRIOR))
    return (np.clip(np.rint(odds * 128), -2047, 2047).astype(np.int16) << 3) | _seen_level(n.sum(axis=1)).astype(np.int16)


def left_out(table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A table's log-odds without one occurrence of a bit, and how often the slot was then seen; by slot and bit."""
    n = np.repeat(table.astype(np.float32), 2, axis=0)
    n[np.arange(len(n)), np.arange(len(n)) % 2] -= 1
    np.maximum(n, 0, out=n)
    return np.log((n[:, 1] + PRIOR) / (n[:, 0] + PRIOR)), _seen_level(n.sum(axis=1)).astype(np.int8)


def _inputs(d: dict, tables: list[np.ndarray], leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """Every decision's four log-odds, and its gate."""
    y = d["y"]
    x = np.full((len(y), INPUTS), 0.3, np.float32)  # one is constant
    seen = []
    for k, (table, slot) in enumerate(zip(tables, d["slots"], strict=True)):
        if isinstance(table, tuple):
            at = 2 * slot + y
            x[:, k] = table[0].take(at)
            seen.append(table[1].take(at))
        elif table.ndim == 1:
            found = table.take(slot)
            x[:, k] = (found >> 3) * np.float32(1 / 128)
            seen.append(found & 7)
        else:
            n = table.take(slot, axis=0).astype(np.float32)
            if leave_out:
                n[np.arange(len(y)), y] -= 1
                np.maximum(n, 0, out=n)
            x[:, k] = np.log((n[:, 1] + PRIOR) / (n[:, 0] + PRIOR))
            seen.append(_seen_level(n.sum(axis=1)))
    if d["prior"] is not None:
        x[:, len(tables)] = d["prior"]
    return x, seen[-1].astype(np.int32) * LEVELS + seen[-2]


def mixed(x: np.ndarray, gate: np.ndarray, y: np.ndarray, start: np.ndarray, length: np.ndarray, weights: np.ndarray, apm: np.ndarray, gather: dict | None = None) -> np.ndarray:
    """The cost in bits of each sequence of decisions. x: every decision's log-odds; gather collects what weights and map have learned, without costs.

    Sequences run side by side, longest first; the last few go on one after another.
    """
    rows = np.ascontiguousarray(x, np.float32).view(np.complex128).ravel()  # four floats move as one item
    order = np.argsort(-length, kind="stable")
    start, length = start[order], length[order]
    count, gates = len(order), len(weights)
    w = np.tile(weights.astype(np.float32).reshape(-1), count).view(np.complex128)
    a = np.tile(apm.astype(np.float32), count)
    base_w, base_a = np.arange(count) * gates, np.arange(count) * APM_STEPS
    cost = np.zeros(count)
    used = np.zeros(count * gates, np.int64) if gather is not None else None
    live = count - np.searchsorted(length[::-1], np.arange(int(length[0]) if count else 0), side="right")
    bits = y.astype(np.float32)
    scale, half, rate, apm_rate = np.float32((APM_STEPS - 1) / 28), np.float32((APM_STEPS - 1) / 2 + 0.5), np.float32(RATE), np.float32(APM_RATE)
    done = 0
    for n in live.tolist():
        if n <= _NARROW and gather is None:
            break
        at = start[:n] + done
        done += 1
        s, bit = rows.take(at).view(np.float32).reshape(n, INPUTS), bits.take(at)
        row = base_w[:n] + gate.take(at)
        own = w.take(row).view(np.float32).reshape(n, INPUTS)
        z = np.einsum("ij,ij->i", own, s)
        np.clip(z, -14, 14, out=z)
        p = np.exp(-z)
        p += 1
        np.reciprocal(p, out=p)
        place = base_a[:n] + (z * scale + half).astype(np.int64)
        q = a.take(place)
        s *= ((bit - p) * rate)[:, None]
        own += s
        w[row] = own.view(np.complex128).ravel()
        a[place] = q + apm_rate * (bit - q)
        if gather is None:
            p += q
            p *= np.float32(0.5)
            cost[:n] -= np.log2(np.maximum(np.abs(p - (1 - bit)), np.float32(1e-9)))
        else:
            used[row] += 1
            place -= base_a[:n]
            gather["apm_n"] += np.bincount(place, minlength=APM_STEPS)
            gather["apm_y"] += np.bincount(place, weights=bit, minlength=APM_STEPS)
    for i in range(int(live[done]) if done < len(live) else 0):
        at = slice(start[i] + done, start[i] + length[i])
        sets = w.view(np.float32).reshape(count, gates, INPUTS)[i].astype(float).tolist()
        cost[i] += _one_by_one(rows[at].view(np.float32).reshape(-1, INPUTS).tolist(), gate[at].tolist(), y[at].tolist(), sets, a[base_a[i] : base_a[i] + APM_STEPS].astype(float).tolist())
    if gather is not None and count:
        n = used.reshape(count, gates)
        gather["w"] += (w.view(np.float32).reshape(count, gates, INPUTS) * n[..., None]).sum(axis=0)
        gather["n"] += n.sum(axis=0)
    out = np.empty(count)
    out[order] = cost
    return out


def _one_by_one(x: list, gate: list, y: list, sets: list, a: list) -> float:
    """The same for one sequence; sets and a learn in place."""
    cost, scale, half = 0.0, (APM_STEPS - 1) / 28, (APM_STEPS - 1) / 2 + 0.5
    for (x0, x1, x2, x3), g, bit in zip(x, gate, y, strict=True):
        w = sets[g]
        z = min(14.0, max(-14.0, w[0] * x0 + w[1] * x1 + w[2] * x2 + w[3] * x3))
        p, k = 1 / (1 + math.exp(-z)), int(z * scale + half)
        q, step = a[k], RATE * (bit - p)
        cost -= math.log2(max(1e-9, abs((p + q) / 2 - (1 - bit))))
        w[0] += step * x0
        w[1] += step * x1
        w[2] += step * x2
        w[3] += step * x3
        a[k] = q + APM_RATE * (bit - q)
    return cost


def mix_bits(d: dict, tables: list[np.ndarray], weights: np.ndarray, apm: np.ndarray, leave_out: bool = False, gather: dict | None = None) -> np.ndarray:
    """Each spelled word's cost in bits. tables are counts, packed, or without one occurrence (``left_out``)."""
    x, gate = _inputs(d, tables, leave_out)
    return mixed(x, gate, d["y"], d["start"], d["length"], weights, apm, gather)


def fresh() -> tuple[np.ndarray, np.ndarray]:
    """The weights and the map that learning starts from."""
    z = np.linspace(-14, 14, APM_STEPS)
    return np.full((LEVELS * LEVELS, INPUTS), 0.35), 1 / (1 + np.exp(-z))


def _counted(bits_of, orders: int, slots: int, text_column: str):
    """Count zeros and ones per slot over a partition; emit compressed blocks of the tables."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables = [np.zeros(2 * slots, np.int64) for _ in range(orders)]
        any_rows = False
        make = bits_of()
        for b in batches:
            for part in _parts(as_bytes(b.column(b.schema.get_field_index(text_column)))):
                any_rows = True
                d = make(part)
                for table, slot in zip(tables, d["slots"], strict=True):
                    table += np.bincount(2 * slot + d["y"], minlength=2 * slots)
        if any_rows:
            press = zstandard.ZstdCompressor(level=1)
            for k, table in enumerate(tables):
                small = np.minimum(table, 2**32 - 1).astype("<u4").reshape(-1, 2 * BLOCK)
                yield pa.RecordBatch.from_arrays([pa.array([k] * len(small), pa.int32()), pa.array(range(len(small)), pa.int32()), pa.array([press.compress(x.tobytes()) for x in small], pa.binary())], names=["table", "block", "counts"])

    return run


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Blocks sorted by table and block -> one block each, with counts of 32 bits."""
    expand, press, key, total = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=1), None, None

    def emit() -> pa.RecordBatch:
        kept = np.minimum(total, 2**32 - 1).astype("<u4")
        return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([press.compress(kept.tobytes())], pa.binary())], names=["table", "block", "counts"])

    for b in batches:
        for k, n, data in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if key != (k, n):
                if key:
                    yield emit()
                key, total = (k, n), np.zeros(2 * BLOCK, np.int64)
            total += np.frombuffer(expand.decompress(data), "<u4")
    if key:
        yield emit()


def _tables(rows: DataFrame, bits_of, orders: int, slots: int, column: str) -> list[np.ndarray]:
    """The tables counted over all rows: fixed sizes."""
    schema = "table int, block int, counts binary"
    blocks = rows.select(column).mapInArrow(_counted(bits_of, orders, slots, column), schema)
    whole = blocks.repartition("table", "block").sortWithinPartitions("table", "block").mapInArrow(_summed, schema).toArrow()
    tables = [np.zeros((slots, 2), np.uint32) for _ in range(orders)]
    expand = zstandard.ZstdDecompressor()
    for k, n, data in zip(*(c.to_pylist() for c in whole.columns), strict=True):
        tables[k][n * BLOCK : (n + 1) * BLOCK] = np.frombuffer(expand.decompress(data), "<u4").reshape(-1, 2)
    return tables


def _learned(rows: DataFrame, bits_of, tables, column: str) -> tuple[np.ndarray, np.ndarray]:
    """Weights and map, averaged over the partitions of all rows; each part starts from the average of those before."""
    gates, inputs = LEVELS * LEVELS, INPUTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        make, (w, apm), ready = bits_of(), fresh(), [left_out(x) for x in tables.value]
        got = {"w": np.zeros((gates, inputs)), "n": np.zeros(gates), "apm_n": np.zeros(APM_STEPS), "apm_y": np.zeros(APM_STEPS)}
        for b in batches:
            for part in _parts(as_bytes(b.column(0))):
                d = make(part)
                mix_bits(d, ready, w, apm, gather=got)
                w = np.where(got["n"][:, None] > 0, got["w"] / np.maximum(got["n"], 1)[:, None], w)
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([x.ravel() for x in got.values()]).tolist()], pa.list_(pa.float64()))], names=["sums"])

    found = rows.select(column).mapInArrow(run, "sums array<double>").select(F.posexplode("sums").alias("k", "x")).groupBy("k").agg(F.sum("x").alias("x")).orderBy("k").toPandas()
    w, apm = fresh()
    if len(found):
        sums = found["x"].to_numpy()
        a = gates * inputs
        seen = sums[a : a + gates]
        w = np.where(seen[:, None] > 0, sums[:a].reshape(gates, inputs) / np.maximum(seen, 1)[:, None], w)
        n, ones = sums[a + gates : a + gates + APM_STEPS], sums[a + gates + APM_STEPS :]
        apm = (ones + 20 * apm) / (n + 20)
    return w, apm


def _parts(texts: list[bytes]) -> Iterator[list[bytes]]:
    part, held = [], 0
    for t in texts:
        part.append(t)
        held += len(t) + 1
        if held >= _SPELLED:
            yield part
            part, held = [], 0
    if part:
        yield part


def _sorted(major: np.ndarray, minor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The order by major and minor; where each differs from the one before, and where its major does."""
    order = np.argsort(major)
    m = major[order]
    new, last = np.ones(len(m), bool), np.ones(len(m), bool)
    new[1:] = m[1:] != m[:-1]
    last[:-1] = new[1:]
    tied = np.flatnonzero(~(new & last))
    few = order[tied]
    order[tied] = few[np.lexsort((minor[few], m[tied]))]
    fresh = new.copy()
    fresh[tied] |= np.concatenate([[True], minor[order[tied[1:]]] != minor[order[tied[1:] - 1]]]) if len(tied) else False
    return order, fresh, new


def _among(x: np.ndarray, few: np.ndarray) -> np.ndarray:
    """Which of x are among a few sorted values."""
    return few[np.minimum(np.searchsorted(few, x), len(few) - 1)] == x


def _rows(b: pa.RecordBatch) -> Iterator[tuple]:
    """A batch's rows, one at a time: each may hold megabytes."""
    for i in range(b.num_rows):
        yield tuple(c[i].as_py() for c in b.columns)


class Words:
    """The tokens of some texts, one after another; each text ends in an end."""

    def __init__(self, texts: list[bytes]):
        split = [t.lower().split() for t in texts]
        self.sizes = np.array([len(w) + 1 for w in split], dtype=np.int64)
        self.flat = [y for x in split for y in x]
        self.first = np.cumsum(self.sizes) - self.sizes
        self.inside = np.ones(int(self.sizes.sum()), bool)
        self.inside[self.first + self.sizes - 1] = False

    def spread(self, values: np.ndarray, end) -> np.ndarray:
        """A value for each word -> for each token."""
        out = np.full(len(self.inside), end, dtype=values.dtype)
        out[self.inside] = values
        return out


class Contexts:
    """Every token's context (the hash of the two tokens before, above ``CHECK`` bits of the third) and symbol (16 bits of its own hash)."""

    def __init__(self, words: Words, bits: int, frequent: np.ndarray, known: tuple | None = None):
        """known: the number of a vocabulary word (-1: none), and the numbers' hashes, which spare the hashing of most words."""
        if known:
            get, hashes = known
            self.number = np.fromiter(map(get, words.flat, repeat(-1)), np.int64, len(words.flat))
            h = hashes[self.number]
            rest = np.flatnonzero(self.number < 0)
            h[rest] = np.fromiter(map(xxhash.xxh3_64_intdigest, [words.flat[i] for i in rest.tolist()]), np.uint64, len(rest))
        else:
            h = np.fromiter(map(xxhash.xxh3_64_intdigest, words.flat), np.uint64, len(words.flat))
        h = words.spread(h, _END)
        back = [h]
        for _ in range(3):
            last = np.concatenate([[_END], back[-1][:-1]])
            last[words.first] = _END
            back.append(last)
        _, one, two, three = back
        key = _context([two, one])
        if len(frequent):
            both = _among(one, frequent)
            both[both] = _among(two[both], frequent)
            key[both] = _context([three[both], key[both]])
        self.of = (key >> np.uint64(64 - bits) << np.uint64(CHECK)) | (_context([three]) >> np.uint64(64 - CHECK))
        self.hash = h
        self.symbol = (h & _SYMBOL).astype(np.uint16)
        self.order, new, _ = _sorted(self.of, self.symbol)
        self.records = np.flatnonzero(new)  # in order: the first of each context and symbol
        self.own = np.empty(len(h), np.int64)  # the record of each token
        self.own[self.order] = np.cumsum(new) - 1


def _planes(x: np.ndarray, width: int) -> bytes:
    """The bytes of whole numbers, the lowest of all first: those that are alike lie together."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _numbers(data: bytes, n: int, at: int, width: int) -> np.ndarray:
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8, n * width, at).reshape(width, n).T
    return out.view("<u8").ravel()


def _state(top: np.ndarray, total: np.ndarray) -> np.ndarray:
    """A context's state, 0 to 30: how often it was seen, and its most frequent token's share."""
    level = np.minimum(np.frexp(total.astype(np.float64))[1], 6)
    share = np.searchsorted([0.25, 0.5, 0.75, 1.0], top / np.maximum(total, 1), side="right")
    return np.where(total > 0, 5 * level - 4 + share, 0).astype(np.uint8)


def _ranked(start: np.ndarray, n: np.ndarray) -> dict[str, np.ndarray]:
    """Groups from start on, each sorted by symbol, with counts -> for every member: rank by count (ties by symbol), the rank of the last that has its count,
    the places of its group's first and second by rank (the first, if there is no second), how many have a count, and the group's count."""
    size = np.diff(np.concatenate([start, [len(n)]]))
    own = np.repeat(start, size)
    rank, tie, first, second = np.zeros(len(n), np.int64), np.zeros(len(n), np.int64), own.copy(), own.copy()
    at = np.flatnonzero(np.repeat(size > 1, size))
    if len(at):
        order = at[np.lexsort((-n[at], own[at]))]  # stable: ties stay in order of symbols
        place = np.arange(len(order))
        new = np.concatenate([[True], own[order[1:]] != own[order[:-1]]])
        head = np.maximum.accumulate(np.where(new, place, 0))
        rank[order] = place - head
        change = np.flatnonzero(np.concatenate([[True], (n[order[1:]] != n[order[:-1]]) | new[1:]]))
        last = np.concatenate([change[1:], [len(order)]]) - 1
        tie[order] = np.repeat(last, np.diff(np.concatenate([change, [len(order)]]))) - head
        first[order], second[order] = order[head], order[head + 1]
    return {"n": n, "rank": rank, "tie": tie, "first": first, "second": second, "kinds": np.repeat(np.add.reduceat((n > 0).astype(np.int64), start), size), "total": np.repeat(np.add.reduceat(n, start), size)}


def _said(three: dict, two: dict, leave_out: bool) -> tuple[np.ndarray, np.ndarray]:
    """Two bytes for each record: the state of three tokens, whether two agree with it (32), one less than the questions (by 64); the state of two tokens, the outcome (by 32).

    The outcome is the number of the question that is answered with yes, or 0.
    With leave_out, one occurrence of the record is taken away; it then stays before others with as many.
    """
    far = np.int64(1 << 40)
    less = int(leave_out)
    states, ranks, known = [], [], []
    for e in (three, two):
        here = e["n"] > less
        rank = np.where(here, e["tie"] if leave_out else e["rank"], far)
        led = (e["rank"] == 0) & leave_out
        top = np.where(led, np.where(rank == 0, e["n"] - less, e["n"][e["second"]]), e["n"][e["first"]])
        total = e["total"] - less
        states.append(_state(top, total))
        ranks.append(rank)
        known.append(total > 0)
    hit = known[0] & (ranks[0] == 0)
    asked = np.where((three["rank"] == 0) & ~hit, three["second"], three["first"]) if leave_out else three["first"]
    place = two["rank"][asked]  # of the first question's token among those of two tokens
    if leave_out:
        place = np.where(asked == np.arange(len(asked)), ranks[1], place - ((two["rank"] < place) & (ranks[1] >= place)))
    listed = np.minimum(TOP, two["kinds"] - (leave_out & (two["n"] == 1)))
    named = ranks[1] < TOP
    outcome = np.where(known[0], np.where(hit, 1, np.where(named, 2 + ranks[1] - (place < ranks[1]), 0)), np.where(known[1] & named, ranks[1] + 1, 0))
    questions = np.where(known[0], 1 + listed - (place < TOP), np.where(known[1], listed, 1))
    agree = known[0] & (place == 0)
    return (states[0] | agree.astype(np.uint8) << 5 | (questions - 1).astype(np.uint8) << 6), (states[1] | outcome.astype(np.uint8) << 5)


def _alone(n: np.ndarray) -> np.ndarray:
    """What contexts say of their only symbol, seen so many times: the four bytes of answers."""
    out = np.zeros((4, len(n)), np.uint8)
    for k in (0, 1):
        seen = n > k
        state = _state(n - k, n - k)[seen]
        out[2 * k, seen], out[2 * k + 1, seen] = state | 32, state | 32
    return out


def answers(blobs: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Records (context, symbol, training count) of one shard, by chunk -> what all of them together say of each: four bytes, of which two leave it out."""
    of, symbol, n = (np.concatenate(c) for c in zip(*blobs, strict=True))
    order, new, _ = _sorted(of, symbol)
    start = np.flatnonzero(new)
    n = np.add.reduceat(n[order], start)
    of, symbol = of[order[start]], symbol[order[start]]
    key = of >> np.uint64(CHECK)
    first = np.concatenate([[True], key[1:] != key[:-1]])
    alone = first & np.concatenate([first[1:], [True]])
    out = np.empty((4, len(of)), np.uint8)
    out[:, alone] = _alone(n[alone])
    several = np.flatnonzero(~alone)
    if len(several):
        out[:, several] = _of_several(of[several], key[several], symbol[several], n[several])
    whole = np.empty((4, len(order)), np.uint8)
    whole[:, order] = out[:, np.cumsum(new) - 1]
    return np.split(whole, np.cumsum([len(b[0]) for b in blobs])[:-1], axis=1)


def _of_several(of: np.ndarray, key: np.ndarray, symbol: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The same for distinct records, sorted, of contexts of two tokens that have several."""
    three = _ranked(np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])), n)
    order, new, new_key = _sorted(key, symbol)
    at = np.flatnonzero(new)
    two = _ranked(np.flatnonzero(new_key[at]), np.add.reduceat(n[order], at))
    back = np.empty(len(key), np.int64)
    back[order] = np.cumsum(new) - 1
    head = order[at]  # a record of each pair of key and symbol: first and second are looked up by place
    two = {name: v[back] for name, v in two.items()}
    two["first"], two["second"] = head[two["first"]], head[two["second"]]
    return np.stack([*_said(three, two, False), *_said(three, two, True)])


def _runs(outcome: np.ndarray, first: np.ndarray) -> np.ndarray:
    """How many tokens before each one, in its text, were the first question's token; ``RUNS`` - 1 at most."""
    place = np.arange(len(outcome))
    stop = np.where(outcome != 1, place, -1)
    before = np.concatenate([[-1], stop[:-1]])
    before[first] = first - 1
    return np.minimum(place - 1 - np.maximum.accumulate(before), RUNS - 1)


def decisions(said: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Two bytes for each token -> the decisions' cells, gates and bits, and how many each token has."""
    three, agree, two, outcome = said[0] & 31, said[0] >> 5 & 1, said[1] & 31, said[1] >> 5
    many = np.where(two == 0, 0, np.where(outcome > 0, outcome, (said[0] >> 6) + 1)).astype(np.int64)
    run = _runs(outcome, first)
    token = np.repeat(np.arange(len(outcome)), many)
    number = np.arange(len(token)) - np.repeat(np.cumsum(many) - many, many)
    known3, two = three[token].astype(np.int64), two[token]
    kind = np.where(number > 0, 3, np.where(known3 == 0, 0, 2 - agree.astype(np.int64)[token]))
    three = np.where(number > 0, number + 4 * (known3 > 0), known3)
    run = run[token]
    return run * CELLS + kind * 1024 + three * 32 + two, run * KINDS + kind, outcome[token] == number + 1, many


def predictors(hits: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Hit rates of all cells -> each cell's log-odds: by the state of three tokens, by that of two, by both, and a constant."""
    h, n = (x.reshape(RUNS, KINDS, 32, 32).astype(np.float64) for x in (hits, n))
    kind = ((h.sum(axis=(2, 3)) + 0.5) / (n.sum(axis=(2, 3)) + 1))[:, :, None]
    three = ((h.sum(axis=3) + 2 * kind) / (n.sum(axis=3) + 2))[:, :, :, None]
    two = ((h.sum(axis=2) + 2 * kind) / (n.sum(axis=2) + 2))[:, :, None, :]
    both = (h + three + two) / (n + 2)
    odds = [np.log(p / (1 - p)) for p in (three + 0 * both, two + 0 * both, both)]
    return np.stack([*odds, np.full(both.shape, 0.3)], axis=-1).reshape(-1, INPUTS).astype(np.float32)


def _chunk_type(id_type: DataType) -> StructType:
    lists = [("uids", LongType()), ("held", BooleanType()), ("sizes", LongType()), ("ids", id_type)]
    return StructType([StructField("chunk", LongType()), *[StructField(n, ArrayType(t)) for n, t in lists], StructField("body", BinaryType())])


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (uid, held out, text, id) -> chunks of texts, compressed."""
    press = zstandard.ZstdCompressor(level=1)
    held: list[tuple] = []
    size = 0

    def emit() -> pa.RecordBatch:
        uids, out, texts, ids = zip(*held, strict=True)
        lists = [pa.array([x], pa.list_(t)) for x, t in ((uids, pa.int64()), (out, pa.bool_()), ([len(t) for t in texts], pa.int64()), (ids, id_type))]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array([uids[0]], pa.int64()), *lists, pa.array([press.compress(b"".join(texts))], pa.binary())], names=["chunk", "uids", "held", "sizes", "ids", "body"])

    for b in batches:
        id_type = b.schema.field(3).type
        for row in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), as_bytes(b.column(2)), b.column(3).to_pylist(), strict=True):
            held.append(row)
            size += len(row[2]) + 1
            if size >= _BODY:
                yield emit()
                size = 0
    if held:
        yield emit()


def _texts(sizes: list[int], body: bytes) -> list[bytes]:
    whole, at, out = zstandard.ZstdDecompressor().decompress(body), 0, []
    for n in sizes:
        out.append(whole[at : at + n])
        at += n
    return out


def _words_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks -> the counts of their training words."""

    def emit() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["word", "c"])
        held.clear()
        return out

    counted: Counter = Counter()
    held = counted
    for b in batches:
        for out, sizes, body in _rows(b):
            for text in (t for t, o in zip(_texts(sizes, body), out, strict=True) if not o):
                held.update(text.lower().split())
                if len(held) > 200_000:
                    yield emit()
    if held:
        yield emit()
    release()


def _alike(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Words and counts -> the counts of all words of each symbol."""
    total = np.zeros(int(_SYMBOL) + 1, np.int64)
    for b in batches:
        words = as_bytes(b.column(0))
        hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
        np.add.at(total, (hashes & _SYMBOL).astype(np.int64), np.asarray(b.column(1)))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at], pa.int64())], names=["symbol", "total"])


def _known(vocabulary: dict) -> tuple:
    return {w: k for k, w in enumerate(vocabulary["words"], 1)}.get, vocabulary["hash"]


def _recorded(bits: int, shards: int, frequent, vocabulary):
    """Chunks -> their records for each shard: contexts (differences of sorted hashes), how many symbols each has, symbols, training counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, known = zstandard.ZstdCompressor(level=1), _known(vocabulary.value)
        for b in batches:
            for chunk, out, sizes, body in _rows(b):
                words = Words(_texts(sizes, body))
                c = Contexts(words, bits, frequent.value, known)
                train = np.repeat(~np.array(out, bool), words.sizes)
                n = np.bincount(c.own, weights=train, minlength=len(c.records)).astype(np.int64)
                first = c.order[c.records]
                of, symbol = c.of[first], c.symbol[first]
                cut = np.searchsorted(of, (np.arange(shards + 1, dtype=np.uint64) << np.uint64(bits + CHECK - shards.bit_length() + 1))[:-1])
                rows = []
                for k, (i, j) in enumerate(zip(cut.tolist(), [*cut[1:].tolist(), len(of)])):
                    if i < j:
                        start = np.flatnonzero(np.concatenate([[True], of[i + 1 : j] != of[i : j - 1]]))
                        mine = of[i:j][start]
                        data = [_planes(np.diff(mine, prepend=np.uint64(0)), 8), _planes(np.diff(np.concatenate([start, [j - i]])), 4), symbol[i:j].astype("<u2").tobytes(), _planes(n[i:j], 4)]
                        rows.append((k, chunk, len(start), j - i, press.compress(b"".join(data))))
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), kinds, strict=True)], names=["shard", "chunk", "contexts", "records", "data"])
                del words, c
        release()

    return run


def _answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of _recorded with every shard whole in the partition, sorted by it -> what the shard says of each chunk's records."""
    expand, press = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1)
    held: list[tuple] = []

    def emit() -> Iterator[pa.RecordBatch]:
        blobs = []
        for _, _, contexts, records, data in held:
            raw = expand(data)
            of = np.repeat(np.cumsum(_numbers(raw, contexts, 0, 8)), _numbers(raw, contexts, 8 * contexts, 4).astype(np.int64))
            blobs.append((of, np.frombuffer(raw, "<u2", records, 12 * contexts), _numbers(raw, records, 12 * contexts + 2 * records, 4).astype(np.int64)))
        said = [press.compress(np.ascontiguousarray(x).tobytes()) for x in answers(blobs)]
        yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in held], pa.int64()), pa.array([r[0] for r in held], pa.int32()), pa.array(said, pa.binary())], names=["chunk", "shard", "said"])
        held.clear()

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            if held and held[0][0] != row[0]:
                yield from emit()
            held.append(row)
    if held:
        yield from emit()
    release()


_DOCUMENT = "uid long, n_bytes long, n_tokens long, known long, base double, named double, said binary, words array<binary>, n array<long>, m array<long>, cells array<long>, hits array<long>, seen array<long>"


def _decided(bits: int, frequent, vocabulary):
    """Chunks with what is said of their records -> a row per document, and a row (uid -1) with the hit rates of the cells."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, expand = vocabulary.value, zstandard.ZstdDecompressor().decompress
        numbers = _known(known)
        names = [x.split()[0] for x in _DOCUMENT.split(", ")]
        kinds = [pa.int64()] * 4 + [pa.float64()] * 2 + [pa.binary(), pa.list_(pa.binary())] + [pa.list_(pa.int64())] * 5
        hits, seen = np.zeros(RUNS * CELLS, np.int64), np.zeros(RUNS * CELLS, np.int64)

        def made(columns: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=names)

        for b in batches:
            for uids, out, sizes, body, said in _rows(b):
                words = Words(_texts(sizes, body))
                first = words.first
                c = Contexts(words, bits, frequent.value, numbers)
                blobs = [np.frombuffer(expand(x["said"]), np.uint8).reshape(4, -1) for x in sorted(said, key=lambda x: x["shard"])]
                of_token = np.concatenate(blobs, axis=1)[:, c.own]
                hashes, symbols = c.hash, words.spread(c.number, 0)
                del c, blobs
                train = np.repeat(~np.array(out, bool), words.sizes)
                if train.any():
                    own = np.flatnonzero(~np.array(out, bool))
                    size = words.sizes[own]
                    cell, _, y, _ = decisions(of_token[2:, train], np.cumsum(size) - size)
                    hits += np.bincount(cell, weights=y, minlength=len(hits)).astype(np.int64)
                    seen += np.bincount(cell, minlength=len(seen))
                missed = of_token[1] >> 5 == 0  # not expected: it has to be named
                inside = symbols >= 0
                total = lambda x, kind=None: np.add.reduceat(x, first, dtype=kind)  # noqa: E731, B023
                rare = np.flatnonzero(~inside)
                doc = np.searchsorted(first, rare, side="right") - 1
                order, fresh, _ = _sorted(doc.astype(np.uint64), hashes[rare])
                start = np.flatnonzero(fresh)
                head = rare[order[start]]
                of_word = (np.cumsum(words.inside) - 1)[head].tolist()
                offsets = np.concatenate([[0], np.cumsum(np.bincount(doc[order[start]], minlength=len(uids)))]).astype(np.int32)
                counts = [np.diff(np.concatenate([start, [len(rare)]])), np.add.reduceat(missed[rare][order].astype(np.int64), start) if len(start) else start]
                lists = [pa.ListArray.from_arrays(offsets, pa.array(x, t)) for x, t in (([words.flat[i] for i in of_word], pa.binary()), (counts[0], pa.int64()), (counts[1], pa.int64()))]
                # rare words where their bits were expected, as if all were known; for the others it is taken back where they are spelled
                alike = known["alike"][(hashes[rare][order[start]] & _SYMBOL).astype(np.int64)]
                alike = np.bincount(doc[order[start]], weights=(counts[0] - counts[1]) * alike, minlength=len(uids))
                ends = first + words.sizes
                bytes_of = [np.ascontiguousarray(of_token[:2, i:j]).tobytes() for i, j in zip(first.tolist(), ends.tolist())]
                nothing = [None] * len(uids)
                yield made([uids, sizes, words.sizes, total(inside & known["seen"][symbols], np.int64), total(np.where(inside, known["base"][symbols], 0)), total(np.where(inside, np.where(missed, known["naming"][symbols], known["within"][symbols]), 0)) + alike, bytes_of, *lists, nothing, nothing, nothing])
        at = np.flatnonzero(seen)
        if len(at):
            yield made([[-1], *[[None]] * 9, [at.tolist()], [hits[at].tolist()], [seen[at].tolist()]])
        release()

    return run


def _weighed(table):
    """Rows (uid, said) -> the documents' costs of decisions in bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, apm = np.tile(START_WEIGHTS, (RUNS * KINDS, 1)), fresh()[1]
        for b in batches:
            out, part, size = [], [], 0

            def flush(part: list[bytes]) -> np.ndarray:
                sizes = np.array([len(x) // 2 for x in part])
                first = np.cumsum(sizes) - sizes
                said = np.concatenate([np.frombuffer(x, np.uint8).reshape(2, -1) for x in part], axis=1)
                cell, gate, y, many = decisions(said, first)
                length = np.add.reduceat(many, first)
                return mixed(table.value.take(cell, axis=0), gate, y, np.cumsum(length) - length, length, weights, apm)

            for x in b.column(1).to_pylist():
                part.append(x)
                size += len(x)
                if size >= _CHUNK:
                    out.append(flush(part))
                    part, size = [], 0
            if part:
                out.append(flush(part))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.concatenate(out) if out else [], pa.float64())], names=["uid", "bits"])
        release()

    return run


def _spelled(tables, mixer, vocabulary):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, apm = mixer
        for b in batches:
            words = as_bytes(b.column(0))
            costs = [mix_bits(spelling_bits(part), tables.value, w, apm) for part in _parts(words)]
            symbols = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)) & _SYMBOL
            alike = vocabulary.value["alike"][symbols.astype(np.int64)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(-LOG2 * np.concatenate(costs) if costs else [], pa.float64()), pa.array(alike)], names=["word", "spelling", "alike"])

    return run


def score(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", fold: int = 10, vocabulary_size: int = VOCABULARY, shard: int = SHARD, frequent_from: int = FREQUENT) -> DataFrame:
    """A row per document: id, held_out, n_bytes, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte."""
    spark = docs.sparkSession
    own = with_row_id(docs.select(F.col(id_column).alias("doc"), F.col(text_column).alias("body")))
    own = own.select("uid", (crc_mod(F.col("doc"), fold) == 0).alias("held"), "body", "doc")
    chunks = materialize(own.mapInArrow(_bodies, _chunk_type(docs.schema[id_column].dataType)), "chunks")
    rows = chunks.select(F.explode(F.arrays_zip("uids", "held", "ids")).alias("x")).select(F.col("x.uids").alias("uid"), "x.held", F.col("x.ids").alias(id_column))
    counts = materialize(chunks.select("held", "sizes", "body").mapInArrow(_words_counted, "word binary, c long").groupBy("word").agg(F.sum("c").alias("c")), "word-counts")
    train_docs = rows.where("NOT held").count()
    # the vocabulary's least count: counts fall in at most 2000 steps
    steps = counts.groupBy(F.floor(F.log2("c") * 32).alias("step")).agg(F.count("*").alias("n"), F.sum("c").alias("all_c"), F.min("c").alias("least"), F.count_if(F.col("c") == 1).alias("once")).orderBy(F.desc("step")).collect()
    words = sum(r["n"] for r in steps)
    tokens = sum(r["all_c"] for r in steps) + train_docs
    least, taken = 1 << 62, 0
    for r in steps:
        taken += r["n"]
        if taken > vocabulary_size:
            break
        least = r["least"]
    top = sorted(((r["c"], bytes(r["word"])) for r in counts.where(F.col("c") >= least).collect()), key=lambda x: (-x[0], x[1]))
    c_top = np.array([train_docs, *[c for c, _ in top]], dtype=np.float64)
    novel = min(0.5, max(1e-3, sum(r["once"] for r in steps) / tokens)) if tokens else 0.5  # the share of unseen words
    spread = np.log10(tokens + 0.1 * (words + (train_docs > 0) + 1))
    one = np.log10((1 - novel) / (tokens + 1))  # a word with a count of one; the end has one more
    naming = np.log10(c_top + (np.arange(len(c_top)) == 0)) + one
    # the training tokens of each symbol: at most 65,536 sums
    alike = np.zeros(int(_SYMBOL) + 1)
    for r in counts.mapInArrow(_alike, "symbol int, total long").groupBy("symbol").agg(F.sum("total").alias("total")).collect():
        alike[r["symbol"]] = r["total"]
    alike[int(_END & _SYMBOL)] += train_docs + 1
    alike = np.log10(1 - novel) - np.log10(np.maximum(alike, 1))
    hashes = np.array([_END, *map(xxhash.xxh3_64_intdigest, (w for _, w in top))], np.uint64)
    within = np.log10(c_top + (np.arange(len(c_top)) == 0)) + alike[(hashes & _SYMBOL).astype(np.int64)]
    vocabulary = spark.sparkContext.broadcast(
        {"words": [w for _, w in top], "base": np.log10(c_top + 0.1) - spread, "naming": naming, "within": within, "alike": alike, "seen": c_top > 0, "hash": hashes}
    )
    frequent = spark.sparkContext.broadcast(np.array([xxhash.xxh3_64_intdigest(w) for c, w in top if c > frequent_from], np.uint64))
    bits, shards = min(48, max(16, int(tokens).bit_length() + 4)), 1 << (int(tokens) // shard).bit_length()
    records = chunks.select("chunk", "held", "sizes", "body").mapInArrow(_recorded(bits, shards, frequent, vocabulary), "shard int, chunk long, contexts long, records long, data binary")
    answered = materialize(records.repartition("shard").sortWithinPartitions("shard").mapInArrow(_answered, "chunk long, shard int, said binary"), "answers")
    said = answered.groupBy("chunk").agg(F.collect_list(F.struct("shard", "said")).alias("said"))
    decided = materialize(chunks.join(said, "chunk").select("uids", "held", "sizes", "body", "said").mapInArrow(_decided(bits, frequent, vocabulary), _DOCUMENT), "decided")
    discard(answered)
    cells = decided.where("uid < 0").select(F.explode(F.arrays_zip("cells", "hits", "seen")).alias("x")).groupBy("x.cells").agg(F.sum("x.hits").alias("hits"), F.sum("x.seen").alias("seen")).collect()
    hits, seen = np.zeros(RUNS * CELLS), np.zeros(RUNS * CELLS)
    for r in cells:
        hits[r["cells"]], seen[r["cells"]] = r["hits"], r["seen"]
    table = spark.sparkContext.broadcast(predictors(hits, seen))
    found = decided.where("uid >= 0")
    weighed = found.select("uid", "said").mapInArrow(_weighed(table), "uid long, bits double")
    # words outside the vocabulary: by their count, or spelled
    rare = counts.where(F.col("c") < least)
    spell_of = lambda: spelling_bits
    spell_counted = spark.sparkContext.broadcast(_tables(rare, spell_of, 3, SPELL_SLOTS, "word"))
    spell = spark.sparkContext.broadcast([packed(x) for x in spell_counted.value])
    speller = _learned(rare, spell_of, spell_counted, "word")
    asked = found.select("uid", F.explode(F.arrays_zip("words", "n", "m")).alias("x")).select("uid", F.col("x.words").alias("word"), "x.n", "x.m")
    named = materialize(asked.join(rare, "word", "left").select("uid", F.when(F.col("c").isNull(), F.col("word")).alias("word"), "n", "m", "c"), "rare-words")
    spelled = named.where("word is not null").select("word").distinct().mapInArrow(_spelled(spell, speller, vocabulary), "word binary, spelling double, alike double")
    by_count = F.col("n") * F.log10(F.col("c").cast("double")) + F.col("m") * float(one)
    sums = [F.sum(F.when(F.col("c").isNotNull(), F.col("n")).otherwise(0)).alias("more_known"), F.sum(F.col("n") * (F.log10(F.coalesce("c", F.lit(0)) + 0.1) - float(spread))).alias("more_base"), F.sum(F.when(F.col("c").isNotNull(), by_count).otherwise(0.0)).alias("more_score")]
    extra = named.groupBy("uid").agg(*sums)
    unseen = named.where("word is not null").select("uid", "word", "n", "m").join(spelled, "word")
    unseen = unseen.groupBy("uid").agg(F.sum(F.col("n") * (F.col("spelling") + float(np.log10(novel))) - (F.col("n") - F.col("m")) * F.col("alike")).alias("more_spelling"))
    joined = rows.join(found.select("uid", "n_bytes", "n_tokens", "known", "base", "named").join(weighed, "uid").join(extra, "uid", "left").join(unseen, "uid", "left"), "uid")
    zero = lambda c: F.coalesce(c, F.lit(0))
    total = F.col("named") - F.col("bits") * float(LOG2) + zero("more_score") + zero("more_spelling")
    return joined.select(id_column, F.col("held").alias("held_out"), "n_bytes", "n_tokens", (F.col("known") + zero("more_known")).alias("n_known"), F.lit(int(tokens)).cast("long").alias("train_tokens"), (F.col("base") + zero("more_base")).alias("base_score"), total.alias("score"), F.when(F.col("n_bytes") > 0, -total / float(LOG2) / F.col("n_bytes")).alias("bits_per_byte"))
