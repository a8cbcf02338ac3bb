"""Removing repeated byte strings by merging Burrows-Wheeler transforms.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else. Finding these strings takes three steps, all exact.

1. Candidates. Every window of ``LENGTH`` bytes is assigned to its anchor, the
   32-byte gram with the smallest hash in it, leftmost first. Windows that have
   the anchor in their first half, and those that have it in their second, all
   cover the same 116 bytes or more around it: their core. Neighbouring windows
   of one core form a piece. Equal windows have equal cores, so pieces are
   sorted by the hash of their core and then by their own digest: a core that
   occurs once has no repeated window, and pieces that are equal in full are
   repeated as a whole. The sort is by range, so a core with very many pieces
   spreads over partitions; what lies on their edges goes on to step 2.
2. Merge. Pieces that share a core with different pieces are compared: dealt by
   the core, each task puts them into shards in turn, so that pieces of one
   core lie in different ones, builds each shard's suffix array and
   Burrows-Wheeler transform, and merges the transforms by refining their
   interleave (Holt and McMillan 2014): sorting the interleaved characters
   stably sorts the suffixes by one more character. The round in which a
   suffix parts from all others gives the length of what they have in common;
   a block still together after ``LENGTH`` rounds is a repeated interval.
   Suffixes are never compared again across shards.
3. The repeated windows return to their documents, where their union goes.

A task merges about half a megabyte of pieces at a time. A core with more than ``GROUP``
differing pieces (at the edges of a passage that very many documents share) is
refined first: its pieces are halved by their windows' distance from the
anchor, and each half has a longer core, by which it is sorted and dealt anew.
After at most eight halvings a piece is a single window, its own core.

Cases: null text is empty; texts under ``LENGTH`` bytes keep all; repeated rows
repeat each other's strings; a null id is kept as it is; matches never cross
documents; no rows give no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, discard, materialize, with_row_id

LENGTH, GRAM, GROUP, SHARD = 200, 32, 8192, 1 << 16
_TASK, _STRIDE = 1 << 19, 1 << 18
_FEW = 1_000_000  # refined cores whose hashes may be broadcast


def _gram_hashes(text: bytes, gram: int) -> np.ndarray:
    """A hash of every gram of the text."""
    n = len(text)
    m = n - gram + 1
    if gram != GRAM:
        return np.fromiter((xxhash.xxh64_intdigest(text[i : i + gram]) for i in range(m)), np.uint64, m)
    eight = np.empty(n - 7, np.uint64)
    for r in range(8):
        eight[r::8] = np.frombuffer(text, "<u8", (n - r) // 8, r)
    h = eight[:m] * np.uint64(0x9E3779B97F4A7C15)
    for k in (8, 16, 24):
        h ^= h >> np.uint64(29)
        h += eight[k : k + m]
        h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def anchors(text: bytes, length: int = LENGTH) -> np.ndarray:
    """The place of each window's anchor."""
    gram = min(GRAM, length)
    width, windows = length - gram + 1, len(text) - length + 1
    if windows < 1:
        return np.zeros(0, np.int64)
    out = []
    for base in range(0, windows, _STRIDE):
        part = text[base : base + _STRIDE + length - 1]
        h = _gram_hashes(part, gram)
        value = (h >> np.uint64(20) << np.uint64(20)) | np.arange(len(h), dtype=np.uint64)  # of equal hashes, the leftmost is smallest
        size = 1
        while size * 2 <= width:
            value = np.minimum(value[size:], value[:-size])
            size *= 2
        if rest := width - size:
            value = np.minimum(value[rest:], value[:-rest])
        out.append((value & np.uint64((1 << 20) - 1)).astype(np.int64) + base)
    return np.concatenate(out)


def pieces(text: bytes, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The pieces of a text: first and last window, and the first and last window that their core allows."""
    at = anchors(text, length)
    if not len(at):
        return (np.zeros(0, np.int64),) * 4
    change = np.flatnonzero(at[1:] != at[:-1]) + 1
    first, last = np.concatenate([[0], change]), np.concatenate([change - 1, [len(at) - 1]])
    a, reach = at[first], length - min(GRAM, length)
    half = (reach + 1) // 2
    mid = a - half  # the last window with the anchor in its second half
    left, right = first <= mid, last > mid
    parts = [
        (first[left], np.minimum(last, mid)[left], (a - reach)[left], mid[left]),
        (np.maximum(first, mid + 1)[right], last[right], (mid + 1)[right], a[right]),
    ]
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


_PIECE = "h long, digest long, uid long, first long, last long, low long, high long, c int"


def _hashes(slices: Iterator[bytes], n: int) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, slices), np.uint64, n).view(np.int64)


def _named(schema: str, columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], names=[x.split()[0] for x in schema.split(", ")])


def _pieces(length: int):
    """Rows (uid, body) -> their pieces, under the hash of their cores."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            columns: list[list[np.ndarray]] = [[] for _ in range(7)]
            for uid, body in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                text = expand(body)
                first, last, low, high = pieces(text, length)
                n = len(first)
                if n:
                    core = _hashes((text[i : j + length] for i, j in zip(high.tolist(), low.tolist())), n)
                    own = _hashes((text[i : j + length] for i, j in zip(first.tolist(), last.tolist())), n)
                    for c, x in zip(columns, (core, own, np.full(n, uid), first, last, low, high), strict=True):
                        c.append(x)
            if columns[0]:
                flat = [np.concatenate(c) for c in columns]
                yield _named(_PIECE, [*flat, np.ones(len(flat[0]), np.int32)])

    return run


_RUN = "kind int, " + _PIECE


def _decided(t: pa.Table, at_start: bool, at_end: bool) -> pa.RecordBatch:
    h, d, c = (t.column(k).to_numpy() for k in ("h", "digest", "c"))
    new_h = np.concatenate([[True], h[1:] != h[:-1]])
    new_d = new_h | np.concatenate([[True], d[1:] != d[:-1]])
    start = np.flatnonzero(new_d)
    times = np.add.reduceat(c, start)
    edge = np.zeros(len(start), bool)
    edge[0] |= at_start
    edge[-1] |= at_end
    first_of = np.flatnonzero(new_h[start])  # each core's first digest
    kinds = np.diff(np.concatenate([first_of, [len(start)]]))
    open_core = (kinds > 1) & (np.minimum.reduceat(times, first_of) == 1) | np.logical_or.reduceat(edge, first_of)
    open_run = np.repeat(open_core, kinds)
    whole = np.flatnonzero(np.repeat(times > 1, np.diff(np.concatenate([start, [len(h)]]))) & (c == 1))
    kept = np.concatenate([whole, start[open_run]])
    out = t.take(pa.array(kept)).combine_chunks()
    kind = np.repeat(np.array([0, 1], np.int32), [len(whole), len(kept) - len(whole)])
    known = np.concatenate([np.full(len(whole), 2), np.minimum(times[open_run], 2)]).astype(np.int32)
    out = out.set_column(out.schema.get_field_index("c"), "c", pa.array(known)).add_column(0, "kind", pa.array(kind))
    return pa.RecordBatch.from_arrays([x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in out.columns], names=out.schema.names)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces sorted by h, digest -> kind 0: those repeated as a whole; kind 1: one of each digest, for cores with several.

    The first and the last digest of a partition may go on in its neighbours,
    so that one piece of each is always of kind 1. c is 2 for pieces known to be repeated.
    """
    held: list[pa.RecordBatch] = []  # pieces of one core
    at_start = True
    for b in batches:
        if not b.num_rows:
            continue
        h = b.column(0).to_numpy()
        cut = int(np.searchsorted(h, h[-1]))  # where the batch's last core begins
        if not cut and (not held or held[0].column(0)[0].as_py() == h[0]):
            held.append(b)
            continue
        done = [*held, b.slice(0, cut)]
        yield _decided(pa.Table.from_batches(done), at_start, False)
        held, at_start = [b.slice(cut)], False
    if held:
        yield _decided(pa.Table.from_batches(held), at_start, True)


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """The order of a shard's suffixes by at least their first depth symbols (under 512 each), by prefix doubling; ties by place."""
    n, size = len(text), 6
    padded = np.concatenate([text.astype(np.int64), np.zeros(size, np.int64)])
    key = np.zeros(n, np.int64)
    for k in range(size):
        key = key << 9 | padded[k : n + k]
    order = np.argsort(key, kind="stable")
    tied = key[order]
    fresh = np.concatenate([[True], tied[1:] != tied[:-1]])
    rank = np.empty(n, np.int64)
    while True:
        first = np.flatnonzero(fresh)
        group = np.repeat(first, np.diff(np.concatenate([first, [n]])))
        rank[order] = group  # the group's first place
        alone = fresh & np.concatenate([fresh[1:], [True]])
        at = np.flatnonzero(~alone)
        if size >= depth or not len(at):
            return order
        own = order[at]
        ahead = np.where(own + size < n, rank[np.minimum(own + size, n - 1)] + 1, 0)
        key = group[at] * (n + 1) + ahead
        again = np.argsort(key, kind="stable")  # groups stay where they are
        order[at], key = own[again], key[again]
        fresh[at[1:]] |= key[1:] != key[:-1]
        size *= 2


def merged_blocks(shards: list[np.ndarray], depth: int, starts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Merge the shards' transforms for the suffixes at starts: which are equal to others in depth symbols, their blocks, and what all have in common with others.

    A suffix enters as the one that lies depth symbols after it. In a round,
    every entry reads its transform's symbol, that of the place before it, and
    a stable sort of these symbols sorts all entries by one more symbol; each
    moves on by its transform's mapping. Entries of one block with one symbol
    form a block of the next round. Those alone in their block leave: the round
    is the length of the longest prefix that the suffix they have reached
    shares with any other, and nothing before it can be repeated.

    Returns the repeated suffixes' places in the joined shards and their blocks,
    in merged order, and for the window at each place of the joined shards how
    many of its last symbols it shares with another (-1: not asked).
    """
    base = np.cumsum([0, *map(len, shards)])
    transforms, maps, entries, places = [], [], [], []
    for text, at, offset in zip(shards, starts, base[:-1].tolist(), strict=True):
        order = suffix_array(text, depth + 1)
        rank = np.empty(len(text), np.int64)
        rank[order] = np.arange(len(text))
        transforms.append(text[order - 1])
        maps.append((rank[order - 1] + offset).astype(np.int32))
        places.append((order + offset).astype(np.int32))
        entries.append((np.sort(rank[at + depth]) + offset).astype(np.int32))
    symbols, mapping, place = np.concatenate(transforms), np.concatenate(maps), np.concatenate(places)
    entry = np.concatenate(entries)
    block = np.zeros(len(entry), np.int32)
    common = np.full(int(base[-1]), -1, np.int16)
    for done in range(depth):
        if len(entry) < 2:
            common[place[entry] + done - depth] = done
            return entry[:0], block[:0], common
        symbol = symbols.take(entry)
        order = np.argsort(symbol, kind="stable")
        moved, own = symbol.take(order), block.take(order)
        split = np.empty(len(entry) + 1, bool)
        split[0] = split[-1] = True
        split[1:-1] = (moved[1:] != moved[:-1]) | (own[1:] != own[:-1])
        alone = split[:-1] & split[1:]
        block = np.cumsum(split[:-1], dtype=np.int32)
        entry = mapping.take(entry.take(order))
        if alone.any():
            common[place[entry[alone]] + (done + 1 - depth)] = done
            block, entry = block[~alone], entry[~alone]
    common[place[entry]] = depth
    return place[entry], block, common


def repeated_windows(pieces: list[bytes], length: int, shard: int = SHARD) -> list[np.ndarray]:
    """For each piece, which of its windows occur at least twice in all pieces. Pieces are put into shards in turn."""
    number = max(1, -(-sum(len(p) + 1 for p in pieces) // shard))
    turn = np.argsort(np.arange(len(pieces)) % number, kind="stable")
    sizes = np.array([len(pieces[i]) + 1 for i in turn])
    at = np.cumsum(sizes) - sizes
    flat = np.zeros(int(sizes.sum()), np.uint16)  # symbol 0 ends a piece
    flat[np.arange(len(flat)) != np.repeat(at + sizes - 1, sizes)] = np.frombuffer(b"".join([pieces[i] for i in turn]), np.uint8).astype(np.uint16) + 1
    first_of = np.flatnonzero(np.concatenate([[True], np.diff(turn % number) > 0]))
    cuts = [*at[first_of].tolist(), len(flat)]
    counts = sizes - length  # windows of each piece
    own = np.repeat(np.arange(len(pieces)), counts)
    start = at[own] + np.arange(len(own)) - np.repeat(np.cumsum(counts) - counts, counts)
    edge = np.searchsorted(start, cuts)
    shards = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
    place, _, _ = merged_blocks(shards, length, [start[i:j] - a for i, j, a in zip(edge, edge[1:], cuts)])
    hit = np.zeros(len(flat), bool)
    hit[place] = True
    out: list = [None] * len(pieces)
    for k, i, n in zip(turn.tolist(), at.tolist(), counts.tolist(), strict=True):
        out[k] = hit[i : i + n]
    return out


def _spans(flags: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true flags as (first, last)."""
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()))


_CUT = _PIECE + ", piece binary"
_FOUND = "uid long, first long, last long"


def _merge(length: int):
    """Rows (h, uid, first, c, piece) with every h whole in the partition, sorted by it -> repeated windows of the pieces that occur once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def emit() -> pa.RecordBatch:
            flags = repeated_windows([r[4] for r in held], length)
            rows = [(r[1], r[2] + a, r[2] + b) for r, f in zip(held, flags, strict=True) if r[3] == 1 and f.any() for a, b in _spans(f)]
            return _named(_FOUND, [pa.array([r[k] for r in rows], pa.int64()) for k in range(3)])

        last = None
        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if size >= _TASK and row[0] != last:
                    yield emit()
                    held, size = [], 0
                held.append(row)
                size += len(row[4])
                last = row[0]
        if held:
            yield emit()

    return run


def _cut(length: int):
    """Documents with the pieces asked of them -> the pieces with their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        kinds = (pa.int64(),) * 7 + (pa.int32(), pa.binary())
        for b in batches:
            out = []
            for uid, body, asked in zip(*(c.to_pylist() for c in b.columns), strict=True):
                text = expand(body)
                out += [(x["h"], x["digest"], uid, x["first"], x["last"], x["low"], x["high"], x["c"], text[x["first"] : x["last"] + length]) for x in asked]
            yield _named(_CUT, [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)])

    return run


def _halves(length: int):
    """Pieces -> their halves by the windows' distance from the anchor, each under its longer core."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashed = xxhash.xxh3_64_intdigest
        kinds = (pa.int64(),) * 7 + (pa.int32(), pa.binary())
        for b in batches:
            out = []
            for _, _, uid, first, last, low, high, c, piece in zip(*(x.to_pylist() for x in b.columns), strict=True):
                mid = (low + high) // 2
                for a, z in ((low, mid), (mid + 1, high)):
                    i, j = max(first, a), min(last, z)
                    if i <= j:
                        own = piece[i - first : j - first + length]
                        core = hashed(own[z - i : a + length - i] if a < z else own, z - a)
                        out.append((core - (1 << 63), hashed(own) - (1 << 63), uid, i, j, a, z, c, own))
            yield _named(_CUT, [pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)])

    return run


def _pressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts are kept, and shuffled, compressed."""
    press = zstandard.ZstdCompressor(level=3)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([press.compress(t) for t in as_bytes(b.column(1))], pa.binary()), b.column(2)], names=["doc", "body", "uid"])


def _kept(length: int, keep_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        expand = zstandard.ZstdDecompressor().decompress
        for b in batches:
            rows = []
            for text, found in zip(map(expand, b.column(1).to_pylist()), b.column(2).to_pylist(), strict=True):
                n = len(text)
                if not found:
                    rows.append((n, 0, 0, hashlib.sha256(text).hexdigest(), text if keep_text else None))
                    continue
                edge = np.zeros(n + 1, np.int32)
                np.add.at(edge, [x["first"] for x in found], 1)
                np.add.at(edge, [x["last"] + length for x in found], -1)
                gone = np.cumsum(edge[:n]) > 0
                kept = np.frombuffer(text, np.uint8)[~gone].tobytes()
                rows.append((n, int(gone.sum()), len(_spans(gone)), hashlib.sha256(kept).hexdigest(), kept if keep_text else None))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]], names=["doc", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])

    return run


def _sorted_runs(pieces: DataFrame, schema: str, name: str) -> DataFrame:
    """kind, and the columns of pieces, which are materialized: a range sort samples its input."""
    dealt = pieces.repartitionByRange("h", "digest", "uid", "first").sortWithinPartitions("h", "digest")
    return materialize(dealt.mapInArrow(_runs, "kind int, " + schema), name)


def _of_cores(rows: DataFrame, cores: DataFrame, few: bool, how: str) -> DataFrame:
    return rows.join(F.broadcast(cores) if few else cores, "h", how)


def remove_repeats(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", length: int = LENGTH, keep_text: bool = False, group: int = GROUP) -> DataFrame:
    """A row per document: id, n_bytes, n_removed, n_spans, kept_sha256, and with keep_text the remaining bytes."""
    own = with_row_id(docs.select(F.col(id_column).cast("long").alias("doc"), F.col(text_column).alias("body")))
    bodies = materialize(own.mapInArrow(_pressed, "doc long, body binary, uid long"), "bodies")
    first = materialize(bodies.select("uid", "body").mapInArrow(_pieces(length), _PIECE), "pieces")
    runs = _sorted_runs(first, _PIECE, "piece-runs")
    discard(first)
    found = [runs.where("kind = 0").select("uid", "first", "last")]
    asked = runs.where("kind = 1").groupBy("uid").agg(F.collect_list(F.struct("h", "digest", "first", "last", "low", "high", "c")).alias("asked"))
    cut = materialize(bodies.select("uid", "body").join(asked, "uid").mapInArrow(_cut(length), _CUT), "open-pieces")
    while True:  # at most eight times: a half of a piece has half the windows
        hot = materialize(cut.groupBy("h").agg(F.count("*").alias("n"), F.max(F.col("high") - F.col("low")).alias("wide")).where((F.col("n") > group) & (F.col("wide") > 0)).select("h"), "hot-cores")
        n = hot.count()
        rest = _of_cores(cut, hot, n <= _FEW, "left_anti") if n else cut
        dealt = rest.select("h", "uid", "first", "c", "piece").repartition("h").sortWithinPartitions("h")
        found.append(materialize(dealt.mapInArrow(_merge(length), _FOUND), "merged"))
        if not n:
            break
        halves = materialize(_of_cores(cut, hot, n <= _FEW, "left_semi").mapInArrow(_halves(length), _CUT), "halves")
        split = _sorted_runs(halves, _CUT, "half-runs")
        discard(halves, hot)
        found.append(split.where("kind = 0").select("uid", "first", "last"))
        cut = split.where("kind = 1").drop("kind")
    spans = found[0]
    for more in found[1:]:
        spans = spans.unionByName(more)
    joined = bodies.join(spans.groupBy("uid").agg(F.collect_set(F.struct("first", "last")).alias("found")), "uid", "left").select("doc", "body", "found")
    out = joined.mapInArrow(_kept(length, keep_text), "doc long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary")
    return out.select(F.col("doc").alias(id_column), "n_bytes", "n_removed", "n_spans", "kept_sha256", *(["kept"] if keep_text else []))
