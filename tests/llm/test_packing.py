import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from corpusgraph.llm import packing

from .conftest import odd_rows

VOCABULARY, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
SLOW = Tokenizer.from_file(VOCABULARY)
FAST = packing.tokenizer(VOCABULARY, RANKS)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(" \n\t'sab1Ü²!　\xa0<|>"), st.characters(exclude_categories=("Cs",))), max_size=40))
def test_tokenizer_gives_the_vocabulary_ids(text):
    assert np.frombuffer(FAST(text), "<u4").tolist() == SLOW.encode(text, add_special_tokens=False).ids


def test_special_string():
    assert np.frombuffer(FAST("a <|endoftext|> b"), "<u4").tolist() == SLOW.encode("a <|endoftext|> b", add_special_tokens=False).ids


@pytest.mark.parametrize("limit", [1, 3, 512])
def test_pieces_and_sequences(odd, limit):
    rows = packing.pack(odd.repartition(3), VOCABULARY, RANKS, capacity=64, open_bins=limit).collect()
    docs = {}
    for r in odd_rows():
        docs.setdefault(r[0], []).append(SLOW.encode(r[1] or "", add_special_tokens=False).ids + [2])
    want = []
    for doc, several in docs.items():
        for ids in several:
            first = len(ids) % 64 or 64
            cuts = [0, *range(first, len(ids) + 1, 64)]
            want += [(doc, k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))]
    assert sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=str) == sorted(want, key=str)
    bins = {}
    for r in rows:
        bins.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in bins.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 64


def test_fullest_closes_first():
    bins = packing.Bins(10, 2)
    assert bins.place(6, 0) == (0, 0) and bins.place(7, 1) == (1, 0)
    assert bins.place(8, 2) == (2, 0)  # bin 1, the fullest, has closed
    assert bins.place(3, 3) == (0, 6) and bins.place(2, 4) == (2, 8)


@pytest.mark.parametrize("share", [40, 100_000])
def test_second_round_in_shares(spark, share):
    docs = spark.createDataFrame([(i, "w " * (i % 50)) for i in range(600)], "doc_id long, text string").repartition(20)
    rows = packing.pack(docs, VOCABULARY, RANKS, capacity=64, share=share).collect()
    used = {}
    for r in rows:
        used.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for parts in used.values():
        parts.sort()
        assert [o for o, _ in parts] == [sum(n for _, n in parts[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= 64
    assert len(rows) == len({(r.doc_id, r.piece) for r in rows}) and sum(r.length for r in rows) / (64 * len(used)) > 0.85


def test_a_million_open_bins_keep_little():
    """The second round holds its open bins only."""
    import tracemalloc

    import pyarrow as pa

    def batches():
        for k in range(100):
            yield pa.RecordBatch.from_arrays([pa.array(range(k * 10_000, (k + 1) * 10_000), pa.int64()), pa.array([600 + (i * 7919) % 400 for i in range(10_000)], pa.int64())], names=["sequence_id", "used"])

    tracemalloc.start()
    rows = sum(b.num_rows for b in packing._again(1024, 512)(batches()))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == 1_000_000 and peak < 10_000_000


def test_empty_table(empty):
    assert packing.pack(empty, VOCABULARY, RANKS).count() == 0


def test_the_order_of_rows_changes_no_place(spark):
    """The second round's bins in two orders of arrival."""
    import random

    from pyspark.sql import functions as F

    used = [(i, 1 + i * 7919 % 63) for i in range(3000)]
    runs = []
    for seed in (1, 2):
        random.Random(seed).shuffle(used)
        df = spark.createDataFrame(used, "sequence_id long, used long").repartition(seed + 2).repartition(2, "sequence_id").sortWithinPartitions(F.xxhash64("sequence_id"), "sequence_id")
        runs.append(sorted(tuple(r) for r in df.mapInArrow(packing._again(64, 16), "sequence_id long, to_id long, shift long").collect()))
    assert runs[0] == runs[1]
