import hashlib
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusgraph.llm import tiff

from .conftest import odd_rows

CODECS = [tiff.NONE, tiff.LZW, tiff.DEFLATE, tiff.OLD_DEFLATE, tiff.PACKBITS]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.binary(min_size=1, max_size=3), st.integers(1, 300)), max_size=30))
def test_codecs_round_trip(parts):
    data = b"".join(a * n for a, n in parts)
    assert tiff.unpack_bits(tiff.pack_bits(data), len(data)) == data
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_lzw_fills_its_table():
    data = np.random.default_rng(1).integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    assert tiff.lzw_decode(tiff.lzw_encode(data), len(data)) == data


def test_known_packbits():
    assert tiff.unpack_bits(bytes.fromhex("FEAA0280002AFDAA0380002A22F7AA"), 24) == bytes.fromhex("AAAAAA80002AAAAAAAAA80002A22AAAAAAAAAAAAAAAAAAAA")


@pytest.mark.parametrize("how", CODECS)
@pytest.mark.parametrize("order", ["<", ">"])
@pytest.mark.parametrize("predictor", [1, 2])
def test_pages_strips_and_tiles(how, order, predictor):
    rng = np.random.default_rng(how)
    pages = [rng.integers(0, 9, (37, 50), dtype=np.uint8), rng.integers(0, 70000, (20, 33, 3)).astype(np.uint16), rng.integers(0, 255, (1, 1), dtype=np.uint8)]
    for tile in (None, (16, 32)):
        data = tiff.write_tiff(pages, how, predictor, 8, tile, order)
        got = [image for _, image in tiff.read_tiff(data)]
        assert len(got) == 3
        for a, b in zip(pages, got):
            assert (a.reshape(b.shape) == b).all() and a.dtype == b.dtype


def test_floating_point_predictor():
    image = np.random.default_rng(2).normal(size=(5, 7)).astype("<f4")
    planes = np.ascontiguousarray(image.astype(">f4")).view(np.uint8).reshape(5, 7, 4).transpose(0, 2, 1).reshape(5, 28)
    stored = planes.copy()
    stored[:, 1:] = planes[:, 1:] - planes[:, :-1]
    assert (tiff._undo(stored.tobytes(), 5, 7, 1, np.dtype("<f4"), 3)[..., 0] == image).all()


def test_damaged_files(spark):
    good = tiff.write_tiff([np.zeros((4, 64), np.uint8)] * 2)
    rows = [(1, None), (2, b""), (3, b"II*\0"), (4, good[:-20]), (5, good), (6, b"junk" * 9)]
    got = tiff.read_pages(spark.createDataFrame(rows, "id long, media binary")).collect()
    assert {r.id: r.page for r in got if r.page < 0} == {1: -1, 2: -1, 3: -1, 4: -1, 6: -1} and all(r.error for r in got if r.page < 0)
    assert [(r.page, r.width, r.height, bytes(r.pixels)) for r in got if r.id == 5] == [(0, 64, 4, b"\0" * 256), (1, 64, 4, b"\0" * 256)]
    loop = bytearray(good)
    at = int.from_bytes(good[4:8], "little")
    entries = int.from_bytes(good[at : at + 2], "little")
    loop[at + 2 + 12 * entries : at + 6 + 12 * entries] = good[4:8]
    assert len(list(tiff.read_tiff(bytes(loop)))) == 1


def test_texts(odd, empty):
    rows = tiff.page_features(tiff.encode_texts(odd)).collect()
    want = []
    for doc, text, *_ in odd_rows():
        raw = (text or "").encode()
        padded = raw + b"\0" * (-len(raw) % 64 or (0 if raw else 64))
        want.append((doc, len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-64:])))
    assert sorted(((r.id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in rows), key=str) == sorted(want, key=str)
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})
    assert tiff.page_features(tiff.encode_texts(empty)).count() == 0


def test_pages_before_the_damage_stay(spark):
    pages = [np.full((9, 8, 1), k, np.uint8) for k in (1, 2)]
    data = tiff.write_tiff(pages, tiff.DEFLATE, 1, 8, None, "<")
    rows = tiff.read_pages(spark.createDataFrame([(n, data[:n]) for n in range(8, len(data), 3)] + [(len(data), data)], "id long, media binary")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.id, []).append(r.page)
    assert sorted(by[len(data)]) == [0, 1] and [0, -1] in by.values()
    assert all(p[-1] == -1 and p[:-1] == list(range(len(p) - 1)) for n, p in by.items() if n < len(data) and -1 in p)
    assert all(bytes(r.pixels) == bytes([1]) * 72 for r in rows if r.page == 0)
