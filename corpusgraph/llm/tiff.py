"""TIFF media columns: writing, and reading one row per page.

The reader walks the image directories of a file of either byte order, and
decodes strips or tiles that are stored plainly or by PackBits, LZW or deflate,
undoes horizontal and floating-point predictors, and returns each page's
samples. The writer stores samples in the same layouts.

Cases: a null or damaged file gives one row with page -1 and the error's text,
a directory that refers to itself ends the walk, a page that claims more
samples than ``MAX_SAMPLES`` is an error; null and empty texts are payloads of
64 zero bytes; no rows give no rows.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes

NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
WIDTH = 64
MAX_SAMPLES = 1 << 31
# fixed values: TIFF 6.0 tags and field sizes
WIDTH_TAG, HEIGHT_TAG, BITS_TAG, COMPRESSION_TAG, PHOTOMETRIC_TAG, OFFSETS_TAG, SAMPLES_TAG, ROWS_TAG, COUNTS_TAG, PLANAR_TAG, PREDICTOR_TAG = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317
TILE_WIDTH_TAG, TILE_HEIGHT_TAG, TILE_OFFSETS_TAG, TILE_COUNTS_TAG, FORMAT_TAG = 322, 323, 324, 325, 339
FIELD_SIZES = {1: 1, 2: 1, 3: 2, 4: 4, 5: 8, 6: 1, 7: 1, 8: 2, 9: 4, 10: 8, 11: 4, 12: 8}
FIELD_CODES = {1: "B", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i"}


class TiffError(ValueError):
    pass


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at, n, made = [], 0, len(data), 0
    while at < n and made < size:
        head = data[at]
        if head < 128:
            part = data[at + 1 : at + 2 + head]
            at += 2 + head
        elif head > 128:
            part = data[at + 1 : at + 2] * (257 - head)
            at += 2
        else:
            at += 1
            continue
        out.append(part)
        made += len(part)
    return b"".join(out)[:size]


def pack_bits(data: bytes) -> bytes:
    a = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(a)) + 1
    out, plain = [], bytearray()

    def flush() -> None:
        for i in range(0, len(plain), 128):
            part = plain[i : i + 128]
            out.append(bytes([len(part) - 1]) + part)
        plain.clear()

    for start, end in zip([0, *edges.tolist()], [*edges.tolist(), len(a)], strict=True):
        run = end - start
        if run < 3:
            plain += data[start:end]
            continue
        flush()
        for i in range(0, run, 128):
            n = min(128, run - i)
            out.append(bytes([257 - n if n > 1 else 0, data[start]]))
    flush()
    return b"".join(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, high bit first; 256 clears, 257 ends; the width grows one code early."""
    base = [bytes([i]) for i in range(256)] + [b"", b""]
    table, width, held, have, at, made, last, out = list(base), 9, 0, 0, 0, 0, None, []
    n = len(data)
    while made < size:
        while have < width:
            if at >= n:
                return b"".join(out)[:size]
            held = (held << 8 | data[at]) & 0xFFFFFF
            have += 8
            at += 1
        code = held >> (have - width) & ((1 << width) - 1)
        have -= width
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, None
            continue
        if last is None:
            if code > 255:
                raise TiffError("damaged LZW data")
            piece = table[code]
        elif code < len(table):
            piece = table[code]
            table.append(last + piece[:1])
        elif code == len(table):
            piece = last + last[:1]
            table.append(piece)
        else:
            raise TiffError("damaged LZW data")
        out.append(piece)
        made += len(piece)
        last = piece
        if len(table) + 1 >= 1 << width and width < 12:
            width += 1
    return b"".join(out)[:size]


def lzw_encode(data: bytes) -> bytes:
    table, following, width, bits, have, out = {}, 258, 9, 0, 0, bytearray()

    def put(code: int) -> None:
        nonlocal bits, have
        bits = bits << width | code
        have += width
        while have >= 8:
            have -= 8
            out.append(bits >> have & 255)
        bits &= (1 << have) - 1

    put(256)
    prefix = -1
    for byte in data:
        if prefix < 0:
            prefix = byte
            continue
        code = table.get((prefix, byte))
        if code is not None:
            prefix = code
            continue
        put(prefix)
        table[prefix, byte] = following
        following += 1
        if following == 4094:
            put(256)
            table, following, width = {}, 258, 9
        elif following >= 1 << width:
            width += 1
        prefix = byte
    if prefix >= 0:
        put(prefix)
        following += 1
        if following >= 1 << width and width < 12:
            width += 1
    put(257)
    if have:
        out.append(bits << (8 - have) & 255)
    return bytes(out)


def _compress(data: bytes, how: int) -> bytes:
    if how == NONE:
        return data
    if how == LZW:
        return lzw_encode(data)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.compress(data, 1)
    if how == PACKBITS:
        return pack_bits(data)
    raise TiffError(f"compression {how} is not supported")


def _expand(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data[:size]
    if how == LZW:
        return lzw_decode(data, size)
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    if how == PACKBITS:
        return unpack_bits(data, size)
    raise TiffError(f"compression {how} is not supported")


def _undo(block: bytes, rows: int, cols: int, samples: int, kind: np.dtype, predictor: int) -> np.ndarray:
    """A stored block's samples, rows x cols x samples, in the machine's byte order."""
    if predictor == 3:
        raw = np.frombuffer(block, np.uint8).reshape(rows, cols * kind.itemsize, samples)
        plane = np.add.accumulate(raw, axis=1, dtype=np.uint8).reshape(rows, kind.itemsize, cols, samples)
        return np.ascontiguousarray(plane.transpose(0, 2, 3, 1)).view(kind.newbyteorder(">"))[..., 0].astype(kind.newbyteorder("="))
    image = np.frombuffer(block, kind).reshape(rows, cols, samples)
    if predictor == 2:
        image = np.add.accumulate(image, axis=1, dtype=kind.newbyteorder("="))
    elif predictor != 1:
        raise TiffError(f"predictor {predictor} is not supported")
    return image.astype(kind.newbyteorder("="), copy=False)


def _difference(image: np.ndarray, predictor: int) -> np.ndarray:
    if predictor == 2:
        out = image.copy()
        out[:, 1:] = image[:, 1:] - image[:, :-1]
        return out
    return image


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int = 128, tile: tuple[int, int] | None = None, order: str = "<") -> bytes:
    """Pages of unsigned samples (height x width, or with a third axis of samples), as strips or as tiles (height, width; multiples of 16)."""
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(f"{order}HI", 42, 0))
    link = 4
    for page in pages:
        image = page.reshape(*page.shape[:2], -1)
        high, wide, samples = image.shape
        stored = image.astype(image.dtype.newbyteorder(order))
        blocks = []
        if tile:
            padded = np.pad(image, ((0, -high % tile[0]), (0, -wide % tile[1]), (0, 0)))
            blocks = [padded[y : y + tile[0], x : x + tile[1]] for y in range(0, high, tile[0]) for x in range(0, wide, tile[1])]
        else:
            blocks = [image[y : y + rows_per_strip] for y in range(0, high, rows_per_strip)]
        offsets, counts = [], []
        for block in blocks:
            data = _compress(_difference(block, predictor).astype(stored.dtype).tobytes(), compression)
            offsets.append(len(out))
            counts.append(len(data))
            out += data + b"\0" * (len(data) & 1)
        fields = {WIDTH_TAG: [wide], HEIGHT_TAG: [high], BITS_TAG: [8 * image.dtype.itemsize] * samples, COMPRESSION_TAG: [compression], PHOTOMETRIC_TAG: [2 if samples == 3 else 1], SAMPLES_TAG: [samples], PREDICTOR_TAG: [predictor]}
        fields |= {TILE_WIDTH_TAG: [tile[1]], TILE_HEIGHT_TAG: [tile[0]], TILE_OFFSETS_TAG: offsets, TILE_COUNTS_TAG: counts} if tile else {OFFSETS_TAG: offsets, ROWS_TAG: [rows_per_strip], COUNTS_TAG: counts}
        entries, late = [], []
        for tag, values in sorted(fields.items()):
            code, kind = ("I", 4) if max(values) > 65535 or tag in (OFFSETS_TAG, COUNTS_TAG, TILE_OFFSETS_TAG, TILE_COUNTS_TAG) else ("H", 3)
            packed = struct.pack(f"{order}{len(values)}{code}", *values)
            entries.append((tag, kind, len(values), packed))
            late.append(len(packed) > 4)
        at = len(out)
        struct.pack_into(f"{order}I", out, link, at)
        after = at + 2 + 12 * len(entries) + 4
        body, tail = bytearray(struct.pack(f"{order}H", len(entries))), bytearray()
        for (tag, kind, n, packed), big in zip(entries, late, strict=True):
            body += struct.pack(f"{order}HHI", tag, kind, n) + (struct.pack(f"{order}I", after + len(tail)) if big else packed.ljust(4, b"\0"))
            if big:
                tail += packed + b"\0" * (len(packed) & 1)
        link = at + len(body)
        out += body + b"\0\0\0\0" + tail
    return bytes(out)


def _directory(data: bytes, at: int, order: str) -> tuple[dict[int, list[int]], int]:
    (n,) = struct.unpack_from(f"{order}H", data, at)
    fields = {}
    for i in range(n):
        tag, kind, count = struct.unpack_from(f"{order}HHI", data, at + 2 + 12 * i)
        if kind not in FIELD_CODES:
            continue
        size = FIELD_SIZES[kind] * count
        place = at + 10 + 12 * i
        if size > 4:
            (place,) = struct.unpack_from(f"{order}I", data, place)
        if place + size > len(data):
            raise TiffError(f"tag {tag} lies outside the file")
        fields[tag] = list(struct.unpack_from(f"{order}{count}{FIELD_CODES[kind]}", data, place))
    (following,) = struct.unpack_from(f"{order}I", data, at + 2 + 12 * n)
    return fields, following


def read_tiff(data: bytes) -> Iterator[tuple[dict[int, list[int]], np.ndarray]]:
    """Each page's fields and samples (height x width x samples)."""
    if data[:2] not in (b"II", b"MM"):
        raise TiffError("no TIFF byte order mark")
    order = "<" if data[:2] == b"II" else ">"
    magic, at = struct.unpack_from(f"{order}HI", data, 2)
    if magic != 42:
        raise TiffError("no TIFF number")
    seen = set()
    while at and at not in seen:
        seen.add(at)
        fields, following = _directory(data, at, order)
        one = lambda tag, default=None, fields=fields: fields.get(tag, [default])[0]
        wide, high, samples, how, predictor = one(WIDTH_TAG), one(HEIGHT_TAG), one(SAMPLES_TAG, 1), one(COMPRESSION_TAG, 1), one(PREDICTOR_TAG, 1)
        bits = fields.get(BITS_TAG, [1])
        if not wide or not high or len(set(bits)) > 1 or bits[0] not in (8, 16, 32) or wide * high * samples > MAX_SAMPLES:
            raise TiffError(f"a page of {wide} x {high} x {samples} samples of {bits[0]} bits is not supported")
        kind = np.dtype(f"{order}{'f' if one(FORMAT_TAG, 1) == 3 else 'i' if one(FORMAT_TAG, 1) == 2 else 'u'}{bits[0] // 8}")
        planes = samples if one(PLANAR_TAG, 1) == 2 else 1
        each = 1 if planes > 1 else samples
        tiled = TILE_OFFSETS_TAG in fields
        step_y, step_x = (one(TILE_HEIGHT_TAG), one(TILE_WIDTH_TAG)) if tiled else (min(one(ROWS_TAG, high), high), wide)
        places = list(zip(fields[TILE_OFFSETS_TAG if tiled else OFFSETS_TAG], fields[TILE_COUNTS_TAG if tiled else COUNTS_TAG], strict=True))
        grid = [(p, y, x) for p in range(planes) for y in range(0, high, step_y) for x in range(0, wide, step_x)]
        if len(places) < len(grid):
            raise TiffError("strips or tiles are missing")
        image = np.zeros((high, wide, samples), kind.newbyteorder("="))
        for (p, y, x), (offset, count) in zip(grid, places, strict=False):
            rows = step_y if tiled else min(step_y, high - y)
            size = rows * step_x * each * kind.itemsize
            block = _expand(data[offset : offset + count], how, size)
            if len(block) < size:
                raise TiffError("a strip or tile is too short")
            part = _undo(block, rows, step_x, each, kind, predictor)[: high - y, : wide - x]
            image[y : y + part.shape[0], x : x + part.shape[1], p : p + each] = part
        yield fields, image
        at = following


def _encode(id_column: str, text_column: str, width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sizes, media = [], []
            for text in as_bytes(b.column(b.schema.get_field_index(text_column))):
                sizes.append(len(text))
                payload = text + b"\0" * (-len(text) % width or (0 if text else width))
                media.append(write_tiff([np.frombuffer(payload, np.uint8).reshape(-1, width)], DEFLATE, 2))
            yield pa.RecordBatch.from_arrays([b.column(b.schema.get_field_index(id_column)), pa.array(sizes, pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])

    return run


def encode_texts(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", width: int = WIDTH) -> DataFrame:
    """id, n_bytes, media: each text's bytes, padded with zeros to whole rows, as the 8-bit samples of a one-page TIFF."""
    return docs.select(F.col(id_column).cast("long").alias(id_column), text_column).mapInArrow(_encode(id_column, text_column, width), "id long, n_bytes long, media binary")


def feature(image: np.ndarray) -> str:
    """Mean, deviation, and which of 64 equal spans of the samples are brighter than the mean."""
    flat = image.reshape(-1)
    spans = flat.reshape(64, -1).mean(axis=1) if len(flat) % 64 == 0 else np.resize(flat, 64)
    return f"{flat.mean():.4f};{flat.std():.4f};{np.packbits(spans > flat.mean()).tobytes().hex()}"


_PAGE = "page int, width int, height int, samples int, bits int, compression int, predictor int"


def _read(media_column: str, pixels: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, pages, rest = [], [], []
            for i, media in enumerate(b.column(b.schema.get_field_index(media_column)).to_pylist()):
                found = []
                try:
                    if media is None:
                        raise TiffError("no file")
                    for n, (fields, image) in enumerate(read_tiff(media)):
                        raw = image.tobytes()
                        how = (fields.get(COMPRESSION_TAG, [1])[0], fields.get(PREDICTOR_TAG, [1])[0])
                        own = (raw,) if pixels else (len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-64:]), feature(image))
                        found.append(((n, image.shape[1], image.shape[0], image.shape[2], 8 * image.dtype.itemsize, *how), (None, *own)))
                except (TiffError, struct.error, zlib.error, KeyError, ValueError, TypeError, MemoryError) as error:
                    # the pages before the damage stay
                    found += [((-1, *[None] * 6), (str(error) or type(error).__name__, *[None] * (1 if pixels else 4)))]
                at += [i] * len(found)
                pages += [x for x, _ in found]
                rest += [x for _, x in found]
            kept = b.take(pa.array(at, pa.int32()))
            media = kept.column(b.schema.get_field_index(media_column))
            drop = [n for n in b.schema.names if n != media_column]
            columns = [*[kept.column(b.schema.get_field_index(n)) for n in drop]]
            names = list(drop)
            if not pixels:
                known = media.to_pylist()
                columns += [pa.array([None if m is None else len(m) for m in known], pa.int64()), pa.array([None if m is None else hashlib.sha256(m).hexdigest() for m in known], pa.string())]
                names += ["media_bytes", "media_sha256"]
            columns += [pa.array([p[k] for p in pages], pa.int32()) for k in range(7)]
            names += [x.split()[0] for x in _PAGE.split(", ")]
            kinds = [pa.string(), pa.binary()] if pixels else [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string()]
            columns += [pa.array([r[k] for r in rest], t) for k, t in enumerate(kinds)]
            names += ["error", "pixels"] if pixels else ["error", "payload_bytes", "payload_sha256", "tail_crc32", "feature"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _schema(df: DataFrame, media_column: str, added: str):
    from pyspark.sql.types import StructType

    return StructType([f for f in df.schema.fields if f.name != media_column] + StructType.fromDDL(added).fields)


def read_pages(df: DataFrame, media_column: str = "media") -> DataFrame:
    """df's other columns with one row per page: its number from 0, its shape, and its samples."""
    return df.mapInArrow(_read(media_column, True), _schema(df, media_column, f"{_PAGE}, error string, pixels binary"))


def page_features(df: DataFrame, media_column: str = "media") -> DataFrame:
    """As read_pages, with digests and features of the samples in place of them."""
    added = f"media_bytes long, media_sha256 string, {_PAGE}, error string, payload_bytes long, payload_sha256 string, tail_crc32 long, feature string"
    return df.mapInArrow(_read(media_column, False), _schema(df, media_column, added))
