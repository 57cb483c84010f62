"""TIFF media columns: a directory walker and decoder that emits one row per page.

Classic and BigTIFF files of either byte order; strips and tiles; chunky and planar
samples of 1, 2, 4, 8, 16, 32 or 64 bits, whole or floating; either fill order; no
compression, PackBits, LZW and deflate; the horizontal and the floating-point predictor.
``encode_tiff`` writes files for storage and for the round-trip tests.

Pages are decoded one by one: one that cannot be read gives a row whose ``error`` says why,
and the pages after it are read all the same.  A page that claims more samples than its
stored bytes can hold is refused before any memory is taken for it.

Defined results: a null medium gives no page; a damaged header or a broken chain of
directories gives an error row after the pages before it; a null text is stored as an empty
one; a very long text becomes a file of several pages; repeated rows are stored each, equal
texts as equal files; an empty table gives an empty result; columns besides the identifier
and the medium are not read, whatever their names.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import map_slices

# Fixed values of the format: tag numbers, field types and compression schemes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC = 256, 257, 258, 259, 262
STRIP_OFFSETS, SAMPLES, ROWS_PER_STRIP, STRIP_SIZES, PLANAR = 273, 277, 278, 279, 284
PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_OFFSETS, TILE_SIZES = 317, 322, 323, 324, 325
FILL_ORDER, SAMPLE_FORMAT = 266, 339
RAW, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
FIELD = {1: "B", 2: "s", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 13: "I", 16: "Q", 17: "q", 18: "Q"}

CLEAR, END = 256, 257
#: No scheme makes more than so many bytes of one (the longest LZW entry takes 12 bits).
MOST_EXPANSION = 4096
#: Rows of 64 samples on a page of a stored text.
PAGE_ROWS = 4096


@dataclass
class Page:
    """One decoded page: samples as (height, width, samples)."""

    index: int
    compression: int
    predictor: int
    pixels: np.ndarray


def unpack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += 2 + head
        elif head > 128:
            out += data[i + 1 : i + 2] * (257 - head)
            i += 2
        else:
            i += 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        run = 1
        while run < 128 and i + run < n and data[i + run] == data[i]:
            run += 1
        if run > 2:
            out += bytes([257 - run, data[i]])
            i += run
            continue
        j = i
        while j < n and j - i < 128 and not (j + 2 < n and data[j] == data[j + 1] == data[j + 2]):
            j += 1
        out += bytes([j - i - 1]) + data[i:j]
        i = j
    return bytes(out)


def lzw_decode(data: bytes) -> bytes:
    """Codes from the most significant bit on, 9 to 12 bits wide, one early change."""
    first = [bytes([i]) for i in range(256)] + [b"", b""]
    words, out, old = list(first), [], b""
    width, held, bits = 9, 0, 0
    for byte in data:
        held = (held << 8 | byte) & 0xFFFFFF
        bits += 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits & (1 << width) - 1
        if code == CLEAR:
            words, width, old = list(first), 9, b""
            continue
        if code == END:
            break
        if code < len(words):
            entry = words[code]
        elif code == len(words) and old:
            entry = old + old[:1]
        else:
            raise ValueError("LZW code out of range")
        if old:
            words.append(old + entry[:1])
        out.append(entry)
        old = entry
        width = 9 if len(words) < 511 else 10 if len(words) < 1023 else 11 if len(words) < 2047 else 12
    return b"".join(out)


def lzw_encode(data: bytes) -> bytes:
    codes: dict[bytes, int] = {}
    held, bits, out = 0, 0, bytearray()
    width, size = 9, 258

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 0xFF)
        held &= (1 << bits) - 1

    put(CLEAR)
    word = b""
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if len(longer) == 1 or longer in codes:
            word = longer
            continue
        put(word[0] if len(word) == 1 else codes[word])
        codes[longer] = size
        size += 1
        if size >= 4095:
            put(CLEAR)
            codes, width, size = {}, 9, 258
        else:
            width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
        word = data[i : i + 1]
    if word:
        put(word[0] if len(word) == 1 else codes[word])
        size += 1
        width = 9 if size < 512 else 10 if size < 1024 else 11 if size < 2048 else 12
    put(END)
    if bits:
        out.append(held << 8 - bits & 0xFF)
    return bytes(out)


def _expand(data: bytes, scheme: int, size: int) -> bytes:
    """The first ``size`` bytes of what is stored."""
    if scheme == RAW:
        out = data
    elif scheme == PACKBITS:
        out = unpack_bits(data)
    elif scheme == LZW:
        out = lzw_decode(data)
    elif scheme in (DEFLATE, OLD_DEFLATE):
        out = zlib.decompressobj().decompress(data, size) if size else b""
    else:
        raise ValueError(f"compression {scheme} is not known")
    if len(out) < size:
        raise ValueError("the stored bytes end before the page does")
    return out[:size]


def _shrink(data: bytes, scheme: int) -> bytes:
    return {RAW: lambda d: d, PACKBITS: pack_bits, LZW: lzw_encode, DEFLATE: lambda d: zlib.compress(d, 1)}[scheme](data)


def directories(blob: bytes) -> Iterator[tuple[str, dict[int, tuple]]]:
    """The byte order and the fields of each image directory, in file order."""
    order = {b"II": "<", b"MM": ">"}.get(blob[:2])
    if not order or len(blob) < 8:
        raise ValueError("no TIFF header")
    magic = struct.unpack_from(order + "H", blob, 2)[0]
    if magic not in (42, 43):
        raise ValueError("no TIFF header")
    big = magic == 43
    count, entry, word = ("Q", 20, "Q") if big else ("H", 12, "I")
    at, seen = struct.unpack_from(order + word, blob, 8 if big else 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("the directories form a loop")
        seen.add(at)
        n = struct.unpack_from(order + count, blob, at)[0]
        base = at + struct.calcsize(order + count)
        fields = {}
        for i in range(n):
            tag, kind, many = struct.unpack_from(order + "HH" + word, blob, base + i * entry)
            if kind not in FIELD:
                continue
            place = base + i * entry + (12 if big else 8)
            layout = f"{order}{many}{FIELD[kind]}"
            if struct.calcsize(layout) > (8 if big else 4):
                place = struct.unpack_from(order + word, blob, place)[0]
            fields[tag] = struct.unpack_from(layout, blob, place)
        yield order, fields
        at = struct.unpack_from(order + word, blob, base + n * entry)[0]


class Unreadable(Exception):
    """A page that cannot be decoded: its number and why."""


DAMAGE = (ValueError, KeyError, IndexError, TypeError, OverflowError, MemoryError, struct.error, zlib.error)
REVERSED = np.packbits(np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1)[:, ::-1], axis=1).ravel()


def _decoded(blob: bytes, order: str, f: dict[int, tuple], index: int) -> Page:
    width, height, samples = f[WIDTH][0], f[HEIGHT][0], f.get(SAMPLES, (1,))[0]
    bits, forms = set(f.get(BITS, (1,))), set(f.get(SAMPLE_FORMAT, (1,)))
    if len(bits) > 1 or not bits <= {1, 2, 4, 8, 16, 32, 64} or len(forms) > 1:
        raise ValueError(f"samples of {sorted(bits)} bits and forms {sorted(forms)}")
    bits, form = bits.pop(), forms.pop()
    if form == 3 and bits < 16:
        raise ValueError(f"floating samples of {bits} bits")
    dtype = np.dtype(f"{order}{ {2: 'i', 3: 'f'}.get(form, 'u') if bits >= 8 else 'u'}{max(1, bits // 8)}")
    scheme, predictor = f.get(COMPRESSION, (RAW,))[0], f.get(PREDICTOR, (1,))[0]
    planes = samples if f.get(PLANAR, (1,))[0] == 2 else 1
    depth = samples // planes
    tiled = TILE_OFFSETS in f
    across, down = (f[TILE_WIDTH][0], f[TILE_HEIGHT][0]) if tiled else (width, min(height, f.get(ROWS_PER_STRIP, (height,))[0]))
    offsets, sizes = (f[TILE_OFFSETS], f[TILE_SIZES]) if tiled else (f[STRIP_OFFSETS], f[STRIP_SIZES])
    if not (width and height and samples and across and down):
        raise ValueError("a page without samples")
    if len(offsets) != planes * -(-height // down) * -(-width // across) or len(sizes) != len(offsets):
        raise ValueError("the strips or tiles do not cover the page")
    line = -(-across * depth * bits // 8)
    stored = [max(0, min(n, len(blob) - at)) for at, n in zip(offsets, sizes)]
    if predictor != 1 and predictor != (3 if form == 3 else 2):
        raise ValueError(f"predictor {predictor} does not fit the samples")
    if line * max(height, down if tiled else 0) * planes > MOST_EXPANSION * max(1, sum(stored)):
        raise ValueError("the page claims more than its bytes can hold")
    pixels = np.zeros((height, width, samples), dtype.newbyteorder("="))
    part = 0
    for plane in range(planes):
        for top in range(0, height, down):
            for left in range(0, width, across):
                rows = down if tiled else min(down, height - top)
                raw_bytes = blob[offsets[part] : offsets[part] + sizes[part]]
                if f.get(FILL_ORDER, (1,))[0] == 2:
                    raw_bytes = REVERSED[np.frombuffer(raw_bytes, np.uint8)].tobytes()
                data = np.frombuffer(_expand(raw_bytes, scheme, rows * line), np.uint8).reshape(rows, line)
                if predictor == 3:  # bytes of equal weight stand together, each a difference
                    planed = np.cumsum(data.reshape(rows, -1, depth), axis=1, dtype=np.uint8).reshape(rows, bits // 8, across * depth)
                    block = np.ascontiguousarray(planed.transpose(0, 2, 1)).view(f">f{bits // 8}").reshape(rows, across, depth)
                elif bits < 8:
                    single = np.unpackbits(data, axis=1)[:, : across * depth * bits].reshape(rows, across * depth, bits)
                    block = (single @ (1 << np.arange(bits - 1, -1, -1))).astype(np.uint8).reshape(rows, across, depth)
                else:
                    block = data.view(dtype).reshape(rows, across, depth)
                if predictor == 2:
                    block = np.cumsum(block, axis=1, dtype=pixels.dtype)
                    block = block & ((1 << bits) - 1) if bits < 8 else block
                high, wide = min(rows, height - top), min(across, width - left)
                pixels[top : top + high, left : left + wide, plane * depth : (plane + 1) * depth] = block[:high, :wide]
                part += 1
    return Page(index, scheme, predictor, pixels)


def each_page(blob: bytes) -> Iterator[Page | Unreadable]:
    """Every page of a file, or why it cannot be read."""
    index, chain = 0, directories(blob)
    while True:
        try:
            order, fields = next(chain)
        except StopIteration:
            return
        except DAMAGE as e:
            yield Unreadable(index, f"{type(e).__name__}: {e}")
            return
        try:
            yield _decoded(blob, order, fields, index)
        except DAMAGE as e:
            yield Unreadable(index, f"{type(e).__name__}: {e}")
        index += 1


def pages(blob: bytes) -> Iterator[Page]:
    """Decode every page of a file; one that cannot be read is an error."""
    for page in each_page(blob):
        if isinstance(page, Unreadable):
            raise page
        yield page


def encode_tiff(
    images: list[np.ndarray],
    scheme: int = DEFLATE,
    predictor: int = 1,
    order: str = "<",
    tile: int = 0,
    rows_per_strip: int = 1024,
    planar: bool = False,
    big: bool = False,
) -> bytes:
    """A file of pages, each an unsigned array of shape (height, width[, samples])."""
    word, count, size = ("Q", "Q", 8) if big else ("I", "H", 4)
    out = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HHHQ", 43, 8, 0, 0) if big else struct.pack(order + "HI", 42, 0)))
    link = len(out) - size
    for image in images:
        image = image if image.ndim == 3 else image[:, :, None]
        height, width, samples = image.shape
        down, across = (tile, tile) if tile else (min(rows_per_strip, height), width)
        offsets, sizes = [], []
        for plane in range(samples) if planar else [slice(None)]:
            body = image[:, :, plane] if not planar else image[:, :, plane : plane + 1]
            for top in range(0, height, down):
                for left in range(0, width, across):
                    block = body[top : top + down, left : left + across]
                    if tile:
                        whole = np.zeros((tile, tile, block.shape[2]), block.dtype)
                        whole[: block.shape[0], : block.shape[1]] = block
                        block = whole
                    if predictor == 2:
                        block = np.concatenate([block[:, :1], block[:, 1:] - block[:, :-1]], axis=1)
                    data = _shrink(np.ascontiguousarray(block.astype(block.dtype.newbyteorder(order))).tobytes(), scheme)
                    offsets.append(len(out))
                    sizes.append(len(data))
                    out += data + b"\0" * (len(data) % 2)
        where = [(TILE_WIDTH, 4, (tile,)), (TILE_HEIGHT, 4, (tile,)), (TILE_OFFSETS, 4, offsets), (TILE_SIZES, 4, sizes)]
        if not tile:
            where = [(STRIP_OFFSETS, 4, offsets), (ROWS_PER_STRIP, 4, (down,)), (STRIP_SIZES, 4, sizes)]
        fields = [(WIDTH, 4, (width,)), (HEIGHT, 4, (height,)), (BITS, 3, (image.dtype.itemsize * 8,) * samples), (COMPRESSION, 3, (scheme,)),
                  (PHOTOMETRIC, 3, (1,)), (SAMPLES, 3, (samples,)), (PLANAR, 3, (2 if planar else 1,)), (PREDICTOR, 3, (predictor,)), *where]
        entries = b""
        for tag, kind, values in sorted(fields):
            data = struct.pack(f"{order}{len(values)}{FIELD[kind]}", *values)
            if len(data) > size:
                place, data_at = len(out), data
                out += data_at + b"\0" * (len(data_at) % 2)
                data = struct.pack(order + word, place)
            entries += struct.pack(order + "HH" + word, tag, kind, len(values)) + data.ljust(size, b"\0")
        struct.pack_into(order + word, out, link, len(out))
        out += struct.pack(order + count, len(fields)) + entries
        link = len(out)
        out += b"\0" * size
    return bytes(out)


def page_feature(page: Page) -> str:
    """Shape, coding and integer statistics of a page: equal pixels, equal text."""
    p = page.pixels if page.pixels.dtype.kind != "f" else page.pixels.view(f"u{page.pixels.itemsize}")
    height, width, samples = p.shape
    total = int(p.sum(dtype=np.int64))
    steps = int(np.abs(np.diff(p.astype(np.int64), axis=1)).sum()) if width > 1 else 0
    return f"{width}x{height}x{samples}:c{page.compression}:p{page.predictor}:{int(p.min())}-{int(p.max())}:{total}:{steps}"


def tiff_pages(df: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per page of every medium: id, page, width, height, samples, compression, predictor, pixels, feature, error."""
    names = ["page", "width", "height", "samples", "compression", "predictor", "pixels", "feature", "error"]
    kinds = [pa.int32()] * 6 + [pa.binary(), pa.string(), pa.string()]

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        who, rows = [], []
        for i, blob in enumerate(part.column("media").to_pylist()):
            if blob is None:
                continue
            for p in each_page(blob):
                who.append(i)
                if isinstance(p, Unreadable):
                    rows.append((p.args[0], *(None,) * 7, p.args[1]))
                else:
                    rows.append((p.index, p.pixels.shape[1], p.pixels.shape[0], p.pixels.shape[2], p.compression, p.predictor, p.pixels.tobytes(), page_feature(p), None))
        columns = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
        return pa.RecordBatch.from_arrays([part.column("id").take(pa.array(who, pa.int64())), *columns], ["id", *names])

    narrow = df.select(F.col(id_col).alias("id"), F.col(media_col).alias("media"))
    out = map_slices(narrow, run, f"id {narrow.schema['id'].dataType.simpleString()}, page int, width int, height int, samples int, compression int, predictor int, pixels binary, feature string, error string", "media")
    return out.withColumnRenamed("id", id_col)


def text_media(text: str | None) -> tuple[int, bytes]:
    """A text as a lossless grey image, 64 samples a row: its length in bytes and the file.

    The file has a page for each ``PAGE_ROWS`` rows.  The payload's own checksum names scheme,
    layout and predictor, so that every way of storing serves a share of the texts and equal
    texts give equal files: a sixteenth each is LZW, PackBits and plain, the rest deflate; every
    fourth is in tiles, every other one predicted.
    """
    data = (text or "").encode("utf-8")
    n = len(data)
    padded = data.ljust(max(64, -(-n // 64) * 64), b"\0")
    way = zlib.crc32(padded)
    scheme = {0: LZW, 1: PACKBITS, 2: RAW}.get(way % 16, DEFLATE)
    rows = np.frombuffer(padded, np.uint8).reshape(-1, 64)
    images = [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
    return n, encode_tiff(images, scheme, 1 + (way >> 4) % 2, tile=64 * ((way >> 5) % 4 == 0), rows_per_strip=1024)


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Texts as media: rows (doc_id, n_bytes, media)."""

    def run(part: pa.RecordBatch) -> pa.RecordBatch:
        made = [text_media(t) for t in part.column("text").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([n for n, _ in made], pa.int64()), pa.array([m for _, m in made], pa.binary())], ["doc_id", "n_bytes", "media"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return map_slices(narrow, run, "doc_id long, n_bytes long, media binary")


def op7_media_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as a TIFF, read back page by page, digests and a feature of what was read."""
    stored = store_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]

    def digest(part: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for doc_id, n, media in zip(*(part.column(k).to_pylist() for k in ("doc_id", "n_bytes", "media"))):
            read = list(pages(media))
            payload = b"".join(p.pixels.tobytes() for p in read)
            rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), ";".join(page_feature(p) for p in read)))
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names)

    return map_slices(stored, digest, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", "media")
