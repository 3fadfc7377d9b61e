"""TIFF media columns: image directories, strips and tiles, compressions and predictors, one row a page.

read_pages() walks a file's directories and decodes every page: classic or big, either byte order, strips or tiles,
1, 2, 4, 8, 16 or 32 bits a sample, one plane or several, stored plain, as PackBits, LZW or deflate, with or without the horizontal
predictor. write_pages() is its counterpart for 8-bit grey pages.

A null file gives no page; a file or page that can't be decoded gives one row with its error, and the rest goes on. What
a directory claims is held against what its strips can hold before room is made, so a few bytes can't ask for a page of
gigabytes. Repeated rows, and equal texts, are decoded one by one, with equal results. Pages leave a task as they are
decoded, so a long file needs memory for one page. An empty table gives no row.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gridpoint.llm.common import table, utf8

#: Tags and codes of the format. Fixed values.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, STRIP_AT, SAMPLES, STRIP_ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, TILE_AT, TILE_BYTES = 284, 317, 322, 323, 324, 325
PLAIN, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 16: "Q", 17: "q", 18: "Q"}

PAGE_WIDTH = 64
PAGE_ROWS = 2048
#: A page of more bytes is not decoded but gives an error row: it would not fit in a task, however small its file.
MOST_PAGE_BYTES = 1 << 28
STRIP = 256
PAGE_SCHEMA = "page int, width int, height int, bits int, samples int, compression int, predictor int, pixels binary, error string"


def unpack_bits(data: bytes, size: int) -> bytes:
    out, at = bytearray(), 0
    while at < len(data) and len(out) < size:
        n = data[at]
        if n < 128:
            out += data[at + 1 : at + 2 + n]
            at += 2 + n
        else:
            if n > 128:
                out += data[at + 1 : at + 2] * (257 - n)
            at += 2 if n > 128 else 1
    return bytes(out)


def pack_bits(data: bytes) -> bytes:
    """Runs of three or more as runs, the rest as it is."""
    values = np.frombuffer(data, np.uint8)
    edges = np.flatnonzero(np.diff(values)) + 1
    starts, ends = np.concatenate([[0], edges]), np.concatenate([edges, [len(values)]])
    out, plain = bytearray(), bytearray()

    def flush() -> None:
        for s in range(0, len(plain), 128):
            piece = plain[s : s + 128]
            out.append(len(piece) - 1)
            out.extend(piece)
        plain.clear()

    for s, e in zip(starts.tolist(), ends.tolist()):
        if e - s < 3:
            plain += data[s:e]
            continue
        flush()
        while s < e:
            n = min(128, e - s)
            out += bytes([257 - n if n > 1 else 0, data[s]])
            s += n
    flush()
    return bytes(out)


def unpack_lzw(data: bytes, size: int) -> bytes:
    """Codes of 9 to 12 bits, highest bit first, that widen one code early; 256 clears, 257 ends."""
    out, words, width, last = bytearray(), [bytes([i]) for i in range(256)] + [b"", b""], 9, None
    held = bits = 0
    for byte in data:
        held, bits = (held << 8) | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code = held >> bits
        held &= (1 << bits) - 1
        if code == 257:
            break
        if code == 256:
            del words[258:]
            width, last = 9, None
            continue
        if last is None:
            word = words[code]
        else:
            word = words[code] if code < len(words) else last + last[:1]
            words.append(last + word[:1])
        out += word
        last = word
        if len(words) >= (1 << width) - 1 and width < 12:
            width += 1
        if len(out) >= size:
            break
    return bytes(out)


def pack_lzw(data: bytes) -> bytes:
    held, bits, width, codes, out = 256, 9, 9, {bytes([i]): i for i in range(256)}, bytearray()
    following, word = 258, b""

    def put(code: int) -> None:
        nonlocal held, bits
        held, bits = (held << width) | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits)
            held &= (1 << bits) - 1

    while bits >= 8:
        bits -= 8
        out.append(held >> bits)
        held &= (1 << bits) - 1
    for i in range(len(data)):
        longer = word + data[i : i + 1]
        if longer in codes:
            word = longer
            continue
        put(codes[word])
        codes[longer] = following
        following += 1
        word = data[i : i + 1]
        if following >= 4094:
            put(256)
            codes, following, width = {bytes([j]): j for j in range(256)}, 258, 9
        elif following >= 1 << width:
            width += 1
    if word:
        put(codes[word])
        if following + 1 >= 1 << width and width < 12:
            width += 1
    put(257)
    if bits:
        out.append((held << (8 - bits)) & 255)
    return bytes(out)


def compressed(data: bytes, kind: int) -> bytes:
    return {PLAIN: lambda: data, PACKBITS: lambda: pack_bits(data), LZW: lambda: pack_lzw(data), DEFLATE: lambda: zlib.compress(data, 1)}[kind]()


def decompressed(data: bytes, kind: int, size: int) -> bytes:
    if kind == PLAIN:
        return data
    if kind == PACKBITS:
        return unpack_bits(data, size)
    if kind == LZW:
        return unpack_lzw(data, size)
    if kind in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size)
    raise ValueError(f"compression {kind}")


def write_pages(payload: bytes, kind: int = DEFLATE, predictor: int = 2, tiled: bool = False, page_rows: int = PAGE_ROWS) -> bytes:
    """A little-endian file of grey pages of PAGE_WIDTH samples a row; the payload is a positive multiple of that."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_WIDTH)
    parts, at, link = [b"II*\0", b"\0\0\0\0"], 8, 4
    links: dict[int, int] = {}
    for top in range(0, len(rows), page_rows):
        page = rows[top : top + page_rows]
        step = min(64 if tiled else STRIP, page_rows)
        places, sizes = [], []
        for r in range(0, len(page), step):
            block = page[r : r + step]
            if tiled and len(block) < step:
                block = np.concatenate([block, np.zeros((step - len(block), PAGE_WIDTH), np.uint8)])
            if predictor == 2:
                block = np.concatenate([block[:, :1], np.diff(block, axis=1)], axis=1)
            data = compressed(block.tobytes(), kind)
            data += b"\0" * (len(data) % 2)
            parts.append(data)
            places.append(at)
            sizes.append(len(data))
            at += len(data)
        tags = [(WIDTH, 4, [PAGE_WIDTH]), (HEIGHT, 4, [len(page)]), (BITS, 3, [8]), (COMPRESSION, 3, [kind]), (PHOTOMETRIC, 3, [1]), (SAMPLES, 3, [1]), (PREDICTOR, 3, [predictor])]
        tags += [(TILE_WIDTH, 4, [PAGE_WIDTH]), (TILE_HEIGHT, 4, [step]), (TILE_AT, 4, places), (TILE_BYTES, 4, sizes)] if tiled else [(STRIP_AT, 4, places), (STRIP_ROWS, 4, [step]), (STRIP_BYTES, 4, sizes)]
        entries = b""
        for tag, type_, values in sorted(tags):
            data = struct.pack(f"<{len(values)}{TYPES[type_]}", *values)
            if len(data) > 4:
                parts.append(data)
                data, at = struct.pack("<I", at), at + len(data)
            entries += struct.pack("<HHI", tag, type_, len(values)) + data.ljust(4, b"\0")
        links[link] = at
        link = at + 2 + len(entries)
        parts.append(struct.pack("<H", len(tags)) + entries + b"\0\0\0\0")
        at += 6 + len(entries)
    out = bytearray(b"".join(parts))
    for place, target in links.items():
        struct.pack_into("<I", out, place, target)
    return bytes(out)


def directories(data: bytes) -> Iterator[tuple[str, dict[int, list]]]:
    """Byte order and tags of each image directory."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None:
        raise ValueError("no byte order mark")
    big = struct.unpack_from(f"{order}H", data, 2)[0] == 43
    if not big and struct.unpack_from(f"{order}H", data, 2)[0] != 42:
        raise ValueError("not a TIFF")
    number, inline, count = ("Q", 8, "Q") if big else ("I", 4, "H")
    at, seen = struct.unpack_from(order + number, data, 8 if big else 4)[0], set()
    while at:
        if at in seen:
            raise ValueError("directories form a loop")
        seen.add(at)
        n = struct.unpack_from(order + count, data, at)[0]
        at += struct.calcsize(order + count)
        tags = {}
        for _ in range(n):
            tag, type_, values = struct.unpack_from(f"{order}HH{number}", data, at)
            at += 4 + inline
            if type_ in TYPES:
                size = values * struct.calcsize(f"={TYPES[type_]}")
                where = at if size <= inline else struct.unpack_from(order + number, data, at)[0]
                tags[tag] = list(struct.unpack_from(f"{order}{values}{TYPES[type_]}", data, where))
            at += inline
        at = struct.unpack_from(order + number, data, at)[0]
        yield order, tags


#: The most bytes that a byte of a compressed strip can stand for. Fixed values of the formats.
MOST_FROM_ONE = {PLAIN: 1, PACKBITS: 64, LZW: 4096, DEFLATE: 1032, OLD_DEFLATE: 1032}


def decode_page(data: bytes, order: str, tags: dict[int, list]) -> tuple[dict, bytes]:
    """A directory's facts, and its samples row by row, in the machine's byte order; samples under a byte come as bytes."""
    first = lambda tag, default: tags.get(tag, [default])[0]
    width, height, samples, kind, predictor = first(WIDTH, 0), first(HEIGHT, 0), first(SAMPLES, 1), first(COMPRESSION, 1), first(PREDICTOR, 1)
    bits = first(BITS, 1)
    if bits not in (1, 2, 4, 8, 16, 32) or predictor not in (1, 2) or kind not in MOST_FROM_ONE or (predictor == 2 and bits < 8):
        raise ValueError(f"{bits} bits a sample, compression {kind}, predictor {predictor}")
    type_ = np.dtype(np.uint8 if bits <= 8 else f"{order}u{bits // 8}")
    planes = samples if first(PLANAR, 1) == 2 else 1
    tiled = TILE_AT in tags
    wide, high = (first(TILE_WIDTH, 0), first(TILE_HEIGHT, 0)) if tiled else (width, min(first(STRIP_ROWS, height), height))
    if min(width, height, samples, wide, high) < 1:
        raise ValueError(f"{width} x {height} pixels of {samples} samples in pieces of {wide} x {high}")
    inside = samples // planes
    across, down = -(-width // wide), -(-height // high)
    places, sizes = tags[TILE_AT if tiled else STRIP_AT], tags[TILE_BYTES if tiled else STRIP_BYTES]
    row_bytes = -(-wide * inside * bits // 8)
    most = MOST_FROM_ONE[kind]
    if min(len(places), len(sizes)) < planes * across * down or high * row_bytes > most * (len(data) + 1) or planes * across * down * row_bytes > most * len(data):
        raise ValueError("more samples than strips can hold")
    for k in range(planes * across * down):
        rows = high if tiled else min(high, height - k // across % down * high)
        if rows * row_bytes > most * max(0, min(sizes[k], len(data) - places[k])):
            raise ValueError("more samples than a strip can hold")
    if (n := planes * height * width * inside * type_.itemsize) > MOST_PAGE_BYTES:
        raise ValueError(f"a page of {n} bytes")
    out = np.zeros((planes, height, width, inside), type_.newbyteorder("="))
    for k in range(planes * across * down):
        plane, row, column = k // (across * down), k // across % down * high, k % across * wide
        rows = high if tiled else min(high, height - row)
        size = rows * row_bytes
        raw = decompressed(data[places[k] : places[k] + sizes[k]], kind, size)
        if len(raw) < size:
            raise ValueError("too few samples")
        if bits < 8:
            flags = np.unpackbits(np.frombuffer(raw, np.uint8, size).reshape(rows, row_bytes), axis=1)[:, : wide * inside * bits]
            block = (flags.reshape(rows, wide, inside, bits) << np.arange(bits - 1, -1, -1, dtype=np.uint8)).sum(axis=3, dtype=np.uint8)
        else:
            block = np.frombuffer(raw, type_, rows * wide * inside).reshape(rows, wide, inside).astype(out.dtype)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=out.dtype)
        out[plane, row : row + rows, column : column + wide] = block[: height - row, : width - column]
    facts = {"width": width, "height": height, "bits": bits, "samples": samples, "compression": kind, "predictor": predictor}
    return facts, np.moveaxis(out, 0, 2).tobytes() if planes > 1 else out.tobytes()


def read_pages(data: bytes) -> Iterator[dict]:
    """A dict for each page: its number, facts and samples, or its error."""
    page = 0
    try:
        for order, tags in directories(data):
            try:
                facts, pixels = decode_page(data, order, tags)
                yield {"page": page, **facts, "pixels": pixels, "error": None}
            except (KeyError, IndexError, ValueError, OverflowError, struct.error, zlib.error) as error:
                yield {"page": page, "error": repr(error)}
            page += 1
    except (ValueError, struct.error) as error:
        yield {"page": page, "error": repr(error)}


def tiff_pages(df: DataFrame, key: str, media: str, batch_bytes: int = 1 << 23) -> DataFrame:
    """One row for each page of each file: key and PAGE_SCHEMA."""
    kind = df.schema[key].dataType.simpleString()
    facts = [x.split()[0] for x in PAGE_SCHEMA.split(", ")]
    types = {"pixels": pa.binary(), "error": pa.string()}

    def pages(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(keys: list, rows: list[dict]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys, key_type), *(pa.array([r.get(f) for r in rows], types.get(f, pa.int32())) for f in facts)], ["key", *facts])

        for batch in found:
            key_type, keys, rows, held = batch.column(0).type, [], [], 0
            for k, data in zip(batch.column(0), batch.column(1)):
                for row in read_pages(data.as_py()) if data.is_valid else ():
                    keys.append(k.as_py())
                    rows.append(row)
                    held += len(row.get("pixels", b""))
                    if held > batch_bytes:
                        yield out(keys, rows)
                        keys, rows, held = [], [], 0
            if keys:
                yield out(keys, rows)

    return df.select(F.col(key).alias("key"), F.col(media).alias("media")).mapInArrow(pages, f"key {kind}, {PAGE_SCHEMA}").withColumnRenamed("key", key)


def padded(data: bytes, to: int = PAGE_WIDTH) -> bytes:
    """data and bytes 0 up to a positive multiple."""
    return data + b"\0" * (-len(data) % to or (to if not data else 0))


def features(pages: Iterable[dict]) -> tuple[bytes, str]:
    """The samples of all pages, and what they look like: pages, rows, mean, share of zero samples, mean step along rows."""
    pages = list(pages)
    if errors := [p["error"] for p in pages if p["error"]]:
        raise ValueError(errors[0])
    payload = b"".join(p["pixels"] for p in pages)
    values = np.frombuffer(payload, np.uint8).reshape(-1, PAGE_WIDTH).astype(np.int16)
    step = np.abs(np.diff(values, axis=1))
    return payload, f"pages={len(pages)} rows={len(values)} mean={values.mean():.4f} zero={(values == 0).mean():.4f} step={step.mean():.4f}"


def op5_tiff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text as a TIFF file, and what its pages hold when they are read back."""

    def stored(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
        for batch in found:
            rows = []
            for key, text in zip(batch.column(0), batch.column(1)):
                data = text.as_py()
                media = write_pages(padded(data))
                payload, feature = features(read_pages(media))
                rows.append((key.as_py(), len(data), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature))
            types = [batch.column(0).type, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 8, types)], names)

    docs = table(spark, sf_dir, "documents")
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return docs.select("doc_id", utf8().alias("text")).mapInArrow(stored, schema)


#: How tiff_pages stores a text, by its length's remainder.
FORMS = ((LZW, 2, False), (PACKBITS, 1, True), (DEFLATE, 2, True), (PLAIN, 1, False), (LZW, 1, True))


def tiff_pages_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored in one of FORMS, and one row for each page that is read back."""

    def stored(found: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in found:
            for s in range(0, batch.num_rows, 64):
                part = batch.slice(s, 64)
                media = [write_pages(padded(d), *FORMS[len(d) % len(FORMS)]) for d in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(media, pa.binary())], ["doc_id", "media"])

    docs = table(spark, sf_dir, "documents")
    files = docs.select("doc_id", utf8().alias("text")).mapInArrow(stored, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, media binary")
    pages = tiff_pages(files, "doc_id", "media")
    return pages.select("doc_id", *(F.col(c).cast("long").alias(c) for c in ("page", "width", "height", "bits", "compression", "predictor")), F.sha2("pixels", 256).alias("pixels_sha256"), "error")


TIFF_PAGES_SQL = f"""
WITH t AS (SELECT row_number() OVER () AS rid, doc_id, encode(coalesce(text, '')) AS b FROM documents),
p AS (SELECT rid, doc_id, octet_length(b) AS n, unhex(hex(b) || repeat('00', CAST(CASE WHEN octet_length(b) = 0 THEN {PAGE_WIDTH} ELSE ({PAGE_WIDTH} - octet_length(b) % {PAGE_WIDTH}) % {PAGE_WIDTH} END AS BIGINT))) AS b FROM t),
q AS (SELECT *, octet_length(b) AS size, unnest(range(0, CAST(ceil(octet_length(b) / {PAGE_WIDTH * PAGE_ROWS}.0) AS BIGINT))) AS page FROM p)
SELECT doc_id, page, CAST({PAGE_WIDTH} AS BIGINT) AS width, least({PAGE_ROWS}, size // {PAGE_WIDTH} - page * {PAGE_ROWS}) AS height, CAST(8 AS BIGINT) AS bits,
  CAST([{", ".join(str(k) for k, _, _ in FORMS)}][n % {len(FORMS)} + 1] AS BIGINT) AS compression, CAST([{", ".join(str(p) for _, p, _ in FORMS)}][n % {len(FORMS)} + 1] AS BIGINT) AS predictor,
  sha256(unhex(substr(hex(b), CAST(page * {2 * PAGE_WIDTH * PAGE_ROWS} + 1 AS BIGINT), {2 * PAGE_WIDTH * PAGE_ROWS}))) AS pixels_sha256, CAST(NULL AS VARCHAR) AS error FROM q
"""

QUERIES = {"op5_tiff": op5_tiff, "tiff_pages": tiff_pages_of_documents}
ORACLES: dict[str, str] = {"tiff_pages": TIFF_PAGES_SQL}
