import hashlib
import struct
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from gridpoint.llm.tiff import DEFLATE, LZW, PACKBITS, PLAIN, pack_bits, pack_lzw, op5_tiff, padded, read_pages, tiff_pages, unpack_bits, unpack_lzw, write_pages


@settings(max_examples=200, deadline=None)
@given(st.one_of(st.binary(max_size=600), st.lists(st.sampled_from(b"ab"), max_size=900).map(bytes)))
def test_codecs_round_trip(data):
    assert unpack_lzw(pack_lzw(data), len(data)) == data
    assert (unpack_bits(pack_bits(data), len(data)) if data else b"") == data


def test_lzw_through_all_widths():
    data = np.random.default_rng(1).integers(0, 256, 60_000, np.uint8).tobytes() + b"a" * 9000
    assert unpack_lzw(pack_lzw(data), len(data)) == data


@pytest.mark.parametrize("kind", [PLAIN, PACKBITS, LZW, DEFLATE])
@pytest.mark.parametrize("predictor", [1, 2])
@pytest.mark.parametrize("tiled", [False, True])
def test_files_round_trip(kind, predictor, tiled):
    payload = padded(b"The quick brown fox. " * 900)
    pages = list(read_pages(write_pages(payload, kind, predictor, tiled, page_rows=128)))
    assert len(pages) == 3 and [p["page"] for p in pages] == [0, 1, 2]
    assert b"".join(p["pixels"] for p in pages) == payload and all(p["error"] is None for p in pages)


def big_endian_rgb16(planar):
    """A hand-made MM file: 2 x 2 pixels of three 16-bit samples."""
    values = np.arange(12).reshape(2, 2, 3) * 1000
    planes = [values[:, :, k] for k in range(3)] if planar == 2 else [values]
    data = [p.astype(">u2").tobytes() for p in planes]
    tags = [(256, 3, [2]), (257, 3, [2]), (258, 3, [16, 16, 16]), (259, 3, [1]), (262, 3, [2]), (273, 4, None), (277, 3, [3]), (278, 3, [2]), (279, 4, [len(d) for d in data]), (284, 3, [planar])]
    at, extra, entries = 8 + sum(map(len, data)), b"", b""
    places = [8 + sum(map(len, data[:k])) for k in range(len(data))]
    for tag, type_, v in tags:
        v = places if v is None else v
        raw = struct.pack(f">{len(v)}{'H' if type_ == 3 else 'I'}", *v)
        if len(raw) > 4:
            raw, extra = struct.pack(">I", at + len(extra)), extra + raw
        entries += struct.pack(">HHI", tag, type_, len(v)) + raw.ljust(4, b"\0")
    return b"MM\0*" + struct.pack(">I", at + len(extra)) + b"".join(data) + extra + struct.pack(">H", len(tags)) + entries + b"\0\0\0\0", values


@pytest.mark.parametrize("planar", [1, 2])
def test_byte_order_samples_and_planes(planar):
    data, values = big_endian_rgb16(planar)
    (page,) = read_pages(data)
    assert page["error"] is None and (page["width"], page["height"], page["samples"], page["bits"]) == (2, 2, 3, 16)
    assert (np.frombuffer(page["pixels"], np.uint16).reshape(2, 2, 3) == values).all()


def test_bad_files_are_rows(spark):
    good = write_pages(padded(b"x" * 200))
    loop = bytearray(good)
    at = struct.unpack_from("<I", good, 4)[0]
    loop[-4:] = struct.pack("<I", at)
    rows = [(1, good, "a"), (2, None, "a"), (3, b"", "a"), (4, b"II*\0", "a"), (5, bytes(loop), "a"), (6, good[:-60], "a"), (1, good, "a")]
    got = tiff_pages(spark.createDataFrame(rows, "id long, media binary, page string"), "id", "media").collect()
    assert sorted((r.id, r.error is None) for r in got) == [(1, True), (1, True), (3, False), (4, False), (5, False), (5, True), (6, False)]


def header(tags, data=b""):
    entries = b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in sorted(tags.items()))
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(tags)) + entries + b"\0\0\0\0"


@pytest.mark.parametrize("changes", [{257: 2**32 - 1}, {256: 2**32 - 1, 257: 2**32 - 1}, {277: 0}, {277: 60_000}, {256: 0}, {278: 0}, {258: 7}, {259: 9}, {279: 2**32 - 1, 257: 2**31}])
def test_claims_are_held_against_the_bytes(changes):
    tags = {256: 8, 257: 8, 258: 8, 259: 1, 262: 1, 273: 8, 277: 1, 278: 8, 279: 64} | changes
    (page,) = read_pages(header(tags, bytes(64)))
    assert page["error"] and "pixels" not in page


@pytest.mark.parametrize("bits", [1, 2, 4, 32])
def test_other_sample_sizes(bits):
    values = np.random.default_rng(bits).integers(0, 1 << min(bits, 31), (5, 7)).astype("<u4")
    if bits == 32:
        data = values.tobytes()
    else:
        flags = (values[:, :, None] >> np.arange(bits - 1, -1, -1)) & 1
        data = np.packbits(flags.reshape(5, -1).astype(np.uint8), axis=1).tobytes()
    (page,) = read_pages(header({256: 7, 257: 5, 258: bits, 259: 1, 262: 1, 273: 8, 277: 1, 278: 5, 279: len(data)}, data))
    assert page["error"] is None and (np.frombuffer(page["pixels"], np.uint32 if bits == 32 else np.uint8).reshape(5, 7) == values).all()


def test_pages_of_documents_equal_sql(spark, tmp_path):
    import duckdb
    from gridpoint.llm.tiff import TIFF_PAGES_SQL, tiff_pages_of_documents

    df = spark.createDataFrame([(i, t) for i, t in enumerate([None, "", "a" * 64, "é" * 70, "b" * 63, "word " * 60_000, "x" * 131_072, "aab" * 50_001])], "doc_id long, text string")
    df.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    told = con.execute(TIFF_PAGES_SQL)
    names = [d[0] for d in told.description]
    got = tiff_pages_of_documents(spark, str(tmp_path)).select(*names).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, told.fetchall()))
    empty = f"{tmp_path}/none"
    df.limit(0).write.parquet(f"{empty}/documents.parquet")
    assert tiff_pages_of_documents(spark, empty).count() == 0 and op5_tiff(spark, empty).count() == 0


def test_query(spark, tmp_path):
    texts = [None, "", "a" * 64, "é" * 70, "word " * 60_000]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op5_tiff(spark, str(tmp_path)).collect()}
    for i, t in enumerate(texts):
        data = (t or "").encode()
        whole = data + b"\0" * (-len(data) % 64 if data else 64)
        r = got[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))


def test_a_page_too_large_for_a_task_is_an_error_row():
    from gridpoint.llm.tiff import MOST_PAGE_BYTES, read_pages, write_pages

    rows = MOST_PAGE_BYTES // 64 + 64
    data = write_pages(b"\0" * (64 * rows), page_rows=rows)  # a small file, as zeros are
    (page,) = read_pages(data)
    assert len(data) < MOST_PAGE_BYTES // 100 and page["error"].startswith("ValueError('a page of")
