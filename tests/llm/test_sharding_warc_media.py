"""Shards, web archives and media columns: contracts, exact round trips, and awkward rows."""

import hashlib
import struct
import zlib

import numpy as np
import pytest
import zstandard
from conftest import rows_of

from tessera.llm import jpeg, registry, warc
from tessera.llm.sharding import jump_hash, shard_rows

AWKWARD = [(1, "a b", "x"), (2, None, "x"), (2, None, None), (None, "", "y"), (3, "é\n" * 5000, "y"), (4, "same", "z"), (5, "same", "z"), (5, "same", "z"), (-7, "neg", None)]


@pytest.fixture(scope="module")
def awkward(spark):
    return spark.createDataFrame(AWKWARD, "doc_id long, text string, shard string")


@pytest.mark.parametrize("name", ["op1_jump_sharding", "op2_warc_archives"])
def test_equals_sql(spark, duck, data, name):
    got, want = registry.QUERIES[name](spark, data).toPandas(), duck.execute(registry.ORACLE[name]).df()
    assert rows_of(got) == rows_of(want)


def jump(key, n):
    key, b, j = key % (1 << 64), -1, 0
    while j < n:
        b = j
        key = (key * 2862933555777941757 + 1) % (1 << 64)
        j = int((b + 1) * ((1 << 31) / ((key >> 33) + 1)))
    return b


def test_jump_hash_and_growth(spark):
    from pyspark.sql import functions as F

    keys = [0, 1, -1, 2**63 - 1, -(2**63), *range(100, 400)]
    df = spark.createDataFrame([(k,) for k in keys], "k long")
    got = {r.k: (r.a, r.b, r.c) for r in df.select("k", jump_hash(F.col("k"), 40).alias("a"), jump_hash(F.col("k"), 41).alias("b"), jump_hash(F.col("k"), 1).alias("c")).collect()}
    assert got == {k: (jump(k, 40), jump(k, 41), 0) for k in keys}
    assert all(b in (a, 40) for a, b, _ in got.values())


def test_shards_of_awkward_rows(awkward):
    for pieces in (250_000, 1):
        got = shard_rows(awkward, 3, rows_per_task=pieces).collect()
        assert len(got) == len(AWKWARD)
        for s in {r.shard for r in got}:
            assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
        assert sorted((r.size, r.text_crc32) for r in got) == sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in AWKWARD)
    assert shard_rows(awkward.limit(0), 3).collect() == []


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, payload_digest int")


def test_archives_round_trip(spark):
    big, other = "<p>" + "word " * 400, "é" * 600
    rows = [(1, "http://a/%0A b", big, 1), (2, None, big, None), (3, "u", big, 2), (4, "u\nv", "small", 3), (5, "u", "small", 3), (6, "u", None, 4), (7, "u", other, 5), (7, "u", other, 5), (None, "n", other, 6), (None, None, "", 7)]
    got = warc.read_archives(warc.write_archives(pages(spark, rows), archive_bytes=3000)).collect()
    assert len(got) == len(rows)
    by = sorted(got, key=lambda r: (r.page_id is None, r.page_id or 0, r.payload_bytes))
    assert [(r.page_id, r.record_type, r.refers_to) for r in by] == [
        (1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (4, "response", None), (5, "response", None), (6, "response", None), (7, "response", None), (7, "response", None),
        (None, "response", None), (None, "revisit", 7),
    ]
    texts = {r[0]: r[2] or "" for r in rows if r[0]}
    for r in got:
        if r.page_id:
            assert r.payload_digest == hashlib.sha1(texts[r.page_id].encode()).hexdigest() and r.payload_bytes == len(texts[r.page_id].encode())
            if r.record_type == "response":
                assert r.payload == texts[r.page_id].encode()
    assert {r.url for r in got if r.page_id in (1, 4)} == {"http://a/%0A b", "u\nv"}
    assert warc.read_archives(warc.write_archives(pages(spark, []))).collect() == []


def test_dictionary_frame_leads_and_records_stand_alone(spark, data):
    a = warc.write_archives(spark.read.parquet(f"{data}/pages.parquet")).first()
    magic, size = struct.unpack_from("<II", a.content)
    assert magic == 0x184D2A5D
    held = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(a.content[8 : 8 + size])).decompressobj()
    first = held.decompress(a.content[8 + size :])
    assert first.startswith(b"WARC/1.1\r\n") and held.unused_data.startswith(b"\x28\xb5\x2f\xfd")
    plain = sum(len((r.html or "").encode()) for r in spark.read.parquet(f"{data}/pages.parquet").collect())
    assert sum(len(r.content) for r in warc.write_archives(spark.read.parquet(f"{data}/pages.parquet")).collect()) < plain


@pytest.mark.parametrize("n", [1, 2, 5])
def test_few_records_have_a_dictionary_too(n):
    records = [warc._record(i, None, f"<p>page {i}".encode() * (i + 1), "0" * 40, "response", None, "2024-01-01T00:00:00Z") for i in range(n)]
    content = warc.build_archive(records, 32 << 10, 1 << 20, 3)
    magic, size = struct.unpack_from("<II", content)
    assert magic == 0x184D2A5D and 8 < size <= 32 << 10
    assert [h["WARC-Record-ID"] for h, _ in warc.read_archive(content)] == [f"<urn:page:{i}>" for i in range(n)]
    assert all(b.endswith(f"<p>page {i}".encode() * (i + 1)) for i, (_, b) in enumerate(warc.read_archive(content)))


def test_media_contract(spark, data):
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = registry.QUERIES["op7_jpeg_media"](spark, data).collect()
    assert len(got) == len(docs)
    for r in got:
        raw = docs[r.doc_id]
        padded = raw.ljust(max(192, -(-len(raw) // 192) * 192), b" ")
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(padded), hashlib.sha256(padded).hexdigest(), zlib.crc32(padded[-16:]))
    media = jpeg.with_media(spark.read.parquet(f"{data}/documents.parquet")).collect()
    stored = {r.doc_id: r.media for r in media}
    assert all(r.media_bytes == len(stored[r.doc_id]) and r.media_sha256 == hashlib.sha256(stored[r.doc_id]).hexdigest() for r in got)


def slow_reader(data):
    """DC values of a grey image, bit by bit."""
    image = jpeg.parse(data)[0]
    bits = "".join(f"{b:08b}" for b in data[image["scan"] : image["end"]].replace(b"\xff\x00", b"\xff")) if not image["restart"] else None
    if bits is None:
        out, at, piece = [], image["scan"], bytearray()
        pieces = []
        while at < image["end"]:
            if data[at] == 0xFF and data[at + 1] != 0:
                pieces.append(bytes(piece))
                piece, at = bytearray(), at + 2
            elif data[at] == 0xFF:
                piece.append(0xFF)
                at += 2
            else:
                piece.append(data[at])
                at += 1
        pieces.append(bytes(piece))
        streams = ["".join(f"{b:08b}" for b in p) for p in pieces]
    else:
        streams, out = [bits], []
    (_, (dc_bits, dc_values), (ac_bits, ac_values), q) = image["order"][0][0], image["order"][0][1], image["order"][0][2], image["order"][0][3]

    def codes(lengths, values):
        table, code, i = {}, 0, 0
        for n in range(1, 17):
            for _ in range(lengths[n - 1]):
                table[f"{code:0{n}b}"] = values[i]
                code, i = code + 1, i + 1
            code <<= 1
        return table

    dc, ac = codes(dc_bits, dc_values), codes(ac_bits, ac_values)
    rows, columns = image["units"]
    left = rows * columns
    for s in streams:
        at, last = 0, 0
        for _ in range(min(left, image["restart"] or left)):
            word = ""
            while word not in dc:
                word, at = word + s[at], at + 1
            n = dc[word]
            v = int(s[at : at + n], 2) if n else 0
            at += n
            last += v if not n or v >= 1 << (n - 1) else v - (1 << n) + 1
            out.append(last)
            k = 1
            while k < 64:
                word = ""
                while word not in ac:
                    word, at = word + s[at], at + 1
                if ac[word] == 0:
                    break
                at += ac[word] & 15
                k += (ac[word] >> 4) + 1
        left -= image["restart"] or left
    return np.clip(np.rint(np.array(out).reshape(rows, columns) * q / 8) + 128, 0, 255).astype(np.uint8)


def test_thumbnails_equal_a_bit_by_bit_reader():
    rng = np.random.default_rng(5)
    payloads = [rng.integers(0, 256, 192 * n, dtype=np.uint8) for n in (1, 3, 11)] + [np.full(384, 255, np.uint8), np.zeros(192, np.uint8)]
    stored = jpeg.encode(payloads)
    for p, data, (image,) in zip(payloads, stored, jpeg.thumbnails(stored)):
        assert (image.reshape(-1) == p).all()
        assert (slow_reader(data) == image).all()


def test_an_image_with_ac_coefficients_and_no_restarts():
    """A 16x8 image written by hand: the second block has a run of zeros and a coefficient."""
    body = "10" + "1" * 0  # DC category 1 below has the code 10
    dc = {0: "0", 1: "10", 2: "110"}
    ac = {0x00: "0", 0x21: "10"}
    bits = dc[2] + "11" + ac[0] + dc[1] + "0" + ac[0x21] + "1" + ac[0]
    bits += "1" * (-len(bits) % 8)
    scan = bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    seg = lambda m, b: struct.pack(">BBH", 0xFF, m, len(b) + 2) + b
    data = b"\xff\xd8" + seg(0xE0, b"JFIF\0") + seg(0xDB, bytes([0] + [16] * 64)) + seg(0xC0, struct.pack(">BHHBBBB", 8, 8, 16, 1, 1, 0x11, 0))
    data += seg(0xC4, bytes([0, 1, 1, 1, *[0] * 13, 0, 1, 2])) + seg(0xC4, bytes([0x10, 1, 1, *[0] * 14, 0x00, 0x21])) + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + scan + b"\xff\xd9"
    (image,) = jpeg.thumbnails([data])[0]
    assert image.tolist() == [[128 + 6, 128 + 4]] and (slow_reader(data) == image).all() and body


def test_media_of_awkward_rows(awkward):
    got = jpeg.media_features(jpeg.with_media(awkward)).collect()
    assert len(got) == len(AWKWARD)
    assert {r.payload_bytes for r in got if r.n_bytes == 0} == {192}
    assert len({(r.media_sha256, r.feature) for r in got if r.n_bytes == 4}) == 1
    assert jpeg.media_features(jpeg.with_media(awkward.limit(0))).collect() == []


def test_a_text_of_several_images(spark):
    long = "x" * (192 * 8191 + 10)
    got = jpeg.media_features(jpeg.with_media(spark.createDataFrame([(1, long)], "doc_id long, text string"))).first()
    padded = long.encode().ljust(192 * 8192, b" ")
    assert got.payload_sha256 == hashlib.sha256(padded).hexdigest()
