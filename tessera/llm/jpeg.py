"""Baseline JPEG: a lossless container for bytes, and a DC-only luminance reader in numpy.

Writing: each payload byte is one 8x8 block of a grey image, whose DC coefficient is the byte minus 128 under a DC
quantiser of 8, and which has no AC coefficients; so the flat block has exactly the byte's value. A row of blocks holds
192 bytes and is a restart interval of its own. An image has 8191 rows of blocks at most; a longer payload becomes
several images, one after another.

Reading: markers are parsed, restart intervals of many images are decoded side by side (one symbol of every interval
per numpy step), and only DC coefficients are kept. Any baseline scan is read, with or without restart intervals and
with several components; the luminance is the first component.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tessera.llm.textblocks import blocks

ROW = 192
MOST_ROWS = 8191
#: The DC category c has a code of 9 - c bits, so that every coefficient takes 9 bits with its extra bits, and the end
#: of a block takes one: all-ones codes stay unused, as baseline asks.
DC_BITS, DC_VALUES = [1] * 9 + [0] * 7, list(range(8, -1, -1))
AC_BITS, AC_VALUES = [1] + [0] * 15, [0]


def _block_codes() -> np.ndarray:
    """Code, extra bits and end of block for each difference -255..255, 10 bits each."""
    codes = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        huffman = (1 << (9 - c)) - 2
        extra = d if d >= 0 else d + (1 << c) - 1
        codes[d + 255] = (((huffman << c) | extra) << 1) if c else huffman << 1
    return codes


CODES = _block_codes()


def _header(rows: int) -> bytes:
    def segment(marker: int, body: bytes) -> bytes:
        return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body

    return (
        b"\xff\xd8"
        + segment(0xDB, bytes([0] + [8] * 64))
        + segment(0xC0, struct.pack(">BHHBBBB", 8, rows * 8, ROW * 8, 1, 1, 0x11, 0))
        + segment(0xC4, bytes([0x00, *DC_BITS, *DC_VALUES]))
        + segment(0xC4, bytes([0x10, *AC_BITS, *AC_VALUES]))
        + segment(0xDD, struct.pack(">H", ROW))
        + segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))
    )


def encode(payloads: list[np.ndarray]) -> list[bytes]:
    """The images of each payload; lengths are positive multiples of 192."""
    rows = [len(p) // ROW for p in payloads]
    data = np.concatenate(payloads).reshape(-1, ROW)
    value = data.astype(np.int16) - 128
    value[:, 1:] -= value[:, :-1].copy()
    code = CODES[value + 255].reshape(-1, ROW // 4, 4)
    packed = np.empty((len(data), ROW // 4, 5), np.uint8)
    a, b, c, d = (code[:, :, i] for i in range(4))
    packed[:, :, 0] = a >> 2
    packed[:, :, 1] = (a & 3) << 6 | b >> 4
    packed[:, :, 2] = (b & 15) << 4 | c >> 6
    packed[:, :, 3] = (c & 63) << 2 | d >> 8
    packed[:, :, 4] = d & 255
    width = ROW // 4 * 5
    flat = packed.reshape(len(data), width)
    number = np.concatenate([np.arange(n) % MOST_ROWS for n in rows])
    out = np.empty((len(data), width + 2), np.uint8)
    out[:, :width] = flat
    out[:, width] = 0xFF
    out[:, width + 1] = 0xD0 + number % 8
    extra = np.zeros(out.shape, bool)
    extra[:, :width] = flat == 0xFF
    put = np.flatnonzero(extra.reshape(-1)) + 1
    stuffed = np.insert(out.reshape(-1), put, 0)
    ends = (np.arange(len(data) + 1) * (width + 2)) + np.concatenate([[0], np.cumsum(extra.sum(axis=1))])
    result, first = [], 0
    for n in rows:
        images = []
        for lo in range(first, first + n, MOST_ROWS):
            hi = min(lo + MOST_ROWS, first + n)
            images.append(_header(hi - lo) + stuffed[ends[lo] : ends[hi] - 2].tobytes() + b"\xff\xd9")
        result.append(b"".join(images))
        first += n
    return result


@lru_cache(64)
def _lookup(bits: bytes, values: bytes) -> np.ndarray:
    """For each 16 bits ahead: code length << 8 | symbol; 0 where no code begins so."""
    table, code, at = np.zeros(1 << 16, np.uint16), 0, 0
    for length in range(1, 17):
        for _ in range(bits[length - 1]):
            lo = code << (16 - length)
            table[lo : lo + (1 << (16 - length))] = length << 8 | values[at]
            code, at = code + 1, at + 1
        code <<= 1
    return table


def parse(data: bytes) -> list[dict]:
    """The images of a byte string: size, components, quantisers, Huffman tables, restart interval, place of the scan."""
    images, at, image = [], 0, {}
    quant: dict[int, int] = {}
    tables: dict[int, tuple[bytes, bytes]] = {}
    while at < len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        marker = data[at + 1]
        at += 2
        if marker == 0xD8:
            image, quant, tables = {"restart": 0}, {}, {}
            continue
        if marker == 0xFF:
            at -= 1
            continue
        if marker == 0xD9:
            continue
        size = struct.unpack_from(">H", data, at)[0]
        body, at = data[at + 2 : at + size], at + size
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = struct.unpack_from(">H", body, 1)[0] if wide else body[1]
                body = body[1 + 64 * (1 + wide) :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = (body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            image["restart"] = struct.unpack(">H", body)[0]
        elif marker == 0xC0:
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            if bits != 8:
                raise ValueError("baseline samples have 8 bits")
            image |= {"height": height, "width": width, "parts": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]}
        elif marker in (0xC1, 0xC2, 0xC3, *range(0xC5, 0xC8), *range(0xC9, 0xCC), *range(0xCD, 0xD0)):
            raise ValueError("not a baseline image")
        elif marker == 0xDA:
            ids = {body[1 + 2 * i]: body[2 + 2 * i] for i in range(body[0])}
            if len(ids) != len(image["parts"]):
                raise ValueError("every component has to be in the first scan")
            order = []
            for k, (who, h, v, q) in enumerate(image["parts"]):
                single = len(ids) == 1
                order += [(k, tables[ids[who] >> 4], tables[0x10 | ids[who] & 15], quant[q])] * (1 if single else h * v)
            most = (1, 1) if len(ids) == 1 else (max(p[1] for p in image["parts"]), max(p[2] for p in image["parts"]))
            image["units"] = (-(-image["height"] // (8 * most[1])), -(-image["width"] // (8 * most[0])))
            image |= {"order": tuple(order), "scan": at, "luma": (image["parts"][0][1], image["parts"][0][2]) if len(ids) > 1 else (1, 1)}
            end = data.find(b"\xff\xd9", at)
            if end < 0:
                raise ValueError("the scan has no end")
            images.append(image | {"end": end})
            at = end
    return images


def _scan_dc(pieces: list[tuple[dict, np.ndarray]]) -> list[np.ndarray]:
    """Luminance DC values (before the quantiser) of scans with equal tables and order, in the order of their blocks."""
    order, restart = pieces[0][0]["order"], pieces[0][0]["restart"]
    data = np.concatenate([x for _, p in pieces for x in (p, np.array([0xFF, 0xD9], np.uint8))])
    ends = np.cumsum([len(p) + 2 for _, p in pieces])
    lead = np.zeros(len(data), bool)
    lead[:-1] = (data[:-1] == 0xFF) & (data[1:] != 0)
    drop = lead.copy()
    drop[1:] |= (data[:-1] == 0xFF)
    cut = np.flatnonzero(lead)
    place = np.cumsum(~drop)
    starts = np.concatenate([[0], place[cut]])[:-1]
    owner = np.searchsorted(ends, cut, "right")
    clean = np.concatenate([data[~drop], np.full(8, 0xFF, np.uint8)]).astype(np.uint64)
    window = clean[:-7] << np.uint64(32) | clean[1:-6] << np.uint64(24) | clean[2:-5] << np.uint64(16) | clean[3:-4] << np.uint64(8) | clean[4:-3]
    units = np.array([i["units"][0] * i["units"][1] for i, _ in pieces])
    rank = np.arange(len(owner)) - np.searchsorted(owner, owner)
    todo = (np.minimum(restart, units[owner] - rank * restart) if restart else units[owner]) * len(order)
    if len(np.unique(owner)) != len(pieces) or (todo <= 0).any():
        raise ValueError("restart intervals don't fit the image")
    tables = np.concatenate([_lookup(*t) for o in order for t in (o[1], o[2])])
    n, most = len(starts), int(todo.max())
    found = np.zeros((n, most), np.int32)
    bit = starts.astype(np.int64) * 8
    last = np.zeros((n, len({o[0] for o in order})), np.int32)
    sixteen, limit = np.uint64(0xFFFF), len(window) - 1
    live = np.arange(n)
    for block in range(most):
        if block and (todo[live] <= block).any():
            live = live[todo[live] > block]
        which = block % len(order)
        at = bit[live]
        word = window[np.minimum(at >> 3, limit)] << (at & 7).astype(np.uint64)
        hit = tables[(2 * which << 16) + (word >> np.uint64(24) & sixteen).astype(np.int64)]
        length, size = (hit >> 8).astype(np.int64), (hit & 15).astype(np.int64)
        if not length.all():
            raise ValueError("no Huffman code begins so")
        word = word << length.astype(np.uint64) & np.uint64(0xFFFFFFFFFF)
        value = (word >> (40 - size).astype(np.uint64)).astype(np.int64)
        value -= np.where(value < (1 << size >> 1), (1 << size) - 1, 0)
        last[live, order[which][0]] += value.astype(np.int32)
        found[live, block] = last[live, order[which][0]]
        at = at + length + size
        busy, k = np.arange(len(live)), np.ones(len(live), np.int64)
        while len(busy):
            here = at[busy]
            word = window[np.minimum(here >> 3, limit)] << (here & 7).astype(np.uint64)
            hit = tables[((2 * which + 1) << 16) + (word >> np.uint64(24) & sixteen).astype(np.int64)]
            length, symbol = (hit >> 8).astype(np.int64), (hit & 255).astype(np.int64)
            if not length.all():
                raise ValueError("no Huffman code begins so")
            at[busy] = here + length + (symbol & 15)
            k[busy] += np.where(symbol == 0, 64, (symbol >> 4) + 1)
            if not symbol.any():
                break
            busy = busy[k[busy] < 64]
        bit[live] = at
    luma = np.array([o[0] == 0 for o in order])
    bounds = np.searchsorted(owner, np.arange(len(pieces) + 1))
    out = []
    for i in range(len(pieces)):
        rows = range(bounds[i], bounds[i + 1])
        if restart and len({int(todo[r]) for r in rows}) == 1:
            values = found[rows.start : rows.stop, : todo[rows.start]].reshape(-1)
        else:
            values = np.concatenate([found[r, : todo[r]] for r in rows])
        out.append(values.reshape(-1, len(order))[:, luma])
    return out


def thumbnails(stored: list[bytes]) -> list[list[np.ndarray]]:
    """The DC-only luminance thumbnails (one sample per 8x8 block) of the images in each byte string."""
    groups: dict[tuple, list] = {}
    result: list[list] = []
    for i, data in enumerate(stored):
        images = parse(data)
        result.append([None] * len(images))
        for k, image in enumerate(images):
            piece = np.frombuffer(data, np.uint8)[image["scan"] : image["end"]]
            groups.setdefault((image["order"], image["restart"]), []).append((i, k, image, piece))
    for members in groups.values():
        for (i, k, image, _), dc in zip(members, _scan_dc([(m[2], m[3]) for m in members])):
            q, (h, v), (rows, columns) = image["order"][0][3], image["luma"], image["units"]
            grid = dc.reshape(rows, columns, v, h).transpose(0, 2, 1, 3).reshape(rows * v, columns * h)
            grid = grid[: -(-image["height"] // 8), : -(-image["width"] // 8)]
            result[i][k] = np.clip(np.rint(grid * (q / 8.0)) + 128, 0, 255).astype(np.uint8)
    return result


def mean_hash(thumbnail: np.ndarray) -> int:
    """64 bits: which cells of an 8x8 grid of means are above the mean of all cells."""
    cells = thumbnail.astype(np.int64)
    count = np.ones((8, 8), np.int64)
    for axis in (0, 1):
        n = thumbnail.shape[axis]
        first = np.arange(8) * n // 8
        cells = np.add.reduceat(cells, first, axis=axis) if n >= 8 else cells.take(first, axis=axis)
        size = np.diff(first, append=n) if n >= 8 else np.ones(8, np.int64)
        count *= size[:, None] if axis == 0 else size
    cells = cells / count
    return int.from_bytes(np.packbits((cells > cells.mean()).reshape(-1)).tobytes())


def with_media(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and the media column: the text's UTF-8 bytes, padded with spaces to a positive multiple of 192,
    as lossless JPEG. A null text is empty; a row stays a row, whatever its key; other columns aren't looked at."""

    def run(batches):
        for batch in batches:
            for lo, hi, data, offsets in blocks(batch.column(1)):
                sizes = np.diff(offsets)
                payloads = []
                for i, n in enumerate(sizes):
                    padded = np.full(max(ROW, -(-int(n) // ROW) * ROW), 32, np.uint8)
                    padded[:n] = data[offsets[i] : offsets[i + 1]]
                    payloads.append(padded)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), pa.array(sizes, pa.int64()), pa.array(encode(payloads), pa.binary())], names=["doc_id", "n_bytes", "media"]
                )

    from pyspark.sql import functions as F

    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width int, height int"


def media_features(media: DataFrame, group_bytes: int = 2 << 20) -> DataFrame:
    """Reads the media column back: payload digests, dimensions, and the hash of the thumbnail; images of about
    group_bytes are decoded side by side, and only they are in memory. The feature is 'width x height:hash'."""

    def run(batches):
        for batch in batches:
            ids, sizes, column = batch.column(0), batch.column(1), batch.column(2)
            lo = 0
            while lo < len(batch):
                hi, held, total = lo, [], 0
                while hi < len(batch) and (not held or total < group_bytes):
                    held.append(column[hi].as_py())
                    total += len(held[-1])
                    hi += 1
                rows = []
                for data, images in zip(held, thumbnails(held)):
                    whole = images[0] if len(images) == 1 else np.concatenate(images)
                    payload = whole.tobytes()
                    height, width = whole.shape[0] * 8, whole.shape[1] * 8
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(data), hashlib.sha256(data).hexdigest(), f"{width}x{height}:{mean_hash(whole):016x}", width, height))
                cols = list(zip(*rows))
                types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int32()]
                names = [x.split()[0] for x in FEATURES.split(", ")]
                yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), sizes.slice(lo, hi - lo), *(pa.array(c, t) for c, t in zip(cols, types))], names=names)
                lo = hi

    return media.mapInArrow(run, FEATURES)
