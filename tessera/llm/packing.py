"""Best-fit packing of token sequences, with lower bounds that certify each partition and rounds that exchange what is left."""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import small_batches, stored

#: Chunks that a worker keeps (twice as many at most), none longer than this many bytes; texts are read in slices of about
#: SLICE bytes, cut at white space.
CACHE, CACHE_LENGTH, SLICE = 400_000, 40, 1 << 20
#: Marks that are a piece of their own after a letter and at the end of a chunk.
MARKS = b".,;:!?"
MARKED = re.compile(rb"(?<=[A-Za-z])([.,;:!?])(?=[ \t-\r])")
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class Ids(dict):
    """Token ids by the tokenizers library, of texts whose words come again and again: chunk of text to its ids as
    little-endian 32-bit integers.

    Where the tokenizer splits by a pattern without white space, chunks between ASCII white space are encoded each by itself:
    the library normalises them and its model encodes their pieces. Any other tokenizer gets whole texts."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.whole = whole = Tokenizer.from_file(path)
        whole.no_truncation()
        whole.no_padding()
        spec = json.loads(whole.to_str())
        kinds = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = [x["type"] for x in (spec["pre_tokenizer"] or {}).get("pretokenizers", [])]
        self.plain = spec["model"]["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or splits != ["Split", "ByteLevel"]
        self.before: dict[bytes, bytes] = {}
        if not self.plain:
            from tessera.llm.bpe import byte_symbols

            self.pieces = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
            self.special = [x["content"] for x in spec["added_tokens"]]
            self.symbols, self.model, self.normalizer = dict(enumerate(byte_symbols())), whole.model, whole.normalizer
            self.marks = {m: self.piece(chr(m)) for m in MARKS}

    def piece(self, piece: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.symbols))]).tobytes()

    def mixed(self, text: str) -> bytes:
        """The ids of a chunk that is more than a word."""
        if any(s in text for s in self.special):
            return array("I", self.whole.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.piece, self.pieces.findall(text.lower() if text.isascii() else self.normalizer.normalize_str(text))))

    def __missing__(self, chunk: bytes) -> bytes:
        text, mark = chunk.decode(), b""
        if chunk[-1] in self.marks and text[:-1].isalpha():  # kept as a word and a mark
            text, mark, chunk = text[:-1], self.marks[chunk[-1]], chunk[:-1]
        found = self.get(chunk) or self.before.get(chunk)
        if found is None:
            found = self.piece(text.lower() if text.isascii() else self.normalizer.normalize_str(text)) if text.isalpha() else self.mixed(text)
        if len(self) >= CACHE:
            self.before = dict(self)
            self.clear()
        if len(chunk) <= CACHE_LENGTH:
            self[chunk] = found
        return found + mark

    def encode(self, raw: bytes) -> bytes:
        """The ids of a whole text."""
        if self.plain:
            return array("I", self.whole.encode(raw.decode(), add_special_tokens=False).ids).tobytes()
        return b"".join([b"".join(map(self.__getitem__, MARKED.sub(rb" \1", part).split())) for part in sliced(raw)])


def sliced(raw: bytes) -> Iterator[bytes]:
    """The text in slices of about SLICE bytes; a slice ends before ASCII white space."""
    at = 0
    while len(raw) - at > SLICE:
        m = re.compile(rb"[ \t-\r]").search(raw, at + SLICE)
        to = m.start() if m else len(raw)
        yield raw[at:to]
        at = to
    yield raw[at:]


_loaded: dict[str, Ids] = {}


def token_pieces(df: DataFrame, path: str, capacity: int = 4096, end: int = 1, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of at most `capacity` tokens: doc_id, piece (from 0), start, length and the checksum of its
    ids. A document is its text's ids, then `end`; a null text is empty, so that it is one piece of one token. Rows of one
    doc_id stay apart; other columns aren't looked at. The tokenizer file has to be at `path` on every executor."""

    def run(batches):
        ids = _loaded.get(path) or _loaded.setdefault(path, Ids(path))
        last = np.array([end], "<u4").tobytes()
        for batch in batches:
            out: list[list] = [[], [], [], [], []]
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                raw = (ids.encode(t.as_buffer().to_pybytes()) if t.is_valid else b"") + last
                for piece, at in enumerate(range(0, len(raw), 4 * capacity)):
                    part = raw[at : at + 4 * capacity]
                    for c, v in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                        c.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    small_batches(df.sparkSession)
    return df.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES)


def lower_bound(counts: np.ndarray) -> int:
    """A number of sequences that no packing of counts[s] items of length s (0 <= s <= capacity) can go below.

    Dual feasible functions weigh lengths so that no sequence holds more than its capacity's weight: f_t takes lengths above
    capacity - t as whole sequences and those below t as nothing, for each t up to a half; g_k rounds (k+1) s / capacity down
    to k-ths, and keeps s where that is a whole number. The bound is the largest weight of all, rounded up."""
    capacity = len(counts) - 1
    s = np.arange(capacity + 1)
    tokens, n = np.cumsum(counts * s), np.cumsum(counts)
    t = np.arange(1, capacity // 2 + 1)
    weights = capacity * (n[-1] - n[capacity - t]) + tokens[capacity - t] - tokens[t - 1]
    best = max(int(-(-tokens[-1] // capacity)), int(-(-weights.max() // capacity)) if len(t) else int(n[-1]))
    for k in range(1, 13):
        up = (k + 1) * s
        g = np.where(up % capacity == 0, k * s, up // capacity * capacity)
        best = max(best, int(-(-int((counts * g).sum()) // (k * capacity))))
    return best


def best_fit(sizes: list[int], capacity: int) -> tuple[list[int], list[int], list[int]]:
    """The sequence of each size, its offset there, and what stays free in each sequence. A size goes where it leaves the
    least; bit r of a mask says that a sequence with r tokens free is there, so that the search is one shift."""
    open_, mask, where, offset, free = [[] for _ in range(capacity + 1)], 0, [], [], []
    for s in sizes:
        if fits := mask >> s:
            r = s + (fits & -fits).bit_length() - 1
            b = open_[r].pop()
            if not open_[r]:
                mask ^= 1 << r
        else:
            b, r = len(free), capacity
            free.append(r)
        where.append(b)
        offset.append(capacity - r)
        free[b] = r = r - s
        if r:
            open_[r].append(b)
            mask |= 1 << r
    return where, offset, free


def repacked(capacity: int, release: int):
    """A function of one partition's items: best-fit decreasing, unless the items' earlier sequences are fewer. The
    emptiest sequences are released until the bound certifies the number of those that stay: `release` of them at least, and
    a quarter of those that aren't full (0: all stay)."""

    def run(table: pa.Table) -> pa.Table:
        table = table.drop_columns(["__part"])
        length, uid = table.column("length").to_numpy(), table.column("uid").to_numpy()
        order = np.lexsort((uid, -length))
        table = table.take(pa.array(order))
        length, uid = length[order], uid[order]
        where, offset, free = map(np.array, best_fit(length.tolist(), capacity))
        before = table.column("sequence_id")
        if not before.null_count and len(olds := np.unique(before.to_numpy())) <= len(free):
            where, offset = np.searchsorted(olds, before.to_numpy()), table.column("offset").to_numpy()
            free = capacity - np.bincount(where, length, len(olds)).astype(np.int64)
        first = np.full(len(free), np.iinfo(np.int64).max)
        np.minimum.at(first, where, uid)
        fullest, give = np.argsort(free, kind="stable"), min(max(release, (free > 0).sum() // 4 if release else 0), len(free))
        while release and give < len(free):
            keep = np.zeros(len(free), bool)
            keep[fullest[: len(free) - give]] = True
            if lower_bound(np.bincount(length[keep[where]], minlength=capacity + 1)) == keep.sum():
                break
            give = min(2 * give, len(free))
        gone = np.zeros(len(free), bool)
        gone[fullest[len(free) - give :]] = give > 0
        for name, values in (("sequence_id", pa.array(first[where], pa.int64())), ("offset", pa.array(offset, pa.int64())), ("released", pa.array(gone[where]))):
            table = table.set_column(table.column_names.index(name), name, values)
        return table

    return run


def packed(pieces: DataFrame, capacity: int = 4096, rows: int = 16_384, release: int = 8) -> DataFrame:
    """sequence_id and offset for every row of `pieces` (length: 1 to `capacity` tokens), in as few sequences as best-fit
    decreasing finds.

    Items are dealt to partitions of some `rows` items by a hash. Each partition packs its own; dual-feasible bounds certify
    the sequences that it keeps, and the emptiest ones, more of them where there is a gap, go into the exchange: their items
    are dealt anew, to fewer partitions, packed again and kept in their earlier sequences where those were fewer. That ends
    when one partition holds what is left. A sequence is known by an id of its first item; full pieces are sequences.
    No task holds more than one partition, whatever the number of rows, equal lengths or equal keys. Empty: empty."""
    fixed = ["sequence_id long", "offset long", "released boolean"]
    items = stored(pieces.withColumn("uid", F.monotonically_increasing_id()), "pack-items")
    full = items.filter(F.col("length") >= capacity).select(*pieces.columns, F.col("uid").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    left = items.filter(F.col("length") < capacity).selectExpr("*", *(f"CAST(NULL AS {c.split()[1]}) AS {c.split()[0]}" for c in fixed))
    kept, n, turn = full, left.count(), 0
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in left.schema)
    parts = max(-(-n // rows), min(48, n // 64 + 1))
    while n:
        together = F.coalesce("sequence_id", "uid")
        dealt = left.withColumn("__part", F.pmod(F.xxhash64(together, F.lit(turn)), F.lit(parts)))
        done = dealt.groupBy("__part").applyInArrow(repacked(capacity, release if parts > 1 else 0), schema)
        done = stored(done, "pack-round")
        kept = kept.unionByName(done.filter("NOT released").select(*pieces.columns, "sequence_id", "offset"))
        left = done.filter("released")
        n, before = left.count(), n
        parts, turn = (1 if n <= rows else min(-(-n // rows), max(1, parts // 2))), turn + 1
        if n > before // 2 and turn > 4:  # nothing to gain: hardly any partition keeps anything
            return kept.unionByName(left.select(*pieces.columns, "sequence_id", "offset"))
    return kept


def certificate(packing: DataFrame, capacity: int = 4096) -> tuple[int, int]:
    """The number of sequences, and a number that no packing of these lengths can go below; `capacity` sums at most."""
    counts = np.zeros(capacity + 1, np.int64)
    for r in packing.groupBy("length").count().collect():
        counts[r["length"]] = r["count"]
    return packing.select("sequence_id").distinct().count(), lower_bound(counts) if counts.sum() else 0
