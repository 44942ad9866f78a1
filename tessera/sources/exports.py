"""Flow exports whose records are described by templates (versions 9 and 10). Datagrams are rows, so that any task may split
and decode them; which template describes a set is a join on ranges of the order in which datagrams arrived."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from ipaddress import ip_address

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions.scalars import joined
from tessera.operators.ranks import PART, ranged
from tessera.sources.stored import stored

SETS = (
    "exporter string, n long, place int, domain long, version int, sequence long, export_s long, boot_ms long, kind string, template int, scope int, "
    "fields array<struct<element:int,length:int,enterprise:long>>, body binary, reason string"
)
# Numbers of information elements, and the columns that they fill.
ADDRESSES = {8: "src", 12: "dst", 15: "next_hop", 27: "src", 28: "dst", 62: "next_hop"}
NUMBERS = {
    1: "bytes", 2: "packets", 4: "protocol", 5: "tos", 6: "flags", 7: "src_port", 10: "input", 11: "dst_port", 14: "output", 21: "last_uptime_ms", 22: "first_uptime_ms", 34: "sampling", 61: "direction",
    136: "end_reason", 150: "start_s", 151: "end_s", 152: "start_ms", 153: "end_ms",
}
COLUMNS = (*dict.fromkeys(ADDRESSES.values()), *NUMBERS.values())
VARIABLE = 0xFFFF


class Broken(ValueError):
    pass


def _templates(body: bytes, version: int, options: bool) -> Iterator[tuple[int, int, list | None]]:
    """(template, number of scope fields, fields) of a set of templates; no fields: it is withdrawn (2 and 3: all of a kind)."""
    at = 0
    while at + 4 <= len(body):
        number, size = struct.unpack_from(">HH", body, at)
        if number == 0 and size == 0:
            return  # padding
        scope, at = 0, at + 4
        if options and version == 9:
            if at + 2 > len(body):
                raise Broken("options template is cut")
            (rest,) = struct.unpack_from(">H", body, at)
            if size % 4 or rest % 4:
                raise Broken(f"options template {number} of odd size")
            scope, size, at = max(1, size // 4), (size + rest) // 4, at + 2
        elif size == 0:
            yield number, 0, None
            continue
        elif options:
            scope, at = int.from_bytes(body[at : at + 2]), at + 2
            if not 1 <= scope <= size:
                raise Broken(f"template {number} with scope {scope} of {size}")
        fields = []
        for _ in range(size):
            if at + 4 > len(body):
                raise Broken(f"template {number} is cut")
            element, length = struct.unpack_from(">HH", body, at)
            at, enterprise = at + 4, 0
            if version == 10 and element & 0x8000:
                enterprise, at, element = int.from_bytes(body[at : at + 4]), at + 4, element & 0x7FFF
                if at > len(body):
                    raise Broken(f"template {number} is cut")
            fields.append({"element": element, "length": length, "enterprise": enterprise})
        if number < 256:
            raise Broken(f"template number {number}")
        yield number, scope, fields


def split(data: bytes) -> Iterator[tuple]:
    """(domain, version, sequence, export_s, boot_ms, kind, template, scope, fields, body, reason) of a datagram's sets. What
    comes before a broken set is kept."""
    head = (None,) * 5
    bad = lambda reason, body: (*head, "broken", None, None, None, body, reason)
    version = int.from_bytes(data[:2]) if len(data) > 1 else None
    size = {9: 20, 10: 16}.get(version)
    if size is None or len(data) < size:
        yield bad("no version 9 or 10" if size is None else "header is cut", data)
        return
    if version == 9:
        _, _, uptime, seconds, sequence, domain = struct.unpack_from(">HHIIII", data)
        head = (domain, 9, sequence, seconds, seconds * 1000 - uptime)
    else:
        _, length, seconds, sequence, domain = struct.unpack_from(">HHIII", data)
        head = (domain, 10, sequence, seconds, None)
        if length != len(data):
            yield bad(f"length {length} of {len(data)} bytes", data)
            return
    at, kinds = size, {0: False, 1: True} if version == 9 else {2: False, 3: True}
    while at + 4 <= len(data):
        number, length = struct.unpack_from(">HH", data, at)
        body = data[at + 4 : at + length]
        if length < 4 or at + length > len(data):
            yield bad(f"set {number} of length {length}", data[at:])
            return
        if number in kinds:
            try:
                for template, scope, fields in _templates(body, version, kinds[number]):
                    yield (*head, "withdrawn" if fields is None else "template", template, scope, fields, None, None)
            except Broken as e:
                yield bad(str(e), body)
        elif number >= 256:
            yield (*head, "data", number, None, None, body, None)
        at += length


def export_sets(datagrams: DataFrame, exporter: str, order: str, data: str) -> DataFrame:
    """The sets of datagrams (exporter, a BIGINT that orders the datagrams of an exporter, bytes): templates, their withdrawals, data,
    and what is broken with a reason. Null bytes are an empty datagram, which is broken."""
    names = [f.name for f in datagrams.sparkSession.createDataFrame([], SETS).schema]
    kinds = [pa.string(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
    kinds += [pa.list_(pa.struct([("element", pa.int32()), ("length", pa.int32()), ("enterprise", pa.int64())])), pa.binary(), pa.string()]

    def run(batches):
        for batch in batches:
            rows = [(who, n, i, *s) for who, n, raw in zip(*(c.to_pylist() for c in batch.columns)) for i, s in enumerate(split(raw or b""))]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)], names=names)

    return datagrams.select(F.col(exporter).cast("string"), F.col(order).cast("bigint"), F.col(data).cast("binary")).mapInArrow(run, SETS)


def template_ranges(sets: DataFrame) -> DataFrame:
    """For each template that changes something, the places (n, place) it describes: from itself up to the next change; and
    before it too, back to a withdrawal or to the beginning, as sets without a template wait for the next one."""
    key = ["exporter", "domain", "template"]
    told = sets.filter("kind IN ('template', 'withdrawn')").select(*key, F.struct("n", "place").alias("at"), "scope", "fields")
    every = told.filter("template IN (2, 3) AND fields IS NULL").select("exporter", "domain", (F.col("template") == 3).alias("__options"), F.col("at").alias("__at"))
    known = told.filter("template >= 256 AND fields IS NOT NULL").groupBy(*key).agg(F.max(F.col("scope") > 0).alias("__options"))
    gone = known.join(every, ["exporter", "domain", "__options"]).select(*key, F.col("__at").alias("at"), F.lit(None).cast("int").alias("scope"), F.lit(None).cast(told.schema["fields"].dataType).alias("fields"))
    w = Window.partitionBy(*key).orderBy("at")
    changes = told.filter("template >= 256").unionByName(gone).withColumns({"__before": F.lag("fields").over(w), "__scope": F.lag("scope").over(w)})
    changes = changes.filter(~(F.col("fields").eqNullSafe(F.col("__before")) & F.col("scope").eqNullSafe(F.col("__scope"))) | F.col("__before").isNull())
    past = changes.withColumns({"__last": F.lag("at").over(w), "__open": F.lag("fields").over(w).isNull(), "until": F.lead("at").over(w)})
    return past.filter("fields IS NOT NULL").select(*key, F.when(F.col("__open"), F.col("__last")).otherwise(F.col("at")).alias("since"), "until", "scope", "fields")


def in_force(data: DataFrame, ranges: DataFrame) -> DataFrame:
    """Data sets with the fields and scope of the range that they lie in (NULL where there is none). Ranges of a template are
    disjoint, so that it is the last one that begins before a set, if that one isn't over. Both are cut into parts of n, and each part
    of a template is sorted once, after the last range that begins in the parts before it."""
    key = ["exporter", "domain", "template"]
    row, t = F.struct(*data.columns), F.struct("since", "until", "fields", "scope")
    held = ranges.filter("since IS NULL OR until IS NULL OR since < until").select(*key, F.col("since").alias("__at"), F.lit(0).alias("__side"), t.alias("__t"))
    held = held.withColumn("__row", F.lit(None).cast(data.select(row.alias("r")).schema["r"].dataType))
    asked = data.select(*key, F.struct("n", "place").alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(held.schema["__t"].dataType).alias("__t"), row.alias("__row"))
    both = asked.unionByName(held).withColumn("__n", F.coalesce(F.col("__at.n").cast("double"), F.lit(-1e308)))
    both = ranged(both, "__n").drop("__n")
    parts = both.groupBy(*key, PART).agg(F.max_by("__t", F.when(F.col("__side") == 0, F.struct("__at"))).alias("__end"))
    before = Window.partitionBy(*key).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*key, PART, F.last("__end", True).over(before).alias("__carried"))
    upto = Window.partitionBy(*key, PART).orderBy("__at", "__side").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = joined(both.withColumn("__last", F.last("__t", True).over(upto)).filter("__side = 1"), parts, [*key, PART])
    found = found.withColumn("__last", F.coalesce("__last", "__carried"))
    there = F.col("__last.until").isNull() | (F.col("__at") < F.col("__last.until"))
    return found.select("__row.*", F.when(there, F.col("__last.fields")).alias("fields"), F.when(there, F.col("__last.scope")).alias("scope"))


def _value(column: str, raw: bytes):
    if column in ("src", "dst", "next_hop"):
        return str(ip_address(raw)) if len(raw) in (4, 16) else None
    return int.from_bytes(raw) if 0 < len(raw) < 8 or (len(raw) == 8 and raw[0] < 128) else None


def records(fields: list[dict], body: bytes) -> Iterator[tuple[list, dict]]:
    """Values of the known columns, and the bytes of the others by enterprise and element. A rest shorter than a record is padding."""
    least = sum(1 if f["length"] == VARIABLE else f["length"] for f in fields)
    at = 0
    while least and at + least <= len(body):
        known, other = [None] * len(COLUMNS), {}
        for f in fields:
            length = f["length"]
            if length == VARIABLE:
                length, at = (body[at], at + 1) if at < len(body) else (0, at + 1)
                if length == 255:
                    length, at = int.from_bytes(body[at : at + 2]), at + 2
            raw, at = body[at : at + length], at + length
            if at > len(body):
                return
            name = (ADDRESSES.get(f["element"]) or NUMBERS.get(f["element"])) if not f["enterprise"] else None
            if name:
                known[COLUMNS.index(name)] = _value(name, raw)
            else:
                other[f"{f['enterprise']}:{f['element']}"] = raw
        yield known, other


def decoded(sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The records of data sets by their templates, and what can't be read: broken sets, and sets whose template never came.

    Each record has its exporter, domain, n, place and number, the known columns, `other` (bytes by enterprise:element), scope
    (above 0: a record of options) and start_us and end_us from whatever times it has."""
    sets = stored(sets, "export-sets")
    ranges = template_ranges(sets)
    ranges = stored(ranges, "export-templates")
    data = sets.filter("kind = 'data'").drop("fields", "scope", "reason", "kind")
    met = in_force(data, ranges)
    broken = sets.filter("kind = 'broken'").select("exporter", "n", "place", "body", F.col("reason").alias("_quarantine"))
    lost = met.filter("fields IS NULL").select("exporter", "n", "place", "body", F.concat(F.lit("no template "), F.col("template").cast("string")).alias("_quarantine"))
    head = ["exporter", "n", "place", "domain", "version", "sequence", "export_s", "boot_ms", "template", "scope"]
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in met.select(*head).schema), "number int", *(f"{c} {'string' if c in ADDRESSES.values() else 'long'}" for c in COLUMNS), "other map<string,binary>"])
    kinds = [pa.int32(), *(pa.string() if c in ADDRESSES.values() else pa.int64() for c in COLUMNS), pa.map_(pa.string(), pa.binary())]

    def run(batches):
        for batch in batches:
            rows, of = [], []
            for i, (fields, body) in enumerate(zip(batch.column(len(head)).to_pylist(), batch.column(len(head) + 1).to_pylist())):
                for number, (known, other) in enumerate(records(fields, body)):
                    rows.append((number, *known, list(other.items())))
                    of.append(i)
            took = batch.select(head).take(pa.array(of, pa.int32()))
            cells = [pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([*took.columns, *cells], names=[*head, "number", *COLUMNS, "other"])

    out = met.filter("fields IS NOT NULL").select(*head, "fields", "body").mapInArrow(run, schema)
    time = lambda up, s, ms: F.coalesce(F.col(ms) * 1000, F.col(s) * 1_000_000, (F.col("boot_ms") + F.col(up)) * 1000)
    return out.withColumns({"start_us": time("first_uptime_ms", "start_s", "start_ms"), "end_us": time("last_uptime_ms", "end_s", "end_ms")}), broken.unionByName(lost)


def sequence_gaps(messages: DataFrame, by: list[str], order: str, sequence: str, advance: str) -> DataFrame:
    """For each message what its sequence number, of 32 bits, says against the one before it: `lost` units, or out of order
    (`early`: it is behind what was expected). `advance` is what a message counts; NULL where that isn't known."""
    w = Window.partitionBy(*by).orderBy(order)
    gap = F.pmod(F.col(sequence) - F.lag(F.col(sequence) + F.col(advance)).over(w), F.lit(1 << 32))
    out = messages.withColumn("__gap", gap)
    return out.withColumns({"lost": F.when(F.col("__gap") < 1 << 31, F.col("__gap")).when(F.col("__gap").isNotNull(), 0), "early": F.coalesce(F.col("__gap") >= 1 << 31, F.lit(False))}).drop("__gap")
