"""Flow records in CSV files of three published layouts, as typed columns. A cell that can't be a measurement is NULL and its
column's name is in `refused`; a line that isn't a row goes to quarantine; labels stay apart from what is measured."""

from __future__ import annotations

import csv
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions.convert import group_address, in_networks, is_address, trimmed
from tessera.sources.stored import stored

# Names of columns in the published files (lower case, letters and digits only), in order of precedence.
CIC = {
    "src": ("srcip", "sourceip"), "dst": ("dstip", "destinationip"), "src_port": ("srcport", "sourceport"), "dst_port": ("dstport", "destinationport"), "protocol": ("protocol",),
    "timestamp": ("timestamp",), "duration": ("flowduration",), "packets_fwd": ("totfwdpkts", "totalfwdpackets"), "packets_bwd": ("totbwdpkts", "totalbackwardpackets"),
    "bytes_fwd": ("totlenfwdpkts", "totallengthoffwdpackets"), "bytes_bwd": ("totlenbwdpkts", "totallengthofbwdpackets"), "iat_mean": ("flowiatmean",), "iat_std": ("flowiatstd",),
    "iat_max": ("flowiatmax",), "fin": ("finflagcnt", "finflagcount"), "syn": ("synflagcnt", "synflagcount"), "rst": ("rstflagcnt", "rstflagcount"), "psh": ("pshflagcnt", "pshflagcount"),
    "ack": ("ackflagcnt", "ackflagcount"), "urg": ("urgflagcnt", "urgflagcount"), "ece": ("eceflagcnt", "eceflagcount"), "cwr": ("cweflagcount", "cweflagcnt", "cwrflagcount", "cwrflagcnt"),
    "window_fwd": ("initfwdwinbyts", "initwinbytesforward"), "window_bwd": ("initbwdwinbyts", "initwinbytesbackward"), "label": ("label",),
}
ARGUS = {
    "timestamp": ("starttime",), "duration": ("dur",), "protocol": ("proto",), "src": ("srcaddr",), "src_port": ("sport",), "dir": ("dir",), "dst": ("dstaddr",), "dst_port": ("dport",),
    "state": ("state",), "packets": ("totpkts",), "bytes": ("totbytes",), "bytes_fwd": ("srcbytes",), "label": ("label",),
}
IOT = {
    "protocol": ("protocoltype",), "ttl": ("duration",), "timestamp": ("ts", "timestamp"), "syn": ("syncount",), "ack": ("ackcount",), "fin": ("fincount",), "urg": ("urgcount",),
    "rst": ("rstcount",), "label": ("label",),
}
# Patterns of times, each with its resolution in microseconds; protocol numbers; bits of TCP flags.
TIMES = (
    ("d/M/yyyy H:mm:ss", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2}$", 1_000_000), ("d/M/yyyy h:mm:ss a", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}:\d{2} [AP]M$", 1_000_000),
    ("d/M/yyyy H:mm", r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{2}$", 60_000_000), ("yyyy/M/d H:mm:ss.SSSSSS", r"^\d{4}/\d{1,2}/\d{1,2} \d{1,2}:\d{2}:\d{2}\.\d{1,6}$", 1),
    ("yyyy-M-d H:mm:ss.SSSSSS", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}\.\d{1,6}$", 1), ("yyyy-M-d H:mm:ss", r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{2}:\d{2}$", 1_000_000),
)
PROTOCOLS = {
    "icmp": 1, "igmp": 2, "ipv4": 4, "tcp": 6, "egp": 8, "udp": 17, "ipv6": 41, "rsvp": 46, "gre": 47, "esp": 50, "ah": 51, "ipv6-icmp": 58, "icmp6": 58, "pim": 103, "sctp": 132,
    "rtp": 17, "rtcp": 17, "udt": 17,
}
BITS = {"fin": 1, "syn": 2, "rst": 4, "psh": 8, "ack": 16, "urg": 32, "ece": 64, "cwr": 128}
PRIVATE = ("10.0.0.0/8", "172.16.0.0/12", "192.168.0.0/16", "fc00::/7", "169.254.0.0/16", "fe80::/10", "127.0.0.0/8", "::1/128")


def csv_cells(spark: SparkSession, path: str, aliases: dict[str, tuple[str, ...]], need: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """Rows of CSV files that share a header: file, block, row (their order is that of the file), raw_hash, and a text column
    for each name in `aliases`, NULL where the files have no such column; and the lines that aren't rows.

    The header is the first line of a file. Empty lines and repeated headers are no rows and aren't kept; lines with more or
    fewer cells than the header are quarantined. A file with another header is quarantined line by line, so that it's seen."""
    rows = spark.read.text(path).select(
        F.regexp_replace("value", "^﻿", "").alias("line"), F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row")
    )
    first = rows.filter("block = 0 AND trim(line) <> ''").select("line").first()
    if first is None:
        raise ValueError(f"{path} has no header")
    plain = lambda name: "".join(c for c in name.lower() if c.isascii() and c.isalnum())
    names = [plain(n) for n in next(csv.reader([first[0]]))]
    at = {k: next((names.index(n) for n in known if n in names), None) for k, known in aliases.items()}
    if missing := [k for k in need if at[k] is None]:
        raise ValueError(f"{path} has no column for {missing}")
    schema = ", ".join([*(f"c{i} STRING" for i in range(len(names))), "_broken STRING"])
    body = rows.filter((F.trim("line") != "") & (F.col("line") != F.lit(first[0])))
    cells = body.withColumn("c", F.from_csv("line", F.lit(schema), {"columnNameOfCorruptRecord": "_broken", "mode": "PERMISSIVE"}))
    fine = cells.filter("c._broken IS NULL")
    values = [(trimmed(F.col(f"c.c{i}")) if i is not None else F.lit(None).cast("string")).alias(k) for k, i in at.items()]
    bad = cells.filter("c._broken IS NOT NULL").select("file", "line", F.lit(f"not {len(names)} cells").alias("_quarantine"))
    return fine.select("file", "block", "row", F.sha2("line", 256).alias("raw_hash"), *values), bad


def number(x: Column) -> Column:
    """A finite number, or NULL."""
    n = x.try_cast("double")
    return F.when(~F.isnan(n) & (F.abs(n) < float("inf")), n)


def numbers(rows: DataFrame, names: list[str]) -> tuple[DataFrame, dict[str, Column]]:
    """rows with a number for each of these texts, converted once, and those columns."""
    return rows.withColumns({f"__n_{k}": number(F.col(k)) for k in names}), {k: F.col(f"__n_{k}") for k in names}


def measured(rows: DataFrame, fields: dict[str, tuple[Column, Column, Column]]) -> DataFrame:
    """Adds each field (there, value, valid) as its value where it's valid, and `refused`: the names of fields whose cells are
    there without being a measurement. `there` is false where the field doesn't apply."""
    values = {f"__{k}": F.when(there & F.coalesce(valid, F.lit(False)), value) for k, (there, value, valid) in fields.items()}
    out = rows.withColumns(values)
    refused = F.array_compact(F.array(*(F.when(F.coalesce(there, F.lit(False)) & F.col(f"__{k}").isNull(), F.lit(k)) for k, (there, _, _) in fields.items())))
    keep = [c for c in rows.columns if c not in fields and not c.startswith("__n_")]
    return out.select(*keep, *(F.col(f"__{k}").alias(k) for k in fields), refused.alias("refused"))


def timed(rows: DataFrame, text: str, offset_hours: float = 0.0) -> DataFrame:
    """Adds start_us, resolution_us and unread_time (a text that the pattern doesn't fit). Each file is read by the one
    pattern that fits most of its texts, the earlier one of equals. Texts carry no zone; `offset_hours` is what local time is ahead."""
    # texts of another shape aren't tried: a parser that fails is slow
    at = [F.when(F.upper(text).rlike(shape), F.unix_micros(F.try_to_timestamp(F.concat(F.upper(text), F.lit(" Z")), F.lit(f"{p} X")))) for p, shape, _ in TIMES]
    rows = rows.withColumns({f"__t{i}": t for i, t in enumerate(at)})
    at = [F.col(f"__t{i}") for i in range(len(TIMES))]
    fits = rows.groupBy("file").agg(*(F.count(t).alias(f"n{i}") for i, t in enumerate(at)))
    best = F.array_max(F.array(*(F.struct(F.col(f"n{i}").alias("n"), F.lit(-i).alias("i")) for i in range(len(TIMES)))))
    fits = fits.select("file", (-best["i"]).alias("__p"))
    pick = lambda xs: F.coalesce(*(F.when(F.col("__p") == i, x) for i, x in enumerate(xs)))
    out = rows.join(fits, "file", "left").withColumns({"start_us": pick(at) - int(offset_hours * 3_600_000_000), "resolution_us": pick([F.lit(r).cast("bigint") for *_, r in TIMES])})
    return out.withColumn("unread_time", F.col("start_us").isNull() & F.col(text).isNotNull()).drop("__p", *(f"__t{i}" for i in range(len(TIMES))))


def ended(rows: DataFrame) -> DataFrame:
    """Adds event_us, the end of the flow (nothing in a record is known before that), or its start where there is no duration;
    time_basis says which (1, 0, or -1 without a time)."""
    end = F.col("start_us") + F.round(F.col("duration") * 1_000_000).cast("bigint")
    return rows.withColumns({"event_us": F.coalesce(end, "start_us"), "time_basis": F.when(F.col("start_us").isNull(), -1).when(F.col("duration").isNull(), 0).otherwise(1)})


def cic_flows(spark: SparkSession, path: str, offset_hours: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Bidirectional flows of CICFlowMeter, in either spelling of its headers. Times of gaps and durations are seconds; the
    variance of gaps is that of the population. Ports are those of TCP and UDP, flags and windows those of TCP."""
    rows, bad = csv_cells(spark, path, CIC)
    there = lambda *names: F.lit(True) if not names else sum((F.col(n).isNotNull().cast("int") for n in names), F.lit(0)) == len(names)
    rows, n = numbers(rows, [k for k in CIC if k not in ("src", "dst", "timestamp", "label")])
    tcp, ports = F.coalesce(n["protocol"] == 6, F.lit(False)), F.coalesce(n["protocol"].isin(6, 17), F.lit(False))
    packets, gaps = n["packets_fwd"] + n["packets_bwd"], n["packets_fwd"] + n["packets_bwd"] - 1
    fields = {"protocol": (there("protocol"), n["protocol"], n["protocol"] > 0)}
    fields |= {k: (there(k) & ports, n[k], n[k] >= 0) for k in ("src_port", "dst_port")}
    fields["duration"] = (there("duration"), n["duration"] / 1e6, n["duration"] >= 0)
    fields |= {k: (there(k), n[k], n[k] >= 0) for k in ("packets_fwd", "packets_bwd", "bytes_fwd", "bytes_bwd")}
    fields["packets"] = (there("packets_fwd", "packets_bwd"), packets, packets >= 0)
    fields["unanswered"] = (there("packets_bwd"), (n["packets_bwd"] == 0).cast("double"), n["packets_bwd"] >= 0)
    fields["iat_mean"] = (there("iat_mean"), n["iat_mean"] / 1e6, (packets >= 2) & (n["iat_mean"] >= 0))
    fields["iat_max"] = (there("iat_max"), n["iat_max"] / 1e6, (packets >= 2) & (n["iat_max"] >= 0))
    fields["iat_var"] = (there("iat_std"), (n["iat_std"] / 1e6) ** 2 * (gaps - 1) / F.greatest(gaps, F.lit(1.0)), (packets >= 3) & (n["iat_std"] >= 0))
    fields |= {k: (there(k) & tcp, n[k], n[k] >= 0) for k in ("fin", "syn", "rst", "psh", "ack", "urg")}
    bits = sum((F.when(n[k] > 0, b).otherwise(0) for k, b in BITS.items()), F.lit(0))
    fields["tcp_flags"] = (there(*BITS) & tcp, bits, F.least(*(n[k] for k in BITS)) + sum((n[k] * 0 for k in BITS), F.lit(0.0)) >= 0)
    fields |= {k: (there(k) & tcp, n[k], n[k] >= 0) for k in ("window_fwd", "window_bwd")}
    rows = timed(measured(rows, fields), "timestamp", offset_hours)
    return ended(rows).drop("timestamp", "iat_std", "ece", "cwr"), bad


def argus_flows(spark: SparkSession, path: str, offset_hours: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """Bidirectional flows of Argus. Protocols are names; ports are decimal or 0x-hexadecimal; the state's letters on both
    sides of '_' are TCP flags; the backward bytes are the rest of the total."""
    rows, bad = csv_cells(spark, path, ARGUS, ("timestamp", "duration", "protocol", "src", "dst", "label"))
    proto = F.element_at(F.create_map(*(x for k, v in PROTOCOLS.items() for x in (F.lit(k), F.lit(float(v))))), F.lower("protocol"))
    rows = rows.withColumn("argus_proto", F.lower("protocol"))
    port = lambda k: F.when(F.lower(k).rlike("^0x[0-9a-f]{1,8}$"), F.conv(F.substring(k, 3, 8), 16, 10).cast("double")).when(F.col(k).rlike(r"^\d{1,9}$"), F.col(k).cast("double"))
    tcp, ports = F.coalesce(proto == 6, F.lit(False)), F.coalesce(proto.isin(6, 17), F.lit(False))
    rows, n = numbers(rows, ["duration", "packets", "bytes", "bytes_fwd"])
    back = n["bytes"] - n["bytes_fwd"]
    fields = {"protocol": (F.col("protocol").isNotNull(), proto, proto.isNotNull())}
    fields |= {k: (F.col(k).isNotNull() & ports, port(k), port(k).isNotNull()) for k in ("src_port", "dst_port")}
    fields |= {k: (F.col(k).isNotNull(), n[k], n[k] >= 0) for k in ("duration", "packets", "bytes_fwd")}
    both = F.col("bytes").isNotNull() & F.col("bytes_fwd").isNotNull()
    fields["bytes_bwd"] = (both, back, (back >= 0) & (n["bytes_fwd"] >= 0))
    fields["bidir_ratio"] = (both & (n["bytes_fwd"] > 0), back / F.when(n["bytes_fwd"] > 0, n["bytes_fwd"]), back >= 0)
    letters = {k[0].upper(): b for k, b in BITS.items() if k != "cwr"} | {"C": 128}
    seen = sum((F.when(F.col("state").contains(c), b).otherwise(0) for c, b in letters.items()), F.lit(0))
    fields["tcp_flags"] = (F.col("state").isNotNull() & tcp, seen, F.col("state").rlike("^[FSRPAUEC]*_[FSRPAUEC]*$"))
    fields["unanswered"] = (both, (back == 0).cast("double"), (back >= 0) & (n["bytes_fwd"] >= 0))
    rows = timed(measured(rows, fields), "timestamp", offset_hours)
    return ended(rows).drop("timestamp", "bytes"), bad


def iot_windows(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Windows of packets, without addresses and mostly without times. Values are averages over a window: one that isn't
    whole is no protocol and no count."""
    rows, bad = csv_cells(spark, path, IOT, ("label",))
    rows, n = numbers(rows, ["protocol", "ttl", "syn", "ack", "fin", "urg", "rst", "timestamp"])
    even = lambda x: (F.abs(x - F.round(x)) < 1e-9) & (x >= 0)
    tcp = F.coalesce(n["protocol"] == 6, F.lit(False))
    fields = {"protocol": (F.col("protocol").isNotNull(), n["protocol"], even(n["protocol"])), "ttl": (F.col("ttl").isNotNull(), n["ttl"], n["ttl"] >= 0)}
    fields |= {k: (F.col(k).isNotNull() & tcp, n[k], even(n[k])) for k in ("syn", "ack", "fin", "urg", "rst")}
    return measured(rows.withColumn("start_us", F.round(n["timestamp"] * 1_000_000).cast("bigint")), fields).drop("timestamp"), bad


def watermarked(rows: DataFrame) -> DataFrame:
    """Adds watermark_us, the latest event time before a row in its file, and reorder_us, how far the row is behind it (the
    resolution at least). Blocks of a file are summed up by themselves, and the blocks before each are added."""
    rows = stored(rows, "flows")
    blocks = rows.groupBy("file", "block").agg(F.max("event_us").alias("__top"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("file", "block", F.max("__top").over(before).alias("__before"))
    within = Window.partitionBy("file", "block").orderBy("row").rowsBetween(Window.unboundedPreceding, -1)
    out = rows.withColumn("__own", F.max("event_us").over(within)).join(blocks, ["file", "block"])
    out = out.withColumn("watermark_us", F.greatest("__own", "__before")).drop("__own", "__before")
    behind = F.greatest("resolution_us", F.coalesce(F.col("watermark_us") - F.col("event_us"), F.lit(0)))
    return out.withColumn("reorder_us", F.when(F.col("event_us").isNotNull(), behind))


def with_entities(rows: DataFrame, networks: list[str] | None = None, synthetic_internal: bool | None = None) -> DataFrame:
    """Adds the initiator, responder and service of each flow with their kinds: multicast for groups, host inside the networks
    (and for what is no address), external elsewhere. Rows without both addresses get two entities of their own;
    whether those are internal has to be said."""
    for x in ("src", "dst"):  # each property of an address is worked out once
        a = F.col(x)
        rows = rows.withColumns({f"__{x}_many": group_address(a), f"__{x}_inside": F.coalesce(in_networks(a, list(networks or PRIVATE)), F.lit(True)), f"__{x}_real": is_address(a)})
    many, inside = (lambda x: F.col(f"__{x}_many")), (lambda x: F.col(f"__{x}_inside"))
    kind = lambda x: F.when(many(x), "multicast").when(~F.col(f"__{x}_real") | inside(x), "host").otherwise("external")
    known = F.col("src").isNotNull() & F.col("dst").isNotNull()
    if synthetic_internal is None:
        own = F.raise_error(F.lit("rows without addresses: say whether they are internal")).cast("boolean")
    else:
        own = F.lit(synthetic_internal)
    name = F.concat(F.lit("synthetic:"), F.col("raw_hash"), F.lit(":"), F.col("row").cast("string"))
    proto = F.when(F.col("protocol") == 6, "tcp").when(F.col("protocol") == 17, "udp").when(F.col("protocol") == 132, "sctp")
    out = {"synthetic": ~known}
    for side, x in (("initiator", "src"), ("responder", "dst")):
        out[side] = F.when(known, F.col(x)).otherwise(F.concat(name, F.lit(f":{side}")))
        out[f"{side}_kind"] = F.when(known, kind(x)).otherwise("host")
        out[f"{side}_internal"] = F.when(known, ~many(x) & inside(x)).otherwise(own)
    if "dst_port" in rows.columns:
        out["service"] = F.when(known & F.col("dst_port").isNotNull() & proto.isNotNull(), F.concat(F.col("dst"), F.lit(":"), F.col("dst_port").cast("bigint").cast("string"), F.lit("/"), proto))
    return rows.withColumns(out).drop(*(f"__{x}_{p}" for x in ("src", "dst") for p in ("many", "inside", "real")))


def port_evidence(rows: DataFrame, src: str, dst: str, port: str, order: list[str], ports: int = 32, least: int = 4) -> DataFrame:
    """Evidence of port scans at each row, from rows of its pair so far: of the last `ports` different ports in the order in which
    they came up, the share of neighbours one apart (`sequential`), and how full the memory is times the rest (`random`);
    NULL below `least` ports. A port that has been forgotten comes up anew.

    Pairs are read sorted, batch by batch; what is held is one pair's ports. A pair is one task by nature."""
    names = [src, dst, *order, port]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pair, held, steps = None, deque(), 0
        for frame in frames:
            share, known = [], []
            for a, b, p in zip(frame[src].tolist(), frame[dst].tolist(), frame[port].tolist()):
                if (a, b) != pair:
                    pair, held, steps = (a, b), deque(), 0
                if p not in held:
                    if len(held) == ports:
                        gone = held.popleft()
                        steps -= abs(gone - held[0]) == 1 if held else 0
                    steps += abs(p - held[-1]) == 1 if held else 0
                    held.append(p)
                share.append(steps / (len(held) - 1) if len(held) >= max(2, least) else None)
                known.append(len(held))
            frame["sequential"], frame["known"] = pd.array(share, "Float64"), known
            yield frame

    kept = rows.select(*names).dropna(subset=[src, dst, port])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", sequential double, known int"
    out = kept.repartition(src, dst).sortWithinPartitions(src, dst, *order).mapInPandas(run, schema)
    return out.withColumn("random", F.least(F.lit(1.0), F.col("known") / ports) * (1 - F.col("sequential")))
