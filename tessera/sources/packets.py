"""Packet captures and flow exports read from binary files: one row for each packet or flow record."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from ipaddress import ip_address

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

PACKET_SCHEMA = "file string, number long, time_ns long, length int, captured int, src string, dst string, protocol int, src_port int, dst_port int, flags int, payload int"
FLOW_SCHEMA = "file string, sequence long, export_s long, src string, dst string, src_port int, dst_port int, protocol int, flags int, packets long, bytes long, first_ms long, last_ms long"
#: Magic numbers of capture files (microseconds, nanoseconds), the link type of Ethernet, EtherTypes.
MAGIC = {0xA1B2C3D4: 1000, 0xA1B23C4D: 1}
ETHERNET, IPV4, IPV6, VLAN = 1, 0x0800, 0x86DD, 0x8100


def _decode(frame: bytes) -> tuple:
    """Addresses, protocol, ports, TCP flags and payload length of an Ethernet frame; None where it isn't so."""
    none = (None,) * 7
    at = 12
    if len(frame) < 14:
        return none
    kind = int.from_bytes(frame[at : at + 2])
    while kind == VLAN and len(frame) >= at + 6:
        at += 4
        kind = int.from_bytes(frame[at : at + 2])
    at += 2
    if kind == IPV4 and len(frame) >= at + 20:
        head, total, protocol = (frame[at] & 15) * 4, int.from_bytes(frame[at + 2 : at + 4]), frame[at + 9]
        src, dst, end = frame[at + 12 : at + 16], frame[at + 16 : at + 20], at + total
        later = int.from_bytes(frame[at + 6 : at + 8]) & 0x1FFF
    elif kind == IPV6 and len(frame) >= at + 40:
        head, protocol, later = 40, frame[at + 6], 0
        src, dst, end = frame[at + 8 : at + 24], frame[at + 24 : at + 40], at + 40 + int.from_bytes(frame[at + 4 : at + 6])
    else:
        return none
    who = (str(ip_address(src)), str(ip_address(dst)), protocol)
    at += head
    if later or protocol not in (6, 17) or len(frame) < at + (14 if protocol == 6 else 8):
        return (*who, None, None, None, None)
    ports = struct.unpack_from(">HH", frame, at)
    size = 8 if protocol == 17 else (frame[at + 12] >> 4) * 4
    return (*who, *ports, frame[at + 13] if protocol == 6 else None, max(0, end - at - size))


def capture_packets(content: bytes) -> Iterator[tuple]:
    """(number, time_ns, length, captured, ...) of a capture file; a cut last packet is left out."""
    order = "<" if struct.unpack_from("<I", content)[0] in MAGIC else ">"
    magic, _, _, _, _, _, link = struct.unpack_from(order + "IHHiIII", content)
    if magic not in MAGIC:
        raise ValueError("not a capture file")
    at, number = 24, 0
    while at + 16 <= len(content):
        seconds, part, captured, length = struct.unpack_from(order + "IIII", content, at)
        frame = content[at + 16 : at + 16 + captured]
        if len(frame) < captured:
            break
        yield (number, seconds * 10**9 + part * MAGIC[magic], length, captured, *(_decode(frame) if link == ETHERNET else (None,) * 7))
        at, number = at + 16 + captured, number + 1


def export_flows(content: bytes) -> Iterator[tuple]:
    """Flow records of version 5 export datagrams, one after another; times are milliseconds since 1970."""
    at = 0
    while at + 24 <= len(content):
        version, count, uptime, seconds, nanos, sequence = struct.unpack_from(">HHIIII", content, at)
        if version != 5:
            raise ValueError("not version 5")
        boot = seconds * 1000 + nanos // 1_000_000 - uptime
        for i in range(count):
            r = content[at + 24 + 48 * i : at + 72 + 48 * i]
            if len(r) < 48:
                return
            packets, octets, first, last, sp, dp = struct.unpack_from(">IIIIHH", r, 16)
            yield (sequence + i, seconds, str(ip_address(r[0:4])), str(ip_address(r[4:8])), sp, dp, r[38], r[37], packets, octets, boot + first, boot + last)
        at += 24 + 48 * count


def _read(spark: SparkSession, path: str, schema: str, decode, rows: int = 20_000) -> DataFrame:
    """One task decodes a file, and hands its records over in batches of `rows`."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    names = [c.split()[0] for c in schema.split(", ")]
    types = {"string": pa.string(), "long": pa.int64(), "int": pa.int32()}
    kinds = [types[c.split()[1]] for c in schema.split(", ")]

    def run(batches):
        def block(held):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held), kinds)], names=names)

        for batch in batches:
            for name, content in zip(batch.column(0), batch.column(1)):
                held = []
                for r in decode(content.as_py()):
                    held.append((name.as_py(), *r))
                    if len(held) >= rows:
                        yield block(held)
                        held = []
                if held:
                    yield block(held)

    return files.mapInArrow(run, schema)


def captures(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, PACKET_SCHEMA, capture_packets)


def flow_exports(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, FLOW_SCHEMA, export_flows)
