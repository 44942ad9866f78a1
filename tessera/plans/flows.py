"""Queries of flow records in CSV files, which Spark writes from the events, with their SQL."""

import uuid

from pyspark.sql import functions as F

from tessera.functions.scalars import rounded
from tessera.sources import flows
from tessera.sources.stored import shared_folder
from tessera.sources.tables import table, updates


def _events(spark, sf, pattern):
    e = table(spark, sf, "events")
    k = F.get_json_object("props", "$.k").cast("bigint")
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return e.select(F.col("event_id").alias("e"), F.col("user_id").alias("u"), k.alias("k"), F.col("value").alias("v"), F.col("event_type").alias("kind"), us.alias("us"), F.date_format("ts", pattern).alias("stamp"))


def _sql(pattern):
    return f"WITH v AS (SELECT event_id AS e, user_id AS u, CAST(json_extract(props, '$.k') AS BIGINT) AS k, value AS v, event_type AS kind, epoch_us(ts) AS us, strftime(ts, '{pattern}') AS stamp FROM events)"


def _written(rows, columns):
    path = f"{shared_folder(rows.sparkSession)}/flows/{uuid.uuid4().hex}"
    rows.selectExpr(*(f"CAST({x} AS STRING) AS `{name}`" for name, x in columns.items())).write.option("header", True).option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).csv(path)
    return path


#: Columns of a file of the first layout, as SQL that both engines read.
CIC = {
    "Src IP": "concat('10.0.', u % 250, '.', u % 200 + 1)", "Src Port": "1024 + e % 60000", "Dst IP": "CASE WHEN k % 17 = 0 THEN '224.0.0.251' WHEN k % 13 = 0 THEN concat('2001:db8::', k) WHEN k % 11 = 0 THEN concat('fd00::', k) ELSE concat('203.0.113.', k) END",
    "Dst Port": "20 + k", "Protocol": "CASE e % 5 WHEN 0 THEN 17 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 6 END", "Timestamp": "stamp",
    "Flow Duration": "CASE WHEN e % 23 = 0 THEN '-1' WHEN e % 29 = 0 THEN 'NaN' WHEN e % 31 = 0 THEN 'Infinity' ELSE concat(e % 5000 * 1000 + k) END", "Tot Fwd Pkts": "e % 5", "Tot Bwd Pkts": "k % 3",
    "TotLen Fwd Pkts": "e % 1000", "TotLen Bwd Pkts": "CASE WHEN e % 37 = 0 THEN '' ELSE concat(k * 10) END", "Flow IAT Mean": "k * 1000", "Flow IAT Std": "k * 500", "Flow IAT Max": "k * 3000", "FIN Flag Cnt": "e % 2",
    "SYN Flag Cnt": "e % 3", "RST Flag Cnt": "0", "PSH Flag Cnt": "k % 2", "ACK Flag Cnt": "1", "URG Flag Cnt": "0", "CWE Flag Count": "0", "ECE Flag Cnt": "CASE WHEN e % 41 = 0 THEN 'x' ELSE concat(k % 5) END",
    "Init Fwd Win Byts": "CASE WHEN e % 7 = 0 THEN -1 ELSE 8192 END", "Init Bwd Win Byts": "1000 + k", "Label": "CASE WHEN kind = 'error' THEN 'Infiltration' ELSE 'Benign' END",
}


def cic_flows(spark, sf):
    good, _ = flows.cic_flows(spark, _written(_events(spark, sf, "dd/MM/yyyy HH:mm:ss"), CIC))
    rows = flows.with_entities(good)
    exact = ["raw_hash", "start_us", "event_us", "time_basis", "label", "initiator", "initiator_kind", "responder_kind", "responder_internal", "service"]
    numbers = ["protocol", "src_port", "dst_port", "packets", "bytes_bwd", "unanswered", "fin", "tcp_flags", "window_fwd", "window_bwd", "duration", "iat_mean", "iat_var"]
    return rows.select(*exact, *(rounded(F.col(c), 9).alias(c) for c in numbers), F.array_join("refused", ",").alias("refused"))


CIC_SQL = _sql("%d/%m/%Y %H:%M:%S") + f""", r AS (
  SELECT *, sha256(concat_ws(',', {', '.join(f'({x})::VARCHAR' for x in CIC.values())})) AS raw_hash, us // 1000000 * 1000000 AS start_us,
    CASE e % 5 WHEN 0 THEN 17.0 WHEN 1 THEN NULL WHEN 2 THEN 1.0 ELSE 6.0 END AS protocol, e % 5 > 2 AS tcp, e % 5 IN (0, 3, 4) AS ports,
    CASE WHEN e % 23 > 0 AND e % 29 > 0 AND e % 31 > 0 THEN (e % 5000 * 1000 + k) / 1e6 END AS duration, e % 5 + k % 3 AS packets, {CIC['Dst IP']} AS dst
  FROM v)
SELECT raw_hash, start_us, start_us + coalesce((e % 5000 * 1000 + k) * (duration IS NOT NULL)::INT, 0) AS event_us, (duration IS NOT NULL)::INT AS time_basis, {CIC['Label']} AS label, {CIC['Src IP']} AS initiator,
  'host' AS initiator_kind, CASE WHEN k % 17 = 0 THEN 'multicast' WHEN k % 13 <> 0 AND k % 11 = 0 THEN 'host' ELSE 'external' END AS responder_kind, k % 17 <> 0 AND k % 13 <> 0 AND k % 11 = 0 AS responder_internal,
  CASE WHEN ports THEN concat(dst, ':', 20 + k, CASE WHEN tcp THEN '/tcp' ELSE '/udp' END) END AS service, protocol, CASE WHEN ports THEN 1024.0 + e % 60000 END AS src_port, CASE WHEN ports THEN 20.0 + k END AS dst_port,
  packets::DOUBLE AS packets, CASE WHEN e % 37 > 0 THEN k * 10.0 END AS bytes_bwd, (k % 3 = 0)::INT::DOUBLE AS unanswered, CASE WHEN tcp THEN (e % 2)::DOUBLE END AS fin,
  CASE WHEN tcp AND e % 41 > 0 THEN 16.0 + e % 2 + 2 * (e % 3 > 0)::INT + 8 * (k % 2) + 64 * (k % 5 > 0)::INT END AS tcp_flags, CASE WHEN tcp AND e % 7 > 0 THEN 8192.0 END AS window_fwd,
  CASE WHEN tcp THEN 1000.0 + k END AS window_bwd, round(duration, 9) AS duration, CASE WHEN packets >= 2 THEN round(k / 1000.0, 9) END AS iat_mean,
  CASE WHEN packets >= 3 THEN round((k * 500 / 1e6) ** 2 * (packets - 2) / (packets - 1), 9) END AS iat_var,
  concat_ws(',', CASE WHEN protocol IS NULL THEN 'protocol' END, CASE WHEN duration IS NULL THEN 'duration' END, CASE WHEN packets < 2 THEN 'iat_mean' END, CASE WHEN packets < 2 THEN 'iat_max' END, CASE WHEN packets < 3 THEN 'iat_var' END,
    CASE WHEN tcp AND e % 41 = 0 THEN 'tcp_flags' END, CASE WHEN tcp AND e % 7 = 0 THEN 'window_fwd' END) AS refused
FROM r"""

ARGUS = {
    "StartTime": "stamp", "Dur": "CASE WHEN e % 19 = 0 THEN '-0.5' ELSE concat(k, '.25') END", "Proto": "CASE e % 4 WHEN 0 THEN 'tcp' WHEN 1 THEN 'UDP' WHEN 2 THEN 'icmp' ELSE 'llc' END",
    "SrcAddr": "CASE WHEN e % 43 = 0 THEN '' ELSE concat('147.32.', u % 250, '.', k) END", "Sport": "CASE WHEN e % 3 = 0 THEN '0x1f90' ELSE concat(1000 + k) END", "Dir": "'  <->'", "DstAddr": "concat('198.51.100.', k)",
    "Dport": "CASE WHEN e % 47 = 0 THEN 'http' ELSE concat(k) END", "State": "CASE k % 3 WHEN 0 THEN 'FSPA_FSRA' WHEN 1 THEN 'S_' ELSE 'CON' END", "sTos": "0", "dTos": "0", "TotPkts": "k", "TotBytes": "e % 1000",
    "SrcBytes": "k * 5", "Label": "concat('flow=', kind)",
}


def argus_flows(spark, sf):
    good, _ = flows.argus_flows(spark, _written(_events(spark, sf, "yyyy/MM/dd HH:mm:ss.SSSSSS"), ARGUS), offset_hours=2)
    rows = flows.with_entities(good, ["147.32.0.0/16"], synthetic_internal=False)
    exact = ["raw_hash", "start_us", "event_us", "argus_proto", "synthetic", "initiator_internal", "service", "dir"]
    numbers = ["protocol", "src_port", "dst_port", "packets", "bytes_fwd", "bytes_bwd", "bidir_ratio", "tcp_flags", "unanswered"]
    return rows.select(*exact, *(rounded(F.col(c), 9).alias(c) for c in numbers), F.array_join("refused", ",").alias("refused"))


ARGUS_SQL = _sql("%Y/%m/%d %H:%M:%S.%f") + f""", r AS (
  SELECT *, sha256(concat_ws(',', {', '.join(f"({x})::VARCHAR" for x in ARGUS.values())})) AS raw_hash, us - 7200000000 AS start_us, e % 43 > 0 AS known, e % 1000 - k * 5 AS back, e % 4 < 2 AS ports FROM v)
SELECT raw_hash, start_us, start_us + CASE WHEN e % 19 > 0 THEN k * 1000000 + 250000 ELSE 0 END AS event_us, lower({ARGUS['Proto']}) AS argus_proto, NOT known AS synthetic, known AS initiator_internal,
  CASE WHEN known AND ports AND e % 47 > 0 THEN concat('198.51.100.', k, ':', k, CASE WHEN e % 4 = 0 THEN '/tcp' ELSE '/udp' END) END AS service, '<->' AS dir,
  CASE e % 4 WHEN 0 THEN 6.0 WHEN 1 THEN 17.0 WHEN 2 THEN 1.0 END AS protocol, CASE WHEN ports THEN CASE WHEN e % 3 = 0 THEN 8080.0 ELSE 1000.0 + k END END AS src_port,
  CASE WHEN ports AND e % 47 > 0 THEN k::DOUBLE END AS dst_port, k::DOUBLE AS packets, k * 5.0 AS bytes_fwd, CASE WHEN back >= 0 THEN back::DOUBLE END AS bytes_bwd,
  CASE WHEN back >= 0 AND k > 0 THEN round(back / (k * 5.0), 9) END AS bidir_ratio, CASE WHEN e % 4 = 0 THEN CASE k % 3 WHEN 0 THEN 31.0 WHEN 1 THEN 2.0 END END AS tcp_flags, CASE WHEN back >= 0 THEN (back = 0)::INT::DOUBLE END AS unanswered,
  concat_ws(',', CASE WHEN e % 4 = 3 THEN 'protocol' END, CASE WHEN ports AND e % 47 = 0 THEN 'dst_port' END, CASE WHEN e % 19 = 0 THEN 'duration' END, CASE WHEN back < 0 THEN 'bytes_bwd' END, CASE WHEN back < 0 AND k > 0 THEN 'bidir_ratio' END,
    CASE WHEN e % 4 = 0 AND k % 3 = 2 THEN 'tcp_flags' END, CASE WHEN back < 0 THEN 'unanswered' END) AS refused
FROM r"""

IOT = {
    "flow_duration": "v", "Protocol Type": "CASE WHEN e % 3 = 0 THEN '6' WHEN e % 3 = 1 THEN '6.4' ELSE '17' END", "Duration": "CASE WHEN k % 9 = 0 THEN 'NaN' ELSE concat(k, '.5') END", "syn_count": "CASE WHEN k % 2 = 0 THEN '2' ELSE '0.35' END",
    "ack_count": "k", "fin_count": "0", "urg_count": "1", "rst_count": "e % 3", "label": "kind",
}


def iot_windows(spark, sf):
    good, _ = flows.iot_windows(spark, _written(_events(spark, sf, "yyyy"), IOT))
    counted = good.groupBy("label", "protocol", F.array_join("refused", ",").alias("refused"))
    return counted.agg(F.count("*").alias("n"), *(F.sum(c).alias(c) for c in ("syn", "ack", "rst")), rounded(F.sum("ttl")).alias("ttl"), F.countDistinct("raw_hash").alias("lines"))


IOT_SQL = _sql("%Y") + """, r AS (
  SELECT kind AS label, CASE e % 3 WHEN 0 THEN 6.0 WHEN 2 THEN 17.0 END AS protocol, e % 3 = 0 AS tcp, *, concat_ws(',', CASE WHEN e % 3 = 1 THEN 'protocol' END, CASE WHEN k % 9 = 0 THEN 'ttl' END, CASE WHEN e % 3 = 0 AND k % 2 = 1 THEN 'syn' END) AS refused FROM v)
SELECT label, protocol, refused, count(*) AS n, sum(CASE WHEN tcp AND k % 2 = 0 THEN 2.0 END) AS syn, sum(CASE WHEN tcp THEN k::DOUBLE END) AS ack, sum(CASE WHEN tcp THEN (e % 3)::DOUBLE END) AS rst,
  round(sum(CASE WHEN k % 9 > 0 THEN k + 0.5::DOUBLE END), 6) AS ttl, count(DISTINCT (v, e % 3, k)) AS lines FROM r GROUP BY ALL"""


def flow_port_evidence(spark, sf):
    """Each user's counts as ports, in the order of events."""
    out = flows.port_evidence(updates(spark, sf), "entity", "kind", "k", ["us", "seq"], ports=8)
    return out.select("seq", "known", rounded(F.col("sequential")).alias("sequential"), rounded(F.col("random")).alias("random"))


QUERIES = {q.__name__: q for q in (cic_flows, argus_flows, iot_windows, flow_port_evidence)}
ORACLE = {"cic_flows": CIC_SQL, "argus_flows": ARGUS_SQL, "iot_windows": IOT_SQL}
