"""Queries of flow exports with templates. Spark writes the datagrams from the events; the SQL reads the events themselves."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from tessera.sources import exports
from tessera.sources.tables import table

#: Two layouts of one template number: element, bytes, and the column it takes. Version 10 has a text of variable length.
LAYOUTS = {
    "a": ((8, 4, "src"), (12, 4, "dst"), (7, 2, "sport"), (11, 2, "dport"), (4, 1, "proto"), (2, 4, "packets"), (1, 4, "bytes"), (22, 4, "first"), (21, 4, "last")),
    "b": ((1, 8, "bytes"), (2, 8, "packets"), (21, 4, "last"), (4, 1, "proto"), (12, 4, "dst"), (8, 4, "src"), (11, 2, "dport"), (7, 2, "sport"), (22, 4, "first")),
}


def _digits(x, size):
    return F.lpad(F.hex(x), 2 * size, "0")


def datagrams(spark, sf):
    """A datagram for each event, from one of seven exporters (even ones: version 9). Every fiftieth event of an exporter
    brings a template, in turns of one layout and of the other, so that data come before, with and after their template."""
    e = table(spark, sf, "events")
    e = e.select((F.col("user_id") % 7).alias("x"), F.col("event_id").alias("n"), F.get_json_object("props", "$.k").cast("bigint").alias("k"), "event_type", F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("s"))
    w = Window.partitionBy("x").orderBy("n")
    e = e.withColumn("i", F.row_number().over(w) - 1).withColumn("told", F.when(F.col("i") % 50 == 20, F.when(F.floor(F.col("i") / 50) % 2 == 0, "a").otherwise("b")))
    e = e.withColumn("layout", F.coalesce(F.last("told", True).over(w), F.lit("a")))
    new = F.col("x") % 2 == 1
    cells = {"src": F.lit(10 << 24) + F.col("n"), "dst": F.lit(203 << 24) + F.col("k"), "sport": 1024 + F.col("n") % 60000, "dport": F.col("k"), "proto": F.lit(6), "packets": F.col("k") + 1, "bytes": F.col("k") * 100, "first": F.lit(1000), "last": F.lit(1000) + F.col("k")}
    text = F.concat(_digits(F.length("event_type"), 1), F.hex(F.encode("event_type", "UTF-8")))
    record = lambda a: F.concat(*(_digits(cells[c], size) for _, size, c in LAYOUTS[a]), F.when(new, text).otherwise(""))
    template = lambda a: F.concat(*(F.concat(_digits(F.lit(el), 2), _digits(F.lit(size), 2)) for el, size, _ in LAYOUTS[a]), F.when(new, F.lit("8064FFFF0000270F")).otherwise(""))
    fields = len(LAYOUTS["a"])
    told = F.when(F.col("told").isNull(), "").otherwise(F.concat(_digits(F.lit(256), 2), _digits(F.when(new, fields + 1).otherwise(fields), 2), F.when(F.col("told") == "a", template("a")).otherwise(template("b"))))
    framed = lambda number, body: F.when(body == "", "").otherwise(F.concat(_digits(number, 2), _digits(F.length(body) / 2 + 4, 2), body))
    body = F.concat(framed(F.when(new, 2).otherwise(0), told), framed(F.lit(256), F.when(F.col("layout") == "a", record("a")).otherwise(record("b"))))
    head9 = F.concat(F.lit("00090001"), _digits(F.lit(5000), 4), _digits(F.col("s"), 4), _digits(F.col("i"), 4), _digits(F.col("x"), 4))
    head10 = F.concat(F.lit("000A"), _digits(F.length(body) / 2 + 16, 2), _digits(F.col("s"), 4), _digits(F.col("i"), 4), _digits(F.col("x"), 4))
    return e.select(F.concat(F.lit("x"), F.col("x").cast("string")).alias("exporter"), "n", F.unhex(F.concat(F.when(new, head10).otherwise(head9), body)).alias("data"))


def export_templates(spark, sf):
    good, _ = exports.decoded(exports.export_sets(datagrams(spark, sf), "exporter", "n", "data"))
    text = F.decode(F.col("other")["9999:100"], "UTF-8")
    return good.select("exporter", "n", "version", "src", "dst", "src_port", "dst_port", "protocol", "packets", "bytes", F.coalesce("start_us", F.lit(0)).alias("start_us"), F.coalesce("end_us", F.lit(0)).alias("end_us"), text.alias("kind"))


TEMPLATES = """SELECT 'x' || user_id % 7 AS exporter, event_id AS n, (9 + user_id % 7 % 2)::INTEGER AS version, concat_ws('.', 10, event_id // 65536, event_id // 256 % 256, event_id % 256) AS src, '203.0.0.' || k AS dst,
  1024 + event_id % 60000 AS src_port, k AS dst_port, 6 AS protocol, k + 1 AS packets, k * 100 AS bytes,
  CASE WHEN user_id % 7 % 2 = 0 THEN (s * 1000 - 4000) * 1000 ELSE 0 END AS start_us, CASE WHEN user_id % 7 % 2 = 0 THEN (s * 1000 - 4000 + k) * 1000 ELSE 0 END AS end_us, CASE WHEN user_id % 7 % 2 = 1 THEN event_type END AS kind
FROM (SELECT *, CAST(json_extract(props, '$.k') AS BIGINT) AS k, epoch_us(ts) // 1000000 AS s FROM events)"""


def export_sequences(spark, sf):
    """Losses by exporter where every seventh datagram is missing."""
    sets = exports.export_sets(datagrams(spark, sf).filter("n % 7 <> 3"), "exporter", "n", "data")
    messages = sets.filter("version = 9").groupBy("exporter", "n").agg(F.first("sequence").alias("sequence")).withColumn("one", F.lit(1))
    gaps = exports.sequence_gaps(messages, ["exporter"], "n", "sequence", "one")
    return gaps.groupBy("exporter").agg(F.count("*").alias("messages"), F.sum("lost").alias("lost"), F.sum((F.col("lost") > 0).cast("bigint")).alias("gaps"))


SEQUENCES = """WITH e AS (
  SELECT user_id % 7 AS x, event_id AS n, row_number() OVER (PARTITION BY user_id % 7 ORDER BY event_id) AS i FROM events WHERE user_id % 7 % 2 = 0
), g AS (SELECT x, n, i - lag(i) OVER (PARTITION BY x ORDER BY n) - 1 AS lost FROM e WHERE n % 7 <> 3)
SELECT 'x' || x AS exporter, count(*) AS messages, sum(lost)::BIGINT AS lost, sum((lost > 0)::INT)::BIGINT AS gaps FROM g GROUP BY x"""

QUERIES = {q.__name__: q for q in (export_templates, export_sequences)}
ORACLE = {"export_templates": TEMPLATES, "export_sequences": SEQUENCES}
