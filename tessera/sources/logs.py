"""Text logs as columns. Lines that don't parse go to quarantine with a reason, they are never dropped."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Names of the header fields of the two vendor formats, in order.
CEF_FIELDS = ("version", "vendor", "product", "device_version", "signature", "name", "severity")
LEEF_FIELDS = ("version", "vendor", "product", "device_version", "event_id")


def lines(spark: SparkSession, path: str) -> DataFrame:
    """line and the file it came from."""
    return spark.read.text(path).select(F.col("value").alias("line"), F.col("_metadata.file_path").alias("file"))


def zeek(spark: SparkSession, path: str, fields: list[str] | None = None) -> DataFrame:
    """A tab-separated log whose header names its fields; '-' is absent, '(empty)' an empty string. All values stay
    strings. Files of one call share their fields; pass them to save reading the header."""
    rows = lines(spark, path)
    if fields is None:
        head = rows.filter(F.col("line").startswith("#fields\t")).select("line").first()
        if head is None:
            raise ValueError("no #fields line")
        fields = head[0].split("\t")[1:]
    body = rows.filter(~F.col("line").startswith("#")).withColumn("p", F.split("line", "\t", -1))
    cell = lambda i: F.get("p", F.lit(i))
    value = lambda i: F.when(cell(i) == "-", None).when(cell(i) == "(empty)", "").otherwise(cell(i))
    reason = F.when(F.size("p") != len(fields), F.concat(F.size("p").cast("string"), F.lit(" values")))
    return body.select(*(value(i).alias(f) for i, f in enumerate(fields)), reason.alias("_quarantine"), F.when(reason.isNotNull(), F.col("line")).alias("_line"))


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One JSON object a line; unknown keys stay in `_rest`, broken lines in `_quarantine`."""
    parsed = lines(spark, path).withColumn("r", F.from_json("line", f"{schema}, _broken STRING", {"columnNameOfCorruptRecord": "_broken"}))
    rest = F.from_json("line", "map<string,string>")
    out = parsed.select("r.*", rest.alias("_all"), "line")
    names = [c for c in out.columns if c not in ("_broken", "_all", "line")]
    return out.select(*names, F.map_filter("_all", lambda k, v: ~k.isin(*names)).alias("_rest"), F.col("_broken").alias("_quarantine"))


def _pairs(text: Column, between: str) -> Column:
    """key=value pairs as a map; a value reaches up to the next key."""
    keys = F.regexp_extract_all(text, F.lit(rf"(?:^|{between})([A-Za-z0-9_.\-]+)="), F.lit(1))
    values = F.regexp_extract_all(text, F.lit(rf"(?:^|{between})[A-Za-z0-9_.\-]+=(.*?)(?={between}[A-Za-z0-9_.\-]+=|$)"), F.lit(1))
    return F.map_from_entries(F.array_distinct(F.zip_with(keys, values, lambda k, v: F.struct(k, v))))


def _unescape(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, r"\\([|=])", "$1"), r"\\\\", r"\\")


def cef(line: Column) -> list[Column]:
    """Columns of a CEF line (after any syslog header), and `extension` as a map."""
    body = F.regexp_extract(line, r"CEF:(.*)$", 1)
    parts = F.split(body, r"(?<!\\)\|", 8)
    ok = F.size(parts) == 8
    fields = [F.when(ok, _unescape(F.get(parts, F.lit(i)))).alias(n) for i, n in enumerate(CEF_FIELDS)]
    return [*fields, F.when(ok, _pairs(F.get(parts, F.lit(7)), " ")).alias("extension"), F.when(~ok, "not CEF").alias("_quarantine")]


def leef(line: Column) -> list[Column]:
    """Columns of a LEEF 1.0 line, attributes divided by tabs."""
    body = F.regexp_extract(line, r"LEEF:(.*)$", 1)
    parts = F.split(body, r"\|", 6)
    ok = F.size(parts) == 6
    fields = [F.when(ok, F.get(parts, F.lit(i))).alias(n) for i, n in enumerate(LEEF_FIELDS)]
    return [*fields, F.when(ok, F.str_to_map(F.get(parts, F.lit(5)), F.lit("\t"), F.lit("="))).alias("attributes"), F.when(~ok, "not LEEF").alias("_quarantine")]


def syslog(line: Column) -> list[Column]:
    """Facility, severity, time text, host, program, pid and message of RFC 5424 and RFC 3164 lines."""
    new = r"^<(\d{1,3})>1 (\S+) (\S+) (\S+) (\S+) \S+ (?:-|(?:\[.*?\])+) ?(.*)$"
    old = r"^<(\d{1,3})>([A-Z][a-z]{2} [ \d]\d \d\d:\d\d:\d\d) (\S+) ([^:\[\s]+)(?:\[(\d+)\])?: ?(.*)$"
    pick = lambda i: F.when(line.rlike(new), F.regexp_extract(line, new, i)).when(line.rlike(old), F.regexp_extract(line, old, i))
    text = lambda i: F.nullif(F.nullif(pick(i), F.lit("")), F.lit("-"))
    code = pick(1).cast("int")
    fine = code.isNotNull() & (code <= 191)
    return [
        F.when(fine, F.floor(code / 8)).cast("int").alias("facility"), F.when(fine, code % 8).alias("severity"), text(2).alias("time"), text(3).alias("host"), text(4).alias("program"),
        text(5).alias("pid"), pick(6).alias("message"), F.when(~F.coalesce(fine, F.lit(False)), "not syslog").alias("_quarantine"),
    ]


def mapped(df: DataFrame, rules: dict[str, tuple[list[str], str]]) -> tuple[DataFrame, DataFrame]:
    """Canonical columns from source columns: for each, the source columns in order of precedence and the SQL type. The
    first one with a value wins. Returns the good rows, with a status for each column (0 observed, 3 not supplied), and
    the rows in which some value can't be converted, with the names of those columns."""
    values, bad, out = {}, [], []
    for name, (sources, kind) in rules.items():
        there = [c for c in sources if c in df.columns]
        raw = F.coalesce(*(F.nullif(F.col(c).cast("string"), F.lit("")) for c in there)) if there else F.lit(None).cast("string")
        values[f"__raw_{name}"] = raw
        out += [F.expr(f"try_cast(__raw_{name} AS {kind})").alias(name), F.when(F.col(f"__raw_{name}").isNull(), 3).otherwise(0).alias(f"s_{name}")]
        bad.append(F.when(F.col(f"__raw_{name}").isNotNull() & F.expr(f"try_cast(__raw_{name} AS {kind})").isNull(), F.lit(name)))
    rows = df.withColumns(values).withColumn("__bad", F.array_compact(F.array(*bad)))
    rest = [c for c in df.columns if c not in rules and not any(c in s for s, _ in rules.values())]
    good = rows.filter(F.size("__bad") == 0).select(*out, *rest)
    return good, rows.filter(F.size("__bad") > 0).select(*df.columns, F.concat_ws(",", "__bad").alias("_quarantine"))
