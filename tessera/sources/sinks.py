"""Writing results: tables by partition, small reports, and a chained log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, in folders by the given columns; rows of one folder are brought together first, so that files are few."""
    out = df.repartition(*by) if by else df
    (out.write.mode(mode).partitionBy(*by) if by else out.write.mode(mode)).parquet(path)


def markdown(df: DataFrame, most: int = 1000) -> str:
    """A report of at most `most` rows as a Markdown table; more rows are an error, as a report isn't a table."""
    rows = df.take(most + 1)
    if len(rows) > most:
        raise ValueError(f"more than {most} rows")
    cell = lambda x: "" if x is None else str(x).replace("|", "\\|").replace("\n", " ")
    table = [df.columns, ["---"] * len(df.columns), *rows]
    return "\n".join("| " + " | ".join(map(cell, r)) + " |" for r in table)


def chained(df: DataFrame, group: str, order: str, payload: list[str]) -> DataFrame:
    """Adds `digest` of each row's payload and `link`, the digest of its own and its predecessor's digest: a changed,
    missing or moved row breaks its link and the next one."""
    from pyspark.sql import Window

    body = F.sha2(F.to_json(F.struct(group, order, *payload)), 256)
    rows = df.withColumn("digest", body)
    before = F.coalesce(F.lag("digest").over(Window.partitionBy(group).orderBy(order)), F.lit(""))
    return rows.withColumn("link", F.sha2(F.concat("digest", before), 256))


def broken(df: DataFrame, group: str, order: str, payload: list[str]) -> DataFrame:
    """Rows whose digest or link isn't what `chained` gives."""
    again = chained(df.drop("digest", "link"), group, order, payload).select(group, order, F.col("digest").alias("__d"), F.col("link").alias("__l"))
    return df.join(again, [group, order]).filter((F.col("digest") != F.col("__d")) | (F.col("link") != F.col("__l"))).drop("__d", "__l")
