"""Writers of result tables as CSV, JSON lines and Markdown, and of seed files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame) -> DataFrame:
    """Arrays, maps and structs as JSON, so that a text format can hold them."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    return df.select(*[F.to_json(F.col(f"`{f.name}`")).alias(f.name) if isinstance(f.dataType, nested) else F.col(f"`{f.name}`") for f in df.schema])


def write_csv(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    flat(df).write.mode(mode).csv(folder, header=True)


def write_json(df: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).json(folder, ignoreNullFields=False)


def write_seeds(seeds: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """(address, first_seen_block, seed_type) in (block, address) order, with a header."""
    kind = F.col("seed_type") if "seed_type" in seeds.columns else F.lit(None).cast("string")
    seeds.select("address", "first_seen_block", kind.alias("seed_type")).orderBy("first_seen_block", "address").write.mode(mode).csv(folder, header=True)


def markdown_table(df: DataFrame, limit: int = 40) -> str:
    """The first rows as a Markdown table; the frame's own order is the order."""
    cell = lambda v: "" if v is None else str(v).replace("|", "\\|").replace("\n", " ")
    rows = [[cell(v) for v in r] for r in df.limit(limit).collect()]
    return "\n".join(["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns), *["| " + " | ".join(r) + " |" for r in rows]])
