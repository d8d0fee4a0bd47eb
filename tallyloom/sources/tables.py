"""Table sources and sinks: CSV, Parquet, JSON, keyed stores."""

from __future__ import annotations

import json
import logging
from collections.abc import Sequence
from pathlib import Path
from typing import Any

from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.sources.stores import KeyedStore as KeyedStore
from tallyloom.storage import Workspace, _path

log = logging.getLogger(__name__)
RAW = ["rating", "date", "review", "platform"]


def numbered_csv(spark: SparkSession, path: str, required: Sequence[str], out: str = "source_row_index") -> DataFrame:
    """A CSV, all strings, quoted fields over several lines, nothing read as missing; rows are numbered 0, 1, 2, ... through all files, in the order
    of their names. Raises ValueError if a column misses.

    Spark numbers the rows of a split as they stream by; a split's first number is the sum of the rows of those before, by file and offset: a row for
    each split is all that is put in order. A file may have a column of any name but `out`.
    """
    head = spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"', inferSchema=False)
    missing = [c for c in required if c not in head.columns]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_at")]
    rows = Workspace(spark, "csv").cut(head.select("*", *place))
    splits = rows.groupBy("_file", "_start").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.partitionBy(F.lit(0)).orderBy("_file", "_start")) - F.col("_n")
    splits = splits.select("_file", "_start", "_first", before.alias("_before"))
    numbered = rows.na.fill("").join(splits, ["_file", "_start"]).withColumn(out, (F.col("_before") + F.col("_at") - F.col("_first")).cast("long"))
    return numbered.drop("_file", "_start", "_at", "_first", "_before")


def read_raw(spark: SparkSession, path: str, required: Sequence[str] = RAW) -> DataFrame:
    """The raw CSV with source_row_index, consecutive from 0 (see numbered_csv)."""
    return numbered_csv(spark, path, required)


def checksum(spark: SparkSession, path: str, block: int = 1 << 20) -> str:
    """SHA-256 of a file of any size in any store that Spark can open, streamed in blocks by the JVM."""
    jvm = spark.sparkContext._jvm
    fs, at = _path(spark, path)
    if not fs.exists(at) or fs.getFileStatus(at).isDirectory():
        raise FileNotFoundError(path)
    digest = jvm.java.security.MessageDigest.getInstance("SHA-256")
    sink = jvm.java.security.DigestOutputStream(jvm.java.io.OutputStream.nullOutputStream(), digest)
    jvm.org.apache.hadoop.io.IOUtils.copyBytes(fs.open(at), sink, block, True)
    return bytes(digest.digest()).hex()


def verify(spark: SparkSession, path: str, expected: str | None) -> str:
    """Missing raises, another checksum only warns; returns the checksum."""
    found = checksum(spark, path)
    if expected and found != expected:
        log.warning("checksum of %s is %s, not %s", path, found, expected)
    return found


def read_table(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """S06, and S10 with a schema: a missing or broken table is then an empty frame."""
    try:
        df = spark.read.parquet(path)
        if schema is not None:
            df.limit(1).collect()
        return df
    except PySparkException:
        if schema is None:
            raise
        log.warning("no readable table at %s", path)
        return spark.createDataFrame([], schema)


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """S07."""
    df.write.mode("overwrite").option("compression", "snappy").partitionBy(*partition_by).parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """For small results (templates, matrices): one file."""
    df.coalesce(1).write.mode("overwrite").csv(path, header=True, quote='"', escape='"')


def write_json(data: Any, path: str | Path) -> None:
    """S09, written beside and moved into place."""
    p = Path(path)
    p.parent.mkdir(parents=True, exist_ok=True)
    half = p.with_suffix(p.suffix + ".part")
    half.write_text(json.dumps(data, indent=2, default=str), encoding="utf-8")
    half.replace(p)


def read_json(path: str | Path) -> dict:
    """{} if missing or broken."""
    try:
        return json.loads(Path(path).read_text(encoding="utf-8"))
    except (OSError, ValueError):
        return {}


def pipeline_state(artefacts: list[tuple[str, str, str]]) -> dict[str, Any]:
    """(name, path, command) of each artefact -> which are there, and the commands for the others, each once."""
    there = {name: Path(path).exists() for name, path, _ in artefacts}
    return {"available": there, "commands": list(dict.fromkeys(cmd for name, _, cmd in artefacts if not there[name]))}


def read_effort(spark: SparkSession, path: str) -> DataFrame:
    """(product_area, issue_type, effort); blank, non-numeric and non-positive efforts are left out."""
    df = spark.read.csv(path, header=True, inferSchema=False)
    missing = [c for c in ("product_area", "issue_type", "effort_person_weeks") if c not in df.columns]
    if missing:
        raise ValueError(f"columns missing from {path}: {missing}")
    return usable_effort(df)


def usable_effort(df: DataFrame) -> DataFrame:
    e = F.trim(F.col("effort_person_weeks").cast("string")).try_cast("double")
    return df.select("product_area", "issue_type", e.alias("effort_person_weeks")).where("effort_person_weeks > 0")
