"""Reading input tables, and written cuts for iterative plans."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """The shared folder that the session names; without one a single-machine session uses its warehouse."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return (found or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/headwater-core").rstrip("/")


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again, so that loops keep short plans."""
    path = f"{work_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def file_system(spark: SparkSession, path: str):
    """(the file system, the path in it), for whatever store the path names."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def children(spark: SparkSession, path: str) -> list[str]:
    fs, place = file_system(spark, path)
    return [s.getPath().getName() for s in fs.listStatus(place)] if fs.exists(place) else []


def swap_in(spark: SparkSession, aside: str, path: str) -> None:
    """Puts a written folder in the place of another, which stays readable until the new one is complete."""
    fs, new = file_system(spark, aside)
    _, old = file_system(spark, path)
    _, spare = file_system(spark, f"{path}.{uuid.uuid4().hex}")
    had = fs.exists(old)
    if had and not fs.rename(old, spare):
        raise OSError(f"cannot move {path} aside")
    if not fs.rename(new, old):
        if had:
            fs.rename(spare, old)
        raise OSError(f"cannot move the new table to {path}")
    if had:
        fs.delete(spare, True)


def read_cache(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A cache of JSON lines; an absent one is empty, and so are its broken lines."""
    if not children(spark, path):
        return spark.createDataFrame([], schema)
    names = [f.name for f in spark.createDataFrame([], schema).schema]
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path).where(F.coalesce(*names).isNotNull() if len(names) == 1 else F.col(names[0]).isNotNull())


def export_lines(rows: DataFrame, line: Column, header: str, path: str) -> None:
    """Text files with CRLF; the header, after a byte order mark, is a file that sorts before all others."""
    spark = rows.sparkSession
    rows.select(line.alias("value")).write.option("lineSep", "\r\n").text(path)
    fs, place = file_system(spark, f"{path}/part-00000-0-header.csv")
    out = fs.create(place, True)
    try:
        out.write(bytearray(f"\ufeff{header}\r\n".encode()))
    finally:
        out.close()
