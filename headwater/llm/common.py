"""Shared pieces: the shared work folder, written cuts, tokens and column checks."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Set when the session names no shared folder: with one JVM only, else work stops with an error.
_OWN_FOLDER = "headwater-work"


def work_dir(spark: SparkSession) -> str:
    """The shared folder of the session, which every executor and the driver can read.

    Where the session names none, a single-machine session (tests) gets a folder in its warehouse; a cluster
    session must name one.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("name a folder that all executors share in spark.checkpoint.dir")
    return f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/{_OWN_FOLDER}"


def cut(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it again.

    What follows depends on the written files alone, so a lost executor never makes the plan above
    run again. The files stay until the folder is cleaned by its owner.
    """
    spark = df.sparkSession
    path = f"{work_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def reserved(df: DataFrame, *names: str) -> dict[str, str]:
    """For each wanted helper column a name that ``df`` does not have yet."""
    taken, out = {c.lower() for c in df.columns}, {}
    for name in names:
        own = name
        while own.lower() in taken:
            own = f"_{own}"
        taken.add(own.lower())
        out[name] = own
    return out


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def fold_bucket(doc_id: Column, folds: int) -> Column:
    """crc32 of the id as text, modulo ``folds``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % folds


def as_bytes(column: pa.Array) -> list[bytes | None]:
    """UTF-8 bytes of a string column, without decoding them."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()).to_pylist()


def words_of(text: bytes | None) -> list[bytes]:
    """A-Z lower-cased, cut at space and the controls 9 to 13; null is empty."""
    return text.lower().split() if text else []


def one_text_an_id(rows: DataFrame, keep: str, id_col: str = "_id", text_col: str = "_text") -> DataFrame:
    """(id, ``keep``, text): of the rows of each id the one whose text has the smallest hash, the smaller text on a tie.

    Chosen before the shuffle too, so an id on very many rows is no hot key and counts as one row of a bounded sample.
    ``keep`` is the same on all rows of an id; a null text counts as empty.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    least = rows.groupBy(id_col, keep).agg(F.min(F.struct(F.xxhash64(text).alias("h"), text.alias("t"))).alias("_least"))
    return least.select(id_col, keep, F.col("_least.t").alias(text_col))


def small_batches(batches: Iterator[pa.RecordBatch], most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Splits batches of long texts so that Python never holds many of them at once."""
    for batch in batches:
        pieces = min(batch.num_rows, max(1, -(-batch.nbytes // most_bytes)))
        if pieces <= 1:
            yield batch
            continue
        step = -(-batch.num_rows // pieces)
        for start in range(0, batch.num_rows, step):
            yield batch.slice(start, step)


def broadcast_if_small(df: DataFrame, most_rows: int, entries: Column | None = None, most_entries: int = 0) -> DataFrame:
    """Marks a written table for broadcasting if it has so few rows (and entries in its arrays); else the join
    shuffles both sides."""
    held = df.limit(most_rows + 1).agg(F.count(F.lit(1)), F.max(F.lit(0)) if entries is None else F.sum(entries)).first()
    return F.broadcast(df) if held[0] <= most_rows and (held[1] or 0) <= most_entries else df


def join_hot(rows: DataFrame, unique: DataFrame, key: str, count: str, hot: int = 50_000) -> DataFrame:
    """Joins rows with a written table that has each key once and how many rows have it.

    Keys of over ``hot`` rows are broadcast (rows / ``hot`` of them at most), so no task gets all rows of one key;
    the others are shuffled.
    """
    many, few = unique.where(F.col(count) > hot).drop(count), unique.where(F.col(count) <= hot).drop(count)
    if many.isEmpty():
        return rows.join(few, key)
    held = F.broadcast(many)
    return rows.join(held, key).unionByName(rows.join(held, key, "left_anti").join(few, key))
