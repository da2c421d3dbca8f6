"""S11 over a stream: the last answer of each item from an append-only log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from cohortaudit.sources.tables import latest_answers

#: Folders of a store of answers: one for each batch, and the last rows of all batches up to a number.
BATCH, BASE = "batch-", "base-"


def read_log(spark: SparkSession, folder: str, schema: str, files_a_batch: int = 100) -> DataFrame:
    """An append-only folder of Parquet files as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(folder)


def latest_stream(log: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key so far; a row that comes late still counts if it is the last.

    State is a row for each key and is never freed, as any key may be answered again; it
    is bounded by the keys, not by the log; follow() keeps none. Use with output mode
    update or complete; batch S11 on the same rows gives the same.
    """
    others = [c for c in log.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(at, tie)).alias("_r")
    return log.groupBy(*keys).agg(newest).select(*keys, "_r.*")


def save_batch(batch: DataFrame, number: int, path: str, keys: list[str], at: str, tie: str) -> None:
    """Put a batch of the log into the store: the last row of each of its keys, in a folder of its own.

    The same batch saved again replaces itself, and one that is not written whole does
    not count, so a stream may repeat what it was at when it stopped.
    """
    latest_answers(batch, keys, at, tie).write.mode("overwrite").parquet(f"{path}/{BATCH}{number:012d}")


def _parts(spark: SparkSession, path: str) -> tuple[list[str], int | None, list]:
    """The whole folders that hold the store's rows, the number of the last batch in them, and the folders that are no longer needed."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark._jsc.hadoopConfiguration())
    there = [s.getPath() for s in fs.listStatus(root)] if fs.exists(root) else []
    whole = {p.getName(): p for p in there if p.getName().startswith((BATCH, BASE)) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))}
    number = lambda name: int(name.rpartition("-")[2])
    base = max((number(n) for n in whole if n.startswith(BASE)), default=-1)
    used = [n for n in sorted(whole) if number(n) > base or n == f"{BASE}{base:012d}"]
    return [whole[n].toString() for n in used], max(map(number, used), default=None), [p for n, p in whole.items() if n not in used]


def position(spark: SparkSession, path: str) -> int | None:
    """The number of the last batch that the store holds; None if it holds none."""
    return _parts(spark, path)[1]


def stored(spark: SparkSession, path: str, schema: str, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key over all whole batches; no rows where there is no store."""
    folders, _, _ = _parts(spark, path)
    if not folders:
        return spark.createDataFrame([], schema)
    return latest_answers(spark.read.schema(schema).parquet(*folders), keys, at, tie)


def compact(spark: SparkSession, path: str, schema: str, keys: list[str], at: str, tie: str) -> None:
    """Unite the store's batches in one folder and remove them; a store without batches stays as it is.

    Only the stream's own writer may call this. A stop on the way loses nothing: until the
    new folder is whole the batches count, and from then on only it does.
    """
    last = position(spark, path)
    if last is None:
        return
    if len(_parts(spark, path)[0]) > 1:
        stored(spark, path, schema, keys, at, tie).write.mode("overwrite").parquet(f"{path}/{BASE}{last:012d}")
    for p in _parts(spark, path)[2]:
        p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def follow(log: DataFrame, path: str, schema: str, keys: list[str], at: str, tie: str, checkpoint: str, every: int = 50) -> DataStreamWriter:
    """A stream's writer that keeps the last row of each key in the store, without state in the stream.

    A batch costs its own rows, and every `every` batches are united. Started again with
    the same checkpoint it goes on after the last batch.
    """

    def save(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        # a batch up to the base is in it already
        save_batch(batch, number, path, keys, at, tie)
        if (number + 1) % every == 0:
            compact(spark, path, schema, keys, at, tie)

    return log.writeStream.foreachBatch(save).option("checkpointLocation", checkpoint)


def windowed_counts(log: DataFrame, at: str, kind: str, width: str, delay: str) -> DataFrame:
    """Rows by window and kind, closed once the watermark passes the window's end."""
    return log.withWatermark(at, delay).groupBy(F.window(at, width), kind).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), kind, "n")
