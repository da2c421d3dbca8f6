"""Helpers that several operators share: scratch tables, Arrow mapping, word bytes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that become Python values at once. Spark bounds batches by bytes too.
BATCH_ROWS = 500


def _separators(keep_case: bool = False) -> bytes:
    table = bytearray(range(256))
    for b in range(128):
        if 0x41 <= b <= 0x5A:
            table[b] = b if keep_case else b + 32
        elif not (0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A):
            table[b] = 0x20
    return bytes(table)


#: ASCII letters to lower case, every other ASCII byte but digits to a blank.
WORD_TABLE = _separators()
#: Only A-Z to lower case.
LOWER_TABLE = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words_of(text: str | None) -> list[bytes]:
    """Words of ASCII letters and digits and of all other code points, A-Z lower-cased."""
    return (text or "").encode().translate(WORD_TABLE).split()


def scratch_root(spark: SparkSession) -> str:
    """The folder that the driver and the executors share (spark.checkpoint.dir).

    It is read from the session. Only a local session may be given one here; on a
    cluster without the setting this raises, as no other folder is known to be shared.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if root:
        return root
    if not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return spark.sparkContext.getCheckpointDir()


def stage(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """Write df as Parquet in the shared folder; return it as read back, and its path.

    Cuts the lineage: what follows survives the loss of any executor, and df is
    computed once however often the result is read.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    if (made := _MADE.get()) is not None:
        made.append(path)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """Let Spark hand out Arrow batches of BATCH_ROWS rows to what is run inside; the session's setting comes back after it."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    spark.conf.set(key, BATCH_ROWS)
    try:
        yield
    finally:
        spark.conf.set(key, before)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[None]:
    """Remove, at the end, the scratch tables that operators write inside the block.

    What an operator returns may still read them, so its result is to be written inside
    the block too, to a place of one's own.
    """
    made: list[str] = []
    token = _MADE.set(made)
    try:
        yield
    finally:
        _MADE.reset(token)
        for path in made:
            discard(spark, path)


#: The scratch tables of the innermost temporary() block.
_MADE: ContextVar[list[str] | None] = ContextVar("made", default=None)
#: Rows of a keyed side that may be sent to every task: some tens of MB.
SMALL_SIDE = 500_000


def small_side(df: DataFrame, name: str, limit: int = SMALL_SIDE) -> DataFrame:
    """df as a written table, marked for broadcast if it proves to have at most `limit` rows.

    A larger one is joined by a shuffle; the result is the same.
    """
    df, _ = stage(df, name)
    return F.broadcast(df) if df.count() <= limit else df


def discard(spark: SparkSession, path: str) -> None:
    """Remove a scratch table that nothing reads any more."""
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def arrow_schema(ddl: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(T.StructType.fromDDL(ddl))


def map_rows(df: DataFrame, rows: Callable[..., Iterator[list]], ddl: str) -> DataFrame:
    """mapInArrow with plain columns.

    rows gets an iterator of batches, each a list of columns as Python lists, and
    yields batches in the same form for the schema ddl.
    """
    schema = arrow_schema(ddl)

    def run(batches):
        for columns in rows(_lists(batches, BATCH_ROWS)):
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([_array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return df.mapInArrow(run, ddl)


def _lists(batches, rows: int) -> Iterator[list]:
    """The batches in parts of at most `rows` rows, as Python lists; a batch is let go before the next one is read."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield [c.slice(at, rows).to_pylist() for c in b.columns]
        del b


def sliced(batches, rows: int) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most `rows` rows, none empty."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _array(column, kind: pa.DataType) -> pa.Array:
    return column if isinstance(column, pa.Array) else pa.array(column, type=kind)


def buffered(batches, limit: int, weight: Callable[[list], int]) -> Iterator[list]:
    """Join batches until their weight reaches limit; the rest comes last."""
    held, total = None, 0
    for columns in batches:
        held = columns if held is None else [a + b for a, b in zip(held, columns)]
        total += weight(columns)
        if total >= limit:
            yield held
            held, total = None, 0
    if held is not None:
        yield held


def text_size(columns: list) -> int:
    """Bytes of the texts in the last column."""
    return sum(len(t.encode()) for t in columns[-1] if t) + len(columns[-1])


def keep_rows(docs: DataFrame, text_col: str, keep: Callable[[list], list], limit: int = 0) -> DataFrame:
    """docs' rows for whose texts keep says True, with all their columns; rows stay where they lie.

    keep gets the texts of at most BATCH_ROWS rows, or of as many as have `limit` bytes together.
    """
    at = docs.columns.index(text_col)

    def run(batches):
        parts = ([[b], b.column(at).to_pylist()] for b in sliced(batches, BATCH_ROWS))
        for held, texts in buffered(parts, limit, text_size):
            mask = pa.array(keep(texts), pa.bool_())
            del texts
            first = 0
            for b in held:
                yield b.filter(mask.slice(first, b.num_rows))
                first += b.num_rows

    return docs.mapInArrow(run, docs.schema)


def hash_bound(share: float) -> int:
    """The signed 64-bit number that a share of all hashes is at most; the share may be as small as 1e-18."""
    return min((1 << 63) - 1, int(min(1.0, share) * (1 << 64)) - (1 << 63))


def run_starts(keys: np.ndarray) -> np.ndarray:
    """Where each run of equal keys begins."""
    return np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)


def project(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the two columns that an operator reads, under fixed names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
