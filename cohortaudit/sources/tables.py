"""Reading and writing tables, labels, report files, prediction stores and file inventories."""

from __future__ import annotations

import hashlib
import re
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortaudit.functions import text as X
from cohortaudit.sources.scratch import kept


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """Parquet, CSV or TSV (also .gz) by suffix; any other suffix raises."""
    low = path.lower().removesuffix(".gz")
    if low.endswith(".parquet"):
        return spark.read.parquet(path)
    if low.endswith((".csv", ".tsv")):
        return spark.read.csv(path, header=True, sep="," if low.endswith(".csv") else "\t", inferSchema=True)
    raise ValueError(f"no reader for {path}")


def read_strings(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """The named columns of a CSV file as strings; only an empty field is null."""
    schema = T.StructType([T.StructField(c, T.StringType()) for c in columns])
    return spark.read.schema(schema).csv(path, header=True, nullValue="", emptyValue="", enforceSchema=False)


def read_labels(spark: SparkSession, path: str, key: str, labels: list[str]) -> DataFrame:
    """S3: JSON Lines with a key and four-state labels. Blank lines are skipped; a broken line or a missing key raises when read."""
    schema = T.StructType([T.StructField(key, T.StringType()), *(T.StructField(c, T.DoubleType()) for c in labels)])
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    checked = F.when(F.col(key).isNull(), F.raise_error(F.lit(f"a label row has no {key}")).cast("string")).otherwise(F.col(key))
    return rows.withColumn(key, checked)


def read_reports(spark: SparkSession, folder: str) -> DataFrame:
    """(study_id, name, text) of the files s<digits>.txt below folder; of files with one id the first by name.

    Tasks list the folders, level by level, and read the files, so the driver holds no
    list of them; only chosen files are opened, and texts are not shuffled. A store that
    pyarrow doesn't know is listed and read by Spark.
    """
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    id_of = X.study_id("name")
    try:
        _system(root)
    except pa.ArrowInvalid:
        rows = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.txt").text(folder, wholetext=True)
        named = rows.select(F.input_file_name().alias("name"), F.col("value").alias("text")).withColumn("study_id", id_of).where("study_id is not null")
        return named.withColumn("_n", F.row_number().over(Window.partitionBy("study_id").orderBy("name"))).where("_n = 1").select("study_id", "name", "text")
    parts = 4 * spark.sparkContext.defaultParallelism
    names = _names(spark, root, parts).withColumn("study_id", id_of).where("study_id is not null")
    chosen = names.repartition(parts, "study_id").groupBy("study_id").agg(F.min_by(F.struct("name", "path"), "name").alias("f")).select("study_id", "f.name", "f.path")
    return chosen.mapInArrow(_contents, "study_id long, name string, text binary").withColumn("text", F.col("text").cast("string"))


#: Bytes of texts that a reader of reports gathers in a batch.
GATHERED = 16 << 20


def _contents(batches):
    """(study_id, name, bytes) of the files of (study_id, name, path)."""
    schema = pa.schema([("study_id", pa.int64()), ("name", pa.string()), ("text", pa.binary())])
    for batch in batches:
        held, size = ([], [], []), 0
        for study, name, path in zip(*(c.to_pylist() for c in batch.columns)):
            with _input(path) as stream:
                text = stream.read()
            for column, x in zip(held, (study, name, text)):
                column.append(x)
            size += len(text)
            if size >= GATHERED:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema)], schema=schema)
                held, size = ([], [], []), 0
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(held, schema)], schema=schema)


def _names(spark: SparkSession, root: str, parts: int) -> DataFrame:
    """(name, path) of the .txt files below root, name as Spark's input_file_name gives it; hidden files and folders are passed over, as Spark does."""

    def listed(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                system, at, prefix = _system(path)
                found = [(f.path, f.type == fs.FileType.Directory) for f in system.get_file_info(fs.FileSelector(at)) if not _hidden(f.base_name)]
                for k in range(0, len(found), 10_000):
                    some = [(prefix + p, d) for p, d in found[k : k + 10_000] if d or p.endswith(".txt")]
                    yield pa.RecordBatch.from_pydict({"name": [_encoded(p) for p, _ in some], "path": [p for p, _ in some], "folder": [d for _, d in some]}, schema=schema)

    schema = pa.schema([("name", pa.string()), ("path", pa.string()), ("folder", pa.bool_())])
    level, files = spark.createDataFrame([(root,)], "path string"), []
    while not files or not level.isEmpty():
        found, _ = kept(level.repartition(parts, "path").mapInArrow(listed, "name string, path string, folder boolean"), "listed")
        files.append(found.where("not folder").select("name", "path"))
        level = found.where("folder").select("path")
    return reduce(DataFrame.unionByName, files)


def _hidden(name: str) -> bool:
    """Whether Spark's listing passes a file or folder over."""
    return (name.startswith("_") and "=" not in name) or name.startswith(".") or name.endswith("._COPYING_")


def _encoded(path: str) -> str:
    """A path as a URI: what java.net.URI quotes is quoted."""
    return re.sub(r'[\x00-\x20"#%<>?\[\\\]^`{|}\x7f]', lambda m: f"%{ord(m[0]):02X}", path)


def write_reports(rows: DataFrame, folder: str, key: str, text: str) -> int:
    """S4 the other way: a file s<key>.txt for each row with a key and a text, in folders of keys; returns how many.

    folder is an address that every executor can write to. A file that is written again
    by a task that is run anew has the same content.
    """

    def write(batches):
        from pyarrow import fs

        store, root = fs.FileSystem.from_uri(folder)
        made = set()
        for batch in batches:
            keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for part in sorted({k % 100 for k in keys} - made):
                store.create_dir(f"{root}/p{part}", recursive=True)
                made.add(part)
            for k, t in zip(keys, texts):
                with store.open_output_stream(f"{root}/p{k % 100}/s{k}.txt") as f:
                    f.write(t.encode())
            yield pa.RecordBatch.from_pydict({"n": [len(keys)]}, schema=pa.schema([("n", pa.int64())]))

    named = rows.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).where("key is not null and text is not null")
    return named.mapInArrow(write, "n long").agg(F.sum("n")).first()[0] or 0


def read_columns(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """Only some columns, which the scan of a Parquet file then reads alone."""
    return read_table(spark, path).select(*columns)


def write_aggregate(df: DataFrame, path: str, allowed: list[str], form: str = "csv") -> None:
    """Write an aggregate table; raises if it holds a column that is not on the list of shareable ones."""
    extra = sorted(set(df.columns) - set(allowed))
    if extra:
        raise ValueError(f"columns not cleared for sharing: {extra}")
    writer = df.write.mode("overwrite")
    {"csv": lambda: writer.csv(path, header=True), "json": lambda: writer.json(path), "parquet": lambda: writer.parquet(path)}[form]()


#: What a stored prediction pass is known by.
PASS_KEYS = ("site", "model", "condition", "label_source", "threshold", "seed")


def save_predictions(df: DataFrame, path: str, digest: str) -> None:
    """Put passes into the store, partitioned by their keys, with the digest of the model's weights.

    A pass replaces what the store holds under its keys, whatever its digest; other
    passes stay. Rows are written aside and moved when all are there, so a save that
    fails leaves the store as it was.
    """
    df.withColumn("digest", F.lit(digest)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*PASS_KEYS).parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def load_predictions(spark: SparkSession, path: str, digest: str, schema: str = "study long, target string, p double", **keys) -> DataFrame:
    """The rows of a pass; none where the keys or the digest differ, or where there is no store (then with the columns of schema).

    Partitions are pruned by the keys.
    """
    unknown = set(keys) - set(PASS_KEYS)
    if unknown:
        raise ValueError(f"no such keys: {sorted(unknown)}")
    if not _exists(spark, path):
        return spark.createDataFrame([], f"{schema}, digest string, " + ", ".join(f"{k} string" for k in PASS_KEYS))
    rows = spark.read.parquet(path).where(F.col("digest") == digest)
    return reduce(lambda df, k: df.where(F.col(k) == keys[k]), keys, rows)


def classify(name: Column, patterns: list[tuple[str, str]], default: str = "other") -> Column:
    """The category of the first pattern that a lower-cased file name matches."""
    out = F.lit(default)
    for category, pattern in reversed(patterns):
        out = F.when(F.lower(name).rlike(pattern), category).otherwise(out)
    return out


#: Files of more bytes are digested in chunks; smaller ones are one value of a row.
WHOLE, CHUNK = 64 << 20, 1 << 20


def _system(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path as Spark writes it, the path there, and what stands before such paths."""
    scheme, _, rest = path.partition(":")
    if scheme == "file":
        return fs.LocalFileSystem(), "/" + rest.lstrip("/"), "file://"
    system, name = fs.FileSystem.from_uri(path.replace("s3a:", "s3:", 1) if scheme == "s3a" else path)
    return system, name, path.removesuffix("/").removesuffix(name.removesuffix("/"))


def _input(path: str):
    """An open stream of a path as Spark writes it."""
    system, name, _ = _system(path)
    return system.open_input_stream(name)


def chunked_digests(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """files, with the sha256 of what the column `path` names, read `chunk` bytes at a time whatever its size."""

    def digests(batches):
        for batch in batches:
            found = []
            for path in batch.column("path").to_pylist():
                digest = hashlib.sha256()
                with _input(path) as stream:
                    while part := stream.read(chunk):
                        digest.update(part)
                found.append(digest.hexdigest())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.string())], [*batch.schema.names, "sha256"])

    return files.mapInArrow(digests, T.StructType([*files.schema.fields, T.StructField("sha256", T.StringType())]))


def inventory(spark: SparkSession, folder: str, patterns: list[tuple[str, str]], counted: list[str], whole: int = WHOLE) -> DataFrame:
    """(path, name, category, size, modified, sha256) of the files below folder.

    Files of the `counted` categories are never opened: their digest is null. Files of
    more than `whole` bytes are read in chunks, so neither memory nor a row's 2 GB bound them.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    category = classify(F.regexp_extract("path", "([^/]+)$", 1), patterns)
    shape = ("path", F.regexp_extract("path", "([^/]+)$", 1).alias("name"), category.alias("category"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    # three scans: only the first reads contents
    opened = files.where(~category.isin(counted) & (F.col("length") <= whole)).select(*shape, F.sha2("content", 256).alias("sha256"))
    large = files.drop("content").where(~category.isin(counted) & (F.col("length") > whole)).select(*shape)
    closed = files.drop("content").where(category.isin(counted)).select(*shape, F.lit(None).cast("string").alias("sha256"))
    return opened.unionByName(chunked_digests(large)).unionByName(closed)


def inventory_summary(files: DataFrame) -> DataFrame:
    """Files, bytes and extensions by category."""
    return files.groupBy("category").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"), F.count_distinct(F.regexp_extract("name", r"\.([^.]+)$", 1)).alias("extensions"))


def parse_manifest(lines: DataFrame, column: str = "value") -> DataFrame:
    """(sha256, name) of lines `<64 hex digits>  <name>`; others are left out."""
    shape = r"^([0-9a-fA-F]{64})\s+\*?(.+?)\s*$"
    return lines.where(F.col(column).rlike(shape)).select(F.lower(F.regexp_extract(column, shape, 1)).alias("sha256"), F.regexp_extract(column, shape, 2).alias("name"))


def verify_checksums(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """(name, status) with status verified, mismatch, unreadable (no digest), missing (no file) or unlisted."""
    m, f = manifest.select("name", F.col("sha256").alias("want")), files.select("name", F.col("sha256").alias("got"), F.lit(True).alias("there"))
    both = m.join(f, "name", "full_outer")
    status = F.when(F.col("there").isNull(), "missing").when(F.col("want").isNull(), "unlisted").when(F.col("got").isNull(), "unreadable").when(F.col("want") == F.col("got"), "verified").otherwise("mismatch")
    return both.select("name", status.alias("status"))


def access_gate(files: DataFrame, required: list[str]) -> DataFrame:
    """One row: PASS with all required categories, BLOCKED with none, else FAIL; and what is missing."""
    spark = files.sparkSession
    need = spark.createDataFrame([(c,) for c in required], "category string")
    missing = need.join(files.select("category").distinct(), "category", "left_anti")
    one = missing.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("category")), ",").alias("missing"))
    return one.select(F.when(F.col("n") == 0, "PASS").when(F.col("n") == len(required), "BLOCKED").otherwise("FAIL").alias("status"), "missing")


def latest_answers(log: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key; ties of time go to the larger tie."""
    others = [c for c in log.columns if c not in keys]
    return log.groupBy(*keys).agg(F.max_by(F.struct(*others), F.struct(at, tie)).alias("_r")).select(*keys, "_r.*")


def next_position(order: DataFrame, done: DataFrame, reader: str, item: str, position: str) -> DataFrame:
    """Each reader's first position without an answer; null once all are read."""
    left = order.join(done.select(reader, item).distinct(), [reader, item], "left_anti").groupBy(reader).agg(F.min(position).alias("next"))
    return order.select(reader).distinct().join(left, reader, "left")
