"""Token ids in files: a frame for each document under one shared zstandard dictionary.

A store is two Parquet tables in one folder. `blocks` has, in ascending doc_id order,
rows of concatenated frames (blob), the offset index of the documents in them, and the
hash of the dictionary; `dictionary` has the dictionary. A frame holds one document's
ids as little-endian unsigned integers of 2 or 4 bytes and can be read alone.
"""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortaudit.llm.common import map_rows, project, small_batches
from cohortaudit.llm.tokens import encoder, vocabulary

#: The dictionary's sample: documents, and of each as many first ids.
SAMPLE, SAMPLE_IDS = 400, 8192
#: Characters of text in a part, about 256 MB, where that asks for more parts than shuffles have.
PART_CHARS = 256_000_000
DICTIONARY_BYTES = 64 << 10
BLOCK_BYTES = 4 << 20
LEVEL = 3


def serialize(ids: np.ndarray) -> bytes:
    """A byte for the width, then the ids."""
    width = 2 if not len(ids) or int(ids.max()) < 1 << 16 else 4
    return bytes([width]) + ids.astype(f"<u{width}").tobytes()


def deserialize(data: bytes) -> np.ndarray:
    return np.frombuffer(data, f"<u{data[0]}", offset=1).astype("<u4")


def train(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A dictionary, or none (empty) where the samples are too few to train on."""
    samples = [s for s in samples if len(s) > 8]
    if len(samples) < 16:
        return b""
    try:
        return zstandard.train_dictionary(min(size, max(1024, sum(map(len, samples)) // 8)), samples, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b""


def _codec(dictionary: bytes) -> dict:
    return {"dict_data": zstandard.ZstdCompressionDict(dictionary)} if dictionary else {}


def train_dictionary(docs: DataFrame, path: str, end_id: int, sample: int = SAMPLE) -> bytes:
    """Train on the first SAMPLE_IDS ids of the documents of the smallest id hashes, `sample` of them at most."""
    chosen = [r.doc_id for r in docs.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample).collect()]

    def rows(batches):
        encode = encoder(path).encode
        for _, texts in batches:
            yield [[serialize(np.append(encode(t), np.uint32(end_id))[:SAMPLE_IDS]) for t in texts]]

    few = map_rows(docs.where(F.col("doc_id").isin(chosen)), rows, "data binary") if chosen else None
    return train(sorted(bytes(r.data) for r in few.limit(2 * sample).collect()) if few else [])


def _bounds(docs: DataFrame, parts: int) -> list[int]:
    """doc_ids that cut the documents into parts of about equal numbers; one that many rows share repeats."""
    if parts < 2:
        return []
    found = docs.agg(F.percentile_approx("doc_id", F.array(*(F.lit(i / parts) for i in range(1, parts))), F.lit(max(10_000, 10 * parts)))).first()[0]
    return sorted(found or [])


def _parts(ids: np.ndarray, ties: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The part of each row: ascending by id, and by tie (0 to 2**32 - 1) among the parts of a bound that repeats."""
    first, last = np.searchsorted(bounds, ids, "left"), np.searchsorted(bounds, ids, "right")
    return np.where(last > first, first + 1 + (ties * np.maximum(last - first, 1) >> 32), last)


def write_store(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, end_id: int = 1, parts: int | None = None, sample: int = SAMPLE) -> None:
    """Encode every whole text, append end_id, and write a store to folder.

    Null and empty texts are the end id alone. Rows with a null doc_id come first.
    Repeated ids stay, in an order that hashes of the rows' places in docs give, so that
    they may fill several parts. Other columns are not read.
    """
    path = tokenizer or vocabulary()
    docs = project(docs, id_col, text_col)
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path, end_id, sample)
    digest = hashlib.sha256(dictionary).hexdigest()
    spark.createDataFrame([(digest, bytearray(dictionary))], "dictionary_sha256 string, dictionary binary").coalesce(1).write.parquet(f"{folder}/dictionary")
    shared = spark.sparkContext.broadcast(dictionary)
    n = parts
    if n is None:
        chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-chars // PART_CHARS))
    bounds = _bounds(docs.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc_id")), n)
    cuts = np.array(bounds, np.int64)

    def encode_rows(batches):
        encode, pack = encoder(path).encode, zstandard.ZstdCompressor(level=LEVEL, **_codec(shared.value)).compress
        for ids, ties, texts in batches:
            tokens = [np.append(encode(t), np.uint32(end_id)) for t in texts]
            part = _parts(np.array([-(1 << 63) if d is None else d for d in ids], np.int64), np.array(ties, np.int64), cuts)
            yield [part.tolist(), ids, ties, [len(t) for t in tokens], [pack(serialize(t)) for t in tokens]]

    tie = F.xxhash64(F.monotonically_increasing_id()).bitwiseAND(F.lit((1 << 32) - 1))
    frames = map_rows(docs.select("doc_id", tie.alias("tie"), "text"), encode_rows, "part int, doc_id long, tie long, n_tokens long, frame binary")
    ranged = frames.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", F.col("doc_id").asc_nulls_first(), "tie")
    ranged = ranged.select("part", "doc_id", "n_tokens", "frame")

    def block_rows(batches):
        held = ([], [], [])
        size = number = first = 0
        part = None

        def block():
            ends = np.cumsum([len(f) for f in held[2]])
            starts = first + np.cumsum(held[1]) - held[1]
            return [[part], [number], [digest], [held[0]], [[0, *ends.tolist()]], [starts.tolist()], [held[1]], [b"".join(held[2])]]

        for columns in batches:
            for p, d, n_tokens, frame in zip(*columns):
                if held[0] and (p != part or size + len(frame) > BLOCK_BYTES):
                    yield block()
                    number, first = (0, 0) if p != part else (number + 1, first + sum(held[1]))
                    held, size = ([], [], []), 0
                part = p
                held[0].append(d), held[1].append(n_tokens), held[2].append(frame)
                size += len(frame)
        if held[0]:
            yield block()

    blocks = map_rows(ranged, block_rows, "part int, block int, dictionary_sha256 string, doc_ids array<long>, offsets array<long>, starts array<long>, n_tokens array<long>, blob binary")
    with small_batches(spark):
        blocks.write.option("compression", "uncompressed").parquet(f"{folder}/blocks")


def _dictionary(spark: SparkSession, folder: str) -> tuple[str, bytes]:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    data = bytes(row.dictionary)
    if hashlib.sha256(data).hexdigest() != row.dictionary_sha256:
        raise ValueError("the dictionary does not match its hash")
    return row.dictionary_sha256, data


def offset_index(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, part, block, position, start, n_tokens), start over the whole store.

    Only one total a part is summed across the store, and a part is a written partition.
    """
    blocks = spark.read.parquet(f"{folder}/blocks").select("part", "block", "doc_ids", "starts", "n_tokens")
    flat = blocks.select("part", "block", F.posexplode(F.arrays_zip("doc_ids", "starts", "n_tokens")).alias("position", "x"))
    return flat.join(F.broadcast(_part_starts(spark, blocks)), "part").select(F.col("x.doc_ids").alias("doc_id"), "part", "block", "position", (F.col("x.starts") + F.col("before")).alias("start"), F.col("x.n_tokens").alias("n_tokens"))


def _part_starts(spark: SparkSession, blocks: DataFrame) -> DataFrame:
    """(part, before): ids in the parts before. A row for each written partition, which bounds it."""
    totals = blocks.groupBy("part").agg(F.sum(F.aggregate("n_tokens", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).orderBy("part").collect()
    before, rows = 0, []
    for r in totals:
        rows.append((r.part, before))
        before += r.n
    return spark.createDataFrame(rows, "part int, before long")


def read_store(spark: SparkSession, folder: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id long, start long, n_tokens long, ids_crc32 long, ids array<long>) of all or the named documents.

    For named documents only their blocks are read, and of a block only their frames
    are decompressed. Select away `ids` where they aren't wanted: see digests().
    """
    return _read(spark, folder, doc_ids, True)


def digests(spark: SparkSession, folder: str) -> DataFrame:
    """read_store without the ids: they are read back and checked in the tasks."""
    return _read(spark, folder, None, False)


def _read(spark: SparkSession, folder: str, doc_ids: list[int] | None, with_ids: bool) -> DataFrame:
    digest, dictionary = _dictionary(spark, folder)
    shared = spark.sparkContext.broadcast(dictionary)
    blocks = spark.read.parquet(f"{folder}/blocks")
    starts = _part_starts(spark, blocks.select("part", "n_tokens"))
    wanted = set(doc_ids) if doc_ids is not None else None
    if wanted is not None:
        blocks = blocks.where(F.arrays_overlap("doc_ids", F.array(*(F.lit(d).cast("long") for d in sorted(wanted)))) if wanted else F.lit(False))
    joined = blocks.join(F.broadcast(starts), "part").select("before", "dictionary_sha256", "doc_ids", "offsets", "starts", "blob")

    def rows(batches):
        unpack = zstandard.ZstdDecompressor(**_codec(shared.value)).decompress
        for columns in batches:
            for before, sha, ids, offsets, first, blob in zip(*columns):
                if sha != digest:
                    raise ValueError("a block was written with another dictionary")
                take = [i for i, d in enumerate(ids) if wanted is None or d in wanted]
                tokens = [deserialize(unpack(blob[offsets[i] : offsets[i + 1]])) for i in take]
                out = [[ids[i] for i in take], [before + first[i] for i in take], [len(t) for t in tokens], [zlib.crc32(t.tobytes()) for t in tokens]]
                if with_ids:
                    ends = np.concatenate(([0], np.cumsum([len(t) for t in tokens]))).astype(np.int32)
                    out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(tokens).astype(np.int64) if tokens else np.zeros(0, np.int64))))
                yield out

    return map_rows(joined, rows, "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids)
