"""Token ids in Parquet files that can be read selectively.

Documents are range-partitioned by id and written in ascending order: one row per document with a list column of
ids (dictionary-encoded, bit-packed), delta-encoded metadata columns, small pages with a page index and row groups of
a set size. A manifest holds the number of ids of every file part, so a document's place in the whole stream is the
base of its part plus its place there. Readers of metadata never touch the ids; readers of some documents touch the
pages that hold them.

Rows: null or empty text gives the end id only. Repeated ids stay separate rows, side by side. Null document ids come
first. An empty table writes an empty set. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortflow.llm.text import chunks, rows_with
from cohortflow.llm.tokens import shared_encoder, ship_spec

ROWS = "part int, doc_id long, local_start long, n_tokens long, tokens array<int>"
END_ID = 2
ROW_GROUP_BYTES = 32 << 20
PAGE_ROWS = 512


def write_tokens(
    docs: DataFrame, tokenizer: str, path: str, key: str = "doc_id", text: str = "text", end_id: int | None = END_ID,
    row_group_bytes: int = ROW_GROUP_BYTES, page_rows: int = PAGE_ROWS, partitions: int | None = None,
) -> str:
    """Write ``path``/data and ``path``/manifest; returns ``path``."""
    spark = docs.sparkSession
    spec = ship_spec(spark, tokenizer)
    end = np.array([] if end_id is None else [end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part, total = shared_encoder(spec.value), TaskContext.get().partitionId(), 0
        for batch in batches:
            for rows, buf, off in chunks(batch):
                ids, at = encoder.encode(buf, off)
                ids = np.insert(ids, np.repeat(at[1:], len(end)), np.tile(end, len(rows))).astype(np.int32)
                at = at + np.arange(len(at)) * len(end)
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids))
                n = len(rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * n, pa.int32()), rows.column(0), pa.array(total + at[:-1], pa.int64()), pa.array(np.diff(at), pa.int64()), lists],
                    names=["part", "doc_id", "local_start", "n_tokens", "tokens"],
                )
                total += int(at[-1])

    rows = rows_with(docs, key, text)
    ranged = rows.repartitionByRange(partitions, "doc_id") if partitions else rows.repartitionByRange("doc_id")
    (
        ranged.sortWithinPartitions("doc_id", "text")
        .mapInArrow(run, ROWS)
        .write.option("compression", "zstd")
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", row_group_bytes)
        .option("parquet.page.row.count.limit", page_rows)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .parquet(f"{path}/data")
    )
    parts = read_metadata(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_docs"))
    base, manifest = 0, []
    for part, n_tokens, n_docs in sorted(parts.collect()):  # a row per file
        manifest.append((part, base, n_tokens, n_docs))
        base += n_tokens
    spark.createDataFrame(manifest, "part int, base long, n_tokens long, n_docs long").coalesce(1).write.parquet(f"{path}/manifest")
    return path


def _data(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ROWS).parquet(f"{path}/data")


def _placed(spark: SparkSession, path: str, rows: DataFrame) -> DataFrame:
    """With ``start``: the ids of all documents before. The manifest has a row per file."""
    manifest = spark.read.schema("part int, base long").parquet(f"{path}/manifest")
    return rows.join(F.broadcast(manifest), "part").withColumn("start", F.col("base") + F.col("local_start")).drop("base", "local_start", "part")


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """Everything but the ids; the scan leaves the list column out."""
    return _data(spark, path).select("part", "doc_id", "local_start", "n_tokens")


def read_tokens(spark: SparkSession, path: str, doc_ids: Sequence[int] | None = None, between: tuple[int, int] | None = None) -> DataFrame:
    """``(doc_id, start, n_tokens, tokens)`` of all, some or a range of documents; filters reach the page index."""
    rows = _data(spark, path)
    if doc_ids is not None:
        rows = rows.where(F.col("doc_id").isin([int(d) for d in doc_ids]))
    if between is not None:
        rows = rows.where(F.col("doc_id").between(*between))
    return _placed(spark, path, rows)


def checksums(spark: SparkSession, path: str) -> DataFrame:
    """``(doc_id, start, n_tokens, ids_crc32)`` of every document, all of it from the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            raw = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False).tobytes()
            crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)]
            count = pa.array(np.diff(at), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), batch.column(2), count, pa.array(crc, pa.int64())],
                names=["part", "doc_id", "local_start", "n_tokens", "ids_crc32"],
            )

    rows = _data(spark, path).select("part", "doc_id", "local_start", "tokens")
    out = rows.mapInArrow(run, "part int, doc_id long, local_start long, n_tokens long, ids_crc32 long")
    return _placed(spark, path, out).select("doc_id", "start", "n_tokens", "ids_crc32")
