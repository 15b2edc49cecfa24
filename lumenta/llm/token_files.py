"""Token counts from flat token files that have no index.

A file is a stream of ids, cut into blocks without regard to documents; only the
end-of-document id tells where a document ends. Each block is searched on its own in
one vectorised comparison; a prefix scan over the blocks' summaries (tokens held, end
of the last separator) then gives every document its true start, also where it began
blocks before.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lumenta.llm import tokens
from lumenta.llm.common import stored
from lumenta.sources import ranges

#: Bytes of a block; even, so that no id is cut.
BLOCK = 1 << 20


def flatten(docs: DataFrame, separator: int = 50256, vocabulary: str | None = None, block: int = BLOCK) -> DataFrame:
    """(file, block, data, doc_ids): each task's documents as one flat stream of little-endian uint16 ids.

    doc_ids lists the documents that end in a block: a sidecar that the scan never reads.
    Null texts count as empty: a separator alone.
    """
    path = vocabulary or tokens.vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, file = tokens.encoder(path), TaskContext.get().partitionId()
        held, ends, size, number, emitted = [], [], 0, 0, 0

        def blocks(least: int) -> Iterator[pa.RecordBatch]:
            nonlocal held, ends, size, number, emitted
            data = b"".join(held)
            at = 0
            while len(data) - at >= least and at < len(data):
                part = data[at : at + block]
                emitted += len(part)
                own = [d for e, d in ends if e <= emitted]
                ends = ends[len(own) :]
                yield pa.RecordBatch.from_arrays([pa.array([file], pa.int64()), pa.array([number], pa.int64()), pa.array([part], pa.binary()), pa.array([own], pa.list_(pa.int64()))], names=["file", "block", "data", "doc_ids"])
                number, at = number + 1, at + len(part)
            held, size = [data[at:]], len(data) - at

        total = 0
        for batch in batches:
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = np.append(encode(text.as_py()), np.uint32(separator))
                if ids.max() > 0xFFFF:
                    raise ValueError("these files hold ids under 65536")
                held.append(ids.astype("<u2").tobytes())
                size, total = size + len(held[-1]), total + len(held[-1])
                ends.append((total, doc.as_py()))
                if size >= block:
                    yield from blocks(block)
        yield from blocks(1)

    return docs.select("doc_id", "text").mapInArrow(run, "file long, block long, data binary, doc_ids array<long>")


def read_files(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """(file, block, data) of the flat binary files at path, a file or a folder, one row for each block.

    The driver lists files and sizes; blocks are read as ranges of bytes, each by itself,
    so files may be of any size. path is one that Arrow opens on driver and executors
    alike. An empty file has no blocks.
    """
    listed = spark.createDataFrame(ranges.sizes(path), "file string, size long").where("size > 0")
    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long")))
    wanted = listed.select("file", "size", start.alias("start")).repartition(spark.sparkContext.defaultParallelism, "file", "start")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, size, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = ranges.read(file, at, min(block, size - at))
                yield pa.RecordBatch.from_arrays([pa.array([file]), pa.array([at // block], pa.int64()), pa.array([data], pa.binary())], names=["file", "block", "data"])

    return wanted.mapInArrow(run, "file string, block long, data binary")


def scan(blocks: DataFrame, separator: int = 50256, dtype: str = "<u2") -> DataFrame:
    """(file, nth, start, n_tokens, ended, block, nth_in_block) of every document in (file, block, data).

    start counts tokens from the file's beginning, n_tokens leaves the separator out. Two
    separators in a row are an empty document. Tokens after a file's last separator are a
    document that hasn't ended. Null or empty blocks hold nothing; no blocks, no rows.
    What the prefix scan of a file sees is four numbers a block; the places found are
    written, and joined to it afterwards.
    """

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.frombuffer(x.as_buffer() if x.is_valid else b"", dtype) for x in batch.column(2)]
            at = [np.flatnonzero(x == separator) + 1 for x in found]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([len(x) for x in found], pa.int64()), pa.array(at, pa.list_(pa.int64()))], names=["file", "block", "held", "ends"])

    kind = f"file {blocks.schema['file'].dataType.simpleString()}, block long, held long, ends array<long>"
    places = stored(blocks.select("file", F.col("block").cast("long"), "data").mapInArrow(ends, kind), "ends")
    summary = places.select(F.col("file").alias("__f"), F.col("block").alias("__b"), "held", F.size("ends").alias("n"), F.try_element_at("ends", F.lit(-1)).alias("final"))
    order = W.partitionBy("__f").orderBy("__b")
    earlier = order.rowsBetween(W.unboundedPreceding, -1)
    based = summary.select("*", F.coalesce(F.sum("held").over(earlier), F.lit(0)).alias("base"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("docs_before"), F.lead("__b").over(order).isNull().alias("last"))
    stitched = based.withColumn("final", F.col("final") + F.col("base")).withColumn("carry", F.coalesce(F.max("final").over(earlier), F.lit(0)))
    open_end = F.col("last") & (F.col("base") + F.col("held") > F.coalesce(F.col("final"), F.col("carry")))
    stitched = stitched.select("__f", "__b", "base", "docs_before", "carry", (F.col("base") + F.col("held")).alias("until"), open_end.alias("open_end"))
    joined = places.join(stitched, F.col("file").eqNullSafe(F.col("__f")) & F.col("block").eqNullSafe(F.col("__b")))
    all_ends = F.concat(F.transform("ends", lambda e: e + F.col("base")), F.when(F.col("open_end"), F.array("until")).otherwise(F.array().cast("array<long>")))
    each = joined.withColumn("all", all_ends).select("*", F.posexplode("all").alias("i", "end"))
    ended = ~(F.col("open_end") & (F.col("i") == F.size("all") - 1))
    start = F.when(F.col("i") == 0, F.col("carry")).otherwise(F.get("all", F.col("i") - 1))
    return each.select("file", (F.col("docs_before") + F.col("i")).alias("nth"), start.alias("start"), (F.col("end") - start - ended.cast("long")).alias("n_tokens"), ended.alias("ended"), "block", F.col("i").alias("nth_in_block"))


def counted(files: DataFrame, separator: int = 50256) -> DataFrame:
    """The scan of flatten()'s stored files, with the doc_id that the sidecar has for each document."""
    named = files.select(F.col("file").alias("__f"), F.col("block").alias("__b"), F.posexplode("doc_ids").alias("__i", "doc_id"))
    found = scan(files, separator)
    return found.join(named, (F.col("file") == F.col("__f")) & (F.col("block") == F.col("__b")) & (F.col("nth_in_block") == F.col("__i"))).select("doc_id", "n_tokens", "file", "nth", "start")
