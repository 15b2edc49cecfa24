"""Media columns: images as binary columns, decoded to RGB tensors and features.

Payloads are held in progressive JPEGs (jpeg.py), a long one in several images after
one another, so that none needs more memory than one image does. The table of images is
written, and everything else is taken from what is read back.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenta.llm import jpeg

UNIT = 576
#: Payload bytes of one image at most.
IMAGE = UNIT * 512
#: Media bytes that are handed on at once.
HELD = 16 << 20


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of 576."""
    return data + b"\xff" * ((-len(data) % UNIT) or (0 if data else UNIT))


def images(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and images, an array of files, of every text; null texts count as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0

            def out() -> pa.RecordBatch:
                doc, n, files = zip(*rows, strict=True)
                return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(n, pa.int64()), pa.array(files, pa.list_(pa.binary()))], names=["doc_id", "n_bytes", "images"])

            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_buffer().to_pybytes() if text.is_valid else b""
                payload = padded(data)
                files = [jpeg.store(payload[at : at + IMAGE]) for at in range(0, len(payload), IMAGE)]
                rows.append((doc, len(data), files))
                held += sum(map(len, files))
                if held >= HELD:
                    yield out()
                    rows, held = [], 0
            if rows:
                yield out()

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, images array<binary>")


def tensors(table: DataFrame, column: str = "image", most: int = jpeg.PIXELS) -> DataFrame:
    """table plus height, width, rgb (rows of pixels, three bytes each) and error of its JPEG column.

    Null stays null. What can't be decoded, or has more than most pixels, has a null
    tensor and says why in error. Columns of those names in table are replaced. Tensors
    are handed on in batches of about 16 MB.
    """
    new = ("height", "width", "rgb", "error")
    keep = [c for c in table.columns if c.lower() not in new]
    source = table.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{column}`").alias("__image"))
    schema = table.select(*[F.col(f"`{c}`") for c in keep]).schema.add("height", "integer").add("width", "integer").add("rgb", "binary").add("error", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = done = 0
            for i in range(batch.num_rows):
                x, row = batch.column(len(keep))[i].as_py(), (None, None, None, None)
                if x is not None:
                    try:
                        t = jpeg.rgb(*jpeg.decode(x, most))
                        row = (t.shape[0], t.shape[1], t.tobytes(), None)
                    except ValueError as e:
                        row = (None, None, None, str(e))
                rows.append(row)
                held += len(row[2] or b"")
                if held >= HELD or i == batch.num_rows - 1:
                    cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.binary(), pa.string()), strict=True)]
                    yield pa.RecordBatch.from_arrays([*[c.slice(done, len(rows)) for c in batch.columns[: len(keep)]], *cols], names=schema.names)
                    rows, held, done = [], 0, i + 1

    return source.mapInArrow(run, schema)


def feature(images: list[np.ndarray]) -> str:
    """Sizes, and each channel's mean and deviation over all pixels."""
    n = sum(t.shape[0] * t.shape[1] for t in images)
    total = sum(t.sum(axis=(0, 1), dtype=np.int64) for t in images)
    square = sum(np.einsum("ijk,ijk->k", t.astype(np.float32), t.astype(np.float32)).astype(np.float64) for t in images)
    mean = total / n
    return "x".join(map(str, images[0].shape[:2])) + f"x{len(images)};" + ",".join(f"{m:.2f}/{d:.2f}" for m, d in zip(mean, np.sqrt(np.maximum(square / n - mean**2, 0)), strict=True))


def read_back(rows: DataFrame) -> DataFrame:
    """Digests of what the written table of images() holds, and a feature of its pixels.

    Everything is taken from the decoded files. Repeated rows are decoded each; an empty
    table gives an empty one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for files in batch.column(2):
                payload, pixels, whole, size = [], [], hashlib.sha256(), 0
                for image in files.values:
                    data = image.as_buffer().to_pybytes()
                    whole.update(data)
                    size += len(data)
                    parts, info = jpeg.decode(data)
                    payload.append(jpeg.stored(parts, info))
                    pixels.append(jpeg.rgb(parts, info))
                data = b"".join(payload)
                out.append((len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-32:]), size, whole.hexdigest(), feature(pixels)))
            cols = list(zip(*out, strict=True)) or [[]] * 6
            kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], *[pa.array(c, t) for c, t in zip(cols, kinds, strict=True)]], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return rows.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
