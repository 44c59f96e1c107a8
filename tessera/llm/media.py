"""Media columns: texts as progressive JPEG files, files as full-resolution RGB tensors, and what is read back of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm import jpeg
from tessera.llm.common import small_batches

UNIT = 576
#: Bytes of payload decoded together; bounds a task's memory, a single larger file aside.
TOGETHER = 512 << 10


def padded(text: bytes) -> bytes:
    """text and bytes 255 up to a positive multiple of UNIT."""
    return text + b"\xff" * (-len(text) % UNIT if text else UNIT)


def _spells(sizes: list[int]) -> Iterator[slice]:
    """Stretches of rows of TOGETHER bytes at most, one row at least."""
    lo = total = 0
    for i, n in enumerate(sizes):
        if i > lo and total + n > TOGETHER:
            yield slice(lo, i)
            lo, total = i, 0
        total += n
    if lo < len(sizes):
        yield slice(lo, len(sizes))


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's padded bytes as a progressive JPEG file.

    Null text counts as empty. Repeated rows keep a row each; other columns are ignored; an empty table gives an empty
    result.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [t or b"" for t in b.column(1).cast(pa.binary()).to_pylist()]
            for part in _spells([len(t) for t in texts]):
                files = jpeg.encode_all([padded(t) for t in texts[part]])
                yield pa.RecordBatch.from_arrays([b.column(0)[part.start : part.stop], pa.array([len(t) for t in texts[part]], pa.int64()), pa.array(files, pa.binary())], ["doc_id", "n_bytes", "media"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary")


def _read(files: list[bytes]) -> list[tuple[jpeg.Image, list[np.ndarray], np.ndarray]]:
    """Frame, coefficients and RGB tensor of each file."""
    images = [jpeg.parse(f) for f in files]
    planes = jpeg.coefficients(images)
    return list(zip(images, planes, jpeg.rgb_all(images, planes), strict=True))


def tensors(media: DataFrame, column: str = "media", payload: bool = False) -> DataFrame:
    """media with height, width and rgb (binary, height x width x 3 bytes) of each file, and the payload read back if asked.

    Null files give nulls; any file that is not progressive JPEG raises. Columns of these names are replaced, others
    pass through; repeated rows keep a row each; an empty table gives an empty result. Row-wise, without a shuffle.
    """
    small_batches(media.sparkSession)
    kept = media.drop("height", "width", "rgb", *(["payload"] if payload else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            files = b.column(b.schema.names.index(column)).to_pylist()
            for part in _spells([len(f or b"") for f in files]):
                got = iter(_read([f for f in files[part] if f is not None]))
                seen = [None if f is None else next(got) for f in files[part]]
                size = lambda i: pa.array([None if x is None else x[2].shape[i] for x in seen], pa.int32())  # noqa: B023, E731
                more = [pa.array([None if x is None else jpeg.payload(x[0], x[1]) for x in seen], pa.binary())] if payload else []
                yield pa.RecordBatch.from_arrays([*(c[part.start : part.stop] for c in b.columns), size(0), size(1), pa.array([None if x is None else x[2].tobytes() for x in seen], pa.binary()), *more], [*b.schema.names, "height", "width", "rgb", *(["payload"] if payload else [])])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema.fields)
    return kept.mapInArrow(run, f"{fields}, height int, width int, rgb binary" + (", payload binary" if payload else ""))


def feature(picture: np.ndarray) -> str:
    """Size, and mean and standard deviation of each channel, of an RGB tensor."""
    h, w, _ = picture.shape
    flat = picture.reshape(-1, 3).astype(float)  # sums of whole numbers, exact
    n = len(flat)
    s, q = flat.sum(0).tolist(), np.einsum("ij,ij->j", flat, flat).tolist()
    return f"{w}x{h} mean {' '.join(f'{x / n:.3f}' for x in s)} dev {' '.join(f'{max(0.0, b / n - (a / n) ** 2) ** 0.5:.3f}' for a, b in zip(s, q, strict=True))}"


def report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256, feature) of every document.

    Everything after n_bytes is of the stored file read back; feature is of the tensor stored in the row. Null text
    counts as empty: one unit of padding. Equal texts give equal values; repeated rows and ids keep a row each; other
    columns are ignored; an empty table gives an empty result. Row-wise, without a shuffle; memory follows the longest
    text.
    """
    read = tensors(store(docs), payload=True)
    sums = read.select(
        "doc_id", "n_bytes", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha2("payload", 256).alias("payload_sha256"), F.crc32(F.substring("payload", -32, 32)).alias("tail_crc32"),
        F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "height", "width", "rgb",
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            pics = zip(*(b.column(i).to_pylist() for i in (7, 8, 9)), strict=True)
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array([feature(np.frombuffer(x, np.uint8).reshape(h, w, 3)) for h, w, x in pics], pa.string())], [*b.schema.names[:7], "feature"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return sums.mapInArrow(run, f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
