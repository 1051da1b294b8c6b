"""Media columns of progressive JPEG files.

`decode_media` turns a column of progressive JPEG files into full-resolution
RGB tensors (see `jpeg`). `store_payload` keeps bytes losslessly in such files:
the format's unit is the quantised coefficient, so each byte b is the
coefficient 256 + b, 64 a block, in MCUs of four luma blocks and one of each
chroma; a comment holds the number of payload bytes. Blocks that fill up the
last MCUs hold zeros.

Null and empty texts have a payload of 64 zeros. Equal texts give equal files.
A file that can't be read gives null tensors and an error text, and does not
stop the job. Repeated rows are each handled; extra columns are not carried;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidewright.llm import jpeg

SAMPLING = [(2, 2), (1, 1), (1, 1)]
#: Rows of a batch are handed on in parts of about so many payload bytes.
PART_BYTES = 2 << 20


def payload_of(text: str | None) -> bytes:
    raw = (text or "").encode()
    return raw + b"\0" * (64 - len(raw) % 64 if len(raw) % 64 or not raw else 0)


def pack(payload: bytes) -> bytes:
    """A payload of a multiple of 64 bytes as a progressive JPEG file."""
    n = -(-len(payload) // 384)
    cols = math.isqrt(n - 1) + 1
    rows = -(-n // cols)
    blocks = np.full((rows * cols, 6, 64), 256, np.int32)
    blocks.reshape(-1)[: len(payload)] += np.frombuffer(payload, np.uint8)
    luma = blocks[:, :4].reshape(rows, cols, 2, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows * 2, cols * 2, 64)
    chroma = [np.ascontiguousarray(blocks[:, k]).reshape(rows, cols, 64) for k in (4, 5)]
    return jpeg.encode([luma, *chroma], cols * 16, rows * 16, SAMPLING, str(len(payload)).encode())


def unpack(frame: jpeg.Frame) -> bytes:
    """The payload in the coefficients of a file that `pack` wrote."""
    luma, *chroma = (c.coefficients for c in frame.components)
    rows, cols = chroma[0].shape[:2]
    blocks = np.empty((rows * cols, 6, 64), np.uint8)
    blocks[:, :4] = (luma - 256).astype(np.uint8).reshape(rows, 2, cols, 2, 64).transpose(0, 2, 1, 3, 4).reshape(rows * cols, 4, 64)
    for k, c in enumerate(chroma):
        blocks[:, 4 + k] = (c - 256).astype(np.uint8).reshape(rows * cols, 64)
    return blocks.tobytes()[: int(frame.comments[0])]


def store_payload(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media (a progressive JPEG file with the text's bytes) of docs(doc_id, text)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, sizes, files, held = [], [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py() or ""
                ids.append(doc)
                sizes.append(len(text.encode()))
                files.append(pack(payload_of(text)))
                held += len(files[-1])
                if held > PART_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])
                    ids, sizes, files, held = [], [], [], 0
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", "text").mapInArrow(f, "doc_id long, n_bytes long, media binary")


TENSOR = "height int, width int, rgb binary, error string"


def decode_media(files: DataFrame, carry: list[str], column: str = "media") -> DataFrame:
    """Columns `carry`, then height, width, rgb (height * width * 3 bytes, row by row) and error of each file."""
    schema = ", ".join(f"`{c}` {dict(files.dtypes)[c]}" for c in carry)

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                one = batch.slice(i, 1)
                try:
                    rgb = jpeg.decode(one.column(column)[0].as_py() or b"")
                    row = [rgb.shape[0], rgb.shape[1], rgb.tobytes(), None]
                except (ValueError, KeyError, IndexError, StopIteration, TypeError) as e:
                    row = [None, None, None, f"{type(e).__name__}: {e}"]
                kinds = (pa.int32(), pa.int32(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([*(one.column(c) for c in carry), *(pa.array([x], t) for x, t in zip(row, kinds, strict=True))], names=[*carry, "height", "width", "rgb", "error"])

    return files.select(*dict.fromkeys([*carry, column])).mapInArrow(f, f"{schema}, {TENSOR}")


def feature_of(rgb: np.ndarray) -> str:
    """Size, mean of each channel and a checksum of the tensor."""
    n = rgb.shape[0] * rgb.shape[1]
    r, g, b = (int(rgb[..., k].sum(dtype=np.int64)) / n for k in range(3))
    return f"{rgb.shape[1]}x{rgb.shape[0]}:{r:.3f},{g:.3f},{b:.3f}:{zlib.crc32(rgb):08x}"


def read_back(stored: DataFrame) -> DataFrame:
    """Checksums of the payload and features of the tensor, from the stored files alone."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, media in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "n_bytes", "media")), strict=True):
                frame = jpeg.read_coefficients(media)
                payload = unpack(frame)
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(media), hashlib.sha256(media).hexdigest(), feature_of(jpeg.to_rgb(frame))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return stored.mapInArrow(f, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")
