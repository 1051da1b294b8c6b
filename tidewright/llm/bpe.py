"""Byte-level BPE encoding and decoding with overlapping chunks.

Texts are cut into chunks of CHUNK_CHARS that overlap by OVERLAP_CHARS. All
chunks of a slice are pre-tokenised at once; then the chunks of a text are
stitched where a boundary of one chunk is also a boundary of the next: from
there on both agree, because a pre-token depends only on the text ahead of its
start. The pre-tokens that are left are encoded, each different one once. If an
overlap has no common boundary, the text is split again as a whole. Decoding
concatenates the bytes of the ids.

Texts above FAR_CHARS are dealt out in larger chunks, so that one text keeps
several tasks busy; their chunks are stitched in the same way when they meet.

Nulls and empty texts have no ids. Repeated rows are encoded each. Columns
other than the key and the text are not carried. An empty table gives an
empty result. A surrogate code point can't occur in Spark's UTF-8.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewright.llm.pretoken import PieceCache, boundaries, split_batch
from tidewright.llm.textkernel import codes, ragged, slices

CHUNK_CHARS = 1_024
OVERLAP_CHARS = 128
#: Texts above this are dealt out in chunks of FAR_CHUNK code points with FAR_OVERLAP.
FAR_CHARS = 1 << 20
FAR_CHUNK = 1 << 18
FAR_OVERLAP = 1_024
#: Pieces that a worker keeps encoded.
CACHED_PIECES = 200_000
#: A match may depend on so many characters after its end.
LOOKAHEAD = 4

_caches: dict[str, PieceCache] = {}
_bytes: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
_ranks: dict[str, dict[bytes, int]] = {}


def load_ranks(path: str) -> dict[bytes, int]:
    if path not in _ranks:
        with open(path, "rb") as f:
            _ranks[path] = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return _ranks[path]


def piece_cache(path: str) -> PieceCache:
    """The worker's cache of encoded pieces for the rank file."""
    if path not in _caches:
        import public_tokenizers
        import tiktoken

        encoding = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
        single = encoding._core_bpe.encode_single_piece
        _caches[path] = PieceCache(lambda pieces: [single(p.encode()) for p in pieces], limit=CACHED_PIECES)
    return _caches[path]


def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens' bytes in a row, and each token's start and length."""
    if path not in _bytes:
        ranks = load_ranks(path)
        table = [b""] * (max(ranks.values()) + 1)
        for k, v in ranks.items():
            table[v] = k
        sizes = np.array([len(t) for t in table], np.int64)
        _bytes[path] = np.frombuffer(b"".join(table), np.uint8), np.cumsum(sizes) - sizes, sizes
    return _bytes[path]


def cut(texts: list[str], chunk: int, overlap: int) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Chunks of all texts in order, the text of each and its start there."""
    parts, owner, start = [], [], []
    for i, t in enumerate(texts):
        for at in range(0, len(t), chunk):
            parts.append(t[at : at + chunk + overlap])
            owner.append(i)
            start.append(at)
            if at + chunk + overlap >= len(t):
                break
    return parts, np.array(owner, np.int64), np.array(start, np.int64)


def stitched(texts: list[str], chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray, list[int]]:
    """Pre-tokens of the texts from their chunks.

    Returns the joined chunks, their code points, starts and ends of the pre-tokens, the text of each, and the texts
    with an overlap without a common boundary, which have no pre-tokens here.
    """
    parts, owner, start = cut(texts, chunk, overlap)
    joined, c, starts, ends, first = split_batch(parts)
    m = len(parts)
    if not m:
        return joined, c, starts[:0], ends[:0], owner, []
    size = np.array([len(p) for p in parts], np.int64)
    k = np.repeat(np.arange(m), np.diff(first))
    shift = start - (np.cumsum(size + 1) - size - 1)
    pos, stop, end = starts + shift[k], ends + shift[k], start + size
    follows = owner[1:] == owner[:-1]
    more, before = np.append(follows, False), np.append(False, follows)
    # boundaries of a chunk that the text after it can't change, and boundaries of the next chunk in the overlap
    sure = more[k] & (stop < end[k] - LOOKAHEAD) & (pos >= np.append(start[1:], 0)[k])
    again = before[k] & (pos < np.append(0, end[:-1])[k])
    common = np.intersect1d(k[sure] << 40 | pos[sure], (k[again] - 1) << 40 | pos[again], assume_unique=True)
    pair, at = np.unique(common >> 40, return_index=True)
    meet = np.full(m, -1, np.int64)
    meet[pair] = common[at] & ((1 << 40) - 1)
    lost = np.unique(owner[more & (meet < 0)])
    keep = (~before[k] | (pos >= np.append(0, meet[:-1])[k])) & (~more[k] | (pos < meet[k])) & ~np.isin(owner[k], lost)
    return joined, c, starts[keep], ends[keep], owner[k[keep]], lost.tolist()


def encode_texts(texts: list[str], path: str, chunk: int = CHUNK_CHARS, overlap: int = OVERLAP_CHARS) -> list[bytes]:
    """Ids of each text as little-endian unsigned 32-bit integers."""
    joined, c, starts, ends, owner, lost = stitched(texts, chunk, overlap)
    ids, sizes = piece_cache(path).lookup(c, starts, ends, joined)
    at = np.append(0, np.cumsum(sizes))[np.searchsorted(owner, np.arange(len(texts) + 1))]
    raw = ids.astype("<u4").tobytes()
    out = [raw[4 * a : 4 * b] for a, b in zip(at[:-1], at[1:], strict=True)]
    for i in lost:
        out[i] = encode_whole(texts[i], path)
    return out


def encode_whole(text: str, path: str) -> bytes:
    """Ids of a text that is pre-tokenised in one piece."""
    joined, c, starts, ends, _ = split_batch([text])
    return piece_cache(path).lookup(c, starts, ends, joined)[0].astype("<u4").tobytes()


def decode_ids(ids: list[bytes], path: str) -> list[bytes]:
    """Bytes of each list of ids."""
    flat, at, sizes = token_bytes(path)
    every = np.frombuffer(b"".join(ids), "<u4")
    out = flat[ragged(at[every], sizes[every])].tobytes()
    ends = np.append(0, np.cumsum(sizes[every]))[np.append(0, np.cumsum([len(x) // 4 for x in ids]))]
    return [out[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


def split_chunk(text: str) -> np.ndarray:
    """Boundaries of the pre-tokens of one text, its end included."""
    c, at = codes([text])
    return boundaries(c[:-1], np.array([0, at[1] - 1]))


def _cut(batches: Iterator[pa.RecordBatch], chunk: int, overlap: int) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("chunk", pa.int32()), ("start", pa.int64()), ("last", pa.bool_()), ("text", pa.string())])
    for batch in batches:
        for i in range(batch.num_rows):
            row, doc, text = (batch.column(k)[i].as_py() for k in ("row", "doc_id", "text"))
            for k, start in enumerate(range(0, len(text), chunk)):
                piece = text[start : start + chunk + overlap]
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((row, doc, k, start, start + chunk >= len(text), piece), schema.types, strict=True)], schema=schema)


def _encode_chunks(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    cache = piece_cache(path)
    for batch in batches:
        for part, texts in slices(batch):
            bounds, ids, sizes = [], [], []
            for text in texts:
                b = split_chunk(text)
                c, _ = codes([text])
                got, n = cache.lookup(c, b[:-1], b[1:], text)
                bounds.append(b.astype("<i8").tobytes())
                ids.append(got.astype("<u4").tobytes())
                sizes.append(n.astype("<i4").tobytes())
            yield pa.RecordBatch.from_arrays([*part.columns, pa.array(bounds, pa.binary()), pa.array(ids, pa.binary()), pa.array(sizes, pa.binary())], names=[*part.schema.names, "bounds", "ids", "sizes"])


def stitch(chunks: list[dict], path: str) -> bytes:
    """Ids of a text from its chunks in order: start, last, text, bounds, ids, sizes."""
    out, at, k = [], 0, 0  # at: a sure boundary
    end = chunks[-1]["start"] + len(chunks[-1]["text"])
    while k < len(chunks):
        x = chunks[k]
        b = np.frombuffer(x["bounds"], "<i8") + x["start"]
        sizes = np.frombuffer(x["sizes"], "<i4")
        first = int(np.searchsorted(b, at))
        if x["last"]:
            stop = len(b) - 1
        else:
            y = chunks[k + 1]
            sure = b[:-1][b[1:] < x["start"] + len(x["text"]) - LOOKAHEAD]
            common = np.intersect1d(sure[sure >= y["start"]], np.frombuffer(y["bounds"], "<i8")[:-1] + y["start"])
            if not len(common):
                # no boundary in common: split what is left, from the last sure one
                p = int(max(at, sure[-1])) if len(sure) else at
                stop = int(np.searchsorted(b, p))
                rest = "".join(z["text"][: (chunks[i + 1]["start"] - z["start"]) if i + 1 < len(chunks) else None] for i, z in enumerate(chunks) if i >= k)[p - x["start"] :]
                out.append(_ids(x, sizes, first, stop))
                out.append(encode_whole(rest, path))
                break
            stop = int(np.searchsorted(b, common[0]))
        out.append(_ids(x, sizes, first, stop))
        at, k = int(b[stop]), k + 1
        if at >= end:
            break
    return b"".join(out)


def _ids(chunk: dict, sizes: np.ndarray, first: int, stop: int) -> bytes:
    a = int(sizes[:first].sum())
    return chunk["ids"][4 * a : 4 * (a + int(sizes[first:stop].sum()))]


def _stitch_group(key: tuple, frame: pd.DataFrame, path: str) -> pd.DataFrame:
    chunks = frame.sort_values("chunk").to_dict("records")
    return pd.DataFrame({"doc_id": [chunks[0]["doc_id"]], "ids": [stitch(chunks, path)]})


def encode(docs: DataFrame, ranks_path: str, chunk_chars: int = CHUNK_CHARS, overlap_chars: int = OVERLAP_CHARS, far_chars: int = FAR_CHARS, far_chunk: int = FAR_CHUNK, far_overlap: int = FAR_OVERLAP) -> DataFrame:
    """Columns doc_id and ids (little-endian unsigned 32-bit) of every row of docs(doc_id, text)."""
    rows = docs.select("doc_id", "text")
    far = F.coalesce(F.length("text") > far_chars, F.lit(False))

    def here(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in slices(batch):
                ids = encode_texts(texts, ranks_path, chunk_chars, overlap_chars)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], names=["doc_id", "ids"])

    whole = rows.where(~far).mapInArrow(here, "doc_id long, ids binary")
    dealt = rows.where(far).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text").mapInArrow(lambda it: _cut(it, far_chunk, far_overlap), "row long, doc_id long, chunk int, start long, last boolean, text string")
    parts = dealt.repartition("row", "chunk").mapInArrow(lambda it: _encode_chunks(it, ranks_path), "row long, doc_id long, chunk int, start long, last boolean, text string, bounds binary, ids binary, sizes binary")
    met = parts.groupBy("row").applyInPandas(lambda k, f: _stitch_group(k, f, ranks_path), "doc_id long, ids binary")
    return whole.unionByName(met)


def decode(tokens: DataFrame, ranks_path: str, out: str = "decoded") -> DataFrame:
    """Columns doc_id, ids and the concatenated bytes of the ids, from tokens(doc_id, ids)."""

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                raw = decode_ids([x or b"" for x in part.column("ids").to_pylist()], ranks_path)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(raw, pa.binary())], names=["doc_id", "ids", out])

    return tokens.select("doc_id", "ids").mapInArrow(f, f"doc_id long, ids binary, {out} binary")


def digests(decoded: DataFrame) -> DataFrame:
    """Counts and checksums of encoded and decoded rows."""
    return decoded.select("doc_id", F.expr("cast(length(ids) div 4 as long)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def reference_digest(text: str, path: str) -> tuple[int, str, str]:
    """The tiktoken library's own answer for one text, for tests."""
    import public_tokenizers
    import tiktoken

    e = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=load_ranks(path), special_tokens={})
    ids = e.encode_ordinary(text or "")
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(e.decode_bytes(ids)).hexdigest()
