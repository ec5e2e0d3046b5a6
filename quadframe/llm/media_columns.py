"""Spark side of the media columns: store payloads as images, read them back, derive tiles and hashes."""

from __future__ import annotations

import hashlib
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import media
from .shared import slices, written

#: Samples in a row of a stored image; payloads are padded to whole rows.
ROW = 64


def text_to_media(df: DataFrame, *, key: str = "doc_id", text: str = "text", form: str = "pgm") -> DataFrame:
    """key, n_bytes, media: the UTF-8 bytes of each text, padded with 0 to whole rows of 64
    samples (one row at least), as a grey image of ``form`` pgm or bmp.  A null text is empty, an empty table gives no rows,
    repeated rows give equal rows, and other columns are ignored."""
    encode = {"pgm": media.encode_pgm, "bmp": media.encode_bmp}[form]
    kind = df.schema[key].dataType.simpleString()

    def store(batches):
        for b in slices(batches, 100):
            sizes, out = [], []
            for x in b.column(1).to_pylist():
                sizes.append(len(x or b""))
                rows = max(1, -(-sizes[-1] // ROW))
                out.append(encode(np.frombuffer((x or b"").ljust(rows * ROW, b"\0"), np.uint8).reshape(rows, ROW)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int64()), pa.array(out, pa.binary())], [key, "n_bytes", "media"])

    return df.select(F.col(key), F.col(text).cast("string").cast("binary").alias("data")).mapInArrow(store, f"{key} {kind}, n_bytes long, media binary")


def media_features(df: DataFrame, *, key: str = "doc_id", media_column: str = "media", keep: tuple[str, ...] = (), side: int = 8) -> DataFrame:
    """Decode a binary column of Netpbm and BMP images.

    Adds height, width, payload_bytes, payload_sha256 and tail_crc32 of the decoded samples in
    row order, media_bytes and media_sha256 of the stored form, ``feature`` (difference hash)
    and ``tile`` (NPY bytes), and ``error``; where the bytes are null or no image, all but
    ``error`` and the two of the stored form are null.  A row is independent of all others.
    Only ``key`` and the columns of ``keep`` are passed on; one of these names among them is refused.
    """
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in (key, *keep))
    own = "height int, width int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, tile binary, error string"
    names = [key, *keep, *(x.split()[0] for x in own.split(", "))]
    if len(set(names)) < len(names):
        raise ValueError("a kept column has the name of one that is made")
    types = (pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string())

    def one(data: bytes | None) -> tuple:
        stored = (None, None) if data is None else (len(data), hashlib.sha256(data).hexdigest())
        try:
            samples = np.ascontiguousarray(media.decode(data or b""))
        except media.BadImage as e:
            return (*[None] * 5, *stored, None, None, str(e))
        raw = samples.reshape(-1).view(np.uint8)
        return (*samples.shape[:2], raw.size, hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-ROW:]), *stored, media.difference_hash(samples, side), media.npy_tile(samples, side), None)

    def features(batches):
        n = 1 + len(keep)
        for b in slices(batches, 100):
            rows = [one(x) for x in b.column(n).to_pylist()]
            columns = zip(*rows) if rows else [[] for _ in types]
            yield pa.RecordBatch.from_arrays([*b.columns[:n], *(pa.array(list(c), t) for c, t in zip(columns, types))], names)

    return df.select(key, *keep, F.col(media_column)).mapInArrow(features, f"{kinds}, {own}")


def stored_text_media(df: DataFrame, form: str = "pgm") -> DataFrame:
    """Store the texts of ``documents`` as images in the shared folder, read them back and derive the features."""
    return media_features(written(text_to_media(df, form=form), "media"), keep=("n_bytes",))
