"""Language identification by compression with per-language zstandard dictionaries."""

from __future__ import annotations

from collections.abc import Mapping

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import slices

#: Bounds of the training sample: documents and bytes of text per language, bytes taken of one document.
SAMPLE_DOCUMENTS, SAMPLE_BYTES, DOCUMENT_BYTES = 512, 112_000, 2_000
#: Bytes of text that one compression sees; zstandard level; least margin that is accepted.
BLOCK, LEVEL, MARGIN = 4096, 6, 0.002
#: What follows every block: digits in a row, so that zstandard never leaves a block as it is for being short.
TAIL = b"0123456789" * 26


def in_fold(key: Column, folds: int = 4, fold: int = 2) -> Column:
    """Whether a document is held out: CRC-32 of its key as text, modulo ``folds``."""
    return F.crc32(key.cast("string").cast("binary")) % folds == fold


def train(df: DataFrame, *, key: str = "doc_id", text: str = "text", label: str = "lang", documents: int = SAMPLE_DOCUMENTS, size: int = SAMPLE_BYTES, each: int = DOCUMENT_BYTES) -> dict[str, bytes]:
    """A raw-content dictionary per language, from a bounded sample of the labelled rows.

    ``documents`` rows of each language are drawn by the hash of their key: the languages are
    counted, a share of the rows somewhat above the bound is kept by hash, and the
    least hashes of those are used, so no task holds more than the sample.  The driver gets at
    most ``documents * each`` bytes per language, and one count per language.  Of these a dictionary takes
    ``size`` bytes: an equal share of each document, so some 218 bytes of its start where there are as many as 512.
    Rows without text or label are left out; the most frequent language comes first.
    """
    rows = df.where(F.col(label).isNotNull() & F.col(text).isNotNull()).select(F.xxhash64(F.col(key).cast("string"), F.lit(7)).alias("h"), F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    counts = {r["label"]: r["n"] for r in rows.groupBy("label").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return {}
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, 2.0 * documents / n))])[F.col("label")]
    kept = rows.where(F.pmod(F.col("h"), F.lit(1 << 30)) < share * (1 << 30)).select("label", "h", F.lower(F.substring("text", 1, each)).alias("text"))
    best = kept.withColumn("n", F.row_number().over(Window.partitionBy("label").orderBy("h", "text"))).where(F.col("n") <= documents)
    parts: dict[str, list] = {}
    for r in sorted(best.collect(), key=lambda r: (r["label"], r["n"])):
        parts.setdefault(r["label"], []).append(r["text"].encode())
    out = {}
    for language in sorted(parts, key=lambda x: (-counts[x], x)):
        # every document gives an equal share, and the most useful place, the end, goes to the first drawn
        share_of = max(64, size // len(parts[language]))
        out[language] = b"\n".join(p[: max(share_of, 64)] for p in reversed(parts[language]))[-size:]
    return out


class Identifier:
    """Compressed size of a text with each language's dictionary; the smallest wins.

    A text is cut into blocks of ``block`` bytes; each is compressed with TAIL after it, and what TAIL takes alone is taken off."""

    def __init__(self, dictionaries: Mapping[str, bytes], level: int = LEVEL, block: int = BLOCK):
        self.languages, self.block = list(dictionaries), block
        self.compressors = []
        for data in dictionaries.values():
            content = zstandard.ZstdCompressionDict(data, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=level)
            self.compressors.append(zstandard.ZstdCompressor(level=level, dict_data=content, write_content_size=False, write_dict_id=False))
        self.tails = [len(c.compress(TAIL)) for c in self.compressors]

    def sizes(self, text: str) -> list[int]:
        data = text.lower().encode("utf-8", "replace")
        blocks = [data[i : i + self.block] + TAIL for i in range(0, len(data), self.block)]
        return [max(1, sum(len(c.compress(x)) - tail for x in blocks)) for c, tail in zip(self.compressors, self.tails)]

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, margin): ``und`` and 0 for no letters; the margin is 1 - smallest / second smallest size.
        Of equal sizes the language that came first in training wins."""
        if not text or not any(map(str.isalpha, text)) or not self.languages:
            return "und", 0.0
        order = sorted((n, i) for i, n in enumerate(self.sizes(text)))
        margin = 1 - order[0][0] / order[1][0] if len(order) > 1 else 1.0
        return self.languages[order[0][1]], margin


def identify(df: DataFrame, dictionaries: Mapping[str, bytes], *, text: str = "text", margin: float = MARGIN) -> DataFrame:
    """Add lang_pred, score and rejected to every row of ``df``.

    Whole texts are compressed, in blocks, so a long text is judged like a short one and a task
    holds one block.  ``score`` is the margin; a row is rejected when it has no letters (characters of the Unicode category L; null
    texts too) or its margin is under ``margin``.  Columns of these names are replaced, all others kept; repeated rows are judged
    alike, and an empty table gives no rows.
    """
    kept = df.drop("lang_pred", "score", "rejected").withColumn(text, F.col(text).cast("string"))
    made, place, names = dict(dictionaries), kept.columns.index(text), [*kept.columns, "lang_pred", "score", "rejected"]

    def predict(batches):
        identifier = Identifier(made)
        for b in slices(batches):
            found = [identifier.predict(x) for x in b.column(place).to_pylist()]
            score = [s for _, s in found]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x for x, _ in found], pa.string()), pa.array(score, pa.float64()), pa.array([x == "und" or s < margin for x, s in found], pa.bool_())], names)

    own = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())]
    return kept.mapInArrow(predict, T.StructType([*kept.schema.fields, *own]))
