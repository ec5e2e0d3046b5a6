"""Order MinHash fingerprints: sketches that follow edit distance.

For each of ``sketches`` hash functions the ``tuple_size`` k-mers of least hash are chosen
among all k-mers of the text, each numbered by its occurrence, and put back into text order;
the hash of that ordered tuple is one entry of the fingerprint.  Two texts agree in an entry
when they share those k-mers in the same order, so both content and order count.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import partitions, range_cuts, range_of

K, TUPLE, SKETCHES = 12, 2, 64
_ODD = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.lru_cache(4)
def _functions(count: int) -> tuple[np.ndarray, np.ndarray]:
    """An odd factor and a mask for each hash function."""
    x = _mix(np.arange(1, 2 * count + 1, dtype=np.uint64) * _ODD)
    return (x[:count] >> np.uint64(32)).astype(np.uint32) | np.uint32(1), (x[count:] >> np.uint64(32)).astype(np.uint32)


def kmer_hashes(text: str, k: int) -> np.ndarray:
    """A 64-bit hash of each k-mer of code points; a shorter text is one k-mer, an empty one has none."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    k = min(k, len(codes))
    if not k:
        return codes
    # hashes of 2^j code points double; k is put together from its binary digits
    part, length, out, done = (codes + np.uint64(1)) * _ODD, 1, None, 0
    size = len(codes) - k + 1
    while True:
        if k & length:
            piece = part[done : done + size]
            out = piece.copy() if out is None else out * np.uint64(pow(0xD1342543DE82EF95, length, 1 << 64)) + piece
            done += length
        if done == k:
            return _mix(out)
        part = part[:-length] * np.uint64(pow(0xD1342543DE82EF95, length, 1 << 64)) + part[length:]
        length *= 2


def numbered(hashes: np.ndarray) -> np.ndarray:
    """Mix into each hash how often it occurred before; a first occurrence keeps its hash."""
    ordered = np.sort(hashes)
    again = ordered[1:] == ordered[:-1]
    if not again.any():
        return hashes
    repeated = ordered[1:][again]
    repeated = repeated[np.flatnonzero(np.r_[True, repeated[1:] != repeated[:-1]])]
    at = np.minimum(np.searchsorted(repeated, hashes), len(repeated) - 1)
    places = np.flatnonzero(repeated[at] == hashes)
    places = places[np.argsort(at[places], kind="stable")]
    groups = at[places]
    starts = np.flatnonzero(np.r_[True, groups[1:] != groups[:-1]])
    number = np.arange(len(places)) - np.repeat(starts, np.diff(np.r_[starts, len(places)]))
    later = places[number > 0]
    out = hashes.copy()
    out[later] = _mix(out[later] + number[number > 0].astype(np.uint64) * _ODD)
    return out


def order_minhash(text: str, k: int = K, tuple_size: int = TUPLE, sketches: int = SKETCHES) -> np.ndarray:
    """The fingerprint of a text as ``sketches`` unsigned 32-bit entries."""
    base = numbered(kmer_hashes(text, k))
    n = len(base)
    short = (base >> np.uint64(32)).astype(np.uint32)
    factors, masks = _functions(sketches)
    chosen = np.empty((sketches, min(tuple_size, n)), np.int64)
    rows = max(1, (1 << 17) // max(1, n))
    for at in range(0, sketches if n else 0, rows):
        values = (short ^ masks[at : at + rows, None]) * factors[at : at + rows, None]
        line = np.arange(len(values))
        for j in range(chosen.shape[1]):
            least = values.argmin(axis=1)
            chosen[at : at + rows, j] = least
            values[line, least] = 0xFFFFFFFF
    chosen.sort(axis=1)
    out = np.arange(sketches, dtype=np.uint64) * _ODD
    for j in range(chosen.shape[1]):
        out = _mix(out * np.uint64(0xD1342543DE82EF95) + base[chosen[:, j]])
    return (out >> np.uint64(32)).astype(np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Share of equal entries, 0 to 1."""
    return float((a == b).mean())


def edited(text: str, following: str) -> str:
    """``text`` with its last floor(n / 2) code points replaced by the first as many of ``following``."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def compare_with_next(df: DataFrame, *, key: str = "doc_id", text: str = "text", k: int = K, tuple_size: int = TUPLE, sketches: int = SKETCHES) -> DataFrame:
    """Fingerprint every text and its edited text, in ascending key order; after the last comes the first.

    One shuffle deals the texts to key ranges.  The first row of a range also goes to the range
    before it (the first of all to the last), so each task reads its rows in order and needs no
    other.  A null text is empty; null keys come first; rows of one key follow each other by
    the text's hash; a single row follows itself; an empty table gives no rows.  A very long text is hashed in
    array passes of its own size; other columns are ignored.

    Returns key, n_chars, edited_sha256, fingerprint, edited_fingerprint (hex), near_edited, near_next.
    """
    import hashlib

    kind = df.schema[key].dataType.simpleString()
    schema = f"{key} {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    names = [x.split()[0] for x in schema.split(", ")]
    own = df.select(F.col(key).alias("k"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("t"))
    cuts = range_cuts(own, "k", partitions(df.sparkSession))
    ranged = own.withColumn("r", range_of(F.col("k"), cuts))
    # one row per range: at most as many as there are partitions
    heads = {x["r"]: x["head"]["k"] for x in ranged.groupBy("r").agg(F.min(F.struct("k")).alias("head")).collect()}
    full = sorted(heads)
    previous = dict(zip(full, full[-1:] + full[:-1]))
    every = range(len(cuts) + 1)
    head = F.array(*[F.lit(heads.get(i)).cast(kind) for i in every])[F.col("r")]
    back = F.array(*[F.lit(previous.get(i, 0)) for i in every])[F.col("r")]
    places = F.when(F.col("k").eqNullSafe(head), F.array(F.struct(F.col("r").alias("r"), F.lit(False).alias("guest")), F.struct(back.alias("r"), F.lit(True).alias("guest")))).otherwise(F.array(F.struct(F.col("r").alias("r"), F.lit(False).alias("guest"))))
    dealt = ranged.select("k", "t", F.explode(places).alias("at")).select("k", "t", F.col("at.r").alias("r"), F.col("at.guest").alias("guest"))
    ordered = dealt.repartitionById(len(cuts) + 1, F.col("r")).sortWithinPartitions("guest", "k", F.xxhash64("t")).select("k", "guest", "t")

    def compare(batches):
        mark = functools.partial(order_minhash, k=k, tuple_size=tuple_size, sketches=sketches)
        before, over = None, False
        for b in batches:
            rows = []
            for key_, guest, t in zip(*(b.column(i).to_pylist() for i in range(3))):
                if over:
                    break
                print_ = mark(t)
                if before is not None:
                    k0, t0, p0 = before
                    changed = edited(t0, t)
                    p1 = mark(changed)
                    rows.append((k0, len(t0), hashlib.sha256(changed.encode()).hexdigest(), p0.astype(">u4").tobytes().hex(), p1.astype(">u4").tobytes().hex(), likeness(p0, p1), likeness(p0, print_)))
                before, over = (key_, t, print_), guest
            if rows:
                types = (b.column(0).type, pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(list(c), x) for c, x in zip(zip(*rows), types)], names)

    return ordered.mapInArrow(compare, schema)
