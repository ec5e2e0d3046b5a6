"""Vectors as codes of a few bytes: a codebook per part, learned by Yinyang's form of Lloyd's rounds on whole numbers."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .shared import discard, join_hot, written
from .vectors import as_binary, common_length, fixed, quantised, roots, squared_distances, unpack

#: The largest lower bound that is kept; a smaller bound than the true one is still a bound.
_FAR = np.iinfo(np.uint16).max


def group_entries(entries: np.ndarray, groups: int) -> np.ndarray:
    """A group number for each entry of a codebook: a few rounds of Lloyd's on the entries themselves."""
    centres = entries[:: max(1, len(entries) // groups)][:groups].astype(np.float64)
    for _ in range(5):
        own = ((entries[:, None, :] - centres) ** 2).sum(axis=2).argmin(axis=1)
        for g in np.unique(own):
            centres[g] = entries[own == g].mean(axis=0)
    return own


def assign_part(x: np.ndarray, entries: np.ndarray, groups: np.ndarray, current: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The nearest entry of each row, its squared distance and new lower bounds.

    ``lower`` has for each row and group a whole number that no entry of the group, but for ``current``, is nearer than.  A group
    is scanned where the square of its bound does not exceed the squared distance to ``current``; all are whole numbers, so an entry
    at the same distance is always seen, and the one of lower index taken.
    """
    own = x - entries[current]
    to_current = (own * own).sum(axis=1)
    best, least = current.copy(), to_current.copy()
    scan = lower * lower <= to_current[:, None]
    seen = {}
    for g in range(lower.shape[1]):
        members, rows = np.flatnonzero(groups == g), np.flatnonzero(scan[:, g])
        if not len(rows) or not len(members):
            continue
        far = squared_distances(x[rows], entries[members])
        first = far.argmin(axis=1)
        near, name = far[np.arange(len(rows)), first].astype(np.int64), members[first]
        far[np.arange(len(rows)), first] = np.iinfo(np.int64).max if far.dtype == np.int64 else np.inf
        second = roots(np.minimum(far.min(axis=1), float(_FAR) ** 2).astype(np.int64))
        seen[g] = rows, near, name, second
        nearer = (near < least[rows]) | ((near == least[rows]) & (name < best[rows]))
        best[rows[nearer]], least[rows[nearer]] = name[nearer], near[nearer]
    lower = lower.copy()
    for g, (rows, near, name, second) in seen.items():
        lower[rows, g] = np.where(name == best[rows], second, roots(near))
    # an entry that is left becomes one of its group, whether or not that was scanned
    left = np.flatnonzero(best != current)
    at = left, groups[current[left]]
    lower[at] = np.minimum(lower[at], roots(to_current[left]))
    return best, least, np.minimum(lower, _FAR)


def _drift(before: np.ndarray, after: np.ndarray, groups: np.ndarray, n: int) -> np.ndarray:
    """Per group the way of its farthest-moved entry, rounded up."""
    moved = ((after - before) ** 2).sum(axis=1)
    way = roots(moved)
    way += way * way < moved
    return np.array([way[groups == g].max(initial=0) for g in range(n)], np.int64)


def _moves(state: DataFrame, shape: tuple[int, int, int]) -> list:
    """Per part and entry: how many rows came and went since the round before, and what that adds to the sums of its components."""
    parts, entries, width = shape

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, counts = np.zeros(shape, np.int64), np.zeros((parts, entries), np.int64)
        for batch in batches:
            x = unpack(batch.column("q"), parts * width).reshape(-1, parts, width)
            old = batch.column("before")
            for codes, rows, sign in ((fixed(batch.column("codes"), "u1", parts), x, 1), (fixed(old.drop_null(), "u1", parts), x[~old.is_null().to_numpy(zero_copy_only=False)], -1)):
                for p in range(parts):
                    counts[p] += sign * np.bincount(codes[:, p], minlength=entries)
                    for i in range(width):  # sums of one batch are below 2^53, so doubles are exact
                        totals[p, :, i] += sign * np.bincount(codes[:, p], rows[:, p, i], entries).astype(np.int64)
        p, e = np.nonzero(counts.astype(bool) | totals.any(axis=2))
        yield pa.RecordBatch.from_arrays([pa.array(p), pa.array(e), pa.array(counts[p, e]), pa.array(totals[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

    changed = state.where(F.col("before").isNull() | (F.col("before") != F.col("codes"))).select("q", "codes", "before")
    found = changed.mapInArrow(add, "part long, entry long, n long, sums array<long>")
    return found.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(width)]).alias("sums")).collect()


def compress(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", *, parts: int = 4, entries: int = 256, rounds: int = 4, groups: int = 16, scale: int = 1024) -> DataFrame:
    """key, code, error, label_error and codebooks_sha256 of every vector without null or non-finite components.

    Components become floor(scale * x).  The codebook of each part starts as that part of the ``entries`` (at most 256) vectors of least key.
    Between rounds a table holds each vector's codes and, per part and group of entries, a lower bound in two bytes; a round lowers
    the bounds by how far a group's entries moved and scans only groups whose bound does not rule them out.  Codebook sums change by the
    vectors that moved alone, and the driver holds no more than the codebooks and their sums.

    Vectors of another length than the most frequent one that ``parts`` divides cannot be cut alike and are left out.  A repeated row is a vector of
    its own; where keys are equal the lesser vector starts first, and null keys come last; fewer vectors make smaller codebooks.
    Null labels are together.  An empty table gives no rows; other columns are left behind, whatever their names.  Components beyond 2^27
    count as 2^27 - 1; a sum of errors that no long holds is null.
    """
    if not 0 < entries <= 256:
        raise ValueError("a code is one byte a part")
    source = vectors.select(F.col(key).alias("k"), F.col(label).alias("label"), F.col(vector).alias("v"))
    length = common_length(source, "v", parts) or parts
    width = length // parts
    state = written(quantised(source, "v", scale, length, "k", "label"), "kept")
    first = state.select("k", "q").orderBy(F.col("k").asc_nulls_last(), "q").limit(entries).collect()
    books = unpack(pa.array([bytes(r.q) for r in first], pa.binary()), length).reshape(len(first), parts, width).transpose(1, 0, 2).copy()
    entries, groups = len(first), max(1, min(groups, len(first)))
    named = [group_entries(b, groups) if entries else np.zeros(0, np.int64) for b in books]
    sums, counts, drift = np.zeros((parts, entries, width), object), np.zeros((parts, entries), object), np.zeros((parts, groups), np.int64)
    names, kinds = ["k", "label"], [state.schema["k"], state.schema["label"]]

    def step(books: np.ndarray, drift: np.ndarray, last: bool):
        def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                n, fresh = batch.num_rows, "codes" not in batch.schema.names
                x = unpack(batch.column("q"), parts * width).reshape(n, parts, width)
                codes = np.zeros((n, parts), np.int64) if fresh else fixed(batch.column("codes"), "u1", parts).astype(np.int64)
                lower = np.zeros((n, parts, groups), np.int64) if fresh else np.maximum(fixed(batch.column("bounds"), "<u2", parts * groups).astype(np.int64).reshape(n, parts, groups) - drift, 0)
                now, error = codes.copy(), np.zeros(n, np.int64)
                for p in range(parts):
                    now[:, p], least, lower[:, p] = assign_part(x[:, p], books[p], named[p], codes[:, p], lower[:, p])
                    error += least
                own = [*[batch.column(c) for c in names], as_binary(now.astype("u1"))]
                if last:
                    yield pa.RecordBatch.from_arrays([*own, pa.array(error)], names=[*names, "codes", "error"])
                else:
                    before = pa.nulls(n, pa.binary()) if fresh else batch.column("codes")
                    yield pa.RecordBatch.from_arrays([*own, before, as_binary(lower.astype("<u2").reshape(n, -1)), batch.column("q")], names=[*names, "codes", "before", "bounds", "q"])

        return assign

    made = "codes binary, before binary, bounds binary, q binary"
    for _ in range(rounds if entries else 0):
        new = written(state.mapInArrow(step(books, drift, False), StructType([*kinds, *_fields(made)])), "state")
        discard(state)
        state, before = new, books.copy()
        for r in _moves(state, (parts, entries, width)):
            counts[r.part, r.entry] += r.n
            sums[r.part, r.entry] += np.array(r.sums, object)
        for p, e in zip(*np.nonzero(counts)):
            books[p, e] = (sums[p, e] // counts[p, e]).astype(np.int64)
        drift = np.array([_drift(before[p], books[p], named[p], groups) for p in range(parts)])
    coded = written(state.mapInArrow(step(books, drift, True), StructType([*kinds, *_fields("codes binary, error long")])), "coded")
    discard(state)
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    rows = coded.withColumns({"none": F.col("label").isNull(), "name": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    total = F.sum(F.col("error").cast("decimal(38,0)")).try_cast("long")
    table = written(rows.groupBy("none", "name").agg(total.alias("label_error"), F.count("*").alias("n")), "labels")
    found = join_hot(rows, table, ["none", "name"], "n")
    return found.select(F.col("k").alias(key), F.lower(F.hex("codes")).alias("code"), "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _fields(ddl: str) -> list[StructField]:
    return list(StructType.fromDDL(ddl))


def oracle(parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024) -> str:
    """For vectors that all have one length."""
    far = "list_sum(list_transform(list_zip(x.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"
    cut = f"w[CAST(p * len(w) / {parts} AS INT) + 1 : CAST((p + 1) * len(w) / {parts} AS INT)]"
    steps = [
        f"raw AS MATERIALIZED (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor({scale} * CAST(x AS DOUBLE)) AS BIGINT)) AS w FROM embeddings "
        "WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"cut AS MATERIALIZED (SELECT vec_id, label, p, {cut} AS v FROM raw, range({parts}) t(p))",
        f"e0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM cut QUALIFY e < {entries})",
    ]
    for i in range(rounds + 1):
        steps.append(f"a{i} AS MATERIALIZED (SELECT x.vec_id, any_value(x.label) AS label, x.p, any_value(x.v) AS v, min({{'d': CAST({far} AS BIGINT), 'e': e.e}}) AS b FROM cut x JOIN e{i} e USING (p) GROUP BY x.vec_id, x.p)")
        if i < rounds:
            mean = "(s - ((s % n) + n) % n) // n"
            steps.append(
                f"m{i} AS MATERIALIZED (SELECT p, e, list({mean} ORDER BY i) AS v FROM (SELECT p, e, i, CAST(sum(x) AS BIGINT) AS s, count(*) AS n FROM "
                f"(SELECT p, b.e AS e, unnest(v) AS x, generate_subscripts(v, 1) AS i FROM a{i}) GROUP BY p, e, i) GROUP BY p, e)"
            )
            steps.append(f"e{i + 1} AS MATERIALIZED (SELECT e.p, e.e, coalesce(m.v, e.v) AS v FROM e{i} e LEFT JOIN m{i} m USING (p, e))")
    return (
        f"WITH {', '.join(steps)}, coded AS (SELECT vec_id, any_value(label) AS label, string_agg(lower(printf('%02x', b.e)), '' ORDER BY p) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id) "
        "SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, "
        f"(SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY p, e)) FROM e{rounds}) AS codebooks_sha256 FROM coded"
    )
