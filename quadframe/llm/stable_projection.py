"""Nearest neighbours by inner product: stable projections to a few dimensions, a kd-tree over them, and a chi-square test that ends a search."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import FloatType

from .shared import written
from .vectors import as_binary, common_length, finite_rows, fixed, of_length

#: The upper kd-tree is cut by about this many projected rows, and has at most so many cells; larger cells are dealt to several blocks.
SAMPLE, CELLS = 65_536, 4_096
#: A block has about a 64th of the rows, within these bounds; queries of a block come in parts of about so many.
LEAST_ROWS, MOST_ROWS, QUERIES = 4_096, 262_144, 262_144
#: Rows in a leaf of a block's own kd-tree.
LEAF = 64


def chi_square_quantile(p: float, freedom: int) -> float:
    """The value that a chi-square variable stays below with probability ``p`` (Wilson and Hilferty's approximation)."""
    v = 2 / (9 * freedom)
    return freedom * (1 - v + NormalDist().inv_cdf(p) * math.sqrt(v)) ** 3


class Projection:
    """Stable projections in which a squared distance is the true one times a chi-square variable.

    Vectors are divided by the largest length of all and get one more component that makes them as long as 1, and queries are
    divided by their own length; then the squared distance is ``2 - 2 * product / (length * largest)``, so the nearest has the largest product.
    """

    def __init__(self, length: int, dimensions: int, largest: float):
        self.matrix = np.random.default_rng(length).standard_normal((length + 1, dimensions))
        self.dimensions, self.largest = dimensions, largest

    def rows(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(0, 1 - (size / self.largest) ** 2))
        return (x / self.largest) @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, x: np.ndarray, size: np.ndarray) -> np.ndarray:
        return (x / size[:, None]) @ self.matrix[:-1]

    def radius(self, product: np.ndarray, size: np.ndarray, quantile: float) -> np.ndarray:
        """The squared projected distance up to which rows are looked at once ``product`` is found."""
        return quantile * np.maximum(0, 2 - 2 * product / (size * self.largest))


def _sizes(x: np.ndarray) -> np.ndarray:
    """Lengths, without an overflow on the way."""
    most = np.abs(x).max(axis=1, initial=0)
    return np.minimum(most * np.sqrt(((x / np.where(most > 0, most, 1)[:, None]) ** 2).sum(axis=1)), np.finfo(float).max)


def _cuts(z: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Dimension and value of each inner node of a complete kd-tree, its nodes numbered level by level."""
    dims, values, parts = np.zeros((1 << depth) - 1, np.int64), np.zeros((1 << depth) - 1), [z]
    for node in range(len(dims)):
        own = parts[node]
        if len(own):
            dims[node] = np.ptp(own, axis=0).argmax()
            values[node] = np.median(own[:, dims[node]])
        right = own[:, dims[node]] >= values[node]
        parts += [own[~right], own[right]]
        parts[node] = None
    return dims, values


def _cell(z: np.ndarray, cuts: tuple[np.ndarray, np.ndarray], depth: int) -> np.ndarray:
    node = np.zeros(len(z), np.int64)
    for _ in range(depth):
        node = 2 * node + 1 + (z[np.arange(len(z)), cuts[0][node]] >= cuts[1][node])
    return node - (1 << depth) + 1


def _outside(z: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each row to each box."""
    out = np.zeros((len(z), len(low)))
    for d in range(z.shape[1]):
        gap = np.maximum(0, np.maximum(low[:, d] - z[:, d, None], z[:, d, None] - high[:, d]))
        out += gap * gap
    return out


class Block:
    """The rows of a block in the order of the leaves of a kd-tree over their projections."""

    def __init__(self, row: np.ndarray, key: np.ndarray, x: np.ndarray, z: np.ndarray):
        order, spans, todo = np.arange(len(row)), [], [(0, len(row))]
        while todo:
            a, b = todo.pop()
            if b - a <= LEAF:
                spans.append((a, b))
                continue
            own = z[order[a:b]]
            d, half = np.ptp(own, axis=0).argmax(), (b - a) // 2
            order[a:b] = order[a:b][np.argpartition(own[:, d], half)]
            todo += [(a, a + half), (a + half, b)]
        self.row, self.key, self.x, self.z = row[order], key[order], x[order], z[order]
        self.spans = [np.arange(a, b) for a, b in spans if b > a]
        self.low = np.array([self.z[s].min(axis=0) for s in self.spans])
        self.high = np.array([self.z[s].max(axis=0) for s in self.spans])

    def search(self, row: int, x: np.ndarray, z: np.ndarray, outside: np.ndarray, size: float, floor: float, neighbours: int, to: Projection, quantile: float) -> tuple[np.ndarray, np.ndarray]:
        """Places and products of the best rows but the query's own.

        Leaves come by the distance of their box, more at a time each time; a row is verified where its projected distance
        is within the radius, and the search ends where the next box is not.
        """
        order = outside.argsort(kind="stable")
        radius = to.radius(floor, size, quantile) if floor > -math.inf else math.inf
        best, products, at, width = np.zeros(0, np.int64), np.zeros(0), 0, 4
        while at < len(order) and outside[order[at]] <= radius:
            places = np.concatenate([self.spans[i] for i in order[at : at + width]])
            at, width = at + width, width * 2
            gaps = self.z[places] - z
            places = places[(np.einsum("ij,ij->i", gaps, gaps) <= radius) & (self.row[places] != row)]
            best = np.concatenate([best, places])
            products = np.concatenate([products, self.x[places].astype(np.float64) @ x])
            if len(best) > neighbours:
                least = np.partition(products, -neighbours)[-neighbours]
                near = products >= least - abs(least) * 1e-12
                best, products = best[near], products[near]
                radius = min(radius, to.radius(least, size, quantile))
        # the same order of additions for each row, so that equal rows have equal products
        products = (self.x[best].astype(np.float64) * x).sum(axis=1)
        first = np.lexsort((self.row[best], self.key[best], -products))[:neighbours]
        first = first[products[first] >= floor - abs(floor) * 1e-12] if floor > -math.inf else first
        return best[first], products[first]


def nearest(vectors: DataFrame, key: str = "vec_id", vector: str = "embedding", *, query: Callable[[Column], Column] = lambda k: k % 20 == 0, neighbours: int = 20, dimensions: int = 8, confidence: float = 0.93) -> DataFrame:
    """query_id, rank, vec_id and score: for each row that ``query`` takes by its key its nearest other rows by inner product, as found.

    All rows are projected and dealt to the cells of a kd-tree over a bounded sample's projections; a cell of more rows than a block
    is dealt to several blocks, so that very many copies of a vector are no hot spot.  A query is answered in a block of its own cell
    first.  What is found there bounds the squared distance, and the query goes to all blocks whose box is within that bound times the chi-square quantile
    of ``confidence``.  Inside a block, rows come by projected distance and are verified on the original vectors until the next one fails the
    same test with the best found by then.  A neighbour is missed with a probability of at most 1 - ``confidence``, about; the expected recall is at least that.

    Rows whose key or vector is null, whose vector is all zeros, has a null or non-finite component or another length than the most
    frequent one take no part.  A repeated row is a candidate of its own, and a query of its own where its key is taken; only the very row itself is no candidate.
    Ties go to the smaller key.  An empty table gives no rows, and other columns are left behind, whatever their names.
    """
    spark, source = vectors.sparkSession, vectors.select(F.col(key).cast("long").alias("key"), F.col(vector).alias("v")).where(F.col(key).isNotNull())
    length = common_length(source, "v") or 1
    kind = "<f4" if source.schema["v"].dataType.elementType == FloatType() else "<f8"
    source = of_length(source, "v", length, "key")

    def valid(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
        for batch in batches:
            kept, x = finite_rows(batch, "v", length)
            some = (x != 0).any(axis=1)
            yield kept.filter(pa.array(some)), x[some], _sizes(x[some])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, largest = 0, 0.0
        for _, _, size in valid(batches):
            n, largest = n + len(size), max(largest, size.max(initial=0))
        yield pa.RecordBatch.from_pydict({"n": [n], "largest": [float(largest)]})

    n, largest = source.mapInArrow(measure, "n long, largest double").agg(F.sum("n"), F.max("largest")).first()
    to = Projection(length, dimensions, largest or 1.0)
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return spark.createDataFrame([], schema)
    block_rows = min(max(LEAST_ROWS, n // 64), MOST_ROWS)
    depth = max(0, math.ceil(math.log2(min(CELLS, max(1, n / block_rows)))))
    floats = [f"z{i}" for i in range(dimensions)]

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, x, size in valid(batches):
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in to.rows(x, size).T], names=floats)

    share = min(1.0, SAMPLE / n)
    some = source.where(F.pmod(F.xxhash64("key", "v"), F.lit(1 << 20)) < math.ceil(share * (1 << 20)))
    cuts = _cuts(some.mapInArrow(project, ", ".join(f"{c} double" for c in floats)).toPandas().to_numpy(), depth)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kept, x, size in valid(batches):
            z = to.rows(x, size).astype("<f4")
            arrays = [kept.column("row"), kept.column("key"), as_binary(x.astype(kind)), pa.array(size), as_binary(z), pa.array(_cell(z, cuts, depth))]
            yield pa.RecordBatch.from_arrays([*arrays, *[pa.array(c.astype(np.float64)) for c in z.T]], names=["row", "key", "x", "size", "z", "cell", *floats])

    row = "row long, key long, x binary, size double, z binary"
    numbered = source.withColumn("row", F.monotonically_increasing_id())
    placed = written(numbered.mapInArrow(place, f"{row}, cell long, {', '.join(f'{c} double' for c in floats)}"), "placed")
    boxes = placed.groupBy("cell").agg(F.count("*").alias("n"), *[f(c).alias(f"{name}{c}") for name, f in (("low", F.min), ("high", F.max)) for c in floats]).orderBy("cell").toPandas()
    low, high = (boxes[[f"{name}{c}" for c in floats]].to_numpy() for name in ("low", "high"))
    blocks = np.maximum(1, -(-boxes["n"].to_numpy() // block_rows))
    first = np.cumsum(blocks) - blocks
    cells = spark.createDataFrame([*zip(boxes["cell"].tolist(), first.tolist(), blocks.tolist())], "cell long, first long, blocks long")
    asked = placed.where(query(F.col("key"))).select("row", "key", "x", "size", "z")
    chunks = max(1, math.ceil(asked.count() / QUERIES))
    points = placed.join(F.broadcast(cells), "cell").withColumn("block", F.col("first") + F.pmod(F.xxhash64("row"), F.col("blocks")))
    points = points.select("block", F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), F.lit(False).alias("asks"), "row", "key", "x", "size", "z", F.lit(0.0).alias("floor"))
    quantile = chi_square_quantile(confidence, dimensions)

    def aim(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each query with the blocks that it has to see: first one of the nearest cell, then all others within the radius of what it found."""
        for batch in batches:
            x, size = fixed(batch.column("x"), kind, length).astype(np.float64), batch.column("size").to_numpy()
            z = to.queries(x, size)
            outside = _outside(z, low, high)
            if "floor" in batch.schema.names:
                own, floor = batch.column("home").to_numpy(), batch.column("floor").to_numpy()
                found = np.isfinite(floor)
                see = outside <= np.where(found, to.radius(np.where(found, floor, 0), size, quantile), np.inf)[:, None]
                q, c = np.nonzero(see)
                every = np.repeat(q, blocks[c])
                block = np.repeat(first[c] - np.cumsum(blocks[c]) + blocks[c], blocks[c]) + np.arange(len(every))
                new = block != own[every]
                every, block = every[new], block[new]
            else:
                home = outside.argmin(axis=1)
                floor, every, block = np.full(len(x), -np.inf), np.arange(len(x)), first[home] + batch.column("row").to_numpy() % blocks[home]
            q = pa.array(every)
            arrays = [pa.array(block), pa.array(np.full(len(every), True)), *[batch.column(c).take(q) for c in ("row", "key", "x", "size")], as_binary(z[every].astype("<f4")), pa.array(floor[every])]
            yield pa.RecordBatch.from_arrays(arrays, names=["block", "asks", "row", "key", "x", "size", "z", "floor"])

    def meet(queries: DataFrame, last: bool) -> DataFrame:
        """Blocks and their queries side by side: a task reads a block's rows, then one query after the other."""
        sent = queries.mapInArrow(aim, f"block long, asks boolean, {row}, floor double").withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)).cast("int"))
        both = points.unionByName(sent).repartition("block", "chunk").sortWithinPartitions("block", "chunk", "asks")
        return both.mapInArrow(_answers(to, kind, length, neighbours, quantile, last), "row long, key long, found long, found_row long, score double" if last else f"{row}, home long, floor double, best array<struct<found: long, found_row: long, score: double>>")

    bounded = written(meet(asked, False), "bounded")
    own = bounded.select("row", "key", F.inline("best"))
    found = written(own.unionByName(meet(bounded.drop("best"), True)), "found")
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("row").orderBy(F.desc("score"), "found", "found_row")))
    return ranked.where(F.col("rank") <= neighbours).select(F.col("key").alias("query_id"), "rank", F.col("found").alias("vec_id"), "score")


def _answers(to: Projection, kind: str, length: int, neighbours: int, quantile: float, last: bool) -> Callable:
    """What each query finds in the block whose rows come before it; the first time beside the query, with the last one's product as its bound."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, parts, block = None, [], None
        for batch in batches:
            places = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("block", "chunk", "asks")])
            edges = [0, *(np.flatnonzero((places[1:] != places[:-1]).any(axis=1)) + 1).tolist(), len(places)]
            for a, b in zip(edges[:-1], edges[1:]):
                if a == b:
                    continue
                own, (where, asks) = batch.slice(a, b - a), (tuple(places[a, :2]), places[a, 2])
                if where != at:
                    at, parts, block = where, [], None
                ids = [own.column(c).to_numpy() for c in ("row", "key")]
                x, z = fixed(own.column("x"), kind, length), fixed(own.column("z"), "<f4", to.dimensions)
                if not asks:
                    parts.append((*ids, x, z))
                    continue
                if block is None and parts:
                    block, parts = Block(*[np.concatenate(c) for c in zip(*parts)]), []
                yield from _answer(block, own, ids, x.astype(np.float64), z.astype(np.float64))

    def _answer(block: Block | None, own: pa.RecordBatch, ids: list[np.ndarray], x: np.ndarray, z: np.ndarray) -> Iterator[pa.RecordBatch]:
        size, floor, made = own.column("size").to_numpy(), own.column("floor").to_numpy(), []
        none = np.zeros(0, np.int64), np.zeros(0)
        for a in range(0, len(x), 256):
            outside = _outside(z[a : a + 256], block.low, block.high) if block else None
            for i in range(a, min(a + 256, len(x))):
                made.append(block.search(ids[0][i], x[i], z[i], outside[i - a], size[i], floor[i], neighbours, to, quantile) if block else none)
        n = np.array([len(p) for p, _ in made])
        places, scores = np.concatenate([p for p, _ in made]), np.concatenate([s for _, s in made])
        found = {"found": block.key[places] if block else places, "found_row": block.row[places] if block else places, "score": scores}
        if last:
            yield pa.RecordBatch.from_pydict({"row": np.repeat(ids[0], n), "key": np.repeat(ids[1], n), **found})
        else:
            floor = np.array([s[-1] if len(s) == neighbours else -np.inf for _, s in made])
            best = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)].astype(np.int32)), pa.StructArray.from_arrays([*map(pa.array, found.values())], [*found]))
            yield pa.RecordBatch.from_arrays([*[own.column(c) for c in ("row", "key", "x", "size", "z", "block")], pa.array(floor), best], names=["row", "key", "x", "size", "z", "home", "floor", "best"])

    return run
