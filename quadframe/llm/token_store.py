"""Content-addressed store of token ids.

A rolling hash cuts each document's ids into chunks at places that depend on the ids
alone, so passages that documents share become shared chunks.  The store has

``stage/kind=chunk/``  each distinct chunk once: digest, number of ids, payload
``recipes/``           in ascending key order: key, first position, number of ids, root, and the
                       digests and lengths of the document's chunks
``manifests/``         for each recipe file its range of keys, its counts and the Merkle root
                       over the recipes of its documents

A document's root is the node over its chunk digests, so equal documents have equal roots; a recipe's
node is over its key, start, number of ids, root and chunk lengths.  Reading recomputes every
chunk's digest, every document's root and every manifest.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import BASE, INVERSE, encoder, partitions, powers, range_cuts, range_of, slices

DIGEST = 16
#: Window of the rolling hash in ids; least, mean and greatest chunk length in ids.
WINDOW, LEAST, MEAN_BITS, MOST = 8, 32, 7, 1024
#: Documents that are cut in one array pass.
GROUP = 256

def _mix(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(1)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def chunk_ends(ids: np.ndarray, documents: np.ndarray) -> list[list[int]]:
    """Ends of the content-defined chunks of documents that lie one after the other in ``ids``.

    ``documents`` has where each of them ends; the chunk ends are counted from its own start.
    The hash of the last WINDOW ids at each place, or of all since the document's start, is a
    difference of prefix sums (a polynomial in an odd base modulo 2^64), so it costs a few array
    passes.  A chunk ends where the hash's top MEAN_BITS bits are 0, at LEAST ids or later,
    or after MOST ids.
    """
    starts = np.r_[0, documents[:-1]].astype(np.int64)
    n = len(ids)
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_mix(ids) * powers(INVERSE, n), out=sums[1:])
    place = np.arange(n)
    window = sums[1:] - sums[np.maximum(place + 1 - WINDOW, np.repeat(starts, documents - starts))]
    window *= powers(BASE, n)
    window = _mix(window)
    candidates = np.flatnonzero(window >> np.uint64(64 - MEAN_BITS) == 0) + 1
    cuts = np.searchsorted(candidates, np.stack([starts, documents]), side="right")
    places, found = candidates.tolist(), []
    for start, end, a, b in zip(starts.tolist(), documents.tolist(), *cuts.tolist()):
        ends, last = [], start
        for p in [*places[a:b], end]:
            while p - last > MOST:
                last += MOST
                ends.append(last - start)
            if p - last >= LEAST or p == end > last:
                ends.append(p - start)
                last = p
        found.append(ends)
    return found


def digest(data: bytes) -> bytes:
    return hashlib.blake2b(data, digest_size=DIGEST).digest()


class Merkle:
    """Merkle root of a stream of digests, with one pending node per level."""

    def __init__(self):
        self.levels: list[bytes | None] = []

    def add(self, node: bytes) -> None:
        for i, other in enumerate(self.levels):
            if other is None:
                self.levels[i] = node
                return
            node, self.levels[i] = digest(b"\1" + other + node), None
        self.levels.append(node)

    def root(self) -> bytes:
        top = b""
        for node in self.levels:
            if node is not None:
                top = digest(b"\1" + node + top) if top else node
        return top or digest(b"\0")


def document_root(digests: bytes) -> bytes:
    """The node over a document's chunks: the digest of their digests."""
    return digest(b"\2" + digests)


# ---------------------------------------------------------------- CRC-32 of joined parts
# Fixed value: the reversed polynomial of CRC-32.
_POLYNOMIAL = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the CRC polynomial, bit 31 being x^0."""
    out = 0
    for bit in range(31, -1, -1):
        out ^= b if a >> bit & 1 else 0
        b = b >> 1 ^ (_POLYNOMIAL if b & 1 else 0)
    return out


@functools.cache
def _power(k: int) -> int:
    """x^(8 * 2^k) modulo the CRC polynomial."""
    return _times(_power(k - 1), _power(k - 1)) if k else 1 << 23


@functools.cache
def _moved(k: int) -> np.ndarray:
    """What each value of each byte of a CRC-32 becomes 2^k bytes further on; the four shares meet by exclusive or."""
    table = np.zeros((4, 256), np.uint32)
    for byte in range(4):
        for bit in range(8):
            table[byte, 1 << bit : 2 << bit] = table[byte, : 1 << bit] ^ np.uint32(_times(1 << 8 * byte + bit, _power(k)))
    return table


def crc_terms(crc: np.ndarray, rest: np.ndarray) -> np.ndarray:
    """What a part contributes to the CRC-32 of a whole, ``rest`` bytes before its end:
    the whole's CRC-32 is the exclusive or of its parts' terms."""
    out, left = crc.astype(np.uint32), rest.astype(np.uint64)
    for k in range(int(left.max(initial=0)).bit_length()):
        odd = np.flatnonzero(left >> np.uint64(k) & np.uint64(1))
        own, table = out[odd], _moved(k)
        out[odd] = table[0, own & 255] ^ table[1, own >> 8 & 255] ^ table[2, own >> 16 & 255] ^ table[3, own >> 24]
    return out.astype(np.int64)


# ---------------------------------------------------------------- write
def write_store(df: DataFrame, path: str, tokenizer: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0) -> None:
    """Encode ``df`` and write the store to ``path`` (a new folder that all executors share).

    ``key`` is an integer; rows without one are left out, as nothing could name them, and rows that share one are
    documents of their own, in any order.  A null text is an empty one, and each document ends with ``end_id``.  The texts are encoded once: one shuffle carries chunks by digest,
    each input partition keeping one copy of a chunk, and recipes by key.
    An empty table gives empty files.
    """
    spark = df.sparkSession
    schema = "kind string, id binary, n int, root binary, payload binary, lengths array<int>"

    def cut(batches):
        coder, task, row = encoder(tokenizer), TaskContext.get().partitionId(), 0
        end = np.array([end_id], coder.dtype)
        width = end.itemsize
        seen: set[bytes] = set()
        for batch in slices(batches):
            keys = iter(batch.column(0).to_pylist())
            own = coder.encode_all(batch.column(1).to_pylist())
            while part := [*itertools.islice(own, GROUP)]:
                ids = np.concatenate([x for one in part for x in (one, end)])
                documents = np.cumsum([len(x) + 1 for x in part])
                data, at = ids.tobytes(), 0
                chunks, recipes, lengths = [], [], []
                for stop, ends, k in zip(documents.tolist(), chunk_ends(ids, documents), keys):
                    digests, last = [], 0
                    for e in ends:
                        piece = data[(at + last) * width : (at + e) * width]
                        digests.append(d := digest(piece))
                        if d not in seen:
                            seen.add(d)
                            chunks.append((d, e - last, piece))
                        lengths.append(e - last)
                        last = e
                    joined = b"".join(digests)
                    recipes.append((int(k).to_bytes(8, "big", signed=True) + b"%d.%d" % (task, row), stop - at, document_root(joined), joined, len(digests)))
                    at, row = stop, row + 1
                if len(seen) > 200_000:
                    seen.clear()
                if chunks:
                    d, n, piece = zip(*chunks)
                    none = pa.nulls(len(d), pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(["chunk"]).take(pa.array(np.zeros(len(d), np.int8))), pa.array(d, pa.binary()), pa.array(n, pa.int32()), none, pa.array(piece, pa.binary()), pa.nulls(len(d), pa.list_(pa.int32()))], names)
                d, n, root, joined, counts = zip(*recipes)
                lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *counts]), pa.int32()), pa.array(lengths, pa.int32()))
                yield pa.RecordBatch.from_arrays([pa.array(["recipe"] * len(d)), pa.array(d, pa.binary()), pa.array(n, pa.int32()), pa.array(root, pa.binary()), pa.array(joined, pa.binary()), lists], names)

    names = ["kind", "id", "n", "root", "payload", "lengths"]
    rows = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("k"), F.col(text).cast("string").alias("t")).mapInArrow(cut, schema)
    # each task emits a chunk once, so rows go straight to the task of their digest
    rows = rows.repartition(partitions(spark), "kind", "id")
    once = rows.groupBy("kind", "id").agg(*[F.first(c).alias(c) for c in ("n", "root", "payload", "lengths")])
    once.write.partitionBy("kind").option("compression", "snappy").parquet(f"{path}/stage")
    stage = spark.read.schema(schema).parquet(f"{path}/stage")
    # The chunks lie where they were written; only the recipes are brought into key order.
    recipes = stage.where("kind = 'recipe'").select(F.conv(F.hex(F.substring("id", 1, 8)), 16, -10).cast("long").alias(key), F.col("n").cast("long").alias("n_tokens"), "root", F.col("payload").alias("digests"), "lengths")
    light = spark.read.schema(schema).parquet(f"{path}/stage").where("kind = 'recipe'").select(F.conv(F.hex(F.substring("id", 1, 8)), 16, -10).cast("long").alias(key), F.col("n").cast("long").alias("n_tokens"))
    parts = partitions(spark)
    cuts = range_cuts(light, key, parts)
    sums = {r["g"]: r["n"] for r in light.groupBy(range_of(F.col(key), cuts).alias("g")).agg(F.sum("n_tokens").alias("n")).collect()}
    first = np.cumsum([0] + [sums.get(i) or 0 for i in range(len(cuts) + 1)]).tolist()
    fields = [key, "start", "n_tokens", "root", "digests", "lengths", "file"]

    def run_on(batches):
        start = None
        for b in batches:
            if start is None:
                start = first[b.column(5)[0].as_py()] if b.num_rows else None
            if not b.num_rows:
                continue
            n = b.column(1).to_numpy()
            starts = start + np.cumsum(n) - n
            start = int(starts[-1] + n[-1])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(starts), *b.columns[1:]], fields)

    ordered = recipes.withColumn("file", range_of(F.col(key), cuts)).repartitionById(len(cuts) + 1, F.col("file")).sortWithinPartitions(key)
    ordered.mapInArrow(run_on, f"{key} long, start long, n_tokens long, root binary, digests binary, lengths array<int>, file int").write.option("compression", "zstd").parquet(f"{path}/recipes")

    _manifests(read_recipes(spark, path, key=key), key).write.parquet(f"{path}/manifests")


MANIFEST = "file int, first_key long, last_key long, documents long, tokens long, root binary"


def recipe_node(fixed: bytes, root: bytes, lengths: bytes) -> bytes:
    """The node over a recipe: key, start and number of ids as 64-bit integers, the document's root, its chunk lengths as 32-bit ones."""
    return digest(b"\3" + fixed + root + lengths)


def _manifests(recipes: DataFrame, key: str) -> DataFrame:
    """One row per recipe file, from its recipes in order of key and start."""

    def manifest(batches):
        def row():
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((file, keys[0], keys[-1], docs, tokens, tree.root()), types)], names)

        tree, docs, tokens, keys, file = Merkle(), 0, 0, [], None
        for b in batches:
            fixed = np.stack([b.column(i).to_numpy(zero_copy_only=False) for i in range(3)], axis=1).astype("<i8")
            places, lengths = b.column(5).offsets.to_pylist(), b.column(5).values.to_numpy(zero_copy_only=False).astype("<i4")
            for i, (k, n, root, f) in enumerate(zip(*(b.column(i).to_pylist() for i in (0, 2, 3, 4)))):
                if f != file and docs:
                    yield row()
                    tree, docs, tokens, keys = Merkle(), 0, 0, []
                file = f
                tree.add(recipe_node(fixed[i].tobytes(), root, lengths[places[i] : places[i + 1]].tobytes()))
                docs, tokens, keys = docs + 1, tokens + n, [*keys[:1], k]
        if docs:
            yield row()

    names, types = ["file", "first_key", "last_key", "documents", "tokens", "root"], (pa.int32(), *[pa.int64()] * 4, pa.binary())
    parts = partitions(recipes.sparkSession)
    dealt = recipes.select(key, "start", "n_tokens", "root", "file", "lengths").repartitionById(parts, F.pmod("file", F.lit(parts)))
    return dealt.sortWithinPartitions("file", key, "start").mapInArrow(manifest, MANIFEST)


# ---------------------------------------------------------------- read
def read_recipes(spark: SparkSession, path: str, *, key: str = "doc_id") -> DataFrame:
    return spark.read.schema(f"{key} long, start long, n_tokens long, root binary, digests binary, lengths array<int>, file int").parquet(f"{path}/recipes")


def read_manifests(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifests")


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("kind string, id binary, n int, payload binary").parquet(f"{path}/stage").where("kind = 'chunk'").select(F.col("id").alias("digest"), "n", "payload")


def check_manifests(spark: SparkSession, path: str, *, key: str = "doc_id") -> None:
    """Make the manifests again from the recipes, and raise where they are not those of the store."""
    made, stored = _manifests(read_recipes(spark, path, key=key), key), read_manifests(spark, path)
    both = made.withColumn("side", F.lit(1)).unionByName(stored.withColumn("side", F.lit(-1)))
    wrong = both.groupBy(*made.columns).agg(F.sum("side").alias("side")).where("side <> 0").agg(F.min("file").alias("file"), F.count("*").alias("n")).first()
    if wrong["n"]:
        raise ValueError(f"recipes and manifests differ, first for recipe file {wrong['file']}")


def _entries(recipes: DataFrame) -> DataFrame:
    """One row per chunk of a document: its start as k, the digest, the ids after it; recipes whose root fails raise."""

    def entries(batches):
        for b in slices(batches, 2000):
            digests = []
            for k, root, joined in zip(*(b.column(i).to_pylist() for i in range(3))):
                if document_root(joined) != root:
                    raise ValueError(f"the recipe of the document at {k} does not match its root")
                digests += [joined[i : i + DIGEST] for i in range(0, len(joined), DIGEST)]
            parts = b.column(3).value_lengths().to_numpy()
            lengths = b.column(3).flatten().to_numpy().astype(np.int64)
            ends, last = np.cumsum(lengths), np.cumsum(parts) - 1
            rest = np.repeat(ends[last], parts) - ends
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), parts)), pa.array(digests, pa.binary()), pa.array(rest), pa.array(np.repeat(parts, parts).astype(np.int32))], ["k", "digest", "rest", "parts"])

    return recipes.select("start", "root", "digests", "lengths").mapInArrow(entries, "k long, digest binary, rest long, parts int")


def read_documents(spark: SparkSession, path: str, *, key: str = "doc_id") -> DataFrame:
    """key, start, ids array<int>: every document put together again from its chunks; wrong or lost recipes raise here."""
    check_manifests(spark, path, key=key)
    recipes = read_recipes(spark, path, key=key)
    joined = _entries(recipes).join(read_chunks(spark, path), "digest")

    def build(batches):
        for b in batches:
            ids = []
            for parts in b.column(1).to_pylist():
                data = []
                for part in sorted(parts, key=lambda x: -x["rest"]):
                    if digest(part["payload"]) != part["digest"]:
                        raise ValueError("a chunk does not match its digest")
                    data.append(np.frombuffer(part["payload"], f"<u{len(part['payload']) // part['n']}").astype("<i4"))
                ids.append(np.concatenate(data))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(ids, pa.list_(pa.int32()))], ["start", "ids"])

    grouped = joined.groupBy(F.col("k").alias("start")).agg(F.collect_list(F.struct("rest", "digest", "n", "payload")).alias("parts"))
    return recipes.select(key, "start").join(grouped.mapInArrow(build, "start long, ids array<int>"), "start").select(key, "start", "ids")


def checked_documents(spark: SparkSession, path: str, *, key: str = "doc_id") -> DataFrame:
    """Read all files back and check them: key, start, n_tokens, root, ids_crc32.

    Every chunk is read once and its digest recomputed.  Its CRC-32, moved by the number of
    bytes that follow in a document, is its share of that document's CRC-32; the shares meet
    by exclusive or, so documents are checked without moving the ids again.  Missing chunks raise; recipes that are
    not those of the manifests raise before anything is returned.
    """
    check_manifests(spark, path, key=key)

    def summaries(batches):
        for b in slices(batches, 5000):
            # the column's bytes lie in one buffer, so ids are widened without a copy per chunk
            column = b.column(2)
            place = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
            data = memoryview(column.buffers()[2])[place[0] : place[-1]]
            ends, counts, crcs, at = (place[1:] - place[0]).tolist(), b.column(1).to_pylist(), [], 0
            width = ends[0] // counts[0]
            wide = memoryview(np.frombuffer(data, f"<u{width}").astype("<u4").tobytes())
            for d, end in zip(b.column(0).to_pylist(), ends):
                if digest(data[at:end]) != d:
                    raise ValueError("a chunk does not match its digest")
                crcs.append(zlib.crc32(wide[at * 4 // width : end * 4 // width]))
                at = end
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(crcs, pa.int64())], ["digest", "n", "crc"])

    def shares(batches):
        for b in batches:
            term = crc_terms(b.column(3).to_numpy(), 4 * b.column(1).to_numpy())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(4), pa.array(term)], ["k", "n", "parts", "term"])

    recipes = read_recipes(spark, path, key=key)
    chunks = read_chunks(spark, path).mapInArrow(summaries, "digest binary, n int, crc long")
    joined = _entries(recipes).join(chunks, "digest").select("k", "rest", "n", "crc", "parts")
    terms = joined.mapInArrow(shares, "k long, n int, parts int, term long")
    found = terms.groupBy("k").agg(F.bit_xor("term").alias("ids_crc32"), F.sum("n").alias("ids"), F.count("*").alias("parts_found"), F.max("parts").alias("parts"))
    whole = F.when((F.col("ids") == F.col("n_tokens")) & (F.col("parts_found") == F.col("parts")), F.col("ids_crc32")).otherwise(F.raise_error(F.concat(F.lit("chunks are missing of document "), F.col(key).cast("string"))).cast("long"))
    return recipes.select(key, "start", "n_tokens", "root").join(found, F.col("start") == F.col("k"), "left").select(key, "start", "n_tokens", F.hex("root").alias("root"), whole.alias("ids_crc32"))
