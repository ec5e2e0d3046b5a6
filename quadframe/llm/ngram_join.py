"""Exact Jaccard join of word n-grams by grouped prefixes, down to components of linked documents.

The shingles of all documents have one order: rare ones by hash, then frequent ones by ascending count.
Two sets of a likeness of at least ``threshold`` share a shingle among the first
n - ceil(threshold n) + 1 of each (the prefix).

1. Equal sets are one node.  Nodes of one prefix and size are one group.
2. Groups post their prefix once; postings of one shingle, cut where sizes get too far apart, make a list.
3. Lists are expanded to nodes; of lists of the same nodes one stays.  Each node is paired with its list's pivot; parity bitmaps rule
   out most pairs with certainty, and the texts of the rest are compared.  Links give components.
4. Only pairs of a list that are not yet in one component can add something.  Nodes apart from their
   pivot's component are paired with a new pivot, another one in each list, some rounds long, then, in blocks, with every
   other node that is still apart; a pair that many lists have is met in one of them.

So a group of near copies costs pairs in proportion to its nodes, yet no link between
components is lost: what is left out would join documents that are already joined.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BASE, discard, join_hot, mixed, partitions, run_hashes, slices, written

WORDS, NUMERATOR, DENOMINATOR = 5, 75, 100
#: Counted from so many times within a task, frequent from so many in all; bound of the table of frequent shingles.
SEEN, FREQUENT, TABLE = 2, 16, 1_000_000
#: Shingles that a task counts at a time; bytes of text in one array pass; rounds of pivots; nodes that are broadcast at most.
COUNTED, GROUP_BYTES, ROUNDS, BROADCAST = 2_000_000, 1_000_000, 3, 500_000
#: Nodes in a block of a list, about; nodes of a list that is not dealt to blocks, at most.
BLOCK, SMALL = 256, 24
#: Parts that the postings of a frequent shingle, and the nodes that meet one pivot, are dealt to.
SALTS, PARTS = 64, 256


# ---------------------------------------------------------------- sets
def _group_sets(texts: list[bytes], n: int) -> list[np.ndarray]:
    data = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    data = np.where((data >= 65) & (data <= 90), data + np.uint8(32), data)
    space = (data == 32) | ((data >= 9) & (data <= 13))
    before = np.r_[True, space[:-1]]
    starts, ends = np.flatnonzero(~space & before), np.flatnonzero(space & ~before)
    word = mixed(run_hashes(data, starts, ends)[0])
    if len(word) >= n:
        shingle = np.zeros(len(word) - n + 1, np.uint64)
        for j in range(n):
            shingle = shingle * np.uint64(BASE) + word[j : len(shingle) + j]
        shingle = mixed(shingle)
    gaps = np.cumsum([len(x) + 1 for x in texts])
    last = np.searchsorted(starts, gaps).tolist()
    out, first = [], 0
    for stop in last:
        if stop - first >= n:
            out.append(np.unique(shingle[first : stop - n + 1]))
        elif stop > first:
            whole = np.uint64(stop - first)
            for w in word[first:stop]:
                whole = mixed(np.array([whole * np.uint64(BASE) + w], np.uint64))[0]
            out.append(np.array([whole], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
        first = stop
    return out


def shingle_sets(texts: list[bytes | None], n: int = WORDS) -> Iterator[np.ndarray]:
    """Sorted distinct 64-bit hashes of the word n-grams of UTF-8 texts, A-Z in lower case.

    With fewer than ``n`` words the whole sequence is one n-gram; without words there is none.
    """
    group, size = [], 0
    with np.errstate(over="ignore"):
        for x in texts:
            group.append(x or b"")
            size += len(group[-1])
            if size >= GROUP_BYTES:
                yield from _group_sets(group, n)
                group, size = [], 0
        if group:
            yield from _group_sets(group, n)


def likeness_links(a: Column, b: Column, words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> Column:
    """Whether two texts link, by the rule of ``link_documents`` in one expression, for pairs that are known beforehand."""

    def shingles(text: Column) -> Column:
        lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
        found = F.filter(F.split(F.coalesce(lower, F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")
        # the array of words is made once, as an array of one that is taken apart again
        every = lambda w: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - words + 1, F.lit(1))), lambda i: F.xxhash64(F.slice(w, i, words))))
        return F.element_at(F.transform(F.array(found), lambda w: F.when(F.size(w) > 0, every(w)).otherwise(F.array().cast("array<bigint>"))), 1)

    def enough(x: Column) -> Column:
        shared = F.size(F.array_intersect(x["a"], x["b"]))
        return (shared > 0) & (den * shared >= num * (F.size(x["a"]) + F.size(x["b"]) - shared))

    return F.element_at(F.transform(F.array(F.struct(shingles(a).alias("a"), shingles(b).alias("b"))), enough), 1)


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1 if n else 0


def parity_bits(shingles: np.ndarray) -> bytes:
    """A bitmap of a power of two of bits, each the parity of the shingles it stands for: 4 to 8 per shingle up to 256 in all, beyond that 1 to 2.

    Bits that differ between two bitmaps need a shingle each that only one set has, so their number is at most that of
    such shingles; the longer bitmap folds onto the shorter.  Of sets with nothing in common about half of the bits differ, and
    a link allows for 2/7 of the shingles' number, so long sets are told apart by few bits per shingle.
    """
    bits = 1 << max(3, min(8, (4 * len(shingles) - 1).bit_length()), (len(shingles) - 1).bit_length())
    counts = np.bincount((shingles & np.uint64(bits - 1)).astype(np.int64), minlength=bits)
    return np.packbits((counts & 1).astype(np.uint8), bitorder="little").tobytes()


def differing_bits(a: bytes, b: bytes) -> int:
    if len(a) < len(b):
        a, b = b, a
    x = int.from_bytes(a, "little")
    size = len(a) * 8
    while size > len(b) * 8:
        size //= 2
        x = (x >> size) ^ (x & ((1 << size) - 1))
    return (x ^ int.from_bytes(b, "little")).bit_count()


# ---------------------------------------------------------------- components
def components(edges: DataFrame) -> DataFrame:
    """node, component (smallest node it is connected to) of the nodes of ``edges`` (a, b).

    Each round takes the smallest label of the neighbours and then the label of that label, so
    the rounds grow with the logarithm of a component's width; the driver sees one sum per round.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = written(both.unionByName(both.select("a", F.col("a").alias("b"))).distinct(), "edges")
    labels, total = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")), None
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("c"))
        jump = near.select(F.col("a").alias("t"), F.col("c").alias("component"))
        before, labels = labels, written(near.join(jump, F.col("c") == F.col("t")).select(F.col("a").alias("node"), "component"), "labels")
        now = labels.agg(F.sum(F.col("component").cast("decimal(38,0)"))).first()[0]
        if total is not None:
            discard(before)
        if now == total:
            discard(both)
            return labels
        total = now


def _grown(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """The components after more links: only the components that these touch are looked at again."""
    if labels is None:
        return components(links)
    of = lambda x: _named(labels, x, f"c_{x}")
    ends = links.join(of("a"), "a", "left").join(of("b"), "b", "left").select(F.coalesce("c_a", "a").alias("a"), F.coalesce("c_b", "b").alias("b"))
    merged = components(ends)
    fresh = links.select(F.col("a").alias("node")).unionByName(links.select(F.col("b").alias("node"))).distinct().join(labels, "node", "left_anti")
    every = labels.unionByName(fresh.select("node", F.col("node").alias("component")))
    out = written(every.join(_named(merged, "component", "now"), "component", "left").select("node", F.coalesce("now", "component").alias("component")), "labels")
    discard(labels, merged)
    return out


def _named(labels: DataFrame, node: str, component: str) -> DataFrame:
    return labels.select(F.col("node").alias(node), F.col("component").alias(component))


# ---------------------------------------------------------------- the join
def frequent_shingles(docs: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The most frequent shingles, sorted by hash, and their ranks by ascending count.

    Every document is counted.  A task sums its own counts and passes on shingles it met ``SEEN`` times; at most
    TABLE of them come to the driver.  They only order shingles, so a count that stays below what it should be costs time, not links.
    """

    def count(batches):
        held, size = [], 0

        def flush():
            nonlocal held, size
            every = np.sort(np.concatenate(held))
            first = np.flatnonzero(np.r_[True, every[1:] != every[:-1]])
            times = np.diff(np.r_[first, len(every)])
            often = times >= SEEN
            held, size = [], 0
            return pa.RecordBatch.from_arrays([pa.array(every[first[often]].view(np.int64)), pa.array(times[often].astype(np.int64))], ["s", "n"])

        known: set[bytes] = set()
        for b in slices(batches, 1000):
            for one in shingle_sets(b.column(0).to_pylist(), n):
                mark = hashlib.blake2b(one.tobytes(), digest_size=8).digest()
                if len(one) and mark not in known:
                    known.add(mark)
                    held.append(one)
                    size += len(one)
                    if size >= COUNTED:
                        known.clear()
                        yield flush()
        if held:
            yield flush()

    counts = docs.select("data").mapInArrow(count, "s long, n long").groupBy("s").agg(F.sum("n").alias("n")).where(F.col("n") >= FREQUENT)
    table = counts.orderBy(F.desc("n"), "s").limit(TABLE).toArrow()
    s, times = (np.array(table.column(i)) for i in range(2))
    s = s.view(np.uint64)
    rank = np.empty(len(s), np.int64)
    rank[np.lexsort((s, times))] = np.arange(len(s))
    order = np.argsort(s)
    return s[order], rank[order]


def ordered_prefix(shingles: np.ndarray, frequent: np.ndarray, rank: np.ndarray, num: int, den: int) -> tuple[np.ndarray, int]:
    """The prefix of a sorted set in the common order, and how many rare shingles come first in it."""
    length = prefix_length(len(shingles), num, den)
    if len(frequent) and len(shingles):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        often = frequent[at] == shingles
        if often.any():
            rare = shingles[~often][:length]
            rest = shingles[often][np.argsort(rank[at[often]])][: length - len(rare)]
            return np.r_[rare, rest], len(rare)
    return shingles[:length], length


def _signatures(docs: DataFrame, n: int, num: int, den: int) -> DataFrame:
    """One row per document: doc, n, sid (digest of its set), gid (of prefix and size), and where a task meets a gid or sid first, prefix and bits."""
    frequent, rank = frequent_shingles(docs, n)

    def sign(batches):
        groups: set[bytes] = set()
        nodes: set[bytes] = set()
        for b in slices(batches, 1000):
            rows = []
            for doc, one in zip(b.column(0).to_pylist(), shingle_sets(b.column(1).to_pylist(), n)):
                # a row without a key is no node, and must not take the place of one
                if doc is None or not len(one):
                    rows.append((doc, len(one), None, None, None, None, None))
                    continue
                sid = hashlib.blake2b(one.tobytes(), digest_size=16).digest()
                prefix, rare = ordered_prefix(one, frequent, rank, num, den)
                group = hashlib.blake2b(prefix.tobytes() + len(one).to_bytes(8, "little"), digest_size=16).digest()
                # two groups that met in half of their digest would both post under it: more candidates, none lost
                gid = int.from_bytes(group[:8], "little", signed=True)
                new = group not in groups
                groups.add(group)
                bits = None if sid in nodes else parity_bits(one)
                nodes.add(sid)
                rows.append((doc, len(one), sid, gid, prefix.view(np.int64) if new else None, rare if new else None, bits))
            types = (b.column(0).type, pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.int32(), pa.binary())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows), types)], names)

    names = ["doc", "n", "sid", "gid", "prefix", "rare", "bits"]
    kind = docs.schema["doc"].dataType.simpleString()
    return written(docs.select("doc", "data").mapInArrow(sign, f"doc {kind}, n long, sid binary, gid long, prefix array<long>, rare int, bits binary"), "signatures")


def _lists(signed: DataFrame, num: int, den: int) -> DataFrame:
    """list, gid, early: groups that share a shingle of their prefixes and have sizes that allow a link; ``early``
    where the shingle is in the shorter prefix.  Lists without an early group are left out."""
    posted = signed.where("prefix IS NOT NULL").select("gid", "n", "rare", F.posexplode("prefix").alias("at", "s"))
    salt = F.when(F.col("at") >= F.col("rare"), F.pmod("gid", F.lit(SALTS))).otherwise(F.lit(-1)).cast("int")
    # of two sets that link, the smaller one has a common shingle in this shorter prefix
    early = F.col("at") < F.col("n") - F.ceil(2 * num * F.col("n") / (num + den)) + 1
    dealt = posted.select("s", "gid", F.col("n").cast("int").alias("n"), salt.alias("salt"), early.cast("int").alias("early")).repartition(partitions(signed.sparkSession), "s", "salt").sortWithinPartitions("s", "salt", "n", "gid")

    def runs(batches):
        tail = None
        for b in batches:
            now = [b.column(i).to_numpy() for i in range(5)]
            if tail is not None:
                now = [np.r_[x, y] for x, y in zip(tail, now)]
            s, salt_ = now[0], now[3]
            # the last run may go on in the next batch
            cut = len(s) - int((((s == s[-1]) & (salt_ == salt_[-1]))[::-1].argmin()) or len(s)) if len(s) else 0
            tail = [x[cut:] for x in now]
            if cut:
                yield found([x[:cut] for x in now])
        if tail is not None and len(tail[0]):
            yield found(tail)

    def found(columns):
        s, gid, n, salt_, early = columns
        fresh = np.r_[True, (s[1:] != s[:-1]) | (gid[1:] != gid[:-1]) | (salt_[1:] != salt_[:-1]) | (n[1:] != n[:-1])]
        s, gid, n, salt_, early = (x[fresh] for x in columns)
        same = np.r_[False, (s[1:] == s[:-1]) & (salt_[1:] == salt_[:-1]) & (den * n[:-1].astype(np.int64) >= num * n[1:].astype(np.int64))]
        keep = same | np.r_[same[1:], False] | (salt_ >= 0)
        # a list of a rare shingle is a chain of sizes without a gap; its name tells where it starts
        chain = np.flatnonzero(~same)
        if len(chain):
            keep &= (salt_ >= 0) | (np.maximum.reduceat(early, chain)[np.cumsum(~same) - 1] > 0)
        head = n[chain[np.cumsum(~same) - 1]].astype(np.uint64) if len(n) else n.astype(np.uint64)
        name = np.where(salt_ >= 0, s.view(np.uint64), mixed(s.view(np.uint64) + head * np.uint64(BASE)))
        return pa.RecordBatch.from_arrays([pa.array(name[keep].view(np.int64)), pa.array(gid[keep]), pa.array(early[keep].astype(np.int32))], ["list", "gid", "early"])

    rows = written(dealt.mapInArrow(runs, "list long, gid long, early int"), "posted")
    useful = rows.groupBy("list").agg(F.max("early").alias("early"), F.min("gid").alias("low"), F.max("gid").alias("high")).where("early = 1 AND low <> high").select("list")
    return rows.join(useful, "list", "left_semi").groupBy("list", "gid").agg(F.max("early").alias("early"))


def _near(pairs: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) that sizes and bitmaps allow to link."""
    side = lambda x: nodes.select(F.col("node").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").where((den * F.least("n_a", "n_b") >= num * F.greatest("n_a", "n_b")))

    def allowed(batches):
        for b in slices(batches, 5000):
            a, c, na, nb, x, y = (b.column(i).to_pylist() for i in range(6))
            # |a - b| + |b - a| is at most (den - num) / (den + num) of the two sizes' sum for a link
            keep = [(den + num) * differing_bits(p, q) <= (den - num) * (m + k) for m, k, p, q in zip(na, nb, x, y)]
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return both.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(allowed, pairs.select("a", "b").schema)


def _links(pairs: DataFrame, docs: DataFrame, n: int, num: int, den: int) -> DataFrame | None:
    """The pairs whose texts link, None for no pairs: whole texts, only of the nodes that occur in a pair.

    A node that many meet is dealt to PARTS; its text goes to each of them once, and the texts that it meets follow it there.
    """
    pairs = written(pairs, "pairs")
    ids = pairs.select(F.col("a").alias("doc")).unionByName(pairs.select(F.col("b").alias("doc"))).distinct()
    ids = written(ids, "ids")
    found = ids.count()
    if not found:
        return None
    texts = written(docs.join(F.broadcast(ids) if found <= BROADCAST else ids, "doc").select("doc", "data"), "texts")
    dealt = pairs.select("a", F.pmod(F.xxhash64("b"), F.lit(PARTS)).cast("int").alias("part"), "b")
    heads = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("doc", "a"), "a").select("a", "part", F.lit(None).cast(dict(pairs.dtypes)["b"]).alias("b"), "data")
    others = dealt.join(texts.withColumnRenamed("doc", "b"), "b").select("a", "part", "b", "data")
    met = heads.unionByName(others).repartition(partitions(pairs.sparkSession), "a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first()).select("a", "b", "data")

    def compare(batches):
        head = None
        for batch in slices(batches, 1000):
            linked = []
            for b, x in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                one = next(shingle_sets([x], n))
                if b is None:
                    head = one
                    linked.append(False)
                    continue
                common = len(np.intersect1d(head, one, assume_unique=True))
                linked.append(common > 0 and den * common >= num * (len(head) + len(one) - common))
            yield batch.select(["a", "b"]).filter(pa.array(linked, pa.bool_()))

    links = written(met.mapInArrow(compare, pairs.schema), "links")
    discard(pairs, ids, texts)
    return links


def link_documents(df: DataFrame, *, key: str = "doc_id", text: str = "text", words: int = WORDS, num: int = NUMERATOR, den: int = DENOMINATOR) -> DataFrame:
    """key, n_shingles, component_id of every row of ``df``.

    Two documents link when den * |a & b| >= num * |a | b| for their sets of word n-grams; component_id is the smallest
    key reachable by links, the own one included.  Null texts and texts without words have no shingles and
    link with nothing.  ``key`` is an integer that no two rows share; rows without one have no component_id.
    An empty table gives no rows.
    """
    docs = df.select(F.col(key).alias("doc"), F.col(text).cast("string").cast("binary").alias("data"))
    signed = _signatures(docs, words, num, den)
    sets = signed.where("sid IS NOT NULL AND doc IS NOT NULL")
    nodes = written(sets.groupBy("sid").agg(F.min("doc").alias("node"), F.max("n").alias("n"), F.max("gid").alias("gid"), F.max("bits").alias("bits")), "nodes")

    # lists of nodes: the nodes of the groups of each list, and the nodes of each group
    members = nodes.select("gid", "node")
    shared = members.join(members.groupBy("gid").agg(F.count("*").alias("k")).where("k > 1").select("gid"), "gid").select(F.col("gid").alias("list"), "node")
    listed = _lists(signed.where("doc IS NOT NULL"), num, den).join(members, "gid").select("list", "node")
    every = written(listed.unionByName(shared), "lists")
    # near copies share many shingles: of lists of the same nodes, known by 128 bits, one is enough
    alike = every.groupBy("list").agg(F.count("*").alias("k"), F.bit_xor(F.xxhash64("node")).alias("x"), F.bit_xor(F.xxhash64(F.lit(7), "node")).alias("y"))
    lists = written(every.join(alike.groupBy("k", "x", "y").agg(F.min("list").alias("list")).select("list"), "list", "left_semi"), "lists")
    discard(every)

    tried, labels, apart = [], None, lists
    for turn in range(ROUNDS):
        # every node of a list that is apart from the pivots so far meets the list's next pivot; after the first round lists
        # that share nodes have pivots of their own, so that a group of near copies is met from many sides at once
        pivot = F.min_by("node", F.xxhash64("list", "node")) if turn else F.min("node")
        pivots = apart.groupBy("list").agg(pivot.alias("pivot"), F.min("node").alias("low"), F.max("node").alias("top"), F.count("*").alias("k")).where("low <> top").select("list", "pivot", "k")
        stars = written(join_hot(apart, written(pivots, "pivots"), ["list"], "k"), "stars")
        pairs = stars.where("node <> pivot").select(F.least("pivot", "node").alias("a"), F.greatest("pivot", "node").alias("b")).distinct()
        for old in tried:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        tried.append(written(pairs, "tried"))
        links = _links(_near(tried[-1], nodes, num, den), docs, words, num, den)
        if links is not None:
            labels = _grown(labels, links)
        component = lambda x: F.col(x) if labels is None else F.coalesce(f"c_{x}", x)
        left = stars if labels is None else stars.join(_named(labels, "node", "c_node"), "node", "left").join(_named(labels, "pivot", "c_pivot"), "pivot", "left")
        apart = written(left.where(component("node") != component("pivot")).select("list", "node"), "apart")
        discard(stars)
        if apart.isEmpty():
            break
    if labels is None:
        labels = nodes.limit(0).select("node", F.col("node").alias("component"))
    # what is left: nodes apart from all their pivots against the nodes of the list in other components
    pairs = written(_rest(lists, labels, nodes, num, den), "rest")
    for old in tried:
        pairs = pairs.join(old, ["a", "b"], "left_anti")
    links = _links(pairs, docs, words, num, den)
    if links is not None:
        labels = _grown(labels, links)
    of = nodes.join(labels, "node", "left").select("sid", F.coalesce("component", "node").alias("component"))
    found = signed.select("doc", "n", "sid").join(of, "sid", "left")
    return found.select(F.col("doc").alias(key), F.col("n").alias("n_shingles"), F.when(F.col("doc").isNotNull(), F.coalesce("component", "doc")).alias("component_id"))


def _may_link(name: int, rows: list[tuple], others: list[tuple], num: int, den: int) -> Iterator[tuple[int, int]]:
    """Pairs of nodes (node, n, c, main, bits, names) in different components that sizes and bitmaps allow to link, but those
    whose least common name is not ``name``: a list of that name has them too."""
    by_width: dict[int, list[tuple]] = {}
    for y in others:
        by_width.setdefault(len(y[4]), []).append(y)
    packed = [(w, ys, np.frombuffer(b"".join(y[4] for y in ys), np.uint8).reshape(len(ys), w), *(np.array([y[i] for y in ys], np.int64) for i in (1, 2)), np.array([y[3] for y in ys]), [set(y[5]) for y in ys]) for w, ys in by_width.items()]
    for node, n, c, main, bits, names in rows:
        own, mine = np.frombuffer(bits, np.uint8), set(names)
        for w, ys, table, m, oc, omain, theirs in packed:
            fit = (oc != c) & ~(omain & main) & (den * np.minimum(m, n) >= num * np.maximum(m, n))
            if not fit.any():
                continue
            a, b = own, table[fit]
            while len(a) > b.shape[1]:
                a = a[: len(a) // 2] ^ a[len(a) // 2 :]
            while b.shape[1] > len(a):
                b = b[:, : b.shape[1] // 2] ^ b[:, b.shape[1] // 2 :]
            apart = np.bitwise_count(a ^ b).sum(axis=1, dtype=np.int64)
            for i in np.flatnonzero(fit)[(den + num) * apart <= (den - num) * (m[fit] + n)].tolist():
                if min(mine & theirs[i]) == name:
                    yield (node, ys[i][0]) if node < ys[i][0] else (ys[i][0], node)


def _rest(lists: DataFrame, labels: DataFrame, nodes: DataFrame, num: int, den: int) -> DataFrame:
    """a, b: the pairs of a list with more than one component that may still link, but those inside its largest component.

    The pairs of a list of at most SMALL nodes are rows.  The nodes of a larger one are dealt to blocks of about BLOCK;
    a row is a pair of blocks, compared in array passes, so it is many bounded rows and its pairs never are.  Near copies are in
    many of these lists together; a node carries their names (32 bits each; of two lists of one name each has the pair), so a pair is made once.
    """
    named = written(lists.join(_named(labels, "node", "component"), "node", "left").select("list", "node", F.coalesce("component", "node").alias("c")), "named")
    sizes = named.groupBy("list", "c").agg(F.count("*").alias("k"))
    lists_of = sizes.groupBy("list").agg(F.max(F.struct("k", "c")).alias("main"), F.count("*").alias("cs"), F.sum("k").alias("k")).select("list", "k", F.col("k").alias("rows"), "cs", F.col("main.c").alias("m"), F.ceil(F.col("k") / BLOCK).alias("blocks"))
    # of all lists, as a hot one of a single component is left out where its rows are
    mixed = written(join_hot(named, written(lists_of, "list_sizes"), ["list"], "rows").where("cs > 1").drop("cs"), "mixed")
    discard(named)
    few = mixed.where(F.col("k") <= SMALL)
    apart = few.where("c <> m").select("list", "node", "c")
    every = few.select("list", F.col("node").alias("other"), F.col("c").alias("oc"), "m")
    # a pair of two nodes apart is met from its smaller one alone
    met = apart.join(every, "list").where("c <> oc AND (oc = m OR node < other)")
    small = _near(met.select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct(), nodes, num, den)
    rows = mixed.where(F.col("k") > SMALL).select("list", "node", "c", (F.col("c") == F.col("m")).alias("main"), F.pmod(F.xxhash64("node"), F.col("blocks")).alias("block"))
    names = rows.groupBy("node").agg(F.collect_set(F.hash("list")).alias("names"))
    rows = rows.join(nodes.select("node", "n", "bits"), "node").join(names, "node")
    packed = written(rows.groupBy("list", "block").agg(F.collect_list(F.struct("node", "n", "c", "main", "bits", "names")).alias("rows"), F.min("main").alias("all_main")), "blocks")
    one, two = (packed.select("list", F.col("block").alias(f"block_{x}"), F.col("rows").alias(f"rows_{x}"), F.col("all_main").alias(f"main_{x}")) for x in "ab")
    both = one.join(two, "list").where("block_a <= block_b AND NOT (main_a AND main_b)").select(F.hash("list").alias("name"), "rows_a", "rows_b")

    def compare(batches):
        for b in slices(batches, 50):
            found: set[tuple[int, int]] = set()
            for name, x, y in zip(*(c.to_pylist() for c in b.columns)):
                found.update(_may_link(name, [tuple(r.values()) for r in x], [tuple(r.values()) for r in y], num, den))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in zip(*sorted(found))], ["a", "b"])

    kind = nodes.schema["node"].dataType.simpleString()
    large = both.mapInArrow(compare, "a long, b long").select(F.col("a").cast(kind).alias("a"), F.col("b").cast(kind).alias("b"))
    return small.unionByName(large).distinct()
