"""Centroids, codebooks and nearest neighbours against plain versions, and odd tables."""

import hashlib
import math
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quadframe.llm import code_books, shared, stable_projection, vectors, weighted_lloyd

# names that clash with those the operators use inside
SCHEMA = "vec_id long, embedding array<float>, label int, q string, n long, k string, row long, cluster int, codes string, block int, none boolean"


def frame(spark, rows, labels=None):
    return spark.createDataFrame([(k, None if v is None else [None if x is None else float(np.float32(x)) for x in v], labels[i] if labels else None, "q", 1, "k", 2, 3, "c", 4, True) for i, (k, v) in enumerate(rows)], SCHEMA)


def unit(n, d, seed, clusters=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) if not clusters else rng.normal(size=(clusters, d))[rng.integers(0, clusters, n)] + 0.2 * rng.normal(size=(n, d))
    return (x / np.linalg.norm(x, axis=1)[:, None]).astype(np.float32).tolist()


def odd(rows, d=64):
    """Null and short vectors, and components that are null or no number, beside copies and a null key."""
    bad = [(9001, None), (9002, [0.1] * (d - 1)), (9003, [0.1] * (d - 1) + [None]), (9004, [math.nan] + [0.1] * (d - 1)), (9005, [math.inf] * d), (9006, [])]
    return [*rows, *bad, rows[0], rows[0], (rows[1][0], rows[2][1]), (None, rows[3][1])]


def whole(v, scale):
    return [math.floor(float(np.float32(x)) * scale) for x in v]


# ---------------------------------------------------------------- whole numbers
@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, -1, 127, -127, -128, 128, 32767, -32768, 40000, vectors.MOST, -vectors.MOST]), min_size=4, max_size=4), max_size=8))
def test_packed_rows_come_back(rows):
    x = np.array(rows, np.int64).reshape(-1, 4)
    packed = vectors.pack(x)
    assert vectors.unpack(packed, 4).tolist() == x.tolist()
    assert vectors.unpack(packed.slice(1), 4).tolist() == x[1:].tolist()
    assert len({bytes(b.as_py()) for b in packed}) == len({tuple(r) for r in rows})


@pytest.mark.parametrize("most", [300, 5_000, 1 << 23, vectors.MOST])
def test_distances_are_exact(most):
    x, e = (np.random.default_rng(i).integers(-most, most, (50, 16)) for i in (1, 2))
    want = [[sum((int(a) - int(b)) ** 2 for a, b in zip(r, s)) for s in e] for r in x]
    assert [[int(v) for v in r] for r in vectors.squared_distances(x, e)] == want


def test_roots():
    n = np.array([0, 1, 2, 3, 4, 8, 9, (1 << 26) ** 2 - 1, (1 << 26) ** 2, (1 << 30) ** 2 - 1], np.int64)
    assert vectors.roots(n).tolist() == [math.isqrt(int(v)) for v in n]


# ---------------------------------------------------------------- centroids
def plain_clusters(rows, clusters=16, rounds=3, scale=64, d=64):
    kept = [(k, tuple(whole(v, scale))) for k, v in rows if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"1:{'' if k is None else k}".encode()).hexdigest(), v) for k, v in kept)
    centres = [list(v) for _, v in sorted(first, key=lambda x: x[0])[:clusters]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    near = lambda v: min((far(v, c), i) for i, c in enumerate(centres))
    for _ in range(rounds):
        own = [near(v)[1] for _, v in kept]
        for i in range(len(centres)):
            if mine := [v for (_, v), c in zip(kept, own) if c == i]:
                centres[i] = [sum(x) // len(mine) for x in zip(*mine)]
    got = [(k, *near(v)) for k, v in kept]
    inertia = [sum(f for _, f, c in got if c == i) for i in range(len(centres))]
    return sorted((str(k), c, f, inertia[c], sum(inertia), hashlib.sha256(",".join(map(str, centres[c])).encode()).hexdigest()) for k, f, c in got)


@pytest.mark.parametrize("n", [5, 90])
def test_clusters_by_hand(spark, n):
    x = unit(n, 64, n, 7)
    x[4] = x[3]
    rows = odd([(i * 3, v) for i, v in enumerate(x)])
    found = weighted_lloyd.cluster_vectors(frame(spark, rows)).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found) == plain_clusters(rows)


def test_clusters_of_large_and_many_equal_vectors(spark):
    big = [1e6] * 64
    rows = [(i, big if i % 3 else [-1e6] * 64) for i in range(60)]
    found = weighted_lloyd.cluster_vectors(frame(spark, rows), clusters=4).collect()
    assert sorted((str(r.vec_id), r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in found) == plain_clusters(rows, 4)
    assert weighted_lloyd.cluster_vectors(frame(spark, [(1, [3e38] * 64), (2, [0.0] * 64)])).count() == 2


def test_empty_tables(spark):
    for rows in ([], [(1, None), (2, [])]):
        table = frame(spark, rows)
        assert weighted_lloyd.cluster_vectors(table).collect() == [] and code_books.compress(table).collect() == [] and stable_projection.nearest(table).collect() == []


# ---------------------------------------------------------------- codebooks
@settings(max_examples=30, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 20), st.integers(1, 5))
def test_bounds_change_nothing(seed, entries, groups):
    """Rounds with bounds assign as a scan of all entries does; small numbers, so that many entries are equally near."""
    rng = np.random.default_rng(seed)
    x, books = rng.integers(-3, 4, (40, 3)), rng.integers(-3, 4, (entries, 3))
    named = code_books.group_entries(books, groups)
    current, lower = np.zeros(40, np.int64), np.zeros((40, groups), np.int64)
    for _ in range(4):
        far = ((x[:, None] - books) ** 2).sum(axis=2)
        current, least, lower = code_books.assign_part(x, books, named, current, lower)
        assert current.tolist() == far.argmin(axis=1).tolist() and least.tolist() == far.min(axis=1).tolist()
        others = np.where(np.arange(entries) == current[:, None], 1 << 40, far)
        assert all(lower[i, g] ** 2 <= others[i][named == g].min(initial=1 << 40) for i in range(40) for g in range(groups))
        moved = books + rng.integers(-1, 2, books.shape) * rng.integers(0, 2, (entries, 1))
        lower, books = np.maximum(lower - code_books._drift(books, moved, named, groups), 0), moved


def plain_codes(rows, labels, parts=4, entries=256, rounds=4, scale=1024, d=64):
    kept = [(k, lab, np.array(whole(v, scale))) for (k, v), lab in zip(rows, labels) if v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0))
    x = np.array([v for _, _, v in kept]).reshape(len(kept), parts, -1)
    books = np.array([v for _, _, v in order[:entries]]).reshape(-1, parts, d // parts).transpose(1, 0, 2).copy()
    far = lambda p: ((x[:, p, None] - books[p]) ** 2).sum(axis=2)
    for _ in range(rounds):
        for p in range(parts):
            own = far(p).argmin(axis=1)
            for e in np.unique(own):
                books[p, e] = x[own == e, p].sum(axis=0) // (own == e).sum()
    codes, error = [far(p).argmin(axis=1) for p in range(parts)], sum(far(p).min(axis=1) for p in range(parts))
    digest = hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()
    total = {lab: sum(int(e) for e, (_, other, _) in zip(error, kept) if other == lab) for lab in {lab for _, lab, _ in kept}}
    return sorted((str(k), "".join(f"{c[i]:02x}" for c in codes), int(error[i]), total[lab], digest) for i, (k, lab, _) in enumerate(kept))


@pytest.mark.parametrize("n, entries", [(300, 256), (300, 20), (9, 256)])
def test_codes_by_hand(spark, n, entries):
    x = unit(n, 64, n, 6)
    rows = [(i * 2, v) for i, v in enumerate(x)]
    rows = [*odd(rows)[:-2], (None, x[3])]  # equal keys with unlike vectors have a test of their own
    labels = [None if i % 5 == 0 else i % 3 for i in range(len(rows))]
    found = code_books.compress(frame(spark, rows, labels), entries=entries).collect()
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error, r.codebooks_sha256) for r in found) == plain_codes(rows, labels, entries=entries)


def test_codes_of_equal_keys_do_not_depend_on_order(spark):
    rows = [(1, v) for v in unit(30, 8, 4)] + [(2, [0.5] * 6)]
    a, b = (code_books.compress(frame(spark, r), entries=10, parts=4).collect() for r in (rows, rows[::-1]))
    assert len(a) == 30 and sorted(a) == sorted(b)
    with pytest.raises(ValueError):
        code_books.compress(frame(spark, rows), entries=300)


# ---------------------------------------------------------------- neighbours
def plain_nearest(rows, neighbours, every, d):
    kept = [(k, np.array(v, np.float32).astype(float)) for k, v in rows if k is not None and v is not None and len(v) == d and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    x = np.array([v for _, v in kept])
    out = {}
    for i, (k, v) in enumerate(kept):
        if k % every == 0:
            scores = (x * v).sum(axis=1)
            order = sorted((j for j in range(len(kept)) if j != i), key=lambda j: (-scores[j], kept[j][0]))
            out[k, i] = [(kept[j][0], scores[j]) for j in order[:neighbours]]
    return out


def test_neighbours_by_hand(spark):
    """Lengths of all kinds: the largest product is not the least angle."""
    rng = np.random.default_rng(5)
    rows = [(i, (np.array(v) * rng.uniform(0.2, 3)).tolist()) for i, v in enumerate(unit(1500, 16, 1, 40))]
    rows += [(2001, [0.0] * 16), (2003, None), (2005, [0.1] * 15), (2007, [None] + [0.1] * 15), (2009, [math.nan] * 16), (None, rows[0][1])]
    want = plain_nearest(rows, 20, 20, 16)
    found = stable_projection.nearest(frame(spark, rows)).orderBy("query_id", "rank").collect()
    got = {k: [(r["rank"], r.vec_id, r.score) for r in g] for k, g in groupby(found, lambda r: r.query_id)}
    assert set(got) == {k for k, _ in want} and all([n for n, _, _ in g] == list(range(1, 21)) for g in got.values())
    truth = {k: dict(plain_nearest([(k, rows[k][1]), *[r for r in rows if r[0] != k]], 2000, 10**9 if k else 1, 16).get((k, 0), [])) for k in list(got)[:1]}
    assert all(abs(truth[0][v] - s) < 1e-12 for _, v, s in got[0])
    hits = sum(len({v for v, _ in want[k, i]} & {v for _, v, _ in got[k]}) for k, i in want)
    assert hits >= 0.9 * 20 * len(want)
    assert all((a[2], -a[1]) >= (b[2], -b[1]) for g in got.values() for a, b in zip(g, g[1:]))


def test_neighbours_among_very_many_copies(spark, monkeypatch):
    """A vector of which there are more than a block holds: its copies are in several blocks, the smallest keys win, and many queries come in parts."""
    monkeypatch.setattr(stable_projection, "LEAST_ROWS", 100)
    monkeypatch.setattr(stable_projection, "QUERIES", 7)
    rows = [(i, [1.0, 0.0, 0.0, 0.5]) for i in range(600)] + [(600 + i, v) for i, v in enumerate(unit(600, 4, 3))]
    found = stable_projection.nearest(frame(spark, rows), neighbours=5).collect()
    assert len(found) == 60 * 5
    for q in (0, 20, 580):
        assert sorted((r["rank"], r.vec_id) for r in found if r.query_id == q) == list(enumerate([i for i in range(6) if i != q][:5], 1))
    want = plain_nearest(rows, 5, 20, 4)
    assert sum(abs(r.score - want[r.query_id, r.query_id][r["rank"] - 1][1]) < 1e-9 for r in found) >= 0.9 * len(found)


def test_few_candidates_and_repeated_rows(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (1, [0.0, 1.0]), (20, [-1.0, 0.0]), (3, [1.0, 0.0])]
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in stable_projection.nearest(frame(spark, rows)).collect())
    of_zero = [(0, 1, 0, 1.0), (0, 2, 3, 1.0), (0, 3, 1, 0.0), (0, 4, 20, -1.0)]
    assert found == sorted([*of_zero, *of_zero, (20, 1, 1, 0.0), (20, 2, 0, -1.0), (20, 3, 0, -1.0), (20, 4, 3, -1.0)])


def test_doubles_of_any_size(spark):
    table = spark.createDataFrame([(i, [x * 1e150, 1e150]) for i, x in enumerate([1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    found = stable_projection.nearest(table, neighbours=2).orderBy("rank").collect()
    assert [(r.query_id, r.vec_id) for r in found] == [(0, 2), (0, 1)] and found[0].score == pytest.approx(4e300)


def test_chi_square_quantile():
    rng = np.random.default_rng(2)
    for m in (4, 8):
        x = (rng.standard_normal((200_000, m)) ** 2).sum(axis=1)
        assert (x <= stable_projection.chi_square_quantile(0.93, m)).mean() == pytest.approx(0.93, abs=0.005)


def test_projected_distances_follow_chi_square(spark):
    x = np.array(unit(400, 32, 8)) * np.random.default_rng(3).uniform(0.5, 2, (400, 1))
    size = np.linalg.norm(x, axis=1)
    to = stable_projection.Projection(32, 8, size.max())
    z, q = to.rows(x, size), to.queries(x[:20], size[:20])
    ratio = ((q[:, None] - z) ** 2).sum(axis=2) / np.maximum(2 - 2 * (x[:20] @ x.T) / (size[:20, None] * size.max()), 1e-9)
    assert ratio[ratio < 1e6].mean() == pytest.approx(8, rel=0.3)


def test_common_length(spark):
    table = frame(spark, [(1, [1.0] * 4), (2, [1.0] * 4), (3, [1.0] * 6), (4, [1.0] * 6), (5, [1.0] * 5), (6, None)])
    assert vectors.common_length(table, "embedding") == 6 and vectors.common_length(table, "embedding", 4) == 4 and vectors.common_length(table.where(F.lit(False)), "embedding") == 0
    assert vectors.fixed(pa.array([], pa.binary()), "u1", 4).shape == (0, 4)


@pytest.mark.parametrize("limit", [64 << 20, 10])
@pytest.mark.parametrize("how", ["inner", "left"])
def test_hot_keys_meet_their_rows_either_way(spark, monkeypatch, limit, how):
    """By broadcast, or dealt to several tasks each where the rows are too large for that; repeated rows stay repeated."""
    monkeypatch.setattr(shared, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(shared, "HOT_KEYS", 10)
    rows = [("hot", i % 50) for i in range(300)] + [(f"k{i}", i) for i in range(40)] + [("alone", 1)]
    counts = [("hot", 300, ["a" * 20, "b"]), *[(f"k{i}", 1, ["c"]) for i in range(40)]]
    table = spark.createDataFrame(counts, "k string, n long, words array<string>")
    found = shared.join_hot(spark.createDataFrame(rows, "k string, salt int"), table, ["k"], "n", how).collect()
    words = {k: w for k, _, w in counts}
    want = [(k, v, words.get(k)) for k, v in rows if k in words or how == "left"]
    assert sorted((r.k, r.salt, r.words or []) for r in found) == sorted((k, v, w or []) for k, v, w in want)
