"""Clustering, whitening and sharding against plain versions."""

import hashlib
import math
import random
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
from codeloom.llm import centroids, sharding, whitening  # noqa: E402

SF = "/root/testdata/sf0.001"
INF, NAN = float("inf"), float("nan")


def vectors(spark, rows, kind="float"):
    return spark.createDataFrame([(i, v, "x", i, [1]) for i, v in rows], f"vec_id long, embedding array<{kind}>, id string, cluster long, q array<int>").repartition(3)


def kmeans(rows, k, rounds, dims, scale):
    """Per row (id, cluster, distance, inertia of the cluster, of all, digest), comparing all with all."""
    kept = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(x * scale) < centroids.MOST for x in v)]
    first = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1]))
    at = [q for _, q in first[:k]]
    d2 = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    for turn in range(rounds + 1):
        own = [min((d2(q, c), j) for j, c in enumerate(at)) for _, q in kept]
        if turn < rounds:
            for j in range(len(at)):
                if mine := [q for (_, q), (_, o) in zip(kept, own, strict=True) if o == j]:
                    at[j] = [sum(x) // len(mine) for x in zip(*mine, strict=True)]
    each = Counter()
    for d, j in own if kept else []:
        each[j] += d
    return [(i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, at[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, own if kept else [], strict=True)]


def bag(rows):
    return sorted(map(repr, rows))


def awkward(dims):
    r = random.Random(3)
    rows = [(k, [r.gauss(0, 0.2) + (k % 5) for _ in range(dims)]) for k in range(150)]
    same = rows[7][1]
    rows += [(200 + k, same) for k in range(60)] + [(5, rows[5][1]), (5, rows[6][1]), (None, rows[8][1]), (None, [0.0] * dims)]
    return rows + [(301, None), (302, []), (303, [0.0] * (dims - 1)), (304, [NAN] + [0.0] * (dims - 1)), (305, [INF] * dims), (306, [None] + [0.5] * (dims - 1)), (307, [1e30] * dims), (308, [-1.0] * dims), (309, [0.0] * (dims - 1) + [-0.0])]


@pytest.mark.parametrize(("k", "dims", "rounds"), [(16, 6, 3), (1, 6, 2), (40, 2, 5), (500, 3, 1)])
def test_ball_kmeans(spark, k, dims, rounds):
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in awkward(dims)]
    got = centroids.ball_kmeans(vectors(spark, rows), k=k, rounds=rounds, dims=dims)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert bag(tuple(r) for r in got.collect()) == bag(kmeans(rows, k, rounds, dims, 64))


def test_ball_kmeans_wide(spark):
    """Double entries up to the bound, where squared distances nearly fill a long."""
    r = random.Random(4)
    rows = [(k, [r.uniform(-1, 1) * (centroids.MOST / 64 - 1) for _ in range(64)]) for k in range(80)]
    got = centroids.ball_kmeans(vectors(spark, rows, "double"), k=9, rounds=2)
    want = [(i, j, d, *(x if x < 1 << 63 else None for x in (a, b)), h) for i, j, d, a, b, h in kmeans(rows, 9, 2, 64, 64)]
    assert bag(tuple(x) for x in got.collect()) == bag(want)


def test_ball_kmeans_corpus(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    want = kmeans([(r.vec_id, r.embedding) for r in df.collect()], 16, 3, 64, 64)
    assert bag(tuple(r) for r in centroids.ball_kmeans(df).collect()) == bag(want)
    assert centroids.ball_kmeans(df.where(F.lit(False))).count() == 0


def test_balls_leave_out():
    """The core and the annuli compare less than all with all, and lose nothing."""
    r = np.random.default_rng(5)
    middle = r.integers(-400, 400, (30, 8))
    x = np.concatenate([m + r.integers(-60, 60, (50, 8)) for m in middle])
    own = np.repeat(np.arange(30), 50)
    d = ((x[:, None] - middle[None]) ** 2).sum(axis=2)
    radii = [centroids._ceil_root(int(d[own == i, i].max())) for i in range(30)]
    balls = centroids.Balls(middle.tolist(), radii)
    assert max(len(near) for near, _ in balls.near) < 29
    cluster, distance = balls.assign(x, own)
    assert (cluster == d.argmin(axis=1)).all() and (distance == d.min(axis=1)).all()


def exact(rows):
    """(ids, integer vectors) of the vectors that are kept."""
    lengths = Counter(len(v) for _, v in rows if v)
    dims = max(lengths, key=lambda d: (lengths[d], d))
    kept = [(i, [math.floor(1024 * x) + 100000 for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(1024 * x) < whitening.MOST for x in v)]
    return [i for i, _ in kept], [x for _, x in kept]


def check_whitening(got, rows, components=8):
    ids, x = exact(rows)
    n, dims = len(x), len(x[0])
    s = [sum(c) for c in zip(*x, strict=True)]
    full = [[n * a - b for a, b in zip(row, s, strict=True)] for row in x]
    deviation = [sum(a * a for a in row) for row in full]
    assert Counter((r.vec_id, r.deviation) for r in got) == Counter({k: c * min(components, dims) for k, c in Counter((i, d if d < 1 << 63 else None) for i, d in zip(ids, deviation, strict=True)).items()})
    assert {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, min(components, dims) + 1))
    a = np.array([[float(v) / n for v in row] for row in full])
    cov = a.T @ a / n
    values = np.linalg.eigvalsh(cov)[::-1]
    for r in got:
        assert r.explained == pytest.approx(max(values[r.component - 1], 0) / values.sum(), rel=1e-6, abs=1e-12)
    return values


def test_whitening(spark):
    df = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]
    got = whitening.whiten(df).collect()
    check_whitening(got, rows)
    table = {(r.vec_id, r.component): r.whitened for r in got}
    w = np.array([[table[i, c] for c in range(1, 9)] for i in sorted({r.vec_id for r in got})])
    assert np.abs(w.T @ w / len(w) - np.eye(8)).max() < 1e-9
    assert all(r.identity_error < 1e-9 for r in got)
    # The same as centring, projecting and dividing each vector by a decomposition of its own.
    ids, x = exact(rows)
    x = np.array(x, float)[np.argsort(ids)]
    x -= x.mean(axis=0)
    values, directions = np.linalg.eigh(x.T @ x / len(x))
    plain = x @ directions[:, ::-1][:, :8] / np.sqrt(values[::-1][:8])
    assert np.abs(np.abs(plain) - np.abs(w)).max() < 1e-6


def test_whitening_awkward(spark):
    rows = [(i, v) for i, v in awkward(6) if i not in (307,)]
    rows = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    got = whitening.whiten(vectors(spark, rows), components=4).collect()
    check_whitening(got, rows, 4)
    assert all(r.identity_error < 1e-9 for r in got)
    flat = [(k, [float(k % 3), 2.0 * (k % 3), 1.0]) for k in range(9)]  # one direction only
    got = whitening.whiten(vectors(spark, flat)).collect()
    check_whitening(got, flat)
    assert {(r.component, r.whitened is None) for r in got} == {(1, False), (2, True), (3, True)}
    assert all(r.whitened is None and r.identity_error is None and r.explained == 0 for r in whitening.whiten(vectors(spark, [(1, [1.0, 2.0])])).collect())
    for none in ([(1, None)], [(1, [])], [(1, [NAN])], []):
        assert whitening.whiten(vectors(spark, none)).count() == 0


def test_whitening_large_numbers(spark):
    """Sums of products beyond 2**53 and 2**63 stay exact: a covariance of huge equal parts and small differences."""
    r = random.Random(6)
    rows = [(k, [1e9 + r.randrange(50), -2e9 + r.randrange(50), 3e11 + r.randrange(9)]) for k in range(300)]
    got = whitening.whiten(vectors(spark, rows, "double")).collect()
    check_whitening(got, rows)
    assert all(r.identity_error < 1e-9 for r in got)
    v = np.array([[3 << 40, -5], [1, 1 << 45]])
    assert whitening.cross_products(v).tolist() == [[(3 << 40) ** 2 + 1, -(15 << 40) + (1 << 45)], [-(15 << 40) + (1 << 45), 25 + (1 << 90)]]
    for value in (0, 1, -1, (1 << 100) - 7, -(1 << 64)):
        assert sum(limb << (whitening.LIMB * place) for place, limb in whitening.limbs(value)) == value


def plain_shard(key, weights):
    def score(s, w):
        bits = int(hashlib.md5(f"{'null' if key is None else key}:{s}".encode()).hexdigest()[:13], 16)
        return (bits if len(set(weights)) == 1 else w / -math.log((bits + 0.5) / (1 << 52)), -s)

    return max(range(len(weights)), key=lambda s: score(s, weights[s]))


def plain_shards(rows, weights, added):
    out, slots = [], Counter()
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, zlib.crc32((r[1] or "").encode()), len((r[1] or "").encode()))):
        s, data = plain_shard(i, weights), (t or "").encode()
        out.append((i, len(data) + 1, zlib.crc32(data), "key", s, slots[s], plain_shard(i, [*weights, added])))
        slots[s] += 1
    return out


@pytest.mark.parametrize(("weights", "added"), [((1.0,) * 8, 1.0), ((1.0, 3.0, 0.5), 2.0)])
def test_sharding(spark, weights, added):
    rows = [(k, "é" * (k % 9)) for k in range(700)] + [(5, "again")] * 40 + [(None, None), (None, ""), (None, "x"), (-3, "y" * 100_000)] + [(9, f"t{k}") for k in range(300)]
    df = spark.createDataFrame([(i, t, "s", 1, 2, "r") for i, t in rows], "doc_id long, text string, size string, shard long, slot long, range string")
    got = [[tuple(r) for r in sharding.shards(df.repartition(p), weights, added).collect()] for p in (1, 5)]
    assert bag(got[0]) == bag(got[1]) == bag(plain_shards(rows, weights, added))
    grown = len(weights)
    assert all(r[6] in (r[4], grown) for r in got[0])
    assert sharding.shards(df.where(F.lit(False))).count() == 0


def test_sharding_weights(spark):
    """Shares follow the weights, and a heavier shard only draws records in."""
    keys = spark.range(20_000)
    before, after = (keys.withColumn("s", sharding.shard_of(F.col("id"), w)).collect() for w in ((1.0, 2.0, 1.0), (1.0, 4.0, 1.0)))
    share = Counter(r.s for r in before)
    assert share[1] / len(before) == pytest.approx(0.5, abs=0.02) and share[0] / len(before) == pytest.approx(0.25, abs=0.02)
    assert all(a.s == b.s or b.s == 1 for a, b in zip(before, after, strict=True))


def test_sharding_files(spark, tmp_path):
    rows = [(k, f"text {k}", "old") for k in range(200)] + [(7, "same", "old")] * 50
    sharding.write(spark.createDataFrame(rows, "doc_id long, text string, shard string"), f"file://{tmp_path}/out", files=3)
    back = spark.read.parquet(f"file://{tmp_path}/out").collect()
    assert bag((r.doc_id, r.text) for r in back) == bag(r[:2] for r in rows)
    assert all(r.shard == plain_shard(r.doc_id, (1.0,) * 8) for r in back)
