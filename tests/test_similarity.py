import numpy as np
import pytest
from pyspark.sql import functions as F

from loregraph.functions import vectors
from loregraph.operators import similarity
from loregraph.schema import VECTOR


def unit(m):
    length = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(length > 0, length, 1)


@pytest.fixture(scope="module")
def clustered(spark):
    """Clustered vectors with many exact copies and one hot cluster."""
    rng = np.random.default_rng(7)
    centers = rng.normal(size=(6, 12))
    which = rng.choice(6, size=240, p=[0.5, 0.1, 0.1, 0.1, 0.1, 0.1])
    nodes = (centers[which] + 0.15 * rng.normal(size=(240, 12))).astype(np.float32)
    nodes[40:80] = nodes[3]
    nodes[100] = 0
    queries = (centers[rng.choice(6, 60)] + 0.2 * rng.normal(size=(60, 12))).astype(np.float32)
    queries[5] = 0
    n_rows = [(f"n{i:03d}", f"p{i % 2}", v.tolist()) for i, v in enumerate(nodes)]
    q_rows = [(f"q{i:03d}", f"p{i % 2}", v.tolist()) for i, v in enumerate(queries)]
    n = spark.createDataFrame(n_rows, "id string, project string, embedding array<float>")
    q = spark.createDataFrame(q_rows, "query_id string, project string, embedding array<float>")
    return n, q, n_rows, q_rows


def brute(n_rows, q_rows, threshold, k):
    out = set()
    nm = unit(np.array([r[2] for r in n_rows], dtype=np.float64))
    qm = unit(np.array([r[2] for r in q_rows], dtype=np.float64))
    for qi, (q, project, _) in enumerate(q_rows):
        sims = [
            (-float(qm[qi] @ nm[i]), r[0])
            for i, r in enumerate(n_rows)
            if r[1] == project and float(qm[qi] @ nm[i]) >= threshold
        ]
        # Copies differ in the last bits only, so ties are compared rounded.
        sims = sorted((round(s, 9), i) for s, i in sims)[:k]
        out |= {(q, i, -s) for s, i in sims}
    return out


@pytest.mark.parametrize("threshold, k", [(0.9, 1), (0.9, 4), (0.5, 3), (0.0, 1)])
@pytest.mark.parametrize("block_rows", [7, 4096])
def test_top_matches_against_brute_force(clustered, threshold, k, block_rows):
    n, q, n_rows, q_rows = clustered
    out = similarity.top_matches(q, n, threshold, k, block_rows=block_rows)
    rows = out.collect()
    got = {(r.query_id, r.similarity) for r in rows}
    want = brute(n_rows, q_rows, threshold, k)
    assert len(rows) == len(want)
    assert {(q, round(s, 6) + 0.0) for q, s in got} == {(q, round(s, 6) + 0.0) for q, _, s in want}
    if k == 1 and threshold > 0:
        assert {(r.query_id, r.id) for r in rows} == {(q, i) for q, i, _ in want}


def test_nearest_match_keeps_every_query(clustered):
    n, q, _, _ = clustered
    assert similarity.nearest_match(q, n, 0.99).count() == 60


def test_find_similar(make_nodes):
    nodes = make_nodes(
        [
            {"embedding": [1.0, 0.0]},
            {"embedding": [0.8, 0.6]},
            {"embedding": [0.0, 1.0]},
            {"embedding": None},
            {"embedding": [1.0, 0.0], "project": "/other"},
        ]
    )
    got = similarity.find_similar(nodes, [2.0, 0.0], 0.5, 10, "/p").collect()
    assert [r.id for r in got] == ["n0", "n1"]
    assert [r.id for r in similarity.find_similar(nodes, [1.0, 0.0], 0.0, 1, "/p").collect()] == ["n0"]
    for bad in ((1.5, 1), (-0.1, 1), (0.5, 0)):
        with pytest.raises(ValueError):
            similarity.find_similar(nodes, [1.0, 0.0], *bad)


@pytest.mark.parametrize("scale", [0.5, 2.0, -1.0])
def test_cosine_scale(spark, scale):
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(2, 16)).astype(np.float32)
    df = spark.createDataFrame([(a.tolist(), b.tolist(), (a * scale).tolist())], "a array<float>, b array<float>, c array<float>")
    x, y = df.select(vectors.cosine("a", "b"), vectors.cosine("c", "b")).first()
    assert y == pytest.approx(np.sign(scale) * x, abs=1e-6)
    zero = spark.createDataFrame([([0.0, 0.0], [1.0, 2.0])], "a array<float>, b array<float>")
    assert zero.select(vectors.cosine("a", "b")).first()[0] == 0.0


def test_codecs(spark):
    rng = np.random.default_rng(3)
    rows = [rng.normal(size=24).astype(np.float32) for _ in range(20)] + [np.zeros(24, np.float32)]
    df = spark.createDataFrame([(r.tolist(),) for r in rows], "v array<float>")
    out = df.select(
        vectors.quantize_int8(F.col("v")).alias("q8"),
        vectors.quantize_ternary(F.col("v")).alias("q2"),
        vectors.requantize(F.col("v"), F.lit(8)).alias("r8"),
        vectors.requantize(F.col("v"), F.lit(2)).alias("r2"),
        vectors.requantize(F.col("v"), F.lit(32)).alias("r32"),
    ).collect()
    for v, r in zip(rows, out, strict=True):
        top = float(np.max(np.abs(v)))
        q8 = np.round(v * np.float32(127.0 / top)).astype(int) if top else np.zeros(24, int)
        mean = float(np.mean(np.abs(v.astype(np.float64))))
        q2 = np.where(v > mean, 1, np.where(v < -mean, -1, 0))
        assert list(r.q8) == list(q8) and list(r.q2) == list(q2)
        assert np.allclose(r.r8, q8 / 127.0) and list(r.r2) == list(q2)
        assert np.array_equal(np.array(r.r32, np.float32), v)
    half = spark.createDataFrame([([0.5, -1.0, 0.25],)], "v array<float>")
    assert list(half.select(vectors.quantize_int8("v" and F.col("v"))).first()[0]) == [64, -127, 32]


def test_vector_schema_is_float():
    assert VECTOR.simpleString() == "array<float>"
