"""Near-duplicate vectors against all pairs."""

import math

import duckdb
import numpy as np
import pytest

from lumen.llm import op12_embeddings as op

VECTORS = "vec_id long, embedding array<double>, label int"


def brute(rows, cosine=0.9):
    """(vec_id, n_links, component_id, kept) of every row, by all pairs in double precision."""
    def usable(v):
        return v is not None and all(x is not None and math.isfinite(x) for x in v) and any(x != 0 for x in v)

    good = [i for i, (key, v) in enumerate(rows) if key is not None and usable(v)]
    dims = max([len(rows[i][1]) for i in good], default=0)
    x = np.zeros((len(good), dims))
    for k, i in enumerate(good):
        x[k, :len(rows[i][1])] = rows[i][1]
    x /= np.abs(x).max(1, initial=1e-300)[:, None]
    norm = np.sqrt((x ** 2).sum(1))
    link = (x @ x.T) / (norm[:, None] * norm[None, :]) >= cosine
    np.fill_diagonal(link, False)
    low = np.array([rows[i][0] for i in good])
    while True:
        new = np.array([min(low[k], *low[link[k]]) if link[k].any() else low[k] for k in range(len(good))], dtype=low.dtype)
        if (new == low).all():
            break
        low = new
    out = [(key, 0, key, key is not None) for i, (key, _) in enumerate(rows) if i not in set(good)]
    return sorted(out + [(rows[i][0], int(link[k].sum()), int(low[k]), rows[i][0] == int(low[k])) for k, i in enumerate(good)], key=str)


def result(df):
    assert df.columns[:4] == ["vec_id", "n_links", "component_id", "kept"]
    return sorted([tuple(r)[:4] for r in df.collect()], key=str)


def clusters(seed=5, dims=24, lone=300):
    """Groups of copies, of near copies at several distances, and vectors of their own."""
    rng = np.random.default_rng(seed)
    parts = [rng.standard_normal((lone, dims))]
    for size, degrees in ((150, 0.0), (220, 0.7), (150, 2.0), (120, 6.0), (160, 12.0), (90, 20.0), (40, 26.0)):
        centre = rng.standard_normal(dims)
        centre /= np.linalg.norm(centre)
        noise = rng.standard_normal((size, dims))
        noise /= np.linalg.norm(noise, axis=1)[:, None]
        parts.append((centre + math.tan(math.radians(degrees)) * noise * rng.random((size, 1))) * rng.integers(1, 9, (size, 1)))
    # two tight groups whose members are linked in part, so that groups are compared by members
    a = rng.standard_normal(dims)
    a /= np.linalg.norm(a)
    b = rng.standard_normal(dims)
    b -= a * (a @ b)
    b = math.cos(op.Space(1, "<f8", 0.9).angle) * a + math.sin(op.Space(1, "<f8", 0.9).angle) * b / np.linalg.norm(b)
    parts += [c + 0.01 * rng.standard_normal((60, dims)) / math.sqrt(dims) for c in (a, b)]
    x = np.vstack(parts)
    return [(int(i), v.tolist()) for i, v in zip(rng.permutation(len(x)), x)]


@pytest.mark.parametrize("tile", [2048, 40])
def test_one_bucket_equals_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(op, "BUCKET", 1 << 20)
    monkeypatch.setattr(op, "TILE", tile)
    rows = clusters()
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).repartition(5)
    assert result(op.near_vectors(df)) == brute(rows)


def test_bands_find_nearly_all_links_and_no_others(spark, monkeypatch):
    monkeypatch.setattr(op, "BUCKET", 64)
    rows = clusters(seed=6, lone=2000)
    got = {r[0]: r for r in result(op.near_vectors(spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS)))}
    want = {r[0]: r for r in brute(rows)}
    assert got.keys() == want.keys()
    assert all(got[k][1] <= want[k][1] for k in want)
    found, there = sum(r[1] for r in got.values()), sum(r[1] for r in want.values())
    assert there > 50_000 and found >= 0.995 * there


def test_planted_copies_in_the_given_vectors(spark, small_dir, tables):
    rows = duckdb.sql(f"select vec_id, embedding from '{small_dir}/embeddings.parquet'").fetchall()
    rng = np.random.default_rng(1)
    rows += [(10_000 + i, (np.array(v) + s * rng.standard_normal(len(v))).tolist())
             for i, (_, v) in enumerate(rows[:60]) for s in [0.01 * (i % 6)]]
    folder = tables(embeddings=spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, label int"))
    given = duckdb.sql(f"select vec_id, embedding from '{folder}/embeddings.parquet/*.parquet'").fetchall()
    got = result(op.op12_embeddings(spark, folder))
    assert got == brute(given)
    con = duckdb.connect()
    con.sql(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    assert sorted([tuple(r) for r in con.sql(op.ORACLE_SQL).fetchall()], key=str) == got


def test_estimates_are_unbiased_and_inside_their_bounds():
    rng = np.random.default_rng(3)
    space = op.Space(64, "<f8", 0.9)
    o, q = op.unit(rng.standard_normal((400, 64))), op.unit(rng.standard_normal((300, 64)))
    q[:200] = op.unit(o[:200] + 0.5 * q[:200])
    code, c = space.codes(o)
    import pyarrow as pa
    error = space.signs(pa.array(code, pa.binary())) @ (q @ space.rotation).T / (8 * c[:, None]) - o @ q.T
    sigma = np.sqrt((1 - c ** 2) / (c ** 2 * 63))
    assert abs(error.mean()) < 0.002 and (np.abs(error) <= op.DEVIATIONS * sigma[:, None]).mean() > 0.9999


def test_awkward_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [4.0, 0.0, 0.0]), (3, None), (4, []), (5, [0.0, -0.0]), (6, [nan, 1.0]),
            (7, [inf, 1.0]), (8, [None, 1.0]), (None, [1.0, 0.0]), (None, None), (9, [1e300, 1e290]), (10, [1e-300, 0.0]),
            (11, [0.9, math.sqrt(1 - 0.81) + 1e-3]), (12, [1.0, 0.3, -0.0]), (2, [0.0, 1.0]), (13, [-1.0, 0.0])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], VECTORS).withColumnRenamed("label", "node")
    assert result(op.near_vectors(df)) == brute(rows)
    assert result(op.near_vectors(df.limit(0))) == []
    assert result(op.near_vectors(df.where("vec_id in (3, 4, 5)"))) == brute(rows[3:6])
    one = [(i, [float(i - 3)]) for i in range(8)]
    assert result(op.near_vectors(spark.createDataFrame([(i, v, 0) for i, v in one], VECTORS))) == brute(one)
