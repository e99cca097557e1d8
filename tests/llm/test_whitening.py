import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgework.llm import whitening

SF = "/root/testdata/sf0.001"
GIVEN = "vec_id bigint, embedding array<double>, n int, x string"


def plain(vectors, width):
    """Whole coordinates, and per row the exact deviation and the whitened components."""
    x = np.array([[math.floor(64 * c) + 1000000 for c in v] for v in vectors], dtype=object)
    n, sums = len(x), x.sum(axis=0)
    away = n * x - sums
    centred = (away / n).astype(float)
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    values, axes = values[::-1], axes[:, ::-1]
    kept = min(32, int((values > 1e-12 * values[0]).sum()))
    return n, (away * away).sum(axis=1).tolist(), centred @ axes[:, :kept] / np.sqrt(values[:kept]), values[:kept] / values.sum()


def check(spark, rows, usable):
    given = spark.createDataFrame([(*r, 1, "x") for r in rows], GIVEN).repartition(5)
    got = whitening.whitened(given).collect()
    n, deviation, white, shares = plain([v for _, v in usable], len(usable[0][1]))
    kept = len(shares)
    assert len(got) == kept * len(usable) and {r["n"] for r in got} == {n}
    assert len({r["identity_error"] for r in got}) == 1 and got[0]["identity_error"] < 1e-9
    assert all(abs(r["explained"] / shares[r["component"] - 1] - 1) < 1e-9 for r in got)
    rows_of = lambda items: sorted(items, key=lambda item: (str(item[0]), item[1]))
    ours = {}
    for r in got:
        ours.setdefault((str(r["vec_id"]), r["deviation"]), {}).setdefault(r["component"], set()).add(round(r["whitened"], 6))
    theirs = rows_of([(i, d) for (i, _), d in zip(usable, deviation)])
    assert sorted(ours, key=str) == sorted({(str(i), d) for i, d in theirs}, key=str)
    # Either sign, but one sign per component.
    for c in range(kept):
        want = {}
        for (i, _), d, w in zip(usable, deviation, white[:, c]):
            want.setdefault((str(i), d), set()).add(w)
        signs = {s for s in (1, -1) if all(
            len(have[c + 1]) <= len(want[key]) and all(min(abs(s * h - w) for w in want[key]) < 1e-5 for h in have[c + 1]) for key, have in ours.items())}
        assert signs


def test_given_and_odd_vectors(spark):
    rows = [(r["vec_id"], [float(c) for c in r["embedding"]]) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    usable = rows + [(9000, rows[0][1]), (9000, rows[0][1]), (None, rows[1][1]), (9001, [5.5] * 64)]
    odd = [(1, None), (2, rows[0][1][:-1] + [None]), (3, [float("nan")] * 64), (4, rows[2][1][:-1] + [float("inf")]), (5, [0.5] * 63), (6, [])]
    check(spark, usable + odd, usable)


def test_many_partials_and_dependent_dimensions(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN_IN", 2)
    monkeypatch.setattr(whitening, "BLOCK_ROWS", 7)
    rng = np.random.default_rng(2)
    base = rng.normal(size=(90, 6)) * [3, 1, 0.5, 2, 0.3, 4]
    base[:, 4] = base[:, 0]
    base[40:70] = base[0]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    check(spark, rows, rows)


def test_nothing_to_whiten(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0]), (2, [1.0])], [(1, [])]):
        given = spark.createDataFrame([(*r, 1, "x") for r in rows], GIVEN)
        assert whitening.whitened(given).collect() == []


def test_large_coordinates(spark):
    rows = [(i, [float(v), 1e5 * (i % 3)]) for i, v in enumerate((1e7, -1e7, 0.0, 12345.678))]
    check(spark, rows, rows)
    huge = spark.createDataFrame([(i, [s * 1e300], 1, "x") for i, s in enumerate((1.0, -1.0, 1.0))], GIVEN)
    got = whitening.whitened(huge).select("deviation", F.round("whitened", 6).alias("w")).collect()
    assert [r["deviation"] for r in got] == [None] * 3 and sorted(abs(r["w"]) for r in got) == [0.707107, 0.707107, 1.414214]


@pytest.mark.parametrize("width", [1, 5, 40])
def test_rank_one_updates(width):
    """Row by row and by blocks, with equal rows, zero rows and equal eigenvalues."""
    rng = np.random.default_rng(width)
    x = np.floor(rng.normal(size=(60, width)) * 10)
    x[10:20], x[20:25] = x[0], 0.0
    x[30:30 + min(width, 5)] = np.eye(width)[:5] * 7
    single, blocks = whitening.Spectrum(width), whitening.Spectrum(width)
    for row in x:
        single.add_rows(row[None, :])
    for part in (x[:13], x[13:14], x[14:50]):
        blocks.add_rows(part)
    other = whitening.Spectrum(width)
    other.add_rows(x[50:])
    blocks.add(other.n, other.mean, other.values, other.vectors)
    scatter = (x - x.mean(axis=0)).T @ (x - x.mean(axis=0))
    for one in (single, blocks):
        assert one.n == 60 and np.allclose(one.mean, x.mean(axis=0), atol=1e-12)
        assert np.allclose(one.vectors @ np.diag(one.values) @ one.vectors.T, scatter, atol=1e-10 * max(scatter.max(), 1))
        assert np.allclose(one.vectors.T @ one.vectors, np.eye(width), atol=1e-12)
