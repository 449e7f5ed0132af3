"""The widest extent against all pairs."""

import numpy as np

from tracklattice.operators import metrology


def widest(points):
    return max(np.linalg.norm(points - p, axis=1).max() for p in points)


def frame(spark, points):
    return spark.createDataFrame(points.tolist(), "x double, y double, z double")


def test_directions_reach_every_way():
    ways, many = metrology.directions(), metrology.directions(200_000)
    assert min(np.abs(part @ ways.T).max(axis=1).min() for part in np.array_split(many, 20)) >= metrology.REACH + 0.005


def test_extent_between_the_directions(spark):
    """A pair just above the baseline is found though every direction has wider reaching ends just below it."""
    ways, many = metrology.directions(), metrology.directions(5000)
    u = many[np.abs(many @ ways.T).max(axis=1).argmin()]
    points = np.concatenate([4.99 * ways, -4.99 * ways, [5.01 * u, -5.01 * u]])
    r = metrology.observability(frame(spark, points)).first()
    assert np.isclose(r["extent"], 10.02) and r["observable"]


def test_extent_is_exact_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(metrology, "BLOCK", 16)
    rng = np.random.default_rng(1)
    for kind in ("ball", "sphere", "line", "one", "same"):
        points = rng.normal(size=(120, 3))
        points = {"ball": points, "sphere": points / np.linalg.norm(points, axis=1)[:, None], "line": points * [1, 0, 0], "one": points[:1], "same": points[[0, 0]]}[kind]
        assert np.isclose(metrology.observability(frame(spark, points)).first()["extent"], widest(points)), kind
