"""Surfaces: normals from neighbourhoods, alpha complexes over given tetrahedra."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracklattice.functions import camera
from tracklattice.operators.mesh import hull_faces
from tracklattice.operators.neighbours import AXES, nearest_few


def pca_normals(points: DataFrame, radius: float, k: int = 12) -> DataFrame:
    """(id, n, nx, ny, nz, planarity, linearity, sphericity) from each point's ``k`` nearest within ``radius``.

    Neighbours are those of ``neighbours.nearest_few``, found once a place; the covariance is divided by their number; the
    normal looks up (least eigenvector with a positive last component, or the first that isn't 0).
    """
    shapes = nearest_few(points, radius, k).mapInArrow(_shapes, "x double, y double, z double, n int, nx double, ny double, nz double, planarity double, linearity double, sphericity double")
    own = points.select("id", *[(F.col(a).cast("double") + 0.0).alias(a) for a in AXES])
    return own.join(shapes, list(AXES)).select(F.col("id").cast("long").alias("id"), "n", "nx", "ny", "nz", "planarity", "linearity", "sphericity")


def _shapes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        near = batch.column("near")
        start = near.offsets.to_numpy().astype(np.int64)
        start, n, flat = start[:-1] - start[0], np.diff(start), near.flatten()
        at = np.stack([flat.field(a).to_numpy() for a in AXES], axis=1)
        out = np.zeros((batch.num_rows, 6))
        for m in np.unique(n[n >= 3]):
            rows = np.flatnonzero(n == m)
            p = at[start[rows, None] + np.arange(m)]
            p = p - p.mean(axis=1, keepdims=True)
            values, vectors = np.linalg.eigh(np.einsum("npi,npj->nij", p, p) / m)
            v = vectors[:, :, 0]
            lead = np.select([np.abs(v[:, i]) > 1e-12 for i in (2, 1, 0)], [v[:, i] for i in (2, 1, 0)], 1.0)
            a, b, d = values[:, 2], values[:, 1], np.maximum(values[:, 0], 0.0)
            over = np.where(a > 0, a, 1.0)
            out[rows, :3] = v * np.sign(lead)[:, None]
            out[rows, 3:] = np.where(a > 0, np.stack([b - d, a - b, d]) / over, 0.0).T
        yield pa.RecordBatch.from_arrays([*[batch.column(a) for a in AXES], pa.array(n.astype(np.int32)), *[pa.array(c) for c in out.T.copy()]], names=[*AXES, "n", "nx", "ny", "nz", "planarity", "linearity", "sphericity"])


def alpha_surface(tetrahedra: DataFrame, vertices: DataFrame, alpha: float) -> DataFrame:
    """(i0, i1, i2): triangles that bound the tetrahedra (a, b, c, d) whose circumradius is at most ``alpha``."""
    t = tetrahedra
    for c in "abcd":
        t = t.join(vertices.select(F.col("v").alias(c), F.array("x", "y", "z").alias(f"p{c}")), c)
    kept = t.filter(camera.circumradius(F.col("pa"), F.col("pb"), F.col("pc"), F.col("pd")) <= alpha)
    return hull_faces(kept.select("a", "b", "c", "d"))
