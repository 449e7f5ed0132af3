"""Triangle meshes as tables: faces (face, i0, i1, i2), vertices (v, x, y, z)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def edges(faces: DataFrame) -> DataFrame:
    """(face, i, j) of each face's three edges, i < j."""
    pair = lambda a, b: F.struct(F.least(a, b).alias("i"), F.greatest(a, b).alias("j"))
    return faces.select("face", F.explode(F.array(pair("i0", "i1"), pair("i1", "i2"), pair("i2", "i0"))).alias("e")).select("face", "e.i", "e.j")


def adjacency(faces: DataFrame) -> DataFrame:
    """(face_a, face_b, i, j): edges with exactly two faces."""
    return edges(faces).groupBy("i", "j").agg(F.min("face").alias("face_a"), F.max("face").alias("face_b"), F.count(F.lit(1)).alias("n")).filter("n = 2").select("face_a", "face_b", "i", "j")


def boundary(faces: DataFrame) -> DataFrame:
    """(i, j, face): edges of one face only."""
    return edges(faces).groupBy("i", "j").agg(F.min("face").alias("face"), F.count(F.lit(1)).alias("n")).filter("n = 1").select("i", "j", "face")


def hull_faces(tetrahedra: DataFrame) -> DataFrame:
    """(i0, i1, i2) of the triangles that occur once among tetrahedra (a, b, c, d)."""
    tri = lambda *c: F.array_sort(F.array(*c))
    t = tetrahedra.select(F.explode(F.array(tri("a", "b", "c"), tri("a", "b", "d"), tri("a", "c", "d"), tri("b", "c", "d"))).alias("t"))
    once = t.groupBy("t").agg(F.count(F.lit(1)).alias("n")).filter("n = 1")
    return once.select(*[F.col("t")[i].alias(f"i{i}") for i in range(3)])


def with_corners(faces: DataFrame, vertices: DataFrame) -> DataFrame:
    """Faces with their corners as arrays p0, p1, p2; faces that name an unknown vertex are left out (see ``violations``)."""
    out = faces
    for k in range(3):
        v = vertices.select(F.col("v").alias(f"i{k}"), F.array("x", "y", "z").alias(f"p{k}"))
        out = out.join(v, f"i{k}")
    return out


def shape_filter(area: Column, longest: Column, roundness: Column, mean_area: Column, most_edge: float, least_share: float, least_roundness: float) -> Column:
    """First reason to drop a face, else null: edge cap, then relative area, then aspect."""
    return F.when(longest > most_edge, "EDGE_TOO_LONG").when(area < least_share * mean_area, "AREA_TOO_SMALL").when(roundness < least_roundness, "ASPECT")


def violations(faces: DataFrame, vertices: DataFrame, unit: str = "RECONSTRUCTION_UNITS") -> DataFrame:
    """One row of counts: unknown vertices, degenerate faces, vertices that aren't finite, wrong unit."""
    refs = faces.select(F.explode(F.array("i0", "i1", "i2")).alias("v"))
    unknown = refs.join(vertices.select("v").distinct(), "v", "left_anti").agg(F.count(F.lit(1)).alias("unknown_vertices"))
    flat = faces.agg(F.count_if(F.expr("i0 = i1 or i1 = i2 or i0 = i2")).alias("degenerate_faces"))
    odd = vertices.agg(F.count_if(F.isnan("x") | F.isnan("y") | F.isnan("z") | (F.abs(F.col("x")) + F.abs(F.col("y")) + F.abs(F.col("z")) == float("inf"))).alias("not_finite"))
    # Three one-row results side by side.
    return unknown.crossJoin(flat).crossJoin(odd).withColumn("wrong_unit", F.lit(unit != "RECONSTRUCTION_UNITS"))


def charts(faces: DataFrame, normals: DataFrame, least_cosine: float) -> DataFrame:
    """(face, chart): faces grown over shared edges whose normals differ by no more than an angle; chart is the smallest face.

    The angle is tested between neighbours, so growing in any order gives the connected components of the edges that pass.
    """
    from tracklattice.operators.graphs import connected

    n = normals.select("face", "n")
    a = adjacency(faces).join(n.select(F.col("face").alias("face_a"), F.col("n").alias("na")), "face_a").join(n.select(F.col("face").alias("face_b"), F.col("n").alias("nb")), "face_b")
    cosine = F.aggregate(F.zip_with("na", "nb", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    found = connected(a.filter(cosine >= least_cosine).select(F.col("face_a").alias("a"), F.col("face_b").alias("b")))
    return faces.select("face").join(found.select(F.col("node").alias("face"), F.col("component")), "face", "left").select("face", F.coalesce("component", "face").alias("chart"))
