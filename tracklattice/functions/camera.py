"""Pinhole cameras and epipolar geometry as column functions.

Poses are explicit: ``r_cw`` (nine, world to camera) and ``t_cw``, so X_c = r_cw X_w + t_cw and the centre is
-r_cw^T t_cw. What can't be projected is null, never a sentinel.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklattice.functions.rotation import add, dot, held, rotate, subtract, transpose, vector
from tracklattice.functions.units import finite

BEHIND = 1e-6


def centre(r_cw: Column, t_cw: Column) -> Column:
    return F.transform(rotate(transpose(r_cw), t_cw), lambda x: -x)


def to_camera(point: Column, r_cw: Column, t_cw: Column) -> Column:
    return add(rotate(r_cw, point), t_cw)


def to_world(point: Column, r_cw: Column, t_cw: Column) -> Column:
    return rotate(transpose(r_cw), subtract(point, t_cw))


def project(point: Column, r_cw: Column, t_cw: Column, fx, fy, cx, cy) -> Column:
    """Struct (u, v, z); null behind the camera."""
    return held(to_camera(point, r_cw, t_cw), lambda c: _pixel(c, fx, fy, cx, cy))


def _pixel(c: Column, fx, fy, cx, cy) -> Column:
    return F.when(c[2] > BEHIND, F.struct((fx * c[0] / c[2] + cx).alias("u"), (fy * c[1] / c[2] + cy).alias("v"), c[2].alias("z")))


def reprojection_error(point: Column, r_cw: Column, t_cw: Column, fx, fy, cx, cy, u: Column, v: Column) -> Column:
    """Pixels; null behind the camera."""
    return held(project(point, r_cw, t_cw, fx, fy, cx, cy), lambda p: F.sqrt((p["u"] - u) * (p["u"] - u) + (p["v"] - v) * (p["v"] - v)))


def ray(u: Column, v: Column, depth: Column, fx, fy, cx, cy) -> Column:
    """The camera's point at a pixel and depth; null for a depth that isn't positive and finite."""
    return F.when(finite(depth) & (depth > BEHIND) & finite(u) & finite(v), vector(depth * (u - cx) / fx, depth * (v - cy) / fy, depth))


def backproject(u: Column, v: Column, depth: Column, r_cw: Column, t_cw: Column, fx, fy, cx, cy) -> Column:
    return to_world(ray(u, v, depth, fx, fy, cx, cy), r_cw, t_cw)


def backproject_rectified(u: Column, v: Column, depth: Column, rect: Column, r_cw: Column, t_cw: Column, fx, fy, cx, cy) -> Column:
    """From a rectified raster: back by the rectifying rotation, then to the world."""
    return to_world(rotate(transpose(rect), ray(u, v, depth, fx, fy, cx, cy)), r_cw, t_cw)


def project_rectified(point: Column, rect: Column, r_cw: Column, t_cw: Column, fx, fy, cx, cy) -> Column:
    return held(rotate(rect, to_camera(point, r_cw, t_cw)), lambda c: _pixel(c, fx, fy, cx, cy))


def homogeneous(x: Column, y: Column) -> Column:
    return vector(x, y, 1.0)


def epipolar_residual(m: Column, xa: Column, xb: Column) -> Column:
    """xb^T M xa of homogeneous points: algebraic residual of an essential or fundamental matrix."""
    return dot(xb, rotate(m, xa), 3)


def sampson(m: Column, xa: Column, xb: Column) -> Column:
    """First-order distance; 0 where the denominator vanishes."""
    return held(F.struct(rotate(m, xa).alias("f"), rotate(transpose(m), xb).alias("g"), xb.alias("b")), lambda x: _sampson(x["f"], x["g"], x["b"]))


def _sampson(f: Column, g: Column, xb: Column) -> Column:
    below = f[0] * f[0] + f[1] * f[1] + g[0] * g[0] + g[1] * g[1]
    residual = dot(xb, f, 3)
    return F.when(below > 1e-12, F.abs(residual) / F.sqrt(below)).otherwise(0.0)


def normalised(u: Column, v: Column, fx, fy, cx, cy) -> Column:
    """Pixel to ray coordinates of an undistorted camera."""
    return vector((u - cx) / fx, (v - cy) / fy)


def undistorted(x: Column, y: Column, k1: float, k2: float, p1: float = 0.0, p2: float = 0.0, k3: float = 0.0, rounds: int = 5) -> Column:
    """Ray coordinates without Brown-Conrady distortion, by fixed-point rounds.

    The rounds are a fold over an array, so the plan doesn't grow with their number.
    """

    def step(v: Column, _: Column) -> Column:
        a, b, x0, y0 = (v[i] for i in range(4))
        r2 = a * a + b * b
        radial = 1 + r2 * (k1 + r2 * (k2 + r2 * k3))
        return F.array((x0 - (2 * p1 * a * b + p2 * (r2 + 2 * a * a))) / radial, (y0 - (p1 * (r2 + 2 * b * b) + 2 * p2 * a * b)) / radial, x0, y0)

    return F.slice(F.aggregate(F.sequence(F.lit(1), F.lit(rounds)), vector(x, y, x, y), step), 1, 2)


def in_front(point: Column, r_cw: Column, t_cw: Column) -> Column:
    """Cheirality."""
    return to_camera(point, r_cw, t_cw)[2] > BEHIND


def cross(a: Column, b: Column) -> Column:
    return held(F.struct(a.alias("a"), b.alias("b")), lambda x: _cross(x["a"], x["b"]))


def _cross(a: Column, b: Column) -> Column:
    return vector(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def distance(a: Column, b: Column) -> Column:
    d = [a[i] - b[i] for i in range(3)]
    return F.sqrt(d[0] * d[0] + d[1] * d[1] + d[2] * d[2])


def triangle_area(a: Column, b: Column, c: Column) -> Column:
    return held(cross(subtract(b, a), subtract(c, a)), lambda n: F.sqrt(dot(n, n, 3)) / 2)


def shortest_edge(a: Column, b: Column, c: Column) -> Column:
    return F.least(distance(a, b), distance(b, c), distance(c, a))


def roundness(a: Column, b: Column, c: Column) -> Column:
    """4 pi area / perimeter^2: near 0.605 for an equilateral triangle, 0 for collinear points."""
    p = distance(a, b) + distance(b, c) + distance(c, a)
    return F.coalesce(F.try_divide(4 * F.pi() * triangle_area(a, b, c), p * p), F.lit(0.0))


def circumradius(a: Column, b: Column, c: Column, d: Column) -> Column:
    """Of a tetrahedron; null if it is flat."""
    sides = F.struct(subtract(b, a).alias("u"), subtract(c, a).alias("v"), subtract(d, a).alias("w"))
    crossed = held(sides, lambda s: F.struct(s["u"].alias("u"), s["v"].alias("v"), s["w"].alias("w"), cross(s["v"], s["w"]).alias("vw"), cross(s["w"], s["u"]).alias("wu"), cross(s["u"], s["v"]).alias("uv")))
    return held(crossed, _circumradius)


def _circumradius(s: Column) -> Column:
    u, v, w, vw, wu, uv = (s[k] for k in ("u", "v", "w", "vw", "wu", "uv"))
    below = 2 * dot(u, vw, 3)
    uu, vv, ww = dot(u, u, 3), dot(v, v, 3), dot(w, w, 3)
    top = held(vector(*[uu * vw[i] + vv * wu[i] + ww * uv[i] for i in range(3)]), lambda t: F.sqrt(dot(t, t, 3)))
    return F.when(F.abs(below) >= 1e-14, top / F.abs(below))


def ray_enters_box(origin: Column, direction: Column, low: Column, high: Column, reach: Column) -> Column:
    """Whether a ray meets an axis-aligned box within ``reach`` of its origin (slabs)."""
    near, far, ok = F.lit(0.0), reach, F.lit(True)
    for i in range(3):
        flat = F.abs(direction[i]) < 1e-12
        a, b = F.try_divide(low[i] - origin[i], direction[i]), F.try_divide(high[i] - origin[i], direction[i])
        ok = ok & F.when(flat, (origin[i] >= low[i]) & (origin[i] <= high[i])).otherwise(True)
        near = F.when(flat, near).otherwise(F.greatest(near, F.least(a, b)))
        far = F.when(flat, far).otherwise(F.least(far, F.greatest(a, b)))
    return ok & (near <= far)


def ray_hits_triangle(origin: Column, direction: Column, a: Column, b: Column, c: Column, tolerance: float = 1e-9) -> Column:
    """Distance along a ray to a triangle, null if it misses. The parallel test is relative to the edges' lengths."""
    edges = F.struct(subtract(b, a).alias("e1"), subtract(c, a).alias("e2"), subtract(origin, a).alias("s"), direction.alias("d"))
    crossed = held(edges, lambda x: F.struct(x["e1"].alias("e1"), x["e2"].alias("e2"), x["s"].alias("s"), x["d"].alias("d"), cross(x["d"], x["e2"]).alias("p"), cross(x["s"], x["e1"]).alias("q")))
    return held(crossed, lambda x: _hit(x, tolerance))


def _hit(x: Column, tolerance: float) -> Column:
    e1, e2, s, direction, p, q = (x[k] for k in ("e1", "e2", "s", "d", "p", "q"))
    det = dot(e1, p, 3)
    scale = F.sqrt(dot(e1, e1, 3) * dot(e2, e2, 3) * dot(direction, direction, 3))
    u, v, t = F.try_divide(dot(s, p, 3), det), F.try_divide(dot(direction, q, 3), det), F.try_divide(dot(e2, q, 3), det)
    return F.when((F.abs(det) > tolerance * scale) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t > 0), t)
