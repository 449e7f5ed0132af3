"""Rotations as column functions: quaternions are arrays (w, x, y, z), matrices arrays of nine, row by row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quaternions closer than this cosine are interpolated linearly.
NEARLY_EQUAL = 0.9995


def held(x: Column, use) -> Column:
    """``use(x)`` with x computed once: columns are trees, and a column that is used n times would stand there n times."""
    return F.transform(F.array(x), use)[0]


def vector(*xs) -> Column:
    return F.array(*[x if isinstance(x, Column) else F.lit(float(x)) for x in xs])


def dot(a: Column, b: Column, n: int) -> Column:
    out = a[0] * b[0]
    for i in range(1, n):
        out = out + a[i] * b[i]
    return out


def unit(a: Column, n: int) -> Column:
    """``a`` over its length; null if that is 0."""
    return held(a, lambda v: F.transform(v, lambda x: F.try_divide(x, F.sqrt(dot(v, v, n)))))


def euler_to_quaternion(yaw: Column, pitch: Column, roll: Column) -> Column:
    """Z-Y-X angles in degrees."""
    half = [F.radians(x) / 2 for x in (yaw, pitch, roll)]
    (cy, cp, cr), (sy, sp, sr) = [F.cos(x) for x in half], [F.sin(x) for x in half]
    return vector(cr * cp * cy + sr * sp * sy, sr * cp * cy - cr * sp * sy, cr * sp * cy + sr * cp * sy, cr * cp * sy - sr * sp * cy)


def quaternion_to_euler(q: Column) -> Column:
    """Struct (yaw in [0, 360), pitch, roll) in degrees; pitch is held at +-90 at gimbal lock."""
    return held(q, _euler)


def _euler(q: Column) -> Column:
    w, x, y, z = (q[i] for i in range(4))
    pitch = 2 * (w * y - z * x)
    return F.struct(
        F.pmod(F.degrees(F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))), F.lit(360.0)).alias("yaw"),
        F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), pitch)))).alias("pitch"),
        F.degrees(F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))).alias("roll"),
    )


def slerp(a: Column, b: Column, alpha: Column) -> Column:
    """Along the shorter arc of unit quaternions."""
    return held(F.struct(a.alias("a"), b.alias("b"), dot(a, b, 4).alias("c")), lambda x: _slerp(x["a"], x["b"], x["c"], alpha))


def _slerp(a: Column, b: Column, cosine: Column, alpha: Column) -> Column:
    sign = F.when(cosine < 0, -1.0).otherwise(1.0)
    cosine = F.least(F.abs(cosine), F.lit(1.0))
    angle = F.acos(cosine)
    near = cosine > NEARLY_EQUAL
    first = F.when(near, 1 - alpha).otherwise(F.try_divide(F.sin((1 - alpha) * angle), F.sin(angle)))
    second = F.when(near, alpha).otherwise(F.try_divide(F.sin(alpha * angle), F.sin(angle)))
    return unit(F.zip_with(a, b, lambda x, y: first * x + second * sign * y), 4)


def euler_to_matrix(yaw: Column, pitch: Column, roll: Column) -> Column:
    """Rz(yaw) Ry(pitch) Rx(roll), angles in degrees."""
    (cy, cp, cr), (sy, sp, sr) = [F.cos(F.radians(x)) for x in (yaw, pitch, roll)], [F.sin(F.radians(x)) for x in (yaw, pitch, roll)]
    return vector(cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr)


def quaternion_to_matrix(q: Column) -> Column:
    return held(q, _matrix)


def _matrix(q: Column) -> Column:
    w, x, y, z = (q[i] for i in range(4))
    return vector(1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w), 2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w), 2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y))


def matrix_to_quaternion(m: Column) -> Column:
    """By the largest of the four squared components, so the divisor is never small."""
    return held(m, _quaternion)


def _quaternion(m: Column) -> Column:
    r = [m[i] for i in range(9)]
    squares = [1 + r[0] + r[4] + r[8], 1 + r[0] - r[4] - r[8], 1 - r[0] + r[4] - r[8], 1 - r[0] - r[4] + r[8]]
    diffs, sums = [r[7] - r[5], r[2] - r[6], r[3] - r[1]], [r[1] + r[3], r[2] + r[6], r[5] + r[7]]
    rows = [
        vector(squares[0], diffs[0], diffs[1], diffs[2]),
        vector(diffs[0], squares[1], sums[0], sums[1]),
        vector(diffs[1], sums[0], squares[2], sums[2]),
        vector(diffs[2], sums[1], sums[2], squares[3]),
    ]
    best = F.when(r[0] + r[4] + r[8] > 0, rows[0]).when((r[0] > r[4]) & (r[0] > r[8]), rows[1]).when(r[4] > r[8], rows[2]).otherwise(rows[3])
    return unit(best, 4)


def quaternion_angle(a: Column, b: Column) -> Column:
    """Degrees between two rotations; a quaternion and its negative are the same rotation."""
    return F.degrees(2 * F.acos(F.least(F.lit(1.0), F.abs(dot(a, b, 4)))))


def matrix_angle(a: Column, b: Column) -> Column:
    """Degrees of the rotation from matrix ``a`` to ``b``."""
    trace = dot(a, b, 9)
    return F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), (trace - 1) / 2))))


def rotate(m: Column, v: Column) -> Column:
    """Matrix times vector."""
    return held(F.struct(m.alias("m"), v.alias("v")), lambda x: _rotate(x["m"], x["v"]))


def _rotate(m: Column, v: Column) -> Column:
    return vector(*[m[3 * i] * v[0] + m[3 * i + 1] * v[1] + m[3 * i + 2] * v[2] for i in range(3)])


def transpose(m: Column) -> Column:
    return held(m, lambda x: vector(*[x[3 * (i % 3) + i // 3] for i in range(9)]))


def multiply(a: Column, b: Column) -> Column:
    return held(F.struct(a.alias("a"), b.alias("b")), lambda x: _multiply(x["a"], x["b"]))


def _multiply(a: Column, b: Column) -> Column:
    return vector(*[a[3 * i] * b[j] + a[3 * i + 1] * b[3 + j] + a[3 * i + 2] * b[6 + j] for i in range(3) for j in range(3)])


def add(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def subtract(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def scale(a: Column, k) -> Column:
    return F.transform(a, lambda x: x * k)


def norm(a: Column, n: int = 3) -> Column:
    return held(a, lambda x: F.sqrt(dot(x, x, n)))


def determinant(m: Column) -> Column:
    return m[0] * (m[4] * m[8] - m[5] * m[7]) - m[1] * (m[3] * m[8] - m[5] * m[6]) + m[2] * (m[3] * m[7] - m[4] * m[6])


def inverse(m: Column) -> Column:
    """Inverse of a 3x3 matrix by cofactors; null if it is singular."""
    return held(m, _inverse)


def _inverse(m: Column) -> Column:
    c = vector(m[4] * m[8] - m[5] * m[7], m[2] * m[7] - m[1] * m[8], m[1] * m[5] - m[2] * m[4], m[5] * m[6] - m[3] * m[8], m[0] * m[8] - m[2] * m[6], m[2] * m[3] - m[0] * m[5], m[3] * m[7] - m[4] * m[6], m[1] * m[6] - m[0] * m[7], m[0] * m[4] - m[1] * m[3])
    d = determinant(m)
    return F.when(F.abs(d) > 1e-300, F.transform(c, lambda x: F.try_divide(x, d)))


def is_rotation(m: Column, tolerance: float = 1e-4) -> Column:
    """Orthonormal with determinant 1."""
    return held(m, lambda x: _is_rotation(x, tolerance))


def _is_rotation(m: Column, tolerance: float) -> Column:
    square = multiply(m, transpose(m))
    off = F.array_max(F.transform(subtract(square, vector(1, 0, 0, 0, 1, 0, 0, 0, 1)), F.abs))
    return (off <= tolerance) & (F.abs(determinant(m) - 1) <= tolerance)


