"""Robust weights, similarity transforms, lever arms and covariances as column functions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tracklattice.functions.rotation import add, held, inverse, multiply, rotate, scale, subtract, transpose, vector

# Divisors from a reported accuracy to one sigma, horizontal and vertical.
ACCURACY = {"one_sigma": (1.0, 1.0), "cep50": (1.1774100225154747, 1.1774100225154747), "two_sigma_95": (2.447746893674682, 1.959963984540054)}
# Sigmas where a log reports none, without and with an RTK fix (horizontal, vertical).
FALLBACK, RTK = (3.0, 5.0), (0.03, 0.05)
# Weights of red, green and blue, by the standard that names them.
LUMA = {"bt601": (0.299, 0.587, 0.114), "bt709": (0.2126, 0.7152, 0.0722), "rgb2gray": (0.2989, 0.5870, 0.1140)}


def huber_loss(x: Column, delta: float) -> Column:
    a = F.abs(x)
    return F.when(a <= delta, 0.5 * x * x).otherwise(delta * (a - 0.5 * delta))


def huber_weight(x: Column, delta: float) -> Column:
    a = F.abs(x)
    return F.when(a <= delta, 1.0).otherwise(F.try_divide(F.lit(float(delta)), a))


def tukey_weight(u: Column) -> Column:
    """(1 - u^2)^2 within [-1, 1], else 0."""
    return F.when(F.abs(u) <= 1, (1 - u * u) * (1 - u * u)).otherwise(0.0)


def luminance(r: Column, g: Column, b: Column, standard: str = "bt601") -> Column:
    w = LUMA[standard]
    return w[0] * r + w[1] * g + w[2] * b


def relative_scale_error(estimate: Column, reference: Column) -> Column:
    """Over the reference, never over the estimate; null if the reference isn't positive."""
    return F.when(reference > 0, F.abs(estimate - reference) / reference)


def rescale_covariance(cov: Column, s: Column) -> Column:
    """s^2 times a covariance; null for a scale that isn't positive."""
    return F.when(s > 0, F.transform(cov, lambda x: s * s * x))


def sim3_apply(s: Column, r: Column, t: Column, x: Column) -> Column:
    return add(scale(rotate(r, x), s), t)


def sim3_inverse(s: Column, r: Column, t: Column) -> Column:
    """Struct (s, r, t)."""
    back = transpose(r)
    return F.struct((1 / s).alias("s"), back.alias("r"), scale(rotate(back, t), -1 / s).alias("t"))


def sim3_compose(s1: Column, r1: Column, t1: Column, s2: Column, r2: Column, t2: Column) -> Column:
    """Struct (s, r, t) of the second transform followed by the first."""
    return F.struct((s1 * s2).alias("s"), multiply(r1, r2).alias("r"), sim3_apply(s1, r1, t1, t2).alias("t"))


def antenna(camera: Column, r_body: Column, arm: Column) -> Column:
    """Antenna position of a camera centre; ``r_body`` turns body axes to east, north, up."""
    return add(camera, rotate(r_body, arm))


def camera_of(antenna_at: Column, r_body: Column, arm: Column) -> Column:
    return subtract(antenna_at, rotate(r_body, arm))


def lever_covariance(r_body: Column, calibrated: Column | None = None, sigma: float | None = None) -> Column:
    """R C R^T of a calibrated arm, sigma^2 I of an uncalibrated one, else 0."""
    if calibrated is not None:
        return multiply(multiply(r_body, calibrated), transpose(r_body))
    v = 0.0 if sigma is None else sigma * sigma
    return vector(v, 0, 0, 0, v, 0, 0, 0, v)


def gnss_covariance(horizontal: Column, vertical: Column, velocity: Column, rtk: Column, interpretation: str = "one_sigma", timing: float = 0.01, lever: Column | None = None) -> Column:
    """Nine numbers: reported accuracy by its meaning, plus (timing * speed)^2 and the lever arm's part.

    ``interpretation`` "unknown" trusts no report but an RTK fix's.
    """
    usable = lambda x: x.isNotNull() & ~F.isnan(x) & (x > 0)
    known = interpretation != "unknown"
    dh, dv = ACCURACY.get(interpretation, (1.0, 1.0))
    sigma = lambda x, d, i: F.when(rtk, F.when(usable(x), x).otherwise(RTK[i])).when(usable(x) & F.lit(known), x / d).otherwise(FALLBACK[i])
    h, v = sigma(horizontal, dh, 0), sigma(vertical, dv, 1)
    moved = F.coalesce(timing * timing * (velocity[0] * velocity[0] + velocity[1] * velocity[1] + velocity[2] * velocity[2]), F.lit(0.0))
    own = vector(h * h + moved, 0, 0, 0, h * h + moved, 0, 0, 0, v * v + moved)
    return own if lever is None else add(own, lever)


def mahalanobis(residual: Column, cov: Column) -> Column:
    """sqrt(r^T C^-1 r); a singular C gets 1e-6 on its diagonal."""
    ridge = vector(*[1e-6 if i % 4 == 0 else 0 for i in range(9)])
    inv = held(cov, lambda c: F.coalesce(inverse(c), inverse(add(c, ridge))))
    return held(F.struct(rotate(inv, residual).alias("w"), residual.alias("r")), lambda x: _length(x["r"], x["w"]))


def _length(residual: Column, w: Column) -> Column:
    return F.sqrt(F.greatest(F.lit(0.0), residual[0] * w[0] + residual[1] * w[1] + residual[2] * w[2]))


def normal_two_sided(z: float) -> float:
    """P(|N| > z)."""
    return math.erfc(abs(z) / math.sqrt(2))
