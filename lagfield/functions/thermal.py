"""Empirical electron-temperature profile along a field line (the published model of
Titheridge, J. Geophys. Res. 103, 1998, with logarithms to base ten)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lagfield.functions.geometry import EARTH_KM, l_shell, line_top_height, radius_ratio

# Reference height in km.
BASE_HEIGHT = 400.0
BASE_RATIO = 1.0 + BASE_HEIGHT / EARTH_KM

# Published rational-polynomial coefficients a0..a4.
COEFFICIENTS = {
    "Day": {"T0": (1230.0, 2200.0, -3290.0, -0.26, -0.68), "G0": (4.65, -8.55, 4.14, -2.16, 1.45)},
    "Night": {"T0": (985.0, -963.0, 1125.0, -0.60, 0.10), "G0": (0.756, -0.88, 0.29, -2.63, 1.84)},
}


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def day_part(ts) -> Column:
    """Day 09–15 h, Night 21–03 h (universal time), else Transition."""
    h = F.hour(_c(ts))
    return (
        F.when(h.between(9, 15), "Day")
        .when((h >= 21) | (h < 4), "Night")
        .when(h.isNotNull(), "Transition")
    )


def rational(s, coefficients) -> Column:
    a0, a1, a2, a3, a4 = (F.lit(float(a)) for a in coefficients)
    s = _c(s)
    return F.try_divide(a0 + a1 * s + a2 * s * s, F.lit(1.0) + a3 * s + a4 * s * s)


def base_value(part, s, which: str) -> Column:
    """T0 or G0 at the reference height for a Day/Night row; null for other parts."""
    part = _c(part)
    return F.when(part == "Day", rational(s, COEFFICIENTS["Day"][which])).when(
        part == "Night", rational(s, COEFFICIENTS["Night"][which])
    )


def gradient_factor(height, shell) -> Column:
    """B(h); null at height zero, where the logarithm is undefined."""
    h = F.log10(_c(height) / BASE_HEIGHT)
    return F.try_divide(F.lit(0.05), 2.0 * _c(shell) - BASE_RATIO) * (88.0 + h * (10.5 - h))


def line_term(height, shell) -> Column:
    """Geometry factor of the profile: everything but T0 and G0."""
    h = _c(height)
    top = line_top_height(shell)
    r = radius_ratio(h)
    return gradient_factor(h, shell) * ((top - BASE_HEIGHT) / BASE_RATIO**2 - (top - h) / (r * r))


def temperature(height, t0, g0, shell) -> Column:
    """Te(h); NaN where the bracket is negative, null where T0 is zero."""
    t0 = _c(t0)
    return t0 * F.pow(1.0 + F.try_divide(_c(g0), t0) * line_term(height, shell), F.lit(2.0 / 7.0))


def temperature_at(height, t0, g0, ilat) -> Column:
    return temperature(height, t0, g0, l_shell(ilat))
