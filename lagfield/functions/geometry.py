"""Dipole geometry as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Earth radii in km. Each formula keeps the radius it was published with.
EARTH_KM = 6371.0
GRID_EARTH_KM = 6378.0
FOOT_RADIUS_KM, FOOT_BASE_KM = 6670.0, 6370.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def l_shell(ilat) -> Column:
    """1/cos² of invariant latitude; null at or beyond the poles."""
    ilat = _c(ilat)
    c2 = F.pow(F.cos(F.radians(ilat)), 2)
    return F.when((c2 >= 1e-9) & (F.abs(ilat) < 90), F.try_divide(F.lit(1.0), c2))


def ilat_of_l(shell) -> Column:
    return F.degrees(F.acos(1.0 / F.sqrt(_c(shell))))


def line_top_height(shell) -> Column:
    return (_c(shell) - 1.0) * EARTH_KM


def radius_ratio(height) -> Column:
    return 1.0 + _c(height) / EARTH_KM


def foot_sine_squared(glat, altitude) -> Column:
    """sin² of the 300 km footpoint latitude; NaN where the line never gets there."""
    x = FOOT_RADIUS_KM * F.pow(F.cos(F.radians(_c(glat))), 2) / (FOOT_BASE_KM + _c(altitude))
    return F.pow(F.sin(F.acos(F.sqrt(x))), 2)


def latitude_sine_squared(glat) -> Column:
    return F.pow(F.sin(F.radians(_c(glat))), 2)


def grid_latitude(altitude) -> Column:
    x = F.sqrt((_c(altitude) + GRID_EARTH_KM) / (2 * GRID_EARTH_KM))
    # Without the guard a null would count as a limit.
    return F.when(x.isNotNull(), 90.0 - F.degrees(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x)))))


def dipole_position(altitude, shell, sm_longitude) -> dict[str, Column]:
    """Radius, magnetic latitude (rad) and SM x, y, z on the field line ``shell``."""
    r = (_c(altitude) + EARTH_KM) / EARTH_KM
    ratio = r / _c(shell)
    arg = F.when(ratio.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio)))
    lam = F.acos(F.sqrt(arg))
    lon = F.radians(_c(sm_longitude))
    return {
        "r_re": r,
        "mag_lat_rad": lam,
        "x_sm": r * F.cos(lam) * F.cos(lon),
        "y_sm": r * F.cos(lam) * F.sin(lon),
        "z_sm": r * F.sin(lam),
    }


def magnetic_local_time(sm_longitude) -> Column:
    return F.pmod(_c(sm_longitude) / 15.0 + 12.0, F.lit(24.0))
