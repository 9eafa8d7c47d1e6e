"""Closed formulas of dam-break hydraulics as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

G = 9.81
#: Weir coefficients of the rectangular part and of the side slopes (fixed values, SI).
C_RECT = 1.7
C_SIDE = 1.35


def froehlich(h: Column, v: Column) -> dict[str, Column]:
    """Froehlich 2008 for overtopping (factor 1.3): width, formation time (h), peak, side slope."""
    return {
        "width_m": 0.27 * 1.3 * F.pow(v, F.lit(0.32)) * F.pow(h, F.lit(0.04)),
        "time_h": 63.2 * F.sqrt(v / (G * h * h)) / 3600.0,
        "peak_m3s": 0.607 * F.pow(v, F.lit(0.295)) * F.pow(h, F.lit(1.24)),
        "side_slope": F.lit(1.0),
    }


def storage_width(v: Column) -> Column:
    """Width added by reservoir volume (steps in millions of cubic metres)."""
    m = v / 1e6
    return F.when(m < 1.23, 6.1).when(m < 6.17, 18.3).when(m < 12.35, 42.7).otherwise(54.9)


def von_thun(h: Column, v: Column) -> dict[str, Column]:
    width = 2.5 * h + storage_width(v)
    return {"width_m": width, "time_h": (width / 4.0) / h, "peak_m3s": froehlich(h, v)["peak_m3s"], "side_slope": F.lit(1.0)}


def macdonald(h: Column, v: Column, dam_height: Column | None = None) -> dict[str, Column]:
    hd = h if dam_height is None else F.greatest(F.coalesce(dam_height, F.lit(0.0)), h)
    eroded = 0.0261 * F.pow(v * h, F.lit(0.769))
    return {
        "width_m": eroded / (hd * (10.0 + 4.5 * hd / 2.0)),
        "time_h": 0.0179 * F.pow(eroded, F.lit(0.364)),
        "peak_m3s": 1.154 * F.pow(v * h, F.lit(0.412)),
        "side_slope": F.lit(0.5),
    }


def weir(level: Column, invert: Column, width: Column, side: Column, c_rect: float = C_RECT, c_side: float = C_SIDE) -> Column:
    """Discharge of a trapezoidal opening; none without head."""
    head = F.greatest(F.lit(0.0), level - invert)
    return F.greatest(F.lit(0.0), c_rect * width * F.pow(head, F.lit(1.5)) + c_side * side * F.pow(head, F.lit(2.5)))


def growth(elapsed: Column, formation: Column) -> Column:
    """Share of the breach that has formed, linear in time, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), elapsed / F.greatest(F.lit(1e-9), formation)))


def ritter(x: Column, h1: float, t: float) -> tuple[Column, Column]:
    """Depth and velocity of the ideal dam break on a dry bed at time t > 0, dam at x = 0."""
    if t <= 0:
        raise ValueError("the solution starts after t = 0")
    c0 = (G * h1) ** 0.5
    xi = x / t
    still, dry = xi < -c0, xi > 2 * c0
    h = F.when(still, h1).when(dry, 0.0).otherwise(F.pow(2 * c0 - xi, F.lit(2.0)) / (9 * G))
    u = F.when(still | dry, 0.0).otherwise(2.0 / 3.0 * (c0 + xi))
    return h, u


def normal_depth(q: Column, width: Column, slope: Column, n: Column) -> Column:
    """Manning's normal depth of a wide channel; missing where the bed doesn't fall."""
    return F.when(slope > 0, F.pow(q * n / (width * F.sqrt(slope)), F.lit(0.6)))


def pulse(t: Column, start: float, peak: float, base: float, duration: float) -> Column:
    """A triangular surge over 2 durations that peaks after 0.35 of one, on a base flow."""
    s, top = t - start, 0.35 * duration
    up = s / top * (peak - base)
    down = (2 * duration - s) / (2 * duration - top) * (peak - base)
    on = (s >= 0) & (s <= 2 * duration)
    return base + F.when(on, F.greatest(F.lit(0.0), F.when(s <= top, up).otherwise(down))).otherwise(0.0)


def runoff_cascade(t: Column, base: float, peak: float, offset: float, sigma: float) -> Column:
    return base + peak * F.exp(-F.pow((t - offset) / sigma, F.lit(2.0)))


def runoff_routing(t: Column, base: float, peak: float, offset: float, sigma: float) -> Column:
    """The other form in use: the peak includes the base, and the exponent is halved."""
    return base + (peak - base) * F.exp(-0.5 * F.pow((t - offset) / sigma, F.lit(2.0)))


def regression_hydrograph(t: Column, peak: Column, formation_s: Column) -> Column:
    """Rise over half the formation time, fall over 1.5 of it to a tenth of the peak, then nothing."""
    rise, fall = 0.5 * formation_s, 1.5 * formation_s
    return F.when(t <= rise, peak * t / rise).when(t <= rise + fall, peak * (1 - 0.9 * (t - rise) / fall)).otherwise(0.0)


def minmod(a: Column, b: Column) -> Column:
    return F.when(a * b > 0, F.signum(a) * F.least(F.abs(a), F.abs(b))).otherwise(0.0)


def velocity(h: Column, hq: Column, eps: float = 1e-3) -> Column:
    """hq / h without division by thin water."""
    return F.when(h > 1e-8, 2 * h * hq / (h * h + F.greatest(h * h, F.lit(eps * eps)))).otherwise(0.0)


def rusanov(hl: Column, ul: Column, hr: Column, ur: Column) -> tuple[Column, Column]:
    """Mass and momentum flux through a face from its two states."""
    a = F.greatest(F.abs(ul) + F.sqrt(G * hl), F.abs(ur) + F.sqrt(G * hr))
    mass = 0.5 * (hl * ul + hr * ur) - 0.5 * a * (hr - hl)
    momentum = 0.5 * (hl * ul * ul + 0.5 * G * hl * hl + hr * ur * ur + 0.5 * G * hr * hr) - 0.5 * a * (hr * ur - hl * ul)
    return mass, momentum


def spline_kernel(r: Column, h: float) -> Column:
    """Cubic spline of unit area in one dimension, support 2h."""
    q = F.abs(r) / h
    inner = 1 - 1.5 * q * q + 0.75 * q * q * q
    return (2.0 / (3.0 * h)) * F.when(q < 1, inner).when(q < 2, 0.25 * F.pow(2 - q, F.lit(3.0))).otherwise(0.0)


def spline_slope(x: Column, h: float) -> Column:
    q = F.abs(x) / h
    d = F.when(q < 1, -3 * q + 2.25 * q * q).when(q < 2, -0.75 * F.pow(2 - q, F.lit(2.0))).otherwise(0.0)
    return (2.0 / (3.0 * h * h)) * d * F.signum(x)


def hillshade(dzdx: Column, dzdy: Column, azimuth: float = 315.0, altitude: float = 45.0) -> Column:
    import math

    az, alt = math.radians(360.0 - azimuth + 90.0), math.radians(altitude)
    slope, aspect = F.atan(F.sqrt(dzdx * dzdx + dzdy * dzdy)), F.atan2(dzdy, -dzdx)
    return F.greatest(F.lit(0.0), math.sin(alt) * F.cos(slope) + math.cos(alt) * F.sin(slope) * F.cos(az - aspect))


def jet_velocity(q: Column, width: Column, head: Column) -> Column:
    return F.when(width * head > 1, q / (width * head)).otherwise(0.0)
