"""Column expressions on phases, complex samples, vectors and sensor timing."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: WGS84 semi-major axis and first eccentricity squared.
WGS84_A, WGS84_E2 = 6378137.0, 6.69437999014e-3


def wrap(phi: Column) -> Column:
    """To [-pi, pi)."""
    return F.pmod(phi + F.pi(), 2 * F.pi()) - F.pi()


def complex_of(re: Column, im: Column) -> Column:
    return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))


def times_conj(a: Column, b: Column) -> Column:
    """a * conj(b)."""
    return F.struct((a["re"] * b["re"] + a["im"] * b["im"]).alias("re"), (a["im"] * b["re"] - a["re"] * b["im"]).alias("im"))


def angle(z: Column) -> Column:
    return F.atan2(z["im"], z["re"])


def power(z: Column) -> Column:
    return z["re"] * z["re"] + z["im"] * z["im"]


def horner(coefficients: list[float] | list[Column], x: Column) -> Column:
    """Polynomial with ascending coefficients."""
    return reduce(lambda acc, c: acc * x + c, reversed(coefficients[:-1]), F.lit(coefficients[-1]) if not isinstance(coefficients[-1], Column) else coefficients[-1])


def dot(a: list[Column], b: list[Column]) -> Column:
    return reduce(lambda x, y: x + y, [p * q for p, q in zip(a, b, strict=True)])


def norm(a: list[Column]) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: list[Column], b: list[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def ecef(lon: Column, lat: Column, alt: Column) -> list[Column]:
    """Degrees and metres to earth-centred x, y, z."""
    la, lo = F.radians(lat), F.radians(lon)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(la) * F.sin(la))
    return [(n + alt) * F.cos(la) * F.cos(lo), (n + alt) * F.cos(la) * F.sin(lo), (n * (1 - WGS84_E2) + alt) * F.sin(la)]


def utm_epsg(lon: Column, lat: Column) -> Column:
    zone = F.floor((lon + 180) / 6) + 1
    return (F.when(lat >= 0, 32600).otherwise(32700) + zone).cast("long")


def flat_earth(baseline: Column, wavelength: float) -> Column:
    return -4 * F.pi() / wavelength * baseline


def topographic(height: Column, b_perp: Column, slant: Column, incidence: Column, wavelength: float) -> Column:
    return -4 * F.pi() / wavelength * height * b_perp / (slant * F.sin(incidence))


def path_delay(alt: Column, incidence: Column) -> Column:
    """Atmospheric path delay in metres."""
    return (alt * alt / 8.55e7 - alt / 3411.0 + 2.41) / F.cos(incidence)


def calibrated(dn: Column, noise: Column, factor: Column, clip: bool = True) -> Column:
    """Intensity after noise removal; below zero it is clipped, or falls back to the raw intensity."""
    own = (dn * dn - noise) / (factor * factor)
    return F.greatest(own, F.lit(0.0)) if clip else F.when(own < 0, dn * dn / (factor * factor)).otherwise(own)


def rtc_normalized(amplitude: Column, simulated: Column) -> Column:
    return F.when(simulated < 0.05, 0.0).otherwise(F.sqrt(amplitude * amplitude / (simulated + 1e-30)))


def doppler_rate(k_a: Column, k_s: Column) -> Column:
    return k_a * k_s / (k_a - k_s)


def los_azimuth(east: Column, north: Column) -> Column:
    return F.pmod(F.degrees(F.atan2(east, north)), F.lit(360.0))


def los_incidence(up: Column) -> Column:
    return F.degrees(F.acos(-up))


def clip_roi(a: Column, b: Column) -> Column:
    """Intersection of two rectangles (col, row, w, h); (0, 0, 0, 0) where there is none."""
    c0, r0 = F.greatest(a["col"], b["col"]), F.greatest(a["row"], b["row"])
    c1 = F.least(a["col"] + a["w"], b["col"] + b["w"])
    r1 = F.least(a["row"] + a["h"], b["row"] + b["h"])
    hit = (c1 > c0) & (r1 > r0)
    return F.struct(*(F.when(hit, v).otherwise(0).cast("int").alias(k) for k, v in (("col", c0), ("row", r0), ("w", c1 - c0), ("h", r1 - r0))))


#: Metres a second.
LIGHT_SPEED = 299792458.0


def unit(a: list[Column]) -> list[Column]:
    """``a`` over its length; a zero vector stays."""
    n = norm(a)
    return [F.when(n == 0, 0.0).otherwise(x / n) for x in a]


def baselines(primary: list[Column], secondary: list[Column], point: list[Column], speed: list[Column]) -> dict[str, Column]:
    """Parallel, perpendicular and along-track parts of the vector between two sensors; perpendicular counts away from the earth."""
    b = [s - p for s, p in zip(secondary, primary, strict=True)]
    los, along = unit([q - p for q, p in zip(point, primary, strict=True)]), unit(speed)
    up = unit(cross(los, along))
    return {"par": dot(b, los), "perp": dot(b, up) * F.signum(dot(primary, up)), "depth": dot(b, along)}


def bistatic(rng: Column, slant_time: float, samples: int, frequency: float) -> Column:
    """Shift of the azimuth time for the pulse's travel, relative to mid swath."""
    return -0.5 * (2 * rng / LIGHT_SPEED - slant_time - 0.5 * samples / frequency)


def bistatic_full(rng: Column, mid_slant_time: float, mid_samples: int, mid_frequency: float, rank: float, pri: float) -> Column:
    return -((mid_slant_time + 0.5 * mid_samples / mid_frequency) / 2 - rank * pri + rng / LIGHT_SPEED)


def intra_pulse(doppler: Column, chirp_rate: float) -> Column:
    """Range shift of a frequency that the chirp meets early or late."""
    return -doppler / chirp_rate * LIGHT_SPEED / 2


def fm_mismatch(doppler: Column, k_geometry: Column, k_range: Column) -> Column:
    return doppler * (1 / k_geometry - 1 / k_range)


def enu(east_of: Column, north_of: Column, v: list[Column]) -> list[Column]:
    """An earth-centred vector in the east, north and up axes at (longitude, latitude)."""
    lo, la = F.radians(east_of), F.radians(north_of)
    x, y, z = v
    flat = F.cos(lo) * x + F.sin(lo) * y
    return [-F.sin(lo) * x + F.cos(lo) * y, -F.sin(la) * flat + F.cos(la) * z, F.cos(la) * flat + F.sin(la) * z]


def geodetic(x: Column, y: Column, z: Column, rounds: int = 5) -> dict[str, Column]:
    """Longitude, latitude, altitude of an earth-centred point, by fixed-point rounds on the latitude; not for the poles themselves."""
    flat = F.sqrt(x * x + y * y)
    lat = F.atan2(z, flat * (1 - WGS84_E2))
    for _ in range(rounds):
        lat = F.atan2(z + WGS84_E2 * WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(lat) * F.sin(lat)) * F.sin(lat), flat)
    n = WGS84_A / F.sqrt(1 - WGS84_E2 * F.sin(lat) * F.sin(lat))
    return {"lon": F.degrees(F.atan2(y, x)), "lat": F.degrees(lat), "alt": flat / F.cos(lat) - n}


def series_of(kind: str, coefficients: list[float], x: Column) -> Column:
    """Standard, Chebyshev or Legendre series with ascending coefficients."""
    if kind == "standard":
        return horner(coefficients, x)
    terms = [F.lit(1.0), x]
    for n in range(1, len(coefficients) - 1):
        following = {"chebyshev": lambda: 2 * x * terms[-1] - terms[-2], "legendre": lambda: ((2 * n + 1) * x * terms[-1] - n * terms[-2]) / (n + 1)}[kind]()  # noqa: B023
        terms.append(following)
    return reduce(lambda a, b: a + b, [c * t for c, t in zip(coefficients, terms, strict=False)])


def inside_polygon(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the edges of a closed polygon."""
    crossings = F.lit(0)
    for (xa, ya), (xb, yb) in zip(corners, [*corners[1:], corners[0]], strict=True):
        if ya != yb:
            spans = (y < max(ya, yb)) & (y >= min(ya, yb))
            crossings = crossings + F.when(spans & (x < (xb - xa) * (y - ya) / (yb - ya) + xa), 1).otherwise(0)
    return crossings % 2 == 1


def rgb(hue: Column, value: Column) -> dict[str, Column]:
    """Fully saturated colour of a hue (0 to 1) and a value (0 to 1)."""

    def channel(shift: float) -> Column:
        k = F.pmod(F.lit(shift) + hue * 6, F.lit(6.0))
        return value * (1 - F.greatest(F.lit(0.0), F.least(k, 4 - k, F.lit(1.0))))

    return {"r": channel(5.0), "g": channel(3.0), "b": channel(1.0)}


#: Seconds of a beam cycle and of the preamble; bursts and orbits of a cycle of twelve days. Fixed values.
T_BEAM, T_PREAMBLE, CYCLE_BURSTS, CYCLE_ORBITS = 2.758273, 2.299849, 375887, 175


def burst_numbers(sensing: Column, anx: Column, relative_orbit: Column, absolute_orbit: Column) -> tuple[Column, Column]:
    """Relative and absolute burst number of a mid-burst sensing time; for the absolute one, an orbit lasts a whole number of bursts a cycle."""
    since = sensing - anx + (relative_orbit - 1) * (12 * 86400 / CYCLE_ORBITS)
    whole = since + (absolute_orbit - relative_orbit) * (T_BEAM * CYCLE_BURSTS / CYCLE_ORBITS)
    return (1 + F.pmod(F.floor((since - T_PREAMBLE) / T_BEAM), F.lit(CYCLE_BURSTS))).cast("long"), (1 + F.floor((whole - T_PREAMBLE) / T_BEAM)).cast("long")


#: UTM: scale on the central meridian, false easting in metres, false northing of the south. Fixed values.
UTM_SCALE, UTM_EAST, UTM_SOUTH = 0.9996, 500_000.0, 10_000_000.0


def _krueger() -> tuple[float, list[float]]:
    """Rectifying radius and forward coefficients of the transverse Mercator series to the fourth order of the third flattening."""
    f = 1 - math.sqrt(1 - WGS84_E2)
    n = f / (2 - f)
    radius = WGS84_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64)
    return radius, [n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280]


def utm(lon: Column, lat: Column, zone: Column) -> tuple[Column, Column]:
    """Easting and northing in metres of geodetic degrees in a zone's frame; south of the equator with the false northing."""
    e = math.sqrt(WGS84_E2)
    phi, lam = F.radians(lat), F.radians(lon - (zone * 6 - 183))
    radius, alpha = _krueger()
    t = F.sinh(F.atanh(F.sin(phi)) - e * F.atanh(e * F.sin(phi)))
    xi, eta = F.atan2(t, F.cos(lam)), F.atanh(F.sin(lam) / F.sqrt(1 + t * t))
    north = xi + sum((a * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, a in enumerate(alpha)), F.lit(0.0))
    east = eta + sum((a * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, a in enumerate(alpha)), F.lit(0.0))
    return UTM_EAST + UTM_SCALE * radius * east, UTM_SCALE * radius * north + F.when(lat < 0, UTM_SOUTH).otherwise(0.0)


def from_utm(east: Column, north: Column, zone: Column, south: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a place in a zone's frame; ``south`` tells of the false northing."""
    f = 1 - math.sqrt(1 - WGS84_E2)
    n = f / (2 - f)
    radius = _krueger()[0]
    beta = [n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280]
    delta = [2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45, 56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630]
    xi = (north - F.when(south, UTM_SOUTH).otherwise(0.0)) / (UTM_SCALE * radius)
    eta = (east - UTM_EAST) / (UTM_SCALE * radius)
    x = xi - sum((b * F.sin(2 * (k + 1) * xi) * F.cosh(2 * (k + 1) * eta) for k, b in enumerate(beta)), F.lit(0.0))
    y = eta - sum((b * F.cos(2 * (k + 1) * xi) * F.sinh(2 * (k + 1) * eta) for k, b in enumerate(beta)), F.lit(0.0))
    chi = F.asin(F.sin(x) / F.cosh(y))
    lat = chi + sum((d * F.sin(2 * (k + 1) * chi) for k, d in enumerate(delta)), F.lit(0.0))
    return F.degrees(F.atan2(F.sinh(y), F.cos(x))) + zone * 6 - 183, F.degrees(lat)


def surface(coefficients: list[list[float]], x: Column, y: Column) -> Column:
    """Sum of coefficients[i][j] x^i y^j, in nested Horner form."""
    return horner([horner(list(map(float, row)), y) for row in coefficients], x)
