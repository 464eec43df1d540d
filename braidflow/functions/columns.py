"""Column expressions: null-safe arithmetic, geometry, georeferencing, spectral indices and reporting helpers.

A missing value is NULL. `clean` maps NaN and infinities to it at ingest, after which aggregates skip it and comparisons
with it are not true. All expressions are built-in functions, so that they stay in generated code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x if isinstance(x, Column) else F.lit(x)


def clean(x) -> Column:
    """NULL for NaN and infinities."""
    x = c(x).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def finite_all(*xs) -> Column:
    """All values are there and finite."""
    out = F.lit(True)
    for x in xs:
        out = out & clean(x).isNotNull()
    return out


def ratio(a, b) -> Column:
    """a / b, NULL for a zero divisor."""
    return c(a) / F.nullif(c(b), F.lit(0.0))


def rounded(x, digits: int) -> Column:
    """Half-even rounding of report values."""
    return F.bround(c(x), digits)


# Vectors


def magnitude(u, v) -> Column:
    return F.sqrt(c(u) * c(u) + c(v) * c(v))


def direction(u, v) -> Column:
    return F.atan2(c(v), c(u))


def rotated(u, v, degrees) -> tuple[Column, Column]:
    """The vector turned by an angle: its length and its direction plus the angle, back in components."""
    r, t = magnitude(u, v), direction(u, v) + F.radians(c(degrees).cast("double"))
    return r * F.cos(t), r * F.sin(t)


def along(u, v, nx, ny) -> Column:
    """Component of (u, v) along a unit vector."""
    return c(u) * c(nx) + c(v) * c(ny)


def wrapped_degrees(d) -> Column:
    """An angle's difference in radians, wrapped around zero, in degrees."""
    return F.degrees(F.pmod(c(d) + math.pi, F.lit(2 * math.pi)) - math.pi)


def capped(u, v, most) -> tuple[Column, Column]:
    """The vector, shortened to the length `most` if it is longer."""
    m = magnitude(u, v)
    scale = F.when(m > 0, F.least(F.lit(1.0), c(most) / F.nullif(m, F.lit(0.0)))).otherwise(1.0)
    return c(u) * scale, c(v) * scale


# Georeferencing


def metres_per_degree(latitude) -> tuple[Column, Column]:
    """(longitude, latitude): metres of one degree there. The series' coefficients."""
    t = F.radians(c(latitude))
    lat = 111132.92 - 559.82 * F.cos(2 * t) + 1.175 * F.cos(4 * t) - 0.0023 * F.cos(6 * t)
    lon = 111412.84 * F.cos(t) - 93.5 * F.cos(3 * t) + 0.118 * F.cos(5 * t)
    return lon, lat


def looks_like_degrees(x, y) -> Column:
    """An aggregate: whether all points there are could be longitudes and latitudes; false without any."""
    return F.coalesce((F.max(F.abs(c(x))) <= 180) & (F.max(F.abs(c(y))) <= 90), F.lit(False))


def stretched(x, low, high, size) -> Column:
    """A coordinate of one grid as a fractional index into a raster of that size; NULL for an empty range."""
    return ratio(c(x) - c(low), c(high) - c(low)) * (c(size) - 1)


def to_map(col, row, a, b, x0, d, e, y0) -> tuple[Column, Column]:
    return c(a) * c(col) + c(b) * c(row) + c(x0), c(d) * c(col) + c(e) * c(row) + c(y0)


def to_pixel(x, y, a, b, x0, d, e, y0) -> tuple[Column, Column]:
    """The inverse of to_map, rounded to a pixel half-even."""
    det = c(a) * c(e) - c(b) * c(d)
    dx, dy = c(x) - c(x0), c(y) - c(y0)
    return F.rint(ratio(c(e) * dx - c(b) * dy, det)).cast("int"), F.rint(ratio(c(a) * dy - c(d) * dx, det)).cast("int")


def to_velocity(u, v, kx, ky, a, b, d, e, dt, degrees, latitude) -> tuple[Column, Column]:
    """Map velocity of a displacement in pixels: scaled by the grid's steps, turned by the affine's linear part, in metres
    where the map is in degrees, and over dt, or over 1 if dt isn't positive."""
    du, dv = c(kx) * c(u), c(ky) * c(v)
    step = F.when(c(dt) > 0, c(dt)).otherwise(1.0)
    lon, lat = metres_per_degree(latitude)
    x, y = c(a) * du + c(b) * dv, c(d) * du + c(e) * dv
    return F.when(c(degrees), x * lon).otherwise(x) / step, F.when(c(degrees), y * lat).otherwise(y) / step


def clamped(low, high, least, most) -> tuple[Column, Column]:
    """An interval moved into limits, its length kept where they allow; one without length stays."""
    w = c(high) - c(low)
    whole = w >= c(most) - c(least)
    start = F.least(F.greatest(c(low), c(least)), c(most) - w)
    new_low = F.when(w <= 0, c(low)).when(whole, c(least)).otherwise(start)
    new_high = F.when(w <= 0, c(high)).when(whole, c(most)).otherwise(start + w)
    return new_low, new_high


def part_of(low, high, first, last) -> tuple[Column, Column]:
    """The interval between two fractions of another."""
    w = c(high) - c(low)
    return c(low) + c(first) * w, c(low) + c(last) * w


def around(centre, size) -> tuple[Column, Column]:
    """The interval of a size about a centre."""
    return c(centre) - c(size) * 0.5, c(centre) + c(size) * 0.5


def shifted(low, high, by, least, most) -> tuple[Column, Column]:
    """An interval moved by a distance, then into limits."""
    return clamped(c(low) + c(by), c(high) + c(by), least, most)


def pixel_window(low, high, origin, step, size) -> tuple[Column, Column]:
    """(offset, length) in pixels of an interval of map coordinates; NULL where one pixel or less is inside."""
    first = F.rint((c(low) - c(origin)) / c(step))
    last = first + F.rint((c(high) - c(low)) / c(step))
    start, end = F.greatest(F.lit(0.0), first), F.least(c(size).cast("double"), last)
    ok = end - start > 1
    return F.when(ok, start.cast("int")), F.when(ok, (end - start).cast("int"))


def inside(x, y, xmin, xmax, ymin, ymax) -> Column:
    return c(x).between(c(xmin), c(xmax)) & c(y).between(c(ymin), c(ymax))


def overlaps(xmin, xmax, ymin, ymax, oxmin, oxmax, oymin, oymax) -> Column:
    return (c(xmin) <= c(oxmax)) & (c(xmax) >= c(oxmin)) & (c(ymin) <= c(oymax)) & (c(ymax) >= c(oymin))


# Masks and spectral indices


def threshold_mask(x, level: float = 0.5) -> Column:
    return F.when(c(x) > level, 255).otherwise(0)


def water(x) -> Column:
    """1 for a finite positive value, else 0."""
    return F.when(clean(x) > 0, 1).otherwise(0)


def reflectance(dn) -> Column:
    return c(dn) * 0.0000275 - 0.2


def clear_sky(qa) -> Column:
    """Neither the cloud nor the cloud shadow bit; true without a quality band."""
    return F.coalesce((c(qa).bitwiseAND(F.lit(8)) == 0) & (c(qa).bitwiseAND(F.lit(16)) == 0), F.lit(True))


def sensor(year) -> Column:
    y = c(year)
    return F.when(y <= 1984, "L4").when(y <= 1999, "L5").when(y <= 2012, "L7").when(y <= 2021, "L8").otherwise("L9")


#: Band names of older sensors in the newer ones' naming.
OLDER_BANDS = {"SR_B1": "SR_B2", "SR_B2": "SR_B3", "SR_B3": "SR_B4", "SR_B4": "SR_B5", "SR_B5": "SR_B6", "SR_B7": "SR_B7"}


def indices(blue, green, red, nir, swir1, swir2) -> dict[str, Column]:
    blue, green, red, nir, swir1, swir2 = map(c, (blue, green, red, nir, swir1, swir2))
    return {
        "mndwi": ratio(green - swir1, green + swir1),
        "ndvi": ratio(nir - red, nir + red),
        "mbsrv": green + red,
        "mbsrn": nir + swir1,
        "awesh": blue + 2.5 * green - 1.5 * (nir + swir1) - 0.25 * swir2,
    }


def surface_tests(blue, green, red, nir, swir1, swir2) -> list[Column]:
    """The five tests of the dynamic surface water extent as 0 or 1. Thresholds in reflectance."""
    i = indices(blue, green, red, nir, swir1, swir2)
    blue, nir, swir1, swir2 = map(c, (blue, nir, swir1, swir2))
    tests = [
        i["mndwi"] > 0.124,
        i["mbsrv"] > i["mbsrn"],
        i["awesh"] > 0,
        (i["mndwi"] > -0.44) & (swir1 < 0.09) & (nir < 0.15) & (i["ndvi"] < 0.7),
        (i["mndwi"] > -0.5) & (blue < 0.1) & (swir1 < 0.3) & (swir2 < 0.1) & (nir < 0.25),
    ]
    return [F.when(t, 1).otherwise(0) for t in tests]


def surface_code(tests: list[Column]) -> Column:
    out = F.lit(0)
    for k, t in enumerate(tests):
        out = out + t * 10**k
    return out


#: Codes of each class; 11011, though it has four positive tests, is in none.
SURFACE_CLASSES = {
    1: (1111, 10111, 11101, 11110, 11111),
    2: (111, 1011, 1101, 1110, 10011, 10101, 10110, 11001, 11010, 11100),
    3: (11000,),
    4: (11, 101, 110, 1001, 1010, 1100, 10000, 10001, 10010, 10100),
}


def surface_class(code, strict: bool = True) -> Column:
    """Class of a code, 0 for none; not strict, 11011 counts as the other codes of four tests do."""
    out = F.when(F.lit(not strict) & (c(code) == 11011), 1)
    for k, codes in SURFACE_CLASSES.items():
        out = out.when(c(code).isin(*codes), k)
    return out.otherwise(0)


def water_at(cls, level: int) -> Column:
    return F.when((c(cls) >= 1) & (c(cls) <= level), 1).otherwise(0)


def luma(r, g, b, weights: tuple[float, float, float] = (0.2126, 0.7152, 0.0722)) -> Column:
    return c(r) * weights[0] + c(g) * weights[1] + c(b) * weights[2]


def desaturated(x, gray, share: float) -> Column:
    a = min(max(share, 0.0), 1.0)
    return c(x) * a + c(gray) * (1 - a)


def bright(r, g, b, threshold: float) -> Column:
    return F.lit(True) if threshold < 0 else F.coalesce((c(r) + c(g) + c(b)) / 3 > threshold, F.lit(False))


# Migration


def hickin_nanson(curvature, peak, critical) -> Column:
    """Migration rate by curvature, with its peak at the critical curvature; NULL if that is 0."""
    x = ratio(curvature, critical)
    return c(peak) * x * F.exp(1 - x)


def link_weight(length, width, by: str = "length") -> Column:
    n = F.coalesce(c(length), F.lit(0.0))
    return n * F.coalesce(c(width), F.lit(0.0)) if by == "length_B" else n


def nice_number(x) -> Column:
    """The next of 1, 2, 5 and 10 times a power of ten; 1 for what isn't positive."""
    base = F.pow(F.lit(10.0), F.floor(F.log10(F.when(c(x) > 0, c(x)))))
    f = c(x) / base
    return F.coalesce(F.when(f <= 1, 1.0).when(f <= 2, 2.0).when(f <= 5, 5.0).otherwise(10.0) * base, F.lit(1.0))


# Names


def year_of_tokens(name) -> Column:
    """The first all-digit token of four characters."""
    return F.try_element_at(F.filter(F.split(F.regexp_replace(c(name), r"\.[^.]*$", ""), "_"), lambda t: t.rlike("^[0-9]{4}$")), F.lit(1)).cast("int")


def year_between_underscores(name) -> Column:
    return F.nullif(F.regexp_extract(c(name), r"_(\d{4})_", 1), F.lit("")).cast("int")


#: Other names of sites.
SITE_ALIASES = {"YR-A": "HuangHe-A", "YR-B": "HuangHe-B", "Jurua": "Jurua-A"}


def site_name(name) -> Column:
    out = c(name)
    for alias, site in SITE_ALIASES.items():
        out = F.when(c(name) == alias, site).otherwise(out)
    return out
