"""Column functions that the operators share. Lengths are metres; null means not observed and stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# By tier, the least absolute and relative half-width of a 95 % interval.
TIER_FLOORS = {"lidar": (0.012, 0.0), "video": (0.04, 0.03), "photo": (0.08, 0.08)}
# Sources that can pass a gate, and sources that are only references.
PHYSICAL = ("laser", "tape", "survey")
REFERENCE = ("faro", "external_reference")


def measurement(value: Column, sigma: Column, abs_floor: Column, rel_floor: Column) -> Column:
    """struct(value, sigma, ci95_low, ci95_high), rounded to 4 places; a null value gives a null struct."""
    half = F.greatest(1.96 * sigma, abs_floor, F.abs(value) * rel_floor)
    made = F.struct(
        F.round(value, 4).alias("value"), F.round(sigma, 4).alias("sigma"),
        F.round(value - half, 4).alias("ci95_low"), F.round(value + half, 4).alias("ci95_high"),
    )
    return F.when(value.isNotNull(), made)


def tier_floor(tier: Column, which: int) -> Column:
    """Floor of a tier: 0 absolute, 1 relative; an unknown tier has none."""
    out = F.lit(None).cast("double")
    for name, floors in TIER_FLOORS.items():
        out = F.when(tier == name, F.lit(floors[which])).otherwise(out)
    return out


def gate_status(eligible: Column, passed: Column) -> Column:
    """BLOCKED unless the source is eligible and the verdict known, else PASS or FAIL."""
    known = F.coalesce(eligible, F.lit(False)) & passed.isNotNull()
    return F.when(~known, "BLOCKED").when(passed, "PASS").otherwise("FAIL")


def eligible_source(source: Column) -> Column:
    """A source that can pass a gate; letters of either case, nothing around it."""
    return F.coalesce(F.lower(source).isin(*PHYSICAL), F.lit(False))


def source_reason(source: Column) -> Column:
    """Why a source can or cannot pass: its own name if it can."""
    name = F.lower(F.coalesce(source, F.lit("")))
    return (
        F.when(name.isin(*PHYSICAL), name).when(name == "faro", "FARO is a depth reference, not a tape")
        .when(name == "external_reference", "external reference is not a tape measurement").when(name == "", "no measurement source")
        .otherwise(F.concat(F.lit("source "), name, F.lit(" is not laser, tape, or survey")))
    )


def hist_bin(value: Column, low: Column, width: Column, bins: Column) -> Column:
    """Left-closed bins from 0, the last one right-closed; null outside."""
    at = F.floor((value - low) / width)
    return F.when((value >= low) & (value <= low + width * bins), F.least(at, bins - 1))


def backproject(u: Column, v: Column, z: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """Pixel and depth to camera coordinates."""
    return F.struct(((u - cx) * z / fx).alias("x"), ((v - cy) * z / fy).alias("y"), z.alias("z"))


def rotate_by_quaternion(q: Column, p: Column) -> Column:
    """p (struct x, y, z) rotated by q (array x, y, z, w of any length but zero)."""
    n = F.sqrt(q[0] * q[0] + q[1] * q[1] + q[2] * q[2] + q[3] * q[3])
    x, y, z, w = (q[i] / n for i in range(4))
    px, py, pz = p["x"], p["y"], p["z"]
    return F.struct(
        ((1 - 2 * (y * y + z * z)) * px + 2 * (x * y - z * w) * py + 2 * (x * z + y * w) * pz).alias("x"),
        (2 * (x * y + z * w) * px + (1 - 2 * (x * x + z * z)) * py + 2 * (y * z - x * w) * pz).alias("y"),
        (2 * (x * z - y * w) * px + 2 * (y * z + x * w) * py + (1 - 2 * (x * x + y * y)) * pz).alias("z"),
    )


def rescaled(fx: Column, fy: Column, cx: Column, cy: Column, sx: Column, sy: Column) -> Column:
    """Intrinsics of the same camera at another image size: sx and sy are new by old width and height."""
    return F.struct((fx * sx).alias("fx"), (fy * sy).alias("fy"), (cx * sx).alias("cx"), (cy * sy).alias("cy"))


def project(p: Column, t: Column, q: Column, fx: Column, fy: Column, cx: Column, cy: Column) -> Column:
    """World point (struct x, y, z) to pixel and depth by a camera at t (struct) turned by q; at depth 0 u and v are null."""
    back = F.array(-q[0], -q[1], -q[2], q[3])
    c = rotate_by_quaternion(back, F.struct(*[(p[a] - t[a]).alias(a) for a in "xyz"]))
    return F.struct((F.try_divide(fx * c["x"], c["z"]) + cx).alias("u"), (F.try_divide(fy * c["y"], c["z"]) + cy).alias("v"), c["z"].alias("z"))


def turned(x: Column, z: Column, theta: Column) -> Column:
    """A floor point in axes turned by theta; by -theta it comes back."""
    return F.struct((x * F.cos(theta) + z * F.sin(theta)).alias("x"), (z * F.cos(theta) - x * F.sin(theta)).alias("z"))


def segment_coords(x: Column, z: Column, x0: Column, z0: Column, x1: Column, z1: Column) -> Column:
    """A floor point along and across the segment; a segment without length gives nulls."""
    dx, dz = x1 - x0, z1 - z0
    n = F.sqrt(dx * dx + dz * dz)
    return F.struct(F.try_divide((x - x0) * dx + (z - z0) * dz, n).alias("along"), F.try_divide((z - z0) * dx - (x - x0) * dz, n).alias("across"))


def pose_usable(t: Column, q: Column) -> Column:
    """Finite translation and rotation, and a quaternion longer than a half."""
    finite = lambda a: ~F.exists(a, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return finite(t) & finite(q) & (F.sqrt(F.aggregate(q, F.lit(0.0), lambda a, x: a + x * x)) > 0.5)


def shoelace(polygon: Column) -> Column:
    """Area of a polygon given as an array of structs x, z; under three points: 0."""
    n = F.size(polygon)
    after = lambda i: F.get(polygon, F.pmod(i + 1, n))
    crossed = F.transform(polygon, lambda p, i: p["x"] * after(i)["z"] - after(i)["x"] * p["z"])
    return F.when(n < 3, F.lit(0.0)).otherwise(0.5 * F.abs(F.aggregate(crossed, F.lit(0.0), lambda a, x: a + x)))


def inside_polygon(x: Column, z: Column, polygon: Column) -> Column:
    """Even-odd rule by casting a ray along x."""
    n = F.size(polygon)
    after = lambda i: F.get(polygon, F.pmod(i + 1, n))

    def crosses(p: Column, i: Column) -> Column:
        q = after(i)
        at = (q["x"] - p["x"]) * (z - p["z"]) / (q["z"] - p["z"]) + p["x"]
        return F.coalesce(((p["z"] > z) != (q["z"] > z)) & (x < at), F.lit(False))

    return F.size(F.filter(F.transform(polygon, crosses), lambda c: c)) % 2 == 1


def overlap_length(runs: Column, low: Column, high: Column) -> Column:
    """Length that runs (structs a, b) share with [low, high]."""
    return F.aggregate(runs, F.lit(0.0), lambda s, r: s + F.greatest(F.lit(0.0), F.least(r["b"], high) - F.greatest(r["a"], low)))


def edge_supported(runs: Column, low: Column, high: Column, share: float = 0.30) -> Column:
    """A span over 0.2 of which runs cover at least a share."""
    return (high - low > 0.2) & (overlap_length(runs, low, high) >= share * (high - low))


def rgb_to_lab(r: Column, g: Column, b: Column) -> Column:
    """sRGB bytes to 8-bit CIE L*a*b* (D65): L scaled to 255, a and b about 128."""
    def linear(c: Column) -> Column:
        s = c / 255.0
        return F.when(s <= 0.04045, s / 12.92).otherwise(F.pow((s + 0.055) / 1.055, 2.4))

    def f(t: Column) -> Column:
        return F.when(t > 0.008856, F.cbrt(t)).otherwise(7.787 * t + 16.0 / 116.0)

    # The matrix of the sRGB primaries and the D65 white point.
    lr, lg, lb = linear(r), linear(g), linear(b)
    x = (0.412453 * lr + 0.357580 * lg + 0.180423 * lb) / 0.950456
    y = 0.212671 * lr + 0.715160 * lg + 0.072169 * lb
    z = (0.019334 * lr + 0.119193 * lg + 0.950227 * lb) / 1.088754
    light = F.when(y > 0.008856, 116 * F.cbrt(y) - 16).otherwise(903.3 * y)
    return F.struct(
        F.round(light * 255 / 100).alias("l"), F.round(500 * (f(x) - f(y)) + 128).alias("a"), F.round(200 * (f(y) - f(z)) + 128).alias("b")
    )


def error_row(predicted: Column, truth: Column) -> Column:
    """struct(abs, rel): absolute error to 4 places, relative to 6; null where a side is missing or truth is 0."""
    gap = F.abs(predicted - truth)
    return F.struct(F.round(gap, 4).alias("abs"), F.round(F.try_divide(gap, F.abs(truth)), 6).alias("rel"))
