"""Putting a cloud on its floor: planes, levelling, drift by quarter of a walk, loop closing, triangulation, photo scale.

Planes and iterated alignments are fitted by array code on bounded samples, one capture a group; everything that
touches all points is column arithmetic on a frame row that is joined to them."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planimeter.functions.expr import project, rotate_by_quaternion
from planimeter.functions.shared import stored
from planimeter.operators.points import floor_mode

#: Points a plane is fitted on, points of one side of an alignment, height of the camera in photos.
PLANE_SAMPLE, ALIGN_SAMPLE, CAMERA_HEIGHT = 12_000, 2500, 1.40


def rotation_between(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The rotation that takes the direction of a to that of b; directions within 0.8 degrees need none, opposite ones half a
    turn about an axis across them."""
    a, b = (np.asarray(v, float) / np.linalg.norm(v) for v in (a, b))
    cosine = float(a @ b)
    if cosine > 0.9999:
        return np.eye(3)
    if cosine < -0.9999:
        axis = np.eye(3)[int(abs(a[0]) >= 0.9)]
        axis = axis - a * (axis @ a)
        axis /= np.linalg.norm(axis)
        return 2 * np.outer(axis, axis) - np.eye(3)
    axis = np.cross(a, b)
    sine = np.linalg.norm(axis)
    x, y, z = axis / sine
    k = np.array([[0, -z, y], [z, 0, -x], [-y, x, 0]])
    return np.eye(3) + sine * k + (1 - cosine) * (k @ k)


def sampled(points: DataFrame, keys: list[str], most: int) -> DataFrame:
    """At most `most` rows a group, those with the least hashes of ord; large groups are thinned before they are ordered."""
    n = points.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    share = (F.xxhash64("ord").bitwiseAND((1 << 30) - 1)) / F.lit(float(1 << 30))
    thin = points.join(n, keys).where(share * F.col("_n") <= 1.5 * most + 100)
    order = Window.partitionBy(*keys).orderBy(F.xxhash64("ord"), "ord")
    return thin.withColumn("_k", F.row_number().over(order)).where(F.col("_k") <= most).drop("_n", "_k")


def fit_plane(xyz: np.ndarray, within: float, up: np.ndarray, level: float, tries: int, seed: int, least: int) -> tuple | None:
    """The plane through three points that most points are close to, among those that face up: normal, centre, points,
    residual. Refitted to its points by least squares; None under `least` of them."""
    rng = np.random.default_rng(seed)
    corners = xyz[rng.integers(0, len(xyz), (tries, 3))]
    normals = np.cross(corners[:, 1] - corners[:, 0], corners[:, 2] - corners[:, 0])
    size = np.linalg.norm(normals, axis=1)
    normals = normals / np.where(size > 1e-8, size, 1.0)[:, None]
    facing = normals @ up
    normals *= np.where(facing < 0, -1.0, 1.0)[:, None]
    usable = np.flatnonzero((size > 1e-8) & (np.abs(facing) >= level))
    if not len(usable):
        return None
    offsets = np.einsum("ij,ij->i", normals[usable], corners[usable, 0])
    near = [int((np.abs(xyz @ n - o) < within).sum()) for n, o in zip(normals[usable], offsets, strict=True)]
    best = int(np.argmax(near))
    close = xyz[np.abs(xyz @ normals[usable[best]] - offsets[best]) < within]
    if len(close) < least:
        return None
    centre = close.mean(axis=0)
    normal = np.linalg.eigh((close - centre).T @ (close - centre))[1][:, 0]
    normal *= -1.0 if normal @ up < 0 else 1.0
    return normal, centre, len(close), float(np.abs((close - centre) @ normal).std())


def floor_planes(low: DataFrame, keys: list[str], *, within: float = 0.02, level: float = 0.92, tries: int = 250, seed: int = 0, least: int = 50) -> DataFrame:
    """A level plane of each group of points (ord, x, y, z): keys, n (array, up), p (array), inliers, residual. Groups under
    `least` points, without a level triple, or with under 30 points close to the plane have none."""
    fields = [low.schema[k] for k in keys]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n array<double>, p array<double>, inliers long, residual double"

    def run(key, table):
        xyz = np.stack([table.column(c).to_numpy() for c in "xyz"], axis=1)
        found = fit_plane(xyz, within, np.array([0.0, 1.0, 0.0]), level, tries, seed, 30) if len(xyz) >= least else None
        rows = [] if found is None else [{**{k: v.as_py() for k, v in zip(keys, key, strict=True)}, "n": found[0].tolist(), "p": found[1].tolist(), "inliers": found[2], "residual": found[3]}]
        kinds = [pa.field(k, table.schema.field(k).type) for k in keys]
        return pa.Table.from_pylist(rows, schema=pa.schema([*kinds, ("n", pa.list_(pa.float64())), ("p", pa.list_(pa.float64())), ("inliers", pa.int64()), ("residual", pa.float64())]))

    typed = sampled(low.select(*keys, "ord", *[F.col(c).cast("double").alias(c) for c in "xyz"]), keys, PLANE_SAMPLE).drop("ord")
    return typed.groupBy(*keys).applyInArrow(run, schema)


def _levelled(n: Column) -> list[list[Column]]:
    """Rows of the rotation that takes the unit vector n (array, pointing up) to +y; near enough to it, none."""
    x, y, z = (F.get(n, F.lit(i)) for i in range(3))
    k = 1 / (1 + y)
    rows = [[1 - x * x * k, -x, -x * z * k], [x, 1 - (x * x + z * z) * k, z], [-x * z * k, -z, 1 - z * z * k]]
    flat = (y > 0.9999) | n.isNull()
    return [[F.when(flat, float(i == j)).otherwise(rows[i][j]) for j in range(3)] for i in range(3)]


def floor_frames(cloud: DataFrame, anchor: bool = True) -> DataFrame:
    """The frame of each capture's floor from its points (capture_id, ord, x, y, z, frame_index), one row a capture:
    turn (nine numbers), origin, floor_h, cuts (quarters of the walk) and shifts, tilt_deg, residual, mode, method.

    The floor is a plane through the points up to 18 cm over the lowest mode, if there are over 80 and one is level; else,
    or without an anchor, the mode itself (the 5th percentile where there is none). floor_h is the median height of the
    points within 3 cm of the plane. Each quarter of the walk with 100 points and a floor mode within 0.25 m is shifted by
    that; without an anchor none is."""
    c, key = F.col, ["capture_id"]
    base = cloud.groupBy(*key).agg(F.percentile("y", 0.05).alias("_p5"), F.percentile("frame_index", F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("cuts"))
    base = base.join(floor_mode(cloud).select("capture_id", "mode"), key, "left").withColumn("mode", F.coalesce("mode", "_p5")).drop("_p5")
    none = F.lit(None).cast("array<double>")
    if anchor:
        low = cloud.join(base.select("capture_id", "mode"), key).where(c("y") < c("mode") + 0.18)
        many = low.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*key))).where("_n > 80")
        base = base.join(floor_planes(many.select("capture_id", "ord", "x", "y", "z"), key), key, "left")
    else:
        base = base.withColumns({"n": none, "p": none, "residual": F.lit(None).cast("double")})
    turn = F.array(*[x for row in _levelled(c("n")) for x in row])
    found = base.withColumns({"turn": turn, "origin": F.coalesce("p", F.array(*[F.lit(0.0)] * 3))})
    there = cloud.join(found.where("n is not null").select("capture_id", "n", "origin", "turn"), key)
    off = sum((F.get("n", F.lit(i)) * (c(a) - F.get("origin", F.lit(i))) for i, a in enumerate("xyz")), F.lit(0.0))
    height = _turned(1)
    h = there.where(F.abs(off) < 0.03).groupBy(*key).agg(F.percentile(height, 0.5).alias("_h"))
    found = found.join(h, key, "left").withColumn("floor_h", F.when(c("n").isNull(), c("mode")).otherwise(F.coalesce("_h", F.lit(0.0))))
    tilt = F.when(c("n").isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.get("n", F.lit(1)))))))
    method = F.when(c("n").isNotNull(), "floor plane").otherwise("floor mode" if anchor else "floor anchor disabled")
    found = found.select("capture_id", "turn", "origin", "floor_h", "cuts", tilt.alias("tilt_deg"), "residual", "mode", method.alias("method"))
    none_shifted = F.array(*[F.lit(0.0)] * 4)
    if not anchor:
        return found.withColumn("shifts", none_shifted)
    found = stored(found)
    flat = replayed(cloud, found.withColumn("shifts", none_shifted)).join(found.select("capture_id", "cuts"), key)
    flat = flat.withColumn("chunk", quarter(c("frame_index"), c("cuts")))
    by = ("capture_id", "chunk")
    counts = flat.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"))
    modes = counts.join(floor_mode(flat, by).select(*by, c("mode").alias("_m")), list(by), "left")
    good = (c("_n") >= 100) & (F.abs("_m") <= 0.25)
    shifts = modes.groupBy(*key).agg(*[F.max(F.when((c("chunk") == i) & good, c("_m"))).alias(f"_{i}") for i in range(4)])
    return found.join(shifts, key, "left").withColumn("shifts", F.array(*[F.coalesce(f"_{i}", F.lit(0.0)) for i in range(4)])).drop("_0", "_1", "_2", "_3")


def quarter(frame: Column, cuts: Column) -> Column:
    """Which quarter of a walk a frame is in (0 to 3; the last holds its end), null outside of it."""
    return F.when(frame.between(F.get(cuts, F.lit(0)), F.get(cuts, F.lit(4))), F.size(F.filter(F.slice(cuts, 2, 3), lambda q: frame >= q)))


def _turned(row: int) -> Column:
    return sum((F.get("turn", F.lit(3 * row + i)) * (F.col(a) - F.get("origin", F.lit(i))) for i, a in enumerate("xyz")), F.lit(0.0))


def replayed(points: DataFrame, frames: DataFrame) -> DataFrame:
    """Points (capture_id, x, y, z, frame_index and others) put on their capture's floor by floor_frames(). Loops are not
    replayed; points of frames outside the walk are not shifted."""
    held = frames.select("capture_id", "turn", "origin", "floor_h", F.col("cuts").alias("_cuts"), "shifts")
    shift = F.coalesce(F.get("shifts", quarter(F.col("frame_index"), F.col("_cuts"))), F.lit(0.0))
    j = points.join(held, "capture_id").withColumns({"_x": _turned(0), "_y": _turned(1) - F.col("floor_h") - shift, "_z": _turned(2)})
    return j.select(*[F.col(f"_{n}").alias(n) if n in "xyz" else F.col(n) for n in points.columns])


def anchor_off(cloud: DataFrame) -> DataFrame:
    """The control of the ablation: one floor height taken off, no rotation, no shift by quarter."""
    return replayed(cloud, floor_frames(cloud, anchor=False))


# Loop closing ----------------------------------------------------------------------------------------


def nearest_rows(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of a the nearest row of b, the first on ties, and its distance."""
    at, gap = np.zeros(len(a), np.int64), np.zeros(len(a))
    for i in range(0, len(a), 512):
        d = ((a[i : i + 512, None, :] - b[None, :, :]) ** 2).sum(axis=2)
        at[i : i + 512] = d.argmin(axis=1)
        gap[i : i + 512] = np.sqrt(d.min(axis=1))
    return at, gap


def rigid_2d(a: np.ndarray, b: np.ndarray) -> tuple[float, np.ndarray]:
    """Yaw and shift that take rows of a to rows of b with the least squares."""
    ma, mb = a.mean(axis=0), b.mean(axis=0)
    x, y = a - ma, b - mb
    yaw = math.atan2((x[:, 0] * y[:, 1] - x[:, 1] * y[:, 0]).sum(), (x * y).sum())
    return yaw, mb - _turn_2d(ma[None], yaw)[0]


def _turn_2d(p: np.ndarray, yaw: float) -> np.ndarray:
    c, s = math.cos(yaw), math.sin(yaw)
    return p @ np.array([[c, s], [-s, c]])


def align_2d(a: np.ndarray, b: np.ndarray, rounds: int = 12) -> tuple[float, np.ndarray, float, float]:
    """Yaw and shift that lay points a on points b by rounds of nearest partners, and the root mean square gap before
    and after."""
    moved = a
    before = math.sqrt((nearest_rows(a, b)[1] ** 2).mean())
    for _ in range(rounds):
        yaw, shift = rigid_2d(moved, b[nearest_rows(moved, b)[0]])
        moved = _turn_2d(moved, yaw) + shift
    after = math.sqrt((nearest_rows(moved, b)[1] ** 2).mean())
    return *rigid_2d(a, moved), before, after


def loop_fits(cloud: DataFrame) -> DataFrame:
    """How the end of each walk lies on its start: capture_id, fired, reason, yaw, tx, tz, cx, cz, rmse_before, rmse_after.

    Points between 0.7 and 1.8 m of the first and last 12 % of the frames (200 each), first of each 5 cm square (30 to 2500
    each) are aligned. The fit is taken if it turns by at most 8 degrees, moves by at most 0.75 m and brings the gap to
    85 %."""
    c, key = F.col, ["capture_id"]
    q = cloud.groupBy(*key).agg(F.percentile("frame_index", F.array(F.lit(0.12), F.lit(0.88))).alias("_q"), F.count(F.lit(1)).alias("_all"))
    band = cloud.join(q, key).where((c("y") > 0.7) & (c("y") < 1.8))
    from planimeter.operators.layout import first_in_cells

    def side(part: DataFrame, name: str) -> tuple[DataFrame, DataFrame]:
        thin = sampled(first_in_cells(part, key, 0.05), key, ALIGN_SAMPLE)
        return stored(thin.select("capture_id", "x", "z")), part.groupBy(*key).agg(F.count(F.lit(1)).alias(f"_{name}"))

    (early, n_early), (late, n_late) = side(band.where(c("frame_index") <= c("_q")[0]), "early"), side(band.where(c("frame_index") >= c("_q")[1]), "late")
    state = q.select("capture_id", "_all").join(n_early, key, "left").join(n_late, key, "left").na.fill(0)
    kind = next(f.dataType.simpleString() for f in cloud.schema if f.name == "capture_id")
    schema = f"capture_id {kind}, _small boolean, yaw double, tx double, tz double, cx double, cz double, rmse_before double, rmse_after double"

    def run(key_, a, b):
        end, start = (np.stack([t.column(k).to_numpy() for k in "xz"], axis=1) if t.num_rows else np.zeros((0, 2)) for t in (a, b))
        small = min(len(end), len(start)) < 30
        yaw, shift, before, after = (None, (None, None), None, None) if small else align_2d(end, start)
        centre = (None, None) if small else start.mean(axis=0)
        row = [key_[0].as_py(), small, yaw, *shift, *centre, before, after]
        names = ("capture_id", "_small", "yaw", "tx", "tz", "cx", "cz", "rmse_before", "rmse_after")
        kinds = [(a if a.num_rows else b).schema.field("capture_id").type, pa.bool_(), *[pa.float64()] * 7]
        return pa.table({n: pa.array([v], k) for n, v, k in zip(names, row, kinds, strict=True)})

    fits = late.groupBy(*key).cogroup(early.groupBy(*key)).applyInArrow(run, schema)
    j = state.join(fits, key, "left")
    reason = (
        F.when(c("_all") < 500, "too few points").when((c("_early") < 200) | (c("_late") < 200), "not enough wall points at both ends of the walk")
        .when(F.coalesce("_small", F.lit(True)), "wall footprint too small to close")
        .when((F.abs("yaw") > math.radians(8)) | (F.hypot("tx", "tz") > 0.75), "alignment is too large to be a loop")
        .when(c("rmse_after") > 0.85 * c("rmse_before"), "alignment did not tighten the loop").otherwise("applied")
    )
    return j.withColumn("reason", reason).select("capture_id", (c("reason") == "applied").alias("fired"), "reason", "yaw", "tx", "tz", "cx", "cz", "rmse_before", "rmse_after")


def closed_loops(cloud: DataFrame, fits: DataFrame) -> DataFrame:
    """Points with their capture's fit spread along the walk: none at its first frame, all of it at its last."""
    c = F.col
    walk = cloud.groupBy("capture_id").agg(F.min("frame_index").alias("_a"), F.max("frame_index").alias("_b"))
    j = cloud.join(walk, "capture_id").join(fits.where("fired").select("capture_id", "yaw", "tx", "tz", "cx", "cz"), "capture_id", "left")
    part = (c("frame_index") - c("_a")) / F.greatest(F.lit(1), c("_b") - c("_a"))
    dx, dz = c("x") - c("cx"), c("z") - c("cz")
    to_x = F.cos("yaw") * dx - F.sin("yaw") * dz + c("cx") + c("tx")
    to_z = F.sin("yaw") * dx + F.cos("yaw") * dz + c("cz") + c("tz")
    moved = {"x": c("x") + F.coalesce(part * (to_x - c("x")), F.lit(0.0)), "z": c("z") + F.coalesce(part * (to_z - c("z")), F.lit(0.0))}
    return j.select(*[moved[n].alias(n) if n in moved else c(n) for n in cloud.columns])


# Video and photos -------------------------------------------------------------------------------------


def frame_pairs(frames: DataFrame) -> DataFrame:
    """Pairs of frames (capture_id, ord, t) next to each other and one apart whose cameras lie 0.08 to 1.3 m apart."""
    w = Window.partitionBy("capture_id").orderBy("ord")
    pairs = frames.withColumn("b", F.array(*[F.struct(F.lead("ord", k).over(w).alias("ord"), F.lead("t", k).over(w).alias("t")) for k in (1, 2)]))
    pairs = pairs.select("capture_id", F.col("ord").alias("first"), F.col("t").alias("_t"), F.explode("b").alias("b")).where("b.ord is not null")
    apart = F.sqrt(sum(((F.get("b.t", F.lit(i)) - F.get("_t", F.lit(i))) ** 2 for i in range(3)), F.lit(0.0)))
    return pairs.select("capture_id", "first", F.col("b.ord").alias("second"), apart.alias("baseline")).where((F.col("baseline") >= 0.08) & (F.col("baseline") <= 1.3))


def good_matches(matches: DataFrame, most: int = 700, least: int = 25, farthest: int = 56) -> DataFrame:
    """Matches of a pair (capture_id, first, second, distance, ord) close enough, the best 700 of each, pairs of 25 or more."""
    by = Window.partitionBy("capture_id", "first", "second")
    near = matches.where(F.col("distance") <= farthest).withColumn("_k", F.row_number().over(by.orderBy("distance", "ord"))).where(F.col("_k") <= most)
    return near.withColumn("_n", F.count(F.lit(1)).over(by)).where(F.col("_n") >= least).drop("_k", "_n")


def frame_intrinsics(fx: Column, fy: Column, cx: Column, cy: Column, own: Column, sx: Column, sy: Column, width: Column, height: Column) -> Column:
    """Camera of a frame scaled to its picture; where it has none (fx or fy up to 1) the capture's own (struct), else a pinhole
    of 0.85 widths."""
    none = F.coalesce((fx <= 1.0) | (fy <= 1.0), F.lit(True))
    guess = F.struct((0.85 * width).alias("fx"), (0.85 * width).alias("fy"), (width / 2).alias("cx"), (height / 2).alias("cy"))
    return F.when(none, F.coalesce(own, guess)).otherwise(F.struct((fx * sx).alias("fx"), (fy * sy).alias("fy"), (cx * sx).alias("cx"), (cy * sy).alias("cy")))


def _scaled_minus(k: Column, a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: k * x - y)


def triangulated(matches: DataFrame) -> DataFrame:
    """World points of matches seen by two posed cameras: matches with x, y, z that both agree on.

    matches: u0, v0, u1, v1, cameras k0, k1 (structs fx, fy, cx, cy), t0, t1, q0, q1 (arrays) and others. The point is the
    null vector of the four ray equations. It must lie 0.35 to 6 m before both cameras, fall within 6 pixels of both
    sights, and be seen from directions over 0.8 degrees apart."""
    c = F.col
    names = matches.columns

    def rows(side: str) -> list[Column]:
        """The three rows of a camera's projection, four numbers each."""
        axes = [rotate_by_quaternion(c(f"q{side}"), F.struct(*[F.lit(float(i == j)).alias(a) for j, a in enumerate("xyz")])) for i in range(3)]
        r = [[axes[i][a] for a in "xyz"] for i in range(3)]  # camera axes in the world: rows of its inverse rotation
        shift = [-sum((r[i][j] * F.get(f"t{side}", F.lit(j)) for j in range(3)), F.lit(0.0)) for i in range(3)]
        cam = [[*r[i], shift[i]] for i in range(3)]
        k = c(f"k{side}")
        return [F.array(*[k["fx"] * cam[0][j] + k["cx"] * cam[2][j] for j in range(4)]), F.array(*[k["fy"] * cam[1][j] + k["cy"] * cam[2][j] for j in range(4)]), F.array(*cam[2])]

    equations = []
    for side in "01":
        top, mid, last = rows(side)
        equations += [_scaled_minus(c(f"u{side}"), last, top), _scaled_minus(c(f"v{side}"), last, mid)]

    def solve(batches):
        for batch in batches:
            m = batch.column(batch.schema.get_field_index("_e"))
            out = batch.drop_columns(["_e"])
            systems = m.flatten().to_numpy(zero_copy_only=False).reshape(-1, 4, 4)
            x = np.linalg.svd(systems)[2][:, -1, :] if len(systems) else np.zeros((0, 4))
            with np.errstate(divide="ignore", invalid="ignore"):
                p = np.where(np.abs(x[:, 3:]) > 1e-8, x[:, :3] / x[:, 3:], np.nan)
            yield pa.record_batch([*out.columns, *[pa.array(p[:, i]) for i in range(3)]], names=[*out.schema.names, "x", "y", "z"])

    finite = ~F.exists(F.flatten(F.array(*equations)), lambda v: v.isNull() | F.isnan(v))
    schema = matches.schema.simpleString()[len("struct<") : -1]
    solved = matches.withColumn("_e", F.flatten(F.array(*equations))).where(finite).mapInArrow(solve, f"{schema},x:double,y:double,z:double")
    p = F.struct("x", "y", "z")
    ok = ~F.isnan("x")
    rays = []
    for side in "01":
        t = F.struct(*[F.get(f"t{side}", F.lit(i)).alias(a) for i, a in enumerate("xyz")])
        s = project(p, t, c(f"q{side}"), *[c(f"k{side}.{n}") for n in ("fx", "fy", "cx", "cy")])
        ok = ok & (s["z"] > 0.35) & (s["z"] < 6.0) & (F.hypot(s["u"] - c(f"u{side}"), s["v"] - c(f"v{side}")) < 6.0)
        rays.append([c(a) - F.get(f"t{side}", F.lit(i)) for i, a in enumerate("xyz")])
    dot = lambda a, b: sum((x * y for x, y in zip(a, b, strict=True)), F.lit(0.0))
    cosine = dot(*rays) / F.greatest(F.sqrt(dot(rays[0], rays[0]) * dot(rays[1], rays[1])), F.lit(1e-8))
    wide = F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))) > 0.8
    return solved.where(F.coalesce(ok & wide, F.lit(False))).select(*names, "x", "y", "z")


def camera_height_scale(cloud: DataFrame, cameras: DataFrame, height: float = CAMERA_HEIGHT) -> DataFrame:
    """Scale that puts each capture's cameras (capture_id, t, q) at their median `height` over the floor of its points:
    capture_id, scale, centre, floor_inliers, scale_source, degraded.

    The floor is the best plane across the cameras' mean up, within 2 % of the cloud's extent, of 40 points at least. Without
    one, or with cameras in it, the scale is 1 and degraded."""
    c, key = F.col, ["capture_id"]
    up = rotate_by_quaternion(c("q"), F.struct(F.lit(0.0).alias("x"), F.lit(-1.0).alias("y"), F.lit(0.0).alias("z")))
    seen = cameras.select("capture_id", *[F.get("t", F.lit(i)).alias(a) for i, a in enumerate("xyz")], *[up[a].alias(f"u{a}") for a in "xyz"])
    kind = next(f.dataType.simpleString() for f in cloud.schema if f.name == "capture_id")

    def run(key_, p, cam):
        xyz = np.stack([p.column(a).to_numpy() for a in "xyz"], axis=1) if p.num_rows else np.zeros((0, 3))
        at = np.stack([cam.column(a).to_numpy() for a in "xyz"], axis=1) if cam.num_rows else np.zeros((0, 3))
        scale, centre, n, source = 1.0, [0.0, 0.0, 0.0], 0, "failed_no_floor_plane"
        if len(xyz) >= 40 and len(at):
            mean = np.stack([cam.column(f"u{a}").to_numpy() for a in "xyz"], axis=1).mean(axis=0)
            mean /= max(np.linalg.norm(mean), 1e-8)
            extent = float(np.linalg.norm(np.ptp(xyz, axis=0)))
            plane = fit_plane(xyz, 0.02 * extent, mean, 0.8, 200, 1, 40)
            if plane:
                normal, middle, n, _ = plane
                over = float(np.median((at - middle) @ normal))
                centre, source = middle.tolist(), "failed_degenerate_scale"
                if abs(over) >= 1e-4:
                    scale, source = height / over, f"camera_height_prior_{height:.2f}m"
        row = [key_[0].as_py(), scale, centre, n, source, source.startswith("failed")]
        kinds = [(p if p.num_rows else cam).schema.field("capture_id").type, pa.float64(), pa.list_(pa.float64()), pa.int64(), pa.string(), pa.bool_()]
        return pa.table({m: pa.array([v], k) for m, v, k in zip(("capture_id", "scale", "centre", "floor_inliers", "scale_source", "degraded"), row, kinds, strict=True)})

    thin = sampled(cloud.select("capture_id", "ord", *[c(a).cast("double").alias(a) for a in "xyz"]), key, 8000)
    schema = f"capture_id {kind}, scale double, centre array<double>, floor_inliers long, scale_source string, degraded boolean"
    return thin.groupBy(*key).cogroup(seen.groupBy(*key)).applyInArrow(run, schema)


def scaled(cloud: DataFrame, scales: DataFrame) -> DataFrame:
    """Points moved away from their capture's floor centre by its scale."""
    j = cloud.join(scales.select("capture_id", "scale", "centre"), "capture_id")
    moved = lambda i, a: ((F.col(a) - F.get("centre", F.lit(i))) * F.col("scale") + F.get("centre", F.lit(i))).alias(a)
    return j.select(*[moved("xyz".index(n), n) if n in ("x", "y", "z") else F.col(n) for n in cloud.columns])


def depth_agreement(low: DataFrame, high: DataFrame, frames: int = 24, pixels: int = 400) -> DataFrame:
    """Median and 90th percentile of the gap between two depth cameras, a row a capture: frames, pixels, median_abs_m,
    p90_abs_m.

    low: capture_id, ts, v, u, mm, conf, width, height; high: capture_id, ts, v, u, mm, width, height. Of each capture 24
    even frames of low, each with the frame of high nearest within 50 ms; of a frame's confident pixels of 0.2 to 5 m (50 at
    least) 400 even ones, each against the pixel at the scaled place (0.2 to 8 m, 30 at least)."""
    from planimeter.operators.rooms import nearest_in_time

    c, key = F.col, ["capture_id"]
    times = low.select("capture_id", "ts").distinct()
    w = Window.partitionBy(*key).orderBy("ts")
    step = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(Window.partitionBy(*key)) / frames))
    picked = times.withColumns({"_i": F.row_number().over(w) - 1, "_s": step}).where((c("_i") % c("_s") == 0) & (c("_i") < c("_s") * frames)).select("capture_id", c("ts").alias("id"), "ts")
    others = high.select("capture_id", c("ts").alias("id"), "ts").distinct()
    met = nearest_in_time(picked, others, 0.05).select("capture_id", c("left_id").alias("ts"), c("right_id").alias("high_ts"))
    frame = Window.partitionBy("capture_id", "ts")
    good = low.join(met, ["capture_id", "ts"]).where((c("conf") >= 2) & (c("mm") > 200) & (c("mm") < 5000))
    good = good.withColumns({"_n": F.count(F.lit(1)).over(frame), "_k": F.row_number().over(frame.orderBy("v", "u")) - 1}).where("_n >= 50")
    m = F.least(F.lit(pixels), c("_n"))
    # Row k is one of m even places from 0 to n - 1 if some whole j has floor(j (n - 1) / (m - 1)) = k.
    j = F.ceil(c("_k") * (m - 1) / (c("_n") - 1) - 1e-9)
    good = good.where((j < m) & (F.floor(j * (c("_n") - 1) / (m - 1) + 1e-9) == c("_k")))
    size = high.groupBy("capture_id", c("ts").alias("high_ts")).agg(F.first("width").alias("_w"), F.first("height").alias("_h"))
    place = lambda at, own, other: F.least(F.greatest(F.rint(c(at) * c(other) / c(own)), F.lit(0.0)), c(other) - 1).cast("int")
    good = good.join(size, ["capture_id", "high_ts"]).select("capture_id", "ts", "high_ts", c("mm").alias("_low"), place("v", "height", "_h").alias("v"), place("u", "width", "_w").alias("u"))
    pairs = good.join(high.select("capture_id", c("ts").alias("high_ts"), "v", "u", "mm"), ["capture_id", "high_ts", "v", "u"]).where((c("mm") > 200) & (c("mm") < 8000))
    pairs = pairs.withColumn("_n", F.count(F.lit(1)).over(frame)).where("_n >= 30").withColumn("gap", F.abs(c("_low") - c("mm")) / 1000.0)
    q = F.percentile("gap", F.array(F.lit(0.5), F.lit(0.9)))
    g = pairs.groupBy(*key).agg(F.count_distinct("ts").alias("frames"), F.count(F.lit(1)).alias("pixels"), q.alias("q"))
    return g.select("capture_id", "frames", "pixels", F.round(c("q")[0], 4).alias("median_abs_m"), F.round(c("q")[1], 4).alias("p90_abs_m"))
