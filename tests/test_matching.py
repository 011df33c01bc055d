"""Greedy folds and cells against plain Python."""

import math
import random

from pyspark.sql import functions as F

from planimeter.operators import matching, rooms, scoring
from planimeter.streaming.voxels import thin_stream


def test_greedy_lengths(spark):
    rng = random.Random(3)
    p = [(k, rng.randint(1, 9) / 2) for k in range(30) for _ in range(rng.randint(0, 5))]
    r = [(k, i, rng.randint(0, 9) / 2) for k in range(30) for i in range(rng.randint(0, 5))]
    want = []
    for k in range(30):
        left = [x[2] for x in r if x[0] == k]
        for a in sorted((x[1] for x in p if x[0] == k), reverse=True):
            b = left.pop(min(range(len(left)), key=lambda i: abs(a - left[i]))) if left else None
            want.append((k, a, b, "matched" if b is not None else "unmatched"))
        want += [(k, None, b, "reference_only") for b in left]
    got = matching.greedy_lengths(spark.createDataFrame(p, "k int, length double"), spark.createDataFrame(r, "k int, ord int, length double"), ["k"])
    assert sorted((tuple(x)[:4] for x in got.collect()), key=repr) == sorted(want, key=repr)


def plain_walls(pred, gt):
    last = {w[1]: w for w in pred if w[1]}
    pairs = [(g[0], last[g[1]][0]) for g in gt if g[1] in last]
    left = [w for w in pred if w[0] not in {b for _, b in pairs}]
    shape = lambda w: (math.atan2(w[5] - w[3], w[4] - w[2]) % math.pi, (w[2] + w[4]) / 2, (w[3] + w[5]) / 2)
    for g in gt:
        if g[1] in last:
            continue
        a, x, z = shape(g)
        near = []
        for w in left:
            b, u, v = shape(w)
            if min(abs(a - b), math.pi - abs(a - b)) <= math.radians(20):
                near.append((round(math.hypot(u - x, v - z), 6), w[1] or "", w[0]))
        best = min(near)[2] if near else None
        pairs.append((g[0], best))
        left = [w for w in left if w[0] != best]
    return pairs + [(None, w[0]) for w in left]


def test_match_truth_walls(spark):
    rng = random.Random(5)
    def wall(k, i):
        return (k, i, rng.choice([None, None, "a", "b", "c"]), *[rng.uniform(0, 4) for _ in range(4)])

    p = [wall(k, i) for k in range(25) for i in range(rng.randint(0, 6))]
    t = [wall(k, i) for k in range(25) for i in range(rng.randint(0, 6))]
    schema = "k int, ord int, id string, x0 double, z0 double, x1 double, z1 double"
    got = matching.match_truth_walls(spark.createDataFrame(p, schema), spark.createDataFrame(t, schema), ["k"])
    want = [(k, *m) for k in range(25) for m in plain_walls([x[1:] for x in p if x[0] == k], [x[1:] for x in t if x[0] == k])]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_candidate_cells(spark):
    run = lambda a, b: [(a, b)]
    lines = [(1, "x", 0.0, -0.05, 0.05, run(0.0, 6.0)), (1, "x", 3.0, 2.95, 3.05, run(0.0, 3.0)), (1, "x", 4.0, 3.95, 4.05, run(0.0, 3.0)), (1, "z", 0.0, -0.05, 0.05, run(0.0, 3.0)), (1, "z", 3.0, 2.95, 3.05, run(0.0, 3.0)), (1, "z", 6.0, 5.95, 6.05, run(9.0, 9.5))]
    ldf = spark.createDataFrame(lines, "k int, axis string, pos double, face_lo double, face_hi double, runs array<struct<a:double,b:double>>")
    pts = spark.createDataFrame([(1, 1.0, 1.0), (1, 0.1, 1.0), (2, 1.0, 1.0)], "k int, x double, z double")
    got = [tuple(r) for r in matching.candidate_cells(ldf, pts, ["k"]).collect()]
    assert got == [(1, 0.05, 2.95, 0.05, 2.95, 0.0, 3.0, 0.0, 3.0, 1)]
    crowd = spark.range(20_000).select(F.lit(1).alias("k"), F.lit(1.0).alias("x"), F.lit(1.0).alias("z"))
    assert matching.candidate_cells(ldf, crowd, ["k"]).count() == 0


def test_summary_counts_decided_rows(spark):
    rows = [("a", "matched", 0.01, True), ("a", "matched", 0.05, False), ("a", "missed", None, None), ("a", "phantom", None, False), ("b", "missed", None, None)]
    df = spark.createDataFrame(rows, "k string, status string, abs_error double, ok boolean")
    got = {r.k: tuple(r)[1:] for r in scoring.summary(df, ["k"], F.col("ok")).collect()}
    assert got == {"a": (4, 1, 0.333333, 1, 1, 0.05), "b": (1, 0, None, 1, 0, None)}


def test_reachable_rooms_by_links(spark):
    rooms_ = spark.createDataFrame([(k, r) for k in "xy" for r in "abcdef"], "capture_id string, room_id string")
    links = spark.createDataFrame([("x", "b", "a"), ("x", "c", "d"), ("x", "d", "b"), ("x", "e", "ghost"), ("y", "f", "e"), ("y", "f", "f")], "capture_id string, room_a string, room_b string")
    got = {(r.capture_id, r.room_id): r.component for r in rooms.reachable(links, rooms_).collect()}
    assert got == {("x", r): c for r, c in zip("abcdef", "aaaaef")} | {("y", r): c for r, c in zip("abcdef", "abcdee")}


def test_stream_thins_by_voxel(spark, tmp_path):
    rows = [("c", f"2026-01-01 00:0{i % 3}:00", 0.02 * (i % 7), 0.0, 0.01 * (i % 5)) for i in range(200)]
    df = spark.createDataFrame(rows, "capture_id string, ts string, x double, y double, z double").withColumn("ts", F.col("ts").cast("timestamp"))
    df.repartition(3).write.parquet(f"{tmp_path}/in")
    live = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = thin_stream(live, 0.025).writeStream.format("memory").queryName("thinned").outputMode("append").option("checkpointLocation", f"{tmp_path}/check").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r.kx, r.kz) for r in spark.table("thinned").collect()}
    want = {(int(x / 0.025), int(z / 0.025)) for _, _, x, _, z in rows}
    assert got == want and spark.table("thinned").count() == len(want)


def test_overlaps_of_many_shapes(spark):
    """Rectangles by their bounds, others by clipping, all pairs by their squares; no room may be lost for its size."""
    rng = random.Random(11)
    rows = []
    for i in range(60):
        x, z, w, d = rng.uniform(-9, 9), rng.uniform(-9, 9), rng.choice((0.3, 1.5, 4.0)), rng.choice((0.3, 1.5, 12.0))
        corners = [(x, z), (x + w, z), (x + w, z + d), (x, z + d)]
        corners = corners[:3] if i % 3 == 0 else [(x, z), (x, z + d), (x + w, z + d), (x + w, z)] if i % 3 == 1 else corners
        rows.append((i % 2, i, corners))
    df = spark.createDataFrame(rows, "capture_id int, room_id int, polygon array<struct<x:double,z:double>>")
    got = {(r.room_a, r.room_b): r.area_m2 for r in rooms.convex_overlaps(df).collect()}

    def area(a, b):
        for (px, pz), (qx, qz) in zip(b, b[1:] + b[:1], strict=True):
            turn = 1 if sum((u - px) * (pz - qz) + (v - pz) * (qx - px) for u, v in b) > 0 else -1
            side = lambda p: turn * ((p[0] - px) * (pz - qz) + (p[1] - pz) * (qx - px))  # noqa: B023, E731
            new = []
            for p, q in zip(a, a[1:] + a[:1], strict=True):
                s, t = side(p), side(q)
                if s >= 0:
                    new.append(p)
                if s * t < 0:
                    new.append((p[0] + s / (s - t) * (q[0] - p[0]), p[1] + s / (s - t) * (q[1] - p[1])))
            a = new
        return abs(sum(p[0] * q[1] - q[0] * p[1] for p, q in zip(a, a[1:] + a[:1], strict=True))) / 2 if a else 0

    want = {(a[1], b[1]): area(a[2], b[2]) for a in rows for b in rows if a[0] == b[0] and a[1] < b[1]}
    assert {k for k, v in got.items() if v > 1e-5} == {k for k, v in want.items() if v > 1e-5}
    assert all(math.isclose(v, want[k], abs_tol=1e-5) for k, v in got.items())


def test_ceilings_of_many_floors(spark):
    """Against all pairs: shared and own polygons, several heights, points on limits, nulls."""
    rng = random.Random(2)
    floors = []
    for i in range(80):
        x, z, w = rng.uniform(-5, 5), rng.uniform(-5, 5), rng.choice((0.4, 3.0, 9.0))
        own = [(x, z), (x + w, z), (x + w / 2, z + w)]
        floors.append((i % 3, i, own if i % 2 else [(-4.0, -4.0), (4.0, -4.0), (4.0, 4.0), (-4.0, 4.0)], rng.choice((0.0, 0.3, 0.6, rng.uniform(-1, 1)))))
    floors.append((0, 99, [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0)], None))
    points = [(rng.randint(0, 2), rng.uniform(-6, 6), rng.choice((1.8, 2.1, 2.4, 6.0, 6.3, rng.uniform(-2, 8))), rng.uniform(-6, 6)) for _ in range(400)] + [(0, None, 2.0, 1.0), (0, 1.0, None, 1.0)]

    def inside(x, z, poly):
        return sum((p[1] > z) != (q[1] > z) and x < (q[0] - p[0]) * (z - p[1]) / (q[1] - p[1]) + p[0] for p, q in zip(poly, poly[1:] + poly[:1], strict=True)) % 2 == 1

    want = {i: min((y - base for s, x, y, z in points if s == k and None not in (x, y) and base is not None and 1.8 <= y - base <= 6 and inside(x, z, poly)), default=None) for k, i, poly, base in floors}
    f = spark.createDataFrame(floors, "scene int, id int, polygon array<struct<x:double,z:double>>, y double")
    p = spark.createDataFrame(points, "scene int, x double, y double, z double")
    assert {r.floor_id: r.ceiling_height_m for r in matching.ceilings_above(f, p, ["scene"]).collect()} == want
