"""Layout steps that have no SQL twin, against plain Python."""

import math
import random

from pyspark.sql import functions as F

from planimeter.functions import expr
from planimeter.operators import layout


def plain_partitions(lines):
    """Lines (pos, score, support) of one capture, in order of position."""
    if len(lines) <= 2:
        return lines
    kept = []
    for line in lines:
        if kept and abs(line[0] - kept[-1][0]) < 0.5:
            if line[1] > kept[-1][1]:
                kept[-1] = line
        else:
            kept.append(line)
    if len(kept) <= 2:
        return kept
    strong = [x for x in kept if x[1] >= 0.38 * max(k[1] for k in kept) and x[2] >= 1.35]
    return strong if len(strong) >= 2 else sorted(sorted(kept, key=lambda x: -x[1])[:2])


def test_drop_weak_partitions(spark):
    rng = random.Random(7)
    rows = [(k, rng.uniform(0, 4), float(rng.randint(1, 9)), rng.uniform(0.5, 2.5)) for k in range(60) for _ in range(rng.randint(1, 9))]
    got = layout.drop_weak_partitions(spark.createDataFrame(rows, "capture int, pos double, score double, support_len double"), ["capture"])
    want = [(k, *x) for k in range(60) for x in plain_partitions(sorted(r[1:] for r in rows if r[0] == k))]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert layout.drop_weak_partitions(spark.createDataFrame([], "capture int, pos double, score double, support_len double"), ["capture"]).count() == 0


def test_project_undoes_backproject(spark):
    lit = lambda *v: [F.lit(float(x)) for x in v]
    k = lit(500, 510, 320, 240)
    q = F.array(*lit(0.1, -0.3, 0.2, 0.9))
    t = F.struct(*[F.lit(v).alias(a) for a, v in zip("xyz", (1.0, -2.0, 0.5))])
    cam = expr.backproject(*lit(100, 50, 2.5), *k)
    turned = expr.rotate_by_quaternion(q, cam)
    world = F.struct(*[(turned[a] + t[a]).alias(a) for a in "xyz"])
    r = spark.range(1).select(expr.project(world, t, q, *k).alias("p")).first().p
    assert all(math.isclose(a, b, abs_tol=1e-9) for a, b in zip(r, (100, 50, 2.5)))
    s = spark.range(1).select(expr.rescaled(*k, *lit(0.5, 0.25)).alias("p")).first().p
    assert tuple(s) == (250.0, 127.5, 160.0, 60.0)


def test_walls_need_points(spark):
    empty = spark.createDataFrame([], "capture int, ord int, x double, y double, z double, vertical boolean")
    assert layout.wall_band(empty, ["capture"]).count() == 0
    assert layout.manhattan_angle(empty, ["capture"]).count() == 0
    few = spark.createDataFrame([(1, i, i * 0.1, 1.0, None, None) for i in range(20)], empty.schema)
    assert layout.wall_band(few, ["capture"]).count() == 0
    assert [tuple(r) for r in layout.manhattan_angle(few, ["capture"]).collect()] == [(1, 0.0)]


def plain_spreads(cells):
    """n and sums of steps about each cell of one capture."""
    out = []
    for x, z in cells:
        d = [(a - x, b - z) for a, b in cells if abs(a - x) <= 4 and abs(b - z) <= 4]
        out.append((len(d), *[sum(f(*p) for p in d) for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a * a, lambda a, b: b * b, lambda a, b: a * b)]))
    return sorted(out)


def test_spreads_about_squares(spark):
    rng = random.Random(5)
    cells = {k: {(rng.randint(-9, 9), rng.randint(-130, 130)) for _ in range(900)} | {(x, z) for x in range(40, 52) for z in range(50, 62)} for k in range(3)}
    rows = [(k, *p, True) for k, ps in cells.items() for p in ps]
    got = layout._spreads(spark.createDataFrame(rows, "k int, cx long, cz long, _vote boolean"), ["k"]).collect()
    for k, ps in cells.items():
        assert sorted(tuple(r)[1:] for r in got if r.k == k) == plain_spreads(ps)


def test_angles_need_no_broadcast(spark):
    """Exploded points look small to the planner: none of them may be broadcast."""
    s = spark.range(50).select(F.col("id").alias("capture"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i"))
    p = s.select("capture", (F.col("i") * 0.03).alias("x"), (F.col("i") * 0.003).alias("z"))
    plan = layout.manhattan_angle(p, ["capture"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1


def plain_angle(spreads):
    """theta from the spreads (n, sx, sz, sxx, szz, sxz) of the squares that may vote."""
    bins = [0.0] * 90
    for n, sx, sz, sxx, szz, sxz in spreads:
        if n < 8:
            continue
        a, d, b = ((n * s - p * q) / (n * (n - 1.0)) for s, p, q in ((sxx, sx, sx), (szz, sz, sz), (sxz, sx, sz)))
        root = math.sqrt(((a - d) / 2) ** 2 + b * b)
        hi, lo = (a + d) / 2 + root, (a + d) / 2 - root
        if lo > 1e-6 and hi / lo >= 4:
            bins[min(int(0.5 * math.atan2(2 * b, a - d) % (math.pi / 2) / (math.pi / 180)), 89)] += hi / lo
    return (bins.index(max(bins)) + 0.5) * math.pi / 180


def test_every_square_votes(spark):
    """Two walls of different slopes, one square of each in every column: every second square in order is one wall's alone."""
    places = {k: sorted((x, z) for x in range(k * 20 - 2600, k * 20 + 2600) for z in (x // 3, 9000 + x // 2)) for k in (0, 1)}
    places[1] = sorted((x, -z) for x, z in places[1])
    rows = [(k, x * 0.05 + 0.02, z * 0.05 + 0.02) for k, ps in places.items() for x, z in ps]
    got = {r.k: r.theta for r in layout.manhattan_angle(spark.createDataFrame(rows + rows[:99], "k int, x double, z double"), ["k"]).collect()}
    parts = []
    for k, ps in places.items():
        seen = set(ps)
        about = [[(a - x, b - z) for a in range(x - 4, x + 5) for b in range(z - 4, z + 5) if (a, b) in seen] for x, z in ps]
        spreads = [(len(d), *(sum(f(*q) for q in d) for f in (lambda a, b: a, lambda a, b: b, lambda a, b: a * a, lambda a, b: b * b, lambda a, b: a * b))) for d in about]
        assert math.isclose(got[k], plain_angle(spreads), abs_tol=1e-12)
        parts.append((plain_angle(spreads), plain_angle(spreads[::2])))
    assert any(not math.isclose(*p) for p in parts)


def test_nearest_point_against_all_pairs(spark):
    """Clusters, points far off, copies, ties, no finite place, captures with one side."""
    rng = random.Random(9)
    lumps = [(rng.uniform(-9, 9), rng.uniform(-9, 9)) for _ in range(4)]
    place = lambda: rng.choice([(float(rng.randint(0, 3)), float(rng.randint(0, 3))), *[(x + rng.gauss(0, 0.1), z + rng.gauss(0, 0.1)) for x, z in lumps], (rng.uniform(-900, 900), 5.0)])
    nan, inf = float("nan"), float("inf")
    left = [(rng.randint(0, 2), i, *place()) for i in range(400)] + [(0, 900, None, 1.0), (0, 901, nan, 1.0), (1, 902, inf, 0.0), (3, 903, 0.0, 0.0), (4, 904, 1.0, 1.0)]
    right = [(rng.randint(0, 2), i, *place()) for i in range(500)] + [(0, -1, None, 1.0), (1, -2, nan, 0.0), (4, 3, None, 0.0), (4, 4, 1.0, None), (5, 5, 0.0, 0.0)]

    def order(a, b):
        if None in (a[2], a[3], b[2], b[3]):
            return (2, 0.0, b[1])
        d = (b[2] - a[2]) * (b[2] - a[2]) + (b[3] - a[3]) * (b[3] - a[3])
        return (1, 0.0, b[1]) if math.isnan(d) else (0, d, b[1])

    want = {a[1]: min(order(a, b) for b in right if b[0] == a[0]) for a in left if any(b[0] == a[0] for b in right)}
    schema = "k int, id int, x double, z double"
    got = {r.left_id: r for r in layout.nearest_point(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), ["k"]).collect()}
    assert {i: r.right_id for i, r in got.items()} == {i: w[2] for i, w in want.items()}
    assert all(got[i].distance == math.sqrt(w[1]) for i, w in want.items() if w[0] == 0) and got[900].distance is None
