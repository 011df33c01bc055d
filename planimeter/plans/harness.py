"""Queries that drive the operators over the harness tables, each with its DuckDB twin.

embeddings give points (three dimensions a point, one capture a label), lineitem and orders give large
measurement tables, and rooms come from lattices. Green twins show arithmetic and semantics, not accuracy."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from planimeter.functions import expr
from planimeter.operators import damage, lines, points, rooms, scoring

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cloud(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _t(spark, sf_dir, "embeddings")
    axes = [F.col("embedding")[i].cast("double").alias(a) for i, a in enumerate("xyz")]
    return e.select((F.col("label") % 2).alias("capture_id"), F.col("vec_id").alias("ord"), F.col("vec_id").cast("int").alias("frame_index"), *axes)


CLOUD = "WITH p AS (SELECT label % 2 AS capture_id, vec_id AS ord, vec_id::INT AS frame_index, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS y, embedding[3]::DOUBLE AS z FROM embeddings)"


@query(CLOUD + """
SELECT capture_id, floor(x / 0.1)::BIGINT AS kx, floor(y / 0.1)::BIGINT AS ky, floor(z / 0.1)::BIGINT AS kz, count(*) AS n, min(ord) AS ord, round(arg_min(x, ord), 4) AS x
FROM p GROUP BY ALL""")
def voxel_downsample(spark, sf_dir):
    v = points.voxel_downsample(cloud(spark, sf_dir), 0.1)
    return v.select("capture_id", "kx", "ky", "kz", "n", "ord", F.round("x", 4).alias("x"))


@query("""
WITH a AS (SELECT s.side, j.j, k.k, h.h FROM range(0, 2) s(side), range(0, 61) j(j), range(7, 51) k(k), range(0, 2) h(h)),
w AS (SELECT (side * 400 + CASE WHEN side = 0 THEN 2 * h ELSE -2 * h END) / 100.0::DOUBLE AS x, k * 5 / 100.0::DOUBLE AS y, j * 5 / 100.0::DOUBLE AS z FROM a WHERE j % 7 <> 0 OR k < 20),
t AS (SELECT *, floor(x / 0.05)::BIGINT AS cx, floor(z / 0.05)::BIGINT AS cz FROM w)
SELECT cx, cz, count(*) AS n FROM t GROUP BY 1, 2 HAVING max(y) - min(y) >= 0.65 AND max(y) >= 1.15 AND count(*) FILTER (y > 0.45 AND y < 1.6) >= 3""")
def vertical_columns(spark, sf_dir):
    r = lambda n, a, b: spark.range(a, b).withColumnRenamed("id", n)
    w = r("side", 0, 2).crossJoin(r("j", 0, 61)).crossJoin(r("k", 7, 51)).crossJoin(r("h", 0, 2)).where("j % 7 <> 0 or k < 20")
    x = (F.col("side") * 400 + F.when(F.col("side") == 0, 2 * F.col("h")).otherwise(-2 * F.col("h"))) / 100.0
    w = w.select(F.lit("room").alias("capture_id"), x.alias("x"), (F.col("k") * 5 / 100.0).alias("y"), (F.col("j") * 5 / 100.0).alias("z"))
    tall = points.vertical_columns(w)
    return tall.groupBy(F.floor(F.col("x") / 0.05).alias("cx"), F.floor(F.col("z") / 0.05).alias("cz")).agg(F.count(F.lit(1)).alias("n"))


FLOOR = """
, q AS (SELECT {keys}, quantile_cont(y, 0.01) AS p1 FROM {src} GROUP BY ALL HAVING count(*) >= 80),
band AS (SELECT p.* FROM {src} p JOIN q USING ({keys}) WHERE y >= p1 - 0.02 AND y <= p1 + 0.25),
r AS (SELECT *, min(y) OVER w AS lo, (max(y) OVER w - min(y) OVER w) / 40 AS wd, count(*) OVER w AS nb FROM band WINDOW w AS (PARTITION BY {keys})),
b AS (SELECT {keys}, CASE WHEN wd > 0 THEN least(floor((y - lo) / wd), 39) ELSE 0 END AS bin, count(*) AS c, any_value(lo) AS lo, any_value(wd) AS wd FROM r WHERE nb >= 40 GROUP BY ALL),
m AS (SELECT {keys}, arg_max(lo + (bin + 0.5) * wd, c * 1000 - bin) AS mode, max(c) AS n FROM b GROUP BY ALL)"""


@query(CLOUD + FLOOR.format(keys="capture_id", src="p") + " SELECT capture_id, round(mode, 4) AS mode, n FROM m")
def floor_mode(spark, sf_dir):
    return points.floor_mode(cloud(spark, sf_dir)).select("capture_id", F.round("mode", 4).alias("mode"), "n")


@query("""
WITH p AS (SELECT l_returnflag AS capture_id, l_orderkey % 100000 AS fi, l_discount * 3 + l_tax AS y FROM lineitem),
c AS (SELECT capture_id, quantile_cont(fi, 0.25) AS q1, quantile_cont(fi, 0.5) AS q2, quantile_cont(fi, 0.75) AS q3 FROM p GROUP BY 1),
h AS (SELECT capture_id, (fi >= q1)::INT + (fi >= q2)::INT + (fi >= q3)::INT AS chunk, y FROM p JOIN c USING (capture_id)),
cnt AS (SELECT capture_id, chunk, count(*) AS n FROM h GROUP BY ALL)""" + FLOOR.format(keys="capture_id, chunk", src="h") + """
SELECT cnt.capture_id, cnt.chunk, cnt.n, CASE WHEN cnt.n >= 100 AND abs(mode) <= 0.25 THEN round(mode, 4) ELSE 0 END AS shift FROM cnt LEFT JOIN m USING (capture_id, chunk)""")
def chunk_drift(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("capture_id"), (F.col("l_orderkey") % 100000).alias("frame_index"), (F.col("l_discount") * 3 + F.col("l_tax")).alias("y"))
    return points.chunk_drift(l).select("capture_id", "chunk", "n", F.round("shift", 4).alias("shift"))


@query(CLOUD + """
, c AS (SELECT capture_id, count(*) AS n, quantile_cont(x, 0.05) - 0.1 AS xl, quantile_cont(x, 0.95) + 0.1 AS xh, quantile_cont(y, 0.05) - 0.1 AS yl, quantile_cont(y, 0.95) + 0.1 AS yh, quantile_cont(z, 0.05) - 0.1 AS zl, quantile_cont(z, 0.95) + 0.1 AS zh FROM p GROUP BY 1)
SELECT p.capture_id, p.ord FROM p JOIN c USING (capture_id) WHERE c.n < 30 OR (x BETWEEN xl AND xh AND y BETWEEN yl AND yh AND z BETWEEN zl AND zh)""")
def fence_outliers(spark, sf_dir):
    return points.fence(cloud(spark, sf_dir), slack=0.1).select("capture_id", "ord")


@query("""
WITH p AS (SELECT label AS capture_id, embedding[1]::DOUBLE AS ax, embedding[2]::DOUBLE AS az, embedding[3]::DOUBLE AS bx, embedding[4]::DOUBLE AS bz FROM embeddings),
s AS (SELECT capture_id, count(*) AS n, atan2(covar_pop(ax, bz) - covar_pop(az, bx), covar_pop(ax, bx) + covar_pop(az, bz)) AS yaw, avg(ax) AS ax, avg(az) AS az, avg(bx) AS bx, avg(bz) AS bz FROM p GROUP BY 1)
SELECT capture_id, n, round(yaw, 4) AS yaw, round(bx - (cos(yaw) * ax - sin(yaw) * az), 4) AS tx, round(bz - (sin(yaw) * ax + cos(yaw) * az), 4) AS tz FROM s""")
def rigid_fit_2d(spark, sf_dir):
    e = _t(spark, sf_dir, "embeddings")
    pairs = e.select(F.col("label").alias("capture_id"), *[F.col("embedding")[i].cast("double").alias(c) for i, c in enumerate(("ax", "az", "bx", "bz"))])
    return points.rigid_fit_2d(pairs).select("capture_id", "n", *[F.round(c, 4).alias(c) for c in ("yaw", "tx", "tz")])


PEAKS = """
WITH v AS (SELECT l_returnflag AS line, l_extendedprice / 20000.0 AS value FROM lineitem),
q AS (SELECT line, quantile_cont(value, 0.005) AS lo, quantile_cont(value, 0.995) AS hi, count(*) AS n FROM v GROUP BY 1 HAVING count(*) >= 30 AND quantile_cont(value, 0.995) - quantile_cont(value, 0.005) >= 0.4),
g AS (SELECT line, lo, ceil((hi + 0.02 - lo) / 0.02 - 1e-9)::BIGINT - 1 AS bins FROM q),
c AS (SELECT line, least(floor((value - lo) / 0.02), bins - 1)::BIGINT AS bin, count(*) AS c FROM v JOIN g USING (line) WHERE value >= lo AND value <= lo + bins * 0.02 GROUP BY ALL),
d AS (SELECT g.line, lo, b.bin, coalesce(c.c, 0) AS c FROM g CROSS JOIN LATERAL (SELECT unnest(range(0, g.bins)) AS bin) b LEFT JOIN c ON c.line = g.line AND c.bin = b.bin),
s AS (SELECT *, (coalesce(lag(c, 2) OVER w, 0) + 2 * coalesce(lag(c) OVER w, 0) + 3 * c + 2 * coalesce(lead(c) OVER w, 0) + coalesce(lead(c, 2) OVER w, 0)) / 9.0::DOUBLE AS s FROM d WINDOW w AS (PARTITION BY line ORDER BY bin)),
e AS (SELECT *, lag(s) OVER w AS l, lead(s) OVER w AS r, max(s) OVER (PARTITION BY line) AS top FROM s WINDOW w AS (PARTITION BY line ORDER BY bin)),
k AS (SELECT *, CASE WHEN l IS NULL OR r IS NULL OR abs(l - 2 * s + r) < 1e-6 THEN 0 ELSE greatest(-0.5, least(0.5, 0.5 * (l - r) / (l - 2 * s + r))) END AS sh FROM e WHERE s >= coalesce(l, -1) AND s >= coalesce(r, -1) AND s >= 0.22 * top AND c >= 15)
"""


def _line_values(spark, sf_dir):
    return _t(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("line"), (F.col("l_extendedprice") / 20000.0).alias("value"))


@query(PEAKS + "SELECT line, round(lo + (bin + 0.5 + sh) * 0.02, 4) AS pos, round(s, 4) AS score, c AS n FROM k")
def wall_peaks(spark, sf_dir):
    return lines.wall_peaks(_line_values(spark, sf_dir), ["line"]).select("line", F.round("pos", 4).alias("pos"), F.round("score", 4).alias("score"), "n")


@query()
def peak_merge(spark, sf_dir):
    return lines.merge_peaks(lines.wall_peaks(_line_values(spark, sf_dir), ["line"]), ["line"])


RUNS = """
WITH v AS (SELECT event_type || '-' || (user_id % 4) AS line, value / 10.0 AS along FROM events WHERE value IS NOT NULL),
base AS (SELECT line, min(along) AS lo FROM v GROUP BY 1 HAVING count(*) >= {least}),
c AS (SELECT line, floor((along - lo) / 0.05)::BIGINT AS bin, count(*) AS c FROM v JOIN base USING (line) GROUP BY ALL),
m AS (SELECT line, max(bin) AS last FROM c GROUP BY 1),
d AS (SELECT m.line, lo, b.bin, coalesce(c.c, 0) AS c FROM m JOIN base USING (line) CROSS JOIN LATERAL (SELECT unnest(range(0, m.last + 1)) AS bin) b LEFT JOIN c ON c.line = m.line AND c.bin = b.bin),
"""


def _along(spark, sf_dir):
    e = _t(spark, sf_dir, "events").where("value is not null")
    return e.select(F.concat("event_type", F.lit("-"), (F.col("user_id") % 4).cast("string")).alias("line"), (F.col("value") / 10.0).alias("along"))


@query(RUNS.format(least=10) + """
i AS (SELECT line, min(bin) AS f, max(bin) AS l FROM (SELECT *, bin - row_number() OVER (PARTITION BY line ORDER BY bin) AS g FROM d WHERE c >= 3) GROUP BY line, g),
j AS (SELECT *, CASE WHEN f - lag(l) OVER w - 1 > 5 THEN 1 WHEN lag(l) OVER w IS NULL THEN 1 ELSE 0 END AS nw FROM i WINDOW w AS (PARTITION BY line ORDER BY f)),
s AS (SELECT line, min(f) AS f, max(l) AS l FROM (SELECT *, sum(nw) OVER (PARTITION BY line ORDER BY f) AS id FROM j) GROUP BY line, id)
SELECT s.line, round(any_value(d.lo) + s.f * 0.05, 4) AS a, round(any_value(d.lo) + (s.l + 1) * 0.05, 4) AS b, sum(d.c)::BIGINT AS n FROM s JOIN d ON d.line = s.line AND d.bin BETWEEN s.f AND s.l GROUP BY s.line, s.f, s.l HAVING (s.l + 1 - s.f) * 0.05 >= 0.45 - 1e-9""")
def support_runs(spark, sf_dir):
    return lines.support_runs(_along(spark, sf_dir), ["line"]).select("line", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), "n")


@query(RUNS.format(least=8) + """
f AS (SELECT *, c >= 2 OR (c = 1 AND (coalesce(lag(c) OVER w, 0) > 0 OR coalesce(lead(c) OVER w, 0) > 0)) AS fl FROM d WINDOW w AS (PARTITION BY line ORDER BY bin)),
i AS (SELECT line, any_value(lo) AS lo, min(bin) AS f, max(bin) AS l, sum(c)::BIGINT AS n FROM (SELECT *, bin - row_number() OVER (PARTITION BY line ORDER BY bin) AS g FROM f WHERE fl) GROUP BY line, g)
SELECT line, round(lo + f * 0.05, 4) AS a, round(lo + (l + 1) * 0.05, 4) AS b, n FROM i WHERE (l + 1 - f) * 0.05 >= 0.45 - 1e-9""")
def sparse_runs(spark, sf_dir):
    return lines.sparse_runs(_along(spark, sf_dir), ["line"]).select("line", F.round("a", 4).alias("a"), F.round("b", 4).alias("b"), "n")


# Lines with many values and lines with few, repeated values among them; 1 / 128 is exact in binary.
STATIONS = """
WITH v AS (SELECT 's' || l_suppkey AS line, epoch(l_shipdate) / 86400.0 / 128 AS along FROM lineitem UNION ALL SELECT 'o' || l_orderkey, l_quantity / 128.0 FROM lineitem),
g AS (SELECT *, along - lag(along) OVER (PARTITION BY line ORDER BY along) AS gap FROM v),
c AS (SELECT line, count(*) AS n, count(*) FILTER (gap > 1e-4) AS w, quantile_cont(gap, 0.95) FILTER (gap > 1e-4) AS p95, quantile_cont(gap, 0.5) FILTER (gap > 1e-4) AS mid FROM g GROUP BY 1),
m AS (SELECT g.line, along, gap, CASE WHEN gap IS NULL OR n < 3 THEN 1 WHEN w < 3 THEN 0 WHEN p95 > greatest(0.02, 4 * mid) THEN (gap >= 0.5 * p95)::INT ELSE 1 END AS nw FROM g JOIN c USING (line)),
n AS (SELECT *, sum(nw) OVER (PARTITION BY line ORDER BY along, gap DESC NULLS FIRST ROWS UNBOUNDED PRECEDING) AS st FROM m),
t AS (SELECT line, st::BIGINT AS station, quantile_cont(along, 0.5) AS centre, count(*) AS n FROM n GROUP BY ALL)
"""


def _station_values(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")
    dates = l.select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("line"), (F.unix_timestamp("l_shipdate") / 86400.0 / 128).alias("along"))
    return dates.unionByName(l.select(F.concat(F.lit("o"), F.col("l_orderkey").cast("string")).alias("line"), (F.col("l_quantity") / 128.0).alias("along")))


@query(STATIONS + "SELECT line, station, round(centre, 4) AS centre, n FROM t")
def stations(spark, sf_dir):
    return lines.station_centres(_station_values(spark, sf_dir), ["line"]).select("line", "station", F.round("centre", 4).alias("centre"), "n")


@query(STATIONS + """, d AS (SELECT *, centre - lag(centre) OVER (PARTITION BY line ORDER BY centre) AS d FROM t)
SELECT line, round(CASE WHEN count(*) >= 3 THEN coalesce(quantile_cont(d, 0.5) FILTER (d > 1e-4 AND d < 0.15), 0.02) ELSE 0.02 END, 4) AS pitch FROM d GROUP BY 1""")
def local_pitch(spark, sf_dir):
    return lines.local_pitch(_station_values(spark, sf_dir), ["line"]).withColumn("pitch", F.round("pitch", 4))


def _centre(side: str) -> str:
    a, b = f"({side} - half)", f"({side} + half)"
    return f"""
c{side} AS (SELECT wall, quantile_cont(({a} + {b}) / 2, 0.5) AS m FROM v WHERE half IS NOT NULL GROUP BY 1),
k{side} AS (SELECT wall, any_value(m) AS m, count(*) FILTER ({a} - 1e-9 <= m AND m <= {b} + 1e-9) AS n, max({a}) FILTER ({a} - 1e-9 <= m AND m <= {b} + 1e-9) AS lo, min({b}) FILTER ({a} - 1e-9 <= m AND m <= {b} + 1e-9) AS hi FROM v JOIN c{side} USING (wall) WHERE half IS NOT NULL GROUP BY 1),
i{side} AS (SELECT wall, n >= 2 AND lo - 1e-6 <= hi AS met, CASE WHEN n >= 2 AND lo - 1e-6 <= hi THEN (lo + hi) / 2 ELSE m END AS at FROM k{side})"""


@query("""
WITH v AS (SELECT l_partkey AS wall, l_quantity / 50.0 AS lft, l_quantity / 50.0 + 0.75 + l_discount AS rgt, CASE WHEN l_partkey % 3 > 0 THEN 0.3 + l_tax END AS half, CASE WHEN l_partkey % 5 = 0 OR l_linenumber < 3 THEN 'sparse_wall_termination' WHEN l_linenumber < 7 THEN 'wall_termination' END AS how FROM lineitem),
a AS (SELECT wall, count(*) AS n, bool_and(half IS NOT NULL) AS ready, quantile_cont(lft, 0.5) AS ml, quantile_cont(rgt, 0.5) AS mr, quantile_cont(rgt - lft, 0.5) AS mw, bool_and(coalesce(how = 'sparse_wall_termination', false)) AS thin, max(how) AS how FROM v GROUP BY 1),
s AS (SELECT wall, quantile_cont(abs(rgt - lft - mw), 0.5) AS s FROM v JOIN a USING (wall) GROUP BY 1),""" + _centre("lft") + "," + _centre("rgt") + """,
j AS (SELECT a.*, s.s, CASE WHEN ready THEN ilft.at ELSE ml END AS x, CASE WHEN ready THEN irgt.at ELSE mr END AS y, ready AND coalesce(ilft.met, false) AND coalesce(irgt.met, false) AS met FROM a JOIN s USING (wall) LEFT JOIN ilft USING (wall) LEFT JOIN irgt USING (wall))
SELECT wall, round(x, 4) AS lft, round(y, 4) AS rgt, n AS frames, CASE WHEN thin THEN 'sparse_wall_termination' WHEN n = 1 AND how = 'wall_termination' THEN how WHEN n = 1 THEN 'single_frame_unobserved_interval' ELSE 'multi_frame_wall_termination' END AS method,
round(CASE WHEN thin THEN greatest(0.35, least(0.62, 0.52 + 0.04 * (n - 1) - s / 0.06)) WHEN n = 1 AND how = 'wall_termination' THEN 0.8 WHEN n = 1 THEN 0.45 ELSE greatest(0.15, least(0.95, 1 - s / 0.06)) END, 2) AS confidence, CASE WHEN met THEN 'interval_intersection' ELSE 'median_midpoint' END AS localization FROM j WHERE y > x""")
def jamb_aggregate(spark, sf_dir):
    c = F.col
    q, half = c("l_quantity") / 50.0, F.when(c("l_partkey") % 3 > 0, 0.3 + c("l_tax"))
    how = F.when((c("l_partkey") % 5 == 0) | (c("l_linenumber") < 3), lines.SPARSE).when(c("l_linenumber") < 7, lines.DENSE)
    v = _t(spark, sf_dir, "lineitem").select(c("l_partkey").alias("wall"), q.alias("left"), (q + 0.75 + c("l_discount")).alias("right"), half.alias("half_left"), half.alias("half_right"), how.alias("method"))
    j = lines.aggregate_jambs(v, ["wall"])
    return j.select("wall", F.round("left", 4).alias("lft"), F.round("right", 4).alias("rgt"), "frames", "method", "confidence", "localization")


@query("""
WITH b AS (SELECT l_partkey AS wall, l_quantity / 50.0 AS lo, l_quantity / 50.0 + 0.3 AS hi FROM lineitem),
m AS (SELECT wall, quantile_cont((lo + hi) / 2, 0.5) AS m FROM b GROUP BY 1),
o AS (SELECT wall, any_value(m) AS m, count(*) FILTER (lo - 1e-9 <= m AND m <= hi + 1e-9) AS n, max(lo) FILTER (lo - 1e-9 <= m AND m <= hi + 1e-9) AS lo, min(hi) FILTER (lo - 1e-9 <= m AND m <= hi + 1e-9) AS hi FROM b JOIN m USING (wall) GROUP BY 1)
SELECT wall, round(CASE WHEN n >= 2 AND lo <= hi THEN (lo + hi) / 2 ELSE m END, 4) AS centre, n FROM o""")
def interval_centre(spark, sf_dir):
    b = _t(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("wall"), (F.col("l_quantity") / 50.0).alias("lo"), (F.col("l_quantity") / 50.0 + 0.3).alias("hi"))
    return lines.interval_centre(b, ["wall"]).select("wall", F.round("centre", 4).alias("centre"), "n")


@query("""
WITH l AS (SELECT user_id % 50 AS c, event_id AS id, epoch(ts) AS ts FROM events WHERE event_id % 2 = 0),
r AS (SELECT user_id % 50 AS c, event_id AS id, epoch(ts) AS ts FROM events WHERE event_id % 2 = 1),
j AS (SELECT l.c AS capture_id, l.id AS left_id, r.id AS right_id, abs(l.ts - r.ts) AS gap, row_number() OVER (PARTITION BY l.c, l.id ORDER BY abs(l.ts - r.ts), r.ts, r.id) AS k FROM l JOIN r ON l.c = r.c AND abs(l.ts - r.ts) <= 600)
SELECT capture_id, left_id, right_id, round(gap, 3) AS gap FROM j WHERE k = 1""")
def nearest_frame(spark, sf_dir):
    e = _t(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("capture_id"), F.col("event_id").alias("id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("ts"))
    n = rooms.nearest_in_time(e.where("id % 2 = 0"), e.where("id % 2 = 1"), 600)
    return n.withColumn("gap", F.round("gap", 3))


# Rooms that touch as the photo fixture's do (three walls shared, none overlapping).
FOUR = "(VALUES ('connector', 4.0, 0.6, 5.4, 2.4), ('room_01', 0.0, 0.0, 4.0, 3.0), ('room_02', 5.4, 0.0, 9.0, 3.2), ('room_03', 0.4, 3.0, 3.4, 5.6)) r(room_id, x0, z0, x1, z1)"


def four_rooms(spark: SparkSession) -> DataFrame:
    """Four touching rectangles as polygons."""
    r = spark.sql(f"SELECT room_id, x0 * 1.0D AS x0, z0 * 1.0D AS z0, x1 * 1.0D AS x1, z1 * 1.0D AS z1 FROM {FOUR}")
    corner = lambda x, z: F.struct(F.col(x).alias("x"), F.col(z).alias("z"))
    return r.select(F.lit("property").alias("capture_id"), "room_id", F.array(corner("x0", "z0"), corner("x1", "z0"), corner("x1", "z1"), corner("x0", "z1")).alias("polygon"))


@query(f"SELECT room_id, round(((x1 - x0) * (z1 - z0))::DOUBLE, 4) AS area_m2 FROM {FOUR}")
def polygon_area(spark, sf_dir):
    return four_rooms(spark).select("room_id", F.round(expr.shoelace(F.col("polygon")), 4).alias("area_m2"))


@query("SELECT * FROM (VALUES ('connector', 'room_01', 0.0::DOUBLE, 1.8::DOUBLE), ('connector', 'room_02', 0.0, 1.8), ('room_01', 'room_03', 0.0, 3.0)) t(room_a, room_b, gap_m, shared_length_m)")
def shared_edges(spark, sf_dir):
    s = rooms.shared_edges(four_rooms(spark))
    return s.select("room_a", "room_b", F.round("gap_m", 4).alias("gap_m"), F.round("shared_length_m", 4).alias("shared_length_m"))


@query("SELECT * FROM (VALUES ('room_02', 'room_03', 'phantom'), ('connector', 'room_02', 'missed')) t(room_a, room_b, status)")
def adjacency_diff(spark, sf_dir):
    truth = rooms.shared_edges(four_rooms(spark)).select("capture_id", "room_a", "room_b")
    predicted = truth.where("room_b <> 'room_02'").select("capture_id", F.col("room_b").alias("room_a"), F.col("room_a").alias("room_b"))
    wrong = spark.sql("SELECT 'property' AS capture_id, 'room_03' AS room_a, 'room_02' AS room_b")
    return rooms.link_difference(predicted.unionByName(wrong), truth).select("room_a", "room_b", "status")


@query("SELECT room_id, 'connector' AS component FROM " + FOUR)
def components(spark, sf_dir):
    r = four_rooms(spark)
    return rooms.reachable(rooms.shared_edges(r), r).select("room_id", "component")


@query("""
WITH b AS (SELECT c_custkey AS id, c_nationkey AS c, c_custkey % 97 / 10.0::DOUBLE AS x, c_custkey % 89 / 10.0::DOUBLE AS z FROM customer)
SELECT a.c AS capture_id, a.id AS room_a, b.id AS room_b, round((least(a.x, b.x) + 1.5 - greatest(a.x, b.x)) * (least(a.z, b.z) + 1.5 - greatest(a.z, b.z)), 4) AS area_m2
FROM b a JOIN b ON a.c = b.c AND a.id < b.id WHERE least(a.x, b.x) + 1.5 > greatest(a.x, b.x) AND least(a.z, b.z) + 1.5 > greatest(a.z, b.z)""")
def polygon_overlap(spark, sf_dir):
    c = _t(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("capture_id"), F.col("c_custkey").alias("room_id"), (F.col("c_custkey") % 97 / 10.0).alias("x"), (F.col("c_custkey") % 89 / 10.0).alias("z"))
    corner = lambda dx, dz: F.struct((F.col("x") + dx).alias("x"), (F.col("z") + dz).alias("z"))
    boxes = c.select("capture_id", "room_id", F.array(corner(0.0, 0.0), corner(1.5, 0.0), corner(1.5, 1.5), corner(0.0, 1.5)).alias("polygon"))
    return rooms.rectangle_overlap(boxes).withColumn("area_m2", F.round("area_m2", 4))


@query("""
WITH t AS (SELECT l_orderkey, l_linenumber, l_quantity / 10.0 AS value, CASE WHEN l_linenumber % 3 = 0 THEN 'lidar' WHEN l_linenumber % 3 = 1 THEN 'video' ELSE 'photo' END AS tier, l_tax / 10 AS sigma FROM lineitem),
h AS (SELECT *, greatest(1.96 * sigma, CASE tier WHEN 'lidar' THEN 0.012 WHEN 'video' THEN 0.04 ELSE 0.08 END, abs(value) * CASE tier WHEN 'lidar' THEN 0.0 WHEN 'video' THEN 0.03 ELSE 0.08 END) AS half FROM t)
SELECT l_orderkey, l_linenumber, tier, round(value, 3) AS value, round(value - half, 3) AS ci95_low, round(value + half, 3) AS ci95_high FROM h""")
def measurement_ci(spark, sf_dir):
    tier = F.when(F.col("l_linenumber") % 3 == 0, "lidar").when(F.col("l_linenumber") % 3 == 1, "video").otherwise("photo")
    l = _t(spark, sf_dir, "lineitem").withColumn("tier", tier)
    m = expr.measurement(F.col("l_quantity") / 10.0, F.col("l_tax") / 10, expr.tier_floor(F.col("tier"), 0), expr.tier_floor(F.col("tier"), 1))
    l = l.select("l_orderkey", "l_linenumber", "tier", m.alias("m"))
    return l.select("l_orderkey", "l_linenumber", "tier", *[F.round(f"m.{c}", 3).alias(c) for c in ("value", "ci95_low", "ci95_high")])


MATCH = """
WITH p AS (SELECT l_suppkey AS room, l_linenumber AS wall, l_orderkey AS id, l_quantity / 50.0 AS width, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_quantity, l_orderkey, l_partkey) AS k FROM lineitem WHERE l_returnflag = 'R'),
t AS (SELECT l_suppkey AS room, l_linenumber AS wall, l_orderkey AS id, l_quantity / 50.0 AS width, row_number() OVER (PARTITION BY l_suppkey, l_linenumber ORDER BY l_quantity, l_orderkey, l_partkey) AS k FROM lineitem WHERE l_returnflag = 'A'),
m AS (SELECT coalesce(t.room, p.room) AS room, coalesce(t.wall, p.wall) AS wall, t.id AS truth_id, p.id AS predicted_id, round(abs(p.width - t.width), 4) AS abs_error, CASE WHEN p.id IS NULL THEN 'missed' WHEN t.id IS NULL THEN 'phantom' ELSE 'matched' END AS status, t.width AS truth FROM t FULL JOIN p ON t.room = p.room AND t.wall = p.wall AND t.k = p.k)
"""


def _matched(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("room"), F.col("l_linenumber").alias("wall"), F.col("l_orderkey").alias("id"), (F.col("l_quantity") / 50.0).alias("value"), "l_returnflag", "l_partkey")
    return scoring.error_rows(scoring.rank_match(l.where("l_returnflag = 'R'"), l.where("l_returnflag = 'A'"), ["room", "wall"], ["value", "id", "l_partkey"]))


@query(MATCH + "SELECT room, wall, truth_id, predicted_id, abs_error, status FROM m")
def match_openings(spark, sf_dir):
    return _matched(spark, sf_dir).select("room", "wall", "truth_id", "predicted_id", "abs_error", "status")


@query(MATCH + """
SELECT room, count(*) AS n, count(*) FILTER (abs_error <= 0.02) AS within, max(abs_error) AS worst,
CASE WHEN room % 4 = 0 OR count(truth) = 0 THEN 'BLOCKED' WHEN count(*) FILTER (abs_error <= 0.02) / count(*)::DOUBLE >= 0.85 THEN 'PASS' ELSE 'FAIL' END AS status FROM m GROUP BY room""")
def opening_gate(spark, sf_dir):
    rows = _matched(spark, sf_dir).withColumn("source", F.when(F.col("room") % 4 == 0, "estimated").otherwise("laser"))
    return scoring.opening_gate(rows, ["room"]).select("room", "n", "within", "worst", "status")


@query("""
WITH r AS (SELECT o_custkey AS room, CASE WHEN o_orderkey % 13 > 0 THEN o_totalprice % 7 / 500 + 2.5 END AS predicted, CASE WHEN o_orderkey % 17 > 0 THEN 2.5 END AS truth, CASE WHEN o_custkey % 4 > 0 AND o_orderkey % 9 > 0 THEN o_totalprice % 5 / 400 END AS spread FROM orders),
g AS (SELECT room, count(predicted - truth) AS n, bool_or(round(abs(predicted - truth), 6) > 0.015) AS b, bool_or(round(spread, 6) > 0.01) FILTER (predicted IS NOT NULL AND truth IS NOT NULL) AS l, count(spread) FILTER (predicted IS NOT NULL AND truth IS NOT NULL) AS s FROM r GROUP BY 1),
k AS (SELECT room, CASE WHEN n = 0 THEN 'blocked' WHEN s = 0 AND b THEN 'biased_repeat_not_measured' WHEN s = 0 THEN 'repeat_not_measured' WHEN b AND l THEN 'both' WHEN b THEN 'biased_but_repeatable' WHEN l THEN 'unrepeatable' ELSE 'passed' END AS classification FROM g)
SELECT room, classification, CASE WHEN room % 5 = 0 OR classification IN ('blocked', 'repeat_not_measured') THEN 'BLOCKED' WHEN classification = 'passed' THEN 'PASS' ELSE 'FAIL' END AS status FROM k""")
def ceiling_gate(spark, sf_dir):
    c, k = F.col, F.col("o_orderkey")
    o = _t(spark, sf_dir, "orders").select(
        c("o_custkey").alias("room"), F.when(k % 13 > 0, c("o_totalprice") % 7 / 500 + 2.5).alias("predicted"), F.when(k % 17 > 0, 2.5).alias("truth"),
        F.when((c("o_custkey") % 4 > 0) & (k % 9 > 0), c("o_totalprice") % 5 / 400).alias("spread"), F.when(c("o_custkey") % 5 == 0, "faro").otherwise("tape").alias("source"),
    )
    return scoring.ceiling_gate(o, ["room"]).select("room", "classification", "status")


REPEAT = """
WITH p AS (SELECT l_partkey % 500 AS room, nullif(l_linenumber, 4) AS wall, l_quantity AS v, l_orderkey AS id, row_number() OVER (PARTITION BY l_returnflag, l_partkey % 500, nullif(l_linenumber, 4) ORDER BY l_orderkey, l_partkey, l_quantity) AS k, l_returnflag AS f FROM lineitem),
m AS (SELECT coalesce(t.room, p.room) AS room, coalesce(t.wall, p.wall) AS wall, t.id AS truth_id, p.id AS predicted_id, t.v AS truth, p.v AS predicted FROM (SELECT * FROM p WHERE f = 'A') t FULL JOIN (SELECT * FROM p WHERE f = 'R') p ON t.room IS NOT DISTINCT FROM p.room AND t.wall = p.wall AND t.k = p.k),
r AS (SELECT *, coalesce(round(abs(predicted - truth), 6) <= 0.01 OR round(abs(predicted - truth) / greatest(abs(predicted), abs(truth)), 6) <= 0.005, false) AS pass FROM m)
"""


def _repeat(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").select((F.col("l_partkey") % 500).alias("room"), F.expr("nullif(l_linenumber, 4)").alias("wall"), F.col("l_orderkey").alias("id"), F.col("l_quantity").alias("value"), "l_partkey", "l_returnflag")
    order = ["id", "l_partkey", "value"]
    return scoring.repeat_rows(scoring.rank_match(l.where("l_returnflag = 'R'"), l.where("l_returnflag = 'A'"), ["room", "wall"], order, null_safe=("room",)))


@query(REPEAT + "SELECT room, wall, truth_id, predicted_id, pass FROM r")
def repeat_match(spark, sf_dir):
    return _repeat(spark, sf_dir).select("room", "wall", "truth_id", "predicted_id", "pass")


@query(REPEAT + "SELECT room, count(*) AS n, count(*) FILTER (NOT pass) AS n_fail, CASE WHEN room % 3 = 0 THEN 'BLOCKED' WHEN bool_and(pass) THEN 'PASS' ELSE 'FAIL' END AS status FROM r GROUP BY room")
def repeat_gate(spark, sf_dir):
    return scoring.all_pass_gate(_repeat(spark, sf_dir), ["room"], F.col("pass"), F.col("room") % 3 != 0)


@query("""
WITH r AS (SELECT p_brand AS property, nullif(p_size, 7) AS ours, nullif(p_size + p_partkey % 5 - 2, 9) AS theirs, p_size + p_partkey % 3 - 1 AS truth FROM part),
g AS (SELECT property, count(*) FILTER (ours IS NOT NULL AND theirs IS NOT NULL) AS scored, count(*) FILTER (abs(ours - truth) < abs(theirs - truth) - 1e-6) AS won, count(*) FILTER (abs(abs(ours - truth) - abs(theirs - truth)) <= 1e-6) AS tied FROM r GROUP BY 1)
SELECT *, round((won + tied) / nullif(scored, 0)::DOUBLE, 6) AS rate, CASE WHEN scored = 0 THEN 'BLOCKED' WHEN (won + tied) / scored::DOUBLE >= 0.7 THEN 'PASS' ELSE 'FAIL' END AS status FROM g""")
def incumbent_gate(spark, sf_dir):
    p = _t(spark, sf_dir, "part").selectExpr("p_brand AS property", "nullif(p_size, 7) AS ours", "nullif(p_size + p_partkey % 5 - 2, 9) AS theirs", "p_size + p_partkey % 3 - 1 AS truth")
    return scoring.incumbent_gate(p, ["property"])


GT = (
    "SELECT o_orderkey AS id, CASE o_orderkey % 5 WHEN 0 THEN 'wall_length' WHEN 1 THEN 'floor_area' WHEN 2 THEN 'opening_width' WHEN 3 THEN 'ceiling_height' ELSE 'guess' END AS measurement_type, CASE WHEN o_orderkey % 11 > 0 THEN 'p' || (o_custkey % 3) END AS property_id, "
    "CASE WHEN o_orderkey % 12 > 0 THEN 'c' END AS capture_id, CASE WHEN o_orderkey % 13 > 0 THEN o_orderpriority ELSE '' END AS room_id, CASE WHEN o_orderkey % 17 > 0 THEN o_totalprice END AS value_m, CASE o_orderkey % 7 WHEN 0 THEN 'cm' WHEN 1 THEN 'm2' ELSE 'm' END AS unit, "
    "CASE WHEN o_orderkey % 23 > 0 THEN 0.1 END AS uncertainty_m, CASE o_orderkey % 9 WHEN 0 THEN 'faro' WHEN 1 THEN 'Estimated' WHEN 2 THEN 'ruler' WHEN 3 THEN '' WHEN 4 THEN NULL ELSE 'Laser' END AS source, o_orderkey % 29 = 0 AS guessed, CASE WHEN o_custkey % 4 > 0 THEN 'p1' END AS bundle_property FROM orders"
)
RULES = {
    "unknown_kind": "measurement_type = 'guess'", "missing_value": "value_m IS NULL", "bad_unit": "unit NOT IN ('m', 'm2')", "area_unit": "measurement_type = 'floor_area' AND unit <> 'm2'", "missing_uncertainty": "uncertainty_m IS NULL",
    "guessed_source": "guessed OR lower(source) = 'estimated'", "reference_source": "source = 'faro'", "not_physical": "lower(source) IN ('estimated', 'ruler')", "missing_property_id": "property_id IS NULL", "missing_capture_id": "capture_id IS NULL",
    "missing_room_id": "room_id = ''", "other_property": "property_id <> bundle_property",
}


@query(f"WITH g AS ({GT}) " + " UNION ALL ".join(f"SELECT id, '{n}' AS rule FROM g WHERE {w}" for n, w in RULES.items()))
def gt_violations(spark, sf_dir):
    _t(spark, sf_dir, "orders").createOrReplaceTempView("planimeter_orders")
    return scoring.violations(spark.sql(GT.replace("FROM orders", "FROM planimeter_orders")))


@query(MATCH + """
, z AS (SELECT CASE WHEN room % 4 = 0 OR count(truth) = 0 THEN 'BLOCKED' WHEN count(*) FILTER (abs_error <= 0.02) / count(*)::DOUBLE >= 0.85 THEN 'PASS' ELSE 'FAIL' END AS status FROM m GROUP BY room)
SELECT max(CASE WHEN status = 'FAIL' THEN 1 ELSE 0 END)::INT AS exit_code FROM z""")
def exit_code(spark, sf_dir):
    return scoring.exit_code(opening_gate(spark, sf_dir))


def _cells_input(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem")
    return l.select(F.col("l_returnflag").alias("wall_id"), (F.col("l_quantity") / 10.0 + 0.05).alias("along"), (F.col("l_discount") * 15 + 0.05).alias("height"), (F.col("l_suppkey") % 200).cast("double").alias("l"), (F.col("l_partkey") % 50 + 100).cast("double").alias("a"), (F.col("l_orderkey") % 40 + 110).cast("double").alias("b"))


CELLS = """
WITH p AS (SELECT l_returnflag AS wall_id, floor((l_quantity / 10.0 + 0.05) / 0.1)::BIGINT AS ia, floor((l_discount * 15 + 0.05) / 0.1)::BIGINT AS ih, (l_suppkey % 200)::DOUBLE AS l, (l_partkey % 50 + 100)::DOUBLE AS a, (l_orderkey % 40 + 110)::DOUBLE AS b FROM lineitem),
c AS (SELECT wall_id, ia, ih, quantile_cont(l, 0.5) AS l, quantile_cont(a, 0.5) AS a, quantile_cont(b, 0.5) AS b, count(*) AS n FROM p GROUP BY ALL HAVING count(*) >= 2),
d AS (SELECT * FROM c WHERE wall_id IN (SELECT wall_id FROM c GROUP BY 1 HAVING count(*) >= 8))
"""


@query(CELLS + "SELECT wall_id, ia, ih, l, a, b, n FROM d")
def lab_cells(spark, sf_dir):
    return damage.colour_cells(_cells_input(spark, sf_dir), ["wall_id"])


@query(CELLS + """
, r AS (SELECT x.wall_id, x.ia, x.ih, x.l - quantile_cont(y.l, 0.5) AS dl, x.a - quantile_cont(y.a, 0.5) AS da, x.b - quantile_cont(y.b, 0.5) AS db FROM d x JOIN d y ON x.wall_id = y.wall_id AND abs(x.ia - y.ia) <= 2 AND abs(x.ih - y.ih) <= 2 AND (x.ia <> y.ia OR x.ih <> y.ih) GROUP BY x.wall_id, x.ia, x.ih, x.l, x.a, x.b HAVING count(*) >= 4)
SELECT wall_id, ia, ih, round(dl, 4) AS dl, round(da, 4) AS da, round(db, 4) AS db, sqrt(dl * dl + da * da + db * db) >= 32 AND dl < -12 AS anomalous FROM r""")
def residual_cells(spark, sf_dir):
    r = damage.residual_cells(damage.colour_cells(_cells_input(spark, sf_dir), ["wall_id"]), ["wall_id"])
    return r.select("wall_id", "ia", "ih", *[F.round(c, 4).alias(c) for c in ("dl", "da", "db")], "anomalous")
