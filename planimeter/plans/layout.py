"""Harness queries of layout steps and of the states around a plan, each with its DuckDB twin; registered beside harness."""

from __future__ import annotations

from pyspark.sql import functions as F

from planimeter.functions import expr
from planimeter.operators import layout, matching
from planimeter.plans.harness import _t, query

c = F.col


@query("""
WITH n AS (SELECT l_suppkey AS capture, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) - 1 AS i, greatest(1, floor(count(*) OVER (PARTITION BY l_suppkey) / 150.0::DOUBLE))::BIGINT AS k FROM lineitem)
SELECT capture, l_orderkey, l_linenumber FROM n WHERE i % k = 0""")
def subsample(spark, sf_dir):
    p = _t(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("capture"), F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("ord"), "l_orderkey", "l_linenumber")
    return layout.subsample(p, ["capture"], 150).drop("ord")


@query("""
WITH p AS (SELECT label % 3 AS capture, vec_id AS ord, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS z FROM embeddings)
SELECT capture, floor(x / 0.1)::BIGINT AS kx, floor(z / 0.1)::BIGINT AS kz, min(ord) AS ord, round(arg_min(x, ord), 4) AS x, round(arg_min(z, ord), 4) AS z FROM p GROUP BY ALL""")
def first_in_cells(spark, sf_dir):
    e = c("embedding")
    p = _t(spark, sf_dir, "embeddings").select((c("label") % 3).alias("capture"), c("vec_id").alias("ord"), e[0].cast("double").alias("x"), e[1].cast("double").alias("z"))
    return layout.first_in_cells(p, ["capture"], 0.1).withColumns({a: F.round(a, 4) for a in "xz"})


@query("""
WITH p AS (SELECT l_suppkey * 10 + l_orderkey % (1 + l_suppkey % 4) AS capture, l_orderkey, l_linenumber, l_quantity / 20.0 AS y, l_partkey % 5 < l_suppkey % 5 AS v FROM lineitem),
k AS (SELECT *, count(*) OVER w AS n, count(*) FILTER (v AND y > 0.8 AND y < 1.9) OVER w AS nb, count(*) FILTER (v) OVER w AS nv, count(*) FILTER (y > 0.8 AND y < 1.8) OVER w AS nm FROM p WINDOW w AS (PARTITION BY capture))
SELECT capture, l_orderkey, l_linenumber FROM k WHERE n >= 200 AND CASE WHEN nb > 400 THEN v AND y > 0.8 AND y < 1.9 WHEN nv >= 150 THEN v ELSE nm >= 80 AND y > 0.8 AND y < 1.8 END""")
def wall_band(spark, sf_dir):
    capture = c("l_suppkey") * 10 + c("l_orderkey") % (1 + c("l_suppkey") % 4)
    p = _t(spark, sf_dir, "lineitem").select(capture.alias("capture"), "l_orderkey", "l_linenumber", (c("l_quantity") / 20.0).alias("y"), (c("l_partkey") % 5 < c("l_suppkey") % 5).alias("vertical"))
    return layout.wall_band(p, ["capture"]).select("capture", "l_orderkey", "l_linenumber")


@query("""
WITH p AS (SELECT s_suppkey AS capture, i * 0.03::DOUBLE AS x, i * 0.003::DOUBLE * (s_suppkey % 11) + 0.011::DOUBLE AS z FROM supplier, range(0, 300) r(i) UNION ALL SELECT s_suppkey, 3.017::DOUBLE - i * 0.003::DOUBLE * (s_suppkey % 11), i * 0.03::DOUBLE FROM supplier, range(0, 150) r(i) WHERE s_suppkey % 3 > 0),
o AS (SELECT DISTINCT capture, floor(x / 0.05)::BIGINT AS cx, floor(z / 0.05)::BIGINT AS cz FROM p),
s AS (SELECT a.capture, a.cx, a.cz, count(*) AS n, sum(b.cx - a.cx) AS sx, sum(b.cz - a.cz) AS sz, sum((b.cx - a.cx) ** 2) AS sxx, sum((b.cz - a.cz) ** 2) AS szz, sum((b.cx - a.cx) * (b.cz - a.cz)) AS sxz FROM o a JOIN o b ON a.capture = b.capture AND abs(a.cx - b.cx) <= 4 AND abs(a.cz - b.cz) <= 4 GROUP BY ALL HAVING count(*) >= 8),
v AS (SELECT capture, (n * sxx - sx * sx) / (n * (n - 1.0::DOUBLE)) AS a, (n * szz - sz * sz) / (n * (n - 1.0::DOUBLE)) AS d, (n * sxz - sx * sz) / (n * (n - 1.0::DOUBLE)) AS b FROM s),
e AS (SELECT *, (a + d) / 2 + sqrt(((a - d) / 2) ** 2 + b * b) AS hi, (a + d) / 2 - sqrt(((a - d) / 2) ** 2 + b * b) AS lo FROM v),
t AS (SELECT capture, 0.5 * atan2(2 * b, a - d) AS g, hi / lo AS w FROM e WHERE lo > 1e-6 AND hi / lo >= 4),
h AS (SELECT capture, least(floor((CASE WHEN g < 0 THEN g + pi() / 2 ELSE g END) / (pi() / 180)), 89) AS bin, sum(w) AS w, count(*) AS v FROM t GROUP BY ALL),
m AS (SELECT capture, (0.5 + arg_max(bin, w)) * (pi() / 180) AS theta FROM h GROUP BY 1 HAVING sum(v) >= 25)
SELECT capture, round(coalesce(theta, 0), 4) AS theta FROM (SELECT DISTINCT capture FROM p) LEFT JOIN m USING (capture)""")
def manhattan_angle(spark, sf_dir):
    s = _t(spark, sf_dir, "supplier").select(c("s_suppkey").alias("capture"))
    slope = lambda: c("i") * F.lit(0.003) * (c("capture") % 11)
    a = s.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(299)))).select("capture", (c("i") * F.lit(0.03)).alias("x"), (slope() + 0.011).alias("z"))
    b = s.where("capture % 3 > 0").withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(149)))).select("capture", (F.lit(3.017) - slope()).alias("x"), (c("i") * F.lit(0.03)).alias("z"))
    return layout.manhattan_angle(a.unionByName(b), ["capture"]).withColumn("theta", F.round("theta", 4))


@query("""
WITH p AS (SELECT label % 3 AS scene, vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS z FROM embeddings),
j AS (SELECT a.scene, a.id AS left_id, b.id AS right_id, (b.x - a.x) * (b.x - a.x) + (b.z - a.z) * (b.z - a.z) AS d FROM p a JOIN p b ON a.scene = b.scene AND b.id % 2 = 1 WHERE a.id % 2 = 0)
SELECT scene, left_id, right_id, round(sqrt(d), 4) AS distance FROM j QUALIFY row_number() OVER (PARTITION BY scene, left_id ORDER BY d, right_id) = 1""")
def nearest_point(spark, sf_dir):
    e = c("embedding")
    p = _t(spark, sf_dir, "embeddings").select((c("label") % 3).alias("scene"), c("vec_id").alias("id"), e[0].cast("double").alias("x"), e[1].cast("double").alias("z"))
    return layout.nearest_point(p.where("id % 2 = 0"), p.where("id % 2 = 1"), ["scene"]).withColumn("distance", F.round("distance", 4))


@query("""
WITH w AS (SELECT label % 5 AS room, vec_id AS id, embedding[1] * 3.0::DOUBLE AS x0, embedding[2] * 3.0::DOUBLE AS z0, embedding[3] * 3.0::DOUBLE AS x1, embedding[4] * 3.0::DOUBLE AS z1 FROM embeddings),
s AS (SELECT room, id, atan2(z1 - z0, x1 - x0) AS a, sqrt((x1 - x0) ** 2 + (z1 - z0) ** 2) AS l, (x0 + x1) / 2 AS x, (z0 + z1) / 2 AS z FROM w),
j AS (SELECT p.room, p.id AS left_id, q.id AS right_id, abs(p.l - q.l) AS delta, p.l AS left_length, q.l AS right_length, sqrt((p.x - q.x) ** 2 + (p.z - q.z) ** 2) AS apart, p.a - q.a + pi() / 2 AS t FROM s p JOIN s q ON p.room = q.room AND p.id % 2 = 0 AND q.id % 2 = 1)
SELECT room, left_id, right_id, round(delta, 4) AS delta, round(left_length, 4) AS left_length, round(right_length, 4) AS right_length, round(apart, 4) AS apart FROM j
WHERE abs(t - floor(t / pi()) * pi() - pi() / 2) <= radians(20) AND apart <= 1.2 QUALIFY row_number() OVER (PARTITION BY room, left_id ORDER BY j.delta, right_id) = 1""")
def match_walls(spark, sf_dir):
    ends = {n: (c("embedding")[i].cast("double") * 3.0).alias(n) for i, n in enumerate(("x0", "z0", "x1", "z1"))}
    w = _t(spark, sf_dir, "embeddings").select((c("label") % 5).alias("room"), c("vec_id").alias("id"), *ends.values())
    m = layout.match_walls(w.where("id % 2 = 0"), w.where("id % 2 = 1"), ["room"])
    return m.withColumns({n: F.round(n, 4) for n in ("delta", "left_length", "right_length", "apart")})


@query("SELECT c_nationkey AS capture, round(sum((c_custkey % 7 + 1) * (c_custkey % 4 + 2.5)), 4) AS footprint_m2 FROM customer GROUP BY 1")
def footprints(spark, sf_dir):
    w, d = (c("c_custkey") % 7 + 1).cast("double"), (c("c_custkey") % 4 + 2.5).cast("double")
    at = lambda x, z: F.struct(x.alias("x"), z.alias("z"))
    o = F.lit(0.0)
    rooms = _t(spark, sf_dir, "customer").select(c("c_nationkey").alias("capture"), F.array(at(o, o), at(w, o), at(w, d), at(o, d)).alias("polygon"))
    return layout.footprints(rooms, ["capture"]).withColumn("footprint_m2", F.round("footprint_m2", 4))


@query("""
WITH f AS (SELECT l_suppkey AS capture, quantile_cont(k, 0.5) AS m, avg((k < 25)::INT) AS few FROM (SELECT l_suppkey, (l_partkey * 7 + l_suppkey * 13) % (60 + l_suppkey * 2) AS k FROM lineitem) GROUP BY 1),
p AS (SELECT s_suppkey AS capture, count(*) AS tried, count(*) FILTER (i % 5 < s_suppkey % 6) AS used FROM supplier, range(0, 12) r(i) WHERE i < s_suppkey % 13 GROUP BY 1)
SELECT capture, coalesce(m < 80 OR few > 0.45, false) AS low_texture, coalesce(used, 0) < 3 OR coalesce(tried >= 4 AND used / tried < 0.3, false) AS weak_overlap FROM f FULL JOIN p USING (capture)""")
def track_quality(spark, sf_dir):
    k = (c("l_partkey") * 7 + c("l_suppkey") * 13) % (60 + c("l_suppkey") * 2)
    f = _t(spark, sf_dir, "lineitem").select(c("l_suppkey").alias("capture"), k.alias("keypoints"))
    p = _t(spark, sf_dir, "supplier").select(c("s_suppkey").alias("capture"), F.explode(F.sequence(F.lit(0), F.lit(11))).alias("i")).where("i < capture % 13")
    return layout.track_quality(f, p.withColumn("used", c("i") % 5 < c("capture") % 6), ["capture"])


@query("""
WITH f AS (SELECT o_custkey AS capture, arg_min(o_orderpriority, o_orderkey) FILTER (o_orderstatus = 'F') AS rule, min(o_orderkey) FILTER (o_orderstatus = 'F') AS surface_id FROM orders GROUP BY 1)
SELECT capture, surface_id IS NOT NULL AS flag, rule, surface_id FROM f""")
def concealed_summary(spark, sf_dir):
    f = _t(spark, sf_dir, "orders").select(c("o_custkey").alias("capture"), c("o_orderkey").alias("ord"), c("o_orderpriority").alias("rule"), c("o_orderkey").alias("surface_id"), (c("o_orderstatus") == "F").alias("fired"))
    return layout.concealed_summary(f, ["capture"])


TIER = "CASE l_linenumber % 3 WHEN 0 THEN 'photo' WHEN 1 THEN 'video' ELSE 'lidar' END"


@query(f"""
WITH w AS (SELECT {TIER} AS tier, CASE WHEN l_orderkey % 9 > 0 THEN l_discount END AS rel FROM lineitem)
SELECT tier, count(*) AS n, count(*) FILTER (tier = 'photo' AND rel <= 0.08 OR tier = 'video' AND rel <= 0.03) AS n_pass, count(*) FILTER (tier = 'lidar') AS n_open FROM w GROUP BY 1""")
def wall_passes(spark, sf_dir):
    w = _t(spark, sf_dir, "lineitem").select(F.expr(TIER).alias("tier"), F.when(c("l_orderkey") % 9 > 0, c("l_discount")).alias("rel"))
    p = w.withColumn("passed", layout.wall_passes(c("tier"), F.lit(None).cast("double"), c("rel")))
    return p.groupBy("tier").agg(F.count(F.lit(1)).alias("n"), F.count_if("passed").alias("n_pass"), F.count_if(c("passed").isNull()).alias("n_open"))


PLAN = "SELECT o_orderkey AS plan, CASE o_orderkey % 5 WHEN 0 THEN 'measured' WHEN 1 THEN 'guessed' WHEN 2 THEN 'unavailable' END AS record, CASE o_custkey % 4 WHEN 0 THEN 'estimated_height' WHEN 1 THEN 'failed_plane' WHEN 2 THEN 'tape' END AS origin, o_custkey % 7 = 0 AS est, o_custkey % 6 > 0 AS has_plan, CASE WHEN o_custkey % 9 = 0 THEN 'degraded' END AS state, o_orderkey % 8 AS n_rooms FROM {t}"


@query(f"WITH p AS ({PLAN.format(t='orders')})" + """
SELECT plan, CASE WHEN record IN ('measured', 'unavailable') THEN record WHEN est OR coalesce(origin LIKE '%estimated%', false) THEN 'estimated' ELSE 'unavailable' END AS calibration,
CASE WHEN NOT has_plan THEN 'BLOCKED' WHEN coalesce(state = 'degraded', false) OR n_rooms = 0 THEN 'DEGRADED' ELSE 'RAN' END AS status FROM p""")
def plan_states(spark, sf_dir):
    _t(spark, sf_dir, "orders").createOrReplaceTempView("planimeter_orders")
    p = spark.sql(PLAN.format(t="planimeter_orders"))
    return p.select("plan", layout.calibration_status(c("record"), c("origin"), c("est")).alias("calibration"), layout.tier_status(c("has_plan"), c("state"), c("n_rooms")).alias("status"))


@query("""
WITH p AS (SELECT o_orderkey AS capture, o_custkey % 4 AS n_rooms, 2 AS n_truth, o_orderkey % 3 * 0.1 AS overlap, o_custkey % 25 + 10.0 AS foot, CASE WHEN o_orderkey % 8 > 0 THEN o_custkey % 25 + 10.5 END AS foot_t, CASE WHEN o_custkey % 5 > 0 THEN 'Tape' ELSE 'faro' END AS source, o_orderkey % 7 = 0 AS synthetic FROM orders),
d AS (SELECT l_orderkey AS capture, count(*) FILTER (l_returnflag = 'R') AS a, count(*) FILTER (l_returnflag = 'A') AS b FROM lineitem GROUP BY 1),
j AS (SELECT p.*, coalesce(a, 0) AS n_missing, coalesce(b, 0) AS n_false, abs(foot - foot_t) / abs(foot_t) AS e FROM p LEFT JOIN d USING (capture))
SELECT capture, n_missing, n_false, round(100 * e, 4) AS footprint_error_percent, CASE WHEN source = 'faro' OR synthetic OR e IS NULL THEN 'BLOCKED' WHEN n_rooms = n_truth AND n_missing = 0 AND n_false = 0 AND overlap <= 0.15 AND e <= 0.08 THEN 'PASS' ELSE 'FAIL' END AS status FROM j""")
def stitch_gate(spark, sf_dir):
    k, n = c("o_orderkey"), c("o_custkey")
    p = _t(spark, sf_dir, "orders").select(
        k.alias("capture"), (n % 4).alias("n_rooms"), F.lit(2).alias("n_rooms_truth"), (k % 3 * 0.1).alias("overlap"), F.lit(0.15).alias("overlap_max"), (n % 25 + 10.0).alias("footprint"),
        F.when(k % 8 > 0, n % 25 + 10.5).alias("footprint_truth"), F.when(n % 5 > 0, "Tape").otherwise("faro").alias("source"), (k % 7 == 0).alias("synthetic"),
    )
    d = _t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("capture"), F.when(c("l_returnflag") == "R", "missed").when(c("l_returnflag") == "A", "phantom").alias("status"))
    return layout.stitch_gate(p, d, ["capture"])


@query("""
WITH r AS (SELECT o_custkey AS property, coalesce(CASE WHEN o_orderkey % 5 > 0 THEN o_orderpriority END, 'unknown') AS room_id, o_orderkey AS id FROM orders)
SELECT property, room_id, count(*) AS n, string_agg(id::VARCHAR, ',' ORDER BY id) AS ids FROM r GROUP BY ALL""")
def rows_by_room(spark, sf_dir):
    r = _t(spark, sf_dir, "orders").select(c("o_custkey").alias("property"), F.when(c("o_orderkey") % 5 > 0, c("o_orderpriority")).alias("room_id"), c("o_orderkey").alias("ord"), c("o_orderkey").cast("string").alias("id"))
    g = layout.rows_by_room(r, ["property"])
    return g.select("property", "room_id", F.size("ids").cast("long").alias("n"), F.array_join("ids", ",").alias("ids"))


@query("""
WITH r AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_partkey % 3 = 0 THEN l_quantity END AS a, CASE WHEN l_partkey % 4 > 0 THEN l_quantity * 2 END AS b, CASE l_linenumber % 3 WHEN 0 THEN 'cm' WHEN 1 THEN 'm' END AS unit FROM lineitem)
SELECT l_orderkey, l_linenumber, round(CASE WHEN unit = 'cm' THEN coalesce(a, b) / 100 ELSE coalesce(a, b) END, 4) AS metres, round(coalesce(a, CASE WHEN unit IS NULL OR unit = 'm' THEN b END), 4) AS vendor FROM r""")
def lengths(spark, sf_dir):
    unit = F.when(c("l_linenumber") % 3 == 0, "cm").when(c("l_linenumber") % 3 == 1, "m")
    a, b = F.when(c("l_partkey") % 3 == 0, c("l_quantity")), F.when(c("l_partkey") % 4 > 0, c("l_quantity") * 2)
    return _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.round(layout.metres(a, b, unit), 4).alias("metres"), F.round(layout.incumbent_length(a, F.lit(None).cast("double"), b, unit), 4).alias("vendor"))


FILES = "SELECT o_custkey % 200 AS root, 'room' || (o_custkey // 200 % 6) AS room_id, CASE WHEN o_orderkey % 41 = 0 THEN 'adjacency.json' WHEN o_orderkey % 43 = 0 THEN '.hidden.jpg' ELSE 'img' || (o_orderkey % 29) || CASE o_orderkey % 31 WHEN 0 THEN '.txt' WHEN 1 THEN '' WHEN 2 THEN '.PNG' ELSE '.jpg' END END AS name FROM orders WHERE o_custkey % 9 > 0 AND o_custkey % 200 <> 17"


@query(f"WITH f AS ({FILES})" + r"""
, roots AS (SELECT DISTINCT o_custkey % 200 AS root, o_custkey % 200 % 3 = 0 AS physical FROM orders), wanted AS (SELECT root, 'room' || i AS room_id FROM roots, range(0, 6) r(i) WHERE root % 2 = 0),
s AS (SELECT *, regexp_matches(lower(name), '\.(jpg|jpeg|png)$') AS still FROM f WHERE name NOT LIKE '.%'), n AS (SELECT root, room_id, name, still, count(*) AS k FROM s GROUP BY ALL), r AS (SELECT root, room_id, count(*) FILTER (still) AS k FROM s GROUP BY ALL)
SELECT root, 'missing_room' AS code, room_id, NULL::VARCHAR AS name FROM wanted ANTI JOIN f USING (root, room_id) UNION ALL SELECT root, 'missing_room', NULL, NULL FROM roots ANTI JOIN f USING (root)
UNION ALL SELECT root, 'unsupported_format', room_id, name FROM s WHERE NOT still AND name NOT IN ('synthetic_walls.json', 'adjacency.json')
UNION ALL (SELECT root, 'image_in_two_rooms', room_id, name FROM n WHERE still QUALIFY lag(room_id) OVER (PARTITION BY root, name ORDER BY room_id) IS NOT NULL)
UNION ALL SELECT root, 'duplicate_filename', room_id, name FROM n WHERE k > 1 UNION ALL SELECT root, 'fewer_than_2', room_id, NULL FROM r WHERE k < 2 UNION ALL SELECT root, 'more_than_8', room_id, NULL FROM r WHERE k > 8
UNION ALL SELECT root, 'missing_calibration', NULL, NULL FROM roots WHERE NOT physical""")
def photo_issues(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    o.createOrReplaceTempView("planimeter_orders")
    f = spark.sql(FILES.replace("FROM orders", "FROM planimeter_orders").replace("o_custkey // 200", "(o_custkey div 200)"))
    roots = o.select((c("o_custkey") % 200).alias("root")).distinct().withColumn("physical", c("root") % 3 == 0)
    wanted = roots.where("root % 2 = 0").select("root", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("i")).select("root", F.concat(F.lit("room"), c("i").cast("string")).alias("room_id"))
    return layout.photo_issues(roots, f, wanted, ["root"])


REASONS = ["low_texture", "weak_overlap", "insufficient_points", "no_room_closure"]


@query("""
WITH p AS (SELECT o_orderkey AS plan, o_custkey % 7 = 0 AS pose, o_custkey % 5 = 0 AS tex, o_custkey % 3 = 0 AS weak, o_orderkey % 4 = 0 AS pts, CASE WHEN o_orderkey % 6 = 0 THEN 'x not enough wall points' END AS notes FROM orders)
SELECT plan, CASE WHEN pose THEN 'missing_pose' WHEN tex THEN 'low_texture' WHEN weak THEN 'weak_overlap' WHEN pts OR notes IS NOT NULL THEN 'insufficient_wall_support' ELSE 'no_room_closure' END AS reason,
concat_ws(',', CASE WHEN tex THEN 'low_texture' END, CASE WHEN weak THEN 'weak_overlap' END, CASE WHEN pts THEN 'insufficient_points' END) AS reasons FROM p""")
def video_reasons(spark, sf_dir):
    k, o = c("o_custkey"), c("o_orderkey")
    found = F.array_compact(F.array(F.when(o % 4 == 0, "insufficient_points"), F.when(k % 3 == 0, "weak_overlap"), F.when(k % 7 == 0, "missing_pose"), F.when(k % 5 == 0, "low_texture")))
    p = _t(spark, sf_dir, "orders").select(o.alias("plan"), found.alias("found"), F.when(o % 6 == 0, "x not enough wall points").alias("notes"))
    return p.select("plan", layout.video_reason(c("found"), c("notes")).alias("reason"), F.array_join(layout.ordered_reasons(c("found"), REASONS), ",").alias("reasons"))


@query("""
WITH f AS (SELECT o_custkey AS folder, o_orderpriority || '/' || o_orderkey || '.png' AS path, (o_totalprice * 100)::BIGINT AS size FROM orders)
SELECT folder, sha256(string_agg(path || size, '' ORDER BY string_split(path, '/'))) AS fingerprint FROM f GROUP BY 1""")
def folder_fingerprints(spark, sf_dir):
    size = F.round(c("o_totalprice") * 100).cast("long")
    f = _t(spark, sf_dir, "orders").select(c("o_custkey").alias("folder"), F.concat("o_orderpriority", F.lit("/"), c("o_orderkey").cast("string"), F.lit(".png")).alias("path"), size.alias("size"))
    return layout.folder_fingerprints(f, ["folder"])


@query("""
WITH p AS (SELECT vec_id AS id, embedding[1]::DOUBLE AS x, embedding[2]::DOUBLE AS z, embedding[3] + 2.0::DOUBLE AS dx, embedding[4]::DOUBLE AS dz FROM embeddings)
SELECT id, round((x * dx + z * dz) / sqrt(dx * dx + dz * dz), 4) AS along, round((z * dx - x * dz) / sqrt(dx * dx + dz * dz), 4) AS across, round(x * cos(0.3) + z * sin(0.3), 4) AS turned_x, round(z * cos(0.3) - x * sin(0.3), 4) AS turned_z FROM p""")
def floor_coordinates(spark, sf_dir):
    e, o, t = c("embedding"), F.lit(0.0), F.lit(0.3)
    x, z = e[0].cast("double"), e[1].cast("double")
    s = expr.segment_coords(x, z, o, o, e[2].cast("double") + 2.0, e[3].cast("double"))
    r = expr.turned(x, z, t)
    return _t(spark, sf_dir, "embeddings").select(c("vec_id").alias("id"), *[F.round(v, 4).alias(n) for n, v in (("along", s["along"]), ("across", s["across"]), ("turned_x", r["x"]), ("turned_z", r["z"]))])


CEIL = "SELECT l_suppkey % 5 AS scan, CASE WHEN l_orderkey % 3 = 0 THEN 2.413 + (l_partkey % 7) / 1010.0 ELSE l_quantity / 9.7 - 0.5 END AS height FROM {t}"


@query(f"WITH p AS ({CEIL.format(t='lineitem')})" + """
, h AS (SELECT * FROM p WHERE height > -0.3 AND height < 5), c AS (SELECT scan, least(floor((height - 1.8) / 0.02), 133) AS b, count(*) AS c FROM h WHERE height >= 1.8 AND height <= 4.48 GROUP BY ALL),
m AS (SELECT scan, arg_max(b, c * 1000 - b) AS b, max(c) AS c FROM c GROUP BY 1), n AS (SELECT scan, count(*) AS n FROM h GROUP BY 1)
SELECT scan, n, CASE WHEN n >= 500 AND c >= 80 THEN round(1.8 + (b + 0.5) * 0.02, 4) END AS ceiling_height_m FROM n LEFT JOIN m USING (scan)""")
def scanned_ceiling(spark, sf_dir):
    _t(spark, sf_dir, "lineitem").createOrReplaceTempView("planimeter_lineitem")
    h = spark.sql(CEIL.format(t="planimeter_lineitem")).withColumn("height", c("height").cast("double"))
    return matching.scanned_ceiling(h, ["scan"])


@query("""
WITH f AS (SELECT s_nationkey AS scene, s_suppkey AS floor_id, s_suppkey % 5 * 0.3::DOUBLE AS y FROM supplier), p AS (SELECT c_nationkey AS scene, c_acctbal / 3000.0 AS x, c_custkey % 40 / 7.0 AS y, c_custkey % 13 / 4.0 AS z FROM customer)
SELECT scene, floor_id, round(min(p.y - f.y) FILTER (p.y - f.y BETWEEN 1.8 AND 6 AND x > 0 AND x < 2.1 AND z > 0.1 AND z < 2.6), 4) AS ceiling_height_m FROM f LEFT JOIN p USING (scene) GROUP BY ALL""")
def ceilings_above(spark, sf_dir):
    at = lambda x, z: F.struct(F.lit(x).alias("x"), F.lit(z).alias("z"))
    f = _t(spark, sf_dir, "supplier").select(c("s_nationkey").alias("scene"), c("s_suppkey").alias("id"), (c("s_suppkey") % 5 * F.lit(0.3)).alias("y"), F.array(at(0.0, 0.1), at(2.1, 0.1), at(2.1, 2.6), at(0.0, 2.6)).alias("polygon"))
    p = _t(spark, sf_dir, "customer").select(c("c_nationkey").alias("scene"), (c("c_acctbal") / 3000.0).alias("x"), (c("c_custkey") % 40 / 7.0).alias("y"), (c("c_custkey") % 13 / 4.0).alias("z"))
    return matching.ceilings_above(f, p, ["scene"]).withColumn("ceiling_height_m", F.round("ceiling_height_m", 4))


@query("""
WITH b AS (SELECT l_orderkey AS plan, max(l_quantity) AS before FROM lineitem WHERE l_linenumber % 2 = 0 GROUP BY 1), a AS (SELECT l_orderkey AS plan, max(l_quantity) AS after FROM lineitem WHERE l_linenumber % 2 = 1 GROUP BY 1)
SELECT plan, before, after, after - before AS change FROM b FULL JOIN a USING (plan)""")
def longest_wall_change(spark, sf_dir):
    w = _t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("plan"), c("l_quantity").alias("length"), "l_linenumber")
    return matching.longest_wall_change(w.where("l_linenumber % 2 = 0"), w.where("l_linenumber % 2 = 1"), ["plan"])


@query("""
WITH m AS (SELECT s_suppkey AS bundle, CASE WHEN s_suppkey % 9 > 0 THEN 'p' || s_suppkey END AS own, CASE s_suppkey % 4 WHEN 0 THEN [] WHEN 1 THEN ['1-URGENT', '1-URGENT', '2-HIGH'] ELSE ['1-URGENT', '2-HIGH', '5-LOW'] END AS rooms FROM supplier),
o AS (SELECT o_custkey AS bundle, o_orderstatus AS name, 'p' || (o_custkey + CASE WHEN o_orderkey % 11 = 0 THEN 1 ELSE 0 END) AS pid, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS room FROM orders)
SELECT bundle, 'no_property' AS code, NULL AS name FROM m WHERE own IS NULL UNION ALL SELECT bundle, 'repeated_room', NULL FROM m WHERE bundle % 4 = 1
UNION ALL SELECT bundle, 'other_property', name FROM o JOIN m USING (bundle) WHERE pid <> own UNION ALL SELECT bundle, 'unknown_room', name || ':' || room FROM o JOIN m USING (bundle) WHERE len(rooms) > 0 AND room IS NOT NULL AND NOT list_contains(rooms, room)""")
def identity_issues(spark, sf_dir):
    k = c("s_suppkey")
    some = lambda *r: F.array(*map(F.lit, r))
    rooms = F.when(k % 4 == 0, F.array().cast("array<string>")).when(k % 4 == 1, some("1-URGENT", "1-URGENT", "2-HIGH")).otherwise(some("1-URGENT", "2-HIGH", "5-LOW"))
    m = _t(spark, sf_dir, "supplier").select(k.alias("bundle"), F.when(k % 9 > 0, F.concat(F.lit("p"), k.cast("string"))).alias("property_id"), rooms.alias("rooms"))
    pid = F.concat(F.lit("p"), (c("o_custkey") + F.when(c("o_orderkey") % 11 == 0, 1).otherwise(0)).cast("string"))
    o = _t(spark, sf_dir, "orders").select(c("o_custkey").alias("bundle"), c("o_orderstatus").alias("name"), pid.alias("property_id"), F.when(c("o_orderkey") % 7 > 0, c("o_orderpriority")).alias("room_id"))
    return matching.identity_issues(m, o.drop("room_id"), o.drop("property_id"), ["bundle"])
