"""Harness queries of rooms, openings, evaluation and manifests, with DuckDB twins where a result can be said in SQL;
registered beside harness."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from planimeter.functions import arrays
from planimeter.operators import align, damage, documents, evaluate, manifest, openings, plan, rooms
from planimeter.plans import fixtures
from planimeter.plans.harness import _t, query
from planimeter.sources import captures

c = F.col


def _rooms(spark, sf_dir) -> DataFrame:
    """A rectangular room a region, of five sizes, as points on a lattice."""
    k = c("r_regionkey")
    specs = _t(spark, sf_dir, "region").select(k.alias("capture_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("z0"), (3.0 + k * 0.4).alias("x1"), (2.6 + k % 3 * 0.4).alias("z1"), F.lit(2.5).alias("height_m"))
    return fixtures.room_cloud(specs)


@query("""
WITH w AS (SELECT r_regionkey AS capture_id, i AS wall, CASE WHEN i % 2 = 0 THEN 3.0 + r_regionkey * 0.4 ELSE 2.6 + r_regionkey % 3 * 0.4 END AS l FROM region, range(0, 4) r(i))
SELECT capture_id, 0 AS room, wall::INT AS wall, round(l::DOUBLE, 1) AS length FROM w""")
def room_walls(spark, sf_dir):
    made = plan.aligned_to_axes(plan.build_layout(_rooms(spark, sf_dir), "photo"))
    return made.walls.select("capture_id", "room", "wall", F.round("length", 1).alias("length"))


@query()
def plan_documents(spark, sf_dir):
    made = plan.build_layout(_rooms(spark, sf_dir), "photo")
    docs = documents.plan_documents(made, "photo", "lattice")
    return docs.join(documents.summaries(docs), "capture_id").join(documents.drawings(docs), "capture_id", "left")


@query("""
WITH b AS (SELECT c_custkey AS id, c_nationkey AS k, c_custkey % 97 / 10.0::DOUBLE AS x, c_custkey % 89 / 10.0::DOUBLE AS z FROM customer)
SELECT a.k AS capture_id, a.id AS room_a, b.id AS room_b, round((least(a.x, b.x) + 1.5 - greatest(a.x, b.x)) * (least(a.z, b.z) + 1.5 - greatest(a.z, b.z)), 4) AS area_m2
FROM b a JOIN b ON a.k = b.k AND a.id < b.id WHERE least(a.x, b.x) + 1.5 > greatest(a.x, b.x) + 0.001 AND least(a.z, b.z) + 1.5 > greatest(a.z, b.z) + 0.001""")
def convex_overlap(spark, sf_dir):
    at = lambda dx, dz: F.struct((c("x") + dx).alias("x"), (c("z") + dz).alias("z"))
    b = _t(spark, sf_dir, "customer").select(c("c_nationkey").alias("capture_id"), c("c_custkey").alias("id"), (c("c_custkey") % 97 / 10.0).alias("x"), (c("c_custkey") % 89 / 10.0).alias("z"))
    b = b.select("capture_id", c("id").alias("room_id"), F.array(at(0.0, 0.0), at(1.5, 0.0), at(1.5, 1.5), at(0.0, 1.5)).alias("polygon"))
    return rooms.convex_overlaps(b, 0.0001).withColumn("area_m2", F.round("area_m2", 4))


@query("""
SELECT c_custkey AS id, round(CASE WHEN x BETWEEN 0 AND 2 AND z BETWEEN 0 AND 1 THEN least(x, 2 - x, z, 1 - z) ELSE sqrt(greatest(0 - x, x - 2, 0) ** 2 + greatest(0 - z, z - 1, 0) ** 2) END, 4) AS gap
FROM (SELECT c_custkey, c_acctbal / 3000.0 AS x, c_custkey % 41 / 13.0 - 1 AS z FROM customer)""")
def loop_distance(spark, sf_dir):
    at = lambda x, z: F.struct(F.lit(x).alias("x"), F.lit(z).alias("z"))
    box = F.array(at(0.0, 0.0), at(2.0, 0.0), at(2.0, 1.0), at(0.0, 1.0))
    p = _t(spark, sf_dir, "customer")
    return p.select(c("c_custkey").alias("id"), F.round(arrays.loop_distance(c("c_acctbal") / 3000.0, c("c_custkey") % 41 / 13.0 - 1, box), 4).alias("gap"))


def _profiles(spark, sf_dir) -> DataFrame:
    """A wall a customer: returns each centimetre and 2 cm of height, without those of a door."""
    k = c("c_custkey") % 8
    w = _t(spark, sf_dir, "customer").select(c("c_custkey").alias("wall"), (1.2 + k * 0.1).alias("a"), (0.75 + k * 0.05).alias("w"))
    p = w.withColumn("along", F.explode(F.transform(F.sequence(F.lit(0), F.lit(400)), lambda i: i / 100.0)))
    return p.where((c("along") < c("a") + 0.005) | (c("along") > c("a") + c("w") - 0.005)).withColumn("frame", F.lit(0))


@query("SELECT c_custkey AS wall, 'door' AS kind, round((0.75 + c_custkey % 8 * 0.05)::DOUBLE, 2) AS width, round((1.2 + c_custkey % 8 * 0.1)::DOUBLE, 1) AS along0, 'wall_termination' AS method FROM customer")
def wall_openings(spark, sf_dir):
    p = _profiles(spark, sf_dir).withColumn("height", F.lit(1.0))
    spans = p.select("wall").distinct().withColumns({"a0": F.lit(0.0), "a1": F.lit(4.0), "abs_floor": F.lit(0.012)})
    o = openings.openings(p.select("wall", "along", "height"), spans, ["wall"])
    # The edges lie half a pitch inside the gap on each side.
    return o.select("wall", "kind", F.round(c("width") + 0.01, 2).alias("width"), F.round("along0", 1).alias("along0"), "method")


@query("SELECT c_custkey AS wall, 1::BIGINT AS frames, round((0.75 + c_custkey % 8 * 0.05)::DOUBLE, 2) AS width, 'wall_termination' AS method, 0.8::DOUBLE AS confidence FROM customer")
def frame_openings(spark, sf_dir):
    o = openings.frame_openings(_profiles(spark, sf_dir).select("wall", "frame", "along"), ["wall"])
    return o.select("wall", "frames", F.round(c("width") + 0.01, 2).alias("width"), "method", "confidence")


def _cases(spark, sf_dir) -> DataFrame:
    """A case an order, its lines being walls and openings; documents as JSON text. Lines are dealt once, as bare columns."""
    told = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    l = _t(spark, sf_dir, "lineitem").select(c("l_orderkey").alias("case_id"), *told).repartition("case_id")
    g = l.groupBy("case_id").agg(F.collect_list(F.struct(*told)).alias("l"), F.sum(c("l_quantity") / 10.0).alias("s"))

    def line(x):
        i = F.concat_ws("-", *[x[n].cast("string") for n in ("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")])
        return F.struct(x["l_linenumber"].alias("l_linenumber"), x["l_partkey"].alias("l_partkey"), x["l_suppkey"].alias("l_suppkey"), i.alias("i"), (x["l_quantity"] / 10.0).alias("q"))

    def wall(x):
        off = x["q"] * (1 + (x["l_partkey"] % 11 - 5) / 90.0)
        measured = F.struct(off.alias("value"), F.lit(0.01).alias("sigma"))
        door = F.struct(F.concat(F.lit("o"), x["i"]).alias("id"), F.lit("door").alias("class"), (x["q"] + x["l_suppkey"] % 7 / 100.0 - 0.025).alias("width_m"))
        return F.when(x["l_partkey"] % 13 > 0, F.struct(x["l_linenumber"].alias("l_linenumber"), F.concat(F.lit("w"), x["i"]).alias("id"), measured.alias("length_m"), F.array(door).alias("openings")))

    truth = lambda x: F.struct(x["l_linenumber"].alias("l_linenumber"), F.concat(F.lit("w"), x["i"]).alias("wall_id"), x["q"].alias("length_m"))
    cut = lambda x: F.struct(x["l_linenumber"].alias("l_linenumber"), F.when(x["l_suppkey"] % 5 > 0, F.concat(F.lit("o"), x["i"])).otherwise(F.concat(F.lit("x"), x["i"])).alias("opening_id"), F.concat(F.lit("v"), x["i"]).alias("wall_id"), x["q"].alias("width_m"))
    g = g.withColumn("l", F.transform("l", line))
    g = g.select("case_id", "s", F.array_sort(F.array_compact(F.transform("l", wall))).alias("w"), F.array_sort(F.transform("l", truth)).alias("t"), F.array_sort(F.transform("l", cut)).alias("o"))
    bare = lambda a: F.transform(a, lambda x: x.dropFields("l_linenumber"))
    tier = F.element_at(F.array(F.lit("photo"), F.lit("video"), F.lit("lidar")), (c("case_id") % 3 + 1).cast("int"))
    room = F.struct(F.lit("r").alias("id"), bare("w").alias("walls"), F.struct((2.5 + c("case_id") % 4 / 100.0).alias("value")).alias("ceiling_height_m"))
    body = F.struct(tier.alias("tier"), F.struct(F.array(room).alias("rooms"), (c("s") * (1 + c("case_id") % 5 / 40.0)).alias("footprint_area_m2")).alias("property"))
    known = F.struct(F.array(F.struct(F.lit("r").alias("room_id"), bare("t").alias("walls"), bare("o").alias("openings"), F.lit(2.5).alias("ceiling_height_m"))).alias("rooms"), c("s").alias("footprint_m2"))
    again = F.when(c("case_id") % 2 == 0, F.to_json(F.struct(F.struct(F.array(F.struct(F.lit("r").alias("room_id"), F.transform("t", lambda x: F.struct(x["wall_id"].alias("id"), x["length_m"].alias("length_m"))).alias("walls"))).alias("rooms")).alias("property"))))
    return g.select("case_id", F.to_json(body).alias("prediction"), F.to_json(known).alias("ground_truth"), again.alias("repeat"), F.lit(None).cast("string").alias("drift_off"))


@query("""
WITH l AS (SELECT l_orderkey AS case_id, l_quantity / 10.0 AS q, l_quantity / 10.0 * (1 + (l_partkey % 11 - 5) / 90.0) AS p, l_partkey % 13 > 0 AS seen, l_suppkey % 5 > 0 AS named, l_quantity / 10.0 + l_suppkey % 7 / 100.0 - 0.025 AS w FROM lineitem),
o AS (SELECT l_orderkey AS case_id, sum(l_quantity / 10.0) AS s FROM lineitem GROUP BY 1),
r AS (
  SELECT case_id, 'wall_accuracy' AS metric, abs(p - q) AS e, seen, NOT seen AS missed, false AS phantom, CASE WHEN NOT seen THEN false WHEN case_id % 3 = 0 THEN abs(p - q) / q <= 0.08 WHEN case_id % 3 = 1 THEN abs(p - q) / q <= 0.03 END AS pass FROM l
  UNION ALL SELECT case_id, 'opening_accuracy', abs(w - q), seen AND named, NOT (seen AND named), false, seen AND named AND abs(w - q) <= 0.02 FROM l
  UNION ALL SELECT case_id, 'opening_accuracy', NULL, false, false, true, false FROM l WHERE seen AND NOT named
  UNION ALL SELECT case_id, 'ceiling_accuracy', case_id % 4 / 100.0, true, false, false, abs(2.5 + case_id % 4 / 100.0 - 2.5) <= 0.015 FROM o
  UNION ALL SELECT case_id, 'repeatability', abs(p - q), true, false, false, abs(p - q) <= 0.01 OR abs(p - q) / greatest(p, q) <= 0.005 FROM l WHERE seen AND case_id % 2 = 0
  UNION ALL SELECT case_id, 'photo_property', s * (case_id % 5 / 40.0), true, false, false, case_id % 5 / 40.0 <= 0.08 FROM o WHERE case_id % 3 = 0)
SELECT case_id, metric, 'evaluated' AS status, count(*) AS n_evaluated, count(*) FILTER (pass) AS n_pass, count(*) FILTER (missed) AS n_missed, count(*) FILTER (phantom) AS n_phantom, round(count(*) FILTER (pass) / nullif(count(pass), 0)::DOUBLE, 4) AS pass_rate FROM r GROUP BY 1, 2""")
def evaluate_cases(spark, sf_dir):
    _, metrics, _ = evaluate.evaluate(_cases(spark, sf_dir))
    return metrics.where("status = 'evaluated'").select("case_id", "metric", "status", "n_evaluated", "n_pass", "n_missed", "n_phantom", "pass_rate")


@query("""
WITH t AS (SELECT l_suppkey AS k, l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, CASE WHEN l_partkey % 31 > 0 THEN l_quantity / 50.0 END AS w FROM lineitem WHERE l_returnflag = 'A'),
p AS (SELECT l_suppkey AS k, CASE WHEN l_partkey % 7 = 0 THEN 'x' ELSE '' END || l_orderkey || '-' || l_linenumber || '-' || l_partkey AS id, l_quantity / 50.0 + l_partkey % 5 / 100.0 AS w FROM lineitem),
m AS (SELECT coalesce(t.k, p.k) AS k, CASE WHEN t.id IS NULL THEN 'phantom' WHEN p.id IS NULL OR t.w IS NULL THEN 'miss' ELSE 'true_positive' END AS kind, abs(p.w - t.w) AS e FROM t FULL JOIN p ON t.k = p.k AND t.id = p.id),
g AS (SELECT k, count(*) AS trials, count(*) FILTER (kind = 'true_positive' AND e <= 0.02) AS hit, count(*) FILTER (kind = 'true_positive') AS matched, count(*) FILTER (kind = 'miss') AS missed, count(*) FILTER (kind = 'phantom') AS phantoms FROM m GROUP BY 1)
SELECT k AS key, trials, hit AS within_2cm, matched, missed, phantoms, CASE WHEN k % 3 = 0 THEN 'BLOCKED' WHEN hit / trials::DOUBLE >= 0.85 THEN 'PASS' ELSE 'FAIL' END AS status FROM g""")
def openings_gate(spark, sf_dir):
    l = _t(spark, sf_dir, "lineitem").withColumn("id", F.concat_ws("-", *[c(n).cast("string") for n in ("l_orderkey", "l_linenumber", "l_partkey")]))
    none = F.lit(None).cast("string")
    shape = [c("l_suppkey").alias("key"), (c("l_orderkey") * 10 + c("l_linenumber")).alias("ord"), none.alias("wall"), none.alias("room")]
    t = l.where("l_returnflag = 'A'").select(*shape, "id", F.when(c("l_partkey") % 31 > 0, c("l_quantity") / 50.0).alias("width"))
    p = l.select(*shape, F.when(c("l_partkey") % 7 == 0, F.concat(F.lit("x"), "id")).otherwise(c("id")).alias("id"), (c("l_quantity") / 50.0 + c("l_partkey") % 5 / 100.0).alias("width"))
    sources = l.select(c("l_suppkey").alias("key")).distinct().withColumn("source", F.when(c("key") % 3 == 0, "faro").otherwise("Tape"))
    return evaluate.openings_gate(evaluate.score_openings(t, p, ["key"]), sources, ["key"]).select("key", "trials", "within_2cm", "matched", "missed", "phantoms", "status")


TRUTH = (
    "SELECT o_custkey AS key, o_orderkey AS k, CASE WHEN o_orderkey % 3 = 0 THEN 'ceiling' WHEN o_orderkey % 3 = 1 THEN 'area' END AS kind, CASE WHEN o_orderkey % 3 = 2 THEN 'wall_length' END AS measurement_type, o_totalprice / 1000.0 AS value, CASE o_orderkey % 4 WHEN 0 THEN 'cm' WHEN 1 THEN 'm' END AS unit, "
    "CASE WHEN o_orderkey % 5 > 0 THEN 0.5 END AS uncertainty, CASE WHEN o_orderkey % 7 > 0 THEN o_orderpriority END AS room_id, CASE o_orderkey % 6 WHEN 0 THEN 'FARO' WHEN 1 THEN 'Tape' END AS source FROM {t}"
)


def _truths(spark, sf_dir) -> DataFrame:
    _t(spark, sf_dir, "orders").createOrReplaceTempView("planimeter_orders")
    rows = spark.sql(TRUTH.format(t="planimeter_orders"))
    row = F.struct("k", F.struct("kind", "measurement_type", "value", "unit", "uncertainty", "room_id", "source").alias("r"))
    g = rows.groupBy("key").agg(F.array_sort(F.collect_list(row), lambda a, b: F.when(a["k"] < b["k"], -1).otherwise(1)).alias("r"))
    body = F.struct(F.when(c("key") % 4 > 0, F.concat(F.lit("p"), c("key").cast("string"))).alias("property_id"), F.lit("m").alias("unit"), F.when(c("key") % 5 > 0, "laser").alias("source"), F.transform("r", lambda x: x["r"]).alias("measurements"))
    return g.select("key", F.to_json(body).alias("doc"))


@query(f"""
WITH r AS ({TRUTH.format(t='orders')})
SELECT key, row_number() OVER (PARTITION BY key ORDER BY k)::INT - 1 AS ord, CASE WHEN key % 4 > 0 THEN 'p' || key END AS property_id, coalesce(measurement_type, CASE kind WHEN 'ceiling' THEN 'ceiling_height' ELSE 'floor_area' END) AS measurement_type,
round(CASE WHEN unit = 'cm' THEN value / 100.0 ELSE value END, 3) AS value_m, 'm' AS unit, CASE WHEN unit = 'cm' THEN uncertainty / 100.0 ELSE uncertainty END AS uncertainty_m, lower(coalesce(source, CASE WHEN key % 5 > 0 THEN 'laser' END, '')) AS source FROM r""")
def truth_rows(spark, sf_dir):
    t = manifest.ground_truth_rows(_truths(spark, sf_dir))
    return t.select("key", "ord", "property_id", "measurement_type", F.round("value_m", 3).alias("value_m"), "unit", "uncertainty_m", "source")


@query(f"""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY k) - 1 AS i FROM ({TRUTH.format(t='orders')})),
g AS (SELECT *, CASE WHEN measurement_type = 'wall_length' THEN ['photo_walls', 'photo_footprint', 'video_walls'] ELSE ['ceiling'] END AS gates, lower(coalesce(source, CASE WHEN key % 5 > 0 THEN 'laser' END, '')) AS own FROM r),
x AS (
  SELECT key, i, [gates[1]] AS gates, 'missing property_id' AS what FROM g WHERE key % 4 = 0 UNION ALL SELECT key, i, [gates[1]], 'missing capture_id' FROM g
  UNION ALL SELECT key, i, gates, 'missing room_id' FROM g WHERE room_id IS NULL UNION ALL SELECT key, i, gates, 'missing measurement_type' FROM g WHERE measurement_type IS NULL UNION ALL SELECT key, i, gates, 'missing value_m' FROM g
  UNION ALL SELECT key, i, gates, 'missing unit' FROM g WHERE unit IS NULL UNION ALL SELECT key, i, gates, 'missing uncertainty_m' FROM g UNION ALL SELECT key, i, gates, 'missing source' FROM g WHERE source IS NULL AND key % 5 = 0
  UNION ALL SELECT key, i, gates, 'missing wall_id' FROM g WHERE measurement_type = 'wall_length' UNION ALL SELECT key, i, gates, 'unit must be m' FROM g WHERE unit = 'cm' UNION ALL SELECT key, i, gates, 'source faro is a reference, not a tape' FROM g WHERE own = 'faro')
SELECT key, unnest(gates) AS gate, 'measurements[' || i || '] ' || what AS issue FROM x""")
def contract_issues(spark, sf_dir):
    return manifest.contract_issues(_truths(spark, sf_dir))


@query("""
WITH w AS (SELECT l_orderkey AS key, l_partkey AS p, l_linenumber AS n, CASE WHEN l_partkey % 4 = 0 THEN l_quantity WHEN l_partkey % 4 = 1 THEN l_quantity * 2 WHEN l_partkey % 4 = 2 THEN NULL ELSE l_quantity * 3 END AS m, l_quantity + l_partkey % 3 AS t, CASE WHEN l_suppkey % 3 > 0 THEN l_quantity + l_suppkey % 4 END AS o FROM lineitem),
g AS (SELECT key, count(*) FILTER (o IS NOT NULL) AS compared, count(*) FILTER (abs(abs(o - t) - abs(m - t)) <= 1e-6) AS tied, count(*) FILTER (abs(o - t) < abs(m - t) AND abs(abs(o - t) - abs(m - t)) > 1e-6) AS won FROM w WHERE m IS NOT NULL GROUP BY 1)
SELECT key, compared, tied, won, CASE WHEN compared = 0 THEN 'BLOCKED' WHEN (won + tied) / compared::DOUBLE >= 0.7 THEN 'PASS' ELSE 'FAIL' END AS status FROM g""")
def vendor_scores(spark, sf_dir):
    q, p = c("l_quantity"), c("l_partkey") % 4
    text = lambda v: v.cast("string")
    wall = F.struct(
        F.concat(F.lit("w"), text(c("l_linenumber"))).alias("id"), F.when(p == 0, text(q)).alias("length_m"), F.when(p == 1, text(q * 2)).alias("lengthInMeters"), F.when(p == 2, F.lit("unknown")).alias("length"), F.when(p == 3, text(q * 3)).alias("measure"),
        (q + c("l_partkey") % 3).alias("ground_truth_m"), F.when(c("l_suppkey") % 3 > 0, q + c("l_suppkey") % 4).alias("ours_m"),
    )
    g = _t(spark, sf_dir, "lineitem").groupBy(c("l_orderkey").alias("key")).agg(F.collect_list(wall).alias("walls"))
    room = F.array(F.struct(F.lit("a").alias("name"), "walls"))
    doc = F.when(c("key") % 2 == 0, F.to_json(F.struct(room.alias("rooms")))).otherwise(F.to_json(F.struct(F.array(F.struct(room.alias("rooms"))).alias("floors"))))
    return manifest.incumbent_scores(manifest.incumbent_rows(g.select("key", doc.alias("doc"))), ["key"]).select("key", "compared", "tied", "won", "status")


@query("""
WITH b AS (SELECT s_suppkey AS key, s_suppkey % 7 = 0 AS bad, s_suppkey % 5 = 0 AS mixed FROM supplier), f AS (SELECT o_custkey AS key, count(DISTINCT o_orderstatus) AS n, bool_or(o_orderpriority = '1-URGENT') AS t, bool_or(o_orderpriority = '2-HIGH') AS a FROM orders GROUP BY 1)
SELECT b.key, 'BLOCKED' AS status, CASE WHEN bad THEN 'malformed_manifest' WHEN mixed THEN 'mixed_property' WHEN coalesce(n, 0) < 3 THEN 'missing_tier_capture' WHEN NOT t THEN 'missing_ground_truth' ELSE 'missing_repeat_capture' END AS reason, CASE WHEN bad OR mixed THEN 2 ELSE 0 END AS exit_code FROM b LEFT JOIN f USING (key)""")
def bundle_results(spark, sf_dir):
    k = c("s_suppkey")
    path = lambda p, own=None: F.struct(F.lit(p).alias("path"), *([own.alias("property_id")] if own is not None else []))
    tiers = F.struct(*[path(t).alias(t) for t in manifest.TIERS])
    body = F.struct(
        F.lit("p").alias("property_id"), F.array(F.lit("a")).alias("rooms"), tiers.alias("tiers"), F.when(k % 7 > 0, F.struct(F.lit("a").alias("capture_a"), F.lit("b").alias("capture_b"))).alias("repeat"),
        path("truth.json", F.when(k % 5 == 0, "q").otherwise("p")).alias("ground_truth"), path("sold.json").alias("incumbent"),
    )
    m = _t(spark, sf_dir, "supplier").select(k.alias("key"), F.to_json(body).alias("manifest"))
    s, p = c("o_orderstatus"), c("o_orderpriority")
    none = F.array().cast("array<string>")
    some = lambda *n: F.array(*map(F.lit, n))
    files = F.concat(
        F.when(s == "F", some("lidar/odometry.csv", "lidar/depth/1.png")).when(s == "O", some("video/a.mp4", "video/odometry.csv")).otherwise(some("photo/r/1.jpg", "photo/r/2.PNG")),
        F.when(p == "1-URGENT", some("truth.json")).when(p == "2-HIGH", some("a/x", "b/.gitkeep")).otherwise(none),
    )
    listing = _t(spark, sf_dir, "orders").select(c("o_custkey").alias("key"), F.explode(files).alias("path"))
    return manifest.bundle_results(manifest.bundle_checks(m, listing)).drop("missing")


LISTING = "SELECT o_custkey AS capture_id, CASE o_orderkey % 9 WHEN 0 THEN 'depth/' || o_orderkey || '.png' WHEN 1 THEN CASE WHEN o_custkey % 3 = 0 THEN 'odometry.csv' ELSE 'notes.txt' END WHEN 2 THEN 'room' || (o_orderkey % 4) || '/' || o_orderkey || '.JPG' WHEN 3 THEN o_orderkey || '.jpg' WHEN 4 THEN CASE WHEN o_custkey % 4 = 0 THEN 'walk' || o_orderkey || '.mp4' WHEN o_custkey % 4 = 1 THEN 'video.mp4' ELSE 'imu.csv' END WHEN 5 THEN CASE WHEN o_custkey % 5 = 0 THEN 'adjacency.json' ELSE '.hidden.jpg' END WHEN 6 THEN 'room9/synthetic_walls.json' WHEN 7 THEN 'depth.png' ELSE 'room1/sub/' || o_orderkey || '.jpg' END AS path FROM {t}"


def _listing(spark, sf_dir) -> DataFrame:
    _t(spark, sf_dir, "orders").createOrReplaceTempView("planimeter_orders")
    return spark.sql(LISTING.format(t="planimeter_orders"))


@query(f"""
WITH f AS ({LISTING.format(t='orders')}),
k AS (SELECT capture_id, bool_or(path = 'adjacency.json') AS a, bool_or(path LIKE 'depth/%') AS d, bool_or(path = 'odometry.csv') AS o, bool_or(path LIKE '%.mp4' AND path NOT LIKE '%/%') AS v, count(*) FILTER (path NOT LIKE '%/%' AND (path LIKE '%.jpg' OR path LIKE '%.png')) AS s FROM f GROUP BY 1)
SELECT capture_id, CASE WHEN a AND NOT d THEN 'photo_property' WHEN d AND o THEN 'lidar_bundle' WHEN v OR o THEN 'video' WHEN s >= 2 THEN 'photo_folder' ELSE 'unknown' END AS kind FROM k""")
def capture_kinds(spark, sf_dir):
    return captures.classify(_listing(spark, sf_dir))


@query(f"""
WITH f AS ({LISTING.format(t='orders')}), r AS (SELECT capture_id, split_part(path, '/', 1) AS room_id, split_part(path, '/', 2) AS n FROM f WHERE path LIKE '%/%' AND path NOT LIKE '%/%/%')
SELECT capture_id, room_id, count(*) FILTER (n LIKE '%.JPG' OR n LIKE '%.png') AS n_stills, bool_or(n = 'synthetic_walls.json') AS specified FROM r GROUP BY 1, 2""")
def room_folders(spark, sf_dir):
    return captures.room_folders(_listing(spark, sf_dir))


@query(f"""
WITH f AS ({LISTING.format(t='orders')})
SELECT capture_id, CASE WHEN bool_or(path = 'video.mp4') THEN 'video.mp4' ELSE min(path) END AS path FROM f WHERE path LIKE '%.mp4' GROUP BY 1""")
def video_files(spark, sf_dir):
    return captures.video_file(_listing(spark, sf_dir))


@query(f"""
WITH f AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY path)::INT - 1 AS ord FROM ({LISTING.format(t='orders')}) WHERE path NOT LIKE '%/%' AND path NOT LIKE '.%' AND (path LIKE '%.jpg' OR path LIKE '%.png'))
SELECT capture_id, ord, path FROM f""")
def still_lists(spark, sf_dir):
    return captures.stills(_listing(spark, sf_dir))


@query("""
WITH g AS (SELECT o_custkey AS key, bool_or(abs(o_totalprice % 7 / 400) > 0.015) AS b FROM orders GROUP BY 1),
s AS (SELECT key, gate, CASE WHEN gate = 'ceiling' AND key % 3 > 0 AND key % 4 > 0 THEN CASE WHEN b THEN 'FAIL' ELSE 'PASS' END ELSE 'BLOCKED' END AS status FROM g, (VALUES ('openings'), ('ceiling'), ('repeatability'), ('photo_walls'), ('photo_footprint'), ('stitch'), ('video_walls'), ('damage'), ('incumbent')) v(gate))
SELECT key, gate, status FROM s""")
def manifest_gates(spark, sf_dir):
    o = _t(spark, sf_dir, "orders")
    key = c("o_custkey").alias("key")
    row = F.struct(F.lit("ceiling_height").alias("measurement_type"), F.lit(2.5).alias("value_m"), (2.5 + c("o_totalprice") % 7 / 400).alias("predicted_m"), F.lit(0.004).alias("repeat_spread_m"))
    docs = o.groupBy(key).agg(F.collect_list(row).alias("m"))
    doc = F.to_json(F.struct(F.when(c("key") % 4 > 0, "tape").otherwise("faro").alias("source"), c("m").alias("measurements")))
    files = docs.where("key % 3 > 0").select("key", F.concat(F.lit("truth/"), c("key").cast("string")).alias("path"), doc.alias("content"), F.lit(False).alias("is_dir"))
    m = docs.select("key", F.to_json(F.struct(F.concat(F.lit("truth/"), c("key").cast("string")).alias("ground_truth"), F.lit("photos").alias("photo_folder"))).alias("manifest"))
    return manifest.run_manifests(m, files).select("key", "gate", "status")


@query("""
SELECT o_custkey AS key, o_orderkey AS k, CASE o_orderkey % 3 WHEN 0 THEN 'a/' || o_orderkey WHEN 1 THEN 'in/' || o_orderkey ELSE o_orderkey::VARCHAR END AS path FROM orders""")
def portable_paths(spark, sf_dir):
    k = c("o_orderkey").cast("string")
    raw = F.when(c("o_orderkey") % 3 == 0, F.concat(F.lit("a/"), k)).when(c("o_orderkey") % 3 == 1, F.concat(F.lit("/root/x/in/"), k)).otherwise(F.concat(F.lit("/root/xy/in/"), k))
    return _t(spark, sf_dir, "orders").select(c("o_custkey").alias("key"), c("o_orderkey").alias("k"), manifest.portable(raw, F.lit("/root/x/")).alias("path"))


@query()
def floor_frames(spark, sf_dir):
    tilted = _rooms(spark, sf_dir).select("capture_id", "ord", "x", (c("y") + 0.02 * c("x") + 0.3).alias("y"), "z", F.floor(c("x") * 10).cast("int").alias("frame_index"))
    f = align.floor_frames(tilted)
    level = align.replayed(tilted, f).groupBy("capture_id").agg(F.round(F.percentile("y", 0.01), 2).alias("floor"))
    return f.select("capture_id", F.round("tilt_deg", 2).alias("tilt_deg"), "method").join(level, "capture_id")


@query()
def wall_damage(spark, sf_dir):
    k = c("r_regionkey")
    walls = _t(spark, sf_dir, "region").select(k.alias("capture_id"), F.lit("room").alias("room_id"), F.lit("w0").alias("wall_id"), F.lit(0.0).alias("x0"), F.lit(0.0).alias("z0"), F.lit(4.0).alias("x1"), F.lit(0.0).alias("z1"), (k % 2).alias("windows"))
    spot = lambda a0, a1, h0, h1, *rgb: F.struct(*[F.lit(v).alias(n) for n, v in zip(("a0", "a1", "h0", "h1", "r", "g", "b"), (a0, a1, h0, h1, *rgb), strict=True)])
    patches = walls.select("capture_id", "wall_id", F.explode(F.array(spot(0.6, 2.2, 1.0, 1.2, 35, 32, 30), spot(2.4, 3.6, 0.2, 0.35, 95, 72, 20))).alias("p")).select("capture_id", "wall_id", "p.*")
    points = fixtures.painted_walls(walls, patches, 0.05, 0.2, 1.8, (212, 204, 190))
    return damage.wall_damage(points, walls).select("capture_id", "damage_id", "class", "extent.value", "bottom", "top", "concealed_rules")
