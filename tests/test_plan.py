"""Plans, openings, evaluation and manifests against fixtures made by rule and plain versions."""

import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from planimeter.functions import arrays
from planimeter.functions.shared import stored
from planimeter.operators import damage, documents, evaluate, lines, manifest, openings, plan, scoring
from planimeter.plans import fixtures

ROOMS = {"room_01": (0.0, 0.0, 4.0, 3.0), "connector": (4.0, 0.6, 5.4, 2.4), "room_02": (5.4, 0.0, 9.0, 3.2), "room_03": (0.4, 3.0, 3.4, 5.6)}


def boxes(spark, rooms):
    corner = lambda x, z: {"x": x, "z": z}
    rows = [(k, n, [corner(a, b), corner(c, b), corner(c, d), corner(a, d)]) for k, r in rooms.items() for n, (a, b, c, d) in r.items()]
    return spark.createDataFrame(rows, "capture_id string, room_id string, polygon array<struct<x:double,z:double>>")


def test_stations_like_plain_ones(spark):
    import numpy as np

    rng = random.Random(1)

    def plain(p):
        d = np.diff(p)
        wide = d[d > 1e-4]
        if len(p) < 3:
            return p
        if len(wide) < 3:
            return [float(np.median(p))]
        upper = np.percentile(wide, 95)
        if not upper > max(0.02, 4 * np.median(wide)):
            return p
        return [float(np.median(x)) for x in np.split(np.array(p), np.flatnonzero(d >= 0.5 * upper) + 1)]

    rows = []
    for i in range(120):
        kind = rng.randrange(4)
        n = rng.randint(0, 40)
        p = [rng.random() for _ in range(n)] if kind == 0 else [0.06 * (k // 5) + rng.random() * 0.002 for k in range(n)] if kind == 1 else [0.01 * k for k in range(n)] if kind == 2 else [1.0] * n
        rows.append((i, sorted(p)))
    df = spark.createDataFrame(rows, "i int, p array<double>")
    for r in df.select("i", "p", arrays.stations(F.col("p")).alias("s"), arrays.pitch(F.col("p")).alias("t")).collect():
        want = plain(r.p)
        assert np.allclose(r.s, want)
        c = plain(r.p)
        near = [x for x in np.diff(c) if 1e-4 < x < 0.15]
        assert np.isclose(r.t, np.median(near) if len(c) >= 3 and near else 0.02)
    flat = df.select("i", F.explode("p").alias("along"))
    got = Counter((r.i, round(r.centre, 9)) for r in lines.station_centres(flat, ["i"]).collect())
    assert got == Counter((i, round(x, 9)) for i, p in rows for x in plain(p))


def profile(gap0, width, pitch, span=4.0, repeats=1, phase=0.0):
    n = int(round(span / pitch))
    return [x for k in range(n + 1) for x in [phase + k * pitch] * repeats if not gap0 < x < gap0 + width]


def test_openings_of_made_up_profiles(spark):
    rows, want = [], {}
    for i, (gap0, width, pitch, repeats) in enumerate([(1.2, 0.8, 0.01, 1), (1.5, 0.9, 0.02, 2), (1.0, 1.0, 0.01, 3), (2.0, 0.7, 0.01, 2), (1.2, 0.8, 0.04, 1), (1.2, 0.5, 0.01, 2), (1.2, 1.5, 0.01, 2)]):
        want[i] = width if 0.68 <= width <= 1.2 else None
        rows += [(i, f, x) for f in range(1 if pitch > 0.02 else 3) for x in profile(gap0, width, pitch, repeats=repeats, phase=f * pitch / 3)]
    out = {r.wall: r for r in openings.frame_openings(spark.createDataFrame(rows, "wall int, frame int, along double"), ["wall"]).collect()}
    assert set(out) == {i for i, w in want.items() if w}
    for i, r in out.items():
        assert abs(r.width - want[i]) <= (0.02 if i != 4 else 0.06)
    assert out[0].method == "multi_frame_wall_termination" and out[0].frames == 3 and out[4].method == lines.SPARSE and out[4].confidence <= 0.62


def test_depth_steps_place_jambs(spark):
    on = [(x / 100, 1.0) for x in range(0, 400) if not 1.195 < x / 100 < 2.005]
    points = spark.createDataFrame([("w", x, h) for x, h in on], "wall string, along double, height double")
    off = [("w", 1.22 + k / 1000, 0.1) for k in range(10)] + [("w", 1.97 + k / 1000, -0.12) for k in range(10)]
    spans = spark.createDataFrame([("w", 0.0, 4.0, 0.012)], "wall string, a0 double, a1 double, abs_floor double")
    o = openings.openings(points, spans, ["wall"], spark.createDataFrame(off, "wall string, along double, depth double")).collect()
    assert len(o) == 1 and abs(o[0].along0 - 1.2245) < 1e-6 and abs(o[0].along1 - 1.9745) < 1e-6 and abs(o[0].sigma - 0.01) < 1e-9 and o[0].head is None


def test_windows_have_low_points(spark):
    rows = [("w", x / 100, 0.4 + k * 0.1) for x in range(0, 400, 2) for k in range(14) if not (1.2 < x / 100 < 2.0 and 4 <= k < 11)]
    rows = [r for r in rows if not (1.2 < r[1] < 2.0 and 0.65 < r[2] < 1.65)] + [("w", 1.25 + k / 40, 0.3) for k in range(28)] * 2
    points = spark.createDataFrame(rows, "wall string, along double, height double")
    runs = spark.createDataFrame([("w", 0.0, 1.2), ("w", 2.0, 4.0)], "wall string, a double, b double")
    spans = spark.createDataFrame([("w", 0.0, 4.0, 0.012)], "wall string, a0 double, a1 double, abs_floor double")
    o = [r for r in openings.openings(points, spans, ["wall"], runs=runs).collect() if r.method == lines.DENSE]
    assert [(r.kind, r.sill) for r in o] == [("window", 0.85)]


def test_property_of_four_rooms(spark):
    specs = spark.createDataFrame([(n, *r, 2.5) for n, r in ROOMS.items()], "capture_id string, x0 double, z0 double, x1 double, z1 double, height_m double")
    made = plan.aligned_to_axes(plan.build_layout(fixtures.room_cloud(specs), "photo"))
    assert Counter(r.capture_id for r in made.rooms.collect()) == Counter(dict.fromkeys(ROOMS, 1))
    area = {r.capture_id: r.footprint_m2 for r in plan.footprint(made).collect()}
    assert abs(sum(area.values()) - 33.84) < 0.6 and abs(area["room_01"] - 12) < 0.3
    corners = specs.select("capture_id", F.col("x0").alias("_x"), F.col("z0").alias("_z"))
    placed = made.rooms.join(corners, "capture_id").select(F.lit("p").alias("capture_id"), F.col("capture_id").alias("room_id"), F.transform("polygon", lambda p: plan.shifted(p, F.col("_x"), F.col("_z"))).alias("polygon"))
    links, over, state = plan.stitched(stored(placed))
    assert {(r.room_a, r.room_b) for r in links.collect()} == {("connector", "room_01"), ("connector", "room_02"), ("room_01", "room_03")}
    assert over.count() == 0 and state.first().connected and state.first().overlap_m2 == 0
    docs = stored(documents.plan_documents(made, "photo", "fixture"))
    doc = json.loads(docs.where("capture_id = 'room_01'").first().document)
    room = doc["property"]["rooms"][0]
    assert doc["status"] == "ok" and len(room["walls"]) == 4 and [w["id"] for w in room["walls"]] == [f"room0_w{i}" for i in range(4)]
    assert room["floor_area_m2"]["ci95_low"] < room["floor_area_m2"]["value"] < room["floor_area_m2"]["ci95_high"]
    text = documents.summaries(docs).where("capture_id = 'room_01'").first().summary
    assert text.startswith("capture: room_01\ntier: photo\nstatus: ok\nrooms: 1\n  room_0: area ") and "no opening" in text
    assert documents.drawings(docs).where("svg like '%<polygon points=%'").count() == 4
    seen = plan.build_layout(fixtures.room_cloud(specs.where("capture_id = 'room_03'")), "photo", "observed")
    assert seen.walls.count() >= 3
    both = plan.compared(made, made).collect()
    assert len(both) == 16 and all(r.passed and r.abs_delta_m == 0 for r in both)


def test_stitches_that_are_rejected(spark):
    r = boxes(spark, {"over": {"a": (0.0, 0.0, 4.0, 3.0), "b": (0.5, 0.5, 4.5, 3.5)}, "far": {"a": (0.0, 0.0, 4.0, 3.0), "b": (12.0, 0.0, 15.0, 3.0)}, "one": {"a": (0.0, 0.0, 2.0, 2.0)}})
    links, over, state = plan.stitched(r)
    assert links.count() == 0 and [(x.capture_id, x.area_m2) for x in over.collect()] == [("over", 8.75)]
    assert {x.capture_id: x.connected for x in state.collect()} == {"over": False, "far": False, "one": True}
    s = state.select("capture_id", F.array().cast("array<string>").alias("found"), F.lit(2).alias("n_rooms"), (F.col("overlap_m2") > 0).alias("overlapping"), "connected")
    assert {x.capture_id: (x.status, x.degraded_reasons) for x in plan.photo_reasons(s).collect()} == {"over": ("degraded", ["overlap_rejected"]), "far": ("degraded", ["adjacency_unresolved"]), "one": ("ok", [])}


def test_clouds_without_rooms_say_why(spark):
    rows = [("few", i, i / 10, 1.0, 0.0) for i in range(50)] + [("line", i, i / 100, 0.5 + i % 20 / 10, 0.001 * (i % 3)) for i in range(3000)]
    made = plan.build_layout(spark.createDataFrame(rows, "capture_id string, ord long, x double, y double, z double"))
    notes = {r.capture_id: r.notes for r in made.notes.collect()}
    assert notes["few"] == ["too few points to build a plan"] and "no closed room" in notes["line"][-1] and made.rooms.count() == 0
    docs = documents.plan_documents(made, "video", "x").collect()
    assert {r.capture_id: json.loads(r.document)["degraded_reasons"] for r in docs} == {"few": ["insufficient_points", "no_room_closure"], "line": ["no_room_closure"]}


def test_contract_drops_dangling_links(spark):
    room = lambda n, z: {"id": n, "polygon_m": [[0.0, z], [4.0, z], [4.0, z + 3], [0.0, z + 3]], "floor_area_m2": None, "ceiling_height_m": None, "ceiling_observed": False, "walls": [{"id": f"{n}_w{i}", "openings": []} for i in (1, 0)], "damage": []}
    wall = f"struct<id:string,length_m:{documents.M},height_m:{documents.M},openings:array<struct<id:string,width_m:{documents.M},sill_height_m:{documents.M},head_height_m:{documents.M}>>>"
    kind = f"array<struct<id:string,polygon_m:array<array<double>>,floor_area_m2:{documents.M},ceiling_height_m:{documents.M},ceiling_observed:boolean,walls:array<{wall}>,damage:array<string>>>"
    docs = spark.createDataFrame([("a", "ok", [], [room("y", 3.0), room("x", 0.0)]), ("b", "ok", [], []), ("c", "degraded", ["low_texture"], [])], f"capture_id string, status string, degraded_reasons array<string>, rooms {kind}")
    link = lambda a, b, k="shared_wall": {"a": a, "b": b, "kind": k}
    links = spark.createDataFrame([("a", link("y", "x")), ("a", link("x", "ghost")), ("a", link("x", "x")), ("a", link("x", "y", None))], f"capture_id string, link {documents.LINK}")
    out = {r.capture_id: r for r in documents.contract(docs, links).collect()}
    assert [r.room_id for r in out["a"].rooms] == ["x", "y"] and [w.id for w in out["a"].rooms[0].walls] == ["x_w0", "x_w1"] and out["a"].rooms[0].status == "ok"
    assert [(x.room_a, x.room_b, x.relationship, x.source, x.shared_length_m) for x in out["a"].adjacencies] == [("y", "x", "shared_wall", "geometry", 4.0)]
    assert (out["b"].status, out["b"].degraded_reasons) == ("degraded", ["no_room_closure"]) and (out["c"].status, out["c"].degraded_reasons) == ("degraded", ["low_texture"])


def case(name, tier, wall=None, door=None, ceiling=None, repeat=None, foot=None, links=None, **truth):
    """A case of the evaluator: pairs of predicted and true numbers."""
    m = lambda v: {"value": v, "sigma": 0.01, "ci95_low": v, "ci95_high": v}
    walls = [{"id": "w0", "length_m": m(wall[0] if wall else 4.0), "p0_m": [0, 0], "p1_m": [4, 0], "openings": [{"id": "o0", "class": "door", "width_m": m(door[0])}] if door and door[0] else []}]
    p = {"tier": tier, "property": {"rooms": [{"id": "r0", "walls": walls, "ceiling_height_m": m(ceiling[0]) if ceiling else None}], "adjacencies": [{"a": x, "b": y} for x, y in (links or [[]])[0]], "footprint_area_m2": foot[0] if foot else None}, "quality": {"overlap_m2": 0.0}}
    t = {"evaluator_only": True, "rooms": [{"room_id": "r0", "walls": [{"wall_id": "w0", "length_m": wall[1] if wall else 4.0, "p0_m": [0, 0], "p1_m": [4, 0]}], "openings": [{"opening_id": "o0", "wall_id": "w0", "width_m": door[1]}] if door and door[1] else []}], **truth}
    if ceiling:
        t["rooms"][0]["ceiling_height_m"] = ceiling[1]
    if foot:
        t["footprint_m2"] = foot[1]
    if links:
        t["adjacencies"] = [{"room_a": y, "room_b": x} for x, y in links[1]]
    again = json.dumps({"property": {"rooms": [{"id": "r0", "walls": [{"id": "w0", "length_m": repeat}]}]}}) if repeat else None
    return name, json.dumps(p), json.dumps(t), again, None


def test_evaluation_of_golden_cases(spark):
    cases = [
        case("exact", "video", (4.0, 4.0), (0.8, 0.8), (2.5, 2.5)), case("wall", "video", (4.0, 3.8)), case("opening", "lidar", door=(0.85, 0.8)), case("missed", "lidar", door=(None, 0.8)), case("phantom", "lidar", door=(0.8, None)),
        case("ceiling", "lidar", ceiling=(2.53, 2.5)), case("repeat_pass", "lidar", repeat=4.004), case("repeat_fail", "lidar", repeat=4.08), case("foot_pass", "photo", foot=(12.0, 12.5), links=([("a", "b")], [("a", "b")])),
        case("foot_fail", "photo", foot=(10.0, 12.0)), case("links", "photo", links=([("a", "b")], [("a", "b"), ("b", "c")]), overlap_m2_max=0.0), case("taped", "lidar", provenance="laser_tape"), ("alone", cases_alone(), None, None, None),
    ]
    df = stored(spark.createDataFrame(cases, "case_id string, prediction string, ground_truth string, repeat string, drift_off string"))
    assert evaluate.structural_problems(df).count() == 0
    rows, metrics, states = (stored(x) for x in evaluate.evaluate(df))
    m = {(r.case_id, r.metric): r for r in metrics.collect()}
    row = {(r.case_id, r.metric, r.kind): r for r in rows.collect()}
    s = {r.case_id: r for r in states.collect()}
    assert all(m["exact", k].pass_rate == 1.0 for k in ("wall_accuracy", "opening_accuracy", "ceiling_accuracy")) and s["exact"].assessment_gate == "blocked"
    w = row["wall", "wall_accuracy", "wall"]
    assert (w.absolute_error, w.relative_error, w["pass"]) == (0.2, 0.052632, False)
    o = row["opening", "opening_accuracy", "opening"]
    assert (o.absolute_error, o["pass"], m["opening", "opening_accuracy"].gate_pass) == (0.05, False, False)
    assert m["missed", "opening_accuracy"].n_missed == 1 and m["phantom", "opening_accuracy"].n_phantom == 1 and row["ceiling", "ceiling_accuracy", "ceiling"].absolute_error == 0.03
    assert row["repeat_pass", "repeatability", "repeat_wall"]["pass"] and not row["repeat_fail", "repeatability", "repeat_wall"]["pass"] and row["repeat_pass", "wall_accuracy", "wall"]["pass"] is None
    f = row["foot_pass", "photo_property", "footprint"]
    assert (f.relative_error, f["pass"]) == (0.04, True) and not row["foot_fail", "photo_property", "footprint"]["pass"] and s["foot_pass"].links_missing == s["foot_pass"].links_phantom == []
    assert s["links"].links_missing == ["b|c"] and s["links"].overlap_pass and s["taped"].assessment_gate == "recorded"
    assert m["opening", "photo_property"].status == "not_applicable" and m["wall", "opening_accuracy"].status == "not_applicable" and m["wall", "repeatability"].status == "unavailable"
    assert m["alone", "wall_accuracy"].status == "unavailable" and s["alone"].drift == "evidence_only" and s["alone"].footprint_delta_m2 == 0.5
    assert s["alone"].blocked_metrics == ["wall_accuracy", "opening_accuracy", "ceiling_accuracy", "repeatability", "calibration", "assessment_gate"]
    r = {x.case_id: x for x in documents.reports(df.where("case_id in ('wall', 'exact')")).collect()}
    assert json.loads(r["wall"].report)["metrics"]["wall_accuracy"]["n_pass"] == 0 and "[wall_accuracy] evaluated  n_evaluated=1  n_pass=0" in r["wall"].text
    notes = {(x.case_id, x.status) for x in evaluate.room_notes(df).collect()}
    assert ("exact", "matched") in notes and len(notes) == 12


def cases_alone():
    return json.dumps({"tier": "lidar", "property": {"rooms": []}, "drift": {"footprint_area_m2_anchor_on": 12.5, "footprint_area_m2_anchor_off": 12.0}})


def test_documents_that_are_no_plan(spark):
    rows = [("a", "{}", None), ("b", '{"property": {"rooms": 3}}', '{"rooms": 1}'), ("c", '{"property": {"rooms": []}}', '{"rooms": [{"id": "x", "walls": [{"id": "w"}], "openings": [{"width_m": 1}]}], "adjacencies": 2}')]
    df = spark.createDataFrame([(*r, None, None) for r in rows], "case_id string, prediction string, ground_truth string, repeat string, drift_off string")
    assert Counter(r.case_id for r in evaluate.structural_problems(df).collect()) == {"a": 1, "b": 2, "c": 4}


def test_openings_are_taken_in_order(spark):
    rng = random.Random(3)

    def plain(truth, predicted):
        used, out = set(), []
        for i, (gid, wall, room, w) in enumerate(truth):
            best = None
            for k, (pid, pwall, proom, _) in enumerate(predicted):
                if k in used:
                    continue
                if gid and pid == gid or not gid and wall and pwall == wall and proom == room:
                    best = k
                    break
            if best is not None:
                used.add(best)
            e = predicted[best][3] if best is not None else None
            out.append(("miss", None) if best is None or w is None or e is None else ("true_positive", round(abs(e - w), 4)))
        return Counter(out + [("phantom", None) for k in range(len(predicted)) if k not in used])

    item = lambda: (rng.choice(["a", "b", "c", None, ""]), rng.choice(["w1", "w2", None]), rng.choice(["r", None]), rng.choice([0.8, 0.9, 1.0, None]))
    groups = {g: ([item() for _ in range(rng.randint(0, 7))], [item() for _ in range(rng.randint(0, 7))]) for g in range(80)}
    frame = lambda side: spark.createDataFrame([(g, i, *x) for g, both in groups.items() for i, x in enumerate(both[side])], "g int, ord int, id string, wall string, room string, width double")
    got = {g: Counter() for g in groups}
    for r in evaluate.score_openings(frame(0), frame(1), ["g"]).collect():
        got[r.g][r.kind, r.absolute_error_m] += 1
    assert got == {g: plain(*x) for g, x in groups.items()}


@pytest.mark.parametrize("rows, source, want", [
    ([(2.515, 2.5, 0.01)], "tape", ("passed", "PASS")), ([(2.516, 2.5, 0.01)], "tape", ("biased_but_repeatable", "FAIL")), ([(2.5, 2.5, 0.011)], "tape", ("unrepeatable", "FAIL")), ([(2.52, 2.5, 0.011)], "tape", ("both", "FAIL")),
    ([(2.5, 2.5, 0.0)], "faro", ("passed", "BLOCKED")), ([(2.5, 2.5, None)], "tape", ("repeat_not_measured", "BLOCKED")), ([(2.6, 2.5, None)], "tape", ("biased_repeat_not_measured", "FAIL")),
    ([(2.5, 2.5, 0.005), (2.5, 2.5, None)], "tape", ("passed", "PASS")), ([(None, 2.5, 0.2), (2.5, 2.5, 0.0)], "tape", ("passed", "PASS")), ([(None, 2.5, 0.2)], "tape", ("blocked", "BLOCKED")), ([(2.5, 2.5, 0.0)], "Laser ", ("passed", "BLOCKED")),
])
def test_ceiling_gate_at_its_limits(spark, rows, source, want):
    df = spark.createDataFrame([("r", *x, source) for x in rows], "k string, predicted double, truth double, spread double, source string")
    g = scoring.ceiling_gate(df, ["k"]).first()
    assert (g.classification, g.status) == want


def test_concealed_rules(spark):
    walls = spark.createDataFrame([("c", "w0", 0), ("c", "w1", 1), ("c", "w2", 1)], "capture_id string, wall_id string, windows int")
    regions = spark.createDataFrame([("c", "w0", "stain", 0.1, 0.9, 1.0), ("c", "w1", "moisture", 0.4, 0.8, 1.0), ("c", "w2", "stain", 0.2, 0.5, 0.03)], "capture_id string, wall_id string, class string, bottom double, top double, extent_m2 double")
    got = {(r.wall_id, r.rule): r.fired for r in damage.concealed_flags(walls, regions).collect()}
    base, sill = "base_stain_moisture_path", "sill_stain_under_window"
    assert got == {("w0", base): True, ("w0", sill): False, ("w1", base): False, ("w1", sill): True, ("w2", base): False, ("w2", sill): False}
    assert [r.code for r in damage.scope_items(regions).orderBy("wall_id").collect()] == ["INTERIOR_PAINT", "MOISTURE_OPEN_AND_INSPECT", "INTERIOR_PAINT"]


def test_gates_of_a_full_manifest(spark):
    rows = [{"measurement_type": "wall_length", "wall_id": "w", "value_m": 4.0, "predicted_m": 4.1}, {"measurement_type": "floor_area", "value_m": 12.0, "predicted_m": 12.5}, {"measurement_type": "ceiling_height", "value_m": 2.5, "predicted_m": 2.51, "repeat_spread_m": 0.002}]
    truth = {
        "source": "laser", "calibration": {"scale": "tape"}, "measurements": rows, "openings": [{"opening_id": "a", "width_m": 0.8}], "predicted_openings": [{"opening_id": "a", "width_m": 0.81}], "rooms": ["x", "y"], "adjacencies": [{"a": "x", "b": "y"}],
        "footprint_m2": 12.0, "predicted_stitch": {"rooms": ["x", "y"], "adjacencies": [{"room_a": "y", "room_b": "x"}], "overlap_m2": 0.0, "footprint_m2": 12.3},
    }
    files = {
        "truth": truth, "repeat": {"walls": [{"wall_id": "w", "length_a_m": 4.0, "length_b_m": 4.005}]}, "damage": {"source": "survey", "regions": [{"surface_id": "w", "class": "stain"}], "predicted": [{"surface_id": "w", "class": "stain"}, {"surface_id": None, "class": "stain"}]},
        "plan": {"status": "ok", "property": {"rooms": [{"id": "x"}]}}, "sold": {"vendor": "v", "dimensions": [{"incumbent_error_m": 0.1, "ours_error_m": 0.1}, {"incumbent_error_m": 0.1, "ours_error_m": 0.2}, {"ours_error_m": 0.2}]},
    }
    m = {"property_id": "p", "room_ids": ["x"], "ground_truth": "truth", "repeat_capture": "repeat", "damage_ground_truth": "damage", "incumbent_export": "sold", "photo_folder": "photos", "video_capture": "v.mp4", "predictions": {"video": "plan"}}
    bare = {"ground_truth": "none"}
    manifests = spark.createDataFrame([("full", json.dumps(m)), ("bare", json.dumps(bare))], "key string, manifest string")
    listing = spark.createDataFrame([("full", n, json.dumps(d), False) for n, d in files.items()] + [("full", "photos", None, True)], "key string, path string, content string, is_dir boolean")
    gates = stored(manifest.run_manifests(manifests, listing))
    got = {(r.key, r.gate): r.status for r in gates.collect()}
    want = {"openings": "PASS", "ceiling": "PASS", "repeatability": "PASS", "photo_walls": "PASS", "photo_footprint": "PASS", "stitch": "PASS", "video_walls": "PASS", "damage": "FAIL", "incumbent": "FAIL"}
    want["video_walls"] = "PASS" if 0.1 / 4 <= 0.03 else "FAIL"
    assert got == {("full", g): s for g, s in want.items()} | {("bare", g): "BLOCKED" for g in manifest.GATES}
    table = {r.key: r for r in documents.gate_tables(gates, manifest.GATES).collect()}
    assert table["full"].failed and "| damage | FAIL | damage regions |" in table["full"].table and json.loads(table["bare"].assessment)["gates"]["stitch"]["status"] == "BLOCKED"
    assert {r.key: r.missing for r in manifest.missing_fields(manifests).collect()}["full"] == ["lidar_capture"]
    problems = manifest.measurement_problems(spark.createDataFrame([("full", json.dumps(truth | {"source": "Estimated", "measurements": [{"measurement_type": "x", "source": "tape"}]}))], "key string, doc string"))
    assert Counter(r.problem for r in problems.collect()) == Counter(["estimated source is not ground truth", "measurements[0] has an unknown measurement_type", "measurements[0] needs value_m"])
    out = {(r.folder, r.name): r.content for r in documents.assessment_files(gates, manifests, problems, manifest.GATES).collect()}
    assert json.loads(out["full", "incumbent.json"])["status"] == "FAIL" and len(json.loads(out["full", "validation.json"])["problems"]) == 3
    blocks = {r.block: (r.path, r.block_property) for r in manifest.normalized_manifests(manifests.where("key = 'full'")).collect()}
    assert blocks["repeat"] == ("repeat", "p") and blocks["lidar"] == (None, "p")


def test_folder_problems(spark):
    files = [("a", "depth/1.png"), ("a", "depth/2.png"), ("a", "confidence/1.png"), ("a", "odometry.csv"), ("b", "x.mp4"), ("b", "sub/odometry.csv"), ("c", "x.mp4")]
    l = spark.createDataFrame(files, "capture_id string, path string")
    assert Counter(r.capture_id for r in manifest.lidar_folder_problems(l).collect()) == {"a": 2, "b": 4, "c": 4}
    poses = spark.createDataFrame([("b", 0, 1.0), ("b", 1, 1.0), ("c", 0, 2.0), ("c", 1, 1.0)], "capture_id string, pose_index int, ts double")
    assert {r.capture_id: r.problem for r in manifest.video_folder_problems(l, poses).collect()} == {"a": "video capture needs an mp4 walkthrough", "c": "video odometry timestamps are not in frame order"}


def test_fix_reports(spark):
    doc = lambda v: json.dumps({"property": {"rooms": [{"walls": [{"length_m": {"value": x}} for x in v]}]}})
    a = spark.createDataFrame([("a", doc([4.0, 3.0])), ("b", doc([1.0]))], "capture_id string, document string")
    b = spark.createDataFrame([("a", doc([3.9, 3.0])), ("c", doc([2.0]))], "capture_id string, document string")
    got = {r.capture_id: (r.before, r.after, r.delta, r.missing) for r in documents.fix_reports(a, b).collect()}
    assert got == {"a": (4.0, 3.9, -0.1, []), "b": (1.0, None, None, ["after"]), "c": (None, 2.0, None, ["before"])}


def test_truth_by_kind(spark):
    doc = {"property_id": "p", "measurements": [{"kind": "ceiling", "value": 250, "unit": "cm", "predicted_m": 2.51, "repeat_spread_m": 0.001}, {"kind": "wall", "wall_id": "w", "value_m": 4.0, "predicted_m": 4.2}, {"kind": "area", "value_m": 12.0, "predicted_m": 12.1}], "openings": [{"opening_id": "o", "width_m": 0.8}]}
    docs = spark.createDataFrame([("a", json.dumps(doc)), ("b", json.dumps({"measurements": []})), ("c", json.dumps(doc))], "key string, doc string")
    rows = stored(manifest.ground_truth_rows(docs))
    first = rows.where("key = 'a' and ord = 0").first()
    assert (first.value_m, first.unit, first.measurement_type) == (2.5, "m", "ceiling_height")
    found = spark.createDataFrame([("a", 0, "o", None, None, 0.815), ("c", 0, "o", None, None, 0.9)], "key string, ord int, id string, wall string, room string, width double")
    sources = spark.createDataFrame([("a", "tape"), ("b", "tape"), ("c", "tape")], "key string, source string")
    got = {(r.key, r.gate): r.status for r in manifest.compared_by_kind(rows, found, sources).collect()}
    assert got == {("a", "openings"): "PASS", ("a", "ceiling"): "PASS", ("a", "photo"): "PASS", ("b", "openings"): "BLOCKED", ("b", "ceiling"): "BLOCKED", ("b", "photo"): "BLOCKED", ("c", "openings"): "FAIL", ("c", "ceiling"): "PASS", ("c", "photo"): "PASS"}


def test_specs_and_cameras(spark):
    from planimeter.operators.align import frame_intrinsics
    from planimeter.sources.captures import wall_specs

    docs = spark.createDataFrame([("c", "a", '{"synthetic_fixture": true, "x0": 0, "z0": 1, "x1": 2, "z1": 3}'), ("c", "b", '{"x0": 0}')], "capture_id string, room_id string, doc string")
    assert [tuple(r) for r in wall_specs(docs).collect()] == [("c", "a", 0.0, 1.0, 2.0, 3.0, 2.5)]
    own = "struct(7.0D as fx, 7.0D as fy, 1.0D as cx, 2.0D as cy)"
    rows = spark.sql(f"select 10.0D as fx, 10.0D as fy, 4.0D as cx, 3.0D as cy, {own} as own union all select 0.5D, 9.0D, 1.0D, 1.0D, {own} union all select 0.5D, 9.0D, 1.0D, 1.0D, null")
    k = frame_intrinsics(*[F.col(n) for n in ("fx", "fy", "cx", "cy", "own")], F.lit(0.5), F.lit(0.25), F.lit(100), F.lit(80))
    assert [tuple(r.k) for r in rows.select(k.alias("k")).collect()] == [(5.0, 2.5, 2.0, 0.75), (7.0, 7.0, 1.0, 2.0), (85.0, 85.0, 50.0, 40.0)]


def test_mean_extent_errors(spark):
    from planimeter.operators import assess

    rows = [("a", 1, 1, 0.3, 0.25), ("a", 2, 2, 0.1, 0.2), ("a", 3, None, 0.4, None), ("b", 1, 1, None, 0.1)]
    df = spark.createDataFrame([(*r, "tape", False) for r in rows], "k string, truth_id int, predicted_id int, truth double, predicted double, source string, synthetic boolean")
    assert {r.k: (r.status, r.mean_extent_error_m2) for r in assess.damage_gate(df, ["k"]).collect()} == {"a": ("FAIL", 0.075), "b": ("PASS", None)}


def test_openings_broadcast_no_points(spark):
    """Exploded points look small to the planner: runs join nothing, and samples are joined by sorting."""
    p = spark.range(50).select(F.col("id").alias("wall"), F.explode(F.sequence(F.lit(0), F.lit(99))).alias("i")).select("wall", (F.col("i") / 100.0).alias("along"), F.lit(1.0).alias("height"))
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    for runs in (lines.support_runs(p, ["wall"]), lines.sparse_runs(p, ["wall"])):
        assert "Join" not in plan(runs)
        assert runs.count() == 50
    gaps = spark.createDataFrame([(1, 0.2, 0.9)], "wall long, gap0 double, gap1 double")
    assert "BroadcastHashJoin" not in plan(openings.jambs(gaps, p, ["wall"]))


def test_evaluation_stays_within_cases(spark):
    """Documents are compared where they are: nothing is stored or dealt out, whatever the names in them."""
    wall = lambda i, v, z, *cuts: {"id": i, "length_m": v, "p0_m": [0, z], "p1_m": [4, z], "openings": [{"id": o, "width_m": w} for o, w in cuts]}
    p = {"tier": "video", "property": {"rooms": [{"id": "a", "walls": [wall("w", 4.0, 0, ("o", 0.8), (None, 0.9)), wall("w", 3.0, 9), wall(None, {"value": 2.0}, 5), None]}, {"id": "", "walls": [wall("w", 1.0, 0)]}, {"id": "b"}]}}
    t = {"room_map": {"a": "A"}, "rooms": [{"room_id": "A", "walls": [wall("w", 3.0, 0), wall("y", 2.0, 5.5), wall("z", 7.0, 8)], "openings": [{"id": "o", "wall_id": "w", "width_m": 0.8}, {"id": "q", "wall_id": "w", "width_m": "x"}]}, {"room_id": "b", "walls": None}, None]}
    df = spark.createDataFrame([("a", json.dumps(p), json.dumps(t), json.dumps(p), None), ("b", None, None, None, None), ("c", "{", "[]", "{}", "{}")], "case_id string, prediction string, ground_truth string, repeat string, drift_off string")
    rows, metrics, states = evaluate.evaluate(df)
    for x in (rows, metrics, states):
        assert "Exchange" not in x._jdf.queryExecution().executedPlan().toString()
    found = Counter((r.metric, r.kind, r.id, r.ground_truth_id, r.absolute_error) for r in rows.collect())
    assert found == Counter([
        ("wall_accuracy", "wall", "w", "w", 0.0), ("wall_accuracy", "wall", "y", "y", 0.0), ("wall_accuracy", "wall", "w", "z", 3.0), ("wall_accuracy", "phantom_wall", None, None, None), ("opening_accuracy", "opening", "o", "o", 0.0),
        ("opening_accuracy", "opening", "q", "q", None), ("repeatability", "repeat_wall", "w", "w", 1.0), ("repeatability", "repeat_wall", "w", "w", 0.0), ("repeatability", "repeat_wall", None, None, 0.0),
    ])


def test_frames_are_read_once(spark):
    """frame_openings() reads each sample once, and says what openings() and aggregate_jambs() say of the same rows."""
    import random

    r, rows = random.Random(3), []
    for i in range(120):
        gap0, width, pitch, repeats = r.uniform(0.6, 2.4), r.choice([0.5, 0.7, 0.8, 0.9, 1.0, 1.18, 1.24, 1.4]), r.choice([0.005, 0.01, 0.02, 0.04, 0.05]), r.choice([1, 2, 3])
        for f in range(r.choice([1, 2, 3])):
            p = [x + r.choice([0, 0, r.gauss(0, 0.004)]) for x in profile(gap0, width, pitch, repeats=repeats, phase=f * pitch / 3)] + [r.uniform(0, 4) for _ in range(r.choice([0, 0, 2, 9]))]
            rows += [(i, f, x) for x in r.sample(p, int(len(p) * r.choice([1, 1, 0.9, 0.5])))]
    rows += [(200, None, x / 50) for x in range(99)] + [(None, 1, x / 50) for x in range(99)] + [(201, 1, None)] * 20 + [(202, 1, x) for x in profile(1.2, 0.8, 0.01)] + [(202, 1, float("nan"))] * 3 + [(202, 1, None)] * 2 + [(203, 1, 0.1)] * 9
    r.shuffle(rows)
    # In the order of frames half the time, so that neighbours gather.
    rows = sorted(rows[::2], key=lambda x: (x[0] or 0, x[1] or 0)) + rows[1::2]
    seen = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    df = spark.createDataFrame(rows, "wall int, frame int, along double")
    got = openings.frame_openings(df.mapInArrow(counted, df.schema), ["wall"]).collect()
    assert seen.value == len(rows)
    by = ["wall", "frame"]
    points = stored(df.join(df.groupBy(*by).count().where("count >= 10").drop("count"), by).withColumn("height", F.lit(1.0)))
    spans = points.select(*by).distinct().withColumns({"a0": F.lit(0.0), "a1": F.lit(4.0), "abs_floor": F.lit(0.012)})
    doors = stored(openings.openings(points, spans, by))
    doors = doors.join(doors.groupBy(*by).count().where("count = 1").drop("count"), by)
    want = lines.aggregate_jambs(stored(doors.selectExpr("wall", "along0 as `left`", "along1 as `right`", "sigma as half_left", "sigma as half_right", "method")), ["wall"]).collect()
    assert len(got) > 50 and sorted(got) == sorted(want)
