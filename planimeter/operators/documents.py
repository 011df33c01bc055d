"""Documents: plans under one contract, their text and drawing, reports and assessments, all as rows of text.

A document is JSON text made by to_json; writers take rows of folder, name and content (sources/sinks.py)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planimeter.operators import evaluate, plan, rooms

M = "struct<value:double,sigma:double,ci95_low:double,ci95_high:double>"
LINK = "struct<a:string,b:string,room_a:string,room_b:string,kind:string,relationship:string,source:string,gap_m:double,shared_length_m:double>"


def _full(*names: Column) -> Column:
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])


def _by_id(items: Column) -> Column:
    """Items sorted by id; a null one counts as empty."""
    key = lambda x: F.coalesce(x["id"], F.lit(""))
    return F.array_sort(items, lambda a, b: F.when(key(a) < key(b), -1).when(key(a) > key(b), 1).otherwise(0))


def normalized_rooms(listed: Column) -> Column:
    """Rooms (as plan.room_documents() makes them) with both names of each field, their measurements gathered, a status (ok
    with a polygon of three points and walls) and everything in order of ids."""
    def opening(o: Column) -> Column:
        return o.withField("measurements", F.struct(o["width_m"].alias("width_m"), o["sill_height_m"].alias("sill_height_m"), o["head_height_m"].alias("head_height_m")))

    def wall(w: Column) -> Column:
        return w.withField("openings", _by_id(F.transform(w["openings"], opening))).withField("measurements", F.struct(w["length_m"].alias("length_m"), w["height_m"].alias("height_m")))

    def room(r: Column) -> Column:
        name = F.coalesce(r["id"], F.lit(""))
        closed = F.coalesce((F.size(r["polygon_m"]) >= 3) & (F.size(r["walls"]) > 0), F.lit(False))
        return (
            r.withField("id", name).withField("room_id", name).withField("floor_polygon", r["polygon_m"]).withField("status", F.when(closed, "ok").otherwise("degraded"))
            .withField("reasons", F.when(closed, F.array().cast("array<string>")).otherwise(F.array(F.lit("no_room_closure"))))
            .withField("measurements", F.struct(r["floor_area_m2"].alias("floor_area_m2"), r["ceiling_height_m"].alias("ceiling_height_m"))).withField("walls", _by_id(F.transform(r["walls"], wall)))
        )

    return _by_id(F.transform(F.coalesce(listed, F.array()), room))


def normalized_links(links: DataFrame, placed: DataFrame) -> DataFrame:
    """Links (capture_id, link of type LINK) between two different rooms there are (capture_id, room_id, polygon), one list
    a capture in order of names: capture_id, links.

    A link needs a kind or relationship; both names of each field are filled; a missing shared length is that of the
    closest pair of edges, a missing source geometry."""
    c = F.col
    ends = links.select("capture_id", _full(c("link.room_a"), c("link.a")).alias("room_a"), _full(c("link.room_b"), c("link.b")).alias("room_b"), _full(c("link.relationship"), c("link.kind")).alias("kind"), c("link.source").alias("source"), c("link.gap_m").alias("gap_m"), c("link.shared_length_m").alias("_s"))
    good = rooms.valid_links(ends.where("room_a is not null and room_b is not null and kind is not null"), placed)
    met = rooms.shared_edges(placed).select("capture_id", c("room_a").alias("_a"), c("room_b").alias("_b"), c("shared_length_m").alias("_l"))
    met = met.withColumnRenamed("capture_id", "_c")
    j = good.join(met, (c("capture_id") == c("_c")) & (F.least("room_a", "room_b") == c("_a")) & (F.greatest("room_a", "room_b") == c("_b")), "left")
    link = F.struct(
        "room_a", "room_b", c("kind").alias("relationship"), c("room_a").alias("a"), c("room_b").alias("b"), "kind", F.coalesce(_full(c("source")), F.lit("geometry")).alias("source"), "gap_m", F.round(F.coalesce("_s", "_l"), 4).alias("shared_length_m"),
    )
    return j.groupBy("capture_id").agg(F.array_sort(F.collect_list(link)).alias("links"))


def contract(docs: DataFrame, links: DataFrame | None = None) -> DataFrame:
    """Plan documents (capture_id, status, degraded_reasons, rooms and others) under the common contract, adjacencies among
    their columns. links: capture_id, link; those that name an unknown room or one room twice are dropped, none are added. A
    plan without rooms is degraded; one that claimed to be fine gets no_room_closure for a reason."""
    c = F.col
    d = docs.withColumns({"rooms": normalized_rooms(c("rooms")), "degraded_reasons": F.coalesce("degraded_reasons", F.array().cast("array<string>"))})
    none = F.array().cast(f"array<{LINK}>")
    if links is None:
        d = d.withColumn("adjacencies", none)
    else:
        point = lambda p: F.struct(F.get(p, F.lit(0)).alias("x"), F.get(p, F.lit(1)).alias("z"))
        placed = d.select("capture_id", F.explode("rooms").alias("r")).select("capture_id", c("r.room_id").alias("room_id"), F.transform("r.polygon_m", point).alias("polygon"))
        d = d.join(normalized_links(links, placed), "capture_id", "left").withColumn("adjacencies", F.coalesce("links", F.array())).drop("links")
    empty = F.size("rooms") == 0
    fine = F.coalesce(c("status") == "ok", F.lit(False)) & (F.size("degraded_reasons") == 0)
    reasons = F.when(empty & fine, F.array(F.lit("no_room_closure"))).otherwise(c("degraded_reasons"))
    return d.withColumns({"degraded_reasons": reasons, "status": F.when(empty, "degraded").otherwise(c("status"))})


def plan_documents(made: plan.Plan, tier: str, source: str, mode: str = "intersections", found: DataFrame | None = None, off: DataFrame | None = None) -> DataFrame:
    """The document of each capture with notes: capture_id, document (JSON), status, n_rooms.

    found: capture_id, reasons observed before the layout (video and photo tiers). off: capture_id, footprint_m2 without the
    floor anchor."""
    c = F.col
    listed = plan.room_documents(made, tier).groupBy("capture_id").agg(F.collect_list("room").alias("rooms"))
    area = plan.footprint(made)
    edges = rooms.shared_edges(made.rooms.select("capture_id", F.concat(F.lit("room_"), c("room").cast("string")).alias("room_id"), "polygon"))
    none = {n: F.lit(None).cast(k) for n, k in (("relationship", "string"), ("source", "string"))}
    link = F.struct(c("room_a").alias("a"), c("room_b").alias("b"), "room_a", "room_b", F.lit("shared_wall").alias("kind"), *[v.alias(n) for n, v in none.items()], F.round("gap_m", 4).alias("gap_m"), F.lit(None).cast("double").alias("shared_length_m"))
    links = edges.select("capture_id", link.alias("link"))
    d = made.notes.join(listed, "capture_id", "left").join(area, "capture_id", "left").join(made.theta, "capture_id", "left")
    d = d.withColumn("rooms", F.coalesce("rooms", F.array().cast(listed.schema["rooms"].dataType)))
    d = d.withColumn("_before", F.lit(None).cast("array<string>")) if found is None else d.join(found.select("capture_id", c("reasons").alias("_before")), "capture_id", "left")
    d = d.withColumn("_off", F.lit(None).cast("double")) if off is None else d.join(off.select("capture_id", c("footprint_m2").alias("_off")), "capture_id", "left")
    seen = F.coalesce("_before", F.array().cast("array<string>"))
    thin = F.exists("notes", lambda n: n.contains("not enough wall points") | n.contains("too few points"))
    empty = F.size("rooms") == 0
    observed = F.concat(seen, F.when(empty & thin, F.array(F.lit("insufficient_points"))).otherwise(F.array().cast("array<string>")), F.when(empty, F.array(F.lit("no_room_closure"))).otherwise(F.array().cast("array<string>")))
    order = {"video": ("low_texture", "weak_overlap", "insufficient_points", "no_room_closure", "missing_pose"), "photo": plan.PHOTO_REASONS}.get(tier, ())
    reasons = F.filter(F.array(*map(F.lit, order)), lambda r: F.array_contains(observed, r)) if order else F.array().cast("array<string>")
    d = d.withColumn("degraded_reasons", reasons).withColumn("status", F.when(empty | (F.size("degraded_reasons") > 0), "degraded").otherwise("ok"))
    d = contract(d, links)
    on = F.round(F.coalesce("footprint_m2", F.lit(0.0)), 4)
    drift = F.struct(on.alias("footprint_area_m2_anchor_on"), F.round("_off", 4).alias("footprint_area_m2_anchor_off"))
    body = F.struct(
        F.lit("1.0").alias("schema_version"), "status", "degraded_reasons", "capture_id", F.lit(tier).alias("tier"), F.lit("meters").alias("units"), F.lit(source).alias("source"), F.lit(mode).alias("endpoint_mode"), drift.alias("drift"),
        F.struct("rooms", "adjacencies", on.alias("footprint_area_m2"), F.round(F.degrees("theta"), 3).alias("manhattan_theta_deg")).alias("property"), "notes",
    )
    return d.select("capture_id", F.to_json(body, {"ignoreNullFields": "false"}).alias("document"), "status", F.size("rooms").alias("n_rooms"))


_ROOMS = f"array<struct<id:string,polygon_m:array<array<double>>,floor_area_m2:{M},ceiling_height_m:{M},walls:array<struct<id:string,length_m:{M},openings:array<struct<class:string,width_m:{M}>>>>,damage:array<struct<class:string,surface_id:string,extent_m2:{M}>>>>"
_READ = f"struct<capture_id:string,tier:string,status:string,degraded_reasons:array<string>,notes:array<string>,property:struct<rooms:{_ROOMS}>,drift:struct<footprint_area_m2_anchor_on:double,footprint_area_m2_anchor_off:double>>"


def summaries(docs: DataFrame) -> DataFrame:
    """A text of each plan document (capture_id, document): rooms with intervals, walls with openings, damage, notes."""
    d = docs.select("capture_id", F.from_json("document", _READ).alias("d"))
    span = lambda m: F.format_string(" [%.3f, %.3f]", m["ci95_low"], m["ci95_high"])

    def wall(w: Column) -> Column:
        cut = F.array_join(F.transform(w["openings"], lambda o: F.format_string("%s %.2f m", o["class"], o["width_m"]["value"])), ", ")
        return F.concat(F.format_string("    %s: %.3f m", w["id"], w["length_m"]["value"]), span(w["length_m"]), F.lit(" ("), F.coalesce(F.nullif(cut, F.lit("")), F.lit("no opening")), F.lit(")"))

    def room(r: Column) -> Column:
        high = F.coalesce(r["ceiling_height_m"]["value"].cast("string"), F.lit("not observed"))
        head = F.concat(F.format_string("  %s: area %.3f m^2", r["id"], r["floor_area_m2"]["value"]), span(r["floor_area_m2"]), F.lit(" ceiling "), high)
        hurt = F.transform(F.coalesce(r["damage"], F.array().cast(f"array<struct<class:string,surface_id:string,extent_m2:{M}>>")), lambda x: F.format_string("    damage %s %.3f m^2 on %s", x["class"], x["extent_m2"]["value"], x["surface_id"]))
        return F.concat(F.array(head), F.transform(r["walls"], wall), hurt)

    said = lambda v: F.coalesce(v.cast("string"), F.lit("None"))
    top = F.array(F.concat(F.lit("capture: "), "d.capture_id"), F.concat(F.lit("tier: "), "d.tier"), F.concat(F.lit("status: "), "d.status"), F.concat(F.lit("rooms: "), F.size("d.property.rooms").cast("string")))
    foot = F.concat(F.lit("footprint anchor on "), said(F.col("d.drift.footprint_area_m2_anchor_on")), F.lit(" off "), said(F.col("d.drift.footprint_area_m2_anchor_off")))
    notes = F.transform(F.coalesce("d.notes", F.array().cast("array<string>")), lambda n: F.concat(F.lit("  - "), n))
    lines = F.concat(top, F.flatten(F.transform("d.property.rooms", room)), F.array(foot, F.lit("notes:")), notes)
    return d.select("capture_id", F.concat(F.array_join(lines, "\n"), F.lit("\n")).alias("summary"))


def drawings(docs: DataFrame, width: int = 900, height: int = 700) -> DataFrame:
    """An SVG of the rooms of each plan document: capture_id, svg. Plans without rooms have none."""
    d = docs.select("capture_id", F.from_json("document", _READ).alias("d")).select("capture_id", F.col("d.property.rooms.polygon_m").alias("p")).where(F.size("p") > 0)
    axis = lambda i: F.flatten(F.transform("p", lambda poly: F.transform(poly, lambda q: F.get(q, F.lit(i)))))
    d = d.withColumns({"_x": F.array_min(axis(0)) - 1, "_y": F.array_min(axis(1)) - 1, "_w": F.array_max(axis(0)) + 1, "_h": F.array_max(axis(1)) + 1})
    d = d.withColumn("_s", F.least(width / F.greatest(F.col("_w") - F.col("_x"), F.lit(0.1)), height / F.greatest(F.col("_h") - F.col("_y"), F.lit(0.1))))
    at = lambda q: F.format_string("%.1f,%.1f", (F.get(q, F.lit(0)) - F.col("_x")) * F.col("_s"), height - (F.get(q, F.lit(1)) - F.col("_y")) * F.col("_s"))
    shape = lambda poly: F.concat(F.lit("<polygon points='"), F.array_join(F.transform(poly, at), " "), F.lit("' fill='#e7eef6' stroke='#1c1c1c' stroke-width='2'/>"))
    head = F.array(F.lit(f"<svg xmlns='http://www.w3.org/2000/svg' width='{width}' height='{height}'>"), F.lit("<rect width='100%' height='100%' fill='#f7f5f1'/>"))
    return d.select("capture_id", F.array_join(F.concat(head, F.transform("p", shape), F.array(F.lit("</svg>"))), "\n").alias("svg"))


def reports(cases: DataFrame) -> DataFrame:
    """The report of each case: case_id, report (JSON), text."""
    rows, metrics, states = evaluate.evaluate(cases)
    row = F.struct(*[n for n in evaluate.ROW if n not in ("case_id", "metric")])
    held = rows.groupBy("case_id", "metric").agg(F.array_sort(F.collect_list(row)).alias("rows"))
    m = metrics.join(held, ["case_id", "metric"], "left").withColumn("rows", F.coalesce("rows", F.array().cast(held.schema["rows"].dataType)))
    order = F.array_position(F.array(*map(F.lit, evaluate.METRICS)), F.col("metric"))
    block = F.struct(order.alias("o"), "metric", "status", "n_evaluated", "n_pass", "pass_rate", "n_missed", "n_phantom", "worst_abs_error_m", "gate_pass", "rows")
    g = m.groupBy("case_id").agg(F.array_sort(F.collect_list(block), lambda a, b: (a["o"] - b["o"]).cast("int")).alias("metrics"))
    j = states.join(g, "case_id")
    plain = F.map_from_entries(F.transform("metrics", lambda b: F.struct(b["metric"], b.dropFields("o", "metric"))))
    body = F.to_json(F.struct("case_id", "tier", "evaluator_only", F.struct(F.col("assessment_gate").alias("status"), F.col("assessment_reason").alias("reason")).alias("assessment_gate"), plain.alias("metrics"), "calibration", "adjacency", "links_missing", "links_phantom", "overlap", "overlap_pass", "footprint_delta_m2", "blocked_metrics"), {"ignoreNullFields": "false"})  # noqa: E501
    number = lambda b, n: F.when(b[n].isNotNull(), F.concat(F.lit(f"{n}="), b[n].cast("string")))
    line = lambda b: F.concat(F.lit("["), b["metric"], F.lit("] "), b["status"], F.coalesce(F.concat(F.lit("  "), F.nullif(F.array_join(F.array_compact(F.array(*[number(b, n) for n in ("n_evaluated", "n_pass", "pass_rate", "n_missed", "n_phantom", "worst_abs_error_m")])), "  "), F.lit(""))), F.lit("")))  # noqa: E731, E501
    head = F.array(F.concat(F.lit("case: "), "case_id"), F.concat(F.lit("tier: "), F.coalesce("tier", F.lit("None"))), F.concat(F.lit("assessment gate: "), "assessment_gate", F.lit(" - "), "assessment_reason"))
    tail = F.array(F.concat(F.lit("[calibration] "), "calibration"), F.concat(F.lit("blocked or unavailable: "), F.array_join("blocked_metrics", ", ")))
    text = F.concat(F.array_join(F.concat(head, F.transform("metrics", line), tail), "\n"), F.lit("\n"))
    return j.select("case_id", body.alias("report"), text.alias("text"))


def gate_tables(gates: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """A Markdown table of each key's gates (key, gate, status, reason) in the order given, and the assessment as JSON: key,
    table, assessment, failed."""
    place = F.array_position(F.array(*map(F.lit, order)), F.col("gate"))
    g = gates.groupBy("key").agg(F.array_sort(F.collect_list(F.struct(place.alias("o"), "gate", "status", "reason"))).alias("g"))
    line = lambda x: F.concat(F.lit("| "), x["gate"], F.lit(" | "), x["status"], F.lit(" | "), F.replace(F.coalesce(x["reason"], F.lit("")), F.lit("|"), F.lit("/")), F.lit(" |"))
    head = F.array(F.concat(F.lit("# Assessment "), F.col("key").cast("string")), F.lit(""), F.lit("| Gate | Status | Reason |"), F.lit("| --- | --- | --- |"))
    foot = F.array(F.lit(""), F.lit("BLOCKED: a file or a physical source is missing. DEGRADED: the run gave no measurement. Neither is a pass."))
    body = F.to_json(F.struct(F.col("key").alias("property_id"), F.map_from_entries(F.transform("g", lambda x: F.struct(x["gate"], F.struct(x["status"].alias("status"), x["reason"].alias("reason"))))).alias("gates")))
    return g.select("key", F.concat(F.array_join(F.concat(head, F.transform("g", line), foot), "\n"), F.lit("\n")).alias("table"), body.alias("assessment"), F.exists("g", lambda x: x["status"] == "FAIL").alias("failed"))


def gate_value(pass_rate: Column, max_error: Column, beat_or_tie: Column, footprint_percent: Column, classification: Column) -> Column:
    """The number a gate's table shows: the first that is there."""
    return F.coalesce(*[v.cast("string") for v in (pass_rate, max_error, beat_or_tie, footprint_percent, classification)], F.lit(""))


def fix_reports(before: DataFrame, after: DataFrame) -> DataFrame:
    """Longest wall of each capture's plan (capture_id, document) before and after a fix: capture_id, before, after, delta,
    missing, status (BLOCKED: one capture seen twice is no second one), text."""
    def longest(t: DataFrame, name: str) -> DataFrame:
        d = t.select("capture_id", F.from_json("document", _READ).alias("d"))
        lengths = F.flatten(F.transform("d.property.rooms", lambda r: F.transform(r["walls"], lambda w: w["length_m"]["value"])))
        return d.select("capture_id", F.array_max(lengths).alias(name), F.lit(True).alias(f"_{name}"))

    j = longest(before, "before").join(longest(after, "after"), "capture_id", "full_outer")
    delta = F.round(F.col("after") - F.col("before"), 4)
    missing = F.array_compact(F.array(F.when(F.col("_before").isNull(), "before"), F.when(F.col("_after").isNull(), "after")))
    still = F.when(F.abs(delta) < 1e-6, "the change did not move the longest wall").otherwise("one capture seen two ways does not close the repeatability gate")
    text = F.concat_ws("\n", F.lit("# Fix loop"), F.concat(F.lit("before "), F.coalesce(F.col("before").cast("string"), F.lit("none")), F.lit(" m, after "), F.coalesce(F.col("after").cast("string"), F.lit("none")), F.lit(" m")), still)
    return j.select("capture_id", "before", "after", delta.alias("delta"), missing.alias("missing"), F.lit("BLOCKED").alias("status"), text.alias("text"))


def assessment_files(gates: DataFrame, manifests: DataFrame, problems: DataFrame, order: tuple[str, ...]) -> DataFrame:
    """Files of assessment folders as rows of folder, name, content: the manifest, its validation, the gates as JSON and
    Markdown, compliance and the incumbent's and repeat gates by themselves. problems: key, problem."""
    t = gate_tables(gates, order)
    bad = problems.groupBy("key").agg(F.array_sort(F.collect_list("problem")).alias("problems"))
    j = manifests.join(t, "key").join(bad, "key", "left").withColumn("problems", F.coalesce("problems", F.array().cast("array<string>")))
    one = lambda gate: F.coalesce(F.get_json_object("assessment", f"$.gates.{gate}"), F.lit('{"status":"BLOCKED"}'))
    files = {
        "input_manifest.json": F.col("manifest"), "validation.json": F.to_json(F.struct(F.col("key").alias("property_id"), "problems")), "assessment.json": F.col("assessment"), "assessment.md": F.col("table"), "benchmark.json": F.col("assessment"),
        "benchmark.md": F.col("table"), "compliance.json": F.get_json_object("assessment", "$.gates"), "final_report.md": F.col("table"), "incumbent.json": one("incumbent"), "repeatability.json": one("repeatability"),
    }
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), v.alias("content")) for n, v in files.items()])).alias("f")
    return j.select(F.col("key").cast("string").alias("folder"), each).select("folder", "f.*")
