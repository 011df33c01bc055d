"""Manifests and bundles: what a property's files hold, which rules they break, and the gates they reach.

Documents are JSON text; files are rows (key, path, content, is_dir) as a listing of the manifest's folder gives them. A
missing file blocks its gates; nothing here raises for a bad document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from planimeter.functions.expr import PHYSICAL, REFERENCE, eligible_source, gate_status, source_reason
from planimeter.operators import assess, evaluate, layout, rooms, scoring

# Fields a manifest, a bundle and its tiers need; gates that a kind of measurement feeds; all gates.
MANIFEST_FIELDS = ("property_id", "room_ids", "lidar_capture", "video_capture", "photo_folder", "repeat_capture", "ground_truth")
BUNDLE_FIELDS, TIERS = ("property_id", "rooms", "tiers", "repeat", "ground_truth", "incumbent"), ("lidar", "video", "photo")
ROW_GATES = {
    "ceiling_height": ("ceiling",), "wall_length": ("photo_walls", "photo_footprint", "video_walls"), "floor_area": ("photo_footprint", "stitch"), "opening_width": ("openings",),
}
GATES = ("openings", "ceiling", "repeatability", "photo_walls", "photo_footprint", "stitch", "video_walls", "damage", "incumbent")
ESTIMATED = ("estimated", "synthetic", "chest_height_prior")

_LINK = "array<struct<a:string,b:string,room_a:string,room_b:string>>"
_ROW = "struct<measurement_type:string,capture_id:string,room_id:string,wall_id:string,opening_id:string,measurement_id:string,name:string,value_m:double,width_m:double,predicted_m:double,repeat_spread_m:double,source:string>"
_OPENING = "struct<opening_id:string,id:string,wall_id:string,room_id:string,width_m:double,value_m:double,predicted_width_m:double>"
_STITCH = f"rooms:array<string>,adjacencies:{_LINK}"
TRUTH = (
    f"struct<property_id:string,capture_id:string,source:string,calibration:struct<scale:string,method:string>,measurements:array<{_ROW}>,openings:array<{_OPENING}>,predicted_openings:array<{_OPENING}>,"
    f"{_STITCH},footprint_m2:double,overlap_m2_max:double,evaluator_only:boolean,synthetic_fixture:boolean,predicted_stitch:struct<{_STITCH},overlap_m2:double,footprint_m2:double>>"
)
_REGION = "struct<surface_id:string,class:string,extent_m2:string>"
DAMAGE = f"struct<label:string,source:string,synthetic_fixture:boolean,regions:array<{_REGION}>,predicted:array<{_REGION}>>"
REPEAT = "struct<walls:array<struct<wall_id:string,room_id:string,matched:boolean,length_a_m:double,length_b_m:double>>>"
VIDEO = "struct<status:string,degraded_reasons:array<string>,notes:array<string>,property:struct<rooms:array<string>>>"
_VWALL = "struct<wall_id:string,id:string,length_m:string,lengthInMeters:string,length:string,measure:string,unit:string,ground_truth_m:double,ours_m:double>"
_VROOM = f"struct<room_id:string,id:string,name:string,walls:array<{_VWALL}>>"
VENDOR = (
    "struct<vendor:string,export:string,source:string,app:string,version:string,property_id:string,dimensions:array<struct<dimension:string,room_id:string,wall_id:string,incumbent_m:double,ours_m:double,ground_truth_m:double,incumbent_error_m:double,ours_error_m:double>>,"
    f"rooms:array<{_VROOM}>,floors:array<struct<rooms:array<{_VROOM}>>>>"
)
MANIFEST = (
    "struct<property_id:string,room_ids:string,lidar_capture:string,video_capture:string,photo_folder:string,repeat_capture:string,ground_truth:string,damage_ground_truth:string,incumbent_export:string,"
    "predictions:struct<openings:string,video:string>>"
)


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _keys(doc: Column) -> Column:
    return F.coalesce(F.json_object_keys(doc), _empty("string"))


def _full(*names: Column) -> Column:
    return F.coalesce(*[F.nullif(n, F.lit("")) for n in names])


def normalized_manifests(docs: DataFrame) -> DataFrame:
    """Blocks of manifests (key, manifest) in any of three dialects: key, property_id, rooms, block, path, block_property, tier.

    A block is an object with a path (or capture_b), or a path itself; its property is its own or the manifest's."""
    names = {
        "lidar": ("lidar", "lidar_capture", "tiers.lidar"), "video": ("video", "video_capture", "tiers.video"), "photos": ("photos", "photo_folder", "tiers.photo", "tiers.photos"),
        "repeat": ("repeat", "repeat_capture"), "ground_truth": ("ground_truth",), "damage": ("damage", "damage_ground_truth"), "incumbent": ("incumbent", "incumbent_export"),
    }
    at = lambda path: F.nullif(F.get_json_object("manifest", f"$.{path}"), F.lit(""))
    inside = lambda raw, name: F.nullif(F.get_json_object(raw, f"$.{name}"), F.lit(""))
    block = lambda raw: F.struct(F.when(raw.startswith("{"), F.coalesce(inside(raw, "path"), inside(raw, "capture_b"))).otherwise(raw).alias("path"), F.when(raw.startswith("{"), inside(raw, "property_id")).alias("own"), F.when(raw.startswith("{"), inside(raw, "tier")).alias("tier"))  # noqa: E731, E501
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("block"), block(F.coalesce(*map(at, paths))).alias("b")) for n, paths in names.items()])).alias("x")
    listed = F.coalesce(F.from_json(F.coalesce(at("rooms"), at("room_ids")), "array<string>"), _empty("string"))
    d = docs.select("key", at("property_id").alias("property_id"), listed.alias("rooms"), each)
    return d.select("key", "property_id", "rooms", "x.block", "x.b.path", F.coalesce("x.b.own", "property_id").alias("block_property"), "x.b.tier")


def portable(path: Column, cwd: Column) -> Column:
    """An absolute path as one relative to cwd, or its last part where it lies outside; other text as it is."""
    inside = path.startswith(F.concat(F.rtrim(cwd, F.lit("/")), F.lit("/")))
    return F.when(~path.startswith("/"), path).when(inside, F.substring(path, F.length(F.rtrim(cwd, F.lit("/"))) + 2, F.length(path))).otherwise(F.element_at(F.split(path, "/"), -1))


def measurement_problems(docs: DataFrame) -> DataFrame:
    """Why a document (key, doc) is no ground truth: key, problem. Estimates and unknown kinds are named, and rows without a
    value."""
    raw = docs.select("key", F.from_json("doc", "struct<source:string,measurements:array<string>>").alias("d"))
    source = F.lower(F.coalesce("d.source", F.lit("")))
    top = raw.where(source.isin(*ESTIMATED)).select("key", F.lit("estimated source is not ground truth").alias("problem"))
    r = raw.select("key", source.alias("_s"), F.posexplode("d.measurements").alias("i", "row"))
    name = F.concat(F.lit("measurements["), F.col("i").cast("string"), F.lit("]"))
    field = lambda n: F.get_json_object("row", f"$.{n}")
    own = F.lower(F.coalesce(_full(field("source")), F.col("_s")))
    rules = [
        (~F.coalesce(field("measurement_type").isin(*scoring.KINDS), F.lit(False)), " has an unknown measurement_type"), (~F.array_contains(_keys(F.col("row")), "value_m"), " needs value_m"), (own.isin(*ESTIMATED), " source is estimated"),
    ]
    found = F.explode(F.array_compact(F.array(*[F.when(c, F.concat(name, F.lit(m))) for c, m in rules])))
    return top.unionByName(r.select("key", found.alias("problem")))


def contract_issues(docs: DataFrame) -> DataFrame:
    """Fields that ground-truth documents (key, doc) lack and sources that cannot pass, by the gate they block: key, gate,
    issue."""
    raw = docs.select("key", F.from_json("doc", "struct<property_id:string,capture_id:string,source:string,measurements:array<string>,openings:array<string>>").alias("d"))
    c = F.col
    source = F.lower(F.coalesce("d.source", F.lit("")))
    out = raw.where(source.isin(*ESTIMATED, "1.40m")).select("key", F.lit("ceiling").alias("gate"), F.lit("estimated source is not ground truth").alias("issue"))
    shared = [source.alias("_s"), _full(c("d.property_id")).alias("_p"), _full(c("d.capture_id")).alias("_c")]

    def checked(part: DataFrame, label: str, gates: Column, rules: list[tuple[Column, Column | None, Column]]) -> DataFrame:
        name = F.concat(F.lit(f"{label}["), c("i").cast("string"), F.lit("] "))
        found = F.explode(F.array_compact(F.array(*[F.when(cond, F.struct((gates if only is None else F.array(only)).alias("g"), F.concat(name, what).alias("issue"))) for cond, only, what in rules]))).alias("x")
        return part.select("key", found).select("key", F.explode("x.g").alias("gate"), "x.issue")

    lacks = lambda n: ~F.array_contains(_keys(c("row")), n)
    field = lambda n: F.get_json_object("row", f"$.{n}")
    own = F.lower(F.coalesce(_full(field("source")), c("_s")))
    reference = (own.isin(*REFERENCE), None, F.concat(F.lit("source "), own, F.lit(" is a reference, not a tape")))
    m = raw.select("key", *shared, F.posexplode("d.measurements").alias("i", "row"))
    kind, unit = field("measurement_type"), field("unit")
    gates = F.coalesce(*[F.when(kind == k, F.array(*map(F.lit, g))) for k, g in ROW_GATES.items()], F.array(F.lit("ceiling")))
    first = F.get(gates, F.lit(0))
    rules = [(lacks("property_id") & c("_p").isNull(), first, F.lit("missing property_id")), (lacks("capture_id") & c("_c").isNull(), first, F.lit("missing capture_id"))]
    rules += [(lacks(n), None, F.lit(f"missing {n}")) for n in ("room_id", "measurement_type", "value_m", "unit", "uncertainty_m")]
    rules += [
        (lacks("source") & (c("_s") == ""), None, F.lit("missing source")), ((kind == "wall_length") & lacks("wall_id"), None, F.lit("missing wall_id")), ((kind == "opening_width") & lacks("opening_id"), F.lit("openings"), F.lit("missing opening_id")),
        (unit.isNotNull() & (kind == "floor_area") & (unit != "m2"), F.lit("photo_footprint"), F.lit("floor area unit must be m2")),
        (unit.isNotNull() & ~F.coalesce(kind == "floor_area", F.lit(False)) & (unit != "m"), None, F.lit("unit must be m")), reference,
    ]
    out = out.unionByName(checked(m, "measurements", gates, rules))
    o = raw.select("key", *shared, F.posexplode("d.openings").alias("i", "row"))
    rules = [(lacks(n), None, F.lit(f"missing {n}")) for n in ("opening_id", "room_id", "wall_id", "width_m", "unit", "uncertainty_m")]
    rules += [(lacks("source") & (c("_s") == ""), None, F.lit("missing source")), (lacks("capture_id") & c("_c").isNull(), None, F.lit("missing capture_id")), (lacks("property_id") & c("_p").isNull(), None, F.lit("missing property_id")), reference]
    return out.unionByName(checked(o, "openings", F.array(F.lit("openings")), rules))


def ground_truth_rows(docs: DataFrame) -> DataFrame:
    """Measurements of documents (key, doc) under one set of names, openings among them: key, ord, property_id, capture_id,
    room_id, measurement_id, measurement_type, name, value_m, unit, uncertainty_m, source, predicted_m, repeat_spread_m,
    wall_id, opening_id, guessed. Centimetres become metres; kinds have short names; what a row lacks its document gives."""
    c = F.col
    row = (
        "struct<property_id:string,capture_id:string,room_id:string,measurement_id:string,measurement_type:string,kind:string,name:string,value_m:double,value:double,unit:string,uncertainty_m:double,uncertainty:double,"
        "source:string,predicted_m:double,repeat_spread_m:double,wall_id:string,opening_id:string,width_m:double,guessed:boolean>"
    )
    d = docs.select("key", F.from_json("doc", f"struct<property_id:string,capture_id:string,source:string,unit:string,measurements:array<{row}>,openings:array<{row}>>").alias("d"))
    as_opening = lambda o: o.withField("kind", F.coalesce(o["kind"], F.lit("opening"))).withField("value", F.coalesce(o["value"], o["width_m"]))
    every = F.concat(F.coalesce("d.measurements", _empty(row)), F.transform(F.coalesce("d.openings", _empty(row)), as_opening))
    r = d.select("key", "d", F.posexplode(every).alias("ord", "r"))
    kinds = {"wall": "wall_length", "opening": "opening_width", "ceiling": "ceiling_height", "area": "floor_area"}
    unit = _full(c("r.unit"), c("d.unit"))
    cm = lambda v, on: F.when(on, v / 100.0).otherwise(v)
    kind = F.coalesce(_full(c("r.measurement_type")), *[F.when(c("r.kind") == k, v) for k, v in kinds.items()])
    return r.select(
        "key", "ord", _full(c("r.property_id"), c("d.property_id")).alias("property_id"), _full(c("r.capture_id"), c("d.capture_id")).alias("capture_id"), c("r.room_id").alias("room_id"),
        _full(c("r.measurement_id"), c("r.opening_id"), c("r.wall_id")).alias("measurement_id"), kind.alias("measurement_type"), _full(c("r.name"), c("r.wall_id"), c("r.opening_id")).alias("name"),
        layout.metres(c("r.value_m"), c("r.value"), unit).alias("value_m"), F.when(unit == "cm", "m").otherwise(unit).alias("unit"),
        F.coalesce(c("r.uncertainty_m"), cm(c("r.uncertainty"), F.coalesce(c("r.unit") == "cm", F.lit(False)))).alias("uncertainty_m"), F.lower(F.coalesce(_full(c("r.source"), c("d.source")), F.lit(""))).alias("source"),
        c("r.predicted_m").alias("predicted_m"), c("r.repeat_spread_m").alias("repeat_spread_m"), c("r.wall_id").alias("wall_id"), c("r.opening_id").alias("opening_id"), F.coalesce("r.guessed", F.lit(False)).alias("guessed"),
    )


def incumbent_rows(docs: DataFrame) -> DataFrame:
    """Walls of vendor exports (key, doc), one row each: key, dimension, room_id, wall_id, incumbent_m, ours_m, ground_truth_m,
    incumbent_error_m, ours_error_m, vendor. A document that lists dimensions is taken as it is; else a wall counts if the
    first of its four lengths that is there is a number."""
    c = F.col
    d = docs.select("key", F.from_json("doc", VENDOR).alias("d"))
    vendor = F.coalesce(_full(c("d.vendor"), c("d.export"), c("d.source")), F.lit("incumbent"))
    listed = F.size(F.coalesce("d.dimensions", F.array())) > 0
    given = d.where(listed).select("key", vendor.alias("vendor"), F.explode("d.dimensions").alias("x")).select("key", "x.*", "vendor")
    every = F.concat(F.coalesce("d.rooms", _empty(_VROOM)), F.flatten(F.transform(F.coalesce("d.floors", _empty(f"struct<rooms:array<{_VROOM}>>")), lambda f: F.coalesce(f["rooms"], _empty(_VROOM)))))
    w = d.where(~listed).select("key", vendor.alias("vendor"), F.explode(every).alias("r")).select("key", "vendor", _full(c("r.room_id"), c("r.id"), c("r.name")).alias("room_id"), F.explode("r.walls").alias("w"))
    length = F.coalesce("w.length_m", "w.lengthInMeters", "w.length", "w.measure").try_cast("double")
    name = _full(c("w.wall_id"), c("w.id"))
    w = w.select("key", F.coalesce(name, "room_id").alias("dimension"), "room_id", name.alias("wall_id"), length.alias("incumbent_m"), c("w.ours_m").alias("ours_m"), c("w.ground_truth_m").alias("ground_truth_m"), "vendor").where("incumbent_m is not null")
    w = w.withColumns({"incumbent_error_m": F.abs(c("incumbent_m") - c("ground_truth_m")), "ours_error_m": F.abs(c("ours_m") - c("ground_truth_m"))})
    return given.unionByName(w)


def incumbent_scores(rows: DataFrame, keys: list[str], tie: float = 1e-6, share: float = 0.70) -> DataFrame:
    """won, tied, compared, beat_or_tie_rate and status of vendors' rows with both errors; none: BLOCKED."""
    ours, theirs = F.col("ours_error_m"), F.col("incumbent_error_m")
    both = ours.isNotNull() & theirs.isNotNull()
    tied = both & (F.abs(ours - theirs) <= tie)
    g = rows.groupBy(*keys).agg(F.count_if(both).alias("compared"), F.count_if(tied).alias("tied"), F.count_if(both & ~tied & (F.abs(ours) < F.abs(theirs))).alias("won"))
    rate = F.try_divide(F.col("won") + F.col("tied"), F.col("compared"))
    return g.withColumns({"beat_or_tie_rate": F.round(rate, 4), "status": gate_status(F.lit(True), rate >= share)})


def calibrated(scale: Column) -> Column:
    """Whether photos are scaled by something measured."""
    return F.coalesce(scale.isin(*PHYSICAL, "measured"), F.lit(False))


def missing_fields(manifests: DataFrame) -> DataFrame:
    """Fields that manifests (key, manifest) lack or leave empty: key, missing (in order)."""
    at = lambda n: F.get_json_object("manifest", f"$.{n}")
    lost = [F.when(F.coalesce(at(n).isin("", "[]", "{}", "0", "false"), F.lit(True)), F.lit(n)) for n in MANIFEST_FIELDS]
    return manifests.select("key", F.array_compact(F.array(*lost, F.when(~at("room_ids").startswith("["), "room_ids_not_a_list"))).alias("missing"))


def run_manifests(manifests: DataFrame, files: DataFrame) -> DataFrame:
    """The nine gates of each manifest (key, manifest) from the files it names: key, gate, status, reason.

    files: key, path (as the manifest writes it), content (text, null for folders), is_dir. Without ground truth all gates
    are BLOCKED; a gate whose file or rows are missing is."""
    c, key = F.col, ["key"]
    m = manifests.select("key", F.from_json("manifest", MANIFEST).alias("m"))
    paths = {
        "truth": "m.ground_truth", "repeat": "m.repeat_capture", "damage": "m.damage_ground_truth", "incumbent": "m.incumbent_export", "plan": "m.predictions.video", "found": "m.predictions.openings", "photos": "m.photo_folder",
    }
    j = m.select("key", _full(c("m.video_capture")).isNotNull().alias("has_video"), *[_full(c(p)).alias(f"_{n}") for n, p in paths.items()])
    for n in paths:
        side = files.select("key", c("path").alias(f"_{n}"), (c("is_dir") if n == "photos" else F.when(~c("is_dir"), c("content"))).alias(n))
        j = j.join(side, ["key", f"_{n}"], "left")
    kinds = {"truth": TRUTH, "repeat": REPEAT, "damage": DAMAGE, "plan": VIDEO, "found": f"struct<openings:array<{_OPENING}>>"}
    d = j.select("key", "has_video", "incumbent", F.coalesce("photos", F.lit(False)).alias("photos"), F.array_contains(_keys(c("truth")), "rooms").alias("has_rooms"), *[F.when(c(n).isNotNull(), F.from_json(n, k)).alias(n) for n, k in kinds.items()])
    d = d.withColumn("source", c("truth.source"))
    known = d.where("truth is not null")
    blocked = lambda t, reason: t.select("key", F.lit("BLOCKED").alias("status"), (F.lit(reason) if isinstance(reason, str) else reason).alias("reason"))
    out = []

    def gate(name: str, scored: DataFrame, parts: list[DataFrame]) -> None:
        rows = scored.select("key", "status", "reason")
        for p in parts:
            rows = rows.unionByName(p.select("key", "status", "reason"))
        out.append(rows.select("key", F.lit(name).alias("gate"), "status", "reason"))

    reason = lambda said: F.when(~eligible_source(c("source")), source_reason(c("source"))).otherwise(said)
    rows = known.select("key", "source", F.posexplode("truth.measurements").alias("ord", "r"))
    of = lambda kind: rows.where(c("r.measurement_type") == kind)
    wide = lambda t, doc: t.select("key", F.posexplode(doc).alias("ord", "o")).select("key", "ord", _full(c("o.opening_id"), c("o.id")).alias("id"), c("o.wall_id").alias("wall"), c("o.room_id").alias("room"), F.coalesce("o.width_m", "o.value_m", "o.predicted_width_m").alias("width"))  # noqa: E731, E501
    truth = wide(known, "truth.openings").unionByName(of("opening_width").select("key", (c("ord") + 1_000_000).alias("ord"), c("r.opening_id").alias("id"), c("r.wall_id").alias("wall"), c("r.room_id").alias("room"), F.coalesce("r.width_m", "r.value_m").alias("width")))
    named = F.when(F.size(F.coalesce("found.openings", F.array())) > 0, c("found.openings")).otherwise(c("truth.predicted_openings"))
    found = wide(known.withColumn("_named", named), "_named").join(truth.select("key").distinct(), key, "left_semi")
    scored = evaluate.openings_gate(evaluate.score_openings(truth, found, key), known.select("key", "source").join(truth.select("key").distinct(), key, "left_semi"), key)
    gate("openings", scored, [blocked(known.join(truth.select("key").distinct(), key, "left_anti"), "ground truth has no opening widths")])

    high = of("ceiling_height").select("key", "source", c("r.value_m").alias("truth"), c("r.predicted_m").alias("predicted"), c("r.repeat_spread_m").alias("spread"))
    scored = scoring.ceiling_gate(high, key).join(known.select("key", "source"), key)
    said = F.when(c("classification") == "blocked", "ceiling values missing").otherwise(reason(c("classification")))
    gate("ceiling", scored.withColumn("reason", said), [blocked(known.join(high.select("key").distinct(), key, "left_anti"), "ground truth has no ceiling_height")])

    walls = known.where("repeat is not null").select("key", "source", F.explode("repeat.walls").alias("w"))
    pairs = walls.select("key", "source", F.when(F.coalesce("w.matched", F.lit(True)), c("w.length_a_m")).alias("predicted"), F.when(F.coalesce("w.matched", F.lit(True)), c("w.length_b_m")).alias("truth"))
    scored = scoring.all_pass_gate(scoring.repeat_rows(pairs), key, c("pass"), eligible_source(c("source"))).join(known.select("key", "source"), key)
    done = F.concat((c("n") - c("n_fail")).cast("string"), F.lit("/"), c("n").cast("string"), F.lit(" walls within 1 cm or 0.5%"))
    rest = known.join(pairs.select("key").distinct(), key, "left_anti")
    gate("repeatability", scored.withColumn("reason", reason(done)), [blocked(rest, F.when(c("repeat").isNull(), "repeat capture is missing").otherwise("no walls to compare"))])

    photo = known.where("photos")
    lengths = of("wall_length").select("key", c("r.value_m").alias("truth"), c("r.predicted_m").alias("predicted"))
    area = of("floor_area").groupBy("key").agg(F.min_by(F.struct(c("r.value_m").alias("truth"), c("r.predicted_m").alias("predicted")), "ord").alias("a"))
    scale = F.coalesce(_full(c("truth.calibration.scale"), c("truth.calibration.method")), F.lit(""))
    prints = photo.select("key", "source", scale.alias("scale"), calibrated(scale).alias("calibrated")).join(area, key, "left").select("key", "source", "scale", "calibrated", "a.truth", "a.predicted")
    scored = assess.photo_gate(lengths.join(photo.select("key"), key, "left_semi"), prints, key).join(prints.select("key", "source", "scale", "calibrated"), key)
    said = (
        F.when((c("n_walls") == 0) | c("footprint_ok").isNull(), "photo ground truth is incomplete").when((c("scale") == "") & ~c("calibrated"), "no calibration metadata")
        .when(~c("calibrated"), "calibration source is not laser, tape, or survey").otherwise(reason(F.when(c("n_walls") == c("n_within"), "walls ok").otherwise("walls outside ±8%")))
    )
    for name in ("photo_walls", "photo_footprint"):
        gate(name, scored.withColumn("reason", said), [blocked(known.where("not photos"), "photo folder is missing")])

    links = lambda doc: F.transform(F.coalesce(f"{doc}.adjacencies", _empty("struct<a:string,b:string,room_a:string,room_b:string>")), lambda x: F.struct(_full(x["room_a"], x["a"]).alias("room_a"), _full(x["room_b"], x["b"]).alias("room_b")))  # noqa: E731, E501
    shaped = photo.where("has_rooms")
    each = lambda doc: shaped.select(c("key").alias("capture_id"), F.explode(links(doc)).alias("l")).select("capture_id", "l.*")
    off = rooms.link_difference(each("truth.predicted_stitch"), each("truth")).withColumnRenamed("capture_id", "key")
    n = lambda doc: F.size(F.coalesce(f"{doc}.rooms", F.array()))
    plans = shaped.select(
        "key", "source", n("truth.predicted_stitch").alias("n_rooms"), n("truth").alias("n_rooms_truth"), c("truth.predicted_stitch.overlap_m2").alias("overlap"), c("truth.overlap_m2_max").alias("overlap_max"),
        c("truth.predicted_stitch.footprint_m2").alias("footprint"), F.nullif("truth.footprint_m2", F.lit(0.0)).alias("footprint_truth"), (F.coalesce("truth.evaluator_only", F.lit(False)) | F.coalesce("truth.synthetic_fixture", F.lit(False))).alias("synthetic"),
    )
    scored = layout.stitch_gate(plans, off, key).join(plans.select("key", "source", "synthetic"), key)
    said = F.when(c("footprint_error_percent").isNull(), "footprint ground truth is missing").when(c("synthetic"), "synthetic fixture is not a physical property").otherwise(reason(F.lit("stitch comparison")))
    gate("stitch", scored.withColumn("reason", said), [blocked(known.where("not photos"), "photo folder is missing"), blocked(photo.where("not has_rooms"), "no room polygons in ground truth")])

    seen = known.where("plan is not null").select("key", "source", c("plan.status").alias("state"), n("plan.property").alias("n_rooms"), c("plan.degraded_reasons").alias("reasons"))
    scored = assess.video_gate(seen, lengths, key).join(seen, key)
    open_ = F.array_contains(F.coalesce("reasons", _empty("string")), "no_room_closure") | (c("n_rooms") == 0)
    said = F.when(c("status") == "DEGRADED", F.when(open_, "no_room_closure").otherwise("video plan is degraded")).when(c("n_walls") == 0, "video plan closed but no wall ground truth was supplied").otherwise(reason(F.lit("video walls against ±3%")))
    gate("video_walls", scored.withColumn("reason", said), [blocked(known.where("plan is null"), F.when(c("has_video"), "video plan is missing").otherwise("video capture is missing"))])

    hurt = known.where("damage is not null")
    region = lambda doc: hurt.select("key", F.posexplode(f"damage.{doc}").alias("id", "r")).select("key", "id", "r.surface_id", "r.class", evaluate.value_of(c("r.extent_m2")).alias("value"))
    matched = scoring.rank_match(region("predicted"), region("regions"), ["key", "surface_id", "class"], ["id"], null_safe=("surface_id", "class"))
    claims = hurt.select("key", F.coalesce("damage.source", "source").alias("source"), (_full(c("damage.label")).isNotNull() | F.coalesce("damage.synthetic_fixture", F.lit(False)) | ~eligible_source(c("damage.source"))).alias("synthetic"))
    scored = assess.damage_gate(matched.join(claims, key), key)
    scored = claims.join(scored, key, "left").withColumn("status", F.coalesce("status", F.lit("BLOCKED")))
    said = F.when(F.coalesce("n_truth", F.lit(0)) == 0, "no damage ground truth").when(c("synthetic"), "synthetic damage fixture is regression coverage, not a furnished room").otherwise(reason(F.lit("damage regions")))
    gate("damage", scored.withColumn("reason", said), [blocked(known.where("damage is null"), "damage ground truth is missing")])

    sold = incumbent_rows(known.where("incumbent is not null").select("key", c("incumbent").alias("doc")))
    scored = incumbent_scores(sold, key)
    done = F.concat((c("won") + c("tied")).cast("string"), F.lit("/"), c("compared").cast("string"), F.lit(" beat or tie; threshold 70%"))
    lost = known.join(sold.select("key").distinct(), key, "left_anti")
    gate("incumbent", scored.withColumn("reason", F.when(c("compared") == 0, "incumbent rows have no paired errors").otherwise(done)), [blocked(lost, "no Polycam or Magicplan export")])

    every = blocked(d.where("truth is null"), "ground truth file is missing").withColumn("gate", F.explode(F.array(*map(F.lit, GATES))))
    rows = every.select("key", "gate", "status", "reason")
    for part in out:
        rows = rows.unionByName(part)
    return rows


def compared_by_kind(rows: DataFrame, predicted: DataFrame, sources: DataFrame) -> DataFrame:
    """Gates of ground_truth_rows() and predicted openings (key, ord, id, wall, room, width): key, gate (openings, ceiling,
    photo), status. sources: key, source. A key without truth of a kind has that gate BLOCKED."""
    c, key = F.col, ["key"]
    own = rows.drop("source").join(sources, key)
    truth = own.where("measurement_type = 'opening_width'").select("key", "ord", F.coalesce("opening_id", "measurement_id").alias("id"), F.coalesce("wall_id", "name").alias("wall"), c("room_id").alias("room"), c("value_m").alias("width"))
    some = truth.select("key").distinct()
    scored = evaluate.openings_gate(evaluate.score_openings(truth, predicted.join(some, key, "left_semi"), key), sources.join(some, key, "left_semi"), key)
    high = scoring.ceiling_gate(own.where("measurement_type = 'ceiling_height'").select("key", "source", c("value_m").alias("truth"), c("predicted_m").alias("predicted"), c("repeat_spread_m").alias("spread")), key)
    area = own.where("measurement_type = 'floor_area'").groupBy("key").agg(F.min_by(F.struct(c("value_m").alias("truth"), c("predicted_m").alias("predicted")), "ord").alias("a"))
    prints = sources.join(area, key, "left").select("key", "source", "a.truth", "a.predicted", eligible_source(c("source")).alias("calibrated"))
    photo = assess.photo_gate(own.where("measurement_type = 'wall_length'").select("key", c("value_m").alias("truth"), c("predicted_m").alias("predicted")), prints, key)
    every = sources.select("key", F.explode(F.array(F.lit("openings"), F.lit("ceiling"), F.lit("photo"))).alias("gate"))
    got = scored.select("key", F.lit("openings").alias("gate"), "status").unionByName(high.select("key", F.lit("ceiling").alias("gate"), "status")).unionByName(photo.select("key", F.lit("photo").alias("gate"), "status"))
    return every.join(got, ["key", "gate"], "left").withColumn("status", F.coalesce("status", F.lit("BLOCKED")))


def bundle_checks(bundles: DataFrame, listing: DataFrame) -> DataFrame:
    """The checks of bundles (key, manifest) in their order: key, priority, name, ok, exit_code, missing.

    listing: key, path (relative to the manifest's folder) of every file under it. name is the reason where a check is not
    ok: malformed_manifest and mixed_property end with code 2, missing captures, truth or exports with 0."""
    c = F.col
    keys = _keys(c("manifest"))
    part = lambda p: F.get_json_object("manifest", f"$.{p}")
    tiers = _keys(part("tiers"))
    lost = F.array_except(F.array(*map(F.lit, BUNDLE_FIELDS)), keys)
    lost_tiers = F.array_except(F.array(*map(F.lit, TIERS)), tiers)
    listed = F.from_json(part("rooms"), "array<string>")
    bad = (F.size(lost) > 0) | F.coalesce(F.size(listed) <= 0, F.lit(True)) | ~F.coalesce(part("tiers").startswith("{"), F.lit(False)) | (F.size(lost_tiers) > 0)
    own = part("property_id")
    other = lambda p: F.coalesce(F.nullif(part(f"{p}.property_id"), F.lit("")) != own, F.lit(False))
    mixed = other("ground_truth")
    for p in ("incumbent", "repeat", "damage", *[f"tiers.{t}" for t in TIERS]):
        mixed = mixed | other(p)
    strangers = F.size(F.array_except(F.coalesce(F.from_json(part("connector.rooms"), "array<string>"), _empty("string")), F.coalesce(listed, _empty("string")))) > 0
    b = bundles.select("key", "manifest", bad.alias("_bad"), (mixed | (strangers & (F.size(listed) > 0))).alias("_mixed"), *[part(f"tiers.{t}.path").alias(f"_{t}") for t in TIERS], part("ground_truth.path").alias("_truth"), part("repeat.capture_a").alias("_a"), part("repeat.capture_b").alias("_b"), part("incumbent.path").alias("_sold"))
    p = c("path")
    low = F.lower(p)
    under = lambda root: p.startswith(F.concat(F.rtrim(c(root), F.lit("/")), F.lit("/")))
    name = F.element_at(F.split(p, "/"), -1)
    has = lambda cond, n: F.coalesce(F.bool_or(cond), F.lit(False)).alias(n)
    g = b.select("key", *[f"_{t}" for t in TIERS], "_truth", "_a", "_b", "_sold").join(listing, "key", "left").groupBy("key").agg(
        has(under("_lidar") & (name == "odometry.csv"), "lo"), has(under("_lidar") & p.endswith(".png"), "lp"), has(under("_video") & p.endswith(".mp4"), "vm"), has(under("_video") & (name == "odometry.csv"), "vo"),
        F.count_if(under("_photo") & low.rlike(r"\.(jpg|jpeg|png)$")).alias("pi"), has(p == c("_truth"), "t"), has(under("_a") & (name != ".gitkeep"), "a"), has(under("_b") & (name != ".gitkeep"), "b"), has(p == c("_sold"), "s"),
    )
    j = b.join(g, "key")
    absent = F.array_compact(F.array(F.when(~(c("lo") & c("lp")), "lidar"), F.when(~(c("vm") & c("vo")), "video"), F.when(c("pi") < 2, "photo")))
    repeats = F.array_compact(F.array(F.when(~c("a"), "capture_a"), F.when(~c("b"), "capture_b")))
    none = _empty("string")
    checks = [
        ("malformed_manifest", ~c("_bad"), 2, none), ("mixed_property", ~F.coalesce("_mixed", F.lit(False)), 2, none), ("missing_tier_capture", F.size(absent) == 0, 0, absent),
        ("missing_ground_truth", c("t"), 0, F.array(F.lit("ground_truth"))), ("missing_repeat_capture", F.size(repeats) == 0, 0, repeats), ("missing_incumbent_export", c("s"), 0, F.array(F.lit("incumbent"))),
    ]
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("priority"), F.lit(n).alias("name"), ok.alias("ok"), F.lit(code).alias("exit_code"), F.when(ok, none).otherwise(miss).alias("missing")) for i, (n, ok, code, miss) in enumerate(checks)])).alias("x")
    return j.select("key", each).select("key", "x.*")


def bundle_results(checks: DataFrame) -> DataFrame:
    """One result a bundle: key, status (ok or BLOCKED), reason, missing, exit_code, by its first check that is not ok."""
    bad = F.when(~F.coalesce("ok", F.lit(False)), F.struct("priority", "name", "missing", "exit_code"))
    g = checks.groupBy("key").agg(F.min_by(F.struct("name", "missing", "exit_code"), F.when(~F.coalesce("ok", F.lit(False)), F.col("priority"))).alias("b"), F.count(bad).alias("n"))
    held = lambda n: F.when(F.col("n") > 0, F.col(f"b.{n}"))
    return g.select("key", F.when(F.col("n") > 0, "BLOCKED").otherwise("ok").alias("status"), held("name").alias("reason"), F.coalesce(held("missing"), _empty("string")).alias("missing"), F.coalesce(held("exit_code"), F.lit(0)).alias("exit_code"))


def lidar_folder_problems(listing: DataFrame) -> DataFrame:
    """What lidar folders (capture_id, path relative to the folder) lack: capture_id, problem."""
    p = F.col("path")
    depth, conf = F.count_if(p.rlike(r"^depth/[^/]+\.png$")), F.count_if(p.rlike(r"^confidence/[^/]+\.png$"))
    g = listing.groupBy("capture_id").agg(depth.alias("d"), conf.alias("c"), F.max(p == "odometry.csv").alias("o"), F.max(p == "camera_matrix.csv").alias("k"))
    d, c = F.col("d"), F.col("c")
    uneven = F.concat(F.lit("depth has "), d.cast("string"), F.lit(" frames and confidence has "), c.cast("string"))
    found = [
        F.when(d == 0, "lidar capture needs depth/*.png"), F.when(c == 0, "lidar capture needs confidence/*.png"), F.when((d > 0) & (c > 0) & (d != c), uneven), F.when(~F.col("o"), "lidar capture needs odometry.csv"),
        F.when(~F.col("k"), "lidar capture needs camera_matrix.csv"),
    ]
    return g.select("capture_id", F.explode(F.array_compact(F.array(*found))).alias("problem"))


def video_folder_problems(listing: DataFrame, poses: DataFrame) -> DataFrame:
    """What video folders (capture_id, path) lack, or whose poses (capture_id, pose_index, ts) go back in time: capture_id,
    problem. Equal times are in order."""
    p = F.col("path")
    g = listing.groupBy("capture_id").agg(F.max(p.rlike(r"^[^/]+\.mp4$")).alias("v"))
    back = assess.time_steps(poses.select("capture_id", F.col("pose_index").alias("ord"), "ts"), ["capture_id"]).select("capture_id", "n_back")
    j = g.join(back, "capture_id", "left")
    late = F.when(F.col("v") & (F.coalesce("n_back", F.lit(0)) > 0), "video odometry timestamps are not in frame order")
    return j.select("capture_id", F.explode(F.array_compact(F.array(F.when(~F.col("v"), "video capture needs an mp4 walkthrough"), late))).alias("problem"))
