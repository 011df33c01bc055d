"""Matching predictions to truth, error rows and gates. A missing side is a state, never a number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from planimeter.functions.expr import PHYSICAL, REFERENCE, eligible_source, error_row, gate_status

# Kinds of measurements, and sources that only guess.
KINDS = ("wall_length", "opening_width", "ceiling_height", "floor_area")
GUESSED = ("estimated", "synthetic", "chest_height_prior", "guess", "guessed")


def rank_match(predicted: DataFrame, truth: DataFrame, keys: list[str], order: list[str], *, null_safe: tuple[str, ...] = (), value: str = "value") -> DataFrame:
    """Pairs the k-th of each side within keys, in the given order; what is left over has one side null.

    Keys in null_safe match null to null; a null in any other key never matches."""
    def ranked(t: DataFrame, side: str) -> DataFrame:
        w = Window.partitionBy(*keys).orderBy(*order)
        return t.withColumn("k", F.row_number().over(w)).select(*[F.col(c).alias(f"{side}_{c}") for c in keys], F.col("k").alias(f"{side}_k"), F.col("id").alias(f"{side}_id"), F.col(value).alias(side))

    p, t = ranked(predicted, "predicted"), ranked(truth, "truth")
    on = F.col("predicted_k") == F.col("truth_k")
    for c in keys:
        a, b = F.col(f"predicted_{c}"), F.col(f"truth_{c}")
        on = on & (a.eqNullSafe(b) if c in null_safe else a == b)
    out = t.join(p, on, "full_outer")
    return out.select(*[F.coalesce(f"truth_{c}", f"predicted_{c}").alias(c) for c in keys], "truth_id", "predicted_id", "truth", "predicted")


def error_rows(matched: DataFrame) -> DataFrame:
    e = error_row(F.col("predicted"), F.col("truth"))
    status = F.when(F.col("predicted").isNull(), "missed").when(F.col("truth").isNull(), "phantom").otherwise("matched")
    return matched.withColumns({"status": status, "abs_error": e["abs"], "rel_error": e["rel"]})


def summary(rows: DataFrame, keys: list[str], passed: Column) -> DataFrame:
    """n, n_pass, pass_rate over decided rows only, n_missed, n_phantom, worst."""
    r = rows.withColumn("_p", passed)
    return r.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("_p").alias("n_pass"),
        F.round(F.try_divide(F.count_if("_p"), F.count("_p")), 6).alias("pass_rate"),
        F.count_if(F.col("status") == "missed").alias("n_missed"), F.count_if(F.col("status") == "phantom").alias("n_phantom"),
        F.max("abs_error").alias("worst"),
    )


def opening_gate(rows: DataFrame, keys: list[str], limit: float = 0.02, share: float = 0.85) -> DataFrame:
    """Share of truth and phantoms within 2 cm is 0.85 or more; every truth's source must be physical."""
    within = F.coalesce(F.round(F.col("abs_error"), 6) <= limit, F.lit(False))
    g = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(within).alias("within"), F.bool_and(eligible_source(F.col("source")) | F.col("truth").isNull()).alias("eligible"),
        F.round(F.avg("abs_error"), 4).alias("mae"), F.round(F.percentile("abs_error", 0.5), 4).alias("median"), F.round(F.percentile("abs_error", 0.95), 4).alias("p95"), F.max("abs_error").alias("worst"),
        F.count("truth").alias("n_truth"),
    )
    passed = F.when(F.col("n_truth") > 0, F.col("within") / F.col("n") >= share)
    return g.withColumn("status", gate_status(F.col("eligible"), passed))


def ceiling_gate(rows: DataFrame, keys: list[str], limit: float = 0.015, spread_limit: float = 0.01) -> DataFrame:
    """classification and status of ceilings: biased over 1.5 cm, unrepeatable over 1 cm of spread, both on errors
    rounded to 6 places; with the mean, median and largest error and the largest spread.

    Rows without truth or prediction count for nothing; a group of such rows only is blocked. Where no counted row has a
    spread nothing can pass, but a bias still fails; where some have, these decide."""
    counted = F.col("predicted").isNotNull() & F.col("truth").isNotNull()
    error = F.when(counted, F.abs(F.col("predicted") - F.col("truth")))
    spread = F.when(counted, F.col("spread"))
    g = rows.groupBy(*keys).agg(
        F.count(error).alias("n"), F.bool_or(F.round(error, 6) > limit).alias("b"), F.bool_or(F.round(spread, 6) > spread_limit).alias("l"), F.count(spread).alias("s"),
        F.round(F.avg(error), 4).alias("mean_error_m"), F.round(F.percentile(error, 0.5), 4).alias("median_error_m"), F.round(F.max(error), 4).alias("max_error_m"),
        F.round(F.max(spread), 4).alias("max_repeat_spread_m"), F.bool_and(eligible_source(F.col("source"))).alias("eligible"),
    )
    b, l = (F.coalesce(F.col(c), F.lit(False)) for c in ("b", "l"))
    kind = (
        F.when(F.col("n") == 0, "blocked").when((F.col("s") == 0) & b, "biased_repeat_not_measured").when(F.col("s") == 0, "repeat_not_measured")
        .when(b & l, "both").when(b, "biased_but_repeatable").when(l, "unrepeatable").otherwise("passed")
    )
    passed = F.when(~kind.isin("blocked", "repeat_not_measured"), kind == "passed")
    numbers = ("mean_error_m", "median_error_m", "max_error_m", "max_repeat_spread_m")
    return g.select(*keys, kind.alias("classification"), gate_status(F.col("eligible"), passed).alias("status"), *numbers)


def repeat_rows(matched: DataFrame, abs_limit: float = 0.01, rel_limit: float = 0.005) -> DataFrame:
    """Two captures of one wall: within 1 cm or 0.5 % of the longer; an unmatched wall fails."""
    d = F.round(F.abs(F.col("predicted") - F.col("truth")), 6)
    rel = F.try_divide(F.abs(F.col("predicted") - F.col("truth")), F.greatest(F.abs("predicted"), F.abs("truth")))
    return matched.withColumns({"delta": d, "rel_delta": F.round(rel, 6), "pass": F.coalesce((d <= abs_limit) | (F.round(rel, 6) <= rel_limit), F.lit(False))})


def all_pass_gate(rows: DataFrame, keys: list[str], passed: Column, eligible: Column) -> DataFrame:
    g = rows.groupBy(*keys).agg(F.bool_and(F.coalesce(passed, F.lit(False))).alias("p"), F.bool_and(eligible).alias("e"), F.count(F.lit(1)).alias("n"), F.count_if(~F.coalesce(passed, F.lit(False))).alias("n_fail"))
    return g.select(*keys, "n", "n_fail", gate_status(F.col("e"), F.col("p")).alias("status"))


def incumbent_gate(rows: DataFrame, keys: list[str], tie: float = 1e-6, share: float = 0.70) -> DataFrame:
    """Won or tied in 70 % of the rows that both sides score: ours, theirs, truth."""
    scored = F.col("ours").isNotNull() & F.col("theirs").isNotNull() & F.col("truth").isNotNull()
    a, b = F.abs(F.col("ours") - F.col("truth")), F.abs(F.col("theirs") - F.col("truth"))
    g = rows.groupBy(*keys).agg(F.count_if(scored).alias("scored"), F.count_if(scored & (a < b - tie)).alias("won"), F.count_if(scored & (F.abs(a - b) <= tie)).alias("tied"))
    rate = F.try_divide(F.col("won") + F.col("tied"), F.col("scored"))
    return g.withColumns({"rate": F.round(rate, 6), "status": gate_status(F.lit(True), rate >= share)})


def violations(rows: DataFrame) -> DataFrame:
    """Rule breaches of ground-truth rows (id, measurement_type, property_id, capture_id, room_id, value_m, unit,
    uncertainty_m, source, guessed, bundle_property), one row a breach: id, rule. An empty or null source is none."""
    c = F.col
    source, blank = F.lower(F.coalesce(c("source"), F.lit(""))), lambda n: F.coalesce(c(n).cast("string"), F.lit("")) == ""
    guessed = source.isin(*GUESSED) | F.coalesce(c("guessed"), F.lit(False))
    rules = {
        "unknown_kind": ~F.coalesce(c("measurement_type").isin(*KINDS), F.lit(False)), "missing_value": c("value_m").isNull(),
        "bad_unit": ~F.coalesce(c("unit").isin("m", "m2"), F.lit(False)), "area_unit": (c("measurement_type") == "floor_area") & ~F.coalesce(c("unit") == "m2", F.lit(False)),
        "missing_uncertainty": c("uncertainty_m").isNull(), "guessed_source": guessed, "reference_source": source.isin(*REFERENCE),
        "not_physical": (source != "") & ~source.isin(*PHYSICAL, *REFERENCE),
        "missing_property_id": blank("property_id"), "missing_capture_id": blank("capture_id"), "missing_room_id": blank("room_id"),
        "other_property": ~blank("property_id") & ~blank("bundle_property") & (c("property_id") != c("bundle_property")),
    }
    return rows.select("id", F.explode(F.array_compact(F.array(*[F.when(cond, F.lit(n)) for n, cond in rules.items()]))).alias("rule"))


def exit_code(gates: DataFrame) -> DataFrame:
    """2 for a structural error, 1 for any FAIL, else 0 (blocked and degraded included)."""
    return gates.agg(F.coalesce(F.max(F.when(F.col("status") == "INVALID", 2).when(F.col("status") == "FAIL", 1).otherwise(0)), F.lit(0)).alias("exit_code"))
