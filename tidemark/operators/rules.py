"""A table of rules compiled to columns: the first rule that a row breaks, all rules that it breaks, and its score."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """The fields are compared by op (flag, gt, lt, abs_gt or max_gt) with the limit of this name."""

    reason: str
    op: str
    fields: tuple[str, ...]
    limit: str


UNDETECTED, MANUAL, ACCEPTED = "no_face_detected", "manual", "accepted"

#: Fixed values, in order: the first rule that holds names the reason.
RULES = (
    Rule("bbox_clipped", "flag", ("bbox_clipped",), "allow_bbox_clipped"),
    Rule("partially_out_of_frame", "gt", ("oob_frac",), "max_oob_frac"),
    Rule("head_turned", "abs_gt", ("yaw",), "max_yaw"),
    Rule("head_tilted", "abs_gt", ("pitch",), "max_pitch"),
    Rule("head_rolled", "abs_gt", ("roll",), "max_roll"),
    Rule("looking_away", "abs_gt", ("gaze_x",), "max_gaze"),
    Rule("looking_away", "abs_gt", ("gaze_y",), "max_gaze"),
    Rule("eyes_closed", "max_gt", ("blink_l", "blink_r"), "max_blink"),
    Rule("face_too_small", "lt", ("interocular_px",), "min_interocular_px"),
    Rule("blurry", "lt", ("sharpness",), "min_sharpness"),
    Rule("overexposed", "gt", ("exposure_hi",), "max_exposure_hi"),
    Rule("underexposed", "lt", ("exposure_lo",), "min_exposure_lo"),
)

#: Default limits and weights.
LIMITS = {"max_yaw": 20.0, "max_pitch": 18.0, "max_roll": 25.0, "max_gaze": 0.35, "max_blink": 0.45, "max_oob_frac": 0.005, "allow_bbox_clipped": False, "min_interocular_px": 60.0, "min_sharpness": 12.0, "min_exposure_lo": 8.0, "max_exposure_hi": 250.0}
WEIGHTS = {"w_pose": 1.0, "w_gaze": 1.0, "w_eyes_open": 1.0, "w_sharpness": 1.0, "w_size": 0.5}


def measure(name: str) -> Column:
    """A measurement with NaN taken as missing."""
    x = F.col(name).cast("double")
    return F.nanvl(x, F.lit(None).cast("double"))


def violates(rule: Rule, limits: dict) -> Column:
    """True where the rule is broken. Comparisons are strict; a missing value or limit breaks nothing, but a flag without a limit isn't allowed."""
    limit = limits.get(rule.limit)
    if rule.op == "flag":
        return F.lit(False) if limit else F.coalesce(F.col(rule.fields[0]).cast("boolean"), F.lit(False))
    tests = {
        "gt": lambda x: x > limit,
        "lt": lambda x: x < limit,
        "abs_gt": lambda x: F.abs(x) > limit,
        "max_gt": lambda x: x > limit,
    }
    if rule.op not in tests:
        raise ValueError(f"unknown rule operator {rule.op!r}")
    if limit is None:
        return F.lit(False)
    values = [measure(f) for f in rule.fields]
    return F.coalesce(tests[rule.op](F.greatest(*values) if len(values) > 1 else values[0]), F.lit(False))


def reject_reason(limits: dict, rules: tuple[Rule, ...] = RULES) -> Column:
    """The first broken rule's reason, null for rows that pass."""
    undetected = ~F.coalesce(F.col("detected").cast("boolean"), F.lit(False))
    # a position in an array of tests, as the optimizer is slow to see through long CASE chains under filters
    first = F.array_position(F.array(undetected, *(violates(r, limits) for r in rules)), True)
    return F.get(F.array(*(F.lit(n) for n in (UNDETECTED, *(r.reason for r in rules)))), first.cast("int") - 1)


def with_manual(reason: Column, manual: Column) -> Column:
    """Adds the manual reason where no rule rejects."""
    return F.when(reason.isNull() & manual, MANUAL).otherwise(reason)


def violations(df: DataFrame, limits: dict, id_col: str = "asset_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row (id, ord, reason) for each rule that a row breaks; ord is the rule's place, 0 for undetected."""
    undetected = ~F.coalesce(F.col("detected").cast("boolean"), F.lit(False))
    tests = [(undetected, UNDETECTED), *((violates(r, limits), r.reason) for r in rules)]
    found = F.array_compact(F.array(*(F.when(t, F.struct(F.lit(i).alias("ord"), F.lit(n).alias("reason"))) for i, (t, n) in enumerate(tests))))
    return df.select(id_col, F.explode(found).alias("v")).select(id_col, "v.ord", "v.reason")


def composite_score(limits: dict, weights: dict) -> Column:
    """Weighted mean of pose, gaze, open eyes, sharpness and size, each from 0 to 1; 0 if the weights add to nothing."""
    needed = {"max_yaw", "max_pitch", "max_roll", "max_gaze", "min_sharpness", "min_interocular_px"}
    if missing := needed - limits.keys():
        raise ValueError(f"limits lack {sorted(missing)}")
    zero, one = F.lit(0.0), F.lit(1.0)

    def closeness(name: str, key: str) -> Column:
        return F.coalesce(F.greatest(zero, one - F.abs(measure(name)) / max(limits[key], 1e-6)), zero)

    def fullness(name: str, goal: float) -> Column:
        return F.least(one, F.coalesce(measure(name), zero) / goal)

    parts = {
        "w_pose": (closeness("yaw", "max_yaw") + closeness("pitch", "max_pitch") + closeness("roll", "max_roll")) / 3,
        "w_gaze": (closeness("gaze_x", "max_gaze") + closeness("gaze_y", "max_gaze")) / 2,
        "w_eyes_open": one - F.least(one, F.coalesce(F.greatest(measure("blink_l"), measure("blink_r")), zero)),
        "w_sharpness": fullness("sharpness", 8 * max(limits["min_sharpness"], 1e-6)),
        "w_size": fullness("interocular_px", 4 * max(limits["min_interocular_px"], 1e-6)),
    }
    total = sum(weights.get(k, 0.0) for k in parts)
    if total <= 0:
        return zero
    return reduce(lambda a, b: a + b, (parts[k] * F.lit(float(weights.get(k, 0.0))) for k in parts)) / F.lit(float(total))


def apply_filters(df: DataFrame, limits: dict = LIMITS, weights: dict = WEIGHTS, manual: DataFrame | None = None, id_col: str = "asset_id", stamp: Column | None = None) -> DataFrame:
    """df with reject_reason and score; rejected rows have no score. manual: a table of ids rejected by hand.

    stamp becomes filtered_at, one for the whole pass.
    """
    reason = reject_reason(limits)
    if manual is not None:
        df = df.join(manual.select(id_col).distinct().withColumn("_manual", F.lit(True)), id_col, "left")
        reason = with_manual(reason, F.coalesce("_manual", F.lit(False)))
    out = df.withColumn("reject_reason", reason).withColumn("score", F.when(F.col("reject_reason").isNull(), composite_score(limits, weights)))
    return (out if stamp is None else out.withColumn("filtered_at", stamp)).drop("_manual")


ERROR = "error:"


def with_errors(df: DataFrame, error_col: str) -> DataFrame:
    """df whose rows with an error (its type as text) count as undetected and rejected by it instead of stopping the rest."""
    bad = F.col(error_col).isNotNull()
    return df.withColumn("detected", F.when(bad, 0).otherwise(F.col("detected"))).withColumn("reject_reason", F.when(bad, F.concat(F.lit(ERROR), error_col)).otherwise(F.col("reject_reason")))


def report_state(metrics: DataFrame) -> DataFrame:
    """One row (analyzed, evaluated, state): `nothing analyzed`, `not evaluated` if no row was ever filtered, else `evaluated`."""
    seen = metrics.agg(F.count("*").alias("analyzed"), F.count("filtered_at").alias("evaluated"))
    state = F.when(F.col("analyzed") == 0, "nothing analyzed").when(F.col("evaluated") == 0, "not evaluated").otherwise("evaluated")
    return seen.withColumn("state", state)


def reason_shares(df: DataFrame) -> DataFrame:
    """(reason, n, share): how many rows have each reason, accepted among them, and their share in percent."""
    counts = df.groupBy(F.coalesce("reject_reason", F.lit(ACCEPTED)).alias("reason")).agg(F.count("*").alias("n"))
    total = F.sum("n").over(Window.partitionBy())  # a row for each reason
    return counts.withColumn("share", F.round(100 * F.col("n") / total, 1))


def whatif(df: DataFrame, before: dict, after: dict, id_col: str = "asset_id") -> DataFrame:
    """(id, change) for rows that other limits would add or drop."""
    old, new = reject_reason(before).isNull(), reject_reason(after).isNull()
    return df.select(id_col, F.when(~old & new, "added").when(old & ~new, "dropped").alias("change")).where("change is not null")


def slider_range(df: DataFrame, field: str, current: float, op: str) -> DataFrame:
    """One row (low, high, step): the track that covers the observed values and the current limit."""
    x = F.abs(measure(field)) if op == "abs_gt" else measure(field)
    seen = df.agg(F.least(F.min(x), F.lit(current), F.lit(0.0)).alias("low"), F.greatest(F.max(x), F.lit(current)).alias("top"))
    seen = seen.withColumn("top", F.when(F.col("top") <= F.col("low"), F.col("low") + 1).otherwise(F.col("top")))
    step = F.pow(F.lit(10.0), F.floor(F.log10((F.col("top") - F.col("low")) / 100)))
    return seen.select(F.round("low", 6).alias("low"), F.round(F.col("top") + step, 6).alias("high"), F.round(F.greatest(step, F.lit(1e-4)), 6).alias("step"))
