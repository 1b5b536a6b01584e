"""Text, number and JSON functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def format_duration(seconds: Column) -> Column:
    """Milliseconds, seconds, minutes or hours; a tie goes to the even digit."""
    whole = F.floor(seconds)
    return (
        F.when(seconds < 1, F.format_string("%sms", F.bround(seconds * 1000, 0).cast("bigint")))
        .when(seconds < 60, F.format_string("%.1fs", F.bround(seconds, 1)))
        .when(seconds < 3600, F.format_string("%dm %02ds", F.floor(whole / 60), whole % 60))
        .otherwise(F.format_string("%dh %02dm", F.floor(whole / 3600), F.floor(whole % 3600 / 60)))
    )


def format_bytes(count: Column) -> Column:
    """Units of 1024 with one decimal; plain bytes below."""
    text = F.format_string("%d B", count.cast("bigint"))
    for unit, power in (("kB", 10), ("MB", 20), ("GB", 30)):
        text = F.when(count >= float(1 << power), F.format_string(f"%.1f {unit}", F.bround(count / float(1 << power), 1))).otherwise(text)
    return text


def normalize_path(path: Column) -> Column:
    """A path with every UUID put as {id}."""
    return F.regexp_replace(path, r"(?i)[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}", "{id}")


def retry_after(text: Column) -> Column:
    """Seconds of a Retry-After header, null unless a number of at least 0."""
    value = text.try_cast("double")
    return F.when(value >= 0, value)


def retry_delay(attempt: Column, base: float, cap: float, asked: Column | None = None) -> Column:
    """Doubling delays up to cap; what the server asked for wins."""
    own = F.least(F.lit(float(cap)), F.lit(float(base)) * F.pow(F.lit(2.0), attempt))
    return own if asked is None else F.coalesce(asked, own)


def message_from(body: Column) -> Column:
    """The first of message, error and detail in a JSON text that isn't empty."""
    return F.coalesce(*(F.nullif(F.get_json_object(body, f"$.{k}"), F.lit("")) for k in ("message", "error", "detail")))


def annotated_name(name: Column, mark: str) -> Column:
    """A file name with a mark before its last dot, or at its end."""
    return F.when(F.contains(name, F.lit(".")), F.regexp_replace(name, r"\.([^.]*)$", f"{mark}.$1")).otherwise(F.concat(name, F.lit(mark)))


def suffix(name: Column, default: str = ".jpg") -> Column:
    return F.coalesce(F.nullif(F.lower(F.regexp_extract(name, r"(\.[^./]+)$", 1)), F.lit("")), F.lit(default))


def fingerprint(items: Column, settings: Column) -> Column:
    """SHA-256 of ordered items and of settings (a map) whatever their order."""
    ordered = F.map_from_entries(F.array_sort(F.map_entries(settings)))
    return F.sha2(F.concat(F.to_json(items), F.lit("|"), F.to_json(ordered)), 256)


def asset_path(asset_id: Column, rendition: Column) -> tuple[Column, Column]:
    """Path and size of a rendition: the original has no size, any other is a thumbnail of that size."""
    original = F.coalesce(rendition == "original", F.lit(False))
    return F.concat(F.lit("/assets/"), asset_id, F.when(original, "/original").otherwise("/thumbnail")), F.when(~original, rendition)


def resolved_path(path: Column, home: str) -> Column:
    """The absolute form of a path, from home unless it begins with a slash: without a local scheme, empty parts, `.` and `..`."""
    plain = F.regexp_replace(path, "^file:/+", "/")
    whole = F.when(F.startswith(plain, F.lit("/")), plain).otherwise(F.concat(F.lit(f"{home.rstrip('/')}/"), plain))
    step = lambda parts, x: F.when(x.isin("", "."), parts).when(x == "..", F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))).otherwise(F.concat(parts, F.array(x)))
    return F.concat(F.lit("/"), F.array_join(F.aggregate(F.split(whole, "/"), F.array().cast("array<string>"), step), "/"))
