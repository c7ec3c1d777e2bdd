"""Data-quality checks: every row gets the list of all rules it breaks, as codes."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The allowed states, stages, labels and severities.
JOB_STATES = ("queued", "running", "completed", "failed")
STAGES = (
    "queued", "validating_uploads", "rendering_documents", "normalizing_pages", "aligning_reference", "extracting_text", "comparing_structure",
    "localizing_differences", "scoring_evidence", "preparing_result", "complete", "failed",
)
LABELS = ("Low tampering risk", "Moderate tampering risk", "High tampering risk", "Critical tampering risk")
SEVERITIES = ("info", "low", "medium", "high", "critical")
BOX_TOLERANCE = 1.000001


def violations(*rules: tuple[str, Column]) -> Column:
    """The codes of the rules that are broken, in order; a rule that can't be decided because of a null is broken."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules]))


def box_rules(prefix: str = "") -> list[tuple[str, Column]]:
    x, y, w, h = (F.col(f"{prefix}{c}") for c in ("x", "y", "width", "height"))
    return [
        ("box_extent_not_positive", (w > 0) & (h > 0)),
        ("box_outside_page", (x + w <= BOX_TOLERANCE) & (y + h <= BOX_TOLERANCE)),
        ("box_not_unit", x.between(0, 1) & y.between(0, 1) & w.between(0, 1) & h.between(0, 1)),
    ]


def score_rule(name: str) -> tuple[str, Column]:
    return f"{name}_out_of_range", F.col(name).between(0, 100)


def unit_rule(name: str) -> tuple[str, Column]:
    return f"{name}_out_of_range", F.col(name).between(0, 1)


def progress_rule(name: str) -> tuple[str, Column]:
    return f"{name}_out_of_range", F.col(name).between(0, 100) & (F.col(name) == F.floor(name))


def sha256_rule(name: str) -> tuple[str, Column]:
    return f"{name}_not_sha256", F.col(name).rlike("^[0-9a-f]{64}$")


def enum_rule(name: str, allowed: tuple[str, ...]) -> tuple[str, Column]:
    return f"{name}_not_allowed", F.col(name).isin(*allowed)


def count_rules(page_number: str | None = None, counts: tuple[str, ...] = (), sizes: tuple[str, ...] = ()) -> list[tuple[str, Column]]:
    rules = [("page_number_below_one", F.col(page_number) >= 1)] if page_number else []
    return rules + [(f"{c}_negative", F.col(c) >= 0) for c in counts] + [(f"{c}_not_positive", F.col(c) > 0) for c in sizes]


def key_violations(payload: Column, required: tuple[str, ...], optional: tuple[str, ...] = ()) -> Column:
    """struct<missing, unknown> of a JSON object's top-level keys; all are missing where the payload is no object."""
    keys = F.coalesce(F.json_object_keys(payload), F.array().cast("array<string>"))
    allowed, needed = F.array(*map(F.lit, (*required, *optional))), F.array(*map(F.lit, required))
    return F.struct(F.array_sort(F.array_except(needed, keys)).alias("missing"), F.array_sort(F.array_except(keys, allowed)).alias("unknown"))


def read_contract(df: DataFrame, payload: str, schema: T.StructType) -> DataFrame:
    """Strict typed read: `record` where the payload has exactly the schema's keys and types, else null and `contract_error`."""
    required = tuple(f.name for f in schema.fields if not f.nullable)
    optional = tuple(f.name for f in schema.fields if f.nullable)
    nullable = T.StructType([T.StructField(f.name, f.dataType, True) for f in schema.fields] + [T.StructField("_corrupt", T.StringType())])
    found = df.withColumn("_k", key_violations(F.col(payload), required, optional))
    found = found.withColumn("_r", F.from_json(payload, nullable, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"}))
    problem = F.when(F.col(payload).isNull() | F.col("_r").isNull() | F.col("_r._corrupt").isNotNull(), "malformed").when(F.size("_k.missing") > 0, "missing_field").when(F.size("_k.unknown") > 0, "unknown_field")
    record = F.struct(*[F.col(f"_r.{f.name}").alias(f.name) for f in schema.fields])
    return found.withColumn("contract_error", problem).withColumn("record", F.when(F.col("contract_error").isNull(), record)).drop("_k", "_r")


def schema_drift(df: DataFrame, saved: str) -> list[str]:
    """Field names that a frame and a saved schema (its JSON) don't share with the same type."""
    now = {f["name"]: f for f in json.loads(df.schema.json())["fields"]}
    then = {f["name"]: f for f in json.loads(saved)["fields"]}
    return sorted(k for k in now.keys() | then.keys() if now.get(k) != then.get(k))
