"""Validation of document files: the first rule that fails names the error; valid and rejected rows are routed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MIB = 1024 * 1024
DEFAULT_MAX_MIB, MAX_PIXELS = 15, 40_000_000
# Extensions, declared types, signatures and HTTP statuses.
MIME_BY_EXTENSION = {
    ".pdf": ("application/pdf", "application/x-pdf"),
    ".png": ("image/png",),
    ".jpg": ("image/jpeg", "image/jpg"),
    ".jpeg": ("image/jpeg", "image/jpg"),
}
SIGNATURES = {".pdf": b"%PDF-", ".png": b"\x89PNG\r\n\x1a\n", ".jpg": b"\xff\xd8\xff", ".jpeg": b"\xff\xd8\xff"}
TOO_LARGE_STATUS, REJECTED_STATUS = 413, 422


def sanitized_filename(filename: Column, role: Column) -> Column:
    """Last path segment, unsafe runs of the stem as `_`, no `.` or `_` at its ends, 80 characters, suffix in lower case."""
    raw = F.element_at(F.split(F.replace(F.coalesce(F.nullif(filename, F.lit("")), F.concat(role, F.lit(".bin"))), F.lit("\\"), F.lit("/")), "/"), -1)
    suffix = F.regexp_extract(raw, r"^.+(\.[^.]+)$", 1)
    stem = F.substring(raw, F.lit(1), F.length(raw) - F.length(suffix))
    safe = F.trim(F.regexp_replace(stem, "[^A-Za-z0-9._-]+", "_"), F.lit("._"))
    return F.concat(F.substring(F.when(safe == "", role).otherwise(safe), 1, 80), F.lower(suffix))


def extension(safe_name: Column) -> Column:
    return F.regexp_extract(safe_name, r"^.+(\.[^.]+)$", 1)


def declared_type(content_type: Column) -> Column:
    return F.lower(F.trim(F.substring_index(F.coalesce(content_type, F.lit("")), ";", 1)))


def error(code: str, role: Column, **details: Column) -> Column:
    pairs = [x for k, v in details.items() for x in (F.lit(k), v.cast("string"))]
    found = F.create_map(*pairs) if pairs else F.create_map().cast("map<string,string>")
    return F.struct(F.lit(code).alias("code"), role.alias("field"), found.alias("details"))


def validate_files(files: DataFrame, max_bytes: int = DEFAULT_MAX_MIB * MIB, max_pages: int = 1) -> DataFrame:
    """Add filename, extension, kind, content_type, sha256 and error (null if the file passes).

    files: role, filename, content_type, content, and where known page_count, width and height (width -1: undecodable).
    The content itself is dropped once its hash is known, so no later shuffle carries it.
    """
    known = set(files.columns)
    for name in ("page_count", "width", "height"):
        if name not in known:
            files = files.withColumn(name, F.lit(None).cast("int"))
    role = F.col("role")
    df = files.withColumn("safe_name", sanitized_filename(F.col("filename"), role))
    df = df.withColumn("extension", extension(F.col("safe_name"))).withColumn("declared", declared_type(F.col("content_type")))
    df = df.withColumn("received", F.coalesce(F.octet_length("content"), F.lit(0)))
    supported = F.col("extension").isin(*MIME_BY_EXTENSION)
    types = F.create_map(*[x for k, v in MIME_BY_EXTENSION.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    signed = F.lit(False)
    for ext, magic in SIGNATURES.items():
        signed = signed | ((F.col("extension") == ext) & (F.substring("content", 1, len(magic)) == F.lit(magic)))
    image = F.col("extension") != ".pdf"
    rule = F.when(F.col("received") == 0, error("empty_file", role))
    rule = rule.when(F.col("received") > max_bytes, error("file_too_large", role, max_bytes=F.lit(max_bytes), received_bytes=F.col("received")))
    rule = rule.when(~supported, error("unsupported_file_type", role, extension=F.coalesce(F.nullif("extension", F.lit("")), F.lit("none"))))
    rule = rule.when(~F.array_contains(types[F.col("extension")], F.col("declared")), error("mime_type_mismatch", role, content_type=F.coalesce(F.nullif("declared", F.lit("")), F.lit("missing")), extension=F.col("extension")))
    rule = rule.when(~signed, error("content_type_mismatch", role))
    rule = rule.when(F.col("page_count") > max_pages, error("single_page_required", role, page_count=F.col("page_count")))
    rule = rule.when(image & (F.col("width") < 0), error("corrupt_image", role))
    pixels = F.col("width").cast("long") * F.col("height")
    rule = rule.when(image & ((F.col("width") == 0) | (F.col("height") <= 0) | (pixels > MAX_PIXELS)), error("invalid_image_dimensions", role, width=F.col("width"), height=F.col("height")))
    kind = F.when(F.col("extension") == ".pdf", "pdf").when(supported, "image")
    canonical = F.when(F.col("extension") == ".pdf", "application/pdf").when(F.col("extension") == ".png", "image/png").when(supported, "image/jpeg")
    out = df.withColumns({"error": rule, "kind": kind, "content_type": canonical, "sha256": F.sha2("content", 256), "filename": F.col("safe_name")})
    return out.drop("content", "safe_name", "declared")


def page_counts(pages: DataFrame) -> DataFrame:
    """file_id and the number of its pages, for the single-page rule."""
    return pages.groupBy("file_id").agg(F.count("*").cast("int").alias("page_count"))


def routed(validated: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with an HTTP status)."""
    status = F.when(F.col("error.code") == "file_too_large", TOO_LARGE_STATUS).otherwise(REJECTED_STATUS)
    return validated.where("error IS NULL"), validated.where("error IS NOT NULL").withColumn("status", status)


def integrity_failures(submitted: DataFrame, stored: DataFrame) -> DataFrame:
    """pair_id, role of submitted files without a stored one of the same content."""
    a = submitted.select("pair_id", "role", F.sha2("content", 256).alias("sha256"))
    return a.join(stored.select("pair_id", "role", F.sha2("content", 256).alias("sha256")), ["pair_id", "role", "sha256"], "left_anti").select("pair_id", "role")


def mode_error(mode: Column) -> Column:
    return F.when(F.coalesce(mode, F.lit("")) != "exact", F.struct(F.lit("unsupported_comparison_mode").alias("code"), F.lit("comparison_mode").alias("field"), F.create_map(F.lit("comparison_mode"), F.coalesce(mode, F.lit("missing"))).alias("details")))


def valid_job_id(job_id: Column) -> Column:
    return F.coalesce(job_id.rlike("^[0-9a-f-]+$"), F.lit(False))


def valid_asset_id(asset_id: Column) -> Column:
    return F.coalesce(asset_id.rlike("^[A-Za-z0-9_-]{1,80}$"), F.lit(False))


def guarded_jobs(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """One job row a pair: completed where there is a result, else failed with `analysis_failed`; never a failed query."""
    done = results.select("pair_id", F.lit(True).alias("_done"))
    state = F.when(F.col("_done"), "completed").otherwise("failed")
    return pairs.select("pair_id").join(done, "pair_id", "left").select("pair_id", state.alias("state"), F.when(F.col("_done").isNull(), "analysis_failed").alias("error_code"))
