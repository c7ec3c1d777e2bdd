"""Result payloads of many producers brought to one shape, as variant expressions.

Each part of a payload is a table of fields: name, the keys that may hold it, its type and its default. One evaluator
reads a table: an object is taken apart once, by a single cast to a struct of all keys; then the first key that is neither
missing nor null is picked, and its kind and text are read once. Expressions are put together as SQL text, one for a payload;
steps are bound to lambda variables, as Spark repeats what is written twice inside nested lambdas.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import count

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The payload contract. A field: name, keys in order, type, default. Types: text; url; number; score (0..100, a share
# of one counts as such); percent (0..100); natural (0 or more); positive (1 or more); part and list (kept as they are).
FINDING = (
    ("finding_id", ("finding_id", "id"), "text", None),
    ("page_number", ("page_number", "page"), "positive", 1.0),
    ("category", ("category",), "text", "visual_difference"),
    ("title", ("title",), "text", "Document difference"),
    ("explanation", ("explanation", "description"), "text", "This region differs from the trusted reference."),
    ("bounding_box", ("bounding_box", "candidate_bounding_box", "normalized_bbox", "bbox"), "part", None),
    ("risk_score", ("risk_score", "risk"), "score", 0.0),
    ("confidence_score", ("confidence_score", "confidence"), "score", 0.0),
    ("severity", ("severity",), "text", "review"),
    ("evidence_source", ("evidence_source", "evidence_sources"), "part", "Visual comparison"),
    ("measurements", ("measurements", "supporting_measurements"), "part", None),
    ("assets", ("assets",), "part", None),
)
LINKS = (
    ("candidate_crop_url", ("candidate_crop_url", "candidate_crop"), "url", ""),
    ("reference_crop_url", ("reference_crop_url", "reference_crop"), "url", ""),
    ("difference_overlay_url", ("difference_overlay_url", "diff_overlay_url", "difference_overlay"), "url", ""),
)
BOX = tuple((n, k, "number", 0.0) for n, k in (("x", ("x", "left", "x0")), ("y", ("y", "top", "y0")), ("w", ("width", "w")), ("h", ("height", "h")), ("x1", ("x1",)), ("y1", ("y1",))))
PAGE = (
    ("page_number", ("page_number", "page"), "positive", None),
    ("width", ("width",), "size", None),
    ("height", ("height",), "size", None),
    ("candidate_image_url", ("candidate_image_url", "candidate_page_url", "preview_url", "image_url"), "url", ""),
    ("reference_image_url", ("reference_image_url", "reference_page_url"), "url", ""),
    ("findings", ("findings",), "list", None),
)
DESCRIPTOR = (
    *((n, (n,), "text", "") for n in ("filename", "content_type", "sha256")),
    ("page_count", ("page_count",), "positive", 1.0),
    ("width", ("width",), "natural", 0.0),
    ("height", ("height",), "natural", 0.0),
    ("preview_url", ("preview_url",), "url", ""),
    ("transform", ("transform",), "part", None),
)
TRANSFORM = (
    *((n, (n,), "natural", 0.0) for n in ("original_width", "original_height", "normalized_width", "normalized_height")),
    ("scale_x", ("scale_x",), "number", 1.0),
    ("scale_y", ("scale_y",), "number", 1.0),
    ("orientation_degrees", ("orientation_degrees",), "number", 0.0),
)
RESULT = (
    ("result_job_id", ("job_id", "analysis_id"), "text", None),
    ("schema_version", ("schema_version",), "text", "1.0"),
    ("comparison_mode", ("comparison_mode",), "text", "exact"),
    ("reference", ("reference",), "part", None),
    ("candidate", ("candidate",), "part", None),
    ("candidate_image_url", ("candidate_image_url", "candidate_page_url", "preview_url"), "url", ""),
    ("reference_image_url", ("reference_image_url", "reference_page_url"), "url", ""),
    ("findings", ("findings",), "list", None),
    ("pages", ("pages",), "list", None),
    ("metrics", ("metrics",), "part", None),
)
METRICS = (
    ("overall_tampering_risk", ("overall_tampering_risk", "tampering_risk", "risk_score"), "score", 0.0),
    ("risk_label", ("risk_label", "label"), "text", "Tampering risk assessed"),
    ("assessment_confidence", ("assessment_confidence", "confidence"), "score", 0.0),
    ("analysis_coverage", ("analysis_coverage", "coverage"), "score", 0.0),
    ("alignment_quality", ("alignment_quality",), "score", 0.0),
    ("finding_count", ("finding_count",), "natural", None),
    ("seconds", ("processing_duration", "duration_seconds"), "number", 0.0),
    ("processing_duration_ms", ("processing_duration_ms", "duration_ms"), "natural", None),
)
JOB = (
    ("job_id", ("job_id", "id"), "text", ""),
    ("state", ("state", "status"), "text", ""),
    ("progress", ("progress",), "percent", 0.0),
    ("current_stage", ("current_stage", "stage_id", "stage"), "text", None),
    ("message", ("message", "current_stage_message", "stage_message"), "text", ""),
    ("finding_count", ("finding_count", "current_finding_count"), "natural", None),
    ("candidate_page_url", ("candidate_page_url", "candidate_image_url", "preview_url"), "url", ""),
    ("error", ("error",), "part", None),
    ("result", ("result", "document_result"), "part", None),
)
ERROR = (("code", ("code", "error_code"), "text", "analysis_error"), ("message", ("message", "detail"), "text", "Analysis could not be completed."), ("field", ("field",), "text", ""))
EVENT = (
    ("progress_event_id", ("event_id", "id"), "part", None),
    ("job_id", ("job_id",), "text", ""),
    ("stage_id", ("stage_id", "current_stage", "stage"), "text", "processing"),
    ("message", ("message", "stage_message"), "text", "Analysing document"),
    ("progress", ("progress",), "percent", 0.0),
    ("page_number", ("page_number",), "positive", 1.0),
    ("total_pages", ("total_pages",), "positive", 1.0),
    ("timestamp", ("timestamp",), "text", None),
    ("finding_count", ("finding_count", "current_finding_count"), "natural", 0.0),
    ("candidate_page_url", ("candidate_page_url", "candidate_image_url", "preview_url"), "url", ""),
)
STATE_SYNONYMS = {
    "completed": ("complete", "completed", "succeeded", "success"),
    "failed": ("failed", "error", "cancelled"),
    "queued": ("queued", "pending", "created"),
}
ABSOLUTE = "(?i)^(https?:|blob:|data:)"

Field = tuple[str, tuple[str, ...], str, object]
NO_NUMBER = "CAST(NULL AS DOUBLE)"
_names = count()


class Sql(str):
    """An expression, where a plain value would be a literal."""


def literal(value: object) -> str:
    if isinstance(value, Sql):
        return value
    if value is None:
        return "NULL"
    return f"{value!r}D" if isinstance(value, float) else "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


def bound(v: str, f: Callable[[str], str]) -> str:
    """f of v, with v worked out once."""
    x = f"v{next(_names)}"
    return f"get(transform(array({v}), {x} -> {f(x)}), 0)"


def mapped(list_: str, f: Callable[[str, str], str]) -> str:
    x, i = f"v{next(_names)}", f"i{next(_names)}"
    return f"transform({list_}, ({x}, {i}) -> {f(x, i)})"


def struct(**cells: str) -> str:
    return "named_struct(" + ", ".join(f"'{n}', {c}" for n, c in cells.items()) + ")"


def of(v: str, field: str) -> str:
    return f"{v}.`{field}`"


def kind_of(v: str) -> str:
    """STRING, OBJECT<...>, ARRAY<...> or a number's type, as the variant has it."""
    return f"schema_of_variant({v})"


def string_of(v: str) -> str:
    return f"try_variant_get({v}, '$', 'string')"


def is_object(v: str) -> str:
    return f"coalesce(startswith({kind_of(v)}, 'OBJECT'), false)"


def is_array(v: str) -> str:
    return f"coalesce(startswith({kind_of(v)}, 'ARRAY'), false)"


def keys_of(v: str, fields: tuple[Field, ...]) -> str:
    """All keys of the fields by one cast; nulls where v is no object or lacks them."""
    keys = dict.fromkeys(k for _, ks, _, _ in fields for k in ks)
    return f"try_variant_get({v}, '$', 'struct<{','.join(f'{k}:variant' for k in keys)}>')"


def scalar(v: str) -> str:
    return struct(k=kind_of(v), t=string_of(v))


def first_present(s: str, fields: tuple[Field, ...]) -> str:
    """For each field the first of its keys that is neither missing nor null: parts as variants, the rest as kind and text."""
    pick = lambda ks: "coalesce(" + ", ".join(f"if(is_variant_null({of(s, k)}), NULL, {of(s, k)})" for k in ks) + ")"
    return struct(**{n: pick(ks) if t in ("part", "list") else bound(pick(ks), scalar) for n, ks, t, _ in fields})


def clamp(x: str, low: float = 0.0, high: float = 100.0) -> str:
    return f"least({high}D, greatest({low}D, {x}))"


def number_of(x: str, fallback: object) -> str:
    """A number or a numeric string; blank strings are 0, true is 1; what is not finite gives the fallback."""
    k, t = of(x, "k"), f"trim({of(x, 't')})"
    number = f"CASE WHEN {k} = 'BOOLEAN' THEN CAST({t} = 'true' AS DOUBLE) WHEN {t} = '' THEN 0D ELSE try_cast({t} AS DOUBLE) END"
    other = NO_NUMBER if fallback is None else literal(fallback)
    return bound(number, lambda n: f"if(NOT isnan({n}) AND abs({n}) < double('infinity'), {n}, {other})")


def text_of(x: str, fallback: object) -> str:
    return f"if({of(x, 'k')} = 'STRING', {of(x, 't')}, {literal(fallback)})"


def score_of(x: str) -> str:
    """0 to 100; a value above 0 and at most 1 counts as a share of one."""
    return clamp(f"if({x} > 0 AND {x} <= 1, {x} * 100, {x})")


def url_of(url: str, base: str = "") -> str:
    return f"CASE WHEN {url} = '' OR {url} RLIKE {literal(ABSOLUTE)} THEN {url} WHEN startswith({url}, '/') THEN concat({literal(base)}, {url}) ELSE concat({literal(base + '/')}, {url}) END"


def value_of(x: str, type_: str, default: object) -> str:
    if type_ in ("part", "list"):
        return x
    if type_ == "text":
        return text_of(x, default)
    if type_ == "url":
        return bound(text_of(x, default), url_of)
    if type_ == "size":
        return f"if({of(x, 'k')} IS NOT NULL, {number_of(x, 0.0)}, {NO_NUMBER})"
    number = number_of(x, default)
    if type_ == "score":
        return bound(number, score_of)
    if type_ == "percent":
        return clamp(number)
    least = {"natural": "0D", "positive": "1D"}.get(type_)
    return f"greatest({least}, {number})" if least and default is not None else number


def read(v: str, fields: tuple[Field, ...]) -> str:
    """The fields of an object as a struct."""
    values = lambda p: struct(**{n: value_of(of(p, n), t, d) for n, _, t, d in fields})
    return bound(bound(keys_of(v, fields), lambda s: first_present(s, fields)), values)


SIDES = ("x", "y", "width", "height")


def box(v: str) -> str:
    """x, y, width, height in 0..1 from an array of four or an object under any of its spellings."""
    item = lambda a, i: number_of(scalar(f"get({a}, {i})"), 0.0)
    of_list = bound(f"try_variant_get({v}, '$', 'array<variant>')", lambda a: struct(**{c: f"if(size({a}) > 3, {item(a, i)}, 0D)" for i, c in enumerate(SIDES)}))
    size = lambda n, at, end: f"if({n} = 0 AND {end} IS NOT NULL, {end} - {at}, {n})"
    ends = tuple((n, k, t, None if n in ("x1", "y1") else d) for n, k, t, d in BOX)
    of_object = bound(read(v, ends), lambda b: struct(x=f"{b}.x", y=f"{b}.y", width=size(f"{b}.w", f"{b}.x", f"{b}.x1"), height=size(f"{b}.h", f"{b}.y", f"{b}.y1")))
    found = f"CASE WHEN {is_array(v)} THEN {of_list} WHEN {is_object(v)} THEN {of_object} ELSE {struct(**dict.fromkeys(SIDES, NO_NUMBER))} END"
    return bound(found, lambda b: struct(**{c: clamp(f"coalesce({b}.{c}, 0D)", 0.0, 1.0) for c in SIDES}))


def measurements(v: str) -> str:
    """Scalar and null entries of an object, as strings."""
    entries = f"coalesce(try_variant_get({v}, '$', 'map<string,variant>'), CAST(map() AS map<string,variant>))"
    return f"transform_values(map_filter({entries}, (k, x) -> NOT ({is_object('x')} OR {is_array('x')})), (k, x) -> {string_of('x')})"


def descriptor(v: str) -> str:
    """A document's description with its defaults; null unless an object."""
    names = [f[0] for f in DESCRIPTOR]
    return f"if({is_object(v)}, " + bound(read(v, DESCRIPTOR), lambda d: struct(**{n: read(of(d, n), TRANSFORM) if n == "transform" else of(d, n) for n in names})) + ", NULL)"


def evidence(v: str) -> str:
    default = dict((f[0], f[3]) for f in FINDING)["evidence_source"]
    listed = mapped(f"try_variant_get({v}, '$', 'array<variant>')", lambda e, _: f"if({kind_of(e)} = 'STRING', {string_of(e)}, '')")
    return f"CASE WHEN {is_array(v)} THEN array_join(filter({listed}, s -> s <> ''), ', ') WHEN {kind_of(v)} = 'STRING' THEN {string_of(v)} ELSE {literal(default)} END"


def findings_of(list_: str) -> str:
    """An array of variants as findings, step by step over the whole array. Links are read from `assets` where that is an object."""

    def picked(s: str, _: str) -> str:
        links = of(s, "assets")
        inner = bound(keys_of(links, LINKS), lambda k: first_present(k, LINKS))
        return struct(p=first_present(s, FINDING), l=f"if({is_object(links)}, {inner}, {first_present(s, LINKS)})")

    def finished(x: str, i: str) -> str:
        part = {"bounding_box": box, "evidence_source": evidence, "measurements": measurements}
        cells = {}
        for n, _, t, d in FINDING:
            own = of(f"{x}.p", n)
            if n == "measurements":
                cells |= {m: value_of(of(f"{x}.l", m), u, e) for m, _, u, e in LINKS}
            if n != "assets":
                cells[n] = bound(own, part[n]) if n in part else value_of(own, t, Sql(f"concat('finding-', {i} + 1)") if n == "finding_id" else d)
        cells["page_number"] = f"CAST({cells['page_number']} AS INT)"
        return struct(**cells)

    return mapped(mapped(mapped(list_, lambda v, _: keys_of(v, FINDING + LINKS)), picked), finished)


def listing(v: str) -> str:
    """The elements of an array, none of anything else."""
    return f"coalesce(if({is_array(v)}, try_variant_get({v}, '$', 'array<variant>'), NULL), CAST(array() AS array<variant>))"


def state_of(text: str) -> str:
    cases = " ".join(f"WHEN {text} IN ({', '.join(map(literal, words))}) THEN {literal(name)}" for name, words in STATE_SYNONYMS.items())
    return f"CASE {cases} ELSE 'processing' END"


def error(v: str) -> str:
    """code, message and field from a string or an object."""
    default = {n: d for n, _, _, d in ERROR}
    plain = struct(code=literal(default["code"]), message=string_of(v), field="CAST(NULL AS STRING)")
    other = bound(read(v, ERROR), lambda e: struct(code=f"{e}.code", message=f"{e}.message", field=f"nullif({e}.field, '')"))
    return f"if(coalesce({kind_of(v)} = 'STRING', false), {plain}, {other})"


def result_of(payload: str, other_id: str) -> str:
    """The whole result of a payload as one struct."""

    def page(top: str) -> Callable[[str, str], str]:
        def one(p: str, i: str) -> str:
            number = f"CAST(greatest(1D, {number_of(of(p, 'page_number'), Sql(f'CAST({i} + 1 AS DOUBLE)'))}) AS INT)"
            own = of(p, "findings")
            rest = {n: value_of(of(p, n), t, d) for n, _, t, d in PAGE[1:-1]}
            return bound(number, lambda n: struct(page_number=n, **rest, findings=f"if({is_array(own)}, {findings_of(listing(own))}, filter({top}, f -> f.page_number = {n}))"))

        return one

    def whole(v: str) -> str:
        measured = lambda r: bound(f"if({is_object(of(r, 'metrics'))}, {of(r, 'metrics')}, {v})", lambda m: read(m, METRICS))
        return bound(read(v, RESULT), lambda r: bound(struct(top=findings_of(listing(of(r, "findings"))), m=measured(r)), lambda x: paged(r, x)))

    def paged(r: str, x: str) -> str:
        sheets = mapped(mapped(mapped(listing(of(r, "pages")), lambda v, _: keys_of(v, PAGE)), lambda s, _: first_present(s, PAGE)), page(f"{x}.top"))
        return bound(sheets, lambda pages: bound(f"if(size({x}.top) > 0, {x}.top, flatten(transform({pages}, p -> p.findings)))", lambda found: finished(r, f"{x}.m", pages, found)))

    def finished(r: str, m: str, pages: str, found: str) -> str:
        lone = struct(page_number="1", width=NO_NUMBER, height=NO_NUMBER, candidate_image_url=f"{r}.candidate_image_url", reference_image_url=f"{r}.reference_image_url", findings=found)
        plain = ("overall_tampering_risk", "risk_label", "assessment_confidence", "analysis_coverage", "alignment_quality")
        return struct(
            result_job_id=f"coalesce({r}.result_job_id, {other_id})", schema_version=f"{r}.schema_version", comparison_mode=f"{r}.comparison_mode",
            reference=bound(of(r, "reference"), descriptor), candidate=bound(of(r, "candidate"), descriptor), **{n: of(m, n) for n in plain},
            finding_count=f"greatest(0D, coalesce({m}.finding_count, CAST(size({found}) AS DOUBLE)))", processing_duration_ms=f"greatest(0D, coalesce({m}.processing_duration_ms, {m}.seconds * 1000))",
            pages=f"if(size({pages}) > 0, {pages}, array({lone}))", findings=found,
        )

    return bound(payload, whole)


def kind(v: Column) -> Column:
    return F.schema_of_variant(v)


def asset_url(v: Column, base: str = "") -> Column:
    """A link of a variant: absolute ones and blanks as they are, others behind base."""
    url = F.when(kind(v) == "STRING", F.try_variant_get(v, "$", "string")).otherwise("")
    return F.when((url == "") | url.rlike(ABSOLUTE), url).when(url.startswith("/"), F.concat(F.lit(base), url)).otherwise(F.concat(F.lit(f"{base}/"), url))


def harmonise_results(df: DataFrame, payload: str, job_id: str | None = None) -> DataFrame:
    """df with one column for each part of the result in its JSON payload; a payload that isn't an object gives defaults."""
    other_id = f"CAST(`{job_id}` AS STRING)" if job_id else "''"
    found = df.withColumn("_r", F.expr(result_of(f"try_parse_json(`{payload}`)", other_id)))
    return found.select(*[F.col(f"`{c}`") for c in df.columns], "_r.*")


def harmonise_jobs(df: DataFrame, payload: str) -> DataFrame:
    """State, progress, stage, message, error and nested result of job payloads; findings are counted from the result where no count is given."""
    found = df.withColumn("_j", F.expr(read(f"try_parse_json(`{payload}`)", JOB)))
    found = found.withColumn("_s", F.expr(state_of("lower(_j.state)"))).withColumn("_result", F.expr(f"if(_j.result IS NOT NULL, {result_of('_j.result', '_j.job_id')}, NULL)"))
    cells = {
        "job_id": "_j.job_id", "state": "_s", "progress": "_j.progress", "current_stage": "coalesce(_j.current_stage, _s)", "message": "_j.message",
        "finding_count": "greatest(0D, coalesce(_j.finding_count, _result.finding_count, 0D))", "candidate_page_url": "nullif(_j.candidate_page_url, '')",
        "error": f"if(_j.error IS NOT NULL OR _s = 'failed', {bound('_j.error', error)}, NULL)", "result": "_result",
    }
    return found.select(*[F.col(f"`{c}`") for c in df.columns], *[F.expr(c).alias(n) for n, c in cells.items()])


def harmonise_events(df: DataFrame, payload: str) -> DataFrame:
    """Progress events with their defaults; an event without a time of its own has none."""
    found = df.withColumn("_e", F.expr(read(f"try_parse_json(`{payload}`)", EVENT)))
    cells = {"progress_event_id": f"coalesce({string_of('_e.progress_event_id')}, '')", "candidate_page_url": "nullif(_e.candidate_page_url, '')"}
    return found.select(*[F.col(f"`{c}`") for c in df.columns], *[F.expr(cells.get(n, of("_e", n))).alias(n) for n, _, _, _ in EVENT])


def duration_text(ms: Column) -> Column:
    seconds = ms / 1000
    return F.when(ms < 1000, F.concat(F.round(ms).cast("long").cast("string"), F.lit(" ms"))).when(ms < 10_000, F.format_string("%.1f s", seconds)).otherwise(F.format_string("%.0f s", seconds))


def bytes_text(n: Column) -> Column:
    """Halves go up, as in toFixed."""
    return F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024**2, F.format_string("%.1f KB", n / 1024)).otherwise(F.format_string("%.1f MB", n / 1024**2))


def title_text(key: Column) -> Column:
    return F.initcap(F.replace(key, F.lit("_"), F.lit(" ")))


def measurement_text(v: Column) -> Column:
    number = F.try_variant_get(v, "$", "double")
    whole = number == F.floor(number)
    return (
        F.when(v.isNull() | F.is_variant_null(v), "Not available")
        .when(kind(v) == "BOOLEAN", F.when(F.try_variant_get(v, "$", "boolean"), "Yes").otherwise("No"))
        .when(kind(v) == "STRING", F.try_variant_get(v, "$", "string"))
        .when(whole, number.cast("long").cast("string"))
        .otherwise(F.format_string("%.3f", number))
    )


def risk_tone(risk: Column) -> Column:
    return F.when(risk >= 75, "critical").when(risk >= 50, "high").when(risk >= 25, "moderate").otherwise("low")
