"""More queries with SQL: findings and results from a fixture, files written and read back, streams run to their end over a restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.operators import alignment, evaluation, joblog, regions, text
from attestra.operators.pages import PAGE
from attestra.plans import verification
from attestra.plans.queries import JOBS, LOG, PAIRS, STAGES, WORDS, log, query, table, updates
from attestra.sources import files as sources
from attestra.sources.tables import scratch, written
from attestra.streaming import joblog as streaming

# Findings: an order is a page of its customer, a line of it a region.
FOUND = """
fl AS (SELECT o_custkey AS pair_id, o_orderkey AS page_number, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS region_no,
  l_partkey % 500 AS x0, l_suppkey % 900 AS y0, l_partkey % 500 + 20 + CAST(l_quantity AS INT) AS x1, l_suppkey % 900 + 15 AS y1, CAST(l_quantity * 10 AS BIGINT) AS changed, l_quantity * 2 AS mean_delta, l_linenumber AS edges,
  l_returnflag = 'R' AS told, 'p' || l_partkey AS before, 's' || l_suppkey AS after, o_orderstatus = 'F' AS has_text, 1 - (o_orderkey % 40) / 100.0::DOUBLE AS quality FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
fr AS (SELECT *, row_number() OVER (PARTITION BY pair_id, page_number ORDER BY told DESC, changed DESC, region_no) AS rank FROM fl),
ft AS (SELECT *, CASE WHEN told THEN before ELSE '' END AS tb, CASE WHEN told THEN after ELSE '' END AS ta, (x1 - x0) * (y1 - y0) AS area, row_number() OVER (PARTITION BY pair_id ORDER BY page_number, rank) AS number FROM fr WHERE rank <= 5),
fs AS (SELECT *, 'finding-' || printf('%03d', number) AS finding_id,
  round(least(greatest(32.0 + 24.0 * least(1.0, mean_delta / 100.0) + 18.0 * least(1.0, changed / area::DOUBLE * 2.5) + 11.0 * least(1.0, area / 2289600.0::DOUBLE / 0.008) + CASE WHEN told THEN 15.0 ELSE 0.0 END, 1.0), 99.0)::DOUBLE, 1) AS risk_score,
  round(least(greatest(50.0 + 35.0 * quality + 8.0 * least(1.0, changed / area::DOUBLE * 3.0) + CASE WHEN told THEN 7.0 ELSE 0.0 END, 1.0), 99.0)::DOUBLE, 1) AS confidence_score FROM ft),
fv AS (SELECT *, CASE WHEN risk_score >= 85 THEN 'critical' WHEN risk_score >= 65 THEN 'high' WHEN risk_score >= 40 THEN 'medium' WHEN risk_score >= 15 THEN 'low' ELSE 'info' END AS severity,
  CASE WHEN told THEN 'text_content_change' ELSE 'visual_content_change' END AS category FROM fs),
fd AS (SELECT pair_id, round(least(100.0, max(risk_score) + least(6.0, 1.5 * (count(*) - 1)))::DOUBLE, 1) AS risk, count(*) AS n, count(DISTINCT page_number) AS pages, min(quality) AS quality, bool_or(has_text) AS has_text,
  string_agg(page_number || '/' || finding_id, ',' ORDER BY number) AS ids FROM fv GROUP BY pair_id),
fn AS (SELECT *, CASE WHEN risk < 25 THEN 'Low tampering risk' WHEN risk < 50 THEN 'Moderate tampering risk' WHEN risk < 75 THEN 'High tampering risk' ELSE 'Critical tampering risk' END AS risk_label FROM fd)
"""


def listed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(ranked regions, pages) of that fixture."""
    li, o = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders")
    both = li.join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    told = F.col("l_returnflag") == "R"
    x0, y0 = F.col("l_partkey") % 500, F.col("l_suppkey") % 900
    change = F.struct(F.lit(1).alias("hunk_no"), F.concat(F.lit("p"), "l_partkey").alias("before"), F.concat(F.lit("s"), "l_suppkey").alias("after"))
    each = both.select(
        F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("page_number"), F.row_number().over(order).alias("region_no"),
        x0.alias("x0"), y0.alias("y0"), (x0 + 20 + F.col("l_quantity").cast("int")).alias("x1"), (y0 + 15).alias("y1"),
        (F.col("l_quantity") * 10).cast("long").alias("changed_pixels"), (F.col("l_quantity") * 2).alias("mean_delta"), F.lit(200).alias("max_delta"), F.col("l_linenumber").alias("edge_changed_pixels"),
        F.when(told, F.array(F.lit(regions.VISUAL), F.lit(regions.TEXTUAL), F.lit(regions.VISUAL))).otherwise(F.array(F.lit(regions.VISUAL))).alias("evidence_sources"),
        F.when(told, F.array(change)).otherwise(F.array().cast("array<struct<hunk_no:int,before:string,after:string>>")).alias("text_changes"),
    )
    pages = o.join(li.select(F.col("l_orderkey").alias("o_orderkey")).distinct(), "o_orderkey").select(
        F.col("o_custkey").alias("pair_id"), F.col("o_orderkey").alias("page_number"), (F.col("o_orderstatus") == "F").alias("has_text"), F.lit(verification.PAGE_WIDTH).alias("width"), F.lit(verification.PAGE_HEIGHT).alias("height"),
        F.lit(0.0).alias("changed_ratio"), F.lit(alignment.HOMOGRAPHY).alias("alignment_method"), (1 - F.col("o_orderkey") % 40 / 100.0).alias("alignment_quality"), F.lit(0.5).alias("inlier_ratio"),
    )
    return regions.ranked(each), pages


@query(f"""WITH {FOUND} SELECT pair_id, page_number, finding_id, category, CASE WHEN told THEN 'Text' ELSE 'Visual' END || ' content differs from the trusted reference' AS title,
 CASE WHEN told THEN 'In the marked box the reference reads “' || tb || '” where the questioned page reads “' || ta || '”.' ELSE 'The two pages look different in the marked box once they lie on each other.' END AS explanation, risk_score, confidence_score, severity,
 CASE WHEN told THEN 'embedded_text_change,visual_difference' ELSE 'visual_difference' END AS evidence, '/api/v1/analyses/' || pair_id || '/assets/' || finding_id || '-overlay' AS overlay,
 CAST(round(changed / area::DOUBLE, 5) AS DOUBLE) AS density, changed AS pixels, area AS region_area, edges, nullif(tb, '') AS text_before, nullif(ta, '') AS text_after, round(x0 / 1272.0::DOUBLE, 6) AS x FROM fv""")
def f17_g7_g9_findings(spark, sf_dir):
    """Ranked regions as findings: texts, scores, links, measurements and sorted evidence."""
    m = lambda k, kind: F.element_at("supporting_measurements", k).cast(kind)
    return regions.findings(*listed(spark, sf_dir)).select(
        "pair_id", "page_number", "finding_id", "category", "title", "explanation", "risk_score", "confidence_score", "severity", F.array_join("evidence_source", ",").alias("evidence"), F.col("assets.difference_overlay_url").alias("overlay"),
        m("changed_pixel_density", "double").alias("density"), m("changed_pixel_count", "long").alias("pixels"), m("region_pixel_area", "long").alias("region_area"), m("edge_changed_pixels", "int").alias("edges"),
        m("text_before", "string").alias("text_before"), m("text_after", "string").alias("text_after"), F.col("bounding_box.x").alias("x"),
    )


@query(f"WITH {FOUND} SELECT pair_id, risk, risk_label, n AS finding_count, pages AS n_pages, round(quality * 100, 1) AS quality, round(least(99.0, 65.0 + 27.0 * quality + CASE WHEN has_text THEN 7.0 ELSE 0.0 END)::DOUBLE, 1) AS confidence, ids FROM fn")
def g10_nested_documents(spark, sf_dir):
    """Findings nested in their pages, pages in their document, in order."""
    ids = F.flatten(F.transform("pages", lambda p: F.transform(p.findings, lambda f: F.concat(p.page_number.cast("string"), F.lit("/"), f.finding_id))))
    return regions.documents(*listed(spark, sf_dir)).select(
        "pair_id", F.col("overall_tampering_risk").alias("risk"), "risk_label", "finding_count", F.size("pages").cast("long").alias("n_pages"), F.col("alignment_quality").alias("quality"), F.col("assessment_confidence").alias("confidence"), F.array_join(ids, ",").alias("ids")
    )


@query(f"WITH {FOUND} SELECT risk_label, severity, category, count(*) AS findings, count(DISTINCT fv.pair_id) AS pairs FROM fv JOIN fn USING (pair_id) GROUP BY ROLLUP (risk_label, severity, category)")
def g12_rollup_of_findings(spark, sf_dir):
    both = listed(spark, sf_dir)
    return regions.rolled_up(regions.documents(*both), regions.findings(*both))


@query(f"WITH {FOUND} SELECT count(*) AS pairs, round(avg(risk), 6) AS mean_risk, max(risk) AS max_risk, CAST(sum(n) AS BIGINT) AS findings, count(*) FILTER (WHERE n = 0) AS clean_pairs FROM fn")
def j7_summary_of_documents(spark, sf_dir):
    return evaluation.summary(regions.documents(*listed(spark, sf_dir))).withColumn("mean_risk", F.round("mean_risk", 6))


@query(f"""WITH {PAIRS}, {WORDS}, d AS (SELECT k.doc_id, sha256(t) AS sha256, CAST(greatest(1, ceil(len(ws) / 720.0::DOUBLE)) AS INT) AS n FROM k JOIN w0 USING (doc_id))
SELECT pair_id, CAST(reference_id AS VARCHAR) AS reference, r.sha256 AS reference_sha256, r.n AS reference_pages, c.sha256 AS candidate_sha256, c.n AS candidate_pages, '/api/v1/analyses/' || pair_id || '/assets/candidate-page' AS preview_url
FROM pairs JOIN d r ON r.doc_id = reference_id JOIN d c ON c.doc_id = candidate_id""")
def g10_descriptors(spark, sf_dir):
    """What results say of their two documents."""
    d = verification.described(*verification.text_pairs(spark, sf_dir))
    return d.select("pair_id", F.col("reference.document_id").alias("reference"), F.col("reference.sha256").alias("reference_sha256"), F.col("reference.page_count").alias("reference_pages"), F.col("candidate.sha256").alias("candidate_sha256"), F.col("candidate.page_count").alias("candidate_pages"), F.col("candidate.preview_url").alias("preview_url"))


# Alignment by a fitted matrix: each text against itself on pages that are laid out smaller and aside.
RELAID = r"""
k AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w0 AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS ws FROM k),
w1 AS (SELECT doc_id, unnest(range(0, len(ws))) AS pos FROM w0),
pp AS (SELECT doc_id, CAST(pos // 720 + 1 AS INT) AS page_number, count(*) AS n, 1 - doc_id % 6 * 0.02::DOUBLE AS s, (doc_id % 7) * 4.0::DOUBLE AS tx, (doc_id % 7) * 6.0::DOUBLE AS ty FROM w1 GROUP BY doc_id, pos // 720),
pq AS (SELECT *, n > 12 AS fits, n >= 10 AND n > 12 AS gates FROM pp)
"""


@query(f"""WITH {RELAID} SELECT doc_id, page_number, n AS match_count, CASE WHEN fits THEN round(s, 6) END AS scale, CASE WHEN fits THEN round(tx, 4) END AS shift_x, CASE WHEN fits THEN round(ty, 4) END AS shift_y,
 CASE WHEN fits THEN CASE WHEN s = 1 AND tx = 0 THEN 'orb_identity_snap' ELSE 'orb_homography' END END AS method, CASE WHEN fits THEN round(0.30 + 0.40 + 0.15 * least(1.0, n / 100.0::DOUBLE) + 0.15, 6) END AS quality FROM pq""")
def d5_d9_relaid_pages(spark, sf_dir):
    """Fit, gates, plausibility, snap and quality of pages that were moved and scaled; pages of one line can't tell a scale and are only counted."""
    w, h = verification.PAGE_WIDTH, verification.PAGE_HEIGHT
    words = text.words_from_text(table(spark, sf_dir, "documents").select("doc_id", "text"))
    key = F.col("doc_id")
    scale, tx, ty = 1 - key % 6 * 0.02, key % 7 * 4.0, key % 7 * 6.0
    rx, ry = (F.col("x0") + F.col("x1")) / 2 * w, (F.col("y0") + F.col("y1")) / 2 * h
    points = words.select(key.alias("pair_id"), "page_number", rx.alias("rx"), ry.alias("ry"), (rx * scale + tx).alias("cx"), (ry * scale + ty).alias("cy"))
    fit = written(alignment.fitted_pages(points, *PAGE), "fit")
    sized = [F.lit(v).alias(c) for c, v in (("rw", w), ("rh", h), ("cw", w), ("ch", h))]
    out = alignment.align(fit.select(*PAGE, F.col("matrix").alias("m"), "match_count", "inliers", "inlier_ratio", F.col("reprojection_error").alias("error"), F.lit(False).alias("identical"), *sized), *PAGE)
    both = out.join(fit.select(*PAGE, F.col("matrix").alias("m"), F.col("match_count").alias("n")), PAGE)
    told = lambda c: F.when(F.col("n") > text.GRID_COLUMNS, c)
    at = lambda i, digits: told(F.round(F.get("m", F.lit(i)), digits))
    return both.select(F.col("pair_id").alias("doc_id"), "page_number", F.col("n").alias("match_count"), at(0, 6).alias("scale"), at(2, 4).alias("shift_x"), at(5, 4).alias("shift_y"), told(F.col("method")).alias("method"), told(F.round("quality", 6)).alias("quality"))


# Files.
@query("""SELECT page_id // 100 AS part, count(*) AS pages, CAST(sum(octet_length(encode(coalesce(html, '')))) + count(*) AS BIGINT) AS length, sha256(string_agg(coalesce(html, '') || chr(10), '' ORDER BY page_id)) AS sha256 FROM pages GROUP BY page_id // 100""")
def a1_scanned_files(spark, sf_dir):
    """Pages written as files, a hundred to a file, and read back as bytes."""
    root = scratch(spark, "files")
    p = table(spark, sf_dir, "pages").select(F.floor(F.col("page_id") / 100).alias("part"), "page_id", F.coalesce("html", F.lit("")).alias("html"))
    dealt = p.repartition("part").sortWithinPartitions("part", "page_id")
    dealt.select("part", F.col("html").alias("value")).write.partitionBy("part").text(root)
    part = F.regexp_extract("path", "part=([0-9]+)", 1).cast("long")
    found = sources.scan_files(spark, root, "*.txt").select(part.alias("part"), "length", F.sha2("content", 256).alias("sha256"))
    return found.join(p.groupBy("part").agg(F.count("*").alias("pages")), "part").select("part", "pages", "length", "sha256")


@query(f"WITH {LOG} SELECT CAST(CAST(timestamp AS DATE) AS VARCHAR) AS day, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS numbers, count(DISTINCT stage_id) AS stages FROM ev JOIN {STAGES} ON stage_no = least(event_id, 10) WHERE timestamp >= TIMESTAMP '2024-01-10' AND timestamp < TIMESTAMP '2024-01-20' GROUP BY 1")
def a6_event_files(spark, sf_dir):
    """The log appended in two steps, by days; ten days read back, the others' folders not opened."""
    root = scratch(spark, "log")
    e = joblog.with_stage(log(spark, sf_dir)).select("job_id", "event_id", "event_type", "stage_id", "progress", "timestamp")
    half = F.col("timestamp") < F.to_timestamp(F.lit("2024-01-16"))
    sources.append_events(e.where(half), root)
    sources.append_events(e.where(~half), root)
    read = sources.read_events(spark, root).where((F.col("day") >= F.lit("2024-01-10").cast("date")) & (F.col("day") < F.lit("2024-01-20").cast("date")))
    return read.groupBy(F.col("day").cast("string").alias("day")).agg(F.count("*").alias("n"), F.sum("event_id").alias("numbers"), F.countDistinct("stage_id").alias("stages"))


@query(f"WITH {FOUND} SELECT pair_id, risk, n AS finding_count, ids FROM fn")
def a7_result_files(spark, sf_dir):
    """Nested results written as JSON lines and read back by their schema."""
    root = scratch(spark, "results")
    documents = regions.documents(*listed(spark, sf_dir))
    sources.write_results(documents, root)
    ids = F.flatten(F.transform("pages", lambda p: F.transform(p.findings, lambda f: F.concat(p.page_number.cast("string"), F.lit("/"), f.finding_id))))
    return spark.read.schema(documents.schema).json(root).select("pair_id", F.col("overall_tampering_risk").alias("risk"), "finding_count", F.array_join(ids, ",").alias("ids"))


# Streams: each runs to the end of what is there, stops, and goes on from its checkpoint when more has come.
def ran(parts: list[DataFrame], sink, timers: bool = False) -> None:
    """Write each part behind the others and run the stream that sink starts (given the source and a checkpoint folder) to its end."""
    spark = parts[0].sparkSession
    source, checkpoint = scratch(spark, "source"), scratch(spark, "checkpoint")
    for part in parts:
        part.write.mode("append").parquet(source)
        writer = sink(spark.readStream.schema(part.schema).parquet(source)).option("checkpointLocation", checkpoint)
        if timers:
            streaming.run_to_end(writer, spark)
        else:
            writer.trigger(availableNow=True).start().awaitTermination()


MIDDLE = "2024-01-16"


def halves(df: DataFrame) -> list[DataFrame]:
    early = F.coalesce(F.col("timestamp") < F.to_timestamp(F.lit(MIDDLE)), F.lit(False))
    return [df.where(early), df.where(~early)]


@query(f"WITH {LOG}, {JOBS} SELECT job_id, seq, state, error_code FROM jobs")
def h6_stream_current_jobs(spark, sf_dir):
    """Upserts by buckets, over a restart in the middle of the month."""
    root = scratch(spark, "jobs")
    parts = halves(updates(spark, sf_dir).withColumnRenamed("updated_at", "timestamp"))
    ran(parts, lambda stream: stream.writeStream.foreachBatch(streaming.upsert_jobs(root)))
    return streaming.read_jobs(spark, root).select("job_id", "seq", "state", "error_code")


@query(f"WITH {LOG} SELECT job_id, event_id, event_type FROM ev")
def h8_stream_deduplicated(spark, sf_dir):
    """Every event twice, and a tenth of the first half once more behind the restart, when most of it is too late and the rest is known."""
    root = scratch(spark, "distinct")
    e = log(spark, sf_dir).select("job_id", "event_id", "event_type", "timestamp")
    first, second = halves(e)
    again = first.where("job_id % 10 = 0")
    ran([first.unionByName(first), second.unionByName(second).unionByName(again)], lambda stream: streaming.deduplicated_stream(stream).writeStream.format("parquet").option("path", root))
    return spark.read.parquet(root).select("job_id", "event_id", "event_type")


@query(f"""WITH {LOG}, m AS (SELECT max(timestamp) - INTERVAL 1 HOUR AS w FROM ev)
SELECT epoch_us(date_trunc('day', timestamp)) AS start_us, event_type, count(*) AS n FROM ev, m WHERE date_trunc('day', timestamp) + INTERVAL 1 DAY <= w GROUP BY ALL""")
def h16_stream_windows(spark, sf_dir):
    """Daily counts of the windows that are closed; what comes a fortnight late behind the restart is not counted."""
    root = scratch(spark, "windows")
    e = log(spark, sf_dir).select("job_id", "event_id", "event_type", "timestamp")
    first, second = halves(e)
    late = first.where(F.col("timestamp") < F.to_timestamp(F.lit("2024-01-14")))
    ran([first, second.unionByName(late)], lambda stream: streaming.windowed_stream(stream).writeStream.format("parquet").option("path", root))
    return spark.read.parquet(root).select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")


@query(f"WITH {LOG}, f AS (SELECT job_id, min(event_id) FILTER (WHERE event_type IN ('complete', 'error')) AS e FROM ev GROUP BY job_id) SELECT job_id, event_id, event_type FROM ev JOIN f USING (job_id) WHERE e IS NULL OR event_id <= e")
def h1_h5_stream_numbered(spark, sf_dir):
    """Numbers from keyed state over a restart in the middle of the month, none behind a terminal event."""
    root = scratch(spark, "numbered")
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("source_id"), "event_type", F.col("ts").cast("timestamp").alias("timestamp"))
    ran(halves(e), lambda stream: streaming.numbered_stream(stream).where("kind = 'event'").writeStream.format("parquet").option("path", root), timers=True)
    return spark.read.parquet(root).select("job_id", "event_id", "event_type")


@query(f"WITH {LOG} SELECT job_id, source_id, event_id FROM ev")
def h1_numbered_in_ranges(spark, sf_dir):
    """Numbering in which no task holds a job: ranges of events, counted and offset."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("source_id"), F.col("ts").cast("timestamp").alias("timestamp"))
    return joblog.numbered_in_ranges(e).select("job_id", "source_id", "event_id")
