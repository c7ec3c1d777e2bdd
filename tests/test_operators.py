"""Operators on small frames with values worked out by hand or by a plain loop."""

import random
import struct
import zlib

import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import TimerValues

from attestra.functions import geometry, scores
from attestra.operators import alignment, contracts, evaluation, harmonise, joblog, raster, regions, text, validation
from attestra.sources import files
from attestra.streaming import joblog as streaming

REGION_COLUMNS = ["x0", "y0", "x1", "y1", "changed_pixels", "mean_delta", "max_delta", "edge_changed_pixels", "evidence_sources", "text_changes"]


def test_score_scale(spark):
    df = spark.createDataFrame([(0.0, 0, 100, False), (100.0, 100, 100, True), (10.0, 5, 1_000, False)], "mean double, changed long, area long, told boolean")
    risk = scores.finding_risk(F.col("mean"), F.col("changed"), F.col("area"), F.lit(1_000_000), F.col("told"))
    assert [r[0] for r in df.select(risk).collect()] == [32.1, 89.1, 36.0]
    labels = spark.createDataFrame([(x,) for x in (0.0, 24.9, 25.0, 50.0, 75.0, None)], "s double").select(scores.risk_label(F.col("s")), scores.severity(F.col("s"))).collect()
    assert [r[0] and r[0].split()[0] for r in labels] == ["Low", "Low", "Moderate", "High", "Critical", None]
    assert [r[1] for r in labels] == ["info", "low", "low", "medium", "high", None]


def plain_merge(rows, width, height):
    """The greedy single pass, as a loop."""
    wide, high, out = max(14, round(width * 0.012)), max(8, round(height * 0.007)), []
    for s in sorted(rows, key=lambda r: (r[1], r[0])):
        for d in out:
            gx, gy = max(0, s[0] - d[2], d[0] - s[2]), max(0, s[1] - d[3], d[1] - s[3])
            oy, ox = min(s[3], d[3]) - max(s[1], d[1]), min(s[2], d[2]) - max(s[0], d[0])
            if (oy > 0 and gx <= wide) or (ox > 0 and gy <= high) or (gx <= 5 and gy <= 5):
                n = d[4] + s[4]
                d[5] = (d[5] * d[4] + s[5] * s[4]) / n if n else d[5]
                d[0], d[1], d[2], d[3], d[4] = min(d[0], s[0]), min(d[1], s[1]), max(d[2], s[2]), max(d[3], s[3]), n
                break
        else:
            out.append(list(s))
    return out


def test_region_merge_by_loop(spark):
    rng = random.Random(7)
    pages = []
    for page in range(40):
        boxes = []
        for _ in range(rng.randint(0, 12)):
            x, y = rng.randint(0, 900), rng.randint(0, 900)
            boxes.append((x, y, x + rng.randint(5, 90), y + rng.randint(5, 40), rng.randint(0, 50), float(rng.randint(0, 90))))
        pages.append((page, boxes))
    schema = "page long, rs array<struct<x0:int,y0:int,x1:int,y1:int,n:int,m:double>>"
    df = spark.createDataFrame(pages, schema)
    full = F.transform("rs", lambda r: F.struct(r.x0, r.y0, r.x1, r.y1, r.n, r.m, F.lit(0), F.lit(0), F.array(F.lit("visual_difference")), F.array()).cast(regions.REGION))
    out = df.select("page", regions.merge_nearby(full, F.lit(1000), F.lit(1000)).alias("m")).collect()
    for row in out:
        want = plain_merge(pages[row.page][1], 1000, 1000)
        assert [[r.x0, r.y0, r.x1, r.y1, r.changed_pixels] for r in row.m] == [w[:5] for w in want]
        assert all(abs(r.mean_delta - w[5]) < 1e-9 for r, w in zip(row.m, want, strict=True))


def region(x0, y0, x1, y1, n=0, text_no=None):
    told = [(text_no, "a", "b")] if text_no else []
    return (x0, y0, x1, y1, n, 10.0, 5, 0, ["embedded_text_change" if text_no else "visual_difference"], told)


def test_text_joins_the_first_overlapping_region(spark):
    df = spark.createDataFrame([(1, [region(0, 0, 10, 10, 4), region(300, 300, 310, 310, 9)], [region(25, 0, 30, 10, text_no=1), region(600, 600, 620, 620, text_no=2), region(305, 330, 306, 331, text_no=3)])], f"id long, a array<{regions.REGION}>, t array<{regions.REGION}>")
    out = df.select(regions.attach_text(F.col("a"), F.col("t")).alias("r")).first().r
    assert [[c.hunk_no for c in r.text_changes] for r in out] == [[1], [3], [2]]
    assert out[0].x1 == 30 and out[1].changed_pixels == 9


def test_ranking_and_remeasuring(spark):
    rows = [(1, i, *region(i * 100, 0, i * 100 + 10, 10, i, 1 if i == 2 else None)) for i in range(10)]
    df = spark.createDataFrame(rows, "pair_id long, region_no int, x0 int, y0 int, x1 int, y1 int, changed_pixels long, mean_delta double, max_delta int, edge_changed_pixels long, evidence_sources array<string>, text_changes array<struct<hunk_no:int,before:string,after:string>>")
    assert [r.region_no for r in regions.ranked(df, keys=["pair_id"]).orderBy("rank").collect()] == [2, 9, 8, 7, 6, 5, 4, 3]
    cells = spark.createDataFrame([(1, 900 + k, 1, 40, 255) for k in range(10)] + [(1, 910, 1, 99, 0)], "pair_id long, x int, y int, raw int, edge int")
    again = {r.region_no: r for r in regions.remeasure(df.select("pair_id", "region_no", F.struct(*REGION_COLUMNS).alias("r")), cells).collect()}
    assert (again[9].changed_pixels, again[9].mean_delta, again[9].max_delta, again[9].edge_changed_pixels) == (10, 40.0, 40, 10)
    assert again[3].changed_pixels == 3 and again[3].mean_delta == 10.0


def aligned(spark, r, c):
    words = [(1, s, i, w) for s, t in (("r", r), ("c", c)) for i, w in enumerate(t.split())]
    df = spark.createDataFrame(words, "pair_id long, side string, pos int, text string").withColumn("token", text.token(F.col("text")))
    return df, text.token_align(df)


def test_alignment_of_words(spark):
    words, matched = aligned(spark, "the cat sat on the mat today", "the dog sat on the big mat today")
    gaps = text.hunks(words, matched)
    got = sorted((r.kind, r.r0, r.r1, r.c0, r.c1) for r in gaps.collect())
    assert got == [("insert", 5, 5, 5, 6), ("replace", 1, 2, 1, 2)]
    assert got == sorted((r.kind, r.r0, r.r1, r.c0, r.c1) for r in text.difflib_changes(words).collect())


def test_matches_are_equal_and_do_not_cross(spark):
    rng = random.Random(3)
    r = [rng.choice("abcdefghijklmnop") + str(rng.randint(0, 9)) for _ in range(120)]
    c = r[:20] + r[50:80] + ["new"] + r[20:50] + r[80:]
    words, matched = aligned(spark, " ".join(r), " ".join(c))
    pairs = sorted((m.rp, m.cp) for m in matched.collect())
    assert pairs and all(r[a] == c[b] for a, b in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


def test_tokens_and_normal_text(spark):
    df = spark.createDataFrame([("Café-Bar!",), ("Straße ",), ("...",)], "t string")
    assert [r[0] for r in df.select(text.token(F.col("t"))).collect()] == ["cafébar", "strasse", ""]
    spaced = spark.createDataFrame([("  A  B\n",)], "t string").select(text.normalized_text(F.col("t"))).first()[0]
    assert spaced == "a b"


def png(width, height, pixels):
    raw = b"".join(b"\0" + bytes(v for x in range(width) for v in pixels(x, y)) for y in range(height))
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 2, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_images_and_files(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(png(3, 2, lambda x, y: (255, 0, 10 * x)))
    (tmp_path / "b.png").write_bytes(b"\x89PNG\r\n\x1a\nbroken")
    images = files.scan_page_images(spark, str(tmp_path))
    assert sorted(r.image.height for r in images.collect()) == [-1, 2]
    cells = raster.image_cells(images.select(F.lit(1).cast("long").alias("pair_id"), F.lit("c").alias("role"), "image")).collect()
    assert len(cells) == 6 and {(c.b, c.g, c.r) for c in cells} == {(0, 0, 255), (10, 0, 255), (20, 0, 255)}
    found = files.scan_files(spark, str(tmp_path), "*.png").select(F.lit("reference").alias("role"), F.element_at(F.split("path", "/"), -1).alias("filename"), F.lit("image/png").alias("content_type"), "content")
    sizes = images.select(F.element_at(F.split("image.origin", "/"), -1).alias("filename"), F.col("image.width").alias("width"), F.col("image.height").alias("height"))
    checked = validation.validate_files(found.join(sizes, "filename"))
    assert {r.filename: r.error and r.error.code for r in checked.collect()} == {"a.png": None, "b.png": "corrupt_image"}


@pytest.mark.parametrize(
    ("name", "kind", "body", "pages", "code"),
    [
        ("document.txt", "text/plain", b"x", 1, "unsupported_file_type"),
        ("a.pdf", "image/png", b"%PDF-1.7", 1, "mime_type_mismatch"),
        ("a.pdf", "application/pdf", b"", 1, "empty_file"),
        ("a.pdf", "application/pdf", b"junk", 1, "content_type_mismatch"),
        ("a.pdf", "application/pdf", b"%PDF-1.7", 2, "single_page_required"),
        ("a.jpg", "image/jpeg", b"\xff\xd8\xff" + b"0" * 200, 1, "file_too_large"),
        ("A B.PDF", "application/pdf; x=y", b"%PDF-1.7", 1, None),
    ],
)
def test_first_failing_rule(spark, name, kind, body, pages, code):
    df = spark.createDataFrame([("reference", name, kind, bytearray(body), pages)], "role string, filename string, content_type string, content binary, page_count int")
    row = validation.validate_files(df, max_bytes=100).first()
    assert (row.error and row.error.code) == code
    if not code:
        assert row.filename == "A_B.pdf" and row.kind == "pdf"


def test_log_properties(spark):
    events = spark.createDataFrame([(j, k, "error" if k == 9 else "progress") for j in (1, 2) for k in range(12)], "job_id long, source_id long, event_type string").withColumn("timestamp", F.timestamp_seconds(F.col("source_id") * 5))
    log = joblog.numbered(events)
    assert joblog.replay(log.where("job_id = 1"), 7).count() == 12 - 7
    assert joblog.until_terminal(log).groupBy("job_id").count().collect()[0]["count"] == 10
    jobs = spark.createDataFrame([(1, "running", None), (2, "completed", None)], "job_id long, state string, error_code string")
    once, new = joblog.recover(jobs, log, "2024-01-01")
    assert [(r.job_id, r.event_id) for r in new.collect()] == [(1, 13)]
    assert joblog.recover(once, log, "2024-01-01")[1].count() == 0
    assert {(r.contiguous, r.in_order) for r in joblog.conforming(joblog.with_stage(log)).collect()} == {(True, True)}


def test_pairs_without_long_lines(spark):
    """Short lines, one altered word in a line, exact copies of short texts; a 3-gram that all share joins nothing."""
    line = "the total to be paid by the tenant on the first day of each month is nine hundred and forty euro without costs"
    texts = ["a b c\nd e f\ng h i", "a b c\nd e f\ng h i", "a b c\nd e f\ng h x", line, line.replace("forty", "sixty"), "the first day here", "", "", "one", None, *[f"all of us {i} here {i}" for i in range(60)]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = {r.candidate_id: r.reference_id for r in text.pair_near_copies(docs).collect()}
    assert pairs == {1: 0, 2: 0, 4: 3, 7: 6, 9: 6}


def test_large_job_in_chunks(spark):
    """No text or array holds all events of a job."""
    log = spark.range(1, 1_001).select(F.when(F.col("id") % 7 == 0, 2).otherwise(1).cast("long").alias("job_id"), F.col("id").alias("event_id"), F.lit("progress").alias("event_type"))
    streams = joblog.streams(joblog.format_records(log), 100)
    assert streams.select(F.max(F.size(F.split("stream", "\n\n")) - 1)).first()[0] <= 100
    back = joblog.parse_records(streams).select(F.get_json_object("data", "$.job_id").cast("long").alias("job_id"), "event_id", "event_type")
    assert back.count() == 1_000 and back.exceptAll(log).count() == 0
    firsts = streams.where("job_id = 1").orderBy("chunk").first().stream.split("\n\n")[:2]
    assert [r.split("\n")[0] for r in firsts] == ["id: 1", "id: 2"]


def test_conforming_holds_stages_only(spark):
    rng = random.Random(5)
    rows = [(j, k, rng.choice((1, 2, 3)) if j < 30 else min(k, 3)) for j in range(40) for k in range(1, 9) if (j, k) != (35, 4)]
    out = joblog.conforming(spark.createDataFrame(rows, "job_id long, event_id long, stage_no int"))
    for r in out.collect():
        mine = [s for j, _, s in rows if j == r.job_id]
        assert r.contiguous == (r.job_id != 35) and r.in_order == (list(dict.fromkeys(mine)) == sorted(set(mine)))
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate [job_id" in plan.split("collect_list")[1] and ", stage_no" in plan.split("Aggregate [job_id")[2].split("]")[0]


def test_streams(spark, tmp_path):
    src = str(tmp_path / "in")
    rows = [(j, k, "complete" if k == 4 else "progress", k) for j in (1, 2) for k in range(7)]
    df = spark.createDataFrame(rows, "job_id long, source_id long, event_type string, s long").select("job_id", "source_id", "event_type", F.timestamp_seconds(F.col("s") + 1_700_000_000).alias("timestamp"), F.col("source_id").alias("event_id"))
    df.unionByName(df).write.parquet(src)
    stream = lambda: spark.readStream.schema(df.schema).parquet(src)

    def run(out, name, mode="append", timers=False):
        writer = out.writeStream.format("memory").queryName(name).outputMode(mode)
        if timers:
            streaming.run_to_end(writer, spark)
        else:
            assert writer.trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    distinct = run(streaming.deduplicated_stream(stream()), "distinct_events")
    assert len(distinct) == 14
    counted = run(streaming.numbered_stream(stream().select("job_id", "source_id", "event_type", "timestamp")), "numbered_events", timers=True)
    for job in (1, 2):
        own = [r.event_id for r in counted if r.job_id == job and r.kind == "event"]
        assert own == list(range(1, len(own) + 1)) and [r.event_type for r in counted if r.job_id == job][-1] in ("complete", None)
    assert run(streaming.windowed_stream(stream(), "1 day"), "windowed_events", "complete")[0].n > 0

    sessions = run(streaming.sessions_stream(stream(), "2 seconds"), "session_events", "complete")
    assert {(r.job_id, r.events) for r in sessions} == {(1, 14), (2, 14)}
    assert all((r.end - r.start).total_seconds() == 8 for r in sessions)


def test_current_jobs_of_a_stream(spark, tmp_path):
    """A batch rewrites the buckets it touches, older versions go, a batch that runs again changes nothing."""
    path = str(tmp_path / "jobs")
    assert streaming.read_jobs(spark, path) is None
    write = streaming.upsert_jobs(path)
    batch = spark.createDataFrame([(k, 1, "running") for k in range(300)], "job_id long, seq long, state string")
    write(batch, 0)
    second = spark.createDataFrame([(1, 2, None), (999, 1, "queued"), (1, 1, "late")], batch.schema)
    for _ in range(2):
        write(second, 1)
        got = {r.job_id: (r.seq, r.state) for r in streaming.read_jobs(spark, path).collect()}
        assert got == {**{k: (1, "running") for k in range(300)}, 1: (2, None), 999: (1, "queued")}
    versions = [v.name for b in (tmp_path / "jobs").glob("bucket=*") for v in b.glob("version=*")]
    assert versions.count("version=1") <= 2 and len(versions) == 64 + versions.count("version=1")
    write(second.limit(0), 2)
    assert streaming.read_jobs(spark, path).count() == 301
    write(batch, 3)
    versions = [v.name for b in (tmp_path / "jobs").glob("bucket=*") for v in b.glob("version=*")]
    assert versions.count("version=3") == 64 and len(versions) == 128


class Value:
    def __init__(self):
        self.held = None

    def exists(self):
        return self.held is not None

    def get(self):
        return self.held

    def update(self, held):
        self.held = held

    def clear(self):
        self.held = None


class Handle:
    """State and timers of one key."""

    def __init__(self):
        self.timers, self.lives = [], {}

    def getValueState(self, name, schema, ttl=None):  # noqa: N802
        self.lives[name] = ttl
        return Value()

    def registerTimer(self, due):  # noqa: N802
        self.timers.append(due)

    def deleteTimer(self, due):  # noqa: N802
        self.timers.remove(due)

    def listTimers(self):  # noqa: N802
        return iter(self.timers)


def test_numbering_and_keep_alive():
    frame = lambda *kinds: pd.DataFrame({"job_id": 7, "source_id": range(len(kinds)), "event_type": kinds, "timestamp": pd.Timestamp("2024-01-01")})
    handle, job, at = Handle(), streaming.Numbering(10_000, 1_000_000), TimerValues
    job.init(handle)
    assert handle.lives == {"last": None, "ended": 1_000_000}
    rows = lambda now, *frames: [(i, k) for f in job.handleInputRows((7,), iter(frames), at(now)) for i, k in zip(f["event_id"], f["event_type"], strict=True)]
    assert [i for i, _ in rows(0, frame("progress", "progress"), frame("progress"))] == [1, 2, 3] and handle.timers == [10_000]
    assert [i for i, _ in rows(5_000, frame("progress"))] == [4] and handle.timers == [15_000]
    handle.timers.clear()  # as Spark does with a timer that is due
    alive = list(job.handleExpiredTimer((7,), at(15_500), None))
    assert [(r["job_id"][0], r["event_id"][0], r["kind"][0]) for r in alive] == [(7, 4, "keep_alive")] and handle.timers == [25_500]
    assert rows(26_000, frame("progress", "complete", "progress"), frame("progress")) == [(5, "progress"), (6, "complete")], "numbers go on behind silence"
    assert not handle.timers and not job.last.exists() and job.ended.get() == (True,)
    assert rows(27_000, frame("progress")) == [] and not handle.timers and not list(job.handleExpiredTimer((7,), at(28_000), None))


def test_numbers_over_a_restart(spark, tmp_path):
    """A stream that stops and goes on from its checkpoint numbers on from its state; an ended job stays ended."""
    rows = lambda *each: spark.createDataFrame([(j, s, k) for j, s, k in each], "job_id long, source_id long, event_type string").withColumn("timestamp", F.timestamp_seconds(F.col("source_id") + 1_700_000_000))
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows((1, 1, "progress"), (1, 2, "progress"), (2, 1, "complete")), rows((1, 3, "progress"), (1, 4, "error"), (2, 2, "progress"), (3, 1, "progress"))):
        part.write.mode("append").parquet(source)
        stream = streaming.numbered_stream(spark.readStream.schema(part.schema).parquet(source), idle_seconds=3_600)
        streaming.run_to_end(stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")), spark)
    got = sorted((r.job_id, r.event_id, r.event_type) for r in spark.read.parquet(out).collect())
    assert got == [(1, 1, "progress"), (1, 2, "progress"), (1, 3, "progress"), (1, 4, "error"), (2, 1, "complete"), (3, 1, "progress")]


def test_log_files(spark, tmp_path):
    events = spark.createDataFrame([(1, 1, "progress", "s", 5)], "job_id long, event_id long, event_type string, stage_id string, progress int").withColumn("timestamp", F.to_timestamp(F.lit("2024-01-02")))
    path = str(tmp_path / "log")
    files.append_events(events, path)
    files.append_events(events.withColumn("event_id", F.lit(2).cast("long")), path)
    assert sorted(r.event_id for r in files.read_events(spark, path).collect()) == [1, 2]
    assert files.stream_events(spark, path).isStreaming


def test_results_as_json(spark, tmp_path):
    """Nested results written one object a line and read back; the JSON column says the same."""
    rows = [(1, 93.6, [(1, [("finding-001", 80.5)])]), (2, 0.0, [(1, [])])]
    docs = spark.createDataFrame(rows, "pair_id long, overall_tampering_risk double, pages array<struct<page_number:int,findings:array<struct<finding_id:string,risk_score:double>>>>")
    files.write_results(docs, str(tmp_path / "out"))
    back = spark.read.schema(docs.schema).json(str(tmp_path / "out"))
    assert back.exceptAll(docs).count() == 0 and back.count() == 2
    texts = files.results_json(docs).select("pair_id", F.from_json("payload", docs.schema).alias("p")).select("p.*")
    assert texts.exceptAll(docs).count() == 0 and texts.count() == 2


def test_manifest_and_binding(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"fixture": "f", "alterations": [{"field": "R", "before": "A", "after": "B", "expected_category": "c",\n "normalized_bbox": {"x": 0.1, "y": 0.2, "width": 0.3, "height": 0.4}}], "thresholds": {"clean_max_risk": 15}}')
    row = files.scan_expected(spark, str(tmp_path / "m.json")).first()
    assert (row.field, row.category, row.width, row.thresholds.clean_max_risk) == ("R", "c", 0.3, 15)
    pairs = spark.createDataFrame([(1, 10, 11, "exact"), (2, 10, 99, "exact")], "pair_id long, reference_id long, candidate_id long, comparison_mode string")
    pairs.write.parquet(str(tmp_path / "pairs"))
    bound = files.bind_pairs(files.scan_pairs(spark, str(tmp_path / "pairs")), spark.createDataFrame([(10, "r"), (11, "c")], "file_id long, name string"))
    assert {r.pair_id: (r.reference and r.reference.name, r.candidate and r.candidate.name) for r in bound.collect()} == {1: ("r", "c"), 2: ("r", None)}


def test_homography_paths(spark):
    shift = [1.0, 0.0, 0.3, 0.0, 1.0, 0.2, 0.0, 0.0, 1.0]
    big = [1.0, 0.0, 30.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]
    rows = [(1, True, None, None, None, None, None), (2, False, shift, 40, 36, 0.9, 0.5), (3, False, big, 40, 36, 0.9, 0.5), (4, False, big, 9, 8, 0.9, 0.5), (5, False, None, None, None, None, None), (6, False, [0.0] * 9, 40, 36, 0.9, 0.5)]
    df = spark.createDataFrame(rows, "pair_id long, identical boolean, m array<double>, match_count long, inliers long, inlier_ratio double, error double").withColumns({"rw": F.lit(400), "rh": F.lit(300), "cw": F.lit(400), "ch": F.lit(300)})
    got = {r.pair_id: (r.method, round(r.quality, 4)) for r in alignment.align(df).collect()}
    quality = round(0.30 + 0.36 + 0.06 + 0.15 * (1 - 0.5 / 8), 4)
    assert got == {1: (alignment.IDENTICAL, 1.0), 2: (alignment.SNAPPED, quality), 3: (alignment.HOMOGRAPHY, quality), 4: (alignment.BY_SIZE, 0.65), 5: (alignment.BY_SIZE, 0.65), 6: (alignment.BY_SIZE, 0.65)}


def test_components_of_a_ring(spark):
    ring = [(1, x, y) for x in range(9) for y in range(9) if x in (0, 8) or y in (0, 8)]
    df = spark.createDataFrame([*ring, (1, 4, 4), (2, 0, 0), (2, 1, 1), (2, 3, 3)], "pair_id long, x int, y int")
    out = raster.components(df).groupBy("pair_id", "label").count().collect()
    assert sorted((r.pair_id, r["count"]) for r in out) == [(1, 1), (1, 32), (2, 1), (2, 2)]


def test_boxes(spark):
    box = geometry.normalized_box(F.lit(0), F.lit(90), F.lit(200), F.lit(100), F.lit(100), F.lit(100))
    row = spark.range(1).select(box.alias("b"), geometry.iou(tuple(map(F.lit, (0.0, 0.0, 0.0, 0.0))), tuple(map(F.lit, (0.0, 0.0, 0.0, 0.0)))).alias("i")).first()
    assert row.b.asDict() == {"x": 0.0, "y": 0.9, "width": 1.0, "height": 0.1} and row.i == 0.0


def test_payload_traps(spark):
    p = ['{"risk_score": 1, "findings": "no", "pages": []}', "[1]", "not json", None, '{"metrics": {"risk_score": 0.4}, "findings": [{"page": 2, "risk": "70"}], "pages": [{"page": 2}, {"page": 3}]}']
    df = spark.createDataFrame(list(enumerate(p)), "i int, payload string")
    out = {r.i: r for r in harmonise.harmonise_results(df, "payload").collect()}
    assert [out[i].overall_tampering_risk for i in range(5)] == [100.0, 0.0, 0.0, 0.0, 40.0]
    assert [len(out[i].pages) for i in range(5)] == [1, 1, 1, 1, 2]
    assert [f.risk_score for f in out[4].pages[0].findings] == [70.0] and out[4].pages[1].findings == []
    texts = spark.createDataFrame([("null",), ("true",), ("3",), ("2.5",), ('"s"',)], "j string").select(harmonise.measurement_text(F.try_parse_json("j")))
    assert [r[0] for r in texts.collect()] == ["Not available", "Yes", "3", "2.500", "s"]


def test_contract_helpers(spark):
    df = spark.createDataFrame([("a" * 64, 50, None)], "h string, p int, s double")
    rules = [contracts.sha256_rule("h"), contracts.progress_rule("p"), contracts.score_rule("s"), contracts.unit_rule("p")]
    assert df.select(contracts.violations(*rules)).first()[0] == ["s_out_of_range", "p_out_of_range"]
    assert contracts.schema_drift(df, df.drop("s").schema.json()) == ["s"]
    runs = spark.createDataFrame([(1, 1.0)], "a int, b double")
    assert evaluation.differences_between(runs, runs).count() == 0


def test_ratio_matches_by_brute_force(spark):
    """Noisy copies of descriptors, unlike ones, pages with one keypoint, and a page whose keypoints share most of their bits."""
    rng = random.Random(11)
    signed = lambda v: v - (1 << 64) if v >= 1 << 63 else v
    flipped = lambda d, n, of=64: [x ^ sum(1 << b for b in {rng.randrange(of) for _ in range(n)}) for x in d]
    reference, candidate = [], []
    for page in range(4):
        for k in range(1 if page == 2 else 90):
            d = [rng.getrandbits(64 if page != 3 else 9) for _ in range(4)]
            reference.append((page, k, *map(signed, d)))
            if k % 9:
                candidate.append((page, k + 500, *map(signed, flipped(d, rng.choice([0, 1, 2, 3, 4, 12]), 64 if page != 3 else 9))))
            if k % 7 == 0:
                candidate.append((page, k + 900, *map(signed, flipped(d, 3, 64 if page != 3 else 9))))
    schema = "pair_id long, kp_id int, d0 long, d1 long, d2 long, d3 long"
    got = alignment.ratio_matches(spark.createDataFrame(reference, schema), spark.createDataFrame(candidate, schema)).collect()
    want = set()
    for p, k, *d in reference:
        near = sorted((sum(((a ^ b) & ((1 << 64) - 1)).bit_count() for a, b in zip(d, e, strict=True)), c) for q, c, *e in candidate if q == p)
        if len(near) > 1 and near[0][0] < 0.76 * near[1][0]:
            want.add((p, k, near[0][1], near[0][0]))
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 100
    met, crowded = alignment.band_candidates(spark.createDataFrame(reference, schema), spark.createDataFrame(candidate, schema))
    assert met.where("pair_id < 2").count() < 2_000 and {r.pair_id for r in crowded.collect()} == {3}


def test_exact_similarity(spark):
    """The exact ratio is the library's on whole normalized texts, and the bag ratio is never below it."""
    from difflib import SequenceMatcher

    texts = ["The rent is 940 euro.", "The rent is 960  euro!", "something else", "", None, "ab" * 150, "ba" * 150]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    pairs = spark.createDataFrame([(k, a, b) for k, (a, b) in enumerate((a, b) for a in range(7) for b in range(7))], "pair_id long, reference_id long, candidate_id long")
    exact = {r.pair_id: r.similarity for r in text.matched_similarity(pairs, docs).collect()}
    bag = {r.pair_id: r.similarity for r in text.similarity(pairs, docs).collect()}
    plain = [" ".join((t or "").lower().split()) for t in texts]
    for k, (a, b) in enumerate((a, b) for a in range(7) for b in range(7)):
        if not plain[a] and not plain[b]:
            assert exact[k] is None and bag[k] is None
        else:
            assert exact[k] == SequenceMatcher(None, plain[a], plain[b]).ratio() and bag[k] >= exact[k] - 1e-6
