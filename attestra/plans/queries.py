"""Queries over the given tables for every group of operators, with the SQL that must agree."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import geometry, scores
from attestra.operators import alignment, contracts, evaluation, harmonise, joblog, raster, regions, text, validation
from attestra.plans import verification
from attestra.sources import files as sources
from attestra.sources.tables import written

SIDE = 8


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# Words and pairs, as SQL.
PAIRS = r"""
k AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pf AS (SELECT t, min(doc_id) AS doc_id FROM k GROUP BY t),
pw AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[ \x09-\x0D]+'), lambda x: x <> '') AS ws FROM pf),
pg AS (SELECT DISTINCT doc_id, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM pw)),
pn AS (SELECT doc_id, count(*) AS n FROM pg GROUP BY doc_id),
pd AS (SELECT *, count(*) OVER (PARTITION BY g) AS df, min(doc_id) OVER (PARTITION BY g) AS hub FROM pg),
pm AS (SELECT x.doc_id AS a, y.doc_id AS b FROM pd x JOIN pd y ON x.g = y.g AND x.doc_id < y.doc_id WHERE x.df <= 30 UNION SELECT hub, doc_id FROM pd WHERE df > 30 AND hub <> doc_id),
po AS (SELECT a, b, count(*) AS c FROM pm JOIN pd x ON x.doc_id = a JOIN pd y ON y.doc_id = b AND y.g = x.g GROUP BY ALL),
pj AS (SELECT b, max(struct_pack(j := CAST(c AS DOUBLE) / (nx.n + ny.n - c), r := -a)) AS m FROM po JOIN pn nx ON nx.doc_id = a JOIN pn ny ON ny.doc_id = b WHERE 10 * c > 3 * (nx.n + ny.n - c) GROUP BY b),
bp AS (SELECT b AS candidate_id, -m.r AS reference_id FROM pj UNION ALL SELECT k.doc_id, pf.doc_id FROM k JOIN pf USING (t) WHERE k.doc_id <> pf.doc_id),
pairs AS (SELECT candidate_id AS pair_id, reference_id, candidate_id, c.t = r.t AS identical, trim(c.t) <> '' AND trim(r.t) <> '' AS has_text FROM bp JOIN k c ON c.doc_id = candidate_id JOIN k r ON r.doc_id = reference_id)
"""
# All pairs: texts meet over every 3-gram, however many have it.
ALL_PAIRS = r"""
k AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
pf AS (SELECT t, min(doc_id) AS doc_id FROM k GROUP BY t),
pw AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[ \x09-\x0D]+'), lambda x: x <> '') AS ws FROM pf),
pg AS (SELECT DISTINCT doc_id, ws[i:i + 2] AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 1)) AS i FROM pw)),
pn AS (SELECT doc_id, count(*) AS n FROM pg GROUP BY doc_id),
po AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM pg x JOIN pg y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
pj AS (SELECT b, max(struct_pack(j := CAST(c AS DOUBLE) / (nx.n + ny.n - c), r := -a)) AS m FROM po JOIN pn nx ON nx.doc_id = a JOIN pn ny ON ny.doc_id = b WHERE 10 * c > 3 * (nx.n + ny.n - c) GROUP BY b),
bp AS (SELECT b AS candidate_id, -m.r AS reference_id FROM pj UNION ALL SELECT k.doc_id, pf.doc_id FROM k JOIN pf USING (t) WHERE k.doc_id <> pf.doc_id),
pairs AS (SELECT candidate_id AS pair_id, reference_id, candidate_id, c.t = r.t AS identical, trim(c.t) <> '' AND trim(r.t) <> '' AS has_text FROM bp JOIN k c ON c.doc_id = candidate_id JOIN k r ON r.doc_id = reference_id)
"""
WORDS = r"""
sides AS (SELECT pair_id, 'r' AS side, reference_id AS doc_id FROM pairs WHERE NOT identical UNION ALL SELECT pair_id, 'c', candidate_id FROM pairs WHERE NOT identical),
w0 AS (SELECT doc_id, list_filter(regexp_split_to_array(t, '[ \t\n\x0B\f\r]+'), lambda w: w <> '') AS ws FROM k),
w1 AS (SELECT doc_id, unnest(ws) AS text, generate_subscripts(ws, 1) - 1 AS pos FROM w0),
words AS (SELECT s.pair_id, s.side, w.pos, w.text, replace(lower(regexp_replace(w.text, '[^\p{L}\p{N}\p{M}\p{Pc}]+', '', 'g')), 'ß', 'ss') AS token, CAST(pos // 720 + 1 AS INT) AS page_number,
  (pos % 12) / 12.0::DOUBLE AS x0, (pos // 12 % 60) / 60.0::DOUBLE AS y0, (pos % 12 + 1) / 12.0::DOUBLE AS x1, (pos // 12 % 60 + 1) / 60.0::DOUBLE AS y1 FROM sides s JOIN w1 w USING (doc_id))
"""
# Alignment by recursion: a row is an open token (kind 0) or a match (kind 1, pos and cp); a step does all gaps that are open.
MATCHED = r"""
al(kind, pair_id, gap, side, pos, token, cp) AS (
  (SELECT 0, pair_id, 0::BIGINT, side, pos, token, NULL::BIGINT FROM words QUALIFY min(side) OVER (PARTITION BY pair_id) <> max(side) OVER (PARTITION BY pair_id))
  UNION ALL
  (WITH o AS (SELECT pair_id, gap, side, pos, token, row_number() OVER w AS k, count(*) OVER (PARTITION BY pair_id, gap, side) AS n FROM al WHERE kind = 0 WINDOW w AS (PARTITION BY pair_id, gap, side ORDER BY pos)),
  oj AS (SELECT *, n - k + 1 AS j FROM o),
  hd AS (SELECT * FROM (SELECT r.pair_id, r.gap, r.k, r.pos AS rp, c.pos AS cp, bool_and(r.token = c.token) OVER (PARTITION BY r.pair_id, r.gap ORDER BY r.k) AS eq FROM oj r JOIN oj c ON c.pair_id = r.pair_id AND c.gap = r.gap AND c.k = r.k WHERE r.side = 'r' AND c.side = 'c') WHERE eq),
  hl AS (SELECT pair_id, gap, max(k) AS lead FROM hd GROUP BY pair_id, gap),
  ft AS (SELECT t.pair_id, t.gap, rp, cp FROM (SELECT r.pair_id, r.gap, r.j, r.pos AS rp, c.pos AS cp, least(r.n, c.n) AS m, bool_and(r.token = c.token) OVER (PARTITION BY r.pair_id, r.gap ORDER BY r.j) AS eq FROM oj r JOIN oj c ON c.pair_id = r.pair_id AND c.gap = r.gap AND c.j = r.j WHERE r.side = 'r' AND c.side = 'c') t
    LEFT JOIN hl ON hl.pair_id = t.pair_id AND hl.gap = t.gap WHERE eq AND m - j >= coalesce(lead, 0)),
  fx AS (SELECT pair_id, gap, rp, cp FROM hd UNION ALL SELECT pair_id, gap, rp, cp FROM ft),
  fe AS (SELECT pair_id, 'r' AS side, rp AS pos FROM fx UNION ALL SELECT pair_id, 'c', cp FROM fx),
  rs AS (SELECT oj.pair_id, gap, oj.side, oj.pos, token FROM oj ANTI JOIN fe ON fe.pair_id = oj.pair_id AND fe.side = oj.side AND fe.pos = oj.pos),
  nx AS (SELECT *, lead(token) OVER (PARTITION BY pair_id, gap, side ORDER BY pos) AS next, row_number() OVER (PARTITION BY pair_id, gap, side, token ORDER BY pos) AS nth FROM rs),
  gm AS (SELECT pair_id, gap, side, pos, 1 AS size, 0 AS nth, token AS g FROM nx UNION ALL SELECT pair_id, gap, side, pos, 2, 0, token || chr(3) || next FROM nx WHERE next IS NOT NULL UNION ALL SELECT pair_id, gap, side, pos, 1, nth, token FROM nx),
  oc AS (SELECT pair_id, gap, size, nth, max(pos) FILTER (WHERE side = 'r') AS rp, max(pos) FILTER (WHERE side = 'c') AS cp FROM gm GROUP BY pair_id, gap, size, nth, g HAVING count(*) FILTER (WHERE side = 'r') = 1 AND count(*) FILTER (WHERE side = 'c') = 1),
  lv AS (SELECT * FROM oc QUALIFY least(nth, 1) = min(least(nth, 1)) OVER (PARTITION BY pair_id, gap)),
  an AS (SELECT DISTINCT pair_id, gap, rp, cp FROM (SELECT pair_id, gap, rp, cp FROM lv UNION ALL SELECT pair_id, gap, rp + 1, cp + 1 FROM lv WHERE size = 2)),
  un AS (SELECT * FROM an QUALIFY count(*) OVER (PARTITION BY pair_id, gap, rp) = 1 AND count(*) OVER (PARTITION BY pair_id, gap, cp) = 1
    AND coalesce(cp > max(cp) OVER (PARTITION BY pair_id, gap ORDER BY rp RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AND coalesce(cp < min(cp) OVER (PARTITION BY pair_id, gap ORDER BY rp RANGE BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), true)),
  rn AS (SELECT *, rp - row_number() OVER (PARTITION BY pair_id, gap, rp - cp ORDER BY rp) AS i FROM an),
  rl AS (SELECT pair_id, gap, rp - cp AS d, i, count(*) AS n, min(rp) AS start FROM rn GROUP BY ALL),
  rb AS (SELECT pair_id, gap, d, i FROM rl QUALIFY row_number() OVER (PARTITION BY pair_id, gap ORDER BY n DESC, start, start - d) = 1),
  fd AS (SELECT pair_id, gap, rp, cp FROM fx UNION SELECT pair_id, gap, rp, cp FROM un UNION SELECT rn.pair_id, rn.gap, rp, cp FROM rn JOIN rb ON rb.pair_id = rn.pair_id AND rb.gap = rn.gap AND rb.d = rn.rp - rn.cp AND rb.i = rn.i),
  en AS (SELECT pair_id, 'r' AS side, rp AS pos, rp AS ap FROM fd UNION ALL SELECT pair_id, 'c', cp, rp FROM fd),
  mk AS (SELECT o.pair_id, o.gap, o.side, o.pos, o.token, ap, count(ap) OVER (PARTITION BY o.pair_id, o.gap) AS hits, coalesce(last_value(ap + 1 IGNORE NULLS) OVER (PARTITION BY o.pair_id, o.gap, o.side ORDER BY o.pos ROWS UNBOUNDED PRECEDING), o.gap) AS new FROM o LEFT JOIN en ON en.pair_id = o.pair_id AND en.side = o.side AND en.pos = o.pos),
  op AS (SELECT pair_id, new, side, pos, token FROM (SELECT * FROM mk WHERE hits > 0 AND ap IS NULL) QUALIFY min(side) OVER (PARTITION BY pair_id, gap, new) <> max(side) OVER (PARTITION BY pair_id, gap, new))
  SELECT 1, pair_id, gap, 'm', rp, NULL, cp FROM fd UNION ALL SELECT 0, pair_id, new, side, pos, token, NULL FROM op)),
matched AS (SELECT pair_id, pos AS rp, cp FROM al WHERE kind = 1),
nn AS (SELECT pair_id, count(*) FILTER (WHERE side = 'r') AS n_r, count(*) FILTER (WHERE side = 'c') AS n_c FROM words GROUP BY pair_id)
"""
HUNKS = r"""
e0 AS (SELECT pair_id, rp, cp FROM matched UNION ALL SELECT pair_id, n_r, n_c FROM nn),
h0 AS (SELECT pair_id, coalesce(lag(rp) OVER o, -1) + 1 AS r0, rp AS r1, coalesce(lag(cp) OVER o, -1) + 1 AS c0, cp AS c1 FROM e0 WINDOW o AS (PARTITION BY pair_id ORDER BY rp, cp)),
hunks AS (SELECT *, row_number() OVER (PARTITION BY pair_id ORDER BY r0, c0) AS hunk_no, CASE WHEN r0 = r1 THEN 'insert' WHEN c0 = c1 THEN 'delete' ELSE 'replace' END AS kind FROM h0 WHERE r0 < r1 OR c0 < c1)
"""
CHANGES = r"""
hx AS (SELECT h.*, w.side, w.pos, w.text, w.page_number AS page, w.x0, w.y0, w.x1, w.y1, min(w.page_number) FILTER (WHERE w.side = 'c') OVER (PARTITION BY h.pair_id, h.hunk_no) AS first FROM hunks h JOIN words w ON w.pair_id = h.pair_id
  AND ((w.side = 'r' AND w.pos >= r0 AND w.pos < r1) OR (w.side = 'c' AND w.pos >= c0 AND w.pos < c1))),
hp AS (SELECT hx.*, CASE WHEN hx.side = 'c' THEN page ELSE coalesce(first, page) END AS part, f.page_number AS front FROM hx LEFT JOIN words f ON f.pair_id = hx.pair_id AND f.side = 'c' AND f.pos = greatest(c0 - 1, 0)),
changes AS (SELECT pair_id, hunk_no, kind, CASE WHEN first IS NULL THEN coalesce(front, 1) ELSE part END AS page_number, part, coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE side = 'r'), '(missing)') AS before,
  coalesce(string_agg(text, ' ' ORDER BY pos) FILTER (WHERE side = 'c'), '(removed)') AS after,
  coalesce(min(x0) FILTER (WHERE side = 'c'), min(x0)) AS x0, coalesce(min(y0) FILTER (WHERE side = 'c'), min(y0)) AS y0,
  coalesce(max(x1) FILTER (WHERE side = 'c'), max(x1)) AS x1, coalesce(max(y1) FILTER (WHERE side = 'c'), max(y1)) AS y1 FROM hp GROUP BY pair_id, hunk_no, kind, CASE WHEN first IS NULL THEN coalesce(front, 1) ELSE part END, part)
"""


@query(f"WITH {ALL_PAIRS} SELECT pair_id, reference_id, candidate_id, identical, has_text FROM pairs")
def a4_bound_pairs(spark, sf_dir):
    return verification.text_pairs(spark, sf_dir)[0]


@query(f"WITH {ALL_PAIRS} SELECT pair_id, reference_id, candidate_id FROM pairs")
def a4_near_copy_pairs(spark, sf_dir):
    """Pairs as planned: exact copies and word 3-grams alike."""
    return text.pair_near_copies(table(spark, sf_dir, "documents").select("doc_id", "text"))


@query(f"WITH {PAIRS}, {WORDS} SELECT pair_id, side, page_number, count(*) AS n, count(DISTINCT token) AS n_tokens, CAST(sum(length(token)) AS BIGINT) AS token_chars, CAST(round(sum(x0), 3) AS DOUBLE) AS sx, CAST(round(sum(y1), 3) AS DOUBLE) AS sy FROM words GROUP BY pair_id, side, page_number")
def a3_e2_words(spark, sf_dir):
    words = verification.changed_words(*verification.text_pairs(spark, sf_dir))
    return words.groupBy("pair_id", "side", "page_number").agg(
        F.count("*").alias("n"), F.countDistinct("token").alias("n_tokens"), F.sum(F.length("token")).alias("token_chars"), F.round(F.sum("x0"), 3).alias("sx"), F.round(F.sum("y1"), 3).alias("sy")
    )


@query(f"WITH RECURSIVE {PAIRS}, {WORDS}, {MATCHED} SELECT pair_id, CAST(rp AS INT) AS rp, CAST(cp AS INT) AS cp FROM matched")
def e6_token_align(spark, sf_dir):
    return text.lines_align(verification.changed_texts(spark, sf_dir)[1])


@query(f"""WITH RECURSIVE {PAIRS}, {WORDS}, {MATCHED}, v AS (SELECT m.pair_id, r.page_number AS r_page, c.page_number, count(*) AS n FROM matched m JOIN words r ON r.pair_id = m.pair_id AND r.side = 'r' AND r.pos = m.rp JOIN words c ON c.pair_id = m.pair_id AND c.side = 'c' AND c.pos = m.cp GROUP BY ALL)
SELECT pair_id, r_page, page_number FROM v QUALIFY row_number() OVER (PARTITION BY pair_id, r_page ORDER BY n DESC, page_number) = 1 AND row_number() OVER (PARTITION BY pair_id, page_number ORDER BY n DESC, r_page) = 1""")
def a3_page_matches(spark, sf_dir):
    """Which reference page each candidate page is held against."""
    words = verification.changed_words(*verification.text_pairs(spark, sf_dir))
    points = verification.matched_points(words, text.token_align(words), verification.PAGE_WIDTH, verification.PAGE_HEIGHT)
    return verification.page_matches(points)


@query(f"WITH RECURSIVE {PAIRS}, {WORDS}, {MATCHED}, {HUNKS}, {CHANGES} SELECT * REPLACE (CAST(hunk_no AS INT) AS hunk_no) FROM changes")
def e7_e9_text_changes(spark, sf_dir):
    texts, lines = verification.changed_texts(spark, sf_dir)
    gaps = written(text.hunks(lines.select("pair_id", "n_r", "n_c"), text.lines_align(lines)), "gaps")
    return text.text_changes(text.words_from_text(texts, "pair_id", "side"), gaps)


@query(f'WITH RECURSIVE {PAIRS}, {WORDS}, {MATCHED}, {HUNKS} SELECT pair_id, count(*) FILTER (WHERE kind = \'delete\') AS "delete", count(*) FILTER (WHERE kind = \'insert\') AS "insert", count(*) FILTER (WHERE kind = \'replace\') AS "replace" FROM hunks GROUP BY pair_id')
def e10_opcode_counts(spark, sf_dir):
    lines = verification.changed_texts(spark, sf_dir)[1]
    return text.opcode_counts(text.hunks(lines.select("pair_id", "n_r", "n_c"), text.lines_align(lines)))


NORMAL = r"trim(regexp_replace(replace(lower(t), 'ß', 'ss'), '[\s\x0B\x85\x{00A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+', ' ', 'g'))"


@query(rf"""WITH {PAIRS}, s AS (SELECT pair_id, 'r' AS side, reference_id AS doc_id FROM pairs UNION ALL SELECT pair_id, 'c', candidate_id FROM pairs),
c AS (SELECT s.pair_id, side, unnest(string_split({NORMAL}, '')) AS ch FROM s JOIN k USING (doc_id)),
n AS (SELECT pair_id, ch, count(*) FILTER (WHERE side = 'r') AS r, count(*) FILTER (WHERE side = 'c') AS c FROM c WHERE ch <> '' GROUP BY pair_id, ch),
z AS (SELECT pair_id, sum(least(r, c)) AS s, sum(r) AS r, sum(c) AS c FROM n GROUP BY pair_id)
SELECT pair_id, CASE WHEN z.r + z.c > 0 THEN round(CAST(2.0 * s AS DOUBLE) / (z.r + z.c), 6) END AS similarity, CAST(coalesce(z.r, 0) AS BIGINT) AS reference_characters, CAST(coalesce(z.c, 0) AS BIGINT) AS candidate_characters FROM pairs LEFT JOIN z USING (pair_id)""")
def e4_e5_e11_similarity(spark, sf_dir):
    pairs, docs = verification.text_pairs(spark, sf_dir)
    return text.similarity(pairs, docs)


@query("""SELECT doc_id, CASE lang WHEN 'en' THEN CASE WHEN length(trim(coalesce(text, ''))) > 0 THEN 'pymupdf_embedded_text' ELSE 'no_embedded_text' END
 WHEN 'fr' THEN 'unavailable_for_raster' ELSE 'unavailable' END AS text_source FROM documents""")
def e1_text_source(spark, sf_dir):
    """Language stands for the kind of file here: en for pdf, fr for image."""
    kind = F.when(F.col("lang") == "en", "pdf").when(F.col("lang") == "fr", "image")
    return table(spark, sf_dir, "documents").select("doc_id", text.text_source(kind, F.col("text")).alias("text_source"))


BOXES = """
b AS (SELECT pair_id, hunk_no, page_number, part, greatest(0, CAST(round(x0 * 1272) AS INT) - 10) AS x0, greatest(0, CAST(round(y0 * 1800) AS INT) - 9) AS y0,
  least(1272, CAST(round(x1 * 1272) AS INT) + 10) AS x1, least(1800, CAST(round(y1 * 1800) AS INT) + 9) AS y1 FROM changes),
risk AS (SELECT *, round(least(greatest(32.0 + 11.0 * least(1.0, (x1 - x0) * (y1 - y0) / 2289600.0::DOUBLE / 0.008) + 15.0, 1.0), 99.0), 1) AS risk_score,
  round(least(greatest(50.0 + 35.0 * 0.65 + 7.0, 1.0), 99.0), 1) AS confidence_score FROM b)
"""


@query(f"""WITH RECURSIVE {PAIRS}, {WORDS}, {MATCHED}, {HUNKS}, {CHANGES}, {BOXES}
SELECT pair_id, CAST(hunk_no AS INT) AS hunk_no, page_number, part, x0, y0, x1, y1, CAST(risk_score AS DOUBLE) AS risk_score, CAST(confidence_score AS DOUBLE) AS confidence_score,
 CASE WHEN risk_score >= 85 THEN 'critical' WHEN risk_score >= 65 THEN 'high' WHEN risk_score >= 40 THEN 'medium' WHEN risk_score >= 15 THEN 'low' ELSE 'info' END AS severity,
 round(x0 / 1272.0::DOUBLE, 6) AS bx, round(y0 / 1800.0::DOUBLE, 6) AS by_,
 greatest(least(round((x1 - x0) / 1272.0::DOUBLE, 6), round(1.0 - round(x0 / 1272.0::DOUBLE, 6), 6)), 0.000001) AS bw,
 greatest(least(round((y1 - y0) / 1800.0::DOUBLE, 6), round(1.0 - round(y0 / 1800.0::DOUBLE, 6), 6)), 0.000001) AS bh FROM risk""")
def c3_c4_g1_g5_hunk_scores(spark, sf_dir):
    """Every text change scored as a region of its own, before any merge."""
    w, h = F.lit(verification.PAGE_WIDTH), F.lit(verification.PAGE_HEIGHT)
    changes = e7_e9_text_changes(spark, sf_dir)
    boxed = changes.select("pair_id", "hunk_no", "page_number", "part", geometry.padded_pixel_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), w, h).alias("b")).select("pair_id", "hunk_no", "page_number", "part", "b.*")
    area = (F.col("x1") - F.col("x0")) * (F.col("y1") - F.col("y0"))
    zero, yes = F.lit(0), F.lit(True)
    scored = boxed.withColumns({"risk_score": scores.finding_risk(F.lit(0.0), zero, area, w * h, yes), "confidence_score": scores.finding_confidence(F.lit(0.65), zero, area, yes)})
    box = geometry.normalized_box(F.col("x0"), F.col("y0"), F.col("x1"), F.col("y1"), w, h)
    return scored.withColumn("severity", scores.severity(F.col("risk_score"))).withColumns({"bx": box.x, "by_": box.y, "bw": box.width, "bh": box.height})


@query()
def f12_f17_regions(spark, sf_dir):
    """Text and visual regions of every pair, merged, measured again and ranked."""
    return verification.verify(spark, sf_dir)[1].select("pair_id", "page_number", "finding_id", "risk_score", "confidence_score", "severity", "category", "bounding_box.*")


@query()
def g10_documents(spark, sf_dir):
    """Nested results as JSON."""
    return sources.results_json(verification.verify(spark, sf_dir)[0])


@query()
def g3_g6_flagship(spark, sf_dir):
    return verification.flagship(spark, sf_dir)


@query()
def g3_g6_near_copies(spark, sf_dir):
    """The flagship from text alone: no page is drawn."""
    return verification.flagship(spark, sf_dir, visual=False)


@query()
def g12_rollup(spark, sf_dir):
    """Findings and pairs by label, severity and category."""
    return regions.rolled_up(*verification.verify(spark, sf_dir))


@query()
def j7_summary(spark, sf_dir):
    return evaluation.summary(verification.verify(spark, sf_dir)[0])


# Files: pages stand for uploads; the page number deals out names, types and heads.
FILES = """
f0 AS (SELECT page_id, coalesce(html, '') AS h, page_id % 7 AS k FROM pages),
f AS (SELECT page_id, 'candidate' AS role,
  CASE k WHEN 0 THEN 'C:\\scan dir\\Page ' || page_id || '.PDF' WHEN 1 THEN 'a/b/..page_' || page_id || '_.png' WHEN 2 THEN 'x.txt' WHEN 3 THEN NULL WHEN 4 THEN 'é.jpeg' WHEN 5 THEN 'ok.pdf' ELSE 'noext' END AS filename,
  CASE k WHEN 0 THEN ' Application/PDF ; charset=x' WHEN 1 THEN 'image/png' WHEN 4 THEN 'image/png' WHEN 5 THEN 'application/x-pdf' ELSE NULL END AS content_type,
  encode(CASE WHEN page_id % 11 = 3 THEN '' WHEN page_id % 2 = 0 THEN '%PDF-1.7' || h ELSE h END) AS content FROM f0)
"""


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").withColumn("k", F.col("page_id") % 7).withColumn("h", F.coalesce("html", F.lit("")))
    number = F.col("page_id").cast("string")
    names = {0: F.concat(F.lit("C:\\scan dir\\Page "), number, F.lit(".PDF")), 1: F.concat(F.lit("a/b/..page_"), number, F.lit("_.png")), 2: F.lit("x.txt"), 4: F.lit("é.jpeg"), 5: F.lit("ok.pdf"), 6: F.lit("noext")}
    types = {0: " Application/PDF ; charset=x", 1: "image/png", 4: "image/png", 5: "application/x-pdf"}
    name, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in names.items():
        name = F.when(F.col("k") == i, c).otherwise(name)
    for i, c in types.items():
        kind = F.when(F.col("k") == i, c).otherwise(kind)
    body = F.when(F.col("page_id") % 11 == 3, "").when(F.col("page_id") % 2 == 0, F.concat(F.lit("%PDF-1.7"), "h")).otherwise(F.col("h"))
    return pages.select("page_id", F.lit("candidate").alias("role"), name.alias("filename"), kind.alias("content_type"), F.encode(body, "UTF-8").alias("content"))


VALIDATED = FILES + r"""
, n AS (SELECT *, string_split(replace(coalesce(nullif(filename, ''), role || '.bin'), '\', '/'), '/')[-1] AS raw FROM f),
n2 AS (SELECT *, regexp_extract(raw, '^.+(\.[^.]+)$', 1) AS suffix FROM n),
n3 AS (SELECT *, regexp_replace(raw[1:length(raw) - length(suffix)], '[^A-Za-z0-9._-]+', '_', 'g') AS st FROM n2),
n4 AS (SELECT *, CASE WHEN trim(st, '._') = '' THEN role ELSE trim(st, '._') END AS safe FROM n3),
n5 AS (SELECT *, safe[1:80] || lower(suffix) AS name, lower(suffix) AS ext, lower(trim(string_split(coalesce(content_type, ''), ';')[1])) AS declared, octet_length(content) AS size FROM n4),
v AS (SELECT page_id, name AS filename, ext AS extension, sha256(content) AS sha256, CASE WHEN size = 0 THEN 'empty_file' WHEN size > 4000 THEN 'file_too_large'
  WHEN ext NOT IN ('.pdf', '.png', '.jpg', '.jpeg') THEN 'unsupported_file_type'
  WHEN NOT ((ext = '.pdf' AND declared IN ('application/pdf', 'application/x-pdf')) OR (ext = '.png' AND declared = 'image/png') OR (ext IN ('.jpg', '.jpeg') AND declared IN ('image/jpeg', 'image/jpg'))) THEN 'mime_type_mismatch'
  WHEN NOT (ext = '.pdf' AND decode(content)[1:5] = '%PDF-') THEN 'content_type_mismatch' END AS code,
  CASE WHEN ext = '.pdf' THEN 'pdf' WHEN ext IN ('.png', '.jpg', '.jpeg') THEN 'image' END AS kind,
  CASE WHEN ext = '.pdf' THEN 'application/pdf' WHEN ext = '.png' THEN 'image/png' WHEN ext IN ('.jpg', '.jpeg') THEN 'image/jpeg' END AS content_type FROM n5)
"""


def _validated(spark, sf_dir):
    return validation.validate_files(uploads(spark, sf_dir), max_bytes=4000)


@query(f"WITH {VALIDATED} SELECT * FROM v")
def b1_b10_validate(spark, sf_dir):
    return _validated(spark, sf_dir).select("page_id", "filename", "extension", "sha256", F.col("error.code").alias("code"), "kind", "content_type")


@query(r"""WITH f AS (SELECT page_id, page_id % 4 AS k, page_id % 11 AS m, coalesce(html, '') AS h FROM pages),
g AS (SELECT *, CASE WHEN m = 7 THEN '00' WHEN k = 0 THEN '89504E470D0A1A0A' WHEN k = 3 THEN '255044462D' ELSE 'FFD8FF' END AS head, CASE WHEN m = 2 THEN 2 ELSE 1 END AS page_count,
  CASE m WHEN 4 THEN -1 WHEN 5 THEN 0 WHEN 6 THEN 8000 ELSE 800 END AS width, CASE m WHEN 6 THEN 8000 ELSE 600 END AS height FROM f)
SELECT page_id, CASE WHEN m = 7 THEN 'content_type_mismatch' WHEN page_count > 1 THEN 'single_page_required' WHEN k <> 3 AND width < 0 THEN 'corrupt_image'
  WHEN k <> 3 AND (width = 0 OR height <= 0 OR CAST(width AS BIGINT) * height > 40000000) THEN 'invalid_image_dimensions' END AS code, sha256(unhex(head) || encode(h)) AS sha256,
  CASE WHEN k = 3 THEN 'pdf' ELSE 'image' END AS kind FROM g""")
def b6_b8_images(spark, sf_dir):
    """Pages as image and document files with signatures, sizes and page counts."""
    f = table(spark, sf_dir, "pages").withColumns({"k": F.col("page_id") % 4, "m": F.col("page_id") % 11})
    of_k = lambda values: F.get(F.array(*map(F.lit, values)), F.col("k").cast("int"))
    head = F.unhex(F.when(F.col("m") == 7, "00").otherwise(of_k(("89504E470D0A1A0A", "FFD8FF", "FFD8FF", "255044462D"))))
    size = lambda rest, **odd: F.when(F.col("m") == 4, odd.get("a", rest)).when(F.col("m") == 5, odd.get("b", rest)).when(F.col("m") == 6, 8000).otherwise(rest)
    files = f.select(
        "page_id", F.lit("reference").alias("role"), of_k(("a.png", "b.jpg", "c.jpeg", "d.pdf")).alias("filename"), of_k(("image/png", "image/jpeg", "image/jpg", "application/pdf")).alias("content_type"),
        F.concat(head, F.encode(F.coalesce("html", F.lit("")), "UTF-8")).alias("content"), F.when(F.col("m") == 2, 2).otherwise(1).alias("page_count"), size(800, a=-1, b=0).alias("width"), size(600).alias("height"),
    )
    return validation.validate_files(files).select("page_id", F.col("error.code").alias("code"), "sha256", "kind")


@query(f"WITH {VALIDATED} SELECT code, CASE WHEN code IS NULL THEN 0 WHEN code = 'file_too_large' THEN 413 ELSE 422 END AS status, count(*) AS n FROM v GROUP BY ALL")
def b14_routed(spark, sf_dir):
    good, bad = validation.routed(_validated(spark, sf_dir))
    both = good.select(F.lit(None).cast("string").alias("code"), F.lit(0).alias("status")).unionByName(bad.select("error.code", "status"))
    return both.groupBy("code", "status").agg(F.count("*").alias("n"))


@query(f"WITH {FILES} SELECT page_id AS pair_id, role FROM f WHERE page_id % 5 = 0 AND octet_length(content) > 0")
def b11_integrity(spark, sf_dir):
    """Every fifth stored file has lost its first byte."""
    files = uploads(spark, sf_dir).withColumnRenamed("page_id", "pair_id")
    stored = files.withColumn("content", F.when(F.col("pair_id") % 5 == 0, F.expr("substring(content, 2)")).otherwise(F.col("content")))
    return validation.integrity_failures(files, stored)


@query("""SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE 'unsupported_comparison_mode' END AS code,
 regexp_full_match(CAST(user_id AS VARCHAR) || CASE WHEN event_type = 'view' THEN 'z' ELSE '-a' END, '[0-9a-f-]+') AS job_ok, regexp_full_match(event_type || CASE WHEN user_id % 2 = 0 THEN '.png' ELSE '_1' END, '[A-Za-z0-9_-]{1,80}') AS asset_ok FROM events""")
def b12_b13_modes_and_ids(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    mode = F.when(F.col("event_type") == "click", "exact").otherwise(F.col("event_type"))
    job = F.concat(F.col("user_id").cast("string"), F.when(F.col("event_type") == "view", "z").otherwise("-a"))
    asset = F.concat("event_type", F.when(F.col("user_id") % 2 == 0, ".png").otherwise("_1"))
    return e.select("event_id", validation.mode_error(mode).code.alias("code"), validation.valid_job_id(job).alias("job_ok"), validation.valid_asset_id(asset).alias("asset_ok"))


@query(f"WITH {PAIRS} SELECT pair_id, CASE WHEN identical THEN 'completed' ELSE 'failed' END AS state, CASE WHEN NOT identical THEN 'analysis_failed' END AS error_code FROM pairs")
def b15_guarded(spark, sf_dir):
    """As if only identical pairs had results."""
    pairs = verification.text_pairs(spark, sf_dir)[0]
    return validation.guarded_jobs(pairs, pairs.where("identical"))


# Page sizes from parts: width and height in points.
@query("""WITH s AS (SELECT p_partkey, 100 + p_size * 37 AS w, 200 + p_partkey % 977 AS h, CASE WHEN p_partkey % 3 = 0 THEN 'pdf' ELSE 'image' END AS kind, p_partkey % 9 AS exif FROM part),
d AS (SELECT *, CASE exif WHEN 3 THEN 180 WHEN 6 THEN 90 WHEN 8 THEN 270 ELSE 0 END AS deg FROM s),
o AS (SELECT *, CASE WHEN deg IN (90, 270) THEN h ELSE w END AS ow, CASE WHEN deg IN (90, 270) THEN w ELSE h END AS oh FROM d),
z AS (SELECT *, CASE WHEN kind = 'pdf' THEN 900.0::DOUBLE / greatest(ow, oh) ELSE least(1.0, 900.0::DOUBLE / greatest(ow, oh)) END AS scale FROM o)
SELECT p_partkey, w AS original_width, CAST(h AS INT) AS original_height, CAST(greatest(1, round(ow * scale)) AS INT) AS normalized_width, CAST(greatest(1, round(oh * scale)) AS INT) AS normalized_height,
 CAST(greatest(1, round(ow * scale)) AS INT) / ow::DOUBLE AS scale_x, CAST(greatest(1, round(oh * scale)) AS INT) / oh::DOUBLE AS scale_y, deg AS orientation_degrees FROM z""")
def c1_c2_transform(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    kind = F.when(F.col("p_partkey") % 3 == 0, "pdf").otherwise("image")
    t = geometry.page_transform(100 + F.col("p_size") * 37, (200 + F.col("p_partkey") % 977).cast("int"), kind, 900, F.col("p_partkey") % 9)
    return p.select("p_partkey", t.alias("t")).select("p_partkey", "t.*")


@query("""WITH s AS (SELECT p_partkey, p_retailprice / 1000 - 0.5 AS a, p_size * 7 AS v, p_partkey % 10 AS x, p_partkey % 7 AS y, CASE p_partkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 90 WHEN 2 THEN 180 ELSE 270 END AS deg FROM part)
SELECT p_partkey, least(greatest(a, 0.0), 1.0) AS unit, CAST(least(greatest(v, 0), 255) AS INT) AS byte, CAST(floor(0.114 * x * 20 + 0.587 * y * 30 + 0.299 * (v % 256) + 0.5) AS INT) AS gray,
 CASE deg WHEN 90 THEN 7 - 1 - y WHEN 180 THEN 10 - 1 - x WHEN 270 THEN y ELSE x END AS tx, CASE deg WHEN 90 THEN x WHEN 180 THEN 7 - 1 - y WHEN 270 THEN 10 - 1 - x ELSE y END AS ty FROM s""")
def c5_c8_cells(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    x, y, v = F.col("p_partkey") % 10, F.col("p_partkey") % 7, F.col("p_size") * 7
    deg = (F.col("p_partkey") % 4) * 90
    t = geometry.turned_cell(x, y, F.lit(10), F.lit(7), deg)
    return p.select("p_partkey", geometry.unit(F.col("p_retailprice") / 1000 - 0.5).alias("unit"), geometry.byte_value(v).alias("byte"), geometry.gray(x * 20, y * 30, v % 256).alias("gray"), t.x.alias("tx"), t.y.alias("ty"))


# Scores over line items: quantities, discounts and prices stand for measures.
@query("""WITH l AS (SELECT l_orderkey, l_linenumber, l_quantity * 2 AS mean_delta, CAST(l_quantity * 10 AS BIGINT) AS changed, CAST(round(l_extendedprice / 10) AS BIGINT) + 1 AS area, l_tax > 0.04 AS has_text, 1 - l_discount AS q FROM lineitem)
SELECT l_orderkey, l_linenumber, count(*) AS n, CAST(sum(round(least(greatest(32.0 + 24.0 * least(1.0, mean_delta / 100.0) + 18.0 * least(1.0, changed / area::DOUBLE * 2.5) + 11.0 * least(1.0, area / 2289600.0::DOUBLE / 0.008) + CASE WHEN has_text THEN 15.0 ELSE 0.0 END, 1.0), 99.0)::DOUBLE, 1)) AS DOUBLE) AS risk,
 CAST(sum(round(least(greatest(50.0 + 35.0 * q + 8.0 * least(1.0, changed / area::DOUBLE * 3.0) + CASE WHEN has_text THEN 7.0 ELSE 0.0 END, 1.0), 99.0)::DOUBLE, 1)) AS DOUBLE) AS confidence FROM l GROUP BY ALL""")
def g1_g2_scores(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    changed, area, told = (F.col("l_quantity") * 10).cast("long"), (F.round(F.col("l_extendedprice") / 10)).cast("long") + 1, F.col("l_tax") > 0.04
    risk = scores.finding_risk(F.col("l_quantity") * 2, changed, area, F.lit(2289600), told)
    sure = scores.finding_confidence(1 - F.col("l_discount"), changed, area, told)
    return li.groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.sum(risk).alias("risk"), F.sum(sure).alias("confidence"))


@query("""WITH f AS (SELECT o_custkey, max(o_totalprice / 6000) AS m, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey),
r AS (SELECT c_custkey, CAST(round(CAST(CASE WHEN n IS NULL THEN least(20.0, abs(c_acctbal) / 1e6 * 1500.0) ELSE least(100.0, least(m, 99.0) + least(6.0, (n - 1) * 1.5)) END::DOUBLE AS DECIMAL(18, 9)), 1) AS DOUBLE) AS risk, coalesce(n, 0) AS n FROM customer LEFT JOIN f ON c_custkey = o_custkey)
SELECT c_custkey, risk, n, CASE WHEN risk < 25 THEN 'Low tampering risk' WHEN risk < 50 THEN 'Moderate tampering risk' WHEN risk < 75 THEN 'High tampering risk' ELSE 'Critical tampering risk' END AS label,
 CASE WHEN risk >= 85 THEN 'critical' WHEN risk >= 65 THEN 'high' WHEN risk >= 40 THEN 'medium' WHEN risk >= 15 THEN 'low' ELSE 'info' END AS severity,
 CASE WHEN c_custkey % 2 = 0 THEN 100.0 ELSE 88.0 END::DOUBLE AS coverage FROM r""")
def g3_g6_overall(spark, sf_dir):
    found = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").groupBy("o_custkey").agg(F.max(F.col("o_totalprice") / 6000).alias("m"), F.count("*").alias("n"))
    c = table(spark, sf_dir, "customer").join(found, F.col("c_custkey") == F.col("o_custkey"), "left")
    risk = scores.overall_risk(F.least("m", F.lit(99.0)), F.col("n"), F.abs("c_acctbal") / 1e6)
    out = c.select("c_custkey", risk.alias("risk"), F.coalesce("n", F.lit(0)).alias("n"))
    return out.withColumns({"label": scores.risk_label(F.col("risk")), "severity": scores.severity(F.col("risk")), "coverage": scores.analysis_coverage(F.col("c_custkey") % 2 == 0)})


@query("""SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(least(99.0, 65.0 + 27.0 * (1 - l_discount * 9) + CASE WHEN l_returnflag = 'R' THEN 7.0 ELSE 0.0 END)::DOUBLE, 1) AS confidence FROM lineitem""")
def g6_confidence(spark, sf_dir):
    """Discounts stand for the quality of an alignment, returned lines for pages with text."""
    li = table(spark, sf_dir, "lineitem")
    sure = scores.assessment_confidence(1 - F.col("l_discount") * 9, F.col("l_returnflag") == "R")
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", sure.alias("confidence"))


# Events as a job log: a user is a job, `error` ends one.
LOG = """
ev AS (SELECT user_id AS job_id, event_id AS source_id, event_type, ts AS timestamp, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS event_id FROM events)
"""
STAGES = "(VALUES " + ", ".join(f"({i}, '{s}', {p})" for i, (s, p) in enumerate(joblog.STAGE_PROGRESS, 1)) + ") AS st(stage_no, stage_id, progress)"


def log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("source_id"), "event_type", F.col("ts").cast("timestamp").alias("timestamp"))
    return joblog.numbered(e)


@query(f"WITH {LOG} SELECT job_id, source_id, event_id, stage_no, stage_id, progress FROM ev JOIN {STAGES} ON stage_no = least(event_id, 10)")
def h1_h2_numbered(spark, sf_dir):
    return joblog.with_stage(log(spark, sf_dir)).select("job_id", "source_id", "event_id", "stage_no", "stage_id", "progress")


@query(f"WITH {LOG}, b AS (SELECT * FROM ev WHERE timestamp < TIMESTAMP '2024-01-16') SELECT job_id, source_id, event_id FROM ev WHERE timestamp >= TIMESTAMP '2024-01-16'")
def h1_appended(spark, sf_dir):
    """The second half of the month numbered behind the first."""
    e = log(spark, sf_dir)
    split = F.col("timestamp") < F.to_timestamp(F.lit("2024-01-16"))
    return joblog.numbered(e.where(~split).drop("event_id"), e.where(split)).select("job_id", "source_id", "event_id")


@query(f"WITH {LOG} SELECT job_id, event_id, event_type FROM ev WHERE event_id > 40")
def h3_replay(spark, sf_dir):
    return joblog.replay(log(spark, sf_dir), 40).select("job_id", "event_id", "event_type")


@query("""SELECT event_id, CASE WHEN a IS NOT NULL AND a >= 0 AND user_id >= 0 THEN greatest(a, user_id) END AS "after", CASE WHEN a IS NULL OR a < 0 THEN 'invalid_event_cursor' END AS error
FROM (SELECT event_id, user_id, CASE event_type WHEN 'click' THEN 7 WHEN 'view' THEN -1 WHEN 'error' THEN NULL WHEN 'signup' THEN 0 ELSE event_id END AS a FROM events)""")
def h3_cursor(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    given = F.when(F.col("event_type") == "click", "7").when(F.col("event_type") == "view", "-1").when(F.col("event_type") == "error", "not-a-number").when(F.col("event_type") == "signup", None).otherwise(F.col("event_id").cast("string"))
    return e.select("event_id", joblog.cursor(given, F.col("user_id").cast("string")).alias("c")).select("event_id", "c.after", "c.error")


@query(f"WITH {LOG} SELECT job_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM ev GROUP BY job_id")
def h4_latest(spark, sf_dir):
    return joblog.latest(log(spark, sf_dir), "event_type")


@query(f"WITH {LOG}, f AS (SELECT job_id, min(event_id) FILTER (WHERE event_type IN ('complete', 'error')) AS e FROM ev GROUP BY job_id) SELECT job_id, event_id, event_type FROM ev JOIN f USING (job_id) WHERE e IS NULL OR event_id <= e")
def h5_until_terminal(spark, sf_dir):
    return joblog.until_terminal(log(spark, sf_dir)).select("job_id", "event_id", "event_type")


JOBS = """
u AS (SELECT job_id, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'running' END AS state,
  CASE WHEN event_type = 'error' THEN 'analysis_failed' END AS error_code, timestamp AS updated_at FROM ev),
jobs AS (SELECT job_id, seq, state, error_code, updated_at FROM u QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY seq DESC) = 1)
"""


def updates(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    state = F.when(kind == "purchase", "completed").when(kind == "error", "failed").when(kind == "signup", "queued").otherwise("running")
    return log(spark, sf_dir).select("job_id", F.col("event_id").alias("seq"), state.alias("state"), F.when(kind == "error", "analysis_failed").alias("error_code"), F.col("timestamp").alias("updated_at"))


@query(f"WITH {LOG}, {JOBS} SELECT job_id, seq, state, error_code FROM jobs")
def h6_current_jobs(spark, sf_dir):
    return joblog.current_jobs(updates(spark, sf_dir)).select("job_id", "seq", "state", "error_code")


@query(f"""WITH {LOG}, v AS (SELECT *, (source_id * 37) % 100 AS progress, CASE WHEN event_type = 'view' THEN 'u' || source_id END AS candidate_page_url FROM ev)
SELECT job_id, event_id, max(progress) OVER o AS shown_progress, last_value(candidate_page_url IGNORE NULLS) OVER o AS shown_url FROM v WINDOW o AS (PARTITION BY job_id ORDER BY event_id ROWS UNBOUNDED PRECEDING)""")
def h7_monotone(spark, sf_dir):
    e = log(spark, sf_dir).withColumns({"progress": F.col("source_id") * 37 % 100, "candidate_page_url": F.when(F.col("event_type") == "view", F.concat(F.lit("u"), F.col("source_id").cast("string")))})
    return joblog.monotone(e).select("job_id", "event_id", "shown_progress", "shown_url")


@query(f"WITH {LOG} SELECT job_id, event_id, min(source_id) AS source_id FROM ev GROUP BY job_id, event_id")
def h8_deduplicated(spark, sf_dir):
    """Every event sent twice, the second time an hour later."""
    e = log(spark, sf_dir)
    again = e.withColumn("timestamp", F.col("timestamp") + F.expr("INTERVAL 1 HOUR"))
    return joblog.deduplicated(e.unionByName(again)).select("job_id", "event_id", "source_id")


@query(f"WITH {LOG}, g AS (SELECT job_id, event_id, epoch_us(timestamp) - epoch_us(lag(timestamp) OVER (PARTITION BY job_id ORDER BY event_id)) AS us FROM ev) SELECT job_id, event_id, us / 1e6 AS gap_seconds FROM g WHERE us > 86400000000")
def h9_idle_gaps(spark, sf_dir):
    return joblog.idle_gaps(log(spark, sf_dir), 86_400).select("job_id", "event_id", "gap_seconds")


@query(f"""WITH {LOG}, g AS (SELECT *, CASE WHEN timestamp - lag(timestamp) OVER (PARTITION BY job_id ORDER BY timestamp, event_id) < INTERVAL 12 HOUR THEN 0 ELSE 1 END AS opens FROM ev),
s AS (SELECT *, sum(opens) OVER (PARTITION BY job_id ORDER BY timestamp, event_id ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT job_id, epoch_us(min(timestamp)) AS start_us, epoch_us(max(timestamp)) + 43200000000 AS end_us, count(*) AS events FROM s GROUP BY job_id, k""")
def h9_activity_spans(spark, sf_dir):
    spans = joblog.activity_spans(log(spark, sf_dir), "12 hours")
    return spans.select("job_id", F.unix_micros("start").alias("start_us"), F.unix_micros("end").alias("end_us"), "events")


@query(f"""WITH {LOG}, {JOBS}, l AS (SELECT job_id, max(event_id) AS last FROM ev GROUP BY job_id)
SELECT job_id, CASE WHEN state IN ('queued', 'running') THEN 'failed' ELSE state END AS state, CASE WHEN state IN ('queued', 'running') THEN 'service_restarted' ELSE error_code END AS error_code,
 CASE WHEN state IN ('queued', 'running') THEN last + 1 END AS new_event_id FROM jobs JOIN l USING (job_id)""")
def h10_recovered(spark, sf_dir):
    jobs, new = joblog.recover(joblog.current_jobs(updates(spark, sf_dir)), log(spark, sf_dir), "2024-02-01")
    return jobs.join(new.select("job_id", F.col("event_id").alias("new_event_id")), "job_id", "left").select("job_id", "state", "error_code", "new_event_id")


@query(f"""WITH {LOG}, {JOBS}, x AS (SELECT job_id FROM jobs WHERE state IN ('completed', 'failed') AND updated_at < TIMESTAMP '2024-01-30 12:00:00' AND job_id % 3 <> 0)
SELECT job_id, count(*) AS n FROM ev WHERE job_id NOT IN (SELECT job_id FROM x) GROUP BY job_id""")
def h11_h12_retention(spark, sf_dir):
    """Events left after ended jobs are swept; the files of every third job are still there."""
    jobs, events = joblog.current_jobs(updates(spark, sf_dir)), log(spark, sf_dir)
    old = joblog.expired(jobs, F.to_timestamp(F.lit("2024-01-30 12:00:00")))
    left, _ = joblog.cascade_delete(old, jobs.where("job_id % 3 <> 0"), events, jobs)
    return left.groupBy("job_id").agg(F.count("*").alias("n"))


ASSETS = "r AS (SELECT job_id, CASE source_id % 3 WHEN 0 THEN 'candidate-page' WHEN 1 THEN 'reference-page' ELSE 'finding-001-overlay' END AS asset_id, 'assets/' || source_id || '.png' AS relative_path, event_id AS seq FROM ev WHERE event_type = 'view' AND job_id % 2 = 0), assets AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY job_id, asset_id ORDER BY seq DESC) = 1)"


def registered(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = log(spark, sf_dir).where("event_type = 'view' AND job_id % 2 = 0")
    k = F.col("source_id") % 3
    name = F.when(k == 0, "candidate-page").when(k == 1, "reference-page").otherwise("finding-001-overlay")
    return e.select("job_id", name.alias("asset_id"), F.concat(F.lit("assets/"), F.col("source_id").cast("string"), F.lit(".png")).alias("relative_path"), F.lit("image/png").alias("media_type"), F.col("event_id").alias("seq"))


@query(f"WITH {LOG}, {ASSETS} SELECT DISTINCT ev.job_id, 'candidate-page' AS asset_id, relative_path FROM ev LEFT JOIN assets a ON a.job_id = ev.job_id AND a.asset_id = 'candidate-page'")
def h13_resolved_assets(spark, sf_dir):
    wanted = log(spark, sf_dir).select("job_id").distinct().withColumn("asset_id", F.lit("candidate-page"))
    return joblog.resolve(wanted, joblog.assets(registered(spark, sf_dir))).select("job_id", "asset_id", "relative_path")


@query(f"WITH {LOG}, {ASSETS}, {JOBS} SELECT job_id, state, CASE WHEN job_id IN (SELECT job_id FROM assets WHERE asset_id = 'candidate-page') THEN '/api/v1/analyses/' || job_id || '/assets/candidate-page' END AS candidate_page_url FROM jobs")
def h14_previews(spark, sf_dir):
    jobs = joblog.current_jobs(updates(spark, sf_dir))
    return joblog.with_preview(jobs, joblog.assets(registered(spark, sf_dir))).select("job_id", "state", "candidate_page_url")


@query(f"""WITH {LOG}, s AS (SELECT job_id, least(event_id, 10) AS stage_no, (epoch_us(lead(timestamp) OVER (PARTITION BY job_id ORDER BY event_id)) - epoch_us(timestamp)) / 1e6 AS seconds FROM ev),
t AS (SELECT job_id, (epoch_us(max(timestamp)) - epoch_us(min(timestamp))) / 1e6 AS total FROM ev GROUP BY job_id)
SELECT job_id, CAST(stage_no AS INT) AS stage_no, round(sum(seconds), 3) AS seconds, any_value(total) AS total FROM s JOIN t USING (job_id) GROUP BY job_id, stage_no""")
def h15_durations(spark, sf_dir):
    e = joblog.with_stage(log(spark, sf_dir))
    each = joblog.stage_durations(e).groupBy("job_id", "stage_no").agg(F.round(F.sum("seconds"), 3).alias("seconds"))
    return each.join(joblog.job_durations(e).select("job_id", F.col("seconds").alias("total")), "job_id")


@query(f"WITH {LOG} SELECT epoch_us(date_trunc('day', timestamp)) AS start_us, event_type, count(*) AS n FROM ev GROUP BY ALL")
def h16_windows(spark, sf_dir):
    return joblog.tumbling_counts(log(spark, sf_dir), "1 day").select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")


@query(f"WITH {LOG} SELECT event_id, event_type, job_id, source_id FROM ev")
def a10_event_records(spark, sf_dir):
    """Events to their text form, a job's as streams of a bounded number of them, and back."""
    e = log(spark, sf_dir).select("job_id", "event_id", "event_type", "source_id")
    back = joblog.parse_records(joblog.streams(joblog.format_records(e)))
    data = F.from_json("data", "job_id long, event_id long, source_id long")
    return back.withColumn("d", data).select("event_id", "event_type", "d.job_id", "d.source_id")


@query(f"WITH {LOG} SELECT job_id, true AS contiguous, true AS in_order FROM ev GROUP BY job_id")
def j5_conforming(spark, sf_dir):
    return joblog.conforming(joblog.with_stage(log(spark, sf_dir)))


@query(f"""WITH {LOG}, b AS (SELECT job_id, event_id, CASE WHEN job_id % 5 = 2 AND event_id <= 2 THEN 3 - event_id ELSE least(event_id, 10) END AS stage_no FROM ev WHERE NOT (job_id % 5 = 1 AND event_id = 3)),
f AS (SELECT job_id, stage_no, min(event_id) AS first FROM b GROUP BY ALL),
o AS (SELECT job_id, bool_and(later) AS in_order FROM (SELECT job_id, stage_no > coalesce(lag(stage_no) OVER (PARTITION BY job_id ORDER BY first), 0) AS later FROM f) GROUP BY job_id)
SELECT b.job_id, max(event_id) = count(*) AND min(event_id) = 1 AS contiguous, any_value(in_order) AS in_order FROM b JOIN o ON o.job_id = b.job_id GROUP BY b.job_id""")
def j5_broken_logs(spark, sf_dir):
    """Every fifth job has lost its third event; in another fifth the first two stages came in the wrong order."""
    e = joblog.with_stage(log(spark, sf_dir))
    job, number = F.col("job_id") % 5, F.col("event_id")
    e = e.where(~((job == 1) & (number == 3)))
    return joblog.conforming(e.withColumn("stage_no", F.when((job == 2) & (number <= 2), 3 - number).otherwise(F.col("stage_no"))))


# Vectors as 8x8 rasters, each against the one before it.
CELLS = r"""
vv AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings),
v2 AS (SELECT vec_id, v, list_min(v) AS lo, CASE WHEN list_max(v) > list_min(v) THEN list_max(v) - list_min(v) ELSE 1.0 END AS span FROM vv),
c0 AS (SELECT vec_id, unnest(range(0, len(v))) AS i, unnest(v) AS x, lo, span FROM v2),
cells AS (SELECT vec_id, i % 8 AS x, i // 8 AS y, CAST(floor(255 * (x - lo) / span + 0.5) AS INT) AS gray FROM c0),
j AS (SELECT r.vec_id AS pair_id, r.x, r.y, r.gray AS gr, c.gray AS gc, abs(r.gray - c.gray) AS raw FROM cells r JOIN cells c ON c.vec_id = r.vec_id + 1 AND c.x = r.x AND c.y = r.y)
"""
BLUR = r"""
b1 AS (SELECT *, coalesce(lag(gr) OVER o, lead(gr) OVER o) + 2 * gr + coalesce(lead(gr) OVER o, lag(gr) OVER o) AS hr, coalesce(lag(gc) OVER o, lead(gc) OVER o) + 2 * gc + coalesce(lead(gc) OVER o, lag(gc) OVER o) AS hc FROM j WINDOW o AS (PARTITION BY pair_id, y ORDER BY x)),
b2 AS (SELECT *, floor((coalesce(lag(hr) OVER o, lead(hr) OVER o) + 2 * hr + coalesce(lead(hr) OVER o, lag(hr) OVER o) + 8) / 16.0) AS br, floor((coalesce(lag(hc) OVER o, lead(hc) OVER o) + 2 * hc + coalesce(lead(hc) OVER o, lag(hc) OVER o) + 8) / 16.0) AS bc FROM b1 WINDOW o AS (PARTITION BY pair_id, x ORDER BY y)),
d AS (SELECT pair_id, x, y, gr, gc, raw, CAST(abs(br - bc) AS INT) AS delta FROM b2)
"""
MASK = """
m0 AS (SELECT pair_id, x, y, raw FROM d WHERE delta >= 60 AND x >= 1 AND x < 7 AND y >= 1 AND y < 7)
"""


def raster_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster.vector_cells(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", SIDE)
    r = cells.withColumnRenamed("vec_id", "pair_id")
    c = cells.select((F.col("vec_id") - 1).alias("pair_id"), "x", "y", "gray")
    return raster.joined_cells(r, c)


def mask_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A threshold and border that suit 8x8 cells."""
    d = raster.blurred_delta(raster_cells(spark, sf_dir)).withColumn("edge_delta", F.lit(0))
    return d.where(raster.changed(delta=60) & raster.inside_border(F.lit(SIDE), F.lit(SIDE), 1)).select("pair_id", "x", "y", "raw", "edge_delta")


@query(f"WITH {CELLS}, {BLUR} SELECT pair_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, raw, delta FROM d")
def f1_f2_deltas(spark, sf_dir):
    return raster.blurred_delta(raster_cells(spark, sf_dir)).select("pair_id", "x", "y", "raw", "delta")


def _sobel(v: str) -> str:
    return f"""
s1{v} AS (SELECT pair_id, x, y, {v} AS v, coalesce(lag({v}) OVER o, lead({v}) OVER o) AS l, coalesce(lead({v}) OVER o, lag({v}) OVER o) AS r FROM j WINDOW o AS (PARTITION BY pair_id, y ORDER BY x)),
s2{v} AS (SELECT *, coalesce(lag(r - l) OVER o, lead(r - l) OVER o) + 2 * (r - l) + coalesce(lead(r - l) OVER o, lag(r - l) OVER o) AS gx,
  coalesce(lead(l + 2 * v + r) OVER o, lag(l + 2 * v + r) OVER o) - coalesce(lag(l + 2 * v + r) OVER o, lead(l + 2 * v + r) OVER o) AS gy FROM s1{v} WINDOW o AS (PARTITION BY pair_id, x ORDER BY y)),
s3{v} AS (SELECT pair_id, x, y, abs(gx) + abs(gy) AS g FROM s2{v}),
s4{v} AS (SELECT *, g >= coalesce(lag(g) OVER h, lead(g) OVER h) AND g >= coalesce(lead(g) OVER h, lag(g) OVER h) OR g >= coalesce(lag(g) OVER w, lead(g) OVER w) AND g >= coalesce(lead(g) OVER w, lag(g) OVER w) AS ridge FROM s3{v}
  WINDOW h AS (PARTITION BY pair_id, y ORDER BY x), w AS (PARTITION BY pair_id, x ORDER BY y)),
s5{v} AS (SELECT pair_id, x, y, CASE WHEN ridge AND g > 150 THEN 2 WHEN ridge AND g > 70 THEN 1 ELSE 0 END AS s FROM s4{v}),
t{v}(pair_id, x, y) AS (SELECT pair_id, x, y FROM s5{v} WHERE s = 2 UNION SELECT b.pair_id, b.x, b.y FROM t{v} a JOIN s5{v} b ON b.pair_id = a.pair_id AND abs(b.x - a.x) <= 1 AND abs(b.y - a.y) <= 1 AND b.s = 1),
e{v} AS (SELECT a.pair_id, a.x, a.y, CASE WHEN t.x IS NOT NULL THEN 255 ELSE 0 END AS e FROM s5{v} a LEFT JOIN t{v} t ON t.pair_id = a.pair_id AND t.x = a.x AND t.y = a.y)"""


@query(f"WITH RECURSIVE {CELLS}, {_sobel('gr')}, {_sobel('gc')} SELECT pair_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, abs(egr.e - egc.e) AS edge_delta FROM egr JOIN egc USING (pair_id, x, y)")
def f3_edge_delta(spark, sf_dir):
    return raster.edge_delta(raster_cells(spark, sf_dir)).select("pair_id", "x", "y", "edge_delta")


@query(f"WITH {CELLS}, {BLUR}, {MASK} SELECT pair_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM m0")
def f4_f5_mask(spark, sf_dir):
    return mask_cells(spark, sf_dir).select("pair_id", "x", "y")


GRID = "grid AS (SELECT a.x, b.y FROM range(0, 8) AS a(x), range(0, 8) AS b(y))"
DILATED = "dl AS (SELECT DISTINCT m0.pair_id, g.x, g.y FROM m0 JOIN grid g ON abs(g.x - m0.x) <= 1 AND abs(g.y - m0.y) <= 1)"


@query(f"WITH {CELLS}, {BLUR}, {MASK}, {GRID}, {DILATED}, n AS (SELECT d1.pair_id, d1.x, d1.y, count(*) AS n FROM dl d1 JOIN dl d2 ON d2.pair_id = d1.pair_id AND abs(d2.x - d1.x) <= 1 AND abs(d2.y - d1.y) <= 1 GROUP BY ALL) SELECT pair_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM n WHERE n = (least(x + 1, 7) - greatest(x - 1, 0) + 1) * (least(y + 1, 7) - greatest(y - 1, 0) + 1)")
def f6_closed(spark, sf_dir):
    return raster.close(mask_cells(spark, sf_dir).select("pair_id", "x", "y"), SIDE, SIDE, 1, 1)


@query(f"WITH {CELLS}, {BLUR}, {MASK}, {GRID}, {DILATED} SELECT pair_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y FROM dl")
def f7_dilated(spark, sf_dir):
    return raster.dilate(mask_cells(spark, sf_dir).select("pair_id", "x", "y"), 1, 1, SIDE, SIDE)


COMPONENTS = """
r(pair_id, x, y, k) AS (SELECT pair_id, x, y, y * 2147483648 + x FROM m0 UNION SELECT m.pair_id, m.x, m.y, r.k FROM r JOIN m0 m ON m.pair_id = r.pair_id AND abs(m.x - r.x) <= 1 AND abs(m.y - r.y) <= 1),
cc AS (SELECT pair_id, x, y, min(k) AS k FROM r GROUP BY ALL),
lb AS (SELECT cc.*, m0.raw, min(y * 2147483648 + x) OVER (PARTITION BY pair_id, k) AS label FROM cc JOIN m0 USING (pair_id, x, y)),
stats AS (SELECT pair_id, CAST(label AS BIGINT) AS label, CAST(min(x) AS INT) AS x0, CAST(min(y) AS INT) AS y0, CAST(max(x) + 1 AS INT) AS x1, CAST(max(y) + 1 AS INT) AS y1, count(*) AS area, avg(raw) AS mean_delta, max(raw) AS max_delta FROM lb GROUP BY pair_id, label)
"""


@query(f"WITH RECURSIVE {CELLS}, {BLUR}, {MASK}, {COMPONENTS} SELECT * FROM stats")
def f8_f9_components(spark, sf_dir):
    mask = written(mask_cells(spark, sf_dir), "mask")
    labelled = raster.components(mask.select("pair_id", "x", "y")).join(mask, ["pair_id", "x", "y"])
    return raster.component_stats(labelled).drop("edge_changed_pixels")


@query(f"WITH RECURSIVE {CELLS}, {BLUR}, {MASK}, {COMPONENTS} SELECT pair_id, label, greatest(0, x0 - 1) AS x0, greatest(0, y0 - 1) AS y0, least(8, x1 + 1) AS x1, least(8, y1 + 1) AS y1, area FROM stats WHERE area >= 4 AND x1 - x0 >= 2 AND y1 - y0 >= 2 AND mean_delta >= 12")
def f10_f11_kept(spark, sf_dir):
    stats = f8_f9_components(spark, sf_dir)
    return raster.padded(stats.where(raster.large_enough(SIDE, SIDE, 4, 2)), SIDE, SIDE, 1).select("pair_id", "label", "x0", "y0", "x1", "y1", "area")


@query(f"WITH {CELLS}, {BLUR}, {MASK} SELECT vec_id AS pair_id, count(m.n) AS has, coalesce(any_value(m.n), 0) / 64.0::DOUBLE AS changed_ratio FROM (SELECT DISTINCT pair_id AS vec_id FROM j) LEFT JOIN (SELECT pair_id, count(*) AS n FROM m0 GROUP BY pair_id) m ON m.pair_id = vec_id GROUP BY vec_id")
def f18_changed_ratio(spark, sf_dir):
    """Every mask cell as a kept component of its own; has: 1 for a page that has any, else 0."""
    pages = raster_cells(spark, sf_dir).select("pair_id", F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height")).distinct()
    return raster.changed_ratio(pages, mask_cells(spark, sf_dir).select("pair_id", F.lit(1).alias("area")))


@query(f"""WITH {CELLS}, {BLUR}, {MASK}, b AS (SELECT pair_id, 1 AS region_no, pair_id % 5 AS x0, pair_id % 3 AS y0, pair_id % 5 + 3 AS x1, 6 AS y1 FROM (SELECT DISTINCT pair_id FROM j) UNION ALL SELECT pair_id, 2, 0, 0, 8, 8 FROM (SELECT DISTINCT pair_id FROM j))
SELECT b.pair_id, region_no, count(m0.x) AS n, CAST(coalesce(sum(raw), 0) AS BIGINT) AS raw, 0::BIGINT AS edges FROM b LEFT JOIN m0 ON m0.pair_id = b.pair_id AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 GROUP BY b.pair_id, region_no""")
def f16_box_sums(spark, sf_dir):
    """Measures of two boxes a page, by four lookups each in its summed-area table."""
    k = F.col("pair_id")
    box = lambda no, *edges: F.struct(F.lit(no).alias("region_no"), *[F.lit(v).cast("int").alias(c) if isinstance(v, int) else v.cast("int").alias(c) for c, v in zip(("x0", "y0", "x1", "y1"), edges, strict=True)])
    pages = raster_cells(spark, sf_dir).select("pair_id").distinct()
    boxes = pages.select("pair_id", F.explode(F.array(box(1, k % 5, k % 3, k % 5 + 3, 6), box(2, 0, 0, SIDE, SIDE))).alias("b")).select("pair_id", "b.*")
    return raster.box_sums(boxes, raster.summed(mask_cells(spark, sf_dir), SIDE, SIDE))


@query(f"WITH {CELLS} SELECT pair_id, count(*) AS cells, CAST(sum(gc) AS BIGINT) AS total FROM j WHERE x >= pair_id % 3 AND x < 6 AND y >= 2 AND y < 7 GROUP BY pair_id")
def f19_crops(spark, sf_dir):
    cells = raster_cells(spark, sf_dir)
    boxes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), F.lit(1).alias("region_no"), (F.col("vec_id") % 3).alias("x0"), F.lit(2).alias("y0"), F.lit(6).alias("x1"), F.lit(7).alias("y1"))
    return raster.crops(cells, boxes).groupBy("pair_id").agg(F.count("*").alias("cells"), F.sum("gray_c").alias("total"))


@query(f"WITH {CELLS} SELECT pair_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, gr AS reference, gc AS candidate FROM j WHERE x >= pair_id % 3 AND x < 6 AND y >= 2 AND y < 7")
def f19_both_sides(spark, sf_dir):
    """Crops of the reference and the candidate at the same box."""
    cells = raster_cells(spark, sf_dir)
    boxes = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), F.lit(1).alias("region_no"), (F.col("vec_id") % 3).alias("x0"), F.lit(2).alias("y0"), F.lit(6).alias("x1"), F.lit(7).alias("y1"))
    return raster.crops(cells, boxes).select("pair_id", "x", "y", F.col("gray_r").alias("reference"), F.col("gray_c").alias("candidate"))


@query(f"""WITH {CELLS}, {BLUR}, {MASK}, o AS (SELECT j.pair_id, j.x, j.y, j.gc, m0.x IS NOT NULL AS hit, j.x < 2 OR j.x >= 6 OR j.y < 2 OR j.y >= 6 AS rim FROM j LEFT JOIN m0 USING (pair_id, x, y))
SELECT pair_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(CASE WHEN rim THEN 20 WHEN hit THEN floor(0.48 * gc + 0.52 * 30 + 0.5) ELSE gc END AS INT) AS b, CAST(CASE WHEN rim THEN 245 WHEN hit THEN floor(0.48 * gc + 0.52 * 235 + 0.5) ELSE gc END AS INT) AS r FROM o""")
def f20_overlay(spark, sf_dir):
    cells = raster_cells(spark, sf_dir).select("pair_id", "x", "y", *[F.col("gray_c").alias(c) for c in "bgr"], F.lit(0).alias("x0"), F.lit(0).alias("y0"), F.lit(SIDE).alias("x1"), F.lit(SIDE).alias("y1"))
    return raster.overlay(cells, mask_cells(spark, sf_dir)).select("pair_id", "x", "y", "b", "r")


# Keypoints from vectors: consecutive pairs of components are points, label groups are pages.
@query("""WITH p AS (SELECT p_partkey AS pair_id, 400 + p_size * 10 AS rw, 300 + p_partkey % 200 AS rh, 420 + p_size * 9 AS cw, 310 + p_partkey % 190 AS ch, p_partkey % 5 = 0 AS identical FROM part)
SELECT pair_id, CASE WHEN identical THEN 'exact_pixel_identity' ELSE 'page_dimension_fallback' END AS method,
 CASE WHEN identical THEN 1.0 ELSE least(greatest(0.65 - 2.5 * abs(rw::DOUBLE / rh - cw::DOUBLE / ch) / greatest(rw::DOUBLE / rh, cw::DOUBLE / ch), 0.25), 0.65) END::DOUBLE AS quality,
 CASE WHEN identical THEN 1.0 ELSE cw::DOUBLE / rw END::DOUBLE AS m00, CASE WHEN identical THEN 1.0 ELSE 0.0 END::DOUBLE AS inlier_ratio, CASE WHEN identical THEN 0.0::DOUBLE END AS reprojection_error FROM p""")
def d1_d2_alignment(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("m", "array<double>"), ("match_count", "long"), ("inliers", "long"), ("inlier_ratio", "double"), ("error", "double"))]
    k, n = F.col("p_partkey"), F.col("p_size")
    pairs = p.select(k.alias("pair_id"), (400 + n * 10).alias("rw"), (300 + k % 200).alias("rh"), (420 + n * 9).alias("cw"), (310 + k % 190).alias("ch"), (k % 5 == 0).alias("identical"), *nothing)
    return alignment.align(pairs).select("pair_id", "method", "quality", F.get("matrix", F.lit(0)).alias("m00"), "inlier_ratio", "reprojection_error")


# Descriptors hashed from line numbers; orders are pages, so a page has few keypoints.
DESC = """
ds AS (SELECT l_orderkey AS pair_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS kp_id, l_partkey * 7919 AS d0, l_suppkey * 104729 AS d1, CAST(l_quantity AS BIGINT) * 611953 AS d2, l_linenumber * 15485863 AS d3 FROM lineitem),
hm AS (SELECT r.pair_id, r.kp_id AS kp_r, c.kp_id AS kp_c, bit_count(xor(r.d0, c.d0 + c.kp_id % 2)) + bit_count(xor(r.d1, c.d1)) + bit_count(xor(r.d2, c.d2)) + bit_count(xor(r.d3, c.d3)) AS distance FROM ds r JOIN ds c ON c.pair_id = r.pair_id),
rk AS (SELECT *, row_number() OVER o AS rn, lead(distance) OVER o AS second FROM hm WINDOW o AS (PARTITION BY pair_id, kp_r ORDER BY distance, kp_c))
"""


@query(f"WITH {DESC} SELECT pair_id, CAST(kp_r AS INT) AS kp_r, CAST(kp_c AS INT) AS kp_c, CAST(distance AS INT) AS distance FROM rk WHERE rn = 1 AND distance < 0.76 * second")
def d3_ratio_matches(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice")
    d = li.select(
        F.col("l_orderkey").alias("pair_id"), F.row_number().over(order).alias("kp_id"), (F.col("l_partkey") * 7919).alias("d0"), (F.col("l_suppkey") * 104729).alias("d1"),
        (F.col("l_quantity").cast("long") * 611953).alias("d2"), (F.col("l_linenumber").cast("long") * 15485863).alias("d3"),
    )
    return alignment.ratio_matches(d, d.withColumn("d0", F.col("d0") + F.col("kp_id") % 2))


@query("""WITH p AS (SELECT l_orderkey AS pair_id, l_quantity AS rx, l_extendedprice / 1000 AS ry, l_quantity * 1.5 + 3 + l_discount * 60 AS cx, l_extendedprice / 1000 * 0.5 - 2 AS cy FROM lineitem),
e AS (SELECT pair_id, sqrt(pow(1.5 * rx + 3 - cx, 2) + pow(0.5 * ry - 2 - cy, 2)) AS err FROM p),
a AS (SELECT pair_id, count(*) AS match_count, count(*) FILTER (WHERE err <= 4.0) AS inliers, quantile_cont(err, 0.5) FILTER (WHERE err <= 4.0) AS med FROM e GROUP BY pair_id)
SELECT pair_id, match_count, inliers, inliers / match_count::DOUBLE AS inlier_ratio, round(coalesce(med, 4.0), 6) AS reprojection_error, match_count >= 10 AND inliers >= 8 AS passes,
 round(least(greatest(0.30 + 0.40 * (inliers / match_count::DOUBLE) + 0.15 * least(1.0, match_count / 100.0::DOUBLE) + 0.15 * greatest(0.0, 1.0 - coalesce(med, 4.0) / 8.0), 0.0), 1.0), 6) AS quality FROM a""")
def d4_d9_reprojection(spark, sf_dir):
    m = alignment.matrix(1.5, 0, 3, 0, 0.5, -2, 0, 0, 1)
    ry = F.col("l_extendedprice") / 1000
    points = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("pair_id"), F.col("l_quantity").alias("rx"), ry.alias("ry"), (F.col("l_quantity") * 1.5 + 3 + F.col("l_discount") * 60).alias("cx"), (ry * 0.5 - 2).alias("cy"), m.alias("matrix"))
    out = alignment.reprojection(points)
    quality = alignment.match_quality(F.col("inlier_ratio"), F.col("match_count"), F.col("reprojection_error"))
    return out.withColumns({"passes": alignment.passes_gates(F.col("match_count"), F.col("inliers")), "quality": F.round(quality, 6), "reprojection_error": F.round("reprojection_error", 6)})


@query("""WITH p AS (SELECT p_partkey, p_size / 40.0::DOUBLE AS s, (p_partkey % 60)::DOUBLE AS t FROM part)
SELECT p_partkey, t >= -60 AND 400 * s + t <= 460 AND 300 * s + t <= 345 AND s * s BETWEEN 0.65 AND 1.35 AS plausible,
 round(greatest(sqrt(2 * t * t), sqrt(pow(400 * s + t - 400, 2) + t * t), sqrt(pow(400 * s + t - 400, 2) + pow(300 * s + t - 300, 2)), sqrt(t * t + pow(300 * s + t - 300, 2))), 6) AS displacement FROM p""")
def d7_d8_plausible(spark, sf_dir):
    s, t = F.col("p_size") / 40.0, (F.col("p_partkey") % 60).cast("double")
    m = alignment.matrix(s, 0, t, 0, s, t, 0, 0, 1)
    w, h = F.lit(400.0), F.lit(300.0)
    return table(spark, sf_dir, "part").select("p_partkey", alignment.plausible(m, w, h, w, h).alias("plausible"), F.round(alignment.corner_displacement(m, w, h), 6).alias("displacement"))


@query(f"""WITH {CELLS}, t AS (SELECT c.vec_id, x, y, gray FROM cells c)
SELECT vec_id AS pair_id, CAST(x AS INT) AS x, CAST(y AS INT) AS y, CAST(floor(0.5 * coalesce(a.gray, 255) + 0.5 * coalesce(b.gray, 255) + 0.5) AS INT) AS gray FROM t
 LEFT JOIN (SELECT vec_id, x + 1 AS x, y, gray FROM cells) a USING (vec_id, x, y) LEFT JOIN (SELECT vec_id, x, y, gray FROM cells) b USING (vec_id, x, y)""")
def d10_warp(spark, sf_dir):
    """Every raster half a cell to the right."""
    cells = raster.vector_cells(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", SIDE).withColumnRenamed("vec_id", "pair_id")
    frames = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("pair_id"), F.lit(SIDE).alias("width"), F.lit(SIDE).alias("height"), alignment.matrix(1, 0, -0.5, 0, 1, 0, 0, 0, 1).alias("inverse"))
    return alignment.warp(cells, frames)


@query("""SELECT p_partkey AS pair_id, '{"schema_version":"1.0","job_id":"' || p_partkey || '","reference_transform":{"normalized_width":' || (p_size + 600) || ',"scale_x":' || CAST(p_size / 4.0::DOUBLE AS VARCHAR)
 || ',"orientation_degrees":' || p_partkey % 4 * 90 || '},"candidate_transform":{"normalized_width":' || (p_size + 700) || ',"scale_x":0.5,"orientation_degrees":0},"reference_to_candidate_homography":[[1.0,0.0,' || CAST(p_size / 2.0::DOUBLE AS VARCHAR) || '],[0.0,0.75,'
 || CAST((p_partkey % 50)::DOUBLE AS VARCHAR) || '],[0.0,0.0,1.0]],"alignment_method":"' || CASE WHEN p_partkey % 2 = 0 THEN 'orb_homography' ELSE 'page_dimension_fallback' END || '","alignment_quality":' || CAST((p_partkey % 8) / 8.0::DOUBLE AS VARCHAR) || '}' AS metadata FROM part""")
def a8_alignment_metadata(spark, sf_dir):
    """Records with both transforms, matrices, methods and qualities that differ from pair to pair."""
    k, n = F.col("p_partkey"), F.col("p_size")
    transform = lambda width, scale, turn: F.struct(width.alias("normalized_width"), scale.alias("scale_x"), turn.alias("orientation_degrees"))
    p = table(spark, sf_dir, "part").select(
        k.alias("pair_id"), transform(n + 600, n / 4.0, k % 4 * 90).alias("reference_transform"), transform(n + 700, F.lit(0.5), F.lit(0)).alias("candidate_transform"),
        alignment.matrix(1, 0, n / 2.0, 0, 0.75, k % 50, 0, 0, 1).alias("matrix"), F.when(k % 2 == 0, alignment.HOMOGRAPHY).otherwise(alignment.BY_SIZE).alias("method"), (k % 8 / 8.0).alias("quality"),
    )
    return sources.alignment_metadata(p)


# Payloads of two producers from events.
PAYLOAD = """CASE WHEN event_id % 2 = 0 THEN '{"job_id":"' || user_id || '","metrics":{"overall_tampering_risk":' || value || ',"label":"L","duration_seconds":2.5},"findings":[{"id":"f' || event_id || '","page":2,"bbox":[0.1,0.2,1.7,0.4],"risk":0.5,"evidence_sources":["a","","b"],"supporting_measurements":{"n":3,"x":[1],"ok":true}}]}'
 ELSE '{"analysis_id":"' || user_id || '","risk_score":"' || value || '","pages":[{"findings":[{"bounding_box":{"left":0.25,"top":0.5,"x1":0.75,"y1":2.5},"confidence":87,"evidence_source":"E"},{}]}],"processing_duration_ms":1200}' END"""


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select("event_id", F.expr(PAYLOAD.replace("'{", "r'{")).alias("payload"))


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS result_job_id, CAST(least(100.0, greatest(0.0, CASE WHEN value > 0 AND value <= 1 THEN value * 100 ELSE value END)) AS DOUBLE) AS risk, CASE WHEN event_id % 2 = 0 THEN 'L' ELSE 'Tampering risk assessed' END AS risk_label,
 CAST(CASE WHEN event_id % 2 = 0 THEN 1 ELSE 2 END AS DOUBLE) AS finding_count, CAST(CASE WHEN event_id % 2 = 0 THEN 2500 ELSE 1200 END AS DOUBLE) AS duration_ms, CASE WHEN event_id % 2 = 0 THEN 'f' || event_id ELSE 'finding-1' END AS first_id,
 CAST(CASE WHEN event_id % 2 = 0 THEN 1.0 ELSE 0.5 END AS DOUBLE) AS first_width, CAST(CASE WHEN event_id % 2 = 0 THEN 0.4 ELSE 1.0 END AS DOUBLE) AS first_height, CASE WHEN event_id % 2 = 0 THEN 'a, b' ELSE 'E' END AS evidence, CASE WHEN event_id % 2 = 0 THEN 2 ELSE 0 END AS n_measures, 1 AS n_pages FROM events""")
def i1_i9_results(spark, sf_dir):
    r = harmonise.harmonise_results(payloads(spark, sf_dir), "payload")
    f = F.get("findings", F.lit(0))
    return r.select(
        "event_id", "result_job_id", F.col("overall_tampering_risk").alias("risk"), "risk_label", "finding_count", F.col("processing_duration_ms").alias("duration_ms"), f.finding_id.alias("first_id"),
        f.bounding_box.width.alias("first_width"), f.bounding_box.height.alias("first_height"), f.evidence_source.alias("evidence"), F.size(f.measurements).alias("n_measures"), F.size("pages").alias("n_pages"),
    )


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS job_id, CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'processing' END AS state, least(100.0, greatest(0.0, value))::DOUBLE AS progress,
 CASE event_type WHEN 'purchase' THEN 'completed' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'queued' ELSE 'processing' END AS current_stage, CASE WHEN event_type = 'error' THEN 'broken' END AS error_message, CASE WHEN event_type = 'error' THEN 'analysis_error' END AS error_code FROM events""")
def i10_i12_jobs(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    word = F.when(F.col("event_type") == "purchase", "Success").when(F.col("event_type") == "error", "cancelled").when(F.col("event_type") == "signup", "pending").otherwise("run")
    fault = F.when(F.col("event_type") == "error", "broken")
    p = e.select("event_id", F.to_json(F.struct(F.col("user_id").cast("string").alias("id"), word.alias("status"), F.col("value").alias("progress"), fault.alias("error"))).alias("payload"))
    j = harmonise.harmonise_jobs(p, "payload")
    return j.select("event_id", "job_id", "state", "progress", "current_stage", F.col("error.message").alias("error_message"), F.col("error.code").alias("error_code"))


@query("""SELECT event_id, CAST(event_id AS VARCHAR) AS progress_event_id, event_type AS stage_id, 'Analysing document' AS message, CAST(least(100.0, greatest(0.0, value)) AS DOUBLE) AS progress, CAST(greatest(1, user_id % 4) AS DOUBLE) AS page_number FROM events""")
def i12_progress_events(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = e.select("event_id", F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("stage"), F.col("value").alias("progress"), (F.col("user_id") % 4).alias("page_number"))).alias("payload"))
    return harmonise.harmonise_events(p, "payload").select("event_id", "progress_event_id", "stage_id", "message", "progress", "page_number")


@query("""SELECT event_id, CASE WHEN event_id % 3 > 0 THEN 'file ' || event_id END AS filename, CASE WHEN event_id % 3 > 0 THEN '' END AS sha256, CASE WHEN event_id % 3 > 0 THEN greatest(1, event_id % 5 - 1)::DOUBLE END AS page_count,
 CASE WHEN event_id % 3 > 0 THEN greatest(0.0, value)::DOUBLE END AS width, CASE WHEN event_id % 3 > 0 THEN 0.0::DOUBLE END AS height, CASE WHEN event_id % 3 > 0 THEN '/p/' || user_id END AS preview_url,
 CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_id % 3 = 1 THEN 0.5 ELSE 1.0 END::DOUBLE END AS scale_x, CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_id % 3 = 1 THEN 90 ELSE 0 END::DOUBLE END AS orientation_degrees,
 CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_id % 3 = 1 THEN user_id ELSE 0 END::DOUBLE END AS original_width FROM events""")
def i6_descriptors(spark, sf_dir):
    """Descriptions with and without a transform, and something that is none."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id") % 3
    turned = F.to_json(F.struct((F.lit(0.5)).alias("scale_x"), F.lit("90").alias("orientation_degrees"), F.col("user_id").alias("original_width")))
    own = F.format_string('{"filename":"file %d","sha256":7,"page_count":%d,"width":"%s","height":-3,"preview_url":"p/%d","transform":%s}', "event_id", F.col("event_id") % 5 - 1, F.col("value").cast("string"), "user_id", F.when(k == 1, turned).otherwise('"none"'))
    payload = F.concat(F.lit('{"candidate":'), F.when(k == 0, '"no"').otherwise(own), F.lit("}"))
    c = harmonise.harmonise_results(e.select("event_id", payload.alias("payload")), "payload").select("event_id", "candidate.*")
    return c.select("event_id", "filename", "sha256", "page_count", "width", "height", "preview_url", "transform.scale_x", "transform.orientation_degrees", "transform.original_width")


@query("""SELECT event_id, CAST(user_id AS VARCHAR) AS job_id, CAST(CASE WHEN event_id % 2 = 0 THEN 2 ELSE 9 END AS DOUBLE) AS finding_count, CAST(CASE WHEN value > 0 AND value <= 1 THEN least(100.0, value * 100) ELSE least(100.0, greatest(0.0, value)) END AS DOUBLE) AS risk,
 'j' || user_id AS result_job_id, '/x/' || event_id AS candidate_page_url, 2 AS n_findings, 640.0::DOUBLE AS page_width, CAST(NULL AS DOUBLE) AS page_height FROM events""")
def i12_nested_results(spark, sf_dir):
    """Jobs with their result inside; findings are counted from it where the job has no count of its own."""
    e = table(spark, sf_dir, "events")
    count = F.when(F.col("event_id") % 2 == 1, '"finding_count":9,').otherwise("")
    payload = F.concat(F.lit('{"id":"'), F.col("user_id").cast("string"), F.lit('","preview_url":"x/'), F.col("event_id").cast("string"), F.lit('",'), count, F.lit('"result":{"analysis_id":"j'), F.col("user_id").cast("string"),
        F.lit('","risk_score":'), F.col("value").cast("string"), F.lit(',"pages":[{"width":"640","findings":[{},{"id":"z"}]}]}}'))
    j = harmonise.harmonise_jobs(e.select("event_id", payload.alias("payload")), "payload")
    page = F.get("result.pages", F.lit(0))
    return j.select("event_id", "job_id", "finding_count", F.col("result.overall_tampering_risk").alias("risk"), "result.result_job_id", "candidate_page_url", F.size("result.findings").alias("n_findings"), page.width.alias("page_width"), page.height.alias("page_height"))


@query("""SELECT event_id, 'j' || user_id AS job_id, CAST(greatest(1, user_id % 3) AS DOUBLE) AS total_pages, CASE WHEN event_id % 2 = 0 THEN '2024-01-01T00:00:00Z' END AS timestamp, CASE WHEN event_id % 3 = 0 THEN '/a/' || event_id END AS candidate_page_url FROM events""")
def i12_event_links(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    p = F.to_json(F.struct(F.concat(F.lit("j"), F.col("user_id").cast("string")).alias("job_id"), (F.col("user_id") % 3).alias("total_pages"), F.when(F.col("event_id") % 2 == 0, "2024-01-01T00:00:00Z").alias("timestamp"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("a/"), F.col("event_id").cast("string"))).alias("preview_url")))
    return harmonise.harmonise_events(e.select("event_id", p.alias("payload")), "payload").select("event_id", "job_id", "total_pages", "timestamp", "candidate_page_url")


@query("""SELECT doc_id, array_to_string(list_filter([CASE WHEN doc_id % 3 > 0 THEN 'h_not_sha256' END, CASE WHEN n_chars % 2 > 0 OR n_chars > 200 THEN 'p_out_of_range' END, CASE WHEN doc_id % 4 = 0 THEN 'u_out_of_range' END], lambda c: c IS NOT NULL), ',') AS codes FROM documents""")
def k3_k4_formats(spark, sf_dir):
    """Hashes in lower and upper case and cut short, halves as progress, shares above 1."""
    d, k = table(spark, sf_dir, "documents"), F.col("doc_id") % 3
    sha = F.sha2(F.concat(F.lit("a"), F.col("doc_id").cast("string")), 256)
    d = d.select("doc_id", F.when(k == 0, sha).when(k == 1, F.concat(F.lit("A"), F.substring(sha, 2, 63))).otherwise(F.substring(sha, 1, 63)).alias("h"), (F.col("n_chars") / 2).alias("p"), F.when(F.col("doc_id") % 4 == 0, 1.5).otherwise(0.5).alias("u"))
    return d.select("doc_id", F.array_join(contracts.violations(contracts.sha256_rule("h"), contracts.progress_rule("p"), contracts.unit_rule("u")), ",").alias("codes"))


@query("""SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'https://h/x' WHEN 1 THEN 'B/x' WHEN 2 THEN 'B/y' ELSE '' END AS url, upper(event_type[1]) || event_type[2:] || ' Id' AS title, CASE WHEN value >= 75 THEN 'critical' WHEN value >= 50 THEN 'high' WHEN value >= 25 THEN 'moderate' ELSE 'low' END AS tone,
 CASE WHEN event_id * 10 < 1024 THEN event_id * 10 || ' B' WHEN event_id * 10 < 1048576 THEN printf('%.1f KB', floor(event_id * 10 / 1024.0::DOUBLE * 10 + 0.5) / 10) ELSE printf('%.1f MB', floor(event_id * 10 / 1048576.0::DOUBLE * 10 + 0.5) / 10) END AS bytes,
 CASE WHEN event_id * 7 < 1000 THEN event_id * 7 || ' ms' WHEN event_id * 7 < 10000 THEN printf('%.1f s', floor((event_id * 7 + 50) / 100.0::DOUBLE) / 10) ELSE printf('%.0f s', floor((event_id * 7 + 500) / 1000.0::DOUBLE)) END AS took FROM events""")
def i13_i14_display(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    k = F.col("event_id") % 4
    link = F.when(k == 0, "https://h/x").when(k == 1, "/x").when(k == 2, "y").otherwise("")
    n = F.col("event_id")
    return e.select(
        "event_id", harmonise.asset_url(F.try_parse_json(F.concat(F.lit('"'), link, F.lit('"'))), "B").alias("url"),
        harmonise.title_text(F.concat("event_type", F.lit("_id"))).alias("title"), harmonise.risk_tone(F.col("value")).alias("tone"), harmonise.bytes_text(n * 10).alias("bytes"), harmonise.duration_text(n * 7).alias("took"),
    )


# Boxes from orders: expected ones and found ones a little off.
BOXED = """
ex AS (SELECT o_orderkey AS pair_id, 1 AS alteration_no, CASE WHEN o_orderkey % 3 = 0 THEN 'a' ELSE 'b' END AS category, (o_custkey % 50) / 100.0::DOUBLE AS x, (o_orderkey % 40) / 100.0::DOUBLE AS y, 0.2::DOUBLE AS width, 0.1::DOUBLE AS height FROM orders),
fo AS (SELECT o_orderkey AS pair_id, 'f' || k AS finding_id, 'a' AS category, o_totalprice / 5000 AS risk_score, ((o_custkey + 7 * k) % 50) / 100.0::DOUBLE AS x, ((o_orderkey + 3 * k) % 40) / 100.0::DOUBLE AS y, 0.2::DOUBLE AS width, 0.1::DOUBLE AS height FROM orders, range(1, 3) AS r(k))
"""


@query(f"""WITH {BOXED}, o AS (SELECT e.pair_id, e.alteration_no, e.category AS want, f.finding_id, f.category, f.risk_score, greatest(0.0, least(e.x + 0.2, f.x + 0.2) - greatest(e.x, f.x)) * greatest(0.0, least(e.y + 0.1, f.y + 0.1) - greatest(e.y, f.y)) AS i FROM ex e JOIN fo f ON f.pair_id = e.pair_id),
u AS (SELECT *, i / (0.2 * 0.1 + 0.2 * 0.1 - i) AS iou FROM o), b AS (SELECT * FROM u QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY round(iou, 12) DESC, finding_id DESC) = 1)
SELECT pair_id, CAST(alteration_no AS INT) AS alteration_no, finding_id, CAST(round(iou, 9) AS DOUBLE) AS iou, want = category AS category_equal, iou >= 0.05 AS located, risk_score >= 50 AS risky FROM b""")
def j1_j2_matched(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    box = [F.lit(0.2).alias("width"), F.lit(0.1).alias("height")]
    expected = o.select(F.col("o_orderkey").alias("pair_id"), F.lit(1).alias("alteration_no"), F.when(F.col("o_orderkey") % 3 == 0, "a").otherwise("b").alias("category"), (F.col("o_custkey") % 50 / 100.0).alias("x"), (F.col("o_orderkey") % 40 / 100.0).alias("y"), *box)
    k = o.select("*", F.explode(F.array(F.lit(1), F.lit(2))).alias("k"))
    found = k.select(F.col("o_orderkey").alias("pair_id"), F.concat(F.lit("f"), F.col("k").cast("string")).alias("finding_id"), F.lit("a").alias("category"), (F.col("o_totalprice") / 5000).alias("risk_score"), ((F.col("o_custkey") + 7 * F.col("k")) % 50 / 100.0).alias("x"), ((F.col("o_orderkey") + 3 * F.col("k")) % 40 / 100.0).alias("y"), *box)
    return evaluation.matched(expected, found).withColumn("iou", F.round("iou", 9))


@query("SELECT o_custkey AS reference_id, min(o_totalprice / 5000) FILTER (WHERE o_orderstatus = 'F') - max(o_totalprice / 5000) FILTER (WHERE o_orderstatus <> 'F') AS gap, coalesce(min(o_totalprice / 5000) FILTER (WHERE o_orderstatus = 'F') - max(o_totalprice / 5000) FILTER (WHERE o_orderstatus <> 'F') >= 40, false) AS separated FROM orders GROUP BY o_custkey")
def j3_separation(spark, sf_dir):
    return evaluation.separation(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("reference_id"), (F.col("o_orderstatus") == "F").alias("tampered"), (F.col("o_totalprice") / 5000).alias("risk")))


@query("(SELECT o_orderkey, o_custkey, 'first' AS run FROM orders WHERE o_orderkey % 100 = 0) UNION ALL (SELECT o_orderkey, o_custkey + 1, 'second' FROM orders WHERE o_orderkey % 100 = 0)")
def j4_differences(spark, sf_dir):
    """Two runs that differ in every hundredth row."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return evaluation.differences_between(o, o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 100 == 0, F.col("o_custkey") + 1).otherwise(F.col("o_custkey"))))


@query(f"WITH {CELLS}, {BLUR}, {MASK}, w AS (SELECT DISTINCT pair_id FROM j) SELECT w.pair_id, 12::BIGINT AS expected_cells, count(m0.x) AS mask_cells, count(m0.x) FILTER (WHERE m0.x BETWEEN 2 AND 5 AND m0.y BETWEEN 3 AND 5) AS both_cells FROM w LEFT JOIN m0 ON m0.pair_id = w.pair_id GROUP BY w.pair_id")
def j6_mask_overlap(spark, sf_dir):
    pairs = raster_cells(spark, sf_dir).select("pair_id").distinct()
    expected = pairs.select("pair_id", F.lit(2).alias("x0"), F.lit(3).alias("y0"), F.lit(6).alias("x1"), F.lit(6).alias("y1"))
    return evaluation.mask_overlap(expected, mask_cells(spark, sf_dir))


@query("""WITH s AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount * 8 AS x, l_tax * 8 AS y, l_quantity / 50 - 0.1 AS width, 0.3::DOUBLE AS height, l_extendedprice / 900 AS score, l_returnflag FROM lineitem)
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, array_to_string(list_filter([CASE WHEN NOT (width > 0 AND height > 0) THEN 'box_extent_not_positive' END, CASE WHEN NOT (x + width <= 1.000001 AND y + height <= 1.000001) THEN 'box_outside_page' END,
 CASE WHEN NOT (x BETWEEN 0 AND 1 AND y BETWEEN 0 AND 1 AND width BETWEEN 0 AND 1 AND height BETWEEN 0 AND 1) THEN 'box_not_unit' END, CASE WHEN NOT (score BETWEEN 0 AND 100) THEN 'score_out_of_range' END, CASE WHEN l_returnflag NOT IN ('A', 'R') THEN 'l_returnflag_not_allowed' END,
 CASE WHEN NOT (l_linenumber - 2 >= 1) THEN 'page_number_below_one' END], lambda c: c IS NOT NULL), ',') AS codes FROM s""")
def k1_k8_violations(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").withColumns({"x": F.col("l_discount") * 8, "y": F.col("l_tax") * 8, "width": F.col("l_quantity") / 50 - 0.1, "height": F.lit(0.3), "score": F.col("l_extendedprice") / 900, "page": F.col("l_linenumber") - 2})
    rules = [*contracts.box_rules(), contracts.score_rule("score"), contracts.enum_rule("l_returnflag", ("A", "R")), *contracts.count_rules("page")]
    return li.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.array_join(contracts.violations(*rules), ",").alias("codes"))


@query("""SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'unknown_field' WHEN event_id % 4 = 1 THEN 'missing_field' WHEN event_id % 4 = 2 THEN 'malformed' END AS contract_error, CASE WHEN event_id % 4 = 3 THEN user_id END AS job FROM events""")
def a9_k7_contract(spark, sf_dir):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("job", T.LongType(), False), T.StructField("state", T.StringType(), False), T.StructField("note", T.StringType(), True)])
    k = F.col("event_id") % 4
    job = F.col("user_id").cast("string")
    payload = F.when(k == 0, F.concat(F.lit('{"job":'), job, F.lit(',"state":"x","more":1}'))).when(k == 1, F.concat(F.lit('{"job":'), job, F.lit("}"))).when(k == 2, F.lit('{"job":')).otherwise(F.concat(F.lit('{"job":'), job, F.lit(',"state":"x"}')))
    read = contracts.read_contract(table(spark, sf_dir, "events").select("event_id", payload.alias("payload")), "payload", schema)
    return read.select("event_id", "contract_error", F.col("record.job").alias("job"))
