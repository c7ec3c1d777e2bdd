"""One query for each numbered operator, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestra.llm import ann, bpe, chat, fim, mixing, ngram_join, pii, quality, repair, repeats, sharding, toxicity, warc
from attestra.llm.common import read_table

RANK_FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SHARD_NAMES = [f"shard-{i:03d}" for i in range(sharding.N_SHARDS)]


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return bpe.encode(docs, RANK_FILE, public_tokenizers.PATTERN, decoded="decoded", keep=["doc_id"]).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read_table(spark, sf_dir, "pages")
    root, shards = warc.archive(pages)
    records = warc.read_captures(pages.select(warc.surt(F.col("url")).alias("key")), shards, root)
    return warc.resolved(records)


OP2_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b) AS n, sha1(b) AS h FROM p),
w AS (SELECT h, max(page_id) AS latest FROM d WHERE n >= 1000 GROUP BY h)
SELECT d.page_id, CAST(d.n AS BIGINT) AS payload_bytes, d.h AS payload_digest,
  CASE WHEN w.latest > d.page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN w.latest > d.page_id THEN w.latest END AS refers_to
FROM d LEFT JOIN w ON d.h = w.h
"""


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return quality.clean_lines(docs, keep=["doc_id"], cleaned=False)


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
ls AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line, generate_subscripts(string_split(t, chr(10)), 1) AS i FROM d),
lw AS (SELECT *, list_filter(regexp_split_to_array(line, '[ \x09-\x0D]+'), lambda w: w <> '') AS ws FROM ls),
lines AS (SELECT *, len(ws) AS nw, length(array_to_string(ws, '')) AS nc,
  row_number() OVER (PARTITION BY doc_id, line ORDER BY i) AS seen FROM lw WHERE len(ws) > 0),
judged AS (SELECT *,
  length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) AS ns,
  len(list_filter(ws, lambda w: suffix(w, '!!') OR suffix(w, '??'))) AS shout FROM lines),
failing AS (SELECT *,
  (length(line) - length(regexp_replace(line, '[|»›]', '', 'g')) >= {quality.MIN_SEPARATORS}
   OR (nw <= {quality.MAX_NOTICE_WORDS} AND regexp_matches(line, '{quality.BOILERPLATE}'))
   OR 100 * ns > {quality.MAX_SYMBOL_PERCENT} * nc
   OR 100 * shout > {quality.MAX_SHOUT_PERCENT} * nw
   OR (nw >= {quality.NEEDS_STOP} AND NOT regexp_matches(line, '[.!?…。]["''”’»)\]]*([ \x09-\x0D]|$)'))) AS bad FROM judged),
words AS (SELECT doc_id, flatten(list(ws ORDER BY i)) AS ws FROM failing GROUP BY doc_id),
win AS (SELECT doc_id, k, ws[k:k+7] AS w8 FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS k FROM words)),
rep AS (SELECT doc_id, k FROM win QUALIFY count(*) OVER (PARTITION BY doc_id, w8) > 1),
cov AS (SELECT doc_id, count(DISTINCT k + j) AS n FROM rep, range(0, 8) AS r(j) GROUP BY doc_id),
agg AS (SELECT doc_id, sum(nw) AS n_words, sum(nc) AS word_chars, sum(ns) AS n_symbols,
  count(*) FILTER (WHERE seen > 1) AS n_dup_lines, coalesce(sum(nc) FILTER (WHERE bad), 0) AS lost FROM failing GROUP BY doc_id),
m AS (SELECT d.doc_id, coalesce(n_words, 0) AS n_words, coalesce(word_chars, 0) AS word_chars, coalesce(n_symbols, 0) AS n_symbols,
  coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words, coalesce(lost, 0) AS lost_chars
  FROM d LEFT JOIN agg USING (doc_id) LEFT JOIN cov USING (doc_id)),
b AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols,
  CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed,
  CAST(lost_chars AS BIGINT) AS lost_chars, NOT base_failed AND 100 * lost_chars <= {quality.MAX_LOSS_PERCENT} * word_chars AS kept
FROM b
"""


def op4_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = spark.sql(
        r"SELECT * FROM VALUES (-7L, 0L, 'user', r'\### Assistant: </turn> ok'), (-7L, 1L, 'assistant', r'\### Assistant: </turn> ok') AS v(conv_id, turn, role, text)"
    )
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    read = chat.parse_conversations(chat.format_conversations(turns))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    loss = F.array_join("loss_texts", "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


OP4_SQL = r"""
WITH c AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok' UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
m AS (SELECT *, lag(role) OVER w IS DISTINCT FROM role AS opens,
  replace(regexp_replace(replace(text, '\', '\\'), '##(#+)', '##\1', 'g'), '</turn>', '<\/turn>') AS e FROM c
  WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)),
n AS (SELECT *, length(e) + 7 + CASE WHEN opens THEN length(role) + 9 ELSE 0 END
  + list_sum(list_transform(regexp_extract_all(text, '##+'), lambda h: length(h) - 2)) AS l0,
  list_sum(list_transform(regexp_extract_all(text, '##+'), lambda h: length(h) - 2)) AS extra FROM m)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(e) + coalesce(extra, 0) + 7 + CASE WHEN opens THEN length(role) + 9 ELSE 0 END) AS BIGINT) AS formatted_chars
FROM n GROUP BY conv_id
"""


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id")
    return sharding.assign_shards(docs, "doc_id", SHARD_NAMES).select("doc_id", "slot", "shard")


def span_digest(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start, s.end)), ",")


def of_kind(kind: str):
    """The span's start if it is of the kind, else null."""
    return lambda span: F.when(span.kind == kind, span.start)


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.find_spans(docs, keep=["doc_id"])
    counts = [F.size(F.array_compact(F.transform("pii", of_kind(k)))).cast("long").alias(f"n_{k}") for k in pii.BASE]
    base = F.filter("pii", lambda s: s.kind.isin(*pii.BASE))
    return found.select("doc_id", *counts, F.sha2(span_digest(base), 256).alias("base_sha256"), span_digest(F.col("pii")).alias("spans"))


def op7_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = read_table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(vectors, F.col("vec_id") % 20 == 0)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "source")
    return mixing.shuffled(mixing.replicate(docs)).select("doc_id", "source", F.col("copy").cast("int").alias("copy"), "mix_key")


OP8_SQL = f"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
t AS (SELECT sum(pow(CAST(n AS DOUBLE), {mixing.ALPHA})) AS ws, CAST(sum(n) AS DOUBLE) AS ns FROM s),
r AS (SELECT source, ns * pow(CAST(n AS DOUBLE), {mixing.ALPHA}) / ws / n AS rate FROM s, t),
cdf(source, rate, k, p, below) AS (SELECT source, rate, 0, exp(-rate), exp(-rate) FROM r
  UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), below + p * rate / (k + 1) FROM cdf WHERE k + 1 <= ceil(rate + 12 * sqrt(rate) + 16)),
d AS (SELECT doc_id, source, CAST(('0x' || substr(md5(concat_ws(':', '{mixing.SEED}', coalesce(CAST(doc_id AS VARCHAR), 'null'))), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS u FROM documents)
SELECT d.doc_id, d.source, CAST(c.k AS INTEGER) AS copy,
  CAST(('0x' || substr(md5(concat_ws(':', '{mixing.SEED}', 'mix', coalesce(CAST(d.doc_id AS VARCHAR), 'null'), CAST(c.k AS VARCHAR))), 1, 13)) AS BIGINT) / 4503599627370496.0::DOUBLE AS mix_key
FROM d JOIN cdf c ON d.source IS NOT DISTINCT FROM c.source AND d.u >= c.below
"""


def op9_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join_components(read_table(spark, sf_dir, "documents").select("doc_id", "text"))


OP9_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
  '[ \x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(ws[k:k+4], ' ') AS g
  FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 4, CASE WHEN len(ws) > 0 THEN 1 ELSE 0 END) + 1)) AS k FROM d))),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM o JOIN n nx ON x = nx.doc_id JOIN n ny ON y = ny.doc_id WHERE 100 * common >= 80 * (nx.n + ny.n - common)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(a, b) AS (SELECT x, y FROM e UNION SELECT r.a, e.y FROM r JOIN e ON r.b = e.x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(c.m, d.doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT a AS doc_id, min(b) AS m FROM r GROUP BY a) c USING (doc_id)
"""


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.fit(docs, read_table(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (~toxicity.in_fit(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = fim.transform(docs, keep=["doc_id"])
    return cut.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2(fim.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256")
    )


OP11_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents),
h AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, [CAST('0x' || x[8 * i + 1:8 * i + 8] AS BIGINT) for i in range(4)] AS h FROM d),
c AS (SELECT doc_id, t, u, len(u) AS n, t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h[3] % 100 >= 100 AS plain, h[4] % 100 < 50 AS spm,
  least(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS a, greatest(h[1] % (len(u) + 1), h[2] % (len(u) + 1)) AS b FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS s FROM c)
SELECT doc_id, n, CASE WHEN plain THEN 'plain' WHEN spm THEN 'spm' ELSE 'psm' END AS form, CASE WHEN NOT plain THEN length(p) END AS prefix_chars, CASE WHEN NOT plain THEN length(m) END AS middle_chars,
  sha256(CASE WHEN plain THEN t WHEN spm THEN '<S>' || s || '<P>' || p || '<M>' || m ELSE '<P>' || p || '<S>' || s || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256
FROM p
"""


def op12_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = repair.damaged(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text"))
    made = F.array_join(F.transform("repaired", lambda t: F.concat(t.role, F.lit(":"), t.text)), "\n")
    return repair.repair(turns, F.col("lost")).withColumn("repaired_sha256", F.sha2(made, 256)).drop("repaired")


OP12_SQL = r"""
WITH RECURSIVE o AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations),
h AS (SELECT *, xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(k, ''), lambda c: [CAST(unicode(c) AS BIGINT), 0, 0, 0, 0, 0, 0, 0]))),
  lambda c, x: CASE WHEN xor(c, x) % 2 = 1 THEN xor(xor(c, x) >> 1, 3988292384::BIGINT) ELSE xor(c, x) >> 1 END), 4294967295::BIGINT) % 20 AS h FROM o),
d AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
  unnest(range(0, CASE h WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM h),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos, left(role, 1) AS i,
  rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t FROM d),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS dup, lag(i) OVER (PARTITION BY conv_id ORDER BY pos) AS prev FROM n),
g AS (SELECT *, CASE WHEN t = '' THEN 'blank' WHEN dup THEN 'duplicate' WHEN right(t, 1) NOT IN ('.', '!', '?') THEN 'truncated' ELSE 'none' END AS fault FROM f),
s AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE prev IS NOT NULL AND prev || i NOT IN ('su', 'ua', 'au')) AS illegal, max(pos) AS rows FROM g GROUP BY conv_id),
q AS (SELECT *, fault IN ('none', 'truncated') AS stays, CASE WHEN fault = 'truncated' THEN 5::BIGINT ELSE 0::BIGINT END AS e FROM g),
r(conv_id, pos, b0, b1, b2, b3) AS (
  SELECT conv_id, rows + 1, {'c': 0::BIGINT, 'a': ''}, {'c': 10::BIGINT, 'a': 'II'}, {'c': 5::BIGINT, 'a': 'I'}, {'c': 0::BIGINT, 'a': ''} FROM s
  UNION ALL
  SELECT conv_id, pos, list_min([p0, {'c': 5 + c2.c, 'a': 'I' || c2.a}]), list_min([p1, {'c': 5 + c2.c, 'a': 'I' || c2.a}]), c2, list_min([p3, {'c': 5 + p2.c, 'a': 'I' || p2.a}])
  FROM (SELECT *, list_min([p2, {'c': 5 + p3.c, 'a': 'I' || p3.a}]) AS c2 FROM (
    SELECT r.conv_id, q.pos,
      list_min([{'c': 2 + b0.c, 'a': 'D' || b0.a}, CASE WHEN stays AND i = 's' THEN {'c': e + b1.c, 'a': 'K' || b1.a} END, CASE WHEN stays AND i = 'u' THEN {'c': e + b2.c, 'a': 'K' || b2.a} END, CASE WHEN stays THEN {'c': 1 + e + b2.c, 'a': 'R' || b2.a} END]) AS p0,
      list_min([{'c': 2 + b1.c, 'a': 'D' || b1.a}, CASE WHEN stays AND i = 'u' THEN {'c': e + b2.c, 'a': 'K' || b2.a} END, CASE WHEN stays THEN {'c': 1 + e + b2.c, 'a': 'R' || b2.a} END]) AS p1,
      list_min([{'c': 2 + b2.c, 'a': 'D' || b2.a}, CASE WHEN stays AND i = 'a' THEN {'c': e + b3.c, 'a': 'K' || b3.a} END, CASE WHEN stays THEN {'c': 1 + e + b3.c, 'a': 'R' || b3.a} END]) AS p2,
      list_min([{'c': 2 + b3.c, 'a': 'D' || b3.a}, CASE WHEN stays AND i = 'u' THEN {'c': e + b2.c, 'a': 'K' || b2.a} END, CASE WHEN stays THEN {'c': 1 + e + b2.c, 'a': 'R' || b2.a} END]) AS p3
    FROM r JOIN q ON q.conv_id IS NOT DISTINCT FROM r.conv_id AND q.pos = r.pos - 1))),
best AS (SELECT conv_id, b0.c AS cost, b0.a AS audit FROM r WHERE pos = 1),
l AS (SELECT conv_id, unnest(string_split(audit, '')) AS letter, generate_subscripts(string_split(audit, ''), 1) AS k FROM best WHERE audit <> ''),
m AS (SELECT *, count(*) FILTER (WHERE letter <> 'I') OVER w AS row, count(*) FILTER (WHERE letter <> 'D') OVER w AS nth FROM l WINDOW w AS (PARTITION BY conv_id ORDER BY k ROWS UNBOUNDED PRECEDING)),
x AS (SELECT m.conv_id, m.k, m.letter, m.nth, q.role, q.text, q.i FROM m LEFT JOIN q ON m.letter <> 'I' AND q.conv_id IS NOT DISTINCT FROM m.conv_id AND q.pos = m.row WHERE m.letter <> 'D'),
y AS (SELECT *, max(CASE WHEN nth = 1 AND letter = 'K' AND i = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id) AS sys FROM x),
z AS (SELECT conv_id, string_agg(CASE WHEN letter = 'K' THEN role WHEN (nth - sys) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN letter = 'I' THEN '' ELSE text END, chr(10) ORDER BY k) AS made FROM y GROUP BY conv_id)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  coalesce(cost, 0) AS cost, coalesce(audit, '') AS audit, sha256(coalesce(made, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN s ON s.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN z ON z.conv_id IS NOT DISTINCT FROM c.conv_id
"""


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    return repeats.remove_repeats(docs, keep=["doc_id"]).select("doc_id", "n_words", "n_removed", F.sha2("kept_text", 256).alias("kept_sha256"))


OP13_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \x09-\x0D]+'), lambda w: w <> '') AS ws FROM documents),
w AS (SELECT doc_id, i, md5(array_to_string(ws[i:i + {repeats.WINDOW - 1}], ' ')) AS g FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - {repeats.WINDOW - 2})) AS i FROM d)),
f AS (SELECT *, min(doc_id) OVER (PARTITION BY g) AS m FROM w),
c AS (SELECT DISTINCT doc_id, i + j AS p FROM f, range(0, {repeats.WINDOW}) AS r(j) WHERE m < doc_id),
e AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
k AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS kept, count(*) AS n FROM e ANTI JOIN c USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(ws) AS n_words, len(ws) - coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN k USING (doc_id)
"""


QUERIES = {
    "op1_bpe": op1_bpe,
    "op2_warc": op2_warc,
    "op3_quality": op3_quality,
    "op4_chat": op4_chat,
    "op5_sharding": op5_sharding,
    "op6_pii": op6_pii,
    "op7_ann": op7_ann,
    "op8_mixing": op8_mixing,
    "op9_ngram_join": op9_ngram_join,
    "op10_toxicity": op10_toxicity,
    "op11_fim": op11_fim,
    "op12_repair": op12_repair,
    "op13_repeats": op13_repeats,
}

ORACLES = {"op2_warc": OP2_SQL, "op3_quality": OP3_SQL, "op4_chat": OP4_SQL, "op8_mixing": OP8_SQL, "op9_ngram_join": OP9_SQL, "op11_fim": OP11_SQL, "op12_repair": OP12_SQL, "op13_repeats": OP13_SQL}
