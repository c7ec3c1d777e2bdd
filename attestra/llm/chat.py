r"""Chat formatting with relational operations and Spark expressions only.

The turns of a conversation are collected as structs and sorted; adjacent turns
of one role become one message that keeps the seams between them, so that the
text can be read back turn by turn. The template, for a message:

    ### role ###\n text </turn> text </turn>

without the blanks around the texts. Inside roles and texts `\` becomes `\\`,
a `#` before two more becomes `#\`, and `</turn>` becomes `<\/turn>`; so neither
`###` nor `</turn>` occurs in them, and dropping each backslash that stands
before another character restores them. The loss mask is a list of half-open code
point ranges: each assistant text of the output, without header and end mark.

Defined results: a null text or role is empty; turns with the same number are
ordered by role and text, null numbers first; repeated rows are turns of their
own; a null conv_id is a conversation; an empty table gives no conversation;
other columns are ignored. A conversation is one string in the end, so its
rows meet in one task; it must fit a Spark string. Writing and reading it take time in
proportion to its length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MARK, END = "###", "</turn>"
#: Code points of the blocks in which a text is searched for a place.
BLOCK = 1_024


def escape(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, r"\\", r"\\\\"), "#(?=##)", r"#\\"), "</turn>", r"<\\/turn>")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_conversations(turns: DataFrame, assistant: str = "assistant") -> DataFrame:
    """conv_id, formatted, loss_spans array<struct<start, end>>, n_turns and n_messages of each conversation."""
    rows = turns.select(
        "conv_id",
        F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("t"),
    )
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("ts"))
    # A turn whose role is not the one before opens a message; those that follow join it, behind their seam.
    opens = lambda t, i: (i == 0) | (F.get("ts", i - 1).role != t.role)
    pieces = F.transform(
        "ts",
        lambda t, i: F.struct(
            F.when(opens(t, i), F.concat(F.lit(f"{MARK} "), escape(t.role), F.lit(f" {MARK}\n"))).otherwise(F.lit("")).alias("before"),
            escape(t.text).alias("text"),
            (t.role == assistant).alias("loss"),
        ),
    )
    chats = chats.select("conv_id", F.size("ts").cast("long").alias("n_turns"), pieces.alias("pieces"))
    chats = chats.withColumn("n_messages", F.size(F.filter("pieces", lambda p: p.before != "")).cast("long"))
    formatted = F.array_join(F.transform("pieces", lambda p: F.concat(p.before, p.text, F.lit(END))), "")
    # Running offsets: a window within the conversation, on the partitioning that the grouping left.
    each = chats.select("conv_id", F.posexplode("pieces").alias("pos", "p"))
    length = F.length("p.before") + F.length("p.text") + len(END)
    until = F.sum(length).over(Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0))
    each = each.withColumn("stop", until - len(END)).where("p.loss")
    spans = each.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct((F.col("stop") - F.length("p.text")).alias("start"), F.col("stop").alias("end")))).alias("loss_spans"))
    spans = spans.withColumnRenamed("conv_id", "_id")
    out = chats.withColumn("formatted", formatted).join(spans, F.col("conv_id").eqNullSafe(F.col("_id")), "left")
    none = F.array().cast("array<struct<start:bigint,end:bigint>>")
    return out.select("conv_id", "formatted", F.coalesce("loss_spans", none).alias("loss_spans"), "n_turns", "n_messages")


def _cut(blocks: str, start: Column, end: Column) -> Column:
    """Code points start to end of a text given in blocks: finding a place costs a block, not all that stands before it."""

    def part(k: Column) -> Column:
        first = F.greatest(start - k * BLOCK, F.lit(0))
        return F.substring(F.get(blocks, k), (first + 1).cast("int"), (F.least(end - k * BLOCK, F.lit(BLOCK)) - first).cast("int"))

    last = F.floor((end - 1) / BLOCK).cast("int")
    return F.when(end <= start, F.lit("")).otherwise(F.array_join(F.transform(F.sequence(F.floor(start / BLOCK).cast("int"), last), part), ""))


def parse_conversations(formatted: DataFrame) -> DataFrame:
    """conv_id, turns array<struct<role, text>> and loss_texts array<string>, read from the output alone."""
    chats = formatted.withColumns({"_parts": F.split(F.col("formatted"), MARK, -1), "_blocks": F.regexp_extract_all("formatted", F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))})
    headers = F.sequence(F.lit(1), F.size("_parts") - 2, F.lit(2))
    messages = F.transform(
        headers,
        lambda i: F.struct(
            F.regexp_replace(F.get("_parts", i), r"(?s)^ (.*) $", "$1").alias("role"),
            F.slice(F.split(F.regexp_replace(F.get("_parts", i + 1), r"^\n", ""), END, -1), F.lit(1), F.size(F.split(F.get("_parts", i + 1), END, -1)) - 1).alias("texts"),
        ),
    )
    turns = F.flatten(F.transform(messages, lambda m: F.transform(m.texts, lambda x: F.struct(unescape(m.role).alias("role"), unescape(x).alias("text")))))
    loss = F.transform("loss_spans", lambda s: unescape(_cut("_blocks", s.start, s.end)))
    return chats.select("conv_id", "formatted", turns.alias("turns"), loss.alias("loss_texts"))
