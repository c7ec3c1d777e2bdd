import random
import time

from attestra.llm import chat


def formatted(spark, rows):
    return chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))


def test_round_trip(spark):
    rng = random.Random(2)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 9)):
            text = "".join(rng.choice(["#", "##", "###", "\\", "</turn>", "<", "/turn>", "\n", " a ", "é", "### user ###"]) for _ in range(rng.randint(0, 8)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "assistant", "sy#stem\\ ", ""]), rng.choice([text, text, None])))
    out = formatted(spark, rows)
    back = {r.conv_id: r for r in chat.parse_conversations(out).collect()}
    n = {r.conv_id: r for r in out.collect()}
    for conv in range(60):
        own = [(r, t or "") for c, _, r, t in sorted((x for x in rows if x[0] == conv), key=lambda x: x[1])]
        assert [(t.role, t.text) for t in back[conv].turns] == own
        assert back[conv].loss_texts == [t for r, t in own if r == "assistant"]
        assert n[conv].n_turns == len(own)
        assert n[conv].n_messages == sum(i == 0 or own[i - 1][0] != own[i][0] for i in range(len(own)))


def test_edges(spark):
    rows = [(None, 0, "user", "a"), (1, 0, None, "b"), (1, None, "assistant", "c"), (2, 5, "assistant", "z"), (2, 5, "assistant", "a"), (2, 5, "assistant", "a")]
    back = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in chat.parse_conversations(formatted(spark, rows)).collect()}
    assert back == {None: [("user", "a")], 1: [("assistant", "c"), ("", "b")], 2: [("assistant", "a"), ("assistant", "a"), ("assistant", "z")]}
    assert formatted(spark, []).count() == 0


def test_long_conversation(spark):
    rows = [(1, i, "assistant" if i % 3 else "user", f"text {i}") for i in range(5_000)]
    back = chat.parse_conversations(formatted(spark, rows)).first()
    assert len(back.turns) == 5_000 and "".join(back.loss_texts) == "".join(f"text {i}" for i in range(5_000) if i % 3)


def test_columns_of_other_names(spark):
    """Columns named like the operator's own change nothing."""
    rows = [(1, 0, "user", "hi ###", "a"), (1, 1, "assistant", None, "b"), (None, 0, "assistant", "alone", "c")]
    plain = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, extra string")
    own = plain.select("*", *[plain.extra.alias(c) for c in ("ts", "starts", "pieces", "formatted", "loss_spans", "t", "pos", "_id")])
    read = lambda df: sorted((str(r.conv_id), r.formatted, str(r.loss_spans)) for r in chat.format_conversations(df).collect())
    assert read(own) == read(plain) and len(read(own)) == 2


def test_mask_over_blocks(spark):
    """Spans that begin, end or stand across the blocks that the reader cuts, code points of two UTF-16 units among them."""
    rng = random.Random(4)
    rows = [(c, i, rng.choice(["user", "assistant"]), "".join(rng.choice("aé\U0001f600\\#\n") for _ in range(rng.choice([0, 1, 900, 1_024, 1_025, 5_000])))) for c in range(12) for i in range(6)]
    back = {r.conv_id: r.loss_texts for r in chat.parse_conversations(formatted(spark, rows)).collect()}
    assert back == {c: [t for k, _, r, t in rows if k == c and r == "assistant"] for c in range(12)}


def test_time_grows_with_the_length(spark):
    """One conversation of 20,000 turns takes seconds, written and read back; at four times the turns a quadratic form takes sixteen times as long."""

    def seconds(n):
        turns = spark.range(n).selectExpr("1L AS conv_id", "id AS turn", "IF(id % 2 = 0, 'user', 'assistant') AS role", "repeat('word # ', 16) AS text")
        began = time.monotonic()
        back = chat.parse_conversations(chat.format_conversations(turns)).first()
        assert len(back.turns) == n and len(back.loss_texts) == n // 2
        return time.monotonic() - began

    seconds(100)
    assert seconds(20_000) < 10 * max(seconds(5_000), 1.0)
