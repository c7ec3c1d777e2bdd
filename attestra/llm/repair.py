r"""Conversation structure repair: the cheapest edits that make a conversation `(s?(ua)+)?`, one walk for all that end alike.

A conversation is told by its signature, a symbol a turn for its role's initial and its fault. What the rest of a conversation costs
depends only on the signature from there on and on where the grammar stands, so signatures share their endings: the automaton
of all signatures, built from the end, has one node for each different ending, and a node knows for each state of
the grammar the least cost to go, the edit to make and the state behind it. Following those edits from a signature's node
spells the best audit. The automaton is never held whole: conversations are dealt into ranges of reversed signatures and
sorted by them, so that endings that are shared lie side by side, and a task keeps the nodes of the ending that it is at.
A node is worked out once, but for those that lie across a bound of two ranges.

Edits: Keep 0, Rerole to user or assistant 1, Delete 2 (the only one for a blank or repeated turn), Insert of an empty user or assistant
turn 5; a truncated turn that stays adds 5. Of audits that cost the same the least in ASCII order is taken; as the four edits lead to one
state each, this is the least edit at each step.

Faults, the first that holds: blank (nothing but white space), duplicate (role and text of an earlier turn), truncated (the last
character is none of `.!?`).

Defined results: a null role or text is one blank; turns are ordered by number, nulls first, then role and text; rows that repeat
are turns; a null conv_id is a conversation; a conversation that has lost all of its rows costs nothing; other
columns are ignored; an empty table gives no rows. A conversation is one text in the end, so its rows meet in one task.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from attestra.llm.common import Workspace, bounded_batches

BLANKS = " \t\n\x0b\f\r"
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 1, 2, 5, 5
#: Symbols at the end of a signature by which conversations are dealt; what they share beyond is sorted within a range.
DEALT_BY = 64
#: States: nothing yet, behind the system turn, behind a user turn, behind an assistant turn. The first and the last may end.
START, SYSTEM, USER, ASSISTANT = range(4)
#: State behind a turn of the other speaker.
NEXT = (USER, USER, ASSISTANT, USER)
#: A node: for each state (cost to go, edit, state behind it). This one is the end of every conversation.
END = ((0, "", START), (2 * INSERT, "I", USER), (INSERT, "I", ASSISTANT), (0, "", ASSISTANT))


def node(symbol: str, behind: tuple) -> tuple:
    """The node of an ending whose first symbol is `symbol` and whose rest has the node `behind`.

    Symbols: x must be deleted; s, u, a and o (any other initial) as they are, capitals if truncated.
    """
    initial, extra = symbol.lower(), TRUNCATED if symbol.isupper() else 0
    plain = []
    for state in range(4):
        ways = [(DELETE + behind[state][0], "D", state)]
        if symbol != "x":
            ways.append((REROLE + extra + behind[NEXT[state]][0], "R", NEXT[state]))
            if initial == ("a" if state == USER else "u"):
                ways.append((KEEP + extra + behind[NEXT[state]][0], "K", NEXT[state]))
            elif initial == "s" and state == START:
                ways.append((KEEP + extra + behind[SYSTEM][0], "K", SYSTEM))
        plain.append(min(ways))
    user = min(plain[USER], (INSERT + plain[ASSISTANT][0], "I", ASSISTANT))
    inserted = (INSERT + user[0], "I", USER)
    return (min(plain[START], inserted), min(plain[SYSTEM], inserted), user, min(plain[ASSISTANT], (INSERT + plain[USER][0], "I", USER)))


class Endings:
    """The nodes of one signature, its end first; signatures should come sorted by their reverse."""

    def __init__(self) -> None:
        self.reverse, self.nodes, self.made, self.last = "", [END], 0, None

    def best(self, signature: str) -> tuple[int, str]:
        """Least cost and best audit of a signature."""
        reverse = signature[::-1]
        if self.last is not None and reverse == self.reverse:
            return self.last
        shared = len(os.path.commonprefix((self.reverse, reverse)))
        del self.nodes[shared + 1 :]
        for symbol in reverse[shared:]:
            self.nodes.append(node(symbol, self.nodes[-1]))
        self.made += len(reverse) - shared
        self.reverse = reverse
        at, state, audit = len(reverse), START, []
        while at or self.nodes[0][state][1]:
            _, edit, state = self.nodes[at][state]
            audit.append(edit)
            at -= edit != "I"
        self.last = self.nodes[-1][START][0], "".join(audit)
        return self.last


def repaired(audit: str, roles: list[str], texts: list[str]) -> tuple[list[str], list[str]]:
    """Roles and texts after the edits."""
    out_roles, out_texts, row, state = [], [], 0, START
    for edit in audit:
        text = "" if edit == "I" else texts[row]
        if edit != "D":
            out_roles.append(roles[row] if edit == "K" else "assistant" if state == USER else "user")
            out_texts.append(text)
            state = SYSTEM if state == START and out_roles[-1][:1] == "s" else NEXT[state]
        row += edit != "I"
    return out_roles, out_texts


def damaged(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and lost: rows damaged by a checksum of conversation and turn; a dropped row stays, marked as lost."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), kind.alias("kind"))
    rows = rows.withColumn("copy", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
    return rows.select(
        "conv_id",
        "turn",
        F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        (F.col("kind") == 0).alias("lost"),
    )


def signatures(turns: DataFrame, lost: Column | None = None) -> DataFrame:
    """A row for each conversation: counts of its faults, its signature and its turns in order. Rows that are lost only name theirs."""
    rows = turns.select(
        "conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"), F.coalesce(lost if lost is not None else F.lit(False), F.lit(False)).alias("lost")
    )
    order = Window.partitionBy("conv_id").orderBy("lost", F.asc_nulls_first("turn"), "role", "text")
    # Both windows and the grouping hold on one partitioning, that by conversation.
    rows = rows.withColumns({"pos": F.row_number().over(order), "initial": F.substring("role", 1, 1)})
    rows = rows.withColumn("before", F.lag("initial").over(Window.partitionBy("conv_id").orderBy("pos")))
    rows = rows.withColumn("again", F.row_number().over(Window.partitionBy("conv_id", "lost", "role", "text").orderBy("pos")) > 1)
    end = F.rtrim(F.col("text"), F.lit(BLANKS))
    fault = F.when(end == "", "blank").when(F.col("again"), "duplicate").when(~F.right(end, F.lit(1)).isin(".", "!", "?"), "truncated").otherwise("none")
    rows = rows.withColumn("fault", fault)
    letter = F.when(F.col("initial").isin("s", "u", "a"), F.col("initial")).otherwise("o")
    symbol = F.when(F.col("fault").isin("blank", "duplicate"), "x").when(F.col("fault") == "truncated", F.upper(letter)).otherwise(letter)
    here = ~F.col("lost")
    count = lambda c: F.count_if(here & c).alias
    each = F.when(here, F.struct("pos", symbol.alias("symbol"), "role", "text"))
    numbers = F.when(here, F.col("turn"))
    chats = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(numbers) - F.min(numbers) + 1 - F.size(F.collect_set(numbers)), F.lit(0)).cast("long").alias("gaps"),
        *[count(F.col("fault") == f)(f) for f in ("blank", "duplicate", "truncated")],
        count(F.col("before").isNotNull() & ~F.concat("before", "initial").isin("su", "ua", "au"))("illegal"),
        F.array_sort(F.collect_list(each)).alias("turns"),
    )
    return chats.withColumn("signature", F.array_join(F.transform("turns", lambda t: t.symbol), ""))


def repair(turns: DataFrame, lost: Column | None = None) -> DataFrame:
    """conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit and repaired array<struct<role, text>> of each conversation.

    turns: conv_id, turn, role, text.
    """
    bounded_batches(turns.sparkSession)
    space = Workspace(turns.sparkSession, "repair")
    chats = space.written(signatures(turns, lost), "signatures")
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal"]
    added = T.StructType.fromDDL("cost long, audit string, repaired array<struct<role:string,text:string>>")
    schema = T.StructType([*[chats.schema[c] for c in ("conv_id", *counts)], *added.fields])
    made_type = to_arrow_type(added["repaired"].dataType)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        endings = Endings()
        for batch in batches:
            own = batch.column(batch.schema.get_field_index("turns"))
            roles, texts = (own.flatten().field(c).to_pylist() for c in ("role", "text"))
            costs, audits, made, at = [], [], [], 0
            for signature in batch.column(batch.schema.get_field_index("signature")).to_pylist():
                cost, audit = endings.best(signature)
                costs.append(cost)
                audits.append(audit)
                there = slice(at, at + len(signature))
                made.append([{"role": r, "text": t} for r, t in zip(*repaired(audit, roles[there], texts[there]), strict=True)])
                at += len(signature)
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(batch.schema.get_field_index(c)) for c in ("conv_id", *counts)], pa.array(costs, pa.int64()), pa.array(audits, pa.string()), pa.array(made, made_type)], names=schema.names
            )

    ending = F.reverse("signature")
    dealt = chats.withColumn("_ending", ending).repartitionByRange(F.left("_ending", F.lit(DEALT_BY)), F.col("conv_id")).sortWithinPartitions("_ending")
    return space.finish(dealt.select("conv_id", *counts, "turns", "signature").mapInArrow(run, schema))
