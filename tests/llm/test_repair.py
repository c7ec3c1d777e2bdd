import functools
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from attestra.llm import repair

LEGAL = re.compile("(s?(ua)+)?$")


def cheapest(signature):
    """Least cost and least audit by trying edits in every order, with strings of roles instead of states."""

    @functools.cache
    def go(at, made):
        out = [(0, "")] if at == len(signature) and LEGAL.match(made) else []
        if at < len(signature):
            c, rest = signature[at], []
            rest.append((2, "D", made))
            if c != "x":
                extra = 5 if c.isupper() else 0
                rest.append((extra, "K", made + c.lower()))
                rest += [(1 + extra, "R", made + x) for x in "ua"]
            for cost, edit, now in rest:
                if alive(now):
                    out += [(cost + a, edit + b) for a, b in [go(at + 1, short(now))] if a < 10**6]
        # Two insertions in a row are enough between turns, as more would only repeat a pair.
        for x in ("u", "a", "ua", "au"):
            if alive(made + x) and (at, x, made) not in busy:
                busy.add((at, x, made))
                a, b = stay(at, short(made + x))
                out.append((5 * len(x) + a, "I" * len(x) + b))
                busy.discard((at, x, made))
        return min(out, default=(10**6, ""))

    @functools.cache
    def stay(at, made):
        """As go, without a further insertion at this place."""
        out = [(0, "")] if at == len(signature) and LEGAL.match(made) else []
        if at < len(signature):
            c, ways = signature[at], [(2, "D", made)]
            if c != "x":
                extra = 5 if c.isupper() else 0
                ways += [(extra, "K", made + c.lower()), (1 + extra, "R", made + "u"), (1 + extra, "R", made + "a")]
            for cost, edit, now in ways:
                if alive(now):
                    a, b = go(at + 1, short(now))
                    out.append((cost + a, edit + b))
        return min(out, default=(10**6, ""))

    busy = set()
    alive = lambda made: bool(re.match("(s?((ua)*u?))$", made))
    # Only the beginning and the last role matter from here on.
    short = lambda made: made if len(made) < 3 else ("s" if made[0] == "s" else "") + ("ua" if made[-1] == "a" else "u")
    return go(0, "")


def test_every_short_signature():
    endings, n = repair.Endings(), 0
    every = ["".join(s) for k in range(5) for s in itertools.product("xsuaoSUAO", repeat=k)]
    for s in sorted(every, key=lambda s: s[::-1]):
        assert endings.best(s) == cheapest(s), s
        n += 1
    # Every ending is worked out once.
    assert endings.made == n - 1


def test_longer_signatures_in_any_order():
    rng, endings = random.Random(5), repair.Endings()
    for _ in range(400):
        s = "".join(rng.choice("uauauaxsoUAS") for _ in range(rng.randint(5, 14)))
        assert endings.best(s) == cheapest(s), s


def brute(rows):
    """Rows (conv_id, turn, role, text, lost) to results, by loops."""
    out = {}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv and not r[4]), key=lambda r: (r[1] is not None, r[1] or 0, r[2] or " " * (r[2] is None), r[3] or " " * (r[3] is None)))
        seen, signature, faults, pairs = set(), "", [], []
        for _, _, role, text, _ in own:
            role, text = " " if role is None else role, " " if text is None else text
            stripped = text.rstrip(" \t\n\x0b\f\r")
            fault = "blank" if not stripped else "duplicate" if (role, text) in seen else "truncated" if stripped[-1] not in ".!?" else ""
            seen.add((role, text))
            faults.append(fault)
            pairs.append((role, text))
            letter = role[:1] if role[:1] in ("s", "u", "a") else "o"
            signature += "x" if fault in ("blank", "duplicate") else letter.upper() if fault else letter
        cost, audit = cheapest(signature)
        made, k = [], 0
        for e in audit:
            if e != "D":
                after_user = bool(made) and made[-1][0][:1] == "u"
                made.append(pairs[k] if e == "K" else ("assistant" if after_user else "user", "" if e == "I" else pairs[k][1]))
            k += e != "I"
        initials = "".join(r[:1] for r, _ in made)
        assert LEGAL.match(initials)
        turns = [r[1] for r in own if r[1] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(pairs))
        out[conv] = (gaps, *[faults.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, made)
    return out


def results(df):
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, [tuple(t) for t in r.repaired]) for r in df.collect()}


ROWS = "conv_id long, turn long, role string, text string, lost boolean"


def test_conversations_by_brute_force(spark):
    rng = random.Random(3)
    texts = ["Yes.", "No!", "Why?", "cut off", "", " \n", "Fine. ", "ends.\x0b", "nbsp. ", None]
    rows = []
    for conv in [None, *range(120)]:
        for turn in range(rng.randint(1, 8)):
            rows.append((conv, rng.choice([turn, turn, turn + 3, None]), rng.choice(["user", "assistant", "assistant", "user", "system", "tool", "", None]), rng.choice(texts), rng.random() < 0.15))
    rows += [(500, 1, "user", "gone.", True), (501, 0, "user", "Same.", False), (501, 0, "user", "Same.", False), (502, 7, "system", "Only.", False)]
    assert results(repair.repair(spark.createDataFrame(rows, ROWS), F.col("lost"))) == brute(rows)


def test_damage(spark):
    rows = [(c, t, "assistant", f"a.b!{t}?") for c in range(40) for t in range(6)] + [(None, None, None, None)]
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()
    by = {}
    for r in got:
        by.setdefault((r.conv_id, r.turn), []).append((r.role, r.text, r.lost))
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = role or " ", text or " "
        want = ("user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text, kind == 0)
        assert by[c, t] == [want] * (2 if kind == 3 else 1)


def test_edges(spark):
    """Empty tables, columns of other names, one long conversation, many that are alike."""
    assert repair.repair(spark.createDataFrame([], ROWS)).count() == 0
    plain = spark.createDataFrame([(1, 0, "user", "Hi.", False), (1, 1, "assistant", "cut", False), (1, 2, "user", "So?", False), (1, 3, "assistant", "Yes.", False)], ROWS)
    own = plain.select("*", *[plain.role.alias(c) for c in ("pos", "turns", "signature", "cost", "audit", "repaired", "fault", "initial", "before", "again")])
    assert results(repair.repair(own)) == results(repair.repair(plain)) == {1: (0, 0, 0, 1, 0, 4, "DDKK", [("user", "So?"), ("assistant", "Yes.")])}
    n = 20_000
    long = spark.range(n).select(F.lit(1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"))
    r = repair.repair(long).first()
    assert (r.cost, r.audit, len(r.repaired)) == (0, "K" * n, n)
    alike = spark.range(9_000).select((F.col("id") / 3).cast("long").alias("conv_id"), (F.col("id") % 3).alias("turn"), F.lit("user").alias("role"), (F.col("id") % 3).cast("string").alias("text"))
    assert {(r.cost, r.audit) for r in repair.repair(alike).collect()} == {cheapest("UUU")}
