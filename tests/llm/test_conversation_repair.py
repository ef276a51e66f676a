import hashlib
import itertools
import os
import random
import re
import sys
import zlib

from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(__file__))
from helpers import rows_of, sql_rows  # noqa: E402

from drawpool.llm import conversation_repair as R  # noqa: E402
from drawpool.llm import oracle, queries  # noqa: E402

SF = "/root/testdata/sf0.001"
SPACE = " \t\n\x0b\x0c\r"


def test_query_equals_sql(spark):
    assert rows_of(queries.op12_conversation_repair(spark, SF)) == sql_rows(oracle.SQL["op12_conversation_repair"], {"conversations": f"{SF}/conversations.parquet"})


def _all_edits(codes):
    """Cheapest (cost, audit) by trying every string of edits with up to two
    inserts in a row."""
    best = None
    grow = re.compile("(s?(ua)*u?)$")
    def go(i, out, cost, audit, inserts):  # noqa: E306
        nonlocal best
        if best is not None and cost > best[0]:
            return
        if i == len(codes) and re.fullmatch("(s?(ua)+)?", out):
            best = min(best or (cost, audit), (cost, audit))
        if inserts < 2:
            for r in "ua":
                if grow.fullmatch(out + r):
                    go(i, out + r, cost + 3, audit + "I", inserts + 1)
        if i == len(codes):
            return
        c = codes[i]
        go(i + 1, out, cost + 4, audit + "D", 0)
        if c == "d":
            return
        more = 3 * (c in "SUA!")
        if c.lower() in "sua" and grow.fullmatch(out + c.lower()):
            go(i + 1, out + c.lower(), cost + more, audit + "K", 0)
        for r in "ua":
            if grow.fullmatch(out + r):
                go(i + 1, out + r, cost + 3 + more, audit + "R", 0)
    go(0, "", 0, "", 0)
    return best


def test_least_numbers_against_every_edit():
    for n in range(4):
        for codes in itertools.product("suaSUA?!d", repeat=n):
            assert R.solve("".join(codes)) == _all_edits(codes), codes
    rng = random.Random(4)
    for _ in range(150):
        codes = "".join(rng.choice("suauauaSUA?d") for _ in range(rng.randrange(4, 7)))
        assert R.solve(codes) == _all_edits(codes), codes


def test_runs_give_the_same_as_the_whole():
    rng = random.Random(6)
    for _ in range(300):
        codes = "".join(rng.choice("suauauuuaaSUA?!d") for _ in range(rng.randrange(1, 60)))
        chain, at = R.Chain(), 0
        while at < len(codes):
            n = rng.randrange(1, 9)
            chain.add(R.run_matrix(codes[at:at + n]))
            at += n
        assert chain.end() == R.solve(codes), codes


def _brute(rows):
    """The contract over plain lists."""
    sp = lambda v: " " if v is None else str(v)
    convs = {}
    for c, turn, role, text in rows:
        out = convs.setdefault(c, [])
        k = zlib.crc32(f"{sp(c)}:{sp(turn)}".encode()) % 20
        role, text = sp(role), sp(text)
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        out += [(turn, "user" if k == 4 else role, text)] * (0 if k == 0 else 2 if k == 3 else 1)
    res = []
    for c, out in convs.items():
        out.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, codes, count = set(), "", {"blank": 0, "duplicate": 0, "truncated": 0}
        for _, role, text in out:
            dense = text.strip(SPACE)
            fault = "blank" if not dense else "duplicate" if (role, text) in seen else "truncated" if dense[-1] not in ".!?" else None
            seen.add((role, text))
            if fault:
                count[fault] += 1
            i = role[:1] if role[:1] in ("s", "u", "a") else "?"
            codes += "d" if fault in ("blank", "duplicate") else i.upper().replace("?", "!") if fault else i
        cost, audit = R.solve(codes)
        parts, i, state = [], 0, ""
        for x in audit:
            other = "assistant" if state == "u" else "user"
            role, text = (other, "") if x == "I" else (out[i][1] if x == "K" else other, out[i][2])
            i += x != "I"
            if x != "D":
                parts.append(f"{role}:{text}")
                state = role[0]
        turns = [t for t, _, _ in out if t is not None]
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
        res.append((c, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, count["blank"], count["duplicate"], count["truncated"], illegal, cost, audit,
                    hashlib.sha256("\n".join(parts).encode()).hexdigest()))
    return sorted(map(str, res))


def _table(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y", None) for r in rows],
                                 "conv_id bigint, turn bigint, role string, text string, code int, key string, copies string, long_id bigint")


def _rows(rng, convs, n):
    text = lambda: rng.choice(["Yes.", "No", "Why?", " ", "", "a b. ", "é!\n", "x. ", "Yes.", None, "long " * 50 + "."])
    role = lambda: rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Uma", "sys"])
    return [(rng.choice(convs), rng.choice([None, *range(12)]), role(), text()) for _ in range(n)]


def test_odd_rows_against_brute_force(spark):
    rng = random.Random(8)
    rows = _rows(rng, [None, *range(60)], 600) + [(100, 5, "user", "x" * 200_000), (101, None, None, None), (-3, -9, "user", "a"), (-3, 9, "assistant", "b.")]
    rows += [(c, t, "user", "Only.") for c in range(200, 260) for t in [3]]  # some of these are dropped whole
    assert sorted(map(str, map(tuple, R.repair(_table(spark, rows)).collect()))) == _brute(rows)


def test_long_conversations_in_runs(spark):
    rng = random.Random(9)
    rows = _rows(rng, [1, 2, None, 4], 900) + [(7, 2, "user", "same.")] * 700 + _rows(rng, list(range(20, 30)), 60)
    rows += [(8, t, rng.choice(["user", "assistant"]), f"turn {t}" + rng.choice([".", ""])) for t in range(500)]
    for long, part in ((50, 120), (7, 40)):
        got = R.repair(_table(spark, rows).repartition(5), long, part)
        assert sorted(map(str, map(tuple, got.collect()))) == _brute(rows)


def test_hot_conversation_is_not_gathered(spark):
    rows = spark.range(30_000).select(F.lit(None).cast("bigint").alias("conv_id"), F.col("id").alias("turn"),
                                      F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("t"), F.col("id").cast("string"), F.lit(".")).alias("text"))
    r = R.repair(rows).collect()
    assert len(r) == 1 and len(r[0].audit) > 25_000 and r[0].duplicate > 1000


def test_empty_table(spark):
    assert R.repair(_table(spark, [])).count() == 0
