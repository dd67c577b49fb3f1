"""Conversation repair against a brute-force version."""

import hashlib
import random
import re
import zlib
from collections import defaultdict
from functools import cache

import duckdb
import pytest
from pyspark.sql import functions as F

from lumen.llm import op11_conversations as op

ROWS = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\v\f\r"


def brute_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if d == 0:
            continue
        text = "" if d == 1 else re.sub("[.!?]", "", text) if d == 2 else text
        out += [(conv, turn, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    return out


def all_cheapest(rows):
    """Cost and every cheapest audit, by trying all edits; rows: (role initial, truncated, gone)."""
    follows = {"": "us", "s": "u", "u": "a", "a": "u"}

    @cache
    def rest(i, state, inserts):
        found = defaultdict(set)
        if i == len(rows) and state in ("", "a"):
            found[0].add("")
        if inserts < 3:
            for role in "ua":
                if role in follows[state]:
                    cost, audits = rest(i, role, inserts + 1)
                    found[cost + 5] |= {"I" + a for a in audits}
        if i < len(rows):
            initial, cut, gone = rows[i]
            ways = [("D", state, 2)]
            if not gone:
                ways += [("K", initial, 5 * cut)] if initial and initial in follows[state] else []
                ways += [("R", role, 1 + 5 * cut) for role in "ua" if role in follows[state]]
            for letter, state_, price in ways:
                cost, audits = rest(i + 1, state_, 0)
                found[cost + price] |= {letter + a for a in audits}
        best = min((c for c, a in found.items() if a), default=10 ** 9)
        return best, frozenset(found[best])

    cost, audits = rest(0, "", 0)
    return cost, min(audits)


def brute(original, damaged, solve):
    groups = defaultdict(list)
    for conv, *row in damaged:
        groups[conv].append(row)
    out = {}
    for conv in {r[0] for r in original}:
        rows = sorted(groups[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).digest()))
        turns = [t for t, _, _ in rows if t is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, faults = set(), []
        for _, role, text in rows:
            bare = text.rstrip(SPACE)
            faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        heads = [r[1][:1] for r in rows]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:]))
        cost, audit = solve(tuple((h, f == "truncated", f in ("blank", "duplicate")) for h, f in zip(heads, faults)))
        lines, left, state = [], list(rows), ""
        for letter in audit:
            _, role, text = (None, None, "") if letter == "I" else left.pop(0)
            if letter != "D":
                role = role if letter == "K" else "assistant" if state == "u" else "user"
                lines.append(f"{role}:{text}")
                state = role[0]
        assert not left and re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in lines))
        out[conv] = (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit,
                     hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


COLUMNS = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def result(df):
    assert df.columns == COLUMNS
    rows = df.collect()
    got = {r[0]: tuple(r)[1:] for r in rows}
    assert len(got) == len(rows)
    return got


def codes(rows):
    return [{"s": 1, "u": 2, "a": 3}.get(i, 0) | (4 if cut else 0) | (8 if gone else 0) for i, cut, gone in rows]


def random_rows(rng, n):
    return tuple((rng.choice("suaux"), rng.random() < 0.2, rng.random() < 0.2) for _ in range(n))


def test_integers_give_the_cheapest_least_audit():
    rng = random.Random(4)
    for k in range(1500):
        rows = random_rows(rng, k % 9)
        want = all_cheapest(rows)
        assert op.cheapest(codes(rows)) == want
        cut = rng.randint(0, len(rows))
        tables = [op.table_of(codes(rows[:cut])), op.table_of(codes(rows[cut:]))]
        assert op.answer(op.compose_all(tables)) == want
        assert op.answer(op.compose_all([op.table_of([c]) for c in codes(rows)])) == want


def test_no_cheapest_path_inserts():
    rng = random.Random(8)
    for _ in range(300):
        rows = random_rows(rng, 60)
        cost, audit = op.cheapest(codes(rows))
        assert "I" not in audit and op.answer(op.compose_all([op.table_of(codes(rows[i:i + 7])) for i in range(0, 60, 7)])) == (cost, audit)
    assert op.answer(op.compose_all([op.table_of(codes([("u", False, False)])), op.deletions(5),
                                     op.table_of(codes([("a", False, False)]))])) == (10, "KDDDDDK")


def test_inserted_turns_are_hashed():
    r = op.Repaired(1, "KIKDRI")
    for role, text in (("user", "a."), ("unit", "b?"), ("x", "gone"), ("tool", "c!")):
        r.row(role, text)
    lines = "user:a.\nassistant:\nunit:b?\nassistant:c!\nuser:"
    assert r.digest() == hashlib.sha256(lines.encode()).hexdigest()


def test_query_equals_brute_force(spark, small_dir):
    rows = duckdb.sql(f"select conv_id, turn, role, text from '{small_dir}/conversations.parquet'").fetchall()
    want = brute(rows, brute_damage(rows), all_cheapest)
    assert result(op.op11_conversations(spark, small_dir)) == want
    assert any(v[5] for v in want.values()) and any("R" in v[6] for v in want.values())


def awkward():
    rng = random.Random(2)
    roles = ["system", "user", "assistant", "tool", "", None, "User", "übel"]
    texts = ["Yes.", "No!", "Why?", "cut off", "", None, " \t\n", "tail. \n", "é…", ". x", "long " * 5000 + "."]
    rows = [(c, rng.choice([None, *range(-2, 9)]), rng.choice(roles), rng.choice(texts)) for c in [*range(40), None] for _ in range(rng.randint(1, 7))]
    return rows + rows[:30] + [(99, None, "user", "x")] * 3


def test_awkward_conversations(spark):
    rows = awkward()
    df = spark.createDataFrame(rows, ROWS).withColumn("n", F.lit(3)).withColumn("h", F.lit("x")).repartition(6)
    want = brute(rows, brute_damage(rows), all_cheapest)
    assert any(not v[6] for v in want.values())
    assert result(op.repair(op.damage(df))) == want
    assert result(op.repair(op.damage(df.limit(0)))) == {}


@pytest.mark.parametrize("partitions", [1, 7])
def test_a_conversation_over_many_tasks(spark, partitions):
    """One conversation of most rows, longer than a block and spread over tasks; one text that fills another."""
    rng = random.Random(3)
    rows = [(5, t, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice(["Fine.", "cut", f"Text {t}."]))
            for t in range(3000)] + [(c, t, "user" if t % 2 else "assistant", f"{c} {t}.") for c in (4, 6) for t in range(5)]
    rows += [(7, 1, "user", "Again.")] * 2500 + [(7, 2, "assistant", "Once.")] + [(8, t, "user", "Same.") for t in range(1500)]
    damaged = brute_damage(rows)

    def by_blocks(faults):
        return op.answer(op.compose_all([op.table_of(codes(faults[i:i + 50])) for i in range(0, len(faults), 50)]))

    before = spark.conf.get("spark.sql.shuffle.partitions"), spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = result(op.repair(op.damage(spark.createDataFrame(rows, ROWS).repartition(4))))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before[0])
        spark.conf.set("spark.sql.adaptive.enabled", before[1])
    assert got == brute(rows, damaged, by_blocks)
