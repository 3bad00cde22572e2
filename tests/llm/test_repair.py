"""Conversation repair against a search over all edits, turn by turn from the end."""

import hashlib
import random
import sys
import zlib
from functools import lru_cache

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from litsieve.llm import repair

WHITE = " \t\n\x0b\x0c\r"
sys.setrecursionlimit(20_000)  # the search below goes as deep as a conversation is long


def plain(rows):
    """What ``Repair`` tells of one conversation's rows (turn, role, text), by the law as it is written."""
    rows = sorted(((t, r if r is not None else " ", x if x is not None else " ") for t, r, x in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, faults = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    def follows(done, initial):
        """Whether a role may come behind the initials so far; only the last one and whether any is there count."""
        return {"s": done == "", "u": done in ("", "s", "a"), "a": done == "u"}.get(initial, False)

    @lru_cache(None)
    def best(i, last, put):
        """(cost, audit, lines) of the cheapest way on, ``put`` turns just put in."""
        ways = []
        if i == len(rows) and last in ("", "a"):
            ways.append((0, "", ()))
        if put < 3:
            for role in ("user", "assistant"):
                if follows(last, role[0]):
                    c, a, lines = best(i, role[0], put + 1)
                    ways.append((c + 2, "I" + a, (f"{role}:", *lines)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, lines = best(i + 1, last, 0)
            ways.append((c + 3, "D" + a, lines))
            if faults[i] not in ("blank", "duplicate"):
                extra = faults[i] == "truncated"
                for new, cost, letter in [(role, 0, "K"), ("user", 2, "R"), ("assistant", 2, "R")]:
                    if follows(last, new[:1]):
                        c, a, lines = best(i + 1, new[0], 0)
                        ways.append((c + cost + extra, letter + a, (f"{new}:{text}", *lines)))
        return min(ways, default=(10**9, "", ()))

    cost, audit, lines = best(0, "", 0)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def table(rnd, n=25):
    roles = ["user", "assistant", "system", "tool", "", None, "user", "assistant", "user", "assistant"]
    texts = ["Yes.", "No!", "well", "", " \n", None, "é?", "same.", "a\x1c", "Long one. " * 3, "x.\n\n", "..\x85"]
    rows = []
    for conv in [None, *range(n)]:
        kind = rnd.random()
        for turn in range(rnd.choice([1, 2, 4, 7, 11])):
            role = rnd.choice(roles) if kind < 0.5 else ["user", "assistant"][turn % 2]
            text = rnd.choice(texts) if kind < 0.7 else f"turn {turn}."
            rows.append((conv, rnd.choice([turn, turn, turn, None, turn * 3]), role, text))
    return rows + rows[:6] + rows[3:5]


def told(spark, rows, **sizes):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({c: F.lit("x") for c in ("n", "place", "block", "conv", "kind", "first", "whole")})
    fixed = repair.Repair(df.repartition(3), **sizes)
    digests = {r.conv: r.sha256 for r in fixed.digests().collect()}
    none = hashlib.sha256(b"").hexdigest()
    faults = {r.conv: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, digests.get(r.conv, none)) for r in fixed.faults().collect()}
    return faults, fixed


@pytest.mark.parametrize("sizes", [{}, {"stretch": 3, "fan": 2}])
def test_repair_against_brute_force(spark, sizes):
    rows = table(random.Random(len(sizes)))
    found, fixed = told(spark, rows, **sizes)
    groups = {}
    for conv, *rest in rows:
        groups.setdefault("" if conv is None else str(conv), []).append(tuple(rest))
    assert found == {conv: plain(part) for conv, part in groups.items()}
    lines = {}
    for r in fixed.turns().orderBy("block", "position").collect():
        lines.setdefault(r.conv, []).append(f"{r.role}:{r.text}")
    assert {c: hashlib.sha256("\n".join(x).encode()).hexdigest() for c, x in lines.items()} == {c: f[-1] for c, f in found.items() if c in lines}


def test_long_and_hot_conversations(spark):
    rnd = random.Random(9)
    one = [(7, t, rnd.choice(["user", "assistant"]), rnd.choice(["ok.", f"turn {t}", f"turn {t}!", ""])) for t in range(400)]
    rows = one + [(8, 0, "user", "copy.")] * 300 + [(9, 1, "user", "w " * 300_000 + "."), (9, 2, "assistant", "y" * 200_000)]
    found, _ = told(spark, rows, stretch=16, fan=3)
    for conv in (7, 8, 9):
        assert found[str(conv)] == plain([r[1:] for r in rows if r[0] == conv])


def test_empty_tables(spark):
    assert told(spark, [])[0] == {}


def test_batches_end_where_stretches_do(monkeypatch):
    rnd = random.Random(2)
    rows = [(f"c{i // 7}", i // 3, i, rnd.choice([0, 4, 8, 12, 6, 5, 9]), rnd.choice([1, 1, 3])) for i in range(90)]
    batch = pa.RecordBatch.from_pylist([dict(zip(("conv", "block", "place", "kind", "n"), r, strict=True)) for r in rows])
    whole = pa.Table.from_batches(repair._walk_all(iter([batch]))).to_pylist()
    monkeypatch.setattr(repair, "BATCH", 8)
    cut = pa.Table.from_batches(repair._walk_all(iter([batch.slice(0, 31), batch.slice(31, 2), batch.slice(33)]))).to_pylist()
    assert cut == whole and sum(r["turns"] for r in whole) == sum(r[4] for r in rows)


def test_damage(spark):
    rows = [(c, t, "assistant", f"Well {c}. Or? {t}!") for c in (1, 2, None) for t in (*range(60), None)]
    rows += [(3, 1, None, None)]
    got = sorted(((r.conv_id, r.turn, r.role, r.text) for r in repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("hit", F.lit(1))).collect()), key=str)
    want = []
    for c, t, role, text in rows:
        key = f"{' ' if c is None else c}:{' ' if t is None else t}"
        hit = zlib.crc32(key.encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        text = {1: "", 2: "".join(x for x in text if x not in ".!?")}.get(hit, text)
        want += [(c, t, "user" if hit == 4 else role, text)] * {0: 0, 3: 2}.get(hit, 1)
    assert got == sorted(want, key=str)


def test_query_has_every_conversation(spark):
    sf = "/root/testdata/sf0.001"
    rows = repair.op11_conversation_repair(spark, sf).collect()
    ids = [r.conv_id for r in rows]
    assert len(ids) == len(set(ids)) and set(ids) == {r.conv_id for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id").collect()}
