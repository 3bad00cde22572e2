"""Conversation structure repair: the cheapest edits that make the turns of a conversation alternate.

Allowed are an optional system turn and then user and assistant in turn, ending with the assistant.  The
turns of all conversations are put in order by ranges, cut into stretches of at most ``STRETCH`` turns and dealt
by the hash of conversation and stretch.  In a task DuckDB runs one recursive query over a batch of stretches:
each recursion advances one turn in all of them and keeps, for each state of the grammar, the least cost and
of equal ones the least audit.

A conversation may hold any share of all rows, so a stretch is walked from each state that it may begin in, and
the stretches of a long conversation are joined, up to ``FAN`` neighbours at a time, as (begin, end) tables.
Keeping the least audit is exact: audits of equal cost over the same turns are never one the beginning of
the other, so what follows cannot turn their order.  The chosen audit is then dealt back to the stretches,
which write their repaired turns side by side.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litsieve.llm.common import park

#: Turns of a stretch, stretches joined at once, turns of a batch for DuckDB, characters of repaired text told at once.
STRETCH, FAN, BATCH, PIECE = 256, 64, 8192, 1 << 20
#: Costs of the edits, and of keeping or turning a truncated turn.
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, behind the system turn, behind a user turn, behind an assistant turn; initials of roles, "x" any other.
START, SYSTEM, USER, ASSISTANT = range(4)
INITIALS = "suax"
#: Where a turn of an initial leads.
LEADS = {"s": {START: SYSTEM}, "u": {START: USER, SYSTEM: USER, ASSISTANT: USER}, "a": {USER: ASSISTANT}}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"


def _inserts() -> list[tuple[int, int, int, str]]:
    """(from, to, cost, letters) of putting up to two turns in."""
    one = [(a, b, INSERT, "I") for c in "ua" for a, b in LEADS[c].items()]
    two = [(a, d, 2 * INSERT, "II") for a, b, _, _ in one for c, d, _, _ in one if b == c and d != a]
    return [*((a, a, 0, "") for a in range(4)), *one, *two]


def moves(kind: int) -> dict[tuple[int, int], tuple[int, str]]:
    """{(from, to): (cost, letters)} of one turn and what is put in before it; see ``kind_of``."""
    initial, must_go, truncated = INITIALS[kind // 4], bool(kind & 2), TRUNCATED * (kind & 1)
    best: dict[tuple[int, int], tuple[int, str]] = {}
    for a, at, cost, put in _inserts():
        edits = [(at, DELETE, "D")]
        if not must_go:
            edits += [(LEADS[c][at], (KEEP if c == initial else REROLE) + truncated, "K" if c == initial else "R") for c in {initial, "u", "a"} if at in LEADS.get(c, ())]
        for b, more, letter in edits:
            best[a, b] = min(best.get((a, b), (cost + more, put + letter)), (cost + more, put + letter))
    return best


#: What may follow the last turn: {state: (cost, letters)}.
CLOSING = {a: (cost, put) for a, b, cost, put in sorted(_inserts(), key=lambda m: -m[2]) if b == ASSISTANT or a == b == START}


# ---- turns in order ----------------------------------------------------------------------------------


def _known(conv_id: Column) -> Column:
    """The key of a conversation, never null."""
    return F.coalesce(conv_id.cast("string"), F.lit(""))


def ordered(turns: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """conv, turn, role, text, n (equal rows), place: the order of all turns, by conversation, turn (nulls first), role and text."""
    one = turns.select(_known(F.col("conv_id")).alias("conv"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c) for c in ("role", "text")), F.lit(1).cast("long").alias("n"))
    keys = ["conv", "turn", "role", "text"]
    equal = one.groupBy(*keys).agg(F.sum("n").alias("n"))
    placed = equal.repartitionByRange(*keys).sortWithinPartitions(*keys)
    return park(placed.withColumn("place", F.monotonically_increasing_id()), "turns").df.withColumn("block", F.floor(F.col("place") / stretch).cast("long"))


def judged(rows: DataFrame) -> DataFrame:
    """conv, turn, block, place, n, blank, first, truncated and kind of ``ordered`` rows, without their texts.

    ``first``: no earlier row has this role and text.  The earliest one of each is found by a grouping and met again by
    its own key, which no two rows share, so a text that fills a conversation is no hot key.
    """
    bare = F.rtrim(F.col("text"), F.lit(BLANKS))
    said = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")))
    initial = F.substr(F.col("role"), F.lit(1), F.lit(1))
    slim = rows.select(
        "conv", "turn", "block", "place", "n", said.alias("said"),
        (F.length(bare) == 0).alias("blank"),
        (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("truncated"),
        F.coalesce(F.array_position(F.array(*map(F.lit, INITIALS[:3])), initial).cast("int") - 1, F.lit(-1)).alias("initial"),
    )
    first = slim.groupBy("conv", "said").agg(F.min("place").alias("place"), F.lit(True).alias("first"))
    slim = slim.join(first, ["conv", "said", "place"], "left").withColumn("first", F.coalesce("first", F.lit(False)))
    must_go = F.col("blank") | ~F.col("first")
    kind = 4 * F.when(F.col("initial") < 0, len(INITIALS) - 1).otherwise(F.col("initial")) + 2 * must_go.cast("int") + (~must_go & F.col("truncated")).cast("int")
    return slim.withColumn("kind", kind.cast("int")).drop("said", "initial")


# ---- stretches ---------------------------------------------------------------------------------------

PATHS = "array<struct<start: int, state: int, cost: long, audit: string>>"
STRETCHES = f"conv string, block long, turns long, illegal long, first int, last int, paths {PATHS}"

_WALK = f"""
WITH RECURSIVE walk(stretch, start, i, state, best) AS (
  SELECT s.stretch, b.start, CAST(0 AS BIGINT), b.start, {{'cost': CAST(0 AS BIGINT), 'audit': ''}} FROM stretches s, begins b
  UNION ALL
  SELECT w.stretch, w.start, t.i, m.b,
    min({{'cost': w.best.cost + m.cost + {DELETE} * (t.n - 1), 'audit': w.best.audit || m.letters || repeat('D', t.n - 1)}})
  FROM walk w JOIN turns t ON t.stretch = w.stretch AND t.i = w.i + 1 JOIN moves m ON m.kind = t.kind AND m.a = w.state
  GROUP BY w.stretch, w.start, t.i, m.b)
SELECT w.stretch, list({{'start': w.start, 'state': w.state, 'cost': w.best.cost, 'audit': w.best.audit}} ORDER BY w.start, w.state) AS paths
FROM walk w JOIN stretches s ON s.stretch = w.stretch AND s.n = w.i GROUP BY w.stretch"""
_SIDES = """
SELECT stretch, CAST(sum(n) AS BIGINT) AS turns, CAST(sum(n - 1 + coalesce(CAST(before || initial NOT IN ('su', 'ua', 'au') AS INTEGER), 0)) AS BIGINT) AS illegal,
  CAST(arg_min(kind, i) // 4 AS INTEGER) AS first, CAST(arg_max(kind, i) // 4 AS INTEGER) AS last
FROM (SELECT *, lag(initial) OVER (PARTITION BY stretch ORDER BY i) AS before FROM (SELECT *, substr('suax', kind // 4 + 1, 1) AS initial FROM turns))
GROUP BY stretch"""


def _walk_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "512MB"})
    table = [(k, a, b, cost, letters) for k in range(4 * len(INITIALS)) for (a, b), (cost, letters) in moves(k).items()]
    con.execute("CREATE TABLE moves(kind INTEGER, a INTEGER, b INTEGER, cost BIGINT, letters VARCHAR)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?)", table)
    con.execute(f"CREATE TABLE begins AS SELECT CAST(range AS INTEGER) AS start FROM range({ASSISTANT + 1})")

    def walked(frame: pd.DataFrame) -> pa.RecordBatch:
        stretch = frame.groupby(["conv", "block"], sort=False).ngroup()
        turns = pd.DataFrame({"stretch": stretch, "i": frame.groupby(stretch).cumcount() + 1, "kind": frame["kind"], "n": frame["n"]})
        stretches = turns.groupby("stretch", as_index=False).agg(n=("i", "max"))
        con.register("turns", turns)
        con.register("stretches", stretches)
        keys = frame.loc[~stretch.duplicated(), ["conv", "block"]].reset_index(drop=True)
        sides, paths = con.sql(_SIDES).df().set_index("stretch").sort_index(), con.sql(_WALK).to_arrow_table().sort_by("stretch")
        cols = [pa.array(keys["conv"], pa.string()), pa.array(keys["block"], pa.int64()), *(pa.array(sides[c], pa.int64() if c in ("turns", "illegal") else pa.int32()) for c in ("turns", "illegal", "first", "last"))]
        return pa.RecordBatch.from_arrays([*cols, paths.column("paths").combine_chunks()], names=["conv", "block", "turns", "illegal", "first", "last", "paths"])

    held: list[pd.DataFrame] = []
    for batch in batches:
        held.append(batch.to_pandas())
        while sum(map(len, held)) > BATCH:
            frame = pd.concat(held, ignore_index=True)
            # a batch ends where a stretch does
            last = frame.iloc[BATCH]
            stop = int(((frame["conv"] == last["conv"]) & (frame["block"] == last["block"])).to_numpy().argmax())
            yield walked(frame.iloc[:stop].reset_index(drop=True))
            held = [frame.iloc[stop:]]
    if sum(map(len, held)):
        yield walked(pd.concat(held, ignore_index=True))


def stretches(judged_rows: DataFrame) -> DataFrame:
    """One row for each (conv, block): its turns, illegal neighbours, first and last initial and cheapest paths."""
    dealt = judged_rows.select("conv", "block", "place", "kind", "n").repartition("conv", "block").sortWithinPartitions("conv", "block", "place")
    return dealt.mapInArrow(_walk_all, STRETCHES)


# ---- long conversations ------------------------------------------------------------------------------


def _table(paths) -> dict[tuple[int, int], tuple[int, str]]:
    return {(p["start"], p["state"]): (p["cost"], p["audit"]) for p in paths}


def _joined(frame: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring stretches as one; its number is the first one's for the moment."""
    frame = frame.sort_values("num")
    rows = list(frame.itertuples())
    best, illegal = _table(rows[0].paths), int(frame["illegal"].sum())
    for before, row in zip(rows, rows[1:]):
        illegal += INITIALS[before.last] + INITIALS[row.first] not in LEGAL
        further, found = _table(row.paths), {}
        for (a, m), (cost, audit) in best.items():
            for b in range(ASSISTANT + 1):
                if (m, b) in further:
                    more, rest = further[m, b]
                    old = found.get((a, b))
                    if old is None or cost + more <= old[0]:
                        new = (cost + more, audit + rest)
                        found[a, b] = new if old is None else min(old, new)
        best = found
    paths = [{"start": a, "state": b, "cost": cost, "audit": audit} for (a, b), (cost, audit) in best.items()]
    return pd.DataFrame({"conv": [rows[0].conv], "num": [rows[0].num], "block": [rows[0].block], "turns": [int(frame["turns"].sum())], "illegal": [illegal], "first": [rows[0].first], "last": [rows[-1].last], "paths": [paths]})


def _shared_out(parent: pd.DataFrame, children: pd.DataFrame) -> pd.DataFrame:
    """The audit of joined stretches dealt to each of them, with the state that it begins in."""
    audit, state, at, out = parent["audit"].iloc[0], int(parent["start"].iloc[0]), 0, []
    rows = list(children.sort_values("num").itertuples())
    for i, row in enumerate(rows):
        left, begun = row.turns, at
        if i == len(rows) - 1:
            at = len(audit)  # with what closes the conversation
        while left:
            # every letter but an insert is one turn
            more = audit[at : at + left]
            at, left = at + len(more), left - len(more) + more.count("I")
            if i == len(rows) - 1:
                break
        part = audit[begun:at]
        out.append((row.conv, row.num, row.block, state, part))
        if i < len(rows) - 1:
            state = next(p["state"] for p in row.paths if p["start"] == state and p["audit"] == part)
    return pd.DataFrame(out, columns=["conv", "num", "block", "start", "audit"])


def _closed(paths: Column) -> Column:
    """The cheapest way through a whole conversation: struct of cost and audit."""
    ends = F.filter(paths, lambda p: p["start"] == START)
    cost, letters = (F.create_map(*(F.lit(x) for s, c in CLOSING.items() for x in (s, c[i]))) for i in (0, 1))
    return F.array_min(F.transform(ends, lambda p: F.struct((p["cost"] + cost[p["state"]]).alias("cost"), F.concat(p["audit"], letters[p["state"]]).alias("audit"))))


def cheapest(cut: DataFrame, fan: int = FAN) -> tuple[DataFrame, DataFrame]:
    """(conversations, audits) of parked ``stretches``: conv, illegal, cost, audit; and conv, block, start, audit, whole of each stretch.

    Most conversations are one stretch.  The stretches of others are numbered and joined ``fan`` at a time, in as many
    rounds as the longest needs, and its audit goes back the same way.  A conversation's audit is one cell.
    """
    counts = cut.groupBy("conv").agg(F.count("*").alias("__parts"))
    cut = cut.join(counts, "conv")
    alone = cut.where("__parts = 1").withColumn("best", _closed(F.col("paths"))).select("conv", "block", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))
    number = (F.row_number().over(Window.partitionBy("conv").orderBy("block")) - 1).cast("long")
    long_ = cut.where("__parts > 1")
    # only (conv, block) is numbered: one row for every stretch of a conversation whose audit has to fit a cell
    level = long_.select("conv", "block").withColumn("num", number).join(long_, ["conv", "block"]).select("conv", "num", *(c for c in cut.columns if c not in ("conv", "__parts")))
    levels = [park(level, "stretches-0").df]
    schema = f"conv string, num long, block long, turns long, illegal long, first int, last int, paths {PATHS}"
    while (levels[-1].agg(F.max("num")).first()[0] or 0) > 0:
        joined = levels[-1].groupBy("conv", F.floor(F.col("num") / fan).alias("group")).applyInPandas(_joined, schema)
        levels.append(park(joined.withColumn("num", F.floor(F.col("num") / fan)), f"stretches-{len(levels)}").df)
    top = levels[-1].withColumn("best", _closed(F.col("paths"))).select("conv", "num", "illegal", F.col("best.cost").alias("cost"), F.col("best.audit").alias("audit"))
    told = top.select("conv", F.lit(0).cast("long").alias("num"), F.lit(START).alias("start"), "audit")
    for below in reversed(levels[:-1]):
        group = F.floor(F.col("num") / fan)
        told = told.groupBy("conv", F.col("num").alias("group")).cogroup(below.select("conv", "num", "block", "turns", "paths").groupBy("conv", group.alias("group"))).applyInPandas(_shared_out, "conv string, num long, block long, start int, audit string")
    parts = told.select("conv", "block", "start", "audit", F.lit(False).alias("whole")) if len(levels) > 1 else None
    audits = alone.select("conv", "block", F.lit(START).alias("start"), "audit", F.lit(True).alias("whole"))
    whole = alone.drop("block").unionByName(top.drop("num"))
    return whole, audits.unionByName(parts) if parts is not None else audits


# ---- repaired turns ----------------------------------------------------------------------------------


class _Replay:
    """The edits of one stretch, as its rows come by."""

    def __init__(self, audit: str, state: int):
        self._audit, self._at, self._state = audit, 0, state

    def _put_in(self) -> Iterator[tuple[str, str, str | None]]:
        while self._audit[self._at : self._at + 1] == "I":
            self._at += 1
            yield self._turned("I", "")

    def _turned(self, letter: str, text: str | None) -> tuple[str, str, str | None]:
        ask = self._state != USER
        self._state = USER if ask else ASSISTANT
        return letter, "user" if ask else "assistant", text

    def row(self, role: str, text: str, n: int) -> Iterator[tuple[str, str, str | None]]:
        """(edit, role, text) of a row of ``n`` equal turns; of those only the first can stay."""
        yield from self._put_in()
        letter = self._audit[self._at]
        self._at += n
        if letter == "R":
            yield self._turned("R", text)
        elif letter == "K":
            self._state = LEADS[role[:1]][self._state]
            yield "K", role, text

    def close(self) -> Iterator[tuple[str, str, str | None]]:
        yield from self._put_in()


def _replayed(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, bool, Iterator[tuple[str, str, str | None]]]]:
    """(conv, block, whole, turns) of sorted rows; each stretch begins with its audit and its turns are taken in order."""
    rows = (r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("conv", "block", "place", "role", "text", "n", "whole")), strict=True))
    row = next(rows, None)
    while row is not None:
        conv, block, _, _, audit, state, whole = row
        replay, after = _Replay(audit, state), []

        def turns(replay=replay, after=after) -> Iterator[tuple[str, str, str | None]]:
            for r in rows:
                if r[2] < 0:
                    after.append(r)
                    break
                yield from replay.row(r[3], r[4], r[5])
            yield from replay.close()

        walk = turns()
        yield conv, block, whole, walk
        for _ in walk:
            pass
        row = after[0] if after else None


def _told(columns: list[list], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = ["conv", "block", "position", "edit", "role", "text"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string()]
    out, size = [[] for _ in names], 0
    for conv, block, _, turns in _replayed(batches):
        for i, turn in enumerate(turns):
            for c, v in zip(out, (conv, block, i, *turn), strict=True):
                c.append(v)
            size += len(turn[2])
            if size > PIECE or len(out[0]) >= BATCH:
                yield _told(out, names, kinds)
                out, size = [[] for _ in names], 0
    yield _told(out, names, kinds)


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """conv, block, piece, text, sha256: the digest of a whole conversation, or the pieces of its stretches' lines."""
    names, kinds = ["conv", "block", "piece", "text", "sha256"], [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
    for conv, block, whole, turns in _replayed(batches):
        digest, lines, size, piece = hashlib.sha256(), [], 0, 0
        begun = False
        for _, role, text in turns:
            line = f"{role}:{text}"
            if whole:
                digest.update(("\n" * begun + line).encode())
            else:
                lines.append(line)
                size += len(line)
                if size > PIECE:
                    yield _told([[conv], [block], [piece], ["\n".join(lines)], [None]], names, kinds)
                    lines, size, piece = [], 0, piece + 1
            begun = True
        if whole:
            yield _told([[conv], [block], [0], [None], [digest.hexdigest()]], names, kinds)
        elif lines:
            yield _told([[conv], [block], [piece], ["\n".join(lines)], [None]], names, kinds)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The digests of conversations that come in pieces, in order."""
    conv, digest, done = None, None, [[], []]
    for batch in batches:
        for c, text in zip(batch.column("conv").to_pylist(), batch.column("text").to_pylist(), strict=True):
            if c == conv:
                digest.update(b"\n")
            else:
                if conv is not None:
                    done[0].append(conv)
                    done[1].append(digest.hexdigest())
                conv, digest = c, hashlib.sha256()
            digest.update(text.encode())
    if conv is not None:
        done[0].append(conv)
        done[1].append(digest.hexdigest())
    yield _told(done, ["conv", "sha256"], [pa.string(), pa.string()])


class Repair:
    """The repair of ``conversations`` (conv_id, turn, role, text), worked out once.

    Rows are taken by turn, nulls first, then by role and text; null roles and texts count as one blank, rows of a null
    conv_id are one conversation, and equal rows count as often as they are there.  A turn is blank (no character but
    white space), else a duplicate (role and text seen earlier), else truncated (its last character does not end a
    sentence).  A role counts by its first letter; an empty one cannot be kept.  Other columns are not read.
    """

    def __init__(self, conversations: DataFrame, stretch: int = STRETCH, fan: int = FAN):
        self._rows = ordered(conversations, stretch)
        self._judged = park(judged(self._rows), "judged").df
        self._cheapest, self._audits = cheapest(park(stretches(self._judged), "stretches").df, fan)

    def faults(self) -> DataFrame:
        """conv, gaps, blank, duplicate, truncated, illegal, cost, audit of every conversation with rows."""
        n, known = F.col("n"), F.col("turn")
        wide = lambda c: c.cast("decimal(20,0)")
        span = wide(F.max(known)) - wide(F.min(known)) + 1 - F.countDistinct(known)
        counts = self._judged.groupBy("conv").agg(
            F.when(span.isNull(), 0).otherwise(F.least(span, F.lit((1 << 63) - 1).cast("decimal(20,0)")).cast("long")).alias("gaps"),
            F.sum(F.when(F.col("blank"), n).otherwise(0)).alias("blank"),
            F.sum(F.when(~F.col("blank"), n - F.col("first").cast("long")).otherwise(0)).alias("duplicate"),
            F.sum((~F.col("blank") & F.col("first") & F.col("truncated")).cast("long")).alias("truncated"),
        )
        return counts.join(self._cheapest, "conv").select("conv", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")

    def _dealt(self) -> DataFrame:
        """The rows of each stretch behind its audit."""
        audits = self._audits.select("conv", "block", F.lit(-1).cast("long").alias("place"), F.lit(None).cast("string").alias("role"), F.col("audit").alias("text"), F.col("start").cast("long").alias("n"), "whole")
        rows = self._rows.select("conv", "block", "place", "role", "text", "n", F.lit(False).alias("whole"))
        return audits.unionByName(rows).repartition("conv", "block").sortWithinPartitions("conv", "block", "place")

    def turns(self) -> DataFrame:
        """The repaired turns: conv, block and position (their order), edit (K, R or I), role, text."""
        return self._dealt().mapInArrow(_turns, "conv string, block long, position long, edit string, role string, text string")

    def digests(self) -> DataFrame:
        """conv, sha256 of the repaired ``role:text`` lines; conversations of several stretches pass as pieces of text."""
        told = park(self._dealt().mapInArrow(_pieces, "conv string, block long, piece long, text string, sha256 string"), "repaired").df
        cut = told.where("sha256 is null").select("conv", "block", "piece", "text").repartition("conv").sortWithinPartitions("conv", "block", "piece")
        return told.where("sha256 is not null").select("conv", "sha256").unionByName(cut.mapInArrow(_hashed, "conv string, sha256 string"))


def damaged(conversations: DataFrame) -> DataFrame:
    """The rows that the query's law damages: dropped, emptied, without sentence marks, repeated, or the user's; by the row's CRC."""
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    hit = F.crc32(F.concat(blank("conv_id"), F.lit(":"), blank("turn"))) % 20
    text = F.when(hit == 1, F.lit("")).when(hit == 2, F.regexp_replace(blank("text"), "[.!?]", "")).otherwise(blank("text"))
    role = F.when(hit == 4, F.lit("user")).otherwise(blank("role"))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), hit.alias("__hit")).where("__hit <> 0")
    again = F.explode(F.when(F.col("__hit") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.withColumn("__again", again).drop("__hit", "__again")


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults, cost, audit and repaired digest of every conversation of ``conversations`` after damage."""
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    repair = Repair(damaged(rows))
    every = rows.select("conv_id").distinct().withColumn("conv", _known(F.col("conv_id")))
    told = every.join(repair.faults(), "conv", "left").join(repair.digests(), "conv", "left")
    counts = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return told.select("conv_id", *counts, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))


def _oracle() -> str:
    """The same by one recursive query over whole conversations; for small tables."""
    values = ", ".join(f"({k}, {a}, {b}, {cost}, '{letters}')" for k in range(4 * len(INITIALS)) for (a, b), (cost, letters) in moves(k).items())
    closing = ", ".join(f"({a}, {cost}, '{letters}')" for a, (cost, letters) in CLOSING.items())
    # what an audit letter writes depends on the state alone: behind a user the assistant, else the user
    return rf"""
WITH RECURSIVE crc AS MATERIALIZED (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS t FROM range(256) AS r(b)),
hit AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_transform(string_split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda x: CAST(ascii(x) AS BIGINT)),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) % 20 AS h FROM conversations, crc),
rows_ AS (SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
  CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN h = 3 THEN [0, 1] ELSE [0] END) AS copy FROM hit WHERE h <> 0),
placed AS MATERIALIZED (SELECT *, row_number() OVER w AS i, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST, copy) AS seen,
  CASE substr(role, 1, 1) WHEN 's' THEN 0 WHEN 'u' THEN 1 WHEN 'a' THEN 2 ELSE 3 END AS initial, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare
  FROM rows_ WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, copy)),
faulty AS MATERIALIZED (SELECT *, bare = '' AS blank, bare <> '' AND seen > 1 AS duplicate, bare <> '' AND seen = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS truncated,
  substr('suax', initial + 1, 1) AS letter FROM placed),
kinds AS MATERIALIZED (SELECT *, 4 * initial + 2 * CAST(blank OR duplicate AS INTEGER) + CAST(truncated AS INTEGER) AS kind, lag(letter) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM faulty),
moves(kind, a, b, cost, letters) AS (VALUES {values}),
closing(a, cost, letters) AS (VALUES {closing}),
counts AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (duplicate) AS duplicate,
  count(*) FILTER (truncated) AS truncated, count(*) FILTER (before || letter NOT IN ('su', 'ua', 'au')) AS illegal, count(*) AS n FROM kinds GROUP BY conv_id),
walk(conv_id, i, state, best) AS (SELECT conv_id, CAST(0 AS BIGINT), 0, {{'cost': 0, 'audit': '', 'told': ''}} FROM counts
  UNION ALL
  SELECT w.conv_id, k.i, m.b, min({{'cost': w.best.cost + m.cost, 'audit': w.best.audit || m.letters,
    'told': w.best.told || CASE left(m.letters, length(m.letters) - 1) WHEN 'I' THEN CASE w.state WHEN 2 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END
        WHEN 'II' THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE '' END
      || CASE right(m.letters, 1) WHEN 'K' THEN chr(10) || k.role || ':' || k.text WHEN 'R' THEN CASE m.b WHEN 3 THEN chr(10) || 'assistant:' ELSE chr(10) || 'user:' END || k.text ELSE '' END}})
  FROM walk w JOIN kinds k ON k.conv_id IS NOT DISTINCT FROM w.conv_id AND k.i = w.i + 1 JOIN moves m ON m.kind = k.kind AND m.a = w.state GROUP BY w.conv_id, k.i, m.b),
ends AS (SELECT w.conv_id, min({{'cost': w.best.cost + c.cost, 'audit': w.best.audit || c.letters,
    'told': w.best.told || CASE c.letters WHEN 'I' THEN chr(10) || 'assistant:' WHEN 'II' THEN chr(10) || 'user:' || chr(10) || 'assistant:' ELSE '' END}}) AS best
  FROM walk w JOIN counts n ON n.conv_id IS NOT DISTINCT FROM w.conv_id AND n.n = w.i JOIN closing c ON c.a = w.state GROUP BY w.conv_id)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(coalesce(e.best.cost, 0) AS BIGINT) AS cost, coalesce(e.best.audit, '') AS audit, sha256(coalesce(substr(e.best.told, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN counts n ON n.conv_id IS NOT DISTINCT FROM o.conv_id LEFT JOIN ends e ON e.conv_id IS NOT DISTINCT FROM o.conv_id"""


ORACLE = _oracle()
