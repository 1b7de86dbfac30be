"""Repair of the role structure of conversations by cheapest edits.

A repaired conversation has the role initials ``(s?(ua)+)?``. An automaton with four states (nothing yet, after s, after u, after a)
reads the turns; each turn is kept, given another role or deleted, and turns may be inserted before it. The cheapest
way is found by a recursive DuckDB query inside hash-partitioned batches: each recursion advances all conversations of
the batch by one turn and keeps, for each state, the least (cost, audit). Of two ways over the same turns with one cost neither audit begins
with the other (what is longer has more insertions and costs more), so the ASCII-least one stays so whatever follows.

For the same reason ways compose: a run of turns is a table of (state before, state after, cost, audit). Conversations are therefore cut into
pieces of at most ``PIECE`` turns, in whose batches all states before are tried where the piece may stand inside a conversation. Pieces are joined by the same recursion, ``PIECE`` at
a time, until each conversation has one. So a conversation with a third of all turns is no large group: its turns are put in order by range partitions,
repeated turns are found by aggregating a hash and joined by place, and only its answer (an audit as long as itself) and the hash of its repaired text,
which is sequential by definition, pass through one task; that one streams.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import product

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from strandloom.llm.common import cut, slices

#: Turns of a piece, and pieces joined at once; turns (steps) of a batch, about.
PIECE = 64
BATCH_ROWS = 32_768
#: States of the grammar: nothing yet, after system, after user, after assistant; and where each role leads.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
NO_FAULT, BLANK, DUPLICATE, CUT_SHORT = range(4)
#: Characters that are not white space, and a text whose last of them ends a sentence.
VISIBLE, FINISHED = r"[^\x20\x09-\x0D]", r"[.!?][\x20\x09-\x0D]*\z"


# --- turns


def _conversation(conv_id: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), conv_id.cast("string")), F.lit(""))


def damage(conversations: DataFrame) -> DataFrame:
    """Turns (conv_id, turn, role, text) after the damage that a checksum of id and turn calls for; a null text or role is one space.

    Of 20 remainders 0 drops the turn, 1 empties its text, 2 removes its sentence ends, 3 repeats it, 4 gives it to the user. Null ids and turns count as one space in the checksum.
    """
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    draw = F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20
    drawn = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), draw.alias("draw")).filter("draw <> 0")
    text = F.when(F.col("draw") == 1, "").when(F.col("draw") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("draw") == 4, "user").otherwise(F.col("role"))
    copies = F.explode(F.when(F.col("draw") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return drawn.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _identified(turns: DataFrame) -> DataFrame:
    """Turns with the key of their conversation and ``digest``, which orders turns of one number and role and tells whether texts are equal."""
    digest = F.unhex(F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))
    return turns.select("conv_id", _conversation(F.col("conv_id")).alias("key"), "turn", "role", "text", digest.alias("digest"))


def _in_order() -> list[Column]:
    return [F.asc("key"), F.asc_nulls_first("turn"), F.asc("role"), F.asc("digest")]


_PLACED = "key string, turn long, digest binary, initial string, fault int, part int, place long, piece long, nth int, sure boolean"


def _place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns in order with their partition, place in it, piece and place in the piece; ``sure`` where the piece begins its conversation for certain."""
    part = TaskContext.get().partitionId()
    place, piece, at, last, sure = 0, -1, 0, None, False
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        keys = batch.column("key")
        new = np.ones(n, dtype=bool)
        if n > 1:
            new[1:] = pc.not_equal(keys.slice(1), keys.slice(0, n - 1)).to_numpy(zero_copy_only=False)
        new[0] = last is None or keys[0].as_py() != last
        first_row = place == 0
        pieces, ats, sures = np.empty(n, np.int64), np.empty(n, np.int32), np.empty(n, bool)
        starts = [0, *np.flatnonzero(new[1:] if n > 1 else new[:0]).__add__(1).tolist(), n]
        for a, b in zip(starts, starts[1:], strict=False):
            if new[a]:
                piece, at, sure = piece + 1, 0, not (first_row and a == 0)
            run = at + np.arange(b - a)
            step = run // PIECE
            pieces[a:b], ats[a:b], sures[a:b] = piece + step, run % PIECE, sure & (step == 0)
            piece, at = int(piece + step[-1]), int(run[-1] % PIECE) + 1
            sure = bool(sures[b - 1])
        last = keys[n - 1].as_py()
        extra = [pa.array(np.full(n, part, np.int32)), pa.array(place + np.arange(n, dtype=np.int64)), pa.array(pieces), pa.array(ats), pa.array(sures)]
        names = ["key", "turn", "digest", "initial", "fault"]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *extra], names=[*names, "part", "place", "piece", "nth", "sure"])
        place += n


def _faulty(turns: DataFrame) -> DataFrame:
    """Turns in pieces with their first fault. A repeated turn is one whose place is not the first of its role and text in the conversation."""
    fault = F.when(~F.col("text").rlike(VISIBLE), BLANK).when(~F.col("text").rlike(FINISHED), CUT_SHORT).otherwise(NO_FAULT)
    light = _identified(turns).select("key", "turn", "role", "digest", F.substring("role", 1, 1).alias("initial"), fault.cast("int").alias("fault"))
    placed = cut(light.sort(*_in_order()).drop("role").mapInArrow(_place, _PLACED))
    firsts = placed.groupBy("key", "digest").agg(F.min(F.struct("part", "place")).alias("at")).select("at.part", "at.place", F.lit(True).alias("first"))
    repeated = F.col("first").isNull() & (F.col("fault") != BLANK)
    rows = placed.drop("digest").join(firsts, ["part", "place"], "left")
    return rows.withColumn("fault", F.when(repeated, DUPLICATE).otherwise(F.col("fault")).cast("int")).drop("first", "place")


# --- the recursion


def moves() -> list[tuple]:
    """(state before, initial or ``?``, fault, state after, cost, letters) of the cheapest ways over one turn, insertions before it included."""
    inserted = {(s, s): "" for s in range(4)}
    for _ in range(2):
        for (a, b), letters in list(inserted.items()):
            for x in "ua":
                if (b, x) in NEXT:
                    inserted.setdefault((a, NEXT[b, x]), letters + "I")
    best: dict[tuple, tuple] = {}
    for ((s, m), before), initial, fault in product(inserted.items(), "sua?", range(4)):
        ways = [("D", m, DELETE)]
        if fault not in (BLANK, DUPLICATE):
            short = TRUNCATED if fault == CUT_SHORT else 0
            ways += [("K", NEXT[m, initial], short)] if (m, initial) in NEXT else []
            ways += [("R", NEXT[m, x], REROLE + short) for x in "ua" if (m, x) in NEXT]
        for letter, t, cost in ways:
            way = (cost + INSERT * len(before), before + letter)
            best[s, initial, fault, t] = min(best.get((s, initial, fault, t), way), way)
    return [(*k, *v) for k, v in sorted(best.items())]


@lru_cache(maxsize=1)
def _connection():
    import duckdb

    con = duckdb.connect(config={"threads": 1, "memory_limit": "600MB"})
    con.execute("CREATE TABLE moves (s TINYINT, c VARCHAR, fault INT, t TINYINT, cost BIGINT, letters VARCHAR)")
    con.executemany("INSERT INTO moves VALUES (?, ?, ?, ?, ?, ?)", moves())
    return con


#: Each recursion advances every run ``k`` by its step ``i``; all ways of a run that end in one state are then one.
_WALK = """
WITH RECURSIVE walk AS (
    SELECT k, 0 AS i, s0, s0 AS s, 0::BIGINT AS cost, '' AS audit FROM starts
    UNION ALL
    SELECT k, i + 1, s0, t, best.cost, best.audit FROM (
        SELECT w.k, w.i, w.s0, x.t, min({'cost': w.cost + x.cost, 'audit': w.audit || x.letters}) AS best
        FROM walk w JOIN steps x ON x.k = w.k AND x.i = w.i AND x.s = w.s GROUP BY w.k, w.i, w.s0, x.t))
SELECT k, list({'s0': s0, 's': s, 'cost': cost, 'audit': audit} ORDER BY s0, s) AS paths FROM walk JOIN runs USING (k) WHERE i = n GROUP BY k"""

_PIECES = """SELECT g.*, paths FROM ({groups}) g JOIN ({walk}) USING (k)"""

_LEGAL = "('su', 'ua', 'au')"

_SUMS = [("blank", "long"), ("duplicate", "long"), ("truncated", "long"), ("illegal", "long"), ("turns", "long"), ("min_turn", "long"), ("max_turn", "long"), ("first_turn", "long"), ("last_turn", "long"), ("first_initial", "string"), ("last_initial", "string")]
_PATHS = "paths array<struct<s0: byte, s: byte, cost: long, audit: string>>"
_RUN = "key string, part int, piece long, " + ", ".join(f"{n} {t}" for n, t in _SUMS) + ", " + _PATHS

_TURN_GROUPS = f"""SELECT k, any_value(key) AS key, any_value(part) AS part, any_value(piece) AS piece, count(*) FILTER (fault = {BLANK}) AS blank, count(*) FILTER (fault = {DUPLICATE}) AS duplicate,
    count(*) FILTER (fault = {CUT_SHORT}) AS truncated, count(*) FILTER (nth > 0 AND was || initial NOT IN {_LEGAL}) AS illegal, count(*) FILTER (turn IS NOT NULL AND turn IS DISTINCT FROM before) AS turns,
    min(turn) AS min_turn, max(turn) AS max_turn, arg_min_null(turn, nth) AS first_turn, arg_max_null(turn, nth) AS last_turn, arg_min(initial, nth) AS first_initial, arg_max(initial, nth) AS last_initial
    FROM (SELECT *, lag(initial) OVER o AS was, lag(turn) OVER o AS before FROM r WINDOW o AS (PARTITION BY k ORDER BY nth)) GROUP BY k"""

_RUN_GROUPS = f"""SELECT k, any_value(key) AS key, min(part) AS part, min(upper) AS piece, sum(blank)::BIGINT AS blank, sum(duplicate)::BIGINT AS duplicate, sum(truncated)::BIGINT AS truncated,
    sum(illegal + CASE WHEN i > 0 AND was || first_initial NOT IN {_LEGAL} THEN 1 ELSE 0 END)::BIGINT AS illegal, sum(turns - CASE WHEN before = first_turn THEN 1 ELSE 0 END)::BIGINT AS turns,
    min(min_turn) AS min_turn, max(max_turn) AS max_turn, arg_min_null(first_turn, i) AS first_turn, arg_max_null(last_turn, i) AS last_turn, arg_min(first_initial, i) AS first_initial, arg_max(last_initial, i) AS last_initial
    FROM (SELECT *, lag(last_initial) OVER o AS was, lag(last_turn) OVER o AS before FROM r WINDOW o AS (PARTITION BY k ORDER BY i)) GROUP BY k"""

_ARROW = {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}
_RUN_ARROW = pa.schema([("key", pa.string()), ("part", pa.int32()), ("piece", pa.int64()), *((n, _ARROW[t]) for n, t in _SUMS), ("paths", pa.list_(pa.struct([("s0", pa.int8()), ("s", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())])))])


def _run(con, groups: str) -> pa.Table:
    found = con.sql(_PIECES.format(groups=groups, walk=_WALK)).to_arrow_table()
    return pa.Table.from_arrays([found.column(f.name).cast(f.type) for f in _RUN_ARROW], schema=_RUN_ARROW)


def _walk_turns(batch: pa.Table) -> pa.Table:
    """The pieces of a batch of turns, each with its sums and its cheapest ways."""
    con = _connection()
    con.register("batch", batch)
    con.execute("CREATE OR REPLACE TEMP TABLE r AS SELECT *, dense_rank() OVER (ORDER BY part, piece) AS k FROM batch")
    con.unregister("batch")
    con.execute("CREATE OR REPLACE TEMP TABLE starts AS SELECT k, unnest(CASE WHEN bool_and(sure) THEN [0] ELSE [0, 1, 2, 3] END)::TINYINT AS s0 FROM r GROUP BY k")
    con.execute("CREATE OR REPLACE TEMP TABLE runs AS SELECT k, count(*) AS n FROM r GROUP BY k")
    con.execute("CREATE OR REPLACE TEMP TABLE steps AS SELECT k, nth AS i, s, t, cost, letters FROM r JOIN moves ON c = CASE WHEN initial IN ('s', 'u', 'a') THEN initial ELSE '?' END AND moves.fault = r.fault")
    return _run(con, _TURN_GROUPS)


def _walk_runs(batch: pa.Table) -> pa.Table:
    """Neighbouring runs of a conversation joined into one."""
    con = _connection()
    con.register("batch", batch)
    con.execute("CREATE OR REPLACE TEMP TABLE r AS SELECT *, dense_rank() OVER (ORDER BY key, upper) AS k, row_number() OVER (PARTITION BY key, upper ORDER BY piece) - 1 AS i FROM batch")
    con.unregister("batch")
    con.execute("CREATE OR REPLACE TEMP TABLE starts AS SELECT DISTINCT k, unnest(paths).s0 AS s0 FROM r WHERE i = 0")
    con.execute("CREATE OR REPLACE TEMP TABLE runs AS SELECT k, count(*) AS n FROM r GROUP BY k")
    con.execute("CREATE OR REPLACE TEMP TABLE steps AS SELECT k, i, p.s0 AS s, p.s AS t, p.cost AS cost, p.audit AS letters FROM (SELECT k, i, unnest(paths) AS p FROM r)")
    return _run(con, _RUN_GROUPS)


def _batched(rows: DataFrame, by: list[str], n_rows: int, size: int, walk) -> DataFrame:
    batch = F.pmod(F.xxhash64(*by), F.lit(max(1, -(-n_rows // size)))).alias("batch")
    return cut(rows.groupBy(batch).applyInArrow(walk, _RUN))


def cheapest(turns: DataFrame) -> DataFrame:
    """One row per conversation with turns: its key, sums, and ``best`` (cost, audit)."""
    rows = _faulty(turns)
    placed = rows.groupBy("part").agg(F.count(F.lit(1)).alias("n"), (F.max("piece") + 1).alias("pieces")).withColumn("before", F.sum("pieces").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("pieces"))
    parts = cut(placed)  # a row for each partition
    n = parts.agg(F.sum("n")).first()[0] or 0
    runs = _batched(rows, ["part", "piece"], n, BATCH_ROWS, _walk_turns)
    runs = runs.join(F.broadcast(parts.select("part", "before")), "part").withColumn("piece", F.col("before") + F.col("piece")).drop("before")
    whole = []
    while True:
        several = cut(runs.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"))
        n = several.agg(F.sum("n")).first()[0]
        if not n:
            break
        whole.append(runs.join(several, "key", "left_anti"))
        upper = runs.join(several, "key", "left_semi").withColumn("upper", F.floor(F.col("piece") / PIECE).cast("long"))
        runs = _batched(upper, ["key", "upper"], n, BATCH_ROWS // PIECE, _walk_runs)
    for x in whole:
        runs = runs.unionByName(x.select(*runs.columns))
    missing = lambda p: F.when(p["s"] == SYSTEM, 2).when(p["s"] == USER, 1).otherwise(0)
    closed = lambda p: F.struct((p["cost"] + INSERT * missing(p)).alias("cost"), F.concat(p["audit"], F.repeat(F.lit("I"), missing(p))).alias("audit"))
    return runs.withColumn("best", F.array_min(F.transform(F.filter("paths", lambda p: p["s0"] == START), closed))).drop("paths", "part", "piece")


# --- the repaired turns


def repaired_turns(turns: list[tuple[str, str]], audit: str) -> list[tuple[str, str]]:
    """Roles and texts after the edits of ``audit``."""
    edit = Edits(audit)
    out = [x for role, text in turns for x in edit.take(role, text)]
    return out + edit.end()


class Edits:
    """Follows an audit along the turns of a conversation."""

    def __init__(self, audit: str):
        self.audit, self.i, self.state = audit, 0, START

    def _new(self) -> str:
        role = "assistant" if self.state == USER else "user"
        self.state = NEXT[self.state, role[0]]
        return role

    def _inserted(self) -> list[tuple[str, str]]:
        out = []
        while self.audit[self.i : self.i + 1] == "I":
            self.i += 1
            out.append((self._new(), ""))
        return out

    def take(self, role: str, text: str) -> list[tuple[str, str]]:
        out = self._inserted()
        letter = self.audit[self.i]
        self.i += 1
        if letter == "K":
            self.state = NEXT[self.state, role[:1]]
            out.append((role, text))
        elif letter == "R":
            out.append((self._new(), text))
        return out

    def end(self) -> list[tuple[str, str]]:
        return self._inserted()


def _hashed(names: list[str], types: list[pa.DataType]):
    """Streams conversations, each an answer and then its turns in order, into answers with the hash of the repaired text."""
    schema = pa.schema([*zip(names, types, strict=True), ("repaired_sha256", pa.string())])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        answer, edits, digest, some, out = None, None, None, False, []

        def add(turns):
            nonlocal some
            for role, text in turns:
                digest.update((("\n" if some else "") + role + ":" + text).encode())
                some = True

        def close():
            if answer is not None:
                add(edits.end())
                out.append((*(answer[n] for n in names), digest.hexdigest()))

        def flush():
            columns = list(zip(*out, strict=True)) if out else [[] for _ in schema]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

        for big in batches:
            for batch in slices(big, "text"):
                for a, role, text in zip(batch.column("answer").to_pylist(), batch.column("role").to_pylist(), batch.column("text").to_pylist(), strict=True):
                    if a is not None:
                        close()
                        answer, edits, digest, some = a, Edits(a["audit"]), hashlib.sha256(), False
                    else:
                        add(edits.take(role, text))
                if out:
                    yield flush()
        close()
        yield flush()

    return stream


def repair(conversations: DataFrame, damaged: DataFrame | None = None) -> DataFrame:
    """One row per conversation of the table: its gaps, faults, least cost, audit and the hash of its repaired text.

    Reads ``conv_id``, ``turn``, ``role`` and ``text``; any other columns are left out. ``damaged`` holds the turns to repair if these are not
    those of ``conversations`` after ``damage``. A null role or text is one space: such a turn is blank, or has a role that fits no place. A null id is a
    conversation of its own; null turn numbers come first and count in no gap. Turns of one number are taken by role, then by a hash of role and text,
    so repeats are neighbours. A role is known by its first character; an empty one fits no place and makes illegal neighbours. Without turns the sums are 0, the audit is empty and the hash is that of no
    text. An empty table gives an empty table. Texts of any length are read in one pass; a conversation's audit is one value.
    """
    turns = damage(conversations) if damaged is None else damaged
    found = cheapest(turns)
    ids = conversations.select(_conversation(F.col("conv_id")).alias("key"), "conv_id").groupBy("key").agg(F.first("conv_id", ignorenulls=True).alias("conv_id"))
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long")
    gaps = F.when(F.col("min_turn").isNull(), 0).otherwise(F.col("max_turn") - F.col("min_turn") + 1 - F.col("turns"))
    sums = {"gaps": zero(gaps), **{c: zero(F.col(c)) for c in ("blank", "duplicate", "truncated", "illegal")}, "cost": zero(F.col("best.cost")), "audit": F.coalesce("best.audit", F.lit(""))}
    answers = ids.join(found, "key", "left").select("key", F.struct("conv_id", *(c.alias(n) for n, c in sums.items())).alias("answer"))
    none = lambda kind: F.lit(None).cast(kind)
    first = answers.select("key", F.lit(0).alias("kind"), none("long").alias("turn"), none("string").alias("role"), none("binary").alias("digest"), none("string").alias("text"), "answer")
    then = _identified(turns).select("key", F.lit(1).alias("kind"), "turn", "role", "digest", "text", none(answers.schema["answer"].dataType).alias("answer"))
    key, *rest = _in_order()
    both = first.unionByName(then).repartition("key").sortWithinPartitions(key, F.asc("kind"), *rest).select("answer", "role", "text")
    kind = answers.schema["answer"].dataType
    out = T.StructType([*kind.fields, T.StructField("repaired_sha256", T.StringType())])
    return both.mapInArrow(_hashed(kind.names, [to_arrow_type(f.dataType) for f in kind.fields]), out)
