"""Chat formatting by minimum-cost role repair.

A legal conversation is an optional system turn, then user and assistant in turn, ending with assistant. Every turn of a conversation
may be kept, relabelled or merged into the message before it, and empty turns may be inserted. A dynamic program over the
states of that automaton (start, after system, after user, after assistant) picks the cheapest way; ties go to the
first of the options in ``OPTIONS``. The repaired sequence is then rendered, a segment for each input turn: the concatenation of a
conversation's segments in order is its text.

The program is a product of (min, +) matrices, one for each turn, so a conversation can be cut anywhere: turns are
range-partitioned by (conversation, turn), and a run that may go on in a neighbouring partition returns its matrix and its best
steps for every pair of entry and exit states. Only those matrices, at most two a partition, meet on the driver to choose the states
at the cuts. So a conversation that holds a third of all rows is worked on by many tasks.

Defined results: turns go by (turn, role, hash of the text, text), nulls first but for the hash, wherever partitions are cut; a null conv_id
is a conversation of its own; a role other than system, user and assistant (any case; null too) is unknown, and cheaper to relabel; null
text is empty; repeated rows are separate turns; texts of any length pass through the program's tasks untouched, a slice of ``SLICE_BYTES`` of them
or one text at a time; an empty table gives no rows; other columns are not carried.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from seriesloom.llm.common import trim
from seriesloom.plans.scratch import Scratch

#: States: start, after system, after user, after assistant; a turn becomes one of the last three.
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ["", "system", "user", "assistant"]
UNKNOWN = 4
MERGE, INSERT, RELABEL, NAME = 2, 3, 4, 2
NEVER = 1 << 40
#: An empty turn that must come between a state and a turn; pairs that are missing have no legal way.
BETWEEN = {
    (START, SYSTEM): 0, (START, USER): 0, (SYSTEM, USER): 0, (USER, ASSISTANT): 0, (ASSISTANT, USER): 0,
    (START, ASSISTANT): USER, (SYSTEM, ASSISTANT): USER, (USER, USER): ASSISTANT, (ASSISTANT, ASSISTANT): USER,
}
#: Bytes of texts in one batch of results, about; a longer text is a batch of its own.
SLICE_BYTES = 1 << 24
#: Empty turns that end a conversation legally.
FINISH = {SYSTEM: [USER, ASSISTANT], USER: [ASSISTANT], ASSISTANT: []}


def _step(role: int) -> tuple[np.ndarray, np.ndarray]:
    """(cost, whether merged) of going from each state to each by a turn of this role."""
    cost, merged = np.full((4, 4), NEVER), np.zeros((4, 4), bool)
    for p in range(4):
        for q in (SYSTEM, USER, ASSISTANT):
            label = 0 if role == q else NAME if role == UNKNOWN else RELABEL
            if (p, q) in BETWEEN:
                cost[p, q] = label + (INSERT if BETWEEN[p, q] else 0)
            if p == q and label + MERGE <= cost[p, q]:
                cost[p, q], merged[p, q] = label + MERGE, True
    return cost, merged


_STEPS = [_step(r) for r in range(5)]
COSTS = np.stack([c for c, _ in _STEPS])
MERGED = np.stack([m for _, m in _STEPS])
ENDS = np.array([NEVER] + [INSERT * len(FINISH[s]) for s in (SYSTEM, USER, ASSISTANT)])


@lru_cache(maxsize=1 << 16)
def solve(roles: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(matrix, plans): cheapest cost from each entry to each exit state, and for each turn and pair p | q << 2 | merged << 4."""
    n = len(roles)
    best = np.full((4, 4), NEVER)
    np.fill_diagonal(best, 0)
    came = np.zeros((n, 4, 4), np.int8)  # [turn, entry, state after it] -> state before it
    for i, r in enumerate(roles):
        ways = best[:, :, None] + COSTS[r][None]
        came[i] = ways.argmin(1)
        best = np.minimum(np.take_along_axis(ways, came[i][:, None].astype(np.int64), 1)[:, 0], NEVER)
    plans = np.zeros((n, 16), np.uint8)
    entry = np.repeat(np.arange(4), 4)
    state = np.tile(np.arange(4), 4)
    for i in range(n - 1, -1, -1):
        before = came[i][entry, state]
        plans[i] = before | state << 2 | MERGED[roles[i]][before, state] << 4
        state = before
    return best, plans


def repair(roles: list[int]) -> tuple[int, list[int]]:
    """(cost, step of each turn) of a whole conversation."""
    if not roles:
        return 0, []
    matrix, plans = solve(bytes(roles))
    end = int((matrix[START] + ENDS).argmin())
    return int(matrix[START, end] + ENDS[end]), plans[:, START * 4 + end].tolist()


def ranks(plans: np.ndarray) -> np.ndarray:
    """For each exit state, the place of each entry state among the four by the ways between them: by the state before the last turn, then
    that before the turn before it, and so on. So ties go as they do in a run that is not cut."""
    out = np.zeros((4, 4), np.int64)
    for q in range(4):
        ways = [(plans[::-1, p * 4 + q] & 3).tobytes() for p in range(4)]
        out[sorted(range(4), key=lambda p: (ways[p], p)), q] = range(4)
    return out


def join_runs(runs: list[tuple[int, np.ndarray, np.ndarray]]) -> dict[int, tuple[int, int, bool]]:
    """Entry and exit state, and whether it is the last, of each run (partition, matrix, ranks) of one conversation."""
    runs = sorted(runs, key=lambda r: r[0])
    best, came = np.array([0, NEVER, NEVER, NEVER]), []
    for _, m, order in runs:
        ways = best[:, None] + m
        came.append((ways * 4 + order).argmin(0))
        best = np.minimum(ways.min(0), NEVER)
    state = int((best + ENDS).argmin())
    out = {}
    for k in range(len(runs) - 1, -1, -1):
        entry = int(came[k][state])
        out[runs[k][0]] = (entry, state, k == len(runs) - 1)
        state = entry
    return out


def _code(role: Column) -> Column:
    r = F.lower(role)
    known = F.when(r == "system", SYSTEM).when(r == "user", USER).when(r == "assistant", ASSISTANT)
    return known.otherwise(UNKNOWN)


RUN = "conv_id bigint, turn bigint, role string, text string, part int, pos bigint, step int, last boolean, plans binary, matrix array<bigint>"


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Turns of a sorted partition with their steps; those of its first and last conversation with plans for any entry and exit."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.bool_(), pa.binary(), pa.list_(pa.int64())]
    names = [c.split()[0] for c in RUN.split(", ")]
    at = 0

    def emit(run: list, edge: bool) -> Iterator[pa.RecordBatch]:
        nonlocal at
        n, roles = len(run), bytes(r[4] for r in run)
        conv, turn, role, text, _ = zip(*run, strict=True)
        pos = range(at, at + n)
        at += n
        if edge:
            matrix, plans = solve.__wrapped__(roles)
            steps, last = [None] * n, [None] * n
            plan, cells = [p.tobytes() for p in plans], [None] * (n - 1) + [[*matrix.ravel().tolist(), *ranks(plans).ravel().tolist()]]
        else:
            steps, last = repair(list(roles))[1] if n <= 256 else _long(roles), [False] * (n - 1) + [True]
            plan, cells = [None] * n, [None] * n
        columns = [conv, turn, role, text, [part] * n, pos, steps, last, plan, cells]
        lo = size = 0
        for i, t in enumerate(text):  # a run of long texts goes in several batches
            if i > lo and size + len(t or "") > SLICE_BYTES // 4:
                yield made(columns, lo, i)
                lo, size = i, 0
            size += len(t or "")
        yield made(columns, lo, n)

    def made(columns: list, lo: int, hi: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(c[lo:hi]), k) for c, k in zip(columns, kinds, strict=True)], names=names)

    def pooled() -> pa.RecordBatch:
        out = pa.Table.from_batches(done).combine_chunks().to_batches()[0]
        done.clear()
        return out

    run: list = []
    first, held = True, 0
    done: list[pa.RecordBatch] = []

    def finished(edge: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held
        for out in emit(run, edge):
            if done and (len(done) >= 1000 or held + out.nbytes > SLICE_BYTES):
                yield pooled()
                held = 0
            done.append(out)
            held += out.nbytes

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run and row[0] != run[-1][0]:
                yield from finished(first)
                first, run = False, []
            run.append(row)
    if run:
        yield from finished(True)
    if done:
        yield pooled()
    trim()


def _long(roles: bytes) -> list[int]:
    matrix, plans = solve.__wrapped__(roles)
    end = int((matrix[START] + ENDS).argmin())
    return plans[:, START * 4 + end].tolist()


OPEN, CLOSE = "<|im_start|>", "<|im_end|>\n"


def _message(role: str) -> str:
    return f"{OPEN}{role}\n{CLOSE}"


def rendered(step: Column, last: Column, text: Column) -> Column:
    """A turn's segment: what closes the message before it, empty turns, its header and text, and the end after the last turn."""
    p, q, merged = step.bitwiseAND(3), F.shiftright(step, 2).bitwiseAND(3), step.bitwiseAND(16) != 0
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"<\|im_", "<| im_")
    fill = F.lit("")
    for (a, b), r in BETWEEN.items():
        if r:
            fill = F.when((p == a) & (q == b), _message(NAMES[r])).otherwise(fill)
    close = F.when(p == START, "").otherwise(CLOSE)
    head = F.concat(F.lit(OPEN), F.element_at(F.array(*map(F.lit, NAMES)), q + 1), F.lit("\n"))
    end = F.lit("")
    for s, rs in FINISH.items():
        end = F.when(q == s, CLOSE + "".join(_message(NAMES[r]) for r in rs)).otherwise(end)
    return F.concat(F.when(merged, "\n\n").otherwise(F.concat(close, fill, head)), body, F.when(last, end).otherwise(""))


def formatted(turns: DataFrame, scratch: Scratch, partitions: int | None = None) -> DataFrame:
    """(conv_id, turn, part, pos, role, action, segment) of every turn; (part, pos) orders a conversation's segments."""
    spark = turns.sparkSession
    n = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = turns.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text", _code(F.col("role")).alias("code"))
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.xxhash64("text").asc()]
    ranged = rows.repartitionByRange(n, *order).sortWithinPartitions(*order, F.col("text").asc_nulls_first())
    runs = scratch.keep(ranged.mapInArrow(_runs, RUN))
    cuts: dict = {}
    for r in runs.where("matrix is not null").select("conv_id", "part", "matrix").collect():  # at most two a partition
        cuts.setdefault(r["conv_id"], []).append((r["part"], *np.array(r["matrix"]).reshape(2, 4, 4)))
    chosen = [(c, k, e * 4 + x, end) for c, parts in cuts.items() for k, (e, x, end) in join_runs(parts).items()]
    states = spark.createDataFrame(chosen, "c bigint, k int, pair int, final boolean")
    hit = (F.col("part") == F.col("k")) & F.col("conv_id").eqNullSafe(F.col("c")) & F.col("plans").isNotNull()
    out = runs.join(F.broadcast(states), hit, "left")
    own = F.conv(F.hex(F.substring("plans", F.col("pair") + 1, F.lit(1))), 16, 10).cast("int")
    tail = F.col("final") & F.col("matrix").isNotNull()
    out = out.withColumns({"step": F.coalesce("step", own), "last": F.coalesce("last", tail)})
    q = F.shiftright(F.col("step"), 2).bitwiseAND(3)
    action = F.when(F.col("step").bitwiseAND(16) != 0, "merge").when(_code(F.col("role")) == q, "keep").otherwise("relabel")
    role = F.element_at(F.array(*map(F.lit, NAMES)), q + 1)
    return out.select("conv_id", "turn", "part", "pos", role.alias("role"), action.alias("action"), rendered(F.col("step"), F.col("last"), F.col("text")).alias("segment"))


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of ``conversations`` with its repaired role and rendered segment."""
    return formatted(spark.read.parquet(f"{sf_dir}/conversations.parquet"), Scratch(spark, "op5")).drop("part", "pos")


def _sql() -> str:
    """The same dynamic program as a recursive query: a row a conversation and turn with the costs of the four states and the steps to each.

    Tied turns (equal conv_id, turn and role) go by their text there, and conv_id must not be null; the test tables have neither.
    """
    cells = lambda m: "[" + ", ".join("[" + ", ".join(f"[{', '.join(str(int(x)) for x in row)}]" for row in role) + "]" for role in m) + "]"
    ways = lambda q: "[" + ", ".join(f"c[{p + 1}] + ({cells(COSTS)})[code + 1][{p + 1}][{q + 1}]" for p in range(4)) + "]"
    merged = lambda q: f"({cells(MERGED)})[code + 1][a{q}][{q + 1}]"
    states = range(1, 4)
    names = "[" + ", ".join(f"'{n}'" for n in NAMES) + "]"
    fill = " ".join(f"WHEN p = {a} AND q = {b} THEN '{_message(NAMES[r])}'" for (a, b), r in BETWEEN.items() if r)
    end = " ".join(f"WHEN q = {s} THEN '{CLOSE + ''.join(_message(NAMES[r]) for r in rs)}'" for s, rs in FINISH.items())
    return f"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, coalesce(text, '') AS text, CASE lower(role) WHEN 'system' THEN 1 WHEN 'user' THEN 2 WHEN 'assistant' THEN 3 ELSE 4 END AS code,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS n, count(*) OVER (PARTITION BY conv_id) AS last
  FROM conversations),
d(conv_id, n, c, ways) AS (
  SELECT DISTINCT conv_id, CAST(0 AS BIGINT), [0, {NEVER}, {NEVER}, {NEVER}]::BIGINT[], [[], [], [], []]::BIGINT[][] FROM t
  UNION ALL
  SELECT conv_id, n, [{NEVER}, {", ".join(f"least({NEVER}, w{q}[a{q}])" for q in states)}]::BIGINT[],
    [[], {", ".join(f"list_append(ways[a{q}], a{q} - 1 + {q * 4} + 16 * {merged(q)})" for q in states)}]::BIGINT[][]
  FROM (SELECT *, {", ".join(f"list_position(w{q}, list_min(w{q})) AS a{q}" for q in states)}
    FROM (SELECT d.conv_id, t.n, t.code, d.ways, {", ".join(f"{ways(q)} AS w{q}" for q in states)} FROM d JOIN t ON t.conv_id = d.conv_id AND t.n = d.n + 1))),
f AS (SELECT conv_id, n, ways, list_transform([1, 2, 3, 4], lambda q: c[q] + ({[int(x) for x in ENDS]})[q]) AS total FROM d),
s AS (SELECT t.*, f.ways[list_position(total, list_min(total))][t.n] AS step FROM t JOIN f ON t.conv_id = f.conv_id AND f.n = t.last),
r AS (SELECT *, step % 4 AS p, step // 4 % 4 AS q, step >= 16 AS merged FROM s)
SELECT conv_id, turn, ({names})[q + 1] AS role, CASE WHEN merged THEN 'merge' WHEN code = q THEN 'keep' ELSE 'relabel' END AS action,
  CASE WHEN merged THEN '\n\n' ELSE CASE WHEN p = 0 THEN '' ELSE '{CLOSE}' END || CASE {fill} ELSE '' END || '{OPEN}' || ({names})[q + 1] || '\n' END
    || replace(text, '<|im_', '<| im_') || CASE WHEN n < last THEN '' {end} ELSE '' END AS segment
FROM r
"""


OP5_SQL = _sql()
