"""Chat formatting with minimum-cost role repair.

Legal conversations are words of an automaton: an optional system turn, then user and
assistant in turn, ending with the assistant. Dynamic programming over its states finds
the cheapest repair by merges (a turn joins the one before), relabels and insertions of
empty turns, and the repaired sequence is rendered.

Conversations may be long. The table is cut by (conversation, turn) into ranges that fit
in memory, so a long one is cut too. For a cut piece the costs from every state to every
state are found (a min-plus matrix); chained over a conversation's cut pieces (16 numbers
for some megabytes of turns) they fix the states at the cuts, and each piece is then
repaired on its own.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from loomgraph.session import materialize, ship_package

# Roles, their other names, and what may follow what.
ROLES = ("system", "user", "assistant")
NAMES = {"human": "user", "prompter": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant", "ai": "assistant"}
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}

MERGE, INSERT, RELABEL = 1, 2, 3
PART_BYTES, LEAST_PARTS = 8 << 20, 16
NEVER = math.inf


def inserts(state: int, last: int) -> list[tuple[int, ...]]:
    """Shortest chains of empty turns after `state` such that a turn of role `last` may follow."""
    chains: list[tuple[int, ...]] = [()]
    for _ in range(4):
        done = [c for c in chains if last in NEXT[c[-1] if c else state]]
        if done:
            return done
        chains = [(*c, t) for c in chains for t in NEXT[c[-1] if c else state]]
    return []


def moves(state: int, role: int | None) -> list[tuple[int, int, str]]:
    """(cost, new state, how) for a turn with a role (None: of no known role) after `state`."""
    out = []
    for new in (SYSTEM, USER, ASSISTANT):
        name, price = ROLES[new - 1], 0 if role == new else RELABEL
        tag = "" if role == new else f"={name}"
        if state == new:
            out.append((price + MERGE, new, f"merge{tag}"))
        for chain in inserts(state, new):
            out.append((price + INSERT * len(chain), new, "".join(f"+{ROLES[c - 1]} " for c in chain) + ("keep" if not tag else f"relabel{tag}")))
    return sorted(out)


MOVES = {(s, r): moves(s, r) for s in range(4) for r in (None, SYSTEM, USER, ASSISTANT)}
#: (cost, how) of ending a conversation in a state.
ENDS = {START: (0, ""), SYSTEM: (2 * INSERT, "+user +assistant"), USER: (INSERT, "+assistant"), ASSISTANT: (0, "")}


def role_number(role: str | None) -> int | None:
    name = (role or "").strip().lower()
    name = NAMES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else None


def solve(roles: list[int | None], entry: int) -> tuple[list[float], list[list[tuple[int, str] | None]]]:
    """Least cost to each state after all turns from `entry`, and each turn's (state before, how)."""
    cost, back = [NEVER] * 4, []
    cost[entry] = 0
    for role in roles:
        new, how = [NEVER] * 4, [None] * 4
        for state in range(4):
            if cost[state] < NEVER:
                for price, to, what in MOVES[state, role]:
                    if cost[state] + price < new[to]:
                        new[to], how[to] = cost[state] + price, (state, what)
        cost = new
        back.append(how)
    return cost, back


def repair(roles: list[int | None], entry: int = START, leave: int | None = None) -> tuple[float, list[str], list[int]]:
    """Cost, operations and the state after each turn; leave: the state to end in (None: any, at its price)."""
    cost, back = solve(roles, entry)
    if leave is None:
        price, leave = min((cost[s] + ENDS[s][0], s) for s in range(4))
    else:
        price = cost[leave]
    how, states, at = [], [], leave
    for step in reversed(back):
        states.append(at)
        at, what = step[at]
        how.append(what)
    return price, how[::-1], states[::-1]


def render(texts: list[str], how: list[str], states: list[int], entry: int, last: bool, leave: int) -> tuple[str, int]:
    """The rendered piece and how many turns begin in it. A turn is closed where the next one begins."""
    out, begun, open_turn = [], 0, entry != START

    def begin(name: str) -> None:
        nonlocal begun, open_turn
        out.append(("<|end|>\n" if open_turn else "") + f"<|{name}|>\n")
        begun += 1
        open_turn = True

    for text, what, state in zip(texts, how, states):
        *chain, last_step = what.split(" ")
        for empty in chain:
            begin(empty[1:])
        if last_step.startswith("merge"):
            out.append("\n\n")
        else:
            begin(ROLES[state - 1])
        out.append(text)
    if last:
        for empty in ENDS[leave][1].split():
            begin(empty[1:])
        if open_turn:
            out.append("<|end|>\n")
    return "".join(out), begun


def pieces_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple, list[tuple]]]:
    """((part, conversation), turns) from batches sorted by part and conversation."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    for key, turns in groupby(rows, key=lambda r: r[:2]):
        yield key, list(turns)


def edge_batches(kind: pa.DataType):
    """A row (part, id, matrix) for the first and the last conversation of each part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = []
        for _, group in groupby(pieces_of(batches), key=lambda p: p[0][0]):
            first = held = None
            for key, turns in group:
                held = (key, [role_number(t[3]) for t in turns])
                if first is None:
                    first = held
            for key, roles in [first] + ([held] if held is not first else []):
                found.append((*key, [c for s in range(4) for c in solve(roles, s)[0]]))
        columns = list(zip(*found)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], kind), pa.array(columns[2], pa.list_(pa.float64()))], names=["part", "id", "matrix"])

    return run


def chain(matrices: list[list[float]]) -> list[tuple[int, int | None]]:
    """Of the pieces of one conversation: the state at its start, and at its end (None for the last)."""
    best, back = {START: 0.0}, []
    for matrix in matrices:
        step: dict[int, tuple[float, int]] = {}
        for s, c in best.items():
            for t in range(4):
                if c + matrix[4 * s + t] < step.get(t, (NEVER,))[0]:
                    step[t] = (c + matrix[4 * s + t], s)
        back.append(step)
        best = {t: c for t, (c, _) in step.items()}
    state = min(best, key=lambda s: (best[s] + ENDS[s][0], s))
    out: list[tuple[int, int | None]] = []
    leave: int | None = None
    for step in reversed(back):
        before = step[state][1]
        out.append((before, leave))
        state = leave = before
    return out[::-1]


def chain_groups(table: pa.Table) -> pa.Table:
    """(part, id, number, entry, leave) of one cut conversation's pieces."""
    table = table.sort_by("part")
    ways = chain(table.column("matrix").to_pylist())
    columns = [pa.array(range(len(ways)), pa.int32()), *(pa.array([w[i] for w in ways], pa.int32()) for i in (0, 1))]
    return pa.Table.from_arrays([table.column("part"), table.column("id"), *columns], names=["part", "id", "number", "entry", "leave"])


def format_chats(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(id_col, piece, n_turns, n_out, cost, ops, rendered): a row for each conversation.

    A conversation that is cut comes in rows with piece 0, 1, ...; their `rendered` in
    order is the whole, and their costs add up. Turns go by number, then role and text;
    nulls come first. A null role or one of no known name must be relabelled, a null
    text is empty, and rows with a null id make one conversation. Repeated turns count
    each. Ids may be of any type with an order. Other columns are ignored; an empty table
    gives no rows.
    """
    spark = turns.sparkSession
    ship_package(spark)
    size = turns.agg(F.sum(F.coalesce(F.octet_length(text_col), F.lit(0)) + 64)).first()[0] or 0
    parts = max(LEAST_PARTS, math.ceil(size / PART_BYTES))
    row = turns.select(F.col(id_col).alias("id"), F.col(turn_col).alias("turn"), F.col(role_col).alias("role"), F.coalesce(text_col, F.lit("")).alias("text"))
    row = row.withColumn("salt", F.xxhash64(F.spark_partition_id()))  # rows equal in all else may be cut too
    cut = materialize(row.repartitionByRange(parts, "id", "turn", "role", "text", "salt").select(F.spark_partition_id().alias("part"), "id", "turn", "role", "text"), "chat-parts")
    kind = cut.schema["id"].dataType.simpleString()
    arrow = to_arrow_type(cut.schema["id"].dataType)
    edges = cut.repartition(parts, "part").sortWithinPartitions("part", "id", "turn", "role", "text").mapInArrow(edge_batches(arrow), f"part int, id {kind}, matrix array<double>")
    edges = materialize(edges, "chat-edges")  # two small rows a part at most
    again = edges.groupBy("id").count().where("count > 1").select(F.col("id").alias("cut_id"))
    fixed = edges.join(again, F.col("id").eqNullSafe(F.col("cut_id")), "left_semi").groupBy("id").applyInArrow(chain_groups, f"part int, id {kind}, number int, entry int, leave int")

    # what is fixed about a cut piece goes before its turns
    none = F.lit(None).cast("int")
    rows = cut.select("part", "id", F.lit(1).alias("is_turn"), "turn", "role", "text", none.alias("number"), none.alias("entry"), none.alias("leave"))
    blank = [F.lit(None).cast(cut.schema[c].dataType).alias(c) for c in ("turn", "role", "text")]
    heads = fixed.select("part", "id", F.lit(0).alias("is_turn"), *blank, "number", "entry", "leave")
    sort = rows.unionByName(heads).repartition(parts, "part").sortWithinPartitions("part", "id", "is_turn", "turn", "role", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        kinds = (arrow, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string())

        def batch() -> pa.RecordBatch:
            columns = list(zip(*made)) or [()] * 7
            out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["id", "piece", "n_turns", "n_out", "cost", "ops", "rendered"])
            made.clear()
            return out

        waiting = 0
        for key, turns in pieces_of(batches):
            number, entry, leave = turns[0][6:9] if turns[0][2] == 0 else (0, START, None)
            own = turns[1:] if turns[0][2] == 0 else turns
            price, how, states = repair([role_number(r[4]) for r in own], entry, leave)
            text, begun = render([r[5] for r in own], how, states, entry, leave is None, states[-1])
            if leave is None and ENDS[states[-1]][1]:
                how = [*how, ENDS[states[-1]][1]]
            made.append((key[1], number, len(own), begun, int(price), ",".join(how), text))
            waiting += len(text)
            if len(made) >= 256 or waiting > PART_BYTES:
                yield batch()
                waiting = 0
        yield batch()

    out = sort.mapInArrow(run, f"id {kind}, piece int, n_turns long, n_out long, cost long, ops string, rendered string")
    return out.withColumnRenamed("id", id_col)
