"""Minimum-cost repair of the roles of a conversation, and its rendering.

Legal conversations follow an automaton: an optional system turn, then user and assistant in turns, user first; a
conversation that has any turn ends with user or assistant. Every input turn is kept under its role, relabelled, or
merged into the message before it, and empty turns can be inserted; dynamic programming over the states of the automaton
finds the cheapest way. Of equally cheap ways the one is taken whose states, read from the end, come first in the order
START, SYSTEM, USER, ASSISTANT.

The cost of a run of turns is a small matrix (state before, state after), and matrices of consecutive runs combine. So
the turns are sorted over all tasks by a range partitioning and cut into runs of at most ``RUN_TURNS`` turns; a
conversation within one run is decoded at once, the others in three passes over one matrix, then one trace, for each
run. A conversation of any length is spread over tasks.

The result has one row for every input turn and every inserted one: conv_id, seq (its place, from 0), message (of the
repaired conversation, from 0), role, action, cost, turn, rendered. Joining ``rendered`` in the order of ``seq`` gives
the text of the conversation; merged turns are joined by an empty line.

Defined results: turns are ordered by turn (nulls first), role, text, so ties and repeated rows have a place each; null
and unknown roles take any role at the price of a relabel; null texts are empty; rows without conv_id form one
conversation; the markers of the template inside a text are broken up by a space; an empty table gives an empty result.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foldwright.llm.common import bounded_batches, materialize

MERGE, RELABEL, INSERT = 1, 2, 3
START, SYSTEM, USER, ASSISTANT = STATES = range(4)
NAMES = ["", "system", "user", "assistant"]
ROLES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "assistant": ASSISTANT, "bot": ASSISTANT,
         "gpt": ASSISTANT, "model": ASSISTANT, "ai": ASSISTANT}
#: The empty turns that must stand between a state and a turn of a role; pairs not listed cannot follow each other.
BETWEEN = {(START, SYSTEM): [], (START, USER): [], (START, ASSISTANT): [USER], (SYSTEM, USER): [], (SYSTEM, ASSISTANT): [USER],
           (USER, ASSISTANT): [], (USER, USER): [ASSISTANT], (ASSISTANT, USER): [], (ASSISTANT, ASSISTANT): [USER]}
FAR = 1 << 40
RUN_TURNS, RUN_CHARS = 1024, 4 << 20
MESSAGE_START, MESSAGE_END = "<|im_start|>", "<|im_end|>\n"


def _step(role: int, before: int, after: int) -> tuple[int, str]:
    """Cost and kind of the cheapest way that a turn of ``role`` leads from a state to another; START: no known role."""
    relabel = RELABEL * (role != after)
    ways = []
    if before == after != START:
        ways.append((MERGE + relabel, "merge"))
    if (before, after) in BETWEEN:
        ways.append((INSERT * len(BETWEEN[before, after]) + relabel, "relabel" if relabel else "keep"))
    return min(ways, default=(FAR, ""))


STEPS = {(r, a, b): _step(r, a, b) for r in STATES for a in STATES for b in STATES}
FROM_START = [0, FAR, FAR, FAR]
#: Cost of ending in a state: a system turn alone is followed by an empty user turn.
ENDING = [0, INSERT, 0, 0]


def forward(roles: str, costs: list[int]) -> list[list[int]]:
    """Costs of the states before the first and after each turn of a run."""
    out = [list(costs)]
    for r in map(int, roles):
        last = out[-1]
        out.append([min(min(last[a] + STEPS[r, a, b][0] for a in STATES), FAR) for b in STATES])
    return out


def matrix(roles: str) -> list[int]:
    """Costs from each state before a run to each state after it."""
    return [c for a in STATES for c in forward(roles, [0 if s == a else FAR for s in STATES])[-1]]


def last_state(costs: list[int]) -> int:
    return min(STATES, key=lambda s: (costs[s] + ENDING[s], s))


def trace(roles: str, costs: list[int], last: int) -> list[int]:
    """The states before the first and after each turn, on the cheapest way that ends in ``last``."""
    table, states = forward(roles, costs), [last]
    for k in range(len(roles), 0, -1):
        r, after = int(roles[k - 1]), states[-1]
        states.append(min(STATES, key=lambda a: (table[k - 1][a] + STEPS[r, a, after][0], a)))
    return states[::-1]


def counts(roles: str, states: list[int]) -> tuple[int, int]:
    """Messages begun and rows made by a run on its way."""
    messages = rows = 0
    for r, a, b in zip(map(int, roles), states, states[1:]):
        new = 0 if STEPS[r, a, b][1] == "merge" else 1 + len(BETWEEN[a, b])
        messages, rows = messages + new, rows + max(1, new)
    return messages, rows


def repaired(run: dict, costs: list[int], last: int, message: int, seq: int, final: bool) -> Iterator[dict]:
    """The rows of a run that starts after ``message`` messages and ``seq`` rows of its conversation."""
    states = trace(run["roles"], costs, last)

    def row(role: int, action: str, cost: int, turn: int | None, text: str) -> dict:
        return {"conv_id": run["conv_id"], "role": NAMES[role], "action": action, "cost": cost, "turn": turn,
                "rendered": text, "message": message, "seq": seq}

    def opened(role: int) -> str:
        return (MESSAGE_END if message else "") + MESSAGE_START + NAMES[role] + "\n"

    out = []
    for r, a, b, turn in zip(map(int, run["roles"]), states, states[1:], run["turns"]):
        cost, action = STEPS[r, a, b]
        text = (turn["text"] or "").replace("<|", "< |")
        if action == "merge":
            message -= 1
            out.append(row(b, action, cost, turn["turn"], "\n\n" + text))
        else:
            for empty in BETWEEN[a, b]:
                out.append(row(empty, "insert", INSERT, None, opened(empty)))
                message, seq = message + 1, seq + 1
            out.append(row(b, action, cost - INSERT * len(BETWEEN[a, b]), turn["turn"], opened(b) + text))
        message, seq = message + 1, seq + 1
    if final and states[-1] == SYSTEM:
        out.append(row(USER, "insert", INSERT, None, opened(USER)))
    if final:
        out[-1]["rendered"] += MESSAGE_END
    return iter(out)


OUT = [("conv_id", pa.int64()), ("seq", pa.int64()), ("message", pa.int64()), ("role", pa.string()), ("action", pa.string()),
       ("cost", pa.int64()), ("turn", pa.int64()), ("rendered", pa.string())]
OUT_DDL = "conv_id long, seq long, message long, role string, action string, cost long, turn long, rendered string"
RUN_DDL = "conv_id long, task int, no int, whole boolean, roles string, turns array<struct<turn: long, text: string>>"


def _key() -> Column:
    """Key of a conversation in joins, where null ids must meet."""
    return F.coalesce(F.col("conv_id").cast("string"), F.lit("")).alias("key")


def runs(conversations: DataFrame, run_turns: int = RUN_TURNS) -> DataFrame:
    """Runs of sorted turns; ``whole``: the run is surely all of its conversation."""
    order = [F.col("conv_id"), F.col("turn"), F.col("role"), F.xxhash64("text")]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, no, run, chars, begun_here, first = TaskContext.get().partitionId(), 0, None, 0, False, True
        fields = pa.schema([("conv_id", pa.int64()), ("task", pa.int32()), ("no", pa.int32()), ("whole", pa.bool_()),
                            ("roles", pa.string()), ("turns", pa.list_(pa.struct([("turn", pa.int64()), ("text", pa.string())])))])

        def closed(ended: bool) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([run | {"task": task, "no": no, "whole": begun_here and ended}], fields)

        for batch in batches:
            for turn in batch.to_pylist():
                other = run is None or run["conv_id"] != turn["conv_id"]
                if run is not None and (other or len(run["roles"]) >= run_turns or chars >= RUN_CHARS):
                    yield closed(other)
                    run, no, begun_here, first = None, no + 1, other, False
                if run is None:
                    run, chars = {"conv_id": turn["conv_id"], "roles": "", "turns": []}, 0
                    begun_here = begun_here and not first
                run["roles"] += str(ROLES.get((turn["role"] or "").strip().lower(), START))
                run["turns"].append({"turn": turn["turn"], "text": turn["text"]})
                chars += len(turn["text"] or "")
        if run is not None:
            yield closed(False)

    return (conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
            .repartitionByRange(*order).sortWithinPartitions(*order, "text").mapInArrow(cut, RUN_DDL))


def _entry_costs(group: pd.DataFrame) -> pd.DataFrame:
    """Costs of the states before each run of a conversation, in the order of its runs."""
    group = group.sort_values(["task", "no"])
    costs, out = FROM_START, []
    for m in group["matrix"]:
        out.append(list(costs))
        costs = [min(min(costs[a] + m[4 * a + b] for a in STATES), FAR) for b in STATES]
    last = last_state(costs)
    return pd.DataFrame({"key": group["key"], "task": group["task"], "no": group["no"], "costs": out, "end": last})


def _ways(group: pd.DataFrame) -> pd.DataFrame:
    """Last state, messages and rows in front of each run, from its traces for every last state."""
    group = group.sort_values(["task", "no"])
    state, lasts, taken = int(group["end"].iloc[0]), [], []
    for traces in group["traces"].iloc[::-1]:
        lasts.append(state)
        taken.append(traces[3 * state:3 * state + 3])
        state = int(traces[3 * state])
    messages = pd.Series([0, *[int(t[1]) for t in taken[::-1]]]).cumsum()[:-1]
    rows = pd.Series([0, *[int(t[2]) for t in taken[::-1]]]).cumsum()[:-1]
    final = [False] * (len(group) - 1) + [True]
    return pd.DataFrame({"key": group["key"].to_numpy(), "task": group["task"].to_numpy(), "no": group["no"].to_numpy(),
                         "last": lasts[::-1], "messages": messages.to_numpy(), "seqs": rows.to_numpy(), "final": final})


def _traces_of(roles: str, costs: list[int]) -> list[int]:
    """For every last state: the first state, messages and rows of the run."""
    out = []
    for last in STATES:
        states = trace(roles, costs, last)
        reached = all(STEPS[int(r), a, b][1] for r, a, b in zip(roles, states, states[1:]))
        out += [states[0], *(counts(roles, states) if reached else (0, 0))]
    return out


def repair(conversations: DataFrame, run_turns: int = RUN_TURNS) -> DataFrame:
    """The repaired turns of ``conversations`` (conv_id, turn, role, text)."""
    bounded_batches(conversations.sparkSession)
    cut = materialize(runs(conversations, run_turns), "role-runs")
    matrix_of, traces_of = F.udf(matrix, "array<long>"), F.udf(_traces_of, "array<long>")
    parted = cut.where("not whole").select(_key(), "task", "no", "roles")
    costs = materialize(parted.select("key", "task", "no", matrix_of("roles").alias("matrix")).groupBy("key")
                        .applyInPandas(_entry_costs, "key string, task int, no int, costs array<long>, end int"), "role-costs")
    traces = parted.join(costs, ["key", "task", "no"]).select("key", "task", "no", "end",
                                                               traces_of("roles", "costs").alias("traces"))
    ways = traces.groupBy("key").applyInPandas(
        _ways, "key string, task int, no int, last int, messages long, seqs long, final boolean")
    known = materialize(costs.join(ways, ["key", "task", "no"]).select(
        "key", "task", "no", "costs", "last", "messages", "seqs", "final"), "role-ways")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for run in batch.to_pylist():
                if run["whole"]:
                    last = last_state(forward(run["roles"], FROM_START)[-1])
                    found = repaired(run, FROM_START, last, 0, 0, True)
                else:
                    found = repaired(run, run["costs"], run["last"], run["messages"], run["seqs"], run["final"])
                yield pa.RecordBatch.from_pylist(list(found), pa.schema(OUT))

    missing = [F.lit(None).cast(t).alias(n) for n, t in known.dtypes if n not in ("key", "task", "no")]
    inputs = ["conv_id", "whole", "roles", "turns", "costs", "last", "messages", "seqs", "final"]
    others = cut.where("not whole").withColumn("key", _key()).join(known, ["key", "task", "no"]).select(*inputs)
    return cut.where("whole").select("*", *missing).select(*inputs).unionAll(others).mapInArrow(decode, OUT_DDL)
