"""Chat formatting: minimum-cost role repair over a legal-turn automaton, then rendering.

Legal sequences: an optional system message, then user and assistant in turn, ending with
the assistant.  Each turn is kept, relabelled, or merged into the message before it; empty
messages may be inserted.  Costs are KEEP < MERGE_SAME < RELABEL < INSERT < MERGE_OTHER.

The dynamic program runs over the state "role of the last message".  A turn is a min-plus
matrix over states that depends on its role only, so conversations are put in order by a
range sort and cut into chunks of CHUNK rows at most: (1) each chunk's matrix product,
(2) the states at chunk borders, one small matrix a chunk, (3) each chunk's own path
between its border states.  No task holds a whole long conversation's text, whatever its
turn numbers; the texts meet their repairs by a join on (conversation, chunk, place).

Every input turn gives one row whose ``fragment`` is its part of the rendering; the
fragments by ``position`` (which orders by turn, role and a hash of the text) are the
rendered conversation.  Null texts render as empty; roles that are null or unknown are
relabelled; a null turn comes last; a row with a null conv_id belongs to no other and is a
conversation of its own; rows that repeat are turns of their own; other columns of the
input are not read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import written

CHUNK = 256
START, SYSTEM, USER, ASSISTANT = range(4)
NAMES = ["start", "system", "user", "assistant"]
KEEP, MERGE_SAME, RELABEL, INSERT, MERGE_OTHER = 0, 1, 3, 4, 6
#: The automaton: roles that may follow each state.
FOLLOWS = {START: (SYSTEM, USER), SYSTEM: (USER,), USER: (ASSISTANT,), ASSISTANT: (USER,)}
#: Cost of the empty messages that complete a conversation which ends in this state, and their roles.
ENDING = {START: (0, ()), ASSISTANT: (0, ()), USER: (INSERT, (ASSISTANT,)), SYSTEM: (2 * INSERT, (USER, ASSISTANT))}
_FAR = 1 << 28


def moves_of(code: int) -> list[tuple[int, int, int, str, int]]:
    """(state before, state after, cost, operation, inserted role or 0) of a turn with role ``code`` (0: unknown)."""
    out = []
    for before in range(4):
        if before != START:
            out.append((before, before, MERGE_SAME if before == code else MERGE_OTHER, "merge", 0))
        for role in (USER, ASSISTANT, SYSTEM):
            cost, op = (KEEP, "keep") if role == code else (RELABEL, "relabel")
            if role in FOLLOWS[before]:
                out.append((before, role, cost, op, 0))
            else:
                for between in FOLLOWS[before]:
                    if role in FOLLOWS[between]:
                        out.append((before, role, cost + INSERT, op, between))
    return out


_MOVES = [moves_of(code) for code in range(4)]


def matrix_of(codes) -> np.ndarray:
    """Min-plus product of the turns' matrices: least cost from each state to each state."""
    steps = []
    for moves in _MOVES:
        m = np.full((4, 4), _FAR, np.int64)
        for a, b, cost, _, _ in moves:
            m[a, b] = min(m[a, b], cost)
        steps.append(m)
    total = np.full((4, 4), _FAR, np.int64)
    np.fill_diagonal(total, 0)
    for c in codes:
        total = np.minimum((total[:, :, None] + steps[c][None]).min(axis=1), _FAR)
    return total


def borders(matrices: list[np.ndarray]) -> tuple[int, list[int]]:
    """(least cost with the ending, states at chunk borders from START on)."""
    costs = [np.array([0, _FAR, _FAR, _FAR])]
    for m in matrices:
        costs.append((costs[-1][:, None] + m).min(axis=0))
    last = [int(costs[-1][s]) + ENDING[s][0] for s in range(4)]
    state = int(np.argmin(last))
    states = [state]
    for m, before in zip(reversed(matrices), reversed(costs[:-1])):
        state = int(np.argmin(before + m[:, state]))
        states.append(state)
    return min(last), states[::-1]


def path_of(codes, entry: int, leave: int) -> list[tuple[str, int, int]]:
    """(operation, role after, inserted role) of each turn on a least-cost path between two states."""
    cost = [0 if s == entry else _FAR for s in range(4)]
    back = []
    for c in codes:
        best = [(_FAR, None)] * 4
        for move in _MOVES[c]:
            total = cost[move[0]] + move[2]
            if total < best[move[1]][0]:
                best[move[1]] = (total, move)
        back.append([b[1] for b in best])
        cost = [b[0] for b in best]
    out, state = [], leave
    for choice in reversed(back):
        before, after, _, op, between = choice[state]
        out.append((op, after, between))
        state = before
    return out[::-1]


def repaired(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, position, operation, role, inserted, cost, fragment) of every turn; ``cost`` is the conversation's least cost."""
    role = F.lower(F.trim(F.coalesce(F.col("role").cast("string"), F.lit(""))))
    code = F.when(role == "system", SYSTEM).when(role == "user", USER).when(role == "assistant", ASSISTANT).otherwise(0)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        role.alias("given"), code.alias("code"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("given"), F.xxhash64("text")]
    n = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed_rows = rows.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("position", F.monotonically_increasing_id())
    # Written, which fixes the positions; they ascend along the sort, so a chunk is a stretch of one conversation.
    rows = written(placed_rows, "turns").withColumn("conv", F.coalesce("conv_id", F.lit(0))).withColumn("own", F.when(F.col("conv_id").isNull(), F.col("position")).otherwise(F.lit(-1))).withColumn("chunk", F.floor(F.col("position") / CHUNK))
    codes = rows.groupBy("conv", "own", "chunk").agg(F.array_sort(F.collect_list(F.struct("position", "code"))).alias("turns")).select("conv", "own", "chunk", F.col("turns.code").alias("codes"))

    def products(batches):
        for pdf in batches:
            yield pd.DataFrame({"conv": pdf["conv"], "own": pdf["own"], "chunk": pdf["chunk"], "codes": pdf["codes"], "matrix": [matrix_of(c).ravel() for c in pdf["codes"]]})

    chunks = codes.mapInPandas(products, "conv long, own long, chunk long, codes array<int>, matrix array<long>")
    lists = chunks.groupBy("conv", "own").agg(F.array_sort(F.collect_list(F.struct("chunk", "matrix"))).alias("chunks"))

    def states(batches):
        for pdf in batches:
            out = []
            for conv, own, parts in zip(pdf["conv"], pdf["own"], pdf["chunks"]):
                cost, at = borders([np.asarray(p["matrix"]).reshape(4, 4) for p in parts])
                out += [(conv, own, p["chunk"], at[i], at[i + 1], i == len(parts) - 1, cost) for i, p in enumerate(parts)]
            yield pd.DataFrame(out, columns=["conv", "own", "chunk", "entry", "leave", "final", "cost"])

    placed = lists.mapInPandas(states, "conv long, own long, chunk long, entry int, leave int, final boolean, cost long")

    def paths(batches):
        for pdf in batches:
            out = []
            for conv, own, chunk, codes, entry, leave, final, cost in zip(*[pdf[c] for c in ("conv", "own", "chunk", "codes", "entry", "leave", "final", "cost")]):
                path = path_of(codes, entry, leave)
                for i, (op, after, between) in enumerate(path):
                    first = entry == START and i == 0
                    ending = [NAMES[r] for r in ENDING[after][1]] if final and i == len(path) - 1 else []
                    out.append((conv, own, chunk, i + 1, op, NAMES[after], NAMES[between] if between else None, first, final and i == len(path) - 1, ending, cost))
            yield pd.DataFrame(out, columns=["conv", "own", "chunk", "place", "operation", "role", "inserted", "first", "last", "ending", "cost"])

    ops = chunks.select("conv", "own", "chunk", "codes").join(placed, ["conv", "own", "chunk"]).mapInPandas(paths, "conv long, own long, chunk long, place int, operation string, role string, inserted string, first boolean, last boolean, ending array<string>, cost long")
    place = F.row_number().over(Window.partitionBy("conv", "own", "chunk").orderBy("position"))
    both = rows.withColumn("place", place).join(ops, ["conv", "own", "chunk", "place"])

    def opened(name):
        return F.concat(F.lit("<|"), name, F.lit("|>\n"))

    closed = F.lit("<|end|>\n")
    empty = F.when(F.col("inserted").isNotNull(), F.concat(opened(F.col("inserted")), closed)).otherwise(F.lit(""))
    begun = F.concat(F.when(F.col("first"), F.lit("")).otherwise(closed), empty, opened(F.col("role")), F.col("text"))
    body = F.when(F.col("operation") == "merge", F.concat(F.lit("\n\n"), F.col("text"))).otherwise(begun)
    tail = F.when(F.col("last"), F.concat(closed, F.array_join(F.transform("ending", lambda r: F.concat(opened(r), closed)), ""))).otherwise(F.lit(""))
    return both.select("conv_id", "turn", "position", "operation", "role", "inserted", "cost", F.concat(body, tail).alias("fragment"))


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
