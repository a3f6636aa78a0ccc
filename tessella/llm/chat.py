"""Chat formatting by minimum-cost role repair.

Legal conversations are an optional system turn, then user and assistant turns by turns, the last an
assistant's. A dynamic program over that automaton chooses for every turn the cheapest way: keep its role,
relabel it, merge it into the turn before, and put one empty turn before it; at the end, empty turns may close
the conversation. The repaired sequence is rendered turn by turn: joined in order, the
`rendered` texts are the whole chat.

Turns are sorted by range, so a conversation of any size is spread over tasks. A piece of a
conversation is solved for every state in which it may begin and end; only the pieces at the edges of
a partition, two at most, meet afterwards.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

ROLES = ("system", "user", "assistant")
#: Roles under other names.
ALIASES = {"human": "user", "prompter": "user", "bot": "assistant", "gpt": "assistant", "model": "assistant", "ai": "assistant", "developer": "system"}
#: Costs: another role, a role for one that isn't known, a merge with a turn of the same role or another, an empty turn.
RELABEL, NAME, MERGE, MERGE_OTHER, INSERT = 2, 1, 1, 3, 2
START, OTHER = 0, 0  # states and roles are numbered alike: 1 system, 2 user, 3 assistant
LEGAL = {START: (1, 2), 1: (2,), 2: (3,), 3: (2,)}
#: The empty turns that end a conversation in a state.
CLOSING = {START: (), 1: (2, 3), 2: (3,), 3: ()}
HEAD, TAIL = "<|{}|>\n", "<|end|>\n"


def role_number(role: str | None) -> int:
    name = (role or "").strip().lower()
    name = ALIASES.get(name, name)
    return ROLES.index(name) + 1 if name in ROLES else OTHER


def _moves() -> dict[tuple[int, int], dict[int, tuple[int, str, tuple[int, ...]]]]:
    """(state, role) to the best move into each next state: (cost, action, empty turns before). Of equal costs the first listed."""
    table = {}
    for s in range(4):
        for r in range(4):
            best: dict[int, tuple[int, str, tuple[int, ...]]] = {}
            ways = []
            for q in (1, 2, 3):
                cost, action = (0, "keep") if q == r else (NAME if r == OTHER else RELABEL, "relabel")
                ways += [(q, cost, action, ())] if q in LEGAL[s] else []
                ways += [(q, cost + INSERT, action, (i,)) for i in LEGAL[s] if q in LEGAL[i]]
            if s != START:
                ways.append((s, MERGE if s == r or r == OTHER else MERGE_OTHER, "merge", ()))
            for q, cost, action, empty in ways:
                if q not in best or cost < best[q][0]:
                    best[q] = (cost, action, empty)
            table[s, r] = best
    return table


MOVES = _moves()
INF = 1 << 60


def solve(roles: list[int], entry: int) -> tuple[list[int], list[list[int]]]:
    """Costs of ending in each state from `entry`, and for every turn and state the state before."""
    cost = [INF] * 4
    cost[entry] = 0
    back = []
    for r in roles:
        new, came = [INF] * 4, [-1] * 4
        for s in range(4):
            if cost[s] < INF:
                for q, (c, _, _) in MOVES[s, r].items():
                    if cost[s] + c < new[q]:
                        new[q], came[q] = cost[s] + c, s
        cost = new
        back.append(came)
    return cost, back


def path(back: list[list[int]], exit_: int) -> list[int]:
    """The states before each turn and after the last, of the best way that ends in exit_."""
    states = [exit_]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1]


def best_exit(cost: list[int]) -> int:
    return min(range(4), key=lambda s: (cost[s] + INSERT * len(CLOSING[s]), s))


def repaired(texts: list[str], roles: list[int], states: list[int], last: bool, position: int = -1) -> list[tuple]:
    """(position, role, action, inserted, rendered) of each turn; position counts the repaired turns, empty ones too."""
    out = []
    for i, (text, r) in enumerate(zip(texts, roles, strict=True)):
        s, q = states[i], states[i + 1]
        _, action, empty = MOVES[s, r][q]
        shown = ""
        if action == "merge":
            shown = "\n" + text
        else:
            shown = (TAIL if s != START else "") + "".join(HEAD.format(ROLES[e - 1]) + TAIL for e in empty) + HEAD.format(ROLES[q - 1]) + text
            position += 1 + len(empty)
        closing = CLOSING[q] if last and i == len(roles) - 1 else ()
        if last and i == len(roles) - 1:
            shown += TAIL + "".join(HEAD.format(ROLES[e - 1]) + TAIL for e in closing)
        out.append((position, ROLES[q - 1], action, ",".join(ROLES[e - 1] for e in (*empty, *closing)), shown))
    return out


OUT = "conv_id string, turn string, position long, role string, action string, inserted string, rendered string"

def format_chats(turns: DataFrame) -> DataFrame:
    """Each row of turns (conv_id, turn, role, text) with its place, role and rendered text in the repaired conversation.

    Turns are taken in (turn, role, hash of the text) order, null turns last; null and empty texts stay as empty
    turns; unknown and null roles get the cheapest one. Rows of a null conv_id are one conversation. Ids and turns are integers.
    """
    spark = turns.sparkSession
    scratch = Scratch(spark, "chat")
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("tie", F.xxhash64("text"))
    # Range bounds are sampled to the driver, so no texts in them.
    keys = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_last(), F.col("role"), F.col("tie")]
    n = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    t = t.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    t = scratch.write(t.withColumn("part", F.spark_partition_id()).withColumn("at", F.monotonically_increasing_id()), "sorted")
    # A conversation that stands in two partitions is the last of one and the first of another.
    ends = t.groupBy("part").agg(F.min(F.struct("conv_id")).alias("lo"), F.max(F.struct("conv_id")).alias("hi"))
    ends = sorted(((r["part"], r["lo"]["conv_id"], r["hi"]["conv_id"]) for r in ends.collect()), key=lambda r: r[0])  # a row for each partition
    split = {c for (_, _, hi), (_, lo, _) in zip(ends, ends[1:], strict=False) for c in [lo] if lo == hi}

    def whole(key, frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("at")
        roles = [role_number(r) for r in f["role"]]
        cost, back = solve(roles, START)
        rows = repaired(f["text"].tolist(), roles, path(back, best_exit(cost)), True)
        out = pd.DataFrame(rows, columns=["position", "role", "action", "inserted", "rendered"])
        out.insert(0, "turn", f["turn"].values)
        out.insert(0, "conv_id", f["conv_id"].values)
        return out

    # Conversations of which a part stands elsewhere, at most one for each partition.
    apart = F.coalesce(F.col("conv_id").isin(*(c for c in split if c is not None)), F.lit(None in split))
    # Pandas has no integers beside nulls, so the two go through it as text.
    t = t.withColumns({"apart": apart, "conv_id": F.col("conv_id").cast("string"), "turn": F.col("turn").cast("string")})
    out = t.where("NOT apart").groupBy("part", "conv_id").applyInPandas(whole, OUT)
    if split:
        out = out.unionByName(_split(t.where("apart"), scratch))
    return out.withColumns({c: F.col(c).cast("long") for c in ("conv_id", "turn")})


def _split(t: DataFrame, scratch: Scratch) -> DataFrame:
    """The conversations that stand in several partitions: blocks of turns, solved for every state they may begin in."""
    block = 512
    from pyspark.sql import Window

    # A piece lies in one partition; its turns are numbered there and cut into blocks.
    t = t.withColumn("seq", F.row_number().over(Window.partitionBy("part", "conv_id").orderBy("at")) - 1)
    t = scratch.write(t.withColumn("block", F.floor(F.col("seq") / block)), "split")

    def costs(key, frame: pd.DataFrame) -> pd.DataFrame:
        roles = [role_number(r) for r in frame.sort_values("seq")["role"]]
        solved = [solve(roles, s) for s in range(4)]
        starts = []
        for _, back in solved:
            starts.append([_started(roles, path(back, q)) if back[-1][q] >= 0 else 0 for q in range(4)])
        return pd.DataFrame({"part": [key[0]], "conv_id": [frame["conv_id"].iloc[0]], "block": [key[2]], "cost": [[c for x, _ in solved for c in x]], "starts": [[c for x in starts for c in x]]})

    solved = t.groupBy("part", "conv_id", "block").applyInPandas(costs, "part int, conv_id string, block long, cost array<long>, starts array<long>")
    # A row for each block of a split conversation; of a conversation, they are combined in order.
    chosen = scratch.write(solved.groupBy("conv_id").applyInPandas(_choose, "part int, conv_id string, block long, entry int, leave int, last boolean, position long"), "chosen")

    def render(key, frame: pd.DataFrame) -> pd.DataFrame:
        f = frame.sort_values("seq")
        roles, entry, leave = [role_number(r) for r in f["role"]], int(f["entry"].iloc[0]), int(f["leave"].iloc[0])
        _, back = solve(roles, entry)
        rows = repaired(f["text"].tolist(), roles, path(back, leave), bool(f["last"].iloc[0]), int(f["position"].iloc[0]))
        out = pd.DataFrame(rows, columns=["position", "role", "action", "inserted", "rendered"])
        out.insert(0, "turn", f["turn"].values)
        out.insert(0, "conv_id", f["conv_id"].values)
        return out

    chosen = chosen.withColumnsRenamed({"part": "p", "conv_id": "c", "block": "b"})
    joined = t.join(chosen, (t["part"] == chosen["p"]) & t["conv_id"].eqNullSafe(chosen["c"]) & (t["block"] == chosen["b"])).drop("p", "c", "b")
    return joined.groupBy("part", "conv_id", "block").applyInPandas(render, OUT)


def _started(roles: list[int], states: list[int]) -> int:
    return sum(0 if m[1] == "merge" else 1 + len(m[2]) for m in (MOVES[s, r][q] for s, q, r in zip(states, states[1:], roles, strict=False)))


def _choose(frame: pd.DataFrame) -> pd.DataFrame:
    """The states in which each block of a conversation begins and ends, and the position before it."""
    f = frame.sort_values(["part", "block"])
    cost, back = [0, INF, INF, INF], []
    for block in f["cost"]:
        new, came = [INF] * 4, [-1] * 4
        for s in range(4):
            for q in range(4):
                if cost[s] < INF and block[4 * s + q] < INF and cost[s] + block[4 * s + q] < new[q]:
                    new[q], came[q] = int(cost[s] + block[4 * s + q]), s
        cost = new
        back.append(came)
    states = path(back, best_exit(cost))
    starts = [int(x[4 * s + q]) for x, s, q in zip(f["starts"], states, states[1:], strict=False)]
    before = (pd.Series(starts).cumsum() - starts - 1).tolist()
    return pd.DataFrame({"part": f["part"].values, "conv_id": f["conv_id"].values, "block": f["block"].values, "entry": states[:-1], "leave": states[1:], "last": [i == len(f) - 1 for i in range(len(f))], "position": before})
