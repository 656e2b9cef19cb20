"""Chat formatting by minimum-cost role repair.

A conversation is legal if an optional system turn is followed by turns of user and assistant in
turn, the user first. Every turn may be kept, merged with the one before, given another role, or
preceded by an empty turn; dynamic programming over the automaton of legal turns finds the
cheapest mixture, and the repaired conversation is rendered.

Rows are sorted by conversation and turn into ranges, so a conversation of any length may span
several partitions and none is gathered in a task. What a stretch of turns does to the automaton is
a small table of costs, one for each pair of states before and after it. Those of the stretches
that touch a partition's edge (two a partition) are chained on the driver, which fixes the states
at the edges; then every partition repairs and renders its own stretches.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dockmill.llm.common import cut, table

START, SYSTEM, USER, ASSISTANT = range(4)
STATES = range(4)
ROLES = {SYSTEM: "system", USER: "user", ASSISTANT: "assistant"}
#: Other names of the three roles: fixed values.
ALIASES = {"system": SYSTEM, "developer": SYSTEM, "user": USER, "human": USER, "prompter": USER, "assistant": ASSISTANT, "ai": ASSISTANT, "bot": ASSISTANT, "gpt": ASSISTANT, "model": ASSISTANT}
LEGAL = {(START, SYSTEM), (START, USER), (SYSTEM, USER), (ASSISTANT, USER), (USER, ASSISTANT)}
MERGE, RELABEL, NAME_UNKNOWN, INSERT = 2, 4, 1, 5
KEEP, MERGED, RELABELLED = "keep", "merge", "relabel"
FOREVER = 1 << 60
OUTPUT = "conv_id long, ordinal long, position long, turn long, role string, original_role string, action string, text string, rendered string"


def _moves() -> dict[int, list[list[tuple[int, str, int]]]]:
    """For a turn's own role (0: unknown), by state before and after: cost, action, role of the inserted turn (0: none)."""
    out = {}
    for own in (0, SYSTEM, USER, ASSISTANT):
        rows = []
        for before in STATES:
            row = []
            for after in STATES:
                choices = []
                if after != START:
                    named = 0 if own == after else RELABEL if own else NAME_UNKNOWN
                    action = RELABELLED if named else KEEP
                    if (before, after) in LEGAL:
                        choices.append((named, 0, action, 0))
                    if before == after:
                        choices.append((MERGE + named, 1, MERGED, 0))
                    choices += [(INSERT + named, 2, action, x) for x in (USER, ASSISTANT) if (before, x) in LEGAL and (x, after) in LEGAL]
                cost, _, action, inserted = min(choices, default=(FOREVER, 0, KEEP, 0))
                row.append((cost, action, inserted))
            rows.append(row)
        out[own] = rows
    return out


MOVES = _moves()


def own_role(role: str | None) -> int:
    return ALIASES.get((role or "").strip().lower(), 0)


def run(roles: Iterable[int], entry: int) -> tuple[list[int], list[list[int]]]:
    """Least cost of reaching each state from ``entry``, and each turn's best predecessor of each state (the smallest of equals)."""
    cost = [FOREVER] * 4
    cost[entry] = 0
    back = []
    for own in roles:
        moves, new, came = MOVES[own], [], []
        for after in STATES:
            best = min(STATES, key=lambda p: (cost[p] + moves[p][after][0], p))  # noqa: B023
            new.append(min(FOREVER, cost[best] + moves[best][after][0]))
            came.append(best)
        back.append(came)
        cost = new
    return cost, back


def path(back: list[list[int]], end: int) -> list[int]:
    """States after each turn on the best way to ``end``."""
    out = []
    for came in reversed(back):
        out.append(end)
        end = came[end]
    return out[::-1]


def summary(roles: list[int]) -> list[list[tuple[int, int, int, int]]]:
    """By state before and after a stretch: its least cost, the turns and rows that the best way writes, and a rank.

    Of ways of equal cost the one with the smaller last states is taken, as ``run`` does turn by
    turn; the rank orders the states before by it.
    """
    table, ways = [], []
    for entry in STATES:
        cost, back = run(roles, entry)
        row, ends = [], []
        for end in STATES:
            turns = rows = 0
            states = path(back, end)
            ends.append([*states[::-1][1:], entry])
            if cost[end] < FOREVER:
                before = entry
                for own, after in zip(roles, states, strict=True):
                    _, action, inserted = MOVES[own][before][after]
                    turns += (action != MERGED) + (inserted > 0)
                    rows += 1 + (inserted > 0)
                    before = after
            row.append((cost[end], turns, rows))
        table.append(row)
        ways.append(ends)
    return [[(*table[p][q], sorted(STATES, key=lambda x: ways[x][q]).index(p)) for q in STATES] for p in STATES]  # noqa: B023


def best_end(cost: list[int]) -> int:
    """The cheapest state to end in; a conversation of a system turn alone stays so."""
    return min((USER, ASSISTANT, SYSTEM), key=lambda s: (cost[s], s == SYSTEM, -s))


def _clean(text: str | None) -> str:
    return (text or "").replace("<|", "< |")


def render(conv_id, turns: list[tuple], entry: int, end: int, turn_at: int, row_at: int, more: bool) -> Iterator[tuple]:
    """Rows of one stretch of a conversation; ``turns`` has (turn, role, text), ``more`` says whether it goes on."""
    roles = [own_role(t[1]) for t in turns]
    _, back = run(roles, entry)
    before = entry
    last = len(turns) - 1
    for k, (own, after, (turn, role, text)) in enumerate(zip(roles, path(back, end), turns, strict=True)):
        _, action, inserted = MOVES[own][before][after]
        close = "<|end|>\n" if k == last and not more else ""
        if inserted:
            yield conv_id, row_at, turn_at, None, ROLES[inserted], None, "insert", "", ("<|end|>\n" if turn_at else "") + f"<|{ROLES[inserted]}|>\n"
            turn_at, row_at = turn_at + 1, row_at + 1
        if action == MERGED:
            yield conv_id, row_at, turn_at - 1, turn, ROLES[after], role, action, text or "", "\n" + _clean(text) + close
        else:
            yield conv_id, row_at, turn_at, turn, ROLES[after], role, action, text or "", ("<|end|>\n" if turn_at else "") + f"<|{ROLES[after]}|>\n" + _clean(text) + close
            turn_at += 1
        row_at += 1
        before = after


def _stretches(frames: Iterable[pd.DataFrame], columns: list[str]) -> Iterator[tuple[object, list[tuple]]]:
    """(conversation, rows) of consecutive rows; a null conversation is one like any other."""
    key, rows, begun = None, [], False
    for frame in frames:
        for row in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False, name=None):
            if not begun or row[0] != key:
                if begun:
                    yield key, rows
                key, rows, begun = row[0], [], True
            rows.append(row[1:])
    if begun:
        yield key, rows


def _edges(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition's first and last conversation: id, place, and the summary's figures."""
    first = last = None
    number = 0
    for key, rows in _stretches(frames, ["conv_id", "role"]):
        if first is None:
            first = (key, [own_role(r[0]) for r in rows])
        last, number = (key, rows), number + 1
    out = []
    if first:
        parts = [(0, *first)] + ([(1, last[0], [own_role(r[0]) for r in last[1]])] if number > 1 else [])
        for place, key, roles in parts:
            out.append((TaskContext.get().partitionId(), place, number, key, [x for row in summary(roles) for cell in row for x in cell]))
    yield pd.DataFrame(out, columns=["part", "place", "number", "conv_id", "figures"]).astype({"conv_id": "Int64"})


def chain(edges: list) -> dict[tuple[int, int], tuple[int, int, int, int, bool]]:
    """For the stretches of conversations that span partitions, by (partition, place): state before and after, turns and rows so far, whether more follows."""
    groups: list[list] = []
    for e in sorted(edges, key=lambda e: (e.part, e.place)):
        joins = groups and groups[-1][-1].conv_id == e.conv_id and groups[-1][-1].part < e.part and (groups[-1][-1].place == 1 or groups[-1][-1].number == 1) and e.place == 0
        if joins:
            groups[-1].append(e)
        else:
            groups.append([e])
    fixed = {}
    for group in groups:
        if len(group) < 2:
            continue
        tables = [[[tuple(e.figures[(p * 4 + q) * 4 : (p * 4 + q) * 4 + 4]) for q in STATES] for p in STATES] for e in group]
        cost, back = [0, FOREVER, FOREVER, FOREVER], []
        for t in tables:
            came = [min(STATES, key=lambda p: (cost[p] + t[p][q][0], t[p][q][3])) for q in STATES]  # noqa: B023
            cost = [min(FOREVER, cost[came[q]] + t[came[q]][q][0]) for q in STATES]
            back.append(came)
        states = path(back, best_end(cost))
        before = turns = rows = 0
        for k, (e, t, after) in enumerate(zip(group, tables, states, strict=True)):
            fixed[e.part, e.place] = (before, after, turns, rows, k < len(group) - 1)
            turns, rows, before = turns + t[before][after][1], rows + t[before][after][2], after
    return fixed


def repair_conversations(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per turn of the repaired conversations, inserted turns included.

    conv_id, ordinal (place among the conversation's rows), position (number of the repaired turn;
    merged rows share it), turn, role, original_role, action, text, rendered. The concatenation of
    ``rendered`` by ordinal is the formatted conversation; ``<|`` inside a text is broken by a
    space. Turns are ordered by turn, equal ones by role and a hash of the text; null turns come first,
    repeated rows follow one another. A null or unknown role can become any at a low cost, a null text is empty.
    Rows without a conversation form one. An empty table gives no rows; other columns are ignored,
    whatever their names.
    """
    spark = turns.sparkSession
    rows = turns.select(F.col(conv_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"), F.col(role_col).cast("string").alias("role"), F.col(text_col).cast("string").alias("text"))
    keys = ["conv_id", "turn", "role", "text"]
    rows = rows.withColumn("spread", F.xxhash64("text"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    # equal rows are spread by their number; it only decides between rows that don't differ
    rows = rows.withColumn("number", F.monotonically_increasing_id()).repartitionByRange(parts, "conv_id", "turn", "role", "spread", "number")
    rows = cut(rows.sortWithinPartitions("conv_id", "turn", "role", "spread", "number").select(*keys))
    edges = rows.select("conv_id", "role").mapInPandas(_edges, "part int, place int, number long, conv_id long, figures array<long>").collect()
    fixed = spark.sparkContext.broadcast(chain(edges))
    ends = spark.sparkContext.broadcast({(e.part, e.place): e.number for e in edges})

    def repair(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part = TaskContext.get().partitionId()
        number = ends.value.get((part, 0), 0)
        out: list[tuple] = []
        names = [c.split()[0] for c in OUTPUT.split(", ")]
        for k, (key, rows) in enumerate(_stretches(frames, keys)):
            place = 0 if k == 0 else 1 if k == number - 1 else None
            known = fixed.value.get((part, place))
            if known is None:
                known = (START, best_end(run([own_role(r[1]) for r in rows], START)[0]), 0, 0, False)
            out += render(key, rows, *known)
            if len(out) > 5000:
                yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64", "turn": "Int64"})
                out = []
        yield pd.DataFrame(out, columns=names).astype({"conv_id": "Int64", "turn": "Int64", "ordinal": "int64", "position": "int64"})

    return rows.mapInPandas(repair, OUTPUT)


def op10_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))
