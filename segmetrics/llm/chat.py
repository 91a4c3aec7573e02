"""Chat formatting with minimum-cost role repair.

Legal conversations are those of an automaton: an optional system message,
then user and assistant in turn, ending with the assistant. For each turn a
dynamic program chooses to keep its role, to relabel it, to merge it into the
message before (with or without a relabel), and to insert empty messages
before it, at the least total ``Costs``; at the end, messages are inserted
until the conversation may stop. Ties go to the first choice in the order of
``_steps``. The repaired sequence is rendered as fragments, one per turn or
inserted message; a conversation's fragments in order of ``pos`` are its text.

A conversation may hold a third of all rows, so none is collected. Turns are
sorted over all partitions by range. The program over a run of turns is a 4 x 4
matrix of costs (state before -> state after), and only the first and the last
run of a partition can go on elsewhere: those matrices, two for each
partition, are chained on the driver, which fixes the states at the borders.
Then every partition solves its runs between fixed states alone. Sorted turns are
written to the shared checkpoint folder before, so both passes see the same
partitions whatever executors are lost.

Defined results: order by turn (null first), then role, then text; an exactly
repeated row counts once; a null or unknown role fits nothing and is
relabelled; a null text is empty; a null conv_id is a conversation of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from segmetrics.session import materialize

ROLES = ("system", "user", "assistant")
OPEN, CLOSE, JOIN = "<|{}|>\n", "<|end|>\n", "\n"

# State 0: nothing yet; state r + 1: the last message has role r.
START, DONE = 0, 3
LEGAL = {0: (0, 1), 1: (1,), 2: (2,), 3: (1,)}
FAR = 1 << 40


@dataclass(frozen=True)
class Costs:
    merge: int = 1
    insert: int = 2
    relabel: int = 3


@dataclass(frozen=True)
class Step:
    cost: int
    inserts: tuple[int, ...]
    role: int
    merged: bool
    relabelled: bool


def insertions(state: int) -> dict[int, tuple[int, ...]]:
    """State -> fewest roles to insert to reach it."""
    reach: dict[int, tuple[int, ...]] = {state: ()}
    queue = [state]
    for at in queue:
        for role in LEGAL[at]:
            if role + 1 not in reach:
                reach[role + 1] = (*reach[at], role)
                queue.append(role + 1)
    return reach


def _steps(costs: Costs) -> list[list[dict[int, Step]]]:
    """[role of the turn, 3 for others][state before] -> {state after: cheapest step}."""
    table = []
    for role in range(4):
        rows = []
        for state in range(4):
            best: dict[int, Step] = {}
            options = []
            for at, inserts in insertions(state).items():
                paid = costs.insert * len(inserts)
                options += [(q + 1, Step(paid + (q != role) * costs.relabel, inserts, q, False, q != role)) for q in LEGAL[at]]
            if state != START:
                own = state - 1
                options.append((state, Step(costs.merge + (own != role) * costs.relabel, (), own, True, own != role)))
            for after, step in options:
                if after not in best or step.cost < best[after].cost:
                    best[after] = step
            rows.append(best)
        table.append(rows)
    return table


def endings(costs: Costs) -> list[int]:
    """Cost of inserting messages until the conversation may stop, by state."""
    return [costs.insert * len(insertions(s).get(DONE, ())) for s in range(4)]


class Repair:
    """The program over runs of turns. Cost vectors, less their minimum, are few; steps between them are remembered."""

    def __init__(self, costs: Costs):
        self.steps, self.ends = _steps(costs), endings(costs)
        self._seen: dict[tuple, tuple] = {}

    def advance(self, vector: tuple[int, ...], role: int) -> tuple[tuple[int, ...], int, tuple[int, ...]]:
        """(next vector less its minimum, that minimum, state before for each state after)."""
        if (found := self._seen.get((vector, role))) is None:
            new, back = [FAR] * 4, [-1] * 4
            for state, paid in enumerate(vector):
                if paid < FAR:
                    for after, step in self.steps[role][state].items():
                        if paid + step.cost < new[after]:
                            new[after], back[after] = paid + step.cost, state
            low = min(new)
            found = self._seen[vector, role] = (tuple(min(FAR, x - low) if x < FAR else FAR for x in new), low, tuple(back))
        return found

    def matrix(self, roles: list[int]) -> list[list[int]]:
        """Least cost from each state before a run to each state after it."""
        out = []
        for state in range(4):
            vector, paid = tuple(0 if s == state else FAR for s in range(4)), 0
            for role in roles:
                vector, low, _ = self.advance(vector, role)
                paid += low
            out.append([x + paid if x < FAR else FAR for x in vector])
        return out

    def solve(self, roles: list[int], before: int, after: int | None) -> list[tuple[int, Step]]:
        """(state before, step) of each turn; ``after`` None: the conversation ends here."""
        vector, backs = tuple(0 if s == before else FAR for s in range(4)), []
        for role in roles:
            vector, _, back = self.advance(vector, role)
            backs.append(back)
        if after is None:
            after = min(range(4), key=lambda s: (vector[s] + self.ends[s] if vector[s] < FAR else FAR, s))
        path = []
        for role, back in zip(reversed(roles), reversed(backs)):
            state = back[after]
            path.append((state, self.steps[role][state][after]))
            after = state
        return path[::-1]


def _role_number(role: str | None) -> int:
    return ROLES.index(role) if role in ROLES else 3


def sorted_turns(conversations: DataFrame) -> DataFrame:
    """Distinct turns sorted over all partitions, with ``part`` and ``seq`` in it, written."""
    rows = conversations.select("conv_id", "turn", "role", "text").dropDuplicates(["conv_id", "turn", "role", "text"])
    order = ["conv_id", "turn", "role", F.xxhash64("text"), "text"]
    parts = int(conversations.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = rows.repartitionByRange(parts, *order).sortWithinPartitions(*order)
    return materialize(placed.select("*", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("seq")), "turns")


def _runs(frames: Iterator[pd.DataFrame], columns: tuple[str, ...]) -> Iterator[tuple[int, bool, bool, list[list]]]:
    """(part, first of its part, last of its part, columns) of each run of one conversation within a part."""
    key, held, first = None, [[] for _ in columns], True
    for frame in frames:
        values = [frame[c].tolist() for c in columns]
        parts, convs = frame["part"].tolist(), [None if pd.isna(c) else c for c in frame["conv_id"].tolist()]
        for i, here in enumerate(zip(parts, convs)):
            if key is not None and here != key:
                yield key[0], first, here[0] != key[0], held
                held, first = [[] for _ in columns], here[0] != key[0]
            key = here
            for h, v in zip(held, values):
                h.append(v[i])
    if key is not None:
        yield key[0], first, True, held


def _border_runs(turns: DataFrame, costs: Costs) -> list:
    """First and last run of every partition with its matrix, in order (two rows a partition)."""

    def summarize(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair = Repair(costs)
        for part, first, last, (convs, roles) in _runs(frames, ("conv_id", "role")):
            if first or last:
                matrix = repair.matrix([_role_number(r) for r in roles])
                yield pd.DataFrame({"part": [part], "is_first": [first], "conv_id": [None if pd.isna(convs[0]) else int(convs[0])], "n": [len(roles)], "costs": [sum(matrix, [])]}).astype({"conv_id": "Int64"})

    kind = "part int, is_first boolean, conv_id long, n long, costs array<long>"
    found = _grouped(turns.select("part", "seq", "conv_id", "role")).mapInPandas(summarize, kind).collect()
    return sorted(found, key=lambda r: (r["part"], not r["is_first"]))


def _grouped(turns: DataFrame) -> DataFrame:
    return turns.repartition("part").sortWithinPartitions("part", "seq")


def border_states(runs: list, costs: Costs) -> dict[tuple[int, bool], tuple[int, int | None, int, bool]]:
    """(part, first run?) -> (state before, state after or None at the end, turns before, goes on).

    Runs of one conversation in consecutive partitions form a chain.
    """
    ends, plan, i = endings(costs), {}, 0
    while i < len(runs):
        chain = [runs[i]]
        while i + len(chain) < len(runs) and (after := runs[i + len(chain)])["conv_id"] == chain[-1]["conv_id"] and after["part"] != chain[-1]["part"]:
            chain.append(after)
        i += len(chain)
        costs_to = [[0 if s == START else FAR for s in range(4)]]
        for run in chain:
            costs_to.append([min(costs_to[-1][s] + run["costs"][4 * s + t] for s in range(4)) for t in range(4)])
        state = min(range(4), key=lambda s: (costs_to[-1][s] + ends[s], s))
        states = [state]
        for k in range(len(chain) - 1, -1, -1):
            state = START if k == 0 else min(range(4), key=lambda s: (costs_to[k][s] + chain[k]["costs"][4 * s + states[-1]], s))
            states.append(state)
        states, turn = states[::-1], 0
        for k, run in enumerate(chain):
            final = k == len(chain) - 1
            plan[run["part"], run["is_first"]] = (states[k], None if final else states[k + 1], turn, not final)
            turn += run["n"]
    return plan


def _rendered(repair: Repair, conv, turns: list, roles: list, texts: list, before: int, after: int | None, base: int) -> list[tuple]:
    """Output rows of a run; a conversation has four positions for every turn."""
    out = []
    numbers = [_role_number(r) for r in roles]
    state = before
    for i, (state, step) in enumerate(repair.solve(numbers, before, after)):
        pos, at = 4 * (base + i), state
        for k, role in enumerate(step.inserts):
            out.append([conv, pos + k, None, ROLES[role], None, "insert", (CLOSE if at else "") + OPEN.format(ROLES[role])])
            at = role + 1
        text = "" if texts[i] is None else texts[i]
        action = ("merge_relabel" if step.relabelled else "merge") if step.merged else "relabel" if step.relabelled else "keep"
        fragment = JOIN + text if step.merged else (CLOSE if at else "") + OPEN.format(ROLES[step.role]) + text
        out.append([conv, pos + 3, None if pd.isna(turns[i]) else int(turns[i]), ROLES[step.role], roles[i], action, fragment])
        state = step.role + 1
    if after is None:
        for k, role in enumerate(insertions(state)[DONE]):
            out.append([conv, 4 * (base + len(turns)) + k, None, ROLES[role], None, "insert", CLOSE + OPEN.format(ROLES[role])])
        out[-1][6] += CLOSE
    return [tuple(x) for x in out]


OUTPUT = "conv_id long, pos long, turn long, role string, source_role string, action string, fragment string"


def repaired_chats(conversations: DataFrame, costs: Costs = Costs()) -> DataFrame:
    """Fragments of the repaired, rendered conversations.

    conv_id, pos (order in the conversation), turn (null: inserted), role,
    source_role, action (keep, relabel, merge, merge_relabel, insert), fragment.
    """
    turns = sorted_turns(conversations.withColumns({"conv_id": F.col("conv_id").cast("long"), "turn": F.col("turn").cast("long")}))
    plan = border_states(_border_runs(turns, costs), costs)

    def render(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        repair, rows, held = Repair(costs), [], 0
        names = [c.split()[0] for c in OUTPUT.split(", ")]

        def table() -> pd.DataFrame:
            return pd.DataFrame(rows, columns=names).astype({"conv_id": "Int64", "turn": "Int64", "pos": "int64"})

        for part, first, last, (convs, order, roles, texts) in _runs(frames, ("conv_id", "turn", "role", "text")):
            before, after, base, _ = plan[part, first] if first or last else (START, None, 0, False)
            conv = None if pd.isna(convs[0]) else int(convs[0])
            rows += _rendered(repair, conv, order, roles, texts, before, after, base)
            held += sum(len(t) for t in texts if t is not None)
            if len(rows) >= 5000 or held >= 4_000_000:
                yield table()
                rows, held = [], 0
        if rows:
            yield table()

    return _grouped(turns).mapInPandas(render, OUTPUT)
