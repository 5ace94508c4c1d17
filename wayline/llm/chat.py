"""Chat formatting with the cheapest repair of the roles.

A conversation is legal if an optional system turn is followed by user and assistant turns in alternation,
the last one of the assistant. Each turn may be kept, given another role, or merged into the turn before
it; empty turns may be put in. Over the automaton's states the cheapest repair of a turn sequence is a
shortest path, found by dynamic programming: a turn is a matrix of costs from state to state, and the
matrices of turns in a row multiply in the (min, +) algebra. So a conversation need not lie in one task:
the rows are range-partitioned by conversation and turn, each partition gives the product for a
conversation that goes on beyond its edges, the driver chains these few products (two for each partition at most)
and tells each partition the states at its edges, and each turn's repair and rendering is then local.

The costs are a parameter. As they stand, a merge (1) is the cheapest, as two turns of one speaker in a row are
usually one turn cut in two and nothing said is changed; an empty turn (2) adds what nobody said but leaves all that was
said with its speaker; another role (4) puts words into another mouth and is taken only for unknown roles and system
turns that come late. Where relabels shall be preferred, give them a lower cost.

Among repairs of equal cost, that with fewer empty turns, then fewer merges, then fewer relabels wins; these
counts are carried beside the cost and compared in this order. Among repairs that are equal in all this, the last
turn ends in the role that stands first in ROLES, and so on backwards from the end.

Defined results: turns are ordered by turn (null first), role, hash of the text; repeated rows are turns of
their own; a null text is empty, a text of any length is one piece; a null or unknown role is relabelled at the usual
cost; the rows without a conv_id make one conversation. `position` counts a conversation's turns from 0 in that order, and
the pieces in the order of their positions are the conversation's rendering; no group is gathered to make it.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import column, shared_root, small_batches

ROLES = ("system", "user", "assistant")
#: Other names of the roles.
NAMES = {"system": 0, "user": 1, "human": 1, "prompter": 1, "assistant": 2, "gpt": 2, "bot": 2, "model": 2}
#: Costs of the repairs: an empty turn, a merge, another role.
INSERT, MERGE, RELABEL = 2, 1, 4
#: A cost and the numbers of empty turns, merges and relabels are one whole number, each of the last three in PART bits.
PART = 48
FAR = 1 << 4 * PART
START, STATES = 3, 4
#: Roles that may follow each state: after system, user, assistant, and at the start.
NEXT = {0: (1,), 1: (2,), 2: (1,), START: (0, 1)}
#: A state in which a conversation may end.
FINAL = 2


def _inserts(state: int, role: int) -> tuple[int, ...] | None:
    """The fewest empty turns after which `role` may follow `state`."""
    paths = [(state, ())]
    for _ in range(4):
        for at, path in paths:
            if role in NEXT[at]:
                return path
        paths = [(r, (*path, r)) for at, path in paths for r in NEXT[at] if r]
    return None


class Automaton:
    """The costs of a turn as matrices: cost[role, state, new state], and what is done, (action, empty turns before)."""

    def __init__(self, insert: int = INSERT, merge: int = MERGE, relabel: int = RELABEL):
        if min(insert, merge, relabel) < 0 or max(insert, merge, relabel) >= 1 << 16:
            raise ValueError("costs must be from 0 to 65535")
        insert, merge, relabel = (insert << 3 * PART) + (1 << 2 * PART), (merge << 3 * PART) + (1 << PART), (relabel << 3 * PART) + 1
        self.cost, self.done = np.full((4, STATES, STATES), FAR, dtype=object), {}
        for role in range(4):  # 3: unknown
            for state in range(STATES):
                for new in range(3):
                    options = []
                    path = _inserts(state, new)
                    if path is not None:
                        options.append((insert * len(path) + (0 if role == new else relabel), "keep" if role == new else "relabel", path))
                    if state == new:
                        options.append((merge + (0 if role == new else relabel), "merge" if role == new else "relabel_merge", ()))
                    if options:
                        best = min(options)
                        self.cost[role, state, new] = best[0]
                        self.done[role, state, new] = best[1:]
        self.end = np.array([insert * (0 if s == FINAL else len(_inserts(s, FINAL)) + 1) for s in range(3)] + [0], dtype=object)

    def product(self, roles: list[int]) -> np.ndarray:
        """Least cost from each state to each state over the turns."""
        total = np.full((STATES, STATES), FAR, dtype=object)
        np.fill_diagonal(total, 0)
        for r in roles:
            total = np.minimum((total[:, :, None] + self.cost[r][None, :, :]).min(axis=1), FAR)
        return total

    def path(self, roles: list[int], entry: int, leave: int | None) -> list[int]:
        """States before each turn and after the last, the cheapest from entry to leave (None: to the end)."""
        # Plain numbers: four states are too few for arrays to be faster.
        steps = [[[int(c) for c in row] for row in m] for m in self.cost]
        cost = [FAR] * STATES
        cost[entry] = 0
        back = []
        for r in roles:
            step = steps[r]
            ways = [min((cost[s] + step[s][new], s) for s in range(STATES)) for new in range(STATES)]
            back.append([s for _, s in ways])
            cost = [min(c, FAR) for c, _ in ways]
        state = min((c + e, s) for s, (c, e) in enumerate(zip(cost, self.end)))[1] if leave is None else leave
        out = [state]
        for b in reversed(back):
            state = b[state]
            out.append(state)
        return out[::-1]

    def edges(self, summaries: list[tuple]) -> dict[tuple[int, bool], tuple[int, int | None, int]]:
        """summaries: (block, conv_id, first, last, product, turns) of the first and last conversation of each block.
        Entry and exit state (None: it ends here) and the first position of those that go on before or after; keys
        (block, is it the first)."""
        chains: list[list[tuple]] = []
        previous = None
        for s in sorted(summaries, key=lambda s: (s[0], not s[2])):
            if s[2] and previous is not None and previous[3] and previous[1] == s[1]:
                chains[-1].append(s)
            else:
                chains.append([s])
            previous = s
        out = {}
        for chain in chains:
            cost = np.full(STATES, FAR, dtype=object)
            cost[START] = 0
            back = []
            for s in chain:
                ways = cost[:, None] + np.array([int(x) for x in s[4]], dtype=object).reshape(STATES, STATES)
                back.append(ways.argmin(axis=0))
                cost = np.minimum(ways.min(axis=0), FAR)
            states = [int((cost + self.end).argmin())]
            for b in reversed(back):
                states.append(int(b[states[-1]]))
            states.reverse()
            position = 0
            for k, s in enumerate(chain):
                out[s[0], s[2]] = (states[k], None if k == len(chain) - 1 else states[k + 1], position)
                position += s[5]
        return out


USUAL = Automaton()


def path(roles: list[int], entry: int, leave: int | None) -> list[int]:
    """Automaton.path at the usual costs."""
    return USUAL.path(roles, entry, leave)


def role_of(name: str | None) -> int:
    return NAMES.get((name or "").strip().lower(), 3)


def _opened(role: int) -> str:
    return f"<|{ROLES[role]}|>\n"


CLOSED = "<|end|>\n"


def rendered(texts: list[str | None], roles: list[int], states: list[int], ends: bool, automaton: Automaton = USUAL) -> list[tuple[str, str, list[str], int, str]]:
    """For each turn: action, role, roles of empty turns put before it, number of empty turns put after it, piece of the rendering."""
    out = []
    for k, (text, role) in enumerate(zip(texts, roles)):
        state, new = states[k], states[k + 1]
        action, before = automaton.done[role, state, new]
        text = text or ""
        if action.endswith("merge"):
            piece = f"\n{text}"
        else:
            piece = ("" if state == START else CLOSED) + "".join(_opened(r) + CLOSED for r in before) + _opened(new) + text
        after: tuple[int, ...] = ()
        if ends and k == len(roles) - 1:
            after = () if new == FINAL else (*_inserts(new, FINAL), FINAL)
            piece += CLOSED + "".join(_opened(r) + CLOSED for r in after)
        out.append((action, ROLES[new], [ROLES[r] for r in before], len(after), piece))
    return out


def _segments(batches):
    """(conv_id, list of (batch, row), is it the partition's first) in order; one conversation's rows at a time."""
    held, current, first, any_ = [], None, True, False
    for batch in batches:
        for i, conv in enumerate(column(batch, "conv_id")):
            if any_ and conv != current:
                yield current, held, first, False
                held, first = [], False
            current, any_ = conv, True
            held.append((batch, i))
    if any_:
        yield current, held, first, True


def repair(turns: DataFrame, insert: int = INSERT, merge: int = MERGE, relabel: int = RELABEL) -> DataFrame:
    """turns: conv_id, turn, role, text. For each turn: conv_id, turn, position, old_role, action, role, before (roles
    of empty turns put before it), after (number of empty turns put after it), piece. insert, merge, relabel: the costs."""
    automaton = Automaton(insert, merge, relabel)
    spark = turns.sparkSession
    small_batches(spark)
    shared_root(spark)  # there must be a checkpoint folder
    data = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    data = data.withColumns({"tie": F.xxhash64("text"), "uid": F.monotonically_increasing_id()})
    keys = ["conv_id", "turn", "role", "tie", "uid"]
    # The checkpoint fixes what lies in which partition; a lost executor's part is read again, not dealt anew.
    data = data.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("block", F.spark_partition_id()).drop("tie", "uid").checkpoint()
    conv, turn = data.schema["conv_id"].dataType.simpleString(), data.schema["turn"].dataType.simpleString()

    def summarise(batches):
        for conv_id, rows, first, last in _segments(batches):
            if first or last:
                roles = [role_of(b.column(2)[i].as_py()) for b, i in rows]
                block = rows[0][0].column(4)[0].as_py()
                total = [str(x) for x in automaton.product(roles).ravel()]  # more than 64 bits each
                columns = [pa.array([block], pa.int32()), rows[0][0].column(0).slice(rows[0][1], 1), pa.array([first]), pa.array([last]), pa.array([total], pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array([len(roles)], pa.int64())], ["block", "conv_id", "first", "last", "total", "turns"])

    found = data.mapInArrow(summarise, f"block int, conv_id {conv}, first boolean, last boolean, total array<string>, turns bigint").collect()
    known = spark.sparkContext.broadcast(automaton.edges([tuple(r) for r in found]))

    def finish(batches):
        for _, rows, first, last in _segments(batches):
            block = rows[0][0].column(4)[0].as_py()
            entry, leave, position = known.value[block, first] if first or last else (START, None, 0)
            old = [b.column(2)[i].as_py() for b, i in rows]
            roles = [role_of(r) for r in old]
            made = rendered([b.column(3)[i].as_py() for b, i in rows], roles, automaton.path(roles, entry, leave), leave is None, automaton)
            columns = [
                pa.concat_arrays([b.column(0).slice(i, 1) for b, i in rows]), pa.concat_arrays([b.column(1).slice(i, 1) for b, i in rows]),
                pa.array(range(position, position + len(rows)), pa.int64()), pa.array(old, pa.string()),
                pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.string()), pa.array([m[2] for m in made], pa.list_(pa.string())),
                pa.array([m[3] for m in made], pa.int32()), pa.array([m[4] for m in made], pa.string()),
            ]
            yield pa.RecordBatch.from_arrays(columns, ["conv_id", "turn", "position", "old_role", "action", "role", "before", "after", "piece"])

    return data.mapInArrow(finish, f"conv_id {conv}, turn {turn}, position bigint, old_role string, action string, role string, before array<string>, after int, piece string")
