import itertools
import random

import pytest

from wayline.llm import chat


def cheapest(roles):
    """Least cost by trying every action on every turn, straight from the rules."""

    def go(k, last):
        if k == len(roles):
            return 0 if last in (None, "assistant") else min(chat.INSERT * n for n in (1, 2) if legal(last, n))
        best = 10**18
        for new in ("system", "user", "assistant"):
            change = 0 if roles[k] == new else chat.RELABEL
            if last == new:
                best = min(best, chat.MERGE + change + go(k + 1, last))
            for n in range(3):
                for put in itertools.product(("user", "assistant"), repeat=n):
                    line = [last, *put, new]
                    if all(fits(a, b) for a, b in zip(line, line[1:])):
                        best = min(best, chat.INSERT * n + change + go(k + 1, new))
        return best

    def legal(last, n):
        return any(all(fits(a, b) for a, b in zip([last, *put], [*put])) and put[-1] == "assistant" for put in itertools.product(("user", "assistant"), repeat=n))

    def fits(a, b):
        return b in {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}[a]

    return go(0, None)


def cost(rows):
    total = 0
    for r in rows:
        total += chat.INSERT * (len(r.before) + r.after)
        total += {"keep": 0, "relabel": chat.RELABEL, "merge": chat.MERGE, "relabel_merge": chat.MERGE + chat.RELABEL}[r.action]
    return total


def spoken(piece):
    """(role, text) of a rendering."""
    return [(p.partition("|>\n")[0], p.partition("|>\n")[2]) for p in piece.removesuffix(chat.CLOSED).replace(chat.CLOSED, "").split("<|")[1:]]


@pytest.mark.parametrize("parts", [1, 7])
def test_repairs_are_cheapest_and_legal(spark, parts):
    rng = random.Random(9)
    names = ["system", "user", "assistant", "tool", None]
    rows = [(c, t, rng.choice(names[: 3 if c % 3 else 5]), f"t{c}.{t}") for c in range(40) for t in range(rng.randint(1, 5))]
    rows += [(None, 0, "user", None), (None, None, "gpt", "")]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "conv_id bigint, turn bigint, role string, text string, block string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = chat.repair(frame).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 8)
    assert len(got) == len(rows)
    for c in {r[0] for r in rows}:
        own = sorted((r for r in got if r.conv_id == c), key=lambda r: -1 if r.turn is None else r.turn)
        roles = [chat.ROLES[k] if (k := chat.role_of(r.old_role)) < 3 else None for r in own]
        assert cost(own) == cheapest(roles)
        said = spoken("".join(r.piece for r in own))
        line = [r for r, _ in said]
        assert line[line[0] == "system" :] == ["user", "assistant"] * ((len(line)) // 2)
        texts = [f"t{c}.{r.turn}" if c is not None else "" for r in own]
        assert "".join(t for _, t in said).replace("\n", "") == "".join(texts)


def test_a_long_conversation_spans_partitions(spark):
    rng = random.Random(10)
    roles = [rng.choice(["user", "assistant", "system", "odd"]) for _ in range(3000)]
    rows = [(5, t, r, "x") for t, r in enumerate(roles)] + [(4, 0, "user", "a"), (6, 0, "assistant", "b")] + [(7, 1, "user", "same")] * 500
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = chat.repair(frame).collect()
    own = sorted((r for r in got if r.conv_id == 5), key=lambda r: r.turn)
    coded = [chat.role_of(r) for r in roles]
    want = chat.rendered(["x"] * 3000, coded, chat.path(coded, chat.START, None), True)
    assert cost(own) == sum(chat.INSERT * (len(w[2]) + w[3]) + {"keep": 0, "relabel": chat.RELABEL, "merge": chat.MERGE, "relabel_merge": chat.MERGE + chat.RELABEL}[w[0]] for w in want)
    assert "".join(r.piece for r in own).endswith(chat.CLOSED)
    same = [r for r in got if r.conv_id == 7]
    assert cost(same) == chat.MERGE * 499 + chat.INSERT


def test_empty_table(spark):
    assert chat.repair(spark.createDataFrame([], "conv_id bigint, turn bigint, role string, text string")).count() == 0


def actions(roles, **costs):
    automaton = chat.Automaton(**costs)
    coded = [chat.role_of(r) for r in roles]
    made = chat.rendered(["x"] * len(coded), coded, automaton.path(coded, chat.START, None), True, automaton)
    return [m[0] for m in made], sum(len(m[2]) + m[3] for m in made)


def test_each_repair_wins_where_it_is_the_cheapest():
    twice = ["user", "user", "assistant", "assistant"]
    assert actions(twice, insert=9, merge=1, relabel=9) == (["keep", "merge", "keep", "merge"], 0)
    assert actions(twice, insert=1, merge=9, relabel=9) == (["keep"] * 4, 2)
    assert actions(twice, insert=9, merge=9, relabel=1) == (["keep", "relabel", "relabel", "keep"], 0)


def least(roles, insert, merge, relabel):
    """(cost, empty turns, merges, relabels) of the best repair by trying all."""
    after = {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}

    def go(k, last):
        if k == len(roles) and last in (None, "assistant"):
            return (0, 0, 0, 0)
        add = lambda x, y: tuple(map(sum, zip(x, y)))
        ways = []
        if k < len(roles):
            for new in chat.ROLES:
                other = (0, 0, 0, 0) if roles[k] == new else (relabel, 0, 0, 1)
                if last == new:
                    ways.append(add(add((merge, 0, 1, 0), other), go(k + 1, new)))
                for n in range(3):
                    for put in itertools.product(("user", "assistant"), repeat=n):
                        line = [last, *put, new]
                        if all(b in after[a] for a, b in zip(line, line[1:])):
                            ways.append(add(add((insert * n, n, 0, 0), other), go(k + 1, new)))
        else:
            ways = [(insert * n, n, 0, 0) for n in (1, 2) if n == (1 if last == "user" else 2)]
        return min(ways)

    return go(0, None)


@pytest.mark.parametrize("costs", [(1, 1, 1), (2, 1, 4), (3, 2, 1), (0, 0, 0)])
def test_ties_go_to_fewer_empty_turns_then_merges_then_relabels(costs):
    rng = random.Random(11)
    automaton = chat.Automaton(*costs)
    mask = (1 << chat.PART) - 1
    for _ in range(60):
        roles = [rng.choice([*chat.ROLES, None]) for _ in range(rng.randint(1, 5))]
        coded = [chat.role_of(r) for r in roles]
        total = min(automaton.product(coded)[chat.START] + automaton.end)
        assert (total >> 3 * chat.PART, total >> 2 * chat.PART & mask, total >> chat.PART & mask, total & mask) == least(roles, *costs)
    many = automaton.product([1] * 20_000)[chat.START]
    assert min(many) < chat.FAR


def test_positions_order_equal_turns(spark):
    rows = [(1, 1, "user", "a"), (1, 1, "user", "b"), (1, 1, "user", "b"), (1, 0, "system", "s"), (2, None, None, None), (2, 3, "assistant", "z" * 300_000)]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = sorted(chat.repair(frame).collect(), key=lambda r: (r.conv_id, r.position))
    assert [(r.conv_id, r.position) for r in got] == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]
    assert [r.action for r in got[:4]] == ["keep", "keep", "merge", "merge"]
    assert len("".join(r.piece for r in got[4:])) > 300_000


def test_positions_go_on_across_partitions(spark):
    rows = [(5, t, "user" if t % 2 == 0 else "assistant", "x") for t in range(2000)]
    got = chat.repair(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(4)).collect()
    assert all(r.turn == r.position for r in got) and len(got) == 2000
