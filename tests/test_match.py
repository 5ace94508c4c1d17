"""Best matches of names against every pair."""

import random

import pytest

from wayline.operators import match


@pytest.mark.parametrize("threshold,limit,block", [(90, 2, 1_000), (60, 3, 7), (75, 1, 5), (98, 2, 3)])
def test_best_matches_equal_every_pair(spark, threshold, limit, block):
    rng = random.Random(threshold)
    tokens = ["Hbf", "Bahnhof", "Nord", "nord", "St.", "a", "bb", "Köln", "Bonn", "Berlin", "Berlni", "Frankfurt", "Main", "am", "Ost-West", "x1"]
    name = lambda: " ".join(rng.choice(tokens) for _ in range(rng.randint(1, 5)))
    left = [(i, name()) for i in range(45)] + [(50, None), (51, ""), (52, "  .. "), (53, "Hbf Hbf Hbf Hbf Berlin"), (54, "Berlin"), (55, "Berlin")]
    right = [(name(),) for _ in range(60)] + [("Hbf Berlin",), (None,), ("",), ("Berlin " * 9,), ("Berlin Hbf am Main Frankfurt Nord Ost-West",)]
    got = match.fuzzy_matches(spark.createDataFrame(left, "id int, name string"), spark.createDataFrame(right, "other string"), "name", "other", threshold, limit, block).collect()
    names = {n for (n,) in right if n is not None}
    for r in got:
        best = sorted((-match.weighted_score(r.name, n), n) for n in names)[:limit] if r.name is not None else []
        assert r.matches == ", ".join(n for s, n in best if -s >= threshold), r.name
    assert len(got) == len(left)


def test_tokens_of_many_names_are_seldom_looked_up(spark):
    frame = lambda rows: match._entries(spark.createDataFrame([(r,) for r in rows], "text string"))
    pairs = match._by_tokens(frame([f"Ortsname{i} Hbf" for i in range(30)]), frame([f"Ortsname{i} Hbf Nord" for i in range(30)]), 90, 1_000)
    assert {(r.text, r.name) for r in pairs.collect()} == {(f"Ortsname{i} Hbf", f"Ortsname{i} Hbf Nord") for i in range(30)}
