import math
import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from wayline.llm import language_model as lm


def documents():
    rng = random.Random(8)
    tongues = [["".join(rng.choice(letters) for _ in range(rng.randint(1, 6))) for _ in range(150)] for letters in ("abcde", "uvwxyß")]
    rows = [(i, " ".join(rng.choice(tongues[i % 2]) for _ in range(rng.randint(0, 120)))) for i in range(300)]
    return [*rows, (900, None), (901, ""), (902, " \n\t"), (903, "Xyz " * 5000), (903, "again"), (None, "a b \x1c\xa0c")]


def test_counts_base_and_gain(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 120)
    rows = documents()
    frame = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id bigint, text string, score double").repartition(6)
    got = lm.scores(frame).collect()
    assert len(got) == len(rows)
    out = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 7 == 2
    split = lambda t: [*(t or "").encode().lower().split(), None]
    count = Counter(w for i, t in rows if not out(i) for w in split(t))
    n, v = sum(count.values()), len(count)
    want = sorted((str(i), out(i), len(split(t)), sum(count[w] > 0 for w in split(t)), n, round(sum(math.log10((count[w] + 1) / (n + v + 1)) for w in split(t)), 6)) for i, t in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    held = [r for r in got if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held)


def cycle(n, dims):
    """A model of n units, and tokens each of which is told by the token `dims` places before it."""
    rng = np.random.default_rng(0)
    line = rng.integers(0, n, 40_000).astype(np.int32)
    for i in range(dims, line.size):
        line[i] = (line[i - dims] + 1) % n if i % 7 else line[i]
    return lm.Model(np.bincount(line, minlength=n).astype(float)), line


def windows(line):
    at = np.arange(lm.CONTEXT, line.size)
    return np.stack([line[at - i - 1] for i in range(lm.CONTEXT)]), line[at]


def test_probabilities_add_up_to_one(monkeypatch):
    monkeypatch.setattr(lm, "GROUP", 16)
    monkeypatch.setattr(lm, "ROWS", 50)
    rng = np.random.default_rng(0)
    model = lm.Model(rng.integers(0, 500, 101).astype(float))
    for name in "rcqg":
        setattr(model, name, rng.normal(0, 0.7, getattr(model, name).shape).astype(np.float32))
    before = rng.integers(0, 101, (lm.CONTEXT, 9)).astype(np.int32)
    total = sum(10 ** model.log_probabilities(before, np.full(9, u)) for u in range(101))
    assert np.allclose(total, 1, atol=1e-4)
    # Many contexts at once go the other way, with the positions' products made beforehand.
    many = np.tile(before, 30)
    assert np.allclose(model.log_probabilities(many, np.full(270, 5)), np.tile(model.log_probabilities(before, np.full(9, 5)), 30), atol=1e-4)


@pytest.mark.parametrize("far", [1, 2, 3])
def test_training_finds_what_stands_some_words_before(monkeypatch, far):
    monkeypatch.setattr(lm, "GROUP", 8)
    model, line = cycle(30, far)
    before, target = windows(line)
    held = slice(30_000, None)
    old = model.log_probabilities(before[:, held], model.rank[target[held]]).mean()
    rng, state = np.random.default_rng(1), {}
    for _ in range(3):
        for a in range(0, 30_000, 500):
            model.learn(before[:, a : a + 500], model.rank[target[a : a + 500]], rng, state)
    new = model.log_probabilities(before[:, held], model.rank[target[held]]).mean()
    # Six of seven tokens are told: at best a third of the start's entropy remains.
    assert new > 0.6 * old


def test_averages_put_back_what_was_learned():
    model, line = cycle(30, 1)
    before, target = windows(line)
    other, state = model.copy(), {}
    other.learn(before[:, :500], model.rank[target[:500]], np.random.default_rng(1), state)
    at, weight, values = other.rows(state)
    # Of a group's table each of 500 tokens uses its own row and each drawn one.
    assert (weight > 0).all() and weight.sum() == 500 * (2 * (1 + lm.NOISE) + lm.CONTEXT * (1 + lm.WIDTH))
    assert not np.allclose(model.q, other.q)
    model.put(at, values)
    for name in "rcqg":
        assert (getattr(model, name) == getattr(other, name)).all()


def test_scores_equal_a_plain_version(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 150)
    monkeypatch.setattr(lm, "OWN", 2)
    seen, train = [], lm.train
    monkeypatch.setattr(lm, "train", lambda learned, head, start: (seen.append((head.value, train(learned, head, start))), seen[-1][1])[1])
    long_one = "http://" + "y" * 90
    rows = [(i, f"{t or ''} {long_one} {long_one if i % 3 else ''}") for i, t in documents()[:120]] + documents()[-7:]
    got = lm.scores(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    head, model = seen[0]
    count = Counter(w for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2 and i is not None or i is None and zlib.crc32(b"") % 7 != 2 for w in lm.words(t))
    own = sorted(count, key=lambda w: (-count[w], w))[: head.own]
    place = {w: k for k, w in enumerate(own)}
    inside = Counter()
    for w, n in count.items():
        if w not in place:
            inside[lm.ending(w)] += n + 1
    unit = lambda w: head.end if w is None else place.get(w, head.own + lm.ending(w))
    softmax = lambda s, k: s[k] - math.log(sum(math.exp(x) for x in s))

    def plain(text):
        line, total = [*lm.words(text), None], 0.0
        for k, w in enumerate(line):
            h = np.zeros(lm.WIDTH)
            for i in range(lm.CONTEXT):
                h += model.r[unit(line[k - i - 1]) if k > i else head.end].astype(float) @ model.c[i].astype(float)
            h, rank = np.r_[h, 1.0], int(model.rank[unit(w)])
            group = rank // model.group
            inner = model.q[group * model.group : (group + 1) * model.group].astype(float) @ h
            total += (softmax(list(model.g.astype(float) @ h), group) + softmax(list(inner), rank % model.group)) / math.log(10)
            if w is not None and w not in place:
                total += math.log10(count[w] + 1) - math.log10(inside[lm.ending(w)] + 1)
        return total

    assert long_one.encode() not in place and any(len(w) == 35 for w in place)
    want = sorted((str(i), round(len(t or ""), 0), plain(t)) for i, t in rows if len(t or "") < 4000)
    have = sorted((str(i), len(t or ""), r.score) for i, t in rows for r in got if r.doc_id == i and r.n_tokens == len(lm.words(t)) + 1 and len(t or "") < 4000)
    assert len(have) >= len(want)
    for w in want:
        assert min(abs(w[2] - x[2]) for x in have if x[:2] == w[:2]) < 1e-3 * max(1, abs(w[2]))


def test_without_training_texts(spark):
    got = lm.scores(spark.createDataFrame([(4, "a b")], "doc_id bigint, text string").where("doc_id = 5"))
    assert got.count() == 0


def test_all_rows_held_out(spark):
    rows = [(4, "a b"), (5, None), (6, "a a a")]
    got = {r.doc_id: r for r in lm.scores(spark.createDataFrame(rows, "doc_id bigint, text string"), F.lit(True)).collect()}
    assert {i: (r.n_tokens, r.n_known, r.train_tokens, r.base_score) for i, r in got.items()} == {4: (3, 0, 0, 0.0), 5: (1, 0, 0, 0.0), 6: (4, 0, 0, 0.0)}
    assert all(r.score < 0 for r in got.values())


@pytest.mark.parametrize("size", [1, 40, 700])
def test_a_step_equals_sums_over_single_tokens(monkeypatch, size):
    """Also where a batch has fewer tokens than groups, whose contexts then fill no whole piece."""
    monkeypatch.setattr(lm, "PIECE", 16)
    rng = np.random.default_rng(2)
    model = lm.Model(rng.integers(0, 500, 101).astype(float), group=10)
    for name in "rcqg":
        setattr(model, name, rng.normal(0, 0.5, getattr(model, name).shape).astype(np.float32))
    before, target = rng.integers(0, 101, (lm.CONTEXT, size)), rng.integers(0, 101, size)
    old, state, steps, step = model.copy(), {}, {}, lm.Model.step

    def told(self, name, at, slopes, times, state):
        steps[name] = np.zeros((getattr(old, name).shape[0], slopes.shape[1])), np.zeros(getattr(old, name).shape[0], dtype=int)
        assert np.unique(at).size == at.size
        steps[name][0][at], steps[name][1][at] = slopes, times
        step(self, name, at, slopes, times, state)

    monkeypatch.setattr(lm.Model, "step", told)
    model.learn(before, target, np.random.default_rng(4), state)
    draws = np.random.default_rng(4)
    back = np.zeros((size, lm.WIDTH))
    h = np.c_[sum(old.r[before[i]].astype(float) @ old.c[i] for i in range(lm.CONTEXT)), np.ones(size)]
    for name, true, cuts, share in (("g", target // old.group, np.array([0, old.groups]), old.of_group), ("q", target, old.cuts, old.share)):
        weights, upto, noise = getattr(old, name).astype(float), np.r_[0.0, np.cumsum(share)], old.log_noise[name]
        x = draws.random((cuts.size - 1, lm.NOISE))
        drawn = [[min(max(int(np.searchsorted(upto, upto[a] + y * (upto[b] - upto[a]), "right")) - 1, a), b - 1) for y in row] for a, b, row in zip(cuts[:-1], cuts[1:], x)]
        slopes, times = np.zeros_like(weights), np.zeros(weights.shape[0], dtype=int)
        for j in range(size):
            own = int(np.searchsorted(cuts, true[j], "right")) - 1
            for row, hit in [(int(true[j]), 1.0), *[(row, 0.0) for row in drawn[own]]]:
                up = hit - 1 / (1 + math.exp(noise[row] - float(h[j] @ weights[row])))
                slopes[row] += up * h[j]
                times[row] += 1
                back[j] += up * weights[row, : lm.WIDTH]
        assert np.allclose(steps[name][0], slopes, atol=1e-3) and (steps[name][1] == times).all()
    slopes, times = np.zeros_like(old.r, dtype=float), np.zeros(101, dtype=int)
    for i in range(lm.CONTEXT):
        np.add.at(slopes, before[i], back @ old.c[i].T)
        np.add.at(times, before[i], 1)
        slope = old.r[before[i]].T.astype(float) @ back / size
        seen = 1e-4 + (slope**2).mean(axis=1)
        assert np.allclose(model.c[i], old.c[i] + lm.RATE * 0.1 * slope / np.sqrt(seen)[:, None], atol=1e-4)
    assert np.allclose(steps["r"][0], slopes, atol=1e-3) and (steps["r"][1] == times).all()


def test_sums_of_runs():
    rng = np.random.default_rng(5)
    for width in (2, 5):
        values = rng.normal(size=(50, width)).astype(np.float32)
        for first in ([0], [0, 1, 7, 8, 49], list(range(50))):
            assert np.allclose(lm._run_sums(values, np.array(first)), np.add.reduceat(values, first, axis=0), atol=1e-5)


ODD = [None, "", " ", "\n\ta  b\x0b\x0cC\r", "x\x1cy\xa0z É ÄB", "y" * 64, "Y" * 65 + " " + "Z" * 200 + "€", "\x00 a\x00", "ß İ ı", None]


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_texts_together_are_cut_as_each_alone(monkeypatch, kind):
    monkeypatch.setattr(lm, "BLOCK", 70)
    for texts in (ODD, ODD[3:7], [None], [" "], []):
        got = []
        for first, block in lm.blocks(pa.array(["before", *texts], kind).slice(1)):
            assert first == len(got)
            found, many = lm.tokens(block)
            assert lm.endings(found).tolist() == [lm.ending(w) for w in found.to_pylist()]
            for n, stop in zip(many, np.cumsum(many)):
                got.append(found.to_pylist()[stop - n : stop])
        assert got == [lm.words(t) for t in texts]


def test_reading_makes_no_object_of_each_word(monkeypatch):
    """What a task reads thrice: units and places of all tokens, without Python for each of them."""
    head = lm.Head([(b"a", 9), (b"b", 8), (b"x\x1cy\xc2\xa0z", 7), (b"rare", 1)], 10)
    texts, at = ODD * 50, {b"a": 0, b"b": 1, b"x\x1cy\xc2\xa0z": 2, b"rare": 3}
    of = lambda w: (-2, head.end) if w is None else (at.get(w, -1), at[w] if at.get(w, 3) < 3 else head.own + lm.ending(w))
    want = [of(w) for t in texts for w in [*lm.words(t), None]]
    unknown = [w for t in texts for w in lm.words(t) if w not in at]
    plain, calls = lm.ending, []
    monkeypatch.setattr(lm, "words", lambda text: pytest.fail("a text was cut in Python"))
    monkeypatch.setattr(lm, "ending", lambda w: calls.append(w) or plain(w))
    kind, place, bounds, rest = head.read(pa.array(texts))
    assert list(zip(place.tolist(), kind.tolist())) == want and bounds[-1] == len(want) and rest.to_pylist() == unknown
    assert len(calls) == len({w[-2:] for w in unknown})


def test_counts_passed_on_in_parts(spark, monkeypatch):
    monkeypatch.setattr(lm, "HELD", 3)
    texts = [t for _, t in documents()[:120]] + ODD
    got = lm.word_counts(spark.createDataFrame([(t,) for t in texts * 12], "text string").coalesce(1)).collect()
    assert {bytes(r.word): r.n for r in got} == {w: 12 * n for w, n in Counter(w for t in texts for w in lm.words(t)).items()} and len(got) == len({r.word for r in got})
