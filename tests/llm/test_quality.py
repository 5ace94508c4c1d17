import random
import zlib

import numpy as np

from wayline.llm import quality


def documents():
    rng = random.Random(3)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(300)]
    rows = []
    for i in range(600):
        n = rng.randint(8, 120)
        good = [rng.choice(words) for _ in range(n)]
        kind = i % 6
        text = " ".join(good)
        if kind == 0:
            text = " ".join(w + rng.choice(["%%%", "$$$"]) for w in good)
        elif kind == 1:
            text = " ".join(w for w in good[:9] for _ in range(8))
        rows.append((i, text, int(kind > 1)))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy_and_odd_rows(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, t, "x") for i, t, _ in rows] + [(None, "no id at all", "x"), (9000, None, "x"), (9001, "", "x"), (9002, "word " * 200_000, "x"), (5, rows[5][1], "x")], "doc_id bigint, text string, quality string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(0, 0), (None, 1), (77777, 1), (9000, None)], "doc_id bigint, quality int")
    model = quality.fit(docs, labels)
    got = quality.score(docs, model).collect()
    assert len(got) == len(rows) + 5 and all(0 <= r.score <= 1 for r in got)
    truth = {i: y for i, _, y in rows}
    out = [r for r in got if r.doc_id in truth and held(r.doc_id)]
    assert sum((r.score >= 0.7) == truth[r.doc_id] for r in out) / len(out) > 0.95
    assert len({r.score for r in got if r.doc_id in (9000, 9001)}) == 1
    kept = quality.good(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == sum(r.score >= 0.7 for r in got)


def test_held_out_labels_change_nothing(spark):
    rows = documents()
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string")
    one = quality.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int"))
    two = quality.fit(docs, spark.createDataFrame([(i, 1 - y if held(i) else y) for i, _, y in rows], "doc_id bigint, quality int"))
    assert np.array_equal(one[0], two[0]) and one[1] == two[1]


def test_features_of_a_block_are_those_of_each_text(monkeypatch):
    monkeypatch.setattr(quality, "BLOCK", 400)
    rng = random.Random(1)
    line = ["".join(rng.choice("ab é\n🙂") for _ in range(rng.randint(0, 900))) for _ in range(30)]
    number = np.random.default_rng(0).normal(size=1 << quality.BITS).astype(np.float32)
    together = quality.probabilities(line, number, 0.1)
    alone = np.array([quality.probabilities([t], number, 0.1)[0] for t in line])
    # Texts of over a block are cut at the same places either way.
    assert np.allclose(together, alone)


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id bigint, text string")
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    assert quality.score(docs, quality.fit(docs, labels)).first().score == 0.5
    assert quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0


def plain_buckets(text):
    """The features' buckets of a text, straight from their definition in whole numbers."""
    mask, base = (1 << 64) - 1, int(quality.BASE)
    back = pow(base, -1, 1 << 64)
    number = lambda piece: sum(ord(c) * pow(base, k, 1 << 64) for k, c in enumerate(piece)) & mask

    def spread(h):
        h &= mask
        return ((h ^ (h >> 31)) * int(quality.MIX) & mask) >> (64 - quality.BITS)

    assert back * base & mask == 1
    line = "".join(" " if ord(c) <= 32 or c in "\x85\xa0" else c for c in text or "")
    words = line.split(" ")
    words = [w for w in words if w]
    out = [spread(number(w) + 1) for w in words]
    out += [spread((number(b) - number(a)) * int(quality.PAIR) + 2) for a, b in zip(words, words[1:])]
    line = f" {line} "
    for n in quality.GRAMS:
        out += [spread(number(line[k : k + n]) + n) for k in range(len(line) - n + 1) if " " not in line[k + 1 : k + n - 1]]
    return out


def test_scores_equal_a_plain_version():
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc  d\né🙂 ") for _ in range(rng.randint(0, 60))) for _ in range(80)] + ["", None, " ", "a", "word word word", "\xa0x\x85y"]
    number = np.random.default_rng(5).normal(0, 1, 1 << quality.BITS).astype(np.float32)
    got = quality.probabilities(texts, number, 0.3)
    for t, p in zip(texts, got):
        own = plain_buckets(t)
        mean = sum(float(number[b]) for b in own) / max(len(own), 1)
        assert abs(p - 1 / (1 + np.exp(-(mean + 0.3)))) < 1e-6
        at, often = quality.counts(t)
        assert sorted(own) == np.repeat(at, often).tolist()


def plain_train(rows, seed=7):
    """Quality.train with loops over documents and buckets."""
    width, rate = quality.WIDTH, quality.RATE
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / width, 1 / width, (1 << quality.BITS, width))
    output, bias = np.zeros((width, 2)), np.zeros(2)
    grown_v, grown_o, grown_b = {}, np.full(output.shape, 1e-6), np.full(2, 1e-6)
    for _ in range(quality.ROUNDS):
        order = rng.permutation(len(rows))
        for k in range(0, len(rows), quality.PORTION):
            own = [rows[i] for i in order[k : k + quality.PORTION]]
            step_o, step_b, steps = np.zeros_like(output), np.zeros(2), {}
            for ids, often, y in own:
                share = often / often.sum()
                mean = sum(vectors[i] * w for i, w in zip(ids, share))
                z = np.exp(mean @ output + bias)
                p = z / z.sum()
                p[y] -= 1
                step_o += np.outer(mean, p) / len(own)
                step_b += p / len(own)
                for i, w in zip(ids, share):
                    steps[i] = steps.get(i, 0) + w * (output @ p) / len(own)
            grown_o += step_o**2
            grown_b += step_b**2
            output = output - rate * step_o / np.sqrt(grown_o)
            bias = bias - rate * step_b / np.sqrt(grown_b)
            for i, s in steps.items():
                grown_v[i] = grown_v.get(i, 1e-6) + (s**2).mean()
                vectors[i] -= rate * s / np.sqrt(grown_v[i])
    return vectors @ (output[:, 1] - output[:, 0]), bias[1] - bias[0]


def test_training_equals_a_plain_version():
    rows = [(*quality.counts(t), y) for _, t, y in documents()[:48]]
    number, bias = quality.train(rows)
    want, want_bias = plain_train(rows)
    used = np.unique(np.concatenate([r[0] for r in rows]))
    assert abs(bias - want_bias) < 0.02
    assert np.corrcoef(number[used], want[used])[0, 1] > 0.999
    assert np.abs(number[used] - want[used]).max() < 0.05 * np.abs(want[used]).max()


def test_a_column_named_score_gives_way(spark):
    model = (np.zeros(1 << quality.BITS, np.float32), 0.0)
    got = quality.score(spark.createDataFrame([(1, "a", 9.0, "k")], "doc_id bigint, text string, score double, p string"), model)
    assert got.columns == ["doc_id", "text", "p", "score"] and got.first().score == 0.5


def test_the_sample_is_bounded_by_bytes(spark, monkeypatch):
    rows = documents()[:200]
    docs, labels = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id bigint, text string"), spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id bigint, quality int")
    seen = []
    monkeypatch.setattr(quality, "train", lambda r: seen.append(r) or (None, 0.0))
    quality.fit(docs, labels)
    monkeypatch.setattr(quality, "SAMPLE_BYTES", 100_000)
    quality.fit(docs, labels)
    size = lambda rows: sum(6 * r[0].size for r in rows)
    assert len(seen[0]) == sum(not held(i) for i, _, _ in rows) and 80_000 < size(seen[1]) <= 100_000
