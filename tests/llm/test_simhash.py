import hashlib
import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from wayline.llm import simhash


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(rows, radius=3):
    """rows: (doc_id, text). doc_id -> smallest doc_id reachable, of all pairs."""
    fp = [(i, plain_fingerprint(t)) for i, t in rows]
    up = list(range(len(fp)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in range(len(fp)):
        for b in range(a):
            if (fp[a][1] ^ fp[b][1]).bit_count() <= radius:
                up[root(a)] = root(b)
    out = []
    for x in range(len(fp)):
        own = [fp[y][0] for y in range(len(fp)) if root(y) == root(x) and fp[y][0] is not None]
        out.append((fp[x][0], fp[x][1], min(own) if own else None))
    return out


def texts(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 400))) for _ in range(n)]
    out = []
    for t in base:
        out.append(t)
        for _ in range(rng.choice([0, 0, 1, 3])):
            w = t.split()
            if w:
                w[rng.randrange(len(w))] = rng.choice(words)
            out.append(" ".join(w))
    return [*out, "", None, " \n\t ", "one", "ONE", "two words", *[base[0]] * 5, "x " * 20_000, "nbsp\xa0here \x1c sep"]


def test_fingerprint_is_the_majority_of_shingle_hashes():
    for t in texts(1, 40):
        assert simhash.fingerprint(t) == plain_fingerprint(t)


def test_forest_keeps_components():
    rng = np.random.default_rng(0)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    n, m = simhash.forest(a, b)
    assert simhash.forest(n, m)[1].tolist() == m.tolist()
    def groups(x, y):
        up = {int(v): int(v) for v in np.r_[a, b]}
        def root(v):
            while up[v] != v:
                v = up[v]
            return v
        for p, q in zip(x.tolist(), y.tolist()):
            up[root(p)] = root(q)
        out = {}
        for v in up:
            out.setdefault(root(v), set()).add(v)
        return sorted(map(sorted, out.values()))
    assert groups(a, b) == groups(n, m)


def test_groups_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    rows = list(enumerate(texts(2, 60), start=10)) + [(None, "two words"), (None, "no other text is like this one"), (11, "two words")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fp string")
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None)
    want = sorted(r for r in plain_components(rows) if r[0] is not None)
    assert got == want
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted({r[2] for r in want})
    assert kept.count(None) == 2


def test_every_file_pair_is_compared(spark):
    rng = np.random.default_rng(3)
    base = rng.integers(-(2**62), 2**62, 400)
    near = [int(x) ^ (1 << int(rng.integers(0, 60))) for x in base]
    fps = sorted({*map(int, base), *near})
    classes = spark.createDataFrame([(f, i) for i, f in enumerate(fps)], "fp bigint, rep bigint")
    found = simhash.components(simhash.linked(classes, 3, 16)).collect()
    assert len({r.component for r in found}) == 400


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    assert simhash.near_duplicates(docs).count() == 0
    assert simhash.keep_one(docs).count() == 0


def test_spark_hash_is_the_same_hash(spark):
    got = spark.range(1).select(F.xxhash64(F.lit("a b c")).alias("h")).first().h % 2**64
    assert got == xxhash.xxh64_intdigest(b"a b c", 42)


def test_one_id_with_several_texts(spark):
    rng = random.Random(12)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    a, b, c, e = (" ".join(rng.choice(words) for _ in range(300)) for _ in range(4))
    # The id 5 has a copy of 3's text and one of its own; 7 has two unrelated texts; 8 a copy of one of them.
    rows = [(3, a), (5, a.upper()), (5, b), (6, b), (7, c), (7, e), (7, e.upper()), (8, e), (None, "no id")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, fp string")
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None)
    assert got == sorted(r for r in plain_components(rows) if r[0] is not None)
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text.lower()) for r in kept.collect()) == sorted([(0, "no id"), (3, a), (5, b), (7, min([c, e, e.upper()], key=digest).lower())])


def test_ids_of_the_whole_range(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    a, b, c = (" ".join(rng.choice(words) for _ in range(200)) for _ in range(3))
    rows = [(2**62, a), (2**62 + 5, b), (2**62 + 6, c), (2**63 - 1, c), (2**63 - 2, a.upper()), (-(2**63), b), (-7, "lone"), (7, "also alone here"), (None, c)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = sorted((r.doc_id, r.fp % 2**64, r.component_id) for r in simhash.near_duplicates(docs).collect() if r.doc_id is not None)
    assert got == sorted(r for r in plain_components(rows) if r[0] is not None)
    kept = [r.doc_id for r in simhash.keep_one(docs).collect()]
    assert sorted(k for k in kept if k is not None) == sorted([2**62, 2**62 + 6, -(2**63), -7, 7]) and kept.count(None) == 1


def test_a_star_and_a_chain(spark, monkeypatch):
    from wayline.llm import components as c

    monkeypatch.setattr(c, "HOT", 4)
    star = [(0, i) for i in range(1, 60)] + [(i, 1000 + i) for i in range(1, 30)]
    chain = [(100 + i, 101 + i) for i in range(50)] + [(-5, -9), (-9, -5), (3, 3)]
    found = {r.node: r.component for r in c.components(spark.createDataFrame(star + chain, "a bigint, b bigint")).collect()}
    want = {i: 0 for i in range(60)} | {1000 + i: 0 for i in range(1, 30)} | {100 + i: 100 for i in range(51)} | {-5: -9, -9: -9}
    assert found == want


def test_no_files_are_opened_in_vain(spark):
    far = simhash._apart(np.zeros((5, 1), int), np.zeros((5, 1), int), np.array([[0, 8], [0, 2], [0, 2], [0, 2], [0, 2]]), np.full((5, 2), 16), 3)
    assert far.tolist() == [False, True]


def test_tiles_in_runs_find_all_links(monkeypatch):
    monkeypatch.setattr(simhash, "TILE", 8)
    monkeypatch.setattr(simhash, "RUN", 3)
    rng = np.random.default_rng(9)
    base = rng.integers(0, 2**63, 120, dtype=np.uint64)
    fps = np.unique(np.r_[base, base ^ np.uint64(5), base ^ np.uint64(1 << 40), rng.integers(0, 2**63, 100, dtype=np.uint64)])

    class Held(simhash._File):
        def __init__(self, fp, rep):
            order = np.lexsort((fp, np.bitwise_count(fp)))
            self.fp, self.rep = fp[order], rep[order]
            counts = np.stack([np.bitwise_count(self.fp)] + [np.bitwise_count((self.fp >> np.uint64(s)) & np.uint64(0xFFFF)) for s in (48, 32, 16, 0)]).astype(np.int64)
            self.starts = np.arange(0, self.fp.size, simhash.TILE)
            self.low, self.high = np.minimum.reduceat(counts, self.starts, axis=1), np.maximum.reduceat(counts, self.starts, axis=1)

    half = fps.size // 2
    rep = np.arange(fps.size)
    one, two = Held(fps[:half], rep[:half]), Held(fps[half:], rep[half:])
    found = [(int(min(a, b)), int(max(a, b))) for left, right in ((one, one), (two, two), (one, two)) for x, y in simhash._links(left, right, 3) for a, b in zip(x, y)]
    want = {(i, j) for j in range(fps.size) for i in range(j) if (int(fps[i]) ^ int(fps[j])).bit_count() <= 3}
    assert sorted(found) == sorted(want) and len(want) > 100
