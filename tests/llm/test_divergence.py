import random
import re
from collections import Counter

import numpy as np
import pytest

from wayline.llm import divergence


def terms(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", text)


def plain(docs, least, top):
    """docs: (lang, source, text); every pair at every term, in exact integers."""
    docs = [(a or "", b or "", t or "") for a, b, t in docs]
    found = set()
    for lang in {d[0] for d in docs}:
        own = [(s, Counter(terms(t))) for a, s, t in docs if a == lang]
        kept = [w for w, n in Counter(w for _, c in own for w in c).items() if n >= least]
        count = {s: Counter() for s, _ in own}
        for s, c in own:
            count[s].update({w: c[w] for w in kept if c[w]})
        whole = sum(count.values(), Counter())

        def p(c, w, kept=kept):
            return 1 + 10**9 * (c[w] + 5) // (sum(c[x] for x in kept) + 5 * len(kept))

        by = {s: {w: p(c, w) for w in kept} for s, c in count.items()}
        q = {w: p(whole, w) for w in kept}
        for s in count:
            pairs = [(sum(abs(by[s][w] - by[o][w]) for w in kept), o) for o in count if o != s]
            best = [(by[s][w] - q[w], w) for w in kept if count[s][w] and by[s][w] > q[w]]
            for part, items, most in (("pair", pairs, None), ("term", best, top)):
                for k, (v, i) in enumerate(sorted(items, key=lambda x: (-x[0], x[1].encode()))[:most]):
                    found.add((lang, s, part, i, v, k + 1))
    return found


def got(spark, docs, least, top):
    d = spark.createDataFrame([(*r, 1, "x") for r in docs], "lang string, source string, text string, n int, term string")
    rows = divergence.audit(d, least, top).collect()
    found = {(r.lang, r.source, r.part, r["item"], r.value, r["rank"]) for r in rows}
    assert len(found) == len(rows)
    return found


def documents():
    rng = random.Random(2)
    words = [rng.choice(["Haus", "été", "ABC", "the", "of", "Ñandú", "x", "中文", "zé"]) + rng.choice("abcdeÉ") for _ in range(40)]
    docs = []
    for _ in range(150):
        text = "".join(rng.choice(words) + rng.choice([" ", ", ", "\n", "1", "_", "\x7f"]) for _ in range(rng.randint(0, 30)))
        docs.append((rng.choice(["en", "de", None]), f"s{rng.randint(0, 6)}", text))
    return docs + [("en", None, "haus Haus"), ("en", "", ""), ("fr", "s1", "alone"), ("fr", "s2", None), ("it", "s1", "solo"), ("en", "s0", "the " * 3_000_00 + "of"), docs[0], docs[0]]


@pytest.mark.parametrize("least,top", [(3, 50), (12, 2), (10_000, 50)])
def test_equals_plain_counts(spark, least, top):
    docs = documents()
    assert got(spark, docs, least, top) == plain(docs, least, top)


def test_small_pieces_and_counts_sent_early(spark, monkeypatch):
    words = divergence.pieces
    monkeypatch.setattr(divergence, "PIECE", 16)
    assert [w for p in words(b"Aa bB1cc  d" * 40) for w in p] == b"".join([b"aa bb cc  d"] * 40).split()
    assert list(words(b"")) == []


def test_empty_table(spark):
    assert got(spark, [], 30, 50) == set()


def test_shares_are_exact_beyond_64_bits():
    rng = random.Random(1)
    for _ in range(200):
        over = rng.randint(1, 2**53 - 1)
        n = rng.randint(0, over)
        assert divergence.shares(np.array([n]), np.array([over]))[0] == 1 + 10**9 * n // over


def test_pair_sums_of_blocks(monkeypatch):
    rng = np.random.default_rng(3)
    v, m = rng.integers(0, 10**9, (57, 9)), rng.integers(0, 6, 57)
    want = [int((np.abs(v[:, i] - v[:, j]) * m).sum()) for i in range(9) for j in range(i + 1, 9)]
    assert divergence.pair_sums(v, m).tolist() == want
    monkeypatch.setattr(divergence, "CELLS", 20)
    assert divergence.pair_sums(v, m).tolist() == want
    assert divergence.pair_sums(v[:, :1], m).tolist() == []


def test_terms_of_one_vector_are_one(spark):
    docs = [("en", f"s{i % 3}", "aa bb cc" + " dd" * (i % 2)) for i in range(12)]
    kept = divergence.kept_terms(spark.createDataFrame(docs, "lang string, source string, text string"), 3)
    assert sorted(r.often for r in divergence.distinct_vectors(kept).collect()) == [1, 3]
