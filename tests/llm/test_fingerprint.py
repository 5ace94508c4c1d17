import hashlib
import math
import random
from collections import Counter

import xxhash

from wayline.llm import fingerprint as f


def jaccard(a, b):
    x, y = (Counter((t or "").encode().lower().split()) for t in (a, b))
    most = sum((x | y).values())
    return sum((x & y).values()) / most if most else 1.0


def documents():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdeéß") for _ in range(rng.randint(1, 5))) for _ in range(400)]
    rows = [(i * 3, " ".join(rng.choice(words) for _ in range(rng.choice([0, 1, 3, 40, 300])))) for i in range(40)]
    rows += [(200 + i, f"{rows[5][1]} {rows[7][1]} w{i}") for i in range(6)]
    return [*rows, (300, None), (301, ""), (302, " \n"), (303, "A"), (304, "a"), (305, "🙂🙂 ñ" * 9), (306, "long " * 30_000), (None, "no id")]


def test_edited_texts_and_likeness(spark):
    rows = documents()
    frame = spark.createDataFrame([(i, t, "x") for i, t in [*rows, rows[3]]], "doc_id bigint, text string, th string").repartition(5)
    got = {r.doc_id: r for r in f.edited_fingerprints(frame).collect()}
    assert len(got) == len(rows) and set(got) == {i for i, _ in rows}
    line = sorted(rows, key=lambda r: -(r[0] if r[0] is not None else -1))
    errors = []
    for k, (i, t) in enumerate(line):
        t, following = t or "", line[(k + 1) % len(line)][1] or ""
        half = len(t) // 2
        edited = t[: len(t) - half] + following[:half]
        r = got[i]
        assert r.n_chars == len(t)
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for near, other in ((r.near_edited, edited), (r.near_next, following)):
            errors.append(near - jaccard(t, other))
    size = 0.5 / f.SAMPLES**0.5
    assert max(map(abs, errors)) < 5 * size
    assert abs(sum(errors) / len(errors)) < 3 * size / len(errors) ** 0.5
    assert got[303].fingerprint == got[304].fingerprint != got[301].fingerprint == got[300].fingerprint == got[302].fingerprint


def test_one_document_follows_itself(spark):
    frame = spark.createDataFrame([(1, "abcd ef")], "doc_id bigint, text string")
    (r,) = f.edited_fingerprints(frame).collect()
    assert r.edited_sha256 == hashlib.sha256(b"abcdabc").hexdigest() and r.near_next == 1


def test_empty_table(spark):
    assert f.edited_fingerprints(spark.createDataFrame([], "doc_id bigint, text string")).count() == 0


def plain_samples(text):
    """A text's samples straight from the definition, as the printed text."""
    counts = Counter((text or "").encode().lower().split())
    out = []
    for k in range(f.SAMPLES):
        best = f.EMPTY
        for word, n in counts.items():
            h = xxhash.xxh64_intdigest(word, 42).to_bytes(8, "little")
            a, b = (xxhash.xxh64_intdigest(i.to_bytes(4, "little"), xxhash.xxh64_intdigest(h, 42)) for i in (2 * k, 2 * k + 1))
            u = lambda x, at, bits: ((x >> at & (1 << bits) - 1) + 0.5) / 2**bits
            r, shift = -math.log(u(a, 0, 21) * u(a, 21, 21)), u(a, 42, 21)
            t = math.floor(math.log(n) / r + shift)
            value = math.log(-math.log(u(b, 0, 32) * u(b, 32, 32))) - r * (t - shift + 1)
            low = (b ^ t * 40_503) & (1 << 23) - 1
            best = min(best, int((value + 1024) * 2**28) << 23 | low)
        out.append(f"{best:016x}")
    return "".join(out)


def test_fingerprints_equal_a_plain_version(spark):
    texts = [t for _, t in documents() if len(t or "") < 3000]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r.fingerprint for r in f.edited_fingerprints(frame).collect()}
    # The last bit of a logarithm may differ between libraries, so a sample in a thousand may as well.
    cut = lambda s: [s[k : k + 16] for k in range(0, len(s), 16)]
    pairs = [(a, b) for i, t in enumerate(texts) for a, b in zip(cut(got[i]), cut(plain_samples(t)), strict=True)]
    assert sum(a != b for a, b in pairs) <= len(pairs) / 1000


def test_copies_give_a_row_each(spark):
    rows = [(5, "a b c"), (5, "a b c"), (5, "a b c"), (None, "x y"), (None, "x y"), (4, "a b c"), (3, None), (3, "")]
    got = f.edited_fingerprints(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert sorted(str((r.doc_id, r.n_chars)) for r in got) == sorted(str((i, len(t or ""))) for i, t in rows)
    assert len({r.fingerprint for r in got if r.n_chars == 5}) == 1 and {r.near_next for r in got if r.doc_id == 5} == {1.0}
