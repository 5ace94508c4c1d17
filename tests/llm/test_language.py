import random
import zlib
from collections import Counter

import numpy as np
import pytest

from wayline.llm import language

ALPHABETS = {"aa": "abcdeé", "bb": "cdefgß", "cc": "аbгдеЖ"}


def documents(n=400, seed=4):
    rng = random.Random(seed)
    words = {k: ["".join(rng.choice(v) for _ in range(rng.randint(1, 6))) for _ in range(80)] for k, v in ALPHABETS.items()}
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(words))
        rows.append((i, rng.choice([" ", "\n", ", 12 "]).join(rng.choice(words[lang]).title() for _ in range(rng.randint(5, 60))), lang))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


def grams(text):
    """n-grams of padded words by a plain loop: as tuples of code points, 0 for a word's end."""
    found, words = Counter(), "".join(c if c.isalpha() else " " for c in text).split(" ")
    for w in filter(None, words):
        low = [ord(c.lower()) if len(c.lower()) == 1 else ord(c) for c in w]
        padded = [0, *low, 0]
        for c in low:
            found[(c,)] += 1
        for n in (2, 3):
            for k in range(len(padded) - n + 1):
                found[tuple(padded[k : k + n])] += 1
    return found


def bucket(gram):
    # The hash adds, for each n, the code that stands n - 1 before the end.
    total = sum(c * int(language.MIX[len(gram) - 1 - k]) for k, c in enumerate(gram))
    return (total * (int(language.MIX[0]) ^ 2 * len(gram)) % 2**64) >> (64 - language.BITS)


TEXTS = ["", "a", "Ab ab", "x1y", "  Élan ÀÉ", "ßß ſİ 中文字", "12 34 %", "a b c d e", "\ud800 a", "word " * 50]


def test_counts_equal_a_plain_loop():
    got = language.text_counts(TEXTS)
    for text, row in zip(TEXTS, got):
        want = Counter()
        for g, n in grams(text).items():
            want[bucket(g)] += n
        assert {int(i): int(row[i]) for i in np.flatnonzero(row)} == dict(want), text


@pytest.mark.parametrize("size", [1, 2, 3, 7])
def test_slices_count_as_the_whole(monkeypatch, size):
    whole = [language.text_counts([t]) for t in TEXTS]
    monkeypatch.setattr(language, "SLICE", size)
    for text, want in zip(TEXTS, whole):
        assert (language.text_counts([text]) == want).all(), text


def test_nearest_equals_plain_cosines(spark):
    rows = documents()
    model = language.fit(spark.createDataFrame(rows, "doc_id bigint, text string, lang string"), sample=60)
    # Frequencies of all documents that teach.
    often = Counter(b for i, t, _ in rows if not held(i) for b in {bucket(g) for g in grams(t)})
    n = sum(not held(i) for i, _, _ in rows)
    idf = [1 + np.log((1 + n) / (1 + often[b])) for b in range(language.BUCKETS)]
    assert np.allclose(model.idf, idf)
    assert model.languages == ["aa", "bb", "cc"] and 3 < len(model.owner) <= 12
    langs, cosine, _ = language.nearest([t for _, t, _ in rows[:40]], model)
    for (_, text, _), lang, c in zip(rows[:40], langs, cosine):
        count = Counter()
        for g, k in grams(text).items():
            count[bucket(g)] += k
        v = {b: (1 + np.log(k)) * idf[b] for b, k in count.items()}
        size = sum(x * x for x in v.values()) ** 0.5
        near = [sum(x * model.centres[b, j] for b, x in v.items()) / size for j in range(len(model.owner))]
        assert abs(max(near) - c) < 1e-5 and model.languages[model.owner[int(np.argmax(near))]] == lang


def test_clusters_are_found():
    rng = np.random.default_rng(1)
    base = np.eye(4, 30, dtype=np.float32)
    rows = np.repeat(base, 25, axis=0) + rng.uniform(0, 0.05, (100, 30)).astype(np.float32)
    rows /= np.linalg.norm(rows, axis=1)[:, None]
    centres, own = language.cluster(rows)
    assert [len(set(own[k : k + 25])) for k in range(0, 100, 25)] == [1] * 4 and len(set(own)) == 4
    assert len(language.cluster(np.repeat(base[:1], 9, axis=0))[0]) == 1


def test_held_out_accuracy_and_odd_rows(spark):
    rows = documents()
    odd = [(None, "Abc de", "aa"), (9000, None, "aa"), (9001, "", "bb"), (9002, "12 $$", "cc"), (9003, "cdef " * 300_000, None), (9004, "日本語", None), (5, rows[5][1], rows[5][2])]
    docs = spark.createDataFrame([(*r, "x", 1) for r in rows + odd], "doc_id bigint, text string, lang string, Score string, order int")
    found = language.predict(docs, language.fit(docs)).collect()
    assert found[0].asDict().keys() == {"doc_id", "text", "lang", "order", "lang_pred", "score", "rejected"} and len(found) == len(rows) + len(odd)
    by = {r.doc_id: r for r in found}
    out = [r for r in found if r.doc_id is not None and r.doc_id < 9000 and held(r.doc_id)]
    assert sum(r.lang == r.lang_pred for r in out) / len(out) > 0.97 and all(0 <= r.score <= 1 for r in found)
    assert all((by[i].lang_pred, by[i].score, by[i].rejected) == ("und", 0, True) for i in (9000, 9001, 9002))
    assert by[9003].lang_pred == "bb" and by[9004].rejected and by[9004].lang_pred in ALPHABETS
    assert len({(r.lang_pred, r.score) for r in found if r.doc_id == 5}) == 1


def test_held_out_rows_teach_nothing(spark):
    rows = documents()
    schema = "doc_id bigint, text string, lang string"
    one = language.fit(spark.createDataFrame(rows, schema))
    two = language.fit(spark.createDataFrame([(i, "zzz " + t if held(i) else t, "new" if held(i) else lang) for i, t, lang in rows], schema))
    assert one.languages == two.languages and np.array_equal(one.idf, two.idf) and np.array_equal(one.centres, two.centres) and np.array_equal(one.radius, two.radius)


def test_without_teachers_all_are_unknown(spark):
    docs = spark.createDataFrame([(1, "abc", None), (2, None, "aa")], "doc_id bigint, text string, lang string")
    assert {(r.lang_pred, r.score, r.rejected) for r in language.predict(docs, language.fit(docs)).collect()} == {("und", 0.0, True)}
    assert language.predict(docs.limit(0), language.fit(docs.limit(0))).count() == 0


def test_too_many_languages_raise(spark, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    with pytest.raises(ValueError, match="more than 2 languages"):
        language.fit(spark.createDataFrame(documents(60), "doc_id bigint, text string, lang string"))
