import itertools
import random
import re

from wayline.llm import filter_audit


def fails(text):
    words = re.findall("[^\x20\x09-\x0d]+", text)
    return {
        "A": len(words) < 200,
        "B": 100 * len(set(words)) < 50 * len(words),
        "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
        "D": bool(re.search("[#$%&*|]", text)),
    }


def plain(docs, labels):
    """docs: (doc_id, text, lang); every document walks through every order."""
    docs = [(i, t or "", p or "") for i, t, p in docs]
    failed = []
    for i, text, _ in docs:
        one = fails(text)
        one["E"] = i is not None and any(j is not None and j < i and t == text for j, t, _ in docs)
        failed.append({c for c, v in one.items() if v})
    said = lambda i, k: any(row[0] == i and row[k] == 1 for row in labels if i is not None)
    found = {}
    for part in {p for _, _, p in docs}:
        own = [(failed[k], said(docs[k][0], 1), said(docs[k][0], 2)) for k in range(len(docs)) if docs[k][2] == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in itertools.permutations("ABCDE"):
            left = own
            for k, c in enumerate(order):
                gone = [d for d in left if c in d[0]]
                left = [d for d in left if c not in d[0]]
                redundant = sum(c in d[0] for d in own) - len(gone)
                found[part, "".join(order), k + 1] = [len(left), len(gone), redundant, sum(d[0] == {c} for d in own), sum(d[1] for d in gone), sum(d[2] for d in gone), c]
                shapley[c] += len(gone)
        for key, row in found.items():
            if key[0] == part:
                row.insert(6, shapley[row[6]])
    return found


def got(spark, docs, labels):
    d = spark.createDataFrame([(*r, "n", 7) for r in docs], "doc_id bigint, text string, lang string, part string, n int")
    rows = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int")).collect()
    found = {(r.part, r.filter_order, r.step): [r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley, r.filter] for r in rows}
    assert len(found) == len(rows)
    return found


def test_equals_walking_every_document_through_every_order(spark):
    rng = random.Random(5)
    vocabulary = [f"word{i}" for i in range(300)]
    docs = []
    for i in range(160):
        words = rng.choices(vocabulary[: rng.choice([40, 300])], k=rng.choice([3, 150, 199, 200, 260]))
        if rng.random() < 0.3:
            words = [w.upper() for w in words[:40]] + words[40:]
        if rng.random() < 0.3:
            words.append(rng.choice("#$%&*|"))
        docs.append((i, rng.choice([" ", "\n", "\x0b \t"]).join(words), rng.choice(["en", "de", None, ""])))
    docs += [(200 + k, docs[k % 5][1], rng.choice(["en", "de", "fr"])) for k in range(60)]
    docs += [(-3, docs[7][1], "fr"), (7, docs[7][1], "en"), (7, docs[7][1], "de"), (300, None, "en"), (301, "", None), (302, "\xa0 é", "en"), (303, "Ä" * 40 + " x", "en")]
    docs += [(None, docs[0][1], "en"), (None, docs[0][1], "en"), (None, None, None), (304, "A a" * 40_000, "fr")]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(0, 260, 2)] + [(2, 1, 0), (2, 0, 1), (None, 1, 1), (999, 1, 1), (7, 1, 1)]
    assert got(spark, docs, labels) == plain(docs, labels)


def test_one_part_and_one_document(spark):
    assert got(spark, [(1, "x", "en")], []) == plain([(1, "x", "en")], [])


def test_empty_tables(spark):
    assert got(spark, [], []) == {}
