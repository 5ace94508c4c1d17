import random

from wayline.llm import decontaminate as d


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row


def test_edit_distance_equals_the_plain_table():
    rng = random.Random(3)
    for _ in range(300):
        a = [rng.randint(0, 3) for _ in range(rng.randint(1, 20))]
        b = [rng.randint(0, 3) for _ in range(rng.randint(0, 30))]
        assert min(plain_distance(a, b[: len(a) + 5])) == d.edit_distance(a, b, 5)[0]


def test_normalise():
    assert "".join(map(chr, d.normalise(" A\n\tbÉ  c\x0b"))) == "a bÉ c"
    assert d.normalise(None).size == d.normalise(" \n").size == 0


def test_recall_of_edited_items():
    assert d.recall(0.0, trials=60) == 1
    assert d.recall(0.05, trials=100) >= 0.9


def corpus():
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, say(20 + i)) for i in range(12)]
    docs, held = [], set()
    for k in range(120):
        text = say(rng.randint(0, 300))
        if k % 3 == 0:
            i = rng.randrange(12)
            inner = items[i][1]
            if k % 2:
                inner = inner.upper().replace(" ", "\n  ")
            if k % 4 == 0:
                at = rng.randrange(20, len(inner) - 20)
                inner = f"{inner[:at]}#{inner[at + 1 :]}"
            text = f"{text} {inner} {say(30)}"
            held.add((k, i))
        docs.append((k, text))
    return items, docs, held


def test_hits_equal_brute_force(spark):
    items, docs, held = corpus()
    docs += [(500, None), (501, ""), (502, items[0][1]), (502, items[0][1]), (None, items[1][1]), (503, "w " * 10_000 + items[2][1] + " x" * 10_000)]
    held |= {(502, 0), (None, 1), (503, 2)}
    frame = spark.createDataFrame([(i, t, "z") for i, t in docs], "doc_id bigint, text string, key string")
    bench = spark.createDataFrame([*items, (77, None), (78, ""), (79, "short")], "item_id bigint, text string")
    got = d.hits(frame, bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == held
    lower = {i: " ".join(t.lower().split()) for i, t in docs if t}
    for r in got:
        item = dict(items)[r.item_id]
        window = lower[r.doc_id][r.start : r.start + r.length]
        assert plain_distance(item, window)[-1] == r.edit_distance <= 0.1 * len(item)
    kept = d.clean(frame, bench)
    assert kept.columns == frame.columns
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in docs} - {i for i, _ in held}


def test_every_window_of_a_small_text_is_compared():
    items, docs, held = corpus()
    walks = d.Walks(items[:4])
    for k, text in docs[:4]:
        line = " ".join(text.lower().split())[-500:]
        starts = [0, *[i + 1 for i, c in enumerate(line) if c == " "]]
        want = set()
        for i, item in items[:4]:
            most = int(len(item) * 0.1)
            if any(min(plain_distance(item, line[s : s + len(item) + most])) <= most for s in starts):
                want.add(i)
        assert {h[1] for h in walks.search([line])} == want


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c")], "doc_id bigint, text string")
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert d.hits(docs, none).count() == 0
    assert d.clean(docs, none).count() == 1
    assert d.hits(docs.limit(0), spark.createDataFrame([(1, "long enough to be searched for")], "item_id bigint, text string")).count() == 0


def test_first_word_replaced_dropped_or_misspelt():
    items, _, _ = corpus()
    for i, item in items:
        first, rest = item.split(" ", 1)
        for k, head in enumerate(["zzzzz "[-len(first) - 1 :], "", "zz" + first[2:] + " "]):
            want = plain_distance(item, head + rest)[-1]
            assert want <= 0.1 * len(item)
            (hit,) = d.Walks([(i, item)]).search([f"kk lll {head}{rest} mmm"])
            assert hit[1] == i and hit[4] <= want


def test_recall_with_the_edits_at_the_head():
    assert d.recall(0.05, trials=60, at_head=True) == d.recall(0.1, trials=60) == 1
    assert d.recall(0.03, trials=60, at_head=True) == 1


def test_glued_passages_and_unspaced_scripts():
    items, _, _ = corpus()
    rng = random.Random(9)
    chinese = "".join(chr(rng.randint(0x4E00, 0x9FFF)) for _ in range(60))
    for glue in (">>", "<p>", "Question:", "https://a.example/?q=", "x" * 40):
        assert [h[1:] for h in d.Walks(items[:1]).search([f"kk {glue}{items[0][1]}{glue}"])] == [(0, 3 + len(glue), len(items[0][1]), 0)]
    edited = chinese[:20] + "a" + chinese[21:40] + chinese[41:]
    assert [h[1:] for h in d.Walks([(5, chinese)]).search([chinese[::-1] + edited + chinese[::-1]])] == [(5, 60, 59, 2)]


def test_every_start_of_a_small_text_is_compared():
    rng = random.Random(10)
    for _ in range(40):
        item = "".join(rng.choice("abc d") for _ in range(rng.randint(30, 60))).strip()
        edited = list(item)
        for _ in range(rng.randint(0, 7)):
            at = rng.randrange(len(edited))
            edited[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "ab"])
        line = "".join(rng.choice("abcd") for _ in range(40)) + "".join(edited) + "".join(rng.choice("abcd") for _ in range(40))
        item, line = " ".join(item.split()), " ".join(line.split())
        most = int(len(item) * 0.1)
        want = [(min(plain_distance(item, line[s : s + len(item) + most])), s) for s in range(len(line))]
        got = [(h[4], h[2]) for h in d.Walks([(1, item)]).search([line])]
        assert got == ([min(want)] if len(item) >= d.LEAST and min(want)[0] <= most else [])


def test_short_items_are_found_exactly_between_words():
    items = [(1, "Two words"), (2, "é"), (3, "二字"), (4, "w"), (5, "")]
    text = "xtwo words two wordsx (TWO\n WORDS) éa é. 一二字三 vw wv"
    line = "".join(map(chr, d.normalise(text)))
    got = {h[1]: h[2:] for h in d.Walks(items).search([text])}
    assert got == {1: (line.index("(two") + 1, 9, 0), 2: (line.index("é."), 1, 0), 3: (line.index("二"), 2, 0)}
    assert not list(d.Walks(items[:1]).search(["two werds", None, "xtwo words"]))


def test_text_ids_equal_items_and_blocks(spark, monkeypatch):
    line = "the quick brown fox jumps over the lazy dog again and again"
    items = [("a", line), ("b", line.upper()), (None, f"{line} and more of it"), ("x", None), ("long", "word " * 3000)]
    bench = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id string, text string, key int")
    docs = spark.createDataFrame([("d1", f"so {line}."), (None, f"{line} and more of it"), ("d2", "word " * 3001), ("d3", None), ("d4", "")], "doc_id string, text string")
    want = sorted([("d1", "a", 0), ("d1", "b", 0), (None, "a", 0), (None, "b", 0), (None, None, 0), ("d2", "long", 0)], key=str)
    assert sorted([(r.doc_id, r.item_id, r.edit_distance) for r in d.hits(docs, bench).collect()], key=str) == want
    monkeypatch.setattr(d, "BLOCK_CHARS", 70)
    assert [len(b) for b in d.blocks(bench)] == [1, 1, 1, 1]
    assert sorted([(r.doc_id, r.item_id, r.edit_distance) for r in d.hits(docs, bench).collect()], key=str) == want
    assert sorted(r.doc_id for r in d.clean(docs, bench).collect()) == ["d3", "d4"]
    none = spark.createDataFrame([], "item_id string, text string")
    assert d.hits(docs, none).count() == 0 and d.clean(docs, none).count() == 5


def nearest_part(item, text):
    """Least edit distance of the item to any part of the text, by the whole table."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        new = [i]
        for j, e in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != e)))
        row = new
    return min(row)


def test_hits_equal_the_whole_table_of_distances():
    rng = random.Random(31)
    words = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(1, 5))) for _ in range(25)]
    line = lambda n: " ".join(rng.choice(words) for _ in range(n))
    items = [(i, line(rng.randint(8, 16))) for i in range(14)]
    texts = []
    for _ in range(60):
        t = list(rng.choice(items)[1])
        # From none to more edits than are allowed, spread or all at one end, and any glue.
        edits, span = rng.randint(0, len(t) // 8), rng.choice([1.0, 0.3])
        for _ in range(edits):
            at = int(rng.random() * span * len(t))
            what = rng.randrange(3)
            t[at : at + (what != 1)] = [] if what == 2 else [rng.choice("abcdefg ")]
        glue = rng.choice([" ", "", '"', "x", "Question:"])
        texts.append(f"{line(3)}{glue}{''.join(t)}{glue}{line(3)}")
    plain = lambda t: "".join(map(chr, d.normalise(t)))
    got = {(h[0], h[1]): h[4] for h in d.Pieces(items).search(texts)}
    want = {}
    for k, t in enumerate(texts):
        for i, item in items:
            far = nearest_part(plain(item), plain(t))
            if far <= int(len(plain(item)) * (1 - d.SIMILARITY) + 1e-9):
                want[k, i] = far
    assert got == want and len(want) > 30 and len({v for v in want.values()}) > 3
