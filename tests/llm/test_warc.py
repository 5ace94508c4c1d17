import gzip
import hashlib
import random
import urllib.parse

from wayline.llm import warc
from wayline.llm.shared import scratch


def pages():
    rng = random.Random(2)
    base = ["".join(rng.choice("abc é🙂<>\r\n") for _ in range(n)) for n in (0, 1, 999, 1000, 3000, 70_000)]
    rows = [(i, f"http://x/{i}", base[i % 6]) for i in range(60)]
    return [*rows, (100, None, None), (101, "http://a b\r\nEvil: 1", "WARC/1.1\r\n\r\n" * 200), (None, "u", base[4]), (None, "u", "y" * 2000), (59, "again", base[5]), (700, "z" * 300, "long " * 200_000)]


def plain(rows):
    top = {}
    for i, _, h in rows:
        b = (h or "").encode()
        if i is not None:
            top[b] = max(top.get(b, i), i)
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        moved = len(b) >= 1000 and b in top and (i is None or i < top[b])
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if moved else "response", top[b] if moved else None))
    return sorted(out, key=str)


def test_round_trip_equals_plain_version(spark):
    rows = pages()
    frame = spark.createDataFrame([(*r, "k") for r in rows], "page_id bigint, url string, html string, kind string").repartition(4)
    got = warc.round_trip(frame, size=4096, roll=20_000).collect()
    assert sorted([tuple(r) for r in got], key=str) == plain(rows)


def test_archives_are_plain_warc_and_chunks_make_the_payload(spark):
    rows = pages()
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").coalesce(1)
    made = warc.write(warc.chunks(warc.records(frame), 1000), scratch(spark, "test"), roll=1 << 30).collect()
    assert sum(m.records for m in made) == len(rows)
    blob = b"".join(gzip.decompress(open(urllib.parse.urlparse(m.uri).path, "rb").read()) for m in made)
    seen = 0
    while blob:
        head, _, rest = blob.partition(b"\r\n\r\n")
        assert head.startswith(b"WARC/1.1\r\n") and b"\r\nEvil" not in head
        size = int(head.rpartition(b"Content-Length: ")[2])
        assert rest[size : size + 4] == b"\r\n\r\n"
        blob = rest[size + 4 :]
        seen += 1
    assert seen == len(rows)
    table = warc.read(spark, spark.createDataFrame(made), 1000).where("page_id = 700").orderBy("chunk").collect()
    assert b"".join(r.data for r in table).decode() == "long " * 200_000
    assert all(len(r.data) <= 1000 for r in table) and table[0].sha1 == hashlib.sha1(b"long " * 200).hexdigest()


def test_empty_table(spark):
    assert warc.round_trip(spark.createDataFrame([], "page_id bigint, url string, html string")).count() == 0


def test_record_ids_are_unique_and_a_hot_page_is_spread(spark, monkeypatch):
    from wayline.llm import components

    monkeypatch.setattr(components, "HOT", 8)
    rows = [(7, "u7", "s" * 1500)] * 3 + [(None, None, "n" * 10)] * 3 + [(100 + i, f"u{i}", "h" * 2000) for i in range(300)] + [(50 + i // 2, "v", "p" * (1000 + i)) for i in range(40)]
    frame = spark.createDataFrame(rows, "page_id bigint, url string, html string").repartition(5)
    assert sorted([tuple(r) for r in warc.round_trip(frame).collect()], key=str) == plain(rows)
    made = warc.write(warc.chunks(warc.records(frame)), scratch(spark, "test")).collect()
    blob = b"".join(gzip.decompress(open(urllib.parse.urlparse(m.uri).path, "rb").read()) for m in made)
    ids = [x for x in blob.split(b"\r\n") if x.startswith(b"WARC-Record-ID: <urn:uuid:")]
    assert len(set(ids)) == len(ids) == len(rows)
    assert blob.count(b"WARC-Refers-To-Target-URI: u299\r\n") == 299
