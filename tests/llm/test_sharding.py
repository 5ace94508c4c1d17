import pytest

from wayline.llm import sharding
from wayline.llm.shared import scratch


def rows(n, start=0):
    return [(i, None if i % 17 == 0 else f"text {i} " * (i % 50), "x") for i in range(start, start + n)]


KIND = "doc_id bigint, text string, file string"


def test_arrivals_are_merged_by_size_and_nothing_is_lost(spark):
    store = sharding.Store(spark, scratch(spark, "store"), target=60_000, fanout=4)
    everything = []
    for k in range(6):
        own = rows(400, 300 * k)  # arrivals repeat rows
        everything += own
        store.append(spark.createDataFrame(own, KIND).repartition(5), rows=40)
        before = store.manifest()
        store.compact()
        now = store.manifest()
        assert len(now["shards"]) <= len(before["shards"])
        assert sorted(map(str, map(tuple, store.read().collect()))) == sorted(map(str, everything))
        # An old version still reads as it was.
        assert store.read(before["version"]).count() == len(everything)
    tiers = [store.tier(s["bytes"]) for s in store.manifest()["shards"] if 2 * s["bytes"] <= store.target]
    assert all(tiers.count(t) < 4 for t in tiers)
    store.vacuum()
    assert store.read().count() == len(everything)
    with pytest.raises(Exception):
        store.read(1).count()


def test_a_taken_version_is_not_overwritten(spark):
    store = sharding.Store(spark, scratch(spark, "store"))
    first = store.append(spark.createDataFrame(rows(3), KIND))
    with pytest.raises(sharding.Taken):
        store.commit(first | {"shards": []})
    assert store.read().count() == 3
    # A slower writer commits on top of the faster one's state.
    real, raced = store.manifest, []

    def stale(version=None):
        state = real(version)
        if not raced:
            raced.append(1)
            sharding.Store(spark, store.root).append(spark.createDataFrame(rows(2), KIND))
        return state

    store.manifest = stale
    store.append(spark.createDataFrame(rows(4), KIND))
    store.manifest = real
    assert store.read().count() == 9


def test_empty_and_wrong_arrivals(spark):
    store = sharding.Store(spark, scratch(spark, "store"))
    with pytest.raises(ValueError):
        store.read()
    store.append(spark.createDataFrame([], KIND))
    assert store.read().count() == 0
    with pytest.raises(ValueError):
        store.append(spark.createDataFrame([(1,)], "other int"))
    assert store.compact()["version"] == 1


def test_versions_are_written_as_differences(spark, monkeypatch):
    monkeypatch.setattr(sharding, "SNAPSHOT", 4)
    store = sharding.Store(spark, scratch(spark, "store"), target=1 << 20, fanout=4)
    for k in range(7):
        store.append(spark.createDataFrame(rows(5, 5 * k), KIND).coalesce(1))
    store.compact()
    assert [v for v in store.versions() if "shards" in store.load(v)] == [1, 5]
    assert len(store.load(7)["added"]) == 1 and len(store.load(8)["removed"]) >= 4
    for v in range(1, 8):
        assert sorted(r.doc_id for r in store.read(v).collect()) == list(range(5 * v))
    assert sorted(r.doc_id for r in store.read().collect()) == list(range(35))
    assert len(store.manifest()["shards"]) < 7


def test_very_long_texts(spark):
    store = sharding.Store(spark, scratch(spark, "store"))
    store.append(spark.createDataFrame([(1, "long " * 1_000_000, None), (None, None, "")], KIND), rows=1)
    store.compact()
    assert sorted((r.doc_id or 0, len(r.text or "")) for r in store.read().collect()) == [(0, 0), (1, 5_000_000)]
