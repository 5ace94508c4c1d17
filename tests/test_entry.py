import sys

import __spark_entry__
from wayline.plans import catalogue


def test_sql_names_are_known_and_the_flagship_query_has_its_columns(spark):
    known = __spark_entry__.queries()
    assert set(__spark_entry__.oracle_sql()) <= set(known)
    assert set(catalogue.QUERIES) <= set(known)
    assert __spark_entry__.entry(spark).columns == ["org", "dest", "s", "flow"]


def test_the_core_stands_where_a_package_of_the_rest_is_missing(monkeypatch):
    for name in [m for m in sys.modules if m == "corpus_pipeline" or m.startswith("wayline.llm")]:
        monkeypatch.delitem(sys.modules, name)
    monkeypatch.delattr(sys.modules["wayline"], "llm", raising=False)
    monkeypatch.setitem(sys.modules, "xxhash", None)
    assert set(__spark_entry__.queries()) == set(catalogue.QUERIES)
    assert set(__spark_entry__.oracle_sql()) == set(catalogue.ORACLE_SQL)
