"""The driver's entry points."""

import __spark_entry__ as entry_points


def test_entry_and_registry(spark):
    df = entry_points.entry(spark)
    assert df.columns == ["arxiv_id", "topic", "topic_label", "title", "score", "published"]
    rows = df.collect()
    assert rows and all(r.score >= 60 for r in rows)
    queries, oracles = entry_points.queries(), entry_points.oracle_sql()
    assert set(oracles) <= set(queries) and len(queries) > 100
