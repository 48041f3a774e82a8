"""The row nearest to a value, with ties and rows without a value, against SQL."""

import duckdb

from chelate.queries.analytics import ORACLES, nearest_threshold


def test_ties_and_nulls(spark, tmp_path):
    """Rows equal in distance and value are settled by their id; a null is nearest to nothing."""
    rows = [(9, None), (7, 51.0), (8, 49.0), (5, 49.0), (6, 49.0), (4, 60.0)]
    spark.createDataFrame(rows, "event_id long, value double").repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want = duckdb.sql(ORACLES["nearest_threshold"].replace("events", f"'{tmp_path}/events.parquet/*.parquet'")).fetchall()
    assert [tuple(r) for r in nearest_threshold(spark, str(tmp_path)).collect()] == want == [(5, 49.0)]
