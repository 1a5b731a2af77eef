"""Streaming queries over tables that are folders of files."""

import __spark_entry__
import pytest

SF = "/root/testdata/sf0.001"
TABLES = {"x05_scoring_stream": "documents", "x01_rollup_stream": "events", "x06_triage_stream": "events"}


@pytest.mark.parametrize("name", TABLES)
def test_stream_over_a_folder(spark, tmp_path, name):
    table = f"{TABLES[name]}.parquet"
    spark.read.parquet(f"{SF}/{table}").repartition(3).write.parquet(f"{tmp_path}/{table}")
    run = __spark_entry__.queries()[name]
    got, want = run(spark, str(tmp_path)), run(spark, SF)
    assert want.count() and got.count() == want.count()
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(got.columns).collect()))
