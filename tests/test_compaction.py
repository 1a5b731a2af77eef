"""A rollup over many micro-batches: right after each, and read at a cost that doesn't rise."""

import random

from pyspark.sql import functions as F

from tidewatch.operators import dashboards as d
from tidewatch.streaming import compaction, jobs

SCHEMA = "at long, tenant_id long, module string, threat_type string, risk_score double"


def test_rollup_of_many_batches(spark, tmp_path):
    r = random.Random(2)
    source, state, out = (str(tmp_path / n) for n in ("in", "state", "out"))
    schema = SCHEMA.replace("at long", "ts timestamp")
    for _ in range(11):  # three days, touched again and again
        rows = [(r.randint(0, 3 * 86400 - 1), r.randint(1, 2), "email", r.choice(["a", None]), round(r.random(), 3)) for _ in range(40)]
        spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumn("ts", F.timestamp_seconds("at")).drop("at").write.mode("append").parquet(source)
    whole = spark.read.schema(schema).parquet(source)

    def run(epoch_batches):
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = jobs.start_rollup(stream, out, state, {"availableNow": True}, epoch_batches)
        query.awaitTermination()
        assert query.exception() is None

    run(3)
    rounded = lambda df: df.withColumn("avg_risk", F.round("avg_risk", 9))
    got, want = rounded(jobs.read_rollup(spark, out)), rounded(d.hourly_rollup(whole))
    want = want.select(got.columns)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0 and got.count() == want.count()
    last, days = compaction._manifest(spark, out)
    assert last >= 2 and days.count() == 3 and len(compaction._epochs(spark, out, last + 1)) <= 2
    epochs = {name.split("epoch=")[1].split("/")[0] for name in got.inputFiles() if "/rows/" in name}
    assert epochs and min(map(int, epochs)) == last + 1
    # folding an epoch once more changes nothing
    compaction.compact(spark, out, jobs.ROLLUP_KEYS, F.to_date("bucket"), last)
    # a part of a failed attempt isn't read
    got.withColumns({"batch_id": F.lit(99).cast("long"), "day": F.lit("1970-01-01"), "max_risk": F.lit(9.0)}).write.partitionBy("day").parquet(f"{out}/days/lost")
    assert rounded(jobs.read_rollup(spark, out)).exceptAll(want).count() == 0
