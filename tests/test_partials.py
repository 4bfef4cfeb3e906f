import datetime as dt

import numpy as np
from pyspark.sql import functions as F

from galleryspark.plans import storage_queries
from galleryspark.streaming import jobs as J

START = dt.datetime(2024, 3, 30, 20)


def rows(spark, n=400, seed=1):
    """A third of all samples on one host, repeated times, nulls, spans of many hours."""
    rng = np.random.default_rng(seed)
    out = []
    for i in range(n):
        host = 0 if i % 3 == 0 else int(rng.integers(1, 6))
        minutes = int(rng.integers(0, 60 * 24 * 4)) if host else int(rng.integers(0, 60 * 30))
        out.append((START + dt.timedelta(minutes=minutes, microseconds=int(rng.integers(0, 3)) * 250_000), host, None if i % 17 == 0 else float(i % 29)))
    return spark.createDataFrame(out + out[:20], "ts timestamp, host int, value double")


def parts(spark, df, tmp_path, partial, batches=5):
    folder, path = str(tmp_path / "in"), str(tmp_path / "partials")
    df.withColumn("_b", F.pmod(F.xxhash64("ts"), F.lit(batches))).repartition(batches, "_b").drop("_b").write.parquet(folder)
    for _ in range(2):  # the second run finds nothing new
        J.stream_partials(J.read_parquet_stream(spark, folder, df.schema, files_per_batch=1), partial, path, str(tmp_path / "cp"))
    assert spark.read.parquet(path).select("batch").distinct().count() > 1
    return spark.read.parquet(path)


def as_set(df):
    return sorted(map(str, df.collect()))


def test_windows_of_batches_merge_to_all_rows(spark, tmp_path):
    df = rows(spark)
    got = J.whole_windows(parts(spark, df, tmp_path, lambda b: J.partial_windows(b, "host", F.col("value"), "2 hours", "1 hour")), "host")
    want = J.resource_windows(df, "2 hours", "1 hour").select("host", "window_start", "window_end", "n", F.round("mean", 9).alias("mean"), "max")
    assert as_set(got.withColumn("mean", F.round("mean", 9))) == as_set(want)


def test_sessions_of_batches_merge_to_all_rows(spark, tmp_path):
    df = rows(spark)
    got = J.whole_sessions(parts(spark, df, tmp_path, lambda b: J.activity_sessions(b, "45 minutes")))
    want = J.activity_sessions(df, "45 minutes")
    assert as_set(got) == as_set(want)
    longest = want.select(F.max(F.col("session_end").cast("double") - F.col("session_start").cast("double"))).first()[0]
    assert longest > 10 * 3600


def test_sessions_that_only_touch_stay_apart(spark):
    at = lambda m: START + dt.timedelta(minutes=m)
    plain = spark.createDataFrame([(at(0), 1, 1.0), (at(10), 1, 2.0), (at(19), 1, 3.0)], "ts timestamp, host int, value double")
    each = [J.activity_sessions(plain.where(F.col("value") == v), "10 minutes") for v in (1.0, 2.0, 3.0)]
    got = J.whole_sessions(each[0].unionByName(each[1]).unionByName(each[2]))
    assert as_set(got) == as_set(J.activity_sessions(plain, "10 minutes"))


def test_sessions_stay_merged_when_columns_are_pruned(spark):
    df = rows(spark)
    for sessions in (J.activity_sessions(df, "45 minutes"), J.whole_sessions(J.activity_sessions(df, "45 minutes"))):
        whole = sessions.collect()
        assert sessions.count() == len(whole)
        assert as_set(sessions.select("session_start", "session_end")) == sorted(f"Row(session_start={r.session_start!r}, session_end={r.session_end!r})" for r in whole)


def test_table_of_many_files_as_stream(spark, tmp_path):
    """The tables may be folders of files as well as single files."""
    rows = [(n, [float(n)] * 3, n % 2) for n in range(9)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").repartition(3).write.parquet(str(tmp_path / "embeddings.parquet"))
    assert storage_queries.l1_stream_index(spark, str(tmp_path)).count() == 9
