"""Streams of revisions, read file by file."""

from pyspark.sql import functions as F

from tallyvine.streaming import turns

SCHEMA = "tree_id string, link string, kind string, event_time timestamp"


def run(spark, tmp_path, rows, f, mode):
    for i, part in enumerate(rows):
        made = spark.createDataFrame([(t, x, k, s) for t, x, k, s in part], "tree_id string, link string, kind string, event_time string")
        made.withColumn("event_time", F.to_timestamp("event_time")).coalesce(1).write.mode("append").parquet(str(tmp_path / f"in/{i}"))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    name = f"out_{abs(hash(str(tmp_path)))}"
    query = f(stream).writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    return spark.table(name).collect()


def test_repeats_within_the_delay_go(spark, tmp_path):
    first = [("a", "1", "object", "2020-01-01 10:00:00"), ("a", "1", "object", "2020-01-01 10:01:00"), ("b", "1", "object", "2020-01-01 10:02:00")]
    again = [("a", "1", "object", "2020-01-01 10:03:00"), ("a", "2", "anchor", "2020-01-01 10:04:00")]
    got = run(spark, tmp_path, [first, again], turns.deduplicated, "append")
    assert sorted((r["tree_id"], r["link"]) for r in got) == [("a", "1"), ("a", "2"), ("b", "1")]


def test_turns_are_closed_by_anchors(spark, tmp_path):
    rows = [("a", "1", "object", "2020-01-01 10:00:00"), ("a", "2", "object", "2020-01-01 10:05:00"), ("b", "3", "object", "2020-01-01 10:01:00"), ("b", "4", "anchor", "2020-01-01 10:09:00"), ("b", "5", "object", "2020-01-01 10:11:00")]
    got = run(spark, tmp_path, [rows], turns.open_turns, "complete")
    assert sorted((r["tree_id"], str(r["start"])[11:16], r["n_revisions"], r["closed"]) for r in got) == [("a", "10:00", 2, False), ("b", "10:00", 2, True), ("b", "10:10", 1, False)]
