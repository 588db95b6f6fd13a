"""Streams of revisions: content-addressed, so a repeat is the same link again; an extension of our own."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def deduplicated(revisions: DataFrame, time_col: str = "event_time", delay: str = "1 hour") -> DataFrame:
    """A stream of (tree_id, link, event_time, ...) without repeats of a link that arrive within delay."""
    return revisions.withWatermark(time_col, delay).dropDuplicatesWithinWatermark(["tree_id", "link"])


def open_turns(revisions: DataFrame, time_col: str = "event_time", delay: str = "1 hour", window: str = "10 minutes") -> DataFrame:
    """tree_id, window, n_revisions, closed: counts by tree and window, and whether an anchor has closed it; late rows within delay count."""
    rows = revisions.withWatermark(time_col, delay)
    out = rows.groupBy("tree_id", F.window(time_col, window).alias("window")).agg(
        F.count("*").alias("n_revisions"), F.max((F.col("kind") == "anchor").cast("int")).alias("closed")
    )
    return out.select("tree_id", F.col("window.start").alias("start"), "n_revisions", (F.col("closed") == 1).alias("closed"))
