"""Line dedup (operator 6): levelled sorted runs of line hashes; each new batch merge-anti-joins the runs and adds its own."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir
from .common import materialize, small_batches, texts_of

BLANKS = b" \t\n\x0b\x0c\r"
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def _keys(text: str, least: int) -> list[tuple[int, bytes]]:
    """(line number, 16-byte hash) of the lines of text whose key has at least `least` code points."""
    import xxhash

    out = []
    for i, line in enumerate(text.encode("utf-8", "surrogatepass").split(b"\n")):
        key = line.strip(BLANKS)
        if len(key) >= least and (len(key) >= 4 * least or len(key.decode("utf-8", "surrogatepass")) >= least):
            out.append((i, xxhash.xxh3_128_digest(key.translate(LOWER))))
    return out


def line_hashes(docs: DataFrame, least: int = 20) -> DataFrame:
    """doc_id, h1, h2: the distinct key hashes (128 bits) of each row of docs(doc_id, text)."""

    def hashed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ids, found = [], []
            for d, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                own = {h for _, h in _keys(t, least)}
                ids += [d] * len(own)
                found += own
            h = np.frombuffer(b"".join(found), "<i8").reshape(-1, 2)
            yield pd.DataFrame({"doc_id": pd.array(ids, "Int64") if None in ids or any(x != x for x in ids) else np.asarray(ids, "int64"), "h1": h[:, 0], "h2": h[:, 1]})

    return docs.mapInPandas(hashed, "doc_id long, h1 long, h2 long")


class Runs:
    """Runs of (h1, h2, n, keeper, first), each sorted by hash and written in the shared folder, in levels.

    fanout runs of a level are merged into one run of the next level, so a hash is rewritten once a level and a new batch
    meets few runs. A hash has one row with `first`, in the batch that saw it first; what later batches add to it is a count and
    their largest doc_id. state() names what is written, and reopen() goes on from there in another job.
    """

    def __init__(self, spark: SparkSession, fanout: int = 3, levels: list[list[str]] | None = None):
        self.spark, self.fanout, self.levels = spark, fanout, levels or [[]]

    def state(self) -> dict:
        """The paths of the runs by level."""
        return {"fanout": self.fanout, "levels": [list(level) for level in self.levels]}

    @classmethod
    def reopen(cls, spark: SparkSession, state: dict) -> Runs:
        return cls(spark, state["fanout"], [list(level) for level in state["levels"]])

    def _write(self, run: DataFrame) -> str:
        path = f"{shared_dir(self.spark)}/tallyvine/run-{uuid.uuid4().hex}"
        run.select("h1", "h2", "n", "keeper", "first").sortWithinPartitions("h1", "h2").write.option("compression", "zstd").parquet(path)
        return path

    def _read(self, paths: list[str]) -> DataFrame | None:
        return self.spark.read.schema("h1 long, h2 long, n long, keeper long, first boolean").parquet(*paths) if paths else None

    def all(self) -> DataFrame | None:
        return self._read([path for level in self.levels for path in level])

    def add(self, batch: DataFrame) -> None:
        """batch: (doc_id, h1, h2). Batches come in any order of doc_id."""
        own = batch.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.max("doc_id").alias("keeper"))
        if (old := self.all()) is not None:
            keys = old.where("first").select("h1", "h2")
            fresh = own.join(keys, ["h1", "h2"], "left_anti").withColumn("first", F.lit(True))
            own = fresh.unionByName(own.join(keys, ["h1", "h2"], "left_semi").withColumn("first", F.lit(False)))
        else:
            own = own.withColumn("first", F.lit(True))
        self.levels[0].append(self._write(own))
        at = 0
        while len(self.levels[at]) >= self.fanout:
            merged = self._write(_merged(self._read(self.levels[at])))
            self.levels[at] = []
            at += 1
            if at == len(self.levels):
                self.levels.append([])
            self.levels[at].append(merged)

    def repeated(self, in_docs: int) -> DataFrame:
        """h1, h2, keeper of the hashes that in_docs rows or more hold; keeper is the largest doc_id."""
        return _merged(self.all()).where(F.col("n") >= in_docs).select("h1", "h2", "keeper")


def _merged(runs: DataFrame) -> DataFrame:
    return runs.groupBy("h1", "h2").agg(F.sum("n").alias("n"), F.max("keeper").alias("keeper"), F.max("first").alias("first"))


def _victims(base: DataFrame, least: int, in_docs: int, batches: int, fanout: int) -> DataFrame:
    """lost_id, lost: the hashes that each doc_id of base(doc_id, text) loses."""
    hashes = line_hashes(base, least)
    if batches > 1:
        cuts = base.where(F.col("doc_id").isNotNull()).approxQuantile("doc_id", [i / batches for i in range(1, batches)], 0.01)
        cuts = sorted(set(cuts), reverse=True)
    else:
        cuts = []
    batch = F.lit(len(cuts))
    for i in reversed(range(len(cuts))):
        batch = F.when(F.col("doc_id") > F.lit(cuts[i]), F.lit(i)).otherwise(batch)
    hashes = materialize(hashes.withColumn("batch", batch), "hashes", "batch")
    runs = Runs(base.sparkSession, fanout)
    for i in range(len(cuts) + 1):
        runs.add(hashes.where(F.col("batch") == i).select("doc_id", "h1", "h2"))
    doomed = materialize(runs.repeated(in_docs), "doomed")
    victims = hashes.join(doomed, ["h1", "h2"]).where(~F.col("doc_id").eqNullSafe(F.col("keeper")) | F.col("keeper").isNull())
    # Rows of one doc_id may differ in text; each drops what it holds of the set.
    return victims.groupBy(F.col("doc_id").alias("lost_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("lost"))


def _without(least: int):
    """A function of (text, h1s, h2s): text without the lines of these hashes, its lines before and those dropped."""

    @F.pandas_udf("text string, n_lines long, n_dropped long")
    def cleaned(texts: pd.Series, a: pd.Series, b: pd.Series) -> pd.DataFrame:
        out = []
        for t, x, y in zip(texts.tolist(), a.tolist(), b.tolist()):
            if x is None or isinstance(x, float):
                out.append((t, t.count("\n") + 1, 0))
                continue
            h = np.stack([np.asarray(x, "<i8"), np.asarray(y, "<i8")], 1).tobytes()
            gone = {h[i : i + 16] for i in range(0, len(h), 16)}
            cut = {i for i, k in _keys(t, least) if k in gone}
            lines = t.split("\n")
            out.append(("\n".join(x for i, x in enumerate(lines) if i not in cut), len(lines), len(cut)))
        return pd.DataFrame(out, columns=["text", "n_lines", "n_dropped"], index=texts.index)

    return cleaned


def dedup_lines(docs: DataFrame, least: int = 20, in_docs: int = 3, batches: int = 4, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, n_lines, n_dropped: every row of docs without its repeated lines.

    A key is a line without ASCII blanks at its ends and with A-Z lower-cased. Keys of at least `least` code points found in
    at least in_docs rows lose all their lines except in the largest doc_id holding them; the other lines stay. A null or
    empty text is one empty line. Rows that repeat a doc_id count as documents each and share the fate of that id; a row
    without an id keeps no key that was found often enough. An empty table gives no rows; other columns are ignored.

    Counts are pre-aggregated before each shuffle, so a line of every document is one row a task; the join that marks
    victims is a plain equi-join whose hot keys adaptive execution splits.
    """
    small_batches(docs.sparkSession)
    base = texts_of(docs, id_col, text_col)
    lost = _victims(base, least, in_docs, batches, fanout)
    both = base.join(lost, F.col("doc_id").eqNullSafe(F.col("lost_id")), "left").select("doc_id", "text", F.col("lost.h1").alias("a"), F.col("lost.h2").alias("b"))
    return both.select("doc_id", _without(least)("text", "a", "b").alias("out")).select("doc_id", "out.text", "out.n_lines", "out.n_dropped")


def dedup_lines_of(docs: DataFrame, least: int = 20, in_docs: int = 3, batches: int = 4, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """docs, whole, with the texts that dedup_lines() gives; chars_col, where docs has it, is the length of the new text. Null texts become empty."""
    small_batches(docs.sparkSession)
    lost = _victims(texts_of(docs, id_col, text_col), least, in_docs, batches, fanout)
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(id_col).cast("long").alias("own_id"))
    both = rows.join(lost, F.col("own_id").eqNullSafe(F.col("lost_id")), "left")
    new = _without(least)(F.coalesce(F.col("row").getField(text_col), F.lit("")), F.col("lost.h1"), F.col("lost.h2"))
    out = both.select("row", new.alias("new")).select(*[F.col("new.text").alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])
    return out.withColumn(chars_col, F.length(text_col).cast(docs.schema[chars_col].dataType)) if chars_col in docs.columns else out
