"""Helpers shared by the corpus operators."""

from __future__ import annotations

import os
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir

#: Rows of an Arrow batch; texts are long, so batches are kept small.
BATCH_ROWS = 1000


def materialize(df: DataFrame, name: str, *partition_by: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: lineage ends there, and a lost executor costs a reread."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tallyvine/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> None:
    """Bound the Arrow batches that Python workers get: by rows and, where Spark has that setting, by bytes.

    The session's own settings are lowered, and stay so: the frames that need them are evaluated later, by the caller.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key, "10000")) > rows:
        spark.conf.set(key, str(rows))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    have = spark.conf.get(key, None)
    if have is None or not have.isdigit() or int(have) > 32 << 20:
        spark.conf.set(key, str(32 << 20))


def texts_of(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *more: str) -> DataFrame:
    """doc_id (long), text (null: empty) and further columns; whatever else docs holds is left behind."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"), *more)


def draw(df: DataFrame, n: int, *key: str) -> DataFrame:
    """At most n rows of df, about n if it has more: those of the lowest hashes of key, ties by key. Tasks send no more than they hold of these."""
    total = df.count()
    if total > n:
        cut = int(-(2**63) + min(1.0, n / total) * 2.0**64)
        df = df.where(F.xxhash64(*key) <= F.lit(min(cut, 2**63 - 1))).orderBy(F.xxhash64(*key), *key)
    return df.limit(n)


def usable_vector(vec: Column) -> Column:
    """True for arrays of at least one component, all of them finite numbers."""
    return F.coalesce((F.size(vec) > 0) & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))), F.lit(False))


def single_thread() -> None:
    """Keep native tokenizer threads from multiplying inside a task that owns one core."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    os.environ.setdefault("RAYON_NUM_THREADS", "1")


class TopK:
    """The k best (score, id) of each of n queries: highest score first, ties to the smaller id.

    Memory is k candidates a query and the candidates of one block. floor, if given, holds scores that are known to be
    reached k times elsewhere; lower candidates are left out.
    """

    def __init__(self, query_ids: np.ndarray, k: int, floor: np.ndarray | None = None, eps: float = 0.0):
        self.ids, self.k, self.eps = query_ids, k, eps
        self.floor = np.full(len(query_ids), -np.inf) if floor is None else floor.astype(np.float64).copy()
        self.q, self.s, self.v = np.empty(0, np.int64), np.empty(0, np.float64), np.empty(0, np.int64)

    def add(self, rows: np.ndarray, scores: np.ndarray, vec_ids: np.ndarray, exact=None) -> None:
        """Offer a block: scores[i, j] of query rows[i] and vector vec_ids[j]. exact(i, j) gives final scores for the pairs kept."""
        own = self.ids[rows][:, None] == vec_ids[None, :]
        if own.any():
            scores = np.where(own, -np.inf, scores)
        low = self.floor[rows]
        if scores.shape[1] > self.k:
            low = np.maximum(low, np.partition(scores, -self.k, axis=1)[:, -self.k])
        i, j = np.nonzero((scores >= (low - self.eps)[:, None]) & (scores > -np.inf))
        if not len(i):
            return
        s = scores[i, j] if exact is None else exact(i, j)
        self.q, self.s, self.v = np.concatenate([self.q, rows[i]]), np.concatenate([self.s, s]), np.concatenate([self.v, vec_ids[j]])
        order = np.lexsort((self.v, -self.s, self.q))
        q = self.q[order]
        first = np.searchsorted(q, q, side="left")
        place = np.arange(len(q)) - first
        order = order[place < self.k]
        kth = order[place[place < self.k] == self.k - 1]
        self.q, self.s, self.v = self.q[order], self.s[order], self.v[order]
        return self._raise(kth, order)

    def _raise(self, kth: np.ndarray, order: np.ndarray) -> None:
        at = np.searchsorted(self.q, np.unique(self.q), side="right") - 1
        n = np.bincount(self.q, minlength=len(self.ids))
        full = n[self.q[at]] >= self.k
        q = self.q[at[full]]
        self.floor[q] = np.maximum(self.floor[q], self.s[at[full]])
