"""Exact top-k search (operator 9): block-at-a-time pruning by summed term maxima, scored through block forward indexes."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TopK, materialize, small_batches, usable_vector

#: Vectors of a block; vectors and queries that meet in one task; groups whose maxima meet queries together.
BLOCK, TOGETHER, QUERIES_TOGETHER, GROUPS_TOGETHER = 512, 8192, 2048, 1024
#: Vectors and queries that meet in one task where sums need whole numbers of any length, and the largest score a long holds.
WIDE_TOGETHER, MOST = 1024, 2**63 - 1


def _taking_part(vectors: DataFrame, scale: int, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, dim, v (doubles), wide of the rows that take part. Sums of two vectors that are not wide are exact in doubles."""
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable_vector(F.col("v"))).withColumn("dim", F.size("v"))
    top = F.array_max(F.transform("v", lambda x: F.abs(x))) * float(scale) + 1
    return rows.select("vec_id", "dim", "v", (top * top * F.col("dim") >= F.lit(2.0**53)).alias("wide"))


def _dealt(rows: DataFrame, n: int, size: int, key: str) -> DataFrame:
    """rows with a group number below ceil(n / size): id ranges where ids are spread evenly, and even in size in any case."""
    groups = max(1, math.ceil(n / size))
    parts = rows.repartitionByRange(groups, "vec_id")
    return parts.withColumn(key, F.spark_partition_id()) if groups > 1 else rows.withColumn(key, F.lit(0))


def _stacked(pdf: pd.DataFrame, scale: int) -> np.ndarray:
    return np.floor(scale * np.stack(pdf["v"].tolist()).astype(np.float64))


def _search(q_ids: np.ndarray, q: np.ndarray, v_ids: np.ndarray, v: np.ndarray, k: int, floor: np.ndarray) -> TopK:
    """Blocks in the order of their bounds for each query, until the next bound is below the query's kth score."""
    order = np.argsort(v_ids, kind="stable")
    v_ids, v = v_ids[order], v[order]
    cuts = range(0, len(v), BLOCK)
    high = np.stack([v[c : c + BLOCK].max(0) for c in cuts])
    low = np.stack([v[c : c + BLOCK].min(0) for c in cuts])
    bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    ranked = np.argsort(-bound, axis=1, kind="stable")
    best = TopK(q_ids, k, floor)
    every = np.arange(len(q))
    for step in range(len(cuts)):
        at = ranked[:, step]
        live = every[bound[every, at] >= best.floor]
        if not len(live):
            break
        for b in np.unique(at[live]):
            rows = live[at[live] == b]
            c = cuts[b]
            best.add(rows, q[rows] @ v[c : c + BLOCK].T, v_ids[c : c + BLOCK])
    return best


def _whole(pdf: pd.DataFrame, scale: int) -> np.ndarray:
    """Components as whole numbers of any length."""
    rows = [[math.floor(scale * x) if abs(x) < 2.0**60 else int(x) * scale for x in v] for v in pdf["v"].tolist()]
    return np.array(rows, object).reshape(len(rows), -1)


def exact_top_k(vectors: DataFrame, k: int = 20, scale: int = 64, every: int = 20, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by `every`, its k highest integer inner products.

    Components become floor(scale * x). Vectors that are null, empty or hold a null or non-finite component, and rows without
    an id, take no part; a query meets vectors of its own dimension only. Rows of the query's own id are not its candidates;
    rows that repeat a query's id are that query's as well, with the candidates of each. Ties go to the smaller id. With
    fewer candidates than k all are returned; an empty table gives no rows. A score beyond a long's range is that range's end.

    The largest and least components of each group of TOGETHER vectors bound what a query can score there. Each query goes to
    the group of its highest bound first; its kth score there is the floor, and it is then sent only to groups whose bound
    reaches that. In a task the same is done with blocks of BLOCK vectors. Sums are taken in doubles where that is exact (components of
    some 10**7 at dimension 64); pairs with a larger vector are summed in whole numbers of any length, in groups of bounded size.
    """
    small_batches(vectors.sparkSession, 4096)
    rows = materialize(_taking_part(vectors, scale, id_col, vec_col), "vectors")
    asked = materialize(rows.where(F.col("vec_id") % every == 0).withColumn("query", F.monotonically_increasing_id()), "queries")
    counted = rows.agg(F.count(F.when(~F.col("wide"), 1)).alias("plain"), F.count(F.when(F.col("wide"), 1)).alias("wide")).first()
    n_queries, wide_queries = asked.count(), asked.where("wide").count()
    kind = "query long, query_id long, vec_id long, score long"
    none = pd.DataFrame({"query": [], "query_id": [], "vec_id": [], "score": []}, dtype="int64")
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.lit(max(1, n) - 1)))
    dealt = lambda n, size, *key: F.pmod(F.xxhash64(*key), F.lit(max(1, math.ceil(n / size)))).cast("int")

    def meet(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return none
        ids = left["vec_id"].to_numpy()
        best = _search(ids, _stacked(left, scale), right["vec_id"].to_numpy(), _stacked(right, scale), k, left["floor"].to_numpy(np.float64))
        return pd.DataFrame({"query": left["query"].to_numpy()[best.q], "query_id": ids[best.q], "vec_id": best.v, "score": best.s.astype(np.int64)})

    def meet_whole(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return none
        q, v, v_ids, out = _whole(left, scale), _whole(right, scale), right["vec_id"].to_numpy(), [none]
        for at, (query, own) in enumerate(zip(left["query"], left["vec_id"])):
            sums = np.array([max(-MOST, min(MOST, x)) for x in (v @ q[at]).tolist()], np.int64)
            other = np.nonzero(v_ids != own)[0]
            other = other[np.lexsort((v_ids[other], -sums[other]))[:k]]
            out.append(pd.DataFrame({"query": query, "query_id": own, "vec_id": v_ids[other], "score": sums[other]}))
        return pd.concat(out).astype("int64")

    def extremes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (dim, vg), own in pdf.groupby(["dim", "vg"]):
                v = _stacked(own, scale)
                yield pd.DataFrame({"dim": [dim], "vg": [vg], "high": [v.max(0).tolist()], "low": [v.min(0).tolist()]})

    def widest(pdf: pd.DataFrame) -> pd.DataFrame:
        high, low = np.stack(pdf["high"].tolist()).max(0), np.stack(pdf["low"].tolist()).min(0)
        return pdf.iloc[:1].assign(high=[high.tolist()], low=[low.tolist()])

    def bounds(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query": np.empty(0, "int64"), "vg": np.empty(0, "int32"), "bound": np.empty(0)})
        q, high, low = _stacked(left, scale), np.stack(right["high"].tolist()), np.stack(right["low"].tolist())
        bound = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
        i, j = np.nonzero(bound >= left["floor"].to_numpy()[:, None])
        if left["best"].iloc[0]:  # only the first of each query
            i, j = np.arange(len(q)), bound.argmax(1)
        return pd.DataFrame({"query": left["query"].to_numpy()[i], "vg": right["vg"].to_numpy()[j].astype("int32"), "bound": bound[i, j]})

    plain_queries = asked.where("not wide").withColumn("qg", dealt(n_queries, QUERIES_TOGETHER, "query"))
    n_groups = max(1, math.ceil(counted["plain"] / TOGETHER))
    stored = materialize(_dealt(rows.where("not wide"), counted["plain"], TOGETHER, "vg"), "blocks")

    def searched(pairs: DataFrame) -> DataFrame:
        """What pairs(query, dim, qg, vg, floor) find."""
        by = ["dim", "qg", "vg"]
        pairs = materialize(pairs, "pairs")
        wanted = pairs.select(*(F.col(c).alias(c) for c in by)).distinct()
        left = plain_queries.select("query", "vec_id", "v").join(pairs, "query")
        right = stored.join(F.broadcast(wanted) if n_groups * math.ceil(n_queries / QUERIES_TOGETHER) <= 10_000 else wanted, ["dim", "vg"])
        return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, kind)

    start = plain_queries.withColumn("floor", F.lit(float("-inf")))
    if n_groups == 1:
        found = searched(start.select("query", "dim", "qg", F.lit(0).alias("vg"), "floor"))
    else:
        edges = stored.select("dim", "vg", "v").mapInPandas(extremes, "dim int, vg int, high array<double>, low array<double>")
        edges = edges.groupBy("dim", "vg").applyInPandas(widest, "dim int, vg int, high array<double>, low array<double>")
        edges = materialize(edges.withColumn("sg", F.floor(F.col("vg") / GROUPS_TOGETHER).cast("int")), "extremes")
        q_groups, s_groups = max(1, math.ceil(n_queries / QUERIES_TOGETHER)), n_groups // GROUPS_TOGETHER + 1

        def bounded(queries: DataFrame, best: bool) -> DataFrame:
            by = ["dim", "qg", "sg"]
            left = queries.select("query", "dim", "qg", "v", "floor", F.lit(best).alias("best"), upto(s_groups).alias("sg"))
            right = edges.withColumn("qg", upto(q_groups))
            found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(bounds, "query long, vg int, bound double")
            return found.join(queries.select("query", "dim", "qg", "floor"), "query")

        highest = Window.partitionBy("query").orderBy(F.desc("bound"), "vg")
        one = bounded(start, True).withColumn("n", F.row_number().over(highest)).where("n = 1").drop("n")
        first = materialize(searched(one), "first")
        floors = first.groupBy("query").agg(F.when(F.count("*") >= k, F.min("score").cast("double")).alias("seen"))
        raised = start.drop("floor").join(floors, "query", "left").withColumn("floor", F.coalesce("seen", F.lit(float("-inf")))).drop("seen")
        rest = bounded(materialize(raised, "raised"), False).join(one.select("query", "vg"), ["query", "vg"], "left_anti")
        found = first.unionByName(searched(materialize(rest, "rest")))
    # pairs that need whole numbers: every query with wide vectors, and wide queries with the others
    for left, n_left, right, n_right in ((asked, n_queries, rows.where("wide"), counted["wide"]), (asked.where("wide"), wide_queries, rows.where("not wide"), counted["plain"])):
        if n_left and n_right:
            by = ["dim", "qg", "vg"]
            left = left.select("query", "vec_id", "dim", "v", dealt(n_left, WIDE_TOGETHER, "query").alias("qg"), upto(math.ceil(n_right / WIDE_TOGETHER)).alias("vg"))
            right = right.select("vec_id", "dim", "v", dealt(n_right, WIDE_TOGETHER, "vec_id", "v").alias("vg"), upto(math.ceil(n_left / WIDE_TOGETHER)).alias("qg"))
            found = found.unionByName(left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet_whole, kind))
    best = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
