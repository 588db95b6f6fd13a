"""Approximate nearest neighbours (operator 1): a hierarchical k-means tree with best-bin-first traversal."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import TopK, draw, materialize, small_batches, usable_vector

#: Bounds of the fitting sample, and of what meets in one task.
SAMPLE, CALIBRATION, TOGETHER, QUERIES_TOGETHER = 65_536, 256, 8192, 4096
#: Cells that a tree's rows are meant to make, and the rows and the components that one holds: at least, and at most.
CELLS, CELL_ROWS, CELL_VALUES = 12, 512, 4 << 20
#: Rows that a leaf is meant to hold, levels at most, and the expected excess, in deviations, of the best of a node's children.
LEAF_ROWS, LEVELS, EXCESS = 200, 3, 1.77
#: Dimensions that get a tree of their own, and the rows from which one other than the most frequent does; all others are searched exactly.
TREES, TREE_ROWS = 8, 4096


class Tree:
    """Centroids by level: node i of a level has the nodes i * fan to i * fan + fan - 1 of the next one as children, the last level's are leaves.

    Its size is fixed by its parameters, not by the data. spread is, for each node of the levels above the leaves, the deviation of its children from it
    in one direction.
    """

    def __init__(self, levels: list[np.ndarray], fan: int):
        self.levels, self.fan = levels, fan
        self.spread = [
            np.sqrt(((low.reshape(len(up), fan, -1) - up[:, None, :]) ** 2).sum(2).mean(1) / max(1, up.shape[1])) for up, low in zip(levels, levels[1:])
        ]

    @property
    def leaves(self) -> int:
        return len(self.levels[-1])

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each vector: the nearest child, level by level."""
        out = _nearest(x, self.levels[0])
        for level in self.levels[1:]:
            node = out.copy()
            for i in np.unique(node):
                at = np.nonzero(node == i)[0]
                out[at] = i * self.fan + _nearest(x[at], level[i * self.fan : (i + 1) * self.fan])
        return out

    def _above(self, q: np.ndarray) -> list[np.ndarray]:
        """For each level above the leaves, from the lowest up: what each query is promised at most on the way from there down to the nodes of the lowest of them.

        A node promises its inner product with the query, plus what the best of its children may add.
        """
        norm = np.sqrt((q * q).sum(1))[:, None]
        ways: list[np.ndarray] = []
        for level, spread in zip(self.levels, self.spread):
            promise = q @ level.T + EXCESS * norm * spread[None, :]
            ways = [promise, *(np.minimum(np.repeat(w, self.fan, axis=1), promise) for w in ways)]
        return ways

    def order(self, q: np.ndarray) -> np.ndarray:
        """All leaves for each query, best bin first: the order in which one queue of what was seen and not yet opened gives them away.

        A queue gives a leaf away no sooner than the least promising node on its way is the best there is, so leaves come by the least on their way
        from the top; those that have it in common by the least on their way below it, and so on.
        """
        scores = q @ self.levels[-1].T
        keys = [scores, *(np.minimum(np.repeat(w, self.fan, axis=1), scores) for w in self._above(q))]
        return np.lexsort([-k for k in keys], axis=1)

    def visits(self, q: np.ndarray, n: int, rows: np.ndarray | None = None, least: int = 0) -> list[np.ndarray]:
        """The first n leaves of order() for each query, or more, until they hold `least` rows (rows: by leaf), by number.

        Leaves are scored when their branch is opened. Branches are opened for many queries at once, from the best on in rounds that double, until n leaves are
        no worse than the best branch that is left.
        """
        n = min(n, self.leaves)
        if len(self.levels) == 1 or n == self.leaves:
            got = [np.sort(o[:n]) for o in self.order(q)]
        else:
            got = self._opened(q, n)
        if rows is not None:
            for r in [r for r, leaves in enumerate(got) if rows[leaves].sum() < least]:
                order = self.order(q[r : r + 1])[0]
                got[r] = np.sort(order[: max(n, int(np.searchsorted(np.cumsum(rows[order]), least)) + 1)])
        return got

    def _opened(self, q: np.ndarray, n: int) -> list[np.ndarray]:
        ways, fan = self._above(q), self.fan
        least = ways[-1]
        branches = np.argsort(-least, axis=1)
        best = np.take_along_axis(least, branches, axis=1)
        keys = np.full((len(q), self.leaves), -np.inf)
        asking, opened, upto = np.arange(len(q)), 0, -(-n // fan)
        while len(asking):
            new = branches[asking, opened:upto]
            who = np.repeat(asking, new.shape[1])[np.argsort(new, axis=None, kind="stable")]
            which, times = np.unique(new, return_counts=True)
            for b, r in zip(which.tolist(), np.split(who, np.cumsum(times)[:-1])):
                scores = q[r] @ self.levels[-1][b * fan : (b + 1) * fan].T
                keys[r, b * fan : (b + 1) * fan] = np.minimum(scores, least[r, b][:, None])
            if upto >= branches.shape[1]:
                break
            nth = -np.partition(-keys[asking], n - 1, axis=1)[:, n - 1]
            asking = asking[nth <= best[asking, upto]]
            opened, upto = upto, min(2 * upto, branches.shape[1])
        nth = -np.partition(-keys, n - 1, axis=1)[:, n - 1]
        taken = keys >= nth[:, None]
        for r in np.nonzero(taken.sum(1) > n)[0]:  # leaves below one node that is the least on the way of all: order() tells them apart
            taken[r] = False
            taken[r, self.order(q[r : r + 1])[0][:n]] = True
        return [np.nonzero(t)[0] for t in taken]


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c * c).sum(1)[None, :] - 2 * (x @ c.T), axis=1)


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        own = (_nearest(x, c)[:, None] == np.arange(k)[None, :]).astype(np.float64)
        n = own.sum(0)
        c[n > 0] = (own.T @ x)[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.integers(len(x), size=int((n == 0).sum()))]
    return c


def fit_tree(sample: np.ndarray, fan: int = 16, depth: int = 2, seed: int = 7) -> Tree:
    """K-means into fan nodes, each node's vectors into fan nodes again, depth times."""
    rng = np.random.default_rng(seed)
    levels = [_kmeans(sample, fan, rng)]
    at = _nearest(sample, levels[0])
    for _ in range(1, depth):
        up, low, new = levels[-1], [], np.empty_like(at)
        for i in range(len(up)):
            own = np.nonzero(at == i)[0]
            low.append(_kmeans(sample[own] if len(own) else up[i : i + 1], fan, rng))
            if len(own):
                new[own] = i * fan + _nearest(sample[own], low[-1])
        levels.append(np.concatenate(low))
        at = new
    return Tree(levels, fan)


def calibrate(tree: Tree, sample: np.ndarray, own: np.ndarray, k: int, recall: float) -> int:
    """Leaf visits, widened until the sample vectors of the numbers own, as queries, find that share of their k best other sample vectors."""
    at, queries = tree.assign(sample), sample[own]
    scores = queries @ sample.T
    scores[np.arange(len(own)), own] = -np.inf
    k = max(1, min(k, len(sample) - 1))
    true = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    place = np.empty((len(queries), tree.leaves), np.int64)
    np.put_along_axis(place, tree.order(queries), np.arange(tree.leaves)[None, :], axis=1)
    needed = np.sort(np.take_along_axis(place, at[true], axis=1).ravel())
    return int(needed[min(len(needed) - 1, math.ceil(recall * len(needed)) - 1)]) + 1


def nearest(
    vectors: DataFrame, k: int = 20, every: int = 20, recall: float = 0.97, fan: int = 16, sample_rows: int = SAMPLE, id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """query_id, rank, vec_id, score: for every row whose id is divisible by `every`, the k nearest found by inner product.

    Each of the TREES most frequent dimensions with TREE_ROWS rows or more, and the most frequent one in any case, gets a tree
    with as many levels as its count of rows asks for, LEVELS at most. It is fitted on sample_rows rows at most (of the lowest
    hashes of their ids), and leaf visits are widened on some of them until `recall` of the sample's true neighbours are found; a query whose
    leaves hold k rows or fewer visits more. Every row is indexed: it goes to its leaf. Leaves that follow each other meet their queries together, as one cell: a query is sent to, and gets k rows from,
    each of about CELLS cells, and more only where they would pass CELL_VALUES components. The rows of a leaf that is larger are dealt over as
    many groups of bounded size as its count asks for, so one crowded leaf is shared out. Queries of other dimensions meet
    all rows of theirs. Scores are inner products in doubles of the original vectors, summed in one fixed order. Vectors that
    are null, empty or zero or hold a null or non-finite component, and rows without an id, take no part; a query meets
    vectors of its own dimension only. Rows of the query's own id are not its candidates; rows that repeat a query's id are
    that query's as well, with the candidates of each. Ties go to the smaller id. Fewer candidates than k: all that
    were found. An empty table gives no rows.
    """
    spark = vectors.sparkSession
    small_batches(spark, 4096)
    v = F.col("v")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable_vector(v) & F.exists(v, lambda x: x != 0)).withColumn("dim", F.size("v"))
    dims = materialize(rows.groupBy("dim").count(), "dims")
    treed = [(r["dim"], r["count"]) for r in dims.orderBy(F.desc("count"), "dim").limit(TREES).collect()]
    treed = [(d, n) for i, (d, n) in enumerate(treed) if not i or n >= TREE_ROWS]
    # all that meet in pairs of groups: cell (of a dimension), what a query asks of it, what lies in it
    left = right = None
    for dim, n in treed:
        asked, indexed = _in_tree(rows.where(F.col("dim") == dim).drop("dim"), dim, n, k, every, recall, fan, sample_rows)
        left = asked if left is None else left.unionByName(asked)
        right = indexed if right is None else right.unionByName(indexed)
    rest = rows.where(~F.col("dim").isin([d for d, _ in treed])).select("vec_id", "v", "dim", F.lit(-1).alias("cell"))
    if dims.count() > len(treed):
        left_over = rest.where(F.col("vec_id") % every == 0).withColumn("leaves", F.array(F.lit(-1)))
        left, right = (left_over, rest.withColumn("leaf", F.lit(-1))) if left is None else (left.unionByName(left_over), right.unionByName(rest.withColumn("leaf", F.lit(-1))))
    if left is None:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    indexed, asked = materialize(right, "leaves"), materialize(left, "visits")
    key = ["dim", "cell"]
    most = F.lit(TOGETHER)
    for dim, n in treed:
        most = F.when(F.col("dim") == dim, _cell_rows(n, dim)).otherwise(most)
    sizes = indexed.groupBy(*key).count().select(*key, F.ceil(F.col("count") / most).cast("int").alias("vgs"))
    asks = asked.groupBy(*key).agg(F.ceil(F.count("*") / QUERIES_TOGETHER).cast("int").alias("qgs"))
    both = materialize(sizes.join(asks, key), "sizes")
    both = F.broadcast(both) if both.count() <= 100_000 else both
    upto = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    share = lambda n: F.pmod(F.xxhash64("vec_id", "v"), F.col(n)).cast("int")
    left = asked.join(both, key).select(*key, share("qgs").alias("qg"), upto("vgs").alias("vg"), "vec_id", "v", "leaves")
    right = indexed.join(both, key).select(*key, share("vgs").alias("vg"), upto("qgs").alias("qg"), "vec_id", "v", "leaf")

    def meet(key, qs: pd.DataFrame, vs: pd.DataFrame) -> pd.DataFrame:
        if not len(qs) or not len(vs):
            return pd.DataFrame({"query_id": np.empty(0, "int64"), "vec_id": np.empty(0, "int64"), "score": np.empty(0)})
        q, x = (np.stack(t["v"].tolist()).astype(np.float64) for t in (qs, vs))
        ids, v_ids, leaf = qs["vec_id"].to_numpy(), vs["vec_id"].to_numpy(), vs["leaf"].to_numpy()
        eps = 1e-9 * float(np.abs(q).sum(1).max() * np.abs(x).max() + 1e-300)
        best = TopK(ids, k, eps=eps)
        own, at = np.unique(leaf, return_inverse=True)
        wanted = np.zeros((len(q), len(own)), bool)  # whether a query visits a leaf
        for r, a in enumerate(qs["leaves"].tolist()):
            wanted[r] = np.isin(own, a, assume_unique=True)
        order = np.argsort(at, kind="stable")
        for first in range(0, len(order), 1024):
            c = order[first : first + 1024]
            r = np.nonzero(wanted[:, at[c[0]] : at[c[-1]] + 1].any(1))[0]
            scores = np.full((len(r), len(c)), -np.inf)
            ends = np.searchsorted(at[c], np.arange(at[c[0]], at[c[-1]] + 2))
            for one, lo, hi in zip(range(at[c[0]], at[c[-1]] + 1), ends, ends[1:]):
                asking = np.nonzero(wanted[r, one])[0]
                scores[asking, lo:hi] = q[r[asking]] @ x[c[lo:hi]].T
            best.add(r, scores, v_ids[c], lambda i, j, r=r, c=c: np.einsum("ij,ij->i", q[r[i]], x[c[j]]))
        return pd.DataFrame({"query_id": ids[best.q], "vec_id": best.v, "score": best.s})

    by = [*key, "qg", "vg"]
    found = left.groupBy(*by).cogroup(right.groupBy(*by)).applyInPandas(meet, "query_id long, vec_id long, score double")
    first = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def _in_tree(rows: DataFrame, dim: int, total: int, k: int, every: int, recall: float, fan: int, sample_rows: int) -> tuple[DataFrame, DataFrame]:
    """(vec_id, v, dim, cell, leaves) of the queries, a row for each cell that they visit, and (vec_id, v, dim, cell, leaf) of all rows(vec_id, v)."""
    spark = rows.sparkSession
    drawn = draw(rows, sample_rows, "vec_id", "v").toArrow().sort_by("vec_id")
    sample = drawn["v"].combine_chunks().flatten().to_numpy().reshape(-1, dim).astype(np.float64)
    depth = max(1, min(LEVELS, math.ceil(math.log(max(1.0, total / LEAF_ROWS), fan))))
    tree = fit_tree(sample, fan, depth)
    tries = np.arange(len(sample))[:: max(1, len(sample) // CALIBRATION)][:CALIBRATION]
    visits = calibrate(tree, sample, tries, k, recall) if total > k + 1 else tree.leaves
    levels = spark.sparkContext.broadcast(tree.levels)  # fan ** LEVELS + ... centroids

    def to_leaf(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Tree(levels.value, fan)
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(leaf=own.assign(np.stack(pdf["v"].tolist()).astype(np.float64)).astype("int32"))

    indexed = materialize(rows.mapInPandas(to_leaf, "vec_id long, v array<double>, leaf int"), "leaves")
    held = np.zeros(tree.leaves, np.int64)
    for r in indexed.groupBy("leaf").count().collect():  # a row a leaf
        held[r["leaf"]] = r["count"]
    cells = _cells(held, _cell_rows(total, dim))

    def to_visits(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own = Tree(levels.value, fan)
        for pdf in batches:
            for at in range(0, len(pdf), 512):
                some, out = pdf.iloc[at : at + 512], []
                for qid, vec, leaves in zip(some["vec_id"], some["v"], own.visits(np.stack(some["v"].tolist()).astype(np.float64), visits, held, k + 1)):
                    leaves = leaves[held[leaves] > 0]
                    asked, first = np.unique(cells[leaves], return_index=True)
                    out += [(qid, vec, c, part) for c, part in zip(asked.tolist(), np.split(leaves, first[1:]))]
                yield pd.DataFrame(out, columns=["vec_id", "v", "cell", "leaves"]).astype({"cell": "int32"})

    asked = rows.where(F.col("vec_id") % every == 0).mapInPandas(to_visits, "vec_id long, v array<double>, cell int, leaves array<int>")
    indexed = indexed.join(F.broadcast(spark.createDataFrame(list(enumerate(cells.tolist())), "leaf int, cell int")), "leaf")  # a row a leaf
    at = F.lit(dim).alias("dim")
    return asked.select("vec_id", "v", at, "cell", "leaves"), indexed.select("vec_id", "v", at, "cell", "leaf")


def _cell_rows(total: int, dim: int) -> int:
    """Rows that a cell of a tree holds at most."""
    return max(CELL_ROWS, min(-(-total // CELLS), CELL_VALUES // dim))


def _cells(held: np.ndarray, together: int) -> np.ndarray:
    """The cell of each leaf, by the rows that leaves hold: runs of leaves that hold so many rows at most, or one leaf that holds more."""
    cells, cell, n = np.empty(len(held), np.int64), 0, 0
    for leaf, rows in enumerate(held.tolist()):
        if n and n + rows > together:
            cell, n = cell + 1, 0
        cells[leaf], n = cell, n + rows
    return cells
