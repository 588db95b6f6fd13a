"""N-gram Jaccard join (operator 8): chosen-path join on word shingles, with exact verification in bounded blocks."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches, texts_of

#: Min-wise samples of a set's tokens from which paths choose, and those that one node tries.
SAMPLES, TRIED = 48, 2
#: Sets of a bucket that one task compares with one another.
BLOCK = 512
#: The longest list of ids that is broadcast.
BROADCAST_ROWS = 1_000_000

_MIX = np.uint64(0x9E3779B97F4A7C15)
_words: dict[str, int] = {}


def _mixed(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str, n: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the n-word shingles of text: words are lower-cased and parted by white space.

    A text of fewer words is one shingle of all its words; a text without words has none.
    """
    import xxhash

    words = text.lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_words) > 200_000:
        _words.clear()
    for w in {w for w in words if w not in _words}:
        _words[w] = xxhash.xxh3_64_intdigest(w.encode("utf-8", "surrogatepass"))
    h = np.fromiter(map(_words.__getitem__, words), np.uint64, len(words))
    n = min(n, len(h))
    with np.errstate(over="ignore"):
        total = np.zeros(len(h) - n + 1, np.uint64)
        for i in range(n):
            total = _mixed(total * _MIX + h[i : len(h) - n + 1 + i])
    return np.unique(total)


def _sampled(sets: np.ndarray) -> np.ndarray:
    """The token each of SAMPLES hash functions ranks lowest, as 32-bit values."""
    seeds = _mixed(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _MIX)
    out = np.empty(SAMPLES, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(0, SAMPLES, 8):
            out[i : i + 8] = ((sets[None, :] ^ seeds[i : i + 8, None]) * (seeds[i : i + 8, None] | np.uint64(1))).min(1)
        return (_mixed(out) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _spanning(a: np.ndarray, b: np.ndarray, ids: np.ndarray) -> list[tuple[int, int]]:
    """Links (smaller root, id) that join what the links a[i]-b[i] join: one for each id at most."""
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in zip(ids[a].tolist(), ids[b].tolist()):
        x, y = find(x), find(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    return [(r, x) for x in list(root) if (r := find(x)) != x]


def _compare(x: pd.DataFrame, y: pd.DataFrame | None, bucket: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Positions (in x, in y) of the pairs of sets that reach the threshold and meet first in this bucket; y None: within x.

    Common shingles are counted exactly, by products of the blocks' incidence matrices in strips of bounded width.
    """
    own = y is None
    y = x if own else y
    xs, ys = ([np.frombuffer(s, np.uint64) for s in t["shingles"]] for t in (x, y))
    nx, ny = np.array([len(s) for s in xs]), np.array([len(s) for s in ys])
    flat = np.concatenate([*xs, *ys])
    _, code = np.unique(flat, return_inverse=True)
    width = int(code.max()) + 1 if len(code) else 0
    common = np.zeros((len(xs), len(ys)), np.int32)
    cx, cy = code[: nx.sum()], code[nx.sum() :]
    rx, ry = np.repeat(np.arange(len(xs)), nx), np.repeat(np.arange(len(ys)), ny)
    for at in range(0, width, 4096):  # dense strips of the incidence matrices
        a, b = np.zeros((len(xs), min(4096, width - at)), np.float32), np.zeros((len(ys), min(4096, width - at)), np.float32)
        m = (cx >= at) & (cx < at + 4096)
        a[rx[m], cx[m] - at] = 1
        m = (cy >= at) & (cy < at + 4096)
        b[ry[m], cy[m] - at] = 1
        common += (a @ b.T).astype(np.int32)
    hit = common >= threshold * (nx[:, None] + ny[None, :] - common) - 1e-9
    if own:
        hit &= np.triu(np.ones_like(hit), 1)
    i, j = np.nonzero(hit)
    xb, yb = x["buckets"].tolist(), y["buckets"].tolist()
    first = np.fromiter((min(set(xb[p]).intersection(yb[q])) == bucket for p, q in zip(i.tolist(), j.tolist())), bool, len(i))
    return i[first], j[first]


def classes_of(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, root: the smallest node that each of nodes(node) is joined to by edges(a, b), by min-label hooking and pointer jumping.

    Each round is written to the shared folder; the number of rounds grows with the logarithm of the longest path. Labels only fall, so the rounds end, and
    they end when none fell.
    """
    both = materialize(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = materialize(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).select(F.col("a").alias("node"), "root"), "labels")
    while True:
        own, other = labels.alias("l"), labels.alias("o")
        # hook: what a neighbour's label offers goes to the node and to the node's root
        offered = both.join(own, F.col("b") == F.col("l.node")).groupBy("a").agg(F.min("l.root").alias("offer"))
        met = labels.join(offered, F.col("node") == F.col("a")).select("node", "root", "offer")
        to_root = met.groupBy("root").agg(F.min("offer").alias("offer")).select(F.col("root").alias("node"), "offer")
        raised = met.select("node", F.least("root", "offer").alias("root")).unionByName(to_root.select("node", F.col("offer").alias("root")))
        hooked = raised.groupBy("node").agg(F.min("root").alias("root"))
        jumped = hooked.alias("h").join(hooked.alias("o"), F.col("h.root") == F.col("o.node"), "left")
        new = jumped.select(F.col("h.node").alias("node"), F.least(F.col("h.root"), F.coalesce(F.col("o.root"), F.col("h.root"))).alias("root"))
        new = materialize(new, "labels")
        moved = new.join(labels.withColumnRenamed("root", "was"), "node").where(F.col("root") != F.col("was")).limit(1).count()
        labels = new
        if not moved:
            return nodes.join(labels, "node", "left").select("node", F.coalesce("root", "node").alias("root"))


def _paths(sets: DataFrame, runs: int, small: int, depth: int, stay: float) -> DataFrame:
    """All runs of the chosen-path recursion, side by side from roots of their own: bucket, set_id, size of the buckets they end in.

    A node is a bucket with its parent's path; it tries TRIED of the sampled tokens, picked by its hash, and a set follows each of
    them into the bucket of the token that it holds. Buckets of one set end at once; those of up to `small` sets end to be
    compared; larger ones are split again, up to `depth` times or until a split leaves them whole (near copies of one another,
    which no token tells apart).
    """
    roots = F.explode(F.sequence(F.lit(1), F.lit(runs)))
    at = sets.select("set_id", roots.alias("run"), "sample").select("set_id", F.xxhash64("run").alias("node"), F.lit(1 << 62).alias("size"), "sample")
    ends = None
    for level in range(depth):
        tried = F.explode(F.sequence(F.lit(0), F.lit(TRIED - 1))).alias("t")
        # two different places for every node
        first = F.pmod(F.xxhash64("node", F.lit("first")), F.lit(SAMPLES))
        place = F.pmod(first + F.col("t") * (1 + F.pmod(F.xxhash64("node", F.lit("step")), F.lit(SAMPLES - 1))), F.lit(SAMPLES))
        down = at.select("set_id", "sample", "node", "size", tried)
        down = down.select("set_id", F.col("size").alias("parent"), F.xxhash64("node", "t", F.get("sample", place.cast("int"))).alias("node"))
        counts = materialize(down.groupBy("node").agg(F.count("*").alias("size")).where(F.col("size") > 1), "counts")
        down = down.join(counts, "node")
        over = (F.col("size") <= small) | (F.col("size") > F.col("parent") * F.lit(stay)) | F.lit(level == depth - 1)
        down = materialize(down.select("set_id", "node", "size", over.alias("over")), "paths")
        done = down.where("over").select(F.col("node").alias("bucket"), "set_id", "size")
        ends = done if ends is None else ends.unionByName(done)
        at = down.where("not over").select("set_id", "node", "size")
        left = at.count()
        if not left:
            break
        at = sets.join(F.broadcast(at) if left <= BROADCAST_ROWS // 4 else at, "set_id")
    return ends


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """docs without all but one row of each class of near copies: the one of the smallest id stays, whole.

    Rows with a null id stay. Of rows that repeat an id and its text one stays; rows that repeat an id with another text are judged each.
    """
    found = jaccard_join(docs, id_col=id_col, text_col=text_col, hashed=True, **options)
    gone = materialize(found.where(F.col("doc_id") != F.col("class_id")).select(F.col("doc_id").alias("gone_id"), F.col("text_hash").alias("gone_hash")).distinct(), "gone")
    few = gone.count() <= BROADCAST_ROWS
    own = F.col(id_col).cast("long")
    same = (own == F.col("gone_id")) & (F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))) == F.col("gone_hash"))
    kept = docs.join(F.broadcast(gone) if few else gone, same, "left_anti")
    again = materialize(docs.groupBy(own.alias("again_id")).agg(F.count("*").alias("n")).where("n > 1 and again_id is not null").select("again_id"), "again")
    if not again.limit(1).count():
        return kept
    twice = kept.join(again, own == F.col("again_id"), "left_semi").dropDuplicates([id_col, text_col])
    return kept.join(again, own == F.col("again_id"), "left_anti").unionByName(twice)


def jaccard_join(
    docs: DataFrame, threshold: float = 0.8, n: int = 5, recall: float = 0.9999, small: int = 32, depth: int = 4, stay: float = 0.7, id_col: str = "doc_id", text_col: str = "text",
    hashed: bool = False,
) -> DataFrame:
    """doc_id, class_id, n_links, copies: every row with the class it belongs to and the number of rows it is linked to; text_hash too if hashed.

    Rows are linked if the Jaccard similarity of their sets of n-word shingles is `threshold` or more; a class is what links
    join, named by its smallest doc_id. Rows of equal sets are copies of one another: they are linked, are one set in the join
    and are never expanded into pairs. copies is the number of rows of the same set, n_links counts those others as well.
    Null and empty texts have no shingles: each is a class of its own without links, as is a row with a null id (class null).
    Texts of fewer than n words are one shingle. An empty table gives no rows; other columns are ignored.

    Each run follows TRIED tokens a node; a pair at the threshold shares a token with probability 0.8 and so still meets after
    four splits with probability 0.93. There are as many runs as independent ones need for `recall` of such pairs: 4. All draw
    from one set of SAMPLES tokens, so they are not quite independent: of 4,000 simulated pairs at 0.8 one was missed, of as
    many at 0.85 none. Buckets are compared exactly, larger ones as pairs of blocks of BLOCK sets dealt over tasks. Of a pair of blocks come counts for each set and a spanning forest of
    its links, never the pairs; a pair that meets in several buckets counts in the first of them.
    """
    spark = docs.sparkSession
    small_batches(spark)
    base = texts_of(docs, id_col, text_col)

    def key_of(s: np.ndarray) -> tuple[int, int]:
        import xxhash

        k = xxhash.xxh3_128_digest(s.tobytes())
        return int.from_bytes(k[:8], "little", signed=True), int.from_bytes(k[8:], "little", signed=True)

    def to_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shingles(t, n) for t in pdf["text"].tolist()]
            keys = [key_of(s) for s in found]
            yield pd.DataFrame({
                "doc_id": pdf["doc_id"],
                "text_hash": pdf["text_hash"],
                "k1": np.array([k for k, _ in keys], "int64"),
                "k2": np.array([k for _, k in keys], "int64"),
                "n": np.array([len(s) for s in found], "int64"),
                "sample": [_sampled(s).tolist() if len(s) else None for s in found],
            })

    met_once = 1.0
    for _ in range(depth):
        met_once = 1 - (1 - threshold * met_once) ** TRIED
    runs = max(1, math.ceil(math.log(1 - recall) / math.log(1 - met_once)))
    keyed = materialize(base.withColumn("text_hash", F.xxhash64("text")).mapInPandas(to_sets, "doc_id long, text_hash long, k1 long, k2 long, n long, sample array<int>"), "sets")
    full = keyed.where((F.col("n") > 0) & F.col("doc_id").isNotNull())
    copies = full.groupBy("k1", "k2").agg(F.min("doc_id").alias("first"), F.count("*").alias("copies"))
    copies = materialize(copies.withColumn("set_id", F.monotonically_increasing_id()), "classes")
    # The sample of a set comes from its first row.
    of_set = keyed.select("k1", "k2", F.col("doc_id").alias("first"), "sample").join(copies, ["k1", "k2", "first"])
    sets = materialize(of_set.select("set_id", "sample").dropDuplicates(["set_id"]), "samples")
    ends = _paths(sets, runs, small, depth, stay)
    # Buckets of up to `small` sets are compared once for each distinct membership.
    few = ends.where(F.col("size") <= small).groupBy("bucket").agg(F.array_sort(F.collect_set("set_id")).alias("members"))
    few = few.where(F.size("members") > 1).groupBy("members").agg(F.min("bucket").alias("bucket"))
    few = few.select("bucket", F.explode("members").alias("set_id"))
    seen = few.join(sets, "set_id").groupBy("bucket").agg(F.collect_list(F.struct("set_id", "sample")).alias("members"))

    def likely(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """The members of each bucket that agree with another one on enough samples for the threshold to be possible."""
        for pdf in batches:
            at, ids = [], []
            for bucket, members in zip(pdf["bucket"].tolist(), pdf["members"].tolist()):
                x = np.array([m["sample"] for m in members])
                agree = (x[:, None, :] == x[None, :, :]).sum(2)
                np.fill_diagonal(agree, 0)
                kept = [members[i]["set_id"] for i in np.nonzero(agree.max(1) >= least)[0]]
                at += [bucket] * len(kept)
                ids += kept
            yield pd.DataFrame({"bucket": np.array(at, "int64"), "set_id": np.array(ids, "int64")})

    # five standard deviations below what a pair at the threshold agrees on
    least = max(1, int(SAMPLES * threshold - 5 * (SAMPLES * threshold * (1 - threshold)) ** 0.5))
    few = seen.mapInPandas(likely, "bucket long, set_id long").withColumn("blocks", F.lit(1))
    large = ends.where(F.col("size") > small).select("bucket", "set_id", F.ceil(F.col("size") / BLOCK).cast("int").alias("blocks"))
    met = materialize(few.unionByName(large).distinct(), "met")
    own = met.groupBy("set_id").agg(F.collect_list(F.struct("bucket", "blocks")).alias("places"))  # runs * TRIED ** depth at most

    def to_shingles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            found = [shingles(t, n) for t in pdf["text"].tolist()]
            keys = [key_of(s) for s in found]
            yield pd.DataFrame({"k1": np.array([k for k, _ in keys], "int64"), "k2": np.array([k for _, k in keys], "int64"), "shingles": [s.tobytes() for s in found]})

    # Only sets that met another are read again; their list is broadcast if it was counted to be short.
    wanted = materialize(copies.join(own, "set_id"), "wanted")
    listed = wanted.select(F.col("first").alias("wanted_id")).distinct()
    few_wanted = wanted.count() <= BROADCAST_ROWS // 10 and met.count() <= BROADCAST_ROWS // 2  # sets, and their places: some 24 bytes each
    if few_wanted:
        listed, wanted = F.broadcast(listed), F.broadcast(wanted)
    again = base.join(listed, F.col("doc_id") == F.col("wanted_id"), "left_semi").mapInPandas(to_shingles, "k1 long, k2 long, shingles binary")
    again = again.join(wanted, ["k1", "k2"]).select("set_id", F.col("places.bucket").alias("buckets"), "copies", "shingles", F.explode("places").alias("place"))
    loads = again.select("set_id", "buckets", "copies", "shingles", "place.bucket", "place.blocks")
    block = F.pmod(F.xxhash64("set_id", "bucket"), F.col("blocks")).cast("int")
    loads = loads.withColumn("block", block)
    # Block b meets the blocks from b on: a set is sent to every pair of blocks that its own block is in.
    partner = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    loads = loads.withColumn("other", partner).select(
        "bucket", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "set_id", "buckets", "copies", "shingles"
    )

    def verify(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        bucket, lo, hi = key
        pdf = pdf.drop_duplicates("set_id")  # rows that repeat an id and its text
        if lo == hi:
            x = pdf.reset_index(drop=True)
            i, j = _compare(x, None, bucket, threshold)
            ids = x["set_id"].to_numpy()
        else:
            x, y = (pdf[pdf["block"] == b].reset_index(drop=True) for b in (lo, hi))
            i, j = _compare(x, y, bucket, threshold) if len(x) and len(y) else (np.empty(0, int), np.empty(0, int))
            ids = np.concatenate([x["set_id"].to_numpy(), y["set_id"].to_numpy()])
            j = j + len(x)
        weight = pdf.set_index("set_id")["copies"].reindex(ids).to_numpy() if len(ids) else ids
        links = np.bincount(i, weight[j], len(ids)) + np.bincount(j, weight[i], len(ids)) if len(ids) else np.empty(0)
        forest = _spanning(i, j, ids)
        out = [(int(s), None, int(c)) for s, c in zip(ids, links) if c] + [(x, r, 0) for r, x in forest]
        return pd.DataFrame(out, columns=["a", "b", "n"]).astype({"a": "int64", "b": "Int64", "n": "int64"})

    found = materialize(loads.groupBy("bucket", "lo", "hi").applyInPandas(verify, "a long, b long, n long"), "links")
    counts = found.groupBy("a").agg(F.sum("n").alias("others"))
    roots = classes_of(found.where(F.col("b").isNotNull()).select("a", "b"), copies.select(F.col("set_id").alias("node")))
    about = copies.join(roots, F.col("set_id") == F.col("node")).join(counts, F.col("set_id") == F.col("a"), "left")
    about = materialize(about, "about")
    names = about.groupBy(F.col("root").alias("of")).agg(F.min("first").alias("class"))
    about = about.join(names, F.col("root") == F.col("of"))
    about = about.select(F.col("k1").alias("j1"), F.col("k2").alias("j2"), F.col("class"), "copies", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("links"))
    same = (F.col("k1") == F.col("j1")) & (F.col("k2") == F.col("j2")) & (F.col("n") > 0) & F.col("doc_id").isNotNull()
    return keyed.join(about, same, "left").select(
        "doc_id",
        F.coalesce("class", "doc_id").alias("class_id"),
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce("copies", F.lit(1)).cast("long").alias("copies"),
        *(["text_hash"] if hashed else []),
    )
