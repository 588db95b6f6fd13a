"""Merkle trees level by level, inclusion of leaves by joins with the levels, and proofs of batches that a record carries."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions.canonical import Refused, load
from ..session import materialize, shuffled

#: Leaves of a tree that is put together where its leaves are; the levels of larger ones are shuffled one by one.
SMALL = 64


def _up(level: DataFrame, hashed: Callable[[Column], Column], *more: Column) -> DataFrame:
    """tree_id, idx, n, node and more of the level above: a grouping by (tree_id, idx div 2)."""
    at = lambda side: F.max(F.when(F.col("idx") % 2 == side, F.col("node")))
    up = level.groupBy("tree_id", F.floor(F.col("idx") / 2).alias("idx"), F.ceil(F.col("n") / 2).alias("n")).agg(at(0).alias("a"), at(1).alias("b"), *more)
    node = F.when(F.col("b").isNull(), F.col("a")).otherwise(hashed(F.concat(F.lit(H.NODE), F.col("a"), F.col("b"))))
    return up.withColumn("node", node).drop("a", "b")


def _apart(leaves: DataFrame) -> tuple[DataFrame, DataFrame | None]:
    """leaves(tree_id, idx, node) with n, the leaves of their tree: those of trees of at most SMALL leaves, the rows of a tree in one task, and the others, if there are any."""
    leaves = leaves.select("tree_id", F.col("idx").cast("long").alias("idx"), "node")
    counts = leaves.groupBy("tree_id").agg(F.count("*").alias("n"))
    big = materialize(counts.where(F.col("n") > SMALL), "large_trees")
    small = leaves.join(shuffled(counts.where(F.col("n") <= SMALL)), "tree_id")
    return small, leaves.join(shuffled(big), "tree_id") if big.limit(1).count() else None


def _whole(small: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """tree_id, size, nodes of the trees over small(tree_id, idx, node, n), of at most SMALL leaves: nodes is an array of (level, idx, node, n), level 0 first.

    The leaves of a tree lie together, so groupings by (tree_id, idx div 2) shuffle nothing; a finished node goes up with the one above it.
    """
    level = small.withColumn("size", F.col("n"))
    level = level.withColumn("nodes", F.array(F.struct(F.lit(0).alias("level"), "idx", "node", "n")))
    for k in range(1, SMALL.bit_length()):
        up = _up(level, hashed, F.flatten(F.collect_list("nodes")).alias("nodes"), F.max("size").alias("size"))
        own = F.array(F.struct(F.lit(k).alias("level"), "idx", "node", "n"))
        level = up.withColumn("nodes", F.when(F.col("size") > 1 << (k - 1), F.concat("nodes", own)).otherwise(F.col("nodes")))
    return level.select("tree_id", "size", F.array_sort("nodes").alias("nodes"))


def _large(leaves: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """tree_id, level, idx, node, n of the trees over leaves(tree_id, idx, node, n), level by level."""
    level = out = materialize(leaves.select("tree_id", F.lit(0).alias("level"), "idx", "node", "n"), "merkle")
    k = 0
    while level.where("n > 1").limit(1).count():
        k += 1
        level = materialize(_up(level.where("n > 1"), hashed).select("tree_id", F.lit(k).alias("level"), "idx", "node", "n"), "merkle")
        out = out.unionByName(level)
    return out


def levels(leaves: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """tree_id, level, idx, node, n of the Merkle trees over leaves(tree_id, idx, node): level 0 are the leaves, n the nodes of a tree's level.

    Pairs of a level are hashed by `hashed`, an odd last node moves up as it is. Trees of at most SMALL leaves are put together from one shuffle by tree_id. Of larger
    ones a level is a grouping of the one below by (tree_id, idx div 2), so none is held anywhere as a whole; there are log2(largest tree) of them.
    """
    small, large = _apart(leaves)
    out = materialize(_whole(small, hashed).select("tree_id", "nodes"), "merkle").select("tree_id", F.inline("nodes")).select("tree_id", "level", "idx", "node", "n")
    return out if large is None else out.unionByName(_large(large, hashed))


def included_in(claims: DataFrame, leaves: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """included() for the trees over leaves(tree_id, idx, node), with the rows of claims: those of trees of at most SMALL leaves meet their tree in one join and climb there."""
    small, large = _apart(leaves)
    if large is not None:
        large = _large(large, hashed)
        others = materialize(large.where("level = 0").select("tree_id").distinct(), "large_trees")
        far = included(claims.join(shuffled(others), "tree_id", "left_semi"), large, hashed)
    at = claims.withColumn("claimed", F.col("node")).withColumn("place", F.col("idx").cast("long"))
    at = at if large is None else at.join(shuffled(others), "tree_id", "left_anti")
    near = at.join(shuffled(_whole(small, hashed)), "tree_id", "left")
    near = near.withColumn("inside", F.coalesce((F.col("place") >= 0) & (F.col("place") < F.col("size")), F.lit(False))).withColumn("before", F.lit(0).cast("long")).withColumn("width", F.col("size"))
    for _ in range(1, SMALL.bit_length()):
        beside = F.col("place").bitwiseXOR(F.lit(1).cast("long"))
        near = near.withColumn("other", F.when((F.col("width") > 1) & F.col("inside") & (beside < F.col("width")), F.get("nodes", (F.col("before") + beside).cast("int"))["node"]))
        pair = F.when(F.col("place") % 2 == 1, F.concat("other", "node")).otherwise(F.concat("node", "other"))
        near = near.withColumn("node", F.when(F.col("other").isNull(), F.col("node")).otherwise(hashed(F.concat(F.lit(H.NODE), pair))))
        near = near.withColumn("before", F.col("before") + F.when(F.col("width") > 1, F.col("width")).otherwise(0)).withColumn("width", F.ceil(F.col("width") / 2)).withColumn("place", F.floor(F.col("place") / 2))
    same = F.coalesce(F.col("inside") & (F.col("node") == F.element_at("nodes", -1)["node"]), F.lit(False))
    near = near.select("tree_id", "idx", F.col("claimed").alias("node"), same.alias("included"))
    return near if large is None else near.unionByName(far.select("tree_id", "idx", "node", "included"))


def roots(nodes: DataFrame) -> DataFrame:
    """tree_id, root of levels()."""
    return nodes.where("n = 1").select("tree_id", F.col("node").alias("root"))


def included(claims: DataFrame, nodes: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """claims(tree_id, idx, node) with included: whether the node, at that place, leads to the root of its tree by the siblings in levels().

    A join for each level; a place that its tree does not have is not included.
    """
    sizes = nodes.where("level = 0").select("tree_id", "n").distinct()
    at = claims.withColumn("claimed", F.col("node")).withColumn("place", F.col("idx").cast("long")).join(sizes, "tree_id", "left")
    at = at.withColumn("inside", F.coalesce((F.col("place") >= 0) & (F.col("place") < F.col("n")), F.lit(False))).drop("n")
    top = nodes.agg(F.max("level")).first()[0] or 0
    for k in range(top):
        other = nodes.where(F.col("level") == k).select("tree_id", F.col("idx").bitwiseXOR(F.lit(1).cast("long")).alias("place"), F.col("node").alias("other"))
        at = at.join(other, ["tree_id", "place"], "left")
        pair = F.when(F.col("place") % 2 == 1, F.concat("other", "node")).otherwise(F.concat("node", "other"))
        node = F.when(F.col("other").isNull(), F.col("node")).otherwise(hashed(F.concat(F.lit(H.NODE), pair)))
        at = materialize(at.withColumn("node", node).withColumn("place", F.floor(F.col("place") / 2)).drop("other"), "climbing")
    same = F.coalesce(F.col("inside") & (F.col("node") == F.col("root")), F.lit(False))
    return at.join(roots(nodes), "tree_id", "left").select("tree_id", "idx", F.col("claimed").alias("node"), same.alias("included"))


def proofs(nodes: DataFrame) -> DataFrame:
    """tree_id, idx, size, proof: for each leaf its siblings from the leaf up. A proof is as long as its tree is deep."""
    leaf = nodes.where("level = 0").select("tree_id", F.col("idx").alias("leaf"), F.col("n").alias("size"))
    top = nodes.agg(F.max("level")).first()[0] or 0
    steps = leaf.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(max(0, top - 1)))))
    steps = steps.withColumn("idx", F.expr("shiftright(leaf, level) ^ 1L"))
    found = steps.join(nodes.select("tree_id", "level", "idx", "node"), ["tree_id", "level", "idx"])
    lists = found.groupBy("tree_id", "leaf").agg(F.array_sort(F.collect_list(F.struct("level", "node"))).alias("all"))
    lists = lists.select("tree_id", "leaf", F.transform("all", lambda x: x["node"]).alias("proof"))
    out = leaf.join(lists, ["tree_id", "leaf"], "left")
    return out.select("tree_id", F.col("leaf").alias("idx"), "size", F.coalesce("proof", F.array().cast("array<binary>")).alias("proof"))


def _hex(text: str) -> bytes:
    try:
        return bytes.fromhex(text.removeprefix("0x"))
    except ValueError:
        raise Refused("MERKLE_HEX_DECODE_FAILED") from None


def _lower(text: str) -> str:
    if text.removeprefix("0x").lower() != text.removeprefix("0x"):
        raise Refused("MERKLE_HEX_NOT_LOWERCASE")
    return text


def _root(text: str) -> bytes:
    link = _hex(_lower(text))
    if H.link_error(link):
        raise Refused("MERKLE_ROOT_BAD_MULTIHASH")
    if link[:2] != H.PREFIX["sha3"]:
        raise Refused("MERKLE_ROOT_BAD_CODEC")
    return link[2:]


def proof_fault(payload: dict, target: str) -> str | None:
    """Why a payload does not prove that the link `target` (hex) is in its batch, the first failing rule; None if it does."""

    def member(name: str, code: str, fits: Callable[[object], bool]):
        if not fits(payload.get(name)):
            raise Refused(code)
        return payload[name]

    text = lambda x: isinstance(x, str)
    whole = lambda x: isinstance(x, int) and not isinstance(x, bool) and 0 <= x < 2**64
    try:
        root = member("merkle_root", "MERKLE_ROOT_MISSING", text)
        size = member("batch_tree_size", "BATCH_TREE_SIZE_MISSING", whole)
        index = member("batch_leaf_index", "BATCH_LEAF_INDEX_MISSING", whole)
        proof = [x for x in member("merkle_proof", "MERKLE_PROOF_MISSING", lambda x: isinstance(x, list)) if isinstance(x, str)]
        if not size:
            raise Refused("BATCH_TREE_SIZE_ZERO")
        nonce = member("shielding_nonce", "SHIELDING_NONCE_MISSING", text)
        leaf = H.batch_leaf(_hex(target), _hex(_lower(nonce)))
        if size == 1:
            return None if leaf == _root(root) else "MERKLE_ROOT_MISMATCH"
        if index >= size:
            raise Refused("MERKLE_LEAF_INDEX_OUT_OF_BOUNDS")
        top = _root(root)
        siblings = [_hex(x) for x in [_lower(x) for x in proof]]
        return None if H.verify_inclusion(leaf, index, size, siblings, top) else "MERKLE_INCLUSION_FAILED"
    except Refused as e:
        return str(e)


def proof_faults(rows: DataFrame) -> DataFrame:
    """rows(payload, target) with code: proof_fault() of each payload (JSON text) for the link `target` (hex text), null for a good proof.

    A payload that is no JSON object, or null, has no members.
    """

    @F.pandas_udf("string")
    def code(payloads: pd.Series, targets: pd.Series) -> pd.Series:
        out = []
        for payload, target in zip(payloads, targets):
            try:
                value = load(payload) if payload is not None else {}
            except Refused:
                value = {}
            out.append(proof_fault(value if isinstance(value, dict) else {}, target or ""))
        return pd.Series(out, dtype=object)

    return rows.withColumn("code", code.asNondeterministic()("payload", "target"))  # else a filter on it is a second Python step, with workers of its own


def round_anchors(anchors: DataFrame, artifacts: DataFrame, hashed: Callable[[Column], Column]) -> DataFrame:
    """turn_id, n_artifacts, root, fault of anchors(turn_id, artifact_count, leaf_hashes as hex texts, merkle_root as hex text): whether each commits to the artifacts of its turn.

    artifacts(turn_id, seq, link as bytes) are committed to in the order of seq, link: leaf = hashed(0x00 and link), pairs as in levels(). fault is the first that holds:
    "empty" (the turn has no artifacts), "artifact_count", "leaf_hashes" (another link, or another order), "merkle_root", else null. Turns without an
    anchor are left out. A turn's artifacts are ranked by a window and gathered for the comparison of the list, which the anchor holds as one value.
    """
    from pyspark.sql import Window

    place = Window.partitionBy("turn_id").orderBy("seq", "link")
    a = artifacts.join(anchors.select("turn_id").distinct(), "turn_id", "left_semi").withColumn("idx", F.row_number().over(place) - 1)
    a = materialize(a.select("turn_id", "idx", "link"), "artifacts")
    leaf = hashed(F.concat(F.lit(H.LEAF), F.col("link")))
    top = roots(levels(a.select(F.col("turn_id").alias("tree_id"), "idx", leaf.alias("node")), hashed)).withColumnRenamed("tree_id", "turn_id")
    lists = a.groupBy("turn_id").agg(F.count("*").alias("n"), F.array_sort(F.collect_list(F.struct("idx", H.render_hex(F.col("link")).alias("x")))).alias("all"))
    lists = lists.select("turn_id", "n", F.transform("all", lambda s: s["x"]).alias("made"))
    rows = anchors.join(lists, "turn_id", "left").join(top, "turn_id", "left")
    same = lambda x, y: F.coalesce(x == y, F.lit(False))
    fault = (
        F.when(F.col("n").isNull(), "empty")
        .when(~same(F.col("artifact_count"), F.col("n")), "artifact_count")
        .when(~same(F.col("leaf_hashes"), F.col("made")), "leaf_hashes")
        .when(~same(F.col("merkle_root"), H.render_hex(F.col("root"))), "merkle_root")
    )
    return rows.select("turn_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_artifacts"), "root", fault.alias("fault"))
