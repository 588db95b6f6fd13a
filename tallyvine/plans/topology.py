"""Chains, branches, tips and orders of revisions: joins and pointer doubling over all trees at once.

Every function takes revisions(tree_id, link, prev, ts, kind, ...): one row a revision, prev null for the first of a tree.
Keys are (tree_id, link); links compare by their bytes. Rows with a null link take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from ..session import materialize, shuffled


def parents(rev: DataFrame) -> DataFrame:
    """The (tree_id, parent, child) edges of the forest."""
    return rev.where("prev is not null").select("tree_id", F.col("prev").alias("parent"), F.col("link").alias("child"))


def genesis(rev: DataFrame) -> DataFrame:
    """Objects and anchors without a parent; templates and signatures never start a tree."""
    return rev.where(F.col("kind").isin("object", "anchor") & F.col("prev").isNull())


def missing_parents(rev: DataFrame) -> DataFrame:
    """Revisions whose parent is not in their tree."""
    keys = rev.select("tree_id", F.col("link").alias("prev"))
    return rev.where("prev is not null").join(shuffled(keys), ["tree_id", "prev"], "left_anti")


def timestamp_violations(rev: DataFrame) -> DataFrame:
    """(tree_id, link, ts, parent_ts) of children older than their parent; equal times are allowed, missing parents ignored."""
    own = rev.where("prev is not null").select("tree_id", "link", "prev", "ts")
    up = rev.select("tree_id", F.col("link").alias("prev"), F.col("ts").alias("parent_ts"))
    return own.join(shuffled(up), ["tree_id", "prev"]).where(F.col("ts") < F.col("parent_ts")).select("tree_id", "link", "ts", "parent_ts")


def children(rev: DataFrame) -> DataFrame:
    """(tree_id, link, n_children, first_child) of revisions that are somebody's parent; first_child is the lowest link."""
    return parents(rev).groupBy("tree_id", F.col("parent").alias("link")).agg(F.count("*").alias("n_children"), F.min("child").alias("first_child"))


def tips(rev: DataFrame) -> DataFrame:
    """Revisions that nobody in their tree names as parent."""
    named = rev.where("prev is not null").select("tree_id", F.col("prev").alias("link")).distinct()
    return rev.join(named, ["tree_id", "link"], "left_anti")


def last_revision(rev: DataFrame) -> DataFrame:
    """(tree_id, link): of the revisions that nobody names as parent and that start no tree, the lowest link, other kinds before templates.

    A tree that has none of these has no last revision, unless its one revision is all it has and starts it.
    """
    rev = rev.where("link is not null")
    first = genesis(rev).select("tree_id", "link").distinct().withColumn("starts", F.lit(True))
    ends = tips(rev).join(first, ["tree_id", "link"], "left").where("starts is null")
    order = F.struct((F.col("kind") == "template").cast("int").alias("t"), F.col("link").alias("link"))
    found = ends.groupBy("tree_id").agg(F.min(order).alias("best")).select("tree_id", F.col("best.link").alias("link"))
    sizes = rev.groupBy("tree_id").agg(F.countDistinct("link").alias("n")).where("n = 1")
    return found.unionByName(first.join(sizes, "tree_id", "left_semi").select("tree_id", "link"))


def content_tip(rev: DataFrame) -> DataFrame:
    """(tree_id, link): the lowest tip that is an object, else the lowest that is a template; other tips carry no content."""
    cand = tips(rev).where(F.col("kind").isin("object", "template"))
    order = F.struct((F.col("kind") != "object").cast("int").alias("b"), F.col("link").alias("link"))
    return cand.groupBy("tree_id").agg(F.min(order).alias("best")).select("tree_id", F.col("best.link").alias("link"))


def signatures_for(rev: DataFrame) -> DataFrame:
    """(tree_id, link, signature) for every revision that is signed."""
    return rev.where("kind = 'signature' and prev is not null").select("tree_id", F.col("prev").alias("link"), F.col("link").alias("signature"))


def cycle_nodes(rev: DataFrame) -> DataFrame:
    """(tree_id, link) of revisions on or leading into a cycle of parents.

    A revision has one parent at most, so following it twice as far each round ends at a root within log2(longest chain)
    rounds; what still points somewhere when no revision advances to a root any more never reaches one.
    """
    at = rev.join(rev.select("tree_id", F.col("link").alias("prev"), F.lit(1).alias("has")).distinct().hint("merge"), ["tree_id", "prev"], "left")
    at = materialize(at.select("tree_id", "link", F.when(F.col("has") == 1, F.col("prev")).alias("up")), "pointers")
    moving, steps, longest = at.where("up is not null"), 0, max(1, at.count())
    while (1 << steps) <= longest and moving.limit(1).count():
        # an inner join on what still points somewhere drops what came to a root
        far = moving.select("tree_id", F.col("link").alias("up"), F.col("up").alias("next"))
        moving, steps = materialize(moving.join(shuffled(far), ["tree_id", "up"]).select("tree_id", "link", F.col("next").alias("up")), "pointers"), steps + 1
    return moving.select("tree_id", "link")


def _prefix(rows: DataFrame, col: str = "link") -> Column:
    """What parts the links of a tree into at most 256 ranges: the first byte, or two hex digits."""
    return F.substring(col, 1, 1 if isinstance(rows.schema[col].dataType, BinaryType) else 2)


def ranked(rows: DataFrame, *places: str) -> DataFrame:
    """rows(tree_id, places, link) with ord (from 0): their rank in their tree by the places (whole numbers), then by link.

    No tree is ranked in one task: rows are ranked in cells of one place and one range of links, cells are summed up in blocks of places.
    """
    cells = rows.withColumn("cell", _prefix(rows)).withColumn("block", F.floor(F.col(places[0]) / 1024))
    counts = materialize(cells.groupBy("tree_id", "block", *places, "cell").agg(F.count("*").alias("n")), "cells")
    blocks = counts.groupBy("tree_id", "block").agg(F.sum("n").alias("n"))
    upto = Window.partitionBy("tree_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("tree_id", "block", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("before_block"))
    within = Window.partitionBy("tree_id", "block").orderBy(*places, "cell").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("before", F.coalesce(F.sum("n").over(within), F.lit(0))).drop("n").join(blocks, ["tree_id", "block"])
    own = Window.partitionBy("tree_id", "block", *places, "cell").orderBy("link")
    out = cells.withColumn("own", F.row_number().over(own)).join(counts, ["tree_id", "block", *places, "cell"])
    return out.withColumn("ord", (F.col("before_block") + F.col("before") + F.col("own") - 1).cast("long")).drop("cell", "block", "own", "before", "before_block")


def chain(rev: DataFrame) -> DataFrame:
    """(tree_id, link, pos): each tree's main chain from its first revision, stepping to the lowest child every time.

    Only a parent's lowest child stays on the chain, so the chain edges are a set of paths; ranks in them come from
    pointer doubling, log2(longest chain) joins instead of one a step. Of several first revisions the lowest link starts. A tree
    without a first revision has all its revisions on the chain, in the order of their links.
    """
    rev = rev.where("link is not null")
    start = genesis(rev).groupBy("tree_id").agg(F.min("link").alias("start"))
    nxt = children(rev).select("tree_id", F.col("link").alias("up"), F.col("first_child").alias("link"))
    nodes = rev.select("tree_id", "link").distinct().join(nxt, ["tree_id", "link"], "left")
    at = materialize(nodes.select("tree_id", "link", "up", F.when(F.col("up").isNotNull(), 1).otherwise(0).cast("long").alias("pos"), F.coalesce("up", "link").alias("root")), "ranks")
    done, moving = at.where("up is null"), at.where("up is not null")
    total, reach = max(1, at.count()), 1
    while reach <= total and moving.limit(1).count():
        # those at their root are written once; what still moves points twice as far each round
        far = done.unionByName(moving).select("tree_id", F.col("link").alias("up"), F.col("up").alias("up2"), F.col("pos").alias("pos2"), F.col("root").alias("root2"))
        met = moving.join(shuffled(far), ["tree_id", "up"])
        moved = materialize(met.select("tree_id", "link", F.col("up2").alias("up"), (F.col("pos") + F.col("pos2")).alias("pos"), F.col("root2").alias("root")), "ranks")
        done, moving = done.unionByName(moved.where("up is null")), moved.where("up is not null")
        reach *= 2
    walked = done.join(start, [done["tree_id"] == start["tree_id"], done["root"] == start["start"]]).select(done["tree_id"], "link", "pos")
    rest = rev.select("tree_id", "link", F.lit(0).alias("place")).distinct().join(start, "tree_id", "left_anti")
    return walked.unionByName(ranked(rest, "place").select("tree_id", "link", F.col("ord").alias("pos")))


def branches(rev: DataFrame) -> DataFrame:
    """(tree_id, pos, link, branches): for each place of the chain the sorted links of its children off the chain (signatures and anchors always)."""
    main = chain(rev)
    kids = rev.where("prev is not null").select("tree_id", F.col("prev").alias("link"), F.col("link").alias("child"), "kind")
    on = main.select("tree_id", F.col("link").alias("child"), F.lit(1).alias("on_chain"))
    off = kids.join(on, ["tree_id", "child"], "left").where(F.col("on_chain").isNull() | F.col("kind").isin("signature", "anchor"))
    lists = off.groupBy("tree_id", "link").agg(F.array_sort(F.collect_list("child")).alias("branches"))
    return main.join(lists, ["tree_id", "link"], "left").select("tree_id", "pos", "link", F.coalesce("branches", F.array().cast("array<string>")).alias("branches"))


def dag_order(rev: DataFrame) -> DataFrame:
    """(tree_id, link, edge_type, depth, ord): the chain, each place followed by its branches in link order, then the other revisions."""
    main = materialize(chain(rev), "chain")
    on = main.select("tree_id", "link", F.col("pos"))
    up = main.select("tree_id", F.col("link").alias("prev"), F.col("pos").alias("parent_pos"))
    rows = rev.select("tree_id", "link", "prev").join(on, ["tree_id", "link"], "left").join(up, ["tree_id", "prev"], "left")
    far = F.lit((1 << 62))
    kind = F.when(F.col("pos").isNotNull(), "chain").when(F.col("parent_pos").isNotNull(), "branch").otherwise("orphan")
    rows = rows.withColumn("edge_type", kind).withColumn("place", F.coalesce("pos", "parent_pos", far)).withColumn("is_branch", F.col("pos").isNull().cast("int"))
    depth = F.when(F.col("pos").isNotNull(), F.col("pos")).when(F.col("parent_pos").isNotNull(), F.col("parent_pos") + 1).otherwise(F.lit(0))
    rows = ranked(rows.select("tree_id", "link", "edge_type", depth.alias("depth"), "place", "is_branch"), "place", "is_branch")
    return rows.select("tree_id", "link", "edge_type", "depth", "ord")


def tree_edges(rev: DataFrame) -> DataFrame:
    """(tree, needs): trees that a tree's anchors refer to by a structural link to any of their revisions; links within a tree are none."""
    links = rev.where("kind = 'anchor'").select(F.col("tree_id").alias("tree"), F.explode("structural_links").alias("link"))
    own = rev.select(F.col("tree_id").alias("tree"), "link").distinct()
    owners = rev.select("link", F.col("tree_id").alias("needs")).distinct()
    return links.join(own, ["tree", "link"], "left_anti").join(owners, "link").select("tree", "needs").distinct()


def references(rev: DataFrame, links: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(tree_id, link, target, needs) of links(tree_id, link, target) that lead out of their tree: needs is the tree that has the target.

    Without linked any tree of rev may be meant; of several that have the target the largest tree_id stands. linked(tree_id, linked_id, ordinal) says which
    trees each tree is verified with; then the one of the largest ordinal stands. Links that no such tree has are left out.
    """
    owners = rev.where("link is not null").select(F.col("link").alias("target"), F.col("tree_id").alias("needs")).distinct()
    met = links.join(owners, "target").where("needs <> tree_id").withColumn("ordinal", F.lit(0))
    if linked is not None:
        pairs = linked.select("tree_id", F.col("linked_id").alias("needs"), "ordinal").distinct()
        met = met.drop("ordinal").join(pairs, ["tree_id", "needs"])
    return met.groupBy("tree_id", "link", "target").agg(F.max(F.struct("ordinal", "needs")).alias("last")).select("tree_id", "link", "target", F.col("last.needs").alias("needs"))


def tree_heights(edges: DataFrame) -> DataFrame:
    """(tree, height) of the trees of edges(tree, needs): the longest way down from each to a tree that needs none, which has height 0.

    A tree on a cycle, or that leads to one, has no height. A round of joins for each height; in a round those trees get theirs that need none without one.
    """
    edges = edges.select("tree", "needs").distinct()
    every = edges.select("tree").unionByName(edges.select(F.col("needs").alias("tree"))).distinct()
    done = materialize(every.join(edges, "tree", "left_anti").withColumn("height", F.lit(0)), "heights")
    open_, height = materialize(edges, "open_edges"), 0
    while True:
        height += 1
        waits = open_.join(done.select(F.col("tree").alias("needs")), "needs", "left_anti").select("tree").distinct()
        new = materialize(open_.select("tree").distinct().join(waits, "tree", "left_anti").withColumn("height", F.lit(height)), "heights")
        if not new.limit(1).count():
            return done.unionByName(open_.select("tree").distinct().withColumn("height", F.lit(None).cast("int")))
        done = done.unionByName(new)
        open_ = materialize(open_.join(new, "tree", "left_anti"), "open_edges")


def tree_levels(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(tree, level, fault) of the trees that roots(tree) depend on by edges(tree, needs): the longest way down to them.

    The tree that is needed comes first in the order of falling level. A tree on a cycle, or that only a way through a cycle leads
    to, has no level and the fault CROSS_TREE_CYCLE_DETECTED. A round of joins for each level: first what can be reached, then
    trees that no tree that is left needs are taken away until a round finds none. An edge of a tree to itself counts for nothing.
    """
    edges = materialize(edges.where("tree <> needs").select("tree", "needs").distinct(), "tree_edges")
    new = reached = materialize(roots.select("tree").distinct(), "reached")
    while new.limit(1).count():
        new = materialize(new.join(edges, "tree").select(F.col("needs").alias("tree")).distinct().join(reached, "tree", "left_anti"), "reached")
        reached = reached.unionByName(new)
    left, open_, level, out = materialize(reached, "left"), edges.join(reached, "tree", "left_semi"), 0, None
    while True:
        needed = open_.select(F.col("needs").alias("tree")).distinct()
        free = materialize(left.join(needed, "tree", "left_anti").withColumn("level", F.lit(level)), "levels")
        if not free.limit(1).count():
            break
        out = free if out is None else out.unionByName(free)
        left = materialize(left.join(free, "tree", "left_anti"), "left")
        open_ = materialize(open_.join(free, "tree", "left_anti"), "open_edges")
        level += 1
    stuck = left.select("tree", F.lit(None).cast("int").alias("level"), F.lit("CROSS_TREE_CYCLE_DETECTED").alias("fault"))
    return stuck if out is None else out.withColumn("fault", F.lit(None).cast("string")).unionByName(stuck)
