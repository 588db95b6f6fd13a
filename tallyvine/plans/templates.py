"""Templates: resolution by priority, lineages, closures, narrowing."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import materialize, shuffled


def resolve(wanted: DataFrame, *sources: DataFrame) -> DataFrame:
    """wanted(scope, digest) with source (its number, null if none has it) and template, from sources(scope, digest, template) in order of priority.

    A source with scope null serves all. Of several templates in one source the lowest stands.
    """
    tagged = [s.select(F.col("scope").alias("s"), F.col("digest").alias("d"), "template", F.lit(i).alias("source")) for i, s in enumerate(sources)]
    every = reduce(DataFrame.unionByName, tagged)
    own = wanted.join(shuffled(every.where("s is not null")), (F.col("scope") == F.col("s")) & (F.col("digest") == F.col("d")), "left").drop("s", "d")
    common = every.where("s is null").groupBy("d").agg(F.min(F.struct("source", "template")).alias("common"))
    best = own.groupBy("scope", "digest").agg(F.min(F.when(F.col("source").isNotNull(), F.struct("source", "template"))).alias("own"))
    best = best.join(common, F.col("digest") == F.col("d"), "left")
    pick = F.least("own", "common")  # least skips nulls
    return best.select("scope", "digest", pick["source"].alias("source"), pick["template"].alias("template"))


def nearest(*levels: Column) -> Column:
    """The first declaration from the template itself up its lineage."""
    return F.coalesce(*levels)


def lineage(templates: DataFrame, most: int | None = None) -> DataFrame:
    """link, depth, ancestor, fault of templates(link, derives_from), nearest first, depth 0 is the template itself.

    All lineages are followed to their ends, a join a step. fault is null, or why a lineage does not go on from this row:
    "unresolved" if the ancestor that is named is not in the table, "cycle" if it was met before, "too_deep" if it is more
    than `most` steps up (without `most` none is).
    """
    up = templates.where("link is not null").select(F.col("link").alias("ancestor"), F.col("derives_from").alias("next"), F.lit(True).alias("has"))
    level = templates.select("link", F.lit(0).alias("depth"), F.col("link").alias("ancestor"), F.col("derives_from").alias("next"), F.lit(None).cast("string").alias("fault"))
    level = out = materialize(level, "lineage")
    d = 0
    while level.where("next is not null").limit(1).count():
        d += 1
        met = out.select("link", "ancestor", F.lit(True).alias("met")).distinct()
        step = level.where("next is not null").select("link", F.col("next").alias("ancestor")).join(up, "ancestor", "left").join(met, ["link", "ancestor"], "left")
        deep = F.lit(most is not None and d > most)
        fault = F.when(deep, "too_deep").when(F.col("met"), "cycle").when(F.col("has").isNull(), "unresolved")
        level = materialize(step.select("link", F.lit(d).alias("depth"), "ancestor", F.when(fault.isNull(), F.col("next")).alias("next"), fault.alias("fault")), "lineage")
        out = out.unionByName(level)
    return out.select("link", "depth", "ancestor", "fault")


def closure(used: DataFrame, templates: DataFrame) -> DataFrame:
    """scope, digest: what used(scope, digest) needs, with all that it derives from, whether templates(link, derives_from) has it or not.

    A join a step up, until no scope needs anything new.
    """
    edges = materialize(templates.where("link is not null and derives_from is not null").select("link", "derives_from").distinct(), "derivations")
    new = out = materialize(used.select("scope", "digest").distinct(), "closure")
    while new.limit(1).count():
        named = new.join(edges, F.col("digest") == F.col("link")).select("scope", F.col("derives_from").alias("digest")).distinct()
        had = out.select(F.col("scope").alias("s"), F.col("digest").alias("d"))
        new = materialize(named.join(had, F.col("scope").eqNullSafe(F.col("s")) & (F.col("digest") == F.col("d")), "left_anti"), "closure")
        out = out.unionByName(new)
    return out


def missing(needed: DataFrame, *present: DataFrame) -> DataFrame:
    """needed(scope, digest) that none of present (scope, digest; scope null: for all) holds."""
    out = needed
    for p in present:
        out = out.join(p.where("scope is not null"), ["scope", "digest"], "left_anti").join(p.where("scope is null").select("digest"), "digest", "left_anti")
    return out.select("scope", "digest")


def widened(child: Column, parent: Column) -> Column:
    """The members of an array column that its parent's lacks: none if the child narrows the parent."""
    return F.array_sort(F.array_except(child, parent))


def over_bounds(rev: DataFrame, bounds: dict[str, int]) -> DataFrame:
    """tree_id, bound, n of trees(tree_id, kind) with more "revisions", "objects", "templates", "signatures" or "anchors" than bounds allow; what bounds do not name is free."""
    kinds = {"object": "objects", "template": "templates", "signature": "signatures", "anchor": "anchors"}
    name = F.lit(None).cast("string")
    for kind, bound in kinds.items():
        name = F.when(F.col("kind") == kind, bound).otherwise(name)
    counts = rev.groupBy("tree_id", name.alias("bound")).agg(F.count("*").alias("n"))
    counts = counts.where("bound is not null").unionByName(counts.groupBy("tree_id").agg(F.sum("n").alias("n")).select("tree_id", F.lit("revisions").alias("bound"), "n"))
    over = F.lit(False)
    for bound, most in bounds.items():
        over = over | ((F.col("bound") == bound) & (F.col("n") > most))
    return counts.where(over)


def facts(templates: DataFrame, permissive: str) -> DataFrame:
    """link, is_derived, depth, declared, bounds of templates(link, raw as JSON text): whether it derives from another, how many ancestors it has, the bounds that it declares, and those or else permissive.

    bounds are JSON texts as declared, and not those of ancestors (see bounds_of). What is no JSON object derives from nothing.
    """
    p = F.from_json("raw", "struct<derives_from: string, ancestry: array<string>>")
    declared = F.get_json_object("raw", "$.bounds")
    return templates.select("link", p["derives_from"].isNotNull().alias("is_derived"), F.coalesce(F.size(p["ancestry"]), F.lit(0)).alias("depth"), declared.alias("declared"), F.coalesce(declared, F.lit(permissive)).alias("bounds"))


def bounds_of(templates: DataFrame, permissive: str) -> DataFrame:
    """link, bounds of templates(link, bounds, ancestry from the root down): a template's own, else those of the nearest ancestor that is known and has any, else permissive."""
    own = templates.select("link", "bounds").where("link is not null")
    up = templates.select("link", F.posexplode("ancestry").alias("place", "ancestor"))
    near = up.join(own.select(F.col("link").alias("ancestor"), F.col("bounds").alias("inherited")).where("inherited is not null"), "ancestor")
    near = near.groupBy("link").agg(F.max_by("inherited", "place").alias("inherited"))
    return own.join(near, "link", "left").select("link", F.coalesce("bounds", "inherited", F.lit(permissive)).alias("bounds"))
