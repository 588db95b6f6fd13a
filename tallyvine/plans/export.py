"""Self-describing trees: the templates that a tree needs are put into it, all of them or none."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.canonical import link_column
from ..functions.hashing import render_hex
from ..session import materialize
from . import builtin, catalogue, topology
from .templates import resolve
from .verify import _digest

PARTS = "struct<derives_from: string, ancestry: array<string>>"


def _bodies(rev: DataFrame, extra: DataFrame | None) -> list[DataFrame]:
    """(scope, digest, template) in order of priority: a tree's own, the built-in ones, those of extra by their key, those of extra by what they hash to."""
    own = rev.where("parse_error is null and kind = 'template'").select(F.col("tree_id").alias("scope"), F.col("link").alias("digest"), F.col("raw").alias("template"))
    body = builtin.templates(rev.sparkSession)
    both = lambda rows, link: rows.select(F.lit(None).cast("string").alias("scope"), F.explode(F.array(link, F.substring(link, 3, 32))).alias("digest"), F.col("raw").alias("template"))
    out = [own, both(body, F.col("link"))]
    if extra is not None:
        out.append(extra.select(F.lit(None).cast("string").alias("scope"), F.col("link").alias("digest"), F.col("raw").alias("template")))
        made = extra.withColumn("made", link_column(F.col("raw"), F.lit("sha3"))["link"]).where("made is not null")
        out.append(both(materialize(made.select("made", "raw"), "canonical"), F.col("made")))
    return out


def closure(rev: DataFrame, extra: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(tree_id, link, raw) of the templates that each tree's objects need, with all that these derive from by ancestry or derives_from; (tree_id, missing) of those found nowhere.

    Templates are named by the link that their body hashes to. extra(link, raw) are further sources, whose keys may be links or bare digests. What a
    missing template derives from is not known, so it is not looked for; the other ways are followed to their ends, a join a step.
    """
    sources = [materialize(s, "template_sources") for s in _bodies(rev, extra)]
    used = rev.where("parse_error is null and kind = 'object'").select(F.col("tree_id").alias("scope"), _digest("revision_type").alias("digest"))
    new = seen = materialize(used.distinct(), "needed")
    found = None
    while new.limit(1).count():
        got = resolve(new, *sources).drop("source").withColumn("p", F.from_json("template", PARTS))
        got = materialize(got, "found_templates")
        found = got if found is None else found.unionByName(got)
        up = F.concat(F.coalesce("p.ancestry", F.array().cast("array<string>")), F.array("p.derives_from"))
        named = got.where("template is not null").select("scope", F.explode(F.filter(up, lambda x: x.isNotNull())).alias("name"))
        named = named.select("scope", _digest("name").alias("digest")).distinct()
        new = materialize(named.join(seen, ["scope", "digest"], "left_anti"), "needed")
        seen = seen.unionByName(new)
    if found is None:
        found = seen.withColumn("template", F.lit(None).cast("string")).limit(0)
    good = found.where("template is not null").withColumn("link", link_column(F.col("template"), F.lit("sha3"))["link"])
    bodies = good.groupBy(F.col("scope").alias("tree_id"), "link").agg(F.min("template").alias("raw"))
    return bodies, found.where("template is null").select(F.col("scope").alias("tree_id"), F.col("digest").alias("missing")).distinct()


def self_describing(rev: DataFrame, extra: DataFrame | None = None, names: DataFrame | None = None, include_builtin: bool = False) -> tuple[DataFrame, DataFrame]:
    """(rows, refused): rows(tree_id, link, kind, raw, file_name, embedded) of every tree with the templates that it needs, and refused(tree_id, missing).

    A tree of which one template is missing has no rows at all: it is refused, with every link that is missing. Templates that a tree holds, and unless
    include_builtin those that are built in, are not put in again, so an exported tree exports as it is. names(link, file_name) are what extra calls its
    templates; built-in ones have their own names, others one made of their link. Trees that cannot be read are refused with missing null.
    """
    bodies, missing = closure(rev, extra)
    bodies, missing = materialize(bodies, "bodies"), materialize(missing, "missing")
    have = rev.where("link is not null").select("tree_id", "link")
    new = bodies.join(have, ["tree_id", "link"], "left_anti")
    own = builtin.templates(rev.sparkSession).select("link")
    if not include_builtin:
        new = new.join(own, "link", "left_anti")
    label = F.concat(F.lit("template_"), F.substring(F.lower(F.hex("link")), 1, 8))
    known = catalogue.catalogue(rev.sparkSession).select("link", F.col("name").alias("known"))
    new = new.join(F.broadcast(known), "link", "left")  # the catalogue
    if names is not None:
        new = new.join(names.groupBy("link").agg(F.min("file_name").alias("given")), "link", "left")
    else:
        new = new.withColumn("given", F.lit(None).cast("string"))
    new = new.select("tree_id", "link", F.lit("template").alias("kind"), "raw", F.coalesce("known", "given", label).alias("file_name"), F.lit(True).alias("embedded"))
    rows = rev.where("parse_error is null").select("tree_id", "link", "kind", "raw", "file_name", F.lit(False).alias("embedded")).unionByName(new)
    unread = rev.where("parse_error is not null").select("tree_id", F.lit(None).cast("binary").alias("missing")).distinct()
    refused = missing.unionByName(unread)
    return rows.join(refused.select("tree_id").distinct(), "tree_id", "left_anti"), refused


def dependencies(rev: DataFrame) -> DataFrame:
    """tree_id, ordinal, link, name: the built-in templates that each tree rests on, ancestors before what derives from them, each once where it comes first.

    They are what the first anchor's structural links name, in their order, then the templates of the suites of the tree's signatures, by the signatures' links.
    """
    spark = rev.sparkSession
    good = rev.where("parse_error is null")
    first = topology.genesis(good).groupBy("tree_id").agg(F.min("link").alias("link"))
    links = good.where("kind = 'anchor'").join(first, ["tree_id", "link"], "left_semi").select("tree_id", F.posexplode("structural_links").alias("at", "target"))
    asked = links.select("tree_id", F.struct(F.lit(0).alias("part"), F.lit(None).cast("binary").alias("by"), "at").alias("place"), F.when(F.length("target") == 34, F.substring("target", 3, 32)).otherwise(F.col("target")).alias("digest"))
    suite = catalogue.suite_template(F.get_json_object("raw", "$.signature.signature_type"))
    signs = good.where("kind = 'signature'").select("tree_id", F.struct(F.lit(1).alias("part"), F.col("link").alias("by"), F.lit(0).alias("at")).alias("place"), suite.alias("digest"))
    body = builtin.templates(spark).select(F.substring("link", 3, 32).alias("digest"), "link", F.from_json("raw", PARTS)["ancestry"].alias("line"))
    line = F.concat(F.coalesce("line", F.array().cast("array<string>")), F.array(render_hex(F.col("link"))))
    chains = body.select("digest", F.posexplode(line).alias("step", "name")).select("digest", "step", _digest("name").alias("member"))
    known = catalogue.catalogue(spark).select(F.col("link").alias("member"), "name")
    chains = chains.join(body.select(F.col("link").alias("member")), "member", "left_semi").join(known, "member")
    met = asked.unionByName(signs).join(F.broadcast(chains), "digest")  # the built-in templates
    once = met.groupBy("tree_id", F.col("member").alias("link"), "name").agg(F.min(F.struct("place", "step")).alias("place"))
    return once.select("tree_id", (F.row_number().over(Window.partitionBy("tree_id").orderBy("place")) - 1).alias("ordinal"), "link", "name")  # as many as are built in


def as_trees(rows: DataFrame) -> DataFrame:
    """tree_id, json of rows(tree_id, link, raw, file_name): members by link. A tree is one text, so it is gathered."""
    key = render_hex(F.col("link"))
    member = F.concat(F.lit('"'), key, F.lit('":'), F.col("raw"))
    file = F.when(F.col("file_name").isNotNull(), F.concat(F.lit('"'), key, F.lit('":'), F.to_json(F.array("file_name"))))
    lists = rows.groupBy("tree_id").agg(F.array_sort(F.collect_set(member)).alias("m"), F.array_sort(F.collect_set(file)).alias("f"))
    names = F.transform("f", lambda x: F.regexp_replace(x, r'^("[^"]*":)\[(.*)\]$', "$1$2"))
    return lists.select("tree_id", F.concat(F.lit('{"revisions":{'), F.array_join("m", ","), F.lit('},"file_index":{'), F.array_join(names, ","), F.lit("}}")).alias("json"))
