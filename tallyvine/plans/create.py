"""Objects made from rows, each held against its template first: what is accepted as new revisions, and a table of what is not."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import Refused, load
from ..functions.schemas import problems
from ..session import materialize, shuffled
from . import changes, verify
from . import templates as resolution


def _checked(bodies: pd.Series, payloads: pd.Series) -> pd.DataFrame:
    """(where the payload breaks the template's schema, why that cannot be told) of JSON texts; each template is read once a batch."""
    schemas: dict[str, object] = {}
    out = []
    for body, payload in zip(bodies, payloads):
        try:
            if body is None:
                out.append((None, None))
                continue
            if body not in schemas:
                schemas[body] = load(body)["schema"]
            if payload is None:
                raise Refused("missing payload")
            out.append((problems(schemas[body], load(payload)), None))
        except (Refused, ValueError, KeyError, TypeError, AttributeError, ArithmeticError, RecursionError, re.error) as e:
            out.append((None, str(e) or "cannot be checked"))
    return pd.DataFrame(out, columns=["errors", "failure"])


def objects(
    wanted: DataFrame, ends: DataFrame, rev: DataFrame, now: int, seed: str, templates: DataFrame | None = None, method: str = "scalar", algorithm: str = "sha3", check: bool = True
) -> tuple[DataFrame, DataFrame]:
    """(made, rejects) of wanted(id, tree_id, revision_type, payloads as JSON text, file_name), ids unique: a new object after the end of each tree, or why there is none.

    ends(tree_id, link) has a row a tree at most; an object of a tree without one begins a tree. Templates are looked up as verify() does: in the object's
    tree in rev, among the built-in ones, in templates(tree_id or null, link, raw). made(id, tree_id, prev, link, raw, file_name): by the tree method raw publishes its leaves.
    Several objects of one tree all follow its end; they are siblings.

    rejects(id, fault, detail), the first that holds: "TEMPLATE_NOT_FOUND", "ANCESTOR_TEMPLATE_NOT_FOUND" (detail: the ancestors that are missing), "SCHEMA_VIOLATION" (every
    place where the payload breaks the schema), "METHOD" (the payload is no JSON, or the schema cannot be evaluated). With check False only payloads of built-in
    templates are held against these, and no template needs to be there.
    """
    rows = wanted.select("id", F.col("tree_id").cast("string").alias("tree_id"), "revision_type", "payloads", "file_name").withColumn("digest", verify._digest("revision_type"))
    rows = materialize(rows, "wanted")
    sources = verify._sources(rev, templates, None) if check else verify._sources(rev.limit(0), None, None)
    found = materialize(resolution.resolve(rows.select(F.col("tree_id").alias("scope"), "digest").distinct(), *sources).drop("source"), "found_templates")
    above = found.where("template is not null").select("scope", F.col("digest").alias("below"), F.explode(F.from_json("template", "struct<ancestry: array<string>>")["ancestry"]).alias("name"))
    above = above.withColumn("digest", verify._digest("name"))
    met = resolution.resolve(above.select("scope", "digest").distinct(), *sources).where("template is null").select("scope", "digest")
    gone = above.join(shuffled(met), ["scope", "digest"]).groupBy("scope", F.col("below").alias("digest")).agg(F.array_join(F.array_sort(F.collect_set("name")), ",").alias("gone"))
    facts = found.join(shuffled(gone), ["scope", "digest"], "left").withColumnRenamed("scope", "tree_id")
    facts = rows.join(shuffled(facts), ["tree_id", "digest"], "left").withColumn("c", F.pandas_udf(_checked, "errors array<string>, failure string")("template", "payloads"))
    facts = materialize(facts.select("id", "tree_id", "revision_type", "payloads", "file_name", F.col("template").isNotNull().alias("there"), "gone", "c.errors", "c.failure"), "checked")
    none = F.lit(None).cast("string")
    wrong = F.size("errors") > 0
    fault = F.when(~F.col("there"), "TEMPLATE_NOT_FOUND").when(F.col("gone").isNotNull(), "ANCESTOR_TEMPLATE_NOT_FOUND") if check else F.when(F.lit(False), none)
    fault = fault.when(F.col("failure").isNotNull(), "METHOD").when(wrong, "SCHEMA_VIOLATION")
    facts = facts.withColumn("fault", fault)
    made = changes.append_objects(ends, facts.where("fault is null"), now, seed, method, algorithm)
    if method == "tree":
        made = changes.published(made, algorithm)
    made = materialize(made, "made_objects")
    detail = F.when(F.col("fault") == "ANCESTOR_TEMPLATE_NOT_FOUND", F.col("gone")).when(F.col("fault") == "METHOD", F.col("failure")).when(F.col("fault") == "SCHEMA_VIOLATION", F.array_join("errors", "; "))
    unhashed = made.where("link is null").select("id", F.lit("METHOD").alias("fault"), F.lit("cannot be hashed").alias("detail"))
    rejects = facts.where("fault is not null").select("id", "fault", detail.alias("detail")).unionByName(unhashed)
    return made.where("link is not null"), rejects
