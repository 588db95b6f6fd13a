"""Audit of template catalogues: templates that are not what their links say, and what must be keyed anew because of them, level by level."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import Refused, link_column, load, render
from ..functions.hashing import render_hex
from ..session import materialize
from .catalogue import GENESIS_SEED
from .verify import _digest

#: The type of the template that all others have as their type.
GENESIS_TYPE = "0x1620" + hashlib.sha3_256(GENESIS_SEED).hexdigest()
PARTS = "struct<revision_type: string, derives_from: string, ancestry: array<string>>"


def _with_members(raw: Column, kind: Column, parent: Column, ancestry: Column) -> Column:
    """raw with another type, parent and ancestry; null: as it is."""

    @F.pandas_udf("string")
    def changed(raws: pd.Series, kinds: pd.Series, parents: pd.Series, lines: pd.Series) -> pd.Series:
        out = []
        for r, k, p, a in zip(raws, kinds, parents, lines):
            try:
                value = load(r)
                value |= {} if k is None else {"revision_type": k}
                value |= {} if p is None else {"derives_from": p, "ancestry": list(a)}
                out.append(render(value))
            except (Refused, TypeError):
                out.append(None)
        return pd.Series(out, dtype=object)

    return changed(raw, kind, parent, ancestry)


def audit(templates: DataFrame, meta: str = "template_meta") -> DataFrame:
    """scope, name, level, old_link, new_link, raw, drift, stale_type, stale_line, fault of templates(scope, name, link, raw): a catalogue a scope, its names unique.

    A template's parent is the one of its scope whose body, as it is or once it is mended, its derives_from names: by the link that the body hashes to, else by
    the link it is kept under, since children of a changed parent still name the old one. Parents are settled before children, the template `meta`
    before all others; level is the number of parents up. drift: the body given does not hash to old_link. stale_type: its type is not
    the new link of meta (of meta itself: not the fixed first type; without meta in the scope nothing is asked). stale_line:
    derives_from or ancestry are not those of the parent's new link. raw is the body with these mended and new_link what it then hashes to; a template
    must be kept under another link if that differs from old_link.

    fault: "unreadable" (no JSON object, or nothing to hash), "unresolved" (the parent is nowhere: its line is left as it is), "cycle" (it derives from itself;
    neither it nor what derives from it can be keyed). Repeated names give repeated rows. A round of joins for each level of derivation.
    """
    t = templates.select("scope", "name", F.col("link").alias("old_link"), "raw").withColumn("made", link_column(F.col("raw"), F.lit("sha3"))["link"])
    t = materialize(t.withColumn("p", F.from_json("raw", PARTS)), "catalogue")
    unreadable = t.where("made is null or p is null")
    t = t.where("made is not null and p is not null").withColumn("names", _digest("p.derives_from"))
    keys = t.select("scope", F.col("made").alias("names"), F.col("name").alias("parent"), F.lit(0).alias("way")).unionByName(t.select("scope", F.col("old_link").alias("names"), F.col("name").alias("parent"), F.lit(1).alias("way")))
    keys = keys.groupBy("scope", "names").agg(F.min(F.struct("way", "parent")).alias("best")).select("scope", "names", F.col("best.parent").alias("parent"))
    t = materialize(t.join(keys, ["scope", "names"], "left").drop("names"), "parents")

    def settle(rows: DataFrame, level: int) -> DataFrame:
        """rows with meta_link, up_link (the parent's new link) and up_line (its line): mended and keyed."""
        kind = F.when(F.col("name") == meta, GENESIS_TYPE).otherwise(render_hex(F.col("meta_link")))
        up = render_hex(F.col("up_link"))
        line = F.when(up.isNotNull(), F.concat(F.coalesce("up_line", F.array().cast("array<string>")), F.array(up)))
        stale_type = kind.isNotNull() & ~F.col("p.revision_type").eqNullSafe(kind)
        stale_line = up.isNotNull() & ~(F.col("p.derives_from").eqNullSafe(up) & F.col("p.ancestry").eqNullSafe(line))
        out = rows.withColumn("stale_type", stale_type).withColumn("stale_line", stale_line).withColumn("line", F.coalesce(line, F.when(F.col("p.derives_from").isNotNull(), F.col("p.ancestry"))))
        mended = _with_members(F.col("raw"), F.when(F.col("stale_type"), kind), F.when(F.col("stale_line"), up), line)
        out = out.withColumn("raw", F.when(F.col("stale_type") | F.col("stale_line"), mended).otherwise(F.col("raw")))
        out = materialize(out, "mended")
        fault = F.when(F.col("p.derives_from").isNotNull() & F.col("parent").isNull(), "unresolved")
        return materialize(out.select(
            "scope", "name", F.lit(level).alias("level"), "old_link", link_column(F.col("raw"), F.lit("sha3"))["link"].alias("new_link"), "raw",
            (~F.col("made").eqNullSafe(F.col("old_link"))).alias("drift"), "stale_type", "stale_line", fault.alias("fault"), "line",
        ), "settled")

    none = F.lit(None).cast("binary")
    first = t.where((F.col("name") == meta) & F.col("parent").isNull())
    done = settle(first.withColumn("meta_link", none).withColumn("up_link", none).withColumn("up_line", F.lit(None).cast("array<string>")), 0)
    pins = materialize(done.groupBy("scope").agg(F.min("new_link").alias("meta_link")), "pins")
    rest = t.join(first.select("scope", "name").distinct(), ["scope", "name"], "left_anti").join(pins, "scope", "left")
    left, level = materialize(rest, "unsettled"), 0
    roots = left.where("parent is null").withColumn("up_link", none).withColumn("up_line", F.lit(None).cast("array<string>"))
    new = settle(roots, 0).unionByName(done)
    done, left = new, materialize(left.where("parent is not null"), "unsettled")
    while True:
        level += 1
        up = new.select("scope", F.col("name").alias("parent"), F.col("new_link").alias("up_link"), F.col("line").alias("up_line"))
        ready = left.join(up, ["scope", "parent"])
        if not ready.limit(1).count():
            break
        new = settle(ready, level)
        done = done.unionByName(new)
        left = materialize(left.join(new.select("scope", "name").distinct(), ["scope", "name"], "left_anti"), "unsettled")
    no = F.lit(False)
    lost = left.select("scope", "name", F.lit(None).cast("int").alias("level"), "old_link", none.alias("new_link"), "raw", (~F.col("made").eqNullSafe(F.col("old_link"))).alias("drift"), no.alias("stale_type"), no.alias("stale_line"), F.lit("cycle").alias("fault"))
    bad = unreadable.select("scope", "name", F.lit(None).cast("int").alias("level"), "old_link", none.alias("new_link"), "raw", no.alias("drift"), no.alias("stale_type"), no.alias("stale_line"), F.lit("unreadable").alias("fault"))
    return done.drop("line").unionByName(lost).unionByName(bad)
