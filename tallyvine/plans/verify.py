"""Verification of decoded trees: every check is a DataFrame of conditions (tree_id, stage, code, link)."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import Refused, link_and_leaves, link_column, link_of, load, remembered
from ..functions.hashing import digest_column, parse_hex, render_hex
from ..functions.schemas import problems
from ..functions.signatures import signature_fault
from ..session import materialize, shuffled
from . import batches, builtin, changes, outcome, topology
from . import catalogue as names
from . import templates as resolution

ZERO = bytes(32)
LEAF = re.compile("0x[0-9a-fA-F]{64}")


def _conditions(rows: DataFrame, stage: float, code: str) -> DataFrame:
    return rows.select("tree_id", F.lit(stage).alias("stage"), F.lit(code).alias("code"), "link")


def dangling_links(rev: DataFrame, known: DataFrame) -> DataFrame:
    """tree_id, link, target of structural links that are neither null nor zero and lead to nothing in known(tree_id, target).

    known holds what each tree may refer to (its own links, those of its linked trees, built-in digests with tree_id null).
    """
    out = rev.select("tree_id", "link", F.explode("structural_links").alias("target")).where(F.col("target") != F.lit(ZERO))
    own = known.where("tree_id is not null").distinct()
    shared = known.where("tree_id is null").select("target").distinct()
    return out.join(shuffled(own), ["tree_id", "target"], "left_anti").join(shared, "target", "left_anti").select("tree_id", "link", "target")


def structural(rev: DataFrame, loose: DataFrame) -> DataFrame:
    """Stage 0: unreadable trees, missing parents, cycles, and the anchors of loose(tree_id, link), whose links lead nowhere."""
    bad = _conditions(rev.where("parse_error is not null"), 0.0, "STRUCTURAL_VALIDATION_FAILED")
    good = rev.where("parse_error is null")
    for rows in (topology.missing_parents(good), topology.cycle_nodes(good), loose):
        bad = bad.unionByName(_conditions(rows, 0.0, "STRUCTURAL_VALIDATION_FAILED"))
    return bad


def contents(rev: DataFrame) -> DataFrame:
    """tree_id, stage, code, link of stage 1: links that are not what the content hashes to (HASH_VERIFICATION_FAILED), and by the tree method published leaves
    that are missing, no bare digests, too few or many, or wrong. A revision is read and hashed once for both."""

    @F.pandas_udf("link binary, code string")
    def made(raws: pd.Series, algs: pd.Series, asked: pd.Series) -> pd.DataFrame:
        out = []
        for raw, alg, ask in zip(raws, algs, asked):
            link, code = None, "LEAVES_COMPUTE_FAILED" if ask else None
            try:
                value = load(raw)
                if ask:
                    link, own = link_and_leaves(value, alg)
                    have = value.get("leaves")
                    code = "LEAVES_MISSING"
                    if have is not None:
                        code = "LEAF_NOT_BARE_DIGEST"
                        if all(isinstance(x, str) and LEAF.fullmatch(x) for x in have):
                            code = "LEAVES_COUNT_MISMATCH" if len(have) != len(own) else None if have == own else "LEAVES_MISMATCH"
                elif alg in ("sha3", "blake3"):
                    link = link_of(value, alg)
            except (Refused, ValueError, KeyError, TypeError):
                code = "LEAVES_COMPUTE_FAILED" if ask else None
            out.append((link, code))
        return pd.DataFrame(out, columns=["link", "code"])

    asked = F.coalesce((F.col("method") == "tree") & F.col("kind").isin("object", "anchor"), F.lit(False))
    rows = rev.where("parse_error is null").select("tree_id", "link", made.asNondeterministic()("raw", "hash_alg", asked).alias("made"))
    wrong = F.when(~F.col("link").eqNullSafe(F.col("made.link")), "HASH_VERIFICATION_FAILED")
    found = rows.select("tree_id", "link", F.explode(F.array(wrong, F.col("made.code"))).alias("code")).where("code is not null")
    return found.select("tree_id", F.lit(1.0).alias("stage"), "code", "link")


def hashes(rev: DataFrame) -> DataFrame:
    """Stage 1: revisions whose link is not what their content hashes to."""
    return contents(rev).where("code = 'HASH_VERIFICATION_FAILED'")


def leaves(rev: DataFrame) -> DataFrame:
    """tree_id, link, code of revisions by the tree method whose published leaves are missing, no bare digests, too few or many, or wrong."""
    return contents(rev).where("code <> 'HASH_VERIFICATION_FAILED'").select("tree_id", "link", "code")


def _digest(text: Column | str) -> Column:
    """The bytes of a link given as hex text; none for what is no such text."""
    return F.coalesce(F.try_to_binary(F.substring(text, 3, 1 << 30), F.lit("hex")), F.lit(b""))


def _sources(rev: DataFrame, templates: DataFrame | None, linked: DataFrame | None) -> list[DataFrame]:
    """(scope, digest, template) in order of priority: the templates of each tree, the built-in ones, those of linked(tree_id, link, raw), and those given."""
    own = rev.where("parse_error is null and kind = 'template'").select(F.col("tree_id").alias("scope"), F.col("link").alias("digest"), F.col("raw").alias("template"))
    body = builtin.templates(rev.sparkSession)
    out = [own, *(body.select(F.col("tree_id").alias("scope"), d.alias("digest"), F.col("raw").alias("template")) for d in (F.col("link"), F.substring("link", 3, 32)))]
    out = [out[0], out[1].unionByName(out[2])]
    for more in (linked, templates):
        if more is not None:
            out.append(more.select(F.col("tree_id").cast("string").alias("scope"), F.col("link").alias("digest"), F.col("raw").alias("template")))
    return out


def _resolved(rev: DataFrame, sources: list[DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(tree_id, link, raw, digest) of all objects, and (scope, digest, template, named) of what they name: named says whether the template hashes to its link, or its bare digest."""
    objects = rev.where("parse_error is null and kind = 'object'").select("tree_id", "link", "raw", _digest("revision_type").alias("digest"))
    found = resolution.resolve(objects.select(F.col("tree_id").alias("scope"), "digest").distinct(), *sources).drop("source")
    made = link_column(F.col("template"), F.lit("sha3"))["link"]
    return objects, materialize(found.withColumn("made", made), "resolved").withColumn("named", F.col("made").eqNullSafe(F.col("digest")) | F.substring("made", 3, 32).eqNullSafe(F.col("digest"))).drop("made")


def computes(rev: DataFrame, sources: list[DataFrame], resolved: tuple[DataFrame, DataFrame]) -> DataFrame:
    """tree_id, link, code of objects whose template names an ancestor that is found nowhere, or asks for computed checks, itself or by an ancestor.

    No compute module is ever run, so what asks for one is refused; a timestamp's is unavailable.
    """
    parts = "struct<ancestry: array<string>, verification: string>"
    objects, found = resolved
    found = found.where("template is not null").select("scope", "digest", F.from_json("template", parts).alias("t"))
    above = found.select("scope", F.col("digest").alias("below"), F.explode("t.ancestry").alias("name")).select("scope", "below", _digest("name").alias("digest"))
    met = resolution.resolve(above.select("scope", "digest").distinct(), *sources)
    met = met.select("scope", "digest", F.col("template").isNull().alias("gone"), F.from_json("template", parts)["verification"].isNotNull().alias("asks"))
    facts = above.join(shuffled(met), ["scope", "digest"]).groupBy("scope", F.col("below").alias("digest")).agg(F.max("gone").alias("gone"), F.max("asks").alias("asks"))
    facts = found.select("scope", "digest", F.col("t.verification").isNotNull().alias("own")).join(shuffled(facts), ["scope", "digest"], "left")
    stamp = F.concat(F.lit("0x"), F.lower(F.hex("digest")))
    refused = F.when(names.kind_named(stamp) == "Timestamp", "TIMESTAMP_UNAVAILABLE").otherwise("COMPUTE_UNSUPPORTED")
    code = F.when(F.col("gone"), "ANCESTOR_TEMPLATE_NOT_FOUND").when(F.col("own") | F.col("asks"), refused)
    facts = facts.select(F.col("scope").alias("tree_id"), "digest", code.alias("code")).where("code is not null")
    return objects.join(shuffled(facts), ["tree_id", "digest"]).select("tree_id", "link", "code")


def linked(rev: DataFrame, roots: DataFrame, outcomes: DataFrame) -> DataFrame:
    """tree_id, stage, code, link for roots(tree): trees that lead to a cycle of trees, or to a tree that failed by outcomes(tree_id, outcome).

    A tree that was verified with warnings is verified.
    """
    edges = materialize(topology.tree_edges(rev), "tree_edges")
    found = _settled(edges, materialize(topology.tree_heights(edges), "heights"), outcomes.where("outcome = 'failed'").select(F.col("tree_id").alias("tree")))
    return found.join(roots.select(F.col("tree").alias("tree_id")).distinct(), "tree_id", "left_semi")


def _settled(edges: DataFrame, heights: DataFrame, failed: DataFrame) -> DataFrame:
    """tree_id, stage, code, link of trees that lead to a cycle of trees, or to a failed tree: level by level, each told by the outcomes of the one below.

    failed(tree) are those that fail by themselves; a tree fails too if one that it needs does.
    """
    none = F.lit(None).cast("binary").alias("link")
    looped = heights.where("height is null").select("tree")
    failed = materialize(failed.distinct().unionByName(looped), "failed_trees")
    top = heights.agg(F.max("height")).first()[0] or 0
    spoilt = None
    for h in range(1, top + 1):
        level = edges.join(shuffled(heights.where(F.col("height") == h).select("tree")), "tree")
        new = materialize(level.join(shuffled(failed.select(F.col("tree").alias("needs"))), "needs", "left_semi").select("tree").distinct(), "failed_trees")
        failed = failed.unionByName(new)
        spoilt = new if spoilt is None else spoilt.unionByName(new)
    out = looped.select(F.col("tree").alias("tree_id"), F.lit(0.25).alias("stage"), F.lit("CROSS_TREE_CYCLE_DETECTED").alias("code"), none)
    if spoilt is None:
        return out
    return out.unionByName(spoilt.select(F.col("tree").alias("tree_id"), F.lit(0.5).alias("stage"), F.lit("LINKED_TREE_RESOLUTION_FAILED").alias("code"), none))


def reachable_templates(rev: DataFrame, edges: DataFrame, heights: DataFrame) -> DataFrame:
    """tree_id, link, raw: the templates of the trees that each tree leads to by edges(tree, needs), whatever the number of steps; trees that lead to a cycle see none.

    A tree of which one that it leads to fails is never held against templates, so whether they may be used needs no outcome.
    """
    own = materialize(rev.where("parse_error is null and kind = 'template'").select(F.col("tree_id").alias("needs"), "link", "raw"), "linked_templates")
    pairs = own.select("needs", "link").distinct()
    seen, top = None, heights.agg(F.max("height")).first()[0] or 0
    for h in range(1, top + 1):
        level = edges.join(shuffled(heights.where(F.col("height") == h).select("tree")), "tree")
        at = level.join(shuffled(pairs), "needs").select("tree", "link")
        if seen is not None:
            at = at.unionByName(level.join(seen.select(F.col("tree").alias("needs"), "link"), "needs").select("tree", "link"))
        at = materialize(at.distinct(), "seen_templates")
        seen = at if seen is None else seen.unionByName(at)
    bodies = own.groupBy("link").agg(F.min("raw").alias("raw"))
    if seen is None:
        return own.limit(0).select(F.col("needs").alias("tree_id"), "link", "raw")
    return seen.join(shuffled(bodies), "link").select(F.col("tree").alias("tree_id"), "link", "raw")


def payloads(resolved: tuple[DataFrame, DataFrame]) -> DataFrame:
    """tree_id, link, code of objects whose template is found nowhere (TEMPLATE_NOT_FOUND), or is not what its link names or refuses the payload (SCHEMA_OR_CHAIN_FAILED)."""

    @F.pandas_udf("boolean")
    def fits(schemas: pd.Series, raws: pd.Series) -> pd.Series:
        out = []
        body = remembered(lambda schema: load(schema)["schema"])
        for schema, raw in zip(schemas, raws):
            try:
                out.append(not problems(body(schema), load(raw)["payloads"]))
            except (ValueError, KeyError, TypeError, AttributeError, ArithmeticError, RecursionError, re.error):  # cannot be checked
                out.append(False)
        return pd.Series(out, dtype=object)

    objects, found = resolved
    rows = objects.join(shuffled(found.withColumnRenamed("scope", "tree_id")), ["tree_id", "digest"], "left")
    missing = F.col("template").isNull()
    bad = ~F.coalesce("named", F.lit(False)) | ~fits.asNondeterministic()("template", "raw")
    return rows.select("tree_id", "link", F.when(missing, "TEMPLATE_NOT_FOUND").when(bad, "SCHEMA_OR_CHAIN_FAILED").alias("code")).where("code is not null")


def file_faults(rev: DataFrame, files: DataFrame) -> DataFrame:
    """tree_id, link, code of file objects for which files(tree_id, content) hold nothing of the size and digest that they name (FILE_CONTENT_MISMATCH), or that name none.

    Names play no part. Only files of a size that some object of their tree names are hashed, once for each hash that is named.
    """
    shape = "struct<size: long, hash: string, hash_type: string>"
    objects = rev.where((F.col("parse_error").isNull()) & (F.col("kind") == "object") & (F.col("revision_type") == names.link_of_name("file")))
    p = F.from_json(F.get_json_object("raw", "$.payloads"), shape)
    alg = F.when(p["hash_type"] == "FIPS_202-SHA3-256", "sha3").when(p["hash_type"] == "BLAKE3-256", "blake3")
    objects = objects.select("tree_id", "link", p["size"].alias("size"), parse_hex(p["hash"]).alias("hash"), alg.alias("alg"))
    wanted = objects.select("tree_id", "size", "alg").where("alg is not null").distinct()
    near = files.select("tree_id", F.octet_length("content").cast("long").alias("size"), "content").join(shuffled(wanted), ["tree_id", "size"])
    made = F.when(F.col("alg") == "sha3", digest_column(F.when(F.col("alg") == "sha3", F.col("content")), "sha3")).otherwise(digest_column(F.when(F.col("alg") == "blake3", F.col("content")), "blake3"))
    near = near.select("tree_id", "size", "alg", made.alias("hash")).distinct()
    return objects.join(shuffled(near), ["tree_id", "size", "alg", "hash"], "left_anti").select("tree_id", "link", F.lit("FILE_CONTENT_MISMATCH").alias("code"))


def signers(rev: DataFrame) -> DataFrame:
    """tree_id, n_signers: the distinct signers of each tree's signatures; empty ones do not count, trees without any have no row."""
    named = rev.where((F.col("kind") == "signature") & (F.coalesce("signer", F.lit("")) != ""))
    return named.groupBy("tree_id").agg(F.countDistinct("signer").alias("n_signers"))


def order(rev: DataFrame) -> DataFrame:
    """Stage 2: children older than their parents."""
    return _conditions(topology.timestamp_violations(rev.where("parse_error is null")), 2.0, "SCHEMA_OR_CHAIN_FAILED")


def signatures(rev: DataFrame) -> DataFrame:
    """Stage 4: signatures that do not fit what they sign or are not by the key that their signer names."""
    signed = rev.where("parse_error is null and kind = 'signature'")
    return _conditions(signed.where(signature_fault(F.col("raw"), F.col("hash_alg")).isNotNull()), 4.0, "VERIFICATION_FAILED")


def batch_proofs(rev: DataFrame) -> DataFrame:
    """tree_id, link, code of timestamps whose payload does not prove that the revision before them is in its batch."""
    stamps = rev.where("parse_error is null and kind = 'object'").where(names.kind_named(F.col("revision_type")) == "Timestamp")
    rows = stamps.select("tree_id", "link", F.get_json_object("raw", "$.payloads").alias("payload"), F.coalesce(render_hex(F.col("prev")), F.lit("")).alias("target"))
    return batches.proof_faults(rows).where("code is not null").select("tree_id", "link", "code")


def compute_sections(rev: DataFrame) -> DataFrame:
    """tree_id, link of templates whose compute modules contradict themselves."""
    own = rev.where("parse_error is null and kind = 'template'").select("tree_id", "link", F.get_json_object("raw", "$.verification").alias("verification"))
    bad = changes.compute_faults(own.select("link", "verification")).select("link").distinct()
    return own.join(shuffled(bad), "link", "left_semi").select("tree_id", "link")


def verify(
    rev: DataFrame, policy: str = "strict", known: DataFrame | None = None, more: DataFrame | None = None, templates: DataFrame | None = None, files: DataFrame | None = None,
    linked: DataFrame | bool = False, check_templates: bool = True, custom: dict[str, str] | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(outcomes, conditions) of decoded trees, stage by stage as outcome.gate() has it.

    Stage 0: structure, cycles of trees (0.25), trees that are needed (0.5). 1: hashes and published leaves. 2: templates, payloads and the order of
    times. 2.5: batch proofs of timestamps. 3: what templates ask to be computed. 4: signatures, contents of files, compute sections.

    Anchors may link to their own tree, to built-in templates, to known(tree_id or null, target) and, with linked, to other trees: True means any tree of rev,
    else linked(tree_id, linked_id, ordinal) names those that each is verified with. Every tree of rev is verified, those that are needed before
    those that need them; a tree fails if one that it leads to fails or is on a cycle, and one that was verified with warnings is good.

    Templates are looked up in the object's own tree, among the built-in ones, in the trees that its tree leads to, and in templates(tree_id or null, link, raw).
    files(tree_id, content) are what file objects are held against. more: further conditions. n_unchecked of the outcomes counts what was not
    checked: without files the file objects; with check_templates False all objects, and revisions by the tree method that publish no leaves.

    Where the stages up to 2 fail a tree as a whole, its conditions name every revision at fault, so n_errors counts these; the codes are the same.
    A tree that cannot be read fails; a tree needs neither an object nor an anchor.
    """
    spark = rev.sparkSession
    good = rev.where("parse_error is null")
    own = good.select("tree_id", F.col("link").alias("target")).unionByName(builtin.known(spark))
    loose = materialize(dangling_links(good, own if known is None else own.unionByName(known)), "loose_links")
    between, seen = None, None
    if linked is not False:
        met = materialize(topology.references(good, loose, None if linked is True else linked), "references")
        edges = materialize(met.select(F.col("tree_id").alias("tree"), "needs").distinct(), "tree_edges")
        heights = materialize(topology.tree_heights(edges), "heights")
        loose = loose.join(shuffled(met), ["tree_id", "link", "target"], "left_anti")
        between, seen = (edges, heights), reachable_templates(good, edges, heights)
    held = contents(rev) if check_templates else contents(rev).where("code <> 'LEAVES_MISSING'")
    found = structural(rev, loose.select("tree_id", "link").distinct()).unionByName(held).unionByName(order(rev)).unionByName(signatures(rev))
    found = found.unionByName(_conditions(compute_sections(rev), 4.0, "VERIFICATION_FAILED"))
    parts = [(batch_proofs(rev), 2.5)]
    if check_templates:
        sources = _sources(rev, templates, seen)
        resolved = _resolved(rev, sources)
        parts += [(payloads(resolved), 2.0), (computes(rev, sources, resolved), 3.0)]
    for rows, stage in parts:
        found = found.unionByName(rows.select("tree_id", F.lit(stage).alias("stage"), "code", "link"))
    if files is not None:
        found = found.unionByName(_conditions(file_faults(rev, files), 4.0, "VERIFICATION_FAILED"))
    if more is not None:
        found = found.unionByName(more)
    found = materialize(found, "conditions")
    if between is not None:
        alone = outcome.outcomes(rev, outcome.gate(found, policy, custom), policy, custom)
        bad = alone.where("outcome = 'failed'").select(F.col("tree_id").alias("tree"))
        found = found.unionByName(_settled(*between, bad))
    found = materialize(outcome.gate(found, policy, custom), "conditions")
    is_file = F.col("revision_type") == names.link_of_name("file")
    open_ = F.lit(False) if files is not None else (F.col("kind") == "object") & is_file
    if not check_templates:
        open_ = open_ | (F.col("kind") == "object") | ((F.col("kind") == "anchor") & (F.col("method") == "tree") & F.col("leaves").isNull())
    unchecked = rev.groupBy("tree_id").agg(F.count(F.when(open_, 1)).alias("n_unchecked"))
    return outcome.outcomes(rev, found, policy, custom).join(shuffled(unchecked), "tree_id", "left"), found
