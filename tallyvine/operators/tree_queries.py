"""Queries over JSON record trees that are built from the driver's tables, with planted faults; SQL says what each fault must lead to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import canonical, hashing
from ..plans import batches, catalogue, disclosure, templates, verify
from ..session import materialize
from ..sources import records
from .queries import query, table

#: Turns of a conversation that make one tree at most.
TURNS = 64
BOGUS = "0x1620" + "5a" * 32


def _template(**more) -> tuple[str, bytearray, str]:
    """(hex link, link, JSON text) of a template for the payloads made here."""
    schema = {"type": "object", "required": ["role", "chars"], "properties": {"role": {"type": "string"}, "chars": {"type": "integer", "minimum": 0}}}
    made = {"revision_type": "0x" + "77" * 34, "nonce": "0x" + "01" * 16, "local_timestamp": 1, "version": "v", "method": "scalar", "schema": schema} | more
    link = canonical.link_of(made, "sha3")
    return "0x" + link.hex(), bytearray(link), canonical.render(made)


def _revision(kind: Column, stamp: Column, chars: Column, prev: Column, **more: Column) -> Column:
    """JSON text of an object; members that are null are left out."""
    nonce = F.concat(F.lit("0x"), F.md5(F.concat_ws("/", "conv_id", "turn")))
    members = {"revision_type": kind, "nonce": nonce, "local_timestamp": stamp, "version": F.lit("v"), "method": F.lit("scalar")} | more
    members |= {"payloads": F.struct("role", chars.cast("long").alias("chars")), "previous_revision": prev}
    return F.to_json(F.struct(*(v.alias(k) for k, v in members.items())))


def _link(text: Column) -> Column:
    return hashing.render_hex(canonical.link_column(text, F.lit("sha3"))["link"])


def planted_trees(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(tree_id, json) and (tree_id, link, raw) of templates: a tree for each TURNS turns of a conversation, its first turn the parent of the others.

    By (conversation + number of the tree) mod 11: 1 another last payload than was hashed, 2 a parent that is not there, 3 times before the parent's, 4 an unknown
    template, 5 a payload that its template refuses, 6 an anchor to nowhere, 7 an unknown member, 8 no first turn, 9 a template whose ancestor
    is not there, 10 a template that asks for computing.
    """
    plain, orphan, wasm = _template(), _template(ancestry=[BOGUS]), _template(verification={"module": "none"})
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", F.length("text").alias("chars")).dropDuplicates(["conv_id", "turn"])
    rows = rows.withColumn("part", F.floor(F.col("turn") / TURNS)).withColumn("at", F.col("turn") % TURNS)
    rows = rows.withColumn("fault", F.pmod(F.col("conv_id") + F.col("part"), F.lit(11))).withColumn("tree_id", F.concat_ws("/", "conv_id", "part"))
    fault = F.col("fault")
    first = rows.where("at = 0")
    kind = F.when(fault == 9, orphan[0]).when(fault == 10, wasm[0]).otherwise(plain[0])
    start = _revision(F.when(fault == 4, BOGUS).otherwise(kind), 1000 + F.col("turn"), F.when(fault == 5, -1).otherwise(F.col("chars")), F.lit(None).cast("string"))
    nonce = F.concat(F.lit("0x"), F.md5(F.concat_ws("/", "conv_id", "turn")))
    anchor = F.to_json(F.struct(F.lit("0x" + "66" * 34).alias("revision_type"), nonce.alias("nonce"), (1000 + F.col("turn")).alias("local_timestamp"), F.lit("v").alias("version"), F.lit("scalar").alias("method"), F.array(F.lit(BOGUS)).alias("structural_links")))
    first = first.withColumn("raw", F.when(fault == 6, anchor).otherwise(start))
    first = materialize(first.select("tree_id", "conv_id", "turn", "role", "chars", "fault", "at", "raw", _link(F.col("raw")).alias("key")), "firsts")
    up = first.select("tree_id", F.col("key").alias("up"))
    rest = rows.where("at > 0").drop("part").join(up, "tree_id", "left")
    prev = F.when(fault == 2, BOGUS).otherwise(F.coalesce("up", F.lit(BOGUS)))
    rest = rest.withColumn("raw", _revision(kind, F.when(fault == 3, 1).otherwise(1000 + F.col("turn")), F.col("chars"), prev))
    rest = rest.select("tree_id", "conv_id", "turn", "role", "chars", "fault", "at", "raw", _link(F.col("raw")).alias("key"))
    every = materialize(first.unionByName(rest), "members")
    last = every.groupBy("tree_id").agg(F.max("at").alias("last"))
    every = every.join(last, "tree_id").where("fault <> 8 or at > 0")
    raw = F.when((fault == 1) & (F.col("at") == F.col("last")), F.regexp_replace("raw", '"payloads":[{]"role"', '"payloads":{"was":1,"role"')).otherwise(F.col("raw"))
    raw = F.when((fault == 7) & (F.col("at") == 0), F.regexp_replace(raw, "[}]$", ',"extra":1}')).otherwise(raw)
    member = F.concat(F.lit('"'), F.col("key"), F.lit('":'), raw)
    trees = every.groupBy("tree_id").agg(F.concat(F.lit('{"revisions":{'), F.array_join(F.array_sort(F.collect_set(member)), ","), F.lit("}}")).alias("json"))
    given = spark.createDataFrame([(None, link, raw) for _, link, raw in (plain, orphan, wasm)], "tree_id string, link binary, raw string")
    return trees, given


PLANTED_SQL = f"""c AS (
  SELECT DISTINCT conv_id, turn // {TURNS} AS part, turn % {TURNS} AS pos, (conv_id + turn // {TURNS}) % 11 AS f FROM conversations
), t AS (
  SELECT conv_id || '/' || part AS tree_id, CASE WHEN min(pos) > 0 THEN 8 ELSE min(f) END AS f, count(*) AS m, count(*) FILTER (WHERE pos > 0) AS later FROM c GROUP BY conv_id, part
), n AS (
  SELECT tree_id, f, CASE f WHEN 1 THEN 'HASH_VERIFICATION_FAILED' WHEN 2 THEN 'STRUCTURAL_VALIDATION_FAILED' WHEN 3 THEN 'SCHEMA_OR_CHAIN_FAILED' WHEN 4 THEN 'TEMPLATE_NOT_FOUND'
    WHEN 5 THEN 'SCHEMA_OR_CHAIN_FAILED' WHEN 6 THEN 'STRUCTURAL_VALIDATION_FAILED' WHEN 7 THEN 'STRUCTURAL_VALIDATION_FAILED' WHEN 8 THEN 'STRUCTURAL_VALIDATION_FAILED'
    WHEN 9 THEN 'ANCESTOR_TEMPLATE_NOT_FOUND' WHEN 10 THEN 'COMPUTE_UNSUPPORTED' ELSE '' END AS code,
    CAST(CASE f WHEN 0 THEN 0 WHEN 2 THEN later WHEN 3 THEN later WHEN 8 THEN later WHEN 9 THEN m WHEN 10 THEN m ELSE 1 END AS BIGINT) AS n
  FROM t WHERE f <> 8 OR later > 0
)"""


def _decoded(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    trees, given = planted_trees(spark, sf_dir)
    return materialize(records.decode(trees), "revisions"), given


@query(f"""WITH {PLANTED_SQL} SELECT tree_id, CASE WHEN code IN ('TEMPLATE_NOT_FOUND', 'COMPUTE_UNSUPPORTED') THEN 0 ELSE n END AS n_errors,
  CASE WHEN code IN ('TEMPLATE_NOT_FOUND', 'COMPUTE_UNSUPPORTED') THEN n ELSE 0 END AS n_warnings,
  CASE WHEN n = 0 THEN 'verified' WHEN code IN ('TEMPLATE_NOT_FOUND', 'COMPUTE_UNSUPPORTED') THEN 'verified_with_warnings' ELSE 'failed' END AS outcome FROM n""")
def verify_trees(spark, sf_dir):
    """Decoding and full verification of planted trees under the offline preset."""
    rev, given = _decoded(spark, sf_dir)
    return verify.verify(rev, "offline", templates=given)[0].select("tree_id", "n_errors", "n_warnings", "outcome")


@query(f"WITH {PLANTED_SQL} SELECT tree_id, code, n FROM n WHERE n > 0")
def condition_codes(spark, sf_dir):
    """The conditions that verification finds in planted trees."""
    rev, given = _decoded(spark, sf_dir)
    return verify.verify(rev, "strict", templates=given)[1].groupBy("tree_id", "code").agg(F.count("*").alias("n"))


def _objects(kind: Column, payloads: Column, stamp: Column, *seed: Column, prev: Column | None = None) -> Column:
    """JSON text of an object with any payloads."""
    members = {"revision_type": kind, "nonce": F.concat(F.lit("0x"), F.md5(F.concat_ws("/", *seed))), "local_timestamp": stamp, "version": F.lit("v"), "method": F.lit("scalar"), "payloads": payloads}
    if prev is not None:
        members["previous_revision"] = prev
    return F.to_json(F.struct(*(v.alias(k) for k, v in members.items())))


def _trees(members: DataFrame) -> DataFrame:
    """tree_id, json of members(tree_id, key, raw); a tree has few of them."""
    one = F.concat(F.lit('"'), F.col("key"), F.lit('":'), F.col("raw"))
    return members.groupBy("tree_id").agg(F.concat(F.lit('{"revisions":{'), F.array_join(F.array_sort(F.collect_set(one)), ","), F.lit("}}")).alias("json"))


#: What is wrong with a planted tree of several faults, by conversation mod 8, and the conditions that are left: under strict, under offline.
_GATED = (
    ("verified", (), ()),
    ("unknown template and computing template", ("TEMPLATE_NOT_FOUND",), ("TEMPLATE_NOT_FOUND", "COMPUTE_UNSUPPORTED")),
    ("unknown template and other contents", ("TEMPLATE_NOT_FOUND",), ("TEMPLATE_NOT_FOUND", "VERIFICATION_FAILED")),
    ("refused payload and computing template", ("SCHEMA_OR_CHAIN_FAILED",), ("SCHEMA_OR_CHAIN_FAILED",)),
    ("wrong link and refused payload", ("HASH_VERIFICATION_FAILED",), ("HASH_VERIFICATION_FAILED",)),
    ("a template alone", (), ()),
    ("a file of no size", ("SCHEMA_OR_CHAIN_FAILED",), ("SCHEMA_OR_CHAIN_FAILED",)),
    ("an anchor to nowhere and a wrong link", ("STRUCTURAL_VALIDATION_FAILED",), ("STRUCTURAL_VALIDATION_FAILED",)),
)
_GATED_SQL = "VALUES " + ", ".join(f"({f}, '{p}', '{c}')" for f, row in enumerate(_GATED) for p, codes in (("strict", row[1]), ("offline", row[2])) for c in codes or ("",))


@query(f"""SELECT DISTINCT policy, CAST(conv_id AS VARCHAR) AS tree_id, code,
  CASE WHEN code = '' THEN 'verified' WHEN policy = 'offline' AND f = 1 THEN 'verified_with_warnings' ELSE 'failed' END AS outcome
FROM (SELECT DISTINCT conv_id FROM conversations) JOIN ({_GATED_SQL}) AS g(f, policy, code) ON conv_id % 8 = f""")
def gated_trees(spark, sf_dir):
    """Trees of files with two faults each, held against built-in templates and contents: what is left of their conditions under two policies, and their outcomes."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"), F.min("text").alias("text"))
    fault, stamp = F.col("conv_id") % 8, F.lit(1000)
    plain, wasm = _template(), _template(verification={"module": "none"})
    content = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    size = F.when(fault == 6, -1).otherwise(F.octet_length(content))
    payload = F.struct(F.lit("file").alias("type"), hashing.render_hex(hashing.digest_column(content, "sha3")).alias("hash"), F.lit("FIPS_202-SHA3-256").alias("hash_type"), F.lit("").alias("descriptor"), size.alias("size"), F.lit("text/plain").alias("content_type"))
    file = _objects(F.lit(catalogue.link_of_name("file")), payload, stamp, F.lit("file"), F.col("conv_id"))
    nothing = _objects(F.lit(BOGUS), F.struct(F.lit(1).alias("any")), stamp, F.lit("unknown"), F.col("conv_id"))
    asks = _objects(F.lit(wasm[0]), F.struct(F.lit("user").alias("role"), F.coalesce("chars", F.lit(0)).alias("chars")), stamp, F.lit("computes"), F.col("conv_id"))
    refused = _objects(F.lit(plain[0]), F.struct(F.lit("user").alias("role"), F.lit(-1).alias("chars")), stamp, F.lit("refused"), F.col("conv_id"))
    anchor = F.to_json(F.struct(F.lit(catalogue.link_of_name("anchor_template")).alias("revision_type"), F.concat(F.lit("0x"), F.md5(F.col("conv_id").cast("string"))).alias("nonce"), stamp.alias("local_timestamp"), F.lit("v").alias("version"), F.lit("scalar").alias("method"),
                                F.array(F.when(fault == 7, BOGUS).otherwise(catalogue.link_of_name("file"))).alias("structural_links")))
    own = F.when(fault.isin(0, 6), F.array(file, anchor)).when(fault == 1, F.array(nothing, asks)).when(fault == 2, F.array(nothing, file)).when(fault == 3, F.array(refused, asks)).when(fault == 5, F.array(F.lit(plain[2])))
    rows = rows.select(F.col("conv_id").cast("string").alias("tree_id"), fault.alias("fault"), F.explode(own.when(fault == 4, F.array(refused, file)).otherwise(F.array(anchor, file))).alias("raw"))
    wrong = (F.col("fault").isin(4, 7)) & F.col("raw").contains('"payloads":{"type":"file"')
    key = F.when(wrong, "0x1620" + "13" * 32).otherwise(_link(F.col("raw")))
    rev = materialize(records.decode(_trees(rows.select("tree_id", "raw", key.alias("key")))), "revisions")
    texts = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.min("text").alias("text")).where("conv_id % 8 <> 2")
    files = materialize(texts.select(F.col("conv_id").cast("string").alias("tree_id"), F.encode(F.coalesce("text", F.lit("")), "UTF-8").alias("content")), "files")
    given = spark.createDataFrame([(None, link, raw) for _, link, raw in (plain, wasm)], "tree_id string, link binary, raw string")
    out = None
    for policy in ("strict", "offline"):
        outcomes, found = verify.verify(rev, policy, templates=given, files=files)
        rows = outcomes.join(found.select("tree_id", "code").distinct(), "tree_id", "left").select(F.lit(policy).alias("policy"), "tree_id", F.coalesce("code", F.lit("")).alias("code"), "outcome")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("""WITH c AS (SELECT DISTINCT conv_id, conv_id % 5 AS f FROM conversations), t AS (SELECT conv_id, f, unnest(['top', 'middle', 'last']) AS part FROM c)
SELECT conv_id || '/' || part AS tree_id, CASE WHEN f = 0 THEN 'verified' WHEN f = 1 AND part = 'last' THEN 'verified_with_warnings' WHEN f = 1 THEN 'verified' WHEN f = 4 AND part <> 'last' THEN 'failed' WHEN f = 4 THEN 'verified' ELSE 'failed' END AS outcome,
  CASE WHEN f = 1 AND part = 'last' THEN 'COMPUTE_UNSUPPORTED' WHEN f = 2 THEN CASE part WHEN 'last' THEN 'HASH_VERIFICATION_FAILED' ELSE 'LINKED_TREE_RESOLUTION_FAILED' END
    WHEN f = 3 THEN 'CROSS_TREE_CYCLE_DETECTED' WHEN f = 4 AND part = 'middle' THEN 'SCHEMA_OR_CHAIN_FAILED' WHEN f = 4 AND part = 'top' THEN 'LINKED_TREE_RESOLUTION_FAILED' ELSE '' END AS code FROM t""")
def linked_outcomes(spark, sf_dir):
    """Chains of three trees, verified together under the offline preset: the last one has the template that the objects of the others name.

    By conversation mod 5: 0 all good, 1 the last tree has warnings, 2 its hash is wrong, 3 it leads back to the first, 4 the middle tree's payload is refused.
    """
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars"))
    fault, stamp = F.col("conv_id") % 5, F.lit(1000)
    wasm = _template(verification={"module": "none"})
    name = lambda part: F.concat_ws("/", F.col("conv_id").cast("string"), F.lit(part))
    fake = lambda part: F.concat(F.lit("0x1620"), F.sha2(name(part), 256))

    def anchor(part: str, to: Column) -> Column:
        return F.to_json(F.struct(F.lit(catalogue.link_of_name("anchor_template")).alias("revision_type"), F.concat(F.lit("0x"), F.md5(name(part))).alias("nonce"), stamp.alias("local_timestamp"), F.lit("v").alias("version"), F.lit("scalar").alias("method"), to.alias("structural_links")))

    # a template of its own for every conversation, so that nothing but the links tells where it is
    schema = F.struct(F.lit("object").alias("type"), F.struct(F.struct(F.lit(0).alias("minimum")).alias("chars")).alias("properties"))
    template = F.to_json(F.struct(F.lit(catalogue.link_of_name("template_meta")).alias("revision_type"), F.concat(F.lit("0x"), F.md5(name("template"))).alias("nonce"), F.lit(1).alias("local_timestamp"), F.lit("v").alias("version"), F.lit("scalar").alias("method"), schema.alias("schema")))
    rows = materialize(rows.select("conv_id", "chars", template.alias("template")).withColumn("type", _link(F.col("template"))), "own_templates")
    asks = _objects(F.lit(wasm[0]), F.struct(F.lit("user").alias("role"), F.coalesce("chars", F.lit(0)).alias("chars")), stamp, F.lit("computes"), F.col("conv_id"))
    member = lambda part, raw, key=None: F.struct(name(part).alias("tree_id"), raw.alias("raw"), (key if key is not None else F.lit(None).cast("string")).alias("key"))
    nothing = F.array().cast("array<string>")
    last = anchor("last", F.when(fault == 3, F.array(fake("top"))).otherwise(nothing))
    middle = anchor("middle", F.array(F.when(fault == 2, fake("last")).otherwise(F.col("type"))))
    obj = lambda part, chars: _objects(F.col("type"), F.struct(chars.alias("chars")), stamp, name(part))
    every = F.array(
        member("last", F.col("template")), member("last", last, F.when(fault == 2, fake("last"))), member("last", F.when(fault == 1, asks)),
        member("middle", middle), member("middle", obj("middle", F.when(fault == 4, -1).otherwise(F.col("chars")))),
        member("top", obj("top", F.col("chars"))),
    )
    built = rows.select("conv_id", F.explode(every).alias("m")).where("m.raw is not null").select("conv_id", "m.*")
    built = materialize(built.withColumn("key", F.coalesce("key", _link(F.col("raw")))), "members")
    mid = built.where("tree_id like '%/middle' and raw like '%structural_links%'").select("conv_id", F.col("key").alias("to"))
    tops = mid.select(name("top").alias("tree_id"), F.when(fault == 3, fake("top")).alias("key"), anchor("top", F.array("to")).alias("raw"))
    tops = tops.withColumn("key", F.coalesce("key", _link(F.col("raw"))))
    rev = materialize(records.decode(_trees(built.select("tree_id", "key", "raw").unionByName(tops))), "revisions")
    given = spark.createDataFrame([(None, wasm[1], wasm[2])], "tree_id string, link binary, raw string")
    outcomes, found = verify.verify(rev, "offline", templates=given, linked=True)
    return outcomes.join(found.select("tree_id", "code").distinct(), "tree_id", "left").select("tree_id", "outcome", F.coalesce("code", F.lit("")).alias("code"))


@query("""WITH p AS (SELECT DISTINCT conv_id, turn // 2 AS part FROM conversations), s AS (SELECT conv_id, count(*) AS n, max(part) AS top FROM p GROUP BY conv_id)
SELECT p.conv_id || '/' || p.part AS tree_id, CASE WHEN conv_id % 3 = 0 AND top > 0 THEN 'CROSS_TREE_CYCLE_DETECTED' WHEN conv_id % 3 = 1 AND part < top THEN 'LINKED_TREE_RESOLUTION_FAILED' ELSE '' END AS code
FROM p JOIN s USING (conv_id)""")
def linked_trees(spark, sf_dir):
    """Trees whose anchors lead from each part of a conversation to the next one: back to the first in one of three, to a failed last one in another."""
    parts = table(spark, sf_dir, "conversations").select("conv_id", F.floor(F.col("turn") / 2).alias("part")).distinct()
    tops = parts.groupBy("conv_id").agg(F.max("part").alias("top"))
    parts = parts.join(tops, "conv_id")
    name = lambda part: F.concat_ws("/", "conv_id", part)
    to = F.when(F.col("part") < F.col("top"), F.col("part") + 1).when((F.col("conv_id") % 3 == 0) & (F.col("top") > 0), F.lit(0))
    rev = parts.select(name("part").alias("tree_id"), F.encode(name("part"), "UTF-8").alias("link"), F.lit("anchor").alias("kind"),
                       F.when(to.isNotNull(), F.array(F.encode(name(to), "UTF-8"))).otherwise(F.array().cast("array<binary>")).alias("structural_links"))
    rev = materialize(rev, "linked")
    bad = (F.col("conv_id") % 3 == 1) & (F.col("part") == F.col("top"))
    outcomes = parts.select(name("part").alias("tree_id"), F.when(bad, "failed").otherwise("verified").alias("outcome"))
    found = verify.linked(rev, rev.select(F.col("tree_id").alias("tree")), outcomes).select("tree_id", "code")
    return rev.select("tree_id").join(found, "tree_id", "left").na.fill("", ["code"])


def _sha256(x: Column) -> Column:
    return F.unhex(F.sha2(x, 256))


def _order_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tree_id, idx, node: an order's lines, numbered, as leaves."""
    rows = table(spark, sf_dir, "lineitem")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")  # an order's lines are few
    leaf = _sha256(F.expr("concat(l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey)"))
    return rows.select(F.col("l_orderkey").alias("tree_id"), (F.row_number().over(place) - 1).alias("idx"), leaf.alias("node"), "l_partkey")


@query("""SELECT l_orderkey AS tree_id, count(*) AS n_leaves, count(*) FILTER (WHERE l_partkey % 10 <> 0) AS n_included FROM lineitem GROUP BY l_orderkey""")
def inclusion_verify(spark, sf_dir):
    """How many of an order's lines are proven to be in its tree; lines of one part in ten claim another leaf than was put in."""
    leaves = _order_leaves(spark, sf_dir)
    claims = leaves.withColumn("node", F.when(F.col("l_partkey") % 10 == 0, _sha256(F.col("node"))).otherwise(F.col("node"))).drop("l_partkey")
    return batches.included_in(claims, leaves.select("tree_id", "idx", "node"), _sha256).groupBy("tree_id").agg(F.count("*").alias("n_leaves"), F.count(F.when(F.col("included"), 1)).alias("n_included"))


#: What is wrong with the proof of a document, by doc_id mod 17, in the order of the rules; 14 to 16 are good ones.
BATCH_CODES = (
    "MERKLE_ROOT_MISSING", "BATCH_TREE_SIZE_MISSING", "BATCH_LEAF_INDEX_MISSING", "MERKLE_PROOF_MISSING", "BATCH_TREE_SIZE_ZERO", "SHIELDING_NONCE_MISSING", "MERKLE_HEX_NOT_LOWERCASE",
    "MERKLE_HEX_DECODE_FAILED", "MERKLE_ROOT_MISMATCH", "MERKLE_LEAF_INDEX_OUT_OF_BOUNDS", "MERKLE_ROOT_BAD_MULTIHASH", "MERKLE_ROOT_BAD_CODEC", "MERKLE_INCLUSION_FAILED",
)


@query("SELECT doc_id, CASE doc_id % 17 " + " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(BATCH_CODES)) + " ELSE '' END AS code FROM documents")
def batch_proof_codes(spark, sf_dir):
    """The codes of batch proofs of documents, batches of up to 5, with a fault planted in most payloads."""
    docs = table(spark, sf_dir, "documents").select("doc_id").withColumn("tree_id", F.floor(F.col("doc_id") / 5))
    target = F.concat(F.unhex(F.lit("1620")), _sha256(F.col("doc_id").cast("string")))
    nonce = F.unhex(F.md5(F.col("doc_id").cast("string")))
    sha3 = lambda x: hashing.digest_column(x, "sha3")
    docs = docs.select("doc_id", "tree_id", (F.col("doc_id") % 5).alias("place"), target.alias("target"), nonce.alias("nonce"))
    leaf = sha3(F.concat(F.lit(hashing.LEAF), sha3(F.concat("target", "nonce"))))
    leaves = materialize(docs.withColumn("node", leaf).withColumn("idx", F.row_number().over(Window.partitionBy("tree_id").orderBy("place")) - 1), "batch_leaves")
    nodes = batches.levels(leaves.select("tree_id", "idx", "node"), sha3)
    rows = leaves.join(batches.proofs(nodes), ["tree_id", "idx"]).join(batches.roots(nodes), "tree_id")
    f = F.col("doc_id") % 17
    single = f == 8  # claims to be a batch of its own
    root = F.concat(F.when(f == 11, F.lit("1e20")).when(f == 10, F.lit("1720")).otherwise(F.lit("1620")), F.lower(F.hex("root")))
    root = F.when(f == 0, None).when(single, F.concat(F.lit("1620"), F.lower(F.hex("nonce")), F.lower(F.hex("nonce")))).otherwise(root)
    size = F.when(f == 1, None).when(f == 4, 0).when(single, 1).otherwise(F.greatest("size", F.lit(2)))
    idx = F.when(f == 2, None).when(f == 9, F.col("size") + 1).otherwise(F.col("idx"))
    shield = F.lower(F.hex("nonce"))
    shield = F.when(f == 5, None).when(f == 6, F.concat(F.lit("AB"), F.substring(shield, 3, 30))).when(f == 7, F.concat(F.lit("zz"), F.substring(shield, 3, 30))).otherwise(shield)
    proof = F.transform("proof", lambda x: F.lower(F.hex(x)))
    proof = F.when(f == 3, None).when(f == 12, F.concat(proof, F.array(F.lit("00" * 32)))).otherwise(proof)
    payload = F.to_json(F.struct(root.alias("merkle_root"), size.alias("batch_tree_size"), idx.alias("batch_leaf_index"), proof.alias("merkle_proof"), shield.alias("shielding_nonce")))
    # a batch of one cannot be told from a wrong size of two, so its good proofs say one
    alone = (F.col("size") == 1) & ~f.isin(1, 4, 8, 9, 12)
    payload = F.when(alone, F.regexp_replace(payload, '"batch_tree_size":2', '"batch_tree_size":1')).otherwise(payload)
    rows = rows.select("doc_id", payload.alias("payload"), F.lower(F.hex("target")).alias("target"))
    return batches.proof_faults(rows).select("doc_id", F.coalesce("code", F.lit("")).alias("code"))


@query(f"""SELECT conv_id || '/' || turn AS tree_id, CAST(CASE WHEN role IS NULL THEN 0 ELSE 1 END AS BIGINT) AS n_disclosed, turn % 5 <> 1 AS ok, CASE turn % 5 WHEN 0 THEN 'FIELD_NOT_FOUND' ELSE '' END AS error
FROM (SELECT DISTINCT conv_id, turn, first_value(role) OVER (PARTITION BY conv_id, turn ORDER BY role) AS role FROM conversations) WHERE turn % 5 <> 0
UNION ALL SELECT DISTINCT conv_id || '/' || turn, CAST(0 AS BIGINT), false, 'FIELD_NOT_FOUND' FROM conversations WHERE turn % 5 = 0""")
def redact_verify(spark, sf_dir):
    """Redacted turns that show their role alone, held against their links; some views lie about the role, some ask for a field that there is not."""
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("role").alias("role"))
    nonce = F.concat(F.lit("0x"), F.md5(F.concat_ws("/", "conv_id", "turn")))
    raw = F.to_json(F.struct(F.lit("0x" + "11" * 34).alias("revision_type"), nonce.alias("nonce"), F.col("turn").alias("local_timestamp"), F.lit("v").alias("version"), F.lit("tree").alias("method"), F.struct("role", "conv_id").alias("payloads")))
    rev = rows.select(F.concat_ws("/", "conv_id", "turn").alias("tree_id"), "turn", F.lit("sha3").alias("hash_alg"), raw.alias("raw"))
    rev = materialize(rev.withColumn("link", canonical.link_column(F.col("raw"), F.col("hash_alg"))["link"]), "redacted")
    shown = F.when(F.col("turn") % 5 == 0, F.array(F.lit("/payloads/none"))).otherwise(F.array(F.lit("/payloads/role")))
    leaves = materialize(disclosure.redact(rev, rev.select("tree_id", "link", shown.alias("pointers"))), "leaves")
    turn = F.split("tree_id", "/")[1].cast("long")
    lied = leaves.withColumn("value", F.when(F.col("disclosed") & (turn % 5 == 1), '"nobody"').otherwise(F.col("value")))
    facts = leaves.groupBy("tree_id").agg(F.count(F.when(F.col("disclosed"), 1)).alias("n_disclosed"), F.coalesce(F.max("error"), F.lit("")).alias("error"))
    good = disclosure.verify_redacted(lied).select("tree_id", "ok")
    return facts.join(good, "tree_id", "left").select("tree_id", "n_disclosed", F.coalesce("ok", F.lit(False)).alias("ok"), "error")


@query("""SELECT doc_id, CASE WHEN doc_id % 5 IN (1, 3) OR text IS NULL THEN 'FILE_CONTENT_MISMATCH' ELSE '' END AS code FROM (SELECT doc_id, min(text) AS text FROM documents GROUP BY doc_id)""")
def file_contents(spark, sf_dir):
    """File objects of the documents' texts, held against files: of one in five the digest is another, of one the size, of one the name (which plays no part)."""
    docs = table(spark, sf_dir, "documents").groupBy("doc_id").agg(F.min("text").alias("text"))
    content = F.encode("text", "UTF-8")
    case = F.col("doc_id") % 5
    sha3 = hashing.digest_column(F.when(case == 1, F.concat(content, F.lit(b"x"))).otherwise(content), "sha3")
    size = F.octet_length("text") + F.when(case == 3, 1).otherwise(0)
    payloads = F.struct(F.coalesce(size, F.lit(0)).alias("size"), F.coalesce(hashing.render_hex(sha3), F.lit("0x")).alias("hash"), F.lit("FIPS_202-SHA3-256").alias("hash_type"))
    rev = docs.select(F.col("doc_id").cast("string").alias("tree_id"), F.lit(b"x").alias("link"), F.lit("object").alias("kind"), F.lit(catalogue.link_of_name("file")).alias("revision_type"), F.lit(None).cast("string").alias("parse_error"), F.to_json(F.struct(payloads.alias("payloads"))).alias("raw"))
    rev = materialize(rev, "file_objects")
    files = docs.where("text is not null").select(F.col("doc_id").cast("string").alias("tree_id"), content.alias("content"))
    found = verify.file_faults(rev, files).select(F.col("tree_id").cast("bigint").alias("doc_id"), "code")
    return docs.select("doc_id").join(found, "doc_id", "left").na.fill("", ["code"])


_TYPES = [*("0x1620" + d for d in catalogue.FOUNDATION.values()), *("0x1620" + d for d in catalogue.TIMESTAMPS), "0x1e20" + catalogue.FOUNDATION["file"], "0x1620" + "AB" * 32, "0x1720" + "ab" * 32, "none"]
_KINDS = ["Anchor", "Object", *["Signature"] * 5, "Template", *["Timestamp"] * 3, "Object", "Unknown", "Unknown", "Unknown"]


@query("WITH k AS (SELECT o_orderkey, o_orderkey % 15 AS i FROM orders) SELECT o_orderkey AS link, CASE i " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(_KINDS)) + """ END AS kind,
  i IN (0, 2, 3, 4, 5, 6, 8, 9, 10) AS branch FROM k""")
def named_kinds(spark, sf_dir):
    """What revision types name."""
    which = F.get(F.array(*map(F.lit, _TYPES)), F.col("i").cast("int"))
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("link"), F.pmod("o_orderkey", F.lit(15)).alias("i"))
    rows = rows.withColumn("kind", catalogue.kind_named(which))
    return rows.select("link", "kind", catalogue.is_branch(F.col("kind")).alias("branch"))


@query(f"""WITH p AS (SELECT o_orderkey AS k, o_orderkey % 4 AS t, o_custkey % 5 AS f FROM orders)
SELECT k AS link, CASE WHEN f = 1 THEN 'empty signer_did' WHEN t = 0 AND f = 2 THEN 'empty turn_id' WHEN t = 1 AND f = 2 THEN 'empty session_id' WHEN t = 1 AND f = 3 THEN 'reason' WHEN t = 1 AND f = 4 THEN 'last_turn_id'
  WHEN t = 2 AND f = 2 THEN 'empty session_id' WHEN t = 2 AND f = 3 THEN 'merkle_root' WHEN t = 2 AND f = 4 THEN 'artifact_count' WHEN t = 3 AND f = 2 THEN 'empty prompt_shown' ELSE '' END AS fault FROM p""")
def payload_rules(spark, sf_dir):
    """The first rule that typed payloads break, with faults planted."""
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("link"), (F.col("o_orderkey") % 4).alias("t"), (F.col("o_custkey") % 5).alias("f"))
    name = F.get(F.array(*map(F.lit, ("audit_user_prompt", "audit_session_close", "audit_round_anchor", "audit_hitl_approval"))), F.col("t").cast("int"))
    t, f, good = F.col("t"), F.col("f"), F.lit("0x1620" + "ab" * 32)
    members = {
        "signer_did": F.when(f == 1, "").otherwise("did:x"),
        "session_id": F.when((f == 2) & t.isin(1, 2), "").otherwise("s"),
        "turn_id": F.when((t == 0) & (f == 2), "").otherwise(good),
        "reason": F.when((t == 1) & (f == 3), "bored").otherwise("idle_timeout"),
        "last_turn_id": F.when((t == 1) & (f == 4), "0x12").otherwise(""),
        "leaf_hashes": F.array(good, good),
        "merkle_root": F.when((t == 2) & (f == 3), "0x12").otherwise("0x" + "cd" * 32),
        "artifact_count": F.when((t == 2) & (f == 4), 3).otherwise(2),
        "prompt_shown": F.when((t == 3) & (f == 2), None).otherwise("yes?"),
    }
    payload = F.to_json(F.struct(*(v.alias(k) for k, v in members.items())))
    return p.select("link", F.coalesce(catalogue.payload_fault(name, payload), F.lit("")).alias("fault"))


@query("""WITH c AS (SELECT conv_id, turn, turn // 3 AS g, CASE WHEN (conv_id + turn) % 7 = 0 THEN turn - 1 ELSE turn END AS n FROM (SELECT DISTINCT conv_id, turn FROM conversations)),
l AS (SELECT *, lag(n) OVER (PARTITION BY conv_id, g ORDER BY turn) AS before FROM c) SELECT conv_id, g, turn, n, before FROM l WHERE n <= before""")
def order_lint(spark, sf_dir):
    """Turns whose number does not rise within their group of three."""
    c = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    n = F.when((F.col("conv_id") + F.col("turn")) % 7 == 0, F.col("turn") - 1).otherwise(F.col("turn"))
    return catalogue.order_faults(c.withColumn("g", F.floor(F.col("turn") / 3)).withColumn("n", n), ["conv_id", "g"], ["turn"], "n")


@query("""WITH c AS (SELECT c_custkey AS k, CASE WHEN c_custkey % 5 = 0 THEN 'own' || c_custkey END AS own, c_nationkey AS n FROM customer)
SELECT 'c' || k AS link, coalesce(own, CASE WHEN n % 3 = 0 THEN 'n' || n WHEN n_regionkey % 2 = 0 THEN 'r' || n_regionkey END, 'permissive') AS bounds FROM c JOIN nation ON n = n_nationkey
UNION ALL SELECT 'n' || n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN 'n' || n_nationkey WHEN n_regionkey % 2 = 0 THEN 'r' || n_regionkey ELSE 'permissive' END FROM nation
UNION ALL SELECT 'r' || r_regionkey, CASE WHEN r_regionkey % 2 = 0 THEN 'r' || r_regionkey ELSE 'permissive' END FROM region""")
def bounds_nearest(spark, sf_dir):
    """The bounds of customers, nations and regions as templates that derive from one another."""
    c, n, r = (table(spark, sf_dir, x) for x in ("customer", "nation", "region"))
    text = lambda letter, c: F.concat(F.lit(letter), F.col(c).cast("string"))
    nation = F.when(F.col("n_nationkey") % 3 == 0, text("n", "n_nationkey"))
    region = F.when(F.col("r_regionkey") % 2 == 0, text("r", "r_regionkey"))
    up = n.select("n_nationkey", "n_regionkey")
    own = F.when(F.col("c_custkey") % 5 == 0, F.concat(F.lit("own"), F.col("c_custkey").cast("string")))
    rows = c.join(F.broadcast(up), F.col("c_nationkey") == F.col("n_nationkey")).select(text("c", "c_custkey").alias("link"), own.alias("bounds"), F.array(text("r", "n_regionkey"), text("n", "n_nationkey")).alias("ancestry"))  # 25 nations
    rows = rows.unionByName(n.select(text("n", "n_nationkey").alias("link"), nation.alias("bounds"), F.array(text("r", "n_regionkey")).alias("ancestry")))
    rows = rows.unionByName(r.select(text("r", "r_regionkey").alias("link"), region.alias("bounds"), F.array().cast("array<string>").alias("ancestry")))
    return templates.bounds_of(rows, "permissive")


#: What a turn's revision is, by turn mod 4, and whether it can only be hidden.
_FAMILIES = ("audit_user_prompt", "audit_agent_response", "derived", "unknown")
DERIVED, UNKNOWN = "0x1620" + "d1" * 32, "0x1620" + "d2" * 32


def _selective(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(revisions, entries, leaves): turns as revisions, the first of a conversation the parent of the others, given away under the profile."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn").distinct()
    types = F.array(*(F.lit({"derived": DERIVED, "unknown": UNKNOWN}.get(f) or catalogue.link_of_name(f)) for f in _FAMILIES))
    nonce = F.concat(F.lit("0x"), F.md5(F.concat_ws("/", "conv_id", "turn")))
    payloads = F.struct(F.lit("did:x").alias("signer_did"), F.col("turn").cast("string").alias("turn_id"), F.lit("now").alias("created_at"), F.lit("hidden").alias("secret"))
    method = F.when(F.col("turn") % 8 == 5, "scalar").otherwise("tree")
    kind = F.get(types, (F.col("turn") % 4).cast("int"))

    def made(up: Column) -> Column:
        return F.to_json(F.struct(kind.alias("revision_type"), nonce.alias("nonce"), F.col("turn").alias("local_timestamp"), F.lit("v").alias("version"), method.alias("method"), payloads.alias("payloads"), up.alias("previous_revision")))

    link = lambda: canonical.link_column(F.col("raw"), F.lit("sha3"))["link"]
    first = materialize(rows.where("turn = 0").withColumn("raw", made(F.lit(None).cast("string"))).withColumn("link", link()), "firsts")
    rest = rows.where("turn > 0").join(first.select("conv_id", hashing.render_hex(F.col("link")).alias("up")), "conv_id").withColumn("raw", made(F.col("up"))).drop("up").withColumn("link", link())
    every = first.unionByName(rest)
    rev = materialize(every.select(F.col("conv_id").cast("string").alias("tree_id"), "turn", "link", "raw", F.lit("object").alias("kind"), kind.alias("revision_type"), method.alias("method"), F.lit("sha3").alias("hash_alg"), F.lit(None).cast("string").alias("file_name")), "selective")
    known = [(catalogue.link_of_name(n), None) for n in sorted(catalogue.TYPED)] + [(DERIVED, catalogue.link_of_name("audit_user_prompt"))]
    policy = disclosure.by_profile(rev, spark.createDataFrame(known, "link string, derives_from string"))
    entries, leaves = disclosure.export_selective(rev, materialize(policy, "policy"))
    return rev, materialize(entries, "entries"), materialize(leaves, "leaves")


SELECTIVE_SQL = """s AS (SELECT DISTINCT CAST(conv_id AS VARCHAR) AS tree_id, turn, conv_id % 5 = 0 AS cut FROM conversations WHERE conv_id IN (SELECT conv_id FROM conversations WHERE turn = 0))"""


@query(f"""WITH {SELECTIVE_SQL} SELECT tree_id, turn, CASE WHEN turn % 8 = 5 THEN 'Hidden' ELSE 'FieldRedacted' END AS disclosure,
  CAST(CASE WHEN turn % 8 = 5 THEN 0 ELSE CASE WHEN turn % 4 = 3 THEN 1 ELSE 4 END + CASE WHEN turn > 0 THEN 1 ELSE 0 END END AS BIGINT) AS n_disclosed FROM s""")
def selective_export(spark, sf_dir):
    """How each revision is given away under the profile of the typed payloads, and how many of its leaves are readable."""
    rev, entries, leaves = _selective(spark, sf_dir)
    shown = leaves.where("disclosed").groupBy("tree_id", "link").agg(F.count("*").alias("n_disclosed"))
    out = rev.select("tree_id", "link", "turn").join(entries.select("tree_id", "link", "disclosure"), ["tree_id", "link"]).join(shown, ["tree_id", "link"], "left")
    return out.select("tree_id", "turn", "disclosure", F.coalesce("n_disclosed", F.lit(0)).cast("long").alias("n_disclosed"))


@query(f"""WITH {SELECTIVE_SQL} SELECT tree_id, turn, 'REDACTION_FAILED' AS code FROM s WHERE turn % 10 = 9 AND turn % 4 <> 3 AND turn % 8 <> 5
UNION ALL SELECT tree_id, turn, 'CHAIN_BREAK' FROM s WHERE cut AND turn > 0 AND turn % 8 <> 5""")
def selective_verify(spark, sf_dir):
    """Faults of selective trees: values that were changed, and first revisions that were taken out of one conversation in five."""
    rev, entries, leaves = _selective(spark, sf_dir)
    at = rev.select("tree_id", "link", "turn")
    lied = leaves.join(at, ["tree_id", "link"]).withColumn("value", F.when((F.col("turn") % 10 == 9) & (F.col("pointer") == "/payloads/turn_id") & F.col("disclosed"), '"0"').otherwise(F.col("value")))
    cut = (F.col("tree_id").cast("long") % 5 == 0) & (F.col("turn") == 0)
    kept = entries.join(at, ["tree_id", "link"]).where(~cut).drop("turn")
    found = disclosure.verify_selective(kept, lied.where(~cut).drop("turn"))
    return found.join(at, ["tree_id", "link"]).select("tree_id", "turn", "code")
