"""What must hold for tables of any size: work dealt over tasks, batches of bounded size, joins that are shuffled, and the work done once."""

import json

import pytest
from pyspark.sql import functions as F

from tallyvine import session
from tallyvine.functions import canonical
from tallyvine.functions import hashing as H
from tallyvine.operators import queries, write_queries
from tallyvine.plans import batches, catalogue, changes, disclosure, outcome, templates, topology, verify


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def typed(spark, n: int):
    body = {"revision_type": catalogue.link_of_name("audit_user_prompt"), "nonce": "0x" + "01" * 16, "local_timestamp": 1, "version": "v", "method": "tree", "payloads": {"signer_did": "x", "secret": "s"}}
    return spark.range(n).select(F.col("id").cast("string").alias("tree_id"), F.lit(b"x").alias("link"), F.lit("object").alias("kind"), F.lit(body["revision_type"]).alias("revision_type"), F.lit("sha3").alias("hash_alg"), F.lit(json.dumps(body)).alias("raw"))


def test_rows_of_one_partition_are_dealt_over_tasks(spark):
    rows = session.spread(spark.range(0, 20000, 1, 1), "id")
    assert rows.rdd.getNumPartitions() > 4
    assert rows.count() == 20000


def test_pointers_are_picked_where_the_revision_is(spark):
    policy = disclosure.pseudonymous(typed(spark, 3))
    assert "Exchange" not in plan(policy)
    assert {tuple(r["pointers"]) for r in policy.collect()} == {("/payloads/signer_did",)}


def test_workers_get_batches_of_bounded_size(spark, tmp_path):
    keys = ("spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch")
    before = {k: spark.conf.get(k, None) for k in keys}
    seen = F.pandas_udf(lambda x: x * 0 + len(x), "long")
    try:
        for k in keys:
            spark.conf.unset(k)
        spark.range(0, 30000, 1, 1).select(F.col("id").alias("doc_id"), F.repeat(F.lit("x"), 20000).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
        docs = queries.table(spark, str(tmp_path), "documents")
        assert docs.select(seen("doc_id").alias("n")).agg(F.max("n")).first()[0] <= session.BATCH_ROWS
        long = docs.select(F.pandas_udf(lambda x: x.str.len() * 0 + len(x), "long")("text").alias("n"))
        assert long.agg(F.max("n")).first()[0] <= session.BATCH_BYTES // 20000 + 1
        spark.conf.set(keys[0], "10")
        session.small_batches(spark)
        assert spark.conf.get(keys[0]) == "10"
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)


def test_batches_leave_tasks_in_slices():
    frames = list(canonical.sliced(((i,) for i in range(10)), ["a"], most=4))
    assert [len(f) for f in frames] == [4, 4, 2]
    assert [x for f in frames for x in f["a"]] == list(range(10))


def test_a_text_is_read_once_a_batch():
    calls = []
    f = canonical.remembered(lambda x: calls.append(x) or 1 / x)
    assert [f(2), f(2)] == [0.5, 0.5]
    for _ in range(2):
        with pytest.raises(ZeroDivisionError):
            f(0)
    assert calls == [2, 0]


def test_a_revision_by_the_tree_method_is_hashed_once(spark):
    made = changes.file_trees(spark.sql("SELECT '1' AS tree_id, 'a.txt' AS file_name, X'61' AS content"), 50, "a", "tree")
    assert plan(made).count("ArrowEvalPython") == 3  # the content, the anchor, the object
    rows = made.collect()
    assert len(rows) == 2
    for r in rows:
        value = json.loads(r["raw"])
        assert bytes(r["link"]) == canonical.link_of(value, "sha3")
        assert value["leaves"] == ["0x" + x[1].hex() for x in canonical.leaves_of(value, "sha3")]
    rev = session.materialize(typed(spark, 3).withColumn("method", F.lit("tree")).withColumn("parse_error", F.lit(None).cast("string")), "rows")
    assert plan(verify.contents(rev)).count("ArrowEvalPython") == 1
    assert {(r["stage"], r["code"]) for r in verify.contents(rev).collect()} == {(1.0, "HASH_VERIFICATION_FAILED"), (1.0, "LEAVES_MISSING")}


def test_a_proof_is_checked_once(spark):
    stamp = {"link": b"x", "kind": "object", "revision_type": "0x1620" + min(catalogue.TIMESTAMPS), "raw": '{"payloads":{}}', "parse_error": None}
    rev = session.materialize(spark.createDataFrame([stamp | {"tree_id": "1", "prev": b"y"}], "tree_id string, link binary, kind string, revision_type string, prev binary, raw string, parse_error string"), "rows")
    assert plan(verify.batch_proofs(rev)).count("ArrowEvalPython") == 1
    assert verify.batch_proofs(rev).count() == 1


def test_no_side_that_grows_is_broadcast(spark):
    rev = session.materialize(typed(spark, 5).withColumn("prev", F.lit(b"y")).withColumn("ts", F.lit(1)), "rows")
    found = rev.select("tree_id", F.lit(1.0).alias("stage"), F.lit("HASH_VERIFICATION_FAILED").alias("code"), "link")
    wanted = rev.select(F.col("tree_id").alias("scope"), F.col("link").alias("digest"))
    own = wanted.withColumn("template", F.lit("{}"))
    parts = [topology.missing_parents(rev), topology.timestamp_violations(rev), outcome.gate(found), outcome.outcomes(rev, found), verify.dangling_links(rev.withColumn("structural_links", F.array("link")), rev.select("tree_id", F.col("prev").alias("target")))]
    for df in parts:
        text = plan(df)
        assert "SortMergeJoin" in text
        assert "BroadcastHashJoin" not in text.replace("BroadcastHashJoin [target", "")  # what has no tree is built in
    assert "SortMergeJoin" in plan(templates.resolve(wanted, own))


def test_inclusion_shuffles_a_tree_once(spark):
    sha = lambda x: F.unhex(F.sha2(x, 256))
    sizes = F.element_at(F.array(*map(F.lit, [1, 2, 3, 7, 64, 65, 130])), (F.col("id") + 1).cast("int"))
    rows = spark.range(7).select(F.col("id").alias("tree_id"), F.explode(F.sequence(F.lit(0), sizes - 1)).alias("idx"))
    leaves = rows.withColumn("node", sha(F.concat_ws("/", "tree_id", "idx")))
    lied = F.when(F.col("idx") % 3 == 1, sha(F.col("node"))).otherwise(F.col("node"))
    claims = leaves.withColumn("node", lied).unionByName(spark.sql("SELECT 3L AS tree_id, 7 AS idx, X'00' AS node UNION ALL SELECT 3L, -1, X'00' UNION ALL SELECT 99L, 0, X'00' UNION ALL SELECT 6L, 130, X'00'"))
    nodes = session.materialize(batches.levels(leaves, sha), "nodes")
    made = {(r["tree_id"], r["idx"]): bytes(r["node"]) for r in leaves.collect()}
    roots = {r["tree_id"]: bytes(r["root"]) for r in batches.roots(nodes).collect()}
    assert roots == {t: H.merkle_root([made[t, i] for i in range(n)], "sha256") for t, n in enumerate([1, 2, 3, 7, 64, 65, 130])}
    key = lambda df: sorted((r["tree_id"], r["idx"], r["included"]) for r in df.collect())
    got = key(batches.included_in(claims, leaves, sha))
    assert got == key(batches.included(claims, nodes, sha))
    assert got == sorted((t, i, (t, i) in made and i % 3 != 1) for t, i in [*made, (3, 7), (3, -1), (99, 0), (6, 130)])
    few = session.materialize(leaves.where("tree_id < 4"), "few")
    text = plan(batches._whole(batches._apart(few)[0], sha))
    assert text.count("Exchange hashpartitioning(tree_id") == 2 == text.count("Exchange ")


def test_views_are_sealed_in_one_pass(spark, monkeypatch):
    """A new revision's link and view come from hashing its leaves once: the same link and readable leaves as by redact(), nothing shuffled by leaf, and a view that was changed does not hold."""
    rev = typed(spark, 5).withColumn("raw", F.replace("raw", F.lit("01" * 16), F.md5("tree_id")))
    rev = rev.withColumn("link", canonical.link_column(F.col("raw"), F.col("hash_alg"))["link"]).cache()
    own = rev.select("link", "raw", "hash_alg", "revision_type")
    views = disclosure.sealed_views(own.withColumnRenamed("link", "was"), disclosure.pseudonymous_patterns(), "was").cache()
    assert views.where("link = was").count() == rev.count() and views.where("error is not null").count() == 0
    policy = disclosure.pseudonymous(rev)
    want = {(bytes(r["link"]), r["pointer"]): (r["value"], r["salt"], r["value_commit"]) for r in disclosure.redact(rev, policy).collect()}
    got = {(bytes(r["link"]), p): x for r in views.where("pointers is not null").collect() for p, *x in zip(r["pointers"], r["shown"], r["salts"], r["commits"])}
    assert {k: tuple(x) for k, x in got.items()} == want and any(v[0] for v in want.values())
    ok = lambda *c: [r[0] for r in views.where("pointers is not null").select(disclosure.view_holds(*c)).collect()]
    link, pointers, shown, salts, commits = (F.col(c) for c in ("link", "pointers", "shown", "salts", "commits"))
    assert set(ok(link, pointers, shown, salts, commits)) == {True}
    assert set(ok(link, pointers, F.transform(shown, lambda v: F.concat(v, F.lit(" "))), salts, commits)) == {False}
    assert set(ok(link, F.reverse(pointers), shown, salts, commits)) == {False}
    assert set(ok(link, pointers, F.slice(shown, 1, 2), salts, commits)) == {False}
    other = disclosure.sealed_views(own.withColumnRenamed("link", "was").withColumn("revision_type", F.lit("another")), disclosure.pseudonymous_patterns(), "was")
    assert other.where("pointers is null and error is null").count() == rev.count()
    with monkeypatch.context() as m:  # the whole query: no leaf leaves its row
        m.setattr(write_queries, "table", lambda s, d, n: s.range(40).select(F.col("id").alias("o_orderkey")))
        out = write_queries.pseudonymous_view(spark, "")
        assert sorted((r["id"], r["redacted"], r["ok"]) for r in out.collect()) == [(i, i % 8 < 7, i % 8 < 7) for i in range(40)]
        assert "Join" not in plan(out) and "Aggregate" not in plan(out)
