"""Record trees: vectors, tampering, and the queries against their SQL."""

import glob
import hashlib
import json
import os

import pytest

from tallyvine.functions import canonical, hashing, schemas
from tallyvine.plans import disclosure, verify
from tallyvine.sources import records

SF = "/root/testdata/sf0.001"


def object_tree(method="tree", alg="sha3", ts=100):
    """A tree of two objects whose links are right."""
    first = {"revision_type": "0x" + "11" * 32, "nonce": "0x" + "ab" * 16, "local_timestamp": ts, "version": "v", "method": method, "payloads": {"a/b": [1, "x", None], "t": 1.5}}
    link = "0x" + canonical.link_of(first, alg).hex()
    second = first | {"previous_revision": link, "local_timestamp": ts + 1}
    return {"revisions": {link: first, "0x" + canonical.link_of(second, alg).hex(): second}, "file_index": {link: "a.txt"}}


def test_blake3_vectors():
    assert hashing.blake3(b"").hex() == "af1349b9f5f9a1a6a0404dea36dcc9499bcb25c9adc112b7cc9a93cae41f3262"
    data = bytes(i % 251 for i in range(1025))
    assert hashing.blake3(data).hex() == "d00278ae47eb27b34faecf67b4fe263f82d5412916c1ffd97c8cb7fb814b8444"


def test_inclusion_every_size_and_place():
    for n in range(1, 20):
        leaves = [bytes([i]) * 32 for i in range(n)]
        root = hashing.merkle_root(leaves)
        for i in range(n):
            proof = hashing.inclusion_proof(leaves, i)
            assert hashing.verify_inclusion(leaves[i], i, n, proof, root)
            assert not hashing.verify_inclusion(leaves[i], i, n, [*proof, bytes(32)], root)
            assert not hashing.verify_inclusion(b"\xff" * 32, i, n, proof, root)
    assert hashing.merkle_root([]) is None


def test_link_errors_in_order():
    good = b"\x16\x20" + bytes(32)
    cases = [(good, None), (b"", "truncated"), (b"\x17\x20" + bytes(32), "unknown_code"), (b"\x16\x21" + bytes(33), "wrong_length"), (good[:-1], "truncated"), (good + b"x", "trailing"), (b"\x96\x00\x20" + bytes(32), "non_minimal")]
    for link, want in cases:
        assert hashing.link_error(link) == want


def test_pointers_and_rendering():
    value = canonical.load('{"b": {"~/": 1}, "a": [true, 1e16, 2]}')
    assert [p for p, _ in canonical.pointer_map(value)] == ["", "/a", "/a/0", "/a/1", "/a/2", "/b", "/b/~0~1"]
    assert canonical.render({"x": [1, 1.0, "é", None]}) == '{"x":[1,1.0,"é",null]}'
    for bad in ('{"a":1,"a":2}', "[NaN]", "{"):
        with pytest.raises(canonical.Refused):
            canonical.load(bad)


def test_schema_subset():
    schema = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer", "minimum": 2}}, "additionalProperties": False}
    assert schemas.problems(schema, {"a": 2}) == []
    assert schemas.problems(schema, {"a": 1, "b": 0}) == ["/a: minimum", "/b: false"]
    assert schemas.problems({"const": 1}, True) == [": const"]
    with pytest.raises(canonical.Refused):
        schemas.problems({"$ref": "#"}, 1)
    parent = json.dumps({"properties": {"a": {"minimum": 2, "enum": [2, 3]}}})
    assert schemas.narrowing_fault(parent, json.dumps({"properties": {"a": {"minimum": 3, "enum": [3]}}})) is None
    assert schemas.narrowing_fault(parent, json.dumps({"properties": {"b": {}}})) == "b: property"
    assert schemas.narrowing_fault(parent, json.dumps({"properties": {"a": {"minimum": 1, "enum": [2]}}})) == "a: minimum"


def test_verify_and_tamper(spark):
    good, blake = object_tree(), object_tree("scalar", "blake3")
    tampered = json.loads(json.dumps(good))
    list(tampered["revisions"].values())[0]["payloads"]["t"] = 2.5
    orphan = {"revisions": dict(list(good["revisions"].items())[1:])}
    late = object_tree(ts=50)
    keys = list(late["revisions"])
    moved = late["revisions"][keys[1]] | {"local_timestamp": 1}
    late["revisions"] = {keys[0]: late["revisions"][keys[0]], "0x" + canonical.link_of(moved, "sha3").hex(): moved}
    unknown = json.loads(json.dumps(good))
    list(unknown["revisions"].values())[0]["extra"] = 1
    trees = {"good": good, "blake": blake, "tampered": tampered, "orphan": orphan, "late": late, "unknown": unknown}
    rows = [(k, json.dumps(v)) for k, v in trees.items()] + [("null", None), ("text", "{")]
    rev = records.decode(spark.createDataFrame(rows, "tree_id string, json string"))
    out, found = verify.verify(rev, check_templates=False)  # no such template is known
    got = {r["tree_id"]: r["outcome"] for r in out.collect()}
    assert got == {"good": "verified", "blake": "verified"} | dict.fromkeys(("tampered", "orphan", "late", "unknown", "null", "text"), "failed")
    codes = {(r["tree_id"], r["code"]) for r in found.collect()}
    assert ("tampered", "HASH_VERIFICATION_FAILED") in codes and ("late", "SCHEMA_OR_CHAIN_FAILED") in codes
    assert records.decode(spark.createDataFrame([], "tree_id string, json string")).count() == 0


def test_redaction_stays_verifiable(spark):
    rev = records.decode(spark.createDataFrame([("t", json.dumps(object_tree()))], "tree_id string, json string"))
    paths = rev.selectExpr("tree_id", "link", "case when prev is null then array('/payloads/t') else array('/nope') end as pointers")
    leaves = disclosure.redact(rev, paths).cache()
    rows = leaves.collect()
    shown = [r for r in rows if r["disclosed"]]
    assert [(r["pointer"], r["value"]) for r in shown] == [("/payloads/t", "1.5")]
    assert {r["error"] for r in rows if r["error"]} == {"FIELD_NOT_FOUND"}
    assert [r["ok"] for r in disclosure.verify_redacted(leaves).collect()] == [True]
    lied = leaves.selectExpr("tree_id", "link", "idx", "pointer", "disclosed", "if(disclosed, '9', value) as value", "salt", "value_commit", "error")
    assert [r["ok"] for r in disclosure.verify_redacted(lied).collect()] == [False]


def test_merkle_columns_agree(spark):
    from pyspark.sql import functions as F

    rows = [([hashlib.sha256(bytes([i, n])).digest() for i in range(n)],) for n in range(1, 12)]
    df = spark.createDataFrame(rows, "leaves array<binary>")
    for r in df.select("leaves", hashing.merkle_root_sql(F.col("leaves")).alias("a"), hashing.merkle_root_column(F.col("leaves"), "sha256").alias("b")).collect():
        assert bytes(r["a"]) == bytes(r["b"]) == hashing.merkle_root([bytes(x) for x in r["leaves"]], "sha256")


def _names():
    from tallyvine.operators.queries import ORACLE_SQL

    return sorted(ORACLE_SQL)


@pytest.mark.parametrize("name", _names())
def test_query_equals_sql(spark, name):
    import duckdb

    from tallyvine.operators import queries

    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    a, b = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.ORACLE_SQL[name]).df()
    cols = sorted(a.columns)
    assert cols == sorted(b.columns)
    assert sorted(map(tuple, a[cols].astype(str).values)) == sorted(map(tuple, b[cols].astype(str).values))
