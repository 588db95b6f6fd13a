"""Closures and lineages of templates: parents that are not there, long chains, cycles."""

import json

import pytest

from tallyvine.functions import canonical
from tallyvine.plans import templates, verify
from tallyvine.sources import records

EDGE = "link string, derives_from string"


def test_closure_keeps_absent_parents(spark):
    edges = spark.createDataFrame([("a", "b"), ("x", "y"), ("y", "x")], EDGE)
    used = spark.createDataFrame([("s", "a"), ("s", "x"), (None, "x"), ("t", "z")], "scope string, digest string")
    needed = templates.closure(used, edges)
    assert sorted(map(tuple, needed.collect()), key=str) == sorted([("s", "a"), ("s", "b"), ("s", "x"), ("s", "y"), (None, "x"), (None, "y"), ("t", "z")], key=str)
    present = edges.selectExpr("cast(null as string) as scope", "link as digest")
    assert {tuple(r) for r in templates.missing(needed, present).collect()} == {("s", "b"), ("t", "z")}


def test_closure_of_a_long_chain(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)], EDGE)
    used = spark.createDataFrame([("s", "n0")], "scope string, digest string")
    assert {r["digest"] for r in templates.closure(used, edges).collect()} == {f"n{i}" for i in range(13)}


def test_lineage_marks_where_it_ends(spark):
    edges = spark.createDataFrame([(f"n{i}", f"n{i + 1}") for i in range(12)] + [("n12", None), ("a", "b"), ("x", "y"), ("y", "x")], EDGE)
    got = {(r["link"], r["depth"], r["ancestor"]): r["fault"] for r in templates.lineage(edges).collect()}
    assert [got["n0", i, f"n{i}"] for i in range(13)] == [None] * 13
    assert {k: v for k, v in got.items() if v} == {("a", 1, "b"): "unresolved", ("x", 2, "x"): "cycle", ("y", 2, "y"): "cycle"}
    cut = {(r["link"], r["depth"], r["ancestor"]): r["fault"] for r in templates.lineage(edges, 9).collect()}
    assert cut["n0", 10, "n10"] == "too_deep" and cut["n3", 9, "n12"] is None and ("n0", 11, "n11") not in cut


SCHEMA = {"type": "object", "required": ["a"], "properties": {"a": {"type": "integer"}}}


def template(schema=SCHEMA):
    t = {"revision_type": "0x" + "22" * 32, "nonce": "0x" + "cd" * 16, "local_timestamp": 1, "version": "v", "method": "scalar", "schema": schema}
    return "0x" + canonical.link_of(t, "sha3").hex(), t


def one_object(kind, payload, own=None, leaves=True):
    r = {"revision_type": kind, "nonce": "0x" + "ab" * 16, "local_timestamp": 9, "version": "v", "method": "tree", "payloads": payload}
    link = "0x" + canonical.link_of(r, "sha3").hex()
    if leaves:
        r["leaves"] = ["0x" + x[1].hex() for x in canonical.leaves_of(r, "sha3")]
    return link, {"revisions": {link: r} | (own or {})}


@pytest.fixture
def tampered(spark):
    name, body = template()
    other, _ = template({"type": "array"})
    odd, odd_body = template({"$ref": "#"})
    trees = {
        "good": one_object(name, {"a": 1}), "no leaves": one_object(name, {"a": 1}, leaves=False), "altered": one_object(name, {"a": 1}), "few": one_object(name, {"a": 1}),
        "unknown": one_object(other, {"a": 1}), "malformed": one_object("0x1z", {"a": 1}), "payload": one_object(name, {"a": "x"}), "odd": one_object(odd, {"a": 1}),
    }
    for tree, change in (("altered", lambda x: ["0x" + "00" * 32, *x[1:]]), ("few", lambda x: x[:-1])):
        link, value = trees[tree]
        value["revisions"][link]["leaves"] = change(value["revisions"][link]["leaves"])
    rev = records.decode(spark.createDataFrame([(k, json.dumps(v)) for k, (_, v) in trees.items()], "tree_id string, json string"))
    rows = [(None, bytes.fromhex(n[2:]), canonical.render(b)) for n, b in ((name, body), (odd, odd_body))]
    return rev, spark.createDataFrame(rows, "tree_id string, link binary, raw string")


def test_leaves_and_templates_are_checked(tampered):
    rev, given = tampered
    out, found = verify.verify(rev, templates=given)
    codes = {r["tree_id"]: r["code"] for r in found.collect()}
    assert codes == {
        "no leaves": "LEAVES_MISSING", "altered": "LEAVES_MISMATCH", "few": "LEAVES_COUNT_MISMATCH", "unknown": "TEMPLATE_NOT_FOUND", "malformed": "TEMPLATE_NOT_FOUND",
        "payload": "SCHEMA_OR_CHAIN_FAILED", "odd": "SCHEMA_OR_CHAIN_FAILED",
    }
    assert {(r["tree_id"], r["outcome"], r["n_unchecked"]) for r in out.collect()} == {(t, "failed", 0) for t in codes} | {("good", "verified", 0)}
    offline = {r["tree_id"]: r["outcome"] for r in verify.verify(rev, "offline", templates=given)[0].collect()}
    assert offline["unknown"] == "verified_with_warnings" and offline["payload"] == "failed"


def test_template_that_is_not_what_its_link_names(tampered):
    rev, given = tampered
    lied = given.selectExpr("tree_id", "link", "replace(raw, 'integer', 'string') as raw")
    out = {r["tree_id"]: r["outcome"] for r in verify.verify(rev, templates=lied)[0].collect()}
    assert out["good"] == out["payload"] == "failed"


def test_without_templates_objects_count_as_unchecked(tampered):
    out = {r["tree_id"]: (r["outcome"], r["n_unchecked"]) for r in verify.verify(tampered[0], check_templates=False)[0].collect()}
    assert out["altered"][0] == out["few"][0] == "failed" and out["no leaves"] == out["unknown"] == ("verified", 1)
