"""Orders of trees, batch proofs, policies and known templates on small cases."""

import hashlib
import json

import pytest

from tallyvine.functions import hashing
from tallyvine.plans import batches, catalogue, outcome, topology, verify

REV = "tree_id string, link string, prev string, kind string, ts long"


def revs(spark, rows):
    return spark.createDataFrame([(t, link, prev, kind, 0) for t, link, prev, kind in rows], REV)


def test_chain_and_last_of_odd_trees(spark):
    rows = [
        ("one", "s", None, "signature"), ("none", "b", "x", "object"), ("none", "a", "b", "object"), ("two", "g2", None, "object"), ("two", "g1", None, "anchor"), ("lone", "g", None, "object"),
        ("run", "g", None, "object"), ("run", "t", None, "template"), ("run", "c", "g", "object"), ("run", "b", "g", "signature"), ("gone", None, None, None),
    ]
    df = revs(spark, rows)
    chain = sorted((r["tree_id"], r["pos"], r["link"]) for r in topology.chain(df).collect())
    assert chain == [("lone", 0, "g"), ("none", 0, "a"), ("none", 1, "b"), ("one", 0, "s"), ("run", 0, "g"), ("run", 1, "b"), ("two", 0, "g1")]
    last = {r["tree_id"]: r["link"] for r in topology.last_revision(df).collect()}
    assert last == {"one": "s", "none": "a", "lone": "g", "run": "b"}
    order = sorted((r["tree_id"], r["ord"], r["link"], r["edge_type"]) for r in topology.dag_order(df.where("tree_id = 'run'")).collect())
    assert [x[2:] for x in order] == [("g", "chain"), ("c", "branch"), ("b", "chain"), ("t", "orphan")]
    for f in (topology.chain, topology.last_revision, topology.dag_order, topology.cycle_nodes):
        assert f(df.limit(0)).count() == 0


def test_tree_levels_of_cycles(spark):
    edges = spark.createDataFrame([("r", "a"), ("a", "b"), ("b", "a"), ("r", "c"), ("c", "d"), ("r", "d"), ("d", "d"), ("far", "x")], "tree string, needs string")
    roots = spark.createDataFrame([("r",)], "tree string")
    got = sorted((r["tree"], r["level"], r["fault"]) for r in topology.tree_levels(edges, roots).collect())
    bad = "CROSS_TREE_CYCLE_DETECTED"
    assert got == [("a", None, bad), ("b", None, bad), ("c", 1, None), ("d", 2, None), ("r", 0, None)]
    assert topology.tree_levels(edges.limit(0), roots.limit(0)).count() == 0


def test_levels_and_inclusion(spark):
    from pyspark.sql import functions as F

    sha = lambda c: F.unhex(F.sha2(c, 256))
    rows = [(t, i, bytearray(hashlib.sha256(bytes([t, i])).digest())) for t in range(1, 12) for i in range(t)]
    leaves = spark.createDataFrame(rows, "tree_id int, idx int, node binary")
    nodes = batches.levels(leaves, sha).cache()
    roots = {r["tree_id"]: bytes(r["root"]) for r in batches.roots(nodes).collect()}
    for t in range(1, 12):
        own = [bytes(n) for x, _, n in rows if x == t]
        assert roots[t] == hashing.merkle_root(own, "sha256")
    claims = leaves.unionByName(spark.createDataFrame([(3, 3, rows[0][2]), (5, 1, rows[0][2]), (99, 0, rows[0][2])], leaves.schema))
    got = [(r["tree_id"], r["idx"], r["included"]) for r in batches.included(claims, nodes, sha).collect()]
    assert sorted(x[:2] for x in got if not x[2]) == [(3, 3), (5, 1), (99, 0)] and len(got) == len(rows) + 3
    for r in batches.proofs(nodes).collect():
        own = [bytes(n) for x, _, n in rows if x == r["tree_id"]]
        assert [bytes(p) for p in r["proof"]] == hashing.inclusion_proof(own, r["idx"], "sha256") and r["size"] == len(own)
    assert batches.levels(leaves.limit(0), sha).count() == 0


def test_proof_faults_in_order():
    link, nonce = b"\x16\x20" + bytes(32), "11" * 16
    leaves = [hashing.batch_leaf(link, bytes.fromhex(nonce)), bytes(32), bytes([1]) * 32]
    root = "0x1620" + hashing.merkle_root(leaves).hex()
    good = {"merkle_root": root, "batch_tree_size": 3, "batch_leaf_index": 0, "merkle_proof": ["0x" + p.hex() for p in hashing.inclusion_proof(leaves, 0)], "shielding_nonce": nonce}
    assert batches.proof_fault(good, link.hex()) is None
    single = good | {"batch_tree_size": 1, "batch_leaf_index": 0, "merkle_proof": [], "merkle_root": "1620" + leaves[0].hex()}
    assert batches.proof_fault(single, "0x" + link.hex()) is None
    for change, code in (
        ({"merkle_root": None}, "MERKLE_ROOT_MISSING"), ({"batch_tree_size": "3"}, "BATCH_TREE_SIZE_MISSING"), ({"batch_leaf_index": -1}, "BATCH_LEAF_INDEX_MISSING"), ({"merkle_proof": 1}, "MERKLE_PROOF_MISSING"),
        ({"batch_tree_size": 0, "shielding_nonce": None}, "BATCH_TREE_SIZE_ZERO"), ({"shielding_nonce": None}, "SHIELDING_NONCE_MISSING"), ({"shielding_nonce": "AB" * 16}, "MERKLE_HEX_NOT_LOWERCASE"),
        ({"shielding_nonce": "zz"}, "MERKLE_HEX_DECODE_FAILED"), ({"batch_leaf_index": 3}, "MERKLE_LEAF_INDEX_OUT_OF_BOUNDS"), ({"merkle_root": "1720" + "00" * 32}, "MERKLE_ROOT_BAD_MULTIHASH"),
        ({"merkle_root": "1e20" + "00" * 32}, "MERKLE_ROOT_BAD_CODEC"), ({"merkle_proof": []}, "MERKLE_INCLUSION_FAILED"), ({"batch_tree_size": 1}, "MERKLE_ROOT_MISMATCH"),
    ):
        assert batches.proof_fault(good | change, link.hex()) == code


def test_policies():
    assert outcome.concerns({}) == [] and outcome.concerns(dict.fromkeys(outcome.POINTS, "W")) == []
    assert outcome.concerns({"wasm_untrusted_signer": "W"}) == ["conflicting_wasm_policy", "untrusted_wasm_without_other_relaxation"]
    assert outcome.concerns({"unsigned_template": "W"}) == ["unsigned_weaker_than_untrusted"]
    assert outcome.PRESETS["offline"]["ancestor_template_not_found"] == "F"


def test_names_and_columns(spark):
    from pyspark.sql import functions as F

    rows = [("0x1620" + catalogue.FOUNDATION["template_meta"],), ("0x1620" + hashlib.sha3_256(catalogue.GENESIS_SEED).hexdigest(),), (None,), ("0x16",)]
    df = spark.createDataFrame(rows, "t string")
    assert [r[0] for r in df.select(catalogue.kind_named(F.col("t"))).collect()] == ["Template", "Template", "Unknown", "Unknown"]
    one = spark.createDataFrame([("0xAb", "did:", "/payloads/attached_files/12/hash", "ed25519")], "h string, d string, p string, s string")
    got = one.select(catalogue.lenient_hex(F.col("h")), catalogue.is_identifier(F.col("d")), catalogue.attached_hash(F.col("p")), F.lower(F.hex(catalogue.suite_template(F.col("s"))))).first()
    assert (bytes(got[0]), got[1], got[2], got[3]) == (b"\xab", True, True, catalogue.FOUNDATION["signature_ed25519"])
    assert catalogue.catalogue(spark).count() == 19


@pytest.mark.parametrize("alg,name", [("sha3", "FIPS_202-SHA3-256"), ("blake3", "BLAKE3-256")])
def test_files_by_size_and_digest(spark, alg, name):
    content = b"some bytes"
    payload = {"size": len(content), "hash": "0x" + hashing.digest(content, alg).hex(), "hash_type": name}
    rows = [("a", payload), ("b", payload), ("c", payload | {"size": 3}), ("d", {"size": 1}), ("e", payload | {"hash_type": "md5"})]
    kind = catalogue.link_of_name("file")
    rev = spark.createDataFrame([(t, bytearray(b"x"), "object", kind, json.dumps({"payloads": p}), None) for t, p in rows], "tree_id string, link binary, kind string, revision_type string, raw string, parse_error string")
    files = spark.createDataFrame([("a", bytearray(content)), ("a", bytearray(content)), ("c", bytearray(content)), ("b", bytearray(b"other byte"))], "tree_id string, content binary")
    assert sorted(r["tree_id"] for r in verify.file_faults(rev, files).collect()) == ["b", "c", "d", "e"]


def test_types_that_revisions_count_as(spark):
    from pyspark.sql import functions as F

    from tallyvine.sources import records

    meta, anchor, file = (catalogue.link_of_name(n) for n in ("template_meta", "anchor_template", "file"))
    rows = [("template", "0x00"), ("anchor", file), ("object", file), ("signature", None), ("object", "0x12")]
    df = spark.createDataFrame(rows, "kind string, t string")
    got = df.select(catalogue.type_of(F.col("kind"), F.col("t")).alias("a"), catalogue.named_type(F.col("t")).alias("b")).collect()
    assert [r["a"] for r in got] == [meta, anchor, file, None, "0x12"]
    assert [r["b"] and bytes(r["b"]).hex() for r in got] == [None, file[6:], file[6:], None, None]
    from tallyvine.plans import builtin

    trees = records.template_trees(builtin.templates(spark)).collect()
    assert {r["tree_id"] for r in trees} == {catalogue.link_of_name(n) for n in builtin.bodies()}
