"""New revisions: what is made passes verification, and compute sections that contradict themselves are told."""

import hashlib
import json

from pyspark.sql import functions as F

from tallyvine.plans import changes, verify
from tallyvine.sources import records


def as_trees(rows):
    member = F.concat(F.lit('"0x'), F.lower(F.hex("link")), F.lit('":'), "raw")
    return rows.groupBy("tree_id").agg(F.concat(F.lit('{"revisions":{'), F.array_join(F.collect_list(member), ","), F.lit('},"file_index":{}}')).alias("json"))


def test_file_trees_verify(spark):
    data = [("a", "test.txt", b"test content", 1), ("b", "B.JPEG", b"", 2), ("c", None, b"x", 3), ("d", "no", None, 4)]
    made = changes.file_trees(spark.createDataFrame(data, "tree_id string, file_name string, content binary, link int"), 1783616148, "seed")
    raws = {(r["tree_id"], r["pos"]): json.loads(r["raw"]) for r in made.collect()}
    assert set(raws) == {(t, p) for t in "abc" for p in (0, 1)}
    assert raws["a", 1]["payloads"] == {"type": "file", "hash": "0x" + hashlib.sha3_256(b"test content").hexdigest(), "hash_type": "FIPS_202-SHA3-256", "descriptor": "", "size": 12, "content_type": "text/plain"}
    assert raws["b", 1]["payloads"]["content_type"] == "image/jpeg" and raws["c", 1]["payloads"]["content_type"] == "application/octet-stream"
    assert len({r["nonce"] for r in raws.values()}) == 6
    assert raws["a", 0]["local_timestamp"] == raws["a", 1]["local_timestamp"] - 1
    rev = records.decode(as_trees(made))
    assert rev.where("parse_error is null").count() == 6 and verify.hashes(rev).isEmpty() and verify.order(rev).isEmpty()
    tips = made.where("pos = 1").select("tree_id", "link")
    objects = spark.createDataFrame([("a", "0x" + "11" * 32, '{"k": [1]}'), ("new", "0x" + "11" * 32, "{}")], "tree_id string, revision_type string, payloads string")
    more = changes.append_objects(tips, objects, 1783616149, "seed")
    rev = records.decode(as_trees(made.select("tree_id", "link", "raw").unionByName(more.select("tree_id", "link", "raw"))))
    assert rev.where("parse_error is null").count() == 8 and verify.hashes(rev).isEmpty()
    assert changes.without_last(rev, more).count() == 6


def test_compute_faults(spark):
    sha = lambda b: hashlib.sha3_256(b).hexdigest()
    good = {"wasm": "0x0061", "wasm_hash": "0x" + sha(b"\0a").upper(), "source": {"code": "é", "hash": sha("é".encode())}}
    cases = {
        "good": ([good, {k: v for k, v in good.items() if k != "source"}], []),
        "hex": ([good, good | {"wasm": "0x0"}], [(1, "malformed_hex")]),
        "hash": ([good | {"wasm": "00"}], [(0, "module_hash")]),
        "large": ([good | {"wasm": "00" * (changes.MODULE_BYTES + 1)}], [(0, "module_too_large")]),
        "text": ([good | {"source": {"code": "e" * (changes.SOURCE_BYTES + 1), "hash": ""}}], [(0, "source_too_large")]),
        "source": ([good | {"source": {"code": "e", "hash": sha(b"f")}}], [(0, "source_hash")]),
    }
    rows = [(k, json.dumps({"computations": v[0]})) for k, v in cases.items()] + [("none", None), ("broken", "{")]
    got = changes.compute_faults(spark.createDataFrame(rows, "link string, verification string")).collect()
    want = {(k, *x) for k, v in cases.items() for x in v[1]} | {("broken", None, "unreadable")}
    assert {tuple(r) for r in got} == want
