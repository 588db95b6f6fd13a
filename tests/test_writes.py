"""Audits, exports, links and round anchors on small cases: what is missing, what goes in circles, what is refused."""

import hashlib
import json

from tallyvine.functions import canonical, hashing
from tallyvine.plans import audit, batches, builtin, catalogue, changes, export, narrowing, verify
from tallyvine.sources import records


def template(**more):
    t = {"revision_type": audit.GENESIS_TYPE, "nonce": "0x" + "01" * 16, "local_timestamp": 1, "version": "v", "method": "scalar", "schema": {"type": "object"}} | more
    return canonical.link_of(t, "sha3"), t


def text(link):
    return "0x" + link.hex()


def test_audit_of_odd_catalogues(spark):
    meta, meta_body = template()
    root, root_body = template(revision_type=text(meta), nonce="0x" + "02" * 16)
    child, child_body = template(revision_type=text(meta), nonce="0x" + "03" * 16, derives_from=text(root), ancestry=[text(root)])
    lost, lost_body = template(revision_type=text(meta), nonce="0x" + "04" * 16, derives_from="0x1620" + "55" * 32, ancestry=["0x1620" + "55" * 32])
    # two that derive from each other's kept links, and one below them
    a, b = b"\x16\x20" + b"a" * 32, b"\x16\x20" + b"b" * 32
    _, a_body = template(revision_type=text(meta), nonce="0x" + "05" * 16, derives_from=text(b), ancestry=[text(b)])
    _, b_body = template(revision_type=text(meta), nonce="0x" + "06" * 16, derives_from=text(a), ancestry=[text(a)])
    c, c_body = template(revision_type=text(meta), nonce="0x" + "07" * 16, derives_from=text(a), ancestry=[text(a)])
    rows = [("s", "template_meta", meta, meta_body), ("s", "root", root, root_body), ("s", "child", child, child_body), ("s", "lost", lost, lost_body), ("s", "a", a, a_body), ("s", "b", b, b_body), ("s", "c", c, c_body)]
    rows = [(s, n, bytearray(k), canonical.render(v)) for s, n, k, v in rows] + [("s", "text", bytearray(root), "{"), ("s", "null", None, None)]
    # another scope without a first template: its types are not asked for, and a parent is found by the link it was kept under
    moved = root_body | {"local_timestamp": 7}
    rows += [("t", "root", bytearray(root), canonical.render(moved)), ("t", "child", bytearray(child), canonical.render(child_body | {"revision_type": "0x" + "77" * 34}))]
    schema = "scope string, name string, link binary, raw string"
    got = {(r["scope"], r["name"]): r for r in audit.audit(spark.createDataFrame(rows, schema)).collect()}
    assert len(got) == len(rows)
    of = lambda s, n: tuple(got[s, n][x] for x in ("level", "drift", "stale_type", "stale_line", "fault"))
    clean = (False, False, False, None)
    assert of("s", "template_meta") == of("s", "root") == (0, *clean) and of("s", "child") == (1, *clean)
    assert of("s", "lost") == (0, False, False, False, "unresolved")
    assert {n: of("s", n)[0::4] for n in "abc"} == dict.fromkeys("abc", (None, "cycle")) and all(got["s", n]["new_link"] is None for n in "abc")
    assert of("s", "text")[4] == of("s", "null")[4] == "unreadable"
    assert of("t", "root") == (0, True, False, False, None) and of("t", "child") == (1, True, False, True, None)
    new_root = canonical.link_of(moved, "sha3")
    mended = child_body | {"revision_type": "0x" + "77" * 34, "derives_from": text(new_root), "ancestry": [text(new_root)]}
    assert bytes(got["t", "root"]["new_link"]) == new_root and bytes(got["t", "child"]["new_link"]) == canonical.link_of(mended, "sha3")
    assert json.loads(got["t", "child"]["raw"]) == mended
    assert audit.audit(spark.createDataFrame([], schema)).count() == 0


def an_object(kind):
    r = {"revision_type": kind, "nonce": "0x" + "ab" * 16, "local_timestamp": 9, "version": "v", "method": "scalar", "payloads": {}}
    return text(canonical.link_of(r, "sha3")), r


def test_exports_are_whole_or_refused(spark):
    root, root_body = template()
    child, child_body = template(nonce="0x" + "03" * 16, derives_from=text(root), ancestry=[text(root)])
    gap, gap_body = template(nonce="0x" + "04" * 16, derives_from="0x1620" + "55" * 32)  # named by derives_from alone
    trees = {"good": dict([an_object(text(child))]), "gap": dict([an_object(text(gap))]), "built in": dict([an_object(catalogue.link_of_name("signature_ed25519"))]), "file": dict([an_object(catalogue.link_of_name("file"))]), "none": {}}
    trees["bare"] = dict([an_object("0x" + child[2:].hex())])
    rev = records.decode(spark.createDataFrame([(k, json.dumps({"revisions": v})) for k, v in trees.items()] + [("text", "{")], "tree_id string, json string"))
    extra = spark.createDataFrame([(bytearray(root), canonical.render(root_body)), (bytearray(child[2:]), canonical.render(child_body)), (bytearray(gap), canonical.render(gap_body))], "link binary, raw string")
    names = spark.createDataFrame([(bytearray(root), "the root")], "link binary, file_name string")
    rows, refused = export.self_describing(rev, extra, names)
    got = {}
    for r in rows.collect():
        got.setdefault(r["tree_id"], []).append((bytes(r["link"]), r["embedded"], r["file_name"]))
    label = "template_" + child.hex()[:8]
    assert sorted((link, name) for link, new, name in got["good"] if new) == sorted([(root, "the root"), (child, label)])
    assert {link for link, new, _ in got["bare"] if new} == {root, child}
    assert [new for _, new, _ in got["file"]] == [False]
    base = catalogue.link_of_name("signature_base")
    missing = {(r["tree_id"], r["missing"] and text(bytes(r["missing"]))) for r in refused.collect()}
    assert missing == {("gap", "0x1620" + "55" * 32), ("built in", base), ("text", None)} and not {"gap", "built in", "text"} & set(got)
    with_files, _ = export.self_describing(rev, extra, include_builtin=True)
    assert [r["file_name"] for r in with_files.where("tree_id = 'file' and embedded").collect()] == ["file"]
    again = records.decode(export.as_trees(rows))
    assert not export.self_describing(again)[0].where("embedded").count()
    assert {r["outcome"] for r in verify.verify(again, policy="offline")[0].where("tree_id = 'good'").collect()} == {"verified"}
    assert export.self_describing(rev.limit(0), extra)[0].count() == 0


def test_links_and_their_refusals(spark):
    ends = spark.createDataFrame([(t, bytearray(b"\x16\x20" + t.encode() * 32)) for t in "abcd"], "tree_id string, link binary")
    names = spark.createDataFrame([("a", "a.txt"), ("b", "b.txt"), ("c", None)], "tree_id string, main_file string")
    rows = [("a", "b", 2), ("a", "a", 1), ("a", "b", 2), ("a", "x", 0), ("b", "x", 0), ("c", "d", 0), ("d", "b", 0), ("d", "c", 1), ("y", "a", 0)]
    links = spark.createDataFrame(rows, "tree_id string, linked_id string, ordinal int")
    for method in ("scalar", "tree"):
        made, files, refused = changes.link_trees(ends, links, names, 50, "s", method)
        assert {(r["tree_id"], r["fault"]) for r in refused.collect()} == {("b", "no_links"), ("c", "no_file_name"), ("d", "no_file_name"), ("y", "no_end")}
        (row,) = made.collect()
        body = json.loads(row["raw"])
        assert [(x["hash"][6:8], x["role"]) for x in body["compositional_links"]] == [("61", "composition"), ("62", "composition")]
        assert body["structural_links"] == [] and body["previous_revision"] == text(b"\x16\x20" + b"a" * 32) and ("leaves" in body) == (method == "tree")
        assert canonical.link_of(body, "sha3") == bytes(row["link"])
        assert {(r["tree_id"], r["file_name"]) for r in files.collect()} == {("a", "a.txt"), ("a", "b.txt")}
        assert changes.link_trees(ends, links.limit(0), names, 50, "s", method)[0].count() == 0


def test_round_anchors(spark):
    sha3 = lambda x: hashing.digest_column(x, "sha3")
    links = [b"\x16\x20" + hashlib.sha256(bytes([i])).digest() for i in range(5)]
    leaf = lambda x: hashlib.sha3_256(b"\x00" + x).digest()
    root = text(hashing.merkle_root([leaf(x) for x in links], "sha3"))
    said = [("good", 5, [text(x) for x in links], root), ("none", 0, [], None), ("null", None, None, None), ("order", 5, [text(x) for x in links[::-1]], root), ("root", 5, [text(x) for x in links], "0x")]
    rows = [(t, i, bytearray(x)) for t in ("good", "null", "order", "root", "other") for i, x in enumerate(links)]
    got = batches.round_anchors(spark.createDataFrame(said, "turn_id string, artifact_count int, leaf_hashes array<string>, merkle_root string"), spark.createDataFrame(rows, "turn_id string, seq int, link binary"), sha3).collect()
    assert {r["turn_id"]: r["fault"] for r in got} == {"good": None, "none": "empty", "null": "artifact_count", "order": "leaf_hashes", "root": "merkle_root"}


def test_first_violations_of_narrowing(spark):
    """Several violations: the first by rule, property and keyword stands; what is no schema has no properties."""
    parent = {"required": ["b", "a"], "properties": {"a": {"minimum": 1, "enum": [1, "1", {"x": 1, "y": 2}], "const": None}, "b": {"maxLength": 5, "pattern": "x"}, "c": {}}}
    cases = {
        "same": (parent, None), "twice new": ({"properties": {"z": {}, "y": {}}}, ("new_property", "y", None)), "none left": ({}, ("removed_required", "b", None)),
        "types": ({"required": ["b", "a"], "properties": {"a": {"minimum": 1, "enum": ["1"], "const": None}}}, None), "other type": ({"required": ["b", "a"], "properties": {"a": {"minimum": 1, "enum": [2], "const": None}}}, ("widened", "a", "enum")),
        "keys": ({"required": ["b", "a"], "properties": {"a": {"minimum": 1.0, "enum": [{"y": 2, "x": 1}], "const": None}}}, None), "no const": ({"required": ["b", "a"], "properties": {"a": {"minimum": 1, "enum": [1]}}}, ("widened", "a", "const")),
        "const for bounds": ({"required": ["b", "a"], "properties": {"b": {"const": "xx"}}}, None), "dropped": ({"required": ["b", "a"], "properties": {"b": {}, "c": {"minimum": 4}}}, ("widened", "b", "maxLength")),
        "true": ({"required": ["b", "a"], "properties": {"c": True}}, None), "list": ([], ("removed_required", "b", None)),
    }
    rows = [(k, json.dumps(parent), json.dumps(child)) for k, (child, _) in cases.items()] + [("null", json.dumps(parent), None), ("no parent", None, '{"properties": {"q": {}}}'), ("neither", None, "{")]
    got = {r["id"]: (r["fault"], r["field"], r["word"]) for r in narrowing.faults(spark.createDataFrame(rows, "id string, parent string, child string")).collect()}
    want = {k: w for k, (_, w) in cases.items() if w} | {"null": ("removed_required", "b", None), "no parent": ("new_property", "q", None)}
    assert got == want


def test_derived_templates_verify(spark):
    """A template derived from one that a tree holds is a template of that tree, and its objects are held against it."""
    root, root_body = template(schema={"type": "object", "properties": {"n": {"maximum": 9}}})
    parents = spark.createDataFrame([(bytearray(root), canonical.render(root_body))], "link binary, raw string")
    children = spark.createDataFrame([(1, bytearray(root), json.dumps({"type": "object", "properties": {"n": {"maximum": 5}}})), (2, bytearray(root), "{"), (3, bytearray(b"x"), "{}")], "id int, parent binary, schema string")
    made, rejects = narrowing.derive(parents, children, 3, "s")
    assert {(r["id"], r["fault"]) for r in rejects.collect()} == {(2, "no_schema"), (3, "unresolved")}
    (row,) = made.collect()
    trees = {}
    for name, n in (("good", 5), ("bad", 6)):
        r = {"revision_type": text(bytes(row["link"])), "nonce": "0x" + "ab" * 16, "local_timestamp": 9, "version": "v", "method": "scalar", "payloads": {"n": n}}
        trees[name] = {"revisions": {text(canonical.link_of(r, "sha3")): r, text(bytes(row["link"])): json.loads(row["raw"]), text(root): root_body}}
    rev = records.decode(spark.createDataFrame([(k, json.dumps(v)) for k, v in trees.items()], "tree_id string, json string"))
    assert {r["tree_id"]: r["outcome"] for r in verify.verify(rev)[0].collect()} == {"good": "verified", "bad": "failed"}


def test_built_in_bodies_are_known(spark):
    assert {bytes(r["link"]) for r in builtin.templates(spark).collect()} < {bytes(r["link"]) for r in catalogue.catalogue(spark).collect()}


def test_functions_by_name(spark):
    from pyspark.sql import functions as F

    from tallyvine.functions import sql

    sql.register(spark)
    good, body = template()
    kinds = [None, "none", "0x1620" + "AB" * 32, *("0x1620" + d for d in (*catalogue.FOUNDATION.values(), *catalogue.TIMESTAMPS)), "0x1620" + "ab" * 32, audit.GENESIS_TYPE]
    df = spark.createDataFrame([(k,) for k in kinds], "t string").select(F.expr("rev_kind(t)").alias("a"), catalogue.kind_named(F.col("t")).alias("b"))
    assert all(r["a"] == r["b"] for r in df.collect())
    rows = [(canonical.render(body), bytearray(good)), ("{", bytearray(good[2:])), (None, None), ("{}", bytearray(b"\x17\x20" + bytes(32)))]
    spark.createDataFrame(rows, "raw string, link binary").createOrReplaceTempView("some_links")
    got = spark.sql("SELECT rev_link(raw, 'sha3') AS made, bare_digest(link) AS bare, multihash_error(link) AS error, merkle_root(array(link)) AS root, schema_problems('{\"type\": \"array\"}', raw) AS problems FROM some_links").collect()
    assert [r["made"] for r in got][:3] == [text(good), None, None] and [r["bare"] and bytes(r["bare"]) for r in got] == [good[2:], good[2:], None, None]
    assert [r["error"] for r in got] == [None, hashing.link_error(good[2:]), "missing", "unknown_code"]
    assert bytes(got[0]["root"]) == good and [r["problems"] for r in got] == [[": type"], ["unchecked"], ["unchecked"], [": type"]]
    flat = spark.sql("SELECT p.idx, p.pointer, p.value, p.error FROM VALUES ('{\"b\": [1, null], \"a\": \"x\"}'), ('{') AS t(raw), LATERAL flatten_pointers(raw) AS p").collect()
    assert sorted((r["idx"], r["pointer"], r["value"]) for r in flat if r["error"] is None) == [(0, "", "{}"), (1, "/a", '"x"'), (2, "/b", "[]"), (3, "/b/0", "1"), (4, "/b/1", "null")]
    assert [r["error"] for r in flat if r["error"]] == ["invalid JSON"]


def test_objects_after_ends(spark):
    """Built-in templates, templates that the tree itself holds, ends and names; without the check only built-in payloads are looked at."""
    from tallyvine.plans import create

    own, body = template(schema={"type": "object", "properties": {"n": {"type": "integer"}}})
    held = {"revisions": {text(own): body}}
    rev = records.decode(spark.createDataFrame([("t", json.dumps(held))], "tree_id string, json string"))
    ends = spark.createDataFrame([("t", bytearray(own))], "tree_id string, link binary")
    file = catalogue.link_of_name("file")
    rows = [(1, "t", text(own), '{"n": 1}', "one"), (2, "u", text(own), '{"n": 1}', None), (3, "t", file, '{"n": 1}', None), (4, "t", text(own), None, None), (5, None, None, "1", None)]
    wanted = spark.createDataFrame(rows, "id int, tree_id string, revision_type string, payloads string, file_name string")
    made, rejects = create.objects(wanted, ends, rev, 9, "s")
    assert {r["id"]: r["fault"] for r in rejects.collect()} == {2: "TEMPLATE_NOT_FOUND", 3: "SCHEMA_VIOLATION", 4: "METHOD", 5: "TEMPLATE_NOT_FOUND"}
    (row,) = made.collect()
    value = json.loads(row["raw"])
    assert (row["id"], row["file_name"], value["previous_revision"], value["payloads"]) == (1, "one", text(own), {"n": 1}) and canonical.link_of(value, "sha3") == bytes(row["link"])
    made, rejects = create.objects(wanted.where("id < 4"), ends, rev, 9, "s", check=False)
    assert {r["id"] for r in made.collect()} == {1, 2} and {r["id"]: r["fault"] for r in rejects.collect()} == {3: "SCHEMA_VIOLATION"}
