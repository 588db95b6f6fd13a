"""Record trees as tables: strict decoding of JSON trees into one row a revision, and ordered export."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.canonical import Refused, load, render, sliced

REVISIONS = (
    "tree_id string, link binary, hash_alg string, kind string, prev binary, revision_type string, nonce binary, ts decimal(20,0), version string, "
    "method string, leaves array<string>, signer string, structural_links array<binary>, compositional_links array<struct<hash: binary, role: string>>, "
    "file_name string, raw string, parse_error string"
)
HEX = re.compile("0x(?:[0-9a-f]{2})*")
# The members that each kind of revision must and may have.
COMMON = {"revision_type", "nonce", "local_timestamp", "version", "method"}
KINDS = {
    "object": (COMMON | {"payloads"}, {"previous_revision", "leaves"}),
    "template": (COMMON | {"schema"}, {"previous_revision", "verification", "derives_from", "ancestry", "bounds"}),
    "signature": (COMMON | {"previous_revision", "signer", "signature"}, set()),
    "anchor": (COMMON | {"structural_links"}, {"previous_revision", "compositional_links", "leaves"}),
}


def _bytes(text, what: str, length: int | None = None) -> bytes:
    if not isinstance(text, str) or not HEX.fullmatch(text):
        raise Refused(f"{what} is no lower-case hex string")
    out = bytes.fromhex(text[2:])
    if length is not None and len(out) != length:
        raise Refused(f"{what} is not {length} bytes long")
    return out


def kind_of(revision: dict) -> str:
    """The one kind whose members these are; unknown or missing members fit none."""
    have = set(revision)
    for kind, (must, may) in KINDS.items():
        if must <= have <= must | may:
            return kind
    raise Refused("the members fit no kind of revision")


def _row(tree: str, link: str, r: dict, name) -> tuple:
    if not isinstance(r, dict):
        raise Refused("a revision is no object")
    kind = kind_of(r)
    key = _bytes(link, "link")
    alg = {b"\x16\x20": "sha3", b"\x1e\x20": "blake3"}.get(key[:2]) if len(key) == 34 else None
    ts = r["local_timestamp"]
    if isinstance(ts, bool) or not isinstance(ts, int) or not 0 <= ts < 2**64:
        raise Refused("local_timestamp is no unsigned 64-bit integer")
    if r["method"] not in ("scalar", "tree"):
        raise Refused("unknown method")
    if any(k in r and r[k] is None for k in ("previous_revision", "leaves", "derives_from", "ancestry", "bounds")):
        raise Refused("null stands for an absent member")
    prev = _bytes(r["previous_revision"], "previous_revision") if "previous_revision" in r else None
    structural = [_bytes(x, "structural link") for x in r.get("structural_links", [])]
    comp = []
    for c in r.get("compositional_links", []):
        if not isinstance(c, dict) or set(c) != {"hash", "role"}:
            raise Refused("malformed compositional link")
        comp.append((_bytes(c["hash"], "compositional link"), c["role"]))
    if not comp:  # an empty list is hashed as an absent one
        r = {k: v for k, v in r.items() if k != "compositional_links"}
    return (tree, key, alg, kind, prev, r["revision_type"], _bytes(r["nonce"], "nonce", 16), ts, r["version"], r["method"], r.get("leaves"), r.get("signer"), structural, comp, name, render(r), None)


def decode(trees: DataFrame, id_col: str = "tree_id", json_col: str = "json") -> DataFrame:
    """REVISIONS rows of trees(id, JSON text): a bare tree {revisions, file_index}, or one under the member "tree" of a wrapper.

    Decoding is strict: an unknown, missing or duplicate member, a wrong length or a number out of range anywhere refuses the
    whole tree, which then gives one row with parse_error and nothing else. A null text is refused. Trees without revisions
    give no rows. Repeated ids are decoded each; other columns are ignored.
    """
    names = ["tree_id", "link", "hash_alg", "kind", "prev", "revision_type", "nonce", "ts", "version", "method", "leaves", "signer", "structural_links", "compositional_links", "file_name", "raw", "parse_error"]

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield from sliced(revisions(pdf), names)

    def revisions(pdf: pd.DataFrame) -> Iterator[tuple]:
        from decimal import Decimal

        for tree, text in zip(pdf["tree_id"].tolist(), pdf["json"].tolist()):
            try:
                if text is None:
                    raise Refused("missing")
                top = load(text)
                if isinstance(top, dict) and isinstance(top.get("tree"), dict):
                    top = top["tree"]
                if not isinstance(top, dict) or not {"revisions"} <= set(top) <= {"revisions", "file_index"} or not isinstance(top["revisions"], dict):
                    raise Refused("no tree")
                files = top.get("file_index", {})
                got = [_row(tree, k, r, files.get(k)) for k, r in top["revisions"].items()]
                out = [(*g[:7], Decimal(g[7]), *g[8:13], [{"hash": h, "role": x} for h, x in g[13]], *g[14:]) for g in got]
            except Refused as e:
                out = [(tree, *[None] * 15, str(e))]
            yield from out

    kept = trees.select(F.col(id_col).cast("string").alias("tree_id"), F.col(json_col).alias("json"))
    return kept.mapInPandas(rows, REVISIONS)


def read_trees(spark: SparkSession, path: str) -> DataFrame:
    """REVISIONS rows of the JSON files under path, a tree a file, named by its path."""
    files = spark.read.text(path, wholetext=True).select(F.col("value").alias("json"), F.input_file_name().alias("tree_id"))
    return decode(files)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """file_name, path, size, content of the files under path."""
    got = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return got.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", F.col("length").alias("size"), "content")


def ordered_json(rev: DataFrame, order: DataFrame) -> DataFrame:
    """tree_id, json: each tree's revisions as one object in the order of order(tree_id, link, ord); revisions that it lacks are left out."""
    key = F.concat(F.lit('"0x'), F.lower(F.hex("link")), F.lit('":'))
    rows = rev.join(order, ["tree_id", "link"]).select("tree_id", F.struct("ord", F.concat(key, F.col("raw")).alias("member")).alias("at"))
    lists = rows.groupBy("tree_id").agg(F.array_sort(F.collect_list("at")).alias("all"))
    return lists.select("tree_id", F.concat(F.lit('{"revisions":{'), F.array_join(F.transform("all", lambda x: x["member"]), ","), F.lit("}}")).alias("json"))


def template_trees(templates: DataFrame) -> DataFrame:
    """tree_id, link, raw: each template (link, raw) as a tree of its own, named by its link."""
    return templates.select(F.concat(F.lit("0x"), F.lower(F.hex("link"))).alias("tree_id"), "link", "raw")


def first_names(rev: DataFrame, order: DataFrame) -> DataFrame:
    """tree_id, main_file: the file name of the first object or template on the chain order(tree_id, link, pos)."""
    rows = rev.join(order, ["tree_id", "link"]).where(F.col("kind").isin("object", "template") & F.col("file_name").isNotNull())
    first = Window.partitionBy("tree_id").orderBy("pos")
    return rows.withColumn("n", F.row_number().over(first)).where("n = 1").select("tree_id", F.col("file_name").alias("main_file"))
