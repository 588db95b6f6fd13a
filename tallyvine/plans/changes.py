"""New revisions as rows: trees of files, appended objects, signing texts, removal of the last revision, checks of compute sections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.canonical import leaves_column, link_column, sealed_column
from ..functions.hashing import digest_column, render_hex
from ..session import materialize, shuffled

# Foundation templates, the version, and content types by file name ending.
VERSION = "https://aqua-protocol.org/docs/v4/schema"
FILE_TEMPLATE = "0x162000f3abb3d74fc9dfc2b961cea906b3211716188f4de6f588180fdfcbbfa3fe53"
META_TEMPLATE = "0x1620f3040850a8836717dd73e87d046723e11f9e9870e3b2e246803ad842fbf01155"
ANCHOR_TEMPLATE = "0x1620479a304927c47f4308d027a858060ce287a9bdb45f2203f8130574a73511e899"
CONTENT_TYPES = {
    "json": "application/json", "txt": "text/plain", "html": "text/html", "htm": "text/html", "css": "text/css", "js": "application/javascript",
    "xml": "application/xml", "csv": "text/csv", "pdf": "application/pdf", "png": "image/png", "jpg": "image/jpeg", "jpeg": "image/jpeg",
    "gif": "image/gif", "svg": "image/svg+xml", "webp": "image/webp", "mp3": "audio/mpeg", "mp4": "video/mp4", "zip": "application/zip",
    "gz": "application/gzip", "gzip": "application/gzip", "tar": "application/x-tar", "wasm": "application/wasm",
}
# Bounds of a compute module and of its source text, in bytes.
MODULE_BYTES, SOURCE_BYTES = 2 << 20, 512 << 10
MODULES = "struct<computations: array<struct<wasm: string, wasm_hash: string, source: struct<code: string, hash: string>>>>"


def content_type(name: Column) -> Column:
    """Content type of a file name by what follows its last dot (all of it, if it has none), whatever the case."""
    types = F.create_map(*[F.lit(x) for kv in CONTENT_TYPES.items() for x in kv])
    return F.coalesce(types[F.lower(F.substring_index(name, ".", -1))], F.lit("application/octet-stream"))


def nonce(seed: str, *parts: Column) -> Column:
    """16 bytes in hex that differ by seed and parts: a task that is run again makes the same ones, so seed must be new each time, and secret."""
    return F.concat(F.lit("0x"), F.substring(F.sha2(F.to_json(F.array(F.lit(seed), *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 256), 1, 32))


def seal(rows: DataFrame, algorithm: str = "sha3") -> DataFrame:
    """rows(raw) with link: the multihash link of each revision's JSON text; null where it cannot be hashed."""
    return rows.withColumn("link", link_column(F.col("raw"), F.lit(algorithm))["link"])


def _revision(kind: Column, at: Column, salt: Column, method: str, *more: Column) -> Column:
    head = [kind.alias("revision_type"), salt.alias("nonce"), at.alias("local_timestamp"), F.lit(VERSION).alias("version"), F.lit(method).alias("method")]
    return F.to_json(F.struct(*head, *more))


def published(rows: DataFrame, algorithm: str = "sha3") -> DataFrame:
    """rows(raw) of revisions by the tree method with their leaves put into raw; leaves are no part of what is hashed. What has none stays as it is."""
    return rows.withColumn("raw", _with_leaves(leaves_column(F.col("raw"), F.lit(algorithm))))


def _with_leaves(leaves: Column) -> Column:
    """raw with its leaves; without any it stays as it is."""
    whole = F.concat(F.substring("raw", F.lit(1), F.length("raw") - 1), F.lit(',"leaves":'), F.to_json(leaves), F.lit("}"))
    return F.coalesce(whole, F.col("raw"))


def sealed(rows: DataFrame, method: str) -> DataFrame:
    """rows(raw) with link, and by the tree method with the leaves put into raw: published(seal(rows)), the leaves being hashed once."""
    if method != "tree":
        return seal(rows)
    s = sealed_column(F.col("raw"), F.lit("sha3"))
    return rows.withColumn("s", s).withColumn("link", F.col("s.link")).withColumn("raw", _with_leaves(F.col("s.leaves"))).drop("s")


def _file_payload() -> Column:
    """The payload of a file object of columns digest, size and file_name."""
    return F.struct(
        F.lit("file").alias("type"),
        render_hex(F.col("digest")).alias("hash"),
        F.lit("FIPS_202-SHA3-256").alias("hash_type"),
        F.lit("").alias("descriptor"),
        F.col("size"),
        content_type(F.col("file_name")).alias("content_type"),
    )


def _hashed(files: DataFrame) -> DataFrame:
    f = files.where("content is not null").select("tree_id", F.coalesce("file_name", F.lit("")).alias("file_name"), "content")
    return f.withColumn("digest", digest_column(F.col("content"), "sha3")).withColumn("size", F.octet_length("content")).drop("content")


def file_trees(files: DataFrame, now: int, seed: str, method: str = "scalar") -> DataFrame:
    """tree_id, pos, link, raw, file_name: an anchor and an object for every row of files(tree_id, file_name, content), links by SHA3-256.

    The anchor refers to the file template and is a second older than the object, which holds the file's digest, size and type; by the tree method both publish their leaves.
    Files with null content have no tree; null names are empty; equal rows give equal trees; further columns are ignored.
    """
    return _trees_of(_hashed(files), now, seed, method)


def metadata_trees(files: DataFrame, now: int, seed: str, method: str = "scalar") -> DataFrame:
    """The rows of file_trees() for files(tree_id, file_name, digest, size) that were hashed elsewhere: contents are not read. Files with a null digest or size have no tree."""
    f = files.where("digest is not null and size is not null").select("tree_id", F.coalesce("file_name", F.lit("")).alias("file_name"), "digest", F.col("size").cast("long").alias("size"))
    return _trees_of(f, now, seed, method)


def _trees_of(f: DataFrame, now: int, seed: str, method: str) -> DataFrame:
    own = lambda part: nonce(seed, F.col("tree_id"), F.col("file_name"), F.col("digest"), F.lit(part))
    anchor = _revision(F.lit(ANCHOR_TEMPLATE), F.lit(now - 1), own("anchor"), method, F.array(F.lit(FILE_TEMPLATE)).alias("structural_links"))
    anchors = sealed(f.withColumn("raw", anchor), method).withColumnRenamed("raw", "first").withColumnRenamed("link", "prev")
    both = anchors.withColumn("raw", _revision(F.lit(FILE_TEMPLATE), F.lit(now), own("object"), method, render_hex(F.col("prev")).alias("previous_revision"), _file_payload().alias("payloads")))
    rows = F.array(
        F.struct(F.lit(0).alias("pos"), F.col("prev").alias("link"), F.col("first").alias("raw"), F.concat(F.lit("anchor_"), F.substring(render_hex(F.col("prev")), 1, 8)).alias("file_name")),
        F.struct(F.lit(1).alias("pos"), F.col("link"), F.col("raw"), F.col("file_name")),
    )
    return sealed(both, method).select("tree_id", F.inline(rows))


def minimal_trees(files: DataFrame, now: int, seed: str, method: str = "scalar") -> DataFrame:
    """tree_id, pos, link, raw, file_name: one object alone for every row of files(tree_id, file_name, content), as the object of file_trees() without an anchor before it."""
    f = _hashed(files)
    salt = nonce(seed, F.col("tree_id"), F.col("file_name"), F.col("digest"), F.lit("minimal"))
    made = sealed(f.withColumn("raw", _revision(F.lit(FILE_TEMPLATE), F.lit(now), salt, method, _file_payload().alias("payloads"))), method)
    return made.select("tree_id", F.lit(0).alias("pos"), "link", "raw", "file_name")


def new_templates(schemas: DataFrame, now: int, seed: str, method: str = "scalar") -> DataFrame:
    """name, link, raw of schemas(name, schema as JSON text): a template that derives from nothing for each, link null where the schema is no JSON."""
    salt = nonce(seed, F.col("name"), F.col("schema"))
    head = _revision(F.lit(META_TEMPLATE), F.lit(now), salt, method)
    raw = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"schema":'), F.col("schema"), F.lit("}"))
    return seal(schemas.select("name", raw.alias("raw"))).select("name", "link", "raw")


def append_objects(tips: DataFrame, objects: DataFrame, now: int, seed: str, method: str = "scalar", algorithm: str = "sha3") -> DataFrame:
    """tree_id, prev, link, raw, and id and file_name where objects has these: an object for every row of objects(tree_id, revision_type, payloads as a JSON text), after the tip of its tree.

    tips(tree_id, link) has one row a tree at most. An object of a tree that has no tip begins one. Payloads that are no JSON value give a null link.
    """
    more = [c for c in ("id", "file_name") if c in objects.columns]
    rows = objects.select("tree_id", "revision_type", "payloads", *more).join(shuffled(tips.select("tree_id", F.col("link").alias("prev"))), "tree_id", "left")
    salt = nonce(seed, F.col("tree_id"), F.col("prev"), F.col("revision_type"), F.col("payloads"), *map(F.col, more))
    head = _revision(F.col("revision_type"), F.lit(now), salt, method, render_hex(F.col("prev")).alias("previous_revision"))  # nulls are left out
    raw = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"payloads":'), F.col("payloads"), F.lit("}"))
    return seal(rows.withColumn("raw", raw), algorithm).select("tree_id", "prev", "link", "raw", *more)


def link_trees(ends: DataFrame, links: DataFrame, names: DataFrame, now: int, seed: str, method: str = "scalar") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(revisions, files, refused) for links(tree_id, linked_id, ordinal): an anchor after the end of each tree that refers to the ends of the trees it is linked to.

    revisions(tree_id, prev, link, raw): links by SHA3-256, compositional ones with the role "composition" in the order of ordinal, linked_id, and leaves for the tree method.
    files(tree_id, link, file_name): the main file names of the linked trees by their ends. ends(tree_id, link) has the last revision on each tree's chain,
    names(tree_id, main_file) its main file name. A linked tree without an end is skipped. refused(tree_id, fault): "no_end" (the tree has none), "no_links"
    (it is linked to nothing that has an end), "no_file_name" (a linked tree has none); a refused tree gets nothing. An anchor's links are one value, so they are gathered.
    """
    wanted = links.select("tree_id", "linked_id", "ordinal").distinct()
    tip = ends.select(F.col("tree_id").alias("linked_id"), F.col("link").alias("target"))
    file = names.select(F.col("tree_id").alias("linked_id"), "main_file")
    met = materialize(wanted.join(tip, "linked_id", "left").join(file, "linked_id", "left"), "linked")
    one = F.struct("ordinal", "linked_id", F.struct(render_hex(F.col("target")).alias("hash"), F.lit("composition").alias("role")).alias("link"))
    lists = met.groupBy("tree_id").agg(F.array_sort(F.collect_list(F.when(F.col("target").isNotNull(), one))).alias("all"), F.max(F.col("target").isNotNull() & F.col("main_file").isNull()).alias("unnamed"))
    rows = lists.join(ends.select("tree_id", F.col("link").alias("prev")), "tree_id", "left")
    fault = F.when(F.col("prev").isNull(), "no_end").when(F.size("all") == 0, "no_links").when(F.col("unnamed"), "no_file_name")
    rows = materialize(rows.withColumn("fault", fault), "linking")
    good = rows.where("fault is null").withColumn("comp", F.transform("all", lambda x: x["link"]))
    salt = nonce(seed, F.col("tree_id"), F.col("prev"), F.to_json("comp"))
    none = F.array().cast("array<string>").alias("structural_links")
    made = _revision(F.lit(ANCHOR_TEMPLATE), F.lit(now), salt, method, render_hex(F.col("prev")).alias("previous_revision"), none, F.col("comp").alias("compositional_links"))
    made = sealed(good.withColumn("raw", made), method)
    files = met.where("target is not null").join(made.select("tree_id"), "tree_id", "left_semi").select("tree_id", F.col("target").alias("link"), F.col("main_file").alias("file_name")).distinct()
    return made.select("tree_id", "prev", "link", "raw"), files, rows.where("fault is not null").select("tree_id", "fault")


def without_last(rev: DataFrame, tips: DataFrame) -> DataFrame:
    """rev without the revision of each tree that tips(tree_id, link) names; trees that tips lacks stay whole."""
    return rev.join(tips.select("tree_id", "link").distinct(), ["tree_id", "link"], "left_anti")


def compute_faults(templates: DataFrame) -> DataFrame:
    """link, module, fault of templates(link, verification as a JSON text) whose compute modules contradict themselves; a module's first fault stands.

    Faults in order: module_too_large, malformed_hex, module_hash, source_too_large, source_hash. A module without source skips the last two;
    templates without verification have no rows, one that cannot be read has module null and fault "unreadable".
    """
    bare = lambda c: F.lower(F.regexp_replace(c, "^0x", ""))
    read = templates.where("verification is not null").select("link", F.from_json("verification", MODULES)["computations"].alias("all"))
    bad = read.where("all is null").select("link", F.lit(None).cast("int").alias("module"), F.lit("unreadable").alias("fault"))
    m = read.select("link", F.posexplode("all").alias("module", "m")).select("link", "module", bare(F.col("m.wasm")).alias("hex"), "m.wasm_hash", "m.source")
    code = F.col("source.code")
    size = F.floor(F.length("hex") / 2)
    hexed = F.col("hex").rlike("^([0-9a-f]{2})*$")
    m = m.withColumn("made", digest_column(F.when((size <= MODULE_BYTES) & hexed, F.unhex("hex")), "sha3"))
    m = m.withColumn("read", digest_column(F.when(F.octet_length(code) <= SOURCE_BYTES, F.encode(code, "utf-8")), "sha3"))
    differs = lambda made, said: ~F.lower(F.hex(made)).eqNullSafe(bare(said))
    fault = (
        F.when(F.col("hex").isNull(), "unreadable")
        .when(size > MODULE_BYTES, "module_too_large")
        .when(~hexed, "malformed_hex")
        .when(differs(F.col("made"), F.col("wasm_hash")), "module_hash")
        .when(F.col("source").isNull(), None)
        .when(F.octet_length(code) > SOURCE_BYTES, "source_too_large")
        .when(differs(F.col("read"), F.col("source.hash")), "source_hash")
    )
    return m.select("link", "module", fault.alias("fault")).where("fault is not null").unionByName(bad)
