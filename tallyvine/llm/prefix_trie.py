"""Conversation prefix trie (operator 13): MSD radix partitioning over dictionary-encoded turns; what is local is finished by multikey quicksort.

A node is named by its smallest member and its depth. Conversations of one sequence of turns are counted as one before anything is
partitioned. A bucket holds the sequences below one node. While it has more turns than a task should hold, its common way down is
walked at once and it is dealt out by the next turn; buckets that are small enough go to tasks, which sort them and emit their nodes.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: Turns of a bucket that one task sorts; a larger bucket is dealt out further.
LOCAL_TURNS = 4096
#: Turns whose places or sums are worked out together.
TOGETHER = 1024
EMPTY = hashlib.sha256(b"").hexdigest()
NODES = "conv_id long, depth long, parent_conv_id long, turn_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ended long"


def encode(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, turn, turn_id, words) of every row, and the dictionary (turn_id, role, text, words) of the different turns.

    Null roles and texts are empty; rows without a conv_id take no part. Ids rise with (role, text). words counts runs of what is not white space.
    Different turns meet their rows by digest, so texts are shuffled once, after equal ones were put together.
    """
    text = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"))
    distinct = rows.select("role", "text").distinct().repartitionByRange("role", "text").sortWithinPartitions("role", "text")
    words = F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+")).cast("long")
    dictionary = materialize(distinct.select(F.monotonically_increasing_id().alias("turn_id"), "role", "text", words.alias("words")), "dictionary")
    known = dictionary.select("turn_id", "words", F.col("role").alias("r"), F.sha2("text", 256).alias("digest"))
    out = rows.select("conv_id", "turn", "role", F.sha2("text", 256).alias("d")).join(known, (F.col("role") == F.col("r")) & (F.col("d") == F.col("digest")))
    return out.select("conv_id", "turn", "turn_id", "words"), dictionary


def placed(rows: DataFrame) -> DataFrame:
    """conv_id, pos (from 1), turn_id, words of rows(conv_id, turn, turn_id, words): places in the order of turn (null first), turn_id.

    Rows are sorted by range over the whole table and numbered within its partitions; a conversation that lies in several gets its places from their counts.
    """
    order = ["conv_id", "turn", "turn_id"]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "turn_id", "words", F.monotonically_increasing_id().alias("at"))
    ordered = materialize(ordered, "ordered").withColumn("part", F.shiftright("at", 33))
    pieces = ordered.groupBy("conv_id", "part").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("conv_id").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # a row a partition
    pieces = pieces.select("conv_id", "part", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    return ordered.join(pieces, ["conv_id", "part"]).select("conv_id", (F.col("at") - F.col("first") + F.col("before") + 1).alias("pos"), "turn_id", "words")


def led(rows: DataFrame, block: int = 20, most: int = 4) -> tuple[DataFrame, DataFrame]:
    """(conv_id) of all conversations of rows(conv_id, pos, turn_id, words), and (conv_id, depth, turn_id, words) of them rebuilt.

    The first h turns of conversation c come from conversation c - c % block (all if it has fewer, none if it is absent); its own turns after its first h follow. h = crc32(c) % most.
    """
    h = F.crc32(F.col("conv_id").cast("string")) % most
    base = F.col("conv_id") - F.col("conv_id") % block
    sizes = materialize(rows.groupBy("conv_id").agg(F.count("*").alias("n")), "sizes")
    convs = sizes.select("conv_id", h.alias("h"), base.alias("base"))
    heads = rows.where(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "turn_id", "words")  # fewer than `most` a conversation, for a block's members
    lead = convs.join(heads, "base").where("pos <= h").select("conv_id", F.col("pos").alias("depth"), "turn_id", "words")
    have = convs.join(sizes.select(F.col("conv_id").alias("base"), F.col("n").alias("n_base")), "base", "left")
    have = have.select("conv_id", (F.least(F.col("h"), F.coalesce("n_base", F.lit(0))) - F.col("h")).alias("shift"))
    own = rows.where(F.col("pos") > h).join(have, "conv_id").select("conv_id", (F.col("pos") + F.col("shift")).alias("depth"), "turn_id", "words")
    return convs.select("conv_id"), lead.unionByName(own)


def sequences(convs: DataFrame, rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sid, conv_id) of every conversation, sid the smallest one of the same turns; and (sid, n, len) of every sequence: how many conversations, how many turns.

    A sequence is told by a digest of digests of TOGETHER turns each, so a long conversation is not gathered.
    """
    part = rows.groupBy("conv_id", F.floor((F.col("depth") - 1) / TOGETHER).alias("part")).agg(F.array_sort(F.collect_list(F.struct("depth", "turn_id"))).alias("turns"))
    part = part.select("conv_id", "part", F.size("turns").cast("long").alias("len"), F.sha2(F.array_join(F.transform("turns", lambda x: x["turn_id"].cast("string")), ","), 256).alias("digest"))
    whole = part.groupBy("conv_id").agg(F.sum("len").alias("len"), F.array_sort(F.collect_list(F.struct("part", "digest"))).alias("parts"))
    whole = whole.select("conv_id", "len", F.sha2(F.array_join(F.transform("parts", lambda x: x["digest"]), ","), 256).alias("digest"))
    every = convs.join(whole, "conv_id", "left").select("conv_id", F.coalesce("len", F.lit(0)).alias("len"), F.coalesce("digest", F.lit("")).alias("digest"))
    every = materialize(every, "digests")
    seqs = materialize(every.groupBy("digest").agg(F.min("conv_id").alias("sid"), F.count("*").alias("n"), F.min("len").alias("len")), "sequences")
    return every.join(seqs.select("digest", "sid"), "digest").select("sid", "conv_id"), seqs.select("sid", "n", "len")


def ends(members: DataFrame) -> DataFrame:
    """sid, ends_sha256: the SHA-256 (hex) of the decimal conv_ids of each sequence of members(sid, conv_id), rising, joined by commas.

    A hash takes them in order, so one task reads a sequence's ids; it keeps the hash only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sid, sha = None, None
        for pdf in batches:
            out = []
            for s, ids in pdf.groupby("sid", sort=False)["conv_id"]:
                text = ",".join(map(str, ids.tolist()))
                if s == sid:
                    sha.update(("," + text).encode())
                    continue
                if sid is not None:
                    out.append((sid, sha.hexdigest()))
                sid, sha = s, hashlib.sha256(text.encode())
            if out:
                yield pd.DataFrame(out, columns=["sid", "ends_sha256"])
        if sid is not None:
            yield pd.DataFrame([(sid, sha.hexdigest())], columns=["sid", "ends_sha256"])

    return members.repartition("sid").sortWithinPartitions("sid", "conv_id").mapInPandas(run, "sid long, ends_sha256 string")


def quicksorted(seqs: list[tuple[int, int, list[int], list[int]]], depth: int, up: int | None, turn: int | None, words: int) -> list[list]:
    """NODES of a bucket: of its top node (at depth, below a node of smallest member up, its last turn and that one's words) and all below.

    seqs are different (sid, n, turn ids below the top, words of these). They are parted three ways by the turn at one place: less, equal, more;
    equal ones are a node and go on at the next place.
    """
    made = [[min(s[0] for s in seqs), depth, up, turn, sum(s[1] for s in seqs), 0, 0, 0, None]]
    weigh, above = [words], [-1]
    stack = [(seqs, 0, 0)]
    while stack:
        group, at, top = stack.pop()
        if not group:
            continue
        pick = group[len(group) // 2][2]
        pivot = pick[at] if at < len(pick) else -1
        less, same, more = [], [], []
        for s in group:
            key = s[2][at] if at < len(s[2]) else -1
            (less if key < pivot else more if key > pivot else same).append(s)
        stack += [(less, at, top), (more, at, top)]
        if pivot < 0:
            made[top][8] = same[0][0]
        else:
            made.append([min(s[0] for s in same), depth + at + 1, made[top][0], pivot, sum(s[1] for s in same), 0, 0, 0, None])
            weigh.append(same[0][3][at])
            above.append(top)
            stack.append((same, at + 1, len(made) - 1))
    for i in range(len(made) - 1, -1, -1):  # a node comes after the one above it
        node = made[i]
        node[6] = node[6] or 1
        node[7] += (node[4] - 1) * weigh[i]
        if i:
            over = made[above[i]]
            over[5], over[6], over[7] = over[5] + 1, over[6] + node[6], over[7] + node[7]
    return made


def _finished(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Nodes of the buckets whose rows (first, start, up, turn, words0, sid, n, turn_id, words) come together and in order."""
    names = [x.split()[0] for x in NODES.split(", ")]
    shape = {n: "Int64" for n in names}
    bucket, top, seqs, out = None, None, [], []
    for pdf in batches:
        pdf = pdf.astype({c: "Int64" for c in pdf.columns})
        for first, start, up, turn, words0, sid, n, tid, w in zip(*(pdf[c].astype(object).where(pdf[c].notna(), None).tolist() for c in pdf.columns)):
            if (first, start) != bucket:
                if bucket is not None:
                    out += quicksorted(seqs, *top)
                bucket, top, seqs = (first, start), (start, up, turn, words0), []
            if not seqs or seqs[-1][0] != sid:
                seqs.append((sid, n, [], []))
            if tid is not None:
                seqs[-1][2].append(tid)
                seqs[-1][3].append(w)
        if len(out) >= 20_000:
            yield pd.DataFrame(out, columns=names).astype(shape)
            out = []
    if bucket is not None:
        out += quicksorted(seqs, *top)
    if out:
        yield pd.DataFrame(out, columns=names).astype(shape)


def _below(rows: DataFrame) -> DataFrame:
    """first, start, depth with below: the sum of weight over this depth and the deeper ones of a bucket's way, in two levels."""
    rows = rows.withColumn("part", F.floor(F.col("depth") / TOGETHER))
    parts = rows.groupBy("first", "start", "part").agg(F.sum("weight").alias("w"))
    after = Window.partitionBy("first", "start").orderBy(F.desc("part")).rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select("first", "start", "part", F.coalesce(F.sum("w").over(after), F.lit(0)).alias("after"))
    within = Window.partitionBy("first", "start", "part").orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("within", F.sum("weight").over(within)).join(parts, ["first", "start", "part"])
    return rows.withColumn("below", F.col("within") + F.col("after")).drop("within", "after", "part", "weight")


def trie(convs: DataFrame, rows: DataFrame, local_turns: int = LOCAL_TURNS) -> DataFrame:
    """The nodes of the trie of conversations (conv_id) with turns rows(conv_id, depth from 1, turn_id, words): NODES without ended, and ends_sha256.

    conv_id is a node's smallest member, turn_id its last turn (root: null), n_convs its members, n_children its children, n_leaves the childless nodes
    at and below it, saved_tokens the words that sharing saves there: (n_convs - 1) times the words of the last turn, summed over it and all below.
    ends_sha256 hashes the ids of the conversations that end there. Conversations without turns are members of the root alone; without conversations there is no node.
    """
    spark = convs.sparkSession
    small_batches(spark, 10_000)
    rows = materialize(rows, "rebuilt")
    members, seqs = sequences(convs, rows)
    members = materialize(members, "members")
    turns = materialize(rows.join(seqs.select(F.col("sid").alias("conv_id")), "conv_id", "left_semi").select(F.col("conv_id").alias("sid"), "depth", "turn_id", "words"), "sequence_turns")
    none = F.lit(None).cast("long")
    top = seqs.agg(F.min("sid").alias("first"), F.count("*").alias("n_seqs"), F.sum("n").alias("n_convs"), F.sum("len").alias("left")).where("first is not null")
    zero = F.lit(0).cast("long")
    # a bucket: (first, start) its top node, (pf, ps) the bucket it was dealt from, up its parent's smallest member
    buckets = materialize(top.select("first", zero.alias("start"), none.alias("pf"), none.alias("ps"), none.alias("up"), none.alias("turn"), zero.alias("words0"), "n_seqs", "n_convs", "left"), "buckets")
    key = ["first", "start"]
    inside = seqs.select("sid", "n", "len", zero.alias("start"))
    root = buckets.select("first").limit(1).collect()
    if not root:
        return spark.createDataFrame([], NODES).drop("ended").withColumn("ends_sha256", F.lit(""))
    inside = inside.withColumn("first", F.lit(root[0]["first"]))
    large, ways, kept, kept_buckets, closed = [], [], [], [], []
    while True:
        small, big = buckets.where(F.col("left") <= local_turns), buckets.where(F.col("left") > local_turns)
        kept_buckets.append(small)
        kept.append(inside.join(small.select(*key), key, "left_semi"))
        if not big.limit(1).count():
            break
        active = materialize(inside.join(big.select(*key, "n_seqs"), key), "active")
        met = turns.join(active.select(*key, "sid"), "sid").where(F.col("depth") > F.col("start"))
        each = met.groupBy(*key, "depth").agg(F.count("*").alias("c"), F.min("turn_id").alias("turn_id"), F.max("turn_id").alias("most"), F.min("words").alias("words"))
        each = materialize(each.join(big.select(*key, "n_seqs"), key).withColumn("common", (F.col("c") == F.col("n_seqs")) & (F.col("turn_id") == F.col("most"))), "depths")
        lcp = each.groupBy(*key).agg(F.coalesce(F.min(F.when(~F.col("common"), F.col("depth"))) - 1, F.max("depth")).alias("lcp"))
        big = materialize(big.join(lcp, key), "large_buckets")
        ways.append(each.join(big.select(*key, "lcp"), key).where("depth <= lcp").select(*key, "depth", "turn_id", "words"))
        active = materialize(active.join(big.select(*key, "lcp"), key), "active")
        closed.append(active.where("len = lcp").select(*key, F.col("sid").alias("ended")))
        on = active.where("len > lcp").select(*key, "sid", "n", "len", "lcp")
        on = materialize(on.join(turns, (on["sid"] == turns["sid"]) & (turns["depth"] == on["lcp"] + 1)).select(*key, on["sid"], "n", "len", "depth", "turn_id", "words"), "dealt")
        made = on.groupBy(F.col("first").alias("pf"), F.col("start").alias("ps"), F.col("turn_id").alias("turn"), "depth").agg(
            F.min("sid").alias("first"), F.count("*").alias("n_seqs"), F.sum("n").alias("n_convs"), F.sum(F.col("len") - F.col("depth")).alias("left"), F.min("words").alias("words0")
        )
        buckets = materialize(made.select("first", F.col("depth").alias("start"), "pf", "ps", F.col("pf").alias("up"), "turn", "words0", "n_seqs", "n_convs", "left"), "buckets")
        named = buckets.select(F.col("first").alias("f"), F.col("start").alias("s"), F.col("pf").alias("first"), F.col("ps").alias("start"), F.col("turn").alias("turn_id"))
        inside = materialize(on.join(named, [*key, "turn_id"]).select(F.col("f").alias("first"), F.col("s").alias("start"), "sid", "n", "len"), "inside")
        large.append(big)
    union = lambda frames: frames[0] if len(frames) == 1 else union([frames[0].unionByName(frames[1]), *frames[2:]])
    tops = union(kept_buckets).select(*key, "up", "turn", "words0")
    local = union(kept).join(tops, key)
    local = local.join(turns.withColumnRenamed("sid", "s"), (F.col("sid") == F.col("s")) & (F.col("depth") > F.col("start")), "left")
    local = local.select(*key, "up", "turn", "words0", "sid", "n", "turn_id", "words", "depth").repartition(*key).sortWithinPartitions(*key, "sid", "depth").drop("depth")
    nodes = materialize(local.mapInPandas(_finished, NODES), "local_nodes")
    if large:
        done = union(kept_buckets).select(*key, "pf", "ps").join(nodes.select(F.col("conv_id").alias("first"), F.col("depth").alias("start"), "n_leaves", "saved_tokens"), key)
        done = materialize(done, "tops")
        gone, way = union(closed), materialize(union(ways), "ways")
        first = union(large).select(*key, F.col("start").alias("depth"), F.col("turn").alias("turn_id"), F.col("words0").alias("words"))
        way = materialize(way.unionByName(first).join(union(large).select(*key, "n_convs"), key).withColumn("weight", (F.col("n_convs") - 1) * F.col("words")), "ways")
        own = way.groupBy(*key).agg(F.sum("weight").alias("own"))
        above, summed = done, []
        for big in reversed(large):  # a round's buckets are few; what is below them is known by now
            sums = above.where("pf is not null").groupBy(F.col("pf").alias("first"), F.col("ps").alias("start")).agg(F.count("*").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"))
            got = big.join(sums, key, "left").join(own, key).select(*key, "pf", "ps", "up", "lcp", F.coalesce("kids", F.lit(0)).alias("kids"), F.coalesce("leaves", F.lit(1)).alias("leaves"), F.coalesce("saved", F.lit(0)).alias("saved"), "own")
            got = materialize(got, "summed")
            summed.append(got)
            above = done.unionByName(got.select(*key, "pf", "ps", F.col("leaves").alias("n_leaves"), (F.col("saved") + F.col("own")).alias("saved_tokens")))
        facts = union(summed).join(gone, key, "left").drop("own")
        path = _below(way.select(*key, "depth", "turn_id", "n_convs", "weight")).join(facts, key)
        last = F.col("depth") == F.col("lcp")
        path = path.select(
            F.col("first").alias("conv_id"), "depth", F.when(F.col("depth") == F.col("start"), F.col("up")).otherwise(F.col("first")).alias("parent_conv_id"), "turn_id", "n_convs",
            F.when(last, F.col("kids")).otherwise(1).cast("long").alias("n_children"), F.col("leaves").alias("n_leaves"), (F.col("below") + F.col("saved")).alias("saved_tokens"), F.when(last, F.col("ended")).alias("ended"),
        )
        nodes = nodes.unionByName(path)
    closing = nodes.where("ended is not null").join(ends(members).withColumnRenamed("sid", "ended"), "ended").drop("ended")
    return closing.unionByName(nodes.where("ended is null").drop("ended").withColumn("ends_sha256", F.lit(EMPTY)))


def prefix_trie(turns: DataFrame, local_turns: int = LOCAL_TURNS) -> tuple[DataFrame, DataFrame]:
    """(nodes, dictionary) of the rebuilt conversations (see led) of turns(conv_id, turn, role, text), as trie() and encode() give them.

    Turns come in the order of turn (null first), role, text. Null roles and texts are empty; rows without a conv_id take no part; repeated rows are turns of
    their own; an empty table gives no nodes; other columns are ignored.
    """
    rows, dictionary = encode(turns)
    convs, rebuilt = led(materialize(placed(rows), "placed"))
    return trie(convs, rebuilt, local_turns), dictionary


TRIE_SQL = """
WITH o AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS pos FROM conversations WHERE conv_id IS NOT NULL
), c AS (
  SELECT conv_id, n, conv_id - conv_id % 20 AS base,
    xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
      lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END)) % 4 AS h
  FROM (SELECT conv_id, count(*) AS n FROM o GROUP BY conv_id)
), r AS (
  SELECT c.conv_id, pos AS d, role, text FROM c JOIN o ON o.conv_id = c.base AND pos <= h
  UNION ALL SELECT c.conv_id, pos - c.h + least(c.h, coalesce(b.n, 0)), role, text FROM c JOIN o USING (conv_id) LEFT JOIN c b ON b.conv_id = c.base WHERE pos > c.h
), s AS (SELECT conv_id, coalesce(list({'role': role, 'text': text} ORDER BY d) FILTER (WHERE d IS NOT NULL), []) AS s FROM c LEFT JOIN r USING (conv_id) GROUP BY conv_id),
p AS (SELECT conv_id, len(s) AS n, unnest(range(0, len(s) + 1)) AS d, s FROM s),
nodes AS (
  SELECT s[1:d] AS k, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(CASE WHEN d > 0 THEN len(regexp_extract_all(s[d].text, '[^\\x20\\x09-\\x0D]+')) ELSE 0 END) AS words,
    sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM p GROUP BY s[1:d], d
), kids AS (SELECT k[1:d - 1] AS k, d - 1 AS d, count(*) AS n_children FROM nodes WHERE d > 0 GROUP BY k[1:d - 1], d - 1),
known AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM nodes n LEFT JOIN kids USING (k, d)),
sums AS (
  SELECT k[1:j] AS k, j AS d, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * words) AS saved_tokens
  FROM (SELECT *, unnest(range(0, d + 1)) AS j FROM known) GROUP BY k[1:j], j
)
SELECT n.conv_id, n.d AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, n_leaves, CAST(saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM known n JOIN sums USING (k, d) LEFT JOIN known u ON n.d > 0 AND u.d = n.d - 1 AND u.k = n.k[1:n.d - 1]
"""
