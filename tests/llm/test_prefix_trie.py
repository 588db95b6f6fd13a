"""Prefix tries against all prefixes in plain Python: small and large buckets, copies, histories that grow, long conversations."""

import hashlib
import random
import re
import zlib

import pytest

from tallyvine.llm import prefix_trie, queries

TURNS = "conv_id long, turn long, role string, text string, depth string, turn_id string"


def rebuilt(rows):
    own = {}
    for c, t, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    own = {c: [(r, x) for _, _, r, x in sorted(v, key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))] for c, v in own.items()}
    h = {c: zlib.crc32(str(c).encode()) % 4 for c in own}
    base = {c: c - (abs(c) % 20) * (1 if c >= 0 else -1) for c in own}
    return {c: own.get(base[c], [])[: h[c]] + own[c][h[c] :] for c in own}


def brute(convs):
    """{(conv_id, depth): (parent, n_convs, n_children, n_leaves, saved, ends)} of conversations {id: list of turns}."""
    nodes = {}
    for c, turns in sorted(convs.items()):
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    kids, leaves, saved = {}, dict.fromkeys(nodes, 0), dict.fromkeys(nodes, 0)
    for k in nodes:
        if k:
            kids[k[:-1]] = kids.get(k[:-1], 0) + 1
    for k, members in nodes.items():
        words = len(re.findall(r"[^\x20\x09-\x0D]+", k[-1][1])) if k else 0
        for d in range(len(k) + 1):
            leaves[k[:d]] += k not in kids
            saved[k[:d]] += (len(members) - 1) * words
    out = {}
    for k, m in nodes.items():
        ended = ",".join(str(c) for c in sorted(m) if len(convs[c]) == len(k))
        out[min(m), len(k)] = (min(nodes[k[:-1]]) if k else None, len(m), kids.get(k, 0), leaves[k], saved[k], hashlib.sha256(ended.encode()).hexdigest())
    assert len(out) == len(nodes)
    return out


def rows_of(nodes):
    return {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in nodes.collect()}


def some_rows(rng, convs):
    rows = []
    for c in convs:
        for i in range(rng.randrange(1, 7)):
            rows.append((c, None if rng.random() < 0.05 else i, rng.choice(["user", "user", None, "system"]), rng.choice(["a b", "a b", "", None, "c\td  e\n", "ü x", " "])))
            if rng.random() < 0.05:
                rows.append(rows[-1])
    return rows


@pytest.mark.parametrize("local_turns", [0, 6, 4096])
def test_nodes_of_rebuilt_conversations(spark, local_turns):
    rng = random.Random(21)
    rows = some_rows(rng, [*range(-30, 130), 2**40 + 3]) + [(None, 0, "user", "lost")]
    nodes, dictionary = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS), local_turns)
    assert rows_of(nodes) == brute(rebuilt(rows))
    words = {r.turn_id: (r.role, r.text) for r in dictionary.collect()}
    seqs = rebuilt(rows)
    assert all(words[r.turn_id] == seqs[r.conv_id][r.depth - 1] for r in nodes.collect() if r.depth)
    assert all(r.turn_id is None for r in nodes.where("depth = 0").collect())


def trie_of(spark, convs, local_turns):
    """The trie of {id: list of (role, text)} as they are."""
    ids = {t: i for i, t in enumerate(sorted({t for s in convs.values() for t in s}))}
    rows = [(c, d, ids[t], len(re.findall(r"[^\x20\x09-\x0D]+", t[1]))) for c, s in convs.items() for d, t in enumerate(s, 1)]
    return rows_of(prefix_trie.trie(spark.createDataFrame([(c,) for c in convs], "conv_id long"), spark.createDataFrame(rows, "conv_id long, depth long, turn_id long, words long"), local_turns))


def test_large_buckets(spark):
    """Copies by the hundred, one first turn of nearly all, histories that grow by a turn, two long conversations that part late, and one without turns."""
    rng = random.Random(22)
    turn = lambda i: ("user", f"w{i} " * (i % 4))
    convs = {i: [turn(0), turn(1), turn(2)] for i in range(100, 400)}
    convs |= {1000 + i: [turn(0), turn(rng.randrange(3, 9)), turn(rng.randrange(3)), turn(i)] for i in range(120)}
    convs |= {2000 + i: [turn(7)] * i for i in range(1, 25)}
    long = [turn(rng.randrange(50)) for _ in range(1500)]
    convs |= {3000: long, 2999: long[:1400] + [turn(51)] + long[1400:], 3001: long, 5: []}
    assert trie_of(spark, convs, 100) == brute_long(convs)


def brute_long(convs):
    """As brute(), with prefixes named by number, so that long conversations are affordable."""
    child, node_of, info = {}, {}, [[None, 0, "", []]]
    for c, turns in sorted(convs.items()):
        at = 0
        info[0][3].append(c)
        for t in turns:
            if (at, t) not in child:
                child[at, t] = len(info)
                info.append([at, info[at][1] + 1, t[1], []])
            at = child[at, t]
            info[at][3].append(c)
        node_of.setdefault(at, []).append(c)
    kids, leaves, saved = [0] * len(info), [0] * len(info), [0] * len(info)
    for i in range(len(info) - 1, -1, -1):
        up, _, text, members = info[i]
        leaves[i] = leaves[i] or 1
        saved[i] += (len(members) - 1) * (len(text.split()) if i else 0)
        if up is not None:
            kids[up], leaves[up], saved[up] = kids[up] + 1, leaves[up] + leaves[i], saved[up] + saved[i]
    sha = lambda ids: hashlib.sha256(",".join(map(str, sorted(ids))).encode()).hexdigest()
    return {(min(m), d): (None if up is None else min(info[up][3]), len(m), kids[i], leaves[i], saved[i], sha(node_of.get(i, []))) for i, (up, d, _, m) in enumerate(info)}


def test_awkward_tables(spark):
    assert trie_of(spark, {7: [], 9: []}, 10) == brute({7: [], 9: []})
    nodes, _ = prefix_trie.prefix_trie(spark.createDataFrame([], TURNS))
    assert nodes.count() == 0
    rows = [(0, 0, "user", "long " * 200_000), (1, 0, "user", "long " * 200_000), (4, None, None, None), (4, None, None, None)]
    nodes, _ = prefix_trie.prefix_trie(spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS))
    assert rows_of(nodes) == brute(rebuilt(rows))


def test_places_over_many_partitions(spark):
    """One conversation holds nearly all rows and lies in several partitions."""
    rows = [(5, None if i < 40 else i, i, 1) for i in range(900)] + [(4, 0, 1, 1), (6, 3, 2, 1), (6, 1, 9, 1)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = prefix_trie.placed(spark.createDataFrame(rows, "conv_id long, turn long, turn_id long, words long").repartition(5)).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted((r.conv_id, r.pos, r.turn_id) for r in got) == [(4, 1, 1)] + [(5, i + 1, i) for i in range(900)] + [(6, 1, 9), (6, 2, 2)]


def test_query_is_its_sql(spark, tmp_path):
    import duckdb

    rows = some_rows(random.Random(23), range(-25, 60))
    spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    cols = "conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"select {cols} from ({queries.ORACLE_SQL['op13_prefix_trie']})").fetchall()
    got = queries.op13_prefix_trie(spark, str(tmp_path)).select(*cols.split(", ")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
