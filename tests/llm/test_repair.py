"""Repairs of conversations against the cheapest of all edits in plain Python, and against the SQL of the query."""

import hashlib
import random
import zlib

import pytest

from tallyvine.llm import queries, repair

TURNS = "conv_id long, turn long, role string, text string, edits string, cost string"
SPACE = " \t\n\x0b\x0c\r"


def cheapest(rows):
    """(cost, audit, repaired lines) by a table of the least (cost, audit) from every turn and every state on: start, after s, after u, after a."""
    n = len(rows)
    best = [[None] * 4 for _ in range(n + 1)]
    for i in range(n, -1, -1):
        here = [None] * 4
        if i == n:
            here[0] = here[3] = (0, "", ())
        else:
            role, text, must, cut = rows[i]
            for q in range(4):
                offers = []
                if best[i + 1][q]:
                    c, a, t = best[i + 1][q]
                    offers.append((c + 4, "D" + a, t))
                need = {0: "su", 1: "u", 2: "a", 3: "u"}[q]
                for x in "" if must else need:
                    to = {"s": 1, "u": 2, "a": 3}[x]
                    if not best[i + 1][to]:
                        continue
                    c, a, t = best[i + 1][to]
                    if role[:1] == x:
                        offers.append((c + 3 * cut, "K" + a, (role + ":" + text, *t)))
                    elif x != "s":
                        offers.append((c + 3 + 3 * cut, "R" + a, ({"u": "user", "a": "assistant"}[x] + ":" + text, *t)))
                here[q] = min(offers, default=None)
        for _ in range(3):
            for q, to, role in ((0, 2, "user"), (1, 2, "user"), (2, 3, "assistant"), (3, 2, "user")):
                if here[to]:
                    c, a, t = here[to]
                    here[q] = min(x for x in (here[q], (c + 3, "I" + a, (role + ":", *t))) if x)
        best[i] = here
    return best[0][0]


def plain(rows, damaged=True):
    """The query's row for one conversation's (conv, turn, role, text)."""
    made = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        d = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20 if damaged else 9
        if d:
            text = "" if d == 1 else "".join(x for x in text if x not in ".!?") if d == 2 else text
            made += [(turn is not None, turn or 0, "user" if d == 4 else role, text)] * (2 if d == 3 else 1)
    made.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
    seen, out, counts = set(), [], [0, 0, 0]
    for _, _, role, text in made:
        bare = text.rstrip(SPACE)
        again, cut = (role, text) in seen, bare[-1:] not in (".", "!", "?")
        seen.add((role, text))
        fault = 0 if not bare else 1 if again else 2 if cut else None
        if fault is not None:
            counts[fault] += 1
        out.append((role, text, not bare or again, cut))
    cost, audit, lines = cheapest(out)
    turns = {t for has, t, _, _ in made if has}
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(out, out[1:]))
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    return gaps, *counts, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()


def some_rows(rng, convs, longest):
    rows = []
    for c in convs:
        for i in range(rng.randrange(0, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", "User", None])
            text = rng.choice([f"Said {i}.", f"said {rng.randrange(3)}", "Yes!", "", " \t", None, "ü. \n", "a\nb?"])
            rows += [(c, None if rng.random() < 0.05 else i - rng.randrange(2), role, text)] * (2 if rng.random() < 0.1 else 1)
    return rows


def found(spark, rows, damaged=True, block_rows=None, partitions=None):
    turns = spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS)
    if partitions:
        turns = turns.repartition(partitions)
    facts, edits = repair.repair(repair.damage(turns) if damaged else turns, **({"block_rows": block_rows} if block_rows else {}))
    got = {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost) for r in facts.collect()}
    return {r.conv_id: (*got[r.conv_id], r.audit, r.repaired_sha256) for r in repair.digests(edits).collect()}, edits


@pytest.mark.parametrize("block_rows", [None, 3])
def test_cheapest_edits(spark, block_rows):
    rng = random.Random(11)
    rows = some_rows(rng, [*range(-5, 120), None, 2**40], 12)
    got, _ = found(spark, rows, block_rows=block_rows)
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    want = {c: plain(r) for c, r in by.items()}
    assert set(got) <= set(want)
    for c, w in want.items():
        assert got.get(c, (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())) == w, by[c]


def test_a_long_conversation_is_shared_out(spark):
    """One conversation holds nearly all rows: it comes in many blocks, cut anywhere, and is repaired as if it were one."""
    rng = random.Random(12)
    rows = [(7, i, rng.choice(["user", "assistant", "system"]), rng.choice([f"Turn {i}.", f"turn {i}", "Same.", ""])) for i in range(1500)] + some_rows(rng, range(8, 20), 6) + some_rows(rng, range(5), 6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got, edits = found(spark, rows, damaged=False, block_rows=64)
        assert edits.where("conv = '7'").select("part").distinct().count() > 1 and edits.where("conv = '7'").count() >= 1500 / 64
        assert got[7] == plain([r for r in rows if r[0] == 7], damaged=False)
        text = "\n".join(f"{r.role}:{r.text}" for r in repair.repaired_turns(edits).where("conv_id = 7").orderBy("part", "seq", "pos").collect())
        assert hashlib.sha256(text.encode()).hexdigest() == got[7][-1]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_blocks_compose():
    """Any cut of a conversation into blocks leads through the same edits."""
    rng = random.Random(13)
    for _ in range(300):
        tokens = [(rng.choice("suaux"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randrange(1, 12))]
        rows = [({"s": "system", "u": "user", "a": "assistant", "x": "x"}[t[0]], f"{i}", t[1], t[2]) for i, t in enumerate(tokens)]
        cost, audit, lines = cheapest(rows)
        cuts = sorted({0, len(tokens), *(rng.randrange(len(tokens) + 1) for _ in range(3))})
        parts = [tokens[a:b] for a, b in zip(cuts, cuts[1:])]
        path, tail = repair.way_through([repair.block_table(p) for p in parts])
        done = [repair._rows_of(p, [r[:2] for r in rows[a:]], q, e, tail if b == len(tokens) else None) for p, (q, e), a, b in zip(parts, path, cuts, cuts[1:])]
        edits = [x for _, part in done for x in part]
        assert (sum(c for c, _ in done), "".join(x["edit"] for x in edits)) == (cost, audit)
        assert [x["role"] + ":" + x["text"] for x in edits if x["edit"] != "D"] == list(lines)


def test_awkward_tables(spark):
    got, edits = found(spark, [])
    assert got == {} and edits.count() == 0
    rows = [(1, 0, "user", "x" * 2_000_000), (1, 1, "assistant", "ok."), (2, None, None, None), (3, 5, "system", "Only."), (4, 0, "assistant", "a. " + " " * 100_000)]
    got, _ = found(spark, rows, damaged=False)
    assert got == {c: plain([r for r in rows if r[0] == c], damaged=False) for c in (1, 2, 3, 4)}
    rows = [(9, 0, "user", "Again.")] * 3000
    got, _ = found(spark, rows, damaged=False)
    assert got[9] == plain(rows, damaged=False)


def test_query_gives_every_conversation(spark, tmp_path):
    import duckdb

    rows = some_rows(random.Random(14), [*range(60), None], 9)
    spark.createDataFrame([(*r, "x", "y") for r in rows], TURNS).write.parquet(str(tmp_path / "conversations.parquet"))
    cols = "conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256"
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    want = con.execute(f"select {cols} from ({queries.ORACLE_SQL['op11_role_earley']})").fetchall()
    got = queries.op11_role_earley(spark, str(tmp_path)).select(*cols.split(", ")).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
