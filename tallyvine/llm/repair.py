"""Conversation structure repair (operator 11): error-correcting Earley parsing under a weighted grammar of roles.

Read from its last turn to its first, a well-formed conversation is S -> nothing | P | P s and P -> a u | P a u, with s, u and a the
initials of system, user and assistant. Further productions let a turn be deleted, given another role, or be inserted, each at a
cost. P is left-recursive in this direction, so all items of a chart begin where reading began, and a set of the chart holds four kernel items
at most, whatever the length: ITEMS below. Each keeps its least (cost, audit); an audit grows at its front, so the audits of a set
are ranked by their first letter and the rank of the rest, and no text of audits is compared or copied.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, small_batches

#: The kernel items by what they have read: nothing, an assistant's turn, pairs, pairs and a system's turn.
ITEMS = ("S -> .", "P -> a . u", "S -> P .", "S -> P s .")
#: Where each terminal takes an item, and the items that are complete.
SCAN = {"a": {0: 1, 2: 1}, "u": {1: 2}, "s": {2: 3}}
COMPLETE = (0, 2, 3)
MADE = {1: "assistant", 2: "user"}
#: Costs of the productions.
RENAME, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
LEGAL = {"su", "ua", "au"}
#: Turns and bytes of a block of one conversation; a longer one is parsed block by block, wherever its blocks lie.
BLOCK_ROWS, BLOCK_BYTES = 4096, 4 << 20
SPACE = " \t\n\x0b\x0c\r"
#: Seeds of the last block: nothing read, or turns inserted at the very end.
END = {0: (0, 0), 1: (INSERT, 1), 2: (2 * INSERT, 2)}


def parse(tokens: list[tuple[str, bool, bool]], seeds: dict[int, tuple[int, int]]) -> tuple[list[list], list, list]:
    """(chart, costs, ranks): tokens (initial, to be deleted, cut off) are read from the last to the first.

    seeds has (cost, rank of the audit) of the items at the right end. chart[i][item] is (letter, item before, whether that is of the same
    set) of the set in front of token i; costs and ranks (equal for equal audits) are those of the first set, None for items that cannot be reached.
    """
    costs: list = [seeds[k][0] if k in seeds else None for k in range(4)]
    ranks: list = [seeds[k][1] if k in seeds else None for k in range(4)]
    chart: list = [None] * len(tokens)
    for i in range(len(tokens) - 1, -1, -1):
        initial, gone, cut = tokens[i]
        best: list = [None] * 4  # (cost, order of the audit, letter, item before, same set)
        for k in range(4):
            if costs[k] is None:
                continue
            moves = [(k, DELETE, "D")]
            if not gone:
                more = CUT_OFF if cut else 0
                for t in "aus":
                    to = SCAN[t].get(k)
                    if to is not None and t == initial:
                        moves.append((to, more, "K"))
                    elif to is not None and t != "s":
                        moves.append((to, RENAME + more, "R"))
            for to, cost, letter in moves:
                offer = (costs[k] + cost, (letter, ranks[k]), letter, k, False)
                if best[to] is None or offer[:2] < best[to][:2]:
                    best[to] = offer
        for k, to in ((0, 1), (2, 1), (1, 2)):  # insertions stay in the set; two in a row are enough
            if best[k] is not None:
                offer = (best[k][0] + INSERT, ("I", best[k][1]), "I", k, True)
                if best[to] is None or offer[:2] < best[to][:2]:
                    best[to] = offer
        order = {key: n for n, key in enumerate(sorted({b[1] for b in best if b is not None}))}
        chart[i] = [None if b is None else b[2:] for b in best]
        costs = [None if b is None else b[0] for b in best]
        ranks = [None if b is None else order[b[1]] for b in best]
    return chart, costs, ranks


def edits_of(chart: list[list], item: int) -> tuple[list[tuple[str, int, int]], int]:
    """([(letter, token, item)], item at the right end): the edits that lead from an item of the first set, from left to right."""
    out, i = [], 0
    while i < len(chart):
        letter, before, same = chart[i][item]
        out.append((letter, i, item))
        item, i = before, i if same else i + 1
    return out, item


def block_table(tokens: list[tuple[str, bool, bool]]) -> tuple[list[int], list[int]]:
    """(costs, ranks) of the 16 ways through a block: from item q of its first set to item e at its right end, at 4 q + e, -1 for none.

    Ranks are of the audits between. Every audit ends with a letter that takes a turn, so none goes on where another ends,
    and the audits of whole conversations compare block by block.
    """
    costs, audits = [-1] * 16, {}
    for e in range(4):
        chart, found, _ = parse(tokens, {e: (0, 0)})
        for q in range(4):
            if found[q] is not None:
                costs[4 * q + e] = found[q]
                audits[4 * q + e] = "".join(x[0] for x in edits_of(chart, q)[0])
    order = {a: n for n, a in enumerate(sorted(set(audits.values())))}
    return costs, [order[audits[j]] if j in audits else -1 for j in range(16)]


def way_through(blocks: list[tuple[list[int], list[int]]]) -> tuple[list[tuple[int, int]], int]:
    """([(q, e)], item at the end): the items between which each block of a conversation is parsed, from the tables of its blocks."""
    costs, ranks, back = {k: c for k, (c, _) in END.items()}, {k: r for k, (_, r) in END.items()}, []
    for c, r in reversed(blocks):
        best = {}
        for q in range(4):
            ways = [(c[4 * q + e] + costs[e], (r[4 * q + e], ranks[e]), e) for e in costs if c[4 * q + e] >= 0]
            if ways:
                best[q] = min(ways)
        order = {key: n for n, key in enumerate(sorted({b[1] for b in best.values()}))}
        costs, ranks = {q: b[0] for q, b in best.items()}, {q: order[b[1]] for q, b in best.items()}
        back.append({q: b[2] for q, b in best.items()})
    q = min((k for k in COMPLETE if k in costs), key=lambda k: (costs[k], ranks[k]))
    path = []
    for step in reversed(back):
        path.append((q, step[q]))
        q = step[q]
    return path, q


BLOCKS = (
    "conv string, part int, seq int, whole boolean, blank long, duplicate long, truncated long, illegal long, first string, last string, "
    "cost long, costs array<int>, ranks array<int>, edits array<struct<edit: string, role: string, text: string>>"
)


def _rows_of(tokens, rows, q: int, e: int | None, tail: int | None) -> tuple[int, list[dict]]:
    """(cost, edits with the role and text that each leaves): through tokens from item q to e, with the turns inserted at the end if tail is the item there."""
    chart, costs, ranks = parse(tokens, END if e is None else {e: (0, 0)})
    if e is None:
        q = min((k for k in COMPLETE if costs[k] is not None), key=lambda k: (costs[k], ranks[k]))
    out = []
    steps, last = edits_of(chart, q)
    for letter, i, item in steps:
        role, text = rows[i]
        out.append({"edit": letter, "role": role if letter in "KD" else MADE[item], "text": "" if letter == "I" else text})
    cost = costs[q]
    tail = last if e is None else tail
    if tail is not None:
        cost += 0 if e is None else END[tail][0]
        out += [{"edit": "I", "role": MADE[k], "text": ""} for k in range(tail, 0, -1)]
    return cost, out


def _token(role: str, blank: bool, again: bool, cut: bool) -> tuple[str, bool, bool]:
    return role[:1], blank or again, cut


def _blocks(batches: Iterator[pd.DataFrame], most: int = BLOCK_ROWS) -> Iterator[pd.DataFrame]:
    """Blocks of a partition's conversations, which come in order. Those at its two ends may go on elsewhere, so they are not whole."""
    from pyspark import TaskContext

    part = TaskContext.get().partitionId()
    names = [x.split()[0] for x in BLOCKS.split(", ") if x.split()[0] not in ("role:", "text:")][:14]

    def block(conv, seq: int, whole: bool, rows: list[tuple]) -> tuple:
        tokens, kept, counts, illegal = [], [], [0, 0, 0], 0
        for role, text, blank, first, cut, n in rows:
            for copy in range(n):
                again = copy > 0 or not first
                fault = 0 if blank else 1 if again else 2 if cut else None
                if fault is not None:
                    counts[fault] += 1
                if tokens and tokens[-1][0] + role[:1] not in LEGAL:
                    illegal += 1
                tokens.append(_token(role, blank, again, cut))
                kept.append((role, text))
        ends = tokens[0][0], tokens[-1][0]
        if whole:
            cost, edits = _rows_of(tokens, kept, 0, None, None)
            return conv, part, seq, True, *counts, illegal, *ends, cost, None, None, edits
        costs, ranks = block_table(tokens)
        raw = [{"edit": "".join(str(int(x)) for x in t[1:]), "role": r, "text": x} for t, (r, x) in zip(tokens, kept)]
        return conv, part, seq, False, *counts, illegal, *ends, None, costs, ranks, raw

    conv, rows, size, turns, seq, opening, out = None, [], 0, 0, 0, True, []
    begun = False
    for pdf in batches:
        for c, *row in pdf.itertuples(index=False, name=None):
            c = None if c is None or c != c else c
            if begun and c != conv:
                out.append(block(conv, seq, seq == 0 and not opening, rows))
                rows, size, turns, seq, opening = [], 0, 0, 0, False
            elif rows and (turns >= most or size >= BLOCK_BYTES):
                out.append(block(conv, seq, False, rows))
                rows, size, turns, seq = [], 0, 0, seq + 1
            conv, begun = c, True
            rows.append(row)
            size, turns = size + len(row[1]), turns + row[5]
            if len(out) >= 500:
                yield pd.DataFrame(out, columns=names)
                out = []
    if begun:
        out.append(block(conv, seq, False, rows))
    if out:
        yield pd.DataFrame(out, columns=names)


def _paths(pdf: pd.DataFrame) -> pd.DataFrame:
    """The way through each block of a conversation, from their tables alone."""
    pdf = pdf.sort_values(["part", "seq"])
    path, tail = way_through([(list(c), list(r)) for c, r in zip(pdf["costs"], pdf["ranks"])])
    out = pdf[["conv", "part", "seq"]].copy()
    out["q"], out["e"] = [p[0] for p in path], [p[1] for p in path]
    out["tail"] = [-1] * (len(path) - 1) + [tail]
    ends = list(zip(pdf["first"], pdf["last"]))
    out["seam"] = [0] + [int(ends[i - 1][1] + ends[i][0] not in LEGAL) for i in range(1, len(ends))]
    return out


def _finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        cost, edits = [], []
        for raw, q, e, tail in zip(pdf["edits"], pdf["q"], pdf["e"], pdf["tail"]):
            tokens = [(x["role"][:1], x["edit"][0] == "1", x["edit"][1] == "1") for x in raw]
            c, found = _rows_of(tokens, [(x["role"], x["text"]) for x in raw], q, e, None if tail < 0 else tail)
            cost.append(c)
            edits.append(found)
        pdf["cost"], pdf["edits"] = cost, edits
        yield pdf[["conv", "part", "seq", "cost", "edits"]]


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies of turns as crc32("conv_id:turn") mod 20 damages them; nulls count as one space.

    0 drops a row, 1 empties its text, 2 takes "." "!" "?" out of it, 3 repeats it, 4 makes its role user; the others stay.
    """
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    d = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn"))) % 20
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), text("role").alias("role"), text("text").alias("text"), d.alias("d"))
    return rows.where("d <> 0").select(
        "conv_id",
        "turn",
        F.when(F.col("d") == 4, "user").otherwise(F.col("role")).alias("role"),
        F.when(F.col("d") == 1, "").when(F.col("d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text")).alias("text"),
        F.when(F.col("d") == 3, 2).otherwise(1).alias("copies"),
    )


def repair(turns: DataFrame, block_rows: int = BLOCK_ROWS) -> tuple[DataFrame, DataFrame]:
    """(facts, edits) of turns(conv_id, turn, role, text, and copies: how often a row counts, if there is such a column).

    facts, a row for every conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost. edits, a row a block of a conversation: conv,
    part, seq (in this order), edits: what is done to its turns in order ("K" keep, "R" rerole, "D" delete, "I" insert) with the role
    and text that each leaves. The cheapest edits stand; of several the audit (their letters) that is least in ASCII.

    Turns come in the order of turn (null first), role, text. Null roles and texts count as one space; a role counts by its first letter, and one
    that is not s, u or a, the empty one too, can only be reroled or deleted. Turns without a letter that is not white space, and those whose role
    and text were met before in their conversation, must be deleted. Rows without a conv_id form one conversation; repeated rows are duplicates of the
    first; an empty table gives no rows; other columns are ignored.

    Equal rows are counted before they are shuffled. Turns are sorted over the whole table by range, so a conversation of any length is shared out;
    a task parses blocks of it for every item that may stand at their ends, and only 16 costs and ranks a block meet in one place to
    choose the way through.
    """
    spark = turns.sparkSession
    small_batches(spark)
    n = F.col("copies") if "copies" in turns.columns else F.lit(1)
    text = lambda c: F.coalesce(F.col(c), F.lit(" ")).alias(c)
    rows = turns.select(F.col("conv_id").cast("string").alias("conv"), F.col("turn").cast("long").alias("turn"), text("role"), text("text"), n.cast("long").alias("n"))
    rows = rows.groupBy("conv", "turn", "role", "text").agg(F.sum("n").alias("n")).withColumn("had", F.col("turn").isNotNull()).withColumn("digest", F.sha2("text", 256))
    rows = materialize(rows, "turns")
    first = rows.groupBy("conv", "role", "digest").agg(F.min(F.struct("had", "turn")).alias("at"))
    first = first.select(F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), F.col("at.had").alias("h"), F.col("at.turn").alias("t"), F.lit(True).alias("first"))
    on = F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d")) & (F.col("had") == F.col("h")) & F.col("turn").eqNullSafe(F.col("t"))
    bare = F.rtrim(F.col("text"), F.lit(SPACE))
    marked = rows.join(first, on, "left").select("conv", "turn", "role", "text", (bare == "").alias("blank"), F.coalesce("first", F.lit(False)).alias("first"), (~F.right(bare, F.lit(1)).isin(".", "!", "?")).alias("cut"), "n")
    order = ["conv", "turn", "role", "text"]
    ordered = materialize(marked, "marked").repartitionByRange(*order).sortWithinPartitions(*order).select("conv", "role", "text", "blank", "first", "cut", "n")
    blocks = materialize(ordered.mapInPandas(partial(_blocks, most=block_rows), BLOCKS), "blocks")
    open_ = blocks.where("not whole")
    ways = materialize(open_.select("conv", "part", "seq", "costs", "ranks", "first", "last").groupBy("conv").applyInPandas(_paths, "conv string, part int, seq int, q int, e int, tail int, seam long"), "ways")
    same = F.col("conv").eqNullSafe(F.col("conv2")) & (F.col("part") == F.col("part2")) & (F.col("seq") == F.col("seq2"))
    met = open_.select("conv", "part", "seq", "edits").join(ways.select(F.col("conv").alias("conv2"), F.col("part").alias("part2"), F.col("seq").alias("seq2"), "q", "e", "tail"), same)
    done = met.drop("conv2", "part2", "seq2").mapInPandas(_finish, "conv string, part int, seq int, cost long, edits array<struct<edit: string, role: string, text: string>>")
    edits = materialize(blocks.where("whole").select("conv", "part", "seq", "cost", "edits").unionByName(done), "edits")
    sums = blocks.select("conv", "blank", "duplicate", "truncated", "illegal", F.lit(0).cast("long").alias("cost"))
    zero = [F.lit(0).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")]
    sums = sums.unionByName(ways.select("conv", *zero, F.col("seam").alias("illegal"), F.lit(0).cast("long").alias("cost")))
    sums = sums.unionByName(edits.select("conv", *zero, F.lit(0).cast("long").alias("illegal"), "cost"))
    counted = sums.groupBy("conv").agg(*(F.sum(c).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")))
    gaps = rows.groupBy("conv").agg(F.coalesce(F.max("turn") - F.min("turn") + 1 - F.countDistinct("turn"), F.lit(0)).alias("gaps"))
    facts = counted.join(gaps.withColumnRenamed("conv", "c"), F.col("conv").eqNullSafe(F.col("c")))
    return facts.select(F.col("conv").cast("long").alias("conv_id"), "gaps", "blank", "duplicate", "truncated", "illegal", "cost"), edits


def digests(edits: DataFrame) -> DataFrame:
    """conv_id, audit, repaired_sha256 of the blocks of edits that repair() gives: the letters of all edits, and the SHA-256 (hex) of the repaired "role:text", joined by newlines.

    A hash takes a conversation's text in its order, so one task reads it; it does so a batch of blocks at a time and keeps the hash and the audit only.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        conv, begun, audit, sha, lines, out = None, False, [], hashlib.sha256(), False, []
        for pdf in batches:
            for c, edits_ in zip(pdf["conv"].tolist(), pdf["edits"]):
                c = None if c is None or c != c else c
                if begun and c != conv:
                    out.append((conv, "".join(audit), sha.hexdigest()))
                    audit, sha, lines = [], hashlib.sha256(), False
                conv, begun = c, True
                for x in edits_:
                    audit.append(x["edit"])
                    if x["edit"] != "D":
                        sha.update((("\n" if lines else "") + x["role"] + ":" + x["text"]).encode())
                        lines = True
                audit = ["".join(audit)]
            if len(out) >= 1000:
                yield pd.DataFrame(out, columns=["conv", "audit", "repaired_sha256"])
                out = []
        if begun:
            out.append((conv, "".join(audit), sha.hexdigest()))
        if out:
            yield pd.DataFrame(out, columns=["conv", "audit", "repaired_sha256"])

    dealt = edits.select("conv", "part", "seq", "edits").repartition("conv").sortWithinPartitions("conv", "part", "seq")
    return dealt.mapInPandas(run, "conv string, audit string, repaired_sha256 string").select(F.col("conv").cast("long").alias("conv_id"), "audit", "repaired_sha256")


def repaired_turns(edits: DataFrame) -> DataFrame:
    """conv_id, part, seq, pos, edit, role, text: the repaired turns of repair()'s edits, in the order of part, seq and pos."""
    rows = edits.select(F.col("conv").cast("long").alias("conv_id"), "part", "seq", F.posexplode("edits").alias("pos", "x"))
    return rows.where("x.edit <> 'D'").select("conv_id", "part", "seq", "pos", "x.edit", "x.role", "x.text")


def repair_sql() -> str:
    """The facts and digests of damaged conversations in SQL: a turn a step of a recursion, from the last to the first."""
    ins = lambda k, to: f"CASE WHEN {k} IS NOT NULL THEN {{'c': {k}.c + {INSERT}, 'a': 'I' || {k}.a, 't': chr(10) || '{MADE[to]}:' || {k}.t}} END"
    gone = lambda k: f"CASE WHEN {k} IS NOT NULL THEN {{'c': {k}.c + {DELETE}, 'a': 'D' || {k}.a, 't': {k}.t}} END"
    extra = f"CASE WHEN cut THEN {CUT_OFF} ELSE 0 END"
    keep = lambda k, t: f"CASE WHEN {k} IS NOT NULL AND NOT must AND left(role, 1) = '{t}' THEN {{'c': {k}.c + {extra}, 'a': 'K' || {k}.a, 't': chr(10) || role || ':' || text || {k}.t}} END"
    name = lambda k, to: f"CASE WHEN {k} IS NOT NULL AND NOT must AND left(role, 1) <> '{MADE[to][0]}' THEN {{'c': {k}.c + {RENAME} + {extra}, 'a': 'R' || {k}.a, 't': chr(10) || '{MADE[to]}:' || text || {k}.t}} END"
    return f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS k FROM conversations
), crc AS (
  SELECT *, xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], flatten(list_transform(string_split(k, ''), lambda x: [CAST(ascii(x) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c % 2 = 1 THEN 3988292384 ELSE 0 END) END)) % 20 AS d FROM keyed
), damaged AS (
  SELECT conv_id, turn, CASE WHEN d = 4 THEN 'user' ELSE role END AS role, CASE WHEN d = 1 THEN '' WHEN d = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(range(CASE WHEN d = 3 THEN 2 ELSE 1 END)) AS copy FROM crc WHERE d <> 0
), numbered AS (
  SELECT conv_id, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i, count(*) OVER (PARTITION BY conv_id) AS n FROM damaged
), marked AS (
  SELECT *, bare = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right(bare, 1) NOT IN ('.', '!', '?') AS cut,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY i), 1) || left(role, 1) NOT IN ('su', 'ua', 'au') AND i > 1 AS wrong FROM numbered
), steps AS (SELECT *, blank OR again AS must FROM marked), chart AS (
  SELECT conv_id, n + 1 AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 't': ''}} AS k0, {{'c': CAST({INSERT} AS BIGINT), 'a': 'I', 't': chr(10) || 'assistant:'}} AS k1,
    {{'c': CAST({2 * INSERT} AS BIGINT), 'a': 'II', 't': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS k2, CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, t VARCHAR)) AS k3 FROM (SELECT DISTINCT conv_id, n FROM steps)
  UNION ALL
  SELECT conv_id, i, n0, m1, list_min([n2, {ins('m1', 2)}]), n3 FROM (
    SELECT *, list_min([n1, {ins('n0', 1)}, {ins('n2', 1)}]) AS m1 FROM (
      SELECT c.conv_id, s.i, {gone('k0')} AS n0, list_min([{gone('k1')}, {keep('k0', 'a')}, {keep('k2', 'a')}, {name('k0', 1)}, {name('k2', 1)}]) AS n1,
        list_min([{gone('k2')}, {keep('k1', 'u')}, {name('k1', 2)}]) AS n2, list_min([{gone('k3')}, {keep('k2', 's')}]) AS n3
      FROM chart c JOIN steps s ON c.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = c.i - 1))
), best AS (SELECT conv_id, list_min([k0, k2, k3]) AS b FROM chart WHERE i = 1),
facts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE again AND NOT blank) AS duplicate,
    count(*) FILTER (WHERE cut AND NOT must) AS truncated, count(*) FILTER (WHERE wrong) AS illegal FROM steps GROUP BY conv_id
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(substr(coalesce(b.t, ''), 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o LEFT JOIN facts f ON o.conv_id IS NOT DISTINCT FROM f.conv_id LEFT JOIN best ON o.conv_id IS NOT DISTINCT FROM best.conv_id
"""
