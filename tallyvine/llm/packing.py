"""Best-fit packing (operator 3): pattern packing by non-negative least squares over the histogram of lengths."""

from __future__ import annotations

import bisect
import json
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, single_thread, small_batches, texts_of

#: Rows of one length that one task ranks.
RANKED_TOGETHER = 50_000
#: Texts that the rank-based encoder leaves to the tokenizer itself: an added token or white space other than blank and line
#: feed (libraries differ there), and scripts whose character classes changed between Unicode versions.
UNUSUAL = re.compile(r"<\||[^ -~\n\xa1-\u02ff\u0370-\u0373\u0391-\u03a1\u03a3-\u03ff\u0400-\u0482\u048a-\u04ff]")

_loaded: dict[int, tuple] = {}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Token bytes by id, if the file is a plain byte-level BPE whose merges come in the order of their ids; else None."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    if spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex") or model.get("ignore_merges"):
        return None
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
    char = {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
    made = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
    added = {t["content"] for t in spec["added_tokens"]}
    ranks = {bytes(char[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    return ranks if made == sorted(made) and len(ranks) == len(made) + 256 else None


def _worker_state(key: int, content) -> tuple:
    """The tokenizer, and an encoder that gives the same ids from its ranks several times faster (None: not of that kind)."""
    if key not in _loaded:
        single_thread()
        import tiktoken
        from public_tokenizers import PATTERN
        from tokenizers import Tokenizer

        ranks = _ranks(json.loads(content.value))
        _loaded[key] = (Tokenizer.from_str(content.value.decode()), ranks and tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}))
    return _loaded[key]


def _id_bytes(text: str, tok, fast) -> bytes:
    """The token ids of a text as little-endian unsigned 32-bit numbers."""
    if fast is None or UNUSUAL.search(text):
        return np.asarray(tok.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    return fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: every document as token ids and end_id, cut into pieces where it is longer than capacity.

    The remainder comes first, so that all later pieces fill a sequence each. An empty or null text is the one id end_id.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    key, content = zlib.crc32(data), spark.sparkContext.broadcast(data)
    end = int(end_id).to_bytes(4, "little")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tok, fast = _worker_state(key, content)
        for pdf in batches:
            rows = []
            for d, text in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                b = _id_bytes(text, tok, fast) + end
                n = len(b) // 4
                first = n % capacity or capacity
                bounds = [0, *range(first, n + 1, capacity)]
                rows += [(d, p, s, e - s, zlib.crc32(b[4 * s : 4 * e])) for p, (s, e) in enumerate(zip(bounds, bounds[1:]))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out.astype({"doc_id": "Int64", "piece": "int32"} | {c: "int64" for c in ("start", "length", "ids_crc32")})

    return texts_of(docs, id_col, text_col).mapInPandas(cut, "doc_id long, piece int, start long, length long, ids_crc32 long")


def patterns_of(present: np.ndarray, capacity: int) -> np.ndarray:
    """Rows (a, b, c), a >= b >= c, of lengths that fill a sequence exactly; c is 0 in a pair, b and c in a single."""
    have = np.zeros(capacity + 1, bool)
    have[present] = True
    have[0] = True
    a, b = np.meshgrid(np.arange(capacity + 1), np.arange(capacity + 1), indexing="ij")
    c = capacity - a - b
    good = (a >= b) & (b >= c) & (c >= 0)
    a, b, c = a[good], b[good], c[good]
    good = have[a] & have[b] & have[c] & (a > 0)
    return np.stack([a[good], b[good], c[good]], 1)


def fit_repeats(patterns: np.ndarray, hist: np.ndarray, steps: int = 400) -> np.ndarray:
    """Non-negative least squares by accelerated projected gradients: repeats x >= 0 whose lengths come nearest to hist."""
    if not len(patterns):
        return np.zeros(0)
    flat, n = patterns.ravel(), len(hist)
    live = np.ones(n)
    live[0] = 0

    def made(x):
        return np.bincount(flat, weights=np.repeat(x, 3), minlength=n) * live

    def back(r):
        r = r * live
        return r[patterns].sum(1)

    v = np.ones(len(patterns))
    for _ in range(12):  # the largest eigenvalue bounds the step
        v = back(made(v))
        v /= np.linalg.norm(v) or 1
    step = 1 / max(1e-9, float(v @ back(made(v))) * 1.05)
    x = y = np.zeros(len(patterns))
    t = 1.0
    for _ in range(steps):
        new = np.maximum(0, y - step * back(made(y) - hist * live))
        t2 = (1 + math.sqrt(1 + 4 * t * t)) / 2
        y = new + (t - 1) / t2 * (new - x)
        x, t = new, t2
    return x


def plan_sequences(hist: dict[int, int], capacity: int = 1024, most_patterns: int = 2048) -> list[tuple[tuple[int, ...], int]]:
    """(lengths of one sequence, repeats) whose lengths together are hist, to the last one.

    hist has capacity entries at most, so all of this is small whatever the corpus. Patterns of up to three documents are
    fitted, the largest ones refitted and rounded down; what is left is packed best fit, as runs of equal sequences.
    """
    left = np.zeros(capacity + 1, np.int64)
    for n, c in hist.items():
        left[n] += c
    plan: list[tuple[tuple[int, ...], int]] = []
    if left[capacity]:
        plan.append(((capacity,), int(left[capacity])))
        left[capacity] = 0
    pats = patterns_of(np.nonzero(left)[0], capacity)
    if len(pats):
        x = fit_repeats(pats, left.astype(float))
        keep = np.argsort(-x, kind="stable")[:most_patterns]
        pats = pats[keep]
        x = fit_repeats(pats, left.astype(float), 800)
        for i in np.argsort(-x, kind="stable"):
            lens = [int(n) for n in pats[i] if n]
            r = int(x[i] + 0.5)
            for n in set(lens):
                r = min(r, int(left[n]) // lens.count(n))
            if r > 0:
                plan.append((tuple(lens), r))
                for n in lens:
                    left[n] -= r
    present = [int(n) for n in np.nonzero(left)[0]]
    while present:
        lens = [present[-1]]
        used = {lens[0]: 1}
        room = capacity - lens[0]
        while room > 0:
            at = bisect.bisect_right(present, room) - 1
            while at >= 0 and used.get(present[at], 0) >= left[present[at]]:
                at -= 1
            if at < 0:
                break
            lens.append(present[at])
            used[present[at]] = used.get(present[at], 0) + 1
            room -= present[at]
        r = min(int(left[n]) // k for n, k in used.items())
        plan.append((tuple(lens), r))
        for n, k in used.items():
            left[n] -= r * k
            if not left[n]:
                present.remove(n)
    return plan


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 1024, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: every piece of every document, placed.

    Only the histogram of lengths (capacity rows) reaches the driver; the plan made of it goes back as runs of places, some
    thousands of rows at most, and each piece takes the place of its rank among the pieces of its length. Ranks are counted
    in buckets of bounded size, so one length may hold any share of the rows. Null and empty texts are one token long;
    repeated rows and null ids are packed each. An empty table gives no rows. Other columns are ignored.
    """
    spark = docs.sparkSession
    pieces = materialize(token_pieces(docs, tokenizer_path, capacity, end_id, id_col, text_col), "pieces")
    hist = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    runs, sequence, taken = [], 0, dict.fromkeys(hist, 0)
    for lens, r in plan_sequences(hist, capacity):
        at = 0
        for n in lens:
            runs.append((n, taken[n], taken[n] + r, sequence - taken[n], at))
            taken[n] += r
            at += n
        sequence += r
    places = spark.createDataFrame(runs or [(0, 0, 0, 0, 0)], "length long, first long, past long, shift long, offset long")
    buckets = max(1, math.ceil(max(hist.values(), default=1) / RANKED_TOGETHER))
    keyed = pieces.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(buckets)).cast("int"))
    sizes = keyed.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("from"))
    within = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = keyed.withColumn("at", F.row_number().over(within) - 1).join(starts, ["length", "bucket"]).withColumn("rank", F.col("from") + F.col("at")).alias("r")
    p = F.broadcast(places.alias("p"))  # its size is bound by the number of lengths
    hit = (F.col("r.length") == F.col("p.length")) & (F.col("r.rank") >= F.col("p.first")) & (F.col("r.rank") < F.col("p.past"))
    return ranked.join(p, hit).select("r.doc_id", "r.piece", "r.start", "r.length", "r.ids_crc32", (F.col("r.rank") + F.col("p.shift")).alias("sequence_id"), F.col("p.offset").alias("offset"))
