"""Byte-level BPE (operator 10): higher-order functions fold ranked merges over the distinct words of a batch of documents."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches, texts_of

#: Bytes of text whose words are encoded together; a longer text is a batch of its own.
BATCH_BYTES = 6 << 20
#: Documents whose repeated words are folded first, once for all tasks (a sample of about so many): this bounds what is broadcast, and only time depends on it.
FIRST_DOCS = 8_000
#: Words of one row, and the distinct words that a task remembers before it begins anew.
ROW_WORDS, TASK_WORDS = 1 << 14, 1 << 20
#: Bytes from which a word is merged by a heap where it is found, as the fold takes steps in the square of a word's length.
LONG_WORD = 512
#: A bound above every token id, and the entry of a pair that is no token.
IDS, EMPTY = 1 << 16, 1 << 40
#: Bits of a symbol's place in its word, below an entry of the map.
PLACE_BITS = 20


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def merges_of(ranks: dict[bytes, int]) -> np.ndarray:
    """(left id, right id, id) of every pair of tokens that is a token: what a pair of neighbours merges into, at that rank."""
    out = []
    for t, i in ranks.items():
        for cut in range(1, len(t)):
            a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
            if a is not None and b is not None:
                out.append((a, b, i))
    return np.array(out or np.empty((0, 3)), np.int64)


def rank_tables(merges: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(shift, mark, slots): the rank map as a sparse matrix, its rows laid over one another without overlap.

    The entry of a pair is slots[shift[left] + right] = mark[left] | merged id, with mark = left << 16; what no pair owns is EMPTY. Shifts of ids without pairs lead beyond the slots.
    """
    shift, mark = np.full(width, 1 << 30, np.int64), np.arange(width, dtype=np.int64) << 16
    free = np.ones(4 * width + 4 * len(merges) + 8, bool)
    slots = np.full(len(free), EMPTY, np.int64)
    order = np.lexsort((merges[:, 1], merges[:, 0]))
    rows = merges[order]
    cuts = np.searchsorted(rows[:, 0], np.arange(width + 1))
    low = start = width  # all below low is taken; rows as long as the last one found no place between low and start
    length = 0
    for left in np.argsort(-np.diff(cuts), kind="stable"):
        own = rows[cuts[left] : cuts[left + 1]]
        if not len(own):
            break
        right = own[:, 1]
        if len(own) != length:
            length, start = len(own), low
        at = max(start, low)
        while True:
            tried = at + np.nonzero(free[at : at + 512])[0] - right[0]
            fits = np.nonzero(free[tried[:, None] + right].all(1))[0]
            if len(fits):
                shift[left] = tried[fits[0]]
                break
            at += 512
        start = at
        place = shift[left] + right
        slots[place], free[place] = mark[left] | own[:, 2], False
        while not free[low]:
            low += 1
    return shift, mark, slots[: np.nonzero(~free)[0].max(initial=0) + 1]


@lru_cache(maxsize=4)
def _rank_map(path: str, changed: int) -> tuple[dict[bytes, int], np.ndarray, tuple]:
    """Ranks, merges and rank tables of a file as of the time of its last change: laid out once, then kept."""
    ranks = read_ranks(path)
    if max(ranks.values(), default=0) >= IDS:
        raise ValueError(f"ids of {IDS} and more are not supported")
    merges = merges_of(ranks)
    return ranks, merges, rank_tables(merges, max(ranks.values(), default=0) + 1)


def _literal(values, kind: str = "bigint") -> Column:
    """A constant array: the optimizer folds it into one literal."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>")


def fold_merges(symbols: Column, shift: Column, slots: Column) -> Column:
    """The ids that ranked merging leaves of an array of ids (int): in each step the pair of lowest rank, leftmost first, becomes one.

    An entry differs from its row's mark in the low 16 bits alone, so the exclusive or is the merged id for a pair in the map
    and larger than any id for every other pair; with the pair's place below it, the least of these numbers tells both. The last symbol has no pair: null.
    """

    def step(s: Column, _: Column) -> Column:
        def ranked(x: Column, i: Column) -> Column:
            merged = F.get(slots, F.get(shift, x) + F.get(s, i + 1)).bitwiseXOR(F.shiftleft(x.cast("bigint"), 16))
            return F.shiftleft(merged, PLACE_BITS).bitwiseOR(i.cast("bigint"))

        least = F.transform(F.array(F.array_min(F.transform(s, ranked))), lambda m: _merged_at(s, m))  # a let
        return F.get(least, F.lit(0))

    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.size(symbols) - 1, F.lit(1))), symbols, step)


def _merged_at(s: Column, m: Column) -> Column:
    """The symbols with the pair that the number m names made one, or as they are if it names no pair."""
    at = m.bitwiseAND(F.lit((1 << PLACE_BITS) - 1)).cast("int")
    one = F.array(F.shiftright(m, PLACE_BITS).cast("int"))
    return F.when(m < (IDS << PLACE_BITS), F.concat(F.slice(s, F.lit(1), at), one, F.slice(s, at + 3, F.size(s)))).otherwise(s)


def _pieces(ranks: dict[bytes, int]) -> Column:
    """The tokens' bytes by id, as a literal of hex texts; nothing where no token has the id."""
    names = [""] * (max(ranks.values(), default=-1) + 1)
    for t, i in ranks.items():
        names[i] = t.hex()
    return F.split(F.lit(",".join(names)), ",")


def decoded(ids: Column, pieces: Column) -> Column:
    """The bytes of an array of ids: the concatenation of their binary pieces. pieces: hex text by id."""
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(pieces, i.cast("int"))), ""))


def heap_merged(symbols: list[int], pairs: dict[tuple[int, int], int]) -> list[int]:
    """What fold_merges gives, by a heap of the pairs and links between neighbours: n log n steps for n symbols."""
    s, n = list(symbols), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := pairs.get((s[i], s[i + 1]))) is not None]
    heapq.heapify(heap)
    while heap:
        r, i = heapq.heappop(heap)
        j = after[i] if s[i] >= 0 else n
        if j >= n or pairs.get((s[i], s[j])) != r:
            continue  # one of the two was merged meanwhile
        s[i], s[j] = r, -1
        after[i] = k = after[j]
        if k < n:
            before[k] = i
            if (m := pairs.get((r, s[k]))) is not None:
                heapq.heappush(heap, (m, i))
        if (h := before[i]) >= 0 and (m := pairs.get((s[h], r))) is not None:
            heapq.heappush(heap, (m, h))
    return [x for x in s if x >= 0]


def _bytes_of(texts: pa.StringArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts on end, and where each begins (and the last ends)."""
    _, offsets, data = texts.buffers()
    ends = np.frombuffer(offsets, np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.empty(0, np.uint8)
    return data, ends.astype(np.int64) - int(ends[0])


def _on_end(data: pa.Buffer, ends: np.ndarray, kind: pa.DataType) -> pa.Array:
    """Texts that lie on end in data."""
    return pa.Array.from_buffers(kind, len(ends) - 1, [None, pa.py_buffer(ends.astype(np.int32)), data])


def cut_runs(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Runs of all texts, and how many each text has. A text is cut before each blank or line feed that follows anything else.

    No match of the pattern lies across such a place, unless other white space is near; texts that hold any are one run.
    """
    data, ends = _bytes_of(texts)
    space = (data == 32) | (data == 10)
    cut = np.zeros(len(data) + 1, bool)
    cut[1:-1] = space[1:] & ~space[:-1]
    other = ((data >= 9) & (data <= 13) & (data != 10)) | ((data >= 28) & (data <= 31))
    if len(data) > 2 and (data > 127).any():
        x, y, z = data[:-2], data[1:-1], data[2:]
        wide = (x == 0xE1) & (y == 0x9A) & (z == 0x80) | (x == 0xE2) & (y == 0x81) & (z == 0x9F) | (x == 0xE3) & (y == 0x80) & (z == 0x80)
        wide |= (x == 0xE2) & (y == 0x80) & ((z <= 0x8A) | (z == 0xA8) | (z == 0xA9) | (z == 0xAF))
        other[:-2] |= wide
        other[:-1] |= (data[:-1] == 0xC2) & ((data[1:] == 0x85) | (data[1:] == 0xA0))
    for i in np.unique(np.searchsorted(ends, np.nonzero(other)[0], side="right") - 1).tolist():
        cut[ends[i] : ends[i + 1]] = False
    cut[ends[:-1]] = True
    cut[-1] = False
    starts = np.nonzero(cut)[0]
    return _on_end(pa.py_buffer(data), np.r_[starts, len(data)], pa.string()), np.diff(np.searchsorted(starts, ends))


def first_words(texts: DataFrame, pattern: str, known, single: list[int], folded, names: Column) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, pa.Array]:
    """(number of each word, its ids on end, where each word's end, their bytes) of words that about FIRST_DOCS of texts(doc_id, text) have more than once.

    folded(symbols) gives the ids of a word. Tokens, and words of LONG_WORD bytes and more, are left out.
    """

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        match, direct, of_byte = regex.compile(pattern), known.value[0], np.array(single, np.int32)
        n: dict[bytes, int] = {}
        for batch in batches:
            runs = cut_runs(batch.column(1))[0].value_counts()
            for x, c in zip(runs.field(0).to_pylist(), runs.field(1).to_pylist()):
                for w in match.findall(x):
                    w = w.encode("utf-8", "surrogatepass")
                    if len(w) < LONG_WORD and w not in direct:
                        n[w] = n.get(w, 0) + c
        words = list(n)
        for s in range(0, len(words), ROW_WORDS):
            own = words[s : s + ROW_WORDS]
            symbols = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, own)]).astype(np.int32)), pa.array(of_byte[np.frombuffer(b"".join(own), np.uint8)]))
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.binary()), symbols, pa.array([n[w] for w in own], pa.int64())], ["word", "symbols", "n"])

    total = texts.count()
    drawn = texts.sample(min(1.0, FIRST_DOCS / max(1, total)), 7)
    words = drawn.mapInArrow(counted, "word binary, symbols array<int>, n long").groupBy("word").agg(F.first("symbols").alias("symbols"), F.sum("n").alias("n")).where("n > 1")
    got = words.select("word", folded(F.col("symbols")).alias("ids")).select("word", "ids", decoded(F.col("ids"), names).alias("bytes")).toArrow().combine_chunks()
    lists = got.column("ids").combine_chunks() if got.num_rows else pa.array([], pa.list_(pa.int32()))
    flat = lists.flatten().to_numpy().astype(np.int32)
    ends = np.cumsum(lists.value_lengths().to_numpy().astype(np.int64))
    data = got.column("bytes").combine_chunks().cast(pa.binary()) if got.num_rows else pa.array([], pa.binary())
    return {w: i for i, w in enumerate(got.column("word").to_pylist())}, flat, ends, data


def encode(docs: DataFrame, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (decimal, parted by blanks), decoded (binary) for every row of docs.

    Each match of pattern is encoded by itself: a match that is a token is its id, any other is merged from its bytes by rank.
    decoded is what the ids stand for, piece by piece. Null and empty texts have no ids. Repeated rows and null ids are
    returned as they come; other columns are ignored; an empty table gives no rows.

    In one pass without a shuffle: a task cuts its texts into words, batch by batch, and hands on rows of the distinct words it
    has not met before, then a row that holds the batch's texts as word numbers; Spark folds the words and concatenates the
    binary pieces of what they became; then the documents' ids and bytes are put together from their words'. Rows of a
    partition keep their order through these steps, so a word is folded once a task. Words that a sample of FIRST_DOCS documents has more than once are folded before that, for all tasks. A task that has met TASK_WORDS words
    forgets them all and says so in the next row, which bounds memory. Words of LONG_WORD bytes and more are merged by a heap.
    """
    spark = docs.sparkSession
    small_batches(spark)
    ranks, merges, (shift, _, slots) = _rank_map(ranks_path, os.stat(ranks_path).st_mtime_ns)
    known = spark.sparkContext.broadcast((ranks, merges))
    single = [ranks[bytes([b])] for b in range(256)]
    names, texts = _pieces(ranks), texts_of(docs, id_col, text_col)
    folded = lambda w: fold_merges(w, _literal(shift, "int"), _literal(slots))
    first = spark.sparkContext.broadcast(first_words(texts, pattern, known, single, folded, names))
    kind = "doc_ids array<long>, words array<array<int>>, done array<array<int>>, of_run binary, sizes binary, codes binary, counts binary, reset boolean"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        match, (direct, merges), before = regex.compile(pattern), known.value, first.value[0]
        base = IDS + len(before)
        pairs: dict[tuple[int, int], int] = {}
        words: dict[bytes, int] = {}
        of_byte = np.array(single, np.int32)
        ints = pa.list_(pa.list_(pa.int32()))

        def row(ids: list, fresh: list[bytes], done: list[list[int]], blobs: tuple, reset: bool) -> pa.RecordBatch:
            symbols = of_byte[np.frombuffer(b"".join(fresh), np.uint8)]
            lists = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, fresh)]).astype(np.int32)), pa.array(symbols))
            columns = [pa.array([ids], pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array([0, len(fresh)], pa.int32()), lists), pa.array([done], ints)]
            columns += [pa.array([b], pa.binary()) for b in blobs] + [pa.array([reset], pa.bool_())]
            return pa.RecordBatch.from_arrays(columns, ["doc_ids", "words", "done", "of_run", "sizes", "codes", "counts", "reset"])

        def flush(ids: list, held: list[pa.StringArray]) -> Iterator[pa.RecordBatch]:
            reset = len(words) >= TASK_WORDS
            if reset:
                words.clear()
            known_before = len(words)
            runs, counts = cut_runs(pa.concat_arrays(held))
            coded = runs.dictionary_encode()
            of_run, sizes, long = [], [], []
            for x in coded.dictionary.to_pylist():
                plain = x.isascii() and (x.isalpha() or x[:1] == " " and x[1:].isalpha())
                own = [w.encode("utf-8", "surrogatepass") for w in ([x] if plain else match.findall(x))]
                # tokens keep their id; other words are numbered from IDS on: those folded first, then the task's, long ones after all others of the batch
                for w in own:
                    if w in direct:
                        of_run.append(direct[w])
                    elif w in before:
                        of_run.append(IDS + before[w])
                    elif len(w) < LONG_WORD or w in words:
                        of_run.append(base + words.setdefault(w, len(words)))
                    else:
                        long.append((len(of_run), w))
                        of_run.append(0)
                sizes.append(len(own))
            fresh = list(islice(words, known_before, None))
            for s in range(0, len(fresh), ROW_WORDS):
                yield row([], fresh[s : s + ROW_WORDS], [], (b"", b"", b"", b""), reset)
                reset = False
            if long and not pairs:
                pairs.update(((a, b), i) for a, b, i in merges.tolist())
            for at, w in long:
                if w not in words:
                    words[w] = len(words)
                    yield row([], [], [heap_merged(of_byte[np.frombuffer(w, np.uint8)].tolist(), pairs)], (b"", b"", b"", b""), reset)
                    reset = False
                of_run[at] = base + words[w]
            blobs = (np.array(of_run, "<i4"), np.array(sizes, "<i4"), coded.indices.to_numpy().astype("<i4"), counts.astype("<i4"))
            yield row(ids, [], [], tuple(b.tobytes() for b in blobs), reset)

        ids, held, size = [], [], 0
        for batch in batches:
            texts, own = batch.column(1), batch.column(0).to_pylist()
            ends = _bytes_of(texts)[1]
            at = 0
            while at < len(own):
                upto = max(at + (not held), int(np.searchsorted(ends, ends[at] + BATCH_BYTES - size, side="right")) - 1)
                if upto > at:
                    held.append(texts.slice(at, upto - at))
                    ids += own[at:upto]
                    size += int(ends[upto] - ends[at])
                    at = upto
                if at < len(own):
                    yield from flush(ids, held)
                    ids, held, size = [], [], 0
        if held:
            yield from flush(ids, held)

    rows = texts.mapInArrow(cut, kind)
    merged = F.concat(F.transform("words", folded), "done")
    rows = rows.withColumn("words", merged).withColumn("bytes", F.transform("words", lambda ids: decoded(ids, names))).drop("done")

    def assemble(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        direct = {i: t for t, i in known.value[0].items()}
        every = range(max(direct, default=-1) + 1)
        name, piece = pa.array([f" {i}" for i in every], pa.string()), pa.array([direct.get(i, b"") for i in every], pa.binary())
        _, ids0, ends0, bytes0 = first.value
        begin = lambda: ([ids0], [np.concatenate([[0], ends0])], [bytes0])  # noqa: E731  ids of the words, where each word's end, their bytes
        flat, ends, data = begin()
        for batch in batches:
            for r in range(batch.num_rows):
                one = {n: c[r] for n, c in zip(batch.schema.names, batch.columns)}
                if one["reset"].as_py():
                    flat, ends, data = begin()
                lists = one["words"].values
                if len(lists):
                    ends.append(ends[-1][-1] + np.cumsum(np.diff(lists.offsets.to_numpy())))
                    flat.append(lists.flatten().to_numpy())
                    data.append(one["bytes"].values)
                ids = one["doc_ids"].as_py()
                if not ids:
                    continue
                flat, ends, data = [np.concatenate(flat)], [np.concatenate(ends)], [pa.concat_arrays(data)]
                of_run, sizes, codes, counts = (np.frombuffer(one[c].as_py(), "<i4").astype(np.int64) for c in ("of_run", "sizes", "codes", "counts"))
                merged = of_run >= IDS
                at = np.where(merged, of_run - IDS, 0)
                n = np.where(merged, np.diff(ends[0], append=0)[at], 1)
                source = np.where(merged, ends[0][at], len(flat[0]) + np.arange(len(of_run)))
                stop = np.cumsum(n)
                own = np.concatenate([flat[0], of_run])[np.repeat(source - stop + n, n) + np.arange(n.sum())]
                words = np.concatenate([[0], np.cumsum(sizes)])  # the words of each run
                bounds = np.concatenate([[0], stop])[words]  # and its ids
                docs_at = np.concatenate([[0], np.cumsum(counts)])

                def joined(parts: pa.Array, of_run: np.ndarray) -> pa.Array:
                    """The documents' texts from parts of the runs."""
                    _, offsets, buffer = parts.buffers()
                    runs = _on_end(buffer, np.frombuffer(offsets, np.int32)[of_run], parts.type)
                    _, offsets, buffer = runs.take(pa.array(codes)).buffers()
                    return _on_end(buffer, np.frombuffer(offsets, np.int32)[docs_at], parts.type)

                of_word = np.where(merged, at, len(data[0]) + np.where(merged, 0, of_run))
                texts = joined(name.take(pa.array(own)), bounds)
                binary = joined(pa.concat_arrays([data[0], piece]).take(pa.array(of_word)), words)
                total = np.concatenate([[0], np.cumsum(np.diff(bounds)[codes])])
                columns = [pa.array(ids, pa.int64()), pa.array(np.diff(total[docs_at])), pc.utf8_ltrim(texts, " "), binary]
                for s in range(0, len(ids), 500):
                    yield pa.RecordBatch.from_arrays([c.slice(s, 500) for c in columns], ["doc_id", "n_tokens", "ids", "decoded"])

    return rows.mapInArrow(assemble, "doc_id long, n_tokens long, ids string, decoded binary")


def decode(rows: DataFrame, ranks_path: str, ids_col: str = "ids") -> DataFrame:
    """rows with decoded (binary): the bytes that ids (decimal, parted by blanks; null or empty: none) stand for.

    Ids are looked up in a literal table and their binary pieces concatenated, without Python. An id that is no token has no bytes.
    """
    names = _pieces(read_ranks(ranks_path))
    ids = F.filter(F.split(F.coalesce(F.col(ids_col), F.lit("")), " "), lambda x: x != "")
    return rows.withColumn("decoded", decoded(ids, names))
