"""Token counts (operator 7): batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import single_thread, small_batches, texts_of

#: Bytes of text that are handed to the tokenizer in one call, and words that a worker remembers.
CALL_BYTES, REMEMBERED = 1 << 20, 400_000
#: Longer words are encoded each time they occur.
LONGEST_REMEMBERED = 64

_loaded: dict[int, tuple] = {}


def _worker_state(key: int, content) -> tuple:
    """The tokenizer and its memory of word lengths: one of each in a Python worker."""
    if key not in _loaded:
        single_thread()
        name, data = content.value
        if name.endswith(".model"):
            import sentencepiece

            sp = sentencepiece.SentencePieceProcessor(model_proto=data)
            _loaded[key] = (lambda ws: [len(x) for x in sp.encode(ws, num_threads=1)], None)
        else:
            from tokenizers import Tokenizer

            tok = Tokenizer.from_str(data.decode())
            encode = lambda ws: [len(x) for x in tok.encode_batch(ws, add_special_tokens=False)]
            _loaded[key] = (encode, {} if _drops_blanks(encode) else None)
    return _loaded[key]


def _drops_blanks(encode) -> bool:
    """Whether blanks and line feeds are no tokens or parts of tokens, so that words can be counted by themselves."""
    words = ["a", "bc", "Word", "12", "é"]
    alone = dict(zip(words, encode(words)))
    tried = [" ", "\n", "  \n ", *(x + gap + y for x in words for gap in (" ", "\n", " \n  ") for y in words)]
    want = [0, 0, 0, *(alone[x] + alone[y] for x in words for _ in range(3) for y in words)]
    return encode(tried) == want


def _by_bytes(items: list[str], limit: int) -> Iterator[list[str]]:
    """Runs of items of about limit bytes each; a longer item is a run of its own."""
    run, n = [], 0
    for x in items:
        size = len(x) if x.isascii() else len(x.encode("utf-8", "surrogatepass"))
        if run and n + size > limit:
            yield run
            run, n = [], 0
        run.append(x)
        n += size + 8
    if run:
        yield run


def _word_lengths(texts: list[str], encode, memory: dict[str, int]) -> list[int]:
    """Blanks and line feeds never lie within a token of these tokenizers (white space is dropped), so texts are cut there
    and each distinct word is encoded once."""
    parts = [t.replace("\n", " ").split(" ") for t in texts]
    new = {w for w in set().union(*parts) if w not in memory}
    if len(memory) + len(new) > REMEMBERED:
        memory.clear()
        new = set().union(*parts)
    for run in _by_bytes(list(new), CALL_BYTES):
        memory.update(zip(run, encode(run)))
    get = memory.__getitem__
    out = [sum(map(get, p)) for p in parts]
    for w in new:
        if len(w) > LONGEST_REMEMBERED:
            del memory[w]
    return out


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs.

    tokenizer_path: a tokenizers .json or a sentencepiece .model. Texts are split at blanks and line feeds only if the tokenizer is found
    to drop them; others are encoded whole.
    The file is read by the driver and sent to the workers once. Null and empty texts: 0 tokens, 0 bytes. Repeated rows and
    null ids are returned as they come; other columns are ignored. Nothing is shuffled.
    """
    spark = docs.sparkSession
    small_batches(spark)
    with open(tokenizer_path, "rb") as f:
        data = f.read()
    key, content = zlib.crc32(data), spark.sparkContext.broadcast((tokenizer_path, data))

    def lengths(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode, memory = _worker_state(key, content)
        for pdf in batches:
            n: list[int] = []
            for run in _by_bytes(pdf["text"].tolist(), CALL_BYTES):
                n += encode(run) if memory is None else _word_lengths(run, encode, memory)
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_bytes": pdf["n_bytes"], "n_tokens": pd.Series(n, dtype="int64", index=pdf.index)})

    base = texts_of(docs, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = base.mapInPandas(lengths, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
