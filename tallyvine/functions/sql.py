"""The library's functions by name, for queries that are SQL alone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from . import canonical, hashing, schemas


def rev_link(raws: pd.Series, algorithms: pd.Series) -> pd.Series:
    """The link (hex text) that a revision's JSON text gives under "sha3" or "blake3"; null if it gives none."""
    out = []
    for raw, alg in zip(raws, algorithms):
        try:
            out.append("0x" + canonical.link_of(canonical.load(raw), alg).hex() if raw is not None else None)
        except (canonical.Refused, KeyError, TypeError, ValueError, AttributeError):
            out.append(None)
    return pd.Series(out, dtype=object)


def multihash_error(links: pd.Series) -> pd.Series:
    """Why bytes are no multihash link; null if they are one."""
    return pd.Series([hashing.link_error(None if x is None else bytes(x)) for x in links], dtype=object)


def schema_problems(texts: pd.Series, values: pd.Series) -> pd.Series:
    """Where a JSON text breaks a JSON Schema text, as pointer: keyword; "unchecked" if that cannot be told."""
    out = []
    for schema, value in zip(texts, values):
        try:
            out.append(schemas.problems(canonical.load(schema), canonical.load(value)))
        except (canonical.Refused, ValueError, TypeError, AttributeError, KeyError):
            out.append(["unchecked"])
    return pd.Series(out, dtype=object)


def merkle_root(leaves: pd.Series) -> pd.Series:
    """The SHA3-256 Merkle root of an array of nodes; null of an empty one and of one with a null."""
    return pd.Series([None if x is None or any(n is None for n in x) else hashing.merkle_root([bytes(n) for n in x], "sha3") for x in leaves], dtype=object)


class FlattenPointers:
    """A row for each node of a JSON text, numbered in pointer order; one row with an error for what is no strict JSON."""

    def eval(self, raw: str):
        try:
            if raw is None:
                raise canonical.Refused("missing")
            for i, (p, v) in enumerate(canonical.pointer_map(canonical.load(raw))):
                yield i, p, canonical.render(v), None
        except canonical.Refused as e:
            yield None, None, None, str(e)


def register(spark: SparkSession) -> None:
    """rev_link, multihash_error, schema_problems, merkle_root, bare_digest, rev_kind and the table function flatten_pointers, for this session.

    The last two functions but one are SQL expressions and stay inside the engine.
    """
    from ..plans import catalogue

    for f, kind in ((rev_link, "string"), (multihash_error, "string"), (schema_problems, "array<string>"), (merkle_root, "binary")):
        spark.udf.register(f.__name__, F.pandas_udf(f, kind))
    spark.udtf.register("flatten_pointers", F.udtf(FlattenPointers, returnType="idx: int, pointer: string, value: string, error: string"))
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION bare_digest(link BINARY) RETURNS BINARY RETURN CASE WHEN length(link) = 32 THEN link WHEN length(link) = 34 AND hex(substr(link, 1, 2)) IN ('1620', '1E20') THEN substr(link, 3) END")
    spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION rev_kind(type STRING) RETURNS STRING RETURN {catalogue.kind_sql('type')}")
