"""Digests, multihash links and Merkle trees: Arrow functions over whole batches, and columns where Spark has the pieces."""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Multihash prefixes (code, length 32) and domain tags of the tree hash.
PREFIX = {"sha3": b"\x16\x20", "blake3": b"\x1e\x20"}
NODE, LEAF, VALUE, LABEL = b"\x01", b"\x00", b"\x02", b"\x03"
SALT_KEY = b"AquaSD"
_INNER, _OUTER = (bytes(b ^ pad for b in range(256)) for pad in (0x36, 0x5C))  # HMAC's pads

# The BLAKE3 specification's initial words, message order and flags.
_IV = np.array([0x6A09E667, 0xBB67AE85, 0x3C6EF372, 0xA54FF53A, 0x510E527F, 0x9B05688C, 0x1F83D9AB, 0x5BE0CD19], np.uint32)
_ORDER = [2, 6, 3, 10, 7, 0, 4, 13, 1, 11, 12, 5, 9, 14, 15, 8]
_START, _END, _PARENT, _ROOT = 1, 2, 4, 8


def _compress(cv: list[int], block: bytes, counter: int, length: int, flags: int) -> list[int]:
    mask = 0xFFFFFFFF
    m = [int.from_bytes(block[i : i + 4], "little") for i in range(0, 64, 4)]
    v = [*cv, *(int(x) for x in _IV[:4]), counter & mask, counter >> 32, length, flags]

    def mix(a: int, b: int, c: int, d: int, x: int, y: int) -> None:
        for word, r1, r2 in ((x, 16, 12), (y, 8, 7)):
            v[a] = (v[a] + v[b] + word) & mask
            t = v[d] ^ v[a]
            v[d] = (t >> r1 | t << (32 - r1)) & mask
            v[c] = (v[c] + v[d]) & mask
            t = v[b] ^ v[c]
            v[b] = (t >> r2 | t << (32 - r2)) & mask

    for _ in range(7):
        for i in range(4):
            mix(i, 4 + i, 8 + i, 12 + i, m[2 * i], m[2 * i + 1])
        for i in range(4):
            mix(i, 4 + (i + 1) % 4, 8 + (i + 2) % 4, 12 + (i + 3) % 4, m[8 + 2 * i], m[9 + 2 * i])
        m = [m[i] for i in _ORDER]
    return [v[i] ^ v[i + 8] for i in range(8)]


def blake3(data: bytes) -> bytes:
    """BLAKE3-256 of data."""
    iv = [int(x) for x in _IV]

    def chunk(at: int, number: int, root: int) -> list[int]:
        part = data[at : at + 1024]
        blocks = [part[i : i + 64] for i in range(0, len(part), 64)] or [b""]
        cv = iv
        for i, b in enumerate(blocks):
            flags = (_START if i == 0 else 0) | ((_END | root) if i == len(blocks) - 1 else 0)
            cv = _compress(cv, b.ljust(64, b"\0"), number, len(b), flags)
        return cv

    def tree(first: int, n: int, root: int) -> list[int]:
        if n == 1:
            return chunk(first * 1024, first, root)
        left = 1 << ((n - 1).bit_length() - 1)
        pair = tree(first, left, 0) + tree(first + left, n - left, 0)
        return _compress(iv, b"".join(x.to_bytes(4, "little") for x in pair), 0, 64, _PARENT | root)

    words = tree(0, max(1, -(-len(data) // 1024)), _ROOT)
    return b"".join(x.to_bytes(4, "little") for x in words)


def digest(data: bytes, algorithm: str) -> bytes:
    """32 bytes; sha256 serves as a stand-in where results are compared with an engine that has no SHA-3, and is never a link."""
    if algorithm == "sha3":
        return hashlib.sha3_256(data).digest()
    if algorithm == "blake3":
        return blake3(data)
    if algorithm == "sha256":
        return hashlib.sha256(data).digest()
    raise ValueError(f"unknown hash {algorithm!r}")


def multihash(d: bytes, algorithm: str) -> bytes:
    return PREFIX[algorithm] + d


def link_error(link: bytes | None) -> str | None:
    """Why bytes are no multihash link, else None. The first failing rule names the error: varints, code, length, size."""
    if link is None:
        return "missing"
    at, values = 0, []
    for _ in range(2):
        value, shift = 0, 0
        while True:
            if at >= len(link):
                return "truncated"
            b = link[at]
            at += 1
            value |= (b & 0x7F) << shift
            shift += 7
            if not b & 0x80:
                if b == 0 and shift > 7:
                    return "non_minimal"
                break
            if shift >= 63:
                return "out_of_range"
        values.append(value)
    if values[0] not in (0x16, 0x1E):
        return "unknown_code"
    if values[1] != 32:
        return "wrong_length"
    if len(link) - at < 32:
        return "truncated"
    return "trailing" if len(link) - at > 32 else None


def merkle_root(leaves: list[bytes], algorithm: str = "sha3") -> bytes | None:
    """Pairs are hashed level by level, an odd last node moves up as it is; one leaf is its own root, none has no root."""
    level = list(leaves)
    while len(level) > 1:
        pairs = zip(level[::2], level[1::2])
        up = [hashlib.sha3_256(NODE + a + b).digest() for a, b in pairs] if algorithm == "sha3" else [digest(NODE + a + b, algorithm) for a, b in pairs]
        level = up + level[len(level) - len(level) % 2 :]
    return level[0] if level else None


def inclusion_proof(leaves: list[bytes], index: int, algorithm: str = "sha3") -> list[bytes]:
    """The siblings from the leaf up to the root."""
    out, level = [], list(leaves)
    while len(level) > 1:
        if index ^ 1 < len(level):
            out.append(level[index ^ 1])
        up = [digest(NODE + level[i] + level[i + 1], algorithm) for i in range(0, len(level) - 1, 2)]
        level = up + level[len(level) - len(level) % 2 :]
        index //= 2
    return out


def verify_inclusion(leaf: bytes, index: int, size: int, proof: list[bytes], root: bytes, algorithm: str = "sha3") -> bool:
    """Whether proof leads from the leaf at index of a tree of size leaves to root; every sibling is used."""
    if not 0 <= index < size:
        return False
    node, last, rest = leaf, size - 1, list(proof)
    while last:
        if index % 2 or index < last:
            if not rest:
                return False
            other = rest.pop(0)
            node = digest(NODE + (other + node if index % 2 else node + other), algorithm)
        index, last = index // 2, last // 2
    return not rest and node == root


def _states(key: bytes) -> tuple:
    """The inner and outer states of HMAC under a key of one block at most."""
    key = key.ljust(hashlib.sha3_256().block_size, b"\0")
    return hashlib.sha3_256(key.translate(_INNER)), hashlib.sha3_256(key.translate(_OUTER))


_keyed = lru_cache(1)(_states)


@lru_cache(maxsize=1 << 14)
def _info(pointer: str) -> bytes:
    """What HKDF's step takes for a pointer."""
    return pointer.encode() + b"\x01"


def salts(nonce: bytes) -> Callable[[str], bytes]:
    """The salt of each pointer under a nonce: one HKDF step of SHA3-256 over the nonce, whose keyed states are made once."""
    inner, outer = (x.copy() for x in _keyed(SALT_KEY))
    inner.update(nonce)
    outer.update(inner.digest())
    inner, outer = _states(outer.digest())

    def salted(pointer: str) -> bytes:
        a, b = inner.copy(), outer.copy()
        a.update(_info(pointer))
        b.update(a.digest())
        return b.digest()

    return salted


def salt(nonce: bytes, pointer: str) -> bytes:
    """The salt of one pointer."""
    return salts(nonce)(pointer)


def value_commit(salted: bytes, rendered: str, algorithm: str) -> bytes:
    data = VALUE + salted + rendered.encode()
    return hashlib.sha3_256(data).digest() if algorithm == "sha3" else digest(data, algorithm)


@lru_cache(maxsize=1 << 14)
def _label(pointer: str, algorithm: str) -> bytes:
    """The head of the leaf of a pointer: records of one type share their pointers."""
    return LEAF + digest(LABEL + pointer.encode(), algorithm)


def leaf_hash(pointer: str, commit: bytes, algorithm: str) -> bytes:
    data = _label(pointer, algorithm) + commit
    return hashlib.sha3_256(data).digest() if algorithm == "sha3" else digest(data, algorithm)


def batch_leaf(link: bytes, nonce: bytes) -> bytes:
    """The leaf of a link in a batch tree, shielded by a nonce."""
    return digest(LEAF + digest(link + nonce, "sha3"), "sha3")


def digest_column(data: Column, algorithm: str) -> Column:
    """The digest of a binary column; null stays null."""

    @F.pandas_udf("binary")
    def hashed(x: pd.Series) -> pd.Series:
        return x.map(lambda b: None if b is None else digest(bytes(b), algorithm))

    return hashed(data)


def merkle_root_column(leaves: Column, algorithm: str = "sha3") -> Column:
    """The root of an array<binary> column; an empty or null array has none."""

    @F.pandas_udf("binary")
    def roots(x: pd.Series) -> pd.Series:
        return x.map(lambda v: None if v is None else merkle_root([bytes(b) for b in v], algorithm))

    return roots(leaves)


def merkle_root_sql(leaves: Column) -> Column:
    """The root of an array<binary> column by SHA-256, in higher-order functions alone: 24 levels, so arrays of up to 2**24 leaves."""

    def up(level: Column, _: Column) -> Column:
        n = F.size(level)
        pairs = F.transform(
            F.sequence(F.lit(1), F.greatest(F.ceil(n / 2), F.lit(1)).cast("int")),
            lambda i: F.when(
                2 * i <= n, F.unhex(F.sha2(F.concat(F.lit(NODE), F.get(level, 2 * i - 2), F.get(level, 2 * i - 1)), 256))
            ).otherwise(F.get(level, 2 * i - 2)),
        )
        return F.when(n > 1, pairs).otherwise(level)

    return F.get(F.aggregate(F.sequence(F.lit(1), F.lit(24)), leaves, up), F.lit(0))


def link_ok(link: Column) -> Column:
    """Whether a binary column holds a well-formed multihash link, without Python."""
    head = F.hex(F.substring(link, 1, 2))
    return F.coalesce((F.length(link) == 34) & head.isin("1620", "1E20"), F.lit(False))


def bare_digest(link: Column) -> Column:
    """The 32 bytes that a link or a bare digest stands for, else null."""
    return F.when(F.length(link) == 32, link).when(link_ok(link), F.substring(link, 3, 32))


def parse_hex(text: Column) -> Column:
    """The bytes of 0x and lower-case hex pairs, else null."""
    return F.when(text.rlike("^0x([0-9a-f]{2})*$"), F.unhex(F.substring(text, 3, 1 << 30)))


def render_hex(data: Column) -> Column:
    return F.concat(F.lit("0x"), F.lower(F.hex(data)))
