"""Bodies of the templates that verification knows by itself: files and the four signature suites."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.canonical import render
from .catalogue import FOUNDATION, link_of_name
from .changes import VERSION

DRAFT = "https://json-schema.org/draft/2020-12/schema"

# The template of file objects.
FILE = {
    "revision_type": link_of_name("template_meta"),
    "nonce": "0x2ba6a8b9b987cf8c3567f72871812ae9",
    "local_timestamp": 1762266013,
    "version": VERSION,
    "method": "scalar",
    "schema": {
        "$schema": DRAFT,
        "type": "object",
        "properties": {
            "type": {"const": "file", "type": "string", "maxLength": 140},
            "hash": {"type": "string", "pattern": "^0x[0-9a-f]{64,128}$"},
            "hash_type": {
                "description": "Hash function identifier: either FIPS_202-SHA3-256 or a custom hashing type.",
                "anyOf": [{"type": "string", "const": "FIPS_202-SHA3-256"}, {"type": "string", "minLength": 1, "maxLength": 128}],
            },
            "descriptor": {"type": "string", "maxLength": 140},
            "size": {"type": "integer", "minimum": 0},
            "content_type": {"type": "string", "maxLength": 140},
        },
        "required": ["type", "hash", "hash_type", "descriptor", "size", "content_type"],
        "additionalProperties": False,
    },
    "bounds": {
        "max_chain_depth": 64, "structural_links": {"required": 0, "max": 0}, "max_signature_branches": 4,
        "max_timestamp_branches": 1, "max_anchor_branches": 4, "max_total_revisions": 1024,
    },
}
# Number, suite, description and hex members (name, pattern, description) of each signature template, in the order of the numbers.
SIGNATURES = (
    (1, "signature_eip191", "ethereum:eip-191", "EIP-191 personal-sign signature (secp256k1)", (
        ("signature", "^0x[0-9a-fA-F]{130}$", "65-byte EIP-191 signature (r || s || v), hex-encoded"),
        ("signature_public_identifier", "^0x[0-9a-fA-F]{40}$", "20-byte Ethereum address, hex-encoded"),
    )),
    (2, "signature_ed25519", "ed25519", "Ed25519 signature (RFC 8032 §5.1)", (
        ("signature", "^0x[0-9a-fA-F]{128}$", "64-byte Ed25519 signature (R || S), hex-encoded"),
        ("signature_public_identifier", "^0x[0-9a-fA-F]{64}$", "32-byte Ed25519 public key, hex-encoded"),
    )),
    (3, "signature_p256", "ecdsa:p256", "ECDSA P-256 signature (NIST FIPS 186-5)", (
        ("signature", "^0x[0-9a-fA-F]{128}$", "64-byte ECDSA signature (r || s), big-endian, hex-encoded"),
        ("signature_public_identifier", "^0x[0-9a-fA-F]{66}$", "33-byte compressed SEC1 public key, hex-encoded"),
    )),
    (4, "signature_webauthn", "webauthn:p256", "WebAuthn/Passkey P-256 signature", (
        ("signature", "^0x[0-9a-fA-F]{128}$", "64-byte ECDSA signature (r || s), big-endian, hex-encoded"),
        ("signature_public_identifier", "^0x[0-9a-fA-F]{66}$", "33-byte compressed SEC1 credential public key, hex-encoded"),
        ("authenticator_data", "^0x[0-9a-fA-F]+$", "authenticatorData bytes from WebAuthn assertion, hex-encoded"),
        ("client_data_json", "^0x[0-9a-fA-F]+$", "clientDataJSON bytes from WebAuthn assertion, hex-encoded"),
    )),
)
# The bounds that all signature templates share.
SIGNATURE_BOUNDS = {
    "max_chain_depth": 3, "structural_links": {"required": 0, "max": 0}, "max_signature_branches": 0,
    "max_timestamp_branches": 1, "max_anchor_branches": 1, "max_total_revisions": 3,
}


def bodies() -> dict[str, dict]:
    """name: body of every template that is resolved without being given."""
    base = link_of_name("signature_base")
    out = {"file": FILE}
    for number, name, suite, about, members in SIGNATURES:
        properties = {m: {"description": d, "pattern": p, "type": "string"} for m, p, d in members}
        schema = {"$schema": DRAFT, "additionalProperties": False, "description": about, "properties": properties | {"signature_type": {"const": suite}},
                  "required": ["signature_type", *(m for m, _, _ in members)], "type": "object"}
        out[name] = {"revision_type": link_of_name("template_meta"), "nonce": f"0x{number:032x}", "local_timestamp": 0, "version": VERSION, "method": "scalar",
                     "schema": schema, "bounds": SIGNATURE_BOUNDS, "derives_from": base, "ancestry": [base]}
    return out


def templates(spark: SparkSession) -> DataFrame:
    """tree_id (null: for all trees), link, raw of the built-in templates."""
    rows = [(None, bytearray.fromhex(link_of_name(n)[2:]), render(body)) for n, body in bodies().items()]
    return spark.createDataFrame(rows, "tree_id string, link binary, raw string")


def known(spark: SparkSession) -> DataFrame:
    """tree_id (null: for all trees), target of what anchors may link to without it being given: the built-in templates, by link or bare digest."""
    digests = [FOUNDATION[n] for n in bodies()]
    return spark.createDataFrame([(None, bytearray.fromhex(p + d)) for d in digests for p in ("1620", "")], "tree_id string, target binary")
