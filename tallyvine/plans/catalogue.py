"""Known templates by digest: kinds of revisions by what they name as their type, signature suites, rules for typed payloads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.hashing import parse_hex

# Names and SHA3-256 digests of the foundation templates and of the typed payloads' templates.
FOUNDATION = {
    "anchor_template": "479a304927c47f4308d027a858060ce287a9bdb45f2203f8130574a73511e899",
    "file": "00f3abb3d74fc9dfc2b961cea906b3211716188f4de6f588180fdfcbbfa3fe53",
    "signature_base": "bdc93b4152c0163e40d3bf8cb956e235f0150731c1e8c8b50d9c3b7abe50e4a7",
    "signature_ed25519": "baf1d5d47eef50dcde3931956879bb30c5580064a92ce43ed4c6bd8b878b659a",
    "signature_eip191": "57090c9095a2e9af36e9b6cb4574196fa973c44a210e703bd15dab2623dbd370",
    "signature_p256": "23a2cdd4618224a67235321e2dfeffac9ab1809175549d8b5402dd5c5376d81c",
    "signature_webauthn": "2cdea1604c08b4e23f5415d8fcf885cf86d0a3e017cf4b7989c41aa99f3f2188",
    "template_meta": "f3040850a8836717dd73e87d046723e11f9e9870e3b2e246803ad842fbf01155",
}
TYPED = {
    "audit_agent_response": "e36f3af11b2c6d5c94e2862e4a66db016ff8e8f5486fe72594daa7df480c5413",
    "audit_agent_thinking": "fe1d5fd50335d5d21f3f1976baadc9eab68a0506241ed5303bb8ad0a25a407f1",
    "audit_agent_tool_call": "13d08a7ea2a0dc5f4d5a380d9dd9456ec10392bc752f152517dd227bb272592f",
    "audit_api_response": "6d1e300bbb0145cedc1a2ff19fd1ad0e0dcfcfde6a4a9b0d6ea67c7d31c4a129",
    "audit_artifact": "431668e53b2181311ec43db30ff4d4cf738059051829a5a4f3398c22440a16f3",
    "audit_hitl_approval": "cd588f6994409f3088eef84d231027ba69a1d9d7193fcb1bf0d07a1716ba6560",
    "audit_round_anchor": "f174f2f669d102d3d74efb80248a08485fe2c40d18b2df5ccc7d225e794b63e7",
    "audit_session_close": "9069525103b9408f039a41454d25ed5ffc59aed9e46224cb19864f2e71e0c23b",
    "audit_tool_result": "ad46f51cfce3fd961acb2a3d9047b4c217c3da43c32addc41e8e11b84b5c4732",
    "audit_user_prompt": "80143d8018fa7a0fa959c115ff7bf7da0d3363192db5202f2904b4626559ecc7",
    "audit_user_turn_marker": "9bf38992cb2cc1230edb6539a98e6d3c889c69aa09b1764a4b91b30cb6a36990",
}
# Digests that name a timestamp, and what the type of the first template is hashed from.
TIMESTAMPS = (
    "b6eadc83070402c73a6af82d56664ca890f2db6539530ea5ac12d5e2798dfdd6",
    "d16cba5ad81745c8d41c0423fb55437af60ecc4db491c943ea261f418ec0a530",
    "65fbe67e03cd437326c8491155b6fb2949eb528a249452eafff0cc6738d501a8",
)
GENESIS_SEED = b"aqua:genesis:template_meta"
# Signature suites and their templates; members that a typed payload must not leave empty; reasons to close a session.
SUITES = {"ethereum:eip-191": "signature_eip191", "ed25519": "signature_ed25519", "ecdsa:p256": "signature_p256", "webauthn:p256": "signature_webauthn"}
FILLED = {
    "audit_agent_response": ("signer_did", "turn_id"),
    "audit_agent_thinking": ("signer_did", "turn_id", "claude_round_id"),
    "audit_agent_tool_call": ("signer_did", "turn_id", "tool_name", "risk_level"),
    "audit_api_response": ("signer_did", "turn_id", "method", "endpoint", "attested_origin"),
    "audit_artifact": ("signer_did",),
    "audit_hitl_approval": ("signer_did", "turn_id", "prompt_shown"),
    "audit_round_anchor": ("signer_did", "session_id"),
    "audit_session_close": ("signer_did", "session_id"),
    "audit_tool_result": ("signer_did", "turn_id", "tool_name"),
    "audit_user_prompt": ("signer_did", "session_id", "turn_id"),
    "audit_user_turn_marker": ("signer_did", "session_id"),
}
REASONS = ("user_ended", "idle_timeout", "time_exhausted", "admin_stopped", "container_crashed")
# The leaves of each typed payload that stay readable in the pseudonymous view (* stands for digits); turn markers stay whole.
READABLE = {
    "audit_user_prompt": ("/payloads/signer_did", "/payloads/session_id", "/payloads/turn_id", "/payloads/created_at", "/payloads/attached_files/*/hash"),
    "audit_agent_thinking": ("/payloads/signer_did", "/payloads/turn_id", "/payloads/seq_in_turn", "/payloads/created_at", "/payloads/model_name"),
    "audit_agent_tool_call": ("/payloads/signer_did", "/payloads/turn_id", "/payloads/tool_name", "/payloads/risk_level", "/payloads/created_at"),
    "audit_api_response": (
        "/payloads/signer_did", "/payloads/turn_id", "/payloads/method", "/payloads/endpoint", "/payloads/status_code", "/payloads/attested_origin", "/payloads/created_at", "/payloads/request_hash",
    ),
    "audit_tool_result": ("/payloads/signer_did", "/payloads/turn_id", "/payloads/tool_name", "/payloads/success", "/payloads/created_at"),
    "audit_hitl_approval": ("/payloads/signer_did", "/payloads/turn_id", "/payloads/decision", "/payloads/created_at"),
    "audit_agent_response": ("/payloads/signer_did", "/payloads/turn_id", "/payloads/created_at", "/payloads/is_final", "/payloads/model_name"),
}

LINK = "^0x(16|1e)20[0-9a-f]{64}$"


def link_of_name(name: str) -> str:
    """The link (hex text) of a known template."""
    return "0x1620" + (FOUNDATION | TYPED)[name]


def catalogue(spark: SparkSession) -> DataFrame:
    """name, link (binary), typed of the known templates, by name."""
    rows = [(n, bytearray.fromhex("1620" + d), n in TYPED) for n, d in sorted((FOUNDATION | TYPED).items())]
    return spark.createDataFrame(rows, "name string, link binary, typed boolean")


def kind_named(revision_type: Column) -> Column:
    """What a revision type names: Template, Anchor, Signature, Timestamp, Object, or Unknown if it is no well-formed link."""
    import hashlib

    links = lambda names: ["0x1620" + FOUNDATION[n] for n in names]
    first = "0x1620" + hashlib.sha3_256(GENESIS_SEED).hexdigest()
    return (
        F.when(~F.coalesce(revision_type.rlike(LINK), F.lit(False)), "Unknown")
        .when(revision_type.isin([first, *links(["template_meta"])]), "Template")
        .when(revision_type.isin(links(["anchor_template"])), "Anchor")
        .when(revision_type.isin(links([n for n in FOUNDATION if n.startswith("signature_")])), "Signature")
        .when(revision_type.isin(["0x1620" + d for d in TIMESTAMPS]), "Timestamp")
        .otherwise("Object")
    )


def kind_sql(text: str) -> str:
    """kind_named() of an SQL expression, as SQL."""
    import hashlib

    first = hashlib.sha3_256(GENESIS_SEED).hexdigest()
    signs = [d for n, d in FOUNDATION.items() if n.startswith("signature_")]
    named = {"Template": [first, FOUNDATION["template_meta"]], "Anchor": [FOUNDATION["anchor_template"]], "Signature": signs, "Timestamp": list(TIMESTAMPS)}
    cases = " ".join(f"WHEN {text} IN ({', '.join(repr('0x1620' + d) for d in digests)}) THEN '{kind}'" for kind, digests in named.items())
    return f"CASE WHEN {text} IS NULL OR NOT {text} RLIKE '{LINK}' THEN 'Unknown' {cases} ELSE 'Object' END"


def is_branch(kind: Column) -> Column:
    """Whether revisions of a named kind fork off their chain."""
    return kind.isin("Signature", "Anchor", "Timestamp")


def type_of(kind: Column, revision_type: Column) -> Column:
    """The type that a revision counts as: templates and anchors have a fixed one whatever they store."""
    return F.when(kind == "template", link_of_name("template_meta")).when(kind == "anchor", link_of_name("anchor_template")).otherwise(revision_type)


def suite_template(signature_type: Column) -> Column:
    """The digest of the template of a signature suite, null for an unknown one."""
    found = F.lit(None).cast("binary")
    for suite, name in SUITES.items():
        found = F.when(signature_type == suite, F.unhex(F.lit(FOUNDATION[name]))).otherwise(found)
    return found


def is_identifier(did: Column) -> Column:
    """Whether a text is an identifier at all: "did:" and something or nothing after it."""
    return F.coalesce(did.startswith("did:"), F.lit(False))


def attached_hash(pointer: Column) -> Column:
    """Whether a pointer is the hash of an attached file."""
    return F.coalesce(pointer.rlike("^/payloads/attached_files/[0-9]+/hash$"), F.lit(False))


def lenient_hex(text: Column) -> Column:
    """The bytes of hex pairs of any case, 0x in front or not, else null."""
    bare = F.regexp_replace(text, "^0x", "")
    return F.when(bare.rlike("^([0-9a-fA-F]{2})*$"), F.unhex(bare))


def all_links(structural: Column, compositional: Column) -> Column:
    """An anchor's links of both kinds, structural ones first."""
    none = F.array().cast("array<binary>")
    return F.concat(F.coalesce(structural, none), F.coalesce(F.transform(compositional, lambda x: x["hash"]), none))


def payload_fault(name: Column, payloads: Column) -> Column:
    """The first rule that a typed payload (JSON text) breaks, null if none does: "empty NAME", "turn_id", "leaf_hashes", "merkle_root", "artifact_count", "reason", ...

    A member that is absent counts as empty. Names that are no typed payload have no rules.
    """
    get = lambda m: F.get_json_object(payloads, f"$.{m}")
    text = lambda m: F.coalesce(get(m), F.lit(""))
    link = lambda m: text(m).rlike(LINK)
    leaves = F.coalesce(F.size(F.from_json(get("leaf_hashes"), "array<string>")), F.lit(0))
    fault = F.lit(None).cast("string")
    more = {
        "audit_round_anchor": (
            (~link("turn_id"), "turn_id"),
            (leaves <= 0, "leaf_hashes"),
            (~text("merkle_root").startswith("0x") | (F.octet_length(text("merkle_root")) != 66), "merkle_root"),
            (~get("artifact_count").cast("long").eqNullSafe(leaves.cast("long")), "artifact_count"),
        ),
        "audit_session_close": (
            (~text("reason").isin(*REASONS), "reason"),
            (~((text("last_turn_id") == "") | link("last_turn_id")), "last_turn_id"),
            (~((text("last_round_anchor_hash") == "") | link("last_round_anchor_hash")), "last_round_anchor_hash"),
        ),
    }
    for kind, members in FILLED.items():
        first = F.lit(None).cast("string")
        rules = [(text(m) == "", f"empty {m}") for m in members] + list(more.get(kind, ()))
        for bad, code in reversed(rules):
            first = F.when(bad, code).otherwise(first)
        fault = F.when(name == kind, first).otherwise(fault)
    return fault


def order_faults(rows: DataFrame, keys: list[str], order: list[str], number: str) -> DataFrame:
    """keys, order, number, before of rows whose number is not larger than that of the row before them in their group.

    A group is ranked by a window, so it should be a turn or a session.
    """
    from pyspark.sql import Window

    before = F.lag(number).over(Window.partitionBy(*keys).orderBy(*order))
    return rows.select(*keys, *order, number, before.alias("before")).where(F.col(number) <= F.col("before"))


def named_type(text: Column) -> Column:
    """The digest that a revision type names, null if it is no well-formed link."""
    return F.when(text.rlike(LINK), F.substring(parse_hex(text), 3, 32))
