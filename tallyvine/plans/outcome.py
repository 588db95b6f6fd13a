"""From conditions to outcomes: stages that gate one another, named policies, one outcome a tree."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffled

# The decision points in order, and what each preset makes of them.
POINTS = ("timestamp_unavailable", "template_not_found", "ancestor_template_not_found", "wasm_execution_failed", "batch_proof_failed", "wasm_untrusted_signer", "unsigned_template")
PRESETS = {
    "strict": {
        "timestamp_unavailable": "F", "template_not_found": "F", "ancestor_template_not_found": "F", "wasm_execution_failed": "F",
        "batch_proof_failed": "F", "wasm_untrusted_signer": "F", "unsigned_template": "F",
    },
    "offline": {
        "timestamp_unavailable": "W", "template_not_found": "W", "ancestor_template_not_found": "F", "wasm_execution_failed": "W",
        "batch_proof_failed": "F", "wasm_untrusted_signer": "F", "unsigned_template": "F",
    },
    "debug": {
        "timestamp_unavailable": "W", "template_not_found": "W", "ancestor_template_not_found": "W", "wasm_execution_failed": "W",
        "batch_proof_failed": "W", "wasm_untrusted_signer": "W", "unsigned_template": "W",
    },
}
# The condition codes that a policy decides, with their points; all other codes always fail.
BATCH_CODES = (
    "MERKLE_ROOT_MISSING", "BATCH_TREE_SIZE_MISSING", "BATCH_LEAF_INDEX_MISSING", "MERKLE_PROOF_MISSING", "BATCH_TREE_SIZE_ZERO", "SHIELDING_NONCE_MISSING", "MERKLE_HEX_NOT_LOWERCASE",
    "MERKLE_HEX_DECODE_FAILED", "MERKLE_ROOT_MISMATCH", "MERKLE_LEAF_INDEX_OUT_OF_BOUNDS", "MERKLE_ROOT_BAD_MULTIHASH", "MERKLE_ROOT_BAD_CODEC", "MERKLE_INCLUSION_FAILED", "BATCH_PROOF_FAILED",
)
ROUTES = {
    "TIMESTAMP_UNAVAILABLE": "timestamp_unavailable",
    "TEMPLATE_NOT_FOUND": "template_not_found",
    "ANCESTOR_TEMPLATE_NOT_FOUND": "ancestor_template_not_found",
    "COMPUTE_UNSUPPORTED": "wasm_execution_failed",
    "TRUST_STORE_REQUIRED": "wasm_execution_failed",
    "WASM_UNTRUSTED_SIGNER": "wasm_untrusted_signer",
    "UNSIGNED_TEMPLATE": "unsigned_template",
} | dict.fromkeys(BATCH_CODES, "batch_proof_failed")


def severity(code: Column, policy: str, custom: dict[str, str] | None = None) -> Column:
    """"error" or "warning" of a condition code under a preset or custom {point: "F" or "W"} (points not named fail)."""
    own = custom if custom is not None else PRESETS[policy]
    warns = [c for c, p in ROUTES.items() if own.get(p, "F") == "W"]
    return F.when(code.isin(warns), "warning").otherwise("error") if warns else F.lit("error")


def gate(conditions: DataFrame, policy: str = "strict", custom: dict[str, str] | None = None) -> DataFrame:
    """conditions(tree_id, stage, code, link) that a tree verified stage by stage comes to.

    The first stage up to 2 that has an error under the policy ends a tree: later conditions go. From there on a revision is looked at by
    itself: its first condition of the stages after 2, which must have a link, stands alone, and a revision whose template may be missing under the policy has none.
    """
    marked = conditions.withColumn("severity", severity(F.col("code"), policy, custom))
    first = marked.where("stage <= 2 and severity = 'error'").groupBy("tree_id").agg(F.min("stage").alias("stop"))
    kept = marked.drop("severity").join(shuffled(first), "tree_id", "left").where(F.col("stop").isNull() | (F.col("stage") <= F.col("stop"))).drop("stop")
    own = kept.where("stage > 2 or code = 'TEMPLATE_NOT_FOUND'").groupBy("tree_id", "link").agg(F.min("stage").alias("first"))
    late = kept.where("stage > 2").join(shuffled(own), ["tree_id", "link"]).where("stage = first").drop("first")
    return kept.where("stage <= 2").unionByName(late)


def outcomes(trees: DataFrame, conditions: DataFrame, policy: str = "strict", custom: dict[str, str] | None = None) -> DataFrame:
    """tree_id, n_errors, n_warnings, outcome of every tree of trees(tree_id): failed by any error, else with warnings by any, else verified."""
    marked = conditions.withColumn("severity", severity(F.col("code"), policy, custom))
    sums = marked.groupBy("tree_id").agg(
        F.count(F.when(F.col("severity") == "error", 1)).alias("n_errors"), F.count(F.when(F.col("severity") == "warning", 1)).alias("n_warnings")
    )
    out = trees.select("tree_id").distinct().join(shuffled(sums), "tree_id", "left").na.fill(0, ["n_errors", "n_warnings"])
    name = F.when(F.col("n_errors") > 0, "failed").when(F.col("n_warnings") > 0, "verified_with_warnings").otherwise("verified")
    return out.select("tree_id", "n_errors", "n_warnings", name.alias("outcome"))


def weakest(trust: DataFrame, strength: dict[str, int]) -> DataFrame:
    """tree_id, trust: the weakest of each tree's trust values; unknown values are the weakest of all."""
    rank = F.coalesce(F.create_map(*[F.lit(x) for kv in strength.items() for x in kv])[F.col("trust")], F.lit(-1))
    return trust.groupBy("tree_id").agg(F.min_by("trust", F.struct(rank, F.col("trust"))).alias("trust"))


def concerns(custom: dict[str, str]) -> list[str]:
    """What is doubtful about a policy {point: "F" or "W"} (points not named fail); nothing is refused for it."""
    warns = {p for p in POINTS if custom.get(p, "F") == "W"}
    out = []
    if "wasm_untrusted_signer" in warns and "wasm_execution_failed" not in warns:
        out.append("conflicting_wasm_policy")
    if "wasm_untrusted_signer" in warns and not warns - {"wasm_untrusted_signer", "ancestor_template_not_found"}:
        out.append("untrusted_wasm_without_other_relaxation")
    if "unsigned_template" in warns and "wasm_untrusted_signer" not in warns:
        out.append("unsigned_weaker_than_untrusted")
    return out


def as_json(outcomes: DataFrame, conditions: DataFrame, policy: str = "strict", custom: dict[str, str] | None = None) -> DataFrame:
    """tree_id, json: each outcome with what decided it: the errors of a failed tree, the warnings of one verified with warnings.

    Conditions are listed by stage, code and link. A tree's conditions are gathered in one row, as the text needs them.
    """
    marked = conditions.withColumn("severity", severity(F.col("code"), policy, custom))
    link = F.coalesce(F.concat(F.lit("0x"), F.lower(F.hex("link"))), F.lit(""))
    one = F.struct("stage", F.col("code"), link.alias("revision_hash"))
    bare = lambda c: F.transform(F.array_sort(c), lambda x: F.struct(x["code"].alias("code"), x["revision_hash"].alias("revision_hash")))
    lists = marked.groupBy("tree_id").agg(
        bare(F.collect_list(F.when(F.col("severity") == "error", one))).alias("errors"), bare(F.collect_list(F.when(F.col("severity") == "warning", one))).alias("warnings")
    )
    rows = outcomes.select("tree_id", "outcome").join(lists, "tree_id", "left")
    errors, warnings = (F.when(F.col("outcome") == o, F.col(c)) for o, c in (("failed", "errors"), ("verified_with_warnings", "warnings")))
    return rows.select("tree_id", F.to_json(F.struct(F.col("outcome").alias("result"), warnings.alias("warnings"), errors.alias("errors"))).alias("json"))
