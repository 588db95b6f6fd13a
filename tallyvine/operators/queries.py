"""The registered queries over the driver's tables, each with the SQL that gives the same rows.

The tables hold no record trees, so both sides derive them alike: a conversation is a tree, a turn a revision whose link is
the SHA-256 of "conv_id/turn" in hex and whose parent is an earlier turn; users write objects, assistants signatures and
systems anchors. Nations and regions stand for templates that customers derive from, lineitems for structural links.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import canonical, hashing
from ..plans import changes, disclosure, outcome, templates, topology, verify
from ..session import small_batches

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


KIND = "CASE role WHEN 'user' THEN 'object' WHEN 'assistant' THEN 'signature' ELSE 'anchor' END"


def revisions(spark: SparkSession, sf_dir: str, parent: str = "turn - 1") -> DataFrame:
    """tree_id, link, prev, ts, kind, turn; parent: SQL for the turn of the parent, negative for none."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role").withColumn("up", F.expr(parent))
    return rows.select(
        F.col("conv_id").alias("tree_id"),
        F.expr("sha2(concat(conv_id, '/', turn), 256)").alias("link"),
        F.expr("CASE WHEN up >= 0 THEN sha2(concat(conv_id, '/', up), 256) END").alias("prev"),
        F.expr("CAST((turn * 7) % 5 AS BIGINT)").alias("ts"),
        F.expr(KIND).alias("kind"),
        "turn",
    )


def odd_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisions(spark, sf_dir, ODD).where(F.expr(KEPT.replace("conv_id", "tree_id")))


def rev_sql(parent: str = "turn - 1", kept: str = "true") -> str:
    return f"""rev AS (
  SELECT conv_id AS tree_id, sha256(conv_id || '/' || turn) AS link, CASE WHEN ({parent}) >= 0 THEN sha256(conv_id || '/' || ({parent})) END AS prev,
         CAST((turn * 7) % 5 AS BIGINT) AS ts, {KIND} AS kind, turn
  FROM conversations WHERE {kept}
)"""


#: Every third turn answers the one before the last, which makes forks.
FORK = "CASE WHEN turn % 3 = 2 THEN turn - 2 ELSE turn - 1 END"
#: In every fifth conversation the first turn names the third as its parent, which makes a cycle.
LOOP = "CASE WHEN conv_id % 5 = 0 AND turn = 0 THEN 2 ELSE turn - 1 END"
#: Forks; a second first revision in one tree of seven, none in another (its first turn names a turn that is not there), and
#: of every seventh tree the first turn alone (see KEPT).
ODD = "CASE WHEN conv_id % 7 = 3 AND turn = 2 THEN -1 WHEN conv_id % 7 = 4 AND turn = 0 THEN 1000000 WHEN turn % 3 = 2 THEN turn - 2 ELSE turn - 1 END"
KEPT = "(conv_id % 7 <> 5 OR turn = 0)"


@query(f"WITH {rev_sql()} SELECT tree_id, link, kind FROM rev WHERE prev IS NULL AND kind IN ('object', 'anchor')")
def genesis(spark, sf_dir):
    return topology.genesis(revisions(spark, sf_dir)).select("tree_id", "link", "kind")


@query(f"WITH {rev_sql(FORK)} SELECT tree_id, link, kind FROM rev r WHERE NOT EXISTS (SELECT 1 FROM rev c WHERE c.tree_id = r.tree_id AND c.prev = r.link)")
def tips(spark, sf_dir):
    return topology.tips(revisions(spark, sf_dir, FORK)).select("tree_id", "link", "kind")


@query(f"""WITH {rev_sql(ODD, KEPT)}, t AS (
  SELECT *, prev IS NULL AND kind IN ('object', 'anchor') AS starts, EXISTS (SELECT 1 FROM rev c WHERE c.tree_id = r.tree_id AND c.prev = r.link) AS named, count(*) OVER (PARTITION BY tree_id) AS n FROM rev r
), l AS (SELECT tree_id, link, row_number() OVER (PARTITION BY tree_id ORDER BY kind = 'template', link) AS place FROM t WHERE NOT named AND NOT starts)
SELECT tree_id, link FROM l WHERE place = 1 UNION ALL SELECT tree_id, link FROM t WHERE n = 1 AND starts""")
def last_revision(spark, sf_dir):
    return topology.last_revision(odd_revisions(spark, sf_dir))


@query(f"""WITH {rev_sql(FORK)} SELECT tree_id, min(link) AS link FROM rev r WHERE kind = 'object'
AND NOT EXISTS (SELECT 1 FROM rev c WHERE c.tree_id = r.tree_id AND c.prev = r.link) GROUP BY tree_id""")
def content_tip(spark, sf_dir):
    return topology.content_tip(revisions(spark, sf_dir, FORK))


@query(f"""WITH {rev_sql()}, kept AS (SELECT * FROM rev WHERE turn % 4 <> 1)
SELECT tree_id, link, prev FROM kept k WHERE prev IS NOT NULL AND NOT EXISTS (SELECT 1 FROM kept p WHERE p.tree_id = k.tree_id AND p.link = k.prev)""")
def missing_parents(spark, sf_dir):
    return topology.missing_parents(revisions(spark, sf_dir).where("turn % 4 <> 1")).select("tree_id", "link", "prev")


@query(f"WITH {rev_sql()} SELECT c.tree_id, c.link, c.ts, p.ts AS parent_ts FROM rev c JOIN rev p ON c.tree_id = p.tree_id AND c.prev = p.link WHERE c.ts < p.ts")
def timestamp_violations(spark, sf_dir):
    return topology.timestamp_violations(revisions(spark, sf_dir))


@query(f"""WITH RECURSIVE {rev_sql(LOOP)}, ok AS (
  SELECT tree_id, link FROM rev r WHERE prev IS NULL OR NOT EXISTS (SELECT 1 FROM rev p WHERE p.tree_id = r.tree_id AND p.link = r.prev)
  UNION ALL SELECT c.tree_id, c.link FROM rev c JOIN ok ON c.tree_id = ok.tree_id AND c.prev = ok.link
) SELECT tree_id, link FROM rev EXCEPT SELECT tree_id, link FROM ok""")
def cycle_nodes(spark, sf_dir):
    return topology.cycle_nodes(revisions(spark, sf_dir, LOOP))


CHAIN_SQL = f"""{rev_sql(ODD, KEPT)}, nxt AS (SELECT tree_id, prev, min(link) AS link FROM rev WHERE prev IS NOT NULL GROUP BY tree_id, prev),
walk AS (
  SELECT tree_id, min(link) AS link, CAST(0 AS BIGINT) AS pos FROM rev WHERE prev IS NULL AND kind IN ('object', 'anchor') GROUP BY tree_id
  UNION ALL SELECT n.tree_id, n.link, c.pos + 1 FROM walk c JOIN nxt n ON n.tree_id = c.tree_id AND n.prev = c.link
), chain AS (
  SELECT * FROM walk UNION ALL SELECT tree_id, link, CAST(row_number() OVER (PARTITION BY tree_id ORDER BY link) - 1 AS BIGINT) FROM rev
  WHERE tree_id NOT IN (SELECT tree_id FROM rev WHERE prev IS NULL AND kind IN ('object', 'anchor'))
)"""


@query(f"WITH RECURSIVE {CHAIN_SQL} SELECT tree_id, link, pos FROM chain")
def chain_walk(spark, sf_dir):
    return topology.chain(odd_revisions(spark, sf_dir))


@query(f"""WITH RECURSIVE {CHAIN_SQL}, kids AS (
  SELECT r.tree_id, r.prev, r.link FROM rev r LEFT JOIN chain c ON c.tree_id = r.tree_id AND c.link = r.link
  WHERE r.prev IS NOT NULL AND (c.link IS NULL OR r.kind IN ('signature', 'anchor'))
) SELECT c.tree_id, c.pos, c.link, coalesce((SELECT string_agg(k.link, ',' ORDER BY k.link) FROM kids k WHERE k.tree_id = c.tree_id AND k.prev = c.link), '') AS branches FROM chain c""")
def branches_per_position(spark, sf_dir):
    return topology.branches(odd_revisions(spark, sf_dir)).withColumn("branches", F.array_join("branches", ","))


@query(f"""WITH RECURSIVE {CHAIN_SQL}, p AS (
  SELECT r.tree_id, r.link, c.pos, u.pos AS parent_pos FROM rev r LEFT JOIN chain c ON c.tree_id = r.tree_id AND c.link = r.link
  LEFT JOIN chain u ON u.tree_id = r.tree_id AND u.link = r.prev
) SELECT tree_id, link, CASE WHEN pos IS NOT NULL THEN 'chain' WHEN parent_pos IS NOT NULL THEN 'branch' ELSE 'orphan' END AS edge_type,
  CAST(CASE WHEN pos IS NOT NULL THEN pos WHEN parent_pos IS NOT NULL THEN parent_pos + 1 ELSE 0 END AS BIGINT) AS depth,
  CAST(row_number() OVER (PARTITION BY tree_id ORDER BY coalesce(pos, parent_pos, 4611686018427387904), pos IS NULL, link) - 1 AS BIGINT) AS ord FROM p""")
def dag_order(spark, sf_dir):
    return topology.dag_order(odd_revisions(spark, sf_dir))


@query(f"WITH {rev_sql(FORK)} SELECT tree_id, prev AS link, count(*) AS n_children, min(link) AS first_child FROM rev WHERE prev IS NOT NULL GROUP BY tree_id, prev")
def children(spark, sf_dir):
    return topology.children(revisions(spark, sf_dir, FORK))


@query(f"WITH {rev_sql()} SELECT tree_id, prev AS link, link AS signature FROM rev WHERE kind = 'signature' AND prev IS NOT NULL")
def signatures_for(spark, sf_dir):
    return topology.signatures_for(revisions(spark, sf_dir))


@query("SELECT o_custkey AS tree_id, count(DISTINCT o_orderpriority) AS n_signers FROM orders WHERE o_orderstatus <> 'P' AND o_orderkey % 9 <> 0 GROUP BY o_custkey")
def distinct_signers(spark, sf_dir):
    """Orders as signatures by their priority: some are no signatures, some have an empty signer."""
    o = table(spark, sf_dir, "orders")
    kind = F.when(F.col("o_orderstatus") == "P", "object").otherwise("signature")
    signer = F.when(F.col("o_orderkey") % 9 == 0, "").otherwise(F.col("o_orderpriority"))
    return verify.signers(o.select(F.col("o_custkey").alias("tree_id"), kind.alias("kind"), signer.alias("signer")))


@query("""SELECT l_orderkey AS tree_id, l_linenumber AS link, l_partkey AS target FROM lineitem l
WHERE NOT EXISTS (SELECT 1 FROM part p WHERE p.p_partkey = l.l_partkey AND p.p_partkey % 10 <> 0) AND NOT EXISTS (SELECT 1 FROM supplier s WHERE s.s_suppkey = l.l_partkey) AND l_partkey % 50 <> 20""")
def dangling_links(spark, sf_dir):
    """Lines as anchors that refer to parts: some parts are unknown, some links are the zero link."""
    bytes_of = lambda c: F.encode(F.col(c).cast("string"), "UTF-8")
    target = F.when(F.col("l_partkey") % 50 == 20, F.lit(bytearray(verify.ZERO))).otherwise(bytes_of("l_partkey"))
    rev = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree_id"), F.col("l_linenumber").alias("link"), F.array(target).alias("structural_links"))
    none = F.lit(None).cast("bigint").alias("tree_id")
    known = table(spark, sf_dir, "part").where("p_partkey % 10 <> 0").select(none, bytes_of("p_partkey").alias("target"))
    known = known.unionByName(table(spark, sf_dir, "supplier").select(none, bytes_of("s_suppkey").alias("target")))
    return verify.dangling_links(rev, known).select("tree_id", "link", F.decode("target", "UTF-8").cast("bigint").alias("target"))


@query("""WITH d AS (SELECT DISTINCT c_custkey AS scope, c_nationkey AS digest FROM customer)
SELECT scope, digest, CASE WHEN scope % 3 = 0 THEN 0 WHEN n.n_nationkey % 2 = 0 THEN 1 WHEN r.r_regionkey IS NOT NULL THEN 2 ELSE -1 END AS source,
  CASE WHEN scope % 3 = 0 THEN 'own' WHEN n.n_nationkey % 2 = 0 THEN n.n_name ELSE coalesce(r.r_name, '') END AS template
FROM d LEFT JOIN nation n ON n.n_nationkey = digest LEFT JOIN region r ON r.r_regionkey = digest""")
def resolve_template_priority(spark, sf_dir):
    wanted = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("scope"), F.col("c_nationkey").alias("digest")).distinct()
    own = wanted.where("scope % 3 = 0").withColumn("template", F.lit("own"))
    none = F.lit(None).cast("bigint").alias("scope")
    builtin = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(none, F.col("n_nationkey").alias("digest"), F.col("n_name").alias("template"))
    linked = table(spark, sf_dir, "region").select(none, F.col("r_regionkey").alias("digest"), F.col("r_name").alias("template"))
    return templates.resolve(wanted, own, builtin, linked).na.fill(-1, ["source"]).na.fill("", ["template"])


TEMPLATES_SQL = """t AS (
  SELECT 'c' || c_custkey AS link, 'n' || c_nationkey AS derives_from FROM customer UNION ALL
  SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation UNION ALL SELECT 'r' || r_regionkey, NULL FROM region
)"""


def template_edges(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.expr("concat('c', c_custkey)").alias("link"), F.expr("concat('n', c_nationkey)").alias("derives_from"))
    n = table(spark, sf_dir, "nation").select(F.expr("concat('n', n_nationkey)").alias("link"), F.expr("concat('r', n_regionkey)").alias("derives_from"))
    r = table(spark, sf_dir, "region").select(F.expr("concat('r', r_regionkey)").alias("link"), F.lit(None).cast("string").alias("derives_from"))
    return c.unionByName(n).unionByName(r)


@query(f"""WITH RECURSIVE {TEMPLATES_SQL}, l AS (
  SELECT link, 0 AS depth, link AS ancestor, derives_from AS next FROM t UNION ALL
  SELECT l.link, l.depth + 1, t.link, t.derives_from FROM l JOIN t ON t.link = l.next
) SELECT link, depth, ancestor FROM l""")
def lineage(spark, sf_dir):
    return templates.lineage(template_edges(spark, sf_dir)).where("fault is null").select("link", "depth", "ancestor")


@query(f"""WITH RECURSIVE {TEMPLATES_SQL}, u AS (SELECT DISTINCT c_mktsegment AS scope, 'n' || c_nationkey AS digest FROM customer), c AS (
  SELECT * FROM u UNION SELECT c.scope, t.derives_from FROM c JOIN t ON t.link = c.digest WHERE t.derives_from IS NOT NULL
) SELECT scope, digest FROM c""")
def template_closure(spark, sf_dir):
    used = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("scope"), F.expr("concat('n', c_nationkey)").alias("digest")).distinct()
    return templates.closure(used, template_edges(spark, sf_dir))


@query(f"""WITH RECURSIVE {TEMPLATES_SQL}, u AS (SELECT DISTINCT c_mktsegment AS scope, 'n' || c_nationkey AS digest FROM customer), c AS (
  SELECT * FROM u UNION SELECT c.scope, t.derives_from FROM c JOIN t ON t.link = c.digest WHERE t.derives_from IS NOT NULL
) SELECT scope, digest FROM c EXCEPT SELECT scope, digest FROM u WHERE scope < 'C' EXCEPT SELECT c.scope, 'n' || n_nationkey FROM c, nation WHERE n_nationkey % 2 = 0""")
def missing_templates(spark, sf_dir):
    used = table(spark, sf_dir, "customer").select(F.col("c_mktsegment").alias("scope"), F.expr("concat('n', c_nationkey)").alias("digest")).distinct()
    builtin = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.lit(None).cast("string").alias("scope"), F.expr("concat('n', n_nationkey)").alias("digest"))
    return templates.missing(template_closure(spark, sf_dir), used.where("scope < 'C'"), builtin)


@query("""WITH RECURSIVE l0 AS (
  SELECT l_orderkey AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS i, sha256(l_orderkey || '/' || l_linenumber || '/' || l_partkey || '/' || l_suppkey) AS h FROM lineitem
), r AS (
  SELECT o, i, h, 0 AS lvl, count(*) OVER (PARTITION BY o) AS n FROM l0 UNION ALL
  SELECT a.o, a.i // 2, CASE WHEN b.h IS NULL THEN a.h ELSE sha256(unhex('01' || a.h || b.h)) END, a.lvl + 1, (a.n + 1) // 2
  FROM r a LEFT JOIN (SELECT * FROM r) b ON b.o = a.o AND b.lvl = a.lvl AND b.i = a.i + 1 WHERE a.n > 1 AND a.i % 2 = 0
) SELECT o AS tree_id, h AS root FROM r WHERE n = 1""")
def merkle_root_sha256(spark, sf_dir):
    return merkle_orders(spark, sf_dir).select("tree_id", F.lower(F.hex(hashing.merkle_root_sql(F.col("leaves")))).alias("root"))


def merkle_orders(spark, sf_dir):
    leaf = F.unhex(F.expr("sha2(concat(l_orderkey, '/', l_linenumber, '/', l_partkey, '/', l_suppkey), 256)"))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree_id"), F.struct("l_linenumber", "l_partkey", "l_suppkey", leaf.alias("leaf")).alias("x"))
    lists = rows.groupBy("tree_id").agg(F.array_sort(F.collect_list("x")).alias("all"))
    return lists.select("tree_id", F.transform("all", lambda x: x["leaf"]).alias("leaves"))


@query("""WITH f AS (SELECT l_orderkey AS tree_id, count(*) AS n, count(DISTINCT l_linenumber) AS d, min(l_linenumber) AS lo, max(l_linenumber) AS hi, max(l_orderkey % 7 + 1) AS declared FROM lineitem GROUP BY l_orderkey)
SELECT tree_id, CASE WHEN n <> declared THEN 'COUNT' ELSE 'INDEX' END AS fault FROM f WHERE n <> declared OR lo < 0 OR hi >= declared OR d < n""")
def index_bijectivity(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree_id"), "l_linenumber", (F.col("l_orderkey") % 7 + 1).alias("declared"))
    return disclosure.index_faults(rows, ["tree_id"], "l_linenumber", "declared")


CONDITIONS_SQL = """c AS (
  SELECT conv_id AS tree_id, CASE turn % 6 WHEN 1 THEN 'TEMPLATE_NOT_FOUND' WHEN 3 THEN 'TIMESTAMP_UNAVAILABLE' WHEN 5 THEN CASE WHEN conv_id % 2 = 0 THEN 'VERIFICATION_FAILED' ELSE 'ANCESTOR_TEMPLATE_NOT_FOUND' END END AS code,
         CASE turn % 6 WHEN 1 THEN 2.0 WHEN 3 THEN 3.0 ELSE 4.0 END AS stage
  FROM conversations WHERE turn % 6 IN (1, 3, 5) AND (conv_id + turn) % 4 <> 0
), g AS (SELECT c.* FROM c LEFT JOIN (SELECT tree_id, min(stage) AS stop FROM c WHERE stage <= 2 GROUP BY tree_id) s ON s.tree_id = c.tree_id WHERE stop IS NULL OR stage <= stop)"""


def conditions(spark, sf_dir, policy):
    rows = table(spark, sf_dir, "conversations").where("turn % 6 in (1, 3, 5) and (conv_id + turn) % 4 <> 0")
    code = F.expr("CASE turn % 6 WHEN 1 THEN 'TEMPLATE_NOT_FOUND' WHEN 3 THEN 'TIMESTAMP_UNAVAILABLE' WHEN 5 THEN CASE WHEN conv_id % 2 = 0 THEN 'VERIFICATION_FAILED' ELSE 'ANCESTOR_TEMPLATE_NOT_FOUND' END END")
    stage = F.expr("CAST(CASE turn % 6 WHEN 1 THEN 2.0 WHEN 3 THEN 3.0 ELSE 4.0 END AS DOUBLE)")
    return outcome.gate(rows.select(F.col("conv_id").alias("tree_id"), stage.alias("stage"), code.alias("code"), F.col("turn").alias("link")), policy)


def _outcome_sql(warns: str, found: str = "c") -> str:
    """found: g where the policy ends a tree at a missing template, c where it lets it go on."""
    return f"""SELECT t.tree_id, CAST(count(*) FILTER (WHERE code IS NOT NULL AND NOT ({warns})) AS BIGINT) AS n_errors, CAST(count(*) FILTER (WHERE code IS NOT NULL AND ({warns})) AS BIGINT) AS n_warnings,
  CASE WHEN count(*) FILTER (WHERE code IS NOT NULL AND NOT ({warns})) > 0 THEN 'failed' WHEN count(code) > 0 THEN 'verified_with_warnings' ELSE 'verified' END AS outcome
FROM (SELECT DISTINCT conv_id AS tree_id FROM conversations) t LEFT JOIN {found} ON {found}.tree_id = t.tree_id GROUP BY t.tree_id"""


@query(f"WITH {CONDITIONS_SQL} {_outcome_sql('code IN (%s)' % repr('TEMPLATE_NOT_FOUND') + ' OR code = ' + repr('TIMESTAMP_UNAVAILABLE'))}")
def outcome_by_tree(spark, sf_dir):
    """Outcome of every tree under the offline preset."""
    trees = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tree_id"))
    return outcome.outcomes(trees, conditions(spark, sf_dir, "offline"), "offline")


@query(f"""WITH {CONDITIONS_SQL}, o AS ({_outcome_sql('false', 'g')}), f AS ({_outcome_sql("code IN ('TEMPLATE_NOT_FOUND', 'TIMESTAMP_UNAVAILABLE')")}),
d AS ({_outcome_sql("code IN ('TEMPLATE_NOT_FOUND', 'TIMESTAMP_UNAVAILABLE', 'ANCESTOR_TEMPLATE_NOT_FOUND')")})
SELECT 'strict' AS policy, outcome, count(*) AS n_trees FROM o GROUP BY outcome UNION ALL SELECT 'offline', outcome, count(*) FROM f GROUP BY outcome UNION ALL SELECT 'debug', outcome, count(*) FROM d GROUP BY outcome""")
def policy_matrix(spark, sf_dir):
    trees = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tree_id"))
    rows = [outcome.outcomes(trees, conditions(spark, sf_dir, p), p).groupBy("outcome").agg(F.count("*").alias("n_trees")).withColumn("policy", F.lit(p)) for p in outcome.PRESETS]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).select("policy", "outcome", "n_trees")


EDGES_SQL = """e AS (
  SELECT DISTINCT 'c' || c_custkey AS tree, 'n' || c_nationkey AS needs FROM customer UNION SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation
  UNION SELECT 'c' || c_custkey, 'r' || (c_custkey % 5) FROM customer UNION SELECT 'r0', 'x1' UNION SELECT 'x1', 'x2' UNION SELECT 'x2', 'x1' UNION SELECT 'x2', 'x3' UNION SELECT 'r1', 'r1'
)"""


@query(f"""WITH RECURSIVE {EDGES_SQL}, up AS (
  SELECT tree AS top, needs FROM e WHERE tree <> needs AND tree[1] <> 'c' UNION SELECT up.top, e.needs FROM up JOIN e ON e.tree = up.needs AND e.tree <> e.needs
), bad AS (SELECT needs AS tree FROM up WHERE top IN (SELECT top FROM up WHERE top = needs) UNION SELECT top FROM up WHERE top = needs),
l AS (
  SELECT DISTINCT 'c' || c_custkey AS tree, 0 AS level FROM customer
  UNION ALL SELECT e.needs, l.level + 1 FROM l JOIN e ON e.tree = l.tree WHERE e.tree <> e.needs AND e.needs NOT IN (SELECT tree FROM bad)
)
SELECT tree, CAST(max(level) AS INTEGER) AS level, '' AS fault FROM l GROUP BY tree UNION ALL SELECT tree, -1, 'CROSS_TREE_CYCLE_DETECTED' FROM bad""")
def tree_levels(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    up = c.select(F.expr("concat('c', c_custkey)").alias("tree"), F.expr("concat('n', c_nationkey)").alias("needs"))
    n = table(spark, sf_dir, "nation").select(F.expr("concat('n', n_nationkey)").alias("tree"), F.expr("concat('r', n_regionkey)").alias("needs"))
    r = c.select(F.expr("concat('c', c_custkey)").alias("tree"), F.expr("concat('r', c_custkey % 5)").alias("needs"))
    loops = spark.createDataFrame([("r0", "x1"), ("x1", "x2"), ("x2", "x1"), ("x2", "x3"), ("r1", "r1")], "tree string, needs string")
    found = topology.tree_levels(up.unionByName(n).unionByName(r).unionByName(loops), up.select("tree"))
    return found.na.fill(-1, ["level"]).na.fill("", ["fault"])


@query("""WITH k AS (SELECT l_orderkey AS o, list_distinct(list(l_suppkey % 7)) AS child, list_distinct(list(l_partkey % 5)) AS parent FROM lineitem GROUP BY l_orderkey)
SELECT o AS tree_id, coalesce(list_aggregate(list_sort(list_filter(child, lambda x: NOT list_contains(parent, x))), 'string_agg', ','), '') AS widened FROM k""")
def narrowing_sets(spark, sf_dir):
    k = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("tree_id")).agg(F.collect_set(F.expr("l_suppkey % 7")).alias("child"), F.collect_set(F.expr("l_partkey % 5")).alias("parent"))
    return k.select("tree_id", F.array_join(templates.widened(F.col("child"), F.col("parent")).cast("array<string>"), ",").alias("widened"))


@query("SELECT page_id, CASE lower(regexp_extract(url, '[^.]*$')) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in changes.CONTENT_TYPES.items()) + " ELSE 'application/octet-stream' END AS content_type FROM pages")
def content_type_guess(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", changes.content_type(F.col("url")).alias("content_type"))


@query("""WITH n AS (SELECT conv_id AS tree_id, CASE role WHEN 'user' THEN 'objects' WHEN 'assistant' THEN 'signatures' ELSE 'anchors' END AS bound FROM conversations),
c AS (SELECT tree_id, bound, count(*) AS n FROM n GROUP BY tree_id, bound UNION ALL SELECT tree_id, 'revisions', count(*) FROM n GROUP BY tree_id)
SELECT * FROM c WHERE n > CASE bound WHEN 'signatures' THEN 2 WHEN 'revisions' THEN 5 WHEN 'anchors' THEN 0 ELSE 1000000 END""")
def bounds_lint(spark, sf_dir):
    return templates.over_bounds(revisions(spark, sf_dir), {"revisions": 5, "signatures": 2, "anchors": 0})


@query("SELECT l_orderkey AS tree_id, l_linenumber AS line, l_linenumber % 3 <> 0 AS ok, CASE l_linenumber % 3 WHEN 1 THEN sha256('' || l_partkey) WHEN 2 THEN sha256('' || l_partkey) END AS digest FROM lineitem")
def link_digests(spark, sf_dir):
    d = F.unhex(F.sha2(F.col("l_partkey").cast("string"), 256))
    n = F.col("l_linenumber") % 3
    link = F.when(n == 1, F.concat(F.unhex(F.lit("1620")), d)).when(n == 2, F.concat(F.unhex(F.lit("1E20")), d)).otherwise(F.concat(F.unhex(F.lit("1720")), d))
    rows = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("tree_id"), F.col("l_linenumber").alias("line"), link.alias("link"))
    return rows.select("tree_id", "line", hashing.link_ok(F.col("link")).alias("ok"), F.lower(F.hex(hashing.bare_digest(F.col("link")))).alias("digest"))


@query("SELECT conv_id AS tree_id, min(CASE role WHEN 'user' THEN 2 WHEN 'assistant' THEN 1 ELSE 0 END) AS strength FROM conversations GROUP BY conv_id")
def weakest_trust(spark, sf_dir):
    strength = {"user": 2, "assistant": 1, "system": 0}
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tree_id"), F.col("role").alias("trust"))
    got = outcome.weakest(rows, strength)
    return got.select("tree_id", F.expr("CASE trust WHEN 'user' THEN 2 WHEN 'assistant' THEN 1 ELSE 0 END").alias("strength"))


@query()
def sha3_links(spark, sf_dir):
    """SHA3-256 links of every document's text."""
    docs = table(spark, sf_dir, "documents")
    digest = hashing.digest_column(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), "sha3")
    return docs.select("doc_id", hashing.render_hex(F.concat(F.unhex(F.lit("1620")), digest)).alias("link"))


@query("""WITH p AS (SELECT event_id, CAST(props AS JSON) AS j FROM events), k AS (SELECT event_id, key, CAST(value AS VARCHAR) AS value FROM p, json_each(j))
SELECT event_id, CAST(0 AS BIGINT) AS idx, '' AS pointer, '{}' AS value, CAST(NULL AS VARCHAR) AS error FROM p
UNION ALL SELECT event_id, row_number() OVER (PARTITION BY event_id ORDER BY key), '/' || key, value, NULL FROM k""")
def event_pointers(spark, sf_dir):
    """The pointer map of every event's properties."""
    return canonical.flatten_rows(table(spark, sf_dir, "events"), "props", "event_id")


@query(f"""WITH {CONDITIONS_SQL}, j AS (
  SELECT tree_id, bool_or(code NOT IN ('TEMPLATE_NOT_FOUND', 'TIMESTAMP_UNAVAILABLE')) AS failed,
    string_agg('{{"code":"' || code || '","revision_hash":""}}', ',' ORDER BY stage, code) FILTER (WHERE code IN ('TEMPLATE_NOT_FOUND', 'TIMESTAMP_UNAVAILABLE')) AS warnings,
    string_agg('{{"code":"' || code || '","revision_hash":""}}', ',' ORDER BY stage, code) FILTER (WHERE code NOT IN ('TEMPLATE_NOT_FOUND', 'TIMESTAMP_UNAVAILABLE')) AS errors FROM c GROUP BY tree_id
) SELECT t.tree_id, CASE WHEN j.tree_id IS NULL THEN '{{"result":"verified"}}' WHEN failed THEN '{{"result":"failed","errors":[' || errors || ']}}'
  ELSE '{{"result":"verified_with_warnings","warnings":[' || warnings || ']}}' END AS json FROM (SELECT DISTINCT conv_id AS tree_id FROM conversations) t LEFT JOIN j ON j.tree_id = t.tree_id""")
def outcome_json(spark, sf_dir):
    """Outcomes with their errors or warnings as JSON texts."""
    trees, found = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("tree_id")), conditions(spark, sf_dir, "offline").withColumn("link", F.lit(None).cast("binary"))
    return outcome.as_json(outcome.outcomes(trees, found, "offline"), found, "offline")
