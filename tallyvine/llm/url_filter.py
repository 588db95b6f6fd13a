"""URL filters (operator 12): rules by host and path, and for pages that no rule decides an empirical-Bayes reputation of their host."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Rules are a literal of the plan, looked through for every page; more than this many should be a table joined by host.
MOST_RULES = 1000
#: Suffixes of two labels under which names are registered. A documented parameter, not a complete list.
TWO_LABEL_SUFFIXES = ("ac.uk", "co.jp", "co.uk", "com.au", "com.br", "com.cn", "gov.uk", "org.uk")
#: Standard deviations that the bound lies below the posterior mean (one-sided 95 %), and the rate of bad pages that it must pass.
SURENESS, MOST_BAD = 1.645, 0.5
#: The correlation of outcomes within a unit is kept between these: a prior weighs two pages at least, so one page decides nothing, and 999 at most.
LEAST_RHO, MOST_RHO = 0.001, 1 / 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first "://" up to "/", "?", "#" or the end, A-Z lower-cased. Path: from there up to "?", "#" or the end.

    Both are empty for null and for texts without "://". Ports and user names stay part of the host.
    """
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return F.translate(F.regexp_extract(rest, "^[^/?#]*", 0), UPPER, LOWER), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> Column:
    """(rule, verdict) of the longest of rules (verdict, host, path) that fits, null if none does.

    A rule fits its host and all subdomains of it, if the path starts with the rule's; of two of one length the one with the longer host stands.
    """
    if len(rules) > MOST_RULES:
        raise ValueError(f"more than {MOST_RULES} rules")
    if not rules:
        return F.lit(None).cast("struct<rule: string, verdict: string>")
    table = F.array(*(F.struct(F.lit(len(h + p)).alias("n"), F.lit(len(h)).alias("m"), F.lit(h).alias("h"), F.lit(p).alias("p"), F.lit(v).alias("v")) for v, h, p in rules))
    fits = F.filter(table, lambda r: ((host == r["h"]) | host.endswith(F.concat(F.lit("."), r["h"]))) & path.startswith(r["p"]))
    best = F.array_max(fits)
    return F.when(best.isNotNull(), F.struct(F.concat(best["h"], best["p"]).alias("rule"), best["v"].alias("verdict")))


def registered(host: Column) -> tuple[Column, Column]:
    """(registered domain, suffix) of a host without user name, port and final dots; addresses of four numbers are their own domain and suffix."""
    bare = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), r"(:[0-9]*)?\.*$", "")
    label = lambda n: F.substring_index(bare, ".", -n)
    two = label(2).isin(*TWO_LABEL_SUFFIXES)
    address = bare.rlike(r"^[0-9]+(\.[0-9]+){3}$")
    domain = F.when(address, bare).when(two, label(3)).otherwise(label(2))
    return domain, F.when(address, bare).when(two, label(2)).otherwise(label(1))


def _rho(units: DataFrame) -> DataFrame:
    """One row: how alike the outcomes of a unit are, from units(n, bad, m) with m the rate expected of each.

    The moments of the beta-binomial give it: (bad - n m)^2 is n m (1 - m) (1 + (n - 1) rho) on average.
    """
    v = F.col("m") * (1 - F.col("m"))
    over = F.sum((F.col("bad") - F.col("n") * F.col("m")) ** 2 - F.col("n") * v)
    most = F.sum(F.col("n") * (F.col("n") - 1) * v)
    rho = F.when(most > 0, over / most)
    return units.agg(F.greatest(F.lit(LEAST_RHO), F.least(F.lit(MOST_RHO), F.coalesce(rho, F.lit(MOST_RHO)))).alias("rho"))


def reputation(hosts: DataFrame) -> DataFrame:
    """host, n, bad, mean, bound of hosts(host, n labelled pages, bad ones of them), a row a host; hosts without labelled pages too.

    The rate of bad pages is shrunk level by level: a suffix towards the rate of all pages, a registered domain towards its suffix, a host
    towards its domain. At each level the prior is a beta with the mean of the level above and k = 1 / rho - 1 pages of weight, rho estimated
    from that level's own units. bound lies SURENESS standard deviations of the host's posterior beta below its mean.
    Groups are summed before they are shuffled; what the driver's side of the plan holds is one number a level.
    """
    domain, suffix = registered(F.col("host"))
    hosts = materialize(hosts.select("host", "n", "bad", domain.alias("domain"), suffix.alias("suffix")), "hosts")  # read by every level
    sums = lambda rows, *keys: rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))
    domains = materialize(sums(hosts, "domain", "suffix"), "domains")
    suffixes = sums(domains, "suffix")
    every = suffixes.agg(((F.coalesce(F.sum("bad"), F.lit(0)) + 1) / (F.coalesce(F.sum("n"), F.lit(0)) + 2)).alias("m"))

    def shrunk(units: DataFrame) -> DataFrame:
        k = 1 / _rho(units).scalar() - 1
        a, b = F.col("m") * k + F.col("bad"), (1 - F.col("m")) * k + F.col("n") - F.col("bad")
        return units.withColumn("a", a).withColumn("b", b).withColumn("mean", F.col("a") / (F.col("a") + F.col("b")))

    suffixes = shrunk(suffixes.withColumn("m", every.scalar()))
    domains = shrunk(domains.join(suffixes.select("suffix", F.col("mean").alias("m")), "suffix"))
    found = shrunk(hosts.join(domains.select("domain", "suffix", F.col("mean").alias("m")), ["domain", "suffix"]))
    s = F.col("a") + F.col("b")
    return found.select("host", "n", "bad", "mean", (F.col("mean") - SURENESS * F.sqrt(F.col("a") * F.col("b") / (s * s * (s + 1)))).alias("bound"))


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], outcomes: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict, bound of every row of pages: the verdict of the rule that fits, else by its host's reputation.

    outcomes(url, bad 0 or 1) are labelled pages, of these hosts or others. A page that no rule decides is blocked if its host's posterior
    bound (see reputation) passes MOST_BAD, so that a host is blocked only if its bad pages leave little doubt. bound is null for pages that
    a rule decides. Null urls and those without a host share the empty host; outcomes with a null bad count for nothing, and without
    any the prior alone speaks, which blocks nothing. Repeated rows and null ids are judged each; an empty table gives no rows; other columns are ignored.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("fit", fitting_rule(F.col("host"), F.col("path"), rules))
    ruled = rows.where("fit is not null").select("page_id", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("verdict"), F.lit(None).cast("double").alias("bound"))
    rest = rows.where("fit is null").drop("fit")
    none = F.lit(0).cast("long")
    labelled = outcomes.where("bad is not null").select(host_and_path(F.col("url"))[0].alias("host"), F.lit(1).cast("long").alias("n"), F.col("bad").cast("long").alias("bad"))
    labelled = labelled.unionByName(rest.select("host", none.alias("n"), none.alias("bad")))
    known = reputation(labelled.groupBy("host").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad"))).select("host", "bound")
    verdict = F.when(F.col("bound") > MOST_BAD, "block").otherwise("allow")
    return ruled.unionByName(rest.join(known, "host", "left").select("page_id", "host", "path", F.lit(None).cast("string").alias("rule"), verdict.alias("verdict"), "bound"))


def judge_sql(rules: list[tuple[str, str, str]]) -> str:
    """The rows that judge() gives for pages with the labels of their ids, in SQL; bound is left out, as its last digits depend on the order of sums."""
    quoted = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    two = ", ".join(f"'{x}'" for x in TWO_LABEL_SUFFIXES)
    tail = lambda n: f"array_to_string(list_slice(string_split(bare, '.'), -{n}, -1), '.')"
    address = "regexp_matches(bare, '^[0-9]+([.][0-9]+){3}$')"
    level = lambda units: f"""(SELECT 1 / greatest({LEAST_RHO}, least({MOST_RHO}, coalesce(CASE WHEN sum(n * (n - 1) * m * (1 - m)) > 0
    THEN sum((bad - n * m) * (bad - n * m) - n * m * (1 - m)) / sum(n * (n - 1) * m * (1 - m)) END, {MOST_RHO}))) - 1 FROM {units})"""  # noqa: E731
    beta = lambda units: f"SELECT *, m * k + bad AS a, (1 - m) * k + n - bad AS b FROM (SELECT *, {level(units)} AS k FROM {units})"
    return f"""
WITH rules AS (SELECT * FROM (VALUES {quoted}) AS t(verdict, h, p)), cut AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages
), parts AS (
  SELECT row_number() OVER () AS r, page_id, translate(regexp_extract(rest, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), fits AS (
  SELECT r, arg_max(struct_pack(rule := h || p, verdict := verdict), length(h) * 1001 + length(p) * 1000) AS fit
  FROM parts, rules WHERE (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY r
), judged AS (SELECT parts.*, fit FROM parts LEFT JOIN fits USING (r)), counted AS (
  SELECT host, regexp_replace(regexp_replace(host, '^.*@', ''), '(:[0-9]*)?[.]*$', '') AS bare, count(quality) AS n, count(*) FILTER (WHERE quality = 0 OR toxic = 1) AS bad
  FROM parts LEFT JOIN labels ON page_id = doc_id GROUP BY host
), hosts AS (
  SELECT host, n, bad, CASE WHEN {address} THEN bare WHEN {tail(2)} IN ({two}) THEN {tail(3)} ELSE {tail(2)} END AS domain,
    CASE WHEN {address} THEN bare WHEN {tail(2)} IN ({two}) THEN {tail(2)} ELSE {tail(1)} END AS suffix FROM counted
), s0 AS (SELECT suffix, sum(n) AS n, sum(bad) AS bad, (SELECT (sum(bad) + 1.0) / (sum(n) + 2) FROM hosts) AS m FROM hosts GROUP BY suffix),
s1 AS ({beta('s0')}), d0 AS (
  SELECT domain, suffix, sum(h.n) AS n, sum(h.bad) AS bad, any_value(a / (a + b)) AS m FROM hosts h JOIN s1 USING (suffix) GROUP BY domain, suffix
), d1 AS ({beta('d0')}), h0 AS (SELECT h.*, a / (a + b) AS m FROM hosts h JOIN d1 USING (domain, suffix)), h1 AS ({beta('h0')}), known AS (
  SELECT host, a / (a + b) - {SURENESS} * sqrt(a * b / ((a + b) * (a + b) * (a + b + 1))) AS bound FROM h1
)
SELECT page_id, j.host, path, fit.rule AS rule, CASE WHEN fit IS NOT NULL THEN fit.verdict WHEN bound > {MOST_BAD} THEN 'block' ELSE 'allow' END AS verdict
FROM judged j LEFT JOIN known k ON j.host = k.host
"""
