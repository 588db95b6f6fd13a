"""Derived templates: schemas as rows of constraints, child rows held against parent rows, and new templates of what narrows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import render_hex
from ..session import materialize
from . import catalogue, changes

#: Keywords that a child may only tighten, in the order in which they are looked at; the least numbers allow the most, or the largest do.
UPPER, LOWER = ("maxLength", "maximum", "exclusiveMaximum"), ("minLength", "minimum", "exclusiveMinimum")
ORDER = ("maxLength", "minLength", "maximum", "minimum", "exclusiveMaximum", "exclusiveMinimum", "enum", "const", "pattern")
#: How many ancestors a template may have.
MOST_ANCESTORS = 3
PARTS = "struct<required: array<string>, properties: map<string, variant>>"


def _values(text: Column) -> Column:
    """The members of a JSON array as JSON texts with sorted keys; none of what is no array."""
    return F.coalesce(F.transform(F.from_json(text, "array<variant>"), lambda x: F.to_json(x)), F.array().cast("array<string>"))


def constraints(schemas: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, field), (id, place, field), (id, field, word, arg, number) of schemas(id, schema as JSON text): properties, required ones, and the keywords of each property.

    arg is the keyword's argument as JSON text, number its value if it is a number. What is no object where one should be has no rows.
    """
    s = schemas.select("id", F.from_json("schema", PARTS).alias("s"))
    props = s.select("id", F.explode("s.properties").alias("field", "body"))
    required = s.select("id", F.posexplode("s.required").alias("place", "field")).where("field is not null")
    words = props.select("id", "field", F.explode(F.from_json(F.to_json("body"), "map<string, variant>")).alias("word", "v"))
    words = words.where(F.col("word").isin(*ORDER)).select("id", "field", "word", F.coalesce(F.to_json("v"), F.lit("null")).alias("arg"), F.try_variant_get("v", "$", "double").alias("number"), F.schema_of_variant("v").alias("kind"))
    numeric = F.col("kind").rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL.*)$")
    return props.select("id", "field"), required, words.select("id", "field", "word", "arg", F.when(numeric, F.col("number")).alias("number"))


def faults(pairs: DataFrame) -> DataFrame:
    """id, fault, field, word of pairs(id, parent, child as JSON texts) whose child is no narrowing of its parent: the first violation, a row a pair.

    In order: "new_property" (the lowest name), "removed_required" (a property that the parent requires and the child neither requires nor has, by the parent's order), then by
    property and in the order of ORDER "widened" or, where a bound is no number, "invalid_structure". A child may leave out a bound or a pattern
    if it has a const, and an enum if its const is in it; it must keep a const. ids are unique; texts that are no objects have no properties.
    """
    p = pairs.select("id", F.col("parent").alias("schema"))
    c = pairs.select("id", F.col("child").alias("schema"))
    (p_props, p_req, p_words), (c_props, c_req, c_words) = constraints(p), constraints(c)
    none = F.lit(None).cast("string")
    order = lambda a, b, c: F.struct(F.lit(a).alias("rule"), F.col(b).alias("by"), c.alias("at"))
    new = c_props.join(p_props, ["id", "field"], "left_anti").select("id", order(1, "field", F.lit(0)).alias("o"), F.lit("new_property").alias("fault"), "field", none.alias("word"))
    gone = p_req.join(c_req.select("id", "field").unionByName(c_props).distinct(), ["id", "field"], "left_anti")
    gone = gone.select("id", F.struct(F.lit(2).alias("rule"), F.lit("").alias("by"), F.col("place").alias("at")).alias("o"), F.lit("removed_required").alias("fault"), "field", none.alias("word"))
    own = c_words.select("id", "field", "word", F.col("arg").alias("c_arg"), F.col("number").alias("c_number"))
    const = c_words.where("word = 'const'").select("id", "field", F.col("arg").alias("c_const"))
    both = p_words.join(c_props, ["id", "field"], "left_semi").join(own, ["id", "field", "word"], "left").join(const, ["id", "field"], "left")
    has, fixed = F.col("c_arg").isNotNull(), F.col("c_const").isNotNull()
    looser = F.when(F.col("word").isin(*UPPER), F.col("c_number") > F.col("number")).otherwise(F.col("c_number") < F.col("number"))
    bound = F.when(~has, ~fixed).otherwise(F.coalesce(looser, F.lit(True)))
    allowed = _values(F.col("arg"))
    enum = F.when(has, F.size(F.array_except(_values(F.col("c_arg")), allowed)) > 0).otherwise(~fixed | ~F.array_contains(allowed, F.coalesce("c_const", F.lit(""))))
    bad = F.when(F.col("word") == "enum", enum).when(F.col("word") == "const", ~F.col("arg").eqNullSafe(F.col("c_const"))).when(F.col("word") == "pattern", ~has & ~fixed).otherwise(bound)
    broken = F.col("word").isin(*UPPER, *LOWER) & has & (F.col("number").isNull() | F.col("c_number").isNull())
    place = F.array_position(F.array(*map(F.lit, ORDER)), F.col("word")).cast("int")
    worse = both.where(bad | broken).select("id", order(3, "field", place).alias("o"), F.when(broken, "invalid_structure").otherwise("widened").alias("fault"), "field", "word")
    every = new.unionByName(gone).unionByName(worse)
    first = every.groupBy("id").agg(F.min_by(F.struct("fault", "field", "word"), "o").alias("x"))
    return first.select("id", "x.fault", "x.field", "x.word")


def derive(parents: DataFrame, children: DataFrame, now: int, seed: str, method: str = "scalar") -> tuple[DataFrame, DataFrame]:
    """(templates, rejects) of children(id, parent, schema as JSON text) of parents(link, raw): parent is a link of these.

    templates(id, link, raw, ancestry): templates of the child's schema that derive from the parent, whose ancestry is the parent's and the parent itself. rejects(id, fault, field, word):
    "unresolved" (no such parent), the first violation of faults(), "max_depth" (more than MOST_ANCESTORS ancestors), "no_schema" (it is no JSON). ids are unique.
    """
    up = parents.select(F.col("link").alias("parent"), F.get_json_object("raw", "$.schema").alias("p_schema"), F.from_json(F.get_json_object("raw", "$.ancestry"), "array<string>").alias("line")).dropDuplicates(["parent"])
    rows = materialize(children.select("id", "parent", "schema").join(up.withColumn("there", F.lit(True)), "parent", "left"), "derived")
    worse = faults(rows.where("there").select("id", F.col("p_schema").alias("parent"), F.col("schema").alias("child")))
    rows = rows.join(worse, "id", "left").withColumn("ancestry", F.concat(F.coalesce("line", F.array().cast("array<string>")), F.array(render_hex(F.col("parent")))))
    fault = F.when(F.col("there").isNull(), "unresolved").when(F.col("fault").isNotNull(), F.col("fault")).when(F.size("ancestry") > MOST_ANCESTORS, "max_depth").when(F.try_parse_json("schema").isNull(), "no_schema")
    rows = materialize(rows.withColumn("why", fault).select("id", "parent", "schema", "ancestry", "why", "field", "word"), "derived")
    good = rows.where("why is null")
    salt = changes.nonce(seed, F.col("id"), render_hex(F.col("parent")), F.col("schema"))
    head = F.to_json(F.struct(F.lit(catalogue.link_of_name("template_meta")).alias("revision_type"), salt.alias("nonce"), F.lit(now).alias("local_timestamp"), F.lit(changes.VERSION).alias("version"), F.lit(method).alias("method"),
                              render_hex(F.col("parent")).alias("derives_from"), F.col("ancestry")))
    raw = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"schema":'), F.col("schema"), F.lit("}"))
    made = changes.seal(good.select("id", "ancestry", raw.alias("raw")))
    rejects = rows.where("why is not null").select("id", F.col("why").alias("fault"), F.when(~F.col("why").isin("unresolved", "max_depth", "no_schema"), F.col("field")).alias("field"), F.when(~F.col("why").isin("unresolved", "max_depth", "no_schema"), F.col("word")).alias("word"))
    return made.select("id", "link", "raw", "ancestry"), rejects
