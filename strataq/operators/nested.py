"""Deeply nested records as flat tables of content-identified objects.

Every object gets a Merkle identity: scalars are hashed, arrays and objects hash
the identities of their members in order, bottom-up, so equal subtrees have
equal identities wherever they occur. Three kinds of table come out:

* nodes   (node_id, kind, content): each distinct object once;
* bridges (parent_id, edge, ordinal, child_id, ref): the members of each distinct
  object, with their place in the source array, once per distinct parent;
* roots   (record_id, edge, ordinal, node_id): every occurrence in a record.

An occurrence deeper down is a walk from a root over bridges. Null members keep
their ordinal and give no row.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.materialize import Scratch

_NULL = "~"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once, also inside lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def identity(col: Column, dtype: T.DataType) -> Column:
    """Merkle identity of a value: hex SHA-256, built from its leaves upwards.
    Null has an identity of its own, different from empty."""
    if isinstance(dtype, T.ArrayType):
        members = F.transform(col, lambda x: identity(x, dtype.elementType))
        return F.coalesce(F.sha2(F.concat(F.lit("["), F.concat_ws(",", members)), 256), F.lit(_NULL))
    if isinstance(dtype, T.StructType):
        members = [F.concat(F.lit(f.name + ":"), identity(col.getField(f.name), f.dataType)) for f in sorted(dtype.fields, key=lambda f: f.name)]
        return F.when(col.isNull(), F.lit(_NULL)).otherwise(F.sha2(F.concat(F.lit("{"), F.concat_ws(",", *members)), 256))
    return F.coalesce(F.sha2(F.concat(F.lit("="), col.cast("string")), 256), F.lit(_NULL))


@dataclass(frozen=True)
class Edge:
    """Members of an object: the array field ``field``, whose elements are nodes
    of ``kind`` and have the edges ``below``. ``ref`` names an integer field of
    the element that is kept on the bridge."""

    field: str
    kind: str
    below: tuple[Edge, ...] = ()
    ref: str | None = None


@dataclass
class Forest:
    nodes: DataFrame
    bridges: DataFrame
    roots: DataFrame


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def flatten(df: DataFrame, record_id: str, edges: Sequence[Edge]) -> Forest:
    """Nodes, bridges and roots of the array columns that ``edges`` describe.
    A record id that repeats gives the roots of each of its rows. Occurrences of
    the outermost objects with their identities, and the distinct ones among them,
    are written once, as all walks start from them."""
    scratch = Scratch(df.sparkSession, "nested")
    roots, bridges, nodes = [], [], []

    def element(e: Edge, parent: T.StructType) -> T.DataType:
        return parent[e.field].dataType.elementType

    def descend(objects: DataFrame, e: Edge, dtype: T.DataType, top: bool = False) -> None:
        """objects: (node_id, value) of the occurrences of one kind."""
        unique = objects.groupBy("node_id").agg(F.first("value").alias("value"))
        unique = scratch.put(unique) if top and e.below else unique
        content = F.to_json("value") if isinstance(dtype, T.StructType) else F.col("value").cast("string")
        nodes.append(unique.select("node_id", F.lit(e.kind).alias("kind"), content.alias("content")))
        for b in e.below:
            inner = element(b, dtype)
            members = unique.select(F.col("node_id").alias("parent_id"), F.posexplode(F.col(f"value.{b.field}")).alias("ordinal", "value")).where("value is not null")
            ref = F.col(f"value.{b.ref}") if b.ref else F.lit(None)
            members = members.select("parent_id", F.lit(b.kind).alias("edge"), F.col("ordinal").cast("bigint").alias("ordinal"), identity(F.col("value"), inner).alias("child_id"), ref.cast("bigint").alias("ref"), "value")
            bridges.append(members.drop("value"))
            descend(members.select(F.col("child_id").alias("node_id"), "value"), b, inner)

    for e in edges:
        dtype = element(e, df.schema)
        found = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.posexplode(e.field).alias("ordinal", "value")).where("value is not null")
        found = found.select("record_id", F.lit(e.kind).alias("edge"), F.col("ordinal").cast("bigint").alias("ordinal"), identity(F.col("value"), dtype).alias("node_id"), "value")
        found = scratch.put(found)
        roots.append(found.drop("value"))
        descend(found.select("node_id", "value"), e, dtype, top=True)
    empty = df.sparkSession.createDataFrame([], "parent_id string, edge string, ordinal bigint, child_id string, ref bigint")
    return Forest(_union(nodes), _union(bridges) if bridges else empty, _union(roots))


def walk(forest: Forest, *kinds: str) -> DataFrame:
    """Occurrences of the last kind, reached from records over the given kinds:
    (record_id, pos1, .. posN, ref, node_id)."""
    out = forest.roots.where(F.col("edge") == kinds[0]).select("record_id", F.col("ordinal").alias("pos1"), F.lit(None).cast("bigint").alias("ref"), "node_id")
    for n, kind in enumerate(kinds[1:], 2):
        step = forest.bridges.where(F.col("edge") == kind).select("parent_id", F.col("ordinal").alias(f"pos{n}"), F.col("ref").alias("_ref"), "child_id")
        kept = [c for c in out.columns if c.startswith("pos")]
        out = out.join(step, F.col("node_id") == F.col("parent_id")).select("record_id", *kept, f"pos{n}", F.col("_ref").alias("ref"), F.col("child_id").alias("node_id"))
    return out


# ---- the project's nested records ----

USAGE_EDGES = (Edge("crypto", "usage", (Edge("call_path", "call_step"), Edge("traces", "trace", (Edge("call_steps", "step"),)))),)
SARIF_EDGES = (Edge("runs", "run", (Edge("rules", "rule"), Edge("results", "result", (Edge("locations", "location"),), ref="rule_place"))),)
CBOM_EDGES = (Edge("components", "component", (Edge("functions", "function"),)),)


#: more layers of JSON strings than a text of 2 GB can hold
LAYERS = 30


def readable(payload: Column) -> Column:
    """The JSON object that a payload holds, as a variant; a byte order mark or
    blanks before it and all layers of JSON strings around it are taken off.
    Null where the payload isn't one whole JSON object."""
    bare = lambda s: F.regexp_replace(s, "^[﻿\\s]+|(?<!\\s)\\s+$", "")
    # within brackets anything after the first value makes the text unreadable or a list of two
    alone = lambda a: F.when(F.try_variant_get(a, "$[1]", "variant").isNull(), F.try_variant_get(a, "$[0]", "variant"))
    whole = lambda s: F.when(s.rlike(r'^[{"]'), _let(F.try_parse_json(F.concat(F.lit("["), s, F.lit("]"))), alone))
    # each layer stays as it is once no quotation mark opens the text; escapes double
    # with every layer, so k of them take 2 ** (k + 1) characters and LAYERS are never full
    unwrap = lambda s: F.when(s.startswith('"'), bare(F.try_variant_get(whole(s), "$", "string"))).otherwise(s)
    text = _let(bare(payload), lambda s: F.when(s.startswith('"'), F.reduce(F.sequence(F.lit(1), F.lit(LAYERS)), s, lambda t, _: unwrap(t))).otherwise(s))
    v = _let(text, whole)
    return _let(v, lambda x: F.when(F.schema_of_variant(x).startswith("OBJECT"), x))


def members(v: Column, path: str) -> Column:
    """array<variant> at a path: a list as it is, a single value as a list of
    one, null or nothing as null. Elements that are JSON null become null."""
    listed = F.try_variant_get(v, path, "array<variant>")
    single = F.try_variant_get(v, path, "variant")
    one = F.when(single.isNotNull() & ~F.is_variant_null(single), F.array(single))
    return F.transform(F.coalesce(listed, one), lambda x: F.when(~F.is_variant_null(x), x))


def report_shapes(reports: DataFrame) -> DataFrame:
    """report_id with ``runs`` and ``components`` as typed arrays; ``body`` is the
    element's JSON with its keys in order, so that key order makes no difference."""
    v = F.col("_doc")
    text = lambda x, path: F.try_variant_get(x, path, "string")
    body = lambda x: F.to_json(x)
    # the fields of an object but for those that become nodes of their own
    rest = lambda x, path, *own: F.to_json(F.map_filter(F.try_variant_get(x, path, "map<string,variant>"), lambda k, _: ~k.isin(*own)))

    def rule(x: Column) -> Column:
        return F.when(x.isNotNull(), F.struct(text(x, "$.id").alias("rule_id"), body(x).alias("body")))

    def result(x: Column, rules: Column) -> Column:
        own = text(x, "$.ruleId")
        ids = F.transform(rules, lambda r: F.coalesce(text(r, "$.id"), F.lit("￾")))
        place = F.coalesce(F.array_position(ids, own) - 1, F.lit(-1).cast("bigint"))
        locations = F.transform(members(x, "$.locations"), lambda y: F.when(y.isNotNull(), F.struct(body(y).alias("body"))))
        return F.when(x.isNotNull(), F.struct(own.alias("rule_id"), place.alias("rule_place"), rest(x, "$", "locations").alias("body"), locations.alias("locations")))

    def run(x: Column) -> Column:
        # what a run says besides its rules and results, at each level that holds them
        levels = F.array_compact(F.array(rest(x, "$", "results", "tool"), rest(x, "$.tool", "driver"), rest(x, "$.tool.driver", "rules")))
        return F.when(
            x.isNotNull(),
            _let(
                members(x, "$.tool.driver.rules"),
                lambda rules: F.struct(F.transform(rules, rule).alias("rules"), F.transform(members(x, "$.results"), lambda r: result(r, rules)).alias("results"), levels.alias("body")),
            ),
        )

    def component(x: Column) -> Column:
        functions = F.transform(members(x, "$.cryptoProperties.algorithmProperties.cryptoFunctions"), body)
        return F.when(x.isNotNull(), F.struct(body(x).alias("body"), functions.alias("functions")))

    read = reports.select("report_id", readable(F.col("payload")).alias("_doc")).where("_doc is not null")
    return read.select("report_id", F.transform(members(v, "$.runs"), run).alias("runs"), F.transform(members(v, "$.components"), component).alias("components"))


def usage_forest(analyses: DataFrame) -> Forest:
    return flatten(analyses.select("analysis_id", "crypto"), "analysis_id", USAGE_EDGES)


def report_forest(reports: DataFrame) -> Forest:
    """Each payload is parsed once; both formats' edges read the written shapes."""
    shapes = Scratch(reports.sparkSession, "shapes").put(report_shapes(reports))
    return flatten(shapes, "report_id", SARIF_EDGES + CBOM_EDGES)


def flat_positions(analyses: DataFrame, reports: DataFrame) -> DataFrame:
    """(kind, record_id, pos1, pos2, pos3) of usages, steps, rules, results,
    locations and functions. Positions count from 0; unused ones are -1."""
    usages, documents = usage_forest(analyses), report_forest(reports)
    none = F.lit(-1).cast("bigint")

    def rows(kind: str, found: DataFrame, third: Column | None = None) -> DataFrame:
        pos = [F.col(f"pos{n}") if f"pos{n}" in found.columns else none for n in (1, 2, 3)]
        if third is not None:
            pos[2] = third
        return found.select(F.lit(kind).alias("kind"), "record_id", *[p.alias(f"pos{n}") for n, p in enumerate(pos, 1)])

    return _union(
        [
            rows("usage", walk(usages, "usage")),
            rows("call_step", walk(usages, "usage", "call_step")),
            rows("trace_step", walk(usages, "usage", "trace", "step")),
            rows("sarif_rule", walk(documents, "run", "rule")),
            rows("sarif_result", walk(documents, "run", "result"), F.col("ref")),
            rows("sarif_location", walk(documents, "run", "result", "location")),
            rows("cbom_function", walk(documents, "component", "function")),
        ]
    )
