"""Entities, their members, and which types satisfy which interfaces."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Node types of types and of interfaces.
TYPES = ("struct", "struct_type", "class", "struct_item", "class_declaration", "class_definition")
INTERFACES = ("interface", "interface_type", "interface_declaration")


def nodes(records: DataFrame) -> DataFrame:
    """(id, name, node_type, path, docstring, members): entities with a name, each once; members as a map."""
    named = records.filter("name is not null and trim(name) <> ''")
    return named.select("id", "name", "node_type", "path", "docstring", F.from_json("structural_metadata", "map<string,string>").alias("members")).dropDuplicates(["id"])


def members(records: DataFrame) -> DataFrame:
    """(id, kind, member): one row for each method: and field: key."""
    keys = records.filter("name is not null and trim(name) <> ''").select("id", F.explode(F.map_keys(F.from_json("structural_metadata", "map<string,string>"))).alias("k"))
    return keys.filter(F.contains("k", F.lit(":"))).select("id", F.substring_index("k", ":", 1).alias("kind"), F.regexp_replace("k", "^[^:]*:", "").alias("member")).distinct()


def implements(records: DataFrame, types: tuple[str, ...] = TYPES, interfaces: tuple[str, ...] = INTERFACES) -> DataFrame:
    """(type_id, interface_id): types that have every method of an interface with at least one.

    Relational division. Every type with all methods of an interface has the one that fewest types have: only
    there the two meet, and the other methods are then looked up for the pairs that met. A method that very
    many share brings no pairs about, unless the interface has no rarer one.
    """
    kinds = records.select("id", "node_type").distinct()
    methods = members(records).filter("kind = 'method'").select("id", "member")
    of = lambda names, alias: methods.join(kinds.filter(F.col("node_type").isin(*names)).select("id"), "id", "left_semi").select(F.col("id").alias(alias), "member")
    t, i = of(types, "type_id"), of(interfaces, "interface_id")
    common = i.join(t.groupBy("member").agg(F.count(F.lit(1)).alias("types")), "member", "left")
    rarest = common.groupBy("interface_id").agg(F.count(F.lit(1)).alias("need"), F.min(F.struct(F.coalesce("types", F.lit(0)).alias("types"), "member")).alias("m"))
    met = rarest.filter("m.types > 0").select("interface_id", "need", F.col("m.member").alias("member")).join(t, "member").filter("type_id <> interface_id").select("type_id", "interface_id", "need")
    rest = met.filter("need > 1").join(i, "interface_id").join(t, ["type_id", "member"])
    all_of = rest.groupBy("type_id", "interface_id", "need").agg(F.count(F.lit(1)).alias("have")).filter("have = need")
    return met.filter("need = 1").select("type_id", "interface_id").unionByName(all_of.select("type_id", "interface_id"))
