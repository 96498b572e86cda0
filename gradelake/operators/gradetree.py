"""Grading trees in columns, of any depth.

A tree is VARIANT or JSON text. VARIANT is walked by Spark's own expressions, some levels at a time: most trees end
within the first step and need no shuffle; deeper ones go on, a written table for each step, until no node is new. Text
that VARIANT can't hold or that Spark reads otherwise than the standard is walked by the parser, with the same result.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradelake.sources import jsontext
from gradelake.sources.jsontext import text_of, truthy
from gradelake.sources.staging import counted, written

#: Levels that are walked in one step.
STEP = 6


def nodes(trees: DataFrame, id_col: str = "id", tree_col: str = "tree", step: int = STEP) -> DataFrame:
    """(id, depth, number, node VARIANT, error, whole) of every object node, without its list of details.

    number counts a tree's nodes from the root, parents before children in order; by (depth, number) they are
    breadth first. error: the node or one below it has status error. A null tree has no nodes; malformed text is an
    error. A value inside a node may have any depth: where it has more than ``jsontext.LEVELS`` levels, node ends there
    with empty lists and maps, and whole is the node's JSON text; else whole is null. Numbers beyond double are infinite.
    """
    rows = trees.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{tree_col}`").alias("tree"))
    if trees.schema[tree_col].dataType.simpleString() != "string":
        return _walked(rows, step)
    read = rows.where("tree is not null").select("id", jsontext.strict_variant("tree").alias("v"), "tree").withColumn("tree", F.when(F.col("v").isNull(), F.col("tree")))
    first, seen = counted(read, "trees", odd=F.count_if(F.col("tree").isNotNull()))
    out, rest = _walked(first.where("tree is null").select("id", F.col("v").alias("tree")), step), first.where("tree is not null").select("id", "tree")
    return out.unionByName(_parsed(rest)) if seen["odd"] else out


def _bare(node: Column) -> Column:
    """A node without its list of details."""
    listed = F.try_variant_get(node, "$.details", "array<variant>").isNotNull()
    return F.when(listed, F.to_variant_object(F.map_filter(F.try_variant_get(node, "$", "map<string,variant>"), lambda k, _: k != "details"))).otherwise(node)


def _failed(node: Column) -> Column:
    return F.coalesce(F.try_variant_get(node, "$.status", "string") == "error", F.lit(False))


def _walked(rows: DataFrame, step: int) -> DataFrame:
    """nodes of VARIANT trees."""
    first = jsontext.with_levels(rows, "tree", step)
    ends = F.size("_below") == 0
    first, seen = counted(first.select("id", "_nodes", F.when(~ends, F.col("tree")).alias("tree")), "walked", deep=F.count_if(F.col("tree").isNotNull()))
    # Where all nodes of a tree are at hand, their places in the order of paths are its numbers.
    near = first.where("tree is null").withColumn("_order", F.array_sort(F.transform("_nodes", lambda s: s["path"]))).withColumn("_bad", F.transform(F.filter("_nodes", lambda s: _failed(s["node"])), lambda s: s["path"]))
    near = near.select("id", "_order", "_bad", F.explode("_nodes").alias("s")).select("id", "_order", "_bad", "s.*")
    error = F.exists("_bad", lambda p: F.slice(p, 1, F.size("path")) == F.col("path"))
    out = near.select("id", F.size("path").alias("depth"), (F.array_position("_order", F.col("path")) - 1).cast("int").alias("number"), _bare(F.col("node")).alias("node"), error.alias("error"))
    far = first.where("tree is not null").select("id", "tree")
    if seen["deep"]:
        out = out.union(_walked_on(far, step))
    return out.withColumn("whole", F.lit(None).cast("string"))


def _walked_on(rows: DataFrame, step: int) -> DataFrame:
    """nodes of trees that don't end within a step: each step's last level is what the next starts from."""
    # Numbered, since ids may repeat.
    begun = written(rows.select(F.monotonically_increasing_id().alias("t"), "id", "tree"), "deep-trees")
    now, found = begun.select("t", F.expr("cast(array() as array<int>)").alias("at"), "tree"), None
    while True:
        level = jsontext.with_levels(now, "tree", step)
        mark = lambda c, new: F.transform(c, lambda s: F.struct(s["path"].alias("path"), s["node"].alias("node"), F.lit(new).alias("new")))
        part = level.select("t", "at", F.explode(F.concat(mark("_nodes", False), mark("_below", True))).alias("s"))
        part, seen = counted(part.select("t", F.concat("at", "s.path").alias("path"), "s.node", "s.new"), "levels", new=F.count_if(F.col("new")))
        here = part.where("not new").select("t", "path", _bare(F.col("node")).alias("node"), _failed(F.col("node")).alias("bad"))
        found = here if found is None else found.union(here)
        now = part.where("new").select("t", F.col("path").alias("at"), F.col("node").alias("tree"))
        if not seen["new"]:
            break
    # A node is in error if a failed one's path begins with its own.
    above = found.where("bad").select("t", F.explode(F.transform(F.sequence(F.lit(0), F.size("path")), lambda n: F.slice("path", 1, n))).alias("path")).distinct().withColumn("error", F.lit(True))
    number = F.row_number().over(Window.partitionBy("t").orderBy("path")) - 1
    out = found.join(above, ["t", "path"], "left").withColumn("number", number).join(begun.select("t", "id"), "t")
    return out.select("id", F.size("path").alias("depth"), "number", "node", F.coalesce("error", F.lit(False)).alias("error"))


def _parsed(rows: DataFrame) -> DataFrame:
    """nodes of text trees, by the parser."""

    def each(batches):
        for batch in batches:
            at, depth, number, node, whole, error = [], [], [], [], [], []
            for i, x in enumerate(batch.column("tree")):
                found = jsontext.walk(jsontext.strict_json(x.as_py()))
                at += [i] * len(found)
                number += range(len(found))
                depth += [d for _, d, _ in found]
                held = [jsontext.held_json({k: v for k, v in n.items() if k != "details" or not isinstance(v, list)}) for n, _, _ in found]
                node += [h for h, _ in held]
                whole += [w for _, w in held]
                error += jsontext.errors(found)
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(at, pa.int64())), pa.array(depth, pa.int32()), pa.array(number, pa.int32()), pa.array(node, pa.string()), pa.array(error, pa.bool_()), pa.array(whole, pa.string())], names=["id", "depth", "number", "node", "error", "whole"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(each, f"id {kind}, depth int, number int, node string, error boolean, whole string").withColumn("node", F.parse_json("node"))


def criteria_of(node: Column) -> Column:
    """The list of a node's criteria as (name, passed), null if it has none; a name that is no text is null."""
    listed = F.try_variant_get(node, "$.metadata.criteria", "array<variant>")
    return F.transform(listed, lambda c: F.struct(text_of(c, "$.name").alias("name"), truthy(F.try_variant_get(c, "$.passed", "variant")).alias("passed")))


def first_criteria(walked: DataFrame) -> DataFrame:
    """(id, criteria): the list of the first node, breadth first, that has one; an empty list ends the search too."""
    found = walked.select("id", "depth", "number", criteria_of(F.col("node")).alias("criteria")).where("criteria is not null")
    return found.groupBy("id").agg(F.min_by("criteria", F.struct("depth", "number")).alias("criteria"))


def is_command(node: Column) -> Column:
    return F.coalesce(F.try_variant_get(node, "$.graderType", "string") == "run-command", F.lit(False))


def run_commands(walked: DataFrame) -> DataFrame:
    """(id, number, name, passed, error) of command nodes; error if the node or one below has status error."""
    get = lambda k, t="string": F.try_variant_get("node", f"$.{k}", t)
    return walked.where(is_command(F.col("node"))).select("id", "number", get("name").alias("name"), truthy(get("passed", "variant")).alias("passed"), "error")


def oracle_leaves(walked: DataFrame) -> DataFrame:
    """(id, number, category, name, passed, evidence): panel criteria by prefix of their criterion, and commands."""
    get = lambda k, t="string": F.try_variant_get("node", f"$.{k}", t)
    criterion = text_of(F.col("node"), "$.metadata.criterion")
    panel = F.when(get("name").startswith("panel/criterion/"), criterion)
    kind = F.when(panel.startswith("prompt/"), "prompt").when(panel.startswith("language/"), "language")
    base = walked.select("id", "number", F.coalesce(criterion, get("name")).alias("name"), truthy(get("passed", "variant")).alias("passed"), get("evidence").alias("evidence"), kind.alias("kind"), is_command(F.col("node")).alias("command"))
    both = F.array_compact(F.array(F.col("kind"), F.when(F.col("command"), "program")))
    return base.select("id", "number", F.explode(both).alias("category"), "name", "passed", "evidence")
