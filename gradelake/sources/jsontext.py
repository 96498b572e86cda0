"""JSON by the standard, of any depth, and grading trees in it.

Most text is parsed by Spark into VARIANT. What VARIANT refuses or reads otherwise than the standard (more than
1,000 levels, repeated keys, half surrogates, trailing text) goes to the parser here, row by row.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_BLANK = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(\.[0-9]+)?([eE][-+]?[0-9]+)?")
_LITERALS = {"true": True, "false": False, "null": None}
#: Levels of a value that are kept in VARIANT, which holds 1,000; a value with more is there in text as well.
LEVELS = 900


def _refuse(x: str):
    raise ValueError(f"{x} is not JSON")


def _integer(digits: str) -> int | float:
    """An integer, exact as long as a double can be as large; beyond, infinite like any such number."""
    return int(digits) if len(digits) < 300 else float(digits)


def strict_json(text: str):
    """JSON by the standard: no NaN, no trailing text; of equal keys the last counts. Values may be nested to any depth.

    A number too large for a double is infinite.
    """
    try:
        return json.loads(text, parse_constant=_refuse, parse_int=_integer)
    except RecursionError:
        return _deep(text)


def _deep(text: str):
    """The same without recursion: open containers wait on a list, with the key whose value comes next."""
    waiting, i = [], _BLANK.match(text).end()

    def key(i: int) -> tuple[str, int]:
        if text[i : i + 1] != '"':
            raise ValueError(f"Expecting a property name at {i}")
        name, i = scanstring(text, i + 1, True)
        i = _BLANK.match(text, i).end()
        if text[i : i + 1] != ":":
            raise ValueError(f"Expecting ':' at {i}")
        return name, _BLANK.match(text, i + 1).end()

    while True:
        c = text[i : i + 1]
        if c in ("{", "["):
            value, i = ({} if c == "{" else []), _BLANK.match(text, i + 1).end()
            if text[i : i + 1] != ("}" if c == "{" else "]"):
                name = None
                if c == "{":
                    name, i = key(i)
                waiting.append([value, name])
                continue
            i += 1
        elif c == '"':
            value, i = scanstring(text, i + 1, True)
        elif m := _NUMBER.match(text, i):
            value, i = (float if m[1] or m[2] else _integer)(m[0]), m.end()
        else:
            name = next((x for x in _LITERALS if text.startswith(x, i)), None)
            if name is None:
                raise ValueError(f"Expecting a value at {i}")
            value, i = _LITERALS[name], i + len(name)
        while True:  # the value is complete; so may be what holds it
            i = _BLANK.match(text, i).end()
            if not waiting:
                if i < len(text):
                    raise ValueError(f"Extra data at {i}")
                return value
            holder, name = waiting[-1]
            is_map = isinstance(holder, dict)
            if is_map:
                holder[name] = value
            else:
                holder.append(value)
            end = text[i : i + 1]
            if end == ",":
                i = _BLANK.match(text, i + 1).end()
                if is_map:
                    waiting[-1][1], i = key(i)
                break
            if end != ("}" if is_map else "]"):
                raise ValueError(f"Expecting ',' at {i}")
            value, i = holder, i + 1
            waiting.pop()


def printable(text: str | None) -> str | None:
    """The text with the replacement character for half surrogates, which UTF-8 can't hold."""
    if text is None:
        return None
    try:
        text.encode()
        return text
    except UnicodeEncodeError:
        return text.encode("utf-16", "surrogatepass").decode("utf-16", "replace")


def _number(x: float) -> str:
    return json.dumps(x) if abs(x) != float("inf") else "1e999" if x > 0 else "-1e999"


def _parts(value, most: int | None) -> Iterator[str]:
    """Pieces of a value's JSON text, without recursion; containers below ``most`` levels are empty."""
    waiting = [(False, value, 0)]  # (whether it is text already, what, its level), the next one last
    while waiting:
        ready, x, level = waiting.pop()
        if ready:
            yield x
        elif isinstance(x, (dict, list)):
            is_map = isinstance(x, dict)
            if not x or level == most:
                yield "{}" if is_map else "[]"
                continue
            yield "{" if is_map else "["
            inside = []
            for k in x:
                inside += [(True, ", ", 0), (True, json.dumps(k, ensure_ascii=False) + ": ", 0), (False, x[k], level + 1)] if is_map else [(True, ", ", 0), (False, k, level + 1)]
            waiting.append((True, "}" if is_map else "]", 0))
            waiting += reversed(inside[1:])
        else:
            yield _number(x) if isinstance(x, float) else json.dumps(x, ensure_ascii=False)


def written_json(value, most: int | None = None) -> str:
    """JSON text of any value. A number beyond double is written as 1e999; containers below ``most`` levels, if given, as empty."""
    try:
        text = json.dumps(value, ensure_ascii=False, allow_nan=False)
        if most is None or text.count("[") + text.count("{") <= most:
            return printable(text)
    except (RecursionError, ValueError):
        pass
    return printable("".join(_parts(value, most)))


def held_json(value) -> tuple[str, str | None]:
    """(text that VARIANT can hold, the whole text if that isn't the same)."""
    held, whole = written_json(value, LEVELS), written_json(value)
    return held, whole if len(whole) != len(held) else None


def strict_variant(text: str | Column) -> Column:
    """VARIANT of a text that Spark reads as the standard does; null for all other texts, which the parser decides on.

    Spark stops reading after the first value. So the text is the first of two values of a map, and the other has to be
    the hash of the text, which trailing text can't foretell.
    """
    text = F.col(text) if isinstance(text, str) else text
    mark = F.sha2(text, 256)
    both = F.try_parse_json(F.concat(F.lit('{"value":'), text, F.lit(',"mark":"'), mark, F.lit('"}')))
    whole = F.try_variant_get(both, "$.mark", "string") == mark
    return F.when(whole & ~text.rlike(r"\\u[dD][89abABcCdDeEfF]"), F.try_variant_get(both, "$.value", "variant"))


def truthy(value: Column) -> Column:
    """Whether a VARIANT counts as true: not null, false, zero or an empty text."""
    kind = F.schema_of_variant(value)
    number = F.try_variant_get(value, "$", "double")
    test = F.when(kind == "BOOLEAN", F.try_variant_get(value, "$", "boolean")).when(kind == "STRING", F.try_variant_get(value, "$", "string") != "").when(kind == "VOID", False)
    return F.coalesce(test.when(kind.like("OBJECT<%") | kind.like("ARRAY<%"), True).otherwise((number != 0) & ~F.isnan(number)), F.lit(False))


def is_true(value) -> bool:
    """The same of a parsed value."""
    return isinstance(value, (dict, list)) or bool(value)


def is_object(value: Column) -> Column:
    return F.try_variant_get(value, "$", "map<string,variant>").isNotNull()


def text_of(value: Column, path: str) -> Column:
    """The text at a path of a VARIANT; null if there is none or it is no text."""
    return F.when(F.schema_of_variant(F.try_variant_get(value, path, "variant")) == "STRING", F.try_variant_get(value, path, "string"))


def parsed(lines: DataFrame, text_col: str, error: str, number_col: str = "line") -> DataFrame:
    """lines with ``row`` VARIANT and ``whole`` in place of the text; whole is the text of a value that has over LEVELS levels, else null.

    A malformed text is an error, which names the line. Lines are written once; only those that Spark doesn't
    read as the standard does meet the parser.
    """
    from gradelake.sources.staging import counted

    keep = [c for c in lines.columns if c != text_col]
    read = lines.select(*keep, strict_variant(text_col).alias("row"), F.coalesce(text_col, F.lit("")).alias("_text")).withColumn("_text", F.when(F.col("row").isNull(), F.col("_text")))
    first, seen = counted(read, "parsed", odd=F.count_if(F.col("_text").isNotNull()))
    plain = first.where("_text is null").select(*keep, "row", F.lit(None).cast("string").alias("whole"))
    rest = first.where("_text is not null").drop("row")
    if not seen["odd"]:
        return plain
    schema = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in keep)

    def each(batches):
        for batch in batches:
            held, whole = [], []
            for n, text in zip(batch.column(number_col).to_pylist(), batch.column("_text").to_pylist()):
                try:
                    one = held_json(strict_json(text))
                except ValueError as e:
                    raise ValueError(f"{error} {n}: {e}") from None
                held.append(one[0])
                whole.append(one[1])
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(held, pa.string()), pa.array(whole, pa.string())], names=[*keep, "row", "whole"])

    return plain.union(rest.mapInArrow(each, f"{schema}, row string, whole string").withColumn("row", F.parse_json("row")))


def with_levels(df: DataFrame, tree: str, levels: int) -> DataFrame:
    """Add ``_nodes``, the object nodes of the VARIANT ``tree`` on its first levels, breadth first, and ``_below``, those of the level after.

    A node is (path, node), its path the places in the lists of details that lead to it; () is the root.
    """
    one = F.transform(F.filter(F.array(F.col(tree)), is_object), lambda x: F.struct(F.expr("cast(array() as array<int>)").alias("path"), x.alias("node")))
    out = df.withColumn("_l0", F.coalesce(one, F.expr("cast(array() as array<struct<path:array<int>,node:variant>>)")))
    for k in range(levels):
        details = lambda s: F.coalesce(F.try_variant_get(s["node"], "$.details", "array<variant>"), F.expr("cast(array() as array<variant>)"))
        below = F.flatten(F.transform(f"_l{k}", lambda s: F.transform(details(s), lambda c, i: F.struct(F.concat(s["path"], F.array(i)).alias("path"), c.alias("node")))))  # noqa: B023
        out = out.withColumn(f"_l{k + 1}", F.filter(below, lambda s: is_object(s["node"])))
    names = [f"_l{k}" for k in range(levels)]
    return out.withColumn("_nodes", F.concat(*names)).withColumn("_below", F.col(f"_l{levels}")).drop(*names, f"_l{levels}")


def walk(tree) -> list[tuple[dict, int, int]]:
    """(node, depth, number of the parent or -1) of each object of a grading tree, parents before children in order.

    Ordered by depth, and else as they come, nodes are breadth first.
    """
    out, open_ = [], [(tree, 0, -1)]
    while open_:
        node, depth, parent = open_.pop()
        if isinstance(node, dict):
            out.append((node, depth, parent))
            below = node.get("details")
            if isinstance(below, list):
                open_ += [(x, depth + 1, len(out) - 1) for x in reversed(below)]
    return out


def errors(nodes: list[tuple[dict, int, int]]) -> list[bool]:
    """Whether each node, or one below it, has status error: one pass from the leaves up."""
    out = [n.get("status") == "error" for n, _, _ in nodes]
    for k in range(len(nodes) - 1, -1, -1):
        parent = nodes[k][2]
        if parent >= 0:
            out[parent] = out[parent] or out[k]
    return out
