"""Readers of JSON lines, manifests and YAML-like catalogs as DataFrames.

Files of lines are read in splits and keep their line numbers, so parsing and checking are distributed.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gradelake.functions.scalars import first_group, normalize_path, unquote
from gradelake.sources.jsontext import errors, is_object, is_true, parsed, printable, strict_json, strict_variant, text_of, truthy, walk, with_levels, written_json
from gradelake.sources.staging import counted, written

_TRIAL = (
    "message string, eval_name string, variant string, status string, service string, "
    "criteria array<struct<name:string,passed:boolean>>, programs array<struct<name:string,passed:boolean,error:boolean>>"
)


def found_files(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path, value): the files of exactly this name at any depth, whole. For small files such as catalogs."""
    return _under(spark, name).text(root, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def found_paths(spark: SparkSession, root: str, name: str) -> DataFrame:
    """(path) of the files of exactly this name at any depth; none is opened."""
    return _under(spark, name).format("binaryFile").load(root).select(F.col("_metadata.file_path").alias("path"))


def _under(spark: SparkSession, name: str):
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", name)


#: What counts as blank in a line, the white space and line ends of the language that wrote the files.
BLANK = "\t\n\x0b\x0c\r \xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000\ufeff"
#: Splits of files whose counts are sent to all executors at most; beyond, lines are shuffled to them.
MOST_SPLITS = 200_000


def numbered_lines(spark: SparkSession, root: str, name: str = "*", physical: bool = False) -> DataFrame:
    """(path, line, text) of the lines that aren't blank, of files of any size; numbers count all lines if physical, else only those.

    Files are read in splits. A split's lines stand together in one task in their order, so their numbers in that
    task, less the first, are places in the split; the lines of the splits before it in the same file, which are
    counted first and written, then shift them. No task sees a whole file, and lines aren't shuffled.
    """
    raw = _under(spark, name).text(root, lineSep="\n").select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value")
    filled = F.col("value").rlike(f"[^{BLANK}]")
    lines = (raw if physical else raw.where(filled)).withColumn("k", F.monotonically_increasing_id())
    sizes, seen = counted(lines.groupBy("path", "at").agg(F.count(F.lit(1)).alias("n"), F.min("k").alias("first")), "splits", splits=F.count(F.lit(1)))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("path").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shift = sizes.select("path", "at", (before - F.col("first") + 1).alias("shift"))
    if seen["splits"] <= MOST_SPLITS:
        shift = F.broadcast(shift)
    text = F.when(F.col("value").endswith("\r"), F.expr("substring(value, 1, length(value) - 1)")).otherwise(F.col("value"))
    return lines.where(filled).join(shift, ["path", "at"]).select("path", (F.col("shift") + F.col("k")).alias("line"), text.alias("text"))


def manifests(spark: SparkSession, root: str, name: str = "evaluation-shard.json") -> DataFrame:
    """(path, dir, language, variant, expected) of each shard manifest; a malformed one is an error."""
    kind = "language string, variant string, expectedEvaluations bigint"
    raw = spark.read.schema(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", name).json(root, multiLine=True, mode="FAILFAST")
    path = F.col("_metadata.file_path")
    return raw.select(path.alias("path"), F.regexp_replace(path, "/[^/]*$", "").alias("dir"), "language", "variant", F.col("expectedEvaluations").alias("expected"))


def _text(row: dict, key: str) -> str:
    """A field as it reads in a message: undefined if absent, and JSON-like otherwise."""
    if key not in row:
        return "undefined"
    v = row[key]
    return printable(v) if isinstance(v, str) else written_json(v)


def _criteria(nodes: list[tuple[dict, int, int]]) -> list[dict]:
    """Those of the first node, breadth first, that has a list of them, even an empty one."""
    first = None
    for node, depth, _ in nodes:
        found = node["metadata"].get("criteria") if isinstance(node.get("metadata"), dict) else None
        if isinstance(found, list) and (first is None or depth < first[0]):
            first = depth, found
    name = lambda c: printable(c["name"]) if isinstance(c, dict) and isinstance(c.get("name"), str) else None
    return [{"name": name(c), "passed": isinstance(c, dict) and is_true(c.get("passed"))} for c in (first[1] if first else ())]


def _programs(nodes: list[tuple[dict, int, int]]) -> list[dict]:
    """Command nodes, breadth first."""
    bad = errors(nodes)
    found = sorted((depth, k) for k, (node, depth, _) in enumerate(nodes) if node.get("graderType") == "run-command")
    return [{"name": _text(nodes[k][0], "name"), "passed": is_true(nodes[k][0].get("passed")), "error": bad[k]} for _, k in found]


def parsed_trial(text: str) -> dict:
    """A line of trial results; message is null unless it is malformed."""
    try:
        row = strict_json(text)
        if not isinstance(row, dict):
            raise ValueError("a result must be an object")
    except ValueError as e:
        return {"message": printable(str(e)) or "malformed"}
    nodes = walk(row.get("gradeResult"))
    service = row.get("service")
    return {"message": None, "eval_name": _text(row, "evalName"), "variant": _text(row, "variant"), "status": _text(row, "status"), "service": printable(service) if isinstance(service, str) and service else None, "criteria": _criteria(nodes), "programs": _programs(nodes)}


#: Levels of grading trees that trials are read to by Spark; trees with more go to the parser.
LEVELS = 8


def _read_trial(lines: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """keep, the fields of parsed_trial, and ``_text``, the line where Spark's own expressions don't give them: then they are null.

    Those are lines that VARIANT doesn't take as the standard does, with trees of more levels, or without one of the usual texts.
    """
    rows = lines.select(*keep, F.coalesce(text_col, F.lit("")).alias("_text"), strict_variant(F.coalesce(text_col, F.lit(""))).alias("_row"))
    rows = with_levels(rows.withColumn("_tree", F.try_variant_get("_row", "$.gradeResult", "variant")), "_tree", LEVELS)
    get = lambda x, k: F.try_variant_get(x, f"$.{k}", "variant")
    texts = {k: text_of(F.col("_row"), f"$.{f}") for k, f in (("eval_name", "evalName"), ("variant", "variant"), ("status", "status"))}
    service = text_of(F.col("_row"), "$.service")
    listed = F.filter("_nodes", lambda s: F.try_variant_get(s["node"], "$.metadata.criteria", "array<variant>").isNotNull())
    first = F.try_variant_get(F.try_element_at(listed, F.lit(1))["node"], "$.metadata.criteria", "array<variant>")
    criteria = F.transform(first, lambda c: F.struct(text_of(c, "$.name").alias("name"), truthy(get(c, "passed")).alias("passed")))
    failed = lambda n: F.coalesce(F.try_variant_get(n, "$.status", "string") == "error", F.lit(False))
    bad = F.transform(F.filter("_nodes", lambda s: failed(s["node"])), lambda s: s["path"])
    commands = F.filter("_nodes", lambda s: F.coalesce(F.try_variant_get(s["node"], "$.graderType", "string") == "run-command", F.lit(False)))
    rows = rows.withColumn("_bad", bad).withColumn("_commands", commands)
    inside = lambda s: F.exists("_bad", lambda p: F.slice(p, 1, F.size(s["path"])) == s["path"])
    programs = F.transform("_commands", lambda s: F.struct(text_of(s["node"], "$.name").alias("name"), truthy(get(s["node"], "passed")).alias("passed"), inside(s).alias("error")))
    rows = rows.select(*keep, "_text", "_row", "_below", *(v.alias(k) for k, v in texts.items()), F.when(service != "", service).alias("service"), criteria.alias("criteria"), programs.alias("programs"))
    plain = is_object(F.col("_row")) & F.col("eval_name").isNotNull() & F.col("variant").isNotNull() & F.col("status").isNotNull() & (F.size("_below") == 0) & ~F.exists("programs", lambda p: p["name"].isNull())
    rows = rows.withColumn("_plain", F.coalesce(plain, F.lit(False)))
    none = lambda kind: F.expr(f"cast(array() as {kind})")
    fields = {k: F.col(k) for k in (*texts, "service")}
    fields |= {"criteria": F.coalesce("criteria", none("array<struct<name:string,passed:boolean>>")), "programs": F.coalesce("programs", none("array<struct<name:string,passed:boolean,error:boolean>>"))}
    return rows.select(*keep, F.lit(None).cast("string").alias("message"), *(F.when(F.col("_plain"), v).alias(k) for k, v in fields.items()), F.when(~F.col("_plain"), F.col("_text")).alias("_text"))


def trials(lines: DataFrame, text_col: str = "text") -> DataFrame:
    """Parse lines of results: the other columns, then the fields of parsed_trial.

    One narrow pass of Spark's own expressions reads the lines, and is written; lines that it doesn't read (see
    _read_trial) are read again by the parser, which gives the same fields for trees of any depth.
    """
    keep = [c for c in lines.columns if c != text_col]
    fields = ["message", "eval_name", "variant", "status", "service", "criteria", "programs"]
    first, seen = counted(_read_trial(lines, keep, text_col), "lines", odd=F.count_if(F.col("_text").isNotNull()))
    plain, rest = first.where("_text is null").drop("_text"), first.where("_text is not null").select(*keep, "_text")
    return plain.union(_parsed_trials(rest, keep, fields)) if seen["odd"] else plain


def _parsed_trials(lines: DataFrame, keep: list[str], fields: list[str]) -> DataFrame:
    schema = ", ".join(f"`{c}` {lines.schema[c].dataType.simpleString()}" for c in keep)
    kinds = {"criteria": pa.list_(pa.struct([("name", pa.string()), ("passed", pa.bool_())])), "programs": pa.list_(pa.struct([("name", pa.string()), ("passed", pa.bool_()), ("error", pa.bool_())]))}

    def each(batches):
        for batch in batches:
            rows = [parsed_trial(x.as_py() or "") for x in batch.column("_text")]
            found = [pa.array([r.get(f) for r in rows], kinds.get(f, pa.string())) for f in fields]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), *found], names=[*keep, *fields])

    return lines.mapInArrow(each, f"{schema}, {_TRIAL}" if schema else _TRIAL)


_CATEGORY = "struct<passed:bigint,total:bigint,failures:array<struct<name:string,evidence:string>>>"
ORACLE_SCHEMA = f"scenario string, language string, status string, error string, prompt {_CATEGORY}, languageChecks {_CATEGORY}, program {_CATEGORY}"


def oracle_lines(spark: SparkSession, root: str, name: str = "oracle-results.jsonl") -> DataFrame:
    """(ord, row VARIANT, whole) of each line in path and line order; a line that isn't strict JSON is an error. Of equal keys the last counts.

    A value of any depth is read; whole is the JSON text of one that VARIANT can't hold (``jsontext.parsed``), else null.
    """
    rows = parsed(numbered_lines(spark, root, name), "text", "Malformed oracle result on line")
    return rows.select(F.struct("path", "line").alias("ord"), "row", "whole")


def write_oracle_rows(rows: DataFrame, path: str) -> None:
    """One JSON line per scenario, in place of what was there; null fields are written."""
    rows.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def eval_cases(spark: SparkSession, path: str) -> DataFrame:
    """(line, id, query, ground_truth) of cases; missing fields and bad JSON are errors that name the physical line, as is a file without cases."""
    lines = numbered_lines(spark, path, physical=True)
    get = lambda k: F.try_variant_get("row", f"$.{k}", "string")
    bad = get("id").isNull() | get("query").isNull() | get("groundTruth").isNull()
    error = F.raise_error(F.format_string("Invalid evaluation case on line %d", "line")).cast("string")
    out = parsed(lines, "text", "Invalid evaluation case on line").select("line", F.when(bad, error).otherwise(get("id")).alias("id"), get("query").alias("query"), get("groundTruth").alias("ground_truth"))
    if lines.isEmpty():
        raise ValueError("The evaluation file has no cases.")
    return out


# -- catalogs ---------------------------------------------------------------------------------------


def _block(x, header: str, ends: str):
    """SQL regular expression pieces: the lines after a header line until one that ``ends`` matches."""
    return F.regexp_extract_all(x, F.lit(rf"(?md)^{header}[ \t]*\r?$((?:\n(?!{ends})[^\n]*)*+)"), F.lit(1))


def _items(x, indent: str):
    return F.transform(F.regexp_extract_all(x, F.lit(rf"(?md)^{indent}-[ \t]+(.+?)[ \t]*\r?$"), F.lit(1)), unquote)


def experiment_evals(text):
    """The paths under the top-level ``evals:``, as an array column."""
    return F.coalesce(_items(F.try_element_at(_block(text, "evals:", r"\S"), F.lit(1)), "  "), F.expr("cast(array() as array<string>)"))


def tag_sets(text):
    """The maps under each four-space ``tags:``, as an array column; of equal keys the last counts."""
    pairs = lambda b: F.arrays_zip(
        F.regexp_extract_all(b, F.lit(r"(?md)^      ([A-Za-z0-9_-]+):[ \t]*.+?[ \t]*\r?$"), F.lit(1)).alias("k"),
        F.transform(F.regexp_extract_all(b, F.lit(r"(?md)^      [A-Za-z0-9_-]+:[ \t]*(.+?)[ \t]*\r?$"), F.lit(1)), unquote).alias("v"),
    )
    last = lambda p: F.aggregate(p, F.expr("cast(map() as map<string,string>)"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, _: k != x["k"]), F.create_map(x["k"], x["v"])))
    return F.transform(_block(text, "    tags:", r"    \S"), lambda b: last(pairs(b)))


def suites(files: DataFrame) -> DataFrame:
    """(suite, suite_ord, ord, repo_path) from files (path, value): a suite without paths has one row with none; of equal names the last counts."""
    body = F.try_element_at(_block("value", "suites:", r"\S"), F.lit(1))
    named = files.select(F.split(F.concat(F.lit("\n"), body), r"\n(?=  [A-Za-z0-9][A-Za-z0-9-]*:[ \t]*\r?(?:\n|$))", -1).alias("parts")).select(F.posexplode("parts").alias("suite_ord", "part"))
    named = named.withColumn("suite", F.regexp_extract("part", r"^  ([A-Za-z0-9][A-Za-z0-9-]*):", 1)).where("suite <> ''")
    latest = named.groupBy("suite").agg(F.max_by("part", "suite_ord").alias("part"), F.min("suite_ord").alias("suite_ord"))
    paths = F.flatten(F.transform(_block("part", "    evals:", r"    \S"), lambda b: _items(b, "      ")))
    rows = latest.select("suite", "suite_ord", F.posexplode_outer(paths).alias("ord", "p"))
    return rows.select("suite", "suite_ord", "ord", normalize_path("p").alias("repo_path"))


def catalog(spark: SparkSession, root: str, experiments: list[tuple[str, str]]) -> DataFrame:
    """(ord, language, experiment, filter, repo_path, tag_sets) of all evaluations that the experiments declare, in order.

    experiments: (language, path under root), few and in declared order.
    """
    parts = []
    for k, (language, path) in enumerate(experiments):
        text = spark.read.text(f"{root}/{path}", wholetext=True)
        one = text.select(F.posexplode(experiment_evals(F.col("value"))).alias("n", "filter"))
        folder = path.rpartition("/")[0]
        parts.append(one.select(F.struct(F.lit(k).alias("experiment"), "n").alias("ord"), F.lit(language).alias("language"), F.lit(path).alias("experiment"), "filter", normalize_path(F.concat(F.lit(f"{folder}/"), "filter")).alias("repo_path")))
    out = parts[0]
    for x in parts[1:]:
        out = out.unionByName(x)
    specs = found_files(spark, root, "eval.yaml").select(F.regexp_extract("path", r"((?:[^/]+/){2}[^/]+)$", 1).alias("tail"), tag_sets(F.col("value")).alias("tag_sets"))
    return out.join(specs, F.regexp_extract("repo_path", r"((?:[^/]+/){2}[^/]+)$", 1) == F.col("tail"), "left").drop("tail")


def eval_services(spark: SparkSession, root: str) -> DataFrame:
    """(eval_name, service) of each scenario file that names both; folders without one are no error."""
    files = found_files(spark, root, "eval.yaml")
    named = files.select("path", first_group("value", r"^name:\s*(\S+)\s*$").alias("eval_name"), first_group("value", r"^\s+service:\s*(\S+)\s*$").alias("service"))
    return named.where("eval_name is not null and service is not null").groupBy("eval_name").agg(F.max_by("service", "path").alias("service"))


def pruned(files: DataFrame, excluded: list[str], marker: str) -> DataFrame:
    """(path): files outside folders of an excluded name and outside folders that hold the marker file."""
    parts = F.split("path", "/")
    kept = files.where(~F.exists(F.slice(parts, 1, F.size(parts) - 1), lambda p: p.isin(*excluded)))
    rims = files.where(F.element_at(parts, -1) == marker).select(F.regexp_replace("path", "/[^/]*$", "").alias("rim")).distinct()
    # Each file looks up all folders above it, so the test is an equi-join.
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    inside = kept.select("path", F.explode(above).alias("rim")).join(rims, "rim", "left_semi").select("path")
    return kept.join(inside, "path", "left_anti")


def walked(spark: SparkSession, root: str, excluded: list[str], marker: str, open_root: Callable[[str], tuple] = pafs.FileSystem.from_uri) -> tuple[DataFrame, DataFrame]:
    """((path) of the files below root, (path) of the folders that were listed).

    Folders of an excluded name are never opened, and of a folder that holds the marker file nothing is taken and nothing
    below it is opened; the root itself is always taken. Folders are listed in rounds, a level at a time, dealt to tasks; each
    round is written. ``open_root`` gives a file system and a path from the root's address, in each task.
    """

    def each(batches):
        fs, base = open_root(root)
        for batch in batches:
            folder, name, kind = [], [], []
            for one in batch.column("path").to_pylist():
                inside = fs.get_file_info(pafs.FileSelector(f"{base}/{one}".rstrip("/")))
                names = [x.base_name for x in inside]
                folder.append(one)
                name.append("")
                kind.append("listed")
                if one and marker in names:
                    continue
                for x in inside:
                    is_folder = x.type == pafs.FileType.Directory
                    if not (is_folder and x.base_name in excluded):
                        folder.append(one)
                        name.append(x.base_name)
                        kind.append("folder" if is_folder else "file")
            yield pa.RecordBatch.from_arrays([pa.array(v, pa.string()) for v in (folder, name, kind)], names=["folder", "name", "kind"])

    now = spark.createDataFrame([("",)], "path string")
    found, folders = None, 1
    while folders:
        dealt = now.repartition(max(1, min(folders, spark.sparkContext.defaultParallelism * 4)), "path")
        level, seen = counted(dealt.mapInArrow(each, "folder string, name string, kind string"), "walk", folders=F.count_if(F.col("kind") == "folder"))
        found = level if found is None else found.union(level)
        now = level.where("kind = 'folder'").select(F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), "name").alias("path"))
        folders = seen["folders"]
    path = F.concat_ws("/", F.when(F.col("folder") != "", F.col("folder")), "name")
    return found.where("kind = 'file'").select(path.alias("path")), found.where("kind = 'listed'").select(F.col("folder").alias("path"))


def under(listing: DataFrame, prefix: str) -> DataFrame:
    """(path, name): files below a prefix, and their names without it."""
    return listing.where(F.col("path").startswith(prefix)).select("path", F.expr(f"substring(path, {len(prefix) + 1})").alias("name"))


def json_lines(text: str) -> list:
    """The values of a command's output, one per line that isn't blank; a malformed line is an error."""
    if not isinstance(text, str):
        raise ValueError("The command gave no standard output")
    return [strict_json(x) for x in text.replace("\r\n", "\n").split("\n") if x.strip()]


def one_outcome(text: str):
    """The value of a command's output that must be exactly one."""
    found = json_lines(text)
    if len(found) != 1:
        raise ValueError(f"Expected one oracle result, received {len(found)}")
    return found[0]


def outcomes(outputs: DataFrame, id_col: str = "id", text_col: str = "stdout") -> DataFrame:
    """(id, outcome VARIANT, error) of commands' outputs, each of which must hold exactly one value: the error says what else it holds.

    Values stand one to a line; a malformed line ends the job, as in ``json_lines``. A null output is an error.
    """
    lines = F.split(F.col(text_col), "\r?\n")
    rows = outputs.select(F.col(id_col).alias("id"), F.monotonically_increasing_id().alias("n"), F.filter(lines, lambda x: x.rlike(f"[^{BLANK}]")).alias("found"))
    rows = written(rows, "outputs")
    one = parsed(rows.where("size(found) = 1").select("id", "n", F.col("found")[0].alias("text")), "text", "Malformed output", "n")
    told = F.when(F.col("found").isNull(), "The command gave no standard output").otherwise(F.concat(F.lit("Expected one oracle result, received "), F.size("found").cast("string")))
    rest = rows.where("coalesce(size(found), 0) <> 1").select("id", F.lit(None).cast("variant").alias("outcome"), told.alias("error"))
    return one.select("id", F.col("row").alias("outcome"), F.lit(None).cast("string").alias("error")).union(rest)


def scenario_directories(spark: SparkSession, root: str, names: list[str] | None = None, service: str | None = None, every: bool = False, language: str | None = None) -> DataFrame:
    """(scenario, language, path) of the folders right under root whose eval.yaml a selector takes, in name order.

    Exactly one of every, names and service selects; a service is compared as text, never as a pattern.
    """
    if every + bool(names) + (service is not None) != 1:
        raise ValueError("Select exactly one of every, a service, or names")
    if any(not x or x.startswith("-") for x in [*(names or ()), *(y for y in (service, language) if y is not None)]):
        raise ValueError("Selector values must be non-empty")
    specs = spark.read.text(f"{root}/*/eval.yaml", wholetext=True).select(F.regexp_replace(F.col("_metadata.file_path"), "/[^/]*$", "").alias("path"), "value")
    out = specs.select(F.regexp_extract("path", "([^/]*)$", 1).alias("scenario"), first_group("value", r"^\s+language:\s*(\S+)\s*$").alias("language"), "path", "value")
    if names:
        out = out.where(F.col("scenario").isin(*names))
    if service is not None:
        listed = F.regexp_extract_all("value", F.lit(r"(?m)^\s+service:[ \t]*(.*?)\s*$"), F.lit(1))
        out = out.where(F.array_contains(listed, service))
    if language is not None:
        out = out.where(F.col("language") == language)
    return out.drop("value").orderBy(F.expr("scenario COLLATE UNICODE"))
