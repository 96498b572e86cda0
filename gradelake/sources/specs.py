"""Scenario specs: nested maps and lists by indentation, as rows, and the rules that a catalog of them keeps.

A spec's lines are read by one fold in Spark's own expressions, which keeps the open keys as a stack. What is read is the
style that catalogs are written in: block maps and lists, texts after | or >, and plain or quoted values; a flow value such
as {} is kept as its text.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gradelake.functions.scalars import unquote

_ENTRY = "struct<place:string,items:array<int>,value:string,line:int>"
#: The open levels, where a text began, and what the last line said, which the next step appends: what is bound is copied, so all found isn't.
_AT = f"named_struct('stack', cast(array() as array<struct<indent:int,dash:boolean,place:string,items:array<int>>>), 'block', -1, 'said', cast(array() as array<{_ENTRY}>))"
_STATE = f"named_struct('at', {_AT}, 'found', cast(array() as array<{_ENTRY}>))"


def _bound(x: Column, f) -> Column:
    """f of x, which is worked out once however often f names it."""
    return F.transform(F.array(x), f)[0]


def _lines(text: Column) -> Column:
    """Each line as (line, indent, dash, key, value, at, bare, blank, is_block): at is where the key of a list item stands, bare the line trimmed."""

    def one(x: Column, n: Column) -> Column:
        def of(start: Column) -> Column:
            dash = start.startswith("-") & start.rlike("^-( |$)")

            def split(r: Column) -> Column:
                rest = r["rest"]
                body = F.rtrim(rest)

                def keyed(y: Column) -> Column:
                    key, body = y["key"], y["body"]
                    value = F.when(key == "", body).otherwise(F.trim(F.substr(body, F.length(key) + 2, F.lit(1 << 30))))
                    return F.struct(F.when(key != "", key).alias("key"), value.alias("value"))

                pair = _bound(F.struct(body.alias("body"), F.regexp_extract(body, "^([A-Za-z0-9_.-]+):( |$)", 1).alias("key")), keyed)
                return _bound(pair, lambda y: F.struct(
                    (n + 1).alias("line"), (F.length(x) - F.length(start)).alias("indent"), r["dash"].alias("dash"), y["key"].alias("key"), y["value"].alias("value"), (F.length(x) - F.length(rest)).alias("at"),
                    F.rtrim(start).alias("bare"), (start == "").alias("blank"), ((y["value"].startswith("|") | y["value"].startswith(">")) & y["value"].rlike("^[|>][+-]?[0-9]?$")).alias("is_block"),
                ))

            return _bound(dash, lambda d: _bound(F.struct(d.alias("dash"), F.when(d, F.ltrim(F.substr(start, F.lit(2), F.lit(1 << 30)))).otherwise(start).alias("rest")), split))

        return _bound(F.ltrim(x), of)

    return F.transform(F.split(F.regexp_replace(text, "\r\n?", "\n"), "\n"), one)


def _level(top: Column, indent: Column, dash: Column, name: Column, items: Column) -> Column:
    """The stack's level for a list item or key below top, which is null at the outermost."""
    return F.struct(indent.alias("indent"), dash.alias("dash"), F.concat_ws("/", top["place"], name).alias("place"), items.alias("items"))


def _step(state: Column, r: Column) -> Column:
    s = state["at"]
    none, nothing = F.expr("cast(array() as array<int>)"), F.expr(f"cast(array() as array<{_ENTRY}>)")
    top = lambda stack: F.try_element_at(stack, F.lit(-1))
    items = lambda e: F.coalesce(e["items"], none)
    entry = lambda place, items, v: F.array(F.struct(place.alias("place"), items.alias("items"), v.alias("value"), r["line"].alias("line")))
    inside = (s["block"] >= 0) & ((r["indent"] > s["block"]) | r["blank"])
    skipped = r["blank"] | r["bare"].startswith("#")
    # A list may stand at the indent of its key.
    over = F.filter(s["stack"], lambda e: (e["indent"] < r["indent"]) | ((e["indent"] == r["indent"]) & r["dash"] & ~e["dash"]))
    item = lambda t: _level(t, r["indent"], F.lit(True), F.lit("#"), F.concat(items(t), F.array(r["line"])))
    dashed = F.when(r["dash"], _bound(over, lambda o: F.concat(o, F.array(item(top(o)))))).otherwise(over)
    keyed = lambda o: F.concat(o, F.array(_level(top(o), r["at"], F.lit(False), r["key"], items(top(o)))))
    stack = F.when(r["key"].isNotNull(), _bound(dashed, keyed)).otherwise(dashed)
    now = lambda stack, block, said: F.struct(stack.alias("stack"), block.alias("block"), said.alias("said"))
    said = lambda o: F.when((r["value"] != "") & ~r["is_block"], entry(F.coalesce(top(o)["place"], F.lit("")), items(top(o)), unquote(r["value"]))).otherwise(nothing)
    at = (
        F.when(inside, now(s["stack"], s["block"], entry(F.concat_ws("/", top(s["stack"])["place"], F.lit("|")), items(top(s["stack"])), r["bare"])))
        .when(skipped, now(s["stack"], F.lit(-1), nothing))
        .otherwise(_bound(stack, lambda o: now(o, F.when(r["is_block"], r["indent"]).otherwise(-1), said(o))))
    )
    return F.struct(at.alias("at"), F.when(F.size(s["said"]) > 0, F.concat(state["found"], s["said"])).otherwise(state["found"]).alias("found"))


def _found(text: Column) -> Column:
    """The (place, items, value, line) of a spec in the order of its lines, as ``entries`` describes them."""
    return F.aggregate(_lines(F.coalesce(text, F.lit(""))), F.expr(_STATE), _step, lambda s: F.concat(s["found"], s["at"]["said"]))


def entries(files: DataFrame, text_col: str = "value") -> DataFrame:
    """(the other columns, place, path, items, value, line): each value of the specs.

    place names the keys that lead to it, joined by /, with # for the items of lists and | for the lines of a text; items are
    the numbers of the lines where these items begin, from the outermost, so values of one item share them.
    """
    keep = [c for c in files.columns if c != text_col]
    return files.select(*keep, F.explode(_found(F.col(text_col))).alias("e")).select(*keep, "e.place", "e.items", "e.value", "e.line")


GRADER, CRITERION = "stimuli/#/graders/#", "stimuli/#/graders/#/config/criteria/#"


def graders(found: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, items, type, name, command, args, timeout) of each grader of ``entries``; args in their order."""
    mine = found.where(F.col("place").startswith(GRADER + "/")).withColumn("items", F.slice("items", 1, 2))
    one = lambda k: F.max(F.when(F.col("place") == f"{GRADER}/{k}", F.col("value")))
    args = F.transform(F.array_sort(F.collect_list(F.when(F.col("place") == f"{GRADER}/config/args/#", F.struct("line", "value")))), lambda x: x["value"])
    return mine.groupBy(*keys, "items").agg(one("type").alias("type"), one("name").alias("name"), one("config/command").alias("command"), args.alias("args"), one("config/timeout").alias("timeout"))


def _values(found: Column, place: str) -> Column:
    """The values at a place, in the order of their lines."""
    return F.transform(F.filter(found, lambda x: x["place"] == place), lambda x: x["value"])


def _graders(found: Column) -> Column:
    """The (items, type, name, command, args, timeout) of each grader among the values of one spec."""

    def one(own: Column) -> Column:
        largest = lambda k: F.array_max(_values(own, f"{GRADER}/{k}")).alias(k.rpartition("/")[2])
        return F.struct(F.slice(own[0]["items"], 1, 2).alias("items"), largest("type"), largest("name"), largest("config/command"), _values(own, f"{GRADER}/config/args/#").alias("args"), largest("config/timeout"))

    # The values of a grader follow each other, so that each is cut out once.
    begins = lambda m: F.filter(F.transform(m, lambda x, i: F.when((i == 0) | (F.try_element_at(m, i)["items"][1] != x["items"][1]), i + 1)), lambda i: i.isNotNull())
    cut = lambda m, b: F.transform(b, lambda at, k: _bound(F.slice(m, at, F.coalesce(F.try_element_at(b, k + 2), F.size(m) + 1) - at), one))
    return _bound(F.filter(found, lambda x: x["place"].startswith(GRADER + "/")), lambda m: _bound(begins(m), lambda b: cut(m, b)))


def grader_rows(files: DataFrame, text_col: str = "value") -> DataFrame:
    """(the other columns, items, type, name, command, args, timeout) of each grader of the specs: ``graders``, each spec by itself.

    Nothing is shuffled. Null and empty texts have no graders.
    """
    keep = [c for c in files.columns if c != text_col]
    return files.select(*keep, F.explode(_graders(_found(F.col(text_col)))).alias("g")).select(*keep, "g.*")


@dataclass(frozen=True)
class Program:
    """A program grader that specs of a language must have."""

    name: str
    command: str
    args: tuple[str, ...]
    timeout: str


@dataclass(frozen=True)
class CatalogRules:
    """What a catalog asks of its specs: by language the number of language criteria and the program graders, and for all the rest."""

    criteria: dict[str, int]
    programs: dict[str, tuple[Program, ...]]
    model: str
    scopes: tuple[str, ...]
    #: Files that every spec stages, as (source, destination), the first of them first; and those of one language only.
    files: tuple[tuple[str, str], ...] = ()
    own_files: dict[str, tuple[str, str]] = field(default_factory=dict)
    sentence: str = ""
    no_criterion: str = ""


def broken_rules(files: DataFrame, rules: CatalogRules, key: str = "path", text_col: str = "value") -> DataFrame:
    """(key, rule, found, wanted) of specs that break a rule: each is a count of values that must be as wanted.

    Specs need a key of their own. A language that the rules don't know is broken too, and none of its numbers are judged.
    Each spec is judged by itself, with no shuffle.
    """
    of = lambda place, test=None: lambda x: (x["place"] == place) if test is None else (x["place"] == place) & test(x["value"])
    staged = "agent_environment/files/#"
    count = {
        "one panel": of(f"{GRADER}/type", lambda v: v == "panel"),
        "program graders": of(f"{GRADER}/type", lambda v: v == "run-command"),
        "no grader of type program": of(f"{GRADER}/type", lambda v: v == "program"),
        "no weights": of("scoring/weights", lambda v: v == "{}"),
        "no threshold of the scoring": lambda x: x["place"].endswith("/threshold") & x["place"].rlike("^[^/]+/threshold$"),
        "nothing required": lambda x: (x["place"] == "required") | x["place"].endswith("/required"),
        "threshold of zero": of(f"{GRADER}/config/threshold", lambda v: v == "0"),
        "overall threshold of zero": of(f"{GRADER}/config/overall_threshold", lambda v: v == "0"),
        "language criteria": of(f"{CRITERION}/name", lambda v: v.startswith("language/")),
        "no such criterion": of(f"{CRITERION}/name", lambda v: v == rules.no_criterion),
        "one scope": lambda x: x["place"].endswith("/scope") & x["value"].isin(*rules.scopes),
        "no environment of a stimulus": lambda x: (x["place"] == "stimuli/#/environment") | x["place"].startswith("stimuli/#/environment/"),
    }
    e = F.col("e")
    first = lambda place: F.try_element_at(_values(e, place), F.lit(1))
    per = files.select(F.col(f"`{key}`").alias("key"), _found(F.col(f"`{text_col}`")).alias("e")).select(
        "key", *(F.size(F.filter(e, t)).alias(f"c{i}") for i, t in enumerate(count.values())),
        F.array_max(_values(e, "stimuli/#/tags/language")).alias("language"), first(f"{GRADER}/config/models/#").alias("model"), first(f"{GRADER}/config/evidence/#").alias("evidence"),
        F.array_join(_values(e, f"{GRADER}/config/prompt/|"), " ").alias("texts"), F.arrays_zip(_values(e, f"{staged}/src").alias("src"), _values(e, f"{staged}/dest").alias("dest")).alias("staged"),
        F.filter(_graders(e), lambda g: g["type"] == "run-command").alias("programs"),
    )
    speaks = lambda lang: F.coalesce(F.col("language") == lang, F.lit(False))
    by_language = lambda numbers: F.coalesce(F.lit(None).cast("bigint"), *(F.when(speaks(lang), F.lit(n).cast("bigint")) for lang, n in numbers.items()))
    n_criteria, n_programs = by_language(rules.criteria), by_language({lang: len(rules.programs.get(lang, ())) for lang in rules.criteria})
    exact = {"one panel": F.lit(1), "program graders": n_programs, "no grader of type program": F.lit(0), "no weights": F.lit(1), "no threshold of the scoring": F.lit(0), "nothing required": F.lit(0), "language criteria": n_criteria, "no such criterion": F.lit(0), "one scope": F.lit(1), "no environment of a stimulus": F.lit(0)}
    told = []
    judge = lambda rule, number, low, high=None: told.append(F.struct(F.lit(rule).alias("rule"), number.cast("bigint").alias("found"), low.cast("bigint").alias("wanted"), (F.lit(None).cast("bigint") if high is None else high.cast("bigint")).alias("high")))
    for i, rule in enumerate(count):
        judge(rule, F.col(f"c{i}"), exact.get(rule, F.lit(1)), exact.get(rule))
    judge("a known language", n_criteria.isNotNull().cast("int"), F.lit(1))
    judge("first model", F.coalesce(F.col("model") == rules.model, F.lit(False)).cast("int"), F.lit(1))
    judge("first evidence is diff", F.coalesce(F.col("evidence") == "diff", F.lit(False)).cast("int"), F.lit(1))
    if rules.sentence:
        judge("sentence of the prompt", F.col("texts").contains(rules.sentence).cast("int"), F.lit(1))
    is_pair = lambda s, p: (s["src"] == p[0]) & (s["dest"] == p[1])
    for k, p in enumerate(rules.files):
        there = F.exists("staged", lambda s: is_pair(s, p)) if k else is_pair(F.try_element_at("staged", F.lit(1)), p)  # noqa: B023
        judge(f"staged file {p[1]}", F.coalesce(there, F.lit(False)).cast("int"), F.lit(1))
    for lang, p in rules.own_files.items():
        wanted = speaks(lang).cast("int")
        judge(f"staged file {p[1]}", F.size(F.filter("staged", lambda s: s["src"] == p[0])), wanted, wanted)  # noqa: B023
    for lang, programs in rules.programs.items():
        for p in programs:
            same = lambda g: (g["name"] == p.name) & (g["command"] == p.command) & (g["args"] == F.array(*map(F.lit, p.args)).cast("array<string>")) & (g["timeout"] == p.timeout)  # noqa: B023, E731
            judge(f"program grader {p.name}", F.coalesce(F.exists("programs", same), F.lit(False)).cast("int"), speaks(lang).cast("int"))
    x = F.col("x")
    broken = per.select("key", F.explode(F.array(*told)).alias("x")).where((x["found"] < x["wanted"]) | (x["found"] > x["high"]))
    return broken.select(F.col("key").alias(key), "x.rule", "x.found", "x.wanted")
