"""Functions by name: SQL functions and table functions of a session, and calls of them that data asks for."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Function:
    """A registered function: its parameters as (name, type), the type it gives, and a test of the arguments in SQL."""

    name: str
    parameters: tuple[tuple[str, str], ...]
    returns: str
    valid: str


class Functions:
    """The functions that calls may name. Each is a temporary SQL function of the session, so SQL text can call it too; bodies are SQL and run in the JVM."""

    def __init__(self, spark: SparkSession):
        self.spark, self.known = spark, {}

    def _declared(self, name: str, parameters: dict[str, str]) -> str:
        if not re.fullmatch(r"[A-Za-z_]\w*", name) or not all(re.fullmatch(r"[A-Za-z_]\w*", p) for p in parameters):
            raise ValueError(f'"{name}" and its parameters must be plain names')
        if name in self.known:
            raise ValueError(f'A function "{name}" is registered already')
        return ", ".join(f"{p} {kind}" for p, kind in parameters.items())

    def scalar(self, name: str, parameters: dict[str, str], returns: str, body: str, valid: str = "true") -> None:
        """A function of one value. ``valid`` is a condition on the parameters; a call that doesn't meet it, or a null of it, is an error."""
        declared = self._declared(name, parameters)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({declared}) RETURNS {returns} RETURN {body}")
        self.known[name] = Function(name, tuple(parameters.items()), returns, valid)

    def table(self, name: str, parameters: dict[str, str], columns: str, query: str) -> None:
        """A function that gives rows, for use in SQL text (FROM name(...), LATERAL name(...))."""
        declared = self._declared(name, parameters)
        self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({declared}) RETURNS TABLE ({columns}) RETURN {query}")
        self.known[name] = Function(name, tuple(parameters.items()), "table", "true")

    def python_table(self, name: str, handler: type, columns: str) -> None:
        """The same of a Python class with ``eval``, which gets and gives Arrow batches."""
        if name in self.known:
            raise ValueError(f'A function "{name}" is registered already')
        self.spark.udtf.register(name, F.arrow_udtf(handler, returnType=columns))
        self.known[name] = Function(name, (), "table", "true")

    def called(self, calls: DataFrame, name: str = "name", arguments: str = "arguments") -> DataFrame:
        """calls with ``result``, the text of what the named function gives for the arguments, a VARIANT map by parameter.

        An unknown name, a missing or wrong argument, and one more than the parameters are errors of the job.
        """
        get = lambda p, kind: F.try_variant_get(F.col(arguments), f"$.{p}", kind)
        out = F.raise_error(F.concat(F.lit("Unknown function: "), F.coalesce(F.col(name), F.lit("")))).cast("string")
        for f in self.known.values():
            if f.returns == "table":
                continue
            given = {p: get(p, kind) for p, kind in f.parameters}
            test = F.size(F.map_keys(F.try_variant_get(F.col(arguments), "$", "map<string,variant>"))) == len(given)
            for v in given.values():
                test = test & v.isNotNull()
            # The condition is a function of the parameters too.
            check = f"_valid_{f.name}"
            declared = ", ".join(f"{p} {kind}" for p, kind in f.parameters)
            self.spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {check}({declared}) RETURNS BOOLEAN RETURN {f.valid}")
            test = F.coalesce(test & F.call_function(check, *given.values()), F.lit(False))
            bad = F.raise_error(F.lit(f"Invalid arguments for {f.name}")).cast("string")
            out = F.when(F.col(name) == f.name, F.when(test, F.call_function(f.name, *given.values()).cast("string")).otherwise(bad)).otherwise(out)
        return calls.withColumn("result", out)
