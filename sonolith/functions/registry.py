"""User functions by name: columns, and scalar, aggregate and table functions for SQL.

A column function takes and gives Column and needs no Python in the tasks. The other
kinds run as Arrow functions; `install` makes them callable in a session's SQL. An
aggregate function is called once a group and holds it whole. One of kind sums is two
functions around Spark's sums, called once a batch: f_parts gives the terms of each row
and f_end the value of their sums; in SQL f_end(sum(p.a), ...) over f_parts(...) AS p.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

KINDS = ("column", "scalar", "aggregate", "sums", "table")


@dataclass(frozen=True)
class UserFunction:
    name: str
    kind: str
    function: Callable | tuple[Callable, Callable]
    returns: str | None = None

    def __call__(self, *args: Column):
        if self.kind == "sums":
            parts, end = self.native()
            terms = parts(*args)
            return end(*(F.sum(terms[name]) for name in parts.returnType.names))
        return self.function(*args) if self.kind == "column" else self.native()(*args)

    def native(self):
        """The function as Spark takes it."""
        if self.kind == "table":
            return F.udtf(type(self.name, (), {"eval": staticmethod(self.function)}), returnType=self.returns)
        if self.kind == "sums":
            return F.pandas_udf(self.function[0], self.returns), F.pandas_udf(self.function[1], "double")
        return F.pandas_udf(self.function, self.returns)


FUNCTIONS: dict[str, UserFunction] = {}


def register(name: str, kind: str, function: Callable, returns: str | None = None) -> UserFunction:
    """kind: column (Column -> Column), scalar (Series -> Series), aggregate (Series ->
    value), both with their types annotated, sums (a pair: Series -> DataFrame of a row's
    terms, Series of their sums -> Series), or table (values -> iterator of tuples).
    returns: the Spark type or schema of the last four, for sums that of the terms."""
    if kind not in KINDS or (kind == "column") != (returns is None):
        raise ValueError(f"{name}: a {kind} function with the type {returns}")
    if name in FUNCTIONS:
        raise ValueError(f"{name} is registered already")
    FUNCTIONS[name] = UserFunction(name, kind, function, returns)
    return FUNCTIONS[name]


def install(spark: SparkSession) -> None:
    """Makes all but column functions callable in SQL."""
    for f in FUNCTIONS.values():
        if f.kind == "table":
            spark.udtf.register(f.name, f.native())
        elif f.kind == "sums":
            for end, native in zip(("parts", "end"), f.native(), strict=True):
                spark.udf.register(f"{f.name}_{end}", native)
        elif f.kind != "column":
            spark.udf.register(f.name, f.native())
