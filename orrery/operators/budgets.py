"""Selections under a budget that skip what doesn't fit, and what is never worth a place in one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A line this long looks generated, and the share of such lines that makes a file minified.
LONG, MOST = 500, 0.3
#: Lines of a body that does nothing, and comments.
STUB = r"^\s*(pass|return\s*$|return\s+None\s*$|\.{3}\s*$)"
COMMENT = r"^\s*(#|//|/\*|\*)"


def minified(text: Column) -> Column:
    lines = F.split(text, "\n", -1)
    return F.size(F.filter(lines, lambda x: F.length(x) > LONG)) / F.size(lines) > MOST


def stub(body: Column) -> Column:
    """Whether a body, without its signature's line, is empty or made of stubs and comments."""
    lines = F.filter(F.slice(F.split(body, "\n", -1), F.lit(2), F.greatest(F.size(F.split(body, "\n", -1)) - 1, F.lit(0))), lambda x: F.trim(x) != "")
    return F.forall(lines, lambda x: x.rlike(STUB) | x.rlike(COMMENT))


class Greedy:
    """A table function over the rows of a partition in order: yields those that fit what is left of the budget."""

    def __init__(self):
        self.spent = 0

    def eval(self, row, budget: int):
        if row["cost"] is not None and self.spent + row["cost"] <= budget:
            self.spent += row["cost"]
            yield (*row, self.spent)


def fitting(items: DataFrame, budget: int) -> DataFrame:
    """The items (grp, priority, id, cost, ...) of each group that fit, in order of priority and id, with what is ``spent``
    so far: an item that doesn't fit is skipped, a cheaper one after it may still be taken. Null costs never fit.

    Rows of a group pass one after the other; the state is one number.
    """
    from pyspark.sql.types import LongType, StructType

    schema = StructType([*items.schema.fields]).add("spent", LongType())
    select = F.udtf(Greedy, returnType=schema)
    return select(items.asTable().partitionBy("grp").orderBy("priority", "id"), F.lit(budget))
