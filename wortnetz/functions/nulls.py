"""Three-valued logic where the statistics language propagates missing values and SQL skips them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _poisoned(value: Column, column: Column) -> Column:
    """value, or null if the group has any null in column."""
    return F.when(F.count_if(column.isNull()) == 0, value)


def r_sum(column: Column) -> Column:
    return _poisoned(F.sum(column), column)


def r_mean(column: Column) -> Column:
    return _poisoned(F.avg(column), column)


def r_all(column: Column) -> Column:
    """False if any is false, else null if any is null, else true."""
    return F.when(F.count_if(~column) > 0, F.lit(False)).when(F.count_if(column.isNull()) > 0, F.lit(None)).otherwise(F.lit(True))


def share(flag: Column) -> Column:
    """Proportion of true values; null if any flag is null."""
    return r_mean(flag.cast("int"))


def n_unique(column: Column) -> Column:
    """Distinct values, null counting as one of them."""
    return F.count_distinct(column) + F.max(column.isNull().cast("int"))


def is_in(column: Column, values) -> Column:
    """Membership that is false, never null, for a null."""
    return F.coalesce(column.isin(*values), F.lit(False))


def if_else(condition: Column, yes: Column, no: Column) -> Column:
    """A null condition gives null, unlike when().otherwise()."""
    return F.when(condition, yes).when(~condition, no)


def na_if(column: Column, value) -> Column:
    return F.nullif(column, F.lit(value))
