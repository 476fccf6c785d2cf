"""Validated joins and vocabularies: they reject with a few examples instead of giving wrong rows. Each check is an aggregation; only examples reach the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Rejected(ValueError):
    """A table does not keep what an operator needs; the message has examples."""


def _refuse(bad: DataFrame, what: str, most: int = 5) -> None:
    if found := [tuple(r) for r in bad.limit(most).collect()]:
        raise Rejected(f"{what}: {found}")


def unique(df: DataFrame, on: list[str], name: str) -> DataFrame:
    """df, if no key (nulls count as equal) has several rows."""
    _refuse(df.groupBy(*on).count().filter("count > 1").select(*on), f"keys of {name} with several rows")
    return df


def filled(df: DataFrame, name: str) -> DataFrame:
    if df.isEmpty():
        raise Rejected(f"{name} is empty")
    return df


def one_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """A join of two tables that have rows, each key once on each side."""
    return unique(filled(left, "the left table"), on, "the left table").join(unique(filled(right, "the right table"), on, "the right table"), on, how)


def many_to_one(left: DataFrame, right: DataFrame, on: list[str], how: str = "left") -> DataFrame:
    """A join that gives each left row one partner at most."""
    return left.join(unique(right, on, "the right table"), on, how)


def in_vocabulary(df: DataFrame, column: str, words: DataFrame) -> DataFrame:
    """df, if each value of the column is one of words(column) or null."""
    known = words.select(column).distinct()
    _refuse(df.filter(F.col(column).isNotNull()).select(column).distinct().join(known, column, "left_anti"), f"unknown values of {column}")
    return df


def one_owner(df: DataFrame, key: str, owner: str) -> DataFrame:
    """df, if each key belongs to one owner."""
    _refuse(df.groupBy(key).agg(F.min(owner).alias("a"), F.max(owner).alias("b")).filter("a <> b"), f"values of {key} with several owners")
    return df
