"""Registry of named queries and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) under its name, with DuckDB SQL that gives the same rows."""

    def add(function):
        name = function.__name__
        if name in QUERIES:
            raise ValueError(f"two queries are named {name}")
        QUERIES[name] = function
        if sql:
            ORACLES[name] = sql
        return function

    return add


def ws(x: str) -> str:
    return f"trim(regexp_replace({x}, '\\s+', ' ', 'g'))"


def plain(x: str) -> str:
    return ws(f"regexp_replace({x}, '[^ -~]', '', 'g')")


def split(x: str) -> str:
    return f"list_filter(string_split_regex({x}, '\\s+'), lambda w: w <> '')"


CORPUS = f"corpus AS (SELECT conv_id AS grp, turn AS seq, {ws('text')} AS txt FROM conversations)"
ASCII_CORPUS = f"corpus AS (SELECT conv_id AS grp, turn AS seq, {plain(ws('text'))} AS txt FROM conversations)"
PASSAGES = f"passages AS (SELECT item_id AS qid, {ws('text')} AS txt FROM benchmark)"
ASCII_PASSAGES = f"passages AS (SELECT item_id AS qid, {plain(ws('text'))} AS txt FROM benchmark)"
