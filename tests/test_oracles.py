"""Every query against its SQL twin."""

import decimal
import math
import os

import duckdb
import pytest

from seqloom.plans.catalog import ORACLES, QUERIES


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(y) for y in x)
    if isinstance(x, dict):
        return tuple(plain(y) for y in x.values())
    if isinstance(x, (bool, int, float, decimal.Decimal)):
        return None if isinstance(x, float) and math.isnan(x) else round(float(x), 6) + 0.0
    return x


@pytest.fixture(scope="module")
def duck():
    from conftest import SF

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_rows(name, spark, duck, sf_dir):
    df = QUERIES[name](spark, sf_dir)
    columns = sorted(df.columns)
    want = duck.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    places = [want.columns.index(c) for c in columns]
    rows = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert rows == sorted((tuple(plain(r[i]) for i in places) for r in want.fetchall()), key=str)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_rows_without_sql(name, spark, sf_dir):
    """Rows come out, with the keys of the input, scores within their range, and ranks without gaps."""
    df = QUERIES[name](spark, sf_dir)
    rows = df.collect()
    assert rows and df.columns == list(rows[0].asDict())
    assert all(any(v is not None for v in r) for r in rows)
    for column in {"score", "combined", "ratio"} & set(df.columns):
        if dict(df.dtypes)[column] == "double" and name not in ("trie_beam", "ctc_forward_rank", "viterbi_final_sequence"):
            assert all(r[column] is None or -1e-9 <= r[column] <= 1.35 for r in rows)  # a continuation bonus may exceed 1 in a tracker
    if {"qid", "rank", "kind"} <= set(df.columns):
        for kind in {r["kind"] for r in rows}:
            for q in {r["qid"] for r in rows}:
                ranks = sorted(r["rank"] for r in rows if r["qid"] == q and r["kind"] == kind)
                assert ranks == list(range(1, len(ranks) + 1))
    if {"session", "pos"} <= set(df.columns):
        for s in {r["session"] for r in rows}:
            assert sorted(r["pos"] for r in rows if r["session"] == s) == list(range(sum(r["session"] == s for r in rows)))


def test_result_does_not_depend_on_partitions(spark, sf_dir):
    for name in ("fragment_lookup", "silence_sessions", "sequence_score", "round_robin"):
        seen = []
        for n in ("2", "7"):
            spark.conf.set("spark.sql.shuffle.partitions", n)
            seen.append(sorted(map(str, QUERIES[name](spark, sf_dir).collect())))
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        assert seen[0] == seen[1]
