import duckdb
import pytest

import __spark_entry__ as entry
from knotwork.plans import catalogue, golden

DATA = "/root/testdata/sf0.001"
#: One of each kind; the driver compares all of them.
SHOWN = ["graph_edges", "graph_collisions", "graph_intern", "scc", "cycles_ordered", "apply_exclusions", "trace_impacts", "restore_init_edges", "resolve_from", "resolve_string_all",
         "ancestor_edges", "check_diff", "scc_far", "reach_forward_far", "trace_best_path_far", "resolve_string_callsite", "suppressed_count", *golden.QUERIES]


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(str([names[i] for i in order]) + str([row[i] for i in order]) for row in values)


@pytest.mark.parametrize("name", SHOWN)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for t in ("part", "lineitem"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    result = con.execute(catalogue.oracles()[name])
    want = rows([c[0] for c in result.description], result.fetchall())
    df = entry.queries()[name](spark, DATA)
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == want


def test_every_query_has_sql():
    assert set(catalogue.queries()) == set(catalogue.oracles())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
