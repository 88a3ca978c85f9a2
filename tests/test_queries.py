"""Every core query against its DuckDB oracle; those without one run and have rows."""

import pandas as pd
import pytest

from routelab.plans import adapters, model_queries, registry

QUERIES, ORACLES = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_oracle(name, compare):
    compare(QUERIES[name], ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(name, spark):
    assert QUERIES[name](spark, "/root/testdata/sf0.01").count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_draw_sweep_is_whole(spark):
    rows = [r.asDict() for r in QUERIES["draw_sweep"](spark, "/root/testdata/sf0.001").collect()]
    assert [r["draws"] for r in rows] == [10, 20, 40, 80]
    for r in rows:
        assert 0 < r["n_obs"] <= 1200 and r["test_log_likelihood"] < 0 and r["mean_set_size"] <= r["mean_choice_set_size"]
        for name, true in (("ivt", 0.025), ("wait", 0.05), ("walk", 0.035), ("transfer", 0.4), ("pathsize", 1.0)):
            assert abs(r[f"bias_{name}"] - (r[name] - true)) < 1e-12
            assert r[f"z_{name}"] is None or r[f"z_{name}"] == r[f"z_{name}"]


def test_hit_rate_draws_sets_of_its_own(spark, monkeypatch):
    draws, hashed_sets = [], model_queries.eps.hashed_sets
    monkeypatch.setattr(model_queries.eps, "hashed_sets", lambda trips, paths, n, *rest: draws.append(n) or hashed_sets(trips, paths, n, *rest))
    monkeypatch.setattr(model_queries.eps, "with_observed", lambda *_: pytest.fail("the observed path is forced in"))
    assert 0 <= QUERIES["hit_rate"](spark, "/root/testdata/sf0.001").first()[0] <= 1
    assert draws == [30]


def test_part_edges_take_tied_lines_in_the_order_of_the_table(spark, tmp_path):
    """Two lines of an order share number and part; the larger file, which Spark reads first, holds the later of them."""
    columns = ["l_orderkey", "l_partkey", "l_linenumber", "l_quantity"]
    files = [[(1, 10, 1, 40.0)], [(1, 10, 1, 5.0), (1, 11, 2, 7.0), *[(n, n, 1, 1.0) for n in range(20, 2000)]]]
    for first, second in (files, files[::-1]):
        (tmp_path / f"{len(first)}" / "lineitem.parquet").mkdir(parents=True)
        for k, rows in enumerate((first, second)):
            pd.DataFrame(rows, columns=columns).to_parquet(tmp_path / f"{len(first)}" / "lineitem.parquet" / f"part-{k}.parquet")
        last = second[0][3]
        assert [tuple(r) for r in adapters.part_edges(spark, str(tmp_path / f"{len(first)}")).collect()] == [("10", "11", 60 + 10 * last)]
