"""Residuals that are equal but for rounding: their ranks are the SQL's; and trials are made of few shuffles."""

import pyarrow as pa
import pyarrow.parquet as pq
from harness import assert_same, database

from pairwave.plans import catalog, standin
from pairwave.operators import series, trial

#: Members, microseconds since 2024 and values of dyads whose first day has two residuals apart by rounding only.
DRAWN = (
    [(0, 7610027294, 56.01), (0, 64839522784, 9.01), (0, 71642763651, 25.36), (0, 117562436691, 28.9), (1, 10603131135, 40.89), (1, 49684711542, 12.33), (1, 85695938596, 79.93), (1, 114903508452, 52.77)],
    [(0, 9298878615, 3.18), (0, 44196361256, 31.88), (0, 46565049012, 17.44), (0, 101480345697, 8.99), (1, 1589536423, 113.72), (1, 67663710605, 10.98), (1, 85693347128, 32.04), (1, 162644916297, 19.2)],
    [(0, 6765685741, 15.25), (0, 11894987370, 40.87), (0, 35382579165, 20.91), (0, 158534105967, 43.68), (1, 10754149729, 55.57), (1, 48893162194, 38.71), (1, 167109662938, 10.82)],
    [(0, 5610738866, 129.4), (0, 70244700948, 5.08), (0, 170244700948, 15.08), (1, 10015653618, 8.71), (1, 47516570960, 21.26), (1, 163606295780, 89.02)],
)


def test_ranks_are_the_sqls(spark, sf, tmp_path):
    rows = [(2 * dyad + member, 1704067200 * 1_000_000 + at, x) for dyad, drawn in enumerate(DRAWN) for member, at, x in drawn]
    user, at, x = zip(*rows)
    columns = {"event_id": pa.array(range(len(rows))), "ts": pa.array(at, pa.timestamp("us")), "user_id": pa.array(user), "event_type": ["view"] * len(rows), "value": pa.array(x), "props": ["{}"] * len(rows)}
    pq.write_table(pa.table(columns), f"{tmp_path}/events.parquet")
    con = database(sf)
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    con.execute("SET threads = 1")
    assert_same(catalog.QUERIES["trial_metrics"](spark, str(tmp_path)), con, catalog.ORACLES["trial_metrics"])


def test_a_trial_is_shuffled_once(spark, sf):
    for name in ("trial_metrics", "trial_assembly"):
        plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().executedPlan().toString()
        # one from the samples to their pieces, its small aggregates, and one of stretches; no grid point is shuffled
        assert plan.count("MapInArrow") == 1 and plan.count("Exchange hashpartitioning") <= 6 and "low#" in plan


def test_blocks_are_the_joined_grid(spark, sf):
    settings = {"most_lag": 10, "width": 24 * 3600.0, "step": 12 * 3600.0}
    kept = lambda df: sorted(repr(tuple(r)) for r in df.select("dyad", "trial", "n", "duration", "mean_a", "min_b", "lag", "n_windows").collect())
    grid = standin.dyads(spark, sf).withColumn("trial", series.F.col("trial").cast("long"))
    assert kept(trial.plain_of(standin.blocks_of(spark, sf), **settings)) == kept(trial.plain_metrics(grid, ["dyad", "trial"], "t", **settings))
