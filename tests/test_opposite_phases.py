"""Pairs in opposite phase: rounding alone tells pi from -pi, so their sums must round as those of the SQL do."""

import pyarrow as pa
import pyarrow.parquet as pq
from harness import assert_same, database

from pairwave.plans import catalog


def _events(at):
    """Dyads whose members each have one bend, in the same hour and to opposite sides."""
    hour, rows = 3600 * 1_000_000, []
    for dyad in range(60):
        bend = 6 + dyad % 7
        for member, way in ((0, 1), (1, -1)):
            values = (30 + 0.37 * dyad, 30 + 0.37 * dyad + way * (7.31 + dyad), 20.5 + 0.11 * dyad)
            times = (0, bend * hour + 60_000_000, (12 + dyad % 9) * hour + 90_000_000)
            rows += [(2 * dyad + member, t, v) for t, v in zip(times, values)]
    base = 1704067200 * 1_000_000
    table = pa.table({
        "event_id": pa.array(range(len(rows)), pa.int64()), "ts": pa.array([base + t for _, t, _ in rows], pa.timestamp("us")), "user_id": pa.array([u for u, _, _ in rows], pa.int64()),
        "event_type": ["view"] * len(rows), "value": pa.array([v for *_, v in rows], pa.float64()), "props": ["{}"] * len(rows),
    })
    pq.write_table(table, f"{at}/events.parquet")


def test_sign_is_the_sqls(spark, sf, tmp_path):
    _events(tmp_path)
    con = database(sf)
    # with more threads the SQL's own sums at edges of vectors come in any order
    con.execute("SET threads = 1")
    con.execute(f"CREATE OR REPLACE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    found = catalog.QUERIES["phase_metrics"](spark, str(tmp_path)).collect()
    signs = {r.mean_phase > 0 for r in found if abs(r.mean_phase) > 3.14159}
    assert signs == {True, False}
    for name in ("phase_metrics", "leader_votes"):
        assert_same(catalog.QUERIES[name](spark, str(tmp_path)), con, catalog.ORACLES[name])
