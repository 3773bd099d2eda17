from __future__ import annotations

from tunegrain.operators import timing
from tunegrain.sources.logs import read_timing_log

LOG = """BFS Performance Test - 20250701_120000
=================================
Run 1 - Artist A: A1, Artist B: B1
\t\tTotal time spent by all map tasks (ms)=77
===== Timing Information =====
\t\tTotal time spent by all map tasks (ms)=1000
\t\tTotal time spent by all reduce tasks (ms)=500
\t\tTotal time spent by all map tasks (ms)=2001
=============================
\t\tTotal time spent by all reduce tasks (ms)=88

Run 2 - Artist A: A2, Artist B: B2
===== Timing Information =====
\t\tTotal time spent by all map tasks (ms)=10
=============================
"""


def test_report(spark, tmp_path):
    (tmp_path / "one.log").write_text(LOG)
    runs = timing.run_times(read_timing_log(spark, str(tmp_path / "one.log")))
    assert sorted((r.run, r.map_ms, r.reduce_ms) for r in runs.collect()) == [(1, 3001, 500), (2, 10, 0)]
    assert tuple(timing.timing_report(runs).first())[1:] == (2, 3011, 500, 3511, 1505, 250, 1755)


def test_blocks_carry_state_across(spark, tmp_path):
    """Tiny file splits: runs and sections reach over several blocks."""
    (tmp_path / "long.log").write_text(LOG * 30)
    (tmp_path / "short.log").write_text(LOG)
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
        events = read_timing_log(spark, str(tmp_path))
        assert events.select("log", "block").distinct().count() > 40
        report = {r.log.rsplit("/", 1)[1]: tuple(r)[1:] for r in timing.timing_report(timing.run_times(events)).collect()}
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    assert report["short.log"] == (2, 3011, 500, 3511, 1505, 250, 1755)
    assert report["long.log"] == (60, 30 * 3011, 30 * 500, 30 * 3511, 1505, 250, 1755)
