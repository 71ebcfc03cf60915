import json

from seriesloom.plans.engine import Engine
from seriesloom.sources.points import METRICS
from seriesloom.streaming import load


def test_a_run_appends_what_it_says(spark, tmp_path, capsys):
    store = f"file://{tmp_path}/store"
    assert load.main(["--store", store, "--workers", "3", "--batch", "20", "--duration", "2", "--series", "10"]) == 0
    said = json.loads(capsys.readouterr().out.strip().splitlines()[-1])
    engine = Engine(spark, store)
    assert said["batches"] >= 3 and said["points"] == 20 * said["batches"] and said["errors"] == 0
    assert 0 < said["p50"] <= said["p95"] <= said["p99"]
    assert sum(engine.query(m, dedup=False).count() for m in METRICS) == said["points"]
    assert 0 < engine.series().count() <= 10


def test_failed_batches_are_errors(spark, tmp_path):
    class Broken(Engine):
        def append(self, *args, **more):
            raise OSError("disk full")

    got = load.run(Broken(spark, f"file://{tmp_path}/store"), workers=2, batch=5, duration=0.2, series=3, rps=20)
    assert got["batches"] == got["points"] == 0 and got["errors"] >= 1 and "disk full" in got["first_error"]


def test_pace_does_not_make_up_for_idle_time():
    pace = load.Pace(10)
    at = [pace.start() for _ in range(4)]
    assert all(0.0999 < b - a < 0.2 for a, b in zip(at, at[1:]))
    pace._next -= 100
    late = [pace.start() for _ in range(2)]
    assert 0.0999 < late[1] - late[0] < 0.2


def test_ranks():
    assert load.rank([], 0.5) == 0 and load.rank([1.0], 0.99) == 1 and load.rank([1, 2, 3, 4], 0.5) == 2
