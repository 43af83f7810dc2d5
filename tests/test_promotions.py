from concurrent.futures import ThreadPoolExecutor
from datetime import datetime, timedelta
from threading import Barrier

import numpy as np

from modelwatch.config import load_settings
from modelwatch.plans import retraining
from modelwatch.sources.manifests import ManifestLog
from modelwatch.sources.tables import MonitorTables

T0 = datetime(2024, 5, 1)


def race(n, act):
    """Results of ``act(i)`` by ``n`` threads that start together."""
    start = Barrier(n)

    def one(i):
        start.wait()
        return act(i)

    with ThreadPoolExecutor(n) as pool:
        return list(pool.map(one, range(n)))


def stored(spark, path, versions=3):
    tables = MonitorTables(spark, str(path))
    data = [(v, f"run{v}", 0.9, 0.5 + v / 100) for v in range(1, versions + 1)]
    tables.append("model_versions", spark.createDataFrame(data, "version int, run_id string, accuracy double, f1_score double"))
    return tables


def in_production(tables):
    return [r["version"] for r in tables.versions().filter("is_production").collect()]


def test_a_number_is_taken_once(spark, tmp_path):
    log = ManifestLog(spark, str(tmp_path / "log"))
    assert log.last() == 0 and log.read("who int").count() == 0
    for number in range(1, 21):
        assert sum(race(8, lambda who, n=number: log.put(n, {"who": who}))) == 1
    assert log.last() == 20
    held = log.read("who int").collect()
    assert sorted(r["number"] for r in held) == list(range(1, 21)) and all(0 <= r["who"] < 8 for r in held)
    assert sorted(p.name[:1] for p in (tmp_path / "log").iterdir()) == ["0"] * 20  # no drafts left


def test_hadoop_paths_refuse_a_second_file(spark, tmp_path):
    log = ManifestLog(spark, f"{tmp_path}/log")
    log._local = lambda: None  # the way of file systems that are not on this machine
    assert log._rename(1, '{"number": 1, "who": 5}') and not log._rename(1, '{"number": 1, "who": 6}')
    assert log.put(2, {"who": 7}) and log.last() == 2
    assert sorted(tuple(r) for r in log.read("who int").collect()) == [(1, 5), (2, 7)]


def test_two_writers_leave_one_production_version(spark, tmp_path):
    tables = stored(spark, tmp_path / "store")
    assert tables.promote(1, T0) and in_production(tables) == [1]
    seen = tables.promotion_number()
    won = race(2, lambda i: tables.promote(2 + i, T0 + timedelta(days=1), seen))
    assert sorted(won) == [False, True]
    assert in_production(tables) == [2 + won.index(True)]
    # who lost has to look again
    assert not tables.promote(2 + won.index(False), T0 + timedelta(days=2), seen)
    assert tables.promote(2 + won.index(False), T0 + timedelta(days=2), tables.promotion_number())
    assert in_production(tables) == [2 + won.index(False)]


def test_numbers_decide_and_not_clocks(spark, tmp_path):
    tables = stored(spark, tmp_path / "store")
    tables.append("promotions", spark.createDataFrame([(3, T0 + timedelta(days=9))], "version int, promoted_at timestamp"))
    assert in_production(tables) == [3]  # an imported promotion
    assert tables.promote(2, T0) and tables.promote(1, T0 - timedelta(days=1))
    assert in_production(tables) == [1]
    deployed = {r["version"]: r["deployed_at"] for r in tables.versions().collect()}
    assert deployed == {1: T0 - timedelta(days=1), 2: T0, 3: T0 + timedelta(days=9)}
    assert not tables.promote(9, T0) and tables.promotion_number() == 2


def test_runs_get_versions_of_their_own(spark, tmp_path):
    tables = stored(spark, tmp_path / "store")
    assert sorted(race(6, lambda i: tables.new_version(f"r{i}"))) == list(range(4, 10))


def test_a_run_overtaken_by_a_promotion_is_rejected(spark, tmp_path, monkeypatch):
    tables = stored(spark, tmp_path / "store", versions=1)
    train = retraining.T.train_forest

    def overtaken(*args):
        assert tables.promote(1, T0)
        return train(*args)

    monkeypatch.setattr(retraining.T, "train_forest", overtaken)
    rng = np.random.default_rng(4)
    a = rng.normal(size=300)
    rows = [(float(x), float(y), int(x > 0.5)) for x, y in zip(a, rng.exponential(30, 300), strict=True)]
    original = spark.createDataFrame(rows, "a double, Amount double, Class int")
    settings = load_settings({"num_trees": 2, "max_depth": 2}, {})
    assert not retraining.retrain(tables, original, "slow", ["a", "Amount"], settings=settings)
    assert in_production(tables) == [1]
    event = tables.retraining_events().first()
    assert (event["status"], event["new_version"]) == ("REJECTED", 2)
