import pytest

from terroir import session
from terroir.functions.geo import haversine_np, sphere_cells
from terroir.operators.joins import spread_join
from tests.conftest import rows


def test_hot_keys_give_the_same_rows(spark):
    left = [(k, k if k % 3 else 0) for k in range(300)] + [(999, None)]
    right = [(k % 10, k) for k in range(50)] + [(None, 7)]
    a, b = spark.createDataFrame(left, "id int, k int"), spark.createDataFrame(right, "k int, v int")
    want = sorted(((k, i, v) for i, k in left for q, v in right if k is not None and k == q), key=str)
    for hot in (1, 7, 1000):
        assert rows(spread_join(a, b, ["k"], ["id"], hot)) == want
    assert spread_join(a.limit(0), b, ["k"], ["id"]).count() == spread_join(a, b.limit(0), ["k"], ["id"]).count() == 0


def test_cells_of_the_sphere(spark):
    import numpy as np

    rng = np.random.default_rng(3)
    at = [(float(90 - x), float(y)) for x, y in zip(rng.uniform(0, 1e-4, 30), rng.uniform(-180, 180, 30))] + [(42.0 + float(x), float(y)) for x, y in zip(rng.uniform(0, 2e-4, 30), rng.choice([179.9999, -179.9999, 179.99995], 30))]
    df = spark.createDataFrame([(k, *p) for k, p in enumerate(at)], "id int, lat double, lon double")
    own = {r["id"]: tuple(r["c"][0]) for r in df.select("id", sphere_cells(df["lat"], df["lon"], 20.0).alias("c")).collect()}
    near = {r["id"]: {tuple(x) for x in r["c"]} for r in df.select("id", sphere_cells(df["lat"], df["lon"], 20.0, 5.0).alias("c")).collect()}
    for i in range(len(at)):
        for j in range(len(at)):
            if haversine_np(*map(np.float64, (*at[i], *at[j]))) <= 5.0:
                assert own[i] in near[j]


def test_a_cluster_must_name_a_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://somewhere:7077"

        class _jsc:
            @staticmethod
            def sc():
                return Context

        @staticmethod
        def getCheckpointDir():
            class Empty:
                @staticmethod
                def isDefined():
                    return False

            return Empty

        @staticmethod
        def getConf():
            return {}

    class Session:
        sparkContext = Context

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        session.ensure_checkpoint_dir(Session)
