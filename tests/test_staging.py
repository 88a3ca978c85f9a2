import os

from routelab import staging


def test_stage_and_clear(spark):
    df = staging.staged(spark.range(5), "numbers")
    folder = df.inputFiles()[0].removeprefix("file://").rpartition("/")[0]
    assert df.count() == 5 and os.path.isdir(folder)
    made, staging._made[:] = staging._made[:], [staging._made[-1]]  # others' tables stay
    assert staging.clear(spark) == 1 and not os.path.exists(folder)
    staging._made[:] = made[:-1]


def test_scratch(spark):
    scratch = staging.Scratch(spark)
    folders = [scratch(spark.range(k), "part").inputFiles()[0].removeprefix("file://").rpartition("/")[0] for k in (1, 2)]
    kept = staging.staged(spark.range(3), "kept")
    scratch.clear()
    assert not any(map(os.path.exists, folders)) and kept.count() == 3
