from types import SimpleNamespace

import pytest

from windowmatch import staging


def session(master, configured=None):
    conf = SimpleNamespace(get=lambda name, default: configured or default)
    context = SimpleNamespace(master=master, applicationId=f"app-{master}")
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_shared_dir_is_the_configured_one():
    assert staging.shared_dir(session("spark://m", "hdfs://x/dir/")) == "hdfs://x/dir"


def test_a_cluster_needs_a_shared_dir():
    with pytest.raises(RuntimeError):
        staging.shared_dir(session("spark://m"))


def test_a_local_run_makes_its_own_once():
    local = session("local[2]")
    assert staging.shared_dir(local) == staging.shared_dir(local)


def test_release_drops_staged_tables_and_their_files(spark):
    df = staging.stage(spark.range(10), "numbers")
    name = staging._staged[spark.sparkContext.applicationId][-1]
    files = df.inputFiles()
    assert df.count() == 10 and files
    others = staging._staged[spark.sparkContext.applicationId][:-1]
    staging._staged[spark.sparkContext.applicationId] = [name]
    staging.release(spark)
    staging._staged[spark.sparkContext.applicationId] = others
    assert not spark.catalog.tableExists(name)
    import os

    assert not any(os.path.exists(f.removeprefix("file://")) for f in files)
