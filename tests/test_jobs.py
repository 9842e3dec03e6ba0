import os
import subprocess
import sys

import fixtures as fx
import pytest

from windowmatch.__main__ import main
from windowmatch.sources import tables


@pytest.fixture
def bar_dir(tmp_path):
    rows = fx.random_bars({1: 40, 2: 30, 3: 25})
    for sid, bars in fx.by_sid(rows).items():
        lines = ["datetime;OPEN;HIGH;LOW;CLOSE;PRE_CLOSE;VOLUME"]
        lines += [f"{r[2]:%Y%m%d %H:%M};{r[3]};{r[4]};{r[5]};{r[6]};1;2" for r in bars]
        path = tmp_path / "files"
        path.mkdir(exist_ok=True)
        (path / f"{sid}.X.csv").write_text("\n".join(lines) + "\n")
    return str(path), rows


def test_import_draw_and_search(spark, tmp_path, bar_dir, capsys):
    path, rows = bar_dir
    tables.reset_namespace(spark, "jobs_test", str(tmp_path / "warehouse"))
    try:
        files = ["--data-path", path, "--delimiter", ";", "--dt-format", "%Y%m%d %H:%M"]
        for _ in range(2):  # a second import of the same files changes nothing
            main(["import", *files, "--table", "jobs_test.bars"], spark)
        assert spark.table("jobs_test.bars").count() == len(rows)
        main(["draw", *files, "--n", "6", "--m", "30", "--namespace", "jobs_test"], spark)
        assert capsys.readouterr().out.strip() == "jobs_test.windows6"
        drawn = sorted(tuple(r)[:3] for r in spark.table("jobs_test.windows6").collect())
        assert len(set(drawn)) == 30 and set(drawn) <= set(fx.windows_of(rows, 6))
        main(["draw", "--table", "jobs_test.bars", "--n", "6", "--m", "30", "--namespace", "jobs_test"], spark)
        assert sorted(tuple(r)[:3] for r in spark.table("jobs_test.windows6").collect()) == drawn
        capsys.readouterr()
        main(["search", "--table", "jobs_test.bars", "--windows", "jobs_test.windows6", "--k", "4"], spark)
        lines = capsys.readouterr().out.strip().splitlines()

        def x(window):
            return [list(r[3:]) for r in fx.bars_in(rows, *window)]

        scored = sorted(
            ((fx.correlation(x(w), x(drawn[0])), w) for w in drawn[1:]), reverse=True
        )[:4]
        assert len(lines) == 4
        for rank, (line, (score, window)) in enumerate(zip(lines, scored), 1):
            place = f"security {window[0]}, {window[1]} to {window[2]}"
            assert line == f"{rank}. {score:.6f}, {place}"
    finally:
        spark.sql("DROP DATABASE jobs_test CASCADE")


def test_commands_of_three_processes(tmp_path, bar_dir):
    path, _ = bar_dir
    bars, windows = tmp_path / "bars", tmp_path / "windows"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    conf = f"spark.checkpoint.dir=file://{tmp_path}/shared"
    env = os.environ | {
        "PYSPARK_SUBMIT_ARGS": f"--master local[2] --conf {conf} --conf spark.ui.enabled=false pyspark-shell"
    }

    def run(*args):
        command = [sys.executable, "-m", "windowmatch", *map(str, args)]
        done = subprocess.run(command, cwd=root, env=env, capture_output=True, text=True, timeout=300)
        assert done.returncode == 0, [x for x in done.stderr.splitlines() if "rror" in x or "xception" in x][:5]
        return done.stdout.strip().splitlines()

    files = ["--data-path", path, "--delimiter", ";", "--dt-format", "%Y%m%d %H:%M"]
    run("import", *files, "--table", bars)
    stored = sorted(str(p) for p in bars.rglob("*.parquet"))
    run("import", *files, "--table", bars)
    assert sorted(str(p) for p in bars.rglob("*.parquet")) == stored
    run("draw", "--table", bars, "--n", 6, "--m", 30, "--out", windows)
    assert len(run("search", "--table", bars, "--windows", windows, "--k", 4)) == 4
    assert not list((tmp_path / "shared").rglob("*.parquet"))
