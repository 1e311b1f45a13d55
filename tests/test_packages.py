from pathlib import Path
from urllib.parse import urlparse

import yaml

from metricspark import Config, Package, render, run_config, run_package, run_packages, write_text
from metricspark.operators.folds import flat
from metricspark.session import shared_dir
from metricspark.publish import read_published


def package(name="shop", **metrics):
    return Package.from_dict({"name": name, "metrics": metrics})


def values(run):
    return {(r.name + r.suffix, r.labels): r.value for r in run.table.collect()}


def test_counter_ignores_its_value_and_starts_anew(spark):
    p = package(gauge=[{"name": "g", "sql": "SELECT 1 AS value"}], counter=[{"name": "c", "sql": "SELECT 2 AS value"}])
    for _ in range(2):
        assert values(run_package(spark, p)) == {("shop_g", ""): 1.0, ("shop_c", ""): 1.0}


def test_a_metric_that_cannot_be_planned_leaves_the_rest(spark):
    p = package(
        gauge=[{"name": "bad", "sql": "select x from nowhere"}, {"name": "good", "sql": "select 1 as v"}],
        summary=[{"name": "worse", "sql": "select", "objectives": [0.5]}],
    )
    run = run_package(spark, p)
    assert set(run.errors) == {"shop_bad", "shop_worse"}
    assert values(run) == {("shop_good", ""): 1.0}


def test_a_metric_that_fails_on_its_data_leaves_the_rest(spark, tmp_path):
    p = package(
        gauge=[{"name": "bad", "sql": "select raise_error('boom') as g, 1 as v"}, {"name": "good", "sql": "select 1 as v"}],
        summary=[{"name": "worse", "sql": "select 1 / (id - id) as v from range(3)", "objectives": [0.5]}],
    )
    run = run_package(spark, p)
    path = str(tmp_path / "samples")
    run.write(path)
    assert set(run.errors) == {"shop_bad", "shop_worse"}
    assert [(r.name, r.value) for r in flat(read_published(spark, path)).collect()] == [("shop_good", 1.0)]


def test_no_metrics_at_all(spark):
    run = run_package(spark, package())
    assert run.table.collect() == [] and run.errors == {}


def test_a_package_that_cannot_be_set_up_leaves_the_others(spark):
    broken = Package.from_dict({"name": "broken", "sources": [{"name": "x", "source": "select * from nowhere"}]})
    bad_macro = Package.from_dict({"name": "macro", "macros": [{"sql": "f(x) as x"}]})
    run = run_packages(spark, [broken, bad_macro, package(gauge=[{"name": "g", "sql": "select 1 as v"}])])
    assert set(run.errors) == {"package broken", "package macro"}
    assert values(run) == {("shop_g", ""): 1.0}


def test_config_file_with_packages_and_core(spark, tmp_path):
    (tmp_path / "a.yml").write_text(
        yaml.safe_dump(
            {
                "name": "first-one",
                "version": 1.0,
                "sources": [{"name": "numbers", "source": "select id from range(:n)"}],
                "metrics": {"counter": [{"name": "rows", "sql": "select id as v from numbers"}]},
            }
        )
    )
    (tmp_path / "config.yml").write_text(
        yaml.safe_dump(
            {
                "name": "ledger",
                "port": 8123,
                "globalLabels": [{"env": "test"}],
                "packages": [
                    {"package": "a.yml", "variables": {"n": 4}, "metricPrefix": "pre_"},
                    {"package": "missing.yml"},
                ],
                "macros": [{"sql": "twice(x int) as x * 2"}],
                "metrics": {"gauge": [{"name": "g", "sql": "select twice(count(*)) as v from numbers"}]},
            }
        )
    )
    run = run_config(spark, Config.from_yaml(str(tmp_path / "config.yml")), str(tmp_path))
    labels = 'env="test",instance_name="ledger"'
    assert values(run) == {("pre_first_one_rows", labels): 4.0, ("core_g", labels): 8.0}
    assert set(run.errors) == {"package missing.yml"}


def test_written_text_is_in_order(spark, tmp_path):
    p = package(
        gauge=[{"name": "z", "help": "Last\\one\nof all", "sql": "select * from values ('b', 2), ('a', 1.5) t(g, v)"}],
        histogram=[{"name": "h", "help": "H", "sql": "select cast(id as double) as v from range(12)", "buckets": [10, 2.5, 5][1:] + [10]}],
        summary=[{"name": "a", "sql": "select 5 as v", "objectives": [0.9, 0.5]}, {"name": "none", "sql": "select 1 as v where false"}],
        counter=[{"name": "c", "sql": "select id as v from range(2000000)"}],
    )
    path = str(tmp_path / "text")
    run = run_package(spark, p)
    write_text(run.samples, path)
    lines = [r.value for f in sorted((tmp_path / "text").glob("part-*")) for r in spark.read.text(str(f)).collect()]
    assert lines == [
        "# HELP shop_a ",
        "# TYPE shop_a summary",
        'shop_a{quantile="0.5"} 5',
        'shop_a{quantile="0.9"} 5',
        "shop_a_sum 5",
        "shop_a_count 1",
        "# HELP shop_c ",
        "# TYPE shop_c counter",
        "shop_c 2e+06",
        "# HELP shop_h H",
        "# TYPE shop_h histogram",
        'shop_h_bucket{le="2.5"} 3',
        'shop_h_bucket{le="5"} 6',
        'shop_h_bucket{le="10"} 11',
        'shop_h_bucket{le="+Inf"} 12',
        "shop_h_sum 66",
        "shop_h_count 12",
        "# HELP shop_z Last\\\\one\\nof all",
        "# TYPE shop_z gauge",
        'shop_z{g="a"} 1.5',
        'shop_z{g="b"} 2',
    ]
    assert render(run.samples).count() == len(lines)


def test_closed_runs_leave_no_checkpoints(spark):
    root = Path(urlparse(shared_dir(spark)).path)

    def files():
        return sum(p.is_file() for p in root.rglob("*"))

    summary = {"sql": "select id % 3 as k, id as v from range(90)", "stage": True, "objectives": [0.5]}
    packages = [package(name=n, summary=[{"name": "s", **summary}]) for n in ("a", "b")]
    before = files()
    for _ in range(10):
        with run_packages(spark, packages) as run:
            assert run.samples.count() == 18 and not run.errors
            assert len(run.checkpoints) == 4 and files() > before  # staged rows and brackets
    assert files() == before


def test_written_samples_replace_the_table_whole(spark, tmp_path):
    path = str(tmp_path / "samples")
    spark.range(2).createOrReplaceTempView("two_rows")
    counter = {"counter": [{"name": "seen", "sql": "select id % 2 as odd from two_rows"}]}
    for _ in range(2):
        run_package(spark, Package.from_dict({"name": "p", "metrics": counter})).write(path)
        assert read_published(spark, path).count() == 2
    assert sorted(f.name for f in (tmp_path / "samples").iterdir()) == ["data", "versions"]
