import pytest

from metricspark import catalog
from metricspark.defs import Config, MacroDef, MetricDef, Package, SourceDef, merge_metrics
from metricspark.functions.macros import macro_sql
from metricspark.plans.package import named_metrics


def test_source_defaults():
    s = SourceDef.from_dict({"name": "s", "source": "select 1"})
    assert (s.type, s.materialize, s.refresh_interval_seconds) == ("sql", False, 0)


def test_merge_keeps_kinds_and_order():
    mine = [MetricDef("gauge", "stock", ""), MetricDef("counter", "returns", "")]
    theirs = [MetricDef("histogram", "weight", ""), MetricDef("gauge", "price", ""), MetricDef("summary", "wait", "")]
    assert [m.name for m in merge_metrics(mine, theirs)] == ["stock", "price", "returns", "wait", "weight"]


@pytest.mark.parametrize(
    "labels", [{"region": "north", "team": "$OWNER_TEAM"}, [{"region": "north"}, {"team": "$OWNER_TEAM"}]]
)
def test_config_labels(monkeypatch, labels):
    monkeypatch.setenv("OWNER_TEAM", "billing")
    config = Config.from_dict({"name": "ledger", "globalLabels": labels, "instanceLabel": "job"})
    assert config.labels() == {"region": "north", "team": "billing", "job": "ledger"}


def test_empty_and_unset_labels(monkeypatch):
    monkeypatch.delenv("NOT_SET", raising=False)
    config = Config.from_dict({"name": "n", "globalLabels": {"a": "", "b": None, "c": "$NOT_SET"}})
    assert config.labels() == {"instance_name": "n", "a": "", "b": "", "c": ""}


def test_package_file():
    p = catalog.load("sales")
    assert (p.name, p.version) == ("sales", "2")
    assert p.sources[0].name == "ordered" and p.sources[0].materialize
    assert [m.kind for m in p.metrics] == ["gauge"] * 6 + ["counter", "summary", "histogram"]
    assert len(p.metrics[-1].buckets) == 18 and len(p.metrics[-2].objectives) == 6


def test_shipped_metrics_are_complete():
    assert sum(len(catalog.load(n).metrics) for n in catalog.NAMES) == 33


@pytest.mark.parametrize(
    "sql, made",
    [
        ("vat() as (0.19)", "vat() return (0.19)"),
        ("newest() AS (SELECT max(ts) FROM events);", "newest() return (SELECT max(ts) FROM events);"),
        ("f(x int) returns int return cast(x as int)", "f(x int) returns int return cast(x as int)"),
        ("f(x int) return x + 1", "f(x int) return x + 1"),
        ("f(x decimal(10,2)) as x", "f(x decimal(10,2)) return x"),
        ("t(x int) as table select x", "t(x int) returns table return select x"),
    ],
)
def test_macro_sql(sql, made):
    assert macro_sql(MacroDef(sql)) == f"create or replace temporary function {made}"


def test_repeated_names():
    first, last = MetricDef("gauge", "m", "select 1"), MetricDef("gauge", "m", "select 2")
    assert named_metrics(Package("p", metrics=(first, last))) == ([(last, "p_m")], {})
    kept, errors = named_metrics(Package("p", metrics=(first, MetricDef("counter", "m", "select 1"))))
    assert kept == [(first, "p_m")] and list(errors) == ["counter p_m of p"]
    assert named_metrics(Package("p", metrics=(first,)), {"p_m": "a gauge of q"})[0] == []


def test_disabled_metrics_are_left_out():
    assert named_metrics(Package("p", metrics=(MetricDef("gauge", "m", "", enabled=False),))) == ([], {})
