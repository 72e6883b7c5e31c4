import itertools
import random
from datetime import datetime
from decimal import Decimal

import pytest
from pyspark.errors import SparkRuntimeException
from pyspark.sql import functions as F

from meterlake import daily, load_prices, merge_prices, resolve_models, unknown_models, with_cost
from meterlake.schemas import PRICES, RATES, TOKENS, CostMode
from tests import brute

TS = datetime(2024, 1, 15, 10)


def entry(model, tokens=(1000, 500, 100, 50), cost=None, **more):
    return {"ts": TS, "model": model, "total_cost": cost, **dict(zip(TOKENS, tokens)), **more}


def price_table(spark, **models):
    rows = [(name, *rates) for name, rates in models.items()]
    text = spark.createDataFrame(rows, "model string, " + ", ".join(f"{r} double" for r in RATES))
    return text.select("model", *[F.col(r).cast("decimal(18,14)") for r in RATES])


def test_cost_formula(spark, make_usage):
    prices = price_table(spark, m=(1e-5, 2e-5, 1.5e-5, 1e-6), half=(1e-5, None, None, None))
    usage = make_usage(entry("m"), entry("half"), entry("nothing"))
    costs = {r.model: float(r.cost) for r in with_cost(usage, prices).collect()}
    assert costs == {"m": 0.02155, "half": 0.01, "nothing": 0.0}


def test_modes(spark, make_usage, prices):
    usage = make_usage(entry("claude-3-opus", cost=9.0), entry("claude-3-opus"), entry("no such model"))
    computed = 1000 * 15e-6 + 500 * 75e-6 + 100 * 18.75e-6 + 50 * 1.5e-6
    by_mode = {
        mode: [None if r.cost is None else float(r.cost) for r in with_cost(usage, prices, mode, strict=False).orderBy("_ord").collect()]
        for mode in CostMode
    }
    assert by_mode[CostMode.AUTO] == [9.0, pytest.approx(computed), 0.0]
    assert by_mode[CostMode.CALCULATE] == [pytest.approx(computed), pytest.approx(computed), None]
    assert by_mode[CostMode.DISPLAY] == [9.0, None, None]
    assert daily(usage, prices).first().total_cost == pytest.approx(9.0 + computed)
    known = usage.where(F.col("model") == "claude-3-opus")
    assert daily(known, prices, "calculate").first().total_cost == pytest.approx(2 * computed)
    assert daily(known.where("total_cost is not null"), prices, "display").first().total_cost == 9.0


def test_strict_modes_fail(make_usage, prices):
    usage = make_usage(entry("claude-3-opus", cost=9.0), entry("no such model"))
    for mode, message in (("calculate", "unknown model: no such model"), ("display", "no logged cost")):
        for run in (lambda: daily(usage, prices, mode).collect(), lambda: with_cost(usage, prices, mode).collect()):
            with pytest.raises(SparkRuntimeException, match=message):
                run()
    with pytest.raises(ValueError):
        CostMode.parse("cheap")
    assert CostMode.parse("AUTO") is CostMode.AUTO


def test_match_order(make_usage, prices):
    wanted = {
        "claude-3-opus": "claude-3-opus", "claude-3-5-sonnet": "claude-3.5-sonnet", "3-haiku": "claude-3-haiku",
        "claude-3-opus-20240229": "claude-3-opus", "sonnet-4.5": "claude-sonnet-4.5", "mystery": None,
        "instant": "claude-instant-1.2", "claude-2.1-long": "claude-2.1",
    }
    rows = resolve_models(make_usage(*[entry(m) for m in wanted]), prices).collect()
    assert {r.model: r.price_key for r in rows} == wanted


def test_random_matches(spark, make_usage):
    """Substring joins find the same key as comparing every model with every key."""
    rng = random.Random(7)
    words = ["claude", "3", "opus", "anthropic/", "-", ".", "a", "b", "sonnet"]

    def name():
        return "".join(rng.choice(words) for _ in range(rng.randint(0, 4)))

    keys = {name() for _ in range(40)}
    models = {name() for _ in range(150)} | {"", "a" * 300 + "opus"}
    prices = price_table(spark, **{key: (float(n), None, None, None) for n, key in enumerate(sorted(keys))})
    rows = resolve_models(make_usage(*[entry(m) for m in models]), prices).collect()
    assert {r.model: r.price_key for r in rows} == {m: brute.best_price(m, keys) for m in models}


def test_unknown_models(make_usage, prices):
    usage = make_usage(entry("mystery"), entry("mystery"), entry("claude-2"))
    assert [r.model for r in unknown_models(usage, prices).collect()] == ["mystery"]


def test_cost_without_broadcast_and_with_a_hot_model(spark, make_usage, prices):
    usage = make_usage(*[entry(f"claude-3-opus-{n % 9}", session_id=f"s{n}") for n in range(60)], entry("mystery"))
    expected = sorted((r.session_id, r.cost) for r in with_cost(usage, prices).collect())
    saved = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        assert sorted((r.session_id, r.cost) for r in with_cost(usage, prices).collect()) == expected
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", saved)
    assert len(expected) == 61


def test_load_and_merge(spark, put, make_usage):
    root = put("prices.json", {
        "m1": {"input_cost_per_token": 1e-6, "output_cost_per_token": None, "mode": "chat"},
        "m2": {"input_cost_per_token": 2.5e-07, "cache_read_input_token_cost": 3},
        "bad": {"input_cost_per_token": "free"}, "text": "x", "number": 3,
    })
    online = load_prices(spark, root + "/prices.json")
    found = {r.model: [None if v is None else float(v) for v in r[1:]] for r in online.collect()}
    assert found == {"m1": [1e-6, None, None, None], "m2": [2.5e-7, None, None, 3.0]}
    embedded = price_table(spark, m1=(9.0, 9.0, 9.0, 9.0), m3=(1.0, None, None, None))
    merged = {r.model: float(r.input_cost_per_token) for r in merge_prices(online, embedded).collect()}
    assert merged == {"m1": 1e-6, "m2": 2.5e-7, "m3": 1.0}
    assert online.schema.fieldNames() == PRICES.fieldNames()


def test_names_that_are_whole_texts(spark, prices, make_usage):
    """Keys are found wherever they lie in a name of many thousand characters, and every such name once."""
    filler = "lorem é\n" * 5_000
    names = {
        filler + "claude-2.1" + filler: "claude-2.1",
        filler + "claude-2": "claude-2",
        "claude-3-opus" + filler + "claude-sonnet-4-5-20250929": "claude-sonnet-4-5-20250929",
        filler + "claude-" + filler: None,
        "": "claude-sonnet-4-5-20250929",
        "laude-2": "claude-2.1",
    }
    found = resolve_models(make_usage(*[entry(name) for name in names for _ in range(2)]), prices)
    got = {r["model"]: r["price_key"] for r in found.select("model", "price_key").collect()}
    assert got == names and found.count() == len(names)


def test_windows_find_what_every_pair_finds(spark, make_usage):
    keys = ["ab", "abcab", "b", "caba", "zz", "abababab"]
    rates = [Decimal("0.1")] * 4
    prices = spark.createDataFrame([(k, *rates) for k in keys], PRICES)
    names = ["".join(x) for n in range(1, 5) for x in itertools.product("abcz", repeat=n)] + ["zc" * 9 + "abcab" + "c" * k for k in range(20)]

    def best(name):
        if name in keys:
            return name
        near = [k for k in keys if k in name or name in k]
        return min(near, key=lambda k: (-len(k), k)) if near else None

    found = resolve_models(make_usage(*[entry(name) for name in names]), prices)
    assert {r["model"]: r["price_key"] for r in found.collect()} == {name: best(name) for name in names}
