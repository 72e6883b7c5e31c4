"""Model price lookup and cost columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.schemas import MONEY, RATE_FIELDS, RATES, TOKENS, CostMode
from meterlake.session import stage

# Order of preference of a match.
EXACT, PARTIAL = 0, 6


def resolve_models(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """One row per distinct model of ``usage``: matched price key, match rank and rates.

    Preference: the name itself, then spelling variants in a fixed order, then
    a key that contains the name or is contained in it. Among several partial
    matches the longest key wins, then the smallest. Models without a match
    keep null rates.

    "Contains" is no equality, so a plain join would compare every model with
    every key. Here both directions become equi-joins on substrings: the
    substrings of a model that are as long as some key are looked up among the
    keys, and the model is looked up among the substrings of the keys (one best
    key kept per substring). The work grows with models + keys, not with their
    product. A name of any length is cut into pieces as long as the longest key; a key
    that it contains lies in two neighbouring pieces. Each such pair is a row of its own,
    so a name that is a whole text takes rows in proportion to its length, none of them large. No join is forced to broadcast; AQE does so when the measured size
    of a side is below the session's limit.
    """
    keys = prices.select(
        F.col("model").alias("_key"),
        F.struct(
            (-F.length("model")).alias("shorter"),
            F.col("model").alias("price_key"),
            *[F.col(rate) for rate in RATES],
        ).alias("_price"),
    )
    key_lengths = prices.agg(F.collect_set(F.length("model"))).scalar()
    piece = F.concat(F.lit("(?s)(.{1,"), F.greatest(F.coalesce(F.array_max("_lengths"), F.lit(1)), F.lit(1)).cast("string"), F.lit("})"))

    inside_keys = (
        keys.select(F.explode(F.expr(_ALL_SUBSTRINGS)).alias("_part"), "_price")
        .groupBy("_part")
        .agg(F.min("_price").alias("_inside"))
    )
    models = usage.select("model").distinct()
    probes = (
        models.join(inside_keys, models["model"] == inside_keys["_part"], "left")
        .withColumn("_lengths", key_lengths)
        .withColumn("_pieces", F.regexp_extract_all("model", piece))
        .select(F.expr(_ID).alias("_id"), "_lengths", F.inline(F.expr(_WINDOWS)))
        .select("_id", "_inside", F.col("_model").alias("model"), F.explode(F.expr(_PROBES)).alias("_probe"))
        .select("_id", F.when(F.col("_probe.rank") == EXACT, F.col("model")).alias("model"), "_inside", "_probe.rank", F.col("_probe.name").alias("_name"))
    )
    # of the probes that are no key only the name itself goes on, for models without a match
    looked_up = probes.join(keys, F.col("_name") == F.col("_key"), "left").where(F.col("_key").isNotNull() | (F.col("rank") == EXACT))
    candidates = looked_up.select(
        "_id",
        "model",
        _match(F.col("rank"), F.col("_price")).alias("_forward"),
        _match(F.lit(PARTIAL), F.col("_inside")).alias("_backward"),
    )
    best = candidates.groupBy("_id").agg(F.max("model").alias("model"), F.min(F.least("_forward", "_backward")).alias("_best"))
    return best.select(
        "model",
        F.col("_best.price.price_key").alias("price_key"),
        F.col("_best.rank").alias("match_rank"),
        *[F.col(f"_best.price.{rate}").alias(rate) for rate in RATES],
    )


def _match(rank: Column, price: Column) -> Column:
    return F.when(price.isNotNull(), F.struct(rank.alias("rank"), price.alias("price")))


def _substrings(text: str, length: str) -> str:
    """SQL: all parts of ``text`` that are ``length`` characters long."""
    return f"""if(length({text}) >= {length},
        transform(sequence(1, length({text}) - {length} + 1), start -> substr({text}, start, {length})), array())"""


_ALL_SUBSTRINGS = f"""
    array_distinct(flatten(transform(sequence(0, length(_key)), size -> {_substrings('_key', 'size')})))"""

# Stands for a model in the rows of its pieces, of which only the first has the name.
_ID = "named_struct('size', length(model), 'name', if(length(model) <= 200, model, sha2(model, 256)))"

# Neighbouring pieces of a name; the name itself and its match inside a key go with the first.
_WINDOWS = """
    transform(
        if(size(_pieces) = 0, array(''), _pieces),
        (piece, i) -> named_struct(
            '_window', concat(piece, coalesce(get(_pieces, i + 1), '')),
            '_model', if(i = 0, model, NULL),
            '_inside', if(i = 0, _inside, NULL)))"""

# All names to look up for a row: with the model, its variants in their
# fixed order, then the substrings of the window that are as long as some key.
_PROBES = f"""
    concat(
        filter(array(
            named_struct('rank', {EXACT}, 'name', _model),
            named_struct('rank', 1, 'name', concat('anthropic/', _model)),
            named_struct('rank', 2, 'name', concat('claude-', _model)),
            named_struct('rank', 3, 'name', replace(_model, 'claude-3-', 'claude-3.')),
            named_struct('rank', 4, 'name', replace(_model, 'claude-3.', 'claude-3-'))), variant -> variant.name IS NOT NULL),
        transform(
            array_distinct(flatten(transform(_lengths, size -> {_substrings('_window', 'size')}))),
            part -> named_struct('rank', {PARTIAL}, 'name', part)))"""


def unknown_models(usage: DataFrame, prices: DataFrame) -> DataFrame:
    """Models that no price matches; their computed cost is zero."""
    return resolve_models(usage, prices).where(F.col("price_key").isNull()).select("model")


def price_meters(
    meters: DataFrame, usage: DataFrame, prices: DataFrame, mode: CostMode | str = CostMode.AUTO, strict: bool = True
) -> DataFrame:
    """Adds ``cost`` to compacted usage (see ``meters.compact``).

    ``usage`` supplies the model names: reading that one column again is
    cheaper than computing the meters twice. ``strict`` makes the two modes
    that need a price or a logged cost fail where it is missing; otherwise the
    missing part counts as null.

    The resolved prices are written first, so the planner knows their size: it
    broadcasts them if they are small, and the meters then stay where they are.
    Beyond ``spark.sql.autoBroadcastJoinThreshold`` the join shuffles, and AQE
    splits the partition of a hot model.
    """
    mode = CostMode.parse(mode)
    if mode is CostMode.DISPLAY:
        complete = F.col("n_logged") == F.col("n_entries")
        cost = F.coalesce(F.col("logged_cost"), F.lit(0)).cast(MONEY)
        return meters.withColumn("cost", _required(complete, cost, "'no logged cost in display mode'") if strict else cost)
    priced = meters.join(stage(resolve_models(usage, prices)), "model", "left")
    if mode is CostMode.AUTO:
        computed = tokens_cost({name: F.col(f"unpriced_{name}") for name in TOKENS})
        cost = (F.coalesce(F.col("logged_cost"), F.lit(0)).cast(MONEY) + computed).cast(MONEY)
    else:
        cost = tokens_cost({name: F.col(name) for name in TOKENS})
        known = F.col("price_key").isNotNull()
        cost = _required(known, cost, "concat('unknown model: ', model)") if strict else F.when(known, cost)
    return priced.withColumn("cost", cost).drop("price_key", "match_rank", *RATES)


def with_cost(
    usage: DataFrame, prices: DataFrame, mode: CostMode | str = CostMode.AUTO, strict: bool = True
) -> DataFrame:
    """Adds ``cost`` to every single entry (decimal; for entry-level output only)."""
    mode = CostMode.parse(mode)
    logged = F.col("total_cost").cast(MONEY)
    if mode is CostMode.DISPLAY:
        known = logged.isNotNull()
        return usage.withColumn("cost", _required(known, logged, "'no logged cost in display mode'") if strict else logged)
    priced = join_models(usage, resolve_models(usage, prices))
    computed = tokens_cost({name: F.col(name) for name in TOKENS})
    if mode is CostMode.AUTO:
        cost = F.coalesce(logged, computed)
    else:
        known = F.col("price_key").isNotNull()
        cost = _required(known, computed, "concat('unknown model: ', model)") if strict else F.when(known, computed)
    return priced.withColumn("cost", cost).select(*usage.columns, "cost")


def join_models(usage: DataFrame, resolved: DataFrame) -> DataFrame:
    """Left join of entries with their resolved prices.

    The resolved table is written first, so the planner knows its size: within
    ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast and the entries
    stay where they are. Beyond it the join shuffles, and AQE splits the
    partition of a model with very many entries.
    """
    return usage.join(stage(resolved), "model", "left")


def tokens_cost(tokens: dict[str, Column]) -> Column:
    """Sum of tokens x rate; a missing rate or price adds nothing."""
    parts = [
        F.coalesce((tokens[name].cast("decimal(19,0)") * F.col(rate)).cast(MONEY), F.lit(0).cast(MONEY))
        for name, rate in RATE_FIELDS.items()
    ]
    return sum(parts[1:], parts[0]).cast(MONEY)


def _required(present: Column, value: Column, message: str) -> Column:
    return F.when(present, value).otherwise(F.raise_error(F.expr(message)))
