"""Billing blocks: anchored spans of fixed length over a stream of entries.

Rule: a block starts at the full hour of its first entry. An entry later than
``start + duration`` opens the next block. (A pause longer than the duration
does not change where blocks start, because the last entry is never before the
block start; it only adds a gap row.)

Read literally this is a fold over all entries in time order, in one task. It
does not have to be. A block start is always a full hour, so whether an entry
lies beyond ``start + duration`` depends only on its hour and on whether it is
beyond the duration's remainder inside that hour. Entries therefore fall into
at most two *units* per hour:

* duration of an hour or more: the fold runs over the distinct units of a key,
  at most 2 x 24 x days of them, however many entries there are.
* duration below an hour: a block never reaches into the next hour. The entries
  of an hour up to the duration form one block, and each later entry of that
  hour is a block of its own. No fold is needed.

``keys`` are the columns that have a timeline each; none means one timeline
for all entries.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import date, datetime, time, timedelta, timezone
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from meterlake.functions.args import duration_micros, parse_date, parse_instant, parse_token_limit
from meterlake.functions.time import HOUR_MICROS, hour_number, instant, micros_between
from meterlake.operators.meters import compact, sorted_set, summed
from meterlake.operators.pricing import price_meters
from meterlake.schemas import MONEY, TOKENS, CostMode

DEFAULT_HOURS = 5.0

#: Approximate token budget of a block, the base of percentage limits (fixed value).
APPROX_MAX_TOKENS = 10_000_000.0

BLOCK_COLUMNS = [
    "start_time", "end_time", "actual_start_time", "actual_end_time", "session_count", *TOKENS, "total_tokens",
    "total_cost", "models_used", "projects_used", "is_active", "is_gap",
]


@dataclass(frozen=True)
class BlockRule:
    hours: float = DEFAULT_HOURS
    keys: tuple[str, ...] = ()
    strict: bool = True

    @property
    def micros(self) -> int:
        return duration_micros(self.hours)

    @property
    def whole_hours(self) -> int:
        return self.micros // HOUR_MICROS

    @property
    def below_an_hour(self) -> bool:
        return self.micros < HOUR_MICROS

    def unit(self, ts: Column) -> Column:
        """Twice the hour number, plus one beyond the duration's remainder in that hour."""
        if not self.strict:
            return hour_number(ts) * 2
        inside = F.pmod(F.unix_micros(ts), F.lit(HOUR_MICROS))
        return hour_number(ts) * 2 + (inside > self.micros % HOUR_MICROS).cast("bigint")

    def compact_keys(self, *more: str) -> dict[str, Column | str]:
        """Keys to compact entries by before blocks are assigned."""
        result: dict[str, Column | str] = {key: key for key in self.keys}
        result["_unit"] = self.unit(F.col("ts"))
        if self.below_an_hour:
            late = F.pmod(self.unit(F.col("ts")), F.lit(2)) == 1
            result["_entry"] = F.when(late, F.struct("_file", "_ord"))
        return {**result, **{name: name for name in more}}

    @property
    def block_id(self) -> list[str]:
        return [*self.keys, "_start_hour", *(["_entry"] if self.below_an_hour else [])]


def assign_blocks(rows: DataFrame, units: DataFrame, rule: BlockRule) -> DataFrame:
    """Adds ``_start_hour``, the hour number at which the block of a row starts.

    ``rows`` and ``units`` have ``_unit`` and the rule's keys. ``units`` may be
    a narrower scan of the same data; only its distinct values matter.
    """
    if rule.below_an_hour:
        return rows.withColumn("_start_hour", _hour_of(F.col("_unit")))
    mapping = fold_units(units, rule).select(
        *[F.col(key).alias(f"_b_{key}") for key in rule.keys], F.col("_unit").alias("_b_unit"), "_start_hour"
    )
    same = [rows[key].eqNullSafe(mapping[f"_b_{key}"]) for key in rule.keys]
    on = reduce(lambda a, b: a & b, same, rows["_unit"] == mapping["_b_unit"])
    return rows.join(mapping, on).drop("_b_unit", *[f"_b_{key}" for key in rule.keys])


def _hour_of(unit: Column) -> Column:
    return F.call_function("div", unit - F.pmod(unit, F.lit(2)), F.lit(2))


def fold_units(units: DataFrame, rule: BlockRule) -> DataFrame:
    """Maps every distinct unit of a key to the start hour of its block.

    Per key the sorted units are one array (two entries per hour of the
    calendar at most, whatever the number of rows) that ``aggregate`` walks
    once, noting the position of every unit that opens a block. An array is
    copied whenever one is added, so positions are noted in parts of 256.
    """
    reach = 2 * rule.whole_hours - (0 if rule.strict else 1)
    distinct = units.select(*rule.keys, "_unit").distinct()
    per_key = distinct.groupBy(*rule.keys).agg(F.array_sort(F.collect_set("_unit")).alias("_units"))

    opened = per_key.withColumn("_openers", F.expr(f"""
        aggregate(
            _units,
            named_struct('position', 0, 'reach', cast(NULL AS bigint), 'openers', cast(array() AS array<int>),
                         'full', cast(array() AS array<array<int>>)),
            (state, unit) -> named_struct(
                'position', state.position + 1,
                'reach', if(coalesce(unit <= state.reach, false), state.reach, unit - pmod(unit, 2) + {reach}L),
                'openers', if(coalesce(unit <= state.reach, false), state.openers,
                              concat(if(size(state.openers) < 256, state.openers, cast(array() AS array<int>)), array(state.position + 1))),
                'full', if(coalesce(unit <= state.reach, false) OR size(state.openers) < 256, state.full,
                           concat(state.full, array(state.openers)))),
            state -> flatten(concat(state.full, array(state.openers))))"""))
    members = F.expr("""
        transform(_openers, (position, i) -> named_struct(
            'start_hour', (element_at(_units, position) - pmod(element_at(_units, position), 2)) div 2,
            'members', slice(_units, position, coalesce(get(_openers, i + 1), size(_units) + 1) - position)))""")
    blocks = opened.select(*rule.keys, F.explode(members).alias("_block"))
    return blocks.select(
        *rule.keys, F.col("_block.start_hour").alias("_start_hour"), F.explode("_block.members").alias("_unit")
    )


def _block_times(rule: BlockRule) -> list[Column]:
    start = F.timestamp_micros(F.col("_start_hour") * HOUR_MICROS)
    end = F.timestamp_micros(F.col("_start_hour") * HOUR_MICROS + rule.micros)
    return [start.alias("start_time"), end.alias("end_time")]


def billing_blocks(
    usage: DataFrame,
    prices: DataFrame,
    as_of: str | datetime,
    mode: CostMode | str = CostMode.AUTO,
    hours: float = DEFAULT_HOURS,
    keys: tuple[str, ...] | list[str] = (),
    strict: bool = True,
    project_sets: bool = True,
) -> DataFrame:
    """Blocks and gaps of every timeline, with sums, models, projects and activity.

    Sessions of a block are rows of ``block_sessions``; a block row only counts
    them, because a block may hold any number of sessions. So it is with projects
    where they are many: without ``project_sets``, ``projects_used`` is null, sums need no
    project key, and ``block_projects`` has the projects as rows.
    """
    rule = BlockRule(hours, tuple(keys))
    unit = rule.unit(F.col("ts")).alias("_unit")
    if not project_sets:
        meters = compact(usage, **rule.compact_keys())
        if "project" not in rule.keys:
            meters = meters.withColumn("project", F.lit(None).cast("string"))
        blocks = _blocks_of(meters, usage, prices, mode, strict, rule, as_of, unit)
        return blocks.withColumn("projects_used", F.lit(None).cast("array<string>"))
    meters = compact(usage, **rule.compact_keys("project"))
    return _blocks_of(meters, usage, prices, mode, strict, rule, as_of, unit)


def _blocks_of(meters, usage, prices, mode, strict, rule: BlockRule, as_of, unit: Column) -> DataFrame:
    priced = price_meters(meters, usage, prices, mode, strict)
    members = usage.select(*dict.fromkeys([*rule.keys, "session_id"]), unit)
    return blocks_from_meters(priced, meters, members, usage.select(*rule.keys, unit), rule, as_of)


def blocks_from_meters(
    priced: DataFrame, meters: DataFrame, members: DataFrame, units: DataFrame, rule: BlockRule, as_of: str | datetime
) -> DataFrame:
    """Blocks from priced meters. ``members`` has the sessions of each unit, ``units`` the units themselves."""
    blocks = roll_up_blocks(assign_blocks(priced, units, rule), rule)
    blocks = with_activity(with_session_count(blocks, members, units, rule), rule, as_of)
    if rule.below_an_hour:
        return blocks.unionByName(_gap_rows(entry_gaps(meters, rule), rule))
    return with_gap_rows(blocks, rule)


def roll_up_blocks(priced: DataFrame, rule: BlockRule) -> DataFrame:
    return priced.groupBy(*rule.block_id).agg(
        F.min("first_ts").alias("actual_start_time"),
        F.max("last_ts").alias("actual_end_time"),
        *summed(),
        sorted_set("model").alias("models_used"),
        sorted_set("project").alias("projects_used"),
    )


def with_session_count(blocks: DataFrame, members: DataFrame, units: DataFrame, rule: BlockRule) -> DataFrame:
    """Distinct sessions per block.

    Counted apart from the sums: only (unit, session) pairs move for it, and
    the sums need no session key, which would keep them from getting small. An
    entry that is a block of its own has one session, as has a session's timeline.
    """
    if "session_id" in rule.keys:
        return blocks.withColumn("session_count", F.lit(1).cast("bigint"))
    pairs = members.select(*rule.keys, "_unit", "session_id")
    if rule.below_an_hour:
        pairs = pairs.where(F.pmod("_unit", F.lit(2)) == 0)
    counts = (
        assign_blocks(pairs.distinct(), units, rule)
        .groupBy(*rule.keys, "_start_hour")
        .agg(F.count_distinct("session_id").alias("session_count"))
        .select(*[F.col(key).alias(f"_c_{key}") for key in rule.keys], F.col("_start_hour").alias("_c_hour"), "session_count")
    )
    on = blocks["_start_hour"] == counts["_c_hour"]
    for key in rule.keys:
        on = on & blocks[key].eqNullSafe(counts[f"_c_{key}"])
    if not rule.below_an_hour:
        return blocks.join(counts, on)
    counted = blocks.join(counts, on & blocks["_entry"].isNull(), "left")
    return counted.withColumn("session_count", F.coalesce("session_count", F.lit(1)))


def with_activity(blocks: DataFrame, rule: BlockRule, as_of: str | datetime) -> DataFrame:
    now = instant(parse_instant(as_of))
    active = (micros_between(F.col("actual_end_time"), now) < rule.micros) & (now < F.col("end_time"))
    return (
        blocks.select("*", *_block_times(rule))
        .withColumn("is_active", active)
        .withColumn("is_gap", F.lit(False))
        .select(*rule.keys, *BLOCK_COLUMNS)
    )


def with_gap_rows(blocks: DataFrame, rule: BlockRule) -> DataFrame:
    """Adds a row for each pause longer than the duration between two blocks.

    The window runs over block rows; a timeline has at most one per hour.
    """
    in_order = Window.partitionBy(*rule.keys).orderBy("start_time")
    previous = F.lag("actual_end_time").over(in_order)
    block = F.struct(*BLOCK_COLUMNS)
    gap = F.when(
        micros_between(F.col("_previous"), F.col("actual_start_time")) > rule.micros,
        _gap(F.col("_previous"), F.col("actual_start_time"), rule),
    )
    rows = F.filter(F.array(gap, block), lambda row: row.isNotNull())
    return (
        blocks.withColumn("_previous", previous)
        .select(*rule.keys, F.explode(rows).alias("_row"))
        .select(*rule.keys, "_row.*")
    )


def _gap(previous: Column, following: Column, rule: BlockRule) -> Column:
    values = {
        "start_time": F.timestamp_micros(F.unix_micros(previous) + rule.micros),
        "end_time": following,
        "actual_start_time": F.lit(None).cast("timestamp"),
        "actual_end_time": F.lit(None).cast("timestamp"),
        "total_cost": F.lit(0.0),
        "models_used": F.array().cast("array<string>"),
        "projects_used": F.array().cast("array<string>"),
        "is_active": F.lit(False),
        "is_gap": F.lit(True),
    }
    zero = F.lit(0).cast("bigint")
    return F.struct(*[values.get(name, zero).alias(name) for name in BLOCK_COLUMNS])


def _gap_rows(pauses: DataFrame, rule: BlockRule) -> DataFrame:
    gap = _gap(F.col("_previous"), F.col("_following"), rule)
    return pauses.select(*rule.keys, gap.alias("_row")).select(*rule.keys, "_row.*")


def entry_gaps(meters: DataFrame, rule: BlockRule) -> DataFrame:
    """Neighbouring entry times of a timeline that are more than the duration apart.

    Needed for durations below an hour, where a pause can lie inside an hour.
    First and last times of the meters are enough: entries that were summed
    together lie within one duration of each other. Neighbours are found on three levels, so that no window partition grows
    with the data: distinct times inside a second (at most 10^6), then seconds
    inside an hour (at most 3600), then hours of a timeline.
    """
    ends = F.explode(F.array(F.unix_micros("first_ts"), F.unix_micros("last_ts"))).alias("_t")
    times = meters.select(*rule.keys, ends).distinct()
    times = times.withColumn("_second", F.call_function("div", F.col("_t") - F.pmod("_t", F.lit(1_000_000)), F.lit(1_000_000)))
    per_second = Window.partitionBy(*rule.keys, "_second").orderBy("_t")
    inner = times.select(*rule.keys, F.lag("_t").over(per_second).alias("_from"), F.col("_t").alias("_to"))

    seconds = times.groupBy(*rule.keys, "_second").agg(F.min("_t").alias("_low"), F.max("_t").alias("_high"))
    seconds = seconds.withColumn("_hour", F.call_function("div", F.col("_second") - F.pmod("_second", F.lit(3600)), F.lit(3600)))
    per_hour = Window.partitionBy(*rule.keys, "_hour").orderBy("_second")
    middle = seconds.select(*rule.keys, F.lag("_high").over(per_hour).alias("_from"), F.col("_low").alias("_to"))

    hours = seconds.groupBy(*rule.keys, "_hour").agg(F.min("_low").alias("_low"), F.max("_high").alias("_high"))
    per_key = Window.partitionBy(*rule.keys).orderBy("_hour")
    outer = hours.select(*rule.keys, F.lag("_high").over(per_key).alias("_from"), F.col("_low").alias("_to"))

    pauses = inner.unionByName(middle).unionByName(outer).where(F.col("_to") - F.col("_from") > rule.micros)
    return pauses.select(
        *rule.keys, F.timestamp_micros("_from").alias("_previous"), F.timestamp_micros("_to").alias("_following")
    )


def block_sessions(
    usage: DataFrame,
    prices: DataFrame,
    mode: CostMode | str = CostMode.AUTO,
    hours: float = DEFAULT_HOURS,
    keys: tuple[str, ...] | list[str] = (),
    strict: bool = True,
) -> DataFrame:
    """One row per block and session; the model is the most frequent one (tie: smallest name)."""
    rule = BlockRule(hours, tuple(keys))
    meters = compact(usage, **rule.compact_keys("session_id"))
    units = usage.select(*rule.keys, rule.unit(F.col("ts")).alias("_unit"))
    priced = price_meters(meters, usage, prices, mode, strict)
    per_model = assign_blocks(priced, units, rule).groupBy(*rule.block_id, "session_id", "model").agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        *[F.sum(name).alias(name) for name in TOKENS],
        F.sum("cost").cast(MONEY).alias("cost"),
        F.sum("n_entries").alias("n_entries"),
    )
    rows = per_model.groupBy(*rule.block_id, "session_id").agg(
        F.min("first_ts").alias("start_time"),
        F.max("last_ts").alias("end_time"),
        *summed(),
        F.min_by("model", F.struct(-F.col("n_entries"), "model")).alias("model"),
    )
    start, _ = _block_times(rule)
    return rows.select(
        *rule.keys, start.alias("block_start"), "session_id", "start_time", "end_time", *TOKENS, "total_tokens",
        "total_cost", "model",
    )


def block_projects(usage: DataFrame, hours: float = DEFAULT_HOURS, keys: tuple[str, ...] | list[str] = ()) -> DataFrame:
    """(keys, block_start, project): one row per block and project that occurs in it, however many they are.

    Blocks below an hour are told apart by their entries, not by their start; they have no row form.
    """
    rule = BlockRule(hours, tuple(keys))
    if rule.below_an_hour:
        raise ValueError("projects of blocks below an hour are in projects_used only")
    unit = rule.unit(F.col("ts")).alias("_unit")
    pairs = usage.where(F.col("project").isNotNull()).select(*dict.fromkeys([*rule.keys, "project"]), unit).distinct()
    assigned = assign_blocks(pairs, usage.select(*rule.keys, unit), rule)
    start, _ = _block_times(rule)
    return assigned.select(*[key for key in rule.keys if key != "project"], start.alias("block_start"), "project").distinct()


def blocks_from_sessions(sessions: DataFrame, as_of: str | datetime, hours: int = 5) -> DataFrame:
    """Blocks over whole sessions in order of their start (the older rule).

    A session belongs to the block of its start; one that starts exactly at the
    end of a block opens the next. No gaps and no projects. Blocks of this rule
    last whole hours.
    """
    if hours != int(hours) or hours < 1:
        raise ValueError(f"blocks of sessions last whole hours, not {hours}")
    rule = BlockRule(hours, strict=False)
    rows = sessions.withColumn("_unit", rule.unit(F.col("start_time")))
    assigned = assign_blocks(rows, rows, rule).withColumn("_cost", F.col("total_cost").cast(MONEY))
    grouped = assigned.groupBy("_start_hour").agg(
        F.min("start_time").alias("actual_start_time"),
        F.max_by("end_time", F.struct("start_time", "session_id")).alias("actual_end_time"),
        F.count("*").alias("session_count"),
        *summed("_cost"),
        sorted_set("model").alias("models_used"),
    )
    return (
        grouped.select(*grouped.columns, *_block_times(rule))
        .withColumn("projects_used", F.array().cast("array<string>"))
        .withColumn("is_active", instant(parse_instant(as_of)) < F.col("end_time"))
        .withColumn("is_gap", F.lit(False))
        .select(*BLOCK_COLUMNS)
    )


def filter_blocks(
    blocks: DataFrame,
    as_of: str | datetime,
    since: date | str | None = None,
    until: date | str | None = None,
    project: str | None = None,
    active: bool = False,
    recent: bool = False,
    projects: DataFrame | None = None,
) -> DataFrame:
    """Block filters; they choose among finished blocks, so they never move a boundary.

    Dates are those of the block start in UTC. A project keeps every block in
    which it occurs, with the tokens of all projects; gaps have none and drop out.
    With ``projects`` (``block_projects`` of the same usage, hours and keys) that is a semi-join
    on the blocks of the project; otherwise ``projects_used`` is searched.
    """
    if since := parse_date(since):
        blocks = blocks.where(F.col("start_time") >= instant(datetime.combine(since, time(), timezone.utc)))
    if until := parse_date(until):
        blocks = blocks.where(F.col("start_time") <= instant(datetime.combine(until, time(23, 59, 59), timezone.utc)))
    if project is not None and projects is not None:
        chosen = projects.where(F.col("project") == project)
        chosen = chosen.select(*[F.col(name).alias(f"_p_{name}") for name in chosen.columns])
        shared = [name for name in projects.columns if name in blocks.columns]
        same = [blocks[name].eqNullSafe(chosen[f"_p_{name}"]) for name in shared]
        on = reduce(lambda a, b: a & b, same, blocks["start_time"] == chosen["_p_block_start"])
        blocks = blocks.where(~F.col("is_gap")).join(chosen, on, "left_semi")
    elif project is not None:
        blocks = blocks.where(F.array_contains("projects_used", project))
    if active:
        blocks = blocks.where("is_active")
    if recent:
        blocks = blocks.where(F.col("start_time") > instant(parse_instant(as_of) - timedelta(days=1)))
    return blocks


def with_token_warnings(blocks: DataFrame, limit: str, approx_max_tokens: float = APPROX_MAX_TOKENS) -> DataFrame:
    """Adds ``warning`` for blocks at or near a limit like ``"500000"`` or ``"80%"``."""
    threshold, wording = parse_token_limit(limit, approx_max_tokens)
    used = F.col("total_tokens").cast("double")
    share = (used / F.nullif(F.lit(threshold), F.lit(0.0)) * 100.0).cast("bigint")
    # Warning texts (fixed values).
    exceeding = F.concat(
        F.lit("⚠️  Block has used "), F.col("total_tokens").cast("string"),
        F.lit(f" tokens, exceeding threshold of {wording}"),
    )
    approaching = F.concat(
        F.lit("⚠️  Block approaching limit: "), F.col("total_tokens").cast("string"),
        F.lit(" tokens used ("), share.cast("string"), F.lit("% of threshold)"),
    )
    warning = F.when(used >= threshold, exceeding).when(used >= threshold * 0.8, approaching)
    return blocks.withColumn("warning", warning)
