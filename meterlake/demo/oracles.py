"""Expected results of the catalog's queries, as SQL over the test tables (DuckDB dialect).

Written from the report definitions, not from the Spark code: blocks come from
a recursive walk, price matches from comparing every name with every price.
"""

from __future__ import annotations

from meterlake.demo.events import EVENT_MODELS
from meterlake.schemas import TOKENS
from meterlake.sources.prices import DEFAULT_PRICES

AS_OF = "TIMESTAMP '2024-01-30 23:59:00'"

_MODEL = "CASE event_type " + " ".join(f"WHEN '{kind}' THEN '{name}'" for kind, name in EVENT_MODELS.items()) + " END"

USAGE = f"""u AS (
  SELECT 's' || user_id AS session_id, ts, {_MODEL} AS model,
    k * 10 AS input_tokens, k AS output_tokens,
    event_id % 50 AS cache_creation_tokens, event_id % 200 AS cache_read_tokens,
    CASE WHEN event_id % 3 = 0 THEN value END AS total_cost,
    CASE WHEN event_id % 11 <> 0 THEN 'proj' || (user_id % 7) END AS project,
    CASE WHEN event_id % 4 <> 0 THEN 'inst' || (event_id % 4) END AS instance_id,
    event_id, k
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def _rate(text: str | None) -> str:
    return "CAST(NULL AS DECIMAL(18,14))" if text is None else f"CAST({text} AS DECIMAL(18,14))"


def _price_rows(prices: dict) -> str:
    return ", ".join(f"('{key}', {', '.join(_rate(rate) for rate in rates)})" for key, rates in prices.items())


def priced(prices: dict = DEFAULT_PRICES) -> str:
    """CTEs ``u``, ``prices``, ``resolved`` and ``c`` (entries with cost and computed cost)."""
    return f"""WITH RECURSIVE {USAGE},
prices(key, r_in, r_out, r_cw, r_cr) AS (VALUES {_price_rows(prices)}),
candidates AS (
  SELECT m.model, p.*, CASE
      WHEN p.key = m.model THEN 0
      WHEN p.key = 'anthropic/' || m.model THEN 1
      WHEN p.key = 'claude-' || m.model THEN 2
      WHEN p.key = replace(m.model, 'claude-3-', 'claude-3.') THEN 3
      WHEN p.key = replace(m.model, 'claude-3.', 'claude-3-') THEN 4
      WHEN contains(p.key, m.model) OR contains(m.model, p.key) THEN 6 END AS match_rank
  FROM (SELECT DISTINCT model FROM u) m, prices p),
resolved AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY model ORDER BY match_rank, length(key) DESC, key) AS place
    FROM candidates WHERE match_rank IS NOT NULL) WHERE place = 1),
c AS (
  SELECT u.*, r.key AS price_key,
    CAST(u.total_cost AS DECIMAL(38,14)) AS logged,
    CAST(input_tokens AS DECIMAL(18,0)) * coalesce(r_in, 0) + CAST(output_tokens AS DECIMAL(18,0)) * coalesce(r_out, 0)
      + CAST(cache_creation_tokens AS DECIMAL(18,0)) * coalesce(r_cw, 0)
      + CAST(cache_read_tokens AS DECIMAL(18,0)) * coalesce(r_cr, 0) AS computed
  FROM u LEFT JOIN resolved r ON u.model = r.model),
a AS (SELECT *, coalesce(logged, CAST(computed AS DECIMAL(38,14))) AS cost FROM c)"""


def money(expression: str) -> str:
    return f"CAST(round({expression}, 8) AS DOUBLE)"


def stamp(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d %H:%M:%S.%f')"


def day(expression: str) -> str:
    return f"strftime({expression}, '%Y-%m-%d')"


def local(ts: str) -> str:
    return f"(({ts} AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York')"


SUMS = ", ".join(f"CAST(sum({name}) AS BIGINT) AS {name}" for name in TOKENS)
TOTAL = f"CAST(sum({' + '.join(TOKENS)}) AS BIGINT) AS total_tokens"
COST = f"{money('sum(cost)')} AS total_cost"
TOKEN_SUMS = f"{SUMS}, {TOTAL}"
MODELS = "array_to_string(list_sort(list(DISTINCT model)), ',') AS models_used"
PROJECTS = "coalesce(array_to_string(list_sort(list(DISTINCT project) FILTER (project IS NOT NULL)), ','), '') AS projects_used"
PLAIN_TOTAL = f"{' + '.join(TOKENS)} AS total_tokens"


def daily(date: str = "CAST(ts AS DATE)", where: str = "true", prices: dict = DEFAULT_PRICES) -> str:
    return f"""{priced(prices)}
SELECT {day('d')} AS date, {TOKEN_SUMS}, {COST}, {MODELS}
FROM (SELECT *, {date} AS d FROM a) WHERE {where} GROUP BY d"""


def monthly(date: str, where: str = "true", having: str = "true") -> str:
    return f"""{priced()}
SELECT strftime(d, '%Y-%m') AS month, {TOKEN_SUMS}, {COST}, count(DISTINCT d) AS active_days
FROM (SELECT *, {date} AS d FROM a) WHERE {where} GROUP BY strftime(d, '%Y-%m') HAVING {having}"""


def weekly(first: int, having: str = "true") -> str:
    start = f"CAST(CAST(ts AS DATE) - to_days(CAST((dayofweek(ts) - {first} + 7) % 7 AS INTEGER)) AS DATE)"
    return f"""{priced()}
SELECT {day('w')} AS week, {TOKEN_SUMS}, {COST}, count(DISTINCT CAST(ts AS DATE)) AS active_days
FROM (SELECT *, {start} AS w FROM a) GROUP BY w HAVING {having}"""


SESSIONS = f"""SELECT session_id, min(ts) AS start_time, max(ts) AS end_time, {TOKEN_SUMS}, sum(cost) AS cost,
  arg_min(model, event_id) AS model FROM a GROUP BY session_id"""


def sessions() -> str:
    return f"""{priced()}, s AS ({SESSIONS})
SELECT session_id, {stamp('start_time')} AS start_time, {stamp('end_time')} AS end_time, {', '.join(TOKENS)}, total_tokens,
  {money('cost')} AS total_cost, model FROM s"""


def _blocks_cte(key: str, minutes: int) -> str:
    """Entries ``b`` with the start of their block, by walking from block to block."""
    return f"""{priced()},
e AS (SELECT *, coalesce({key}, '~none') AS tk FROM a),
walk AS (
  SELECT tk, min(ts) AS opened, date_trunc('hour', min(ts)) AS start FROM e GROUP BY tk
  UNION ALL
  SELECT w.tk, min(e.ts), date_trunc('hour', min(e.ts)) FROM walk w
  JOIN e ON e.tk = w.tk AND e.ts > w.start + INTERVAL {minutes} MINUTE GROUP BY w.tk, w.start),
b AS (SELECT e.*, w.start FROM e ASOF JOIN walk w ON e.tk = w.tk AND e.ts >= w.opened)"""


def _block_rows(minutes: int, group: str = "tk, start") -> str:
    """CTE ``r``: one row per block and gap."""
    return f"""g AS (
  SELECT {group}, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT session_id) AS session_count,
    {TOKEN_SUMS}, sum(cost) AS cost, {MODELS}, {PROJECTS} FROM b GROUP BY {group}),
h AS (SELECT *, lag(last_ts) OVER (PARTITION BY tk ORDER BY first_ts) AS before FROM g),
r AS (
  SELECT tk, start AS start_time, start + INTERVAL {minutes} MINUTE AS end_time, first_ts, last_ts, session_count,
    {', '.join(TOKENS)}, total_tokens, cost, models_used, projects_used,
    ({AS_OF} - last_ts < INTERVAL {minutes} MINUTE) AND ({AS_OF} < start + INTERVAL {minutes} MINUTE) AS is_active,
    false AS is_gap FROM h
  UNION ALL
  SELECT tk, before + INTERVAL {minutes} MINUTE, first_ts, NULL, NULL, 0, 0, 0, 0, 0, 0, 0, '', '', false, true
  FROM h WHERE first_ts - before > INTERVAL {minutes} MINUTE)"""


_BLOCK_OUT = f"""{stamp('start_time')} AS start_time, {stamp('end_time')} AS end_time,
  {stamp('first_ts')} AS actual_start_time, {stamp('last_ts')} AS actual_end_time, session_count, {', '.join(TOKENS)},
  total_tokens, {money('cost')} AS total_cost, models_used, projects_used, is_active, is_gap"""


def blocks(key: str | None = None, minutes: int = 300, where: str = "true") -> str:
    key_out = f"nullif(tk, '~none') AS {key}, " if key else ""
    return f"""{_blocks_cte(key or "''", minutes)}, {_block_rows(minutes)}
SELECT {key_out}{_BLOCK_OUT} FROM r WHERE {where}"""


def blocks_below_an_hour(minutes: int) -> str:
    return f"""{priced()},
b AS (
  SELECT *, '' AS tk, date_trunc('hour', ts) AS start,
    CASE WHEN ts - date_trunc('hour', ts) > INTERVAL {minutes} MINUTE THEN event_id END AS alone FROM a),
{_block_rows(minutes, 'tk, start, alone')}
SELECT {_BLOCK_OUT} FROM r"""


def _claude_records() -> str:
    """Records that parse, with dedup key, and the first of each key in ``kept``."""
    return f"""WITH {USAGE},
records AS (
  SELECT *, CASE WHEN event_id % 13 <> 0 THEN 'm' || (event_id % 5000) || '-r' || (event_id % 2500) END AS dedup_key,
    'logs/' || session_id || '.jsonl' AS file FROM u WHERE event_id % 17 <> 0),
kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY dedup_key ORDER BY file, event_id) AS place FROM records)
  WHERE place = 1 OR dedup_key IS NULL)"""


def _usage_out(ts: str, session: str = "session_id", model: str = "model", cw: str = "cache_creation_tokens",
               cr: str = "cache_read_tokens", cost: str = "total_cost", project: str = "CAST(NULL AS VARCHAR)",
               instance: str = "CAST(NULL AS VARCHAR)", inp: str = "input_tokens", outp: str = "output_tokens") -> str:
    return f"""SELECT {session} AS session_id, {stamp(ts)} AS ts, {model} AS model, {inp} AS input_tokens,
  {outp} AS output_tokens, {cw} AS cache_creation_tokens, {cr} AS cache_read_tokens, {cost} AS total_cost,
  {project} AS project, {instance} AS instance_id"""


PARSE_CLAUDE = f"""{_claude_records()}
{_usage_out('ts', project='project', instance='instance_id')} FROM kept
WHERE event_id % 31 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0 AND event_id % 29 <> 0"""

PARSE_CODEX = f"""WITH {USAGE},
lines AS (
  SELECT *, CASE WHEN model = 'claude-sonnet-4-5-20250929' THEN CASE WHEN event_id % 2 = 0 THEN 'gpt-5' ELSE 'o4-mini' END END AS switch
  FROM u WHERE event_id % 17 <> 0),
named AS (
  SELECT *, coalesce(last_value(switch IGNORE NULLS) OVER (
    PARTITION BY session_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 'gpt-5') AS active
  FROM lines),
counts AS (
  SELECT *, CASE WHEN event_id % 11 <> 0 THEN event_id END AS t_in,
    CASE WHEN event_id % 11 <> 0 THEN event_id - event_id % 2 END AS t_out,
    CASE WHEN event_id % 11 <> 0 THEN CASE WHEN event_id % 7 > 0 THEN event_id % 7 ELSE 5 END END AS t_cache
  FROM named WHERE switch IS NULL AND event_id % 31 <> 0),
rises AS (
  SELECT *,
    coalesce(greatest(t_in - coalesce(last_value(t_in IGNORE NULLS) OVER w, 0), 0), 0) AS d_in,
    coalesce(greatest(t_out - coalesce(last_value(t_out IGNORE NULLS) OVER w, 0), 0), 0) AS d_out,
    coalesce(greatest(t_cache - coalesce(last_value(t_cache IGNORE NULLS) OVER w, 0), 0), 0) AS d_cache
  FROM counts WINDOW w AS (PARTITION BY session_id, active ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
deltas AS (
  SELECT session_id, ts, active,
    CASE WHEN model = 'claude-3-5-sonnet' THEN input_tokens ELSE d_in END AS i,
    CASE WHEN model = 'claude-3-5-sonnet' THEN output_tokens ELSE d_out END AS o,
    CASE WHEN model = 'claude-3-5-sonnet' THEN cache_read_tokens ELSE d_cache END AS cr FROM rises)
{_usage_out('ts', model='active', inp='i', outp='o', cw='CAST(0 AS BIGINT)', cr='cr', cost='CAST(NULL AS DOUBLE)')}
FROM deltas WHERE i > 0 OR o > 0"""

PARSE_OPENCODE = f"""WITH {USAGE},
kept AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY event_id % 7000 ORDER BY event_id) AS place FROM u WHERE event_id % 17 <> 0)
  WHERE place = 1 AND (input_tokens > 0 OR output_tokens > 0))
{_usage_out(
    f"CASE WHEN event_id % 10 = 0 THEN {AS_OF} ELSE date_trunc('second', ts) + INTERVAL 250 MILLISECOND END",
    model="CASE WHEN model = 'claude-3-haiku' THEN 'gemini-3-pro-preview' ELSE model END",
    cw="CASE WHEN event_id % 4 = 0 THEN 0 ELSE cache_creation_tokens END",
    cr="CASE WHEN event_id % 4 = 0 THEN 0 ELSE cache_read_tokens END")} FROM kept"""

PARSE_AMP = f"""WITH {USAGE}
{_usage_out(
    "ts", session="'T-' || session_id || '-' || (event_id // 500)",
    model="CASE WHEN event_id % 6 = 0 THEN 'unknown' ELSE model END",
    cw="CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 1 ELSE cache_creation_tokens END",
    cr="CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 3 = 0 THEN 1 ELSE cache_read_tokens END")}
FROM u WHERE event_id % 31 <> 0 AND (input_tokens > 0 OR output_tokens > 0)"""

PARSE_PI = f"""WITH {USAGE}
{_usage_out("ts", model="'[pi] ' || CASE WHEN event_id % 6 = 0 THEN 'unknown' ELSE model END", project="coalesce(project, 'no project')")}
FROM u WHERE event_id % 31 <> 0 AND event_id % 17 <> 0 AND event_id % 19 <> 0 AND (input_tokens > 0 OR output_tokens > 0)"""


def _provider_union() -> str:
    parts = {"claude": PARSE_CLAUDE, "codex": PARSE_CODEX, "opencode": PARSE_OPENCODE, "amp": PARSE_AMP, "pi": PARSE_PI}
    rows = " UNION ALL ".join(
        f"SELECT '{name}' AS provider, {', '.join(TOKENS)}, total_cost FROM ({sql})" for name, sql in parts.items()
    )
    return f"""SELECT provider, count(*) AS entries, {SUMS},
  {money('sum(CAST(total_cost AS DECIMAL(38,14)))')} AS total_cost FROM ({rows}) GROUP BY provider"""


def _cost_rows(expression: str) -> str:
    return f"{priced()} SELECT event_id, model, {money(expression)} AS cost FROM a"


NEWER_PRICES = {
    **DEFAULT_PRICES,
    "claude-3-haiku": ("0.000002", "0.000004", "0.000001", None),
    "mystery-model": ("0.00001", "0.00002", None, "0.000003"),
}

_SHORT = """CASE model WHEN 'claude-3-haiku' THEN 'Haiku 3' WHEN 'claude-3-5-sonnet' THEN 'Sonnet 3.5'
  WHEN 'claude-3-opus-20240229' THEN 'Opus 3' WHEN 'claude-sonnet-4-5-20250929' THEN 'Sonnet 4.5' ELSE model END"""
_STATUS = """CASE model WHEN 'claude-3-haiku' THEN 'Haiku' WHEN 'claude-3-5-sonnet' THEN 'Sonnet'
  WHEN 'claude-3-opus-20240229' THEN 'Opus' WHEN 'claude-sonnet-4-5-20250929' THEN 'Sonnet' ELSE 'model' END"""

_SESSION_BLOCKS = f"""s AS (
  SELECT start, session_id, min(ts) AS start_time, max(ts) AS end_time, {TOKEN_SUMS}, sum(cost) AS cost
  FROM b GROUP BY start, session_id),
m AS (
  SELECT start, session_id, model FROM (
    SELECT start, session_id, model, row_number() OVER (PARTITION BY start, session_id ORDER BY count(*) DESC, model) AS place
    FROM b GROUP BY start, session_id, model) WHERE place = 1)"""


def _duration(seconds: str) -> str:
    minutes = f"({seconds} // 60)"
    return f"""CASE WHEN {seconds} <= 0 THEN '0m' WHEN {minutes} < 60 THEN {minutes} || 'm'
    ELSE ({minutes} // 60) || 'h ' || ({minutes} % 60) || 'm' END"""


def _seconds(earlier: str, later: str) -> str:
    return f"((epoch_us({later}) - epoch_us({earlier})) // 1000000)"


def _ny(ts: str) -> str:
    return f"strftime({local(ts)}, '%Y-%m-%d %H:%M') || ' EST'"


_TOKEN_NAMES = f"{', '.join(TOKENS)}, total_tokens"


def _document(rows: str, names: list[str]) -> str:
    """Report rows and totals; ``names`` are the columns besides tokens and cost, the first is the key."""
    blank = ", ".join(f"NULL AS {name}" for name in names[1:])
    return f"""SELECT {', '.join(names)}, {_TOKEN_NAMES}, total_cost FROM ({rows})
UNION ALL SELECT 'totals' AS {names[0]}, {blank}, {_TOKEN_NAMES}, total_cost
FROM ({priced()} SELECT {TOKEN_SUMS}, {COST} FROM a)"""


ORACLES: dict[str, str] = {
    "daily": daily(),
    "daily_ny": daily(f"CAST({local('ts')} AS DATE)"),
    "daily_detailed": f"""{priced()}
SELECT {day('ts')} AS date, {stamp('ts')} AS timestamp, session_id, model, {', '.join(TOKENS)}, {PLAIN_TOTAL},
  {money('cost')} AS cost, event_id FROM a""",
    "daily_by_instance": f"""{priced()}
SELECT {day('ts')} AS date, coalesce(instance_id, 'default') AS instance_id, {TOKEN_SUMS}, {COST}, {MODELS}
FROM a GROUP BY 1, 2""",
    "sessions": sessions(),
    "monthly": monthly(f"CAST({local('ts')} AS DATE)"),
    "weekly_sunday": weekly(0),
    "weekly_wednesday": weekly(3),
    "totals": f"{priced()} SELECT {TOKEN_SUMS}, {COST} FROM a",
    "totals_rollup": f"""{priced()}
SELECT {day('d')} AS date, {TOKEN_SUMS}, {COST} FROM (SELECT *, CAST(ts AS DATE) AS d FROM a) GROUP BY ROLLUP (d)""",
    "date_project_filter": daily(
        f"CAST({local('ts')} AS DATE)", "d BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND project = 'proj3'"),
    "month_filter": monthly(f"CAST({local('ts')} AS DATE)", having="strftime(d, '%Y-%m') <= '2023-12'"),
    "week_month_filter": weekly(0, "strftime(w, '%Y-%m') >= '2024-01'"),
    "monthly_primary_rules": monthly("CAST(ts AS DATE)", having="strftime(d, '%Y-%m') = '2024-01'"),
    "monthly_other_rules": monthly(
        "CAST(ts AS DATE)", "d BETWEEN DATE '2024-01-10' AND DATE '2024-01-20' AND project = 'proj3'"),
    "cost_auto": _cost_rows("cost"),
    "cost_calculate": _cost_rows("CASE WHEN price_key IS NOT NULL THEN computed END"),
    "cost_display": _cost_rows("logged"),
    "price_resolution": f"""{priced()}
SELECT m.model, r.key AS price_key, CAST(r.match_rank AS BIGINT) AS match_rank,
  {money('r_in')} AS input_cost_per_token, {money('r_out')} AS output_cost_per_token,
  {money('r_cw')} AS cache_creation_input_token_cost, {money('r_cr')} AS cache_read_input_token_cost
FROM (SELECT DISTINCT model FROM u) m LEFT JOIN resolved r ON m.model = r.model""",
    "unknown_models": f"{priced()} SELECT DISTINCT model FROM u WHERE model NOT IN (SELECT model FROM resolved)",
    "price_merge": daily(prices=NEWER_PRICES),
    "dedup_claude": f"{_claude_records()} SELECT dedup_key, event_id FROM kept",
    "parse_claude": PARSE_CLAUDE,
    "parse_codex_delta": PARSE_CODEX,
    "parse_opencode": PARSE_OPENCODE,
    "parse_amp": PARSE_AMP,
    "parse_pi": PARSE_PI,
    "provider_union": _provider_union(),
    "blocks_global": blocks(),
    "blocks_by_model": blocks("model"),
    "blocks_by_project": blocks("project"),
    "blocks_by_session": blocks("session_id"),
    "blocks_fractional": blocks("session_id", 150),
    "blocks_below_an_hour": blocks_below_an_hour(15),
    "block_gaps": f"""{_blocks_cte('session_id', 300)}, {_block_rows(300)}
SELECT tk AS session_id, {stamp('start_time')} AS start_time, {stamp('end_time')} AS end_time, total_tokens FROM r WHERE is_gap""",
    "block_sessions": f"""{_blocks_cte("''", 300)}, {_SESSION_BLOCKS}
SELECT {stamp('start')} AS block_start, session_id, {stamp('start_time')} AS start_time, {stamp('end_time')} AS end_time,
  {', '.join(TOKENS)}, total_tokens, {money('cost')} AS total_cost, model
FROM s JOIN m USING (start, session_id)""",
    "blocks_legacy": f"""{priced()}, s AS ({SESSIONS}),
walk AS (
  SELECT min(start_time) AS opened, date_trunc('hour', min(start_time)) AS start FROM s
  UNION ALL
  SELECT min(s.start_time), date_trunc('hour', min(s.start_time)) FROM walk w
  JOIN s ON s.start_time >= w.start + INTERVAL 5 HOUR GROUP BY w.start),
b AS (SELECT s.*, w.start FROM s ASOF JOIN walk w ON s.start_time >= w.opened)
SELECT {stamp('start')} AS start_time, {stamp('start + INTERVAL 5 HOUR')} AS end_time,
  {stamp('min(b.start_time)')} AS actual_start_time, {stamp('arg_max(b.end_time, b.start_time)')} AS actual_end_time,
  count(*) AS session_count, {TOKEN_SUMS.replace('sum(' + ' + '.join(TOKENS) + ')', 'sum(total_tokens)')},
  {COST}, {MODELS}, '' AS projects_used, {AS_OF} < start + INTERVAL 5 HOUR AS is_active, false AS is_gap
FROM b GROUP BY start""",
    "block_filters": blocks(
        "session_id",
        where="start_time >= TIMESTAMP '2024-01-10' AND start_time <= TIMESTAMP '2024-01-20 23:59:59' "
        "AND contains(',' || projects_used || ',', ',proj3,')"),
    "blocks_active_recent": blocks("session_id", where=f"is_active AND start_time > {AS_OF} - INTERVAL 1 DAY"),
    "token_warnings": f"""{_blocks_cte("''", 300)}, {_block_rows(300)}
SELECT {stamp('start_time')} AS start_time, total_tokens, CASE
  WHEN total_tokens >= 50000
    THEN '⚠️  Block has used ' || total_tokens || ' tokens, exceeding threshold of 0% (~50000 tokens)'
  WHEN total_tokens >= 40000
    THEN '⚠️  Block approaching limit: ' || total_tokens || ' tokens used (' || (total_tokens * 100 // 50000) || '% of threshold)'
  END AS warning FROM r""",
    "historical_max": f"""{_blocks_cte("''", 300)}, {_block_rows(300)}
SELECT {money('CASE WHEN max(cost) > 0 THEN max(cost) ELSE 50 END')} AS max_cost FROM r""",
    "burn_projection": f"""{_blocks_cte("''", 300)}, {_block_rows(300)},
x AS (SELECT *, CAST(cost AS DOUBLE) AS usd, {_seconds('start_time', AS_OF)} AS sec,
    greatest((epoch_us(end_time) - epoch_us({AS_OF})) // 60000000, 0) AS left_min,
    (SELECT CAST(max(cost) AS DOUBLE) FROM r) AS top FROM r),
y AS (SELECT *, usd / greatest(sec // 60, 1) AS rate FROM x),
z AS (SELECT *, usd + rate * left_min AS projected FROM y)
SELECT {stamp('start_time')} AS start_time, round(usd, 8) AS total_cost, round(top, 8) AS max_cost,
  round(sec / CAST({_seconds('start_time', 'end_time')} AS DOUBLE) * 100, 8) AS block_progress, round(rate, 8) AS burn_rate, left_min AS remaining_minutes,
  round(projected, 8) AS projected_cost, round(usd / top * 100, 8) AS usage_percent,
  round(projected / top * 100, 8) AS projection_percent,
  CASE WHEN projected / top * 100 > 100 THEN 'WILL EXCEED LIMIT' WHEN projected / top * 100 > 80 THEN 'APPROACHING LIMIT'
    ELSE 'WITHIN LIMITS' END AS projection_status,
  CASE WHEN rate > 0.5 THEN 'HIGH' WHEN rate > 0.2 THEN 'ELEVATED' ELSE 'NORMAL' END AS burn_status FROM z""",
    "active_sessions": f"""WITH {USAGE}
SELECT session_id, count(*) AS entries FROM u WHERE ts > {AS_OF} - INTERVAL 5 MINUTE GROUP BY session_id""",
    "spend_snapshot": f"""{priced()},
s AS (SELECT session_id, sum(cost) AS cost, min(ts) AS began FROM a GROUP BY session_id),
d AS (SELECT CAST(sum(cost) AS DOUBLE) AS cost FROM a WHERE CAST({local('ts')} AS DATE) = DATE '2024-01-30'),
x AS (SELECT s.*, d.cost AS day_cost, d.cost / (200.0::DOUBLE / 31) * 100 AS percent,
  18000 - {_seconds("date_trunc('hour', began)", AS_OF)} AS sec FROM s, d)
SELECT session_id, {money('cost')} AS session_cost, {stamp('began')} AS session_start, round(day_cost, 8) AS day_cost,
  round(percent, 8) AS budget_percent,
  CASE WHEN percent < 0 THEN 'muted' WHEN percent < 80 THEN 'good' WHEN percent < 120 THEN 'warn'
    WHEN percent < 150 THEN 'over' ELSE 'high' END AS budget_band,
  CASE WHEN sec > 0 THEN sec END AS seconds_left,
  CASE WHEN sec <= 0 THEN 'expired' WHEN sec < 3600 THEN (sec // 60) || 'm left'
    ELSE (sec // 3600) || 'h ' || (sec // 60 % 60) || 'm left' END AS time_left FROM x""",
    "usage_by_model_family": f"""{priced()}
SELECT {_SHORT} AS family, {_STATUS} AS status_name, count(*) AS entries, CAST(sum(output_tokens) AS BIGINT) AS output_tokens,
  {money('sum(cost)')} AS cost FROM a GROUP BY 1, 2""",
    "display_daily": f"""{priced()},
d AS (SELECT {day('ts')} AS date, model, sum(input_tokens) AS i, sum({' + '.join(TOKENS)}) AS t, sum(cost) AS usd
  FROM a GROUP BY 1, 2)
SELECT date, format('{{:,}}', CAST(sum(i) AS BIGINT)) AS input_tokens_text,
  format('{{:,}}', CAST(sum(t) AS BIGINT)) AS total_tokens_text, printf('$%.2f', CAST(sum(usd) AS DOUBLE)) AS total_cost_text,
  string_agg({_SHORT}, ', ' ORDER BY model) AS models_text FROM d GROUP BY date""",
    "display_blocks": f"""{_blocks_cte('session_id', 300)}, {_block_rows(300)}
SELECT tk AS session_id, CASE
    WHEN is_gap THEN {_ny('start_time')} || ' - ' || {_ny('end_time')} || ' (' || {_duration(_seconds('start_time', 'end_time'))} || ' gap)'
    WHEN is_active THEN {_ny('start_time')} || ' (' || {_duration(_seconds('start_time', AS_OF))} || ' elapsed)'
    ELSE {_ny('start_time')} || ' (' || {_duration(_seconds('first_ts', 'last_ts'))} || ')' END AS start_text,
  CASE WHEN is_gap THEN 'GAP' WHEN is_active THEN 'ACTIVE' ELSE 'Complete' END AS status,
  CASE WHEN NOT is_active THEN '-'
    ELSE ({_seconds(AS_OF, 'end_time')} // 3600) || 'h ' || ({_seconds(AS_OF, 'end_time')} // 60 % 60) || 'm' END AS time_remaining
FROM r""",
    "json_sessions": f"""{priced()}, s AS ({SESSIONS})
SELECT session_id, strftime(start_time, '%Y-%m-%dT%H:%M:%S') || CASE
    WHEN epoch_us(start_time) % 1000000 = 0 THEN '' WHEN epoch_us(start_time) % 1000 = 0 THEN strftime(start_time, '.%g')
    ELSE strftime(start_time, '.%f') END || '+00:00' AS start_time,
  {_seconds('start_time', 'end_time')} AS duration_seconds, {', '.join(TOKENS)}, total_tokens,
  {money('cost')} AS total_cost, model FROM s""",
    "json_weekly": weekly(0),
    "json_daily_entries": f"""{priced()}
SELECT {day('ts')} AS date, count(*) AS entries, CAST(sum({' + '.join(TOKENS)}) AS BIGINT) AS total_tokens,
  {money('sum(cost)')} AS cost FROM a GROUP BY 1""",
    "json_block_sessions": f"""{_blocks_cte("''", 300)}
SELECT session_id, count(DISTINCT start) AS blocks FROM b GROUP BY session_id""",
    "stream_daily": daily(),
    "stream_monthly": monthly(f"CAST({local('ts')} AS DATE)"),
    "stream_weekly": weekly(0),
    "stream_sessions": sessions(),
    "stream_blocks": blocks(),
}
ORACLES["read_claude"] = ORACLES["stream_claude_dedup"] = ORACLES["parse_claude"]
ORACLES["read_codex"], ORACLES["read_pi"] = ORACLES["parse_codex_delta"], ORACLES["parse_pi"]
ORACLES["stream_blocks_below_an_hour"] = ORACLES["blocks_below_an_hour"]
ORACLES["json_daily"] = _document(ORACLES["daily"], ["date", "models_used"])
ORACLES["json_by_instance"] = _document(ORACLES["daily_by_instance"], ["date", "instance_id", "models_used"])
ORACLES["json_monthly"] = _document(ORACLES["monthly"], ["month", "active_days"])
ORACLES["json_blocks"] = f"""SELECT start_time, end_time, is_active, is_gap, session_count, {_TOKEN_NAMES}, total_cost, models_used
FROM ({ORACLES['blocks_global']})"""
ORACLES["spend_snapshot_requests"] = ORACLES["spend_snapshot"].replace(
    "x AS (SELECT s.*,", """q AS (SELECT DISTINCT session_id FROM u WHERE project = 'proj3' UNION ALL SELECT 'nobody'),
x AS (SELECT q.session_id, coalesce(s.cost, 0) AS cost, s.began,""").replace(
    "FROM s, d)", "FROM q LEFT JOIN s ON q.session_id = s.session_id CROSS JOIN d)").replace(
    "CASE WHEN sec <= 0", "CASE WHEN began IS NULL THEN 'no block' WHEN sec <= 0").replace(
    "AS time_left FROM x", "AS time_left,\n  CASE WHEN cost > 0 THEN printf('$%.2f', CAST(cost AS DOUBLE)) ELSE 'no session' END AS cost_text FROM x")
ORACLES["daily_staged"] = ORACLES["daily"]
ORACLES["blocks_staged"] = ORACLES["blocks_global"]
ORACLES["stream_by_instance"] = ORACLES["daily_by_instance"]

# Reports over the deduplicated records of the log files: their usage takes the place of ``u``.
_KEPT_USAGE = f"""{_claude_records().removeprefix('WITH ')},
u2 AS (SELECT * FROM kept WHERE event_id % 31 <> 0 AND event_id % 19 <> 0 AND event_id % 23 <> 0 AND event_id % 29 <> 0)"""


def _over_logs(sql: str) -> str:
    body = sql.replace(USAGE, _KEPT_USAGE, 1)
    head, tail = body.split("u2 AS", 1)
    return f"{head}u2 AS{tail.replace('FROM u)', 'FROM u2)').replace('FROM u LEFT', 'FROM u2 u LEFT')}"


ORACLES["stream_tail_sessions"] = _over_logs(ORACLES["sessions"])
ORACLES["stream_block_watch"] = ORACLES["blocks_by_project"]
ORACLES["stream_block_maximum"] = ORACLES["historical_max"]
ORACLES["stream_active_sessions"] = f"""WITH {USAGE}
SELECT session_id, count(*) AS entries FROM u
WHERE ts > (SELECT date_trunc('millisecond', max(ts)) FROM u) - INTERVAL 1 DAY GROUP BY session_id"""
ORACLES["read_amp"] = ORACLES["parse_amp"]
ORACLES["json_sessions"] = _document(ORACLES["json_sessions"], ["session_id", "start_time", "duration_seconds", "model"])
ORACLES["json_weekly"] = _document(ORACLES["json_weekly"], ["week", "active_days"])
ORACLES["price_file"] = ORACLES["daily"]
ORACLES["read_claude_recent"] = PARSE_CLAUDE.replace("FROM u WHERE event_id % 17 <> 0", "FROM u WHERE event_id % 17 <> 0 AND CAST(substr(session_id, 2) AS BIGINT) % 2 = 0")
ORACLES["stream_monthly_bits"], ORACLES["stream_weekly_bits"] = ORACLES["monthly"], ORACLES["weekly_sunday"]
ORACLES["block_filters_by_rows"] = f"SELECT * EXCLUDE (projects_used) FROM ({ORACLES['block_filters']})"
ORACLES["block_projects"] = f"""{_blocks_cte("''", 300)}
SELECT DISTINCT {stamp('start')} AS block_start, project FROM b WHERE project IS NOT NULL"""
