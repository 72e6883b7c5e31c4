"""Usage analytics for logs of AI coding tools, on Spark."""

from meterlake.operators.blocks import (
    BlockRule, billing_blocks, block_projects, block_sessions, blocks_from_sessions, filter_blocks, with_token_warnings,
)
from meterlake.operators.filters import MonthFilter, UsageFilter
from meterlake.operators.monitor import active_sessions, historical_max, spend_snapshot, with_burn_rate
from meterlake.operators.pricing import resolve_models, unknown_models, with_cost
from meterlake.plans.reports import (
    BlockReport, Report, daily, daily_by_instance, daily_by_instance_report, daily_detailed, daily_report, monthly,
    monthly_bits_report, monthly_report, other_provider_report, primary_provider_report, session_report, sessions, totals,
    weekly, weekly_bits_report, weekly_report, with_totals,
)
from meterlake.schemas import USAGE, CostMode
from meterlake.session import get_session
from meterlake.sources import read_usage, union_usage
from meterlake.sources.prices import default_prices, load_prices, merge_prices

__all__ = [name for name in dir() if not name.startswith("_")]
