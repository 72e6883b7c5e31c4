"""JSON documents of the reports, written by all executors.

A document is a data set of text lines in document order: an opening line, one
line per report row, a closing line with the totals. Its text is the lines in
order. Nothing is gathered in one row or task, so a session or instance report
of any length can be written. The rows are needed several times (rows, first
row, totals), so they are staged first; ``write_document`` leaves part files whose
concatenation in name order is the document.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from meterlake.functions.text import rfc3339
from meterlake.functions.time import micros_between, whole_seconds
from meterlake.plans.reports import totals
from meterlake.schemas import TOKENS
from meterlake.session import stage


def _tokens() -> Column:
    return F.struct(*[F.col(name) for name in TOKENS], F.col("total_tokens").alias("total")).alias("tokens")


def _money() -> Column:
    return F.col("total_cost")


def _day(name: str) -> Column:
    return F.date_format(name, "yyyy-MM-dd").alias(name)


# Row layout and order of each report's document.
def _layouts() -> dict[str, tuple[list[Column], list[str]]]:
    return {
        "daily": ([_day("date"), _tokens(), _money(), F.col("models_used")], ["date"]),
        "daily_by_instance": (
            [_day("date"), F.col("instance_id"), _tokens(), _money(), F.col("models_used")], ["date", "instance_id"],
        ),
        "sessions": (
            [
                F.col("session_id"),
                rfc3339(F.col("start_time")).alias("start_time"),
                rfc3339(F.col("end_time")).alias("end_time"),
                whole_seconds(micros_between(F.col("start_time"), F.col("end_time"))).alias("duration_seconds"),
                _tokens(), _money(), F.col("model"),
            ],
            ["start_time", "session_id"],
        ),
        "monthly": ([F.col("month"), _tokens(), _money(), F.col("active_days")], ["month"]),
        "weekly": ([_day("week"), _tokens(), _money(), F.col("active_days")], ["week"]),
    }


OPENING, ROWS, CLOSING = 0, 1, 2


def document_lines(report: DataFrame, kind: str) -> DataFrame:
    """Lines of ``{"<kind>": [rows], "totals": {...}}`` for a daily, instance, session, monthly or weekly report.

    Columns: ``section``, ``position`` (sort key inside the section) and ``line``.
    """
    report = stage(report)
    layout, order = _layouts()[kind]
    rows = report.select(F.struct(*order).alias("position"), F.to_json(F.struct(*layout)).alias("text"))
    first = report.agg(F.min(F.struct(*order))).scalar()
    opening = report.sparkSession.range(1).select(_null_like(rows, "position"), F.lit(f'{{"{kind}":[').alias("line"))
    summary = F.to_json(F.struct(_tokens(), _money()))
    closing = totals(report).select(
        _null_like(rows, "position"), F.concat(F.lit('],"totals":'), summary, F.lit("}")).alias("line")
    )
    return (
        _section(OPENING, opening)
        .unionByName(_section(ROWS, _comma_separated(rows, first)))
        .unionByName(_section(CLOSING, closing))
        .orderBy("section", "position")
    )


def daily_detailed_lines(report: DataFrame, entries: DataFrame) -> DataFrame:
    """The daily document with an ``entries`` array in every day.

    A day is an opening line, its entry lines and a closing line. Which entry
    is the first of its day comes from a minimum per day, not from collecting days.
    """
    report, entries = stage(report), stage(entries)
    layout, _ = _layouts()["daily"]
    entry = F.struct(
        rfc3339(F.col("timestamp")).alias("timestamp"), F.col("session_id"), F.col("model"), _tokens(), F.col("cost")
    )
    order = F.struct("timestamp", "_file", "_ord")
    no_entry = F.lit(None).cast("struct<timestamp:timestamp,_file:string,_ord:bigint>").alias("position")
    firsts = entries.groupBy("date").agg(F.min(order).alias("_first"))
    lines = entries.select("date", order.alias("position"), F.to_json(entry).alias("text")).join(firsts, "date")
    lines = lines.select(
        "date", F.lit(ROWS).alias("step"), "position",
        F.concat(F.when(F.col("position") == F.col("_first"), F.lit("")).otherwise(F.lit(",")), "text").alias("line"),
    )
    first_day = report.agg(F.min("date")).scalar()
    day_text = F.to_json(F.struct(*layout))
    day_head = F.concat(
        F.when(F.col("date") == first_day, F.lit("")).otherwise(F.lit(",")),
        F.substring(day_text, F.lit(1), F.length(day_text) - 1), F.lit(',"entries":['),
    )
    heads = report.select("date", F.lit(OPENING).alias("step"), no_entry, day_head.alias("line"))
    tails = report.select("date", F.lit(CLOSING).alias("step"), no_entry, F.lit("]}").alias("line"))
    body = heads.unionByName(lines).unionByName(tails).withColumn("section", F.lit(ROWS))
    blank = [F.lit(None).cast("date").alias("date"), F.lit(OPENING).alias("step"), no_entry]
    opening = report.sparkSession.range(1).select(*blank, F.lit('{"daily":[').alias("line")).withColumn("section", F.lit(OPENING))
    summary = F.to_json(F.struct(_tokens(), _money()))
    closing = totals(report).select(*blank, F.concat(F.lit('],"totals":'), summary, F.lit("}")).alias("line")).withColumn(
        "section", F.lit(CLOSING)
    )
    return body.unionByName(opening).unionByName(closing).orderBy("section", "date", "step", "position")


def block_lines(blocks: DataFrame, sessions: DataFrame) -> DataFrame:
    """Lines of ``{"blocks": [rows]}``; the session ids of a block are lines of their own.

    ``blocks`` is a single timeline of blocks of an hour or more, and
    ``sessions`` the matching ``block_sessions``.
    """
    blocks, sessions = stage(blocks), stage(sessions)
    no_session = F.lit(None).cast("struct<start_time:timestamp,session_id:string>").alias("position")
    block_key = F.struct(F.col("start_time").alias("start_time"), F.col("is_gap").alias("is_gap")).alias("block")
    head = F.to_json(F.struct(
        rfc3339(F.col("start_time")).alias("start_time"), rfc3339(F.col("end_time")).alias("end_time"),
        "is_active", "is_gap", "session_count", _tokens(), _money(), "models_used",
    ))
    first_block = blocks.agg(F.min(F.struct("start_time", "is_gap"))).scalar()
    chosen = blocks.where(~F.col("is_gap")).select(F.col("start_time").alias("block_start"))
    members = sessions.join(chosen, "block_start", "left_semi")
    order = F.struct("start_time", "session_id")
    firsts = members.groupBy("block_start").agg(F.min(order).alias("_first"))
    ids = members.join(firsts, "block_start").select(
        F.struct(F.col("block_start").alias("start_time"), F.lit(False).alias("is_gap")).alias("block"),
        F.lit(ROWS).alias("step"), order.alias("position"),
        F.concat(F.when(order == F.col("_first"), F.lit("")).otherwise(F.lit(",")), _quoted("session_id")).alias("line"),
    )
    heads = blocks.select(block_key, F.lit(OPENING).alias("step"), no_session, F.concat(
        F.when(F.struct("start_time", "is_gap") == first_block, F.lit("")).otherwise(F.lit(",")),
        F.substring(head, F.lit(1), F.length(head) - 1), F.lit(',"sessions":['),
    ).alias("line"))
    tails = blocks.select(block_key, F.lit(CLOSING).alias("step"), no_session, F.lit("]}").alias("line"))
    body = heads.unionByName(ids).unionByName(tails).withColumn("section", F.lit(ROWS))
    no_block = F.lit(None).cast("struct<start_time:timestamp,is_gap:boolean>").alias("block")
    edge = blocks.sparkSession.range(1)
    opening = edge.select(no_block, F.lit(OPENING).alias("step"), no_session, F.lit('{"blocks":[').alias("line"), F.lit(OPENING).alias("section"))
    closing = edge.select(no_block, F.lit(OPENING).alias("step"), no_session, F.lit("]}").alias("line"), F.lit(CLOSING).alias("section"))
    return body.unionByName(opening).unionByName(closing).orderBy("section", "block", "step", "position")


def write_document(lines: DataFrame, path: str) -> None:
    """Writes the lines as ordered text parts."""
    lines.select("line").write.mode("overwrite").text(path)


def _quoted(column: str) -> Column:
    as_array = F.to_json(F.array(F.col(column)))
    return F.substring(as_array, F.lit(2), F.length(as_array) - 2)


def _comma_separated(rows: DataFrame, first: Column) -> DataFrame:
    comma = F.when(F.col("position") == first, F.lit("")).otherwise(F.lit(","))
    return rows.select("position", F.concat(comma, "text").alias("line"))


def _section(number: int, rows: DataFrame) -> DataFrame:
    return rows.select(F.lit(number).alias("section"), "position", "line")


def _null_like(rows: DataFrame, column: str) -> Column:
    return F.lit(None).cast(rows.schema[column].dataType).alias(column)
