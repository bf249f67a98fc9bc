"""Periodic digests: counters, the best matches, and rendered fragments, for all users in one plan."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.functions.text import escape_html, subject_line
from larkmill.operators.retrieval import top_k


def previous_day(ref: Column) -> tuple[Column, Column]:
    """[midnight of the day before, midnight of the day) around a reference time."""
    end = F.date_trunc("day", ref).cast("timestamp_ntz")
    return end - F.expr("INTERVAL 1 DAY"), end


def in_period(ts: Column, start: Column, end: Column) -> Column:
    return (ts >= start) & (ts < end)


def counters(matches: DataFrame, user: str, ts: str, start: Column, end: Column) -> DataFrame:
    inside = in_period(F.col(ts), start, end)
    return matches.groupBy(user).agg(
        F.count_if(inside).alias("new_matches"), F.count_if(inside & (F.col("action") == "APPLY_HIGH")).alias("high_priority"),
        F.count_if(inside & (F.col("action") == "REVIEW")).alias("pending"),
    )


def digest(matches: DataFrame, user: str, ts: str, start: Column, end: Column, best: int = 5) -> DataFrame:
    """(user, counters, subject, html) of the period."""
    stats = counters(matches, user, ts, start, end)
    ranked = top_k(
        matches.where(in_period(F.col(ts), start, end)), user, best, F.desc("llm_score"), F.desc("final_score"), F.asc("job_id")
    )
    rows = ranked.groupBy(user).agg(
        F.array_sort(F.collect_list(F.struct("rank", "title", "company", "llm_score", "action"))).alias("top")
    )
    item = lambda m: F.concat(
        F.lit("<li><b>"), escape_html(m["title"]), F.lit("</b> "), escape_html(m["company"]), F.lit(" ("),
        m["llm_score"].cast("string"), F.lit(", "), m["action"], F.lit(")</li>"),
    )
    html = F.concat(F.lit("<ul>"), F.array_join(F.transform("top", item), ""), F.lit("</ul>"))
    joined = stats.join(rows, user, "left")
    return joined.select(
        user, "new_matches", "high_priority", "pending", subject_line(F.col("high_priority"), F.col("new_matches")).alias("subject"),
        F.coalesce(html, F.lit("<p>No new matches.</p>")).alias("html"),
    )
