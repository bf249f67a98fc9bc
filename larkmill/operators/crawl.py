"""Crawl bookkeeping: due companies, sessions, error classes, source ladders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.functions.scores import ladder

# The classes of crawl failures.
ERROR_TYPES = (
    "network_error", "timeout", "connection_refused", "dns_error", "rate_limited", "blocked_by_site",
    "captcha_detected", "ip_banned", "parsing_error", "no_jobs_found", "invalid_page_structure", "pagination_error",
    "database_error", "duplicate_constraint", "storage_error", "missing_config", "invalid_url", "scraper_not_found",
    "unknown_error",
)


def due(enabled: Column, hours_since: Column, every: Column) -> Column:
    """Enabled, and never crawled or not within the interval."""
    return enabled & (hours_since.isNull() | F.coalesce(hours_since >= every, F.lit(False)))


def status_by_company(jobs: DataFrame, companies: DataFrame, ref: str) -> DataFrame:
    end = F.lit(ref).cast("date")
    recent = (F.col("posted_date") >= F.date_sub(end, 7)) & (F.col("posted_date") < end)
    return jobs.join(companies, "company_id").groupBy("company").agg(
        F.count("*").alias("n_jobs"), F.date_format(F.max("posted_date"), "yyyy-MM-dd").alias("last_posted"),
        F.count_if(recent).alias("recent"),
    )


def session_rollup(df: DataFrame, key: str, ts: str, ok: Column, failed: Column, items: Column) -> DataFrame:
    """Per session: attempts, successes, failures, items, seconds, and rates (null without a base)."""
    found = df.groupBy(key).agg(
        F.count("*").alias("attempted"), F.count_if(ok).alias("succeeded"), F.count_if(failed).alias("failed"),
        F.sum(items).alias("items"),
        (F.unix_seconds(F.max(ts).cast("timestamp")) - F.unix_seconds(F.min(ts).cast("timestamp"))).alias("seconds"),
    )
    return found.withColumns(
        {
            "success_rate": F.round(F.try_divide("succeeded", "attempted"), 6),
            "items_per_hour": F.round(F.try_divide(F.col("items") * 3600.0, F.col("seconds")), 6),
        }
    )


def classify_error(message: Column, kind: Column) -> Column:
    """The class of a failure by its message and the name of its type; the first rule that holds decides."""
    m, k = F.lower(F.coalesce(message, F.lit(""))), F.lower(F.coalesce(kind, F.lit("")))
    net = m.rlike("connection|network|resolve|unreachable")
    stored = k.rlike("integrity|database|sql")
    return ladder(
        [
            (net & m.contains("refused"), "connection_refused"),
            (net & m.contains("timeout"), "timeout"),
            (net & m.rlike("resolve|dns|name"), "dns_error"),
            (net, "network_error"),
            (m.rlike("rate limit|429|too many requests"), "rate_limited"),
            (m.rlike("blocked|forbidden|403"), "blocked_by_site"),
            (m.contains("captcha"), "captcha_detected"),
            (stored & m.rlike("unique|duplicate"), "duplicate_constraint"),
            (stored, "database_error"),
            (k.rlike("parse|json|xml|html"), "parsing_error"),
            (m.contains("timeout") | k.contains("timeout"), "timeout"),
        ],
        "unknown_error",
    )


def retryable(status: Column, message: Column, network: Column) -> Column:
    """rate_limit, server_error, network_error, or null for failures that stay."""
    m = F.lower(F.coalesce(message, F.lit("")))
    return ladder(
        [
            (status == 429, "rate_limit"),
            (status.between(500, 599), "server_error"),
            (m.rlike("rate limit|too many requests|quota exceeded"), "rate_limit"),
            (network, "network_error"),
        ],
        F.lit(None).cast("string"),
    )


def error_histogram(df: DataFrame, kind: str) -> DataFrame:
    """A count for every class, zero where there is none."""
    every = df.sparkSession.createDataFrame([(x,) for x in ERROR_TYPES], "error_type string")
    counts = df.groupBy(F.col(kind).alias("error_type")).agg(F.count("*").alias("n"))
    return every.join(counts, "error_type", "left").select("error_type", F.coalesce("n", F.lit(0)).alias("n"))


def acquire(api: DataFrame, scraped: DataFrame, company: str, enough: int = 20) -> DataFrame:
    """API rows of every company, and scraped rows of those with fewer than ``enough`` API rows."""
    full = api.groupBy(company).agg(F.count("*").alias("_n")).where(F.col("_n") >= enough).select(company)
    return api.unionByName(scraped.join(full, company, "left_anti"))
