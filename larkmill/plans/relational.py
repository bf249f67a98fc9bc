"""Filters, projections, joins, aggregates, windows, orders and set operations of the matching domain."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from larkmill.operators import windows as W
from larkmill.operators.tables import lineage_depth, range_pairs
from larkmill.plans import domain as D
from larkmill.plans.registry import Registry
from larkmill.session import table

R = Registry()
REF = "2024-02-01"


@R.add("SELECT doc_id, source, lang FROM documents WHERE lang = 'en'")
def filter_equality(spark, d):
    return table(spark, d, "documents").where(F.col("lang") == "en").select("doc_id", "source", "lang")


@R.add("SELECT o_orderkey, o_orderstatus FROM orders WHERE o_orderstatus = 'F' AND o_totalprice >= 100000")
def filter_optional(spark, d):
    from larkmill.operators.tables import optional_filters

    found = optional_filters(
        table(spark, d, "orders"), {"o_orderstatus": "F", "o_orderpriority": None}, {"o_totalprice": 100000}
    )
    return found.select("o_orderkey", "o_orderstatus")


@R.add("SELECT s_suppkey, s_name FROM supplier WHERE s_name ILIKE '%7%'")
def filter_ilike(spark, d):
    return table(spark, d, "supplier").where(F.col("s_name").ilike("%7%")).select("s_suppkey", "s_name")


@R.add("SELECT doc_id FROM documents WHERE contains(text, 'the')")
def filter_contains(spark, d):
    return table(spark, d, "documents").where(F.col("text").contains("the")).select("doc_id")


@R.add(D.with_ctes(D.MATCHES) + "SELECT job_id, resume_id, final_score FROM matches WHERE final_score >= 0.6")
def filter_threshold(spark, d):
    return D.matches(spark, d).where(F.col("final_score") >= 0.6).select("job_id", "resume_id", "final_score")


@R.add(
    D.with_ctes(D.MATCHES)
    + """SELECT job_id, resume_id, llm_score FROM matches WHERE llm_score BETWEEN 70 AND 80 AND action IN ('REVIEW', 'SKIP')"""
)
def filter_between_in(spark, d):
    m = D.matches(spark, d)
    return m.where(F.col("llm_score").between(70, 80) & F.col("action").isin("REVIEW", "SKIP")).select(
        "job_id", "resume_id", "llm_score"
    )


@R.add("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def unapplied_jobs_anti(spark, d):
    orders = table(spark, d, "orders").where("o_orderstatus = 'F'").select("o_custkey").distinct()
    return table(spark, d, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


@R.add("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def applied_semi(spark, d):
    done = table(spark, d, "orders").where("o_orderstatus = 'F'")
    return table(spark, d, "customer").join(done, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select(
        "c_custkey", "c_name"
    )


@R.add(
    """SELECT d.doc_id, l.quality IS NULL AS unlabelled FROM documents d LEFT JOIN labels l USING (doc_id)
    WHERE l.quality IS NULL OR l.toxic IS NOT NULL AND l.toxic = 1"""
)
def filter_null_tests(spark, d):
    joined = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left")
    return joined.where(F.col("quality").isNull() | (F.col("toxic").isNotNull() & (F.col("toxic") == 1))).select(
        "doc_id", F.col("quality").isNull().alias("unlabelled")
    )


@R.add(f"SELECT event_id FROM events WHERE ts >= TIMESTAMP '{REF}' - INTERVAL 7 DAYS AND ts < TIMESTAMP '{REF}'")
def filter_recent_window(spark, d):
    from larkmill.operators.tables import within

    return within(table(spark, d, "events"), "ts", REF, days=7).select("event_id")


@R.add(
    """SELECT s_suppkey, s_nationkey % 4 <> 0 AND (s_acctbal < 0 OR CAST(abs(s_acctbal) AS BIGINT) % 48 >= 24) AS due
    FROM supplier"""
)
def crawl_due(spark, d):
    from larkmill.operators.crawl import due

    s = table(spark, d, "supplier")
    hours = F.when(F.col("s_acctbal") >= 0, F.bround(F.abs("s_acctbal")).cast("long") % 48)
    return s.select("s_suppkey", due(F.col("s_nationkey") % 4 != 0, hours, F.lit(24)).alias("due"))


@R.add(
    """SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN TIMESTAMP '2024-02-01' END IS NULL AS active FROM documents
    WHERE doc_id % 5 <> 0 OR doc_id % 10 = 0"""
)
def soft_deleted(spark, d):
    from larkmill.operators.tables import restore, soft_delete

    marked = soft_delete(table(spark, d, "documents"), F.col("doc_id") % 5 == 0, REF)
    shown = restore(marked, F.lit(False)).where((F.col("doc_id") % 5 != 0) | (F.col("doc_id") % 10 == 0))
    return shown.select("doc_id", F.col("deleted_at").isNull().alias("active"))


@R.add(
    D.with_ctes(D.COMPANIES, D.JOBS)
    + """SELECT job_id, title, company, location FROM jobs JOIN companies USING (company_id)"""
)
def jobs_with_companies(spark, d):
    return D.jobs(spark, d).join(D.companies(spark, d), "company_id").select("job_id", "title", "company", "location")


@R.add(
    D.with_ctes(D.COMPANIES, D.JOBS, D.MATCHES)
    + """SELECT job_id, resume_id, company, title, final_score, vector_score FROM matches JOIN jobs USING (job_id)
    JOIN companies USING (company_id) ORDER BY final_score DESC NULLS LAST, vector_score DESC NULLS LAST, job_id, resume_id LIMIT 50"""
)
def top_matches_nulls_last(spark, d):
    m = D.matches(spark, d).join(D.jobs(spark, d), "job_id").join(D.companies(spark, d), "company_id")
    order = [F.desc_nulls_last("final_score"), F.desc_nulls_last("vector_score"), F.asc("job_id"), F.asc("resume_id")]
    return m.orderBy(*order).limit(50).select("job_id", "resume_id", "company", "title", "final_score", "vector_score")


@R.add(
    D.with_ctes(D.COMPANIES, D.JOBS, D.RESUMES, D.MATCHES)
    + """SELECT m.job_id, m.resume_id, j.seniority, c.company, r.years, l.quality = 1 AS got_interview, l.toxic
    FROM matches m JOIN jobs j ON m.job_id = j.job_id JOIN companies c ON j.company_id = c.company_id
    JOIN resumes r ON m.resume_id = r.resume_id JOIN labels l ON l.doc_id = m.job_id
    WHERE l.quality IS NOT NULL AND m.scored_at >= TIMESTAMP '2024-01-11'"""
)
def outcomes_five_way(spark, d):
    m = D.matches(spark, d).where(F.col("scored_at") >= F.lit("2024-01-11").cast("timestamp_ntz"))
    joined = (
        m.join(D.jobs(spark, d).select("job_id", "company_id", "seniority"), "job_id")
        .join(D.companies(spark, d), "company_id")
        .join(D.resumes(spark, d).select("resume_id", "years"), "resume_id")
        .join(table(spark, d, "labels").withColumnRenamed("doc_id", "job_id"), "job_id")
    )
    return joined.where(F.col("quality").isNotNull()).select(
        "job_id", "resume_id", "seniority", "company", "years", (F.col("quality") == 1).alias("got_interview"), "toxic"
    )


@R.add(
    D.with_ctes(D.COMPANIES)
    + """SELECT o.o_orderkey, c.c_name, coalesce(k.company, 'Unknown') AS company FROM orders o JOIN customer c
    ON o.o_custkey = c.c_custkey LEFT JOIN companies k ON k.company_id = o.o_custkey % 400"""
)
def display_lookup_left(spark, d):
    orders = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    named = orders.join(D.companies(spark, d), F.col("company_id") == F.col("o_custkey") % 400, "left")
    return named.select("o_orderkey", "c_name", F.coalesce("company", F.lit("Unknown")).alias("company"))


@R.add(
    D.with_ctes(D.MATCHES)
    + """, r AS (SELECT job_id, resume_id, final_score FROM matches WHERE llm_score >= 60)
    SELECT a.job_id, a.resume_id, b.job_id AS other_job, round(abs(a.final_score - b.final_score), 6) AS gap
    FROM r a JOIN r b ON a.resume_id = b.resume_id AND a.job_id <> b.job_id
    AND round(abs(a.final_score - b.final_score), 6) <= 0.02"""
)
def similar_matches_range_join(spark, d):
    m = D.matches(spark, d).where("llm_score >= 60").select("job_id", "resume_id", "final_score")
    return range_pairs(m, "resume_id", "job_id", "final_score", 0.02)


@R.add(
    """SELECT conv_id, turn, depth, root FROM (
    WITH RECURSIVE up AS (
      SELECT conv_id, turn, turn AS root, CAST(0 AS BIGINT) AS depth FROM conversations WHERE turn = 0
      UNION ALL SELECT c.conv_id, c.turn, u.root, u.depth + 1 FROM conversations c JOIN up u
      ON c.conv_id = u.conv_id AND c.turn = u.turn + 1)
    SELECT * FROM up)"""
)
def lineage_depth_by_parent(spark, d):
    turns = table(spark, d, "conversations").select("conv_id", "turn")
    return lineage_depth(turns.withColumn("parent", F.when(F.col("turn") > 0, F.col("turn") - 1)), "conv_id", "turn", "parent")


@R.add(
    D.with_ctes(D.CHUNKS)
    + """SELECT d.doc_id, coalesce(list_sort(list(c.vec_id) FILTER (c.vec_id IS NOT NULL)), []) AS vec_ids
    FROM documents d LEFT JOIN chunks c ON c.job_id = d.doc_id AND c.vec_id % 2 = 0 GROUP BY d.doc_id"""
)
def children_array_left(spark, d):
    kids = D.chunks(spark, d).where("vec_id % 2 = 0").groupBy("job_id").agg(F.array_sort(F.collect_list("vec_id")).alias("v"))
    docs = table(spark, d, "documents")
    return docs.join(kids, F.col("doc_id") == F.col("job_id"), "left").select(
        "doc_id", F.coalesce("v", F.array().cast("array<bigint>")).alias("vec_ids")
    )


@R.add(
    D.with_ctes(D.MATCHES)
    + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY final_score DESC, job_id) AS r FROM matches),
    a AS (SELECT job_id, final_score FROM ranked WHERE resume_id = 1 AND r <= 10),
    b AS (SELECT job_id, final_score FROM ranked WHERE resume_id = 2 AND r <= 10)
    SELECT coalesce(a.job_id, b.job_id) AS job_id, coalesce(a.final_score, 0) AS score_1, coalesce(b.final_score, 0) AS score_2,
      CASE WHEN coalesce(a.final_score, 0) > coalesce(b.final_score, 0) THEN 'first'
        WHEN coalesce(a.final_score, 0) < coalesce(b.final_score, 0) THEN 'second' ELSE 'tie' END AS winner
    FROM a FULL JOIN b ON a.job_id = b.job_id"""
)
def compare_two_full_outer(spark, d):
    from larkmill.operators.retrieval import top_k

    top = top_k(D.matches(spark, d).where("resume_id IN (1, 2)"), "resume_id", 10, F.desc("final_score"), F.asc("job_id"))
    a = top.where("resume_id = 1").select("job_id", F.col("final_score").alias("s1"))
    b = top.where("resume_id = 2").select("job_id", F.col("final_score").alias("s2"))
    both = a.join(b, "job_id", "full").select(
        "job_id", F.coalesce("s1", F.lit(0.0)).alias("score_1"), F.coalesce("s2", F.lit(0.0)).alias("score_2")
    )
    winner = F.when(F.col("score_1") > F.col("score_2"), "first").when(F.col("score_1") < F.col("score_2"), "second")
    return both.withColumn("winner", winner.otherwise("tie"))


@R.add(
    D.with_ctes(D.MATCHES)
    + """SELECT count(*) AS total, round(coalesce(avg(llm_score), 0), 6) AS avg_llm, coalesce(max(final_score), 0) AS best,
    coalesce(min(final_score), 0) AS worst, count(*) FILTER (action IN ('APPLY_HIGH', 'APPLY_MEDIUM')) AS to_apply FROM matches"""
)
def match_stats(spark, d):
    return D.matches(spark, d).agg(
        F.count("*").alias("total"), F.round(F.coalesce(F.avg("llm_score"), F.lit(0.0)), 6).alias("avg_llm"),
        F.coalesce(F.max("final_score"), F.lit(0.0)).alias("best"), F.coalesce(F.min("final_score"), F.lit(0.0)).alias("worst"),
        F.count_if(F.col("action").isin("APPLY_HIGH", "APPLY_MEDIUM")).alias("to_apply"),
    )


@R.add(D.with_ctes(D.MATCHES) + "SELECT action, count(*) AS n FROM matches GROUP BY action")
def action_breakdown(spark, d):
    return D.matches(spark, d).groupBy("action").agg(F.count("*").alias("n"))


@R.add("SELECT o_orderstatus AS status, count(*) AS n FROM orders GROUP BY 1 ORDER BY 1")
def application_status_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("status")).agg(F.count("*").alias("n")).orderBy("status")


@R.add(
    D.with_ctes(D.COMPANIES, D.JOBS)
    + """SELECT company, count(*) AS n_jobs, strftime(max(posted_date), '%Y-%m-%d') AS last_posted,
    count(*) FILTER (posted_date >= DATE '2024-06-01' - 7 AND posted_date < DATE '2024-06-01') AS recent
    FROM jobs JOIN companies USING (company_id) GROUP BY company"""
)
def crawl_status_by_company(spark, d):
    from larkmill.operators.crawl import status_by_company

    return status_by_company(D.jobs(spark, d), D.companies(spark, d), "2024-06-01")


@R.add(
    D.with_ctes(D.JOBS)
    + """SELECT seniority, round(max(n_chars), 6) AS best, round(avg(n_chars), 6) AS mean,
      CASE WHEN avg(n_chars) >= 2400 THEN 'strong' WHEN avg(n_chars) >= 2200 THEN 'fair' ELSE 'weak' END AS label
    FROM jobs GROUP BY seniority ORDER BY best DESC, seniority"""
)
def department_max_avg(spark, d):
    g = D.jobs(spark, d).groupBy("seniority").agg(F.max("n_chars").alias("best"), F.avg("n_chars").alias("mean"))
    label = F.when(F.col("mean") >= 2400, "strong").when(F.col("mean") >= 2200, "fair").otherwise("weak")
    return g.select("seniority", "best", F.round("mean", 6).alias("mean"), label.alias("label")).orderBy(F.desc("best"), "seniority")


@R.add(
    """SELECT event_type AS name, count(*) AS n, arg_max(value, (ts, event_id)) AS latest, round(sum(value), 4) AS total,
    round(avg(value), 6) AS mean FROM events WHERE value IS NOT NULL GROUP BY 1"""
)
def metric_summary(spark, d):
    e = table(spark, d, "events").where("value IS NOT NULL")
    return e.groupBy(F.col("event_type").alias("name")).agg(
        F.count("*").alias("n"), F.max_by("value", F.struct("ts", "event_id")).alias("latest"),
        F.round(F.sum("value"), 4).alias("total"), F.round(F.avg("value"), 6).alias("mean"),
    )


@R.add(
    """WITH e AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS r,
      count(*) OVER (PARTITION BY event_type) AS n, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS late
      FROM events WHERE value IS NOT NULL)
    SELECT event_type AS name, max(n) AS n, min(value) AS low, max(value) AS high,
      max(value) FILTER (late = 1) AS current, max(value) FILTER (r = CAST(floor(n * 0.95) AS BIGINT) + 1) AS p95
    FROM e GROUP BY 1"""
)
def metric_p95_by_index(spark, d):
    return W.order_statistic(table(spark, d, "events").where("value IS NOT NULL"), "event_type", "value", "ts", "event_id", 0.95)


@R.add(
    """SELECT count(DISTINCT text) AS unique_texts, count(*) AS texts, round(count(DISTINCT text) / count(*), 6) AS ratio
    FROM documents"""
)
def distinct_text_ratio(spark, d):
    return table(spark, d, "documents").agg(
        F.count_distinct("text").alias("unique_texts"), F.count("*").alias("texts"),
        F.round(F.count_distinct("text") / F.count("*"), 6).alias("ratio"),
    )


@R.add(
    """SELECT source, lang, count(*) AS n, sum(n_chars)::BIGINT AS chars, grouping_id(source, lang)::BIGINT AS level FROM documents
    GROUP BY ROLLUP (source, lang) HAVING count(*) > 3"""
)
def crawl_rollup(spark, d):
    g = table(spark, d, "documents").rollup("source", "lang").agg(
        F.count("*").alias("n"), F.sum("n_chars").alias("chars"), F.grouping_id().alias("level")
    )
    return g.where("n > 3")


@R.add("SELECT lang, o AS odd, count(*) AS n FROM (SELECT lang, doc_id % 2 AS o FROM documents) GROUP BY CUBE (lang, o)")
def crawl_cube(spark, d):
    return table(spark, d, "documents").select("lang", (F.col("doc_id") % 2).alias("odd")).cube("lang", "odd").agg(F.count("*").alias("n"))


@R.add(
    D.with_ctes(D.MATCHES)
    + """, c AS (SELECT *, CAST(1000 + job_id % 700 AS DOUBLE) / 1000 AS cost FROM matches),
    run AS (SELECT *, coalesce(sum(cost) OVER (PARTITION BY resume_id ORDER BY final_score DESC, job_id
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM c)
    SELECT job_id, resume_id, round(spent, 6) AS spent FROM run WHERE round(spent, 9) < 20"""
)
def judge_budget_prefix(spark, d):
    m = D.matches(spark, d).withColumn("cost", (F.lit(1000) + F.col("job_id") % 700).cast("double") / 1000)
    kept = W.within_budget(m, ["resume_id"], [F.desc("final_score"), F.asc("job_id")], "cost", 20.0)
    return kept.select("job_id", "resume_id", F.round("spent", 6).alias("spent"))


@R.add(
    """WITH t AS (SELECT doc_id, source, CAST(floor(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE) AS BIGINT) AS tokens
      FROM documents),
    r AS (SELECT *, sum(tokens) OVER (PARTITION BY source ORDER BY doc_id) <= 5000 AS fits FROM t),
    p AS (SELECT *, bool_and(fits) OVER (PARTITION BY source ORDER BY doc_id) AS keep FROM r)
    SELECT doc_id, source, tokens FROM p WHERE keep"""
)
def token_budget_prefix(spark, d):
    from larkmill.functions.text import token_estimate

    docs = table(spark, d, "documents").select("doc_id", "source", token_estimate(F.col("text")).alias("tokens"))
    return W.prefix_that_fits(docs, ["source"], [F.asc("doc_id")], "tokens", 5000).select("doc_id", "source", "tokens")


@R.add(
    """WITH c AS (SELECT *, count(*) OVER w AS calls, count(*) FILTER (event_type = 'error') OVER w AS errors
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 49 PRECEDING AND CURRENT ROW))
    SELECT event_id, user_id, calls, errors, round(errors / calls, 6) AS error_rate FROM c"""
)
def last_50_calls_error_rate(spark, d):
    return W.recent_error_rate(table(spark, d, "events"), "user_id", ["ts", "event_id"], F.col("event_type") == "error", 50)


@R.add(
    """WITH c AS (SELECT event_id, user_id, CAST(floor(epoch(ts)) AS BIGINT) AS s, ts FROM events),
    n AS (SELECT *, count(*) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS calls,
      min(s) OVER (PARTITION BY user_id ORDER BY s RANGE BETWEEN 86400 PRECEDING AND CURRENT ROW) AS oldest FROM c)
    SELECT event_id, user_id, calls, calls > 3 AS limited, CASE WHEN calls > 3 THEN oldest + 86400 - s ELSE 0 END AS wait_s FROM n"""
)
def rate_limit_sliding(spark, d):
    return W.sliding_limit(table(spark, d, "events"), "event_id", "user_id", "ts", 86400, 3)


@R.add(
    """SELECT user_id, date_trunc('day', ts) AS day, count(*) AS used, greatest(count(*) - 2, 0) AS over
    FROM events GROUP BY 1, 2"""
)
def quota_fixed_window(spark, d):
    return W.fixed_quota(table(spark, d, "events"), "user_id", "ts", 2)


@R.add(
    """WITH f AS (SELECT *, event_type = 'error' AS bad,
      sum(CASE WHEN event_type = 'error' THEN 0 ELSE 1 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM events),
    k AS (SELECT *, count(*) FILTER (bad) OVER (PARTITION BY user_id, island ORDER BY ts, event_id) AS streak FROM f)
    SELECT event_id, user_id, CASE WHEN bad THEN streak ELSE 0 END AS streak, bad AND streak >= 2 AS opened FROM k"""
)
def circuit_breaker_islands(spark, d):
    return W.failure_streaks(table(spark, d, "events"), "event_id", "user_id", ["ts", "event_id"], F.col("event_type") == "error", 2)


@R.add(
    """WITH g AS (SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) <= INTERVAL 30 MINUTES THEN 0 ELSE 1 END AS fresh
      FROM events), s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM g)
    SELECT user_id, min(ts) AS started, max(ts) AS last_seen, count(*) AS n FROM s GROUP BY user_id, sid"""
)
def activity_sessions(spark, d):
    return W.sessions(table(spark, d, "events"), "user_id", "ts", 30)


@R.add(
    """SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"""
)
def tumbling_counts(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "1 day").alias("w"), "event_type")
    return e.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(
        F.col("w.start").alias("start"), "event_type", "n", "total"
    )


@R.add(
    """SELECT date_trunc('day', ts) - k * INTERVAL 1 DAY AS start, count(*) AS n
    FROM events, (SELECT unnest([0, 1]) AS k) GROUP BY 1"""
)
def sliding_counts(spark, d):
    e = table(spark, d, "events").groupBy(F.window("ts", "2 days", "1 day").alias("w")).agg(F.count("*").alias("n"))
    return e.select(F.col("w.start").alias("start"), "n")


@R.add(
    D.with_ctes(D.MATCHES)
    + """, a AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY fts_score DESC, job_id) AS r1 FROM matches),
    b AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY vector_score DESC, job_id) AS r2 FROM a WHERE r1 <= 30),
    c AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY final_score DESC, llm_score DESC, vector_score DESC, job_id) AS r3 FROM b WHERE r2 <= 10)
    SELECT resume_id, job_id, r3 AS rank FROM c WHERE r3 <= 3"""
)
def top_k_cascade(spark, d):
    from larkmill.operators.retrieval import top_k

    m = D.matches(spark, d)
    m = top_k(m, "resume_id", 30, F.desc("fts_score"), F.asc("job_id"), rank="r1")
    m = top_k(m, "resume_id", 10, F.desc("vector_score"), F.asc("job_id"), rank="r2")
    order = (F.desc("final_score"), F.desc("llm_score"), F.desc("vector_score"), F.asc("job_id"))
    return top_k(m, "resume_id", 3, *order).select("resume_id", "job_id", F.col("rank").cast("long").alias("rank"))


@R.add(
    """WITH v AS (SELECT item_id % 7 AS family, item_id, length(text) AS size FROM benchmark)
    SELECT family, max(item_id) AS newest, arg_max(size, item_id) AS size FROM v GROUP BY family"""
)
def latest_by_created(spark, d):
    v = table(spark, d, "benchmark").select((F.col("item_id") % 7).alias("family"), "item_id", F.length("text").cast("long").alias("size"))
    return v.groupBy("family").agg(F.max("item_id").alias("newest"), F.max_by("size", "item_id").alias("size"))


@R.add("SELECT vec_id, CAST((row_number() OVER (ORDER BY vec_id) - 1) // 100 AS BIGINT) AS batch FROM embeddings WHERE label % 3 = 0")
def reembed_backlog_batches(spark, d):
    return W.batches(table(spark, d, "embeddings").where("label % 3 = 0"), "vec_id", 100)


@R.add(
    """SELECT doc_id, source FROM documents ORDER BY n_chars, doc_id LIMIT 500"""
)
def oldest_first_batch(spark, d):
    return table(spark, d, "documents").orderBy("n_chars", "doc_id").limit(500).select("doc_id", "source")


@R.add("SELECT s_name, s_suppkey FROM supplier ORDER BY s_name, s_suppkey LIMIT 50")
def companies_by_name(spark, d):
    return table(spark, d, "supplier").orderBy("s_name", "s_suppkey").limit(50).select("s_name", "s_suppkey")


@R.add(
    """WITH r AS (SELECT user_id, event_id, value, ntile(10) OVER (ORDER BY ts, event_id) AS tenth FROM events)
    SELECT tenth::BIGINT AS tenth, count(*) AS n, tenth = 1 AS evicted FROM r GROUP BY tenth"""
)
def evict_oldest_tenth(spark, d):
    return W.oldest_share(table(spark, d, "events"), ["ts", "event_id"], 10)


@R.add(
    """SELECT l_suppkey AS k FROM lineitem WHERE l_shipdate >= TIMESTAMP '1995-01-01' INTERSECT
    SELECT s_suppkey FROM supplier WHERE s_acctbal > 0"""
)
def set_intersect(spark, d):
    a = table(spark, d, "lineitem").where(F.col("l_shipdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    b = table(spark, d, "supplier").where("s_acctbal > 0").select("s_suppkey")
    return a.select(F.col("l_suppkey").alias("k")).intersect(b)


@R.add("SELECT l_partkey AS k FROM lineitem WHERE l_quantity > 49 EXCEPT SELECT l_partkey FROM lineitem WHERE l_discount > 0.08")
def set_except(spark, d):
    e = table(spark, d, "lineitem")
    return e.where("l_quantity > 49").select(F.col("l_partkey").alias("k")).subtract(e.where("l_discount > 0.08").select("l_partkey"))


@R.add(
    """SELECT 'doc' AS kind, doc_id AS id, md5(text) AS digest FROM documents UNION ALL
    SELECT 'item', item_id, md5(text) FROM benchmark"""
)
def union_sources(spark, d):
    a = table(spark, d, "documents").select(F.lit("doc").alias("kind"), F.col("doc_id").alias("id"), F.md5("text").alias("digest"))
    b = table(spark, d, "benchmark").select(F.lit("item").alias("kind"), F.col("item_id").alias("id"), F.md5("text").alias("digest"))
    return a.unionByName(b)


@R.add(
    """SELECT p_partkey, list_sort(list_distinct(list_intersect(a, b))) AS shared, len(list_distinct(a || b))::BIGINT AS n_union,
      round(len(list_distinct(list_intersect(a, b))) / len(list_distinct(a || b)), 6) AS jaccard
    FROM (SELECT p_partkey, string_split(p_name, ' ') || [p_brand] AS a, string_split(p_type, ' ') || [p_brand] AS b FROM part)"""
)
def skill_set_operations(spark, d):
    p = table(spark, d, "part").select(
        "p_partkey", F.concat(F.split("p_name", " "), F.array("p_brand")).alias("a"),
        F.concat(F.split("p_type", " "), F.array("p_brand")).alias("b"),
    )
    both, one = F.array_intersect("a", "b"), F.array_union("a", "b")
    return p.select(
        "p_partkey", F.array_sort(both).alias("shared"), F.size(one).cast("long").alias("n_union"),
        F.round(F.size(both) / F.size(one), 6).alias("jaccard"),
    )


@R.add(
    D.with_ctes(D.MATCHES)
    + """, s AS (SELECT *, max(vector_score) OVER (PARTITION BY resume_id) AS mv, max(fts_score) OVER (PARTITION BY resume_id) AS mf FROM matches)
    SELECT job_id, resume_id, round(0.6 * CASE WHEN mv > 0 THEN vector_score / mv ELSE 0 END + 0.3 * CASE WHEN mf > 0 THEN fts_score / mf ELSE 0 END
      + 0.1 * (job_id % 10) / 10.0::DOUBLE, 6) AS score FROM s"""
)
def hybrid_rerank_normalised(spark, d):
    from larkmill.functions.scores import hybrid_rerank, ratio

    w = Window.partitionBy("resume_id")
    top = lambda c: ratio(F.col(c), F.max(c).over(w))
    score = hybrid_rerank(top("vector_score"), top("fts_score"), F.col("job_id") % 10 / 10.0)
    return D.matches(spark, d).select("job_id", "resume_id", F.round(score, 6).alias("score"))


@R.add(
    """WITH w AS (SELECT l_suppkey, l_shipdate, l_orderkey, l_linenumber FROM lineitem),
    v AS (SELECT s_suppkey, DATE '1992-01-01' + CAST(k * 700 AS INTEGER) AS since, k FROM supplier, (SELECT unnest([0, 1, 2, 3]) AS k)),
    h AS (SELECT *, lead(since) OVER (PARTITION BY s_suppkey ORDER BY since) AS till FROM v)
    SELECT l_orderkey, l_linenumber::BIGINT AS l_linenumber, k::BIGINT AS version FROM w JOIN h
    ON l_suppkey = s_suppkey AND since <= l_shipdate AND (till IS NULL OR l_shipdate < till)"""
)
def weights_as_of(spark, d):
    from larkmill.operators.tables import as_of

    line = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("k"), F.col("l_shipdate").alias("at"))
    v = table(spark, d, "supplier").select("s_suppkey", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("version"))
    since = F.date_add(F.lit("1992-01-01").cast("date"), F.col("version") * 700).cast("timestamp_ntz")
    v = v.select(F.col("s_suppkey").alias("k"), since.alias("at"), F.col("version").cast("long").alias("version"))
    return as_of(line, v, "k", "at", ["version"]).select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "version")
