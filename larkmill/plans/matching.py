"""Matching, scoring and feedback queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkmill.functions import scores as S
from larkmill.functions import text as T
from larkmill.operators import feedback as FB
from larkmill.operators import matching as M
from larkmill.plans import domain as D
from larkmill.plans.registry import Registry
from larkmill.session import cut_lineage, table

R = Registry()
STOP = "['the', 'and', 'or', 'but', 'with', 'for', 'of', 'to', 'in', 'on', 'at']"


def job_side(spark, d):
    return D.jobs(spark, d).join(D.companies(spark, d), "company_id")


def resume_side(spark, d):
    own = F.array_distinct(F.slice(T.split_words(F.lower("fulltext")), 1, 12))
    return D.resumes(spark, d).withColumn("own_skills", own)


CFG = M.MatchConfig(judge_min_score=45, max_cost_cents=0.3).checked()


def hybrid_sql(cfg: M.MatchConfig) -> str:
    """The stages as tables: f2 by words, v2 by vectors, b judged, z kept."""
    return (
        D.with_ctes(D.COMPANIES, D.JOBS, D.CHUNKS, D.RESUMES)
        + rf""", q AS (SELECT resume_id, list_distinct(list_filter(string_split_regex(lower(fulltext), '\s+'), lambda w: length(w) > 2 AND NOT list_contains({STOP}, w))[1:{cfg.query_terms}]) AS terms FROM resumes),
  qt AS (SELECT resume_id, len(terms) AS n, unnest(terms) AS term FROM q),
  t AS (SELECT job_id, unnest(list_filter(string_split_regex(lower(description), '\s+'), lambda w: w <> '')) AS term FROM jobs),
  tf AS (SELECT job_id, term, count(*) AS tf FROM t WHERE term IN (SELECT term FROM qt) GROUP BY job_id, term),
  fts AS (SELECT resume_id, job_id, round(sum(tf / (tf + 1)) / n, 9) AS fts_score FROM qt JOIN tf USING (term) GROUP BY resume_id, job_id, n HAVING count(*) = n),
  f2 AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY fts_score DESC, job_id) AS fr FROM fts QUALIFY fr <= {cfg.fts_limit}),
  v AS (SELECT f2.resume_id, f2.job_id, fts_score, max(coalesce(round(list_cosine_similarity(resume_vector::DOUBLE[], embedding::DOUBLE[]), 9), 0)) AS vector_score
    FROM f2 JOIN resumes r ON r.resume_id = f2.resume_id LEFT JOIN chunks c ON c.job_id = f2.job_id GROUP BY f2.resume_id, f2.job_id, fts_score),
  v2 AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY vector_score DESC, job_id) AS vr FROM v QUALIFY vr <= {cfg.vector_limit}),
  p AS (SELECT v2.*, 'Rate the fit of a candidate with a job from 0 to 100. Weigh skills, seniority level, role.' || chr(10) || 'Title: ' || title || chr(10) || 'Company: ' || company
      || chr(10) || 'Required skills: ' || array_to_string(list_filter(skills_raw, lambda x, i: list_position(skills_raw, x) = i), ', ') || chr(10) || 'Seniority: ' || seniority || chr(10) || 'Description: ' || left(description, 500) || '...'
      || chr(10) || 'Skills: ' || array_to_string(own, ', ') || chr(10) || 'Experience: ' || CASE WHEN years = 0 THEN 'Not specified' ELSE years::VARCHAR END || ' years'
      || chr(10) || 'Education: Not specified' || chr(10) || 'Preferred roles: ' AS prompt
    FROM (SELECT * FROM v2 WHERE vr <= {cfg.judge_limit}) v2 JOIN jobs USING (job_id) JOIN companies USING (company_id)
    JOIN (SELECT resume_id, years, list_filter(w12, lambda x, i: list_position(w12, x) = i) AS own FROM (SELECT resume_id, years, list_filter(string_split_regex(lower(fulltext), '\s+'), lambda w: w <> '')[1:12] AS w12 FROM resumes)) USING (resume_id)),
  c AS (SELECT *, round(len(list_filter(string_split_regex(prompt, '\s+'), lambda w: w <> '')) * 1.3::DOUBLE / 1000 * 0.2::DOUBLE, 9) AS cost FROM p),
  b AS (SELECT *, round(coalesce(sum(cost) OVER (PARTITION BY resume_id ORDER BY vector_score DESC, job_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 9) AS spent FROM c QUALIFY spent < {cfg.max_cost_cents or 1e9}),
  j AS (SELECT *, lower(prompt) AS low, TRY_CAST(regexp_extract(lower(prompt), 'experience: (\d+)', 1) AS INTEGER) AS y FROM b),
  k AS (SELECT *, least(50 + 10 * (contains(low, 'python')::INT + contains(low, 'javascript')::INT + contains(low, 'java')::INT + contains(low, 'react')::INT + contains(low, 'sql')::INT
      + contains(low, 'aws')::INT + contains(low, 'docker')::INT + contains(low, 'kubernetes')::INT), 90) AS base FROM j),
  s AS (SELECT *, greatest(0, least(100, CASE WHEN contains(low, 'experience: 0') THEN greatest(base - 30, 20) WHEN y >= 5 THEN least(base + 10, 95)
      WHEN y < 2 AND (contains(low, 'junior') OR contains(low, 'entry') OR contains(low, '0-2') OR contains(low, 'intern')) THEN least(base + 5, 90) ELSE base END
      + CAST('0x' || substr(md5(prompt), 1, 2) AS INTEGER) % 20 - 10)) AS llm_score FROM k),
  z AS (SELECT *, round(fts_score * 0.2::DOUBLE + vector_score * 0.3::DOUBLE + llm_score / 100.0::DOUBLE * 0.5::DOUBLE, 6) AS final_score FROM s WHERE llm_score >= {cfg.judge_min_score})"""
    )


@R.add(
    hybrid_sql(CFG)
    + f"""SELECT resume_id, job_id, row_number() OVER (PARTITION BY resume_id ORDER BY final_score DESC, llm_score DESC, vector_score DESC, job_id) AS rank,
    round(fts_score, 6) AS fts_score, round(vector_score, 6) AS vector_score, llm_score::BIGINT AS llm_score, final_score,
    CASE WHEN llm_score >= 85 AND final_score >= 0.8 THEN 'APPLY_HIGH' WHEN llm_score >= 70 AND final_score >= 0.6 THEN 'APPLY_MEDIUM' WHEN llm_score >= 60 AND final_score >= 0.4 THEN 'REVIEW' ELSE 'SKIP' END AS action
  FROM z QUALIFY rank <= {CFG.judge_limit}"""
)
def hybrid_match_topk(spark, d):
    found = M.hybrid_match(resume_side(spark, d), job_side(spark, d), D.chunks(spark, d), CFG, texts=D.jobs(spark, d))
    return found.select(
        "resume_id", "job_id", F.col("rank").cast("long").alias("rank"), F.round("fts_score", 6).alias("fts_score"),
        F.round("vector_score", 6).alias("vector_score"), "llm_score", "final_score", "action",
    )


STAGES_CFG = M.MatchConfig().checked()


@R.add(
    hybrid_sql(STAGES_CFG)
    + """SELECT resume_id, stage, count(*) AS n FROM (SELECT resume_id, 'fts' AS stage FROM f2 UNION ALL SELECT resume_id, 'vector' FROM v2
    UNION ALL SELECT resume_id, 'judge' FROM b UNION ALL SELECT resume_id, 'kept' FROM z) GROUP BY resume_id, stage"""
)
def hybrid_stage_counts(spark, d):
    """Under the operator's own limits, without a budget."""
    return M.stage_counts(resume_side(spark, d), job_side(spark, d), D.chunks(spark, d), STAGES_CFG, texts=D.jobs(spark, d))


PAIR = """pairs_in AS (SELECT d.doc_id AS job_id, b.item_id AS resume_id FROM documents d JOIN benchmark b ON b.item_id = d.doc_id % (SELECT count(*) FROM benchmark)),
  parts AS (SELECT p_partkey, list_distinct(string_split(p_name, ' ') || [p_brand]) AS skills FROM part),
  side AS (SELECT job_id, resume_id, j.skills AS job_skills, r.skills AS own_skills, CAST(resume_id % 12 AS DOUBLE) AS years,
    ['entry', 'junior', 'mid', 'senior', 'staff', 'principal'][job_id % 6 + 1] AS seniority
    FROM pairs_in JOIN parts j ON j.p_partkey = job_id % (SELECT count(*) FROM part) + 1 JOIN parts r ON r.p_partkey = resume_id + 1)"""


def skill_pairs(spark, d):
    n, m = table(spark, d, "benchmark").count(), table(spark, d, "part").count()
    parts = table(spark, d, "part").select("p_partkey", F.array_distinct(F.concat(F.split("p_name", " "), F.array("p_brand"))).alias("s"))
    pairs = table(spark, d, "documents").select(F.col("doc_id").alias("job_id"), (F.col("doc_id") % n).alias("resume_id"))
    j = parts.select(F.col("p_partkey").alias("jk"), F.col("s").alias("job_skills"))
    r = parts.select(F.col("p_partkey").alias("rk"), F.col("s").alias("own_skills"))
    both = pairs.join(j, F.col("jk") == F.col("job_id") % m + 1).join(r, F.col("rk") == F.col("resume_id") + 1)
    level = F.element_at(F.array(*[F.lit(x) for x in D.LEVELS]), (F.col("job_id") % 6 + 1).cast("int"))
    return both.select(
        "job_id", "resume_id", "job_skills", "own_skills", (F.col("resume_id") % 12).cast("double").alias("years"),
        level.alias("seniority"), F.lit("").alias("location"),
    )


BASIC = (
    D.with_ctes(PAIR)
    + """, s AS (SELECT *, least(len(list_intersect(own_skills, job_skills)) / len(job_skills), 1.0) AS skill,
      CASE WHEN seniority = 'senior' THEN CASE WHEN years >= 5 THEN 1.0 ELSE greatest(years / 5 * 0.7::DOUBLE, 0.1) END
        WHEN seniority = 'mid' THEN CASE WHEN years >= 3 THEN 1.0 ELSE greatest(years / 3 * 0.7::DOUBLE, 0.1) END
        WHEN seniority IN ('junior', 'entry') THEN CASE WHEN years >= 1 THEN 1.0 ELSE 0.1 END ELSE 0.5 END AS exp FROM side),
    t AS (SELECT *, 0.7::DOUBLE * skill + 0.3::DOUBLE * exp AS score FROM s),
    best AS (SELECT *, row_number() OVER (PARTITION BY resume_id ORDER BY round(score, 9) DESC, job_id) AS rank FROM t WHERE round(score, 9) >= 0.25 QUALIFY rank <= 20)
    """
)


@R.add(BASIC + "SELECT resume_id, job_id, round(skill, 6) AS skill_score, round(exp, 6) AS experience_score, round(score, 6) AS score, rank FROM best")
def basic_skill_match(spark, d):
    found = M.basic_match(skill_pairs(spark, d), M.MatchConfig(min_score=0.25, max_results=20))
    return found.select(
        "resume_id", "job_id", F.round("skill_score", 6).alias("skill_score"), F.round("experience_score", 6).alias("experience_score"),
        F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"),
    )


@R.add(
    BASIC
    + """SELECT resume_id, job_id, CASE WHEN len(list_intersect(own_skills, job_skills)) > 0 THEN 'Skills match: ' || array_to_string(list_sort(list_intersect(own_skills, job_skills)), ', ') || ' (' || printf('%.2f', round(skill, 2)) || ')'
        ELSE 'Limited skill overlap (' || printf('%.2f', round(skill, 2)) || ')' END
      || '; Experience level: ' || CASE WHEN exp > 0.8 THEN 'good' WHEN exp > 0.5 THEN 'adequate' ELSE 'limited' END || ' match (' || printf('%.2f', round(exp, 2)) || ')' AS reasoning FROM best"""
)
def basic_match_reasoning(spark, d):
    return M.basic_match(skill_pairs(spark, d), M.MatchConfig(min_score=0.25, max_results=20)).select("resume_id", "job_id", "reasoning")


FIVE = (
    D.with_ctes(PAIR)
    + """, f AS (SELECT *, len(list_intersect(own_skills, job_skills[1:3])) / len(job_skills[1:3]) AS req,
      CASE WHEN len(job_skills) > 3 THEN len(list_intersect(own_skills, job_skills[4:])) / len(job_skills[4:]) ELSE 0 END AS pref,
      job_id % 7 AS need FROM side),
    g AS (SELECT *, CASE WHEN need > 0 THEN least(years / need, 1.0) ELSE 1.0 END AS exp,
      CASE seniority WHEN 'entry' THEN 0 WHEN 'junior' THEN 1 WHEN 'mid' THEN 2 WHEN 'senior' THEN 5 WHEN 'staff' THEN 8 ELSE 12 END AS lo,
      CASE seniority WHEN 'entry' THEN 2 WHEN 'junior' THEN 3 WHEN 'mid' THEN 6 WHEN 'senior' THEN 12 WHEN 'staff' THEN 20 ELSE 25 END AS hi FROM f),
    h AS (SELECT *, CASE WHEN years >= lo AND years <= hi THEN 1.0 WHEN years < lo THEN greatest(0, years / lo) ELSE greatest(0.7, 1 - (years - hi) / 10) END AS fit FROM g),
    i AS (SELECT *, req * 0.4::DOUBLE + exp * 0.25::DOUBLE + pref * 0.15::DOUBLE + fit * 0.1::DOUBLE + 0.5::DOUBLE * 0.1::DOUBLE AS score, len(list_intersect(own_skills, job_skills[1:3])) AS n_req FROM h)"""
)


def five(spark, d):
    p = skill_pairs(spark, d)
    req, pref = F.slice("job_skills", 1, 3), F.slice("job_skills", 4, 100)
    need = F.col("job_id") % 7
    shared = lambda x: F.size(F.array_intersect("own_skills", x))
    parts = {
        "req": S.ratio(shared(req), F.size(req)), "pref": S.ratio(shared(pref), F.size(pref)), "n_req": shared(req),
        "exp": F.when(need > 0, F.least(F.col("years") / need, F.lit(1.0))).otherwise(1.0),
        "fit": S.seniority_fit(F.col("years"), F.col("seniority")),
        "dom": S.domain_relevance(F.lit("x"), F.lit("y")),
        "missing": F.array_except(req, "own_skills"), "matched": F.array_intersect(req, "own_skills"), "wanted": req,
        "missing_pref": F.array_except(pref, "own_skills"), "need": need,
    }
    return p.withColumns(parts).withColumn("score", S.five_factor(*[F.col(c) for c in ("req", "exp", "pref", "fit", "dom")]))


@R.add(
    FIVE
    + """ SELECT job_id, resume_id, round(req, 6) AS req, round(exp, 6) AS exp, round(pref, 6) AS pref, round(fit, 6) AS fit, round(score, 6) AS score,
      round(least(req * 0.7::DOUBLE + exp * 0.3::DOUBLE + len(list_intersect(own_skills, job_skills[4:])) * 0.1::DOUBLE, 1.0), 6) AS two FROM i"""
)
def five_factor_score(spark, d):
    pref_n = F.size(F.array_intersect("own_skills", F.slice("job_skills", 4, 100)))
    cols = [F.round(c, 6).alias(c) for c in ("req", "exp", "pref", "fit", "score")]
    return five(spark, d).select("job_id", "resume_id", *cols, F.round(S.two_factor(F.col("req"), F.col("exp"), pref_n), 6).alias("two"))


@R.add(
    FIVE
    + """ SELECT job_id, resume_id, CASE WHEN s >= 0.8 AND n_req >= 3 * 0.8 THEN 'High' WHEN s >= 0.6 AND n_req >= 3 * 0.6 THEN 'Medium' WHEN s >= 0.4 THEN 'Low' ELSE 'Very Low' END AS confidence
      FROM (SELECT *, round(score, 9) AS s FROM i)"""
)
def confidence_label(spark, d):
    return five(spark, d).select("job_id", "resume_id", S.confidence(F.round("score", 9), F.col("n_req"), F.size("wanted")).alias("confidence"))


@R.add(
    FIVE
    + """, l AS (SELECT *, list_sort(list_filter(job_skills[1:3], lambda x: NOT list_contains(own_skills, x))) AS gap, list_sort(list_filter(job_skills[4:], lambda x: NOT list_contains(own_skills, x))) AS wish FROM i)
    SELECT job_id, resume_id, list_filter([CASE WHEN len(gap) > 0 THEN 'Focus on developing: ' || array_to_string(gap[1:3], ', ') END,
      CASE WHEN years < need THEN 'Gain ' || (need - years)::INTEGER || ' more years of relevant experience' END,
      CASE WHEN n_req >= len(job_skills[1:3]) * 0.7 THEN 'Strong technical foundation - highlight relevant projects' END,
      CASE WHEN len(wish) BETWEEN 1 AND 3 THEN 'Consider learning: ' || array_to_string(wish[1:2], ', ') END], lambda x: x IS NOT NULL) AS advice FROM l"""
)
def recommendations_list(spark, d):
    advice = S.recommendations(F.col("missing"), F.col("matched"), F.col("wanted"), F.col("missing_pref"), F.col("years").cast("int"), F.col("need").cast("int"))
    return five(spark, d).select("job_id", "resume_id", advice.alias("advice"))


@R.add(
    FIVE
    + """ SELECT skill, count(*) AS n, round(count(*) / (SELECT count(*) FROM i) * 100, 4) AS percent FROM
      (SELECT unnest(list_filter(job_skills[1:3], lambda x: NOT list_contains(own_skills, x))) AS skill FROM i) GROUP BY skill ORDER BY n DESC, skill LIMIT 5"""
)
def top_missing_skills(spark, d):
    f = five(spark, d)
    total = f.count()
    g = f.select(F.explode("missing").alias("skill")).groupBy("skill").agg(F.count("*").alias("n"))
    return g.withColumn("percent", F.round(F.col("n") / total * 100, 4)).orderBy(F.desc("n"), "skill").limit(5)


@R.add(
    """SELECT conv_id, turn, CAST(greatest(0, least(100, least(50 + 10 * (contains(low, 'python')::INT + contains(low, 'javascript')::INT + contains(low, 'java')::INT + contains(low, 'react')::INT
      + contains(low, 'sql')::INT + contains(low, 'aws')::INT + contains(low, 'docker')::INT + contains(low, 'kubernetes')::INT), 90) + CAST('0x' || substr(md5(text), 1, 2) AS INTEGER) % 20 - 10)) AS BIGINT) AS score,
      CAST('0x' || substr(md5(text), 1, 2) AS BIGINT) % 40 + 60 AS critique, round(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) * 1.3::DOUBLE / 1000 * 0.2::DOUBLE, 9) AS cost
    FROM (SELECT conv_id, turn, text, lower(text) AS low FROM conversations)"""
)
def judge_heuristic(spark, d):
    t = F.col("text")
    return table(spark, d, "conversations").select(
        "conv_id", "turn", S.heuristic_judge(t).cast("long").alias("score"), S.critique_score(t).cast("long").alias("critique"),
        F.round(S.judge_cost(t), 9).alias("cost"),
    )


def features(spark, d):
    m = D.matches(spark, d).join(D.jobs(spark, d), "job_id").join(D.companies(spark, d), "company_id")
    m = m.join(D.resumes(spark, d).select("resume_id", "fulltext", "years"), "resume_id").join(
        table(spark, d, "labels").withColumnRenamed("doc_id", "job_id"), "job_id", "left"
    )
    places = F.array(*[F.lit(x) for x in ("remote", "hybrid", "onsite")])
    at = lambda k: F.element_at(places, (k % 3 + 1).cast("int"))
    return m.select(
        "job_id", "resume_id", "vector_score", "llm_score", (F.col("job_id") % 1200).alias("fts_rank"),
        (F.col("job_id") % 9).cast("double").alias("required_yoe"), F.col("years").alias("candidate_yoe"),
        F.col("skills").alias("required_skills"), T.split_words(F.lower("fulltext")).alias("candidate_skills"),
        F.col("title").alias("job_title"), F.substring("fulltext", 1, 40).alias("resume_title"),
        F.when(F.col("job_id") % 4 == 0, F.concat("company", F.lit(" public"))).otherwise(F.col("company")).alias("company"),
        F.col("seniority").alias("job_seniority"), F.lit("mid").alias("candidate_level"),
        at(F.col("job_id")).alias("location"), at(F.col("resume_id")).alias("location_pref"), "posted_date",
        (F.col("quality") == 1).alias("got_interview"),
    )


FEATURE_SQL = (
    D.with_ctes(D.COMPANIES, D.JOBS, D.RESUMES, D.MATCHES)
    + r""", x AS (SELECT m.job_id, m.resume_id, m.vector_score, m.llm_score / 100.0::DOUBLE AS llm_score, greatest(0, 1 - (m.job_id % 1200) / 1000.0::DOUBLE) AS fts_rank_norm,
      abs(m.job_id % 9 - r.years) AS gap, abs(m.job_id % 9 - r.years) / greatest(m.job_id % 9, 1) AS gap_ratio, list_distinct(j.skills_raw) AS need,
      list_distinct(list_filter(string_split_regex(lower(r.fulltext), '\s+'), lambda w: w <> '')) AS own, j.title, left(r.fulltext, 40) AS rt,
      CASE WHEN m.job_id % 4 = 0 THEN 0.7 ELSE 0.3 END AS tier, j.seniority, ['remote', 'hybrid', 'onsite'][m.job_id % 3 + 1] AS loc, ['remote', 'hybrid', 'onsite'][m.resume_id % 3 + 1] AS pref,
      date_diff('day', j.posted_date, DATE '2025-01-10') AS age, l.quality = 1 AS y
    FROM matches m JOIN jobs j USING (job_id) JOIN companies c ON c.company_id = j.company_id JOIN resumes r ON r.resume_id = m.resume_id LEFT JOIN labels l ON l.doc_id = m.job_id),
  jac AS (SELECT *, len(list_intersect(need, own)) AS shared, list_distinct(list_filter(string_split_regex(lower(title), '\s+'), lambda w: w <> '')) AS a,
    list_distinct(list_filter(string_split_regex(lower(rt), '\s+'), lambda w: w <> '')) AS b,
    CASE WHEN len(list_intersect(need, ['python', 'sql', 'aws', 'kubernetes', 'react', 'node.js'])) > 0 THEN len(list_intersect(list_intersect(need, own), ['python', 'sql', 'aws', 'kubernetes', 'react', 'node.js'])) / len(list_intersect(need, ['python', 'sql', 'aws', 'kubernetes', 'react', 'node.js'])) ELSE 1.0 END AS critical FROM x),
  feat AS (SELECT job_id, resume_id, vector_score, llm_score, fts_rank_norm, gap AS yoe_gap, gap_ratio AS yoe_gap_ratio,
    greatest(0, 1 - abs(CASE seniority WHEN 'junior' THEN 2 WHEN 'mid' THEN 3 WHEN 'senior' THEN 4 WHEN 'staff' THEN 5 WHEN 'principal' THEN 6 ELSE 3 END - 3) * 0.2::DOUBLE) AS seniority_match,
    shared::DOUBLE AS skill_overlap_count, shared / greatest(len(need), 1) AS skill_overlap_ratio, critical AS critical_skill_match,
    CASE WHEN len(a) > 0 AND len(b) > 0 THEN len(list_intersect(a, b)) / len(list_distinct(a || b)) ELSE 0 END AS title_similarity, tier::DOUBLE AS company_tier_match,
    CASE WHEN loc = pref THEN 1.0 WHEN loc = 'hybrid' AND pref = 'remote' THEN 0.8 WHEN loc = 'onsite' AND pref = 'hybrid' THEN 0.6 WHEN loc = 'onsite' AND pref = 'remote' THEN 0.2 ELSE 0.5 END::DOUBLE AS location_preference_match,
    age::DOUBLE AS job_recency_days, least(1.0, (tier + greatest(0, (30 - age) / 30.0)) / 2.0)::DOUBLE AS application_competition, y FROM jac)"""
)


@R.add(FEATURE_SQL + "SELECT job_id, resume_id, " + ", ".join(f"round({f}, 6) AS {f}" for f in FB.FEATURES) + " FROM feat")
def feature_vector(spark, d):
    f = FB.feature_columns(features(spark, d), "2025-01-10")
    return f.select("job_id", "resume_id", *[F.round(c, 6).alias(c) for c in FB.FEATURES])


@R.add(
    FEATURE_SQL
    + ", s AS (SELECT *, round(1 / (1 + exp(-("
    + " + ".join(f"{k} * {w}::DOUBLE" for k, w in S.HEURISTIC_WEIGHTS.items())
    + "))), 9) AS p FROM feat) SELECT resume_id, job_id, row_number() OVER (PARTITION BY resume_id ORDER BY p DESC, job_id) AS rank, round(p, 6) AS final_score FROM s QUALIFY rank <= 5"
)
def heuristic_weight_rank(spark, d):
    f = FB.feature_columns(features(spark, d), "2025-01-10").select("resume_id", "job_id", *S.HEURISTIC_WEIGHTS)
    packed = F.create_map(*[x for k, w in S.HEURISTIC_WEIGHTS.items() for x in (F.lit(k), F.lit(w))])
    w = spark.range(1).select(F.lit(1).alias("created_at"), packed.alias("weights"), F.lit("heuristic_v1").alias("model_version"))
    ranked = M.adaptive_rank(f, w, "resume_id", "job_id", 5)
    return ranked.select("resume_id", "job_id", F.col("rank").cast("long").alias("rank"), F.round("final_score", 6).alias("final_score"))


@R.add(
    """WITH m AS (SELECT event_type AS name, round(avg(value), 9) AS weight FROM events WHERE event_type IS NOT NULL AND value IS NOT NULL GROUP BY event_type)
    SELECT name, weight, row_number() OVER (ORDER BY abs(weight) DESC, name) AS place FROM m"""
)
def feature_importance(spark, d):
    """Kinds of event by the weight of their values, the mean, as a model ranks its features."""
    mean = table(spark, d, "events").where("event_type IS NOT NULL AND value IS NOT NULL").groupBy("event_type").agg(F.round(F.avg("value"), 9).alias("w"))
    model = FB.WeightModel({r["event_type"]: r["w"] for r in mean.collect()}, "means")  # a weight for each kind
    ranked = [(name, weight, place) for place, (name, weight) in enumerate(model.importance(), 1)]
    return spark.createDataFrame(ranked, "name string, weight double, place long")


@R.add(
    """WITH s AS (SELECT quality AS y, CAST('0x' || substr(md5(doc_id::VARCHAR), 1, 4) AS BIGINT) % 100 / 100.0::DOUBLE AS p FROM labels),
    r AS (SELECT *, rank() OVER (ORDER BY p) + (count(*) OVER (PARTITION BY p) - 1) / 2.0::DOUBLE AS r FROM s)
    SELECT count(*) AS n, round((sum(CASE WHEN y = 1 THEN r ELSE 0 END) - sum(y) * (sum(y) + 1) / 2) / (sum(y) * (count(*) - sum(y))), 6) AS auc,
      round(avg(CASE WHEN (p >= 0.5)::INT = y THEN 1.0 ELSE 0.0 END), 6) AS accuracy, round(sum(y) / count(*), 6) AS positive_rate FROM r"""
)
def auc_rank_sum(spark, d):
    p = D.digits(F.col("doc_id").cast("string"), 1, 4) % 100 / 100.0
    return FB.evaluate(table(spark, d, "labels").select(F.col("quality").alias("y0"), p.alias("p")), "p", "y0")


@R.add()
def logistic_train_eval(spark, d):
    f = cut_lineage(FB.feature_columns(features(spark, d), "2025-01-10").where("got_interview IS NOT NULL"))  # read by each step
    model = FB.train(f)
    return FB.evaluate(f.select(model.score().alias("p"), "got_interview"), "p", "got_interview").withColumn("model", F.lit(model.version))


@R.add(
    FEATURE_SQL
    + ", e AS (SELECT *, 1 / (1 + exp(-("
    + " + ".join(f"{k} * {w}::DOUBLE" for k, w in S.HEURISTIC_WEIGHTS.items())
    + "))) - y::INTEGER AS off FROM feat WHERE y IS NOT NULL) "
    + " UNION ALL ".join(f"SELECT '{k}' AS name, round({w}::DOUBLE - 0.05::DOUBLE * avg(off * {k}), 9) AS weight FROM e" for k, w in S.HEURISTIC_WEIGHTS.items())
)
def online_weight_update(spark, d):
    f = FB.feature_columns(features(spark, d), "2025-01-10").where("got_interview IS NOT NULL")
    new = FB.online_update(spark, dict(S.HEURISTIC_WEIGHTS), f, "got_interview")
    return spark.createDataFrame([(k, round(w, 9)) for k, w in sorted(new.items())], "name string, weight double")


@R.add(
    """SELECT event_id, least(1.0::DOUBLE * pow(2, event_id % 8) * CASE WHEN event_type = 'error' THEN 2 ELSE 1 END, 60.0) AS delay,
      CASE WHEN event_id % 10 = 0 THEN 'rate_limit' WHEN event_id % 10 IN (1, 2) THEN 'server_error' WHEN event_type = 'error' THEN 'network_error' END AS retry FROM events"""
)
def backoff_and_retry(spark, d):
    from larkmill.operators.crawl import retryable

    k = F.col("event_id") % 10
    code = F.when(k == 0, 429).when(k == 1, 500).when(k == 2, 599).otherwise(404)
    bad = F.col("event_type") == "error"
    return table(spark, d, "events").select(
        "event_id", S.backoff_delay(F.col("event_id") % 8, rate_limited=bad).alias("delay"), retryable(code, F.lit("x"), bad).alias("retry")
    )
