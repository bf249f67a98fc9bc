"""Scores of a match between a candidate and a job, as column arithmetic."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
JUDGE_KEYWORDS = ("python", "javascript", "java", "react", "sql", "aws", "docker", "kubernetes")
SENIOR_WORDS = ("senior", "5+", "lead", "principal", "architect")
JUNIOR_WORDS = ("junior", "entry", "0-2", "intern")
SENIORITY_RANGES = {
    "entry": (0, 2), "junior": (1, 3), "mid": (2, 6), "senior": (5, 12), "staff": (8, 20), "principal": (12, 25),
}
DOMAIN_KEYWORDS = {
    "defense": ("defense", "military", "security", "clearance", "classified"),
    "aerospace": ("aerospace", "aviation", "flight", "uav", "drone"),
    "autonomy": ("autonomous", "robotics", "ai", "machine learning", "computer vision"),
    "systems": ("systems", "integration", "architecture", "engineering"),
    "software": ("software", "programming", "development", "algorithms"),
}
CRITICAL_SKILLS = ("python", "sql", "aws", "kubernetes", "react", "node.js")
COMPANY_TIERS = (("faang", 1.0), ("unicorn", 0.9), ("public", 0.7), ("startup", 0.5), ("unknown", 0.3))
SENIORITY_LEVELS = {"intern": 1, "junior": 2, "mid": 3, "senior": 4, "staff": 5, "principal": 6}
LOCATION_FIT = {
    ("remote", "remote"): 1.0, ("hybrid", "hybrid"): 1.0, ("hybrid", "remote"): 0.8, ("onsite", "onsite"): 1.0,
    ("onsite", "hybrid"): 0.6, ("onsite", "remote"): 0.2,
}
HEURISTIC_WEIGHTS = {
    "vector_score": 0.25, "llm_score": 0.30, "skill_overlap_ratio": 0.20, "critical_skill_match": 0.15,
    "yoe_gap_ratio": -0.10, "title_similarity": 0.05, "company_tier_match": 0.05,
}


def ladder(steps: list[tuple[Column, object]], default) -> Column:
    """The value of the first step whose condition holds."""
    out = F.when(steps[0][0], steps[0][1])
    for condition, value in steps[1:]:
        out = out.when(condition, value)
    return out.otherwise(default)


def skill_score(own: Column, wanted: Column) -> Column:
    """Shared distinct skills over the length of the wanted list, repeats counted; 0 for an empty list."""
    shared = F.size(F.array_intersect(own, wanted))
    return F.when(F.size(wanted) > 0, F.least(shared / F.size(wanted), F.lit(1.0))).otherwise(0.0)


def experience_score(years: Column, seniority: Column) -> Column:
    low = F.lower(F.coalesce(seniority, F.lit("")))
    has = lambda *xs: reduce(lambda a, b: a | b, [F.instr(low, x) > 0 for x in xs])
    needed = ladder(
        [(has("senior", "lead"), 5.0), (has("mid", "intermediate"), 3.0), (has("junior", "entry"), 1.0)],
        F.lit(None).cast("double"),
    )
    short = F.greatest(years / needed * 0.7, F.lit(0.1))
    return F.when(needed.isNull(), 0.5).when(years >= needed, 1.0).otherwise(short)


def basic_score(skills: Column, experience: Column) -> Column:
    return 0.7 * skills + 0.3 * experience


def final_score(fts: Column, vector: Column, judge: Column) -> Column:
    return 0.2 * fts + 0.3 * vector + 0.5 * (judge / 100.0)


def action(judge: Column, final: Column) -> Column:
    return ladder(
        [
            ((judge >= 85) & (final >= 0.8), "APPLY_HIGH"),
            ((judge >= 70) & (final >= 0.6), "APPLY_MEDIUM"),
            ((judge >= 60) & (final >= 0.4), "REVIEW"),
        ],
        "SKIP",
    )


def hybrid_rerank(vector: Column, fts: Column, recency: Column) -> Column:
    """Inputs normalised by their largest value in the candidate set."""
    return 0.6 * vector + 0.3 * fts + 0.1 * recency


def experience_label(score: Column) -> Column:
    return ladder([(score > 0.8, "good"), (score > 0.5, "adequate")], "limited")


def seniority_fit(years: Column, seniority: Column) -> Column:
    """1 inside the range of the level, less below it, and at least 0.7 above it; unknown levels have 0 to 1 years."""
    pick = lambda i, other: ladder([(seniority == k, float(v[i])) for k, v in SENIORITY_RANGES.items()], other)
    low, high = pick(0, 0.0), pick(1, 1.0)
    return (
        F.when((years >= low) & (years <= high), 1.0)
        .when(years < low, F.greatest(F.lit(0.0), years / low))
        .otherwise(F.greatest(F.lit(0.7), 1.0 - (years - high) / 10))
    )


def domain_relevance(resume_text: Column, job_text: Column, domains: dict = DOMAIN_KEYWORDS) -> Column:
    """Mean share of a domain's keywords in the resume, over domains the job names; 0.5 if it names none."""
    resume, job = F.lower(F.coalesce(resume_text, F.lit(""))), F.lower(F.coalesce(job_text, F.lit("")))
    shares = []
    for words in domains.values():
        in_job = reduce(lambda a, b: a | b, [F.instr(job, w) > 0 for w in words])
        found = reduce(lambda a, b: a + b, [(F.instr(resume, w) > 0).cast("int") for w in words])
        shares.append(F.when(in_job, found / len(words)))
    used = F.array_compact(F.array(*shares))
    total = F.aggregate(used, F.lit(0.0), lambda a, x: a + x)
    return F.when(F.size(used) == 0, 0.5).otherwise(total / F.size(used))


def ratio(part: Column, whole: Column) -> Column:
    return F.when(whole > 0, part / whole).otherwise(0.0)


def five_factor(required: Column, experience: Column, preferred: Column, seniority: Column, domain: Column) -> Column:
    return required * 0.4 + experience * 0.25 + preferred * 0.15 + seniority * 0.1 + domain * 0.1


def confidence(score: Column, matches: Column, wanted: Column) -> Column:
    return ladder(
        [
            ((score >= 0.8) & (matches >= wanted * 0.8), "High"),
            ((score >= 0.6) & (matches >= wanted * 0.6), "Medium"),
            (score >= 0.4, "Low"),
        ],
        "Very Low",
    )


def two_factor(skills: Column, experience: Column, preferred_matches: Column | None = None) -> Column:
    score = skills * 0.7 + experience * 0.3
    return score if preferred_matches is None else F.least(score + preferred_matches * 0.1, F.lit(1.0))


def recommendations(
    missing: Column, matched: Column, wanted: Column, missing_preferred: Column, years: Column, min_years: Column
) -> Column:
    """Advice in a fixed order; the skills named are the first in alphabetical order."""
    first = lambda xs, n: F.array_join(F.slice(F.array_sort(xs), 1, n), ", ")
    return F.array_compact(
        F.array(
            F.when(F.size(missing) > 0, F.concat(F.lit("Focus on developing: "), first(missing, 3))),
            F.when(
                years < min_years,
                F.concat(F.lit("Gain "), (min_years - years).cast("string"), F.lit(" more years of relevant experience")),
            ),
            F.when(
                F.size(matched) >= F.size(wanted) * 0.7, F.lit("Strong technical foundation - highlight relevant projects")
            ),
            F.when(
                F.size(missing_preferred).between(1, 3),
                F.concat(F.lit("Consider learning: "), first(missing_preferred, 2)),
            ),
        )
    )


def judge_prompt(
    title: Column, company: Column, skills: Column, seniority: Column, description: Column,
    own_skills: Column, years: Column, education: Column, roles: Column,
) -> Column:
    """A scoring prompt: the job, the candidate, and the scale. No years count as not specified."""
    said = lambda x: F.coalesce(F.nullif(x, F.lit("")), F.lit("Not specified"))
    years_text = F.when(F.coalesce(years, F.lit(0.0)) == 0, F.lit("Not specified")).otherwise(years.cast("string"))
    return F.concat(
        F.lit("Rate the fit of a candidate with a job from 0 to 100. Weigh skills, seniority level, role.\nTitle: "),
        F.coalesce(title, F.lit("")), F.lit("\nCompany: "), F.coalesce(company, F.lit("")), F.lit("\nRequired skills: "),
        F.array_join(skills, ", "), F.lit("\nSeniority: "), said(seniority), F.lit("\nDescription: "),
        F.substring(F.coalesce(description, F.lit("")), 1, 500), F.lit("...\nSkills: "), F.array_join(own_skills, ", "),
        F.lit("\nExperience: "), years_text, F.lit(" years\nEducation: "), said(education),
        F.lit("\nPreferred roles: "), F.array_join(roles, ", "),
    )


def heuristic_judge(prompt: Column, keywords=JUDGE_KEYWORDS, senior=SENIOR_WORDS, junior=JUNIOR_WORDS) -> Column:
    """0 to 100: ten for each keyword over fifty, an adjustment for experience, and a jitter from the prompt's MD5.

    Words are looked for in the whole prompt, whose own text names seniority: every role counts as senior.
    """
    low = F.lower(prompt)
    has = lambda xs: reduce(lambda a, b: a | b, [F.instr(low, x) > 0 for x in xs])
    found = reduce(lambda a, b: a + b, [(F.instr(low, k) > 0).cast("int") for k in keywords])
    base = F.least(50 + found * 10, F.lit(90))
    years = F.regexp_extract(low, r"experience: (\d+)", 1).try_cast("int")
    base = (
        F.when((F.instr(low, "experience: 0") > 0) & has(senior), F.greatest(base - 30, F.lit(20)))
        .when((years >= 5) & has(senior), F.least(base + 10, F.lit(95)))
        .when((years < 2) & has(junior), F.least(base + 5, F.lit(90)))
        .otherwise(base)
    )
    jitter = F.conv(F.substring(F.md5(prompt), 1, 2), 16, 10).cast("int") % 20 - 10
    return F.greatest(F.lit(0), F.least(F.lit(100), base + jitter))


def judge_cost(prompt: Column) -> Column:
    """Cents at 0.2 a thousand tokens."""
    words = F.size(F.filter(F.split(prompt, r"\s+"), lambda w: w != ""))
    return words * F.lit(1.3) / 1000 * 0.2


def critique_score(text: Column) -> Column:
    """60 to 99 from the MD5 of the text."""
    return F.conv(F.substring(F.md5(text), 1, 2), 16, 10).cast("int") % 40 + 60


def company_tier(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return ladder([(F.instr(low, k) > 0, v) for k, v in COMPANY_TIERS], 0.3)


def seniority_distance(job: Column, candidate: Column) -> Column:
    level = lambda x: ladder([(F.lower(x) == k, v) for k, v in SENIORITY_LEVELS.items()], 3)
    return F.greatest(F.lit(0.0), 1.0 - F.abs(level(job) - level(candidate)) * 0.2)


def location_fit(job: Column, wanted: Column) -> Column:
    return ladder([((job == a) & (wanted == b), v) for (a, b), v in LOCATION_FIT.items()], 0.5)


def jaccard(a: Column, b: Column) -> Column:
    """Of two texts' lower-case words; 0 if either has none."""
    words = lambda t: F.array_distinct(F.filter(F.split(F.lower(t), r"\s+"), lambda w: w != ""))
    x, y = words(F.coalesce(a, F.lit(""))), words(F.coalesce(b, F.lit("")))
    both = F.size(F.array_intersect(x, y))
    return F.when((F.size(x) > 0) & (F.size(y) > 0), both / F.size(F.array_union(x, y))).otherwise(0.0)


def competition(tier: Column, age_days: Column) -> Column:
    fresh = F.greatest(F.lit(0.0), (30 - F.coalesce(age_days, F.lit(30))) / 30.0)
    return F.least(F.lit(1.0), (tier + fresh) / 2.0)


def logistic(weights: dict[str, float], intercept: float = 0.0) -> Column:
    """Sigmoid of a weighted sum of columns named by the weights; missing values count as zero."""
    total = reduce(lambda a, b: a + b, [F.coalesce(F.col(k), F.lit(0.0)) * w for k, w in weights.items()])
    return 1.0 / (1.0 + F.exp(-(total + intercept)))


def logistic_of_map(features: Column, weights: Column) -> Column:
    """The same over map columns: one weight map may serve many rows, or each row its own."""
    terms = F.transform(
        F.map_entries(weights), lambda e: e["value"] * F.coalesce(F.try_element_at(features, e["key"]), F.lit(0.0))
    )
    return 1.0 / (1.0 + F.exp(-F.aggregate(terms, F.lit(0.0), lambda a, x: a + x)))


def backoff_delay(
    attempt: Column, base: float = 1.0, factor: float = 2.0, most: float = 60.0, rate_limited: Column | None = None
) -> Column:
    """Seconds before a retry, without jitter; doubled when rate-limited, then capped."""
    delay = base * F.pow(F.lit(factor), attempt)
    delay = delay if rate_limited is None else F.when(rate_limited, delay * 2).otherwise(delay)
    return F.least(delay, F.lit(most))
