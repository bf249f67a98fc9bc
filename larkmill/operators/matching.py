"""Match pipelines: the basic one over skills and experience, and the staged hybrid one."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from larkmill.functions import scores as S
from larkmill.functions import text as T
from larkmill.functions import vectors as V
from larkmill.operators.retrieval import match_terms, top_k
from larkmill.operators.windows import within_budget
from larkmill.session import cut_lineage


@dataclass(frozen=True)
class MatchConfig:
    """Parameters of both pipelines."""

    # basic
    min_score: float = 0.4
    max_results: int = 50
    # hybrid
    query_terms: int = 20
    match_mode: str = "all"
    fts_limit: int = 1000
    fts_min_score: float = 0.0
    vector_limit: int = 100
    vector_min_score: float | None = None
    judge_limit: int = 20
    judge_min_score: int = 60
    max_cost_cents: float | None = None
    weights: tuple[float, float, float] = (0.2, 0.3, 0.5)

    def checked(self) -> MatchConfig:
        if abs(sum(self.weights) - 1) > 1e-9:
            raise ValueError("weights must sum to 1")
        if not self.fts_limit >= self.vector_limit >= self.judge_limit > 0:
            raise ValueError("stage limits must not grow")
        return self


# Extension point: a judge maps a prompt to a score of 0 to 100.
JUDGES: dict[str, Callable[[Column], Column]] = {"heuristic": S.heuristic_judge}


def basic_match(pairs: DataFrame, cfg: MatchConfig = MatchConfig()) -> DataFrame:
    """Scores candidate pairs (resume_id, job_id, own_skills, job_skills, years, seniority, location).

    Adds skill_score, experience_score, score and reasoning; keeps scores of the threshold and more, the best per
    resume first.
    """
    scored = pairs.withColumns(
        {
            "skill_score": S.skill_score(F.col("own_skills"), F.col("job_skills")),
            "experience_score": S.experience_score(F.col("years"), F.col("seniority")),
            "matched": F.array_sort(F.array_intersect("own_skills", "job_skills")),
        }
    ).withColumn("score", S.basic_score(F.col("skill_score"), F.col("experience_score")))
    two = lambda c: F.format_string("%.2f", F.round(c, 2))
    reasoning = F.concat_ws(
        "; ",
        F.when(
            F.size("matched") > 0,
            F.concat(F.lit("Skills match: "), F.array_join("matched", ", "), F.lit(" ("), two("skill_score"), F.lit(")")),
        ).otherwise(F.concat(F.lit("Limited skill overlap ("), two("skill_score"), F.lit(")"))),
        F.concat(
            F.lit("Experience level: "), S.experience_label(F.col("experience_score")), F.lit(" match ("),
            two("experience_score"), F.lit(")"),
        ),
        F.when(F.col("location") != "", F.concat(F.lit("Location: "), F.col("location"))),
    )
    kept = scored.withColumn("reasoning", reasoning).where(F.round("score", 9) >= cfg.min_score)
    return top_k(kept, "resume_id", cfg.max_results, F.desc(F.round("score", 9)), F.asc("job_id"))


def lexical_stage(resumes: DataFrame, jobs: DataFrame, cfg: MatchConfig) -> DataFrame:
    terms = T.query_terms(F.col("fulltext"), cfg.query_terms)
    found = match_terms(resumes, "resume_id", terms, jobs, "job_id", "description", cfg.match_mode)
    kept = found.where(F.col("fts_score") >= cfg.fts_min_score)
    best = top_k(kept, "query_id", cfg.fts_limit, F.desc(F.round("fts_score", 9)), F.asc("doc_id"), rank="fts_rank")
    return best.select(
        F.col("query_id").alias("resume_id"), F.col("doc_id").alias("job_id"), F.round("fts_score", 9).alias("fts_score"), "fts_rank"
    )


def vector_stage(cands: DataFrame, resumes: DataFrame, chunks: DataFrame, cfg: MatchConfig) -> DataFrame:
    """The best chunk of each candidate job; jobs without a vector keep a score of 0 and go last."""
    pairs = cands.join(resumes.select("resume_id", "resume_vector"), "resume_id").join(
        chunks.select("job_id", "embedding"), "job_id", "left"
    )
    similarity = F.coalesce(F.round(V.cosine(F.col("resume_vector"), F.col("embedding")), 9), F.lit(0.0))
    best = pairs.groupBy("resume_id", "job_id", "fts_score", "fts_rank").agg(F.max(similarity).alias("vector_score"))
    if cfg.vector_min_score is not None:
        best = best.where(F.col("vector_score") >= cfg.vector_min_score)
    return top_k(best, "resume_id", cfg.vector_limit, F.desc("vector_score"), F.asc("job_id"), rank="vector_rank")


def judge_stage(
    cands: DataFrame, resumes: DataFrame, jobs: DataFrame, cfg: MatchConfig, judge: str = "heuristic"
) -> DataFrame:
    """Scores the first candidates of each resume until the budget is spent."""
    few = cands.where(F.col("vector_rank") <= cfg.judge_limit)
    full = few.join(jobs.select("job_id", "title", "company", "skills", "seniority", "description"), "job_id").join(
        resumes.select("resume_id", "own_skills", "years"), "resume_id"
    )
    prompt = S.judge_prompt(
        F.col("title"), F.col("company"), F.col("skills"), F.col("seniority"), F.col("description"), F.col("own_skills"),
        F.col("years"), F.lit(None).cast("string"), F.array().cast("array<string>"),
    )
    priced = full.withColumn("prompt", prompt).withColumn("cost_cents", F.round(S.judge_cost(F.col("prompt")), 9))
    if cfg.max_cost_cents is not None:
        order = [F.desc("vector_score"), F.asc("job_id")]
        priced = within_budget(priced, ["resume_id"], order, "cost_cents", cfg.max_cost_cents).drop("spent")
    return priced.withColumn("llm_score", JUDGES[judge](F.col("prompt")).cast("long")).drop("prompt")


def rank_stage(scored: DataFrame, cfg: MatchConfig) -> DataFrame:
    fts, vector, judge = cfg.weights
    final = F.col("fts_score") * fts + F.col("vector_score") * vector + F.col("llm_score") / 100.0 * judge
    kept = scored.withColumn("final_score", F.round(final, 6)).where(F.col("llm_score") >= cfg.judge_min_score)
    kept = kept.withColumn("action", S.action(F.col("llm_score"), F.col("final_score")))
    order = (F.desc("final_score"), F.desc("llm_score"), F.desc("vector_score"), F.asc("job_id"))
    return top_k(kept, "resume_id", cfg.judge_limit, *order)


def hybrid_match(
    resumes: DataFrame, jobs: DataFrame, chunks: DataFrame, cfg: MatchConfig = MatchConfig(), judge: str = "heuristic",
    texts: DataFrame | None = None,
) -> DataFrame:
    """Lexical stage, vector stage, judge, rank: one plan for all resumes.

    resumes: resume_id, fulltext, own_skills, years, resume_vector. jobs: job_id, title, company, skills, seniority,
    description. chunks: job_id, embedding. texts: job_id and description, where these are at hand without what jobs
    joins to them.
    """
    cfg = cfg.checked()
    found = vector_stage(lexical_stage(resumes, jobs if texts is None else texts, cfg), resumes, chunks, cfg)
    return rank_stage(judge_stage(found, resumes, jobs, cfg, judge), cfg)


def stage_counts(
    resumes: DataFrame, jobs: DataFrame, chunks: DataFrame, cfg: MatchConfig, texts: DataFrame | None = None
) -> DataFrame:
    """Candidates of each resume after every stage, each of which is computed once."""
    lexical = cut_lineage(lexical_stage(resumes, jobs if texts is None else texts, cfg))
    near = cut_lineage(vector_stage(lexical, resumes, chunks, cfg))
    judged = cut_lineage(judge_stage(near, resumes, jobs, cfg))
    tag = lambda df, name: df.select("resume_id", F.lit(name).alias("stage"))
    rows = tag(lexical, "fts").union(tag(near, "vector")).union(tag(judged, "judge")).union(tag(rank_stage(judged, cfg), "kept"))
    return rows.groupBy("resume_id", "stage").agg(F.count("*").alias("n"))


def adaptive_rank(features: DataFrame, weights: DataFrame, resume_id: str, job_id: str, k: int) -> DataFrame:
    """Re-ranks by the newest weights (created_at, weights map) with a logistic score over the feature columns."""
    newest = weights.orderBy(F.desc("created_at"), F.desc("model_version")).limit(1).select("weights", "model_version")
    names = [c for c in features.columns if c not in (resume_id, job_id)]
    packed = F.create_map(*[x for c in names for x in (F.lit(c), F.col(c).cast("double"))])
    scored = features.join(F.broadcast(newest)).withColumn("final_score", F.round(S.logistic_of_map(packed, F.col("weights")), 9))
    return top_k(scored, resume_id, k, F.desc("final_score"), F.asc(job_id)).select(
        resume_id, job_id, "rank", "final_score", "model_version"
    )
