"""Features of matches, weights learned from outcomes, and their evaluation."""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkmill.functions import scores as S
from larkmill.operators.tables import global_row_number

# Numeric features in the order of the model.
FEATURES = (
    "vector_score", "llm_score", "fts_rank_norm", "yoe_gap", "yoe_gap_ratio", "seniority_match", "skill_overlap_count",
    "skill_overlap_ratio", "critical_skill_match", "title_similarity", "company_tier_match",
    "location_preference_match", "job_recency_days", "application_competition",
)


def feature_columns(df: DataFrame, ref_date: str) -> DataFrame:
    """The feature vector of each match.

    Reads vector_score, llm_score, fts_rank, required_yoe, candidate_yoe, required_skills, candidate_skills,
    job_title, resume_title, company, job_seniority, candidate_level, location, location_pref and posted_date; missing
    values take the defaults.
    """
    zero = F.lit(0.0)
    need, have = F.coalesce(F.col("required_yoe"), zero), F.coalesce(F.col("candidate_yoe"), zero)
    wanted, own = F.array_distinct("required_skills"), F.col("candidate_skills")
    shared = F.array_intersect(wanted, own)
    critical = F.array(*[F.lit(s) for s in S.CRITICAL_SKILLS])
    n_critical = F.size(F.array_intersect(wanted, critical))
    age = F.coalesce(F.date_diff(F.lit(ref_date).cast("date"), F.col("posted_date")), F.lit(365))
    tier = S.company_tier(F.col("company"))
    made = {
        "vector_score": F.coalesce("vector_score", zero),
        "llm_score": F.coalesce("llm_score", F.lit(0)) / 100.0,
        "fts_rank_norm": F.greatest(zero, 1 - F.coalesce("fts_rank", F.lit(999)) / 1000.0),
        "yoe_gap": F.abs(need - have),
        "yoe_gap_ratio": F.abs(need - have) / F.greatest(need, F.lit(1.0)),
        "seniority_match": S.seniority_distance(F.col("job_seniority"), F.col("candidate_level")),
        "skill_overlap_count": F.size(shared).cast("double"),
        "skill_overlap_ratio": F.size(shared) / F.greatest(F.size(wanted), F.lit(1)),
        "critical_skill_match": F.when(n_critical > 0, F.size(F.array_intersect(shared, critical)) / n_critical).otherwise(1.0),
        "title_similarity": S.jaccard(F.col("job_title"), F.col("resume_title")),
        "company_tier_match": tier,
        "location_preference_match": S.location_fit(F.col("location"), F.col("location_pref")),
        "job_recency_days": age.cast("double"),
        "application_competition": S.competition(tier, age),
    }
    keys = [c for c in df.columns if c in ("job_id", "resume_id", "got_interview")]
    return df.select(*keys, *[made[name].alias(name) for name in FEATURES])


@dataclass(frozen=True)
class WeightModel:
    """Weights over features, with the means and deviations they were learned under."""

    weights: dict[str, float]
    version: str
    mean: dict[str, float] = field(default_factory=dict)
    std: dict[str, float] = field(default_factory=dict)
    intercept: float = 0.0
    samples: int = 0

    def score(self, compat: bool = False):
        """Probability column; ``compat`` applies the weights to raw features without intercept."""
        if compat or not self.mean:
            return S.logistic(self.weights)
        raw = {k: w / self.std[k] for k, w in self.weights.items()}
        shift = sum(raw[k] * self.mean[k] for k in raw)
        return S.logistic(raw, self.intercept - shift)

    def importance(self) -> list[tuple[str, float]]:
        return sorted(self.weights.items(), key=lambda kv: (-abs(kv[1]), kv[0]))

    def to_json(self) -> str:
        return json.dumps(self.__dict__, sort_keys=True)

    @staticmethod
    def from_json(text: str) -> WeightModel:
        return WeightModel(**json.loads(text))


def heuristic_model() -> WeightModel:
    return WeightModel(dict(S.HEURISTIC_WEIGHTS), "heuristic_v1")


def train(df: DataFrame, label: str = "got_interview", least: int = 100, c: float = 1.0, rounds: int = 1000) -> WeightModel:
    """Balanced logistic regression on standardised features of four fifths of the rows (by hash, per label);
    the heuristic weights when there are too few."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler

    known = df.where(F.col(label).isNotNull()).withColumn("_y", F.col(label).cast("double"))
    split = F.pmod(F.xxhash64(*[x for x in ("job_id", "resume_id") if x in df.columns], F.lit(42)), F.lit(5))
    part = known.where(split != 0)
    stats = part.agg(
        F.count("*").alias("n"), F.sum("_y").alias("pos"),
        *[F.avg(f).alias(f"m_{f}") for f in FEATURES], *[F.stddev_pop(f).alias(f"s_{f}") for f in FEATURES],
    ).first()
    n, pos = stats["n"], stats["pos"] or 0
    if n < least or pos in (0, n):
        return heuristic_model()
    mean = {f: stats[f"m_{f}"] for f in FEATURES}
    std = {f: stats[f"s_{f}"] or 1.0 for f in FEATURES}
    scaled = part.select(
        *[((F.col(f) - mean[f]) / std[f]).alias(f) for f in FEATURES], "_y",
        F.when(F.col("_y") == 1, n / (2.0 * pos)).otherwise(n / (2.0 * (n - pos))).alias("_w"),
    )
    data = VectorAssembler(inputCols=list(FEATURES), outputCol="x").transform(scaled)
    fitted = LogisticRegression(
        featuresCol="x", labelCol="_y", weightCol="_w", maxIter=rounds, regParam=1.0 / (c * n), standardization=False
    ).fit(data)
    weights = {f: float(w) for f, w in zip(FEATURES, fitted.coefficients, strict=True)}
    return WeightModel(weights, "logistic_v1", mean, std, float(fitted.intercept), int(n))


def evaluate(df: DataFrame, score: str, label: str) -> DataFrame:
    """AUC by rank sums, accuracy at one half and the share of positives; AUC is 0.5 if a class is empty.

    Rows are numbered over the whole order without one task for all; equal scores share their mean number.
    """
    numbered = global_row_number(df.select(F.col(label).cast("int").alias("y"), F.col(score).alias("s")), ["s"])
    groups = numbered.groupBy("s").agg(
        F.avg("row").alias("r"), F.count("*").alias("n"), F.sum("y").alias("n1"),
        F.sum(((F.col("s") >= 0.5).cast("int") == F.col("y")).cast("long")).alias("right"),
    )
    a = groups.agg(
        F.sum("n").alias("n"), F.sum("n1").alias("n1"), F.sum(F.col("r") * F.col("n1")).alias("ranks"), F.sum("right").alias("right")
    )
    n0 = F.col("n") - F.col("n1")
    auc = (F.col("ranks") - F.col("n1") * (F.col("n1") + 1) / 2) / (F.col("n1") * n0)
    return a.select(
        "n", F.round(F.when((F.col("n1") > 0) & (n0 > 0), auc).otherwise(0.5), 6).alias("auc"),
        F.round(F.col("right") / F.col("n"), 6).alias("accuracy"), F.round(F.col("n1") / F.col("n"), 6).alias("positive_rate"),
    )


def online_update(spark, weights: dict[str, float], batch: DataFrame, label: str, rate: float = 0.05) -> dict[str, float]:
    """One gradient step of the logistic weights over a micro-batch, computed as one aggregate."""
    error = S.logistic(weights) - F.col(label).cast("double")
    row = batch.agg(F.count("*").alias("n"), *[F.sum(error * F.coalesce(F.col(k), F.lit(0.0))).alias(k) for k in weights]).first()
    return weights if not row["n"] else {k: w - rate * row[k] / row["n"] for k, w in weights.items()}
