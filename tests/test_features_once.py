"""The features that a model is trained and evaluated on are made once."""

from larkmill.operators import feedback as FB
from larkmill.plans import matching


def test_training_reads_stored_features(spark, small, monkeypatch):
    plans = []

    def train(df, *more):
        plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return FB.heuristic_model()

    monkeypatch.setattr(FB, "train", train)
    assert matching.logistic_train_eval(spark, small).first()["model"] == "heuristic_v1"
    assert plans and "Join" not in plans[0]
