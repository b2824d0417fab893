from loomquill.operators import model


def test_linear_classifier_and_pluggable_scorer(spark):
    rows = [(str(i), "skatt jobb pengar", "M") if i % 2 else (str(i), "klimat skog natur", "MP") for i in range(40)]
    df = spark.createDataFrame(rows, "id string, text string, label string")
    got = model.predict(df, model.train(df, features=256, rounds=5))
    assert got.where("pred <> label").count() == 0
    assert all(abs(sum(r.probs.values()) - 1) < 1e-6 for r in got.limit(5).collect())

    def load():
        return lambda texts: [[1.0, 0.0] if "skatt" in t else [0.0, 1.0] for t in texts]

    out = {r.id: r.probs for r in model.score_with(df, load, ["M", "MP"]).collect()}
    assert out["1"] == {"M": 1.0, "MP": 0.0} and out["0"]["MP"] == 1.0
