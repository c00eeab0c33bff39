"""Topics are matched on a text that is folded once."""

from pyspark.sql import functions as F

from tablado.operators.score import Topic, with_topics


def test_filtered_score_folds_once(spark):
    topics = [Topic(n, n.upper(), w, (k, "sal")) for n, w, k in (("a", 5, "volcan"), ("b", 3, "mareas"), ("c", 5, "telares"), ("d", 2, "noche de"))]
    rows = [("Volcán y  MAREAS", "", ""), ("Salinas", "telar", ""), ("Noche", "", "de"), ("La sal", "Noche de", "x")]
    df = with_topics(spark.createDataFrame(rows, "t string, x string, c string"), F.col("t"), F.col("x"), F.col("c"), topics)
    got = {r.t: (r.score, r.topic, r.label) for r in df.collect()}
    assert got == {"Volcán y  MAREAS": (8, "a", "A"), "Salinas": (0, "", ""), "Noche": (2, "d", "D"), "La sal": (15, "a", "A")}
    # The filter goes below the score's projection: four folded parts in either, however many topics there are.
    plan = df.where("score >= 3")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("translate(") <= 8
