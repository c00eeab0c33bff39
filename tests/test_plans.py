"""The plans pipeline: junk titles, like titles, history by title."""

from pyspark.sql import functions as F

from tablado import queries


def _tables(spark, at):
    words = "cometas azoteas volcan"
    long = f"{words} teatro, exposición y concierto en una sala."
    rows = [
        (1, "Linternas sobre el agua", "", "https://a.example/1"),
        (2, "Linternas sobre el agua.", long, "https://a.example/2"),
        (3, "Mapas de la sierra norte", long, "https://a.example/3"),
        (4, "Los mejores planes de teatro", long, "https://a.example/4"),
    ]
    cols = "row_id long, titulo string, descripcion string, enlace string"
    empty = {c: F.lit("") for c in ("precio", "fecha_inicio", "fecha_fin")}
    df = spark.createDataFrame([(i, t, x or f"{words} sala", u) for i, t, x, u in rows], cols)
    df.withColumns({**empty, "batch_no": F.lit(1), "categoria": F.lit("Teatro"), "fuente": F.lit("a"), "_extracted_at": F.lit("2026-11-16T08:00:00")}).write.parquet(f"{at}/normalizer.parquet")
    past = spark.createDataFrame([(1, "Mapas de la sierra nortes", "", "https://b.example/9")], cols).withColumns({**empty, "id": F.lit("other"), "_first_seen": F.lit("2026-01-02T08:00:00"), "_extracted_at": F.lit("2026-01-02T08:00:00")})
    past.write.parquet(f"{at}/plan_history.parquet")
    return str(at)


def test_plans_pipeline(spark, tmp_path):
    d = _tables(spark, tmp_path)
    got = {r.ord: r for r in queries.QUERIES["fuzzy_dedup_plans"](spark, d).collect()}
    assert {k: (r.titulo, r.status) for k, r in got.items()} == {1: ("Linternas sobre el agua.", "new"), 3: ("Mapas de la sierra norte", "ongoing")}
    assert got[3].first_seen == "2026-01-02T08:00:00"
    assert [tuple(r) for r in queries.QUERIES["history_fuzzy_match"](spark, d).select("ord", "hist_ord", "tier").collect()] == [(3, 1, 3)]
    said = " ".join(r.json for r in queries.QUERIES["plans_pipeline"](spark, d).collect())
    assert said.count("Linternas sobre el agua") == 1 and "Los mejores" not in said
