"""Texts are measured for the rows of plans with several rows, words by pieces between blanks."""

import pandas as pd
from pyspark.sql import functions as F

from tablado.llm import content, survivors


def test_only_rows_of_plans_are_measured(spark):
    rows = spark.range(2_000).select(F.col("id").alias("row_id"), F.concat(F.lit("texto "), "id").alias("x"), F.lit("2026").alias("seen")).repartition(3)
    keys = rows.where("row_id % 10 = 3").select("row_id")
    measure = lambda b: pd.DataFrame({"length": pd.array([len(x) if x != "texto 13" else None for x in b["x"]], dtype="Int32"), "priced": [True] * len(b)})
    got = {r.row_id: (r.seen, r.length, r.priced) for r in survivors.measured_rows(rows, keys, measure, "length int, priced boolean", ["seen"]).collect()}
    wanted = {i: ("2026", len(f"texto {i}") if i != 13 else None, True) for i in range(3, 2_000, 10)}
    assert wanted.items() <= got.items() and len(got) < 1.5 * len(wanted)
    assert survivors.measured_rows(rows, keys.limit(0), measure, "length int, priced boolean", ["seen"]).count() == 0


def test_a_small_sieve_loses_nothing(spark, monkeypatch):
    monkeypatch.setattr(survivors, "SIEVE_BITS", 128)
    rows = spark.range(1_000).withColumnRenamed("id", "row_id").withColumn("x", F.lit(""))
    keys = rows.where("row_id < 300").select("row_id")
    measure = lambda b: pd.DataFrame({"length": [0] * len(b)})
    assert survivors.measured_rows(rows, keys, measure, "length int", []).join(keys, "row_id", "left_semi").count() == 300


def test_words_by_pieces():
    for text in ("", "Música en la plaza, 21:30h", "፩ casa 5", "² b ½", "ΣΑΣ ΣΑΣ 1", "ć ́d\xa0e_f", "a\x1cb"):
        assert content._words(text) == content._words_at_once(text)


def test_quick_reading_of_notices():
    assert survivors.usable_text("Una tarde de música en la plaza mayor, con entrada libre")
    assert not any(survivors.usable_text(f"  {x.upper()}...") for x in survivors.NO_DESCRIPTION) and not survivors.usable_text("- … -")
