"""Keyword topics: scores, the best topic, and counted reasons.  Vocabularies are arguments."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablado.functions import text as T


@dataclass(frozen=True)
class Topic:
    name: str
    label: str
    weight: int
    keywords: tuple[str, ...]


def with_topics(df: DataFrame, title: Column, text: Column, category: Column, topics: list[Topic], lead: int = 300) -> DataFrame:
    """``df`` with ``score``: the weights of all matching topics, each once; ``topic`` and ``label``: the one of
    the greatest weight, the first declared among equals, '' for none.

    The text is folded once and every topic matched once, also where a filter on the score is pushed below its
    column: what is used several times is bound by ``_with``.  Patterns are run where a keyword stands at all.
    """
    hay = T.haystack(title, category, F.substring(F.coalesce(text, F.lit("")), 1, lead))
    hits = _with(hay, lambda h: F.array(*[T.contains_any(h, T.folded_keywords(list(t.keywords))) & h.rlike(T.keyword_pattern(list(t.keywords))) for t in topics]))

    def found(x: Column) -> Column:
        score = F.lit(0)
        name = label = F.when(F.lit(False), F.lit(""))
        for i, t in sorted(enumerate(topics), key=lambda y: -y[1].weight):
            score = score + F.when(x[i], t.weight).otherwise(0)
            name, label = name.when(x[i], F.lit(t.name)), label.when(x[i], F.lit(t.label))
        return F.struct(score.alias("score"), name.otherwise("").alias("topic"), label.otherwise("").alias("label"))

    df = df.withColumn("__found", _with(hits, found))
    return df.withColumns({c: F.col(f"__found.{c}") for c in ("score", "topic", "label")}).drop("__found")


def _with(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it and wherever the optimizer moves it."""
    return F.transform(F.array(c), lambda x: f(x))[0]


def counted_score(c: Column, high: list[str], medium: list[str]) -> Column:
    """Four for each of the high words in a text and two for each of the medium ones."""
    low = F.lower(F.coalesce(c, F.lit("")))
    return T.count_contained(low, high) * 4 + T.count_contained(low, medium) * 2


def first_reason(reasons: list[tuple[str, Column]], kept: str = "kept") -> Column:
    """The name of the first predicate that drops a row, for ordered predicates that keep rows."""
    out = F.when(F.lit(False), F.lit(""))
    for name, keeps in reasons:
        out = out.when(~keeps, F.lit(name))
    return out.otherwise(F.lit(kept))


def count_reasons(df: DataFrame, reasons: list[tuple[str, Column]]) -> DataFrame:
    return df.groupBy(first_reason(reasons).alias("reason")).agg(F.count("*").alias("n"))
