"""Plans: normalise, filter, deduplicate against history, bucket, export."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablado.functions import listing as L
from tablado.functions import text as T
from tablado.functions.dates import display_date, end_date_text, short_date_es
from tablado.io import cut
from tablado.operators import dedup, filters, history, rank
from tablado.operators.score import Topic, with_topics
from tablado.sinks.export import export_lines


def normalise(raw: DataFrame, today: Column, sources: dict[str, str] | None = None) -> DataFrame:
    """Raw events (titulo, categoria, descripcion, ...) with text decoded and squeezed, the title's category
    taken off, one word for free entry, sources under one name, a missing end date read from the text, and a
    stable id.  Rows without a title, or ended, are dropped.

    The result is cut: what follows reads these columns many times.
    """
    fields = ("titulo", "categoria", "descripcion", "precio", "fecha_inicio", "fecha_fin")
    rows = raw.withColumns({c: L.read_as_utf8(T.squeeze(F.coalesce(F.col(c), F.lit("")))) for c in fields}).where("titulo <> ''")
    rows = rows.withColumns({"categoria": T.category_of(F.col("titulo"), F.when(F.col("categoria") == "", "Evento").otherwise(F.col("categoria"))), "titulo": T.without_category(F.col("titulo")), "precio": L.price_canon(F.col("precio"))})
    if sources:
        named = F.element_at(F.create_map(*[F.lit(x) for kv in sources.items() for x in kv]), F.col("fuente"))
        rows = rows.withColumn("fuente", F.coalesce(named, "fuente"))
    end = F.when(F.col("fecha_fin") == "", end_date_text(F.concat_ws(". ", "titulo", "descripcion"), today)).otherwise(F.col("fecha_fin"))
    rows = cut(rows.withColumn("fecha_fin", end))
    return rows.where(filters.not_ended(F.col("fecha_fin"), today)).withColumn("id", T.stable_id(F.col("titulo"), F.col("enlace")))


def score(plans: DataFrame, topics: list[Topic]) -> DataFrame:
    return with_topics(plans, F.col("titulo"), F.col("descripcion"), F.col("categoria"), topics)


def select_plans(plans: DataFrame, now: Column, topics: list[Topic], refused: list[str], *, least_score: int = 2, weeks: int = 8) -> DataFrame:
    """Scored plans that say enough, use no refused word and touch the coming weeks."""
    without = filters.without_words(F.col("titulo"), F.col("descripcion"), refused)
    window = filters.runs_within(F.col("fecha_inicio"), F.col("fecha_fin"), now, weeks, filters.open_ended(F.col("titulo"), F.col("descripcion")))
    # What costs least comes first.
    return score(plans.where(window & without), topics).where(F.col("score") >= least_score)


def deduplicate(plans: DataFrame, past: DataFrame, order: str = "ord", *, hist_order: str = "hist_ord", with_titles: bool = True, run: Column | None = None) -> DataFrame:
    """The fullest row of each plan (of each ``run``), with the status of the plan's first row against history.  Missing dates are
    filled from there where the first row is the fullest; a row that replaced it keeps its own."""
    fullness = dedup.completeness(F.col("descripcion"), [(F.col("precio"), 50), (F.col("fecha_inicio"), 100), (F.col("fecha_fin"), 100), (F.col("enlace"), 30)])
    plans = cut(plans)
    compared = plans.withColumns({"__row": F.col(order), "__title": L.without_categories(F.col("titulo"))})
    unique = cut(dedup.dedup_keep_fullest(compared, order, "id", "__title", fullness, run=run)).drop("__title")
    first = plans.join(unique.select(order), order, "left_semi")
    matches = history.match_history(first, past, order, "id", "enlace", "titulo" if with_titles else None, hist_order=hist_order)
    dates = ["fecha_inicio", "fecha_fin"]
    known = history.with_status(first, past, matches, order, hist_order=hist_order, fill=dates)
    out = unique.join(known.select(order, "is_new", "status", "first_seen", *[F.col(c).alias(f"__{c}") for c in dates]), order)
    return out.withColumns({c: F.when(F.col("__row") == F.col(order), F.col(f"__{c}")).otherwise(F.col(c)) for c in dates}).drop("__row", *[f"__{c}" for c in dates])


def bucketed(plans: DataFrame, now: Column) -> DataFrame:
    """Plans with their bucket and dates for display."""
    start, end = display_date(F.col("fecha_inicio")), display_date(F.col("fecha_fin"))
    seen = F.col("first_seen").try_cast("timestamp")
    return plans.withColumns({"bucket": rank.lifecycle(start, end, seen, now), "date_start": F.when(start.isNull(), F.col("fecha_inicio")).otherwise(short_date_es(start)), "date_end": F.when(end.isNull(), F.col("fecha_fin")).otherwise(short_date_es(end))})


def export_plans(plans: DataFrame, now: Column, order: Column) -> DataFrame:
    """(bucket, place, json): every plan as an item of its bucket, in order, behind the bucket's head (place 0).

    A line an item, so that a bucket of any size is written and read in parts.
    """
    fields = {"title": F.col("titulo"), "category": F.col("categoria"), "date_start": F.col("date_start"), "date_end": F.col("date_end"), "url": F.col("enlace"), "price": F.col("precio"), "bullets": T.bullets(F.lit(None).cast("array<string>"), F.col("descripcion"), F.lit(""))}
    return export_lines(plans, "bucket", fields, [-F.col("score"), order], {"generated": now.cast("string")})
