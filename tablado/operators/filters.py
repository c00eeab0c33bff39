"""Row predicates over listings.  Each is a Column that is true for rows to keep and never NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablado.functions import text as T
from tablado.functions.dates import display_date


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def not_older(at: Column, now: Column, span: str) -> Column:
    """At most ``span`` (an interval literal) before ``now``; rows without a time are kept."""
    return at.isNull() | (at >= now - F.expr(f"INTERVAL {span}"))


def filled(*cs: Column) -> Column:
    out = F.lit(True)
    for c in cs:
        out = out & _sure(c != "")
    return out


def without_keywords(title: Column, text: Column, keywords: list[str], lead: int = 200) -> Column:
    """No keyword in the title (read twice, so that phrases match across the seam) or the lead of the text."""
    return ~_sure(T.haystack(title, F.substring(F.coalesce(text, F.lit("")), 1, lead)).rlike(T.keyword_pattern(keywords)))


def within_days(day: Column, today: Column, days: int) -> Column:
    """From today to ``days`` later, both included; NULL days are dropped."""
    return _sure(day.between(today, F.date_add(today, days)))


def names_an_act(c: Column, notices: list[str]) -> Column:
    """No notice in place of a name: none of the phrases, blanks and marks set aside, and no opening mark."""
    bare = F.lower(F.regexp_replace(c, r"(?U)[¡!¿?\s]", ""))
    return ~_sure(T.contains_any(bare, [n.replace(" ", "").lower() for n in notices])) & ~_sure(F.trim(c).rlike("^[¡¿]"))


def not_in_cities(venue: Column, raw: Column, cities: list[str], home: str) -> Column:
    """The venue names none of the cities, and the raw title none unless it names the home city too."""
    city = r"(^|[^\p{L}\p{N}_])(" + "|".join(cities) + r")([^\p{L}\p{N}_]|$)"
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    return ~low(venue).rlike(city) & ~(low(raw).rlike(city) & ~low(raw).rlike(rf"(^|[^\p{{L}}\p{{N}}_]){home}([^\p{{L}}\p{{N}}_]|$)"))


def proper_title(c: Column, exact: list[str], patterns: list[str], least: int = 4) -> Column:
    """A title of at least ``least`` letters that is none of the given ones and fits none of the patterns."""
    t = T.fold(F.coalesce(c, F.lit("")))
    bad = (F.length(t) < least) | t.isin(*exact) if exact else F.length(t) < least
    return ~(bad | t.rlike("|".join(f"(?:{p})" for p in patterns))) if patterns else ~bad


def without_words(title: Column, text: Column, words: list[str], lead: int = 300) -> Column:
    """None of the words anywhere in the title or the lead of the text, letter for letter."""
    hay = F.concat_ws(" ", F.lower(F.coalesce(title, F.lit(""))), F.lower(F.substring(F.coalesce(text, F.lit("")), 1, lead)))
    return ~T.contains_any(hay, words)


def runs_within(start_text: Column, end_text: Column, now: Column, weeks: int = 8, open_ended: Column | None = None, *, strict_compat: bool = False) -> Column:
    """Whether a run touches the coming ``weeks``.

    Without dates it is kept; with an end only, if that is not past; with a start only, if that lies before
    the horizon and is at most ``weeks`` past or open-ended.  An end on the day of ``now`` is not past, unless
    ``strict_compat`` compares midnight with the time of day.
    """
    start, end = display_date(start_text), display_date(end_text)
    horizon = now + F.expr(f"INTERVAL {weeks} WEEKS")
    lasting = end.cast("timestamp") >= (now if strict_compat else F.date_trunc("day", now))
    soon = start.cast("timestamp") <= horizon
    recent = (F.datediff(now, start) <= weeks * 7) | (open_ended if open_ended is not None else F.lit(False))
    return _sure(
        F.when(start.isNull() & end.isNull(), True)
        .when(start.isNull(), lasting)
        .when(end.isNull(), soon & ((start >= F.to_date(now)) | recent))
        .otherwise(soon & lasting)
    )


# Wordings of a run without an end.
OPEN_ENDED = ["a partir de", "desde el", "permanente", "todo el año", "todo el verano", "hasta nuevo aviso"]


def open_ended(title: Column, text: Column, wordings: list[str] | None = None) -> Column:
    """Wording of a run without an end."""
    return _sure(F.lower(F.concat_ws(" ", title, text)).rlike("|".join(w.replace(" ", r"\s+") for w in wordings or OPEN_ENDED)))


def not_ended(end_text: Column, today: Column) -> Column:
    """No readable end day before today."""
    end = display_date(end_text)
    return end.isNull() | (end >= today)


def enough_text(content: Column, description: Column, least_content: int = 220, least_description: int = 120) -> Column:
    """The text to go on with: long content, else a long description, else NULL (drop the row)."""
    return F.when(F.length(content) > least_content, content).when(F.length(description) > least_description, description)


def indicators(c: Column, words: list[str], least: int) -> Column:
    """Whether at least ``least`` of the words stand in a text."""
    return _sure(T.count_contained(F.lower(c), words) >= least)


def usable_image(url: Column, refused: list[str]) -> Column:
    return _sure(url.startswith("http")) & ~_sure(T.contains_any(url, refused))
