"""Scalars of listings: prices, categories, notes, places and the viewer's dates.  All are native.

Vocabularies are arguments.  NULL text counts as '' unless the docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tablado.functions import dates, text

# Words for free entry, in a price and in running text, and the labels that prices are given.
FREE_PRICES, FREE_TEXTS = ["gratis", "free", "gratuito"], ["gratis", "gratuito", "free", "entrada libre", "sin coste"]
PRICED_WORDS = ["precio", "entrada"]
FREE, ASK = "Gratis", "Consultar"
# An amount in euros as a sign and as a word, and the words for included charges.
AMOUNT_SIGN, AMOUNT_WORD, CHARGES = r"(\d+[,.]?\d*)\s*€", r"(\d[\d.,]+)\s*euros?", "gastos incluidos"
# Notes on a listing's state.
SOLD_OUT, POSTPONED = ["entradas agotadas", "sold out", "soldout"], ["pospuesto"]


def _given(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def price_label(c: Column) -> Column:
    """What a text says of the price: free, the first amount as written, to be asked for, or nothing."""
    low = F.lower(_given(c))
    return F.when(text.contains_any(low, FREE_TEXTS), FREE).when(_given(c).rlike(AMOUNT_SIGN), F.regexp_extract(c, AMOUNT_SIGN, 0)).when(text.contains_any(low, PRICED_WORDS), ASK).otherwise("")


def price_canon(c: Column) -> Column:
    """One word for all forms of free entry; other prices stay as they are."""
    return F.when(text.contains_any(F.lower(_given(c)), FREE_PRICES), FREE).otherwise(c)


def price_in_words(c: Column) -> Column:
    """``12€`` out of "12 euros", with a remark where charges are included; else to be asked for."""
    amount = F.regexp_extract(_given(c), f"(?i){AMOUNT_WORD}", 1)
    return F.when(amount == "", ASK).otherwise(F.concat(amount, F.lit("€"), F.when(F.contains(F.lower(c), F.lit(CHARGES)), " (gastos incl.)").otherwise("")))


def titled_category(title: Column, context: Column, by_title: list[tuple[str, list[str]]], by_context: list[tuple[str, list[str]]], default: str = "Evento") -> Column:
    """The category before a title, else the first of an ordered cascade with a keyword in the title, else one
    in the context."""
    low = F.lower(title)
    out = None
    for k in text.CATEGORIES:
        before = low.startswith(f"{k.lower()}: ")
        out = F.when(before, F.lit(k)) if out is None else out.when(before, F.lit(k))
    for c, cascade in ((low, by_title), (F.lower(_given(context)), by_context)):
        for name, words in cascade:
            out = out.when(text.contains_any(c, words), F.lit(name))
    return out.otherwise(F.lit(default))


def without_categories(title: Column) -> Column:
    """A title in small letters with every category prefix taken out, wherever it stands."""
    out = F.lower(_given(title))
    for k in text.CATEGORIES:
        out = F.replace(out, F.lit(f"{k.lower()}:"), F.lit(""))
    return F.trim(out)


def status_note(c: Column) -> Column:
    """Sold out, what stands between double marks, or postponed; '' for none."""
    low = F.lower(_given(c))
    return F.when(text.contains_any(F.regexp_replace(low, r"\s+", " "), SOLD_OUT), "ENTRADAS AGOTADAS").when(F.contains(low, F.lit("¡¡")), F.trim(F.regexp_extract(c, "¡¡(.+?)!!", 1))).when(text.contains_any(low, POSTPONED), "POSPUESTO").otherwise("")


def place_named(c: Column, kind: str = "sala") -> Column:
    """The place in the first brackets, else what follows the kind of place, else ''."""
    inside = F.trim(F.regexp_extract(_given(c), r"\(([^)]+)\)", 1))
    after = F.trim(F.regexp_extract(_given(c), rf"(?i){kind}\s+([A-Za-záéíóúü\s]+)", 1))
    return F.when(inside != "", inside).when(after != "", F.concat(F.lit(kind.capitalize() + " "), after)).otherwise("")


def main_act(c: Column, prefixes: list[str]) -> Column:
    """The first act of a heading without what stands before a name."""
    bare = F.regexp_replace(_given(c), "(?i)^" + dates.any_of(prefixes) + r"\s+", "")
    return F.trim(F.split(bare, r"(?i)\s*\+\s*|\bcon\b", 2)[0])


def spoken_in(source: Column, spanish: list[str]) -> Column:
    """The language of a source: Spanish where its name holds one of the words."""
    return F.when(text.contains_any(F.lower(_given(source)), spanish), "es").otherwise("en")


def shown(c: Column, most: int) -> Column:
    """The lead of a text that a card shows."""
    return F.left(_given(c), F.lit(most))


def days_left(end: Column, today: Column) -> Column:
    return F.datediff(end, today)


def urgent(end: Column, today: Column, within: int = 7) -> Column:
    """Ending today or within a week."""
    return F.coalesce(days_left(end, today).between(0, within), F.lit(False))






def shown_date(c: Column) -> Column:
    """A day out of a displayed date: ISO, d/m/yyyy or "d month yyyy"; the first form that occurs decides."""
    iso, figures = dates.written("Y - MM - DD"), dates.written("D / M / Y")
    slashes = figures[0].replace(r"[/\-]", "/")
    named = r"(\d{1,2})\s+(\w+)\s+(\d{4})"
    part = lambda p, k: F.regexp_extract(c, p, k).try_cast("int")
    return (
        F.when(c.rlike(iso[0]), dates._day(part(iso[0], 1), part(iso[0], 2), part(iso[0], 3)))
        .when(c.rlike(slashes), dates._day(part(slashes, 3), part(slashes, 2), part(slashes, 1)))
        .when(c.rlike(named), dates._day(part(named, 3), dates.month_es(F.lower(F.regexp_extract(c, named, 2))), part(named, 1)))
    )


def infobox_value(c: Column, name: str) -> Column:
    """The value of a field of an encyclopedia's information box, as marked up, over several lines."""
    return F.regexp_extract(_given(c), rf"(?is)\|\s*{name}\s*=\s*(.*?)(?:\n\s*\||\n\s*\}}\}})", 1)


def said(items: Column) -> Column:
    """The items of a list that say something, trimmed."""
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: F.trim(x)), lambda x: F.length(x) > 0)


def list_inside(c: Column) -> Column:
    """The list in a JSON text: the text itself if it is one, else the first list among an object's fields."""
    t = F.trim(_given(c))
    inner = F.regexp_extract(t, r"(?s):\s*(\[.*\])\s*[,}]", 1)
    found = F.when(t.startswith("["), t).otherwise(F.nullif(inner, F.lit("")))
    return F.when(F.try_parse_json(found).isNotNull(), found)


def bonus(score: Column, price: Column, is_new: Column) -> Column:
    """A score with one more for free entry and two for what is new."""
    return score + F.when(F.lower(_given(price)).isin("gratis", "free"), 1).otherwise(0) + F.when(F.coalesce(is_new, F.lit(False)), 2).otherwise(0)


def read_as_utf8(c: Column) -> Column:
    """Text whose letters are all bytes of UTF-8 read one by one, read as UTF-8; other text stays as it is."""
    bytes_only = c.rlike(r"^[\x00-\xFF]*$") & c.rlike(r"[\xC2-\xF4][\x80-\xBF]")
    again = F.try_validate_utf8(F.encode(F.when(bytes_only, c).otherwise(""), "ISO-8859-1").cast("string"))
    return F.when(bytes_only, F.coalesce(again, c)).otherwise(c)
