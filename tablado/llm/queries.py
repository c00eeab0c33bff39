"""Queries of the subpackage: name -> (spark, directory) -> DataFrame, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablado.io import cut, table
from tablado.llm.canonical import Dictionary, map_values, source_names, url_sections
from tablado.llm.content import Model, fit, main_content, page_furniture
from tablado.llm.dedup_history import repeats_by_batches, take_apart, title_parser
from tablado.llm.encoding import damaged_fields
from tablado.llm.leakage import leaked_passages
from tablado.llm.mixing import mix
from tablado.llm.plan_keys import page_key
from tablado.llm.residue import residue_documents
from tablado.llm.survivors import MEASURED, best_values, measured, measured_rows
from tablado.operators.timestamps import madrid_day, normalise_timestamps, parse_instant_text

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# 2. New batches against all history.

#: Batches of arrival that are merged at a time.
MERGED_AT_ONCE = 30


def _apart(spark: SparkSession, d: str, model: Model) -> tuple[DataFrame, DataFrame]:
    """Rows of plan_history and of normalizer with their keys, the latter with their batch."""
    history, rows, sources = table(spark, d, "plan_history"), table(spark, d, "normalizer"), table(spark, d, "source_catalog")
    parser = title_parser(history.select("titulo"), rows.select("titulo"), history.select("categoria"), table(spark, d, "venue_catalog").select("venue_id", "name"), model)
    listings = {page_key(r.url) for r in sources.select("url").where("url <> ''").distinct().collect()}
    cols = lambda df, *rest: df.select("row_id", "id", F.col("enlace").alias("page"), F.col("titulo").alias("title"), *rest)
    return take_apart(cols(history), parser, listings), take_apart(cols(rows, "batch_no"), parser, listings, keep=["batch_no"])


def _plans(spark: SparkSession, history: DataFrame, rows: DataFrame) -> DataFrame:
    """(row_id, first_row_id) of every row that repeats an earlier one; the rows are merged by batches."""
    last = rows.agg(F.max("batch_no")).first()[0] or 0
    number = F.coalesce("batch_no", F.lit(last))
    groups = [rows.where((number > a) & (number <= a + MERGED_AT_ONCE)) for a in range(0, last, MERGED_AT_ONCE)] or [rows]
    return repeats_by_batches(spark, history, groups)


@query()
def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every normalizer row whose plan occurred before, with that plan's first row."""
    history, rows = (cut(x) for x in _apart(spark, d, _page_model(spark, d)))
    return _plans(spark, history, rows).join(rows.select("row_id"), "row_id", "left_semi").select("first_row_id", "row_id")


# 3. Page boilerplate.


def _page_model(spark: SparkSession, d: str) -> Model:
    return fit(table(spark, d, "plan_history"), "titulo", "descripcion", table(spark, d, "source_catalog"), "name")


@query()
def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Every line of page furniture; line 0 is a title that carries words of the site."""
    return page_furniture(table(spark, d, "normalizer"), "row_id", "titulo", "descripcion", _page_model(spark, d))


@query()
def p3_content(spark: SparkSession, d: str) -> DataFrame:
    """The plan's own title and main text of every row."""
    return main_content(table(spark, d, "normalizer"), "row_id", "titulo", "descripcion", _page_model(spark, d))


# 4. Garbled text.


@query()
def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Every field value in which a character was decoded wrongly."""
    return damaged_fields(table(spark, d, "normalizer"), "row_id", ["titulo", "descripcion", "precio"]).select("row_id", "field_name").distinct()


@query()
def p4_restored(spark: SparkSession, d: str) -> DataFrame:
    """The affected values, restored where nothing was lost."""
    found = damaged_fields(table(spark, d, "normalizer"), "row_id", ["titulo", "descripcion", "precio"])
    return found.select("row_id", "field_name", F.when(~F.col("lost"), F.col("restored")).alias("restored"), "lost").distinct()


# 5. Best representative.


def _best(spark: SparkSession, d: str) -> DataFrame:
    """(first_row_id, field_name, row_id, size, trust, seen) of the values that compete for each field of the
    plans that occur at least twice."""
    model = _page_model(spark, d)
    sources = table(spark, d, "source_catalog")
    dictionary = Dictionary(*source_names(table(spark, d, "normalizer"), "fuente", sources, "source_id", "name"), SOURCE_DECORATIONS + url_sections(sources, "url"))
    trust = {r.source_id: r.trust or 0 for r in sources.select("source_id", "trust").collect()}

    known: dict[str, int] = {}

    def trusted(source: str | None) -> int:
        """The trust of a source, however its name is spelled; names recur."""
        if not source:
            return 0
        if (hit := known.get(source)) is None:
            if len(known) > 100_000:
                known.clear()
            hit = known[source] = trust.get(dictionary.match(source), 0)
        return hit

    def worth(b: pd.DataFrame) -> pd.DataFrame:
        return measured(b["titulo"], b["descripcion"], b["precio"], model).assign(trust=[trusted(v) for v in b["fuente"]])

    history, rows = (cut(x) for x in _apart(spark, d, model))
    # A plan is named by its root until its rows are known; hot plans are counted by partial aggregation.
    rooted = rows.select("row_id").join(_plans(spark, history, rows), "row_id", "left").select("row_id", F.coalesce("first_row_id", "row_id").alias("root"))
    plans = rooted.groupBy("root").agg(F.min("row_id").alias("first_row_id"), F.count("*").alias("n")).where("n > 1").select("root", "first_row_id")
    members = cut(rooted.join(plans, "root").select("row_id", "first_row_id").distinct())
    # Texts are read for the rows of these plans only and not moved: what competes is numbers.
    kept = ["fecha_inicio", "fecha_fin", "_extracted_at"]
    texts = table(spark, d, "normalizer").select("row_id", *kept, "titulo", "descripcion", "precio", "fuente")
    own = measured_rows(texts, members.select("row_id"), worth, f"{MEASURED}, trust int", kept)
    at = parse_instant_text(F.col("_extracted_at"))
    own = own.withColumns({"at": at, "seen": F.coalesce(F.unix_micros(at), F.lit(0).cast("bigint"))}).drop("_extracted_at")
    named = cut(own.join(members, "row_id"))
    keys = ["first_row_id", "row_id", "trust", "seen"]
    entry = lambda name, usable, size: F.struct(F.lit(name).alias("field_name"), usable.alias("usable"), size.alias("size"))
    texts = named.select(*keys, F.explode(F.array(entry("descripcion", F.col("length").isNotNull(), F.coalesce("length", F.lit(0))), entry("precio", F.col("priced"), F.lit(0)))).alias("x")).where("x.usable")
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("fecha_inicio", "fecha_fin")]))
    dates = normalise_timestamps(named.select(*keys, "at", both.alias("x")).select(*keys, "at", "x.field_name", "x.value"), "value", anchor=madrid_day(F.col("at")), only_read=True)
    return texts.select("first_row_id", "x.field_name", "row_id", "x.size", "trust", "seen").unionByName(dates.select("first_row_id", "field_name", "row_id", F.lit(0).alias("size"), "trust", "seen"))


@query()
def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """For every plan with several rows and every field, the row whose value is best in every respect."""
    return best_values(_best(spark, d), "first_row_id", "field_name", "row_id", [F.col("size"), F.col("trust"), F.col("seen")]).select("first_row_id", "field_name", "row_id")


@query()
def p5_records(spark: SparkSession, d: str) -> DataFrame:
    """One record for every plan with several rows: each field's first value in the ranking and its row."""
    rows = table(spark, d, "normalizer")
    best = best_values(_best(spark, d), "first_row_id", "field_name", "row_id", [F.col("size"), F.col("trust"), F.col("seen")], dominant=False)
    fields = ["descripcion", "precio", "fecha_inicio", "fecha_fin"]
    value = F.coalesce(*[F.when(F.col("field_name") == f, F.col(f)) for f in fields])
    taken = best.join(rows.select("row_id", *fields), "row_id").select("first_row_id", "field_name", "row_id", value.alias("value"))
    one = [F.max(F.when(F.col("field_name") == f, F.struct("value", "row_id"))).alias(f) for f in fields]
    records = taken.groupBy("first_row_id").agg(*one)
    return records.select("first_row_id", *[x for f in fields for x in (F.col(f"{f}.value").alias(f), F.col(f"{f}.row_id").alias(f"{f}_row"))])


# 6. Free-entered values.

#: Words that scrapers append to a source's name, besides the sections of its listing pages.
SOURCE_DECORATIONS = ["agenda", "portada", "redaccion", "rss", "web"]


def _mapped(spark: SparkSession, d: str, keep_exact: bool = False) -> DataFrame:
    venues, sources = table(spark, d, "venue_catalog"), table(spark, d, "source_catalog")
    a = map_values(table(spark, d, "concerts"), "concert_id", "venue", venues, "venue_id", "name", kinds=True, keep_exact=keep_exact)
    b = map_values(table(spark, d, "normalizer"), "row_id", "fuente", sources, "source_id", "name", decorations=SOURCE_DECORATIONS + url_sections(sources, "url"), keep_exact=keep_exact)
    cols = lambda x, field, key: x.select(F.lit(field).alias("field_name"), F.col(key).alias("row_key"), "value", "ref_id")
    return cols(a, "venue", "concert_id").unionByName(cols(b, "fuente", "row_id"))


@query()
def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """The entry that every value not spelled as an entry means."""
    return _mapped(spark, d).select("field_name", "row_key", "ref_id").distinct()


@query()
def p6_misses(spark: SparkSession, d: str) -> DataFrame:
    """The values that mean no entry and how many rows have them."""
    return _mapped(spark, d).where("ref_id = -1").groupBy("field_name", F.trim(F.regexp_replace(F.lower("value"), r"\s+", " ")).alias("value")).agg(F.count("*").alias("n"))


# 8. Leaked evaluation passages.


def _leaks(spark: SparkSession, d: str) -> DataFrame:
    return leaked_passages(table(spark, d, "documents"), "doc_id", "text", table(spark, d, "eval_items"), "item_id", "text")


@query()
def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document that contains a passage of a test item."""
    return _leaks(spark, d).select(F.col("doc").alias("doc_id"), F.col("item").alias("item_id"))


@query()
def p8_items(spark: SparkSession, d: str) -> DataFrame:
    """Every test item with the number of documents it leaked into and its longest leaked passage."""
    leaks = _leaks(spark, d).groupBy(F.col("item").alias("item_id")).agg(F.count("*").alias("n_docs"), F.max("n_words").alias("longest"))
    return table(spark, d, "eval_items").select("item_id", "suite").join(leaks, "item_id", "left").select("item_id", "suite", F.coalesce("n_docs", F.lit(0).cast("bigint")).alias("n_docs"), F.coalesce("longest", F.lit(0)).alias("longest"))


# 9. Mixing sources.


@query()
def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """Every document of the mix and how often it is used."""
    return mix(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))[0]


@query()
def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """The share of all tokens that each source was to have and has."""
    return mix(table(spark, d, "documents"), "doc_id", "text", "source", table(spark, d, "mix_targets"))[1]


# 10. Template residue and error pages.


@query()
def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Every document in which residue stands in place of content."""
    return residue_documents(table(spark, d, "documents"), "doc_id", "text").select("doc_id")


@query()
def p10_kept(spark: SparkSession, d: str) -> DataFrame:
    """How many documents of each source and kind are left out and kept."""
    documents = table(spark, d, "documents")
    found = residue_documents(documents, "doc_id", "text").select("doc_id", F.lit(1).alias("left_out"))
    out = F.sum(F.coalesce("left_out", F.lit(0)))
    return documents.join(found, "doc_id", "left").groupBy("source", "kind").agg(out.alias("left_out"), (F.count("*") - out).alias("kept"))
