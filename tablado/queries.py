"""Queries of the core: name -> (spark, directory) -> DataFrame, and the SQL that states the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tablado.functions import dates as D
from tablado.functions import listing as L
from tablado.functions import text as T
from tablado.io import cut, table
from tablado.operators import dedup, enrich, filters, history, rank
from tablado.operators.score import Topic, count_reasons, counted_score, with_topics
from tablado.operators.split_values import delimiter_report, split_values
from tablado.operators.timestamps import madrid_day, normalise_timestamps, parse_instant_text
from tablado.plans import concerts as concert_plans
from tablado.plans import news as news_plans
from tablado.plans import plans as plan_plans

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


@query()
def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Every act of every bill with its position."""
    concerts = table(spark, d, "concerts")
    return split_values(concerts, "lineup", "concert_id", source="source", known=concerts.select("artist"))


@query()
def p1_delimiters(spark: SparkSession, d: str) -> DataFrame:
    """What was inferred: the score of each delimiter for each source."""
    return delimiter_report(table(spark, d, "concerts"), "lineup", source="source")


def _dated_values(spark: SparkSession, d: str, only_read: bool = False) -> DataFrame:
    concerts = table(spark, d, "concerts").select(F.lit("date_str").alias("field_name"), F.col("concert_id").alias("row_key"), F.col("date_str").alias("value"), madrid_day(F.col("scraped_at")).alias("seen"))
    plans = table(spark, d, "normalizer").select("row_id", "fecha_inicio", "fecha_fin", madrid_day(parse_instant_text(F.col("_extracted_at"))).alias("seen"))
    both = F.explode(F.array(*[F.struct(F.lit(c).alias("field_name"), F.col(c).alias("value")) for c in ("fecha_inicio", "fecha_fin")]))
    plans = plans.select(both.alias("v"), F.col("row_id").alias("row_key"), "seen").select("v.field_name", "row_key", "v.value", "seen")
    rows = concerts.unionByName(plans)
    return normalise_timestamps(rows, "value", anchor=F.col("seen"), only_read=only_read)


@query()
def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every date value that names a full day, in its normal form."""
    return _dated_values(spark, d, only_read=True).select("field_name", "row_key", "norm_value").distinct()


@query()
def p7_unread(spark: SparkSession, d: str) -> DataFrame:
    """How many values of each field and shape name no full day (digits as 9, letters as a)."""
    # Written once: a test of the result would be moved below the steps that make it, and double them.
    left = cut(_dated_values(spark, d).select("field_name", "value", "norm_value")).where("norm_value is null and trim(value) <> ''")
    shape = F.regexp_replace(F.regexp_replace(F.lower("value"), r"\d", "9"), r"(?U)[^\W\d]+", "a")
    return left.groupBy("field_name", shape.alias("shape")).agg(F.count("*").alias("n"), F.min("value").alias("example"))


# The listing operators on the listing tables.  Each SQL states the same on the same tables.

#: Test vocabularies: words that the listing tables use.
NOISE = ["futbol", "liga", "relojes", "sal", "cometas"]
TOPICS = [Topic("sky", "Cielo", 5, ("cometas", "azoteas", "volcan")), Topic("sea", "Mar", 3, ("mareas", "sal", "salinas")), Topic("craft", "Oficio", 5, ("ceramica", "telares", "taller")), Topic("night", "Noche", 2, ("noche de", "luz"))]
REFUSED = ["sombra", "papel"]
CITIES = ["barcelona", "bilbao", "sevilla", "valencia", "zaragoza"]
CASCADE = [("Música", ["concierto", "festival", "en directo"]), ("Arte", ["exposición", "museo", "cerámica"]), ("Taller", ["taller", "jardín"]), ("Cine", ["cine", "luz |"])]
TIERS = [(2, ["melodic", "death"]), (1, ["metal", "hard"])]
NOW = "TIMESTAMP '2026-03-15 10:00:00'"
TODAY = "DATE '2026-03-15'"

# SQL for the functions the queries share.
_FOLD = "trim(regexp_replace(lower(translate({0}, '" + T.ACCENTED + "', '" + T.PLAIN + "')), '[\\s\\x{{00A0}}]+', ' ', 'g'))"
_SQUEEZE = "trim(regexp_replace({0}, '[\\s\\x{{00A0}}]+', ' ', 'g'))"


def _sql_fold(c: str) -> str:
    return _FOLD.format(f"coalesce({c}, '')")


def _sql_hay(title: str, *rest: str) -> str:
    return "' ' || " + " || ' ' || ".join(_sql_fold(x) for x in (title, title, *rest)) + " || ' '"


def _sql_display_date(c: str) -> str:
    return f"coalesce(CASE WHEN regexp_full_match(trim({c}), '\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}') THEN try_strptime(trim({c}), '%d/%m/%Y')::DATE END, CASE WHEN regexp_matches(trim({c}), '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}') THEN try_strptime(regexp_extract(trim({c}), '^\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}'), '%Y-%m-%d')::DATE END)"


_NOISE_SQL = T.keyword_pattern(NOISE)


@query(
    f"""WITH kept AS (SELECT *, row_number() OVER (PARTITION BY title ORDER BY article_id) AS k FROM news_articles
        WHERE coalesce(title, '') <> '' AND coalesce(url, '') <> ''
        AND NOT regexp_matches({_sql_hay("title", "substr(coalesce(description, ''), 1, 200)")}, '{_NOISE_SQL}'))
    SELECT article_id, title, source, pub_date FROM kept WHERE k = 1 ORDER BY pub_date DESC NULLS LAST, article_id LIMIT 130"""
)
def news_noise_cap(spark: SparkSession, d: str) -> DataFrame:
    """Noise dropped, the first row of each title kept, the newest 130 taken (a capped report)."""
    rows = table(spark, d, "news_articles").where(filters.filled(F.col("title"), F.col("url")) & filters.without_keywords(F.col("title"), F.col("description"), NOISE))
    first = dedup.keep_first(rows, [F.col("title")], [F.col("article_id")])
    return first.orderBy(F.col("pub_date").desc_nulls_last(), "article_id").limit(130).select("article_id", "title", "source", "pub_date")


@query(f"SELECT article_id, title, source FROM news_articles WHERE pub_date IS NULL OR pub_date >= {NOW} - INTERVAL 30 HOUR")
def news_recency(spark: SparkSession, d: str) -> DataFrame:
    """Undated articles and those of the last 30 hours before a stated time."""
    rows = table(spark, d, "news_articles").withColumn("pub_date", F.col("pub_date").cast("timestamp"))
    return rows.where(filters.not_older(F.col("pub_date"), F.expr(NOW), "30 HOURS")).select("article_id", "title", "source")


_BARE_DESCRIPTION = "coalesce(description, '')"
for _ref, _sign in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", "\u00a0"), ("&amp;", "&")):
    _BARE_DESCRIPTION = f"replace({_BARE_DESCRIPTION}, '{_ref}', '{_sign}')"


@query(f"SELECT article_id, {_SQUEEZE.format(f'regexp_replace({_BARE_DESCRIPTION}, {chr(39)}<[^>]+>{chr(39)}, {chr(39) * 2}, {chr(39)}g{chr(39)})')} AS clean FROM news_articles")
def clean_text(spark: SparkSession, d: str) -> DataFrame:
    """References resolved, tags dropped and white space squeezed in every description."""
    return table(spark, d, "news_articles").select("article_id", T.clean_markup(F.coalesce("description", F.lit(""))).alias("clean"))


@query(f"SELECT article_id, CASE WHEN description IS NOT NULL THEN {_SQUEEZE.format(f'regexp_replace({_BARE_DESCRIPTION}, {chr(39)}<[^>]+>{chr(39)}, {chr(39) * 2}, {chr(39)}g{chr(39)})')} END AS clean FROM news_articles")
def clean_markup(spark: SparkSession, d: str) -> DataFrame:
    """The same with missing descriptions left missing."""
    return table(spark, d, "news_articles").select("article_id", T.clean_markup(F.col("description")).alias("clean"))


def _topic_sql() -> str:
    hay = _sql_hay("titulo", "categoria", "substr(coalesce(descripcion, ''), 1, 300)")
    hits = {t.name: f"regexp_matches(hay, '{T.keyword_pattern(list(t.keywords))}')" for t in TOPICS}
    score = " + ".join(f"CASE WHEN {hits[t.name]} THEN {t.weight} ELSE 0 END" for t in TOPICS)
    order = sorted(TOPICS, key=lambda t: -t.weight)
    best = "CASE " + " ".join(f"WHEN {hits[t.name]} THEN '{t.name}'" for t in order) + " ELSE '' END"
    label = "CASE " + " ".join(f"WHEN {hits[t.name]} THEN '{t.label}'" for t in order) + " ELSE '' END"
    return f"WITH h AS (SELECT row_id, {hay} AS hay FROM normalizer) SELECT row_id, {score} AS score, {best} AS topic, {label} AS label FROM h"


@query(_topic_sql())
def topic_score(spark: SparkSession, d: str) -> DataFrame:
    """Topic scores and the best topic of every plan."""
    return with_topics(table(spark, d, "normalizer"), F.col("titulo"), F.col("descripcion"), F.col("categoria"), TOPICS).select("row_id", "score", "topic", "label")


@query(f"WITH s AS ({_topic_sql()}) SELECT row_id, score, topic FROM s WHERE score >= 5 ORDER BY score DESC, row_id LIMIT 100")
def ranked_plans(spark: SparkSession, d: str) -> DataFrame:
    """The hundred plans of the highest score (a top-k report)."""
    return topic_score(spark, d).where("score >= 5").orderBy(F.desc("score"), "row_id").limit(100).select("row_id", "score", "topic")


@query("SELECT row_id FROM normalizer WHERE NOT (" + " OR ".join(f"contains(lower(coalesce(titulo, '')) || ' ' || lower(substr(coalesce(descripcion, ''), 1, 300)), '{w}')" for w in REFUSED) + ")")
def strict_exclude(spark: SparkSession, d: str) -> DataFrame:
    """Plans without any refused word in title or lead."""
    return table(spark, d, "normalizer").where(filters.without_words(F.col("titulo"), F.col("descripcion"), REFUSED)).select("row_id")


_TEXT_SQL = "lower(concat_ws(' ', titulo, descripcion, categoria))"


@query(f"SELECT row_id, 4 * ({' + '.join(f'contains({_TEXT_SQL}, {chr(39)}{w}{chr(39)})::INT' for w in ('cometas', 'azoteas'))}) + 2 * ({' + '.join(f'contains({_TEXT_SQL}, {chr(39)}{w}{chr(39)})::INT' for w in ('mareas', 'taller'))}) AS score FROM normalizer")
def keyword_count_score(spark: SparkSession, d: str) -> DataFrame:
    """Counted keywords with two weights."""
    return table(spark, d, "normalizer").select("row_id", counted_score(F.concat_ws(" ", "titulo", "descripcion", "categoria"), ["cometas", "azoteas"], ["mareas", "taller"]).alias("score"))


_CATEGORY_SQL = "CASE " + " ".join(f"WHEN starts_with(titulo, '{k}: ') THEN '{k}'" for k in T.CATEGORIES) + " ELSE coalesce(categoria, '') END"
_BARE_SQL = "CASE " + " ".join(f"WHEN starts_with(titulo, '{k}: ') THEN substr(titulo, {len(k) + 3})" for k in T.CATEGORIES) + " ELSE titulo END"
_CASCADE_SQL = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(titulo), '{w}')" for w in ws) + f" THEN '{n}'" for n, ws in CASCADE) + " ELSE 'Evento' END"


@query(f"SELECT row_id, {_CATEGORY_SQL} AS category, {_BARE_SQL} AS title, {_CASCADE_SQL} AS cascade FROM normalizer WHERE titulo IS NOT NULL")
def category_cascade(spark: SparkSession, d: str) -> DataFrame:
    """The category before a title, the title without it, and the category an ordered keyword cascade gives."""
    t = F.col("titulo")
    rows = table(spark, d, "normalizer").where("titulo is not null")
    return rows.select("row_id", T.category_of(t, F.coalesce("categoria", F.lit(""))).alias("category"), T.without_category(t).alias("title"), T.keyword_category(t, CASCADE, "Evento").alias("cascade"))


_START, _END = _sql_display_date("fecha_inicio"), _sql_display_date("fecha_fin")
_OPEN_SQL = "regexp_matches(lower(concat_ws(' ', titulo, descripcion)), '" + "|".join(w.replace(" ", "\\s+") for w in filters.OPEN_ENDED) + "')"
_WINDOW_SQL = f"""CASE WHEN s IS NULL AND e IS NULL THEN true WHEN s IS NULL THEN e >= {TODAY}
    WHEN e IS NULL THEN s <= {TODAY} + INTERVAL 56 DAY AND (s >= {TODAY} OR {TODAY} - s <= 56 OR open_ended)
    ELSE s <= {TODAY} + INTERVAL 56 DAY AND e >= {TODAY} END"""
_DATED = f"(SELECT *, {_START} AS s, {_END} AS e, {_OPEN_SQL} AS open_ended FROM normalizer)"


@query(f"SELECT row_id, s AS start_day, e AS end_day FROM {_DATED} WHERE {_WINDOW_SQL}")
def validity_window(spark: SparkSession, d: str) -> DataFrame:
    """Plans whose run touches the coming eight weeks."""
    keeps = filters.runs_within(F.col("fecha_inicio"), F.col("fecha_fin"), F.expr(NOW), 8, filters.open_ended(F.col("titulo"), F.col("descripcion")))
    return table(spark, d, "normalizer").where(keeps).select("row_id", D.display_date(F.col("fecha_inicio")).alias("start_day"), D.display_date(F.col("fecha_fin")).alias("end_day"))


_JUNK = ["cine", "agenda", "rol"]
_JUNK_PATTERNS = [r"^\d{4}$", r"^por que ", r"^inicio "]
_PROPER_SQL = f"NOT (length({_sql_fold('titulo')}) < 4 OR {_sql_fold('titulo')} IN ('cine', 'agenda', 'rol') OR regexp_matches({_sql_fold('titulo')}, '(?:^\\d{{4}}$)|(?:^por que )|(?:^inicio )'))"
_WORDS_SQL = "NOT (" + " OR ".join(f"contains(lower(coalesce(titulo, '')) || ' ' || lower(substr(coalesce(descripcion, ''), 1, 300)), '{w}')" for w in REFUSED) + ")"


@query(f"SELECT CASE WHEN NOT ({_PROPER_SQL}) THEN 'junk' WHEN NOT ({_WORDS_SQL}) THEN 'words' WHEN NOT ({_WINDOW_SQL}) THEN 'window' ELSE 'kept' END AS reason, count(*) AS n FROM {_DATED} GROUP BY 1")
def exclusion_reasons(spark: SparkSession, d: str) -> DataFrame:
    """How many plans each of three ordered predicates drops first, and how many are kept."""
    rows = table(spark, d, "normalizer")
    window = filters.runs_within(F.col("fecha_inicio"), F.col("fecha_fin"), F.expr(NOW), 8, filters.open_ended(F.col("titulo"), F.col("descripcion")))
    return count_reasons(rows, [("junk", filters.proper_title(F.col("titulo"), _JUNK, _JUNK_PATTERNS)), ("words", filters.without_words(F.col("titulo"), F.col("descripcion"), REFUSED)), ("window", window)])


@query("SELECT concert_id, artist FROM concerts WHERE date_obj BETWEEN DATE '2026-03-15' AND DATE '2026-03-15' + 56")
def date_window(spark: SparkSession, d: str) -> DataFrame:
    """Concerts of the coming 56 days; undated ones are dropped."""
    return table(spark, d, "concerts").where(filters.within_days(F.col("date_obj"), F.expr(TODAY), 56)).select("concert_id", "artist")


_MONTH_SQL = "CASE {0} " + " ".join(f"WHEN '{n}' THEN {i}" for i, (a, b) in enumerate(zip(D.MONTHS, D.SHORT_MONTHS, strict=True), 1) for n in (a, b)) + " ".join(f" WHEN '{k}' THEN {v}" for k, v in D.ENGLISH_SHORT.items()) + " END"


def _sql_day(y: str, m: str, d: str) -> str:
    return f"try_strptime(lpad(({y})::VARCHAR, 4, '0') || '-' || lpad(({m})::VARCHAR, 2, '0') || '-' || lpad(({d})::VARCHAR, 2, '0'), '%Y-%m-%d')::DATE"


def _event_date_sql() -> str:
    found = []
    for form in D.READINGS:
        p, at = D.written(form)
        part = lambda g, p=p: f"nullif(regexp_extract(t, '{p}', {g}), '')::INT"
        month = _MONTH_SQL.format(f"regexp_extract(t, '{p}', {at['N']})") if "N" in at else part(at["M"])
        day = part(at["D"])
        if "Y" in at or "y" in at:
            found.append(_sql_day(part(at["Y"]) if "Y" in at else part(at["y"]) + " + 2000", month, day))
        else:
            this, following = _sql_day("2026", month, day), _sql_day("2027", month, day)
            found.append(f"CASE WHEN {this} < {TODAY} THEN {following} ELSE {this} END")
    return f"WITH x AS (SELECT concert_id, lower({_SQUEEZE.format('date_str')}) AS t FROM concerts) SELECT concert_id, coalesce({', '.join(found)}) AS day FROM x"


@query(_event_date_sql())
def event_dates(spark: SparkSession, d: str) -> DataFrame:
    """The first of five readings of every date text that is a real day."""
    return table(spark, d, "concerts").select("concert_id", D.event_date(F.col("date_str"), F.expr(TODAY)).alias("day"))


_NAME_SQL = lambda names, n: "CASE " + n + " " + " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(names, 1)) + " END"


@query(
    f"""SELECT o_orderkey, day(o_orderdate) || ' ' || {_NAME_SQL(D.SHORT_MONTHS, 'month(o_orderdate)')} || ' ' || year(o_orderdate) AS short,
    day(o_orderdate) || ' de ' || {_NAME_SQL(D.MONTHS, 'month(o_orderdate)')} || ' de ' || year(o_orderdate) AS long,
    strftime(o_orderdate, '%d/%m/%Y') || ' · ' || {_NAME_SQL(D.WEEKDAYS, 'isodow(o_orderdate)')} AS card FROM orders"""
)
def date_display_es(spark: SparkSession, d: str) -> DataFrame:
    """Days written out in Spanish in three forms."""
    day = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", D.short_date_es(day).alias("short"), D.long_date_es(day).alias("long"), D.card_date_es(day).alias("card"))


_M = "|".join(D.MONTHS)
_RANGE_TEXT_SQL = "CASE o_orderkey % 4 WHEN 0 THEN 'Abierto del ' || a || ' al ' || b WHEN 1 THEN 'Hasta el ' || b WHEN 2 THEN 'a partir del ' || a WHEN 3 THEN 'Solo el ' || a END"
_LONG_SQL = lambda c: f"(day({c}) || ' de ' || {_NAME_SQL(D.MONTHS, f'month({c})')} || ' de ' || year({c}))"


@query(
    f"""SELECT o_orderkey, CASE WHEN o_orderkey % 4 <> 1 THEN strftime(o_orderdate, '%d/%m/%Y') END AS start_text,
    CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate + INTERVAL 9 DAY, '%d/%m/%Y') END AS end_text,
    CASE WHEN o_orderkey % 4 < 2 THEN strftime(o_orderdate + INTERVAL 9 DAY, '%d/%m/%Y') ELSE '' END AS closing FROM orders"""
)
def date_ranges(spark: SparkSession, d: str) -> DataFrame:
    """Ranges written out in four forms and read back by the cascade (the modulus chooses the form, all rows stay)."""
    a, b = D.long_date_es(F.to_date("o_orderdate")), D.long_date_es(F.date_add(F.to_date("o_orderdate"), 9))
    form = F.col("o_orderkey") % 4
    text = F.when(form == 0, F.concat(F.lit("Abierto del "), a, F.lit(" al "), b)).when(form == 1, F.concat(F.lit("Hasta el "), b)).when(form == 2, F.concat(F.lit("a partir del "), a)).otherwise(F.concat(F.lit("Solo el "), a))
    rows = table(spark, d, "orders").select("o_orderkey", text.alias("t"))
    r = D.range_text(F.col("t"), F.expr(TODAY))
    return rows.select("o_orderkey", r["start"].alias("start_text"), r["end"].alias("end_text"), D.end_date_text(F.col("t"), F.expr(TODAY)).alias("closing"))


_BUCKET_SQL = f"""CASE WHEN e BETWEEN {TODAY} AND {TODAY} + 7 THEN 'ending_soon'
    WHEN coalesce(floor((epoch({NOW}) - epoch(seen)) / 86400) <= 8, false) AND (s IS NULL OR s >= {NOW} - INTERVAL 21 DAY) THEN 'new' ELSE 'ongoing' END"""
_SEEN_SQL = f"(SELECT row_id, {_START} AS s, {_END} AS e, (_extracted_at::TIMESTAMPTZ AT TIME ZONE 'UTC') AS seen FROM normalizer)"


def _lifecycle(spark: SparkSession, d: str) -> DataFrame:
    start, end = D.display_date(F.col("fecha_inicio")), D.display_date(F.col("fecha_fin"))
    bucket = rank.lifecycle(start, end, parse_instant_text(F.col("_extracted_at")), F.expr(NOW))
    return table(spark, d, "normalizer").select("row_id", start.alias("s"), end.alias("e"), bucket.alias("bucket"))


@query(f"SELECT {_BUCKET_SQL} AS bucket, count(*) AS n, count(e) AS with_end FROM {_SEEN_SQL} GROUP BY 1")
def lifecycle_buckets(spark: SparkSession, d: str) -> DataFrame:
    """Plans ending soon, new and ongoing, counted."""
    return _lifecycle(spark, d).groupBy("bucket").agg(F.count("*").alias("n"), F.count("e").alias("with_end"))


@query(
    f"""WITH b AS (SELECT row_id, s, e, {_BUCKET_SQL} AS bucket FROM {_SEEN_SQL}), r AS (
    SELECT row_id, bucket, row_number() OVER (PARTITION BY bucket ORDER BY CASE bucket WHEN 'new' THEN s WHEN 'ending_soon' THEN e ELSE coalesce(e, s) END ASC NULLS LAST, row_id) AS place FROM b)
    SELECT bucket, place, row_id FROM r WHERE place <= CASE bucket WHEN 'new' THEN 30 WHEN 'ending_soon' THEN 15 ELSE 25 END"""
)
def bucket_topk(spark: SparkSession, d: str) -> DataFrame:
    """The first plans of each bucket in its own order (a top-k report)."""
    late = lambda c: c.asc_nulls_last()
    orders = {"new": ([late(F.col("s")), F.col("row_id")], 30), "ending_soon": ([late(F.col("e")), F.col("row_id")], 15), "ongoing": ([late(F.coalesce("e", "s")), F.col("row_id")], 25)}
    return rank.top_per_bucket(_lifecycle(spark, d), "bucket", orders).select("bucket", "place", "row_id")


@query("SELECT concert_id, artist, date_obj FROM (SELECT *, row_number() OVER (PARTITION BY lower(artist), date_obj ORDER BY concert_id) AS k FROM concerts) WHERE k = 1")
def distinct_keep_first(spark: SparkSession, d: str) -> DataFrame:
    """The first row of each artist and day."""
    return dedup.keep_first(table(spark, d, "concerts"), [F.lower("artist"), F.col("date_obj")], [F.col("concert_id")]).select("concert_id", "artist", "date_obj")


_FULL_SQL = "length(coalesce(descripcion, '')) + CASE WHEN coalesce(precio, '') <> '' THEN 50 ELSE 0 END + CASE WHEN coalesce(fecha_inicio, '') <> '' THEN 100 ELSE 0 END + CASE WHEN coalesce(fecha_fin, '') <> '' THEN 100 ELSE 0 END + CASE WHEN coalesce(enlace, '') <> '' THEN 30 ELSE 0 END"


@query(f"SELECT id, row_id, fullness FROM (SELECT *, {_FULL_SQL} AS fullness, row_number() OVER (PARTITION BY id ORDER BY {_FULL_SQL} DESC, row_id) AS k FROM normalizer) WHERE k = 1")
def completeness_best(spark: SparkSession, d: str) -> DataFrame:
    """The fullest row of each id."""
    full = dedup.completeness(F.col("descripcion"), [(F.col("precio"), 50), (F.col("fecha_inicio"), 100), (F.col("fecha_fin"), 100), (F.col("enlace"), 30)])
    rows = table(spark, d, "normalizer").withColumn("fullness", full)
    return dedup.keep_first(rows, [F.col("id")], [-F.col("fullness"), F.col("row_id")]).select("id", "row_id", "fullness")


@query("SELECT row_id, substr(md5(lower(coalesce(titulo, '') || '|' || coalesce(enlace, ''))), 1, 16) AS new_id FROM normalizer")
def md5_ids(spark: SparkSession, d: str) -> DataFrame:
    """Stable ids from titles and pages."""
    return table(spark, d, "normalizer").select("row_id", T.stable_id(F.col("titulo"), F.col("enlace")).alias("new_id"))


_HIST_SQL = """WITH byid AS (SELECT n.row_id, min(h.row_id) AS hist FROM normalizer n JOIN plan_history h ON n.id = h.id AND h.id <> '' GROUP BY 1),
    byurl AS (SELECT n.row_id, min(h.row_id) AS hist FROM normalizer n JOIN plan_history h ON n.enlace = h.enlace AND h.enlace <> '' WHERE n.row_id NOT IN (SELECT row_id FROM byid) GROUP BY 1),
    m AS (SELECT row_id, hist, 1 AS tier FROM byid UNION ALL SELECT row_id, hist, 2 FROM byurl)"""


def _history_matches(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows, past = table(spark, d, "normalizer"), table(spark, d, "plan_history").withColumn("hist_ord", F.col("row_id"))
    return rows, past, history.match_history(rows, past, "row_id", "id", "enlace")


@query(_HIST_SQL + " SELECT row_id, hist AS hist_ord, tier FROM m")
def history_tiers(spark: SparkSession, d: str) -> DataFrame:
    """The history row that each plan matches by id, else by page."""
    return _history_matches(spark, d)[2].select("row_id", "hist_ord", "tier")


@query(
    _HIST_SQL
    + """ SELECT n.row_id, CASE WHEN m.hist IS NULL THEN 'new' ELSE 'ongoing' END AS status, coalesce(nullif(h._first_seen, ''), nullif(h._extracted_at, ''), n._extracted_at) AS first_seen,
    coalesce(nullif(n.fecha_fin, ''), h.fecha_fin) AS fecha_fin FROM normalizer n LEFT JOIN m USING (row_id) LEFT JOIN plan_history h ON h.row_id = m.hist"""
)
def new_vs_ongoing(spark: SparkSession, d: str) -> DataFrame:
    """New or ongoing, when first seen, and end dates filled from history."""
    rows, past, matches = _history_matches(spark, d)
    out = history.with_status(rows, past.select("hist_ord", "_first_seen", "_extracted_at", "fecha_fin"), matches, "row_id", fill=["fecha_fin"])
    return out.select("row_id", "status", "first_seen", "fecha_fin")


@query(
    """WITH u AS (SELECT id, row_id, _extracted_at::TIMESTAMPTZ AS t, 0 AS fresh FROM plan_history UNION ALL SELECT id, row_id, _extracted_at::TIMESTAMPTZ, 1 FROM normalizer),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY fresh DESC, t DESC NULLS LAST, row_id) AS n FROM u WHERE coalesce(id, '') <> '')
    SELECT id FROM k WHERE n = 1 AND (t IS NULL OR t >= TIMESTAMPTZ '2026-06-30 00:00:00+00' - INTERVAL 180 DAY)"""
)
def history_upsert(spark: SparkSession, d: str) -> DataFrame:
    """History with the batch merged in and rows unseen for 180 days dropped: the ids left."""
    cols = ["id", "row_id", "titulo", "enlace", "_extracted_at"]
    merged = history.upsert(table(spark, d, "plan_history").select(*cols), table(spark, d, "normalizer").select(*cols), "id", parse_instant_text(F.col("_extracted_at")), F.expr("TIMESTAMP '2026-06-30 00:00:00Z'"))
    return merged.select("id")


@query("SELECT event_id, user_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS heading, sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS section FROM events")
def carry_forward(spark: SparkSession, d: str) -> DataFrame:
    """The last heading carried forward, and the number of headings so far."""
    rows = table(spark, d, "events").select("event_id", "user_id", "event_type")
    is_heading = F.col("event_type") == "purchase"
    carried = rank.carry_forward(rows, "user_id", "event_id", is_heading, F.col("event_id"), "heading")
    return rank.sections(carried, "user_id", "event_id", is_heading).select("event_id", "user_id", "heading", "section")


@query("SELECT event_id, floor((row_number() OVER (ORDER BY ts, event_id) - 1) / 6)::BIGINT AS batch, ((row_number() OVER (ORDER BY ts, event_id) - 1) % 6 + 1)::INT AS slot FROM events")
def batch_numbers(spark: SparkSession, d: str) -> DataFrame:
    """Rows in order, in batches of six."""
    return rank.batches(table(spark, d, "events").select("event_id", "ts"), [F.col("ts"), F.col("event_id")], 6).select("event_id", "batch", "slot")


@query(
    """WITH b AS (SELECT event_id, floor((row_number() OVER (ORDER BY event_id) - 1) / 6)::BIGINT AS batch, ((row_number() OVER (ORDER BY event_id) - 1) % 6 + 1)::INT AS slot FROM events),
    a AS (SELECT batch, 7 - slot AS idx, event_id AS answer FROM b WHERE batch % 5 <> 0), full_ AS (SELECT batch FROM b GROUP BY batch HAVING count(*) = 6)
    SELECT b.event_id, a.answer FROM b LEFT JOIN (SELECT * FROM a WHERE batch IN (SELECT batch FROM full_)) a ON a.batch = b.batch AND a.idx = b.slot
    WHERE b.batch IN (SELECT batch FROM full_)"""
)
def batch_align(spark: SparkSession, d: str) -> DataFrame:
    """Answers given in reverse order and joined back by their index; every fifth batch has none."""
    asked = rank.batches(table(spark, d, "events").select("event_id"), [F.col("event_id")], 6)
    whole = asked.groupBy("batch").agg(F.count("*").alias("n")).where("n = 6").select("batch")
    asked = asked.join(whole, "batch")
    answers = asked.where("batch % 5 <> 0").select("batch", F.expr("7 - slot").alias("index"), F.expr("7 - slot").alias("position"), F.col("event_id").alias("answer"))
    return enrich.align_batches(asked, answers).select("event_id", "answer")


@query("SELECT n.n_name, coalesce(r.r_name, 'OTHER') AS region FROM nation n LEFT JOIN (SELECT * FROM region WHERE r_regionkey <> 2) r ON n.n_regionkey = r.r_regionkey")
def dimension_default(spark: SparkSession, d: str) -> DataFrame:
    """A look-up with a default for what the dimension lacks."""
    regions = table(spark, d, "region").where("r_regionkey <> 2")
    return table(spark, d, "nation").join(regions, F.col("n_regionkey") == F.col("r_regionkey"), "left").select("n_name", F.coalesce("r_name", F.lit("OTHER")).alias("region"))


@query(
    """SELECT a.o_orderkey AS later, b.o_orderkey AS earlier FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderkey > b.o_orderkey
    AND abs(date_diff('day', b.o_orderdate::DATE, a.o_orderdate::DATE)) <= 3"""
)
def band_join(spark: SparkSession, d: str) -> DataFrame:
    """Orders of one customer at most three days apart, by an equi-join on day buckets."""
    rows = table(spark, d, "orders").select("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("day")).withColumn("b", F.floor(F.datediff("day", F.lit("1970-01-01").cast("date")) / 4))
    other = rows.toDF("earlier", "o_custkey", "other_day", "ob").withColumn("b", F.explode(F.array(F.col("ob") - 1, F.col("ob"), F.col("ob") + 1)))
    near = rows.join(other, ["o_custkey", "b"]).where((F.col("o_orderkey") > F.col("earlier")) & (F.abs(F.datediff("day", "other_day")) <= 3))
    return near.select(F.col("o_orderkey").alias("later"), "earlier")


@query("SELECT c_name AS name, c_acctbal AS balance, c_mktsegment AS segment, 'customer' AS source FROM customer UNION ALL SELECT s_name, s_acctbal, NULL, 'supplier' FROM supplier")
def union_sources(spark: SparkSession, d: str) -> DataFrame:
    """Two sources with different columns as one."""
    a = table(spark, d, "customer").select(F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_mktsegment").alias("segment"), F.lit("customer").alias("source"))
    b = table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.lit("supplier").alias("source"))
    return concert_plans.union_sources([a, b]).select("name", "balance", "segment", "source")


@query("SELECT source, count(*) AS n, count(DISTINCT lang) AS langs, sum(CASE WHEN kind = 'news' THEN 1 ELSE 0 END)::BIGINT AS news FROM documents GROUP BY source")
def source_histogram(spark: SparkSession, d: str) -> DataFrame:
    """Documents, languages and news of each source."""
    return table(spark, d, "documents").groupBy("source").agg(F.count("*").alias("n"), F.countDistinct("lang").alias("langs"), F.sum(F.when(F.col("kind") == "news", 1).otherwise(0)).alias("news"))


@query("SELECT event_id, (props->>'$.k')::INT AS k FROM events")
def json_props(spark: SparkSession, d: str) -> DataFrame:
    """A field out of JSON text."""
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").cast("int").alias("k"))


@query("SELECT row_id, regexp_extract(precio, '(\\d+[,.]?\\d*)\\s*€') AS amount FROM normalizer WHERE precio IS NOT NULL")
def price_extract(spark: SparkSession, d: str) -> DataFrame:
    """The first amount in euros as written."""
    return table(spark, d, "normalizer").where("precio is not null").select("row_id", T.first_amount(F.col("precio")).alias("amount"))


@query("SELECT concert_id, CASE WHEN contains(lower(coalesce(genre, '')), 'melodic') OR contains(lower(coalesce(genre, '')), 'death') THEN 2 WHEN contains(lower(coalesce(genre, '')), 'metal') OR contains(lower(coalesce(genre, '')), 'hard') THEN 1 ELSE 0 END AS tier FROM concerts")
def genre_tier(spark: SparkSession, d: str) -> DataFrame:
    """Tiers by ordered keywords."""
    return table(spark, d, "concerts").select("concert_id", T.tiered(F.coalesce("genre", F.lit("")), TIERS).alias("tier"))


_LOW = ", ".join(f"'{w}'" for w in T.LOW_WORDS)
_HIGH = ", ".join(f"'{w}'" for w in T.HIGH_WORDS)


@query(
    f"""SELECT concert_id, array_to_string(list_transform(string_split({_SQUEEZE.format('lower(artist)')}, ' '), lambda w, i: CASE WHEN upper(w) IN ({_HIGH}) THEN upper(w)
    WHEN w IN ({_LOW}) AND i > 1 THEN w ELSE upper(substr(w, 1, 1)) || lower(substr(w, 2)) END), ' ') AS titled FROM concerts WHERE artist IS NOT NULL"""
)
def title_case(spark: SparkSession, d: str) -> DataFrame:
    """Names in title case."""
    return table(spark, d, "concerts").where("artist is not null").select("concert_id", T.title_case(F.lower("artist")).alias("titled"))


_CITY = "|".join(CITIES)


@query(f"SELECT concert_id FROM concerts WHERE NOT regexp_matches(lower(coalesce(venue, '')), '(^|[^\\p{{L}}\\p{{N}}_])({_CITY})([^\\p{{L}}\\p{{N}}_]|$)') AND NOT (regexp_matches(lower(coalesce(_artist_raw, '')), '(^|[^\\p{{L}}\\p{{N}}_])({_CITY})([^\\p{{L}}\\p{{N}}_]|$)') AND NOT regexp_matches(lower(coalesce(_artist_raw, '')), '(^|[^\\p{{L}}\\p{{N}}_])madrid([^\\p{{L}}\\p{{N}}_]|$)'))")
def anti_cities(spark: SparkSession, d: str) -> DataFrame:
    """Concerts that name no other city."""
    return table(spark, d, "concerts").where(filters.not_in_cities(F.col("venue"), F.col("_artist_raw"), CITIES, "madrid")).select("concert_id")


@query("SELECT article_id, regexp_extract(lower(url), '^(?:[a-z][a-z0-9+.-]*:)?//(?:www\\.)?([^/?#:]+)', 1) AS host FROM news_articles WHERE url IS NOT NULL")
def url_host(spark: SparkSession, d: str) -> DataFrame:
    """Hosts of addresses."""
    return table(spark, d, "news_articles").where("url is not null").select("article_id", T.host_of(F.col("url")).alias("host"))


@query(
    """SELECT n.row_id, CASE WHEN coalesce(n.precio, '') IN ('', 'Consultar') THEN coalesce(nullif(h.precio, ''), n.precio) ELSE n.precio END AS precio,
    CASE WHEN coalesce(n.fecha_inicio, '') = '' THEN coalesce(nullif(h.fecha_inicio, ''), n.fecha_inicio) ELSE n.fecha_inicio END AS fecha_inicio FROM normalizer n LEFT JOIN plan_history h ON n.id = h.id"""
)
def fill_missing(spark: SparkSession, d: str) -> DataFrame:
    """Missing prices and dates taken from history by id."""
    rows, past = table(spark, d, "normalizer"), table(spark, d, "plan_history")
    return enrich.fill_missing(rows, past, "id", ["precio", "fecha_inicio"], {"precio": ["Consultar"]}).select("row_id", "precio", "fecha_inicio")


@query(
    """WITH a AS (SELECT DISTINCT artist FROM concerts WHERE artist IS NOT NULL), own AS (SELECT artist, min(genre) AS g FROM concerts WHERE coalesce(genre, '') NOT IN ('', 'Rock') GROUP BY artist)
    SELECT c.concert_id, coalesce(own.g, 'Rock') AS found, CASE WHEN own.g IS NULL THEN 'default' ELSE 'own' END AS found_from FROM concerts c LEFT JOIN own USING (artist)"""
)
def genre_cascade(spark: SparkSession, d: str) -> DataFrame:
    """A genre for every concert from providers in order, asked once an artist, with where it came from."""
    concerts = table(spark, d, "concerts").select("concert_id", "artist", "genre")
    known = concerts.where("coalesce(genre, '') not in ('', 'Rock') and artist is not null").groupBy("artist").agg(F.min("genre").alias("genre"))
    own = lambda keys: keys.join(known, "artist", "left")
    return enrich.cascade(concerts.select("concert_id", "artist"), "artist", [("own", own)], "found", F.lit("Rock")).select("concert_id", "found", "found_from")


@query(
    f"""SELECT o_orderkey, CASE WHEN e > s THEN least(100, greatest(0, floor(date_diff('day', s, {TODAY}) / date_diff('day', s, e) * 100 + 0.5)))::INT END AS pct
    FROM (SELECT o_orderkey, o_orderdate::DATE AS s, (o_orderdate + INTERVAL 12000 DAY)::DATE AS e FROM orders)"""
)
def progress_pct(spark: SparkSession, d: str) -> DataFrame:
    """How much of a run is over, halves rounded up."""
    start = F.to_date("o_orderdate")
    return table(spark, d, "orders").select("o_orderkey", D.progress(start, F.date_add(start, 12000), F.expr(TODAY)).alias("pct"))


@query("SELECT DISTINCT categoria AS category FROM normalizer WHERE coalesce(categoria, '') <> ''")
def facets(spark: SparkSession, d: str) -> DataFrame:
    """The values of a facet."""
    return table(spark, d, "normalizer").where("coalesce(categoria, '') <> ''").select(F.col("categoria").alias("category")).distinct()


@query("SELECT source, article_id, title FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY pub_date DESC NULLS LAST, article_id) AS k FROM news_articles) WHERE k <= 20")
def limit_per_source(spark: SparkSession, d: str) -> DataFrame:
    """The twenty newest articles of each source (a capped report)."""
    return rank.limit_per_source(table(spark, d, "news_articles"), "source", [F.col("pub_date").desc_nulls_last(), F.col("article_id")], 20).select("source", "article_id", "title")


# Fuzzy and pipeline queries: no SQL states them; tests hold them against plain sequential code.


@query()
def fuzzy_dedup_news(spark: SparkSession, d: str) -> DataFrame:
    """Articles without like titles, in order."""
    return dedup.dedup_by_title(table(spark, d, "news_articles").select(F.col("article_id").alias("ord"), "title"), "ord", "title")


@query()
def fuzzy_dedup_concerts(spark: SparkSession, d: str) -> DataFrame:
    """Concerts of the coming 56 days, one row each."""
    rows = concert_plans.make(table(spark, d, "concerts").withColumnRenamed("concert_id", "ord"))
    kept = concert_plans.select_concerts(rows, F.expr(TODAY), CITIES, "madrid")
    return concert_plans.finish(kept, TIERS).select("ord", "artist", "date_obj", "venue", "taste_score")


@query()
def news_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """The news of the last days as one JSON envelope."""
    articles = table(spark, d, "news_articles").withColumn("pub_date", F.col("pub_date").cast("timestamp")).withColumnRenamed("article_id", "ord")
    return news_plans.export_news(news_plans.select_news(articles, F.expr(NOW), NOISE), F.expr(NOW))


# Titles that name no plan, folded.
PLAN_JUNK = (
    "cartel fechas fecha descripcion precios precio horario horarios programa programacion contenido resumen indice contacto ubicacion direccion telefono entradas mapa plano newsletter patrocinadores".split()
    + ["time out market", "online privacy notice", "privacy notice", "cookie policy", "terms of service"]
)
PLAN_JUNK_PATTERNS = [
    r"^cartel(\s+\d{4})?$", r"^fechas?(\s+\d{4})?$", r"^\d{4}$", r"^(precios?|horarios?|descripcion|programacion|programa|contenido|resumen|indice|contacto|ubicacion|direccion|telefono)$",
    r"privacy notice|cookie policy|cookies|terms of|aviso legal|politica de privacidad", r"^discover\b", r"coolest cities", r"time out market", r"^(los|las)\s+mejores\b", r"^las?\s+exposiciones\b",
    r"^los?\s+mercadillos\b", r"\bque\s+puedes\s+ver\b", r"^planes?\s+para\b", r"^que\s+(ver|hacer|visitar)\b", r"^\d+\s+(planes|cosas|lugares|sitios|razones|motivos)\b", r"^todo\s+(lo\s+que|sobre)\b",
    r"^arte\s+en\s+madrid$", r"^guia\s+(de|del|para)\b",
]


def _plans_known(spark: SparkSession, d: str) -> DataFrame:
    """Plans normalised and filtered, one row each in every run (arrival batch), with their status against history."""
    raw = table(spark, d, "normalizer").withColumnRenamed("row_id", "ord")
    proper = plan_plans.normalise(raw, F.expr(TODAY)).where(filters.proper_title(F.col("titulo"), PLAN_JUNK, PLAN_JUNK_PATTERNS))
    chosen = plan_plans.select_plans(proper, F.expr(NOW), TOPICS, REFUSED)
    return plan_plans.deduplicate(chosen, _plans_past(spark, d), run=F.col("batch_no"))


def _plans_past(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "plan_history").select(F.col("row_id").alias("hist_ord"), "id", "enlace", "titulo", "_first_seen", "_extracted_at", "fecha_inicio", "fecha_fin")


@query()
def fuzzy_dedup_plans(spark: SparkSession, d: str) -> DataFrame:
    """The fullest row of each plan that is kept, in the place of its first row, with its status."""
    return _plans_known(spark, d).select("ord", "id", "titulo", "status", "first_seen")


@query()
def history_fuzzy_match(spark: SparkSession, d: str) -> DataFrame:
    """The first history row that a row matches by id, page or like title, and which of them it was."""
    raw = table(spark, d, "normalizer").withColumnRenamed("row_id", "ord")
    return history.match_history(plan_plans.normalise(raw, F.expr(TODAY)), _plans_past(spark, d), "ord", "id", "enlace", "titulo")


@query()
def plans_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """Plans normalised, filtered, deduplicated by id and like title against history, bucketed and exported."""
    return plan_plans.export_plans(plan_plans.bucketed(_plans_known(spark, d), F.expr(NOW)), F.expr(NOW), F.col("ord"))


# Scalars on the listing tables.

_NOTICES = ["sold out", "proyecto", "gran"]
_ACT_SQL = " OR ".join(f"contains(lower(regexp_replace(artist, '[¡!¿?\\s]', '', 'g')), '{n.replace(' ', '')}')" for n in _NOTICES)


@query(f"SELECT concert_id FROM concerts WHERE NOT ({_ACT_SQL}) AND NOT regexp_matches(trim(artist), '^[¡¿]')")
def act_names(spark: SparkSession, d: str) -> DataFrame:
    """Concerts whose artist holds no notice in place of a name."""
    return table(spark, d, "concerts").where(F.col("artist").isNotNull() & filters.names_an_act(F.col("artist"), _NOTICES)).select("concert_id")


@query("SELECT article_id, CASE WHEN length(title) > 130 THEN title WHEN length(coalesce(description, '')) > 300 THEN coalesce(description, '') END AS body FROM news_articles WHERE title IS NOT NULL")
def content_gate(spark: SparkSession, d: str) -> DataFrame:
    """Long content, else a long description, else nothing."""
    rows = table(spark, d, "news_articles").where("title is not null")
    return rows.select("article_id", filters.enough_text(F.col("title"), F.coalesce("description", F.lit("")), 130, 300).alias("body"))


_SIGNS_OF = ["cookies", "aviso legal", "privacidad", "derechos"]


@query("SELECT row_id FROM normalizer WHERE " + " + ".join(f"contains(lower(coalesce(descripcion, '')), '{w}')::INT" for w in _SIGNS_OF) + " >= 2")
def indicator_counts(spark: SparkSession, d: str) -> DataFrame:
    """Rows with at least two of several indicators."""
    return table(spark, d, "normalizer").where(filters.indicators(F.coalesce("descripcion", F.lit("")), _SIGNS_OF, 2)).select("row_id")


@query(
    """WITH s AS (SELECT row_id, list_filter(list_transform(regexp_split_to_array(coalesce(descripcion, ''), '[.·•\\n]+'), lambda x: trim(x, ' ')), lambda x: length(x) > 20) AS l FROM normalizer)
    SELECT row_id, CASE WHEN len(l) > 0 THEN array_to_string(l[1:3], '|') ELSE '' END AS bullets FROM s"""
)
def bullet_points(spark: SparkSession, d: str) -> DataFrame:
    """The first three longer sentences of every description."""
    none = F.lit(None).cast("array<string>")
    return table(spark, d, "normalizer").select("row_id", F.array_join(T.bullets(none, F.col("descripcion"), F.lit("")), "|").alias("bullets"))


@query(f"SELECT concert_id, {T.headliner_sql('artist', CITIES)} AS name FROM concerts WHERE artist IS NOT NULL")
def headliners(spark: SparkSession, d: str) -> DataFrame:
    """The first act of every bill in normal form."""
    return table(spark, d, "concerts").where("artist is not null").select("concert_id", T.headliner(F.col("artist"), CITIES).alias("name"))


@query("SELECT concert_id, trim(regexp_replace(trim(regexp_replace(venue, '\\s+\\d{1,2}[/\\-]\\d{1,2}[/\\-]\\d{4}\\s*$', ''), ' '), '\\s+\\d{4}-\\d{2}-\\d{2}\\s*$', ''), ' ') AS venue FROM concerts WHERE venue IS NOT NULL")
def venue_without_date(spark: SparkSession, d: str) -> DataFrame:
    """Venues without a date at their end."""
    return table(spark, d, "concerts").where("venue is not null").select("concert_id", T.strip_closing_date(F.col("venue")).alias("venue"))


@query(
    """SELECT categoria AS category, count(*) AS n, count(DISTINCT enlace) AS pages, sum(CASE WHEN coalesce(precio, '') = '' THEN 1 ELSE 0 END)::BIGINT AS unpriced, max(length(titulo)) AS longest
    FROM normalizer GROUP BY categoria"""
)
def category_counts(spark: SparkSession, d: str) -> DataFrame:
    """Counts of each category."""
    return table(spark, d, "normalizer").groupBy(F.col("categoria").alias("category")).agg(F.count("*").alias("n"), F.countDistinct("enlace").alias("pages"), F.sum(F.when(F.coalesce("precio", F.lit("")) == "", 1).otherwise(0)).alias("unpriced"), F.max(F.length("titulo")).alias("longest"))


# Prices, categories, notes, places and the viewer's dates.


def _sql_any(c: str, words: list[str]) -> str:
    return "(" + " OR ".join(f"contains({c}, '{w}')" for w in words) + ")"


@query(
    f"""SELECT row_id, CASE WHEN {_sql_any("lower(coalesce(precio, ''))", L.FREE_TEXTS)} THEN 'Gratis' WHEN regexp_matches(coalesce(precio, ''), '{L.AMOUNT_SIGN}') THEN regexp_extract(precio, '{L.AMOUNT_SIGN}')
    WHEN {_sql_any("lower(coalesce(precio, ''))", L.PRICED_WORDS)} THEN 'Consultar' ELSE '' END AS label, CASE WHEN {_sql_any("lower(coalesce(precio, ''))", L.FREE_PRICES)} THEN 'Gratis' ELSE precio END AS canon FROM normalizer"""
)
def price_labels(spark: SparkSession, d: str) -> DataFrame:
    """What every price says: free, an amount, to be asked for; and its one form."""
    return table(spark, d, "normalizer").select("row_id", L.price_label(F.col("precio")).alias("label"), L.price_canon(F.col("precio")).alias("canon"))


# The ordered keyword cascades of categories, by title and then by context.
BY_TITLE = [
    ("Exposición", ["exposición", "expo", "muestra", "retrospectiva", "instalación artística"]), ("Museo", ["museo", "sala "]), ("Teatro", ["teatro", "obra de teatro", "función", "representación", "dramaturgia"]),
    ("Teatro", ["comedia", "monólogo", "humor", "stand-up", "stand up"]), ("Concierto", ["concierto", "actuación musical", "recital"]), ("Festival", ["festival", "feria", "congreso"]),
    ("Taller", ["taller", "workshop", "curso", "masterclass"]), ("Cine", ["cine", "película", "film", "proyección", "ciclo de cine"]), ("Mercado", ["mercado", "mercadillo", "rastro"]),
    ("Ruta", ["ruta", "paseo ", "tour "]), ("Gastronomía", ["gastronomía", "gastronómico", "food", "chef"]),
]
BY_CONTEXT = [("Experiencia", ["inmersiv", "experiencia interactiva", "escape room"]), ("Teatro", ["teatro", "obra", "escena", "actores"]), ("Exposición", ["exposición", "galería", "pintura", "escultura", "arte"])]
_TITLED_SQL = "CASE " + " ".join(
    [f"WHEN starts_with(lower(titulo), '{k.lower()}: ') THEN '{k}'" for k in T.CATEGORIES]
    + [f"WHEN {_sql_any('lower(titulo)', w)} THEN '{k}'" for k, w in BY_TITLE]
    + [f"WHEN {_sql_any(chr(108) + 'ower(coalesce(descripcion, ' + chr(39) * 2 + '))', w)} THEN '{k}'" for k, w in BY_CONTEXT]
) + " ELSE 'Evento' END"


@query(f"SELECT row_id, {_TITLED_SQL} AS category FROM normalizer WHERE titulo IS NOT NULL")
def titled_categories(spark: SparkSession, d: str) -> DataFrame:
    """The category of every plan by its title, else by its text."""
    rows = table(spark, d, "normalizer").where("titulo is not null")
    return rows.select("row_id", L.titled_category(F.col("titulo"), F.col("descripcion"), BY_TITLE, BY_CONTEXT).alias("category"))


_NO_PREFIX = "lower(coalesce(titulo, ''))"
for _k in T.CATEGORIES:
    _NO_PREFIX = f"replace({_NO_PREFIX}, '{_k.lower()}:', '')"


@query(f"SELECT row_id, trim({_NO_PREFIX}) AS title FROM normalizer")
def titles_without_categories(spark: SparkSession, d: str) -> DataFrame:
    """Titles as duplicates are compared: in small letters, with no category prefix anywhere."""
    return table(spark, d, "normalizer").select("row_id", L.without_categories(F.col("titulo")).alias("title"))


_NOTES = "coalesce(notes, '') || CASE concert_id % 5 WHEN 0 THEN ' Sold  out' WHEN 1 THEN ' ¡¡ Nueva fecha !!' WHEN 2 THEN ' POSPUESTO' ELSE '' END"


@query(
    f"""WITH n AS (SELECT concert_id, {_NOTES} AS t FROM concerts) SELECT concert_id, CASE WHEN {_sql_any("regexp_replace(lower(t), '[ ]+', ' ', 'g')", L.SOLD_OUT)} THEN 'ENTRADAS AGOTADAS'
    WHEN contains(t, '¡¡') THEN trim(regexp_extract(t, '¡¡(.+?)!!', 1)) WHEN contains(lower(t), 'pospuesto') THEN 'POSPUESTO' ELSE '' END AS note FROM n"""
)
def status_notes(spark: SparkSession, d: str) -> DataFrame:
    """What every concert's notes say of its state (the modulus adds a wording, all rows stay)."""
    return table(spark, d, "concerts").select("concert_id", L.status_note(F.expr(_NOTES)).alias("note"))


_LISTED = "concat(coalesce(artist, ''), CASE WHEN concert_id % 2 = 0 THEN concat(' (', coalesce(venue, '?'), ')') ELSE ', sala Clamores' END, CASE WHEN concert_id % 3 = 0 THEN ' 12,50 euros gastos incluidos' WHEN concert_id % 3 = 1 THEN ' 20 Euros' ELSE '' END)"


@query(
    f"""WITH l AS (SELECT concert_id, {_LISTED} AS t FROM concerts), p AS (SELECT concert_id, t, trim(regexp_extract(t, '[(]([^)]+)[)]', 1)) AS inside, trim(regexp_extract(t, '(?i)sala +([A-Za-záéíóúü ]+)', 1)) AS after_,
    regexp_extract(t, '(?i){L.AMOUNT_WORD}', 1) AS amount FROM l)
    SELECT concert_id, CASE WHEN inside <> '' THEN inside WHEN after_ <> '' THEN 'Sala ' || after_ ELSE '' END AS place, CASE WHEN amount = '' THEN 'Consultar' ELSE amount || '€' || CASE WHEN contains(lower(t), '{L.CHARGES}') THEN ' (gastos incl.)' ELSE '' END END AS price FROM p"""
)
def places_and_prices(spark: SparkSession, d: str) -> DataFrame:
    """The place and the price that a list item states (the moduli choose its form, all rows stay)."""
    rows = table(spark, d, "concerts").select("concert_id", F.expr(_LISTED).alias("t"))
    return rows.select("concert_id", L.place_named(F.col("t")).alias("place"), L.price_in_words(F.col("t")).alias("price"))


@query(r"SELECT concert_id, trim(regexp_split_to_array(regexp_replace(coalesce(lineup, ''), '(?i)^(gira\s+de|conciertos\s+de|concierto\s+de)\s+', ''), '(?i)\s*\+\s*|\bcon\b')[1]) AS act FROM concerts")
def main_acts(spark: SparkSession, d: str) -> DataFrame:
    """The first act of every heading."""
    return table(spark, d, "concerts").select("concert_id", L.main_act(F.col("lineup"), ["conciertos de", "concierto de", "gira de"]).alias("act"))


#: Test vocabulary: words in the names of Spanish sources.
SPANISH = ["diario", "gaceta", "madrid", "la "]


@query(f"SELECT article_id, CASE WHEN {_sql_any(chr(108) + 'ower(coalesce(source, ' + chr(39) * 2 + '))', SPANISH)} THEN 'es' ELSE 'en' END AS spoken FROM news_articles")
def source_language(spark: SparkSession, d: str) -> DataFrame:
    """The language that a source's name tells."""
    return table(spark, d, "news_articles").select("article_id", L.spoken_in(F.col("source"), SPANISH).alias("spoken"))


@query("SELECT row_id, substr(coalesce(titulo, ''), 1, 120) AS title, substr(coalesce(descripcion, ''), 1, 400) AS lead FROM normalizer")
def card_texts(spark: SparkSession, d: str) -> DataFrame:
    """What a card shows of every plan (the lengths are the card's format)."""
    return table(spark, d, "normalizer").select("row_id", L.shown(F.col("titulo"), 120).alias("title"), L.shown(F.col("descripcion"), 400).alias("lead"))


@query(f"SELECT o_orderkey, date_diff('day', {TODAY}, o_orderdate::DATE + 10000) AS days, date_diff('day', {TODAY}, o_orderdate::DATE + 10000) BETWEEN 0 AND 7 AS urgent, weekofyear(o_orderdate)::INT AS week FROM orders")
def days_left(spark: SparkSession, d: str) -> DataFrame:
    """Days to an end, whether that is urgent, and the ISO week."""
    end = F.date_add(F.to_date("o_orderdate"), 10000)
    return table(spark, d, "orders").select("o_orderkey", L.days_left(end, F.expr(TODAY)).cast("bigint").alias("days"), L.urgent(end, F.expr(TODAY)).alias("urgent"), F.weekofyear("o_orderdate").alias("week"))


_ISO, _FIG, _NAMED = r"(\d{4})-(\d{2})-(\d{2})", r"(\d{1,2})/(\d{1,2})/(\d{4})", r"(\d{1,2})\s+(\w+)\s+(\d{4})"
_MONTH_ES = "CASE {0} " + " ".join(f"WHEN '{n}' THEN {i}" for i, (a, b) in enumerate(zip(D.MONTHS, D.SHORT_MONTHS, strict=True), 1) for n in (a, b)) + " END"


def _sql_shown(c: str) -> str:
    part = lambda p, g: f"nullif(regexp_extract({c}, '{p}', {g}), '')::INT"
    return f"CASE WHEN regexp_matches({c}, '{_ISO}') THEN {_sql_day(part(_ISO, 1), part(_ISO, 2), part(_ISO, 3))} WHEN regexp_matches({c}, '{_FIG}') THEN {_sql_day(part(_FIG, 3), part(_FIG, 2), part(_FIG, 1))} WHEN regexp_matches({c}, '{_NAMED}') THEN {_sql_day(part(_NAMED, 3), _MONTH_ES.format(f'lower(regexp_extract({c}, {chr(39)}{_NAMED}{chr(39)}, 2))'), part(_NAMED, 1))} END"


@query(f"SELECT row_id, {_sql_shown('fecha_fin')} AS ends, coalesce({_sql_shown('fecha_fin')} < {TODAY}, false) AS ended FROM normalizer")
def shown_dates(spark: SparkSession, d: str) -> DataFrame:
    """The viewer's reading of every end date, and whether it is over; unreadable ones never are."""
    end = L.shown_date(F.col("fecha_fin"))
    return table(spark, d, "normalizer").select("row_id", end.alias("ends")).select("row_id", "ends", F.coalesce(F.col("ends") < F.expr(TODAY), F.lit(False)).alias("ended"))


#: Test vocabulary: words of titles that offer vouchers.
COUPONS = "coupon|promo code|discount|noche de"


@query(f"SELECT article_id FROM news_articles WHERE NOT regexp_matches(coalesce(title, ''), '(?i){COUPONS}')")
def without_coupons(spark: SparkSession, d: str) -> DataFrame:
    """Articles whose title offers no voucher."""
    return table(spark, d, "news_articles").where(~F.coalesce("title", F.lit("")).rlike(f"(?i){COUPONS}")).select("article_id")


@query("SELECT row_id, _relevance + CASE WHEN lower(coalesce(precio, '')) IN ('gratis', 'free') THEN 1 ELSE 0 END + CASE WHEN coalesce(_is_new, false) THEN 2 ELSE 0 END AS score, coalesce(_relevance + CASE WHEN lower(coalesce(precio, '')) IN ('gratis', 'free') THEN 1 ELSE 0 END + CASE WHEN coalesce(_is_new, false) THEN 2 ELSE 0 END >= 15, false) AS priority FROM plan_history")
def tie_breakers(spark: SparkSession, d: str) -> DataFrame:
    """Relevance with its small bonuses, and what has priority by it."""
    score = L.bonus(F.col("_relevance"), F.col("precio"), F.col("_is_new"))
    return table(spark, d, "plan_history").select("row_id", score.alias("score"), F.coalesce(score >= 15, F.lit(False)).alias("priority"))


@query("SELECT row_id, array_to_string(list_filter(list_transform(coalesce(points, []), lambda x: trim(x)), lambda x: length(x) > 0), '|') AS points FROM plan_history WHERE coalesce(why_go, '') <> '' OR len(list_filter(list_transform(coalesce(points, []), lambda x: trim(x)), lambda x: length(x) > 0)) > 0")
def summaries_that_say_something(spark: SparkSession, d: str) -> DataFrame:
    """Summaries' points trimmed, empty ones out; plans with neither points nor reason are dropped."""
    points = L.said(F.col("points"))
    return table(spark, d, "plan_history").where((F.coalesce("why_go", F.lit("")) != "") | (F.size(points) > 0)).select("row_id", F.array_join(points, "|").alias("points"))


_WRAPPED = "CASE event_id % 3 WHEN 0 THEN concat('[', event_id, ']') WHEN 1 THEN concat('{\"items\": [', event_id, ', 1], \"n\": 2}') ELSE '{\"n\": 2}' END"


@query("SELECT event_id, CASE event_id % 3 WHEN 0 THEN '[' || event_id || ']' WHEN 1 THEN '[' || event_id || ', 1]' END AS list FROM events")
def lists_in_answers(spark: SparkSession, d: str) -> DataFrame:
    """The list of an answer that is one, or that wraps one (the modulus chooses the form, all rows stay)."""
    return table(spark, d, "events").select("event_id", L.list_inside(F.expr(_WRAPPED)).alias("list"))


_BOX = "concat('{{Infobox\\n| name = x\\n| genre = ', coalesce(genre, ''), '\\n| label = y\\n}}')"


@query("SELECT concert_id, CASE WHEN coalesce(genre, '') = '' THEN '| label = y' ELSE genre END AS genre FROM concerts")
def infobox_genres(spark: SparkSession, d: str) -> DataFrame:
    """The genre out of an information box made of every concert; an empty field reads on to the next line."""
    return table(spark, d, "concerts").select("concert_id", L.infobox_value(F.expr(_BOX), "genre").alias("genre"))
