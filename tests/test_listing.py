"""Scalars and operators on literal rows, with values worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F

from tablado.functions import dates as D
from tablado.functions import html as H
from tablado.functions import text as T
from tablado.functions.similarity import indel_text, ratcliff_text
from tablado.operators import dedup, enrich, filters, history, rank
from tablado.operators.score import Topic, with_topics
from tablado.sinks import export
from tablado.sources import extract, feeds, pages


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first().r


@pytest.mark.parametrize(("text", "titled"), [("la oreja de van gogh", "LA Oreja de Van Gogh"), ("ac/dc", "Ac/dc"), ("AC/DC", "AC/DC"), (None, None)])
def test_title_case(spark, text, titled):
    assert one(spark, text, T.title_case) == titled


def test_text(spark):
    assert one(spark, "Noche en blanco", lambda c: T.strip_places(c, ["madrid"])) == "Noche"
    assert one(spark, "Godsmack, Nothing More y Thundermother", lambda c: T.headliner(c, ["madrid"])) == "godsmack"
    assert one(spark, "<b>A &amp;  B</b>&nbsp;c", T.clean_markup) == "A & B c"
    assert one(spark, "Sala X 12/05/2026", T.strip_closing_date) == "Sala X"
    assert one(spark, "desde 12,50 €", T.first_amount) == "12,50 €"
    assert one(spark, "Exposición: Goya", T.without_category) == "Goya"
    assert one(spark, "del 3 de mayo al 9 de mayo de 2026, Sábado, una obra", T.strip_leading_dates) == "una obra"
    assert one(spark, '```json\n{"a": 1}\n```', T.json_in) == '{"a": 1}'
    assert one(spark, "[[Heavy metal music|heavy metal]], [[Rock]]", T.clean_genre) == "Heavy metal"
    assert one(spark, "Uno dos tres cuatro cinco seis. ok • siete ocho nueve diez once", lambda c: T.bullets(F.lit(None).cast("array<string>"), c, F.lit(""))) == ["Uno dos tres cuatro cinco seis", "siete ocho nueve diez once"]
    assert one(spark, "../b?x=1", lambda c: T.absolute_url(c, F.lit("https://a.example/x/y"))) == "https://a.example/b?x=1"
    assert one(spark, "van der graaf", T.initials) == "VD"


@pytest.mark.parametrize(
    ("text", "day"),
    [("12 de enero", "2027-01-12"), ("12 de enero de 2026", "2026-01-12"), ("05/12/26", "2026-12-05"), ("31/02/2026", None), ("2026-11-31", "2031-11-26"), ("20 horas 2026, 5 de mayo de 2026", None), ("26 de noviembre", "2026-11-26"), (None, None), ("", None)],
)
def test_event_date(spark, text, day):
    got = one(spark, text, lambda c: D.event_date(c, F.lit(datetime.date(2026, 11, 26))))
    assert (str(got) if got else None) == day


def test_dates(spark):
    today = F.lit(datetime.date(2026, 11, 26))
    assert one(spark, "hasta 5 de mayo", lambda c: D.end_date_text(c, today)) == ""
    assert one(spark, "hasta el 5 de mayo", lambda c: D.end_date_text(c, today)) == "05/05/2026"
    r = one(spark, "del 3 de mayo al 9 de junio de 2027", lambda c: D.range_text(c, today))
    assert (r.start, r.end) == ("03/05/2026", "09/06/2027")
    assert one(spark, datetime.date(2026, 1, 5), D.card_date_es, "date") == "05/01/2026 · Lunes"


@pytest.mark.parametrize(
    ("start", "end", "kept"),
    [("", "26/11/2026", True), ("01/10/2026", "", True), ("30/09/2026", "", False), ("", "31/12/2030", True), ("", "", True), (None, None, True), ("01/03/2027", "", False), ("01/11/2026", "20/11/2026", False)],
)
def test_window(spark, start, end, kept):
    df = spark.createDataFrame([(start, end)], "s string, e string")
    now = F.lit("2026-11-26 10:00:00").cast("timestamp")
    assert df.where(filters.runs_within(F.col("s"), F.col("e"), now)).count() == int(kept)
    if end == "26/11/2026":
        assert df.where(filters.runs_within(F.col("s"), F.col("e"), now, strict_compat=True)).count() == 0


def test_keywords(spark):
    df = spark.createDataFrame([("Liga femenina en La", ""), ("golfista", None), ("UFC 300", ""), ("ufceta", ""), (None, None)], "t string, d string")
    kept = df.where(filters.without_keywords(F.col("t"), F.col("d"), ["golf", "ufc", "en la liga"])).collect()
    assert [r.t for r in kept] == ["ufceta", None]
    topics = [Topic("a", "A", 5, ("comic",)), Topic("b", "B", 5, ("robot",)), Topic("c", "C", 2, ("arte",))]
    row = spark.createDataFrame([("Comic y robot",)], "t string").transform(lambda x: with_topics(x, F.col("t"), F.lit(""), F.lit(""), topics)).first()
    assert (row.score, row.topic) == (10, "a")


def test_likeness():
    assert ratcliff_text("tide", "diet") == 0.25
    assert ratcliff_text("diet", "tide") == 0.5
    assert indel_text("abc", "abd") == pytest.approx(200 * 2 / 6)
    assert indel_text("", "") == 100


def test_greedy_is_not_components(spark):
    rows = [(1, "una noche de relojes en la plaza"), (2, "una noche de relojes en la playa alta"), (3, "otra noche de relojes en la playa alta norte"), (4, "nada que ver aquí con todo eso"), (5, None), (6, ""), (7, "una noche de relojes en la plaza")]
    df = spark.createDataFrame(rows, "ord long, title string")
    kept: list = []
    for o, t in rows:
        if not any(ratcliff_text((t or "").lower(), k) > 0.72 for _, k in kept):
            kept.append((o, (t or "").lower()))
    assert sorted(r.ord for r in dedup.dedup_by_title(df, "ord", "title").collect()) == [o for o, _ in kept]
    assert dedup.dedup_by_title(df.limit(0), "ord", "title").count() == 0


def test_fullest_and_band(spark):
    df = spark.createDataFrame([(1, "a", "Noche de cine en la plaza", "x"), (2, "b", "Noche de cine en la plaza!", "xxxx"), (3, "c", "Otra cosa distinta", "x"), (4, "a", "sin relación alguna", "x")], "ord long, id string, titulo string, d string")
    got = dedup.dedup_keep_fullest(df, "ord", "id", "titulo", F.length("d")).collect()
    assert sorted((r.ord, r.id) for r in got) == [(1, "b"), (3, "c")]
    day = datetime.date(2026, 5, 1)
    df = spark.createDataFrame([(1, "Nazca", day, False), (2, "Nazca", day + datetime.timedelta(3), True), (3, "Nazca", day + datetime.timedelta(7), False), (4, "Nazca", None, False)], "ord long, n string, d date, link boolean")
    got = dedup.dedup_in_band(df, "ord", "n", "d", F.array("link")).collect()
    assert sorted((r.ord, str(r.d)) for r in got) == [(1, "2026-05-04"), (3, "2026-05-08"), (4, "None")]


def test_history(spark):
    past = spark.createDataFrame([(0, "a", "u1", "Feria del libro antiguo", "2026-01-01T00:00:00Z", "01/02/2026"), (1, "b", "u2", "Otra cosa", "2025-01-01T00:00:00Z", "")], "hist_ord long, id string, enlace string, titulo string, _extracted_at string, fecha_fin string")
    now = spark.createDataFrame([(10, "a", "zz", "t", "2026-03-01T00:00:00Z", ""), (11, "q", "u2", "t", "2026-03-01T00:00:00Z", "05/05/2026"), (12, "r", "", "Feria del libro antiguo!", "2026-03-01T00:00:00Z", None), (13, "s", None, "Nueva", "2026-03-01T00:00:00Z", "")], "ord long, id string, enlace string, titulo string, _extracted_at string, fecha_fin string")
    m = history.match_history(now, past, "ord", "id", "enlace", "titulo")
    assert sorted(map(tuple, m.select("ord", "hist_ord", "tier").collect())) == [(10, 0, 1), (11, 1, 2), (12, 0, 3)]
    got = {r.ord: (r.status, r.first_seen, r.fecha_fin) for r in history.with_status(now, past, m, "ord", fill=["fecha_fin"]).collect()}
    assert got[10] == ("ongoing", "2026-01-01T00:00:00Z", "01/02/2026") and got[13][0] == "new"
    kept = history.upsert(past.drop("hist_ord"), now.drop("ord"), "id", F.col("_extracted_at").try_cast("timestamp"), F.lit("2026-03-02").cast("timestamp"))
    assert sorted(r.id for r in kept.collect()) == ["a", "q", "r", "s"]


PAGE = """<html><head><title>T</title><meta property="og:image" content="i.jpg"><script type="application/ld+json">{"startDate": "2026-05-01"}</script></head><body><nav><p>%s</p></nav>
<article><h2>BANDA UNO</h2><ul><li>12 mayo Madrid<li>13 mayo</ul><p>%s<p>corto</article><a href="/x#y">x</a><a href="/x">x</a><a href="https://o.example/z">z</a>
<table><tr><th>Fecha<th>Sala</tr><tr><td>1/1<td>Sol</tr></table></body></html>""" % ("n" * 90, "p" * 90)


def test_pages(spark):
    df = spark.createDataFrame([("https://a.example/l", PAGE), ("https://a.example/m", None)], "url string, html string")
    r = df.select(H.blocks(F.col("html")).alias("b")).select(H.page_title(F.col("b")).alias("t"), H.social_image(F.col("b")).alias("i"), H.article_text(F.col("b")).alias("a"), H.structured_dates(F.col("b")).alias("d")).first()
    assert (r.t, r.i, r.a, r.d.start) == ("T", "i.jpg", "p" * 90, "2026-05-01")
    b = extract.page_blocks(df, "url", "html")
    rows = extract.under_heading(b, extract.shouted(F.col("text")) & (F.col("tag") == "h2"), F.col("tag") == "li").collect()
    assert [(x.heading, x.text) for x in sorted(rows, key=lambda x: x.pos)] == [("BANDA UNO", "12 mayo Madrid"), ("BANDA UNO", "13 mayo")]
    assert extract.table_rows(b).first().cells == {"fecha": "1/1", "sala": "Sol"}
    listing = df.select(F.lit("s").alias("source"), F.lit(0).alias("ord"), F.col("url").alias("page_url"), "html", F.lit(None).cast("int").alias("max_links"))
    assert sorted(x.url for x in pages.crawl_links(listing).collect()) == ["https://a.example/x", "https://o.example/z"]


def test_feeds(spark, tmp_path):
    (tmp_path / "f.xml").write_text("<rss><channel><item><title>A</title><link>http://x</link><description>d</description><pubDate>x</pubDate><enclosure url='p.jpg' type='image/jpeg'/></item></channel></rss>")
    rows = feeds.read_feeds(spark, [(str(tmp_path / "f.xml"), "S", "es"), (str(tmp_path / "none.xml"), "N", "en")]).collect()
    assert [(r.title, r.url, r.rss_image, r.source) for r in rows] == [("A", "http://x", "p.jpg", "S")]
    (tmp_path / "c.yml").write_text("sources:\n  - name: A\n    url: u\n    selectors: {container: article}\n")
    assert feeds.read_catalog(spark, str(tmp_path / "c.yml")).first().max_links == 100
    assert feeds.read_json(spark, str(tmp_path / "no.json"), "a int").count() == 0


def test_pages_source(spark):
    spark.dataSource.register(pages.HttpPages)
    row = spark.read.format("pages").option("urls", "http://127.0.0.1:9/none").option("timeout", "1").load().first()
    assert row.html == "" and row.error
    assert pages.decode_page("año".encode(), "ISO-8859-1") == "año"


def test_ranks_and_enrichment(spark, tmp_path):
    df = spark.range(25).select(F.col("id").alias("k"), (F.col("id") % 3).alias("g"))
    got = rank.batches(df, [F.col("k").desc()], 6).orderBy("k").collect()
    assert (got[24].batch, got[24].slot, got[0].batch, got[0].slot) == (0, 1, 4, 1)
    asked = rank.batches(df.limit(6), [F.col("k")], 3)
    answers = spark.createDataFrame([(0, 3, 1, "c"), (0, 1, 2, "a"), (0, 2, 3, "b"), (1, 1, 1, "x")], "batch long, index int, position int, answer string")
    out = {r.k: r.answer for r in enrich.align_batches(asked, answers).collect()}
    assert [out[k] for k in sorted(out)] == ["a", "b", "c", None, None, None]
    names = spark.createDataFrame([("a",), ("b",), (None,)], "artist string")
    first = lambda keys: keys.where("artist = 'a'").withColumn("v", F.lit("Metal"))
    got = {r.artist: (r.genre, r.genre_from) for r in enrich.cascade(names, "artist", [("one", first)], "genre", F.lit("Rock")).collect()}
    assert got == {"a": ("Metal", "one"), "b": ("Rock", "default"), None: ("Rock", "default")}
    row = export.envelope(df, {"k": F.col("k")}, [-F.col("k")], {"by": F.lit("t")}, "rows", 2).first().json
    assert row == '{"by":"t","count":2,"rows":[{"k":24},{"k":23}]}'
    export.write_snapshot(df, str(tmp_path / "s"), F.lit("2026-01"))
    assert spark.read.parquet(str(tmp_path / "s")).count() == 25


def test_streams(spark, tmp_path):
    from tablado.streaming import history_stream as S

    src = tmp_path / "in"
    spark.createDataFrame([("a", "2026-01-01 00:00:00"), ("a", "2026-01-02 00:00:00"), ("b", "2026-01-01 00:00:00"), (None, "2026-01-01 00:00:00")], "id string, t string").write.parquet(str(src))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    stream = spark.readStream.schema("id string, t string").parquet(str(src))
    q = S.sightings(stream, "id", F.col("t")).writeStream.format("memory").queryName("seen").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {r.id: (r.times, r.is_new) for r in spark.table("seen").collect()} == {"a": (2, True), "b": (1, True)}
    q = S.upsert_stream(stream, str(tmp_path / "h"), "id", F.col("t").cast("timestamp"), F.lit("2026-02-01").cast("timestamp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    current = spark.read.text(str(tmp_path / "h" / "current")).first()[0]
    assert spark.read.parquet(str(tmp_path / "h" / current)).count() == 2


def test_cards(spark):
    page = "<body><article><h3>Uno</h3><time datetime='2026-05-01'>1 mayo</time><p>Sala A</p><a href='u'>e</a></article><article><h3>Dos</h3><p>12 de junio de 2026</p></article></body>"
    b = extract.page_blocks(spark.createDataFrame([("p", page)], "url string, html string"), "url", "html")
    rows = extract.cards(b, F.col("tag") == "article", F.col("tag") == "h3").withColumn("day", extract.first_day([F.col("time"), F.col("text")], F.lit(datetime.date(2026, 1, 1)))).orderBy("card").collect()
    assert [(r.title, r.time, str(r.day), [x.href for x in r.links]) for r in rows] == [("Uno", "2026-05-01", "2026-05-01", ["u"]), ("Dos", None, "2026-06-12", [])]
