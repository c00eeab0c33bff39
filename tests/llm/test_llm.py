"""The llm operators against round trips, brute force and held-out pages."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablado.llm import canonical, content, dedup_history, leakage, mixing, residue, survivors
from tablado.llm.encoding import damaged_fields, repair
from tablado.llm.plan_keys import Titles, page_key, same_title
from tablado.operators.graph import components


# 4. Encoding.


@pytest.mark.parametrize("codec", ["cp1252", "latin-1", "mac_roman", "cp850", "cp437", "cp1251"])
@pytest.mark.parametrize("text", ["Exposición de año", "«Señal» – café", "12 €", "Ruénuola ¡Última!", "🎭 Teatro en la calle"])
def test_round_trip(codec, text):
    try:
        damaged = text.encode("utf-8").decode(codec)
    except UnicodeDecodeError:
        damaged = "".join(bytes([b]).decode(codec, "replace").replace("�", chr(b)) for b in text.encode("utf-8"))
    assert repair(damaged) == (True, text, False)
    assert repair(text) == (False, text, False)
    mixed = f"Antes ñ {damaged} después"
    assert repair(mixed)[:2] == (True, f"Antes ñ {text} después")


def test_encoding_cases(spark):
    assert repair("Exposición".encode().decode("cp1252").encode().decode("cp1252")) == (True, "Exposición", False)
    assert repair("exposiciã³n")[1] == "exposición"
    assert repair("Jard�n") == (True, "Jard�n", True)
    for meant in ("SAUDAÇÃO", "Âmbar", "œuvre de Åse", "", None, "a»b", "© 2026"):
        assert not repair(meant)[0]
    df = spark.createDataFrame([(1, "Ã¡", None), (2, "", "bien"), (2, "", "bien"), (3, "x" * 100_000 + "Ã±", "Ã©")], "k long, a string, b string").selectExpr("*", "k as original", "a as lost")
    got = sorted((r.k, r.field_name, r.restored[-1]) for r in damaged_fields(df, "k", ["a", "b"]).collect())
    assert got == [(1, "a", "á"), (3, "a", "ñ"), (3, "b", "é")]
    assert damaged_fields(df.limit(0), "k", ["a", "b"]).count() == 0


# 6. Canonical list.

VENUES = [(1, "Sala Tavira"), (2, "Teatro Tavira"), (3, "Museo Golondrina 1"), (4, "Museo Golondrina 2"), (5, "Centro Cultural Oropendola")]
VALUES = [
    ("SALA TAVIRA", 1), ("Tavira, Sala", 1), ("Sala Tavria (Madrid)", 1), ("Tº Tavira", 2), ("Tavira", -1), ("museo golondrina 2, Calle de los Mapas, 3", 4), ("Museo Golondrina", -1), ("Museo Golondrina 3", -1),
    ("Club Tavira", -1), ("Oropendola", 5), ("C.C. Oropendola 12/05/2026", 5), ("TBA", -1), ("Sala Tavira", None), ("", None), (None, None),
]


@pytest.mark.parametrize("bound", [5000, 2])
def test_canonical(spark, monkeypatch, bound):
    monkeypatch.setattr(canonical, "MAX_BROADCAST_NAMES", bound)
    df = spark.createDataFrame([(i, v) for i, (v, _) in enumerate(VALUES)], "k long, v string").selectExpr("*", "v as value", "k as ref_id")
    cat = spark.createDataFrame(VENUES, "id long, name string")
    got = {r.k: r.ref_id for r in canonical.map_values(df.select("k", "v"), "k", "v", cat, "id", "name", kinds=True).collect()}
    assert got == {i: r for i, (_, r) in enumerate(VALUES) if r is not None}
    assert canonical.map_values(df.limit(0), "k", "v", cat, "id", "name").count() == 0
    assert {r.ref_id for r in canonical.map_values(df.select("k", "v"), "k", "v", cat.limit(0), "id", "name").collect()} == {-1}
    # Of two entries equally near, the one that the table spells more often.
    near = spark.createDataFrame([(1, "Sala Rona"), (2, "Sala Ronx"), (3, "Sala Ronx.")][:2] + [(9, "Otra")], "id long, name string")
    rows = spark.createDataFrame([(0, "Sala Ronz")] + [(i, "Sala Ronx") for i in range(1, 6)], "k long, v string")
    assert [(r.k, r.ref_id) for r in canonical.map_values(rows, "k", "v", near, "id", "name", kinds=True).collect()] == [(0, 2)]
    twins = spark.createDataFrame([(1, "Sala Rona"), (2, "SALA RONA"), (3, "Otra")], "id long, name string")
    assert [r.ref_id for r in canonical.map_values(rows.limit(1), "k", "v", twins, "id", "name", kinds=True).collect()] == [-1]


# 3. Main content.

WORDS = "el la montaje recorrido público sala obra entrada plaza luz noche ciudad memoria barrio taller voz juego mapa cine vidrio".split()


def _examples(rng, n):
    def name():
        return "".join(rng.choice(["ba", "lu", "tri", "mo", "ne", "ga", "vu", "so"]) for _ in range(4)).capitalize()

    def text():
        return " ".join((" ".join(rng.choice(WORDS) for _ in range(rng.randint(8, 18)))).capitalize() + "." for _ in range(rng.randint(2, 6)))

    return [(f"{rng.choice(['Noche de', 'Taller de', 'Ruta de'])} {rng.choice(WORDS)} con {name()} {name()}", text()) for _ in range(n)]


def test_held_out_pages():
    rng = random.Random(3)
    examples, sites = _examples(rng, 400), ["Villa Secreta", "Agenda Calamar"]
    model = content.train(examples[:300], sites)
    right = wrong = 0
    for title, text in examples[300:]:
        page = content.training_page(rng, title, text, [t for t, _ in examples[300:]], sites)
        found = set(model.furniture_lines("\n".join(x for x, _ in page), title))
        for i, (_, y) in enumerate(page, 1):
            right, wrong = right + ((i in found) == bool(y)), wrong + ((i in found) != bool(y))
    assert right / (right + wrong) > 0.96
    assert model.furniture_lines(None, "x") == model.furniture_lines("", None) == []
    assert model.title_is_dressed("Noche de cine con Balu Trimo | Villa Secreta")
    assert not model.title_is_dressed("Teatro: Noche de cine - Balu Trimo")
    assert model.clean_title("Inicio » Cine » Noche de cine con Balu Trimo") == "Noche de cine con Balu Trimo"


def test_sum_product_is_exact():
    """Marginals against enumeration of all states of a small tree."""
    import itertools
    import math

    model = content.train(_examples(random.Random(1), 50), ["Villa Secreta"])
    page, title = "Inicio\nBlog\nCine\nTe puede interesar\nNoche de luz con Balu Gaga\nLa obra es una noche en la ciudad.", "Taller de cine con Luba Mone"
    got = model.content(page, title)
    lines = [model.line(x) for x in page.split("\n")]
    z = model.odds(lines, {w for w in content._words(title) if len(w) > 3})
    blocks = content.blocks_of(lines, model.heads)
    total, marginal = 0.0, [0.0] * len(lines)
    for p in (0, 1):
        for bs in itertools.product((0, 1), repeat=len(blocks)):
            for ls in itertools.product((0, 1), repeat=len(lines)):
                w = model.page[p]
                for b, block in zip(bs, blocks, strict=True):
                    w *= model.block_given_page[p][b]
                    for i in block:
                        w *= model.line_given_block[b][ls[i]] / (1 + math.exp(z[i] if ls[i] == 0 else -z[i]))
                total += w
                for i, s in enumerate(ls):
                    marginal[i] += w * s
    assert got == pytest.approx([m / total for m in marginal], abs=1e-6)


# 2. Batches against history.


def test_page_key():
    base = page_key("https://www.a.example/planes/x-1")
    for u in ("http://a.example/planes/x-1/", "https://m.A.example/planes/x-1/amp?utm_source=b&fbclid=1#top", "HTTPS://WWW.A.EXAMPLE/planes/x-1?ref=portada"):
        assert page_key(u) == base
    assert page_key("https://a.example/e.php?id=1") != page_key("https://a.example/e.php?id=2")
    assert page_key(None) == page_key(" ") == ""


def _titles():
    model = content.train(_examples(random.Random(2), 60), ["Villa Secreta"])
    return Titles({"noche", "taller", "cine", "mareas", "llega", "directo", "plaza"}, {"llega", "plaza"}, {"cine", "teatro"}, canonical.Dictionary([(1, "Sala Tavira")], {}, (), True), model)


def test_same_title():
    t = _titles()
    same = lambda a, b: same_title(t.parse(a), t.parse(b))
    assert same("Noche de mareas - Vulebo Tricagu", "TEATRO: NOCHE DE MAREAS - VULEBO TRICAGU @ Sala Tavira")
    assert same("Noche de mareas - Vulebo Tricagu", "Noche de maraes - Vulebo Trcagu")
    assert same("Noche de mareas - Vulebo Tricagu", "Vulebo Tricagu llega a la plaza")
    assert same("Noche de mareas - Vulebo Tricagu, vol. 2", "Noche de mareas, volumen II: Vulebo Tricagu")
    assert not same("Noche de mareas - Vulebo Tricagu", "Noche de mareas - Vulebo Sanodre")
    assert not same("Noche de mareas - Vulebo Tricagu, vol. 2", "Noche de mareas - Vulebo Tricagu, vol. 3")
    assert not same("Noche de mareas - Vulebo Tricagu", "Noche de mareas - Vulebo Tricagu (II edición)")
    assert t.parse(None) is None and t.parse("  ") is None


def _plans(rng, n, first):
    rows = []
    for i in range(n):
        p = rng.randint(0, n // 4)
        who = f"{'bclmnprst'[p % 9]}{'aeiou'[p % 5]}dro{'bclm'[p % 4]}u Zalima{'bcdfghjk'[p % 8]}o{p}"
        title = f"Noche de cine - {who}"
        if rng.random() < 0.3:
            k = rng.randint(16, len(title) - 4)
            title = title[:k] + title[k + 1 :]
        rows.append((first + i, rng.choice([f"id{p}", f"x{i}", "", None]), rng.choice([f"https://a.example/p/{p}", "", None, "https://a.example/agenda"]), rng.choice([title, title, None])))
    return rows


def _brute(rows, parser):
    root = {r[0]: r[0] for r in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    keys = [(r[0], r[1] or None, (page_key(r[2]) if r[2] and "agenda" not in r[2] else None), parser.parse(r[3])) for r in rows]
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a[1] and a[1] == b[1]) or (a[2] and a[2] == b[2]) or (a[3] and b[3] and (a[3] == b[3] or same_title(a[3], b[3]))):
                x, y = find(a[0]), find(b[0])
                root[max(x, y)] = min(x, y)
    return {x: find(x) for x in root if find(x) != x}


def test_batches_and_backlog(spark):
    rng, parser = random.Random(5), _titles()
    schema = "row_id long, id string, page string, title string"
    old, new = _plans(rng, 40, 0), _plans(rng, 160, 1000)
    apart = lambda rows: dedup_history.take_apart(spark.createDataFrame(rows, schema), parser, {page_key("https://a.example/agenda")})
    want = _brute(old + new, parser)
    batches = [apart(new[i : i + 40]) for i in range(0, 160, 40)]
    got = {r.row_id: r.first_row_id for r in dedup_history.repeats_by_batches(spark, apart(old), batches).collect()}
    assert {k: v for k, v in got.items() if k >= 1000} == {k: v for k, v in want.items() if k >= 1000}
    store = dedup_history.new_store(spark, max_runs=2)
    assert store.members().count() == 0
    store.merge(apart(old))
    seen = set()
    for i, batch in enumerate(batches):
        # Every batch is merged by a store opened anew, as another process would.
        store = dedup_history.RunStore(spark, store.folder, max_runs=2)
        found = {r.row_id: r.first_row_id for r in store.merge(batch).collect()}
        so_far = _brute(old + new[: 40 * i + 40], parser)
        assert found == {r[0]: so_far[r[0]] for r in new[40 * i : 40 * i + 40] if r[0] in so_far}
        seen |= set(found)
    assert len(store.runs) <= 2 and seen <= set(want)
    assert {r.row_id: r.first_row_id for r in store.members().collect()} == want
    assert store.merge(batches[0].limit(0)).count() == 0


def test_store_reads_what_a_batch_touches(spark, monkeypatch):
    monkeypatch.setattr(dedup_history, "RANGE_RECORDS", 20)
    monkeypatch.setattr(dedup_history, "BUCKET_KEYS", 20)
    rng, parser = random.Random(9), _titles()
    apart = lambda rows: dedup_history.take_apart(spark.createDataFrame(rows, "row_id long, id string, page string, title string"), parser, set())
    store = dedup_history.new_store(spark, max_runs=1)
    store.merge(apart(_plans(rng, 60, 0)))
    ranges, buckets = len(store.points[0]), store.buckets
    store.merge(apart(_plans(rng, 200, 1000)))  # compacts, and cuts ranges and buckets for four times as many
    assert len(store.runs) == 1 and len(store.points[0]) > ranges and store.buckets > buckets
    store.merge(apart(_plans(rng, 1, 5000)))
    assert len(store.touched["titles"]) <= dedup_history.PASSES * 2 < dedup_history.PASSES * (len(store.points[0]) + 1)
    assert len(store.touched["keys"]) <= 3 and len(store.touched["blocks"]) < store.buckets


def _skewed(spark):
    """(sig, first, fresh) of one performer with many titles, and the pairs that ``same_title`` links."""
    rng, letters = random.Random(8), "abcdefghijklmnopqrstuvwxyz"
    word = lambda n: "".join(rng.choices(letters, k=n))
    shows = [f"{a} {b}" for a, b in (sorted((word(8), word(7))) for _ in range(60))]
    parser = Titles({w for c in shows for w in c.split()}, set(), set(), canonical.Dictionary([], {}, (), True), content.train([], []))
    sigs = [f"{c}||vulebo tricagu" for c in shows]
    sigs += ["~llega||vulebo tricagu", f"{shows[7]}||tricagu vulebo", f"{shows[9]}||xulebo tricagx"]
    readings = {}
    for c in shows[20:30]:
        a, b = c.split()
        for common, word, damaged in ((b, a, f"{a[:2]}zz{a[4:]}"), (a, b, f"{b[:1]}qq{b[3:]}")):
            sigs.append(f"{common}||tricagu vulebo {damaged}")
            readings[sigs[-1]] = parser.other_readings((common, "", ["tricagu", "vulebo", damaged]))
            assert (" ".join(sorted((common, word))), "", ["tricagu", "vulebo"]) in readings[sigs[-1]]
    other = {k: "\n".join("|".join((c, e, " ".join(n))) for c, e, n in v) for k, v in readings.items()}
    parts = [tuple(x.split("|")[:2]) + (x.split("|")[2].split(),) for x in sigs]
    want = {(i, j) for i in range(len(sigs)) for j in range(i) if same_title(parts[i], parts[j]) or same_title(parts[j], parts[i])}
    return spark.createDataFrame([(x, other.get(x, ""), i) for i, x in enumerate(sigs)], "sig string, other string, node long"), want


def _roots(pairs, n):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_titles_of_a_hot_performer(spark):
    sigs, want = _skewed(spark)
    # Without the rewording, which joins everything, every single link counts.
    none = spark.createDataFrame([], "a long, b long")
    for df, pairs in ((sigs, want), (sigs.where("sig not like '~%'"), {p for p in want if 60 not in p})):
        found = {(r.a, r.b) for r in dedup_history.block_pairs(dedup_history.blocked(df).withColumn("fresh", F.lit(True)), df.select("node", "sig"), none).collect()}
        assert found and _roots(found, 83) == _roots(pairs, 83)
    apart = sigs.select(F.col("node").alias("row_id"), F.lit(None).cast("long").alias("k_id"), F.lit(None).cast("long").alias("k_page"), "sig", "other", F.xxhash64("sig").alias("k_sig"))
    store = dedup_history.new_store(spark)
    store.merge(apart.where("row_id < 60"))
    got = {r.row_id: r.first_row_id for r in store.merge(apart.where("row_id >= 60")).collect()}
    assert got == {i: r for i, r in enumerate(_roots(want, 83)) if i >= 60 and r != i}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(45)] + [(100 + i, 101 + i) for i in range(30)] + [(500, i) for i in range(200, 260)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: find(x) for x in root if find(x) != x}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 5. Best representative.


def test_best_values(spark):
    rng = random.Random(4)
    rows = [(g, f, k, rng.randint(0, 3), rng.choice([0, 1, 2]), rng.randint(0, 3)) for k, (g, f) in enumerate((rng.randint(0, 12), rng.choice("ab")) for _ in range(120))]
    df = spark.createDataFrame(rows, "g long, f string, k long, a int, b int, c int")
    want = set()
    for g, f in {r[:2] for r in rows}:
        own = [r for r in rows if r[:2] == (g, f)]
        best = [r for r in own if all(r[i] >= x[i] for x in own for i in (3, 4, 5))]
        if best:
            want.add((g, f, min(r[2] for r in best)))
    rank = [F.col("a"), F.col("b"), F.col("c")]
    assert set(map(tuple, survivors.best_values(df, "g", "f", "k", rank).collect())) == want
    assert survivors.best_values(df, "g", "f", "k", rank, dominant=False).count() == len({r[:2] for r in rows})
    assert survivors.best_values(df.limit(0), "g", "f", "k", rank).count() == 0


def test_usable():
    assert [survivors.usable_text(t) for t in ("Sin descripción.", "-", "Próximamente.", "", "Una obra")] == [False, False, False, False, True]
    assert [survivors.states_price(p) for p in ("?", "Consultar", "Entrada libre", "gratis con invitaciÃ³n", "18 €", None, "N/D")] == [False, False, True, True, True, False, False]


# 8. Leakage.


@pytest.mark.parametrize("bound", [500_000, 3])
def test_leakage_finds_every_passage(spark, monkeypatch, bound):
    monkeypatch.setattr(leakage, "MAX_BROADCAST", bound)
    rng = random.Random(6)
    words = ["w" + "".join(rng.choice("abcdefgh") for _ in range(4)) for _ in range(400)]
    items = [(i, " ".join(rng.choice(words) for _ in range(60))) for i in range(8)] + [(98, ""), (99, None)]
    docs, want = [(0, None), (1, ""), (2, "corto")], set()
    for d in range(10, 90):
        i = rng.randint(0, 7)
        w = items[i][1].split()
        n = rng.choice([12, 19, 20, 25, 40])
        at = rng.randint(0, 60 - n)
        part = w[at : at + n]
        inside = rng.sample(range(1, n - 1), n // 10)
        for k in inside:
            part[k] = "otra"
        text = " ".join(f"fondo{rng.randint(0, 9999)}" for _ in range(30)) + "\n" + "<b>" + ", ".join(part).upper() + "</b> " + " ".join(f"fin{rng.randint(0, 9999)}" for _ in range(30))
        docs.append((d, text))
        if n >= 20:
            want.add((d, i))
    got = leakage.leaked_passages(spark.createDataFrame(docs + docs[-3:], "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text")
    assert {(r.doc, r.item) for r in got.collect()} == want
    assert leakage.leaked_passages(spark.createDataFrame([], "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, text string"), "item_id", "text").count() == 0


def test_longest_span_against_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(300):
        item = rng.integers(0, 1 << 40, 70).astype(np.uint64)
        doc = item.copy()
        doc[rng.random(70) < rng.choice([0.03, 0.1, 0.2])] = 1
        at = np.flatnonzero(doc == item)
        want = max((b - a + 1 for i, a in enumerate(at) for j, b in enumerate(at[i:], i) if (b - a + 1 - (j - i + 1)) * 10 <= b - a + 1), default=0)
        assert leakage.longest_span(doc, item, 0) == (want if want >= leakage.LEAST else 0)


def test_winnow_guarantee():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b = rng.integers(0, 50, 40).astype(np.uint64), rng.integers(50, 99, 40).astype(np.uint64)
        b[10:16] = a[20:26]
        x, y = leakage.grams(a), leakage.grams(b)
        assert set(x[leakage.winnow(x)]) & set(y[leakage.winnow(y)])


# 9. Mixing.


def test_mix_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(mixing, "count_tokens", lambda text, path: F.coalesce(F.size(F.split(F.nullif(text, F.lit("")), " ")), F.lit(0)).cast("bigint"))
    rng = random.Random(7)
    docs = [(i, rng.choice("aaaaab"), " ".join("x" for _ in range(rng.randint(1, 60)))) for i in range(1500)] + [(5000, "c", "x"), (5001, None, "x"), (5002, "a", None), (5003, "a", "")]
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 3), ("z", 0.0, 2)], "source string, target_share double, max_repeats int")
    df = spark.createDataFrame(docs, "doc_id long, source string, text string")
    used, shares = mixing.mix(df, "doc_id", "text", "source", targets)
    rows = used.collect()
    size = {i: len(t.split()) for i, _, t in docs if t}
    total = min(sum(size[i] for i, s, t in docs if s == "a" and t), 3 * sum(size[i] for i, s, _ in docs if s == "b")) / 0.5
    for s, most in (("a", 1), ("b", 3)):
        mine = [r for r in rows if r.source == s]
        assert abs(sum(r.n_tokens * r.repeats for r in mine) - total / 2) <= 60
        assert all(1 <= r.repeats <= most for r in mine)
    small = {r.doc_id: r.repeats for r in mixing.mix(df, "doc_id", "text", "source", targets, total=total / 3)[0].collect()}
    large = {r.doc_id: r.repeats for r in rows}
    assert all(large.get(k, 0) >= n for k, n in small.items())  # nested
    assert {r.source: round(r.reached_share, 2) for r in shares.collect()} == {"a": 0.5, "b": 0.5, "z": 0.0}
    assert mixing.mix(df.limit(0), "doc_id", "text", "source", targets)[0].count() == 0


def test_tokenizer(spark):
    pytest.importorskip("tiktoken")
    df = spark.createDataFrame([("Hola, mundo",), ("",), (None,)], "t string")
    assert [r[0] > 0 for r in df.select(mixing.count_tokens(F.col("t"))).collect()] == [True, False, False]


# 10. Residue.

CLEAN = ["La obra ocupa la sala y obliga a caminar despacio. El público se mueve entre mapas de papel.", "El museo cerró por mantenimiento el lunes y reabrió el martes con las salas recién pintadas.", "El taller enseña a escribir plantillas: quien ponga {{ titulo }} entre llaves verá aparecer el título de cada obra.", "La muestra «Error 404» reúne carteles de páginas perdidas.", "", None]
DIRTY = ["La obra ocupa {{sala}} y obliga a caminar despacio.", "Una obra sobre el papel.\n\nActiva JavaScript en tu navegador para ver la cartelera.", "503 Service Unavailable: backend fetch failed", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Aquí va el titular - borrador", "Fecha: undefined — Precio: NaN € — Sala: null", "COMPROBANDO QUE NO ERES UN ROBOT. UN MOMENTO…"]


def test_residue(spark):
    filler = ["La crítica local destacó las escenas y el público de la plaza pudo ver la agenda del barrio en la página de la sala."] * 40
    texts = CLEAN + DIRTY + filler
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(len(CLEAN), DIRTY[0])], "doc_id long, text string").selectExpr("*", "text as passage", "doc_id as k", "text as t")
    got = sorted(r.doc_id for r in residue.residue_documents(df, "doc_id", "text").collect())
    assert got == list(range(len(CLEAN), len(CLEAN) + len(DIRTY)))
    assert residue.residue_documents(df.limit(0), "doc_id", "text").count() == 0


def test_residue_in_a_third_of_the_documents(spark):
    """Copies of a notice make all its words frequent, but no less residue."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdeilmnorstu", k=7))
    plain = [" ".join(word() for _ in range(12)).capitalize() + "." for _ in range(300)]
    for notice in (DIRTY[1].splitlines()[-1], DIRTY[2], DIRTY[3], DIRTY[4]):
        texts = [f"{t} {notice}" if i % 3 == 0 else t for i, t in enumerate(plain)]
        df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
        assert sorted(r.doc_id for r in residue.residue_documents(df, "doc_id", "text").collect()) == list(range(0, 300, 3)), notice


def test_scorer_equals_features():
    """The quick score of a line is that of its features."""
    model = content.train([], ["La Revista"])
    scorer = content._Scorer(model.weights, model.vocabulary)
    for text in ["", "Compartir", "Inicio - Agenda - Planes", "• 12:30 Taller de cerámica", "Una tarde de música en la plaza. La entrada es libre.", "a  b  c", "x " * 40 + "…", "« Anterior"]:
        t = text.strip()
        words = content._words(t)
        assert abs(scorer.line(t, words) - content._score(content.line_features(t, words, model.vocabulary), model.weights)) < 1e-9
