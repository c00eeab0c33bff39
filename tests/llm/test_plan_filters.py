"""What is turned down by numbers before words are compared: nothing that is the same, and most of the rest."""

import random

from pyspark.sql import functions as F

from tablado.llm import dedup_history, plan_keys
from tablado.llm.canonical import Dictionary
from tablado.llm.content import train
from tablado.operators.timestamps import normalise_timestamps

WORDS = ["concierto", "exposicion", "taller", "teatro", "visita", "danza", "cine", "ciclo", "no", "gira"]
NAMES = ["arribas", "quintela", "oyarzun", "belmonte", "zubiri", "ledo", "campoamor", "teatrillo", "5", "añon"]


def _changed(rng, word, most):
    for _ in range(rng.randint(0, most)):
        i, c = rng.randint(0, len(word)), rng.choice("abcdeinorst5ñ�")
        word = rng.choice([word[:i] + c + word[i:], word[:i] + word[i + 1 :], word[:i] + c + word[i + 1 :], word[:i] + word[i + 1 : i + 2] + word[i : i + 1] + word[i + 2 :]]) or word
    return word


def test_words_near_common_ones_are_told_by_letters():
    rng = random.Random(3)
    tokens = {_changed(rng, rng.choice(WORDS + NAMES), 4) for _ in range(4_000)}
    whole = {t for t in tokens if "�" not in t}
    assert set(plan_keys._Near(set(WORDS)).apart(tokens)) == {t for t in whole if all(plan_keys.edits(w, t, 2) > 2 for w in WORDS)}
    assert plan_keys._Near({*WORDS, "m�sica"}).apart(tokens) == [] and len(plan_keys._Near(set()).apart(tokens)) == len(whole)


def test_titles_together_as_one_by_one():
    rng = random.Random(4)
    model = train([("Concierto de Ana Ruiz", "Una tarde de música en la plaza. " * 5)], ["La Revista"])
    made = lambda: plan_keys.Titles(set(WORDS), {"gira"}, {"teatro"}, Dictionary([(1, "Sala Zubiri")], {}, (), True), model)
    titles = [" ".join(_changed(rng, w, 2) for w in rng.sample(WORDS + NAMES, rng.randint(1, 4))) for _ in range(1_500)] + [None, "", " ", "Vol. 2", "5"]
    one, together = made(), made()
    found = together.parse_all(titles)
    assert found == [one.parse(t) for t in titles]
    assert [together.other_readings(p) for p in found if p] == [one.other_readings(p) for p in found if p]
    # No letters are left out of a name that is near no common word.
    together.far = together.near = None
    assert [p[2] for p in together.parse_all(["Quintela Oyarzun"])] == [["quintela", "oyarzun"]] and together.damaged("quintela") == ()


def test_pairs_are_turned_down_by_numbers():
    rng = random.Random(5)

    def title(words, names):
        return plan_keys.signature((" ".join(sorted(set(words))), "", list(dict.fromkeys(names))))

    pairs = []
    for _ in range(20_000):
        words, names = rng.sample(WORDS, rng.randint(0, 3)), rng.sample(NAMES, rng.randint(1, 3))
        others = [_changed(rng, w, 1) if rng.random() < 0.3 else w for w in names]
        some = [w for w in words if rng.random() < 0.8] + rng.sample(WORDS, rng.random() < 0.2)
        if rng.random() < 0.2 and words:
            others.append(_changed(rng, words[0], 2))
        rng.shuffle(others)
        pairs.append((title(words, names), title(some, others)))
    traits = dedup_history._Traits()
    may = dedup_history._may(traits([a for a, _ in pairs]), traits([b for _, b in pairs])).tolist()
    parsed = [(plan_keys.parsed(a), plan_keys.parsed(b)) for a, b in pairs]
    same = [plan_keys.may_be_same(a, b) and plan_keys.same_title(a, b) for a, b in parsed]
    assert sum(same) > 1_000 and all(m for m, s in zip(may, same, strict=True) if s)

    # Other numbers of words, two other words, and other names: all of these were compared word by word.
    far = [("cine||arribas ledo", "cine teatro||arribas zubiri"), ("cine danza||arribas ledo", "gira visita||arribas zubiri"), ("cine||arribas ledo", "cine||arribas belmonte"), ("cine||arribas", "cine||quintela")]
    assert not dedup_history._may(traits([a for a, _ in far[:3]]), traits([b for _, b in far[:3]])).any()
    assert not any(plan_keys.same_title(plan_keys.parsed(a), plan_keys.parsed(b)) for a, b in far)


def test_a_result_that_nothing_asks_for_is_not_made(spark, capsys):
    values = ["2026-03-04", "4 de marzo de 2026 a las 21:30", "mañana", "2026-02-30", "1772600000", "2026-03-04T21:30:00Z", "", None]
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "k int, v string")
    read = normalise_timestamps(rows, "v", only_read=True)
    every = normalise_timestamps(rows, "v").where("norm_value is not null")
    assert {(r.k, r.norm_value) for r in read.collect()} == {(r.k, r.norm_value) for r in every.collect()}
    assert {r.k for r in read.select("k").collect()} == {r.k for r in every.select("k").collect()} == {0, 1, 4, 5}
    read.select("k").explain()
    assert "86400000" not in capsys.readouterr().out
    assert read.select(F.count("norm_value")).first()[0] == 4
