"""Pairs of like texts over several blocks, against every pair measured."""

import random

import pytest
from pyspark.sql.classic.dataframe import DataFrame
from test_plans import _tables

from tablado import queries
from tablado.functions.blocks import Block, held, like
from tablado.functions.similarity import indel_text
from tablado.operators import dedup, history


def _texts(n, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice("abcdé ") for _ in range(rng.randint(0, 14))) for _ in range(n)]
    return texts + [t[1:] + rng.choice("xyz") for t in texts[: n // 3]] + [t + " y de nuevo" for t in texts[: n // 4]]


@pytest.fixture
def to_driver(monkeypatch):
    """The rows that each call brings to the driver."""
    sizes, collect = [0], DataFrame.collect

    def counted(self):
        rows = collect(self)
        sizes.append(len(rows))
        return rows

    monkeypatch.setattr(DataFrame, "collect", counted)
    return sizes


def test_pairs_meet_in_blocks(spark, monkeypatch, to_driver):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 20, raising=False)
    match = lambda a, b: indel_text(a, b) >= 85 or (len(a) > 5 and len(b) > 5 and (a in b or b in a))
    rows = [(i, t, i % 2) for i, t in enumerate(_texts(60, 1))]
    df = spark.createDataFrame(rows, "k long, t string, run int").repartition(3)
    found = dedup.similar_pairs(df, "k", "t", match, 0.85, within=["run"], contained_from=5)
    assert max(to_driver) <= 1
    want = {(i, j) for i, t, r in rows for j, u, s in rows if i > j and r == s and match(t, u)}
    assert len(want) > 10 and {tuple(r) for r in found.toLocalIterator()} == want


def test_history_is_matched_in_blocks(spark, monkeypatch, to_driver):
    monkeypatch.setattr(dedup, "BLOCK_ROWS", 20, raising=False)
    now, past = _texts(50, 2), _texts(50, 3) + _texts(50, 2)[::3]
    make = lambda texts, o: spark.createDataFrame([(i, "", "", t) for i, t in enumerate(texts)], f"{o} long, id string, url string, titulo string")
    found = history.match_history(make(now, "ord"), make(past, "hist_ord"), "ord", "id", "url", "titulo")
    assert max(to_driver) <= 1
    match = lambda a, b: indel_text(a, b) >= 90 or (len(a) > 10 and len(b) > 10 and (a in b or b in a))
    want = {(i, j, 3) for i, t in enumerate(now) if (j := next((j for j, u in enumerate(past) if match(t.strip(), u.strip())), None)) is not None}
    assert {tuple(r) for r in found.toLocalIterator()} == want


@pytest.mark.parametrize(("least", "size"), [(0.72, 30), (0.9, 30), (0.85, 150)])
def test_blocks_leave_nothing_out(least, size):
    rng = random.Random(size)
    texts = ["".join(rng.choice("abcdeñ 🎉") for _ in range(rng.randint(0, size))) for _ in range(60)]
    texts += [t[2:-1] for t in texts[:20]] + [t[:5] + "x" + t[6:] for t in texts[20:50]]
    a, b = Block(range(len(texts)), texts), Block(range(40), texts[::-1][:40])
    alike = lambda t, u: indel_text(t, u) >= 100 * least
    assert {(i, j) for i, j in like(a, b, least).tolist() if alike(a.texts[i], b.texts[j])} == {(i, j) for i, t in enumerate(a.texts) for j, u in enumerate(b.texts) if alike(t, u)}
    for x in (a, b):
        assert {tuple(p) for p in held(a, x, 8).tolist()} == {(i, j) for i, t in enumerate(a.texts) for j, u in enumerate(x.texts) if len(t) > 8 and t in u and (x is not a or i != j)}


@pytest.mark.parametrize("query", ["plans_pipeline", "fuzzy_dedup_plans"])
def test_queries_of_plans_collect_nothing(spark, tmp_path, to_driver, query):
    d = _tables(spark, tmp_path)
    assert len(list(queries.QUERIES[query](spark, d).toLocalIterator())) > 0
    assert max(to_driver) <= 1
