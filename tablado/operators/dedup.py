"""Order-preserving duplicate removal.

Exact forms keep the first row of a key.  The fuzzy forms reproduce an ordered greedy pass: rows are taken in
order, and each is compared with the leaders kept so far.  Greedy on the whole equals greedy within each
connected component of the match relation, so the plan is: matching pairs are found first, and the pass
is then settled in rounds over the pairs.

Candidate pairs: rows are dealt into blocks of ``BLOCK_ROWS``, and every two blocks meet in a task of their own
(``functions.blocks``); nothing is collected.  The work is still rows x rows, at some nanoseconds a pair: it is
meant for batches (a crawl's rows), not for a corpus.

Defined results
    * NULL texts count as ''.  Ties in order are broken by the key columns given as order; order must be total.
    * Empty tables give empty tables.  Extra columns are kept as they are.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablado.functions.blocks import Block, held, like
from tablado.functions.similarity import indel_text, ratcliff_text
from tablado.io import cut
from tablado.operators.graph import components

#: Rows of a block; a row is sent to as many tasks as the other side has blocks.
BLOCK_ROWS = 20_000


def keep_first(df: DataFrame, keys: list[Column], order: list[Column]) -> DataFrame:
    """The first row of each key in order; a total order makes the result certain.

    The first row is found by an aggregate with partial combination, so a hot key is never sorted in one task.
    """
    names = df.columns
    row = F.struct(*[F.col(f"`{c}`") for c in names])
    ks = [k.alias(f"__k{i}") for i, k in enumerate(keys)]
    os = F.struct(*[o.alias(f"__o{i}") for i, o in enumerate(order)])
    best = df.select(*ks, os.alias("__o"), row.alias("__r")).groupBy(*[f"__k{i}" for i in range(len(keys))]).agg(F.min_by("__r", "__o").alias("__r"))
    return best.select(*[F.col(f"__r.`{c}`").alias(c) for c in names])


def completeness(text: Column, weighted: list[tuple[Column, int]]) -> Column:
    """Letters of the text plus the weight of each field that is not missing."""
    out = F.length(F.coalesce(text, F.lit("")))
    for c, w in weighted:
        out = out + F.when(F.coalesce(c.cast("string"), F.lit("")) != "", w).otherwise(0)
    return out


def similar_pairs(df: DataFrame, key: str, text: str, measure: Callable[[str, str], bool], least: float, *, within: list[str] | None = None, contained_from: int | None = None, later: str = "true", earlier: str = "true") -> DataFrame:
    """(later, earlier): pairs of keys whose texts match under ``measure(later, earlier)``, later > earlier.

    ``least`` is a lower bound of the likeness (0 to 1) of matching pairs, ``within`` columns that must be
    equal.  With ``contained_from`` pairs of which one text (longer than it) holds the other are compared too.
    ``later`` and ``earlier`` are conditions on the key ``k`` of either side, so that two tables meet without
    pairs of their own.
    """
    rows = df.select(F.col(key).cast("bigint").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"), F.concat_ws("\u0001", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in within or []]).alias("w"))
    rows = cut(rows.withColumns({"a": F.expr(later), "b": F.expr(earlier)}).where("a or b"))
    # Blocks of BLOCK_ROWS on either side of each group; every two of them meet in one task.
    count = lambda c: F.ceil(F.count_if(c) / BLOCK_ROWS).cast("int")
    sizes = rows.groupBy("w").agg(count("a").alias("na"), count("b").alias("nb"), (F.count_if("a") + F.count_if("b") == 2 * F.count_if(F.col("a") & F.col("b"))).alias("one"))
    placed = rows.join(sizes.where("na > 0 and nb > 0"), "w")
    own = lambda n: F.pmod(F.xxhash64("k"), F.col(n)).cast("int")
    upto = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    # A table that meets itself has each two blocks once; rows of the block i are the left ones.
    other = F.when(F.col("one"), F.filter(upto("nb"), lambda j: j >= own("na"))).otherwise(upto("nb"))
    one = F.when(F.col("one"), F.filter(upto("na"), lambda i: i < own("nb"))).otherwise(upto("na"))
    same = F.col("one")
    left = placed.where("a").select("w", own("na").alias("i"), F.explode(other).alias("j"), F.lit(True).alias("left"), "one", "k", "t")
    right = placed.where("b").select("w", F.explode(one).alias("i"), own("nb").alias("j"), F.lit(False).alias("left"), same, "k", "t")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf[pdf["left"]]
        itself = bool(pdf["one"].iloc[0]) and pdf["i"].iloc[0] == pdf["j"].iloc[0]
        second = first if itself else pdf[~pdf["left"]]
        x, y = Block(first["k"], first["t"]), Block(second["k"], second["t"])
        found = like(x, y, least)
        if contained_from is not None:
            found = np.unique(np.concatenate([found, held(x, y, contained_from), held(y, x, contained_from)[:, ::-1]]), axis=0)
        k, m = x.keys[found[:, 0]], y.keys[found[:, 1]]
        good = k != m if pdf["one"].iloc[0] and not itself else k > m
        out = []
        for p, q, n, o in zip(*found[good].T.tolist(), k[good].tolist(), m[good].tolist(), strict=True):
            if measure(x.texts[p], y.texts[q]) if n > o else measure(y.texts[q], x.texts[p]):
                out.append((max(n, o), min(n, o)))
        return pd.DataFrame(out, columns=["later", "earlier"], dtype="int64")

    # As many tasks as there are pairs of blocks, so that one holds few of them.
    tasks = max(2 * df.sparkSession.sparkContext.defaultParallelism, min(sizes.agg(F.sum(F.col("na") * F.col("nb"))).first()[0] or 0, 10_000))
    met = left.unionByName(right).repartition(tasks, "w", "i", "j")
    return met.groupBy("w", "i", "j").applyInPandas(run, "later bigint, earlier bigint").distinct()


def greedy(rows: list[dict], match: Callable[[dict, dict], bool], better: Callable[[dict, dict], bool] | None, moving: bool, same: Callable[[dict], object] | None = None) -> list[dict]:
    """The ordered pass: every row joins the first leader it matches, or becomes one.

    With ``better`` a row replaces its leader's payload; with ``moving`` it then is what later rows are
    compared with.  ``same`` gives an exact key: rows whose key a kept leader had are skipped.
    """
    kept: list[list[dict]] = []  # [compared with, payload, first]
    seen: set = set()
    for r in rows:
        if same is not None and same(r) in seen:
            continue
        for leader in kept:
            if match(r, leader[0]):
                if better is not None and better(r, leader[1]):
                    leader[1] = r
                    if moving:
                        leader[0] = r
                break
        else:
            kept.append([r, r, r])
            if same is not None:
                seen.add(same(r))
    return [{**payload, "__at": first["__ord"]} for _, payload, first in kept]


def greedy_dedup(df: DataFrame, order: str, pairs: DataFrame, columns: list[str], match: Callable[[dict, dict], bool], better: Callable[[dict, dict], bool] | None = None, *, moving: bool = False, same: Callable[[dict], object] | None = None) -> DataFrame:
    """The rows that survive the ordered pass, with ``order`` set to the place of the first row they stand for.

    ``pairs`` (later, earlier) of order values has every pair that ``match`` can hold for; ``columns`` are
    what ``match`` and ``better`` read.  Rows without a partner are kept without entering Python.  A component
    is one task's work and is held there, so that this is for batches of bounded size.
    """
    roots = components(pairs.select("later", "earlier"))
    # The least node of a component is its root and has no row of its own there.
    every = cut(roots.select(F.col("node").alias("k"), "root").unionByName(roots.select(F.col("root").alias("k"), "root").distinct()))
    in_one = df.join(every, F.col(order) == F.col("k"), "left").drop("k")
    alone = in_one.where("root is null").select(*df.columns)
    some = in_one.where("root is not null").select("root", F.col(order).alias("__ord"), *[F.col(c) for c in columns if c != order])

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("__ord").astype(object).where(pdf.notna(), None).to_dict("records")
        kept = greedy(rows, match, better, moving, same)
        return pd.DataFrame({"payload": [k["__ord"] for k in kept], "at": [k["__at"] for k in kept]})

    chosen = some.groupBy("root").applyInPandas(run, "payload bigint, at bigint")
    taken = df.join(chosen, F.col(order) == F.col("payload")).withColumn(order, F.col("at")).select(*df.columns)
    return alone.unionByName(taken)


def first_leaders(pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(leaders, followers) of the ordered pass over ``pairs`` (later, earlier) of matching rows: (k) of rows
    with a partner that are kept, and (k, leader) of the others with the first kept row they match.

    Rounds: a row without an undecided earlier partner is kept, what matches a kept row is not.  No group is
    brought together, so a component of any size is spread over all tasks.
    """
    open_ = all_pairs = cut(pairs.distinct())
    leaders = pairs.select(F.col("later").alias("k")).limit(0)
    while True:
        later = open_.select(F.col("later").alias("k")).distinct()
        kept = cut(open_.select(F.col("earlier").alias("k")).distinct().join(later, "k", "left_anti"))
        if kept.isEmpty():
            break
        leaders = leaders.unionByName(kept)
        out = cut(open_.join(kept, F.col("earlier") == F.col("k"), "left_semi").select(F.col("later").alias("k")).distinct())
        left = open_.join(kept, F.col("earlier") == F.col("k"), "left_anti").join(out, F.col("later") == F.col("k"), "left_anti")
        # Rows that lost all their partners are kept in the end.
        nxt = cut(left.join(out, F.col("earlier") == F.col("k"), "left_anti"))
        freed = left.select(F.col("later").alias("k")).distinct().join(nxt.select(F.explode(F.array("later", "earlier")).alias("k")).distinct(), "k", "left_anti")
        leaders, open_ = leaders.unionByName(cut(freed)), nxt
    leaders = cut(leaders.distinct())
    followers = all_pairs.join(leaders, F.col("earlier") == F.col("k"), "left_semi").join(leaders, F.col("later") == F.col("k"), "left_anti")
    return leaders, followers.groupBy(F.col("later").alias("k")).agg(F.min("earlier").alias("leader"))


def dedup_by_title(df: DataFrame, order: str, title: str, least: float = 0.72) -> DataFrame:
    """Rows of which no kept earlier row has a title more than ``least`` alike (Ratcliff-Obershelp)."""
    low = keep_first(df.withColumn("__t", F.lower(F.coalesce(F.col(title), F.lit("")))), [F.col("__t")], [F.col(order)])  # copies share the first one's fate
    # The longest common subsequence bounds the matched letters and is much cheaper.
    alike = lambda later, earlier: indel_text(later, earlier) >= 100 * least - 1e-9 and ratcliff_text(later, earlier) > least
    pairs = similar_pairs(low, order, "__t", alike, least)
    followers = first_leaders(pairs)[1]
    return low.join(followers, F.col(order) == F.col("k"), "left_anti").drop("__t")


def dedup_keep_fullest(df: DataFrame, order: str, key: str, title: str, score: Column, least: float = 85.0, held_from: int = 8, run: Column | None = None) -> DataFrame:
    """One row of each group of like titles (Indel ratio from ``least`` on, or one holding the other), the
    fullest by ``score``; a row whose key a leader had is skipped.  Later rows are compared with the title
    of the group's first row, also after it was replaced.  With ``run`` rows of each run are taken by themselves."""
    low = df.withColumns({"__t": F.trim(F.lower(F.coalesce(F.col(title), F.lit("")))), "__s": score, "__run": F.coalesce(run.cast("string"), F.lit("")) if run is not None else F.lit("")})
    low = low.withColumn("__key", F.concat("__run", F.lit("|"), F.col(key).cast("string")))

    def alike(a: str, b: str) -> bool:
        return indel_text(a, b) >= least or (len(a) > held_from and len(b) > held_from and (a in b or b in a))

    low = cut(low)
    pairs = similar_pairs(low, order, "__t", alike, least / 100, within=["__run"], contained_from=held_from)
    # A row whose key a kept row has is skipped; only rows that match by title compete.
    rows = low.select(F.col(order).alias("k"), "__key", "__s")
    same = rows.join(rows.withColumnRenamed("k", "earlier").drop("__s"), "__key").where("k > earlier").select(F.col("k").alias("later"), "earlier")
    followers = cut(first_leaders(pairs.unionByName(same))[1])
    held = rows.join(followers.select("k"), "k", "left_anti").groupBy("__key").agg(F.min("k").alias("holder"))
    skipped = followers.join(rows, "k").join(held, "__key").where("holder < k").select("k")
    # The fullest of a leader's rows, the first of equals; the leader itself included.
    joined = followers.join(skipped, "k", "left_anti").unionByName(rows.join(followers, "k", "left_anti").select("k", F.col("k").alias("leader")))
    best = joined.join(rows, "k").groupBy("leader").agg(F.max_by("k", F.struct("__s", (-F.col("k")).alias("n"))).alias("k"))
    out = low.join(best, F.col(order) == F.col("k")).withColumn(order, F.col("leader")).select(*low.columns)
    return out.drop("__t", "__s", "__run", "__key")


def dedup_in_band(df: DataFrame, order: str, name: str, day: str, better: Column, days: int = 3, least: float = 0.85, held: float = 0.70) -> DataFrame:
    """One row of each group of like names at most ``days`` apart (NULL days only match NULL).

    Names match if equal, more than ``least`` alike, or one holds the other (over 4 letters) and is at least
    ``held`` as long.  A row whose ``better`` flags (an array of booleans) has one that its leader lacks
    takes its place, and later rows are compared with it.
    """
    low = df.withColumns({"__t": F.coalesce(F.col(name), F.lit("")), "__d": F.datediff(F.col(day), F.lit("1970-01-01").cast("date")), "__b": better})

    def alike(a: str, b: str) -> bool:
        if a == b or (indel_text(a, b) >= 100 * least - 1e-9 and ratcliff_text(a, b) > least):
            return True
        short, long = (a, b) if len(a) <= len(b) else (b, a)
        return len(short) > 4 and short in long and len(short) / len(long) >= held

    def match(r: dict, u: dict) -> bool:
        x, y = r["__d"], u["__d"]
        near = (x is None and y is None) if x is None or y is None else abs(int(x) - int(y)) <= days
        return near and alike(r["__t"], u["__t"])

    # Equal buckets of days, each row in its own and the next: partners meet in at least one.
    bucket = F.when(F.col("__d").isNull(), F.array(F.lit(-1))).otherwise(F.array(F.floor(F.col("__d") / (days + 1)).cast("int"), F.floor(F.col("__d") / (days + 1)).cast("int") + 1))
    spread = low.withColumn("__w", F.explode(bucket))
    pairs = similar_pairs(spread, order, "__t", alike, 2 * held / (1 + held), within=["__w"])
    out = greedy_dedup(low, order, pairs, ["__t", "__d", "__b"], match, lambda r, u: any(p and not q for p, q in zip(r["__b"], u["__b"], strict=True)), moving=True)
    return out.drop("__t", "__d", "__b")


def latest_per_key(df: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """The last row of each key, by a window; for keys that are known to be few rows each."""
    w = Window.partitionBy(*keys).orderBy(order.desc())
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


