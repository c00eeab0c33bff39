"""Mixing sources to target weights of a total number of tokens, with capped repetition.

Every document has a fixed hash.  Tokens are summed by source and hash bucket; the running sums show in which
bucket a source's budget ends, only that bucket is split into finer buckets, and so on until it holds one
document.  Documents below their source's threshold are then taken by a filter.  Nothing is sorted, only the
histograms (sources x ``BUCKETS`` numbers) reach the driver, and a larger budget takes a superset.

Defined results
    * The total is the largest at which every source can fill its share within its repeats, or ``total``.
    * A source whose budget is r times its tokens and a rest is used r times whole, and once more below the
      threshold; no document is used more than ``max_repeats`` times.
    * The tokens taken differ from the budget by less than the documents at the threshold have (documents
      with the same hash, such as repeated rows, are taken together or not at all).
    * NULL and empty texts, sources without a target and targets without documents are not used; a target
      without documents doesn't limit the total.  NULL or negative shares and repeats count as 0.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablado.io import cut

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the published pattern that splits texts before byte pairs are merged.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
BITS = 10
BUCKETS = 1 << BITS
MAX_SOURCES = 10_000


def load_tokenizer(path: str) -> Any:
    """A tiktoken encoding from a file of ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def count_tokens(text: Column, path: str = TOKENIZER) -> Column:
    """The number of tokens of a text column; 0 for NULL and empty texts."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoding = load_tokenizer(path)  # once for a task
        for s in batches:
            yield s.map(lambda t: len(encoding.encode_ordinary(t)) if t else 0).astype("int64")

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "bigint")(text)


def _bucket(level: int) -> Column:
    """The bucket of a document at a level: the next ``BITS`` bits of its hash."""
    return F.expr(f"cast(shiftright(h, {63 - BITS * (level + 1)}) & {BUCKETS - 1} as int)")


def _thresholds(sized: DataFrame, rests: dict[str, float]) -> dict[str, int]:
    """For each source the hash below which documents sum up to its rest, or one document less."""
    done = dict.fromkeys(rests, 0)
    open_ = {s: (0, r) for s, r in rests.items() if r > 0}  # prefix of the hash so far, tokens still wanted
    for level in range(6):
        if not open_:
            break
        rows = sized
        if level:
            wanted = sized.sparkSession.createDataFrame([(s, prefix) for s, (prefix, _) in open_.items()], "source string, prefix bigint")
            rows = rows.join(F.broadcast(wanted), "source").where(F.expr(f"shiftright(h, {63 - BITS * level})") == F.col("prefix"))
        counted = rows.where(F.col("source").isin(*open_)).groupBy("source", _bucket(level).alias("b")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("docs")).collect()
        by: dict[str, list] = {}
        for r in counted:
            by.setdefault(r.source, []).append((r.b, r.n, r.docs))
        following = {}
        shift = 63 - BITS * (level + 1)
        for s, (prefix, wanted) in open_.items():
            end, go_on = (prefix + 1) << (shift + BITS), False
            for b, n, docs in sorted(by.get(s, [])):
                if n > wanted:
                    end = ((prefix << BITS) | b) << shift
                    go_on = docs > 1
                    if not go_on and n - wanted < wanted:  # nearer with the document than without
                        end += 1 << shift
                    break
                wanted -= n
            if go_on and level < 5:
                following[s] = (end >> shift, wanted)
            else:
                done[s] = end
        open_ = following
    return done


def plan_mix(sized: DataFrame, targets: list[tuple[str, float, int]], total: float | None = None) -> dict[str, tuple[float, int, int]]:
    """source -> (budget, whole repeats, hash threshold of one more) for documents (source, n_tokens, h)."""
    if len(targets) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    wanted = {s: (max(share or 0.0, 0.0), max(repeats or 0, 0)) for s, share, repeats in targets if s is not None}
    sums = {r.source: r.n for r in sized.where(F.col("source").isin(*wanted)).groupBy("source").agg(F.sum("n_tokens").alias("n")).collect()} if wanted else {}
    most = [wanted[s][1] * n / wanted[s][0] for s, n in sums.items() if n and wanted[s][0] > 0]
    size = min([*most, *([total] if total is not None else [])], default=0.0)
    budgets = {s: size * wanted[s][0] for s, n in sums.items() if n}
    whole = {s: int(b // sums[s]) for s, b in budgets.items()}
    rests = {s: b - whole[s] * sums[s] for s, b in budgets.items()}
    # A budget within a token of the next whole repeat is that repeat.
    for s in budgets:
        if sums[s] - rests[s] < 1 and whole[s] < wanted[s][1]:
            whole[s], rests[s] = whole[s] + 1, 0.0
    at = _thresholds(sized, rests)
    return {s: (budgets[s], whole[s], at[s]) for s in budgets}


def mix(docs: DataFrame, key: str, text: str, source: str, targets: DataFrame, *, total: float | None = None, tokenizer: str = TOKENIZER) -> tuple[DataFrame, DataFrame]:
    """(documents, shares): (key, source, n_tokens, repeats) of every used document, and what each target got.

    ``targets`` has source, target_share and max_repeats.
    """
    sized = docs.select(F.col(f"`{key}`").alias(key), F.col(f"`{source}`").alias("source"), count_tokens(F.col(f"`{text}`"), tokenizer).alias("n_tokens"))
    sized = cut(sized.where("n_tokens > 0 and source is not null").withColumn("h", F.expr(f"xxhash64(`{key}`) & {(1 << 63) - 1}")))
    rows = [(r.source, r.target_share, r.max_repeats) for r in targets.select("source", "target_share", "max_repeats").limit(MAX_SOURCES + 1).collect()]
    plan = plan_mix(sized, rows, total)
    spark = docs.sparkSession
    plans = spark.createDataFrame([(s, float(b), w, t) for s, (b, w, t) in plan.items()], "source string, budget double, whole int, threshold bigint")
    used = sized.join(F.broadcast(plans), "source").withColumn("repeats", F.col("whole") + F.when(F.col("h") < F.col("threshold"), 1).otherwise(0)).where("repeats > 0")
    got = used.groupBy("source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("tokens"), F.count("*").alias("documents"), F.max("repeats").alias("most_repeats"))
    everything = got.agg(F.sum("tokens").alias("every"))
    shares = (
        targets.select("source", "target_share", "max_repeats")
        .join(got, "source", "left")
        .join(F.broadcast(everything))
        .select("source", "target_share", (F.coalesce("tokens", F.lit(0)) / F.col("every")).alias("reached_share"), F.coalesce("tokens", F.lit(0).cast("bigint")).alias("tokens"), F.coalesce("documents", F.lit(0).cast("bigint")).alias("documents"), F.coalesce("most_repeats", F.lit(0)).alias("most_repeats"), "max_repeats")
    )
    return used.select(key, "source", "n_tokens", "repeats"), shares
