"""New batches checked for duplicates and near-duplicates against everything accepted before.

Multi-key sorted-neighbourhood runs.  Every accepted title is kept under several sort keys in persisted key
ranges.  A batch is sorted under the same keys, merged into just the ranges it touches, and compared only
within a window round each new record; exact keys (id, page, title) are looked up in hashed buckets.  Like
titles that lie farther away in every order meet under block keys of their names, kept in buckets too.  What
the batch adds is written as a new run; when runs pile up they are compacted and ranges are cut anew.

The store's state is a manifest beside the runs, renamed into place after a run is written, so that a store
opened by another process goes on where the last whole merge ended.

Scale: copies are aggregated to one record a title before sorting; ranges are cut at quantiles of the sort
keys, so that neither a common title word nor a large plan makes a hot range; windows stream over sorted
records, and only the ends of ranges (2 x window records each) meet in a second step.  Block keys are
numbers; only blocks in which records of different plans meet are given their titles and compared.

Defined results
    * Two rows are one plan if they have the same id, page or title as ``plan_keys`` defines it; chains too.
    * NULL and empty ids, pages and titles link nothing; pages of the listing catalog link nothing.
    * The first row of a plan is the one with the least row_id; repeated rows are links like any other.
    * An empty batch or store gives no rows.
"""

from __future__ import annotations

import bisect
import json
from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tablado.io import cut, delete, discard, names_in, shared_dir, write_text
from tablado.llm.canonical import Dictionary
from tablado.llm.content import Model
from tablado.llm.encoding import fold
from tablado.llm.plan_keys import LIKE, PERFORMER, REWORDED, Titles, block_keys, may_be_same, near_sets, of_sort_key, page_key, parsed, same_title, signature, sort_keys
from tablado.operators.graph import components, normal

WINDOW = 8
PASSES = 4
#: Records of a key range that are aimed at, and the most ranges of a pass (their ends, some 100 bytes each, are
#: sent to the tasks); beyond that ranges grow, which costs no memory, as windows stream.
RANGE_RECORDS, MAX_RANGES = 20_000, 20_000
#: Titles from which the cutting points of key ranges are taken, 16 a range if that is more; they only decide
#: where ranges end.
SAMPLE_TITLES = 8_000
#: A word is common, and no proper name, from this share of the distinct titles on (and this number): at most
#: words-per-title / share words, some 6,000.
COMMON_SHARE, COMMON_LEAST = 0.002, 10
#: Keys of a bucket that are aimed at, and the fewest buckets.
BUCKET_KEYS, LEAST_BUCKETS = 50_000, 8

_ACCENTS = ("áéíóúüñàèìòùâêîôûçãõ", "aeiouunaeiouaeioucao")


def common_words(accepted: DataFrame, arriving: DataFrame) -> tuple[set[str], set[str]]:
    """Words that at least ``COMMON_SHARE`` of the distinct titles (one-column tables) have, and those of
    them that no accepted title has."""
    fields = [df.select(F.translate(F.lower(F.col(df.columns[0])), *_ACCENTS).alias("t"), F.lit(old).alias("old")) for df, old in ((accepted, 1), (arriving, 0))]
    distinct = fields[0].unionByName(fields[1]).where("trim(t) <> ''").groupBy("t").agg(F.max("old").alias("old"))
    # "#" counts the titles themselves.
    words = F.explode(F.array_append(F.array_distinct(F.split("t", r"[^\p{L}\p{N}]+")), F.lit("#")))
    counts = cut(distinct.select(words.alias("w"), "old").groupBy("w").agg(F.count("*").alias("n"), F.sum("old").alias("old")).where("n >= 2"))
    titles_in_all = counts.where("w = '#'").select("n").first()
    least = max(COMMON_LEAST, COMMON_SHARE * titles_in_all.n) if titles_in_all else COMMON_LEAST
    found = counts.where((F.col("n") >= least) & (F.length("w") > 2)).select("w", "old").collect()
    return {fold(r.w) for r in found}, {fold(r.w) for r in found if not r.old}


def bounded_sample(df: DataFrame, column: str, size: int, total: int) -> list[str]:
    """At most ``size`` values chosen by a hash; partitions send only what passes the hash, not ``size`` each."""
    share = min(1.0, 2 * size / max(total, 1))
    chosen = df.where(F.pmod(F.xxhash64(column), F.lit(1 << 20)) <= int(share * (1 << 20)))
    return [r[0] for r in chosen.select(column).limit(size).collect()]


def title_parser(accepted: DataFrame, arriving: DataFrame, categories: DataFrame, venues: DataFrame, model: Model) -> Titles:
    """What takes titles apart, from the accepted and the arriving titles, the categories (one column each)
    and the venue catalog (id, name)."""
    names = [(r[0], r[1]) for r in venues.collect()]
    # A category heads many titles of its own, so the categories that ``COMMON_SHARE`` of the rows have are few.
    kind = F.col(categories.columns[0])
    least = max(1, int(COMMON_SHARE * categories.count()))
    kinds = {fold(r[0]) for r in categories.where(kind != "").groupBy(kind).count().where(F.col("count") >= least).collect()}
    words, phrases = common_words(accepted, arriving)
    return Titles(words, phrases, kinds, Dictionary(names, {}, (), True), model)


def take_apart(rows: DataFrame, parser: Titles, listings: set[str], more: Callable[[pd.DataFrame], pd.DataFrame] | None = None, schema: str = "", keep: list[str] | None = None) -> DataFrame:
    """(row_id, k_id, k_page, sig, other, k_sig) of (row_id, id, page, title) rows; NULL keys link nothing.

    ``other`` has further readings of the title, a line each.  ``more`` may add columns (of ``schema``) read
    from the same rows in the same pass; the columns ``keep`` are kept.
    """
    keep = keep or []

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            pages = [page_key(u) for u in b["page"]]
            found = parser.parse_all(b["title"])
            out = b[["row_id", "id", *keep]].assign(
                page=[p if p not in listings else "" for p in pages],
                sig=[signature(p) if p else "" for p in found],
                other=["\n".join(map(signature, parser.other_readings(p))) if p else "" for p in found],
            )
            yield out if more is None else pd.concat([out, more(b)], axis=1)

    kept = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    out = rows.mapInPandas(run, f"row_id bigint, id string{kept}, page string, sig string, other string" + (", " + schema if schema else ""))
    key = lambda c, kind: F.when(F.col(c) != "", F.xxhash64(F.lit(kind), F.col(c)))
    rest = [c for c in out.columns if c not in ("row_id", "id", "page", "sig", "other")]
    return out.select("row_id", key("id", "id").alias("k_id"), key("page", "page").alias("k_page"), "sig", "other", key("sig", "title").alias("k_sig"), *rest)


def _cut_points(sigs: list[str], total: int) -> list[list[str]]:
    n = max(1, min(len(sigs), MAX_RANGES, -(-total // RANGE_RECORDS)))
    out = []
    for k in range(PASSES):
        keys = sorted(sort_keys(s)[k] for s in sigs)
        out.append(sorted({keys[len(keys) * i // n] for i in range(1, n)}) if keys else [])
    return out


#: Pass and number of a range in one number.
_PASS = 1_000_000
_RECORD = "range_no int, key string, sig string, node bigint"


def _keyed(sigs: DataFrame, points: list[list[str]]) -> DataFrame:
    """(range_no, key, sig, node): every title under the key of every pass and reading, in its range.

    ``sig`` is NULL where it can be read from the key.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for sig, other, node in zip(b["sig"], b["other"], b["node"], strict=True):
                out += [(k * _PASS + bisect.bisect_right(points[k], key), key, None, node) for k, key in enumerate(sort_keys(sig))]
                for reading in other.split("\n") if other else ():
                    out += [(k * _PASS + bisect.bisect_right(points[k], key), key, sig, node) for k, key in enumerate(sort_keys(reading))]
            yield pd.DataFrame(out, columns=["range_no", "key", "sig", "node"])

    return sigs.select("sig", "other", "node").mapInPandas(run, _RECORD)


_PAIRS = "a bigint, b bigint, range_no int, key string, sig string, node bigint, fresh boolean"
_KINDS = {"a": "Int64", "b": "Int64", "range_no": "Int32", "node": "Int64", "fresh": "boolean"}


class _Bits(dict):
    """A bit for each letter, and six for all other characters together."""

    def __missing__(self, c: str) -> int:
        bit = self[c] = 1 << (ord(c) - 97 if "a" <= c <= "z" else 26 + ord(c) % 6)
        return bit


_bit = _Bits().__getitem__


def _letters(name: str) -> int:
    """The characters of a name as bits; one edit changes at most two."""
    return reduce(or_, map(_bit, name))


class _Traits:
    """Numbers by which pairs of titles that cannot be the same are told apart, many at once."""

    COLUMNS = 12

    def __init__(self) -> None:
        self.memo: dict[str, tuple[int, ...]] = {}

    def __call__(self, sigs: list[str]) -> np.ndarray:
        """(series, names if two, first and second name, ends of both; words in all, common words, bits of
        these, all names, letters of the first and of the second name) of each title."""
        memo, out = self.memo, []
        if len(memo) > 200_000:
            memo.clear()
        for s in sigs:
            if (t := memo.get(s)) is None:
                common, series, joined = s.split("|")
                words, names = common.split(), joined.split()
                bits = 0
                for w in words:
                    bits |= 1 << hash(w) % 63
                if len(names) != 2 or "\ufffd" in joined:
                    two = hash(series), 0, 0, 0, 0, 0
                    seen = 0, 0
                else:
                    p, q = names
                    two = hash(series), 2, hash(p), hash(q), ord(p[0]) << 32 | ord(p[-1]), ord(q[0]) << 32 | ord(q[-1])
                    seen = _letters(p), _letters(q)
                t = memo[s] = (*two, len(words) + len(names), hash(frozenset(words)), bits, hash(frozenset(names)), *seen)
            out.append(t)
        return np.array(out, dtype=np.int64).reshape(len(sigs), self.COLUMNS)


def _may(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """``may_be_same`` for rows of traits, and more that ``same_title`` needs.

    Unless the names are the same, each of at most one other common word on either side is paired with a name,
    so that both titles have as many words; with the same common words, at most two edits part the names.
    """
    low = 0xFFFFFFFF
    p, q, r, s = x[:, 2], x[:, 3], y[:, 2], y[:, 3]
    shared = (p == r) | (q == s) | (p == s) | (q == r)
    end = lambda a, b: ((a >> 32) == (b >> 32)) | ((a & low) == (b & low))
    close = (end(x[:, 4], y[:, 4]) & end(x[:, 5], y[:, 5])) | (end(x[:, 4], y[:, 5]) & end(x[:, 5], y[:, 4]))
    not_two = (x[:, 1] != 2) | (y[:, 1] != 2)
    apart = lambda i, j: np.bitwise_count(x[:, i] ^ y[:, j])
    few = np.minimum(apart(10, 10) + apart(11, 11), apart(10, 11) + apart(11, 10)) <= 4
    one = (np.bitwise_count(x[:, 8] & ~y[:, 8]) <= 1) & (np.bitwise_count(y[:, 8] & ~x[:, 8]) <= 1)
    alike = (x[:, 6] == y[:, 6]) & one & ((x[:, 7] != y[:, 7]) | not_two | few)
    return (x[:, 0] == y[:, 0]) & (not_two | shared | close) & ((x[:, 9] == y[:, 9]) | alike)


def _slide(batches: Iterator[pd.DataFrame], across: bool) -> Iterator[pd.DataFrame]:
    """Pairs within the window over sorted records; the ends of ranges come out as records without a pair.

    With ``across`` the input is ends of ranges, and only pairs of different ranges of a pass are compared.
    Records that are known to be one plan, or have become so within the batch, are not compared again.
    """
    traits = _Traits()
    tail: pd.DataFrame | None = None  # the last WINDOW records
    place = 0  # of the tail's last record in its range

    def ends(part: pd.DataFrame) -> list[tuple]:
        return [(None, None, *r) for r in part[["range_no", "key", "sig", "node", "fresh"]].itertuples(index=False, name=None)]

    for batch in batches:
        if batch.empty:
            continue
        carried = 0 if tail is None else len(tail)
        df = batch if tail is None else pd.concat([tail, batch], ignore_index=True)
        rng = df["range_no"].to_numpy()
        group = rng // _PASS if across else rng
        node, fresh = df["node"].to_numpy(), df["fresh"].to_numpy(dtype=bool)
        sigs = [x or of_sort_key(r // _PASS, key) for x, r, key in zip(df["sig"], rng.tolist(), df["key"], strict=True)]
        x = traits(sigs)
        label = dict(zip(node.tolist(), node.tolist(), strict=True))

        def root(n: int, label: dict[int, int] = label) -> int:
            while label[n] != n:
                n = label[n]
            return n

        out: list[tuple] = []
        for k in range(1, WINDOW + 1):
            if len(df) <= k:
                break
            good = (group[k:] == group[:-k]) & (node[k:] != node[:-k]) & (fresh[k:] | fresh[:-k])
            if across:
                good &= rng[k:] != rng[:-k]
            good[: max(0, carried - k)] = False  # both carried over: compared before
            at = np.flatnonzero(good)
            at = at[_may(x[at], x[at + k])] if len(at) else at
            for i in at.tolist():
                a, b = root(int(node[i])), root(int(node[i + k]))
                if a == b:
                    continue
                if sigs[i] == sigs[i + k]:  # tied by their exact key
                    label[max(a, b)] = min(a, b)
                elif same_title(parsed(sigs[i]), parsed(sigs[i + k])):
                    label[max(a, b)] = min(a, b)
                    m, n = int(node[i]), int(node[i + k])
                    out.append((max(m, n), min(m, n), None, None, None, None, None))
        if not across:
            # The first and the last records of every range.
            new = np.r_[True, group[1:] != group[:-1]]
            starts = np.flatnonzero(new)
            number = np.arange(len(df)) - np.repeat(starts, np.diff(np.r_[starts, len(df)]))
            if carried:  # the range that went on from the batch before
                i = int(np.searchsorted(starts, carried - 1, side="right"))
                number[starts[i - 1] : starts[i] if i < len(starts) else len(df)] += place - number[carried - 1]
            firsts = (number < WINDOW) & (np.arange(len(df)) >= carried)
            lasts = np.zeros(len(df), dtype=bool)
            for end in starts[1:]:
                lasts[max(0, end - WINDOW) : end] |= (group[max(0, end - WINDOW) : end] == group[end - 1]) & (number[max(0, end - WINDOW) : end] >= WINDOW)
            out += ends(df[firsts | lasts])
            place = int(number[-1])
        tail = df.iloc[-WINDOW:]
        yield pd.DataFrame(out, columns=["a", "b", "range_no", "key", "sig", "node", "fresh"]).astype(_KINDS)
    if not across and tail is not None:
        last = tail[(tail["range_no"] == tail["range_no"].iloc[-1]) & (np.arange(place - len(tail) + 1, place + 1) >= WINDOW)]
        yield pd.DataFrame(ends(last), columns=["a", "b", "range_no", "key", "sig", "node", "fresh"]).astype(_KINDS)


def window_pairs(keyed: DataFrame) -> DataFrame:
    """(a, b): nodes of two titles that name the same event, at least one of them new, a > b."""
    records = keyed.select("range_no", "key", "sig", "node", "fresh")
    found = cut(records.repartition("range_no").sortWithinPartitions("range_no", "key", "sig").mapInPandas(lambda it: _slide(it, False), _PAIRS))
    ends = found.where("a is null").select("range_no", "key", "sig", "node", "fresh").distinct()
    of_pass = F.floor(F.col("range_no") / _PASS)
    across = ends.repartition(PASSES, of_pass).sortWithinPartitions(of_pass, "key", "sig", "range_no").mapInPandas(lambda it: _slide(it, True), _PAIRS)
    return found.where("a is not null").select("a", "b").unionByName(across.where("a is not null").select("a", "b")).distinct()


def blocked(sigs: DataFrame) -> DataFrame:
    """(block, kind, node): every title under each of its block keys, as numbers."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            keys, kinds, sizes = [], [], []
            for sig, other in zip(b["sig"], b["other"], strict=True):
                found = {key: kind for kind, key in block_keys(parsed(sig))}
                for reading in other.split("\n") if other else ():
                    found |= {key: kind for kind, key in block_keys(parsed(reading)) if kind == LIKE}
                keys += found
                kinds += found.values()
                sizes.append(len(found))
            yield pd.DataFrame({"block": np.array(keys, dtype=np.uint64).view(np.int64), "kind": np.array(kinds, dtype=np.int8), "node": np.repeat(b["node"].to_numpy(), sizes)})

    return sigs.select("sig", "other", "node").mapInPandas(run, "block bigint, kind tinyint, node bigint")


def _star(firsts: list[int]) -> list[tuple[int, int]]:
    least = min(firsts)
    return [(x, least) for x in firsts if x != least]


def _of_performer(block: list[tuple]) -> list[tuple[int, int]]:
    """Links between titles (kind, sig, node, fresh, parsed) of the same names, at least one of each pair new.

    Titles that differ in the words of rewordings are the same event, so they need no comparing.
    """
    kinds: dict[frozenset, dict[frozenset, list[tuple]]] = {}
    for r in block:
        words = frozenset(r[4][0].split())
        kinds.setdefault(frozenset(w for w in words if w.startswith(REWORDED)), {}).setdefault(words, []).append(r)
    fresh = {k for k, sets in kinds.items() if any(r[3] for rs in sets.values() for r in rs)}
    out = []
    if len(kinds) > 1 and fresh:
        out += _star([r[2] for k, sets in kinds.items() for rs in sets.values() for r in rs if r[3] or fresh - {k}])
    for sets in kinds.values():
        rows = list(sets.values())
        new = [any(r[3] for r in rs) for rs in rows]
        starred = set()
        for i, j in [*((i, i) for i in range(len(rows))), *near_sets(list(sets))]:
            if (new[i] or new[j]) and (i == j or same_title(rows[i][0][4], rows[j][0][4])):
                for x in {i, j} - starred:
                    out += _star([r[2] for r in rows[x]])
                    starred.add(x)
                out += _star([min(r[2] for r in rows[i]), min(r[2] for r in rows[j])])
    return out


def _of_block(block: list[tuple]) -> list[tuple[int, int]]:
    """Links between titles (kind, sig, node, fresh, parsed) of a block; joined ones are not compared again."""
    if block[0][0] == PERFORMER:
        return _of_performer(block)
    same = lambda r, o: (r[3] or o[3]) and may_be_same(o[4], r[4]) and same_title(o[4], r[4])
    out: list[tuple[int, int]] = []
    groups: list[list[tuple]] = []
    for r in block:
        joined, apart = [r], []
        for g in groups:
            if o := next((o for o in g if r[2] == o[2] or same(r, o)), None):
                if r[2] != o[2]:
                    out.append((max(r[2], o[2]), min(r[2], o[2])))
                joined += g
            else:
                apart.append(g)
        groups = [joined, *apart]
    return out


def block_pairs(blocks: DataFrame, titles: DataFrame, pairs: DataFrame) -> DataFrame:
    """(a, b): nodes of two titles of a block that name the same event, at least one of them new, a > b.

    ``blocks`` has (block, kind, node, fresh), ``titles`` the (node, sig) of all of them.  ``pairs`` are
    links already found: blocks whose records are all tied to one node by them need no comparing.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, block = None, []
        for batch in batches:
            out = []
            for key, kind, sig, node, fresh in zip(batch["block"], batch["kind"], batch["sig"], batch["node"], batch["fresh"], strict=True):
                if key != now:
                    if len(block) > 1:
                        out += _of_block(block)
                    now, block = key, []
                block.append((kind, sig, node, fresh, parsed(sig)))
            yield pd.DataFrame(list(set(out)), columns=["a", "b"], dtype="int64")
        if len(block) > 1:
            yield pd.DataFrame(_of_block(block), columns=["a", "b"], dtype="int64")

    tied = pairs.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low"))
    labelled = blocks.join(tied, "node", "left").withColumn("low", F.coalesce("low", "node"))
    w = Window.partitionBy("block")
    met = labelled.select("*", F.max("fresh").over(w).alias("any"), F.min("low").over(w).alias("least"), F.max("low").over(w).alias("most")).where("any and least < most")
    some = met.select("block", "kind", "node", "fresh").join(titles, "node")
    return some.repartition("block").sortWithinPartitions("block", "node").mapInPandas(run, "a bigint, b bigint").where("a <> b").distinct()


class RunStore:
    """Accepted plans in a shared folder: key ranges of titles, hashed exact and block keys, and the rows' plans.

    A title is known by the least row that has it, its node.  ``links`` has (node, root) of every row that
    repeats an earlier one; roots that a later batch ties together are links too, so that a chain of them leads
    to a plan's first row.  Only the links of nodes that a batch touches are read.
    """

    _TABLES = {"titles": "key string, sig string, node bigint, range_no int", "blocks": "block bigint, kind tinyint, node bigint, bucket int", "keys": "k bigint, node bigint, bucket int", "sigs": "node bigint, sig string, other string, bucket int", "links": "a bigint, b bigint, bucket int"}
    _KEYS = {"titles": "range_no", "blocks": "block", "keys": "k", "sigs": "node", "links": "a"}

    def __init__(self, spark: SparkSession, folder: str, max_runs: int = 6) -> None:
        self.spark, self.folder, self.max_runs = spark, folder.rstrip("/"), max_runs
        self.runs: list[str] = []
        self.points: list[list[str]] | None = None
        self.buckets = LEAST_BUCKETS
        self.titles = self.made = 0
        #: The folders of each table that the last merge read.
        self.touched: dict[str, list[int]] = {}
        if states := [n for n in names_in(spark, f"{self.folder}/states") if n.endswith(".json")]:
            state = json.loads(spark.read.text(f"{self.folder}/states/{states[-1]}", wholetext=True).first()[0])
            self.runs, self.points, self.buckets, self.titles, self.made = (state[k] for k in ("runs", "points", "buckets", "titles", "made"))

    def _commit(self) -> None:
        state = {"runs": self.runs, "points": self.points, "buckets": self.buckets, "titles": self.titles, "made": self.made}
        write_text(self.spark, f"{self.folder}/states/{self.made:09d}.json", json.dumps(state))

    def _of_run(self, run: str, part: str) -> DataFrame:
        return self.spark.read.schema(self._TABLES[part]).parquet(f"{self.folder}/{run}/{part}")

    def _read(self, part: str, only: list[int] | None = None) -> DataFrame:
        """A table of all runs; with ``only`` just those of its folders (ranges or buckets)."""
        out = None
        by = "range_no" if part == "titles" else "bucket"
        for r in self.runs:
            f = self._of_run(r, part)
            if only is not None:
                f = f.where(F.col(by).isin(only))
            out = f if out is None else out.unionByName(f)
        if only is not None:
            self.touched[part] = only
        return out

    def _folders(self, run: str, part: str) -> list[int]:
        """Numbers of the folders that a run has of a table."""
        return [int(n.split("=")[1]) for n in names_in(self.spark, f"{self.folder}/{run}/{part}") if "=" in n]

    def _write(self, run: str, part: str, df: DataFrame) -> None:
        # Ranges and buckets are folders, so that a later batch reads only those it touches.
        if part != "titles":
            df = df.withColumn("bucket", self._bucket(self._KEYS[part]))
        by = "range_no" if part == "titles" else "bucket"
        df.repartition(by).write.mode("overwrite").partitionBy(by).parquet(f"{self.folder}/{run}/{part}")

    def _bucket(self, c: str) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(self.buckets)).cast("int")

    def _looked_up(self, part: str, wanted: DataFrame, only: list[int] | None = None) -> DataFrame:
        """Records of a table whose key is among ``wanted`` (one column), from the buckets that these lie in."""
        key = self._KEYS[part]
        wanted = wanted.toDF(key).distinct()
        if only is None:
            only = [r[0] for r in wanted.select(self._bucket(key).alias("b")).distinct().collect()]  # at most the buckets
        return self._read(part, only).join(wanted, key, "left_semi").drop("bucket")

    def merge(self, batch: DataFrame, *, trusted: bool = False) -> DataFrame:
        """(row_id, first_row_id) for the batch rows (from ``take_apart``) that repeat an earlier row.

        Accepts the batch.  The cost follows the batch: of the accepted titles only the touched key ranges are
        read, of keys and links only the touched buckets.  With ``trusted`` like titles within the batch, a
        list of different plans, are not compared.  What is written before the state counts only after it.
        """
        self.touched = {}
        number = self.made + 1
        run = f"run-{number:09d}"
        # One record a title; hot titles are aggregated before they move.
        sigs = cut(batch.where("sig <> ''").groupBy("sig", "other").agg(F.min("row_id").alias("node")))
        if self.points is None:
            self._aim(sigs)
        for part, df in (("titles", _keyed(sigs, self.points)), ("blocks", blocked(sigs)), ("sigs", sigs)):
            self._write(run, part, df)
        found = []
        if self.runs or not trusted:
            new = F.lit(not trusted)
            near = self._of_run(run, "titles").withColumn("fresh", new)
            if self.runs:
                near = near.unionByName(self._read("titles", self._folders(run, "titles")).withColumn("fresh", F.lit(False)))
            pairs = cut(window_pairs(near))
            blocks, known = self._of_run(run, "blocks").drop("bucket"), sigs.select("node", "sig")
            near = blocks.withColumn("fresh", new)
            if self.runs:
                held = self._looked_up("blocks", blocks.select("block"), self._folders(run, "blocks"))
                near = near.unionByName(held.withColumn("fresh", F.lit(False)))
                known = known.unionByName(self._looked_up("sigs", held.select("node")).select("node", "sig"))
            found = [pairs, block_pairs(near, known, pairs)]

        # Exact keys: a row is tied to the least row of its id, page and title, accepted ones included.
        long = batch.select("row_id", F.explode(F.array("k_id", "k_page", "k_sig")).alias("k")).where("k is not null")
        mine = long.groupBy("k").agg(F.min("row_id").alias("m"), F.count("*").alias("n"))
        if self.runs:
            mine = cut(mine)
            accepted = self._looked_up("keys", mine.select("k")).groupBy("k").agg(F.min("node").alias("old"))
            mine = mine.join(accepted, "k", "left")
            found.append(mine.where("old <> m").select("m", "old"))
        else:
            mine = mine.withColumn("old", F.lit(None).cast("bigint"))
        # A plan of which some key is new still has its rows tied to the least of the batch.
        links = long.join(mine.where("n > 1").select("k", "m"), "k").where("row_id <> m").select("row_id", "m")
        for f in found:
            links = links.union(f)
        links = normal(links)
        roots = components(self._with_earlier(links) if self.runs else links, is_normal=True)
        self._write(run, "links", roots.toDF("a", "b"))
        self._write(run, "keys", mine.where("old is null").select("k", F.col("m").alias("node")))
        self.titles += sigs.count() if self.runs else 0
        self.runs, self.made = [*self.runs, run], number
        self._commit()
        discard(sigs)
        if len(self.runs) > self.max_runs:
            self.compact()
        return batch.select("row_id").join(roots, F.col("row_id") == F.col("node")).select("row_id", F.col("root").alias("first_row_id")).distinct()

    def _aim(self, sigs: DataFrame) -> None:
        """Cuts the ranges at quantiles of a bounded sample, and sets the number of buckets, for these titles."""
        self.titles = sigs.count()
        self.points = _cut_points(bounded_sample(sigs, "sig", max(SAMPLE_TITLES, min(16 * MAX_RANGES, 16 * self.titles // RANGE_RECORDS)), self.titles), self.titles)
        self.buckets = max(LEAST_BUCKETS, -(-8 * self.titles // BUCKET_KEYS))

    def _with_earlier(self, links: DataFrame) -> DataFrame:
        """``links`` with the accepted links that lead on from the nodes they touch, step by step."""
        at, parts = links.select(F.explode(F.array("a", "b")).alias("a")), [links]
        while True:
            step = cut(self._looked_up("links", at).select("a", "b"))
            if step.isEmpty():
                break
            parts.append(step)
            at = step.select("b")
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.distinct() if len(parts) > 1 else out

    def compact(self) -> None:
        """All runs as one, with ranges and buckets cut anew for what the store has grown to, links resolved."""
        sigs, blocks, keys = self._read("sigs").drop("bucket"), self._read("blocks").drop("bucket"), self._read("keys").drop("bucket")
        links, old = components(self._read("links")), self.runs
        sigs = cut(sigs.groupBy("sig", "other").agg(F.min("node").alias("node")))
        self._aim(sigs)
        self.made += 1
        run = f"run-{self.made:09d}"
        for part, df in {"titles": _keyed(sigs, self.points), "blocks": blocks.join(sigs.select("node"), "node", "left_semi"), "keys": keys, "sigs": sigs, "links": links.toDF("a", "b")}.items():
            self._write(run, part, df)
        self.runs = [run]
        self._commit()
        discard(sigs)
        for r in old:
            delete(self.spark, f"{self.folder}/{r}")

    def members(self) -> DataFrame:
        """(row_id, first_row_id) of all accepted rows that repeat an earlier one, as known now: rows whose
        plan a later batch tied to an older one are given that one's first row."""
        if not self.runs:
            return self.spark.createDataFrame([], "row_id bigint, first_row_id bigint")
        if len(self.runs) == 1:  # resolved
            return self._read("links").select(F.col("a").alias("row_id"), F.col("b").alias("first_row_id"))
        return components(self._read("links")).toDF("row_id", "first_row_id")


def repeats_by_batches(spark: SparkSession, history: DataFrame, batches: list[DataFrame], *, folder: str | None = None) -> DataFrame:
    """(row_id, first_row_id) for every row that repeats an earlier one of ``history`` or of the batches, which
    are merged in order into a store that starts with the history.  All come from ``take_apart``."""
    store = RunStore(spark, folder or shared_dir(spark))
    store.merge(history, trusted=True)
    for b in batches:
        store.merge(b)
    return store.members()


def new_store(spark: SparkSession, max_runs: int = 6) -> RunStore:
    return RunStore(spark, shared_dir(spark), max_runs)
