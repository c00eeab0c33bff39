"""Free-entered values mapped to a canonical list, with a report of those that mean no entry.

A symmetric-delete dictionary of the list (every name with up to ``MAX_EDITS`` letters left out) finds the
entries within a bounded edit distance of a value's readings; candidates are ranked by weighted
Damerau-Levenshtein distance and then by how often the table spells the entry exactly.

The dictionary is broadcast only when the list has at most ``MAX_BROADCAST_NAMES`` names (some 200 keys a
name, so under 200 MB); a longer list is matched by a join on the delete keys of the distinct values.

Defined results
    * NULL, ``''`` and values spelled exactly as an entry are no cases and give no row.
    * A value that means no entry, or several equally (a bare name that two kinds of place share), gives -1.
    * Case, accents, blanks, punctuation, order around a comma, appended places, addresses, dates and the
      given decorations are set aside; the kind of place and every number must agree.
    * Names that differ only in such things in the list itself are ambiguous and give -1.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from itertools import combinations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablado.llm.encoding import fold, repair

MAX_EDITS = 2
MAX_BROADCAST_NAMES = 5_000
# Kinds of place, as the first words of a venue's name.
KINDS = [
    "centro cultural", "auditorio", "biblioteca", "bar", "cafe", "carpa", "casa", "centro", "cine", "circulo", "club",
    "espacio", "estadio", "galeria", "jardin", "mercado", "museo", "nave", "pabellon", "palacio", "parque", "plaza",
    "sala", "salon", "taberna", "teatro",
]
# Abbreviated kinds of place, as written at the start of a name.
ABBREVIATIONS = {
    "tº": "teatro", "t.": "teatro", "tro.": "teatro", "pal.": "palacio", "aud.": "auditorio", "audit.": "auditorio",
    "c.c.": "centro cultural", "c. c.": "centro cultural", "cc": "centro cultural", "ctro. cultural": "centro cultural",
    "c. cultural": "centro cultural", "bibl.": "biblioteca", "esp.": "espacio", "mus.": "museo", "pque.": "parque",
    "pza.": "plaza", "sª": "sala", "s.": "sala",
}
_ABBREVIATED = re.compile(r"(^|[,;(]\s*)(" + "|".join(re.escape(a) for a in sorted(ABBREVIATIONS, key=len, reverse=True)) + r")(?=\s|$|[,;)])")
_DATE = re.compile(r"\b\d{1,4}[/.-]\d{1,2}[/.-]\d{1,4}\b|\b\d{1,2}[:.]\d{2}\s*h?\b")
_PARTS = re.compile(r"\s*[,;()\[\]|@·/]\s*|\s+[-–—:]+\s+")
_WORD = re.compile(r"[^\W_]+")


def edits_allowed(length: int) -> int:
    """How many edits a name of so many letters may have: one from 4 letters on, two from 8 on."""
    return 0 if length < 4 else 1 if length < 8 else MAX_EDITS


def deletes(word: str, most: int = MAX_EDITS) -> set[str]:
    """``word`` with up to ``most`` letters left out."""
    out = {word}
    if most == 1 and len(word) > 1:
        return out | {word[:i] + word[i + 1 :] for i in range(len(word))}
    for k in range(1, min(most, len(word) - 1) + 1):
        for at in combinations(range(len(word)), k):
            left = list(word)
            for i in reversed(at):
                del left[i]
            out.add("".join(left))
    return out


def weighted_distance(a: str, b: str, most: float) -> float:
    """Damerau-Levenshtein distance with cheaper doubled letters, swaps and vowels; beyond ``most``, infinity."""
    if abs(len(a) - len(b)) > most * 2 + 1:
        return float("inf")
    vowels = "aeiou"
    before, last = None, [0.0]
    for j in range(len(b)):
        last.append(last[-1] + (0.6 if j and b[j] == b[j - 1] else 1.0))
    for i, x in enumerate(a, 1):
        drop = 0.6 if i > 1 and x == a[i - 2] else 1.0
        row = [last[0] + drop]
        for j, y in enumerate(b, 1):
            add = 0.6 if j > 1 and y == b[j - 2] else 1.0
            change = 0.0 if x == y else 0.9 if x in vowels and y in vowels else 1.0
            best = min(last[j] + drop, row[j - 1] + add, last[j - 1] + change)
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y and x != y:
                best = min(best, before[j - 2] + 0.8)
            row.append(best)
        before, last = last, row
    return last[-1] if last[-1] <= most else float("inf")


def _compact(text: str) -> str:
    return "".join(_WORD.findall(text))


def _numbers(text: str) -> tuple[str, ...]:
    return tuple(re.findall(r"\d+", text))


_KIND = re.compile("(?:" + "|".join(KINDS) + ")(?= |$)")


def kind_of(folded: str) -> str:
    return m.group() if (m := _KIND.match(folded)) else ""


def readings(value: str, decorations: Iterable[str] = ()) -> list[str]:
    """Folded phrases a value may stand for, the fullest first."""
    text = " ".join(repair(value)[1].lower().split())
    text = _ABBREVIATED.sub(lambda m: m.group(1) + ABBREVIATIONS[m.group(2)], text)
    text = _DATE.sub(" ", fold(text).replace("_", " "))
    host = re.match(r"^(?:https?://)?(?:www\.|m\.)?([a-z0-9-]+)\.[a-z.]+(?:/\S*)?$", text.strip())
    if host:
        return [host.group(1).replace("-", " ")]
    parts = [" ".join(_WORD.findall(p)) for p in _PARTS.split(text)]
    parts = [p for p in parts if p]
    if not parts:
        return []
    out = [" ".join(_WORD.findall(text))]
    if len(parts) > 1:
        out += [f"{parts[1]} {parts[0]}", parts[0]]
    for phrase in (out[0], parts[0]):
        words = phrase.split()
        for d in decorations:
            n = len(d.split())
            tail = " ".join(words[-n:])
            if len(words) > n and (tail == d or weighted_distance(tail, d, 2.0 if len(d) >= 6 else 1.0) <= 2.0):
                out.append(" ".join(words[:-n]))
    return list(dict.fromkeys(out))


class Dictionary:
    """The symmetric-delete dictionary of (id, name) pairs; ``frequency`` breaks ties."""

    def __init__(self, names: list[tuple[int, str]], frequency: dict[int, int], decorations: Iterable[str] = (), kinds: bool = False) -> None:
        self.exact = {n for _, n in names}
        self.frequency, self.kinds, self.decorations = frequency, kinds, tuple(decorations)
        self.full: dict[str, set[int]] = {}
        self.bare: dict[str, set[int]] = {}
        self.folded: dict[int, str] = {}
        for i, n in names:
            f = fold(n)
            self.folded[i] = f
            self.full.setdefault(_compact(f), set()).add(i)
            if kinds and (k := kind_of(f)):
                self.bare.setdefault(_compact(f[len(k) :]), set()).add(i)
        self.deleted = {True: self._index(self.full), False: self._index(self.bare)}
        self.memo: dict[str, int] = {}

    @staticmethod
    def _index(names: dict[str, set[int]]) -> dict[str, set[str]]:
        out: dict[str, set[str]] = {}
        for n in names:
            for d in deletes(n, edits_allowed(len(n))):
                out.setdefault(d, set()).add(n)
        return out

    def near(self, phrase: str, full: bool) -> list[tuple[float, str]]:
        """(distance, name) of the names within the allowed edits of a phrase."""
        names = self.full if full else self.bare
        c = _compact(phrase)
        if c in names:
            return [(0.0, c)]
        most = edits_allowed(len(c))
        found = {n for d in deletes(c, most) for n in self.deleted[full].get(d, ())}
        return sorted((w, n) for n in found if _numbers(n) == _numbers(c) and (w := weighted_distance(c, n, min(most, edits_allowed(len(n))))) < float("inf"))

    def match(self, value: str) -> int:
        if value not in self.memo:
            if len(self.memo) > 200_000:
                self.memo.clear()
            self.memo[value] = self._match(value)
        return self.memo[value]

    def candidates(self, value: str) -> list[tuple[bool, float, int, int, int, str]]:
        """(bare, distance, reading, -frequency, id, folded form) of each entry that a value may mean, the best
        being the least; -1 stands for several entries of one bare name.  Bare names count after all full ones."""
        options = readings(value, self.decorations)
        out = []
        for rank, phrase in enumerate(options):
            for w, n in self.near(phrase, True):
                ids = self.full[n]
                if len(ids) > 1:
                    continue
                (i,) = ids
                # A kind that the value states must be the entry's kind, typing errors aside.
                if self.kinds and (k := kind_of(phrase)) and not (kind_of(self.folded[i]) + " ").startswith(k + " "):
                    continue
                out.append((False, w, rank, -self.frequency.get(i, 0), i, n))
        if self.kinds and not out:
            for rank, phrase in enumerate(options):
                if not kind_of(phrase):
                    for w, n in self.near(phrase, False):
                        ids = self.bare[n]
                        out.append((True, w, rank, 0, next(iter(ids)) if len(ids) == 1 else -1, n))
        return out

    def _match(self, value: str) -> int:
        return min(self.candidates(value), default=(True, 0.0, 0, 0, -1, ""))[4]


def _entries(catalog: DataFrame, key: str, name: str) -> DataFrame:
    return catalog.select(F.col(f"`{key}`").cast("bigint").alias("id"), F.col(f"`{name}`").alias("name")).where("id is not null and trim(name) <> ''").distinct()


def source_names(df: DataFrame, field: str, catalog: DataFrame, catalog_key: str, catalog_name: str) -> tuple[list[tuple[int, str]], dict[int, int]]:
    """The names of a list and how often ``field`` spells each exactly, for a ``Dictionary`` on the executors."""
    entries = _entries(catalog, catalog_key, catalog_name)
    spelled = df.select(F.col(f"`{field}`").alias("name")).groupBy("name").agg(F.count("*").alias("n"))
    rows = entries.join(spelled, "name", "left").collect()
    return sorted((r.id, r.name) for r in rows), {r.id: r.n or 0 for r in rows}


def map_values(
    df: DataFrame, key: str, field: str, catalog: DataFrame, catalog_key: str, catalog_name: str, *, decorations: list[str] | None = None, kinds: bool = False, ref: str = "ref_id", keep_exact: bool = False
) -> DataFrame:
    """(key, value, ref): the entry that each value of ``field`` means, -1 for none.

    With ``keep_exact`` values spelled exactly as an entry are returned too.
    """
    entries = _entries(catalog, catalog_key, catalog_name)
    rows = df.select(F.col(f"`{key}`").alias(key), F.col(f"`{field}`").alias("value")).where("value <> ''")
    if entries.limit(MAX_BROADCAST_NAMES + 1).count() > MAX_BROADCAST_NAMES:
        return _map_by_join(rows, key, entries, decorations or [], kinds, ref, keep_exact)
    names, frequency = source_names(rows, "value", catalog, catalog_key, catalog_name)
    if not keep_exact and names:
        rows = rows.where(~F.col("value").isin(*[n for _, n in names]))
    make = lambda: Dictionary(names, frequency, decorations or (), kinds)
    return rows.select(key, "value", _matcher(make)(F.col("value")).alias(ref))


def _matcher(make: Callable[[], Dictionary]) -> Callable[[Column], Column]:
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        d = make()  # once for a task
        for s in batches:
            yield s.map(d.match)

    run.__annotations__ = {"batches": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "bigint")


def _map_by_join(rows: DataFrame, key: str, entries: DataFrame, decorations: list[str], kinds: bool, ref: str, keep_exact: bool) -> DataFrame:
    """The same for a list too long to broadcast: delete keys are joined, and each distinct value is measured
    against the entries that any of its readings touches, one pair a row."""
    exact = entries.select(F.col("name").alias("value")).distinct()
    # How often the table spells each entry, before those rows are left out.
    frequency = rows.join(exact, "value", "left_semi").groupBy("value").agg(F.count("*").alias("n")).withColumnRenamed("value", "name")
    if not keep_exact:
        rows = rows.join(exact, "value", "left_anti")

    def keys(phrases: list[str], longest: int) -> list[str]:
        """Delete keys; a phrase longer than the longest name by more than the edits is near none."""
        return sorted({d for p in phrases if len(c := _compact(p)) <= longest + MAX_EDITS for d in deletes(c, edits_allowed(len(c)))})

    longest = entries.agg(F.max(F.length("name"))).first()[0] or 0  # folding can lengthen letters, at most threefold
    bound = 3 * longest

    def value_keys(s: pd.Series) -> pd.Series:
        return s.map(lambda v: keys(readings(v, decorations), bound))

    def name_keys(s: pd.Series) -> pd.Series:
        return s.map(lambda n: keys([f := fold(n), *([f[len(k) :]] if kinds and (k := kind_of(f)) else [])], bound))

    values = rows.select("value").distinct()
    v = values.select("value", F.explode(F.pandas_udf(value_keys, "array<string>")("value")).alias("k"))
    e = entries.select("id", "name", F.explode(F.pandas_udf(name_keys, "array<string>")("name")).alias("k"))
    near = v.join(e, "k").select("value", "id", "name").distinct().join(frequency, "name", "left")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = [(value, *c) for value, i, name, n in zip(b["value"], b["id"], b["name"], b["n"], strict=True) for c in Dictionary([(i, name)], {i: 0 if pd.isna(n) else int(n)}, decorations, kinds).candidates(value)]
            yield pd.DataFrame(out, columns=["value", "bare", "w", "rank", "n", "id", "form"])

    found = near.mapInPandas(measure, "value string, bare boolean, w double, rank int, n bigint, id bigint, form string")
    # Entries that share a folded form are ambiguous: as full names they are passed over, as bare ones they mean none.
    shared = entries.select("id", F.explode(F.pandas_udf(_forms(kinds), "array<struct<bare:boolean,form:string>>")("name")).alias("f")).select("f.bare", "f.form", "id").groupBy("bare", "form").agg(F.countDistinct("id").alias("ids"))
    told = found.join(shared, ["bare", "form"]).where("bare or ids = 1").withColumn("id", F.when(F.col("ids") > 1, F.lit(-1).cast("bigint")).otherwise(F.col("id")))
    best = F.min(F.struct("bare", "w", "rank", "n", "id"))
    meant = told.groupBy("value").agg(best.alias("b")).select("value", F.col("b.id").alias(ref))
    return rows.join(meant, "value", "left").select(key, "value", F.coalesce(ref, F.lit(-1).cast("bigint")).alias(ref))


def _forms(kinds: bool) -> Callable[[pd.Series], pd.Series]:
    def of(name: str) -> list[dict]:
        f = fold(name)
        return [{"bare": False, "form": _compact(f)}, *([{"bare": True, "form": _compact(f[len(k) :])}] if kinds and (k := kind_of(f)) else [])]

    return lambda s: s.map(of)


def url_sections(catalog: DataFrame, url: str) -> list[str]:
    """Names of the sections that listing pages lie in, from the last part of each url, as decorations."""
    last = F.regexp_replace(F.regexp_extract(F.col(f"`{url}`"), r"/([^/?#]+)/?(?:[?#].*)?$", 1), "[-_]+", " ")
    found = catalog.select(last.alias("s")).where("s <> ''").distinct().collect()  # at most one a source
    return sorted(fold(r.s) for r in found)
