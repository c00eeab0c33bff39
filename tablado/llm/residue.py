"""Template residue and error-page text found by retrieval of labelled exemplars.

Every passage window (a sentence, a line, an unfilled placeholder with what stands round it) retrieves
labelled exemplars through an inverted index of their words.  TF-IDF containment is measured both ways: how
much of the exemplar the window holds, and how much of the window the exemplar's family covers.  A window
with high coverage is residue unless exemplars of mere mention contain it better; a document with such a
window is excluded.

Document frequencies are counted over the whole corpus, without the sentences that many documents repeat: copies
of a notice would make its words light and the other words of its exemplars heavy.  Only words of at least ``COMMON_SHARE`` of the
documents are sent out (words per document / share at most), rarer ones share the greatest weight.

Defined results
    * NULL and empty texts are no case.  Repeated rows give one row.
    * Whole texts are read; case, accents, numbers and proper names are set aside.
    * Placeholders in running prose are residue; in prose that explains, quotes or names them they are not.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablado.io import cut
from tablado.llm.encoding import fold
from tablado.llm.labelled_residue import MENTIONS, RESIDUE

COMMON_SHARE = 0.001
COVERAGE, CONTAINMENT, MENTION = 0.55, 0.5, 0.5
#: A sentence is a copy from ``COMMON_SHARE`` of the documents on, and this number.
COPIES_LEAST = 10
# Small words, which alone don't make a window worth looking up.  Frequency can't tell: a notice
# copied into many documents makes all its words frequent.
SMALL = set(
    "a al and are as be by con de del e el en es esta este for from has have in is it la las lo los mas me mi no nos not o of on or our para pero por que se ser si sin sobre son su sus "
    "the this to tu u un una unas uno unos was we with y ya you your".split()
)
SLOT = "⟦slot⟧"
# Forms of unfilled placeholders.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,60}\}\}|\{%[^%\n]{0,60}%\}|<%[^%\n]{0,60}%>|[$#]\{[^{}\n]{0,60}\}|%%\w+%%|@@\w+@@|\[\[[^\[\]\n]{1,40}\]\]|\{[A-Za-z][A-Za-z0-9]*(?:[_.][A-Za-z0-9]+)*\}"
    r"|\b__[A-Z][A-Z0-9_]*__\b|(?<![\w:]):[A-Za-z]+(?:_[A-Za-z]+)+:(?!\w)|<[A-Za-zÁÉÍÓÚáéíóúñÑ]+(?: [A-Za-zÁÉÍÓÚáéíóúñÑ]+){1,5}>|\bX{2,}(?:[/-]X{2,})+\b|\b[A-Z]+(?:_[A-Z]+)*_PLACEHOLDER\b"
    r"|\[object Object\]|%\(\w+\)s|\[(?i:insert\w*|inserta\w*|tu|your|escrib\w*|añad\w*|nombre|texto|pendiente|todo|tbd|title|name|city)\b[^\[\]\n]{0,40}\]",
)
_MAY = re.compile(r"[{<%@_\[:X]")
_TOKEN = re.compile(r"⟦slot⟧|[^\W_]+")
_PATH = re.compile(r"(?:https?://|(?<!\S)/)\S+")
_SENTENCE = re.compile(r"(?<=[.!?…])\s+|\n+")
_QUOTED = re.compile(r"«[^»\n]{1,80}»|“[^”\n]{1,80}”|\"[^\"\n]{1,80}\"")
_NEAR = 60


def tokens(text: str) -> list[tuple[str, bool]]:
    """(folded word, whether it may be a proper name) of a window; numbers are left out, placeholders are slots."""
    shouted = text.upper() == text
    out = []
    for m in _TOKEN.finditer(_PATH.sub(" ", PLACEHOLDER.sub(f" {SLOT} ", text))):
        w = m.group()
        if w == SLOT:
            out.append((w, False))
        elif not w.isdigit():
            out.append((fold(w), w[0].isupper() and not shouted and m.start() > 0))
    return out


class Exemplars:
    """The inverted index of labelled sentences under given document frequencies."""

    def __init__(self, frequency: dict[str, int], documents: int) -> None:
        # No word weighs more than one that a single document of the corpus has.
        self.top = min(math.log(1 / COMMON_SHARE), math.log(max(documents, 2)))
        self.idf = {w: min(self.top, math.log(max(documents, 1) / n)) for w, n in frequency.items() if n > 0}
        self.idf[SLOT] = self.top
        self.families: dict[str, set[str]] = {}
        self.sentences: list[tuple[str, dict[str, float], float]] = []
        self.index: dict[str, list[int]] = {}
        for family, sentences in [*RESIDUE.items(), ("mention", MENTIONS)]:
            for s in sentences:
                words = {w: self.weight(w) for w, _ in tokens(s.replace("{name}", " "))}
                if not words:
                    continue
                self.families.setdefault(family, set()).update(words)
                self.sentences.append((family, words, sum(words.values())))
                for w in words:
                    self.index.setdefault(w, []).append(len(self.sentences) - 1)
        self.residue_words = set().union(*(v for k, v in self.families.items() if k != "mention"))
        self.telling = self.residue_words - SMALL

    def weight(self, w: str) -> float:
        return self.idf.get(w, self.top)

    def measure(self, window: str) -> tuple[float, float, float]:
        """(coverage, containment, mention) of a window: the best family's and the best mention's."""
        found = tokens(window)
        weights = {w: self.weight(w) for w, name in found if not (name and w not in self.residue_words)}
        total = sum(weights.values())
        if not total:
            return 0.0, 0.0, 0.0
        hits: dict[int, float] = {}
        for w, x in weights.items():
            for i in self.index.get(w, ()):
                hits[i] = hits.get(i, 0.0) + x
        coverage = containment = mention = 0.0
        for i, x in hits.items():
            family, _, mass = self.sentences[i]
            share = x / mass
            if family == "mention":
                mention = max(mention, share)
                continue
            if share >= CONTAINMENT or x / total >= COVERAGE:
                c = sum(y for w, y in weights.items() if w in self.families[family]) / total
                # A family covers no more than its best exemplar bears out.
                if (c, share) > (coverage, containment) and share >= 0.3:
                    coverage, containment = c, share
        return coverage, containment, mention

    def is_residue(self, window: str) -> bool:
        coverage, containment, mention = self.measure(window)
        words = sum(1 for _ in tokens(window))
        filler = coverage >= 0.8 and words >= 5
        return coverage >= COVERAGE and (containment >= CONTAINMENT or filler) and coverage > mention

    def windows(self, text: str) -> list[str]:
        return [s.strip() for s in _SENTENCE.split(text) if s.strip()]

    def found(self, text: str | None) -> str | None:
        """The first residue window of a text."""
        if not text or not text.strip():
            return None
        for s in self.windows(text):
            plain = s
            if _MAY.search(s) and PLACEHOLDER.search(s):
                # Quoted placeholders are mentioned; the others count unless the sentence explains them.
                bare = _QUOTED.sub(lambda m: " " if PLACEHOLDER.search(m.group()) and len(m.group()) < _NEAR else m.group(), s)
                if PLACEHOLDER.search(bare) and self.measure(s)[2] < MENTION:
                    return s
                plain = PLACEHOLDER.sub(" ", s)
            if not self.telling.isdisjoint(_TOKEN.findall(fold(plain))) and self.is_residue(_QUOTED.sub(" ", plain) if len(plain) > _NEAR else plain):
                return s
        return None


def _sentences(text: str) -> dict[int, set[str]]:
    """The words of each sentence, by a hash of them without numbers."""
    out = {}
    for s in _SENTENCE.split(text):
        if words := [w for w in _TOKEN.findall(fold(s)) if not w.isdigit()]:
            out[int.from_bytes(hashlib.blake2b(" ".join(words).encode(), digest_size=8).digest(), "big", signed=True)] = set(words)
    return out


def _copied_sentences(docs: DataFrame, text: str) -> set[int]:
    """Hashes of the sentences that many documents have: at most sentences-per-document / share."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[int, int] = {}
            for t in b["t"]:
                for h in _sentences(t):
                    seen[h] = seen.get(h, 0) + 1
            yield pd.DataFrame({"h": list(seen), "n": list(seen.values())}, dtype="int64")

    rows = docs.select(F.col(f"`{text}`").alias("t")).where("t <> ''")
    least = max(COPIES_LEAST, rows.count() * COMMON_SHARE)
    return {r.h for r in rows.mapInPandas(run, "h bigint, n bigint").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("h").collect()}


def count_words(docs: DataFrame, text: str) -> tuple[dict[str, int], int]:
    """Document frequencies of the common words of a corpus outside copied sentences, and its number of texts."""
    copied = _copied_sentences(docs, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            seen: dict[str, int] = {"": 0}
            for t in b["t"]:
                seen[""] += 1
                for w in set().union(*(words for h, words in _sentences(t).items() if h not in copied)):
                    seen[w] = seen.get(w, 0) + 1
            yield pd.DataFrame({"w": list(seen), "n": list(seen.values())})

    partial = docs.select(F.col(f"`{text}`").alias("t")).where("t <> ''").mapInPandas(run, "w string, n bigint")
    counts = cut(partial.groupBy("w").agg(F.sum("n").alias("n")).where("n > 0"))
    total = counts.where("w = ''").select("n").first()
    if not total:
        return {}, 0
    common = counts.where((F.col("w") != "") & (F.col("n") >= total.n * COMMON_SHARE)).collect()
    return {r.w: r.n for r in common}, total.n


def residue_documents(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, passage): every document in which residue stands in place of content, with the first such passage."""
    frequency, total = count_words(docs, text)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        exemplars = Exemplars(frequency, total)
        for b in batches:
            found = [exemplars.found(t) for t in b["t"]]
            out = pd.DataFrame({key: b["k"], "passage": found})
            yield out[out["passage"].notna()]

    rows = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"))
    found = rows.mapInPandas(run, f"`{key}` {rows.schema['k'].dataType.simpleString()}, passage string")
    return found.groupBy(key).agg(F.min("passage").alias("passage"))
