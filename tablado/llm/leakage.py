"""Evaluation passages that leaked into a corpus, wholly or in part and not always letter for letter.

Winnowing: of every sliding window of ``WINDOW`` hashes of ``GRAM`` words the least is kept, on both sides, so
that any run of GRAM + WINDOW - 1 = 6 equal words shares a fingerprint.  A passage of at least ``LEAST`` words
with up to one word in ten changed has such a run, so joining the fingerprints finds every one; each hit is
then extended along its diagonal and measured exactly.

Scale: up to ``MAX_BROADCAST`` fingerprints of items (some 50 MB with their texts) are sent to the tasks, and
whole texts are read, looked up and extended in one pass without a shuffle.  With more items fingerprints are
joined on their hash, and only documents with a hit are read a second time.

Defined results
    * NULL and empty texts and items, and items shorter than ``LEAST`` words, leak nothing.
    * Case, accents, punctuation, markup, entities and line breaks are set aside; hyphenation at a line's end too.
    * A span begins and ends with an equal word.  Repeated rows give one row.
"""

from __future__ import annotations

import html
import re
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tablado.io import cut

GRAM, WINDOW = 5, 2
LEAST, ONE_IN = 20, 10
MAX_BROADCAST = 500_000
_MARKUP = re.compile(r"<[a-zA-Z/!][^<>]*>")
_BREAK = re.compile(r"(?<=[^\W\d_])[-­]\s*\n\s*(?=[^\W\d_])|­")
_MARKS = re.compile("[̀-ͯ]+")
_WORD = re.compile(r"[^\W_]+")
_A = np.uint64(0x9E3779B97F4A7C15)
_B = np.uint64(0xBF58476D1CE4E5B9)


def words_of(text: str | None) -> list[str]:
    """The words of a text with everything else set aside."""
    if not text:
        return []
    if "&" in text:
        text = html.unescape(text)
    text = _BREAK.sub("", _MARKUP.sub(" ", text).lower())
    if not text.isascii():
        text = _MARKS.sub("", unicodedata.normalize("NFKD", text))
    return _WORD.findall(text)


class _Coder:
    """Words as 64-bit numbers, the same on every machine."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def __call__(self, words: list[str]) -> np.ndarray:
        memo = self.memo
        if len(memo) > 500_000:
            memo.clear()
        out = np.empty(len(words), dtype=np.uint64)
        for i, w in enumerate(words):
            if (h := memo.get(w)) is None:
                b = w.encode()
                h = memo[w] = zlib.crc32(b) << 32 | zlib.crc32(b, 0x5BD1E995)
            out[i] = h
        return out


def grams(codes: np.ndarray) -> np.ndarray:
    """A mixed 64-bit hash of every run of ``GRAM`` words."""
    n = len(codes) - GRAM + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    h = np.zeros(n, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for k in range(GRAM):
            h = h * _A + codes[k : k + n]
        h ^= h >> np.uint64(31)
        h *= _B
        h ^= h >> np.uint64(29)
    return h


def winnow(hashes: np.ndarray) -> np.ndarray:
    """Places of the kept hashes: the last least one of every window; all of them in a shorter text."""
    n = len(hashes) - WINDOW + 1
    if n <= 0:
        return np.arange(len(hashes))[-1:] if len(hashes) else np.empty(0, dtype=np.int64)
    best = np.arange(n)
    for k in range(1, WINDOW):
        at = np.arange(n) + k
        best = np.where(hashes[at] <= hashes[best], at, best)
    return np.unique(best)


def longest_span(doc: np.ndarray, item: np.ndarray, shift: int) -> int:
    """The longest run of item words on a diagonal (doc place - item place = shift) of which at most one in
    ``ONE_IN`` differs, beginning and ending with an equal word; 0 if shorter than ``LEAST``."""
    low, high = max(0, -shift), min(len(item), len(doc) - shift)
    if high - low < LEAST:
        return 0
    same = item[low:high] == doc[low + shift : high + shift]
    at = np.flatnonzero(same)
    if len(at) < LEAST - LEAST // ONE_IN:
        return 0
    # For ends i <= j of equal words, at most one word in ONE_IN differs if f[j] <= f[i] + 1; the best start of
    # an end is the first place where the running greatest f reaches that.
    f = (ONE_IN - 1) * at - ONE_IN * np.arange(len(at))
    start = np.searchsorted(np.maximum.accumulate(f), f - 1)
    best = int((at - at[start]).max()) + 1
    return best if best >= LEAST else 0


def _fingerprints(df: DataFrame, key: str, text: str) -> DataFrame:
    """(key, h, at): the fingerprints of every text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = _Coder()
        for b in batches:
            keys, hashes, places = [], [], []
            for k, t in zip(b["k"], b["t"], strict=True):
                h = grams(code(words_of(t)))
                at = winnow(h)
                keys.append(np.full(len(at), k))
                hashes.append(h[at].view(np.int64))
                places.append(at)
            if keys:
                yield pd.DataFrame({key: np.concatenate(keys), "h": np.concatenate(hashes), "at": np.concatenate(places).astype(np.int32)}).astype({key: np.int64})

    rows = df.select(F.col(f"`{key}`").cast("bigint").alias("k"), F.col(f"`{text}`").alias("t")).where("k is not null and t <> ''")
    return rows.mapInPandas(run, f"`{key}` bigint, h bigint, at int")


class _Items:
    """Test items with their fingerprints in order, for a look-up of many hashes at once."""

    def __init__(self, items: list[tuple[int, str]]) -> None:
        code = _Coder()
        self.codes = [(i, code(words_of(t))) for i, t in items]
        prints = [(h[at].view(np.int64), n, at) for n, (_, c) in enumerate(self.codes) for h in [grams(c)] for at in [winnow(h)]]
        hashes = np.concatenate([p[0] for p in prints]) if prints else np.empty(0, dtype=np.int64)
        order = np.argsort(hashes, kind="stable")
        self.hashes = hashes[order]
        self.numbers = np.concatenate([np.full(len(p[0]), p[1]) for p in prints])[order] if prints else order
        self.places = np.concatenate([p[2] for p in prints])[order] if prints else order

    def leaks(self, words: np.ndarray) -> list[tuple[int, int]]:
        """(item, longest passage) of a document."""
        h = grams(words)
        at = winnow(h)
        own = h[at].view(np.int64)
        a, b = np.searchsorted(self.hashes, own, "left"), np.searchsorted(self.hashes, own, "right")
        met = np.flatnonzero(b > a)
        if not len(met):
            return []
        # One diagonal of an item a pair, however many fingerprints lie on it.
        n = b[met] - a[met]
        which = np.repeat(a[met], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        diagonals = {(int(i), int(s)) for i, s in zip(self.numbers[which], np.repeat(at[met], n) - self.places[which], strict=True)}
        best: dict[int, int] = {}
        for i, shift in diagonals:
            item, codes = self.codes[i]
            if (k := longest_span(words, codes, shift)) > best.get(item, 0):
                best[item] = k
        return list(best.items())


def _in_one_pass(docs: DataFrame, items: list[tuple[int, str]]) -> DataFrame:
    """(doc, item, n_words) of (doc, text) rows: fingerprints are looked up and hits extended where a text is read."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tests, code = _Items(items), _Coder()
        for b in batches:
            out = [(doc, *x) for doc, text in zip(b["doc"], b["text"], strict=True) for x in tests.leaks(code(words_of(text)))]
            yield pd.DataFrame(out, columns=["doc", "item", "n_words"])

    return docs.mapInPandas(run, "doc bigint, item bigint, n_words int")


def leaked_passages(docs: DataFrame, doc_key: str, doc_text: str, items: DataFrame, item_key: str, item_text: str) -> DataFrame:
    """(doc, item, n_words): every document that contains a passage of an item and the passage's length.

    Several spans of one item in one document count once, with the longest.
    """
    tests = _fingerprints(items.select(F.col(f"`{item_key}`").alias("item"), F.col(f"`{item_text}`").alias("text")), "item", "text")
    tests = tests.select("item", "h", F.col("at").alias("item_at")).distinct()
    wanted = items.select(F.col(f"`{item_key}`").cast("bigint").alias("item"), F.col(f"`{item_text}`").alias("item_text")).where("item is not null and item_text <> ''")
    texts = docs.select(F.col(f"`{doc_key}`").cast("bigint").alias("doc"), F.col(f"`{doc_text}`").alias("text")).where("doc is not null and text <> ''")
    if tests.limit(MAX_BROADCAST + 1).count() <= MAX_BROADCAST:
        found = _in_one_pass(texts, [(r.item, r.item_text) for r in wanted.distinct().collect()])
        return found.groupBy("doc", "item").agg(F.max("n_words").alias("n_words"))
    prints = _fingerprints(docs.select(F.col(f"`{doc_key}`").alias("doc"), F.col(f"`{doc_text}`").alias("text")), "doc", "text")
    # A diagonal a row: repeated hits of a pair on the same diagonal are one.
    hits = prints.join(tests, "h").select("doc", "item", (F.col("at") - F.col("item_at")).alias("shift")).distinct()
    hits = hits.groupBy("doc", "item").agg(F.collect_set("shift").alias("shifts"))  # at most a text's length
    # One row a pair of document and item, so that a document or an item with many hits is not brought together;
    # texts without a hit are left out before they are moved.
    pairs = cut(hits.join(wanted, "item"))
    texts = texts.join(pairs.select("doc").distinct(), "doc", "left_semi")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        code = _Coder()
        memo: dict[str, np.ndarray] = {}
        for b in batches:
            out = []
            for doc, item, text, item_text, shifts in zip(b["doc"], b["item"], b["text"], b["item_text"], b["shifts"], strict=True):
                words = code(words_of(text))
                if (codes := memo.get(item_text)) is None:
                    if len(memo) > 5_000:
                        memo.clear()
                    codes = memo[item_text] = code(words_of(item_text))
                if n := max(longest_span(words, codes, int(s)) for s in shifts):
                    out.append((doc, item, n))
            yield pd.DataFrame(out, columns=["doc", "item", "n_words"])

    found = texts.join(pairs, "doc").mapInPandas(extend, "doc bigint, item bigint, n_words int")
    return found.groupBy("doc", "item").agg(F.max("n_words").alias("n_words"))
