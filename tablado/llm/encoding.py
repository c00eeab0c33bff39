"""Garbled text from wrong character decoding: find it and restore what was not lost.

Characters are mapped back to the bytes of the legacy encoding that may have read them, a byte automaton
finds the maximal well-formed multibyte UTF-8 spans among those bytes, and only those spans are decoded.
Passes repeat until nothing changes, for text that was damaged more than once.

Defined results
    * NULL and empty texts are not affected; they restore to themselves.
    * Letters that are meant (``SAUDAÇÃO``, ``Âmbar``) form no well-formed span and stay.
    * Damaged text whose case was changed later is decoded by the bytes of the other case.
    * U+FFFD, and lone leading or trailing characters of a broken span inside a word, make a text affected
      and not restorable; the rest of such a text is restored all the same.
    * A lone C1 control stands for the cp1252 character of that byte.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Legacy encodings tried, in this order for equal evidence.
CODECS = ("cp1252", "mac_roman", "cp850", "cp437", "cp1251", "iso8859_15", "cp1250")
# Leading bytes of the characters that texts in Western languages use (Latin, punctuation,
# currency, arrows and symbols, presentation selectors, emoji).
LEADS = (0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xCB, 0xE2, 0xEF, 0xF0)
SCHEMA = "struct<affected:boolean,restored:string,lost:boolean>"


def _plausible(c: str) -> bool:
    o = ord(c)
    return 0xA0 <= o <= 0x17F or o in (0x192, 0x2C6, 0x2DC) or 0x2010 <= o <= 0x2064 or 0x20A0 <= o <= 0x20BF or 0x2100 <= o <= 0x27BF or o in (0xFE0F, 0xFEFF, 0xFFFD) or 0x1F000 <= o <= 0x1FAFF or 0x80 <= o <= 0x9F


def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte for the upper half of a codec; bytes it leaves open are read as C1 controls."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if codec == "cp1252":
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


class _Codec:
    """Well-formed spans under one codec; ``loose`` also reads a character as its other case."""

    def __init__(self, name: str, loose: bool) -> None:
        strict = _bytes_of(name)
        self.bytes: dict[str, list[int]] = {c: [b] for c, b in strict.items()}
        if loose:
            for c, b in strict.items():
                for other in {c.lower(), c.upper()} - {c}:
                    if len(other) == 1 and ord(other) > 127:
                        self.bytes.setdefault(other, []).append(b)
        leads = "".join(re.escape(c) for c, bs in self.bytes.items() if any(b in LEADS for b in bs))
        tails = "".join(re.escape(c) for c, bs in self.bytes.items() if any(0x80 <= b < 0xC0 for b in bs))
        tails += " " if name == "cp1252" else ""
        self.find = re.compile(f"[{leads}][{tails}]{{1,3}}")

    def _decode(self, chars: str) -> tuple[str, int] | None:
        """The longest well-formed character at the start of ``chars`` and how many characters it takes."""
        for lead in self.bytes.get(chars[0], ()):
            if lead not in LEADS:
                continue
            n = 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
            if n > len(chars):
                continue
            tails = [[b for b in ([0xA0] if c == " " else self.bytes.get(c, ())) if 0x80 <= b < 0xC0] for c in chars[1:n]]
            if not all(tails):
                continue
            # A blank stands for a no-break space only where the character is a letter with accent grave (C3 A0).
            if " " in chars[1:n] and not (lead == 0xC3 and n == 2):
                continue
            try:
                c = bytes([lead, *(t[0] for t in tails)]).decode("utf-8")
            except UnicodeDecodeError:
                continue
            if _plausible(c):
                return c, n
        return None

    def decode(self, text: str) -> tuple[str, int]:
        """``text`` with its well-formed spans decoded, and how many characters these had."""
        out, at, found = [], 0, 0
        while m := self.find.search(text, at):
            i = m.start()
            end = m.end()
            while i < end:
                if got := self._decode(text[i : i + 4]):
                    out.append(text[at:i] + got[0])
                    i += got[1]
                    at = i
                    found += got[1]
                    end = max(end, i)
                else:
                    i += 1
                    break
            if i > at:
                out.append(text[at:i])
                at = i
        out.append(text[at:])
        return "".join(out), found


_STRICT = [_Codec(c, False) for c in CODECS]
_LOOSE = [_Codec(c, True) for c in CODECS]
#: Any character that can start a span or is damage by itself.
_FIRST = "".join(sorted({c for x in _LOOSE for c, bs in x.bytes.items() if any(b in LEADS for b in bs)} | {"�"}))
_C1 = re.compile("[\x80-\x9f]")
_BROKEN = re.compile("�|(?<=[a-záéíóúñ])[ÃÂ√├┬]|[Ã√├┬](?=[a-záéíóúñ])|(?<=[^\\W\\d_])[±³©≠∫≥│║▒⌐∂∑‰¤](?=[^\\W\\d_])|ï¿½")
#: One character class, so that a clean text costs one scan: no affected text lacks all of these.
_QUICK = re.compile("[\x80-\x9f" + re.escape(_FIRST) + re.escape("±³©≠∫≥│║▒⌐∂∑‰¤") + "]")


def repair(text: str) -> tuple[bool, str, bool]:
    """(affected, restored text, whether something stays lost) of one text."""
    if not text or text.isascii() or not _QUICK.search(text):
        return False, text, False
    affected = False
    while True:  # every pass with a span makes the text shorter
        best = max((x.decode(text) for x in _STRICT), key=lambda r: r[1])
        if not best[1]:
            cased = text.lower() == text or text.upper() == text
            best = max((x.decode(text) for x in _LOOSE), key=lambda r: r[1]) if cased else best
        if not best[1]:
            break
        text, affected = best[0], True
    if _C1.search(text):
        affected = True
        text = _C1.sub(lambda m: m.group().encode("latin-1").decode("cp1252", "replace"), text)
    lost = bool(_BROKEN.search(text))
    return affected or lost, text, lost


def _repair_all(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([repair(t) if t is not None else (False, None, False) for t in s], columns=["affected", "restored", "lost"])


def repaired(c: Column) -> Column:
    """struct(affected, restored, lost) of a text column."""
    return F.pandas_udf(_repair_all, SCHEMA)(c)


def damaged_fields(df: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, original, restored, lost) of each affected field value, in one pass without a shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for f, name in enumerate(fields):
                for k, text in zip(b["k"], b[f"f{f}"], strict=True):
                    if text and not text.isascii() and _QUICK.search(text):
                        affected, restored, lost = repair(text)
                        if affected:
                            out.append((k, name, text, restored, lost))
            yield pd.DataFrame(out, columns=[key, "field_name", "original", "restored", "lost"])

    rows = df.select(F.col(f"`{key}`").alias("k"), *[F.col(f"`{f}`").alias(f"f{i}") for i, f in enumerate(fields)])
    kind = rows.schema["k"].dataType.simpleString()
    return rows.mapInPandas(run, f"`{key}` {kind}, field_name string, original string, restored string, lost boolean")


_MARKS = re.compile("[\u0300-\u036f]+")


def unaccented(text: str) -> str:
    """Lower case without accents."""
    t = text.lower()
    return t if t.isascii() else _MARKS.sub("", unicodedata.normalize("NFKD", t))


def fold(text: str) -> str:
    """Lower case without accents and with one kind of blank."""
    return " ".join(unaccented(text).split())
