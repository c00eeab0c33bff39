"""Several values packed in one field: one value per row with its position kept.

The delimiters are inferred for each source.  Every candidate (punctuation sign, line break, linking word)
is scored on how consistent the number of pieces is and how regular their type is, against what all
sources show; a source's accepted candidates then split its fields.  A name that holds a delimiter stays
whole where it is enclosed in quotes or where it is a complete known name.

Scale: fields are made distinct by source first, so a field's copies are split once; known names are
looked up by a join on the spans a field could hold, so nothing is broadcast and no group is collected.

Defined results
    * NULL, empty and blank fields, and fields of delimiters only, give no row.
    * A single value gives one row, position 1; repeated values keep their positions.
    * Enclosing quotes, brackets round the whole field and outer blanks are dropped; a doubled or
      escaped quote inside an enclosed value stands for one.  Spelling is kept.
    * NULL sources are one source of their own.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablado.io import cut

# Candidate delimiters.
SIGNS = ["+", "/", ",", "|", ";", "&", "·", "•", "×", "\n", "\t", "\\", "‖", "¦", "●", "▪", "►", "→", "*", "~", "_"]
#: Signs that occur inside words and so count only between blanks.
SPACED = ["-", "–", "—", ":", "x"]
LINKS = ["y", "e", "and", "con", "with", "feat.", "feat", "ft.", "ft", "featuring", "vs.", "vs", "junto a", "junto con", "más", "plus", "además de", "invitado", "invitados", "special guest"]
QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»", "‘": "’", "„": "“", "‹": "›"}
BRACKETS = {"[": "]", "(": ")", "{": "}"}

_SEPARATOR = re.compile(
    r"\s*(?:(?P<sign>[" + "".join(map(re.escape, SIGNS)) + r"]|\r\n?)|(?<=\s)(?P<spaced>[" + "".join(map(re.escape, SPACED)) + r"])(?=\s)"
    r"|(?<=\s)(?P<link>" + "|".join(re.escape(x).replace(r"\ ", r"\s+") for x in sorted(LINKS, key=len, reverse=True)) + r")(?=\s))",
    re.IGNORECASE,
)
_SHAPE = re.compile(r"^[^\W\d_]?['’]?(?:[A-ZÁÉÍÓÚÜÑÂÊÔÃÕÇÅØÖÄ¡¿\d].{0,60}|[^\s]+(?:\s+[^\s]+){0,4})$")


def delimiter_of(text: str) -> str:
    """The canonical form of a matched separator."""
    t = re.sub(r"\s+", " ", text.strip(" ")).lower()
    return "\n" if t.strip() == "" and ("\n" in text or "\r" in text) else t.strip() or " "


def _inner(text: str) -> tuple[int, int]:
    """Bounds of the field without outer blanks and without one bracket pair round the whole."""
    a, b = 0, len(text)
    while a < b and text[a].isspace():
        a += 1
    while b > a and text[b - 1].isspace():
        b -= 1
    close = BRACKETS.get(text[a]) if b - a >= 2 else None
    if close and text[b - 1] == close:
        depth = 0
        for i in range(a, b):
            depth += (text[i] == text[a]) - (text[i] == close)
            if depth == 0 and i < b - 1:
                break
        else:
            a, b = a + 1, b - 1
            while a < b and text[a].isspace():
                a += 1
            while b > a and text[b - 1].isspace():
                b -= 1
    return a, b


def _quoted(text: str, at: int, end: int) -> tuple[str, int] | None:
    """The value enclosed in quotes that starts at ``at`` and the place after it, if a delimiter or the end follows."""
    close = QUOTES[text[at]]
    out, i = [], at + 1
    while i < end:
        c = text[i]
        if c == "\\" and i + 1 < end and text[i + 1] in (close, text[at], "\\"):
            out.append(text[i + 1])
            i += 2
        elif c == close:
            if i + 1 < end and text[i + 1] == close and close == text[at]:
                out.append(close)
                i += 2
                continue
            j = i + 1
            while j < end and text[j] in "  ":
                j += 1
            if j >= end or ((m := _SEPARATOR.match(text, i + 1, end)) and m.end() > i + 1):
                return "".join(out).strip(), i + 1
            if close != text[at] or close == "'":
                out.append(c)
                i += 1
                continue
            return None
        else:
            out.append(c)
            i += 1
    return None


def atoms(text: str) -> list[tuple[int, int, str | None, str]]:
    """Pieces between all candidate delimiters: (start, end, enclosed value or None, delimiter after it)."""
    a, end = _inner(text)
    out, i, start = [], a, a
    fresh = True
    while i < end:
        if fresh and text[i] in QUOTES and (q := _quoted(text, i, end)):
            value, after = q
            m = _SEPARATOR.match(text, after, end)
            out.append((i, after, value, delimiter_of(m.group()) if m else ""))
            i = start = m.end() if m else end
            while i < end and text[i] == " ":
                i += 1
            start = i
            continue
        m = _SEPARATOR.match(text, i, end)
        if m and m.end() > i:
            out.append((start, i, None, delimiter_of(m.group())))
            i = m.end()
            while i < end and text[i] in "  ":
                i += 1
            start, fresh = i, True
            continue
        fresh = False
        i += 1
        if i < end and text[i - 1] in "  " and text[i] in QUOTES and start == i:
            fresh = True
    if start < end:
        out.append((start, end, None, ""))
    return out


def known_form(c: Column) -> Column:
    """What two spellings of a complete name have in common: blanks and case set aside."""
    return F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))


def assemble(text: str, pieces: list[tuple], whole: list[tuple[int, int]], accepted: set[str]) -> list[str]:
    """The values of a field; ``whole`` are spans of atoms that are one known name."""
    inside = {}
    for i, j in sorted(whole, key=lambda s: (s[0] - s[1], s[0])):
        if not any(k in inside for k in range(i, j + 1)):
            inside.update(dict.fromkeys(range(i, j + 1), j))
    out, i = [], 0
    while i < len(pieces):
        j = inside.get(i, i)
        if j == i and pieces[i][2] is not None:
            value = pieces[i][2]
        else:
            # Delimiters that the source does not use are part of the value.
            while pieces[j][3] and pieces[j][3] not in accepted and j + 1 < len(pieces) and (j == i or (i, j) not in whole):
                j = inside.get(j + 1, j + 1)
            value = text[pieces[i][0] : pieces[j][1]].strip()
        if value:
            out.append(value)
        i = j + 1
    return out


def _atomise(texts: pd.Series) -> pd.Series:
    return texts.map(lambda t: [{"start": s, "end": e, "quoted": q, "delimiter": d} for s, e, q, d in atoms(t)] if t else [])


def infer_delimiters(pieces: DataFrame, *, prior: float = 20.0, least: float = 0.45) -> DataFrame:
    """(source, delimiter, score, accepted) for every source and candidate seen in it.

    ``pieces`` has source, field, delimiter, regular (share of the neighbouring pieces that look like or
    are a name) and n_pieces.  Score = smoothed regularity x consistency of the piece count, where the
    smoothing weighs ``prior`` fields of all sources.
    """
    per = pieces.groupBy("source", "delimiter").agg(
        F.count("*").alias("n"), F.sum("regular").alias("regular"), F.avg("n_pieces").alias("mean"), F.coalesce(F.stddev_pop("n_pieces"), F.lit(0.0)).alias("spread")
    )
    every = pieces.groupBy("delimiter").agg((F.sum("regular") / F.count("*")).alias("usual"))
    score = (F.col("regular") + prior * F.col("usual")) / (F.col("n") + prior) * (0.5 + 0.5 / (1 + F.col("spread") / F.col("mean")))
    return per.join(every, "delimiter").select("source", "delimiter", "n", score.alias("score"), (score >= least).alias("accepted"))


def split_values(
    df: DataFrame, field: str, key: str, *, source: str | None = None, known: DataFrame | None = None, position: str = "item_pos", item: str = "item"
) -> DataFrame:
    """(key, position, item): one row per value in ``field``.

    ``known`` is a one-column table of complete names.  Rows that repeat a key with another field give
    the values of each.  See the module for the defined results.
    """
    src = F.col(f"`{source}`") if source else F.lit(None)
    rows = df.select(F.col(f"`{key}`").alias("k"), F.coalesce(src.cast("string"), F.lit("")).alias("source"), F.col(f"`{field}`").alias("field")).where(F.trim("field") != "")
    fields = rows.select("source", "field").distinct()
    atomise = F.pandas_udf(_atomise, "array<struct<start:int,end:int,quoted:string,delimiter:string>>")
    # Read four times below, so it is taken apart once.
    fields = cut(fields.withColumn("atoms", atomise("field")))

    if known is not None:
        names = known.select(known_form(F.col(f"`{known.columns[0]}`")).alias("name")).where(F.col("name") != "").distinct()
        # A known name of s atoms needs spans of up to s atoms only; s comes from all names.
        longest = names.select(F.size(atomise("name")).alias("s")).agg(F.max("s")).first()[0] or 1
        spans = (
            fields
            .withColumn("i", F.explode(F.sequence(F.lit(0), F.greatest(F.size("atoms") - 1, F.lit(0)))))
            .withColumn("j", F.explode(F.sequence(F.col("i"), F.least(F.size("atoms") - 1, F.col("i") + F.lit(longest - 1)))))
            .where((F.col("j") >= F.col("i")) & (F.size("atoms") > 0))
            .select("source", "field", "i", "j", known_form(F.expr("coalesce(if(i = j, atoms[i].quoted, null), substring(field, atoms[i].start + 1, atoms[j].end - atoms[i].start))")).alias("name"))
        )
        found = spans.join(names, "name", "left_semi").groupBy("source", "field").agg(F.collect_set(F.struct("i", "j")).alias("whole"))
        fields = fields.join(found, ["source", "field"], "left")
    else:
        fields = fields.withColumn("whole", F.lit(None).cast("array<struct<i:int,j:int>>"))

    # Type regularity: a piece is a complete known name or has the shape of one.
    shape = F.pandas_udf(lambda s: s.map(lambda t: bool(_SHAPE.match(t.strip())) if t else True), "boolean")
    pieces = (
        fields.select("source", "field", "whole", F.size("atoms").alias("n_pieces"), F.posexplode("atoms").alias("i", "a"))
        .where(F.col("a.delimiter") != "")
        .select("source", "n_pieces", F.col("a.delimiter").alias("delimiter"), F.coalesce(F.col("a.quoted"), F.expr("substring(field, a.start + 1, a.end - a.start)")).alias("text"), F.exists(F.coalesce("whole", F.array().cast("array<struct<i:int,j:int>>")), lambda w: (w["i"] == F.col("i")) & (w["j"] == F.col("i"))).alias("is_known"))
        .withColumn("regular", F.when(F.col("is_known") | shape("text"), 1.0).otherwise(0.0))
    )
    accepted = infer_delimiters(pieces).where("accepted").groupBy("source").agg(F.collect_set("delimiter").alias("accepted"))

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            b["items"] = [
                assemble(t, [(p["start"], p["end"], p["quoted"], p["delimiter"]) for p in a], [(w["i"], w["j"]) for w in (whole if whole is not None else [])], set(ok if ok is not None else []))
                for t, a, whole, ok in zip(b["field"], b["atoms"], b["whole"], b["accepted"], strict=True)
            ]
            yield b[["source", "field", "items"]]

    split = fields.join(accepted, "source", "left").select("source", "field", "atoms", "whole", "accepted").mapInPandas(finish, "source string, field string, items array<string>")
    out = rows.join(split, ["source", "field"]).select(F.col("k").alias(key), F.posexplode("items").alias("pos", "v"))
    return out.select(key, (F.col("pos") + 1).cast("int").alias(position), F.col("v").alias(item)).distinct()


def delimiter_report(df: DataFrame, field: str, *, source: str) -> DataFrame:
    """(source, delimiter, n, score, accepted) as inferred from ``field`` by shape alone."""
    atomise = F.pandas_udf(_atomise, "array<struct<start:int,end:int,quoted:string,delimiter:string>>")
    shape = F.pandas_udf(lambda s: s.map(lambda t: bool(_SHAPE.match(t.strip())) if t else True), "boolean")
    fields = df.select(F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("source"), F.col(f"`{field}`").alias("field")).where(F.trim("field") != "").distinct()
    pieces = (
        fields.withColumn("atoms", atomise("field"))
        .select("source", "field", F.size("atoms").alias("n_pieces"), F.explode("atoms").alias("a"))
        .where(F.col("a.delimiter") != "")
        .select("source", "n_pieces", F.col("a.delimiter").alias("delimiter"), F.coalesce(F.col("a.quoted"), F.expr("substring(field, a.start + 1, a.end - a.start)")).alias("text"))
        .withColumn("regular", F.when(shape("text"), 1.0).otherwise(0.0))
    )
    return infer_delimiters(pieces)
