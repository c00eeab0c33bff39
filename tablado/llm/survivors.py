"""The best representative of each group of duplicates, field by field.

Competing values are ranked by completeness, trust and recency, with the least key as the last tie-break.
The ranking is the window ordering of that tuple with its top row kept; it is computed as one maximum over an
ordering struct, which combines on the map side, where a window would bring a hot group into one task.

Defined results
    * Only usable values compete; a field without one has no row.
    * With ``dominant`` a winner must reach the group's best completeness, best trust and best recency at
      once; where no row does, the field has no row.  Without it the first of the ranking wins.
    * NULL trust counts as 0, NULL recency as the oldest.  Repeated rows are ties.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablado.llm.content import Model
from tablado.llm.encoding import fold, repair

# Texts that say there is no description yet, without accents and end signs.
NO_DESCRIPTION = {
    "sin descripcion", "proximamente", "mas informacion en breve", "mas informacion proximamente", "descripcion no disponible", "no disponible", "pendiente",
    "descripcion pendiente", "por confirmar", "en breve", "muy pronto", "coming soon", "no description", "no description available", "more information soon", "tba", "tbc", "n/d", "n/a",
}
# Words for free entry.
FREE = re.compile(r"\b(?:gratis|gratuit[oa]s?|entrada libre|acceso libre|libre|free|sin coste|invitacion)\b")


_PLAIN = re.compile("[A-Za-z0-9]+")
_LONGEST = max(map(len, NO_DESCRIPTION))


def usable_text(text: str) -> bool:
    """Whether a main text says something: no bare sign and no notice that there is no description yet."""
    if sum(map(len, _PLAIN.findall(text, 0, 4 * _LONGEST))) > _LONGEST:  # longer than every notice, however it is folded
        return True
    t = fold(text).strip(" .…!¡-–—*•[]()")
    return len(re.sub(r"[\W_]", "", t)) >= 2 and t not in NO_DESCRIPTION


def states_price(text: str | None) -> bool:
    """Whether a price states an amount or free entry."""
    return bool(text) and (bool(re.search(r"\d", text)) or bool(FREE.search(fold(repair(text)[1]))))


MEASURED = "length int, priced boolean"


def measured(titles: pd.Series, descriptions: pd.Series, prices: pd.Series, model: Model) -> pd.DataFrame:
    """(length, priced) of a batch of rows: characters of the main text, NULL if it says nothing, and whether
    the price states one."""
    lengths = []
    for t, x in zip(titles, descriptions, strict=True):
        text = model.main_text(x, t)
        lengths.append(len(text) if text and usable_text(text) else None)
    return pd.DataFrame({"length": pd.array(lengths, dtype="Int32"), "priced": [states_price(p) for p in prices]}, index=titles.index)


#: The most bits of a sieve (16 MB, sent with the function) and the bits for each key that are aimed at.
SIEVE_BITS, BITS_A_KEY = 1 << 27, 16


class Sieve:
    """Lets all rows through whose key is in a set, and few others, so that their texts are read but not joined.

    A bit for each hash of a key; beyond ``SIEVE_BITS`` / ``BITS_A_KEY`` keys more rows pass, none is lost.
    """

    def __init__(self, keys: DataFrame) -> None:
        name = keys.columns[0]
        wanted = BITS_A_KEY * max(64, keys.count())
        self.bits = min(SIEVE_BITS, 1 << (wanted - 1).bit_length())
        at = keys.select(self.place(name).alias("h"))
        words = at.groupBy(F.shiftright("h", 6).alias("w")).agg(F.bit_or(F.expr("shiftleft(1L, cast(h & 63 as int))")).alias("b")).toPandas()
        self.words = np.zeros(self.bits >> 6, dtype=np.int64)
        self.words[words["w"].to_numpy(dtype=np.int64)] = words["b"].to_numpy(dtype=np.int64)

    def place(self, key: str) -> Column:
        return F.xxhash64(key).bitwiseAND(F.lit(self.bits - 1))

    def passes(self, places: np.ndarray) -> np.ndarray:
        return (self.words[places >> 6] >> (places & 63)) & 1 == 1


def measured_rows(rows: DataFrame, keys: DataFrame, measure: Callable[[pd.DataFrame], pd.DataFrame], schema: str, keep: list[str]) -> DataFrame:
    """(row_id, ``keep``, ``schema``) of the rows whose row_id is in ``keys`` (one column) and of few others.

    ``measure`` gives the columns of ``schema`` for a batch; no text is moved.
    """
    sieve = Sieve(keys)
    kinds = {"int": pa.int32(), "boolean": pa.bool_()}
    made = [(n, kinds[k]) for n, k in (x.split() for x in schema.split(","))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some = b.filter(pa.array(sieve.passes(b.column("__at").to_numpy())))
            if some.num_rows:
                values = measure(some.drop_columns(["__at", *keep]).to_pandas())
                yield pa.RecordBatch.from_arrays([some.column(c) for c in ("row_id", *keep)] + [pa.array(values[n], kind, from_pandas=True) for n, kind in made], ["row_id", *keep, *(n for n, _ in made)])

    kept = "".join(f", `{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)
    return rows.withColumns({"row_id": F.col("row_id").cast("bigint"), "__at": sieve.place("row_id")}).mapInArrow(run, f"row_id bigint{kept}, {schema}")


def best_values(candidates: DataFrame, group: str, field: str, key: str, rank: list[Column], *, dominant: bool = True) -> DataFrame:
    """(group, field, key): the row whose value wins, of rows that compete for (group, field).

    ``rank`` lists what to compare, the most important first; higher is better.
    """
    names = [f"r{i}" for i in range(len(rank))]
    rows = candidates.select(F.col(group).alias("g"), F.col(field).alias("f"), F.col(key).alias("k"), *[r.alias(n) for n, r in zip(names, rank, strict=True)])
    top = F.max(F.struct(*names, (-F.col("k")).alias("k"))).alias("top")
    best = rows.groupBy("g", "f").agg(top, *[F.max(n).alias(n) for n in names])
    if dominant:
        for n in names:
            best = best.where(F.col(f"top.{n}") == F.col(n))
    return best.select(F.col("g").alias(group), F.col("f").alias(field), (-F.col("top.k")).alias(key))
