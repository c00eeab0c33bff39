"""Mixed timestamp formats and time zones brought to one unambiguous form.

An ordered cascade of anchored patterns is tried on the folded text; the first that matches the whole
value decides, and its parts must form an existing day and time.  Everything is a native expression.

Defined results
    * NULL, empty and unreadable values, days that do not exist (31/02), times that do not exist (25:00),
      unknown zone names and values that name no full day ("julio 2026") give NULL.
    * A value with a day but no time gives the calendar day ``yyyy-MM-dd``; no zone is applied to it.
    * A value with a time gives the UTC instant ``yyyy-MM-ddTHH:mm:ss.SSSZ``; further digits are cut off.
    * Without a zone in the text the default zone applies.  ``nonexistent`` and ``ambiguous`` say what
      happens to local times that a clock change skips or repeats.
    * A day without year is the next such day counted from ``anchor``, that day included; without an
      anchor it gives NULL.
"""

from __future__ import annotations

from zoneinfo import available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Names of months and weekdays in Spanish and English, accents removed.
MONTH_NAMES = [
    ("enero", "ene", "january", "jan"),
    ("febrero", "feb", "february"),
    ("marzo", "mar", "march"),
    ("abril", "abr", "april", "apr"),
    ("mayo", "may"),
    ("junio", "jun", "june"),
    ("julio", "jul", "july"),
    ("agosto", "ago", "august", "aug"),
    ("septiembre", "setiembre", "sept", "sep", "set", "september"),
    ("octubre", "oct", "october"),
    ("noviembre", "nov", "november"),
    ("diciembre", "dic", "december", "dec"),
]
WEEKDAY_NAMES = [
    "lunes", "martes", "miercoles", "jueves", "viernes", "sabado", "domingo",
    "monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday",
    "lun", "mar", "mie", "jue", "vie", "sab", "dom",
    "mon", "tue", "tues", "wed", "thu", "thur", "thurs", "fri", "sat", "sun",
]
# Zone abbreviations and spoken zones.
ZONE_ALIASES = {
    "z": "+00:00", "utc": "+00:00", "gmt": "+00:00", "wet": "+00:00", "west": "+01:00",
    "cet": "+01:00", "cest": "+02:00",
    "hora canaria": "Atlantic/Canary", "hora de canarias": "Atlantic/Canary",
    "hora peninsular": "Europe/Madrid", "hora espanola": "Europe/Madrid", "hora local": "Europe/Madrid",
    "hora de madrid": "Europe/Madrid", "hora de espana": "Europe/Madrid",
}

_FOLD_FROM, _FOLD_TO = "áéíóúüàèìòùâêîôûäëïöñç", "aeiouuaeiouaeiouaeionc"
_MONTH = "|".join(sorted((n for names in MONTH_NAMES for n in names), key=len, reverse=True))
_WEEKDAY = "|".join(sorted(WEEKDAY_NAMES, key=len, reverse=True))
_LEAD = rf"^(?:(?:el )?(?:{_WEEKDAY})\.?,? )?"
_TAIL = rf"(?: ?[·,(|-]? ?(?:{_WEEKDAY})\.?\)?)?$"
_ZONE = r"(?: ?[\[(]?(z|utc|gmt|cest|cet|west|wet|(?:utc|gmt)?[+-]\d{1,2}(?::?\d{2})?|[a-z]+(?:/[a-z0-9_+-]+)+|hora (?:de )?[a-z]+)[\])]?)?"
_JOIN = r"(?:t|,? ?[-–·|@] ?|,? )(?:a las? |at |desde las? )?"
_CLOCK = (
    r"(\d{1,2})(?:[:.h](\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
    r"(?: ?(am|pm|a\.? ?m\.?|p\.? ?m\.?))?(?: ?h(?:oras?|rs?|s)?\.?)?| ?(am|pm|a\.m\.|p\.m\.|h(?:oras?|rs?|s)?\.?))"
)
_TIME = rf"(?:{_JOIN}{_CLOCK})?{_ZONE}"
_DAY = r"(\d{1,2})(?:º|\.º|st|nd|rd|th)?"

#: (pattern, group numbers of year, month, day); the time groups follow the three date groups.
_CASCADE = [
    (rf"{_LEAD}(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}}){_TIME}{_TAIL}", (1, 2, 3)),
    (rf"{_LEAD}(\d{{1,2}})[-/.](\d{{1,2}})[-/.](\d{{4}}|\d{{2}}){_TIME}{_TAIL}", (3, 2, 1)),
    (rf"{_LEAD}{_DAY}(?: de | |-)({_MONTH})\.?(?:(?:,? | del? |-)(\d{{4}}))?{_TIME}{_TAIL}", (3, 2, 1)),
    (rf"{_LEAD}({_MONTH})\.? {_DAY}(?:,? (\d{{4}}))?{_TIME}{_TAIL}", (3, 1, 2)),
]
_COMPACT = rf"^(\d{{4}})(\d{{2}})(\d{{2}})(?:[t ]?(\d{{2}}):?(\d{{2}})(?::?(\d{{2}})(?:[.,](\d{{1,9}}))?)?()())?{_ZONE}$"

#: Stands before the parts of a text that a pattern has read.
_MARK = "\x01"


def _int(c: Column) -> Column:
    return F.when(c != "", c.cast("int"))


def _month_number(c: Column) -> Column:
    """A month from digits or from the first three letters of its name, which tell all names apart."""
    heads = {name[:3]: number for number, names in enumerate(MONTH_NAMES, 1) for name in names}
    by_name = F.create_map(*[F.lit(x) for pair in heads.items() for x in pair])
    return F.when(c.rlike(r"^\d+$"), c.try_cast("int")).otherwise(by_name[F.substring(c, 1, 3)])


def _days_in(year: Column, month: Column) -> Column:
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(month.isin(4, 6, 9, 11), 30).when(month == 2, F.when(leap, 29).otherwise(28)).otherwise(31)


def _exists(year: Column, month: Column, day: Column) -> Column:
    return year.between(1, 9999) & month.between(1, 12) & (day >= 1) & (day <= _days_in(year, month))


def _zone_table(spark: SparkSession) -> DataFrame:
    """(lower-case name, zone) of the spoken zones and of every region; some 600 rows."""
    known = ZONE_ALIASES | {name.lower(): name for name in available_timezones() if "/" in name}
    return spark.createDataFrame(sorted(known.items()), "zone_text string, zone_name string")


def _zone(text: Column, default: Column, named: Column) -> Column:
    offset = F.regexp_extract(text, r"^(?:utc|gmt)?([+-]\d{1,2}(?::?\d{2})?)$", 1)
    hours = F.lpad(F.regexp_extract(offset, r"^[+-](\d{1,2})", 1), 2, "0")
    minutes = F.regexp_extract(offset, r"^[+-]\d{2}:?(\d{2})$", 1)
    minutes = F.when(minutes == "", "00").otherwise(minutes)
    fixed = F.when((hours.cast("int") * 60 + minutes.cast("int") <= 18 * 60) & (minutes < "60"), F.concat(F.substring(offset, 1, 1), hours, F.lit(":"), minutes))
    return F.when(text == "", default).when(text.rlike(r"\d"), F.coalesce(fixed, named)).otherwise(named)


def _iso_utc(ms: Column) -> Column:
    """Milliseconds since 1970 as text, by arithmetic and so whatever the session's zone is."""
    day = F.date_from_unix_date(F.floor(ms / 86_400_000).cast("int"))
    rest = F.pmod(ms, F.lit(86_400_000).cast("bigint"))
    part = lambda unit, most, width: F.lpad((F.floor(rest / unit) % most).cast("string"), width, "0")
    return F.concat(day.cast("string"), F.lit("T"), part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3), F.lit("Z"))


def _local(ts: Column, zone: Column) -> Column:
    return F.convert_timezone(F.current_timezone(), zone, ts.cast("timestamp_ntz"))


def madrid_day(ts: Column, zone: str = "Europe/Madrid") -> Column:
    """The calendar day of an instant in ``zone``."""
    return F.to_date(_local(ts, F.lit(zone)))


def parse_instant_text(c: Column) -> Column:
    """A full ISO instant in text as a timestamp, else NULL."""
    return c.try_cast("timestamp")


def normalise_timestamps(
    df: DataFrame,
    value: str,
    *,
    out: str = "norm_value",
    anchor: Column | None = None,
    default_zone: str | Column = "Europe/Madrid",
    ambiguous: str = "first",
    nonexistent: str = "before",
    only_read: bool = False,
) -> DataFrame:
    """``df`` with the column ``out``: the normal form of the text column ``value`` (see the module).

    ``default_zone`` is a zone name or a column (a source's zone from a lookup joined before).
    ``ambiguous``: ``first`` or ``second`` pass of a repeated local time, or ``null``.
    ``nonexistent``: offset ``before`` or ``after`` the change for a skipped local time, or ``null``.
    With ``only_read`` rows whose value names no full day are left out.
    Other columns of ``df`` stay as they are, whatever their names.
    """
    if ambiguous not in ("first", "second", "null") or nonexistent not in ("before", "after", "null"):
        raise ValueError("unknown policy")
    tmp = "__ts_"
    while any(c.lower().startswith(tmp) for c in df.columns):
        tmp += "_"
    n = lambda x: tmp + x
    default = F.lit(default_zone) if isinstance(default_zone, str) else default_zone
    text = F.translate(F.lower(F.trim(F.regexp_replace(F.col(f"`{value}`"), r"[\s   ]+", " "))), _FOLD_FROM, _FOLD_TO)
    df = df.withColumns({n("s"): text, n("a"): anchor.cast("date") if anchor is not None else F.lit(None).cast("date"), n("dz"): default})
    s = F.col(n("s"))

    # Each pattern rewrites a text it matches as a mark and its parts, which no later pattern matches.
    read = s
    for pattern, order in [*_CASCADE, (_COMPACT, (1, 2, 3))]:
        read = F.regexp_replace(read, pattern, _MARK + "~".join(f"${i}" for i in (*order, 4, 5, 6, 7, 8, 9, 10)))
    df = df.withColumn(n("r"), read)
    parts = F.when(F.col(n("r")).startswith(_MARK), F.split(F.right(F.col(n("r")), F.length(n("r")) - 1), "~", -1))
    df = df.withColumn(n("p"), parts)
    p = lambda i: F.col(n("p"))[i]

    zones = _zone_table(df.sparkSession).toDF(n("zt"), n("zn"))
    df = df.withColumn(n("zt0"), p(9)).join(F.broadcast(zones), F.col(n("zt0")) == F.col(n("zt")), "left")
    year = F.when(F.length(p(0)) == 2, _int(p(0)) + 2000).otherwise(_int(p(0)))
    meridiem = F.substring(F.when(p(7).rlike("^[ap]"), p(7)).otherwise(p(8)), 1, 1)
    hour = _int(p(3))
    hour = (
        F.when(~meridiem.isin("a", "p") | meridiem.isNull(), hour)
        .when(hour.between(1, 12), hour % 12 + F.when(meridiem == "p", 12).otherwise(0))
    )
    df = df.withColumns(
        {
            n("y"): year, n("m"): _month_number(p(1)), n("d"): _int(p(2)), n("h"): hour,
            n("mi"): F.coalesce(_int(p(4)), F.lit(0)), n("sec"): F.coalesce(_int(p(5)), F.lit(0)),
            n("ms"): F.coalesce(F.rpad(F.substring(F.when(p(6) != "", p(6)), 1, 3), 3, "0").cast("int"), F.lit(0)),
            n("timed"): p(3) != "", n("z"): _zone(p(9), F.col(n("dz")), F.col(n("zn"))),
        }
    )
    y, m, d = F.col(n("y")), F.col(n("m")), F.col(n("d"))
    a = F.col(n("a"))
    # The next such day: this year or the next, and for 29 February the next leap year.
    following = F.year(a) + F.when(m * 100 + d >= F.month(a) * 100 + F.dayofmonth(a), 0).otherwise(1)
    fourth = F.ceil(following / 4).cast("int") * 4
    leap = fourth + F.when((fourth % 100 == 0) & (fourth % 400 != 0), 4).otherwise(0)
    df = df.withColumn(n("y"), F.when(p(0) != "", y).otherwise(F.when((m == 2) & (d == 29), leap).otherwise(following)))
    df = df.withColumn(n("ok"), _exists(y, m, d))
    clock_ok = F.col(n("h")).between(0, 23) & F.col(n("mi")).between(0, 59) & F.col(n("sec")).between(0, 59)
    df = df.withColumn(
        n("t"),
        F.when(
            F.col(n("ok")) & F.col(n("timed")) & clock_ok & F.col(n("z")).isNotNull(),
            F.make_timestamp(y, m, d, F.col(n("h")), F.col(n("mi")), F.col(n("sec")).cast("decimal(16,6)"), F.col(n("z"))),
        ),
    )
    t, zone = F.col(n("t")), F.col(n("z"))
    if (ambiguous, nonexistent) != ("first", "before"):
        wanted = F.make_timestamp_ntz(y, m, d, F.col(n("h")), F.col(n("mi")), F.col(n("sec")).cast("decimal(16,6)"))
        shift = _local(t, zone) - wanted  # the length of the gap, for a skipped time
        step = F.expr("INTERVAL '1' HOUR")
        if nonexistent != "before":
            t = F.when(shift != F.expr("INTERVAL '0' HOUR"), F.lit(None) if nonexistent == "null" else t - shift).otherwise(t)
        if ambiguous != "first":
            again = (_local(F.col(n("t")) + step, zone) == wanted) & (_local(F.col(n("t")), zone) == wanted)
            t = F.when(again, F.lit(None) if ambiguous == "null" else F.col(n("t")) + step).otherwise(t)
    epoch = F.when(s.rlike(r"^\d{10}$"), s.try_cast("bigint") * 1000).when(s.rlike(r"^\d{13}$"), s.try_cast("bigint"))
    df = df.withColumn(n("at"), F.coalesce(epoch, F.unix_millis(t) + F.col(n("ms"))))
    result = F.when(F.col(n("at")).isNotNull(), _iso_utc(F.col(n("at")))).when(F.col(n("ok")) & ~F.col(n("timed")), F.make_date(y, m, d).cast("string"))
    df = df.withColumn(out, result)
    if only_read:
        # A test of the steps would be moved below those that make them, with all of them written out once
        # more.  The row number keeps it here: nothing is moved past a column that depends on its place.
        # It is no test of the result, which need not be made where nothing else asks for it.
        is_read = F.col(n("at")).isNotNull() | (F.col(n("ok")) & ~F.col(n("timed")))
        df = df.withColumn(n("row"), F.monotonically_increasing_id()).where(is_read & (F.col(n("row")) >= 0))
    return df.drop(*[n(x) for x in ("s", "a", "dz", "p", "zt", "zn", "zt0", "y", "m", "d", "h", "mi", "sec", "ms", "timed", "z", "ok", "t", "r", "at", "row")])
