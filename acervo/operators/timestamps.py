"""Mixed date and time notations brought to one unambiguous form.

A text is parsed by JVM expressions into a local reading (date, time of day, zone text). Readings with a time of day
are then joined as-of to the zone's offset intervals: the interval table holds, for each zone and local year, the
intervals [local_start, local_end) of constant offset. Two matching intervals mean a repeated local time (the earlier
instant is taken), none a skipped one (the offset before the change is taken), one gives the offset directly.
The interval table is bounded by the zone database (zones times years), whatever the size of the data.
"""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from functools import lru_cache
from zoneinfo import ZoneInfo, available_timezones

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from acervo.functions.text import fold

# Month names and abbreviations in Portuguese, Spanish and English, by month.
MONTHS = [
    "janeiro|january|enero|jan|ene",
    "fevereiro|february|febrero|fev|feb",
    "marco|march|marzo|mar",
    "abril|april|abr|apr",
    "maio|may|mayo|mai",
    "junho|june|junio|jun",
    "julho|july|julio|jul",
    "agosto|august|ago|aug",
    "setembro|september|septiembre|setiembre|set|sept|sep",
    "outubro|october|octubre|out|oct",
    "novembro|november|noviembre|nov",
    "dezembro|december|diciembre|dez|dec|dic",
]
ROMAN = ["i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix", "x", "xi", "xii"]
# Zone abbreviations with one meaning among the zones in use, in seconds from UTC.
ABBREVIATIONS = {
    "z": 0, "utc": 0, "gmt": 0, "wet": 0, "west": 3600, "cet": 3600, "cest": 7200,
    "brt": -10800, "brst": -7200, "amt": -14400, "amst": -10800, "art": -10800,
    "est": -18000, "edt": -14400, "cst": -21600, "cdt": -18000, "mst": -25200, "mdt": -21600, "pst": -28800, "pdt": -25200,
}
BRASILIA = "America/Sao_Paulo"
FIRST_YEAR, LAST_YEAR = 1900, 2100
_EPOCH = datetime(1970, 1, 1)


@lru_cache(maxsize=1024)
def offset_intervals(zone: str) -> tuple[tuple[int, int, int], ...]:
    """(local_start, local_end, offset) in seconds, in order of time; the first and last are open-ended."""
    tz, step = ZoneInfo(zone), 43200

    def offset(second: int) -> int:
        return int((datetime.fromtimestamp(second, timezone.utc)).astimezone(tz).utcoffset().total_seconds())

    start = int((datetime(FIRST_YEAR, 1, 1) - _EPOCH) / timedelta(seconds=1))
    end = int((datetime(LAST_YEAR, 12, 31) - _EPOCH) / timedelta(seconds=1))
    changes, at, now = [], start, offset(start)
    while at < end:
        following = at + step
        after = offset(following)
        if after != now:
            low, high = at, following
            while high - low > 1:
                middle = (low + high) // 2
                low, high = (middle, high) if offset(middle) == now else (low, middle)
            changes.append((high, now, offset(high)))
            at, now = high, offset(high)
        else:
            at = following
    far = 1 << 60
    bounds = [-far, *(c[0] for c in changes), far]
    offsets = [changes[0][1] if changes else now, *(c[2] for c in changes)]
    return tuple(
        (a if a == -far else a + o, b if b == far else b + o, o) for a, b, o in zip(bounds, bounds[1:], offsets, strict=False)
    )


def interval_table(spark: SparkSession, zones: list[str]) -> DataFrame:
    """(zone, local_year, intervals): the intervals that touch the year, exploded by year so that the as-of join is an equi join.

    At most (zones of the database) x (LAST_YEAR - FIRST_YEAR + 1) rows of at most a few intervals each.
    """
    rows = []
    for zone in zones:
        spans = offset_intervals(zone)
        for year in range(FIRST_YEAR, LAST_YEAR + 1):
            low = int((datetime(year, 1, 1) - _EPOCH).total_seconds()) - 172800
            high = int((datetime(year + 1, 1, 1) - _EPOCH).total_seconds()) + 172800
            rows.append((zone, year, [s for s in spans if s[1] > low and s[0] < high]))
    return spark.createDataFrame(rows, "zone string, local_year int, intervals array<struct<local_start:bigint,local_end:bigint,offset:int>>")


def _cleaned(text: Column) -> Column:
    """Lower case without accents, months as m01..m12, a leading time moved behind its date."""
    out = F.trim(F.regexp_replace(fold(text), r"(?U)\s+", " "))
    out = F.regexp_replace(out, r"(?<=\d)[ºª°]", "")
    out = F.regexp_replace(out, r"^(?:mon|tue|wed|thu|fri|sat|sun)[a-z]*,? ", "")
    out = F.regexp_replace(out, r"^aos (\d{1,2}) dias? do mes de ", "$1 de ")
    for number, names in enumerate(MONTHS, 1):
        out = F.regexp_replace(out, rf"(?<![a-z/])(?:{names})(?![a-z])|(?<=\d/)(?:{names})(?=/)", f"m{number:02d}")
    for number, roman in enumerate(ROMAN, 1):
        out = F.regexp_replace(out, rf"(?<=\d/){roman}(?=/\d)", f"m{number:02d}")
    return F.regexp_replace(out, r"^(\d{1,2}:\d{2}(?::\d{2})?) de (.+)$", "$2 $1")


_YMD = r"^(\d{4})([-/.])(\d{1,2})\2(\d{1,2})(?:t| |$)(.*)$"
_COMPACT = r"^(\d{4})(\d{2})(\d{2})(?:t| |$)(.*)$"
_DMY = r"^(\d{1,2})(?:/|-|\.| de | )m?(\d{1,2})(?:/|-|\.| de | )(\d{4}|\d{2})(?!\d)(.*)$"
_MDY = r"^m(\d{2}) (\d{1,2}), ?(\d{4})(?!\d)(.*)$"
_MONTH_YEAR = r"^m?(\d{1,2})(?: de |/| |-)(\d{4})$"
_YEAR_MONTH = r"^(\d{4})[-/](\d{1,2})$"
_ZONE = r"(z|[+-]\d{2}:?\d{2}|(?:utc|gmt)[+-]\d{1,2}(?::?\d{2})?|[a-z]{2,5}|[a-z]+(?:/[a-z_]+){1,2}|\(?horario de brasilia\)?)?"
_TIME = r"^[ ,-]*(?:as )?(\d{1,2})(?::|h)(\d{2})?(?:min|:(\d{2}))?(?:[.,](\d{1,9}))? ?((?:am|pm)(?![a-z]))? ?" + _ZONE + "$"
_TIME_COMPACT = r"^(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?()" + _ZONE + "$"


def _int(text: Column) -> Column:
    return F.when(text != "", text.cast("int")).otherwise(F.lit(0))


def _match(text: Column, pattern: str, order: list[int]) -> Column:
    groups = [F.regexp_extract(text, pattern, i) for i in order]
    return F.when(text.rlike(pattern), F.array(*groups))


def with_normal_form(df: DataFrame, text: str, local_zone: str, name: str = "normal_form") -> DataFrame:
    """Add the normal form of df[text] under `name` (an existing column of that name is replaced).

    A date gives YYYY-MM-DD, a month YYYY-MM, a date with a time of day the UTC instant YYYY-MM-DDTHH:MM:SS.mmmZ.
    Numeric dates are day first unless the year leads; two-digit years are 20yy; 10 and 13 digits are Unix seconds and
    milliseconds. Defined results: a null, empty or unreadable text, an impossible date or time, or a zoneless time
    whose local_zone is null or no known zone gives null. Repeated rows each keep their own result; an empty table
    stays empty; all other columns pass through untouched.
    """
    spark = df.sparkSession
    zones = _zones_of(df, text, local_zone)
    t = "__ts_"
    out = df.withColumn(t + "c", _cleaned(F.col(f"`{text}`")))
    c = F.col(t + "c")
    out = out.withColumn(
        t + "d",
        F.coalesce(
            _match(c, _YMD, [1, 3, 4, 5]),
            _match(c, _COMPACT, [1, 2, 3, 4]),
            _match(c, _DMY, [3, 2, 1, 4]),
            _match(c, _MDY, [3, 1, 2, 4]),
        ),
    ).withColumn(t + "m", F.coalesce(_match(c, _YEAR_MONTH, [1, 2]), _match(c, _MONTH_YEAR, [2, 1])))
    d, month = F.col(t + "d"), F.col(t + "m")
    year = F.when(F.length(d[0]) == 2, F.concat(F.lit("20"), d[0])).otherwise(d[0])
    out = out.withColumn(
        t + "day", F.concat_ws("-", year, F.lpad(d[1], 2, "0"), F.lpad(d[2], 2, "0")).try_cast("date")
    )
    rest = F.trim(d[3])
    out = out.withColumn(
        t + "t", F.when(rest != "", F.coalesce(_match(rest, _TIME, [1, 2, 3, 4, 5, 6]), _match(rest, _TIME_COMPACT, [1, 2, 3, 4, 5, 6])))
    )
    p = F.col(t + "t")
    hour, minute, second = _int(p[0]), _int(p[1]), _int(p[2])
    twelve = p[4] != ""
    good = (minute < 60) & (second < 60) & F.when(twelve, hour.between(1, 12)).otherwise(hour < 24)
    hour = F.when(twelve, F.pmod(hour, F.lit(12)) + F.when(p[4] == "pm", 12).otherwise(0)).otherwise(hour)
    millis = F.rpad(F.substring(p[3], 1, 3), 3, "0").cast("int")
    zone_text = p[5]
    sign = F.when(F.regexp_extract(zone_text, r"([+-])\d", 1) == "-", -1).otherwise(1)
    numeric = _match(zone_text, r"^(?:utc|gmt)?[+-](\d{1,2}):?(\d{2})?$", [1, 2])
    fixed = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    stated = F.coalesce(
        F.when(numeric.isNotNull(), sign * (_int(numeric[0]) * 3600 + _int(numeric[1]) * 60)), F.try_element_at(fixed, zone_text)
    )
    known = F.create_map(*[F.lit(x) for z in zones for x in (z.lower(), z)])
    named = F.when(zone_text == "", F.try_element_at(known, F.lower(F.col(f"`{local_zone}`")))).when(
        zone_text.contains("brasilia"), F.lit(BRASILIA)
    ).otherwise(F.try_element_at(known, zone_text))
    out = (
        out.withColumn(t + "local", F.when(good, F.unix_date(F.col(t + "day")).cast("long") * 86400 + hour * 3600 + minute * 60 + second))
        .withColumn(t + "ms", F.when(p[3] != "", millis).otherwise(0))
        .withColumn(t + "stated", stated)
        .withColumn(t + "zone", F.when(F.col(t + "stated").isNull(), named))
        .withColumn(t + "year", F.year(F.col(t + "day")))
    )
    spans = interval_table(spark, zones).toDF(t + "z", t + "y", t + "spans")
    out = out.join(F.broadcast(spans), (F.col(t + "zone") == F.col(t + "z")) & (F.col(t + "year") == F.col(t + "y")), "left")
    local, all_spans = F.col(t + "local"), F.col(t + "spans")
    holding = F.filter(all_spans, lambda s: (s["local_start"] <= local) & (local < s["local_end"]))
    before = F.filter(all_spans, lambda s: s["local_end"] <= local)
    as_of = F.when(F.size(holding) > 0, holding[0]["offset"]).otherwise(F.try_element_at(before, F.lit(-1))["offset"])
    instant = local - F.coalesce(F.col(t + "stated"), as_of)
    epoch = F.when(c.rlike(r"^\d{10}$"), c.cast("long") * 1000).when(c.rlike(r"^\d{13}$"), c.cast("long"))
    in_millis = F.coalesce(epoch, instant * 1000 + F.col(t + "ms"))
    month_ok = month[1].cast("int").between(1, 12)
    out = out.withColumn(
        name,
        F.when(in_millis.isNotNull(), utc_text(in_millis))
        .when(month.isNotNull() & month_ok, F.concat(month[0], F.lit("-"), F.lpad(month[1], 2, "0")))
        .when(F.col(t + "day").isNotNull() & (rest == ""), F.col(t + "day").cast("string")),
    )
    return out.drop(*[x for x in out.columns if x.startswith(t)])


def utc_text(millis: Column) -> Column:
    """YYYY-MM-DDTHH:MM:SS.mmmZ of a count of milliseconds, whatever the session's zone."""
    day = F.floor(millis / 86400000).cast("int")
    left = (millis - day.cast("long") * 86400000).cast("long")
    part = lambda unit, most, width: F.lpad((F.floor(left / unit) % most).cast("string"), width, "0")
    clock = F.concat(part(3600000, 24, 2), F.lit(":"), part(60000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3))
    return F.concat(F.date_from_unix_date(day).cast("string"), F.lit("T"), clock, F.lit("Z"))


def _zones_of(df: DataFrame, text: str, local_zone: str) -> list[str]:
    """Known zones that the rows name: what reaches the driver is bounded by the zone database."""
    lower = {z.lower(): z for z in available_timezones()}
    named = F.regexp_extract(F.col(f"`{text}`"), r"(?<![A-Za-z/_])([A-Za-z]{1,20}(?:/[A-Za-z_]{1,30}){1,2})\s{0,9}$", 1)
    seen = df.select(F.explode(F.array(F.col(f"`{local_zone}`"), named)).alias("z")).select(F.lower("z").alias("z"))
    return sorted({lower[r.z] for r in seen.where(F.col("z").isin(*lower)).distinct().collect()} | {BRASILIA})
