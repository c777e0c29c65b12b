"""Parsing of time texts in SQL expressions."""
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Offsets in minutes of the abbreviations used in the zones of the environments table.
ABBREVIATIONS = {"UTC": 0, "GMT": 0, "Z": 0, "BST": 60, "CET": 60, "CEST": 120, "EST": -300, "EDT": -240, "CST": -360,
                 "CDT": -300, "JST": 540, "IST": 330, "AEST": 600, "AEDT": 660}
EXACT = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}Z$"
MONTHS = "jan feb mar apr may jun jul aug sep oct nov dec".split()
TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d+))?)?"
ZONE = r"\s*(Z|UTC|GMT|[A-Z]{3,4}|[+-]\d{2}(?::?\d{2})?|[A-Za-z_]+/[A-Za-z_/]+)?(?:\[[A-Za-z_/]+\])?"
T = TIME + ZONE
#: pattern and what it becomes: year, month, day, hour, minute, second, fraction, AM/PM, zone, kind
FORMS = [
    (rf"(?i)^(\d{{4}})([-/])(\d{{2}})\2(\d{{2}})(?:[T ]{T})?$", "$1,$3,$4,$5,$6,$7,$8,,$9,c"),
    (r"(?i)^(\d{4})(\d{2})(\d{2})T(\d{2})(\d{2})(\d{2})?(?:[.,](\d+))?\s*(Z|[+-]\d{2}(?::?\d{2})?)?$", "$1,$2,$3,$4,$5,$6,$7,,$8,c"),
    (rf"(?i)^(\d{{1,2}})\.(\d{{1,2}})\.(\d{{4}})(?:[T ]{T})?$", "$3,$2,$1,$4,$5,$6,$7,,$8,c"),
    (rf"(?i)^(?:[a-z]{{3}}, )?(\d{{1,2}})[- ]([a-z]{{3}})[- ](\d{{4}})(?: {T})?$", "$3,$2,$1,$4,$5,$6,$7,,$8,c"),
    (rf"(?i)^([a-z]{{3}}) (\d{{1,2}}), (\d{{4}})(?: {TIME}\s*(AM|PM)?{ZONE})?$", "$3,$1,$2,$4,$5,$6,$7,$8,$9,c"),
    (rf"(?i)^(\d{{4}})-(\d{{3}})(?:[T ]{T})?$", "$1,,$2,$3,$4,$5,$6,,$7,o"),
    (rf"(?i)^(\d{{4}})-W(\d{{2}})-(\d)(?:[T ]{T})?$", "$1,$2,$3,$4,$5,$6,$7,,$8,w"),
]


def parsed(d: DataFrame) -> DataFrame:
    """d with instant_us, microseconds since the epoch of its stripped text raw, or null. zone: name for local times.

    Digits only: seconds up to 11 digits, milliseconds up to 14, else microseconds. Local times go through the zone's
    rules: a repeated one is the first, a skipped one moves forward by the skip.
    """
    raw = F.col("raw")
    exact = F.when(raw.rlike(EXACT) & ~raw.startswith("0000"), F.unix_micros(raw.try_cast("timestamp")))
    canon = F.when(raw.rlike(FORMS[0][0]), F.regexp_replace(raw, *map(F.lit, FORMS[0])))
    for p, to in FORMS[1:]:
        canon = canon.when(raw.rlike(p), F.regexp_replace(raw, F.lit(p), F.lit(to)))
    big = lambda c: c.try_cast("bigint")
    plain = F.when(raw.rlike(r"^\d{1,11}\.\d+$"), big(F.regexp_extract(raw, r"^(\d+)\.", 1)) * 1000000
                   + big(F.rpad(F.substring(F.regexp_extract(raw, r"\.(\d+)$", 1), 1, 6), 6, "0")))
    plain = plain.when(raw.rlike(r"^\d{1,11}$"), big(raw) * 1000000).when(raw.rlike(r"^\d{12,14}$"), big(raw) * 1000).when(raw.rlike(r"^\d{15,17}$"), big(raw))
    f = lambda i: F.col("_f")[i]
    n = lambda i: F.coalesce(big(f(i)), F.lit(0).cast("bigint"))
    names = F.create_map(*[F.lit(x) for i, m in enumerate(MONTHS) for x in (m, i + 1)])
    month = F.coalesce(big(f(1)), names[F.lower(f(1))].cast("bigint"))
    iso = F.concat_ws("-", f(0), F.lpad(month.cast("string"), 2, "0"), F.lpad(f(2), 2, "0")).try_cast("date")
    new_year = F.concat(f(0), F.lit("-01-01")).try_cast("date")
    o = F.date_add(new_year, (n(2) - 1).cast("int"))
    monday = F.date_add(F.trunc(F.concat(f(0), F.lit("-01-04")).try_cast("date"), "week"), (n(1) * 7 - 7).cast("int"))
    day = (F.when(f(0) == "0000", None).when(f(9) == "c", iso).when((f(9) == "o") & (n(2) > 0) & (F.year(o) == n(0)), o)
           .when((f(9) == "w") & n(1).between(1, 53) & n(2).between(1, 7) & (F.year(F.date_add(monday, 3)) == n(0)), F.date_add(monday, (n(2) - 1).cast("int"))))
    ap = F.upper(f(7))
    hour = F.when(ap == "", n(3)).when(n(3).between(1, 12), n(3) % 12 + F.when(ap == "PM", 12).otherwise(0))
    secs = F.when((hour < 24) & (n(4) < 60) & (n(5) < 60), F.unix_date("_day").cast("bigint") * 86400 + hour * 3600 + n(4) * 60 + n(5))
    at = r"^[+-](\d{2}):?(\d{2})?$"
    num = big(F.regexp_extract(f(8), at, 1)) * 60 + F.coalesce(big(F.regexp_extract(f(8), at, 2)), F.lit(0))
    off = F.when(num <= 1080, F.when(f(8).startswith("-"), -num).otherwise(num))
    off = F.coalesce(off, F.create_map(*[F.lit(x) for k, v in ABBREVIATIONS.items() for x in (k, v)])[F.upper(f(8))].cast("bigint"))
    wall = F.timestamp_micros(F.col("_secs") * 1000000)
    us = F.when(f(8) == "", F.unix_micros(F.to_utc_timestamp(wall, F.col("zone")))).when(f(8).contains("/"), F.unix_micros(F.to_utc_timestamp(wall, f(8)))) \
        .otherwise((F.col("_secs") - off * 60) * 1000000)
    return (d.withColumn("_f", F.split(canon, ",")).withColumn("_day", day).withColumn("_secs", secs)
            .withColumn("instant_us", F.coalesce(plain, us + F.rpad(F.substring(f(6), 1, 6), 6, "0").cast("bigint"))).drop("_f", "_day", "_secs"))
