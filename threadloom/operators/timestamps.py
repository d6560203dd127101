"""Mixed timestamp notations and zones to one instant in UTC."""

from __future__ import annotations

import hashlib
import inspect
import sys
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from threadloom.session import cut

#: Month names in English, German, Russian (both cases), Spanish, French and Portuguese.
MONTHS = (
    "jan january januar января январь enero janvier janeiro",
    "feb february februar февраля февраль febrero février fevereiro",
    "mar march märz maerz марта март marzo mars março",
    "apr april апреля апрель abril avril",
    "may mai мая май mayo maio",
    "jun june juni июня июнь junio juin junho",
    "jul july juli июля июль julio juillet julho",
    "aug august августа август agosto août",
    "sep sept september сентября сентябрь septiembre septembre setembro",
    "oct october oktober октября октябрь octubre octobre outubro okt",
    "nov november ноября ноябрь noviembre novembre novembro",
    "dec december dezember декабря декабрь diciembre décembre dezembro dez",
)

_BLANK = "[\\s\\u00A0\\u200B\\u202F\\u2000-\\u200A\\u3000\\uFEFF]"
_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?"
_HALF = r"(?:\s*([aApP])\.?\s?[mM]\.?(?![A-Za-z]))?"
_OFFSET = r"[+\-−]\d{2}(?::?\d{2})?"
_ZONE = (
    rf"(?:\s*(?:({_OFFSET})(?:\[[^\]]*\])?|\[?((?:UTC|GMT)\s?[+\-]\d{{1,2}}(?::?\d{{2}})?|[A-Za-z][A-Za-z0-9_]*(?:[/+\-][A-Za-z0-9_]+)*)\]?))?"
)
#: (pattern, rewriting to year|month|day|hour|minute|second|fraction|half|offset|zone).
_NOTATIONS = (
    (rf"^(\d{{4}})[-/.](\d{{1,2}})[-/.](\d{{1,2}})(?:T|\s*,\s*|\s+){_TIME}{_HALF}{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7|$8|$9|$10"),
    (rf"^(\d{{4}})(\d{{2}})(\d{{2}})[T ](\d{{2}})(\d{{2}})(?:(\d{{2}})(?:[.,](\d{{1,9}}))?)?{_ZONE}$", "$1|$2|$3|$4|$5|$6|$7||$8|$9"),
    (rf"^(\d{{1,2}})[./-](\d{{1,2}})[./-](\d{{4}}|\d{{2}})(?:T|\s*,\s*|\s+){_TIME}{_HALF}(?:\s*Uhr)?{_ZONE}$", "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10"),
    (
        rf"^(?:\p{{L}}+\.?,?\s+)?(\d{{1,2}})\.?(?:\s+de)?[\s-]+(\p{{L}}+)\.?,?(?:\s+de)?[\s-]+(\d{{4}}|\d{{2}})(?:\s*г\.?)?(?:,|\s+в|\s+um|\s+at|\s+a\s+las|\s+à)*\s*{_TIME}{_HALF}(?:\s*Uhr)?{_ZONE}$",
        "$3|$2|$1|$4|$5|$6|$7|$8|$9|$10",
    ),
    (rf"^(?:\p{{L}}+\.?,\s+)?(\p{{L}}+)\.?\s+(\d{{1,2}})(?:st|nd|rd|th)?,?\s+(\d{{4}})(?:,|\s+at)?\s+{_TIME}{_HALF}{_ZONE}$", "$3|$1|$2|$4|$5|$6|$7|$8|$9|$10"),
)

#: A value that holds at least one row in this many is joined back by broadcast; there are at most so many of them.
HOT_SHARE = 1000


def _trim(value: Column) -> Column:
    return F.regexp_replace(value, f"^{_BLANK}+|{_BLANK}+$", "")


def _zones(spark: SparkSession) -> DataFrame:
    """(_low, _zone) of every name in the time zone database, about 600 rows."""
    names = spark._jvm.java.lang.String.join(",", spark._jvm.java.time.ZoneId.getAvailableZoneIds())
    known = sorted({n for n in names.split(",") if not n.startswith("SystemV/")} | {"EST", "MST", "HST"})
    return spark.createDataFrame([(n.lower(), n) for n in known], "_low string, _zone string")


def _offset_seconds(sign_and_digits: Column) -> Column:
    """Seconds east of UTC of +h, +hh, +hhmm, +hh:mm; null beyond 18 hours."""
    shape = r"^([+\-−])(\d{1,2}):?(\d{2})?$"
    hours = F.regexp_extract(sign_and_digits, shape, 2).try_cast("int")
    minutes = F.coalesce(F.regexp_extract(sign_and_digits, shape, 3).try_cast("int"), F.lit(0))
    size = hours * 3600 + minutes * 60
    return F.when(
        sign_and_digits.rlike(shape) & (minutes < 60) & (size <= 18 * 3600),
        F.when(F.regexp_extract(sign_and_digits, shape, 1) == "+", size).otherwise(-size),
    )


def parse_timestamps(values: DataFrame, raw: str = "_raw", assumption: str = "_assumed") -> DataFrame:
    """``values`` with ``utc_us``: microseconds since 1970 UTC of the instant, null where there is none.

    Pure numbers count seconds (10 digits, with or without fraction), milliseconds (13) or microseconds
    (16). An offset or zone inside the value outranks the assumption. The assumption may be null, a
    UTC_ASSUMED_… value, UTC or GMT with or without offset, or a zone name in any case. Numeric dates are
    day first unless the year leads; two-digit years are 20yy; missing seconds and fractions are zero and
    digits beyond microseconds are cut off. A local time that occurs twice means the first, a skipped one
    is read with the offset before the change. Unknown notations, impossible dates or clock times, dates
    without a clock time and unknown zones have no instant. Everything is one projection in the JVM but
    for two broadcast joins with the zone names.
    """
    zones = _zones(values.sparkSession)
    text = _trim(F.col(raw))
    fields = F.lit(None).cast("string")
    for pattern, order in reversed(_NOTATIONS):
        fields = F.when(F.col("_t").rlike(pattern), F.regexp_replace("_t", pattern, order)).otherwise(fields)
    months = {name: str(i + 1) for i, names in enumerate(MONTHS) for name in names.split()}
    month_map = F.create_map(*[F.lit(x) for kv in months.items() for x in kv])

    df = (
        values.withColumn("_t", F.regexp_replace(text, _BLANK, " "))
        .withColumn("_f", F.split(fields, r"\|", -1))
        .withColumn("_z", F.trim(F.element_at("_f", 10)))
        .withColumn("_a", _trim(F.col(assumption)))
    )
    part = lambda i: F.element_at("_f", i)
    number = lambda i: part(i).try_cast("int")
    year = F.when(F.length(part(1)) == 2, number(1) + 2000).otherwise(number(1))
    month = F.coalesce(part(2).try_cast("int"), F.element_at(month_map, F.lower(part(2))).try_cast("int"))
    half = F.lower(part(8))
    hour = F.when(half == "", number(4)).when(
        number(4).between(1, 12), number(4) % 12 + F.when(half == "p", 12).otherwise(0)
    )
    second = F.coalesce(number(6), F.lit(0))
    fraction = F.rpad(F.substring(part(7), 1, 6), 6, "0").cast("int")
    df = (
        df.withColumn("_y", year)
        .withColumn("_mo", month)
        .withColumn("_d", number(3))
        .withColumn("_h", hour)
        .withColumn("_mi", number(5))
        .withColumn("_s", second)
        .withColumn("_day", F.try_to_date(F.format_string("%04d-%02d-%02d", "_y", "_mo", "_d")))
    )
    sane = (
        F.col("_day").isNotNull() & F.col("_h").between(0, 23) & F.col("_mi").between(0, 59) & F.col("_s").between(0, 59)
    )
    local = F.when(
        sane,
        F.unix_date("_day").cast("long") * 86_400_000_000
        + (F.col("_h") * 3600 + F.col("_mi") * 60 + F.col("_s")).cast("long") * 1_000_000
        + F.coalesce(fraction, F.lit(0)),
    )
    utc_like = r"(?i)^(?:UTC|GMT)\s*([+-]\d{1,2}(?::?\d{2})?)$"
    utc_offset = lambda c: _offset_seconds(F.regexp_extract(c, utc_like, 1))
    inside = F.when(part(9) != "", _offset_seconds(part(9))).when(F.col("_z").isin("Z", "z"), 0).when(
        F.col("_z").rlike(utc_like), utc_offset(F.col("_z"))
    )
    assumed = F.when(F.col("_a").isNull() | F.upper("_a").isin("UTC", "GMT") | F.upper("_a").startswith("UTC_ASSUMED_"), 0).when(
        F.col("_a").rlike(utc_like), utc_offset(F.col("_a"))
    )
    named_inside = (part(9) != "") | (F.col("_z") != "")
    df = (
        df.withColumn("_local", local)
        .withColumn("_offset", F.when(named_inside, inside).otherwise(assumed).cast("long"))
        .withColumn("_low", F.when(F.col("_offset").isNull(), F.lower(F.when(named_inside, F.col("_z")).otherwise(F.col("_a")))))
        .join(F.broadcast(zones), "_low", "left")
    )
    epoch = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    naive = epoch + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.col("_local") / F.lit(1_000_000).cast("decimal(18,6)"))
    moved = F.convert_timezone(F.col("_zone"), F.lit("UTC"), naive)
    by_zone = F.timestamp_diff("MICROSECOND", epoch, moved)
    seconds = F.split(F.col("_t"), r"\.", -1)
    counted = (
        F.when(
            F.col("_t").rlike(r"^\d{10}(\.\d+)?$"),
            seconds[0].try_cast("long") * 1_000_000
            + F.coalesce(F.rpad(F.substring(F.get(seconds, F.lit(1)), 1, 6), 6, "0").try_cast("long"), F.lit(0)),
        )
        .when(F.col("_t").rlike(r"^\d{13}$"), F.col("_t").try_cast("long") * 1000)
        .when(F.col("_t").rlike(r"^\d{16}$"), F.col("_t").try_cast("long"))
    )
    result = F.coalesce(
        counted,
        F.when(F.col("_offset").isNotNull(), F.col("_local") - F.col("_offset") * 1_000_000).when(
            F.col("_zone").isNotNull() & F.col("_local").isNotNull(), by_zone
        ),
    )
    return df.select(*values.columns, result.cast("long").alias("utc_us"))


def parser_version() -> str:
    """Changes whenever the parser does, so that a kept dictionary never holds what an older one read."""
    return hashlib.sha256(inspect.getsource(sys.modules[__name__]).encode()).hexdigest()[:12]


def _held(spark: SparkSession, path: str) -> DataFrame | None:
    """(_r, _a, utc_us) of a kept dictionary, each pair once, or None where nothing is kept."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/run=*/_SUCCESS")
    done = at.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(at)
    parts = [done[i].getPath().getParent().toString() for i in range(len(done))] if done else []
    if not parts:
        return None
    rows = spark.read.schema("_raw string, _assumed string, utc_us bigint").parquet(*parts)
    return rows.groupBy(F.col("_raw").alias("_r"), F.col("_assumed").alias("_a")).agg(F.first("utc_us").alias("utc_us"))


def timestamp_dictionary(rows: DataFrame, raw: str, assumption: str, path: str | None = None) -> DataFrame:
    """(_raw, _assumed, _n, utc_us): each distinct pair of the two columns, parsed once.

    With ``path`` the dictionary is a folder of Parquet tables that grows: pairs it already holds aren't
    parsed again, new ones are committed as one more table under a name of its own. Only committed tables
    are read and each pair is taken once, so runs side by side, failed runs and repeated runs do no harm; a
    pair that two of them parsed has the same instant in both. Without ``path`` the dictionary lives in the
    session's checkpoint folder. Pairs with a null raw value aren't listed.
    """
    pairs = (
        rows.where(F.col(raw).isNotNull())
        .groupBy(F.col(raw).alias("_raw"), F.col(assumption).alias("_assumed"))
        .agg(F.count(F.lit(1)).alias("_n"))
    )
    if path is None:
        return cut(parse_timestamps(pairs))
    pairs = cut(pairs)
    held = _held(rows.sparkSession, path)
    if held is None:
        known = parse_timestamps(pairs)
        known = cut(known)
        new = known
    else:
        matched = cut(pairs.join(held.withColumn("_held", F.lit(True)), (pairs["_raw"] == held["_r"]) & pairs["_assumed"].eqNullSafe(held["_a"]), "left"))
        new = cut(parse_timestamps(matched.where("_held IS NULL").select("_raw", "_assumed", "_n")))
        known = matched.where("_held").select("_raw", "_assumed", "_n", "utc_us").unionByName(new)
    if not new.isEmpty():
        new.select("_raw", "_assumed", "utc_us").write.parquet(f"{path}/run={uuid.uuid4().hex}")
    return known


def normalise_timestamps(
    rows: DataFrame, key: str, raw: str, assumption: str, dictionary_path: str | None = None
) -> DataFrame:
    """(key, utc_us) of every row; ``utc_us`` is null where the row states no instant.

    See ``parse_timestamps`` for what a value means. Null raw values state nothing; repeated rows come
    out repeatedly; an empty table gives an empty table; other columns are ignored.

    The distinct values are parsed once, kept under ``dictionary_path`` if one is given, and joined back. A value that holds at least 1/1000 of the rows
    is joined by broadcast, and there can be no more than 1000 of those; all others are joined by shuffle,
    where none is large.
    """
    words = timestamp_dictionary(rows, raw, assumption, dictionary_path)
    total = words.agg(F.sum("_n")).first()[0] or 0
    hot = words.where(F.col("_n") >= max(1, -(-total // HOT_SHARE)))
    cold = words.where(F.col("_n") < max(1, -(-total // HOT_SHARE)))
    slim = rows.select(F.col(key).alias("_key"), F.col(raw).alias("_x"), F.col(assumption).alias("_y"))

    def on(right: DataFrame) -> Column:
        return (F.col("_x") == right["_raw"]) & F.col("_y").eqNullSafe(right["_assumed"])

    marked = slim.join(F.broadcast(hot.withColumn("_hot", F.lit(True))), on(hot), "left")
    direct = marked.where(F.col("_hot") | F.col("_x").isNull()).select(F.col("_key"), "utc_us")
    rest = marked.where(F.col("_hot").isNull() & F.col("_x").isNotNull()).select("_key", "_x", "_y")
    joined = rest.join(cold, on(cold), "inner").select("_key", "utc_us")
    return direct.unionByName(joined).withColumnRenamed("_key", key)
