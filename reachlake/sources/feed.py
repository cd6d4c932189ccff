"""Schedule feeds: a directory of CSV files to typed tables, and back."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reachlake.functions import codes, text
from reachlake.operators.skew import last_per_key

MANDATORY = ("trips", "stops", "routes", "stop_times", "agency")
SPLITTABLE = ("stop_times", "shapes")
DAYS = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")


def _cols(spec: str) -> dict[str, tuple[str, bool]]:
    """``name:kind`` words to ``{name: (kind, required)}``; a trailing ``!`` marks required."""
    out = {}
    for word in spec.split():
        name, _, kind = word.partition(":")
        required = kind.endswith("!")
        out[name] = (kind.rstrip("!") or "str", required)
    return out


# Files and columns of the feed format with the kind of each column.
SCHEMAS: dict[str, dict[str, tuple[str, bool]]] = {
    "agency": _cols("agency_id agency_name:str! agency_url agency_timezone agency_lang agency_phone "
                    "agency_fare_url agency_email"),
    "stops": _cols("stop_id:str! stop_code stop_name stop_desc location_type:location_type parent_station zone_id "
                   "stop_url stop_lon:float stop_lat:float stop_timezone wheelchair_boarding:availability level_id "
                   "platform_code"),
    "routes": _cols("route_id:str! route_short_name route_long_name route_desc route_type:int! route_url agency_id "
                    "route_sort_order:int route_color:color route_text_color:text_color "
                    "continuous_pickup:continuous continuous_drop_off:continuous"),
    "trips": _cols("trip_id:str! service_id:str! route_id:str! shape_id trip_headsign trip_short_name "
                   "direction_id:direction block_id wheelchair_accessible:availability bikes_allowed:bikes_allowed"),
    "stop_times": _cols("trip_id:str! arrival_time:time departure_time:time stop_id:str! stop_sequence:int! "
                        "stop_headsign pickup_type:pickup_drop_off drop_off_type:pickup_drop_off "
                        "continuous_pickup:continuous continuous_drop_off:continuous shape_dist_traveled:float "
                        "timepoint:timepoint"),
    "calendar": _cols("service_id:str! " + " ".join(f"{d}:flag!" for d in DAYS) + " start_date:date! end_date:date!"),
    "calendar_dates": _cols("service_id:str! date:date! exception_type:exception_type!"),
    "shapes": _cols("shape_id:str! shape_pt_lat:float! shape_pt_lon:float! shape_pt_sequence:int! "
                    "shape_dist_traveled:float"),
    "fare_attributes": _cols("fare_id:str! price:str! currency_type payment_method:payment_method! "
                             "transfers:transfers agency_id transfer_duration:int"),
    "frequencies": _cols("trip_id:str! start_time:time! end_time:time! headway_secs:int! exact_times:exact_times"),
    "transfers": _cols("from_stop_id:str! to_stop_id:str! transfer_type:transfer_type min_transfer_time:int"),
    "pathways": _cols("pathway_id:str! from_stop_id:str! to_stop_id:str! pathway_mode:pathway_mode "
                      "is_bidirectional:pathway_direction length:float traversal_time:int stair_count:int "
                      "max_slope:float min_width:float signposted_as reversed_signposted_as"),
    "feed_info": _cols("feed_publisher_name feed_publisher_url feed_lang default_lang feed_start_date:date "
                       "feed_end_date:date feed_version feed_contact_email feed_contact_url"),
}
COLORS = {"color": "FFFFFF", "text_color": "000000"}
SQL_TYPES = {"str": "string", "int": "int", "float": "double", "time": "int", "date": "date", "flag": "boolean",
             "color": "string", "text_color": "string"}


def typed(raw: Column, kind: str) -> Column:
    """Value of a text cell; null when empty or malformed."""
    c = text.blank_to_null(raw)
    if kind == "str":
        return c
    if kind in ("int", "float"):
        return c.try_cast("int" if kind == "int" else "double")
    if kind == "time":
        return text.parse_time(c)
    if kind == "date":
        return text.parse_date(c)
    if kind == "flag":
        return text.parse_flag(c)
    if kind in COLORS:
        return text.parse_color(c, COLORS[kind])
    return codes.code_of(c, kind)


def encoded(c: Column, kind: str) -> Column:
    """Text of a typed value in feed form."""
    if kind == "time":
        return text.format_time(c)
    if kind == "date":
        return text.format_date(c)
    if kind == "flag":
        return text.format_flag(c)
    return c.cast("string")


@dataclass
class Feed:
    """Typed tables of one or more feeds; a missing optional file is an empty table."""

    tables: dict[str, DataFrame]
    raw: dict[str, DataFrame] = field(default_factory=dict)

    def __getitem__(self, name: str) -> DataFrame:
        return self.tables[name]

    def replace(self, **tables: DataFrame) -> "Feed":
        return Feed({**self.tables, **tables}, self.raw)


class MissingFile(ValueError):
    pass


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return bool(found)


def read_raw(spark: SparkSession, path: str, name: str) -> DataFrame | None:
    """Text cells bound by header name, trimmed; ``_line`` orders rows as in the file."""
    file = f"{path}/{name}.txt"
    if not _exists(spark, file):
        if name in MANDATORY:
            raise MissingFile(f"{file} is required")
        return None
    # Quotes in quoted text are doubled. Text may hold line breaks, but in the two large tables, which
    # have no free text and so stay splittable.
    df = spark.read.csv(
        file, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, mode="PERMISSIVE",
        escape='"', multiLine=name not in SPLITTABLE
    )
    present = {c.lstrip("﻿").strip(): c for c in df.columns}
    line = F.struct("_metadata.file_path", "_metadata.file_block_start", F.monotonically_increasing_id().alias("row"))
    cells = [
        (F.col(f"`{present[c]}`") if c in present else F.lit(None).cast("string")).alias(c) for c in SCHEMAS[name]
    ]
    return df.select(*cells, line.alias("_line"))


def project(raw: DataFrame, name: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return raw.select(*[typed(F.col(c), k).alias(c) for c, (k, _) in SCHEMAS[name].items()], *keep)


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    ddl = ", ".join(f"{c} {SQL_TYPES.get(k, 'int')}" for c, (k, _) in SCHEMAS[name].items())
    return spark.createDataFrame([], ddl)


def read_feed(spark: SparkSession, path: str, tables: tuple[str, ...] = tuple(SCHEMAS)) -> Feed:
    """Feed directory to typed tables. Tables not asked for are not touched."""
    raw = {t: r for t in tables if (r := read_raw(spark, path, t)) is not None}
    out = {t: project(raw[t], t) if t in raw else empty_table(spark, t) for t in tables}
    return Feed(out, raw)


def rejects(raw: DataFrame, name: str) -> DataFrame:
    """Cells that could not be read: ``table, column, value, line_text`` with headers and values."""
    spec = SCHEMAS[name]
    names = list(spec)

    def bad(c: str) -> Column:
        kind, required = spec[c]
        empty = text.blank_to_null(F.col(c)).isNull()
        failed = ~empty & typed(F.col(c), kind).isNull()
        return failed | (empty & F.lit(required and kind != "str"))

    cells = F.array(*[F.when(bad(c), F.struct(F.lit(c).alias("column"), F.col(c).alias("value"))) for c in names])
    shown = F.concat_ws(",", *[F.concat(F.lit(c), F.lit("="), F.coalesce(F.col(c), F.lit(""))) for c in names])
    return raw.select(shown.alias("line_text"), F.explode(F.array_compact(cells)).alias("cell")).select(
        F.lit(name).alias("table"), "cell.column", "cell.value", "line_text"
    )


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """Files of a feed with size and sha256."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    name = F.regexp_extract("path", r"([^/]+(?:/part-[^/]+)?)$", 1)
    return files.select(name.alias("file"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def statistics(feed: Feed) -> DataFrame:
    """Rows per table."""
    counts = [d.agg(F.count("*").alias("rows")).select(F.lit(t).alias("table"), "rows") for t, d in feed.tables.items()]
    return reduce(DataFrame.unionByName, counts)


def read_feeds(spark: SparkSession, catalog: list[tuple[str, str]], tables: tuple[str, ...]) -> Feed:
    """Several feeds ``(path, city)`` as one set of tables with ``city`` and ``feed`` columns."""
    parts = []
    for path, city in catalog:
        feed = read_feed(spark, path, tables)
        parts.append({t: d.withColumns({"city": F.lit(city), "feed": F.lit(path)}) for t, d in feed.tables.items()})
    return Feed({t: reduce(DataFrame.unionByName, [p[t] for p in parts]) for t in tables})


def write_snapshot(feed: Feed, path: str, partition_by: tuple[str, ...] = ()) -> None:
    """Typed tables as Parquet, partitioned by the given columns where a table has them."""
    for name, df in feed.tables.items():
        by = [c for c in partition_by if c in df.columns]
        df.write.mode("overwrite").partitionBy(*by).parquet(f"{path}/{name}")


def read_snapshot(spark: SparkSession, path: str, tables: tuple[str, ...]) -> Feed:
    return Feed({t: spark.read.parquet(f"{path}/{t}") for t in tables})


def write_feed(feed: Feed, path: str) -> None:
    """Typed tables back in feed form."""
    for name, df in feed.tables.items():
        cells = [encoded(F.col(c), k).alias(c) for c, (k, _) in SCHEMAS[name].items() if c in df.columns]
        df.select(*cells).write.mode("overwrite").csv(f"{path}/{name}.txt", header=True, emptyValue="", escape='"')


def unknown_to_default(feed: Feed) -> Feed:
    """Codes outside the known lists become the default of their kind."""
    soft = {k for k, s in codes.CODES.items() if not s.strict and s.default is not None}
    out = {}
    for name, df in feed.tables.items():
        fixes = {
            c: codes.known_or_default(F.col(c), k)
            for c, (k, _) in SCHEMAS[name].items() if k in soft and c in df.columns
        }
        out[name] = df.withColumns(fixes) if fixes else df
    return feed.replace(**out)


def last_rows(feed_raw: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """One row per key, the last in file order."""
    rows = project(feed_raw, name, ("_line",))
    return last_per_key(rows, keys, ["_line"]).drop("_line")
