"""Ingestion of landed payload documents whose variables are not known beforehand.

A document is a JSON object with ``location_name``, the axis ``time_start, time_end, interval_s`` (epoch seconds, end
exclusive) and any number of arrays, one value per step. Every document is either accepted or comes
out with a reason; none stops the run and none is lost.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivo import config
from nivo.operators import frames
from nivo.sources.payloads import _local

AXIS = ("time_start", "time_end", "interval_s")
RESERVED = ("location_name", *AXIS)

# What a document is put aside for, tested in this order.
REASONS = (
    "malformed",
    "location_missing",
    "axis_invalid",
    "series_missing",
    "series_uneven",
    "value_invalid",
    "location_unknown",
)

#: Epoch seconds of the years 1 to 9999, which dates and times can hold.
FIRST_SECOND, LAST_SECOND = -62_135_596_800, 253_402_300_799
#: No measured value is beyond this; what is, like NaN, is no number of the series.
MOST_VALUE = 1e9


def _array(value: Column) -> Column:
    return F.try_variant_get(value, "$", "array<variant>")


def _number(value: Column) -> Column:
    number = F.try_variant_get(value, "$", "double")
    return F.when(F.abs(number) <= MOST_VALUE, number)


def inspect(raw: DataFrame, locations: DataFrame | None = None, value: str = "value") -> DataFrame:
    """One row per document: key, axis, ``series`` (name to values), ``reason`` or NULL, and the text itself.

    All documents are judged in one pass. Members that are arrays are series; other members are
    left alone. JSON nulls are missing values. With ``locations`` (``name``, ``latitude``,
    ``longitude``, ``elevation``) their attributes are added and unknown names are a reason; of several rows
    of a name the least is used. A NULL text is malformed; equal texts have equal keys. Other columns are kept.
    """
    text = F.col(f"`{value}`")
    parsed = raw.withColumns(
        {
            "document_id": F.substring(F.sha2(F.coalesce(text, F.lit("")), 256), 1, 16),
            "_doc": F.try_parse_json(text),
        }
    ).withColumns(
        {
            "_members": F.try_variant_get("_doc", "$", "map<string,variant>"),
            "location_name": F.try_variant_get("_doc", "$.location_name", "string"),
            **{name: F.try_variant_get("_doc", f"$.{name}", "bigint") for name in AXIS},
        }
    )
    arrays = F.map_filter(
        "_members", lambda name, member: ~name.isin(*RESERVED) & _array(member).isNotNull()
    )
    listed = parsed.withColumn("_arrays", F.transform_values(arrays, lambda name, member: _array(member)))
    start, end, step = (F.col(name) for name in AXIS)
    within = [t.between(FIRST_SECOND, LAST_SECOND) for t in (start, end)]
    sound = within[0] & within[1] & (end > start) & step.between(1, LAST_SECOND)
    steps = F.when(sound, F.ceil((end - start) / step))
    lists = F.map_values("_arrays")
    uneven = F.exists(lists, lambda a: F.size(a).cast("long") != F.col("_steps"))
    strange = F.exists(lists, lambda a: F.exists(a, lambda v: ~F.is_variant_null(v) & _number(v).isNull()))
    found = [
        F.col("_members").isNull(),
        F.coalesce(F.trim("location_name"), F.lit("")) == "",
        F.col("_steps").isNull(),
        F.size("_arrays") == 0,
        uneven,
        strange,
    ]
    unknown = F.lit(False)
    judged = listed.withColumn("_steps", steps)
    if locations is not None:
        place = F.struct("latitude", "longitude", "elevation")
        places = locations.groupBy(F.col("name").alias("location_name")).agg(F.min(place).alias("_place"))
        judged = judged.join(places, "location_name", "left")
        unknown = F.col("_place").isNull()
    reason = F.lit(None).cast("string")
    for name, condition in reversed(list(zip(REASONS, [*found, unknown]))):
        reason = F.when(condition, name).otherwise(reason)
    series = F.transform_values("_arrays", lambda name, values: F.transform(values, _number))
    placed = ["_place.latitude", "_place.longitude", "_place.elevation"] if locations is not None else []
    extra = [F.col(f"`{c}`") for c in raw.columns if c != value]
    return judged.withColumn("reason", reason).select(
        "document_id",
        *extra,
        "location_name",
        *placed,
        *AXIS,
        F.when(F.col("reason").isNull(), series).alias("series"),
        "reason",
        text.alias("value"),
    )


def accepted(inspected: DataFrame) -> DataFrame:
    return inspected.where("reason is null").drop("reason", "value")


def quarantine(inspected: DataFrame) -> DataFrame:
    """The documents put aside, with the reason and the text, to be landed again once mended."""
    return inspected.where("reason is not null").select("document_id", "location_name", "reason", "value")


def reconcile(inspected: DataFrame) -> DataFrame:
    """Documents per outcome, ``accepted`` or a reason; the counts add up to the input."""
    outcome = F.coalesce("reason", F.lit("accepted")).alias("outcome")
    return inspected.groupBy(outcome).agg(F.count(F.lit(1)).alias("documents"))


def variables(raw: DataFrame, value: str = "value") -> DataFrame:
    """Every member name that occurs in a document that is an object, with documents and type.

    Each object is exploded into its members; types are merged over all documents, so a number
    that is a text somewhere shows.
    """
    parsed = raw.select(F.try_parse_json(F.col(f"`{value}`")).alias("_doc"))
    objects = parsed.where(F.try_variant_get("_doc", "$", "map<string,variant>").isNotNull())
    members = objects.lateralJoin(raw.sparkSession.tvf.variant_explode(F.col("_doc").outer()).alias("member"))
    return members.groupBy(F.col("member.key").alias("variable")).agg(
        F.count(F.lit(1)).alias("documents"), F.schema_of_variant_agg("member.value").alias("type")
    )


def _utc(step: Column) -> Column:
    seconds = F.col("time_start") + step * F.col("interval_s")
    return F.timestamp_add("SECOND", seconds, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def rows(
    documents: DataFrame, known: Sequence[str], tz: str | Column = config.LOCAL_TIMEZONE, hourly: bool = False
) -> DataFrame:
    """One row per time step of accepted documents: a column per known variable, NULL where a document lacks it.

    Times are local wall-clock times of ``tz``: daily rows have ``date``, hourly ones ``timestamp`` and ``date``.
    Documents may overlap: of several rows for a location and time that of the greatest
    ``landed`` (if there is such a column), then of the greatest key stays. In the hour that a
    zone puts its clocks back two steps share a local time; both stay, told apart by ``step_utc``.
    """
    landed = [F.desc("landed")] if "landed" in documents.columns else []
    keep = [c for c in documents.columns if c not in (*AXIS, "series")]
    lengths = F.transform(F.map_values("series"), F.size)
    axis = F.sequence(F.lit(0), F.array_max(lengths) - 1)
    stepped = documents.select(*keep, *AXIS[::2], "series", F.explode(axis).alias("_step"))
    values = [F.get(F.try_element_at("series", F.lit(name)), F.col("_step")).alias(name) for name in known]
    flat = stepped.select(*keep, _utc(F.col("_step")).alias("step_utc"), *values)
    local = _local(F.col("step_utc"), tz)
    if hourly:
        timed = flat.withColumns({"timestamp": local, "date": local.cast("date")})
        return frames.newest_per_key(timed, ["location_name", "step_utc"], [*landed, F.desc("document_id")])
    timed = flat.withColumn("date", local.cast("date"))
    return frames.newest_per_key(timed, ["location_name", "date"], [*landed, F.desc("document_id"), F.desc("step_utc")])


def other_series(documents: DataFrame, known: Sequence[str], tz: str | Column = config.LOCAL_TIMEZONE) -> DataFrame:
    """The series that no column is made for, long: location, local time, variable and value (missing ones left out)."""
    rest = F.map_filter("series", lambda name, values: ~name.isin(*known))
    each = documents.select("location_name", *AXIS[::2], F.explode(rest).alias("variable", "_values"))
    stepped = each.select("*", F.posexplode("_values").alias("_step", "value"))
    return stepped.where("value is not null").select(
        "location_name", _local(_utc(F.col("_step")), tz).alias("timestamp"), "variable", "value"
    )
