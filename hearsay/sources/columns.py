"""JSON columns of stored reports, both ways, by declared schemas; and manifests of runs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The JSON columns of a report. Times are written with their offset, in whole seconds.
_BUCKET = "struct<start:timestamp,up:bigint,down:bigint>"
COLUMNS = {
    "narrative": "struct<prose:string,spans:array<struct<start:int,end:int,text:string,kind:string,value:double,review_id:string>>>",
    "histogram": f"struct<app_id:bigint,rollup_unit:string,rollups:array<{_BUCKET}>,recent_daily:array<{_BUCKET}>,past_events:array<struct<event_type:int,start:timestamp,end:timestamp>>,fetched_at:timestamp>",
    "episodes": "array<struct<start:timestamp,end:timestamp,buckets:int,reviews:bigint,peak_multiple:double,overlaps_marked_window:boolean>>",
    "language_mix": "array<struct<language:string,count:bigint>>",
    "marked_windows": "array<struct<start:timestamp,end:timestamp,members_inside:bigint>>",
    "fetch_windows": "array<struct<start:timestamp,end:timestamp,outcome:string>>",
}
#: What must be there in each entry; a payload without it is refused.
_NEEDED = {
    "episodes": ("start", "end", "buckets", "reviews", "peak_multiple", "overlaps_marked_window"), "language_mix": ("language", "count"), "marked_windows": ("start", "end", "members_inside"),
    "fetch_windows": ("start", "end", "outcome"),
}
_TIMES = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ssxxx"}


def encoded(column: str, value: Column) -> Column:
    """A report's column as JSON; nulls inside are written, a null column stays null."""
    return F.to_json(value.cast(COLUMNS[column]), {**_TIMES, "ignoreNullFields": "false"})


def decoded(column: str, payload: Column) -> Column:
    """The column back; JSON that is broken, of another shape, or lacks a field that must be there, fails. Null stays null."""
    read = F.from_json(payload, COLUMNS[column], {**_TIMES, "mode": "FAILFAST"})
    if column in _NEEDED:
        lacks = F.exists(read, lambda x: F.greatest(*(x[c].isNull() for c in _NEEDED[column])))
    else:
        lacks = F.greatest(*(read[c].isNull() for c in (("prose", "spans") if column == "narrative" else ("app_id", "rollup_unit", "rollups", "recent_daily", "past_events", "fetched_at"))))
    return F.when(payload.isNull(), None).when(F.coalesce(lacks, F.lit(True)), F.raise_error(F.lit(f"{column} lacks a field")).cast(COLUMNS[column])).otherwise(read)


def encode_report(reports: DataFrame) -> DataFrame:
    return reports.withColumns({c: encoded(c, F.col(c)) for c in COLUMNS if c in reports.columns})


def decode_report(rows: DataFrame) -> DataFrame:
    return rows.withColumns({c: decoded(c, F.col(c)) for c in COLUMNS if c in rows.columns})


def measurement_lines(summaries: DataFrame, cell: tuple[str, ...]) -> DataFrame:
    """line: one JSON object for each cell and aspect, intervals nested. A cell without a stratified interval says null.

    summaries: the cell's columns, aspect and what was measured; wilson_, bootstrap_ and stratified_ coverage and mean_width become objects.
    """
    kinds = ("wilson", "bootstrap", "stratified")
    flat = [c for c in summaries.columns if c not in cell and not c.startswith(tuple(f"{k}_" for k in kinds))]
    nested = []
    for k in kinds:
        both = [F.col(f"{k}_{c}") if f"{k}_{c}" in summaries.columns else F.lit(None).cast("double") for c in ("coverage", "mean_width")]
        nested.append(F.when(both[0].isNotNull(), F.struct(both[0].alias("coverage"), both[1].alias("mean_width"))).alias(k))
    return summaries.select(F.to_json(F.struct(*cell, *flat, *nested), {**_TIMES, "ignoreNullFields": "false"}).alias("line"))


def write_manifest(metrics: DataFrame, folder: str) -> None:
    """One run's metrics, one row, as one JSON file; there must be none yet."""
    rows = metrics.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a manifest is one row")
    metrics.coalesce(1).write.mode("errorifexists").option("ignoreNullFields", "false").json(folder)
