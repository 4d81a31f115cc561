"""The daily analysis as one plan over all file dates, its outputs and its report."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.operators import listings, observations, quality, windows
from tidemark.plans.versions import Published


@dataclass
class Analysis:
    """The results of typed observations (file_date, src_row, ...); each is planned when it is first asked for."""

    rows: DataFrame
    aliases: DataFrame | None = None
    schedule: DataFrame | None = None
    settings: Settings = Settings()

    @cached_property
    def normal(self) -> DataFrame:
        return observations.normalize(self.rows, self.aliases)

    @cached_property
    def cleaned(self) -> DataFrame:
        return observations.clean(self.normal, self.settings)

    @cached_property
    def ready(self) -> DataFrame:
        return observations.resolve(self.cleaned)

    @cached_property
    def rides(self) -> DataFrame:
        return observations.ride_profiles(self.normal, self.settings)

    @cached_property
    def singles(self) -> DataFrame:
        return observations.single_rider_profiles(self.normal)

    @cached_property
    def gaps(self) -> DataFrame | None:
        return windows.collection_gaps(self.normal, self.schedule) if self.schedule is not None else None


def analyze(rows: DataFrame, aliases: DataFrame | None = None, schedule: DataFrame | None = None, settings: Settings = Settings()) -> Analysis:
    return Analysis(rows, aliases, schedule, settings)


def flat(rows: DataFrame) -> DataFrame:
    """For text files: flags joined, ages with one decimal, nulls empty."""
    out = rows.withColumn("quality_flags", F.concat_ws("|", "quality_flags")).withColumn("source_age_minutes", F.format_string("%.1f", F.col("age_tenths") / 10))
    return out.withColumn("source_age_minutes", F.when(F.col("age_tenths").isNull(), "").otherwise(F.col("source_age_minutes"))).drop("age_tenths", "age_ms")


def write(found: Analysis, folder: str, dry_run: bool = False) -> None:
    """Cleaned and optimizer-ready rows, partitioned by file date, as CSV; the report as JSON. Other dates that are there stay. A dry run computes and keeps nothing."""
    for name, rows in (("cleaned", found.cleaned), ("optimizer_ready", found.ready)):
        if dry_run:
            rows.write.format("noop").mode("overwrite").save()
        else:
            flat(rows).write.partitionBy("file_date").mode("overwrite").options(partitionOverwriteMode="dynamic", header=True, emptyValue="", nullValue="", escape='"').csv(f"{folder}/{name}")
    if not dry_run:
        report(found).write.mode("overwrite").json(f"{folder}/report")


def report(found: Analysis) -> DataFrame:
    """A row per file date: the summaries as structs, counts of groups, recommendations. Listings stay tables of their own."""
    day = lambda df, name: df.groupBy("file_date").agg(F.first(F.struct(*[c for c in df.columns if c != "file_date"])).alias(name))
    parks = quality.park_summary(found.cleaned, found.settings)
    by_park = parks.groupBy("file_date").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("park_id", F.struct(*[c for c in parks.columns if c not in ("file_date", "park_id")]))))).alias("by_park"))
    rides = found.rides.groupBy("file_date").agg(F.count_if("possible_full_day_closed").alias("full_day_closed"), F.count_if("temporary_downtime").alias("downtime"))
    stale = quality.stale_sources(found.cleaned, found.settings).groupBy("file_date").agg(F.count(F.lit(1)).alias("stale_sources"))
    groups = lambda keys, name: found.cleaned.groupBy("file_date", *keys).count().where("count > 1").groupBy("file_date").agg(F.count(F.lit(1)).alias(name))
    doubled = groups(["snapshot_ts", "park_id", "name"], "duplicate_groups")
    claimed = groups(["snapshot_ts", "park_id", "canonical_id", "access_mode"], "conflict_groups")
    out = day(quality.summary(found.cleaned, found.settings), "summary")
    for part in (day(quality.optimizer_summary(found.ready), "optimizer"), day(quality.single_rider_summary(found.singles), "single_rider"), by_park, rides, doubled, claimed, stale, quality.recommendations(found.cleaned, found.ready, found.singles, found.settings)):
        out = out.join(part, "file_date", "left")
    if found.gaps is not None:
        gaps = found.gaps.groupBy("file_date").agg(F.count_if(F.col("state") == "missing").alias("missing_snapshots"), F.count_if(F.col("state") == "unexpected").alias("unexpected_snapshots"))
        out = out.join(gaps, "file_date", "left")
    return out


#: Rows of a listing on a page; a line says how many more there are.
PAGE_ROWS = 1000


def listed(found: Analysis) -> dict[str, DataFrame]:
    """The listings that a report's page has, in their orders, each with file_date."""
    out = {
        "Single Rider": listings.single_riders_in_order(found.singles).select("file_date", "park_id", "base_ride_name", "total_rows", "open_rows", "positive_wait_rows", "zero_wait_rows", "optimizer_use"),
        "Possible full-day closed rides": listings.full_day_closed(found.rides).select("file_date", "park_id", "ride_name", "total_rows", "closed_rows", "closed_ratio"),
        "Temporary downtime candidates": listings.downtimes(found.rides).select("file_date", "park_id", "ride_name", "transitions", "open_rows", "closed_rows"),
        "Stale sources": listings.stale_in_order(quality.stale_sources(found.cleaned, found.settings)),
    }
    if found.gaps is not None:
        out["Park snapshots against the schedule"] = found.gaps.where("state <> 'as_expected'").select("file_date", "snapshot_ts", "park_id", "state").orderBy("file_date", "snapshot_ts", "park_id")
    return out


def page(found: Analysis, date: str, rows: int = PAGE_ROWS) -> str:
    """The Markdown page of one date with its listings. Figures are counts and a listing has ``rows`` rows at most, so little goes to the driver."""
    row = report(found).where(F.col("file_date") == date).first()
    if row is None:
        raise LookupError(f"no rows of {date}")
    lines = [markdown(row).rstrip("\n")]
    for title, listing in listed(found).items():
        mine = listing.where(F.col("file_date") == date).drop("file_date")
        said = mine.limit(rows + 1).collect()
        if said:
            heads = [c.replace("_", " ").capitalize() for c in mine.columns]
            lines += ["", f"## {title}", "", f"| {' | '.join(heads)} |", f"|{' --- |' * len(heads)}", *[f"| {' | '.join(_cell(v) for v in r)} |" for r in said[:rows]]]
        if len(said) > rows:
            lines += ["", f"{mine.count() - rows} more are not shown."]
    return "\n".join(lines) + "\n"


def _cell(value) -> str:
    return str(value).replace("|", "\\|").replace("\n", " ")


def publish(found: Analysis, folder: str) -> Published:
    """Cleaned and optimizer-ready rows and the report as one version: all of them or none, dates that aren't analysed stay as they were."""
    store = Published(found.rows.sparkSession, folder)
    tables = {"cleaned": found.cleaned, "optimizer_ready": found.ready, "report": report(found)}
    store.publish(tables, by={k: "file_date" for k in tables})
    return store


def markdown(row) -> str:
    """One report row as a page. It has a line per figure, so it stays small whatever the rows it counts."""
    told = row.asDict(recursive=True)
    lines = [f"# Wait-time quality report: {told['file_date']}"]
    for title in ("summary", "optimizer", "single_rider"):
        lines += ["", f"## {title.replace('_', ' ').capitalize()}", ""]
        lines += [f"- {k.replace('_', ' ').capitalize()}: {v}" for k, v in (told[title] or {}).items()]
    parks = told["by_park"] or {}
    heads = list(next(iter(parks.values()), {}))
    lines += ["", "## By park", "", f"| Park | {' | '.join(heads)} |", f"| --- |{' ---: |' * len(heads)}"]
    lines += [f"| {park} | {' | '.join(str(v) for v in counts.values())} |" for park, counts in parks.items()]
    issues = ("duplicate_groups", "conflict_groups", "stale_sources", "full_day_closed", "downtime", "missing_snapshots", "unexpected_snapshots")
    lines += ["", "## Data issues", "", *[f"- {k.replace('_', ' ').capitalize()}: {told[k] or 0}" for k in issues if k in told]]
    lines += ["", "## Recommendations", "", *[f"- {x}" for x in told["recommendations"]]]
    return "\n".join(lines) + "\n"
