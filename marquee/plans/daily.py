"""The daily run: every source staged into one listing, audited, deduplicated and published."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee import config
from marquee.config import RunParams
from marquee.operators import audit, dedup, fallback, intake, quarantine
from marquee.plans import publish
from marquee.schema import STAGED, to_listing
from marquee.session import cut
from marquee.sources import api, artifacts, pages, sheet, venues


@dataclass
class Source:
    """One audited source: its staged rows, or why there are none."""

    name: str
    rank: int
    staged: DataFrame | None = None
    success: bool = True
    error: str | None = None
    empty_message: str | None = None


@dataclass
class Landing:
    """Where a run's inputs lie; a missing place is not an error unless the source says so."""

    ticketing: str | None = None
    sheets: list[tuple[str, str]] = field(default_factory=list)
    artifacts: str | None = None
    keep_hours: int | None = None              # read only artifacts not older than this
    responses: DataFrame | None = None
    venue_pages: DataFrame | None = None       # venue_key, origin, html; fetch_error where landing failed
    profiles: DataFrame | None = None          # further page profiles
    failed_venues: dict[str, str] = field(default_factory=dict)   # venue_key -> message
    second_api: str | None = None
    marketplace: DataFrame | None = None       # origin, html
    city_page: DataFrame | None = None
    newspaper: DataFrame | None = None         # origin, html, endpoint_rank


FLAGS = ["found", "kept", "filtered"]


def materialised(staged: DataFrame) -> DataFrame:
    return cut(to_listing(staged, *FLAGS))


def guarded(name: str, rank: int, build, prefix: str = "Unexpected error: ", empty: str | None = None) -> Source:
    """A source whose input cannot be read becomes a failed audit row; the run goes on.

    The source is worked out here, into the checkpoint folder, so that errors of its rows show here as well.
    """
    try:
        return Source(name, rank, materialised(build()), empty_message=empty)
    except Exception as e:
        return Source(name, rank, success=False, error=f"{prefix}{str(e)[:100]}")


def collect_sources(spark: SparkSession, landing: Landing, p: RunParams) -> list[Source]:
    out = []
    if landing.ticketing is None:
        out.append(Source(config.TICKETING_API, 0, success=False, error=config.MSG_NO_TICKETING_KEY))
    else:
        out.append(guarded(config.TICKETING_API, 0, lambda: api.stage_ticketing(api.read_payloads(spark, landing.ticketing))))
    found, _ = sheet.first_sheet(spark, landing.sheets)
    if found is None:
        out.append(Source(config.SHEET, 1, error=config.MSG_NO_SHEET))
    else:
        out.append(guarded(found.source_name, 1, lambda: sheet.stage_sheet(found, p), empty=config.MSG_EMPTY_SHEET))
    out.append(_artifact_source(spark, landing, p))
    if landing.venue_pages is not None or landing.failed_venues:
        out.extend(_venue_sources(spark, landing, p))
    rank = venues.FIRST_RANK + len(config.VENUES)
    if landing.second_api is not None:
        out.append(guarded(config.SECOND_API, rank, lambda: api.stage_second(api.read_payloads(spark, landing.second_api), rank)))
    for kind, name, df, empty in [("marketplace", config.MARKETPLACE, landing.marketplace, config.MSG_EMPTY_MARKETPLACE),
                                  ("city_page", config.CITY_PAGE, landing.city_page, config.MSG_EMPTY_CITY_PAGE),
                                  ("newspaper", config.NEWSPAPER, landing.newspaper, None)]:
        rank += 1
        if df is not None:
            s = guarded(name, rank, lambda df=df, kind=kind, name=name, rank=rank: stage_endpoints(venues.tagged_pages(df, kind, name, rank), p), empty=empty)
            if kind == "newspaper" and s.staged is not None and s.staged.isEmpty():
                s = Source(name, rank, s.staged, success=False, error=config.MSG_NEWSPAPER_DOWN, empty_message=empty)
            out.append(s)
    return out


def stage_endpoints(tagged: DataFrame, p: RunParams) -> DataFrame:
    """Staged pages of sources with alternate addresses: per source, the first address that yields an event."""
    staged = cut(pages.stage_pages(tagged, p))
    return fallback.first_yielding(staged, ["source_rank"], "endpoint_rank", F.col("found")).drop("endpoint_rank")


def _artifact_source(spark: SparkSession, landing: Landing, p: RunParams) -> Source:
    if landing.artifacts is None and landing.responses is None:
        return Source(config.ARTIFACTS, 2, error=config.MSG_NO_ARTIFACT_DIR)

    def build() -> DataFrame:
        parts = []
        if landing.artifacts is not None:
            # images are never opened; files past their keeping time are left out before they are read
            web, archives = (intake.retained(artifacts.list_artifacts(spark, landing.artifacts, suffixes), F.lit(p.run_ts).cast("timestamp"), landing.keep_hours) if landing.keep_hours
                             else artifacts.list_artifacts(spark, landing.artifacts, suffixes) for suffixes in (artifacts.PAGES, artifacts.ARCHIVES))
            parts.append(pages.stage_pages(artifacts.artifact_pages(web, archives), p).drop("endpoint_rank"))
        if landing.responses is not None:
            parts.append(artifacts.stage_responses(landing.responses, p))
        return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

    return guarded(config.ARTIFACTS, 2, build)


def _venue_sources(spark: SparkSession, landing: Landing, p: RunParams) -> list[Source]:
    """All venues from one plan; a page that fails fails its own venue."""
    staged, broken, failed = None, None, {}
    if landing.venue_pages is not None:
        try:
            events = cut(pages.page_events(venues.venue_pages(landing.venue_pages), p.year, landing.profiles))
            failed = {r["source_rank"]: r["error"] for r in pages.page_errors(events).where("n_failed > 0").collect()}  # at most one row for each venue
            staged = materialised(pages.stage_events(events, p).drop("endpoint_rank"))
        except Exception as e:  # the pages themselves cannot be read
            broken = f"Parse error: {str(e)[:80]}"
    out = []
    for r in venues.calendar_sources(spark).orderBy("source_rank").collect():
        message = landing.failed_venues.get(r["venue_key"])
        error = f"Request failed: {message[:80]}" if message is not None else broken or failed.get(r["source_rank"])
        # the staged rows of all venues are attached to the first of them
        out.append(Source(r["source_name"], r["source_rank"], staged, success=error is None, error=error, empty_message=config.MSG_EMPTY_VENUE))
        staged = None
    return out


def bad_records(spark: SparkSession, landing: Landing, p: RunParams) -> DataFrame:
    """What the adapters of a run cannot use (``quarantine.BAD``). A source that cannot be read at all has a failed audit row instead."""
    def of_sheet() -> DataFrame:
        found, _ = sheet.first_sheet(spark, landing.sheets)
        return spark.createDataFrame([], quarantine.BAD) if found is None else sheet.bad_rows(found, p)

    rank = venues.FIRST_RANK + len(config.VENUES)
    makers = [of_sheet]
    if landing.ticketing is not None:
        makers.append(lambda: api.bad_ticketing(api.read_payloads(spark, landing.ticketing)))
    if landing.second_api is not None:
        makers.append(lambda: api.bad_second(api.read_payloads(spark, landing.second_api), rank))
    if landing.venue_pages is not None:
        makers.append(lambda: pages.bad_scripts(venues.venue_pages(landing.venue_pages)))
    for n, (kind, name, df) in enumerate([("marketplace", config.MARKETPLACE, landing.marketplace), ("city_page", config.CITY_PAGE, landing.city_page),
                                          ("newspaper", config.NEWSPAPER, landing.newspaper)], 1):
        if df is not None:
            makers.append(lambda df=df, kind=kind, name=name, n=n: pages.bad_scripts(venues.tagged_pages(df, kind, name, rank + n)))
    parts = []
    for make in makers:
        try:
            parts.append(cut(make()))
        except Exception:  # noqa: S112  its audit row says why
            continue
    return quarantine.union(spark, parts)


@dataclass
class Run:
    """What a run yields: tables, not yet written anywhere."""

    params: RunParams
    listing: DataFrame
    staged: DataFrame
    audit: DataFrame
    deduped: DataFrame
    totals: DataFrame
    bad: DataFrame | None = None


def assemble(spark: SparkSession, sources: list[Source], p: RunParams) -> Run:
    """Union the sources (each kept in the checkpoint folder already, since audit and deduplication both read it)."""
    dim = spark.createDataFrame([(s.name, s.rank, s.success, s.error, s.empty_message) for s in sources], audit.SOURCE_DIM)
    parts = [s.staged for s in sources if s.staged is not None]
    if parts:
        staged = to_listing(parts[0], *FLAGS)
        for x in parts[1:]:
            staged = staged.unionByName(to_listing(x, *FLAGS))
    else:
        staged = spark.createDataFrame([], STAGED)
    listing = to_listing(staged.where("kept"))
    rows = cut(audit.source_audit(staged, F.broadcast(dim), F.lit(p.run_ts)))
    deduped = cut(dedup.deduplicate(listing))
    return Run(p, listing, staged, rows, deduped, audit.run_totals(rows, deduped))


def write(run: Run, out: str) -> dict[str, int]:
    """Write the marts and documents under ``out``; each document is its part files in order. Returns the number of bad records by reason."""
    p, seen = run.params, {}
    if run.bad is not None:
        bad, counts = quarantine.counted(run.bad)
        bad.write.mode("overwrite").parquet(f"{out}/bad_records")
        seen = dict(counts.get)
    # the place of an act in its block depends on the plan that found it: not part of the mart
    run.deduped.drop("slot").write.mode("overwrite").partitionBy("date").parquet(f"{out}/listing")
    run.audit.write.mode("overwrite").parquet(f"{out}/audit")
    audit.source_health(run.audit).write.mode("overwrite").parquet(f"{out}/health")
    audit.failures(run.audit).write.mode("overwrite").parquet(f"{out}/failures")
    audit.run_header(p, run.totals).write.mode("overwrite").parquet(f"{out}/totals")
    publish.rss_feed(run.deduped, "Listings", "").write.mode("overwrite").text(f"{out}/rss")
    publish.by_day(run.deduped).write.mode("overwrite").parquet(f"{out}/by_day")
    publish.page(p, run.totals, audit.source_health(run.audit), run.deduped, "Listings").write.mode("overwrite").text(f"{out}/page")
    publish.text_summary(run.deduped).write.mode("overwrite").text(f"{out}/summary")
    publish.run_log(p, run.totals, run.audit, run.deduped).write.mode("overwrite").text(f"{out}/log")
    publish.json_feed(p, run.deduped).write.mode("overwrite").text(f"{out}/feed")
    publish.stamps(p, run.deduped.sparkSession).write.mode("overwrite").parquet(f"{out}/stamps")
    return seen


def run_daily(spark: SparkSession, landing: Landing, p: RunParams, out: str | None = None) -> Run:
    """A whole run; without ``out`` it is a dry run that writes nothing."""
    run = assemble(spark, collect_sources(spark, landing, p), p)
    run.bad = bad_records(spark, landing, p)
    if out is not None:
        write(run, out)
    return run
