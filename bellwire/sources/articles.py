"""Article payloads: fetch planning, page status, and ingest of JSON pages.

The HTTP client is the caller's; these functions plan its requests and take in its responses.
A stored response is one row: domain, slice_start, page, body.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bellwire.functions.text import source_from_domain, strip
from bellwire.functions.timez import canonical_or_empty, iso_z
from bellwire.operators.dedup import insert_or_ignore
from bellwire.schemas import ARTICLE_PAGE
from bellwire.session import materialise

PAGE_SIZE = 100
SLICE_DAYS = 7
FETCH = ["domain", "slice_start"]


def fetch_slices(bounds: DataFrame, domains: Sequence[str]) -> DataFrame:
    """Weekly slices of [start, end), the last one clipped, for every domain.

    ``bounds`` has one row (start, end). The domain list is configuration and is exploded from a
    literal, so no join is needed.
    """
    step = F.make_dt_interval(F.lit(SLICE_DAYS))
    starts = F.sequence(F.col("start").cast("timestamp_ntz"), F.col("end").cast("timestamp_ntz"), step)
    return (
        bounds.where(F.col("start") < F.col("end"))
        .select("end", F.explode(starts).alias("slice_start"))
        .where(F.col("slice_start") < F.col("end"))
        .withColumn("slice_end", F.least(F.col("slice_start") + step, F.col("end").cast("timestamp_ntz")))
        .select("slice_start", "slice_end", F.explode(F.array(*[F.lit(d) for d in domains])).alias("domain"))
    )


def fetch_plan(slices: DataFrame, totals: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """One row per page to request: ceil(total / page_size) pages for each domain and slice.

    ``totals`` (domain, slice_start, total) comes from the first response; no results, no pages.
    """
    pages = F.ceil(F.col("total") / F.lit(page_size)).cast("int")
    return (
        slices.join(totals, FETCH)
        .where(F.col("total") > 0)
        .select(
            "domain",
            iso_z(F.col("slice_start")).alias("from_iso"),
            iso_z(F.col("slice_end")).alias("to_iso"),
            F.explode(F.sequence(F.lit(1), pages)).alias("page"),
        )
    )


def parse_pages(responses: DataFrame) -> DataFrame:
    """Responses with ``status``, ``total_results`` (0 when absent), ``articles``, and ``ok``.

    A page is not ok when its JSON is broken, its status is not "ok", or it holds no articles.
    """
    parsed = responses.withColumn("_p", F.from_json("body", ARTICLE_PAGE)).drop("body")
    return parsed.select(
        *[c for c in parsed.columns if c != "_p"],
        F.col("_p.status").alias("status"),
        F.coalesce(F.col("_p.totalResults"), F.lit(0)).alias("total_results"),
        F.col("_p.articles").alias("articles"),
    ).withColumn(
        "ok",
        F.coalesce(F.col("status") == "ok", F.lit(False))
        & (F.coalesce(F.size("articles"), F.lit(0)) > 0),
    )


def accepted_status(responses: DataFrame) -> DataFrame:
    """Pages the service answered with status ok, with their reported totals."""
    pages = parse_pages(responses)
    return pages.where(F.col("status") == "ok").select(*FETCH, "page", "total_results")


def usable_pages(pages: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Pages a sequential fetch would have kept: a fetch stops before its first bad page.

    Fetching also ends at the page count announced on page 1. Both limits are pre-aggregated per
    fetch to a narrow table; stored, its true size lets Spark choose the join.
    """
    announced = F.ceil(F.col("total_results") / F.lit(page_size))
    limits = materialise(
        pages.groupBy(*FETCH).agg(
            F.min(F.when(~F.col("ok"), F.col("page"))).alias("_first_bad"),
            F.max(F.when((F.col("page") == 1) & (F.col("status") == "ok"), announced)).alias("_pages"),
        ),
        "fetch-limits",
    )
    before_bad = F.col("_first_bad").isNull() | (F.col("page") < F.col("_first_bad"))
    kept = pages.join(limits, FETCH).where(before_bad & (F.col("page") <= F.col("_pages")))
    return kept.drop("_first_bad", "_pages")


def ingest_articles(responses: DataFrame, page_size: int = PAGE_SIZE) -> DataFrame:
    """Articles with title, time and url all present, cleaned, in fetch order columns."""
    pages = usable_pages(parse_pages(responses), page_size)
    rows = pages.select(*FETCH, "page", F.posexplode("articles").alias("pos", "a"))
    return (
        rows.where(F.col("a.title").isNotNull())
        .select(
            source_from_domain("domain").alias("source"),
            strip(F.col("a.title")).alias("title"),
            canonical_or_empty(F.col("a.publishedAt")).alias("published_at"),
            F.coalesce(F.col("a.url"), F.lit("")).alias("url"),
            *FETCH,
            "page",
            "pos",
        )
        .where((F.col("title") != "") & (F.col("published_at") != "") & (F.col("url") != ""))
    )


def store_articles(target: DataFrame, articles: DataFrame) -> DataFrame:
    """New rows for the per-source tables, url unique within a source, first fetched wins."""
    order = F.struct("slice_start", "page", "pos")
    return insert_or_ignore(target, articles.withColumn("_at", order), ["source", "url"], "_at").drop("_at")
