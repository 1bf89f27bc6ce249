"""The walk over listing pages: from page to page by their Next links, and the adverts found on the way."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import defragment, origin, resolve_url
from ..sources.tables import stored
from .html import Count, Values, read_fields


def listing_links(pages: DataFrame, url: str, html: str, adverts: str, following: str) -> DataFrame:
    """page_url, adverts (links), nexts (links of the Next controls) and controls (how many there are) of each page."""
    rows = pages.select(F.col(url).alias("page_id"), F.col(html).alias("html"))
    found = read_fields(rows, adverts=Values(adverts, "href"), nexts=Values(following, "href"), controls=Count(following))
    return found.withColumnRenamed("page_id", "page_url")


def walk(starts: DataFrame, links: DataFrame, max_pages: int = 10, max_ads: int = 1000) -> tuple[DataFrame, DataFrame]:
    """What a run of each source finds, as (walks, adverts) (O1.3, O1.6).

    ``starts`` has source_id, start_no and start_url, ``links`` what ``listing_links`` gives (an address once). A start is followed
    from page to page, all starts at once, a written table for each step; pages that it has seen are known by a join with those
    tables. It stops, in this order, with ``repeated_page``, ``fetch_failed`` (no such page), ``max_pages``, ``end_of_pagination`` (no
    Next control), ``ambiguous_next_control`` (several with different addresses, or with and without one; fragments don't count),
    ``click_requires_browser`` (one without an address) or ``cross_origin_blocked``.

    walks: source_id, start_no, pages_visited, stop_reason. adverts: source_id, url, ordinal (from 1), page_number (the smallest one).
    Of a source's adverts, in the order of starts, pages and links, the first ``max_ads`` different ones count; what comes after
    the last of them isn't visited, and its start stops with ``max_ads``. No task holds a source's adverts: their order is cut per
    task first.
    """
    links = stored(links, "listing-links")
    start = F.struct("source_id", "start_no").alias("start")
    front = stored(starts.select(start, "start_url", F.col("start_url").alias("at_url")), "walk-front")
    steps: list[DataFrame] = []
    for step in range(max_pages):
        at = front.withColumn("seen", F.lit(False))
        if steps:
            seen = reduce(DataFrame.unionByName, [s.select("start", "at_url") for s in steps])
            at = front.join(seen.withColumn("seen", F.lit(True)), ["start", "at_url"], "left")
        at = at.join(links, F.col("at_url") == F.col("page_url"), "left")
        targets = F.array_distinct(F.transform("nexts", lambda h: defragment(resolve_url(F.col("at_url"), h))))
        one = (F.size("nexts") == F.col("controls")) & (F.size(targets) == 1)
        at = at.withColumn("next_url", F.when(one, F.get(targets, F.lit(0))))
        reason = (
            F.when(F.col("seen"), "repeated_page").when(F.col("page_url").isNull(), "fetch_failed").when(F.lit(step + 1 >= max_pages), "max_pages").when(F.col("controls") == 0, "end_of_pagination")
            .when(F.col("next_url").isNull() & (F.col("controls") > 1), "ambiguous_next_control").when(F.col("next_url").isNull(), "click_requires_browser")
            .when(origin(F.col("start_url")) != origin(F.col("next_url")), "cross_origin_blocked")
        )
        done = stored(at.select("start", F.lit(step).alias("step"), "start_url", "at_url", "adverts", "next_url", reason.alias("stop_reason")), "walk-step")
        steps.append(done)
        front = done.where("stop_reason is null").select("start", "start_url", F.col("next_url").alias("at_url"))
        if front.isEmpty():
            break
    whole = reduce(DataFrame.unionByName, steps)
    visited = whole.where("coalesce(stop_reason, '') not in ('repeated_page', 'fetch_failed')")

    source = F.struct("start.source_id").alias("source")
    found = visited.select("start", "step", F.posexplode("adverts").alias("place", "href"), "at_url")
    found = found.select(source, F.struct("start.start_no", "step", "place").alias("at"), resolve_url(F.col("at_url"), F.col("href")).alias("url"))
    found = stored(found, "walk-adverts")
    first = found.groupBy("source", "url").agg(F.min("at").alias("first_at"))
    first = first.withColumn("ordinal", F.row_number().over(Window.partitionBy("source").orderBy("first_at"))).where(F.col("ordinal") <= max_ads)
    first = stored(first, "walk-first")
    cut = first.where(F.col("ordinal") == max_ads).select("source", F.col("first_at").alias("cut"))
    number = found.join(cut, "source", "left").where(F.col("cut").isNull() | (F.col("at") <= F.col("cut")))
    number = number.groupBy("source", "url").agg((F.min("at.step") + 1).alias("page_number"))
    adverts = first.join(number, ["source", "url"]).select("source.source_id", "url", "ordinal", "page_number")

    rows = whole.withColumn("source", source).join(cut, "source", "left")
    rows = rows.where(F.col("cut").isNull() | (F.struct("start.start_no", "step") <= F.struct("cut.start_no", "cut.step")))
    here = (F.col("start.start_no") == F.col("cut.start_no")) & (F.col("step") == F.col("cut.step"))
    rows = rows.withColumn("stop_reason", F.when(F.coalesce(here, F.lit(False)), "max_ads").otherwise(F.col("stop_reason")))
    counted = F.count_if(~F.coalesce("stop_reason", F.lit("")).isin("repeated_page", "fetch_failed")).alias("pages_visited")
    walks = rows.groupBy("start").agg(counted, F.max_by("stop_reason", "step").alias("stop_reason"))
    return walks.select("start.*", "pages_visited", "stop_reason"), adverts
