"""Crawl dataflow as tables: the fetch log's filters, links and their priorities, the frontier, metrics.

The frontier advances by whole levels or priority batches, not one address at a time. A
step anti-joins what it finds with what is known, and is written before the next, so its
plan doesn't grow with the crawl.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from peneira.config import Config
from peneira.dims import SOFT_404
from peneira.functions import urls
from peneira.functions.html import hrefs
from peneira.session import durable


# Filters of the fetch log -------------------------------------------------------------------------


def good_status(status: Column) -> Column:
    """Below 400; a missing status isn't good."""
    return F.coalesce(status < 400, F.lit(False))


def html_content(content_type: Column) -> Column:
    """No content type, or one that says text/html."""
    return (F.coalesce(content_type, F.lit("")) == "") | F.contains(F.lower(content_type), F.lit("text/html"))


def soft_404(html: Column) -> Column:
    """Whether a served page says that it was not found, anywhere in its markup."""
    return F.coalesce(F.lower(html).rlike("|".join(SOFT_404)), F.lit(False))


def fetch_outcome(status: Column, content_type: Column, html: Column) -> Column:
    """'ok', or why a response is dropped; the first reason counts."""
    return F.when(~good_status(status), "status").when(~html_content(content_type), "content_type").when(soft_404(html), "soft_404").otherwise("ok")


def robots_allowed(pages: DataFrame, rules: DataFrame) -> DataFrame:
    """pages (url, among others) with `allowed`: the longest matching rule of their origin decides, allow before disallow; without a match all is allowed.

    rules: origin, kind ('allow' or 'disallow'), path; * stands for anything and $ for the end. An empty path matches nothing.
    """
    origin = F.concat(urls.scheme(F.col("url")), F.lit("://"), F.lower(urls.part(F.col("url"), "AUTHORITY")))
    path = F.concat(F.coalesce(urls.part(F.col("url"), "PATH"), F.lit("/")), F.coalesce(F.concat(F.lit("?"), urls.part(F.col("url"), "QUERY")), F.lit("")))
    quoted = F.regexp_replace(F.col("path"), r"([.+?^(){}\[\]|\\])", r"\\$1")
    pattern = F.concat(F.lit("^"), F.regexp_replace(quoted, r"\*", ".*"))
    of_origin = rules.where(F.coalesce("path", F.lit("")) != "").groupBy("origin").agg(F.collect_set(F.struct(F.length("path").alias("n"), (F.col("kind") == "allow").alias("allow"), pattern.alias("pattern"))).alias("rules"))
    joined = pages.withColumn("__origin", origin).join(of_origin.withColumnRenamed("origin", "__origin"), "__origin", "left").withColumn("__path", path)
    hits = F.filter(F.coalesce("rules", F.array().cast("array<struct<n:int,allow:boolean,pattern:string>>")), lambda r: F.regexp_like(F.col("__path"), r["pattern"]))
    return joined.withColumn("allowed", F.coalesce(F.array_max(hits)["allow"], F.lit(True))).select(*pages.columns, "allowed")


def rate_schedule(requests: DataFrame, host: str, order_by: str, per_second: int = 15) -> DataFrame:
    """requests with `second`: the whole second, from the host's first, in which a host's limit lets each start.

    A host of very many requests is numbered in buckets of its order column (whole seconds of a timestamp, or the value itself), so no task holds a host.
    """
    bucket = F.col(order_by).cast("timestamp").cast("bigint") if dict(requests.dtypes)[order_by].startswith("timestamp") else F.floor(F.col(order_by) / 10_000)
    tagged = requests.withColumn("__bucket", bucket)
    sums = tagged.groupBy(host, "__bucket").agg(F.count("*").alias("__n"))
    before = W.partitionBy(host).orderBy("__bucket").rowsBetween(W.unboundedPreceding, -1)
    starts = sums.select(host, "__bucket", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    tie = F.xxhash64(*[F.col(c).cast("string") for c in requests.columns])
    place = F.row_number().over(W.partitionBy(host, "__bucket").orderBy(order_by, tie)) - 1
    out = tagged.withColumn("__place", place).join(starts, [host, "__bucket"])
    return out.withColumn("second", F.floor((F.col("__start") + F.col("__place")) / per_second).cast("bigint")).select(*requests.columns, "second")


# Links --------------------------------------------------------------------------------------------


def page_links(pages: DataFrame, url: str = "url", html: str = "html", keep: tuple[str, ...] = ()) -> DataFrame:
    """(page, pos, url, kept columns): each page's links, resolved, each once at its first place; links that cannot be resolved are left out. Runs on the page's row."""
    resolved = F.transform(hrefs(F.col(html)), lambda h: urls.resolve(F.col(url), h))
    return pages.select(F.col(url).alias("page"), *keep, F.posexplode(F.array_distinct(F.filter(resolved, lambda x: x.isNotNull()))).alias("pos", "url"))


def link_tasks(links: DataFrame, config: Config = Config(), priority: str = "priority", depth: str = "depth") -> DataFrame:
    """(page, url, depth, priority): tasks of the crawlable links of pages that bear priority and depth.

    The first link_limit links of a page get the page's priority less one decay, the j-th further one another j decays less, or none if only the first are processed.
    A page's links are ranked among themselves only.
    """
    valid = links.where(urls.is_http(F.col("url")) & ~urls.is_blocked(F.col("url")))
    rank = F.row_number().over(W.partitionBy("page").orderBy("pos"))
    next_ = F.coalesce(F.col(priority), F.lit(config.initial_priority)) - config.priority_decay
    n = F.lit(config.link_limit if config.link_limit > 0 else 2**31 - 1)
    out = valid.withColumn("__rank", rank).select(
        "page",
        "url",
        (F.coalesce(F.col(depth), F.lit(0)) + 1).alias("depth"),
        F.when(F.col("__rank") <= n, next_).otherwise(next_ - (F.col("__rank") - n) * config.priority_decay).alias("priority"),
        "__rank",
    )
    return (out if config.process_all_links else out.where(F.col("__rank") <= n)).drop("__rank")


# Frontier -----------------------------------------------------------------------------------------


def enqueue(tasks: DataFrame, known: DataFrame, config: Config = Config()) -> DataFrame:
    """The tasks that enter the frontier: canonical, within depth, crawlable, not known yet; of several for one address the first by ordinal.

    tasks: url, depth, priority, ord. known: url (visited or queued).
    """
    new = tasks.withColumn("url", urls.canonical(F.col("url"))).where(F.col("url").isNotNull() & (F.coalesce("depth", F.lit(0)) <= config.max_depth) & ~urls.is_blocked(F.col("url")))
    first = new.groupBy("url").agg(F.min_by(F.struct("depth", "priority", "ord"), "ord").alias("t")).select("url", "t.*")
    return first.join(known.select("url"), "url", "left_anti")


def pop(queue: DataFrame, n: int, strategy: str = "priority") -> DataFrame:
    """The next n tasks: by priority (ties by ordinal), the newest first (dfs), or the oldest first (bfs)."""
    order = {"priority": [F.coalesce("priority", F.lit(0.0)).desc(), F.col("ord")], "dfs": [F.col("ord").desc()], "bfs": [F.col("ord")]}[strategy]
    return queue.orderBy(*order).limit(n)


def _levels(seeds: DataFrame, links: DataFrame, last: int) -> Iterator[tuple[int, DataFrame, int]]:
    """(level, its new addresses, their number), level by level until none is new or the last is reached.

    One step a level; each is written to the checkpoint folder, so its plan stays short and a lost executor costs no earlier step.
    """
    usable = urls.is_http(F.col("raw")) & ~urls.is_blocked(F.col("raw"))
    edges = links.select(urls.canonical(F.col("page")).alias("page"), F.col("url").alias("raw"), urls.canonical(F.col("url")).alias("url")).where(F.col("url").isNotNull() & usable)
    edges = durable(edges.select("page", "url").distinct())
    level = durable(seeds.select(urls.canonical(F.col("url")).alias("url")).where(F.col("url").isNotNull() & ~urls.is_blocked(F.col("url"))).distinct())
    seen, n = level, 0
    while found := level.count():
        yield n, level, found
        if n >= last:
            return
        n += 1
        reached = level.select(F.col("url").alias("page")).join(edges, "page").select("url").distinct()
        level = durable(reached.join(seen, "url", "left_anti"))
        seen = seen.unionByName(level)


def _placed(level: DataFrame, n: int) -> DataFrame:
    return level.select("url", F.lit(n).alias("level"))


def crawl_levels(seeds: DataFrame, links: DataFrame, config: Config = Config(), max_levels: int | None = None) -> DataFrame:
    """(url, level): every address reached from the seeds by the link table (page, url) within the depth, at its least level. Addresses are canonical."""
    out = seeds.select(F.col("url"), F.lit(0).alias("level")).limit(0)
    for n, level, _ in _levels(seeds, links, config.max_depth if max_levels is None else min(max_levels, config.max_depth)):
        out = out.unionByName(_placed(level, n))
    return out


def crawl_run(seeds: DataFrame, links: DataFrame, config: Config = Config(), max_seconds: float = 0.0, clock: Callable[[], float] = time.monotonic) -> tuple[DataFrame, str]:
    """A whole crawl: (url, level) of the pages processed, and why it stopped: 'max_pages', 'runtime_limit' or 'frontier_empty'.

    Tested between levels; the level that reaches max_pages is cut by address. max_seconds 0 is no limit. Addresses beyond the depth never enter.
    """
    began, pages, reason = clock(), 0, "frontier_empty"
    out = seeds.select(F.col("url"), F.lit(0).alias("level")).limit(0)
    for n, level, found in _levels(seeds, links, config.max_depth):
        if max_seconds > 0 and clock() - began >= max_seconds:
            return out, "runtime_limit"
        left = config.max_pages - pages
        out = out.unionByName(_placed(level if found <= left else level.orderBy("url").limit(left), n))
        pages += found
        if pages >= config.max_pages:
            return out, "max_pages"
    return out, reason


def snapshot(queue: DataFrame, visited: DataFrame, path: str) -> None:
    """Write the frontier as two tables."""
    queue.write.mode("overwrite").parquet(f"{path}/queue")
    visited.write.mode("overwrite").parquet(f"{path}/visited")


def restored(queue: DataFrame, visited: DataFrame) -> tuple[DataFrame, DataFrame]:
    """A frontier from its snapshot: addresses canonical again, blocked ones dropped; repeated ones are kept, as they were."""
    again = lambda df: df.withColumn("url", urls.canonical(F.col("url"))).where(F.col("url").isNotNull() & ~urls.is_blocked(F.col("url")))
    return again(queue), again(visited).select("url").distinct()


# Metrics ------------------------------------------------------------------------------------------


def source_breakdown(tasks: DataFrame, url: str = "url") -> DataFrame:
    """(host, pages) of the tasks done without an error."""
    done = tasks.where(~F.coalesce("failed", F.lit(False))) if "failed" in tasks.columns else tasks
    return done.groupBy(urls.hostname_or_unknown(F.col(url)).alias("host")).agg(F.count("*").alias("pages"))


def crawl_metrics(tasks: DataFrame, at: str = "fetched_at", failed: Column | None = None) -> DataFrame:
    """One row: pages_processed (every task), error_count, matches_found (always 0, as the original counts none), seconds (1 at least), pages_per_second."""
    f = F.lit(False) if failed is None else failed
    micros = F.unix_micros(F.max(at)) - F.unix_micros(F.min(at))
    seconds = F.greatest(F.lit(1.0), F.coalesce(micros / 1_000_000, F.lit(0.0)))
    return tasks.agg(
        F.count("*").alias("pages_processed"),
        F.count_if(f).alias("error_count"),
        F.lit(0).cast("bigint").alias("matches_found"),
        F.round(seconds, 3).alias("seconds"),
        F.round(F.count("*") / seconds, 6).alias("pages_per_second"),
    )
