"""Polite crawls: each host is asked at a fixed pace however many tasks fetch, and a crawl goes on where it stopped.

A host's URLs take numbered places.  Places are dealt over lanes, so no task holds a whole large host, and each lane
may send only in its own slots of wall-clock time: slot k of a host lasts ``pause`` seconds from the crawl's start
and belongs to lane k mod lanes.  So tasks need not talk to each other, and requests to a host start a pause apart.
A crawl runs in rounds of about ``round_seconds``; each appends its articles to the output, which is what has been
done when the crawl is started again.  The driver and the executors need clocks that agree within part of a pause.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..operators.tables import Shelf
from .web import SCRAPED, Response, article, page_of

Clients = tuple[Callable[[str], Response], Callable[[str], Iterable[str]]]
_KEPT = ("media_name", "publish_date", "title", "url")


def host_of(url: Column) -> Column:
    """The host of a URL, with its port, lower-cased; null without ``://``."""
    rest = F.regexp_extract(url, r"^[^/?#]*?://(?:[^/?#@]*@)?([^/?#]*)", 1)
    return F.when(F.contains(url, F.lit("://")), F.lower(rest))


def plan(urls: DataFrame, pause: float, round_seconds: float, lane_rows: int) -> DataFrame:
    """``urls`` (id, media_name, publish_date, title, url) with host, lanes, lane, turn (from 0) and round (from 0).

    A lane has about ``lane_rows`` rows.  URLs without a host, nulls among them, are dealt over lanes too.
    """
    rows = urls.select("id", *(F.col(c).cast("string").alias(c) for c in _KEPT)).withColumn("host", F.coalesce(host_of(F.col("url")), F.lit("")))
    sizes = rows.groupBy("host").agg(F.ceil(F.count(F.lit(1)) / lane_rows).cast("long").alias("lanes"))
    dealt = rows.join(sizes, "host").withColumn("lane", F.pmod(F.xxhash64("url", "id"), F.col("lanes")))
    turn = F.row_number().over(Window.partitionBy("host", "lane").orderBy("url", "id")) - 1
    place = F.col("turn").cast("double") * F.col("lanes") + F.col("lane")
    return dealt.withColumn("turn", turn).withColumn("round", F.floor(place * pause / round_seconds).cast("int"))


def _next_slot(now: float, start: float, last: int, lane: int, lanes: int, pause: float) -> int:
    """The first slot of a lane that begins at ``now`` or later and comes after slot ``last``."""
    least = max(math.ceil((now - start) / pause), last + 1, 0)
    return least + (lane - least) % lanes


def paced(rows: DataFrame, connect: Callable[[], Clients], start: float, pause: float, tasks: int) -> DataFrame:
    """id and the columns of ``web.SCRAPED`` of planned rows, each fetched in a slot of its lane."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get, snapshots = connect()
        last: dict = {}

        def paced_get(host: str, lane: int, lanes: int) -> Callable[[str], Response]:
            def ask(at: str) -> Response:
                slot = _next_slot(time.time(), start, last.get((host, lane), -1), lane, lanes, pause)
                last[host, lane] = slot
                time.sleep(max(0.0, start + slot * pause - time.time()))
                return get(at)

            return ask

        for pdf in batches:
            found = []
            for url, host, lane, lanes in zip(pdf["url"], pdf["host"], pdf["lane"], pdf["lanes"]):
                html = page_of(url, paced_get(host, lane, lanes), snapshots) if url is not None and host else None
                found.append(article(html))
            yield pdf[["id", *_KEPT]].assign(body=[f[0] for f in found], keywords=[f[1] for f in found], error=[f[2] for f in found])

    # turn by turn, so that a host's pause is spent on the other hosts of its task
    dealt = rows.repartition(tasks, "host", "lane").sortWithinPartitions("turn", "host", "lane")
    kind = dict(rows.dtypes)["id"]
    return dealt.select("id", *_KEPT, "host", "lane", "lanes").mapInPandas(run, f"id {kind}, {SCRAPED}")


def finished(output: str, like: DataFrame) -> DataFrame | None:
    """id and url of what a crawl has written to ``output``; None before its first round."""
    spark = like.sparkSession
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(output)
    if not target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(target):
        return None
    return spark.read.schema(f"id {dict(like.dtypes)['id']}, {SCRAPED}").parquet(output).select("id", "url")


def crawl(urls: DataFrame, output: str, connect: Callable[[], Clients], pause: float = 1.0, round_seconds: float = 600.0, lane_rows: int = 10_000, tasks: int | None = None, most_rounds: int | None = None) -> DataFrame:
    """Scrape ``urls`` (id, media_name, publish_date, title, url) into Parquet at ``output`` and return that table.

    ``connect`` gives, once a task, the client and the lister of archived snapshots; give clients that don't wait
    themselves.  Archived pages are asked for in the slots of the page's own host.  Rows whose (id, url) the output
    has are not fetched again, failures included; a task that is lost fetches its part of the round again, and a
    round that is lost leaves nothing.  A null or hostless url keeps its row with an error.  ``most_rounds`` ends a
    crawl early.  Repeated rows of one crawl are fetched each.
    """
    spark = urls.sparkSession
    shelf = Shelf(spark, "crawl")
    done = finished(output, urls)
    todo = urls
    if done is not None:
        keys = done.select(F.col("id").alias("_id"), F.col("url").alias("_url")).distinct()
        todo = urls.join(keys, F.col("id").eqNullSafe(F.col("_id")) & F.col("url").cast("string").eqNullSafe(F.col("_url")), "left_anti")
    planned = shelf.keep(plan(todo, pause, round_seconds, lane_rows).repartitionByRange("round", "host", "lane"))
    rounds = (planned.agg(F.max("round").alias("r")).first()["r"] or 0) + 1
    tasks = tasks or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    for k in range(rounds if most_rounds is None else min(rounds, most_rounds)):
        # a round starts after the last slot that the one before may have used
        paced(planned.where(F.col("round") == k), connect, time.time() + pause, pause, tasks).write.mode("append").parquet(output)
    shelf.clear()
    return spark.read.schema(f"id {dict(urls.dtypes)['id']}, {SCRAPED}").parquet(output)
