"""URL filters as a temporal list join, with DataFrame functions.

Dated list entries (domain, category, action, dated) become validity intervals;
every capture is judged by the entries active on the day it was fetched. Captures
are first reduced to their distinct (host, day), so a host with a third of all
captures is as many rows as it has days, and entries to one per domain, category
and day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import bitmap, in_bitmap, written

#: Captures of one host and day from which these are judged by broadcast, and host days of one listed domain from which these are
#: dealt over tasks. Where rows are so many that over MOST_HOT keys could be hot, the number is rows / MOST_HOT, so
#: what is broadcast has a bound.
HOT_ROWS, MOST_HOT = 100_000, 200_000


def host_of(url: Column) -> Column:
    """The lower-case host; '' where a URL is null or has none."""
    return F.coalesce(F.regexp_replace(F.regexp_extract(F.lower(url), r"^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]*)", 1), r"\.+$", ""), F.lit(""))


def suffixes(host: Column) -> Column:
    """The host and its parent domains."""
    parts = F.split(host, r"\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts) - i + 1), "."))


def intervals(entries: DataFrame) -> DataFrame:
    """domain, category, valid_from, valid_to (exclusive; null: still valid).

    action is 'add' or 'remove'; of several on one day a removal counts. Rows with a null domain, category
    or date are no entries.
    """
    daily = entries.filter("domain IS NOT NULL AND category IS NOT NULL AND dated IS NOT NULL").groupBy("domain", "category", "dated").agg(F.max("action").alias("action"))
    nexts = F.lead("dated").over(Window.partitionBy("domain", "category").orderBy("dated"))
    return daily.withColumn("valid_to", nexts).filter("action = 'add'").select("domain", "category", F.col("dated").alias("valid_from"), "valid_to")


def judged(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """captures (capture_id, url, fetched) with host, blocked, n_entries, categories; one row for each row.

    Null or odd URLs have host '' and aren't blocked; nor is a capture without a fetch day. Only the three
    named columns are read. Of the hosts' parent domains only those in the list are joined (a bitmap of bounded size
    leaves the others, such as a domain that most hosts lie under), and the host days of one that many hosts lie under are dealt
    over tasks, its entries going to each. Days with HOT_ROWS captures or more are judged by broadcast, and rows
    that need no look-up are spread, so no key is one task's. No entries block nothing; no captures give no rows.
    """
    rows = captures.select("capture_id", host_of(F.col("url")).alias("host"), F.col("fetched").cast("date").alias("fetched"))
    valid = written(intervals(entries), "intervals")
    days = written(rows.filter("host <> '' AND fetched IS NOT NULL").groupBy("host", "fetched").agg(F.count("*").alias("n")), "days")
    keyed = days.select("host", "fetched", F.explode(suffixes(F.col("host"))).alias("domain"))
    listed = written(valid.select(F.xxhash64("domain").alias("h")).distinct(), "listed")
    keyed = written(in_bitmap(keyed, F.xxhash64("domain"), bitmap(listed)), "keyed")
    hosts = keyed.count()
    large = max(HOT_ROWS, hosts // MOST_HOT)
    wide = keyed.groupBy("domain").agg(F.count("*").alias("n")).filter(F.col("n") >= large).select(F.col("domain").alias("wide"), F.ceil(F.col("n") / large).cast("int").alias("deals"))
    wide = written(wide, "wide-domains")
    dealt = keyed.join(F.broadcast(wide), F.col("domain") == F.col("wide"), "left").select("host", "fetched", "domain", F.pmod(F.xxhash64("host", "fetched"), F.coalesce("deals", F.lit(1))).cast("int").alias("deal"))
    valid = valid.join(F.broadcast(wide), F.col("domain") == F.col("wide"), "left").withColumn("deal", F.explode(F.sequence(F.lit(0), F.coalesce("deals", F.lit(1)) - 1))).drop("wide", "deals")
    active = dealt.join(valid, (dealt["domain"] == valid["domain"]) & (dealt["deal"] == valid["deal"]) & (dealt["fetched"] >= valid["valid_from"]) & (valid["valid_to"].isNull() | (dealt["fetched"] < valid["valid_to"])))
    verdict = written(active.groupBy("host", "fetched").agg(F.count("*").alias("n_entries"), F.array_join(F.array_sort(F.collect_set("category")), ",").alias("categories")), "verdicts")
    # there are no more hot days than MOST_HOT
    often = max(HOT_ROWS, (days.agg(F.sum("n")).first()[0] or 0) // MOST_HOT)
    hot = days.filter(F.col("n") >= often).select("host", "fetched").join(verdict, ["host", "fetched"], "left").select(F.col("host").alias("hot_host"), F.col("fetched").alias("hot_day"), F.struct("n_entries", "categories").alias("hot"))
    rows = rows.join(F.broadcast(hot), (F.col("host") == F.col("hot_host")) & (F.col("fetched") == F.col("hot_day")), "left")
    alone = F.col("hot_host").isNotNull() | (F.col("host") == "") | F.col("fetched").isNull()
    key = F.when(alone, F.concat(F.lit(" "), F.xxhash64("capture_id", "host").cast("string"))).otherwise(F.col("host"))
    found = verdict.select(F.col("host").alias("key"), F.col("fetched").alias("day"), F.struct("n_entries", "categories").alias("cold"))
    out = rows.withColumn("key", key).withColumn("day", F.coalesce("fetched", F.lit("1970-01-01").cast("date"))).join(found, ["key", "day"], "left")
    said = F.coalesce("hot", "cold")
    return out.select("capture_id", "host", "fetched", said["n_entries"].isNotNull().alias("blocked"), F.coalesce(said["n_entries"], F.lit(0)).alias("n_entries"), F.coalesce(said["categories"], F.lit("")).alias("categories"))


def derived_entries(pages: DataFrame) -> DataFrame:
    """A dated list for tables that have none: half of the pages' hosts and of their parents with three
    labels or more, with days, category and removals from the MD5 of the domain.

    Null and odd URLs give no entry, URLs of one host the same entries once, and no pages none."""
    domains = pages.select(host_of(F.col("url")).alias("host")).filter("host <> ''").distinct().select(F.explode(suffixes(F.col("host"))).alias("domain")).filter(F.size(F.split("domain", r"\.", -1)) >= 3).distinct()
    hashed = domains.withColumn("h", F.md5(F.col("domain").cast("binary")))
    digit = lambda at, n: F.conv(F.substring("h", at, n), 16, 10).cast("int")
    listed = hashed.filter(digit(1, 1) < 8).select("domain", F.element_at(F.array(F.lit("adult"), F.lit("malware"), F.lit("spam"), F.lit("gambling")), digit(2, 1) % 4 + 1).alias("category"), F.date_add(F.lit("2024-01-01").cast("date"), digit(3, 2)).alias("added"), digit(5, 1).alias("r"), digit(6, 2).alias("after"), digit(8, 1).alias("again"))
    moves = F.array(
        F.struct(F.lit("add").alias("action"), F.col("added").alias("dated")),
        F.when(F.col("r") < 8, F.struct(F.lit("remove").alias("action"), F.date_add("added", F.col("after") + 1).alias("dated"))),
        F.when((F.col("r") < 8) & (F.col("again") < 8), F.struct(F.lit("add").alias("action"), F.date_add("added", F.col("after") + 30).alias("dated"))),
    )
    return listed.select("domain", "category", F.explode(moves).alias("m")).filter("m IS NOT NULL").select("domain", "category", "m.action", "m.dated")
