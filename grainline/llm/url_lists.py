"""URL filters with dated list entries (temporal list join).

A list is a log of entries (rule, action, category, at): ``block`` and
``allow`` put a rule in force from ``at`` on, ``remove`` ends it.  Entries
become validity intervals [at, next entry of the rule); an as-of join then
judges every capture by the entries in force when it was fetched.  A rule is a
host suffix (``example.com`` covers its subdomains) or a host with a path
prefix (``example.com/a/b``, whole segments).  The most specific rule decides:
paths before hosts, longer before shorter, allow before block.

The join is an equi-join on (rule, time bucket): intervals are listed under
each bucket they touch within the captures' time span, so a busy host's
captures spread over buckets (AQE splits what is still skewed) and a capture
meets only entries near its time.  Equal captures are one row with a count.

Defined cases: NULL or host-less urls and NULL fetch times match nothing
(verdict ``none``); of entries of one rule at one time the last by (remove,
allow, block) wins; NULL rules, actions or times in a list are ignored;
repeated entries count once, repeated captures each get the verdict; an empty
list gives ``none`` everywhere, empty captures an empty result.  Urls are whole,
however long; columns beyond those named are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

BUCKET_DAYS = 30
_HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]*)"
_PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*(/[^?#]*)"


def host_of(url: str) -> F.Column:
    return F.lower(F.regexp_extract(F.col(url).cast("string"), _HOST, 1))


def path_of(url: str) -> F.Column:
    return F.regexp_extract(F.col(url).cast("string"), _PATH, 1)


def validity_intervals(entries: DataFrame) -> DataFrame:
    """(rule, verdict, category, since, until): entries in force, in
    microseconds; until is NULL while the rule is still in force."""
    e = entries.select(F.rtrim(F.lower(F.col("rule")), F.lit("/")).alias("rule"), "action", "category",
                       F.unix_micros(F.col("at").cast("timestamp")).alias("since"))
    e = e.filter("rule is not null and rule <> '' and since is not null and action in ('block', 'allow', 'remove')")
    strength = F.when(F.col("action") == "remove", 2).when(F.col("action") == "allow", 1).otherwise(0)
    e = e.groupBy("rule", "since").agg(F.max(F.struct(strength.alias("s"), "action", "category")).alias("x"))
    e = e.withColumn("until", F.lead("since").over(W.partitionBy("rule").orderBy("since")))
    return e.filter("x.action <> 'remove'").select("rule", F.col("x.action").alias("verdict"), F.col("x.category").alias("category"), "since", "until")


def judge(captures: DataFrame, entries: DataFrame, url_col: str = "url", time_col: str = "fetched_at",
          keep: tuple[str, ...] = ("page_id",), bucket_days: int = BUCKET_DAYS) -> DataFrame:
    """The ``keep`` columns, url, fetched_at, verdict (block, allow, none) and
    the deciding rule, category and since (timestamp)."""
    width = bucket_days * 86_400_000_000
    ids = [f"k{i}" for i in range(len(keep))]
    caps = (captures.select(*[F.col(c).alias(k) for c, k in zip(keep, ids)], F.col(url_col).cast("string").alias("url"),
                            F.unix_micros(F.col(time_col).cast("timestamp")).alias("t"))
            .groupBy(*ids, "url", "t").agg(F.count(F.lit(1)).alias("copies")))
    rules = validity_intervals(entries)
    # how deep the list's rules go bounds the keys of a capture
    deep = rules.select(F.max(F.size(F.split(F.split_part("rule", F.lit("/"), F.lit(1)), r"\."))).alias("labels"),
                        F.max(F.size(F.split("rule", "/")) - 1).alias("depth")).first()
    span = captures.select(F.unix_micros(F.col(time_col).cast("timestamp")).alias("t")).agg(F.min("t").alias("a"), F.max("t").alias("b")).first()
    first, last = span["a"] or 0, span["b"] or 0
    rules = rules.filter((F.col("since") <= last) & (F.col("until").isNull() | (F.col("until") > first)))
    bucket = lambda c: F.floor(c / F.lit(width)).cast("long")
    rules = rules.withColumn("bucket", F.explode(F.sequence(
        bucket(F.greatest("since", F.lit(first))), bucket(F.least(F.coalesce("until", F.lit(last)), F.lit(last))))))
    labels, depth = int(deep["labels"] or 0), int(deep["depth"] or 0)
    parts, segs = F.col("parts"), F.col("segs")
    hosts = [F.when(F.size(parts) >= k, F.array_join(F.slice(parts, F.size(parts) - k + 1, k), ".")) for k in range(1, labels + 1)]
    paths = [F.when(F.size(segs) > d, F.concat(F.array_join(parts, "."), F.array_join(F.slice(segs, 1, d + 1), "/"))) for d in range(1, depth + 1)]
    # a path rule may be given for a parent host, too
    paths += [F.when((F.size(segs) > d) & (F.size(parts) > k), F.concat(F.array_join(F.slice(parts, F.size(parts) - k + 1, k), "."),
                                                                       F.array_join(F.slice(segs, 1, d + 1), "/")))
              for k in range(1, labels + 1) for d in range(1, depth + 1)]
    keyed = (caps.filter("t is not null").withColumn("host", host_of("url")).filter("host <> ''")
             .withColumn("parts", F.split("host", r"\.")).withColumn("segs", F.split(F.rtrim(F.lower(path_of("url")), F.lit("/")), "/"))
             .withColumn("rule", F.explode(F.array_distinct(F.array(*hosts, *paths, F.lit(None).cast("string"))))).filter("rule is not null")
             .withColumn("bucket", bucket(F.col("t"))))
    hit = keyed.join(rules, ["rule", "bucket"]).filter((F.col("since") <= F.col("t")) & (F.col("until").isNull() | (F.col("t") < F.col("until"))))
    weight = F.struct(F.size(F.split("rule", "/")).alias("depth"), F.size(F.split("rule", r"\.")).alias("labels"),
                      F.length("rule").alias("len"), "rule", "verdict", "category", "since")
    best = hit.select(*ids, "url", "t", "copies", weight.alias("best"))
    every = caps.withColumn("best", F.lit(None).cast(best.schema["best"].dataType)).unionByName(best)
    out = every.groupBy(*ids, "url", "t", "copies").agg(F.max("best").alias("best"))
    return (out.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
            .select(*[F.col(k).alias(c) for c, k in zip(keep, ids)], "url", F.timestamp_micros("t").alias("fetched_at"),
                    F.coalesce("best.verdict", F.lit("none")).alias("verdict"), F.col("best.rule").alias("rule"),
                    F.col("best.category").alias("category"), F.timestamp_micros("best.since").alias("since")))


def _number(text: F.Column, at: int) -> F.Column:
    """24 bits of the text's md5, from the hex digit ``at`` on."""
    return F.conv(F.substring(F.md5(text), at, 6), 16, 10).cast("long")


_START = "timestamp '2023-01-01 00:00:00 UTC'"


def _day(n: F.Column) -> F.Column:
    return F.expr(_START) + F.make_dt_interval(days=n.cast("int"))


def derived_captures(pages: DataFrame) -> DataFrame:
    """Pages with a fetch time in 2023 derived from page_id (the test tables
    have none)."""
    key = F.col("page_id").cast("string")
    return pages.select("page_id", "url", (_day(_number(key, 1) % 365) + F.make_dt_interval(secs=(_number(key, 7) % 86400).cast("decimal(18,6)"))).alias("fetched_at"))


def derived_list(pages: DataFrame) -> DataFrame:
    """A dated list over the pages' hosts: for two in five of them a host
    rule that is set, removed and set again; for one in five a path rule and a
    later allow of the host; for one in five a rule of the parent host."""
    hosts = pages.select(host_of("url").alias("host")).filter("host <> ''").distinct()
    h = F.col("host")
    kind, d = _number(h, 1) % 5, _number(h, 7) % 200
    row = lambda rule, action, category, day: F.struct(rule.alias("rule"), F.lit(action).alias("action"), F.lit(category).alias("category"), _day(day).alias("at"))
    parent = F.substring_index(h, ".", -3)
    return hosts.select(F.explode(
        F.when(kind <= 1, F.array(row(h, "block", "spam", d), row(h, "remove", "spam", d + 20 + _number(h, 13) % 40), row(h, "block", "malware", d + 100)))
        .when(kind == 2, F.array(row(F.concat(h, F.lit("/en")), "block", "adult", d), row(h, "allow", "reviewed", d + 30)))
        .when(kind == 3, F.array(row(parent, "block", "parked", d)))
        .otherwise(F.array())).alias("e")).select("e.*")


def url_filter_report(pages: DataFrame) -> DataFrame:
    df = judge(derived_captures(pages), derived_list(pages))
    return df.select("page_id", F.unix_seconds("fetched_at").alias("fetched_s"), "verdict", "rule", "category", F.unix_seconds("since").alias("since_s"))
