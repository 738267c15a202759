"""URL filters: host-suffix and path-prefix rules, matched by hashed expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import named

#: Columns of the result besides those that are kept.
RESULT = ("host", "path", "rule", "verdict")
#: Rules are broadcast up to this many; beyond it the same join is shuffled on the hash prefix.
BROADCAST_RULES = 200_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first :// up to / ? # or the end, A-Z lower-cased; path: from there up to ? # or the end. Both empty without ://."""
    at = F.coalesce(F.locate("://", url), F.lit(0))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    raw = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substr(rest, F.length(raw) + 1), r"^[^?#]*", 0)
    return F.translate(raw, UPPER, LOWER), path


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url", keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """Judge every url by rules(host, path, verdict).

    A rule fits its host and all subdomains where the url's path starts with the rule's. Each url expands into
    the expressions host suffix + path prefix that it has itself and whose label count and prefix length occur among the
    rules; they meet the rules by an equi-join on the first 8 hex digits of their SHA-256, and the whole digest is compared
    next. Of several rules the longest wins (then the longer host, then block). A url has at most its labels times its
    path's lengths that rules have, however many rules there are; a hot host or a very long url costs no more than any other.

    Null or malformed urls: host and path are empty, no rule fits, the verdict is the default. Repeated rows and
    repeated or null keys are judged one by one. Empty tables give empty results; without rules all get the default.
    Columns of pages in `keep` come back, under any name but those of the result, which replace them; other columns are ignored. Rules with a null host or path are ignored; repeated rules count once.
    """
    text = F.concat("host", "path")
    book = (
        rules.select("host", "path", "verdict").dropna(subset=["host", "path"]).groupBy("host", "path").agg(F.max_by("verdict", F.col("verdict") == "block").alias("verdict"))
        .select(text.alias("rule"), "verdict", F.length("host").alias("host_len"), F.size(F.split("host", r"\.")).alias("labels"), F.length("path").alias("path_len"))
    )
    shape = book.agg(F.collect_set("labels").alias("labels"), F.collect_set("path_len").alias("lens"), F.count(F.lit(1)).alias("n")).first()
    book = book.select("rule", F.col("verdict").alias("_v"), "host_len", F.sha2("rule", 256).alias("_digest"))
    book = book.withColumn("_short", F.substring("_digest", 1, 8))
    if shape["n"] <= BROADCAST_RULES:
        book = F.broadcast(book)
    host, path = host_and_path(named(url))
    keep = tuple(c for c in keep if c.lower() not in RESULT)
    kept = [f"_k{i}" for i in range(len(keep))]
    rows = pages.select(*[named(c).alias(k) for c, k in zip(keep, kept)], host.alias("host"), path.alias("path")).withColumn("_row", F.monotonically_increasing_id())
    numbers = lambda xs: F.array(*map(F.lit, sorted(xs))) if xs else F.array().cast("array<int>")
    own = lambda xs, size: F.filter(numbers(xs), lambda x: x <= size)
    heads = F.transform(own(shape["lens"], F.length("path")), lambda m: F.substr("path", F.lit(1), m))
    tails = F.transform(own(shape["labels"], F.size(F.split("host", r"\."))), lambda k: F.call_function("substring_index", F.col("host"), F.lit("."), -k))
    rows = rows.withColumns({"_heads": heads, "_tails": tails})
    keys = F.flatten(F.transform("_tails", lambda t: F.transform("_heads", lambda h: F.concat(t, h))))
    rows = rows.withColumn("_key", F.explode_outer(keys)).drop("_heads", "_tails")
    rows = rows.withColumn("_full", F.sha2("_key", 256))
    hit = rows.join(book, (F.substring("_full", 1, 8) == F.col("_short")), "left").withColumn("_fits", (F.col("_full") == F.col("_digest")) & (F.col("host") != ""))
    best = F.max(F.when(F.col("_fits"), F.struct(F.length("rule").alias("a"), F.col("host_len").alias("b"), (F.col("_v") == "block").alias("c"), "rule", "_v"))).alias("_best")
    out = hit.groupBy("_row", *kept, "host", "path").agg(best)
    return out.select(*[F.col(k).alias(c) for c, k in zip(keep, kept)], "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best._v", F.lit(default)).alias("verdict"))
