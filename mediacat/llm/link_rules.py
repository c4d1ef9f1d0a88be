"""Allow and block rules for the links of media items.

A host written from its top label down, ``net.example.www.``, begins with every domain it
belongs to, so a rule's domain is an interval of such keys. Links and rules are sorted
together by key, and one sweep keeps the rules around the current key on a stack: a rule is
pushed where its interval begins and popped where the next key leaves it. Intervals are
nested or apart, so the stack holds exactly the rules of the host.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mediacat.llm.components import lookup

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"


def link_host(url: Column) -> Column:
    """After the first ``://``, up to a slash, question mark or hash, A-Z in lower case."""
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 1), _UPPER, _LOWER)


def link_path(url: Column) -> Column:
    """What follows the host, up to a question mark or hash."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), _URL, 2)


def _key(host: Column) -> Column:
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def _bucket(key: Column) -> Column:
    """The two top labels of a key, or the one it has, without a dot at the end."""
    return F.substring_index(F.regexp_replace(key, r"\.$", ""), ".", 2)


def judge_links(media_items: DataFrame, rules: DataFrame, default: str = "allow") -> DataFrame:
    """(media_item_id, host, path, rule, verdict), one row per row of ``media_items``.

    ``rules`` has host, path and verdict. A rule fits its host and all subdomains where the
    path of media_google_url starts with the rule's. The longest rule, host and path
    together, wins; of equally long ones the deeper host; of two on the same host and path
    the verdict that is last in the alphabet. ``rule`` is the host and path of the winner,
    NULL where none fits and ``default`` holds. NULL links and such without ``://`` have an
    empty host and path and fit no rule. Rules with an empty or NULL host are ignored, a
    NULL path is an empty one. Repeated rows and NULL ids are kept. No rows, no rows.

    Rows are dealt by the two top labels of the host. A domain gets as many salts as it has
    shares of the rows, and its rules go to each, so one domain may hold any part of them.
    """
    spark = media_items.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    kind = media_items.schema["media_item_id"].dataType
    url = F.col("media_google_url")
    links = media_items.select(
        "media_item_id", link_host(url).alias("host"), link_path(url).alias("path"),
        F.pmod(F.xxhash64("media_google_url", "media_item_id"), F.lit(1 << 20)).alias("spread"),
    )
    links = links.withColumn("key", _key(F.col("host"))).withColumn("bucket", _bucket(F.col("key")))
    buckets = links.groupBy("bucket").agg(F.count("*").alias("n"))
    total = buckets.agg(F.sum("n")).first()[0] or 0
    salts = F.lit(1) + F.floor(F.col("n") * tasks / F.lit(max(total, 1)))
    buckets = buckets.withColumn("salts", salts.cast("int"))

    known = rules.select(
        F.translate("host", _UPPER, _LOWER).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "verdict"
    ).filter("host <> ''")
    known = known.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))
    known = known.withColumn("key", _key(F.col("host"))).withColumn("domain", _bucket(F.col("key")))
    deep = buckets.join(known, buckets.bucket == known.domain)
    top = buckets.join(
        known.filter(~F.contains("domain", F.lit("."))),
        F.substring_index("bucket", ".", 1) == F.col("domain"),
    ).filter(F.col("bucket") != F.col("domain"))
    placed = deep.unionByName(top).select(
        "bucket", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key",
        F.lit(0).alias("kind"), F.lit(None).cast(kind).alias("media_item_id"), "host", "path", "verdict",
    )
    salted = lookup(links, buckets, "bucket", total).select(
        "bucket", F.pmod("spread", F.col("salts")).cast("int").alias("salt"), "key",
        F.lit(1).alias("kind"), "media_item_id", "host", "path", F.lit(None).cast("string").alias("verdict"),
    )
    events = placed.unionByName(salted).repartition(tasks, "bucket", "salt")
    ordered = events.sortWithinPartitions("bucket", "salt", "key", "kind")
    schema = T.StructType(
        [T.StructField("media_item_id", kind)]
        + [T.StructField(n, T.StringType()) for n in ("host", "path", "rule", "verdict")]
    )

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, stack = None, []  # (key, path -> (rule, verdict), path lengths)
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("bucket", "salt", "key", "kind", "host", "path", "verdict")]
            took, out = [], []
            for i, (bucket, salt, key, kind, host, path, verdict) in enumerate(zip(*columns)):
                if group != (bucket, salt):
                    group, stack = (bucket, salt), []
                while stack and not key.startswith(stack[-1][0]):
                    stack.pop()
                if kind == 0:
                    if not stack or stack[-1][0] != key:
                        stack.append((key, {}, set()))
                    stack[-1][1][path] = (host + path, verdict)
                    stack[-1][2].add(len(path))
                    continue
                best = None
                for _, paths, lengths in stack:
                    fits = [n for n in lengths if n <= len(path) and path[:n] in paths]
                    if fits:
                        one = paths[path[: max(fits)]]
                        if best is None or len(one[0]) >= len(best[0]):
                            best = one
                took.append(i)
                out.append((host, path, *(best or (None, default))))
            made = list(zip(*out)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column("media_item_id").take(pa.array(took, pa.int64())), *(pa.array(c, pa.string()) for c in made)],
                names=schema.names,
            )

    return ordered.mapInArrow(sweep, schema)
