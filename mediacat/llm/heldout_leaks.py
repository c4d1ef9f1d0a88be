"""Held-out texts that occur in captions.

Every place where a caption and a held-out text share a shingle puts a window of that text's
size over the caption. Windows and held-out texts get SimHash fingerprints of their weighted
shingles. A multi-index of fingerprint blocks finds every pair within the radius: of two
fingerprints that differ in at most ``radius`` bits, one of four blocks differs in at most
a fourth of them. The held-out side lists all block values that near, so the join is by
equality on window width, block and value. Weighted shingle similarity then decides. A window without a shared shingle has
similarity 0, so leaving out such windows loses nothing.

Built-in functions only. Captions are read once, and only windows are shuffled, equal ones
once.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

from mediacat.llm.components import lookup
from mediacat.llm.license_notices import notice_words
from mediacat.session import checkpointed

SHINGLE_WORDS = 5
_FIELD_BITS = 26
_BROADCAST_ROWS = 200_000
_BITS = 64
_BLOCKS = 4
_BLOCK_BITS = _BITS // _BLOCKS


def _hash_at(size: int):
    return lambda i: F.xxhash64(*[F.get("w", i + j) for j in range(size)])


def _shingles(size: int) -> Column:
    """Hash of the shingle at each word of column w, none where it has too few words."""
    starts = F.sequence(F.lit(0), F.size("w") - size)
    return F.when(F.size("w") >= size, F.transform(starts, _hash_at(size))).otherwise(F.array().cast("array<bigint>"))


def held_out_shingles(held_out: DataFrame) -> DataFrame:
    """(item, item_id, w, size, hashes) of the held-out texts that have words.

    A text of fewer words than a shingle is one shingle of its own size. ``item`` tells
    different texts under one id apart; repeated rows count once.
    """
    split = held_out.select("item_id", notice_words(F.col("text")).alias("w")).filter("size(w) > 0")
    items = split.distinct().withColumn("item", F.xxhash64("item_id", F.array_join("w", " ")))
    hashes = F.lit(None).cast("array<bigint>")
    for size in range(1, SHINGLE_WORDS + 1):
        hashes = F.when(F.least(F.size("w"), F.lit(SHINGLE_WORDS)) == size, _shingles(size)).otherwise(hashes)
    return items.select("item", "item_id", "w", F.least(F.size("w"), F.lit(SHINGLE_WORDS)).alias("size"), hashes.alias("hashes"))


def _bit_field(seeds: DataFrame, count: int) -> tuple[Column, int]:
    """A literal array of longs with two bits set for each hash, and the number of its bits.

    It has 64 bits or more for each of ``count`` hashes, up to a fixed number of bits (8 MB),
    and only spares work: with five million hashes 2 % of all others pass it.
    """
    bits = 1 << min(_FIELD_BITS, max(16, (64 * count).bit_length()))
    slots = F.array(*[_slot(F.col("hash"), probe, bits) for probe in (0, 1)])
    words = seeds.select(F.explode(slots).alias("slot")).select(
        F.shiftright("slot", 6).alias("id"), F.expr("shiftleft(1L, int(slot & 63))").alias("bit")
    ).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    found = words.toArrow()  # at most the fixed number of words
    field = np.zeros(bits // 64, np.int64)
    field[found.column("id").to_numpy()] = found.column("bits").to_numpy()
    # one text that Spark turns into the array while planning: a list would pass number by number
    return F.split(F.lit(",".join(map(str, field.tolist()))), ",").cast("array<bigint>"), bits


def _slot(h: Column, probe: int, bits: int) -> Column:
    return F.shiftright(h, 32 * probe).bitwiseAND(bits - 1)


def _in_field(field: Column, bits: int, h: Column) -> Column:
    def is_set(slot: Column) -> Column:
        return F.getbit(F.get(field, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(63).cast("int")) == 1
    return is_set(_slot(h, 0, bits)) & is_set(_slot(h, 1, bits))


def caption_windows(media_items: DataFrame, items: DataFrame) -> DataFrame:
    """(media_item_id, row, start, width, words): windows of captions that share a shingle
    with a held-out text of ``width`` words, aligned to it, cut at the ends of the caption."""
    seeds = items.select(
        F.size("w").alias("width"), "size", F.posexplode("hashes").alias("q", "hash")
    ).distinct()
    seeds = checkpointed(seeds)
    count = seeds.count()
    bounds = seeds.agg(F.max("width").alias("w"), F.collect_set("size").alias("sizes")).first()
    widest, sizes = bounds.w or 0, sorted(bounds.sizes)
    field, bits = _bit_field(seeds, count)
    row = F.xxhash64("media_item_id", "google_description")
    split = media_items.select(
        "media_item_id", row.alias("row"), notice_words(F.col("google_description")).alias("w")
    )
    hashed = split.select("media_item_id", "row", "w", *[_shingles(k).alias(f"h{k}") for k in sizes])

    def marked(k: int) -> Column:
        spot = lambda h, i: F.when(_in_field(field, bits, h), F.struct(i.alias("at"), h.alias("hash"), F.lit(k).alias("size")))
        return F.array_compact(F.transform(f"h{k}", spot))

    places = F.concat(*map(marked, sizes)) if sizes else F.array().cast("array<struct<at:int,hash:bigint,size:int>>")
    found = hashed.select("media_item_id", "row", "w", places.alias("places"))
    # words around the place, so that every window over it can be cut from them; explode
    # would have Spark work out the places once more in a filter, explode_outer has not
    begin = F.greatest(F.col("p.at") - widest, F.lit(0))
    around = found.select("media_item_id", "row", "w", F.explode_outer("places").alias("p")).filter("p IS NOT NULL").select(
        "media_item_id", "row", F.col("p.at").alias("at"), F.col("p.hash").alias("hash"), F.col("p.size").alias("size"),
        begin.alias("begin"), F.slice("w", begin + 1, F.lit(2 * widest + SHINGLE_WORDS)).alias("words"),
    )
    if count <= _BROADCAST_ROWS:
        seeds = F.broadcast(seeds)
    start = F.greatest(F.col("at") - F.col("q"), F.lit(0))
    end = F.col("at") - F.col("q") + F.col("width")
    windows = around.join(seeds, ["hash", "size"]).select(
        "media_item_id", "row", start.alias("start"), "width",
        F.slice("words", start - F.col("begin") + 1, end - start).alias("words"),
    )
    return windows.groupBy("row", "media_item_id", "start", "width").agg(F.first("words").alias("words"))


def fingerprints(texts: DataFrame, weights: DataFrame, unseen: float) -> DataFrame:
    """(key, fingerprint) of (key, hashes): the SimHash of the weighted shingles."""
    rows = texts.select("key", F.explode(F.array_distinct("hashes")).alias("hash"))
    weighed = rows.join(weights, "hash", "left").withColumn("weight", F.coalesce("weight", F.lit(unseen)))
    bit = [F.sum(F.when(F.getbit("hash", F.lit(b)) == 1, F.col("weight")).otherwise(-F.col("weight"))).alias(f"b{b}") for b in range(_BITS)]
    summed = weighed.groupBy("key").agg(*bit)
    signs = F.concat(*[F.when(F.col(f"b{b}") > 0, F.lit("1")).otherwise(F.lit("0")) for b in reversed(range(_BITS))])
    high, low = F.conv(F.substring(signs, 1, 32), 2, 10).cast("bigint"), F.conv(F.substring(signs, 33, 32), 2, 10).cast("bigint")
    return summed.select("key", F.shiftleft(high, 32).bitwiseOR(low).alias("fingerprint"))


def _block(name: str, i: int) -> Column:
    return F.shiftrightunsigned(name, i * _BLOCK_BITS).bitwiseAND((1 << _BLOCK_BITS) - 1)


def _reach(radius: int) -> int:
    """Bits that the nearest of the blocks differs in at most."""
    return radius // _BLOCKS


def meetings(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """(key, item, fingerprint, other, block): prints of one width with a block in common
    up to ``_reach(radius)`` bits. A pair may meet in several blocks."""
    near = [m for m in range(1 << _BLOCK_BITS) if m.bit_count() <= _reach(radius)]
    values = F.array(*[_block("fingerprint", i) for i in range(_BLOCKS)])
    a = left.select("key", "width", "fingerprint", F.posexplode(values).alias("block", "value"))
    own = F.array(*[_block("other", i) for i in range(_BLOCKS)])
    b = right.select("item", "width", F.col("fingerprint").alias("other")).select(
        "item", "width", "other", F.posexplode(own).alias("block", "exact")
    ).select("item", "width", "other", "block", "exact", F.explode(F.lit(near)).alias("change"))
    b = b.select("item", "width", "other", "block", F.col("exact").bitwiseXOR(F.col("change")).alias("value"))
    return a.join(b, ["width", "block", "value"]).select("key", "item", "fingerprint", "other", "block")


def within_radius(left: DataFrame, right: DataFrame, radius: int) -> DataFrame:
    """(key, item) of all fingerprints of ``left`` and ``right`` of one width within ``radius`` bits.

    A pair that meets in several blocks is reported at the first of them only.
    """
    differ = F.col("fingerprint").bitwiseXOR(F.col("other"))
    first = F.lit(_BLOCKS)
    for i in reversed(range(_BLOCKS)):
        first = F.when(F.bit_count(_block("differ", i)) <= _reach(radius), F.lit(i)).otherwise(first)
    met = meetings(left, right, radius).withColumn("differ", differ)
    return met.filter((F.bit_count("differ") <= radius) & (first == F.col("block"))).select("key", "item")


def find_leaks(
    media_items: DataFrame, held_out: DataFrame, similarity: float = 0.8, radius: int = 15
) -> DataFrame:
    """(media_item_id, item_id, start, n_words, similarity): held-out texts in captions.

    ``held_out`` has item_id and text. A row says that the words of the caption
    (google_description) from ``start`` on have at least ``similarity`` with the text:
    weights of common shingles over weights of all shingles of both, where a shingle has
    ``SHINGLE_WORDS`` words and weighs more the fewer texts have it. Words are compared
    without case and punctuation. Found for sure are windows whose fingerprints are within
    ``radius`` of the text's; equal ones are at distance 0. NULL and empty captions and
    texts leak nothing; captions with equal ids and texts are reported once; NULL ids are
    kept. No captions or no texts, no rows. Other columns are ignored.
    """
    items = checkpointed(held_out_shingles(held_out))
    total = items.count()
    frequency = items.select(F.explode(F.array_distinct("hashes")).alias("hash")).groupBy("hash").agg(F.count("*").alias("df"))
    weights = checkpointed(frequency.select("hash", (1 + F.log((F.lit(total) + 1) / (F.col("df") + 1))).alias("weight")))
    unseen = 1 + math.log(total + 1)  # the weight of a shingle that no held-out text has
    windows = checkpointed(
        caption_windows(media_items, items).withColumn("key", F.xxhash64(F.array_join("words", " "), "width"))
    )
    counts = checkpointed(windows.groupBy("key").agg(
        F.count("*").alias("n"), F.first("width").alias("width"), F.first("words").alias("w")
    ))
    few = F.least(F.size("w"), F.lit(SHINGLE_WORDS))
    hashes = F.lit(None).cast("array<bigint>")
    for size in range(1, SHINGLE_WORDS + 1):
        hashes = F.when(few == size, _shingles(size)).otherwise(hashes)
    texts = checkpointed(counts.select("key", hashes.alias("hashes")))
    prints = checkpointed(fingerprints(texts, weights, unseen).join(counts.select("key", "width"), "key"))
    own = items.select(F.col("item").alias("key"), "hashes")
    widths = items.select("item", F.size("w").alias("width"))
    item_prints = fingerprints(own, weights, unseen).withColumnRenamed("key", "item")
    item_prints = checkpointed(item_prints.join(widths, "item"))
    pairs = checkpointed(within_radius(prints, item_prints, radius))
    sides = pairs.join(texts, "key").join(items.select("item", F.col("hashes").alias("others")), "item")
    every = sides.select(
        "key", "item",
        F.explode(F.array_distinct(F.concat("hashes", "others"))).alias("hash"),
        F.col("hashes").alias("a"), F.col("others").alias("b"),
    ).select("key", "item", "hash", (F.array_contains("a", F.col("hash")) & F.array_contains("b", F.col("hash"))).alias("common"))
    weight = F.coalesce("weight", F.lit(unseen))
    similar = every.join(weights, "hash", "left").groupBy("key", "item").agg(
        (F.sum(F.when(F.col("common"), weight).otherwise(0.0)) / F.sum(weight)).alias("similarity")
    ).filter(F.col("similarity") >= similarity)
    similar = similar.join(items.select("item", "item_id"), "item")
    matched = similar.groupBy("key").agg(F.collect_list(F.struct("item_id", "similarity")).alias("found"))
    matched = checkpointed(matched.join(counts.select("key", "n"), "key"))
    placed = lookup(windows.select("key", "media_item_id", "start", F.size("words").alias("n_words")), matched, "key", windows.count())
    return placed.select(
        "media_item_id", F.explode("found").alias("f"), "start", "n_words"
    ).select("media_item_id", "f.item_id", "start", "n_words", "f.similarity")

