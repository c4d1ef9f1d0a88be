"""Drawing media items so that albums get their target share of words.

An item may lie in several albums, so its words can count for any of them. Items are added
up by the set of albums they lie in (their pattern); ``quota_flow`` routes the words of each
pattern to its albums, taking second copies only where first ones do not suffice. Then
items are drawn in the order of a seeded hash, up to the cut where the words of a pattern
are used up. The cuts come from histograms of the hash that get finer around them, so no
task or driver sees the items of a pattern.
"""

from __future__ import annotations

from dataclasses import dataclass
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, functions as F

from mediacat.llm.quota_flow import QuotaFlow
from mediacat.llm.registry import written

_LEVEL_BITS, _LEVELS = 8, 5
_TRIED_A_CLASS = 8
_WORD = r"[^\x20\x09-\x0D]+"
_CUTS = "key string, cut int, album string, copy int, prefix bigint, need bigint, words bigint"


@dataclass
class Mix:
    """Items with what is drawn of them, and the albums with their targets."""

    items: DataFrame
    albums: DataFrame


def album_targets(sizes: dict, total: Fraction, weights: tuple[int, ...], most_copies: int) -> dict:
    """Target words of each album, as fractions, in order of code points with None last.

    ``total`` is shared out by repeating ``weights``. A target above ``most_copies`` times
    the album is cut to that and the rest shared out again.
    """
    order = sorted(sizes, key=lambda album: (album is None, album or ""))
    weight = {album: weights[i % len(weights)] for i, album in enumerate(order)}
    targets = {}
    left, waiting = total, order
    while waiting:
        heavy = sum(weight[a] for a in waiting)
        full = [a for a in waiting if left * weight[a] / heavy > most_copies * sizes[a]]
        if not full:
            targets |= {a: left * weight[a] / heavy for a in waiting}
            break
        targets |= {a: Fraction(most_copies * sizes[a]) for a in full}
        left -= sum(targets[a] for a in full)
        waiting = [a for a in waiting if a not in targets]
    return {album: targets[album] for album in order}


def route(words: list[tuple[str, tuple, int]], targets: dict, most_copies: int) -> list[tuple]:
    """Cuts (key, cut, album, copy, 0, need, size) of each pattern (key, albums, words).

    The copies of a pattern laid end to end are dealt to its albums in turn; an album's part
    ends ``need`` words into a copy.
    """
    flow = QuotaFlow([albums for _, albums, _ in words], {a: round(t) for a, t in targets.items()})
    sizes = [size for _, _, size in words]
    for _ in range(most_copies):
        flow.add_copy(sizes)
    cuts = []
    for (key, albums, size), sent in zip(words, flow.sent):
        end = 0
        for cut, album in enumerate(albums):
            end += sent[album]
            if sent[album]:
                cuts.append((key, cut, album, end // size, 0, end % size, size))
    return cuts


def _cut_hashes(spark: SparkSession, drawn: DataFrame, cuts: list[tuple]) -> list[tuple]:
    """The cuts with the hash each one falls on as prefix.

    Items with a smaller hash lie before the cut; they lack ``need`` words, of the ``words``
    that items with this hash have. Each level reads one more piece of the
    hash, of the items whose hash begins like that of a cut.
    """
    open_cuts = [c for c in cuts if c[5] > 0]
    done = [c for c in cuts if c[5] == 0]
    for level in range(1, _LEVELS + 1):
        if not open_cuts:
            break
        shift = _LEVEL_BITS * (_LEVELS - level)
        state = spark.createDataFrame(open_cuts, _CUTS).withColumnRenamed("prefix", "begin").drop("words")
        parts = (
            drawn.join(F.broadcast(state), "key")
            .withColumn("prefix", F.shiftright("place", shift))
            .filter(F.shiftright("prefix", _LEVEL_BITS) == F.col("begin"))
            .groupBy("key", "cut", "album", "copy", "need", "prefix").agg(F.sum("size").alias("words"))
        )
        up_to = F.expr("sum(words) OVER (PARTITION BY key, cut ORDER BY prefix)")
        found = (
            parts.withColumn("up_to", up_to).filter("up_to > need")
            .groupBy("key", "cut", "album", "copy")
            .agg(F.min(F.struct("prefix", (F.col("need") - F.col("up_to") + F.col("words")).alias("need"), "words")).alias("at"))
            .select("key", "cut", "album", "copy", "at.*")
        )
        open_cuts = [tuple(r) for r in found.collect()]
    return done + open_cuts


def _corrections(spark: SparkSession, drawn: DataFrame, cuts: list[tuple]) -> dict[str, tuple]:
    """How whole items come nearest to the last cut of a pattern: (added, omitted) hashes.

    Either items beyond the cut are added to fill what is left before it, or the item on the
    cut is taken and others of the same part are left out for what that is too much,
    whichever comes nearer. A few items of each class of size that fit are tried (two
    classes to a doubling), the largest first.
    """
    last, begins = {}, {}
    for c in sorted(cuts, key=lambda c: c[:2]):
        before = last.get(c[0])
        begins[c[0]] = before[4] if before and before[3] == c[3] else 0
        last[c[0]] = c
    gaps = [(c[0], side, c[4], begins[c[0]], c[5] if side else c[6] - c[5]) for c in last.values() if c[5] > 0 for side in (0, 1)]
    if not gaps:
        return {}
    state = F.broadcast(spark.createDataFrame(gaps, "key string, side int, prefix bigint, begin bigint, need bigint"))
    on_side = F.when(F.col("side") == 1, F.col("place") > F.col("prefix")).otherwise(
        (F.col("place") < F.col("prefix")) & (F.col("place") >= F.col("begin"))
    )
    firsts = (
        drawn.join(state, "key")
        .filter(on_side & F.expr("size > 0 AND size <= need"))
        .groupBy("key", "side", "need", F.floor(2 * F.log2("size")), F.pmod("place", F.lit(_TRIED_A_CLASS)))
        .agg(F.min(F.struct("size", "place")).alias("one"))
    )
    none = F.struct(F.col("need").alias("left"), F.array().cast("array<bigint>").alias("places"))
    tried = firsts.groupBy("key", "side", "need").agg(F.sort_array(F.collect_list("one"), False).alias("tried"))
    chosen = tried.select(
        "key", "side",
        F.aggregate(
            "tried", none,
            lambda have, one: F.when(
                one["size"] <= have["left"],
                F.struct(
                    (have["left"] - one["size"]).alias("left"),
                    F.concat(have["places"], F.array(one["place"])).alias("places"),
                ),
            ).otherwise(have),
        ).alias("chosen"),
    ).select("key", "side", "chosen.*")
    best = {(key, side): (need, []) for key, side, _, _, need in gaps}
    best |= {(r.key, r.side): (r.left, r.places) for r in chosen.collect()}
    found = {}
    for key in {g[0] for g in gaps}:
        omitting, adding = best[key, 0], best[key, 1]
        found[key] = (adding[1], None) if adding[0] <= omitting[0] else ([], omitting[1])
    return found


def mix_albums(
    media_items: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2),
    most_copies: int = 2, seed: str = "catalog", most_patterns: int = 100_000,
) -> Mix:
    """Media items with the number of copies drawn of each, so that albums meet targets.

    ``media_items`` has media_item_id, google_description and album_ids (an array; an item
    whose content lies in several albums lists them all; NULL counts as an album). Other
    columns do not matter. The size of an item is its number of words. Targets are those of
    ``album_targets`` for ``share`` times the words of all items; an album's own size counts
    all items that lie in it.

    ``items`` has media_item_id, album_ids (sorted, each once, NULL last), size, copies,
    taken (copies times size, at most ``most_copies`` times) and drawn_for, the album of each
    copy. ``albums`` has album_id, size and target. Items are drawn whole, so an album comes
    as near its target as its items of the last size that fits; where albums overlap, the
    border between two of them is off by one item at most. The same rows and ``seed`` draw
    the same items, whatever their order.

    Items without text have size 0, those in no album are not drawn. Rows equal in id and
    text are drawn together. No rows, no rows. The driver holds one row per pattern, and a
    catalog with more than ``most_patterns`` of them raises ValueError.
    """
    spark = media_items.sparkSession
    text = F.coalesce(F.col("google_description"), F.lit(""))
    drawn = written(media_items.select(
        "media_item_id",
        F.array_sort(F.array_distinct(F.coalesce("album_ids", F.array().cast("array<string>")))).alias("album_ids"),
        F.regexp_count(text, F.lit(_WORD)).cast("bigint").alias("size"),
        F.shiftrightunsigned(
            F.xxhash64(F.lit(seed), "media_item_id", text), 64 - _LEVEL_BITS * _LEVELS
        ).alias("place"),
    ).withColumn("key", F.to_json("album_ids")))

    sums = drawn.groupBy("key").agg(F.first("album_ids").alias("albums"), F.sum("size").alias("words"))
    patterns = sums.orderBy("key").limit(most_patterns + 1).collect()
    if len(patterns) > most_patterns:
        raise ValueError(f"items lie in more than {most_patterns} sets of albums")
    sizes = {}
    for p in patterns:
        for album in p.albums:
            sizes[album] = sizes.get(album, 0) + p.words
    words = [(p.key, tuple(p.albums), p.words) for p in patterns if p.albums and p.words]
    targets = album_targets(sizes, Fraction(share) * sum(w for _, _, w in words), weights, most_copies)
    cuts = _cut_hashes(spark, drawn, route(words, targets, most_copies))
    corrections = _corrections(spark, drawn, cuts)

    by_key = {}
    for key, cut, album, copy, prefix, *_ in sorted(cuts, key=lambda c: c[:2]):
        by_key.setdefault(key, []).append((album, copy, prefix, []))
    for key, (_, omitted) in corrections.items():
        if omitted is not None:
            album, copy, prefix, _ = by_key[key][-1]
            by_key[key][-1] = (album, copy, prefix + 1, omitted)
    plan = spark.createDataFrame(
        [(key, ends, corrections.get(key, ([], None))[0]) for key, ends in by_key.items()],
        "key string, ends array<struct<album: string, copy: int, place: bigint, omitted: array<bigint>>>,"
        " added array<bigint>",
    )
    place = F.col("place")

    def album_of(copy):
        def reaches(end):
            in_copy = (place < end["place"]) & ~F.array_contains(end["omitted"], place)
            return (end["copy"] > copy) | ((end["copy"] == copy) & in_copy)

        return F.transform(F.slice(F.filter("ends", reaches), 1, 1), lambda e: e["album"])

    filled = F.when(F.array_contains("added", place), F.transform(F.slice("ends", -1, 1), lambda e: e["album"]))
    nothing = F.array().cast("array<string>")
    copies = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(most_copies - 1)), album_of))
    items = (
        drawn.join(F.broadcast(plan), "key", "left")
        .withColumn("drawn_for", F.coalesce(F.concat(copies, F.coalesce(filled, nothing)), nothing))
        .select(
            "media_item_id", "album_ids", "size", F.size("drawn_for").alias("copies"),
            (F.size("drawn_for") * F.col("size")).alias("taken"), "drawn_for",
        )
    )
    albums = spark.createDataFrame(
        [(a, sizes[a], float(t)) for a, t in targets.items()], "album_id string, size bigint, target double"
    )
    return Mix(items, albums)
