"""Captions of media items that share most of their word shingles.

The join is exact. Shingles have one global order, rare ones first, and two sets that
reach the threshold must share one of the first few in it, so:

1. shingles are counted over all captions in a table of fixed size, which orders them;
2. every caption sends its first shingles, by hash, to the tasks of those hashes. Sets
   that meet there and are of similar size become candidates of one another;
3. connected candidates form families. The heads of a family are compared first, which
   breaks up families that only hang together by chance;
4. the full sets of a family, or of two of its blocks where it is large, meet in one task,
   which joins them through a prefix tree.

Equal sets are joined as one from step 2 on. Only hashes, sizes and links are shuffled in
the first two steps; the texts never are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from mediacat.llm.components import Scratch, components, lookup, release
from mediacat.llm.prefix_tree import PrefixTree
from mediacat.llm.shingles import shingle_sets, signature

_CELL_BITS = 20
_CHUNK_CELLS = 1024
_FILTER_BITS = 24
_BLOCK_TOKENS = 2_000_000
_HOT_BLOCKS = 20
_U = np.uint64


def caption_links(
    media_items: DataFrame, shingle_words: int = 4, numerator: int = 85, denominator: int = 100
) -> DataFrame:
    """(media_item_id, n_shingles, n_links, component_id), one row per row of ``media_items``.

    Captions (google_description) link when intersection over union of their sets of
    ``shingle_words``-word shingles is at least numerator / denominator. Words are runs of
    anything but ASCII white space, with A-Z as a-z; a caption of fewer words than a
    shingle has its whole word sequence as its only one. ``n_links`` counts the other rows
    linked directly, exact copies among them; ``component_id`` is the smallest id that
    links reach. A NULL, empty or blank caption has no shingles and links with nothing.
    Rows with equal ids stay separate rows; rows with NULL ids take part, and their
    component is the smallest id that is not NULL, or NULL. No rows, no rows. Other
    columns are ignored.
    """
    captions = media_items.select("media_item_id", "google_description")
    counts = _counts(captions, shingle_words)
    ranks = np.minimum(np.log2(counts + 1) * 1400, 65535).astype(_U)
    shared = captions.sparkSession.sparkContext.broadcast(ranks)
    result, scratch = Scratch(captions.sparkSession), Scratch(captions.sparkSession)
    heads = scratch.keep(_heads(captions, shared, shingle_words, numerator, denominator))
    ids = result.keep(heads.select("media_item_id", "n_shingles", "signature"))
    total = ids.count()
    shared.destroy()
    release(ids.sparkSession)
    classes = scratch.keep(
        ids.filter("signature IS NOT NULL").groupBy("signature")
        .agg(F.min("media_item_id").alias("first_id"), F.count("*").alias("n"))
    )
    links, weights = _join(captions, heads, classes, scratch, shingle_words, numerator, denominator)
    rooted = components(links).select(F.col("node").alias("signature"), "component")
    known = (
        classes.join(rooted, "signature", "left").join(weights, "signature", "left")
        .select(
            "signature", "n", "first_id",
            F.coalesce("component", "signature").alias("component"),
            (F.coalesce("weight", F.lit(0)) + F.col("n") - 1).alias("n_links"),
        )
    )
    known = scratch.keep(known)
    smallest = known.groupBy("component").agg(
        F.min("first_id").alias("component_id"), F.count("*").alias("n")
    )
    smallest = scratch.keep(smallest)
    classes = result.keep(
        lookup(known.withColumnRenamed("n", "copies"), smallest, "component", total)
        .withColumnRenamed("copies", "n").select("signature", "n", "n_links", "component_id")
    )
    scratch.drop_all()
    linked = lookup(ids.filter("signature IS NOT NULL"), classes, "signature", total)
    columns = ["media_item_id", "n_shingles", "n_links", "component_id"]
    blank = ids.filter("signature IS NULL").select(
        "media_item_id", "n_shingles", F.lit(0).cast("bigint").alias("n_links"),
        F.col("media_item_id").alias("component_id"),
    )
    return linked.select(*columns).unionByName(blank.select(*columns))


def _counts(captions: DataFrame, size: int) -> np.ndarray:
    """How often shingles of each hash cell occur, one per caption, over all captions."""
    cells = 1 << _CELL_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(cells, np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                own = shingle_sets(batch.column(0).slice(at, 512), size)
                if own:
                    cell = (np.concatenate(own) >> _U(64 - _CELL_BITS)).astype(np.int64)
                    counts += np.bincount(cell, minlength=cells)
        rows = counts.reshape(-1, _CHUNK_CELLS)
        some = np.flatnonzero(rows.any(axis=1))
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array(some, pa.int32()), "counts": pa.array([rows[i].tobytes() for i in some], pa.binary())}
        )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, counts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                own = np.frombuffer(counts, np.int64)
                sums[chunk] = sums[chunk] + own if chunk in sums else own
        yield pa.RecordBatch.from_pydict(
            {"chunk": pa.array(list(sums), pa.int32()), "counts": pa.array([c.tobytes() for c in sums.values()], pa.binary())}
        )

    schema = "chunk int, counts binary"
    parts = captions.select("google_description").mapInArrow(count, schema)
    summed = parts.repartition("chunk").mapInArrow(add, schema)
    counts = np.zeros((cells // _CHUNK_CELLS, _CHUNK_CELLS), np.int64)
    found = summed.toArrow()  # one number per cell, however many captions
    for chunk, own in zip(found.column("chunk").to_pylist(), found.column("counts")):
        counts[chunk] = np.frombuffer(own.as_buffer(), np.int64)
    return counts.ravel()


def _ordered(shingles: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Shingles as tokens whose numeric order is the global one: rank, then hash."""
    rank = ranks[(shingles >> _U(64 - _CELL_BITS)).astype(np.int64)]
    return np.sort((rank << _U(48)) | (shingles & _U((1 << 48) - 1)))


def _packed(shingles: np.ndarray) -> bytes:
    """The low 48 bits of each hash, ascending. Within a family that tells shingles apart."""
    low = np.unique(shingles & _U((1 << 48) - 1))
    return np.ascontiguousarray(low.view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _unpacked(raw: bytes) -> np.ndarray:
    wide = np.zeros((len(raw) // 6, 8), np.uint8)
    wide[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return wide.view(_U).ravel()


def _heads(captions: DataFrame, shared, size: int, numerator: int, denominator: int) -> DataFrame:
    """(media_item_id, n_shingles, signature, head) with the first shingles of each caption.

    Within a task only the first of equal sets has a head.
    """
    schema = T.StructType([
        T.StructField("media_item_id", captions.schema["media_item_id"].dataType),
        T.StructField("n_shingles", T.LongType()), T.StructField("signature", T.LongType()),
        T.StructField("head", T.ArrayType(T.LongType())),
    ])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                count, marks, heads = [], [], []
                for own in shingle_sets(part.column(1), size):
                    n = len(own)
                    count.append(n)
                    mark = signature(own) if n else None
                    marks.append(mark)
                    if n and mark not in seen:
                        seen.add(mark)
                        most = n - -(-n * numerator // denominator) + 1
                        heads.append(_ordered(own, shared.value)[:most].view(np.int64))
                    else:
                        heads.append(None)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(count, pa.int64()), pa.array(marks, pa.int64()), pa.array(heads, pa.list_(pa.int64()))],
                    names=schema.names,
                )

    return captions.mapInArrow(cut, schema)


def _candidates(heads: DataFrame, numerator: int, denominator: int) -> DataFrame:
    """(a, b): signatures whose heads meet at places that leave enough to come for the
    threshold, each linked to the smallest of its kind instead of to all."""
    # A set of m shingles links through a first common token at position p only if both have
    # (m + n) * numerator / (numerator + denominator) tokens from there on. ``reach`` is the
    # largest n for which this set has.
    both = numerator + denominator
    reach = F.expr(f"((n - at) * {both}) div {numerator} - n")
    tokens = (
        heads.filter("head IS NOT NULL").select(F.posexplode("head").alias("at", "token"), F.col("n_shingles").alias("n"), "signature")
        .select("token", (F.shiftleft("n", 32) + reach).alias("size"), "signature")
    )
    none = np.iinfo(np.int64).max

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Runs of one token by size, each as long as something before reaches what comes.
        A set that reaches no size of its run has no part in it."""
        token, furthest, smallest, lead = None, 0, 0, none
        met = [np.zeros((0, 2), np.int64)]
        for batch in batches:
            if not batch.num_rows:
                continue
            t, size, s = (batch.column(k).to_numpy() for k in range(3))
            n, far = size >> 32, size & 0xFFFFFFFF
            other = np.r_[token is None or t[0] != token, t[1:] != t[:-1]]
            group = np.cumsum(other) << 33
            up_to = np.maximum.accumulate(np.r_[0 if other[0] else furthest, far] + np.r_[group[0], group])
            new = other | (up_to[:-1] < group + n)
            first = np.flatnonzero(np.r_[True, new[1:]])
            length = np.diff(np.r_[first, len(s)])
            least_size = n[first]
            if not new[0]:
                least_size[0] = smallest
            within = far >= np.repeat(least_size, length)
            least = np.minimum.reduceat(np.where(within, s, none), first)
            if not new[0] and lead != none:
                if least[0] not in (none, lead):
                    met.append(np.array([[lead, least[0]]], np.int64))
                if least[0] == none:
                    least[0] = lead
            a = np.repeat(least, length)
            token, furthest, smallest, lead = t[-1], up_to[-1] - group[-1], least_size[-1], least[-1]
            keep = within & (a != s)
            met.append(np.unique(np.stack([a[keep], s[keep]], axis=1), axis=0))
        yield _forest(np.concatenate(met))

    dealt = tokens.repartition("token").sortWithinPartitions("token", "size", "signature")
    return dealt.mapInArrow(meet, "a bigint, b bigint")


def _forest(pairs: np.ndarray) -> pa.RecordBatch:
    """(a, b) with every number of ``pairs`` as b and the smallest it is linked to as a."""
    names, at = np.unique(pairs, return_inverse=True)
    root = list(range(len(names)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for x, y in at.reshape(-1, 2).tolist():
        x, y = top(x), top(y)
        if x != y:
            root[max(x, y)] = min(x, y)
    tops = np.array([top(x) for x in range(len(names))], np.int64)
    hung = tops != np.arange(len(names))
    return pa.RecordBatch.from_arrays([pa.array(names[tops[hung]]), pa.array(names[hung])], names=["a", "b"])


def _join(captions, heads, classes, scratch, size, numerator, denominator) -> tuple[DataFrame, DataFrame]:
    """(a, b) that span the linked sets of each family, and (signature, weight) with the
    rows of other sets that each set links with."""
    copies = classes.select("signature", F.col("n").alias("copies"))
    heads = heads.filter("head IS NOT NULL").select("signature", "n_shingles", "head")

    def family(links: DataFrame) -> DataFrame:
        members = components(links).withColumnRenamed("node", "signature").join(copies, "signature")
        sizes = heads.select("signature", "n_shingles").distinct()
        return scratch.keep(members.join(sizes, "signature"))

    def near(rows: dict, key: tuple) -> pa.RecordBatch:
        return _near(rows, key, numerator, denominator)

    def linked(rows: dict, key: tuple) -> pa.RecordBatch:
        return _linked(rows, key, numerator, denominator)

    wide = family(_candidates(heads, numerator, denominator))
    release(captions.sparkSession)
    sent = F.expr(f"n_shingles - (n_shingles * {numerator}) div {denominator} + 1")
    tokens = heads.select("signature", F.col("head").alias("tokens"))
    closer = scratch.keep(_by_family(wide, tokens, sent, near, scratch))
    scratch.drop(wide)
    release(captions.sparkSession)
    members = family(closer.filter("a <> b").select("a", "b"))
    scratch.drop(closer)
    release(captions.sparkSession)
    met = scratch.keep(_by_family(members, _sets(captions, members, size), F.col("n_shingles"), linked, scratch))
    scratch.drop(members)
    release(captions.sparkSession)
    weights = met.groupBy(F.col("b").alias("signature")).agg(F.sum("weight").alias("weight"))
    return met.filter("a <> b").select("a", "b"), weights


def _by_family(members: DataFrame, tokens: DataFrame, sent: Column, link, scratch: Scratch) -> DataFrame:
    """``link`` of the members of every family with their ``tokens`` (signature, tokens),
    of which each has ``sent``.

    A large family is cut into blocks by hash, and every two of its blocks meet.
    """
    found = members.count()
    # blocks by volume; and by share, so that no pair of blocks outweighs the other tasks
    share = F.col("n") / F.lit(float(max(found, 1)))
    hot = F.when((F.col("n") >= 256) & (share >= 1 / 64), F.ceil(_HOT_BLOCKS * F.sqrt(share)))
    few = F.greatest(F.ceil(F.col("volume") / _BLOCK_TOKENS), hot)
    sizes = members.groupBy("component").agg(F.count("*").alias("n"), F.sum(sent).alias("volume"))
    sizes = scratch.keep(sizes.select("component", "n", few.cast("int").alias("blocks")))
    release(members.sparkSession)
    block = F.pmod(F.xxhash64("signature"), F.col("blocks")).cast("int")
    kept = ["signature", "n_shingles", "component", "copies", "block"]
    routes = (
        lookup(members, sizes, "component", found)
        .withColumn("block", block)
        .select(*kept, F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
        .select(*kept, F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    )

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, rows = None, {}
        for batch in batches:
            columns = [batch.column(k).to_pylist() for k in range(7)]
            payload = batch.column(7)
            for at, (component, i, j, own, mark, count, n) in enumerate(zip(*columns)):
                if key != (component, i, j):
                    if len(rows) > 1:
                        yield link(dict(sorted(rows.items())), key)
                    key, rows = (component, i, j), {}
                rows[mark] = (own, n, count, _numbers(payload, at))
        if len(rows) > 1:
            yield link(dict(sorted(rows.items())), key)

    key = ["component", "i", "j"]
    return (
        tokens.join(routes, "signature").select(*key, "block", "signature", "copies", "n_shingles", "tokens")
        .repartition(*key).sortWithinPartitions(*key)
        .mapInArrow(meet, "a bigint, b bigint, weight bigint")
    )


def _numbers(column: pa.Array, at: int) -> np.ndarray:
    value = column[at]
    return _unpacked(value.as_py()) if pa.types.is_binary(column.type) else value.values.to_numpy().view(_U)


def _sets(captions: DataFrame, members: DataFrame, size: int) -> DataFrame:
    """(signature, tokens) of the captions whose signature may be in ``members``."""
    spark = captions.sparkSession
    slot = F.col("signature").bitwiseAND((1 << _FILTER_BITS) - 1)
    words = (
        members.select(F.shiftright(slot, 6).alias("word"), F.expr(f"shiftleft(1L, int(signature & 63))").alias("bit"))
        .groupBy("word").agg(F.bit_or("bit").alias("bits"))
    )
    bits = np.zeros((1 << _FILTER_BITS) // 64, np.int64)
    found = words.toArrow()  # a bit field of fixed size; it only spares work
    bits[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    wanted = spark.sparkContext.broadcast(bits)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        field = wanted.value
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                marks, tokens = [], []
                for own in shingle_sets(batch.column(0).slice(at, 512), size):
                    if not len(own):
                        continue
                    mark = signature(own)
                    low = mark & ((1 << _FILTER_BITS) - 1)
                    if (int(field[low >> 6]) >> (low & 63)) & 1 and mark not in seen:
                        seen.add(mark)
                        marks.append(mark)
                        tokens.append(_packed(own))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(marks, pa.int64()), pa.array(tokens, pa.binary())], names=["signature", "tokens"]
                )

    return captions.select("google_description").mapInArrow(read, "signature bigint, tokens binary")


def _near(rows: dict, key: tuple, numerator: int, denominator: int) -> pa.RecordBatch:
    """Links among sets whose heads share enough for the whole sets to reach the threshold.

    Up to the end of the head that ends first, a token that two sets share is in both heads.
    Behind that end they share at most what the one or the other still has.
    """
    heads = [row[3] for row in rows.values()]
    names, ids = np.unique(np.concatenate(heads), return_inverse=True)
    length = np.array([len(h) for h in heads])
    ends = np.cumsum(length)
    owner = np.repeat(np.arange(len(heads)), length)
    order = np.argsort(ids, kind="stable")
    holders = owner[order]
    first = np.searchsorted(ids[order], np.arange(len(names) + 1))
    sizes = np.array([row[1] for row in rows.values()])
    places, last = owner * len(names) + ids, ids[ends - 1]

    def similar(x: int) -> np.ndarray:
        own = ids[ends[x] - length[x] : ends[x]]
        held = first[own + 1] - first[own]
        begin = np.cumsum(held) - held
        met = holders[np.repeat(first[own] - begin, held) + np.arange(held.sum())]
        both = np.bincount(met, minlength=len(heads))
        y = np.flatnonzero(both)
        end = np.minimum(last[x], last[y])
        passed = np.searchsorted(places, y * len(names) + end, side="right") - (ends[y] - length[y])
        behind = np.minimum(sizes[x] - np.searchsorted(own, end, side="right"), sizes[y] - passed)
        return y[(both[y] + behind) * (numerator + denominator) >= numerator * (sizes[x] + sizes[y])]

    return _joined(rows, key, similar)


def _linked(rows: dict, key: tuple, numerator: int, denominator: int) -> pa.RecordBatch:
    """Links among the sets of one family, or between two of its blocks.

    Of two blocks one makes the tree and the other one looks its sets up.
    """
    sets = [row[3] for row in rows.values()]
    _, i, j = key
    at = [n for n, row in enumerate(rows.values()) if row[0] == j]
    if not at:
        return _joined(rows, key, lambda x: np.zeros(0, np.int64))
    tree = PrefixTree([sets[n] for n in at], numerator, denominator)
    places = np.array(at)
    looked_up = set(range(len(sets))) if i == j else set(range(len(sets))) - set(at)

    def similar(x: int) -> np.ndarray:
        return places[tree.similar(sets[x])] if x in looked_up else np.zeros(0, np.int64)

    return _joined(rows, key, similar, one_way=i != j)


def _joined(rows: dict, key: tuple, similar, one_way: bool = False) -> pa.RecordBatch:
    """One row per set: b is the set, a the smallest it reaches here, weight the rows of
    the other sets it links with. ``one_way``: each link is reported for one of its sets."""
    _, i, j = key
    names = np.array(list(rows), np.int64)
    blocks = np.array([row[0] for row in rows.values()])
    copies = np.array([row[2] for row in rows.values()], np.int64)
    root = list(range(len(names)))

    def top(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    weight = np.zeros(len(names), np.int64)
    for x in range(len(names)):
        others = similar(x)
        others = others[others != x]
        if i != j:
            others = others[blocks[others] != blocks[x]]
        weight[x] += copies[others].sum()
        if one_way:
            weight[others] += copies[x]
        for y in others:
            a, b = top(x), top(int(y))
            if a != b:
                root[max(a, b)] = min(a, b)
    return pa.RecordBatch.from_arrays(
        [pa.array(names[[top(x) for x in range(len(names))]]), pa.array(names), pa.array(weight)],
        names=["a", "b", "weight"],
    )
