"""Packing the captions of media items into token sequences of one fixed length.

Captions are tokenised and cut into pieces of at most ``capacity`` tokens. Which pieces
share a sequence is decided on the counts of the piece lengths alone: there are at most
``capacity`` lengths however many captions there are, so the plan is made in one place,
and every piece finds its sequence by its length and its rank among pieces of that length.

The plan is large-item matching. Pieces above a third of the capacity fit at most twice
into a sequence, so they are paired greedily, the longest with the longest that fits it.
The smaller ones then go, longest first, to the tightest gap that takes them.
"""

from __future__ import annotations

import re
from array import array
from bisect import bisect_left, insort
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from mediacat.session import checkpointed

_TAIL = "%$#&*!,.|"
_CACHE_ENTRIES = 500_000
_MAX_BUCKETS = 4096

_encoders: dict[str, "CaptionEncoder"] = {}


def _visible_bytes() -> dict[int, str]:
    """The printable character by which byte-level vocabularies write each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class _Parts(dict):
    """Token bytes of text parts, worked out when first asked for.

    ``lead`` stands before each part. ``bare`` is the same without lead.
    """

    def __init__(self, tokenizer, lead: str, bare: "_Parts | None" = None):
        self.tokenizer, self.lead = tokenizer, lead
        self.bare = self if bare is None else bare
        self.visible = _visible_bytes()

    def __missing__(self, part: str) -> bytes:
        if len(self) >= _CACHE_ENTRIES:
            self.clear()
        self[part] = found = self._work_out(part)
        return found

    def _work_out(self, part: str) -> bytes:
        """The splitter cuts around runs of letters and around single line ends."""
        if part.isalpha():
            raw = (self.lead + part).encode().decode("latin-1").translate(self.visible)
            return array("I", [t.id for t in self.tokenizer.model.tokenize(raw)]).tobytes()
        head, line_end, rest = part.partition("\n")
        if head and rest:
            return self[head] + self.bare[line_end] + self.bare[rest]
        core = part.rstrip(_TAIL)
        if core != part and core[-1:].isalpha():
            return self[core] + self.bare[part[len(core):]]
        ids = self.tokenizer.encode(self.lead + part, add_special_tokens=False).ids
        return array("I", ids).tobytes()


class CaptionEncoder:
    """Token ids of a text as little-endian 32-bit numbers.

    The splitter of byte-level vocabularies never joins the two sides of a space that
    stands between two other characters, so a text without adjacent white space is looked
    up word by word; all other texts are encoded as a whole, those too in which a token
    of the vocabulary that the splitter leaves uncut is written out. Both give the same ids.
    """

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(vocabulary)
        added = self._tokenizer.get_added_tokens_decoder().values()
        self._whole = re.compile("|".join([r"\s\s", *(re.escape(t.content) for t in added)]))
        self._first = _Parts(self._tokenizer, "")
        self._rest = _Parts(self._tokenizer, " ", self._first)

    def __call__(self, text: str) -> bytes:
        parts = text.split(" ")
        if "" in parts or self._whole.search(text):
            ids = self._tokenizer.encode(text, add_special_tokens=False).ids
            return array("I", ids).tobytes()
        return self._first[parts[0]] + b"".join(map(self._rest.__getitem__, parts[1:]))


def _encoder(vocabulary: str) -> CaptionEncoder:
    """One per worker process."""
    if vocabulary not in _encoders:
        _encoders[vocabulary] = CaptionEncoder(vocabulary)
    return _encoders[vocabulary]


def cut_captions(
    media_items: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024
) -> DataFrame:
    """Captions as pieces: (media_item_id, piece, start, length, tokens).

    A caption is its token ids followed by ``end_id``; a NULL caption counts as empty, so
    every row gives at least one piece. Only captions above ``capacity`` are cut: the
    first piece takes what is left over when the others are full, or is full itself.
    ``tokens`` holds the ids as little-endian unsigned 32-bit numbers, ``start`` counts
    the ids before the piece. Repeated ids of media stay separate rows. A special token
    written out in a caption is that token, as in a plain call of the tokenizer.
    """
    end = array("I", [end_id]).tobytes()
    kind = media_items.schema["media_item_id"].dataType
    schema = T.StructType(
        [T.StructField("media_item_id", kind)]
        + [T.StructField(n, T.LongType() if n == "start" else T.IntegerType()) for n in ("piece", "start", "length")]
        + [T.StructField("tokens", T.BinaryType())]
    )
    arrow = pa.schema(
        [("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int32()), ("tokens", pa.binary())]
    )

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows, took = [], []
                for i, text in enumerate(part.column(1).to_pylist()):
                    ids = encode(text or "") + end
                    total = len(ids) // 4
                    start, piece = 0, 0
                    length = total % capacity or min(total, capacity)
                    while start < total:
                        rows.append((piece, start, length, ids[4 * start : 4 * (start + length)]))
                        took.append(i)
                        start, piece, length = start + length, piece + 1, capacity
                made = [pa.array(c, f.type) for c, f in zip(zip(*rows), arrow)]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(took)), *made], names=["media_item_id", *arrow.names]
                )

    return media_items.select("media_item_id", "google_description").mapInArrow(cut, schema)


def plan_sequences(counts: dict[int, int], capacity: int) -> tuple[list[tuple], int]:
    """Where the pieces of each length go.

    Returns rows (length, first rank, sequence of that rank, offset): from that rank on,
    pieces of the length go one each to consecutive sequences, up to the next row; and the
    number of sequences.
    """
    left = {length: n for length, n in counts.items() if n}
    used: dict[int, int] = defaultdict(int)
    rows: list[tuple] = []
    gaps: dict[int, list[tuple[int, int]]] = defaultdict(list)  # gap -> (first sequence, how many)
    open_gaps: list[int] = []
    sequences = 0

    def place(length: int, n: int, sequence: int, offset: int) -> None:
        rows.append((length, used[length], sequence, offset))
        used[length] += n
        left[length] -= n

    def leave(gap: int, sequence: int, n: int) -> None:
        if gap:
            if not gaps[gap]:
                insort(open_gaps, gap)
            gaps[gap].append((sequence, n))

    # Pieces above a third of the capacity: the longest with the longest that fits it.
    large = sorted(length for length in left if 3 * length > capacity)
    while large:
        length = large[-1]
        while left[length]:
            fits = bisect_left(large, capacity - length + 1) - 1
            while fits >= 0 and not left[large[fits]]:
                fits -= 1
            other = large[fits] if fits >= 0 else 0
            if other == length and left[length] > 1:
                n = left[length] // 2
            elif other and other != length:
                n = min(left[length], left[other])
            else:
                n, other = left[length], 0
            place(length, n, sequences, 0)
            if other:
                place(other, n, sequences, length)
            leave(capacity - length - other, sequences, n)
            sequences += n
        large.pop()
    # The others: longest first, to the tightest gap.
    for length in sorted((k for k in left if 3 * k <= capacity), reverse=True):
        while left[length]:
            at = bisect_left(open_gaps, length)
            if at == len(open_gaps):
                fresh = -(-left[length] // (capacity // length))
                leave(capacity, sequences, fresh)
                sequences += fresh
                continue
            gap = open_gaps[at]
            first, many = gaps[gap].pop()
            if not gaps[gap]:
                open_gaps.pop(at)
            n = min(many, left[length])
            place(length, n, first, capacity - gap)
            leave(gap - length, first, n)
            if many > n:
                leave(gap, first + n, many - n)
    return rows, sequences


def place_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` with (sequence_id, offset): the sequence of each and its place there.

    Every piece is placed once, sequences hold at most ``capacity`` tokens and have no
    gaps. The rows must be cheap to read again (write or checkpoint them first): they are
    counted by length and by a hash bucket, and ranked within those. One length may hold
    any share of the rows, since the bucket splits it. The counts, at most ``capacity``
    times ``_MAX_BUCKETS`` numbers, are all that the driver sees.
    """
    spark = pieces.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(16, min(_MAX_BUCKETS, tasks))
    bucket = F.pmod(F.xxhash64("media_item_id", "piece", F.lit(8)), F.lit(buckets)).cast("int")
    keyed = pieces.withColumn("_bucket", bucket)
    counted = keyed.groupBy("length", "_bucket").count().toPandas()
    matrix = np.zeros((capacity + 1, buckets), np.int64)
    matrix[counted["length"], counted["_bucket"]] = counted["count"]
    rows, _ = plan_sequences({i: int(n) for i, n in enumerate(matrix.sum(axis=1))}, capacity)
    before = np.cumsum(matrix, axis=1) - matrix
    rows.sort()
    plan = np.array(rows, np.int64).reshape(-1, 4)
    first_row = np.searchsorted(plan[:, 0], np.arange(capacity + 2))
    shared = spark.sparkContext.broadcast((before, plan, first_row))
    schema = T.StructType(
        [*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]
    )
    names = pieces.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, plan, first_row = shared.value
        key, rank = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            length = batch.column("length").to_numpy(zero_copy_only=False).astype(np.int64)
            bucket = batch.column("_bucket").to_numpy(zero_copy_only=False).astype(np.int64)
            code = length * buckets + bucket
            starts = np.flatnonzero(np.r_[True, code[1:] != code[:-1]])
            size = np.diff(np.r_[starts, len(code)])
            within = np.arange(len(code)) - np.repeat(starts, size)
            if key == code[0]:
                within[: size[0]] += rank
            key, rank = code[-1], within[-1] + 1
            ranks = before[length, bucket] + within
            sequence, offset = np.empty_like(ranks), np.empty_like(ranks)
            for one in np.unique(length):
                at = np.flatnonzero(length == one)
                own = plan[first_row[one] : first_row[one + 1]]
                row = own[np.searchsorted(own[:, 1], ranks[at], side="right") - 1]
                sequence[at] = row[:, 2] + ranks[at] - row[:, 1]
                offset[at] = row[:, 3]
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(n) for n in names), pa.array(sequence), pa.array(offset)],
                names=[*names, "sequence_id", "offset"],
            )

    order = ["length", "_bucket", "media_item_id", "piece", *(c for c in ("start",) if c in names)]
    dealt = keyed.repartition(buckets, "length", "_bucket").sortWithinPartitions(*order)
    return dealt.mapInArrow(place, schema)


def pack_captions(
    media_items: DataFrame, vocabulary: str, end_id: int, capacity: int = 1024
) -> DataFrame:
    """Pieces of the captions with their places and a digest of their tokens.

    One row per piece: (media_item_id, piece, start, length, tokens_crc32, sequence_id,
    offset). The tokens themselves are a join of ``cut_captions`` on media_item_id and
    piece away. No captions, no rows.
    """
    cut = cut_captions(media_items, vocabulary, end_id, capacity)
    digest = F.crc32("tokens").alias("tokens_crc32")
    pieces = checkpointed(cut.select("media_item_id", "piece", "start", "length", digest))
    return place_pieces(pieces, capacity)
