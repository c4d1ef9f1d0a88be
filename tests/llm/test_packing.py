"""Packing against the tokenizer itself and against the rules of a valid packing."""

import random
import struct
import zlib

import pytest
from tokenizers import Tokenizer

from mediacat.llm import packing
from mediacat.llm.queries import vocabulary_file

TEXTS = [
    None, "", "a", " ", "two  spaces", "line\nbreak and\n more", "\n", "ends with space ",
    "Licence 2.0, no.\nNext 's don't we'll", "x" * 3000, "ab cd " * 900 + "e", "tab\tand nbsp a  b",
    "<|endoftext|> inside", "a <|endoftext|> b", "x<|endoftext|>y\nz", "<|endoftext|><|endoftext|>", "<|endoftext| >", "Ciónmente### las%%% déjà|vu &&& 12,5 a,b c.. d!!", "end.\n\nstart", "emoji \U0001f600 ok x",
]


def test_ids_equal_those_of_the_tokenizer():
    tokenizer = Tokenizer.from_file(vocabulary_file())
    encode = packing.CaptionEncoder(vocabulary_file())
    random.seed(5)
    made = ["".join(random.choices("ab é,.!%\n\t'1 |", k=40)) for _ in range(3000)]
    for text in [*filter(None, TEXTS), *made, *made[:50]]:
        want = tokenizer.encode(text, add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(want)}I", encode(text))) == want, repr(text)


def _check(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pack(spark):
    random.seed(1)
    texts = TEXTS + [" ".join(["word"] * random.randint(0, 900)) for _ in range(300)] + ["same text"] * 200
    rows = [(i, t, "clash") for i, t in enumerate(texts)] + [(None, "no id", "x"), (7, TEXTS[7], "repeated")]
    items = spark.createDataFrame(rows, "media_item_id bigint, google_description string, tokens string")
    got = packing.pack_captions(items, vocabulary_file(), 2, 256).collect()
    tokenizer = Tokenizer.from_file(vocabulary_file())
    total = 0
    pieces = {}
    for r in got:
        pieces.setdefault(r.media_item_id, []).append(r)
    for i, t, _ in rows[:-2]:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [2]
        total += len(ids)
        mine = sorted({(r.piece, r.start, r.length, r.tokens_crc32) for r in pieces[i]})
        assert sum(p[2] for p in mine) == len(ids) and [p[0] for p in mine] == list(range(len(mine)))
        if len(ids) <= 256:
            assert len(mine) == 1
        for _, start, length, crc in mine:
            assert crc == zlib.crc32(struct.pack(f"<{length}I", *ids[start : start + length]))
        assert all(p[2] == 256 for p in mine[1:])
    assert len(pieces[7]) == 2 and len(pieces[None]) == 1
    sequences = _check(got, 256)
    assert sequences <= 1.02 * total / 256 + 2


def test_no_rows(spark):
    items = spark.createDataFrame([], "media_item_id bigint, google_description string")
    assert packing.pack_captions(items, vocabulary_file(), 2).collect() == []


@pytest.mark.parametrize("seed", range(6))
def test_plan_places_all(seed):
    random.seed(seed)
    counts = {random.randint(1, 100): random.randint(1, 50) for _ in range(seed * 12)}
    rows, sequences = packing.plan_sequences(dict(counts), 100)
    placed, ends = {}, {}
    for (length, rank, sequence, offset), following in zip(sorted(rows), sorted(rows)[1:] + [None]):
        end = following[1] if following and following[0] == length else counts[length]
        for k in range(end - rank):
            placed[length] = placed.get(length, 0) + 1
            ends.setdefault(sequence + k, []).append((offset, length))
    assert placed == counts and len(ends) == sequences
    for places in ends.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 100
    assert sequences >= -(-sum(k * n for k, n in counts.items()) // 100)


def test_ids_of_whole_documents(spark):
    tokenizer = Tokenizer.from_file(vocabulary_file())
    encode = packing.CaptionEncoder(vocabulary_file())
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect():
        want = tokenizer.encode(r.text or "", add_special_tokens=False).ids
        assert list(struct.unpack(f"<{len(want)}I", encode(r.text or ""))) == want
