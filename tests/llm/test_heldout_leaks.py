"""Leaks against every window of every caption, and the index against all pairs."""

import math
import random
import re

from mediacat.llm import heldout_leaks as leaks
from mediacat.llm.license_notices import WORD


def words(text):
    return re.findall(WORD, (text or "").lower())


def shingles(w):
    k = min(len(w), leaks.SHINGLE_WORDS)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if w else set()


def plain(captions, items, least=0.8):
    texts = {(i, tuple(words(t))) for i, t in items if words(t)}
    df = {}
    for _, w in texts:
        for s in shingles(list(w)):
            df[s] = df.get(s, 0) + 1
    weigh = lambda some: sum(1 + math.log((len(texts) + 1) / (df.get(s, 0) + 1)) for s in some)
    found = set()
    for key, text in captions:
        own = words(text)
        for item, w in texts:
            want = shingles(list(w))
            for start in range(-len(w) + 1, len(own)):
                window = own[max(start, 0) : start + len(w)]
                have = shingles(window)
                if have & want and weigh(have & want) / weigh(have | want) >= least:
                    found.add((str(key), str(item), max(start, 0), len(window)))
    return found


def data(seed):
    rnd = random.Random(seed)
    vocabulary = ["v%d" % i for i in range(300)] + ["né", "ß"]
    text = lambda n: " ".join(rnd.choices(vocabulary, k=n))
    items = [(i, text(rnd.choice([15, 30, 45]))) for i in range(12)]
    items += [(20, "only four words here"), (21, "twoshort words"), (22, None), (23, " .. "), (0, items[0][1]), (None, text(20))]
    captions = [(i, text(rnd.randint(0, 80))) for i in range(30)]
    for i, (_, t) in enumerate(items):
        if t:
            captions.append((100 + i, text(20) + " " + t.upper().replace(" ", ", ") + ". " + text(10)))
            captions.append((200 + i, t + " " + t))
            w = t.split()
            w[0] = "changed"
            captions.append((300 + i, text(5) + " " + " ".join(w)))
            captions.append((400 + i, " ".join(w[: len(w) // 2])))
    captions += [(None, items[1][1]), (500, None), (501, ""), (502, "only four"), (101, captions[31][1])]
    return captions, items


def test_against_all_windows(spark):
    captions, items = data(4)
    frame = spark.createDataFrame([(k, t, "x") for k, t in captions], "media_item_id bigint, google_description string, w string")
    held = spark.createDataFrame(items, "item_id bigint, text string")
    got = {(str(r.media_item_id), str(r.item_id), r.start, r.n_words) for r in leaks.find_leaks(frame, held).collect()}
    want = plain(captions, items)
    assert got <= want
    # every leak is found; windows beside the aligned one may be left out
    assert {g[:2] for g in got} == {w[:2] for w in want}
    assert len(got) > 40


def test_index_finds_all_within_radius(spark):
    rnd = random.Random(9)
    a = [(i, rnd.getrandbits(64) - 2**63) for i in range(40)]
    b = []
    for i in range(200):
        x = a[i % 40][1] & (2**64 - 1)
        for bit in rnd.sample(range(64), rnd.randint(0, 20)):
            x ^= 1 << bit
        b.append((i, x - 2**64 if x >= 2**63 else x))
    left = spark.createDataFrame([(k, x, 5) for k, x in a], "key bigint, fingerprint bigint, width int")
    right = spark.createDataFrame([(i, y, 5) for i, y in b], "item bigint, fingerprint bigint, width int")
    got = sorted(map(tuple, leaks.within_radius(left, right, 15).collect()))
    want = sorted((k, i) for k, x in a for i, y in b if bin((x ^ y) & (2**64 - 1)).count("1") <= 15)
    assert got == want


def test_few_pairs_meet(spark):
    """Random prints of 5,000 items in 40 widths: a window meets under 1 % of the items."""
    rnd = random.Random(3)
    some = lambda n: [(i, rnd.getrandbits(64) - 2**63, 20 + rnd.randrange(40)) for i in range(n)]
    left = spark.createDataFrame(some(2000), "key bigint, fingerprint bigint, width int")
    right = spark.createDataFrame(some(5000), "item bigint, fingerprint bigint, width int")
    assert leaks.meetings(left, right, 15).count() < 0.01 * 2000 * 5000


def test_field_holds_all_hashes(spark):
    seeds = spark.range(3000).select(leaks.F.xxhash64("id").alias("hash"))
    field, bits = leaks._bit_field(seeds, 3000)
    others = spark.range(10**6, 10**6 + 20_000).select(leaks.F.xxhash64("id").alias("hash"))
    inside = leaks._in_field(field, bits, leaks.F.col("hash"))
    assert seeds.filter(inside).count() == 3000
    assert others.filter(inside).count() < 200


def test_nothing(spark):
    frame = spark.createDataFrame([(1, "a b c d e f")], "media_item_id bigint, google_description string")
    held = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    assert leaks.find_leaks(frame.limit(0), held).collect() == []
    assert leaks.find_leaks(frame, held.limit(0)).collect() == []
    long = spark.createDataFrame([(1, "w x y z u v " * 30_000 + "a b c d e f")], frame.schema)
    found = leaks.find_leaks(long, held)
    assert found.count() == 1
    assert "Python" not in found._jdf.queryExecution().executedPlan().toString()
