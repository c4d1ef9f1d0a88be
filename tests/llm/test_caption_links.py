"""Caption links against all pairs, on texts with copies, near copies and shared passages."""

import random
import re

import pytest

from mediacat.llm import caption_links as links
from mediacat.llm.components import components


def brute(rows, size, numerator, denominator):
    sets = []
    for _, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        if len(words) >= size:
            sets.append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)})
        else:
            sets.append({tuple(words)} if words else set())
    root = list(range(len(rows)))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    n = [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and denominator * both >= numerator * len(sets[i] | sets[j]):
                n[i] += 1
                n[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    smallest = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            smallest[top(i)] = min(smallest.get(top(i), key), key)
    return sorted(
        (str(key), len(sets[i]), n[i], str(smallest.get(top(i)))) for i, (key, _) in enumerate(rows)
    )


def texts(seed):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % i for i in range(400)] + ["Ünï", "É", "é", "A", "a"]
    passage = " ".join(rnd.choices(vocabulary, k=40))
    made = []
    for _ in range(60):
        made.append(" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 150))))
    for _ in range(120):
        words = rnd.choice(made).split()
        for _ in range(rnd.randint(0, 3)):
            words[rnd.randrange(len(words))] = rnd.choice(vocabulary)
        made.append(rnd.choice(["  ", " ", "\n"]).join(words))
    for _ in range(40):
        made.append(rnd.choice(made)[:400] + " " + passage)
    base = rnd.choices(vocabulary, k=120)
    for i in range(300):  # one large family of near copies
        words = list(base)
        words[rnd.randrange(120)] = "x%d" % i
        made.append(" ".join(words))
    made += [made[3]] * 70 + ["", None, " \t\n", "one", "One", "ONE two", "one two three"]
    return made


@pytest.mark.parametrize("size,numerator,denominator", [(4, 85, 100), (5, 8, 10)])
def test_against_all_pairs(spark, size, numerator, denominator, monkeypatch):
    monkeypatch.setattr(links, "_BLOCK_TOKENS", 5000)
    rows = [(i, t) for i, t in enumerate(texts(size))] + [(None, "one two three"), (5, "again the same id"), (None, None)]
    random.Random(1).shuffle(rows)
    items = spark.createDataFrame([(k, t, "x") for k, t in rows], "media_item_id bigint, google_description string, signature string")
    got = links.caption_links(items, size, numerator, denominator).collect()
    have = sorted((str(r.media_item_id), r.n_shingles, r.n_links, str(r.component_id)) for r in got)
    assert have == brute(rows, size, numerator, denominator)


def test_no_rows(spark):
    items = spark.createDataFrame([], "media_item_id bigint, google_description string")
    assert links.caption_links(items).collect() == []


def test_one_very_long_text(spark):
    text = " ".join("w%d" % (i % 7919) for i in range(300_000))
    items = spark.createDataFrame([(1, text), (2, text + " end"), (3, "w1 w2 w3")], "media_item_id bigint, google_description string")
    got = {r.media_item_id: r for r in links.caption_links(items).collect()}
    assert (got[1].component_id, got[2].component_id, got[3].component_id) == (1, 1, 3)
    assert got[1].n_shingles == 7919 and got[2].n_links == 1


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(200, 400)] + [(7, k) for k in range(1000, 1700)] + [(5, 5), (9, 8), (8, 9)]
    random.Random(2).shuffle(edges)
    got = dict(map(tuple, components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()))
    want = {k: 200 for k in range(200, 401)} | {k: 7 for k in range(1000, 1700)} | {7: 7, 5: 5, 8: 8, 9: 8}
    assert got == want
