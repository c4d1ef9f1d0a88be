"""Licence notices in the captions of media items.

A positional index of rare words: for every notice, the word of its key phrase that the
fewest captions have is looked up. Each place of such a word in a caption, less the word's
position in the notice, is where that notice would begin; there the key phrase must stand
in full, and the share of the other notice words that also stand in place is the score.
The key phrase is mandatory, so looking up one of its words misses nothing.

Only built-in functions are used, and nothing is shuffled but one count per notice word.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Fixed values: (label, notice, key phrase). These are the phrases a caption is counted by.
PHRASES = [
    ("gpl", "gnu general public license", "gnu general public license"),
    ("apache", "apache license", "apache license"),
    ("cc-by", "cc by", "cc by"),
    ("mit", "mit license", "mit license"),
]

#: Fixed values: (label, notice, key phrase) of usual notices.
NOTICES = [
    ("agpl-notice", "licensed under the gnu affero general public license", "gnu affero general public license"),
    ("apache-2.0", "licensed under the apache license version 2 0", "apache license version 2 0"),
    ("bsd-notice", "redistribution and use in source and binary forms with or without modification are permitted", "source and binary forms"),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", "cc by nc 4 0"),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", "cc by sa 4 0"),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright cc0 1 0", "cc0 1 0"),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("lgpl-notice", "licensed under the gnu lesser general public license", "gnu lesser general public license"),
    ("mit-notice", "permission is hereby granted free of charge to any person obtaining a copy of this software", "permission is hereby granted free of charge"),
    ("mpl-2.0", "subject to the terms of the mozilla public license v 2 0", "mozilla public license v 2 0"),
]


def notice_words(text: Column) -> Column:
    """The words of a text with A-Z in lower case; NULL counts as empty.

    ``lower`` would also turn the Kelvin sign into a k; doubling it first keeps such words
    apart from those of the notices, none of which has a double k.
    """
    kelvin = "\u212a"
    plain = F.lower(F.replace(F.coalesce(text, F.lit("")), F.lit(kelvin), F.lit(kelvin * 2)))
    return F.regexp_extract_all(plain, F.lit(WORD), F.lit(0))


def templates() -> list[dict]:
    """Phrases and notices with the place of the key phrase in each."""
    found = []
    for base, rows in ((True, PHRASES), (False, NOTICES)):
        for label, notice, key in rows:
            words, phrase = notice.split(), key.split()
            at = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
            found.append({"label": label, "base": base, "words": words, "key_from": at, "key_to": at + len(phrase) - 1})
    return found


def document_counts(media_items: DataFrame, words: list[str]) -> tuple[dict[str, int], int]:
    """How many captions have each of ``words``, over all captions, and their number."""
    split = media_items.select(notice_words(F.col("google_description")).alias("w"))
    own = F.array_distinct(F.filter("w", lambda w: w.isin(words)))
    counted = split.select(F.explode(F.array_append(own, F.lit(" "))).alias("word")).groupBy("word").count()
    counts = {r.word: r["count"] for r in counted.collect()}  # one row per notice word at most
    return counts, counts.pop(" ", 0)


def scan_notices(media_items: DataFrame, min_share: float = 0.6) -> DataFrame:
    """Licence notices of every caption (google_description), one row per media item.

    (media_item_id, n_words, n_base, first_word, last_word, base_labels, labels, score,
    places). ``n_base`` counts all places of ``PHRASES``; first_word and last_word are the
    smallest and largest of them, counted in words from 0, NULL without any. ``labels``
    adds the ``NOTICES`` of which ``min_share`` of the words stand in place around the key
    phrase. ``score`` is the largest such share, at least 0.5 with any phrase, else 0.
    ``places`` lists (start, label, base, share). NULL and empty captions have no words and
    no labels; repeated rows and NULL ids are kept; no rows, no rows.
    """
    every = templates()
    words = sorted({w for t in every for w in t["words"][t["key_from"] : t["key_to"] + 1]})
    counts, total = document_counts(media_items, words)
    rarity = {w: math.log((total + 1) / (counts.get(w, 0) + 1)) for w in words}
    postings: dict[str, list[Column]] = {}
    for t in every:
        anchor = max(range(t["key_from"], t["key_to"] + 1), key=lambda i: (rarity[t["words"][i]], -i))
        postings.setdefault(t["words"][anchor], []).append(
            F.struct(
                F.lit(t["label"]).alias("label"), F.lit(t["base"]).alias("base"), F.lit(anchor).alias("anchor"),
                F.array(*map(F.lit, t["words"])).alias("words"),
                F.lit(t["key_from"]).alias("key_from"), F.lit(t["key_to"]).alias("key_to"),
            )
        )
    index = F.create_map(*[x for w, rows in sorted(postings.items()) for x in (F.lit(w), F.array(*rows))])

    def in_place(start: Column, t: Column):
        return lambda i: F.coalesce(F.get("w", start + i) == F.get(t["words"], i), F.lit(False))

    def share(start: Column, t: Column) -> Column:
        size = F.size(t["words"])
        return F.size(F.filter(F.sequence(F.lit(0), size - 1), in_place(start, t))) / size

    def stands(at: Column):
        return lambda t: F.forall(
            F.sequence(t["key_from"], t["key_to"]), in_place(at - t["anchor"], t)
        )

    def beginning(at: Column):
        def place(t: Column) -> Column:
            start = at - t["anchor"]
            return F.struct(start.alias("start"), t["label"].alias("label"), t["base"].alias("base"), share(start, t).alias("share"))
        return lambda t: place(t)

    def look_up(at: Column) -> Column:
        return F.transform(F.filter(index[F.get("w", at)], stands(at)), beginning(at))

    split = media_items.select("media_item_id", notice_words(F.col("google_description")).alias("w"))
    marked = split.select(
        "media_item_id", "w",
        F.array_compact(F.transform("w", lambda w, i: F.when(w.isin(sorted(postings)), i))).alias("at"),
    )
    found = marked.select(
        "media_item_id", F.size("w").cast("bigint").alias("n_words"),
        F.filter(F.flatten(F.transform("at", look_up)), lambda p: p["base"] | (p["share"] >= min_share)).alias("places"),
    )
    base = F.filter("places", lambda p: p["base"])
    starts = found.select("media_item_id", "n_words", "places", base.alias("b"))

    def joined(places: str) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(F.col(f"{places}.label"))), ",")

    worth = F.transform("places", lambda p: F.when(p["base"], F.lit(0.5)).otherwise(p["share"]))
    return starts.select(
        "media_item_id", "n_words", F.size("b").cast("bigint").alias("n_base"),
        F.array_min("b.start").cast("bigint").alias("first_word"),
        F.array_max("b.start").cast("bigint").alias("last_word"),
        joined("b").alias("base_labels"), joined("places").alias("labels"),
        F.coalesce(F.array_max(worth), F.lit(0.0)).alias("score"), "places",
    )
