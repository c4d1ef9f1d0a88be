"""Licence notices against a plain walk over the words."""

import re

from mediacat.llm import license_notices as notices

TEXTS = [
    None, "", " .,", "MIT License", "the mit license, MIT LICENSE and mit\nlicense", "cc-by 4.0 cc by cc",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache License, Version 2.0. More. licensed by apache license version 2 0",
    "GNU General Public Licens", "gnu gnu general public license license", "apache license version 2 0 " * 40,
    "Permission is hereby granted, free of charge, to any person", "hereby granted free of charge",
    "ünder gnu général public license mit licens\u00e9", "\u212amit license", "a_mit license x1 mit license",
    "license mit " * 30, "Licensed under CC BY-NC 4.0.", "general public license gnu general public license",
]


def plain(text, min_share=0.6):
    words = re.findall(notices.WORD, re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base, every, worth = [], set(), [0.0]
    for t in notices.templates():
        a, b = t["key_from"], t["key_to"] + 1
        for p in range(len(words)):
            start = p - a
            if words[p : p + b - a] == t["words"][a:b]:
                hits = sum(0 <= start + i < len(words) and words[start + i] == w for i, w in enumerate(t["words"]))
                share = hits / len(t["words"])
                if t["base"]:
                    base.append((start, t["label"]))
                if t["base"] or share >= min_share:
                    every.add(t["label"])
                    worth.append(0.5 if t["base"] else share)
    starts = [s for s, _ in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None),
        ",".join(sorted({x for _, x in base})), ",".join(sorted(every)), round(max(worth), 9),
    )


def test_against_plain_walk(spark):
    rows = [(i, t, 1) for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], 2), (None, TEXTS[6], 3)]
    items = spark.createDataFrame(rows, "media_item_id bigint, google_description string, w int")
    got = notices.scan_notices(items).collect()
    have = sorted(
        (str(r.media_item_id), r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, round(r.score, 9))
        for r in got
    )
    assert have == sorted((str(i), *plain(t)) for i, t, _ in rows)
    assert {r.labels for r in got} >= {"apache,apache-2.0", "gpl,gpl-3.0", "cc-by,cc-by-nc-4.0"}


def test_no_rows_and_no_python(spark):
    items = spark.createDataFrame([], "media_item_id bigint, google_description string")
    found = notices.scan_notices(items)
    assert found.collect() == []
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_one_very_long_text(spark):
    text = "word " * 200_000 + "mit license"
    items = spark.createDataFrame([(1, text)], "media_item_id bigint, google_description string")
    row = notices.scan_notices(items).first()
    assert (row.n_words, row.first_word, row.labels) == (200_002, 200_000, "mit")
