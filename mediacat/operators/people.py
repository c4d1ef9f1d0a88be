"""People and their tags on media."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from mediacat.functions import ids


def name_tags(media_names: DataFrame) -> DataFrame:
    """(media_item_id, tag_order, person_name), order from 0; a repeated name counts once."""
    return media_names.select(
        "media_item_id", F.posexplode(F.array_distinct("people")).alias("tag_order", "person_name")
    )


def assign_person_ids(tags: DataFrame, people: DataFrame) -> DataFrame:
    """People table with every name of ``tags``: stored ids stay, new names get one."""
    fresh = (
        tags.select("person_name")
        .distinct()
        .join(people, "person_name", "left_anti")
        .select(ids.person_id(F.col("person_name")).alias("person_id"), "person_name")
    )
    return people.select("person_id", "person_name").unionByName(fresh)


def replace_people_tags(tags: DataFrame, people: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored tags with those of re-read media replaced; media without names keep theirs.

    ``people`` is the output of ``assign_person_ids``.
    """
    fresh = tags.join(people, "person_name").select("media_item_id", "person_id", "tag_order")
    kept = stored.join(tags.select("media_item_id"), "media_item_id", "left_anti")
    return kept.select("media_item_id", "person_id", "tag_order").unionByName(fresh)


def people_of(tags: DataFrame, people: DataFrame) -> DataFrame:
    """(media_item_id, names): person names in tag order."""
    ordered = F.array_sort(F.collect_list(F.struct("tag_order", "person_name")))
    return (
        tags.join(people, "person_id")
        .groupBy("media_item_id")
        .agg(ordered.alias("pairs"))
        .select("media_item_id", F.col("pairs.person_name").alias("names"))
    )
