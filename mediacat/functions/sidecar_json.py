"""Reading the JSON of a sidecar through the variant type."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from mediacat.functions import times


def field(v: Column, name: str, as_type: str = "string") -> Column:
    return F.try_variant_get(v, f"$.{name}", as_type)


def has_field(v: Column, name: str) -> Column:
    """The key exists, even when its value is null."""
    return field(v, name, "variant").isNotNull()


def json_time(v: Column, name: str) -> Column:
    """ISO text of a time that may be a number, a text or {timestamp, formatted}."""
    value = field(v, name, "variant")
    shape = F.schema_of_variant(value)
    stamp = field(v, f"{name}.timestamp").try_cast("bigint")
    return (
        F.when(shape == "BIGINT", times.epoch_text(field(v, name, "bigint")))
        .when(shape == "STRING", field(v, name))
        .when(
            F.startswith(shape, F.lit("OBJECT")),
            F.when(
                has_field(v, f"{name}.timestamp"), times.epoch_text(stamp)
            ).otherwise(times.formatted_time(field(v, f"{name}.formatted"))),
        )
    )


def geo(v: Column, name: str, key: str) -> Column:
    """One coordinate; text that is not a number is NULL."""
    return field(v, f"{name}.{key}", "double")


def people_names(v: Column) -> Column:
    """Names in tag order; entries without a name are left out."""
    people = F.try_variant_get(v, "$.people", "array<variant>")
    names = F.transform(people, lambda p: F.try_variant_get(p, "$.name", "string"))
    return F.coalesce(F.filter(names, lambda n: n.isNotNull()), F.array().cast("array<string>"))


def parsed_columns(v: Column) -> list[Column]:
    """The typed columns of one parsed sidecar."""
    has_geo = has_field(v, "geoData")

    def coordinate(key: str) -> Column:
        return F.when(has_geo, geo(v, "geoData", key)).otherwise(geo(v, "geoDataExif", key))

    has_taken = has_field(v, "photoTakenTime")
    has_creation = has_field(v, "creationTime") & ~has_taken
    return [
        field(v, "title").alias("json_title"),
        field(v, "description").alias("json_description"),
        F.coalesce(has_taken, F.lit(False)).alias("has_taken"),
        json_time(v, "photoTakenTime").alias("taken"),
        F.coalesce(has_creation, F.lit(False)).alias("has_creation"),
        F.when(has_creation, json_time(v, "creationTime")).alias("creation"),
        coordinate("latitude").alias("latitude"),
        coordinate("longitude").alias("longitude"),
        coordinate("altitude").alias("altitude"),
        coordinate("latitudeSpan").alias("latitude_span"),
        coordinate("longitudeSpan").alias("longitude_span"),
        people_names(v).alias("people"),
        field(v, "url").alias("url"),
        F.to_json(field(v, "googlePhotosOrigin", "variant")).alias("origin"),
        field(v, "imageViews").alias("image_views"),
        F.to_json(field(v, "appSource", "variant")).alias("app_source"),
    ]
