"""Surrogates for personal data in captions and for people's names.

Every detected entity gets a replacement of its own kind: digits for digits, letters of the
same case and script for letters, a host kept for documentation for a mail host, a name of
the same gender for a name. Replacements are drawn with a secret key from the entity itself,
so the same entity has the same replacement in every caption. Drawn replacements that equal
another one, or an entity that really occurs, are drawn again until all differ.

Built-in functions only. The entities are collected as a table of distinct ones, replaced
there and joined back to the captions that have any; other captions are not shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from mediacat.llm.components import lookup
from mediacat.session import checkpointed

#: The word that gives a secret away, in any case, up to the secret itself.
_LED = r"(?i:%s)[\"']?+\s*+[=:]\s*+[\"']?+"

#: Fixed values: (kind, pattern), tried in this order at each place of a text. What
#: ``_LEAD`` finds at the beginning of a match stays in the text and is no part of the entity.
PATTERNS = [
    ("email", r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"),
    ("secret", r"AKIA[0-9A-Z]{16}"),
    ("secret", _LED % "token" + r"[0-9A-Fa-f]{32,}"),
    ("secret", _LED % "password" + r"[^\s\"']{6,}"),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?\b"),
    ("phone", r"\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}"),
    ("phone", r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}\b|\b[0-9]{3}-[0-9]{3}-[0-9]{4}\b"),
    ("ssn", r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b"),
    ("card", r"\b[0-9]{4}(?:[ -]?[0-9]{4}){3}\b"),
    ("ip", r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b(?!\.[0-9])"),
    ("name_m", r"(?<=\bMr\.? |\bHerr |\bMonsieur |\bSeñor )\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?"),
    ("name_f", r"(?<=\bMrs\.? |\bMs\.? |\bFrau |\bMadame |\bSeñora )\p{Lu}[\p{L}'-]+(?: \p{Lu}[\p{L}'-]+)?"),
]
_ANY = "|".join(f"(?:{p})" for _, p in PATTERNS)
_LEAD = "^" + _LED % "token|password"

#: Something of this is in every text with an entity; it is much cheaper to look for.
_HINT = (
    r"@|AKIA|(?i:token|password)[\"']?+\s*+[=:]|\+[0-9]|\([0-9]{3}\)|[A-Z]{2}[0-9]{2}"
    r"|[0-9](?:[0-9]{2}-[0-9]{2}|[0-9]{3}[ -]?[0-9]{4}|[0-9]{0,2}\.[0-9]{1,3}\.[0-9])"
    r"|(?:Mr|Mrs|Ms|Herr|Frau|Monsieur|Madame|Señora?)\.? "
)

#: Letters by script, upper case and lower case in the same order.
_SCRIPTS = {
    "Latin": ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"),
    "Greek": ("ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ", "αβγδεζηθικλμνξοπρστυφχψω"),
    "Cyrillic": ("АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЭЮЯ", "абвгдежзиклмнопрстуфхцчшэюя"),
}
#: Invented first names by script and gender.
_NAMES = {
    ("Latin", "name_m"): ["Alden", "Boris", "Cedric", "Dario", "Emil", "Fabio", "Gustav", "Henrik"],
    ("Latin", "name_f"): ["Alma", "Bianca", "Clara", "Dora", "Elena", "Flora", "Greta", "Helena"],
    ("Greek", "name_m"): ["Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης"],
    ("Greek", "name_f"): ["Άννα", "Βασιλική", "Γεωργία", "Δήμητρα"],
    ("Cyrillic", "name_m"): ["Андрей", "Борис", "Виктор", "Григорий"],
    ("Cyrillic", "name_f"): ["Анна", "Борислава", "Вера", "Галина"],
}
_MOST_DRAWS = 12


def find_entities(text: Column) -> Column:
    """All matches of a text in order, each an entity with its lead; NULL has none."""
    return F.coalesce(F.regexp_extract_all(text, F.lit(_ANY), F.lit(0)), F.array().cast("array<string>"))


def lead_of(match: Column) -> Column:
    """What a match has before its entity."""
    return F.regexp_extract(match, _LEAD, 0)


def kind_of(match: Column) -> Column:
    """The kind of a match. What only its surroundings tell is decided by shape."""
    whole = [(k, p) for k, p in PATTERNS if not p.startswith("(?<=")]
    found = F.lit(None).cast("string")
    for kind, pattern in reversed(whole):
        found = F.when(F.rlike(match, F.lit(f"^(?:{pattern})$")), F.lit(kind)).otherwise(found)
    name = F.rlike(match, F.lit(r"^\p{Lu}[\p{L}'-]+( \p{Lu}[\p{L}'-]+)?$"))
    return F.coalesce(found, F.when(name, F.lit("name")), F.lit("secret"))


def _drawn(entity: Column, key: str, draw: Column) -> Column:
    """Hex digits from the key, the entity and the number of the draw, as many as it may need."""
    def block(i: Column) -> Column:
        seed = F.concat_ws("\u0001", F.lit(key), draw.cast("string"), i.cast("string"), entity)
        return F.sha2(seed, 256)
    blocks = F.floor(F.length(entity) / F.lit(16)).cast("int")
    return F.array_join(F.transform(F.sequence(F.lit(0), blocks), block), "")


def _letter(c: Column, value: Column) -> Column:
    """Another letter or digit like ``c``, picked by ``value``; other characters stay."""
    found = c
    for upper, lower in reversed(_SCRIPTS.values()):
        for letters in (upper, lower):
            pick = F.substring(F.lit(letters), (F.pmod(value, F.lit(len(letters))) + 1).cast("int"), F.lit(1))
            found = F.when(F.contains(F.lit(letters), c), pick).otherwise(found)
    digit = F.pmod(value, F.lit(10)).cast("string")
    # accented and further letters become plain Latin ones
    other = F.substring(F.lit(_SCRIPTS["Latin"][1]), (F.pmod(value, F.lit(26)) + 1).cast("int"), F.lit(1))
    return (
        F.when(F.rlike(c, F.lit("[0-9]")), digit)
        .when(F.rlike(c, F.lit(r"^\p{L}$")) & (found == c) & ~F.rlike(c, F.lit("[A-Za-zΑ-Ωα-ωА-Яа-я]")), other)
        .otherwise(found)
    )


def _like(text: Column, drawn: Column) -> Column:
    """``text`` with every letter and digit replaced by one of its script and case."""
    chars = F.split(text, "")
    def one(c: Column, i: Column) -> Column:
        byte = F.conv(F.substring(drawn, i * 4 + 1, F.lit(4)), 16, 10).cast("bigint")
        return _letter(c, byte)
    return F.array_join(F.transform(chars, one), "")


def _hex_like(entity: Column, drawn: Column) -> Column:
    """As many hex digits; capital where the entity is in capitals or has a capital."""
    digits = F.substring(drawn, F.lit(1), F.length(entity))
    def one(c: Column, i: Column) -> Column:
        digit = F.substring(drawn, i + 1, F.lit(1))
        return F.when(F.rlike(c, F.lit("[A-F]")), F.upper(digit)).otherwise(digit)
    mixed = F.array_join(F.transform(F.split(entity, ""), one), "")
    return F.when(entity == F.lower(entity), digits).when(entity == F.upper(entity), F.upper(digits)).otherwise(mixed)


def surrogate(entity: Column, kind: Column, key: str, draw: Column) -> Column:
    """The replacement of an entity at a draw. Late draws of short entities get longer."""
    drawn = _drawn(entity, key, draw)
    number = F.conv(F.substring(drawn, 1, 8), 16, 10).cast("bigint")
    like = _like(entity, drawn)
    tail = F.when(draw >= 6, F.concat(F.lit("-"), F.substring(drawn, 9, 12))).otherwise(F.lit(""))
    local = _like(F.substring_index(entity, "@", 1), drawn)
    mail = F.concat(local, F.when(draw >= 6, F.substring(drawn, 9, 12)).otherwise(F.lit("")), F.lit("@"),
                    F.element_at(F.array(*map(F.lit, ["example.com", "example.net", "example.org"])), (F.pmod(number, F.lit(3)) + 1).cast("int")))
    ip = F.concat_ws(".", *[F.conv(F.substring(drawn, 2 * i + 1, 2), 16, 10) for i in range(4)])
    # the country code of a phone number and the fixed beginning of a key stay
    code = F.regexp_extract(entity, r"^\+[0-9]{1,3}(?=[ .(-])|^AKIA|^[A-Z]{2}(?=[0-9]{2})", 0)
    rest = F.substring(like, F.length(code) + 1, F.length(like))
    hexed = F.rlike(entity, F.lit("^[0-9A-Fa-f]+$"))
    secret = F.when(hexed, _hex_like(entity, drawn)).otherwise(F.concat(code, rest))
    base = F.when(kind == "email", mail).when(kind == "ip", ip).when(kind == "secret", secret)
    base = base.when(F.startswith(kind, F.lit("name")), _name(entity, kind, drawn, number))
    fixed = base.otherwise(F.concat(code, rest))
    return F.when(kind == "email", fixed).otherwise(F.concat(fixed, tail))


def _name(entity: Column, kind: Column, drawn: Column, number: Column) -> Column:
    """A first name of the gender and script, and as many more words as the entity has."""
    script = (
        F.when(F.rlike(entity, F.lit(r"\p{IsCyrillic}")), F.lit("Cyrillic"))
        .when(F.rlike(entity, F.lit(r"\p{IsGreek}")), F.lit("Greek")).otherwise(F.lit("Latin"))
    )
    gender = (
        F.when(kind != "name", kind)
        .when(F.rlike(F.substring_index(entity, " ", 1), F.lit("[aeiаяαη]$")), F.lit("name_f")).otherwise(F.lit("name_m"))
    )
    first = F.lit(None).cast("string")
    for (s, g), names in _NAMES.items():
        pick = F.element_at(F.array(*map(F.lit, names)), (F.pmod(number, F.lit(len(names))) + 1).cast("int"))
        first = F.when((script == s) & (gender == g), pick).otherwise(first)
    family = _like(F.substring_index(entity, " ", -1), drawn)
    return F.when(F.contains(entity, F.lit(" ")), F.concat_ws(" ", first, family)).otherwise(
        F.concat(first, F.lower(F.substring(family, 2, 3)))
    )


def assign_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(entity, surrogate): all different, and none that is itself an entity.

    ``entities`` has one row per distinct entity, with its kind. A draw that meets another
    is repeated for all but the smallest of them; draws from the seventh on are longer, so
    the few rounds end. Each round is written to the shared folder.
    """
    entities = checkpointed(entities)
    left, done, draw = entities, None, 0
    while True:
        drawn = left.select("entity", "kind", surrogate(F.col("entity"), F.col("kind"), key, F.lit(draw)).alias("surrogate"))
        drawn = checkpointed(drawn)
        first = drawn.groupBy("surrogate").agg(F.min("entity").alias("entity"))
        first = first.join(entities.select(F.col("entity").alias("surrogate")), "surrogate", "left_anti")
        if done is not None:
            first = first.join(done.select("surrogate"), "surrogate", "left_anti")
        first = first.select("entity", "surrogate")
        done = checkpointed(first if done is None else done.unionByName(first))
        left = checkpointed(entities.join(done.select("entity"), "entity", "left_anti"))
        draw += 1
        if left.isEmpty():
            return done
        if draw > _MOST_DRAWS:
            raise ValueError("surrogates still collide; the entities leave too little room")


def replace_entities(media_items: DataFrame, key: str) -> DataFrame:
    """``media_items`` with surrogates in google_description, and two columns more.

    ``entities`` lists what was replaced as (entity, surrogate) in order of place, and
    ``n_entities`` counts the places. All other columns stay as they are. Captions without
    entities are unchanged, NULL ones stay NULL. Repeated rows and NULL ids are kept. No
    rows, no rows. Columns of the input named like the two new ones are replaced by them.
    """
    items = media_items.drop("entities", "n_entities")
    text = F.col("google_description")
    pairs = "array<struct<entity:string,surrogate:string>>"
    has_any = F.coalesce(F.rlike(text, F.lit(_HINT)) & F.rlike(text, F.lit(_ANY)), F.lit(False))
    clean = items.filter(~has_any)
    marked = items.withColumn("_row", F.monotonically_increasing_id()).withColumn("_found", find_entities(text))
    touched = checkpointed(marked.filter(has_any))
    own = touched.select("_row", F.explode(F.array_distinct("_found")).alias("match"))
    counted = own.groupBy("match").agg(F.count("*").alias("n")).withColumn("lead", lead_of(F.col("match")))
    counted = checkpointed(counted.select(
        "match", "n", "lead", F.expr("substring(match, length(lead) + 1)").alias("entity"), kind_of(F.col("match")).alias("kind"),
    ))
    kinds = counted.groupBy("entity").agg(F.min("kind").alias("kind"))
    assigned = assign_surrogates(kinds, key)
    mapped = checkpointed(counted.select("match", "n", "lead", "entity").join(assigned, "entity"))
    rows = counted.agg(F.sum("n")).first()[0] or 0
    known = (
        lookup(own, mapped, "match", rows).groupBy("_row")
        .agg(F.map_from_entries(F.collect_list(F.struct("match", F.struct("lead", "entity", "surrogate").alias("new")))).alias("_map"))
    )
    gaps = F.split(text, _ANY, -1)
    def new(match: Column) -> Column:
        return F.element_at(F.col("_map"), match)
    inserted = F.concat(F.transform("_found", lambda m: F.concat(new(m)["lead"], new(m)["surrogate"])), F.array(F.lit("")))
    replaced = F.array_join(F.transform(F.arrays_zip(gaps.alias("gap"), inserted.alias("new")), lambda z: F.concat(z["gap"], z["new"])), "")
    done = touched.join(known, "_row").select(
        *[(replaced if c == "google_description" else F.col(c)).alias(c) for c in items.columns],
        F.transform("_found", lambda m: F.struct(new(m)["entity"].alias("entity"), new(m)["surrogate"].alias("surrogate"))).alias("entities"),
        F.size("_found").cast("bigint").alias("n_entities"),
    )
    untouched = clean.select("*", F.array().cast(pairs).alias("entities"), F.lit(0).cast("bigint").alias("n_entities"))
    return untouched.unionByName(done)


def replace_people(people: DataFrame, key: str) -> DataFrame:
    """``people`` (person_name, ...) with a surrogate_name of like gender and script.

    The gender is told by the ending of the first name. Equal names have one surrogate, no
    two names share one; NULL stays NULL, and an empty name stays empty.
    """
    named = F.coalesce(F.col("person_name"), F.lit("")) != ""
    names = people.filter(named).select(F.col("person_name").alias("entity"), F.lit("name").alias("kind")).distinct()
    assigned = assign_surrogates(names, key).withColumnRenamed("entity", "person_name")
    kept = people.drop("surrogate_name")
    return (
        kept.filter(named).join(assigned.withColumnRenamed("surrogate", "surrogate_name"), "person_name")
        .select(*kept.columns, "surrogate_name")
        .unionByName(kept.filter(~named).withColumn("surrogate_name", F.col("person_name")))
    )
