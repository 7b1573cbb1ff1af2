"""Entity tags in texts: parsing, names and translation to characters."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliptide.session import broadcast_when_small, cut_lineage

# Sentence shapes that name a voice, in order of precedence.
NAME_PATTERNS = [
    r"Name:\s*<voice_(\d+)>\s+is\s+([A-Z][a-zA-Z]+)",
    r"<voice_(\d+)>'s\s+name\s+is\s+([A-Z][a-zA-Z]+)",
    r"<voice_(\d+)>\s+is\s+named\s+([A-Z][a-zA-Z]+)",
    r"<voice_(\d+)>\s+introduces\s+(?:themselves|herself|himself)\s+as\s+([A-Z][a-zA-Z]+)",
]
_TAG = r"<((?:face|voice|character)_[0-9]+)>"


def entity_tags(text: Column) -> Column:
    """Bracketed face, voice and character tags in order of appearance."""
    return F.regexp_extract_all(text, F.lit(_TAG), F.lit(1))


def voice_name(text: Column) -> Column:
    """(voice, name) by the first sentence shape that fits, null if none does."""
    options = [
        F.when(
            text.rlike(p),
            F.struct(
                F.regexp_extract(text, p, 1).cast("bigint").alias("voice"),
                F.regexp_extract(text, p, 2).alias("name"),
            ),
        )
        for p in NAME_PATTERNS
    ]
    return F.coalesce(*options)


def person_name(text: Column) -> Column:
    """Lower case, letters, digits, dash and apostrophe only, single blanks."""
    kept = F.regexp_replace(F.lower(F.trim(F.coalesce(text, F.lit("")))), "[^A-Za-z0-9\\-' ]+", "")
    return F.trim(F.regexp_replace(kept, " +", " "))


def names_of_voices(texts: DataFrame, graph: list[str], order: str, text: str) -> DataFrame:
    """Last name told for each voice."""
    told = texts.withColumn("told", voice_name(F.col(text))).filter(F.col("told").isNotNull())
    return told.groupBy(*graph, F.col("told.voice").alias("voice")).agg(
        F.max_by(F.col("told.name"), order).alias("name")
    )


def names_of_characters(names: DataFrame, members: DataFrame, graph: list[str]) -> DataFrame:
    """First voice's name per character."""
    joined = names.join(members.withColumnRenamed("node_id", "voice"), [*graph, "voice"])
    return joined.groupBy(*graph, "character").agg(F.min_by("name", "voice").alias("name"))


def asked_speakers(
    queries: DataFrame, names: DataFrame, graph: list[str], text: str, key: list[str]
) -> tuple[DataFrame, DataFrame]:
    """Voices whose spoken name occurs as whole words in the query: (graph, key, names) and (graph, names, voice).

    Query word runs up to the longest name are joined on equality, so no query is held against
    every name. Queries that tell the same names ask for the same voices, so the voices stand once per set of names.
    """
    normal = names.select(*graph, person_name(F.col("name")).alias("gram"), "voice").filter("gram <> ''")
    normal = cut_lineage(normal.distinct())
    longest = normal.agg(F.coalesce(F.max(F.size(F.split("gram", " "))), F.lit(1))).first()[0]
    words = F.filter(F.split(person_name(F.col(text)), " "), lambda w: w != "")
    runs = queries.select(*graph, *key, words.alias("w")).withColumn(
        "gram",
        F.explode(
            F.array_distinct(
                F.flatten(
                    F.transform(
                        F.sequence(F.lit(1), F.lit(int(longest))),
                        lambda n: F.transform(
                            F.when(F.size("w") >= n, F.sequence(F.lit(1), F.size("w") - n + 1)).otherwise(
                                F.array().cast("array<int>")
                            ),
                            lambda i: F.array_join(F.slice("w", i, n), " "),
                        ),
                    )
                )
            )
        ),
    )
    told = runs.join(broadcast_when_small(normal.select(*graph, "gram").distinct(), 256), [*graph, "gram"])
    asked = cut_lineage(told.groupBy(*graph, *key).agg(F.array_sort(F.collect_set("gram")).alias("names")))
    sets = asked.select(*graph, "names").distinct().withColumn("gram", F.explode("names"))
    return asked, sets.join(normal, [*graph, "gram"]).select(*graph, "names", "voice").distinct()


def translate(texts: DataFrame, mapping: DataFrame, graph: list[str], key: list[str], text: str) -> DataFrame:
    """Replace bracketed face and voice tags by character tags; equivalence lines are dropped.

    Texts are split at tags, tags joined with the mapping and the pieces put back in order.
    """
    kept = texts.filter(~F.lower(F.col(text)).startswith("equivalence: "))
    pieces = kept.select(
        *graph, *key, F.posexplode(F.split(text, r"(?=<(?:face|voice)_[0-9]+>)|(?<=[0-9]>)")).alias("pos", "piece")
    )
    tagged = pieces.withColumn("tag", F.regexp_extract("piece", r"^<((?:face|voice)_[0-9]+)>$", 1))
    known = mapping.select(*graph, "tag", "character_tag")
    joined = tagged.join(known, [*graph, "tag"], "left").withColumn(
        "piece",
        F.when(F.col("character_tag").isNotNull(), F.concat(F.lit("<"), "character_tag", F.lit(">"))).otherwise(
            F.col("piece")
        ),
    )
    parts = F.array_sort(F.collect_list(F.struct("pos", "piece")))
    return joined.groupBy(*graph, *key).agg(
        F.array_join(F.transform(parts, lambda p: p["piece"]), "").alias(text)
    )


def query_variants(queries: DataFrame, members: DataFrame, graph: list[str], key: list[str], text: str) -> DataFrame:
    """Rewrite each character tag into every alias: all variants, numbered in order of their aliases.

    One tag is expanded per pass (in order of appearance) into a row per alias, so no row holds more than one variant
    and a query without tags costs no join. A variant's number follows from the numbers of its aliases; nothing is sorted.
    """
    in_order = Window.partitionBy(*graph, "character_tag").orderBy("__alias")
    aliases = (
        members.select(*graph, "character_tag", F.col("tag").alias("__alias"))
        .distinct()
        .withColumn("__n", F.row_number().over(in_order) - 1)
    )
    rows = queries.withColumn("__tags", F.array_distinct(F.filter(entity_tags(F.col(text)), lambda t: t.startswith("character_"))))
    rows = rows.withColumn("variant", F.lit(0).cast("bigint")).withColumn("__times", F.lit(1).cast("bigint"))
    longest = rows.agg(F.coalesce(F.max(F.size("__tags")), F.lit(0))).first()[0]
    sizes = aliases.groupBy(*graph, "character_tag").agg(F.count("*").alias("__size"))
    for i in range(int(longest)):
        rows = rows.withColumn("character_tag", F.get("__tags", F.lit(i)))
        rows = rows.join(sizes, [*graph, "character_tag"], "left").join(aliases, [*graph, "character_tag"], "left")
        # the alias of a later tag counts before those of the tags expanded so far
        rows = rows.withColumns({
            text: F.when(
                F.col("__alias").isNotNull(),
                F.replace(F.col(text), F.concat(F.lit("<"), F.col("character_tag"), F.lit(">")), F.concat(F.lit("<"), F.col("__alias"), F.lit(">"))),
            ).otherwise(F.col(text)),
            "variant": F.col("variant") + F.coalesce("__n", F.lit(0)) * F.col("__times"),
            "__times": F.col("__times") * F.coalesce("__size", F.lit(1)),
        }).drop("__alias", "__n", "__size", "character_tag")
    return rows.select(*graph, *key, "variant", text)


def variant_ends(queries: DataFrame, members: DataFrame, graph: list[str], key: list[str], text: str) -> DataFrame:
    """(graph, key, variants, first, last): how many variants ``query_variants`` makes of a query, and the first and last of them by text.

    Variants are a product over the tags of a query, so none is formed: their number is the product of the numbers of aliases.
    Two variants differ first where the earliest tag with another alias stands first, and an alias ends there with its bracket;
    so the first text takes the first alias of every tag in the order of alias and bracket, and the last text the last.
    Aliases are faces and voices, never characters.
    """
    closed = F.concat("tag", F.lit(">"))
    aliases = members.select(*graph, "character_tag", "tag").distinct().groupBy(*graph, "character_tag").agg(
        F.count("*").alias("__size"), F.min_by("tag", closed).alias("__first"), F.max_by("tag", closed).alias("__last")
    )
    aliases = broadcast_when_small(cut_lineage(aliases), 512)
    tags = F.array_distinct(F.filter(entity_tags(F.col(text)), lambda t: t.startswith("character_")))
    rows = queries.select(*graph, *key, tags.alias("__tags"), F.lit(1).cast("bigint").alias("variants"), F.col(text).alias("first"), F.col(text).alias("last"))
    longest = rows.agg(F.coalesce(F.max(F.size("__tags")), F.lit(0))).first()[0]
    for i in range(int(longest)):
        rows = rows.withColumn("character_tag", F.get("__tags", F.lit(i))).join(aliases, [*graph, "character_tag"], "left")

        def named(end: str) -> Column:
            tag, alias = (F.concat(F.lit("<"), F.col(c), F.lit(">")) for c in ("character_tag", f"__{end}"))
            return F.coalesce(F.replace(F.col(end), tag, alias), F.col(end))

        rows = rows.withColumns(
            {"variants": F.col("variants") * F.coalesce("__size", F.lit(1)), "first": named("first"), "last": named("last")}
        ).drop("character_tag", "__size", "__first", "__last")
    return rows.drop("__tags")


def resolve_nodes(
    items: DataFrame, known: DataFrame, matches: DataFrame, graph: list[str], item: str, content: str, node: str
) -> DataFrame:
    """Node of each item: the node that holds exactly its content, else its confident vector match.

    ``known``: (graph, content, node). ``matches``: (graph, item, node) that passed the margin.
    """
    exact = known.groupBy(*graph, content).agg(F.min(node).alias("__exact"))
    near = matches.select(*graph, item, F.col(node).alias("__near"))
    joined = items.join(exact, [*graph, content], "left").join(near, [*graph, item], "left")
    return joined.withColumn(node, F.coalesce("__exact", "__near")).drop("__exact", "__near")


def related_nodes(
    queries: DataFrame, members: DataFrame, graph: list[str], key: list[str], text: str
) -> tuple[DataFrame, DataFrame]:
    """Faces and voices that a query's tags stand for: (graph, key, asked) and (graph, asked, tag).

    A character stands for its members, a face or voice for itself; tags that no character holds are left out. Queries
    with the same set of known tags ask for the same nodes, so the nodes stand once per set.
    """
    told = queries.select(*graph, *key, F.explode(F.array_distinct(entity_tags(F.col(text)))).alias("one"))
    known = cut_lineage(members.select(*graph, F.explode(F.array("character_tag", "tag")).alias("one"), "tag").distinct())
    kept = told.join(broadcast_when_small(known.select(*graph, "one").distinct(), 256), [*graph, "one"])
    asked = cut_lineage(kept.groupBy(*graph, *key).agg(F.array_sort(F.collect_set("one")).alias("asked")))
    sets = asked.select(*graph, "asked").distinct().withColumn("one", F.explode("asked"))
    return asked, sets.join(known, [*graph, "one"]).select(*graph, "asked", "tag").distinct()


def clip_inspection(texts: DataFrame, graph: list[str], clip: str, text: str) -> DataFrame:
    """(graph, clip, texts, faces, voices): how many texts a clip has, and how many faces and voices they name."""
    tags = texts.select(*graph, clip, entity_tags(F.col(text)).alias("tags"))
    counted = tags.groupBy(*graph, clip).agg(F.count("*").alias("texts"))
    named = tags.select(*graph, clip, F.explode("tags").alias("tag")).distinct()
    kinds = named.groupBy(*graph, clip).agg(
        F.count_if(F.col("tag").startswith("face_")).alias("faces"), F.count_if(F.col("tag").startswith("voice_")).alias("voices")
    )
    return counted.join(kinds, [*graph, clip], "left").na.fill(0, ["faces", "voices"])
