"""Names to known names, level by level: equal, alias, similar; each level sees what the levels above left, and the first known name in order wins.

No level forms all pairs. An alias holds the other key or is held by it (met by rarest grams), or shares its first letters: the beginnings of known keys are grouped by
beginning and length, with the first name of each group alone. Similar names share three quarters of their words at least, so the rarest words of both meet.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions import names
from tidemark.operators import containment

# The least key of an alias, the share of the shorter key that begins both, the similarity of names, and what share of words that needs.
LEAST, BEGIN, SIMILAR, WORDS = 3, 85, 0.85, 75


def _begin(key: str):
    """The letters of a key that an alias must share."""
    return F.ceil(F.length(key) * BEGIN / 100).cast("int")


def _beginnings(df: DataFrame, *more: str) -> DataFrame:
    """Every beginning of a key, of ``LEAST`` letters or more."""
    some = F.when(F.length("key") >= LEAST, F.sequence(F.lit(LEAST), F.length("key"))).otherwise(F.array().cast("array<int>"))
    return df.select("key", *more, F.length("key").alias("size"), F.explode(F.transform(some, lambda n: F.substring("key", F.lit(1), n))).alias("part"))


def aliases(asked: DataFrame, known: DataFrame) -> DataFrame:
    """key and place: the first known place that is an alias of each asked key; asked: key; known: key and place."""
    held = containment.within(asked, known.select("key").distinct(), LEAST).join(known.select(F.col("key").alias("b"), "place"), "b").groupBy(F.col("a").alias("key")).agg(F.min("place").alias("place"))
    long_enough = F.length("key") >= LEAST
    own = lambda df, *more: df.filter(long_enough).select("key", *more, F.length("key").alias("size"), F.substring("key", F.lit(1), _begin("key")).alias("part")).filter(F.length("part") >= LEAST)
    # Longer known keys that begin like the asked one; shorter known keys whose beginning begins the asked one.
    longer = _beginnings(known, "place").groupBy("part", F.col("size").alias("known_size")).agg(F.min("place").alias("place"))
    first = own(asked).join(longer, "part").filter("known_size >= size").select("key", "place")
    shorter = own(known, "place").groupBy("part", F.col("size").alias("known_size")).agg(F.min("place").alias("place"))
    second = _beginnings(asked).join(shorter, "part").filter("known_size < size").select("key", "place")
    return held.unionByName(first).unionByName(second).groupBy("key").agg(F.min("place").alias("place"))


def similar(asked: DataFrame, known: DataFrame) -> DataFrame:
    """name and place: the first known name of similarity ``SIMILAR`` or more to each asked one; asked: name; known: name and place."""
    parted = lambda df: df.withColumn("words", names.tokens(F.col("name"))).filter(F.size("words") > 0)
    a, b = parted(asked), parted(known)
    often = b.select(F.explode("words").alias("word")).groupBy("word").agg(F.count("*").alias("n"))

    def rare(df: DataFrame, *more: str) -> DataFrame:
        """The rarest words of each name: so many that two names with enough in common share one."""
        x = df.select("name", *more, F.size("words").alias("size"), F.explode("words").alias("word")).join(often, "word", "left").groupBy("name", *more, "size").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "word"))).alias("ws"))
        need = F.col("size") - F.ceil(F.col("size") * WORDS / 100) + 1
        return x.select("name", *more, F.explode(F.transform(F.slice("ws", F.lit(1), need.cast("int")), lambda w: w["word"])).alias("word"))

    pairs = rare(a).join(rare(b.withColumnRenamed("place", "known_place"), "known_place").withColumnRenamed("name", "other"), "word").select("name", "other", "known_place").distinct()
    return pairs.filter(names.name_similarity(F.col("name"), F.col("other")) >= SIMILAR).groupBy("name").agg(F.min("known_place").alias("place"))


def matched(asked: DataFrame, known: DataFrame) -> DataFrame:
    """name, known_name and level (exact, alias, similar) of each distinct asked name that some level finds; asked: name; known: name. Known names go in the order of their text; keys of fewer than two characters match nothing."""
    order = known.select("name").distinct()
    keyed = asked.select("name").distinct().withColumn("key", names.match_key(F.col("name"))).filter(F.length("key") >= 2)
    book = order.select(names.match_key(F.col("name")).alias("key"), F.col("name").alias("place")).filter("key <> ''")
    first = book.groupBy("key").agg(F.min("place").alias("place"))
    exact = keyed.join(first, "key").select("name", F.col("place").alias("known_name"), F.lit("exact").alias("level"))
    rest = keyed.join(exact.select("name"), "name", "left_anti")
    alias = rest.join(aliases(rest.select("key").distinct(), first), "key").select("name", F.col("place").alias("known_name"), F.lit("alias").alias("level"))
    rest = rest.join(alias.select("name"), "name", "left_anti")
    near = similar(rest.select("name"), order.select("name", F.col("name").alias("place"))).select("name", F.col("place").alias("known_name"), F.lit("similar").alias("level"))
    return exact.unionByName(alias).unionByName(near)
