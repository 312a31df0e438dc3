"""Descriptors to entities, level by level: equal keys, then keys of one prefix by score, then owners' names within.

Levels see only what those above left. All work is over distinct keys, and no level forms the pairs of a prefix that everyone shares:

* a score by words depends on the words of both keys alone, so keys with equal words are one signature and signatures meet by prefix;
* keys at the start or the end of one another score by their lengths instead. They are found by equi-joins on the prefixes and suffixes of
  keys, of which there are at most as many as letters;
* of a signature, the best is the first key in order that is not such a pair with the query: the first rank that those pairs leave out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators import containment

# Letters of the shared prefix, the least score, and the least lengths of a key, a word and an owner's name.
PREFIX, SCORE, KEY, WORD, OWNER = 6, 0.6, 4, 3, 4


def _words(key: str) -> Column:
    return F.filter(F.regexp_extract_all(F.col(key), F.lit("([a-z]+)")), lambda w: F.length(w) >= WORD)


def word_score(query: Column, candidate: Column) -> Column:
    """The share of the query's words that equal one of the candidate's, or begin it or are begun by it where both have four letters."""
    long = lambda w: F.length(w) >= 4
    same = lambda q, c: (q == c) | long(q) & long(c) & (c.startswith(q) | q.startswith(c))
    hits = F.size(F.filter(query, lambda q: F.exists(candidate, lambda c: same(q, c))))
    return F.when(F.size(query) > 0, hits / F.size(query)).otherwise(0.0)


def _ends(df: DataFrame, name: str) -> DataFrame:
    """name, part and at: the beginnings (1) and ends (0) of a key, of the least length of a key on, itself not."""
    k = F.col(name)
    sizes = F.when(F.length(k) > KEY, F.sequence(F.lit(KEY), F.length(k) - 1)).otherwise(F.array().cast("array<int>"))
    parts = F.flatten(F.array(F.transform(sizes, lambda n: F.struct(F.substring(k, F.lit(1), n).alias("part"), F.lit(1).alias("at"))), F.transform(sizes, lambda n: F.struct(F.substring(k, F.length(k) - n + 1, n).alias("part"), F.lit(0).alias("at")))))
    return df.select(name, F.explode(parts).alias("x")).select(name, "x.part", "x.at")


def _nested(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query and key of one prefix where one begins or ends the other; queries: query; index: key."""
    inner = _ends(queries, "query").join(index.withColumnRenamed("key", "part"), "part").select("query", F.col("part").alias("key"))
    outer = _ends(index, "key").join(queries.withColumnRenamed("query", "part"), "part").select(F.col("part").alias("query"), "key")
    return inner.unionByName(outer).filter(F.substring("query", 1, PREFIX) == F.substring("key", 1, PREFIX)).distinct()


def by_prefix(queries: DataFrame, index: DataFrame) -> DataFrame:
    """query, key and score: the best key of each query that shares its prefix and scores ``SCORE`` or more; of equal scores the least key. Both hold distinct values, none equal."""
    queries, index = queries.filter(F.length("query") >= PREFIX), index.filter(F.length("key") >= PREFIX)
    nested = _nested(queries, index)
    lengths = F.least(F.length("query"), F.length("key")) / F.greatest(F.length("query"), F.length("key"))
    best = nested.select("query", "key", lengths.alias("score"))
    signed = index.select("key", F.substring("key", 1, PREFIX).alias("prefix"), _words("key").alias("words")).withColumn("rank", F.row_number().over(Window.partitionBy("prefix", "words").orderBy("key")))
    asked = queries.select("query", F.substring("query", 1, PREFIX).alias("prefix"), _words("query").alias("asked"))
    score = word_score(F.col("asked"), F.col("words"))
    signatures = asked.select("prefix", "asked").distinct().join(signed.select("prefix", "words").distinct(), "prefix").withColumn("score", score).filter(F.col("score") >= SCORE)
    # Ranks of a signature that a query meets as a nested key: those from 1 on without a gap are passed over.
    met = nested.join(signed, "key").withColumn("n", F.row_number().over(Window.partitionBy("query", "words").orderBy("rank"))).filter("n = rank")
    passed = met.groupBy("query", "words").agg(F.max("n").alias("passed"))
    worded = asked.join(signatures, ["prefix", "asked"]).join(passed, ["query", "words"], "left").withColumn("rank", F.coalesce("passed", F.lit(0)) + 1)
    worded = worded.join(signed, ["prefix", "words", "rank"]).select("query", "key", "score")
    found = best.unionByName(worded).filter(F.col("score") >= SCORE)
    return found.groupBy("query").agg(F.min_by(F.struct("key", "score"), F.struct(-F.col("score"), "key")).alias("x")).select("query", "x.key", "x.score")


def resolve(descriptors: DataFrame, identities: DataFrame, owners: DataFrame) -> DataFrame:
    """descriptor_id, entity_id, level (exact, prefix, owner) and score of every descriptor that some level resolves.

    descriptors: descriptor_id, place and key, the texts of one descriptor in the order in which they are tried, each by all levels; identities: key and entity_id; owners: key and entity_id.
    Keys are lower-case letters and digits; those of fewer than two characters are not tried, shorter ones than the prefix only as a whole. Of entities that share a key the least counts.
    """
    index = identities.groupBy("key").agg(F.min("entity_id").alias("entity_id"))
    keys = descriptors.filter(F.length("key") >= 2).select("key").distinct()
    exact = keys.join(index, "key").select("key", "entity_id", F.lit("exact").alias("level"), F.lit(1.0).alias("score"))
    rest = keys.join(exact.select("key"), "key", "left_anti")
    near = by_prefix(rest.select(F.col("key").alias("query")), index.filter(F.length("key") >= KEY).select("key")).join(index, "key").select(F.col("query").alias("key"), "entity_id", F.lit("prefix").alias("level"), "score")
    rest = rest.join(near.select("key"), "key", "left_anti").filter(F.length("key") >= PREFIX)
    own = owners.filter(F.length("key") >= OWNER)
    inside = containment.within(rest, own.select("key").distinct(), OWNER).filter(F.col("a").contains(F.col("b")))
    owned = inside.join(own.select(F.col("key").alias("b"), "entity_id"), "b").groupBy(F.col("a").alias("key")).agg(F.min("entity_id").alias("entity_id")).select("key", "entity_id", F.lit("owner").alias("level"), F.lit(1.0).alias("score"))
    found = descriptors.join(exact.unionByName(near).unionByName(owned), "key")
    first = found.groupBy("descriptor_id").agg(F.min_by(F.struct("entity_id", "level", "score"), "place").alias("x"))
    return first.select("descriptor_id", "x.entity_id", "x.level", "x.score")
