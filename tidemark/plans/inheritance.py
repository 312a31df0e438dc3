"""What entities take over from the anchor of their cluster: archetypes and confidence, by the relationship that joins them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.plans import network, priors
from tidemark.registry import query
from tidemark.sources import domain as d

# Parts of a relationship's name with the type that they mean, in order; the types that are no business; payments below which an archetype is inherited and the confidence that it takes;
# the penalty of each archetype that is inherited; boosts by the anchor's confidence, the share of the relationship, and the most.
TYPES = (
    (("parent", "subsidiary", "child"), "parent_subsidiary"),
    (("same", "duplicate", "alias"), "same_entity"),
    (("owner", "personal"), "owner_related"),
    (("processor", "payment"), "processor_related"),
    (("internal", "transfer"), "internal"),
    (("related", "associated"), "related_business"),
)
NOT_BUSINESS = ("owner_related", "processor_related", "internal")
FEW, SURE = 2, 0.7
PENALTIES = {"clockwork": 0.1, "slow_reliable": 0.1, "bursty": 0.15, "episodic": 0.2}
BOOST, BOOSTS, MOST = 0.3, {"high": 1.5, "medium": 1.2, "low": 1.0}, 0.3
#: Payments from which a model's confidence is high or medium; the least mean confidence of an entity's relationships; what low and medium entities gain by a stronger anchor: new level, boost, share of the relationship.
LEVELS, WEAK = ((6, "high"), (3, "medium")), 0.5
GAINS = (("low", ("high", "medium"), "medium", 0.2, 0.6), ("medium", ("high",), "high", 0.15, 0.5))


def relationship_type(name: Column) -> Column:
    """The type of a relationship by the first part of its name that is known."""
    low = F.lower(F.trim(name))
    found = [F.when(low.rlike("|".join(parts)), kind) for parts, kind in TYPES]
    return F.coalesce(*found, F.lit("other"))


_TYPE = "CASE " + " ".join("WHEN " + " OR ".join(f"contains(lower(relationship), '{p}')" for p in parts) + f" THEN '{kind}'" for parts, kind in TYPES) + " ELSE 'other' END"
_BOTH = f"rel AS (SELECT from_id AS a, to_id AS b, {_TYPE} AS kind, confidence FROM edges UNION ALL SELECT to_id, from_id, {_TYPE}, confidence FROM edges)"


def relationships(spark: SparkSession, sf: str) -> DataFrame:
    """a, b, kind and confidence of each edge, both ways."""
    e = d.edges(spark, sf).withColumn("kind", relationship_type(F.col("relationship")))
    return e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "kind", "confidence").unionByName(e.select(F.col("to_id").alias("a"), F.col("from_id").alias("b"), "kind", "confidence"))


@query("relationship_types", d.with_tables(f"WITH {_BOTH} SELECT a AS entity_id, kind, count(*) AS n, round(avg(confidence), 6) AS confidence, kind NOT IN {NOT_BUSINESS} AS business FROM rel GROUP BY 1, 2", "edges"))
def relationship_types(spark: SparkSession, sf: str) -> DataFrame:
    """Each entity's relationships by type."""
    found = relationships(spark, sf).groupBy(F.col("a").alias("entity_id"), "kind").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))
    return found.withColumn("business", ~F.col("kind").isin(*NOT_BUSINESS))


def level(n: Column) -> Column:
    return F.coalesce(*(F.when(n >= least, name) for least, name in LEVELS), F.lit("low"))


_LEVEL = lambda n: "CASE " + " ".join(f"WHEN {n} >= {least} THEN '{name}'" for least, name in LEVELS) + " ELSE 'low' END"

_INHERITED = f"""{priors._RECEIPTS}, {_BOTH},
anchors AS (SELECT component, arg_max(entity_id, struct_pack(seq := seq, e := entity_id)) AS anchor FROM cc JOIN entities USING (entity_id) GROUP BY 1 HAVING count(*) > 1),
direct AS (SELECT a, b, max(confidence) AS confidence, max(confidence) FILTER (WHERE kind NOT IN {NOT_BUSINESS}) AS business FROM rel GROUP BY 1, 2),
strength AS (SELECT a, avg(confidence) AS rm FROM rel GROUP BY 1),
x AS (SELECT cc.entity_id, CASE WHEN k.anchor <> cc.entity_id THEN k.anchor END AS anchor, coalesce(f.n, 0) AS n, coalesce(f.archetype, 'low_data') AS own, g.archetype AS theirs, coalesce(g.n, 0) AS anchor_n, t.confidence, t.business, coalesce(rm, 0) AS mean
  FROM cc LEFT JOIN anchors k USING (component) LEFT JOIN ft f ON f.entity_id = cc.entity_id LEFT JOIN ft g ON g.entity_id = k.anchor LEFT JOIN direct t ON t.a = cc.entity_id AND t.b = k.anchor LEFT JOIN strength ON strength.a = cc.entity_id),
y AS (SELECT *, anchor IS NOT NULL AND n < {FEW} AND coalesce(business, 0) > {SURE} AND theirs IN {tuple(PENALTIES)} AND theirs <> own AS takes, {_LEVEL("n")} AS level, {_LEVEL("anchor_n")} AS anchor_level FROM x)"""
_PENALTY = "CASE theirs " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in PENALTIES.items()) + " END"
_GAIN = lambda i: "CASE WHEN anchor IS NULL OR mean < 0.5 THEN {} ".format(("level", "0.0", "0.0")[i]) + " ".join(f"WHEN level = '{a}' AND anchor_level IN ({', '.join(repr(x) for x in of)})" + (f" AND n < 3 THEN " if a == "low" else " THEN ") + (repr(new), str(up), f"mean * {share}")[i] for a, of, new, up, share in GAINS) + f" ELSE {('level', '0.0', '0.0')[i]} END"


@query(
    "inherited_archetypes",
    "WITH RECURSIVE "
    + d.with_tables("SELECT 1", "entities", "edges", "movements")[5:].rsplit("\nSELECT 1", 1)[0]
    + ",\n"
    + network._CC.removeprefix("RECURSIVE ")
    + f""",
cc AS (SELECT id AS entity_id, min(r) AS component FROM w GROUP BY 1), {_INHERITED}
SELECT entity_id, anchor, own AS archetype, CASE WHEN takes THEN theirs ELSE own END AS archetype_used, CASE WHEN takes THEN 'anchor' ELSE 'own' END AS source, CASE WHEN takes THEN {_PENALTY} ELSE 0.0 END::DOUBLE AS penalty,
  round(CASE WHEN anchor IS NULL OR confidence IS NULL THEN 0 ELSE least({MOST}, confidence * {BOOST} * CASE anchor_level WHEN 'high' THEN 1.5 WHEN 'medium' THEN 1.2 ELSE 1.0 END) END, 6)::DOUBLE AS satellite_boost,
  level, {_GAIN(0)} AS boosted_level, round({_GAIN(1)}, 6)::DOUBLE AS level_boost, round({_GAIN(2)}, 6)::DOUBLE AS score_boost FROM y""",
)
def inherited_archetypes(spark: SparkSession, sf: str) -> DataFrame:
    """Every entity's own archetype and the one it goes by, with its source, the penalty of an inherited one, and what a strong anchor adds to its confidence.

    An entity of fewer than two payments takes its anchor's archetype over a sure business relationship to it; volatile ones are not inherited. Anchors come from the cluster table, one row a cluster.
    """
    e = d.entities(spark, sf).select("entity_id", "seq")
    cc = network.clusters(spark, sf)
    anchors = cc.join(e, "entity_id").groupBy("component").agg(F.max_by("entity_id", F.struct("seq", "entity_id")).alias("anchor"), F.count("*").alias("size")).filter("size > 1").drop("size")
    rel = relationships(spark, sf)
    direct = rel.groupBy(F.col("a").alias("entity_id"), F.col("b").alias("anchor")).agg(F.max("confidence").alias("confidence"), F.max(F.when(~F.col("kind").isin(*NOT_BUSINESS), F.col("confidence"))).alias("business"))
    mean = rel.groupBy(F.col("a").alias("entity_id")).agg(F.avg("confidence").alias("mean"))
    f = priors.features(spark, sf).select("entity_id", "n", "archetype")
    theirs = f.select(F.col("entity_id").alias("anchor"), F.col("n").alias("anchor_n"), F.col("archetype").alias("theirs"))
    x = cc.join(anchors, "component", "left").withColumn("anchor", F.when(F.col("anchor") != F.col("entity_id"), F.col("anchor")))
    x = x.join(f, "entity_id", "left").join(theirs, "anchor", "left").join(direct, ["entity_id", "anchor"], "left").join(mean, "entity_id", "left")
    x = x.fillna(0, ["n", "anchor_n", "mean"]).withColumn("archetype", F.coalesce("archetype", F.lit("low_data")))
    c, there = F.col, F.col("anchor").isNotNull()
    takes = F.coalesce(there & (c("n") < FEW) & (c("business") > SURE) & c("theirs").isin(*PENALTIES) & (c("theirs") != c("archetype")), F.lit(False))
    penalty = F.coalesce(*(F.when(takes & (c("theirs") == k), v) for k, v in PENALTIES.items()), F.lit(0.0))
    x = x.withColumns({"level": level(c("n")), "anchor_level": level(c("anchor_n"))})
    factor = F.coalesce(*(F.when(c("anchor_level") == k, v) for k, v in BOOSTS.items()))
    boost = F.when(there & c("confidence").isNotNull(), F.least(F.lit(MOST), c("confidence") * BOOST * factor)).otherwise(0.0)
    met = [there & (c("mean") >= WEAK) & (c("level") == a) & c("anchor_level").isin(*of) & ((c("n") < 3) if a == "low" else F.lit(True)) for a, of, *_ in GAINS]
    gained = lambda i, other: F.coalesce(*(F.when(m, (F.lit(g[2]), F.lit(g[3]), c("mean") * g[4])[i]) for m, g in zip(met, GAINS, strict=True)), other)
    return x.select(
        "entity_id", "anchor", "archetype", F.when(takes, c("theirs")).otherwise(c("archetype")).alias("archetype_used"), F.when(takes, "anchor").otherwise("own").alias("source"), penalty.alias("penalty"), F.round(boost, 6).alias("satellite_boost"), "level",
        gained(0, c("level")).alias("boosted_level"), F.round(gained(1, F.lit(0.0)), 6).alias("level_boost"), F.round(gained(2, F.lit(0.0)), 6).alias("score_boost"),
    )
