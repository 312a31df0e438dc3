"""Entity graph: adjacency, components, anchors, neighbourhoods, shared names."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators import graph
from tidemark.registry import query
from tidemark.sources import domain as d

_SYM = "b AS (SELECT from_id AS a, to_id AS b, confidence FROM edges UNION ALL SELECT to_id, from_id, confidence FROM edges)"


@query("entity_adjacency", d.with_tables(f"WITH {_SYM} SELECT a AS entity_id, count(DISTINCT b) AS neighbours, round(avg(confidence), 6) AS confidence FROM b GROUP BY 1", "edges"))
def entity_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    """Symmetric degree and the mean confidence of each entity's edges."""
    e = d.edges(spark, sf)
    both = e.select(F.col("from_id").alias("a"), F.col("to_id").alias("b"), "confidence").union(e.select("to_id", "from_id", "confidence"))
    return both.groupBy(F.col("a").alias("entity_id")).agg(F.countDistinct("b").alias("neighbours"), F.round(F.avg("confidence"), 6).alias("confidence"))


_CC = """RECURSIVE w AS (SELECT entity_id AS id, entity_id AS r FROM entities UNION SELECT x.b, w.r FROM w JOIN (SELECT from_id AS a, to_id AS b FROM edges WHERE relationship = 'same_entity'
  UNION ALL SELECT to_id, from_id FROM edges WHERE relationship = 'same_entity') x ON x.a = w.id)"""


def _components_sql(body: str) -> str:
    return "WITH RECURSIVE " + d.with_tables("SELECT 1", "entities", "edges")[5:].rsplit("\nSELECT 1", 1)[0] + ",\n" + _CC.removeprefix("RECURSIVE ") + ",\ncc AS (SELECT id AS entity_id, min(r) AS component FROM w GROUP BY 1)\n" + body


def clusters(spark: SparkSession, sf: str) -> DataFrame:
    e = d.edges(spark, sf).filter("relationship = 'same_entity'")
    return graph.components(d.entities(spark, sf).select(F.col("entity_id").alias("id")), e).withColumnRenamed("id", "entity_id")


@query("entity_components", _components_sql("SELECT * FROM cc"))
def entity_components(spark: SparkSession, sf: str) -> DataFrame:
    """Connected components over same_entity edges."""
    return clusters(spark, sf)


@query(
    "entity_clusters",
    _components_sql("""SELECT component, count(*) AS members, arg_max(entity_id, struct_pack(seq := seq, e := entity_id)) AS anchor, sum(seq)::BIGINT AS total FROM cc JOIN entities USING (entity_id) GROUP BY 1 HAVING count(*) > 1"""),
)
def entity_clusters(spark: SparkSession, sf: str) -> DataFrame:
    """Clusters with their anchor, the member of largest weight."""
    e = d.entities(spark, sf).select("entity_id", "seq")
    return clusters(spark, sf).join(e, "entity_id").groupBy("component").agg(F.count("*").alias("members"), F.max_by("entity_id", F.struct("seq", "entity_id")).alias("anchor"), F.sum("seq").alias("total")).filter("members > 1")


@query(
    "two_hop_neighbours",
    d.with_tables(
        """WITH x AS (SELECT from_id AS a, to_id AS b FROM edges UNION SELECT to_id, from_id FROM edges), s AS (SELECT entity_id FROM entities WHERE seq % 20 = 0), r AS (
  SELECT entity_id AS start, entity_id AS id, 0 AS depth FROM s UNION SELECT s.entity_id, x.b, 1 FROM s JOIN x ON x.a = s.entity_id UNION SELECT s.entity_id, y.b, 2 FROM s JOIN x ON x.a = s.entity_id JOIN x y ON y.a = x.b)
SELECT start, id, min(depth)::INTEGER AS depth FROM r GROUP BY 1, 2""",
        "edges",
        "entities",
    ),
)
def two_hop_neighbours(spark: SparkSession, sf: str) -> DataFrame:
    """What lies within two edges of each twentieth entity."""
    starts = d.entities(spark, sf).filter("seq % 20 = 0").select(F.col("entity_id").alias("id"))
    return graph.neighbourhood(starts, d.edges(spark, sf), 2)


@query(
    "shared_attribute_pairs",
    d.with_tables("SELECT a.entity_id AS id1, b.entity_id AS id2 FROM entities a JOIN entities b ON a.nation_key = b.nation_key AND a.seq % 100 = b.seq % 100 AND a.entity_id < b.entity_id", "entities"),
)
def shared_attribute_pairs(spark: SparkSession, sf: str) -> DataFrame:
    """Pairs of entities that share their attributes (an equi-self-join)."""
    e = d.entities(spark, sf).select("entity_id", "nation_key", (F.col("seq") % 100).alias("k"))
    b = e.withColumnRenamed("entity_id", "id2")
    return e.join(b, ["nation_key", "k"]).filter("entity_id < id2").select(F.col("entity_id").alias("id1"), "id2")


@query(
    "cluster_patterns",
    _components_sql("""SELECT component, floor(sum(t)::DOUBLE / sum(n) * 1000000 + 0.5) / 1000000 AS weighted_amount, sum(n)::BIGINT AS payments FROM cc JOIN (SELECT entity_id, count(*) AS n, sum(amount) AS t FROM (""" + d.SQL["movements"][0].replace("FROM cash_events", "FROM (" + d.SQL["cash_events"][0] + ")") + """) GROUP BY 1) USING (entity_id) GROUP BY 1"""),
)
def cluster_patterns(spark: SparkSession, sf: str) -> DataFrame:
    """Payment-weighted means over each cluster."""
    p = d.movements(spark, sf).groupBy("entity_id").agg(F.count("*").alias("n"), F.sum("amount").alias("t"))
    return clusters(spark, sf).join(p, "entity_id").groupBy("component").agg((F.floor(F.sum("t").cast("double") / F.sum("n") * 1000000 + 0.5) / 1000000).alias("weighted_amount"), F.sum("n").alias("payments"))
