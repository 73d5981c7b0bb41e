"""Entities across documents: what is mentioned together in a document belongs together, over any number of documents.

Documents and mentions are the two sides of a graph; an entity is a connected component of it. Mentions of very many
documents (a help desk's address in every footer) are hubs and documents with very many mentions are lists: neither
joins what it touches, and so no vertex of the graph has more edges than the two bounds allow. Labels spread by the
least mention, and follow the labels of their labels, so that long chains take few rounds; each round is written to
the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.session import shared_place

#: Documents of a mention, and mentions of a document, up to which they link.
HUB, LIST = 50, 50


def _written(df: DataFrame, name: str) -> DataFrame:
    at = shared_place(df.sparkSession, name)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def links(mentions: DataFrame, doc: str = "doc_id", hub: int = HUB, many: int = LIST) -> DataFrame:
    """Distinct (doc, mention) rows that may link: without hubs and lists."""
    pairs = _written(mentions.where(F.col("mention").isNotNull() & F.col(doc).isNotNull()).select(F.col(doc).alias("doc"), "mention").distinct(), "mentions")
    few = lambda key, most: pairs.groupBy(key).agg(F.count("*").alias("n")).where(F.col("n") <= most).select(key)
    # a hub's rows all leave, so its key is dropped before the join by an anti-join on the few hubs there are
    hubs = pairs.groupBy("mention").agg(F.count("*").alias("n")).where(F.col("n") > hub).select("mention")
    return pairs.join(hubs, "mention", "left_anti").join(few("doc", many), "doc", "left_semi")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """mention, entity: the least mention that can be reached from each."""
    edges = _written(edges.select("doc", "mention"), "edges")
    labels = edges.select("mention").distinct().withColumn("entity", F.col("mention"))
    for _ in range(rounds):
        by_doc = edges.join(labels, "mention").groupBy("doc").agg(F.min("entity").alias("entity"))
        spread = edges.join(by_doc, "doc").groupBy("mention").agg(F.min("entity").alias("entity"))
        # the label's own label: doubles the distance of each round
        own = spread.select(F.col("mention").alias("entity"), F.col("entity").alias("top"))
        jumped = spread.join(own, "entity").select("mention", F.least("entity", "top").alias("entity"))
        after = _written(jumped.join(labels.withColumnRenamed("entity", "was"), "mention").select("mention", "entity", (F.col("entity") != F.col("was")).alias("moved")), "labels")
        labels = after.select("mention", "entity")
        if not after.where("moved").limit(1).count():
            return labels
    raise RuntimeError(f"the components did not settle in {rounds} rounds")


def resolved(mentions: DataFrame, doc: str = "doc_id", hub: int = HUB, many: int = LIST) -> DataFrame:
    """mention, n_docs, entity, canonical (its most frequent mention, the least of equals), n_mentions of every mention. Hubs and mentions of lists stand alone."""
    seen = mentions.where(F.col("mention").isNotNull()).groupBy("mention").agg(F.count_distinct(doc).alias("n_docs"))
    labels = components(links(mentions, doc, hub, many))
    named = _written(seen.join(labels, "mention", "left").withColumn("entity", F.coalesce("entity", "mention")), "named")
    best = named.groupBy("entity").agg(F.min_by("mention", F.struct(-F.col("n_docs"), "mention")).alias("canonical"), F.count("*").alias("n_mentions"))
    return named.join(best, "entity").select("mention", "n_docs", "entity", "canonical", "n_mentions")
