"""The queries of the training-data problems, each over its whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from .components import connected_components
from .docpairs import doc_pairs
from .leakage import leaked_items
from .links import valid_links
from .neardup import similar_classes, similar_groups, similar_pairs
from .packing import pack_documents, packing_summary
from .reading import reading_levels
from .topn import top_n


def load(spark, d, table):
    return spark.read.parquet(f"{d}/{table}.parquet")


def p2_found(spark, d):
    return p2_pairs(spark, d).select("unit_id")


def p2_pairs(spark, d):
    return doc_pairs(load(spark, d, "units"), load(spark, d, "source_files"))


def p4_found(spark, d):
    links = valid_links(load(spark, d, "soft_relationships"), "SIMILAR_TO")
    return top_n(links, "source_unit_id", "target_unit_id", "score", 5).select("source_unit_id", "target_unit_id")


def p5_found(spark, d):
    links = valid_links(load(spark, d, "soft_relationships"), "MATCHES").where("score >= 0.6")
    return connected_components(links, "source_unit_id", "target_unit_id").select(F.col("node").alias("unit_id"), F.col("component").alias("group_id"))


def p6_found(spark, d):
    return similar_pairs(load(spark, d, "shingles_v2"), 0.5)


def p6_classes(spark, d):
    """One row per readable set with its class of equal sets."""
    return similar_classes(load(spark, d, "shingles_v2"), 0.5)[1]


def p6_pairs(spark, d):
    """Pairs of classes of equal sets, by their representatives."""
    return similar_classes(load(spark, d, "shingles_v2"), 0.5)[0]


def p6_groups(spark, d):
    return similar_groups(load(spark, d, "shingles_v2"), 0.5)


def p7_containers(spark, d):
    return pack_documents(load(spark, d, "documents"))


def p7_summary(spark, d):
    return packing_summary(pack_documents(load(spark, d, "documents")))


def p8_found(spark, d):
    return leaked_items(load(spark, d, "documents"), load(spark, d, "eval_items"))


def p9_levels(spark, d):
    return reading_levels(load(spark, d, "documents"), load(spark, d, "reading_labels"))


def p9_found(spark, d):
    return p9_levels(spark, d).where("too_demanding").select("doc_id")


QUERIES = {
    "p2_found": p2_found,
    "p2_pairs": p2_pairs,
    "p4_found": p4_found,
    "p5_found": p5_found,
    "p6_found": p6_found,
    "p6_classes": p6_classes,
    "p6_pairs": p6_pairs,
    "p6_groups": p6_groups,
    "p7_containers": p7_containers,
    "p7_summary": p7_summary,
    "p8_found": p8_found,
    "p9_found": p9_found,
    "p9_levels": p9_levels,
}
