"""Mixing sources to target weights.

Words are summed for each source; the sources, by code point with null last, weigh 3, 1, 2
and so on, and share `share` of all words. A target stops at `cap` times its source's words
and the excess goes to the rest by weight: sorted by cap over weight, that is one threshold,
found with prefix sums over one row a source. A document is emitted floor(rate) times, and
once more if a draw from md5(seed, doc_id) falls below the rate's fraction. Null texts have
no words, null doc_ids draw as the empty text, repeated rows draw alike; empty in, empty out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import WORD, table

WEIGHTS, SHARE, CAP, SEED = (3, 1, 2), 1.5, 2.0, "mix-1"


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """(_source, source_size) with target; one row a source."""
    order = F.row_number().over(W.orderBy(F.col("_source").asc_nulls_last()))
    s = sizes.withColumn("w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (order - 1) % len(weights) + 1))
    s = s.withColumn("most", F.lit(cap) * F.col("source_size")).withColumn("bar", F.col("most") / F.col("w"))
    up = W.orderBy("bar", F.col("_source").asc_nulls_last())
    before, after = up.rowsBetween(W.unboundedPreceding, -1), up.rowsBetween(0, W.unboundedFollowing)
    total = F.sum("source_size").over(W.partitionBy()).cast("double")
    s = s.withColumn("level", (F.lit(share) * total - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / F.sum("w").over(after)).withColumn("nth", F.row_number().over(up))
    level = F.min(F.when(F.col("level") <= F.col("bar"), F.struct("nth", "level"))).over(W.partitionBy())["level"]
    return s.select("_source", "source_size", F.least("most", F.coalesce(level * F.col("w"), F.col("most"))).alias("target"))


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """docs with _size, _source_size, _target and _copies."""
    d = docs.withColumn("_size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    sizes = d.groupBy(F.col("source").alias("_source")).agg(F.sum("_size").alias("source_size"))
    t = targets(sizes).withColumnsRenamed({"source_size": "_source_size", "target": "_target"})
    d = d.join(t, d["source"].eqNullSafe(t["_source"])).drop("_source")
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 8), 16, 10).cast("double") / F.lit(4294967296.0)
    return d.withColumn("_copies", (F.floor(rate) + (draw < rate - F.floor(rate)).cast("int")).cast("int"))


def emit(docs: DataFrame) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of docs. Rows are
    wrapped, so no column of docs can clash with those used here."""
    whole = F.struct(*[docs[c] for c in docs.columns]).alias("whole")
    m = mix(docs.select(docs["doc_id"].alias("doc_id"), docs["text"].alias("text"), docs["source"].alias("source"), whole)).filter(F.col("_copies") > 0)
    return m.select("whole", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("whole.*")


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mix(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return m.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_copies") * F.col("_size")).cast("long").alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST(CASE (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS w FROM s),
b AS (SELECT *, CAST(2.0 AS DOUBLE) * source_size AS most, CAST(2.0 AS DOUBLE) * source_size / w AS bar FROM w),
l AS (SELECT *, row_number() OVER up AS nth,
   (CAST(1.5 AS DOUBLE) * CAST(sum(source_size) OVER () AS DOUBLE) - coalesce(sum(most) OVER (ORDER BY bar, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
   / sum(w) OVER (ORDER BY bar, source ASC NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
   FROM b WINDOW up AS (ORDER BY bar, source ASC NULLS LAST)),
v AS (SELECT level FROM l WHERE level <= bar ORDER BY nth LIMIT 1),
t AS (SELECT source, source_size, least(most, coalesce((SELECT level FROM v) * w, most)) AS target FROM l),
r AS (SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
   CAST(('0x' || substr(md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / CAST(4294967296.0 AS DOUBLE) AS draw
   FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target, CAST((floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM r
"""
