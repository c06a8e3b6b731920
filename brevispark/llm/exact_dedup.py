"""Exact dedup by skew-safe combining: local groups, salted digest groups, then salt winners, on full content throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brevispark.llm.common import cut, fresh, named

HOT_ROWS, MOST_HOT, SALTS = 64, 4096, 64


def _sha256(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def _hot(rows: DataFrame, hot_rows: int) -> Column:
    """Whether a row's digest is one of the MOST_HOT largest with hot_rows rows or more: a bounded list, collected."""
    sizes = rows.groupBy("digest").count().where(F.col("count") >= hot_rows)
    found = [r["digest"] for r in sizes.orderBy(F.desc("count"), "digest").limit(MOST_HOT).collect()]
    return F.col("digest").isin(found) if found else F.lit(False)


def _base(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    base = docs.select(named(id_col).alias("doc_id"), F.coalesce(named(text_col), F.lit("")).alias("text"))
    return base.withColumn("digest", digest(F.col("text")))


def groups(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest=_sha256, hot_rows: int = HOT_ROWS
) -> tuple[DataFrame, DataFrame, Column]:
    """(rows, found, hot): rows (doc_id, digest), one of (digest, keep_id, group_size) per distinct text, and the test for
    digests of many rows.

    Digests only route; group keys hold the whole text, so texts whose digests collide stay apart, as several rows of one
    digest. Spark's partial aggregation combines within each task first. A digest of at least hot_rows rows (the MOST_HOT
    largest: a bounded table) is salted by row id, combined by (digest, salt, text) and then its winners by (digest,
    text); all others need one exchange.
    """
    base = _base(docs, id_col, text_col, digest)
    rows = cut(base.select("doc_id", "digest"))
    hot = _hot(rows, hot_rows)
    ids = [F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")]
    cold = base.where(~hot).groupBy("digest", "text").agg(*ids)
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))
    salted = base.where(hot).withColumn("salt", salt).groupBy("digest", "salt", "text").agg(*ids)
    winners = salted.groupBy("digest", "text").agg(
        F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size")
    )
    found = cut(cold.unionByName(winners).select("digest", "keep_id", "group_size"))
    return rows, found, hot


def mark(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", digest=_sha256, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Per row of docs: doc_id, keep_id, group_size, kept, text_sha256 (the digest).

    Null texts count as empty texts. Of equal texts the row with the largest id stays; rows that share that id all carry
    kept. A null id stays only where its group has no other. Other columns are ignored; an empty table gives no row. Rows
    of a hot digest find their winner by a broadcast of the hot winners (at most MOST_HOT), so they are never brought
    together.
    """
    rows, found, hot = groups(docs, id_col=id_col, text_col=text_col, digest=digest, hot_rows=hot_rows)
    out = ["doc_id", "digest", "keep_id", "group_size"]
    many = found.groupBy("digest").count().where("count > 1").drop("count")
    collided = bool(many.limit(1).count())
    one = found.join(many, "digest", "left_anti") if collided else found
    marked = rows.where(~hot).join(one.where(~hot), "digest").select(*out)
    marked = marked.unionByName(rows.where(hot).join(F.broadcast(one.where(hot)), "digest").select(*out))
    if collided:  # a digest that stands for several texts: its rows find their group by the whole text
        base = _base(docs, id_col, text_col, digest).join(many, "digest", "left_semi")
        own = base.groupBy("digest", "text").agg(
            F.max("doc_id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")
        )
        marked = marked.unionByName(base.join(own, ["digest", "text"]).select(*out))
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    return marked.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256"))


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row for each distinct text: that with the largest id (of rows that share it, any one).

    Null and empty texts are one text. A null id stays only where its group has no other. All columns are kept as they are,
    whatever their names; an empty table gives an empty table. Only ids and digests of winners, one for each text, are
    joined back.
    """
    key, digest, own = fresh(docs, "id", "digest", "kept_digest")
    marked = cut(mark(docs, id_col=id_col, text_col=text_col).where("kept"))
    keep = marked.select(F.col("doc_id").alias(key), F.col("text_sha256").alias(own)).distinct()
    left = docs.withColumn(digest, _sha256(F.coalesce(named(text_col), F.lit(""))))
    out = left.join(keep, named(id_col).eqNullSafe(F.col(key)) & (F.col(digest) == F.col(own)), "left_semi")
    if marked.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count():
        out = out.dropDuplicates([id_col, digest])
    return out.select(*map(named, docs.columns))


def op8_exact_dedup(spark, sf_dir: str) -> DataFrame:
    return mark(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL8 = """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
       doc_id IS NOT DISTINCT FROM max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))
"""
