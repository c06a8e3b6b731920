"""Mixing sources to target weights with DataFrame operations only.

A document is taken floor(rate) times, and once more by a hash-seeded Bernoulli draw whose probability is the fraction of
its source's rate. Draws of one source are coupled, because independent ones miss the target of a source of 50 documents by
up to 30 %: documents of a size and
a hash of 4 bits form a cell; cells are gone through from the largest size to the smallest, and each takes
its fraction of what is left of the target. The first fraction is the rate's and the next one has the last as its mean, so
every document keeps the fraction as its probability (but where chosen documents exceed the target or cannot reach it any
more: the fraction is then 0 or 1). A cell of c documents that is due k copies gives each of them the chance k / c, drawn by
the hash of its id; k is rounded by the hash of the cell. What is missed at last is about the smallest document and the
deviation within cells of several documents, sqrt(sum of c * size ** 2 * (k / c) * (1 - k / c)).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brevispark.llm.common import WORD, cut, fresh, join_spread, named

WEIGHTS = (5, 2, 1)
MOST_TIMES = 3
SEED = 17
EXACT_BITS = 7
_RANGE = 1 << 52


def size_of(text: Column) -> Column:
    """Number of words (null: 0)."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def _digest(key: Column, seed: int) -> Column:
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(key.cast("string"), F.lit("null")))
    return F.md5(text.cast("binary"))


def _draw(key: Column, seed: int) -> Column:
    """Uniform in [0, 1): 52 bits of the md5 of the seed and the key."""
    return F.conv(F.substring(_digest(key, seed), 1, 13), 16, 10).cast("long") / F.lit(float(_RANGE))


def part_of(doc_id: Column, seed: int) -> Column:
    """One of 16 parts of a cell, by the next 4 bits of the md5 of the id."""
    return F.substring(_digest(doc_id, seed), 14, 1)


def _source_key(source: Column) -> Column:
    """A string that tells a null source from all others."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target, rate) from rows (source, size).

    Sources by code point, null last, weigh WEIGHTS in turn and share all words; a target stops at MOST_TIMES its source's
    size and what it leaves is shared by weight. That is min(cap, level * weight) with one level for all: sources are taken
    in order of cap / weight and the level is where the first of them no longer fills up. Only this table, a row for each
    source, is ordered as a whole. A source without words has target and rate 0.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").cast("long").alias("source_size"))
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*map(F.lit, WEIGHTS)), turn + 1).cast("long")
    w = Window.orderBy((F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last())
    before, onward, everyone = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(0, Window.unboundedFollowing), Window.partitionBy()
    t = totals.withColumn("weight", weight)
    t = t.withColumn("total", F.sum("source_size").over(everyone)).withColumn(
        "left", F.col("total") - F.coalesce(MOST_TIMES * F.sum("source_size").over(before), F.lit(0))
    )
    t = t.withColumn("still", F.sum("weight").over(onward))
    # this one and all after it stay below their caps
    t = t.withColumn("open", F.col("left") * F.col("weight") <= MOST_TIMES * F.col("source_size") * F.col("still"))
    first = Window.orderBy(
        (F.col("source_size") / F.col("weight")), F.col("source").asc_nulls_last()
    ).rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn(
        "level",
        F.min(
            F.when(F.col("open"), F.struct((-F.col("left")).alias("minus"), F.col("still").alias("still")))
        ).over(everyone),
    )
    t = t.withColumn("any_open", F.max("open").over(first))
    share = (-F.col("level.minus") * F.col("weight")).cast("double") / F.col("level.still").cast("double")
    t = t.withColumn(
        "target", F.when(F.col("any_open"), share).otherwise((MOST_TIMES * F.col("source_size")).cast("double"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    return t.select("source", "source_size", "target", rate.alias("rate"))


def size_class(size: Column) -> Column:
    """The size with all but its first EXACT_BITS bits cleared: 64 classes for each power of two."""
    step = F.pow(F.lit(2), F.greatest(F.lit(0), F.length(F.bin(size)) - EXACT_BITS)).cast("long")
    return F.coalesce(size - size % step, F.lit(0))  # never null, which spares joins a filter that counts words again


def cells(rows: DataFrame, sources: DataFrame, seed: int = SEED) -> DataFrame:
    """A row for each cell: key (source), class (of sizes), part, n (documents), whole (sure copies of each), chance (of one more).

    Only counts by cell are gathered for a source, at most 16 for each class of sizes, however many documents it has.
    """
    rate = sources.select(_source_key(F.col("source")).alias("key"), "source_size", "target", "rate")
    size = [F.count(F.lit(1)).alias("n"), F.sum("size").alias("words"), F.first("source").alias("source")]
    n = rows.groupBy(
        _source_key(F.col("source")).alias("key"), size_class(F.col("size")).alias("class"), "part"
    ).agg(*size)
    n = n.withColumn("shift", _draw(F.concat_ws(":", _source_key(F.col("source")), "class", "part"), seed))
    lists = n.groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("class", "part", "n", "words", "shift")), asc=False).alias("classes")
    )
    t = lists.join(rate, "key").withColumn("whole", F.floor("rate")).withColumn(
        "fraction", F.col("rate") - F.col("whole")
    )
    none = F.array().cast("array<struct<class:bigint,part:string,n:bigint,chance:double>>")
    start = F.struct(
        (F.col("target") - F.col("whole") * F.col("source_size")).alias("left"),
        F.col("source_size").cast("double").alias("rest"),
        none.alias("out"),
    )

    def step(acc: Column, x: Column) -> Column:
        now = F.least(F.lit(1.0), F.greatest(F.lit(0.0), acc["left"] / acc["rest"]))
        due = F.floor(x["n"] * F.when(acc["rest"] > 0, now).otherwise(F.col("fraction")) + x["shift"])
        cell = F.struct(
            x["class"].alias("class"), x["part"].alias("part"), x["n"].alias("n"), (due / x["n"]).alias("chance")
        )
        left = acc["left"] - due * (x["words"] / x["n"])
        return F.struct(
            left.alias("left"),
            (acc["rest"] - x["words"]).alias("rest"),
            F.concat(acc["out"], F.array(cell)).alias("out"),
        )

    t = t.withColumn("cell", F.explode(F.aggregate("classes", start, step, lambda acc: acc["out"])))
    return t.select("key", "cell.class", "cell.part", "cell.n", "source_size", "target", "whole", "cell.chance")


def plan(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED
) -> tuple[DataFrame, DataFrame]:
    """(rows, cells): rows (doc_id, source, size, part), and cells() of them."""
    part = part_of(named(id_col), seed).alias("part")
    rows = cut(
        docs.select(
            named(id_col).alias("doc_id"),
            named(source_col).alias("source"),
            size_of(named(text_col)).alias("size"),
            part,
        )
    )
    return rows, cut(cells(rows, targets(rows), seed))


def copies(doc_id: Column, whole: Column, chance: Column, seed: int = SEED) -> Column:
    """The sure copies, and one more with the given chance."""
    return whole + F.when(_draw(doc_id, seed) < chance, F.lit(1)).otherwise(F.lit(0))


def mix_report(docs: DataFrame, *, seed: int = SEED, **cols: str) -> DataFrame:
    """(doc_id, size, source_size, target, taken, source, copies) for every row of docs.

    Null texts have size 0, null sources are one source, rows that share an id share a draw, other columns are
    ignored and an empty table gives no row. Draws depend on ids, sources, sizes and the seed only, so reruns agree.
    """
    rows, own = plan(docs, seed=seed, **cols)
    rows = rows.withColumn("key", _source_key(F.col("source"))).withColumn("class", size_class(F.col("size")))
    joined = join_spread(rows, own, ["key", "class", "part"], "n")
    joined = joined.withColumn("copies", copies(F.col("doc_id"), F.col("whole"), F.col("chance"), seed))
    taken = (F.col("size") * F.col("copies")).cast("long")
    return joined.select("doc_id", "size", "source_size", "target", taken.alias("taken"), "source", "copies")


def mix(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = SEED
) -> DataFrame:
    """The rows of docs, each as often as the mix takes it, with the columns of docs, whatever their names.

    Nulls, empty tables and rows that share an id are treated as in mix_report(); a document of any length is one row.
    """
    wanted = ("key", "class", "part", "n", "whole", "chance", "times", "copy", "words")
    key, size, part, n, whole, chance, times, copy, words = names = fresh(docs, *wanted)
    own = plan(docs, id_col=id_col, text_col=text_col, source_col=source_col, seed=seed)[1]
    own = own.select(*[F.col(a).alias(b) for a, b in zip(wanted[:6], names)])
    rows = docs.withColumn(key, _source_key(named(source_col))).withColumn(words, size_of(named(text_col)))
    rows = rows.withColumn(size, size_class(F.col(words))).withColumn(part, part_of(named(id_col), seed))
    taken = join_spread(rows, own, [key, size, part], n)
    taken = taken.withColumn(
        times, copies(named(id_col), F.col(whole), F.col(chance), seed).cast("int")
    ).where(F.col(times) > 0)
    return taken.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(times)))).select(*map(named, docs.columns))


def op7_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet"))


SQL7 = f"""
WITH RECURSIVE d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
                          md5(concat('{SEED}:', coalesce(doc_id::VARCHAR, 'null'))) AS h, substr(h, 14, 1) AS part FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight FROM d GROUP BY source),
u AS (SELECT *, sum(source_size) OVER () - coalesce(3 * sum(source_size) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
             sum(weight) OVER (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still,
             row_number() OVER (ORDER BY source_size / weight, source NULLS LAST) AS rn FROM t),
o AS (SELECT rn, rest, still FROM u WHERE rest * weight <= 3 * source_size * still ORDER BY rn LIMIT 1),
g AS (SELECT u.source, u.source_size, CASE WHEN u.rn >= o.rn THEN (o.rest * u.weight)::DOUBLE / o.still::DOUBLE ELSE (3 * u.source_size)::DOUBLE END AS target FROM u LEFT JOIN o ON true),
r AS (SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate FROM g),
e AS (SELECT *, size - size % (2 ** greatest(0, length(bin(size)) - {EXACT_BITS}))::BIGINT AS class FROM d),
c AS (SELECT source, class, part, count(*) AS n, sum(size)::BIGINT AS words FROM e GROUP BY 1, 2, 3),
p AS (SELECT c.source, class, part, n, words, source_size, target, floor(rate)::BIGINT AS whole, rate - floor(rate) AS f,
             ('0x' || substr(md5(concat('{SEED}:', coalesce('=' || c.source, 'null'), ':', class, ':', part)), 1, 13))::BIGINT / {float(_RANGE)} AS shift,
             row_number() OVER (PARTITION BY c.source ORDER BY class DESC, part DESC) AS i
      FROM c JOIN r ON c.source IS NOT DISTINCT FROM r.source),
w AS (SELECT source, 0::BIGINT AS i, 0.0::DOUBLE AS chance, target - floor(rate) * source_size AS rest_target, source_size::DOUBLE AS rest FROM r
      UNION ALL
      SELECT source, i, due / n::DOUBLE, rest_target - due * (words / n::DOUBLE), rest - words
      FROM (SELECT p.source, p.i, p.n, p.words, w.rest_target, w.rest,
                   floor(p.n * CASE WHEN w.rest > 0 THEN least(1.0, greatest(0.0, w.rest_target / w.rest)) ELSE p.f END + p.shift) AS due
            FROM w JOIN p ON w.source IS NOT DISTINCT FROM p.source AND p.i = w.i + 1)),
x AS (SELECT e.doc_id, e.size, source_size, target, e.source, whole + CASE WHEN ('0x' || substr(h, 1, 13))::BIGINT / {float(_RANGE)} < chance THEN 1 ELSE 0 END AS copies
      FROM e JOIN p ON e.source IS NOT DISTINCT FROM p.source AND e.class = p.class AND e.part = p.part
      JOIN w ON p.source IS NOT DISTINCT FROM w.source AND p.i = w.i)
SELECT doc_id, size, source_size, target, (size * copies)::BIGINT AS taken, source, copies FROM x
"""
