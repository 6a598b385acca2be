"""Mixing sources to target weights by Poisson replication.

Each source has a mean repetition rate: its target share of the output over its
share of the input. A document's copies are a Poisson number with that mean,
read off the inverse distribution at a number that a hash of the seed and the
id gives. Copies are exploded and shuffled globally by another hash. All of it
is DataFrame code.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegraph.llm.common import documents, materialize

#: Largest mean of one draw; a larger rate is the sum of several independent draws.
STEP = 16.0
#: Entries of the distribution of one draw: beyond them is less than 2**-53.
TERMS = 90
#: Up to so many sources (under 1 KB each) are broadcast, so that documents move once.
BROADCAST_SOURCES = 4096


def _uniform(*parts: Column) -> Column:
    """In (0, 1), from 52 bits of an MD5."""
    digest = F.md5(F.concat_ws(":", *parts))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)


def rates(docs: DataFrame, weights: dict[str, float] | None = None, total: float | None = None) -> DataFrame:
    """``(source, n, rate)``: the mean repetition rate of each source.

    ``weights``: target shares by source, scaled to sum to one over the sources
    that occur; a source that isn't named has none. By default all sources weigh
    the same. ``total``: documents wanted, by default as many as there are. Null
    is a source like others (name it by the key None).
    """
    n = docs.groupBy("source").agg(F.count("*").alias("n"))
    if weights is None:
        w = F.lit(1.0)
    else:
        w = F.lit(0.0)
        for k, v in weights.items():
            w = F.when(F.col("source").eqNullSafe(F.lit(k)), F.lit(float(v))).otherwise(w)
    n = n.withColumn("w", w)
    sums = n.agg(F.sum("n").alias("n"), F.sum("w").alias("w")).first()  # two numbers
    wanted, all_w = float(total if total is not None else sums["n"] or 0), float(sums["w"] or 0)
    rate = F.lit(wanted) * F.col("w") / F.lit(all_w) / F.col("n") if all_w > 0 else F.lit(0.0)
    return n.select("source", "n", rate.alias("rate"))


def mix(docs: DataFrame, *, weights: dict[str, float] | None = None, total: float | None = None, seed: int = 42, copy_column: str | None = None) -> DataFrame:
    """Repeat and shuffle documents so that sources have their target weights.

    Returns the columns of ``docs`` (and ``copy_column``, the copy's number from
    0, where it is named). A document keeps its doc_id in each copy. Rows that
    repeat a doc_id draw alike; null ids draw as the empty text does. Texts, null, empty
    or long, play no part; extra columns may have any names. An empty table gives no rows. The hottest source costs no more than
    others: counts are combined before they move, and the few rows of
    ``rates`` are broadcast, or, of many sources, joined back by a join that AQE can split.
    """
    # Whole rows travel as one column, so that no name of theirs clashes.
    rows = docs.select(F.struct(*docs.columns).alias("row"))
    r = rates(docs, weights, total).select(F.col("source").alias("s"), "rate")
    draws = F.greatest(F.ceil(F.col("rate") / STEP).cast("int"), F.lit(1))
    mean = F.col("rate") / draws
    # Distribution of one draw, one array for a source: (term, sum so far) folded over 1..TERMS.
    first = F.struct(F.exp(-mean).alias("p"), F.array(F.exp(-mean)).alias("c"))
    cdf = F.aggregate(
        F.sequence(F.lit(1), F.lit(TERMS)), first,
        lambda a, k: F.struct((a["p"] * mean / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * mean / k)).alias("c")),
    )["c"]
    r = r.where("rate > 0").select("s", draws.alias("draws"), cdf.alias("cdf"))
    if r.count() <= BROADCAST_SOURCES:
        r = F.broadcast(r)
    key = F.coalesce(F.col("row.doc_id").cast("string"), F.lit(""))
    u = lambda j: _uniform(F.lit(str(seed)), F.lit("count"), key, j.cast("string"))
    # The count of a draw is the number of sums that lie below the hashed number.
    count = F.aggregate(F.transform(F.sequence(F.lit(1), F.col("draws")), lambda j: F.aggregate(F.col("cdf"), F.struct(u(j).alias("u"), F.lit(0).alias("k")), lambda a, c: F.struct(a["u"].alias("u"), (a["k"] + (c < a["u"]).cast("int")).alias("k")))["k"]), F.lit(0), lambda a, b: a + b)
    drawn = rows.join(r, F.col("row.source").eqNullSafe(F.col("s"))).withColumn("times", count).where("times > 0")
    copies = drawn.select("row", F.explode(F.sequence(F.lit(0), F.col("times") - 1)).alias("copy"))
    place = F.md5(F.concat_ws(":", F.lit(str(seed)), F.lit("place"), key, F.col("copy").cast("string")))
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    out = copies.withColumn("place", place).repartition(n, "place").sortWithinPartitions("place")
    return out.select(*(F.col("row")[c].alias(c) for c in docs.columns), *([F.col("copy").alias(copy_column)] if copy_column else []))


def op6_poisson_mixing_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copies of all documents: whole rows, texts included, and the copy's number."""
    return mix(documents(spark, sf_dir), copy_column="copy")


def op6_poisson_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The keys of all copies, read from the mixed documents, which are written as whole rows."""
    return materialize(op6_poisson_mixing_documents(spark, sf_dir), "mixed").select("doc_id", "source", "n_chars", "copy")


def oracle(seed: int = 42) -> str:
    terms = math.ceil(TERMS)
    u = f"(('0x' || substr(md5('{seed}:count:' || doc_id || ':' || j), 1, 13))::BIGINT::DOUBLE + 0.5) / 4503599627370496.0"
    return f"""
WITH RECURSIVE s AS (SELECT source, count(*) AS n FROM documents GROUP BY source),
r AS (SELECT source, (SELECT sum(n) FROM s)::DOUBLE * 1.0 / (SELECT count(*) FROM s)::DOUBLE / n AS rate FROM s),
d AS (SELECT source, ceil(rate / {STEP})::INT AS draws, rate / ceil(rate / {STEP}) AS mean FROM r),
t AS (SELECT source, 0 AS k, exp(-mean) AS p, exp(-mean) AS c FROM d
  UNION ALL SELECT t.source, t.k + 1, t.p * mean / (t.k + 1), t.c + t.p * mean / (t.k + 1) FROM t JOIN d USING (source) WHERE t.k < {terms}),
a AS (SELECT source, list(c ORDER BY k) AS cdf FROM t GROUP BY source),
x AS (SELECT doc_id, source, n_chars, cdf, unnest(range(1, draws + 1)) AS j FROM documents JOIN d USING (source) JOIN a USING (source)),
y AS (SELECT doc_id, source, n_chars, len(list_filter(cdf, lambda v: v < {u}))::INT AS k FROM x),
z AS (SELECT doc_id, source, n_chars, sum(k)::INT AS n FROM y GROUP BY ALL)
SELECT doc_id, source, n_chars, unnest(range(0, n))::INT AS copy FROM z"""


def oracle_documents(seed: int = 42) -> str:
    """As ``oracle``, with whole rows; doc_id is a key of the tables it is for."""
    return f"SELECT d.doc_id, d.text, d.lang, d.source, d.n_chars, o.copy FROM ({oracle(seed)}) o JOIN documents d ON d.doc_id = o.doc_id"
