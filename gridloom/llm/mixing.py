"""Mixing sources to target weights by Pfair scheduling, in DataFrame operations alone.

Weights are integers of a common total W: a source of weight w is due w blocks in W slots. Its block j is released at
floor(j * W / w) and due before ceil((j + 1) * W / w). Earliest deadline first gives each slot to the released block with
the earliest deadline (ties: the larger weight, then the source's name). On one lane this meets all deadlines when the
weights sum to W, so each source is always less than one block from its target. Windows repeat every W slots, so one
period of W slots is scheduled, by a fold over its slots, and repeated: W and the sources are bounded by parameters and
so is the period's table, which is broadcast.

A source's documents are put in order by a hash of id and text and cut into blocks of `block_rows`. Ranks come from
counts of buckets and ranks within a bucket, so no source, however large, is sorted by one task. Slots of an exhausted
source stay empty; no document is dropped or repeated. `mixed` is true for slots before the first source runs out: up to
there the weights hold.

Defined results: a null source is a source of its own. Without given weights a source's weight is the rounded share of
the square root of its count, at least 1; with given ones, unnamed sources weigh 1, and a sum beyond MOST_GIVEN is an error. Null ids and texts are ordered as
empty; repeated rows are kept, next to each other. An empty table gives an empty result. Columns of the input that have
an output's name are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gridloom.llm.common import free_name

#: Documents of one block, the scale of derived weights, the most sources whose period is scheduled, and the largest sum of
#: given weights, in lowest terms.
BLOCK_ROWS, SCALE, MOST_SOURCES, MOST_GIVEN = 16, 100, 10_000, 100_000
OUTPUTS = ("source_rank", "block", "slot", "mixed")


def source_weights(docs: DataFrame, given: dict[str, int] | None = None, scale: int = SCALE) -> DataFrame:
    """s (source), n (documents), w (weight)."""
    counts = docs.groupBy(F.col("source").alias("s")).agg(F.count("*").alias("n"))
    if given:
        if any(w < 1 for w in given.values()) or sum(given.values()) > MOST_GIVEN:
            raise ValueError(f"given weights are positive integers that sum to {MOST_GIVEN} at most")
        known = F.create_map(*[F.lit(x) for kv in given.items() for x in kv])
        return counts.withColumn("w", F.coalesce(F.try_element_at(known, F.col("s")), F.lit(1)).cast("long"))
    total = counts.agg(F.sum("n").alias("t"))
    share = F.floor(F.sqrt(F.col("n").cast("double")) * scale / F.sqrt(F.col("t").cast("double")) + 0.5)
    return counts.join(F.broadcast(total)).select("s", "n", F.greatest(share, F.lit(1)).cast("long").alias("w"))


def pfair_period(weights: DataFrame) -> DataFrame:
    """s, w, period (W), j, at: slot of each source's block j in one period, by an earliest-deadline-first fold."""
    one = weights.groupBy().agg(F.sort_array(F.collect_list(F.struct((-F.col("w")).alias("nw"), "s", "w"))).alias("src"), F.sum("w").alias("period"), F.count("*").alias("sources"))
    one = one.where(F.when(F.col("sources") > MOST_SOURCES, F.raise_error(F.lit("too many sources to schedule"))).otherwise(F.col("sources") > 0))
    order = F.expr("""
        aggregate(sequence(0L, period - 1),
          named_struct('nxt', transform(src, x -> 0L), 'got', cast(array() as array<int>)),
          (acc, t) -> transform(array(array_min(transform(
              filter(sequence(0, size(src) - 1), i -> acc.nxt[i] < src[i].w and (acc.nxt[i] * period) div src[i].w <= t),
              i -> named_struct('due', ((acc.nxt[i] + 1) * period + src[i].w - 1) div src[i].w, 'i', i)))),
            b -> named_struct('nxt', transform(acc.nxt, (n, i) -> if(i = b.i, n + 1, n)), 'got', array_append(acc.got, b.i)))[0],
          acc -> acc.got)""")
    slots = one.select("src", "period", F.posexplode(order).alias("at", "i"))
    source = F.element_at("src", F.col("i") + 1)
    named = slots.select("period", F.col("at").cast("long").alias("at"), source.s.alias("s"), source.w.alias("w"))
    return named.withColumn("j", F.row_number().over(Window.partitionBy("s").orderBy("at")).cast("long") - 1)


def mix(docs: DataFrame, weights: dict[str, int] | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """docs with source_rank, block (within the source), slot and mixed."""
    rows = docs.drop(*[c for c in docs.columns if c.lower() in OUTPUTS])
    wide = rows.select("*", *[F.lit(0).alias(c) for c in OUTPUTS])  # names that may not be used
    hash_, bucket, offset, key, place = (free_name(wide, f"mix_{c}") for c in ("hash", "bucket", "offset", "source", "place"))
    none = F.lit("")
    hashed = rows.withColumn(hash_, F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), none), F.lit(":"), F.coalesce("text", none)))).withColumn(bucket, F.substring(hash_, 1, 3))
    counts = hashed.groupBy(F.col("source").alias(key), F.col(bucket).alias(place)).agg(F.count("*").alias("c"))
    before = F.sum("c").over(Window.partitionBy(key).orderBy(place).rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select(F.col(key), F.col(place), F.coalesce(before, F.lit(0)).alias(offset))
    within = F.row_number().over(Window.partitionBy("source", bucket).orderBy(hash_, "doc_id"))
    ranked = hashed.withColumn("source_rank", within.cast("long") - 1)
    ranked = ranked.join(counts, ranked["source"].eqNullSafe(counts[key]) & (ranked[bucket] == counts[place])).withColumn("source_rank", F.col("source_rank") + F.col(offset))
    ranked = ranked.drop(key, place, offset, bucket, hash_).withColumn("block", F.floor(F.col("source_rank") / block_rows).cast("long"))
    sources = source_weights(rows, weights)
    period = pfair_period(sources)
    spent = sources.select("s", F.floor((F.col("n") + block_rows - 1) / block_rows).cast("long").alias("have")).withColumnRenamed("s", "s2")
    ends = period.join(F.broadcast(spent), F.col("s").eqNullSafe(F.col("s2"))).where(F.col("have") % F.col("w") == F.col("j"))
    end = ends.agg(F.min(F.floor(F.col("have") / F.col("w")) * F.col("period") + F.col("at")).alias("end"))
    names = {c: free_name(wide, f"pf_{c}") for c in ("s", "w", "period", "j", "at", "end", "source", "weight")}
    table = period.join(F.broadcast(end)).select(*[F.col(c).alias(names[c]) for c in ("s", "w", "period", "j", "at", "end")])
    # at most MOST_SOURCES sources of bounded weights: the table of one period is bounded
    sized = F.broadcast(sources.select(F.col("s").alias(names["source"]), F.col("w").alias(names["weight"])))
    placed = ranked.join(sized, F.col("source").eqNullSafe(F.col(names["source"])))
    placed = placed.join(F.broadcast(table), F.col("source").eqNullSafe(F.col(names["s"])) & (F.col("block") % F.col(names["weight"]) == F.col(names["j"])))
    slot = F.floor(F.col("block") / F.col(names["w"])).cast("long") * F.col(names["period"]) + F.col(names["at"])
    out = placed.withColumn("slot", slot.cast("long")).withColumn("mixed", F.col("slot") < F.col(names["end"]))
    return out.drop(*names.values())


def in_mixed_order(mixed: DataFrame) -> DataFrame:
    """Rows in the order of their slots over partitions and within them."""
    return mixed.repartitionByRange("slot", "source_rank").sortWithinPartitions("slot", "source_rank")


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "source", "source_rank", "block", "slot", "mixed")


OP10_SQL = f"""
WITH RECURSIVE c AS (
  SELECT source, count(*) AS n, sum(count(*)) OVER () AS t FROM documents GROUP BY source
), w AS (
  SELECT source, n, greatest(1, CAST(floor(sqrt(n::DOUBLE) * {SCALE} / sqrt(t::DOUBLE) + 0.5) AS BIGINT)) AS w FROM c
), k AS (
  SELECT *, CAST(sum(w) OVER () AS BIGINT) AS period, row_number() OVER (ORDER BY w DESC, source NULLS FIRST) AS i FROM w
), a AS (
  SELECT list(w ORDER BY i) AS ws, any_value(period) AS period FROM k
), e(t, nxt, pick) AS (
  SELECT CAST(-1 AS BIGINT), list_transform(ws, lambda x: CAST(0 AS BIGINT)), CAST(0 AS BIGINT) FROM a
  UNION ALL
  SELECT t + 1, list_transform(nxt, lambda x, i: CASE WHEN i = p THEN x + 1 ELSE x END), p FROM (
    SELECT e.t, e.nxt, (list_sort(list_filter(
        list_transform(range(1, len(ws) + 1), lambda i: CASE WHEN nxt[i] < ws[i] AND (nxt[i] * period) // ws[i] <= t + 1
          THEN [((nxt[i] + 1) * period + ws[i] - 1) // ws[i], i] END), lambda x: x IS NOT NULL)))[1][2] AS p
    FROM e, a WHERE t + 1 < period)
), p AS (
  SELECT t AS place, pick, row_number() OVER (PARTITION BY pick ORDER BY t) - 1 AS j FROM e WHERE t >= 0
), s AS (
  SELECT k.source, k.n, k.w, k.period, p.j, p.place FROM p JOIN k ON k.i = p.pick
), f AS (
  SELECT min((((n + {BLOCK_ROWS} - 1) // {BLOCK_ROWS}) // w) * period + place) AS stop FROM s WHERE ((n + {BLOCK_ROWS} - 1) // {BLOCK_ROWS}) % w = j
), r AS (
  SELECT doc_id, source, row_number() OVER (PARTITION BY source
    ORDER BY md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(text, '')), doc_id NULLS FIRST) - 1 AS source_rank FROM documents
), b AS (
  SELECT r.doc_id, r.source, r.source_rank, r.source_rank // {BLOCK_ROWS} AS block, k.w FROM r JOIN k ON k.source IS NOT DISTINCT FROM r.source
)
SELECT b.doc_id, b.source, b.source_rank, b.block, (b.block // b.w) * s.period + s.place AS slot, (b.block // b.w) * s.period + s.place < f.stop AS mixed
FROM b JOIN s ON s.source IS NOT DISTINCT FROM b.source AND s.j = b.block % b.w, f
"""
