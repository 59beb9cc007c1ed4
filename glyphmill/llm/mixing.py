"""Mixing sources to target weights by pivotal dependent rounding, with DataFrame functions only.

A source's documents share one fractional number of copies, target / size; its
whole part is taken at once.  The rest is a mass of words for each document.
Masses are paired: one random move, with the two masses' sum kept, makes one
of the two whole (no copy or one copy more) and leaves the other as residual.
Chunks of about ``CHUNK`` documents reduce to one residual each, residuals
are chunked again, and so on: a reduction tree of logarithmic depth.  Each chunk
pairs its longest documents first, so that a short one remains.  The last
residual of a source is rounded by a coin, so a source's taken words differ
from its target by less than that one document.  All draws are hashes of the
documents' keys: reruns agree.

Null texts have size 0 and are taken 0 times their 0 words.  A null source is a
source of its own, last in order.  Repeated rows are told apart by a running
number within their group, counted before the shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import read, scratch

WORD = r"[^\x20\x09-\x0D]+"
CHUNK, SEED, MAX_COPIES, BLOCK = 64, 20240229, 3, 4096


def sized(docs: DataFrame, key: str, source: str, text: str) -> DataFrame:
    """key, source, size and ``n`` equal rows."""
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select(F.col(key).alias("_key"), F.col(source).alias("_source"), size.alias("size")).groupBy("_key", "_source", "size").agg(F.count("*").alias("n"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, cap: int = MAX_COPIES) -> DataFrame:
    """_source, source_size, target: ``share`` of all sizes split by the repeating weights, none above ``cap`` times its size.

    Sharing the excess again and again ends where each source has
    least(cap * size, level * weight) for one level; with the sources sorted by
    cap * size / weight the level is the largest of (rest of the total) / (rest
    of the weights).  Only the per-source sums are ordered here.
    """
    totals = sizes.groupBy("_source").agg(F.sum(F.col("size") * F.col("n")).alias("source_size"))
    ranked = totals.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("_source").isNull(), "_source")) - 1)
    ranked = ranked.withColumn("_weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int")).cast("double"))
    most = F.col("source_size") * F.lit(float(cap))
    before = Window.orderBy(most / F.col("_weight"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    rest = F.sum("source_size").over(whole) * F.lit(share) - F.coalesce(F.sum(most).over(before), F.lit(0.0))
    level = rest / (F.sum("_weight").over(whole) - F.coalesce(F.sum("_weight").over(before), F.lit(0.0)))
    levelled = ranked.withColumn("_level", level).withColumn("_level", F.max("_level").over(whole))
    return levelled.select("_source", "source_size", F.least(most, F.col("_level") * F.col("_weight")).alias("target"))


ITEM = "struct<key:{key},size:bigint,no:bigint,mass:double>"


def _fold(kind: str, seed: int = SEED) -> str:
    """SQL: reduce ``items`` to ``rest`` (the residual) and ``done`` (items with 1 or 0 copies more)."""
    item = ITEM.format(key=kind)
    done = f"struct<key:{kind},size:bigint,no:bigint,more:int>"
    state = f"struct<rest:{item},done:array<{done}>>"

    def keep(rest: str, mass: str, gone: str, more: int) -> str:
        return f"""CAST(named_struct('rest', named_struct('key', {rest}.key, 'size', {rest}.size, 'no', {rest}.no, 'mass', {mass}),
            'done', array_append(acc.done, CAST(named_struct('key', {gone}.key, 'size', {gone}.size, 'no', {gone}.no, 'more', {more}) AS {done}))) AS {state})"""

    a, x = "acc.rest", "x"
    up, down = f"least({a}.size - {a}.mass, {x}.mass)", f"least({a}.mass, {x}.size - {x}.mass)"
    draw = f"shiftrightunsigned(xxhash64({a}.key, {a}.no, {x}.key, {x}.no, {seed}L), 11) / 9007199254740992D"
    return f"""aggregate(slice(items, 2, size(items)), CAST(named_struct('rest', items[0], 'done', array()) AS {state}),
        (acc, x) -> CASE WHEN {a}.mass <= 0 THEN {keep(x, f"{x}.mass", a, 0)}
            WHEN {a}.mass >= {a}.size THEN {keep(x, f"{x}.mass", a, 1)}
            WHEN {draw} * ({up} + {down}) < {down} THEN
                CASE WHEN {a}.size - {a}.mass <= {x}.mass THEN {keep(x, f"{x}.mass - ({a}.size - {a}.mass)", a, 1)}
                ELSE {keep(a, f"{a}.mass + {x}.mass", x, 0)} END
            WHEN {a}.mass <= {x}.size - {x}.mass THEN {keep(x, f"{x}.mass + {a}.mass", a, 0)}
            ELSE {keep(a, f"{a}.mass - ({x}.size - {x}.mass)", x, 1)} END)"""


def mix(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0, chunk: int = CHUNK, seed: int = SEED) -> DataFrame:
    """One row per document row: key, source, ``size``, ``no`` (among equal rows), ``source_size``, ``target``, ``copies``."""
    kind = docs.schema[key].dataType.simpleString()
    sizes = scratch(sized(docs, key, source, text), "mix-sizes")
    targets = scratch(source_targets(sizes, weights, share).coalesce(1), "mix-targets")
    per = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rates = targets.select(F.col("_source").alias("_s"), "source_size", "target", F.floor(per).alias("whole"), (per - F.floor(per)).alias("part"))
    rows = sizes.join(rates, F.col("_source").eqNullSafe(F.col("_s"))).drop("_s")
    # equal rows one by one, in arrays of bounded size however many there are
    blocks = rows.select("_key", "_source", "size", "n", "part", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(n - 1) DIV {BLOCK}"))).alias("b"))
    in_block = F.sequence(F.col("b") * BLOCK + 1, F.least((F.col("b") + 1) * BLOCK, F.col("n")))
    rows = blocks.select("_key", "_source", "size", F.explode(in_block).alias("no"), "part")
    loose = (F.col("size") > 0) & (F.col("part") > 0)
    fixed = rows.where(~loose).select("_source", F.col("_key").alias("key"), "size", F.col("no").cast("long").alias("no"), F.lit(0).alias("more"))
    item = F.struct(F.col("_key").alias("key"), "size", F.col("no").cast("long").alias("no"), (F.col("part") * F.col("size")).alias("mass")).cast(ITEM.format(key=kind))
    open_ = rows.where(loose).select("_source", item.alias("item"))
    decided, level = [fixed], 0
    while True:
        many = scratch(open_.groupBy("_source").agg(F.count("*").alias("many")).coalesce(1), f"mix-count-{level}")
        most = many.agg(F.max("many")).first()[0] or 0
        if most <= 1:
            break
        chunks = many.select(F.col("_source").alias("_s"), F.ceil(F.col("many") / chunk).alias("chunks"))
        spread = F.xxhash64("item.key", "item.no", "item.size", F.lit(seed + level))
        dealt = open_.join(chunks, F.col("_source").eqNullSafe(F.col("_s"))).select("_source", F.pmod(spread, F.col("chunks")).alias("chunk"), F.struct((-F.col("item.size")).alias("s"), spread.alias("h"), "item").alias("i"))
        folded = dealt.groupBy("_source", "chunk").agg(F.transform(F.array_sort(F.collect_list("i")), lambda x: x["item"]).alias("items")).select("_source", F.expr(_fold(kind, seed)).alias("f"))
        done = scratch(folded.select("_source", "f.rest", "f.done"), f"mix-level-{level}")
        decided.append(done.select("_source", F.explode("done").alias("d")).select("_source", "d.key", "d.size", "d.no", "d.more"))
        open_ = done.select("_source", F.col("rest").alias("item"))
        level += 1
    coin = F.shiftrightunsigned(F.xxhash64("item.key", "item.no", F.lit(seed - 1)), 11) / F.lit(float(1 << 53))
    decided.append(open_.select("_source", "item.key", "item.size", "item.no", (coin * F.col("item.size") < F.col("item.mass")).cast("int").alias("more")))
    out = decided[0]
    for d in decided[1:]:
        out = out.unionByName(d)
    out = out.join(rates, F.col("_source").eqNullSafe(F.col("_s")))
    return out.select(F.col("key").alias(key), F.col("_source").alias(source), "size", "no", "source_size", "target", (F.col("whole") + F.col("more")).cast("long").alias("copies"))


def mixed_documents(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: tuple[int, ...] = (1, 2, 3), share: float = 1.0) -> DataFrame:
    """The documents of the mix with all their columns, each as often as it is taken.

    Equal keys are told apart by size and source; of equal rows the copies are added up.
    """
    copies = mix(docs, key, source, text, weights, share).groupBy(key, source, "size").agg(F.sum("copies").alias("copies"), F.count("*").alias("rows"))
    taken = copies.where(F.col("copies") > 0).select(F.col(key).alias("_key"), F.col(source).alias("_source"), F.col("size").alias("_size"), "copies", "rows")
    size = F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")
    held = docs.select(F.struct(*docs.columns).alias("_doc"), size.alias("_n"))
    on = F.col(f"_doc.{key}").eqNullSafe(F.col("_key")) & F.col(f"_doc.{source}").eqNullSafe(F.col("_source")) & (F.col("_n") == F.col("_size"))
    joined = held.join(taken, on)
    # of `rows` equal rows the first ones (in any order: they are equal in key, source and size) take the larger part
    unlike = joined.where(F.col("rows") == 1).select("_doc", "copies")
    alike = joined.where(F.col("rows") > 1).withColumn("_no", F.row_number().over(Window.partitionBy("_key", "_source", "_size").orderBy(F.hash(F.col(f"_doc.{text}")))) - 1)
    alike = alike.select("_doc", (F.floor(F.col("copies") / F.col("rows")) + (F.col("_no") < F.col("copies") % F.col("rows")).cast("long")).alias("copies")).where("copies > 0")
    every = unlike.unionByName(alike).select("_doc", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("_copy"))
    return every.select("_doc.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = mix(read(spark, sf_dir, "documents"))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "source")


#: The query's columns that SQL can express: sizes and targets, the excess shared out again until no source is above its limit.
SIZES_SQL = r"""
WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS MATERIALIZED (SELECT source, sum(size)::BIGINT AS source_size, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS w FROM d GROUP BY source),
r AS (SELECT 0 AS k, source, source_size, w, false AS fixed, 0::DOUBLE AS target FROM s
    UNION ALL SELECT k + 1, source, source_size, w, fixed OR level * w >= 3 * source_size, CASE WHEN fixed THEN target ELSE least(level * w, 3 * source_size) END
    FROM (SELECT *, (sum(source_size) OVER () - sum(CASE WHEN fixed THEN target ELSE 0 END) OVER ()) / greatest(sum(CASE WHEN fixed THEN 0 ELSE w END) OVER (), 1) AS level, count(*) OVER () AS n FROM r) WHERE k <= n)
SELECT doc_id, size, source_size, target FROM d JOIN (SELECT * FROM r WHERE k = (SELECT max(k) FROM r)) t ON t.source IS NOT DISTINCT FROM d.source
"""
