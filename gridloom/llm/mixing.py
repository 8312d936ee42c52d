"""Mixing sources to target weights (operator 10), DataFrame functions only.

Each source gets a share of a total word budget by its weight, at most ``max_epochs`` times what it has;
what a stopped source leaves goes to the others by weight (water filling in closed form over the sources
in order of size per weight). A target of k and a fraction epochs takes every document k times and then,
for the fraction, documents by Efraimidis-Spirakis sampling: each draws u in (0, 1) from a hash of its id
and the seed, gets the exponential key -ln(u) / quality, and the smallest keys are taken until their words
reach the budget (:func:`gridloom.llm.select.take_budget`, so a hot source is not sorted in one task).
A whole document is taken or left; the last one is taken if that comes nearer to the budget.

Defined results: null source is a source, the last; null text has no words; quality null or not positive is 1;
documents without words are never drawn; repeated rows are drawn together as often as they occur;
no documents give no rows. Runs with one seed agree. Columns beyond doc_id, text and source are not read; ``mix`` passes them
through whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .select import BROADCAST_GROUPS, take_budget
from .storage import free, materialize

WORDS = r"[^\x20\x09-\x0D]+"
BINS = 4096


def n_words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORDS)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``sizes``: one row per source (source, source_size). Adds ``weight`` (repeating, by code point, null last) and ``target``.

    The windows run over one row per source.
    """
    n = len(weights)
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weighted = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (rank % n + 1).cast("int")))
    cap = F.lit(max_epochs) * F.col("source_size")
    everything = Window.partitionBy()
    # in order of cap per weight, the sources before this one are stopped at their caps if this one is open
    before = Window.orderBy(F.col("source_size") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    level = (F.sum("source_size").over(everything) * share - F.coalesce(F.sum(cap).over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    opened = weighted.withColumn("_cap", cap).withColumn("_level", level)
    final = F.max(F.when(F.col("_level") * F.col("weight") <= F.col("_cap"), F.col("_level"))).over(everything)
    return opened.withColumn("target", F.coalesce(F.least("_cap", final * F.col("weight")), "_cap").cast("double")).drop("_cap", "_level")


def uniform(id_: Column, seed: str) -> Column:
    """A number in (0, 1) from 48 bits of md5, the same in any engine."""
    return (F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.lit(":"), F.coalesce(id_.cast("string"), F.lit("")))), 1, 12), 16, 10).cast("double") + 0.5) / float(1 << 48)


def draw(sized: DataFrame, seed: str = "mix", quality: Column | None = None, weights: tuple[float, ...] = (5.0, 2.0, 1.0),
         share: float = 1.5, max_epochs: float = 2.0) -> DataFrame:
    """``sized`` (doc_id, source, size, any more) with ``source_size``, ``target`` and ``epochs``, the copies the mix takes.

    quality: a column of ``sized`` that scales a document's chance; None: all alike. ``sized`` is read more
    than once, so it should be a table.
    """
    q = F.lit(1.0) if quality is None else F.when(quality > 0, quality.cast("double")).otherwise(F.lit(1.0))
    keyed = sized.withColumn("_key", -F.log(uniform(F.col("doc_id"), seed)) / q)
    targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, max_epochs)
    targets = targets.withColumn("_whole", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    targets = targets.withColumn("budget", F.col("target") - F.col("_whole") * F.col("source_size"))
    targets = materialize(targets, "mix-targets")  # a row per source
    t = targets.select(F.col("source").alias("_s"), "source_size", "target", "_whole")
    t = F.broadcast(t) if targets.count() <= BROADCAST_GROUPS else t
    bin_ = F.least(F.floor(F.lit(float(BINS)) * (1 - F.exp(-F.col("_key")))), F.lit(BINS - 1)).cast("int")
    picked = take_budget(keyed, targets, "source", bin_, [F.col("_key"), F.col("doc_id"), F.col("size")], F.col("size"), nearest=True)
    out = picked.join(t, picked["source"].eqNullSafe(t["_s"]), "left")
    return out.withColumn("epochs", F.when(F.col("size") > 0, F.col("_whole") + F.col("_taken").cast("long")).otherwise(0)).drop("_key", "_s", "_whole", "_taken")


def sized_table(docs: DataFrame, labels: DataFrame | None) -> DataFrame:
    """A table (doc_id, source, size, quality_weight) of ``docs``: texts are measured in the scan and never shuffled.

    quality_weight: 2 for documents labelled good in ``labels`` (doc_id, quality), 0.5 for bad ones, else 1.
    """
    out = docs.select("doc_id", "source", n_words(F.col("text")).alias("size"))
    if labels is None:
        return materialize(out.withColumn("quality_weight", F.lit(1.0)), "mix-sizes")
    q = labels.groupBy("doc_id").agg(F.max("quality").alias("_quality"))
    weight = F.when(F.col("_quality") == 1, 2.0).when(F.col("_quality") == 0, 0.5).otherwise(1.0)
    return materialize(out.join(q, "doc_id", "left").withColumn("quality_weight", weight).drop("_quality"), "mix-sizes")


def mix(docs: DataFrame, labels: DataFrame | None = None, seed: str = "mix", **how) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as the mix takes it, same columns.

    Rows with equal doc_id, source and number of words are taken alike.
    """
    drawn = draw(sized_table(docs, labels), seed, F.col("quality_weight"), **how).where("epochs > 0")
    own = {c: free(docs.columns, c) for c in ("_d", "_s", "_n", "_epochs", "_copy")}
    per = drawn.groupBy(F.col("doc_id").alias(own["_d"]), F.col("source").alias(own["_s"]), F.col("size").alias(own["_n"])).agg(F.max("epochs").cast("int").alias(own["_epochs"]))
    key = docs["doc_id"].eqNullSafe(per[own["_d"]]) & docs["source"].eqNullSafe(per[own["_s"]]) & (n_words(docs["text"]) == per[own["_n"]])
    return docs.join(per, key).withColumn(own["_copy"], F.explode(F.sequence(F.lit(1), F.col(own["_epochs"])))).select(*[f"`{c}`" for c in docs.columns])


def digest(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of query op10."""
    out = draw(sized_table(docs, labels), "mix", F.col("quality_weight"))
    return out.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), (F.col("size") * F.col("epochs")).alias("taken"))


ORACLE = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    case when q.quality = 1 then 2.0::double when q.quality = 0 then 0.5::double else 1.0::double end as q
  from documents left join (select doc_id, max(quality) as quality from labels group by doc_id) q using (doc_id)
), k as (
  select *, -ln((cast(('0x' || substr(md5('mix:' || coalesce(cast(doc_id as varchar), '')), 1, 12)) as bigint) + 0.5::double) / 281474976710656::double) / q as key from d
), s as (
  select source, cast(sum(size) as double) as source_size from d group by source
), w as (
  select *, [5.0::double, 2.0::double, 1.0::double][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight from s
), l as (
  select *, (1.5::double * sum(source_size) over () - coalesce(sum(2.0::double * source_size) over b, 0)) / (sum(weight) over () - coalesce(sum(weight) over b, 0)) as level
  from w window b as (order by source_size / weight, source nulls last rows between unbounded preceding and 1 preceding)
), t as (
  select source, source_size, coalesce(least(2.0::double * source_size, weight * max(case when level * weight <= 2.0::double * source_size then level end) over ()), 2.0::double * source_size) as target from l
), r as (
  select k.*, t.source_size, t.target, case when t.source_size > 0 then cast(floor(t.target / t.source_size) as bigint) else 0 end as whole,
    sum(size) over (partition by k.source order by key, doc_id, size rows unbounded preceding) as run
  from k join t on k.source is not distinct from t.source
), o as (
  select *, run - (target - whole * source_size) as over_by from r
)
select doc_id, size, cast(source_size as bigint) as source_size, round(target, 3) as target,
  cast(case when size = 0 then 0 else size * (whole + case when over_by <= 0 or (over_by < size and over_by <= size - over_by) then 1 else 0 end) end as bigint) as taken
from o
"""
