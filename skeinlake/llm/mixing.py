"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Every document draws an exponential key, divided by its quality weight; within a
source, documents in order of that key are taken until the source's token budget
is used up. Budgets that exceed a source take complete epochs first, and the rest
of the budget selects a fraction. The prefix sums run over sums of key ranges,
and only the one range per source in which the budget ends is summed row by row,
so no task holds a source. Keys come from a digest of id and text: reruns agree.

Rows of one id, text and source share a key. They are summed before the range is,
and where the budget ends among them, they are numbered and cut one by one, so a
source misses its budget by half a document at most, repeated rows or not. Which
of the equal rows are taken makes no difference to what is taken.

Cases: a null text has size 0 and is never counted, one of any length is read whole;
a null source is a source, ordered last; sources without words get nothing; ids may
be null; an empty table gives no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames

WEIGHTS = (5, 2, 1)
SHARE, CAP = 1.5, 2.0
#: What lowers a document's weight, and the characters a word that are taken as usual.
SYMBOLS, DIGITS, WORD_CHARS = "#*$%&|<>", "0123456789", 6.5
#: Key ranges per factor e of the key.
RANGES = 512
#: Sources up to which the table with a row for each is broadcast.
BROADCAST_SOURCES = 50_000


def size_of(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality_of(text: Column, size: Column) -> Column:
    """A document's weight, 1 at best: less with each symbol and digit per character, and the further the
    characters per word are from ``WORD_CHARS``."""
    n = F.length(text)
    symbols, digits = (n - F.length(F.translate(text, c, "")) for c in (SYMBOLS, DIGITS))
    odd = F.abs(F.try_divide(n.cast("double"), size) - F.lit(WORD_CHARS)) / F.lit(WORD_CHARS)
    return F.coalesce(F.lit(1.0) / (F.lit(1.0) + F.lit(50.0) * symbols / F.greatest(n, F.lit(1)) + F.lit(4.0) * digits / F.greatest(n, F.lit(1)) + odd), F.lit(1.0))


def key_of(doc_id: Column, text: Column, weight: Column) -> Column:
    digest = F.sha2(F.concat_ws(":", doc_id.cast("string"), F.md5(F.coalesce(text, F.lit("")).cast("binary"))), 256)
    u = (F.conv(F.substr(digest, F.lit(1), F.lit(13)), 16, 10).cast("double") + 0.5) / float(2**52)
    return -F.log(u) / weight


def sized(docs: DataFrame, weight: Column | None = None) -> DataFrame:
    """doc_id, source, size and key of every row. weight: the documents' weights, positive, if they aren't quality_of's."""
    own = F.lit(None).cast("double") if weight is None else weight.cast("double")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"), own.alias("weight"))
    d = d.withColumn("size", size_of(F.col("text")))
    return d.select("doc_id", "source", "size", key_of(F.col("doc_id"), F.col("text"), F.coalesce("weight", quality_of(F.col("text"), F.col("size")))).alias("key"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, cap: float = CAP) -> DataFrame:
    """source, source_size and target: a level times the weight, or the cap if that is less.

    Sharing out again what exceeds the caps ends at that level. It is found in
    the order in which rising levels reach the caps; the table has a row a source.
    """
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    ranked = s.withColumn("i", F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))))
    w = ranked.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.col("i") - 1) % len(weights) + 1).cast("int"))).withColumn("cap", F.col("source_size") * F.lit(cap))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "i").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = w.withColumns({
        "caps": F.coalesce(F.sum("cap").over(order), F.lit(0.0)), "weights": F.coalesce(F.sum("weight").over(order), F.lit(0.0)),
        "all": F.sum("source_size").over(everything) * F.lit(share), "all_weights": F.sum("weight").over(everything),
    })
    levels = before.withColumn("level", (F.col("all") - F.col("caps")) / (F.col("all_weights") - F.col("weights")))
    level = F.coalesce(F.min(F.when(F.col("level") <= F.col("cap") / F.col("weight"), F.struct("i_cap", "level"))).over(everything)["level"], F.lit(float("inf")))
    levels = levels.withColumn("i_cap", F.row_number().over(Window.orderBy(F.col("cap") / F.col("weight"), "i")))
    return levels.withColumn("target", F.least("cap", level * F.col("weight"))).select("source", "source_size", "target")


def _range(key: Column) -> Column:
    return F.floor(F.log(key) * RANGES)


def cuts(sizes: DataFrame, **how) -> DataFrame:
    """A row a source: source_size, target, epochs, and where its fractional selection ends: all of the key ranges
    below ``last``, in ``last`` the keys up to ``upto``, and of the rows of the next key, ``part``, the first ``some``."""
    plan = targets(sizes, **how)
    plan = plan.withColumn("epochs", F.coalesce(F.floor(F.try_divide("target", "source_size")), F.lit(0)))
    plan = frames.stored(plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size")), "mix-plan")
    same = lambda a, b: a["source"].eqNullSafe(b["source"])
    ranged = sizes.withColumn("range", _range(F.col("key")))
    sums = ranged.groupBy("source", "range").agg(F.sum("size").alias("n"))
    upto = Window.partitionBy("source").orderBy("range")
    sums = sums.withColumn("through", F.sum("n").over(upto))
    p = _small(plan)
    over = sums.join(p, same(sums, p)).where(F.col("through") > F.col("rest")).groupBy(sums["source"]).agg(F.min(F.struct("range", (F.col("through") - F.col("n")).alias("base"), "rest")).alias("x"))
    over = frames.stored(over.select("source", F.col("x.range").alias("last"), F.col("x.base").alias("base"), F.col("x.rest").alias("rest")), "mix-ranges")
    o = _small(over.withColumnRenamed("source", "o_source"))
    edge = ranged.join(o, ranged["source"].eqNullSafe(o["o_source"]) & (ranged["range"] == o["last"])).drop("o_source")
    edge = edge.groupBy("source", "range", "key", "doc_id", "size", "base", "rest").agg(F.count("*").alias("rows"))
    running = Window.partitionBy("source", "range").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    edge = edge.withColumn("to", F.col("base") + F.sum(F.col("size") * F.col("rows")).over(running))
    # row j of a key is taken if half of it or more lies within the budget
    within = F.floor(F.try_divide(F.col("rest") - (F.col("to") - F.col("size") * F.col("rows")) + F.col("size") / 2.0, "size"))
    edge = edge.withColumn("some", F.when(F.col("size") == 0, F.when(F.col("to") <= F.col("rest"), F.col("rows")).otherwise(0)).otherwise(F.greatest(F.least(within, "rows"), F.lit(0))).cast("long"))
    key = F.struct("key", "doc_id")
    last = edge.groupBy(F.col("source").alias("l_source")).agg(F.max(F.when(F.col("some") == F.col("rows"), key)).alias("upto"), F.max(F.when((F.col("some") > 0) & (F.col("some") < F.col("rows")), F.struct(F.col("key"), F.col("doc_id"), F.col("some")))).alias("part"))
    found = plan.join(o, plan["source"].eqNullSafe(o["o_source"]), "left").join(last, plan["source"].eqNullSafe(last["l_source"]), "left")
    return frames.stored(found.select(plan["source"], "source_size", "target", "epochs", "last", "upto", F.struct("part.key", "part.doc_id").alias("part"), "part.some"), "mix-cuts")


def _small(per_source: DataFrame) -> DataFrame:
    return F.broadcast(per_source) if per_source.count() <= BROADCAST_SOURCES else per_source


def _numbered(rows: DataFrame) -> DataFrame:
    """rows with their number, from 1, in each source: counted within the partitions as they are stored, which are
    then added up, so that no task gets all rows of a source."""
    held = frames.stored(rows.withColumn("dealt", F.spark_partition_id()), "mix-ties")
    counts = held.groupBy("source", "dealt").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("source").orderBy("dealt")) - F.col("n")).select(F.col("source").alias("b_source"), F.col("dealt").alias("b_dealt"), "before")
    own = held.withColumn("own", F.row_number().over(Window.partitionBy("source", "dealt").orderBy("key")))
    joined = own.join(before, own["source"].eqNullSafe(before["b_source"]) & (own["dealt"] == before["b_dealt"]))
    return joined.withColumn("number", F.col("before") + F.col("own")).select(*rows.columns, "number")


def taken(sizes: DataFrame, cut: DataFrame) -> DataFrame:
    """sizes' columns and source_size, target, copies and taken."""
    c = _small(cut.withColumnRenamed("source", "c_source"))
    r, key = _range(F.col("key")), F.struct("key", "doc_id")
    joined = sizes.join(c, sizes["source"].eqNullSafe(c["c_source"]), "left").drop("c_source")
    tied = F.coalesce((r == F.col("last")) & key.eqNullSafe(F.col("part")) & F.col("some").isNotNull(), F.lit(False))
    rest = joined.where(~tied).withColumn("chosen", F.coalesce((r < F.col("last")) | ((r == F.col("last")) & F.coalesce(key <= F.col("upto"), F.lit(False))), F.col("last").isNull()))
    if not cut.where("some IS NOT NULL").isEmpty():
        ties = _numbered(joined.where(tied))
        rest = rest.unionByName(ties.withColumn("chosen", F.col("number") <= F.col("some")).drop("number"))
    copies = F.when(F.col("size") > 0, F.col("epochs") + F.when(F.col("chosen") & (F.col("epochs") < F.lit(int(CAP))), 1).otherwise(0)).otherwise(0)
    return rest.withColumn("copies", copies.cast("long")).withColumn("taken", F.col("copies") * F.col("size")).select(*sizes.columns, "source_size", "target", "copies", "taken")


def mix(docs: DataFrame, weight: Column | None = None, **how) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken of every row of docs."""
    frames.ready(docs.sparkSession)
    sizes = frames.stored(sized(docs, weight), "mix-sizes")
    return taken(sizes, cuts(sizes, **how)).drop("key")


def op4_source_mixing(spark, sf_dir: str) -> DataFrame:
    return mix(frames.table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


OP4_SQL = r"""
WITH w0 AS (SELECT doc_id, source, text, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
d AS (
  SELECT doc_id, source, size, md5(coalesce(text, '')) AS m,
    coalesce(1.0::DOUBLE / (1.0::DOUBLE + 50.0::DOUBLE * (length(text) - length(translate(text, '#*$%&|<>', ''))) / greatest(length(text), 1)
      + 4.0::DOUBLE * (length(text) - length(translate(text, '0123456789', ''))) / greatest(length(text), 1) + abs(length(text)::DOUBLE / nullif(size, 0) - 6.5::DOUBLE) / 6.5::DOUBLE), 1.0::DOUBLE) AS q FROM w0),
k AS (
  SELECT doc_id, source, size, -ln((('0x' || substr(sha256(concat_ws(':', doc_id::VARCHAR, m)), 1, 13))::BIGINT::DOUBLE + 0.5::DOUBLE) / 4503599627370496::DOUBLE) / q AS key FROM d),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS i FROM k GROUP BY source),
w AS (SELECT *, [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((i - 1) % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap FROM s),
b AS (
  SELECT *, coalesce(sum(cap) OVER o, 0) AS caps, coalesce(sum(weight) OVER o, 0) AS weights, row_number() OVER (ORDER BY cap / weight, i) AS n,
    sum(source_size) OVER () * 1.5::DOUBLE AS every, sum(weight) OVER () AS every_weight
  FROM w WINDOW o AS (ORDER BY cap / weight, i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (SELECT (every - caps) / (every_weight - weights) AS level FROM b WHERE (every - caps) / (every_weight - weights) <= cap / weight ORDER BY n LIMIT 1),
t AS (SELECT source, source_size, least(cap, level * weight) AS target FROM b, l),
e AS (SELECT k.*, t.source_size, t.target, coalesce(floor(t.target / nullif(t.source_size, 0)), 0)::BIGINT AS epochs FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
r AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) AS upto FROM e)
SELECT doc_id, size, source_size, target,
  (size * (epochs + CASE WHEN epochs < 2 AND 2 * upto - size <= 2 * (target - epochs * source_size) THEN 1 ELSE 0 END))::BIGINT AS taken FROM r
"""
