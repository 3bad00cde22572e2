"""Sharding by balanced label propagation: DataFrame operations only.

Documents with equal texts are linked.  Each document starts in a shard that its id decides.  In
a round, documents learn how many of their linked documents sit in each shard.  A text fills the
shards that hold most of it, as many as it needs, and its documents elsewhere ask for places there; a
shard admits askers, greatest gain first, up to its quota.  Then shards over their share give up
documents, those with the fewest links in the shard first, to shards that are under it, so counts are
at most one apart.  Rounds go on as long as more linked pairs come together.  Linked documents are
counted per (text, shard), never paired.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from litsieve.llm.common import park, ranked

#: Shards; shares that a shard's linked documents may take before those with fewest links leave.
SHARDS, SHARES = 40, 2
#: Documents that one bucket ranks, about.
BUCKET_ROWS = 20_000
#: What a document weighs besides its text's bytes.
OVERHEAD = 16


def _per_shard(df: DataFrame) -> DataFrame:
    return df.where("link is not null").groupBy("link", "shard").agg(F.count("*").alias("n"))


def together(placed: DataFrame) -> int:
    """Linked pairs that share a shard: all linked pairs less the cut edges."""
    return int(_per_shard(placed).agg(F.sum(F.col("n").cast("decimal(38,0)") * (F.col("n") - 1) / 2)).first()[0] or 0)


def propagate(nodes: DataFrame, shards: int = SHARDS) -> DataFrame:
    """node, link, shard for ``nodes`` (node long, unique; link: equal where nodes are linked, null for none).

    Shard sizes differ by one node at most.
    """
    total = nodes.count()
    buckets = max(1, total // BUCKET_ROWS)
    start = F.pmod(F.xxhash64("node"), F.lit(shards)).cast("int")
    first = park(nodes.select("node", "link", start.alias("shard")), "shards")
    held = park(_balance(first.df, total, shards, buckets), "shards")
    first.drop()
    kept = together(held.df)
    # ends: the linked pairs that are together rise each time; where no text has documents to move, a round changes nothing
    while not _spread(held.df, total, shards)[0].where("not filled").isEmpty():
        moved = park(_gather(held.df, total, shards, buckets), "shards")
        after = park(_balance(moved.df, total, shards, buckets), "shards")
        moved.drop()
        now = together(after.df)
        if now <= kept:
            after.drop()
            return held.df
        held.drop()
        held, kept = after, now
    return held.df


def _spread(held: DataFrame, total: int, shards: int) -> tuple[DataFrame, DataFrame]:
    """A text's count in each shard, where the shard stands in the order the text fills them, and whether it does; and the shards' quotas."""
    share = total // shards
    sizes = held.groupBy("shard").agg(F.count("link").alias("count"))  # ``shards`` rows
    # documents without links count for nothing here: they make room when the counts are balanced
    quota = sizes.select("shard", F.greatest(F.lit(0), F.lit((share + 1) * SHARES) - F.col("count")).alias("quota"))
    order = Window.partitionBy("link").orderBy(F.desc("n"), F.xxhash64("link", "shard"))  # at most ``shards`` rows
    earlier = order.rowsBetween(Window.unboundedPreceding, -1)
    spread = _per_shard(held).join(quota, "shard").withColumn("free", F.greatest(F.lit(0), F.least(F.col("quota"), F.lit(share) - F.col("n"))))
    spread = spread.withColumn("before", F.coalesce(F.sum(F.col("n") + F.col("free")).over(earlier), F.lit(0))).withColumn("from", F.coalesce(F.sum("free").over(earlier), F.lit(0)))
    spread = spread.withColumn("filled", F.col("before") < F.sum("n").over(Window.partitionBy("link"))).select("link", "shard", "n", "free", "from", "filled")
    return spread, quota


def _gather(held: DataFrame, total: int, shards: int, buckets: int) -> DataFrame:
    """A round: ``held`` (node, link, shard) with the admitted documents moved."""
    spread, quota = _spread(held, total, shards)
    # the text fills its first shards; what stands in the others moves to the free places, by number
    aims = spread.where("filled and free > 0").groupBy("link").agg(F.array_sort(F.collect_list(F.struct("from", "shard", "n"))).alias("aims"))
    movers = held.join(spread.where("not filled").select("link", "shard", "n"), ["link", "shard"]).select("node", "link", (F.col("n") - 1).alias("here"))
    movers = ranked(movers, ["link"], [F.col("node")], "number", buckets, F.col("node")).join(aims, "link")
    aim = F.element_at(F.filter("aims", lambda x: x["from"] <= F.col("number")), -1)
    asks = movers.withColumn("aim", aim).select("node", F.col("aim.shard").alias("best"), (F.col("aim.n") - F.col("here")).alias("gain"))
    # askers in order of gain: whole classes of gain first, numbered within a class
    by_gain = asks.groupBy("best", "gain").agg(F.count("*").alias("n"))
    above = Window.partitionBy("best").orderBy(F.desc("gain")).rowsBetween(Window.unboundedPreceding, -1)
    by_gain = by_gain.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).drop("n")
    numbered = ranked(asks, ["best", "gain"], [F.col("node")], "place", buckets, F.col("node"))
    admitted = numbered.join(by_gain, ["best", "gain"]).join(quota.withColumnRenamed("shard", "best"), "best").where("place + above < quota").select("node", "best")
    return held.join(admitted, "node", "left").select("node", "link", F.coalesce("best", "shard").alias("shard"))


def _balance(held: DataFrame, total: int, shards: int, buckets: int) -> DataFrame:
    """``held`` with shard sizes that differ by one node at most."""
    share, rest = divmod(total, shards)
    # number each shard's documents, best linked first; those beyond the share move on
    around = held.join(_per_shard(held), ["link", "shard"], "left").withColumn("here", F.coalesce(F.col("n") - 1, F.lit(0))).drop("n")
    classes = around.groupBy("shard", "here").agg(F.count("*").alias("n"))
    above = Window.partitionBy("shard").orderBy(F.desc("here")).rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("above", F.coalesce(F.sum("n").over(above), F.lit(0))).drop("n")
    slim = around.select("node", "link", "shard", "here")
    placed = ranked(slim, ["shard", "here"], [F.col("link"), F.col("node")], "place", buckets, F.coalesce("link", "node")).join(classes, ["shard", "here"])
    spark = held.sparkSession
    counts = held.groupBy("shard").count()
    all_shards = spark.range(shards).select(F.col("id").cast("int").alias("shard")).join(counts, "shard", "left").fillna(0, ["count"])
    # the shards with most documents get one more where the total leaves a rest
    order = Window.orderBy(F.desc("count"), "shard")  # ``shards`` rows
    aims = all_shards.withColumn("aim", F.lit(share) + (F.row_number().over(order) <= rest).cast("int"))
    aims = aims.withColumn("over", F.greatest(F.lit(0), F.col("count") - F.col("aim"))).withColumn("under", F.greatest(F.lit(0), F.col("aim") - F.col("count")))
    upto = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    aims = aims.withColumn("first_over", F.coalesce(F.sum("over").over(upto), F.lit(0))).withColumn("first_under", F.coalesce(F.sum("under").over(upto), F.lit(0)))
    # the gaps that documents move to: at most ``shards``, so an array that is searched
    gap = F.when(F.col("under") > 0, F.struct("first_under", F.col("shard").alias("to")))
    aims = aims.withColumn("gaps", F.array_sort(F.collect_list(gap).over(Window.partitionBy(F.lit(0)))))
    numbered = placed.join(aims.select("shard", "aim", "first_over", "gaps"), "shard").withColumn("beyond", F.col("place") + F.col("above") - F.col("aim"))
    index = F.col("first_over") + F.col("beyond")
    to = F.element_at(F.filter("gaps", lambda g: g["first_under"] <= index), -1)["to"]
    moved = numbered.where("beyond >= 0").select("node", "link", to.alias("shard"))
    return numbered.where("beyond < 0").select("node", "link", "shard").unionByName(moved)


def shard_documents(documents: DataFrame, shards: int = SHARDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row of ``documents`` (doc_id, text).

    Law ``rows``: counts are at most one apart.  Equal texts are linked and gather in one shard as far as
    the law lets them.  A null text counts as empty and is linked like one; rows that repeat and null
    doc_ids are documents of their own.  Other columns are not read.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = documents.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.octet_length(text) + OVERHEAD).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.xxhash64(text, F.octet_length(text)).alias("text_key"),
    )
    rows = park(rows.withColumn("node", F.monotonically_increasing_id()), "documents")
    # written first, so that the join below has no grouping in its stage and Spark may split a hot text
    copies = park(rows.df.groupBy("text_key").count().where("count > 1").select("text_key", F.col("text_key").alias("link")), "copies")
    nodes = rows.df.select("node", "text_key").join(copies.df, "text_key", "left").select("node", "link")
    placed = park(propagate(nodes, shards), "placed")
    buckets = max(1, placed.df.count() // BUCKET_ROWS)
    slots = ranked(placed.df.select("node", "shard"), ["shard"], [F.col("node")], "slot", buckets, F.col("node"))
    return rows.df.join(slots, "node").select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op8_label_propagation_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All of ``documents`` in forty shards of equal row counts."""
    return shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
