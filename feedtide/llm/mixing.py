"""Mixing sources to target weights with Efraimidis-Spirakis keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from feedtide.llm.common import documents, numbered, store, text_or_empty

WEIGHTS = (3.0, 1.0, 2.0)
BUCKETS = 4096
WORDS = r"[^\x20\x09-\x0D]+"


def word_count(column: str = "text") -> Column:
    return F.regexp_count(text_or_empty(column), F.lit(WORDS)).cast("long")


def uniform(identity: Column) -> Column:
    """A repeatable number in (0, 1) from the MD5 of an id."""
    high = F.conv(F.substring(F.md5(F.coalesce(identity.cast("string"), F.lit("")).cast("binary")), 1, 12), 16, 10).cast("double")
    return (high + 0.5) / F.lit(float(1 << 48))


def source_targets(sizes: DataFrame, share: float = 1.5, most: float = 2.0, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """source, source_size, target. Sources in code-point order, null last, take the weights in turn.

    Targets are min(level * weight, most * source_size). The level is raised until `share` of all sizes is dealt
    out: each round fixes the sources that would exceed their limit and divides the rest again. A round is one
    aggregate over the table of sources; it never leaves the executors.
    """
    order = [F.col("source").isNull().asc(), F.col("source").asc_nulls_last()]
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    turn = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.pmod("turn", F.lit(len(weights))) + 1).cast("int"))
    table = store(numbered(by_source, order, "turn", "mix-order").withColumn("weight", turn), "mix-sources")
    limit = F.col("source_size") * F.lit(most)
    total = table.agg(F.sum("source_size")).first()[0] or 0
    level, before = 0.0, -1.0
    while level > before:
        full = F.col("weight") * F.lit(level) >= limit
        row = table.agg(F.sum(F.when(full, limit)).alias("fixed"), F.sum(F.when(~full, F.col("weight"))).alias("open")).first()
        if not row["open"]:
            break
        before, level = level, (share * total - (row["fixed"] or 0.0)) / row["open"]
    return table.select("source", "source_size", F.least(limit, F.col("weight") * F.lit(level)).alias("target"))


def choose(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """rows (doc_id, source, size, weight) with source_size, target and taken.

    Every document is taken floor(target / source_size) times. Then documents follow in the order of their keys
    -ln(u) / weight until the rest of the budget is used up; the last place goes to the document whose size comes
    closest to what is left. The prefix sums run in BUCKETS key ranges per source, so no task sees a whole source.
    """
    # u ** (1 / weight), the classic form of the key, is monotone in it and lies in (0, 1)
    key = 1 - F.exp(F.ln(uniform(F.col("doc_id"))) / F.col("weight"))
    keyed = store(
        rows.withColumn("key", F.when(F.col("weight") > 0, key).otherwise(2 - uniform(F.col("doc_id"))))
        .withColumn("bucket", F.floor(F.col("key") * BUCKETS).cast("int")),
        "mix-keys",
    )
    earlier = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        keyed.groupBy("source", "bucket")
        .agg(F.sum("size").alias("bucket_size"))
        .withColumn("start", F.coalesce(F.sum("bucket_size").over(earlier), F.lit(0)))
    )
    budget = targets.withColumn("epochs", F.floor(F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0))).withColumn(
        "rest", F.col("target") - F.col("epochs") * F.col("source_size")
    )
    plan = starts.join(budget, starts["source"].eqNullSafe(budget["source"])).select(
        starts["source"].alias("_source"), F.col("bucket").alias("_bucket"), "start", "source_size", "target", "epochs", "rest"
    )
    inside = Window.partitionBy("source", "bucket").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, 0)
    summed = keyed.join(plan, keyed["source"].eqNullSafe(plan["_source"]) & (keyed["bucket"] == plan["_bucket"])).withColumn(
        "end", F.col("start") + F.sum("size").over(inside)
    )
    chosen = store(
        summed.withColumn("picked", F.col("end") <= F.col("rest")).drop("_source", "_bucket", "start", "bucket"), "mix-picked"
    )
    # what the whole prefix leaves, and the unpicked document that fits it best (size 0: none)
    left = chosen.groupBy("source").agg((F.max("rest") - F.coalesce(F.sum(F.when(F.col("picked"), F.col("size"))), F.lit(0))).alias("left"))
    left = left.select(F.col("source").alias("_source"), "left")
    open_ = chosen.filter(~F.col("picked")).join(left, chosen["source"].eqNullSafe(F.col("_source")))
    last = (
        open_.groupBy("source")
        .agg(F.min(F.struct(F.abs(F.col("left") - F.col("size")).alias("miss"), "key", "doc_id", "size", "end", "left")).alias("best"))
        .filter(F.col("best.miss") < F.col("best.left"))
        .select(F.col("source").alias("_source"), F.col("best.key").alias("_key"), F.col("best.end").alias("_end"))
    )
    # sizes above 0 add up to another sum at every row, so the sum tells equal rows apart
    same = chosen["source"].eqNullSafe(last["_source"]) & (chosen["key"] == last["_key"]) & (chosen["end"] == last["_end"]) & (chosen["size"] > 0)
    copies = F.col("epochs") + (F.col("picked") | F.col("_key").isNotNull()).cast("int")
    return chosen.join(last, same, "left").select(
        "doc_id", "source", "size", "source_size", "target", (F.col("size") * copies).cast("long").alias("taken"), copies.cast("int").alias("copies")
    )


def quality_weights(labels: DataFrame) -> DataFrame:
    """doc_id, weight: 2 if any label calls the document good, else 1. Documents without a label weigh 1."""
    return labels.groupBy("doc_id").agg((1.0 + F.max(F.coalesce("quality", F.lit(0)))).alias("weight"))


def mix(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, copies for every document.

    Null or empty texts have size 0 and are taken with nothing. A null source is a source of its own, the last.
    Rows that repeat a doc_id are separate documents with the same key. An empty table gives an empty result.
    Other columns of `docs` and `labels` are not looked at; labels without a document are ignored.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "source", word_count().alias("size"))
    if labels is None:
        rows = rows.withColumn("weight", F.lit(1.0))
    else:
        rows = rows.join(quality_weights(labels), "doc_id", "left").withColumn("weight", F.coalesce("weight", F.lit(1.0)))
    rows = store(rows, "mix-sizes")
    return choose(rows, source_targets(rows))


def mixed_documents(docs: DataFrame, labels: DataFrame | None = None) -> DataFrame:
    """Each row of `docs` as often as the mix takes it, with the same columns. Where the mix takes some of the rows that are equal in
    doc_id, source and size more often than others (a few groups for each source), as many of them are taken so."""
    copies = F.col("copies")
    taken = mix(docs, labels).groupBy("doc_id", "source", "size").agg(F.min(copies).alias("least"), F.max(copies).alias("most"), F.sum(copies).alias("all"), F.count("*").alias("n"))
    taken = store(taken.filter("most > 0").toDF("_doc_id", "_source", "_size", "_least", "_most", "_all", "_n"), "mix-taken")
    same = docs["doc_id"].eqNullSafe(taken["_doc_id"]) & docs["source"].eqNullSafe(taken["_source"]) & (word_count() == taken["_size"])

    def repeated(rows: DataFrame, times: Column) -> DataFrame:
        return rows.select(*[rows[c] for c in docs.columns], F.explode(F.sequence(F.lit(1), times)).alias("_copy")).drop("_copy")

    mixed = repeated(docs.join(taken.filter("_least = _most"), same), F.col("_most"))
    uneven = taken.filter("_least < _most")
    if uneven.isEmpty():
        return mixed
    keys = ["_doc_id", "_source", "_size"]
    rows = docs.join(uneven, same).withColumn("_tie", F.monotonically_increasing_id())
    placed = numbered(rows, [F.col(c) for c in [*keys, "_tie"]], "_nth", "mix-uneven")
    first = placed.groupBy(*keys).agg(F.min("_nth").alias("_first")).toDF("_d", "_s", "_z", "_first")
    found = placed["_doc_id"].eqNullSafe(first["_d"]) & placed["_source"].eqNullSafe(first["_s"]) & (placed["_size"] == first["_z"])
    # copies differ by one at most: the first rows are taken once more
    often = F.col("_least") + (F.col("_nth") - F.col("_first") < F.col("_all") - F.col("_least") * F.col("_n")).cast("int")
    again = placed.join(first, found).withColumn("_often", often.cast("int")).filter("_often > 0")
    return mixed.unionByName(repeated(again, F.col("_often")))


def op3_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return mix(documents(spark, sf_dir), labels).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
