"""Mixing sources to target weights by weighted fair queueing.

Every source is a queue of its documents in shuffled order (by MD5 of the id), offered up to ``cap`` times
over. An offer's virtual finish time is the words its source has offered so far, divided by the source's
weight; offers are range-sorted by it over the whole table and the mix is cut where its words reach the
budget. A source that runs dry leaves its share to the others in proportion to their weights, which is the
target that ``level`` works out.

Running sums never put one source, or the whole table, in one task: queues are cut into ranges of (source, shuffle key, row), which
no key that many rows share makes large, and the global order into range partitions of which only the
one with the cut is looked at row by row. Sources are a table like any other, however many: their order is
that of range partitions, and the common level of those below their cap is found by rounds of sums over them.
To the driver go sums, and a row a partition.

Defined results: a null or empty text has size 0 and takes nothing; a null source is a source of its own,
last in order; rows with equal ids are told apart by their place in the input; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from genoloom.llm import shared

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS, SHARE, CAP = (3, 1, 2), 1.5, 2


def level(sources: DataFrame, budget: float, cap: int = CAP) -> float | None:
    """The words a unit of weight gets, of the columns (n, w), where no source gets more than ``cap`` times its ``n``; None if all
    get as much. Rounds over those that reach their cap, whose level only rises."""
    at = 0.0
    while True:
        full = F.col("n") * cap <= F.lit(at) * F.col("w")
        r = sources.agg(F.sum(F.when(full, F.col("n"))).alias("n"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if r.w is None:
            return None
        now = (budget - cap * (r.n or 0)) / r.w
        if now <= at:
            return at
        at = now


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, share: float = SHARE, cap: int = CAP) -> tuple[DataFrame, DataFrame]:
    """(documents, offers).

    documents: _rid, doc_id, size, source_size, target, taken, copies; one row for each row of ``docs``.
    offers: _rid, epoch, size, finish, key, for every offer in the mix; sorting by finish, key, epoch
    gives the order of the mix.
    """
    spark = docs.sparkSession
    docs = shared.numbered(docs)
    slim = shared.written(
        docs.select(
            docs[shared.RID].alias("_rid"),
            docs[id_col].alias("_id"),
            (docs[source_col].cast("string") if docs.schema[source_col].dataType.simpleString() == "void" else docs[source_col]).alias("_source"),
            F.coalesce(F.regexp_count(docs[text_col], F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
            F.md5(F.coalesce(docs[id_col].cast("string"), F.lit(""))).alias("key"),
        ),
        "mix",
    )
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = [F.col("_source").isNull(), F.col("_source")]
    table = slim.groupBy("_source").agg(F.sum("size").alias("n"), F.count("*").alias("rows"))
    table = shared.written(table.repartitionByRange(parts, *order).withColumn("_p", F.spark_partition_id()), "sources")
    starts, before, total = [], 0, 0
    for r in sorted(table.groupBy("_p").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).collect()):  # a row a partition
        starts.append((r["_p"], before))
        before += r.rows
        total += r.n
    first = F.broadcast(spark.createDataFrame(starts, "_p int, _before long"))
    table = table.withColumn("_s", F.row_number().over(Window.partitionBy("_p").orderBy(*order)) - 1)
    table = table.join(first, "_p").withColumn("_s", F.col("_s") + F.col("_before"))
    given = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_s") % len(weights) + 1).cast("int"))
    sources = shared.written(table.select("_source", "_s", "n", "rows", given.alias("w")), "sources")
    most = level(sources, share * total, cap)
    whole = F.col("n").cast("double") * cap
    target = whole if most is None else F.least(whole, F.lit(most) * F.col("w"))
    sources = sources.select("_source", "_s", F.col("n").alias("source_size"), target.alias("target"), F.col("w").alias("weight"))
    own = slim.join(sources, slim["_source"].eqNullSafe(sources["_source"])).drop("_source")
    own = shared.written(own.repartitionByRange(parts, "_s", "key", "_rid").withColumn("_part", F.spark_partition_id()), "queues")
    before = own.groupBy("_s", "_part").agg(F.sum("size").alias("_n"))
    before = before.select("_s", "_part", (F.sum("_n").over(Window.partitionBy("_s").orderBy("_part")) - F.col("_n")).alias("_before"))
    queue = own.withColumn("_in", F.sum("size").over(Window.partitionBy("_s", "_part").orderBy("key", "_rid").rowsBetween(Window.unboundedPreceding, 0)))
    queue = queue.join(before, ["_s", "_part"]).withColumn("_epochs", F.array(*[F.lit(k) for k in range(cap)]))
    offers = queue.select("_rid", "size", "key", "weight", (F.col("_before") + F.col("_in")).alias("_cum"), "source_size", F.explode("_epochs").alias("epoch"))
    offers = offers.select("_rid", "size", "key", "epoch", ((F.col("_cum") + F.col("source_size") * F.col("epoch")).cast("double") / F.col("weight")).alias("finish"))
    offers = shared.written(offers.repartitionByRange(parts, "finish", "key", "epoch", "_rid").withColumn("_p", F.spark_partition_id()), "offers")
    sums = {r["_p"]: r.n for r in offers.groupBy("_p").agg(F.sum("size").alias("n")).collect()}  # a row a partition
    budget, done, cut = share * total, 0, None
    for p in sorted(sums):
        if done + sums[p] > budget:
            cut = p
            break
        done += sums[p]
    if cut is not None:
        running = F.sum("size").over(Window.partitionBy("_p").orderBy("finish", "key", "epoch", "_rid").rowsBetween(Window.unboundedPreceding, 0))
        last = offers.filter(F.col("_p") == cut).withColumn("_run", running).filter(F.col("_run") + done <= budget).drop("_run")
        offers = offers.filter(F.col("_p") < cut).unionByName(last)
    taken = offers.groupBy("_rid").agg(F.sum("size").alias("taken"), F.count("*").alias("copies"))
    out = own.join(taken, "_rid", "left").select("_rid", F.col("_id").alias(id_col), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), F.coalesce("copies", F.lit(0)).cast("long").alias("copies"))
    return out, offers.drop("_p")


def mixture(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """The rows of ``docs`` in the mix, with all their columns and those of ``mix`` (named mix_* where they clash).

    ``copies`` says how often the mix has a row.
    """
    docs = shared.numbered(docs)
    own = {c.lower() for c in docs.columns}
    with shared.scope():
        taken = shared.kept(shared.written(mix(docs, id_col, text_col, source_col, **how)[0].filter("copies > 0"), "taken"))
    new = ["size", "source_size", "target", "taken", "copies"]
    taken = taken.select(F.col("_rid").alias(shared.RID), *[F.col(c).alias(f"mix_{c}" if c in own else c) for c in new])
    both = docs.join(taken, shared.RID)
    return both.select(*[docs[f"`{c}`"] for c in docs.columns if c != shared.RID], *[taken[c] for c in taken.columns[1:]])


def op5_mix_sources(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))[0].drop("_rid", "copies")


SQL = r"""
WITH d AS (SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS key,
                  coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, [3, 1, 2][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS w FROM d GROUP BY source),
r AS (SELECT *, row_number() OVER (ORDER BY 2 * n / w::DOUBLE, source NULLS LAST) AS k FROM s),
l AS (SELECT *, (1.5::DOUBLE * (sum(n) OVER ())::DOUBLE - 2 * (sum(n) OVER (ORDER BY k) - n)::DOUBLE) / (sum(w) OVER () - sum(w) OVER (ORDER BY k) + w)::DOUBLE AS level FROM r),
f AS (SELECT level, k FROM l WHERE level * w <= 2 * n ORDER BY k LIMIT 1),
t AS (SELECT l.source, l.n, l.w, CASE WHEN l.k < f.k THEN 2.0::DOUBLE * l.n ELSE f.level * l.w END AS target FROM l, f),
q AS (SELECT d.*, t.n, t.w, t.target, sum(size) OVER (PARTITION BY d.source ORDER BY key ROWS UNBOUNDED PRECEDING) AS cum
      FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
o AS (SELECT doc_id, key, size, e.epoch, (cum + n * e.epoch)::DOUBLE / w AS finish FROM q, (SELECT unnest([0, 1]) AS epoch) e),
m AS (SELECT *, sum(size) OVER (ORDER BY finish, key, epoch ROWS UNBOUNDED PRECEDING) AS run FROM o),
x AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM m WHERE run <= (SELECT 1.5 * sum(size) FROM d) GROUP BY doc_id)
SELECT q.doc_id, q.size, q.n AS source_size, q.target::DOUBLE AS target, coalesce(x.taken, 0)::BIGINT AS taken FROM q LEFT JOIN x ON q.doc_id = x.doc_id
"""
