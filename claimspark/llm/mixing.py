"""Mixing sources to target weights by weighted fair queueing.

Each source's documents stand in a shuffled order; a document's virtual finish time is its source's words up to and
with it, over the source's target. The queue serves all sources by finish time and is cut where the total budget is
spent. A source whose target exceeds its size goes round again, up to ``max_repeats`` times.

Prefix sums come in two levels (sums by bucket of the shuffle key, then a window inside one bucket), so a source
that holds most rows is dealt over many tasks. Null text has size 0; null source is a source of its own, ranked last; the
order is shuffled by id and text, so null and repeated ids stand anywhere too, and the layout of the files decides nothing; equal rows are rows of their own, which of
them is served first is all the same; an empty table gives an empty result. Columns but id, source and text are not read
by ``mix_sources`` and go through ``mixed_documents``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from claimspark.llm.common import WORD_RE, fresh, stage, table

BUCKETS = 4096


def cyclic_weights(rank: Column, weights: tuple[int, ...] = (1, 2, 3)) -> Column:
    """Weight of a source by its rank from 1: the weights in turn."""
    return F.element_at(F.array(*[F.lit(float(w)) for w in weights]), ((rank - 1) % len(weights) + 1).cast("int"))


def capped_shares(rows: list[tuple[int, float]], budget: float, cap: float) -> list[float]:
    """Shares of ``budget`` by weight over (size, weight), none above ``cap`` times its size; excess goes round again."""
    target = [0.0] * len(rows)
    open_ = [i for i, (size, w) in enumerate(rows) if w > 0 and size > 0]
    left = float(budget)
    while open_:
        total = sum(rows[i][1] for i in open_)
        over = [i for i in open_ if left * rows[i][1] / total > cap * rows[i][0]]
        if not over:
            for i in open_:
                target[i] = left * rows[i][1] / total
            break
        for i in over:
            target[i] = cap * rows[i][0]
            left -= target[i]
        open_ = [i for i in open_ if i not in over]
    return target


def mix_sources(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text", weights: tuple[int, ...] = (1, 2, 3), max_repeats: int = 3, seed: int = 8, keyed: bool = False) -> DataFrame:
    """(id, size, source_size, target, taken, times) for each row; ``taken`` is size by the times a document is served. keyed: and a
    digest of id, source and text as ``key``.

    ``weights`` go to the sources in code-point order, repeating. The sources themselves (not rows) are listed on the
    driver to solve the shares: a mix is stated for a list of sources.
    """
    spark = docs.sparkSession
    size = F.regexp_count(F.coalesce(F.col(text_col), F.lit("")), F.lit(WORD_RE)).cast("long")
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("src"), size.alias("size"), F.xxhash64(F.lit(seed), F.col(id_col), F.col(text_col)).alias("h"), *([row_key(id_col, source_col, text_col).alias("key")] if keyed else []))
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()).withColumn("bucket", F.shiftrightunsigned("h", 52)), "mix")
    sums = stage(rows.groupBy("src", "bucket").agg(F.sum("size").alias("b_size")), "mix-sums")
    per = sums.groupBy("src").agg(F.sum("b_size").alias("s")).collect()
    per = sorted(per, key=lambda r: (r.src is None, (r.src or "").encode("utf-32-be")))
    shares = capped_shares([(r.s, float(weights[i % len(weights)])) for i, r in enumerate(per)], float(sum(r.s for r in per)), float(max_repeats))
    kind = docs.schema[source_col].dataType.simpleString()
    plan = spark.createDataFrame([(r.src, int(r.s), t, i) for i, (r, t) in enumerate(zip(per, shares, strict=True))], f"p_src {kind}, source_size bigint, target double, rank int")
    budget = int(sum(r.s for r in per))

    upto = Window.partitionBy("src").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    before = sums.select("src", "bucket", F.coalesce(F.sum("b_size").over(upto), F.lit(0)).alias("before"))
    before = before.join(plan, F.col("src").eqNullSafe(F.col("p_src")))
    inside = Window.partitionBy("src", "bucket").orderBy(F.col("h").asc(), F.col("id").asc_nulls_first(), "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("within", F.sum("size").over(inside)).alias("r").join(before.alias("b"), F.col("r.src").eqNullSafe(F.col("b.src")) & (F.col("r.bucket") == F.col("b.bucket")))
    more = ["key"] if keyed else []
    placed = placed.select("id", "size", "source_size", "target", "rank", "row", (F.col("before") + F.col("within")).alias("cum"), *more)
    placed = stage(placed, "mix-placed")

    finish = lambda k: (F.col("source_size") * k + F.col("cum")) / F.col("target")
    cut = _cut(placed, finish, max_repeats, budget)
    served = lambda k: F.when((F.col("target") > 0) & (F.struct(finish(k), "rank", "row") <= cut), 1).otherwise(0)
    times = sum((served(k) for k in range(1, max_repeats)), served(0))
    return placed.select(F.col("id").alias(id_col), "size", "source_size", "target", (F.col("size") * times).alias("taken"), times.alias("times"), *more)


def row_key(id_col: str, source_col: str, text_col: str) -> Column:
    """Digest of id, source and text; rows that are equal in all three share it."""
    part = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("n"))
    return F.unhex(F.sha2(F.concat(part(F.col(id_col)), part(F.col(source_col)), F.col(text_col).isNull().cast("string"), F.coalesce(F.col(text_col), F.lit(""))), 256))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` as often as the mix serves them, with their own columns."""
    key, n, many, visit = fresh(docs, "key", "n", "many", "visit")
    times = mix_sources(docs, id_col, source_col, text_col, keyed=True).groupBy(F.col("key").alias(key)).agg(F.sum("times").cast("int").alias(n), F.count(F.lit(1)).alias(many)).where(f"{n} > 0")
    times = stage(times, "mix-times")
    served = docs.withColumn(key, row_key(id_col, source_col, text_col)).join(times, key)
    whole = served.where(F.col(many) == 1)
    if not times.where(F.col(many) > 1).isEmpty():  # equal rows share what is served of them; the rest goes to the first
        number = F.row_number().over(Window.partitionBy(key).orderBy(F.lit(0)))
        share = F.floor((F.col(n) + F.col(many) - number) / F.col(many)).cast("int")
        whole = whole.unionByName(served.where(F.col(many) > 1).withColumn(n, share).where(F.col(n) > 0))
    return whole.withColumn(visit, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*docs.columns)


def _cut(placed: DataFrame, finish, repeats: int, budget: int, few: int = 100_000) -> Column:
    """(finish, rank, row) of the last visit that the budget pays for, over the global order of all visits.

    Sums by range of the finish time find the range where the budget ends; only that range is put in order.
    """
    visits = placed.where("target > 0").select(F.explode(F.array(*[F.struct(finish(k).alias("f"), "rank", "row", "size") for k in range(repeats)])).alias("v")).select("v.*")
    # finish times from 0 to 64; what is beyond counts as 64. Ranges within the range where the budget ends, until few visits are left
    low, width, spent, inside = 0.0, 64.0, 0, visits
    while True:
        at = F.least(F.floor((F.least(F.col("f"), F.lit(64.0)) - F.lit(low)) / F.lit(width) * BUCKETS), F.lit(BUCKETS - 1))
        ranges = inside.groupBy(at.alias("at")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        upto = Window.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        run = ranges.select("at", "n", "words", (F.sum("words").over(upto) + F.lit(spent)).alias("run"))  # BUCKETS rows at most
        last = run.where(F.col("run") >= budget).orderBy("at").first()
        if last is None:
            return F.struct(F.lit(float("inf")), F.lit(0), F.lit(0).cast("long"))
        inside, spent = inside.where(at == last.at), last.run - last.words
        low, width = low + width * last.at / BUCKETS, width / BUCKETS
        if last.n <= few or width < 1e-9:
            break
    inner = Window.orderBy("f", "rank", "row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    tail = inside.withColumn("run", F.sum("size").over(inner) + F.lit(spent))
    end = tail.where(F.col("run") <= budget).orderBy(F.desc("f"), F.desc("rank"), F.desc("row")).first()
    if end is None:  # all before this range
        return F.struct(F.lit(low), F.lit(-1), F.lit(-1).cast("long"))
    return F.struct(F.lit(end.f), F.lit(end["rank"]), F.lit(end.row).cast("long"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"))


ORACLE: dict[str, str] = {}
