"""Queries of the problems of text and reference data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenfold.llm import canon, filters, leakage, packing, sql, stuffing, targets
from lumenfold.plans.registry import Registry
from lumenfold.session import read

registry = Registry()
query = registry.query

#: Vocabulary that measures texts, and the permitted sequence lengths.
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
SIZES = (2048, 4096, 8192)


@query("p2_found")
def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    """Scheduler and library rows that mean the same target."""
    return p2_links(spark, sf).select("id", "target_id")


@query("p2_links")
def p2_links(spark: SparkSession, sf: str) -> DataFrame:
    """The same with the confidence and the levels of agreement."""
    schedule = read(spark, sf, "scheduler_target").select("id", "name", "ra", "dec", "rotation")
    library = read(spark, sf, "library_target").select("target_id", "objects", "center_ra_deg", "center_dec_deg", "footprint_arcmin", "rotation_deg")
    m = targets.matches(schedule, library)
    return m.select(F.col("l").alias("id"), F.col("r").alias("target_id"), F.round("confidence", 6).alias("confidence"), "level_designation", "level_name", "level_place", "level_rotation")


TYPED = (("exposuretemplate", "id", "filtername"), ("plan_row", "plan_row_id", "filter"), ("acquiredimage", "id", "filtername"))


def _typed(spark: SparkSession, sf: str) -> DataFrame:
    """tbl, row_id and value of every row whose filter isn't null nor a name of the list; rows loaded twice stay."""
    names = [r[0] for r in read(spark, sf, "filter_canon").select("canon_name").collect()]
    rows = None
    for table, key, column in TYPED:
        df = read(spark, sf, table).select(F.lit(table).alias("tbl"), F.col(key).cast("bigint").alias("row_id"), F.col(column).alias("value"))
        df = df.where(F.col("value").isNotNull() & ~canon.is_listed("value", names))
        rows = df if rows is None else rows.unionByName(df)
    return rows


def _matched(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    rows = _typed(spark, sf)
    return rows, canon.match_values(rows.select("value"), filters.entries(read(spark, sf, "filter_canon")), filters.BESIDE)


@query("p3_found", sql.p3_found())
def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    """The entry that each free-typed filter means, 0 if none."""
    rows, matched = _matched(spark, sf)
    return canon.map_column(rows, "value", matched).select("tbl", "row_id", "canon_id").distinct()


@query("p3_unmatched")
def p3_unmatched(spark: SparkSession, sf: str) -> DataFrame:
    """Values that are on no list, with their rows by table."""
    rows, matched = _matched(spark, sf)
    return canon.map_column(rows.distinct(), "value", matched).where("canon_id = 0").groupBy("value").pivot("tbl", [t for t, _, _ in TYPED]).count().na.fill(0)


def _placed(spark: SparkSession, sf: str) -> DataFrame:
    counts = packing.token_counts(read(spark, sf, "documents").select("doc_id", "text"), VOCABULARY)
    return packing.pack(counts, SIZES)


@query("p8_packing")
def p8_packing(spark: SparkSession, sf: str) -> DataFrame:
    """The place of each text, or piece of a text that exceeds the greatest size, in the sequences."""
    return _placed(spark, sf).withColumnRenamed("id", "doc_id")


@query("p8_bins")
def p8_bins(spark: SparkSession, sf: str) -> DataFrame:
    """Sequences by size with their tokens and unused room."""
    bins = _placed(spark, sf).groupBy("bin").agg(F.first("capacity").alias("capacity"), F.sum("length").alias("tokens"), F.count("*").alias("items"))
    return bins.groupBy("capacity").agg(F.count("*").alias("bins"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"), F.sum(F.col("capacity") - F.col("tokens")).alias("unused"))


@query("p8_mixes")
def p8_mixes(spark: SparkSession, sf: str) -> DataFrame:
    """What each mix of sizes to open bins in would cost: one row a mix, from the histogram of lengths."""
    counts = packing.token_counts(read(spark, sf, "documents").select("doc_id", "text"), VOCABULARY)
    histogram = packing.histogram_of(packing.pieces(counts, max(SIZES)))
    rows = [("+".join(map(str, m)), float(total), sum(g.n for g in groups), sum(g.n * (g.size - g.room) for g in groups)) for m, (total, _, groups) in packing.mixes(histogram, SIZES).items()]
    return spark.createDataFrame(rows, "mix string, cost double, bins bigint, unused bigint")


@query("p8_invariants", sql.P8_INVARIANTS)
def p8_invariants(spark: SparkSession, sf: str) -> DataFrame:
    """What the layout must keep: every text with a token is placed, and nothing else breaks a rule."""
    placed = _placed(spark, sf)
    texts = placed.groupBy("id").agg(F.sum("length").alias("tokens"), F.count("*").alias("pieces"), F.max(F.col("start") + F.col("length")).alias("end"))
    texts = texts.agg(
        F.count("*").alias("texts"),
        F.count_if(F.col("tokens") != F.col("end")).alias("not_whole"),
        F.count_if(F.col("pieces") != F.ceil(F.col("tokens") / F.lit(max(SIZES)))).alias("cut_needlessly"),
    )
    bins = placed.groupBy("bin").agg(F.sum("length").alias("tokens"), F.max(F.col("offset") + F.col("length")).alias("end"), F.max("filled").alias("filled"), F.min("capacity").alias("capacity"), F.max("capacity").alias("most"))
    smaller = [F.when(F.col("tokens") <= s, F.lit(s)) for s in sorted(SIZES)]
    bins = bins.agg(
        F.count_if(F.col("tokens") > F.col("capacity")).alias("overfull"),
        F.count_if((F.col("tokens") != F.col("end")) | (F.col("tokens") != F.col("filled"))).alias("overlapping"),
        F.count_if((F.col("capacity") != F.coalesce(*smaller)) | (F.col("capacity") != F.col("most"))).alias("not_downsized"),
    )
    return texts.crossJoin(bins)


@query("p9_found", sql.P9_FOUND)
def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold at least 12 consecutive words of an evaluation item."""
    return leakage.leaks(read(spark, sf, "documents").select("doc_id", "text"), read(spark, sf, "eval_item").select("item_id", "item_text"))


@query("p9_items", sql.P9_ITEMS)
def p9_items(spark: SparkSession, sf: str) -> DataFrame:
    """Evaluation items that leaked, with the number of documents."""
    return p9_found(spark, sf).groupBy("item_id").agg(F.count("*").alias("documents"))


@query("p10_found")
def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    """Pages that are keywords, links, tags or offers rather than sentences."""
    return stuffing.stuffed_pages(read(spark, sf, "documents").select("doc_id", "text")).select("doc_id").distinct()


@query("p10_measures")
def p10_measures(spark: SparkSession, sf: str) -> DataFrame:
    """The same with what was measured."""
    return stuffing.stuffed_pages(read(spark, sf, "documents").select("doc_id", "text"))
