"""Filters, ranks, rollups and pages over pair results."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marklens.operators.grouping import top_k

PAGE_SIZE = 6
SORTABLE = ("final_similarity", "text_similarity", "vit_similarity", "color_similarity")
STATUSES = ("all", "infringement", "clear")


def on_failure(
    results: DataFrame,
    scores: Sequence[str],
    mode: str = "drop",
    label: str | None = None,
    value: str = "PROCESSING FAILED",
) -> DataFrame:
    """Rows whose scores are missing are dropped, or kept with 0 and a label."""
    if mode == "drop":
        return results.dropna(subset=list(scores))
    if mode != "keep":
        raise ValueError(f"unknown mode: {mode}")
    failed = F.lit(False)
    for name in scores:
        failed = failed | F.col(name).isNull()
    if label is not None:
        results = results.withColumn(label, F.when(failed, value).otherwise(F.col(label)))
    return results.fillna(0.0, subset=list(scores))


def filter_min_similarity(results: DataFrame, minimum: float) -> DataFrame:
    return results.filter(F.coalesce(F.col("final_similarity"), F.lit(0.0)) >= minimum)


def filter_status(results: DataFrame, mode: str = "all") -> DataFrame:
    if mode not in STATUSES:
        raise ValueError(f"unknown status filter: {mode}")
    if mode == "all":
        return results
    flagged = F.col("infringement_detected")
    return results.filter(flagged if mode == "infringement" else ~flagged)


def search(results: DataFrame, term: str) -> DataFrame:
    """Case-insensitive search in name and both texts."""
    found = F.lit(False)
    for name in ("logo_name", "text1", "text2"):
        found = found | F.contains(F.lower(F.coalesce(F.col(name), F.lit(""))), F.lit(term.lower()))
    return results.filter(found)


def filter_processing(results: DataFrame, statuses: Sequence[str]) -> DataFrame:
    return results.filter(F.col("processing_status").isin(*statuses))


def order_by(
    results: DataFrame, by: str = "final_similarity", descending: bool = True
) -> DataFrame:
    """Sorted by a score (missing counts as 0), ties by the pair."""
    if by not in SORTABLE:
        raise ValueError(f"cannot sort by {by}")
    key = F.coalesce(F.col(by), F.lit(0.0))
    return results.orderBy(key.desc() if descending else key.asc(), "ref_id", "cmp_id")


def top_results(results: DataFrame, n: int, by: str = "final_similarity") -> DataFrame:
    return order_by(results, by).limit(n)


def infringements(results: DataFrame) -> DataFrame:
    """All infringing pairs over all references, highest first."""
    return order_by(filter_status(results, "infringement"))


def rank_in_reference(results: DataFrame, k: int) -> DataFrame:
    """The best ``k`` results of each reference with their rank."""
    order: list[Column] = [F.desc("final_similarity"), F.asc("logo_name"), F.asc("cmp_id")]
    return top_k(results, ["ref_id"], order, k)


def page(results: DataFrame, number: int, size: int = PAGE_SIZE) -> DataFrame:
    """Rows of a page of sorted results, numbered from 1."""
    if number < 1:
        raise ValueError("pages start at 1")
    return results.offset((number - 1) * size).limit(size)


def page_count(results: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    return results.agg(F.ceil(F.count("*") / F.lit(size)).alias("pages"))


def _rate(part: Column, whole: Column, digits: int) -> Column:
    return F.round(
        F.when(whole > 0, part * 100.0 / F.nullif(whole, F.lit(0))).otherwise(F.lit(0.0)), digits
    )


def per_reference(results: DataFrame) -> DataFrame:
    return results.groupBy("ref_id").agg(
        F.count("*").alias("result_count"),
        F.count_if("infringement_detected").alias("infringement_count"),
    )


def summary(results: DataFrame) -> DataFrame:
    """Comparisons, infringements and rate: one row per reference and a total row."""
    counts = results.rollup("ref_id").agg(
        F.grouping("ref_id").cast("int").alias("is_total"),
        F.count("*").alias("total_comparisons"),
        F.count_if("infringement_detected").alias("infringements"),
    )
    return counts.withColumn(
        "infringement_rate", _rate(F.col("infringements"), F.col("total_comparisons"), 2)
    )


def reference_totals(flagged: DataFrame, refs: DataFrame, marks: DataFrame) -> DataFrame:
    """Comparisons, flagged pairs and rate of every reference, those without one included.

    ``refs`` and ``marks`` are ``logo_id``. A reference is compared with every mark but
    itself, so the comparisons follow from the sizes and no pair is listed for them.
    """
    everyone = marks.agg(F.count("*").alias("_marks"))
    own = marks.groupBy(F.col("logo_id").alias("ref_id")).agg(F.count("*").alias("_own"))
    hits = flagged.groupBy("ref_id").agg(F.count_if("infringement_detected").alias("_hits"))
    # one row
    listed = refs.select(F.col("logo_id").alias("ref_id")).distinct().crossJoin(F.broadcast(everyone))
    counted = listed.join(own, "ref_id", "left").join(hits, "ref_id", "left").fillna(0, ["_own", "_hits"])
    counted = counted.select(
        "ref_id", (F.col("_marks") - F.col("_own")).alias("total_comparisons"), F.col("_hits").alias("infringement_count")
    )
    return counted.withColumn(
        "infringement_rate", _rate(F.col("infringement_count"), F.col("total_comparisons"), 2)
    )


def score_bands(results: DataFrame, score: str = "similarity_score") -> DataFrame:
    """Mean and number of results in the five confidence bands of a 0..1 score."""
    s = F.col(score)
    return results.agg(
        F.count("*").alias("results"),
        F.avg(s).alias("average_score"),
        F.count_if(s >= 0.75).alias("very_high"),
        F.count_if((s >= 0.55) & (s < 0.75)).alias("high"),
        F.count_if((s >= 0.35) & (s < 0.55)).alias("medium"),
        F.count_if((s >= 0.15) & (s < 0.35)).alias("low"),
        F.count_if(s < 0.15).alias("very_low"),
    )


def dashboard_stats(results: DataFrame, minimum: float = 0.0) -> DataFrame:
    """Figures of the overview: all rows counted once, shown rows by ``minimum``."""
    final = F.coalesce(F.col("final_similarity"), F.lit(0.0))
    shown = final >= minimum
    flagged = shown & F.col("infringement_detected")
    counts = results.agg(
        F.count("*").alias("total"),
        F.count_if(shown).alias("shown"),
        F.count_if(flagged).alias("infringements"),
        F.avg(F.when(shown, final)).alias("mean_final"),
        F.avg(F.when(shown, F.coalesce(F.col("vit_similarity"), F.lit(0.0)))).alias("mean_visual"),
        F.count_if(shown & (final >= 70)).alias("high_similarity"),
        F.count_if(shown & ~F.col("infringement_detected")).alias("clear"),
    )
    return counts.withColumn("infringement_rate", _rate(F.col("infringements"), F.col("shown"), 2))


# --- nested report -----------------------------------------------------------

REPORT_ROWS = 100_000


def to_report(results: DataFrame, part_rows: int = REPORT_ROWS) -> DataFrame:
    """A reference's results as a sorted array, with its counts: ``ref_id, part, ...``.

    A reference with more than ``part_rows`` results is spread over several rows,
    its parts, so no array grows without bound; the counts always cover all parts.
    """
    counts = per_reference(results)
    fields = [c for c in results.columns if c != "ref_id"]
    entry = F.struct((-F.coalesce("final_similarity", F.lit(0.0))).alias("_order"), *fields)
    part = F.pmod(F.xxhash64("cmp_id"), F.ceil(F.col("result_count") / F.lit(part_rows)))
    nested = F.sort_array(F.collect_list(entry))
    return (
        results.join(counts, "ref_id")
        .withColumn("part", part)
        .groupBy("ref_id", "part", "result_count", "infringement_count")
        .agg(F.transform(nested, lambda x: x.dropFields("_order")).alias("results"))
    )


def flatten_report(report: DataFrame) -> DataFrame:
    """Inverse of the nested report: one row per pair."""
    return report.select("ref_id", F.inline("results"))


def write_report(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").json(path)


def export_csv(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").option("header", True).csv(path)


def run_metrics(results: DataFrame, name: str = "run") -> tuple[DataFrame, object]:
    """``results`` observed for pair and infringement counts of the run."""
    from pyspark.sql import Observation

    observation = Observation(name)
    observed = results.observe(
        observation,
        F.count(F.lit(1)).alias("comparisons"),
        F.count_if("infringement_detected").alias("infringements"),
    )
    return observed, observation


def speed(comparisons: int, references: int, seconds: float) -> dict[str, float]:
    """Driver-side figures of a run: total, per reference, comparisons per second."""
    return {
        "total_processing_time": round(seconds, 2),
        "average_time_per_reference": round(seconds / references, 2) if references else 0.0,
        "images_per_second": round(comparisons / seconds, 1) if seconds else 0.0,
    }
