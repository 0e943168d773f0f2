"""Scanline statistics of a page: threshold, ink, bands of text lines, skew."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doctables.operators.blocks import ROWS_PER_PART, gap_numbers, int_block, lookup_by_block, running_sum

PAGE_ID = ["page_id"]
LINES_PER_CROP = 1024


def otsu_threshold(pixels: DataFrame, keys: list[str] = PAGE_ID, v: str = "v") -> DataFrame:
    """Per-page threshold with the largest between-class variance; the lowest level wins ties, 0 without any split.

    ``v`` is an intensity level (0..255), so the windows run over at most 256 rows per page.
    """
    levels = pixels.groupBy(*keys, F.col(v).alias("_v")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    page = Window.partitionBy(*keys)
    upto = page.orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    mass = F.col("_v") * F.col("_n")
    sums = levels.withColumns(
        {"_w0": F.sum("_n").over(upto), "_s0": F.sum(mass).over(upto), "_w": F.sum("_n").over(page), "_s": F.sum(mass).over(page)}
    )
    lead = F.col("_w") * F.col("_s0") - F.col("_w0") * F.col("_s")
    variance = lead * lead / (F.col("_w0") * (F.col("_w") - F.col("_w0")))
    best = F.max(F.when(F.col("_w") > F.col("_w0"), F.struct(variance.alias("s"), (-F.col("_v")).alias("v"))))
    return sums.groupBy(*keys).agg(F.coalesce(-best["v"], F.lit(0)).cast("int").alias("threshold"))


def threshold_binarize(pixels: DataFrame, thresholds: DataFrame, keys: list[str] = PAGE_ID, y: str = "y", v: str = "v") -> DataFrame:
    """Inverse binary value: 255 (ink) where the intensity is at most the page's threshold, else 0."""
    rows = lookup_by_block(pixels, thresholds, keys, int_block(F.col(y), 256))
    return rows.withColumn("ink", F.when(F.col(v) <= F.col("threshold"), 255).otherwise(0)).drop("threshold")


def ink_profile(binary: DataFrame, keys: list[str] = PAGE_ID, y: str = "y", ink: str = "ink") -> DataFrame:
    """Sum of ink per scanline."""
    return binary.groupBy(*keys, y).agg(F.sum(F.col(ink).cast("bigint")).alias("ink"))


def segment_bands(profile: DataFrame, keys: list[str] = PAGE_ID, y: str = "y", part_rows: int = ROWS_PER_PART) -> DataFrame:
    """Runs of consecutive scanlines with ink, both ends inclusive, numbered from the top. Pages without ink have none."""
    banded = gap_numbers(profile.filter(F.col("ink") > 0), keys, y, 1, None, "band_no", part_rows)
    return banded.groupBy(*keys, "band_no").agg(F.min(y).alias("y_start"), F.max(y).alias("y_end"))


def crop_bands(rows: DataFrame, bands: DataFrame, keys: list[str] = PAGE_ID, y: str = "y", exclusive_end: bool = False) -> DataFrame:
    """Rows (scanlines or pixels) inside a band, with its number; ``exclusive_end`` loses the last scanline of each band.

    Bands are laid out as scanlines (in two steps, so that a tall band is never one array) and met by equality.
    """
    last = F.col("y_end") - F.lit(1 if exclusive_end else 0)
    covered = (
        bands.filter(F.col("y_start") <= last)
        .select(*keys, "band_no", "y_start", last.alias("_last"), F.explode(F.sequence("y_start", last, F.lit(LINES_PER_CROP))).alias("_from"))
        .select(*keys, "band_no", F.explode(F.sequence("_from", F.least(F.col("_from") + LINES_PER_CROP - 1, F.col("_last")))).alias(y))
    )
    return rows.join(covered, [*keys, y])


def band_heights(bands: DataFrame, exclusive_end: bool = False) -> DataFrame:
    return bands.withColumn("height", F.col("y_end") - F.col("y_start") + F.lit(0 if exclusive_end else 1))


def page_skew_angle(pages: DataFrame, edges: DataFrame, keys: list[str] = PAGE_ID, theta: str = "theta", part_rows: int = ROWS_PER_PART) -> DataFrame:
    """Exact median of ``degrees(theta) - 90`` over the lines of a page; 0 for a page without lines.

    Equal angles collapse into counts first, and the counts before each angle tell the middle one or two. Many angles of one page are cut
    into parts of ``part_rows``, so none is collected and no window runs over all of them.
    """
    counts = edges.filter(F.col(theta).isNotNull()).groupBy(*keys, F.col(theta).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*keys).agg(F.sum("_n").alias("_total"))
    ranked = running_sum(counts, keys, ["_t"], F.col("_n"), "_before", part_rows)
    ranked = lookup_by_block(ranked, totals, keys, int_block(F.col("_before"), 1 << 20))
    low, high = F.floor((F.col("_total") - 1) / 2), F.floor(F.col("_total") / 2)
    after = F.col("_before") + F.col("_n")
    has_low = (F.col("_before") <= low) & (low < after)
    has_high = (F.col("_before") <= high) & (high < after)
    degrees = F.degrees("_t") - 90
    angle = (F.sum(F.when(has_low, degrees)) + F.sum(F.when(has_high, degrees))) / 2
    medians = ranked.filter(has_low | has_high).groupBy(*keys).agg(angle.alias("angle"))
    return pages.select(*keys).join(medians, keys, "left").withColumn("angle", F.coalesce("angle", F.lit(0.0)))
