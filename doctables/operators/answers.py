"""Structured page answers: validity, fields with defaults, fallbacks, outcome of each file."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from doctables.functions.fixed_values import ALL_FINE, PROMPT_HEAD, PROMPT_TAIL
from doctables.functions.text import base_name, without_extension
from doctables.sources.files import only_pdf

PAGE = ["doc_id", "page_no"]
ANSWER_TABLES = "array<struct<table_title:string,table_content:string>>"


def build_prompt(pages: DataFrame, text: str = "ocr_text", head: str = PROMPT_HEAD, tail: str = PROMPT_TAIL) -> DataFrame:
    """Add the request text of each page; nothing is sent."""
    return pages.withColumn("prompt", F.concat(F.lit(head), F.coalesce(F.col(text), F.lit("")), F.lit(tail)))


def latest_answer(answers: DataFrame, keys: list[str] = PAGE, order: str = "attempt", response: str = "response") -> DataFrame:
    """One answer per page: that of the last attempt, of equal ones the greatest text. Without ``order`` only the text decides."""
    last = F.struct(order, response) if order in answers.columns else F.struct(response)
    return answers.groupBy(*keys).agg(F.max(last).alias("_last")).select(*keys, f"_last.{response}")


def match_page_answer(pages: DataFrame, answers: DataFrame, keys: list[str] = PAGE, order: str = "attempt") -> DataFrame:
    """Pages with their answer, null where there is none. Answers of pages that do not exist: ``orphan_answers``."""
    return pages.join(latest_answer(answers, keys, order), keys, "left")


def orphan_answers(pages: DataFrame, answers: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """Answers, all attempts, that name no page."""
    return answers.join(pages.select(*keys).distinct(), keys, "left_anti")


@contextmanager
def _last_key_counts(spark: SparkSession) -> Iterator[None]:
    """JSON parsed in a plan made here takes the last of repeated keys; the session's setting stays as it was."""
    setting = "spark.sql.variant.allowDuplicateKeys"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "true")
    try:
        yield
    finally:
        spark.conf.set(setting, before)


def classify_answer(matched: DataFrame, response: str = "response") -> DataFrame:
    """``status``: structured (JSON object), fallback (other valid JSON), malformed, or missing; ``answer``: the parsed value.

    Parsers stop behind the first value, so trailing text would go unnoticed. The response is therefore parsed once, as the first of two
    elements; the second is its own checksum. Whatever closes the list early or adds elements leaves no checksum in second place.
    Of repeated keys the last counts.
    """
    r, sum_of = F.col(response), F.md5(F.col(response))
    with _last_key_counts(matched.sparkSession):
        parsed = matched.withColumn("answer", F.try_parse_json(F.concat(F.lit("["), r, F.lit(',"'), sum_of, F.lit('"]'))))
    valid = F.coalesce(F.try_variant_get("answer", "$[1]", "string") == sum_of, F.lit(False))
    status = F.when(r.isNull(), "missing").when(~valid, "malformed").when(r.rlike("^[ \\t\\r\\n]*\\{"), "structured").otherwise("fallback")
    return parsed.withColumn("status", status)


def parse_structured_json(classified: DataFrame) -> DataFrame:
    """Fields of structured answers: absent or null title and content are empty, absent or null tables are ``[]``; tables stay JSON text.

    All are taken from the value that ``classify_answer`` parsed. Tables of titles and contents are written in that order; other values
    with their keys sorted.
    """
    good = F.col("status") == "structured"
    field = lambda name: F.when(good, F.coalesce(F.try_variant_get("answer", f"$[0].{name}", "string"), F.lit("")))
    given = F.try_variant_get("answer", "$[0].tables", "variant")
    text, ordered = F.to_json(given), F.to_json(F.try_variant_get("answer", "$[0].tables", ANSWER_TABLES))
    same = F.length(text) == F.length(ordered)  # else a table holds something beside them
    tables = F.when(given.isNull() | F.is_variant_null(given), "[]").when(same, ordered).otherwise(text)
    return classified.withColumns({"title": field("title"), "content": field("content"), "tables": F.when(good, tables)}).drop("answer")


def fallback_to_ocr(parsed: DataFrame, text: str = "ocr_text", keys: list[str] = PAGE) -> DataFrame:
    """One typed row per page; pages without a structured answer carry their recognised text and nothing else."""
    good = F.col("status") == "structured"
    return parsed.select(
        *keys,
        F.col("page_no").cast("string").alias("page"),
        F.when(good, F.col("title")).otherwise("").alias("title"),
        F.when(good, F.col("content")).otherwise(F.coalesce(F.col(text), F.lit(""))).alias("content"),
        F.when(good, F.col("tables")).otherwise("").alias("tables"),
        "status",
    )


def quarantine(classified: DataFrame) -> DataFrame:
    """Malformed answers, kept aside for inspection."""
    return classified.filter(F.col("status") == "malformed").drop("answer")


def explode_answer_tables(parsed: DataFrame, keys: list[str] = PAGE) -> DataFrame:
    """One row per table of an answer; an answer without tables keeps one row with nulls."""
    tables = F.from_json("tables", ANSWER_TABLES)
    return parsed.select(*keys, F.posexplode_outer(tables).alias("table_no", "_t")).select(
        *keys, "table_no", "_t.table_title", "_t.table_content"
    )


def file_manifest(files: DataFrame, pages: DataFrame, strict: bool = False, read_error: str = "read_error") -> DataFrame:
    """Outcome per PDF file: pages, malformed pages, status and reason. Other files are not taken in.

    A file fails if it could not be read (the optional column ``read_error`` says why) or has no page, and with ``strict`` also if one of
    its answers is malformed.
    """
    files = only_pdf(files)
    error = F.col(read_error) if read_error in files.columns else F.lit(None).cast("string")
    outcome = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_pages"), F.count_if(F.col("status") == "malformed").alias("n_malformed")
    )
    rows = files.select("doc_id", base_name(F.col("path")).alias("file_name"), error.alias("_error")).join(outcome, "doc_id", "left")
    rows = rows.withColumns({n: F.coalesce(n, F.lit(0)) for n in ("n_pages", "n_malformed")})
    malformed = (F.col("n_malformed") > 0) if strict else F.lit(False)
    reason = F.coalesce("_error", F.when(F.col("n_pages") == 0, "no pages"), F.when(malformed, "malformed answer"))
    rows = rows.withColumn("reason", reason).withColumn("status", F.when(F.col("reason").isNull(), "success").otherwise("failed"))
    return rows.drop("_error")


def failure_report(manifest: DataFrame) -> DataFrame:
    """Names of the files that failed by their manifest, or a single line that all is fine."""
    failed = manifest.filter("status <> 'success'")
    names = failed.select(F.col("file_name").alias("report"))
    fine = failed.agg(F.count(F.lit(1)).alias("_n")).filter("_n = 0").select(F.lit(ALL_FINE).alias("report"))
    return names.unionByName(fine)


def output_path(files: DataFrame, directory: str = "out", extension: str = ".csv", path: str = "path") -> DataFrame:
    """Target path: directory, input name without its extension, new extension."""
    return files.withColumn("output_path", F.concat(F.lit(directory + "/"), without_extension(base_name(F.col(path))), F.lit(extension)))
