"""Secret scans over a ledger of blobs, with DataFrame functions only.

Every version of every path is known by the content address of its text (SHA-256). The ledger lists which blobs were scanned under which
version of the rules. A run scans only pairs that the ledger lacks, each blob once however many paths hold it, appends the findings, and
joins them back to all paths. Positions come from the texts between the matches: where a rule's k-th match starts is the length of all
that lies before it.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doctables.llm.common import renamed


@dataclass(frozen=True)
class Rule:
    """A pattern; ``group`` of a match must have ``least`` characters. ``marker``: a pattern that is cheap and true for every text that matches."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    marker: str = ""


WORDS = r"(?i:password|passwd|secret|token|api_?key)"
BASE = (
    Rule("assign", rf"""({WORDS})["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, WORDS),
    Rule("access", r"AKIA[A-Z0-9]{16,}", marker="AKIA"),
    Rule("hex", r"[0-9a-f]{24,}"),
)
MORE = (
    Rule("pem", r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----", marker="PRIVATE KEY"),
    Rule("forge", r"gh[opsu]_[A-Za-z0-9]{36,}", marker="gh[opsu]_"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]{10,}", marker="xox"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", marker="eyJ"),
)
RULES = BASE + MORE
SPAN = "array<struct<kind:string,start:int,end:int>>"


def rules_version(rules: tuple[Rule, ...]) -> str:
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def spans(text: Column, rule: Rule) -> Column:
    """The rule's spans in a text, leftmost first, in code points. (A pattern that drops short matches by itself consumes the same text.)"""
    pattern = F.lit(rule.pattern)
    gaps, found = F.split(text, rule.pattern, -1), F.regexp_extract_all(text, pattern, F.lit(0))
    tested = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else found
    sizes = F.zip_with(F.transform(F.slice(gaps, 1, F.size(found)), F.length), F.zip_with(F.transform(found, F.length), F.transform(tested, F.length), lambda n, t: F.struct(n.alias("n"), t.alias("t"))), lambda g, x: F.struct(g.alias("g"), x["n"].alias("n"), x["t"].alias("t")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(SPAN).alias("out"))

    def add(state, x):
        a = state["at"] + x["g"]
        one = F.array(F.struct(F.lit(rule.kind).alias("kind"), a.alias("start"), (a + x["n"]).alias("end")))
        return F.struct((a + x["n"]).alias("at"), F.when(x["t"] >= rule.least, F.concat(state["out"], one)).otherwise(state["out"]).alias("out"))

    walked = F.aggregate(sizes, start, add)["out"]
    return F.when(text.rlike(rule.marker or rule.pattern), walked).otherwise(F.array().cast(SPAN))


def scanned(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """blob, spans: all findings of a blob by start, then rule as listed."""
    order = {r.kind: k for k, r in enumerate(rules)}
    table = blobs.select("blob", *[spans(F.col("text"), r).alias(r.kind) for r in rules])

    def ranked(rule: Rule) -> Column:
        return F.transform(rule.kind, lambda s: F.struct(s["start"].alias("start"), F.lit(order[rule.kind]).alias("rank"), s["end"].alias("end"), s["kind"].alias("kind")))

    keyed = [ranked(r) for r in rules]
    merged = F.array_sort(F.concat(*keyed))
    return table.select("blob", F.transform(merged, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"))).alias("spans"))


def addressed(versions: DataFrame, path: str, text: str) -> DataFrame:
    """path, text (missing: empty) and the blob's address."""
    table = renamed(versions, {"path": path, "text": text}).select("path", F.coalesce("text", F.lit("")).alias("text"))
    return table.withColumn("blob", F.sha2("text", 256))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES, path: str = "doc_id", text: str = "text") -> DataFrame:
    """path, blob, spans for every version; blobs that the ledger (a folder) lacks under these rules are scanned and added to it.

    Missing texts are the empty blob. Repeated versions each get their row. An empty table adds nothing.
    """
    spark, version = versions.sparkSession, rules_version(rules)
    table = addressed(versions, path, text)
    new = table
    folder = spark._jvm.org.apache.hadoop.fs.Path(ledger)
    if folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):
        known = spark.read.parquet(ledger).filter(F.col("rules") == version).select("blob")
        new = table.join(known, "blob", "left_anti")
    # one row of each blob carries its text: the smallest path, found without moving texts
    first = new.groupBy(F.col("blob").alias("_blob")).agg(F.min("path").alias("_path"))
    texts = new.join(first, (F.col("blob") == F.col("_blob")) & F.col("path").eqNullSafe(F.col("_path")))
    found = scanned(texts.select("blob", "text"), rules).dropDuplicates(["blob"])
    found.withColumn("rules", F.lit(version)).write.mode("append").parquet(ledger)
    findings = spark.read.parquet(ledger).filter(F.col("rules") == version).select("blob", "spans").dropDuplicates(["blob"])
    return table.select("path", "blob").join(findings, "blob").select("path", "blob", "spans")


def report(findings: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """Per version: counts of the base kinds, a digest of the base spans, all spans as text."""
    shown = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    own = F.filter("spans", lambda s: s["kind"].isin(*[r.kind for r in base]))

    def count(rule: Rule) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == rule.kind)).cast("long").alias(f"n_{rule.kind}")

    counts = [count(r) for r in base]
    return findings.select(F.col("path").alias("doc_id"), *counts, F.sha2(F.array_join(F.transform(own, shown), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", shown), ",").alias("spans"))


def redacted(docs: DataFrame, ledger: str, mark: str = "[secret]", text: str = "text", path: str = "doc_id", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The documents, all columns, with every finding replaced by a mark (overlapping ones by one)."""
    column, spans = F.col(f"d.`{text}`"), F.col("f.spans")
    findings = scan(docs, ledger, rules, path, text).filter(F.size("spans") > 0).select("blob", "spans").dropDuplicates(["blob"])
    joined = docs.alias("d").join(findings.alias("f"), F.sha2(column, 256) == F.col("f.blob"), "left")
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def add(state, s):
        piece = F.concat(state["out"], F.substring(column, state["at"] + 1, s["start"] - state["at"]), F.lit(mark))
        return F.struct(F.greatest(state["at"], s["end"]).alias("at"), F.when(s["start"] >= state["at"], piece).otherwise(state["out"]).alias("out"))

    done = F.aggregate(spans, start, add)
    rest = F.concat(done["out"], F.substring(column, done["at"] + 1, F.length(column)))
    safe = F.when(spans.isNotNull(), rest).otherwise(column)
    return joined.select(*[safe.alias(c) if c == text else F.col(f"d.`{c}`") for c in docs.columns])
