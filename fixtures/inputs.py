"""Input tables of the operators, derived from the test data, nearly all with column expressions.

Every table is derived from all rows and whole texts; nested pages are built with Arrow. Ids pick *values* (coordinates, file endings, answer shapes), never rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doctables.functions.batches import slices, text_bytes
from doctables.operators.blocks import number_rows
from doctables.sinks.files import write_table_files, write_text_files
from doctables.sinks.shipped import ship_package
from doctables.sources.pages import explode_lines

LINES_PER_PAGE = 25
# Bytes of text that one task cuts up, about: its words take some twenty times as much memory where they are sorted.
TEXT_PER_TASK = 16 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str, together: bool = False) -> DataFrame:
    """Documents dealt out by a hash of their id before their texts are cut up.

    By the hash, not the id (``together``): else Spark would leave all pages of a document together in every later step. Left to itself
    Spark makes tasks by the bytes it moves, which says little of the words that come of them: with more text there are more tasks, not
    larger ones.
    """
    docs, place = table(spark, sf_dir, "documents"), F.col("doc_id") if together else F.xxhash64("doc_id")
    tasks = -(-(docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // TEXT_PER_TASK)
    return docs.repartition(place) if tasks <= spark.sparkContext.defaultParallelism else docs.repartition(tasks, place)


def _with_empty_lines(text: str) -> Column:
    """The lines of a text with an empty line behind every ninth."""
    pairs = F.transform(F.split(text, "\n"), lambda line, i: F.when(i % 9 == 8, F.array(line, F.lit(""))).otherwise(F.array(line)))
    return F.flatten(pairs)


def lines(spark, sf_dir) -> DataFrame:
    """25 lines per page; behind every ninth line an empty one."""
    docs = documents(spark, sf_dir).select("doc_id", F.array_join(_with_empty_lines("text"), "\n").alias("text"))
    return explode_lines(docs, "text", ["doc_id"], "_ln").selectExpr(
        "doc_id",
        f"int(1 + _ln div {LINES_PER_PAGE}) as page_no",
        f"_ln % {LINES_PER_PAGE} as line_no",
        "line",
    )


def words(spark, sf_dir) -> DataFrame:
    """words with coordinates; in every third line the emission order is reversed."""
    # the number of words is counted before the words are cut, so that no word row carries its whole line
    sized = lines(spark, sf_dir).selectExpr("*", "size(split(line, ' ')) as _n")
    one = sized.select("doc_id", "page_no", "line_no", "_n", F.posexplode(F.split("line", " ")).alias("_i", "text"))
    return one.filter("text <> ''").selectExpr(
        "doc_id",
        "page_no",
        "line_no",
        "bigint(line_no * 100000 + if(line_no % 3 = 0, _n - 1 - _i, _i)) as ord",
        "text",
        "((doc_id + _i) % 100) / 100d as confidence",
        "double(_i * 40 + _i div 4 * 76 + (doc_id + line_no * 3 + _i * 7) % 23) as x",
        "double(line_no * 30 + (doc_id * 7 + line_no * 13 + _i * 5) % 11) as y",
        "double(line_no * 12 + (doc_id * 7 + line_no * 5 + _i * 2) % 9) as y_drift",
    )


def boxes(spark, sf_dir) -> DataFrame:
    """F2 in its four-corner form."""
    corners = ", ".join(f"struct({a} as x, {b} as y)" for a, b in (("x", "y"), ("_r", "y"), ("_r", "_b"), ("x", "_b")))
    sized = words(spark, sf_dir).selectExpr("*", "x + 8 * length(text) as _r", "y + 12 as _b")
    return sized.selectExpr("doc_id", "page_no", "line_no", "ord", "text", "confidence", f"array({corners}) as bbox")


def _page_lines(lines: Column) -> Column:
    """The lines of a text as one array for each page."""
    return F.transform(
        F.sequence(F.lit(0), F.floor((F.size(lines) - 1) / LINES_PER_PAGE).cast("int")),
        lambda p: F.slice(lines, p * LINES_PER_PAGE + 1, F.lit(LINES_PER_PAGE)),
    )


def _line_items(lines: Column, make) -> Column:
    """Per line of ``lines``: its words in emission order, each turned into a struct by ``make(word, line_no)``.

    A word comes with its place, which is worked out once: ``i``, ``text``, ``x``, ``y``, ``right``, ``low``.
    """
    d = F.col("doc_id")

    def one_line(line, ln):
        words = F.transform(F.split(line, " "), lambda w, i: F.struct(w.alias("text"), i.alias("i")))
        words = F.filter(words, lambda s: s["text"] != "")

        def corner(s):
            i = s["i"]
            x = (i * 40 + F.shiftright(i, 2) * 76 + (d + ln * 3 + i * 7) % 23).cast("double")
            y = (ln * 30 + (d * 7 + ln * 13 + i * 5) % 11).cast("double")
            return F.struct(s["text"].alias("text"), i.alias("i"), x.alias("x"), y.alias("y"))

        def opposite(s):
            return F.struct(s["text"].alias("text"), s["i"].alias("i"), s["x"].alias("x"), s["y"].alias("y"), (s["x"] + 8 * F.length(s["text"])).alias("right"), (s["y"] + 12).alias("low"))

        items = F.transform(F.transform(F.transform(words, corner), opposite), lambda s: make(s, ln))
        return F.when(ln % 3 == 0, F.reverse(items)).otherwise(items)

    return F.transform(lines, one_line)


def _paged_words(spark, sf_dir, trees: bool) -> DataFrame:
    """Pages with their words nested as ``box_pages`` or ``tree_pages`` have them, built from whole slices of texts with Arrow.

    Everything stands inside, so that workers need no module of the fixtures.
    """
    ship_package(spark)
    per_page, block = LINES_PER_PAGE, 5

    def lists(items, sizes):
        return pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)), items)

    def runs(first):
        return np.diff(np.append(np.flatnonzero(first), len(first)))

    def lines_of(data, offsets):
        """Per line with the added empty ones: text, place in its text, whether it was added; per line of the texts: where it starts."""
        breaks = np.flatnonzero(data == 10)
        n = 1 + np.bincount(np.searchsorted(offsets[1:], breaks, side="right"), minlength=len(offsets) - 1)
        begins, opening = np.empty(n.sum(), np.int64), np.zeros(n.sum(), bool)
        opening[np.cumsum(n) - n] = True
        begins[opening], begins[~opening] = offsets[:-1], breaks + 1
        at = np.arange(len(begins)) - np.repeat(np.cumsum(n) - n, n)
        twice = 1 + (at % 9 == 8)
        added = np.zeros(twice.sum(), bool)
        added[(np.cumsum(twice) - 1)[twice == 2]] = True
        doc, place = np.repeat(np.repeat(np.arange(len(n)), n), twice), np.repeat(at + at // 9, twice) + added
        return doc, place, added, begins

    def pages_of(batch):
        batch = batch.filter(pc.is_valid(batch.column("text")))
        ids, (data, offsets) = batch.column("doc_id"), text_bytes(batch.column("text"))
        doc, place, added, begins = lines_of(data, offsets)
        ln = place % per_page
        held = np.concatenate(([False], (data != 32) & (data != 10), [False]))
        edge = np.zeros(len(data) + 1, bool)
        edge[offsets] = True  # words end where their text ends
        start = np.flatnonzero(held[1:] & (~held[:-1] | edge))
        end = np.flatnonzero(held[:-1] & (~held[1:] | edge))
        blanks, chars = (np.concatenate(([0], np.cumsum(x))) for x in (data == 32, (data & 0xC0) != 0x80))
        line = np.searchsorted(begins, start, side="right") - 1
        i = blanks[start] - blanks[begins[line]]
        line = np.flatnonzero(~added)[line]
        words = np.bincount(line, minlength=len(ln))
        first = (np.cumsum(words) - words)[line]
        k = np.arange(len(line)) - first
        order = np.empty(len(line), np.int64)
        order[first + np.where(ln[line] % 3 == 0, words[line] - 1 - k, k)] = np.arange(len(line))
        ends = np.concatenate(([0], np.cumsum(end - start))).astype(np.int32)
        text = pa.Array.from_buffers(pa.string(), len(line), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[held[1:-1]]))]).take(pa.array(order))
        i, line, size = i[order], line[order], (chars[end] - chars[start])[order]
        missing, d, n = ids.is_null().to_numpy(zero_copy_only=False)[doc[line]], pc.fill_null(ids, 0).to_numpy()[doc[line]], ln[line]
        x = (i * 40 + (i >> 2) * 76 + np.fmod(d + n * 3 + i * 7, 23)).astype(np.float64)
        y = (n * 30 + np.fmod(d * 7 + n * 13 + i * 5, 11)).astype(np.float64)
        right, low = x + 8 * size, y + 12
        corners = [(x, y), (right, low)] if trees else [(x, y), (right, y), (right, low), (x, low)]
        points = [pa.array(np.stack(side, 1).ravel(), mask=np.repeat(missing, len(corners))) for side in zip(*corners)]
        box = lists(pa.StructArray.from_arrays(points, ["x", "y"]), np.full(len(line), len(corners)))
        confidence = pa.array(np.fmod(d + i, 100) / 100.0, mask=missing)
        if trees:
            lined = pa.StructArray.from_arrays([lists(pa.StructArray.from_arrays([text, confidence, box], ["text", "confidence", "geometry"]), words)], ["words"])
            blocks = pa.StructArray.from_arrays([lists(lined, runs(ln % block == 0))], ["lines"])
            nested = lists(blocks, -(-runs(ln == 0) // block))
        else:
            nested = lists(lists(pa.StructArray.from_arrays([box, text, confidence], ["bbox", "text", "confidence"]), words), runs(ln == 0))
        top = np.flatnonzero(ln == 0)
        return pa.RecordBatch.from_arrays([ids.take(pa.array(doc[top])), pa.array((place[top] // per_page + 1).astype(np.int32)), nested], names=["doc_id", "page_no", name])

    def made(batches):
        for batch in slices(batches, "text", 1 << 18):
            yield pages_of(batch)

    point = "array<struct<x:double,y:double>>"
    name = "blocks" if trees else "result"
    kind = f"array<struct<lines:array<struct<words:array<struct<text:string,confidence:double,geometry:{point}>>>>>>" if trees else f"array<array<struct<bbox:{point},text:string,confidence:double>>>"
    return documents(spark, sf_dir).select("doc_id", "text").mapInArrow(made, f"doc_id bigint, page_no int, {name} {kind}")


def box_pages(spark, sf_dir) -> DataFrame:
    """Pages as ``array<array<struct<bbox, text, confidence>>>``: one inner list per recogniser group (line)."""
    return _paged_words(spark, sf_dir, trees=False)


def tree_pages(spark, sf_dir) -> DataFrame:
    """Pages as block -> line -> word trees with two-corner geometry; a block holds five lines."""
    return _paged_words(spark, sf_dir, trees=True)


def _hocr_page(lines: Column) -> Column:
    """The hOCR text of a page; markup characters are escaped."""

    def make(s, ln):
        x, y, right, low = (s[n].cast("int").cast("string") for n in ("x", "y", "right", "low"))
        conf = ((F.col("doc_id") + s["i"]) % 100).cast("int").cast("string")
        safe = F.replace(F.replace(F.replace(s["text"], F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))
        span = F.concat(
            F.lit("<span class='ocrx_word' title='bbox "), F.concat_ws(" ", x, y, right, low), F.lit("; x_wconf "), conf, F.lit("'>"), safe, F.lit("</span>")
        )
        return F.struct(span.alias("span"))

    return F.array_join(F.transform(F.flatten(_line_items(lines, make)), lambda s: s["span"]), "\n")


def hocr_documents(spark, sf_dir) -> DataFrame:
    """F8: one hOCR text per document: all of its pages, each under its page mark, built inside the row of the document's texts.

    The texts of a document are brought together, not its pages: hOCR is many times as large, and stays in the task that builds it.
    """
    texts = documents(spark, sf_dir, together=True).filter("text is not null").groupBy("doc_id").agg(F.collect_list(_with_empty_lines("text")).alias("_texts"))
    pages = F.flatten(F.transform("_texts", lambda lines: F.transform(_page_lines(lines), lambda page, p: F.struct((p + 1).alias("page_no"), _hocr_page(page).alias("hocr")))))
    marked = F.transform(F.sort_array(pages), lambda p: F.concat(F.lit("<div class='ocr_page' id='page_"), p["page_no"].cast("string"), F.lit("'>\n"), p["hocr"], F.lit("\n</div>\n")))
    return texts.select("doc_id", F.concat(F.lit("<html><body>\n"), F.array_join(marked, ""), F.lit("</body></html>")).alias("hocr"))


def write_hocr(spark, sf_dir, path: str) -> None:
    """One compressed file of several pages per document, named by the document's id."""
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.lit(".txt"))
    write_text_files(hocr_documents(spark, sf_dir).select(name.alias("file_name"), F.col("hocr").alias("value")), path, dealt=True, packed=".gz")


def spaced_lines(spark, sf_dir) -> DataFrame:
    """lines with wide blanks; the page is the brand."""
    part = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = part.select(
        F.col("p_brand").alias("page"),
        "p_partkey",
        F.when(k % 9 == 0, "   ")
        .when(k % 7 == 0, F.concat(F.lit("  "), "p_name", F.lit("   "), "p_type"))
        .otherwise(F.concat("p_name", F.lit("  "), "p_type", F.lit("     "), F.col("p_size").cast("string"), F.lit("  ")))
        .alias("line"),
    )
    return number_rows(rows, ["page"], ["p_partkey"], "line_no").select("page", "line_no", "line")


def marked_lines(spark, sf_dir) -> DataFrame:
    """separators, pipe lines and plain lines; the page is the user."""
    events = table(spark, sf_dir, "events")
    e = F.col("event_id")
    text = e.cast("string")
    rows = events.select(
        F.col("user_id").alias("page"),
        "event_id",
        F.when(F.col("event_type") == "signup", "  ---+---+---")
        .when(F.col("event_type") == "error", F.concat(F.lit("plain "), text))
        .when(F.col("event_type") == "click", F.concat(F.lit("click | "), text))
        .otherwise(F.concat("event_type", F.lit(" | "), text, F.lit(" | 2013-"), (2013 + e % 5).cast("string")))
        .alias("line"),
    )
    return number_rows(rows, ["page"], ["event_id"], "line_no").select("page", "line_no", "line")


def profile(spark, sf_dir) -> DataFrame:
    """F6 profile: ink per scanline."""
    li = table(spark, sf_dir, "lineitem")
    return (
        li.groupBy(F.col("l_suppkey").alias("page_id"), (F.col("l_partkey") % 400).cast("int").alias("y"))
        .agg(F.sum(F.col("l_quantity").cast("bigint")).alias("ink"))
    )


def pixels(spark, sf_dir) -> DataFrame:
    """F6 pixels: intensity samples."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_suppkey").alias("page_id"),
        (F.col("l_partkey") % 400).cast("int").alias("y"),
        (F.col("l_quantity").cast("int") * 2 + F.when(F.col("l_returnflag") == "R", 120).otherwise(0)).cast("int").alias("v"),
    )


def edges(spark, sf_dir) -> DataFrame:
    """F6 edges: detected line angles; the pages are the orders."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_orderkey").alias("page_id"), (F.pi() / 2 + (F.col("l_discount") - 0.05)).alias("theta"))


def edge_pages(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"))


def document_files(spark, sf_dir) -> DataFrame:
    """one file per document, its name with one of several endings."""
    d = F.col("doc_id")
    ending = F.element_at(F.array(*[F.lit(s) for s in (".PDF", ".pdf", ".Pdf", ".txt", ".pdf.bak")]), (d % 5 + 1).cast("int"))
    return documents(spark, sf_dir).select("doc_id", F.concat(F.lit("in/scan."), d.cast("string"), ending).alias("path"))


def files(spark, sf_dir) -> DataFrame:
    """F7 with files that no document has: some that cannot be read, some without pages."""
    d = F.col("doc_id")
    name = lambda kind: F.concat(F.lit(f"in/{kind}."), d.cast("string"), F.lit(".pdf")).alias("path")
    docs = documents(spark, sf_dir)
    broken = docs.filter("doc_id % 31 = 6").select((-2 * d - 1).alias("doc_id"), name("broken"))
    empty = docs.filter("doc_id % 37 = 11").select((-2 * d - 2).alias("doc_id"), name("empty"))
    return document_files(spark, sf_dir).unionByName(broken).unionByName(empty)


def answer_pages(spark, sf_dir) -> DataFrame:
    """F7b page side: one page per document."""
    return documents(spark, sf_dir).select("doc_id", (1 + F.col("doc_id") % 3).cast("int").alias("page_no"), F.col("text").alias("ocr_text"))


def write_page_files(spark, sf_dir, path: str) -> None:
    """Every file of F7 as a page file: the page of its document, no page, or bytes that are no page file."""
    named = files(spark, sf_dir).select("doc_id", F.substring_index("path", "/", -1).alias("file_name"), F.col("path").contains("/broken.").alias("_broken"))
    whole = named.filter("not _broken").drop("_broken").join(answer_pages(spark, sf_dir), "doc_id", "left")
    write_table_files(whole, path)
    broken = named.filter("_broken").select("file_name", F.concat(F.lit("%PDF-1.4 cut off at "), "doc_id").alias("value"))
    write_text_files(broken, path)


def answers(spark, sf_dir) -> DataFrame:
    """F7b answers: every 17th document's answer belongs to a page that does not exist, so its real page has none."""
    d, s = F.col("doc_id"), F.col("doc_id").cast("string")
    title = F.concat(F.lit('{"title":"T'), s, F.lit('"'))
    response = (
        F.when(d % 11 == 0, title)
        .when(d % 13 == 0, F.concat(F.lit("["), title, F.lit("}]")))
        .when(d % 19 == 0, F.concat(title, F.lit("} x")))
        .when(d % 23 == 0, F.concat(title, F.lit(',"tables":"x"}')))
        .when(d % 7 == 0, F.concat(F.lit('{"content":"'), "lang", F.lit('"}')))
        .when(d % 6 == 0, F.concat(title, F.lit(',"content":"'), "lang", F.lit('","tables":[]}')))
        .otherwise(
            F.concat(
                title, F.lit(',"content":"'), "lang", F.lit(" "), "source", F.lit('","tables":[{"table_title":"A'), s,
                F.lit('","table_content":"1;2"},{"table_title":"B"}]}'),
            )
        )
    )
    page_no = F.when(d % 17 == 0, 9).otherwise(1 + d % 3).cast("int")
    answered = documents(spark, sf_dir).select("doc_id", page_no.alias("page_no"), F.lit(2).alias("attempt"), response.alias("response"))
    # every fourth page was asked twice; the first attempt does not count
    first = answered.filter("doc_id % 4 = 1").select("doc_id", "page_no", F.lit(1).alias("attempt"), F.lit('{"title":"first"}').alias("response"))
    return answered.unionByName(first)


def regions(spark, sf_dir) -> DataFrame:
    """a layout region for every tag of a web page with what follows it, each with an image payload; together they are the page."""
    pages = table(spark, sf_dir, "pages")
    regions = pages.select("page_id", F.encode("url", "UTF-8").alias("img"), F.posexplode(F.split("html", "(?=<)", -1)).alias("region_no", "res"))
    kind = F.when(F.col("res").rlike("^<h[0-9]>"), "title").when(F.col("res").rlike("^<(li>|a )"), "list").otherwise("text")
    return regions.select("page_id", "region_no", kind.alias("type"), "img", "res")
