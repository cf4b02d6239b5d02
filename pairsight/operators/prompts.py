"""What a model is asked, as relations: documents in pieces of numbered lines, a prompt for each.

A model is asked where things are, never whether they are right; what it names is looked for in the documents before it
counts for anything. Pieces have a bounded size and repeat some lines of the one before, so that a row of a table or a
sentence at the end of one piece stands whole in the next.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import numbered
from ..sources.documents import lines
from .locate import FIELD_NAMES, KEPT, ask, parse_with_model
from .structure import CELLS, DOC, Structure

#: Characters of numbered lines in a piece, and lines that it repeats from the piece before.
PIECE, OVERLAP = 24_000, 6
STRUCTURE_PROMPT = (
    "What follows are lines of a {kind}, each after its number and a bar, which aren't part of it. Say where its header fields, sections and tests are. "
    "Copy every value exactly as it is printed on the line that you name; leave out what isn't there. What can't be found again is thrown away. Judge nothing.\n"
    'Reply with JSON only: {{"fields": [{{"key": "", "value": "", "line": 0}}], "sections": [{{"number": 0, "title": "", "line": 0}}], "tests": [{{{cells}}}]}}\n'
    "Keys of fields: {keys}. Give a test's cells by the part that stands on the line you name, and its test_id with the line on which its row begins.\n\n"
)
SUGGEST_PROMPT = (
    "What follows are lines of a protocol and of the report on it, each after its number and a bar, which aren't part of them. Name differences that matter and that a check of "
    "numbers, versions, dates, sample sizes and missing tests would not see. Never say whether anything passes or fails. Quote from the lines exactly, with their numbers.\n"
    'Reply with JSON only, {limit} entries at most and none if there is nothing: {{"suggestions": [{{"scope": "a test id or document", "observation": "", "reviewer_action": "", "protocol_quote": "", "protocol_line": 0, "report_quote": "", "report_line": 0}}]}}\n\n'
)


def pieces(all_lines: DataFrame, most: int = PIECE, overlap: int = OVERLAP) -> DataFrame:
    """pair_id, doc_key, page, piece, first_line, last_line and body: a page's lines with their numbers, in pieces of about ``most`` characters that repeat ``overlap`` lines of the one before.

    A line longer than that is a piece by itself. A page's lines are put in order by one window; no piece goes on over a page.
    """
    page = [*DOC, "page"]
    shown = all_lines.select(*page, "line", numbered(F.col("line"), F.col("raw")).alias("shown"))
    before = F.sum(F.length("shown") + 1).over(Window.partitionBy(*page).orderBy("line")) - F.length("shown") - 1
    shown = shown.withColumn("own", F.floor(before / most).cast("int"))
    # a line also goes to the piece that begins within ``overlap`` lines after it
    soon = F.max("own").over(Window.partitionBy(*page).orderBy("line").rowsBetween(0, overlap))
    each = shown.withColumn("soon", soon).select(*page, "line", "shown", F.explode(F.array_distinct(F.array("own", "soon"))).alias("piece"))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "shown"))), lambda x: x["shown"]), "\n")
    return each.groupBy(*page, "piece").agg(F.min("line").alias("first_line"), F.max("line").alias("last_line"), body.alias("body"))


def structure_prompts(all_lines: DataFrame, most: int = PIECE) -> DataFrame:
    """pieces() with a prompt for the structure of each."""
    keys = ", ".join(FIELD_NAMES)
    cells = ", ".join(f'"{c}": {{"value": "", "line": 0}}' for c in CELLS)
    ask_for = lambda kind: F.lit(STRUCTURE_PROMPT.format(kind=kind, keys=keys, cells=cells))
    head = F.when(F.col("doc_key") == "report", ask_for("verification report")).otherwise(ask_for("test protocol"))
    return pieces(all_lines, most).select("*", F.concat(head, "body").alias("prompt"))


def suggestion_prompts(all_lines: DataFrame, most: int = PIECE // 2, limit: int = KEPT) -> DataFrame:
    """pair_id, protocol_piece, report_piece and prompt: one prompt for a pair of which each document is one piece.

    Of longer documents those pieces are put together that name the same test, and the first ones; tests are rows of
    T and a number.
    """
    part = pieces(all_lines.where("page = 1"), most).select(*DOC, "piece", "body")
    tests = part.select(*DOC, "piece", F.explode(F.array_distinct(F.concat(F.regexp_extract_all("body", F.lit(r"\b(T\d+)\b"), F.lit(1)), F.when(F.col("piece") == 0, F.array(F.lit(""))).otherwise(F.array())))).alias("test"))
    of = lambda key: tests.where(F.col("doc_key") == key).select("pair_id", "test", F.col("piece").alias(f"{key}_piece"))
    both = of("protocol").join(of("report"), ["pair_id", "test"]).select("pair_id", "protocol_piece", "report_piece").distinct()
    body = lambda key: part.where(F.col("doc_key") == key).select("pair_id", F.col("piece").alias(f"{key}_piece"), F.col("body").alias(key))
    both = both.join(body("protocol"), ["pair_id", "protocol_piece"]).join(body("report"), ["pair_id", "report_piece"])
    return both.select("pair_id", "protocol_piece", "report_piece", F.concat(F.lit(SUGGEST_PROMPT.format(limit=limit)), F.lit("PROTOCOL\n"), "protocol", F.lit("\n\nREPORT\n"), "report").alias("prompt"))


def model_structure(model: Callable[[str], str | dict], retries: int = 1, wait: float = 1.5, per_second: float | None = None, most: int = PIECE) -> Callable[[DataFrame], Structure]:
    """A fallback for review(): documents are asked about in pieces, and what a model names is taken where the document has it.

    Documents of which no reply can be read keep their parse errors.
    """

    def structure(documents: DataFrame) -> Structure:
        all_lines = lines(documents).where("page = 1")
        replies = ask(structure_prompts(all_lines, most), model, retries, wait, (*DOC, "page", "piece"), per_second)
        tests, named, parts, report = parse_with_model(replies, all_lines)
        return Structure(report.where("read"), tests, named, parts)

    return structure
