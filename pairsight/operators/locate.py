"""Quotations found again in documents, and suggestions from a model held to them."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import found_at, loose_pattern, strip
from ..sources.shared import by_shuffle, may_be, remove_folder, scratch, stored
from .cite import CITATIONS
from .structure import CELLS, DOC, SPANS, cell_text

#: Beginnings of words by which a suggestion would judge; such a suggestion is dropped.
VERDICTS = r"(?iU)\b(?:pass|fail|conform|non-?conform|complian|acceptab|unacceptab|approv|reject|satisf)\w*"
KEPT = 6
REPLY = "suggestions array<struct<scope:string,observation:string,reviewer_action:string,protocol_quote:string,protocol_line:int,report_quote:string,report_line:int>>"


#: Columns that a word's rest on the next line may stand beside its beginning, as the rest of a cell does.
COLUMN_SLACK = 2


WHERE = ("pair_id", "doc_key", "quote_id")
LINE = ["pair_id", "doc_key", "page", "line"]
#: Characters of the ends of neighbouring words, and of parts of a word, by which places are looked up; shorter words by one character.
GRAM = 3
#: What makes quotations the same question: they are looked for once.
ASKED = ["pair_id", "doc_key", "_q", "_hint", "_any", "_only"]
_BEST = ("way", "far", "page", "line", "start", "text", "rest_start", "rest")


def _tokens(text: Column) -> Column:
    return F.array_remove(F.split(text, r"(?U)\s+"), "")


def postings(lines: DataFrame) -> DataFrame:
    """LINE, place, token, and the tokens before and after it, empty where there is none, of every word of every line; places are counted from 1."""
    t = lines.select(*LINE, _tokens(F.col("raw")).alias("t"))
    none = F.array(F.lit(""))
    beside = F.arrays_zip(F.col("t").alias("token"), F.slice(F.concat(none, "t"), F.lit(1), F.size("t")).alias("before"), F.concat(F.slice("t", F.lit(2), F.size("t")), none).alias("after"))
    each = t.where(F.size("t") > 0).select(*LINE, F.posexplode(beside).alias("place", "x"))
    return each.select(*LINE, (F.col("place") + 1).alias("place"), "x.*")


def _join_key(a: Column, b: Column, n: int) -> Column:
    """Where two words meet: the end of the first and the beginning of the second, n characters each."""
    return F.concat(F.lit(f"{n} "), F.right(a, F.lit(n)), F.lit(" "), F.left(b, F.lit(n)))


def _after_key(before: Column, word: Column, n: int) -> Column:
    """A whole word after the end of another, n characters of it."""
    return F.concat(F.lit(f"a{n} "), F.right(before, F.lit(n)), F.lit(" "), word)


def _inner_key(words: Column) -> Column:
    """The key of the second word of a quotation, which is a word of the line as it is, after the first, which may begin within one."""
    return F.when(F.length(words[0]) >= GRAM, _after_key(words[0], words[1], GRAM)).otherwise(_after_key(words[0], words[1], 1))


def _hyphen_key(word: Column) -> Column:
    return F.concat(F.lit("- "), F.right(word, F.lit(2)))


def _pair_key(words: Column) -> Column:
    """The key of the first two words of a quotation, of which the first may begin, and the second end, within words of the line."""
    a, b = words[0], words[1]
    long = (F.length(a) >= GRAM) & (F.length(b) >= GRAM)
    return F.when(long, _join_key(a, b, GRAM)).otherwise(_join_key(a, b, 1))


def _part_key(part: Column) -> Column:
    return F.concat(F.lit("p "), part)


def _parts(token: Column) -> Column:
    """All parts of a word by which a quotation of one word is looked up."""
    return F.array_distinct(F.concat(F.regexp_extract_all(token, F.lit(rf"(?s)(?=(.{{{GRAM}}}))"), F.lit(1)), F.regexp_extract_all(token, F.lit("(?s)."), F.lit(0))))


def _key_hash(key: Column) -> Column:
    return F.xxhash64("pair_id", "doc_key", key)


def _line_hash(line: Column) -> Column:
    return F.xxhash64("pair_id", "doc_key", "page", line.cast("long"))


def _places(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """postings() with key, a row for each key that may be wanted in its document: words after the end of another, words that meet, ends in a hyphen, parts of words. wanted: pair_id, doc_key and key.

    A table of bits tells at each word which of its keys may be wanted, so that words are never shuffled to find out; what
    is joined to places later is joined by the keys themselves. Parts of words are made only in documents that are asked for any.
    """
    may = may_be(wanted.select(_key_hash(F.col("key")).alias("h")))
    asked = may_be(wanted.where(F.col("key").startswith("p ")).select(F.xxhash64("pair_id", "doc_key").alias("h")))
    meets = lambda n: (F.col("after") != "") & (F.length("token") >= n) & (F.length("after") >= n)
    follows = lambda n: (_after_key(F.col("before"), F.col("token"), n), F.length("before") >= n)
    kinds = (follows(GRAM), follows(1), (_join_key(F.col("token"), F.col("after"), GRAM), meets(GRAM)), (_join_key(F.col("token"), F.col("after"), 1), meets(1)), (_hyphen_key(F.col("token")), F.col("token").endswith("-")))
    place = [*LINE, "place", "token", "before", "after"]
    each = postings(lines).select(*place, F.explode(F.array(*(F.when(has, key) for key, has in kinds))).alias("key"))
    parts = postings(lines.where(asked(F.xxhash64("pair_id", "doc_key")))).select(*place, F.explode(_parts(F.col("token"))).alias("part"))
    # exploded before bits are read, so that each key is hashed in one place of the plan
    return each.unionByName(parts.select(*place, _part_key(F.col("part")).alias("key"))).where("key IS NOT NULL").where(may(_key_hash(F.col("key"))))


def _anchored(q: DataFrame, places: DataFrame) -> DataFrame:
    """Quotations with LINE, where their first word may be on one line: of three words and more by the second, which is a word of the line as it is, and the end of the first, of two by how they meet, of one by a part of it."""
    on = ["pair_id", "doc_key"]
    w = F.col("words")
    # the words beside it tell most places apart before any line is read
    many = q.where(F.size("words") > 2).select(*WHERE, "words", _inner_key(w).alias("key"))
    third = F.when(F.size("words") == 3, F.col("after").startswith(w[2])).otherwise(F.col("after") == w[2])
    of_many = many.join(by_shuffle(places), [*on, "key"]).where((F.col("token") == w[1]) & F.col("before").endswith(w[0]) & third).select(*WHERE, *LINE[2:])
    two = q.where(F.size("words") == 2).select(*WHERE, "words", _pair_key(w).alias("key"))
    of_two = two.join(by_shuffle(places), [*on, "key"]).where(F.col("token").endswith(w[0]) & F.col("after").startswith(w[1])).select(*WHERE, *LINE[2:])
    one = q.where(F.size("words") == 1).select(*WHERE, F.col("words")[0].alias("w"), _own_part(F.col("words")[0]).alias("key"))
    of_one = one.join(by_shuffle(places), [*on, "key"]).where(F.contains("token", "w")).select(*WHERE, *LINE[2:])
    return of_many.unionByName(of_two).unionByName(of_one).distinct()


def _own_part(word: Column) -> Column:
    """The key by which a quotation of one word is looked up."""
    return _part_key(F.left(word, F.when(F.length(word) >= GRAM, GRAM).otherwise(1)))


def _with_line(at: DataFrame, lines: DataFrame) -> DataFrame:
    """at with raw and its words, t, and chunks, the words with the white space before them."""
    both = at.join(by_shuffle(lines.select(*LINE, "raw")), LINE)
    chunks = F.regexp_extract_all("raw", F.lit(r"(?U)\s*\S+"), F.lit(0))
    # generated, so that they are made once for all that reads them
    return both.select("*", F.inline(F.array(F.struct(_tokens(F.col("raw")).alias("t"), chunks.alias("chunks")))))


def _begin(chunks: Column, t: Column, place: Column) -> Column:
    """The column at which a line's word begins."""
    return F.length(F.array_join(F.slice(chunks, F.lit(1), place), "")) - F.length(F.get(t, place - 1))


def _run_starts(t: Column, place: Column, words: Column) -> Column:
    """Whether words stand in t from a place on; the first may begin, the last may end, within a word of t."""
    n = F.size(words)
    first, last = F.get(t, place - 1), F.get(t, place + n - 2)
    inner = F.slice(t, place + 1, F.greatest(n - 2, F.lit(0))) == F.slice(words, F.lit(2), F.greatest(n - 2, F.lit(0)))
    return F.coalesce(F.when(n == 1, first.contains(words[0])).otherwise(first.endswith(words[0]) & last.startswith(F.element_at(words, -1)) & inner), F.lit(False))


def _start(chunks: Column, t: Column, place: Column, words: Column) -> Column:
    token, first = F.get(t, place - 1), words[0]
    within = F.when(F.size(words) == 1, F.call_function("instr", token, first) - 1).otherwise(F.length(token) - F.length(first))
    return _begin(chunks, t, place) + within


def _end(chunks: Column, t: Column, place: Column, words: Column) -> Column:
    n = F.size(words)
    return F.when(n == 1, _start(chunks, t, place, words) + F.length(words[0])).otherwise(_begin(chunks, t, place + n - 1) + F.length(F.element_at(words, -1)))


def locate(quotes: DataFrame, lines: DataFrame) -> DataFrame:
    """quotes with page, line, start, end and text of their place, and ``rest_start`` and ``rest`` of what goes on in the next line; null where they aren't in the document.

    quotes: pair_id, doc_key, quote_id, quote and hint, the line where it is thought to be; where there is a column
    only_page that isn't null, only that page counts. White space may differ. The hinted line comes first, else the first
    one. A quotation on no line is looked for in two: a word that a hyphen breaks may go on in the next line in the same
    column, where the hyphen is the last of its cell; else from some word on the quotation may go on anywhere in the next
    line, and the place with the longest first part counts. Quotations meet lines by words or parts of them, never a whole
    document.
    """
    spark, work = quotes.sparkSession, scratch(quotes.sparkSession)
    only = F.col("only_page").cast("int") if "only_page" in quotes.columns else F.lit(None).cast("int")
    columns = quotes.columns
    quotes = quotes.withColumns({"_q": strip(F.col("quote")), "_hint": F.coalesce(F.col("hint").cast("long"), F.lit(0).cast("long")), "_any": only.isNull(), "_only": F.coalesce(only, F.lit(0))})
    q = stored(quotes.where("_q <> ''").groupBy(*ASKED).agg(F.min("quote_id").alias("quote_id")).withColumn("words", _tokens(F.col("_q"))), work)
    on = ["pair_id", "doc_key"]
    match = lambda text, pattern: F.call_function("regexp_substr", text, pattern)
    none = F.lit(None)
    here = F.col("_any") | (F.col("page") == F.col("_only"))
    best = lambda df: df.groupBy(*WHERE).agg(F.min(F.struct(*_BEST)).alias("b"))

    n, words = F.size("words"), F.col("words")
    hyphens = F.regexp_extract_all("_q", F.lit("(?s)(?=((?<=[0-9A-Za-z])-(?=[0-9A-Za-z]).*))-"), F.lit(1))
    # the beginnings of a quotation that end in one of its hyphens
    heads = F.transform(hyphens, lambda tail: F.substring("_q", F.lit(1), F.length("_q") - F.length(tail) + 1))
    inner = F.when(n > 2, F.array(_inner_key(words))).otherwise(F.array())
    keys = F.array_distinct(F.concat(inner, F.when((n == 2) | (n > 3), F.array(_pair_key(words))).otherwise(F.array()), F.when(n == 1, F.array(_own_part(words[0]))).otherwise(F.array()), F.transform(heads, _hyphen_key)))
    wanted = stored(q.select(*on, F.explode(keys).alias("key")), work)
    places = stored(_places(lines, wanted), work)
    t, chunks, place = F.col("t"), F.col("chunks"), F.col("place")
    # nearly all lines that are left have the quotation, so the pattern is run once for each
    pattern = loose_pattern(F.col("_q"))
    at = stored(_anchored(q, places), work)
    held = may_be(at.select(_line_hash(F.col("line")).alias("h")))
    one = at.join(by_shuffle(q.select(*WHERE, "_hint", "_any", "_only", "_q")), list(WHERE)).where(here).join(by_shuffle(lines.where(held(_line_hash(F.col("line")))).select(*LINE, "raw")), LINE)
    one = one.select(*WHERE, "page", "line", "_hint", F.inline(F.array(F.struct(match("raw", pattern).alias("text"), found_at("raw", pattern).alias("start"))))).where("text IS NOT NULL")
    one = one.select(*WHERE, F.lit(0).alias("way"), (F.col("line") != F.col("_hint")).cast("int").alias("far"), "page", "line", "start", "text", none.cast("int").alias("rest_start"), none.cast("string").alias("rest"))
    one = stored(best(one), work)
    # only what is on no line is held against two
    left = stored(q.join(by_shuffle(one), list(WHERE), "left_anti"), work)

    broken = left.select(*WHERE, "_any", "_only", "_q", F.posexplode(hyphens).alias("_m", "_tail")).withColumn("_tail", F.substring("_tail", F.lit(2), F.length("_tail")))
    broken = broken.withColumn("_head", F.substring("_q", F.lit(1), F.length("_q") - F.length("_tail")))
    broken = broken.withColumn("_last", F.element_at(_tokens(F.col("_head")), -1)).withColumn("key", _hyphen_key(F.col("_head")))
    long = left.where(F.size("words") >= 4).select(*WHERE, "_any", "_only", "words", _pair_key(F.col("words")).alias("key"))
    sought = may_be(broken.select(*on, "key").unionByName(long.select(*on, "key")).select(_key_hash(F.col("key")).alias("h")))
    places = places.where(sought(_key_hash(F.col("key"))))
    broken = stored(broken.join(by_shuffle(places.select(*LINE, "token", "key")), [*on, "key"]).where(F.col("token").endswith(F.col("_last")) & here).drop("token", "key", "_last").distinct(), work)
    cut = stored(long.join(by_shuffle(places), [*on, "key"]).where(here & F.col("token").endswith(words[0]) & F.col("after").startswith(words[1])).select(*WHERE, "words", *LINE[2:], "place"), work)
    first = broken.select(*LINE).unionByName(cut.select(*LINE))
    held2 = may_be(first.select(F.explode(F.array(_line_hash(F.col("line")), _line_hash(F.col("line") + 1))).alias("h")))
    near = stored(lines.where(held2(_line_hash(F.col("line")))).select(*LINE, "raw"), work)
    after = near.select("pair_id", "doc_key", "page", (F.col("line") - 1).alias("line"), F.col("raw").alias("after"))

    head, tail = loose_pattern(F.col("_head")), loose_pattern(F.col("_tail"))
    broken = broken.join(by_shuffle(near), LINE).join(by_shuffle(after), LINE)
    broken = broken.where(F.regexp_like("raw", head)).withColumn("_at", found_at("raw", head)).withColumn("_text", match("raw", head))
    last = F.col("_at") + F.length("_text")
    broken = broken.where(F.trim(F.substring("raw", last + 1, F.lit(1))) == "")
    low = F.greatest(F.col("_at") - COLUMN_SLACK, F.lit(0))
    window = F.concat(F.lit(rf"(?s)^.{{0,{2 * COLUMN_SLACK}}}?"), tail)
    rest = F.substring("after", low + 1, F.length("after"))
    begin = low + F.length(match(rest, window)) - F.length(match(match(rest, window), F.concat(tail, F.lit("$"))))
    broken = broken.where(F.regexp_like(rest, window)).withColumn("_rest_at", begin).where(F.abs(F.col("_rest_at") - F.col("_at")) <= COLUMN_SLACK)
    broken = broken.select(*WHERE, F.lit(1).alias("way"), F.col("_m").alias("far"), "page", "line", F.col("_at").cast("int").alias("start"), F.col("_text").alias("text"), F.col("_rest_at").cast("int").alias("rest_start"), match(rest, tail).alias("rest"))

    cut = _with_line(cut.join(by_shuffle(after), LINE), near).select("*", F.inline(F.array(F.struct(_tokens(F.col("after")).alias("t2")))))
    t2 = F.col("t2")
    part = lambda k: F.slice(words, F.lit(1), k)
    others = lambda k: F.slice(words, k + 1, n - k)
    rests = lambda k: F.filter(F.sequence(F.lit(1), F.size(t2)), lambda j: _run_starts(t2, j, others(k)))
    splits = F.filter(F.sequence(n - 1, F.lit(2), F.lit(-1)), lambda k: _run_starts(t, place, part(k)) & (F.size(rests(k)) > 0))
    cut = cut.where(F.size("t2") > 0).select("*", F.inline(F.array(F.struct(F.try_element_at(splits, F.lit(1)).alias("k"))))).where("k IS NOT NULL")
    cut = cut.select("*", F.inline(F.array(F.struct(F.regexp_extract_all("after", F.lit(r"(?U)\s*\S+"), F.lit(0)).alias("chunks2"), rests(F.col("k"))[0].alias("j"), part(F.col("k")).alias("w1"), others(F.col("k")).alias("w2")))))
    w1, w2, j, chunks2 = (F.col(c) for c in ("w1", "w2", "j", "chunks2"))
    cut = cut.select(*WHERE, "k", "page", "line", "raw", "after", _start(chunks, t, place, w1).alias("start"), _end(chunks, t, place, w1).alias("end"), _start(chunks2, t2, j, w2).alias("rest_start"), _end(chunks2, t2, j, w2).alias("rest_end"))
    cut = cut.select(*WHERE, F.lit(2).alias("way"), (-F.col("k")).alias("far"), "page", "line", "start", F.substring("raw", F.col("start") + 1, F.col("end") - F.col("start")).alias("text"), "rest_start", F.substring("after", F.col("rest_start") + 1, F.col("rest_end") - F.col("rest_start")).alias("rest"))

    found = one.unionByName(best(broken.unionByName(cut))).join(by_shuffle(q.select(*ASKED, "quote_id")), list(WHERE))
    found = stored(found.select(*ASKED, "b.page", "b.line", "b.start", (F.col("b.start") + F.length("b.text")).alias("end"), "b.text", "b.rest_start", "b.rest"), scratch(spark))
    remove_folder(spark, work)
    return quotes.join(by_shuffle(found), ASKED, "left").select(*WHERE, *(c for c in columns if c not in WHERE), "page", "line", "start", "end", "text", "rest_start", "rest")


def spans_of(doc: Column) -> Column:
    """SPANS of a located quotation, one for each line."""
    span = lambda line, start, text: F.struct(doc.alias("doc"), F.col("page").cast("int").alias("page"), line.cast("int").alias("line"), start.cast("int").alias("start"), (start + F.length(text)).cast("int").alias("end"), text.alias("text"))
    here, beyond = span(F.col("line"), F.col("start"), F.col("text")), span(F.col("line") + 1, F.col("rest_start"), F.col("rest"))
    return F.when(F.col("rest").isNotNull(), F.array(here, beyond)).when(F.col("line").isNotNull(), F.array(here)).otherwise(F.array()).cast(SPANS)


def parse_reply(reply: Column, schema: str = REPLY) -> Column:
    """A model's reply as a struct: a fenced block, the text itself or its widest braces; null where none is such JSON."""
    fenced = F.nullif(F.regexp_extract(reply, r"(?s)```(?:json)?\s*(.*?)```", 1), F.lit(""))
    braces = F.nullif(F.regexp_extract(reply, r"(?s)\{.*\}", 0), F.lit(""))
    read = lambda t: F.from_json(t, schema, {"mode": "PERMISSIVE"})
    first = schema.split()[0]
    usable = lambda t: F.when(read(t)[first].isNotNull(), read(t))
    return F.coalesce(usable(fenced), usable(reply), usable(braces))


def scope(text: Column) -> Column:
    return F.when(text.rlike(r"(?iU)^(T\d+|document)$"), F.when(F.lower(text) == "document", "document").otherwise(F.upper(text))).otherwise("document")


#: What a suggestion that doesn't say what to do is shown with.
LOOK = "Read what is quoted and decide whether the difference matters."


def suggestions(replies: DataFrame, lines: DataFrame, limit: int = KEPT) -> tuple[DataFrame, DataFrame]:
    """Suggestions kept (pair_id, id, scope, observation, action, places and citations), and notes (pair_id, ord, note) on what was dropped. replies: pair_id and reply.

    A suggestion is dropped if its observation uses the language of a verdict, or if none of its quotations is in its
    document; a quotation that isn't there is dropped from a suggestion that has another. Suggestions without an observation
    count for nothing. Of the rest the first ``limit`` of a pair stay, in the reply's order, and nothing after them is
    noted. A reply that can't be read has a note of its own, at ord -1; a null one is left out.
    """
    parsed = stored(replies.select("pair_id", F.col("reply").isNotNull().alias("said"), parse_reply(F.col("reply")).alias("r")), scratch(lines.sparkSession))
    each = parsed.select("pair_id", F.posexplode("r.suggestions").alias("ord", "s")).where(strip(F.coalesce("s.observation", F.lit(""))) != "")
    quoted = lambda key: each.select("pair_id", F.lit(key).alias("doc_key"), F.col("ord").alias("quote_id"), F.col(f"s.{key}_quote").alias("quote"), F.col(f"s.{key}_line").alias("hint"))
    wanted = quoted("protocol").unionByName(quoted("report")).where(strip(F.coalesce("quote", F.lit(""))) != "")
    found = locate(wanted, lines).withColumn("spans", spans_of(F.col("doc_key")))
    place = F.struct("doc_key", "page", "line", "start", "end", "text", "rest_start", "rest", "spans")
    places = found.groupBy("pair_id", F.col("quote_id").alias("ord")).agg(F.array_sort(F.collect_list(F.when(F.col("line").isNotNull(), place))).alias("places"), F.array_sort(F.collect_list(F.when(F.col("line").isNull(), F.col("doc_key")))).alias("lost"))
    each = each.join(by_shuffle(places), ["pair_id", "ord"], "left")
    why = F.when(F.col("s.observation").rlike(VERDICTS), "verdict language").when(F.coalesce(F.size("places"), F.lit(0)) < 1, "quotation not found")
    each = each.withColumn("why", why)
    n = F.count(F.when(F.col("why").isNull(), 1)).over(Window.partitionBy("pair_id").orderBy("ord"))
    each = each.withColumn("n", n).where((F.col("n") < limit) | (F.col("why").isNull() & (F.col("n") == limit)))
    cites = F.transform("places", lambda x: F.struct(x["doc_key"].alias("doc"), F.lit("quoted by the model").alias("note"), x["spans"].alias("spans"))).cast(CITATIONS)
    action = F.coalesce(F.nullif(strip(F.col("s.reviewer_action")), F.lit("")), F.lit(LOOK))
    kept = each.where("why IS NULL").select("pair_id", F.format_string("AI-%03d", "n").alias("id"), scope(F.col("s.scope")).alias("scope"), strip(F.col("s.observation")).alias("observation"), action.alias("action"), F.transform("places", lambda x: x.dropFields("spans")).alias("places"), cites.alias("citations"))
    unread = parsed.where("said AND r IS NULL").select("pair_id", F.lit(-1).alias("ord"), F.lit("the reply can't be read").alias("note"))
    partly = each.where("why IS NULL").select("pair_id", "ord", F.explode("lost").alias("doc")).select("pair_id", "ord", F.concat("doc", F.lit(" quotation not found")).alias("note"))
    return kept, each.where("why IS NOT NULL").select("pair_id", "ord", F.col("why").alias("note")).unionByName(partly).unionByName(unread)


_VALUE = "struct<value:string,line:int>"
PARSED = f"tests array<struct<{','.join(f'{c}:{_VALUE}' for c in CELLS)}>>, fields array<struct<key:string,value:string,line:int>>, sections array<struct<number:int,title:string,line:int>>"
#: Header fields that a reply may name, in lower case, as they are called here.
FIELD_NAMES = {
    "document": "Document", "title": "Title", "version": "Version", "effective": "Effective", "date": "Date", "verifies protocol": "Verifies protocol",
    "test equipment": "Test equipment", "revision": "Revision", "testing performed": "Testing performed",
}


def parse_with_model(replies: DataFrame, lines: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Test rows, header fields and sections that a model's replies name and that documents really have, and a report of each document.

    replies: pair_id, doc_key and reply, JSON of tests, fields and sections with texts and the lines where they are thought
    to be; several replies on a document, of which page and piece give the order, count as one. Every text is looked for on
    the document's first page, or on the page of its reply, and taken as it stands there; what isn't found is dropped and
    listed. A test or section that two replies have at the same place counts once, the one with more cells. Test rows are as tables() gives them: cells of other names and empty ones don't count, and a row without a found test_id is
    dropped, as nothing could be joined to it. Fields of other names are dropped; sections end where the next one begins.
    """
    part = [F.coalesce(c, F.lit(d)).alias(c) if c in replies.columns else F.lit(d).alias(c) for c, d in (("page", 1), ("piece", 0))]
    folder = scratch(lines.sparkSession)
    read = stored(replies.select(*DOC, *part, parse_reply(F.col("reply"), PARSED).alias("r")), folder)
    in_order = F.row_number().over(Window.partitionBy(*DOC).orderBy("page", "piece", "at")) - 1
    each = lambda kind: read.select(*DOC, "page", "piece", F.posexplode(f"r.{kind}").alias("at", "x")).select(*DOC, F.col("page").alias("only_page"), in_order.alias("ord"), "x")
    name = lambda kind, *parts: F.concat_ws(":", F.lit(kind), *(p.cast("string") for p in parts))
    cells = each("tests").select(*DOC, "ord", "only_page", F.inline(F.array(*(F.struct(F.lit(c).alias("cell"), F.col(f"x.{c}.value").alias("quote"), F.col(f"x.{c}.line").alias("hint")) for c in CELLS))))
    fields = each("fields").where(F.lower(F.trim("x.key")).isin(*FIELD_NAMES))
    wanted = cells.select(*DOC, name("test", F.col("ord"), F.col("cell")).alias("quote_id"), "quote", "hint", "only_page")
    wanted = wanted.unionByName(fields.select(*DOC, name("field", F.col("ord")).alias("quote_id"), F.col("x.value").alias("quote"), F.col("x.line").alias("hint"), "only_page"))
    wanted = wanted.unionByName(each("sections").select(*DOC, name("section", F.col("ord")).alias("quote_id"), F.col("x.title").alias("quote"), F.col("x.line").alias("hint"), "only_page"))
    page = stored(lines.join(by_shuffle(read.select(*DOC, "page").distinct()), [*DOC, "page"], "left_semi"), folder)
    found = stored(locate(wanted.where(strip(F.col("quote")) != ""), page), folder).withColumn("spans", spans_of(F.col("doc_key"))).withColumn("id", F.split("quote_id", ":"))
    there = found.where("line IS NOT NULL")

    rows = there.where(F.col("id")[0] == "test").select(*DOC, F.col("id")[1].cast("int").alias("ord"), F.col("id")[2].alias("cell"), "spans", cell_text(F.transform("spans", lambda s: s["text"])).alias("text"))
    rows = rows.groupBy(*DOC, "ord").agg(*(F.coalesce(F.max(F.when(F.col("cell") == c, F.col("text"))), F.lit("")).alias(c) for c in CELLS), F.map_from_entries(F.collect_list(F.struct("cell", "spans"))).alias("spans")).where("test_id <> ''")
    at = F.try_element_at("spans", F.lit("test_id"))[0]
    twice = F.row_number().over(Window.partitionBy(*DOC, at["page"], at["line"], at["start"]).orderBy(F.desc(F.size("spans")), "ord"))
    rows = rows.withColumn("twice", twice).where("twice = 1")
    rows = rows.select(*DOC, F.row_number().over(Window.partitionBy(*DOC).orderBy("ord")).alias("row_ord"), *(F.upper(c).alias(c) if c == "test_id" else c for c in CELLS), "spans")

    label = F.create_map(*(F.lit(x) for kv in FIELD_NAMES.items() for x in kv))
    one_line = there.where(F.col("rest").isNull())
    named = one_line.where(F.col("id")[0] == "field").withColumn("ord", F.col("id")[1].cast("int")).join(by_shuffle(fields.select(*DOC, "ord", F.try_element_at(label, F.lower(F.trim("x.key"))).alias("key"))), [*DOC, "ord"])
    named = named.withColumn("n", F.row_number().over(Window.partitionBy(*DOC, "key").orderBy(F.desc("ord")))).where("n = 1").select(*DOC, "key", F.col("text").alias("value"), "page", "line", F.col("spans")[0].alias("span"))

    w = Window.partitionBy(*DOC).orderBy("ord")
    last = page.groupBy(*DOC, "page").agg(F.max("line").alias("last"))
    parts = one_line.where(F.col("id")[0] == "section").withColumn("ord", F.col("id")[1].cast("int")).join(by_shuffle(each("sections").select(*DOC, "ord", F.col("x.number").alias("given"))), [*DOC, "ord"]).join(by_shuffle(last), [*DOC, "page"])
    parts = parts.withColumn("twice", F.row_number().over(Window.partitionBy(*DOC, "page", "line", "start").orderBy("ord"))).where("twice = 1")
    parts = parts.select(*DOC, F.coalesce("given", F.row_number().over(w)).alias("number"), F.col("text").alias("title"), "page", F.col("line").alias("start"), F.coalesce(F.when(F.lead("page").over(w) == F.col("page"), F.lead("line").over(w)), F.col("last") + 1).alias("end"))

    n = lambda kind: F.count_if((F.col("id")[0] == kind) & F.col("line").isNotNull())
    lost = F.array_sort(F.collect_list(F.when(F.col("line").isNull(), F.concat("quote_id", F.lit(": "), F.substring("quote", 1, 80)))))
    report = found.groupBy(*DOC).agg(n("field").alias("fields_found"), F.count_if(F.col("line").isNotNull()).alias("located"), F.count_if(F.col("line") != F.col("hint")).alias("hints_corrected"), lost.alias("discarded"))
    # where no test has a place the table would begin at the first line
    tests = rows.groupBy(*DOC).agg(F.count("*").alias("tests_found"), F.min(F.try_element_at("spans", F.lit("test_id"))[0]["line"]).alias("header_line"))
    report = read.groupBy(*DOC).agg(F.max(F.col("r").isNotNull()).alias("read")).join(by_shuffle(report), DOC, "left").join(by_shuffle(tests), DOC, "left").fillna(0, ["fields_found", "located", "hints_corrected", "tests_found"]).fillna(1, ["header_line"])
    return rows, named, parts, report


class ModelRefused(RuntimeError):
    """A call that no other attempt can mend: a key that isn't accepted, a model that isn't there."""


def ask(prompts: DataFrame, model: Callable[[str], str | dict], retries: int = 1, wait: float = 1.5, keys: tuple[str, ...] = ("pair_id",), per_second: float | None = None) -> DataFrame:
    """keys, reply, error, attempts, prompt_tokens and completion_tokens for each prompt. model is called by tasks, by each at most per_second times a second.

    A call that raises is made again up to ``retries`` times, each time after a longer wait, unless it raises ModelRefused;
    what fails in the end gives an error, not a failed job. model returns a text, or a dict with content and usage.
    """

    columns = [*keys, "reply", "error", "attempts", "prompt_tokens", "completion_tokens"]

    def call(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        next_call = time.monotonic()
        for pdf in it:
            out = []
            for *key, prompt in pdf[[*keys, "prompt"]].itertuples(index=False, name=None):
                for attempt in range(1, retries + 2):
                    if per_second:
                        time.sleep(max(0.0, next_call - time.monotonic()))
                        next_call = max(next_call, time.monotonic()) + 1 / per_second
                    try:
                        got = model(prompt)
                        got = got if isinstance(got, dict) else {"content": got}
                        used = got.get("usage") or {}
                        out.append((*key, got.get("content") or "", None, attempt, int(used.get("prompt_tokens") or 0), int(used.get("completion_tokens") or 0)))
                        break
                    except Exception as e:  # noqa: BLE001  whatever a model's client raises
                        if attempt > retries or isinstance(e, ModelRefused):
                            out.append((*key, None, f"{type(e).__name__}: {e}"[:400], attempt, 0, 0))
                            break
                        time.sleep(wait * attempt)
            yield pd.DataFrame(out, columns=columns)

    kinds = ", ".join(f"{k} {prompts.schema[k].dataType.simpleString()}" for k in keys)
    return prompts.select(*keys, "prompt").mapInPandas(call, f"{kinds}, reply string, error string, attempts int, prompt_tokens long, completion_tokens long")


def usage(replies: DataFrame) -> DataFrame:
    """calls, prompt_tokens and completion_tokens over all replies that came."""
    return replies.where("error IS NULL").agg(F.count("*").alias("calls"), F.coalesce(F.sum("prompt_tokens"), F.lit(0)).alias("prompt_tokens"), F.coalesce(F.sum("completion_tokens"), F.lit(0)).alias("completion_tokens"))
