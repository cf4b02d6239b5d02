"""I-Match document fingerprints over several randomised lexicons.

A term belongs to the lexicon if its inverse document frequency lies in a band: terms of nearly every document say
nothing, and terms rarer than a share of all documents are noise. The share also bounds the lexicon: with d different
terms in the mean document, no more than d / LEAST_SHARE terms can reach it, however large the corpus.

Each of the views is a random subset of the lexicon, drawn for each view by bits of a term's hash, and gives one hash of a
document's sorted terms in it; subsets overlap. COARSE views keep three quarters of the lexicon each, so two of them
share some nine sixteenths of it: one that agrees means nearly the same terms. FINE views keep one term in 64, views
next to each other half of it in common: they go on agreeing when a part of a text is replaced, and so measure how much
is left. A document with none of the lexicon's terms is described by all of its terms, and is like another as far as
those agree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, let

TERM = r"[\p{L}\p{N}]+"
#: Document frequencies, as shares of all documents, between which a term counts.
LEAST_SHARE, MOST_SHARE = 0.001, 0.2
#: Bits of the table that tells whether a term is in the lexicon, as a power of two. A term outside that has the place of one inside counts as inside, in every text.
TABLE_BITS = 24
#: The column that holds it while fingerprints are made.
BITS = "_lexicon_bits"
COARSE, FINE = 8, 40
#: Bits of a term's hash that a coarse view needs not to be all clear, and a fine view to be all clear.
MASKS = (*((3 << 2 * k, False) for k in range(COARSE)), *((63 << k, True) for k in range(2 * COARSE, 2 * COARSE + FINE)))
#: Documents next to each other in order of id that are handled together, about, in so many runs at most.
RUN, MOST_RUNS = 2000, 1 << 16
#: Cuts between runs that are looked at together.
GROUP = 256


def terms(text: Column) -> Column:
    """The different terms of a text as sorted 64-bit hashes."""
    words = F.regexp_extract_all(F.lower(text), F.lit(TERM), F.lit(0))
    return F.array_sort(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, text: str = "text", least: float = LEAST_SHARE, most: float = MOST_SHARE) -> DataFrame:
    """The lexicon as one row: an array of longs with a bit set for the place of each term in the band.

    Document frequencies are counted over all rows, for each term by itself. A term in a single row is in no lexicon unless that row is all there is.
    """
    n = docs.count()
    df = docs.select(F.explode(terms(F.coalesce(F.col(text), F.lit("")))).alias("t")).groupBy("t").agg(F.count("*").alias("df"))
    band = df.where((F.col("df") >= max(2 if n > 1 else 1, least * n)) & (F.col("df") <= max(1, most * n)))
    slot = F.col("t").bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
    bits = band.select(F.shiftright(slot, 6).cast("int").alias("i"), F.call_function("shiftleft", F.lit(1).cast("long"), slot.bitwiseAND(F.lit(63)).cast("int")).alias("b"))
    every = docs.sparkSession.range((1 << TABLE_BITS) // 64).select(F.col("id").cast("int").alias("i"), F.lit(0).cast("long").alias("b"))
    words = bits.unionByName(every).groupBy("i").agg(F.bit_or("b").alias("b"))
    return words.agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "b"))), lambda x: x["b"]).alias("lexicon"))


def in_lexicon(all_terms: Column, bits: Column) -> Column:
    def known(t: Column) -> Column:
        slot = t.bitwiseAND(F.lit((1 << TABLE_BITS) - 1))
        return F.call_function("shiftright", F.get(bits, F.shiftright(slot, 6).cast("int")), slot.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1

    return let(F.filter(all_terms, known), lambda k: F.when(F.size(k) == 0, all_terms).otherwise(k))


def views(known: Column) -> Column:
    """The 31-bit hash of each view's terms, in order; 0 for a view without any."""
    placed = F.transform(known, lambda t: F.struct(F.xxhash64(t, F.lit("view")).alias("h"), t.alias("t")))

    def one(placed: Column, mask: int, clear: bool) -> Column:
        held = lambda x: x["h"].bitwiseAND(F.lit(mask)) == 0
        mine = F.transform(F.filter(placed, held if clear else lambda x: ~held(x)), lambda x: x["t"])
        return let(mine, lambda m: F.when(F.size(m) == 0, 0).otherwise(F.greatest(F.xxhash64(m).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int"), F.lit(1))))

    return let(placed, lambda p: F.array(*(one(p, *m) for m in MASKS)))


def with_fingerprint(docs: DataFrame, bits: Column, text: str, name: str) -> DataFrame:
    """docs and a column with the hashes of a text's views. Texts that are equal have equal ones; a null text is empty and has none. A column of that name is replaced; rows that repeat get the same."""
    all_terms = terms(F.coalesce(F.col(f"`{text}`"), F.lit("")))
    return docs.withColumn(BITS, bits).withColumn(name, views(let(all_terms, lambda t: in_lexicon(t, F.col(BITS))))).drop(BITS)


def likeness(a: Column, b: Column) -> Column:
    """The share of views with the same terms, of those with any; 1 where neither has any."""
    both = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), -1).when(x == y, 1).otherwise(0))
    count = lambda z, least: F.size(F.filter(z, lambda x: x >= least))
    return let(both, lambda z: F.when(count(z, 0) == 0, F.lit(1.0)).otherwise(count(z, 1) / count(z, 0)))


def hex_string(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def with_next(docs: DataFrame, order: str, text: str, derive) -> DataFrame:
    """docs with what ``derive`` adds to them, and ``next``: text and what is added of the row that follows in descending order, and after the last row those of the first.

    docs: order and text. Rows are dealt to runs between quantiles of the order column, and the head of the following run
    closes each run, so no task has more than a run. Nulls come last; rows of equal order follow each other by text.
    ``derive`` is applied once, to rows and heads together.
    """
    spark = docs.sparkSession
    n = docs.count()
    runs = max(1, min(MOST_RUNS, n // RUN))
    cuts = docs.agg(F.percentile_approx(order, [i / runs for i in range(1, runs)], 10 * runs)).first()[0] if runs > 1 else []
    cuts = sorted({*(cuts or [])})
    # a run's number is how many cuts are above its values, counted in two steps; null goes after all
    groups = [cuts[at : at + GROUP] for at in range(0, len(cuts), GROUP)]
    kind = docs.schema[order].dataType.simpleString()
    finer = spark.createDataFrame([(len(groups) - k, sum(map(len, groups[k + 1 :])), g) for k, g in enumerate(groups)], f"_above int, _base int, _cuts array<{kind}>")
    above = F.size(F.filter(F.array(*(F.lit(g[-1]) for g in groups)), lambda c: c > F.col(order))) if groups else F.lit(0)
    placed = docs.select(order, text, F.coalesce(above, F.lit(0)).cast("int").alias("_above")).join(F.broadcast(finer), "_above", "left")
    run = F.when(F.col(order).isNull(), len(cuts) + 1).otherwise(F.coalesce(F.col("_base") + F.size(F.filter("_cuts", lambda c: c > F.col(order))), F.lit(0))).cast("int")
    placed = placed.select(order, text, run.alias("_run"), F.lit(0).alias("_close"))
    heads = placed.groupBy("_run").agg(F.max(order).alias("_head")).orderBy("_run").collect()  # MOST_RUNS + 1 rows at most
    follows = spark.createDataFrame([(heads[i]["_run"], heads[(i + 1) % len(heads)]["_run"], heads[(i + 1) % len(heads)]["_head"]) for i in range(len(heads))], f"_before int, _run int, _head {kind}")
    first = placed.join(F.broadcast(follows), [placed["_run"] == follows["_run"], placed[order].eqNullSafe(follows["_head"])]).groupBy("_before").agg(F.min(text).alias(text))
    closing = first.select(F.lit(None).cast(docs.schema[order].dataType).alias(order), text, F.col("_before").alias("_run"), F.lit(1).alias("_close"))
    rows = derive(placed.unionByName(closing))
    added = [c for c in rows.columns if c not in placed.columns]
    w = Window.partitionBy("_run").orderBy("_close", F.col(order).desc_nulls_last(), text)
    return rows.withColumn("next", F.lead(F.struct(text, *added)).over(w)).where("_close = 0").drop("_run", "_close")


def imatch_digest(docs: DataFrame) -> DataFrame:
    """A row for each row of docs, with the fingerprints of its text and of the text edited by a third, and their likeness.

    Null texts are empty, and two without terms are alike. Texts may have any length; rows that repeat follow each other
    and each get a row. Columns but doc_id and text are ignored.
    """
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    bits = cut(lexicon(docs))
    rows = with_next(docs, "doc_id", "text", lambda rows: with_fingerprint(rows, bits.scalar(), "text", "fp"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    rows = rows.withColumn("edited", F.concat(F.substring("text", F.lit(1), n - third), F.substring(F.col("next.text"), F.lit(1), third))).select("doc_id", n.cast("long").alias("n_chars"), "fp", F.col("next.fp").alias("next_fp"), "edited")
    rows = with_fingerprint(rows, bits.scalar(), "edited", "edited_fp")
    return rows.select("doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), hex_string(F.col("fp")).alias("fingerprint"), hex_string(F.col("edited_fp")).alias("edited_fingerprint"), likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"))
