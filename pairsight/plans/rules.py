"""The nineteen discrepancy rules over relations of many pairs at once.

Relations: ``pairs`` has a row for each pair with what the headers and texts say (facts); ``protocol`` and ``report`` have
a row for each test; ``shared`` is their join, made once. A rule is a function from these and the findings so far to
findings; its status for a pair without any is told by a column over facts. Rules of the second stage read findings of
the first: R-15 those of R-14; R-17 of R-12, R-13 and R-16; R-20 and R-21 of R-10 and R-14.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import comparable, number, squash
from ..functions.values import criterion, instruments, integer, measurements, outside, qualifiers, stringency, temperatures, worst_case
from ..operators.cite import CITATIONS, citation, citations
from ..operators.structure import SPANS
from ..sources.shared import settle

FINDING = ["pair_id", "rule_id", "scope", "priority", "statement", "basis", "action", "uncertainty", "citations", "emit_ord"]
PRIORITIES = ("high", "medium", "low")
PASSING = r"(?iU)\b(pass|passed|conform(?:s|ing)?|meets)\b"


@dataclass
class Relations:
    pairs: DataFrame
    protocol: DataFrame
    report: DataFrame
    shared: DataFrame
    findings: dict[str, DataFrame] = field(default_factory=dict)


@dataclass(frozen=True)
class Rule:
    id: str
    title: str
    category: str
    question: str
    find: Callable[[Relations], DataFrame]
    applies: Column | None
    stage: int


RULES: list[Callable[[], Rule]] = []


def rule(id: str, title: str, category: str, question: str, applies: Callable[[], Column] | None = None, stage: int = 1):
    """Registers a rule. applies: whether a pair of facts can be judged; without it, every pair can."""

    def add(find):
        RULES.append(lambda: Rule(id, title, category, question, find, applies() if applies else None, stage))
        return find

    return add


def registry() -> list[Rule]:
    return [make() for make in RULES]


def _say(*parts) -> Column:
    return F.concat(*(F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("")) for p in parts))


def _finding(rows: DataFrame, rule_id: str, scope, priority, statement: Column, basis: str, action: str, cites: Column, uncertainty: Column | None = None, order: str | None = None) -> DataFrame:
    lit = lambda x: F.lit(x) if isinstance(x, str) else x
    return rows.select(
        "pair_id", F.lit(rule_id).alias("rule_id"), lit(scope).alias("scope"), lit(priority).alias("priority"), statement.alias("statement"), F.lit(basis).alias("basis"), F.lit(action).alias("action"),
        (F.lit("") if uncertainty is None else F.coalesce(uncertainty, F.lit(""))).alias("uncertainty"), cites.cast(CITATIONS).alias("citations"), (F.col(order) if order else F.lit(0)).cast("int").alias("emit_ord"),
    )


def _cell(doc: str, cell: str, note: str, spans: str | None = None) -> Column:
    column = spans or {"protocol": "p_spans", "report": "r_spans"}[doc]
    return citation(doc, note, F.try_element_at(F.col(column), F.lit(cell)))


def _field(doc: str, name: str, note: str) -> Column:
    return citation(doc, note, F.when(F.col(f"{name}_span").isNotNull(), F.array(f"{name}_span")))


def _day(c: str) -> Column:
    return F.date_format(c, "dd MMMM yyyy")


def by_id(tests: DataFrame) -> DataFrame:
    """One row a test: of rows that repeat an id the last."""
    n = F.row_number().over(Window.partitionBy("pair_id", "test_id").orderBy(F.desc("row_ord")))
    return tests.withColumn("_n", n).where("_n = 1").drop("_n")


def share_tests(protocol: DataFrame, report: DataFrame) -> DataFrame:
    """Tests of both sides: columns p_* and r_*, with criteria and measurements parsed once for all rules."""
    cells = ("test_name", "criterion", "sample_size", "method", "result", "spans", "row_ord", "criterion_form")
    take = lambda df, k: by_id(df).select("pair_id", "test_id", *(F.col(c).alias(f"{k}_{c}") for c in cells))
    both = take(protocol, "p").join(take(report, "r"), ["pair_id", "test_id"])
    both = both.withColumn("p_c", criterion(F.col("p_criterion"), F.col("p_criterion_form"))).withColumn("r_c", criterion(F.col("r_criterion"), F.col("r_criterion_form")))
    values = measurements(F.col("r_result"), F.when(F.col("p_c.kind") == "threshold", F.col("p_c.prefix")))
    both = both.withColumn("values", F.when(F.col("p_c.kind").isin("range", "threshold"), values))
    both = both.withColumn("p_temps", temperatures(F.col("p_method"))).withColumn("reported", squash(F.concat_ws(" ", "r_result", "r_method")))
    return both.withColumn("quals", F.when(F.col("p_c.kind") == "qualitative", qualifiers(F.col("p_criterion"))))


# ---- identity, equipment and dates -------------------------------------------


@rule("R-01", "Protocol version cited", "identity", "Does the report name the version of the protocol that is at hand?", lambda: F.col("cited_version").isNotNull() & F.col("version").isNotNull())
def r01(r: Relations) -> DataFrame:
    rows = r.pairs.where(F.col("cited_version") != F.col("version"))
    cites = citations(_field("report", "cited", "protocol named in the header"), _field("protocol", "version_field", "version in the header"), citation("protocol", "reporting requirement", F.col("must_reference")))
    return _finding(rows, "R-01", "document", "high", _say("The report cites protocol version ", F.col("cited_version"), "; the protocol at hand has version ", F.col("version"), "."), "The report has to refer to the protocol version that it verifies.", "Find out which version was tested against and what changed between the two.", cites)


@rule("R-02", "Protocol document cited", "identity", "Does the report name the document number of the protocol that is at hand?", lambda: F.col("cited_id").isNotNull() & F.col("protocol_id").isNotNull())
def r02(r: Relations) -> DataFrame:
    rows = r.pairs.where(F.col("cited_id") != F.col("protocol_id"))
    cites = citations(_field("report", "cited", "protocol named in the header"), _field("protocol", "protocol_field", "document number in the header"))
    return _finding(rows, "R-02", "document", "high", _say("The report cites protocol ", F.col("cited_id"), "; the protocol at hand is ", F.col("protocol_id"), "."), "A report has to be traceable to its protocol.", "Settle which protocol the report belongs to before reading any result.", cites)


@rule("R-03", "Report named by the protocol", "identity", "Is this the report into which the protocol says results go?", lambda: F.col("report_id").isNotNull() & (F.size("named_ids") > 0))
def r03(r: Relations) -> DataFrame:
    rows = r.pairs.where((F.size("named_ids") > 0) & ~F.array_contains("named_ids", F.col("report_id")))
    cites = citations(citation("protocol", "reporting section", F.col("reporting_spans")), _field("report", "report_field", "document number in the header"))
    return _finding(rows, "R-03", "document", "high", _say("The protocol sends results to ", F.col("named_ids")[0], "; this report is ", F.col("report_id"), "."), "Results go into the report that the protocol names.", "Confirm that this is the report meant.", cites)


@rule("R-04", "Calibration in date", "equipment", "Was the equipment's calibration still due at the report's date?", lambda: F.col("calibration_due").isNotNull() & F.col("report_date").isNotNull())
def r04(r: Relations) -> DataFrame:
    rows = r.pairs.where(F.col("calibration_due") < F.col("report_date"))
    cites = citations(citation("protocol", "calibration requirement", F.col("calibration_phrase")), _field("report", "equipment", "equipment in the header"), _field("report", "report_date_field", "date in the header"))
    said = _say("Calibration was due ", _day("calibration_due"), ", ", F.date_diff("report_date", "calibration_due"), " days before the report's date of ", _day("report_date"), ".")
    return _finding(rows, "R-04", "document", "high", said, "Instruments have to be within calibration when they are used.", "Get the certificate that covers the days of testing, or a deviation with its impact.", cites, F.lit("The days of testing aren't known here; the report's date stands in for them."))


@rule("R-05", "Protocol in force", "dates", "Is the report dated on or after the day the protocol took effect?", lambda: F.col("effective").isNotNull() & F.col("report_date").isNotNull())
def r05(r: Relations) -> DataFrame:
    rows = r.pairs.where(F.col("report_date") < F.col("effective"))
    cites = citations(_field("protocol", "effective_field", "effective date in the header"), _field("report", "report_date_field", "date in the header"))
    return _finding(rows, "R-05", "document", "high", _say("The report is dated ", _day("report_date"), ", before the protocol took effect on ", _day("effective"), "."), "Testing follows a protocol that is in force.", "Find out which version was in force at the time.", cites)


@rule("R-06", "Days of testing stated", "dates", "Does the report say when tests were carried out?")
def r06(r: Relations) -> DataFrame:
    cites = citations(citation("protocol", "calibration requirement", F.col("calibration_phrase")), _field("report", "report_date_field", "date in the header"))
    return _finding(r.pairs.where(~F.col("says_test_dates")), "R-06", "document", "low", F.lit("The report doesn't say on which days tests were carried out."), "Whether calibration was in date depends on the days of testing.", "Ask for the days, or for records that have them.", cites)


#: Letters before and digits after the gap of an instrument's name, by which it is looked up; names have as many of each at least.
ENDS = 3


def instrument_places(texts: DataFrame) -> DataFrame:
    """pair_id, end and start, by which places are looked up, and name, gap and number of each place of a report that an instrument's name may have. texts: pair_id and report_text. Rows are distinct."""
    each = texts.select("pair_id", F.explode(F.array_distinct(F.regexp_extract_all(F.lower("report_text"), F.lit(r"[a-z]{3,}(?U:\s+)\d{3,}"), F.lit(0)))).alias("place"))
    name, number = F.regexp_extract("place", "^[a-z]+", 0), F.regexp_extract("place", r"\d+$", 0)
    gap = F.substring("place", F.length(name) + 1, F.length("place") - F.length(name) - F.length(number))
    return each.select("pair_id", F.right(name, F.lit(ENDS)).alias("end"), F.left(number, F.lit(ENDS)).alias("start"), name.alias("name"), gap.alias("gap"), number.alias("number"))


def missing_instruments(protocol: DataFrame, texts: DataFrame) -> DataFrame:
    """pair_id, test_id, row_ord, spans and token of instruments that methods name and the pair's report hasn't, in any case of letters.

    Each report is cut once into the places that may be a name; names meet places by the letters and digits around the
    gap, so no text is searched for each name. A name is there where a place ends in its letters and goes on with its digits
    after the same gap.
    """
    named = protocol.select("pair_id", "test_id", "row_ord", "spans", F.explode(instruments(F.col("method"))).alias("token")).join(texts.select("pair_id"), "pair_id", "left_semi")
    low = F.lower("token")
    name, number = F.regexp_extract(low, "^[a-z]+", 0), F.regexp_extract(low, r"\d+$", 0)
    tokens = named.select("pair_id", "token").distinct().select("*", name.alias("w"), F.substring(low, F.length(name) + 1, F.length(low) - F.length(name) - F.length(number)).alias("g"), number.alias("d"))
    tokens = tokens.select("*", F.right("w", F.lit(ENDS)).alias("end"), F.left("d", F.lit(ENDS)).alias("start"))
    there = tokens.join(instrument_places(texts), ["pair_id", "end", "start"]).where(F.col("name").endswith(F.col("w")) & F.col("number").startswith(F.col("d")) & (F.col("gap") == F.col("g")))
    return named.join(there.select("pair_id", "token").distinct(), ["pair_id", "token"], "left_anti")


@rule("R-19", "Named instruments used", "equipment", "Does the report name every instrument that the protocol's methods name?", lambda: F.col("n_instruments") > 0)
def r19(r: Relations) -> DataFrame:
    rows = missing_instruments(r.protocol, r.pairs.select("pair_id", "report_text"))
    return _finding(rows, "R-19", F.col("test_id"), "medium", _say("The protocol names ", F.col("token"), " for ", F.col("test_id"), "; the report doesn't."), "The protocol fixes the instrument of this test.", "Find out which instrument was used and whether it was qualified.", citations(_cell("protocol", "method", "method", "spans")), order="row_ord")


# ---- coverage ------------------------------------------------------------------


@rule("R-10", "Every test reported", "coverage", "Has every test of the protocol a row in the report?")
def r10(r: Relations) -> DataFrame:
    missing = r.protocol.join(r.report.select("pair_id", "test_id").distinct(), ["pair_id", "test_id"], "left_anti")
    spans = F.coalesce(F.try_element_at("spans", F.lit("test_id")), F.array().cast(SPANS))
    there = r.report.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct("row_ord", "test_id", spans.alias("spans")))).alias("there"))
    rows = missing.join(there, "pair_id", "left").join(r.pairs.select("pair_id", "recorded_phrase"), "pair_id", "left")
    cites = citations(_cell("protocol", "test_id", "test", "spans"), _cell("protocol", "test_name", "test", "spans"), _cell("protocol", "criterion", "criterion", "spans"), citation("protocol", "reporting requirement", F.col("recorded_phrase")), citation("report", "tests in the report", F.flatten(F.transform("there", lambda x: x["spans"]))))
    said = _say(F.col("test_id"), " (", F.col("test_name"), ") is in the protocol and not in the report, which has ", F.array_join(F.transform("there", lambda x: x["test_id"]), ", "), ".")
    return _finding(rows, "R-10", F.col("test_id"), "high", said, "Results of every test of the protocol have to be recorded.", "Find out whether the test was done and recorded elsewhere; until then coverage is incomplete.", cites, order="row_ord")


@rule("R-11", "No unplanned tests", "coverage", "Has the report rows for tests that the protocol doesn't define?")
def r11(r: Relations) -> DataFrame:
    extra = r.report.join(r.protocol.select("pair_id", "test_id").distinct(), ["pair_id", "test_id"], "left_anti")
    return _finding(extra, "R-11", F.col("test_id"), "medium", _say("The report has ", F.col("test_id"), " (", F.col("test_name"), "), which the protocol doesn't define."), "The protocol sets the tests that a report is held against.", "Find out where this test's criterion comes from.", citations(_cell("report", "test_id", "test", "spans")), order="row_ord")


@rule("R-18", "Usable sample sizes", "protocol-quality", "Does every test of the protocol give its sample size as a number?")
def r18(r: Relations) -> DataFrame:
    rows = r.protocol.where((F.col("sample_size") != "") & integer(F.col("sample_size")).isNull())
    return _finding(rows, "R-18", F.col("test_id"), "low", _say("The protocol's sample size for ", F.col("test_id"), ' is "', F.col("sample_size"), '", not a number.'), "How many units were tested is held against this column.", "Take the number required from the standard or plan referred to.", citations(_cell("protocol", "sample_size", "sample size", "spans"), _cell("protocol", "method", "method", "spans")), order="row_ord")


# ---- criteria, sampling, conditions, results -------------------------------------


def _both(cell_p: str, cell_r: str) -> Column:
    return citations(_cell("protocol", cell_p, cell_p.replace("_", " ")), _cell("report", cell_r, cell_r.replace("_", " ")))


@rule("R-12", "Criteria restated as they are", "criteria", "Is each criterion in the report the protocol's?")
def r12(r: Relations) -> DataFrame:
    form = lambda k: comparable(F.coalesce(f"{k}_criterion_form", f"{k}_criterion"))
    rows = r.shared.where((F.col("p_criterion") != "") & (F.col("r_criterion") != "") & (form("p") != form("r")))
    way = stringency(F.col("p_c"), F.col("r_c"))
    said = _say("The report's criterion for ", F.col("test_id"), ' is "', F.col("r_criterion"), '", the protocol\'s "', F.col("p_criterion"), '".', F.when(way == "", "").otherwise(_say(" The report's is ", way, ".")))
    return _finding(rows, "R-12", F.col("test_id"), "high", said, "Results are held against the protocol's criteria.", "Go by the protocol's criterion; find out why the report has another and whether it was used.", _both("criterion", "criterion"), order="p_row_ord")


@rule("R-13", "Sample sizes met", "sampling", "Were as many units tested as the protocol asks for?")
def r13(r: Relations) -> DataFrame:
    need, got = integer(F.col("p_sample_size")), integer(F.col("r_sample_size"))
    rows = r.shared.withColumn("need", need).withColumn("got", got).where("need <> got")
    low = F.col("got") < F.col("need")
    said = _say("The report has ", F.col("got"), " units for ", F.col("test_id"), ", the protocol ", F.col("need"), ": ", F.abs(F.col("need") - F.col("got")), F.when(low, " fewer.").otherwise(" more."))
    return _finding(rows, "R-13", F.col("test_id"), F.when(low, "high").otherwise("low"), said, "The protocol fixes each test's sample size.", "Find out whether a deviation covers the difference.", _both("sample_size", "sample_size"), order="p_row_ord")


@rule("R-16", "Conditions as specified", "conditions", "Do the conditions in the report contradict the protocol's method?", lambda: F.col("n_conditions") > 0)
def r16(r: Relations) -> DataFrame:
    rows = r.shared.where(F.size("p_temps") > 0).withColumn("temps", temperatures(F.col("reported")))
    other = F.exists("temps", lambda t: F.abs(t - F.col("p_temps")[0]) > 0.01)
    ambient = F.col("reported").rlike(r"(?iU)\b(ambient|room temperature)\b") & (F.size("temps") == 0)
    at = F.when(other, _say("a different temperature (", F.array_join(F.transform("temps", lambda t: F.concat(number(t), F.lit(" C"))), ", "), ")")).when(ambient, "ambient or room temperature")
    rows = rows.withColumn("at", at).where("at IS NOT NULL")
    said = _say("The report has ", F.col("test_id"), " at ", F.col("at"), '; the protocol says "', F.col("p_method"), '".')
    return _finding(rows, "R-16", F.col("test_id"), "high", said, "The protocol fixes the conditions; results under others show something else.", "Find out whether the change was authorised and what it does to the property measured.", _both("method", "result"), order="p_row_ord")


def _out() -> Column:
    return F.filter(worst_case(F.col("p_c"), F.col("values")), lambda v: outside(F.col("p_c"), v["value"]))


@rule("R-14", "Values within the protocol's criterion", "results", "Do reported values lie within the protocol's own criterion?", lambda: F.col("n_compared") > 0)
def r14(r: Relations) -> DataFrame:
    rows = r.shared.where(F.size("values") > 0).withColumn("out", _out()).where(F.size("out") > 0)
    # the lowest value for a lower limit, else the highest; of equal ones the first
    sign = F.when(F.col("p_c.op") == ">=", 1.0).otherwise(-1.0)
    worst = F.array_min(F.transform("out", lambda v, i: F.struct((sign * v["value"]).alias("by"), i.alias("i"), v.alias("v"))))["v"]
    means = F.filter("values", lambda v: v["label"] == "mean")
    rows = rows.withColumn("worst", worst).withColumn("mean", F.try_element_at(means, F.lit(1)))
    unsure = F.when((F.col("p_c.kind") == "threshold") & F.col("mean").isNotNull() & ~outside(F.col("p_c"), F.col("mean.value")), _say('The protocol doesn\'t say whether "', F.col("p_criterion"), '" holds for each unit or for the mean. The mean (', number(F.col("mean.value")), " ", F.col("mean.unit"), ") is inside, the ", F.col("worst.label"), " isn't."))
    said = _say("For ", F.col("test_id"), ' the report has "', squash("worst.source"), '", outside the protocol\'s criterion "', F.col("p_criterion"), '".')
    return _finding(rows, "R-14", F.col("test_id"), "high", said, "Values are held against the protocol's criterion.", "Look at the raw data and decide the disposition; this review doesn't.", _both("criterion", "result"), unsure, order="p_row_ord")


@rule("R-22", "Qualitative criteria shown in full", "results", "Where a criterion in words sets a time, does the result have it too?", lambda: F.col("n_qualified") > 0)
def r22(r: Relations) -> DataFrame:
    gone = F.filter("quals", lambda q: ~comparable(F.col("r_result")).contains(comparable(q)))
    rows = r.shared.where(F.size("quals") > 0).withColumn("gone", gone).where(F.size("gone") > 0)
    said = _say("The criterion for ", F.col("test_id"), ' is "', F.col("p_criterion"), '"; the report says "', F.col("r_result"), '" without ', F.array_join("gone", ", "), ".")
    return _finding(rows, "R-22", F.col("test_id"), "low", said, "A criterion in words is met only under its own conditions.", "Check in the raw data that it was observed at that point.", _both("criterion", "result"), order="p_row_ord")


# ---- second stage -------------------------------------------------------------------


@rule("R-15", "Disposition follows from values", "claims", "Is a passing disposition recorded next to values outside the criterion?", stage=2)
def r15(r: Relations) -> DataFrame:
    fired = r.findings["R-14"].select("pair_id", F.col("scope").alias("test_id"))
    rows = r.shared.join(fired, ["pair_id", "test_id"]).where(F.col("r_result").rlike(PASSING))
    said = _say("The report's disposition for ", F.col("test_id"), ' is "', squash("r_result"), '", with values outside the protocol\'s criterion "', F.col("p_criterion"), '".')
    return _finding(rows, "R-15", F.col("test_id"), "medium", said, "A disposition follows from the data recorded with it.", "Settle the contradiction; the disposition is the reviewer's.", _both("criterion", "result"), order="p_row_ord")


def _scopes(r: Relations, *rules: str) -> DataFrame:
    """pair_id and, for each rule, the sorted scopes in which it fired; pairs in which one of them did."""
    each = reduce(DataFrame.unionByName, (r.findings[k].select("pair_id", "scope", "rule_id") for k in rules))
    of = lambda k: F.array_sort(F.collect_set(F.when(F.col("rule_id") == k, F.col("scope")))).alias(f"in_{k[2:]}")
    return each.groupBy("pair_id").agg(F.array_sort(F.collect_set("scope")).alias("scopes"), *map(of, rules))


@rule("R-17", "Deviations documented", "deviations", "Where a departure was found, does the report document a deviation?", lambda: F.col("n_departures") > 0, stage=2)
def r17(r: Relations) -> DataFrame:
    rows = r.pairs.join(_scopes(r, "R-12", "R-13", "R-16"), "pair_id").where(~F.col("says_deviation"))
    said = _say('The word "deviation" isn\'t in the report, whose sections are ', F.array_join(F.col("report_titles"), ", "), "; departures were found for ", F.array_join("scopes", ", "), ".")
    cites = citations(citation("protocol", "deviation requirement", F.col("deviation_phrase")), citation("report", "section headings", F.col("heading_spans")))
    return _finding(rows, "R-17", "document", "high", said, "Deviations have to be documented and justified in the report.", "Each departure needs a deviation or a correction.", cites)


@rule("R-20", "Summary supported by the table", "claims", "Does a summary claim all tests while entries contradict it?", stage=2)
def r20(r: Relations) -> DataFrame:
    rows = r.pairs.join(_scopes(r, "R-14", "R-10"), "pair_id").where(F.col("all_tests_phrase").isNotNull())
    first = r.findings["R-14"].groupBy("pair_id").agg(F.min_by(F.slice("citations", -1, 1), F.struct("emit_ord", "scope")).alias("evidence"))
    rows = rows.join(first, "pair_id", "left")
    why = F.concat_ws(" and ", F.when(F.size("in_14") > 0, _say("values of ", F.array_join("in_14", ", "), " lie outside")), F.when(F.size("in_10") > 0, _say(F.array_join("in_10", ", "), " has no result")))
    cites = F.concat(citations(citation("report", "summary", F.col("all_tests_phrase"))), F.coalesce("evidence", F.array().cast(CITATIONS)))
    return _finding(rows, "R-20", "document", "medium", _say("The summary speaks for all tests, but ", why, "."), "A summary has to be borne out by the entries under it.", "Reconcile summary and table, whatever the dispositions will be.", cites)


@rule("R-21", "Conclusion supported", "claims", "Does a conclusion stand while tests are missing or contested?", lambda: (F.col("n_outstanding") == 0) | F.col("conclusion_spans").isNotNull(), stage=2)
def r21(r: Relations) -> DataFrame:
    rows = r.pairs.join(_scopes(r, "R-10", "R-14"), "pair_id").where(F.col("conclusion_spans").isNotNull())
    why = F.concat_ws(" and ", F.when(F.size("in_10") > 0, _say(F.array_join("in_10", ", "), " isn't reported")), F.when(F.size("in_14") > 0, _say(F.array_join("in_14", ", "), " has values outside")))
    cites = citations(citation("report", "conclusion", F.col("conclusion_spans")), citation("protocol", "reporting requirement", F.col("recorded_phrase")))
    return _finding(rows, "R-21", "document", "medium", _say("The report concludes while ", why, "."), "Verification is complete when all results are in.", "Settle what is outstanding before the conclusion can stand; release is for others to decide.", cites)


# ---- all of them -------------------------------------------------------------------------


def with_counts(pairs: DataFrame, protocol: DataFrame, report: DataFrame, shared: DataFrame) -> DataFrame:
    """pairs with what tells whether a rule applies."""
    named = protocol.groupBy("pair_id").agg(F.sum(F.size(instruments(F.col("method")))).alias("n_instruments"), F.count("*").alias("n_protocol"))
    tested = report.groupBy("pair_id").agg(F.count("*").alias("n_report"))
    seen = shared.groupBy("pair_id").agg(F.count("*").alias("n_shared"), F.count_if(F.size("p_temps") > 0).alias("n_conditions"), F.count_if(F.size("values") > 0).alias("n_compared"), F.count_if(F.size("quals") > 0).alias("n_qualified"))
    counted = [c for df in (named, tested, seen) for c in df.columns if c != "pair_id"]
    return pairs.join(named, "pair_id", "left").join(tested, "pair_id", "left").join(seen, "pair_id", "left").fillna(0, counted)


#: What a rule goes over, where that isn't the pair as a whole: a count of facts, and how one and more of it are called.
JUDGED = {
    "R-10": ("n_protocol", "test", "of the protocol"), "R-11": ("n_report", "test", "of the report"), "R-18": ("n_protocol", "test", "of the protocol"), "R-19": ("n_instruments", "instrument", "named"),
    **dict.fromkeys(("R-12", "R-13"), ("n_shared", "test", "on both sides")), "R-14": ("n_compared", "test", "with values to compare"), "R-15": ("n_shared", "test", "on both sides"),
    "R-16": ("n_conditions", "test", "with conditions"), "R-22": ("n_qualified", "test", "with a time in words"), "R-17": ("n_departures", "departure", ""),
}


def _judged(rule_id: str) -> tuple[Column, Column, Column]:
    count, one, rest = JUDGED.get(rule_id, ("", "pair", "of documents"))
    return (F.col(count).cast("long") if count else F.lit(1).cast("long")), F.lit(one), F.lit(rest)


def run_rules(r: Relations, only: list[str] | None = None) -> tuple[DataFrame, DataFrame]:
    """Findings, numbered within their pair in order of priority, rule and scope, and one outcome for each rule and pair.

    only: rules to run, in place of all; those of the first stage that the second needs have to be among them.
    """
    rules = [x for x in registry() if only is None or x.id in only]
    stages = []
    for stage in (1, 2):
        ran = {x.id: x.find(r).select(FINDING) for x in rules if x.stage == stage}
        if ran:
            # settled together, so the second stage and the outcomes read findings instead of running rules again
            stages.append(settle(reduce(DataFrame.unionByName, ran.values())))
            r.findings |= {k: stages[-1].where(F.col("rule_id") == k) for k in ran}
    all_found = reduce(DataFrame.unionByName, stages)
    ranks = F.array_position(F.array(*map(F.lit, PRIORITIES)), F.col("priority"))
    n = F.row_number().over(Window.partitionBy("pair_id").orderBy(ranks, "rule_id", "scope", "emit_ord", "statement"))
    numbered = all_found.withColumn("id", F.format_string("F-%03d", n))

    count = lambda *ids: F.coalesce(F.sum(F.when(F.col("rule_id").isin(*ids), 1)), F.lit(0))
    fired = all_found.groupBy("pair_id").agg(count("R-12", "R-13", "R-16").alias("n_departures"), count("R-10", "R-14").alias("n_outstanding"))
    facts = r.pairs.join(fired, "pair_id", "left").fillna(0, ["n_departures", "n_outstanding"])
    said = [F.struct(F.lit(i).alias("ord"), F.lit(x.id).alias("rule_id"), F.lit(x.title).alias("title"), F.lit(x.category).alias("category"), F.lit(x.question).alias("question"), (F.lit(True) if x.applies is None else F.coalesce(x.applies, F.lit(False))).alias("applies"), *(v.alias(k) for k, v in zip(("n_judged", "judged", "rest"), _judged(x.id), strict=True))) for i, x in enumerate(rules)]
    each = facts.select("pair_id", F.inline(F.array(*said)))
    counts = all_found.groupBy("pair_id", "rule_id").agg(F.count("*").cast("int").alias("fired"))
    outcomes = each.join(counts, ["pair_id", "rule_id"], "left").fillna(0, ["fired"])
    status = F.when(F.col("fired") > 0, "findings").when(F.col("applies"), "no-finding").otherwise("not-applicable")
    judged = F.concat(F.lit("Judged: "), F.col("n_judged").cast("string"), F.lit(" "), "judged", F.when(F.col("n_judged") == 1, "").otherwise("s"), F.regexp_replace("rest", "^(?=.)", " "), F.lit("; "))
    fired_said = F.concat(F.col("fired").cast("string"), F.when(F.col("fired") == 1, F.lit(" finding.")).otherwise(F.lit(" findings.")))
    detail = F.when(status == "not-applicable", "There is nothing here to judge.").otherwise(F.concat(judged, F.when(F.col("fired") == 0, F.lit("nothing to raise.")).otherwise(fired_said)))
    return numbered, outcomes.select("pair_id", "ord", "rule_id", "title", "category", "question", "fired", status.alias("status"), detail.alias("detail"))
