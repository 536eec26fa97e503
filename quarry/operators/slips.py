"""Salary slips: parse, check, compare."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import amount, map_sum, strip

FIELDS = ["basic_salary", "allowances_total", "gross_salary", "ssf_employee_contribution", "ssf_employer_contribution", "tds_deducted", "other_deductions_total", "net_pay"]
# The tolerance, and labels (a line's part before the colon, in lower case, single-spaced).
TOLERANCE = 1.0
LABELS = {
    "basic_salary": ["basic", "basic salary"],
    "gross_salary": ["gross", "gross salary"],
    "ssf_employee_contribution": ["ssf employee contribution", "ssf employee contribution (11%)", "ssf (employee)", "ssf (emp 11%)"],
    "ssf_employer_contribution": ["employer ssf contribution", "employer ssf contribution (20%)", "ssf (employer)", "ssf (co 20%)"],
    "tds_deducted": ["tds", "tds deducted this month"],
    "net_pay": ["net pay", "net salary", "take home"],
}
ALLOWANCE = r"(?i)\A\s*(.*allowance|.*bonus)\s*\z"
DEDUCTION = r"(?i)\A\s*(.*(loan|advance|insurance|premium|recovery|repayment).*)\s*\z"
PERIOD = r"(?i)(?:salary slip - |payslip for )([^\n,]+)"
NAME = r"(?im)^\s*(?:employee|name):\s*([^\n,]+)"


def parse_slips(slips: DataFrame) -> DataFrame:
    """id, slip_text to a record each; what a slip does not state is 0 or an empty map.

    Lines are read as "label: amount"; text that is neither, orders to the reader included, is not
    read.  Several "label: amount" on one line are told apart by commas before a letter.  Of
    repeated labels the first counts, in maps they add up.
    """
    lines = F.filter(F.split("slip_text", r"\n|,\s*(?=[A-Za-z])"), lambda s: s.rlike(r":[^:\d]*-?\d"))
    pairs = F.transform(lines, lambda s: F.struct(strip(F.regexp_extract(s, r"\A(.*):[^:]*\z", 1)).alias("label"), amount(s).alias("value")))
    known = F.create_map(*[F.lit(x) for field, labels in LABELS.items() for label in labels for x in (label, field)])
    # a label is looked up once, whatever it is then asked for
    plain = lambda label: F.regexp_replace(F.regexp_replace(F.lower(label), r"\s*\(", " ("), r"\s+", " ")
    told = F.transform(F.filter(pairs, lambda p: p.value.isNotNull()), lambda p: F.struct(F.try_element_at(known, plain(p.label)).alias("kind"), p.label.alias("label"), p.value.alias("value")))
    # behind a generator, so that no expression or filter on a field repeats the reading of the text
    read = slips.withColumn("_pairs", F.explode(F.array(told)))

    def field(name: str) -> Column:
        own = F.filter("_pairs", lambda p: p.kind == name)
        return F.when(F.size(own) > 0, F.element_at(own, 1).value)

    def amounts(pattern: str) -> Column:
        own = F.filter("_pairs", lambda p: p.kind.isNull() & p.label.rlike(pattern))
        labels = F.array_distinct(F.transform(own, lambda p: p.label))
        total = lambda label: F.aggregate(F.filter(own, lambda p: p.label == label), F.lit(0.0), lambda t, p: t + p.value)
        return F.map_from_arrays(labels, F.transform(labels, total))

    found = lambda pattern: F.nullif(strip(F.regexp_extract("slip_text", pattern, 1)), F.lit(""))
    columns = {"pay_period": found(PERIOD), "employee_name": found(NAME)} | {k: field(k) for k in LABELS} | {"allowances": amounts(ALLOWANCE), "other_deductions": amounts(DEDUCTION)}
    return with_defaults(read.withColumns(columns).drop("_pairs"))


def with_defaults(slips: DataFrame) -> DataFrame:
    """What may be missing becomes 0 or an empty map."""
    empty = F.create_map().cast("map<string,double>")
    zero = ["ssf_employee_contribution", "ssf_employer_contribution", "tds_deducted"]
    return slips.withColumns({c: F.coalesce(F.col(c), F.lit(0.0)) for c in zero} | {c: F.coalesce(F.col(c), empty) for c in ("allowances", "other_deductions")})


def violations(required: list[str] = ["basic_salary", "gross_salary", "net_pay"]) -> Column:
    """Names of amounts that are missing, negative or not a number, in a fixed order."""
    bad = lambda c: (F.col(c) < 0) | F.isnan(c) | (F.col(c).isNull() if c in required else F.lit(False))
    return F.array_compact(F.array(*[F.when(F.coalesce(bad(c), F.lit(False)), c) for c in LABELS]))


# The texts of both warnings.


def gross_warning() -> Column:
    expected = F.col("basic_salary") + map_sum("allowances")
    text = F.concat(F.lit("gross_salary ("), _plain("gross_salary"), F.lit(") does not match basic_salary + allowances ("), _plain(expected), F.lit(")"))
    return F.when(F.abs(expected - F.col("gross_salary")) > TOLERANCE, text)


def net_warning() -> Column:
    """The employer's contribution does not enter."""
    expected = F.col("gross_salary") - F.col("ssf_employee_contribution") - F.col("tds_deducted") - map_sum("other_deductions")
    text = F.concat(F.lit("net_pay ("), _plain("net_pay"), F.lit(") does not match gross minus deductions ("), _plain(expected), F.lit(")"))
    return F.when(F.abs(expected - F.col("net_pay")) > TOLERANCE, text)


def _plain(value) -> Column:
    """Two decimals, no exponent."""
    return F.format_string("%.2f", value)


def arithmetic_warnings() -> Column:
    return F.array_compact(F.array(gross_warning(), net_warning()))


def checked(slips: DataFrame) -> DataFrame:
    """Every record with its arithmetic warnings and its violations; none is left out."""
    return slips.withColumn("violations", violations()).withColumn("arithmetic_warnings", arithmetic_warnings())


def validated(slips: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records with their arithmetic warnings, quarantined ones with their violations too)."""
    told = checked(slips)
    return told.filter(F.size("violations") == 0).drop("violations"), told.filter(F.size("violations") > 0)


def amounts() -> list[Column]:
    """The eight compared amounts of a record."""
    return [map_sum({"allowances_total": "allowances", "other_deductions_total": "other_deductions"}[c]).alias(c) if c.endswith("_total") else F.col(c) for c in FIELDS]


def flat(slips: DataFrame) -> DataFrame:
    """id and the eight compared amounts."""
    return slips.select("id", *amounts())


def field_matches(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """id, field, match: each amount within the tolerance; a missing one does not match."""
    long = lambda df, name: df.unpivot("id", FIELDS, "field", name)
    near = F.abs(F.col("expected") - F.col("actual")) <= TOLERANCE
    return long(expected, "expected").join(long(actual, "actual"), ["id", "field"], "left").select("id", "field", F.coalesce(near, F.lit(False)).alias("match"))
