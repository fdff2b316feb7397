"""Column functions of claim intake and feature engineering. None raises on bad input: what can't be read is null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The categories of the one-hot columns, in order.
INSURANCE_TYPES = ("Medicare", "Medicaid", "Commercial", "TriCare", "ChampVA", "Other")
CLAIM_TYPES = ("Professional", "Institutional")
ADMISSION_TYPES = ("Emergency", "Elective", "Urgent", "Trauma")
ADMISSION_SOURCES = ("Physician Referral", "Transfer from Hospital", "Transfer from SNF", "Emergency Room", "Court/Law Enforcement", "Not Available")
#: Phrases of a missing prior authorization.
PRIOR_AUTH = (r"prior\s+authorization", r"pre[-\s]authorization", r"pre\s+authorization", r"auth\s+gap", r"prior\s+auth", r"preauth", r"authorization\s+required", r"not\s+authorized")


def trim0(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit("")))


def utrim0(c: Column) -> Column:
    return F.upper(trim0(c))


def code5(c: Column) -> Column:
    return F.substring(trim0(c), 1, 5)


def pad4(c: Column) -> Column:
    """A revenue code: no leading zeros, at least four digits; longer ones stay."""
    bare = F.ltrim(trim0(c), F.lit("0"))
    bare = F.when(bare == "", "0").otherwise(bare)
    return F.when(F.length(bare) < 4, F.lpad(bare, 4, "0")).otherwise(bare)


def npi_ok(c: Column) -> Column:
    return F.coalesce(F.trim(c).rlike("^[0-9]{10}$"), F.lit(False))


def norm_icd10(c: Column) -> Column:
    return F.trim(F.upper(F.replace(c, F.lit("."), F.lit(""))))


def x12_date(c: Column) -> Column:
    return F.when(F.length(F.trim(c)) == 8, F.try_to_date(F.trim(c), "yyyyMMdd"))


def x12_amount(c: Column) -> Column:
    return F.trim(c).try_cast("decimal(18,2)")


def x12_units(c: Column) -> Column:
    whole = F.trim(c).try_cast("double").try_cast("int")
    return F.when(whole.isNotNull(), F.greatest(F.lit(0), whole))


def sex(c: Column) -> Column:
    up = utrim0(c)
    return F.when(up.isin("M", "F"), up).otherwise("U")


def date_features(c: Column) -> tuple[Column, Column]:
    """(day of the year, month), both 0 without a date."""
    return F.coalesce(F.dayofyear(c), F.lit(0)), F.coalesce(F.month(c), F.lit(0))


def age_years(dob: Column, at: Column) -> Column:
    """Whole years, -1 where either date is absent; the birthday counts from its month and day on."""
    before = F.struct(F.month(at), F.dayofmonth(at)) < F.struct(F.month(dob), F.dayofmonth(dob))
    return F.coalesce(F.year(at) - F.year(dob) - F.when(before, 1).otherwise(0), F.lit(-1))


def gender_code(c: Column) -> Column:
    up = utrim0(c)
    return F.when(up == "M", 1).when(up == "F", 0).otherwise(-1)


def one_hot(c: Column, categories: tuple[str, ...], names: tuple[str, ...]) -> list[Column]:
    value = F.lower(trim0(c))
    return [(value == k.lower()).cast("int").alias(n) for k, n in zip(categories, names, strict=True)]


def size0(c: Column) -> Column:
    return F.coalesce(F.size(c), F.lit(0))


def length_of_stay(admitted: Column, discharged: Column) -> Column:
    return F.when(admitted.isNull() & discharged.isNull(), -2).when(admitted.isNull() | discharged.isNull(), -1).otherwise(F.greatest(F.datediff(discharged, admitted), F.lit(0)))


def clamp01(c: Column) -> Column:
    return F.greatest(F.least(c, F.lit(1.0)), F.lit(0.0))


def parse_ts_date(c: Column) -> Column:
    """The date that a timestamp text is written with, whatever its zone; null unless the whole text has a known shape."""
    shape = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?\s*(Z|[+-]\d{2}:?\d{2})?)?$"
    text = F.trim(c)
    return F.when(text.rlike(shape), F.try_to_date(F.substring(text, 1, 10), "yyyy-MM-dd"))


def phrase_flag(text: Column, patterns: tuple[str, ...] = PRIOR_AUTH) -> Column:
    return F.coalesce(text.rlike("(?i)" + "|".join(patterns)), F.lit(False)).cast("int")


def necessity_score(vector: Column) -> Column:
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return F.bround(clamp01(total / F.nullif(F.size(vector), F.lit(0))), 4)


# Fixed values of the next three: the thresholds of alerts and of the gate, and the minutes a run may take.
def alert_tier(precision: Column) -> Column:
    return F.when(precision < 0.80, "urgent").when(precision < 0.85, "degradation").otherwise("none")


def gate_stage(precision: Column, ece: Column) -> Column:
    return F.when((precision >= 0.90) & (ece <= 0.05), "Staging").otherwise("Failed")


def sla_breach(minutes: Column, limit: int = 240) -> Column:
    return minutes > limit


def to_pretty_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*"), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def missing_list(df: DataFrame, columns: list[str]) -> Column:
    """The names of columns that are null, comma-joined; null when none is."""
    return F.nullif(F.concat_ws(",", *(F.when(F.col(c).isNull(), F.lit(c)) for c in columns)), F.lit(""))
