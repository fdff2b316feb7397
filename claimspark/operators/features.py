"""The per-claim feature groups: claim level, clinical, provider and facility, payer; and the table of all of them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimspark.functions import scalars as S
from claimspark.functions.reference import PROCEDURES
from claimspark.plans.joins import any_interval, asof, keyed_upsert, longest_prefix
from claimspark.plans.views import cut
from claimspark.plans.windows import leave_one_out, trailing_cube, trailing_rate

# The names of the features.
INS = ("ins_type_medicare", "ins_type_medicaid", "ins_type_commercial", "ins_type_tricare", "ins_type_champva", "ins_type_other")
TYP = ("claim_type_professional", "claim_type_institutional")
ADM = ("adm_type_emergency", "adm_type_elective", "adm_type_urgent", "adm_type_trauma")
SRC = ("adm_src_physician_referral", "adm_src_transfer_hospital", "adm_src_transfer_snf", "adm_src_er", "adm_src_court_law", "adm_src_not_available")
#: The 37 numeric features, in the order of the model's vector.
NUMERIC = (
    "claim_submission_date_doy", "claim_submission_date_month", "patient_age", "gender", *INS, *TYP, *ADM, *SRC, "billing_provider_id_encoded", "provider_historical_denial_rate", "provider_claim_volume",
    "facility_bed_size", "principal_dx_ccs_category", "secondary_dx_count", "length_of_stay", "comorbidity_risk_score", "diagnosis_procedure_mismatch", "payer_historical_denial_rate",
    "payer_historical_denial_rate_by_type", "days_since_last_payment", "payer_contract_stop_loss", "documents_medical_necessity", "mentions_lack_of_pre_auth",
)


#: What a claim carries from the link to its encounter.
FLAGS = ("partial_ehr_flag", "ehr_null_match_flag")


def claim_level(claims: DataFrame, at: str = "submission_date") -> DataFrame:
    """The claim's own features, and those of FLAGS that the claims have."""
    return claims.select("claim_id", *claim_level_columns(at), *(c for c in FLAGS if c in claims.columns))


def claim_level_columns(at: str = "submission_date") -> list[Column]:
    doy, month = S.date_features(F.col("submission_date"))
    return [
        doy.alias(NUMERIC[0]), month.alias(NUMERIC[1]), S.age_years(F.col("date_of_birth"), F.col(at)).alias("patient_age"), S.gender_code(F.col("gender")).alias("gender"),
        *S.one_hot(F.col("insurance_type"), S.INSURANCE_TYPES, INS), *S.one_hot(F.col("claim_type"), S.CLAIM_TYPES, TYP), *S.one_hot(F.col("admission_type"), S.ADMISSION_TYPES, ADM), *S.one_hot(F.col("admission_source"), S.ADMISSION_SOURCES, SRC),
    ]


def procedure_sets(codes: DataFrame, procedures: DataFrame, length: int = PROCEDURES) -> DataFrame:
    """(claim_id, _set): the indices below ``length`` that codes of the claim have. codes: claim_id, cpt."""
    known = procedures.filter(F.col("idx").between(0, length - 1))
    return codes.select("claim_id", S.utrim0(F.col("cpt")).alias("cpt")).join(known, "cpt").groupBy("claim_id").agg(F.collect_set("idx").alias("_set"))


def vector_of(indices: str, length: int = PROCEDURES) -> Column:
    """A bit for each number below ``length``: whether it is among the indices."""
    return F.transform(F.sequence(F.lit(0), F.lit(length - 1)), lambda i: F.coalesce(F.array_contains(indices, i), F.lit(False)).cast("int"))


def procedure_vector(claims: DataFrame, codes: DataFrame, procedures: DataFrame, length: int = PROCEDURES) -> DataFrame:
    """(claim_id, procedure_vector): a bit for each index that any code of the claim has. codes: claim_id, cpt."""
    return claims.select("claim_id").join(procedure_sets(codes, procedures, length), "claim_id", "left").select("claim_id", vector_of("_set", length).alias("procedure_vector"))


def comorbidity(claims: DataFrame, diagnoses: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(claim_id, comorbidity_risk_score): weights of the distinct longest prefixes. diagnoses: claim_id, code."""
    return claims.select("claim_id").join(comorbidity_totals(diagnoses, prefixes), "claim_id", "left").select("claim_id", F.coalesce("_w", F.lit(0)).alias("comorbidity_risk_score"))


def comorbidity_totals(diagnoses: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(claim_id, _w) of the claims that have a listed prefix. Distinct codes are matched once, not once a claim."""
    codes = diagnoses.select("claim_id", S.norm_icd10(F.col("code")).alias("code")).filter("code is not null").distinct()
    matched = longest_prefix(codes.select("code").distinct(), "code", prefixes)
    return codes.join(matched, "code").select("claim_id", "prefix", "weight").distinct().groupBy("claim_id").agg(F.sum("weight").cast("int").alias("_w"))


#: What clinical() gives, in this order.
CLINICAL = ("principal_dx_ccs_category", "secondary_dx_count", "length_of_stay", "comorbidity_risk_score", "procedure_vector", "diagnosis_procedure_mismatch")
#: So many distinct codes with a listed prefix at most, as the claims write them, are sent as one map; each claim looks its codes up there.
MAP_CODES = 256


def clinical(claims: DataFrame, ccs: DataFrame, procedures: DataFrame, prefixes: DataFrame, expected: DataFrame) -> DataFrame:
    """claims: claim_id, principal_icd10_code, secondary_icd10_codes, cpt_codes, admission_date, discharge_date."""
    return clinical_rows(claims, claims, ccs, procedures, prefixes, expected).select("claim_id", *CLINICAL)


def clinical_rows(rows: DataFrame, claims: DataFrame, ccs: DataFrame, procedures: DataFrame, prefixes: DataFrame, expected: DataFrame) -> DataFrame:
    """rows with the columns of CLINICAL in place of their own of these names. rows: the claims, with any more columns.

    What a claim's codes are worth is found in its own row, by maps of the reference tables; no claims are shuffled for it while
    the codes with a prefix are few.
    """
    # one row of the reference table: the indices of each code
    known = procedures.filter(F.col("cpt").isNotNull() & F.col("idx").between(0, PROCEDURES - 1)).groupBy("cpt").agg(F.collect_set("idx").alias("i"))
    known = known.agg(F.map_from_entries(F.collect_list(F.struct("cpt", "i"))).alias("_known"))
    own = F.array_distinct(F.flatten(F.array_compact(F.transform("cpt_codes", lambda c: F.try_element_at("_known", S.utrim0(c))))))
    rows = rows.drop(*CLINICAL).crossJoin(F.broadcast(known)).withColumns({"_icd10": S.norm_icd10(F.col("principal_icd10_code")), "_set": own})
    codes = claims.select(F.explode("secondary_icd10_codes").alias("_raw")).distinct().select("_raw", S.norm_icd10(F.col("_raw")).alias("code")).filter("code is not null")
    matched = cut(longest_prefix(codes, "code", prefixes))
    if matched.count() <= MAP_CODES:
        worth = matched.agg(F.map_from_entries(F.collect_list(F.struct("_raw", F.struct("prefix", "weight")))).alias("_worth"))
        met = F.array_distinct(F.array_compact(F.transform("secondary_icd10_codes", lambda c: F.try_element_at("_worth", c))))
        total = F.aggregate(met, F.lit(0).cast("long"), lambda a, x: a + F.coalesce(x["weight"], F.lit(0)))
        rows = rows.crossJoin(F.broadcast(worth)).withColumn("_w", total.cast("int"))
    else:
        secondary = claims.select("claim_id", F.explode("secondary_icd10_codes").alias("code"))
        rows = rows.join(comorbidity_totals(secondary, prefixes), "claim_id", "left")
    ccs = cut(ccs.select(F.col("icd10").alias("_code"), F.col("category").alias("_category")))
    ccs = F.broadcast(ccs) if ccs.count() <= SEND_ROWS else ccs
    rows = rows.join(ccs, F.col("_icd10") == F.col("_code"), "left").withColumn("_category", F.coalesce("_category", F.lit(0)))
    rows = rows.join(expected.select(F.col("category").alias("_of"), F.col("indices").alias("_indices")), F.col("_category") == F.col("_of"), "left")
    overlap = F.coalesce(F.arrays_overlap("_indices", "_set"), F.lit(False))
    made = (
        F.col("_category"), S.size0(F.col("secondary_icd10_codes")), S.length_of_stay(F.col("admission_date"), F.col("discharge_date")), F.coalesce("_w", F.lit(0)),
        vector_of("_set"), F.when(F.col("_indices").isNotNull() & ~overlap, 1).otherwise(0),
    )
    rows = rows.withColumns(dict(zip(CLINICAL, made, strict=True)))
    return rows.drop("_known", "_worth", "_icd10", "_set", "_w", "_code", "_category", "_of", "_indices")


def specialty(npi: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """npi rows with ``provider_specialty_code``: the taxonomy's code, UNKNOWN where absent or blank. taxonomy: npi, code."""
    codes = taxonomy.select(F.col("npi").alias("_npi"), F.col("code").alias("_code"))
    return npi.join(codes, F.col("provider_npi") == F.col("_npi"), "left").withColumn("provider_specialty_code", F.coalesce(F.nullif(F.trim("_code"), F.lit("")), F.lit("UNKNOWN"))).drop("_npi", "_code")


def bed_size(rows: DataFrame, facility: DataFrame) -> DataFrame:
    """rows with ``facility_bed_size``: the facility's, else the mean of all rounded half to even, else 0. facility: npi, bed_size."""
    mean = facility.agg(F.coalesce(F.bround(F.avg("bed_size"), 0).cast("int"), F.lit(0)).alias("_mean"))
    own = facility.select(F.col("npi").alias("_npi"), F.col("bed_size").alias("_bed"))
    return rows.join(own, F.col("provider_npi") == F.col("_npi"), "left").crossJoin(F.broadcast(mean)).withColumn("facility_bed_size", F.coalesce("_bed", "_mean")).drop("_npi", "_bed", "_mean")


def provider_facility(claims: DataFrame, taxonomy: DataFrame, facility: DataFrame) -> DataFrame:
    """(claim_id, provider_specialty_code, facility_bed_size) of each claim's provider."""
    return bed_size(specialty(claims.select("claim_id", "provider_npi"), taxonomy), facility).select("claim_id", "provider_specialty_code", "facility_bed_size")


def provider(claims: DataFrame) -> DataFrame:
    """Trailing 90-day features by provider, on each claim's own date. The claim's own outcome counts, but for the encoding."""
    name = "provider_historical_denial_rate"
    rated = trailing_rate(claims, ["provider_npi"], 30, 0.0, name)
    return rated.select("claim_id", "provider_npi", name, leave_one_out(name).alias("billing_provider_id_encoded"), F.coalesce(f"{name}_volume", F.lit(0)).alias("provider_claim_volume"))


def days_since_payment(claims: DataFrame, era: DataFrame) -> DataFrame:
    """claims with ``days_since_last_payment``: from the payer's last paid day on or before the claim; 0 if paid only later; -1 if never."""
    paid = cut(era.filter("status = 'paid'").select("payer_name", "payment_date").distinct())  # a row for each payer and day, read twice
    ever = paid.groupBy(F.col("payer_name").alias("_payer")).agg(F.min("payment_date").alias("_first"))
    # a payer's days, not its claims, meet in one window
    seen = asof(claims.select("payer_name", "submission_date").distinct(), paid, ["payer_name"], "submission_date", "payment_date", F.col("payment_date"), "_paid", strict=False)
    seen = seen.join(ever, F.col("payer_name") == F.col("_payer"), "left")
    days = F.when(F.col("_paid").isNotNull(), F.datediff("submission_date", "_paid")).when(F.col("_first").isNotNull(), 0).otherwise(-1)
    seen = seen.select(F.col("payer_name").alias("_payer"), F.col("submission_date").alias("_day"), days.alias("days_since_last_payment"))
    return claims.join(seen, F.col("payer_name").eqNullSafe(F.col("_payer")) & F.col("submission_date").eqNullSafe(F.col("_day")), "left").drop("_payer", "_day")


def payer(claims: DataFrame, era: DataFrame, contracts: DataFrame) -> DataFrame:
    """era: payer_name, payment_date, status; contracts: payer_name, start, end (null: open), stop_loss."""
    typed = claims.select("claim_id", "payer_name", "submission_date", F.lower("adjudication_outcome").alias("adjudication_outcome"), F.coalesce(F.lower("claim_type"), F.lit("")).alias("type"))
    rows = trailing_rate(typed, ["payer_name"], 50, 0.5, "payer_historical_denial_rate")
    rows = trailing_rate(rows, ["payer_name", "type"], 50, 0.5, "payer_historical_denial_rate_by_type")
    rows = any_interval(days_since_payment(rows, era), contracts, "payer_name", "submission_date", "stop_loss", "payer_contract_stop_loss")
    return rows.select("claim_id", "payer_historical_denial_rate", "payer_historical_denial_rate_by_type", "days_since_last_payment", "payer_contract_stop_loss")


#: Tables of at most so many rows are sent to all tasks.
SEND_ROWS = 200_000


def behaviour(claims: DataFrame, era: DataFrame, contracts: DataFrame, *more: Column) -> DataFrame:
    """What provider() and payer() give, with ``more`` columns of the claims, by one day cube."""
    outcome, kind = F.col("adjudication_outcome"), F.coalesce(F.lower("claim_type"), F.lit(""))
    number = lambda test: F.coalesce(test.cast("int"), F.lit(0))
    counts = {
        "known": number(outcome.isin("paid", "denied")), "denied": number(outcome == "denied"), "volume": F.lit(1),
        "known_any": number(F.lower(outcome).isin("paid", "denied")), "denied_any": number(F.lower(outcome) == "denied"),
    }
    met = trailing_cube(claims.withColumn("_type", kind), {"all": (), "provider": ("provider_npi",), "payer": ("payer_name",), "type": ("payer_name", "_type")}, counts)
    days = cut(claims.select("payer_name", "submission_date").distinct())  # a row for each payer and day
    found = cut(any_interval(days_since_payment(days, era), contracts, "payer_name", "submission_date", "stop_loss", "payer_contract_stop_loss"))
    found = found.select(F.col("payer_name").alias("_p"), F.col("submission_date").alias("_d"), "days_since_last_payment", "payer_contract_stop_loss")
    found = F.broadcast(found) if found.count() <= SEND_ROWS else found
    met = met.join(found, F.col("payer_name").eqNullSafe(F.col("_p")) & F.col("submission_date").eqNullSafe(F.col("_d")))

    def rate(name: str, suffix: str, least: int, default: float) -> tuple[Column, Column]:
        """(own rate from ``least`` known claims on, else everyone's; everyone's)."""
        share = lambda of: F.col(f"{of}_denied{suffix}").cast("double") / F.nullif(F.col(f"{of}_known{suffix}"), F.lit(0))
        everyone = F.coalesce(share("all"), F.lit(default))
        return F.when(F.col(f"{name}_known{suffix}") >= least, share(name)).otherwise(everyone), everyone

    name = "provider_historical_denial_rate"
    own, everyone = rate("provider", "", 30, 0.0)
    met = met.withColumns({name: own, f"{name}_population": everyone, f"{name}_known": F.col("provider_known"), f"{name}_denied": F.col("provider_denied")})
    return met.select(
        "claim_id", *more, name, leave_one_out(name).alias("billing_provider_id_encoded"), F.coalesce("provider_volume", F.lit(0)).alias("provider_claim_volume"),
        rate("payer", "_any", 50, 0.5)[0].alias("payer_historical_denial_rate"), rate("type", "_any", 50, 0.5)[0].alias("payer_historical_denial_rate_by_type"),
        "days_since_last_payment", "payer_contract_stop_loss",
    )


def unknown_payers(claims: DataFrame, contracts: DataFrame) -> DataFrame:
    return claims.select("payer_name").distinct().join(contracts.select("payer_name"), "payer_name", "left_anti")


def link_encounters(claims: DataFrame, encounters: DataFrame) -> DataFrame:
    """claims with ``encounter_id`` of the patient's latest encounter strictly before the claim (least id of a day), and ehr_null_match_flag."""
    one = encounters.groupBy("patient_account_number", "encounter_date").agg(F.min("encounter_id").alias("encounter_id"))
    rows = asof(claims, one, ["patient_account_number"], "submission_date", "encounter_date", F.col("encounter_id"), "encounter_id", strict=True)
    return rows.withColumn("ehr_null_match_flag", F.col("encounter_id").isNull().cast("int"))


def attach_encounters(linked: DataFrame, encounters: DataFrame) -> DataFrame:
    """linked claims with the matched encounter's other columns."""
    return linked.join(encounters, ["patient_account_number", "encounter_id"], "left")


def attach_notes(linked: DataFrame, notes: DataFrame, order: tuple[str, ...] = ("note_datetime",), columns: tuple[str, ...] = ("note_type", "text")) -> DataFrame:
    """linked claims with ``clinical_notes``, the notes of the matched encounter in order; an empty array where there are none."""
    fields = list(dict.fromkeys((*order, *columns)))
    per = notes.groupBy("encounter_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("clinical_notes"))
    rows = linked.join(per, "encounter_id", "left")
    return rows.withColumn("clinical_notes", F.coalesce("clinical_notes", F.array().cast(per.schema["clinical_notes"].dataType)))


def link_outcomes(store: DataFrame, era: DataFrame) -> DataFrame:
    """store with outcome and its time from the last era row of each claim; unknown claims get a row. era: claim_id, adjudication_status, processed."""
    last = era.groupBy("claim_id").agg(F.max(F.struct("processed", "adjudication_status")).alias("x")).select("claim_id", F.col("x.adjudication_status").alias("adjudication_outcome"), F.col("x.processed").alias("adjudication_timestamp"))
    return keyed_upsert(store, last, "claim_id")


def quality_flag(columns: tuple[str, ...] = NUMERIC) -> Column:
    nulls = [F.col(c).isNull() for c in columns]
    some = nulls[0]
    for x in nulls[1:]:
        some = some | x
    return F.when(some, "degraded")


def impute(df: DataFrame, columns: tuple[str, ...] = NUMERIC) -> DataFrame:
    """df with nulls of ``columns`` as 0, and null arrays of any column as empty ones."""
    empty = {f.name: F.coalesce(F.col(f.name), F.array().cast(f.dataType)) for f in df.schema if f.dataType.typeName() == "array"}
    return df.withColumns(empty | {c: F.coalesce(F.col(c), F.lit(0).cast(df.schema[c].dataType)) for c in columns if c in df.columns})


def feature_table(claims: DataFrame, era: DataFrame, contracts: DataFrame, *groups: DataFrame, within: Callable[[DataFrame], DataFrame] | None = None, carried: tuple[str, ...] = ()) -> DataFrame:
    """One wide row a claim of the claims view: all groups. What the view has ready is taken over.

    The claims are read more than once, so hand in a stored frame of them.

    ``within`` adds columns to the rows where they are, as clinical_rows(), specialty() and bed_size() do, and may replace what
    the view has ready; ``carried`` are the columns of the claims that it needs, which aren't returned. ``groups`` are frames
    with a row a claim from elsewhere, joined by claim_id; where they have a column that the view has ready, theirs is taken.
    With clinical_rows(), specialty() and bed_size() the table has all of NUMERIC.
    """
    ready = ("submission_date", "claim_status", "adjudication_outcome", "length_of_stay", "comorbidity_risk_score", "documents_medical_necessity", "mentions_lack_of_pre_auth", *FLAGS)
    taken = {c for g in groups for c in g.columns if c != "claim_id"}
    kept = (c for c in ready if c in claims.columns and c not in taken)
    out = behaviour(claims, era, contracts, *map(F.col, (*kept, *carried)), *claim_level_columns())
    out = within(out).drop(*carried) if within else out
    for group in groups:
        out = out.join(group, "claim_id")
    return out
