"""Row validation, itemised findings and dataset summaries.

The first failing check names the finding and the row stops there. The key of a row is claimed right after the
read-point check, so a row rejected later (unit, value) still makes the next one with its key a duplicate.
"""

from __future__ import annotations

from dataclasses import dataclass
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lotwise import constants as K
from lotwise.functions import robust as R
from lotwise.operators import series as S

KEY = ["component_id", "parameter", "elapsed_hours"]

# Rejection class and action of each finding
ERROR_CLASS = {
    "SCHEMA_VIOLATION": "SCHEMA",
    "RANGE_VIOLATION": "RANGE",
    "UNIT_MISMATCH": "UNIT",
    "DUPLICATE_KEY": "DUPLICATE",
    "READPOINT_OUT_OF_GRID": "RANGE",
    "NOT_MEASURED_ROW": "SCHEMA",
}
ACTIONS = {
    "SCHEMA_VIOLATION": "rows rejected; fix the schema and re-upload",
    "RANGE_VIOLATION": "rows rejected; value outside the plausible range",
    "UNIT_MISMATCH": "rows rejected; resubmit with units matching the profile",
    "DUPLICATE_KEY": "first occurrence retained; duplicates recorded",
    "READPOINT_OUT_OF_GRID": "rows rejected; only screening-grid hours are decision inputs",
    "NOT_MEASURED_ROW": "row not stored; missing evidence surfaced, never imputed",
    "CENSORED_READING": "retained as censored; not coerced to zero or to the limit",
    "NON_MONOTONIC_TIME": "accepted_with_warning",
    "SINGLE_PART_LOT": "reported; analysis defers to absolute limits for n < 3",
    "MISSING_READPOINT": "reported; analysis returns INSUFFICIENT_DATA, never imputes",
}
SAMPLES = 5


@dataclass(frozen=True)
class Profile:
    """Validation side of a screening profile: (low, high, unit) per parameter and the read-point grid."""

    limits: dict[str, tuple[float | None, float | None, str]]
    grid: tuple[int, ...] = K.SCREENING_GRID
    parameters: tuple[str, ...] = K.PARAMETERS
    statuses: tuple[str, ...] = K.STATUSES
    provenance: str | None = K.PROVENANCE

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(p, low, high, unit) for p, (low, high, unit) in self.limits.items()]
        return spark.createDataFrame(rows, "parameter string, limit_low double, limit_high double, limit_unit string")


def as_text(c: Column) -> Column:
    return F.nullif(F.trim(c.cast("string")), F.lit(""))


def as_number(df: DataFrame, name: str) -> Column:
    if dict(df.dtypes)[name] == "string":
        return F.trim(F.col(name)).try_cast("double")
    return F.col(name).cast("double")


def _optional_text(df: DataFrame, name: str) -> Column:
    return as_text(F.col(name)) if name in df.columns else F.lit(None).cast("string")


def _optional_number(df: DataFrame, name: str) -> Column:
    return as_number(df, name) if name in df.columns else F.lit(None).cast("double")


def structural_checks(df: DataFrame, profile: Profile, spark: SparkSession, also: Mapping[str, Column] | None = None) -> DataFrame:
    """Coerced columns plus ``finding_code``/``finding_column`` of the checks before the key is claimed.

    ``also`` names further columns to keep.
    """
    hours = as_number(df, "elapsed_hours")
    rows = df.select(
        F.col("source_row").cast("long").alias("source_row"),
        *[as_text(F.col(c)).alias(c) for c in ("component_id", "lot_id", "component_type", "parameter", "status")],
        as_text(F.col("measurement_unit")).alias("unit"),
        F.when(R.finite(hours) & (hours == F.floor(hours)), hours.cast("long")).alias("elapsed_hours"),
        as_number(df, "measurement_value").alias("value"),
        *[_optional_number(df, c).alias(c) for c in ("temperature_c", "voltage_v")],
        *[_optional_text(df, c).alias(c) for c in ("read_timestamp", "board_id", "socket_id", "thermal_zone", "tester_id", "data_provenance")],
        *[c.alias(name) for name, c in (also or {}).items()],
    )
    missing = F.coalesce(
        *[
            F.when(F.col(stored).isNull(), F.lit(source))
            for stored, source in (
                ("component_id", "component_id"), ("lot_id", "lot_id"), ("component_type", "component_type"),
                ("parameter", "parameter"), ("status", "status"), ("unit", "measurement_unit"),
            )
        ]
    )
    known = F.col("parameter").isin(*profile.parameters)
    status_ok = F.col("status").isin(*profile.statuses)
    hour = F.col("elapsed_hours")
    column = (
        F.when(missing.isNotNull(), missing)
        .when(~known, "parameter")
        .when(~status_ok, "status")
        .when(hour.isNull() | ~hour.isin(*profile.grid), "elapsed_hours")
    )
    code = F.when(missing.isNotNull() | ~known | ~status_ok | hour.isNull(), "SCHEMA_VIOLATION").when(
        ~hour.isin(*profile.grid), "READPOINT_OUT_OF_GRID"
    )
    detail = (
        F.when(missing.isNotNull(), F.format_string("missing required field '%s'", missing))
        .when(~known, F.format_string("unknown parameter '%s'", "parameter"))
        .when(~status_ok, F.format_string("unknown status '%s'", "status"))
        .when(hour.isNull(), "elapsed_hours is not an integer")
        .when(~hour.isin(*profile.grid), F.format_string("elapsed_hours %d is outside the screening grid", hour))
    )
    # A generator makes the code a real column, so that filters on it don't repeat all checks for each of their uses.
    rows = rows.select("*", F.explode(F.array(code)).alias("finding_code"))
    return rows.withColumn("finding_column", column).withColumn("finding_detail", detail)


def validate(df: DataFrame, profile: Profile) -> DataFrame:
    """Every source row with its finding (``finding_code`` NULL means accepted) and a ``censored`` mark.

    The first row of a key is found by a minimum combined before the shuffle, so a key that fills the file is no
    hot spot, and rows are matched to it by (key, row).
    """
    rows = structural_checks(df, profile, df.sparkSession)
    return judge(rows, first_claims(rows), profile)


def first_claims(rows: DataFrame) -> DataFrame:
    """The row that claims each key: the first without a structural finding."""
    return rows.filter("finding_code IS NULL").groupBy(*KEY).agg(F.min("source_row").alias("source_row"))


def judge(rows: DataFrame, claims: DataFrame, profile: Profile) -> DataFrame:
    """Structurally checked rows with the findings that come after the key is claimed; ``claims`` holds KEY, source_row."""
    spark = rows.sparkSession
    rows = rows.join(claims.select(*KEY, "source_row").withColumn("_first", F.lit(True)), [*KEY, "source_row"], "left")
    rows = rows.join(F.broadcast(profile.table(spark)), "parameter", "left")
    value, status = F.col("value"), F.col("status")
    open_ = F.col("finding_code").isNull()
    duplicate = open_ & F.col("_first").isNull()
    unit = F.col("limit_unit").isNotNull() & (F.col("unit") != F.col("limit_unit"))
    unmeasured = status == "NOT_MEASURED"
    censored = status.isin("BELOW_LOD", "OVERRANGE")
    foreign = (
        F.col("data_provenance").isNotNull() & (F.col("data_provenance") != profile.provenance)
        if profile.provenance
        else F.lit(False)
    )
    checks = [
        (duplicate, "DUPLICATE_KEY", "component_id", F.lit("duplicate (component_id, parameter, elapsed_hours)")),
        (unit, "UNIT_MISMATCH", "measurement_unit", F.format_string("'%s' where '%s' expected", "unit", "limit_unit")),
        (unmeasured, "NOT_MEASURED_ROW", "measurement_value", F.lit("NOT_MEASURED carries no value")),
        (~R.finite(value), "RANGE_VIOLATION", "measurement_value", F.lit("measurement_value is missing or non-finite")),
        (F.abs(value) > K.IMPLAUSIBLE_ABS, "RANGE_VIOLATION", "measurement_value", F.lit("value exceeds the plausible range")),
        (foreign, "SCHEMA_VIOLATION", "data_provenance", F.lit("data_provenance has an unexpected value")),
    ]
    reached_status = open_
    for condition, *_ in checks[:5]:
        reached_status = reached_status & ~F.coalesce(condition, F.lit(False))
    code, column, detail = F.col("finding_code"), F.col("finding_column"), F.col("finding_detail")
    new_code, new_column, new_detail = F.when(~open_, code), F.when(~open_, column), F.when(~open_, detail)
    for condition, name, where, text in checks:
        new_code = new_code.when(condition, name)
        new_column = new_column.when(condition, where)
        new_detail = new_detail.when(condition, text)
    return (
        rows.withColumn("censored", F.coalesce(reached_status & censored, F.lit(False)))
        .withColumn("_c", new_code)
        .withColumn("_k", new_column)
        .withColumn("_d", new_detail)
        .drop("finding_code", "finding_column", "finding_detail", "_first")
        .withColumnsRenamed({"_c": "finding_code", "_k": "finding_column", "_d": "finding_detail"})
    )


STORED = [
    "component_id", "lot_id", "component_type", "parameter", "elapsed_hours", "value", "unit", "status",
    "temperature_c", "voltage_v", "board_id", "socket_id", "thermal_zone", "tester_id", "source_row",
]


def accepted(validated: DataFrame) -> DataFrame:
    return validated.filter("finding_code IS NULL").select(*STORED)


def non_monotonic(rows: DataFrame) -> DataFrame:
    """First row of each (component, parameter) whose timestamps go back as the hours advance."""
    stamped = rows.filter(F.col("read_timestamp").isNotNull())
    w = Window.partitionBy("component_id", "parameter").orderBy("elapsed_hours")
    # The key is unique here, so a series holds at most one row per read-point of the grid.
    back = stamped.withColumn("_back", F.lag("read_timestamp").over(w) > F.col("read_timestamp"))
    return (
        back.groupBy("component_id", "parameter")
        .agg(F.max("_back").alias("_back"), F.min_by("source_row", "elapsed_hours").alias("source_row"))
        .filter("_back")
        .drop("_back")
    )


def series_presence(rows: DataFrame, grid: Sequence[int]) -> DataFrame:
    """Read-points of the grid that a series lacks."""
    grid_array = F.array(*[F.lit(int(g)).cast("long") for g in grid])
    return rows.groupBy("component_id", "lot_id", "component_type", "parameter").agg(
        F.array_sort(F.array_except(grid_array, F.collect_set("elapsed_hours"))).alias("missing_hours")
    )


# What occurrences need of validated rows
OCCURRING = [
    "source_row", "component_id", "lot_id", "component_type", "parameter", "elapsed_hours", "status", "read_timestamp", "censored",
    "finding_code", "finding_column", "finding_detail",
]


def occurrences(validated: DataFrame, profile: Profile) -> DataFrame:
    """One row per finding occurrence: code, source_row, column, detail, lot."""
    ok = validated.filter("finding_code IS NULL")
    cols = ["code", "source_row", "column", "detail", "lot_id"]
    rejected = validated.filter("finding_code IS NOT NULL").select(
        F.col("finding_code").alias("code"), "source_row", F.col("finding_column").alias("column"),
        F.col("finding_detail").alias("detail"), "lot_id",
    )
    held = validated.filter("censored").select(
        F.lit("CENSORED_READING").alias("code"), "source_row", F.lit("status").alias("column"),
        F.concat("status", F.lit(" retained as censored")).alias("detail"), "lot_id",
    )
    times = non_monotonic(ok).select(
        F.lit("NON_MONOTONIC_TIME").alias("code"), "source_row", F.lit("read_timestamp").alias("column"),
        F.format_string("read_timestamp not monotonic for %s/%s", "component_id", "parameter").alias("detail"),
        F.lit(None).cast("string").alias("lot_id"),
    )
    singles = (
        ok.groupBy("lot_id").agg(F.min("component_id").alias("_a"), F.max("component_id").alias("_b")).filter("_a = _b")
    ).select(
        F.lit("SINGLE_PART_LOT").alias("code"), F.lit(0).cast("long").alias("source_row"), F.lit("lot_id").alias("column"),
        F.format_string("lot %s holds a single part", "lot_id").alias("detail"), "lot_id",
    )
    gaps = series_presence(ok, profile.grid).filter(F.size("missing_hours") > 0).select(
        F.lit("MISSING_READPOINT").alias("code"), F.lit(0).cast("long").alias("source_row"),
        F.lit("elapsed_hours").alias("column"),
        F.format_string("%s/%s missing read-points %s", F.col("component_id"), F.col("parameter"), F.col("missing_hours").cast("string")).alias("detail"),
        "lot_id",
    )
    out = rejected.select(*cols)
    for part in (held, times, singles, gaps):
        out = out.unionByName(part.select(*cols))
    return out


def findings(occurred: DataFrame) -> DataFrame:
    """One row per code: severity, count, first column and detail, at most five sample rows and lots, action.

    Samples are cut by ``row_number <= 5``, which Spark applies before the shuffle, so no code is gathered whole.
    """
    first = F.min(F.struct("source_row", "column", "detail")).alias("_first")
    base = occurred.groupBy("code").agg(F.count(F.lit(1)).alias("count"), first)
    rows = (
        occurred.select("code", "source_row")
        .withColumn("_r", F.row_number().over(Window.partitionBy("code").orderBy("source_row")))
        .filter(F.col("_r") <= SAMPLES)
        .groupBy("code")
        .agg(F.array_sort(F.collect_list("source_row")).alias("sample_rows"))
    )
    lots = (
        occurred.filter(F.col("lot_id").isNotNull())
        .groupBy("code", "lot_id")
        .agg(F.min("source_row").alias("_at"))
        .withColumn("_r", F.row_number().over(Window.partitionBy("code").orderBy("_at", "lot_id")))
        .filter(F.col("_r") <= SAMPLES)
        .groupBy("code")
        .agg(F.array_sort(F.collect_list("lot_id")).alias("affected_lots"))
    )
    actions = F.create_map(*[F.lit(x) for pair in ACTIONS.items() for x in pair])
    return (
        base.join(rows, "code")
        .join(lots, "code", "left")
        .select(
            "code",
            F.when(F.col("code").isin(*ERROR_CLASS), "ERROR").otherwise("WARNING").alias("severity"),
            "count",
            F.col("_first.column").alias("column"),
            F.col("_first.detail").alias("detail"),
            F.coalesce(F.element_at(actions, F.col("code")), F.lit("reported")).alias("action"),
            "sample_rows",
            F.coalesce("affected_lots", F.array().cast("array<string>")).alias("affected_lots"),
        )
    )


def rejection_classes(validated: DataFrame) -> DataFrame:
    """Rejected rows per class; classes without any are kept with 0."""
    mapping = F.create_map(*[F.lit(x) for pair in ERROR_CLASS.items() for x in pair])
    counts = (
        validated.filter("finding_code IS NOT NULL")
        .groupBy(F.element_at(mapping, F.col("finding_code")).alias("class"))
        .agg(F.count(F.lit(1)).alias("rejected"))
    )
    domain = validated.sparkSession.createDataFrame([(c,) for c in K.REJECTION_CLASSES], "class string")
    return domain.join(counts, "class", "left").select("class", F.coalesce("rejected", F.lit(0)).alias("rejected"))


def grid_quality(validated: DataFrame, profile: Profile) -> DataFrame:
    """Quality of each (component, parameter) over the read-point grid: missing, impossible, censored, flat."""
    value = F.col("value")
    outside = F.coalesce(value < F.col("limit_low"), F.lit(False)) | F.coalesce(value > F.col("limit_high"), F.lit(False))
    good = F.when(~outside, value)
    out = (
        validated.filter("finding_code IS NULL")
        .groupBy("component_id", "lot_id", "component_type", "parameter")
        .agg(
            (F.lit(len(profile.grid)) - F.count(F.lit(1))).alias("n_missing"),
            F.count_if(outside).alias("n_impossible"),
            F.count_if(F.col("censored")).alias("n_censored"),
            F.count(good).alias("n_valid"),
            F.when((F.count(good) >= 2) & (F.min(good) == F.max(good)), 1).otherwise(0).alias("n_flatline"),
        )
    )
    counts = {
        "MISSING_OBSERVATION": F.col("n_missing"),
        "IMPOSSIBLE_VALUE": F.col("n_impossible"),
        "CENSORED_READING": F.col("n_censored"),
        "FLATLINE": F.col("n_flatline"),
    }
    return out.withColumn("score", S.quality_score(counts, F.col("n_valid"))).withColumn(
        "findings", S.quality_findings(counts)
    )


def lot_summary(validated: DataFrame, occurred: DataFrame, quality: DataFrame) -> DataFrame:
    """Per lot with accepted rows: parts, accepted and rejected rows, mean quality, finding codes."""
    ok = validated.filter("finding_code IS NULL")
    lots = ok.groupBy("lot_id").agg(
        F.min_by("component_type", "source_row").alias("component_type"), F.count(F.lit(1)).alias("rows_accepted")
    )
    parts = ok.select("lot_id", "component_id").distinct().groupBy("lot_id").agg(F.count(F.lit(1)).alias("n_parts"))
    rejected = (
        validated.filter("finding_code IS NOT NULL AND lot_id IS NOT NULL")
        .groupBy("lot_id")
        .agg(F.count(F.lit(1)).alias("rows_rejected"))
    )
    codes = occurred.groupBy("lot_id").agg(F.array_sort(F.collect_set("code")).alias("finding_codes"))
    score = S.quality_rollup(quality, ["lot_id"]).select("lot_id", "quality_score")
    return (
        lots.join(parts, "lot_id")
        .join(rejected, "lot_id", "left")
        .join(codes, "lot_id", "left")
        .join(score, "lot_id", "left")
        .select(
            "lot_id", "component_type", "n_parts", "rows_accepted",
            F.coalesce("rows_rejected", F.lit(0)).alias("rows_rejected"), "quality_score",
            F.coalesce("finding_codes", F.array().cast("array<string>")).alias("finding_codes"),
        )
    )


def decide(classes: DataFrame, found: DataFrame, rows_accepted: int) -> str:
    """Driver decision over a handful of rows: ACCEPTED, UNIT_MISMATCH or VALIDATION_FAILED."""
    if rows_accepted > 0:
        return "ACCEPTED"
    codes = {r["code"] for r in found.select("code").collect()}
    return "UNIT_MISMATCH" if codes == {"UNIT_MISMATCH"} else "VALIDATION_FAILED"


def validate_store(stored: DataFrame, manifest_rows: Column | int, provenance: Column | None = None,
                   grid: Sequence[int] = K.SCREENING_GRID) -> DataFrame:
    """Re-check stored rows: count against the manifest, late hours, repeated keys, provenance."""
    totals = stored.agg(
        F.count(F.lit(1)).alias("_n"),
        F.count_if(~F.col("elapsed_hours").isin(*grid)).alias("_late"),
        (F.count_if(provenance) if provenance is not None else F.lit(0)).alias("_foreign"),
    )
    repeats = stored.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_c")).filter("_c > 1").agg(F.count(F.lit(1)).alias("_d"))
    expected = F.lit(manifest_rows) if isinstance(manifest_rows, int) else manifest_rows
    one = totals.withColumn("_j", F.lit(1)).join(F.broadcast(repeats.withColumn("_j", F.lit(1))), "_j")
    items = F.array(
        F.struct(F.lit("ROW_COUNT_MISMATCH").alias("code"), F.abs(F.col("_n") - expected).cast("long").alias("count")),
        F.struct(F.lit("LATE_OBSERVATION_PRESENT").alias("code"), F.col("_late").cast("long").alias("count")),
        F.struct(F.lit("DUPLICATE_KEY_IN_STORE").alias("code"), F.col("_d").cast("long").alias("count")),
        F.struct(F.lit("PROVENANCE_VIOLATION").alias("code"), F.col("_foreign").cast("long").alias("count")),
    )
    return one.select(F.explode(items).alias("f")).select("f.code", "f.count", (F.col("f.count") == 0).alias("passed"))


def row_digest() -> Column:
    """SHA-256 of a row's identity and value; independent of row order, file format and other columns."""
    fields = ("component_id", "lot_id", "component_type", "parameter", "elapsed_hours", "value", "unit", "status")
    return F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in fields]), 256)


def dataset_digest(rows: DataFrame, keys: Sequence[str] = (), digest: Column | None = None) -> DataFrame:
    """Content digest of a multiset of rows: four 60-bit lanes of the row digests are summed.

    Sums combine before the shuffle and in any order, so no partition ever gathers the row digests.
    """
    lanes = rows.select(*keys, (digest if digest is not None else row_digest()).alias("_h"))
    sums = [
        F.sum(F.conv(F.substring("_h", 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).alias(f"_l{i}") for i in range(4)
    ]
    out = lanes.groupBy(*keys).agg(F.count(F.lit(1)).alias("row_count"), *sums)
    text = F.concat_ws("|", F.col("row_count").cast("string"), *[F.col(f"_l{i}").cast("string") for i in range(4)])
    return out.select(*keys, "row_count", F.concat(F.lit("sha256:"), F.sha2(text, 256)).alias("dataset_hash"))
