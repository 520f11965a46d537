"""From raw to cleaned tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.operators import clean, features
from ledgerloom.operators.profile import ObservedProfile
from ledgerloom.sinks.writers import write_parquet, write_parquet_tables
from ledgerloom.sources import contracts, typed


# Tables whose last step looks at all repaired rows before it treats each of them.
TWO_PASS_TABLES = ("order_items", "products")

# Working tables of the cleaning job, below the cleaned folder.
REPAIRED_FOLDER = "_repaired"

# What the raw files hold that their types cannot: counts per column, and the fields with their
# records. Readers skip names with an underscore, so folders of tables can be listed.
CONFORMANCE_FOLDER = "_type_conformance"
QUARANTINE_FOLDER = "_quarantine"
# Rows and nulls of the cleaned tables.
PROFILE_FOLDER = "_profile"


def repair_table(name: str, df: DataFrame) -> DataFrame:
    """Fill missing dates and measures, repair types, translate payment types, then deduplicate."""
    if name == "orders":
        df = clean.impute_order_dates(df)
    elif name == "products":
        df = clean.impute_mode(df)
    elif name == "payments":
        df = clean.standardise_payment_types(df)
    if name in contracts.CORRECTED_TYPES:
        df = clean.cast_columns(df, contracts.CORRECTED_TYPES[name])
    return clean.deduplicate(df)


def finish_table(name: str, df: DataFrame, quantile_accuracy: int | None = None) -> DataFrame:
    """Derive order features; cut price outliers and band weights over rows that no longer repeat."""
    if name == "orders":
        return features.add_calendar(features.add_durations(df))
    if name == "order_items":
        return clean.drop_price_outliers(df, accuracy=quantile_accuracy)
    if name == "products":
        return clean.add_weight_band(df, accuracy=quantile_accuracy)
    return df


def clean_table(name: str, df: DataFrame, quantile_accuracy: int | None = None) -> DataFrame:
    """One table repaired and finished, as a lazy frame."""
    return finish_table(name, repair_table(name, df), quantile_accuracy)


def clean_tables(
    tables: Mapping[str, DataFrame], quantile_accuracy: int | None = None
) -> dict[str, DataFrame]:
    """All tables cleaned, as lazy frames."""
    return {name: clean_table(name, df, quantile_accuracy) for name, df in tables.items()}


def write_cleaned(
    tables: Mapping[str, DataFrame],
    cleaned_path: str,
    *,
    quantile_accuracy: int | None = None,
    **write_options,
) -> DataFrame:
    """Clean raw tables, overwrite one Parquet folder per table, return their profile.

    The profile (rows and nulls per column) is counted by the tasks that write.

    Quantiles need all rows of a table before its first row can be written. The
    tables concerned are written repaired and read back: the raw input is parsed
    and shuffled once instead of twice, the quantiles then read one column, and
    the price filter reaches the scan.
    """
    repaired = {name: repair_table(name, df) for name, df in tables.items()}
    staged = {name: repaired[name] for name in TWO_PASS_TABLES}
    staged_path = f"{cleaned_path.rstrip('/')}/{REPAIRED_FOLDER}"
    write_parquet_tables(staged, staged_path, {name: name for name in staged})
    for name, df in staged.items():
        repaired[name] = df.sparkSession.read.parquet(f"{staged_path}/{name}")
    finished = {name: finish_table(name, df, quantile_accuracy) for name, df in repaired.items()}
    profile = ObservedProfile()
    watched = {name: profile.watch(name, df) for name, df in finished.items()}
    write_parquet_tables(watched, cleaned_path, contracts.CLEANED_FOLDERS, **write_options)
    return profile.counts(next(iter(tables.values())).sparkSession)


def run_cleaning(
    spark: SparkSession,
    raw_path: str,
    cleaned_path: str,
    *,
    prefix: str = "",
    multi_line: frozenset[str] = contracts.MULTI_LINE_TABLES,
    on_malformed: str = "quarantine",
    **options,
) -> None:
    """Read the raw CSV tables and write them cleaned; ``options`` as for ``write_cleaned``.

    Fields that do not parse are counted first, in a scan of the raw files. They become null, and
    are written with their records to the quarantine folder beside the cleaned tables, which
    is there, if empty, on every run. With ``on_malformed="fail"`` the job ends instead, before
    it overwrites a cleaned table.
    """
    if on_malformed not in ("quarantine", "fail"):
        raise ValueError(f"on_malformed: {on_malformed!r}")
    checked = typed.load_csv_checked(spark, raw_path, prefix=prefix, multi_line=multi_line)
    base = cleaned_path.rstrip("/")
    write_parquet(typed.conformance(checked), f"{base}/{CONFORMANCE_FOLDER}")
    write_parquet(typed.quarantine(checked), f"{base}/{QUARANTINE_FOLDER}")
    counts = spark.read.parquet(f"{base}/{CONFORMANCE_FOLDER}")
    if on_malformed == "fail" and not counts.where("bad_rows > 0").isEmpty():
        raise ValueError(f"malformed fields in the raw tables: see {base}/{QUARANTINE_FOLDER}")
    profile = write_cleaned({name: x.rows() for name, x in checked.items()}, cleaned_path,
                            **options)
    write_parquet(profile, f"{base}/{PROFILE_FOLDER}", single_file=True)
