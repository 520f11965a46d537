"""CSV tables whose malformed values are kept and counted instead of becoming null unseen.

A checked table is read as text. Its typed rows are what an explicit schema gives: a field that
does not parse is null. Beside them, ``rejected`` says of every row which fields those were, and
whether the record itself had too few or too many fields; ``quarantine`` lists them with the whole
record, so nothing that the files hold is lost.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources import contracts
from ledgerloom.sources.readers import csv_path

REJECTED = "_rejected"
_CORRUPT = "_malformed_record"
#: What a record is called that has too few or too many fields.
RECORD = "record"
_FIELD = "struct<column: string, value: string, target_type: string>"


@dataclass(frozen=True)
class CheckedTable:
    """A CSV table as text with its target schema."""

    text: DataFrame
    schema: T.StructType

    def _cast(self, field: T.StructField) -> Column:
        # blanks around a number or a time are no error, as for the typed reader
        value = F.col(field.name)
        return value if isinstance(field.dataType, T.StringType) \
            else F.trim(value).try_cast(field.dataType)

    def _is_bad(self, field: T.StructField) -> Column:
        """Whether a field holds something that its type cannot; an empty field is missing."""
        if isinstance(field.dataType, T.StringType):
            return F.lit(False)
        given = F.trim(F.col(field.name)) != ""
        return F.coalesce(given, F.lit(False)) & self._cast(field).isNull()

    @property
    def rejected(self) -> Column:
        """The fields that do not parse, as an array; the record itself if it is malformed."""
        fields = [
            F.when(self._is_bad(f), F.struct(
                F.lit(f.name).alias("column"), F.col(f.name).alias("value"),
                F.lit(f.dataType.simpleString()).alias("target_type")))
            for f in self.schema if not isinstance(f.dataType, T.StringType)
        ]
        record = F.when(F.col(_CORRUPT).isNotNull(), F.struct(
            F.lit(RECORD).alias("column"), F.col(_CORRUPT).alias("value"),
            F.lit("struct").alias("target_type")))
        return F.array_compact(F.array(record, *fields)).cast(f"array<{_FIELD}>")

    def rows(self, with_rejected: bool = False) -> DataFrame:
        """The typed rows, all of them; on request with the column ``_rejected``."""
        columns = [self._cast(f).alias(f.name) for f in self.schema]
        return self.text.select(
            *columns, *([self.rejected.alias(REJECTED)] if with_rejected else []))

    def quarantine(self) -> DataFrame:
        """``(column, value, target_type, record)``: one row per field that did not parse."""
        record = F.coalesce(F.col(_CORRUPT), F.to_csv(F.struct(*self.schema.names)))
        found = self.text.select(self.rejected.alias("fields"), record.alias("record"))
        return found.where(F.size("fields") > 0) \
            .select(F.explode("fields").alias("field"), "record").select("field.*", "record")

    def conformance(self) -> DataFrame:
        """``(column, target_type, bad_rows)`` of all typed columns, in one scan."""
        typed = [f for f in self.schema if not isinstance(f.dataType, T.StringType)]
        counts = [F.count_if(self._is_bad(f)) for f in typed]
        # true of every row: Spark does not read the record column alone
        read = F.coalesce(F.length(self.schema.names[0]), F.lit(0)) >= 0
        lines = [
            F.struct(F.lit(f.name).alias("column"),
                     F.lit(f.dataType.simpleString()).alias("target_type"), n.alias("bad_rows"))
            for f, n in zip(typed, counts)
        ]
        lines.append(F.struct(
            F.lit(RECORD).alias("column"), F.lit("struct").alias("target_type"),
            F.count_if(F.col(_CORRUPT).isNotNull() & read).alias("bad_rows")))
        return self.text.agg(F.array(*lines).alias("lines")).select(F.inline("lines"))


def read_csv_checked(
    spark: SparkSession, path: str, schema: str, *, multi_line: bool = False
) -> CheckedTable:
    """One CSV table with a header row, checked against it by name as ``read_csv`` does."""
    target = T.StructType.fromDDL(schema)
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in target])
    reader = (
        spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
        .option("enforceSchema", False).option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", _CORRUPT)
        # a pruned scan would not see that a record has too many fields
        .option("columnPruning", False)
    )
    return CheckedTable(reader.schema(text.add(_CORRUPT, T.StringType())).csv(path), target)


def load_csv_checked(
    spark: SparkSession,
    base_path: str,
    *,
    prefix: str = "",
    schemas: Mapping[str, str] = contracts.RAW_SCHEMAS,
    files: Mapping[str, str] = contracts.RAW_FILES,
    multi_line: frozenset[str] = contracts.MULTI_LINE_TABLES,
) -> dict[str, CheckedTable]:
    """All raw tables under ``base_path`` as checked tables, keyed by short name."""
    return {
        name: read_csv_checked(spark, csv_path(base_path, name, prefix, files), schemas[name],
                               multi_line=name in multi_line)
        for name in files
    }


def quarantine(tables: Mapping[str, CheckedTable]) -> DataFrame:
    """``(table, column, value, target_type, record)`` over several tables."""
    return _over(tables, lambda x: x.quarantine())


def conformance(tables: Mapping[str, CheckedTable]) -> DataFrame:
    """``(table, column, target_type, bad_rows)`` over several tables; one scan each."""
    return _over(tables, lambda x: x.conformance())


def _over(tables: Mapping[str, CheckedTable], made) -> DataFrame:
    parts = [made(x).select(F.lit(name).alias("table"), "*") for name, x in tables.items()]
    return reduce(DataFrame.unionByName, parts)
