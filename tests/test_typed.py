"""Checked CSV tables: typed rows, and every field that did not parse."""

import pytest

from ledgerloom.plans import cleaning
from ledgerloom.sources import contracts, typed
from tests.helpers import rows

DDL = "id STRING, price DOUBLE, day TIMESTAMP_NTZ, n INT"
HEAD = "id,price,day,n\n"


def checked(spark, tmp_path, text, ddl=DDL, **options):
    path = tmp_path / "table.csv"
    path.write_text(text)
    return typed.read_csv_checked(spark, str(path), ddl, **options)


def test_malformed_fields_are_null_and_kept(spark, tmp_path):
    table = checked(spark, tmp_path, HEAD + (
        "a,1.5,2020-01-02 03:04:05,7\n" 'b,"12,50",2020-13-01,x\n' "c,,,\n" "d, 2.0 ,soon, 3\n"))
    found = {r.id: r for r in table.rows(with_rejected=True).collect()}
    assert found["a"].price == 1.5 and found["a"].n == 7 and found["a"]._rejected == []
    assert found["b"][:4] == ("b", None, None, None) and found["c"]._rejected == []
    assert (found["d"].price, found["d"].n) == (2.0, 3)
    assert [(x.column, x.value, x.target_type) for x in found["b"]._rejected] == [
        ("price", "12,50", "double"), ("day", "2020-13-01", "timestamp_ntz"), ("n", "x", "int")]
    quarantined = sorted(rows(table.quarantine()))
    assert [r[:2] for r in quarantined] == [
        ("day", "2020-13-01"), ("day", "soon"), ("n", "x"), ("price", "12,50")]
    assert quarantined[0][3] == 'b,"12,50",2020-13-01,x'
    assert sorted(rows(table.conformance())) == [
        ("day", "timestamp_ntz", 2), ("n", "int", 1), ("price", "double", 1),
        ("record", "struct", 0)]


def test_records_with_too_few_or_too_many_fields_are_kept(spark, tmp_path):
    table = checked(spark, tmp_path, HEAD + "a,1.5\n" "b,1,2020-01-01,2,extra\n" "c,1,,2\n")
    assert table.rows().count() == 3
    records = [r for r in rows(table.quarantine()) if r[0] == typed.RECORD]
    assert sorted(r[3] for r in records) == ["a,1.5", "b,1,2020-01-01,2,extra"]
    counts = {r[0]: r[2] for r in rows(table.conformance())}
    assert counts["record"] == 2
    # also if a reader wants one column only
    assert table.rows(with_rejected=True).where("size(_rejected) > 0").count() == 2


def test_text_columns_and_line_breaks(spark, tmp_path):
    text = 'id,note\n1,"two\nlines, ""quoted"""\n2,plain\n'
    table = checked(spark, tmp_path, text, "id INT, note STRING", multi_line=True)
    assert sorted(rows(table.rows())) == [(1, 'two\nlines, "quoted"'), (2, "plain")]
    assert table.quarantine().count() == 0
    only_text = checked(spark, tmp_path, "a,b\n1,2\n3\n", "a STRING, b STRING")
    assert rows(only_text.conformance()) == [("record", "struct", 1)]


def test_moved_columns_fail(spark, tmp_path):
    with pytest.raises(Exception):
        checked(spark, tmp_path, "price,id,day,n\n1,a,,1\n").rows().collect()


def raw_tables(base, broken):
    """One or two records per table."""
    for name, ddl in contracts.RAW_SCHEMAS.items():
        fields = [x.strip().split(" ") for x in ddl.replace("\n", " ").split(",")]
        fields = [(x[0], x[-1]) for x in fields]
        sample = {"STRING": "t", "DOUBLE": "1.5", "INT": "1", "TIMESTAMP_NTZ": "2020-01-01 00:00:00"}
        line = ",".join(sample[kind] for _, kind in fields)
        lines = [",".join(c for c, _ in fields), line]
        if broken and name == "order_items":
            lines.append("o,1,p,s,2020-01-01 00:00:00,\"12,50\",2.0")
        lead = "" if name in contracts.UNPREFIXED_FILES else "shop_"
        (base / f"{lead}{contracts.RAW_FILES[name]}").write_text("\n".join(lines) + "\n")


def test_cleaning_job_quarantines_or_fails(spark, tmp_path):
    raw, out = tmp_path / "raw", tmp_path / "cleaned"
    raw.mkdir()
    raw_tables(raw, broken=True)
    with pytest.raises(ValueError, match="malformed"):
        cleaning.run_cleaning(spark, str(raw), str(out), prefix="shop_", on_malformed="fail")
    assert not (out / contracts.CLEANED_FOLDERS["orders"]).exists()
    cleaning.run_cleaning(spark, str(raw), str(out), prefix="shop_")
    found = rows(spark.read.parquet(f"{out}/{cleaning.QUARANTINE_FOLDER}"))
    assert [r[:4] for r in found] == [("order_items", "price", "12,50", "double")]
    counts = spark.read.parquet(f"{out}/{cleaning.CONFORMANCE_FOLDER}")
    assert counts.where("bad_rows > 0").count() == 1
    raw_tables(raw, broken=False)
    cleaning.run_cleaning(spark, str(raw), str(out), prefix="shop_", on_malformed="fail")
    assert spark.read.parquet(f"{out}/{cleaning.QUARANTINE_FOLDER}").count() == 0
    with pytest.raises(ValueError):
        cleaning.run_cleaning(spark, str(raw), str(out), on_malformed="ignore")
