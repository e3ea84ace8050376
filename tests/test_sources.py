"""CSV and table sinks."""

import pytest
from frames import billing, finding, findings, line, tuples
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duecheck import schemas
from duecheck.sources import audit, csv, snapshots, tables


def test_csv_round_trip_keeps_awkward_text(spark, tmp_path):
    rows = [
        (1, 'Ac"me, Ltd', 'line one\nline "two", three\n\n  indented '),
        (2, None, "plain"),
        (3, "", "a\\b 'c'"),
    ]
    csv.write_csv(spark.createDataFrame(rows, schemas.CONTRACTS), str(tmp_path / "c"))
    back = csv.read_contracts(spark, str(tmp_path / "c"))
    # Empty fields, quoted or not, are NULL.
    assert sorted(map(tuple, back.collect())) == [rows[0], rows[1], (3, None, rows[2][2])]


def test_bad_rows_fail_the_load_and_keep_the_old_table(spark, tmp_path):
    good = tmp_path / "good.csv"
    good.write_text("customer_id,customer_name,contract_text\n1,A,text\n")
    bad = tmp_path / "bad.csv"
    bad.write_text("customer_id,customer_name,contract_text\n1,A,text\n2,B\n")
    target = str(tmp_path / "table")
    assert csv.load_contracts(spark, str(good), target).count() == 1
    with pytest.raises(Exception):
        csv.load_contracts(spark, str(bad), target)
    assert spark.read.parquet(target).count() == 1
    with pytest.raises(Exception):
        csv.read_contracts(spark, str(bad)).count()
    bad.write_text("customer_id,customer_name,contract_text\n1,A,text,more\n")
    with pytest.raises(Exception):
        csv.read_contracts(spark, str(bad)).count()
    bad.write_text("customer_id,customer_name,contract_text\none,A,text\n")
    with pytest.raises(Exception):
        csv.load_contracts(spark, str(bad), target)
    assert spark.read.parquet(target).count() == 1


def test_load_picks_files_by_pattern_and_replaces(spark, tmp_path):
    head = "customer_id,customer_name,contract_text\n"
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "contracts_1.csv").write_text(head + "1,A,x\n")
    (tmp_path / "in" / "notes.csv").write_text(head + "9,Z,y\n")
    for _ in range(2):
        stored = csv.load_contracts(spark, str(tmp_path / "in"), str(tmp_path / "t"), "contracts_*.csv")
    assert tuples(stored, "customer_id") == [(1,)]


def test_audit_reports_a_wrong_count(spark):
    expected = spark.createDataFrame([("a", 3), ("b", 3)], "table_name string, expected long")
    found = audit.load_audit({"a": spark.range(3), "b": spark.range(2)}, expected)
    assert tuples(found, "table_name", "row_count", "as_expected") == [("a", 3, True), ("b", 2, False)]


def test_scratch_folder_is_the_session_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    folder = tables.scratch_dir(spark)
    assert folder == (named.rstrip("/") if named else spark.sparkContext.getCheckpointDir())


def test_clustered_load_splits_one_hot_account(spark, tmp_path):
    row = line(1, "2026-01", "A", 1, "5", amount="5")
    csv.write_csv(billing(spark, *[row] * 4000), str(tmp_path / "in"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        stored = csv.load_billing(spark, str(tmp_path / "in"), str(tmp_path / "t"))
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    per_file = [r["count"] for r in stored.groupBy(F.input_file_name()).count().collect()]
    assert sum(per_file) == 4000 and max(per_file) < 1000


def billing_file(tmp_path, *rows):
    head = ",".join(schemas.BILLING.names) + "\n"
    (tmp_path / "b.csv").write_text(head + "".join(r + "\n" for r in rows))
    return str(tmp_path / "b.csv")


def test_a_load_keeps_all_digits(spark, tmp_path):
    path = billing_file(tmp_path, "i,1,C,2026-01,A,3000000000,0.000125,12.345,0.0015")
    row = csv.load_billing(spark, path, str(tmp_path / "t")).first()
    assert [str(row[c].normalize()) for c in ("unit_rate_billed", "discount_pct_applied", "amount_billed")] == ["0.000125", "12.345", "0.0015"]
    assert row["units"] == 3_000_000_000


@pytest.mark.parametrize(
    "row",
    [
        "i,1,C,2026-01,A,1,0.00000000001,0,0",
        "i,1,C,2026-01,A,1,1,0.00005,0",
        "i,1,C,2026-01,A,1,1,0,0.0000001",
        "i,1,C,2026-01,A,1.5,1,0,0",
        "i,1,C,2026-01,A,1,dear,0,0",
        ",1,C,2026-01,A,1,1,0,0",
        "i,,C,2026-01,A,1,1,0,0",
        "i,1,C,2026-13,A,1,1,0,0",
        "i,1,C,,A,1,1,0,0",
    ],
)
def test_a_load_fails_on_what_it_cannot_hold(spark, tmp_path, row):
    with pytest.raises(Exception, match="does not fit|no invoice"):
        csv.load_billing(spark, billing_file(tmp_path, row), str(tmp_path / "t"))


def test_a_large_billing_file_is_read_by_many_tasks(spark, tmp_path):
    path = billing_file(tmp_path, *[f"i{i},1,C,2026-01,A,1,1,0,0" for i in range(4000)])
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16k")
    try:
        assert csv.read_billing(spark, path).rdd.getNumPartitions() > 3
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def plain_read(spark, path, schema):
    """The plain reader: one task a file."""
    text = T.StructType([T.StructField(f.name, T.StringType()) for f in schema.fields])
    return spark.read.schema(text).options(**csv._READ).option("multiLine", True).csv(path)


AWKWARD = [
    (1, 'Ac"me, Ltd', 'line one\nline "two", three\n\n  indented '),
    (2, None, '"'),
    (3, '""', '\n\n"\n",\n'),
    (4, "a,b", "x\r\ny"),
    (5, "plain", "no quotes at all"),
    (6, "long", 'q"\n' * 400),
]


@pytest.mark.parametrize("size", ["7", "64", "1k", "128m"])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_multi_line_files_are_split_without_loss(spark, tmp_path, size, end):
    """Blocks end inside fields, between doubled quotes, in blank lines; one field spans many blocks."""
    quoted = lambda x: "" if x is None else '"' + str(x).replace('"', '""') + '"'
    rows = [(i, *AWKWARD[i % len(AWKWARD)][1:]) for i in range(40)]
    for name, part in (("a", rows[:25]), ("b", rows[25:]), ("c", [])):
        body = [f"{i},{quoted(n)},{quoted(t) if t != 'no quotes at all' else t}" for i, n, t in part]
        body[5:5] = ["", ""] if body else []
        text = end.join(["customer_id,customer_name,contract_text", *body]) + (end if name == "a" else "")
        (tmp_path / f"{name}.csv").write_bytes(text.encode())
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        read = csv.read_csv(spark, str(tmp_path), schemas.CONTRACTS, multi_line=True)
        got = tuples(read, *schemas.CONTRACTS.names)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted((i, n or None, t) for i, n, t in rows)
    wanted = plain_read(spark, str(tmp_path), schemas.CONTRACTS).collect()
    # of a file whose records end so, the plain reader shortens such breaks inside fields too
    as_plain = lambda t: t.replace("\r\n", "\n") if end == "\r\n" else t
    assert sorted((i, n, as_plain(t)) for i, n, t in got) == sorted((int(r[0]), r[1], r[2]) for r in wanted)


def test_a_large_contract_file_is_read_by_many_tasks(spark, tmp_path):
    head = "customer_id,customer_name,contract_text\n"
    (tmp_path / "c.csv").write_text(head + "".join(f'{i},n,"a\n{i}\n""b"""\n' for i in range(4000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        lines = csv._numbered_lines(spark, str(tmp_path / "c.csv"), None)
        assert lines.rdd.getNumPartitions() > 5
        found = csv.read_contracts(spark, str(tmp_path / "c.csv"))
        assert found.where("contract_text = concat('a\n', customer_id, '\n\"b\"')").count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


@pytest.mark.parametrize("body", ['1,A,te"xt\n2,B,x"y\n', '1,A,"text\n', '1,A,"te"xt"\n', '1,A\n', '1,A,"a\nb",more\n', 'one,A,"a\nb"\n'])
def test_a_multi_line_read_stays_strict(spark, tmp_path, body):
    (tmp_path / "c.csv").write_text("customer_id,customer_name,contract_text\n" + body)
    with pytest.raises(Exception, match="quotes inside|MALFORMED|does not fit|Malformed"):
        csv.read_contracts(spark, str(tmp_path / "c.csv")).collect()
