"""Stored vault and ledger."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from veilframe.operators.audit import LEDGER_SCHEMA, merge_ledgers
from veilframe.operators.vault import VAULT_SCHEMA, select_persistable
from veilframe.sources.audit_store import read_audit, write_audit
from veilframe.sources.capture import write_capture
from veilframe.sources.text import scan_text
from veilframe.sources.vault_store import read_vault, unreadable_rows, write_vault


@pytest.fixture()
def vault(spark):
    rows = [("__VAULT_JWT_12345678__", "é \"x\" \n", "JWT", 1_700_000_000_123_456, 4, "n", "manual"),
            ("__VAULT_APIKEY_87654321__", "k", "APIKEY", 1, 0, None, "proxy")]
    raw = spark.createDataFrame(rows, "token string, secret string, type string, us long, hit_count long, name string, source string")
    return raw.select("token", "secret", "type", F.timestamp_micros("us").alias("created_at"), "hit_count", "name", "source")


def test_round_trip(spark, vault, tmp_path):
    path = str(tmp_path / "v")
    write_vault(vault, path, "right")
    assert sorted(read_vault(spark, path, "right").collect()) == sorted(vault.collect())
    assert "secret" not in spark.read.parquet(path).columns
    assert select_persistable(vault).count() == 1 and select_persistable(vault, True).count() == 2


def test_appended_writes_have_their_own_salt(spark, vault, tmp_path):
    path = str(tmp_path / "v")
    write_vault(vault, path, "p")
    before = {r["salt"] for r in spark.read.parquet(path).collect()}
    write_vault(vault, path, "p", mode="append")
    after = [r["salt"] for r in spark.read.parquet(path).collect()]
    assert len(after) == 4 and len([s for s in after if s not in before]) == 2
    assert read_vault(spark, path, "p").count() == 4


def test_wrong_password(spark, vault, tmp_path):
    path = str(tmp_path / "v")
    write_vault(vault, path, "right")
    with pytest.raises(Exception):
        read_vault(spark, path, "wrong").collect()
    assert read_vault(spark, path, "wrong", strict=False).count() == 0
    assert unreadable_rows(spark, path, "wrong").count() == 2


def test_invalid_entry(spark, vault, tmp_path):
    path = str(tmp_path / "v")
    write_vault(vault.withColumn("type", F.lit("OTHER")), path, "p")
    with pytest.raises(Exception, match="corrupted"):
        read_vault(spark, path, "p").collect()


def test_missing_path_is_empty(spark, tmp_path):
    assert read_vault(spark, str(tmp_path / "none"), "p").count() == 0


def test_keys_stay_out_of_plans(spark, vault, tmp_path, capsys):
    from veilframe.sources.vault_store import derive_key

    path = str(tmp_path / "v")
    write_vault(vault, path, "p")
    salt = spark.read.parquet(path).first()["salt"]
    key = derive_key("p", bytes.fromhex(salt)).hex()
    read_vault(spark, path, "p").explain(True)
    assert key not in capsys.readouterr().out.lower().replace(" ", "")


def write_lines(path, *records):
    path.mkdir()
    (path / "a.json").write_text("\n".join(json.dumps(r) for r in records))
    return str(path)


GOOD = {"id": " abc ", "created_at": "2024-01-01T00:00:00.000001Z", "last_seen_at": "2024-01-02T00:00:00Z", "name": "  ",
        "preview": "a***b", "seen_count": 3, "source": "stdin", "type": "JWT"}


def test_audit_read(spark, tmp_path):
    rows = read_audit(spark, write_lines(tmp_path / "a", GOOD, {**GOOD, "id": "  "})).collect()
    assert [(r["id"], r["name"], r["seen_count"]) for r in rows] == [("abc", None, 3)]
    for i, bad in enumerate(({"type": "X"}, {"source": "y"}, {"seen_count": "many"}, {"preview": None})):
        with pytest.raises(Exception):
            read_audit(spark, write_lines(tmp_path / f"b{i}", {**GOOD, **bad})).collect()


def test_audit_write_and_merge(spark, tmp_path):
    old = read_audit(spark, write_lines(tmp_path / "a", GOOD))
    path = str(tmp_path / "out")
    assert write_audit(old, path) and read_audit(spark, path).collect() == old.collect()
    assert not write_audit(old.limit(0), path) and read_audit(spark, path).count() == 1
    merged = merge_ledgers(old, old.withColumn("type", F.lit("APIKEY"))).first()
    assert merged["seen_count"] == 6 and merged["type"] == "APIKEY"
    assert spark.createDataFrame([], LEDGER_SCHEMA).columns == old.columns


def test_capture(spark, tmp_path):
    df = spark.createDataFrame([("{\"a\":1}", "d1"), ("{}", "d2")], "r string, day string")
    write_capture(df, str(tmp_path / "c"), "r", "day")
    assert spark.read.text(str(tmp_path / "c")).filter("day = 'd1'").first()["value"] == "{\"a\":1}"


def test_scan_text(spark):
    with pytest.raises(ValueError):
        scan_text(spark.range(1), ["id"], "id", "other")
    assert spark.createDataFrame([], VAULT_SCHEMA).count() == 0
