"""End-to-end jobs on small tables."""

from __future__ import annotations

import pytest
from pyspark.sql import Observation
from pyspark.sql import functions as F

from veilframe.config import DetectOptions
from veilframe.operators.mask import mask
from veilframe.operators.restore import restore
from veilframe.plans.pipelines import mask_corpus, mask_traffic
from veilframe.session import ensure_checkpoint_dir

PAT = "ghp_" + "a1" * 18


def test_corpus_round_trip_and_idempotence(spark):
    rows = [(1, f"key {PAT}; password = '{PAT[:9]} x'"), (2, "nothing"), (3, f"z{PAT}"), (4, None)]
    df = spark.createDataFrame(rows, "id int, text string")
    run = mask_corpus(df, ["id"], "text", "s", F.timestamp_seconds("id"), scope=["id"])
    masked = {r["id"]: (r["masked_text"], r["n_masked"]) for r in run.texts.collect()}
    assert masked[2] == ("nothing", 0) and masked[3] == (f"z{PAT}", 0) and masked[4] == (None, 0) and masked[1][1] == 2
    assert PAT not in masked[1][0]
    back = restore(run.texts.select("id", "masked_text"), run.vault, ["id"], "masked_text", "t").collect()
    assert {r["id"]: r["t"] for r in back} == dict(rows)
    scoped = run.findings.select("id", F.col("value").alias("secret")).distinct().join(run.vault, "secret")
    again = mask(run.texts.select("id", "masked_text"), scoped, ["id"], ["id"], "masked_text", "t").collect()
    assert all(r["t"] == r["masked_text"] for r in again)


def test_exclusions(spark):
    df = spark.createDataFrame([(1, f"key {PAT} password = hunter22")], "id int, text string")
    excluded = spark.createDataFrame([(None, "APIKEY")], "record_id string, type string")
    run = mask_corpus(df, ["id"], "text", "s", F.timestamp_seconds("id"), excluded=excluded)
    assert [r["type"] for r in run.vault.collect()] == ["PASSWORD"]
    assert run.ledger.first()["preview"] == "hu***22"


@pytest.mark.parametrize("limit", [1 << 26, 0])
def test_gate_keeps_rows_in_both_plans(spark, monkeypatch, limit):
    """With a broadcast limit of 0 the join is shuffled and gated."""
    monkeypatch.setattr("veilframe.operators.replace.BROADCAST_LIMIT_BYTES", limit)
    df = spark.createDataFrame([(i, f"key {PAT}{'' if i % 2 else 'x'} {i}") for i in range(50)] + [(50, None), (51, "plain")], "id int, text string")
    run = mask_corpus(df, ["id"], "text", "s", F.timestamp_seconds("id"), options=DetectOptions(entropy=False))
    got = {r["id"]: r["n_masked"] for r in run.texts.collect()}
    assert got == {i: i % 2 if i < 50 else 0 for i in range(52)}


def test_traffic_is_observed(spark):
    log = spark.createDataFrame([(1, "/v1/messages", {"content-type": ["application/json"]}, f'{{"a":"{PAT}\\n"}}'), (2, "/x", {}, PAT),
                                 (3, "/v1/messages", {"content-type": ["image/png"]}, PAT)],
                                "id int, path string, headers map<string,array<string>>, body string")
    seen = Observation("bodies")
    run = mask_traffic(log, ["id"], "s", F.timestamp_seconds("id"), observation=seen)
    got = {r["id"]: (r["masked_body"], r["route"]["error"]) for r in run.texts.collect()}
    assert PAT not in got[1][0] and got[2] == (PAT, "unresolved provider") and got[3] == (PAT, None)
    assert seen.get["n_bodies"] == 1


def test_cluster_needs_a_shared_folder():
    class Context:
        master = "yarn"

        def getCheckpointDir(self):
            return None

        def getConf(self):
            return self

        def get(self, *_):
            return None

    class Session:
        sparkContext = Context()
        conf = Context()

    with pytest.raises(RuntimeError):
        ensure_checkpoint_dir(Session())
