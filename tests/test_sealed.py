"""Sessions whose vault is sealed keyed state."""

from __future__ import annotations

import glob
import hashlib
import random
import zipfile

import pytest
from test_streaming import feed

from veilframe.sources.vault_store import read_vault
from veilframe.streaming import jobs
from veilframe.streaming.sealed import Sealer, Vault, sealed_sessions, sealed_to

RANDOM = random.Random(23)


def test_sealed_texts():
    sealer = Sealer("key")
    for text in ["", "a", "é😀\n" * 999, "\ud800"]:
        sealed = sealer.seal(text)
        assert sealer.open(sealed) == text and sealed != sealer.seal(text) and (len(text) < 4 or text[:4] not in sealed)
        with pytest.raises(ValueError):
            Sealer("other").open(sealed)
        with pytest.raises(ValueError):
            sealer.open(("B" if sealed[30] != "B" else "C").join([sealed[:30], sealed[31:]]))


def test_tokens_of_a_session_are_unique(monkeypatch):
    vault, state = Vault("s"), {}
    base = vault._token("first", "JWT", state)
    assert base == f"__VAULT_JWT_{hashlib.sha256(b'firsts').hexdigest()[:8]}__"
    state["other"] = base
    for rank in range(1, 16):
        token = vault._token("first", "JWT", state)
        assert token == f"{base[:-2]}{rank:x}__"
        state[f"x{rank}"] = token
    assert vault._token("first", "JWT", state) == f"__VAULT_JWT_{hashlib.sha256(b'firsts:16').hexdigest()[:9]}__"


def test_sealed_sessions(spark, tmp_path):
    """Many micro-batches: every turn is masked by what its session knew by then, and no state file holds a secret."""
    secrets = {s: [f"hunter{s}{i}xyzzy" for i in range(3)] for s in "ab"}
    texts = {s: [f"turn {i} {v[i // 4 % 3]} and {v[0]}\n" if i % 4 else f"password = {v[i // 4 % 3]}; go\n" for i in range(12)] for s, v in secrets.items()}
    texts["c"] = ["nothing"] * 3
    rows = [(s, i, t) for s, v in texts.items() for i, t in enumerate(v)]
    rows.sort(key=lambda r: r[1] + 3 * RANDOM.random())
    batches = [rows[i:i + 5] for i in range(0, len(rows), 5)]
    stream = feed(spark, tmp_path, batches, "s string, turn long, text string")
    out, vault, state = str(tmp_path / "out"), str(tmp_path / "vault"), str(tmp_path / "ck")
    turns = sealed_sessions(stream, ["s"], "turn", "text", "id", "pass")
    jobs.start_batches(turns, sealed_to(["s"], out, vault, "pass"), state).awaitTermination()
    got = {(r["s"], r["seq"]): (r["masked_text"], r["late"]) for r in spark.read.parquet(out).collect()}
    known = {r["secret"]: r["token"] for r in read_vault(spark, vault, "pass").collect()}
    assert set(known) == {x for v in secrets.values() for x in v}
    want = {}
    for s, v in texts.items():
        for i, t in enumerate(v):
            for secret in secrets.get(s, [])[:i // 4 + 1]:
                t = t.replace(secret, known[secret])
            want[(s, i)] = (t, False)
    assert got == want
    files = [f for folder in (out, vault, state) for f in glob.glob(f"{folder}/**/*", recursive=True)]
    for path in (f for f in files if "." in f.rsplit("/", 1)[1]):
        data = open(path, "rb").read()
        if path.endswith(".zip"):
            with zipfile.ZipFile(path) as inner:
                data += b"".join(inner.read(n) for n in inner.namelist())
        assert b"xyzzy" not in data, path
    assert len(files) > 20
