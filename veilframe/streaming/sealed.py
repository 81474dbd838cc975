"""Sessions whose vault is keyed state, sealed at rest.

Turns go through two processors of the same key: one keeps the rolling detection text, one the session's vault; between
them detection runs as an expression. What either writes to the state store is encrypted with a key that is not stored
there. A micro-batch reads and writes the state of the sessions it holds, however many came before it.
"""

from __future__ import annotations

import base64
import hashlib
import hmac
import json
import os
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veilframe.config import DETECTION_WINDOW, DetectOptions
from veilframe.functions.detect import detect
from veilframe.functions.text import is_token
from veilframe.operators.vault import SHORT_ATTEMPTS
from veilframe.sources.vault_store import new_salts, write_vault
from veilframe.streaming.cutters import Dictionary
from veilframe.streaming.state import Early, Handler, OrderedStream, Windows, use_rocksdb


class Sealer:
    """Texts under a secret key: a key stream from SHAKE-256 over key and nonce, and a tag (HMAC-SHA-256) over nonce and text.
    A text that was changed, or sealed with another key, is refused."""

    def __init__(self, password: str) -> None:
        key = hashlib.scrypt(password.encode(), salt=b"stream state", n=1 << 14, r=8, p=1, dklen=64)
        self.stream_key, self.tag_key = key[:32], key[32:]

    def _mixed(self, nonce: bytes, data: bytes) -> bytes:
        stream = hashlib.shake_256(self.stream_key + nonce).digest(len(data))
        return (int.from_bytes(data, "big") ^ int.from_bytes(stream, "big")).to_bytes(len(data), "big")

    def _tag(self, sealed: bytes) -> bytes:
        return hmac.digest(self.tag_key, sealed, "sha256")[:16]

    def seal(self, text: str) -> str:
        nonce = os.urandom(16)
        sealed = nonce + self._mixed(nonce, text.encode("utf-8", "surrogatepass"))
        return base64.b64encode(self._tag(sealed) + sealed).decode()

    def open(self, sealed: str) -> str:
        data = base64.b64decode(sealed)
        if not hmac.compare_digest(self._tag(data[16:]), data[:16]):
            raise ValueError("stream state does not open with this key")
        return self._mixed(data[16:32], data[32:]).decode("utf-8", "surrogatepass")


class _SealedValue:
    """A value state whose ``body`` is sealed."""

    def __init__(self, state, sealer: Sealer, body: int) -> None:
        self.state, self.sealer, self.body = state, sealer, body
        self.exists, self.clear = state.exists, state.clear

    def get(self):
        found = list(self.state.get())
        found[self.body] = self.sealer.open(found[self.body])
        return tuple(found)

    def update(self, value: tuple) -> None:
        self.state.update(tuple(self.sealer.seal(x) if i == self.body else x for i, x in enumerate(value)))


class _SealedMap:
    """A map state of one text per key, sealed."""

    def __init__(self, state, sealer: Sealer) -> None:
        self.state, self.sealer = state, sealer
        self.clear, self.removeKey = state.clear, state.removeKey

    def getValue(self, key):
        return (self.sealer.open(self.state.getValue(key)[0]),)

    def updateValue(self, key, value) -> None:
        self.state.updateValue(key, (self.sealer.seal(value[0]),))


class SealedStream(OrderedStream):
    """An ``OrderedStream`` that encrypts what it stores. A session that hears nothing for ``idle_ms`` forgets its state, not its
    place: what waits is taken in order, and later turns start from an empty state."""

    def __init__(self, sealer: Sealer, names: list[str], handler: Handler, idle_ms: int | None = None, patience: int | None = None) -> None:
        super().__init__(names, handler, idle_ms, patience)
        self.sealer = sealer

    def init(self, handle) -> None:
        super().init(handle)
        self.stream = _SealedValue(self.stream, self.sealer, body=5)
        self.early = _SealedMap(self.early, self.sealer)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        expected, _, n_early, blocks, gaps, body, _ = self.stream.get()
        state, gaps = json.loads(body), json.loads(gaps)
        early = Early(self.early, json.loads(blocks))
        while n_early:
            seq = early.first()
            if seq > expected:
                gaps.append([expected, seq])
            yield from self._out(key, self.handler.take(key, state, seq, early.pop(seq)[0]))
            expected, n_early = seq + 1, n_early - 1
        self.stream.update((expected, 0, 0, json.dumps(early.keep()), json.dumps(gaps), json.dumps(self.handler.open(key)), False))


class Vault(Handler):
    """Registers what is found and masks a turn by all its session knows by then: (seq, masked_text, late, registered). A late
    turn is masked by what is known when it comes."""

    fields = ["text", "types", "secrets"]

    def __init__(self, session_id: str) -> None:
        self.session_id = session_id

    def open(self, key):
        return {}

    def _token(self, secret: str, type_: str, known: dict) -> str:
        """The token of a new secret: the first 8 digits of its hash; if another secret holds that, with a rank behind it, then
        longer hashes."""
        taken = set(known.values())

        def made(digits: str) -> str:
            return f"__VAULT_{type_}_{digits}__"

        base = hashlib.sha256((secret + self.session_id).encode()).hexdigest()[:8]
        for rank in range(SHORT_ATTEMPTS + 1):
            if (token := made(base + (f"{rank:x}" if rank else ""))) not in taken:
                return token
        attempt = SHORT_ATTEMPTS + 1
        while (token := made(hashlib.sha256(f"{secret}{self.session_id}:{attempt}".encode()).hexdigest()[:9])) in taken:
            attempt += 1
        return token

    def take(self, key, state, seq, row):
        text, types, secrets = row
        new = []
        for type_, secret in zip(types or (), secrets or ()):
            if secret not in state:
                state[secret] = self._token(secret, type_, state)
                new.append((secret, state[secret], type_))
        yield seq, self._masked(state, text), False, [Row(secret=s, token=t, type=k) for s, t, k in new]

    def late(self, key, state, seq, row):
        yield seq, self._masked(state, row[0]), True, []

    def _masked(self, state: dict, text: str | None) -> str | None:
        return None if text is None else Dictionary(list(state.items())).last(text)


REGISTERED = "array<struct<secret:string,token:string,type:string>>"


def sealed_sessions(turns: DataFrame, session: list[str], order: str, text: str, session_id: str, password: str, patience: int = 1000,
                    idle_ms: int | None = None, options: DetectOptions = DetectOptions(), window: int = DETECTION_WINDOW) -> DataFrame:
    """Turns of sessions, numbered from 0 in ``order``, masked as they come: (session, seq, masked_text, late, registered).

    Each turn is masked by what its session knows by then; ``registered`` are the secrets it is the first to show (see
    ``sealed_to``). The state of both steps is sealed with a key from ``password``. Shuffle files hold texts in clear unless the
    cluster encrypts them (``spark.io.encryption.enabled``).
    """
    use_rocksdb(turns.sparkSession)
    sealer, keys = Sealer(password), [turns.schema[k] for k in session]
    mode = "None" if idle_ms is None else "ProcessingTime"

    def step(rows: DataFrame, handler: Handler, shape: str, waits: int) -> DataFrame:
        schema = T.StructType([*keys, *T._parse_datatype_string(shape).fields])
        return rows.select(*session, "seq", *handler.fields, F.lit(False).alias("is_last")).groupBy(*session).transformWithState(
            SealedStream(sealer, schema.names, handler, idle_ms, waits), schema, "Append", mode)

    rows = turns.select(*session, F.col(order).cast("long").alias("seq"), F.col(text).alias("text"))
    windows = step(rows, Windows(window), "seq long, text string, window_text string, late boolean", patience)
    found = F.filter(detect(F.col("window_text"), options), lambda f: ~is_token(f["value"]))
    seen = windows.withColumn("_found", found).select(
        *session, "seq", "text", F.transform("_found", lambda f: f["type"]).alias("types"), F.transform("_found", lambda f: f["value"]).alias("secrets"))
    return step(seen, Vault(session_id), f"seq long, masked_text string, late boolean, registered {REGISTERED}", 0)


def sealed_to(session: list[str], path: str, vault_path: str, password: str) -> Callable[[DataFrame, int], None]:
    """Sink of ``sealed_sessions``: masked turns in one folder per micro-batch, and what was registered as an encrypted vault
    (``read_vault`` reads all of it)."""
    salts = new_salts()

    def handle(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        batch.drop("registered").write.mode("overwrite").parquet(f"{path}/batch_id={batch_id}")
        new = batch.select("seq", F.explode("registered").alias("r")).select(
            "r.token", "r.secret", "r.type", F.timestamp_seconds("seq").alias("created_at"), F.lit(0).cast("long").alias("hit_count"),
            F.lit(None).cast("string").alias("name"), F.lit("stdin").alias("source"))
        write_vault(new, f"{vault_path}/batch_id={batch_id}", password, salts=salts)
        batch.unpersist()

    return handle
