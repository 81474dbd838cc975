"""The stored vault: a Parquet table of encrypted entries.

Every write draws a few salts and derives an AES-256 key per salt from the password (scrypt). A row holds the salt's name and the
entry as AES-GCM ciphertext; the cipher's tag makes a wrong password or a changed row an error. Keys travel as the
rows of a one-column table that is joined by salt name, so they appear in no plan, log or event.
"""

from __future__ import annotations

import hashlib
import secrets as random_source

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.config import SECRET_SOURCES, SECRET_TYPES
from veilframe.operators.vault import VAULT_SCHEMA

# --- fixed values -----------------------------------------------------------------------------------------------
KEY_BYTES = 32
SALT_BYTES = 16
SCRYPT = {"n": 2**14, "r": 8, "p": 1}
# ----------------------------------------------------------------------------------------------------------------
SALTS = 4  # per write
ENTRY = "struct<token:string,secret:string,type:string,created_us:bigint,hit_count:bigint,name:string,source:string>"


def derive_key(password: str, salt: bytes) -> bytes:
    return hashlib.scrypt(password.encode(), salt=salt, dklen=KEY_BYTES, **SCRYPT)


def _key_ring(spark: SparkSession, password: str, salts: list[str]) -> DataFrame:
    rows = [(i, s, bytearray(derive_key(password, bytes.fromhex(s)))) for i, s in enumerate(salts)]
    return F.broadcast(spark.createDataFrame(rows, "slot int, salt string, key binary"))


def _entry() -> Column:
    return F.to_json(F.struct(
        "token", "secret", "type", F.unix_micros("created_at").alias("created_us"), "hit_count", "name", "source"))


def new_salts() -> list[str]:
    return [random_source.token_bytes(SALT_BYTES).hex() for _ in range(SALTS)]


def write_vault(vault: DataFrame, path: str, password: str, mode: str = "overwrite", salts: list[str] | None = None) -> None:
    """Every row sealed by itself. Parts that are written one after the other share ``salts``, so that reading derives a few keys
    only, however many parts there are."""
    ring = _key_ring(vault.sparkSession, password, salts or new_salts())
    slot = F.pmod(F.hash("token"), F.lit(SALTS))
    sealed = vault.select(slot.alias("slot"), _entry().alias("entry")).join(ring, "slot").select(
        "salt", F.aes_encrypt(F.encode("entry", "UTF-8"), "key", F.lit("GCM")).alias("sealed"))
    sealed.write.mode(mode).parquet(path)


def read_vault(spark: SparkSession, path: str, password: str, strict: bool = True) -> DataFrame:
    """Decrypted entries. A missing path is an empty vault. With ``strict`` a wrong password, a damaged row or an
    invalid entry fails the job; without it such rows are left out (see ``unreadable_rows``)."""
    try:
        sealed = spark.read.schema("salt string, sealed binary").parquet(path)
    except AnalysisException as error:
        if "PATH_NOT_FOUND" not in str(error):
            raise
        return spark.createDataFrame([], VAULT_SCHEMA)
    opened = _open(spark, sealed, password, strict)
    valid = _is_valid(F.col("e"))
    if strict:
        opened = opened.withColumn("e", F.when(valid, F.col("e")).otherwise(
            F.raise_error(F.lit("vault table is corrupted"))))
    else:
        opened = opened.filter(F.coalesce(valid, F.lit(False)))
    return opened.select(
        "e.token", "e.secret", "e.type", F.timestamp_micros("e.created_us").alias("created_at"), "e.hit_count",
        "e.name", "e.source")


def unreadable_rows(spark: SparkSession, path: str, password: str) -> DataFrame:
    """Rows that the password does not open or that hold no valid entry."""
    sealed = spark.read.schema("salt string, sealed binary").parquet(path)
    return _open(spark, sealed, password, strict=False).filter(
        ~F.coalesce(_is_valid(F.col("e")), F.lit(False))).select("salt", "sealed")


def _open(spark: SparkSession, sealed: DataFrame, password: str, strict: bool) -> DataFrame:
    salts = [r["salt"] for r in sealed.select("salt").distinct().collect()]  # a few per write
    ring = _key_ring(spark, password, salts).drop("slot")
    decrypt = F.aes_decrypt if strict else F.try_aes_decrypt
    plain = decrypt("sealed", "key", F.lit("GCM")).cast("string")
    return sealed.join(ring, "salt").select("salt", "sealed", F.from_json(plain, ENTRY).alias("e"))


def _is_valid(e: Column) -> Column:
    return F.coalesce(
        e["token"].isNotNull() & e["secret"].isNotNull() & e["type"].isin(*SECRET_TYPES)
        & e["created_us"].isNotNull() & e["hit_count"].isNotNull()
        & (e["source"].isNull() | e["source"].isin(*SECRET_SOURCES)), F.lit(False))
