"""The vault table: one row per secret, unique on secret, on token and on non-null name."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilframe.functions.text import is_token, normalize_name, vault_token
from veilframe.session import broadcast_if_small, cut_lineage

VAULT_SCHEMA = (
    "token string, secret string, type string, created_at timestamp, hit_count bigint, name string, source string"
)
VAULT_COLUMNS = ["token", "secret", "type", "created_at", "hit_count", "name", "source"]
SHORT_ATTEMPTS = 15  # fixed value: one hex digit behind the 8-digit hash, then a 9-digit hash
TokenGenerator = Callable[[Column, Column, Column], Column]


def sightings(
    found: DataFrame, source: str, seen_at: Column, order: list[str], name: Column | None = None,
    scope: list[str] | None = None,
) -> DataFrame:
    """Findings as registration events with a total order."""
    return found.select(
        *(scope or []), F.col("value").alias("secret"), "type", F.lit(source).alias("source"), seen_at.alias("seen_at"),
        (F.lit(None).cast("string") if name is None else normalize_name(name)).alias("name"),
        F.struct(*order).alias("ord"),
    )


def build_vault(
    events: DataFrame, session: str | Column, generator: TokenGenerator = vault_token, scope: list[str] | None = None,
) -> DataFrame:
    """One entry per secret (per scope): token from the first type, type and source as last seen, first time seen.

    ``events`` has secret, type, source, seen_at, name, ord; optional ``token`` and ``hit_count`` are those of a
    stored entry. One shuffle on the secret, behind a partial aggregation.
    """
    scope = scope or []
    columns = events.columns
    given = F.col("token") if "token" in columns else F.lit(None).cast("string")
    hits = F.col("hit_count") if "hit_count" in columns else F.lit(None).cast("long")
    entries = events.groupBy(*scope, "secret").agg(
        F.min_by("type", "ord").alias("first_type"),
        F.max_by("type", "ord").alias("type"),
        F.min_by("seen_at", "ord").alias("created_at"),
        F.max_by("source", F.when(F.col("source").isNotNull(), F.col("ord"))).alias("source"),
        F.max_by("name", F.when(F.col("name").isNotNull(), F.col("ord"))).alias("name"),
        F.min_by(given, "ord").alias("given_token"),
        F.coalesce(F.max_by(hits, F.when(hits.isNotNull(), F.col("ord"))), F.lit(0).cast("long")).alias("hit_count"),
        F.min("ord").alias("first_ord"),
    )
    return assign_tokens(entries, session, generator, scope).select(*scope, *VAULT_COLUMNS)


def _long_hash(session: Column, attempt: Column) -> Column:
    digest = F.sha2(F.concat(F.col("secret"), session, F.lit(":"), attempt.cast("string")), 256)
    return F.concat(F.lit("__VAULT_"), F.col("first_type"), F.lit("_"), F.substring(digest, 1, 9), F.lit("__"))


def assign_tokens(
    entries: DataFrame, session: str | Column, generator: TokenGenerator = vault_token, scope: list[str] | None = None,
) -> DataFrame:
    """Tokens, made unique: within one base token the first entry keeps it, the next 15 append their rank in hex, later
    ones take a longer hash. Longer hashes may meet by chance, so uniqueness is checked and settled.

    Entries with one base token are numbered together, so a generator of one's own has to spread secrets over tokens as
    a hash does."""
    scope = scope or []
    session = F.lit(session) if isinstance(session, str) else session
    based = entries.withColumn(
        "base", F.coalesce(F.col("given_token"), generator(F.col("secret"), F.col("first_type"), session)))
    # A token outside the grammar would never be recognised again, so its secret would be lost.
    based = based.withColumn("base", F.when(is_token(F.col("base")), F.col("base")).otherwise(
        F.raise_error(F.concat(F.lit("not a vault token: "), F.coalesce("base", F.lit("null"))))))
    order = Window.partitionBy(*scope, "base").orderBy("first_ord", "secret")
    ranked = based.withColumn("rank", F.row_number().over(order) - 1)
    hash8 = F.regexp_extract(F.col("base"), r"_([0-9a-f]{8})[0-9a-f]?__$", 1)
    short = F.concat(F.lit("__VAULT_"), F.col("first_type"), F.lit("_"), hash8,
                     F.lower(F.hex(F.col("rank"))), F.lit("__"))
    named = ranked.withColumn(
        "token",
        F.when(F.col("rank") == 0, F.col("base")).when(F.col("rank") <= SHORT_ATTEMPTS, short)
        .otherwise(_long_hash(session, F.lit(SHORT_ATTEMPTS + 1))),
    )
    current = cut_lineage(named.withColumn("attempt", F.greatest(F.col("rank"), F.lit(SHORT_ATTEMPTS + 1))))
    while not current.groupBy(*scope, "token").count().filter("count > 1").isEmpty():
        # An entry that holds its base token keeps it; of the others the earliest does.
        holder = Window.partitionBy(*scope, "token").orderBy(F.col("rank") != 0, "first_ord", "secret")
        moved = current.withColumn("late", F.row_number().over(holder) > 1)
        moved = moved.withColumn("attempt", F.col("attempt") + F.col("late").cast("int"))
        current = cut_lineage(moved.withColumn("token", F.when(
            F.col("late"), _long_hash(session, F.col("attempt"))).otherwise(F.col("token"))).drop("late"))
    return current.drop("base", "rank", "attempt", "given_token", "first_ord", "first_type")


def name_conflicts(vault: DataFrame) -> DataFrame:
    """Names given to more than one secret."""
    named = vault.filter(F.col("name").isNotNull())
    return named.groupBy("name").agg(F.count_distinct("secret").alias("n_secrets")).filter("n_secrets > 1")


def require_unique_names(vault: DataFrame) -> DataFrame:
    if not name_conflicts(vault).isEmpty():
        raise ValueError("secret name already exists")
    return vault


def resolve(requests: DataFrame, vault: DataFrame) -> DataFrame:
    """Vault with every resolved token counted. Requests are counted per token before they meet the vault."""
    hits = requests.groupBy("token").agg(F.count("*").alias("_hits"))
    return vault.join(hits, "token", "left").withColumn(
        "hit_count", F.col("hit_count") + F.coalesce(F.col("_hits"), F.lit(0))).drop("_hits")


def find_by_name(names: DataFrame, vault: DataFrame) -> DataFrame:
    wanted = names.select(normalize_name(F.col("name")).alias("name")).filter(F.col("name").isNotNull()).distinct()
    return vault.join(wanted, "name", "left_semi")


def remove_by_name(vault: DataFrame, names: DataFrame) -> DataFrame:
    gone = names.select(normalize_name(F.col("name")).alias("name")).filter(F.col("name").isNotNull()).distinct()
    return vault.join(gone, "name", "left_anti")


def named_listing(vault: DataFrame, now: Column) -> DataFrame:
    """Named entries in name order with their age; the unnamed are only counted (see ``status_counts``)."""
    from veilframe.functions.text import relative_age

    return vault.filter(F.col("name").isNotNull()).select(
        "name", "type", "token", relative_age(F.col("created_at"), now).alias("added")).orderBy("name")


def status_counts(vault: DataFrame) -> DataFrame:
    return vault.agg(
        F.count("*").alias("stored"), F.count("name").alias("named"),
        F.count_if(F.col("name").isNull()).alias("unnamed"))


def snapshot(vault: DataFrame) -> DataFrame:
    return vault.orderBy("secret")


def replacement_rules(vault: DataFrame, direction: str, scope: list[str] | None = None) -> DataFrame:
    """(source, target) pairs: secrets to tokens for text going out, tokens to secrets for text coming in."""
    source, target = ("secret", "token") if direction == "mask" else ("token", "secret")
    return vault.filter(F.length(source) > 0).select(
        *(scope or []), F.col(source).alias("source"), F.col(target).alias("target"))


def rule_order(rules: DataFrame) -> DataFrame:
    """Longest source first, equal lengths in text order: the precedence used when sources overlap."""
    return rules.orderBy(F.length("source").desc(), "source")


def select_persistable(vault: DataFrame, persist_detected: bool = False) -> DataFrame:
    return vault if persist_detected else vault.filter(F.col("source") == "manual")


def stored_events(persisted: DataFrame) -> DataFrame:
    """Stored entries as registration events that come before all detected ones."""
    return persisted.select(
        "secret", "type", F.coalesce("source", F.lit("manual")).alias("source"), F.col("created_at").alias("seen_at"),
        "name", "token", "hit_count")


def rehydrate_vault(
    persisted: DataFrame, detected: DataFrame, session: str, excluded_types: DataFrame, excluded_ids: DataFrame,
) -> DataFrame:
    """Stored entries keep their tokens, times and counts; excluded ones are skipped; new secrets come behind."""
    from veilframe.functions.text import record_id

    types, _ = broadcast_if_small(excluded_types.select("type").distinct(), F.length("type"))
    ids, _ = broadcast_if_small(excluded_ids.select("record_id").distinct(), F.length("record_id"))
    kept = persisted.join(types, "type", "left_anti").withColumn("record_id", record_id(F.col("secret"))).join(
        ids, "record_id", "left_anti")
    new = detected.withColumn("token", F.lit(None).cast("string")).withColumn(
        "hit_count", F.lit(None).cast("long")).withColumn(
        "ord", F.struct(F.lit(1).alias("phase"), F.col("ord").alias("pos")))
    place = new.schema["ord"].dataType["pos"].dataType.simpleString()
    old = stored_events(kept).withColumn(
        "ord", F.struct(F.lit(0).alias("phase"), F.lit(None).cast(place).alias("pos")))
    return require_unique_names(build_vault(old.unionByName(new), session))
