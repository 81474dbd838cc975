"""Job options, value domains and limits."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

# --- fixed values -----------------------------------------------------------------------------------------------
SECRET_TYPES = ("PASSWORD", "APIKEY", "DBCONN", "PRIVATE_KEY", "BEARER_TOKEN", "JWT", "GENERIC")
SECRET_SOURCES = ("manual", "argv", "stdin", "proxy")
HEX_ENTROPY = 3.5
BASE64_ENTROPY = 4.5
MIN_ENTROPY_LENGTH = 20
DETECTION_WINDOW = 4096
RECENT_LIMIT = 20
CONFIG_ENTROPY_THRESHOLD = 4.0
# ----------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class CustomRule:
    """A user rule: the whole match is the value, confidence is high."""

    id: str
    regex: str
    type: str

    def __post_init__(self) -> None:
        if self.type not in SECRET_TYPES:
            raise ValueError(f"rule {self.id}: unknown type {self.type}")


@dataclass(frozen=True)
class DetectOptions:
    """Which detector stages run, and how.

    ``extra_detectors`` are callables from a text column to an array of candidate spans
    (see ``functions.spans.CANDIDATE``); they run after the built-in stages.
    """

    patterns: bool = True
    context: bool = True
    entropy: bool = True
    entropy_threshold: float | None = None
    custom_rules: tuple[CustomRule, ...] = ()
    anchors: bool = True
    extra_detectors: tuple[Callable[[Column], Column], ...] = field(default=())

    @staticmethod
    def argv(**kw) -> "DetectOptions":
        """Profile for command-line arguments: no entropy stage."""
        return DetectOptions(entropy=False, **kw)

    @staticmethod
    def configured_default(**kw) -> "DetectOptions":
        """Profile of the job configuration file defaults: entropy off, one threshold for both kinds."""
        return DetectOptions(entropy=False, entropy_threshold=CONFIG_ENTROPY_THRESHOLD, **kw)


def check_custom_rules(spark: SparkSession, rules: tuple[CustomRule, ...]) -> None:
    """Reject a rule whose regex does not compile, before any job starts."""
    for rule in rules:
        try:
            spark.range(1).select(F.regexp_like(F.lit(""), F.lit(rule.regex))).collect()
        except Exception as error:
            raise ValueError(f"rule {rule.id}: invalid regex") from error
