"""Find secrets in text, replace them by reversible tokens, and put them back: as Spark jobs."""

from veilframe.config import DetectOptions

__all__ = ["DetectOptions"]
