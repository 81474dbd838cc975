"""Language identification with hyperdimensional profiles.

A letter has a fixed random vector of +1 and -1. A letter n-gram is bound from its letters' vectors, each rotated by its
place; a document is the bundle (sum) of its n-grams, a language the bundle of its documents, each at length one. The
language of a document is the prototype of the largest cosine.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.llm.common import U64, give_back, lean, mix, pieces

DIMENSIONS = 1024
GRAM = 3
UNKNOWN = "und"
_CHUNK = 1 << 19
_LETTERS: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    if not _LETTERS:
        _LETTERS.append(np.array([chr(c).isalpha() for c in range(0x110000)], bool))
    return _LETTERS[0]


def letter_vectors(points: np.ndarray, dimensions: int) -> np.ndarray:
    """The fixed random +1/-1 vector of each code point (0 stands for a word border)."""
    words = mix(points.astype(U64)[:, None] * U64(0x9E3779B97F4A7C15) + np.arange(1, dimensions // 64 + 1, dtype=U64))
    bits = np.unpackbits(words.view(np.uint8).reshape(len(points), -1), axis=1)
    return (bits.astype(np.int8) * 2 - 1).astype(np.int8)


def bundles(texts: list[str], dimensions: int = DIMENSIONS) -> tuple[np.ndarray, np.ndarray]:
    """The bundle of each text at length one, and whether the text holds a letter. Runs of other characters count as one
    word border; a text with a letter but fewer than three symbols is the bundle of those it has."""
    lower = [t.lower() for t in texts]
    sizes = np.array([len(t) + 1 for t in lower])
    points = np.frombuffer(" ".join(lower + [""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    doc = np.repeat(np.arange(len(texts)), sizes)
    letter = _is_letter()[points]
    has_letter = np.bincount(doc[letter], minlength=len(texts)) > 0
    points = np.where(letter, points, 0)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # one border after each run of letters
    points, doc = points[keep], doc[keep]
    distinct, symbol = np.unique(points, return_inverse=True)
    if len(distinct) == 0:
        return np.zeros((len(texts), dimensions), np.float32), has_letter
    base = len(distinct)
    n = max(len(points) - GRAM + 1, 0)
    inside = doc[:n] == doc[GRAM - 1:GRAM - 1 + n]
    code = np.zeros(n, np.int64)
    for i in range(GRAM):
        code = code * base + symbol[i:i + n]
    code, owner = code[inside], doc[:n][inside]
    lone = has_letter & (np.bincount(owner, minlength=len(texts)) == 0)
    if base ** GRAM <= 1 << 22:
        seen = np.zeros(base ** GRAM, bool)
        seen[code] = True
        grams = np.flatnonzero(seen)
        place = np.zeros(base ** GRAM, np.int32)
        place[grams] = np.arange(len(grams))
        which = place[code]
    else:
        grams, which = np.unique(code, return_inverse=True)
    letters = letter_vectors(distinct, dimensions)
    bound = np.ones((len(grams), dimensions), np.int8)
    for i in range(GRAM):
        bound *= np.roll(letters, GRAM - 1 - i, axis=1)[grams // base ** (GRAM - 1 - i) % base]
    counts = np.bincount(owner * np.int64(len(grams)) + which, minlength=len(texts) * len(grams))
    sums = counts.reshape(len(texts), len(grams)).astype(np.float32) @ bound.astype(np.float32)
    for d in np.flatnonzero(lone):
        sums[d] = letters[symbol[doc == d]].sum(axis=0)
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return sums / np.where(length == 0, 1, length), has_letter


def _in_chunks(texts: pa.Array):
    """Lists of texts of about the same number of characters, so that no count table grows with the batch."""
    values = texts.to_pylist()
    bounds = np.r_[0, np.cumsum([len(t or "") + 1 for t in values])]
    for a, b in pieces(bounds, _CHUNK):
        yield [t or "" for t in values[a:b]]


@dataclass(frozen=True)
class Profiles:
    """One prototype of length one per language, in the order of ``languages``."""

    languages: tuple[str, ...]
    prototypes: np.ndarray


def learn_profiles(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", per_language: int = 2000,
                   dimensions: int = DIMENSIONS, id_col: str = "doc_id") -> Profiles:
    """Prototypes from labelled rows; those with null text or language teach nothing.

    ``per_language`` bounds the sample: of a language with more rows about that many are taken, chosen by a hash of the
    identifier (``id_col``, if there is one) and the text, so that of many copies of a text some are in and some are not. What reaches the driver is one vector per language and task of 16.
    """
    drawn = [F.col(id_col).cast("string")] if id_col in labelled.columns else []
    rows = labelled.select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"), F.pmod(
        F.xxhash64(*drawn, F.col(text_col).cast("string")), F.lit(1 << 30)).alias("draw")).where("text IS NOT NULL AND lang IS NOT NULL")
    counts = {r["lang"]: r["n"] for r in labelled.where(F.col(lang_col).isNotNull()).groupBy(
        F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).collect()}
    if not counts:
        return Profiles((), np.zeros((0, dimensions), np.float32))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_language / n))])
    sample = rows.where(F.col("draw") < share[F.col("lang")] * (1 << 30)).drop("draw")

    def bundle(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, at = batch.column("lang").to_pylist(), 0
            for texts in _in_chunks(batch.column("text")):
                vectors, known = bundles(texts, dimensions)
                for i in np.flatnonzero(known):
                    sums.setdefault(langs[at + i], np.zeros(dimensions))
                    sums[langs[at + i]] += vectors[i]
                at += len(texts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(sums), pa.string()), pa.array([v.tobytes() for v in sums.values()], pa.binary())],
            ["lang", "bundle"])

    parts = sample.repartition(16).mapInArrow(lean(bundle), "lang string, bundle binary").collect()
    languages = tuple(sorted({r["lang"] for r in parts}))
    sums = np.zeros((len(languages), dimensions))
    for r in sorted(parts, key=lambda r: (r["lang"], bytes(r["bundle"]))):
        sums[languages.index(r["lang"])] += np.frombuffer(r["bundle"])
    length = np.linalg.norm(sums, axis=1, keepdims=True)
    return Profiles(languages, (sums / np.where(length == 0, 1, length)).astype(np.float32))


def language_of(text: Column, profiles: Profiles) -> Column:
    """A struct of ``lang_pred`` and ``score`` (the cosine, 0 to 1) for a text column.

    Null, empty and letterless texts are ``und`` with score 0, and so is every text when nothing was learned; of equal
    cosines the first language in alphabetical order wins. The whole text counts, however long.
    """
    languages, prototypes = profiles.languages, profiles.prototypes

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    def predict(texts: pa.Array) -> pa.Array:
        names, scores = [], []
        for chunk in _in_chunks(texts):
            vectors, known = bundles(chunk, prototypes.shape[1])
            if not languages:
                known[:] = False
            cosine = vectors @ prototypes.T if languages else np.zeros((len(chunk), 1))
            best = cosine.argmax(axis=1)
            names += [languages[b] if k else UNKNOWN for b, k in zip(best, known)]
            scores += np.where(known, np.clip(cosine[np.arange(len(chunk)), best], 0, 1), 0).tolist()
        give_back()
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return predict(text.cast("string"))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept out of learning: CRC-32 of the identifier as text leaves 2 when divided by 4. A null one does not."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def reject_unidentified(docs: DataFrame, profiles: Profiles, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows whose language is known, with their columns: those that are ``und``, or below ``min_score``, go."""
    found = language_of(F.col(text_col), profiles)
    kept = docs.where((found["lang_pred"] != UNKNOWN) & (found["score"] >= min_score))
    return kept.select(*docs.columns)
