"""Personal data by candidate gradient boosting, in DataFrame expressions only.

Fixed rules find what is certain (the base). High-recall generators propose further spans, which overlap each other and the
base. Features of format and context, each a small number, describe a candidate. Boosted trees are trained on the candidates
of the corpus itself: one that equals a base span is personal data, one that a rule has looked at and refused is not, and
one inside a longer match (two numbers side by side that a rule reads as one) teaches nothing. A candidate's
features take few values, so the whole corpus is counted per combination of them, and the trees are grown on these counts.
On documents held out of growing the scores are calibrated (isotonic), and a kind's threshold is where the calibrated
probability reaches ``precision``. The trees become a column expression again.

The base stays as it is. Of added candidates that overlap each other the best one stays; one that overlaps the base goes.

Defined results: null text is empty; a table without candidates, or a kind without positive ones, adds nothing; rows are
handled one by one, so repeated rows give repeated results, and columns of any name stand beside (``find_personal_data``
returns the given columns and adds its own, lengthened with ``_`` where a name is taken).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilframe.functions.scans import located, running, running_sums
from veilframe.functions.spans import let
from veilframe.llm.common import free_name

KINDS = ("email", "ip", "card", "phone")

# The base rules, written so that no match backs up: a run that cannot match is left at once, not tried from each of its places.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}

#: Plain looks that tell most texts without a match of a base rule.
WORTH = {"email": "@[A-Za-z0-9-]", "ip": r"[0-9]\.[0-9]", "card": r"(?:[0-9][\x20-]?){12}", "phone": r"\+[0-9]"}

#: Generators: kind, plain look, pattern. A kind may have several; each proposes spans that do not overlap within it.
GENERATORS = (
    ("email", "@[A-Za-z0-9-]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)*+"),
    ("email", r"[\[({](?:at|AT|@)[\])}]", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++ ?[\[({](?:at|AT|@)[\])}] ?[A-Za-z0-9-]++"
     r"(?: ?[\[({](?:dot|DOT|\.)[\])}] ?[A-Za-z0-9-]++|\.[A-Za-z0-9-]++)*+"),
    ("ip", r"[0-9]\.[0-9]", r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])"),
    ("ip", r"[\[(]\.[\])]", r"(?<![0-9])[0-9]{1,3}(?:[\[(]\.[\])][0-9]{1,3}){3}(?![0-9])"),
    ("card", "[0-9]{12}", r"(?<![0-9])[0-9]{12,19}(?![0-9])"),
    ("card", r"[0-9]{4}[\x20.-][0-9]{4}", r"(?<![0-9])[0-9]{4}(?:[\x20.-][0-9]{4}){3}(?:[\x20.-][0-9]{1,3})?(?![0-9])"),
    ("phone", r"\([0-9]{2,4}\)", r"(?:\+|(?<![0-9+]))[0-9]{1,3}[\x20.-]?\([0-9]{2,4}\)[\x20.-]?[0-9]{3,4}[\x20.-]?[0-9]{3,4}(?![0-9])"),
    ("phone", r"[0-9]{3}[\x20.-][0-9]{4}", r"(?:\+[0-9]{1,3}[\x20.-])?(?:\([0-9]{3}\)\x20?|(?<![0-9(])[0-9]{3}[\x20.-])[0-9]{3}[\x20.-][0-9]{4}(?![0-9])"),
)

CONTEXT = (
    r"(?:phone|tel|call|fax|mobile|contact|whatsapp|mail|write|reach)",
    r"(?:card|visa|master|amex|pay|credit|debit|account|iban)",
    r"(?:\bip\b|host|server|addr|ping|gateway|login)",
    r"(?:token|passw|secret|key|hash|sha|md5|uuid|version|isbn|licen|cc by)",
)

#: The number of values of each feature; their product bounds the table of counts, whatever the size of the corpus.
FEATURES = {"generator": len(GENERATORS), "digits": 8, "valid": 2, "left": 4, "right": 4, "marks": 3, "lead": 4, "words": 5}
SPAN = "struct<start:int,end:int>"
CANDIDATE = "struct<start:int,end:int,kind:int," + ",".join(f"{f}:int" for f in FEATURES) + ">"


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the check digit is right: from the right, every second digit counts twice, less nine above nine."""
    twice = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(
        c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(twice, F.lit(0), lambda total, d: total + F.coalesce(d, F.lit(0))) % 10 == 0


def _small_parts(value: Column) -> Column:
    return F.rlike(value, F.lit(r"^(?:[^0-9]*0*(?:25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])(?![0-9])){4}$"))


def _holds(kind: str, value: Column) -> Column:
    """What a base match of ``kind`` must fulfil besides its pattern."""
    if kind == "email":
        return F.lit(True)
    if kind == "ip":
        return _small_parts(value)
    return let(_digits(value), lambda d: F.when(
        F.length(d).between(16, 19), luhn(d)).otherwise(False) if kind == "card" else F.length(d).between(8, 15))


def base_matches(text: Column, kind: str) -> Column:
    """Every match of the kind's pattern: array of (start, end, holds); those that do not hold are no spans."""
    shape = "array<struct<start:int,end:int,holds:boolean>>"
    found = F.transform(located(text, BASE[kind]), lambda m: F.struct(
        m["at"].alias("start"), (m["at"] + F.length(m["value"])).alias("end"), _holds(kind, m["value"]).alias("holds")))
    return F.when(F.rlike(text, F.lit(WORTH[kind])), found.cast(shape)).otherwise(F.array().cast(shape))


def _class(char: Column) -> Column:
    """Nothing, space, letter or digit, other."""
    return F.when(char == "", 0).when(F.rlike(char, F.lit(r"[\s ]")), 1).when(F.rlike(char, F.lit(r"[\p{L}\p{N}]")), 2).otherwise(3)


def _features(generator: int, kind: str, m: Column) -> Column:
    value, lower = m["value"], F.lower(m["before"])
    count = F.length(_digits(value))
    digits = F.when(count < 8, F.least(count, F.lit(1))).when(count < 10, 2).when(count < 12, 3).when(
        count < 13, 4).when(count < 16, 5).when(count < 20, 6).otherwise(7)
    if kind == "card":
        valid = let(_digits(value), luhn)
    elif kind == "email":
        valid = F.rlike(value, F.lit(r"(?:\.|[\[({](?:dot|DOT|\.)[\])}] ?)[A-Za-z]{2,}$"))
    else:
        valid = _small_parts(value) if kind == "ip" else count.between(8, 15)
    marks = F.size(F.array_distinct(F.split(F.regexp_replace(value, r"[0-9A-Za-z+]", ""), "")))
    words = F.lit(0)
    for place, pattern in reversed(list(enumerate(CONTEXT, 1))):
        words = F.when(F.rlike(lower, F.lit(pattern)), place).otherwise(words)
    lead = F.left(value, F.lit(1))
    return F.struct(
        m["at"].alias("start"), (m["at"] + F.length(value)).alias("end"), F.lit(KINDS.index(kind)).alias("kind"),
        F.lit(generator).alias("generator"), digits.alias("digits"), valid.cast("int").alias("valid"),
        _class(F.right(m["before"], F.lit(1))).alias("left"), _class(F.left(m["after"], F.lit(1))).alias("right"),
        F.least(marks - 1, F.lit(2)).alias("marks"),
        F.when(lead == "+", 1).when(lead == "(", 2).when(lead == "0", 3).otherwise(0).alias("lead"), words.alias("words"))


def _describe(generator: int, kind: str) -> Callable[[Column], Column]:
    return lambda m: _features(generator, kind, m)


def candidates(text: Column) -> Column:
    """What all generators propose, with features, as one array."""
    parts = []
    for number, (kind, look, pattern) in enumerate(GENERATORS):
        found = F.transform(located(text, pattern), _describe(number, kind)).cast(f"array<{CANDIDATE}>")
        parts.append(F.when(F.rlike(text, F.lit(look)), found).otherwise(F.array().cast(f"array<{CANDIDATE}>")))
    return F.concat(*parts)


def _judged(base: dict[str, Column], proposed: Column) -> Column:
    """Candidates with ``label``: 1 equals a base span of its kind, 0 not, null inside a longer match of a rule.

    Per kind candidates and matches are sorted together; the last match that starts at or before a candidate is a running
    maximum, since matches of a kind do not overlap."""
    last = "struct<start:int,end:int,holds:boolean>"
    row = f"array<struct<start:int,turn:int,seen:{last},candidate:{CANDIDATE}>>"
    out = []
    for place, kind in enumerate(KINDS):
        own = F.filter(proposed, lambda c: c["kind"] == place)
        both = F.concat(
            F.transform(base[kind], lambda b: F.struct(b["start"], F.lit(0), b, F.lit(None).cast(CANDIDATE))).cast(row),
            F.transform(own, lambda c: F.struct(c["start"], F.lit(1), F.lit(None).cast(last), c)).cast(row))

        def label(rows: Column) -> Column:
            def judge(seen: Column) -> Column:
                def one(c: Column, b: Column) -> Column:
                    same = (b["start"] == c["start"]) & (b["end"] == c["end"])
                    return F.when(b.isNull(), 0).when(same, b["holds"].cast("int")).when(b["end"] >= c["end"], None).otherwise(0)
                paired = F.zip_with(rows, seen, lambda r, b: F.struct(
                    r["candidate"].alias("candidate"), one(r["candidate"], b).cast("int").alias("label")))
                return F.filter(paired, lambda p: p["candidate"].isNotNull())
            return let(running(F.transform(rows, lambda r: r["seen"]), lambda a, b: F.greatest(a, b)), judge)

        out.append(F.when(F.size(own) == 0, F.array().cast(f"array<struct<candidate:{CANDIDATE},label:int>>")).otherwise(
            let(F.array_sort(both), label)))
    return F.concat(*out)


# --- trees ------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Tree:
    """A split (value of ``feature`` is at most ``at``) with two sides, or a leaf with a ``score``."""

    feature: str | None = None
    at: int = 0
    low: "Tree | None" = None
    high: "Tree | None" = None
    score: float = 0.0

    def values(self, cells: dict[str, np.ndarray]) -> np.ndarray:
        if self.feature is None:
            return np.full(len(cells["generator"]), self.score)
        return np.where(cells[self.feature] <= self.at, self.low.values(cells), self.high.values(cells))

    def column(self, candidate: Column) -> Column:
        if self.feature is None:
            return F.lit(self.score)
        return F.when(candidate[self.feature] <= self.at, self.low.column(candidate)).otherwise(self.high.column(candidate))


@dataclass(frozen=True)
class Model:
    """Boosted trees and the least score per kind that is redacted (infinite: never)."""

    trees: tuple[Tree, ...]
    thresholds: tuple[float, ...]
    start: float = 0.0

    def scores(self, cells: dict[str, np.ndarray]) -> np.ndarray:
        return self.start + sum((t.values(cells) for t in self.trees), np.zeros(len(cells["generator"])))

    def column(self, candidate: Column) -> Column:
        total = F.lit(self.start)
        for tree in self.trees:
            total = total + tree.column(candidate)
        return total

    def chosen(self, candidate: Column, score: Column) -> Column:
        least = F.element_at(F.array(*[F.lit(x) for x in self.thresholds]), candidate["kind"] + 1)
        return score >= least


NOTHING = Model((), (float("inf"),) * len(KINDS))


def _grow(cells, gradient, hessian, here, depth: int, ridge: float) -> Tree:
    """A tree by second-order gains; ties take the first feature and the least value."""
    g, h = gradient[here].sum(), hessian[here].sum()
    best = (1e-6, None, 0)
    if depth:
        for feature, size in FEATURES.items():
            bins = cells[feature][here]
            left_g = np.cumsum(np.bincount(bins, gradient[here], size))[:-1]
            left_h = np.cumsum(np.bincount(bins, hessian[here], size))[:-1]
            gain = left_g**2 / (left_h + ridge) + (g - left_g)**2 / (h - left_h + ridge) - g**2 / (h + ridge)
            at = int(np.argmax(gain))
            if gain[at] > best[0] + 1e-9:
                best = (gain[at], feature, at)
    if best[1] is None:
        return Tree(score=float(-g / (h + ridge)))
    low = here & (cells[best[1]] <= best[2])
    return Tree(best[1], best[2], _grow(cells, gradient, hessian, low, depth - 1, ridge),
                _grow(cells, gradient, hessian, here & ~low, depth - 1, ridge))


def boost(cells: dict[str, np.ndarray], ones: np.ndarray, zeros: np.ndarray, rounds: int = 24, depth: int = 3,
          rate: float = 0.4, ridge: float = 1.0) -> tuple[tuple[Tree, ...], float]:
    """Logistic boosting on counted cells: ``ones`` and ``zeros`` are the numbers of candidates of either label."""
    weight = ones + zeros
    start = float(np.log((ones.sum() + 1) / (zeros.sum() + 1)))
    score, trees = np.full(len(weight), start), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(cells, weight * p - ones, weight * p * (1 - p), np.ones(len(weight), bool), depth, ridge)
        tree = _scaled(tree, rate)
        trees.append(tree)
        score = score + tree.values(cells)
    return tuple(trees), start


def _scaled(tree: Tree, rate: float) -> Tree:
    if tree.feature is None:
        return Tree(score=tree.score * rate)
    return Tree(tree.feature, tree.at, _scaled(tree.low, rate), _scaled(tree.high, rate))


def isotonic(score: np.ndarray, ones: np.ndarray, zeros: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rising steps of the probability over the score: the least score of each step, and its probability (pooled
    neighbours that would fall; one pseudo-count keeps small steps away from certainty)."""
    steps: list[list[float]] = []
    for s in np.unique(score):
        here = score == s
        steps.append([float(s), float(ones[here].sum()), float(zeros[here].sum())])
        while len(steps) > 1 and steps[-1][1] * (steps[-2][1] + steps[-2][2]) <= steps[-2][1] * (steps[-1][1] + steps[-1][2]):
            _, a, b = steps.pop()
            steps[-1][1] += a
            steps[-1][2] += b
    return np.array([s[0] for s in steps]), np.array([s[1] / (s[1] + s[2] + 1) for s in steps])


def learn(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", precision: float = 0.9) -> Model:
    """Count the candidates of the whole corpus per combination of features, grow the trees on four fifths of the documents
    (by CRC-32 of the identifier), calibrate on the rest. What reaches the driver is the table of combinations that occur.

    With fewer than 20 labelled candidates in the held-out fifth, calibration uses all documents."""
    judged = _judged_rows(docs, text_col, F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False)))
    counted = judged.where("label IS NOT NULL").groupBy("kind", *FEATURES, "held").agg(
        F.sum("label").alias("ones"), F.count("*").alias("n")).orderBy("kind", *FEATURES, "held").collect()
    if not counted:
        return NOTHING
    cells = {f: np.array([r[f] for r in counted]) for f in FEATURES}
    kind, held = np.array([r["kind"] for r in counted]), np.array([r["held"] for r in counted])
    ones = np.array([r["ones"] for r in counted], float)
    zeros = np.array([r["n"] for r in counted], float) - ones
    fit = ~held if (~held).any() else held
    trees, start = boost({f: v[fit] for f, v in cells.items()}, ones[fit], zeros[fit])
    score = Model(trees, (), start).scores(cells)
    test = held if (ones + zeros)[held].sum() >= 20 else np.ones(len(held), bool)
    thresholds = []
    for place in range(len(KINDS)):
        own = test & (kind == place)
        least, probability = isotonic(score[own], ones[own], zeros[own])
        good = least[probability >= precision]
        thresholds.append(float(good[0]) if len(good) else float("inf"))
    return Model(trees, tuple(thresholds), start)


def _with_parts(docs: DataFrame, text_col: str, *more: Column) -> DataFrame:
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return docs.select(*more, F.struct(*[base_matches(text, k).alias(k) for k in KINDS]).alias("_base"), candidates(text).alias("_proposed"))


def _judged_rows(docs: DataFrame, text_col: str, held: Column) -> DataFrame:
    parts = _with_parts(docs, text_col, held.alias("held"))
    judged = _judged({k: F.col("_base")[k] for k in KINDS}, F.col("_proposed"))
    return parts.where(F.size("_proposed") > 0).select("held", F.explode(judged).alias("j")).select("held", "j.candidate.*", "j.label")


def _added(base: Column, proposed: Column, model: Model) -> Column:
    """Chosen candidates that overlap no base span, the best of each stretch of overlapping ones.

    All spans are sorted by start; a stretch begins where no earlier span reaches. Within a stretch the running maximum of
    (stretch, base, score, position) ends with its best, so one pass of running maxima settles all stretches at once."""
    chosen = F.filter(F.transform(proposed, lambda c: F.struct(
        c["start"].alias("start"), c["end"].alias("end"), c["kind"].alias("kind"), model.column(c).alias("score"),
        model.chosen(c, model.column(c)).alias("chosen"))), lambda c: c["chosen"])
    span = "array<struct<start:int,end:int,kind:int,score:double,fixed:boolean>>"
    none = F.array().cast("array<struct<start:int,end:int,kind:int,score:double>>")

    def settle(added: Column) -> Column:
        every = F.array_sort(F.concat(
            F.transform(added, lambda c: F.struct(c["start"], c["end"], c["kind"], c["score"], F.lit(False))).cast(span),
            F.transform(base, lambda b: F.struct(b["start"], b["end"], b["kind"], F.lit(0.0), F.lit(True))).cast(span)))

        def stretches(rows: Column) -> Column:
            reach = running(F.transform(rows, lambda r: r["end"]), lambda a, b: F.greatest(a, b))
            heads = let(reach, lambda ends: F.transform(rows, lambda r, i: F.when(
                (i == 0) | (r["start"] >= F.get(ends, i - 1)), 1).otherwise(0)))
            best = let(running_sums(heads), lambda number: running(F.transform(rows, lambda r, i: F.struct(
                F.get(number, i).alias("stretch"), r["fixed"].alias("fixed"), r["score"].alias("score"), (r["end"] - r["start"]).alias("size"),
                (-r["start"]).alias("place"), (-r["kind"]).alias("order"))), lambda a, b: F.greatest(a, b)))
            lasts = let(best, lambda bs: F.filter(bs, lambda b, i: F.coalesce(F.get(bs, i + 1)["stretch"] != b["stretch"], F.lit(True))))
            return F.transform(F.filter(lasts, lambda b: ~b["fixed"]), lambda b: F.struct(
                (-b["place"]).alias("start"), (b["size"] - b["place"]).alias("end"), (-b["order"]).alias("kind"), b["score"].alias("score")))

        return F.when(F.size(added) == 0, none).otherwise(let(every, stretches))

    return let(chosen, settle)


def _kept(matches: Column, kind: int) -> Column:
    return F.transform(F.filter(matches, lambda b: b["holds"]), lambda b: F.struct(
        b["start"].alias("start"), b["end"].alias("end"), F.lit(kind).alias("kind")))


FOUND = "array<struct<kind:string,start:int,end:int,added:boolean,score:double>>"


def find_personal_data(docs: DataFrame, model: Model, text_col: str = "text", into: str = "personal") -> DataFrame:
    """The given columns and ``into``: an array of (kind, start, end, added, score), by kind and start. Code points, the end
    exclusive; ``score`` is null for the base. The whole text counts, however long; nothing is shuffled."""
    into = free_name(docs.columns, into)
    base_name, proposed_name = free_name(docs.columns, "_base"), free_name(docs.columns, "_proposed")
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    held = F.concat(*[_kept(base_matches(text, k), i) for i, k in enumerate(KINDS)])
    parts = docs.select("*", held.alias(base_name), candidates(text).alias(proposed_name))
    extra_name = free_name([*docs.columns, into], "_added")
    added = parts.select("*", F.when(F.size(proposed_name) == 0, None).otherwise(
        _added(F.col(base_name), F.col(proposed_name), model)).alias(extra_name))
    row = "array<struct<place:int,start:int,end:int,added:boolean,score:double>>"
    both = F.concat(
        F.transform(base_name, lambda b: F.struct(b["kind"], b["start"], b["end"], F.lit(False), F.lit(None).cast("double"))).cast(row),
        F.coalesce(F.transform(extra_name, lambda c: F.struct(c["kind"], c["start"], c["end"], F.lit(True), c["score"])).cast(row), F.array().cast(row)))
    names = F.array(*[F.lit(k) for k in KINDS])
    found = F.transform(F.array_sort(both), lambda s: F.struct(F.get(names, s["place"]), s["start"], s["end"], s["added"], s["score"])).cast(FOUND)
    return added.select(*[F.col(f"`{c}`") for c in docs.columns], found.alias(into))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined with commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; of spans that overlap, the rest of the later one goes too."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))

    def build(rows: Column) -> Column:
        reach = running(F.transform(rows, lambda r: r["end"]), lambda a, b: F.greatest(a, b))
        return let(reach, lambda ends: F.concat(F.array_join(F.transform(rows, lambda r, i: let(
            F.when(i == 0, 0).otherwise(F.get(ends, i - 1)), lambda done: F.concat(
                F.when(r["start"] > done, F.substring(text, done + 1, r["start"] - done)).otherwise(""),
                F.when(r["end"] > done, F.concat(F.lit("["), r["kind"], F.lit("]"))).otherwise("")))), ""),
            F.substring(text, F.element_at(ends, -1) + 1, F.length(text))))

    return F.when(F.size(spans) == 0, text).otherwise(let(ordered, build))


def personal_data(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", precision: float = 0.9) -> DataFrame:
    """Learn from the documents and find in them: the given columns and ``personal``."""
    return find_personal_data(docs, learn(docs, text_col, id_col, precision), text_col)
