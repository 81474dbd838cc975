"""Secret detection as one Catalyst expression per text column: provider patterns, keyword context, entropy."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from veilframe.config import BASE64_ENTROPY, HEX_ENTROPY, MIN_ENTROPY_LENGTH, CustomRule, DetectOptions
from veilframe.functions import rules
from veilframe.functions.spans import (
    as_findings, candidate, let, located_matches, merge, no_candidates, resolve_overlaps,
)

PATTERN_STAGE, CONTEXT_STAGE, ENTROPY_STAGE, EXTRA_STAGE = 0, 1, 2, 3


def _any_of(parts) -> Column:
    return reduce(lambda a, b: a | b, parts)


def _holds(text: Column, literals: tuple[str, ...]) -> Column | None:
    return _any_of(F.contains(text, F.lit(a)) for a in literals) if literals else None


def _gated(condition: Column | None, spans: Column) -> Column:
    return spans if condition is None else F.when(condition, spans).otherwise(no_candidates())


def pattern_spans(text: Column, pattern_id: str, type_: str, regex: str, anchors: tuple[str, ...],
                  ordinal: int, group: int = 1) -> Column:
    """Spans of one provider rule. ``anchors`` are literals without which the rule cannot match: a plain substring
    search over the text decides whether the regex runs at all."""
    hits = F.transform(located_matches(text, regex, group), lambda m: _pattern_hit(m, pattern_id, type_, ordinal, group))
    hits = F.filter(hits, lambda s: s["value"] != "")
    return _gated(_holds(text, anchors), hits)


def _pattern_hit(m: Column, pattern_id: str, type_: str, ordinal: int, group: int) -> Column:
    value = m["full"] if group == 0 else m["g1"]
    start = m["at"] if group == 0 else m["at"] + F.instr(m["full"], value) - 1
    end = start + F.length(value)
    return candidate(PATTERN_STAGE, ordinal, value, F.lit(type_), "high", pattern_id, start, end, start, end)


def provider_spans(text: Column, custom: tuple[CustomRule, ...] = (), anchors: bool = True) -> Column:
    """All provider rules, with the user's rules behind them."""
    parts = [
        pattern_spans(text, id_, type_, regex, literals if anchors else (), i)
        for i, (id_, type_, regex, literals) in enumerate(rules.PATTERNS)
    ]
    base = len(rules.PATTERNS)
    parts += [
        pattern_spans(text, rule.id, rule.type, rule.regex, (), base + i, group=0)
        for i, rule in enumerate(custom)
    ]
    return merge(parts)


def classify_keyword(keyword: Column) -> Column:
    """Type named by an English keyword or an assigned variable's name."""
    k = F.lower(keyword)
    return (
        F.when(F.contains(k, F.lit("password")) | F.contains(k, F.lit("passwd")) | F.contains(k, F.lit("口令")), "PASSWORD")
        .when(F.contains(k, F.lit("api_key")) | F.contains(k, F.lit("api-key")) | F.contains(k, F.lit("密钥")), "APIKEY")
        .when(F.contains(k, F.lit("token")), "BEARER_TOKEN")
        .otherwise("GENERIC")
    )


def trim_end(text: Column) -> Column:
    return F.rtrim(text, F.lit(rules.SPACE_LETTERS))


def context_rule_spans(text: Column, rule_id: str, regex: str, anchors: tuple[str, ...], ordinal: int) -> Column:
    """Spans of one keyword rule. A quoted value's span keeps its quotes; ``value_start/value_end`` leave them out."""

    def hit(m: Column) -> Column:
        raw = m["g2"]
        quoted = F.left(raw, F.lit(1)).isin('"', "'")
        body = F.when(quoted, raw).otherwise(trim_end(raw))
        start = m["at"] + F.length(m["full"])
        end = start + F.length(body)
        inset = F.when(quoted, 1).otherwise(0)
        value = F.when(quoted, F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(body)
        if rule_id == "context_cn_keyword":
            type_ = F.when(m["g1"] == "密钥", "APIKEY").otherwise("PASSWORD")
        else:
            type_ = classify_keyword(m["g1"])
        return candidate(CONTEXT_STAGE, ordinal, value, type_, "medium", rule_id, start, end, start + inset, end - inset)

    hits = F.filter(F.transform(located_matches(text, regex, 2), hit), lambda s: s["value"] != "")
    return _gated(_context_gate(text, rule_id, anchors), hits)


def _context_gate(text: Column, rule_id: str, anchors: tuple[str, ...]) -> Column | None:
    if rule_id == "context_en_keyword" and anchors:
        return let(F.lower(text), lambda low: _holds(low, anchors))
    return _holds(text, anchors)


def context_spans(text: Column, anchors: bool = True) -> Column:
    return F.array_distinct(merge(
        context_rule_spans(text, id_, regex, literals if anchors else (), i)
        for i, (id_, regex, literals) in enumerate(rules.CONTEXT)
    ))


def shannon_entropy(value: Column) -> Column:
    """Bits per character, summed in order of first appearance."""
    n = F.length(value)
    letters = F.array_distinct(F.regexp_extract_all(value, F.lit(r"[\s\S]"), F.lit(0)))

    def step(acc: Column, letter: Column) -> Column:
        p = (n - F.length(F.replace(value, letter, F.lit("")))) / n
        return acc - p * F.log2(p)

    return F.aggregate(letters, F.lit(0.0), step)


def char_groups(value: Column) -> Column:
    """How many of lower case, upper case, digit and base64 punctuation occur."""
    return reduce(lambda a, b: a + b, [F.rlike(value, F.lit(rx)).cast("int") for rx in rules.CHAR_GROUPS])


def is_whitelisted(value: Column) -> Column:
    """UUID, version, commit hash, URL, e-mail or a plain identifier."""
    return _any_of(F.rlike(value, F.lit(rx)) for rx in rules.WHITELIST)


def is_random_run(kind: str, value: Column, threshold: float) -> Column:
    """The cheap tests stand first, so that entropy is computed for few runs."""
    ok = (F.length(value) >= MIN_ENTROPY_LENGTH) & ~is_whitelisted(value)
    if kind == "entropy_base64":
        ok = ok & (char_groups(value) >= 3)
    return ok & (shannon_entropy(value) > threshold)


def entropy_kind_spans(text: Column, kind: str, regex: str, ordinal: int, threshold: float) -> Column:
    """Spans of one kind of run. Most runs are long words: positions are worked out only if one of them is kept."""

    def hit(m: Column) -> Column:
        end = m["at"] + F.length(m["g1"])
        return candidate(ENTROPY_STAGE, ordinal, m["g1"], F.lit("GENERIC"), "low", kind, m["at"], end, m["at"], end)

    def keep(wanted: Column) -> Column:
        spans = F.transform(located_matches(text, regex, 1), hit)
        return _gated(F.exists(wanted, lambda w: w), F.filter(spans, lambda s, i: F.get(wanted, i)))

    runs = F.regexp_extract_all(text, F.lit(regex), F.lit(1))
    return let(F.transform(runs, lambda run: is_random_run(kind, run, threshold)), keep)


def entropy_spans(text: Column, threshold: float | None = None) -> Column:
    """High-entropy runs; for one span found by both kinds the hex rule stays."""
    hex_rule, base64_rule = rules.ENTROPY
    hexes = entropy_kind_spans(text, *hex_rule, 0, HEX_ENTROPY if threshold is None else threshold)
    runs = entropy_kind_spans(text, *base64_rule, 1, BASE64_ENTROPY if threshold is None else threshold)

    def new(spans: Column) -> Column:  # sorted by place: spans of the same place stand side by side
        return F.filter(spans, lambda s, i: F.coalesce(
            (F.get(spans, i - 1)["start"] != s["start"]) | (F.get(spans, i - 1)["end"] != s["end"]), F.lit(True)))

    return let(F.concat(hexes, runs), lambda both: F.when(F.size(both) < 2, both).otherwise(let(F.sort_array(both), new)))


def detect(text: Column, options: DetectOptions = DetectOptions()) -> Column:
    """Array of findings of one text: stages in fixed order, overlaps resolved in favour of the earlier stage."""
    text = F.coalesce(text, F.lit(""))
    parts = []
    if options.patterns:
        parts.append(provider_spans(text, options.custom_rules, options.anchors))
    if options.context:
        parts.append(context_spans(text, options.anchors))
    if options.entropy:
        parts.append(entropy_spans(text, options.entropy_threshold))
    parts += [detector(text) for detector in options.extra_detectors]
    if not parts:
        return as_findings(no_candidates())
    return resolve_overlaps(merge(parts))


def may_hold_secret(text: Column, options: DetectOptions = DetectOptions()) -> Column:
    """Necessary condition for ``detect`` to return anything; false lets a row skip every join."""
    if options.custom_rules or options.extra_detectors:
        return F.lit(True)
    tests = []
    if options.patterns:
        tests.append(_holds(text, tuple(dict.fromkeys(a for _, _, _, anchors in rules.PATTERNS for a in anchors))))
    if options.context:
        tests += [_context_gate(text, id_, literals) for id_, _, literals in rules.CONTEXT]
    if options.entropy:
        tests += [F.rlike(text, F.lit(regex)) for _, regex in rules.ENTROPY]
    return F.coalesce(_any_of(tests), F.lit(False)) if tests else F.lit(False)


def infer_type(name: Column, secret: Column, custom: tuple[CustomRule, ...] = ()) -> Column:
    """Type of a secret registered by hand: a provider rule that covers it entirely, else words in its name."""
    spans = F.sort_array(provider_spans(secret, custom))
    whole = F.filter(spans, lambda s: (s["start"] == 0) & (s["end"] == F.length(secret)))
    n = F.lower(name)

    def has(*words: str) -> Column:
        return _any_of(F.contains(n, F.lit(w)) for w in words)

    by_name = (
        F.when(has("pass"), "PASSWORD")
        .when(has("private", "pem", "ssh"), "PRIVATE_KEY")
        .when(has("jwt"), "JWT")
        .when(has("bearer"), "BEARER_TOKEN")
        .when(has("token", "key", "secret"), "APIKEY")
        .otherwise("GENERIC")
    )
    return F.coalesce(F.try_element_at(whole, F.lit(1))["type"], by_name)
