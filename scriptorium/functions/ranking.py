"""Scores of search candidates as column arithmetic.

score = base * (1 + 0.5 * coverage + 0.75 if phrase, else 0.35 if ordered and near) * class / length

Everything is computed from the candidate's own text and the query's terms, so equal input has equal
scores, and the class of a match orders results before scores do.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.lexemes import collapse

#: The weights of the score.
STRUCTURE = {"document-title": 100, "heading": 100, "table-cell": 60, "paragraph": 40, "list-item": 40, "figure-caption": 40}
COVERAGE = 0.5
PHRASE = 0.75
ORDERED_NEAR = 0.35
NEAR_WINDOW = 80
CLASSES = {"direct": 1.0, "prefix": 0.6, "stemmed": 0.55, "synonym": 0.5, "partial": 0.35, "corrected": 0.25}
PIVOT_LENGTH = 240
DECAY_PER_DOUBLING = 0.18

#: Match classes from strict to loose; the strategy that a loosest visible class stands for.
TIERS = list(CLASSES)
STRATEGIES = {"direct": "strict"} | {c: c for c in TIERS[1:]}


def rounded(x: Column) -> Column:
    """Six decimals, halves up."""
    return F.floor(x * 1_000_000 + 0.5) / 1_000_000


def score_components(block_type: Column, content: Column, terms: tuple[str, ...], phrases: tuple[tuple[str, ...], ...], match_class: str) -> Column:
    """A struct of all that makes up a score; final_score is the score."""
    text = collapse(content)
    low = F.lower(text)
    base = reduce(lambda rest, kv: F.when(block_type == kv[0], float(kv[1])).otherwise(rest), STRUCTURE.items(), F.lit(40.0))
    places = [F.instr(low, t) for t in terms]  # 0: not there
    matched = reduce(lambda a, b: a + b, [(p > 0).cast("int") for p in places], F.lit(0))
    coverage = matched / F.lit(float(max(1, len(terms)))) if terms else F.lit(0.0)
    whole = [" ".join(terms)] * bool(terms) + [" ".join(p) for p in phrases if p]
    phrase = reduce(lambda a, b: a | b, [F.contains(low, F.lit(w)) for w in whole], F.lit(False))
    if len(places) > 1:
        in_order = reduce(lambda a, b: a & b, [a <= b for a, b in zip(places, places[1:])])
        there = reduce(lambda a, b: a & b, [p > 0 for p in places])
        near = ~phrase & there & in_order & (places[-1] - places[0] <= NEAR_WINDOW)
    else:
        near = F.lit(False)
    coverage_bonus = base * COVERAGE * coverage
    phrase_bonus = F.when(phrase, base * PHRASE).otherwise(0.0)
    near_bonus = F.when(near, base * ORDERED_NEAR).otherwise(0.0)
    raw = (base + coverage_bonus + phrase_bonus + near_bonus) * CLASSES[match_class]
    length = F.length(text)
    shrink = F.when(length <= PIVOT_LENGTH, 1.0).otherwise(1 + DECAY_PER_DOUBLING * F.log2(length / PIVOT_LENGTH))
    return F.struct(
        block_type.alias("block_type"),
        base.alias("structural_weight"),
        F.lit(match_class).alias("match_class"),
        F.lit(CLASSES[match_class]).alias("match_class_multiplier"),
        matched.alias("distinct_terms_matched"),
        F.lit(len(terms)).alias("distinct_terms_total"),
        rounded(coverage).alias("coverage_ratio"),
        rounded(coverage_bonus).alias("coverage_bonus"),
        phrase.alias("exact_phrase_match"),
        rounded(phrase_bonus).alias("phrase_bonus"),
        near.alias("ordered_near_match"),
        rounded(near_bonus).alias("ordered_near_bonus"),
        length.alias("content_length"),
        rounded(shrink).alias("length_normalization_factor"),
        rounded(raw).alias("raw_score"),
        rounded(raw / shrink).alias("final_score"),
    )
