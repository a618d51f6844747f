"""Thresholds of the rules. Every operator that applies a rule takes one `Params`."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    # Fixed values. Shares are kept as (numerator, denominator) so that comparisons stay in integers.
    majority: tuple[int, int] = (1, 2)
    united: tuple[int, int] = (9, 10)
    min_members: int = 3
    reference_term: int = 19
    min_denominator: int = 30
    minority: tuple[int, int] = (1, 4)
    per_theme: int = 5
    important_weight: int = 2
    tie_margin: int = 3
    nobody_below: int = 50
    mean_affinity_tolerance: int = 5
    first_share_tolerance: int = 10
    area_recognition: tuple[int, int] = (7, 10)
    min_quote: int = 15
    shingle_words: int = 6
    shared_text: tuple[int, int] = (1, 2)
    readable_window: int = 20
    readable_known: tuple[int, int] = (8, 10)
    batch_chars: int = 12_000
    batch_items: int = 100
    text_days: int = 7


DEFAULT = Params()
