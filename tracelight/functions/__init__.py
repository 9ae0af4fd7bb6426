"""Column expressions: text, numbers, detection flags, labels and normal scores."""

from tracelight.functions.labels import (
    contact_label, is_detected, is_floor, is_high_touch, matches, room_key, severity_class,
    severity_rank, site_category, subject_key,
)
from tracelight.functions.numbers import (
    even_grid, log10_abundance, null_to_zero, percent_text, replace_where, round_half_even,
    significant, tidy_number,
)
from tracelight.functions.normal import inverse_normal, normal_score, uniform_score
from tracelight.functions.text import extract_word, spread_text, strip_digits, title_words

__all__ = [
    "contact_label", "even_grid", "extract_word", "inverse_normal", "is_detected", "is_floor",
    "is_high_touch", "log10_abundance", "matches", "normal_score", "null_to_zero",
    "percent_text", "replace_where", "room_key", "round_half_even", "severity_class",
    "severity_rank", "significant", "site_category", "spread_text", "strip_digits",
    "subject_key", "tidy_number", "title_words", "uniform_score",
]
