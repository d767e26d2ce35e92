"""Column-level (Catalyst expression) building blocks."""

from peakscreen.functions.cleaning import (  # noqa: F401
    sample_code, drop_suffix, remove_literals, merge_synonyms, replace_substring,
    strip_last_chars, coerce_double, fill_zero, null_tokens)
from peakscreen.functions.decisions import (  # noqa: F401
    label_from_result, decision, expected_outcome, false_pos, false_neg,
    sample_flag, parse_acquisition, false_neg_adjusted, row_profit_cents,
    error_flags, f1_from_counts)
from peakscreen.functions.decisions import (  # noqa: F401,E402
    precision_from_counts, recall_from_counts, round_half_even)
from peakscreen.functions.names import display_name  # noqa: F401,E402
