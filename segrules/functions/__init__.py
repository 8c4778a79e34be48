"""Column -> Column functions (path cleaning, rule text, frequencies)."""

from segrules.functions.paths import (
    clean_path,
    first_path_step,
    last_pipe_pair,
    normalize_separators,
    page_name_tail,
    strip_leading_non_letters,
    to_double,
)

__all__ = [
    "clean_path",
    "first_path_step",
    "last_pipe_pair",
    "normalize_separators",
    "page_name_tail",
    "strip_leading_non_letters",
    "to_double",
]
