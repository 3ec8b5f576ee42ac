"""Words as the operators for training text count them."""

from __future__ import annotations

import re

_WORD = re.compile(r"[^\W_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters or digits of the lower-cased text; an underscore separates."""
    return _WORD.findall(text.lower())
