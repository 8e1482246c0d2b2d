"""Markers of chat models in plain texts."""

from __future__ import annotations

import re

# The marks around an answer, in the order in which they go.
_AROUND = (re.compile(r"\A<\|im_start\|>assistant\s*"), re.compile(r"<\|im_end\|>\s*\Z"), re.compile(r"\A(?i:assistant)\s*[:：]?\s*"), re.compile(r"</s>\s*\Z"))


def plain_answer(text: str) -> str:
    """An answer without its markers; the plain form of ``functions.text.clean_response``."""
    text = text.strip()
    for marker in _AROUND:
        text = marker.sub("", text)
    return text.strip()
