"""Normalisation of single texts in Python, for operators that hold a session in memory."""

from __future__ import annotations

import re

from scansio.functions import text as tx

_marks = re.compile(f"[{tx.DIACRITICS}]")
_letters = str.maketrans(tx.VARIANTS, tx.UNITED, tx.DROPPED)


def normalized(text: str) -> str:
    """As `scansio.functions.text.normalize`."""
    return " ".join(_marks.sub("", text.replace(tx.WORD_START, " ").replace("﻿", "")).translate(_letters).split())
