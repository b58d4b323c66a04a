"""Settings as arguments: what a chain's callers may give as text."""

import math
import re

#: The default length of a candidate, in seconds, and the words for no limit.
CANDIDATE_S, NO_LIMIT = 3.0, ("inf", "infinity", "off", "none", "disabled")


def candidate_limit_ms(given: float | str | None = None, setting: str | None = None) -> float:
    """PRJ-26: the longest candidate in milliseconds: what is given, else the setting, else the default; a setting that is no number means the default, a word for no limit infinity."""
    value = given if given is not None else setting
    text = "" if value is None else str(value).strip().lower()
    if not text:
        return CANDIDATE_S * 1000
    if text in NO_LIMIT:
        return math.inf
    try:
        return float(text) * 1000
    except ValueError:
        if given is not None:
            raise
        return CANDIDATE_S * 1000


_LINE = re.compile(r"\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*=\s*(.*?)\s*$")


def parsed_settings(text: str) -> dict[str, str]:
    """SRC-18: NAME=value lines. A value in quotes is what is between them; without quotes it ends before a blank and #. Blank lines, comments and lines without a name are passed over; the last of equal names counts."""
    out = {}
    for line in text.removeprefix("﻿").splitlines():
        m = _LINE.match(line)
        if not m:
            continue
        name, value = m.groups()
        quoted = re.match(r"""(["'])(.*?)\1(?:\s*(?:#.*)?)?$""", value)
        out[name] = quoted[2] if quoted else re.split(r"\s#", " " + value)[0].strip()
    return out
