"""Settings given as text."""

import math

import pytest

from turnloom.functions.settings import candidate_limit_ms, parsed_settings


def test_candidate_limits():
    assert candidate_limit_ms() == candidate_limit_ms(None, "") == candidate_limit_ms(None, "much") == 3000
    assert candidate_limit_ms(2, "5") == 2000 and candidate_limit_ms(None, " 1.5 ") == 1500
    assert all(candidate_limit_ms(None, x) == math.inf for x in ("inf", "OFF", "none", "disabled")) and candidate_limit_ms(math.inf) == math.inf
    with pytest.raises(ValueError):
        candidate_limit_ms("much")


def test_parsed_settings():
    text = "﻿A=1\n# no\nexport B = 'two # three' # four\nC=\"a=b\"\nD=x#y # z\n\nE=\n F=#none\nnonsense\nA=2"
    assert parsed_settings(text) == {"A": "2", "B": "two # three", "C": "a=b", "D": "x#y", "E": "", "F": ""}
