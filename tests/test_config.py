import math

import pytest

from gristmill import config as C


def test_defaults_and_identity():
    plain = C.screening_config({})
    assert plain == {n: s.default for n, s in C.SCREENING.items()}
    resources = {n: s.high for n, s in C.SCREENING.items() if not s.results}
    assert set(resources) == {"concurrency", "max_requests", "timeout", "attempts"}
    assert C.config_hash(C.screening_config(resources | {"not_a_setting": 0})) == C.config_hash(plain)
    for name, value in (("confidence", 0.5), ("rubric", "code"), ("min_chars", 9), ("max_chars", 9)):
        assert C.config_hash(C.screening_config({name: value})) != C.config_hash(plain)
    assert C.screening_config({"provider": "scorer", "max_requests": None})["model"] == "default"


@pytest.mark.parametrize("table, check", [(C.SCREENING, C.screening_config), (C.TRAINING, C.training_config)])
def test_every_setting_is_held_to_its_range(table, check):
    for name, s in table.items():
        bad = [None, [], "", "no such choice"] if s.choices else [None, True, "1", s.low - 1, s.high + 1, math.nan, math.inf]
        bad += [s.low + 0.5] if not s.choices and s.kind is int else []
        for value in bad:
            with pytest.raises(ValueError, match=f"{name}: expected"):
                check({name: value})
        for value in s.choices or (s.low, s.high):
            pair = {"max_chars": s.high} if name == "min_chars" else {"min_chars": 1} if name == "max_chars" else {}
            assert check(pair | {name: value})[name] == value


@pytest.mark.parametrize("bad", [7, {"min_chars": 5, "max_chars": 4}, {"provider": "scorer", "model": "\t"}, {"provider": "scorer", "model": "m" * 201}])
def test_settings_that_contradict(bad):
    with pytest.raises(ValueError):
        C.screening_config(bad)


def test_all_faults_are_told_at_once():
    with pytest.raises(ValueError, match="epochs: .*seed: "):
        C.training_config({"epochs": 0, "seed": -5})
    assert C.training_config({"validation_fraction": 0.4, "test_fraction": 0.4})["test_fraction"] == 0.4  # together at most four fifths


def test_thresholds():
    t = C.thresholds(C.RUBRICS["general"], 0.7)
    assert t["privacy"] == {"use_confidence": True, "min_probability": 0.9, "max_reject_probability": 0.1, "min_confidence": 0.7}
    assert t["quality"]["min_confidence"] is None and C.RUBRICS["code"]["dedupe"] == "exact"
