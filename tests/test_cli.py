"""Argument handling of the release job entry point (no Spark needed)."""

import pytest

from wavepanel.__main__ import _pairs, parse


def test_pairs_parse_keys_and_paths():
    assert _pairs(["2026-03=s3://a/*.txt", "2026-04=b=c"]) == (("2026-03", "s3://a/*.txt"), ("2026-04", "b=c"))
    assert _pairs(["2022=x.csv"], int) == ((2022, "x.csv"),)


def test_malformed_pair_and_missing_arguments_fail():
    with pytest.raises(SystemExit):
        _pairs(["2026-03"])
    with pytest.raises(SystemExit):
        parse(["release", "--events", "e"])  # no --snapshot / --cpi / --income / --home-values / --out
