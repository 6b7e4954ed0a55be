"""Configuration of a study: a JSON file, or YAML where its reader is installed."""

from __future__ import annotations

import json

#: Keys that the data section must have. Fixed values.
REQUIRED = ("start_date", "tickers", "fred_series", "raw_dir", "processed_dir")


def checked(config: dict) -> dict:
    """The configuration; KeyError for a missing section or key, ValueError for no tickers."""
    if "data" not in config:
        raise KeyError("the configuration has no data section")
    missing = [k for k in REQUIRED if k not in config["data"]]
    if missing:
        raise KeyError(f"the data section lacks {missing}")
    if not config["data"]["tickers"]:
        raise ValueError("the data section names no tickers")
    return config


def load(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        text = f.read()
    try:
        return checked(json.loads(text))
    except json.JSONDecodeError:
        import yaml

        return checked(yaml.safe_load(text))
