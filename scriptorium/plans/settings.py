"""Settings: one-level TOML tables under command line and defaults, with their origins."""

from __future__ import annotations

import difflib
import tomllib
from dataclasses import fields
from typing import Any

from .digest import Settings

MODES = frozenset({"config", "dry_run", "doctor", "forget", "recipes", "self_check", "show_state"})


class SettingsError(ValueError):
    pass


def _name(key: str) -> str:
    return key.strip().lower().replace("-", "_")


def flatten(data: dict[str, Any]) -> dict[str, Any]:
    """Top-level keys and those of one level of tables; deeper or repeated ones are refused."""
    out: dict[str, Any] = {}
    for key, value in data.items():
        for k, v in value.items() if isinstance(value, dict) else ((key, value),):
            if isinstance(v, dict):
                raise SettingsError(f"table {key}.{k} is nested too deeply")
            if _name(k) in out:
                raise SettingsError(f"{_name(k)} is set twice")
            out[_name(k)] = v
    return out


def convert(name: str, value: Any, kind: str) -> Any:
    """``value`` as the kind of the setting; a flag is no number and a text no list."""
    base = kind.split("|")[0].strip()
    if base == "list[str]":
        if isinstance(value, list) and all(isinstance(v, str) for v in value):
            return value
    elif base == "int" and isinstance(value, int) and not isinstance(value, bool):
        return value
    elif base == "float" and isinstance(value, int | float) and not isinstance(value, bool):
        return float(value)
    elif base == "str" and isinstance(value, str):
        return value
    raise SettingsError(f"{name} takes {base}, not {type(value).__name__}")


def read_settings(text: str) -> dict[str, Any]:
    try:
        data = flatten(tomllib.loads(text))
    except tomllib.TOMLDecodeError as error:
        raise SettingsError(str(error)) from error
    known = {f.name: str(f.type) for f in fields(Settings)}
    for name in data:
        if name in MODES:
            raise SettingsError(f"{name} chooses what to do, so it belongs on the command line")
        if name not in known:
            near = difflib.get_close_matches(name, known, 1)
            raise SettingsError(f"unknown setting {name}" + (f"; did you mean {near[0]}?" if near else ""))
    return {k: convert(k, v, known[k]) for k, v in data.items()}


def overlay(given: dict[str, Any], stored: dict[str, Any]) -> tuple[Settings, dict[str, str]]:
    """The settings and where each came from: command line over file over default."""
    s = Settings()
    origins = {}
    for f in fields(Settings):
        for origin, source in (("command line", given), ("file", stored)):
            if f.name in source:
                setattr(s, f.name, source[f.name])
                origins[f.name] = origin
                break
        else:
            origins[f.name] = "default"
    return s, origins
