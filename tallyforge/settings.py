"""Settings from the environment: a value that cannot be read, or is out of range, is reported and replaced."""

from __future__ import annotations

import os
import warnings
from pathlib import Path

_TRUE, _FALSE = ("1", "true", "yes", "on"), ("0", "false", "no", "off")


def _read(name: str, default, convert):
    raw = os.environ.get(name, "").strip()
    if not raw:
        return default
    try:
        return convert(raw)
    except ValueError:
        warnings.warn(f"{name}={raw!r} is not valid; {default!r} is used", stacklevel=3)
        return default


def _flag(raw: str) -> bool:
    if raw.lower() in _TRUE + _FALSE:
        return raw.lower() in _TRUE
    raise ValueError(raw)


def _clamped(name: str, value, least, most):
    kept = value if least is None else max(least, value)
    kept = kept if most is None else min(most, kept)
    if kept != value:
        warnings.warn(f"{name}={value!r} is out of range; {kept!r} is used", stacklevel=3)
    return kept


def env_bool(name: str, default: bool) -> bool:
    return _read(name, default, _flag)


def env_int(name: str, default: int, least: int | None = None, most: int | None = None) -> int:
    return _clamped(name, _read(name, default, int), least, most)


def env_float(name: str, default: float, least: float | None = None, most: float | None = None) -> float:
    return _clamped(name, _read(name, default, float), least, most)


def env_str(name: str, default: str, choices: tuple[str, ...] = ()) -> str:
    def chosen(raw: str) -> str:
        if choices and raw not in choices:
            raise ValueError(raw)
        return raw

    return _read(name, default, chosen)


def env_path(name: str, default: str) -> Path:
    return Path(_read(name, default, str)).expanduser()
