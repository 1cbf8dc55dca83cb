"""Settings of a job, read on the driver."""

from __future__ import annotations

import math
import os
from collections.abc import Iterable

#: Checkpoints that go by a name.
NAMED = ("best", "last")


def resolved(settings: dict, paths: Iterable[str], lists: Iterable[str] = (), root: str = "SESSION_PATH") -> dict:
    """The settings with relative paths put under the session's root, which has to be absolute as it is. paths: keys of one path; lists: of several, or one."""
    base = str(settings.get(root) or "").strip()
    full = lambda p: os.path.normpath(os.path.join(base, p.replace("\\", "/"))) if isinstance(p, str) and p and base and not os.path.isabs(p) else p
    out = dict(settings)
    for key in paths:
        if key != root and out.get(key):
            out[key] = full(out[key])
    for key in lists:
        if key in out:
            out[key] = [full(p) for p in out[key]] if isinstance(out[key], list) else full(out[key])
    return out


def _items(value, key: str) -> list:
    items = [x.strip() for x in value.split(",")] if isinstance(value, str) else list(value) if isinstance(value, (list, tuple, set)) else [value]
    if not items or items == [""]:
        raise ValueError(f"{key} is empty")
    return items


def checkpoints(value, key: str = "WEIGHT") -> list[str]:
    """best, last or whole numbers from 1, one or several, as names of weights, each once: 3 is epoch3."""
    out: dict[str, None] = {}
    for x in _items(value, key):
        text = str(x).strip().lower()
        if isinstance(value, str) and not text:
            continue  # commas in a row
        number = x if isinstance(x, (int, float)) and not isinstance(x, bool) else int(text) if text.isdigit() else None
        if text not in NAMED and (number is None or not math.isfinite(number) or number != int(number) or number < 1):
            raise ValueError(f"{key}: {x!r} is neither of {NAMED} nor a whole number from 1")
        out[text if text in NAMED else f"epoch{int(number)}"] = None
    return list(out)


def rates(value, key: str = "LR0", most: float | None = None) -> list[float]:
    """Positive numbers, one or several, each once; most: none may be larger."""
    out: dict[float, None] = {}
    for x in _items(value, key):
        if x is None or isinstance(x, bool):
            raise ValueError(f"{key}: {x!r} is no number")
        number = float(x)
        if not math.isfinite(number) or number <= 0 or most is not None and number > most:
            raise ValueError(f"{key}: {x!r} isn't above 0" + (f" and at most {most}" if most is not None else ""))
        out[number] = None
    return list(out)
