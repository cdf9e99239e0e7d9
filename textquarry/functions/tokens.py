"""The token estimate on the driver and in Python kernels, and the exact counter where a vocabulary is at hand."""

from __future__ import annotations

import base64
import json
import math
import os
import re
from collections import Counter
from functools import lru_cache
from pathlib import Path

from . import fixed

_SPLIT = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[^\W\d_]+| ?\d+| ?[^\s\w]+|_+|\s+")
_SHORT = {"'s", "'d", "'m", "'t", "'ll", "'ve", "'re"}


@lru_cache(maxsize=1 << 16)
def piece_class(piece: str) -> str:
    last = piece[-1:]
    if not piece.isascii():
        return "nonascii"
    if piece in _SHORT or not piece:
        return "mixed"
    return "underscore" if last == "_" else "letters" if last.isalpha() else "digits" if last.isdigit() else "ws" if last.isspace() else "punct"


def histogram(text: str) -> Counter:
    """How often each (class, length) occurs."""
    return Counter((piece_class(p), len(p)) for p in _SPLIT.findall(text))


def cost(pieces: Counter, costs=fixed.TOKEN_COSTS) -> float:
    return sum(n * (1.0 if size <= costs[c][1] else (size - costs[c][1]) / costs[c][0]) for (c, size), n in pieces.items())


def _price(piece_cls: str, size: int, costs) -> float:
    ratio, free = costs[piece_cls]
    return 1.0 if size <= free else (size - free) / ratio


def line_costs(text: str, ends: list[int], costs=fixed.TOKEN_COSTS) -> list[tuple[float, int]]:
    """For every offset in ``ends`` (rising, each behind a line end): the cost of the pieces that end before the white space
    there, and where that white space begins. A piece that an offset cuts is white space."""
    out, total, k = [], 0.0, 0
    for m in _SPLIT.finditer(text):
        start, stop = m.span()
        while k < len(ends) and ends[k] <= stop:
            if ends[k] > start:
                out.append((total, start))
            k += 1
        total += _price(piece_class(m[0]), stop - start, costs)
    return out


def estimate(text: str, calibration: float = 1.0, costs=fixed.TOKEN_COSTS) -> int:
    """0 for an empty text, otherwise 1 at least."""
    return max(1, math.ceil(round(cost(histogram(text), costs) * calibration, 9))) if text else 0


@lru_cache(maxsize=4)
def encoding(path: str):
    """An exact byte-level tokenizer from a vocabulary file of (base64 token, rank) lines."""
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}
    return tiktoken.Encoding("own", pat_str=r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})


class TokenCounter:
    """Counts tokens of one text: ``auto`` is exact where a vocabulary is given and readable, ``never`` always estimates."""

    def __init__(self, mode: str = "auto", vocabulary: str | None = None, calibration: float = 1.0):
        if mode not in ("auto", "exact", "never"):
            raise ValueError(f"unknown mode {mode!r}; choose auto, exact or never")
        self.vocabulary = vocabulary if mode != "never" and vocabulary and os.path.exists(vocabulary) else None
        if mode == "exact" and not self.vocabulary:
            raise ValueError("exact counts need a vocabulary file")
        self.method, self.calibration = ("exact" if self.vocabulary else "heuristic"), calibration

    def __call__(self, text: str) -> int:
        return len(encoding(self.vocabulary).encode_ordinary(text)) if self.vocabulary else estimate(text, self.calibration)


def calibration_path() -> Path:
    if named := os.environ.get("TEXTQUARRY_CALIBRATION"):
        return Path(named)
    return Path(os.environ.get("XDG_CONFIG_HOME") or Path.home() / ".config") / "textquarry" / "calibration.json"


def load_calibration() -> float:
    """The stored factor; 1 if there is none that is a positive finite number."""
    try:
        factor = float(json.loads(calibration_path().read_text())["factor"])
    except (OSError, ValueError, KeyError, TypeError):
        return 1.0
    return factor if math.isfinite(factor) and factor > 0 else 1.0


def save_calibration(factor: float, samples: int, error: float) -> Path:
    path = calibration_path()
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(json.dumps({"factor": round(factor, 6), "samples": samples, "mean_abs_pct_error": round(error, 6)}, indent=2) + "\n")
    return path


def fit(samples: list[tuple[Counter, int]], rounds: int = 6, costs=fixed.TOKEN_COSTS) -> tuple[dict, float]:
    """Coordinate descent on the mean relative error over (histogram, true count) samples."""

    def error(model) -> float:
        used = [(h, t) for h, t in samples if t]
        return sum(abs(cost(h, model) - t) / t for h, t in used) / max(1, len(used))

    best, least = dict(costs), error(costs)
    for step in (0.2 * 0.5**k for k in range(rounds)):
        moved = True
        while moved:
            moved = False
            for name in best:
                for part in (0, 1):
                    for sign in (1, -1):
                        pair = list(best[name])
                        pair[part] = max(0.2 if part == 0 else 0.0, pair[part] * (1 + sign * step) + (sign * step if part else 0))
                        trial = best | {name: tuple(pair)}
                        if (e := error(trial)) < least - 1e-9:
                            best, least, moved = trial, e, True
    return best, least
