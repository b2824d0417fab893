"""Small tables that parameterise the operators: lexicons, pattern tables, pairs, stop words.  Checked loudly when loaded."""

from __future__ import annotations

import csv
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

from loomquill.functions.text import Patterns


def _rows(path: str | Path, required: tuple[str, ...]) -> list[dict[str, str]]:
    p = Path(path)
    if not p.exists():
        raise FileNotFoundError(f"no such table: {p}")
    with p.open(encoding="utf-8", newline="") as f:
        reader = csv.DictReader(f)
        rows = list(reader)
        if missing := [c for c in required if c not in (reader.fieldnames or [])]:
            raise ValueError(f"{p.name} lacks the columns {missing}")
    if not rows:
        raise ValueError(f"{p.name} is empty; a dimension without patterns scores zero forever")
    return rows


@lru_cache(maxsize=32)
def pattern_table(path: str | Path, key: str = "pattern", required: tuple[str, ...] = ()) -> Patterns:
    """Patterns with optional columns slot, subtype and exclude_next (words between bars)."""
    rows = _rows(path, (key, *required))
    words = [(r[key] or "").strip().lower() for r in rows]
    excludes = {w: tuple(x.strip().lower() for x in (r.get("exclude_next") or "").split("|") if x.strip()) for w, r in zip(words, rows)}
    column = lambda c: {w: r[c] for w, r in zip(words, rows) if r.get(c)}
    return Patterns(tuple(words), {w: e for w, e in excludes.items() if e}, column("subtype"), column("slot"))


@lru_cache(maxsize=32)
def pair_table(path: str | Path) -> tuple[tuple[str, str | None, str], ...]:
    """(gendered, neutral or None, measure); gendered words may occur once."""
    rows = _rows(path, ("gendered", "neutral", "measure"))
    Patterns(tuple(r["gendered"] or "" for r in rows))
    return tuple((r["gendered"].strip().lower(), (r["neutral"] or "").strip().lower() or None, r["measure"]) for r in rows)


@dataclass(frozen=True)
class Lexicon:
    categories: tuple[str, ...]
    singles: dict[str, dict[str, float]]
    phrases: dict[str, dict[str, float]]


def lexicon(path: str | Path) -> Lexicon:
    """Three columns in order: word, category, weight.  A weight that is no number is 0; of repeated words the last counts."""
    with Path(path).open(encoding="utf-8", newline="") as f:
        rows = list(csv.reader(f))[1:]
    categories = tuple(dict.fromkeys(r[1] for r in rows))
    out = Lexicon(categories, {c: {} for c in categories}, {c: {} for c in categories})
    for word, category, weight, *_ in rows:
        try:
            value = float(weight)
        except ValueError:
            value = 0.0
        w = word.strip().lower()
        kind = out.phrases if " " in w else out.singles
        kind[category][w] = value
    return out


def stopwords(path: str | Path) -> frozenset[str]:
    """Lower-case words of a file; blank lines and comments don't count."""
    with Path(path).open(encoding="utf-8") as f:
        return frozenset(line.strip().lower() for line in f if line.strip() and not line.lstrip().startswith("#"))
