"""Text expressions that stay in the JVM: cleaning, tokens, sentences, word-boundary patterns, slugs, lexicon scores.

Java's character classes are ASCII unless ``(?U)`` is set, so every pattern here sets it where classes or case matter.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = "[a-zA-ZÀ-ÖØ-öø-ÿ]+"
READING_WORD = r"[0-9]{%d,}|[^\W\d_]{%d,}"
ABBREVIATIONS = "ang bl.a ca d.v.s dvs e.d enl etc ev f.d fr.o.m jfr kl kr m.fl m.m milj mkr nr o.s.v osv p.g.a proc resp s.k st t.ex t.o.m".split()
CLOSERS = "[\"'’»)\\]]*"
#: What counts as white space beside Java's Unicode class.
SPACE = r"[\s\x{1c}-\x{1f}]"


def quoted(text: str) -> str:
    """`text` as a literal of a Java regular expression."""
    return re.sub(r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\\1", text)


def clean_text(text: Column) -> Column:
    """Heal words cut at line ends, collapse white space, strip; a null gives an empty text."""
    healed = F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "-\n", "")
    return F.trim(F.regexp_replace(healed, f"(?U){SPACE}+", " "))


def strip(text: Column) -> Column:
    """`text` without white space at its ends."""
    return F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+$", "")


def tokens(text: Column, min_length: int = 3, stopwords: Iterable[str] = ()) -> Column:
    """Lower-case letter runs of at least `min_length` letters that are no stop words; a null gives a null."""
    found = F.regexp_extract_all(F.lower(text), F.lit(f"({TOKEN})"), F.lit(1))
    stop = sorted({s.lower() for s in stopwords})
    if min_length <= 1 and not stop:
        return found

    def keep(x: Column) -> Column:
        long = F.length(x) >= min_length
        return long & ~x.isin(stop) if stop else long

    return F.filter(found, keep)


def sentence_regex(abbreviations: Sequence[str] = ABBREVIATIONS) -> str:
    """What lies between two sentences: white space behind a stop that doesn't end an abbreviation."""
    behind = "|".join(quoted(a) for a in sorted(abbreviations, key=lambda a: (-len(a), a)))
    guard = rf"(?<!\b(?:{behind})\.)" if behind else ""
    return rf"(?iU)(?<=[.!?]){guard}{CLOSERS}{SPACE}+"


def sentences(text: Column, abbreviations: Sequence[str] = ABBREVIATIONS) -> Column:
    """Sentences in order, stripped, without empty ones; none for a null."""
    parts = F.split(F.coalesce(text, F.lit("")), sentence_regex(abbreviations), -1)
    return F.filter(F.transform(parts, strip), lambda s: s != "")


@dataclass(frozen=True)
class Patterns:
    """A checked table of literal patterns; `excludes` maps a pattern to words that may not come right behind it."""

    words: tuple[str, ...]
    excludes: Mapping[str, tuple[str, ...]] = field(default_factory=dict)
    subtypes: Mapping[str, str] = field(default_factory=dict)
    slots: Mapping[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        low = [w.strip().lower() for w in self.words]
        if not low:
            raise ValueError("a pattern table without patterns scores zero forever")
        if any(not w for w in low):
            raise ValueError("a pattern is blank")
        if len(set(low)) < len(low):
            raise ValueError(f"patterns occur twice and would be counted twice: {sorted({w for w in low if low.count(w) > 1})}")
        if any(set(".!?") & set(w) for w in low):
            raise ValueError("a pattern may not contain a sentence stop")
        object.__setattr__(self, "words", tuple(low))

    def subset(self, slot: str | None = None, subtype: str | None = None) -> Patterns:
        chosen = tuple(w for w in self.words if (slot is None or self.slots.get(w) == slot) and (subtype is None or self.subtypes.get(w) == subtype))
        return Patterns(chosen, {w: e for w, e in self.excludes.items() if w in chosen}, self.subtypes, self.slots)

    def without_excludes(self) -> Patterns:
        return Patterns(self.words, {}, self.subtypes, self.slots)

    @property
    def ordered(self) -> list[str]:
        """Longest first, as an alternation takes the first that fits."""
        return sorted(self.words, key=lambda w: (-len(w), w))

    @property
    def overlapping(self) -> bool:
        """Whether an excluded match could hide another pattern, which the JVM expression can't tell."""
        return any(o != w and re.search(rf"(?<!\w){re.escape(o)}(?!\w)", w) for w in self.excludes for o in self.words)

    def regex(self) -> str:
        """One alternation for the whole table; an exclusion is a look-ahead of its own pattern."""

        def one(w: str) -> str:
            after = self.excludes.get(w, ())
            guard = f"(?!\\s+(?:{'|'.join(quoted(e.lower()) for e in after)})(?!\\w))" if after else ""
            return quoted(w) + "(?!\\w)" + guard

        return rf"(?iU)(?<!\w)(?:{'|'.join(one(w) for w in self.ordered)})"

    def python_regex(self) -> re.Pattern[str]:
        return re.compile(rf"(?<!\w)(?:{'|'.join(re.escape(w) for w in self.ordered)})(?!\w)", re.IGNORECASE)

    def python_excludes(self) -> dict[str, re.Pattern[str]]:
        return {w: re.compile(rf"\s+(?:{'|'.join(re.escape(e.lower()) for e in after)})(?!\w)", re.IGNORECASE) for w, after in self.excludes.items() if after}


def matches(text: Column, patterns: Patterns) -> Column:
    """Matched patterns in lower case, in text order: leftmost, longest first, without overlap."""
    return F.transform(F.regexp_extract_all(text, F.lit(f"({patterns.regex()})"), F.lit(1)), F.lower)


def sentences_hit(found: Column, patterns: Patterns) -> Column:
    """How many of the sentences have a match."""
    rx = patterns.regex()
    return F.size(F.filter(found, lambda s: s.rlike(rx)))


def within_others(words: Sequence[str]) -> set[str]:
    """The words that stand as whole words within another one, which an alternation would hide."""
    return {w for w in words if any(o != w and re.search(rf"(?<!\w){re.escape(w)}(?!\w)", o) for o in words)}


def reading_word_regex(least: int = 1) -> str:
    """Numbers and letter runs of at least `least` signs; a run is taken whole, so shorter ones can't be part of longer ones."""
    return f"(?U)(?:{READING_WORD % (least, least)})"


def reading_words(text: Column) -> Column:
    """Numbers and letter runs of any script."""
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({reading_word_regex()})"), F.lit(1))


def slug(name: Column) -> Column:
    """Lower-case ASCII letters and digits with hyphens between: folds the accents of European names."""
    low = F.lower(strip(name))
    folded = F.translate(low, "åäöéèüøàáâãçêëìíîïñòóôõùúûýÿ", "aaoeeuoaaaaceeiiiinoooouuuyy")
    dashed = F.regexp_replace(F.regexp_replace(folded, "[^\\x00-\\x7f]", ""), "[^a-z0-9]+", "-")
    return F.regexp_replace(dashed, "^-+|-+$", "")


def canonical_party(raw: Column, parties: Sequence[str], renames: Mapping[str, str]) -> Column:
    """Upper case, renamed; null if it is none of `parties`."""
    up = F.upper(raw)
    for old, new in renames.items():
        up = F.when(up == old, new).otherwise(up)
    return F.when(up.isin(list(parties)), up)


def lexicon_score(text: Column, singles: Mapping[str, float], phrases: Mapping[str, float]) -> Column:
    """Weighted words and phrases for each 100 blank-separated tokens.  Phrases match as plain substrings."""
    low = F.lower(F.coalesce(text, F.lit("")))
    words = F.filter(F.split(low, f"(?U){SPACE}+"), lambda x: x != "")
    score = F.lit(0.0)
    if singles:
        weights = F.create_map(*[F.lit(x) for pair in singles.items() for x in (pair[0], float(pair[1]))])
        known = F.filter(words, lambda x: x.isin(list(singles)))
        score = F.aggregate(known, F.lit(0.0), lambda acc, x: acc + F.element_at(weights, x))
    for phrase, weight in phrases.items():
        score = score + F.regexp_count(low, F.lit(quoted(phrase))) * F.lit(float(weight))
    return score / F.greatest(F.size(words), F.lit(1)) * 100.0
