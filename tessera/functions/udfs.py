"""Arrow UDFs for what has no built-in: Unicode folding, running offsets, number words."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

# Number words.
UNITS = {"one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8, "nine": 9}
TEENS = {"ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14, "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19}
TENS = {"twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70, "eighty": 80, "ninety": 90}
NUMBER_WORD = re.compile(rf"\b(?:(?:({'|'.join(UNITS)}) hundred(?: and)?(?:[ -]|\b))?(?:({'|'.join(TENS)})(?:[ -]({'|'.join(UNITS)}))?|({'|'.join([*TEENS, *UNITS])})(?! hundred))?)\b", re.I)
DIGITS = re.compile(r"(?<![\w.])-?\d+(?:\.\d+)?")


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


def folded(text: str | None) -> str | None:
    """Lower case without diacritics."""
    if text is None:
        return None
    return "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()


@pandas_udf(T.StringType())
def fold(texts: pd.Series) -> pd.Series:
    return texts.map(folded, na_action="ignore")


@pandas_udf(T.StringType())
def normal_text(texts: pd.Series) -> pd.Series:
    """NFKC, all dashes as hyphens, one space between words."""
    table = {ord(c): "-" for c in "‐‑‒–—−"}
    return texts.map(lambda t: " ".join(unicodedata.normalize("NFKC", t).translate(table).split()), na_action="ignore")


def numbers(text: str | None) -> list[float]:
    """Numbers that a text prints, in digits and then in words."""
    if text is None:
        return []
    found = [float(m) for m in DIGITS.findall(text.replace(",", "").replace("+/-", " ± "))]
    for m in NUMBER_WORD.finditer(text):
        hundreds, tens, unit, alone = ((g or "").lower() for g in m.groups())
        if hundreds or tens or alone:
            found.append(float(100 * UNITS.get(hundreds, 0) + TENS.get(tens, 0) + UNITS.get(unit, 0) + {**TEENS, **UNITS}.get(alone, 0)))
    return found


@pandas_udf(T.ArrayType(T.DoubleType()))
def numbers_in(texts: pd.Series) -> pd.Series:
    return texts.map(numbers)


@pandas_udf(T.ArrayType(_struct(match=T.StringType(), start=T.IntegerType(), context=T.StringType())))
def in_context(texts: pd.Series, patterns: pd.Series, widths: pd.Series) -> pd.Series:
    """Matches of a pattern with the text around each, on one line."""

    def find(t: str | None, p: str, w: int) -> list[dict]:
        return [{"match": m.group(), "start": m.start(), "context": " ".join(t[max(0, m.start() - w) : m.end() + w].split())} for m in re.finditer(p, t or "")]

    return pd.Series([find(t, p, w) for t, p, w in zip(texts, patterns, widths)])


@pandas_udf(T.StringType())
def sentence_at(texts: pd.Series, offsets: pd.Series) -> pd.Series:
    """The sentence that an offset lies in."""

    def of(t: str | None, at: int) -> str | None:
        if t is None or not 0 <= at < len(t):
            return None
        begin = max((m.end() for m in re.finditer(r"[.!?]\s+", t[:at])), default=0)
        stop = re.search(r"[.!?](?=\s|$)", t[at:])
        return t[begin : at + stop.end() if stop else len(t)].strip()

    return pd.Series([of(t, int(a)) for t, a in zip(texts, offsets)])


@pandas_udf(T.ArrayType(T.StringType()))
def countries(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Country names in their canonical form, first seen first; regions and unknown markers go."""
    # Other spellings of countries, and names that are no country.
    other = {"usa": "United States", "us": "United States", "united states of america": "United States", "uk": "United Kingdom", "great britain": "United Kingdom", "england": "United Kingdom", "korea, republic of": "South Korea", "republic of korea": "South Korea", "iran, islamic republic of": "Iran", "iran (islamic republic of)": "Iran", "russian federation": "Russia", "turkiye": "Turkey", "viet nam": "Vietnam", "czechia": "Czech Republic"}
    regions = {"europe", "asia", "africa", "north america", "south america", "worldwide", "european union"}

    def canonical(names) -> list[str]:
        out: dict[str, None] = {}
        for name in names if names is not None else []:
            key = " ".join((folded(name) or "").split())
            if key and key not in regions:
                out.setdefault(other.get(key, " ".join(name.split())))
        return list(out)

    for batch in batches:
        yield batch.map(canonical)


@pandas_udf(T.ArrayType(_struct(term=T.StringType(), start=T.IntegerType(), end=T.IntegerType())))
def longest_terms(texts: pd.Series, lexicons: pd.Series) -> pd.Series:
    """Terms of a lexicon in a text: at each word the longest that fits, without overlaps."""

    def find(t: str | None, lexicon) -> list[dict]:
        words = [(m.group().lower(), m.start(), m.end()) for m in re.finditer(r"\w+", t or "")]
        known, most = set(lexicon), max((len(x.split()) for x in lexicon), default=0)
        out, i = [], 0
        while i < len(words):
            for k in range(min(most, len(words) - i), 0, -1):
                term = " ".join(w for w, _, _ in words[i : i + k])
                if term in known:
                    out.append({"term": term, "start": words[i][1], "end": words[i + k - 1][2]})
                    i += k - 1
                    break
            i += 1
        return out

    return pd.Series([find(t, x) for t, x in zip(texts, lexicons)])
