"""Preparation of query text in the driver, and the same tests as column expressions."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from kairolog.functions import vocabulary as v

MAX_KEYWORDS = 5
#: A keyword: two or more of one script, a kanji with an ending in hiragana, or a word of letters and digits of two or more.
_WORD = "|".join([f"[{v.KATAKANA}]{{2,}}", f"[{v.KANJI}]{{2,}}", f"[{v.KANJI}][{v.HIRAGANA}]", f"[{v.ALNUM}][{v.ALNUM}_\\-]+"])


def _longest_first(words: Sequence[str]) -> list[str]:
    return sorted(words, key=lambda w: (-len(w), w))


def strip_query(text: str, fillers: Sequence[str] = v.FILLERS, tails: Sequence[str] = v.TAIL_FILLERS, stopwords: Sequence[str] = v.STOPWORDS) -> str:
    """The substance of a query. If nothing is left, the query without its spaces."""
    left = reduce(lambda t, w: t.replace(w, " "), [*_longest_first(fillers), *_longest_first(stopwords)], text)
    end = re.compile("(?:" + "|".join(map(re.escape, _longest_first(tails))) + r")[?？!！。、 　]*$")
    while m := end.search(left):
        left = left[: m.start()].rstrip()
    return " ".join(left.split()) or "".join(text.split())


def keywords(text: str, stopwords: Sequence[str] = v.STOPWORDS, protected: Sequence[str] = ()) -> list[str]:
    """Up to five chunks: runs of katakana, of kanji, kanji with an ending, words of letters and digits. Protected names stay whole and come first."""
    names = [n for n in _longest_first([p for p in protected if p]) if n in text]
    for n in names:
        text = text.replace(n, " ")
    stop = {w.lower() for w in (*stopwords, *v.EN_STOPWORDS)}
    found = dict.fromkeys(w for w in re.findall(_WORD, text) if w.lower() not in stop and not (len(w) == 2 and w[0] >= "一" and w[1] in v.PARTICLES))
    return list(dict.fromkeys([*names, *found]))[:MAX_KEYWORDS]


def expand(word: str, corrections: dict[str, str]) -> tuple[str, ...]:
    """Spellings that count as the word: itself and its corrections. A group matches if any of them does."""
    more = [right if wrong == word else word.replace(wrong, right) for wrong, right in corrections.items() if wrong and wrong in word]
    return tuple(dict.fromkeys([word, *more]))


def query_variants(text: str, synonyms: dict[str, Sequence[str]], most: int = 2) -> list[str]:
    """The query with a word replaced by a synonym, at most ``most`` times."""
    out = [text.replace(w, s) for w, others in synonyms.items() if w in text for s in others]
    return list(dict.fromkeys(x for x in out if x != text))[:most]


def any_of(text: Column, words: Sequence[str]) -> Column:
    """Whether a text contains one of the words, as they are written."""
    return reduce(lambda a, b: a | b, (text.contains(w) for w in words), F.lit(False))


def corrected(text: Column, fixes: dict[str, str]) -> Column:
    """A text with wrong spellings replaced by the right ones."""
    return reduce(lambda t, pair: F.replace(t, F.lit(pair[0]), F.lit(pair[1])), fixes.items(), text)


def merged_words(default: Sequence[str], more: object) -> list[str]:
    """A list of words with those of ``include`` added and those of ``exclude`` taken out; anything else in ``more`` changes nothing."""
    rules = more if isinstance(more, dict) else {}
    words = lambda name: [w for w in rules.get(name, []) if isinstance(w, str) and w.strip()] if isinstance(rules.get(name), list) else []
    out = set(words("exclude"))
    return [w for w in dict.fromkeys([*default, *words("include")]) if w not in out]


def is_meta(text: Column) -> Column:
    return reduce(lambda a, b: a | b, [text.startswith(h) for h in v.META_HEADS]) | any_of(text, v.META_MARKS)


def is_negative(text: Column, markers: Sequence[str] = v.NEGATIVE_MARKERS) -> Column:
    return F.coalesce(any_of(text, markers), F.lit(False))


def should_recall(text: Column, triggers: Sequence[str] = v.TRIGGERS) -> Column:
    return any_of(F.lower(text), [t.lower() for t in triggers])


def has_heat(text: Column, words: Sequence[str] = v.HEAT_WORDS) -> Column:
    return F.coalesce(any_of(text, words), F.lit(False))


def all_keywords(text: Column, groups: Sequence[Sequence[str]]) -> Column:
    """Every keyword, in any of its spellings, is in the text, whatever the case."""
    low = F.lower(text)
    return reduce(lambda a, b: a & b, (any_of(low, [w.lower() for w in g]) for g in groups), F.lit(True))


def echo_windows(query: str, whole_below: int = 20, least: int = 10, step: int = 10) -> list[str]:
    """Stretches of a query whose presence in a text shows that the text quotes it."""
    s = "".join(query.split())
    if len(s) < whole_below:
        return [s] if len(s) >= least else []
    return list(dict.fromkeys([*(s[i : i + whole_below] for i in range(0, len(s) - whole_below + 1, step)), s[-whole_below:]]))


def is_echo(text: Column, query: str) -> Column:
    return any_of(F.regexp_replace(text, r"(?U)\s", ""), echo_windows(query))


def column_keywords(text: Column) -> Column:
    """:func:`keywords` of a column, inside the JVM."""
    words = F.array_distinct(F.regexp_extract_all(text, F.lit(f"({_WORD})"), F.lit(1)))
    stop = F.array(*[F.lit(w.lower()) for w in dict.fromkeys([*v.STOPWORDS, *v.EN_STOPWORDS])])
    good = F.filter(words, lambda w: ~F.array_contains(stop, F.lower(w)) & ~((F.length(w) == 2) & w.rlike(f"^[一-龥々][{v.PARTICLES}]$")))
    return F.slice(good, 1, MAX_KEYWORDS)
