"""Time phrases in free text (English and Japanese) to ranges of days and hours.

A text is first split into atoms: numbers, words, single Japanese characters or known Japanese words, signs. A rule is a shape, a sequence
of tests on atoms written as a line of short codes, and a function from what the shape caught to a span of local days, or to
nothing, in which case the next rule is tried. The same shapes blank out time phrases before keywords are taken, so what was
read as time is never searched as a word. Parsing happens once, in the driver; what comes out is a `QueryPlan` that operators turn
into filters.
"""

from __future__ import annotations

import calendar
import re
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from datetime import UTC, date, datetime, time, timedelta
from zoneinfo import ZoneInfo

from kairolog.functions import vocabulary as v

Span = tuple[date, date]


@dataclass(frozen=True)
class QueryPlan:
    """What a query asks for. ``days`` are local and inclusive; ``hours`` local, end exclusive; each keyword is a group of spellings."""

    text: str
    tz: str
    today: date
    days: Span | None = None
    hours: tuple[int, int] | None = None
    keywords: tuple[tuple[str, ...], ...] = field(default=())
    widened: bool = False

    @property
    def utc(self) -> tuple[datetime, datetime] | None:
        """Half-open range of instants, without zone, in UTC."""
        if self.days is None:
            return None
        return day_start(self.days[0], self.tz), day_start(self.days[1] + timedelta(days=1), self.tz)


@dataclass(frozen=True)
class Vocabulary:
    """Words that carry nothing in a query, and names that always do."""

    fillers: tuple[str, ...] = tuple(v.FILLERS)
    tails: tuple[str, ...] = tuple(v.TAIL_FILLERS)
    stopwords: tuple[str, ...] = tuple(v.STOPWORDS)
    protected: tuple[str, ...] = ()


def day_start(day: date, tz: str) -> datetime:
    return datetime.combine(day, time(), ZoneInfo(tz)).astimezone(UTC).replace(tzinfo=None)


def _month(year: int, month: int) -> Span:
    return date(year, month, 1), date(year, month, calendar.monthrange(year, month)[1])


def _months_ago(today: date, n: int) -> Span:
    year, month = divmod(today.year * 12 + today.month - 1 - n, 12)
    return _month(year, month + 1)


def _year(year: int) -> Span:
    return date(year, 1, 1), date(year, 12, 31)


def _day(day: date) -> Span:
    return day, day


def _ago(today: date, n: int, unit: str) -> Span:
    """A day; a week as seven days around one; a calendar month or year."""
    if unit == "day":
        return _day(today - timedelta(days=n))
    if unit == "week":
        middle = today - timedelta(weeks=n)
        return middle - timedelta(days=3), middle + timedelta(days=3)
    return _months_ago(today, n) if unit == "month" else _year(today.year - n)


def _last_week(today: date) -> Span:
    return today - timedelta(days=7), today - timedelta(days=1)


def _month_by_name(today: date, month: int) -> Span:
    """The month of this year, or of last year if it is still to come."""
    return _month(today.year - (month > today.month), month)


# --------------------------------------------------------------- atoms and shapes


@dataclass(frozen=True)
class Atom:
    """A number, word, sign or Japanese character or word, and where it stands."""

    kind: str
    text: str
    start: int
    end: int


_KANA_KANJI = "\u3040-\u30ff\u3400-\u9fff々〇"
_ATOM = re.compile(rf"(?P<num>\d+)|(?P<jp>[{_KANA_KANJI}])|(?P<word>[^\W\d{_KANA_KANJI}]+)|(?P<sign>[^\w\s])")


def lex(text: str) -> list[Atom]:
    """Atoms in order. At each Japanese character the longest known word that begins there is one atom."""
    out, at = [], 0
    while m := _ATOM.search(text, at):
        kind, end = m.lastgroup or "", m.end()
        if kind == "jp":
            end = m.start() + max((len(w) for w in v.JP_RELATIVE if text.startswith(w, m.start())), default=1)
        out.append(Atom(kind, text[m.start() : end].lower(), m.start(), end))
        at = end
    return out


def _test(code: str) -> Callable[[Atom], bool]:
    """What an atom must be. ``9``, ``99``, ``9999``: a number of at most so many digits; ``YYYY``: of just four; ``MONTH``, ``UNIT``, ``COUNT``; else one of these words or signs, parted by ``|``."""
    if set(code) == {"9"}:
        return lambda a: a.kind == "num" and len(a.text) <= len(code)
    if code == "YYYY":
        return lambda a: a.kind == "num" and len(a.text) == 4
    if code == "MONTH":
        return lambda a: a.kind == "word" and _month_number(a.text) > 0
    if code == "UNIT":
        return lambda a: a.kind == "word" and a.text.removesuffix("s") in ("day", "week", "month", "year")
    if code == "COUNT":
        return lambda a: (a.kind == "num" and len(a.text) <= 4) or a.text in ("a", "an", *v.EN_NUMBERS[1:])
    words = frozenset(code.split("|"))
    return lambda a: a.text in words


class Shape:
    """A sequence of tests. A code with ``+`` before it must touch the atom before, any other must be parted from it by space; one with ``?`` may be missing.

    A shape that begins or ends with ``~`` begins or ends at the edge of a word.
    """

    def __init__(self, codes: str):
        parts = codes.split()
        self.left, self.right = parts[0] == "~", parts[-1] == "~"
        self.steps = [("+" in c[:2], "?" in c[:2], _test(c.lstrip("+?"))) for c in parts if c != "~"]

    def _from(self, atoms: list[Atom], i: int, step: int, last: Atom | None, text: str) -> list[Atom] | None:
        if step == len(self.steps):
            return None if last is None or (self.right and text[last.end : last.end + 1].strip() and re.match(r"\w", text[last.end])) else []
        touch, optional, test = self.steps[step]
        if i < len(atoms) and test(atoms[i]) and (last is None or (atoms[i].start == last.end) == touch):
            rest = self._from(atoms, i + 1, step + 1, atoms[i], text)
            if rest is not None:
                return [atoms[i], *rest]
        return self._from(atoms, i, step + 1, last, text) if optional else None

    def all(self, text: str) -> list[list[Atom]]:
        """Places where the shape fits, from left to right, that do not overlap."""
        atoms, out, free = lex(text), [], 0
        for i, a in enumerate(atoms):
            if a.start < free or (self.left and a.start and re.match(r"\w", text[a.start - 1])):
                continue
            found = self._from(atoms, i, 0, None, text)
            if found:
                out.append(found)
                free = found[-1].end
        return out


def blank(text: str, spans: Sequence[tuple[int, int]], put: str = " ") -> str:
    for a, b in sorted(spans, reverse=True):
        text = text[:a] + put + text[b:]
    return text


def _month_number(name: str) -> int:
    """1 to 12 of a month's name, whole or shortened to three letters (or ``sept``), else 0."""
    return next((i for i, m in enumerate(v.EN_MONTHS, 1) if name in (m, m[:3], "sept" * (i == 9))), 0)


def _count(word: str) -> int:
    return int(word) if word.isdigit() else 1 if word in ("a", "an") else v.EN_NUMBERS.index(word)


@dataclass(frozen=True)
class Rule:
    """A shape, what its atoms mean on a given day, and whether the text before and after allows it."""

    shape: Shape
    make: Callable[[list[Atom], date], Span | None]
    fits: Callable[[str, int, int], bool] = lambda text, a, b: True

    def spans(self, text: str) -> list[tuple[int, int, list[Atom]]]:
        found = [(m[0].start, m[-1].end, m) for m in self.shape.all(text)]
        return [f for f in found if self.fits(text, f[0], f[1])]


def _numbers(m: list[Atom]) -> list[int]:
    return [int(a.text) for a in m if a.kind == "num"]


def _dated(m: list[Atom], today: date) -> Span:
    """Year, month, day, or month and day of this year."""
    year, month, day = ([today.year] + _numbers(m))[-3:]
    return _day(date(year, month, day))


def _named_day(m: list[Atom], today: date) -> Span:
    month = next(_month_number(a.text) for a in m if _month_number(a.text))
    return _day(date(today.year, month, _numbers(m)[0]))


def _whole_month(text: str, a: int, b: int) -> bool:
    """No day of the month follows."""
    return not text[b:].lstrip("0123456789 \t\u3000").startswith("日")


def _relative(unit: str, n: int) -> Callable[[list[Atom], date], Span]:
    if (unit, n) == ("week", 1):
        return lambda _, today: _last_week(today)
    return lambda _, today: _ago(today, n, unit)


def _jp_ago(unit: str) -> Callable[[list[Atom], date], Span]:
    return lambda m, today: _ago(today, int(m[0].text), unit)


def _date_rules() -> list[Rule]:
    """In order of precedence: the first rule that yields a span wins."""
    yearless = lambda text, a, b: text[a - 1 : a] != "年" and _whole_month(text, a, b)
    rules = [
        Rule(Shape("YYYY +-|/ +99 +-|/ +99"), _dated),
        Rule(Shape("YYYY +年 +99 +月 +99 +日"), _dated),
        Rule(Shape("99 +月 +99 +日"), _dated),
        Rule(Shape("YYYY +年 +99 +月"), lambda m, t: _month(*_numbers(m)), _whole_month),
        Rule(Shape("99 +月"), lambda m, t: _month_by_name(t, _numbers(m)[0]), yearless),
        Rule(Shape("9999 +日 +前"), _jp_ago("day")),
        Rule(Shape("9999 +週 +間 +前"), _jp_ago("week")),
        Rule(Shape("99 +年 +前"), _jp_ago("year")),
        Rule(Shape("99 +ヶ|か|カ +月 +前"), _jp_ago("month")),
    ]
    rules += [Rule(Shape(word), _relative(unit, n)) for word, (unit, n) in v.JP_RELATIVE.items()]
    dot, suffix = "?+.", "?+st|nd|rd|th"
    rules += [
        Rule(Shape(f"~ MONTH {dot} 99 {suffix} ~"), _named_day),
        Rule(Shape(f"~ 99 {suffix} ?of MONTH {dot}"), _named_day),
        Rule(Shape(f"~ in|during MONTH {dot}"), lambda m, t: _month_by_name(t, _month_number(m[1].text))),
        Rule(Shape("~ COUNT UNIT ago ~"), lambda m, t: _ago(t, _count(m[0].text), m[1].text.removesuffix("s"))),
    ]
    rules += [Rule(Shape(f"~ {codes} ~"), _relative(unit, n)) for codes, unit, n in v.EN_RELATIVE]
    clock = lambda text, a, b: text[a - 1 : a] != ":"
    return [*rules, Rule(Shape("99 +/ +99"), _dated, clock)]


DATE_RULES: list[Rule] = _date_rules()

_EN_FALSE = [Shape(f"~ {phrase} ~") for phrase in v.EN_NO_DAYPARTS]
_EN_CLOCK = [Shape(f"~ ?around|about|at 99 {minute} {half}") for minute in ("+: +99", "") for half in ("+am|pm ?+.", "am|pm ?+.", "+a|p +. +m ?+.", "a|p +. +m ?+.")]
_JP_CLOCK = Shape("99 +時 ?+頃|台|ご")
_EN_PARTS = [(Shape(f"~ {words} ~"), (a, b)) for words, a, b in sorted(v.EN_DAYPARTS, key=lambda p: -len(p[0]))]
_JP_PARTS = sorted(v.JP_DAYPARTS, key=lambda p: -len(p[0]))


def read_days(text: str, today: date) -> Span | None:
    """The span of days that a text names, or nothing. Impossible dates fall through to later rules."""
    for rule in DATE_RULES:
        found = rule.spans(text)
        if not found:
            continue
        try:
            span = rule.make(found[0][2], today)
        except (ValueError, OverflowError):
            continue
        if span:
            return span
    return None


def _around(hour: int, loose: bool) -> tuple[int, int]:
    return (max(0, hour - 1), min(24, hour + 2)) if loose else (hour, min(24, hour + 1))


def _jp_false(text: str) -> list[tuple[int, int]]:
    """Compounds that only look like a part of the day."""
    out: list[tuple[int, int]] = []
    at = 0
    while at < len(text):
        word = next((w for w in v.JP_NO_DAYPARTS if text.startswith(w, at)), "")
        if word:
            out.append((at, at + len(word)))
        at += len(word) or 1
    return out


def _jp_clocks(text: str) -> list[list[Atom]]:
    """Hours on the clock, but no lengths of time."""
    return [m for m in _JP_CLOCK.all(text) if not text.startswith("間", m[1].end)]


def _en_clocks(text: str) -> list[list[Atom]]:
    found = [m for shape in _EN_CLOCK for m in shape.all(text) if not text[m[-1].end : m[-1].end + 1].isalpha()]
    first: list[list[Atom]] = []
    for m in sorted(found, key=lambda m: (m[0].start, -m[-1].end)):
        if not first or m[0].start >= first[-1][-1].end:
            first.append(m)
    return first


def read_hours(text: str) -> tuple[int, int] | None:
    """Hours of the day that a text names. A clock beats a part of the day, a longer word a shorter one."""
    s = blank(text, _jp_false(text))
    clocks = _jp_clocks(s)
    if clocks:
        about = lambda m: len(m) > 2 and m[2].text == "頃"
        m = next((c for c in clocks if about(c)), clocks[0])
        return _around(int(m[0].text) % 24, about(m))
    for word, a, b in _JP_PARTS:
        if word in s:
            return a, b
    for shape in _EN_FALSE:
        s = blank(s, [(m[0].start, m[-1].end) for m in shape.all(s)])
    for m in _en_clocks(s)[:1]:
        hour, half = _numbers(m)[0], next(a.text[0] for a in m if a.text in ("am", "pm", "a", "p"))
        if 1 <= hour <= 12:
            return _around(hour % 12 + 12 * (half == "p"), m[0].text in ("around", "about"))
    return next((hours for shape, hours in _EN_PARTS if shape.all(s)), None)


def mask_time(text: str, hours_read: bool) -> str:
    """``text`` without its time phrases. Compounds that only look like one are kept, under characters of private use meanwhile."""
    for rule in DATE_RULES:
        text = blank(text, [(a, b) for a, b, _ in rule.spans(text)])
    if not hours_read:
        return text
    kept = [text[a:b] for a, b in _jp_false(text)]
    for i, (a, b) in reversed(list(enumerate(_jp_false(text)))):
        text = text[:a] + chr(0xE000 + i) + text[b:]
    ro = lambda m: m[-1].end + (m[-1].text == "ご" and text.startswith("ろ", m[-1].end))
    text = blank(text, [(m[0].start, ro(m)) for m in _jp_clocks(text)])
    text = blank(text, [(m[0].start, m[-1].end) for m in _en_clocks(text)])
    for word, *_ in _JP_PARTS:
        text = text.replace(word, " ")
    for shape, _ in _EN_PARTS:
        text = blank(text, [(m[0].start, m[-1].end) for m in shape.all(text)])
    return "".join(kept[ord(c) - 0xE000] if 0xE000 <= ord(c) < 0xE000 + len(kept) else c for c in text)


def names_occurrence(text: str, modifiers: Sequence[str] = tuple(v.TEMPORAL_MODIFIERS)) -> bool:
    """Whether a text asks which time something happened, so that no range may narrow the search."""
    low = text.lower()
    return any(m.lower() in low for m in modifiers)


def parse(text: str, today: date, tz: str = "UTC", corrections: dict[str, str] | None = None, modifiers: Sequence[str] = tuple(v.TEMPORAL_MODIFIERS), words_of: Vocabulary | None = None) -> QueryPlan:
    """The one place where a query is read. Words that a user has named protected are no filler, and stay whole."""
    from kairolog.functions.textprep import expand, keywords, strip_query

    own = words_of or Vocabulary()

    text = text or ""
    days, hours = read_days(text, today), read_hours(text)
    rest = mask_time(text, hours is not None)
    hidden = rest
    for i, name in enumerate(own.protected):
        hidden = hidden.replace(name, chr(0xF000 + i))
    left = strip_query(hidden, own.fillers, own.tails, own.stopwords) if rest.strip() else ""
    left = "".join(own.protected[ord(c) - 0xF000] if 0xF000 <= ord(c) < 0xF000 + len(own.protected) else c for c in left)
    words = keywords(left, own.stopwords, own.protected)
    widened = days is not None and names_occurrence(text, modifiers)
    return QueryPlan(text, tz, today, None if names_occurrence(text, modifiers) else days, hours, tuple(expand(w, corrections or {}) for w in words), widened)
