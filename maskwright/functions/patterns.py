"""All values of a document found in one walk over its text.

The values are one automaton (Aho-Corasick), so that a text costs its length and its hits, whether there are ten values or
ten thousand. Texts and values are folded character by character, as ``(?iu)`` does in Java (upper case,
then lower), which keeps every place; flexible values also stand for any white space between their tokens.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterable, Iterator

import ahocorasick

_SET = "\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
SPACE, RUN, MANY = re.compile(f"[{_SET}]"), re.compile(f"[{_SET}]+"), re.compile(f"[{_SET}]{{2,}}")
ODD = re.compile(r"[^\S ]| \s")  # white space other than single spaces; Python's is that set


def _fold_one(ch: str) -> str:
    upper = ch.upper()
    lower = (upper if len(upper) == 1 else ch).lower()
    return lower if len(lower) == 1 else "i"  # the dotted capital I alone has two


#: characters that ``str.lower`` alone would take elsewhere; the capital sigma's form depends on its neighbours there
_SPECIAL = {i: x for i in range(128, 0x1F000) if not 0xD800 <= i < 0xE000 and (x := _fold_one(chr(i))) != chr(i).lower()} | {0x3A3: "σ"}


def fold(text: str) -> str:
    """In lower case, as many characters as before."""
    return text.lower() if text.isascii() else text.translate(_SPECIAL).lower()


def strip(value: str) -> str:
    """Without white space at both ends (Unicode's, as in ``WS``, which is Python's)."""
    return value.strip()


class Collapsed:
    """A folded text with each run of white space made one space, and the places of the original. A text without such runs
    but at its ends, where no stripped value lies, stays as it is."""

    def __init__(self, text: str):
        self.folded = self.text = fold(text)
        self.after, self.gone = [0], [0]
        if not ODD.search(strip(self.folded)):
            return
        runs = [m.span() for m in MANY.finditer(self.folded)]
        lost = 0
        for start, end in runs:
            self.after.append(start - lost + 1)
            lost += end - start - 1
            self.gone.append(lost)
        self.text = RUN.sub(" ", self.folded)

    def place(self, i: int) -> int:
        return i + self.gone[bisect_right(self.after, i) - 1]


class Automaton:
    """Literal strings, each with numbers; hits of each (string, number) are taken from left to right without overlap."""

    def __init__(self, strings: Iterable[tuple[str, object]]):
        by: dict[str, list] = {}
        for s, x in strings:
            if s:
                by.setdefault(s, []).append(x)
        self.found = None
        if by:
            self.found = ahocorasick.Automaton()
            for s, xs in by.items():
                self.found.add_word(s, (len(s), xs))
            self.found.make_automaton()

    def hits(self, text: str) -> Iterator[tuple[int, int, object]]:
        """(start, end, number), by end; also those that overlap."""
        if self.found is not None:
            for last, (n, xs) in self.found.iter(text):
                for x in xs:
                    yield last + 1 - n, last + 1, x


class Flexible:
    """M2 for all values of a dictionary: any case; each white-space character of a stripped value stands for one or more."""

    def __init__(self, values: list[str]):
        self.gaps: dict[int, re.Pattern] = {}
        strings = []
        for i, value in enumerate(values):
            v = fold(strip(value))
            strings.append((RUN.sub(" ", v), i))
            if MANY.search(v):  # so many characters at least between these tokens
                parts = [f"[{_SET}]{{{len(p)},}}" if RUN.fullmatch(p) else re.escape(p) for p in re.findall(f"[{_SET}]+|[^{_SET}]+", v)]
                self.gaps[i] = re.compile("".join(parts))
        self.automaton = Automaton(strings)

    def hits(self, text: str) -> Iterator[tuple[int, int, int]]:
        """(start, end, value) in the original text; those of one value don't overlap."""
        c, upto = Collapsed(text), {}
        for start, end, i in self.automaton.hits(c.text):
            if start >= upto.get(i, 0):
                a, b = c.place(start), c.place(end - 1) + 1
                if i not in self.gaps or self.gaps[i].match(c.folded, a, b):
                    upto[i] = end
                    yield a, b, i


def leftmost_longest(pooled: Iterable[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """M3 of (start, end, rank): in order of start, longest and rank, those that don't overlap one kept before."""
    kept, upto = [], 0
    found = list(pooled)
    if len(found) > 1:
        found.sort(key=lambda x: (x[0], -x[1], x[2]))
    for x in found:
        if x[0] >= upto:
            kept.append(x)
            upto = x[1]
    return kept


class Occurrences:
    """L1 for all candidates of a document: exact hits, and of candidates of two tokens or more those in any case with any white space between."""

    def __init__(self, needles: list[str]):
        self.exact = Automaton((n, i) for i, n in enumerate(needles))
        several = [(i, strip(n)) for i, n in enumerate(needles)]
        self.flexible = Automaton((RUN.sub(" ", fold(n)), i) for i, n in several if SPACE.search(n))

    def hits(self, text: str) -> dict[int, list[tuple[int, int]]]:
        """Each candidate's spans, in order, none twice."""
        found: dict[int, set] = {}
        for automaton, c in ((self.exact, None), (self.flexible, Collapsed(text))):
            upto: dict[int, int] = {}
            for start, end, i in automaton.hits(text if c is None else c.text):
                if start >= upto.get(i, 0):
                    upto[i] = end
                    found.setdefault(i, set()).add((start, end) if c is None else (c.place(start), c.place(end - 1) + 1))
        return {i: sorted(s) for i, s in found.items()}
