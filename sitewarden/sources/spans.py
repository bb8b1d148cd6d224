"""Words and numbers of many slices of one text, counted without copying the slices.

Elements nest, so the texts of all list items of a page can be as long as the
square of the page. Counts over slices come from sorted places of word starts
and matches; only what lies between a slice's ends and the next place where
nothing can be cut in two is looked at.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterable

from ..functions.text import SPACE, SPACES, collapse_py

_START = re.compile(f"(?<![^{SPACE}])[^{SPACE}]")
#: What counts as a data point, in text whose white space is collapsed, and as it is.
QUOTABLE = re.compile(r"[$€£¥]\s?\d[\d,.]*|\d[\d,.]*\s?%|\b\d[\d,.]*\b", re.ASCII)
_AS_IT_IS = re.compile(rf"[$€£¥][{SPACE}]*[0-9][0-9,.]*|[0-9][0-9,.]*[{SPACE}]*%|(?a:\b)[0-9][0-9,.]*(?a:\b)")
#: Places where a text may be cut: no data point spans them, nor do they change one. The second is for the text read backwards.
_IDLE, _ANY = rf"[^0-9,.$€£¥%{SPACE}]", "[^0-9,.$€£¥%]"
_CUT = re.compile(f"(?<={_IDLE})(?={_ANY})|(?<=[{SPACE}])(?={_IDLE})|(?<=[0-9][{SPACE}])(?=[0-9])")
_CUT_BACK = re.compile(f"(?={_IDLE})(?<={_ANY})|(?=[{SPACE}])(?<={_IDLE})|(?=[{SPACE}][0-9])(?<=[0-9])")


class Spans:
    """Counts over slices ``(begin, end)`` of a text; places are found when first asked for."""

    def __init__(self, text: str):
        self.text, self._words, self._points, self._back = text, None, None, None

    def _starts(self) -> list[int]:
        if self._words is None:
            self._words = [m.start() for m in _START.finditer(self.text)]
        return self._words

    def words(self, begin: int, end: int) -> int:
        """Words of one slice; one that is cut counts."""
        starts = self._starts()
        if begin >= end:
            return 0
        cut = begin > 0 and self.text[begin] not in SPACES and self.text[begin - 1] not in SPACES
        return bisect_left(starts, end) - bisect_left(starts, begin) + cut

    def joined_words(self, slices: Iterable[tuple[int, int]]) -> int:
        """Words of slices put together without anything between them."""
        total, before = 0, " "
        for begin, end in slices:
            if begin < end:
                total += self.words(begin, end) - (before not in SPACES and self.text[begin] not in SPACES)
                before = self.text[end - 1]
        return total

    def _cuts(self, begin: int, end: int) -> tuple[int, int] | None:
        """The first and last places inside a slice where it may be cut."""
        first = _CUT.search(self.text, begin + 1, end)
        if first is None:
            return None
        if self._back is None:
            self._back = self.text[::-1]
        n = len(self.text)
        last = _CUT_BACK.search(self._back, n - end + 1, n - begin)
        return (first.start(), n - last.start()) if last else None

    def joined_points(self, slices: Iterable[tuple[int, int]]) -> int:
        """Data points of slices put together, white space collapsed."""
        if self._points is None:
            self._points = [m.start() for m in _AS_IT_IS.finditer(self.text)]
        total, held = 0, []
        count = lambda: len(QUOTABLE.findall(collapse_py("".join(held))))
        for begin, end in slices:
            if begin >= end:
                continue
            if (cuts := self._cuts(begin, end)) is None:
                held.append(self.text[begin:end])
                continue
            held.append(self.text[begin : cuts[0]])
            total += count() + bisect_left(self._points, cuts[1]) - bisect_left(self._points, cuts[0])
            held = [self.text[cuts[1] : end]]
        return total + count()
