"""Whether two profiles are of the same person, organisation, vessel or aircraft: names, births, countries, numbers.

Plain Python over small word lists, with the comparison of two words cached; it runs in Arrow batches
over candidate pairs only.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def distance(a: str, b: str, most: int) -> int:
    """Edit distance with exchange of neighbours as one, or ``most + 1`` if larger than ``most``."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, last = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row = [i]
        for j, y in enumerate(b, 1):
            d = min(last[j] + 1, row[j - 1] + 1, last[j - 1] + (x != y))
            if before is not None and i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            row.append(d)
        if min(row) > most:
            return most + 1
        before, last = last, row
    return min(last[-1], most + 1)


def _shortened(short: str, long: str) -> bool:
    """``short`` is ``long`` with letters left out, the first kept; or its end or middle of four letters and more."""
    if short[0] == long[0]:
        rest = iter(long)
        return all(c in rest for c in short)
    return len(short) >= 4 and short in long


@lru_cache(maxsize=50_000)
def _letters(word: str) -> tuple[int, bool]:
    """Letters as bits, with some letters in one bit; and whether there is a digit."""
    bits = 0
    for c in word:
        bits |= 1 << (ord(c) & 63)
    return bits, any(c.isdigit() for c in word)


@lru_cache(maxsize=100_000)
def alike(a: str, b: str) -> float:
    """How surely two words stand for one: 1 equal, about 0.9 misspelled, 0.8 shortened, 0.5 initial, 0 other."""
    if a == b:
        return 1.0
    if a > b:
        a, b = b, a
    if len(a) == 1 or len(b) == 1:
        return 0.5 if a[0] == b[0] else 0.0
    (in_a, digit_a), (in_b, digit_b) = _letters(a), _letters(b)
    if digit_a or digit_b:
        return 0.0
    longest = max(len(a), len(b))
    most = 0 if longest < 4 else 1 if longest < 7 or a[0] != b[0] else 2 if longest < 12 else 3
    only_a, only_b = (in_a & ~in_b).bit_count(), (in_b & ~in_a).bit_count()
    # each letter that the other word lacks is an edit of its own, and a shortened word has none
    if only_a and only_b and (only_a > most or only_b > most):
        return 0.0
    if most and only_a <= most and only_b <= most:
        d = distance(a, b, most)
        if d <= most:
            return 1 - d / longest
    short, long = (a, b) if len(a) <= len(b) else (b, a)
    if len(short) >= 2 and len(long) - len(short) >= 1 and _shortened(short, long):
        return 0.8
    return 0.0


class Profile(NamedTuple):
    kind: str | None
    names: list[list[str]]
    births: list[tuple[int, int, int | None, int | None]]
    countries: frozenset[str]
    numbers: frozenset[str]


class Judge:
    """Holds what is common to all comparisons: word weights come with the pair, learned variants here."""

    def __init__(self, variants: frozenset[tuple[str, str]], strong: float):
        self.variants = variants
        self.strong = strong

    def word(self, a: str, b: str) -> float:
        s = alike(a, b)
        if s < 0.8 and len(a) > 1 and len(b) > 1 and ((a, b) if a < b else (b, a)) in self.variants:
            return 0.85
        return s

    def name(self, a: list[str], b: list[str], weight: dict[str, float]) -> tuple[int, float]:
        """(level, matched weight): 0 no match, 1 the telling word with initials or alone, 2 with another word, -1 contradiction."""
        pairs = sorted(((-s, i, j) for i, x in enumerate(a) for j, y in enumerate(b) if (s := self.word(x, y)) > 0), key=lambda t: t)
        used_a, used_b, full, strong, total = set(), set(), 0, False, 0.0
        whole_a, whole_b = set(), set()
        for s, i, j in pairs:
            if i in used_a or j in used_b:
                continue
            used_a.add(i)
            used_b.add(j)
            w = min(weight.get(a[i], 0.0), weight.get(b[j], 0.0))
            total += -s * w
            if -s >= 0.7:
                full += 1
                whole_a.add(i)
                whole_b.add(j)
                if w >= self.strong and min(len(a[i]), len(b[j])) >= 4:
                    strong = True
        if not strong or not self._heaviest(a, weight) <= whole_a or not self._heaviest(b, weight) <= whole_b:
            return 0, 0.0
        if len(used_a) < len(a) and len(used_b) < len(b):
            return -1, total
        return (2 if full >= 2 else 1), total

    @staticmethod
    def _heaviest(words: list[str], weight: dict[str, float]) -> set[int]:
        """Place of the rarest word of four letters or more: it must be met in full."""
        long = [i for i, w in enumerate(words) if len(w) >= 4]
        return {max(long, key=lambda i: (weight.get(words[i], 0.0), len(words[i])))} if long else set()

    def _led(self, names: list[list[str]], weight: dict[str, float]) -> list[tuple[str, list[str]]]:
        """Names that can match at all, with their heaviest word: without a telling one there is no match."""
        out = []
        for n in names:
            for i in self._heaviest(n, weight):
                if weight.get(n[i], 0.0) >= self.strong:
                    out.append((n[i], n))
        return out

    def _counterparts(self, some: list[tuple[str, list[str]]], others: list[tuple[str, list[str]]]) -> dict[str, set[str]]:
        """By heaviest word of ``some``: the words of ``others`` that stand for it. Those without any are left out."""
        words = {w for _, n in others for w in n}
        met = {x: {w for w in words if self.word(x, w) >= 0.7} for x in {x for x, _ in some}}
        return {x: found for x, found in met.items() if found}

    def names(self, p: Profile, q: Profile, weight: dict[str, float]) -> int:
        best = 0
        some, others = self._led(p.names, weight), self._led(q.names, weight)
        # most pairs end here: the heaviest word of one has no counterpart in the other
        of_p = self._counterparts(some, others)
        of_q = self._counterparts(others, some) if of_p else {}
        for x, a in some if of_q else ():
            for y, b in others:
                if x not in of_p or y not in of_q or of_p[x].isdisjoint(b) or of_q[y].isdisjoint(a):
                    continue
                level, _ = self.name(a, b, weight)
                best = max(best, level)
                if best == 2:
                    return 2
        if best == 1 and not self._share_other(p, q, weight):
            return 0  # both have first names in full, and none in common: relatives
        return best

    def _others(self, p: Profile, weight: dict[str, float]) -> set[str]:
        return {w for n in p.names for w in n if len(w) > 1 and weight.get(w, 0.0) < self.strong}

    def _share_other(self, p: Profile, q: Profile, weight: dict[str, float]) -> bool:
        a, b = self._others(p, weight), self._others(q, weight)
        return not a or not b or any(self.word(x, y) >= 0.7 for x in a for y in b)

    def verdict(self, p: Profile, q: Profile, weight: dict[str, float]) -> tuple[bool, int]:
        """(same, level): level is that of the names, 0 or less where they do not match."""
        if p.kind and q.kind and p.kind != q.kind:
            return False, 0
        level = self.names(p, q, weight)
        if level <= 0:
            return False, level
        when, where = births(p, q), _common(p.countries, q.countries)
        number = bool(p.numbers & q.numbers)
        if number and when >= 0:
            return True, level
        if when < 0:
            return number and level == 2, level
        if level == 2:
            return when > 0 or where >= 0, level
        return when > 0 or where > 0 or (p.kind in ("E", "V", "A") and where >= 0), level


def _common(a: frozenset, b: frozenset) -> int:
    return 0 if not a or not b else 1 if a & b else -1


def _births(a: tuple, b: tuple) -> int:
    """2 the same day, 1 may be the same, -1 not."""
    gap = max(0, a[0] - b[1], b[0] - a[1])
    months, days = a[2] is not None and b[2] is not None, a[3] is not None and b[3] is not None
    if months and days:
        if (a[2], a[3]) == (b[2], b[3]):
            return 2 if gap == 0 else 1 if gap <= 3 else -1
        if gap == 0 and ((a[2], a[3]) == (b[3], b[2]) or a[2] == b[2] or a[3] == b[3]):
            return 1
        return -1
    if months:
        return (1 if gap <= 3 else -1) if a[2] == b[2] else -1
    return 1 if gap <= 1 else -1


def births(p: Profile, q: Profile) -> int:
    """Best agreement of any two dates; 0 if either has none."""
    return max((_births(a, b) for a in p.births for b in q.births), default=0)


#: Fields beside the names, by which pairs are ruled out before names are compared.
LIGHT = ("kind", "births", "countries", "numbers")

_MONTHS = "x.m is not null and y.m is not null"
_BIRTHS_OF_TWO = f"""case
 when {_MONTHS} and x.d is not null and y.d is not null then case
  when x.m = y.m and x.d = y.d then case when gap = 0 then 2 when gap <= 3 then 1 else -1 end
  when gap = 0 and ((x.m = y.d and x.d = y.m) or x.m = y.m or x.d = y.d) then 1 else -1 end
 when {_MONTHS} then case when x.m = y.m and gap <= 3 then 1 else -1 end
 when gap <= 1 then 1 else -1 end""".replace("gap", "greatest(0, x.y1 - y.y2, y.y1 - x.y2)")


def beside(a: str, b: str) -> tuple[Column, Column, Column]:
    """(births, countries, number) of two profiles in columns ``a`` and ``b`` (structs with ``LIGHT``): as ``births`` and ``_common`` above, and 1 for a common number."""
    when = F.expr(f"coalesce(array_max(flatten(transform({a}.births, x -> transform({b}.births, y -> {_BIRTHS_OF_TWO})))), 0)")
    where = F.expr(f"case when size({a}.countries) = 0 or size({b}.countries) = 0 then 0 when arrays_overlap({a}.countries, {b}.countries) then 1 else -1 end")
    return when, where, F.expr(f"cast(arrays_overlap({a}.numbers, {b}.numbers) as int)")


def not_excluded(births: Column, countries: Column, number: Column) -> Column:
    """Whether two profiles may be of one: a common number, births that agree, or nothing in births and countries against it."""
    return (number == 1) | (births > 0) | ((births == 0) & (countries >= 0))


def of_one_kind(a: str, b: str) -> Column:
    return F.expr(f"coalesce({a}.kind = {b}.kind, true)")


_FIELD, _ITEM = "\x1e", "\x1f"


def encoded() -> Column:
    """A profile with its word weights as one text: it is small in a shuffle and in Arrow, and parsed once per task."""
    births = F.transform("births", lambda b: F.concat_ws(",", *[F.coalesce(b[k].cast("string"), F.lit("-")) for k in ("y1", "y2", "m", "d")]))
    weights = F.transform("weights", lambda x: F.concat_ws(" ", x["t"], F.round(x["w"], 4).cast("string")))
    names = F.transform("names", lambda n: F.concat_ws(" ", n))
    return F.concat_ws(_FIELD, F.coalesce("kind", F.lit("")), *[F.concat_ws(_ITEM, c) for c in (names, births, F.col("countries"), F.col("numbers"), weights)])


@lru_cache(maxsize=4096)
def parsed(text: str) -> tuple[Profile, dict[str, float]]:
    kind, names, dates, countries, numbers, weights = text.split(_FIELD)
    items = lambda x: x.split(_ITEM) if x else []
    births = [tuple(None if v == "-" else int(v) for v in d.split(",")) for d in items(dates)]
    pairs = (w.rsplit(" ", 1) for w in items(weights))
    return Profile(kind or None, [n.split(" ") for n in items(names)], births, frozenset(items(countries)), frozenset(items(numbers))), {t: float(w) for t, w in pairs}


def judge_pairs(variants: frozenset[tuple[str, str]], strong: float, keep: list[str]):
    """A ``mapInPandas`` function over pairs with ``body_a`` and ``body_b``: adds same and level."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        judge = Judge(variants, strong)
        for b in batches:
            same, levels = [], []
            for x, y in zip(b["body_a"], b["body_b"]):
                (p, wp), (q, wq) = parsed(x), parsed(y)
                yes, level = judge.verdict(p, q, wp | wq)
                same.append(yes)
                levels.append(level)
            out = b[keep].copy()
            out["same"], out["level"] = same, levels
            yield out

    return run
