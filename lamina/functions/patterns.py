"""The whole pattern language, for what no regex can express: balanced matches, position captures, functions as
replacements. Vectorised Python functions over Arrow batches; where a regex serves, functions.text is the faster way.

Positions are 1-based code points, ends inclusive. An item is a character, a class, a set or a back reference, each
with an optional * + - or ?; %bxy is a balanced stretch. Matching is greedy from the left with backtracking.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from lamina.functions.text import CLASSES


def _members(spec: str) -> frozenset[str]:
    """The characters of an ASCII class as the regexes of functions.text write it."""
    import re

    one = re.compile(f"[{spec}]")
    return frozenset(chr(i) for i in range(128) if one.match(chr(i)))


_CLASS = {k: _members(v) for k, v in CLASSES.items()}


def _in_class(ch: str, letter: str) -> bool:
    low = letter.lower()
    if low not in _CLASS:
        return ch == letter
    return (ch in _CLASS[low]) == letter.islower()


def _in_set(ch: str, body: str) -> bool:
    negate, i = body.startswith("^"), int(body.startswith("^"))
    hit = False
    while i < len(body):
        if body[i] == "%" and i + 1 < len(body):
            hit, i = hit or _in_class(ch, body[i + 1]), i + 2
        elif i + 2 < len(body) and body[i + 1] == "-":
            hit, i = hit or body[i] <= ch <= body[i + 2], i + 3
        else:
            hit, i = hit or ch == body[i], i + 1
    return hit != negate


class Pattern:
    """A parsed pattern: items ("one", test, quantifier), ("open",), ("close",), ("here",), ("back", n), ("pair", x, y), ("end",)."""

    def __init__(self, text: str, anchored: bool = True) -> None:
        self.text, self.front = text, anchored and text.startswith("^")
        self.items: list[tuple] = []
        i, depth = int(self.front), 0
        while i < len(text):
            c = text[i]
            if c == "(":
                here = text[i + 1 : i + 2] == ")"
                self.items.append(("here",) if here else ("open",))
                depth += not here
                i += 2 if here else 1
                continue
            if c == ")":
                if not depth:
                    raise ValueError(f"{text!r}: nothing to close")
                depth -= 1
                self.items.append(("close",))
                i += 1
                continue
            if c == "$" and i == len(text) - 1:
                self.items.append(("end",))
                break
            if c == "%":
                if i + 1 >= len(text):
                    raise ValueError(f"{text!r} ends with %")
                n = text[i + 1]
                if n == "b":
                    if i + 3 >= len(text):
                        raise ValueError(f"{text!r}: %b wants two characters")
                    self.items.append(("pair", text[i + 2], text[i + 3]))
                    i += 4
                    continue
                if n == "f":
                    raise ValueError("no frontier patterns")
                if n.isdigit():
                    self.items.append(("back", int(n)))
                    i += 2
                    continue
                test, i = (lambda ch, n=n: _in_class(ch, n)), i + 2
            elif c == "[":
                end = i + 2 if text[i + 1 : i + 2] != "^" else i + 3  # a ] in front is a member
                while end < len(text) and text[end] != "]":
                    end += 2 if text[end] == "%" else 1
                if end >= len(text):
                    raise ValueError(f"set without an end in {text!r}")
                body = text[i + 1 : end]
                test, i = (lambda ch, body=body: _in_set(ch, body)), end + 1
            elif c == ".":
                test, i = (lambda ch: True), i + 1
            else:
                test, i = (lambda ch, c=c: ch == c), i + 1
            q = text[i : i + 1]
            if q and q in "*+-?":
                i += 1
            else:
                q = ""
            self.items.append(("one", test, q))
        if depth:
            raise ValueError(f"{text!r}: a capture without an end")

    def at(self, s: str, start: int) -> tuple[int, list] | None:
        """(end, captures) of a match that starts at a place, by backtracking over a stack of choices."""
        items = self.items
        todo: list[tuple[int, int, tuple, tuple]] = [(0, start, (), ())]
        while todo:
            k, i, caps, opened = todo.pop()
            while True:
                if k == len(items):
                    return i, [c if c[1] is not None else (c[0], None) for c in caps]
                kind = items[k][0]
                if kind == "open":
                    caps, opened, k = (*caps, (i, -1)), (*opened, len(caps)), k + 1
                elif kind == "close":
                    n = opened[-1]
                    caps, opened, k = (*caps[:n], (caps[n][0], i), *caps[n + 1 :]), opened[:-1], k + 1
                elif kind == "here":
                    caps, k = (*caps, (i, None)), k + 1
                elif kind == "end":
                    if i != len(s):
                        break
                    k += 1
                elif kind == "back":
                    n = items[k][1] - 1
                    if n >= len(caps) or caps[n][1] in (None, -1):
                        raise ValueError(f"{self.text!r}: no capture %{n + 1}")
                    part = s[caps[n][0] : caps[n][1]]
                    if not s.startswith(part, i):
                        break
                    i, k = i + len(part), k + 1
                elif kind == "pair":
                    x, y = items[k][1:]
                    if s[i : i + 1] != x:
                        break
                    depth, j = 1, i + 1
                    while j < len(s) and depth:
                        depth += -1 if s[j] == y else s[j] == x
                        j += 1
                    if depth:
                        break
                    i, k = j, k + 1
                else:
                    _, test, q = items[k]
                    if q in ("*", "+"):
                        n = i
                        while n < len(s) and test(s[n]):
                            n += 1
                        least = i + (q == "+")
                        if n < least:
                            break
                        todo += [(k + 1, j, caps, opened) for j in range(least, n)]
                        i, k = n, k + 1
                    elif q == "-":
                        if i < len(s) and test(s[i]):
                            todo.append((k, i + 1, caps, opened))
                        k += 1
                    elif q == "?":
                        if i < len(s) and test(s[i]):
                            todo.append((k + 1, i, caps, opened))
                            i += 1
                        k += 1
                    else:
                        if i >= len(s) or not test(s[i]):
                            break
                        i, k = i + 1, k + 1
        return None

    def find(self, s: str, init: int = 1) -> tuple[int, int, list[str]] | None:
        """(start, end, captures): 1-based, end inclusive; without captures in the pattern the list is empty."""
        begin = init - 1 if init > 0 else max(0, len(s) + init) if init < 0 else 0
        if begin > len(s):
            return None
        for i in [begin] if self.front else range(begin, len(s) + 1):
            if (hit := self.at(s, i)) is not None:
                return i + 1, hit[0], [str(a + 1) if b is None else s[a:b] for a, b in hit[1]]
        return None

    def all(self, s: str) -> Iterator[tuple[int, int, list[str]]]:
        """(start, end, captures) of all matches in order; the whole match stands for captures if there are none."""
        i = 0
        while i <= len(s):
            hit = self.at(s, i)
            if hit is not None and (hit[0] > i or True):
                end = hit[0]
                yield i + 1, end, [str(a + 1) if b is None else s[a:b] for a, b in hit[1]] or [s[i:end]]
                i = end if end > i else i + 1
            else:
                i += 1
            if self.front:
                return


Replacement = str | dict[str, str] | Callable[..., str | None]


def substitute(s: str, pattern: Pattern, by: Replacement, limit: int | None = None) -> tuple[str, int]:
    """(text, number of replacements). Text: %0 to %9 are captures; a table is asked by the first capture, a function gets
    all; what they do not have becomes empty."""
    out, last, n = [], 0, 0
    for start, end, caps in pattern.all(s):
        if limit is not None and n >= limit:
            break
        n += 1
        out.append(s[last : start - 1])
        if callable(by):
            out.append(by(*caps) or "")
        elif isinstance(by, dict):
            out.append(by.get(caps[0], ""))
        else:
            i = 0
            while i < len(by):
                if by[i] == "%" and i + 1 < len(by):
                    d = by[i + 1]
                    if d.isdigit() and int(d) > len(caps):
                        raise ValueError(f"no capture %{d}")
                    out.append(s[start - 1 : end] if d == "0" else caps[int(d) - 1] if d.isdigit() else d)
                    i += 2
                else:
                    out.append(by[i])
                    i += 1
        last = end
    return "".join([*out, s[last:]]), n


def find(c: Column, pattern: str, init: int = 1) -> Column:
    """struct<start,end,captures> of the first match from a place on; null if none."""
    parsed = Pattern(pattern)

    @F.pandas_udf("start int, end int, captures array<string>")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [None if t is None else parsed.find(t, init) for t in texts]
        return pd.DataFrame([(None, None, None) if r is None else r for r in rows], columns=["start", "end", "captures"]).astype({"start": "Int32", "end": "Int32"})

    out = run(c)
    return F.when(out["start"].isNotNull(), out)


def gmatch(c: Column, pattern: str) -> Column:
    """array<array<string>>: the captures of each match, or the match itself; a leading ^ is a plain character."""
    parsed = Pattern(pattern, anchored=False)

    @F.pandas_udf("array<array<string>>")
    def run(texts: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else [caps for _, _, caps in parsed.all(t)] for t in texts], dtype=object)

    return run(c)


def gsub(c: Column, pattern: str, by: Replacement, limit: int | None = None) -> Column:
    """struct<text,n>: text with at most limit matches replaced by text, a table or a function of the captures."""
    parsed = Pattern(pattern)

    @F.pandas_udf("text string, n int")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None) if t is None else substitute(t, parsed, by, limit) for t in texts]
        return pd.DataFrame(rows, columns=["text", "n"]).astype({"n": "Int32"})

    return run(c)
