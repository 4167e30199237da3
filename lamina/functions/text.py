"""String functions of the predicate language, as JVM-side column expressions.

Positions are 1-based code points; negative ones count from the end. Patterns use the small pattern language
(%a classes, sets, captures, back references, lazy -, anchors) and are translated to Java regexes; balanced matches
(%b) and position captures have no regex and are refused.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the pattern language: ASCII members of each class.
CLASSES = {
    "a": "A-Za-z",
    "c": r"\x00-\x1f\x7f",
    "d": "0-9",
    "g": r"\x21-\x7e",
    "l": "a-z",
    "p": r"\x21-\x2f\x3a-\x40\x5b-\x60\x7b-\x7e",
    "s": r"\x09-\x0d\x20",
    "u": "A-Z",
    "w": "A-Za-z0-9",
    "x": "A-Fa-f0-9",
}
_SPECIAL = set(r"\.[]{}()*+-?^$|&~#")


def _quoted(ch: str) -> str:
    return "\\" + ch if ch in _SPECIAL else ch


def _class(ch: str) -> str:
    if ch.lower() not in CLASSES:
        return _quoted(ch)
    return f"[{'^' if ch.isupper() else ''}{CLASSES[ch.lower()]}]"


def _set(p: str, i: int) -> tuple[str, int]:
    """The set that starts after p[i] == '[' as a Java set, and the place after it."""
    i += 1
    negate = p[i : i + 1] == "^"
    i += negate
    parts, first = [], True
    while i < len(p) and (p[i] != "]" or first):
        first = False
        if p[i] == "%" and i + 1 < len(p):
            c = p[i + 1]
            if c.lower() in CLASSES:
                parts.append(f"[{'^' if c.isupper() else ''}{CLASSES[c.lower()]}]" if c.isupper() else CLASSES[c])
            else:
                parts.append(_quoted(c))
            i += 2
        elif i + 2 < len(p) and p[i + 1] == "-" and p[i + 2] != "]":
            parts.append(f"{_quoted(p[i])}-{_quoted(p[i + 2])}")
            i += 3
        else:
            parts.append(_quoted(p[i]))
            i += 1
    if i >= len(p):
        raise ValueError(f"set without an end in {p!r}")
    return f"[{'^' if negate else ''}{''.join(parts)}]", i + 1


def to_regex(pattern: str, anchored: bool = True) -> str:
    """The Java regex of a pattern. anchored=False: a leading ^ is a plain character."""
    out, i = [], 0
    if anchored and pattern.startswith("^"):
        out, i = ["^"], 1
    while i < len(pattern):
        c = pattern[i]
        if c == "(":
            if pattern[i + 1 : i + 2] == ")":
                raise ValueError("position captures have no regex")
            out.append("(")
            i += 1
            continue
        if c == ")":
            out.append(")")
            i += 1
            continue
        if c == "$" and i == len(pattern) - 1:
            out.append(r"\z")
            break
        if c == "%":
            if i + 1 >= len(pattern):
                raise ValueError("pattern ends with %")
            n = pattern[i + 1]
            if n in "bf":
                raise ValueError(f"%{n} has no regex")
            one, i = (f"\\{n}" if n.isdigit() else _class(n)), i + 2
            if n.isdigit():
                out.append(one)
                continue
        elif c == "[":
            one, i = _set(pattern, i)
        else:
            one, i = ("[\\s\\S]" if c == "." else _quoted(c)), i + 1
        q = pattern[i : i + 1]
        if q and q in "*+?-":
            one, i = one + {"*": "*", "+": "+", "?": "?", "-": "*?"}[q], i + 1
        out.append(one)
    return "".join(out)


def length(c: Column) -> Column:
    return F.char_length(c)


def sub(c: Column, i: int, j: int = -1) -> Column:
    n = F.char_length(c)
    start = F.greatest(F.lit(i) if i > 0 else F.lit(1) if i == 0 else n + i + 1, F.lit(1))
    end = F.least(F.lit(j), n) if j >= 0 else n + j + 1
    return F.when(end >= start, F.substring(c, start, end - start + 1)).otherwise("")


def reverse(c: Column) -> Column:
    return F.reverse(c)


def codepoints(c: Column, i: int = 1, j: int | None = None) -> Column:
    """array<int> of the code points i to j (only i if j is None)."""
    piece = sub(c, i, i if j is None else j)
    return F.transform(F.filter(F.split(piece, ""), lambda x: x != ""), F.ascii)


def char(code: int) -> Column:
    if not 0 <= code <= 0x10FFFF:
        raise ValueError("no such code point")
    return F.lit(chr(code))


def pieces(c: Column, n: int) -> Column:
    """The n-character pieces; a short tail is dropped."""
    whole = F.floor(F.char_length(c) / n).cast("int")
    return F.when(whole > 0, F.transform(F.sequence(F.lit(0), whole - 1), lambda k: F.substring(c, k * n + 1, F.lit(n)))).otherwise(F.expr("cast(array() as array<string>)"))


def find(c: Column, pattern: str, plain: bool = False) -> Column:
    """1-based place of the first match, 0 if none."""
    return F.instr(c, F.lit(pattern)) if plain else F.when(F.regexp_like(c, F.lit(to_regex(pattern))), F.char_length(F.split(c, to_regex(pattern), 2)[0]) + 1).otherwise(0)


def match(c: Column, pattern: str) -> Column:
    """The first capture, or the whole match; null if none."""
    regex = to_regex(pattern)
    return F.when(F.regexp_like(c, F.lit(regex)), F.regexp_extract(c, regex, 1 if "(" in pattern.replace("%(", "") else 0))


def gmatch(c: Column, pattern: str) -> Column:
    regex = to_regex(pattern, anchored=False)
    return F.regexp_extract_all(c, F.lit(regex), F.lit(1 if "(" in pattern.replace("%(", "") else 0))


def gsub(c: Column, pattern: str, replacement: str) -> tuple[Column, Column]:
    """(text with every match replaced, number of matches); %0 to %9 stand for captures, %% for %."""
    out, i = [], 0
    while i < len(replacement):
        ch = replacement[i]
        if ch == "%" and i + 1 < len(replacement):
            n = replacement[i + 1]
            out.append(f"${n}" if n.isdigit() else "%" if n == "%" else n)
            i += 2
            continue
        out.append("\\" + ch if ch in "\\$" else ch)
        i += 1
    regex = to_regex(pattern)
    return F.regexp_replace(c, regex, "".join(out)), F.regexp_count(c, F.lit(regex))


def contains(c: Column, values: list) -> Column:
    return c.isin(*values) if values else F.lit(False)


def printable(c: Column) -> Column:
    """The text itself if it is valid UTF-8, else with all but printable ASCII as '?'."""
    return F.when(F.is_valid_utf8(c), c).otherwise(F.regexp_replace(c, "[^ -~]", "?"))


def valid_chars(c: Column) -> Column:
    return F.regexp_replace(c, r'[<>:"|?*]', "�")


def human_size(n: Column) -> Column:
    """Three significant digits, cut not rounded, in steps of 1024 from 1000 on: 999 -> '999 ', 1000 -> '0.97 K'."""
    out = F.concat(n.cast("string"), F.lit(" "))
    for power, unit in enumerate("KMGTPE", 1):
        base = 1024**power
        hundredths = F.floor(n.cast("decimal(38,0)") * 100 / F.lit(base).cast("decimal(38,0)")).cast("long")
        whole = F.floor(hundredths / 100)
        two = F.lpad((hundredths % 100).cast("string"), 2, "0")
        text = F.when(whole >= 100, whole.cast("string")).when(whole >= 10, F.concat(whole.cast("string"), F.lit("."), F.substring(two, 1, 1))).otherwise(F.concat(whole.cast("string"), F.lit("."), two))
        # a unit serves from 1000 of the one below, save that 999.9 and more of it stay as 999
        start = 1000 * 1024 ** (power - 1)
        out = F.when(n >= start, F.concat(text, F.lit(f" {unit}"))).otherwise(out)
    return out


def thousands(n: Column, width: int = 0) -> Column:
    text = F.format_number(n, 0)
    return F.lpad(text, width, " ") if width else text


def date_text(t: Column) -> Column:
    return F.when(t.isNull() | (t == F.lit(0).cast("timestamp")), " " * 19).otherwise(F.date_format(t, "yyyy-MM-dd HH:mm:ss"))


def lower(c: Column) -> Column:
    """A-Z only."""
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def upper(c: Column) -> Column:
    """a-z only."""
    return F.translate(c, "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")


def repeat(c: Column, n: int, between: str = "") -> Column:
    """The text n times, with a text between; empty if n is below 1."""
    if n < 1:
        return F.when(c.isNotNull(), F.lit(""))
    return F.repeat(c, n) if not between else F.concat(F.repeat(F.concat(c, F.lit(between)), n - 1), c)


def formatted(template: str, *values: Column) -> Column:
    """printf: %d %s %x %5.2f and the like; %i is %d, %q quotes a text with its control characters escaped."""
    out, i, n, used = [], 0, 0, []
    while i < len(template):
        if template[i] != "%":
            out.append(template[i])
            i += 1
            continue
        j = i + 1
        while j < len(template) and template[j] in "-+ #0123456789.":
            j += 1
        if j >= len(template):
            raise ValueError(f"{template!r} ends inside a conversion")
        kind = template[j]
        if kind == "%":
            out.append("%%")
        elif n >= len(values):
            raise ValueError(f"{template!r} wants more values")
        elif kind == "q":
            text = values[n].cast("string")
            for a, b in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\\n"), ("\r", "\\r"), ("\0", "\\0")):
                text = F.replace(text, F.lit(a), F.lit(b))
            used.append(F.concat(F.lit('"'), text, F.lit('"')))
            out.append("%s")
            n += 1
        elif kind in "dixXocsfeEgG":
            used.append(values[n].cast("long") if kind in "dixXo" else values[n].cast("double") if kind in "feEgG" else values[n].cast("string") if kind == "s" else F.char(values[n].cast("long")))
            out.append(template[i:j] + {"i": "d", "c": "s"}.get(kind, kind))
            n += 1
        else:
            raise ValueError(f"no conversion %{kind}")
        i = j + 1
    return F.format_string("".join(out), *used) if used else F.lit("".join(out).replace("%%", "%"))


def matches(c: Column, pattern: str, init: int = 1) -> Column:
    """array<string> of all captures of the first match from place init on, or the whole match; null if none."""
    rest = c if init == 1 else sub(c, init)
    regex = to_regex(pattern)
    n = pattern.replace("%(", "").count("(")
    groups = [F.regexp_extract(rest, regex, i) for i in (range(1, n + 1) if n else [0])]
    return F.when(F.regexp_like(rest, F.lit(regex)), F.array(*groups))


def find_span(c: Column, pattern: str, init: int = 1) -> Column:
    """struct<start,end,captures> of the first match from place init on (1-based, end inclusive); null if none."""
    rest = c if init == 1 else sub(c, init)
    regex = to_regex(pattern)
    shift = F.lit(0) if init in (0, 1) else F.lit(init - 1) if init > 1 else F.greatest(F.char_length(c) + init, F.lit(0))
    start = F.char_length(F.split(rest, regex, 2)[0]) + shift + 1
    end = start + F.char_length(F.regexp_extract(rest, regex, 0)) - 1
    n = pattern.replace("%(", "").count("(")
    captures = F.array(*[F.regexp_extract(rest, regex, i) for i in range(1, n + 1)]) if n else F.expr("cast(array() as array<string>)")
    return F.when(F.regexp_like(rest, F.lit(regex)), F.struct(start.alias("start"), end.alias("end"), captures.alias("captures")))


def gensub_spans(c: Column, n: int) -> Column:
    """array<struct<piece,start,end>>: the n-character pieces with their byte spans (1-based, end inclusive)."""
    each = pieces(c, n)
    whole = F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<piece:string,start:int,end:int>>)").alias("out"))

    def step(acc, x):
        end = acc["at"] + F.octet_length(x)
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(x.alias("piece"), (acc["at"] + 1).alias("start"), end.alias("end")))).alias("out"))

    return F.aggregate(each, whole, step, lambda acc: acc["out"])
