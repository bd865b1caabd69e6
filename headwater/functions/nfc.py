"""Canonical composition (NFC) of texts as Column expressions; none runs Python.

All tables are built by rule from the character database of the standard library. A text without any character that
could change is returned after one search; else characters are decomposed, runs of marks are ordered by their classes,
and each mark that nothing blocks is joined to the starter before it. Each step is linear in the text, whatever the
length of its runs of marks (but for their sorting): of a run, a starter takes three marks at most.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

_CHARS = [chr(i) for i in range(0x80, sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
_SYLLABLE = range(0xAC00, 0xD7A4)
_CLASSES = {c: k for c in _CHARS if (k := unicodedata.combining(c))}
#: Full decompositions, the longest first; syllables of Hangul are arithmetic and not among them.
_DECOMPOSED = sorted(((c, d) for c in _CHARS if ord(c) not in _SYLLABLE and (d := unicodedata.normalize("NFD", c)) != c), key=lambda p: -len(p[1]))
#: (starter, what follows it, both as one), shorter results before those that are built on them.
_PAIRS = sorted(
    ((first, second, c) for c, d in _DECOMPOSED if unicodedata.normalize("NFC", c) == c for first, second in [(unicodedata.normalize("NFC", d[:-1]), d[-1])] if len(first) == 1),
    key=lambda p: len(unicodedata.normalize("NFD", p[2])),
)
_JOINS = [p for p in _PAIRS if p[1] not in _CLASSES]
_BY_MARK: dict[str, list[tuple[str, str]]] = {}
for _first, _second, _whole in _PAIRS:
    if _second in _CLASSES:
        _BY_MARK.setdefault(_second, []).append((_first, _whole))


def _ranges(chars: Iterable[str]) -> str:
    found: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if found and found[-1][1] == code - 1:
            found[-1][1] = code
        else:
            found.append([code, code])
    return "".join(rf"\x{{{a:X}}}-\x{{{b:X}}}" for a, b in found)


# Characters below U+0300 are told first, as most texts have no others.
_HIGH = r"\x{300}-\x{10FFFF}"
_MARK = rf"[{_HIGH}&&[{_ranges(_CLASSES)}]]"
_NO_MARK = rf"[\x{{0}}-\x{{2FF}}[^{_ranges(_CLASSES)}]]"
_SECOND = rf"[{_HIGH}&&[{_ranges(p[1] for p in _JOINS)}]]"
_JAMO = r"[\x{1161}-\x{1175}\x{11A8}-\x{11C2}]"
_CHANGING = [c for c in _CHARS if ord(c) not in _SYLLABLE and unicodedata.normalize("NFC", c) != c]
_TOUCHED = rf"[{_HIGH}&&[{_ranges([*_CLASSES, *_CHANGING, *(p[1] for p in _JOINS)])}\x{{1161}}-\x{{1175}}\x{{11A8}}-\x{{11C2}}]]"
_PARTED = rf"[\x{{C0}}-\x{{10FFFF}}&&[{_ranges(c for c, _ in _DECOMPOSED)}]]"
_WHOLE = rf"[\x{{0}}-\x{{BF}}[^{_ranges(c for c, _ in _DECOMPOSED)}]]"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Binds a value to a name, else every use would repeat the expression above it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _over(text: Column, pattern: str, change: Callable[[Column], Column]) -> Column:
    """Applies ``change`` to the pieces that a pattern cuts a text into."""
    return F.array_join(F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), change), "")


def _decompose(text: Column) -> Column:
    """The k-th characters of all decompositions are one ``translate``, which drops what has fewer."""
    chars = "".join(c for c, _ in _DECOMPOSED)
    parts = lambda p: F.concat(*[F.translate(p, chars, "".join(d[k] for _, d in _DECOMPOSED if len(d) > k)) for k in range(len(_DECOMPOSED[0][1]))])
    return _over(text, rf"{_PARTED}|{_WHOLE}++", lambda p: F.when(p.rlike(rf"^{_PARTED}"), parts(p)).otherwise(p))


def _class(mark: Column) -> Column:
    """A character whose order is that of the mark's class."""
    return F.translate(mark, "".join(_CLASSES), "".join(chr(0x100 + k) for k in _CLASSES.values()))


def _order(text: Column) -> Column:
    def run(p: Column) -> Column:
        keyed = F.transform(F.regexp_extract_all(p, F.lit(_MARK), F.lit(0)), lambda m, i: F.struct(_class(m).alias("k"), i.alias("i"), m.alias("m")))
        return F.array_join(F.transform(F.array_sort(keyed), lambda s: s["m"]), "")

    return _over(text, rf"{_MARK}++|{_NO_MARK}++", lambda p: F.when(p.rlike(rf"^{_MARK}{{2}}"), run(p)).otherwise(p))


def _join_starters(text: Column) -> Column:
    joined = text
    for first, second, whole in _JOINS:
        joined = F.replace(joined, F.lit(first + second), F.lit(whole))
    return F.when(text.rlike(_SECOND), joined).otherwise(text)


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _join_jamo(text: Column) -> Column:
    """Syllables of Hangul by their arithmetic."""

    def one(p: Column) -> Column:
        at = lambda k: F.ascii(F.substring(p, k, 1))
        tail = F.when(F.length(p) == 3, at(3) - 0x11A7).otherwise(0)
        letters = _char(0xAC00 + ((at(1) - 0x1100) * 21 + at(2) - 0x1161) * 28 + tail)
        closed = F.when((at(1) - 0xAC00) % 28 == 0, _char(at(1) + at(2) - 0x11A7)).otherwise(p)
        return F.when(p.rlike(r"^[\x{1100}-\x{1112}][\x{1161}-\x{1175}]"), letters).when(p.rlike(r"^[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}]"), closed).otherwise(p)

    pieces = r"(?s)[\x{1100}-\x{1112}][\x{1161}-\x{1175}][\x{11A8}-\x{11C2}]?|[\x{AC00}-\x{D7A3}][\x{11A8}-\x{11C2}]|."
    return F.when(text.rlike(_JAMO), _over(text, pieces, one)).otherwise(text)


def _compose(text: Column) -> Column:
    """Folds the marks after a starter: it takes each one that forms a pair with it, unless a mark of the same class or a
    higher one was left between them."""
    strings = lambda k: F.create_map(*[F.lit(x) for mark, pairs in _BY_MARK.items() for x in (mark, "".join(p[k] for p in pairs))])
    firsts, wholes = strings(0), strings(1)

    def step(state: Column, mark: Column) -> Column:
        place = F.instr(F.coalesce(F.try_element_at(firsts, mark["m"]), F.lit("")), state["starter"])
        free = (state["starter"] != "") & (state["last"] < mark["k"])
        return _let(
            F.when(free, place).otherwise(0),
            lambda at: F.when(at > 0, F.struct(F.substring(F.try_element_at(wholes, mark["m"]), at, F.lit(1)).alias("starter"), state["last"].alias("last"), F.array_append(state["taken"], mark["i"]).alias("taken"))).otherwise(
                F.struct(state["starter"].alias("starter"), mark["k"].alias("last"), state["taken"].alias("taken"))
            ),
        )

    def piece(p: Column) -> Column:
        marks = F.transform(F.regexp_extract_all(p, F.lit(_MARK), F.lit(0)), lambda m, i: F.struct(m.alias("m"), _class(m).alias("k"), i.alias("i")))

        def folded(ms: Column) -> Column:
            body = F.substring(p, F.lit(1), F.length(p) - F.size(ms))
            begin = F.struct(F.right(body, F.lit(1)).alias("starter"), F.lit("").alias("last"), F.array().cast("array<int>").alias("taken"))
            done = F.aggregate(ms, begin, step)
            head = F.substring(body, F.lit(1), F.length(body) - 1)
            rest = lambda s: F.array_join(F.transform(F.filter(ms, lambda m: ~F.array_contains(s["taken"], m["i"])), lambda m: m["m"]), "")
            return _let(done, lambda s: F.concat(head, s["starter"], rest(s)))

        return F.when(p.rlike(rf"{_MARK}\z"), _let(marks, folded)).otherwise(p)

    return _over(text, rf"{_NO_MARK}*+{_MARK}++|{_NO_MARK}++", piece)


def nfc(text: Column) -> Column:
    """The composed form of a text; null stays null."""

    def changed(t: Column) -> Column:
        held = F.array(t)
        for step in (_decompose, _order, _join_starters, _join_jamo, _compose):
            held = F.transform(held, step)
        return F.get(held, F.lit(0))

    return _let(text, lambda t: F.when(t.rlike(_TOUCHED), changed(t)).otherwise(t))
