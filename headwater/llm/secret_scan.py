"""Finds secrets in texts: three base patterns, and assignment-aware lexing around them.

Base spans, leftmost and not overlapping within a kind (a span is the whole match, in code points, end
exclusive): ``assign`` (a telling name, a sign and a literal of 12 or more characters), ``access`` (a key id
of 18 or more), ``hex`` (16 or more hex digits).

Lexing reads a text as source code or configuration: it finds names (bare, quoted or quoted subscripts, with or without a
declared type) followed by a sign of assignment or ``:`` and reads the value after it term by term: literals (quoted with
escapes and prefixes, triple-quoted, or bare to the end of the word), names, joined by operators or by standing side by side, in
brackets or not, on the same line or the next; blocks of YAML; all items of a list; what a constructor wraps. Names that are
assigned together take their values in order. A call's result is no literal, but a quoted name and a literal that stand side by
side as arguments are a pair. So are elements of markup, attributes, and properties (``name`` or ``key`` beside ``value`` or
content). Constants are propagated: where a name's value is or holds another name (also inside a formatted literal) that is
assigned anywhere in the text, before or after, the literals of that name reach the first one too. Each literal is then scored
by the most telling name that it reaches (the parts of a name, split at case changes and separators) and by its form (length,
kinds of characters, entropy); at ``SCORE`` or more the literal is reported as kind ``lexed``. A span runs from the first to
the last literal of a joined value. Short literals, plain words and numbers score lower the shorter they are; stand-ins for
values, and bare words in running text, score low.

Defined cases: null texts count as empty; texts without spans give zero counts and empty lists; repeated
rows and null ids are returned as they come; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("assign", "access", "hex", "lexed")
SCORE = 1.0
#: Fixed values of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")  # the maximal runs of 16 or more are those of the plain pattern
LEAST = {"assign": 12, "access": 18, "hex": 16}
_ASSIGN_HINT = re.compile(r"(?:password|passwd|secret|token|api_?key)[\"']?\x20*[:=]", re.IGNORECASE | re.ASCII)

#: A quoted literal, with escapes; tripled signs may span lines; letters before it tell its kind.
_BARE_QUOTED = r"""\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*+\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*+'{3}|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\\n]|\\.)*+`"""
_QUOTED = rf"(?:[bBrRuUfFL@$]{{1,2}}(?=[\"'`]))?+(?:{_BARE_QUOTED})"
_NAME = r"[A-Za-z_$][\w$.-]*+"
_WORD = r"""[^\s"'`,;(){}\[\]<>|]++"""
_TYPE = r"[&*]{0,2}+(?:'\w++\x20)?+(?:(?:mut|const)\x20)?+[A-Za-z_][\w.]*+(?:::\w++)*+(?:[\x20\t]*+[<\[][^\n=;:\"`{}]*+(?<=[>\]\x20\t]))?+[?!]?+(?:[\x20\t]*+\|[\x20\t]*+[\w.\[\]]++)*+"
#: A name, perhaps its type, and a sign. Possessive repeats without bounds keep the search linear.
_HEAD = re.compile(
    rf"""(?<![\w$.-])["']?(?P<name>{_NAME})(?:["'](?:[\x20\t]*+\])?+)?+
        (?:[?!]?+[\x20\t]*+:[\x20\t]*+{_TYPE}[\x20\t]*+(?==(?![=>]))|[\x20\t]++(?:string|\[\]byte)[\x20\t]*+(?==(?![=>])))?+
        (?P<gap>[\x20\t]*+)(?P<sign>:=|=>|<-|(?:\|\||\?\?|[?+.])?=(?![=>])|:(?!:))""",
    re.ASCII | re.VERBOSE,
)
#: Several names at the start of a line that are assigned together.
_TUPLE = re.compile(rf"^[\x20\t]*+(?:(?:let|const|var|my|local|auto)[\x20\t]++)?+[(\[]?+[\x20\t]*+(?P<names>{_NAME}(?:[\x20\t]*+,[\x20\t]*+{_NAME})++)[\x20\t]*+[)\]]?+[\x20\t]*+(?::=|=(?![=>]))", re.ASCII | re.MULTILINE)
#: A quoted name as the first of two things in brackets.
_KEYED = re.compile(rf"""[({{\[]\s*+(?:"(?P<a>{_NAME})"|'(?P<b>{_NAME})')\s*+,\s*+(?=[bBrRuUfFL@$]{{0,2}}["'`])""", re.ASCII)
#: What may stand before a value: blanks, tags and anchors.
_LEAD = re.compile(r"[\x20\t]*+(?:![\w!/:.-]*+[\x20\t]++|&[\w-]++[\x20\t]++)*+", re.ASCII)
_BLOCK = re.compile(r"[|>][0-9+-]{0,2}[\x20\t]*+(?:\#[^\n]*+)?\r?\n")
_LINE = re.compile(r"(?P<blanks>[\x20\t]*+)(?P<rest>[^\r\n]*+)\r?\n?")
_BREAK = re.compile(r"\\?\r?\n[\x20\t]*+")
#: A bare word alone on the next line, unless what opens that line is a name with a sign of its own.
_NEXT = re.compile(rf"\\?\r?\n[\x20\t]++(?!{_NAME}[\x20\t]*+(?::|=(?!=*+[\x20\t]*+(?:\r?\n|\Z))))(?P<word>{_WORD})(?=[\x20\t]*+(?:\r?\n|\Z))", re.ASCII)
_LITERAL = re.compile(_QUOTED, re.ASCII)
_BARE = re.compile(_WORD)
_NAMED = re.compile(_NAME, re.ASCII)
#: A constructor and its bracket: what it wraps is the value.
_MADE = re.compile(r"(?:new[\x20\t]++)?+(?:[A-Za-z_]\w*+(?:::|\.))*+(?:from|new|[A-Z]\w*+)\(\s*+", re.ASCII)
_OPERATOR = r"\+|\.\.|&(?!&)|(?<=[\x20\t])\.(?=[\x20\t])"
_GLUE = re.compile(rf"[\x20\t]*+(?:(?P<sign>{_OPERATOR})[\x20\t]*+(?:\\?\r?\n[\x20\t]*+)?+|\\\r?\n[\x20\t]*+)?+")
_GLUE_INSIDE = re.compile(rf"\s*+(?:(?P<sign>{_OPERATOR})\s*+)?+")
_COMMA = re.compile(r"\s*+,\s*+")
_SKIP = re.compile(r"""[^,\n()\[\]{}"'`]*+""")
_HOLE = re.compile(r"\{([A-Za-z_]\w*)", re.ASCII)
#: Markup: a start tag, its attributes, and what stands before the next tag.
_TAG = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]*+)(?P<rest>[^<>]*+)>(?P<text>[^<]*+)(?P<end></)?+", re.ASCII)
_ATTRIBUTE = re.compile(r"""(?P<name>[\w.:-]++)\s*+=\s*+(?:"(?P<a>[^"]*+)"|'(?P<b>[^']*+)')""", re.ASCII)
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")
#: How telling the parts of a name are.
WEIGHTS = {
    "password": 1.0, "passwd": 1.0, "pwd": 1.0, "passphrase": 1.0, "secret": 1.0, "token": 0.9, "apikey": 1.0,
    "credential": 0.9, "credentials": 0.9, "auth": 0.6, "bearer": 0.8, "private": 0.5, "access": 0.4, "key": 0.5,
    "api": 0.3, "client": 0.2, "signing": 0.4, "encryption": 0.4, "session": 0.3, "cookie": 0.3, "jwt": 0.8, "pass": 0.7,
}
#: Whole literals that are a word or a number, and those that are one repeated sign or a stand-in for a value.
_PLAIN = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9.,:-]+")
_STAND_IN = re.compile(r"(?i)(?:(.)\1*|(?:your|my|example|sample|change[-_ ]?me|placeholder|insert|enter)(?:[-_ ][a-z]+)*|<[^<>]*>|\$\{[^{}]*\}|\{\{.*\}\}|%[({].*[)}]s?)", re.DOTALL)


def name_weight(name: str) -> float:
    parts = [p.lower() for p in _PART.findall(name)]
    joined = [a + b for a, b in zip(parts, parts[1:], strict=False)]
    return min(1.5, sum(WEIGHTS.get(p, WEIGHTS.get(p.removesuffix("s"), 0.0)) for p in {*parts, *joined}))


def literal_weight(text: str, sure: bool = True) -> float:
    """From -1 to 0.5: form alone never suffices. ``sure``: quoted, or all that stands after the sign of a setting."""
    if _STAND_IN.fullmatch(text):
        return -1.0
    plain = _PLAIN.fullmatch(text) is not None
    if plain and not sure:
        return -1.0
    count = Counter(text)
    entropy = -sum(c / len(text) * math.log2(c / len(text)) for c in count.values())
    kinds = sum(bool(re.search(p, text)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    short = 0.05 * max(0, 14 - len(text)) if plain else 0.1 * max(0, 8 - len(text))
    return min(0.5, 0.1 * (entropy - 2) + 0.05 * kinds) - short


def base_spans(text: str) -> list[tuple[int, int, str]]:
    found = []
    if _ASSIGN_HINT.search(text):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= LEAST["assign"]]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= LEAST["access"]]
    return found + [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]


#: A literal, its place, and whether its form alone shows that it is one.
Value = tuple[str, int, int, bool]


def _inner(piece: str) -> tuple[int, int]:
    """Where the content of a quoted literal begins and ends."""
    at = next(i for i, c in enumerate(piece) if c in "\"'`")
    n = 3 if len(piece) - at >= 6 and piece[at : at + 3] in ('"""', "'''") else 1
    return at + n, len(piece) - n


class _Reader:
    """Reads a value term by term; each step moves on in the text."""

    def __init__(self, text: str):
        self.text = text

    def joined(self, at: int, inside: bool) -> tuple[Value | None, list[Value], int]:
        """(the literal, words, end) of terms that are joined; the first term is quoted."""
        text, pieces, words = self.text, [], []
        glue = _GLUE_INSIDE if inside else _GLUE
        end = at
        while m := _LITERAL.match(text, at):
            pieces.append((m[0], at))
            if m[0][0] in "fFrR$`" or m[0][1:2] in ("\"", "'", "`"):
                words += [(w[1], at + w.start(1), at + w.end(1), False) for w in _HOLE.finditer(m[0])]
            end = m.end()
            g = glue.match(text, end)
            at = g.end()
            while g["sign"] and not _LITERAL.match(text, at) and (w := _NAMED.match(text, at)):
                words.append((w[0], at, w.end(), False))
                end = w.end()
                g = glue.match(text, end)
                at = g.end()
        return self.literal(pieces), words, end

    @staticmethod
    def literal(pieces: list[tuple[str, int]]) -> Value | None:
        if not pieces:
            return None
        cuts = [_inner(p) for p, _ in pieces]
        value = "".join(p[a:b] for (p, _), (a, b) in zip(pieces, cuts, strict=True))
        (_, start), (last, end) = pieces[0], pieces[-1]
        if len(pieces) > 1:
            return value, start, end + len(last), True
        return value, start + cuts[0][0], start + cuts[0][1], True

    def bare(self, at: int, inside: bool, tight: bool) -> tuple[Value | None, list[Value], int] | None:
        text, m = self.text, _BARE.match(self.text, at)
        if not m:
            return None
        end = m.end()
        if text[end : end + 1] in ("(", "["):  # a call or a subscript
            if made := _MADE.match(text, at):
                if _LITERAL.match(text, made.end()):
                    return self.joined(made.end(), True)
            return None
        word = m[0].rstrip(".,:")
        words = [(word, at, at + len(word), tight and text[end : end + 1] in ("", "\r", "\n"))]
        g = (_GLUE_INSIDE if inside else _GLUE).match(text, end)
        if g["sign"] and g.start("sign") > end:
            at = g.end()
            if _LITERAL.match(text, at):
                literal, more, end = self.joined(at, inside)
                return literal, words + more, end
            if w := _NAMED.match(text, at):
                literal, more, end = self.after_word(w.end(), inside)
                return literal, [*words, (w[0], at, w.end(), False), *more], end
        return None if not word else (None, words, end)

    def after_word(self, end: int, inside: bool) -> tuple[Value | None, list[Value], int]:
        words = []
        while (g := (_GLUE_INSIDE if inside else _GLUE).match(self.text, end))["sign"]:
            if _LITERAL.match(self.text, g.end()):
                literal, more, end = self.joined(g.end(), inside)
                return literal, words + more, end
            w = _NAMED.match(self.text, g.end())
            if not w:
                break
            words.append((w[0], g.end(), w.end(), False))
            end = w.end()
        return None, words, end

    def term(self, at: int, inside: bool = False, tight: bool = False) -> tuple[Value | None, list[Value], int] | None:
        if _LITERAL.match(self.text, at):
            return self.joined(at, inside)
        if made := _MADE.match(self.text, at):
            return self.joined(made.end(), True) if _LITERAL.match(self.text, made.end()) else None
        return self.bare(at, inside, tight)

    def block(self, name_at: int, at: int) -> tuple[Value, int] | None:
        """The lines below a name that are set in further than its own line."""
        text = self.text
        line = text.rfind("\n", 0, name_at) + 1
        base, first, last, lines = len(_LINE.match(text, line)["blanks"]), None, at, []
        while at < len(text):
            m = _LINE.match(text, at)
            if m["rest"] and len(m["blanks"]) <= base:
                break
            if m["rest"]:
                first = m.start("rest") if first is None else first
                last = m.start("rest") + len(m["rest"].rstrip())
                lines.append(m["rest"].strip())
            at = m.end()
        return None if first is None else (("\n".join(lines), first, last, True), last)

    def values(self, at: int, name_at: int = 0, tight: bool = False) -> tuple[list[tuple[Value | None, list[Value]]], int | None]:
        """All values after a sign, several if they are a list, and where they end (None: no value)."""
        text = self.text
        begin, at = at, _LEAD.match(text, at).end()
        tight = tight and at == begin
        if b := _BLOCK.match(text, at):
            found = self.block(name_at, b.end())
            return ([(found[0], [])], found[1]) if found else ([], None)
        if b := _BREAK.match(text, at):
            if _LITERAL.match(text, b.end()):
                literal, words, end = self.joined(b.end(), False)
                opens = re.compile(r"\]?[\x20\t]*+[:=]").match(text, end)
                return ([], None) if opens else ([(literal, words)], end)
            if n := _NEXT.match(text, at):
                word = n["word"].rstrip(".,:")
                return [(None, [(word, n.start("word"), n.start("word") + len(word), False)])], n.end()
            return [], None
        depth = at
        while text[at : at + 1] in ("(", "["):
            at += 1
            while text[at : at + 1].isspace():
                at += 1
        if at == depth:
            found = self.term(at, False, tight)
            return ([found[:2]], found[2]) if found else ([], None)
        out, end = [], None
        while found := self.term(at, True):
            if found[0] is None:  # bare words in brackets are names at most
                found = (None, [(w, a, b, False) for w, a, b, _ in found[1]] + [("", at, at, False)], found[2])
            out.append(found[:2])
            end = found[2]
            if not (comma := _COMMA.match(text, end)):
                break
            at = comma.end()
        return out, end


def _assignments(text: str) -> Iterator[tuple[str, Value | None, list[Value]]]:
    """(name, its literal and place, other words of its value and their places)."""
    reader, ends = _Reader(text), set()
    if "," in text:
        for m in _TUPLE.finditer(text):
            ends.add(m.end())
            at = _LEAD.match(text, m.end()).end()
            for name in m["names"].split(","):
                found = reader.term(at)
                if found:
                    yield name.strip(), found[0], found[1]
                comma = _COMMA.match(text, found[2] if found else _SKIP.match(text, at).end())
                if not comma:
                    break
                at = comma.end()
        for m in _KEYED.finditer(text):
            literal, words, _ = reader.joined(m.end(), True)
            if literal:
                yield m["a"] or m["b"], literal, words
    at = 0
    while m := _HEAD.search(text, at):
        at = m.end()
        if at in ends:
            continue
        found, end = reader.values(at, m.start("name"), m["sign"] == "=" and not m["gap"])
        for literal, words in found:
            yield m["name"], literal, words
        at = at if end is None else end


def _markup(text: str) -> Iterator[tuple[str, Value | None, list[Value]]]:
    """Elements with plain content, and properties that name their value in attributes."""
    for m in _TAG.finditer(text):
        content = m["text"].strip()
        at = m.start("text") + len(m["text"]) - len(m["text"].lstrip())
        inside = (content, at, at + len(content), True) if content and m["end"] and text.startswith(m["name"], m.end()) else None
        if inside:
            yield m["name"], inside, []
        named = value = None
        for a in _ATTRIBUTE.finditer(m["rest"]):
            kind, group = a["name"].lower(), "a" if a["a"] is not None else "b"
            if kind in ("name", "key", "id"):
                named = named or a[group]
            elif kind == "value":
                value = (a[group], m.start("rest") + a.start(group), m.start("rest") + a.end(group), True)
        if named and (value or inside):
            yield named, value or inside, []


def lexed_spans(text: str) -> list[tuple[int, int, str]]:
    """Literals that telling names receive, directly or through other names."""
    found = [*_assignments(text), *(_markup(text) if "<" in text else ())]
    assigned = {name for name, _, _ in found}
    weight = {name: name_weight(name) for name in assigned}
    gives: dict[str, set[str]] = {}  # for each name those whose literals it receives
    literals: dict[tuple[int, int], tuple[str, bool, set[str]]] = {}
    for name, literal, words in found:
        for word, start, end, sure in words:
            if word in assigned and word != name:
                gives.setdefault(name, set()).add(word)
            elif literal is None and len(words) == 1 and word:
                literal = (word, start, end, sure)
        if literal and literal[0]:
            literals.setdefault(literal[1:3], (literal[0], literal[3], set()))[2].add(name)
    todo = list(gives)
    while todo:
        name = todo.pop()
        for other in gives.get(name, ()):
            if weight[other] < weight[name]:
                weight[other] = weight[name]
                todo.append(other)
    best = {place: (value, sure, max(weight[n] for n in names)) for place, (value, sure, names) in literals.items()}
    return sorted((a, b, "lexed") for (a, b), (v, sure, w) in best.items() if w and w + literal_weight(v, sure) >= SCORE)


#: Without any of these a text holds no pair.
_SIGNS = ("=", ":", "<-", "(", "{", "[")


def ordered(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1])))


def scan(text: str | None) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """(base spans, lexed spans)."""
    text = text or ""
    return base_spans(text), (lexed_spans(text) if any(c in text for c in _SIGNS) else [])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans): each span with kind, start, end and the text in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("text", pa.string())]))
        for batch in small_batches(batches):
            out = []
            for text in batch.column(1).to_pylist():
                base, lexed = scan(text)
                spans = sorted([*base, *lexed], key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
                out.append([{"kind": k, "start": a, "end": b, "text": text[a:b]} for a, b, k in spans])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "spans"])

    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return narrow.mapInArrow(run, "doc_id long, spans array<struct<kind:string,start:long,end:long,text:string>>")


def digest(base: str) -> str:
    return hashlib.sha256(base.encode()).hexdigest()
