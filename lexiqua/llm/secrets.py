"""Secrets in texts: fixed patterns, and assignments read as source or configuration syntax.

A lexer cuts the text into names, literals of every quote form (escapes, triple quotes, backticks,
prefixes), operators, line ends and blanks (continued lines count as blanks).  A small grammar over
these tokens reads ``targets = value``: also ``:``, ``:=``, ``=>``, typed declarations, quoted names
and subscripts, chains, tuples, defaults of calls and of ``or``, literals that stand side by side or are
joined by operators, within brackets over several lines too; block scalars, elements and name-value
attributes of configuration files; passwords in URLs.  Values that are names take over what these
stand for in the same or an outer scope (by indentation), the latest before, or else the next.
A literal is reported if a name it reaches is sensitive and the literal looks random enough.  Every
token is passed a bounded number of times.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from dataclasses import dataclass, field
from hashlib import sha256

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import map_texts

KINDS = ("assign", "access", "hex")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
# fixed values: the base patterns
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A | re.I)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
# a match of [0-9a-f]+ is a whole run of such characters
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}+")
ASSIGN_VALUE, ACCESS_LENGTH = 8, 16

TOKEN = re.compile(
    r"""(?P<space>(?:[ \t\r\f\v]|\\\r?\n)++)|(?P<line>\n)|(?P<name>[A-Za-z_$@][\w$]*+(?:[.-][\w$]++)*+)|(?P<number>[0-9][\w]*+(?:[.-][\w]++)*+)"""
    r"""|(?P<quote>"{3}|'{3}|["'`])|(?P<op>=>|:=|[=!<>]=++|->|::|\+=|\|\||\?\?|[\x21-\x7E])|(?P<other>[^\x00-\x7F]++|.)""",
    re.A | re.S,
)
#: What may stand between an opening quote and its end.
INSIDE = {
    '"': re.compile(r'(?:[^"\\\n]|\\.)*+', re.S), "'": re.compile(r"(?:[^'\\\n]|\\.)*+", re.S), "`": re.compile(r"(?:[^`\\\n]|\\.)*+", re.S),
    '"""': re.compile(r'(?:[^"\\]|\\.|"(?!""))*+', re.S), "'''": re.compile(r"(?:[^'\\]|\\.|'(?!''))*+", re.S),
}
PREFIX = re.compile(r"(?:[rbuRBUfFL]|[rR][bB]|[bB][rR])")
#: An unquoted value.
RAW = re.compile(r"""[^\s,;"'`()\[\]{}<>&]++""")
REFERENCE = re.compile(r"\$?\{?([A-Za-z_][\w.]*+)\}?", re.A)
NAME = re.compile(r"[A-Za-z_$@:][\w.$ -]*+", re.A)
ASSIGNS = {"=", ":", ":=", "=>"}
JOINS, DEFAULTS = {"+", ".", "~"}, {"or", "||", "??"}
#: Tokens of a type between a name and "=", as in "name: Map<string, str | None> = ...".
TYPE_OPS = set("|[]<>,.?*&")
#: Names for longer values are not replaced by them, so that sums of sums stay bounded.
LONGEST = 1000
#: Calls whose only literal is a name and no value.
LOOKUP = re.compile(r"env|get|lookup|config|param|fetch|read|load|prompt|input", re.I)
ELEMENT = re.compile(r"<([A-Za-z_][\w.:-]*+)(?:\s[^<>]*+)?>([^<>\n]++)</", re.A)
URL_PASSWORD = re.compile(r"""://[^\s:/@"'<>`]*+:([^\s/@"'<>`]++)@""")
BLOCK = re.compile(r"[|>][+-]?[0-9]?[+-]?[ \t]*+\r?\n")
INDENT = re.compile(r"[ \t]*+")
NAME_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: How telling the words of a name are; the largest counts, and both halves of a compound add up.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "pwd": 1.0, "secret": 1.0, "token": 1.0, "credential": 1.0,
    "credentials": 1.0, "apikey": 1.0, "pass": 0.7, "auth": 0.7, "key": 0.6, "private": 0.4, "access": 0.4, "api": 0.4,
    "signing": 0.4, "encryption": 0.4, "client": 0.2,
}
PLACEHOLDER = re.compile(r"example|changeme|placeholder|your|dummy|sample|todo|xxx|\*\*\*|<|\$\{", re.I)
#: A literal needs this product of name score and literal score, and this many characters.
THRESHOLD, MIN_LITERAL = 0.6, 8

COLUMNS = T.StructType(
    [T.StructField(f"n_{k}", T.LongType(), False) for k in KINDS]
    + [T.StructField("base_sha256", T.StringType(), False), T.StructField("spans", T.StringType(), False), T.StructField("n_lexed", T.LongType(), False)]
)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the fixed patterns, leftmost and non-overlapping per kind."""
    found = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        found += [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_VALUE]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LENGTH]
    found += [(m.start(), m.end(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def name_score(name: str) -> float:
    words = [w.lower() for w in NAME_WORD.findall(name)]
    return min(1.0, sum(sorted((SENSITIVE.get(w, 0.0) for w in words), reverse=True)[:2]))


def literal_score(value: str) -> float:
    """0 to 1: long literals of many different characters score high, placeholders and words 0."""
    if len(value) < MIN_LITERAL or PLACEHOLDER.search(value) or not re.search(r"[^A-Za-z\s]", value):
        return 0.0
    # with blanks, every piece must be no plain word
    pieces = value.split()
    if len(pieces) > 1 and not all(re.search(r"[^A-Za-z.,;:!?'-]|[a-z][A-Z]|[A-Z][A-Z]+[a-z]", x) for x in pieces):
        return 0.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    return min(1.0, n / 12) * min(1.0, bits / 3)


@dataclass
class Value:
    """A folded literal, the spans of its parts, and the name that it stands for if that is all."""

    text: str = ""
    spans: tuple[tuple[int, int], ...] = ()
    name: str | None = None

    def __bool__(self) -> bool:
        return bool(self.spans) or self.name is not None


@dataclass
class Scope:
    indent: int
    outer: Scope | None
    known: dict[str, Value] = field(default_factory=dict)
    later: dict[str, Value] = field(default_factory=dict)

    def find(self, name: str, later: bool = False) -> Value | None:
        scope: Scope | None = self
        while scope is not None:
            if found := (scope.later if later else scope.known).get(name):
                return found
            scope = scope.outer
        return None


class Lexer:
    """Tokens of a text as lists: ``kinds`` ('name', 'number', 'str', 'line', or the operator itself),
    ``starts`` and ``ends`` (of a literal's content), ``tight`` (no blank before the token)."""

    def __init__(self, text: str) -> None:
        self.text = text
        self.kinds: list[str] = []
        self.starts: list[int] = []
        self.ends: list[int] = []
        self.tight: list[bool] = []
        at, n, tight = 0, len(text), False
        open_until = dict.fromkeys(INSIDE, -1)
        while at < n:
            m = TOKEN.match(text, at)
            kind, end = m.lastgroup, m.end()
            if kind == "space":
                at, tight = end, False
                continue
            start = at
            if kind == "quote":
                mark = m[0]
                # an apostrophe within a word begins no literal
                worded = mark == "'" and start and text[start - 1].isalnum() and not self._prefix(start)
                if not worded and start >= open_until[mark]:
                    inner = INSIDE[mark].match(text, end)
                    if text.startswith(mark, inner.end()):
                        if self._prefix(start):
                            for column in (self.kinds, self.starts, self.ends, self.tight):
                                column.pop()
                        self._add("str", end, inner.end(), tight)
                        at, tight = inner.end() + len(mark), True
                        continue
                    # nothing closes this quote up to here, so no later one of its kind opens before
                    open_until[mark] = inner.end()
                kind, end = "op", start + 1
            self._add(text[start:end] if kind == "op" else kind, start, end, tight)
            at, tight = end, True
        self._add("end", n, n, False)
        self.calls = self._calls()
        # the next token from each on that is no part of a type
        self.after_type = [0] * len(self.kinds)
        stop = len(self.kinds) - 1
        for i in range(len(self.kinds) - 1, -1, -1):
            if self.kinds[i] not in TYPE_OPS and self.kinds[i] != "name":
                stop = i
            self.after_type[i] = stop

    def _calls(self) -> dict[int, tuple[int, int, int | None]]:
        """Per closed "(" its ")", the number of arguments, and the last one if that is a literal."""
        out, open_ = {}, []
        for i, kind in enumerate(self.kinds):
            if kind in ("(", "[", "{"):
                open_.append([i, kind, 1, None])
            elif not open_:
                continue
            elif kind in (")", "]", "}"):
                if open_[-1][1] + kind in ("()", "[]", "{}"):
                    begin, _, count, last = open_.pop()
                    if kind == ")":
                        out[begin] = (i, count, last)
            elif kind == ",":
                open_[-1][2] += 1
                open_[-1][3] = None
            elif kind == "str" and self.kinds[i - 1] in ("(", ",", "=", "line"):
                open_[-1][3] = i
        return out

    def _add(self, kind: str, start: int, end: int, tight: bool) -> None:
        self.kinds.append(kind)
        self.starts.append(start)
        self.ends.append(end)
        self.tight.append(tight)

    def _prefix(self, quote: int) -> bool:
        """Whether the token before a quote is a literal's prefix, as in r"..."."""
        return bool(self.kinds) and self.kinds[-1] == "name" and self.ends[-1] == quote and bool(PREFIX.fullmatch(self.text, self.starts[-1], quote))

    def word(self, i: int) -> str:
        return self.text[self.starts[i] : self.ends[i]]

    def skip_lines(self, i: int, inside: bool) -> int:
        while inside and self.kinds[i] == "line":
            i += 1
        return i

    def token_at(self, place: int) -> int:
        return bisect_left(self.starts, place)

    # -------------------------------------------------------------- values

    def value(self, i: int, scope: Scope, inside: bool = False) -> tuple[Value, int]:
        """The value whose first token is ``i``, and the token behind it."""
        out, i = self._term(i, scope, inside)
        parts = [out]
        while True:
            j = self.skip_lines(i, inside)
            kind = self.kinds[j]
            if kind == "name" and self.word(j) in DEFAULTS:
                kind = self.word(j)
            if kind in DEFAULTS:
                other, i = self._term(self.skip_lines(j + 1, inside), scope, inside)
                parts = [other] if other.spans else parts
                continue
            if kind in JOINS and parts[0]:
                # an operator at the end of a line goes on in the next
                j = self.skip_lines(j + 1, True)
                if self.kinds[j] not in ("str", "name", "("):
                    break
            elif not (kind == "str" and parts[0].spans and self.kinds[j - 1] in ("str", "line")):
                break
            more, i = self._term(j, scope, inside)
            parts.append(more)
        if len(parts) == 1:
            return parts[0], i
        return Value("".join(x.text for x in parts), tuple(span for x in parts for span in x.spans)), i

    def _term(self, i: int, scope: Scope, inside: bool) -> tuple[Value, int]:
        kind = self.kinds[i]
        if kind == "str":
            content = self.word(i)
            plain = re.sub(r"\\(.)", r"\1", content, flags=re.S) if "\\" in content else content
            return Value(plain, ((self.starts[i], self.ends[i]),)), i + 1
        if kind == "(":
            if self.depth > 50:
                return Value(), i + 1
            self.depth += 1
            out, i = self.value(self.skip_lines(i + 1, True), scope, True)
            self.depth -= 1
            i = self.skip_lines(i, True)
            return out, i + (self.kinds[i] == ")")
        if kind in ("line", "end"):
            return Value(), i
        raw = RAW.match(self.text, self.starts[i])
        if raw is None:
            return Value(), i
        end = raw.end()
        follows = self.text[end : end + 1]
        if kind == "name" and follows == "(" and end == self.ends[i]:
            return self._call(i, scope)
        if kind == "name" and follows == "[":
            return Value(), self.token_at(end)
        word = raw[0]
        if word[-1] in "+." and follows and follows in "\"'`" and len(word) > 1 and REFERENCE.fullmatch(word[:-1]):
            word, end = word[:-1], end - 1
        if follows == "{" and word == "$":
            close = self.text.find("}", end, end + 200)
            word, end = (self.text[self.starts[i] : close + 1], close + 1) if close > 0 else (word, end)
        if ref := REFERENCE.fullmatch(word):
            if (found := scope.find(ref[1])) and len(found.text) <= LONGEST:
                return found, self.token_at(end)
            return Value(word, ((self.starts[i], end),), ref[1]), self.token_at(end)
        return Value(word, ((self.starts[i], end),)), self.token_at(end)

    #: Brackets that a value is in; where no chain begins before.
    depth, no_chain = 0, 0

    def _call(self, i: int, scope: Scope) -> tuple[Value, int]:
        """A call's value: its last argument if that is a literal, as a default or what is wrapped.

        The only literal of a call that looks something up is a name.
        """
        if i + 1 not in self.calls:
            return Value(), i + 1
        close, count, last = self.calls[i + 1]
        if last is None or (count == 1 and LOOKUP.search(self.word(i))):
            return Value(), close + 1
        return Value(self.word(last), ((self.starts[last], self.ends[last]),)), close + 1

    # -------------------------------------------------------------- targets

    def target_before(self, i: int) -> tuple[str | None, int]:
        """The name that ends before token ``i``, and its first token."""
        j = i - 1
        if j >= 0 and self.kinds[j] == "]" and j >= 2 and self.kinds[j - 1] == "str" and self.kinds[j - 2] == "[":
            first = j - 3 if j >= 3 and self.kinds[j - 3] == "name" else j - 2
            return self.word(j - 1), first
        if j >= 0 and self.kinds[j] in ("name", "str") and NAME.fullmatch(self.word(j)):
            return self.word(j), j
        return None, i

    def target_at(self, i: int) -> tuple[str | None, int]:
        """The target that begins at token ``i`` with "=" behind it, and the token behind that."""
        if self.kinds[i] != "name":
            return None, i
        name, j = self.word(i), i + 1
        if self.kinds[j] == "[" and self.kinds[j + 1] == "str" and self.kinds[j + 2] == "]":
            name, j = self.word(j + 1), j + 3
        return (name, j + 1) if self.kinds[j] == "=" else (None, i)

    def chain(self, i: int) -> tuple[list[str], int]:
        """Further targets from token ``i`` on, and the value's token.

        Without blanks before "=" they are targets only if a quoted literal ends the chain.
        """
        names, at, loose = [], i, i
        if i < self.no_chain:
            return names, at
        while (found := self.target_at(at))[0] is not None:
            names.append(found[0])
            if not self.tight[found[1] - 1]:
                loose = found[1]
            at = found[1]
        if self.kinds[at] == "str":
            return names, at
        # the tight ones at the end belong to the value, and none of them begins a chain
        self.no_chain = at
        kept, at = [], i
        while at < loose:
            name, at = self.target_at(at)
            kept.append(name)
        return kept, loose


def _block(text: str, at: int) -> tuple[Value, int]:
    """The indented lines below the line that ends with a block mark at ``at``, and their end."""
    begin = text.rfind("\n", 0, at) + 1
    indent = INDENT.match(text, begin).end() - begin
    m = BLOCK.match(text, at)
    out, at = Value(), m.end()
    while at < len(text):
        first = INDENT.match(text, at).end()
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        if first < end:
            if first - at <= indent:
                break
            last = first + len(text[first:end].rstrip())
            out = Value(out.text + text[first:last], (*out.spans, (first, last)))
        at = end + 1
    return out, min(at, len(text))


def pairs(text: str) -> list[tuple[str, str, tuple[tuple[int, int], ...]]]:
    """(name, literal value, spans of its parts) of every assignment, constants propagated."""
    lexer = Lexer(text)
    kinds = lexer.kinds
    scope = Scope(0, None)
    found: list[tuple[str, Value, Scope]] = []
    i, block_end, line_start, called = 0, 0, True, None

    def define(name: str, value: Value) -> None:
        name = name.strip().lstrip(":@$")
        found.append((name, value, scope))
        scope.known[name] = value

    while kinds[i] != "end":
        if line_start and kinds[i] != "line":
            begin = text.rfind("\n", 0, lexer.starts[i]) + 1
            indent = lexer.starts[i] - begin if not text[begin : lexer.starts[i]].strip() else 0
            while scope.outer is not None and scope.indent > indent:
                scope = scope.outer
            if scope.indent < indent:
                scope = Scope(indent, scope)
        line_start = kinds[i] == "line"
        op = kinds[i]
        if op not in ASSIGNS:
            i += 1
            continue
        # a tuple of targets may stand in brackets
        name, first = lexer.target_before(i - (op == "=" and i > 0 and kinds[i - 1] == ")"))
        if name is None:
            i += 1
            continue
        at = i + 1
        typed = op == ":" and kinds[at] == "name" and kinds[lexer.after_type[at]] == "="
        if typed:
            at = lexer.after_type[at] + 1
        if op == ":" and kinds[at] in "|>" and lexer.starts[at] >= block_end and BLOCK.match(text, lexer.starts[at]):
            value, block_end = _block(text, lexer.starts[at])
            if value:
                define(name, value)
            i = at + 1
            continue
        if op == ":" and kinds[at] in (":", "/") and lexer.tight[at]:
            i += 1
            continue
        names = [name]
        if op in ("=", ":="):
            while first >= 2 and kinds[first - 1] == "," and kinds[first - 2] in ("name", "]"):
                before, first = lexer.target_before(first - 1)
                if before is None:
                    break
                names.append(before)
        more, at = lexer.chain(at) if op == "=" or typed else ([], at)
        inside = kinds[at] == "(" and len(names) > 1
        value, end = lexer.value(at + inside, scope, inside)
        values = [value]
        while len(values) < len(names) and kinds[end] == ",":
            value, end = lexer.value(lexer.skip_lines(end + 1, inside), scope, inside)
            values.append(value)
        if len(names) == len(values) > 1:
            for target, part in zip(reversed(names), values):
                if part:
                    define(target, part)
        elif values[0]:
            for target in [name, *more]:
                define(target, values[0])
            # what a pair called "name" holds names the pair called "value" that follows
            if name.lower() == "value" and called:
                define(called, values[0])
            called = values[0].text if name.lower() in ("name", "key") and NAME.fullmatch(values[0].text) else None
        # tokens of the value may hold assignments of their own, but not those of an unquoted one
        i = max(at, end) if kinds[at] in ("name", "number") and kinds[at + 1 : at + 2] != ["("] else max(at, i + 1)

    # names used before they have a value take the next one, from the last pair backwards
    out = []
    for name, value, scope in reversed(found):
        if value.name is not None and (later := scope.find(value.name, later=True)):
            value = later
        scope.later[name] = value
        out.append((name, value.text, value.spans))
    out.reverse()
    out += [(m[1], m[2].strip(), (_stripped(text, m.start(2), m.end(2)),)) for m in ELEMENT.finditer(text)]
    out += [("url password", m[1], (m.span(1),)) for m in URL_PASSWORD.finditer(text)]
    return out


def _stripped(text: str, a: int, b: int) -> tuple[int, int]:
    body = text[a:b]
    return a + len(body) - len(body.lstrip()), a + len(body.rstrip())


def lexed_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Literals that reach a sensitive name and do not touch a base span."""
    if not any(c in text for c in "=:<"):
        return []
    hits = set()
    for name, value, spans in pairs(text):
        score = name_score(name)
        if score and score * literal_score(value) >= THRESHOLD:
            hits.update(s for s in spans if s[1] > s[0])
    return [(a, b, "lexed") for a, b in sorted(hits) if not any(a < y and x < b for x, y, _ in base)]


def scan(texts: list[str]) -> dict:
    made: dict[str, list] = {f.name: [] for f in COLUMNS}
    order = {k: i for i, k in enumerate((*KINDS, "lexed"))}
    for text in texts:
        base = base_spans(text)
        lexed = lexed_spans(text, base)
        everything = sorted([*base, *lexed], key=lambda s: (s[0], order[s[2]], s[1]))
        counts = Counter(k for _, _, k in base)
        for kind in KINDS:
            made[f"n_{kind}"].append(counts[kind])
        made["base_sha256"].append(sha256(joined(base).encode()).hexdigest())
        made["spans"].append(joined(everything))
        made["n_lexed"].append(len(lexed))
    return made


def joined(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for a, b, k in spans)


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts, digest and spans (code points, end exclusive) per row of ``docs``.

    Base spans always stay; ``lexed`` spans are those that only the lexer finds.  A null text is
    empty and has none; repeated rows and null ids give a row each; an empty table gives no rows.
    Other columns are not read, whatever their names.  Texts are read whole, in time and memory in
    proportion to their length.
    """
    return map_texts(docs, [doc_id], text, COLUMNS, lambda: scan)
