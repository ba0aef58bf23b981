"""Secrets by assignment-aware lexing.

Around every assignment sign of a text a small lexer reads the target name on
the left and an expression on the right: quoted literals, names, calls and bare
values, joined by plus signs or blanks between quotes.  Lists of literals, block
values of indented lines, XML attributes and elements, setters and pairs of
arguments give names their literals, too.  Constants propagate: a name
stands for the last expression assigned to it before, or else the first one
after, and passes on all literals that can be reached so, over any number of
names.  A literal counts as a secret if the sensitivity of the name that it
reaches and the shape of all that reaches it score THRESHOLD or more; its span
is that of the literal, however short.  Three base patterns are searched
besides: assign, access and hex.

Names, expressions and chains of names may be of any length: what an expression
amounts to is summed up once, names that define each other together, and
what an accepted one reaches is marked once.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kalibra.llm.shared import table

THRESHOLD = 1.0
KINDS = ("assign", "access", "hex", "lexed")

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Words that a text with an assign match holds, lower-cased.
MARKS = ("passw", "secret", "token", "apikey", "api_key")

#: Texts of up to BRIEF characters are compared with placeholders; counts are kept of up to WIDE different ones.
BRIEF, WIDE = 64, 256
#: Small letters, capitals, digits, and all that no name has.
TESTS = tuple(re.compile(t, re.A).match for t in ("[a-z]", "[A-Z]", r"[0-9]", r"[^\w]"))

#: Sensitivity of the parts of a name.
SENSITIVE = {
    "password": 1.0, "passwd": 1.0, "passphrase": 1.0, "passcode": 0.9, "pwd": 0.9, "pass": 0.7, "secret": 1.0, "token": 0.9,
    "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "bearer": 0.8, "authorization": 0.8, "auth": 0.6, "signature": 0.5,
    "salt": 0.5, "pin": 0.5, "jwt": 0.9, "dsn": 0.6, "webhook": 0.5,
}
#: Sensitivity of "key" after another part.
KEYS = {"api": 1.0, "access": 0.9, "private": 1.0, "secret": 1.0, "encryption": 1.0, "signing": 0.9, "master": 0.9, "account": 0.8, "auth": 0.9, "client": 0.8, "service": 0.7}
#: Literals that stand for a secret without being one.
PLACEHOLDERS = {"changeme", "placeholder", "example", "password", "secret", "token", "undefined", "default", "required", "redacted", "string"}

#: A name, what may stand between it and its sign, and the sign.  Runs of names begin where no other does, so each is read once.
TARGET = re.compile(r"(?<![\w.$-])[\d.-]*+(?P<name>[A-Za-z_$][\w.$-]*+)[\"'`\])]*+[ \t]*+(?P<sign>:=|=>|[:=])(?![=:]|//)", re.A)
#: A bare value ends before the next sign, but for a URL's own and the padding at its end.
TERM = re.compile(
    r"""[ \t]*+(?:(?:[rbfuL]{0,2})(?P<quoted>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`[^`\n]*`)|\$?\{?(?P<name>[A-Za-z_$][\w.$]*)\}?(?![\w+/=-]|://)|(?P<bare>(?:[^\s"'`,;(){}\[\]<>=:]|://(?:[^\s"'`,;(){}\[\]<>=:/@]*+:[^\s"'`,;(){}\[\]<>=:/@]*+@)?)++(?:={1,2}(?![^\s"'`,;(){}\[\]<>]))?))""", re.A
)
PLUS = re.compile(r"[ \t]*+[+.][ \t]*+(?=[\"'`$A-Za-z_])")
QUOTE = re.compile(r"[ \t]*+[\"']")
BRACKET = re.compile(r"""\"(?:[^\"\\\n]|\\.)*+\"|'(?:[^'\\\n]|\\.)*+'|[()\[\]]""")
LIST = re.compile(r"\s*+\[")
ITEM = re.compile(r"""\s*+(?P<quoted>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*')\s*+(?:,|(?=\]))""")
BLOCK = re.compile(r"[ \t]*+[|>][-+]?\d?[ \t]*+\n")
INDENT = re.compile(r"[ \t]*+")
#: A call with a literal, and two literals as arguments, a name and a value.
SETTER = re.compile(r"(?<![\w$-])(?P<name>[A-Za-z_$][\w$]*+)\([ \t]*+(?=[\"'`])", re.A)
SETTING = {"set", "with", "add", "put", "use", "update", "configure", "init"}
ARGUMENTS = re.compile(r"""\([ \t]*+["'](?P<name>[A-Za-z_][\w.-]*+)["'][ \t]*+,[ \t]*+(?=["'])""", re.A)
ATTRIBUTES = re.compile(r"""(?<![\w.-])(?:key|name|id)[ \t]*+=[ \t]*+["'](?P<name>[^"'\n<>]*+)["']\s++value[ \t]*+=[ \t]*+["'](?P<value>[^"'\n<>]*+)["']""", re.I | re.A)
ELEMENT = re.compile(r"<(?P<name>[A-Za-z_][\w.:-]*+)>[ \t]*+(?P<value>[^<>\s][^<>\n]*+)</(?P=name)>", re.A)
PARTS = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+", re.A)


def sensitivity(name: str) -> float:
    parts = [p.lower() for p in PARTS.findall(name)]
    best = max((SENSITIVE.get(p, SENSITIVE.get(p.rstrip("s"), 0.0)) for p in parts), default=0.0)
    for a, b in zip(parts, parts[1:]):
        if b in ("key", "keys"):
            best = max(best, KEYS.get(a, 0.0))
        best = max(best, SENSITIVE.get(a + b, 0.0))
    return best


class Value:
    """What a shape depends on of a concatenation: its length, characters, words, first character and, where it is short, text."""

    __slots__ = ("length", "counts", "kinds", "words", "edges", "spaced", "first", "text", "parts")

    def __init__(self, text: str = ""):
        self.length, self.text, self.parts, self.first = len(text), text, int(bool(text)), text[:1]
        self.counts: Counter | None = Counter(text)
        self.kinds = tuple(any(map(test, self.counts)) for test in TESTS)
        self.words, self.spaced = len(text.split()), " " in text
        self.edges = (text[:1].isspace(), text[-1:].isspace())
        self.narrow()

    def narrow(self) -> None:
        if self.counts is not None and len(self.counts) > WIDE:
            self.counts = None
        if self.text is not None and len(self.text) > BRIEF:
            self.text = None

    def __add__(self, other: Value) -> Value:
        if not self.length or not other.length:
            return self if self.length else other
        out = Value.__new__(Value)
        out.length, out.parts, out.first = self.length + other.length, self.parts + other.parts, self.first
        out.text = self.text + other.text if self.text is not None and other.text is not None else None
        out.counts = self.counts + other.counts if self.counts is not None and other.counts is not None else None
        out.kinds = tuple(map(any, zip(self.kinds, other.kinds)))
        joined = self.words and other.words and not self.edges[1] and not other.edges[0]
        out.words, out.spaced, out.edges = self.words + other.words - bool(joined), self.spaced or other.spaced, (self.edges[0], other.edges[1])
        out.narrow()
        return out

    def plain_word(self) -> bool:
        """One literal of small letters alone."""
        return self.parts == 1 and self.kinds[0] and not any(self.kinds[1:])

    def shape(self) -> float:
        """From -1, no secret, to 1: length, kinds of characters and entropy; more than WIDE different characters count as 8 bits."""
        n = self.length
        if n < 6 or (self.text or "").lower() in PLACEHOLDERS or self.first in "<{$%" or self.spaced and self.words > 4:
            return -1.0
        if self.counts is not None and len(self.counts) < 4:
            return -1.0
        entropy = 8.0 if self.counts is None else -sum(c / n * math.log2(c / n) for c in self.counts.values())
        return min(1.0, 0.1 * (entropy - 2) + 0.15 * (sum(self.kinds) - 1) + (0.2 if n >= 16 else 0.0) + 0.1)


Term = tuple[str, int, int]  # literal, item, name, call or bare, and its span


def closing(text: str) -> dict[int, int]:
    """The places of brackets that open, outside of quotes on one line, with those that close them."""
    out, stack = {}, []
    for m in BRACKET.finditer(text):
        if m[0] in ("(", "["):
            stack.append(m.start())
        elif m[0] in (")", "]") and stack:
            out[stack.pop()] = m.start()
    return out


def block(text: str, at: int) -> tuple[list[Term], int]:
    """The lines indented deeper than the one that a block sign ends, as literals, and where they end."""
    line = text.rfind("\n", 0, at) + 1
    depth = INDENT.match(text, line).end() - line
    at, out = text.find("\n", at) + 1, []
    while 0 < at < len(text):
        end = text.find("\n", at)
        end = len(text) if end < 0 else end
        own = INDENT.match(text, at).end()
        if own < end and own - at <= depth:
            break
        if own < end:
            out.append(("literal", own, own + len(text[own:end].rstrip())))
        at = end + 1
    return out, at


def expression(text: str, at: int, closes: Callable[[], dict[int, int]]) -> list[Term]:
    terms = []
    while t := TERM.match(text, at):
        at = t.end()
        if t["quoted"] is not None:
            terms.append(("literal", t.start("quoted") + 1, t.end("quoted") - 1))
        elif t["name"] is not None:
            called = text[t.end("name") : t.end("name") + 1] in ("(", "[")
            terms.append(("call" if called else "name", *t.span("name")))
            if called:  # what it is called with has no part in the value
                end = closes().get(t.end("name"))
                if end is None:
                    break
                at = end + 1
        else:
            terms.append(("bare", *t.span("bare")))
        if plus := PLUS.match(text, at):
            at = plus.end()
        elif t["quoted"] is None or not QUOTE.match(text, at):
            break
    return terms


def assignments(text: str) -> list[tuple[str, list[Term]]]:
    """(name, terms) in order."""
    out: list[tuple[int, str, list[Term]]] = []
    known: list[dict[int, int]] = []

    def closes() -> dict[int, int]:
        if not known:
            known.append(closing(text))
        return known[0]

    until = 0
    for m in TARGET.finditer(text):
        terms = expression(text, m.end(), closes)
        if not terms and (opened := LIST.match(text, m.end())):
            at = opened.end()
            while item := ITEM.match(text, at):
                terms.append(("item", item.start("quoted") + 1, item.end("quoted") - 1))
                at = item.end()
        elif m["sign"] == ":" and m.start() >= until and BLOCK.match(text, m.end()):
            terms, until = block(text, m.end())
        if terms:
            out.append((m.start(), m["name"], terms))
    if "(" in text:
        for m in SETTER.finditer(text):
            parts = [p.lower() for p in PARTS.findall(m["name"])]
            if parts[0] in SETTING and all(p in SETTING or p == "key" or sensitivity(p) > 0 or p in KEYS for p in parts) and (terms := expression(text, m.end(), closes)):
                out.append((m.start(), m["name"], terms[:1]))
        for m in ARGUMENTS.finditer(text):
            if terms := expression(text, m.end(), closes):
                out.append((m.start(), m["name"], terms[:1]))
    if "<" in text:
        for form in (ATTRIBUTES, ELEMENT):
            out += [(m.start(), m["name"], [("literal", *m.span("value"))]) for m in form.finditer(text)]
    return [(name, terms) for _, name, terms in sorted(out, key=lambda x: x[0])]


def meant(known: list[int], i: int) -> int:
    """Of the assignments of a name that assignment i uses: the last before it, else the first after it, or i itself if there is no other."""
    k = bisect_left(known, i)
    return known[k - 1] if k else next((j for j in known[:2] if j != i), i)


class Program:
    """The assignments of a text, and what each amounts to."""

    def __init__(self, text: str):
        self.text, self.pairs = text, assignments(text)
        self.at: dict[str, list[int]] = {}
        for i, (name, _) in enumerate(self.pairs):
            self.at.setdefault(name, []).append(i)
        self.values: dict[int, Value] = {}
        self.marked: set[int] = set()
        self.found: set[tuple[int, int]] = set()

    def uses(self, i: int) -> Iterator[tuple[str, int, int, int]]:
        """(what, start, end, assignment or -1) of the literals and the names that assignment i takes others' values of.

        A name without an assignment is a bare value where it stands alone.
        """
        terms = self.pairs[i][1]
        for what, a, b in terms:
            if what != "name":
                if what != "call":
                    yield "literal", a, b, -1
            elif known := self.at.get(self.text[a:b]):
                if (to := meant(known, i)) != i:
                    yield "name", a, b, to
            elif len(terms) == 1:
                yield "literal", a, b, -1

    def value(self, first: int) -> Value:
        """What assignment first amounts to; those that define each other have one value, as in Tarjan's order of strong components."""
        if first in self.values:
            return self.values[first]
        order: dict[int, int] = {first: 0}
        low, path, open_ = {first: 0}, [(first, self.uses(first))], [first]
        while path:
            i, terms = path[-1]
            term = next(terms, None)
            if term is not None:
                to = term[3]
                if to >= 0 and to not in self.values:
                    if to in order:
                        low[i] = min(low[i], order[to])
                    else:
                        order[to] = low[to] = len(order)
                        path.append((to, self.uses(to)))
                        open_.append(to)
                continue
            path.pop()
            if path:
                low[path[-1][0]] = min(low[path[-1][0]], low[i])
            if low[i] == order[i]:
                group = set()
                while i not in group:
                    group.add(open_.pop())
                whole = Value()
                for k in sorted(group):
                    for _, a, b, to in self.uses(k):
                        if to not in group:
                            whole = whole + (self.values[to] if to >= 0 else Value(self.text[a:b]))
                for k in group:
                    self.values[k] = whole
        return self.values[first]

    def mark(self, first: int) -> None:
        """All literals that assignment first reaches are found."""
        stack = [first]
        while stack:
            i = stack.pop()
            if i not in self.marked:
                self.marked.add(i)
                for _, a, b, to in self.uses(i):
                    if to >= 0:
                        stack.append(to)
                    elif b > a:
                        self.found.add((a, b))


def lexed(text: str) -> list[tuple[int, int]]:
    """The spans of the literals that reach a sensitive name."""
    if not any(x in text for x in ":=(<"):
        return []
    program = Program(text)
    weights = {name: sensitivity(name) for name in program.at}
    for i, (name, terms) in enumerate(program.pairs):
        if weights[name] <= 0:
            continue
        if terms[0][0] == "item":  # each by itself
            program.found |= {(a, b) for _, a, b in terms if weights[name] + Value(text[a:b]).shape() >= THRESHOLD}
            continue
        own = program.at.get(text[terms[0][1] : terms[0][2]]) if len(terms) == 1 and terms[0][0] == "name" else None
        to = meant(own, i) if own else i  # what only names another reaches what that one does
        if own and to == i:
            continue
        whole = program.value(to)
        quoted = own is not None or any(t[0] == "literal" for t in terms)
        if whole.length and (quoted or not whole.plain_word()) and weights[name] + whole.shape() >= THRESHOLD:
            program.mark(to)
    return sorted(program.found)


def base(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, end) of the base patterns, in order."""
    out = []
    low = text.lower()
    if any(m in low for m in MARKS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def scanned(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_assign, n_access, n_hex, base_sha256, spans): a row per row of docs.

    The counts and the digest are of the base patterns' spans, each that of its
    whole match in code points; spans also has those of the lexer, kind lexed.
    Null and empty texts have none; texts of any length are read whole; repeated
    rows get their row each; clashing columns play no part; an empty table gives
    no rows.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for x in b.column(1):
                x = x.as_py() or ""
                own = base(x)
                every = sorted(own + [(s, 3, e) for s, e in lexed(x)])
                n = Counter(k for _, k, _ in own)
                rows.append((n[0], n[1], n[2], hashlib.sha256(joined(own).encode()).hexdigest(), joined(every)))
            cols = list(zip(*rows)) or [()] * 5
            kinds = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [b.column(0), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=[key, "n_assign", "n_access", "n_hex", "base_sha256", "spans"]
            )

    return docs.select(F.col(key), F.col(text).cast("string")).mapInArrow(
        run, f"`{key}` {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"
    )


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(table(spark, sf_dir, "documents"))
