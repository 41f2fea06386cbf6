"""The full-text query language, compiled to column expressions.

Grammar, loosest first: OR, AND, NOT (binary), terms next to each other (a tighter AND),
then ``column: ...``, ``{a b}: ...``, ``- column: ...``, ``NEAR(a b, n)``, phrases in
quotes, ``a + b`` (one phrase), ``^a`` (first token of the column), ``a*`` (prefix) and
parentheses.  The operators are upper case.  The parser runs on the driver; its result is
one boolean expression over analysed columns (see :mod:`lectern.functions.text`), in which
a phrase has to stand within one column while different terms may match different ones.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.names import fold_text
from lectern.functions.porter import stem
from lectern.functions.text import tokens_of

OPERATORS = ("AND", "OR", "NOT", "NEAR")
NEAR_DEFAULT = 10
#: Searchable columns: the name in queries and the analysed column it stands for.
COLUMNS = {"title": "title_norm", "authors": "authors_norm", "abstract": "abstract_norm", "category": "category_norm"}
#: Other names a query may use for them.
COLUMN_NAMES = {**{c: c for c in COLUMNS}, "authors_fold": "authors"}
SCOPES = {"all": tuple(COLUMNS), "title": ("title", "authors")}


class QueryError(ValueError):
    """A query that cannot be read."""


@dataclass(frozen=True)
class Phrase:
    text: str
    prefix: bool = False
    initial: bool = False


@dataclass(frozen=True)
class Near:
    phrases: tuple[Phrase, ...]
    distance: int = NEAR_DEFAULT


@dataclass(frozen=True)
class Within:
    """An expression restricted to columns, or, negated, to all others."""

    columns: tuple[str, ...]
    negated: bool
    inner: "Node"


@dataclass(frozen=True)
class Both:
    left: "Node"
    right: "Node"


@dataclass(frozen=True)
class Either:
    left: "Node"
    right: "Node"


@dataclass(frozen=True)
class Without:
    left: "Node"
    right: "Node"


Node = Phrase | Near | Within | Both | Either | Without


# -- reading ---------------------------------------------------------------------------


@dataclass(frozen=True)
class _Token:
    kind: str  # word, string, a symbol, end
    text: str


def _bare(c: str) -> bool:
    return c == "_" or not c.isascii() or c.isalnum()


def _lex(query: str) -> list[_Token]:
    out, i = [], 0
    while i < len(query):
        c = query[i]
        if c in " \t\r\n":
            i += 1
        elif c == '"':
            end, text = i + 1, []
            while True:
                stop = query.find('"', end)
                if stop < 0:
                    raise QueryError("a quotation mark is not closed")
                text.append(query[end:stop])
                if query[stop + 1 : stop + 2] != '"':
                    break
                text.append('"')
                end = stop + 2
            out.append(_Token("string", "".join(text)))
            i = stop + 1
        elif _bare(c):
            end = i
            while end < len(query) and _bare(query[end]):
                end += 1
            out.append(_Token("word", query[i:end]))
            i = end
        elif c in "(){}:,+*-^":
            out.append(_Token(c, c))
            i += 1
        else:
            raise QueryError(f"{c!r} has no meaning in a query")
    return [*out, _Token("end", "")]


class _Parser:
    def __init__(self, query: str, strict: bool = False) -> None:
        self.tokens, self.at, self.strict = _lex(query), 0, strict

    def peek(self, ahead: int = 0) -> _Token:
        return self.tokens[min(self.at + ahead, len(self.tokens) - 1)]

    def take(self, kind: str | None = None) -> _Token:
        token = self.peek()
        if kind and token.kind != kind:
            raise QueryError(f"expected {kind}, found {token.text or 'the end'}")
        self.at += 1
        return token

    def operator(self, name: str) -> bool:
        token = self.peek()
        return token.kind == "word" and token.text == name

    def parse(self) -> Node:
        node = self.either()
        if self.peek().kind != "end":
            raise QueryError(f"{self.peek().text!r} is out of place")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.operator("OR"):
            self.take()
            node = Either(node, self.both())
        return node

    def both(self) -> Node:
        node = self.without()
        while self.operator("AND"):
            self.take()
            node = Both(node, self.without())
        return node

    def without(self) -> Node:
        node = self.row()
        while self.operator("NOT"):
            self.take()
            node = Without(node, self.row())
        return node

    def starts_term(self) -> bool:
        token = self.peek()
        if token.kind == "word":
            return token.text not in ("AND", "OR", "NOT")
        return token.kind in ("string", "(", "{", "-", "^")

    def row(self) -> Node:
        if not self.starts_term():
            raise QueryError(f"a term is missing before {self.peek().text or 'the end'}")
        grouped = self.peek().kind == "("
        node = self.term()
        while self.starts_term():
            # groups take an operator in the strict grammar
            if self.strict and (grouped or self.peek().kind == "("):
                raise QueryError("a group needs an operator beside it")
            node = Both(node, self.term())
        return node

    def columns(self) -> tuple[tuple[str, ...], bool] | None:
        """A column filter, if one stands here."""
        start, negated = self.at, False
        if self.peek().kind == "-":
            self.take()
            negated = True
        names: list[str] = []
        if self.peek().kind == "{":
            self.take()
            while self.peek().kind in ("word", "string"):
                names.append(self.take().text)
            self.take("}")
        elif self.peek().kind in ("word", "string") and self.peek(1).kind == ":":
            names.append(self.take().text)
        if not names or self.peek().kind != ":":
            if negated or names:
                raise QueryError("a column filter needs a colon")
            self.at = start
            return None
        self.take(":")
        unknown = [n for n in names if n.lower() not in COLUMN_NAMES]
        if unknown:
            raise QueryError(f"no column is called {unknown[0]}")
        return tuple(COLUMN_NAMES[n.lower()] for n in names), negated

    def term(self) -> Node:
        if (found := self.columns()) is not None:
            columns, negated = found
            if self.peek().kind == "(":
                self.take()
                inner = self.either()
                self.take(")")
            else:
                inner = self.set()
            return Within(columns, negated, inner)
        if self.peek().kind == "(":
            self.take()
            inner = self.either()
            self.take(")")
            return inner
        return self.set()

    def set(self) -> Node:
        if self.operator("NEAR") and self.peek(1).kind == "(":
            self.take()
            self.take("(")
            phrases = []
            while self.peek().kind in ("word", "string", "^"):
                phrases.append(self.phrase())
            distance = NEAR_DEFAULT
            if self.peek().kind == ",":
                self.take()
                number = self.take("word").text
                if not number.isdigit():
                    raise QueryError("the distance of NEAR is no number")
                distance = int(number)
            self.take(")")
            if not phrases:
                raise QueryError("NEAR needs phrases")
            return Near(tuple(phrases), distance)
        return self.phrase()

    def phrase(self) -> Phrase:
        initial = False
        if self.peek().kind == "^":
            self.take()
            initial = True
        if self.peek().kind not in ("word", "string") or (self.peek().kind == "word" and self.peek().text in ("AND", "OR", "NOT")):
            raise QueryError("a term is missing")
        parts = [self.take().text]
        while self.peek().kind == "+":
            self.take()
            if self.peek().kind not in ("word", "string"):
                raise QueryError("a term is missing after +")
            parts.append(self.take().text)
        prefix = False
        if self.peek().kind == "*":
            self.take()
            prefix = True
        return Phrase(" ".join(parts), prefix, initial)


def parse(query: str, strict: bool = False) -> Node:
    """The tree of a query; raises :class:`QueryError`.  In the strict grammar groups in
    parentheses stand next to others only with an operator between."""
    return _Parser(query, strict).parse()


# -- preparing what a user typed -------------------------------------------------------


def split_tokens(query: str) -> list[str]:
    """White-space separated tokens; quoted phrases stay whole, quotes kept."""
    out, current, quoted = [], "", False
    for c in query:
        if c == '"':
            quoted = not quoted
        if c.isspace() and not quoted:
            if current:
                out.append(current)
            current = ""
        else:
            current += c
    return [*out, current] if current else out


def add_prefix(token: str) -> str:
    """The token as a prefix search, where that makes sense: operators in any case, what
    has a star, column or group syntax, and single characters stay as they are."""
    if token.upper() in OPERATORS or token.endswith("*") or any(c in token for c in ":(){}") or token[:1] in ("-", "^"):
        return token
    if len(token.strip('"')) < 2:
        return token
    return token + "*"


def _hyphenated(token: str) -> str:
    """A word with hyphens or the like inside is the phrase of its parts."""
    body, star = (token[:-1], "*") if token.endswith("*") else (token, "")
    if '"' in body or not body or body[:1] in "-^" or any(c in body for c in ":(){}+,"):
        return token
    return f'"{body}"{star}' if not all(_bare(c) for c in body) and any(_bare(c) for c in body) else token


def quoted(query: str, operators: bool = True) -> str:
    """The second reading of a query that has no first one: every token a quoted term.
    Operators keep their meaning, unless ``operators`` is False: then they are words."""
    out = []
    for token in split_tokens(query):
        if operators and token in ("AND", "OR", "NOT"):
            out.append(token)
            continue
        bare = token.replace('"', "")
        if bare:
            out.append(f'"{bare}"*' if len(bare) >= 2 else f'"{bare}"')
    while out and out[0] in ("AND", "OR", "NOT"):
        out.pop(0)
    while out and out[-1] in ("AND", "OR", "NOT"):
        out.pop()
    return " ".join(out)


def read(query: str, prefix: bool = True, compat: bool = False) -> Node | None:
    """The tree of what a user typed; None for a query without terms.

    ``prefix`` turns plain terms and phrases into prefix searches.  A query that cannot
    be read is read once more with its tokens quoted; ``compat`` makes that reading take
    operators literally, and leaves hyphenated words to it."""
    if not query.strip():
        return None
    tokens = split_tokens(query)
    if not compat:
        tokens = [_hyphenated(t) for t in tokens]
    text = " ".join(map(add_prefix, tokens)) if prefix else " ".join(tokens)
    try:
        return parse(text, strict=compat)
    except QueryError:
        second = quoted(query, operators=not compat)
        if not second:
            raise QueryError("could not read the query") from None
        try:
            return parse(second)
        except QueryError:
            return parse(quoted(query, operators=False))


# -- compiling -------------------------------------------------------------------------


@dataclass(frozen=True)
class Analysis:
    """How the columns were analysed."""

    stemmed: bool = True
    columns: tuple[tuple[str, str], ...] = tuple(COLUMNS.items())

    def terms(self, text: str) -> list[str]:
        return [stem(t) if self.stemmed else t for t in tokens_of(text)]

    def variants(self, phrase: Phrase, column: str) -> list[list[str]]:
        """The token lists a phrase may have in a column.  Bylines are indexed folded,
        so there the folded phrase counts too."""
        out = [self.terms(phrase.text)]
        if column == "authors" and (folded := self.terms(fold_text(phrase.text))) not in out:
            out.append(folded)
        return [x for x in out if x]


def _phrase_in(column: Column, terms: list[str], phrase: Phrase) -> Column:
    text = " " + " ".join(terms) + ("" if phrase.prefix else " ")
    return F.startswith(column, F.lit(text)) if phrase.initial else F.contains(column, F.lit(text))


def _positions(column: Column, terms: list[str], phrase: Phrase) -> Column:
    """struct(start, size) of every occurrence in the column's tokens."""
    n = len(terms)

    def all_of(words: Column) -> Column:
        def here(i: Column) -> Column:
            tests = [F.get(words, i + k) == t for k, t in enumerate(terms)]
            if phrase.prefix:
                tests[-1] = F.startswith(F.get(words, i + (n - 1)), F.lit(terms[-1]))
            found = F.coalesce(reduce(lambda a, b: a & b, tests), F.lit(False))
            return found & (i == 0) if phrase.initial else found

        return F.transform(F.filter(F.sequence(F.lit(0), F.size(words) - 1), here), lambda i: F.struct(i.alias("s"), F.lit(n).alias("n")))

    return _bound(F.split(F.trim(column), " "), all_of)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often it stands in it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _near_in(column: Column, name: str, near: Near, analysis: Analysis) -> Column:
    """Some occurrence of each phrase such that at most ``distance`` tokens stand between
    the end of the first and the start of the last."""
    places, there = [], []
    for phrase in near.phrases:
        variants = analysis.variants(phrase, name)
        if not variants:
            continue
        places.append(reduce(F.array_union, [_positions(column, v, phrase) for v in variants]))
        there.append(reduce(lambda a, b: a | b, [_phrase_in(column, v, phrase) for v in variants]))
    if not places:
        return F.lit(False)
    present = reduce(lambda a, b: a & b, there)  # cheap, and seldom true
    if len(places) == 1:
        return present

    def together(found: Column) -> Column:
        every = [found[f"p{k}"] for k in range(len(places))]

        def fits(first: Column) -> Column:
            return reduce(lambda a, b: a & b, [F.exists(p, lambda x: (x["s"] >= first["s"]) & (x["s"] - (first["s"] + first["n"]) <= near.distance)) for p in every])

        return F.exists(reduce(F.array_union, every), fits)

    return F.when(present, _bound(F.struct(*[p.alias(f"p{k}") for k, p in enumerate(places)]), together)).otherwise(F.lit(False))


def _compile(node: Node, names: tuple[str, ...], analysis: Analysis) -> Column | None:
    """The predicate of a tree; None for one without tokens."""
    columns = dict(analysis.columns)
    if isinstance(node, Phrase):
        tests = [_phrase_in(F.col(columns[c]), v, node) for c in names if c in columns for v in analysis.variants(node, c)]
        if not analysis.terms(node.text):
            return None
        return reduce(lambda a, b: a | b, [F.coalesce(t, F.lit(False)) for t in tests]) if tests else F.lit(False)
    if isinstance(node, Near):
        tests = [F.coalesce(_near_in(F.col(columns[c]), c, node, analysis), F.lit(False)) for c in names if c in columns]
        return reduce(lambda a, b: a | b, tests) if tests else F.lit(False)
    if isinstance(node, Within):
        inside = tuple(c for c in names if (c in node.columns) != node.negated)
        return _compile(node.inner, inside, analysis)
    left, right = _compile(node.left, names, analysis), _compile(node.right, names, analysis)
    if isinstance(node, Without):
        return left if right is None else F.lit(False) if left is None else left & ~right
    if left is None or right is None:
        return right if left is None else left
    return left & right if isinstance(node, Both) else left | right


def predicate(node: Node, scope: str = "all", analysis: Analysis | None = None) -> Column:
    """The boolean expression of a tree within a scope (all, title)."""
    out = _compile(node, SCOPES[scope], analysis or Analysis())
    return F.lit(False) if out is None else out


def phrases(node: Node, names: tuple[str, ...]) -> list[tuple[Phrase, tuple[str, ...]]]:
    """The phrases that can be matched, each with the columns it may stand in; not those
    that must be absent."""
    if isinstance(node, Phrase):
        return [(node, names)]
    if isinstance(node, Near):
        return [(p, names) for p in node.phrases]
    if isinstance(node, Within):
        return phrases(node.inner, tuple(c for c in names if (c in node.columns) != node.negated))
    if isinstance(node, Without):
        return phrases(node.left, names)
    return phrases(node.left, names) + phrases(node.right, names)


def scope_of(name: str) -> str:
    """The scope a word names: title and titles mean titles and bylines, all else all."""
    return "title" if name.strip().lower() in ("title", "titles") else "all"


def exact(node: Phrase) -> Phrase:
    return replace(node, prefix=False)
