"""Web-style search text to a small expression tree, and the tree to a Column.

Text holds words, "quoted phrases", OR, and -excluded words. Everything here runs on the driver and
is bounded; the tree only ever holds words of [a-z0-9-].
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions import lexemes as L

#: Bounds of query text.
MAX_CHARACTERS = 256
MAX_WORDS = 24
PREFIX_LENGTHS = (3, 40)
MAX_PARTIAL_CLAUSES = 8
MAX_SYNONYMS_PER_TERM = 3
MAX_SYNONYMS = 6

#: Directional domain synonyms.
SYNONYMS = {
    "flu": ("influenza",),
    "covid": ("coronavirus", "sars-cov-2"),
    "puncture": ("needlestick",),
    "sanitizer": ("disinfectant",),
    "isolation": ("quarantine",),
    "mask": ("respirator",),
    "respirator": ("mask",),
}

_WORD = r"[a-z0-9]+(?:-[a-z0-9]+)*"
_PIECE = re.compile(rf'"(?P<quoted>[^"]*)"?|(?P<minus>-)?(?P<word>{_WORD})')


class QueryError(ValueError):
    """Search text that cannot be searched for; the message is for the user."""


@dataclass(frozen=True)
class Clause:
    """Words that stand one after the other; one word for a plain term."""

    words: tuple[str, ...]
    quoted: bool = False


@dataclass(frozen=True)
class Query:
    normalized: str
    terms: tuple[str, ...]
    phrases: tuple[tuple[str, ...], ...]
    excluded: tuple[str, ...]
    has_or: bool
    clauses: tuple[Clause, ...]
    ends_excluded: bool
    #: Clauses by OR group: all groups must match, any clause of a group.
    groups: tuple[tuple[Clause | str, ...], ...] = field(default=())


def _pieces(text: str) -> list[tuple[str, tuple[str, ...]]]:
    out: list[tuple[str, tuple[str, ...]]] = []
    for m in _PIECE.finditer(text):
        if m["quoted"] is not None:
            if words := tuple(re.findall(_WORD, m["quoted"])):
                out.append(("phrase", words))
        elif m["minus"]:
            out.append(("exclude", (m["word"],)))
        elif m["word"] == "or":
            if out and out[-1][0] != "or":
                out.append(("or", ()))
        else:
            out.append(("term", (m["word"],)))
    while out and out[-1][0] == "or":
        out.pop()
    return out


def parse(raw: str) -> Query:
    """The query that raw, trimmed text says; QueryError if it says none."""
    if len(raw) > MAX_CHARACTERS:
        raise QueryError(f"Search query is too long (max {MAX_CHARACTERS} characters).")
    pieces = _pieces(raw.lower())
    content = [p for p in pieces if p[0] != "or"]
    if not content:
        raise QueryError("Search query has no searchable words. Use letters, numbers, or hyphenated codes -- quotes, OR, and - need a word to apply to.")
    if sum(len(words) for _, words in content) > MAX_WORDS:
        raise QueryError(f"Search query has too many terms (max {MAX_WORDS}).")
    positive = [Clause(words, kind == "phrase") for kind, words in content if kind != "exclude"]
    if not positive:
        raise QueryError("Search query only excludes terms. Add at least one term to search for.")
    said = {"phrase": lambda w: f'"{" ".join(w)}"', "exclude": lambda w: f"-{w[0]}", "or": lambda w: "OR", "term": lambda w: w[0]}
    # OR binds more loosely than standing side by side: alternatives of conjunctions
    alternatives: list[list[Clause | str]] = [[]]
    for kind, words in pieces:
        if kind == "or":
            alternatives.append([])
        else:
            alternatives[-1].append(words[0] if kind == "exclude" else Clause(words, kind == "phrase"))
    return Query(
        normalized=" ".join(said[kind](words) for kind, words in pieces),
        terms=tuple(dict.fromkeys(w for c in positive for w in c.words)),
        phrases=tuple(c.words for c in positive if c.quoted),
        excluded=tuple(dict.fromkeys(words[0] for kind, words in content if kind == "exclude")),
        has_or=any(kind == "or" for kind, _ in pieces),
        clauses=tuple(positive),
        ends_excluded=pieces[-1][0] == "exclude",
        groups=tuple(map(tuple, alternatives)),
    )


# -- expression tree -----------------------------------------------------------------------------


@dataclass(frozen=True)
class Words:
    """Lexemes next to each other; prefix: the last one may go on."""

    lexemes: tuple[str, ...]
    prefix: bool = False


@dataclass(frozen=True)
class All:
    parts: tuple


@dataclass(frozen=True)
class Any_:
    parts: tuple


@dataclass(frozen=True)
class Not:
    part: object


Lexer = "Callable[[str], list[str]]"


def _words(words: tuple[str, ...], lex, prefix: bool = False):
    found = tuple(x for w in words for x in lex(w))
    return Words(found, prefix) if found else None


def _all(parts) -> object | None:
    parts = tuple(p for p in parts if p is not None)
    return None if not parts else parts[0] if len(parts) == 1 else All(parts)


def _with_exclusions(positive, query: Query, lex) -> object | None:
    return _all([positive, *(Not(w) for w in (_words((x,), lex) for x in query.excluded) if w)])


def strict(query: Query, lex=L.lex) -> object | None:
    """Every clause, or with OR any alternative; None if nothing is left to search for."""

    def part(x) -> object | None:
        if isinstance(x, Clause):
            return _words(x.words, lex)
        own = _words((x,), lex)
        return Not(own) if own else None

    ways = tuple(w for w in (_all(part(x) for x in group) for group in query.groups) if w is not None)
    return None if not ways else ways[0] if len(ways) == 1 else Any_(ways)


def prefix_term(query: Query) -> str | None:
    """The last word, if it is one that may still be being typed."""
    last = query.clauses[-1]
    low, high = PREFIX_LENGTHS
    if query.has_or or query.ends_excluded or last.quoted or not low <= len(last.words[0]) <= high:
        return None
    return last.words[0]


def prefix(query: Query, lex=L.lex) -> object | None:
    if prefix_term(query) is None:
        return None
    parts = [_words(c.words, lex) for c in query.clauses[:-1]]
    return _with_exclusions(_all([*parts, _words(query.clauses[-1].words, lex, prefix=True)]), query, lex)


def partial(query: Query, lex=L.lex) -> object | None:
    """Any of the first clauses, phrases whole, exclusions kept."""
    parts = tuple(p for p in (_words(c.words, lex) for c in query.clauses[:MAX_PARTIAL_CLAUSES]) if p)
    return _with_exclusions(Any_(parts) if len(parts) > 1 else _all(parts), query, lex)


def expansions(query: Query, rules: dict[str, tuple[str, ...]] = SYNONYMS) -> list[tuple[str, tuple[str, ...]]]:
    """For each clause, in order, its term and the synonyms that widen it; () for none."""
    out, used = [], set()
    for c in query.clauses:
        added: list[str] = []
        if not c.quoted:
            for candidate in rules.get(c.words[0], ()):
                if len(added) < MAX_SYNONYMS_PER_TERM and len(used) < MAX_SYNONYMS and candidate not in (*query.terms, *used):
                    added.append(candidate)
                    used.add(candidate)
        out.append((c.words[0], tuple(added)))
    return out


def synonym(query: Query, rules: dict[str, tuple[str, ...]] = SYNONYMS, lex=L.lex) -> object | None:
    if query.has_or:
        return None
    wider = expansions(query, rules)
    if not any(added for _, added in wider):
        return None
    parts = []
    for clause, (_, added) in zip(query.clauses, wider):
        ways = tuple(p for p in [_words(clause.words, lex), *(_words((a,), lex) for a in added)] if p)
        parts.append(Any_(ways) if len(ways) > 1 else _all(ways))
    return _with_exclusions(_all(parts), query, lex)


def say(node) -> str:
    """The tree as text: & | ! and <-> for neighbours, :* for a prefix."""
    if isinstance(node, Words):
        text = "<->".join(node.lexemes) + (":*" if node.prefix else "")
        return f"({text})" if len(node.lexemes) > 1 else text
    if isinstance(node, Not):
        return "!" + say(node.part)
    joined = (" & " if isinstance(node, All) else " | ").join(say(p) for p in node.parts)
    return joined if isinstance(node, All) else f"({joined})"


def condition(node, lexed: Column) -> Column:
    """Whether joined lexemes (lexemes.join) match: substring tests only, all inside code generation."""
    if isinstance(node, Words):
        text = L.MARK + L.MARK.join(node.lexemes) + ("" if node.prefix else L.MARK)
        return F.contains(lexed, F.lit(text))
    if isinstance(node, Not):
        return ~condition(node.part, lexed)
    parts = [condition(p, lexed) for p in node.parts]
    return reduce(lambda a, b: a & b if isinstance(node, All) else a | b, parts)


Leaf = tuple[str, bool]  # a lexeme, and whether it is a prefix


def leaves(node) -> set[Leaf]:
    """The lexemes that an expression looks for; excluded ones are not among them."""
    if isinstance(node, Words):
        return {(w, node.prefix and i == len(node.lexemes) - 1) for i, w in enumerate(node.lexemes)}
    return set() if isinstance(node, Not) else set().union(*map(leaves, node.parts))


def cover(node, counts: dict[Leaf, int]) -> tuple[int, set[Leaf]] | None:
    """The cheapest lexemes of which every match holds one, and their postings; None where there are none."""
    if isinstance(node, Words):
        least = min(sorted(leaves(node)), key=lambda leaf: counts[leaf])
        return counts[least], {least}
    if isinstance(node, Not):
        return None
    parts = [cover(p, counts) for p in node.parts]
    if isinstance(node, All):
        return min((p for p in parts if p is not None), key=lambda p: p[0], default=None)
    if any(p is None for p in parts):
        return None
    return sum(p[0] for p in parts), set().union(*(p[1] for p in parts))
