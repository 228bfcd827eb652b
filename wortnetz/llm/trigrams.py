"""Boolean trigram queries derived from regular expressions: what a text must hold for a match to be possible."""

from __future__ import annotations

from itertools import product

#: A query is True (any text may match), a trigram, or ("and" | "or", [queries]).
Query = bool | str | tuple

#: More spellings than this in a row are given up: the row then demands nothing.
MOST_SPELLINGS = 64
#: A class with more characters than this ends a row of known characters.
MOST_CHARS = 8


class _Parser:
    """Literals, escapes, classes, groups, alternatives and quantifiers; groups and flags do not change the query."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def take(self) -> str:
        self.i += 1
        return self.p[self.i - 1]

    def alternatives(self) -> tuple:
        branches = [self.row()]
        while self.peek() == "|":
            self.take()
            branches.append(self.row())
        return branches[0] if len(branches) == 1 else ("alt", branches)

    def row(self) -> tuple:
        items = []
        while self.peek() not in ("", "|", ")"):
            items.append(self.quantified(self.atom()))
        return ("row", items)

    def quantified(self, node: tuple) -> tuple:
        c = self.peek()
        if c and c in "?*+":
            self.take()
            node = ("rep", node, 0 if c in "?*" else 1, 1 if c == "?" else None)
        elif c == "{":
            end = self.p.index("}", self.i)
            low, _, high = self.p[self.i + 1 : end].partition(",")
            node = ("rep", node, int(low), int(high) if high else (None if "," in self.p[self.i : end] else int(low)))
            self.i = end + 1
        return node

    def atom(self) -> tuple:
        c = self.take()
        if c == "(":
            if self.peek() == "?":
                self.i = self.p.index(":", self.i) + 1
            node = self.alternatives()
            self.take()
            return node
        if c == "[":
            return ("set", self.charset())
        if c == "\\":
            return ("set", self.escaped())
        return ("set", None if c == "." else frozenset(c))

    def escaped(self) -> frozenset | None:
        c = self.take()
        if c == "x":
            self.i += 2
            return frozenset(chr(int(self.p[self.i - 2 : self.i], 16)))
        return None if c in "dDwWsSbB" else frozenset(c)

    def charset(self) -> frozenset | None:
        chars, known, first = set(), self.peek() != "^", True
        while first or self.peek() != "]":
            first, c = False, self.take()
            one = self.escaped() if c == "\\" else frozenset(c)
            if one is None:
                known = False
            elif self.peek() == "-" and self.p[self.i + 1] != "]":
                self.take()
                chars |= {chr(k) for k in range(ord(c), ord(self.take()) + 1)}
            else:
                chars |= one
        self.take()
        return frozenset(chars) if known else None


def _join(kind: str, parts: list[Query]) -> Query:
    if kind == "and":
        parts = [q for q in parts if q is not True]
        if not parts:
            return True
    elif True in parts:
        return True
    flat: list[Query] = []
    for q in parts:
        flat += [x for x in (q[1] if isinstance(q, tuple) and q[0] == kind else [q]) if x not in flat]
    if kind == "or":  # what demands more than another alternative adds no text
        demands = [trigrams_of(q) if isinstance(q, str) or q[0] == "and" else None for q in flat]
        flat = [q for q, d in zip(flat, demands) if d is None or not any(o is not None and o < d for o in demands)]
    return flat[0] if len(flat) == 1 else (kind, flat)


def _spelled(node: tuple) -> list[str] | None:
    """All texts that the node can match, or None for too many."""
    kind = node[0]
    if kind == "set":
        return None if node[1] is None or len({c.lower() for c in node[1]}) > MOST_CHARS else sorted({c.lower() for c in node[1]})
    if kind == "rep":
        inner = _spelled(node[1])
        if inner is None or node[3] is None:
            return None
        out = {"".join(x) for k in range(node[2], node[3] + 1) for x in product(inner, repeat=k)} if len(inner) ** node[3] <= MOST_SPELLINGS else None
        return None if out is None else sorted(out)
    parts = [_spelled(x) for x in node[1]]
    if any(x is None for x in parts):
        return None
    if kind == "alt":
        out = sorted({x for p in parts for x in p})
    else:
        out = [""]
        for p in parts:
            out = sorted({a + b for a in out for b in p})
            if len(out) > MOST_SPELLINGS:
                return None
    return out if len(out) <= MOST_SPELLINGS else None


def _of_spellings(texts: list[str]) -> Query:
    return _join("or", [_join("and", [t[k : k + 3] for k in range(len(t) - 2)]) for t in texts]) if texts else True


def _query(node: tuple) -> Query:
    kind = node[0]
    if kind == "set":
        return True
    if kind == "rep":
        return _query(node[1]) if node[2] else True
    if kind == "alt":
        return _join("or", [_of_spellings(s) if (s := _spelled(x)) is not None else _query(x) for x in node[1]])
    parts, known = [], [""]
    for x in node[1]:
        more = _spelled(x)
        grown = None if more is None else sorted({a + b for a in known for b in more})
        if grown is not None and len(grown) <= MOST_SPELLINGS:
            known = grown
        else:
            parts += [_of_spellings(known), _query(x) if more is None else _of_spellings(more)]
            known = [""]
    return _join("and", [*parts, _of_spellings(known)])


def trigram_query(pattern: str) -> Query:
    """The weakest demand on a lower-cased text that every match of the pattern meets; True where there is none."""
    return _query(_Parser(pattern).alternatives())


def trigrams_of(query: Query) -> set[str]:
    if query is True:
        return set()
    return {query} if isinstance(query, str) else {t for q in query[1] for t in trigrams_of(q)}
