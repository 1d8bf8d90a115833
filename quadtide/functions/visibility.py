"""Visibility expressions: parse, normalise, and compile to a Column over an array of authorisations.

Terms are joined by ``&`` or ``|``; the two mix only with parentheses. A term is plain or quoted; in quotes a backslash
escapes a quote or a backslash. The empty expression is visible to all.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

_TOKEN = re.compile(r'\s*(?:([A-Za-z0-9_:./-]+)|"((?:[^"\\]|\\["\\])+)"|([&|()]))')


class VisibilityError(ValueError):
    pass


def parse(text: str):
    """None, a term, or (operator, parts)."""
    tokens, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise VisibilityError(f"bad character at {at} in {text!r}")
        tokens.append(("term", m[1]) if m[1] else ("term", re.sub(r"\\(.)", r"\1", m[2])) if m[2] else (m[3], None))
        at = m.end()
    if not tokens:
        return None
    node, rest = _expression(tokens, 0, text)
    if rest != len(tokens):
        raise VisibilityError(f"unexpected {tokens[rest][0]} in {text!r}")
    return node


def _expression(tokens, at, text):
    parts, operator = [], None
    while True:
        if at < len(tokens) and tokens[at][0] == "term":
            parts.append(tokens[at][1])
            at += 1
        elif at < len(tokens) and tokens[at][0] == "(":
            part, at = _expression(tokens, at + 1, text)
            if at >= len(tokens) or tokens[at][0] != ")":
                raise VisibilityError(f"unclosed parenthesis in {text!r}")
            parts.append(part)
            at += 1
        else:
            raise VisibilityError(f"a term is missing in {text!r}")
        if at < len(tokens) and tokens[at][0] in "&|":
            if operator not in (None, tokens[at][0]):
                raise VisibilityError(f"& and | need parentheses in {text!r}")
            operator = tokens[at][0]
            at += 1
            continue
        return (parts[0] if len(parts) == 1 else (operator, parts)), at


def quote(term: str) -> str:
    if re.fullmatch(r"[A-Za-z0-9_:./-]+", term):
        return term
    return '"' + re.sub(r'(["\\])', r"\\\1", term) + '"'


def normal(node):
    """Like operators rolled up, parts sorted (terms first, then shorter ones) without repeats, only children promoted."""
    if node is None or isinstance(node, str):
        return node
    operator, parts = node
    flat = []
    for part in map(normal, parts):
        flat += part[1] if isinstance(part, tuple) and part[0] == operator else [part]
    unique = {to_text(p): p for p in flat}
    ordered = sorted(unique.values(), key=lambda p: (isinstance(p, tuple), len(p[1]) if isinstance(p, tuple) else 0, to_text(p)))
    return ordered[0] if len(ordered) == 1 else (operator, ordered)


def to_text(node) -> str:
    if node is None:
        return ""
    if isinstance(node, str):
        return quote(node)
    return node[0].join(f"({to_text(p)})" if isinstance(p, tuple) else to_text(p) for p in node[1])


def normalise(text: str) -> str:
    return to_text(normal(parse(text)))


def visible(text: str, auths: Column) -> Column:
    """The expression as a Column: plain array membership, so Catalyst sees it."""

    def compiled(node) -> Column:
        if isinstance(node, str):
            return F.array_contains(auths, node)
        out = compiled(node[1][0])
        for part in node[1][1:]:
            out = out & compiled(part) if node[0] == "&" else out | compiled(part)
        return out

    node = parse(text)
    return F.lit(True) if node is None else compiled(node)
