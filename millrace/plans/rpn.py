"""Boolean queries in reverse Polish notation, compiled to one predicate over a document's terms."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column

AND, OR = "AND", "OR"


@dataclass(frozen=True)
class Plan:
    """The terms a query names, its predicate given each term's, and its tree: a term, or an operator with its two operands."""

    terms: tuple[str, ...]
    predicate: Callable[[dict[str, Column]], Column]
    tree: str | tuple


def compile_query(query: str) -> Plan:
    """Tokens are separated by white space; AND and OR are operators as written, anything else is a term as written.

    The result is the top of the stack; operands below it are ignored. An operator without two operands is refused.
    """
    stack: list[str | tuple] = []
    terms: list[str] = []
    for token in query.split():
        if token in (AND, OR):
            if len(stack) < 2:
                raise ValueError(f"{token} needs two operands: {query!r}")
            right, left = stack.pop(), stack.pop()
            stack.append((token, left, right))
        else:
            terms.append(token)
            stack.append(token)
    if not stack:
        raise ValueError("an empty query")

    def holds(tree: str | tuple, flags: dict[str, Column]) -> Column:
        if isinstance(tree, str):
            return flags[tree]
        op, left, right = tree[0], holds(tree[1], flags), holds(tree[2], flags)
        return left & right if op == AND else left | right

    return Plan(tuple(dict.fromkeys(terms)), lambda flags: holds(stack[-1], flags), stack[-1])
