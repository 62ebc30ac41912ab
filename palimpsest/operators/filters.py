"""The JSON filter language, translated clause by clause into one Column, which Catalyst pushes to the scan.

    {"level": "explicit", "OR": [{"times_derived": {"gte": 2}}, {"session_name": None}]}

The keys of an object all hold. A key is a field of the table or, in any case, AND, OR or NOT. A field's value is a
scalar (equal), a list (one of), or an object of operators that all hold. What is not understood is refused, since
leaving a clause out would show rows that were asked to stay hidden.
"""

from __future__ import annotations

import datetime as dt
import operator
from collections.abc import Callable, Iterable, Iterator
from functools import reduce
from typing import Any, NamedTuple

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH, MAX_CLAUSES = 16, 256  # fixed values: nested AND, OR and NOT; comparisons in all

# Fields that a filter may name, with their types.
FACT_FIELDS = {
    "id": "text", "session_name": "text", "level": "text", "content": "text", "content_norm": "text", "sync_state": "text", "confidence": "decimal",
    "times_derived": "integer", "created_at": "timestamp", "updated_at": "timestamp", "last_reinforced_at": "timestamp", "expires_at": "timestamp",
}
MESSAGE_FIELDS = {"id": "integer", "session_name": "text", "peer_name": "text", "content": "text", "token_count": "integer", "seq_in_session": "integer", "created_at": "timestamp"}


class FilterError(ValueError):
    pass


def _text(v: Any) -> str:
    if isinstance(v, str):
        return v
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, (int, float)):
        return str(v)
    raise ValueError


def _number(make: type) -> Callable[[Any], Any]:
    return lambda v: make(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else make(v.strip())


def _moment(v: Any) -> dt.datetime:
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return dt.datetime.fromtimestamp(int(v), dt.UTC)
    at = dt.datetime.fromisoformat(v.strip())
    if at.tzinfo is None:
        raise ValueError
    return at


#: Type of a field -> what makes its values of JSON's, and what is expected, for messages.
VALUES: dict[str, tuple[Callable[[Any], Any], str]] = {
    "text": (_text, "text"),
    "integer": (_number(int), "a whole number"),
    "decimal": (_number(float), "a number"),
    "timestamp": (_moment, "seconds since 1970, or ISO-8601 with an offset"),
}


class Operator(NamedTuple):
    """build makes the Column of a field and the operand; takes: 'value', 'list' or 'flag'; null: for a null operand."""

    build: Callable[[Column, Any], Column]
    takes: str = "value"
    null: Callable[[Column], Column] | None = None
    on: Iterable[str] = tuple(VALUES)


#: A null operand asks for null rows or all others; ne and nin keep null rows, which plain SQL comparisons would drop.
OPERATORS: dict[str, Operator] = {
    "eq": Operator(operator.eq, null=Column.isNull),
    "ne": Operator(lambda c, v: ~c.eqNullSafe(v), null=Column.isNotNull),
    "gt": Operator(operator.gt),
    "gte": Operator(operator.ge),
    "lt": Operator(operator.lt),
    "lte": Operator(operator.le),
    "in": Operator(lambda c, vs: c.isin(vs) if vs else F.lit(False), "list"),
    "nin": Operator(lambda c, vs: c.isNull() | ~c.isin(vs), "list"),
    "exists": Operator(lambda c, there: c.isNotNull() if there else c.isNull(), "flag"),
    "contains": Operator(Column.contains, on=("text",)),
    "icontains": Operator(lambda c, v: F.lower(c).contains(F.lower(v)), on=("text",)),
    "starts_with": Operator(Column.startswith, on=("text",)),
}


def _clauses(field: str, asked: Any) -> Iterator[tuple[str, Any]]:
    """The (operator, operand) pairs of a field's value."""
    if isinstance(asked, list):
        yield "in", asked
    elif isinstance(asked, dict):
        if not asked:
            raise FilterError(f"{field}: an object of operators is needed, this one is empty")
        for name, operand in asked.items():
            name = str(name).lower()
            if name not in OPERATORS:
                raise FilterError(f"{field}: there is no operator {name!r}; there are {', '.join(OPERATORS)}")
            if OPERATORS[name].takes == "list" and operand == []:
                raise FilterError(f"{field}: {name} needs at least one value")
            yield name, operand
    else:
        yield "eq", asked


class _Translation:
    def __init__(self, fields: dict[str, str], prefix: str):
        self.fields, self.prefix, self.left = fields, prefix, MAX_CLAUSES

    def object(self, node: dict, depth: int) -> Column:
        if depth > MAX_DEPTH:
            raise FilterError(f"AND, OR and NOT may be nested {MAX_DEPTH} deep")
        parts = []
        for key, value in node.items():
            word = key.upper()
            if word == "NOT":
                parts.append(~self.object(self.operand(word, value), depth + 1))
            elif word in ("AND", "OR"):
                if not isinstance(value, list) or not value:
                    raise FilterError(f"{word} takes a list of one object or more")
                each = [self.object(self.operand(word, x), depth + 1) for x in value]
                parts.append(reduce(operator.and_ if word == "AND" else operator.or_, each))
            else:
                parts += [self.comparison(key, name, operand) for name, operand in _clauses(key, value)]
        return reduce(operator.and_, parts) if parts else F.lit(True)

    @staticmethod
    def operand(word: str, value: Any) -> dict:
        if not isinstance(value, dict):
            raise FilterError(f"{word} combines objects, not {type(value).__name__}")
        return value

    def comparison(self, field: str, name: str, operand: Any) -> Column:
        self.left -= 1
        if self.left < 0:
            raise FilterError(f"a filter may make {MAX_CLAUSES} comparisons, no more predicates than that")
        if field not in self.fields:
            raise FilterError(f"no field {field!r} to filter by; there are {', '.join(self.fields)}")
        kind, op, column = self.fields[field], OPERATORS[name], F.col(self.prefix + field)
        if kind not in op.on:
            raise FilterError(f"{name} is for {' and '.join(op.on)} fields, and {field} is of type {kind}")
        if op.takes == "flag":
            if not isinstance(operand, bool):
                raise FilterError(f"{field}: {name} takes true or false")
            return op.build(column, operand)
        if op.takes == "list":
            if not isinstance(operand, list):
                raise FilterError(f"{field}: {name} takes a list")
            return op.build(column, [self.value(field, kind, v) for v in operand])
        if operand is None:
            if op.null is None:
                raise FilterError(f"{field}: {name} has no meaning for null")
            return op.null(column)
        return op.build(column, self.value(field, kind, operand))

    @staticmethod
    def value(field: str, kind: str, given: Any) -> Column:
        make, expected = VALUES[kind]
        try:
            return F.lit(make(given))
        except (ValueError, OverflowError, AttributeError, OSError) as e:
            raise FilterError(f"{field}: {given!r} is not {expected}") from e


def column_of(raw: dict | None, fields: dict[str, str], prefix: str = "") -> Column:
    """The Column of a filter over the given fields; null and empty filters hold for every row, NOT keeps three-valued logic."""
    return _Translation(fields, prefix).object(raw or {}, 0)


def all_of(*filters: dict | None) -> dict:
    """One filter that holds where all do. Null and empty ones drop out; a single one stays as it is."""
    kept = [f for f in filters if f]
    return {} if not kept else kept[0] if len(kept) == 1 else {"AND": kept}


def fact_filter(raw: dict | None) -> Column:
    return column_of(raw, FACT_FIELDS)


def message_filter(raw: dict | None) -> Column:
    return column_of(raw, MESSAGE_FIELDS)
