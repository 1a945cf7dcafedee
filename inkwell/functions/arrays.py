"""Expressions over the arrays of a nested document: what else would need windows and joins of token rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements that a scan goes through before it puts them away: what it appends to stays short, so that a scan copies n * sqrt(n) references at most, not n * n.
PIECE = 128


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)``, the value evaluated once."""
    return F.get(F.transform(F.array(value), body), 0)


def positions(items: Column, wanted: Callable[[Column], Column]) -> Column:
    """Where the wanted elements stand, from 0."""
    return F.filter(F.transform(items, lambda x, i: F.when(wanted(x), i)), lambda i: i.isNotNull())


def scanned(items: Column, start: Column, step: Callable[[Column, Column], Column], emit: Callable[[Column, Column], Column], kind: str) -> Column:
    """A state machine over an array: ``emit(state before, element)`` of every element, an array of ``kind``. ``step`` gives the state after an element, of the same type as ``start``."""
    none = F.array().cast(f"array<{kind}>")
    pieces = F.when(F.size(items) > 0, F.transform(F.sequence(F.lit(0), F.floor((F.size(items) - 1) / PIECE).cast("int")), lambda p: F.slice(items, p * PIECE + 1, PIECE)))
    one = lambda held, x: F.struct(step(held["state"], x).alias("state"), F.concat(held["out"], F.array(emit(held["state"], x).cast(kind))).alias("out"))

    def piece(held: Column, part: Column) -> Column:
        inner = F.aggregate(part, F.struct(held["state"].alias("state"), none.alias("out")), one)
        return let(inner, lambda r: F.struct(r["state"].alias("state"), F.concat(held["out"], F.array(r["out"])).alias("out")))

    empty = F.array().cast(f"array<array<{kind}>>")
    found = F.aggregate(pieces, F.struct(start.alias("state"), empty.alias("out")), piece, lambda held: F.flatten(held["out"]))
    return F.coalesce(found, none)


def levels(tokens: Column) -> Column:
    """How many openers are open before each token, its own closer counted as closed."""
    return scanned(tokens, F.lit(0), lambda depth, t: (depth + t["nesting"]).cast("int"), lambda depth, t: depth - F.when(t["nesting"] == -1, 1).otherwise(0), "int")


#: What a stack of open tokens holds: where the token stands, how many nodes it has so far, its tag.
_OPEN = "struct<at:int,n:int,tag:string>"


def nesting(tokens: Column) -> Column:
    """For each token (at, parent, idx, partner tag): where it stands, the position of the last opener before that is still open (-1: none), the number of nodes before it there, and for a closer the tag that this opener has.

    Positions are places in the array. A closer's ``parent`` is the opener that it closes.
    """
    root = F.array(F.struct(F.lit(-1).alias("at"), F.lit(0).alias("n"), F.lit(None).cast("string").alias("tag"))).cast(f"array<{_OPEN}>")
    start = F.struct(F.lit(0).alias("at"), root.alias("stack"))
    top = lambda s: F.element_at(s["stack"], -1)

    def step(s: Column, t: Column) -> Column:
        last = top(s)
        below = F.slice(s["stack"], 1, F.size(s["stack"]) - 1)
        counted = F.concat(below, F.array(F.struct(last["at"].alias("at"), (last["n"] + 1).alias("n"), last["tag"].alias("tag"))))
        opened = F.concat(counted, F.array(F.struct(s["at"].alias("at"), F.lit(0).alias("n"), t["tag"].alias("tag"))))
        closed = F.when(F.size(s["stack"]) > 1, below).otherwise(s["stack"])
        stack = F.when(t["nesting"] == 1, opened).when(t["nesting"] == -1, closed).otherwise(counted)
        return F.struct((s["at"] + 1).alias("at"), stack.cast(f"array<{_OPEN}>").alias("stack"))

    emit = lambda s, t: F.struct(s["at"].alias("at"), top(s)["at"].alias("parent"), top(s)["n"].alias("idx"), top(s)["tag"].alias("tag"))
    return scanned(tokens, start, step, emit, "struct<at:int,parent:int,idx:int,tag:string>")
