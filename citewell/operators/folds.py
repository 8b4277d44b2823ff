"""Sequential rules over the places of an array, in time proportional to its length.

A fold whose state holds a growing array copies it at every step. Here the state holds a
few numbers; what a step gives out is gathered block by block, so no more than a block is
copied, and the blocks are joined once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from citewell.functions.text import let

BLOCK = 512
INTS = "array<int>"


def ints(*values: Column) -> Column:
    return F.array(*(v.cast("int") for v in values)).cast(INTS)


def emitted(n: Column, state: Column, step: Callable[[Column, Column], tuple[Column, Column]], kind: str) -> Column:
    """struct<state, out>: ``step`` over the places 0 to n - 1 from ``state`` (a struct of
    type ``kind``) gives the next state and an array of numbers; ``out`` is all of these."""
    pair = f"struct<state:{kind},out:{INTS}>"
    held = f"struct<state:{kind},out:array<{INTS}>>"

    def one(acc: Column, i: Column) -> Column:
        now, given = step(acc["state"], i)
        return F.struct(now.alias("state"), F.concat(acc["out"], given).alias("out")).cast(pair)

    def block(acc: Column, b: Column) -> Column:
        last = F.least(n, (b + 1) * BLOCK) - 1
        inside = F.aggregate(F.sequence((b * BLOCK).cast("int"), last.cast("int")), F.struct(acc["state"].alias("state"), ints().alias("out")).cast(pair), one)
        return let(inside, lambda x: F.struct(x["state"].alias("state"), F.concat(acc["out"], F.array(x["out"])).alias("out")).cast(held))

    zero = F.struct(state.alias("state"), F.array().cast(f"array<{INTS}>").alias("out")).cast(held)
    blocks = F.sequence(F.lit(0), F.floor((n - 1) / BLOCK).cast("int"))
    done = F.when(n > 0, F.aggregate(blocks, zero, block)).otherwise(zero)
    return let(done, lambda x: F.struct(x["state"].alias("state"), F.flatten(x["out"]).alias("out")))


def running(sizes: Column) -> Column:
    """0 and the sums of the first 1, 2, ... sizes: one more than there are sizes."""
    kind = "struct<sum:int>"

    def of(sizes: Column) -> Column:
        def step(s: Column, i: Column) -> tuple[Column, Column]:
            total = (s["sum"] + F.get(sizes, i)).cast("int")
            return F.struct(total.alias("sum")).cast(kind), ints(total)

        return F.concat(ints(F.lit(0)), emitted(F.size(sizes), F.struct(F.lit(0).alias("sum")).cast(kind), step, kind)["out"])

    return let(sizes, of)


def cut(parts: Column, ends: Column, joiner: str) -> Column:
    """The runs of ``parts`` up to each of the ascending ``ends``, joined."""
    before = lambda k: F.when(k == 0, 0).otherwise(F.get(ends, k - 1))
    return F.transform(ends, lambda end, k: F.array_join(F.slice(parts, before(k) + 1, end - before(k)), joiner))
