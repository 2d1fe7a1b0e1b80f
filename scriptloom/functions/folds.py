"""Sequential steps over the items of one recording or stretch, as folds of built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import classes as C
from . import clock as K

#: What a time may have lost, in the order of trying: an hour, else some tens of minutes. Seconds.
SHIFTS = (3600.0, *(600.0 * k for k in range(1, 12)))

#: Seconds. A small overlap; what a unit keeps at least.
SMALL, LEAST = 0.3, 0.02
UNIT = "struct<start:double,end:double,text:string,kind:string,prob:double,logprob:double>"


def repaired_times(times: Column) -> Column:
    """Times in order, as an array: each that doesn't come after the one before, as it was repaired, is moved to where it fits.

    It fits above that one and below the next later time above that. The first shift that brings it there is taken; else it
    stands half-way, or a second on if no later time is above.
    """

    def moved(floor: Column, at: Column, i: Column) -> Column:
        above = F.get(F.filter(F.slice(times, i + 2, F.size(times)), lambda t: t > floor), F.lit(0))
        tries = F.transform(F.array(*map(F.lit, SHIFTS)), lambda s: at + s)
        fits = F.get(F.filter(tries, lambda t: (t > floor) & (above.isNull() | (t < above))), F.lit(0))
        return F.coalesce(fits, (floor + above) / 2, floor + 1)

    def step(done: Column, x: Column) -> Column:
        floor = F.try_element_at(done, F.lit(-1))
        late = F.coalesce(x["t"] <= floor, F.lit(False))
        return F.array_append(done, F.when(late, moved(floor, x["t"], x["i"])).otherwise(x["t"]))

    items = F.transform(times, lambda t, i: F.struct(t.alias("t"), i.alias("i")))
    return F.aggregate(items, F.array().cast("array<double>"), step)


def _unit(u: Column, **changed: Column) -> Column:
    return F.struct(*(changed.get(f, u[f]).alias(f) for f in ("start", "end", "text", "kind", "prob", "logprob"))).cast(UNIT)


def without_overlaps(units: Column) -> Column:
    """Units by start, as an array: small overlaps are halved, large ones beside recovered speech are merged.

    A fold with a stack: a unit meets only the last one that is done, and none if it begins LEAST behind all ends before it.
    """

    def step(acc: Column, u: Column) -> Column:
        done = acc["done"]
        last = F.try_element_at(done, F.lit(-1))
        before = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        either = lambda kind: (last["kind"] == kind) | (u["kind"] == kind)
        middle = (last["end"] + u["start"]) / 2
        halved = F.array(_unit(last, end=middle), _unit(u, start=middle, end=F.greatest(u["end"], middle + LEAST)))
        text = F.concat(F.regexp_replace(last["text"], f"{C.WS}+$", ""), F.lit(" "), F.regexp_replace(u["text"], f"^{C.WS}+", ""))
        whole = _unit(last, end=F.greatest(last["end"], u["end"]), text=text, kind=F.when(either("arabic"), "arabic").otherwise("recovered"), prob=F.lit(None).cast("double"))
        large = (K.lasting(u["start"], last["end"]) > K.limit(SMALL)) & either("recovered")
        meets = F.coalesce((last["end"] > u["start"]) & (u["start"] < acc["reach"] + LEAST), F.lit(False))
        now = F.when(~meets, F.array_append(done, _unit(u))).when(large, F.array_append(before, whole)).otherwise(F.concat(before, halved))
        return F.struct(now.alias("done"), F.greatest(acc["reach"], u["end"]).alias("reach"))

    nothing = F.struct(F.array().cast(f"array<{UNIT}>").alias("done"), F.lit(None).cast("double").alias("reach"))
    return F.aggregate(units, nothing, step, lambda acc: acc["done"])
