"""Two ways to compute a graph: Spark columns, and numpy arrays inside tasks."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumaframe.programs.graph import Graph

#: Levels of an expression above which its value becomes a column of its own.
DEEP = 40


def _nan(c: Column) -> Column:
    return F.isnan(c)


def _quotient(a: Column, b: Column) -> Column:
    """IEEE division, which Spark's isn't where b is 0."""
    at_zero = F.when(_nan(a) | (a == 0), F.lit(float("nan"))).otherwise(F.signum(a) * F.lit(float("inf")))
    return F.when(b == 0, at_zero).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))


def _whole(c: Column, f: Callable[[Column], Column]) -> Column:
    """floor or ceil as a double; values that a long can't hold are whole already."""
    return F.when(F.abs(c) < 2.0**53, f(c).cast("double")).otherwise(c)


def _as_int(c: Column) -> Column:
    """A double cut to int, 0 where it is none."""
    return F.when(_nan(c) | (F.abs(c) >= 2.0**31), F.lit(0)).otherwise(c).cast("int").cast("long")


def _wrapped(c: Column) -> Column:
    """A long as 32 bits hold it."""
    return F.pmod(c + (1 << 31), F.lit(1 << 32)) - (1 << 31)


def _less(a: Column, b: Column) -> Column:
    return (a < b) & ~_nan(b)


_FLOATS: dict[str, Callable[..., Column]] = {
    "neg": lambda a: -a, "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": _quotient, "pow": F.pow,
    "min": F.least, "max": F.greatest, "floor": lambda a: _whole(a, F.floor), "ceil": lambda a: _whole(a, F.ceil), "rint": F.rint, "abs": F.abs, "sign": F.signum,
    "sqrt": F.sqrt, "exp": F.exp, "log": lambda a: F.when(a > 0, F.log(a)).when(a == 0, F.lit(float("-inf"))).otherwise(F.lit(float("nan"))), "atan2": lambda a, b: F.atan2(a + 0.0, b + 0.0),
    **{f: getattr(F, f) for f in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh")},
    "isnan": _nan, "isinf": lambda a: F.abs(a) == F.lit(float("inf")), "lt": _less, "le": lambda a, b: (a <= b) & ~_nan(b), "eq": lambda a, b: (a == b) & ~_nan(a),
    "int": _as_int, "bool": lambda a: a != 0, "float": lambda a: a, "select": lambda c, a, b: F.when(c, a).otherwise(b),
}
_INTS: dict[str, Callable[..., Column]] = {
    "neg": lambda a: _wrapped(-a), "add": lambda a, b: _wrapped(a + b), "sub": lambda a, b: _wrapped(a - b), "mul": lambda a, b: _wrapped(a * b),
    "idiv": lambda a, b: F.when(b == 0, F.lit(0)).otherwise((a - a % F.when(b == 0, F.lit(1)).otherwise(b)) / F.when(b == 0, F.lit(1)).otherwise(b)).cast("long"), "imod": lambda a, b: F.when(b == 0, F.lit(0)).otherwise(a % F.when(b == 0, F.lit(1)).otherwise(b)),
    "min": F.least, "max": F.greatest, "abs": F.abs, "sign": lambda a: F.signum(a).cast("long"), "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "eq": lambda a, b: a == b,
    "band": lambda a, b: a.bitwiseAND(b), "bor": lambda a, b: a.bitwiseOR(b), "bxor": lambda a, b: a.bitwiseXOR(b),
    "shl": lambda a, b: _wrapped(F.call_function("shiftleft", a, (b % 32).cast("int"))), "shr": lambda a, b: F.call_function("shiftright", a, (b % 32).cast("int")),
    "float": lambda a: a.cast("double"), "bool": lambda a: a != 0, "int": lambda a: a, "select": lambda c, a, b: F.when(c, a).otherwise(b),
}
_BOOLS: dict[str, Callable[..., Column]] = {
    "and": lambda a, b: a & b, "or": lambda a, b: a | b, "not": lambda a: ~a, "eq": lambda a, b: a == b, "select": lambda c, a, b: F.when(c, a).otherwise(b),
    "float": lambda a: a.cast("double"), "int": lambda a: a.cast("long"), "bool": lambda a: a,
}


def as_columns(frame: DataFrame, graph: Graph, out: dict[str, int]) -> DataFrame:
    """image_id, y, x and the nodes of `out` under their names. frame has the graph's inputs as columns.

    What several nodes need becomes a column that a projection computes once; the next projection takes it up.
    """
    order = graph.below(list(out.values()))
    uses = Counter(a for n in order for a in graph.arguments(n))
    bound: dict[int, int] = {}
    level, deep, made = {}, {}, {}
    for n in order:
        op, args = graph.nodes[n].op, graph.arguments(n)
        level[n] = max((level[a] + (a in bound) for a in args), default=0)
        deep[n] = 1 + max((0 if a in bound else deep[a] for a in args), default=0)
        if op not in ("const", "input") and (uses[n] > 1 or deep[n] > DEEP):
            bound[n] = level[n]
    for n in order:
        node = graph.nodes[n]
        if node.op == "const":
            made[n] = F.lit(node.args[0]).cast({"float": "double", "int": "long", "bool": "boolean"}[node.kind])
        elif node.op == "input":
            made[n] = F.col(node.args[0]).cast("long" if node.kind == "int" else "double")
        else:
            rules = {"float": _FLOATS, "int": _INTS, "bool": _BOOLS}[graph.kind(node.args[-1])]
            given = [F.col(f"n{a}") if a in bound else made[a] for a in node.args]
            if node.op == "div" and graph.value(node.args[1]):
                made[n] = given[0] / given[1]
            else:
                made[n] = rules[node.op](*given)
    inputs = sorted({graph.nodes[n].args[0] for n in order if graph.nodes[n].op == "input"} - {"y", "x"})
    # The level at which a node is computed for the last time: a column's own, or that of what it is a part of.
    steps = max(bound.values(), default=-1) + 1
    last = dict.fromkeys(order, -1) | dict.fromkeys(out.values(), steps)
    for n in reversed(order):
        for a in graph.arguments(n):
            last[a] = max(last[a], bound.get(n, last[n]))
    for k in range(steps):
        alive = [f"n{a}" for a in bound if bound[a] < k <= last[a]]
        frame = frame.select("image_id", "y", "x", *inputs, *alive, *[made[n].alias(f"n{n}") for n in bound if bound[n] == k])
    return frame.select("image_id", "y", "x", *[(F.col(f"n{n}") if n in bound else made[n]).alias(c) for c, n in out.items()])



def _power(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """As Spark's: 1 and -1 have no powers that aren't finite."""
    return np.where((np.abs(a) == 1) & ~np.isfinite(b), np.nan, np.power(a, b))


def _divided(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Zeros have no sign, here and as columns."""
    return np.divide(a, np.add(b, 0.0))


_NUMPY: dict[str, Callable] = {
    "neg": np.negative, "add": np.add, "sub": np.subtract, "mul": np.multiply, "div": _divided, "pow": _power, "min": np.fmin, "max": np.maximum, "floor": np.floor, "ceil": np.ceil, "rint": np.rint, "abs": np.abs, "sign": np.sign,
    "sqrt": np.sqrt, "exp": np.exp, "log": np.log, "atan2": lambda a, b: np.arctan2(a + 0.0, b + 0.0), "sin": np.sin, "cos": np.cos, "tan": np.tan, "asin": np.arcsin, "acos": np.arccos, "atan": np.arctan,
    "sinh": np.sinh, "cosh": np.cosh, "tanh": np.tanh, "asinh": np.arcsinh, "acosh": np.arccosh, "atanh": np.arctanh, "isnan": np.isnan, "isinf": np.isinf,
    "lt": np.less, "le": np.less_equal, "eq": np.equal, "and": np.logical_and, "or": np.logical_or, "not": np.logical_not, "select": np.where,
    "band": np.bitwise_and, "bor": np.bitwise_or, "bxor": np.bitwise_xor, "shl": lambda a, b: np.left_shift(a, b & 31), "shr": lambda a, b: np.right_shift(a, b & 31),
    "idiv": lambda a, b: np.where(b == 0, 0, np.sign(a) * np.sign(b) * (np.abs(a) // np.where(b == 0, 1, np.abs(b)))), "imod": lambda a, b: np.where(b == 0, 0, np.sign(a) * (np.abs(a) % np.where(b == 0, 1, np.abs(b)))),
    "float": lambda a: np.asarray(a, np.float64), "bool": lambda a: np.asarray(a) != 0, "int": lambda a: np.where(np.isfinite(a) & (np.abs(a) < 2.0**31), a, 0).astype(np.int64),
}


def as_arrays(graph: Graph, wanted: list[int], inputs: dict[str, np.ndarray], tap: Callable[[int, int, int, Callable[[int], np.ndarray]], np.ndarray], n: int, stops: bool = False) -> list[np.ndarray]:
    """The wanted nodes for n pixels. tap(u node, v node, channel, value of a node) answers taps; with `stops` it needs no places, so those aren't computed."""
    through = (lambda k: graph.nodes[k].op != "tap") if stops else (lambda k: True)
    order = graph.below(wanted, through)
    left = Counter(a for k in order if through(k) for a in graph.arguments(k))
    left.update(wanted)
    values: dict[int, np.ndarray] = {}
    with np.errstate(all="ignore"):
        for k in order:
            node = graph.nodes[k]
            if node.op == "const":
                values[k] = node.args[0]
            elif node.op == "input":
                values[k] = inputs[node.args[0]]
            elif node.op == "tap":
                values[k] = tap(*node.args, values.__getitem__)
            else:
                found = _NUMPY[node.op](*(values[a] for a in node.args))
                values[k] = (found + (1 << 31)) % (1 << 32) - (1 << 31) if node.kind == "int" else found
            for a in graph.arguments(k) if through(k) else ():
                left[a] -= 1
                if not left[a]:
                    del values[a]
        return [np.broadcast_to(np.asarray(values[k], {"float": np.float64, "int": np.int64, "bool": bool}[graph.kind(k)]), (n,)) for k in wanted]
