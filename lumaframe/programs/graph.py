"""A graph of scalar values: what a program computes for one pixel, whatever computes it then.

Equal values are one node, constants are folded. Inputs are u, v (the pixel's place), width, height (of the result), in_width, in_height,
x, y and the channels r, g, b, a of the pixel itself. A tap reads one channel of the image at a computed place.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

#: Nodes of a program at most; unrolled loops fill them.
MOST_NODES = 60_000


def _pow(x: float, y: float) -> float:
    return math.nan if x < 0 or x == 1 and not math.isfinite(y) else x**y


def _div(a: float, b: float) -> float:
    return a / b if b else math.nan if a == 0 or a != a else math.copysign(math.inf, a)


def _safe(f: Callable) -> Callable:
    def run(*x):
        try:
            return f(*x)
        except (ValueError, OverflowError, ZeroDivisionError):
            return math.nan

    return run


#: What constants fold by; all of them float functions but for the names at the end.
FOLD: dict[str, Callable] = {
    "neg": lambda a: -a, "add": lambda a, b: a + b, "sub": lambda a, b: a - b, "mul": lambda a, b: a * b, "div": _div, "pow": _safe(_pow),
    "min": min, "max": max, "floor": lambda a: float(math.floor(a)) if math.isfinite(a) else a, "ceil": lambda a: float(math.ceil(a)) if math.isfinite(a) else a,
    "rint": lambda a: float(round(a)) if math.isfinite(a) else a, "abs": abs, "sign": lambda a: float((a > 0) - (a < 0)), "sqrt": _safe(math.sqrt),
    "exp": _safe(math.exp), "log": lambda a: math.log(a) if a > 0 else -math.inf if a == 0 else math.nan, "atan2": lambda a, b: math.atan2(a + 0.0, b + 0.0),
    **{f: _safe(getattr(math, f)) for f in ("sin", "cos", "tan", "asin", "acos", "atan", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh")},
    "isnan": lambda a: a != a, "isinf": lambda a: abs(a) == math.inf,
    "lt": lambda a, b: a < b, "le": lambda a, b: a <= b, "eq": lambda a, b: a == b, "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a,
    "select": lambda c, a, b: a if c else b, "float": float, "int": lambda a: int(a) if math.isfinite(a) else 0, "bool": bool,
    "idiv": lambda a, b: (abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1) if b else 0, "imod": lambda a, b: a - b * ((abs(a) // abs(b)) * (1 if (a < 0) == (b < 0) else -1)) if b else 0,
    "band": lambda a, b: a & b, "bor": lambda a, b: a | b, "bxor": lambda a, b: a ^ b, "shl": lambda a, b: a << (b & 31), "shr": lambda a, b: a >> (b & 31),
}
BOOLEAN = {"isnan", "isinf", "lt", "le", "eq", "and", "or", "not", "bool"}
INTEGER = {"idiv", "imod", "band", "bor", "bxor", "shl", "shr", "int"}


@dataclass(frozen=True)
class Op:
    """op is const (args: its value), input (args: its name), tap (args: u, v, channel) or a name of FOLD; args are nodes."""

    op: str
    args: tuple
    kind: str


@dataclass(frozen=True)
class Affine:
    """c + u*U + v*V + x/width + y/height."""

    c: float = 0.0
    u: float = 0.0
    v: float = 0.0
    x: float = 0.0
    y: float = 0.0

    def plus(self, o: Affine, k: float = 1.0) -> Affine:
        return Affine(*(a + k * b for a, b in zip(self.parts, o.parts, strict=True)))

    def times(self, k: float) -> Affine:
        return Affine(*(a * k for a in self.parts))

    @property
    def parts(self) -> tuple[float, ...]:
        return self.c, self.u, self.v, self.x, self.y


class Full(Exception):
    """The graph has no room for another node."""


class Graph:
    def __init__(self):
        self.nodes: list[Op] = []
        self._known: dict[Op, int] = {}
        self._affine: list[Affine | None] = []

    def _node(self, op: str, args: tuple, kind: str) -> int:
        # -0.0 and 0.0, 1 and True are equal keys: the text of a constant tells them apart.
        key = Op(op, (repr(args[0]),) if op == "const" else args, kind)
        if key not in self._known:
            if len(self.nodes) >= MOST_NODES:
                raise Full
            self._known[key] = len(self.nodes)
            self.nodes.append(Op(op, args, kind))
            self._affine.append(self._sum_of_places(op, args))
        return self._known[key]

    def const(self, value: float | int | bool, kind: str) -> int:
        return self._node("const", ({"float": float, "int": int, "bool": bool}[kind](value),), kind)

    def input(self, name: str) -> int:
        return self._node("input", (name,), "int" if name in ("x", "y") else "float")

    def kind(self, n: int) -> str:
        return self.nodes[n].kind

    def value(self, n: int) -> float | int | bool | None:
        """The constant that a node is, or None."""
        return self.nodes[n].args[0] if self.nodes[n].op == "const" else None

    def make(self, op: str, *args: int) -> int:
        values = [self.value(a) for a in args]
        kind = "bool" if op in BOOLEAN else "int" if op in INTEGER else "float" if op == "float" else self.kind(args[-1])
        if None not in values:
            folded = FOLD[op](*values)
            if kind == "int":
                folded = (int(folded) + (1 << 31)) % (1 << 32) - (1 << 31)
            return self.const(folded, kind)
        one, two = (values + [None])[:2]
        if op == "select":
            if one is not None or args[1] == args[2]:
                return args[1] if one is not False else args[2]
            if kind == "bool" and values[1] is not None and values[2] is not None:
                return args[0] if values[1] else self.make("not", args[0])
        elif op in ("and", "or"):
            stops = op == "or"
            for a, b in (args, args[::-1]):
                if self.value(a) is not None:
                    return a if self.value(a) is stops else b
            if args[0] == args[1]:
                return args[0]
        elif op == "not" and self.nodes[args[0]].op == "not":
            return self.nodes[args[0]].args[0]
        elif op == "add" and 0 in (one, two):
            return args[1] if one == 0 else args[0]
        elif op == "sub" and two == 0 or op in ("mul", "div") and two == 1:
            return args[0]
        elif op == "mul" and one == 1:
            return args[1]
        elif op == self.kind(args[0]) and op in ("float", "int", "bool"):
            return args[0]
        return self._node(op, args, kind)

    def tap(self, u: int, v: int) -> list[int]:
        """The four channels of the image at (u, v)."""
        if self.offset(u, v) == (0.0, 0.0):
            return [self.input(c) for c in "rgba"]
        return [self._node("tap", (u, v, k), "float") for k in range(4)]

    def _sum_of_places(self, op: str, args: tuple) -> Affine | None:
        """A new node as a sum of constants, u, v and texels, if it is one."""
        if op == "const":
            return Affine(float(args[0])) if math.isfinite(args[0]) else None
        if op == "input":
            return {"u": Affine(u=1.0), "v": Affine(v=1.0)}.get(args[0])
        if op not in ("add", "sub", "mul", "neg", "div", "float"):
            return None
        parts = [self._affine[a] for a in args]
        if op == "div" and parts[0]:
            by = self.nodes[args[1]]
            if by.op == "const" and by.args[0]:
                return parts[0].times(1 / by.args[0])
            if by.op == "input" and not any(parts[0].parts[1:]):
                return {"width": Affine(x=parts[0].c), "height": Affine(y=parts[0].c)}.get(by.args[0])
        if op == "div" or None in parts:
            return None
        if op in ("neg", "float"):
            return parts[0].times(-1.0 if op == "neg" else 1.0)
        if op != "mul":
            return parts[0].plus(parts[1], 1.0 if op == "add" else -1.0)
        return next((b.times(a.c) for a, b in (parts, parts[::-1]) if not any(a.parts[1:])), None)

    def offset(self, u: int, v: int) -> tuple[float, float] | None:
        """How many pixels to the right and down a place lies from the pixel, if that is the same for all pixels of all images."""
        a, b = self._affine[u], self._affine[v]
        if a and b and (a.c, a.u, a.v, a.y) == (0, 1, 0, 0) and (b.c, b.u, b.v, b.x) == (0, 0, 1, 0):
            return a.x, b.y
        return None

    def below(self, tops: list[int], through: Callable[[int], bool] = lambda n: True) -> list[int]:
        """The nodes that tops need, arguments first; arguments of a node for which `through` is false aren't looked at."""
        seen: set[int] = set()
        stack = list(tops)
        while stack:
            n = stack.pop()
            if n not in seen:
                seen.add(n)
                if through(n):
                    stack += self.arguments(n)
        return sorted(seen)

    def arguments(self, n: int) -> tuple[int, ...]:
        node = self.nodes[n]
        return () if node.op in ("const", "input") else node.args[:2] if node.op == "tap" else node.args
