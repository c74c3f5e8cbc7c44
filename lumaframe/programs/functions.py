"""The functions a program can call, each a rule over the values given: the result, or None where their types don't fit."""

from __future__ import annotations

import math
from collections.abc import Callable
from typing import TYPE_CHECKING

from lumaframe.programs import lower
from lumaframe.programs.text import TYPES

if TYPE_CHECKING:
    from lumaframe.programs.lower import Lowering, Value

Rule = Callable[["Lowering", list["Value"]], "Value | None"]


def _floats(values: list[Value], n: int, kinds: tuple[str, ...] = ("float",)) -> bool:
    """n numbers or vectors of one kind, none of them arrays or matrices."""
    return len(values) == n and all(v.length is None and v.type in TYPES and TYPES[v.type][0] in kinds and not v.type.startswith("mat") for v in values) and len({TYPES[v.type][0] for v in values}) <= 1


def _alike(values: list[Value]) -> bool:
    """The first value's size holds for the others, which may also be single numbers."""
    return all(len(v.parts) in (1, len(values[0].parts)) for v in values)


def _constant(low: Lowering, x: float, like: Value | None = None) -> Value:
    kind = TYPES[like.type][0] if like else "float"
    return lower.Value(kind, (low.g.const(x, kind),))


def _each(op: str, n: int = 1, kinds: tuple[str, ...] = ("float",)) -> Rule:
    return lambda low, v: low.each(op, *v) if _floats(v, n, kinds) and _alike(v) else None


def _composed(n: int, build: Callable, kinds: tuple[str, ...] = ("float",)) -> Rule:
    """A function written with others: build gets a helper E(op, ...) that takes values and plain numbers."""

    def rule(low: Lowering, values: list[Value]) -> Value | None:
        if not _floats(values, n, kinds):
            return None
        wide = max(values, key=lambda v: len(v.parts))
        if any(len(v.parts) not in (1, len(wide.parts)) for v in values):
            return None
        return build(lambda op, *args: low.each(op, *(a if isinstance(a, lower.Value) else _constant(low, a, wide) for a in args)), *values)

    return rule


def _either(*rules: Rule) -> Rule:
    def rule(low: Lowering, values: list[Value]) -> Value | None:
        return next((out for r in rules if (out := r(low, values)) is not None), None)

    return rule


def _dot(low: Lowering, a: Value, b: Value) -> Value:
    return lower.Value("float", (low.sum([low.g.make("mul", x, y) for x, y in zip(a.parts, b.parts, strict=True)]),))


def _same(values: list[Value], n: int) -> bool:
    return _floats(values, n) and len({v.type for v in values}) == 1


def _length(low: Lowering, v: list[Value]) -> Value | None:
    return low.each("sqrt", _dot(low, v[0], v[0])) if _floats(v, 1) else None


def _distance(low: Lowering, v: list[Value]) -> Value | None:
    return _length(low, [low.each("sub", *v)]) if _same(v, 2) else None


def _cross(low: Lowering, v: list[Value]) -> Value | None:
    if not _same(v, 2) or v[0].type != "vec3":
        return None
    a, b, m = v[0].parts, v[1].parts, low.g.make
    return lower.Value("vec3", tuple(m("sub", m("mul", a[i], b[j]), m("mul", a[j], b[i])) for i, j in ((1, 2), (2, 0), (0, 1))))


def _reflect(low: Lowering, v: list[Value]) -> Value | None:
    if not _same(v, 2):
        return None
    return low.each("sub", v[0], low.each("mul", v[1], low.each("mul", _constant(low, 2), _dot(low, v[1], v[0]))))


def _refract(low: Lowering, v: list[Value]) -> Value | None:
    if len(v) != 3 or v[2].name != "float" or not _same(v[:2], 2):
        return None
    one, eta, d = _constant(low, 1), v[2], _dot(low, v[1], v[0])
    k = low.each("sub", one, low.each("mul", low.each("mul", eta, eta), low.each("sub", one, low.each("mul", d, d))))
    bent = low.each("sub", low.each("mul", v[0], eta), low.each("mul", v[1], low.each("add", low.each("mul", eta, d), low.each("sqrt", k))))
    zero = lower.Value(bent.type, (low.number(0),) * len(bent.parts))
    return low.merged(low.g.make("lt", k.parts[0], low.number(0)), zero, bent)


def _faceforward(low: Lowering, v: list[Value]) -> Value | None:
    return low.merged(low.g.make("lt", _dot(low, v[2], v[1]).parts[0], low.number(0)), v[0], low.each("neg", v[0])) if _same(v, 3) else None


def _mix_by_bool(low: Lowering, v: list[Value]) -> Value | None:
    """mix(a, b, condition): b where it holds."""
    if len(v) != 3 or not _floats(v[:2], 2, ("float", "int")) or v[0].type != v[1].type or v[2].length is not None or TYPES.get(v[2].type, ("", 0)) != ("bool", len(v[0].parts)):
        return None
    return lower.Value(v[0].type, tuple(low.g.make("select", c, b, a) for a, b, c in zip(v[0].parts, v[1].parts, v[2].parts, strict=True)))


def _compared(op: str, swapped: bool, negated: bool) -> Rule:
    def rule(low: Lowering, v: list[Value]) -> Value | None:
        if len(v) != 2 or v[0].name != v[1].name or len(v[0].parts) < 2 or not _floats(v, 2, ("float", "int", "bool") if op == "eq" else ("float", "int")):
            return None
        out = low.each(op, *(v[::-1] if swapped else v))
        return low.each("not", out) if negated else out

    return rule


def _joined(op: str) -> Rule:
    return lambda low, v: lower.Value("bool", (low.all_of(op, v[0].parts),)) if _floats(v, 1, ("bool",)) and len(v[0].parts) > 1 else None


def _transpose(low: Lowering, v: list[Value]) -> Value | None:
    if len(v) != 1 or v[0].length is not None or not v[0].type.startswith("mat"):
        return None
    n = math.isqrt(len(v[0].parts))
    return lower.Value(v[0].type, tuple(v[0].parts[column * n + row] for row in range(n) for column in range(n)))


def _minor(low: Lowering, cells: list[list[int]]) -> int:
    """The determinant by its first row."""
    if len(cells) == 1:
        return cells[0][0]
    m, out = low.g.make, None
    for k, c in enumerate(cells[0]):
        part = m("mul", c, _minor(low, [row[:k] + row[k + 1 :] for row in cells[1:]]))
        out = part if out is None else m("sub" if k % 2 else "add", out, part)
    return out


def _cells(v: list[Value]) -> list[list[int]] | None:
    if len(v) != 1 or v[0].length is not None or not v[0].type.startswith("mat"):
        return None
    n = math.isqrt(len(v[0].parts))
    return [[v[0].parts[column * n + row] for column in range(n)] for row in range(n)]


def _determinant(low: Lowering, v: list[Value]) -> Value | None:
    cells = _cells(v)
    return lower.Value("float", (_minor(low, cells),)) if cells else None


def _inverse(low: Lowering, v: list[Value]) -> Value | None:
    cells = _cells(v)
    if not cells:
        return None
    n, m = len(cells), low.g.make
    whole = _minor(low, cells)
    without = lambda row, column: _minor(low, [r[:column] + r[column + 1 :] for k, r in enumerate(cells) if k != row])
    # The cell of the inverse at (row, column) is the signed minor at (column, row) over the determinant.
    return lower.Value(v[0].type, tuple(m("div", without(column, row) if (row + column) % 2 == 0 else m("neg", without(column, row)), whole) for column in range(n) for row in range(n)))


def _outer(low: Lowering, v: list[Value]) -> Value | None:
    if not _same(v, 2) or len(v[0].parts) == 1:
        return None
    return lower.Value(f"mat{len(v[0].parts)}", tuple(low.g.make("mul", a, b) for b in v[1].parts for a in v[0].parts))


def _taken(low: Lowering, v: list[Value]) -> Value | None:
    """sampleInput(place): borders repeat outside, so pulling the place to the border changes nothing."""
    if [x.name for x in v] != ["vec2"]:
        return None
    return lower.Value("vec4", tuple(low.g.tap(*v[0].parts) if low.same_size else [low.g._node("tap", (*v[0].parts, k), "float") for k in range(4)]))


def _texture(low: Lowering, v: list[Value]) -> Value | None:
    """texture(inputTexture, place); a level or bias changes nothing, as there is one level."""
    names = [x.name for x in v]
    return _taken(low, v[1:2]) if names in (["sampler2D", "vec2"], ["sampler2D", "vec2", "float"]) else None


def _texel(low: Lowering, v: list[Value]) -> Value | None:
    """texelFetch(inputTexture, cell, 0): the middle of a pixel, 0 outside."""
    if [x.name for x in v] != ["sampler2D", "ivec2", "int"]:
        return None
    m, size = low.g.make, [low.g.input(n) for n in (("width", "height") if low.same_size else ("in_width", "in_height"))]
    place, inside = [], low.true
    for cell, n in zip(v[1].parts, size, strict=True):
        at = m("float", cell)
        place.append(m("div", m("add", at, low.number(0.5)), n))
        inside = m("and", inside, m("and", m("le", low.number(0), at), m("lt", at, n)))
    found = _taken(low, [lower.Value("vec2", tuple(place))])
    return low.merged(inside, found, lower.Value("vec4", (low.number(0),) * 4))


def _texture_size(low: Lowering, v: list[Value]) -> Value | None:
    if [x.name for x in v] != ["sampler2D", "int"]:
        return None
    return lower.Value("ivec2", tuple(low.g.make("int", low.g.input(n)) for n in (("width", "height") if low.same_size else ("in_width", "in_height"))))


def _luminance(low: Lowering, v: list[Value]) -> Value | None:
    return _dot(low, v[0], lower.Value("vec3", tuple(map(low.number, lower.LUMINANCE)))) if [x.name for x in v] == ["vec3"] else None


def _transfer(limit: float, below: Callable, above: Callable) -> Rule:
    """One of the sRGB transfers on a vec3, negatives first pulled to 0."""
    curve = _composed(1, lambda e, x: _pieces(e, e("max", x, 0.0), limit, below, above))
    return lambda low, v: curve(low, v) if [x.name for x in v] == ["vec3"] else None


def _pieces(e, x, limit, below, above):
    return e("select", e("lt", x, limit), below(e, x), above(e, x))


def _texel_size(low: Lowering, v: list[Value]) -> Value | None:
    return lower.Value("vec2", tuple(low.g.make("div", low.number(1), low.g.input(n)) for n in ("width", "height"))) if not v else None


def _smoothstep(e, a, b, x):
    t = e("min", e("max", e("div", e("sub", x, a), e("sub", b, a)), 0.0), 1.0)
    return e("mul", e("mul", t, t), e("sub", 3.0, e("mul", 2.0, t)))


_NUMBERS = ("float", "int")

FUNCTIONS: dict[str, Rule] = {
    **{f: _each(f) for f in ("sin", "cos", "tan", "asin", "acos", "sinh", "cosh", "tanh", "asinh", "acosh", "atanh", "exp", "log", "sqrt", "floor", "ceil", "isnan", "isinf")},
    "atan": _either(_each("atan"), _each("atan2", 2)),
    "roundEven": _each("rint"),
    "abs": _each("abs", 1, _NUMBERS), "sign": _each("sign", 1, _NUMBERS),
    "min": _each("min", 2, _NUMBERS), "max": _each("max", 2, _NUMBERS),
    "pow": lambda low, v: low.each("pow", *v) if _same(v, 2) else None,
    "radians": _composed(1, lambda e, x: e("mul", x, math.pi / 180)), "degrees": _composed(1, lambda e, x: e("mul", x, 180 / math.pi)),
    "exp2": _composed(1, lambda e, x: e("pow", 2.0, x)), "log2": _composed(1, lambda e, x: e("div", e("log", x), math.log(2))),
    "inversesqrt": _composed(1, lambda e, x: e("div", 1.0, e("sqrt", x))),
    "trunc": _composed(1, lambda e, x: e("mul", e("sign", x), e("floor", e("abs", x)))), "round": _composed(1, lambda e, x: e("floor", e("add", x, 0.5))),
    "fract": _composed(1, lambda e, x: e("sub", x, e("floor", x))),
    "mod": _composed(2, lambda e, x, y: e("sub", x, e("mul", y, e("floor", e("div", x, y))))),
    "clamp": _composed(3, lambda e, x, a, b: e("min", e("max", x, a), b), _NUMBERS),
    "mix": _either(_mix_by_bool, _composed(3, lambda e, a, b, t: e("add", e("mul", a, e("sub", 1.0, t)), e("mul", b, t)))),
    "step": _composed(2, lambda e, edge, x: e("select", e("lt", x, edge), 0.0, 1.0)),
    "smoothstep": _composed(3, _smoothstep),
    "length": _length, "distance": _distance, "cross": _cross, "reflect": _reflect, "refract": _refract, "faceforward": _faceforward,
    "dot": lambda low, v: _dot(low, *v) if _same(v, 2) else None,
    "normalize": lambda low, v: low.each("div", v[0], _length(low, v)) if _floats(v, 1) else None,
    "any": _joined("or"), "all": _joined("and"), "not": lambda low, v: low.each("not", v[0]) if _floats(v, 1, ("bool",)) and len(v[0].parts) > 1 else None,
    **{name: _compared(*how) for name, how in lower.COMPARE.items()},
    "transpose": _transpose, "determinant": _determinant, "inverse": _inverse, "outerProduct": _outer,
    "matrixCompMult": lambda low, v: low.each("mul", *v) if len(v) == 2 and v[0].name == v[1].name and v[0].type.startswith("mat") else None,
    "texture": _texture, "textureLod": _texture, "texelFetch": _texel, "textureSize": _texture_size,
    "sampleInput": _taken, "texelSize": _texel_size, "luminance": _luminance,
    "srgbToLinear": _transfer(lower.TO_LINEAR, lambda e, x: e("div", x, lower.SLOPE), lambda e, x: e("pow", e("div", e("add", x, lower.SHIFT), lower.SCALE), lower.POWER)),
    "linearToSrgb": _transfer(lower.TO_SRGB, lambda e, x: e("mul", x, lower.SLOPE), lambda e, x: e("sub", e("mul", lower.SCALE, e("pow", x, 1.0 / lower.POWER)), lower.SHIFT)),
}
