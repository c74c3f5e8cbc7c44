"""From statements to a graph: types are checked, branches become choices, loops of constant bounds are unrolled, functions are inlined."""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from typing import NoReturn

from lumaframe.programs.graph import Full, Graph
from lumaframe.programs.text import TYPES, Node, ShaderError, parse

#: Rounds of a loop, and of all loops together, at most.
MOST_ROUNDS, ALL_ROUNDS = 4096, 20_000
SWIZZLES = ("xyzw", "rgba", "stpq")
PREFIX = {"float": "", "int": "i", "bool": "b"}
COMPARE = {"lessThan": ("lt", False, False), "lessThanEqual": ("le", False, False), "greaterThan": ("lt", True, False), "greaterThanEqual": ("le", True, False), "equal": ("eq", False, False), "notEqual": ("eq", False, True)}

# Luminance weights and the constants of the sRGB transfer.
LUMINANCE = (0.2126, 0.7152, 0.0722)
TO_LINEAR, TO_SRGB, SLOPE, SCALE, SHIFT, POWER = 0.04045, 0.0031308, 12.92, 1.055, 0.055, 2.4


@dataclass(frozen=True)
class Value:
    """Components and their type; `length` where it is an array, whose components are then those of its elements."""

    type: str
    parts: tuple[int, ...]
    length: int | None = None

    @property
    def name(self) -> str:
        return self.type + (f"[{self.length}]" if self.length is not None else "")


@dataclass
class Variable:
    value: Value
    #: The condition under which the variable was declared: an assignment under the same one replaces the value.
    mask: int
    constant: bool = False


@dataclass
class Loop:
    broken: int
    skipped: int


def changes(node: object) -> bool:
    """Whether evaluating a node assigns anything."""
    if isinstance(node, Node):
        return node.kind in ("assign", "step") or any(map(changes, node.parts))
    return isinstance(node, tuple) and any(map(changes, node))


def vector(kind: str, size: int) -> str:
    return kind if size == 1 else f"{PREFIX[kind]}vec{size}"


@dataclass
class Program:
    """A program: its graph and the nodes of r, g, b and a."""

    graph: Graph
    out: list[int]
    #: Whether result and image have the same size, so that a pixel's own values are inputs.
    same_size: bool = True

    def taps(self) -> list[int]:
        """The places (u, v) that are read, as nodes of taps, one for each place."""
        found = {}
        for n in self.graph.below(self.out):
            node = self.graph.nodes[n]
            if node.op == "tap":
                found.setdefault(node.args[:2], n)
        return list(found.values())

    def inputs(self, through=lambda n: True) -> set[str]:
        return {self.graph.nodes[n].args[0] for n in self.graph.below(self.out, through) if self.graph.nodes[n].op == "input"}


class Lowering:
    def __init__(self, same_size: bool):
        self.g = Graph()
        self.same_size = same_size
        self.true = self.g.const(True, "bool")
        self.mask, self.done = self.true, self.g.const(False, "bool")
        self.loops: list[Loop] = []
        self.rounds = 0
        number = lambda x: self.g.const(x, "float")
        pair = lambda a, b: Value("vec2", (self.g.input(a), self.g.input(b)))
        uv, size = pair("u", "v"), pair("width", "height")
        own = self.g.tap(*uv.parts) if same_size else [self.g._node("tap", (*uv.parts, k), "float") for k in range(4)]
        x, y = (self.g.make("add", self.g.make("float", self.g.input(c)), number(0.5)) for c in "xy")
        fixed = {"uv": uv, "inputColor": Value("vec4", tuple(own)), "resolution": size, "inputResolution": size if same_size else pair("in_width", "in_height"), "time": Value("float", (number(0),)), "gl_FragCoord": Value("vec4", (x, y, number(0), number(1))), "inputTexture": Value("sampler2D", ())}
        self.scopes = [{k: Variable(v, self.true, k not in ("uv", "inputColor")) for k, v in fixed.items()}]
        self.scopes[0]["outputColor"] = Variable(Value("vec4", (number(0), number(0), number(0), number(1))), self.true)

    # Values

    def fail(self, message: str, node: Node) -> NoReturn:
        raise ShaderError(message, node.at)

    def number(self, x: float) -> int:
        return self.g.const(x, "float")

    def constant(self, node: Node | None, what: str) -> int:
        value = self.expression(node)
        n = self.g.value(value.parts[0]) if value.type == "int" and value.length is None else None
        if n is None:
            self.fail(f"{what} must be a constant int", node)
        return n

    def each(self, op: str, *values: Value) -> Value:
        """op on each component; single numbers go with all components of the others."""
        size = max(len(v.parts) for v in values)
        spread = [v.parts * size if len(v.parts) == 1 else v.parts for v in values]
        parts = tuple(self.g.make(op, *c) for c in zip(*spread, strict=True))
        widest = next(v for v in values if len(v.parts) == size)
        kind = self.g.kind(parts[0])
        return Value(widest.type if widest.type.startswith("mat") else vector(kind, size), parts)

    def merged(self, mask: int, new: Value, old: Value) -> Value:
        return new if mask == self.true else Value(new.type, tuple(self.g.make("select", mask, a, b) for a, b in zip(new.parts, old.parts, strict=True)), new.length)

    def active(self) -> int:
        """The condition under which the statement at hand runs."""
        mask = self.g.make("and", self.mask, self.g.make("not", self.done))
        for loop in self.loops:
            mask = self.g.make("and", mask, self.g.make("not", self.g.make("or", loop.broken, loop.skipped)))
        return mask

    def find(self, node: Node, name: str) -> Variable:
        for scope in reversed(self.scopes):
            if name in scope:
                return scope[name]
        self.fail(f"{name!r} is not declared", node)

    # Statements

    def run(self, statements: list[Node]) -> None:
        for s in statements:
            self.statement(s)

    def statement(self, s: Node) -> None:
        if self.g.value(self.active()) is False:
            return
        getattr(self, "_" + s.kind.replace(" ", "_"))(s)

    def _block(self, s: Node) -> None:
        self.scopes.append({})
        self.run(list(s.parts))
        self.scopes.pop()

    def _several(self, s: Node) -> None:
        for part in s.parts:
            self._declare(part)

    def _declare(self, s: Node) -> None:
        kind, size, name, start, constant = s.parts
        value = self.expression(start) if start is not None else None
        if size is None:
            length = None
        elif size == "":
            length = value.length if value else self.fail(f"{name} needs a size", s)
        else:
            length = self.constant(size, "the size of an array")
            if not 0 < length <= 4096:
                self.fail("an array has 1 to 4096 elements", s)
        base, n = TYPES[kind]
        wanted = Value(kind, (self.g.const(0, base),) * (n * (length or 1)), length)
        if value is None:
            if constant:
                self.fail(f"{name} is const and needs a value", s)
            value = wanted
        if value.name != wanted.name:
            self.fail(f"{name} is {wanted.name}, its value is {value.name}", s)
        if name in self.scopes[-1] or len(self.scopes) == 2 and name in ("uv", "inputColor", "outputColor"):
            self.fail(f"{name!r} is declared already", s)
        self.scopes[-1][name] = Variable(value, self.active(), constant)

    def _do_expression(self, s: Node) -> None:
        self.expression(s.parts[0], unused=True)

    def condition(self, node: Node) -> int:
        value = self.expression(node)
        if value.name != "bool":
            self.fail(f"a condition must be bool, not {value.name}", node)
        return value.parts[0]

    def _if(self, s: Node) -> None:
        condition, then, other = s.parts
        c = self.condition(condition)
        before = self.mask
        for branch, when in ((then, c), (other, self.g.make("not", c))):
            if branch is not None and self.g.value(when) is not False:
                self.mask = self.g.make("and", before, when)
                self._block(Node("block", branch.at, (branch,)))
        self.mask = before

    def _for(self, s: Node) -> None:
        first, condition, step, body = s.parts
        self.scopes.append({})
        if first is not None:
            self.statement(first)
        self._rounds(s, condition, step, body, False)
        self.scopes.pop()

    def _do(self, s: Node) -> None:
        body, condition = s.parts
        self._rounds(s, condition, None, body, True)

    def _rounds(self, s: Node, condition: Node | None, step: Node | None, body: Node, body_first: bool) -> None:
        no = self.g.const(False, "bool")
        loop = Loop(no, no)
        for k in range(MOST_ROUNDS + 1):
            if condition is not None and (k or not body_first):
                c = self.condition(condition)
                if self.g.value(c) is False:
                    break
                if self.g.value(c) is None:
                    self.fail("the rounds of a loop must follow from constants; use a constant bound and break", condition)
            self.rounds += 1
            if k == MOST_ROUNDS or self.rounds > ALL_ROUNDS:
                self.fail(f"a loop has {MOST_ROUNDS} rounds at most, all together {ALL_ROUNDS}", s)
            loop.skipped = no
            self.loops.append(loop)
            self._block(Node("block", body.at, (body,)))
            self.loops.pop()
            if self.g.value(loop.broken) is True or self.g.value(self.active()) is False:
                break
            if step is not None:
                self.expression(step, unused=True)

    def _jump(self, s: Node) -> None:
        (word,) = s.parts
        if word == "return":
            self.done = self.g.make("or", self.done, self.active())
            return
        if not self.loops:
            self.fail(f"{word} stands outside of a loop", s)
        loop = self.loops[-1]
        # What the loop's own flags already hold off isn't stopped anew.
        if word == "break":
            loop.broken = self.g.make("or", loop.broken, self.active())
        else:
            loop.skipped = self.g.make("or", loop.skipped, self.active())

    # Expressions

    def expression(self, node: Node, unused: bool = False) -> Value:
        value = getattr(self, "_x_" + node.kind)(node)
        if not unused and value.type == "void":
            self.fail("a value is needed here", node)
        return value

    def _x_literal(self, node: Node) -> Value:
        value, kind = node.parts
        if kind == "int" and value >= 1 << 32:
            self.fail("a number is too large for int", node)
        return Value(kind, (self.g.const((value + (1 << 31)) % (1 << 32) - (1 << 31) if kind == "int" else value, kind),))

    def _x_name(self, node: Node) -> Value:
        return self.find(node, node.parts[0]).value

    def _x_comma(self, node: Node) -> Value:
        self.expression(node.parts[0], unused=True)
        return self.expression(node.parts[1])

    def _x_choose(self, node: Node) -> Value:
        if changes(node.parts[1:]):
            self.fail("the values of ?: can't assign anything", node)
        c = self.condition(node.parts[0])
        a, b = (self.expression(p) for p in node.parts[1:])
        if a.name != b.name:
            self.fail(f"both values of ?: must have one type, not {a.name} and {b.name}", node)
        return self.merged(c, a, b)

    def _x_unary(self, node: Node) -> Value:
        sign, operand = node.parts
        v = self.expression(operand)
        kind = TYPES.get(v.type, (None,))[0]
        if v.length is not None or (kind != "bool" or len(v.parts) > 1 if sign == "!" else kind not in ("int", "float")) or sign == "~" and kind != "int":
            self.fail(f"{sign} can't be used on {v.name}", node)
        if sign == "+":
            return v
        if sign == "~":
            return self.each("sub", self.each("neg", v), Value("int", (self.g.const(1, "int"),)))
        return self.each("not" if sign == "!" else "neg", v)

    def _x_binary(self, node: Node) -> Value:
        sign, left, right = node.parts
        if sign in ("&&", "||") and changes(right):
            self.fail(f"what stands right of {sign} can't assign anything", node)
        a, b = self.expression(left), self.expression(right)
        return self.combined(sign, a, b, node)

    def combined(self, sign: str, a: Value, b: Value, node: Node) -> Value:
        bad = f"{sign} can't be used on {a.name} and {b.name}"
        if sign in ("==", "!="):
            if a.name != b.name or a.type not in TYPES:
                self.fail(bad, node)
            out = self.all_of("and", self.each("eq", *(Value(vector(TYPES[a.type][0], len(v.parts)), v.parts) for v in (a, b))).parts) if len(a.parts) <= 4 else self.all_of("and", [self.g.make("eq", x, y) for x, y in zip(a.parts, b.parts, strict=True)])
            return Value("bool", (self.g.make("not", out) if sign == "!=" else out,))
        if a.length is not None or b.length is not None or a.type not in TYPES or b.type not in TYPES:
            self.fail(bad, node)
        kind, other = TYPES[a.type][0], TYPES[b.type][0]
        if sign in ("&&", "||", "^^"):
            if a.type != "bool" or b.type != "bool":
                self.fail(bad, node)
            if sign == "^^":
                return self.each("not", self.each("eq", a, b))
            return self.each("and" if sign == "&&" else "or", a, b)
        if kind != other or kind == "bool":
            self.fail(bad, node)
        if sign in ("<", ">", "<=", ">="):
            if len(a.parts) > 1 or len(b.parts) > 1:
                self.fail(bad, node)
            a, b = (a, b) if sign[0] == "<" else (b, a)
            return self.each("le" if sign[1:] else "lt", a, b)
        matrices = a.type.startswith("mat"), b.type.startswith("mat")
        if sign == "*" and any(matrices) and len(a.parts) > 1 and len(b.parts) > 1:
            return self.product(a, b, matrices) or self.fail(bad, node)
        if len(a.parts) > 1 and len(b.parts) > 1 and a.type != b.type:
            self.fail(bad, node)
        op = {"+": "add", "-": "sub", "*": "mul", "/": "idiv" if kind == "int" else "div", "%": "imod", "&": "band", "|": "bor", "^": "bxor", "<<": "shl", ">>": "shr"}[sign]
        if kind == "float" and sign in ("%", "&", "|", "^", "<<", ">>"):
            self.fail(bad, node)
        return self.each(op, a, b)

    def product(self, a: Value, b: Value, matrices: tuple[bool, bool]) -> Value | None:
        """Matrix times vector, vector times matrix, matrix times matrix; columns come one after another."""
        n = math.isqrt(len(a.parts if matrices[0] else b.parts))
        if any(len(v.parts) != (n * n if m else n) for v, m in zip((a, b), matrices, strict=True)):
            return None
        cell = lambda v, m, row, column, as_row: v.parts[column * n + row] if m else v.parts[column if as_row else row]
        total = lambda row, column: self.sum([self.g.make("mul", cell(a, matrices[0], row, k, True), cell(b, matrices[1], k, column, False)) for k in range(n)])
        if all(matrices):
            return Value(a.type, tuple(total(row, column) for column in range(n) for row in range(n)))
        return Value(f"vec{n}", tuple(total(k, 0) if matrices[0] else total(0, k) for k in range(n)))

    def sum(self, parts: list[int]) -> int:
        return self.all_of("add", parts)

    def all_of(self, op: str, parts) -> int:
        out = parts[0]
        for p in parts[1:]:
            out = self.g.make(op, out, p)
        return out

    # Places that can be assigned to

    def places(self, node: Node) -> tuple[str, list[int] | None, Value, int | None, Node | None]:
        """(variable, its components meant, their value as it is, None, None), or with a dynamic index: (variable, None, value, width, index)."""
        if node.kind == "name":
            v = self.find(node, node.parts[0]).value
            return node.parts[0], list(range(len(v.parts))), v, None, None
        if node.kind not in ("member", "index"):
            self.fail("this can't be assigned to", node)
        name, at, v, *dynamic = self.places(node.parts[0])
        if dynamic[1] is not None:
            self.fail("only one index of a place may vary", node)
        if node.kind == "member":
            picks = self.swizzle(v, node)
            if len(set(picks)) < len(picks):
                self.fail("a component is named twice", node)
            return name, [at[k] for k in picks], Value(vector(TYPES[v.type][0], len(picks)), tuple(v.parts[k] for k in picks)), None, None
        if changes(node.parts[1]):
            self.fail("the index of a place can't assign anything", node)
        element, width = self.element(v, node)
        k = self.index_value(node, len(v.parts) // width)
        if isinstance(k, int):
            return name, at[k * width : (k + 1) * width], Value(element, v.parts[k * width : (k + 1) * width]), None, None
        return name, at, Value(element, self.pick(v, width, k)), width, node

    def swizzle(self, v: Value, node: Node) -> list[int]:
        letters = node.parts[1]
        kind, size = TYPES.get(v.type, (None, 0))
        if v.length is None and kind and not v.type.startswith("mat") and size > 1:
            for family in SWIZZLES:
                if 0 < len(letters) <= 4 and all(c in family[:size] for c in letters):
                    return [family.index(c) for c in letters]
        self.fail(f"{v.name} has no component {letters!r}", node)

    def element(self, v: Value, node: Node) -> tuple[str, int]:
        if v.length is not None:
            return v.type, TYPES[v.type][1]
        if v.type.startswith("mat"):
            return f"vec{v.type[3]}", int(v.type[3])
        if v.type in TYPES and TYPES[v.type][1] > 1:
            return TYPES[v.type][0], 1
        self.fail(f"{v.name} has no elements", node)

    def index_value(self, node: Node, size: int) -> int | Value:
        index = self.expression(node.parts[1])
        if index.name != "int":
            self.fail(f"an index must be int, not {index.name}", node)
        k = self.g.value(index.parts[0])
        if k is not None and not 0 <= k < size:
            self.fail(f"index {k} is not in 0..{size - 1}", node)
        return index if k is None else k

    def pick(self, v: Value, width: int, index: Value) -> tuple[int, ...]:
        """The element at a varying index; one beyond the ends is the last."""
        out = v.parts[-width:]
        for k in range(len(v.parts) // width - 2, -1, -1):
            same = self.g.make("eq", index.parts[0], self.g.const(k, "int"))
            out = tuple(self.g.make("select", same, a, b) for a, b in zip(v.parts[k * width : (k + 1) * width], out, strict=True))
        return out

    def assign(self, node: Node, new: Value) -> None:
        name, at, old, width, index_node = self.places(node)
        if new.name != old.name:
            self.fail(f"{old.name} can't take {new.name}", node)
        variable = self.find(node, name)
        if variable.constant:
            self.fail(f"{name} can't be changed", node)
        parts = list(variable.value.parts)
        if width is None:
            for k, p in zip(at, new.parts, strict=True):
                parts[k] = p
        else:
            index = self.expression(index_node.parts[1])
            for k in range(len(at) // width):
                same = self.g.make("eq", index.parts[0], self.g.const(k, "int"))
                for j in range(width):
                    parts[at[k * width + j]] = self.g.make("select", same, new.parts[j], parts[at[k * width + j]])
        value, mask = Value(variable.value.type, tuple(parts), variable.value.length), self.active()
        variable.value = value if mask == variable.mask else self.merged(mask, value, variable.value)

    def _x_assign(self, node: Node) -> Value:
        sign, target, source = node.parts
        value = self.expression(source)
        if sign:
            value = self.combined(sign, self.places(target)[2], value, node)
        self.assign(target, value)
        return value

    def _x_step(self, node: Node) -> Value:
        sign, target, first = node.parts
        old = self.places(target)[2]
        kind = TYPES.get(old.type, ("bool",))[0]
        if kind == "bool" or old.length is not None:
            self.fail(f"{sign} can't be used on {old.name}", node)
        new = self.each("add" if sign == "++" else "sub", old, Value(kind, (self.g.const(1, kind),)))
        self.assign(target, new)
        return new if first else old

    def _x_member(self, node: Node) -> Value:
        if node.parts[1] == "length":
            self.fail("length is called with ()", node)
        v = self.expression(node.parts[0])
        picks = self.swizzle(v, node)
        return Value(vector(TYPES[v.type][0], len(picks)), tuple(v.parts[k] for k in picks))

    def _x_index(self, node: Node) -> Value:
        v = self.expression(node.parts[0])
        element, width = self.element(v, node)
        k = self.index_value(node, len(v.parts) // width)
        return Value(element, v.parts[k * width : (k + 1) * width] if isinstance(k, int) else self.pick(v, width, k))

    # Calls

    def _x_call(self, node: Node) -> Value:
        name, arguments, size = node.parts
        given = [self.expression(a) for a in arguments]
        if name in TYPES:
            return self.array(name, size, given, node) if size is not None else self.constructed(name, given, node)
        from lumaframe.programs.functions import FUNCTIONS

        rule = FUNCTIONS.get(name) or self.fail(f"{name!r} is not a function", node)
        value = rule(self, given)
        if value is None:
            self.fail(f"{name} can't take ({', '.join(v.name for v in given)})", node)
        return value

    def array(self, kind: str, size: Node | str, given: list[Value], node: Node) -> Value:
        length = len(given) if size == "" else self.constant(size, "the size of an array")
        if length != len(given) or any(v.name != kind for v in given):
            self.fail(f"{kind}[{length}] takes {length} values of {kind}", node)
        return Value(kind, tuple(p for v in given for p in v.parts), length)

    def constructed(self, name: str, given: list[Value], node: Node) -> Value:
        kind, size = TYPES[name]
        if not given or any(v.length is not None or v.type not in TYPES for v in given):
            self.fail(f"{name} can't be made of ({', '.join(v.name for v in given)})", node)
        matrix = name.startswith("mat")
        if len(given) == 1 and (source := given[0]):
            if matrix and (len(source.parts) == 1 or source.type.startswith("mat")):
                n = int(name[3])
                m = math.isqrt(len(source.parts))
                zero, one = self.number(0), self.number(1)
                cell = lambda row, column: (source.parts[0] if row == column else zero) if m == 1 else source.parts[column * m + row] if max(row, column) < m else one if row == column else zero
                return Value(name, tuple(self.converted(cell(row, column), "float") for column in range(n) for row in range(n)))
            if len(source.parts) == 1:
                return Value(name, (self.converted(source.parts[0], kind),) * size)
            if not matrix and len(source.parts) >= size:
                return Value(name, tuple(self.converted(p, kind) for p in source.parts[:size]))
        parts = [self.converted(p, kind) for v in given for p in v.parts]
        unused = len(parts) - size
        if unused < 0 or unused >= len(given[-1].parts) or matrix and unused:
            self.fail(f"{name} has {size} components, {len(parts)} are given", node)
        return Value(name, tuple(parts[:size]))

    def converted(self, part: int, kind: str) -> int:
        return part if self.g.kind(part) == kind else self.g.make(kind, part)


def compile_program(code: str, same_size: bool = True) -> Program:
    """The graph of a program's text. Errors name line and column of the text.

    With same_size the result has the size of the image, so that inputColor is the pixel itself and places a constant number of pixels away are known as such.
    """
    lowering = Lowering(same_size)
    statements = parse(code)
    lowering.scopes.append({})
    at = statements[0].at if statements else (1, 1)
    try:
        for s in statements:
            at = s.at
            lowering.statement(s)
    except Full:
        raise ShaderError("the program is too large once its loops are unrolled", at) from None
    except RecursionError:
        raise ShaderError("nested too deeply", at) from None
    return Program(lowering.g, list(lowering.scopes[0]["outputColor"].value.parts), same_size)
