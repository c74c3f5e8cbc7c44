"""Program texts: words, and the statements and expressions they make, each with its line and column.

A text is the body of one function over `uv` and `inputColor` that assigns `outputColor`, in the shading language's ES 3.00 form:
declarations, assignments, swizzles, calls, if, for, while, do, break, continue, return, and macros by #define.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import NoReturn

SCALARS = {"float": 1, "int": 1, "bool": 1}
#: Type names with the kind and number of their components; a matrix has its columns one after another.
TYPES = {k: (k, 1) for k in SCALARS} | {f"{p}vec{n}": (k, n) for p, k in (("", "float"), ("i", "int"), ("b", "bool")) for n in (2, 3, 4)} | {f"mat{n}": ("float", n * n) for n in (2, 3, 4)}
QUALIFIERS = {"const", "highp", "mediump", "lowp"}
JUMPS = {"break", "continue", "return"}

WORDS = re.compile(
    r"(?P<space>[ \t\r\n\f\v]+|//[^\n]*|/\*.*?\*/)|(?P<float>(?:\d+\.\d*|\.\d+)(?:[eE][+-]?\d+)?[fF]?|\d+[eE][+-]?\d+[fF]?)|(?P<int>0[xX][0-9a-fA-F]+|\d+)"
    r"|(?P<name>[A-Za-z_]\w*)|(?P<sign><<=|>>=|\+\+|--|<=|>=|==|!=|&&|\|\||\^\^|[-+*/%]=|<<|>>|[-+*/%<>=!?:;,.(){}\[\]&|^~])",
    re.S,
)
#: Binary signs from the loosest to the tightest.
LEVELS = (("||",), ("^^",), ("&&",), ("|",), ("^",), ("&",), ("==", "!="), ("<", ">", "<=", ">="), ("<<", ">>"), ("+", "-"), ("*", "/", "%"))
TIGHTNESS = {sign: k for k, signs in enumerate(LEVELS) for sign in signs}
ASSIGNMENTS = ("=", "+=", "-=", "*=", "/=", "%=")
#: Nested parentheses, blocks and macros at most.
DEPTH = 40


class ShaderError(ValueError):
    """A program's text can't be used. line and column count from 1, in the text that the user wrote."""

    def __init__(self, message: str, at: tuple[int, int]):
        super().__init__(f"line {at[0]}, column {at[1]}: {message}")
        self.line, self.column, self.reason = *at, message


@dataclass(frozen=True)
class Word:
    kind: str
    text: str
    at: tuple[int, int]


@dataclass(frozen=True)
class Node:
    """A statement or expression: what it is, where it stands, its parts."""

    kind: str
    at: tuple[int, int]
    parts: tuple


def _plain_words(text: str, line: int = 1, column: int = 1) -> list[Word]:
    out, at = [], 0
    while at < len(text):
        m = WORDS.match(text, at)
        if not m or text.startswith("/*", at) and m.lastgroup != "space":
            raise ShaderError(f"unexpected character {text[at]!r}" if not m else "a comment has no end", (line, column))
        if m.lastgroup != "space":
            out.append(Word(m.lastgroup, m[0], (line, column)))
        newlines = m[0].count("\n")
        line, column = line + newlines, (len(m[0]) - m[0].rfind("\n") if newlines else column + len(m[0]))
        at = m.end()
    return out


class _Macros:
    """#define with and without parameters; other directives are refused."""

    def __init__(self):
        self.known: dict[str, tuple[list[str] | None, list[Word]]] = {}

    def define(self, line: str, at: tuple[int, int]) -> None:
        m = re.match(r"\s*#\s*define\s+([A-Za-z_]\w*)(\(([^)]*)\))?(.*)", line, re.S)
        if not m:
            if re.match(r"\s*#\s*(undef\s|$)", line) and (name := line.split("undef")[-1].strip()):
                self.known.pop(name, None)
                return
            raise ShaderError(f"directive {line.strip().split()[0]!r} isn't supported", at)
        parameters = [p.strip() for p in m[3].split(",") if p.strip()] if m[2] else None
        self.known[m[1]] = parameters, _plain_words(m[4], *at)

    def expand(self, words: list[Word], active: tuple[str, ...] = ()) -> list[Word]:
        out, k = [], 0
        while k < len(words):
            w = words[k]
            found = self.known.get(w.text) if w.kind == "name" and w.text not in active else None
            k += 1
            if not found or found[0] is not None and (k == len(words) or words[k].text != "("):
                out.append(w)
                continue
            if len(active) > DEPTH:
                raise ShaderError("macros are nested too deeply", w.at)
            parameters, body = found
            if parameters is None:
                given = {}
            else:
                arguments, depth, k = [[]], 1, k + 1
                while depth:
                    if k == len(words):
                        raise ShaderError(f"the arguments of {w.text} have no end", w.at)
                    depth += (words[k].text == "(") - (words[k].text == ")")
                    if depth == 1 and words[k].text == ",":
                        arguments.append([])
                    elif depth:
                        arguments[-1].append(words[k])
                    k += 1
                arguments = arguments if parameters or arguments != [[]] else []
                if len(arguments) != len(parameters):
                    raise ShaderError(f"{w.text} takes {len(parameters)} arguments", w.at)
                given = {p: self.expand(a, active) for p, a in zip(parameters, arguments, strict=True)}
            replaced = [x for b in body for x in (given[b.text] if b.kind == "name" and b.text in given else [Word(b.kind, b.text, w.at)])]
            out += self.expand(replaced, (*active, w.text))
        return out


def words(text: str) -> list[Word]:
    """The words of a text after macros."""
    macros, out, rest, start = _Macros(), [], [], 1
    # Comments that span lines are blanked first, so that a directive is one that starts a line.
    bare = re.sub(r"/\*.*?\*/", lambda m: re.sub(r"[^\n]", " ", m[0]), text, flags=re.S)
    lines = bare.split("\n")
    for n, line in enumerate(lines, 1):
        if line.lstrip().startswith("#"):
            out += macros.expand(_plain_words("\n".join(rest), start))
            macros.define(re.sub(r"//.*", "", line), (n, len(line) - len(line.lstrip()) + 1))
            rest, start = [], n + 1
        else:
            rest.append(line)
    out += macros.expand(_plain_words("\n".join(rest), start))
    return [*out, Word("end", "the end of the text", (len(lines), len(lines[-1]) + 1))]


class _Parser:
    def __init__(self, text: str):
        self.words, self.k, self.depth = words(text), 0, 0

    @property
    def now(self) -> Word:
        return self.words[self.k]

    def fail(self, expected: str) -> NoReturn:
        raise ShaderError(f"expected {expected}, found {self.now.text!r}" if self.now.kind != "end" else f"expected {expected} before the end of the text", self.now.at)

    def take(self, *texts: str) -> Word | None:
        if self.now.kind in ("sign", "name") and self.now.text in texts:
            self.k += 1
            return self.words[self.k - 1]
        return None

    def need(self, text: str) -> Word:
        return self.take(text) or self.fail(repr(text))

    def name(self) -> Word:
        if self.now.kind != "name" or self.now.text in TYPES:
            self.fail("a name")
        self.k += 1
        return self.words[self.k - 1]

    def deeper(self, rule):
        self.depth += 1
        if self.depth > DEPTH:
            raise ShaderError("nested too deeply", self.now.at)
        out = rule()
        self.depth -= 1
        return out

    # Statements

    def body(self) -> list[Node]:
        out = []
        while self.now.kind != "end":
            out.append(self.statement())
        return out

    def statement(self) -> Node:
        return self.deeper(self._statement)

    def _statement(self) -> Node:
        at = self.now.at
        if self.take("{"):
            inside = []
            while not self.take("}"):
                if self.now.kind == "end":
                    self.fail("'}'")
                inside.append(self.statement())
            return Node("block", at, tuple(inside))
        if self.take("if"):
            condition = self.bracketed()
            then = self.statement()
            return Node("if", at, (condition, then, self.statement() if self.take("else") else None))
        if self.take("for"):
            self.need("(")
            first = None if self.take(";") else self.simple(";")
            condition = None if self.now.text == ";" else self.expression()
            self.need(";")
            step = None if self.now.text == ")" else self.expression()
            self.need(")")
            return Node("for", at, (first, condition, step, self.statement()))
        if self.take("while"):
            condition = self.bracketed()
            return Node("for", at, (None, condition, None, self.statement()))
        if self.take("do"):
            inside = self.statement()
            self.need("while")
            condition = self.bracketed()
            self.need(";")
            return Node("do", at, (inside, condition))
        if w := self.take(*JUMPS):
            self.need(";")
            return Node("jump", at, (w.text,))
        if self.take(";"):
            return Node("block", at, ())
        return self.simple(";")

    def bracketed(self) -> Node:
        self.need("(")
        out = self.expression()
        self.need(")")
        return out

    def simple(self, end: str) -> Node:
        """A declaration or an expression, and the sign that ends it."""
        at, constant = self.now.at, False
        while w := self.take(*QUALIFIERS):
            constant |= w.text == "const"
        if self.now.text in TYPES and self.words[self.k + 1].text != "(" and not (self.words[self.k + 1].text == "[" and self._is_constructor()):
            kind = self.now.text
            self.k += 1
            common = self.array_size()
            out = []
            while True:
                name = self.name()
                size = self.array_size() or common
                out.append(Node("declare", name.at, (kind, size, name.text, self.assignment() if self.take("=") else None, constant)))
                if not self.take(","):
                    break
            self.need(end)
            return Node("several", at, tuple(out))
        if constant:
            self.fail("a type")
        out = self.expression()
        self.need(end)
        return Node("do expression", at, (out,))

    def _is_constructor(self) -> bool:
        k = self.k + 1
        while self.words[k].text != "]" and self.words[k].kind != "end":
            k += 1
        return self.words[min(k + 1, len(self.words) - 1)].text == "("

    def array_size(self) -> Node | str | None:
        """The size in brackets; "" where brackets are empty."""
        if not self.take("["):
            return None
        if self.take("]"):
            return ""
        size = self.expression()
        self.need("]")
        return size

    # Expressions

    def expression(self) -> Node:
        out = self.assignment()
        while w := self.take(","):
            out = Node("comma", w.at, (out, self.assignment()))
        return out

    def assignment(self) -> Node:
        return self.deeper(self._assignment)

    def _assignment(self) -> Node:
        left = self.choice()
        if w := self.take(*ASSIGNMENTS):
            return Node("assign", w.at, (w.text[:-1], left, self.assignment()))
        return left

    def choice(self) -> Node:
        condition = self.binary(0)
        if not (w := self.take("?")):
            return condition
        then = self.assignment()
        self.need(":")
        return Node("choose", w.at, (condition, then, self.assignment()))

    def binary(self, least: int) -> Node:
        """Operands joined by signs that are at least as tight."""
        left = self.unary()
        while self.now.kind == "sign" and (tight := TIGHTNESS.get(self.now.text, -1)) >= least:
            self.k += 1
            left = Node("binary", self.words[self.k - 1].at, (self.words[self.k - 1].text, left, self.binary(tight + 1)))
        return left

    def unary(self) -> Node:
        if w := self.take("++", "--"):
            return Node("step", w.at, (w.text, self.deeper(self.unary), True))
        if w := self.take("-", "+", "!", "~"):
            return Node("unary", w.at, (w.text, self.deeper(self.unary)))
        return self.postfix()

    def postfix(self) -> Node:
        out = self.primary()
        while True:
            if w := self.take("."):
                if self.now.kind != "name":
                    self.fail("a component")
                self.k += 1
                out = Node("member", w.at, (out, self.words[self.k - 1].text))
            elif w := self.take("["):
                out = Node("index", w.at, (out, self.expression()))
                self.need("]")
            elif w := self.take("++", "--"):
                out = Node("step", w.at, (w.text, out, False))
            else:
                return out

    def primary(self) -> Node:
        w = self.now
        if w.kind == "float":
            self.k += 1
            return Node("literal", w.at, (float(w.text.rstrip("fF")), "float"))
        if w.kind == "int":
            self.k += 1
            return Node("literal", w.at, (int(w.text, 16) if w.text[:2] in ("0x", "0X") else int(w.text, 8 if len(w.text) > 1 and w.text[0] == "0" and w.text.isdigit() and not set(w.text) & {"8", "9"} else 10), "int"))
        if self.take("true", "false"):
            return Node("literal", w.at, (w.text == "true", "bool"))
        if self.take("("):
            out = self.expression()
            self.need(")")
            return out
        if w.kind != "name":
            self.fail("an expression")
        self.k += 1
        size = None
        if w.text in TYPES and self.now.text == "[":
            size = self.array_size()
        if not self.take("("):
            if w.text in TYPES:
                self.fail("'('")
            return Node("name", w.at, (w.text,))
        arguments = []
        if not self.take(")"):
            arguments.append(self.assignment())
            while self.take(","):
                arguments.append(self.assignment())
            self.need(")")
        return Node("call", w.at, (w.text, tuple(arguments), size))


def parse(text: str) -> list[Node]:
    """The statements of a program's text."""
    return _Parser(text).body()
