"""A small sandboxed template language, compiled to Python closures.

Syntax: ``{{ expression }}``, ``{% if e %} {% elif e %} {% else %} {% endif %}``,
``{% for name in e %} {% endfor %}``, ``{% set name = e %}`` and
``{% generation %} {% endgeneration %}``, which marks what a model would write.
Expressions have strings, integers, true, false, names, ``a.b`` and ``a['b']``
(keys of mappings only), ``not and or``, ``== != in``, ``+``, parentheses and
filters ``| name``. There are no calls and no attributes of Python objects, so a
template can reach nothing but the values it is given.

A template is parsed to a tree, constants are folded (operators and pure filters
on constants, branches whose condition is known, neighbouring texts), and each
node becomes a closure.
"""

import re
from dataclasses import dataclass, replace


class TemplateError(ValueError):
    pass


# Tree


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: object
    key: object


@dataclass(frozen=True)
class Filter:
    of: object
    name: str


@dataclass(frozen=True)
class Op:
    name: str
    args: tuple


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Emit:
    value: object


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body)
    otherwise: tuple


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class Set:
    name: str
    value: object


@dataclass(frozen=True)
class Generation:
    body: tuple


# Parsing

TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|[|.+()\[\]]))""", re.S)
WORDS = {"not", "and", "or", "in", "true", "false"}
ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}


def unquote(token: str) -> str:
    return re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)


class Expression:
    """Recursive descent over the tokens of one expression."""

    def __init__(self, text: str):
        self.tokens, at, text = [], 0, text.strip()
        while at < len(text):
            m = TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    @classmethod
    def parse(cls, text: str):
        own = cls(text)
        tree = own.either()
        if own.at < len(own.tokens):
            raise TemplateError(f"unexpected {own.tokens[own.at][1]!r}")
        return tree

    def take(self, *wanted):
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" and self.tokens[self.at][1] in wanted:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, wanted):
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected")

    def name(self):
        kind, value = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind != "name" or value in WORDS:
            raise TemplateError("a name is expected")
        self.at += 1
        return value

    def either(self):
        tree = self.both()
        while self.take("or"):
            tree = Op("or", (tree, self.both()))
        return tree

    def both(self):
        tree = self.negation()
        while self.take("and"):
            tree = Op("and", (tree, self.negation()))
        return tree

    def negation(self):
        return Op("not", (self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self):
        tree = self.total()
        if name := self.take("==", "!=", "in"):
            tree = Op(name, (tree, self.total()))
        return tree

    def total(self):
        tree = self.filtered()
        while self.take("+"):
            tree = Op("+", (tree, self.filtered()))
        return tree

    def filtered(self):
        tree = self.value()
        while True:
            if self.take("|"):
                tree = Filter(tree, self.name())
            elif self.take("."):
                tree = Item(tree, Const(self.name()))
            elif self.take("["):
                tree = Item(tree, self.either())
                self.need("]")
            else:
                return tree

    def value(self):
        if self.take("("):
            tree = self.either()
            self.need(")")
            return tree
        if word := self.take("true", "false"):
            return Const(word == "true")
        kind, token = self.tokens[self.at] if self.at < len(self.tokens) else (None, None)
        if kind == "str":
            self.at += 1
            return Const(unquote(token))
        if kind == "int":
            self.at += 1
            return Const(int(token))
        return Name(self.name())


def parse(source: str) -> tuple:
    """Tree of a template: a tuple of nodes."""
    pieces, last = [], 0
    for m in TAG.finditer(source):
        pieces.append(("text", source[last : m.start()]))
        pieces.append(("emit", m[1]) if m[1] is not None else ("tag", m[2].strip()))
        last = m.end()
    pieces.append(("text", source[last:]))
    at = 0

    def block(*ends):
        nonlocal at
        body = []
        while at < len(pieces):
            kind, value = pieces[at]
            at += 1
            if kind == "text":
                if value:
                    body.append(Text(value))
                continue
            if kind == "emit":
                body.append(Emit(Expression.parse(value)))
                continue
            word, _, rest = value.partition(" ")
            if word in ends:
                return tuple(body), word, rest
            if word == "for":
                m = re.fullmatch(r"\s*([A-Za-z_]\w*)\s+in\s+(.*)", rest, re.S)
                if not m:
                    raise TemplateError(f"cannot read {value!r}")
                body.append(For(m[1], Expression.parse(m[2]), block("endfor")[0]))
            elif word == "set":
                name, _, expression = rest.partition("=")
                body.append(Set(Expression(name).name(), Expression.parse(expression)))
            elif word == "generation":
                body.append(Generation(block("endgeneration")[0]))
            elif word == "if":
                branches, otherwise, end = [], (), "if"
                while end in ("if", "elif"):
                    condition = Expression.parse(rest)
                    inner, end, rest = block("elif", "else", "endif")
                    branches.append((condition, inner))
                if end == "else":
                    otherwise = block("endif")[0]
                body.append(If(tuple(branches), otherwise))
            else:
                raise TemplateError(f"unknown tag {value!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return tuple(body), "", ""

    return block()[0]


# Meaning

OPERATORS = {
    "==": lambda a, b: a == b,
    "!=": lambda a, b: a != b,
    "+": lambda a, b: a + b,
    "in": lambda a, b: a in b,
    "not": lambda a: not a,
}


def as_text(value) -> str:
    if value is None:
        return ""
    if isinstance(value, bool) or not isinstance(value, (str, int)):
        raise TemplateError("only strings and integers can be written")
    return str(value)


def item(of, key):
    """Keys of mappings and places of lists; a missing one is none."""
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and not isinstance(key, bool):
        return of[key] if key < len(of) else None
    raise TemplateError("only mappings and lists have items")


# Folding


def fold(node, filters):
    """The same tree with everything computed that does not depend on values given later."""
    go = lambda x: fold(x, filters)
    if isinstance(node, Op):
        args = tuple(map(go, node.args))
        if node.name in ("and", "or") and isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.name == "and") else args[0]
        if node.name in OPERATORS and all(isinstance(a, Const) for a in args):
            return Const(OPERATORS[node.name](*(a.value for a in args)))
        return replace(node, args=args)
    if isinstance(node, Filter):
        of = go(node.of)
        if node.name not in filters:
            raise TemplateError(f"no filter {node.name!r}")
        return Const(filters[node.name](of.value)) if isinstance(of, Const) else Filter(of, node.name)
    if isinstance(node, Item):
        return Item(go(node.of), go(node.key))
    if isinstance(node, Emit):
        value = go(node.value)
        return Text(as_text(value.value)) if isinstance(value, Const) else Emit(value)
    if isinstance(node, Set):
        return replace(node, value=go(node.value))
    if isinstance(node, For):
        return For(node.name, go(node.over), fold_all(node.body, filters))
    if isinstance(node, Generation):
        return Generation(fold_all(node.body, filters))
    return node


def fold_all(nodes, filters) -> tuple:
    out = []
    for node in nodes:
        if isinstance(node, If):
            known, open_ = None, []
            for condition, body in node.branches:
                condition = fold(condition, filters)
                if isinstance(condition, Const):
                    if not condition.value:
                        continue
                    known = fold_all(body, filters)
                    break
                open_.append((condition, fold_all(body, filters)))
            rest = known if known is not None else fold_all(node.otherwise, filters)
            new = (If(tuple(open_), rest),) if open_ else rest
        else:
            new = (fold(node, filters),)
        for x in new:
            if isinstance(x, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].value + x.value)
            elif x != Text(""):
                out.append(x)
    return tuple(out)


# Closures


class Output:
    """Text written so far and the spans, in code points, that a model would have written."""

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def write(self, text):
        self.parts.append(text)
        self.length += len(text)


def evaluator(node, filters):
    """Closure from the values given to the value of an expression."""
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name
        return lambda env: env.get(name)
    if isinstance(node, Item):
        of, key = evaluator(node.of, filters), evaluator(node.key, filters)
        return lambda env: item(of(env), key(env))
    if isinstance(node, Filter):
        of, apply = evaluator(node.of, filters), filters[node.name]
        return lambda env: apply(of(env))
    args = [evaluator(a, filters) for a in node.args]
    if node.name == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.name == "or":
        return lambda env: args[0](env) or args[1](env)
    act = OPERATORS[node.name]
    if len(args) == 1:
        return lambda env: act(args[0](env))
    return lambda env: act(args[0](env), args[1](env))


def writer(nodes, filters):
    """Closure that writes nodes to an Output."""
    steps = [statement(node, filters) for node in nodes]

    def run(env, out):
        for step in steps:
            step(env, out)

    return steps[0] if len(steps) == 1 else run


def statement(node, filters):
    if isinstance(node, Text):
        text = node.value
        return lambda env, out: out.write(text)
    if isinstance(node, Emit):
        value = evaluator(node.value, filters)
        return lambda env, out: out.write(as_text(value(env)))
    if isinstance(node, Set):
        name, value = node.name, evaluator(node.value, filters)
        return lambda env, out: env.__setitem__(name, value(env))
    if isinstance(node, For):
        name, over, body = node.name, evaluator(node.over, filters), writer(node.body, filters)

        def loop(env, out):
            inner = dict(env)
            for inner[name] in over(env) or ():
                body(inner, out)

        return loop
    if isinstance(node, Generation):
        body = writer(node.body, filters)

        def marked(env, out):
            start = out.length
            body(env, out)
            out.spans.append((start, out.length))

        return marked
    branches = [(evaluator(c, filters), writer(b, filters)) for c, b in node.branches]
    otherwise = writer(node.otherwise, filters)

    def choose(env, out):
        for condition, body in branches:
            if condition(env):
                return body(env, out)
        return otherwise(env, out)

    return choose


def compile_template(source: str, filters=None):
    """Function from given values to (text, spans a model would have written)."""
    filters = filters or {}
    body = writer(fold_all(parse(source), filters), filters)

    def render(**values):
        out = Output()
        body(values, out)
        return "".join(out.parts), out.spans

    return render
