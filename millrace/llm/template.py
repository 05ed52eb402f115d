"""A small template language for conversations, compiled to Python closures.

    text {{ expression }} {% for m in messages %} ... {% endfor %} {% if e %} {% elif e %} {% else %} {% endif %}
    {% set name = e %} {% generation %} ... {% endgeneration %} {# comment #}

Expressions have strings, integers, true, false, none, names, fields (m.text, m["text"]), ``+ == != in not and or``, brackets and filters
(e | escape). A dash inside a tag ({%- -%}) takes away the white space next to it. In a loop, loop.first, loop.last and
loop.index0 are known.

The language is a sandbox: values are strings, numbers, truth values and the given messages, a field is only ever a key of a message, there
are no calls beyond the filters, and loops run over the messages alone, so a template ends and reaches nothing else.

A source becomes a syntax tree; parts of it that are constant are computed once (fold), and what is left becomes nested closures.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field


class TemplateError(ValueError):
    pass


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Field:
    of: object
    key: object


@dataclass(frozen=True)
class Apply:
    """An operator or a filter on its arguments."""

    what: str
    args: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Print:
    value: object


@dataclass(frozen=True)
class Put:
    name: str
    value: object


@dataclass(frozen=True)
class For:
    name: str
    over: object
    body: tuple


@dataclass(frozen=True)
class If:
    test: object
    then: tuple
    other: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


def _text(value: object) -> str:
    if value is None:
        return ""
    if isinstance(value, (str, int)):
        return str(value)
    raise TemplateError(f"a {type(value).__name__} cannot be written")


def _plus(a: object, b: object) -> object:
    return _text(a) + _text(b) if isinstance(a, str) or isinstance(b, str) else a + b


#: Operators of two values; ``and`` and ``or`` are apart, as they may leave out their second one.
OPERATORS: dict[str, Callable] = {
    "+": _plus, "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "in": lambda a, b: _text(a) in _text(b), "not": lambda a: not a}
FILTERS: dict[str, Callable] = {"trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "length": lambda x: len(_text(x))}

_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKENS = re.compile(r"""\s*(?:(\d+)|("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|([A-Za-z_]\w*)|(==|!=|[-+.|()\[\]=]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r"}
_WORDS = {"true": True, "false": False, "none": None}
_RESERVED = {*_WORDS, "and", "or", "not", "in", "loop", "messages"}


class _Expression:
    """Recursive descent over the tokens of one tag."""

    def __init__(self, source: str, filters: dict[str, Callable]):
        self.tokens, self.at, self.filters = [], 0, filters
        end = 0
        source = source.rstrip()
        while end < len(source):
            m = _TOKENS.match(source, end)
            if not m:
                raise TemplateError(f"cannot read {source[end:end + 20]!r}")
            end = m.end()
            if m[1]:
                self.tokens.append(("const", int(m[1])))
            elif m[2]:
                self.tokens.append(("const", re.sub(r"\\(.)", lambda c: _ESCAPES.get(c[1], c[1]), m[2][1:-1], flags=re.S)))
            elif m[3]:
                self.tokens.append(("name", m[3]))
            else:
                self.tokens.append(("sign", m[4]))

    def peek(self, *wanted: str) -> str | None:
        """The next name or sign if it is one of these."""
        if self.at < len(self.tokens):
            kind, value = self.tokens[self.at]
            if kind != "const" and value in wanted:
                return value
        return None

    def take(self, *wanted: str) -> str | None:
        found = self.peek(*wanted)
        self.at += found is not None
        return found

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} is missing")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def done(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self) -> object:
        found = self.either()
        self.done()
        return found

    def either(self) -> object:
        left = self.both()
        while self.take("or"):
            left = Apply("or", (left, self.both()))
        return left

    def both(self) -> object:
        left = self.negated()
        while self.take("and"):
            left = Apply("and", (left, self.negated()))
        return left

    def negated(self) -> object:
        return Apply("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> object:
        left = self.added()
        while True:
            if sign := self.take("==", "!=", "in"):
                left = Apply(sign, (left, self.added()))
            elif self.peek("not"):
                self.at += 1
                self.need("in")
                left = Apply("not", (Apply("in", (left, self.added())),))
            else:
                return left

    def added(self) -> object:
        left = self.filtered()
        while self.take("+"):
            left = Apply("+", (left, self.filtered()))
        return left

    def filtered(self) -> object:
        left = self.single()
        while self.take("|"):
            which = self.name()
            if which not in self.filters:
                raise TemplateError(f"there is no filter {which!r}")
            left = Apply(which, (left,))
        return left

    def single(self) -> object:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        if self.take("("):
            found = self.either()
            self.need(")")
        else:
            kind, value = self.tokens[self.at]
            self.at += 1
            if kind == "const":
                found = Const(value)
            elif kind == "name":
                found = Const(_WORDS[value]) if value in _WORDS else Name(value)
            else:
                raise TemplateError(f"unexpected {value!r}")
        while sign := self.take(".", "["):
            if sign == ".":
                found = Field(found, Const(self.name()))
            else:
                found = Field(found, self.either())
                self.need("]")
        return found


def parse(source: str, filters: dict[str, Callable] | None = None) -> tuple:
    """The syntax tree: a tuple of statements."""
    filters = {**FILTERS, **(filters or {})}
    parts = _TAGS.split(source)
    for i in range(1, len(parts), 2):  # dashes take away blanks
        if parts[i][2] == "-":
            parts[i - 1] = parts[i - 1].rstrip()
        if parts[i][-3] == "-" and len(parts[i]) > 5:
            parts[i + 1] = parts[i + 1].lstrip()
    at = 0

    def block(ends: tuple[str, ...], known: frozenset[str], loops: int) -> tuple[tuple, str, _Expression | None]:
        nonlocal at
        out = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if at % 2:  # text between tags
                if "{%" in part or "{{" in part:
                    raise TemplateError(f"a tag is not closed: {part[:30]!r}")
                if part:
                    out.append(Text(part))
                continue
            inner = part[2:-2].removeprefix("-").removesuffix("-")
            if part[1] == "#":
                continue
            read = _Expression(inner, filters)
            if part[1] == "{":
                out.append(Print(checked(read.whole(), known, loops)))
                continue
            word = read.name()
            if word in ends:
                return tuple(out), word, read
            if word == "set":
                name = fresh(read.name())
                read.need("=")
                out.append(Put(name, checked(read.whole(), known, loops)))
                known |= {name}
            elif word == "generation":
                read.done()
                body, _, _ = block(("endgeneration",), known, loops)
                out.append(Generation(body))
            elif word == "for":
                name = fresh(read.name())
                read.need("in")
                if read.whole() != Name("messages"):
                    raise TemplateError("a loop runs over messages")
                body, _, _ = block(("endfor",), known | {name}, loops + 1)
                out.append(For(name, Name("messages"), body))
            elif word == "if":
                out.append(condition(read, known, loops))
            else:
                raise TemplateError(f"unexpected {word!r}")
        if ends:
            raise TemplateError(f"{ends[0]!r} is missing")
        return tuple(out), "", None

    def condition(read: _Expression, known: frozenset[str], loops: int) -> If:
        test = checked(read.whole(), known, loops)
        then, end, more = block(("elif", "else", "endif"), known, loops)
        other: tuple = ()
        if end == "elif":
            other = (condition(more, known, loops),)
        elif end == "else":
            other, _, _ = block(("endif",), known, loops)
        return If(test, then, other)

    def fresh(name: str) -> str:
        if name in _RESERVED:
            raise TemplateError(f"{name!r} cannot be set")
        return name

    def checked(node: object, known: frozenset[str], loops: int) -> object:
        if isinstance(node, Name) and node.name not in known and not (node.name == "loop" and loops) and node.name != "messages":
            raise TemplateError(f"{node.name!r} is not known here")
        for child in (node.of, node.key) if isinstance(node, Field) else node.args if isinstance(node, Apply) else ():
            checked(child, known, loops)
        return node

    return block((), frozenset(), 0)[0]


def fold(node: object, filters: dict[str, Callable] | None = None) -> object:
    """The same expression with its constant parts computed."""
    if isinstance(node, Field):
        return Field(fold(node.of, filters), fold(node.key, filters))
    if not isinstance(node, Apply):
        return node
    args = tuple(fold(x, filters) for x in node.args)
    if node.what in ("and", "or"):
        if isinstance(args[0], Const):
            return args[1] if bool(args[0].value) == (node.what == "and") else args[0]
    elif all(isinstance(x, Const) for x in args):
        return Const({**OPERATORS, **FILTERS, **(filters or {})}[node.what](*(x.value for x in args)))
    return Apply(node.what, args)


def fold_all(nodes: tuple, filters: dict[str, Callable] | None = None) -> tuple:
    """The same statements, with constants computed, branches that never run left out, and neighbouring text joined."""
    out: list = []

    def add(node: object) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + node.text)
        elif not isinstance(node, Text) or node.text:
            out.append(node)

    for node in nodes:
        if isinstance(node, Print):
            value = fold(node.value, filters)
            add(Text(_text(value.value)) if isinstance(value, Const) else Print(value))
        elif isinstance(node, Put):
            add(Put(node.name, fold(node.value, filters)))
        elif isinstance(node, For):
            add(For(node.name, node.over, fold_all(node.body, filters)))
        elif isinstance(node, Generation):
            add(Generation(fold_all(node.body, filters)))
        elif isinstance(node, If):
            test = fold(node.test, filters)
            then, other = fold_all(node.then, filters), fold_all(node.other, filters)
            if isinstance(test, Const):
                for x in then if test.value else other:
                    add(x)
            else:
                add(If(test, then, other))
        else:
            add(node)
    return tuple(out)


@dataclass
class Output:
    """Text written so far, and the spans of it that are under a generation marker."""

    parts: list[str] = field(default_factory=list)
    size: int = 0
    spans: list[tuple[int, int]] = field(default_factory=list)
    depth: int = 0
    since: int = 0

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.size += len(text)

    def begin(self) -> None:
        if not self.depth:
            self.since = self.size
        self.depth += 1

    def end(self) -> None:
        self.depth -= 1
        if not self.depth:
            self.spans.append((self.since, self.size))

    def take(self) -> tuple[str, list[tuple[int, int]]]:
        """What is there, and a fresh start; a span that is open goes on in the next piece."""
        if self.depth:
            self.spans.append((self.since, self.size))
        taken = "".join(self.parts), self.spans
        self.parts, self.size, self.spans, self.since = [], 0, [], 0
        return taken


def _field(of: object, key: object) -> object:
    if isinstance(of, list) and type(key) is int and key < len(of):
        return of[key]
    if not isinstance(of, dict) or key not in of:
        raise TemplateError(f"there is no {key!r} here")
    return of[key]


def expression(node: object, filters: dict[str, Callable]) -> Callable[[dict], object]:
    """A closure that gives the value in an environment."""
    if isinstance(node, Const):
        value = node.value
        return lambda env: value
    if isinstance(node, Name):
        name = node.name

        def look(env: dict) -> object:
            if name not in env:
                raise TemplateError(f"{name!r} has no value")
            return env[name]

        return look
    if isinstance(node, Field):
        of, key = expression(node.of, filters), expression(node.key, filters)
        return lambda env: _field(of(env), key(env))
    args = [expression(x, filters) for x in node.args]
    if node.what == "and":
        return lambda env: args[0](env) and args[1](env)
    if node.what == "or":
        return lambda env: args[0](env) or args[1](env)
    call = {**OPERATORS, **FILTERS, **filters}[node.what]
    if len(args) == 1:
        one = args[0]
        return lambda env: call(one(env))
    left, right = args
    return lambda env: call(left(env), right(env))


Step = Callable[[dict, Output], None]


def _turns(messages: Iterable) -> Iterator[tuple[object, dict]]:
    """Each message with what a loop knows of it; only one message is looked at ahead."""
    ahead, index = iter(messages), 0
    for now in ahead:
        for later in ahead:
            yield now, {"first": index == 0, "last": False, "index0": index}
            now, index = later, index + 1
        yield now, {"first": index == 0, "last": True, "index0": index}


def statement(node: object, filters: dict[str, Callable]) -> Step:
    if isinstance(node, Text):
        text = node.text
        return lambda env, out: out.write(text)
    if isinstance(node, Print):
        value = expression(node.value, filters)
        return lambda env, out: out.write(_text(value(env)))
    if isinstance(node, Put):
        name, value = node.name, expression(node.value, filters)
        return lambda env, out: env.__setitem__(name, value(env))
    if isinstance(node, Generation):
        body = block(node.body, filters)

        def generate(env: dict, out: Output) -> None:
            out.begin()
            body(env, out)
            out.end()

        return generate
    if isinstance(node, If):
        test, then, other = expression(node.test, filters), block(node.then, filters), block(node.other, filters)
        return lambda env, out: then(env, out) if test(env) else other(env, out)
    name, body = node.name, block(node.body, filters)

    def loop(env: dict, out: Output) -> None:
        for message, known in _turns(env["messages"]):
            body({**env, name: message, "loop": known}, out)

    return loop


def block(nodes: tuple, filters: dict[str, Callable]) -> Step:
    steps = [statement(x, filters) for x in nodes]
    if len(steps) == 1:
        return steps[0]

    def run(env: dict, out: Output) -> None:
        for step in steps:
            step(env, out)

    return run


def _uses_messages(node: object) -> bool:
    """Whether a statement or expression looks at all messages."""
    if isinstance(node, tuple):
        return any(map(_uses_messages, node))
    if isinstance(node, Name):
        return node.name == "messages"
    return any(_uses_messages(x) for x in vars(node).values()) if hasattr(node, "__dataclass_fields__") else False


class Template:
    """A compiled template. What ``set`` defines in a loop is forgotten after each turn."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        filters = filters or {}
        self.tree = fold_all(parse(source, filters), filters)
        loops = [x for x in self.tree if isinstance(x, For)]
        # One loop at the top, and nothing else that looks at the messages: then they need not be held.
        self.streams = len(loops) == 1 and not any(_uses_messages(x.body if x is loops[0] else x) for x in self.tree)
        self._steps = [(x.name, block(x.body, filters)) if self.streams and x is loops[0] else statement(x, filters) for x in self.tree]

    def pieces(self, messages: Iterable[dict], most: int = 1 << 20) -> Iterator[tuple[str, list[tuple[int, int]]]]:
        """The text with its generated spans, cut after turns into pieces of about ``most`` characters; one piece at least."""
        env, out = {"messages": () if self.streams else list(messages)}, Output()
        for step in self._steps:
            if not isinstance(step, tuple):
                step(env, out)
                continue
            name, body = step
            for message, known in _turns(messages):
                body({**env, name: message, "loop": known}, out)
                if out.size >= most and not known["last"]:
                    yield out.take()
        yield out.take()

    def render(self, messages: Iterable[dict]) -> tuple[str, list[tuple[int, int]]]:
        """Whole text and spans."""
        text, spans, at = [], [], 0
        for part, inside in self.pieces(messages):
            text.append(part)
            spans += [(at + a, at + b) for a, b in inside]
            at += len(part)
        return "".join(text), spans
