"""A parser for the SELECT statements of text-to-SQL corpora.

It runs in Python workers, so that statements are analysed where their rows are: as many
tasks as there are partitions, with no driver round trip and no JVM parser in the way. A
statement becomes a tree of nodes; `text` renders any node in one canonical spelling.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field


class SqlError(ValueError):
    """The text is no statement of the supported grammar."""


@dataclass
class Node:
    """kind, its own value, its children, and for queries the parts by name."""

    kind: str
    value: str = ""
    children: list[Node] = field(default_factory=list)
    parts: dict[str, object] = field(default_factory=dict)

    def walk(self) -> Iterator[Node]:
        """This node and everything below it, outer parts first, in reading order."""
        yield self
        for c in self.children:
            yield from c.walk()


TOKEN = re.compile(
    r"\s*(?:(?P<comment>--[^\n]*|/\*.*?\*/)|(?P<string>'(?:[^']|'')*')|(?P<quoted>\"(?:[^\"]|\"\")*\"|`[^`]*`|\[[^\]]*\])"
    r"|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)|(?P<word>[^\W\d]\w*)|(?P<op><>|!=|<=|>=|==|\|\||<<|>>|[-+*/%=<>(),.;~&|?])|(?P<bad>\S))",
    re.S,
)
# Fixed: words that end a name, an alias or an expression.
RESERVED = frozenset(
    "select from where group order having limit offset union intersect except join inner left right full outer cross natural "
    "on using as and or not in like glob between is null exists distinct all case when then else end by asc desc with values collate set".split()
)
AGGREGATES = frozenset("count sum avg min max total group_concat".split())
COMPARISONS = {"=": "eq", "==": "eq", "!=": "neq", "<>": "neq", ">": "gt", ">=": "gte", "<": "lt", "<=": "lte"}


class _Reader:
    def __init__(self, sql: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        for m in TOKEN.finditer(sql):
            kind = m.lastgroup
            if kind == "bad":
                raise SqlError(f"unexpected {m.group('bad')!r}")
            if kind and kind != "comment":
                self.tokens.append((kind, m.group(kind)))
        self.at = 0

    def peek(self, ahead: int = 0) -> tuple[str, str]:
        i = self.at + ahead
        return self.tokens[i] if i < len(self.tokens) else ("end", "")

    def word(self, ahead: int = 0) -> str:
        kind, t = self.peek(ahead)
        return t.lower() if kind == "word" else ""

    def take(self, *words: str) -> bool:
        """Consume this run of words or marks if it comes next."""
        for i, w in enumerate(words):
            kind, t = self.peek(i)
            if (t.lower() if kind == "word" else t if kind == "op" else "") != w:
                return False
        self.at += len(words)
        return True

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SqlError(f"expected {' '.join(words)} at {self.peek()[1]!r}")

    def name(self) -> Node:
        kind, t = self.peek()
        if kind == "word" and t.lower() not in RESERVED:
            self.at += 1
            return Node("name", t)
        if kind == "quoted":
            self.at += 1
            return Node("name", t[1:-1], parts={"quote": t[0]})
        raise SqlError(f"expected a name at {t!r}")

    # ------------------------------------------------------------ queries

    def statement(self) -> Node:
        query = self.query()
        while self.take(";"):
            pass
        if self.peek()[0] != "end":
            raise SqlError(f"unexpected {self.peek()[1]!r}")
        return query

    def query(self) -> Node:
        ctes: list[Node] = []
        if self.take("with"):
            self.take("recursive")
            while True:
                name = self.name()
                if self.take("("):
                    self.names()
                self.need("as", "(")
                ctes.append(Node("cte", name.value, [self.query()]))
                self.need(")")
                if not self.take(","):
                    break
        left = self.core()
        while self.word() in ("union", "intersect", "except"):
            op = self.word()
            self.at += 1
            if self.take("all"):
                op += " all"
            right = self.core()
            left = Node("set", op, [left, right])
        order = limit = offset = None
        if self.take("order", "by"):
            order = self.order_items()
        if self.take("limit"):
            limit = self.expression()
            if self.take(","):
                offset, limit = limit, self.expression()
            elif self.take("offset"):
                offset = self.expression()
        tail = [n for n in (order, limit, offset) if n is not None]
        if ctes or tail or left.kind == "set":
            if left.kind == "select" and not ctes and not ({"order", "limit"} & left.parts.keys()):
                top = left
            else:
                top = Node("query", "", [*ctes, left], {"body": left})
            for key, n in (("order", order), ("limit", limit), ("offset", offset)):
                if n is not None:
                    top.parts[key] = n
            top.children += tail
            return top
        return left

    def core(self) -> Node:
        if self.take("("):
            inner = self.query()
            self.need(")")
            return inner
        if self.take("values"):
            rows = []
            while True:
                self.need("(")
                rows.append(Node("row", "", self.list_of(self.expression)))
                self.need(")")
                if not self.take(","):
                    return Node("values", "", rows)
        self.need("select")
        select = Node("select")
        parts = select.parts
        if self.take("distinct"):
            parts["distinct"] = True
        else:
            self.take("all")
        parts["items"] = self.list_of(self.item)
        select.children += parts["items"]  # type: ignore[operator]
        if self.take("from"):
            parts["from"] = self.sources()
            select.children.append(parts["from"])  # type: ignore[arg-type]
        if self.take("where"):
            parts["where"] = self.expression()
            select.children.append(parts["where"])  # type: ignore[arg-type]
        if self.take("group", "by"):
            parts["group"] = self.list_of(self.expression)
            select.children += parts["group"]  # type: ignore[operator]
        if self.take("having"):
            parts["having"] = self.expression()
            select.children.append(parts["having"])  # type: ignore[arg-type]
        return select

    def list_of(self, one) -> list[Node]:
        got = [one()]
        while self.take(","):
            got.append(one())
        return got

    def names(self) -> list[Node]:
        got = self.list_of(self.name)
        self.need(")")
        return got

    def order_items(self) -> Node:
        def one() -> Node:
            e = self.expression()
            way = "desc" if self.take("desc") else "asc" if self.take("asc") else ""
            if self.word() == "nulls":
                self.at += 1
                way += f" nulls {self.name().value.lower()}"
            return Node("sort", way.strip(), [e])

        return Node("order", "", self.list_of(one))

    def item(self) -> Node:
        if self.take("*"):
            return Node("star")
        e = self.expression()
        alias = self.alias()
        return Node("alias", alias.value, [e]) if alias else e

    def alias(self) -> Node | None:
        if self.take("as"):
            kind, t = self.peek()
            if kind == "string":
                self.at += 1
                return Node("name", t[1:-1])
            return self.name()
        kind, t = self.peek()
        if kind == "word" and t.lower() not in RESERVED or kind == "quoted":
            return self.name()
        return None

    def sources(self) -> Node:
        joined = Node("sources", "", [self.source()])
        while True:
            if self.take(","):
                joined.children.append(Node("join", ",", [self.source()]))
                continue
            start, words = self.at, []
            while self.word() in ("natural", "left", "right", "full", "outer", "inner", "cross"):
                words.append(self.word())
                self.at += 1
            if not self.take("join"):
                self.at = start
                return joined
            join = Node("join", " ".join(words), [self.source()])
            if self.take("on"):
                join.parts["on"] = self.expression()
                join.children.append(join.parts["on"])  # type: ignore[arg-type]
            elif self.take("using"):
                self.need("(")
                join.parts["using"] = self.names()
            joined.children.append(join)

    def source(self) -> Node:
        if self.take("("):
            if self.word() in ("select", "with", "values") or self.peek()[1] == "(":
                inner = self.query()
                self.need(")")
                alias = self.alias()
                return Node("subquery", alias.value if alias else "", [inner])
            inner = self.sources()
            self.need(")")
            return inner
        name = self.name()
        while self.take("."):
            name = self.name()
        alias = self.alias()
        return Node("table", name.value, [], {"alias": alias.value if alias else ""})

    # ------------------------------------------------------------ expressions

    def expression(self) -> Node:
        left = self.conjunction()
        while self.take("or"):
            left = Node("op", "or", [left, self.conjunction()])
        return left

    def conjunction(self) -> Node:
        left = self.negation()
        while self.take("and"):
            left = Node("op", "and", [left, self.negation()])
        return left

    def negation(self) -> Node:
        if self.take("not"):
            return Node("not", "", [self.negation()])
        return self.comparison()

    def comparison(self) -> Node:
        left = self.sum()
        while True:
            kind, t = self.peek()
            if kind == "op" and t in COMPARISONS:
                self.at += 1
                left = Node("compare", COMPARISONS[t], [left, self.sum()])
                continue
            if self.take("is"):
                negated = self.take("not")
                left = Node("is", "not" if negated else "", [left, self.sum()])
                continue
            mark, negated = self.at, self.take("not")
            if self.take("in"):
                self.need("(")
                if self.word() in ("select", "with"):
                    inside = [Node("subquery", "", [self.query()])]
                else:
                    inside = [] if self.peek()[1] == ")" else self.list_of(self.expression)
                self.need(")")
                left = Node("in", "not" if negated else "", [left, *inside])
            elif self.word() in ("like", "glob", "regexp", "match") and self.peek()[0] == "word":
                op = self.word()
                self.at += 1
                left = Node(op, "not" if negated else "", [left, self.sum()])
                if self.word() == "escape":
                    self.at += 1
                    left.children.append(self.sum())
            elif self.take("between"):
                low = self.sum()
                self.need("and")
                left = Node("between", "not" if negated else "", [left, low, self.sum()])
            else:
                self.at = mark
                return left

    def sum(self) -> Node:
        left = self.product()
        while self.peek()[0] == "op" and self.peek()[1] in ("+", "-", "||", "&", "|", "<<", ">>"):
            op = self.peek()[1]
            self.at += 1
            left = Node("op", op, [left, self.product()])
        return left

    def product(self) -> Node:
        left = self.unary()
        while self.peek()[0] == "op" and self.peek()[1] in ("*", "/", "%"):
            op = self.peek()[1]
            self.at += 1
            left = Node("op", op, [left, self.unary()])
        return left

    def unary(self) -> Node:
        kind, t = self.peek()
        if kind == "op" and t in ("-", "+", "~"):
            self.at += 1
            return Node("unary", t, [self.unary()])
        e = self.primary()
        if self.take("collate"):
            self.name()
        return e

    def primary(self) -> Node:
        kind, t = self.peek()
        if kind == "string":
            self.at += 1
            return Node("string", t[1:-1].replace("''", "'"))
        if kind == "number":
            self.at += 1
            return Node("number", t)
        if self.take("("):
            if self.word() in ("select", "with"):
                inner = Node("subquery", "", [self.query()])
            else:
                got = self.list_of(self.expression)
                inner = got[0] if len(got) == 1 else Node("row", "", got)
                if len(got) == 1:
                    inner = Node("paren", "", got)
            self.need(")")
            return inner
        low = self.word()
        if low == "null":
            self.at += 1
            return Node("null")
        if low == "case":
            return self.case()
        if low == "exists":
            self.at += 1
            self.need("(")
            inner = Node("exists", "", [Node("subquery", "", [self.query()])])
            self.need(")")
            return inner
        if low == "cast" and self.peek(1)[1] == "(":
            self.at += 2
            e = self.expression()
            self.need("as")
            kind_of = self.name().value.lower()
            if self.take("("):
                self.list_of(self.primary)
                self.need(")")
            self.need(")")
            return Node("cast", kind_of, [e])
        if kind == "word" and low not in RESERVED and self.peek(1) == ("op", "("):
            self.at += 2
            call = Node("call", low)
            if self.take("distinct"):
                call.parts["distinct"] = True
            if self.take("*"):
                call.children = [Node("star")]
            elif self.peek()[1] != ")":
                call.children = self.list_of(self.expression)
            self.need(")")
            return self.over(call) if self.word() == "over" and self.peek(1) == ("op", "(") else call
        first = self.name()
        chain = [first]
        while self.take("."):
            if self.take("*"):
                return Node("star", chain[-1].value)
            chain.append(self.name())
        column = Node("column", chain[-1].value, parts={"table": chain[-2].value if len(chain) > 1 else ""})
        if len(chain) == 1 and "quote" in first.parts:
            column.parts["quote"] = first.parts["quote"]
        return column

    def over(self, call: Node) -> Node:
        """A call over a window; its frame, if it has one, is kept as it is written."""
        self.need("over", "(")
        window = Node("window", "", [call])
        if self.take("partition", "by"):
            window.parts["partition"] = self.list_of(self.expression)
            window.children += window.parts["partition"]  # type: ignore[operator]
        if self.take("order", "by"):
            window.parts["sorted"] = self.order_items()
            window.children.append(window.parts["sorted"])  # type: ignore[arg-type]
        frame = []
        while self.peek()[1] not in (")", ""):
            frame.append(self.peek()[1].lower())
            self.at += 1
        self.need(")")
        window.value = " ".join(frame)
        return window

    def case(self) -> Node:
        self.need("case")
        node = Node("case")
        if self.word() != "when":
            node.parts["of"] = True
            node.children.append(self.expression())
        while self.take("when"):
            node.children.append(self.expression())
            self.need("then")
            node.children.append(self.expression())
        if self.take("else"):
            node.parts["otherwise"] = True
            node.children.append(self.expression())
        self.need("end")
        return node


def parse(sql: str) -> Node:
    """The tree of one SELECT statement; SqlError if it is none."""
    return _Reader(sql).statement()


def try_parse(sql: str | None) -> Node | None:
    try:
        return parse(sql) if sql and sql.strip() else None
    except (SqlError, RecursionError):
        return None


_SIGNS = {"eq": "=", "neq": "<>", "gt": ">", "gte": ">=", "lt": "<", "lte": "<="}


def _named(s: str) -> str:
    """A name in lower case, in quotes if it would not be read as one word without."""
    low = s.lower()
    return low if re.fullmatch(r"[^\W\d]\w*", low) and low not in RESERVED else '"' + low.replace('"', '""') + '"'


def text(n: Node) -> str:
    """Canonical spelling of a node: lower-case words and names, one space, literals as they are."""
    k, c = n.kind, n.children
    if k == "string":
        return "'" + n.value.replace("'", "''") + "'"
    if k == "number":
        return n.value
    if k == "null":
        return "null"
    if k == "star":
        return f"{_named(n.value)}.*" if n.value else "*"
    if k == "column":
        table = str(n.parts["table"])
        return f"{_named(table)}.{_named(n.value)}" if table else _named(n.value)
    if k == "call":
        return f"{n.value}({'distinct ' if n.parts.get('distinct') else ''}{', '.join(map(text, c))})"
    if k == "window":
        inside = [f"partition by {', '.join(map(text, n.parts['partition']))}"] if "partition" in n.parts else []  # type: ignore[arg-type]
        inside += [text(n.parts["sorted"])] if "sorted" in n.parts else []  # type: ignore[arg-type]
        return f"{text(c[0])} over ({' '.join([*inside, *([n.value] if n.value else [])])})"
    if k == "alias":
        return f"{text(c[0])} as {_named(n.value)}"
    if k in ("op", "compare"):
        return f"{text(c[0])} {_SIGNS.get(n.value, n.value)} {text(c[1])}"
    if k == "not":
        return f"not {text(c[0])}"
    if k == "unary":
        return f"{n.value}{text(c[0])}"
    if k == "is":
        return f"{text(c[0])} is {'not ' if n.value else ''}{text(c[1])}"
    if k == "in":
        inside = text(c[1]) if len(c) == 2 and c[1].kind == "subquery" else f"({', '.join(map(text, c[1:]))})"
        return f"{text(c[0])} {'not ' if n.value else ''}in {inside}"
    if k in ("like", "glob", "regexp", "match"):
        return f"{text(c[0])} {'not ' if n.value else ''}{k} {text(c[1])}" + (f" escape {text(c[2])}" if len(c) > 2 else "")
    if k == "between":
        return f"{text(c[0])} {'not ' if n.value else ''}between {text(c[1])} and {text(c[2])}"
    if k == "paren":
        return f"({text(c[0])})"
    if k == "row":
        return f"({', '.join(map(text, c))})"
    if k == "cast":
        return f"cast({text(c[0])} as {n.value})"
    if k == "exists":
        return f"exists{text(c[0])}"
    if k == "subquery":
        return f"({text(c[0])})" + (f" as {_named(n.value)}" if n.value else "")
    if k == "case":
        rest, out = list(c), ["case"]
        if n.parts.get("of"):
            out.append(text(rest.pop(0)))
        last = rest.pop() if n.parts.get("otherwise") else None
        for i in range(0, len(rest), 2):
            out.append(f"when {text(rest[i])} then {text(rest[i + 1])}")
        return " ".join([*out, *([f"else {text(last)}"] if last else []), "end"])
    if k == "table":
        alias = str(n.parts["alias"])
        return _named(n.value) + (f" as {_named(alias)}" if alias else "")
    if k == "join":
        head = "," if n.value == "," else f" {n.value + ' ' if n.value else ''}join"
        on = f" on {text(n.parts['on'])}" if "on" in n.parts else f" using ({', '.join(x.value.lower() for x in n.parts['using'])})" if "using" in n.parts else ""  # type: ignore[arg-type, union-attr]
        return f"{head} {text(c[0])}{on}"
    if k == "sources":
        return text(c[0]) + "".join(map(text, c[1:]))
    if k == "sort":
        return f"{text(c[0])} {n.value}".strip() if n.value != "asc" else text(c[0])
    if k == "order":
        return f"order by {', '.join(map(text, c))}"
    if k == "set":
        return f"{text(c[0])} {n.value} {text(c[1])}"
    if k == "cte":
        return f"{_named(n.value)} as ({text(c[0])})"
    if k == "values":
        return f"values {', '.join(map(text, c))}"
    p = n.parts
    tail = "".join(f" {w}{text(p[key])}" for key, w in (("order", ""), ("limit", "limit "), ("offset", "offset ")) if key in p)  # type: ignore[arg-type]
    if k == "query":
        ctes = [x for x in c if x.kind == "cte"]
        return (f"with {', '.join(map(text, ctes))} " if ctes else "") + text(p["body"]) + tail  # type: ignore[arg-type]
    out = "select " + ("distinct " if p.get("distinct") else "") + ", ".join(map(text, p["items"]))  # type: ignore[arg-type]
    for key, w in (("from", " from "), ("where", " where ")):
        if key in p:
            out += w + text(p[key])  # type: ignore[arg-type]
    if "group" in p:
        out += " group by " + ", ".join(map(text, p["group"]))  # type: ignore[arg-type]
    if "having" in p:
        out += " having " + text(p["having"])  # type: ignore[arg-type]
    return out + tail


def canonical(sql: str | None) -> str | None:
    """Canonical spelling of a statement in lower case, None if it is not parsable."""
    tree = try_parse(sql)
    return text(tree).lower() if tree else None
