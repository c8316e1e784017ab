"""Lexer and recursive-descent parser of the dialect.

Expressions become small tuples ``(kind, ...)``; a SELECT becomes ``Select``.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

_TOKEN = re.compile(
    r"""(?P<ws>\s+|--[^\n]*)|(?P<blob>[xX]'[0-9a-fA-F]*')|(?P<str>'(?:[^']|'')*')|(?P<num>\d+\.\d+(?:[eE][+-]?\d+)?|\d+(?:[eE][+-]?\d+)?|\.\d+)
    |(?P<name>[A-Za-z_][A-Za-z0-9_]*|"[^"]+")|(?P<param>\$[A-Za-z0-9_]+)|(?P<op><>|!=|<=|>=|[-+*/(),.<>=\[\];])""",
    re.VERBOSE,
)
_STOP = set(
    "FROM WHERE GROUP HAVING ORDER LIMIT OFFSET UNION INTERSECT EXCEPT SEARCH NEAREST FACET JOIN INNER LEFT RIGHT FULL CROSS ON AS AND OR NOT IN LIKE BETWEEN IS THEN ELSE WHEN END ASC DESC FOR TO USING WEIGHT WITH SET VALUES RETURNING ESCAPE OVER ROWS RANGE".split()
)


class SqlError(ValueError):
    """A statement that the dialect does not have."""


@dataclass
class Select:
    items: list = field(default_factory=list)  # (expr, alias); ('*',) or ('star', alias)
    distinct: bool = False
    source: tuple | None = None  # ('table', name, alias) | ('query', q, alias) | ('unnest', expr, alias, columns, offset)
    joins: list = field(default_factory=list)  # (kind, source, on)
    where: tuple | None = None
    group: list = field(default_factory=list)
    having: tuple | None = None
    search: tuple | None = None  # ([(column, weight)], text)
    nearest: list = field(default_factory=list)  # (column, vector, metric)
    facet: list = field(default_factory=list)
    order: list = field(default_factory=list)  # (expr, descending)
    limit: tuple | None = None
    offset: tuple | None = None


@dataclass
class Query:
    body: object  # Select or (op, all, left, right)
    ctes: list = field(default_factory=list)  # (name, columns, Query, materialised)
    recursive: bool = False
    order: list = field(default_factory=list)
    limit: tuple | None = None
    offset: tuple | None = None


def lex(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m:
            raise SqlError(f"unexpected {text[at]!r}")
        at = m.end()
        if m.lastgroup != "ws":
            out.append((m.lastgroup, m.group()))
    return [*out, ("end", "")]


class Parser:
    def __init__(self, text: str) -> None:
        self.tokens, self.at = lex(text), 0

    # tokens

    def word(self, ahead: int = 0) -> str:
        kind, value = self.tokens[min(self.at + ahead, len(self.tokens) - 1)]
        return value.upper() if kind in ("name", "op") else ""

    def take(self, *words: str) -> bool:
        if all(self.word(i) == w for i, w in enumerate(words)):
            self.at += len(words)
            return True
        return False

    def need(self, *words: str) -> None:
        if not self.take(*words):
            raise SqlError(f"expected {' '.join(words)} at {self.tokens[self.at][1]!r}")

    def name(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "name":
            raise SqlError(f"expected a name at {value!r}")
        self.at += 1
        return value.strip('"')

    def listed(self, item) -> list:
        out = [item()]
        while self.take(","):
            out.append(item())
        return out

    def done(self) -> None:
        self.take(";")
        if self.tokens[self.at][0] != "end":
            raise SqlError(f"unexpected {self.tokens[self.at][1]!r}")

    # queries

    def query(self) -> Query:
        q = Query(None)
        if self.take("WITH"):
            q.recursive = self.take("RECURSIVE")
            q.ctes = self.listed(self._cte)
        q.body = self._union()
        if self.take("ORDER", "BY"):
            q.order = self.listed(self._key)
        self._limits(q)
        return q

    def _cte(self):
        name, columns = self.name(), []
        if self.take("("):
            columns = self.listed(self.name)
            self.need(")")
        self.need("AS")
        kept = not self.take("NOT", "MATERIALIZED") and self.take("MATERIALIZED")
        self.need("(")
        q = self.query()
        self.need(")")
        return name, columns, q, kept

    def _union(self):
        left = self._intersect()
        while self.word() in ("UNION", "EXCEPT"):
            op = self.word()
            self.at += 1
            every = self.take("ALL")
            if every and op != "UNION":
                raise SqlError(f"{op} ALL is not supported")
            left = (op, every, left, self._intersect())
        return left

    def _intersect(self):
        left = self._operand()
        while self.take("INTERSECT"):
            if self.take("ALL"):
                raise SqlError("INTERSECT ALL is not supported")
            left = ("INTERSECT", False, left, self._operand())
        return left

    def _operand(self):
        if self.take("("):
            q = self.query()
            self.need(")")
            return q
        return self.select()

    def _limits(self, target) -> None:
        if self.take("LIMIT"):
            target.limit = self.expr()
        if self.take("OFFSET"):
            target.offset = self.expr()

    def _key(self):
        e = self.expr()
        down = self.take("DESC")
        if not down:
            self.take("ASC")
        return e, down

    def select(self) -> Select:
        self.need("SELECT")
        s = Select(distinct=self.take("DISTINCT"))
        s.items = self.listed(self._item)
        if self.take("FROM"):
            s.source = self._source()
            while (join := self._join()) is not None:
                s.joins.append(join)
        if self.take("WHERE"):
            s.where = self.expr()
        if self.take("GROUP", "BY"):
            s.group = self.listed(self.expr)
            if any(g[0] == "num" for g in s.group):
                raise SqlError("GROUP BY takes no positions")
        if self.take("HAVING"):
            s.having = self.expr()
        while self.word() in ("SEARCH", "NEAREST", "FACET"):
            if self.take("SEARCH"):
                columns = self.listed(self._weighted)
                self.need("FOR")
                s.search = (columns, self.expr())
            elif self.take("NEAREST"):
                column = self.expr()
                self.need("TO")
                vector = self.expr()
                s.nearest.append((column, vector, self.name().lower() if self.take("USING") else None))
            else:
                self.need("FACET")
                s.facet = self.listed(self.name)
        return s

    def _weighted(self):
        column = self.name()
        return column, float(self._number()) if self.take("WEIGHT") else 1.0

    def _number(self) -> str:
        kind, value = self.tokens[self.at]
        if kind != "num":
            raise SqlError(f"expected a number at {value!r}")
        self.at += 1
        return value

    def _item(self):
        if self.take("*"):
            return ("star", None), None
        if self.tokens[self.at][0] == "name" and self.word(1) == "." and self.word(2) == "*":
            alias = self.name()
            self.at += 2
            return ("star", alias), None
        e = self.expr()
        return e, self._alias()

    def _alias(self) -> str | None:
        if self.take("AS"):
            return self.name()
        kind, value = self.tokens[self.at]
        return self.name() if kind == "name" and value.upper() not in _STOP else None

    def _source(self):
        if self.take("("):
            q = self.query()
            self.need(")")
            return "query", q, self._alias()
        if self.take("UNNEST", "("):
            e = self.expr()
            self.need(")")
            alias, columns = self._alias(), []
            if alias and self.take("("):
                columns = self.listed(self.name)
                self.need(")")
            return "unnest", e, alias, columns, self.take("WITH", "OFFSET")
        name = self.name()
        while self.take("."):
            name += "." + self.name()
        return "table", name, self._alias()

    def _join(self):
        if self.take("CROSS", "JOIN"):
            return "CROSS", self._source(), None
        for kind in ("INNER", "LEFT", "RIGHT", "FULL"):
            if self.word() == kind:
                self.at += 1
                self.take("OUTER")
                self.need("JOIN")
                break
        else:
            if not self.take("JOIN"):
                return None
            kind = "INNER"
        source = self._source()
        self.need("ON")
        return kind, source, self.expr()

    # expressions

    def expr(self):
        left = self._and()
        while self.take("OR"):
            left = ("bin", "OR", left, self._and())
        return left

    def _and(self):
        left = self._not()
        while self.take("AND"):
            left = ("bin", "AND", left, self._not())
        return left

    def _not(self):
        return ("not", self._not()) if self.take("NOT") else self._comparison()

    def _comparison(self):
        left = self._sum()
        while True:
            if self.word() in ("=", "<>", "!=", "<", ">", "<=", ">="):
                op = self.word()
                self.at += 1
                left = ("bin", op, left, self._sum())
                continue
            if self.take("IS"):
                no = self.take("NOT")
                self.need("NULL")
                left = ("isnull", left, no)
                continue
            start = self.at
            no = self.take("NOT")
            if self.take("BETWEEN"):
                low = self._sum()
                self.need("AND")
                left = ("between", left, low, self._sum(), no)
            elif self.take("LIKE"):
                pattern = self._sum()
                left = ("like", left, pattern, self._sum() if self.take("ESCAPE") else None, no)
            elif self.take("IN"):
                self.need("(")
                inner = ("subquery", self.query()) if self.word() in ("SELECT", "WITH") else self.listed(self.expr)
                self.need(")")
                left = ("in", left, inner, no)
            else:
                self.at = start
                return left

    def _sum(self):
        left = self._product()
        while self.word() in ("+", "-"):
            op = self.word()
            self.at += 1
            left = ("bin", op, left, self._product())
        return left

    def _product(self):
        left = self._unary()
        while self.word() in ("*", "/"):
            op = self.word()
            self.at += 1
            left = ("bin", op, left, self._unary())
        return left

    def _unary(self):
        if self.take("-"):
            return ("neg", self._unary())
        self.take("+")
        return self._postfix()

    def _postfix(self):
        e = self._primary()
        while True:
            if self.take("["):
                e = ("at", e, self.expr())
                self.need("]")
            elif e[0] in ("name", "at", "field") and self.tokens[self.at][0] == "num" and re.fullmatch(r"\.\d+", self.tokens[self.at][1]):
                part = self.tokens[self.at][1][1:]  # an array step of a path, as in doc.a.0
                self.at += 1
                e = ("name", [*e[1], part]) if e[0] == "name" else ("field", e, part)
            elif e[0] not in ("num", "str") and self.word() == "." and self.tokens[self.at + 1][0] in ("name", "num"):
                self.at += 1
                part = self.tokens[self.at][1].strip('"')
                self.at += 1
                e = ("name", [*e[1], part]) if e[0] == "name" else ("field", e, part)
            else:
                return e

    def _primary(self):
        kind, value = self.tokens[self.at]
        if kind in ("num", "str", "blob", "param"):
            self.at += 1
            return kind, value
        if self.take("("):
            if self.word() in ("SELECT", "WITH"):
                q = self.query()
                self.need(")")
                return "subquery", q
            inside = self.listed(self.expr)
            self.need(")")
            return inside[0] if len(inside) == 1 else ("vector", inside)
        word = self.word()
        if word in ("TRUE", "FALSE", "NULL"):
            self.at += 1
            return "word", word
        if self.take("CASE"):
            return self._case()
        if self.take("EXISTS"):
            self.need("(")
            q = self.query()
            self.need(")")
            return "exists", q
        if self.take("CAST"):
            self.need("(")
            e = self.expr()
            self.need("AS")
            kind = self.type()
            self.need(")")
            return "cast", e, kind
        if word in ("DATE", "TIMESTAMP", "TIMESTAMPTZ", "TIME", "INTERVAL") and self.tokens[self.at + 1][0] == "str":
            self.at += 2
            text = self.tokens[self.at - 1][1]
            unit = self.name() if word == "INTERVAL" and self.word().rstrip("S") in ("YEAR", "MONTH", "DAY", "HOUR", "MINUTE", "SECOND") else None
            return "typed", word, text, unit
        if word in _STOP - {"LEFT", "RIGHT", "SET", "WEIGHT", "FACET", "ROWS", "RANGE"}:
            raise SqlError(f"unexpected {word}")
        name = self.name()
        if self.take("("):
            return self._call(name)
        return "name", [name]

    def _case(self):
        subject = None if self.word() == "WHEN" else self.expr()
        arms = []
        while self.take("WHEN"):
            test = self.expr()
            self.need("THEN")
            arms.append((test, self.expr()))
        other = self.expr() if self.take("ELSE") else None
        self.need("END")
        return "case", subject, arms, other

    def type(self) -> str:
        """A type's name with its arguments: DECIMAL(10,2), ENUM('a','b'), ARRAY<INT64>, STRUCT<a INT64>."""
        out = self.name().upper()
        if self.take("("):
            items = []
            for _ in iter(int, 1):
                kind, value = self.tokens[self.at]
                if kind not in ("num", "str", "name"):
                    raise SqlError(f"unexpected {value!r} in a type")
                items.append(value)
                self.at += 1
                if not self.take(","):
                    break
            self.need(")")
            out += "(" + ",".join(items) + ")"
        if self.take("<"):
            if out == "STRUCT":
                out += "<" + ", ".join(self.listed(lambda: f"{self.name()} {self.type()}")) + ">"
            else:
                out += "<" + ", ".join(self.listed(lambda: self._number() if self.tokens[self.at][0] == "num" else self.type())) + ">"
            self.need(">")
        return out

    def _call(self, name: str):
        args, names = [], []
        if self.take("*"):
            args = [("star", None)]
        elif self.word() != ")":
            for _ in iter(int, 1):
                args.append(self.expr())
                names.append(self.name() if self.take("AS") else None)
                if not self.take(","):
                    break
        self.need(")")
        call = ("call", name.upper(), args, names)
        return ("over", call, self._window()) if self.take("OVER") else call

    def _window(self):
        self.need("(")
        by = self.listed(self.expr) if self.take("PARTITION", "BY") else []
        order = self.listed(self._key) if self.take("ORDER", "BY") else []
        frame = None
        if self.word() in ("ROWS", "RANGE"):
            kind = self.name().upper()
            if self.take("BETWEEN"):
                low = self._bound()
                self.need("AND")
                frame = (kind, low, self._bound())
            else:
                frame = (kind, self._bound(), "CURRENT ROW")
        self.need(")")
        return by, order, frame

    def _bound(self) -> str:
        if self.take("CURRENT", "ROW"):
            return "CURRENT ROW"
        first = "UNBOUNDED" if self.take("UNBOUNDED") else self._number()
        side = self.name().upper()
        if side not in ("PRECEDING", "FOLLOWING"):
            raise SqlError("a frame bound is PRECEDING or FOLLOWING")
        return f"{first} {side}"
