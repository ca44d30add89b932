"""Table-driven generalised LR parsing from bundled grammars.

`Tables` turns a grammar text into an SLR(1) automaton; where a state has several actions for a token, all are
followed (generalised LR), so grammars may be ambiguous: only whether a token stream is a sentence matters here.
`Parser` keeps each parse stack once (a node is a state over a node), and each set of living stacks once (a
front); fronts remember their successor for each token, so over many files parsing becomes one table
look-up per token.
"""

from __future__ import annotations

import re
from functools import cached_property

_SYMBOL = re.compile(r"\s*('[^']*'|[^\s()|?*+']+|[()|?*+])")


class Tables:
    """SLR(1) tables of a grammar in lines `name: alternative | ...` with ( ), ?, * and +; other names are tokens."""

    def __init__(self, text: str, starts: tuple[str, ...]):
        self.rules: list[tuple[str, tuple[str, ...]]] = []
        self.names: set[str] = set()
        bodies: list[tuple[str, str]] = []
        for line in re.sub(r"\n\s+", " ", text).splitlines():
            line = line.split("#")[0].strip()
            if line:
                name, body = line.split(":", 1)
                bodies.append((name.strip(), body))
        self.names |= {n for n, _ in bodies} | {"ANYTOKEN"}
        for name, body in bodies:
            symbols = _SYMBOL.findall(body)
            self._alternatives(name, symbols)
        tokens = {s for _, r in self.rules for s in r if s not in self.names}
        self.rules += [("ANYTOKEN", (t,)) for t in sorted(tokens - set("()[]{}"))] if any("ANYTOKEN" in r for _, r in self.rules) else []
        self.starts = {s: f"{s}'" for s in starts}
        for s, t in self.starts.items():
            self.names.add(t)
            self.rules.append((t, (s,)))
        self.rules = list(dict.fromkeys(self.rules))
        self.tokens = sorted(tokens | {"$"})
        self._build()

    def _fresh(self, name: str) -> str:
        self.count = getattr(self, "count", 0) + 1
        self.names.add(f"{name}~{self.count}")
        return f"{name}~{self.count}"

    def _alternatives(self, name: str, symbols: list[str]) -> None:
        """Adds the rules of `name`; consumes symbols up to an unmatched )."""
        current: list[str] = []
        while symbols and symbols[0] != ")":
            s = symbols.pop(0)
            if s == "|":
                self.rules.append((name, tuple(current)))
                current = []
                continue
            if s == "(":
                item = self._fresh(name)
                self._alternatives(item, symbols)
                symbols.pop(0)
            else:
                item = s.strip("'") if len(s) > 1 else s
            if symbols and symbols[0] in "?*+":
                kind, many = symbols.pop(0), self._fresh(name)
                if kind == "?":
                    self.rules += [(many, ()), (many, (item,))]
                elif kind == "*":
                    self.rules += [(many, ()), (many, (many, item))]
                else:
                    self.rules += [(many, (item,)), (many, (many, item))]
                item = many
            current.append(item)
        self.rules.append((name, tuple(current)))

    def _build(self) -> None:
        rules, by = self.rules, {}
        for i, (n, _) in enumerate(rules):
            by.setdefault(n, []).append(i)
        empty, first = set(), {t: {t} for t in self.tokens}
        first |= {n: set() for n in self.names}
        changed = True
        while changed:
            changed = False
            for n, r in rules:
                before = len(first[n]), n in empty
                for s in r:
                    first[n] |= first[s]
                    if s not in empty:
                        break
                else:
                    empty.add(n)
                changed |= before != (len(first[n]), n in empty)
        follow: dict[str, set[str]] = {n: set() for n in self.names}
        for t in self.starts.values():
            follow[t].add("$")
        changed = True
        while changed:
            changed = False
            for n, r in rules:
                tail = follow[n]
                for s in reversed(r):
                    if s in self.names:
                        if not tail <= follow[s]:
                            follow[s] |= tail
                            changed = True
                        tail = tail | first[s] if s in empty else first[s]
                    else:
                        tail = first[s]

        def closure(kernel: frozenset) -> list[tuple[int, int]]:
            seen, todo, done = set(kernel), list(kernel), set()
            for i, d in todo:
                r = rules[i][1]
                if d < len(r) and r[d] in by and r[d] not in done:
                    done.add(r[d])
                    for j in by[r[d]]:
                        if (j, 0) not in seen:
                            seen.add((j, 0))
                            todo.append((j, 0))
            return todo

        states: dict[frozenset, int] = {}
        order: list[frozenset] = []

        def state(kernel: frozenset) -> int:
            if kernel not in states:
                states[kernel] = len(order)
                order.append(kernel)
            return states[kernel]

        self.begin = {s: state(frozenset({(by[t][0], 0)})) for s, t in self.starts.items()}
        self.shift: list[dict[str, int]] = []
        self.reduce: list[dict[str, list[tuple[str, int]]]] = []
        accepting = {by[t][0] for t in self.starts.values()}
        self.accept: set[int] = set()
        for k, kernel in enumerate(order):
            moves: dict[str, set] = {}
            reduce: dict[str, list[tuple[str, int]]] = {}
            for i, d in closure(kernel):
                n, r = rules[i]
                if d < len(r):
                    moves.setdefault(r[d], set()).add((i, d + 1))
                elif i in accepting:
                    self.accept.add(k)
                else:
                    for t in follow[n]:
                        reduce.setdefault(t, []).append((n, len(r)))
            self.shift.append({s: state(frozenset(m)) for s, m in moves.items()})
            self.reduce.append(reduce)


class Front:
    """A set of living stacks, and what follows it for each token."""

    __slots__ = ("next", "stacks")

    def __init__(self, stacks: list[tuple]):
        self.stacks = stacks
        self.next: dict[str, Front | None] = {}


class Parser:
    """Follows token streams of one grammar; `codes` gives each token as one character."""

    LIMIT = 100_000  #: Remembered fronts; beyond it all are forgotten and found anew.

    def __init__(self, tables: Tables):
        self.tables = tables
        self.codes = {t: chr(0x100 + i) for i, t in enumerate(tables.tokens)}
        self.token_of = {c: t for t, c in self.codes.items()}
        self._forget()

    def _forget(self) -> None:
        self.nodes: dict[tuple, tuple] = {}
        self.fronts: dict[frozenset, Front] = {}

    def node(self, state: int, below: tuple | None) -> tuple:
        key = (state, id(below))
        if key not in self.nodes:
            self.nodes[key] = (state, below)
        return self.nodes[key]

    def front(self, stacks: list[tuple]) -> Front:
        key = frozenset(map(id, stacks))
        if key not in self.fronts:
            self.fronts[key] = Front(stacks)
        return self.fronts[key]

    def _settle(self, front: Front, token: str) -> list[tuple]:
        """All stacks after the reductions that `token` allows, the front's own among them."""
        seen = {id(s): s for s in front.stacks}
        todo = list(front.stacks)
        for stack in todo:
            for name, n in self.tables.reduce[stack[0]].get(token, ()):
                under = stack
                for _ in range(n):
                    under = under[1]
                new = self.node(self.tables.shift[under[0]][name], under)
                if id(new) not in seen:
                    seen[id(new)] = new
                    todo.append(new)
        return todo

    def step(self, front: Front, code: str) -> Front | None:
        token = self.token_of.get(code)
        if token is None:
            return None
        moved = {}
        for stack in self._settle(front, token):
            to = self.tables.shift[stack[0]].get(token)
            if to is not None:
                new = self.node(to, stack)
                moved[id(new)] = new
        out = self.front(list(moved.values())) if moved else None
        front.next[code] = out
        return out

    def ends(self, front: Front) -> bool:
        return any(s[0] in self.tables.accept for s in self._settle(front, "$"))

    def begin(self, start: str) -> Front:
        if len(self.fronts) > self.LIMIT:
            self._forget()
        return self.front([self.node(self.tables.begin[start], None)])

    @cached_property
    def _semi(self) -> str:
        return self.codes.get("VSEMI", "")

    def advance(self, front: Front, c: str, line_end: bool) -> Front | None:
        """The front after token c, `line_end` if a line ended before it; None if no parse lives on."""
        semi = self._semi
        if semi and line_end and c == self.codes.get("INC"):
            front = (front.next[semi] if semi in front.next else self.step(front, semi)) or front
        to = front.next[c] if c in front.next else self.step(front, c)
        if to is None and semi and (line_end or c == self.codes.get("}")):
            mid = front.next[semi] if semi in front.next else self.step(front, semi)
            to = mid and (mid.next[c] if c in mid.next else self.step(mid, c))
        return to

    def error(self, stream: str, start: str, line_end: str = "\n") -> int | None:
        """Index of the first token at which no parse lives any more (len(stream): at its end); None for a sentence.

        A line end is no token; at one, before a closing brace and at the end a missing statement end (VSEMI)
        may stand, in grammars that have that token."""
        front, semi, brace, inc, step = self.begin(start), self._semi, self.codes.get("}"), self.codes.get("INC"), self.step
        for k, c in enumerate(stream):
            if c == line_end:
                continue
            if c == inc and semi and stream[k - 1 : k] == line_end:  # ++ on a new line begins a statement
                front = (front.next[semi] if semi in front.next else step(front, semi)) or front
            try:
                to = front.next[c]
            except KeyError:
                to = step(front, c)
            if to is None and semi and (c == brace or stream[k - 1 : k] == line_end):
                mid = front.next[semi] if semi in front.next else step(front, semi)
                to = mid and (mid.next[c] if c in mid.next else step(mid, c))
            if to is None:
                return k
            front = to
        if self.ends(front):
            return None
        if semi:
            mid = front.next[semi] if semi in front.next else step(front, semi)
            if mid and self.ends(mid):
                return None
        return len(stream)
