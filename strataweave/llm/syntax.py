"""Source files that do not parse.

Each file's token stream is parsed in full by the grammar of the language that its extension stands for, and the
first unrecoverable error is reported.  Lexers are one regular expression per language; parsing is one table
look-up per token (see `parsing`), which keeps the cost near that of reading the text.

What no regular expression can tell is left by it as an opener (`_OPENERS`): a literal or comment that may nest is then
read with a stack, holes in templates and interpolated strings by the same lexer and grammar, and a script's `/` begins
a regular expression where the parser's state allows no operator.  Texts without an opener never take that slower way.

Defined cases: null content and unknown extensions are no case; files without any token are valid, except .json;
a leading byte order mark and any line ends are allowed; NUL characters are valid nowhere; repeated rows of a file_id
count once (latest scanned_at); an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataweave.functions.text import project_key
from strataweave.llm import grammars as G
from strataweave.llm.parsing import Parser, Tables

# Extensions and their languages.
LANGUAGES = {"cs": "C#", "ts": "TypeScript", "js": "JavaScript", "py": "Python", "sql": "SQL", "rs": "Rust", "json": "JSON"}

_ASSIGN = "+= -= *= /= %= &= |= ^= <<= >>="
_OPERATORS = {
    "script": {"ASSIGN": _ASSIGN + " **= >>>= &&= ||= ??=", "BIN": "=== !== == != <= >= && || ?? << ** / % ^", "INC": "++ --", "": "... => ?. ( ) [ ] { } ; , . ? : = < > + - * & | ! ~ @"},
    "cs": {"ASSIGN": _ASSIGN + " ??=", "BIN": "== != <= >= && || ?? << / %", "INC": "++ --", "": "=> ?. -> :: .. ( ) [ ] { } ; , . ? : = < > + - * & | ^ ! ~"},
    "rs": {"ASSIGN": _ASSIGN, "BIN": "== != <= >= << / % ^", "": "..= ... .. :: -> => && || ( ) [ ] { } ; , . ? : = < > + - * & | ! @ $"},
    "py": {"ASSIGN": _ASSIGN + " **= //= @=", "CMP": "== != <= >=", "BIN": "// % ^ & << >>", "": "... -> := ** ( ) [ ] { } ; , . : = < > + - * / | ~ @"},
    "sql": {"CMP": "<=> <> != <= >= < >", "BIN": "|| << >> + - / % | & ^ ~", "CAST": "::", "": "( ) [ ] ; , . = *"},
    "json": {"": "{ } [ ] , :"},
}
_C_COMMENT = r"//[^\n]*|/\*[\s\S]*?\*/"
_NUMBER = r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d[\d_]*)?)"
_D = r"\d(?:_?\d)*"
_PY_NUMBER = rf"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:{_D}(?:\.(?:{_D})?)?|\.{_D})(?:[eE][+-]?{_D})?[jJ]?)(?!\w)"
_PY_PREFIX, _PY_F = r"(?:[rR][bB]?|[bB][rR]?|[uU])?", r"(?:[fF][rR]?|[rR][fF])"

_LITERALS = {
    "script": [_C_COMMENT, r'"(?:[^"\\\n]|\\[\s\S])*"', r"'(?:[^'\\\n]|\\[\s\S])*'", r"`(?:[^`\\$]|\\[\s\S]|\$(?!\{))*`", _NUMBER + r"\.?n?(?![\w$])", r"#?(?:[^\W\d]|\$)(?:\w|\$)*"],
    "cs": [
        r"#(?:region|endregion|if|else|elif|endif|pragma|nullable|define|undef|line|warning|error)\b[^\n]*", _C_COMMENT, r'\$*"{3,}', r'(?:\$@|@\$)"', r'@"(?:[^"]|"")*"',
        r'\$"(?:[^"\\{}\n]|\\.|\{\{|\}\})*"', r'\$"', r'"(?:[^"\\\n]|\\.)*"(?:u8)?', r"'(?:[^'\\\n]|\\[^\n][0-9a-fA-F]*)'", _NUMBER + r"[uUlLfFdDmM]{0,2}(?!\w)", r"@?[^\W\d]\w*",
    ],
    "rs": [
        r"//[^\n]*|/\*(?:[^*/]|\*(?!/)|/(?!\*))*\*/|/\*", r'#!?\[(?:[^\[\]"]|"(?:[^"\\]|\\.)*"|\[[^\[\]]*\])*\]', r'[bc]?r"[^"]*"|[bc]?r#+"', r'[bc]?"(?:[^"\\]|\\[\s\S])*"', r"b?'(?:[^'\\\n]|\\(?:u\{[0-9a-fA-F_]+\}|x[0-9a-fA-F]{2}|.))'", r"'[^\W\d]\w*",
        r"(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|\d[\d_]*(?:\.\d[\d_]*)?(?:[eE][+-]?[\d_]+)?)(?:[iuf]\d+|[iu]size)?(?!\w)", r"(?:r#)?[^\W\d]\w*",
    ],
    "py": [
        r"#[^\n]*", r"\\\n", r"\n[ \t\f]*", _PY_F + r"""(?:"(?!"")(?:[^"\\{}\n]|\\[^N{}]|\{\{|\}\})*"|'(?!'')(?:[^'\\{}\n]|\\[^N{}]|\{\{|\}\})*')""", _PY_F + r"""(?:\"{3}|'{3}|"|')""",
        _PY_PREFIX + r"""(?:\"{3}(?:[^"\\]|\\[\s\S]|"(?!""))*\"{3}|'{3}(?:[^'\\]|\\[\s\S]|'(?!''))*'{3}|"(?!"")(?:[^"\\\n]|\\[\s\S])*"|'(?!'')(?:[^'\\\n]|\\[\s\S])*')""",
        _PY_NUMBER, r"[^\W\d]\w*",
    ],
    "sql": [
        r"--[^\n]*", r"/\*[\s\S]*?\*/", r"[eE]'(?:[^'\\]|\\[\s\S]|'')*'", r"(?:[NnXxBb]|[uU]&)?'(?:[^']|'')*'", r'"(?:[^"]|"")+"', r"`[^`]+`", r"\[[^\W\d][\w .]*\]", _NUMBER + r"(?!\w)", r"\$(?:[^\W\d]\w*)?\$",
        r"@{1,2}\w+|:[^\W\d]\w*|\$\d+|\?", r"#{0,2}[^\W\d][\w$#]*",
    ],
    "json": [r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"', r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?(?![\w.])", r"\w+"],
}
_COMMENTS = {"script": ("//", "/*"), "cs": ("//", "/*", "#"), "rs": ("//", "/*"), "sql": ("--", "/*"), "py": "#", "json": "\x03"}
# Tokens after which the text is read with a stack.
_OPENERS = {
    "script": {"`", "/", "/="},
    "cs": {'$"', '$@"', '@$"', *("$" * k + '"' * n for k in range(4) for n in range(3, 9))},
    "rs": {"/*", *(p + "r" + "#" * n + '"' for p in ("", "b", "c") for n in range(1, 256))},
    "py": {"".join(p) + q for k in (1, 2) for p in itertools.product("fFrR", repeat=k) if "f" in "".join(p).lower() for q in ('"', "'", '"""', "\'\'\'")},
}
_JS_REGEX = re.compile(r"/(?![*/])(?:[^/\\\n\[]|\\[^\n]|\[(?:[^\]\\\n]|\\[^\n])*\])+/[A-Za-z]*")
_BAD_ESCAPE = re.compile(r"(?<!\\)(?:\\\\)*\\(?:x(?![\da-fA-F]{2})|u(?![\da-fA-F]{4})|U(?!(?:000[\da-fA-F]|0010)[\da-fA-F]{4})|N(?!\{[^{}]+\}))")
_LITERAL, _COMMENT = "\x01", "\x02"  # what a construct read with a stack stands for


class Language:
    """Lexer and parser of one language; made once in each worker."""

    hole_start = "expr"

    def __init__(self, kind: str, grammar: str, starts: tuple[str, ...], reserved: list[str], newline: bool):
        self.kind, self.starts = kind, starts
        self.parser = Parser(Tables(grammar, starts))
        codes = self.parser.codes
        assert not self.parser.tables.names & set(reserved), "a rule is named like a word of the language"
        ops = {op: codes.get(name or op, "\0") for name, text in _OPERATORS[kind].items() for op in text.split()}
        literals = list(_LITERALS[kind])
        tail = [re.escape(op) for op in sorted(ops, key=len, reverse=True)]
        blank = [r"[^ \t\n\r]"] if kind == "json" else [r"\n", r"\S"] if newline else [r"\S"]
        self.lexer = re.compile("|".join([*literals, *tail, *blank]))
        self.known = ops | {w: codes[w] for w in reserved if w in codes} | ({"\n": "\n"} if newline else {})
        if kind == "sql":
            self.known |= {"TOP": codes["ID_TOP"], "ILIKE": codes["ID_LIKE"], "EXECUTE": codes["EXEC"], "REGEXP": codes["ID_LIKE"], "RLIKE": codes["ID_LIKE"]}
        self.codes = codes

    def other(self, t: str, following: str = "") -> str:
        """The code of a token that is no operator or reserved word; empty for comments."""
        c, codes, kind = t[0], self.codes, self.kind
        if kind == "json" and c not in '"' and not _JSON_NUMBER.fullmatch(t):
            return "\0"
        if kind == "py" and c == "0" and len(t) > 1 and t.replace("_", "").isdigit() and t.strip("0_"):
            return "\0"
        if c.isdigit() or (c == "." and len(t) > 1) or (kind == "json" and c == "-" and len(t) > 1):
            return codes["NUM"] if len(t) > 1 or t.isdigit() else "\0"
        if kind == "json":
            return codes["STR"] if c == '"' and len(t) > 1 else "\0"
        if t == _LITERAL:
            return codes["TPL" if kind == "script" else "STR"]
        if t == _COMMENT:
            return ""
        if t.startswith(_COMMENTS[kind]) and len(t) > (kind in ("script", "cs", "rs", "sql")):
            return ""
        if t[-1] in "\"'" and len(t) > 1 or t.endswith(('"u8', '"#')):
            if kind == "sql":
                return codes["ID"] if c == '"' else codes["STR"]
            if kind == "rs" and t[-1] == "'" or kind == "cs" and c == "'":
                return codes["CHAR"]
            if kind == "py":
                prefix = t[: t.index(t[-1])].lower()
                if "b" in prefix and not t.isascii() or "r" not in prefix and "b" not in prefix and "\\" in t and _BAD_ESCAPE.search(t):
                    return "\0"
            return codes["STR"]
        if kind == "script" and c == "/":
            return codes["REGEX"] if len(t) > 2 else "\0"
        if c == "`" and len(t) > 1:
            return codes["ID"] if kind == "sql" else codes["TPL"]
        if kind == "sql":
            if c in "@:$?":
                return codes["VARN"]
            if c in "[#" and len(t) > 1:
                return codes["ID"]
        if c == "#":
            if kind == "cs":
                return "" if len(t) > 1 else "\0"
            if kind == "rs" and len(t) > 1:
                return codes["IATTR" if t[1] == "!" else "ATTR"]
            return codes["PRIV"] if kind == "script" and len(t) > 1 else "\0"
        if kind == "rs" and c == "'" and len(t) > 1:
            return codes["LIFE"]
        if c.isalpha() or c == "_" or c == "$" and kind == "script" or c == "@" and kind == "cs" and len(t) > 1:
            return codes["ID"]
        return "\0"

    def hard(self, tokens: list[str], text: str) -> bool:
        """Whether the text needs a stack somewhere."""
        return self.kind == "sql" and "$" in text and any(t[0] == "$" and t[-1] == "$" for t in tokens) or self.kind in _OPENERS and not self.openers.isdisjoint(tokens)

    def tokens(self, text: str) -> list[str]:
        """The tokens; a construct read with a stack is one, and what does not end is a NUL.

        A script's `/` is taken for a division here; `error` asks the parser."""
        found = self.lexer.findall(text)
        return [t for t, _, _ in self.scan(text)] if self.hard(found, text) else found

    def scan(self, text: str, at: int = 0) -> Iterator[tuple[str, int, int]]:
        """(token, start, end), with every construct that nests read with a stack."""
        while at < len(text):
            for m in self.lexer.finditer(text, at):
                t = m.group()
                if t in self.openers and t not in ("/", "/=") or self.kind == "sql" and t[0] == "$" == t[-1]:
                    what, at = self.construct(text, m.start(), t)
                    yield what, m.start(), at
                    break
                yield t, m.start(), m.end()
            else:
                return

    def construct(self, text: str, start: int, t: str) -> tuple[str, int]:
        """What begins at `start` with the opener t, and where it ends; a NUL up to the end of the text if it does not."""
        at, lost = start + len(t), ("\0", len(text))
        if t == "/*":
            depth = 1
            for m in re.compile(r"/\*|\*/").finditer(text, at):
                depth += 1 if m.group() == "/*" else -1
                if not depth:
                    return _COMMENT, m.end()
            return lost
        if self.kind in ("rs", "sql"):
            close = '"' + "#" * t.count("#") if self.kind == "rs" else t
            end = text.find(close, at)
            return (_LITERAL, end + len(close)) if end >= 0 else lost
        if self.kind == "script":
            return self.interpolated(text, at, re.compile(r"\\[\s\S]|`|\$\{"), "`", {"${"}, "}") or lost
        if self.kind == "cs":
            quotes = t.lstrip("$@")
            if len(quotes) >= 3:
                end = text.find(quotes, at)
                while 0 <= end and text[end + len(quotes) : end + len(quotes) + 1] == '"':
                    end += 1
                if end < 0:
                    return lost
                holes, at = t.count("$"), start + len(t)
                opener = re.compile("[{]{%d,}" % max(1, holes))
                while holes and (m := opener.search(text, at, end)) is not None:
                    inner = self.hole(text, m.end(), "}" * holes)
                    if inner is None or inner > end:
                        return lost
                    at = inner
                return _LITERAL, end + len(quotes)
            plain = r'""|"|\{\{|\{|\}\}' if "@" in t else r'\\.|\n|"|\{\{|\{|\}\}'
            return self.interpolated(text, at, re.compile(plain), '"', {"{"}, "}") or lost
        raw, quote = "r" in t.lower(), t.lstrip("fFrR")
        escape = "" if raw else r"\\N\{[^{}]*\}|\\[^{}]|"
        stop = "" if len(quote) == 3 else r"|\n"
        end = self.interpolated(text, at, re.compile((r"\\[" + quote[0] + r"\\]|" if raw else escape) + re.escape(quote) + r"|\{\{|\{|\}\}|\}" + stop), quote, {"{"}, "}")
        return end or lost

    def interpolated(self, text: str, at: int, marks: re.Pattern, close: str, opens: set[str], shut: str) -> tuple[str, int] | None:
        """A literal with holes up to `close`; None if it or a hole in it does not end or parse."""
        while (m := marks.search(text, at)) is not None:
            t, at = m.group(), m.end()
            if t == close:
                return _LITERAL, at
            if t in opens:
                inner = self.hole(text, at, shut)
                if inner is None:
                    return None
                at = inner
            elif t == "\n" or t == "}":
                return None
        return None

    def hole(self, text: str, at: int, shut: str) -> int | None:
        """Where the hole that begins at `at` ends, behind `shut`; None if what it holds does not parse."""
        if self.kind == "script":
            got = self.follow(text, at, "expr", True)
            return got if isinstance(got, int) and got > 0 else None
        codes, depth, lambdas = [], 0, 0
        for t, start, end in self.scan(text, at):
            flat = depth == 0
            if flat and (t[0] == "}" or t == ":" and not lambdas or t == "," and self.kind == "cs" or t in ("!", "=") and self.kind == "py" and re.compile(r"=?\s*(?:![rsa])?\s*[:}]").match(text, start)):
                if not codes or self.parser.error("".join(codes), self.hole_start) is not None:
                    return None
                return self.format_spec(text, start, shut)
            if t == "\0":
                return None
            depth += (t in ("(", "[", "{")) - (t in (")", "]", "}"))
            if self.kind == "py":
                lambdas += (t == "lambda") if flat else 0
                lambdas -= t == ":" and flat
            if t[0] != "\n":
                c = self.known.get(t)
                codes.append(self.other(t) if c is None else c)
        return None

    def format_spec(self, text: str, at: int, shut: str) -> int | None:
        """Behind the hole's end: alignment, conversion and format up to `shut`, with holes of its own in Python."""
        if self.kind == "py":
            at = re.compile(r"=?\s*(?:![rsa])?\s*").match(text, at).end()
            if text[at : at + 1] == ":":
                while (m := re.compile(r"[{}\n]").search(text, at)) is not None and m.group() == "{":
                    inner = self.hole(text, m.end(), "}")
                    if inner is None:
                        return None
                    at = inner
                at = m.start() if m else len(text)
            return at + 1 if text[at : at + 1] == "}" else None
        end = text.find(shut, at)
        while 0 <= end and shut == "}" and text[end + 1 : end + 2] == "}" and ":" in text[at:end] and text[at:end].endswith("\\"):
            end = text.find(shut, end + 1)
        return None if end < 0 or "\n" in text[at:end] else end + len(shut)

    def follow(self, text: str, at: int, start: str, inside: bool) -> int | None:
        """Parses a script token by token from `at`: -1 - k for a first error at token k, None for a sentence;
        `inside` a hole, the place behind the brace that ends it."""
        parser, known, codes = self.parser, self.known, self.codes
        front, depth, k, line_end, last, semi = parser.begin(start), 0, 0, False, "", codes.get("VSEMI", "")
        while True:
            for m in self.lexer.finditer(text, at):
                t = m.group()
                self.place = m.start()
                if inside and t == "}" and not depth:
                    return m.end() if k and parser.ends(front) else -1 - k
                jump = None
                if t in ("/", "/="):
                    r = _JS_REGEX.match(text, m.start())
                    # A word that is an operator here and might be a name elsewhere is an operator.
                    asks = r and last in ("await", "yield", "of") and parser.advance(front, codes["REGEX"], False)
                    if asks or parser.advance(front, codes["BIN" if t == "/" else "ASSIGN"], False) is None:
                        c, jump = (codes["REGEX"], r.end()) if r else ("\0", len(text))
                    else:
                        c = known[t]
                elif t == "`":
                    what, jump = self.construct(text, m.start(), t)
                    c = "\0" if what == "\0" else codes["TPL"]
                else:
                    c = known.get(t)
                    if c is None:
                        c = self.other(t)
                depth += (t == "{") - (t == "}")
                if c == "\n":
                    line_end = True
                elif c:
                    to = parser.advance(front, c, line_end)
                    if to is None:
                        return -1 - k
                    front, line_end, k, last = to, False, k + 1, t
                if jump is not None:
                    at = jump
                    break
            else:
                if inside:
                    return -1 - k
                if not k or parser.ends(front) or (mid := parser.advance(front, semi, False)) and parser.ends(mid):
                    return None
                return -1 - k

    @property
    def openers(self) -> set[str]:
        return _OPENERS.get(self.kind, set())

    def stream(self, text: str) -> str:
        known, other = self.known, self.other
        if self.kind == "sql":
            return "".join([known.get(t) or known.get(t.upper()) or other(t) for t in self.tokens(text)])
        cache: dict[str, str] = {}
        out = []
        for t in self.tokens(text):
            c = known.get(t)
            if c is None:
                c = cache.get(t)
                if c is None:
                    c = cache[t] = other(t)
            out.append(c)
        return "".join(out)

    def error(self, text: str) -> int | None:
        """Index of the first bad token, None if the text parses or has no token."""
        if "\0" in text:
            return 0
        text = text[1:] if text.startswith("﻿") else text
        text = text.replace("\r\n", "\n").replace("\r", "\n")
        if self.kind == "script" and text.startswith("#!"):
            text = text[text.find("\n") :] if "\n" in text else ""
        self.place = None
        if self.kind == "script" and self.hard(self.lexer.findall(text), text):
            got = self.follow(text, 0, self.starts[0], False)
            return None if got is None else -1 - got
        s = self.stream(text)
        if not s.strip("\n") and self.kind != "json":
            return None
        return self.parser.error(s, self.starts[0])

    def line_of(self, text: str, index: int) -> int:
        """The line, from 1, of the token at which `error` last found that index; the last line at the end."""
        text = (text[1:] if text.startswith("\ufeff") else text).replace("\r\n", "\n").replace("\r", "\n")
        if self.place is not None:
            return text.count("\n", 0, self.place) + 1
        at = 0
        for code, start in self.placed(text):
            if code:
                if at == index:
                    return text.count("\n", 0, start) + 1
                at += 1
        return text.rstrip("\n").count("\n") + 1

    def placed(self, text: str) -> Iterator[tuple[str, int]]:
        """The codes of the stream and where they stand."""
        for t, start, _ in self.scan(text):
            yield self.known.get(t) or (self.kind == "sql" and self.known.get(t.upper())) or self.other(t), start


class Python(Language):
    hole_start = "exprs"

    def stream(self, text: str) -> str:
        return "".join([c for c, _ in self.layout((t, 0) for t in self.tokens("\n" + text))])

    def placed(self, text: str) -> Iterator[tuple[str, int]]:
        return ((c, max(0, at - 1)) for c, at in self.layout((t, at) for t, at, _ in self.scan("\n" + text)))

    def layout(self, tokens: Iterator[tuple[str, int]]) -> Iterator[tuple[str, int]]:
        """With NEWLINE, INDENT and DEDENT as the indentation has it; tabs and blanks must agree at any width of a tab."""
        codes, known, cache = self.codes, self.known, {}
        new, indent, dedent = codes["NEWLINE"], codes["INDENT"], codes["DEDENT"]
        depth, levels, width, fresh, some, at = 0, [(0, 0)], (0, 0), True, False, 0
        for t, at in tokens:
            if t[0] == "\n":
                if depth == 0:
                    blank = t[1:].rpartition("\f")[2]
                    width, fresh = (len(blank.expandtabs(8)), len(blank)), True
                continue
            if t == "\\\n":
                continue
            c = known.get(t)
            if c is None:
                c = cache.get(t)
                if c is None:
                    c = cache[t] = self.other(t)
            if not c:
                continue
            if fresh:
                fresh = False
                if some:
                    yield new, at
                top = levels[-1]
                if width[0] > top[0] and width[1] > top[1]:
                    levels.append(width)
                    yield indent, at
                else:
                    while width[0] < levels[-1][0] and width[1] < levels[-1][1]:
                        levels.pop()
                        yield dedent, at
                    if width != levels[-1]:
                        yield "\0", at
            yield c, at
            some = True
            if len(t) == 1:
                depth = max(depth + (t in "([{") - (t in ")]}"), 0)
        if some:
            yield new, at
            for _ in levels[1:]:
                yield dedent, at


_JSON_NUMBER = re.compile(r"-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?")


@lru_cache(maxsize=8)
def language(ext: str) -> Language:
    if ext == "js":
        return Language("script", G.script(False), ("program", "expr"), G.JS_RESERVED + G.JS_CONTEXT, True)
    if ext == "ts":
        return Language("script", G.script(True), ("program", "expr"), G.JS_RESERVED + G.JS_CONTEXT + G.TS_CONTEXT, True)
    if ext == "cs":
        return Language("cs", G.CSHARP, ("unit", "expr"), G.CS_RESERVED + G.CS_CONTEXT, False)
    if ext == "rs":
        return Language("rs", G.RUST, ("file",), G.RUST_RESERVED + G.RUST_CONTEXT, False)
    if ext == "py":
        return Python("py", G.PYTHON, ("file", "exprs"), G.PY_RESERVED + ["match", "case", "type"], False)
    if ext == "sql":
        return Language("sql", G.SQL, ("file",), G.SQL_WORDS, False)
    return Language("json", G.JSON, ("file",), ["true", "false", "null"], False)


def first_error(ext: str, content: str | None) -> int | None:
    """Token index of the first unrecoverable error; None for valid files and those that are no case."""
    if content is None or ext not in LANGUAGES:
        return None
    return language(ext).error(content)


def first_error_line(ext: str, content: str | None) -> int | None:
    """Line of the first unrecoverable error; None as for `first_error`."""
    at = first_error(ext, content)
    return None if at is None else language(ext).line_of(content, at)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(F.trim(path), r"\.([A-Za-z]+)$", 1))


def parse_files(files: DataFrame) -> DataFrame:
    """(file_id, project, language, error_at) once per file; error_at, the line of the first error, is null for valid files and those that are no case.

    Files are parsed where they are read; only the verdicts are shuffled."""
    rows = files.select("file_id", project_key(F.col("project")).alias("project"), extension(F.col("file_path")).alias("ext"), F.unix_micros(F.col("scanned_at").cast("timestamp")).alias("at"), "content")

    def verdicts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            errors = [first_error_line(e, c) for e, c in zip(b.column(2).to_pylist(), b.column(4).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array(errors, pa.int64())], ["file_id", "project", "ext", "at", "error_at"])

    parsed = rows.mapInArrow(verdicts, "file_id long, project string, ext string, at long, error_at long")
    last = F.max(F.struct("at", "project", "ext", "error_at")).alias("m")
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    return parsed.groupBy("file_id").agg(last).select("file_id", "m.project", names[F.col("m.ext")].alias("language"), "m.error_at")


def parse_rates(parsed: DataFrame) -> DataFrame:
    """Files, invalid files and their rate by project and language."""
    return parsed.groupBy("project", "language").agg(F.count("*").alias("files"), F.count("error_at").alias("invalid")).withColumn("rate", F.round(F.col("invalid") / F.col("files"), 6))


