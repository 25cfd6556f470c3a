"""Java sources as units, statements and tokens: a lexer and a light statement parser, run file by file in Arrow batches.

A unit is a method or constructor with a body.  Its statements are: the signature; braces of blocks (one token each); headers of
if, switch, for, foreach and while up to their closing parenthesis (a later ``else`` joins its if); ``try`` (with its catch and
finally clauses' tokens); ``do`` (with its closing condition); and all other statements whole.  Statements of a lambda's block are
rows of their own.  A method of an anonymous or local class is a unit of its own and one METHOD token in the statement around it.

Scores follow cognitive complexity: +1 for if, switch, loops, catch, conditional expressions, else, and labelled jumps, plus the
nesting level for the first five.  ``fixed=False`` leaves catch clauses out and counts only a statement's last conditional
expression.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame

from kindred.params import CODE, CloneParams

KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally "
    "float for goto if implements import instanceof int interface long native new package private protected public return short "
    "static strictfp super switch synchronized this throw throws transient try void volatile while".split()
)
STATEMENTS = ("SIGNATURE", "BLOCK", "IF", "ELSE", "SWITCH", "FOR", "FOREACH", "WHILE", "DO", "TRY", "SYNCHRONIZED", "RETURN", "THROW", "BREAK", "CONTINUE", "ASSERT", "LABEL", "CASE", "CLASS", "EMPTY", "STATEMENT")
_KIND = {name: i for i, name in enumerate(STATEMENTS)}
_LEX = re.compile(
    r"""(?P<space>\s+)|(?P<doc>/\*\*(?!/)[\s\S]*?(?:\*/|\Z))|(?P<comment>//[^\r\n]*|/\*[\s\S]*?(?:\*/|\Z))"""
    r"""|(?P<string>\"\"\"[\s\S]*?\"\"\"|"(?:\\.|[^"\\\r\n])*"?)|(?P<char>'(?:\\.|[^'\\\r\n])*'?)"""
    r"""|(?P<number>0[xX][0-9a-fA-F_.]+(?:[pP][+-]?\d+)?[lLfFdD]?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?\d+)?[lLfFdD]?)"""
    r"""|(?P<word>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>->|::|\.\.\.|>>>=|<<=|>>=|==|!=|<=|>=|&&|\|\||\+\+|--|[-+*/%&|^]=|[\s\S])"""
)


@dataclass
class Token:
    kind: str
    text: str
    start: int
    end: int


def lex(source: str) -> list[Token]:
    out = []
    for m in _LEX.finditer(source):
        group, text = m.lastgroup, m[0]
        if group in ("space", "comment"):
            continue
        kind = text if group == "op" or group == "word" and text in KEYWORDS else {"word": "LITERAL" if text in ("true", "false", "null") else "IDENTIFIER", "doc": "DOC"}.get(group, f"LITERAL_{group.upper()}")
        out.append(Token(kind, text, m.start(), m.end()))
    return out


class Lines:
    """Offsets to 1-based (line, column); a line ends with \\n, \\r or both."""

    def __init__(self, source: str):
        self.starts = [0] + [m.end() for m in re.finditer(r"\r\n|\r|\n", source)]
        self.newlines = source.count("\n")

    def at(self, offset: int) -> tuple[int, int]:
        line = bisect_right(self.starts, offset)
        return line, offset - self.starts[line - 1] + 1


@dataclass
class Stmt:
    kind: str
    start: int
    end: int
    tokens: list[Token] = field(default_factory=list)
    cc: int = 0


@dataclass
class Unit:
    package: str
    cls: str
    name: str
    params: str
    start: int
    end: int = 0
    stmts: list[Stmt] = field(default_factory=list)


class Parser:
    def __init__(self, source: str, fixed: bool = True):
        self.t = lex(source)
        self.i = 0
        self.fixed = fixed
        self.units: list[Unit] = []
        self.package = ""
        self.anonymous = 0

    # ---- helpers
    def kind(self, ahead: int = 0) -> str:
        k = self.i + ahead
        return self.t[k].kind if k < len(self.t) else ""

    def close(self, at: int, opener: str, closer: str) -> int:
        """Index of the token that closes the one at ``at`` (the last token if nothing does)."""
        depth = 0
        for k in range(at, len(self.t)):
            if self.t[k].kind == opener:
                depth += 1
            elif self.t[k].kind == closer:
                depth -= 1
                if not depth:
                    return k
        return len(self.t) - 1

    def parse(self) -> list[Unit]:
        k = next((k for k, t in enumerate(self.t) if t.kind == "package"), None)  # a keyword: it stands nowhere else
        if k is not None:
            end = next((j for j in range(k, len(self.t)) if self.t[j].kind == ";"), k)
            self.package = "".join(t.text for t in self.t[k + 1 : end])
        while self.i < len(self.t):
            if self.is_class():
                self.class_decl("")
            else:
                self.i += 1
        return sorted(self.units, key=lambda u: u.start)

    def is_class(self) -> bool:
        if self.kind() in ("class", "interface", "enum"):
            return self.kind(1) == "IDENTIFIER" and (self.i == 0 or self.t[self.i - 1].kind != ".")
        return self.i < len(self.t) and self.t[self.i].text == "record" and self.kind(1) == "IDENTIFIER" and self.kind(2) in ("(", "<")

    def class_decl(self, outer: str) -> None:
        name = self.t[self.i + 1].text
        while self.i < len(self.t) and self.kind() not in ("{", ";"):
            self.i = self.close(self.i, "(", ")") + 1 if self.kind() == "(" else self.i + 1
        if self.kind() == "{":
            self.class_body(f"{outer}.{name}" if outer else name)

    def class_body(self, path: str) -> int:
        """Members from the opening brace on; returns the number of methods with a body."""
        end = self.close(self.i, "{", "}")
        self.i += 1
        methods, member = 0, self.i
        while self.i < end:
            k = self.kind()
            if self.is_class():
                self.class_decl(path)
                member = self.i
            elif k == "(" and self.t[self.i - 1].kind == "IDENTIFIER" and not any(t.kind in ("=", "new") for t in self.t[member : self.i]) and self.t[member].kind != "." and not (self.i >= 2 and self.t[self.i - 2].kind == "@"):
                shut = self.close(self.i, "(", ")")
                k = shut + 1
                while k < end and self.t[k].kind not in ("{", ";", "=", ","):
                    k += 1
                if k < end and self.t[k].kind == "{":
                    self.method(path, member, self.i - 1, shut, k)
                    methods += 1
                else:
                    self.i = k + 1
                member = self.i
            elif k == "(":
                self.i = self.close(self.i, "(", ")") + 1
            elif k == "{":  # an initialiser, or a body in a field's value
                self.i = self.close(self.i, "{", "}") + 1
                if self.t[self.i - 1].kind == "}" and self.kind() != ";":
                    member = self.i
            else:
                self.i += 1
                if k == ";":
                    member = self.i
        self.i = end + 1
        return methods

    def method(self, path: str, first: int, name: int, shut: int, brace: int) -> None:
        params = " ".join(t.text for t in self.t[name + 1 : shut + 1])
        unit = Unit(self.package, path, self.t[name].text, params, self.t[first].start)
        head = self.t[first:brace]
        unit.stmts.append(Stmt("SIGNATURE", head[0].start, head[-1].end, head))
        self.units.append(unit)
        self.i = brace
        self.block(unit, 0)
        unit.end = self.t[self.i - 1].end

    # ---- statements
    def add(self, unit: Unit, kind: str, tokens: list[Token], cc: int = 0) -> Stmt:
        s = Stmt(kind, tokens[0].start, tokens[-1].end, list(tokens), cc)
        unit.stmts.append(s)
        return s

    def block(self, unit: Unit, nesting: int) -> None:
        end = self.close(self.i, "{", "}")
        self.add(unit, "BLOCK", [self.t[self.i]])
        self.i += 1
        while self.i < end:
            self.statement(unit, nesting)
        if end < len(self.t):
            self.add(unit, "BLOCK", [self.t[end]])
        self.i = end + 1

    def header(self, unit: Unit, kind: str, cc: int, nesting: int) -> Stmt:
        """A keyword and what stands in its parentheses."""
        end = self.close(self.i + 1, "(", ")") if self.kind(1) == "(" else self.i
        s = Stmt(kind, self.t[self.i].start, self.t[end].end, [], cc)
        unit.stmts.append(s)
        s.tokens.append(self.t[self.i])
        self.i += 1
        self.expression(unit, s, end + 1, nesting)
        return s

    def statement(self, unit: Unit, nesting: int, in_else: bool = False) -> None:
        k = self.kind()
        if k == "{":
            self.block(unit, nesting)
        elif k == "if":
            s = self.header(unit, "ELSE" if in_else else "IF", 1 if in_else else 1 + nesting, nesting)
            self.statement(unit, nesting + (0 if in_else else 1))
            if self.kind() == "else":
                s.tokens.append(self.t[self.i])
                self.i += 1
                chained = self.kind() == "if"
                if not chained:
                    s.cc += 1
                self.statement(unit, nesting + (0 if in_else or chained else 1), chained)
        elif k in ("while", "for", "switch", "synchronized"):
            name = k.upper()
            if k == "for":
                end = self.close(self.i + 1, "(", ")")
                depth = [t.kind for t in self.t[self.i + 2 : end]]
                name = "FOREACH" if ":" in depth and ";" not in depth and "?" not in depth else "FOR"
            scored = k != "synchronized"
            self.header(unit, name, 1 + nesting if scored else 0, nesting)
            self.statement(unit, nesting + scored)
        elif k == "do":
            s = self.add(unit, "DO", [self.t[self.i]], 1 + nesting)
            self.i += 1
            self.statement(unit, nesting + 1)
            if self.kind() == "while":
                end = self.end_of_statement()
                self.expression(unit, s, end, nesting)
        elif k == "try":
            s = self.add(unit, "TRY", [self.t[self.i]])
            self.i += 1
            if self.kind() == "(":
                self.expression(unit, s, self.close(self.i, "(", ")") + 1, nesting)
            self.block(unit, nesting)
            while self.kind() in ("catch", "finally"):
                caught = self.kind() == "catch"
                s.tokens.append(self.t[self.i])
                self.i += 1
                if caught:
                    s.cc += (1 + nesting) * self.fixed
                    self.expression(unit, s, self.close(self.i, "(", ")") + 1, nesting)
                if self.kind() == "{":
                    self.block(unit, nesting + (1 if caught and self.fixed else 0))
        elif k in ("case", "default") and self.kind(1) != "IDENTIFIER" or k == "case":
            s = Stmt("CASE", self.t[self.i].start, self.t[self.i].end)
            unit.stmts.append(s)
            while self.i < len(self.t) and self.kind() not in (":", "->", "{", "}"):
                s.tokens.append(self.t[self.i])
                self.i += 1
            if self.kind() in (":", "->"):
                s.tokens.append(self.t[self.i])
                self.i += 1
            s.end = s.tokens[-1].end
        elif k == "IDENTIFIER" and self.kind(1) == ":":
            self.add(unit, "LABEL", self.t[self.i : self.i + 2])
            self.i += 2
            self.statement(unit, nesting)
        elif k == ";":
            self.add(unit, "EMPTY", [self.t[self.i]])
            self.i += 1
        elif k in ("final", "abstract", "static") and self.kind(1) in ("class", "interface", "enum"):
            self.i += 1
            self.statement(unit, nesting)
        elif self.is_class():
            at = self.i
            before = len(self.units)
            self.class_decl(unit.cls)
            s = self.add(unit, "CLASS", self.t[at : at + 2])
            s.tokens += [Token("METHOD", "METHOD", s.end, s.end) for _ in self.units[before:]]
        elif k == "}":
            self.i += 1
        else:
            name = k.upper() if k in ("return", "throw", "break", "continue", "assert") else "STATEMENT"
            end = self.end_of_statement()
            s = Stmt(name, self.t[self.i].start, self.t[end - 1].end)
            if k in ("break", "continue") and self.kind(1) == "IDENTIFIER":
                s.cc = 1
            unit.stmts.append(s)
            self.expression(unit, s, end, nesting)

    def end_of_statement(self) -> int:
        """Index after the semicolon that ends the statement at hand."""
        depth = 0
        for k in range(self.i, len(self.t)):
            kind = self.t[k].kind
            if kind in ("(", "[", "{"):
                depth += 1
            elif kind in (")", "]", "}"):
                depth -= 1
                if depth < 0:
                    return max(k, self.i + 1)
            elif kind == ";" and not depth:
                return k + 1
        return len(self.t)

    def expression(self, unit: Unit, s: Stmt, end: int, nesting: int) -> None:
        """Tokens up to ``end``, with bodies of lambdas and anonymous classes taken out."""
        inner = nesting
        while self.i < end:
            t = self.t[self.i]
            if t.kind == "?" and not (self.i and self.t[self.i - 1].kind in ("<", ",")):
                s.cc = s.cc + 1 + inner if self.fixed else 1 + inner
                inner += 1
            if t.kind == "{" and self.i and self.t[self.i - 1].kind == "->":
                self.block(unit, nesting + 1)
                continue
            if t.kind == "{" and self.i and self.t[self.i - 1].kind in (")", ">") and self._after_new():
                self.anonymous += 1
                methods = self.class_body(f"{unit.cls}.ANON{self.anonymous}")
                s.tokens += [Token("METHOD", "METHOD", t.start, t.start)] * methods
                continue
            s.tokens.append(t)
            self.i += 1

    def _after_new(self) -> bool:
        depth = 0
        for k in range(self.i - 1, -1, -1):
            kind = self.t[k].kind
            if kind == ")":
                depth += 1
            elif kind == "(":
                depth -= 1
            elif not depth and kind == "new":
                return True
            elif not depth and kind in (";", "{", "}", "="):
                return False
        return False


@lru_cache(maxsize=1 << 16)
def content_id(text: str, digits: int = 8) -> int:
    return int(hashlib.md5(text.encode()).hexdigest()[:digits], 16)


def normal(token: Token, p: CloneParams) -> int:
    """Token id: by kind, or by text for identifiers and literals that are told apart."""
    by_text = (token.kind == "IDENTIFIER" and not p.any_identifier) or (token.kind.startswith("LITERAL") and not p.any_literal) or token.kind == "DOC"
    return content_id(f"t:{token.text}" if by_text else f"k:{token.kind}")


SCHEMA = (
    "unit_id bigint, partition_key string, folder string, path string, package string, class string, signature string, from_off int, to_off int, "
    "from_line int, from_col int, to_line int, to_col int, n_newlines bigint, stmts array<struct<kind:int,tokens:array<bigint>,text:string,cc:int,from_off:int,to_off:int,from_line:int,to_line:int>>"
)


def parse_file(path: str, folder: str, partition: str, source: str, p: CloneParams, fixed: bool) -> list[tuple]:
    lines = Lines(source)
    rows = []
    seen: dict[str, int] = {}
    for u in Parser(source, fixed).parse():
        name = ".".join(x for x in (u.package, u.cls, u.name) if x) + u.params
        again = seen[name] = seen.get(name, -1) + 1
        signature = f"{name}#{again}" if again else name
        stmts = [
            {"kind": _KIND[s.kind], "tokens": [normal(t, p) for t in s.tokens], "text": " ".join(t.text for t in s.tokens), "cc": s.cc, "from_off": s.start, "to_off": s.end, "from_line": lines.at(s.start)[0], "to_line": lines.at(max(s.start, s.end - 1))[0]}
            for s in u.stmts
        ]
        rows.append((content_id(f"{path}:{u.start}", 15), partition, folder, path, u.package, u.cls, signature, u.start, u.end, *lines.at(u.start), *lines.at(max(u.start, u.end - 1)), lines.newlines, stmts))
    return rows


def units(files: DataFrame, params: CloneParams = CODE, fixed: bool = True) -> DataFrame:
    """files(path, folder, content and, if there is one, partition_key) as units."""
    from pyspark.sql import functions as F

    key = F.col("partition_key") if "partition_key" in files.columns else F.lit("")

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            rows = [row for f in pdf.itertuples(index=False) for row in parse_file(f.path, f.folder, f.partition_key, f.content or "", params, fixed)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])

    return files.select("path", "folder", key.alias("partition_key"), "content").mapInPandas(run, SCHEMA)


def packages(units_df: DataFrame) -> DataFrame:
    """Distinct packages of units."""
    return units_df.select("package").distinct()


def classes(units_df: DataFrame) -> DataFrame:
    """Distinct classes by file, with their number of methods."""
    from pyspark.sql import functions as F

    return units_df.groupBy("path", "package", "class").agg(F.count("*").alias("n_methods"))
