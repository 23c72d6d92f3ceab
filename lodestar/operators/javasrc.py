"""Java source to tables of methods and types.

A reader of declarations stands in for a full compiler's parser: it follows Java's grammar through packages, types, their
members and parameters, and through code as far as types can stand in it (local and anonymous classes, lambdas, array
initialisers); expressions are only balanced. Any parser with the same interface can take its place.
"""

from __future__ import annotations

import re
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

METHOD = "seq int, name string, class string, return_type string, parameters array<struct<type: string, name: string>>, body_raw string, start int, end int, kind string"
_TOKEN = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?\*/)|(?P<literal>\"\"\"(?:\\.|[^\\])*?\"\"\"|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|[^\W\d]|\$", re.S
)
_WORD = re.compile(r"[\w$]+")
# Words of the language.
_MODIFIERS = {"public", "protected", "private", "static", "final", "abstract", "native", "synchronized", "default", "strictfp", "transient", "volatile"}
_TYPES = {"class", "interface", "enum", "record"}


class Parser(Protocol):
    def __call__(self, source: str) -> list[dict]: ...


def tokens(source: str) -> list[tuple[str, int]]:
    """Words, symbols and '"' for literals, with their places; no comments and blanks. Three dots are one symbol."""
    out, at = [], 0
    while at < len(source):
        m = _TOKEN.match(source, at)
        if m and m["skip"] is not None:
            at = m.end()
        elif m and m["literal"] is not None:
            out.append(('"', at))
            at = m.end()
        else:
            word = _WORD.match(source, at)
            text = word[0] if word else "..." if source.startswith("...", at) else source[at]
            out.append((text, at))
            at += len(text)
    return out


def body_from(source: str, line_start: int) -> str:
    """From the start of the line to the brace that closes the first one after it, counting braces blindly, stripped."""
    first = source.find("{", line_start)
    if first < 0:
        return ""
    depth, end = 0, first
    for m in re.compile(r"[{}]").finditer(source, first):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            end = m.end()
            break
    return source[line_start:end].strip()


class Declarations:
    """Methods and constructors of one source, found by descent. What is not Java raises ValueError."""

    def __init__(self, source: str):
        self.source, self.tokens, self.i = source, tokens(source), 0
        self.types: list[tuple[str, str]] = []  # kind and name of the types around, anonymous ones left out
        self.found: list[dict] = []

    def look(self, ahead: int = 0) -> str:
        """The token there; '' behind the last."""
        return self.tokens[self.i + ahead][0] if self.i + ahead < len(self.tokens) else ""

    def take(self, *wanted: str) -> str:
        t = self.look()
        if not t or wanted and t not in wanted:
            raise ValueError(f"{wanted} expected, {t!r} found")
        self.i += 1
        return t

    def word(self) -> str:
        if not _WORD.fullmatch(self.look()):
            raise ValueError(f"a name expected, {self.look()!r} found")
        return self.take()

    def unit(self) -> list[dict]:
        while self.look():
            self.modifiers()
            if self.at_type():
                self.type()
            elif self.look() in ("{", "}"):
                raise ValueError("a brace outside of types")
            else:
                self.take()  # package and import lines
        return self.found

    def at_type(self) -> bool:
        """Does a type's declaration begin here? record is a word like others elsewhere."""
        t = self.look()
        return t == "@" and self.look(1) == "interface" or t in _TYPES and bool(_WORD.fullmatch(self.look(1))) and (t != "record" or self.look(2) in ("(", "<"))

    def modifiers(self) -> None:
        while True:
            if self.look() == "@" and self.look(1) != "interface":
                self.take()
                self.word()
                while self.look() == ".":
                    self.take()
                    self.word()
                if self.look() == "(":
                    self.code("(", ")")
            elif self.look() == "non" and self.look(1) == "-":
                self.i += 3
            elif self.look() in _MODIFIERS or self.look() == "sealed" and self.look(1) in _MODIFIERS | _TYPES:
                self.take()
            else:
                return

    def type(self) -> None:
        if self.look() == "@":
            self.take()
            kind = "annotation"
            self.take()
        else:
            kind = self.take()
        name = self.word()
        while self.look() != "{":  # parameters, bounds, a record's head, what is extended
            if self.look() == "(":
                self.code("(", ")")
            else:
                self.take()
        self.types.append((kind, name))
        self.body(kind, name)
        self.types.pop()

    def body(self, kind: str, name: str) -> None:
        self.take("{")
        if kind == "enum":
            while self.look() not in (";", "}"):
                self.modifiers()
                self.word()
                if self.look() == "(":
                    self.code("(", ")")
                if self.look() == "{":
                    self.body("", "")
                if self.look() == ",":
                    self.take()
        while True:
            self.modifiers()
            t = self.look()
            if t == "}":
                self.take()
                return
            if t == ";":
                self.take()
            elif t == "{":
                self.code("{", "}")
            elif self.at_type():
                self.type()
            else:
                self.member(kind, name)

    def member(self, kind: str, name: str) -> None:
        start = self.tokens[self.i][1] if self.look() else 0
        if self.look() == "<":
            self.generics()
            self.modifiers()
        if self.look() == name and self.look(1) in ("(", "{") and kind in ("class", "enum", "record"):
            self.take()
            if self.look() == "(":
                owner = name if kind == "class" else next((n for k, n in reversed(self.types) if k == "class"), "Unknown")
                self.add(start, "constructor", name, owner, owner, self.parameters())
            self.rest()
            return
        returned = self.type_name()
        called = self.word()
        if self.look() != "(":
            self.code("", ";")  # a field and its value
            return
        owner = next((n for k, n in reversed(self.types) if k != "annotation"), "Unknown")
        at = len(self.found)
        self.add(start, "method", called, owner, returned, self.parameters())
        if kind == "annotation":
            del self.found[at:]
        self.rest()

    def rest(self) -> None:
        """From behind the parameters to a member's end: a body, or a semicolon."""
        while self.look() not in ("{", ";"):
            if self.look() == "default":
                self.code("", ";")
                return
            self.take()
        if self.look() == "{":
            self.code("{", "}")
        else:
            self.take()

    def generics(self) -> None:
        depth = 0
        while True:
            t = self.take()
            depth += (t == "<") - (t == ">")
            if t in (";", "{", "}"):
                raise ValueError("type parameters without an end")
            if not depth:
                return

    def type_name(self) -> str:
        """A type's first name; arguments, further names, dimensions and annotations are passed over."""
        self.modifiers()
        name = self.word()
        while True:
            if self.look() == "<":
                self.generics()
            elif self.look() == ".":
                self.take()
                self.modifiers()
                self.word()
            elif self.look() == "[" or self.look() == "@":
                self.modifiers()
                if self.look() == "[":
                    self.take()
                    self.take("]")
            else:
                return name

    def parameters(self) -> list[dict]:
        out = []
        self.take("(")
        while self.look() != ")":
            self.modifiers()
            kind = self.type_name()
            self.modifiers()
            if self.look() == "...":
                self.take()
            name = self.word()
            while self.look() == "." or self.look() == "[":  # a receiver, or dimensions behind the name
                self.take()
                self.take()
            if name != "this" and self.tokens[self.i - 1][0] != "this":
                out.append({"type": kind or "Object", "name": name})
            if self.look() != ")":
                self.take(",")
        self.take(")")
        return out

    def add(self, start: int, kind: str, name: str, owner: str, returned: str, parameters: list[dict]) -> None:
        line = self.source.rfind("\n", 0, start) + 1
        body = body_from(self.source, line)
        self.found.append({"name": name, "class": owner, "return_type": returned, "parameters": parameters, "body_raw": body, "start": line, "end": line + len(body), "kind": kind})

    def code(self, opening: str, closing: str) -> None:
        """Balanced code from an opening symbol (none: from here) to its closing one, with the types in it."""
        if opening:
            self.take(opening)
        while True:
            t = self.look()
            if t == closing:
                self.take()
                return
            if t == "{":
                self.code("{", "}")
            elif t == "(":
                self.code("(", ")")
            elif t in ("}", ")"):
                raise ValueError(f"{t} without its beginning")
            elif t == "new":
                self.take()
                self.modifiers()
                if _WORD.fullmatch(self.look()) or self.look() == "<":
                    self.created()
            elif self.at_type() and self.tokens[self.i - 1][0] not in (".", "::"):
                self.type()
            else:
                self.take()

    def created(self) -> None:
        """Behind new: a type, then an array, or arguments and the body of an anonymous class."""
        while _WORD.fullmatch(self.look()) or self.look() in (".", "<"):
            if self.look() == "<":
                self.generics()
            else:
                self.take()
                self.modifiers()
        if self.look() == "(":
            self.code("(", ")")
            if self.look() == "{":
                self.body("", "")


def scan(source: str) -> list[dict]:
    """Methods, then constructors, in source order, those of local and anonymous classes among them. A file that cannot be
    parsed gives no rows."""
    try:
        found = Declarations(source.replace("\r\n", "\n")).unit()
    except (ValueError, IndexError, RecursionError):
        return []
    found.sort(key=lambda r: r["kind"] == "constructor")
    return [row | {"seq": i} for i, row in enumerate(found)]


def java_methods(files: DataFrame, parser: Parser = scan, slice_mode: str = "fixed") -> DataFrame:
    """content and metadata, with project, relative_path and seq, of every method and constructor in files (project,
    relative_path, source). slice_mode 'fixed' takes the method's text from its line to its last brace; 'legacy' loses as
    many characters at the end as the line is indented by. Positions are character offsets."""
    ship(files.sparkSession)

    @F.pandas_udf(f"array<struct<{', '.join(re.sub(r'^(\w+) ', r'\1: ', x) for x in re.split(r', (?![^<]*>)', METHOD))}>>")
    def parse(s: pd.Series) -> pd.Series:
        def one(x: str | None) -> list[dict]:
            try:
                return parser(x) if x is not None else []
            except (ValueError, RecursionError, IndexError):
                return []

        return s.map(one)

    src = F.replace("source", F.lit("\r\n"), F.lit("\n"))
    d = files.select("project", "relative_path", src.alias("source")).withColumn("m", F.explode(parse("source")))
    size = F.col("m.end") - F.col("m.start")
    if slice_mode == "fixed":
        line = F.expr("substring(source, m.start + 1, length(source))")
        size = size + F.length(line) - F.length(F.ltrim(line))
    cut = F.substring(F.col("source"), F.col("m.start") + 1, size)
    content = F.when(F.length(F.trim(cut)) > 0, cut).otherwise(F.col("m.body_raw"))
    meta = F.struct(
        F.split("relative_path", "/").alias("fpath_tuple"), F.col("m.name").alias("name"), F.col("m.class").alias("class"), F.col("m.start").alias("start_line_no"),
        F.col("m.end").alias("end_line_no"), F.col("m.return_type").alias("return_type"), F.col("m.parameters").alias("parameters"), F.col("m.body_raw").alias("body_raw"),
    )
    return d.select("project", "relative_path", F.col("m.seq").alias("seq"), content.alias("content"), meta.alias("metadata"))


def java_types(methods: DataFrame) -> DataFrame:
    """class, relative_path, methods (names in order, overloads kept) and first_seq, the order types were met in."""
    named = F.sort_array(F.collect_list(F.struct("seq", F.col("metadata.name").alias("name"))))
    d = methods.groupBy("project", F.col("metadata.class").alias("class"), "relative_path").agg(named.alias("n"), F.min("seq").alias("first_seq"))
    return d.select("project", "class", "relative_path", F.transform("n", lambda x: x["name"]).alias("methods"), "first_seq")

