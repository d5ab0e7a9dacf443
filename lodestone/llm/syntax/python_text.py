"""Python 3."""

from __future__ import annotations

import re

from lodestone.llm.syntax.base import Fault, Parser, Token, checked, missed

NUMBER = re.compile(
    r"(?:0[xX](?:_?[\da-fA-F])+|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*|\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?[jJ]?)"
)
WORD = re.compile(r"[^\W\d]\w*")
PREFIX = re.compile(r"(?i)(?:rb|br|fr|rf|tr|rt|[rbuft])?(\"\"\"|'''|\"|')")
OP = re.compile(r"\*\*=|//=|>>=|<<=|\.\.\.|->|:=|\*\*|//|<<|>>|<=|>=|==|!=|[-+*/%@&|^]=|[-+*/%@&|^~<>()\[\]{},:.;=!]")
SPACE = re.compile(r"[ \t\f]+|\\\r?\n|\\\r")
LINE = re.compile(r"\r\n|\n|\r")
#: Keywords of Python (fixed values).
KEYWORDS = frozenset(
    "False None True and as assert async await break class continue def del elif else except finally for from global if import in is lambda "
    "nonlocal not or pass raise return try while with yield".split()
)
AUGMENTED = frozenset("+= -= *= /= //= %= @= &= |= ^= >>= <<= **=".split())
COMPARE = frozenset("< > == >= <= !=".split())
BINARY = {"|": 1, "^": 2, "&": 3, "<<": 4, ">>": 4, "+": 5, "-": 5, "*": 6, "/": 6, "//": 6, "%": 6, "@": 6}
CLOSE = {"(": ")", "[": "]", "{": "}"}


def string(text: str, at: int, line: int) -> tuple[int, str, list | None, int] | None:
    """A string literal at ``at``: its end, kind, parts of a formatted one, and lines in it."""
    m = PREFIX.match(text, at)
    if not m:
        return None
    prefix, quote = m.group()[: -len(m.group(1))].lower(), m.group(1)
    raw, formatted, parts = "r" in prefix, "f" in prefix or "t" in prefix, []
    i, n, begin = m.end(), len(text), line
    while True:
        if i >= n:
            raise Fault("string without an end", line)
        c = text[i]
        if c == "\\" and not (formatted and raw and text[i + 1 : i + 2] in "{}"):
            if not raw and formatted and text.startswith("\\N{", i):
                i = text.find("}", i) + 1 or n
                continue
            if text.startswith("\\\r\n", i):
                i += 3
                begin += 1
                continue
            begin += text[i + 1 : i + 2] in ("\n", "\r")
            i += 2
        elif text.startswith(quote, i):
            i += len(quote)
            break
        elif c in "\r\n":
            if len(quote) == 1:
                raise Fault("string without an end", line)
            i += 2 if text.startswith("\r\n", i) else 1
            begin += 1
        elif formatted and c == "{":
            if text.startswith("{{", i):
                i += 2
                continue
            i = field(text, i + 1, begin, quote, parts)
        elif formatted and c == "}":
            if not text.startswith("}}", i):
                raise Fault("a single '}' in a formatted string", begin)
            i += 2
        else:
            i += 1
    return i, ("bytes" if "b" in prefix else "str"), (parts if formatted else None), begin - line


def field(text: str, i: int, line: int, quote: str, parts: list) -> int:
    """The place behind a replacement field whose brace has been read."""
    begin, stack, n = i, [], len(text)
    while i < n:
        c = text[i]
        if c in "'\"" or (c.isalpha() and PREFIX.match(text, i) and not text[i - 1 : i].isidentifier()):
            if not stack and len(quote) == 3 and text.startswith(quote, i):
                raise Fault("expected '}' in a formatted string", line)
            inner = string(text, i, line)
            i = inner[0]
            continue
        if c == "#":
            while i < n and text[i] not in "\r\n":
                i += 1
            continue
        if c in "([{":
            stack.append(c)
        elif c in ")]}":
            if not stack:
                if c != "}":
                    raise Fault(f"unexpected '{c}' in a formatted string", line)
                break
            if CLOSE[stack.pop()] != c:
                raise Fault("brackets that don't match in a formatted string", line)
        elif not stack and c == "!" and text[i + 1 : i + 2] != "=":
            break
        elif not stack and c == ":":
            break
        elif c in "\r\n" and len(quote) == 1 and not stack and False:
            break
        i += 1
    if i >= n:
        raise Fault("formatted string without an end", line)
    source = text[begin:i]
    bare = source.rstrip()
    if bare.endswith("=") and not bare.endswith(("==", "!=", "<=", ">=")):
        bare = bare[:-1]
    if not bare.strip():
        raise Fault("an empty expression in a formatted string", line)
    parts.append((bare, line))
    if text[i] == "!":
        i += 1
        m = WORD.match(text, i)
        if not m or m.group() not in ("s", "r", "a"):
            raise Fault("unknown conversion in a formatted string", line)
        i = m.end()
    if text[i : i + 1] == ":":
        i += 1
        while i < n and text[i] != "}":
            if text[i] == "{":
                i = field(text, i + 1, line, quote, parts)
            elif text[i] in "\r\n" and len(quote) == 1 or text.startswith(quote, i):
                raise Fault("expected '}' in a formatted string", line)
            else:
                i += 1
    if text[i : i + 1] != "}":
        raise Fault("expected '}' in a formatted string", line)
    return i + 1


def lex(text: str, line: int = 1, inner: bool = False, errors: list | None = None) -> list[Token]:
    """Tokens with nl, indent and dedent. ``inner``: an expression, in which lines don't count. A lexical error is a Fault, or is added to ``errors``."""
    text = text.removeprefix("﻿")
    out: list[Token] = []
    brackets: list[tuple[str, int]] = []
    indents = [(0, 0)]
    at, n = 0, len(text)
    fresh = not inner
    while at < n:
        try:
            if fresh:
                begin, col, alt = at, 0, 0
                while at < n and text[at] in " \t\f":
                    c = text[at]
                    col = col + 1 if c == " " else (col // 8 + 1) * 8 if c == "\t" else 0
                    alt = alt + 1 if c != "\f" else 0
                    at += 1
                if at >= n:
                    break
                if text[at] == "#":
                    while at < n and text[at] not in "\r\n":
                        at += 1
                if m := LINE.match(text, at):
                    at, line = m.end(), line + 1
                    continue
                if at >= n:
                    break
                if text[at] == "\\" and LINE.match(text, at + 1):
                    at, line = LINE.match(text, at + 1).end(), line + 1
                    continue
                if col > indents[-1][0]:
                    if alt <= indents[-1][1]:
                        raise Fault("tabs and blanks mixed in an indentation", line)
                    indents.append((col, alt))
                    out.append(Token("indent", "", line, begin))
                else:
                    while col < indents[-1][0]:
                        indents.pop()
                        out.append(Token("dedent", "", line, begin))
                    if col != indents[-1][0]:
                        raise Fault("indentation that matches no outer level", line)
                    if alt != indents[-1][1]:
                        raise Fault("tabs and blanks mixed in an indentation", line)
                fresh = False
            c = text[at]
            if m := SPACE.match(text, at):
                if m.group()[0] == "\\":
                    line += 1
                    if m.end() >= n:
                        raise Fault("the text ends in a continued line", line)
                at = m.end()
                continue
            if c == "#":
                while at < n and text[at] not in "\r\n":
                    at += 1
                continue
            if m := LINE.match(text, at):
                if not brackets and not inner:
                    out.append(Token("nl", "", line, at))
                    fresh = True
                at, line = m.end(), line + 1
                continue
            if (c in "'\"" or c in "rRbBuUfFtT") and (s := string(text, at, line)):
                end, kind, parts, lines = s
                if kind == "bytes" and not text[at:end].isascii():
                    raise Fault("bytes with other than ASCII characters", line)
                out.append(Token("str", kind, line, at, parts=parts))
                at, line = end, line + lines
                continue
            if c.isdigit() or (c == "." and text[at + 1 : at + 2].isdigit()):
                m = NUMBER.match(text, at)
                x = m.group()
                tail = WORD.match(text, m.end())
                if (tail and tail.group() not in ("and", "or", "if", "else", "in", "is", "for", "not")) or text[m.end() : m.end() + 1].isdigit() or re.fullmatch(r"0[0_]*[1-9][\d_]*", x):
                    raise Fault("malformed number", line)
                out.append(Token("num", x, line, at))
                at = m.end()
                continue
            if m := WORD.match(text, at):
                out.append(Token("id", m.group(), line, at))
                at = m.end()
                continue
            m = OP.match(text, at)
            if not m or m.group() == "!":
                raise Fault(f"unexpected character {c!r}", line)
            x = m.group()
            if x in CLOSE:
                brackets.append((x, line))
                if len(brackets) > 200:  # as CPython
                    raise Fault("too many nested brackets", line)
            elif x in (")", "]", "}"):
                if not brackets:
                    raise Fault(f"unmatched '{x}'", line)
                if CLOSE[brackets[-1][0]] != x:
                    raise Fault(f"'{x}' doesn't close '{brackets[-1][0]}'", line)
                brackets.pop()
            out.append(Token("op", x, line, at))
            at = m.end()
        except Fault as fault:
            if fresh:  # an indentation that fits nowhere: the line is read as if it were at the level left
                fresh = False
            elif brackets and text[at] in ")]}":
                if errors is not None:
                    brackets.pop()
            at = missed(text, at, fault, errors, out, False)
    if brackets:
        missed(text, n, Fault(f"'{brackets[-1][0]}' was never closed", brackets[-1][1]), errors, out, False)
    if not inner:
        if out and out[-1].kind not in ("nl", "indent", "dedent"):
            out.append(Token("nl", "", line, n))
        out += [Token("dedent", "", line, n) for _ in indents[1:]]
    out.append(Token("end", "", line, n))
    return out


#: What an expression may be used as: a name, an attribute, an item, a tuple or list of targets, a starred one.
TARGET = frozenset(("name", "attr", "item", "tuple", "list", "star"))


class Python(Parser):
    def word(self, *texts: str) -> bool:
        return self.tok.kind == "id" and self.tok.text in texts

    def name(self) -> None:
        if self.tok.kind != "id" or self.tok.text in KEYWORDS:
            self.fail("expected a name")
        self.step()

    def fail(self, message: str):
        found = {"nl": "the end of the line", "indent": "an indentation", "dedent": "the end of the block", "end": "the end of the text"}.get(self.tok.kind) or f"'{self.tok.text[:20]}'"
        raise Fault(f"{message}, found {found}", self.tok.line)

    def recover(self, fault: Fault, begin: int) -> None:
        """Record the fault and skip the rest of the line and a block that hangs on it."""
        self.errors.append((fault.line, fault.message))
        if self.i == begin:
            self.step()
        while self.tok.kind not in ("nl", "end", "dedent", "indent"):
            self.step()
        if self.tok.kind == "nl":
            self.step()
        level = 0
        while self.tok.kind == "indent" or level:
            if self.tok.kind == "indent":
                level += 1
            elif self.tok.kind == "dedent":
                level -= 1
            elif self.tok.kind == "end":
                return
            self.step()
            if not level and self.tok.kind != "indent":
                return

    def top(self) -> None:
        if self.tok.kind in ("indent", "dedent"):
            self.fail("unexpected indentation")
        if self.tok.kind == "nl":
            self.step()
            return
        self.statement()

    # --- statements ---
    def block(self) -> None:
        self.need(":")
        if self.tok.kind != "nl":
            return self.simple_line()
        self.step()
        if self.tok.kind != "indent":
            self.fail("expected an indented block")
        self.step()
        while self.tok.kind not in ("dedent", "end"):
            begin, depth = self.i, self.depth
            try:
                if self.tok.kind == "indent":
                    self.fail("unexpected indentation")
                self.statement()
            except Fault as fault:
                self.depth = depth
                self.recover(fault, begin)
        if self.tok.kind == "dedent":
            self.step()
        return None

    def statement(self) -> None:
        self.deeper()
        self._statement()
        self.depth -= 1

    def _statement(self) -> None:
        x = self.tok
        if x.kind == "op" and x.text == "@":
            while self.take("@"):
                self.named()
                self.end_line()
            if self.take("async"):
                return self.function()
            if self.word("def"):
                return self.function()
            if self.word("class"):
                return self.klass()
            self.fail("expected a function or a class behind a decorator")
        if x.kind == "id":
            w = x.text
            if w == "if":
                self.step()
                self.named()
                self.block()
                while self.take("elif"):
                    self.named()
                    self.block()
                if self.take("else"):
                    self.block()
                return None
            if w == "while":
                self.step()
                self.named()
                self.block()
                if self.take("else"):
                    self.block()
                return None
            if w == "for":
                return self.for_()
            if w == "try":
                return self.try_()
            if w == "with":
                return self.with_()
            if w == "def":
                return self.function()
            if w == "class":
                return self.klass()
            if w == "async":
                self.step()
                if self.word("def"):
                    return self.function()
                if self.word("for"):
                    return self.for_()
                if self.word("with"):
                    return self.with_()
                self.fail("expected def, for or with")
            if w == "match" and self.guess(self.match_head):
                return self.match_body()
        return self.simple_line()

    def end_line(self) -> None:
        if self.tok.kind == "nl":
            self.step()
        elif self.tok.kind != "end":
            self.fail("invalid syntax")

    def simple_line(self) -> None:
        self.simple()
        while self.take(";"):
            if self.tok.kind in ("nl", "end"):
                break
            self.simple()
        self.end_line()

    def simple(self) -> None:
        x = self.tok
        if x.kind == "id":
            w = x.text
            if w in ("pass", "break", "continue"):
                self.step()
                return None
            if w == "return":
                self.step()
                if self.tok.kind not in ("nl", "end") and not self.on(";"):
                    self.stars()
                return None
            if w == "raise":
                self.step()
                if self.tok.kind not in ("nl", "end") and not self.on(";"):
                    self.test()
                    if self.take("from"):
                        self.test()
                return None
            if w in ("global", "nonlocal"):
                self.step()
                self.name()
                while self.take(","):
                    self.name()
                return None
            if w == "del":
                self.step()
                line = self.tok.line
                while True:
                    if self.comparison() not in ("name", "attr", "item", "tuple", "list"):
                        raise Fault("can't be deleted", line)
                    if not self.take(",") or self.tok.kind in ("nl", "end") or self.on(";"):
                        return None
            if w == "assert":
                self.step()
                self.test()
                if self.take(","):
                    self.test()
                return None
            if w == "import":
                self.step()
                while True:
                    self.dotted()
                    if self.take("as"):
                        self.name()
                    if not self.take(","):
                        return None
            if w == "from":
                return self.from_()
            if w == "type" and self.ahead().kind == "id" and self.ahead().text not in KEYWORDS and self.ahead(2).text in ("=", "["):
                self.step()
                self.name()
                self.type_parameters()
                self.need("=")
                self.test()
                return None
        return self.expression_statement()

    def dotted(self) -> None:
        self.name()
        while self.take("."):
            self.name()

    def from_(self) -> None:
        self.need("from")
        dots = False
        while self.on(".", "..."):
            self.step()
            dots = True
        if not (dots and self.word("import")):
            self.dotted()
        self.need("import")
        if self.take("*"):
            return
        closed = self.take("(")
        while True:
            self.name()
            if self.take("as"):
                self.name()
            if not self.take(","):
                break
            if closed and self.on(")"):
                break
        if closed:
            self.need(")")

    def expression_statement(self) -> None:
        line = self.tok.line
        kind = self.value()
        if self.take(":"):
            if kind not in ("name", "attr", "item", "paren-name"):
                raise Fault("can't be annotated", line)
            self.test()
            if self.take("="):
                self.value()
            return
        if self.tok.kind == "op" and self.tok.text in AUGMENTED:
            if kind not in ("name", "attr", "item"):
                raise Fault("can't be assigned to", line)
            self.step()
            self.value()
            return
        while self.on("="):
            if kind not in ("name", "attr", "item", "tuple", "list", "paren-name"):
                raise Fault("can't be assigned to", line)
            self.step()
            line = self.tok.line
            kind = self.value()
        if kind == "star":
            raise Fault("a starred expression alone", line)

    def value(self) -> str:
        return self.yield_() if self.word("yield") else self.stars()

    def yield_(self) -> str:
        self.need("yield")
        if self.take("from"):
            self.test()
        elif not (self.tok.kind in ("nl", "end") or self.on(")", "]", "}", "=", ";", ":")):
            self.stars()
        return "yield"

    def for_(self) -> None:
        self.need("for")
        self.targets()
        self.need("in")
        self.stars()
        self.block()
        if self.take("else"):
            self.block()

    def targets(self) -> None:
        """Targets of a loop or a comprehension, up to ``in``."""
        while True:
            line = self.tok.line
            self.take("*")
            kind = self.binary(1)
            if kind not in ("name", "attr", "item", "tuple", "list", "paren-name"):
                raise Fault("can't be assigned to", line)
            if not self.take(",") or self.word("in"):
                return

    def try_(self) -> None:
        self.need("try")
        self.block()
        handled = bare = False
        while self.word("except"):
            if bare:
                self.fail("an except behind a bare one")
            self.step()
            handled = True
            self.take("*")
            if self.on(":"):
                bare = True
            else:
                self.test()
                if self.on(","):
                    while self.take(","):
                        self.test()
                if self.take("as"):
                    self.name()
            self.block()
        if handled and self.take("else"):
            self.block()
        if self.take("finally"):
            self.block()
        elif not handled:
            self.fail("expected except or finally")

    def with_(self) -> None:
        self.need("with")

        def closed():
            self.need("(")
            while not self.on(")"):
                self.item()
                if not self.take(","):
                    break
            self.need(")")
            if not self.on(":"):
                self.fail("expected ':'")

        if not (self.on("(") and self.guess(closed)):
            self.item()
            while self.take(","):
                self.item()
        self.block()

    def item(self) -> None:
        self.test()
        if self.take("as"):
            line = self.tok.line
            self.take("*")
            if self.atom_with_trailers() not in ("name", "attr", "item", "tuple", "list", "paren-name"):
                raise Fault("can't be assigned to", line)

    def type_parameters(self) -> None:
        if not self.take("["):
            return
        while not self.on("]"):
            if self.on("*", "**"):
                self.step()
            self.name()
            if self.take(":"):
                self.test()
            if self.take("="):
                self.take("*")
                self.test()
            if not self.take(","):
                break
        self.need("]")

    def function(self) -> None:
        self.need("def")
        self.name()
        self.type_parameters()
        self.need("(")
        self.parameters(")", True)
        self.need(")")
        if self.take("->"):
            self.stars()
        self.block()

    def parameters(self, end: str, annotated: bool) -> None:
        default = star = slash = False
        while not self.on(end):
            if self.take("**"):
                self.name()
                if annotated and self.take(":"):
                    self.test()
                self.take(",")
                if not self.on(end):
                    self.fail("a parameter behind **")
                return
            if self.take("*"):
                if star:
                    self.fail("a second *")
                star = True
                if self.on(","):
                    if self.ahead().text in (end, "**"):
                        self.fail("names must follow a bare *")
                else:
                    self.name()
                    if annotated and self.take(":"):
                        self.take("*")
                        self.test()
            elif self.take("/"):
                if slash or star:
                    self.fail("misplaced /")
                slash = True
            else:
                self.name()
                if annotated and self.take(":"):
                    self.test()
                if self.take("="):
                    default = True
                    self.test()
                elif default and not star:
                    self.fail("a parameter without a default behind one with it")
            if not self.take(","):
                return

    def klass(self) -> None:
        self.need("class")
        self.name()
        self.type_parameters()
        if self.take("("):
            self.arguments()
        self.block()

    # --- match ---
    def match_head(self) -> None:
        self.need("match")
        if self.tok.kind == "nl" or self.on("=", ".", ")"):
            self.fail("not a match")
        self.stars()
        self.need(":")
        if self.tok.kind != "nl" or self.ahead().kind != "indent" or self.ahead(2).text != "case":
            self.fail("expected a block of cases")
        self.step()

    def match_body(self) -> None:
        self.step()
        while self.tok.kind not in ("dedent", "end"):
            self.need("case")
            self.patterns()
            if self.take("if"):
                self.named()
            self.block()
        if self.tok.kind == "dedent":
            self.step()

    def patterns(self) -> None:
        self.pattern()
        while self.take(","):
            if self.on(":") or self.word("if"):
                break
            self.pattern()

    def pattern(self) -> None:
        self.deeper()
        if self.take("*"):
            self.name()
        else:
            self.closed_pattern()
            while self.take("|"):
                self.closed_pattern()
            if self.take("as"):
                self.name()
        self.depth -= 1

    def closed_pattern(self) -> None:
        x = self.tok
        if x.kind == "num" or (x.kind == "op" and x.text == "-"):
            self.take("-")
            self.step()
            if self.on("+", "-"):
                self.step()
                self.step()
        elif x.kind == "str":
            self.strings()
        elif x.kind == "op" and x.text in ("(", "["):
            end = CLOSE[self.step().text]
            while not self.on(end):
                self.pattern()
                if not self.take(","):
                    break
            self.need(end)
        elif x.kind == "op" and x.text == "{":
            self.step()
            while not self.on("}"):
                if self.take("**"):
                    self.name()
                else:
                    self.closed_pattern()
                    self.need(":")
                    self.pattern()
                if not self.take(","):
                    break
            self.need("}")
        elif x.kind == "id" and x.text in ("None", "True", "False"):
            self.step()
        else:
            self.dotted()
            if self.take("("):
                while not self.on(")"):
                    if self.tok.kind == "id" and self.ahead().text == "=":
                        self.name()
                        self.step()
                    self.pattern()
                    if not self.take(","):
                        break
                self.need(")")

    # --- expressions: each gives its kind ---
    def stars(self) -> str:
        kind = self.star_or_named()
        if not self.on(","):
            return kind
        good = kind in TARGET
        while self.take(","):
            if self.tok.kind in ("nl", "end") or self.on(")", "]", "}", "=", ":", ";") or self.tok.text in AUGMENTED:
                break
            good = (self.star_or_named() in TARGET) and good
        return "tuple" if good else "value"

    def star_or_named(self) -> str:
        if self.take("*"):
            return "star" if self.binary(1) in TARGET else "stars"
        return self.named()

    def named(self) -> str:
        kind = self.test()
        if self.on(":="):
            if kind != "name":
                self.fail("only a name can be assigned with :=")
            self.step()
            self.test()
            return "value"
        return kind

    def test(self) -> str:
        self.deeper()
        kind = self._test()
        self.depth -= 1
        return kind

    def _test(self) -> str:
        if self.word("lambda"):
            self.step()
            self.parameters(":", False)
            self.need(":")
            self.test()
            return "value"
        kind = self.disjunction()
        if self.word("if"):
            self.step()
            self.disjunction()
            self.need("else")
            self.test()
            return "value"
        return kind

    def disjunction(self) -> str:
        kind = self.conjunction()
        while self.take("or"):
            self.conjunction()
            kind = "value"
        return kind

    def conjunction(self) -> str:
        kind = self.inversion()
        while self.take("and"):
            self.inversion()
            kind = "value"
        return kind

    def inversion(self) -> str:
        if self.take("not"):
            self.deeper()
            self.inversion()
            self.depth -= 1
            return "value"
        return self.comparison()

    def comparison(self) -> str:
        kind = self.binary(1)
        while True:
            x = self.tok
            if x.kind == "op" and x.text in COMPARE:
                self.step()
            elif x.kind == "id" and x.text == "in":
                self.step()
            elif x.kind == "id" and x.text == "is":
                self.step()
                self.take("not")
            elif x.kind == "id" and x.text == "not" and self.ahead().text == "in":
                self.step()
                self.step()
            else:
                return kind
            self.binary(1)
            kind = "value"

    def binary(self, least: int) -> str:
        """Precedence climbing."""
        kind = self.factor()
        while self.tok.kind == "op" and (strength := BINARY.get(self.tok.text, 0)) >= least:
            self.step()
            self.deeper()
            self.binary(strength + 1)
            self.depth -= 1
            kind = "value"
        return kind

    def factor(self) -> str:
        if self.on("+", "-", "~") and self.tok.kind == "op":
            self.step()
            self.deeper()
            self.factor()
            self.depth -= 1
            return "value"
        awaited = self.take("await")
        kind = self.atom_with_trailers()
        if self.take("**"):
            self.deeper()
            self.factor()
            self.depth -= 1
            return "value"
        return "value" if awaited else kind

    def atom_with_trailers(self) -> str:
        kind = self.atom()
        while True:
            if self.tok.kind != "op":
                return kind
            if self.take("."):
                self.name()
                kind = "attr"
            elif self.take("("):
                self.arguments()
                kind = "call"
            elif self.take("["):
                self.slices()
                self.need("]")
                kind = "item"
            else:
                return kind

    def slices(self) -> None:
        if self.on("]"):
            self.fail("expected an index")
        while not self.on("]"):
            if self.take("*"):
                self.binary(1)
            else:
                if not self.on(":"):
                    self.named()
                while self.take(":"):
                    if not self.on(":", "]", ","):
                        self.test()
            if not self.take(","):
                break

    def arguments(self) -> None:
        """Arguments of a call whose parenthesis has been read."""
        named = double = False
        while not self.on(")"):
            if self.take("**"):
                self.test()
                double = True
            elif self.take("*"):
                if double:
                    self.fail("* behind **")
                self.test()
            elif self.tok.kind == "id" and self.ahead().text == "=" and self.ahead().kind == "op":
                self.name()
                self.step()
                self.test()
                named = True
            else:
                first = self.tok
                self.named()
                if self.on("="):
                    self.fail("only a name can be given a value in a call")
                if self.word("for", "async"):
                    self.comprehension()
                elif named or double:
                    raise Fault("a positional argument behind a named one", first.line)
            if not self.take(","):
                break
        self.need(")")

    def comprehension(self) -> None:
        while True:
            self.take("async")
            self.need("for")
            self.targets()
            self.need("in")
            self.disjunction()
            while self.take("if"):
                self.disjunction()
                if self.take(":="):
                    self.test()
            if not self.word("for", "async"):
                return

    def strings(self) -> None:
        kinds = set()
        while self.tok.kind == "str":
            x = self.step()
            kinds.add(x.text)
            for part, line in x.parts or ():
                inner = Python(lex(part, line, inner=True))
                inner.depth = self.depth + 1
                if inner.word("yield"):
                    inner.yield_()
                else:
                    inner.stars()
                if inner.tok.kind != "end":
                    inner.fail("expected the end of the expression")
        if len(kinds) > 1:
            self.fail("text and bytes side by side")

    def atom(self) -> str:
        x = self.tok
        if x.kind == "str":
            self.strings()
            return "value"
        if x.kind == "num":
            self.step()
            return "value"
        if x.kind == "id":
            if x.text in ("None", "True", "False"):
                self.step()
                return "value"
            if x.text == "yield":
                self.fail("yield inside an expression")
            self.name()
            return "name"
        if x.kind == "op":
            if x.text == "...":
                self.step()
                return "value"
            if x.text == "(":
                return self.group()
            if x.text == "[":
                self.step()
                self.deeper()
                good, n = True, 0
                while not self.on("]"):
                    good = (self.star_or_named() in TARGET) and good
                    n += 1
                    if n == 1 and self.word("for", "async"):
                        self.comprehension()
                        good = False
                        break
                    if not self.take(","):
                        break
                self.depth -= 1
                self.need("]")
                return "list" if good else "value"
            if x.text == "{":
                return self.braces()
        return self.fail("invalid syntax")

    def group(self) -> str:
        self.need("(")
        if self.take(")"):
            return "tuple"
        self.deeper()
        if self.word("yield"):
            self.yield_()
            kind, comma = "value", False
        else:
            kind, comma = self.star_or_named(), False
            if self.word("for", "async"):
                self.comprehension()
                kind = "value"
            else:
                good = kind in TARGET
                while self.take(","):
                    comma = True
                    if self.on(")"):
                        break
                    good = (self.star_or_named() in TARGET) and good
                if comma:
                    kind = "tuple" if good else "value"
                elif kind in ("star", "stars"):
                    self.fail("a starred expression alone")
        self.depth -= 1
        self.need(")")
        return kind

    def braces(self) -> str:
        self.need("{")
        self.deeper()
        mapping: bool | None = None
        n = 0
        while not self.on("}"):
            if self.take("**"):
                this = True
                self.binary(1)
            elif self.take("*"):
                this = False
                self.binary(1)
            else:
                self.named()
                this = self.take(":")
                if this:
                    self.test()
            if mapping is not None and this != mapping:
                self.fail("entries of a dict and of a set mixed")
            mapping = this
            n += 1
            if n == 1 and self.word("for", "async"):
                self.comprehension()
                break
            if not self.take(","):
                break
        self.depth -= 1
        self.need("}")
        return "value"


def check(text: str, errors: list) -> list[tuple[int, str]]:
    if "\x00" in text:
        errors.append((text.count("\n", 0, text.index("\x00")) + 1, "a null character"))
        text = text.replace("\x00", " ")
    return checked(text, lex, lambda tokens: Python(tokens), errors)
