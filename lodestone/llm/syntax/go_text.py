"""Go."""

from __future__ import annotations

import re

from lodestone.llm.syntax.base import Fault, Parser, Token, checked, missed

TOKEN = re.compile(
    r"""(?P<ws>[ \t\r]+)|(?P<nl>\n)|(?P<lc>//[^\n]*)|(?P<bc>/\*(?:[^*]|\*(?!/))*\*/)"""
    r"""|(?P<num>(?:0[xX](?:_?[\da-fA-F])*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?\d[\d_]*)?|0[bB](?:_?[01])+|0[oO](?:_?[0-7])+|(?:\d(?:_?\d)*\.?(?:\d(?:_?\d)*)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)i?)"""
    r"""|(?P<id>[^\W\d]\w*)|(?P<str>"(?:[^"\\\n]|\\(?:[abfnrtv\\"]|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))*"|`[^`]*`)"""
    r"""|(?P<chr>'(?:[^'\\\n]|\\(?:[abfnrtv\\']|[0-7]{3}|x[\da-fA-F]{2}|u[\da-fA-F]{4}|U[\da-fA-F]{8}))')"""
    r"""|(?P<op>\.\.\.|<<=|>>=|&\^=|<-|\+\+|--|&&|\|\||==|!=|<=|>=|:=|<<|>>|&\^|[-+*/%&|^]=|[-+*/%&|^<>=!()\[\]{},;.:~])"""
)
#: Keywords of Go (fixed values).
KEYWORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
ENDS = frozenset("break continue fallthrough return".split())
BINARY = {"||": 1, "&&": 2, "==": 3, "!=": 3, "<": 3, "<=": 3, ">": 3, ">=": 3, "+": 4, "-": 4, "|": 4, "^": 4, "*": 5, "/": 5, "%": 5, "<<": 5, ">>": 5, "&": 5, "&^": 5}
ASSIGN = frozenset("= := += -= *= /= %= &= |= ^= <<= >>= &^=".split())


def lex(text: str, errors: list | None = None) -> list[Token]:
    """Tokens with the semicolons that line ends stand for (text "\\n"); a lexical error is a Fault, or is added to ``errors``."""
    text = text.removeprefix("﻿")
    out: list[Token] = []
    at, line, n = 0, 1, len(text)

    def line_end() -> None:
        if out:
            p = out[-1]
            if (p.kind == "id" and (p.text not in KEYWORDS or p.text in ENDS)) or p.kind in ("num", "str", "chr") or (p.kind == "op" and p.text in ("++", "--", ")", "]", "}")):
                out.append(Token("op", ";", line, at, True))

    while at < n:
        try:
            m = TOKEN.match(text, at)
            if not m:
                raise Fault(f"unexpected {text[at : at + 10]!r}", line)
            kind, x = m.lastgroup, m.group()
            if kind == "nl":
                line_end()
                line += 1
            elif kind == "bc":
                if "\n" in x:
                    line_end()
                line += x.count("\n")
            elif kind not in ("ws", "lc"):
                if kind == "num" and TOKEN.match(text, m.end()) and TOKEN.match(text, m.end()).lastgroup in ("id", "num"):
                    raise Fault("malformed number", line)
                out.append(Token(kind, x, line, at, not out or out[-1].line < line))
                line += x.count("\n") if kind == "str" else 0
            at = m.end()
        except Fault as fault:
            at = missed(text, at, fault, errors, out, not out or out[-1].line < line)
    line_end()
    out.append(Token("end", "", line, n, True))
    return out


class Go(Parser):
    STARTS = frozenset("func type var const import if for switch select return go defer".split())

    def __init__(self, tokens: list[Token]):
        super().__init__(tokens)
        self.header = False  # in the header of a control clause, where a brace opens the block
        self.begun = False
        self.imports = True

    def word(self, *texts: str) -> bool:
        return self.tok.kind == "id" and self.tok.text in texts

    def name(self) -> None:
        if self.tok.kind != "id" or self.tok.text in KEYWORDS:
            self.fail("expected a name")
        self.step()

    def end_of_statement(self) -> None:
        if self.take(";") or self.on(")", "}"):
            return
        if self.tok.kind != "end":
            self.fail("expected the end of the statement")

    def run(self):
        if self.tok.kind == "end":
            self.errors.append((1, "expected 'package', found the end of the text"))
        return super().run()

    def top(self) -> None:
        if not self.begun:
            self.begun = True
            self.need("package")
            self.name()
            return self.end_of_statement()
        if self.take(";"):
            return None
        if self.on("}"):
            self.fail("unexpected '}'")
        if self.word("import"):
            if not self.imports:
                self.fail("import behind a declaration")
            self.step()
            self.group(self.import_spec)
            return self.end_of_statement()
        self.imports = False
        if self.word("func"):
            self.function()
        elif self.word("var", "const", "type"):
            self.declaration()
        else:
            self.fail("expected a declaration")
        return self.end_of_statement()

    def group(self, spec) -> None:
        if self.take("("):
            while not self.on(")"):
                spec()
                if not self.take(";") and not self.on(")"):
                    self.fail("expected ';' or ')'")
            self.need(")")
        else:
            spec()

    def import_spec(self) -> None:
        if not self.take("."):
            if self.tok.kind == "id":
                self.name()
        if self.tok.kind != "str":
            self.fail("expected the path of a package")
        self.step()

    def declaration(self) -> None:
        w = self.step().text
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[w])

    def names(self) -> None:
        self.name()
        while self.take(","):
            self.name()

    def var_spec(self) -> None:
        self.names()
        if self.take("="):
            return self.expressions()
        self.type()
        if self.take("="):
            self.expressions()
        return None

    def const_spec(self) -> None:
        self.names()
        if not self.on("=", ";", ")"):
            self.type()
        if self.take("="):
            self.expressions()

    def type_spec(self) -> None:
        self.name()
        if self.on("["):
            self.guess(self.type_parameters)
        self.take("=")
        self.type()

    def type_parameters(self) -> None:
        self.need("[")
        if self.on("]"):
            self.fail("expected a type parameter")
        while not self.on("]"):
            self.names()
            self.constraint()
            if not self.take(","):
                break
        self.need("]")

    def constraint(self) -> None:
        while True:
            self.take("~")
            self.type()
            if not self.take("|"):
                return

    def function(self) -> None:
        self.need("func")
        if self.on("("):
            self.parameters()
        self.name()
        if self.on("["):
            self.type_parameters()
        self.signature()
        if self.on("{"):
            self.body()

    def signature(self) -> None:
        self.parameters()
        if self.on("("):
            self.parameters()
        elif self.type_ahead():
            self.type()

    def type_ahead(self) -> bool:
        if self.tok.kind == "id":
            return self.tok.text not in KEYWORDS or self.tok.text in ("func", "map", "chan", "struct", "interface")
        return self.on("*", "[", "(", "<-")

    def parameters(self) -> None:
        self.need("(")
        while not self.on(")"):
            if self.take("..."):
                self.type()
            else:
                self.type()
                if not self.on(",", ")"):
                    self.take("...")
                    self.type()
            if not self.take(","):
                break
        self.need(")")

    def type(self) -> None:
        self.deeper()
        self._type()
        self.depth -= 1

    def _type(self) -> None:
        if self.take("*"):
            return self.type()
        if self.take("("):
            self.type()
            self.need(")")
            return None
        if self.take("["):
            if self.take("]"):
                return self.type()
            if self.take("..."):
                pass
            else:
                old, self.header = self.header, False
                self.expression()
                self.header = old
            self.need("]")
            return self.type()
        if self.take("<-"):
            self.need("chan")
            return self.type()
        if self.word("chan"):
            self.step()
            self.take("<-")
            return self.type()
        if self.word("map"):
            self.step()
            self.need("[")
            self.type()
            self.need("]")
            return self.type()
        if self.word("func"):
            self.step()
            return self.signature()
        if self.word("struct"):
            return self.struct()
        if self.word("interface"):
            return self.interface()
        self.name()
        if self.take("."):
            self.name()
        if self.on("[") and self.ahead().text != "]":
            self.guess(self.type_arguments)
        return None

    def type_arguments(self) -> None:
        self.need("[")
        self.type()
        while self.take(","):
            if self.on("]"):
                break
            self.type()
        self.need("]")

    def struct(self) -> None:
        self.need("struct")
        self.need("{")
        while not self.on("}"):
            if self.on("*", "("):
                self.type()
            else:
                y = self.ahead()
                if y.text in (";", "}", ".") or y.kind == "str":
                    self.type()
                elif y.text == "[" and not self.guess(self.field):
                    self.type()
                elif y.text != "[":
                    self.field()
            if self.tok.kind == "str":
                self.step()
            if not self.take(";") and not self.on("}"):
                self.fail("expected ';' or '}'")
        self.need("}")

    def field(self) -> None:
        self.names()
        self.type()
        if not (self.tok.kind == "str" or self.on(";", "}")):
            self.fail("expected the end of the field")

    def interface(self) -> None:
        self.need("interface")
        self.need("{")
        while not self.on("}"):
            if self.tok.kind == "id" and self.tok.text not in KEYWORDS and self.ahead().text == "(":
                self.name()
                self.signature()
            else:
                self.constraint()
            if not self.take(";") and not self.on("}"):
                self.fail("expected ';' or '}'")
        self.need("}")

    # --- statements ---
    def body(self) -> None:
        old, self.header = self.header, False
        self.block()
        self.header = old

    def block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self) -> None:
        while not (self.on("}") or self.tok.kind == "end" or self.word("case", "default")):
            begin, depth, header = self.i, self.depth, self.header
            try:
                self.statement()
                if not self.on("}") and not self.word("case", "default"):
                    self.need(";")
            except Fault as fault:
                self.depth, self.header = depth, header
                self.recover(fault, begin)

    def statement(self) -> None:
        self.deeper()
        self._statement()
        self.depth -= 1

    def _statement(self) -> None:
        x = self.tok
        if x.kind == "op":
            if x.text == "{":
                return self.block()
            if x.text == ";":
                return None
            return self.simple()
        if x.kind != "id" or x.text not in KEYWORDS:
            if x.kind == "id" and self.ahead().text == ":" and not self.header:
                self.step()
                self.step()
                if not self.on("}"):
                    self.statement()
                return None
            return self.simple()
        w = x.text
        if w in ("var", "const", "type"):
            return self.declaration()
        if w in ("func", "struct", "map", "chan", "interface"):
            return self.simple()
        if w == "return":
            self.step()
            if not self.on(";", "}"):
                self.expressions()
            return None
        if w in ("break", "continue", "goto"):
            self.step()
            if self.tok.kind == "id" and self.tok.text not in KEYWORDS:
                self.step()
            elif w == "goto":
                self.fail("expected a label")
            return None
        if w == "fallthrough":
            self.step()
            return None
        if w in ("go", "defer"):
            self.step()
            begin = self.i
            self.expression()
            if self.t[self.i - 1].text != ")" or self.i - begin < 2:
                self.fail(f"{w} needs a call")
            return None
        if w == "if":
            return self.if_()
        if w == "for":
            return self.for_()
        if w == "switch":
            return self.switch()
        if w == "select":
            self.step()
            self.need("{")
            while not self.on("}"):
                if not self.take("default"):
                    self.need("case")
                    self.simple()
                self.need(":")
                self.statements()
                if self.tok.kind == "end":
                    self.fail("expected '}'")
            self.need("}")
            return None
        return self.fail("unexpected keyword")

    def if_(self) -> None:
        self.need("if")
        old, self.header = self.header, True
        if self.on("{"):
            self.fail("expected a condition")
        if not self.on(";"):
            self.simple()
        if self.take(";"):
            if self.on("{"):
                self.fail("expected a condition")
            self.simple()
        self.header = old
        self.body()
        if self.take("else"):
            if self.word("if"):
                self.deeper()
                self.if_()
                self.depth -= 1
            else:
                self.body()

    def for_(self) -> None:
        self.need("for")
        old, self.header = self.header, True
        if not self.on("{"):
            if self.word("range"):
                self.step()
                self.expression()
            else:
                ranged = False
                if not self.on(";"):
                    ranged = self.simple(may_range=True)
                if not ranged and self.on(";"):
                    self.step()
                    if not self.on(";"):
                        self.simple()
                    self.need(";")
                    if not self.on("{"):
                        self.simple()
        self.header = old
        self.body()

    def switch(self) -> None:
        self.need("switch")
        old, self.header = self.header, True
        if not self.on("{"):
            if not self.on(";"):
                self.simple()
            if self.take(";") and not self.on("{"):
                self.simple()
        self.header = False
        self.need("{")
        while not self.on("}"):
            if not self.take("default"):
                self.need("case")
                self.type_or_expression()
                while self.take(","):
                    self.type_or_expression()
            self.need(":")
            self.statements()
            if self.tok.kind == "end":
                self.fail("expected '}'")
        self.header = old
        self.need("}")

    def type_or_expression(self) -> None:
        if not self.guess(lambda: (self.expression(), self.on(",", ":") or self.fail("expected ':'"))):
            self.type()

    def simple(self, may_range: bool = False) -> bool:
        """A simple statement; whether it is the clause of a range."""
        self.expressions()
        x = self.tok
        if x.kind != "op":
            return False
        if x.text in ("++", "--"):
            self.step()
        elif x.text in ASSIGN:
            self.step()
            if may_range and self.word("range"):
                self.step()
                self.expression()
                return True
            self.expressions()
        elif x.text == "<-":
            self.step()
            self.expression()
        return False

    # --- expressions ---
    def expressions(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def expression(self, least: int = 1) -> None:
        """Precedence climbing."""
        self.deeper()
        self.unary()
        while self.tok.kind == "op" and (strength := BINARY.get(self.tok.text, 0)) >= least:
            self.step()
            self.expression(strength + 1)
        self.depth -= 1

    def unary(self) -> None:
        n = 0
        while self.on("+", "-", "!", "^", "*", "&", "<-", "~"):
            self.step()
            n += 1
        self.primary()

    def primary(self) -> None:
        x = self.tok
        literal = False  # whether a brace here opens a composite literal
        if x.kind in ("num", "str", "chr"):
            self.step()
        elif x.kind == "op" and x.text == "(":
            self.step()
            old, self.header = self.header, False
            if not self.guess(lambda: (self.expression(), self.need(")"))):
                self.type()
                self.need(")")
            self.header = old
        elif x.kind == "id" and x.text == "func":
            self.step()
            self.signature()
            if self.on("{"):
                self.body()
        elif (x.kind == "op" and x.text == "[") or (x.kind == "id" and x.text in ("map", "struct", "chan", "interface")):
            self.type()
            literal = True
            if self.on("{"):
                self.composite()
        else:
            self.name()
            literal = not self.header
        while True:
            x = self.tok
            if x.kind != "op":
                return
            if x.text == ".":
                self.step()
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.need(")")
                    literal = False
                else:
                    self.name()
            elif x.text == "[":
                literal = self.index() and not self.header
            elif x.text == "(":
                self.call()
                literal = False
            elif x.text == "{" and literal:
                self.composite()
                literal = False
            else:
                return

    def index(self) -> bool:
        """An index, a slice, or type arguments; whether it may be type arguments."""
        self.need("[")
        old, self.header = self.header, False
        colons, places = 0, 0
        while not self.on("]"):
            if self.take(":"):
                colons += 1
                continue
            self.type_or_value()
            places += 1
            if self.take(","):
                continue
            if not self.on(":", "]"):
                self.fail("expected ']'")
        if colons > 2 or (colons == 0 and places == 0):
            self.fail("malformed index")
        self.header = old
        self.need("]")
        return colons == 0

    def type_or_value(self) -> None:
        if not self.guess(lambda: (self.expression(), self.on(",", ":", "]", ")", "...") or self.fail("expected an expression"))):
            self.type()

    def call(self) -> None:
        self.need("(")
        old, self.header = self.header, False
        while not self.on(")"):
            self.type_or_value()
            self.take("...")
            if not self.take(","):
                break
        self.header = old
        self.need(")")

    def composite(self) -> None:
        self.need("{")
        self.deeper()
        old, self.header = self.header, False
        while not self.on("}"):
            self.element()
            if self.take(":"):
                self.element()
            if not self.take(","):
                break
        self.header = old
        self.depth -= 1
        self.need("}")

    def element(self) -> None:
        if self.on("{"):
            self.composite()
        else:
            self.expression()


def check(text: str, errors: list) -> list[tuple[int, str]]:
    return checked(text, lex, lambda tokens: Go(tokens), errors)
