"""Java."""

from __future__ import annotations

import re

from lodestone.llm.syntax.base import Fault, Parser, Token, checked, missed

TOKEN = re.compile(
    r"""(?P<ws>[ \t\f\r\n\x1a]+)|(?P<lc>//[^\n\r]*)|(?P<bc>/\*(?:[^*]|\*(?!/))*\*/)"""
    r"""|(?P<num>0[xX][\da-fA-F_]*(?:\.[\da-fA-F_]*)?(?:[pP][+-]?[\d_]+[fFdD]?|[lL])?|0[bB][01_]+[lL]?|(?:\d[\d_]*\.?(?:\d[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?[fFdDlL]?)"""
    r"""|(?P<id>(?:[^\W\d]|\$)[\w$]*)|(?P<str>\"\"\"[ \t\f]*(?:\r\n|\n|\r)(?:[^"\\]|\\[\s\S]|"(?!""))*\"\"\"|"(?:[^"\\\n\r]|\\(?:[btnfrs"'\\]|[0-3]?[0-7]{1,2}|u+[\da-fA-F]{4}))*")"""
    r"""|(?P<chr>'(?:[^'\\\n\r]|\\(?:[btnfrs"'\\]|[0-3]?[0-7]{1,2}|u+[\da-fA-F]{4}))')"""
    r"""|(?P<op>\.\.\.|->|::|\+\+|--|&&|\|\||==|!=|<=|<<=|<<|[-+*/%&|^]=|[-+*/%&|^<>=!()\[\]{},;.:?~@])"""
)
#: Keywords and literals of Java (fixed values).
KEYWORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if "
    "implements import instanceof int interface long native new package private protected public return short static strictfp super switch "
    "synchronized this throw throws transient try void volatile while true false null _".split()
)
PRIMITIVE = frozenset("boolean byte char double float int long short".split())
MODIFIERS = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed".split())
BINARY = {"||": 1, "&&": 2, "|": 3, "^": 4, "&": 5, "==": 6, "!=": 6, "<": 7, "<=": 7, "instanceof": 7, "<<": 8, "+": 9, "-": 9, "*": 10, "/": 10, "%": 10}
ASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<=".split())
STATEMENTS = frozenset(("assign", "call", "new", "step"))


def lex(text: str, errors: list | None = None) -> list[Token]:
    """Tokens; ``>`` always comes alone. A lexical error is a Fault, or is added to ``errors``."""
    text = text.removeprefix("﻿")
    out: list[Token] = []
    at, line, n, last = 0, 1, len(text), 0
    while at < n:
        try:
            m = TOKEN.match(text, at)
            if not m:
                what = {'"': "string without an end", "'": "character literal without an end"}.get(text[at])
                raise Fault(what or ("comment without an end" if text.startswith("/*", at) else f"unexpected {text[at : at + 10]!r}"), line)
            kind, x = m.lastgroup, m.group()
            if text.startswith("/*", at) and kind == "op":
                raise Fault("comment without an end", line)
            if kind not in ("ws", "lc", "bc"):
                if kind == "num" and (y := TOKEN.match(text, m.end())) and y.lastgroup in ("id", "num"):
                    raise Fault("malformed number", line)
                out.append(Token(kind, x, line, at, line > last))
                last = line
            line += x.count("\n") if "\n" in x else x.count("\r")
            at = m.end()
        except Fault as fault:
            at = missed(text, at, fault, errors, out, not out or out[-1].line < line)
    out.append(Token("end", "", line, n, True))
    return out


class Java(Parser):
    STARTS = frozenset("class interface enum public private protected static final if for while do try switch return throw import".split())

    def __init__(self, tokens: list[Token]):
        super().__init__(tokens)
        self.stage = 0  # 0: package or anything behind it, 1: imports, 2: types

    def word(self, *texts: str) -> bool:
        return self.tok.kind == "id" and self.tok.text in texts

    def name(self) -> str:
        if self.tok.kind != "id" or (self.tok.text in KEYWORDS and self.tok.text != "_"):
            self.fail("expected a name")
        return self.step().text

    def qualified(self) -> None:
        self.name()
        while self.on(".") and self.ahead().kind == "id" and self.ahead().text not in KEYWORDS:
            self.step()
            self.name()

    # --- the file ---
    def top(self) -> None:
        if self.take(";"):
            return None
        if self.word("package") or (self.on("@") and self.stage == 0 and self.annotated_package()):
            if self.stage > 0:
                self.fail("package behind other declarations")
            self.stage = 1
            self.need("package")
            self.qualified()
            self.need(";")
            return None
        if self.word("import"):
            if self.stage > 1:
                self.fail("import behind a type")
            self.stage = max(self.stage, 1)
            self.step()
            self.take("static")
            self.qualified()
            if self.take("."):
                self.need("*")
            self.need(";")
            return None
        if self.word("module", "open") and self.ahead().kind == "id":
            while not self.on("{"):
                if self.tok.kind == "end":
                    self.fail("expected '{'")
                self.step()
            while not self.on("}"):
                if self.tok.kind == "end":
                    self.fail("expected '}'")
                self.step()
            self.step()
            return None
        self.stage = 2
        self.modifiers()
        if not self.type_declaration():
            self.fail("expected class, interface, enum or record")
        return None

    def annotated_package(self) -> bool:
        place = self.i
        try:
            while self.on("@") and self.ahead().text != "interface":
                self.annotation()
            return self.word("package")
        except Fault:
            return False
        finally:
            if not self.word("package"):
                self.back(place)

    def modifiers(self) -> set[str]:
        seen: set[str] = set()
        while True:
            if self.on("@") and self.ahead().text != "interface":
                self.annotation()
            elif self.word("sealed") and not (self.ahead().kind == "id"):
                return seen
            elif self.word("default") and self.ahead().text in (":", "->"):
                return seen
            elif self.word("synchronized") and self.ahead().text == "(":
                return seen
            elif self.word("non") and self.ahead().text == "-" and self.ahead(2).text == "sealed":
                for _ in range(3):
                    self.step()
            elif self.tok.kind == "id" and self.tok.text in MODIFIERS:
                if self.tok.text in seen:
                    self.fail("repeated modifier")
                seen.add(self.step().text)
            else:
                return seen

    def annotation(self) -> None:
        self.need("@")
        self.qualified()
        if self.take("("):
            while not self.on(")"):
                if self.tok.kind == "id" and self.ahead().text == "=":
                    self.name()
                    self.step()
                self.annotation_value()
                if not self.take(","):
                    break
            self.need(")")

    def annotation_value(self) -> None:
        if self.on("@"):
            self.annotation()
        elif self.take("{"):
            while not self.on("}"):
                self.annotation_value()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.ternary()

    def type_declaration(self) -> bool:
        """A class, interface, enum, record or annotation type, if there is one here."""
        if self.word("class"):
            self.step()
            self.name()
            self.type_parameters()
            if self.take("extends"):
                self.type()
            for w in ("implements", "permits"):
                if self.take(w):
                    self.types()
            self.class_body()
        elif self.word("interface"):
            self.step()
            self.name()
            self.type_parameters()
            for w in ("extends", "permits"):
                if self.take(w):
                    self.types()
            self.class_body()
        elif self.on("@") and self.ahead().text == "interface":
            self.step()
            self.step()
            self.name()
            self.class_body(annotation=True)
        elif self.word("enum") and self.ahead().kind == "id":
            self.step()
            self.name()
            if self.take("implements"):
                self.types()
            self.enum_body()
        elif self.word("record") and self.ahead().kind == "id" and self.ahead(2).text in ("(", "<"):
            self.step()
            self.name()
            self.type_parameters()
            self.parameters()
            if self.take("implements"):
                self.types()
            self.class_body(record=True)
        else:
            return False
        return True

    def types(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def type_parameters(self) -> None:
        if not self.take("<"):
            return
        while True:
            while self.on("@"):
                self.annotation()
            self.name()
            if self.take("extends"):
                self.type()
                while self.take("&"):
                    self.type()
            if not self.take(","):
                break
        self.need(">")

    def enum_body(self) -> None:
        self.need("{")
        while not self.on(";", "}"):
            while self.on("@"):
                self.annotation()
            self.name()
            if self.on("("):
                self.arguments()
            if self.on("{"):
                self.class_body()
            if not self.take(","):
                break
        if self.take(";"):
            self.members()
        self.need("}")

    def class_body(self, annotation: bool = False, record: bool = False) -> None:
        self.need("{")
        self.members(annotation, record)
        self.need("}")

    def members(self, annotation: bool = False, record: bool = False) -> None:
        while not self.on("}") and self.tok.kind != "end":
            begin, depth = self.i, self.depth
            try:
                self.deeper()
                self.member(annotation, record)
                self.depth -= 1
            except Fault as fault:
                self.depth = depth
                self.recover(fault, begin)

    def member(self, annotation: bool, record: bool) -> None:
        if self.take(";"):
            return None
        if self.on("{"):
            return self.block()
        if self.word("static") and self.ahead().text == "{":
            self.step()
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return None
        self.type_parameters()
        if self.tok.kind == "id" and self.ahead().text == "(" and self.tok.text not in KEYWORDS:
            self.step()  # a constructor
            self.parameters()
            self.throws()
            return self.block()
        if record and self.tok.kind == "id" and self.ahead().text == "{":
            self.step()
            return self.block()
        if not self.take("void"):
            self.type()
        self.name()
        if self.on("("):
            self.parameters()
            self.dimensions()
            self.throws()
            if annotation and self.take("default"):
                self.annotation_value()
            if self.on("{"):
                return self.block()
            self.need(";")
            return None
        self.variables()
        self.need(";")
        return None

    def throws(self) -> None:
        if self.take("throws"):
            self.types()

    def dimensions(self) -> None:
        while self.on("[") and self.ahead().text == "]":
            self.step()
            self.step()

    def variables(self) -> None:
        """What follows the first name of a declaration."""
        while True:
            self.dimensions()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.name()

    def initializer(self) -> None:
        if self.on("{"):
            self.array_values()
        else:
            self.expression()

    def array_values(self) -> None:
        self.need("{")
        self.deeper()
        while not self.on("}"):
            if self.take(","):
                break
            self.initializer()
            if not self.take(","):
                break
        self.depth -= 1
        self.need("}")

    def parameters(self) -> None:
        self.need("(")
        if not self.on(")"):
            while True:
                self.modifiers()
                self.type()
                while self.on("@"):
                    self.annotation()
                self.take("...")
                if self.take("this"):
                    pass
                else:
                    self.name()
                    if self.take("."):
                        self.need("this")
                self.dimensions()
                if not self.take(","):
                    break
        self.need(")")

    # --- types ---
    def type(self, arrays: bool = True) -> None:
        self.deeper()
        while self.on("@"):
            self.annotation()
        if self.take("?"):
            if self.take("extends") or self.take("super"):
                self.type()
        elif self.tok.kind == "id" and self.tok.text in PRIMITIVE:
            self.step()
        else:
            self.name()
            self.type_arguments()
            while self.on(".") and self.ahead().kind == "id" and self.ahead().text not in KEYWORDS:
                self.step()
                self.name()
                self.type_arguments()
        if arrays:
            self.dimensions()
        self.depth -= 1

    def type_arguments(self) -> None:
        if not self.on("<"):
            return
        self.step()
        if self.take(">"):
            return
        self.types()
        self.need(">")

    # --- statements ---
    def block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self) -> None:
        while not (self.on("}") or self.tok.kind == "end" or self.case_ahead()):
            begin, depth = self.i, self.depth
            try:
                self.statement(True)
            except Fault as fault:
                self.depth = depth
                self.recover(fault, begin)

    def case_ahead(self) -> bool:
        return self.word("case") or (self.word("default") and self.ahead().text in (":", "->"))

    def statement(self, declarations: bool = False) -> None:
        self.deeper()
        self._statement(declarations)
        self.depth -= 1

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def _statement(self, declarations: bool) -> None:
        x, y = self.tok, self.ahead()
        if x.kind == "op" and x.text == "{":
            return self.block()
        if x.kind == "op" and x.text == ";":
            self.step()
            return None
        if x.kind == "id":
            w = x.text
            if w == "if":
                self.step()
                self.paren()
                self.statement()
                if self.take("else"):
                    self.statement()
                return None
            if w == "for":
                return self.for_()
            if w == "while":
                self.step()
                self.paren()
                return self.statement()
            if w == "do":
                self.step()
                self.statement()
                self.need("while")
                self.paren()
                self.need(";")
                return None
            if w == "try":
                return self.try_()
            if w == "switch":
                self.switch()
                self.take(";")
                return None
            if w == "synchronized" and y.text == "(":
                self.step()
                self.paren()
                return self.block()
            if w in ("return", "throw") or (w == "yield" and y.text not in ("=", ".", "(", "[", "++", "--") or w == "yield" and y.text == "("):
                self.step()
                if w != "return" or not self.on(";"):
                    self.expression()
                self.need(";")
                return None
            if w in ("break", "continue"):
                self.step()
                if self.tok.kind == "id":
                    self.name()
                self.need(";")
                return None
            if w == "assert":
                self.step()
                self.expression()
                if self.take(":"):
                    self.expression()
                self.need(";")
                return None
            if w in ("else", "catch", "finally"):
                self.fail("unexpected keyword")
            if y.text == ":" and y.kind == "op" and w not in KEYWORDS:
                self.step()
                self.step()
                return self.statement()
        if (x.kind == "op" and x.text == "@") or (x.kind == "id" and (x.text in ("final", "abstract", "static", "strictfp", "class", "interface", "enum") or x.text in ("record", "sealed", "non") and y.kind == "id")):
            if not declarations:
                self.fail("a declaration can't stand here")
            place = self.i
            self.modifiers()
            if self.type_declaration():
                return None
            if self.i == place and x.text in ("record", "sealed", "non"):
                pass
            else:
                return self.local()
        if declarations and self.local_ahead():
            return self.local()
        line = x.line
        if self.expression() not in STATEMENTS:
            raise Fault("not a statement", line)
        self.need(";")
        return None

    def local_ahead(self) -> bool:
        """Whether a type and a name come next."""
        x, y = self.tok, self.ahead()
        if x.kind != "id" or (x.text in KEYWORDS and x.text not in PRIMITIVE):
            return False
        if y.kind == "id" and y.text != "instanceof":
            return True
        if y.text not in ("<", ".", "["):
            return False
        place, depth = self.i, self.depth
        try:
            self.type()
            return self.tok.kind == "id" and self.tok.text not in KEYWORDS
        except Fault:
            return False
        finally:
            self.back(place)
            self.depth = depth

    def local(self) -> None:
        self.type()
        self.name()
        self.variables()
        self.need(";")

    def for_(self) -> None:
        self.need("for")
        self.need("(")
        if not self.on(";"):
            if self.on("@") or self.word("final") or self.local_ahead():
                self.modifiers()
                self.type()
                self.name()
                if self.take(":"):
                    self.expression()
                    self.need(")")
                    return self.statement()
                self.variables()
            else:
                self.expressions_as_statements()
        self.need(";")
        if not self.on(";"):
            self.expression()
        self.need(";")
        if not self.on(")"):
            self.expressions_as_statements()
        self.need(")")
        return self.statement()

    def expressions_as_statements(self) -> None:
        while True:
            line = self.tok.line
            if self.expression() not in STATEMENTS:
                raise Fault("not a statement", line)
            if not self.take(","):
                return

    def try_(self) -> None:
        self.need("try")
        handled = False
        if self.take("("):
            handled = True
            while not self.on(")"):
                if self.on("@") or self.word("final") or self.local_ahead():
                    self.modifiers()
                    self.type()
                    self.name()
                    self.need("=")
                self.expression()
                if not self.take(";"):
                    break
            self.need(")")
        self.block()
        while self.take("catch"):
            handled = True
            self.need("(")
            self.modifiers()
            self.type()
            while self.take("|"):
                self.type()
            self.name()
            self.need(")")
            self.block()
        if self.take("finally"):
            handled = True
            self.block()
        if not handled:
            self.fail("expected catch or finally")

    def switch(self) -> None:
        self.need("switch")
        self.paren()
        self.need("{")
        while not self.on("}"):
            if not self.take("default"):
                self.need("case")
                while True:
                    if not self.take("default") and not self.guess(self.pattern):
                        self.ternary()
                    if not self.take(","):
                        break
                if self.take("when"):
                    self.expression()
            if self.take("->"):
                if self.on("{"):
                    self.block()
                elif self.word("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                self.statements()
        self.need("}")

    def pattern(self) -> None:
        self.modifiers()
        self.type()
        if self.take("("):
            while not self.on(")"):
                self.pattern()
                if not self.take(","):
                    break
            self.need(")")
            if self.tok.kind == "id" and self.tok.text not in ("when",) and self.tok.text not in KEYWORDS:
                self.name()
        else:
            self.name()
        if not (self.on("->", ":", ",", ")", "&&", "||", "?", ";") or self.word("when")):
            self.fail("expected the end of the pattern")

    # --- expressions: each gives its kind, for what may be a statement or a target ---
    def expression(self) -> str:
        self.deeper()
        kind = self._expression()
        self.depth -= 1
        return kind

    def _expression(self) -> str:
        if self.lambda_ahead():
            self.lambda_()
            return "lambda"
        line = self.tok.line
        kind = self.ternary()
        op = self.assign_operator()
        if op:
            if kind not in ("name", "field", "index"):
                raise Fault("can't be assigned to", line)
            self.expression()
            return "assign"
        return kind

    def lambda_ahead(self) -> bool:
        x, y = self.tok, self.ahead()
        if x.kind == "id":
            return y.text == "->" and x.text not in KEYWORDS | {"default"} or (x.text == "_" and y.text == "->")
        if not (x.kind == "op" and x.text == "("):
            return False
        level, j = 0, self.i
        while self.t[j].kind != "end":
            z = self.t[j]
            if z.kind == "op":
                if z.text == "(":
                    level += 1
                elif z.text == ")":
                    level -= 1
                    if level == 0:
                        return self.t[j + 1].text == "->"
                elif z.text in ("{", "}", ";"):
                    return False
            j += 1
        return False

    def lambda_(self) -> None:
        if self.tok.kind == "id":
            self.name()
        else:
            self.need("(")
            while not self.on(")"):
                if self.tok.kind == "id" and self.ahead().text in (",", ")"):
                    self.name()
                else:
                    self.modifiers()
                    self.type()
                    self.take("...")
                    self.name()
                    self.dimensions()
                if not self.take(","):
                    break
            self.need(")")
        self.need("->")
        if self.on("{"):
            self.block()
        else:
            self.expression()

    def assign_operator(self) -> bool:
        x = self.tok
        if x.kind != "op":
            return False
        if x.text in ASSIGN:
            self.step()
            return True
        if x.text == ">":
            j = self.i
            while self.t[j].text == ">" and self.t[j + 1].at == self.t[j].at + 1:
                j += 1
            if j >= self.i + 2 and self.t[j].text == "=":
                self.back(j + 1)
                return True
        return False

    def ternary(self) -> str:
        kind = self.binary(1)
        if self.take("?"):
            self.expression()
            self.need(":")
            if self.lambda_ahead():
                self.lambda_()
            else:
                self.deeper()
                self.ternary()
                self.depth -= 1
            return "value"
        return kind

    def operator(self) -> tuple[int, int]:
        x = self.tok
        if x.kind == "op":
            if x.text == ">":
                run, j = 1, self.i
                while self.t[j + 1].text == ">" and self.t[j + 1].at == self.t[j].at + 1 and run < 3:
                    run, j = run + 1, j + 1
                after = self.t[j + 1]
                equal = after.at == self.t[j].at + 1 and after.text in ("=", "==")
                if equal:
                    return (7, 2) if run == 1 and after.text == "=" else (0, 0)
                return (7, 1) if run == 1 else (8, run)
            return BINARY.get(x.text, 0), 1
        if x.kind == "id" and x.text == "instanceof":
            return 7, 1
        return 0, 0

    def binary(self, least: int) -> str:
        """Precedence climbing."""
        kind = self.unary()
        while True:
            strength, size = self.operator()
            if not strength or strength < least:
                return kind
            kind = "value"
            if self.word("instanceof"):
                self.step()
                if not self.guess(self.pattern):
                    self.modifiers()
                    self.type()
                continue
            for _ in range(size):
                self.step()
            if self.lambda_ahead():
                self.fail("a lambda for an operand")
            self.deeper()
            self.binary(strength + 1)
            self.depth -= 1

    def unary(self) -> str:
        x = self.tok
        if x.kind == "op":
            if x.text in ("++", "--"):
                self.step()
                line = self.tok.line
                if self.unary() not in ("name", "field", "index"):
                    raise Fault("can't be incremented", line)
                return "step"
            if x.text in ("+", "-", "!", "~"):
                self.step()
                self.deeper()
                self.unary()
                self.depth -= 1
                return "value"
            if x.text == "(" and self.cast():
                return "value"
        line = x.line
        kind = self.postfix()
        if self.on("++", "--"):
            if kind not in ("name", "field", "index"):
                raise Fault("can't be incremented", line)
            self.step()
            return "step"
        return kind

    def cast(self) -> bool:
        """A cast with its operand, if there is one here."""
        place, depth = self.i, self.depth
        try:
            self.need("(")
            primitive = self.tok.kind == "id" and self.tok.text in PRIMITIVE and self.ahead().text == ")"
            self.type()
            while self.take("&"):
                self.type()
            self.need(")")
        except Fault:
            self.back(place)
            self.depth = depth
            return False
        x = self.tok
        if x.kind in ("num", "str", "chr") or (x.kind == "id" and x.text not in ("instanceof",) and (x.text not in KEYWORDS or x.text in PRIMITIVE or x.text in ("this", "super", "new", "true", "false", "null", "void", "switch"))) or (x.kind == "op" and (x.text in ("(", "!", "~") or (primitive and x.text in ("+", "-", "++", "--")))):
            self.deeper()
            if self.lambda_ahead():
                self.lambda_()
            else:
                self.unary()
            self.depth -= 1
            return True
        self.back(place)
        return False

    def arguments(self) -> None:
        self.need("(")
        while not self.on(")"):
            self.expression()
            if not self.take(","):
                break
        self.need(")")

    def postfix(self) -> str:
        kind = self.primary()
        while True:
            x = self.tok
            if x.kind != "op":
                return kind
            if x.text == ".":
                self.step()
                if self.word("new"):
                    self.new()
                    kind = "new"
                elif self.word("class", "this"):
                    self.step()
                    kind = "value"
                elif self.word("super"):
                    self.step()
                    kind = "super"
                else:
                    if self.on("<"):
                        self.type_arguments()
                    self.name()
                    kind = "field"
            elif x.text == "[":
                self.step()
                if self.on("]") and kind in ("name", "field", "value"):
                    self.step()
                    self.dimensions()
                    if self.take("."):
                        self.need("class")
                    elif not self.on("::"):
                        self.fail("expected an index")
                    kind = "value"
                    continue
                self.expression()
                self.need("]")
                kind = "index"
            elif x.text == "(" and kind in ("name", "field", "this", "super"):
                self.arguments()
                kind = "call"
            elif x.text == "::":
                self.step()
                if self.on("<"):
                    self.type_arguments()
                if not self.take("new"):
                    self.name()
                kind = "value"
            elif x.text == "<" and kind in ("name", "field") and self.generic_reference():
                kind = "value"
            else:
                return "value" if kind in ("this", "super") else kind

    def generic_reference(self) -> bool:
        """Type arguments that a method reference or a class literal follows."""
        place, depth = self.i, self.depth
        try:
            self.type_arguments()
            while self.on(".") and self.ahead().kind == "id":
                self.step()
                self.name()
                self.type_arguments()
            self.dimensions()
        except Fault:
            self.back(place)
            self.depth = depth
            return False
        if self.on("::"):
            return True
        self.back(place)
        return False

    def primary(self) -> str:
        x = self.tok
        if x.kind in ("num", "str", "chr"):
            self.step()
            return "value"
        if x.kind == "op" and x.text == "(":
            self.step()
            kind = self.expression()
            self.need(")")
            return kind if kind in ("name", "field", "index") else "value"
        if x.kind == "op" and x.text == "@":
            self.annotation()
            return self.primary()
        if x.kind == "id":
            w = x.text
            if w in ("this", "super"):
                self.step()
                return w
            if w in ("true", "false", "null"):
                self.step()
                return "value"
            if w == "new":
                return self.new()
            if w == "switch":
                self.switch()
                return "value"
            if w in PRIMITIVE or w == "void":
                self.step()
                self.dimensions()
                if self.on("::"):
                    return "value"
                self.need(".")
                self.need("class")
                return "value"
            self.name()
            return "name"
        return self.fail("expected an expression")

    def new(self) -> str:
        self.need("new")
        if self.on("<"):
            self.type_arguments()
        while self.on("@"):
            self.annotation()
        self.type(arrays=False)
        if self.on("["):
            given = True
            sizes = 0
            while self.on("["):
                self.step()
                if self.on("]"):
                    given = False
                    self.step()
                    continue
                if not given:
                    self.fail("a size behind an open dimension")
                sizes += 1
                self.expression()
                self.need("]")
                if self.on("{"):
                    break
            if sizes == 0:
                if not self.on("{"):
                    self.fail("expected the values of the array")
                self.array_values()
            return "value"
        if not self.on("("):
            self.fail("expected '(' or '['")
        self.arguments()
        if self.on("{"):
            self.class_body()
        return "new"


def check(text: str, errors: list) -> list[tuple[int, str]]:
    return checked(text, lex, lambda tokens: Java(tokens), errors)
