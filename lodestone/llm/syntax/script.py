"""ECMAScript modules and TypeScript."""

from __future__ import annotations

import re

from lodestone.llm.syntax.base import Fault, Parser, Token, checked, missed

SPACE = re.compile(r"[ \t\f\v ﻿ - 　]+")
LINE = re.compile(r"\r\n|[\n\r  ]")
LINE_COMMENT = re.compile(r"//[^\n\r  ]*")
NUMBER = re.compile(r"(?:0[xX][\da-fA-F](?:_?[\da-fA-F])*n?|0[bB][01](?:_?[01])*n?|0[oO][0-7](?:_?[0-7])*n?|(?:(?:0|[1-9](?:_?\d)*)n)|(?:(?:0|[1-9](?:_?\d)*)(?:\.(?:\d(?:_?\d)*)?)?|\.\d(?:_?\d)*)(?:[eE][+-]?\d(?:_?\d)*)?)")
WORD = re.compile(r"(?:[^\W\d]|[$_]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})(?:[\w$‌‍]|\\u[0-9a-fA-F]{4}|\\u\{[0-9a-fA-F]+\})*")
STRING = re.compile(r"""'(?:[^'\\\n\r]|\\(?:\r\n|[\s\S]))*'|"(?:[^"\\\n\r]|\\(?:\r\n|[\s\S]))*\"""")
REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n\r]|\\[^\n\r]|\[(?:[^\]\\\n\r]|\\[^\n\r])*\])+/(?P<flags>[A-Za-z]*)")
PUNCT = re.compile(r"\.\.\.|=>|===|!==|\*\*=|<<=|&&=|\|\|=|\?\?=|==|!=|<=|<<|\+\+|--|&&|\|\||\?\?|\?\.(?!\d)|\*\*|[-+*/%&|^]=|[{}()\[\];,<>+\-*/%&|^!~?:=.@#]")

#: Reserved words of ECMAScript (fixed values).
RESERVED = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in "
    "instanceof new null return super switch this throw true try typeof var void while with".split()
)
#: Words reserved in strict code (fixed values).
STRICT = frozenset("implements interface let package private protected public static yield await".split())
BEFORE_REGEX = frozenset("return typeof case delete void in instanceof new throw do else yield await of extends default".split())
BINARY = {"??": 1, "||": 2, "&&": 3, "|": 4, "^": 5, "&": 6, "==": 7, "!=": 7, "===": 7, "!==": 7, "<": 8, "<=": 8, "instanceof": 8, "in": 8, "<<": 9, "+": 10, "-": 10, "*": 11, "/": 11, "%": 11, "**": 12}
ASSIGN = frozenset("= += -= *= /= %= **= <<= &= |= ^= &&= ||= ??=".split())


def lex(text: str, line: int = 1, errors: list | None = None) -> list[Token]:
    """Tokens; a lexical error is a Fault, or is added to ``errors``. ``>`` always comes alone: the parser joins neighbours."""
    out: list[Token] = []
    at, n, nl = 0, len(text), False
    if text.startswith("#!"):
        at = LINE.search(text).start() if LINE.search(text) else n
    while at < n:
        try:
            c = text[at]
            if m := SPACE.match(text, at):
                at = m.end()
                continue
            if m := LINE.match(text, at):
                at, nl, line = m.end(), True, line + 1
                continue
            if c == "/":
                if text.startswith("//", at):
                    at = LINE_COMMENT.match(text, at).end()
                    continue
                if text.startswith("/*", at):
                    end = text.find("*/", at + 2)
                    if end < 0:
                        raise Fault("comment without an end", line)
                    lines = len(LINE.findall(text, at, end))
                    nl, line, at = nl or lines > 0, line + lines, end + 2
                    continue
                p = out[-1] if out else None
                value = p is not None and (p.kind in ("num", "str", "tpl", "re", "priv") or p.text in (")", "]") or (p.text == "}" and not nl) or (p.kind == "id" and p.text not in BEFORE_REGEX) or p.text in ("++", "--"))
                if not value:
                    m = REGEX.match(text, at)
                    if not m:
                        raise Fault("regular expression without an end", line)
                    if len(set(m["flags"])) < len(m["flags"]) or set(m["flags"]) - set("dgimsuvy"):
                        raise Fault("unknown flags of a regular expression", line)
                    out.append(Token("re", m.group(), line, at, nl))
                    at, nl = m.end(), False
                    continue
            if c in "'\"":
                m = STRING.match(text, at)
                if not m:
                    raise Fault("string without an end", line)
                out.append(Token("str", m.group(), line, at, nl))
                line += len(LINE.findall(m.group()))
                at, nl = m.end(), False
                continue
            if c == "`":
                end, parts = template(text, at, line)
                out.append(Token("tpl", text[at:end], line, at, nl, parts))
                line += len(LINE.findall(text, at, end))
                at, nl = end, False
                continue
            if c.isdigit() or (c == "." and text[at + 1 : at + 2].isdigit()):
                m = NUMBER.match(text, at)
                if not m or WORD.match(text, m.end()) or text[m.end() : m.end() + 1].isdigit():
                    raise Fault("malformed number", line)
                out.append(Token("num", m.group(), line, at, nl))
                at, nl = m.end(), False
                continue
            if m := WORD.match(text, at):
                out.append(Token("id", m.group(), line, at, nl))
                at, nl = m.end(), False
                continue
            if c == "#" and (m := WORD.match(text, at + 1)):
                out.append(Token("priv", "#" + m.group(), line, at, nl))
                at, nl = m.end(), False
                continue
            m = PUNCT.match(text, at)
            if not m:
                raise Fault(f"unexpected character {c!r}", line)
            out.append(Token("op", m.group(), line, at, nl))
            at, nl = m.end(), False
        except Fault as fault:
            at = missed(text, at, fault, errors, out, nl)
            nl = False
    out.append(Token("end", "", line, n, True))
    return out


def template(text: str, at: int, line: int) -> tuple[int, list[tuple[str, int]]]:
    """Where the template that begins at ``at`` ends, and its expressions with their lines."""
    i, n, parts = at + 1, len(text), []
    while i < n:
        c = text[i]
        if c == "\\":
            i += 2
        elif c == "`":
            return i + 1, parts
        elif c == "$" and text.startswith("${", i):
            begin = i + 2
            i = closing(text, begin, line)
            parts.append((text[begin:i], line + len(LINE.findall(text, at, begin))))
            i += 1
        else:
            i += 1
    raise Fault("template without an end", line)


def closing(text: str, i: int, line: int) -> int:
    """The place of the brace that ends the expression of a template."""
    level, n = 0, len(text)
    while i < n:
        c = text[i]
        if c in "'\"":
            m = STRING.match(text, i)
            if not m:
                raise Fault("string without an end", line)
            i = m.end()
            continue
        if c == "`":
            i = template(text, i, line)[0]
            continue
        if text.startswith("//", i):
            i = LINE_COMMENT.match(text, i).end()
            continue
        if text.startswith("/*", i):
            i = text.find("*/", i) + 2
            if i < 2:
                break
            continue
        if c == "/" and text[max(0, i - 200) : i].rstrip()[-1:] in "(,=:[!&|?{};+-*%~^<>" and (m := REGEX.match(text, i)):
            i = m.end()
            continue
        if c == "{":
            level += 1
        elif c == "}":
            if level == 0:
                return i
            level -= 1
        i += 1
    raise Fault("template without an end", line)


class Script(Parser):
    """A module. ``typed``: TypeScript."""

    STARTS = frozenset("import export function class const let var if for while switch try return throw async interface type enum abstract declare".split())

    def __init__(self, tokens: list[Token], typed: bool, sub: bool = False):
        super().__init__(tokens)
        self.typed = typed
        self.fn = self.asyn = self.gen = False  # inside a function, an async one, a generator
        self.loops = self.switches = 0
        self.labels: list[str] = []
        self.no_in = False
        self.module = True  # at the top level
        self.asyn = True  # modules may await at the top
        self.no_conditional_type = False
        self.ambient = False
        self.cover: int | None = None

    # --- statements ---
    def top(self) -> None:
        self.statement(top=True)

    def semicolon(self) -> None:
        if self.take(";") or self.on("}") or self.tok.kind == "end" or self.tok.nl:
            return
        self.fail("expected ';'")

    def block(self) -> None:
        self.need("{")
        self.statements()
        self.need("}")

    def statements(self) -> None:
        while not self.on("}") and self.tok.kind != "end":
            begin, depth, state = self.i, self.depth, self.state()
            try:
                self.statement()
            except Fault as fault:
                self.depth = depth
                self.restore(state)
                self.recover(fault, begin)

    def state(self):
        return self.fn, self.asyn, self.gen, self.loops, self.switches, list(self.labels), self.no_in, self.no_conditional_type, self.ambient

    def restore(self, s) -> None:
        self.fn, self.asyn, self.gen, self.loops, self.switches, self.labels, self.no_in, self.no_conditional_type, self.ambient = s

    def word(self, *texts: str) -> bool:
        return self.tok.kind == "id" and self.tok.text in texts

    def statement(self, top: bool = False, single: bool = False) -> None:
        self.deeper()
        self._statement(top, single)
        self.depth -= 1

    def _statement(self, top: bool, single: bool) -> None:
        x, y = self.tok, self.ahead()
        if x.kind == "op":
            if x.text == "{":
                return self.block()
            if x.text == ";":
                self.step()
                return None
            if x.text == "@":
                self.decorators()
                if self.word("export"):
                    return self.export() if top else self.fail("export inside a block")
                self.take("abstract")
                return self.klass(True)
            return self.expression_statement()
        if x.kind != "id":
            return self.expression_statement()
        w = x.text
        if w in ("const", "var") or (w == "let" and (y.kind == "id" and y.text not in ("in", "instanceof", "of") or y.text in ("[", "{"))):
            if w == "const" and self.typed and y.text == "enum":
                self.step()
                return self.enum()
            if single and w != "var":
                self.fail("a declaration can't stand here")
            self.step()
            self.declarations(w)
            return self.semicolon()
        if w == "function" or (w == "async" and y.text == "function" and not y.nl):
            return self.function(True)
        if w == "class":
            return self.klass(True)
        if w == "if":
            self.step()
            self.paren()
            self.statement(single=True)
            if self.take("else"):
                self.statement(single=True)
            return None
        if w == "for":
            return self.for_loop()
        if w == "while":
            self.step()
            self.paren()
            return self.loop_body()
        if w == "do":
            self.step()
            self.loop_body()
            self.need("while")
            self.paren()
            self.take(";")
            return None
        if w == "return":
            if not self.fn:
                self.fail("return outside a function")
            self.step()
            if not (self.on(";", "}") or self.tok.kind == "end" or self.tok.nl):
                self.expression()
            return self.semicolon()
        if w in ("break", "continue"):
            self.step()
            if self.tok.kind == "id" and not self.tok.nl and self.tok.text not in RESERVED:
                if self.tok.text not in self.labels:
                    self.fail("no such label")
                self.step()
            elif not self.loops and not (w == "break" and self.switches):
                raise Fault(f"{w} outside a loop", x.line)
            return self.semicolon()
        if w == "throw":
            self.step()
            if self.tok.nl:
                self.fail("line break after throw")
            self.expression()
            return self.semicolon()
        if w == "try":
            self.step()
            self.block()
            handled = False
            if self.take("catch"):
                handled = True
                if self.take("("):
                    self.binding()
                    if self.typed and self.take(":"):
                        self.type()
                    self.need(")")
                self.block()
            if self.take("finally"):
                handled = True
                self.block()
            if not handled:
                self.fail("expected catch or finally")
            return None
        if w == "switch":
            self.step()
            self.paren()
            self.need("{")
            self.switches += 1
            default = False
            while not self.on("}"):
                if self.take("case"):
                    self.expression()
                else:
                    if default:
                        self.fail("a second default")
                    self.need("default")
                    default = True
                self.need(":")
                while not (self.on("}") or self.word("case", "default") or self.tok.kind == "end"):
                    self.statement()
            self.switches -= 1
            self.need("}")
            return None
        if w == "debugger":
            self.step()
            return self.semicolon()
        if w == "import" and y.text not in ("(", "."):
            if not top:
                self.fail("import inside a block")
            return self.import_()
        if w == "export":
            if not top and not self.ambient:
                self.fail("export inside a block")
            return self.export()
        if self.typed and self.typed_statement(x, y):
            return None
        if y.text == ":" and y.kind == "op" and w not in RESERVED and (w not in STRICT or self.typed):
            self.step()
            self.step()
            self.labels.append(w)
            self.statement(single=True)
            self.labels.pop()
            return None
        return self.expression_statement()

    def typed_statement(self, x: Token, y: Token) -> bool:
        w = x.text
        if y.nl and w not in ("interface", "enum"):
            return False
        if w == "interface" and y.kind == "id":
            self.step()
            self.name()
            self.type_parameters()
            if self.take("extends"):
                self.type_list()
            self.object_type()
            return True
        if w == "type" and y.kind == "id" and self.ahead(2).text in ("=", "<"):
            self.step()
            self.name()
            self.type_parameters()
            self.need("=")
            self.type()
            self.semicolon()
            return True
        if w == "enum" and y.kind == "id":
            self.enum()
            return True
        if w in ("namespace", "module") and (y.kind in ("id", "str")):
            self.step()
            if self.tok.kind == "str":
                self.step()
            else:
                self.name()
                while self.take("."):
                    self.name()
            if self.on("{"):
                old, self.ambient = self.ambient, True
                self.block()
                self.ambient = old
            else:
                self.semicolon()
            return True
        if w == "abstract" and y.text == "class":
            self.step()
            self.klass(True)
            return True
        if w == "declare" and y.kind == "id":
            self.step()
            old, self.ambient = self.ambient, True
            if self.word("global") and self.ahead().text == "{":
                self.step()
                self.block()
            else:
                self.statement()
            self.ambient = old
            return True
        return False

    def loop_body(self) -> None:
        self.loops += 1
        self.statement(single=True)
        self.loops -= 1

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def expression_statement(self) -> None:
        self.expression()
        self.semicolon()

    def declarations(self, kind: str, head: bool = False) -> None:
        while True:
            pattern = self.on("[", "{")
            line = self.tok.line
            self.binding()
            if self.typed:
                self.take("!")
                if self.take(":"):
                    self.type()
            if self.take("="):
                self.assignment()
            elif (kind == "const" or pattern) and not self.ambient and not (head and (self.word("of", "in"))):
                raise Fault("declaration without a value", line)
            if not self.take(","):
                return

    def for_loop(self) -> None:
        self.need("for")
        if self.word("await"):
            self.step()
        self.need("(")
        self.no_in = True
        each = None
        if self.word("var", "const") or (self.word("let") and (self.ahead().kind == "id" or self.ahead().text in ("[", "{"))):
            kind = self.step().text
            self.declarations(kind, head=True)
            each = self.word("of", "in")
        elif not self.on(";"):
            begin = self.tok
            what = self.expression(cover=True)
            each = self.word("of", "in")
            if each and what not in ("id", "mem", "arr", "obj"):
                raise Fault("can't be assigned to", begin.line)
            if not each:
                self.no_cover()
            self.cover = None
        self.no_in = False
        if each:
            if self.step().text == "of":
                self.assignment()
            else:
                self.expression()
        else:
            self.need(";")
            if not self.on(";"):
                self.expression()
            self.need(";")
            if not self.on(")"):
                self.expression()
        self.need(")")
        self.loop_body()

    def name(self) -> str:
        if self.tok.kind != "id":
            self.fail("expected a name")
        w = self.tok.text
        if w in RESERVED or (not self.typed and w in STRICT) or (w == "await" and not self.typed):
            self.fail("reserved word for a name")
        self.step()
        return w

    def any_name(self) -> None:
        if self.tok.kind != "id":
            self.fail("expected a name")
        self.step()

    def module_name(self) -> None:
        if self.tok.kind == "str":
            self.step()
        else:
            self.any_name()

    def source(self) -> None:
        if self.tok.kind != "str":
            self.fail("expected the name of a module")
        self.step()
        if self.word("with", "assert") and self.ahead().text == "{":
            self.step()
            self.primary()

    def specifiers(self) -> list[tuple[bool, Token]]:
        self.need("{")
        names = []
        while not self.on("}"):
            first = self.tok
            if self.typed and self.word("type") and (self.ahead().kind in ("id", "str") and self.ahead().text != "as" or self.ahead(2).text == "as" and self.ahead(3).kind == "id"):
                self.step()
            self.module_name()
            if self.word("as"):
                self.step()
                last = self.tok
                self.module_name()
            else:
                last = first
            names.append((first.kind == "str", last))
            if not self.take(","):
                break
        self.need("}")
        return names

    def import_(self) -> None:
        self.need("import")
        if self.tok.kind == "str":
            self.source()
            return self.semicolon()
        if self.typed and self.word("type") and (self.ahead().text in ("{", "*") or self.ahead().kind == "id" and (self.ahead().text != "from" or self.ahead(2).text == "from")):
            self.step()
        if self.tok.kind == "id":
            self.name()
            if self.typed and self.take("="):
                self.expression()
                return self.semicolon()
            if not self.take(","):
                self.need("from")
                self.source()
                return self.semicolon()
        if self.take("*"):
            self.need("as")
            self.name()
        else:
            for quoted, last in self.specifiers():
                if last.kind != "id" or (last.text in RESERVED or (last.text in STRICT and not self.typed)):
                    raise Fault("imported under a reserved word", last.line)
        self.need("from")
        self.source()
        return self.semicolon()

    def export(self) -> None:
        self.need("export")
        if self.take("default"):
            x = self.tok
            if x.text == "function" or (x.text == "async" and self.ahead().text == "function" and not self.ahead().nl):
                return self.function(True, nameless=True)
            if x.text == "@":
                self.decorators()
            if self.typed and self.word("abstract") and self.ahead().text == "class":
                self.step()
            if self.word("class"):
                return self.klass(True, nameless=True)
            if self.typed and self.word("interface"):
                self.typed_statement(self.tok, self.ahead())
                return None
            self.assignment()
            return self.semicolon()
        if self.typed and self.take("="):
            self.expression()
            return self.semicolon()
        if self.typed and self.word("as") and self.ahead().text == "namespace":
            self.step()
            self.step()
            self.name()
            return self.semicolon()
        if self.typed and self.word("type") and self.ahead().text in ("{", "*"):
            self.step()
        if self.typed and self.word("import"):
            return self.import_()
        if self.take("*"):
            if self.word("as"):
                self.step()
                self.module_name()
            self.need("from")
            self.source()
            return self.semicolon()
        if self.on("{"):
            names = self.specifiers()
            if self.word("from"):
                self.step()
                self.source()
            elif any(quoted for quoted, _ in names):
                self.fail("a string exported without a source")
            return self.semicolon()
        if self.on("@") or self.word("const", "let", "var", "function", "class", "async", *(("interface", "type", "enum", "namespace", "module", "abstract", "declare") if self.typed else ())):
            if self.word("async") and self.ahead().text != "function":
                self.fail("expected a declaration")
            return self.statement()
        return self.fail("expected a declaration")

    # --- functions and classes ---
    def function(self, statement: bool, nameless: bool = False) -> None:
        asyn = self.take("async")
        self.need("function")
        gen = self.take("*")
        if self.tok.kind == "id" and not self.on("("):
            self.name()
        elif statement and not nameless:
            self.fail("expected the name of a function")
        self.signature_and_body(asyn, gen, may_lack_body=self.typed and statement)

    def signature_and_body(self, asyn: bool, gen: bool, may_lack_body: bool = False) -> None:
        self.type_parameters()
        old = self.enter(asyn, gen)
        self.parameters()
        self.return_type()
        if may_lack_body and not self.on("{"):
            self.semicolon()
        else:
            self.block()
        self.restore(old)

    def enter(self, asyn: bool, gen: bool):
        old = self.state()
        self.fn, self.asyn, self.gen = True, asyn, gen
        self.loops = self.switches = 0
        self.labels, self.no_in, self.no_conditional_type, self.ambient = [], False, False, False
        return old

    def return_type(self) -> None:
        if self.typed and self.take(":"):
            self.predicate_or_type()

    def parameters(self) -> None:
        self.need("(")
        while not self.on(")"):
            if self.on("@"):
                self.decorators()
            if self.take("..."):
                self.parameter(rest=True)
                if self.on(","):
                    self.fail("a parameter after the rest")
                break
            self.parameter()
            if not self.take(","):
                break
        self.need(")")

    def parameter(self, rest: bool = False) -> None:
        if self.typed:
            while self.word("public", "private", "protected", "readonly", "override") and (self.ahead().kind == "id" or self.ahead().text in ("{", "[")):
                self.step()
            if self.word("this"):
                self.step()
            else:
                self.binding()
            self.take("?")
            if self.take(":"):
                self.type()
        else:
            self.binding()
        if not rest and self.take("="):
            self.assignment()

    def binding(self) -> None:
        self.deeper()
        if self.take("["):
            while not self.on("]"):
                if self.take(","):
                    continue
                if self.take("..."):
                    self.binding()
                    break
                self.binding()
                if self.take("="):
                    self.assignment()
                if not self.on("]"):
                    self.need(",")
            self.need("]")
        elif self.take("{"):
            while not self.on("}"):
                if self.take("..."):
                    self.name()
                    break
                short = self.tok.kind == "id"
                reserved = short and (self.tok.text in RESERVED or (self.tok.text in STRICT and not self.typed))
                self.property_name()
                if self.take(":"):
                    self.binding()
                elif not short or reserved:
                    self.fail("expected ':'")
                if self.take("="):
                    self.assignment()
                if not self.take(","):
                    break
            self.need("}")
        else:
            self.name()
        self.depth -= 1

    def decorators(self) -> None:
        while self.take("@"):
            if self.on("("):
                self.paren()
                continue
            self.any_name()
            while self.take("."):
                self.any_name()
            if self.typed and self.on("<"):
                self.guess(self.type_arguments)
            if self.on("("):
                self.arguments()

    def klass(self, statement: bool, nameless: bool = False) -> None:
        self.need("class")
        if self.tok.kind == "id" and not self.word("extends") and not (self.typed and self.word("implements") and not statement):
            self.name()
        elif statement and not nameless:
            self.fail("expected the name of a class")
        self.type_parameters()
        if self.take("extends"):
            self.unary_tail(head=True)
            if self.typed and self.on("<"):
                self.type_arguments()
        if self.typed and self.take("implements"):
            self.type_list()
        self.need("{")
        while not self.on("}"):
            if self.tok.kind == "end":
                self.fail("expected '}'")
            if self.take(";"):
                continue
            self.member()
        self.need("}")

    def member(self) -> None:
        self.deeper()
        if self.on("@"):
            self.decorators()
        modifiers = ("static", "async", "get", "set", "accessor") + (("public", "private", "protected", "readonly", "abstract", "override", "declare") if self.typed else ())
        asyn = gen = False
        accessor = ""
        loose = self.ambient
        while self.tok.kind == "id" and self.tok.text in modifiers:
            y = self.ahead()
            if y.kind == "op" and y.text in ("(", "=", ";", "}", "?", "!", ":", "<", ",") or y.kind == "end":
                break
            if self.tok.text == "static" and y.text == "{":
                self.step()
                old = self.enter(False, False)
                self.block()
                self.restore(old)
                self.depth -= 1
                return
            if y.nl and self.tok.text in ("async", "get", "set", "accessor", "declare", "abstract") and self.tok.text not in ("get", "set"):
                break
            if y.text == "{":
                break
            w = self.step().text
            asyn = asyn or w == "async"
            accessor = w if w in ("get", "set") else accessor
            loose = loose or w == "abstract"
        if self.take("*"):
            gen = True
        if self.typed and self.on("[") and self.index_signature():
            self.semicolon_type()
            self.depth -= 1
            return
        self.property_name(private=True)
        if self.typed and not self.take("?"):
            self.take("!")
        if self.on("(", "<") and (self.typed or self.on("(")):
            self.signature_and_body(asyn, gen, may_lack_body=self.typed)
        elif gen or asyn or accessor:
            self.fail("expected parameters")
        else:
            if self.typed and self.take(":"):
                self.type()
            if self.take("="):
                old = self.enter(False, False)
                self.assignment()
                self.restore(old)
            self.semicolon()
        self.depth -= 1

    def property_name(self, private: bool = False) -> None:
        k = self.tok.kind
        if k in ("id", "str", "num") or (private and k == "priv"):
            self.step()
        elif self.take("["):
            old, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = old
            self.need("]")
        else:
            self.fail("expected the name of a property")

    # --- expressions ---
    def expression(self, cover: bool = False) -> str:
        kind = self.assignment(cover)
        while self.take(","):
            self.assignment()
            kind = "other"
        return kind

    def no_cover(self) -> None:
        if self.cover is not None:
            line, self.cover = self.cover, None
            raise Fault("a default outside a pattern", line)

    def arrow_ahead(self) -> bool:
        """Whether a parenthesis opens the parameters of an arrow function (without types)."""
        level, j, t = 0, self.i, self.t
        while j < len(t):
            x = t[j]
            if x.kind == "op":
                if x.text in ("(", "[", "{"):
                    level += 1
                elif x.text in (")", "]", "}"):
                    level -= 1
                    if level == 0:
                        y = t[min(j + 1, len(t) - 1)]
                        return (y.text == "=>" and not y.nl) or (self.typed and y.text == ":")
            elif x.kind == "end":
                return False
            j += 1
        return False

    def arrow(self, asyn: bool) -> None:
        old = self.enter(asyn, False)
        self.no_in = old[6]
        if self.typed and self.on("<"):
            self.type_parameters()
        if self.on("("):
            self.parameters()
            self.return_type()
        else:
            self.name()
        if not self.on("=>") or self.tok.nl:
            self.fail("expected '=>'")
        self.step()
        self.arrow_old = old

    def arrow_rest(self) -> None:
        """The body of an arrow function whose head has been read."""
        old = self.arrow_old
        if self.on("{"):
            self.no_in = False
            self.block()
        else:
            self.assignment()
        self.restore(old)

    def try_arrow(self, asyn: bool, sure: bool) -> bool:
        state, place, depth = self.state(), self.i, self.depth
        if sure:
            self.arrow(asyn)
            self.arrow_rest()
            return True
        try:
            self.arrow(asyn)
        except Fault:
            self.restore(state)
            self.back(place)
            self.depth = depth
            return False
        self.arrow_rest()
        return True

    def assignment(self, cover: bool = False) -> str:
        self.deeper()
        kind = self._assignment(cover)
        self.depth -= 1
        return kind

    def _assignment(self, cover: bool) -> str:
        x, y = self.tok, self.ahead()
        if x.kind == "id":
            if x.text == "async" and not y.nl:
                if y.kind == "id" and self.ahead(2).text == "=>" and y.text not in RESERVED:
                    self.step()
                    self.try_arrow(True, True)
                    return "other"
                if y.text == "(" or (self.typed and y.text == "<"):
                    place = self.i
                    self.step()
                    if y.text == "(" and not self.typed:
                        if self.arrow_ahead():
                            self.try_arrow(True, True)
                            return "other"
                    elif (y.text == "<" or self.arrow_ahead()) and self.try_arrow(True, False):
                        return "other"
                    self.back(place)
            if y.text == "=>" and not y.nl and x.text not in RESERVED:
                self.try_arrow(False, True)
                return "other"
            if x.text == "yield" and self.gen:
                self.step()
                if not self.tok.nl:
                    if self.take("*"):
                        self.assignment()
                    elif not (self.on(")", "]", "}", ",", ";", ":") or self.tok.kind == "end" or self.word("in", "of")):
                        self.assignment()
                return "other"
        elif x.kind == "op":
            if x.text == "(" and self.arrow_ahead():
                if self.typed:
                    if self.try_arrow(False, False):
                        return "other"
                else:
                    self.try_arrow(False, True)
                    return "other"
            elif x.text == "<" and self.typed and self.try_arrow(False, False):
                return "other"
        outer, self.cover = self.cover, None
        line = self.tok.line
        kind = self.conditional()
        op = self.assign_operator()
        if op:
            if op == "=":
                self.cover = None
                if kind not in ("id", "mem", "arr", "obj"):
                    raise Fault("can't be assigned to", line)
            elif kind not in ("id", "mem"):
                raise Fault("can't be assigned to", line)
            self.cover = outer
            self.assignment()
            return "other" if kind in ("id", "mem") else "assigned"
        if not cover:
            self.no_cover()
            self.cover = outer
        return kind

    def assign_operator(self) -> str:
        x = self.tok
        if x.kind != "op":
            return ""
        if x.text in ASSIGN:
            return self.step().text
        if x.text == ">":
            j = self.i
            while self.t[j].text == ">" and self.t[j + 1].at == self.t[j].at + 1 and j < self.i + 3:
                j += 1
                if self.t[j].text == "=" and j >= self.i + 2:
                    self.back(j + 1)
                    return ">>="
                if self.t[j].text != ">":
                    break
        return ""

    def conditional(self) -> str:
        kind = self.binary(1)
        if self.on("?"):
            self.step()
            old, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = old
            self.need(":")
            self.assignment()
            return "other"
        return kind

    def operator(self) -> tuple[str, int, int]:
        """The binary operator here, its strength and how many tokens it takes."""
        x = self.tok
        if x.kind == "op":
            if x.text == ">":
                t, i = self.t, self.i
                a, b = t[i + 1] if i + 1 < len(t) else x, t[i + 2] if i + 2 < len(t) else x
                near = a.at == x.at + 1
                if near and a.text == ">":
                    third = b.at == a.at + 1
                    if third and b.text == ">":
                        c = t[i + 3]
                        return ("", 0, 0) if c.at == b.at + 1 and c.text == "=" else (">>>", 9, 3)
                    return ("", 0, 0) if third and b.text == "=" else (">>", 9, 2)
                if near and a.text == "=":
                    return ">=", 8, 2
                return ">", 8, 1
            return x.text, BINARY.get(x.text, 0), 1
        if x.kind == "id":
            if x.text == "instanceof" or (x.text == "in" and not self.no_in):
                return x.text, 8, 1
            if self.typed and x.text in ("as", "satisfies") and not x.nl:
                return x.text, 8, 1
        return "", 0, 0

    def binary(self, least: int) -> str:
        """Precedence climbing."""
        if self.tok.kind == "priv" and self.ahead().text == "in":
            self.step()
            kind = "other"
        else:
            kind = self.unary()
        mixed = ""
        while True:
            op, strength, size = self.operator()
            if strength < least or not strength:
                return kind
            if op in ("as", "satisfies"):
                self.step()
                if not (self.word("const") and self.step()):
                    self.type()
                kind = kind if kind in ("id", "mem") else "other"
                continue
            if op in ("??", "||", "&&"):
                group = "??" if op == "??" else "||"
                if mixed and mixed != group:
                    self.fail("?? mixed with another logical operator")
                mixed = group
            if op == "**" and kind == "unary":
                self.fail("a unary operand of **")
            for _ in range(size):
                self.step()
            self.deeper()
            right = self.binary(strength if op == "**" else strength + 1)
            self.depth -= 1
            if op == "??" and right == "logical":
                self.fail("?? mixed with another logical operator")
            kind = "logical" if op in ("||", "&&") else "other"

    def unary(self) -> str:
        x = self.tok
        if (x.kind == "op" and x.text in ("+", "-", "~", "!")) or (x.kind == "id" and x.text in ("typeof", "void", "delete")):
            self.step()
            self.deeper()
            self.unary()
            self.depth -= 1
            return "unary"
        if x.kind == "id" and x.text == "await":
            if not self.asyn and not self.typed:
                self.fail("await outside an async function")
            if self.asyn or self.ahead().kind in ("id", "str", "num", "tpl") or self.ahead().text in ("(", "[", "{"):
                self.step()
                self.deeper()
                self.unary()
                self.depth -= 1
                return "unary"
        if x.kind == "op" and x.text in ("++", "--"):
            self.step()
            line = self.tok.line
            if self.unary() not in ("id", "mem"):
                raise Fault("can't be incremented", line)
            return "unary"
        if self.typed and x.text == "<" and x.kind == "op":
            self.step()
            if not (self.word("const") and self.ahead().text == ">" and self.step()):
                self.type()
            self.need(">")
            self.unary()
            return "other"
        line = x.line
        kind = self.unary_tail()
        if self.tok.kind == "op" and self.tok.text in ("++", "--") and not self.tok.nl:
            if kind not in ("id", "mem"):
                raise Fault("can't be incremented", line)
            self.step()
            return "other"
        return kind

    def arguments(self) -> None:
        self.need("(")
        old, self.no_in = self.no_in, False
        while not self.on(")"):
            self.take("...")
            self.assignment()
            if not self.take(","):
                break
        self.no_in = old
        self.need(")")

    def unary_tail(self, head: bool = False, new: bool = False) -> str:
        """A primary with what follows it; ``new``: the callee of new."""
        kind = self.primary()
        chain = False
        while True:
            x = self.tok
            if x.kind == "tpl":
                if chain:
                    self.fail("a template in an optional chain")
                self.templates()
                kind = "other"
                continue
            if x.kind != "op":
                return kind
            if x.text == ".":
                self.step()
                if self.tok.kind not in ("id", "priv"):
                    self.fail("expected the name of a member")
                self.step()
                kind = "chain" if chain else "mem"
            elif x.text == "?.":
                if new:
                    self.fail("an optional chain after new")
                self.step()
                chain, kind = True, "chain"
                if self.on("("):
                    self.arguments()
                elif self.take("["):
                    self.expression()
                    self.need("]")
                elif self.typed and self.on("<"):
                    self.type_arguments()
                    self.arguments()
                else:
                    if self.tok.kind not in ("id", "priv"):
                        self.fail("expected the name of a member")
                    self.step()
            elif x.text == "[":
                self.step()
                old, self.no_in = self.no_in, False
                self.expression()
                self.no_in = old
                self.need("]")
                kind = "chain" if chain else "mem"
            elif x.text == "(" and not new:
                self.arguments()
                kind = "call"
            elif self.typed and x.text == "!" and not x.nl:
                self.step()
            elif self.typed and x.text == "<" and kind in ("id", "mem", "chain", "call", "other"):
                place = self.i
                if self.guess(self.type_arguments) and (self.on("(") or self.tok.kind == "tpl" or self.on(")", "]", ",", ";", ":", "}", ".", "?.", "=") or self.tok.kind == "end" or self.tok.nl):
                    if new:
                        return kind
                    continue
                self.back(place)
                return kind
            else:
                return kind

    def templates(self) -> None:
        x = self.step()
        for part, line in x.parts or ():
            inner = Script(lex(part, line), self.typed)
            inner.restore(self.state())
            inner.depth, inner.no_in = self.depth + 1, False
            inner.expression()
            if inner.tok.kind != "end":
                inner.fail("expected the end of the expression")

    def primary(self) -> str:
        x = self.tok
        k = x.kind
        if k == "id":
            w = x.text
            if w == "function" or (w == "async" and self.ahead().text == "function" and not self.ahead().nl):
                self.function(False)
                return "other"
            if w == "class":
                self.klass(False)
                return "other"
            if w == "new":
                return self.new()
            if w in ("this", "null", "true", "false"):
                self.step()
                return "other"
            if w == "super":
                self.step()
                if not self.on("(", ".", "["):
                    self.fail("super alone")
                return "other"
            if w == "import":
                self.step()
                if self.take("."):
                    self.any_name()
                elif not self.on("("):
                    self.fail("import inside an expression")
                return "other"
            self.name()
            return "id"
        if k in ("num", "str", "re"):
            self.step()
            return "other"
        if k == "tpl":
            self.templates()
            return "other"
        if k == "op":
            if x.text == "(":
                self.step()
                old, self.no_in = self.no_in, False
                kind = self.expression()
                self.no_in = old
                self.need(")")
                return kind if kind in ("id", "mem") else "other"
            if x.text == "[":
                self.step()
                old, self.no_in = self.no_in, False
                cover = self.cover
                while not self.on("]"):
                    if self.take(","):
                        continue
                    self.take("...")
                    self.assignment(cover=True)
                    cover, self.cover = self.cover if self.cover is not None else cover, None
                    if not self.on("]"):
                        self.need(",")
                self.cover = cover
                self.no_in = old
                self.need("]")
                return "arr"
            if x.text == "{":
                return self.object()
            if x.text == "@":
                self.decorators()
                self.klass(False)
                return "other"
        return self.fail("expected an expression")

    def new(self) -> str:
        self.need("new")
        if self.take("."):
            self.any_name()
            return "other"
        self.deeper()
        if self.word("new"):
            self.new()
        else:
            if self.word("import"):
                self.fail("import after new")
            self.unary_tail(new=True)
        self.depth -= 1
        if self.on("("):
            self.arguments()
        return "call"

    def object(self) -> str:
        self.need("{")
        old, self.no_in = self.no_in, False
        cover = self.cover
        while not self.on("}"):
            if self.take("..."):
                self.assignment()
            else:
                x, y = self.tok, self.ahead()
                asyn = gen = False
                if x.kind == "id" and x.text in ("get", "set", "async") and not (y.kind == "op" and y.text in (",", ":", "(", "}", "=", "<") or y.kind == "end"):
                    self.step()
                    asyn = x.text == "async"
                    if asyn and self.take("*"):
                        gen = True
                    self.property_name()
                    self.signature_and_body(asyn, gen)
                elif self.take("*"):
                    self.property_name()
                    self.signature_and_body(False, True)
                else:
                    self.property_name()
                    if self.on("(") or (self.typed and self.on("<")):
                        self.signature_and_body(False, False)
                    elif self.take(":"):
                        self.assignment(cover=True)
                        cover, self.cover = self.cover if self.cover is not None else cover, None
                    elif x.kind != "id" or x.text in RESERVED or (x.text in STRICT and not self.typed):
                        self.fail("expected ':'")
                    elif self.on("="):
                        cover = self.tok.line
                        self.step()
                        self.assignment()
            if not self.take(","):
                break
        self.no_in = old
        self.cover = cover
        self.need("}")
        return "obj"

    # --- types ---
    def type_parameters(self) -> None:
        if not (self.typed and self.on("<")):
            return
        self.need("<")
        while not self.on(">"):
            while self.word("const", "in", "out") and self.ahead().kind == "id" and self.ahead().text != "extends":
                self.step()
            self.name()
            if self.take("extends"):
                self.type()
            if self.take("="):
                self.type()
            if not self.take(","):
                break
        self.need(">")

    def type_arguments(self) -> None:
        self.need("<")
        self.type()
        while self.take(","):
            if self.on(">"):
                break
            self.type()
        self.need(">")

    def type_list(self) -> None:
        self.type()
        while self.take(","):
            self.type()

    def predicate_or_type(self) -> None:
        if self.word("asserts") and self.ahead().kind == "id" and not self.ahead().nl and self.ahead().text != "is":
            self.step()
            self.any_name()
            if self.take("is"):
                self.type()
            return
        if self.tok.kind == "id" and self.ahead().text == "is" and self.ahead().kind == "id" and not self.ahead().nl:
            self.step()
            self.step()
        self.type()

    def type(self) -> None:
        self.deeper()
        self._type()
        self.depth -= 1

    def _type(self) -> None:
        if self.word("new") or (self.word("abstract") and self.ahead().text == "new"):
            self.take("abstract")
            self.step()
            self.type_parameters()
            self.parameters()
            self.need("=>")
            return self.predicate_or_type()
        if self.on("<") or (self.on("(") and self.arrow_ahead()):
            if self.on("<") or self.function_type_ahead():
                self.type_parameters()
                self.parameters()
                self.need("=>")
                return self.predicate_or_type()
        self.union()
        if self.word("extends") and not self.no_conditional_type and not self.tok.nl:
            self.step()
            old, self.no_conditional_type = self.no_conditional_type, True
            self.type()
            self.no_conditional_type = False
            self.need("?")
            self.type()
            self.need(":")
            self.type()
            self.no_conditional_type = old
        return None

    def function_type_ahead(self) -> bool:
        level, j, t = 0, self.i, self.t
        while t[j].kind != "end":
            if t[j].kind == "op":
                if t[j].text in ("(", "[", "{"):
                    level += 1
                elif t[j].text in (")", "]", "}"):
                    level -= 1
                    if level == 0:
                        return t[j + 1].text == "=>"
            j += 1
        return False

    def union(self) -> None:
        self.take("|")
        self.take("&")
        self.type_operator()
        while self.on("|", "&"):
            self.step()
            if self.on("<") or (self.on("(") and self.function_type_ahead()):
                self.type()
            else:
                self.type_operator()

    def type_operator(self) -> None:
        if self.word("keyof", "unique", "readonly") and (self.ahead().kind in ("id", "str", "tpl", "num") or self.ahead().text in ("(", "{", "[")) and self.ahead().text not in ("extends",):
            self.step()
            return self.type_operator()
        if self.word("infer") and self.ahead().kind == "id":
            self.step()
            self.name()
            if self.word("extends"):
                place = self.i
                self.step()
                old, self.no_conditional_type = self.no_conditional_type, True
                self.type()
                self.no_conditional_type = old
                if self.on("?") and not old:
                    self.back(place)
            return None
        self.primary_type()
        while self.on("[") and not self.tok.nl:
            self.step()
            if not self.on("]"):
                old, self.no_conditional_type = self.no_conditional_type, False
                self.type()
                self.no_conditional_type = old
            self.need("]")
        return None

    def primary_type(self) -> None:
        x = self.tok
        if x.kind in ("str", "num"):
            self.step()
        elif x.kind == "tpl":
            self.step()
            for part, line in x.parts or ():
                inner = Script(lex(part, line), True)
                inner.depth = self.depth + 1
                inner.type()
                if inner.tok.kind != "end":
                    inner.fail("expected the end of the type")
        elif x.kind == "op" and x.text == "-":
            self.step()
            if self.tok.kind != "num":
                self.fail("expected a number")
            self.step()
        elif x.kind == "op" and x.text == "(":
            self.step()
            old, self.no_conditional_type = self.no_conditional_type, False
            self.type()
            self.no_conditional_type = old
            self.need(")")
        elif x.kind == "op" and x.text == "[":
            self.tuple()
        elif x.kind == "op" and x.text == "{":
            self.object_type()
        elif x.kind == "id":
            if x.text == "typeof":
                self.step()
                if self.word("import"):
                    self.step()
                    self.need("(")
                    self.type()
                    self.need(")")
                else:
                    self.any_name()
                while self.take("."):
                    if self.tok.kind not in ("id", "priv"):
                        self.fail("expected a name")
                    self.step()
                if self.on("<") and not self.tok.nl:
                    self.type_arguments()
                return
            if x.text == "import":
                self.step()
                self.need("(")
                self.type()
                self.need(")")
            elif x.text in RESERVED and x.text not in ("void", "null", "true", "false", "this"):
                self.fail("expected a type")
            else:
                self.step()
            while self.take("."):
                self.any_name()
            if self.on("<") and not self.tok.nl:
                self.type_arguments()
        else:
            self.fail("expected a type")

    def tuple(self) -> None:
        self.need("[")
        old, self.no_conditional_type = self.no_conditional_type, False
        while not self.on("]"):
            self.take("...")
            if self.tok.kind == "id" and (self.ahead().text == ":" or (self.ahead().text == "?" and self.ahead(2).text == ":")):
                self.step()
                self.take("?")
                self.need(":")
            self.type()
            self.take("?")
            if not self.take(","):
                break
        self.no_conditional_type = old
        self.need("]")

    def semicolon_type(self) -> None:
        if self.take(";") or self.take(",") or self.on("}") or self.tok.nl:
            return
        self.fail("expected ';'")

    def index_signature(self) -> bool:
        """``[k: T]: U`` of a class or object type."""
        if self.ahead().kind == "id" and self.ahead(2).text == ":":
            self.step()
            self.step()
            self.step()
            self.type()
            self.need("]")
            self.need(":")
            self.type()
            return True
        return False

    def object_type(self) -> None:
        self.need("{")
        old, self.no_conditional_type = self.no_conditional_type, False
        while not self.on("}"):
            self.type_member()
            self.semicolon_type()
        self.no_conditional_type = old
        self.need("}")

    def type_member(self) -> None:
        if self.on("(", "<"):
            self.type_parameters()
            self.parameters()
            return self.return_type()
        if self.word("new") and self.ahead().text in ("(", "<"):
            self.step()
            self.type_parameters()
            self.parameters()
            return self.return_type()
        while self.on("+", "-"):
            self.step()
        while self.word("readonly", "get", "set") and (self.ahead().kind in ("id", "str", "num", "priv") or self.ahead().text == "["):
            self.step()
        if self.on("["):
            if self.index_signature():
                return None
            if self.ahead().kind == "id" and self.ahead(2).text == "in":
                self.step()
                self.name()
                self.step()
                self.type()
                if self.take("as"):
                    self.type()
                self.need("]")
                while self.on("+", "-"):
                    self.step()
                self.take("?")
                if self.take(":"):
                    self.type()
                return None
        self.property_name(private=True)
        self.take("?")
        if self.on("(", "<"):
            self.type_parameters()
            self.parameters()
        return self.return_type()

    def enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")
        while not self.on("}"):
            self.property_name()
            if self.take("="):
                self.assignment()
            if not self.take(","):
                break
        self.need("}")


def check(text: str, typed: bool, errors: list) -> list[tuple[int, str]]:
    return checked(text, lex, lambda tokens: Script(tokens, typed), errors)
