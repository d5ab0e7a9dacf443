"""What the parsers share: tokens, the fault that ends a statement, and panic-mode recovery."""

from __future__ import annotations

import re
from dataclasses import dataclass

#: Nested constructs from which a text is refused, as compilers do at their own limits.
DEEPEST = 3000


class Fault(Exception):
    """A syntax error: message and line."""

    def __init__(self, message: str, line: int):
        super().__init__(message)
        self.message, self.line = message, line


class Deep(Exception):
    """The text is nested too deeply."""


class OnlyFirst(list):
    """Errors of a text for which only whether there are any is asked."""

    class Found(Exception):
        pass

    def append(self, error) -> None:
        raise OnlyFirst.Found


@dataclass(slots=True)
class Token:
    kind: str  # id, num, str, chr, tpl, re, op, nl, end and what a language adds
    text: str
    line: int
    at: int  # offset of its first character
    nl: bool = False  # a line ends before it
    parts: list | None = None  # texts of the expressions inside a template

    @property
    def end(self) -> int:
        return self.at + len(self.text)


class Cut:
    """Stands for all tokens behind the part of a text that has been lexed. To look at it is to need more of the text."""

    class Reached(Exception):
        pass

    def __getattr__(self, name: str):
        raise Cut.Reached


def fails_early(text: str, lex, parser, size: int) -> bool:
    """Whether an error shows in the first ``size`` characters, whatever follows them.

    The last tokens may be others once the text goes on, and so are cut off. An error that the parser finds without having
    looked at the cut is an error of the whole text. False tells nothing.
    """
    end = text.find("\n", size)
    try:
        tokens = lex(text[:end]) if 0 <= end < len(text) else []
    except Fault:
        return False
    while tokens and tokens[-1].kind in ("end", "nl", "dedent", "indent"):
        tokens.pop()
    if len(tokens) < 8:
        return False
    try:
        parse = parser([*tokens[:-4], Cut()])
        parse.errors = OnlyFirst()
        parse.run()
    except OnlyFirst.Found:
        return True
    except (Cut.Reached, RecursionError):
        pass
    return False


_LINE_END = re.compile(r"[\n\r]|\Z")
_WORD = re.compile(r"\w*")


def missed(text: str, at: int, fault: Fault, errors: list | None, out: list[Token], nl: bool) -> int:
    """Record a lexical error at ``at`` and go on behind it: behind the line for what has no end, else behind the word or sign.

    A literal leaves a token of its kind, so that the parser doesn't find the same fault again. Without ``errors`` the
    fault is raised.
    """
    if errors is None:
        raise fault
    errors.append((fault.line, fault.message))
    if at >= len(text):
        return at
    if "comment" in fault.message:
        return len(text)
    for word, kind in (("string", "str"), ("character literal", "chr"), ("regular", "re"), ("template", "tpl"), ("bytes", "str")):
        if word in fault.message:
            end = _LINE_END.search(text, at).start()
            out.append(Token(kind, text[at:end], fault.line, at, nl, []))
            return max(end, at + 1)
    if "number" in fault.message:
        end = _WORD.match(text, at).end()
        out.append(Token("num", text[at:end], fault.line, at, nl))
        return max(end, at + 1)
    return at if "indentation" in fault.message else at + 1


def checked(text: str, lex, parser, errors: list) -> list[tuple[int, str]]:
    """All errors of a text, lexical and syntactic, in the order of their lines."""
    tokens = lex(text, errors=errors)
    parse = parser(tokens)
    parse.errors = errors
    return sorted(parse.run(), key=lambda e: e[0])


class Parser:
    """Recursive descent over a list of tokens that ends in one of kind ``end``."""

    def __init__(self, tokens: list[Token]):
        self.t, self.i = tokens, 0
        self.tok = tokens[0]
        self.errors: list[tuple[int, str]] = []
        self.depth = 0

    # moving
    def step(self) -> Token:
        old = self.tok
        if old.kind != "end":
            self.i += 1
            self.tok = self.t[self.i]
        return old

    def ahead(self, n: int = 1) -> Token:
        return self.t[min(self.i + n, len(self.t) - 1)]

    def back(self, place: int) -> None:
        self.i = place
        self.tok = self.t[place]

    def on(self, *texts: str) -> bool:
        return self.tok.text in texts and self.tok.kind in ("op", "id")

    def take(self, text: str) -> bool:
        if self.tok.text == text and self.tok.kind in ("op", "id"):
            self.step()
            return True
        return False

    def need(self, text: str) -> Token:
        if self.tok.text == text and self.tok.kind in ("op", "id"):
            return self.step()
        self.fail(f"expected '{text}'")

    def fail(self, message: str):
        found = "the end of the text" if self.tok.kind == "end" else f"'{self.tok.text[:20]}'"
        raise Fault(f"{message}, found {found}", self.tok.line)

    def deeper(self) -> None:
        self.depth += 1
        if self.depth > DEEPEST:
            raise Deep

    def guess(self, parse):
        """The result of ``parse`` (true), or false with the place kept where it fails."""
        place, depth = self.i, self.depth
        try:
            return parse() or True
        except Fault:
            self.back(place)
            self.depth = depth
            return False

    # recovery
    STARTS: frozenset = frozenset()

    def recover(self, fault: Fault, begin: int) -> None:
        """Record the fault and skip to behind a ``;``, or to a closing brace or a word that starts a statement."""
        self.errors.append((fault.line, fault.message))
        if self.i == begin:
            self.step()
        level = 0
        while self.tok.kind != "end":
            x = self.tok
            if x.kind == "op":
                if x.text in ("{", "(", "["):
                    level += 1
                elif x.text in ("}", ")", "]"):
                    if level == 0 and x.text == "}":
                        return
                    level = max(0, level - 1)
                elif x.text == ";" and level == 0:
                    self.step()
                    return
            elif level == 0 and x.kind == "id" and x.text in self.STARTS and x.nl:
                return
            self.step()

    def run(self) -> list[tuple[int, str]]:
        """Parse the whole text; all errors, in order. A place nested too deeply is the last."""
        while self.tok.kind != "end":
            begin, depth = self.i, self.depth
            try:
                self.top()
            except Fault as fault:
                self.depth = depth
                self.recover(fault, begin)
                if self.on("}"):
                    self.step()
            except (Deep, RecursionError):
                self.errors.append((self.tok.line, "nested too deeply"))
                break
        return self.errors

    def top(self) -> None:
        raise NotImplementedError
