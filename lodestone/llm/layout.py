"""Lexing any source file of six languages and comparing its layout with a canonical one."""

from __future__ import annotations

import re
from collections import Counter

_C_COMMENT = r"//[^\n\r]*|/\*[\s\S]*?(?:\*/|\Z)"
_STRINGS = r"\"(?:[^\"\\\n\r]|\\[\s\S])*(?:\"|$)|'(?:[^'\\\n\r]|\\[\s\S])*(?:'|$)"
_NUMBER = r"0[xXbBoO][\da-fA-F_]+|(?:\d[\d_]*\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[a-zA-Z]{0,2}"
_PUNCT = r"[+\-*/%&|^=<>!?:.]{2,3}|[^\s\w]"


def _lexer(comment: str, strings: str, word: str = r"[^\W\d]\w*") -> re.Pattern:
    return re.compile(rf"(?P<comment>{comment})|(?P<str>{strings})|(?P<num>{_NUMBER})|(?P<word>{word})|(?P<op>{_PUNCT})|(?P<nl>\r\n|\n|\r)|(?P<ws>[^\S\n\r]+)", re.M)


_BRACES = _lexer(_C_COMMENT, r"`(?:[^`\\]|\\[\s\S])*(?:`|\Z)|" + _STRINGS, r"[^\W\d][\w$]*|\$[\w$]*")
#: Lexers by extension.
LEXERS = {
    "js": _BRACES,
    "ts": _BRACES,
    "java": _lexer(_C_COMMENT, r"\"\"\"[\s\S]*?(?:\"\"\"|\Z)|" + _STRINGS),
    "go": _lexer(_C_COMMENT, r"`[^`]*(?:`|\Z)|" + _STRINGS),
    "css": _lexer(r"/\*[\s\S]*?(?:\*/|\Z)", _STRINGS, r"-{0,2}[^\W\d][\w-]*|#[\w-]+"),
    "py": _lexer(r"#[^\n\r]*", r"\"\"\"(?:[^\\]|\\[\s\S])*?(?:\"\"\"|\Z)|'''(?:[^\\]|\\[\s\S])*?(?:'''|\Z)|" + _STRINGS),
}
#: Columns of a canonical line.
WIDTH = 80
DIGITS = re.compile(r"\d+")


class Layout:
    """What the comparison of a file with its canonical form gives.

    ``lines``: with code, as they are. ``canonical``: lines of the canonical form. ``expansion``: their ratio.
    ``uniformity``: share of the canonical lines whose shape (numbers put aside) occurs ``REPEATS`` times or more.
    ``literal``: share of the characters of code that are literals. ``tight``: share of operators without a blank beside
    them. ``comments``: texts of the comments in order. ``words``: words of the code in order.
    """

    REPEATS = 5

    def __init__(self, text: str, extension: str):
        lexer = LEXERS[extension]
        braces = extension != "py"
        self.comments: list[str] = []
        self.words: list[str] = []
        shapes: Counter[str] = Counter()
        statement: list[str] = []
        code = literal = size = depth = 0
        self.canonical = 0
        lines, here, spaced, operators, before = 0, False, 0, 0, "nl"
        self.longest_literal_run = run = 0
        kinds: set[str] = set()

        def emit() -> None:
            nonlocal size
            if statement:
                self.canonical += max(1, -(-size // WIDTH))
                shapes[" ".join(statement)] += 1
                statement.clear()
                size = 0

        for m in lexer.finditer(text):
            kind, x = m.lastgroup, m.group()
            if kind == "nl":
                lines += here
                here = False
                if not braces and depth == 0:
                    emit()
            elif kind == "comment":
                self.comments.append(x)
            elif kind == "ws":
                if before == "op":
                    spaced += 1
                before = "ws"
                continue
            else:
                if not here and kind == "str" and ("\n" in x or "\r" in x):
                    lines += len(re.findall(r"\r\n|\n|\r", x))
                here = True
                code += len(x)
                size += len(x) + 1
                if kind == "str" or kind == "num":
                    literal += len(x)
                    run += 1
                    self.longest_literal_run = max(self.longest_literal_run, run)
                    statement.append("0" if kind == "num" else "''")
                else:
                    if kind == "word":
                        self.words.append(x)
                        run = 0
                        statement.append(DIGITS.sub("0", x))
                    else:
                        statement.append(x)
                        operators += 1
                        if before == "ws":
                            spaced += 1
                        if x in "([":
                            depth += 1
                            if x == "(":
                                run = 0
                        elif x in ")]":
                            depth = max(0, depth - 1)
                        if not braces and x == "{":
                            depth += 1
                        elif not braces and x == "}":
                            depth = max(0, depth - 1)
                        elif braces and (x in "{}" or (x == ";" and depth == 0)):
                            emit()
                kinds.add(kind)
            before = kind
        lines += here
        emit()
        self.lines = lines
        self.expansion = self.canonical / lines if lines else 0.0
        total = sum(shapes.values())
        plain = {s for s in shapes if len(s) > 1}
        named = sum(shapes[s] for s in plain)
        self.uniformity = sum(shapes[s] for s in plain if shapes[s] >= self.REPEATS) / named if named else 0.0
        self.statements = total
        self.literal = literal / code if code else 0.0
        self.tight = 1 - min(1.0, spaced / (2 * operators)) if operators else 0.0
        self.code = code
