"""Parsers for six languages: recursive descent over statements, precedence climbing for expressions, panic-mode recovery.

``check(text, language)`` gives all errors of a text as (line, message), in order; an empty list means it is valid. A lexical
error is recorded like any other, and lexing goes on behind it. ``accepts`` only tells whether there are none. Names and
types aren't resolved. A text nested deeper than ``base.DEEPEST`` is refused with an error that says so; JSON has no such
bound, and Python has CPython's.
"""

from __future__ import annotations

import sys

from lodestone.llm.syntax import go_text, java_text, json_text, python_text, script
from lodestone.llm.syntax.base import OnlyFirst, fails_early

LANGUAGES = {
    "python": python_text.check,
    "javascript": lambda text, errors: script.check(text, False, errors),
    "typescript": lambda text, errors: script.check(text, True, errors),
    "java": java_text.check,
    "go": go_text.check,
    "json": json_text.check,
}
#: Lexer and parser of those whose errors may show in the first lines.
EARLY = {
    "python": (python_text.lex, python_text.Python),
    "javascript": (script.lex, lambda tokens: script.Script(tokens, False)),
    "typescript": (script.lex, lambda tokens: script.Script(tokens, True)),
    "java": (java_text.lex, java_text.Java),
    "go": (go_text.lex, go_text.Go),
}
#: Frames for ``base.DEEPEST`` nested constructs; Python keeps them on the heap.
FRAMES = 150_000


def check(text: str, language: str, errors: list | None = None) -> list[tuple[int, str]]:
    if sys.getrecursionlimit() < FRAMES:
        sys.setrecursionlimit(FRAMES)
    errors = [] if errors is None else errors
    try:
        return LANGUAGES[language](text, errors)
    except RecursionError:  # inside the texts of a template
        errors.append((1, "nested too deeply"))
        return errors


def accepts(text: str, language: str) -> bool:
    """Whether ``check`` finds no error. Most texts of another language fail in their first lines, which are tried alone first."""
    if language in EARLY and len(text) > 600 and "\r" not in text and "\x00" not in text and fails_early(text, *EARLY[language], 200):
        return False
    try:
        return not check(text, language, OnlyFirst())
    except OnlyFirst.Found:
        return False
