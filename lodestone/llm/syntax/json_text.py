"""JSON (RFC 8259)."""

from __future__ import annotations

import re

TOKEN = re.compile(
    r"""[ \t\r\n]*(?:(?P<str>"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*")|(?P<num>-?(?:0|[1-9]\d*)(?:\.\d+)?(?:[eE][+-]?\d+)?)(?![\w.])"""
    r"""|(?P<lit>true|false|null)(?!\w)|(?P<op>[{}\[\]:,]))""",
    re.ASCII,
)


#: Where reading goes on behind an error.
RESUME = re.compile(r"[,\]}]")
CLOSES = {"}": "{", "]": "["}


def check(text: str, errors: list) -> list[tuple[int, str]]:
    """Errors as (line, message), found at any depth. Behind an error reading goes on at the next comma or closing bracket."""
    text = text.removeprefix("\ufeff")
    at, n = 0, len(text)
    seen, line = 0, 1
    stack: list[str] = []
    want = "value"  # value, value or ], key or }, key, colon, next, end

    def fault(message: str, place: int) -> None:
        nonlocal seen, line
        line += text.count("\n", seen, place)
        seen = place
        errors.append((line, message))

    def resume(place: int) -> int:
        """Behind the next comma or closing bracket from ``place`` on; sets what is wanted there."""
        nonlocal want
        m = RESUME.search(text, place)
        if not m:
            want = "end"
            stack.clear()
            return n
        x = m.group()
        if x == ",":
            want = "key" if stack and stack[-1] == "{" else "value" if stack else "end"
        else:
            while stack and CLOSES[x] in stack:
                if stack.pop() == CLOSES[x]:
                    break
            want = "next" if stack else "end"
        return m.end()

    while True:
        m = TOKEN.match(text, at)
        if not m:
            begin = at + len(text[at:]) - len(text[at:].lstrip(" \t\r\n"))
            if begin < n:
                fault(f"not a token: {text[begin : begin + 20]!r}", begin)
                at = resume(begin)
                continue
            if want != "end":
                fault(f"expected {want}, found the end of the text", n)
            return errors
        begin, kind, x, at = m.start(m.lastgroup), m.lastgroup, m.group(m.lastgroup), m.end()
        if want.startswith("value") and kind != "op":
            want = "next" if stack else "end"
        elif want.startswith("value") and x in "{[" and kind == "op":
            stack.append(x)
            want = "key or }" if x == "{" else "value or ]"
        elif want.startswith("key") and kind == "str":
            want = "colon"
        elif want == "colon" and x == ":":
            want = "value"
        elif want == "next" and x == "," and kind == "op":
            want = "key" if stack[-1] == "{" else "value"
        elif want in ("next", "value or ]", "key or }") and kind == "op" and CLOSES.get(x) == stack[-1]:
            stack.pop()
            want = "next" if stack else "end"
        else:
            expected = {"next": "',' or a closing bracket", "colon": "':'"}.get(want, want)
            fault(f"expected {expected}, found {x[:20]!r}" if want != "end" else f"text behind the value: {x[:20]!r}", begin)
            if want == "end" and not stack:
                return errors
            at = resume(begin)
