"""One pass over TypeScript or JavaScript: what is code, and how deep each place is nested."""

from __future__ import annotations

import bisect
import re

_TOKEN = re.compile(
    r"(?P<space>\s+)|(?P<comment>//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")|(?P<word>[\w$#@]+)|(?P<brace>[{}])|(?P<tick>`)"
    r"|(?P<regex>/(?![*/])(?:\\[^\n]|\[(?:\\[^\n]|[^\]\\\n])*\]|[^/\\\[\n])+/[a-z]*)|(?P<other>.)",
    re.S,
)
_TEMPLATE = re.compile(r"(?:\\.|\$(?!\{)|[^\\`$])*", re.S)
#: Words after which a slash begins a regex (fixed values).
_BEFORE_REGEX = frozenset("return typeof case in of delete void throw new else do await yield instanceof".split())


def _hidden(text: str) -> str:
    return re.sub(r"[^\n]", " ", text)


class Code:
    """``blank`` is the text at its length, with comments, regexes and the insides of strings and templates as blanks.

    A stack holds, for each template that is open, how many braces its current ``${}`` has open, so code inside stays code. A slash
    is a division after a value, the end of a tag after ``<``, else a regex if one closes on its line. A quote that isn't closed
    on its line stands for itself, as in the text of a tag. Every character is taken once, so time is linear in the text.
    """

    def __init__(self, text: str) -> None:
        self.text = text
        out: list[str] = []
        open_templates: list[int] = []
        self._at: list[int] = []
        self._deep: list[int] = [0]
        k, value = 0, False
        while k < len(text):
            m = _TOKEN.match(text, k)
            kind, token = m.lastgroup, m[0]
            if kind == "regex" and (value or text[k - 1 : k] == "<"):
                kind, token = "other", "/"
            start, k = k, k + len(token)
            if kind == "space" or kind == "comment":
                out.append(token if kind == "space" else _hidden(token))
            elif kind == "regex":
                out.append(_hidden(token))
                value = True
            elif kind == "string":
                out.append(token[0] + _hidden(token[1:-1]) + token[0])
                value = True
            elif kind == "tick" or token == "}" and open_templates and open_templates[-1] == 0:
                if token == "}":
                    open_templates.pop()
                    self._brace(start, -1)
                end = _TEMPLATE.match(text, k).end()
                out += [token, _hidden(text[k:end])]
                k, value = end + 1, True
                if text.startswith("${", end):
                    out.append(" {")
                    self._brace(end + 1, 1)
                    open_templates.append(0)
                    k, value = end + 2, False
                elif end < len(text):
                    out.append("`" if text[end] == "`" else " ")
            else:
                out.append(token)
                value = token in ")]" or kind == "word" and token not in _BEFORE_REGEX
                if kind == "brace":
                    step = 1 if token == "{" else -1
                    self._brace(start, step)
                    if open_templates:
                        open_templates[-1] += step
        self.blank = "".join(out)

    def _brace(self, at: int, step: int) -> None:
        self._at.append(at)
        self._deep.append(self._deep[-1] + step)

    def depth(self, at: int) -> int:
        """Braces open before a place."""
        return self._deep[bisect.bisect_left(self._at, at)]
