"""Source text as lines: comments blanked, imports on one line, and the function each line is in."""

from __future__ import annotations

import re
from bisect import bisect_right

#: Strings and comments, whichever begins first; what is inside of one can't begin another.
_TOKEN = re.compile(r"""//[^\n]*|/\*.*?(?:\*/|\Z)|'(?:\\.|[^'\\\n])*'|"(?:\\.|[^"\\\n])*"|`(?:\\.|[^`\\])*`""", re.S)
#: An import or export of names from a module, over any number of lines.
_FROM = re.compile(r"""^[ \t]*(?:import|export)\b[^;'"`(={]*(?:\{[^}'"`;]*\}[^;'"`({]*)?\bfrom\s*['"][^'"\n]+['"]""", re.M)
_DECLARED = re.compile(r"^[ \t]*(?:export\s+)?(?:default\s+)?(?:async\s+)?(?:function\b\s*\*?\s*([A-Za-z_$][\w$]*)|(?:const|let|var)\s+([A-Za-z_$][\w$]*)\s*(?::[^=\n]+)?=\s*(?:(?:React\.)?(?:memo|forwardRef|useCallback)\s*(?:<[^>\n]*>)?\(\s*)?(?:async\s*)?(?:function\b[^\n(]*)?(?=\(|<|[A-Za-z_$][\w$]*\s*=>))", re.M)
_ARROW = re.compile(r"\s*(?::[^=;{]*(?:\{[^}]*\}[^=;{]*)?)?=>")
_PAREN = re.compile(r"[()]")
_BRACKET = re.compile(r"[{}()\[\]]|=>|;|\n")


def masked(text: str) -> tuple[str, str]:
    """The text without comments, and without what strings hold as well; line ends stay where they are."""
    blank = lambda s: re.sub(r"[^\n]", " ", s)
    code = _TOKEN.sub(lambda m: blank(m[0]) if m[0][:2] in ("//", "/*") else m[0], text)
    bare = _TOKEN.sub(lambda m: m[0][0] + blank(m[0][1:-1]) + m[0][-1] if len(m[0]) > 1 else m[0], code)
    return code, bare


def _end(bare: str, at: int) -> int:
    """Where the function declared up to ``at`` ends: its body's closing brace, or, for an arrow
    without braces, the end of its expression."""
    depth, body, arrow = 0, False, False
    for m in _BRACKET.finditer(bare, at):
        x = m[0]
        if x == "{" and depth == 0 and (arrow or not body) and bare[at : m.start()].strip():
            body = True
        if x in "{([":
            depth += 1
        elif x in "})]":
            depth -= 1
            if depth < 0:
                return m.start()
            if depth == 0 and x == "}" and body:
                return m.end()
        elif x == "=>" and depth == 0:
            arrow, body = True, False
            rest = bare[m.end() : m.end() + 200].lstrip()
            body = rest.startswith("{")
        elif depth == 0 and (x == ";" or (x == "\n" and arrow and not body and bare[at : m.start()].rstrip()[-2:] != "=>")):
            return m.start()
    return len(bare)


def _is_function(bare: str, m: re.Match) -> bool:
    """Whether a declaration's value is a function: named so, or parameters with an arrow behind them."""
    if m[1] or "function" in m[0] or bare[m.end()] not in "(<":
        return True
    depth, at = 0, m.end()
    if bare[at] == "<":
        at = bare.find(">", at) + 1
    for x in _PAREN.finditer(bare, at):
        depth += 1 if x[0] == "(" else -1
        if depth == 0:
            return bool(_ARROW.match(bare, x.end()))
    return False


def lines(text: str) -> list[tuple[int, str, str, str | None]]:
    """(line, text, code, parent) of every line. ``code`` has no comments, and an import or export that goes over several lines
    stands on its first; ``parent`` is the innermost named function that the line lies in."""
    code, bare = masked(text)
    begin = [0, *(m.end() for m in re.finditer("\n", code))]
    line_of = lambda at: bisect_right(begin, at)
    parent: list[str | None] = [None] * len(begin)
    # Outer functions come first, so that inner ones go over them.
    for m in (m for m in _DECLARED.finditer(bare) if _is_function(bare, m)):
        first, last = line_of(m.start() + len(m[0]) - len(m[0].lstrip())), line_of(max(m.end(), _end(bare, m.end())) - 1)
        parent[first - 1 : last] = [m[1] or m[2]] * (last - first + 1)
    joined = _FROM.sub(lambda m: re.sub(r"\s*\n\s*", " ", m[0]) + "\n" * m[0].count("\n"), code)
    return [(k, *row) for k, row in enumerate(zip(text.split("\n"), joined.split("\n"), parent), 1)]
