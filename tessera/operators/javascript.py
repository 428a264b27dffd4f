"""Which lines of a JavaScript file start at its top level, and which declarations on them are sound.

Not a grammar: a scanner that follows comments, strings, templates, regular expressions, JSX and brackets well enough
to know where a line starts. Where it can't be sure (two readings of a slash, a template within a template's hole, an open
literal) it gives up, and the rest of the file has no declarations; wrong boundaries would be worse than none.
"""

from __future__ import annotations

import re
from collections.abc import Callable

MAX_DEPTH = 256

# Words that can't name anything, and words after which an expression, a condition or a block comes.
RESERVED = frozenset(
    """arguments await break case catch class const continue debugger default delete do else enum eval export extends
    false finally for function if implements import in instanceof interface let new null package private protected public
    return static super switch this throw true try typeof var void while with yield""".split()
)
EXPRESSION_WORDS = frozenset("await case delete do else in instanceof new of return throw typeof void yield".split())
CONDITION_WORDS = frozenset("catch for if switch while with".split())
BLOCK_WORDS = frozenset("do else finally try".split())

NAME = r"[A-Za-z_$][A-Za-z0-9_$]*"
_BLANKS = " \t\r\n"
_WORD = re.compile(NAME)
_NUMBER = re.compile(r"[0-9][0-9A-Fa-f._xXoObBeEn]*")
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\])*\]|[^/\\\[])*/", re.S)
_STRING = {q: re.compile(rf"(?:\\.|[^\\{q}])*", re.S) for q in "'\""}
_IN_TEMPLATE = re.compile(r"\\.|`|\$\{", re.S)
_IN_TAG = re.compile(r"['\"{>]|/>")
_IN_JSX_TEXT = re.compile(r"\{|</|<>|<(?=[A-Za-z_$])")

# kinds of open brackets; what a closing one may match
PAREN, CONDITION, BRACKET = "(", "condition", "["
BRACE, OBJECT, STATEMENT, CONTROL, HOLE, JSX_HOLE = "{", "object", "statement", "control", "${", "jsx{"
_BRACES = {BRACE, OBJECT, STATEMENT, CONTROL, HOLE, JSX_HOLE}
# after one token, what the next may be: see Scanner.hint
AFTER_OPERATOR, AFTER_CONDITION_WORD, AFTER_BLOCK_WORD, AFTER_BRACE = "operator", "condition", "block", "brace"
#: Whether an expression may follow, and the hint.
_SIGNS = {c: (True, AFTER_OPERATOR) for c in ",?=!~+-*%&|^"} | {c: (True, None) for c in ";:>"} | {".": (False, None)}


class Scanner:
    """State carried from line to line."""

    def __init__(self, allowed: Callable[[str], bool] | None = None):
        self.allowed, self.refused = allowed, False
        self.open: list[str] = []
        self.expression = True  # an expression may start here, so a slash begins a pattern
        self.hint: str | None = None
        self.lost = False
        self.comment = self.template = False
        self.string = ""
        self.elements, self.tag, self.closing, self.tag_string, self.tag_escape = 0, False, False, "", False

    @property
    def at_top(self) -> bool:
        return not (self.lost or self.comment or self.string or self.template or self.open or self.elements)

    def _push(self, kind: str) -> bool:
        self.lost = self.lost or len(self.open) >= MAX_DEPTH
        if not self.lost:
            self.open.append(kind)
        return not self.lost

    def _pop(self, kinds) -> str | None:
        top = self.open.pop() if self.open else None
        if top not in kinds:
            self.lost = True
            return None
        return top

    def line(self, text: str) -> None:
        """Read one line, without its end."""
        at, first = 0, True
        while at < len(text) and not self.lost and not self.refused:
            if self.comment:
                end = text.find("*/", at)
                self.comment, at = end < 0, len(text) if end < 0 else end + 2
            elif self.template:
                at = self._in_template(text, at)
            elif self.string:
                at = self._in_string(text, at)
            elif self.elements and JSX_HOLE not in self.open:
                at = self._in_jsx(text, at)
            elif text[at] in _BLANKS:
                at += 1
            elif text.startswith("//", at):
                return
            elif text.startswith("/*", at):
                self.comment, at = True, at + 2  # what follows it still comes first on the line
            else:
                at, first = self._token(text, at, first), False

    def _in_template(self, text: str, at: int) -> int:
        for part in _IN_TEMPLATE.finditer(text, at):
            if part[0] == "`":
                self.template, self.expression = False, False
                return part.end()
            if part[0] == "${":
                if self._push(HOLE):
                    self.template, self.expression = False, True
                return part.end()
        return len(text)

    def _in_string(self, text: str, at: int) -> int:
        end = _STRING[self.string].match(text, at).end()
        if end < len(text) and text[end] == self.string:
            self.string, self.expression = "", False
            return end + 1
        self.lost = end >= len(text)  # else a backslash at the end carries it over
        return len(text)

    def _in_jsx(self, text: str, at: int) -> int:
        if self.tag_string:
            if not self.tag_escape and text[at] == self.tag_string:
                self.tag_string = ""
            self.tag_escape = not self.tag_escape and text[at] == "\\"
            return at + 1
        part = (_IN_TAG if self.tag else _IN_JSX_TEXT).search(text, at)
        if not part:
            return len(text)
        sign = part[0]
        if sign == "{":
            if self._push(JSX_HOLE):
                self.expression = True
        elif self.tag and sign in "'\"":
            self.tag_string = sign
        elif self.tag:
            self.elements -= self.closing or sign == "/>"
            self.closing = self.closing and sign == "/>"
            self.tag = False
            if not self.elements:
                self.tag, self.closing, self.expression = False, False, False
        else:
            self.elements += sign != "</"
            self.tag = sign != "<>"
            self.closing = sign == "</" or (self.closing and sign == "<>")
        return part.end()

    def _token(self, text: str, at: int, first: bool) -> int:
        sign, hint = text[at], self.hint
        word = _WORD.match(text, at)
        self.hint = None
        if word:
            if self.allowed and not self.allowed(word[0]):
                self.refused = True
                return at
            self.expression = word[0] in EXPRESSION_WORDS
            self.hint = AFTER_CONDITION_WORD if word[0] in CONDITION_WORDS else AFTER_BLOCK_WORD if word[0] in BLOCK_WORDS else AFTER_OPERATOR if self.expression else None
            return word.end()
        if number := _NUMBER.match(text, at):
            self.expression = False
            return number.end()
        if sign == "/":
            if hint == AFTER_BRACE:
                self.lost = True
            elif self.expression or first:
                literal = _REGEX.match(text, at)
                self.lost, self.expression = literal is None, False
                return literal.end() if literal else len(text)
            else:
                self.expression, self.hint = True, AFTER_OPERATOR
        elif sign in "'\"":
            self.string = sign
            self.lost = at + 1 == len(text)
        elif sign == "`":
            self.lost = HOLE in self.open
            self.template = not self.lost
        elif sign == "<" and self.expression and re.match(rf"<(?:{NAME}|>)", text[at : at + 2]):
            if JSX_HOLE in self.open:
                self.lost = True
                return at
            self.elements, self.closing, self.expression = self.elements + 1, False, False
            self.tag = text[at + 1] != ">"
            return at + 1 if self.tag else at + 2
        elif sign in _SIGNS:
            self.expression, self.hint = _SIGNS[sign]
        elif sign in "([{":
            self._opening(sign, hint, first)
        elif sign in ")]}":
            self._closing(sign)
        else:
            self.expression = True
        return at + 1

    def _opening(self, sign: str, hint: str | None, first: bool) -> None:
        if sign == "(":
            kind = CONDITION if hint == AFTER_CONDITION_WORD else PAREN
        elif sign == "[":
            kind = BRACKET
        elif hint in (AFTER_BLOCK_WORD, "after condition"):
            kind = CONTROL
        elif hint == AFTER_OPERATOR:
            kind = OBJECT
        else:
            free = not {HOLE, JSX_HOLE}.intersection(self.open) and (not self.open or self.open[-1] in (BRACE, STATEMENT, CONTROL))
            kind = STATEMENT if first and free else BRACE
        if self._push(kind):
            self.expression = True
            self.hint = AFTER_OPERATOR if sign != "{" else None

    def _closing(self, sign: str) -> None:
        kind = self._pop({")": {PAREN, CONDITION}, "]": {BRACKET}, "}": _BRACES}[sign])
        self.expression = kind in (CONDITION, CONTROL, STATEMENT)
        if kind == CONDITION:
            self.hint = "after condition"
        elif kind == HOLE:
            self.template = True
        elif kind == BRACE:
            self.hint = AFTER_BRACE


# --- declarations on one line ------------------------------------------------------------------------


def _named(word: str | None) -> bool:
    return bool(word) and word not in RESERVED


def _parameters(text: str) -> str | None:
    """What follows a sound list of parameters: plain names, each once, a rest parameter last; null if unsound."""
    inner, closed, tail = text[1:].partition(")")
    if not text.startswith("(") or not closed:
        return None
    parts = [p.strip() for p in inner.split(",")] if inner.strip() else []
    if parts and parts[-1].startswith("..."):
        parts[-1] = parts[-1][3:].strip()
    sound = all(re.fullmatch(NAME, p) and _named(p) for p in parts) and len(set(parts)) == len(parts)
    return tail if sound else None


def sound_function(text: str, must_have_name: bool) -> bool:
    """``function``, a star or not, a name, parameters and an opening brace."""
    head = re.match(rf"function\s*(?:\*\s*)?({NAME})?\s*", text)
    if not head or (head[1] is not None or must_have_name) and not _named(head[1]):
        return False
    tail = _parameters(text[head.end() :])
    return tail is not None and tail.strip().startswith("{")


def _sound_class(text: str) -> bool:
    head = re.match(rf"class[{_BLANKS}]*(?:\{{|({NAME})[{_BLANKS}]*(?:extends(?=[{_BLANKS}*(])[{_BLANKS}]*({NAME})[{_BLANKS}]*((?:\.{NAME}[{_BLANKS}]*)*))?\{{)", text)
    if not head:
        return False
    names = [head[1], head[2], *re.findall(NAME, head[3] or "")]
    return all(n is None or _named(n) for n in names)


def _starts_expression(body: str, scanned: Scanner, may_wait: bool) -> bool:
    """Whether an arrow's body begins like an expression or block that can be told from its first words."""
    unary = r"[+\-!~]|(?:delete|new|typeof|void|await)(?![A-Za-z0-9_$])"
    at = 0
    while part := re.compile(rf"[{_BLANKS}]*({unary})").match(body, at):
        if part[1] == "await" and not may_wait:
            return False
        at = part.end()
    rest = body[at:].lstrip(_BLANKS)
    if not rest:
        return False
    if rest[0] == "<":
        return bool(re.match(r"<[A-Za-z_$>]", rest)) and scanned.at_top
    if rest[0] in "/'\"`([{0123456789":
        return True
    word = _WORD.match(rest)
    if not word:
        return False
    if word[0] == "function":
        return sound_function(rest, False)
    if word[0] == "class":
        return _sound_class(rest)
    return word[0] in ("false", "null", "this", "true") or _named(word[0])


def _sound_arrow(text: str, may_wait: bool) -> bool:
    if text.startswith("("):
        tail = _parameters(text)
    else:
        word = _WORD.match(text)
        tail = text[word.end() :] if word and _named(word[0]) else None
    if tail is None or not tail.strip().startswith("=>"):
        return False
    body = tail.strip()[2:].strip()
    if not body or body.startswith(("=>", "//", "/*")):
        return False
    scanned = Scanner(lambda w: w != "yield" and (w != "await" or may_wait))
    scanned.line(body)
    return not scanned.refused and not scanned.lost and _starts_expression(body, scanned, may_wait)


def sound_initializer(line: str) -> bool:
    """The right side of ``name = ..``: a function expression or an arrow function."""
    right = line.partition("=")[2].strip()
    follows = lambda word, text: re.match(rf"{word}[{_BLANKS}*(]", text)
    if follows("async", right):
        rest = right[5:].strip()
        if follows("function", rest) or rest == "function":
            return sound_function(rest, False)
        return _sound_arrow(rest, True) or _sound_arrow(right, False)
    if follows("function", right) or right == "function":
        return sound_function(right, False)
    return _sound_arrow(right, False)


def sound_declaration(line: str) -> bool:
    at = line.find("function")
    return at >= 0 and sound_function(line[at:], True)
