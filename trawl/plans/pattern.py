"""Patterns compiled on the driver: what text a match must contain, and the same pattern in Spark's dialect.

A requirement is a tree: ``("lit", text)``, ``("and", parts)``, ``("or", parts)``, or None where a match needs no
particular text. It is sound, not complete: whatever isn't understood gives None, and the true predicate is applied
to every candidate anyway.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

Need = tuple | None


class PatternError(ValueError):
    pass


def like_tokens(pattern: str) -> list[str | None]:
    """Characters of a LIKE pattern; ``"%"`` and ``"_"`` wildcards as None and as "" respectively."""
    out: list[str | None] = []
    chars = iter(pattern)
    for c in chars:
        if c == "\\":
            c = next(chars, None)
            if c is None:
                raise PatternError("a LIKE pattern must not end with its escape character")
            out.append(c)
        else:
            out.append(None if c == "%" else "" if c == "_" else c)
    return out


def like_segments(pattern: str) -> list[str]:
    """Literal runs between wildcards, without empty ones: 'abc%def_g\\%h' has abc, def, g%h."""
    runs = [""]
    for t in like_tokens(pattern):
        if t:
            runs[-1] += t
        else:
            runs.append("")
    return [r for r in runs if r]


def spark_like(pattern: str) -> str:
    """The pattern with escapes where Spark allows them: an escaped ordinary character is that character."""
    return "".join("%" if t is None else "_" if t == "" else "\\" + t if t in "%_\\" else t for t in like_tokens(pattern))


def like_pieces(pattern: str) -> list[str] | None:
    """The literals between runs of %, the first and last of them anchored and maybe empty; None if a _ is there."""
    tokens = like_tokens(pattern)
    if "" in tokens:
        return None
    pieces, after = [""], False
    for t in tokens:
        if t is not None:
            pieces[-1] += t
        elif not after:
            pieces.append("")
        after = t is None
    return pieces


def like_need(pattern: str) -> Need:
    return both([("lit", s) for s in like_segments(pattern)])


def both(parts: list[Need]) -> Need:
    real = [p for p in parts if p is not None]
    return None if not real else real[0] if len(real) == 1 else ("and", tuple(real))


def either(parts: list[Need]) -> Need:
    if not parts or None in parts:
        return None
    return parts[0] if len(parts) == 1 else ("or", tuple(parts))


@dataclass(frozen=True)
class Regex:
    java: str
    need: Need
    fold: bool


_CLASS = {"alpha": r"\p{IsAlphabetic}", "digit": r"\p{IsDigit}", "alnum": r"\p{IsAlphabetic}\p{IsDigit}", "upper": r"\p{IsUppercase}", "lower": r"\p{IsLowercase}", "space": r"\s", "punct": r"\p{Punct}", "blank": r" \t", "cntrl": r"\p{Cntrl}", "xdigit": "0-9A-Fa-f", "graph": r"\p{Graph}", "print": r"\p{Print}", "word": r"\w"}
_ANCHOR = {"m": r"\b(?=\w)", "M": r"\b(?<=\w)", "y": r"\b", "Y": r"\B", "A": r"\A", "Z": r"\z"}
_CONTROL = {"a": "\x07", "b": "\b", "e": "\x1b", "f": "\f", "n": "\n", "r": "\r", "t": "\t", "v": "\v", "B": "\\"}


def quoted(c: str) -> str:
    return "\\" + c if c in r".^$*+?()[]{}|\-&" else c


class _Parser:
    """Advanced regular expressions of the host's kind, to Java's dialect and to a requirement."""

    def __init__(self, pattern: str):
        self.p, self.i = pattern, 0
        self.classes = False  # whether there are classes or word edges, which are Unicode's

    def peek(self, n: int = 1) -> str:
        return self.p[self.i : self.i + n]

    def take(self, n: int = 1) -> str:
        out = self.peek(n)
        if len(out) < n:
            raise PatternError("the regular expression ends too early")
        self.i += n
        return out

    def alternation(self) -> tuple[str, Need]:
        branches = [self.branch()]
        while self.peek() == "|":
            self.take()
            branches.append(self.branch())
        return "|".join(j for j, _ in branches), either([n for _, n in branches])

    def branch(self) -> tuple[str, Need]:
        java: list[str] = []
        needs: list[Need] = []
        run = ""

        def flush() -> None:
            nonlocal run
            if run:
                needs.append(("lit", run))
            run = ""

        while self.i < len(self.p) and self.peek() not in ("|", ")"):
            text, need, literal, fixed = self.atom()
            mark, least = ("", 1) if fixed else self.quantifier()
            java.append(text + mark)
            if literal is not None and not mark:
                run += literal
                continue
            if literal is not None and least:
                run += literal
            flush()
            if literal is None and least:
                needs.append(need)
        flush()
        return "".join(java), both(needs)

    def quantifier(self) -> tuple[str, int]:
        c = self.peek()
        if c and c in "*+?":
            self.take()
            mark, least = c, int(c == "+")
        elif found := re.match(r"\{(\d+)(,(\d*))?\}", self.p[self.i :]):
            self.i += found.end()
            mark, least = found[0], int(found[1])
        else:
            return "", 1
        if self.peek() == "?":
            mark += self.take()
        if self.peek() in ("*", "+", "?"):
            raise PatternError("a quantifier can't follow a quantifier")
        return mark, least

    def atom(self) -> tuple[str, Need, str | None, bool]:
        """(Java, requirement, literal character or None, takes no quantifier)."""
        c = self.take()
        if c == "(":
            return self.group()
        if c == "[":
            return self.bracket(), None, None, False
        if c == "\\":
            return self.escape()
        if c == ".":
            return ".", None, None, False
        if c == "^":
            return "^", None, None, True
        if c == "$":
            return r"\z", None, None, True
        if c in "*+?":
            raise PatternError("a quantifier needs something before it")
        if c == "{" and self.peek().isdigit():
            raise PatternError("a bound needs something before it")
        return quoted(c), None, c, False

    def group(self) -> tuple[str, Need, str | None, bool]:
        opener, look = "(", False
        if self.peek() == "?":
            for o in ("?:", "?=", "?!", "?<=", "?<!"):
                if self.peek(len(o)) == o:
                    self.take(len(o))
                    opener, look = "(" + o, o != "?:"
                    break
            else:
                raise PatternError("options are allowed at the start only")
        java, need = self.alternation()
        if self.take() != ")":
            raise PatternError("a group isn't closed")
        return f"{opener}{java})", None if look else need, None, look

    def escape(self) -> tuple[str, Need, str | None, bool]:
        c = self.take()
        if c in _ANCHOR:
            self.classes = True
            return _ANCHOR[c], None, None, True
        if c in "dDsSwW":
            self.classes = True
            return "\\" + c, None, None, False
        if c in "xuU":
            n = {"u": 4, "U": 8}.get(c)
            found = re.match(r"[0-9a-fA-F]+" if n is None else rf"[0-9a-fA-F]{{{n}}}", self.p[self.i :])
            if not found:
                raise PatternError("a hexadecimal escape without digits")
            self.i += found.end()
            char = chr(int(found[0], 16))
            return f"\\x{{{ord(char):x}}}", None, char, False
        if c.isdigit():
            if c == "0":
                raise PatternError("octal escapes aren't supported")
            digits = c
            while self.peek().isdigit():
                digits += self.take()
            return "\\" + digits, None, None, False
        if c in _CONTROL:
            return quoted(_CONTROL[c]), None, _CONTROL[c], False
        if c.isalnum():
            raise PatternError(f"unknown escape \\{c}")
        return quoted(c), None, c, False

    def bracket(self) -> str:
        out = "["
        if self.peek() == "^":
            out += self.take()
        first = True
        while first or self.peek() != "]":
            c = self.take()
            first = False
            if c == "[" and self.peek() == ":":
                end = self.p.find(":]", self.i)
                name = self.p[self.i + 1 : end]
                if end < 0 or name not in _CLASS:
                    raise PatternError("unknown character class")
                out += _CLASS[name]
                self.classes = True
                self.i = end + 2
            elif c == "[" and self.peek() in (".", "="):
                raise PatternError("collating elements aren't supported")
            elif c == "\\":
                text, _, _, anchor = self.escape()
                if anchor:
                    raise PatternError("that escape has no place in a bracket")
                out += text
            elif c == "-" and out not in ("[", "[^") and self.peek() != "]":
                out += "-"
            else:
                out += quoted(c)
        self.take()
        return out + "]"


def regex(pattern: str, fold: bool = False) -> Regex:
    """Newlines are ordinary characters, ``$`` is the very end, as in the host's default."""
    if pattern.startswith("***="):
        text = pattern[4:]
        return Regex("(?s)" + ("(?iu)" if fold else "") + "".join(map(quoted, text)), ("lit", text) if text else None, fold)
    pattern = pattern.removeprefix("***:")
    if found := re.match(r"\(\?([a-z]+)\)", pattern):
        for option in found[1]:
            if option in "ic":
                fold = option == "i"
            elif option not in "st":
                raise PatternError(f"option {option} isn't supported")
        pattern = pattern[found.end() :]
    parser = _Parser(pattern)
    java, need = parser.alternation()
    if parser.i < len(pattern):
        raise PatternError("a closing parenthesis without its opening one")
    return Regex("(?s" + ("iu" if fold else "") + ("U" if parser.classes else "") + ")" + java, need, fold)


def is_linear(pattern: str) -> bool:
    """Whether a pattern of Java's dialect has no look-around, atomic group or back-reference."""
    i, inside = 0, 0
    while i < len(pattern):
        c = pattern[i]
        if c == "\\":
            if not inside and pattern[i + 1 : i + 2] in tuple("123456789k"):
                return False
            i += 2
            continue
        if c == "[":
            inside += 1
        elif c == "]" and inside:
            inside -= 1
        elif not inside and pattern.startswith(("(?=", "(?!", "(?<=", "(?<!", "(?>"), i):
            return False
        i += 1
    return True
