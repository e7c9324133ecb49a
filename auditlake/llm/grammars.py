"""Local grammars: whether balanced statements of JavaScript, Java and Go are well formed.

A text becomes a list of tokens in which every identifier, number and string is one symbol. Blocks are taken out of
the list and checked by themselves, so what remains of a statement is a short shape; the verdict on a shape is
remembered, since most statements of a corpus share a few shapes.
"""

from __future__ import annotations

import re
from collections.abc import Callable


class Broken(Exception):
    """The text is not in the grammar."""


# The reserved words and operators of the languages.
_JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else export extends finally for function if import in instanceof new return super switch this throw try typeof var void while with null true false".split()
)
_JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while yield null true false".split()
)
_GO_WORDS = frozenset(
    "break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split()
)
_PRIMITIVES = frozenset("boolean byte char double float int long short void".split())
_MODIFIERS = frozenset("abstract final native private protected public static strictfp synchronized transient volatile default".split())

_NUMBER = re.compile(r"(?:0[xX][0-9a-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|0[xX][0-9a-fA-F_.]*[pP][+-]?\d+|(?:\d[\d_]*)?\.?\d[\d_]*\.?(?:[eE][+-]?\d+)?)[nlLfFdDi]?")
_OPERATORS = {
    "javascript": ">>>= ... === !== **= <<= >>= >>> &&= ||= ??= => == != <= >= && || ?? ?. ++ -- += -= *= /= %= &= |= ^= << >> ** { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @",
    "java": "... -> :: <<= >>= >>>= == != <= >= && || ++ -- += -= *= /= %= &= |= ^= << { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ ? : = . @",
    "go": "... <<= >>= &^= := <- == != <= >= && || ++ -- += -= *= /= %= &= |= ^= << >> &^ { } ( ) [ ] ; , < > + - * / % & | ^ ! ~ : = .",
}
_STRINGS = {
    "javascript": r"""\"(?:[^\"\\\n]|\\[\s\S])*\"|'(?:[^'\\\n]|\\[\s\S])*'|`(?:[^`\\]|\\[\s\S])*`""",
    "java": r"""\"\"\"[\s\S]*?\"\"\"|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'""",
    "go": r"""\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.[0-9a-fA-F]*)'|`[^`]*`""",
}
_COMMENT = r"//[^\n]*|/\*[^*]*\*+(?:[^/*][^*]*\*+)*/"


def _lexer(language: str) -> Callable[[str], list[str]]:
    """Cuts a text into white space, comments, words, numbers, strings, operators and single other characters."""
    operators = "|".join(re.escape(x) for x in _OPERATORS[language].split())
    return re.compile(rf"[ \t\r\f\v\xa0\ufeff]+|\n\s*|[^\W\d][\w$]*|\$[\w$]*|{_STRINGS[language]}|{_COMMENT}|\.?\d(?:[eE][+-]|[\w.])*|{operators}|\#[^\W\d]\w*|[\s\S]").findall


_LEXERS = {x: _lexer(x) for x in _OPERATORS}


class _Symbols(dict):
    """The symbol of each piece of text: nothing for what is skipped, ``bad`` for what is in no language."""

    def __init__(self, language: str, words: frozenset[str]):
        super().__init__({x: x for x in _OPERATORS[language].split()})
        self.words, self.js = words, language == "javascript"

    def __missing__(self, piece: str) -> str:
        c = piece[0]
        if c in "\"'`":
            return "s" if len(piece) > 1 else "bad"
        if c == "/":
            return "\n" if "\n" in piece else ""
        if c == "\n":
            return "\n"
        if len(self) > 200_000:
            return self._symbol(piece, c)
        found = self[piece] = self._symbol(piece, c)
        return found

    def _symbol(self, piece: str, c: str) -> str:
        if piece in self.words:
            return piece
        if c.isalpha() or c in "_$" or c == "#" and self.js and len(piece) > 1:
            return "i"
        if c.isdigit() or c == ".":
            return "n" if _NUMBER.fullmatch(piece) else "bad"
        return "" if c in " \t\r\f\v\xa0\ufeff" else "bad"


_WORDS = {"javascript": _JS_WORDS, "java": _JAVA_WORDS, "go": _GO_WORDS}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*\])+/[a-z]*")
_OPEN, _CLOSE = {"(": ")", "[": "]", "{": "}"}, {")", "]", "}"}
#: Go puts a semicolon at the end of a line after one of these.
_GO_ENDS = frozenset(["i", "n", "s", "break", "continue", "fallthrough", "return", "++", "--", ")", "]", "}"])
_VALUE_END = frozenset(["i", "n", "s", ")", "]", "}", "this", "super", "null", "true", "false", "++", "--"])


_SYMBOLS = {x: _Symbols(x, w) for x, w in _WORDS.items()}


def _with_regexes(pieces: list[str], text: str) -> list[str]:
    """The pieces of JavaScript text again, with its regular expressions as strings."""
    symbols, out, at, before = _SYMBOLS["javascript"], [], 0, ";"
    lex = _LEXERS["javascript"]
    while at < len(text):
        for piece in pieces:
            symbol = symbols[piece]
            if symbol in ("/", "/=") and before not in _VALUE_END:
                regex = _REGEX.match(text, at)
                if regex:
                    out.append("'regex'")
                    at, before = regex.end(), "s"
                    pieces = lex(text[at:])
                    break
            if symbol and symbol != "\n":
                before = symbol
            out.append(piece)
            at += len(piece)
    return out


def tokens(text: str, language: str) -> list[str]:
    """The symbols of a text; ``\\n`` for line ends in JavaScript, semicolons for those that end Go statements."""
    pieces, symbols = _LEXERS[language](text), _SYMBOLS[language]
    if language == "javascript" and ("/" in pieces or "/=" in pieces):
        pieces = _with_regexes(pieces, text)
    found = [t for p in pieces if (t := symbols[p])]
    if "bad" in found:
        raise Broken(found.index("bad"))
    if language == "javascript":
        return found
    if language == "java":
        return [t for t in found if t != "\n"]
    out: list[str] = []
    for t in found:
        if t != "\n":
            out.append(t)
        elif out and out[-1] in _GO_ENDS:
            out.append(";")
    if out and out[-1] in _GO_ENDS:
        out.append(";")
    return out


def matches(toks: list[str]) -> dict[int, int]:
    """The place of the bracket that closes each one."""
    stack: list[int] = []
    found: dict[int, int] = {}
    for i, t in enumerate(toks):
        if t in _OPEN:
            stack.append(i)
        elif t in _CLOSE:
            if not stack or _OPEN[toks[stack[-1]]] != t:
                raise Broken(i)
            found[stack.pop()] = i
    if stack:
        raise Broken(stack[-1])
    return found


class _Parser:
    """A parser of one shape: a statement without its blocks, each of which is the symbol ``C``."""

    assigns = frozenset("= += -= *= /= %= **= <<= >>= >>>= &= |= ^= &&= ||= ??= &^= :=".split())
    binaries = frozenset("+ - * / % ** < > <= >= == != === !== && || ?? & | ^ << >> >>> instanceof in &^".split())
    prefixes = frozenset("+ - ! ~ ++ -- typeof void delete".split())

    def __init__(self, toks: list[str]):
        self.t, self.p, self.deep = toks, 0, 0

    def peek(self, ahead: int = 0) -> str:
        at = self.p + ahead
        return self.t[at] if at < len(self.t) else ""

    def take(self, *which: str) -> bool:
        if self.peek() in which and self.peek():
            self.p += 1
            return True
        return False

    def need(self, *which: str) -> None:
        if not self.take(*which):
            raise Broken(self.p)

    def attempt(self, rule: Callable[[], None]) -> bool:
        at = self.p
        try:
            rule()
            return True
        except Broken:
            self.p = at
            return False

    def end(self) -> None:
        self.take(";")
        if self.p < len(self.t):
            raise Broken(self.p)

    def closing(self, at: int) -> int:
        depth = 0
        for i in range(at, len(self.t)):
            depth += (self.t[i] in _OPEN) - (self.t[i] in _CLOSE)
            if not depth:
                return i
        raise Broken(at)

    def items(self, close: str, item: Callable[[], None], holes: bool = False) -> None:
        while not self.take(close):
            if holes and self.take(","):
                continue
            item()
            if not self.take(","):
                self.need(close)
                return

    def expr(self) -> None:
        self.assign()
        while self.take(","):
            self.assign()

    def assign(self) -> None:
        self.binary()
        if self.take("?"):
            self.assign()
            self.need(":")
            self.assign()
        if self.take(*self.assigns):
            self.assign()

    def binary(self) -> None:
        self.unary()
        while self.take(*self.binaries):
            self.unary()


class _JavaScript(_Parser):
    def assign(self) -> None:
        if self.peek() == "i" and self.peek(1) == "i" and self.peek(2) == "=>" or self.peek() == "i" and self.peek(1) == "(" and self._arrow(1):
            self.p += 1
        if self.peek() == "i" and self.peek(1) == "=>":
            self.p += 1
        elif self.peek() == "(" and self._arrow(0):
            self.p += 1
            self.items(")", self.pattern)
        else:
            super().assign()
            return
        self.need("=>")
        if not self.take("C"):
            self.assign()

    def _arrow(self, ahead: int) -> bool:
        return self.t[self.closing(self.p + ahead) + 1 : self.closing(self.p + ahead) + 2] == ["=>"]

    def pattern(self) -> None:
        self.take("...")
        if self.take("["):
            self.items("]", self.pattern, holes=True)
        elif self.take("{"):
            self.items("}", self._member_pattern)
        else:
            self.need("i")
        if self.take("="):
            self.assign()

    def _member_pattern(self) -> None:
        if self.take("..."):
            self.need("i")
            return
        self._name()
        if self.take(":"):
            self.pattern()
        elif self.take("="):
            self.assign()

    def _name(self) -> None:
        if self.take("["):
            self.assign()
            self.need("]")
        elif self.peek() in _JS_WORDS or self.peek() in ("i", "s", "n"):
            self.p += 1
        else:
            raise Broken(self.p)

    def _member(self) -> None:
        if self.take("..."):
            self.assign()
            return
        self.take("*")
        while self.peek() == "i" and (self.peek(1) in ("i", "s", "n", "[", "*") or self.peek(1) in _JS_WORDS):
            self.p += 1
            self.take("*")
        plain = self.peek() == "i"
        self._name()
        if self.take("("):
            self.items(")", self.pattern)
            self.need("C")
        elif self.take(":"):
            self.assign()
        elif plain and self.take("="):
            self.assign()
        elif not plain:
            raise Broken(self.p)

    def unary(self) -> None:
        while True:
            if self.take(*self.prefixes):
                continue
            # await, yield and async before an operand
            if self.peek() == "i" and (self.peek(1) in ("i", "s", "n", "new", "this", "function", "{", "!") and self.peek(1)):
                self.p += 1
                continue
            break
        self.primary()
        while True:
            if self.take(".", "?."):
                if self.peek() == "(" or self.peek() == "[":
                    continue
                if self.peek() != "i" and self.peek() not in _JS_WORDS:
                    raise Broken(self.p)
                self.p += 1
            elif self.take("("):
                self.items(")", self._argument)
            elif self.take("["):
                self.expr()
                self.need("]")
            elif not self.take("++", "--"):
                if self.peek() == "s" and self.t[self.p - 1] in ("i", ")", "]"):
                    raise Broken(self.p)
                return

    def _argument(self) -> None:
        self.take("...")
        self.assign()

    def primary(self) -> None:
        if self.take("i", "n", "s", "this", "super", "null", "true", "false"):
            return
        if self.take("("):
            self.expr()
            self.need(")")
        elif self.take("["):
            self.items("]", self._argument, holes=True)
        elif self.take("{"):
            self.items("}", self._member)
        elif self.take("function"):
            self.take("*")
            self.take("i")
            self.need("(")
            self.items(")", self.pattern)
            self.need("C")
        elif self.take("class"):
            self.take("i")
            if self.take("extends"):
                self.unary()
            self.need("C")
        elif self.take("new"):
            if self.take("."):
                self.need("i")
            else:
                self.unary()
        elif self.take("import"):
            self.need("(", ".")
            if self.t[self.p - 1] == "(":
                self.assign()
                self.need(")")
            else:
                self.need("i")
        else:
            raise Broken(self.p)

    def _declarations(self) -> None:
        while True:
            self.pattern()
            if not self.take(","):
                return

    def statement(self) -> None:
        first = self.peek()
        if self.take(";", "C", "debugger"):
            pass
        elif first in ("const", "var") or first == "i" and self.peek(1) in ("i", "{", "[") and not (self.peek(1) == "[" and self.closing(self.p + 1) + 1 < len(self.t) and self.t[self.closing(self.p + 1) + 1] != "="):
            self.p += 1
            if not self.attempt(self._declarations):
                # not let but await or the like
                if first != "i":
                    raise Broken(self.p)
                self.p -= 1
                self.expr()
        elif first == "function" or first == "i" and self.peek(1) == "function":
            self.p += 1 + (first == "i")
            self.take("*")
            self.need("i")
            self.need("(")
            self.items(")", self.pattern)
            self.need("C")
        elif first == "class":
            self.primary()
        elif self.take("if", "while", "with"):
            self._condition()
            self.statement()
            if first == "if" and self.take("else"):
                self.statement()
            return
        elif self.take("for"):
            self.take("i")
            self.need("(")
            self._for_head()
            self.statement()
            return
        elif self.take("do"):
            self.statement()
            self.need("while")
            self._condition()
        elif self.take("return"):
            if self.peek() not in ("", ";"):
                self.expr()
        elif self.take("throw"):
            self.expr()
        elif self.take("break", "continue"):
            self.take("i")
        elif self.take("switch"):
            self._condition()
            self.need("C")
        elif self.take("try"):
            self.need("C")
            caught = self.take("catch")
            if caught:
                if self.take("("):
                    self.pattern()
                    self.need(")")
                self.need("C")
            if self.take("finally"):
                self.need("C")
            elif not caught:
                raise Broken(self.p)
        elif self.take("case"):
            self.expr()
            self.need(":")
            if self.peek():
                self.statement()
            return
        elif first == "default" and self.peek(1) == ":" or first == "i" and self.peek(1) == ":":
            self.p += 2
            if self.peek():
                self.statement()
            return
        elif first == "import" and self.peek(1) not in ("(", "."):
            self.p += 1
            self._module()
        elif self.take("export"):
            if self.take("default"):
                if self.peek() in ("function", "class") or self.peek(1) == "function":
                    self.expr()
                else:
                    self.assign()
            elif self.peek() in ("{", "*"):
                self._module()
            else:
                self.statement()
                return
        else:
            self.expr()
        self.take(";")

    def _module(self) -> None:
        if self.take("s"):
            return
        while True:
            if self.take("*"):
                if self.take("i"):
                    self.need("i")
            elif self.take("{"):
                self.items("}", self._import_name)
            else:
                self.need("i")
            if not self.take(","):
                break
        if self.take("i"):
            self.need("s")

    def _import_name(self) -> None:
        self._name()
        if self.take("i"):
            self._name()

    def _condition(self) -> None:
        self.need("(")
        self.expr()
        self.need(")")

    def _for_head(self) -> None:
        if self.peek() in ("const", "var") or self.peek() == "i" and self.peek(1) in ("i", "[", "{"):
            self.p += 1
            self.pattern()
            if self.take("i", "in"):
                self.expr()
                self.need(")")
                return
            while self.take(","):
                self.pattern()
        elif self.peek() != ";":
            self.expr()
            if self.take("i"):
                self.expr()
            if self.take(")"):
                return
        for close in (";", ")"):
            self.need(";")
            if self.peek() != (";" if close == ";" else ")"):
                self.expr()
        self.need(")")

    def class_member(self) -> None:
        if self.take(";", "C"):
            return
        while self.peek() in ("i", "*") and self.peek(1) not in ("(", "=", ";", ""):
            self.p += 1
        self._name()
        if self.take("("):
            self.items(")", self.pattern)
            self.need("C")
        elif self.take("="):
            self.assign()
        self.take(";")


class _Java(_Parser):
    binaries = frozenset("+ - * / % < > <= >= == != && || & | ^ <<".split())
    prefixes = frozenset("+ - ! ~ ++ --".split())

    def type(self) -> None:
        self._annotations()
        if not self.take(*_PRIMITIVES):
            self.need("i")
            self._arguments()
            while self.peek() == "." and self.peek(1) == "i":
                self.p += 2
                self._arguments()
        while self.peek() == "[" and self.peek(1) == "]":
            self.p += 2

    def _arguments(self) -> None:
        if self.take("<"):
            while not self.take(">"):
                if self.take("?"):
                    if self.take("extends", "super"):
                        self.type()
                else:
                    self.type()
                    while self.take("extends", "&"):
                        self.type()
                if not self.take(","):
                    self.need(">")
                    return

    def _annotations(self) -> None:
        while self.peek() == "@" and self.peek(1) == "i":
            self.p += 2
            while self.peek() == "." and self.peek(1) == "i":
                self.p += 2
            if self.peek() == "(":
                self.p = self.closing(self.p) + 1

    def _modifiers(self) -> None:
        while True:
            self._annotations()
            if not self.take(*_MODIFIERS):
                return

    def assign(self) -> None:
        if self.peek() == "i" and self.peek(1) == "->":
            self.p += 1
        elif self.peek() == "(" and self.t[self.closing(self.p) + 1 : self.closing(self.p) + 2] == ["->"]:
            self.p += 1
            self.items(")", self._lambda_parameter)
        else:
            super().assign()
            return
        self.need("->")
        if not self.take("C"):
            self.assign()

    def _lambda_parameter(self) -> None:
        if self.peek() == "i" and self.peek(1) in (",", ")"):
            self.p += 1
        else:
            self._parameter()

    def binary(self) -> None:
        self.unary()
        while True:
            if self.take("instanceof"):
                self.take("final")
                self.type()
                self.take("i")
            elif self.peek() == ">" and self.peek(1) == ">":
                while self.take(">"):
                    pass
                self.take("=")
                self.unary()
            elif self.take(*self.binaries):
                self.unary()
            else:
                return

    def _cast(self) -> None:
        self.need("(")
        primitive = self.peek() in _PRIMITIVES
        self.type()
        while self.take("&"):
            self.type()
        self.need(")")
        if not primitive and self.peek() not in ("i", "n", "s", "(", "!", "~", "new", "this", "super", "null", "true", "false") + tuple(_PRIMITIVES):
            raise Broken(self.p)
        self.unary()

    def unary(self) -> None:
        while self.take(*self.prefixes):
            pass
        if self.peek() == "(" and self.attempt(self._cast):
            return
        self.primary()
        while True:
            if self.take("."):
                self._arguments()
                if self.take("new"):
                    self._creation()
                else:
                    self.need("i", "this", "super", "class", "yield")
            elif self.take("("):
                self.items(")", self.assign)
            elif self.peek() == "[" and self.peek(1) != "]":
                self.p += 1
                self.expr()
                self.need("]")
            elif self.take("::"):
                self.need("i", "new")
            elif not self.take("++", "--"):
                return

    def _creation(self) -> None:
        self._annotations()
        if not self.take(*_PRIMITIVES):
            self.need("i")
            self._arguments()
            while self.take("."):
                self.need("i")
                self._arguments()
        if self.take("("):
            self.items(")", self.assign)
            self.take("C")
            return
        if self.peek() != "[":
            raise Broken(self.p)
        while self.take("["):
            if not self.take("]"):
                self.expr()
                self.need("]")
        if self.take("{"):
            self.items("}", self._initializer)

    def _initializer(self) -> None:
        if self.take("{"):
            self.items("}", self._initializer)
        else:
            self.assign()

    def primary(self) -> None:
        if self.peek() in _PRIMITIVES or self.peek() == "i" and self.peek(1) in ("[", "<") and self.attempt(self._type_value):
            if self.peek() in _PRIMITIVES:
                self._type_value()
            return
        if self.take("i", "n", "s", "this", "super", "null", "true", "false"):
            return
        if self.take("("):
            self.assign()
            self.need(")")
        elif self.take("new"):
            self._creation()
        elif self.take("switch"):
            self.need("(")
            self.expr()
            self.need(")")
            self.need("C")
        else:
            raise Broken(self.p)

    def _type_value(self) -> None:
        self.type()
        if self.peek() == "::" or self.peek() == "." and self.peek(1) == "class":
            return
        raise Broken(self.p)

    def _parameter(self) -> None:
        self._modifiers()
        self.type()
        self.take("...")
        self.need("i", "this")
        while self.take("["):
            self.need("]")

    def _variables(self) -> None:
        while True:
            self.need("i")
            while self.take("["):
                self.need("]")
            if self.take("="):
                self._initializer()
            if not self.take(","):
                return

    def _local(self) -> None:
        self._modifiers()
        self.type()
        if self.peek() != "i":
            raise Broken(self.p)

    def statement(self) -> None:
        first = self.peek()
        if self.take(";", "C"):
            return
        if self.take("if", "while"):
            self._condition()
            self.statement()
            if first == "if" and self.take("else"):
                self.statement()
        elif self.take("for"):
            self.need("(")
            if self.attempt(self._each):
                pass
            else:
                if self.peek() != ";":
                    if self.attempt(self._local):
                        self._variables()
                    else:
                        self.expr()
                self.need(";")
                if self.peek() != ";":
                    self.expr()
                self.need(";")
                if self.peek() != ")":
                    self.expr()
                self.need(")")
            self.statement()
        elif self.take("do"):
            self.statement()
            self.need("while")
            self._condition()
            self.need(";")
        elif self.take("return"):
            if self.peek() != ";":
                self.assign()
            self.need(";")
        elif self.take("throw", "yield"):
            self.assign()
            self.need(";")
        elif self.take("break", "continue"):
            self.take("i")
            self.need(";")
        elif self.take("assert"):
            self.assign()
            if self.take(":"):
                self.assign()
            self.need(";")
        elif first in ("switch", "synchronized") and self.peek(1) == "(":
            self.p += 1
            self._condition()
            self.need("C")
        elif self.take("try"):
            resources = self.take("(")
            if resources:
                while not self.take(")"):
                    if self.attempt(self._local):
                        self._variables()
                    else:
                        self.assign()
                    if not self.take(";"):
                        self.need(")")
                        break
            self.need("C")
            clauses = 0
            while self.take("catch"):
                self.need("(")
                self._modifiers()
                self.type()
                while self.take("|"):
                    self.type()
                self.need("i")
                self.need(")")
                self.need("C")
                clauses += 1
            if self.take("finally"):
                self.need("C")
            elif not clauses and not resources:
                raise Broken(self.p)
        elif self.take("case"):
            while True:
                self.binary()
                if not self.take(","):
                    break
            self._arm()
        elif first == "default" and self.peek(1) in (":", "->"):
            self.p += 1
            self._arm()
        elif first == "i" and self.peek(1) == ":":
            self.p += 2
            self.statement()
        elif self.attempt(self._type_declaration):
            pass
        elif self.attempt(self._local):
            self._variables()
            self.need(";")
        else:
            at = self.p
            self.assign()
            acts = self.t[self.p - 1] in (")", "++", "--", "C") or any(x in self.assigns or x in ("++", "--") for x in self.t[at : self.p])
            if not acts:
                raise Broken(self.p)
            self.need(";")

    def _arm(self) -> None:
        if self.take("->"):
            if self.peek() in ("C", "throw"):
                self.statement()
            else:
                self.assign()
                self.need(";")
        else:
            self.need(":")
            if self.peek():
                self.statement()

    def _each(self) -> None:
        self._modifiers()
        self.type()
        self.need("i")
        self.need(":")
        self.assign()
        self.need(")")

    def _condition(self) -> None:
        self.need("(")
        self.assign()
        self.need(")")

    def _type_declaration(self) -> None:
        self._modifiers()
        if self.peek() == "@" and self.peek(1) == "interface":
            self.p += 1
        record = self.peek() == "i" and self.peek(1) == "i" and self.peek(2) in ("(", "<")
        if not record:
            self.need("class", "interface", "enum")
        else:
            self.p += 1
        self.need("i")
        self._arguments()
        if record:
            self.need("(")
            self.items(")", self._parameter)
        while self.take("extends", "implements"):
            self.type()
            while self.take(","):
                self.type()
        self.need("C")

    def class_member(self) -> None:
        if self.take(";", "C") or self.peek() == "static" and self.peek(1) == "C":
            self.take("static")
            self.take("C")
            return
        if self.attempt(self._type_declaration):
            return
        self._modifiers()
        self._arguments()
        if self.peek() == "i" and self.peek(1) in ("(", "C"):
            self.p += 1
        else:
            self.type()
            if self.peek() == "i" and self.peek(1) != "(":
                self._variables()
                self.need(";")
                return
            self.need("i")
        if self.take("("):
            self.items(")", self._parameter)
        while self.take("["):
            self.need("]")
        if self.take("throws"):
            self.type()
            while self.take(","):
                self.type()
        if self.take("default"):
            self._initializer()
        if not self.take("C"):
            self.need(";")

    def unit(self) -> None:
        """A top-level part of a file."""
        if self.take(";"):
            return
        at = self.p
        self._annotations()
        if self.take("package"):
            pass
        elif self.peek() == "import" and self.p == at:
            self.p += 1
            self.take("static")
        else:
            self.p = at
            self._type_declaration()
            return
        self.need("i")
        while self.take("."):
            self.need("i", "*")
        self.need(";")


class _Go(_Parser):
    binaries = frozenset("+ - * / % < > <= >= == != && || & | ^ << >> &^".split())
    prefixes = frozenset("+ - ! ^ * & <-".split())

    def type(self) -> None:
        if self.take("*"):
            self.type()
        elif self.take("["):
            if not self.take("]"):
                if not self.take("..."):
                    self.assign()
                self.need("]")
            self.type()
        elif self.take("map"):
            self.need("[")
            self.type()
            self.need("]")
            self.type()
        elif self.take("<-"):
            self.need("chan")
            self.type()
        elif self.take("chan"):
            self.take("<-")
            self.type()
        elif self.take("func"):
            self.signature()
        elif self.take("struct", "interface"):
            self.need("C")
        elif self.take("("):
            self.type()
            self.need(")")
        else:
            self.need("i")
            if self.peek() == "." and self.peek(1) == "i":
                self.p += 2
            if self.peek() == "[" and self.peek(1) != "]":
                self.attempt(self._type_arguments)

    def _type_arguments(self) -> None:
        self.need("[")
        self.items("]", self.type)

    def signature(self) -> None:
        self.need("(")
        self.items(")", self._parameter)
        if self.take("("):
            self.items(")", self._parameter)
        elif self.peek() in ("i", "*", "[", "map", "chan", "func", "struct", "interface", "<-"):
            self.type()

    def _parameter(self) -> None:
        if self.peek() == "i" and self.peek(1) not in (",", ")", ".", ""):
            at = self.p
            self.p += 1
            self.take("...")
            if self.attempt(self.type):
                return
            self.p = at
        self.take("...")
        self.type()

    def assign(self) -> None:
        self.binary()

    def unary(self) -> None:
        while self.take(*self.prefixes):
            pass
        self.primary()
        while True:
            if self.take("."):
                if self.take("("):
                    if not self.take("type"):
                        self.type()
                    self.need(")")
                else:
                    self.need("i")
            elif self.take("("):
                self.items(")", self._argument)
            elif self.take("["):
                if self.peek() != ":":
                    if not self.attempt(self._index):
                        self.type()
                while self.take(":"):
                    if self.peek() not in (":", "]"):
                        self.assign()
                while self.take(","):
                    self.type()
                self.need("]")
            elif self.peek() == "{" and self.t[self.p - 1] in ("i", "]"):
                self._literal()
            else:
                return

    def _index(self) -> None:
        self.assign()
        if self.peek() not in (":", "]", ","):
            raise Broken(self.p)

    def _literal(self) -> None:
        self.need("{")
        self.items("}", self._element)

    def _element(self) -> None:
        for again in (True, False):
            if self.peek() == "{":
                self._literal()
            else:
                self.assign()
            if not (again and self.take(":")):
                return

    def _argument(self) -> None:
        if self.peek() in ("[", "map", "chan", "struct", "interface") or self.peek() == "func" and not self.attempt(self.assign):
            at = self.p
            if not (self.attempt(self.assign) and self.peek() in (",", ")", "...")):
                self.p = at
                self.type()
        elif self.t[self.p - 1] in ("(", ","):
            self.assign()
        self.take("...")

    def primary(self) -> None:
        if self.take("i", "n", "s"):
            return
        if self.take("("):
            if not self.attempt(self._inner):
                self.type()
                self.need(")")
        elif self.take("func"):
            self.signature()
            self.need("C")
        elif self.peek() in ("[", "map", "struct", "chan", "interface"):
            self.type()
            if self.peek() == "{":
                self._literal()
            elif self.peek() != "(":
                raise Broken(self.p)
        else:
            raise Broken(self.p)

    def _inner(self) -> None:
        self.assign()
        self.need(")")

    def simple(self) -> None:
        self.expr()
        if self.take(*self.assigns):
            if self.take("range"):
                self.assign()
            else:
                self.expr()
        elif self.take("<-"):
            self.assign()
        else:
            self.take("++", "--")

    def _declaration(self, kind: str) -> None:
        if kind == "type":
            self.need("i")
            if self.peek() == "[" and self.peek(1) == "i" and self.peek(2) != "]":
                self.need("[")
                self.items("]", self._parameter)
            self.take("=")
            self.type()
            return
        self.need("i")
        while self.take(","):
            self.need("i")
        if self.peek() not in ("=", ";", ")", ""):
            self.type()
        elif kind == "var" and self.peek() != "=":
            raise Broken(self.p)
        if self.take("="):
            self.expr()

    def _declarations(self, kind: str) -> None:
        if self.take("("):
            while not self.take(")"):
                self._declaration(kind)
                if not self.take(";"):
                    self.need(")")
                    return
        else:
            self._declaration(kind)

    def _header(self, name: str) -> None:
        """What precedes the block of if, for and switch."""
        if self.peek() == "C":
            if name == "if":
                raise Broken(self.p)
            return
        if name == "for" and self.take("range"):
            self.assign()
            return
        parts = 0
        while self.peek() != "C":
            if self.peek() != ";":
                self.simple()
            parts += 1
            if not self.take(";"):
                break
        if parts > 3 or name != "for" and parts > 2:
            raise Broken(self.p)

    def statement(self) -> None:
        first = self.peek()
        if self.take(";", "C", "fallthrough"):
            pass
        elif self.take("var", "const", "type"):
            self._declarations(first)
        elif self.take("return"):
            if self.peek() not in ("", ";"):
                self.expr()
        elif self.take("if"):
            self._header("if")
            self.need("C")
            if self.take("else"):
                if self.peek() == "if":
                    self.statement()
                    return
                self.need("C")
        elif self.take("for", "switch"):
            self._header(first)
            self.need("C")
        elif self.take("select"):
            self.need("C")
        elif self.take("go", "defer"):
            self.assign()
            if self.t[self.p - 1] != ")":
                raise Broken(self.p)
        elif self.take("break", "continue"):
            self.take("i")
        elif self.take("goto"):
            self.need("i")
        elif self.take("case"):
            if not self.attempt(self._case):
                self.type()
                while self.take(","):
                    self.type()
                self.need(":")
            if self.peek():
                self.statement()
            return
        elif self.take("default"):
            self.need(":")
            if self.peek():
                self.statement()
            return
        elif first == "i" and self.peek(1) == ":":
            self.p += 2
            if self.peek():
                self.statement()
            return
        else:
            self.simple()
        self.take(";")

    def _case(self) -> None:
        self.simple()
        self.need(":")

    def unit(self) -> None:
        """A top-level part of a file."""
        if self.take(";"):
            return
        first = self.peek()
        if self.take("package"):
            self.need("i")
        elif self.take("import"):
            if self.take("("):
                while not self.take(")"):
                    self.take("i", ".")
                    self.need("s")
                    if not self.take(";"):
                        self.need(")")
                        break
            else:
                self.take("i", ".")
                self.need("s")
        elif self.take("func"):
            if self.peek() == "(":
                self.p += 1
                self.items(")", self._parameter)
            self.need("i")
            if self.peek() == "[":
                self.need("[")
                self.items("]", self._parameter)
            self.signature()
            self.take("C")
        elif self.take("var", "const", "type"):
            self._declarations(first)
        else:
            raise Broken(self.p)
        self.take(";")

    def class_member(self) -> None:
        """A field of a struct or a method of an interface."""
        if self.take(";"):
            return
        if self.peek() == "i" and self.peek(1) == "(":
            self.p += 1
            self.signature()
        elif self.take("*"):
            self.type()
        elif self.peek() == "i" and self.peek(1) not in (";", "", ".", "s", "|"):
            self._declaration("const")
        else:
            self.type()
            while self.take("|"):
                self.type()
        self.take("s")
        self.take(";")


_PARSERS = {"javascript": _JavaScript, "java": _Java, "go": _Go}
_ENDING_BLOCKS = frozenset("if else for while switch try function class interface enum with do finally catch synchronized func select C { static".split())
_KNOWN: dict[tuple[str, str, str], bool] = {}


def _is_block(language: str, toks: list[str], start: int, at: int, where: str) -> str:
    """What an opening brace begins: ``block``, ``class``, or nothing if it is part of an expression."""
    before = toks[at - 1] if at > start else ""
    head = toks[start:at]
    if language == "go":
        if before in ("struct", "interface"):
            return "class"
        if before in ("", "else", "select", "for", "switch") or where == "unit" and head[:1] == ["func"]:
            return "block"
        if head[0] in ("if", "for", "switch") or "else" in head:
            # a literal of a written-out type may stand in the header; any other brace opens the block
            return "" if before == "i" and at - 2 > start and toks[at - 2] == "]" else "block"
        depth = 0
        for i in range(at - 1, start - 1, -1):
            depth += (toks[i] in _CLOSE) - (toks[i] in _OPEN)
            if depth < 0 or toks[i] in (",", "=", ":=", ":") and not depth:
                break
            if toks[i] == "func" and not depth:
                return "block"
        return ""
    if "class" in head or language == "java" and ("interface" in head or "enum" in head):
        last = max(i for i, t in enumerate(head) if t in ("class", "interface", "enum"))
        if not any(t in ("(", "=", ";") for t in head[last:]) and not (last and head[last - 1] == "."):
            return "enum" if head[last] == "enum" else "class"
    if language == "java" and before == ")" and "new" in head and where != "class":
        # the body of an anonymous class follows the arguments of its creation
        depth = 0
        for i in range(at - 1, start - 1, -1):
            depth += (toks[i] in _CLOSE) - (toks[i] in _OPEN)
            if not depth and toks[i] == "(":
                j = i - 1
                while j > start and toks[j] in ("i", ".", "<", ">", ",", "?"):
                    j -= 1
                if toks[j] == "new":
                    return "class"
                break
    if before in ("", ")", "=>", "->", "else", "do", "try", "finally", "static") or before == ":" and head[:1] in (["case"], ["default"]):
        return "block"
    if language == "javascript" and before == "catch":
        return "block"
    if language == "java" and ("throws" in head or where == "class" and before == "i" and "=" not in head or head[:1] == ["i"] and "(" in head and before == ")"):
        return "block"
    return ""


def _well_formed(language: str, rule: str, shape: list[str]) -> bool:
    key = (language, rule, " ".join(shape))
    known = _KNOWN.get(key)
    if known is None:
        if len(_KNOWN) > 100_000:
            _KNOWN.clear()
        parser = _PARSERS[language](shape)
        try:
            getattr(parser, rule)()
            known = parser.p == len(shape)
        except Broken:
            known = False
        _KNOWN[key] = known
    return known


def _check(language: str, toks: list[str], closing: dict[int, int], start: int, end: int, where: str) -> None:
    """Check the statements, members or top-level parts between two places."""
    rule = {"unit": "unit", "class": "class_member", "block": "statement"}[where]
    if language == "javascript" and where == "unit":
        rule = "statement"
    js, at = language == "javascript", start
    while at < end:
        while at < end and toks[at] == "\n":
            at += 1
        if at >= end:
            return
        first, shape, i, inner = at, [], at, 0
        opened: list[int] = []
        while i < end:
            t = toks[i]
            if t == "\n":
                following = next((x for x in toks[i + 1 : i + 3] if x != "\n"), "")
                if not opened and shape and shape[-1] in _VALUE_END | {"C", "return", "break", "continue"} and (
                    following in ("i", "n", "s", "{", "}") or following in _JS_WORDS and following not in ("in", "instanceof", "else", "catch", "finally")
                    and not (following == "while" and shape[0] == "do")
                ):
                    break
                i += 1
                continue
            if t == "{":
                kind = _is_block(language, [x for x in toks[first:i] if x != "\n"], 0, sum(x != "\n" for x in toks[first:i]), where)
                if kind:
                    if kind == "enum":
                        _check_enum(toks, closing, i + 1, closing[i])
                    else:
                        _check(language, toks, closing, i + 1, closing[i], kind)
                    shape.append("C")
                    i = closing[i] + 1
                    if opened:
                        continue
                    following = next((x for x in toks[i : i + 2] if x != "\n"), "")
                    continues = following in ("else", "catch", "finally") or following == "while" and shape[0] == "do"
                    plain = shape[0] in _ENDING_BLOCKS or "function" in shape[:2] or where == "class" and "=" not in shape or rule == "unit" or any(x in shape for x in ("class", "interface", "enum")) and "=" not in shape
                    plain = plain or shape[0] in ("case", "default") or len(shape) > 2 and shape[1] == ":"
                    if plain and language == "go":
                        if following == ";":
                            i += 1
                            break
                        continue
                    if plain and not continues and not (following == ";" and shape[0] not in ("C",)) and not (shape[0] == "do"):
                        break
                    continue
                opened.append(closing[i])
            elif t in ("(", "["):
                opened.append(closing[i])
            elif opened and i == opened[-1]:
                opened.pop()
            shape.append(t)
            i += 1
            inner += 1
            if t == ";" and not opened:
                if language == "go" and shape[0] in ("if", "for", "switch") and "C" not in shape:
                    continue
                # an if with a plain statement goes on with its else
                if next((x for x in toks[i : i + 2] if x != "\n"), "") == "else" and shape[0] == "if":
                    continue
                if shape[0] == "do" and toks[i : i + 1] == ["while"]:
                    continue
                break
        if not _well_formed(language, rule, shape):
            raise Broken(first)
        at = i


def _check_enum(toks: list[str], closing: dict[int, int], start: int, end: int) -> None:
    """Constants of a Java enum, then members."""
    at = start
    while at < end and toks[at] != ";":
        if toks[at] in ("(", "{"):
            at = closing[at] + 1
        elif toks[at] in ("i", ",", "@"):
            at += 1
        else:
            raise Broken(at)
    if at < end:
        _check("java", toks, closing, at + 1, end, "class")


def is_well_formed(text: str, language: str) -> bool:
    """Whether a whole file is in the grammar of ``javascript``, ``java`` or ``go``."""
    try:
        toks = tokens(text, language)
        closing = matches(toks)
        if language == "go" and toks[:1] != ["package"]:
            return False
        _check(language, toks, closing, 0, len(toks), "unit")
        return True
    except Broken:
        return False
