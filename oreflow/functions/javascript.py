"""Count vectors of scripts by a tokenizer: exact calls and literals of plain code, coarse statement kinds.

No parser of the language is at hand, so statement kinds are those that tokens show: a pipeline that
has a parser's maps uses them as an input column instead.
"""

from __future__ import annotations

import re
from collections import Counter

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

_COUNTS = T.MapType(T.StringType(), T.IntegerType())
RESULT = T.StructType([
    T.StructField("statements_by_count", _COUNTS),
    T.StructField("calls_by_count", _COUNTS),
    T.StructField("literals_by_count", _COUNTS),
    T.StructField("failed", T.BooleanType()),
    T.StructField("stderr", T.StringType()),
])

_TOKEN = re.compile(
    r"""(?P<blank>\s+|//[^\n]*|/\*.*?\*/)
    |(?P<string>"(?:[^"\\\n]|\\.)*+"|'(?:[^'\\\n]|\\.)*+'|`(?:[^`\\]|\\.)*+`)
    |(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)
    |(?P<name>[A-Za-z_$\u0080-￿][\w$\u0080-￿]*)
    |(?P<sign>===|!==|>>>=|[-+*/%&|^=!<>]=|&&|\|\||\+\+|--|=>|<<|>>>?|[-+*/%&|^!~<>=?:;,.(){}\[\]])""",
    re.S | re.X,
)
_REGEX = re.compile(r"/(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*")
_BEFORE_REGEX = frozenset(["(", ",", "=", ":", "[", "!", "&&", "||", "?", "{", "}", ";", "return", "typeof", "case", "in", "===", "!==", "==", "!=", "+", "=>"])
# The statement kind that a keyword opens.
_KINDS = {
    "break": "BreakStatement", "catch": "CatchClause", "continue": "ContinueStatement", "do": "DoLoop", "for": "ForLoop", "function": "FunctionNode",
    "if": "IfStatement", "new": "NewExpression", "return": "ReturnStatement", "switch": "SwitchStatement", "case": "SwitchCase", "default": "SwitchCase",
    "throw": "ThrowStatement", "try": "TryStatement", "var": "VariableDeclaration", "let": "VariableDeclaration", "const": "VariableDeclaration",
    "while": "WhileLoop", "with": "WithStatement", "typeof": "UnaryExpression", "void": "UnaryExpression", "delete": "UnaryExpression",
    "true": "KeywordLiteral", "false": "KeywordLiteral", "null": "KeywordLiteral", "this": "KeywordLiteral",
}
_OTHER_WORDS = frozenset(["else", "finally", "in", "instanceof", "debugger", "class", "extends", "import", "export", "yield", "await", "async", "of"])
_INFIX = frozenset(["+", "-", "*", "/", "%", "&&", "||", "==", "!=", "===", "!==", "<", ">", "<=", ">=", "&", "|", "^", "<<", ">>", ">>>"])


def analyse(code: str) -> tuple[Counter, Counter, Counter]:
    """Counts of statement kinds, called names and literals; ValueError for what is no script."""
    kinds, calls, literals = Counter({"AstRoot": 1}), Counter(), Counter()
    last, before, depth, at = "", "", [], 0
    while at < len(code):
        if code[at] == "/" and (last in _BEFORE_REGEX or not last) and code[at : at + 2] not in ("//", "/*") and (found := _REGEX.match(code, at)):
            kinds["RegExpLiteral"] += 1
            before, last, at = last, "/", found.end()
            continue
        found = _TOKEN.match(code, at)
        if not found:
            raise ValueError(f"unexpected character at {at}")
        kind, text, at = found.lastgroup, found[0], found.end()
        if kind == "blank":
            continue
        if kind == "string":
            kinds["StringLiteral"] += 1
            literals[text[1:-1]] += 1
        elif kind == "number":
            kinds["NumberLiteral"] += 1
            literals[text] += 1
        elif kind == "name" and last != "." and text in _KINDS:
            kinds[_KINDS[text]] += 1
        elif kind == "name" and (last == "." or text not in _OTHER_WORDS):
            kinds["Name"] += 1
            kinds["PropertyGet"] += last == "."
        elif kind == "sign":
            kinds["InfixExpression"] += text in _INFIX
            kinds["Assignment"] += text == "=" or text.endswith("=") and text not in ("==", "!=", "===", "!==", "<=", ">=")
            kinds["ConditionalExpression"] += text == "?"
            kinds["ObjectProperty"] += text == ":" and bool(depth) and depth[-1] == "{"
            kinds["UnaryExpression"] += text in ("!", "~", "++", "--")
            kinds["EmptyStatement"] += text == ";" and last in (";", "{", "}")
            kinds["ExpressionStatement"] += text == ";" and last == ")"
            if text == "(" and (name := re.fullmatch(r"[A-Za-z_$\u0080-￿][\w$\u0080-￿]*", last)) and last not in _KINDS and last not in _OTHER_WORDS and before != "function":
                kinds["FunctionCall"] += 1
                calls["F" + last if last.startswith("$") else last] += 1
            elif text == "(" and (last in (")", "]") or last == "}" and depth and depth[-1] == "("):
                kinds["FunctionCall"] += 1
                calls["N/A"] += 1
            elif text == "(" and last not in _KINDS:
                kinds["ParenthesizedExpression"] += before != "function"
            if text in "([{":
                depth.append(text)
                kinds["ArrayLiteral"] += text == "[" and last in _BEFORE_REGEX
                kinds["ElementGet"] += text == "[" and last not in _BEFORE_REGEX
                kinds["Block"] += text == "{" and last in (")", "else", "try", "finally", "do")
                kinds["ObjectLiteral"] += text == "{" and last in ("(", ",", "=", ":", "[", "return")
            elif text in ")]}":
                if not depth or depth.pop() + text not in ("()", "[]", "{}"):
                    raise ValueError(f"unbalanced {text} at {at}")
        before, last = last, text
    if depth:
        raise ValueError(f"unclosed {depth[-1]}")
    return +kinds, calls, literals


@F.pandas_udf(RESULT)
def _analysed(code: pd.Series) -> pd.DataFrame:
    rows = []
    for x in code:
        try:
            code = bytes(x).decode("utf-8", "replace") if x is not None else ""
            kinds, calls, literals = analyse(unpack(code) if _IS_PACKED.search(code) else code)
            rows.append((dict(kinds), dict(calls), dict(literals), False, None))
        except ValueError as e:
            rows.append((None, None, None, True, str(e)))
    return pd.DataFrame(rows, columns=["statements_by_count", "calls_by_count", "literals_by_count", "failed", "stderr"])


def analysed(code: Column) -> Column:
    """struct of the three count maps, failed and stderr, for a script's bytes; a packed script is unpacked first."""
    return _analysed(code)


_IS_PACKED = re.compile(r"eval\s*\(\s*function\s*\(\s*p\s*,\s*a\s*,\s*c\s*,\s*k\s*,\s*e\s*,")
_PACKED = re.compile(r"}\s*\(\s*'((?:[^'\\]|\\.)*)'\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*'((?:[^'\\]|\\.)*)'\.split\('\|'\)", re.S)
_DIGITS = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ"


def unpack(code: str) -> str:
    """The script inside a packed one; ValueError if there is none."""
    found = _PACKED.search(code)
    if not found:
        raise ValueError("no packed script")
    payload, base, count, names = found[1], int(found[2]), int(found[3]), found[4].split("|")
    if not 2 <= base <= 62 or len(names) < count:
        raise ValueError("a damaged packed script")

    def number(word: str) -> int | None:
        n = 0
        for x in word:
            digit = _DIGITS.find(x)
            if digit < 0 or digit >= base:
                return None
            n = n * base + digit
        return n

    def name(match: re.Match) -> str:
        n = number(match[0])
        return names[n] if n is not None and n < len(names) and names[n] else match[0]

    return re.sub(r"\b\w+\b", name, payload.replace("\\'", "'").replace("\\\\", "\\"))


@F.pandas_udf(T.StringType())
def _unpacked(code: pd.Series) -> pd.Series:
    def one(x: str | None) -> str | None:
        try:
            return unpack(x) if x is not None and _IS_PACKED.search(x) else x
        except ValueError:
            return None

    return code.map(one)


def unpacked(code: Column) -> Column:
    """The script inside a packed one, other scripts as they are; null for one that cannot be unpacked."""
    return _unpacked(code)
