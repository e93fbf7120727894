"""Configuration reads in Java sources: a table of invocations, and plans that say what they mean.

A small helper lexes one file at a time and emits one row per method call, constructor call and annotation, with its
arguments as text and, where they fold, as literals.  Which of these are configuration reads is decided by a table of
rules and column expressions, as with user rules.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from collections.abc import Callable, Iterator
from functools import reduce
from json.encoder import encode_basestring_ascii

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import keys as K
from ..functions.placeholders import nested_placeholders
from ..operators.rules import match_annotations, match_methods
from ..shared import shuffled, written
from .detectors import ENTRY, _union, entries
from .leaves import leaves

#: The tokens of a text, line breaks between them, and comments.
_TOKEN = re.compile(r'[A-Za-z_$][\w$]*|//[^\n]*|/\*.*?\*/|"""[ \t]*\n.*?"""|"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\])\'|\d[\w.]*|->|::|[-+*/%&|^!=<>]=|&&|\|\||[^\s\w]|\n', re.S)
_WORDS = frozenset("if for while switch catch synchronized return throw else do try case new instanceof assert super this".split())
_OPERATORS = frozenset("+ - * / % & | ^ = == != <= >= < > && || ? : -> += -=".split())
_OPEN, _CLOSE = frozenset("([{"), frozenset(")]}")
_TYPES = frozenset("class interface enum record".split())
_MODIFIERS = frozenset("public private protected static final abstract sealed".split())
#: Tokens that say how a file is built; all others are passed over.
_MARKS = _OPEN | _CLOSE | _TYPES | frozenset("= @ import new".split())
#: Those among them that classes and constants, and that invocations, are told by.
_HEADS, _INVOKED = _TYPES | {"=", "new"}, frozenset("( @ import".split())
#: Tokens that an expression shows with spaces.
_SPACED = _OPERATORS | {",", "new"}
#: What a name begins with.
_NAME = frozenset(string.ascii_letters + "_$")

ARGUMENT = "struct<name:string,text:string,literal:string,value:string,strings:array<string>,concat:boolean,pairs:array<struct<key:string,value:string>>>"
INVOCATIONS = f"scan_id string, path string, scope string, seq int, line int, symbol string, form string, name string, args array<{ARGUMENT}>, target string, error string"

#: What a name of a constant stands for, if anything.
Known = Callable[[str], "str | None"]


def _unescape(s: str) -> str:
    if "\\" not in s:
        return s
    return re.sub(r"\\(?:u+([0-9a-fA-F]{4})|(.))", lambda m: chr(int(m[1], 16)) if m[1] else {"n": "\n", "t": "\t", "r": "\r", "s": " "}.get(m[2], m[2]), s, flags=re.S)


def _string(token: str) -> str | None:
    """The value of a string literal; None of another token."""
    if token[0] != '"':
        return None
    if not token.startswith('"""'):
        return token[1:-1] if "\\" not in token else _unescape(token[1:-1])
    rows = token[3:-3].partition("\n")[2].split("\n")
    pad = min((len(r) - len(r.lstrip()) for r in rows if r.strip()), default=0)
    return _unescape("\n".join([r[pad:] for r in rows]))


#: What a token that goes over lines holds.
_OVER_LINES = ("/*", '"""', "\\\n", "'\n")


def _lex(text: str) -> tuple[list[str], list[int]]:
    """The tokens of a text without its comments, and their lines."""
    tokens, lines, line = [], [], 1
    if not any(x in text for x in _OVER_LINES):
        for line, row in enumerate(text.split("\n"), 1):
            found = _TOKEN.findall(row)
            if found and found[-1].startswith("//"):
                found.pop()
            tokens += found
            lines += [line] * len(found)
        return tokens, lines
    for x in _TOKEN.findall(text):
        c = x[0]
        if c == "\n":
            line += 1
        elif c in "/\"'":
            if x[:2] not in ("//", "/*"):
                tokens.append(x)
                lines.append(line)
            line += x.count("\n")
        else:
            tokens.append(x)
            lines.append(line)
    return tokens, lines


def _shown(tokens: list[str]) -> str:
    """Expression text with one spelling of its spaces."""
    if _SPACED.isdisjoint(tokens):
        return "".join(tokens)
    out = []
    for i, t in enumerate(tokens):
        if t == ",":
            out.append(", ")
        elif t in _OPERATORS and i and not (t in "<>" and "." not in out[-1][-1:] and tokens[i - 1][:1].isupper()):
            out.append(f" {t} ")
        elif t == "new":
            out.append("new ")
        else:
            out.append(t)
    return "".join(out).strip() if len(tokens) > 1 else tokens[0]


def _split(tokens: list[str]) -> list[list[str]]:
    if "," not in tokens:
        return [tokens] if tokens else []
    parts, depth, angle, begun = [], 0, 0, 0
    for i, t in enumerate(tokens):
        if t in _OPEN:
            depth += 1
        elif t in _CLOSE:
            depth -= 1
        elif t == "<" and i and tokens[i - 1][:1].isupper():
            angle += 1
        elif t == ">" and angle:
            angle -= 1
        elif t == "," and not depth and not angle:
            parts.append(tokens[begun:i])
            begun = i + 1
    parts.append(tokens[begun:])
    return [p for p in parts if p]


def _literal(tokens: list[str], known: Known) -> str | None:
    """The text that a literal, a constant or a sum of these folds to; of an array its first element."""
    if len(tokens) == 1:
        t = tokens[0]
        return known(t) if t[0] in _NAME else _string(t)
    if tokens and tokens[0] == "{":
        inner = _split(tokens[1:-1])
        return _literal(inner[0], known) if inner else None
    parts, out = [[]], ""
    if "+" not in tokens:
        parts, tokens = [tokens], []
    for t in tokens:
        if t == "+":
            parts.append([])
        else:
            parts[-1].append(t)
    for p in parts:
        text = _string(p[0]) if len(p) == 1 else None
        if text is None and p and p[0][0] in _NAME and all(x == "." if i % 2 else x[0] in _NAME for i, x in enumerate(p)):
            text = known("".join(p))
        if text is None:
            return None
        out += text
    return out


def _value(tokens: list[str], known: Known) -> str | None:
    """As ``_literal``, and the text of a number, a boolean or a character."""
    if len(tokens) == 1:
        t = tokens[0]
        if t[0].isdecimal():
            return t.rstrip("LlFfDd")
        if t[0] == "'" or t in ("true", "false"):
            return t.strip("'")
    return _literal(tokens, known)


def _call(tokens: list[str]) -> tuple[str, list[list[str]]]:
    """Name and arguments of an expression that is one call of a plain name."""
    if "(" not in tokens or tokens[-1] != ")":
        return "", []
    at = tokens.index("(")
    name = re.sub(r"<.*>", "", "".join(tokens[:at]))
    return (name, _split(tokens[at + 1:-1])) if re.fullmatch(r"[\w$.]+", name) else ("", [])


def _pairs(tokens: list[str], known: Known) -> list[dict]:
    """Keys and values of a map made in place, those whose keys fold."""
    if tokens[-1] != ")" or "Map" not in tokens:
        return []
    name, args = _call(tokens)
    cells: list = []
    if re.search(r"(^|\.)Map\.of$", name):
        cells = list(zip(args[::2], args[1::2]))
    elif re.search(r"(^|\.)Map\.ofEntries$", name):
        made = map(_call, args)
        cells = [(a[0], a[1]) for n, a in made if re.search(r"(^|\.)Map\.entry$", n) and len(a) > 1]
    folded = [(_literal(k, known), _value(v, known)) for k, v in cells]
    return [{"key": k, "value": v} for k, v in folded if k is not None and k.strip()]


def _argument(tokens: list[str], known: Known, named: bool) -> dict:
    name = None
    if named and len(tokens) > 2 and tokens[1] == "=":
        name, tokens = tokens[0], tokens[2:]
    if len(tokens) == 1:
        t = tokens[0]
        if t[0] == '"':
            literal = value = _string(t)
        else:
            literal, value = known(t) if t[0] in _NAME else None, _value(tokens, known)
        return {"name": name, "text": t, "literal": literal, "value": value, "strings": [] if literal is None else [literal], "concat": t == "+", "pairs": []}
    literal = _literal(tokens, known)
    folded = [_literal(p, known) for p in _split(tokens[1:-1])] if tokens[0] == "{" else [literal]
    strings = [s for s in folded if s is not None] or [_string(t) for t in tokens if t[0] == '"']
    depth, concat = 0, False
    for t in tokens if "+" in tokens else ():
        depth += (t in _OPEN) - (t in _CLOSE)
        concat |= t == "+" and not depth
    return {"name": name, "text": _shown(tokens), "literal": literal, "value": literal, "strings": strings, "concat": concat, "pairs": _pairs(tokens, known)}


def _arguments(tokens: list[str], known: Known, named: bool) -> list[dict]:
    return [_argument(p, known, named) for p in _split(tokens)]


def _unknown(name: str) -> None:
    """What a name means in a file without constants."""


class Scopes:
    """Classes of a file, with the places where they begin and end, and their constant texts by qualified name."""

    def __init__(self, t: list[str], ends: dict[int, int], heads: list[int]):
        self.spans: list[tuple[int, int, str]] = []  # (first token, last token, name); an anonymous class has no name
        for i in heads:
            x = t[i]
            if x in _TYPES and i + 1 < len(t) and t[i + 1][0] in _NAME and (i == 0 or t[i - 1] != "."):
                opened = next((k for k in range(i + 2, len(t)) if t[k] in ("{", ";")), None)
                if opened is not None and t[opened] == "{":
                    self.spans.append((self._head(t, i), ends.get(opened, len(t)), t[i + 1]))
            elif x == "new":
                k = i + 1
                while k < len(t) and (t[k] in ".<>,?&@" or t[k][0] in _NAME):
                    k += 1
                if k < len(t) and t[k] == "(" and k in ends and ends[k] + 1 < len(t) and t[ends[k] + 1] == "{":
                    self.spans.append((ends[k] + 1, ends.get(ends[k] + 1, len(t)), ""))
        self.spans.sort()
        self.edges = sorted({x for a, b, _ in self.spans for x in (a, b + 1)})  # the classes around a place change here only
        self.chains: dict[int, list[str]] = {}
        self.package = ""
        if "package" in t[:2]:
            i = t.index("package")
            self.package = "".join(t[i + 1:t.index(";", i)]) if ";" in t[i:] else ""
        self.found: list[tuple[int, str, list[str]]] = []
        self.named: dict[str, list[tuple[int, str]]] = {}  # places and qualified names by simple name
        self.values: dict[str, str] = {}
        if "static" in t and "final" in t:
            self._constants(t, heads)

    @staticmethod
    def _head(t: list[str], i: int) -> int:
        """Where a declaration begins: behind what ends the one before, with its annotations and modifiers."""
        depth = 0
        while i and (depth or t[i - 1] not in ("{", "}", ";")):
            depth += (t[i - 1] in _CLOSE) - (t[i - 1] in _OPEN)
            if depth < 0:
                break
            i -= 1
        return i

    def chain(self, i: int) -> list[str]:
        """Names of the classes around a place, outermost first."""
        k = bisect_right(self.edges, i)
        if k not in self.chains:
            self.chains[k] = [name for a, b, name in self.spans if a <= i <= b]
        return self.chains[k]

    def symbol(self, i: int) -> str | None:
        """The class that a place lies in: its simple name, empty in an anonymous class, None outside of all."""
        chain = self.chain(i)
        return chain[-1] if chain else None

    def _constants(self, t: list[str], heads: list[int]) -> None:
        for i in heads:
            if t[i] == "=" and 0 < i < len(t) - 1 and t[i - 1][0] in _NAME and {"static", "final"} <= set(t[self._head(t, i - 1):i - 1]):
                depth, k = 0, i + 1
                while k < len(t) and (depth or t[k] not in (";", ",")):
                    depth += (t[k] in _OPEN) - (t[k] in _CLOSE)
                    k += 1
                self.found.append((i, ".".join([*self.chain(i), t[i - 1]]), t[i + 1:k]))
        for place, full, _ in self.found:
            self.named.setdefault(full.rpartition(".")[2], []).append((place, full))
        left = self.found
        while left:  # a constant may stand below its use, or be made of others
            folded = [(name, v) for i, name, e in left if (v := _literal(e, self.at(i))) is not None]
            if not folded:
                break
            for name, v in folded:
                self.values.setdefault(name, v)
            left = [c for c in left if c[1] not in self.values]

    def at(self, i: int) -> Known:
        """What a name means at a place: the constant of the innermost class around it that has one of the name, also where
        a class is named first, also by its package.  A plain name that no class around has is that of another class of
        the file, of several the last above the place, else the first below; a class of another file is not known."""
        if not self.values:
            return _unknown
        chain = self.chain(i)

        def known(name: str) -> str | None:
            parts = name.split(".")
            if self.package and name.startswith(self.package + "."):
                parts, around = name.removeprefix(self.package + ".").split("."), [[]]
            else:
                around = [chain[:k] for k in range(len(chain), -1, -1)]
            for outer in around:
                value = self.values.get(".".join([*outer, *parts]))
                if value is not None:
                    return value
            if len(parts) > 1:
                return None
            named = [(place, full) for place, full in self.named.get(name, ()) if full in self.values]
            above = [full for place, full in named if place < i]
            return self.values[above[-1]] if above else self.values[named[0][1]] if named else None

        return known


def invocations(text: str) -> Iterator[tuple[int, str | None, str, str, list[dict], str | None]]:
    """(line, class, form, name, arguments, what an annotation stands on) in the order of the source; of an annotation
    type that is annotated, its full name behind an ``@``.  The package and the imports of a file are rows too."""
    t, lines = _lex(text)
    ends, stack, heads, invoked = {}, [], [], []
    for i, x in enumerate(t):
        if x not in _MARKS:
            continue
        if x in _OPEN:
            stack.append(i)
        elif x in _CLOSE:
            if stack:
                ends[stack.pop()] = i
        elif x in _HEADS:
            heads.append(i)
        if x in _INVOKED:
            invoked.append(i)
    begins, scopes = {b: a for a, b in ends.items()}, Scopes(t, ends, heads)
    if scopes.package:
        yield 1, None, "package", scopes.package, [], None
    for i in invoked:
        x = t[i]
        if x == "(":
            before = t[i - 1] if i else ""
            if before[:1] not in _NAME or before in _WORDS or i not in ends:
                continue
            a = i - 1
            while a >= 2 and t[a - 1] == ".":
                b = a - 2
                while b >= 0 and t[b] in (")", "]") and b in begins:
                    b = begins[b] - 1
                if b < 0 or t[b][0] not in _NAME and t[b][0] != '"':
                    break
                a = b
                if a >= 1 and t[a - 1] == "new":
                    a -= 1
                    break
            before = t[a - 1] if a else ""
            if before == "@" or (a and t[a] != "new" and (before[:1] in _NAME and before not in _WORDS or before in (">", "]"))):
                continue  # an annotation, or a declaration
            args = _arguments(t[i + 1:ends[i]], scopes.at(i), False)
            if before == "new" and t[a] != "new":
                yield lines[a - 1], scopes.symbol(i), "new", "".join(t[a:i]), args, None
            else:
                yield lines[a], scopes.symbol(i), "call", _shown(t[a:i]), args, None
        elif x == "@" and i + 1 < len(t) and t[i + 1] != "interface":
            j = i + 2
            while j + 1 < len(t) and t[j] == ".":
                j += 2
            name = "".join(t[i + 1:j])
            args = []
            if j < len(t) and t[j] == "(" and j in ends:
                args = _arguments(t[j + 1:ends[j]], scopes.at(i), True)
                j = ends[j] + 1
            k = j
            while k + 1 < len(t) and t[k] == "@" and t[k + 1] != "interface":  # what comes after the annotations next to it
                k += 2
                if k < len(t) and t[k] == "(" and k in ends:
                    k = ends[k] + 1
            while k < len(t) and t[k] in _MODIFIERS:
                k += 1
            if k + 1 < len(t) and t[k] in _TYPES:
                target = t[k + 1]
            elif k + 2 < len(t) and t[k] == "@" and t[k + 1] == "interface":
                around = [c for c in scopes.chain(i) if c][:-1]  # but for the annotation type itself, whose head this is
                target = "@" + ".".join([*([scopes.package] if scopes.package else []), *around, t[k + 2]])
            else:
                target = t[k] if k < len(t) else None
            yield lines[i], scopes.symbol(i), "annotation", name, args, target
        elif x == "import" and not scopes.chain(i):
            stop = next((k for k in range(i, len(t)) if t[k] == ";"), len(t))
            yield lines[i], None, "import", "".join(t[i + 1:stop]).removeprefix("static"), [], None


def _packed(args: list[dict]) -> str:
    """Arguments as JSON, without members that are null."""
    text, out = encode_basestring_ascii, []
    for a in args:
        name, shown, literal, value, strings, concat, pairs = a.values()
        head = f'"text":{text(shown)}' if name is None else f'"name":{text(name)},"text":{text(shown)}'
        if literal is not None:
            one = text(literal)
            head += f',"literal":{one},"value":{one if value == literal else text(value)}'
            held = one if len(strings) == 1 and strings[0] == literal else ",".join(map(text, strings))
        else:
            head += "" if value is None else f',"value":{text(value)}'
            held = ",".join(map(text, strings))
        made = ",".join([f'{{"key":{text(p["key"])}}}' if p["value"] is None else f'{{"key":{text(p["key"])},"value":{text(p["value"])}}}' for p in pairs]) if pairs else ""
        out.append(f'{{{head},"strings":[{held}],"concat":{"true" if concat else "false"},"pairs":[{made}]}}')
    return f'[{",".join(out)}]'


def invocation_rows(files: DataFrame) -> DataFrame:
    """The invocations of all Java files; a file that fails gives one row with an error.  Arguments leave Python as JSON, since
    Arrow takes nested values one by one, and columns as Arrow arrays, which pandas passes on as they are."""
    def run(frames):
        for f in frames:
            columns: list[list] = [[] for _ in names]
            for scan_id, path, scope, content in zip(f["scan_id"], f["path"], f["scope"], f["content"]):
                try:
                    found = [(n, line, symbol, form, name, _packed(args), target, None) for n, (line, symbol, form, name, args, target) in enumerate(invocations(content or ""))]
                except Exception as e:
                    found = [(0, None, None, "error", "", "[]", None, f"{type(e).__name__}: {e}")]
                for values, column in zip(((scan_id,) * len(found), (path,) * len(found), (scope,) * len(found), *zip(*found)), columns):
                    column += values
            yield pd.DataFrame({n: pd.Series(pd.arrays.ArrowExtensionArray(pa.array(c, t)), copy=False) for n, c, t in zip(names, columns, types)}, copy=False)

    schema = T.StructType.fromDDL(INVOCATIONS)
    names = schema.fieldNames()
    types = [pa.int32() if n in ("seq", "line") else pa.string() for n in names]
    flat = T.StructType([T.StructField("args", T.StringType()) if x.name == "args" else x for x in schema.fields])
    rows = files.where("file_type = 'JAVA'").select("scan_id", "path", "scope", "content").mapInPandas(run, flat)
    return rows.withColumn("args", F.from_json("args", schema["args"].dataType, {"mode": "FAILFAST", "maxStringLen": str(2 ** 31 - 1)}))


# ---- rules -------------------------------------------------------------------------------------------------------

#: How a call that ends with ``suffix`` is read; fixed values.  ``key`` must be a literal, or the access is uncertain
#: where ``uncertain`` says so.
CALL_RULES = [
    # suffix, role, value from, default from, confidence, details, extra, uncertain
    *[(s, "READ", None, d, "HIGH", "java-system-property", None, True) for s, d in (
        ("getProperty", "last"), ("getRequiredProperty", None), ("containsProperty", None), ("System.getProperties().get", None), ("System.getProperties().getOrDefault", "1"),
        ("System.getProperties().containsKey", None), ("getenv", None), ("System.getenv().get", None), ("System.getenv().getOrDefault", "1"), ("System.getenv().containsKey", None),
        ("Integer.getInteger", "1"), ("Long.getLong", "1"), ("Boolean.getBoolean", None))],
    *[(s, "DEFINE", v, None, "HIGH", "java-system-property", None, True) for s, v in (
        ("setProperty", "last"), ("clearProperty", None), ("System.getProperties().put", "last"), ("System.getProperties().putIfAbsent", "last"), ("System.getProperties().replace", "last"), ("System.getProperties().remove", None))],
    ("getInitParameter", "READ", None, None, "MEDIUM", "external", "servlet-init-parameter", True),
    ("lookup", "READ", None, None, "MEDIUM", "external", "jndi-lookup", True),
]
#: Getters of configuration objects, preferences and bundles; fixed values.
_GENERIC = "getString getInt getLong getBoolean getDouble getDuration getStringList getIntList getLongList getBooleanList getDoubleList getConfig hasPath getValue getOptionalValue getConfigValue".split()
_PREFERENCES = "get getInt getLong getBoolean getFloat getDouble getByteArray".split()
_BUNDLE = ["getString", "getObject", "containsKey"]
#: Expressions of the expression language that name a property; fixed values.
_SPEL = [r"environment\[['\"]([^'\"]+)['\"]]", r"systemEnvironment\[['\"]([^'\"]+)['\"]]", r"systemProperties\[['\"]([^'\"]+)['\"]]", r"environment\.getProperty\(['\"]([^'\"]+)['\"]",
         r"systemEnvironment\.get\(['\"]([^'\"]+)['\"]", r"systemProperties\.getProperty\(['\"]([^'\"]+)['\"]", r"systemProperties\.get\(['\"]([^'\"]+)['\"]"]


def _attribute(*names: str) -> Column:
    """Literals of the first of the annotation's attributes that is there; the unnamed one counts as ``value``."""
    def of(n: str) -> Column:
        return F.flatten(F.transform(F.filter("args", lambda a: F.coalesce(a["name"], F.lit("value")) == n), lambda a: a["strings"]))

    out = of(names[0])
    for n in names[1:]:
        out = F.when(F.size(out) > 0, out).otherwise(of(n))
    return out


def _first(name: str) -> Column:
    return F.get(_attribute(name), F.lit(0))


#: What a reading of an invocation says, beside its place: columns of ``ENTRY``.
_SAID = ("role", "key", "raw", "default_raw", "profile", "confidence", "source_kind", "value_kind", "details_type", "extra", "namespace", "group", "data_id")


def _entry(key: Column, role: Column | str = "READ", **given: Column | str) -> Column:
    said = {"role": role, "key": key, "confidence": "HIGH", "source_kind": "JAVA", "value_kind": "JAVA", "details_type": "external"} | given
    as_column = lambda x: F.lit(x) if x is None or isinstance(x, str) else x
    return F.struct(*[as_column(said.get(n)).cast("string").alias(n) for n in _SAID])


#: A kind of reading: the form of invocation it reads, a condition on its name and the number of its arguments, and what it finds there.
Kind = tuple[str, "Column | None", Column]


def _if(form: str, condition: Column | None, found: Column) -> Kind:
    """An array of entries, those whose keys are no blanks."""
    return form, condition, F.filter(found, lambda x: F.trim(x["key"]) != "")


def _one(form: str, condition: Column, entry: Column, also: Column | None = None) -> Kind:
    """One entry; ``also`` is what its arguments must be."""
    filled = F.trim(entry["key"]) != ""
    return form, condition, F.when(filled if also is None else filled & also, F.array(entry))


def _met(rows: DataFrame, kinds: list[Kind], none: Column) -> DataFrame:
    """What all kinds find, in one pass over the invocations.

    Conditions have no functions over arrays: they are compiled, as one number with a bit for each kind that is met, and what
    kinds find is worked out for those alone.  Most invocations meet one kind at most, whose finds are taken as they are; arrays
    are put together where several are met.  A kind without a condition reads all invocations of its form.
    """
    met, forms = None, []
    for form in dict.fromkeys(f for f, _, _ in kinds):
        own, is_form = [(i, condition, x) for i, (f, condition, x) in enumerate(kinds) if f == form], F.col("form") == form
        some = [(F.lit(1 << i), condition, x) for i, condition, x in own if condition is not None]
        bits = reduce(Column.bitwiseOR, [F.when(condition, bit).otherwise(F.lit(0)) for bit, condition, _ in some])
        met = F.when(is_form, bits) if met is None else met.when(is_form, bits)
        one = F.when(F.col("met") == 0, none)
        for bit, _, x in some:
            one = one.when(F.col("met") == bit, x)
        one = one.otherwise(F.concat(*[F.coalesce(F.when(F.col("met").bitwiseAND(bit) != 0, x), none) for bit, _, x in some]))
        always = [x for _, condition, x in own if condition is None]
        forms.append((is_form, one if not always else F.concat(*[F.coalesce(x, none) for x in (*always, one)])))
    found = None
    for is_form, x in forms:
        found = F.when(is_form, x) if found is None else found.when(is_form, x)
    return rows.withColumn("met", met).select("scan_id", "path", "scope", "line", "symbol", F.inline(found))


def _read(rows: DataFrame, kinds: list[Kind]) -> DataFrame:
    """Entries of all kinds of reading."""
    out = _met(rows, kinds, F.array().cast(f"array<struct<{','.join(f'`{n}`:string' for n in _SAID)}>>"))
    given = {n: F.col(f"`{n}`") for n in _SAID if n != "role"}
    return entries(out, "java-source-config", F.col("role"), **given)


def _annotation_kinds() -> list[Kind]:
    form, name = "annotation", F.col("name")
    strings = F.filter(_strings(), lambda s: s.contains("nvironment") | s.contains("systemProperties"))  # as in all of _SPEL
    role = F.when(name.endswith("ConditionalOnExpression"), "CONDITION").otherwise("READ")
    spelt = lambda s: F.array_distinct(F.concat(*[F.regexp_extract_all(s, F.lit(p), 1) for p in _SPEL]))
    prefix, having = _first("prefix"), _first("havingValue")
    under = lambda n: F.when(F.trim(F.coalesce(prefix, F.lit(""))) == "", n).otherwise(F.concat_ws(".", prefix, n))
    filled = lambda names: F.filter(_attribute(*names), lambda x: F.trim(x) != "")
    nacos = name.endswith("NacosPropertySource")
    return [
        _if(form, None, F.flatten(F.transform(strings, lambda s: F.transform(spelt(s), lambda k: _entry(k, role))))),
        _if(form, name.endswith("ConfigurationProperties"), F.transform(filled(["prefix", "value"]), lambda k: _entry(k, confidence="MEDIUM", details_type="spring-configuration-properties", extra=F.col("target")))),
        _one(form, name.endswith("WebInitParam"), _entry(_first("name"), "DEFINE", raw=_first("value"), extra="web-init-param")),
        _if(form, name.endswith("ConditionalOnProperty"), F.transform(filled(["name", "value"]), lambda n: _entry(under(n), "CONDITION", default_raw=having, extra="conditional-on-property"))),
        _if(form, name.endswith("Profile"), F.transform(filled(["value"]), lambda x: _entry(F.lit("spring.profiles"), "METADATA", raw=x, profile=x, value_kind="STRING", extra="profile"))),
        _if(form, name.endswith("PropertySource") & ~nacos, F.transform(filled(["value"]), lambda x: _entry(F.lit("spring.property-source"), "METADATA", raw=x, value_kind="STRING", extra="property-source"))),
        _if(form, nacos, F.transform(filled(["dataId"]), lambda x: _entry(F.concat(F.lit("nacos.config."), x), "METADATA", details_type="config-center", data_id=x, group=_first("groupId"))))]


def _placeholder_entries(rows: DataFrame) -> DataFrame:
    """Placeholders in the texts of annotations and in what resolves them."""
    e = lambda f, role: entries(f.select("*", F.inline(nested_placeholders("s"))).withColumns({"default_raw": F.col("default_value"), "extra": F.col("raw")}).drop("raw"), "java-source-config", role, source_kind="JAVA", value_kind="JAVA", details_type="spring-placeholder")
    last = F.substring_index("name", ".", -1)
    resolved = (F.col("form") == "call") & last.isin("resolvePlaceholders", "resolveRequiredPlaceholders")
    texts = F.when(F.col("form") == "annotation", F.flatten(F.transform("args", lambda x: x["strings"]))).when(resolved, F.array(_arg(0)["literal"]))
    role = F.when((F.col("form") == "annotation") & F.col("name").endswith("ConditionalOnExpression"), "CONDITION").otherwise("READ")
    held = rows.where((F.col("form") == "annotation") | resolved).select("scan_id", "path", "scope", "line", "symbol", role.alias("role"), F.explode(texts).alias("s")).where(F.col("s").contains("${"))
    return e(held, F.col("role"))


def annotation_entries(rows: DataFrame) -> DataFrame:
    """Entries of annotations alone."""
    a = rows.where("form = 'annotation'")
    return _read(a, _annotation_kinds()).unionByName(_placeholder_entries(a))


def _arg(i: int) -> Column:
    return F.get("args", F.lit(i))


def _calls(rows: DataFrame) -> DataFrame:
    """Invocations with what is asked of calls: method, receiver, number of arguments and rule."""
    c = rows.withColumns({"method": F.substring_index("name", ".", -1), "n": F.size("args")})
    return c.withColumns({"receiver": F.lower(F.expr("substr(name, 1, greatest(length(name) - length(method) - 1, 0))")), "rule": _rule()})


def _apollo() -> Column:
    return (F.col("method") == "getProperty") & F.col("name").rlike(r"^(com\.ctrip\.framework\.apollo\.)?ConfigService\.(getAppConfig\(\)|getConfig\()")


_RULE = ("suffix", "role", "value_from", "default_from", "confidence", "details", "extra", "uncertain")


#: The rules, those with the longest suffix first; a rule's number is its place here, from 1.
_BY_LENGTH = sorted(CALL_RULES, key=lambda r: -len(r[0]))


def _rule() -> Column:
    """The number of the rule whose suffix, the longest, ends a name; null where there is none, and for calls that another kind reads."""
    ends = lambda x: F.col("method") == x if "." not in x else (F.col("name") == x) | F.col("name").endswith("." + x)
    out = F.when(_apollo(), None)
    for i, r in enumerate(_BY_LENGTH, 1):
        out = out.when(ends(r[0]), i)
    return F.when((F.col("form") == "call") & F.col("method").isin(sorted({r[0].rpartition(".")[2] for r in CALL_RULES})), out)


def _of_rule(part: str) -> Column:
    """A part of an invocation's rule."""
    at = _RULE.index(part)
    return F.get(F.array(*[F.lit(r[at]).cast("boolean" if part == "uncertain" else "string") for r in _BY_LENGTH]), F.col("rule") - 1)


def _ruled() -> Column:
    return F.col("rule").isNotNull() & (F.col("n") > 0)


def _nacos() -> Column:
    return (F.col("method") == "getConfig") & (F.col("n") >= 2) & ((F.col("name") == "ConfigService.getConfig") | F.col("name").endswith(".ConfigService.getConfig"))


def _strings() -> Column:
    return F.flatten(F.transform("args", lambda a: a["strings"]))


def _split_at(t: Column) -> Column:
    """Where ``key=value`` or ``key:value`` is split: at the first of both signs; 0 where there is none."""
    return F.coalesce(F.array_min(F.filter(F.array(F.instr(t, "="), F.instr(t, ":")), lambda x: x > 0)), F.lit(0))


def _pair(t: Column) -> tuple[Column, Column]:
    """Key, null where there is none, and value of such a text."""
    at = _split_at(t)
    return F.when(at > 1, F.nullif(F.trim(F.substring(t, F.lit(1), at - 1)), F.lit(""))), F.trim(F.substring(t, at + 1, F.length(t)))


def _sets_defaults() -> Column:
    return F.col("method") == "setDefaultProperties"


def _builds_defaults() -> Column:
    return (F.col("method") == "properties") & F.col("name").contains("SpringApplicationBuilder")


def _started() -> Column:
    """Arguments with which an application is started, as structures: ``whole``, the argument, and ``set``, what it sets
    behind its dashes, null where it sets nothing.  An argument that does not fold is its expression."""
    first = F.when(F.col("name").contains("SpringApplicationBuilder"), 0).otherwise(1)

    def texts(a: Column) -> Column:
        array = a["text"].rlike(r"^(new String\[\] ?)?\{")
        folded = F.when(a["literal"].isNotNull() & ~array, F.array(a["literal"])).when(array & (F.size(a["strings"]) > 0), a["strings"])
        sets = lambda t: F.when(folded.isNotNull() & t.startswith("--"), F.substring(t, F.lit(3), F.length(t)))
        return F.transform(F.coalesce(folded, F.array(a["text"])), lambda t: F.struct(t.alias("whole"), sets(t).alias("set")))

    return F.flatten(F.transform(F.filter("args", lambda a, i: i >= first), texts))


def _starts() -> Column:
    return (F.col("method") == "run") & F.col("name").contains("SpringApplication")


def _call_kinds() -> list[Kind]:
    call, new, key, method, receiver, name, n, rule = "call", "new", _arg(0)["literal"], F.col("method"), F.col("receiver"), F.col("name"), F.col("n"), _of_rule
    last = F.get("args", n - 1)
    take = lambda part: F.when((rule(part) == "last") & (n > 1), last["value"]).when((rule(part) == "1") & (n > 1), _arg(1)["value"])
    space = F.when(name.contains("getAppConfig()"), "application").otherwise(F.nullif(F.regexp_extract("name", r'getConfig\("([^"]*)"\)\.getProperty$', 1), F.lit("")))
    generic = method.isin(_GENERIC) & (receiver.contains("config") | (receiver == "cfg")) & ~((method == "getConfig") & receiver.contains("configservice"))
    prefs = method.isin(_PREFERENCES) & (receiver.contains("preferences") | (receiver == "prefs") | receiver.endswith(".prefs"))
    bundle = method.isin(_BUNDLE) & (receiver.contains("resourcebundle") | (receiver == "bundle") | receiver.endswith(".bundle"))
    binder = method.isin("bind", "bindOrCreate") & name.contains("Binder.get(")
    asks = method.isin("acceptsProfiles", "matchesProfiles")
    profiles = (asks | (method == "setAdditionalProfiles") | (method == "profiles") & name.contains("SpringApplicationBuilder"))
    filled = F.filter(_strings(), lambda x: F.trim(x) != "")
    pairs = lambda i, extra: F.transform(_arg(i)["pairs"], lambda x: _entry(x["key"], "DEFINE", raw=x["value"], extra=extra))
    halves = lambda t, extra: (lambda k, v: _entry(k, "DEFINE", raw=v, extra=extra))(*_pair(t))
    resource = last["literal"]
    return [
        _one(call, _ruled(), _entry(key, rule("role"), raw=take("value_from"), default_raw=take("default_from"), confidence=rule("confidence"), details_type=rule("details"), extra=rule("extra")), (rule("suffix") != "lookup") | key.like("java:comp/env/%")),
        _one(call, _apollo(), _entry(key, default_raw=_arg(1)["value"], details_type="config-center", namespace=space)),
        _one(call, _nacos(), _entry(F.concat(F.lit("nacos.config."), key), "METADATA", details_type="config-center", data_id=key, group=_arg(1)["literal"]), F.trim(key) != ""),
        _one(call, generic, _entry(key, default_raw=F.when(~method.isin("getValue", "getOptionalValue", "getConfigValue"), _arg(1)["value"]), confidence="MEDIUM", extra="generic-config-getter")),
        _one(call, prefs, _entry(key, default_raw=_arg(1)["value"], confidence="MEDIUM", extra="preferences")), _one(call, bundle, _entry(key, confidence="MEDIUM", extra="resource-bundle")), _one(call, binder, _entry(key, extra="binder")),
        _if(call, profiles, F.transform(filled, lambda x: _entry(F.lit("spring.profiles"), F.when(asks, "CONDITION").otherwise("METADATA"), raw=x, profile=x, value_kind="STRING", extra=F.when(asks, "profile-condition").otherwise("additional-profile")))),
        _if(call, _starts(), F.transform(_started(), lambda x: halves(x["set"], "command-line-args"))),
        _if(call, (_sets_defaults() | _builds_defaults()) & (n == 1), pairs(0, "default-properties")), _if(call, _builds_defaults(), F.transform(_strings(), lambda t: halves(t, "default-properties"))),
        _if(new, name.endswith("MapPropertySource") & (n > 1), pairs(1, "map-property-source")),
        _one(new, name.endswith("ResourcePropertySource"), _entry(F.lit("spring.property-source"), "METADATA", raw=resource, value_kind="STRING", extra="resource-property-source"), F.trim(resource) != "")]


def invocation_entries(rows: DataFrame) -> DataFrame:
    """Entries of all annotations, calls and constructor calls."""
    return _read(_calls(rows), [*_annotation_kinds(), *_call_kinds()]).unionByName(_placeholder_entries(rows))


def uncertain_rows(rows: DataFrame) -> DataFrame:
    """Accesses whose key is not a literal: ``(scan_id, path, scope, line, symbol, expression, reason, root_sink)``, of all kinds in
    one pass."""
    key, n, name, text = _arg(0)["literal"], F.col("n"), F.col("name"), _arg(0)["text"]
    reason = F.when(_arg(0)["concat"], "STRING_CONCAT").otherwise("UNKNOWN")

    def u(expression: Column, why: Column | str, sink: Column | str) -> Column:
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(expression.cast("string").alias("expression"), as_column(why).alias("reason"), as_column(sink).alias("root_sink"))

    one = lambda condition, found, form="call": (form, condition, F.array(found))
    some = lambda condition, also, found: ("call", condition, F.when(also, F.array(found)))
    whole = F.concat(name, F.lit("("), F.array_join(F.transform("args", lambda a: a["text"]), ", "), F.lit(")"))
    unset = F.filter(_started(), lambda x: _pair(x["set"])[0].isNull())
    kinds = [
        some(_ruled(), _of_rule("uncertain") & key.isNull(), u(text, reason, name)), some(_apollo() & (n > 0), key.isNull(), u(text, reason, "apollo.getProperty")),
        one(name.endswith("System.setProperties") & (n > 0), u(text, "MAP_DRIVEN_KEY", name)),
        one(F.col("method").isin("readLine", "readPassword") & name.rlike(r"System\.console\(\)\.(readLine|readPassword)$"), u(F.coalesce(F.nullif(F.trim(_arg(0)["value"]), F.lit("")), whole), "USER_INPUT", name)),
        one(name.endswith("getInputArguments") & name.contains("ManagementFactory.getRuntimeMXBean()"), u(whole, "COMMAND_LINE_ARGS", name)),
        one(name.endswith("PropertiesPropertySource") & (n > 1), u(_arg(1)["text"], "MAP_DRIVEN_KEY", name), "new"), some(_sets_defaults() & (n > 0), F.size(_arg(0)["pairs"]) == 0, u(text, "MAP_DRIVEN_KEY", name)),
        ("call", _starts(), F.transform(unset, lambda x: u(x["whole"], "COMMAND_LINE_ARGS", name))), some(_nacos(), F.trim(F.coalesce(key, F.lit(""))) == "", u(text, reason, "nacos.getConfig"))]
    return _met(_calls(rows), kinds, F.array().cast("array<struct<expression:string,reason:string,root_sink:string>>"))


def user_rule_entries(rows: DataFrame, method_rules: DataFrame | None, annotation_rules: DataFrame | None) -> DataFrame | None:
    """Entries by user rules on calls and annotations."""
    at = lambda i: F.when(F.col(i) >= 0, F.get("args", F.col(i)))["value"]
    parts = []
    if method_rules is not None:
        calls = rows.where("form = 'call'").withColumns({"method": F.col("name"), "owner": F.col("name")})
        m = match_methods(calls, method_rules).withColumns({"key": at("rule_key_arg"), "raw": at("rule_value_arg"), "default_raw": at("rule_default_arg"), "extra": F.col("rule_id")}).where("trim(key) <> ''")
        parts.append(entries(m, "java-source-config", F.coalesce("rule_role", F.lit("READ")), source_kind="JAVA", value_kind="JAVA", confidence=F.coalesce("rule_confidence", F.lit("MEDIUM"))))
    if annotation_rules is not None:
        def attribute(column: str) -> Column:
            return F.get(F.flatten(F.transform(F.filter("args", lambda a: F.coalesce(a["name"], F.lit("value")) == F.col(column)), lambda a: F.array(a["value"]))), F.lit(0))

        m = match_annotations(rows.where("form = 'annotation'").withColumn("annotation", F.col("name")), annotation_rules)
        m = m.withColumns({"key": attribute("rule_key_attribute"), "raw": attribute("rule_value_attribute"), "default_raw": attribute("rule_default_attribute"), "extra": F.col("rule_id")}).where("trim(key) <> ''")
        parts.append(entries(m, "java-source-config", F.coalesce("rule_role", F.lit("READ")), source_kind="JAVA", value_kind="JAVA", confidence=F.coalesce("rule_confidence", F.lit("MEDIUM"))))
    return _union(*parts) if parts else None


def full_names(names: DataFrame, types: DataFrame, rows: DataFrame) -> DataFrame:
    """``(scan_id, path, name, full)`` of the names ``(scan_id, path, name)`` that mean one of ``types(scan_id, path, full)``.

    A name means, in this order, a type of its own file, what is imported by name or written out in full, a type of the
    file's package, and one of a package imported whole; types of one simple name in two packages stay apart.  Every rule
    makes full names that are looked up by an equi-join.
    """
    n = names.distinct().withColumns({"head": F.substring_index("name", ".", 1), "tail": F.expr("substr(name, length(substring_index(name, '.', 1)) + 1)")})
    at = ["scan_id", "path"]
    imports = rows.where("form = 'import'").select(*at, F.col("name").alias("imported")).distinct()
    package = rows.where("form = 'package'").groupBy(*at).agg(F.min("name").alias("package"))
    own = types.select(*at, "full", F.substring_index("full", ".", -1).alias("last"))
    beside = n.withColumn("last", F.substring_index("name", ".", -1)).join(shuffled(own), [*at, "last"]).where((F.col("full") == F.col("name")) | F.col("full").endswith(F.concat(F.lit("."), "name")))
    by_name = n.join(shuffled(imports.where("imported not like '%*'").withColumn("head", F.substring_index("imported", ".", -1))), [*at, "head"]).withColumn("full", F.concat("imported", "tail"))
    local = n.join(shuffled(package), at, "left").withColumn("full", F.concat_ws(".", "package", "name"))
    whole = n.join(shuffled(imports.where("imported like '%.*'")), at).withColumn("full", F.concat(F.regexp_replace("imported", "[*]$", ""), "name"))
    rules = (beside, by_name.unionByName(n.where("name like '%.%'").withColumn("full", F.col("name")), allowMissingColumns=True), local, whole)
    guesses = _union(*[f.select(*at, "name", "full", F.lit(k).alias("rule")) for k, f in enumerate(rules)])
    known = guesses.join(shuffled(types.select("scan_id", "full").distinct()), ["scan_id", "full"], "left_semi")
    return known.groupBy(*at, "name").agg(F.min_by("full", F.struct("rule", "full")).alias("full"))


def meta_annotation_entries(rows: DataFrame, layers: int = 1) -> DataFrame:
    """Uses of annotations that carry a value placeholder themselves, within each scan and by full names.  With more
    ``layers``, also of annotations that carry such an annotation, as many times over, or until nothing is new."""
    a = rows.where("form = 'annotation'").select("scan_id", "path", "scope", "line", "symbol", "name", "target", "args")
    declares = a.where(F.col("target").startswith("@")).withColumn("owner", F.expr("substr(target, 2)"))
    types = declares.select("scan_id", "path", F.col("owner").alias("full")).distinct()
    held = declares.where(F.substring_index("name", ".", -1) == "Value").select("scan_id", F.col("owner").alias("full"), F.explode(_attribute("value")).alias("s"))
    held = held.select("scan_id", "full", F.inline(nested_placeholders("s"))).select("scan_id", "full", "key").distinct()
    named = full_names(a.select("scan_id", "path", "name"), types, rows)
    if layers > 1:
        named, all_ = written(named, "annotation-names"), written(held, "annotation-keys")
        carries = written(declares.select("scan_id", "path", "name", "owner").join(shuffled(named), ["scan_id", "path", "name"]).select("scan_id", "full", "owner").distinct(), "annotation-layers")
        fresh = all_
        for _ in range(layers - 1):
            fresh = fresh.join(shuffled(carries), ["scan_id", "full"]).select("scan_id", F.col("owner").alias("full"), "key").distinct()
            fresh = written(fresh.join(shuffled(all_), ["scan_id", "full", "key"], "left_anti"), "annotation-keys")
            if fresh.isEmpty():
                break
            all_ = written(all_.unionByName(fresh), "annotation-keys")
        held = all_
    used = a.join(shuffled(named), ["scan_id", "path", "name"]).join(shuffled(held), ["scan_id", "full"]).select("scan_id", "path", "scope", "line", "symbol", "key")
    return entries(used, "codegraph-config-usage", "READ", source_kind="JAVA", value_kind="JAVA", confidence="MEDIUM")


def _sourced(rows: DataFrame, method_rules: DataFrame | None, annotation_rules: DataFrame | None) -> DataFrame:
    """Entries of the invocations that could name a source of properties.  Placeholders have no value and name none."""
    key = lambda x: x.contains("spring.property-source")
    written_out = F.exists("args", lambda a: key(a["literal"]) | F.exists(a["strings"], key) | F.exists(a["pairs"], lambda x: key(x["key"])))
    own = rows.where(F.col("name").endswith("PropertySource") | written_out)
    out = _read(_calls(own), [*_annotation_kinds(), *_call_kinds()])
    ruled = user_rule_entries(own, method_rules, annotation_rules)
    return out if ruled is None else out.unionByName(ruled)


def java_entries(files: DataFrame, method_rules: DataFrame | None = None, annotation_rules: DataFrame | None = None, meta: bool = False,
                 rows: DataFrame | None = None, scalars: DataFrame | None = None, provider: Callable[[DataFrame], DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """Entries and uncertain accesses of Java files, and entries of the local property files that they name.

    ``rows`` and ``scalars`` are the invocations and the scalars of the files where these have been read already;
    ``provider`` makes entries of the invocations in place of the built-in reading of annotated annotations.
    """
    rows = invocation_rows(files) if rows is None else rows
    scalars = leaves(files) if scalars is None else scalars
    found = invocation_entries(rows)
    ruled = user_rule_entries(rows, method_rules, annotation_rules)
    found = found if ruled is None else found.unionByName(ruled)
    sourced = _sourced(rows, method_rules, annotation_rules)
    if provider is not None:
        found, sourced = (f.unionByName(given) for given in (provider(rows),) for f in (found, sourced))
    elif meta:  # uses of annotated annotations have no value and name no source
        found = found.unionByName(meta_annotation_entries(rows))
    named = sourced.where("key = 'spring.property-source'").select("scan_id", "symbol", F.col("raw").alias("location"), F.regexp_replace("raw", "^optional:", "").alias("t"))
    local = named.where("t like 'classpath:%' or t like 'file:%'").select("scan_id", "location", "symbol", F.when(F.col("t").startswith("classpath:"), F.concat(F.lit("src/main/resources/"), F.regexp_replace("t", "^classpath:/?", ""))).otherwise(F.regexp_replace("t", r"^file:(\./)?", "")).alias("path"))
    local = local.where("path like '%.properties'").groupBy("scan_id", "path").agg(F.min(F.struct("location", "symbol")).alias("m")).select("scan_id", "path", "m.*")
    read = scalars.where("error is null").drop("profile").join(shuffled(local), ["scan_id", "path"]).withColumns({"key": F.get("segs", F.lit(0)), "raw": F.col("value")})
    e = lambda f, role, **g: entries(f, "java-source-config", role, source_kind="PROPERTIES", value_kind="JAVA", **g)
    own = e(read.withColumn("extra", F.lit("property-source-file")), "DEFINE")
    held = read.where("value like '%${%'").drop("key", "raw").select("*", F.inline(nested_placeholders("value", deep=False))).drop("raw")
    reads = e(held.withColumns({"default_raw": F.col("default_value"), "extra": F.col("location")}), "READ", details_type="spring-placeholder")
    return _union(found, own, reads).select(*ENTRY), uncertain_rows(rows)


def uncertain_findings(rows: DataFrame, like: DataFrame) -> DataFrame:
    """Uncertain accesses in the layout of the findings ``like``."""
    kinds = dict(like.dtypes)
    given = {
        "scan_id": F.col("scan_id"), "kind": F.lit("UNCERTAIN"), "expression": F.col("expression"), "reason": F.col("reason"), "root_sink": F.col("root_sink"), "confidence": F.lit("LOW"), "detector_id": F.lit("java-source-config"),
        "source": F.struct("path", "line", "symbol", F.lit("JAVA").alias("source_kind"), "scope"),
        "environment": F.struct(*[F.lit(None).cast("string").alias(n) for n in ("profile", "region", "namespace")])}
    return rows.select(*[given.get(c, F.lit(None)).cast(kinds[c]).alias(c) for c in like.columns])


def rule_tables(spark: SparkSession, rules: dict) -> dict[str, DataFrame | None]:
    """Rule tables from a parsed rules document: ``methodCalls``, ``annotations`` and ``files``."""
    from ..schema import ANNOTATION_RULES, FILE_RULES, METHOD_RULES

    def table(name: str, ddl: str, fields: list[str]) -> DataFrame | None:
        rows = [tuple(r.get(f) for f in fields) + ((i,) if name == "files" else ()) for i, r in enumerate(rules.get(name) or [])]
        return spark.createDataFrame(rows, ddl) if rows else None

    return {
        "method_rules": table("methodCalls", METHOD_RULES, ["id", "owner", "method", "keyArg", "defaultArg", "valueArg", "confidence", "role"]),
        "annotation_rules": table("annotations", ANNOTATION_RULES, ["id", "type", "keyAttribute", "valueAttribute", "defaultAttribute", "confidence", "role"]),
        "file_rules": table("files", FILE_RULES, ["id", "pattern", "format", "scope"])}
