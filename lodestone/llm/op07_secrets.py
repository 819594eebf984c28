r"""Secret scans by assignment-aware lexing.

A document is lexed for assignments, in source code and configuration alike: `name = "x"`, `:=`, `=>`, `name: "x"`,
`"name": "x"`, `d["name"] = "x"`, typed targets (`name: str = "x"`), KEY=value and key: value at the start of a line, XML
elements, pairs in calls (`define("NAME", "x")`) and flags (`--name x`). Its right side is an expression of literals and
names joined by + . .. ~ or adjacency, with interpolation; constants assigned further up are put in for names,
so `a = "x"; password = a + "y"` gives password the literal "xy". `f("x")` counts as "x" unless f fetches
a setting, and in `get() or "x"` the literal counts.

Each name-literal pair is scored: the weight of the name's sensitive parts (camelCase and separators split it; parts such as
`field`, `name`, `url` or `length` make it harmless) times a factor of the literal, its bits of entropy over what is due for such a name, and
nearly 0 for placeholders. Pairs of `threshold` or more are secrets. Known key formats count as fully random.

Only documents in which a stem of a sensitive name occurs are lexed; the stems come from the tables of weights, so without one no pair can score.
Names, calls, indentation and lines may be of any length: places of line ends and brackets are tabled once, so that nothing is looked for twice.
A constant put in for names so often that it would be longer than its whole text isn't a constant any more.

Defined results: null and empty texts have no secrets; each row is scanned for itself, repeated rows and null ids too;
places are in characters; the literal itself isn't returned, but its place, length and sha256;
other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import arrays as A

THRESHOLD = 0.5
PARTS = {"password": 1.0, "passwd": 1.0, "pwd": 1.0, "pass": 0.8, "passphrase": 1.0, "passcode": 0.8, "secret": 1.0, "secrets": 0.9, "token": 0.9, "tokens": 0.7, "apikey": 1.0, "credential": 0.9, "credentials": 0.9, "auth": 0.7, "authorization": 0.9, "bearer": 0.9, "signature": 0.6, "dsn": 0.6, "key": 0.3}
PAIRS = {("api", "key"): 1.0, ("access", "key"): 1.0, ("private", "key"): 1.0, ("secret", "key"): 1.0, ("signing", "key"): 0.9, ("encryption", "key"): 0.9, ("account", "key"): 0.9, ("shared", "key"): 0.8, ("auth", "key"): 0.9, ("connection", "string"): 0.8, ("conn", "str"): 0.8}
GLUED = re.compile(r"(api_?key|access_?key|secret_?key|private_?key|password|passwd|passphrase|secret|token|credential)", re.I)


def _stems() -> str:
    """What occurs in any text with a name of some weight: a part, one of a pair, or the letters of a glued form, which separators may part."""
    whole = {*PARTS, *(a for a, b in PAIRS if a not in PARTS and b not in PARTS)}
    whole = {s for s in whole if not any(o in s for o in whole - {s})}
    glued = {s.replace("_?", "") for s in GLUED.pattern.strip("()").split("|")}
    return "(?i)" + "|".join([*sorted(whole), *("[^a-zA-Z0-9]*+".join(s) for s in sorted(glued))])


STEMS = _stems()
HARMLESS = frozenset("name names field fields label url uri path file filename dir type types length len size min max count limit hint prompt placeholder title regex pattern policy expiry expires expiration ttl id ids index column public format prefix suffix header error message msg description required enabled valid strength rules test mock".split())
PLACEHOLDER = re.compile(r"(?i)^(?:changeme|change[_-]?me|example|sample|dummy|none|null|nil|undefined|true|false|todo|tbd|fixme|redacted|hidden|masked|secret|password|passwd|token|key|string|str|text|value|your|test|foo|bar|[x*.•_-]+|[<\[{(%$].*[>\]})%]?)$|(?i:your[_ -]|insert[_ -]|replace[_ -]|<[^>]+>|\$\{|\{\{|xxxx|\.\.\.)")
FORMATS = re.compile(r"^(?:AKIA[0-9A-Z]{16}|gh[pousr]_\w{30,}|xox[abprs]-[\w-]{10,}|[sr]k_(?:live|test)_\w{10,}|AIza[\w-]{30,}|eyJ[\w-]+\.eyJ[\w-]+\.[\w-]*|-----BEGIN [A-Z ]*PRIVATE KEY-----)")
FETCHES = re.compile(r"(?i)(?:env|get|read|load|input|find|fetch|lookup|param|prompt|request|query|select|resolve|format|len|hash|print|log|test|match|replace|split|join)")

_OP = re.compile(r"(?<![=!<>:+\-*/%&|^~?]):=(?!=)|(?<![=!<>:+\-*/%&|^~])=(?![=~])>?|(?<![:=]):(?![:/=])")
_NAME = re.compile(r"[A-Za-z_$@][\w$]*(?:(?:\.|->|::)[A-Za-z_$][\w$]*)*")
_WORD = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|\d+")
_JOIN = re.compile(r"[ \t]*(?:\n[ \t]*)?(?:\+|\.\.?|~|&|<>)[ \t]*(?:\\?\n[ \t]*)?(?=[\"'`A-Za-z_$@])|[ \t]*(?:\\\n[ \t]*)?(?=[\"'`A-Za-z_$@])")
_NEW = re.compile(r"(?:new|await|mut|const)[ \t]+")
_ELSE = re.compile(r"[ \t]*(?:\bor\b|\|\||\?\?|\?:)[ \t]*")
_PREFIX = re.compile(r"(?:[rRbBuUfF@$]{0,2})(\"\"\"|'''|[\"'`])")
_NUMBER = re.compile(r"\d[\w.]*")
_BARE = re.compile(r"(?:\$\{\w+\}|[^\s\"'<>(){}\[\],;#])+")
_HOLE = re.compile(r"\$?\{([A-Za-z_]\w*)\}|\$([A-Za-z_]\w*)|%\(([A-Za-z_]\w*)\)s")
_XML = re.compile(r"<([\w:.-]+)(?:\s[^<>]*)?>([^<>\n]+)</\1>")
_FLAG = re.compile(r"(?<!-)--([\w-]++)[ \t]+(?!-)(?:\"([^\"\n]*)\"|'([^'\n]*)'|([^\s\"'<>|;&]+))")
_CALL = re.compile(r"\(\s*([\"'])([\w.-]+)\1\s*,\s*([\"'])([^\"'\n]*)\3")
_LEADS = ("export ", "set ", "setx ", "declare ", "- ", "--", "ENV ", "ARG ")
_SOME = re.compile(r"\S")


def name_weight(name: str) -> float:
    parts = [w.lower() for w in _WORD.findall(name.rpartition(".")[2].rpartition(":")[2].rpartition(">")[2])]
    if not parts or parts[-1] in HARMLESS or "placeholder" in parts or "public" in parts:
        return 0.0
    best = max((PARTS.get(p, 0.0) for p in parts), default=0.0)
    best = max([best, *(PAIRS.get(p, 0.0) for p in zip(parts, parts[1:]))])
    if best < 0.8 and (m := GLUED.search("".join(parts))) and len(m[0]) >= 5:
        best = 0.9
    return best


def literal_factor(name: str, text: str) -> float:
    text = text.strip()
    if len(text) < 4 or len(set(text)) < 3 or PLACEHOLDER.search(text):
        return 0.02
    if FORMATS.match(text):
        return 1.0
    counts = Counter(text)
    bits = -sum(n * math.log2(n / len(text)) for n in counts.values())
    if " " in text and text.count(" ") >= 3:
        return 0.1  # a sentence
    low = name.lower()
    due = 16.0 if "pass" in low or "pwd" in low else 40.0
    if text.isalpha() and text.islower() and due > 16:
        bits *= 0.4  # a word rather than a key
    return min(1.0, bits / due)


def score(name: str, text: str) -> float:
    w = name_weight(name)
    return round(w * literal_factor(name, text), 4) if w else 0.0


class Lexer:
    """Name-literal pairs of one text, in order, with the constants met so far."""

    def __init__(self, text: str):
        self.text, self.constants = text, {}
        self.ends = [m.start() for m in re.finditer("\n", text)]
        self.opening = [m.start() for m in re.finditer(r"\[", text)]
        self.closing = [m.start() for m in re.finditer(r"\)", text)]
        self.after: dict[int, int] = {}  # where what isn't white space goes on

    def _line(self, at: int) -> tuple[int, int]:
        """Where the line of `at` begins and ends."""
        k = bisect.bisect_left(self.ends, at)
        return (self.ends[k - 1] + 1 if k else 0), (self.ends[k] if k < len(self.ends) else len(self.text))

    def _next(self, at: int) -> int:
        """The first place from `at` on that isn't white space."""
        if at not in self.after:
            m = _SOME.search(self.text, at)
            self.after[at] = m.start() if m else len(self.text)
        return self.after[at]

    def _leads(self, at: int) -> bool:
        """Whether nothing but white space, a declaring word and a quote stand before `at` on its line."""
        t, (low, _) = self.text, self._line(at)
        i = at - (at > low and t[at - 1] in "\"'")
        j = i
        while j > low and t[j - 1] in " \t":
            j -= 1
        if j == low:
            return True
        first = self._next(low)
        for word in _LEADS:
            bare = word.rstrip()
            if first == j - len(bare) and t.startswith(bare, first) and (word == bare or j < i and t[j] == " "):
                return True
        return False

    def _quoted(self, at: int) -> tuple[str, int, bool] | None:
        """The string literal at `at`: its text, its end, whether names were put in."""
        m = _PREFIX.match(self.text, at)
        if not m:
            return None
        mark, i = m[1], m.end()
        stop = len(self.text) if len(mark) == 3 or mark == "`" else self._line(i)[1]
        j = i
        while True:
            j = self.text.find(mark, j, stop)
            if j < 0:
                return None
            slashes = 0
            while j - 1 - slashes >= i and self.text[j - 1 - slashes] == "\\":
                slashes += 1
            if slashes % 2 == 0:
                break
            j += 1
        raw, changed = self.text[i:j], False

        def put(h: re.Match) -> str:
            nonlocal changed
            value = self.constants.get(h[1] or h[2] or h[3])
            changed |= value is not None
            return h[0] if value is None else value

        value = _HOLE.sub(put, raw) if mark != "'" and ("{" in raw or "$" in raw or "%" in raw) or "f" in m[0][:2].lower() else raw
        return value, j + len(mark), changed

    def expression(self, at: int) -> tuple[str | None, int, int, bool, bool]:
        """The constant at `at` (None if it isn't one), where its literals begin and end, whether any constant was put in, whether any literal was quoted."""
        parts: list[str] | None = []
        begin, end, put, quoted, first = at, at, False, False, True
        if m := _NEW.match(self.text, at):
            begin = end = at = m.end()
        while True:
            if found := self._quoted(at):
                if parts is not None:
                    parts.append(found[0])
                if first:
                    begin = at
                at, put, quoted = found[1], put | found[2], True
                end = at
            elif m := _NAME.match(self.text, at):
                name, after = m[0], m.end()
                if self.text.startswith("(", after):
                    inner = None if FETCHES.search(name.rpartition(".")[2]) else self._quoted(after + 1)
                    k = bisect.bisect_left(self.closing, after)
                    close = self.closing[k] if k < len(self.closing) else -1
                    if inner and self.text.startswith(")", inner[1]):
                        if parts is not None:
                            parts.append(inner[0])
                        if first:
                            begin = after + 1
                        quoted, end, at = True, inner[1], inner[1] + 1
                    else:
                        parts, at = None, (close + 1 if close > 0 else after)
                else:
                    value = self.constants.get(name, self.constants.get(name.rpartition(".")[2]))
                    if value is None:
                        parts = None
                    elif parts is not None:
                        parts.append(value)
                        put = True
                    at = after
                    end = at if parts is not None else end
            elif (m := _NUMBER.match(self.text, at)) and first:
                return m[0], at, m.end(), False, False
            else:
                break
            first = False
            if alt := _ELSE.match(self.text, at):
                if parts is None:
                    parts, at, first = [], alt.end(), True
                    begin = end = at
                    continue
                break
            joined = _JOIN.match(self.text, at)
            if not joined or joined.end() == at or not joined[0].strip(" \t") and not _PREFIX.match(self.text, joined.end()):
                break
            at = joined.end()
        if put and parts and sum(map(len, parts)) > len(self.text):
            parts = None
        return ("".join(parts) if parts else None), begin, end, put, quoted

    def _target(self, at: int) -> tuple[str, int] | None:
        """The name that ends before `at`, and where it begins."""
        t, i = self.text, at
        while True:
            while i > 0 and t[i - 1] in " \t":
                i -= 1
            if i == 0:
                return None
            if t[i - 1] != "]":
                break
            k = bisect.bisect_left(self.opening, i) - 1
            if k < 0:
                return None
            j = self.opening[k]
            first = self._next(j + 1)
            if t[first] in "\"'" and first < i - 2:
                close = t.find(t[first], first + 1, i - 1)
                if close > first + 1 and self._next(close + 1) == i - 1:
                    return t[first + 1 : close], j
            i = j
        low = self._line(i - 1)[0]
        if t[i - 1] in "\"'":
            j = t.rfind(t[i - 1], low, i - 1)
            name = t[j + 1 : i - 1]
            return (name, j) if j >= 0 and name else None
        j = i
        while j > low and (t[j - 1].isalnum() or t[j - 1] in "_.-$>:" and not t[j - 1 : j + 1] == "->" or t[j - 1] == "-"):
            j -= 1
        name = t[j:i].lstrip(".->:$")
        return (name, i - len(name)) if name and not name[0].isdigit() else None

    def run(self) -> Iterator[tuple[str, str, int, int, bool]]:
        t = self.text
        for m in _OP.finditer(t):
            target = self._target(m.start())
            if not target:
                continue
            name, start = target
            op = m[0].strip()
            if op == "=":  # a type stands between name and sign
                k = start
                while k > 0 and t[k - 1] in " \t":
                    k -= 1
                if k > 0 and t[k - 1] == ":" and (typed := self._target(k - 1)):
                    name, start = typed
            at = m.end()
            while at < len(t) and t[at] in " \t":
                at += 1
            value, begin, end, put, quoted = self.expression(at)
            if op == ":" and not quoted and not put:
                nxt = t[end : end + 3].lstrip(" \t")
                if value is None and nxt.startswith("="):
                    continue
            if not quoted and not put:
                value = None
                bare = _BARE.match(t, at)
                if bare and op in ("=", ":") and self._leads(start) and not t.startswith("(", bare.end()):
                    text = bare[0]
                    filled = _HOLE.sub(lambda h: self.constants.get(h[1] or h[2] or h[3], h[0]), text)
                    value, begin, end, put = filled, at, bare.end(), filled != text
                    if put and len(filled) > len(t):
                        value = None
            if value is not None:
                self.constants[name] = self.constants[name.rpartition(".")[2]] = value
                yield name, value, begin, end, put
        if "</" in t:
            yield from ((m[1], m[2].strip(), m.start(2), m.end(2), False) for m in _XML.finditer(t))
        if "--" in t:
            yield from ((m[1], next(filter(None, m.groups()[1:]), ""), m.end(1) + 1, m.end(), False) for m in _FLAG.finditer(t))
        if "(" in t:
            yield from ((m[2], m[4], m.start(4), m.end(4), False) for m in _CALL.finditer(t))


def scan(text: str | None, threshold: float = THRESHOLD) -> list[tuple[str, int, int, int, bool, float, str]]:
    """name, start, end, length, propagated, score and sha256 of every secret of a text, in order."""
    out = {}
    for name, value, begin, end, put in Lexer(text or "").run():
        s = score(name, value)
        if s >= threshold:
            out.setdefault((begin, end, name), (name, begin, end, len(value), put, s, hashlib.sha256(value.encode("utf-8", "replace")).hexdigest()))
    return sorted(out.values(), key=lambda x: (x[1], x[2], x[0]))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, name, start, end, length, propagated, score and sha256 of every secret."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").cast("string").alias("text")).filter(F.col("text").rlike(STEMS))
    names = ["doc_id", "name", "start", "end", "length", "propagated", "score", "sha256"]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.float64(), pa.string()]

    def run(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [(i, *s) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for s in scan(t, threshold)]
        yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], kind) for k, kind in enumerate(kinds)], names)

    return A.map_batches(rows, run, "doc_id long, name string, start long, end long, length long, propagated boolean, score double, sha256 string")


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The secrets of all documents."""
    return secrets(spark.read.parquet(f"{sf_dir}/documents.parquet"))


QUERIES = {"op7_secret_scan": op7_secret_scan}
ORACLE: dict[str, str] = {}
