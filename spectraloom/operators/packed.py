"""Several values packed in one field: a parsing expression grammar with ordered alternatives.

Grammar (``/`` is ordered choice: the first alternative that parses stands)::

    field    <- open field close / whole-quoted field / pairs / list
    pairs    <- pair (sep pair)*          # "(mz,i),(mz,i)"  "mz:i mz:i"  "mz i; mz i"  rows of two columns
    list     <- slot (sep slot)*
    slot     <- quoted / bare / empty
    quoted   <- q (any but q)* q  &(sep / end)    # no closing quote: the parser goes back and reads a bare value
    sep      <- space* [,;|] space* / tab / newline / space+
    number   <- sign? digits ([.,] digits)? exponent?

A comma is a decimal comma where the field has another separator and no decimal points, or its values
are quoted; else it separates. Bracket kinds may enclose a field; a missing closing bracket is flagged.

Defined results: null and blank fields give no slots; a slot without a number (empty, "-", NaN, NA,
null) keeps its position and has a null value; repeated rows are parsed each on its own; a trailing
separator adds no slot; infinite numbers are no numbers. Every slot carries error flags:
``unclosed_quote``, ``unclosed_bracket``, ``not_a_number``.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.arrow import map_columns

OPEN, CLOSE = "[{(<", "]})>"
QUOTES = {'"': '"', "'": "'", "“": "”", "«": "»", "`": "`"}
#: Spellings of a slot without a number.
GAPS = {"", "-", "–", "—", "nan", "na", "n/a", "null", "none", "nd", "n.d.", "?", ".", "inf", "-inf", "+inf", "infinity"}

_NUMBER = re.compile(r"[-+−]?(?:\d+(?:[.,]\d*)?|[.,]\d+)(?:[eE][-+−]?\d+)?")
_SEP = re.compile(r"[ \u00a0]*(\r\n|[,;|\t\r\n])[ \u00a0]*|[ \u00a0]+")
_PAIR_ROWS = re.compile(r"\r\n|\r|\n")


def to_number(text: str, decimal_comma: bool) -> float | None:
    """A slot's number, or None. Thousands separators aren't guessed at."""
    t = text.strip().replace("−", "-").replace(" ", "")
    if t.lower() in GAPS or not _NUMBER.fullmatch(t):
        return None
    if "," in t:
        if not decimal_comma:
            return None
        t = t.replace(",", ".")
    value = float(t)
    return value if math.isfinite(value) else None


class _Parser:
    """Recursive descent over one field. ``slots`` are (text, error flags)."""

    def __init__(self, text: str, alone: bool = True):
        self.text = text
        self.alone = alone
        self.flags: set[str] = set()

    # field <- open field close / quoted field / body
    def unwrap(self, text: str) -> str:
        text = text.strip(" \u00a0\ufeff\u200b").rstrip("\r\n")  # a separator in front has an empty slot before it
        if text and text[0] in OPEN:
            want = CLOSE[OPEN.index(text[0])]
            depth, at = 0, 0
            for at, ch in enumerate(text):
                depth += (ch == text[0]) - (ch == want)
                if depth == 0:
                    break
            if depth > 0:  # cut short: what is left of the list is read
                if text[0] == "(" and not self._nested(text):
                    return text
                self.flags.add("unclosed_bracket")
                return self.unwrap(text[1:])
            if at == len(text.rstrip()) - 1 and (text[0] != "(" or text.count("(") == 1 and not self._one_pair(text)):
                return self.unwrap(text[1:at])
            return text
        if text and text[-1:] in CLOSE and text.count(text[-1]) > text.count(OPEN[CLOSE.index(text[-1])]):
            self.flags.add("unclosed_bracket")
            return self.unwrap(text[:-1])
        if text and text[0] in QUOTES and len(text) > 1:
            end = text.find(QUOTES[text[0]], 1)
            if end == len(text) - 1:  # one quoted field: its inside is the list
                return self.unwrap(text[1:-1])
            if end < 0 and re.search(r"[,;|\s]", text):  # opened, never closed: go back, read the rest bare
                self.flags.add("unclosed_quote")
                return self.unwrap(text[1:])
        return text

    @staticmethod
    def _nested(text: str) -> bool:
        return text.startswith(("((", "([", "({"))

    @staticmethod
    def _one_pair(text: str) -> bool:
        return len(re.findall(r"[,;|]", text)) == 1 and text.count("(") == 1

    # quoted <- q inside q &(sep / end)
    def quoted(self, text: str, at: int) -> tuple[str, int] | None:
        close = QUOTES.get(text[at])
        if close is None:
            return None
        end = text.find(close, at + 1)
        if end < 0:
            return None
        nxt = end + 1
        return (text[at + 1 : end], nxt) if nxt == len(text) or _SEP.match(text, nxt) else None

    def slots(self, text: str, sep: re.Pattern) -> list[tuple[str, set[str]]]:
        """slot (sep slot)*; text must be unwrapped."""
        out: list[tuple[str, set[str]]] = []
        at, n = 0, len(text)
        while at < n:
            flags: set[str] = set()
            if (got := self.quoted(text, at)) is not None:
                value, at = got
            else:
                m = sep.search(text, at)
                end = m.start() if m else n
                value = text[at:end]
                if value and value[0] in QUOTES:
                    flags.add("unclosed_quote")
                    value = value[1:]
                elif value and value[-1] in QUOTES.values():
                    flags.add("unclosed_quote")
                    value = value[:-1]
                at = end
            out.append((value, flags))
            if at < n:
                m = sep.match(text, at)
                at = m.end() if m else at + 1
        return out

    def parse(self) -> tuple[list[list[tuple[float | None, str, set[str]]]], bool]:
        """Columns of slots (one for a list, two for pairs) and whether pairs were read."""
        text = self.unwrap(self.text)
        if not text.strip():
            return [[]], False
        # pairs told by white space alone could as well be a list with mixed separators: only where the partner is blank
        for alternative in (self.bracket_pairs, self.colon_pairs, *((self.row_pairs, self.semicolon_pairs) if self.alone else ())):
            if (pairs := alternative(text)) is not None:
                comma = self._decimal_comma([x for pair in pairs for x in pair])
                columns = [[self._slot(pair[k], set(), comma) for pair in pairs] for k in (0, 1)]
                return columns, True
        sep, comma = self.separator(text)
        return [[self._slot(v, f, comma) for v, f in self.slots(text, sep)]], False

    def _slot(self, text: str, flags: set[str], comma: bool) -> tuple[float | None, str, set[str]]:
        clean = text.strip(" \t\r\n\u00a0\ufeff\u200b")
        for q, c in QUOTES.items():
            if len(clean) > 1 and clean[0] == q and clean[-1] == c:
                clean = clean[1:-1].strip()
        value = to_number(clean, comma)
        flags = set(flags)
        if value is None and clean.lower() not in GAPS:
            flags.add("not_a_number")
        return value, clean, flags

    @staticmethod
    def _decimal_comma(values: list[str]) -> bool:
        return any("," in v for v in values) and not any("." in v for v in values)

    # "(mz,i),(mz,i)" or "[mz, i], [mz, i]"
    @staticmethod
    def bracket_pairs(text: str) -> list[tuple[str, str]] | None:
        if text[0] not in OPEN:
            return None
        k = OPEN.index(text[0])
        o, c = re.escape(OPEN[k]), re.escape(CLOSE[k])
        inner = re.findall(rf"{o}([^{o}{c}]*)(?:{c}|$)", text)
        out = []
        for item in inner:
            parts = re.split(r"\s*[;|:]\s*|,\s+|\t", item) if not re.fullmatch(r"[^,]*,[^,]*", item) else item.split(",")
            if len(parts) > 2:
                return None
            out.append((parts[0], parts[1] if len(parts) == 2 else ""))
        return out or None

    # "mz:i mz:i"
    @staticmethod
    def colon_pairs(text: str) -> list[tuple[str, str]] | None:
        if ":" not in text:
            return None
        out = []
        for item in re.split(r"\s*[;|]\s*|\s+|,(?=[^,:]*:)", text.strip(" ;,|")):
            if item == "":
                continue
            left, found, right = item.partition(":")
            if not found and out and len(out) < text.count(":"):
                return None
            out.append((left, right))
        return out or None

    # rows of two columns
    @staticmethod
    def row_pairs(text: str) -> list[tuple[str, str]] | None:
        rows = [r for r in _PAIR_ROWS.split(text) if r.strip()]
        if len(rows) < 2 and "\n" not in text:
            return None
        cells = [re.split(r"\t|;\s*|,\s+| +", r.strip(" ")) for r in rows]
        if not any(len(c) == 2 and c[1].strip() for c in cells) or any(len(c) > 2 for c in cells):
            return None
        if sum(len(c) == 2 for c in cells) < len(cells) - 1:
            return None
        return [(c[0], c[1] if len(c) > 1 else "") for c in cells]

    # "mz i; mz i"
    @staticmethod
    def semicolon_pairs(text: str) -> list[tuple[str, str]] | None:
        for mark in (";", "|", ","):
            if mark not in text or len(set(re.findall(r"[;|,]", text))) > 1:
                continue
            items = [x.strip() for x in text.split(mark)]
            while items and not items[-1]:
                items.pop()
            cells = [re.split(r"\s+", x) for x in items]
            if len(cells) > 1 and all(len(c) == 2 and all(_NUMBER.fullmatch(v) or v.lower() in GAPS for v in c) for c in cells[:-1]) and len(cells[-1]) <= 2:
                return [(c[0], c[1] if len(c) > 1 else "") for c in cells]
        return None

    def separator(self, text: str) -> tuple[re.Pattern, bool]:
        """The list's separator and whether a comma is a decimal comma."""
        points = "." in re.sub(r"[eE]", "", text)
        outside = re.sub(r"\"[^\"]*\"|'[^']*'", "", text)
        other = re.search(r"[;|\t\n]", outside) is not None
        spaced = re.search(r"\S +\S", outside) is not None
        quoted = len(outside) < len(text) / 2
        comma = False
        if "," in text and not points:
            if quoted:
                comma = any("," in q for q in re.findall(r"\"([^\"]*)\"|'([^']*)'", text) for q in q)
            elif other:
                comma = True
            elif spaced:  # "1,5 2,5" has decimal commas, "1, 2" separates
                comma = re.search(r",\s", outside) is None
        if not comma:
            return _SEP, False
        return re.compile(r"[ \u00a0]*([;|\t\n])[ \u00a0]*|,(?=[ \u00a0]|$|(?<=[\"'],)[\"'])[ \u00a0]*|[ \u00a0]+") if not quoted else _SEP, True


def parse_packed(text: str | None, alone: bool = True) -> tuple[list[list[tuple[float | None, str, set[str]]]], bool, set[str]]:
    """Columns of slots of one field, whether it held pairs, and the field's own flags.

    ``alone``: the partner field is blank, so this one may hold pairs.
    """
    if text is None or not text.strip():
        return [[]], False, set()
    parser = _Parser(text, alone)
    columns, pairs = parser.parse()
    return columns, pairs, parser.flags


SCHEMA = "row_key bigint, source_column string, field string, pos int, value double, raw string, error string"


def explode_packed(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """One row per slot: (row_key, source_column, field, pos, value, raw, error).

    ``first`` and ``second`` are two quantities measured together. A column that packs pairs holds
    both, so its second members come out under ``second`` whichever column they stand in.
    ``pos`` counts from 1 within the quantity of a row. No shuffle: rows are parsed where they are read.
    """

    def parse(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {k: [] for k in ("row_key", "source_column", "field", "pos", "value", "raw", "error")}
        for k, a, b in zip(columns["k"], columns["a"], columns["b"]):
            count = {first: 0, second: 0}
            for column, text, partner in ((first, a, b), (second, b, a)):
                fields, pairs, flags = parse_packed(text, alone=partner is None or not partner.strip())
                for name, slots in zip((first, second) if pairs else (column,), fields):
                    for value, raw, errors in slots:
                        count[name] += 1
                        for key_, x in zip(out, (k, column, name, count[name], value, raw, ",".join(sorted(errors | flags)) or None)):
                            out[key_].append(x)
        return out

    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(first).cast("string").alias("a"), F.col(second).cast("string").alias("b"))
    return map_columns(rows, lambda: parse, SCHEMA)


def parsed_lists(df: DataFrame, key: str, first: str, second: str) -> DataFrame:
    """(key, first, second) with each quantity's values in order as array<double>; a slot without a number is a null in its place."""

    def parse(columns: dict[str, list]) -> dict[str, list]:
        out: dict[str, list] = {key: columns["k"], first: [], second: []}
        for a, b in zip(columns["a"], columns["b"]):
            values: dict[str, list] = {first: [], second: []}
            for column, text, partner in ((first, a, b), (second, b, a)):
                fields, pairs, _ = parse_packed(text, alone=partner is None or not partner.strip())
                for name, slots in zip((first, second) if pairs else (column,), fields):
                    values[name] += [value for value, _, _ in slots]
            for name in (first, second):
                out[name].append(values[name])
        return out

    rows = df.select(F.col(key).cast("bigint").alias("k"), F.col(first).cast("string").alias("a"), F.col(second).cast("string").alias("b"))
    return map_columns(rows, lambda: parse, f"{key} bigint, {first} array<double>, {second} array<double>")
