"""Mapping free-entered values to a canonical list.

Reference entries and their aliases form a trie. A typed value is searched with a Levenshtein
automaton: the rows of the edit-distance table are advanced along the trie's paths, with adjacent
swaps as one edit, and a path is left as soon as no cell of its row is within the bound. The bound
grows with the value's length. Rigid characters (digits, and letters of short codes such as "PC" or
"II") are written upper case in the trie and can only be matched exactly: another chain or model
number is another thing.
"""

from __future__ import annotations

import re
import unicodedata
import uuid
from collections.abc import Callable, Iterable, Sequence
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spectraloom.arrow import map_columns

#: Distinct values a Python worker remembers; a forgotten value is searched again, so no result depends on it.
REMEMBERED = 200_000

#: Characters from here on (private use) are rigid in the trie and in the typed value.
RIGID = "\U000f0000"


def bound(length: int) -> int:
    """Greatest distance for a value of so many characters."""
    return 0 if length < 6 else 1 if length < 10 else 2


class Trie:
    """Entries by path. A node is (children, terminal labels)."""

    def __init__(self, paths: Iterable[tuple[str, int]] = ()):
        self.root: tuple[dict, set] = ({}, set())
        for path, label in paths:
            self.add(path, label)

    def add(self, path: str, label: int) -> None:
        node = self.root
        for ch in path:
            node = node[0].setdefault(ch, ({}, set()))
        node[1].add(label)

    def search(self, text: str, limit: int) -> list[tuple[int, int]]:
        """(distance, label) of every entry within ``limit``, the nearest first.

        Only the cells within ``limit`` of the diagonal can be within it, so only those are advanced.
        """
        far = limit + 1
        n = len(text)
        # typed characters that must not be inserted or replaced: digits are rigid in the typed value as well
        rigid = [c.isdigit() or c >= RIGID for c in text]
        first = [0] + [far] * n
        for i in range(1, min(n, limit) + 1):
            if rigid[i - 1]:
                break
            first[i] = i
        best: dict[int, int] = {}

        def walk(node: tuple[dict, set], depth: int, row: list[int], before: list[int] | None, last: str) -> None:
            if node[1] and row[n] <= limit:
                for label in node[1]:
                    best[label] = min(best.get(label, far), row[n])
            depth += 1
            low_i, high_i = max(1, depth - limit), min(n, depth + limit)
            if low_i > n:
                return
            for ch, child in node[0].items():
                hard = ch.isupper() or ch.isdigit() or ch >= RIGID
                low = ch.lower()
                new = [far] * (n + 1)
                if not hard and depth <= limit:
                    new[0] = min(far, row[0] + 1)
                least = new[0]
                for i in range(low_i, high_i + 1):
                    t = text[i - 1]
                    if t == low:
                        d = row[i - 1]
                    else:
                        d = far if hard or rigid[i - 1] else row[i - 1] + 1
                    if not hard and row[i] + 1 < d:
                        d = row[i] + 1
                    if not rigid[i - 1] and new[i - 1] + 1 < d:
                        d = new[i - 1] + 1
                    if before is not None and i > 1 and not hard and t == last and text[i - 2] == low and t != low and not t.isdigit() and before[i - 2] + 1 < d:
                        d = before[i - 2] + 1
                    if d < far:
                        new[i] = d
                        if d < least:
                            least = d
                if least <= limit:
                    walk(child, depth, new, row if not hard else None, low)

        walk(self.root, 0, first, None, "")
        return sorted((d, label) for label, d in best.items())


def plain(text: str) -> str:
    """Compatibility form, lower case, without invisible characters; white space as single spaces."""
    t = unicodedata.normalize("NFKC", text)
    t = "".join(c for c in t if unicodedata.category(c) not in ("Cf", "Cc") or c in "\t\n\r")
    return re.sub(r"\s+", " ", t).strip().lower()


def _rigid_short(words: Iterable[str]) -> str:
    """Words as one path; digits and words of up to three characters are rigid."""
    return "".join(w.upper() if len(w) <= 3 or any(c.isdigit() for c in w) else w for w in words)


class Matcher:
    """Base: ``forms`` gives the readings of a typed value in order, the first that matches stands."""

    def __init__(self) -> None:
        self.trie = Trie()
        self.lookup = lru_cache(REMEMBERED)(self._lookup)

    def forms(self, text: str) -> list[str]:
        raise NotImplementedError

    def accept(self, form: str, label: int, distance: int) -> bool:
        return True

    def within(self, form: str) -> list[tuple[int, int]]:
        """(distance, entry) of all entries within the bound of the form's length, the nearest first."""
        return [(d, e) for d, e in self.trie.search(form, bound(len(form))) if self.accept(form, e, d)]

    def nearest(self, form: str) -> list[tuple[int, int]]:
        """``within`` up to the least distance at which there is an entry: most values need no search beyond it."""
        for limit in range(bound(len(form)) + 1):
            found = [(d, e) for d, e in self.trie.search(form, limit) if self.accept(form, e, d)]
            if found:
                return found
        return []

    def candidates(self, text: str) -> list[tuple[int, int]]:
        """(distance, entry) of all entries within the bound of any reading of the value."""
        best: dict[int, int] = {}
        for form in filter(None, self.forms(text)):
            for d, e in self.within(form):
                best[e] = min(d, best.get(e, d))
        return sorted((d, e) for e, d in best.items())

    def _lookup(self, text: str) -> tuple[int, int, int]:
        """(entry or 0, distance or -1, number of entries at that distance)."""
        ties = 0
        for form in self.forms(text):
            if not form:
                continue
            found = self.nearest(form)
            if found:
                near = {e for d, e in found if d == found[0][0]}
                if len(near) == 1:
                    return near.pop(), found[0][0], 1
                ties = max(ties, len(near))
        return 0, -1, ties


class ClassMatcher(Matcher):
    """Class codes, class names and synonyms; "PC (phosphatidylcholine)" must say the same twice."""

    def __init__(self, rows: list[tuple[int, str, str, list[str] | None]]):
        super().__init__()
        for label, code, name, synonyms in rows:
            for alias in (code, name, *(synonyms or ())):
                if alias:
                    self.trie.add(self.key(alias), label)

    @staticmethod
    def key(alias: str) -> str:
        words = re.findall(r"[^\W_]+", plain(alias))
        joined = "".join(words)
        return joined.upper() if len(joined) <= 5 else "".join(c.upper() if c.isdigit() else c for c in joined)

    def forms(self, text: str) -> list[str]:
        t = plain(text)
        if t.endswith("?"):
            return []
        return ["".join(re.findall(r"[^\W_]+", t))]

    TWICE = re.compile(r"\s*([^()\[\]]+?)\s*[(\[]([^()\[\]]+)[)\]]\s*")

    def candidates(self, text: str) -> list[tuple[int, int]]:
        m = self.TWICE.fullmatch(plain(text))
        if not m:
            return super().candidates(text)
        a, b = ({e: d for d, e in super(ClassMatcher, self).candidates(p)} for p in m.groups())
        return sorted((max(a[e], b[e]), e) for e in a.keys() & b.keys())

    def _lookup(self, text: str) -> tuple[int, int, int]:
        m = self.TWICE.fullmatch(plain(text))
        if not m:
            return super()._lookup(text)
        parts = [super(ClassMatcher, self)._lookup(p) for p in m.groups()]
        named = {p[0] for p in parts if p[0]}
        return (named.pop(), max(p[1] for p in parts), 1) if len(named) == 1 and parts[0][0] else (0, -1, len(named))


class InstrumentMatcher(Matcher):
    """Instruments: "model, maker", maker first or left out, run together or hyphenated, among other devices."""

    NOISE = {"by", "instruments", "instrument", "scientific", "inc", "ltd", "gmbh", "corp", "serial", "sn", "no"}

    def __init__(self, rows: list[tuple[int, str, str | None]]):
        super().__init__()
        self.makers = {plain(m) for _, _, m in rows if m}
        models: dict[str, set[int]] = {}
        for label, name, maker in rows:
            model = name.rpartition(",")[0] if maker and plain(name).endswith(plain(maker)) and "," in name else name
            words = self.words(model)
            path = _rigid_short(words)
            models.setdefault(path, set()).add(label)
            own = plain(maker or "")
            for p in (path, *((path + own, own + path) if own else ())):
                self.trie.add(p, label)
        self.rows = {label: plain(maker or "") for label, _, maker in rows}

    @staticmethod
    def words(text: str) -> list[str]:
        return re.findall(r"[^\W_]+", re.sub(r"\+", " plus ", plain(text)))

    def forms(self, text: str) -> list[str]:
        t = plain(text)
        t = re.sub(r"[(\[]\s*(?:serial|s/?n|sn|no\.?|nr\.?)[^)\]]*[)\]]|\b(?:serial|s/n)\s*(?:no\.?|number)?\s*[:#]?\s*\w*\d\w*", " ", t)
        out = []
        for part in (t, *(re.split(r"\s*[;/|]\s*|\s+(?:with|coupled to|and|&|on)\s+", t) if re.search(r"[;/|&]|\b(?:with|coupled|and|on)\b", t) else ())):
            out.append("".join(w for w in self.words(part) if w not in self.NOISE))
        return list(dict.fromkeys(out))

    def accept(self, form: str, label: int, distance: int) -> bool:
        # a maker that is spelled out must be the entry's
        return not any(m in form and m != self.rows[label] for m in self.makers if m)


class NameMatcher(Matcher):
    """Compound names by the automaton, systematic names and shorthand.

    Shorthand is a path of its sorted chains, all rigid, and its class word: codes and stems of up to
    five letters are rigid, longer words aren't ("phosphatidylcholne 16:0/18:1"). The order of the
    chains is checked afterwards. "_" leaves it open: such a name stands for an entry only where one
    entry has these chains, or where the reference lists that very spelling.
    """

    #: Glycerophospho stems of class codes, and trivial remarks after a name.
    STEMS = {"gpcho": "pc", "gpetn": "pe", "gpser": "ps", "gpgro": "pg", "gpins": "pi", "gpa": "pa",
             "phosphatidylcholine": "pc", "phosphatidylethanolamine": "pe", "phosphatidylserine": "ps",
             "phosphatidylglycerol": "pg", "phosphatidylinositol": "pi", "phosphatidicacid": "pa", "phosphatidate": "pa"}
    REMARK = re.compile(r"\s*(?:[(\[]\s*(?:standard|std|in\s+\w+|synthetic|isotope|lot\s*\w+|[^()\[\]:]*(?:purity|%)[^()\[\]:]*)[^)\]]*[)\]]|[,;]\s*(?:>|<|≥|~)?\s*\d+(?:\.\d+)?\s*%.*|[,;]\s*(?:lot|batch|cat\.?|no\.?)\b.*)\s*$")
    CHAIN = re.compile(r"(?:[opd]-?|t)?\d{1,2}:\d{1,2}(?:;\w+)?(?:\([^()]*\))?")

    def __init__(self, rows: list[tuple[int, str, str | None, list[str] | None]]):
        super().__init__()
        self.short = Trie()
        self.shorts: list[tuple[str, tuple[str, ...]]] = []
        self.open_order: dict[tuple[str, tuple[str, ...]], set[int]] = {}
        self.listed: dict[str, set[int]] = {}
        self.vocabulary: set[str] = set()
        self.words_of: dict[int, list[list[str]]] = {}
        for label, name, abbreviation, synonyms in rows:
            for alias in (name, abbreviation, *(synonyms or ())):
                if not alias:
                    continue
                short = self.shorthand(plain(alias))
                if short:
                    head, chains, join = short[:3]
                    if (head, tuple(sorted(chains))) not in self.open_order:
                        self.add_short(head, chains)
                    self.listed.setdefault(head + join.join(chains), set()).add(label)
                    self.open_order.setdefault((head, tuple(sorted(chains))), set()).add(label)
                else:
                    for a in {plain(alias), re.sub(r"-sn(?=-)", "", plain(alias))}:
                        words = self.systematic(a)
                        self.trie.add("".join(c.upper() if c.isdigit() else c for c in "".join(words)), label)
                        self.words_of.setdefault(label, []).append(words)
                        self.vocabulary |= {w for w in words if len(w) > 4}

    @staticmethod
    def systematic(text: str) -> list[str]:
        return re.findall(r"\d+|[^\W\d_]+", text)

    @staticmethod
    def chain_path(chains: Iterable[str], bare: bool = False) -> str:
        """Rigid path of the chains in any order; ``bare``: one chain was said to be absent ("0:0")."""
        return "".join(chr(ord(RIGID) + (ord(c) & 0xFFFF)) for c in "/".join(sorted(chains)) + ("|-" if bare else "|"))

    def add_short(self, head: str, chains: list[str]) -> None:
        """The paths of a class and its chains, by every word for the class."""
        at = len(self.shorts)
        self.shorts.append((head, tuple(sorted(chains))))
        lyso = head[1:] if head.startswith("l") else None
        soft = lambda w: w.upper() if len(w) <= 5 else w
        words = {soft(w) for w, code in self.STEMS.items() if code == (lyso or head)}
        named = {head.upper()} | ({x for w in words | {lyso.upper()} for x in ("lyso" + w, w + "lyso")} if lyso else words)
        for w in named:
            self.short.add(self.chain_path(chains) + w, at)
        if lyso:
            for w in named | words | {lyso.upper()}:
                self.short.add(self.chain_path(chains, True) + w, at)

    def shorthand(self, t: str) -> tuple[str, list[str], str, list[str], bool] | None:
        """(class, chains, join, typed words, one chain absent) of a shorthand name, or None. Join is "/" (positions known) or "_"."""
        chains = self.CHAIN.findall(t)
        if not chains:
            return None
        rest = self.CHAIN.sub("\0", t)
        words = re.findall(r"\d+|[^\W\d_]+", re.sub(r"\(?sum\)?", "", rest.replace("\0", " ")))
        head = "".join(w for w in words if not w.isdigit())
        lyso = head.startswith("lyso") or "lyso" in head
        head = head.replace("lyso", "")
        head = self.STEMS.get(head, head)
        if lyso and not head.startswith("l"):
            head = "l" + head
        join = "_" if "_" in rest else "/"
        kept = [c for c in chains if c != "0:0"]
        if len(kept) < len(chains) and not head.startswith("l") and len(kept) == 1:
            head = "l" + head
        return head, kept, join, words, len(kept) < len(chains) and len(kept) == 1

    def forms(self, text: str) -> list[str]:
        t = plain(text).strip("\"'`*“”„ ")
        while (cut := self.REMARK.sub("", t)) != t:
            t = cut
        return [t.strip("\"'`*“”„ .,;")]

    def readings(self, text: str) -> tuple[tuple | None, str, list[str]]:
        """The shorthand parts of a value, or else its form and long words."""
        (t,) = self.forms(text)
        short = self.shorthand(t)
        words = [] if short else self.systematic(t)
        return short, "".join(words), [w for w in words if len(w) > 4]

    def _lookup(self, text: str) -> tuple[int, int, int]:
        short, form, typed = self.readings(text)
        for limit in range(bound(len(form)) + 1 if not short else 1):
            found = self.search_short(*short) if short else [(d, e) for d, e in self.trie.search(form, limit) if self.accept_words(typed, e)]
            if found:
                near = {e for d, e in found if d == found[0][0]}
                return (near.pop(), found[0][0], 1) if len(near) == 1 else (0, -1, len(near))
        return 0, -1, 0

    def candidates(self, text: str) -> list[tuple[int, int]]:
        short, form, typed = self.readings(text)
        if short:
            return self.search_short(*short)
        return [(d, e) for d, e in self.trie.search(form, bound(len(form))) if self.accept_words(typed, e)]

    def search_short(self, head: str, chains: list[str], join: str, words: list[str], bare: bool) -> list[tuple[int, int]]:
        """(distance, entry) of the entries with these chains whose class word is within the bound."""
        found = self.short.search(self.chain_path(chains) + head, 0)
        if not found and head not in self.STEMS.values() and head[1:] not in self.STEMS.values():
            # numbers and words of one or two letters besides the class ("d7", "o") aren't misspellings of it
            if all(len(w) > 2 or w in self.STEMS.values() or w[1:] in self.STEMS.values() for w in words if w.isalpha()) and not any(w.isdigit() for w in words):
                word = "".join(words)
                found = self.short.search(self.chain_path(chains, bare) + word, bound(len(word)))
        best: dict[int, int] = {}
        for d, at in found:
            name, ordered = self.shorts[at]
            listed = self.listed.get(name + join.join(chains), set())
            for e in listed if join == "/" else listed or self.open_order[name, ordered]:
                best[e] = min(d, best.get(e, d))
        nearest = sorted((d, e) for e, d in best.items())
        # a nearer class whose chains stand in another order hides the farther ones
        return nearest if nearest and nearest[0][0] == found[0][0] else []

    def accept_words(self, typed: list[str], label: int) -> bool:
        """A rightly spelled word of the list that the entry doesn't have at that place names another thing."""

        def agrees(words: list[str]) -> bool:
            own = [w for w in words if len(w) > 4]
            if len(own) == len(typed):
                return all(t == w or t not in self.vocabulary for t, w in zip(typed, own))
            return all(t not in self.vocabulary or t in own for t in typed)

        return any(agrees(words) for words in self.words_of[label])


#: Matchers of this worker by the id of their broadcast lists: built once in a worker process, whatever the number of its tasks.
_BUILT: dict[str, dict[str, Matcher]] = {}

VALUES = "field string, typed string, ref_id int, distance int, ties int"
CANDIDATES = "field string, typed string, ref_id int, distance int"


def typed_values(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(row_id, field, typed): one row per non-null value."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("typed")) for f in fields]))
    return df.select(F.col(key).cast("bigint").alias("row_id"), pairs.alias("p")).select("row_id", "p.*").where("typed is not null")


def _searched(values: DataFrame, lists: dict[str, tuple[type[Matcher], list[tuple]]], schema: str, answer: Callable[[str, Matcher, str], list[tuple]]) -> DataFrame:
    """``answer`` of each (field, typed) row. The lists are one broadcast of a checked size (``reference_rows``)."""
    shared, name = values.sparkSession.sparkContext.broadcast(lists), uuid.uuid4().hex

    def make():
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = {f: cls(rows) for f, (cls, rows) in shared.value.items()}
        built = _BUILT[name]

        def step(columns: dict[str, list]) -> dict[str, list]:
            rows = [(f, t, *x) for f, t in zip(columns["field"], columns["typed"]) for x in answer(f, built[f], t)]
            return {c: [x[i] for x in rows] for i, c in enumerate(names)}

        return step

    names = [c.split()[0] for c in schema.split(", ")]
    # a search costs time, not bytes: a number of parts that is named isn't merged by adaptive execution
    parts = int(values.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return map_columns(values.select("field", "typed").repartition(parts, "field", "typed"), make, schema)


def distinct_values(df: DataFrame, key: str, fields: Sequence[str]) -> DataFrame:
    """(field, typed, n_rows): each typed value once, with how often it stands. Counts are combined where the rows lie."""
    return typed_values(df, key, fields).groupBy("field", "typed").agg(F.count(F.lit(1)).alias("n_rows"))


def match_distinct(values: DataFrame, matchers: dict[str, tuple[type[Matcher], list[tuple]]]) -> DataFrame:
    """(field, typed, ref_id, distance, ties) of distinct (field, typed) rows.

    ``matchers`` has, by field, the matcher's class and its reference rows: number, name, and what else it takes. ``ref_id``
    is 0 where a value stands for no single entry (``ties`` then counts the entries that come equally near).
    An entry's own spelling is that entry, even where other entries read alike.
    """
    exact = {f: {r[1]: r[0] for r in rows} for f, (_, rows) in matchers.items()}
    own = values.sparkSession.sparkContext.broadcast(exact)

    def answer(field: str, matcher: Matcher, text: str) -> list[tuple]:
        entry = own.value[field].get(text)
        return [(entry, 0, 1) if entry is not None else matcher.lookup(text)]

    return _searched(values, matchers, VALUES, answer)


def match_values(df: DataFrame, key: str, matchers: dict[str, tuple[type[Matcher], list[tuple]]]) -> DataFrame:
    """One row per non-null typed value: (row_id, field, typed, ref_id, distance, ties).

    Each distinct value is searched once and joined back to its rows. The distinct values are counted
    where the rows lie, and the join's exchange lets adaptive execution split the partition of a value
    that fills a third of the rows.
    """
    rows = typed_values(df, key, list(matchers))
    found = match_distinct(rows.groupBy("field", "typed").agg(F.lit(1).alias("one")), matchers)
    return rows.join(found, ["field", "typed"]).select("row_id", "field", "typed", "ref_id", "distance", "ties")


def match_candidates(values: DataFrame, matchers: dict[str, tuple[type[Matcher], list[tuple]]]) -> DataFrame:
    """(field, typed, ref_id, distance): every entry within the bound of each distinct value; a value without any has no row."""
    return _searched(values, matchers, CANDIDATES, lambda _, m, t: [(e, d) for d, e in m.candidates(t)])


def reference_rows(df: DataFrame, *columns: str, most: int = 100_000) -> list[tuple]:
    """The rows of a reference list for the driver. A list of more than ``most`` rows is refused, not cut."""
    rows = [tuple(r) for r in df.select(*columns).limit(most + 1).collect()]
    if len(rows) > most:
        raise ValueError(f"a reference list of more than {most} rows doesn't fit a trie on each worker")
    return rows
