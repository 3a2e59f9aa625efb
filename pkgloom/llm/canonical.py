"""Map freely typed values to the entries of a canonical list.

The list's entries and their aliases (identifier, name, name without its generic noun, name turned round with "of")
are stems in a trie; version and form ("only", "or later") are read off the value beforehand. A Levenshtein automaton,
whose states are rows of edit distances with transpositions, walks the trie and returns every entry within a distance
that depends on the length of the stem. Digits of a stem are never edited: another number is another entry.

Defined results: null and empty values give no answer at all; a value whose stem, version or form the list lacks, and
one whose nearest entries disagree, maps to ''. Ties between aliases of one entry are one answer.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from pkgloom.engine import cut, join_skewed, unused

# Notes that are appended to a license without changing it, generic nouns, abbreviations.
NOTES = re.compile(
    r"\s*(?:\((?:see|full|file|c\)|with|text)[^()]*\)|\[[^\[\]]*\]|\s[-–]\s+(?:full text|see|text).*|\.)\s*$", re.I
)
PREFIX = re.compile(r"^\s*(?:licenseref-(?:distro-)?|the\s+)", re.I)
TRAILING = re.compile(r"[\s,]+(?:style|text|licen[sc]e text)$", re.I)
WORDS = {"licence": "license", "licences": "license", "licenses": "license", "lic": "license", "pub": "public"}
NOUNS = ("license", "agreement", "notice", "terms")

FORM = [
    (re.compile(r"(?:[\s,_-]+or[\s_-]+(?:any[\s_-]+)?(?:later|newer|above|greater)(?:[\s_-]+versions?)?|\s*\+)\s*$", re.I), "later"),
    (re.compile(r"[\s,_-]+only\s*$", re.I), "only"),
]
VERSION = re.compile(r"(?:[\s,_-]*\bv(?:ersion|er)?\.?[\s_-]*|(?<=[A-Za-z])v|[\s,_-]+|(?<=[A-Za-z]))(\d+(?:\.\d+)*)\s*$", re.I)


def parse(text: str) -> tuple[str, tuple[int, ...] | None, str]:
    """Stem (letters and digits only), version without trailing zeros, and form of a value."""
    text = text.strip().strip("\"'").strip()
    while (shorter := NOTES.sub("", text)) != text:
        text = shorter
    text = PREFIX.sub("", PREFIX.sub("", text))
    form = ""
    for pattern, name in FORM:
        if pattern.search(text):
            text, form = pattern.sub("", text), name
            break
    version = None
    if m := VERSION.search(text):
        numbers = [int(x) for x in m[1].split(".")]
        while len(numbers) > 1 and numbers[-1] == 0:
            numbers.pop()
        text, version = text[: m.start()], tuple(numbers)
    text = TRAILING.sub("", text)
    words = [WORDS.get(w, w) for w in re.findall(r"[^\W_]+", text.lower())]
    return "".join(words), version, form


@dataclass
class Node:
    next: dict[str, Node] = field(default_factory=dict)
    stems: list[int] = field(default_factory=list)


def allowance(length: int) -> int:
    """Edits allowed in a stem of so many characters."""
    return 0 if length <= 5 else 1 if length <= 9 else 2


class CanonicalList:
    def __init__(self, entries: list[tuple[str, str | None]]) -> None:
        self.root = Node()
        self.stems: list[str] = []
        self.entries: list[dict[tuple, set[str]]] = []
        at: dict[str, int] = {}
        for identifier, name in entries:
            for stem, version, form in self._aliases(identifier, name):
                if stem not in at:
                    at[stem] = len(self.stems)
                    self.stems.append(stem)
                    self.entries.append({})
                    node = self.root
                    for c in stem:
                        node = node.next.setdefault(c, Node())
                    node.stems.append(at[stem])
                self.entries[at[stem]].setdefault((version, form), set()).add(identifier)

    @staticmethod
    def _aliases(identifier: str, name: str | None) -> Iterator[tuple[str, tuple | None, str]]:
        stem, version, form = parse(identifier)
        yield stem, version, form
        if not name:
            return
        stem, version, form = parse(name)
        yield stem, version, form
        bare = name
        for pattern, _ in FORM:
            bare = pattern.sub("", bare)
        words = [WORDS.get(w, w) for w in re.findall(r"[^\W_]+", VERSION.sub("", bare).lower())]
        if len(words) > 1:
            yield "".join([*words[1:], "of", words[0]]), version, form
            if words[-1] in NOUNS:
                yield "".join(words[:-1]), version, form
            if words[-1] != "license":
                yield "".join([*words, "license"]), version, form
        plain = parse(identifier)[0]
        if version is None and not any(c.isdigit() for c in identifier):
            yield plain + "license", version, form

    def within(self, stem: str, most: int) -> list[tuple[int, int]]:
        """(distance, stem number) of every stem within ``most`` edits."""
        found: list[tuple[int, int]] = []
        n = len(stem)

        def step(node: Node, letter: str, row: list[int], before: list[int] | None, last: str) -> None:
            new = [row[0] + 1]
            for j in range(1, n + 1):
                same = stem[j - 1] == letter
                change = row[j - 1] + (0 if same else 9 if stem[j - 1].isdigit() or letter.isdigit() else 1)
                drop = new[j - 1] + (9 if stem[j - 1].isdigit() else 1)
                add = row[j] + (9 if letter.isdigit() else 1)
                best = min(change, drop, add)
                if before is not None and j > 1 and stem[j - 2] == letter and stem[j - 1] == last and last != letter:
                    best = min(best, before[j - 2] + 1)
                new.append(best)
            if min(new) > most and (before is None or min(row) > most):
                return
            if new[n] <= most:
                found.extend((new[n], k) for k in node.stems)
            for c, child in node.next.items():
                step(child, c, new, row, letter)

        first = [0]
        for c in stem:
            first.append(first[-1] + (9 if c.isdigit() else 1))
        for c, child in self.root.next.items():
            step(child, c, first, None, "")
        return sorted(found)

    def _pick(self, stem: int, version: tuple | None, form: str) -> set[str]:
        have = self.entries[stem]
        if (version, form) in have:
            return have[version, form]
        if version is None:  # a single entry needs no version to be meant
            only = {i for (v, f), ids in have.items() if not form or f == form for i in ids}
            return only if len({v for v, _ in have}) == 1 and len(only) == 1 else set()
        return set()

    def resolve(self, text: str) -> str:
        """The identifier that a value means, or ''."""
        stem, version, form = parse(text)
        if not stem:
            return ""
        found = self.within(stem, allowance(len(stem)))
        nearest = [k for d, k in found if d == found[0][0]]
        ids = set().union(*(self._pick(k, version, form) for k in nearest)) if nearest else set()
        return ids.pop() if len(ids) == 1 else ""


def map_values(df: DataFrame, column: str, entries: list[tuple[str, str | None]]) -> DataFrame:
    """``df`` with a column ``identifier`` for the non-null, non-empty values of ``column``; other rows are dropped.

    A column of that name is replaced. ``entries`` is the bounded canonical list, whose trie each worker holds. Every distinct
    value is counted before it is shuffled, resolved once, and joined back; a spelling that fills a third of the table is
    joined apart from the others."""
    df = df.drop("identifier")
    (held,) = unused(df, "held_")
    kept = df.where(F.col(column).isNotNull() & (F.col(column) != ""))
    (kind,) = [f.dataType for f in df.schema.fields if f.name == column]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        canonical = CanonicalList(entries)
        for batch in batches:
            answers = pa.array([canonical.resolve(text) for text in batch.column(0).to_pylist()], type=pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, answers], names=[column, held, "identifier"])

    tasks = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    values = kept.groupBy(column).agg(F.count(F.lit(1)).alias(held)).repartition(tasks)
    schema = StructType([StructField(column, kind), StructField(held, LongType()), StructField("identifier", StringType())])
    answers = cut(values.mapInArrow(work, schema))
    return join_skewed(kept, answers, [column], held).select(*df.columns, "identifier")
