"""Split fields that pack several values into one string.

Every field is cut into tokens by one regular expression; each token is replaced by a one-character class, and the
classes in order form the field's *delimiter skeleton*. Ordinary characters all fall into the same few classes, so
millions of fields share few skeletons. The splitting rule (which token ranges are the values) is worked out once per
distinct skeleton and joined back; the values are then cut out of the token arrays by position, inside the JVM.

Two dialects are known: ``prose`` (descriptions: commas, slashes and quotes are mostly ordinary characters) and
``terms`` (short expressions such as licenses: boolean words, brackets, blanks between identifiers).

Defined results: null, empty and blank fields give no value; items between two separators that hold nothing are not
counted; an opening quote that is never closed counts as a blank; tables without rows give none.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pkgloom.engine import cut, join_skewed, unused

#: Rules are broadcast while there are at most so many skeletons (about 300 bytes each); beyond it they are shuffled, the
#: commonest ones apart.
BROADCAST_SKELETONS = 50_000

# Separators that are ordinary characters in their context are replaced by private-use characters of equal length
# or marked with an empty one before tokens are cut, and restored afterwards.
KEPT, COMMA, OPEN, CLOSE = "\ue000", "\ue001", "\ue002", "\ue003"

RULE = "array<struct<start:int,size:int,quoted:boolean>>"

PROSE_TOKENS = (
    r"\\\"|\\'|\"\"|[\"'“”„«»]|\r\n|[\n\r]|\t+|[;|•]+|,|[ \u00a0]+"
    r"|[^\s\u00a0;|,\"'•“”„«»\\]+(?: \p{Ll}[^\s\u00a0;|,\"'•“”„«»\\]*)*|."
)
PROSE_CLASSES = [
    ("X", r"^(?:\\\"|\\'|\"\")$"), ("D", "^[\"“”„«»]$"), ("S", "^'$"), ("N", r"^[\r\n]+$"), ("T", r"^\t+$"),
    ("P", r"^(?:[;|•]+|//?|\\)$"), ("K", "^,$"), ("_", r"^[ \u00a0]+$"), ("L", r"^[-*+‣◦–—]$"),
    ("M", r"^\(?\d{1,3}\)$"), ("E", r"^[\p{Lu}\p{Nd}(]"), ("e", ""),
]

TERMS_TOKENS = (
    r"\\\"|\\'|\"\"|[\"“”„«»]|[\n\r\t]+|[;|•&]+|,|[()]|[ \u00a0]+|\p{Alpha}+://[^\s\"';|]+|//?(?=\s|$)"
    r"|(?<![\p{L}\p{Nd}])'|'(?![\p{L}\p{Nd}])|(?:[^\s\u00a0;|,\"'•&()“”„«»\\]|(?<=[\p{L}\p{Nd}])'(?=[\p{L}\p{Nd}]))+|."
)
QUALIFIERS = (
    "only|later|newer|above|any|licen[sc]es?|lic\\.?|pub\\.?|public|style|text|terms?|the|of|see|file|full|version|"
    "ver\\.?|v\\.|in|same|as|upstream|with|by|for"
)
TERMS_CLASSES = [
    ("X", r"^(?:\\\"|\\'|\"\")$"), ("D", "^[\"“”„«»]$"), ("S", "^'$"), ("N", r"^[\r\n\t]+$"), ("P", "^[;|•&]+$"),
    ("K", "^,$"), ("O", r"^\($"), ("C", r"^\)$"), ("=", r"^[ \u00a0]{2,}$"), ("_", r"^[ \u00a0]$"), ("/", "^//?$"),
    ("B", "(?i)^(?:and|or|and/or)$"), ("q", f"(?i)^(?:{QUALIFIERS}|-|[\\[\ue000\ue002].*)$"),
    ("V", r"(?i)^v?(?:ersion|er)?\.?\d"), ("I", r"^\p{L}+(?:[-_v]?\d|[-_]\p{L})"), ("w", ""),
]


def _protect(value: Column, dialect: str, pairs: Iterable[tuple[str, str]]) -> Column:
    if dialect == "prose":  # an enumeration of capitalised words within one value, also one that was cut off
        word = r"\p{Lu}[\p{L}\p{Nd}-]*"
        return F.regexp_replace(value, rf"(?<=\p{{Ll}} )({word}), (?={word}(?:\s+and\b| an?$| ?$)|$)", f"$1{COMMA} ")
    out = F.regexp_replace(value, r"(?i)\b(and|or)(?=\s+(?:later|newer|above|any|greater|higher)\b)", f"{KEPT}$1")
    out = F.regexp_replace(out, r"(?i),(?=\s*v(?:ersion|er)?\.?\s*\d)", COMMA)
    out = F.regexp_replace(
        out, r"(?i)(?<=[^\s;|,&(/\"'])(?<!\band)(?<!\bor) \((?![^()]*\b(?:and|or)\b)([^()]*)\)", f" {OPEN}$1{CLOSE}"
    )
    for left, right in pairs:
        out = F.regexp_replace(out, rf"(?i)(?:(?<=\b{left} )(and|or)|\b(and|or)(?= {right}\b))", f"{KEPT}$1$2")
    return out


def _restore(value: Column) -> Column:
    return F.translate(value, COMMA + OPEN + CLOSE + KEPT, ",()")


def _class(token: Column, dialect: str, vocabulary: list[str]) -> Column:
    classes = PROSE_CLASSES if dialect == "prose" else TERMS_CLASSES
    out = F.lit(classes[-1][0])
    for name, pattern in reversed(classes[:-1]):
        out = F.when(token.rlike(pattern), F.lit(name)).otherwise(out)
    return F.when(F.lower(token).isin(vocabulary), F.lit("A")).otherwise(out) if vocabulary else out


def prose_rule(s: str) -> list[tuple[int, int, bool]]:
    """Token ranges (start, size, quoted) of the values of a prose skeleton."""
    n, items, i = len(s), [], 0
    numbered = s.lstrip("_").startswith("M")

    def separates(k: int) -> bool:
        c = s[k]
        if c in "TP":
            return True
        if c == "N":  # a line that goes on after blanks is the wrapped rest of the same value
            rest = s[k + 1 :]
            return not rest.startswith("_") or rest.lstrip("_")[:1] in ("L", "M", "N", "")
        if c == "K":
            return s[k + 1 :].lstrip("_N")[:1] in ("E", "D", "S", "M", "L", "K", "P", "")
        return c == "M" and numbered

    start = 0
    while i <= n:
        if i == n or separates(i):
            items.append((start, i, False))
            i += 1
            start = i
            continue
        at_start = not s[start:i].strip("_NL")
        if s[i] in "DS" and at_start:
            shut = -1
            for j in range(i + 1, n):
                rest = s[j + 1 :].lstrip("_") if s[j] == s[i] else "e"
                if s[j] == s[i] and (not rest or separates(n - len(rest))):
                    shut = j
                    break
            if shut > 0:
                items.append((i + 1, shut, True))
                i = start = shut + 1
                continue
        i += 1
    out = []
    for a, b, quoted in items:
        if not quoted:
            while a < b and (s[a] in "_N" or s[a] == "L" and s[a + 1 : a + 2] in ("_", "") or s[a] in "DS" and not s[a + 1 : b].count(s[a])):
                a += 1
            while a < b and s[b - 1] in "_N":
                b -= 1
        if a < b:
            out.append((a + 1, b - a, quoted))
    return out


def terms_rule(s: str) -> list[tuple[int, int, bool]]:
    """Token ranges (start, size, quoted) of the values of a terms skeleton."""
    n, parts, i, start = len(s), [], 0, 0  # parts: lists of neighbours with nothing but blanks between them
    parts.append([])

    def separates(k: int) -> bool:
        if s[k] == "/":
            return (k == 0 or s[k - 1] in "_=") and (k + 1 == n or s[k + 1] in "_=")
        if s[k] == "O":
            return k == 0 or s[k - 1] not in "wIAVq"
        return s[k] in "NPKBC"

    def flush(end: int) -> None:
        if s[start:end].strip("_="):
            parts[-1].append((start, end, False))

    while i < n:
        if separates(i):
            flush(i)
            parts.append([])
            i += 1
            start = i
            continue
        if s[i] in "DS" and (i == start or s[i - 1] in "_="):
            shut = next(
                (j for j in range(i + 1, n) if s[j] == s[i] and (j + 1 == n or s[j + 1] in "_=" or separates(j + 1))), -1
            )
            if shut > 0:
                flush(i)
                parts[-1].append((i + 1, shut, True))
                i = start = shut + 1
                continue
        i += 1
    flush(n)
    out = []
    for part in parts:
        for a, b, quoted in part:
            if quoted:
                out.append((a, b, True))
                continue
            pieces, at = [], a
            for k in range(a, b + 1):
                if k == b or s[k] in "_=":
                    if k > at:
                        pieces.append((at, k))
                    at = k + 1
            kinds = [s[x:y] for x, y in pieces]
            wide = [x for x in s[a:b].strip("_=").replace("_", "")]
            if len(pieces) > 1 and all(k in ("I", "A", "w") for k in kinds) and (
                "I" in kinds or all(k == "A" for k in kinds) or "=" in wide
            ):
                out += [(x, y, False) for x, y in pieces]
            elif len(pieces) > 1 and "=" in s[a:b].strip("_="):
                at = a
                for k in range(a, b + 1):
                    if k == b or s[k] == "=":
                        if s[at:k].strip("_"):
                            out.append((at, k, False))
                        at = k + 1
            else:
                out.append((a, b, False))
    trimmed = []
    for a, b, quoted in out:
        while not quoted and a < b and (s[a] in "_=" or s[a] in "DS" and s[a + 1 : b].count(s[a]) == 0):
            a += 1
        while not quoted and a < b and s[b - 1] in "_=":
            b -= 1
        if a < b:
            trimmed.append((a + 1, b - a, quoted))
    return trimmed


def _rules(dialect: str):
    resolve = prose_rule if dialect == "prose" else terms_rule

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rules = [[{"start": a, "size": k, "quoted": q} for a, k, q in resolve(s)] for s in batch["skeleton"]]
            yield pd.DataFrame({"skeleton": batch["skeleton"], "rule": rules, "held": batch["held"]})

    return work


def split_values(
    df: DataFrame, field: str, dialect: str = "prose", vocabulary: Iterable[str] = (), names: Iterable[str] = (), broadcast: int = BROADCAST_SKELETONS
) -> DataFrame:
    """``df`` with a column ``values_``: the values packed in ``field``, in order, as an array (empty for none). A column
    of that name is replaced; other columns may have any names.

    ``vocabulary``: single words that are values of their own in a list with nothing but blanks between its items.
    ``names``: values whose own text holds "and" or "or"; next to their words these do not separate.
    Both are small dimensions that the caller bounds. Only distinct skeletons are shuffled, after partial
    deduplication; the table itself is not."""
    words = sorted({w.lower() for w in vocabulary if " " not in w})
    pairs = sorted(
        {
            (ws[k - 1], ws[k + 1])
            for ws in ([w for w in name.lower().split() if w.isalnum()] for name in names)
            for k in range(1, len(ws) - 1)
            if ws[k] in ("and", "or") and ws[k + 1] != "later"
        }
    )
    tokens = F.regexp_extract_all(
        _protect(F.coalesce(F.col(field), F.lit("")), dialect, pairs),
        F.lit("(?s)" + (PROSE_TOKENS if dialect == "prose" else TERMS_TOKENS)),
        F.lit(0),
    )
    t, s, r = unused(df, "tokens_", "skeleton_", "rule_")
    cutup = df.withColumn(t, tokens).withColumn(s, F.array_join(F.transform(t, lambda x: _class(x, dialect, words)), ""))
    (n,) = unused(cutup, "held_")
    skeletons = cutup.groupBy(F.col(s).alias("skeleton")).agg(F.count(F.lit(1)).alias("held"))
    rules = cut(skeletons.mapInPandas(_rules(dialect), f"skeleton string, rule {RULE}, held bigint")).select(
        F.col("skeleton").alias(s), F.col("rule").alias(r), F.col("held").alias(n)
    )
    few = rules.count() <= broadcast
    ruled = cutup.join(F.broadcast(rules), s) if few else join_skewed(cutup, rules, [s], n)

    def value(x: Column) -> Column:
        text = _restore(F.array_join(F.slice(t, x["start"], x["size"]), ""))
        plain = F.regexp_replace(F.regexp_replace(text, r"\\([\"'])", "$1"), '""', '"')
        return F.trim(F.when(x["quoted"], plain).otherwise(text))

    found = ruled.withColumn("values_", F.filter(F.transform(r, value), lambda v: v != ""))
    return found.drop(t, s, r, n)


def explode_values(df: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """One row per value of ``values_`` with its position from 1, of the rows that hold ``least`` values or more."""
    return df.where(F.size("values_") >= least).select(*keys, F.posexplode("values_").alias("p_", "value")).select(
        *keys, (F.col("p_") + 1).cast("int").alias("pos"), "value"
    )
