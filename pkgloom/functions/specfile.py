"""Parse RPM spec files into a struct: one state machine per document, run as an Arrow function."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StringType, StructField, StructType

#: Rounds of macro replacement after which nested macros are left as they are, and the length a text may grow to meanwhile.
ROUNDS, LONGEST = 1_000, 1_000_000

# Tags with one value, tags that list values, section headings.
SINGLE = {
    "name": "name", "version": "version", "epoch": "epoch", "release": "release", "summary": "summary", "license": "license",
    "group": "group", "url": "url", "buildroot": "buildroot", "buildarch": "buildarch", "excludearch": "excludearch",
    "exclusivearch": "exclusivearch",
}
LISTED = {"source": "sources", "patch": "patches", "requires": "requires", "buildrequires": "build_requires", "conflicts": "conflicts", "obsoletes": "obsoletes", "provides": "provides"}
SECTIONS = ("description", "changelog", "prep", "build", "install", "check", "files", "clean", "pre", "post", "preun", "postun", "package")

TAG = re.compile(r"^\s*([A-Za-z]+)(\d*)(?:\([^)]*\))?\s*:\s*(.*?)\s*$")
SECTION = re.compile(rf"^%({'|'.join(SECTIONS)})\b\s*(.*)$")
DEFINE = re.compile(r"^\s*(?:%\{[!?]+\w+:\s*)?%(?:global|define)\s+(\w+)(?:\([^)]*\))?\s+(.*?)\s*$", re.S)
MACRO = re.compile(r"%\{([^{}]*)\}|%(\w+)\b")
REQUIREMENT = re.compile(r"([^\s,]+(?:\([^)]*\))?)(?:\s*(<=|>=|==|=|<|>)\s*([^\s,]+))?")

TEXTS = [*SINGLE.values(), "description", "changelog"]
LISTS = [*LISTED.values(), "packages"]
PART_TEXTS, PART_LISTS = ["name", "summary", "group", "description"], ["requires", "build_requires", "conflicts", "obsoletes", "provides"]
SCHEMA = StructType(
    [StructField(n, StringType()) for n in TEXTS]
    + [StructField(n, ArrayType(StringType())) for n in LISTS]
    + [StructField("macros", MapType(StringType(), StringType())), StructField("files", MapType(StringType(), StringType()))]
    + [StructField("parts", ArrayType(StructType([StructField(n, StringType()) for n in PART_TEXTS] + [StructField(n, ArrayType(StringType())) for n in PART_LISTS])))]
)


def expand(text: str | None, macros: dict[str, str]) -> str | None:
    """Macros replaced: %{x}, %x, %{?x} optional, %{?x:y} y where x is known, %{!?x:y} y where it is not; unknown ones stay."""
    if text is None:
        return None

    def value(m: re.Match) -> str:
        body = m[1] if m[1] is not None else m[2]
        if c := re.fullmatch(r"([!?]+)(\w+)(?::(.*))?", body, re.S):
            known = c[2] in macros
            if "!" in c[1]:
                return "" if known else (c[3] or "")
            if not known:
                return ""
            return c[3] if c[3] is not None else macros[c[2]]
        return macros.get(body, m[0])

    for _ in range(ROUNDS):
        new = MACRO.sub(value, text)
        if new == text or len(new) > LONGEST:
            break
        text = new
    return text


def requirements(text: str) -> list[str]:
    """Single requirements of a line, each as name, operator and version where it has them."""
    return [" ".join(p for p in m.groups() if p) for m in REQUIREMENT.finditer(text) if m[1] not in ("<", ">", "=", "<=", ">=", "==")]


def logical_lines(text: str) -> list[str]:
    """The lines of a spec file, with those joined that end in a backslash."""
    lines: list[str] = []
    held = ""
    for line in text.splitlines():
        if line.endswith("\\"):
            held += line[:-1] + "\n"
            continue
        lines.append(held + line)
        held = ""
    return [*lines, held] if held else lines


def part_name(words: str, name: str | None) -> str:
    """The package that a section heading names: ``-n other``, a suffix of the main name, or '' for the main package."""
    given = words.split()
    if "-n" in given[:-1]:
        return given[given.index("-n") + 1]
    plain = [w for k, w in enumerate(given) if not w.startswith("-") and (k == 0 or given[k - 1] not in ("-l", "-f", "-p"))]
    return "-".join(filter(None, [name, plain[0]])) if plain else ""


def parse(text: str | None) -> dict:
    """The tags, lists, sections, macros and parts (sub-packages) of a spec file. Of a tag that stands twice the first counts; tags
    after a ``%package`` heading belong to that part, as do sections that name it."""
    out: dict = {k: None for k in SINGLE.values()} | {k: [] for k in LISTED.values()} | {"packages": [], "description": None, "changelog": None}
    macros: dict[str, str] = {}
    sources: dict[str, str] = {}
    parts: dict[str, dict] = {}
    section, package = "", ""
    kept: dict[tuple[str, str], list[str]] = {}
    for line in logical_lines(text or ""):
        if line.lstrip().startswith("#"):
            continue
        if m := SECTION.match(line):
            section, package = m[1], part_name(m[2], out["name"])
            if section == "package":
                out["packages"].append(package)
                parts.setdefault(package, {"name": package, "summary": None, "group": None, "description": None} | {k: [] for k in PART_LISTS})
            continue
        if m := DEFINE.match(line):
            body = m[2][:-1] if line.lstrip().startswith("%{") and m[2].endswith("}") else m[2]
            if not (line.lstrip().startswith("%{!?") and m[1] in macros):
                macros[m[1]] = body
            continue
        if section in ("description", "changelog"):
            kept.setdefault((section, package), []).append(line)
            continue
        if section not in ("", "package") or not (m := TAG.match(line)):
            continue
        tag, value = m[1].lower(), m[3]
        part = parts.get(package) if section == "package" else None
        if part is not None:
            if tag in ("summary", "group"):
                part[tag] = part[tag] or value
            elif tag in LISTED and LISTED[tag] in PART_LISTS:
                part[LISTED[tag]] += requirements(value)
                out[LISTED[tag]] += requirements(value)
        elif tag in SINGLE:
            key = SINGLE[tag]
            if out[key] is None:
                out[key] = value
                macros.setdefault(key, value)
        elif tag in LISTED:
            key = LISTED[tag]
            if key in ("sources", "patches"):
                number = m[2] or str(len(out[key]))
                sources.setdefault(f"{tag}{number}", value)
                macros.setdefault(f"{tag.upper()}{number}", value)
                out[key].append(value)
            else:
                out[key] += requirements(value)
    for (key, name), lines in kept.items():
        joined = "\n".join(lines).strip() or None
        if name in parts:
            parts[name][key] = joined if key == "description" else None
        elif not name:
            out[key] = joined
    for key, value in out.items():
        out[key] = [expand(v, macros) for v in value] if isinstance(value, list) else expand(value, macros)
    told = [{k: [expand(x, macros) for x in v] if isinstance(v, list) else expand(v, macros) for k, v in p.items() if k != "changelog"} for p in parts.values()]
    return out | {"macros": macros, "files": {k: expand(v, macros) for k, v in sources.items()}, "parts": told}


@F.pandas_udf(SCHEMA)
def spec_struct(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse(t) for t in texts], columns=SCHEMA.names)
