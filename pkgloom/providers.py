"""External services behind protocols, with deterministic defaults that need no network."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from typing import Protocol

import pyarrow as pa
from pyspark.sql import DataFrame

#: Characters of a text that a language model is given.
HEAD = 4_096


class TextModel(Protocol):
    def define(self, text: str, software: str) -> str: ...

    def licenses(self, text: str, software: str) -> list[str]: ...


class FirstSentences:
    """Stands in for a language model: the first two sentences, and the known license names that a text holds."""

    def __init__(self, names: list[str] = ()) -> None:
        self.names = sorted(names, key=lambda n: (-len(n), n))

    def define(self, text: str, software: str) -> str:
        return " ".join(re.split(r"(?<=[.!?])\s+", text[:HEAD].strip())[:2])

    def licenses(self, text: str, software: str) -> list[str]:
        low = text[:HEAD].lower()
        return [n for n in self.names if n.lower() in low]


def _told_by(df: DataFrame, model: Callable[[], TextModel], text: str, software: str, ask: Callable, kind: pa.DataType, name: str, sql: str) -> DataFrame:
    columns = ", ".join(f"`{n}` {t}" for n, t in df.dtypes)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = model()
        for batch in batches:
            said = zip(batch.column(text).to_pylist(), batch.column(software).to_pylist(), strict=True)
            answers = pa.array([ask(made, t or "", s or "") for t, s in said], type=kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, answers], names=[*batch.schema.names, name])

    return df.mapInArrow(work, f"{columns}, {name} {sql}")


def define_texts(df: DataFrame, model: Callable[[], TextModel], text: str = "description", software: str = "software") -> DataFrame:
    """``df`` with ``definition`` by the model, which each worker makes once."""
    return _told_by(df, model, text, software, lambda made, t, s: made.define(t, s), pa.string(), "definition", "string")


def extract_licenses(df: DataFrame, model: Callable[[], TextModel], text: str, software: str) -> DataFrame:
    """``df`` with ``found_licenses`` by the model."""
    return _told_by(df, model, text, software, lambda made, t, s: made.licenses(t, s), pa.list_(pa.string()), "found_licenses", "array<string>")
