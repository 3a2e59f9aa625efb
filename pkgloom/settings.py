"""Settings of a run: defaults, then a JSON file, then the environment (PKGLOOM__SECTION__NAME), later ones first."""

from __future__ import annotations

import json
import logging
import os
from dataclasses import dataclass, field, fields
from pathlib import Path

PREFIX = "PKGLOOM__"


@dataclass(frozen=True)
class Paths:
    reference: str = "reference"
    results: str = "results"
    answers: str = ""


@dataclass(frozen=True)
class Logging:
    level: str = "INFO"
    file: str = ""


@dataclass(frozen=True)
class Settings:
    paths: Paths = field(default_factory=Paths)
    logging: Logging = field(default_factory=Logging)


def load(path: str | None = None, environment: dict[str, str] | None = None) -> Settings:
    """Unknown sections and names are refused, so that a misspelt setting does not pass unnoticed."""
    environment = dict(os.environ) if environment is None else environment
    given: dict[str, dict[str, str]] = json.loads(Path(path).read_text()) if path else {}
    for key, value in environment.items():
        if key.startswith(PREFIX):
            section, _, name = key.removeprefix(PREFIX).lower().partition("__")
            given.setdefault(section, {})[name] = value
    made = {}
    for f in fields(Settings):
        made[f.name] = {"paths": Paths, "logging": Logging}[f.name](**given.pop(f.name, {}))
    if given:
        raise ValueError(f"unknown settings: {', '.join(sorted(given))}")
    return Settings(**made)


class JsonLines(logging.Formatter):
    """One JSON object a record, with whatever was handed over as ``extra``."""

    KNOWN = set(vars(logging.makeLogRecord({}))) | {"message", "asctime"}

    def format(self, record: logging.LogRecord) -> str:
        out = {"time": self.formatTime(record), "level": record.levelname, "logger": record.name, "message": record.getMessage()}
        out |= {k: v for k, v in vars(record).items() if k not in self.KNOWN}
        if record.exc_info:
            out["error"] = self.formatException(record.exc_info)
        return json.dumps(out, default=str, ensure_ascii=False)


def start_logging(settings: Settings) -> logging.Logger:
    """The driver's logger, as JSON lines to a file or to the error stream."""
    logger = logging.getLogger("pkgloom")
    handler = logging.FileHandler(settings.logging.file) if settings.logging.file else logging.StreamHandler()
    handler.setFormatter(JsonLines())
    logger.handlers = [handler]
    logger.setLevel(settings.logging.level)
    logger.propagate = False
    return logger
