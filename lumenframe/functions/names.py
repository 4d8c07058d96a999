"""Names of features: ``Algorithm (Outer (Inner (channel))) [index]``. The innermost transform is applied first."""

from __future__ import annotations

import re
from dataclasses import dataclass


@dataclass(frozen=True)
class Feature:
    algorithm: str
    transforms: tuple[str, ...]  # in the order in which they are applied
    channel: str = ""
    index: int = 0

    @property
    def group(self) -> str:
        inner = f"({self.channel})"
        for t in self.transforms:
            inner = f"({t} {inner})"
        return f"{self.algorithm} {inner}"

    @property
    def name(self) -> str:
        return f"{self.group} [{self.index}]"


def parse(name: str, legacy: dict[str, str] | None = None) -> Feature:
    """Blanks count only within names; without an index it is 0, without brackets the whole name is the algorithm's.
    ``legacy`` maps old names to new ones."""
    name = (legacy or {}).get(name, name)
    found = re.search(r"\[\s*(\d+)[^\]]*\]\s*$", name)
    index = int(found[1]) if found else 0
    head = name[: name.rfind("[")] if "[" in name else name
    algorithm, opening, rest = head.partition("(")
    parts = [p.strip() for p in rest.split("(")] if opening else []
    if parts and rest.count(")") != len(parts):
        raise ValueError(f"brackets of {name!r} don't close")
    channel = parts[-1].split(")")[0].strip() if parts else ""
    return Feature(algorithm.strip(), tuple(reversed(parts[:-1])), channel, index)


def read_legacy(text: str) -> dict[str, str]:
    """Old and new names, a tab between them; lines that don't begin with a letter (after blanks) don't count."""
    out = {}
    for line in text.splitlines():
        old, tab, new = line.strip().partition("\t")
        if tab and old[:1].isalpha():
            out[old.strip()] = new.strip()
    return out
