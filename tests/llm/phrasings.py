"""Phrasings kept apart from the resources, for measuring."""

from __future__ import annotations

from pathlib import Path


def phrasings(name: str) -> list[str]:
    lines = (Path(__file__).with_name("data") / name).read_text(encoding="utf-8").splitlines()
    return [line for line in lines if line and not line.startswith("#")]
