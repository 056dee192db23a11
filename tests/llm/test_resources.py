"""The resources are general: none of their sentences, frames or longer phrases stands in the texts of the given tables.

The two label tables are given for fitting and aren't compared. Short phrases are vocabulary and may occur.
"""

from __future__ import annotations

import re

import pytest

from tapewell.llm import pii, subjects, toxicity

WORDS = 4


def words(text: str) -> str:
    return " " + " ".join(re.findall(r"[^\W_]+", text.casefold())) + " "


def pieces() -> set[str]:
    """Stretches of at least ``WORDS`` words between the slots of patterns and frames, and terms that long."""
    texts: list[str] = []
    for _, pattern in toxicity.Patterns().patterns:
        while "(" in pattern:  # alternatives can't be taken apart from each other: each is a text of its own
            texts += [a for m in re.findall(r"\(([^()]*)\)", pattern) for a in m.split("|")]
            pattern = re.sub(r"\([^()]*\)", "{}", pattern)
        texts.append(pattern)
    texts += [f for frames in pii._Maker.FRAMES.values() for f in frames]
    texts += [t for terms in toxicity.read_lists().values() for t in terms]
    texts += [t.rstrip("*") for terms in subjects.read_terms().values() for t in terms]
    parts = {words(p) for t in texts for p in re.split(r"\{[^{}]*\}|\[\[|\]\]", t)}
    return {p for p in parts if len(p.split()) >= WORDS}


@pytest.mark.parametrize("name", ["mention", "documents"])
def test_no_longer_phrase_of_the_resources_stands_in_the_tables(spark, name):
    import ahocorasick

    some = pieces()
    assert len(some) > 150
    automaton = ahocorasick.Automaton()
    for p in some:
        automaton.add_word(p, p.strip())
    automaton.make_automaton()
    texts = spark.read.parquet(f"/root/testdata/sf0.1/{name}.parquet").select("text").distinct().collect()
    found = {hit for r in texts if r[0] for _, hit in automaton.iter(words(r[0]))}
    assert not found
