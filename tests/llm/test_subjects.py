from __future__ import annotations

import random

import pytest

from tapewell.llm import subjects
from tests.llm.phrasings import phrasings


@pytest.fixture(scope="module")
def labels(spark, folder):
    return subjects.read_labels(spark.read.parquet(f"{folder}/subject_label.parquet"))


@pytest.fixture(scope="module")
def matcher(labels):
    return subjects.fit(labels)


def test_held_out_accuracy(labels):
    """Fitted on two thirds, right on most of the rest; a few labels are wrong."""
    rows = list(labels)
    random.Random(1).shuffle(rows)
    cut = len(rows) * 2 // 3
    model = subjects.fit(rows[:cut])
    right = 0
    for text, subject in rows[cut:]:
        found = model.document(text)
        right += bool(found) and max(found, key=lambda s: found[s]) == subject
    assert right / (len(rows) - cut) > 0.9


def test_phrasings_kept_apart(matcher):
    """Texts written before the term lists: at least nine in ten subjects found and right."""
    hit = miss = wrong = 0
    for line in phrasings("subject_phrasings.tsv"):
        subjects_, text = line.split("\t")
        want = set(subjects_.split(",")) - {"-"}
        have = {k for k, (n, _) in matcher.document(text).items() if n >= 2}
        hit, miss, wrong = hit + len(want & have), miss + len(want - have), wrong + len(have - want)
    assert hit / (hit + miss) >= 0.9 and hit / (hit + wrong) >= 0.9


def test_tags_of_any_length(matcher):
    assert subjects.sentences(f"<a title='{'surgeon ' * 500}'>nothing</a>") == [" nothing "]


@pytest.mark.parametrize(
    "sentence,want",
    [
        ("The surgeon at the clinic treated three patients.", {"health"}),
        ("Prosecutors told the jury about the bribe.", {"law"}),
        ("In the court of public opinion it is over.", set()),
        ("It is a marathon, not a sprint.", set()),
        ("By the way, my cousin used to work in gene therapy.", set()),
        ("The bank branch was closed for lunch.", None),
        ("Nothing happened today.", set()),
        ("THE STRIKER MISSED THE PENALTY SHOOTOUT.", {"sport"}),
        ("The  wind  turbines  fed  the  power  grid.", {"energy"}),
        ("Der Torwart hielt den Elfmeter.", {"sport"}),
    ],
)
def test_sentences(matcher, sentence, want):
    got = set(matcher.subjects(subjects.sentences(sentence)[0]))
    assert want is None or got == want


def test_a_single_sentence_is_not_a_case(spark, labels, folder):
    two = "The surgeon left the clinic. The nurse stayed with the patients."
    rows = [(1, two), (2, two.split(". ")[0]), (3, None), (4, ""), (5, "  \n "), (6, two.replace(". ", ".<br>")), (None, two), (1, two), (7, "word " * 200_000 + ". " + two)]
    df = spark.createDataFrame(rows, "subject long, text string")
    got = subjects.document_subjects(df, "subject", "text", spark.read.parquet(f"{folder}/subject_label.parquet")).toDF("k", "subject", "sentences", "score").collect()
    assert sorted((r["k"] or 0, r["subject"]) for r in got) == [(0, "health"), (1, "health"), (1, "health"), (6, "health"), (7, "health")]


def test_markup_and_broken_encoding():
    assert subjects.sentences("<b>Halbleiterwerk</b> &amp; Ölpreis".encode().decode("latin-1"))[0].strip() == "halbleiterwerk ölpreis"
    assert subjects.sentences(None) == []


def test_bounds(spark, folder, monkeypatch):
    monkeypatch.setattr(subjects, "MOST_LABELS", 5)
    with pytest.raises(ValueError):
        subjects.read_labels(spark.read.parquet(f"{folder}/subject_label.parquet"))


def test_empty_table(spark, folder):
    df = spark.createDataFrame([], "k long, t string")
    assert subjects.document_subjects(df, "k", "t", spark.read.parquet(f"{folder}/subject_label.parquet")).count() == 0


def test_without_labels_and_odd_long_texts():
    model = subjects.fit([])
    assert set(model.document("The surgeon left the clinic. The nurse stayed with the patients.")) == {"health"}
    for text in ("a" * 500_000, ". " * 200_000, "surgeon " * 60_000, "<b" * 100_000, "Ã" * 200_000):
        model.document(text)


def test_a_stronger_subject_does_not_hide_another():
    matcher = subjects.Matcher({"law": {"jury": 3.0, "bribe": 3.0}, "software": {"compiler": 3.0}}, limits={"law": 1.9, "software": 1.9})
    assert matcher.subjects(" jury bribe compiler ") == {"law": 6.0, "software": 3.0}


def test_limits_are_those_of_the_labels():
    terms = {"law": {"jury": 3.0, "gavel": 2.2}, "software": {"compiler": 3.0}}
    model = subjects.fit([("The jury.", "law")] * 3 + [("A gavel and a compiler.", "software")] * 3, terms)
    assert model.limits["law"] > 2.2
