from __future__ import annotations

import random

import numpy as np
import pytest

from tapewell.llm import toxicity
from tests.llm.phrasings import phrasings


@pytest.fixture(scope="module")
def labels(spark, folder):
    return toxicity.read_labels(spark.read.parquet(f"{folder}/toxic_label.parquet"))


@pytest.fixture(scope="module")
def ordinary(spark, folder):
    return [r[0] for r in spark.read.parquet(f"{folder}/subject_label.parquet").select("text").collect()]


@pytest.fixture(scope="module")
def tagger(labels, ordinary):
    return toxicity.train(labels, ordinary)


def test_phrasings_kept_apart(tagger):
    """Sentences written before the word lists and patterns: at least nine in ten found and right."""
    rows = [line.split("\t") for line in phrasings("toxicity_phrasings.tsv")]
    got = tagger.scores([t for _, t in rows])[0] >= tagger.threshold
    truth = np.array([y == "1" for y, _ in rows])
    assert (got & truth).sum() / truth.sum() >= 0.9 and (got & truth).sum() / got.sum() >= 0.9


def test_misspelt_words(tagger):
    plain = tagger.reader.plain
    assert [plain(w) for w in ("imbecle", "imbeccile", "callate", "scumbagg", "parasites", "moon", "whole")] == ["imbecile", "imbecile", "cállate", "scumbag", "parasites", "moon", "whole"]


def flagged(tagger, *texts):
    return [bool(x) for x in tagger.scores(list(texts))[0] >= tagger.threshold]


def test_held_out_accuracy(labels):
    rows = list(labels)
    random.Random(2).shuffle(rows)
    cut = len(rows) * 2 // 3
    model = toxicity.train(rows[:cut])
    got = model.scores([t for t, _ in rows[cut:]])[0] >= model.threshold
    assert np.mean(got == np.array([bool(y) for _, y in rows[cut:]])) > 0.93


def test_abuse_and_ordinary_talk(tagger):
    assert all(flagged(tagger, "You are a pathetic idiot.", "I will find you and break your neck.", "All immigrants are cockroaches, deport them.", "She gave me a blowjob.", "Du bist ein widerliches Arschloch."))
    assert not any(flagged(tagger, "I was an idiot to sell.", "Damn, what a shitty quarter.", "Shorts got slaughtered.", "They killed the dividend.", "Naked puts are risky.", "", " ", None))


@pytest.mark.parametrize(
    "disguised",
    ["you p4th3+1c 1d10+", "you p a t h e t i c i d i o t", "you pathetic i.d.i.o.t", "you path​etic id​iot", "you p*thetic i***t", "you pathetiiiic idiooot", "you ptahetic idoit", "you раthеtiс idiоt", "YOU PATHETIC IDIOT", "you pa_th pathetic i-d-i-o-t"],
)
def test_disguises(tagger, disguised):
    assert flagged(tagger, disguised) == [True]


def test_forward_backward_against_enumeration(tagger):
    """Marginals of a short chain by adding up all label sequences."""
    from itertools import product

    u = np.array([[0.3, -1.2, 2.0, 0.1]])
    enter, leave, stay = tagger.steps
    step = {(0, 0): 0.0, (0, 1): enter, (1, 0): leave, (1, 1): stay}
    total, mass = 0.0, np.zeros(4)
    for y in product((0, 1), repeat=4):
        w = np.exp(sum(u[0, i] for i in range(4) if y[i]) + sum(step[y[i], y[i + 1]] for i in range(3)))
        total += w
        mass += w * np.array(y)
    ahead, back = toxicity._chains(u, np.ones_like(u, bool), tagger.steps)
    assert 1 / (1 + np.exp(-(ahead + back)[0])) == pytest.approx(mass / total)


def test_offsets(tagger):
    text = "Chart looks fine. You are a pathetic​ idiot. See you."
    spans = toxicity.locate(tagger, text)
    assert spans and all(18 <= s["start"] < s["end"] <= len(text) for s in spans)
    assert "idiot" in "".join(text[s["start"] : s["end"]] for s in spans)


def test_table(spark, folder):
    labels = spark.read.parquet(f"{folder}/toxic_label.parquet")
    rows = [(1, "You are a pathetic idiot.", "s"), (2, "Nice chart.", None), (3, None, "s"), (4, "", "s"), (1, "You are a pathetic idiot.", "s"), (None, "word " * 100_000 + ". You stupid pig.", "s")]
    df = spark.createDataFrame(rows, "k long, text string, flag string").selectExpr("*", "'old' AS score", "1 AS spans")  # clashing names
    scored = toxicity.score_table(df, "text", labels, spans=True)
    got = sorted((r["k"] or 0, r["flagged"], len(r["spans"]) > 0) for r in scored.collect())
    assert got == [(0, True, True), (1, True, True), (1, True, True), (2, False, False), (3, False, False), (4, False, False)]
    rates = {r["flag"]: (r["records"], r["flagged"]) for r in toxicity.rates(scored, "flag").collect()}
    assert rates == {"s": (5, 3), None: (1, 0)}
    assert toxicity.score_table(df.where("false"), "text", labels).count() == 0


@pytest.mark.parametrize("text", ["a" * 300_000, "a " * 150_000, "1" * 300_000, "a*" * 100_000, ".a" * 100_000, "@" * 200_000, "fuuuuck" * 40_000, "\n" * 100_000])
def test_odd_long_texts_end_soon(tagger, text):
    import time

    began = time.perf_counter()
    tagger.scores([text, "You are a pathetic idiot."])
    assert time.perf_counter() - began < 10


def test_without_labels():
    model = toxicity.train([])
    assert flagged(model, "You are a pathetic idiot.", "Nice chart.") == [True, False]
    assert flagged(toxicity.train([(None, 1), ("", 0), ("x", None)]), "Nice chart.") == [False]


@pytest.mark.parametrize("text", ["Q&amp;A &gt; fine &quot;text&quot;. You are a pathetic&nbsp;idiot, don&#39;t post.", "&amp;gt; R&amp;amp;D. You​ are a pathetic idi​ot &lt;3", "ab &amp; c. You are a pathetic idiot."])
def test_offsets_beside_entities(tagger, text):
    shown = [text[s["start"] : s["end"]].replace("​", "") for s in toxicity.locate(tagger, text)]
    assert any("idiot" in s for s in shown) and not any("fine" in s or "D." in s or "c." in s for s in shown)


def test_offsets_follow_the_words_of_odd_texts(tagger):
    import random

    r = random.Random(3)
    parts = ["&amp;", "&gt;", "gt;", "&", "amp;", "&#39;", "#39;", "&nbsp;", "​", "", "idiot", "i d i o t", " ", ".", "\n", "don", "t", "é", "…"]
    for _ in range(3000):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        assert all(0 <= s["start"] < s["end"] <= len(text) for s in toxicity.locate(tagger, text))


def test_letters_drawn_out_beyond_any_length(tagger):
    assert tagger.reader.plain("idi" + "o" * 500 + "t") == "idiot"


def test_every_sentence_goes_through_the_field(tagger):
    scores, p, _ = tagger.scores(["Nice chart today. We hold.", "", "nothing"])
    assert (p > 0).all() and scores[0] > 0 and scores[1] == 0 and scores[2] > 0


def test_abuse_without_an_offensive_word(tagger):
    """Sentences written before the patterns of implied abuse: 0.45 found (0.30 before those), 0.90 right."""
    rows = [line.split("\t") for line in phrasings("implied_phrasings.tsv")]
    got = tagger.scores([t for _, t in rows])[0] >= tagger.threshold
    truth = np.array([y == "1" for y, _ in rows])
    assert (got & truth).sum() / truth.sum() >= 0.4 and (got & truth).sum() / got.sum() >= 0.85


def test_abuse_without_an_offensive_word_against_the_talk_of_the_table(spark, folder, labels, ordinary):
    """With unlabelled records of the table beside the labels, 0.7 of the same sentences are found (0.45 without)."""
    talk = toxicity.read_background(spark.read.parquet(f"{folder}/mention.parquet"))
    model = toxicity.train(labels, ordinary, talk)
    rows = [line.split("\t") for line in phrasings("implied_phrasings.tsv")]
    truth = np.array([y == "1" for y, _ in rows])
    got = model.scores([t for _, t in rows])[0] >= model.threshold
    assert (got & truth).sum() / truth.sum() >= 0.7 and (got & truth).sum() / got.sum() >= 0.85
    assert not any(model.scores(ordinary)[0] >= model.threshold)
    assert flagged(model, "You are a pathetic idiot.", "Nice chart.", "I was an idiot to sell.", "", None) == [True, False, False, False, False]


def test_talk_of_a_table_is_chosen_by_id(spark):
    rows = [(str(i), f"text {i}") for i in range(400)] + [(None, "no id"), ("x", None), ("y", "long " * 1000)]
    df = spark.createDataFrame(rows, "id string, text string")
    some = toxicity.read_background(df, 50)
    assert len(some) == len(set(some)) == 50 and "no id" not in some
    assert some == toxicity.read_background(df.union(df).repartition(7).orderBy("text"), 50)
    assert sorted(toxicity.read_background(df, 1000)) == sorted(t for i, t in rows[:400])
    assert toxicity.read_background(df.where("false")) == []


def test_equal_sentences_are_put_together(tagger):
    one, other = toxicity._marked(tagger.reader, ["[[you fool]]", "nice chart", "[[you fool]]"]), toxicity._marked(tagger.reader, ["nice chart", "you fool"])
    ids, _, sentence, gold, weight = toxicity._joined((one, 1.0), (other, 0.5))
    assert weight.tolist() == [2.0, 1.5, 0.5] and sentence.tolist() == [0, 0, 1, 1, 2, 2] and gold.tolist() == [True, True, False, False, False, False]
    assert ids[:2].tolist() == ids[4:].tolist()
