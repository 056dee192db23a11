"""Subject areas of documents: weighted terms found by a multi-pattern automaton."""

from __future__ import annotations

import html
import re
import unicodedata
from bisect import bisect_left
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from functools import lru_cache
from pathlib import Path

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewell.session import spread

TERMS = Path(__file__).with_name("data") / "subject_terms.txt"
#: Figures of speech hide what they contain; a passing remark takes its sentence out.
HIDDEN, PASSING = "-", "?"
#: Labelled texts read on the driver: a documented bound, a larger table is refused.
MOST_LABELS = 20_000
#: Sentences of a document that must be about a subject.
LEAST_SENTENCES = 2
#: Words from which the score of a sentence is divided by the root of its length.
USUAL_WORDS = 10

_BREAK = re.compile(r"(?<=[.!?…。！？])\s+|[\r\n]+")
_BLOCK_TAG = re.compile(r"</?(?:br|p|div|li|ul|ol|h[1-6]|tr|td|table|blockquote)\b[^<>]*>", re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_NOISE = re.compile(r"[^\w]+")


def clean(text: str) -> str:
    """Markup resolved, compatibility form, case folded; UTF-8 read as Latin-1 is repaired where that is possible."""
    if "<" in text:
        text = _TAG.sub(" ", _BLOCK_TAG.sub("\n", text))
    if "&" in text:
        text = html.unescape(text)
    if "Ã" in text or "â€" in text:
        try:
            text = text.encode("cp1252").decode("utf-8")
        except UnicodeError:
            text = re.sub("[Â-ß][\u0080-¿]", lambda m: m[0].encode("latin-1").decode("utf-8"), text)
    return unicodedata.normalize("NFKC", text).casefold().replace("\u200b", "").replace("\ufeff", "")


def sentences(text: str | None) -> list[str]:
    """Sentences of a text, each as words with single spaces, padded with spaces; empty ones are left out."""
    if not text:
        return []
    parts = (_NOISE.sub(" ", part).strip() for part in _BREAK.split(clean(text)))
    return [f" {part} " for part in parts if part]


def read_terms(path: Path = TERMS) -> dict[str, dict[str, float]]:
    """subject -> term -> weight. A term with a star at its end stands for every word that begins so."""
    out: dict[str, dict[str, float]] = {}
    subject = ""
    for line in path.read_text(encoding="utf-8").splitlines():
        if line.startswith("#") or not line.strip():
            continue
        if line.startswith("=="):
            subject = line[2:].strip()
            out.setdefault(subject, {})
            continue
        weight, _, terms = line.partition(":")
        for term in terms.split(","):
            words = _NOISE.sub(" ", clean(term)).strip()
            if words:
                words += "*" if term.rstrip().endswith("*") else ""
                out[subject][words] = max(float(weight), out[subject].get(words, 0))
    return out


class Matcher:
    """Automaton over all terms with weights, rarity and thresholds; small enough to travel with a task."""

    def __init__(self, terms: dict[str, dict[str, float]], rarity: dict[tuple[str, str], float] | None = None, limits: dict[str, float] | None = None) -> None:
        import ahocorasick

        self.limits = limits or {}
        weights: dict[str, list[tuple[str, float]]] = defaultdict(list)
        for subject, own in terms.items():
            for term, weight in own.items():
                value = weight * (rarity or {}).get((subject, term), 1.0)
                forms = {term}
                if subject not in (HIDDEN, PASSING) and len(term) > 2 and not term.endswith(("s", "*")):
                    forms.add(term + "s")
                for form in forms:
                    weights[form].append((subject, value))
        self.automaton = ahocorasick.Automaton()
        for form, values in weights.items():
            key = " " + form[:-1] if form.endswith("*") else " " + form + " "
            self.automaton.add_word(key, (len(key), len(form.rstrip("*")), values))
        self.automaton.make_automaton()

    def score(self, sentence: str) -> dict[str, float]:
        """subject -> score of one padded sentence; none for a passing remark."""
        found = [(end - size + 1, -length, values) for end, (size, length, values) in self.automaton.iter(sentence)]
        if not found:
            return {}
        found.sort(key=lambda x: x[:2])
        total: dict[str, float] = defaultdict(float)
        upto, seen = -1, set()
        for start, minus, values in found:
            if start <= upto - 1:  # inside a longer term; neighbours share one space
                continue
            upto = start - minus + 1
            for subject, weight in values:
                if subject == PASSING:
                    return {}
                if subject != HIDDEN and (subject, start) not in seen:
                    seen.add((subject, start))
                    total[subject] += weight
        length = max(1.0, (sentence.count(" ") - 1) / USUAL_WORDS) ** 0.5
        return {k: v / length for k, v in total.items()}

    def subjects(self, sentence: str) -> dict[str, float]:
        """Subjects that the sentence is about: every one at or above its limit."""
        return {k: v for k, v in self.score(sentence).items() if v >= self.limits.get(k, 1.5)}

    def document(self, text: str | None) -> dict[str, tuple[int, float]]:
        """subject -> (sentences about it, sum of their scores)."""
        out: dict[str, tuple[int, float]] = {}
        for sentence in sentences(text):
            for subject, score in self.subjects(sentence).items():
                n, s = out.get(subject, (0, 0.0))
                out[subject] = (n + 1, s + score)
        return out


def fit(labels: Iterable[tuple[str | None, str | None]], terms: dict[str, dict[str, float]] | None = None) -> Matcher:
    """Curated terms with rarity, further terms and limits from labelled texts.

    Rarity: a term seen in the labelled texts of other subjects too loses weight by the share of texts that
    carry another label. Phrases of two or three words that occur in at least four texts, nearly all of one
    subject, join its terms. The limit of a subject is the middle of the best range of limits for telling its
    texts from the others, so a few wrong labels don't move it.
    """
    terms = {k: dict(v) for k, v in (terms or read_terms()).items()}
    rows = [(sentences(t), s) for t, s in labels if t and s]
    known = {s for _, s in rows}
    for subject in known:
        terms.setdefault(subject, {})
    seen: dict[str, Counter] = defaultdict(Counter)
    for parts, subject in rows:
        grams = set()
        for part in parts:
            words = part.split()
            for n in (1, 2, 3):
                grams.update(" ".join(words[i : i + n]) for i in range(len(words) - n + 1))
        for gram in grams:
            seen[gram][subject] += 1
    rarity, ordered = {}, sorted(seen)
    for subject, own in terms.items():
        for term in own:
            counts = seen.get(term)
            if term.endswith("*"):
                counts = Counter()
                for gram in ordered[bisect_left(ordered, term[:-1]) : bisect_left(ordered, term[:-1] + "\uffff")]:
                    if gram.count(" ") == term.count(" "):
                        counts.update(seen[gram])
            if counts and subject not in (HIDDEN, PASSING) and sum(counts.values()) >= 4:
                rarity[subject, term] = max(0.15, counts[subject] / sum(counts.values())) if counts[subject] else 0.5
    for gram, counts in seen.items():
        subject, n = counts.most_common(1)[0]
        words = gram.split()
        if len(words) >= 2 and n >= 4 and n >= 0.85 * sum(counts.values()) and not any(gram in own for own in terms.values()):
            if min(len(words[0]), len(words[-1])) > 3 and all(sum(seen[w].values()) < 0.15 * len(rows) for w in words):
                terms[subject][gram] = 2.0
    matcher = Matcher(terms, rarity)
    limits = {}
    best = [[max((matcher.score(p).get(s, 0.0) for p in parts), default=0.0) for s in sorted(known)] for parts, _ in rows]
    for k, subject in enumerate(sorted(known)):
        grid = [0.8 + 0.1 * i for i in range(23)]
        quality = []
        for limit in grid:
            hit = sum(row[k] >= limit and s == subject for row, (_, s) in zip(best, rows))
            wrong = sum(row[k] >= limit and s != subject for row, (_, s) in zip(best, rows))
            quality.append(2 * hit / max(1, hit + wrong + sum(s == subject for _, s in rows)))
        top = [g for g, q in zip(grid, quality) if q >= max(quality) - 0.005]
        limits[subject] = top[len(top) // 2]
    matcher.limits = limits
    matcher.settings = (terms, rarity, limits)
    return matcher


@lru_cache(maxsize=4)
def _rebuilt(settings: bytes) -> Matcher:
    import pickle

    return Matcher(*pickle.loads(settings))


def read_labels(labels: DataFrame, text: str = "text", subject: str = "subject") -> list[tuple[str, str]]:
    rows = labels.select(text, subject).limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labelled texts; give a sample")
    return [(r[0], r[1]) for r in rows]


def document_subjects(documents: DataFrame, key: str, text: str, labels: DataFrame, least: int = LEAST_SENTENCES) -> DataFrame:
    """(key, subject, sentences, score) for every subject with at least ``least`` sentences in the document.

    One pass over the texts without a shuffle: the matcher (a few thousand terms, fitted on at most
    ``MOST_LABELS`` labelled texts) travels with the tasks. Texts are read whole, whatever their length; null,
    empty and blank texts have no subject. A key may be null or repeat: each row stands for itself.
    """
    import pickle

    settings = pickle.dumps(fit(read_labels(labels)).settings)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = _rebuilt(settings)
        for frame in frames:
            rows = [(k, s, n, v) for k, t in zip(frame.iloc[:, 0].tolist(), frame.iloc[:, 1].tolist()) for s, (n, v) in matcher.document(t).items() if n >= least]
            yield pd.DataFrame(rows, columns=["key", "subject", "sentences", "score"])

    kind = documents.schema[key].dataType.simpleString()
    return spread(documents.select(key, text)).mapInPandas(run, f"key {kind}, subject string, sentences int, score double").withColumnRenamed("key", key)


def corpus_shares(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(subject, documents, share): how many documents have each subject, and their share of all documents."""
    total = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    return found.groupBy("subject").agg(F.count(F.lit(1)).alias("documents")).withColumn("share", F.col("documents") / total)
