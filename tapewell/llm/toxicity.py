"""Abusive, hateful and sexual language: a linear-chain conditional random field over words."""

from __future__ import annotations

import pickle
import random
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator, Sequence
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapewell.llm.tokens import DEFAULT_FOLDER, common_words
from tapewell.operators.records import latest_records
from tapewell.session import spread

_DATA = Path(__file__).with_name("data")
#: Labelled texts read on the driver: a documented bound, a larger table is refused.
MOST_LABELS = 20_000
#: Words whose reading is remembered per worker; beyond it the memory starts anew.
MOST_WORDS = 400_000
#: Sentences made from each pattern (times the pattern's own number).
COPIES = 10
#: Times that texts of another label table are repeated in the fit, as they are few beside the made sentences.
ORDINARY = 2
#: Unlabelled records that the fit of a table sees as its ordinary talk; longer ones are passed over there, as the driver holds these texts.
BACKGROUND, BACKGROUND_LENGTH = 10_000, 2_000
#: Sentences of the ordinary talk in the fit for each made one, whatever the size of the table.
BACKGROUND_WEIGHT = 2.0
#: Padded words in one call of the recursions.
CHUNK = 400_000
_OFFENSIVE = ("insult_noun", "insult_adj", "insult_phrase", "slur", "shut", "threat", "harm", "threat_phrase", "dehuman", "erase", "sex_body", "sex_strong", "contempt")
#: Classes whose words are also found in disguise.
_DISGUISED = (*_OFFENSIVE[:-1], "you", "group", "sex_weak", "fword")

# Invisible characters, look-alike letters and digits or signs written for letters.
_INVISIBLE = "\u200b\u200c\u200d\u2060\ufeff\u00ad"
_LOOKALIKES = str.maketrans("асеоріхукмтнвѕјԁһԛԝαοερικνυτ", "aceopixykmthbsjdhqwaoepikvut")
_LEET = str.maketrans("0134578@$+!|", "oieastbastil")
_LEET_L = str.maketrans("0134578@$+!|", "oleastbastil")

#: Ordinary words that a swap of neighbours turns into a listed one.
_NOT_SWAPPED = frozenset({"carp", "bran", "from", "form", "trial", "trail", "angel", "casual", "causal", "silver", "sliver"})
#: Endings of words that no list holds: peoples, and compounds with an insult.
_ENDINGS = {
    "demonym": re.compile(r"[^\W\d_]{3,}(?:ians|eans|ans|ites|ese|ish)"),
    "insult_noun": re.compile(r"[^\W\d_]{3,}(?:tards?|fucks?|fuckers?|cunts?|bitch|bitches|brained|wits?|whores?|idiots?|arschloch|arschlöcher|hurensohn|wichser|idiot|trottel)"),
}

_RECORD = "\ue000"
_LETTER = r"[^\W\d_]"
_SPACED = "|".join(rf"{_LETTER}(?:{sep}{_LETTER}){{2,}}{end}" for sep, end in ((" ", ""), (r"\.", r"(?:\.(?=\s\.))?"), ("_", ""), ("-", "")))
_TOKEN = re.compile(rf"{_RECORD}|(?<![^\W_])(?:{_SPACED})(?![^\W_])|[^\s.,;:!?\"“”„«»()\[\]<>{{}}…¿¡|/{_RECORD}]+|[.!?…]+(?=\s|$)|\n")
_END = 1  # id of a sentence end
_MARK = 2  # id of a record end


def read_lists(path: Path = _DATA / "toxicity_terms.txt") -> dict[str, list[str]]:
    """Terms by the full name of their line; the class is the part before the first dot."""
    out: dict[str, list[str]] = {}
    for line in path.read_text(encoding="utf-8").splitlines():
        if line.strip() and not line.startswith("#"):
            name, _, terms = line.partition(":")
            out.setdefault(name.strip(), []).extend(t.strip() for t in terms.split(",") if t.strip())
    return out


def read_classes() -> dict[str, list[str]]:
    out: dict[str, list[str]] = {name: [] for name in _ENDINGS}
    for name, terms in read_lists().items():
        if not name.startswith("slot."):
            out.setdefault(name.partition(".")[0], []).extend(terms)
    return out


class Patterns:
    """Sentences for training, made from patterns and the word lists with a fixed seed; ``half``: of one half of the patterns only."""

    def __init__(self, path: Path = _DATA / "toxicity_patterns.txt", seed: int = 11, half: int | None = None) -> None:
        self.r, self.lists = random.Random(seed), read_lists()
        self.patterns: list[tuple[int, str]] = []
        for line in path.read_text(encoding="utf-8").splitlines():
            if line.strip() and not line.startswith(("#", "==")):
                head, _, rest = line.partition(" ")
                self.patterns.append((int(head), rest) if head.isdigit() else (1, line))
        if half is not None:
            order = random.Random(5).sample(range(len(self.patterns)), len(self.patterns))
            self.patterns = [self.patterns[i] for i in sorted(order[half::2])]

    def invented(self) -> str:
        return "".join(self.r.choice("bdfgklmnprstvz") + self.r.choice("aeiou") for _ in range(self.r.randint(2, 3)))

    def fill(self, m: re.Match) -> str:
        name = m[1]
        if name in ("word", "invented"):
            return self.invented() + self.r.choice("lnrstk")
        if name == "people":
            return self.invented() + self.r.choice(["rians", "nians", "ans", "vish people", "lish", "nese", "rites"])
        return self.r.choice(self.lists[name])

    def made(self, pattern: str) -> str:
        while "(" in pattern:
            pattern = re.sub(r"\(([^()]*)\)", lambda m: self.r.choice(m[1].split("|")), pattern)
        text = re.sub(r"\{([a-z_.]+)\}", self.fill, pattern)
        return text if self.r.random() < 0.6 else text + self.r.choice([".", "!", ", " + self.invented(), " today"])

    def sentences(self, copies: int = COPIES) -> list[str]:
        """Sentences of all patterns, and half as many clean ones of words that offend nobody, among them the patterns' own."""
        made = [self.made(p) for n, p in self.patterns for _ in range(n * copies)]
        harmless = [w for name in ("you", "third", "self", "people", "group.en", "intens.x", "praise.x", "market.x") for w in self.lists[name]]
        plain = sorted(self.words())
        return made + [" ".join(self.r.choice(plain if self.r.random() < 0.7 else harmless) for _ in range(self.r.randint(3, 9))) for _ in range(len(made) // 2)]

    def words(self) -> set[str]:
        """Words that stand in the patterns themselves and in no offensive class."""
        listed = {t for name, terms in self.lists.items() if name.partition(".")[0] in _OFFENSIVE for t in terms}
        return {w.casefold() for _, p in self.patterns for w in re.findall(r"[^\W\d_][^\W\d_'’]*", re.sub(r"\{[a-z_.]+\}", " ", p))} - listed


def _without_accents(word: str) -> str:
    return "".join(c for c in unicodedata.normalize("NFD", word) if not unicodedata.combining(c))


#: Decoded one after the other, so that what the first uncovers is decoded too.
_ENTITIES = (("&amp;", "&"), ("&gt;", " "), ("&lt;", " "), ("&quot;", " "), ("&#39;", "'"), ("&nbsp;", " "))


class Reader:
    """Turns texts into arrays of word ids, word classes and sentence numbers.

    A word in disguise is read as the listed word behind it: invisible characters, look-alike letters,
    digits and signs for letters, letters set apart, letters masked by stars, letters drawn out, two
    neighbours swapped, accents left off, or one letter too many or too few where that gives no ordinary word. Only words of
    the offensive classes are looked for in disguise. Ordinary words are those that a public vocabulary holds whole.
    """

    def __init__(self, words: Sequence[str] = (), folder: str = DEFAULT_FOLDER) -> None:
        classes = read_classes()
        self.classes = ["", *classes]
        self.words: dict[str, int] = {}
        of: list[int] = [0, 0, 0]
        self.endings: list[tuple[re.Pattern, int]] = []
        for name, ending in _ENDINGS.items():  # words known by their ending share a number
            self.endings.append((ending, len(of)))
            of.append(self.classes.index(name))
        self.phrases: dict[int, list[tuple[tuple[int, ...], int]]] = {}

        def number(word: str, kind: int) -> int:
            if word not in self.words:
                self.words[word] = len(of)
                of.append(kind)
            elif kind and not of[self.words[word]]:
                of[self.words[word]] = kind
            return self.words[word]

        strong: list[str] = []
        for k, (name, terms) in enumerate(classes.items(), 1):
            for term in terms:
                parts = term.casefold().split()
                if len(parts) == 1:
                    number(parts[0], k)
                    if name in _DISGUISED:
                        strong.append(parts[0])
        for k, (name, terms) in enumerate(classes.items(), 1):
            for term in terms:
                parts = term.casefold().split()
                if len(parts) > 1:
                    ids = tuple(number(p, 0) for p in parts)
                    self.phrases.setdefault(ids[0], []).append((ids, k))
                    if name in _DISGUISED:
                        strong.extend(p for p in parts if len(p) > 4)
        for word in words:
            number(word, 0)
        self.of = np.array(of, np.int16)
        self.strong = frozenset(strong)
        self.by_length: dict[int, list[str]] = {}
        self.squeezed: dict[str, str] = {}
        # a mask may fit several words: the more offensive classes come first
        rank = {name: i for i, name in enumerate(_DISGUISED)}
        for word in sorted(self.strong, key=lambda w: (rank.get(self.classes[of[self.words[w]]], len(rank)), w)):
            self.by_length.setdefault(len(word), []).append(word)
            self.squeezed.setdefault(re.sub(r"(.)\1+", r"\1", word), word)
        for some in self.phrases.values():  # a longer phrase has the last word
            some.sort(key=lambda x: len(x[0]))
        self.size = len(of)
        self.starts = np.unique([ids[0] * self.size + ids[1] for some in self.phrases.values() for ids, _ in some])
        self.longest = max(map(len, self.words))
        self.unaccented = {}
        for word in self.words:
            if not word.isascii():
                self.unaccented.setdefault(_without_accents(word), word)
        ordinary = common_words(folder)
        self.short: dict[str, str] = {}
        for word in sorted(self.strong):
            if len(word) > 5 and word.isalpha():
                for i in range(1, len(word)):
                    form = word[:i] + word[i + 1 :]
                    if form not in self.words and form not in ordinary:
                        self.short.setdefault(form, word)
        # ordinary words that one letter less would turn into a listed one
        self.ordinary = frozenset(w for w in ordinary if any(w[:i] + w[i + 1 :] in self.strong for i in range(1, len(w))))
        self.cache: dict[str, int] = {}

    def plain(self, token: str) -> str:
        """The word behind a token, in lower case, out of disguise where it is one."""
        t = unicodedata.normalize("NFKC", token).casefold()
        if not t.isascii():
            t = "".join(c for c in t if c not in _INVISIBLE)
            if t not in self.words:
                t = t.translate(_LOOKALIKES)
        if t in self.words:
            return t
        bare = t.strip("'’`-_*+~=&%#^")
        bare = bare[:-2] if bare.endswith(("'s", "’s")) else bare.replace("’", "'")
        if bare in self.words:
            return bare
        if len(t) > self.longest:  # a letter drawn out that far is as good as one drawn out to three
            t, bare = re.sub(r"(.)\1{3,}", r"\1\1\1", t), re.sub(r"(.)\1{3,}", r"\1\1\1", bare)
        if not any(c.isalpha() or c in "@+*" for c in t):
            return bare
        if re.fullmatch(r"[^\W\d_](?:[ ._-][^\W\d_])+", bare):
            joined = re.sub(r"[ ._-]", "", bare)
            if joined in self.words:
                return joined
            if joined[0] in "aiu" and joined[1:] in self.words:  # an article or pronoun before it
                return joined[1:]
            for i in range(2, len(joined) - 1) if len(joined) <= 2 * self.longest + 1 else ():  # no two words are longer
                for start in (0, 1) if joined[0] in "aiu" else (0,):
                    left, right = joined[start:i], joined[i:]
                    if left in self.words and right in self.words and (left in self.strong or right in self.strong):
                        return right if right in self.strong else left  # the noun, where both offend
            return joined
        if any(c in "0134578@$+!|" for c in t):
            for table in (_LEET, _LEET_L):
                for form in (t.translate(table), bare.translate(table)):
                    if form in self.strong or form in self.words and len(form) > 1:
                        return form
        if "*" in t and t[0].isalpha():
            fitting = self.by_length.get(len(t), ())
            pattern = re.compile(re.escape(t).replace(r"\*", ".")) if fitting else None
            for word in fitting:
                if pattern.fullmatch(word):
                    return word
            for part in t.split("*"):  # the mask may stand for the space between two words
                if part in self.strong:
                    return part
        if re.search(r"(.)\1\1", bare):
            forms = (re.sub(r"(.)\1{2,}", r"\1", bare), re.sub(r"(.)\1{2,}", r"\1\1", bare))
            for words in (self.strong, self.words):
                for form in forms:
                    if form in words:
                        return form
            short = self.squeezed.get(re.sub(r"(.)\1+", r"\1", bare))
            if short:
                return short
        if bare.isalpha() and 3 < len(bare) <= self.longest and bare not in _NOT_SWAPPED:
            for i in range(len(bare) - 1):
                swapped = bare[:i] + bare[i + 1] + bare[i] + bare[i + 2 :]
                if swapped in self.strong:
                    return swapped
        if bare in self.unaccented:
            return self.unaccented[bare]
        if bare.isalpha() and 5 <= len(bare) <= self.longest + 1:
            if bare in self.short:
                return self.short[bare]
            if len(bare) > 5 and bare not in self.ordinary:
                for i in range(1, len(bare)):
                    less = bare[:i] + bare[i + 1 :]
                    if less in self.strong:
                        return less
        return bare

    def number(self, token: str) -> int:
        first = token[0]
        if token == _RECORD:
            return _MARK
        if first in ".!?…\n":
            return _END
        if not any(c.isalnum() or c in "@+*$" for c in token):
            return -1
        plain = self.plain(token)
        found = self.words.get(plain)
        if found is None and len(plain) > 5:
            found = next((n for ending, n in self.endings if ending.fullmatch(plain)), None)
        return found or 0

    def tokens(self, texts: Sequence[str | None]) -> list[str]:
        whole = f" {_RECORD}\n".join((t or "").replace(_RECORD, " ") for t in texts) + f" {_RECORD}"
        for c in _INVISIBLE:
            if c in whole:
                whole = whole.replace(c, "")
        if "&" in whole:
            for entity, sign in _ENTITIES:
                whole = whole.replace(entity, sign)
        return _TOKEN.findall(whole)

    def read(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """ids, classes, sentence of each word, record of each sentence (sentence and record ends left out)."""
        tokens = self.tokens(texts)
        cache = self.cache
        if len(cache) > MOST_WORDS:
            cache.clear()
        get, ids = cache.get, []
        for token in tokens:
            n = get(token)
            if n is None:
                n = cache[token] = self.number(token)
            ids.append(n)
        return self.arrange(np.array(ids, np.int32))

    def arrange(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        ids = ids[ids >= 0]
        kinds = self.of[ids]
        pairs = ids[:-1].astype(np.int64) * self.size + ids[1:]
        place = np.minimum(np.searchsorted(self.starts, pairs), len(self.starts) - 1)
        for at in np.flatnonzero(self.starts[place] == pairs).tolist():
            for phrase, k in self.phrases[int(ids[at])]:
                n = len(phrase)
                if at + n <= len(ids) and tuple(ids[at : at + n].tolist()) == phrase:
                    kinds[at : at + n] = k
        ends = (ids == _END) | (ids == _MARK)
        sentence = np.cumsum(ends) - ends
        record_of_end = np.cumsum(ids == _MARK) - (ids == _MARK)
        record = record_of_end[ends]  # of each sentence, by its end
        words = ~ends
        return ids[words], kinds[words], sentence[words], record


def _log_add(a: np.ndarray | float, b: np.ndarray | float) -> np.ndarray:
    return np.logaddexp(a, b)


def _chains(u: np.ndarray, mask: np.ndarray, step: Sequence[float]) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward log odds of the second state for padded rows of node log odds ``u``.

    ``step``: log weights of staying out, entering, leaving and staying in, the first of them 0.
    """
    enter, leave, stay = step
    n, t = u.shape
    ahead, back = np.empty_like(u), np.zeros_like(u)
    ahead[:, 0] = u[:, 0]
    for i in range(1, t):
        p = ahead[:, i - 1]
        ahead[:, i] = u[:, i] + _log_add(enter, p + stay) - _log_add(0.0, p + leave)
    for i in range(t - 2, -1, -1):
        v = u[:, i + 1] + back[:, i + 1]
        back[:, i] = np.where(mask[:, i + 1], _log_add(leave, stay + v) - _log_add(0.0, enter + v), 0.0)
    return ahead, back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))


class Tagger:
    """The random field: weights of a word, its class, its neighbours' classes, and the classes and words in its sentence."""

    def __init__(self, reader: Reader) -> None:
        self.reader = reader
        c = len(reader.classes)
        self.bias = np.zeros(1)
        self.word, self.around = np.zeros(len(reader.of)), np.zeros(len(reader.of))
        self.own, self.before, self.after = np.zeros(c), np.zeros(c), np.zeros(c)
        self.pair = np.zeros((c, c + 1))
        self.offensive = np.isin(np.arange(c), [reader.classes.index(k) for k in _OFFENSIVE])
        self.steps = np.array([-1.0, -1.0, 1.0])
        self.threshold = 0.5

    def _sentences(self, kinds: np.ndarray, sentence: np.ndarray, count: int) -> np.ndarray:
        present = np.zeros((count, len(self.reader.classes) + 1))
        present[sentence, kinds] = 1.0
        present[:, 0] = 1.0  # class 0 stands for the sentence as such
        present[:, -1] = present[:, :-1][:, self.offensive].any(1)
        return present

    def nodes(self, ids: np.ndarray, kinds: np.ndarray, sentence: np.ndarray, count: int, present: np.ndarray, group: np.ndarray) -> np.ndarray:
        """Log odds of every word; ``group``: its row in ``present``."""
        same = sentence[1:] == sentence[:-1]
        before = np.concatenate([[0], np.where(same, kinds[:-1], 0)]) if len(ids) else kinds
        after = np.concatenate([np.where(same, kinds[1:], 0), [0]]) if len(ids) else kinds
        context = np.einsum("sc,kc->sk", present, self.pair)  # not a matrix product: its threads would spin
        around = np.bincount(sentence, self.around[ids], count)
        return self.bias[0] + self.word[ids] + self.own[kinds] + self.before[before] + self.after[after] + context[group, kinds] + around[sentence]

    def marginals(self, ids: np.ndarray, kinds: np.ndarray, sentence: np.ndarray, count: int) -> np.ndarray:
        """P(offending) of every word; sentences are chains of their own."""
        u = self.nodes(ids, kinds, sentence, count, self._sentences(kinds, sentence, count), sentence)
        out = np.empty(len(ids))
        lengths = np.bincount(sentence, minlength=count)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        at = 0
        while at < len(order):
            # rows of similar length share a padded block
            longest = lengths[order[at]]
            to = min(len(order), at + max(1, CHUNK // max(1, int(longest))))
            while to > at + 1 and lengths[order[to - 1]] > 2 * longest + 8:
                to = at + (to - at) // 2
            rows = order[at:to]
            t = int(lengths[rows].max())
            place = starts[rows][:, None] + np.arange(t)
            mask = np.arange(t) < lengths[rows][:, None]
            place = np.where(mask, place, 0)
            ahead, back = _chains(u[place], mask, self.steps)
            out[place[mask]] = (ahead + back)[mask]
            at = to
        return _sigmoid(out)

    def fit(self, ids: np.ndarray, kinds: np.ndarray, sentence: np.ndarray, gold: np.ndarray, weight: np.ndarray, around: bool = False, rounds: int = 120, rate: float = 0.08, decay: float = 0.004) -> None:
        """Penalised likelihood by Adam; gradients from forward-backward marginals. ``weight``: how often each sentence counts.

        ``around``: also weigh the words anywhere in the sentence.
        """
        count = len(weight)
        lengths = np.bincount(sentence, minlength=count)
        starts = np.concatenate([[0], np.cumsum(lengths)[:-1]])
        order = np.argsort(lengths, kind="stable")
        order = order[lengths[order] > 0]
        y = gold.astype(float)
        blocks, gold_steps = [], np.zeros(3)
        for rows in np.array_split(order, max(1, min(8, len(order)))):  # sentences of similar length are padded together
            mask = np.arange(int(lengths[rows].max())) < lengths[rows][:, None]
            place = np.where(mask, starts[rows][:, None] + np.arange(mask.shape[1]), 0)
            yp, both = np.where(mask, y[place], 0.0), mask[:, 1:] * weight[rows][:, None]
            gold_steps += [((1 - yp[:, :-1]) * yp[:, 1:] * both).sum(), (yp[:, :-1] * (1 - yp[:, 1:]) * both).sum(), (yp[:, :-1] * yp[:, 1:] * both).sum()]
            blocks.append((mask, place, both))
        present, group = np.unique(self._sentences(kinds, sentence, count), axis=0, return_inverse=True)  # many sentences hold the same classes
        group = group.reshape(-1)[sentence]
        same = sentence[1:] == sentence[:-1]
        before = np.concatenate([[0], np.where(same, kinds[:-1], 0)])
        after = np.concatenate([np.where(same, kinds[1:], 0), [0]])
        n, of_word = float(weight[order].sum()), weight[sentence]
        names = ("bias", "word", "own", "before", "after", "pair", "steps", *(["around"] if around else []))
        first = {k: np.zeros_like(getattr(self, k)) for k in names}
        second = {k: np.zeros_like(getattr(self, k)) for k in names}
        c = len(self.reader.classes)
        for step in range(1, rounds + 1):
            u_of = self.nodes(ids, kinds, sentence, count, present, group)
            enter, leave, stay = self.steps
            d, steps = np.zeros(len(ids)), np.zeros(3)
            for mask, place, both in blocks:
                u = u_of[place]
                ahead, back = _chains(u, mask, self.steps)
                d[place[mask]] = y[place[mask]] - _sigmoid(ahead + back)[mask]
                v = u[:, 1:] + back[:, 1:]
                w = np.stack([np.zeros_like(v), enter + v, ahead[:, :-1] + leave, ahead[:, :-1] + stay + v])
                w = np.exp(w - w.max(0))
                steps += (both * w / w.sum(0)).sum((1, 2))[1:]
            d *= of_word
            by_class = np.bincount(group * c + kinds, d, len(present) * c).reshape(len(present), c)
            pair = np.einsum("sk,sc->kc", by_class, present)
            grads = {
                "bias": np.array([d.sum()]),
                "word": np.bincount(ids, d, len(self.word)),
                "own": np.bincount(kinds, d, c),
                "before": np.bincount(before, d, c),
                "after": np.bincount(after, d, c),
                "pair": pair,
                "steps": gold_steps - steps,
            }
            if around:
                grads["around"] = np.bincount(ids, np.bincount(sentence, d, count)[sentence], len(self.around))
            for k, g in grads.items():
                value = getattr(self, k)
                g = g / n - decay * (1.0 if k == "word" else 0.0 if k == "bias" else 1.0) * value
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.99 * second[k] + 0.01 * g * g
                value += rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)

    def scores(self, texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Score of every text: the greatest marginal of its words; words' marginals and places come along."""
        ids, kinds, sentence, record = self.reader.read(texts)
        out = np.zeros(len(texts))
        p = np.zeros(len(ids))
        if len(ids):
            used, where = np.unique(sentence, return_inverse=True)
            p = self.marginals(ids, kinds, where, len(used))
        np.maximum.at(out, record[sentence], p)
        return out, p, (ids, kinds, sentence, record)


def _marked(reader: Reader, lines: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids, classes, sentence and mark of the words of ``lines``; [[ ]] encloses marked words."""
    marks: list[bool] = []
    flat: list[int] = []
    inside = False
    for token in reader.tokens([line.replace("[[", " \ue001 ").replace("]]", " \ue002 ") for line in lines]):
        if token in ("\ue001", "\ue002"):
            inside = token == "\ue001"
            continue
        n = reader.number(token)
        if n >= 0:
            flat.append(n)
            marks.append(inside and n not in (_END, _MARK))
    all_ids = np.array(flat, np.int32)
    ids, kinds, sentence, _ = reader.arrange(all_ids)
    return ids, kinds, sentence, np.array(marks, bool)[(all_ids != _END) & (all_ids != _MARK)]


_Part = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _joined(*parts: tuple[_Part, float]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The sentences of all parts, each a part's weight; equal ones are put together and their weights added."""
    place: dict[tuple[bytes, ...], int] = {}
    weight: list[float] = []
    some: list[tuple[np.ndarray, ...]] = []
    for (ids, kinds, sentence, gold), w in parts:
        for at in _pieces(sentence):
            one = ids[at], kinds[at], gold[at]
            k = place.setdefault(tuple(x.tobytes() for x in one), len(some))
            if k == len(some):
                some.append(one)
                weight.append(0.0)
            weight[k] += w
    ids, kinds, gold = (np.concatenate(x) for x in zip(*some))
    return ids, kinds, np.repeat(np.arange(len(some)), [len(x[0]) for x in some]), gold, np.array(weight)


def _pieces(sentence: np.ndarray) -> list[slice]:
    """Where the words of each sentence stand; ``sentence`` doesn't fall."""
    cuts = [0, *(np.flatnonzero(np.diff(sentence)) + 1).tolist(), len(sentence)]
    return [slice(i, j) for i, j in zip(cuts, cuts[1:]) if i < j]


def _score_made(tagger: Tagger, patterns: Patterns) -> tuple[np.ndarray, np.ndarray]:
    fresh = patterns.sentences(2)
    return tagger.scores([x.replace("[[", "").replace("]]", "") for x in fresh])[0], np.array(["[[" in x for x in fresh])


def train(labels: Sequence[tuple[str | None, int | None]], ordinary: Sequence[str | None] = (), background: Sequence[str | None] = ()) -> Tagger:
    """Fit the field on made sentences and on labelled texts, and set the threshold.

    The made sentences (``Patterns``) have their offending words marked. A text labelled 1 says not where it offends: a
    field fitted on the made sentences alone points out its worst sentence, and the words of offensive classes there, from the first to
    the last, are marked; its other sentences aren't used, and neither is a text whose worst sentence has no such word (a wrong
    label, or a form that no class knows). The words of a text labelled 0 are clean, unless that field is sure of the contrary.
    ``ordinary``: texts of another label table, not about abuse; all their words are clean.
    ``background``: unlabelled texts of the table to be scored, read as if labelled 0: most are, so what recurs there is
    ordinary, while the few abusive ones hardly count beside the made sentences. Only against such talk all words of a sentence are weighed.
    """
    rows = [(t, int(y)) for t, y in labels if t and y is not None] + [(t, 0) for t in ordinary if t]
    labelled, extra = len(rows), sum(1 for t in ordinary if t)
    rows += [(t, 0) for t in background if t]
    made = Patterns()
    plain = Reader()
    seen: Counter = Counter()
    for text, _ in rows:
        seen.update({plain.plain(w) for w in plain.tokens([text]) if w[0] not in ".!?…\n" and w != _RECORD})
    reader = Reader(sorted({w for w, n in seen.items() if n >= 3 and w.isalpha()} | made.words()))
    part = _marked(reader, made.sentences())
    tagger = Tagger(reader)
    tagger.fit(*_joined((part, 1.0)))
    if not rows:
        return tagger
    scores, p, (ids, kinds, sentence, record) = tagger.scores([t for t, _ in rows])
    truth = np.array([y for _, y in rows], bool)
    worst = np.zeros(len(record))
    np.maximum.at(worst, sentence, p)
    use, gold = np.zeros(len(ids), bool), np.zeros(len(ids), bool)
    for at in _pieces(sentence):
        s = sentence[at.start]
        r = record[s]
        if not truth[r]:
            use[at] = labelled - extra <= r < labelled or worst[s] < 0.9
            continue
        hits = at.start + np.flatnonzero(tagger.offensive[kinds[at]])
        if len(hits) and worst[s] >= scores[r] - 1e-12:
            gold[hits[0] : hits[-1] + 1] = True
            use[at] = True
    of = record[sentence]

    def some(chosen: np.ndarray) -> _Part:
        return ids[chosen], kinds[chosen], sentence[chosen], gold[chosen]

    parts = [(some(use & (of < labelled)), 1.0), (some((of >= labelled - extra) & (of < labelled)), float(ORDINARY))]
    talk = some(use & (of >= labelled))
    against = len(talk[0]) > 0
    if against:
        parts.append((talk, BACKGROUND_WEIGHT * len(_pieces(part[2])) / len(_pieces(talk[2]))))
    tagger.fit(*_joined((part, 1.0), *parts), around=against)
    # thresholds from the labelled texts and from made sentences of another seed
    sets = [(tagger.scores([t for t, _ in rows[:labelled]])[0], truth[:labelled])]
    if not against:
        sets.append(_score_made(tagger, Patterns(seed=12)))
    else:  # of patterns that the field hasn't seen, half of them at a time, as abuse comes in other words than the known ones
        halves = []
        for k in range(2):
            other = Tagger(reader)
            other.fit(*_joined((_marked(reader, Patterns(half=k).sentences()), 1.0), *parts), around=True)
            halves.append(_score_made(other, Patterns(seed=12, half=1 - k)))
        sets.append(tuple(np.concatenate(x) for x in zip(*halves)))
    grid = np.linspace(0.1, 0.8, 71) if against else np.linspace(0.2, 0.8, 61)
    # the made sentences are many more; both sets count the same
    quality = np.mean([[2 * (y & (s >= g)).sum() / max(1, y.sum() + (s >= g).sum()) for g in grid] for s, y in sets], 0)
    # the lowest that is as good but for one in a hundred: what is flagged is meant for review
    tagger.threshold = float(grid[quality >= quality.max() - 0.01][0])
    return tagger


def read_labels(labels: DataFrame, text: str = "text", label: str = "toxic") -> list[tuple[str, int]]:
    rows = labels.select(text, label).limit(MOST_LABELS + 1).collect()
    if len(rows) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labelled texts; give a sample")
    return [(r[0], r[1]) for r in rows]


@lru_cache(maxsize=2)
def _loaded(model: bytes) -> Tagger:
    return pickle.loads(model)


def _decoded(text: str) -> tuple[str, list[int], list[int]]:
    """The text as it is read, without invisible characters and entities, and where each of its signs begins and ends."""
    starts = [i for i, c in enumerate(text) if c not in _INVISIBLE]
    ends = [i + 1 for i in starts]
    clean = "".join(text[i] for i in starts).replace(_RECORD, " ")
    for entity, sign in _ENTITIES:
        at = clean.find(entity)
        if at < 0:
            continue
        s, e, last = [], [], 0
        while at >= 0:
            stop = at + len(entity)
            s += starts[last : at + 1]
            e += [*ends[last:at], ends[stop - 1]]
            last, at = stop, clean.find(entity, stop)
        starts, ends = s + starts[last:], e + ends[last:]
        clean = clean.replace(entity, sign)
    return clean, starts, ends


def locate(tagger: Tagger, text: str) -> list[dict[str, int]]:
    """Offsets (start, end) in ``text`` of the stretches whose words are above one half, or of the worst word."""
    _, p, _ = tagger.scores([text])
    clean, starts, ends = _decoded(text)
    hits = [m for m in _TOKEN.finditer(clean) if tagger.reader.number(m[0]) not in (-1, _END, _MARK)]
    assert len(hits) == len(p)
    bad = p >= min(0.5, float(p.max(initial=0.0)))
    out: list[dict[str, int]] = []
    last = -2
    for i in np.flatnonzero(bad).tolist():
        a, b = starts[hits[i].start()], ends[hits[i].end() - 1]
        if i == last + 1 and out:
            out[-1]["end"] = b
        else:
            out.append({"start": a, "end": b})
        last = i
    return out


def read_background(rows: DataFrame, most: int = BACKGROUND) -> list[str]:
    """Texts of the ``most`` records that come first by a hash of their id, for the fit; which rows are scored doesn't depend on it."""
    key = F.xxhash64("id")
    known = rows.where(F.col("id").isNotNull() & (F.length("text") <= BACKGROUND_LENGTH)).select(key.alias("key"), "text")
    share = 2 * most / max(1, rows.count())
    if share < 1:  # so that few rows are sorted, whatever the size of the table
        known = known.where(F.col("key") < int(-(2**63) + share * 2**64))
    return [r[1] for r in known.distinct().orderBy("key", "text").limit(most).collect()]


def score_table(records: DataFrame, text: str, labels: DataFrame, spans: bool = False, ordinary: DataFrame | None = None, background: Sequence[str] = ()) -> DataFrame:
    """``records`` without ``text``, with ``score`` (0 to 1), ``flagged`` and, if asked for, ``spans`` of flagged texts.

    One pass without a shuffle; the model (under 3 MB, fitted on at most ``MOST_LABELS`` labelled texts and as many of ``ordinary``,
    labelled texts in a column ``text`` that are not about abuse, and on ``background``) travels with the tasks. Whole texts are read. Null, empty and blank texts score 0. Other columns pass through, null or not;
    a column that has one of the new names is replaced.
    """
    model = pickle.dumps(train(read_labels(labels), [] if ordinary is None else [t for t, _ in read_labels(ordinary, "text", "text")], background))
    others = [c for c in records.columns if c not in (text, "score", "flagged", "spans")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tagger = _loaded(model)
        for batch in batches:
            texts = batch.column(0).to_pylist()
            scores = tagger.scores(texts)[0]
            flagged = scores >= tagger.threshold
            columns = [*batch.columns[1:], pa.array(scores), pa.array(flagged)]
            if spans:
                found = [locate(tagger, t) if f and t else [] for t, f in zip(texts, flagged.tolist())]
                columns.append(pa.array(found, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))))
            yield pa.RecordBatch.from_arrays(columns, names=[*others, "score", "flagged", *(["spans"] if spans else [])])

    shape = [f"`{c}` {records.schema[c].dataType.simpleString()}" for c in others]
    shape += ["score double", "flagged boolean", *(["spans array<struct<start:int,end:int>>"] if spans else [])]
    return records.select(text, *others).mapInArrow(run, ", ".join(shape))


def scored_records(rows: DataFrame, labels: DataFrame, keep: Sequence[str] = (), spans: bool = False, ordinary: DataFrame | None = None) -> DataFrame:
    """Scores of records: every delivered row is scored where it lies, then the newest row of an id counts.

    So only ids, scores and the columns to keep are shuffled, never texts.
    """
    scored = score_table(spread(rows.select("id", "ingested_at", "text", *keep)), "text", labels, spans, ordinary, read_background(rows))
    return latest_records(scored, "id", "ingested_at", ["score", "flagged", *(["spans"] if spans else []), *keep])


def rates(scored: DataFrame, by: str) -> DataFrame:
    """(by, records, flagged, rate): null is a group of its own."""
    return scored.groupBy(by).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if("flagged").alias("flagged"),
    ).withColumn("rate", F.col("flagged") / F.col("records"))
