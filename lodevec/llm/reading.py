"""Reading level of English prose: ordinal regression on sentences, decided by the document's sentences together.

Which texts are English is told by a model of character trigrams, fitted to texts whose given language agrees with their words.  Sentences are described
by lexical diversity, word rarity in the whole corpus, connectives, clause depth (commas and subordinators), lengths, and by how their words are spread over the
graded texts.  A regularised proportional-odds model, fitted to graded texts, gives each sentence a share in every level; a second one of
the same kind calibrates the document's shares to the grades of whole documents.  Both models, their counts and thresholds come from all documents and all
grades: they are sums over stored batches, whatever the number of texts.  A batch of texts is taken apart once; all numbers are then taken
over its different words and summed by sentence.
"""

from __future__ import annotations

import math
import pickle
import re
import zlib
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodevec.session import cut_lineage

LEVELS = 4
CHUNK = 16_000_000  # characters
# Words are counted in so many buckets, all of them, so the table has one size whatever the corpus.
WORD_BUCKETS = 1 << 20
GRAM_BUCKETS = 1 << 15
ENGLISH_SHARE = 0.1
FAR_TOPIC = 2.0

# Fixed word lists: frequent English function words, connectives and subordinators.
ENGLISH = frozenset(
    "the is are was were be been it this that these those and or but not of to in on at by for from with if then when while which who "
    "what how you your we they he she can may might should would will must has have had did does because than there their its into each "
    "every some any all both between where whether though although thus let such our us them".split()
)
SIMPLE_LINKS = frozenset("and but so or if then when because".split())
HARD_LINKS = frozenset("although though whereas notwithstanding thus therefore hence unless while whenever provided since however moreover consequently nevertheless albeit".split())
SUBORDINATORS = frozenset("that which who whom whose where whether what how as than such".split())

CODE = re.compile(r"```.*?(?:```|\Z)", re.S)
TIMED_LINE = re.compile(r"^[\s\[(]*\d{4}-\d\d-\d\d[ T]\d\d:\d\d|^\s*\[?\d\d:\d\d:\d\d")
PROMPT_LINE = re.compile(r"^\s*(?:\$ |>>> |PS>|#!)")
MACHINE_LINE = re.compile(r"\s--?\w[\w-]*(?:[= ]|$)|\w=\S.*?\w=\S")
TABLE_LINE = re.compile(r"^\s*\|")
HEADING = re.compile(r"^\s*#+\s")
MARKER = re.compile(r"^\s*(?:[-*+•]|\d+[.)]|[QA]:)\s+")
ENDS = re.compile(r"(?<=[.!?;])\s+|\x00")
WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
ASCII_WORD = re.compile(r"[a-z]+(?:'[a-z]+)?")  # the same for lower-case ASCII, in half the time


def machine_line(line: str) -> bool:
    """Whether a line is no prose: a log line with its time, a prompt, a table row, or options and settings with hardly a function word."""
    if TIMED_LINE.search(line) or PROMPT_LINE.match(line) or TABLE_LINE.match(line):
        return True
    if ("-" in line or "=" in line) and MACHINE_LINE.search(line):
        words = WORD.findall(line.lower())
        return 6 * sum(w in ENGLISH for w in words) <= len(words)
    return False


def prose(text: str | None) -> str:
    """The prose of a text: code, logs, commands, table rows and headings left out; list items and paragraphs end in NUL."""
    if not text:
        return ""
    out: list[str] = []
    for line in CODE.sub("\n\n", text).replace("\r", "\n").split("\n"):
        first = line.lstrip()[:1]
        if first.isalpha() and first not in "PQA" and "-" not in line and "=" not in line:  # none of the patterns can match
            out.append(line)
            continue
        if not first or HEADING.match(line) or machine_line(line):
            out.append("\x00")
            continue
        item = MARKER.sub("", line)
        if item != line:
            out.append("\x00")
        out.append(item)
    return " ".join(out)


def sentences(text: str | None) -> list[tuple[str, list[str]]]:
    """(sentence, its lower-case words) of the prose; those of a single word are left out."""
    out = []
    for part in ENDS.split(prose(text)):
        low = part.lower()
        words = (ASCII_WORD if low.isascii() else WORD).findall(low)
        if len(words) > 1:
            out.append((part, words))
    return out


class Batch:
    """Texts taken apart: the different words, the words of every sentence by number, and the sentences of every text."""

    def __init__(self, texts):
        number: dict[str, int] = defaultdict()
        number.default_factory = number.__len__
        flat, self.commas, size, doc = [], [], [], []
        for d, text in enumerate(texts):
            for part, words in sentences(text):
                flat += map(number.__getitem__, words)
                size.append(len(words))
                doc.append(d)
                self.commas.append(part.count(",") + 2 * part.count(";") + 2 * part.count(":"))
        self.words = list(number)
        self.flat, self.size, self.doc = np.array(flat, np.int64), np.array(size, np.int64), np.array(doc, np.int64)
        self.commas, self.n_docs = np.array(self.commas, float), len(texts)
        self.sentence = np.repeat(np.arange(len(self.size)), self.size)

    def pairs(self, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(group, word): the different words of each group, of which ``group`` has that of every word."""
        both = np.sort(group * max(len(self.words), 1) + self.flat)  # np.unique takes ten times as long
        return np.divmod(both[np.diff(both, prepend=-1) != 0], max(len(self.words), 1))

    def pack(self) -> bytes:
        small = np.uint16 if len(self.words) <= 1 << 16 else np.uint32
        return pickle.dumps((self.words, self.flat.astype(small), self.size.astype(np.uint32), self.doc.astype(np.uint32), self.commas.astype(np.uint32), self.n_docs))

    @classmethod
    def unpack(cls, data: bytes) -> Batch:
        self = cls([])
        self.words, *rest, self.commas, self.n_docs = pickle.loads(data)
        self.flat, self.size, self.doc = (a.astype(np.int64) for a in rest)
        self.commas = self.commas.astype(float)
        self.sentence = np.repeat(np.arange(len(self.size)), self.size)
        return self

    def only(self, docs: np.ndarray) -> None:
        """Keep the sentences of the documents whose flag is set."""
        self.__dict__.pop("doc_of", None)
        self.__dict__.pop("n_words", None)
        keep = docs[self.doc]
        self.flat, self.size, self.doc, self.commas = self.flat[keep[self.sentence]], self.size[keep], self.doc[keep], self.commas[keep]
        self.sentence = np.repeat(np.arange(len(self.size)), self.size)

    @cached_property
    def doc_of(self) -> np.ndarray:
        """The document of each word."""
        return self.doc[self.sentence]

    @cached_property
    def n_words(self) -> np.ndarray:
        return self.by_doc(np.ones(len(self.words)))

    @cached_property
    def trigrams(self) -> tuple[np.ndarray, np.ndarray]:
        return LanguageModel.trigrams(self.words)

    def by_doc(self, of_word: np.ndarray) -> np.ndarray:
        """Sum over the words of each document."""
        return np.bincount(self.doc_of, weights=of_word[self.flat], minlength=self.n_docs)

    def by_sentence(self, of_word: np.ndarray) -> np.ndarray:
        return np.bincount(self.sentence, weights=of_word[self.flat], minlength=len(self.size))


@dataclass
class LanguageModel:
    """Character trigrams of each language, English first; below ``least`` (mean log probability of a trigram) no text is English."""

    grams: np.ndarray
    least: float

    @staticmethod
    def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(word number, bucket) of all trigrams of the words with a blank at each end."""
        at, out = [], []
        for i, w in enumerate(words):
            w = f" {w} "
            grams = [zlib.crc32(w[j : j + 3].encode("utf-8", "replace")) % GRAM_BUCKETS for j in range(len(w) - 2)]
            out += grams
            at += [i] * len(grams)
        return np.array(at, np.int64), np.array(out, np.int64)

    @classmethod
    def scores(cls, grams: np.ndarray, batch: Batch) -> np.ndarray:
        """(language, document): mean log probability of a trigram; -inf without a word."""
        at, bucket = batch.trigrams
        n = batch.by_doc(np.bincount(at, minlength=len(batch.words)).astype(float))
        out = [batch.by_doc(np.bincount(at, weights=g[bucket], minlength=len(batch.words))) for g in grams]
        return np.where(n > 0, np.array(out) / np.maximum(n, 1), -np.inf)

    @classmethod
    def kinds(cls, batch: Batch, langs: list[str | None]) -> dict[str, np.ndarray]:
        """Kind of each document by its label, empty where that does not agree with the words, and by its words alone."""
        n = batch.n_words
        share = batch.by_doc(np.array([w in ENGLISH for w in batch.words], float)) / np.maximum(n, 1)
        named = [re.split(r"[-_]", lang.strip().lower())[0] if lang and lang.strip() else None for lang in langs]
        label = np.array([a if a is not None and (a == "en") == (s >= ENGLISH_SHARE) else "" for a, s in zip(named, share)], object)
        return {"label": label, "words": np.where(share >= ENGLISH_SHARE, "en", "other").astype(object)}

    @classmethod
    def count(cls, batch: Batch, kind: np.ndarray) -> dict[str, np.ndarray]:
        """Times of each trigram in the documents of every kind but the empty one; those of less than five words count for nothing."""
        at, bucket = batch.trigrams
        enough = batch.n_words >= 5
        out = {}
        for k in set(kind) - {""}:
            times = np.bincount(batch.flat[((kind == k) & enough)[batch.doc_of]], minlength=len(batch.words)).astype(float)
            out[k] = np.bincount(bucket, weights=times[at], minlength=GRAM_BUCKETS)
        return out

    @classmethod
    def agreeing(cls, batch: Batch, kind: np.ndarray, names: list[str], grams: np.ndarray) -> np.ndarray:
        """The kinds, empty where a model of another language has the higher score, or with less than five words."""
        best = cls.scores(grams, batch).argmax(0) if batch.n_docs else ()
        enough = batch.n_words >= 5
        return np.array([k if e and names[b] == k else "" for k, b, e in zip(kind, best, enough)], object)

    @classmethod
    def fit(cls, texts: list[str], langs: list[str | None]) -> LanguageModel | None:
        """:meth:`fit_all` of texts and their given languages (``en``, ``en-GB``, ...)."""
        batch = Batch(texts)

        def limits(scored: Callable) -> tuple[float | None, float | None]:
            english, s = scored(batch, langs)
            return tuple(float(np.quantile(v, q)) if len(v) else None for v, q in ((s[english], 0.002), (s[~english], 0.998)))

        return cls.fit_all(lambda count: count(batch, langs), limits)

    @classmethod
    def fit_all(cls, summed: Callable, limits: Callable) -> LanguageModel | None:
        """A model from all batches of texts: ``summed`` adds up the trigram counts by name that a function gives of each batch and its languages, ``limits``
        has the 0.002 quantile of the English and the 0.998 quantile of the other ones of the scores that a function gives.

        A label counts where it agrees with the words: a tenth or more of an English text are English function words, of others less.  Labels
        that the first models contradict are then left out and the models are made again.  ``least`` lies midway between nearly all English texts and nearly all
        others under the English model.  Texts without any label are told apart by their function words; without English ones there is no model.
        """
        first = summed(lambda batch, langs: {f"{by} {k}": c for by, kind in cls.kinds(batch, langs).items() for k, c in cls.count(batch, kind).items()})
        by = "label" if "label en" in first else "words"
        counts = {k.removeprefix(f"{by} "): c for k, c in first.items() if k.startswith(f"{by} ") and c.any()}
        if "en" not in counts:
            return None
        names = ["en", *sorted(set(counts) - {"en"})]
        logs = lambda c: np.log((c + 0.05) / (c.sum() + 0.05 * GRAM_BUCKETS))
        before = np.array([logs(counts[k]) for k in names])
        counts = summed(lambda batch, langs: cls.count(batch, cls.agreeing(batch, cls.kinds(batch, langs)[by], names, before)))
        grams = np.array([logs(counts.get(k, np.zeros(GRAM_BUCKETS))) for k in names])
        of_english = grams[:1]

        def scored(batch: Batch, langs: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
            kind = cls.agreeing(batch, cls.kinds(batch, langs)[by], names, before)
            return (kind == "en")[kind != ""], cls.scores(of_english, batch)[0][kind != ""]

        low, high = limits(scored)
        if low is None:
            return None
        least = (low + high) / 2 if high is not None else low - 2.0
        return cls(grams, float(min(least, low)))

    def english(self, batch: Batch) -> np.ndarray:
        """Whether each document has at least five words of prose, which are more likely English than any other language and likely enough English.

        With a fifth of English function words a text may be less likely by ``FAR_TOPIC``: its subject is then not that of the corpus.
        """
        s = self.scores(self.grams, batch)
        n = batch.n_words
        common = batch.by_doc(np.array([w in ENGLISH for w in batch.words], float)) >= 2 * ENGLISH_SHARE * n
        return (n >= 5) & (s[0] >= np.where(common, self.least - FAR_TOPIC, self.least)) & (s[0] >= s.max(0))

    def is_english(self, text: str | None) -> bool:
        return bool(self.english(Batch([text]))[0])


def ordinal_sums(theta: np.ndarray, x: np.ndarray, above: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Gradient and, below it, second derivatives of the proportional-odds loss, which add up over rows; ``above`` has the share above each threshold."""
    d, k = x.shape[1], above.shape[1]
    grad, hess = np.zeros(d + k), np.zeros((d + k, d + k))
    for j in range(k):
        p = 1 / (1 + np.exp(-np.clip(x @ theta[:d] - theta[d + j], -30, 30)))
        r, v = weight * (p - above[:, j]), weight * p * (1 - p) + 1e-9
        grad[:d] += x.T @ r
        grad[d + j] -= r.sum()
        hess[:d, :d] += (x * v[:, None]).T @ x
        hess[:d, d + j] -= x.T @ v
        hess[d + j, :d] -= x.T @ v
        hess[d + j, d + j] += v.sum()
    return np.concatenate([grad[None], hess])


def newton(sums: Callable, share: np.ndarray, d: int, penalty: float, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """(``d`` coefficients, thresholds) by Newton steps; ``sums`` has :func:`ordinal_sums` of all rows, ``share`` the mean share above each threshold."""
    k = len(share)
    cut = -np.log(np.clip(share, 1e-3, 1 - 1e-3) / (1 - np.clip(share, 1e-3, 1 - 1e-3)))
    theta = np.concatenate([np.zeros(d), cut])
    ridge = np.concatenate([np.full(d, penalty), np.full(k, 1e-3)])
    for _ in range(rounds):
        got = sums(theta)
        step = np.linalg.solve(got[1:] + np.diag(ridge), got[0] + ridge * np.concatenate([theta[:d], np.zeros(k)]))
        theta = theta - step
        if np.abs(step).max() < 1e-6:
            break
    return theta[:d], np.sort(theta[d:])


def shares_above(y: np.ndarray) -> np.ndarray:
    """Share above each threshold from shares in the levels."""
    return 1 - np.cumsum(y, axis=1)[:, :-1]


def fit_ordinal(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1.0, rounds: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Proportional-odds regression with an L2 penalty, by Newton steps: (coefficients, three thresholds).

    ``y`` has a row of shares in the levels for each row of ``x``.
    """
    above = shares_above(y)
    return newton(lambda theta: ordinal_sums(theta, x, above, weight), weight @ above / weight.sum(), x.shape[1], penalty, rounds)


def level_shares(x: np.ndarray, beta: np.ndarray, cut: np.ndarray) -> np.ndarray:
    above = 1 / (1 + np.exp(-np.clip((x @ beta)[:, None] - cut[None, :], -30, 30)))
    edges = np.concatenate([np.ones((len(x), 1)), above, np.zeros((len(x), 1))], axis=1)
    return edges[:, :-1] - edges[:, 1:]


@dataclass
class LevelModel:
    """All that scoring needs; its size is that of the buckets and of the different words of the graded texts."""

    language: LanguageModel | None
    rarity: np.ndarray
    number: dict[str, int]
    counts: np.ndarray
    total: np.ndarray
    mean: np.ndarray | None = None
    scale: np.ndarray | None = None
    beta: np.ndarray | None = None
    cut: np.ndarray | None = None
    doc_beta: np.ndarray | None = None
    doc_cut: np.ndarray | None = None
    use: slice = slice(None)

    def __post_init__(self) -> None:
        self.prior = self.total / self.total.sum()
        self.levels = np.arange(1, LEVELS + 1)

    def _words(self, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each word: log odds of the levels, mean level, and whether it was seen at all."""
        m = c.sum(1)
        p = (c + 1.2 * self.prior) / (m + 1.2)[:, None]
        known = m >= 0.5
        return np.where(known[:, None], np.log(p / self.prior), 0.0), np.where(known, p @ self.levels, 0.0), known

    def features(self, batch: Batch, own: np.ndarray | None = None) -> np.ndarray:
        """Numbers of each sentence; ``own`` are the shares of each document in the levels, to be taken out of the word counts while fitting."""
        words, n = batch.words, np.maximum(batch.size, 1).astype(float)
        flag = lambda held: np.array([w in held for w in words], float)
        length = np.array([len(w) for w in words], float)
        rare = self.rarity[[word_bucket(w) for w in words]] if words else np.zeros(0)
        number = np.array([self.number.get(w, -1) for w in words], np.int64)
        # the different words of each sentence
        sentence, word = batch.pairs(batch.sentence)
        kinds = np.bincount(sentence, minlength=len(n))
        seen = number[word] >= 0
        sentence, word = sentence[seen], number[word][seen]
        counts = self.counts[word] - (own[batch.doc[sentence]] if own is not None else 0.0)
        odds_, grades, known = self._words(counts)
        total = lambda w: np.bincount(sentence, weights=w, minlength=len(n))
        odds = np.stack([total(odds_[:, j]) for j in range(LEVELS)], axis=1)
        grades, known = total(grades), total(known.astype(float))
        e = np.log(self.prior) + odds
        e = np.exp(e - e.max(1, keepdims=True, initial=-np.inf))
        e /= e.sum(1, keepdims=True)
        root = np.sqrt(n)
        columns = [
            np.log(n),
            batch.by_sentence(length) / n,
            batch.by_sentence((length > 9).astype(float)) / n,
            kinds / n,
            batch.by_sentence(rare) / n,
            batch.by_sentence(flag(SIMPLE_LINKS)) / root,
            batch.by_sentence(flag(HARD_LINKS)) / root,
            np.log1p(batch.commas),
            batch.by_sentence(flag(SUBORDINATORS)) / root,
            np.where(known > 0, grades / np.maximum(known, 1e-9), float(self.prior @ self.levels)),
            e @ self.levels,
            *np.clip(np.diff(odds, axis=1) / 4, -3, 3).T,
        ]
        return np.stack(columns, axis=1)[:, self.use]

    def documents(self, batch: Batch, x: np.ndarray) -> np.ndarray:
        """Numbers of each document from those of its sentences: their shares in the levels, by sentences and by words, and which level has most."""
        p = level_shares((x - self.mean) / self.scale, self.beta, self.cut)
        d, n = batch.doc, batch.n_docs
        mean = lambda v, w: np.stack([np.bincount(d, weights=v[:, j] * w, minlength=n) for j in range(LEVELS)], 1) / np.maximum(np.bincount(d, weights=w, minlength=n), 1e-9)[:, None]
        one = np.ones(len(d))
        by_n, by_size = mean(p, one), mean(p, batch.size.astype(float))
        crisp = mean(np.eye(LEVELS)[p.argmax(1)], one)
        most = np.eye(LEVELS)[by_n.argmax(1)]
        return np.concatenate([by_n[:, 1:], by_size[:, 1:], crisp[:, 1:], np.cumsum(most[:, ::-1], axis=1)[:, ::-1][:, 1:], (by_n @ self.levels)[:, None], (by_size @ self.levels)[:, None]], axis=1)

    def score(self, texts) -> np.ndarray:
        """1 to 4 for each text, 0 for what is no English prose."""
        return self.score_batch(Batch(texts))

    def score_batch(self, batch: Batch) -> np.ndarray:
        english = self.language.english(batch)
        batch.only(english)
        out = np.zeros(batch.n_docs, np.int64)
        if english.any():
            shares = level_shares(self.documents(batch, self.features(batch))[english], self.doc_beta, self.doc_cut)
            out[english] = shares.argmax(1) + 1
        return out


def word_bucket(word: str) -> int:
    return zlib.crc32(word.encode("utf-8", "replace")) % WORD_BUCKETS


def word_rarity(documents: DataFrame, text: str = "text") -> np.ndarray:
    """For each bucket of words the negative log share of all documents that hold one; every word of the corpus is counted, and what
    words of one bucket add to each other's counts is all that is lost."""
    words = documents.where(F.col(text).isNotNull()).select(F.explode(F.array_distinct(F.split(F.lower(F.col(text)), r"[^\p{L}]+"))).alias("w"))
    rows = words.where("w <> ''").groupBy(F.pmod(F.crc32(F.encode("w", "utf-8")), F.lit(WORD_BUCKETS)).alias("b")).count().toPandas()
    n = max(documents.where(F.col(text).isNotNull()).count(), 1)
    out = np.full(WORD_BUCKETS, math.log(n) + 1 if n > 1 else 1.0, np.float32)
    out[rows["b"]] = -np.log(np.minimum(rows["count"], n) / n)
    return out


def take_apart(documents: DataFrame, key: str = "doc_id", text: str = "text", more: tuple[str, ...] = ("lang",)) -> DataFrame:
    """(key, each column of ``more``, batch): lists of the values of some documents, and their texts taken apart; stored, as several passes read it."""
    columns = [key, *more]
    schema = ", ".join(f"`{c}` array<{documents.schema[c].dataType.simpleString()}>" for c in columns) + ", batch binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).to_pylist()
            chunk = np.cumsum([len(t or "") for t in texts], dtype=np.int64) // CHUNK
            starts = np.flatnonzero(np.diff(chunk, prepend=-1)).tolist()
            for a, e in zip(starts, [*starts[1:], len(texts)]):
                lists = [pa.ListArray.from_arrays(pa.array([0, e - a], pa.int32()), c.slice(a, e - a)) for c in b.columns[1:]]
                yield pa.RecordBatch.from_arrays([*lists, pa.array([Batch(texts[a:e]).pack()], pa.binary())], [*columns, "batch"])

    return cut_lineage(documents.select(text, *columns).mapInArrow(run, schema))


def exact_quantile(values: DataFrame, q: float, most: int = 100_000) -> float | None:
    """numpy's quantile of the column ``v``, of all rows: they are counted in ever finer ranges, until ``most`` or fewer lie in that of the quantile."""
    n, low, high = values.agg(F.count("v"), F.min("v"), F.max("v")).first()
    if not n:
        return None
    at = q * (n - 1)
    first, before, held = int(at), 0, n
    while held > most and low < high:
        inside = values.where(F.col("v").between(low, high))
        number = F.floor((F.col("v") - F.lit(low)) / F.lit((high - low) / 1024))
        bins = inside.groupBy(number.alias("b")).agg(F.count("v").alias("n"), F.min("v").alias("low"), F.max("v").alias("high")).orderBy("low").collect()
        ends = before + np.cumsum([r["n"] for r in bins])
        i = int(np.searchsorted(ends, first, side="right"))
        low, high, held, before = bins[i]["low"], bins[i]["high"], bins[i]["n"], int(ends[i]) - bins[i]["n"]
        if first + 1 == ends[i] and i + 1 < len(bins):  # the next one is the first of the next range
            return float(np.quantile([high, bins[i + 1]["low"]], at - first))
    if low == high:
        pair = [low, low if first + 1 < before + held else values.where(F.col("v") > low).agg(F.min("v")).first()[0]]
        return float(low if pair[1] is None else np.quantile(pair, at - first))
    v = np.sort(values.where(F.col("v").between(low, high)).toPandas()["v"].to_numpy())
    if first + 1 < before + held:
        return float(np.quantile(v[first - before : first - before + 2], at - first))
    after = values.where(F.col("v") > high).agg(F.min("v")).first()[0]
    return float(v[-1] if after is None else np.quantile([v[-1], after], at - first))


def fit_language(documents: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", apart: DataFrame | None = None) -> LanguageModel | None:
    """A language model from all documents; without a column ``lang`` from their words alone.  ``apart`` is what :func:`take_apart` made of them, if it did."""
    if apart is None:
        given = (F.col(lang) if lang in documents.columns else F.lit(None)).cast("string")
        apart = take_apart(documents.select(key, text, given.alias("lang")), key, text)
    parts = apart.select("batch", "lang")

    def summed(count: Callable) -> dict[str, np.ndarray]:
        def table(held: dict[str, np.ndarray]) -> pa.RecordBatch:
            at = [np.r_[-1, np.flatnonzero(c)] for c in held.values()]  # -1: the name is there, with or without a count
            names = np.repeat(np.array(list(held), object), [len(a) for a in at])
            n = [np.r_[0, c[a[1:]]] for a, c in zip(at, held.values())]
            arrays = [pa.array(names, pa.string()), pa.array(np.concatenate([*at, np.zeros(0)]).astype(np.int32)), pa.array(np.concatenate([*n, np.zeros(0)]).astype(np.int64))]
            return pa.RecordBatch.from_arrays(arrays, ["name", "at", "n"])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held: dict[str, np.ndarray] = {}
            for b in batches:
                for data, langs in zip(b.column(0), b.column(1)):
                    for name, c in count(Batch.unpack(data.as_py()), langs.as_py()).items():
                        held[name] = held[name] + c if name in held else c
                    if len(held) > 256:
                        yield table(held)
                        held = {}
            yield table(held)

        rows = parts.mapInArrow(run, "name string, at int, n long").groupBy("name", "at").agg(F.sum("n").alias("n")).toPandas()
        out = {name: np.zeros(GRAM_BUCKETS) for name in rows["name"].unique()}
        for name, part in rows[rows["at"] >= 0].groupby("name"):
            out[name][part["at"]] = part["n"]
        return out

    def limits(scored: Callable) -> tuple[float | None, float | None]:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for data, langs in zip(b.column(0), b.column(1)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in scored(Batch.unpack(data.as_py()), langs.as_py())], ["english", "v"])

        scores = cut_lineage(parts.mapInArrow(run, "english boolean, v double"))
        return exact_quantile(scores.where("english"), 0.002), exact_quantile(scores.where("not english"), 0.998)

    return LanguageModel.fit_all(summed, limits)


def _total(parts: DataFrame, of: Callable) -> np.ndarray:
    """Sum of the arrays that ``of`` makes of the content of each row; every partition gives one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for data in b.column(0):
                v = of(*pickle.loads(data.as_py()))
                total = v if total is None else total + v
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(total)], pa.binary())], ["v"])

    return sum(pickle.loads(r["v"]) for r in parts.mapInArrow(run, "v binary").collect())


def fit_ordinal_parts(parts: DataFrame, d: int, penalty: float, mean: np.ndarray | float = 0.0, scale: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """:func:`fit_ordinal` of stored (x, y, weight, ...), the ``d`` columns of x less ``mean`` and divided by ``scale``."""
    weight, *share = _total(parts, lambda x, y, w, *_: np.append(w.sum(), w @ shares_above(y)))
    return newton(lambda theta: _total(parts, lambda x, y, w, *_: ordinal_sums(theta, (x - mean) / scale, shares_above(y), w)), np.array(share) / weight, d, penalty)


def fit_levels(
    documents: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", level: str = "reading_level", use: slice = slice(None), apart: DataFrame | None = None
) -> LevelModel | None:
    """A model from all graded texts.

    Grades outside 1 to 4 and nulls are left out; several grades of one document share its weight.  Word
    rarity covers all documents and all words.  Without English prose graded at two levels at least there is no model (None).  ``use`` limits the
    sentence numbers (the first nine are the text's own, the others come from grades of words), for comparisons; ``apart`` as in :func:`fit_language`.
    """
    names = [f"n{v}" for v in range(1, LEVELS + 1)]
    graded = labels.where(F.col(level).between(1, LEVELS)).groupBy(key).agg(*[F.sum((F.col(level) == v).cast("int")).alias(n) for v, n in enumerate(names, 1)])
    rows = take_apart(documents.select(key, text).join(graded, key), key, text, tuple(names)).select("batch", *names)
    language = fit_language(documents, key=key, text=text, apart=apart) if not rows.isEmpty() else None
    if language is None:
        return None
    sc = documents.sparkSession.sparkContext
    english_by = sc.broadcast(language)

    def english_parts(b: pa.RecordBatch) -> Iterator[tuple[Batch, np.ndarray, np.ndarray]]:
        for data, *grades in zip(*b.columns):
            batch = Batch.unpack(data.as_py())
            y = np.stack([g.values.to_numpy() for g in grades], axis=1).astype(float)
            # in steps of 2^-30, so that sums are the same in any order
            y = np.round(y / y.sum(1, keepdims=True) * 2**30) / 2**30
            english = english_by.value.english(batch)
            batch.only(english)
            if english.any():
                yield batch, y, english

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, y, english in english_parts(b):
                doc, word = batch.pairs(batch.doc_of)
                counts = np.stack([np.bincount(word, weights=y[doc, j], minlength=len(batch.words)) for j in range(LEVELS)], axis=1)
                used = np.flatnonzero(counts.any(1))
                # no word has a blank
                counts = np.concatenate([counts[used], y[english].sum(0)[None], np.bincount(y[english].argmax(1), minlength=LEVELS)[None]])
                yield pa.RecordBatch.from_arrays([pa.array([*[batch.words[i] for i in used], " total", " most"]), *[pa.array(c) for c in counts.T]], ["word", *names])

    counts = rows.mapInArrow(words, "word string, " + ", ".join(f"{n} double" for n in names)).groupBy("word").agg(*[F.sum(n).alias(n) for n in names])
    counts = counts.toPandas().set_index("word").sort_index()
    if not len(counts) or np.count_nonzero(counts.loc[" most"]) < 2:
        return None
    total = counts.loc[" total"].to_numpy() + 0.5
    counts = counts.drop([" total", " most"])
    model = LevelModel(language, word_rarity(documents, text), {w: i for i, w in enumerate(counts.index)}, counts.to_numpy(), total, use=use)
    shared = sc.broadcast(model)

    def sentence_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for batch, y, english in english_parts(b):
                x = shared.value.features(batch, own=y)
                weight = 1 / np.sqrt(np.bincount(batch.doc, minlength=len(y)))[batch.doc]
                part = x, y[batch.doc], weight, (np.cumsum(english) - 1)[batch.doc], batch.size, y[english]
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(part)], pa.binary())], ["part"])

    sentences_ = cut_lineage(rows.mapInArrow(sentence_numbers, "part binary"))
    n, *sums = _total(sentences_, lambda x, *_: np.append(len(x), x.sum(0)))
    mean = np.array(sums) / n
    model.mean, model.scale = mean, np.sqrt(_total(sentences_, lambda x, *_: ((x - mean) ** 2).sum(0)) / n) + 1e-9
    model.beta, model.cut = fit_ordinal_parts(sentences_, len(mean), 2.0, model.mean, model.scale)
    small = replace(model, language=None, rarity=np.zeros(0), number={}, counts=np.zeros((0, LEVELS)))

    def document_numbers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # with sentence scores that left the document itself out of the word counts
        for b in batches:
            for data in b.column(0):
                x, _, _, doc, size, y = pickle.loads(data.as_py())
                docs = small.documents(SimpleNamespace(doc=doc, size=size, n_docs=len(y)), x)
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((docs, y, np.ones(len(y))))], pa.binary())], ["part"])

    docs = cut_lineage(sentences_.mapInArrow(document_numbers, "part binary"))
    model.doc_beta, model.doc_cut = fit_ordinal_parts(docs, 4 * (LEVELS - 1) + 2, 1.0)
    return model


def reading_levels(documents: DataFrame, model: LevelModel | None, key: str = "doc_id", text: str = "text", apart: DataFrame | None = None) -> DataFrame:
    """(key, reading_level): a row for each document that is English prose; others (null, blank, other languages,
    only logs, commands or table rows) have none.  Documents are scored where they lie, once; or from ``apart``, what :func:`take_apart` made of
    them.  Without a model there are no rows."""
    kind = documents.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, reading_level long"
    if model is None:
        return documents.sparkSession.createDataFrame([], schema)
    shared, stored = documents.sparkSession.sparkContext.broadcast(model), apart is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            parts = ((k.values, Batch.unpack(data.as_py())) for k, data in zip(*b.columns)) if stored else [(b.column(0), Batch(b.column(1).to_pylist()))]
            for keys, batch in parts:
                levels = shared.value.score_batch(batch)
                rows = np.flatnonzero(levels)
                yield pa.RecordBatch.from_arrays([keys.take(pa.array(rows)), pa.array(levels[rows])], [key, "reading_level"])

    return (apart.select(key, "batch") if stored else documents.select(key, text)).mapInArrow(run, schema)
