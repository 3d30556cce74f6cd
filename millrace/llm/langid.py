"""Languages of documents and of their stretches of cues, by prediction by partial matching.

Every distinct word gets its exact code length under the frozen context trees of each language once per worker. A
line's code lengths are sums over its words; the least one names its language. Languages that fewer than
``ACTIVE_LINES`` different lines of a document speak for are no languages of that document unless a line is far from all
others. A cue has the languages of its lines; cues without dialogue do not count, and undecided cues follow their
neighbours. Stretches are the maximal runs of cues that have a language.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import subtitles
from .ppm import Model

#: Labelled sample lines used per language at most; a classifier needs no more.
SAMPLES = 5_000
#: Bits a line must differ by to speak for a language.
SURE_BITS = 8.0
#: Different lines that make a language one of the document.
ACTIVE_LINES = 3
#: Bits by which a line must prefer a language that is none of the document.
FOREIGN_BITS = 45.0
#: Bits of code length that change the odds of a line by a factor of e; fitted on held-out pieces of 1 to 5 words, where
#: stated confidence and share of right answers then agree (``tests/llm/test_langid.py``).
SOFTNESS = 4.0
#: Words kept between batches; the table starts anew beyond (results do not depend on it).
CACHE_WORDS = 300_000

_TOKEN = re.compile(r"\w+|\n")

# Codes and names of the languages, in the usual styles.
NAMES = {
    "da": "da dan danish dansk",
    "de": "de deu ger german deutsch",
    "en": "en eng english",
    "es": "es spa spanish español espanol castellano castilian",
    "fr": "fr fra fre french français francais",
    "it": "it ita italian italiano",
    "nl": "nl nld dut dutch nederlands flemish vlaams",
    "pl": "pl pol polish polski",
    "pt": "pt por portuguese português portugues",
    "ru": "ru rus russian русский",
    "sv": "sv swe swedish svenska",
    "tr": "tr tur turkish türkçe turkce",
}
# Russian letters in Latin script, as commonly written.
ROMAN = dict(zip("абвгдеёжзийклмнопрстуфхцчшщъыьэюя", "a b v g d e e zh z i y k l m n o p r s t u f kh ts ch sh shch  y  e yu ya".split(" ")))
# Letters that lose their mark only by another spelling.
PLAIN = str.maketrans({"ł": "l", "ø": "o", "ı": "i", "ß": "ss", "æ": "ae", "đ": "d"})


def fold(text: str) -> str:
    """Lower case without the dot that capitals leave behind."""
    text = text.lower()
    return text if text.isascii() else text.replace("̇", "")


def spellings(text: str) -> list[str]:
    """A sample as it may come: plain, without marks, from capitals, romanised, with bytes misread or lost."""
    low = fold(text)
    bare = "".join(c for c in unicodedata.normalize("NFKD", low.translate(PLAIN)) if not unicodedata.combining(c))
    found = [low, bare, fold(text.upper())]
    if not text.isascii():
        found.append(fold("".join(c if c.isascii() else "�" for c in text)))
        if any(c in ROMAN for c in low):
            found.append("".join(ROMAN.get(c, c) for c in low))
            for encoding in ("cp1251", "koi8-r", "cp866"):
                for wrong in ("cp1252", "latin-1"):
                    found.append(fold(text.encode(encoding, "replace").decode(wrong, "replace")))
        else:
            for encoding in ("cp1252", "cp1250", "cp1254"):
                for wrong in ("cp1251", "cp1250", "cp437"):
                    if encoding != wrong:
                        found.append(fold(text.encode(encoding, "replace").decode(wrong, "replace")))
    return found


def train(samples: DataFrame, lang: str = "lang", text: str = "text", key: str = "sample_id", per_language: int = SAMPLES) -> Model:
    """Frozen trees of the languages in ``samples``; at most ``per_language`` lines of each, the least keys first."""
    from pyspark.sql import Window

    first = F.row_number().over(Window.partitionBy(lang).orderBy(key))
    rows = samples.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(lang, text, first.alias("k")).where(F.col("k") <= per_language).collect()
    words: dict[str, list[bytes]] = {r[0]: [] for r in rows}
    for r in rows:
        for spelling in spellings(r[1]):
            words[r[0]] += [w.encode("utf-8", "replace") for w in re.findall(r"\w+", spelling)]
    return Model(sorted(words), words)


class Judge:
    """Finds the stretches of a batch of documents; keeps the code lengths of words it has seen."""

    def __init__(self, model: Model) -> None:
        self.model = model
        self._reset()

    def _reset(self) -> None:
        self.number: dict[str, int] = {"\n": 0}
        self.bits = np.zeros((1, len(self.model.classes)), np.float32)
        self.mix = np.zeros(1, np.uint64)

    def _numbers(self, words: list[str]) -> np.ndarray:
        if len(self.number) > CACHE_WORDS:
            self._reset()
        fresh = [w for w in dict.fromkeys(words) if w not in self.number]
        if fresh:
            first = len(self.number)
            self.number.update(zip(fresh, range(first, first + len(fresh))))
            self.bits = np.concatenate([self.bits, self.model.code_lengths([w.encode("utf-8", "replace") for w in fresh]).astype(np.float32)])
            self.mix = np.arange(len(self.number), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            self.mix = (self.mix ^ (self.mix >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        return np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))

    def stretches(self, texts: list[str | None]) -> tuple[np.ndarray, ...]:
        """(text number, class, first cue, last cue, cues with dialogue, confidence) of every stretch."""
        words: list[str] = []
        per_line_text: list[int] = []
        per_line_cue: list[int] = []
        for i, text in enumerate(texts):
            if not text or "-->" not in text:
                continue
            for j, cue in enumerate(subtitles.spoken(text)):
                if cue:
                    lines = cue.count("\n") + 1
                    words += _TOKEN.findall(fold(cue))
                    words.append("\n")
                    per_line_text += [i] * lines
                    per_line_cue += [j] * lines
        empty = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int32, np.int32, np.int32, np.float64))
        if not words:
            return empty
        ids = self._numbers(words)
        ends = np.flatnonzero(ids == 0)
        starts = np.concatenate([[0], ends[:-1] + 1])
        full = ends > starts  # lines with words
        text_of, cue_of = np.array(per_line_text)[full], np.array(per_line_cue)[full]
        if not len(text_of):
            return empty
        sums = np.add.reduceat(self.bits[ids], starts[full], axis=0)  # the closing line end adds nothing
        line_mark = np.add.reduceat(self.mix[ids], starts[full])
        return self._judge(text_of, cue_of, sums, line_mark, len(texts))

    def _judge(self, text_of: np.ndarray, cue_of: np.ndarray, bits: np.ndarray, mark: np.ndarray, texts: int) -> tuple[np.ndarray, ...]:
        n, k = bits.shape
        each = np.arange(n)
        order = np.partition(bits, 1, axis=1) if k > 1 else np.concatenate([bits, bits + 1e6], axis=1)
        best, sure = bits.argmin(axis=1), order[:, 1] - order[:, 0] >= SURE_BITS
        seen = np.unique(np.stack([text_of[sure].astype(np.uint64) * np.uint64(k) + best[sure].astype(np.uint64), mark[sure]]), axis=1)[0].astype(np.int64)
        active = (np.bincount(seen, minlength=texts * k).reshape(texts, k) >= ACTIVE_LINES) if len(seen) else np.zeros((texts, k), bool)
        active[~active.any(axis=1)] = True
        allowed = np.where(active[text_of], bits, np.inf)
        lang = allowed.argmin(axis=1)
        cost = allowed[each, lang]
        foreign = cost - order[:, 0] > FOREIGN_BITS
        lang = np.where(foreign, best, lang)
        rest = allowed.copy()
        rest[each, lang] = np.inf
        open_ = ~foreign & (rest.min(axis=1) - cost < SURE_BITS)
        weight = np.exp(-(bits - order[:, :1]) / SOFTNESS)
        sure_of = weight[each, lang] / weight.sum(axis=1)
        # cues
        head = np.concatenate([[True], (text_of[1:] != text_of[:-1]) | (cue_of[1:] != cue_of[:-1])])
        first = np.flatnonzero(head)
        cue = np.cumsum(head) - 1
        masks = np.bitwise_or.reduceat(np.where(open_, 0, 1 << lang), first)
        cue_text, cue_no = text_of[first], cue_of[first]
        m = len(first)
        known = masks > 0
        new_text = np.concatenate([[True], cue_text[1:] != cue_text[:-1]])
        before = np.maximum.accumulate(np.where(known, np.arange(m), -1))
        begin = np.maximum.accumulate(np.where(new_text, np.arange(m), 0))
        after = np.minimum.accumulate(np.where(known, np.arange(m), m)[::-1])[::-1]
        end = np.flatnonzero(np.concatenate([cue_text[1:] != cue_text[:-1], [True]]))
        stop = end[np.searchsorted(end, np.arange(m))]
        source = np.where(before >= begin, before, np.where(after <= stop, after, -1))
        # a document with nothing decided takes its least total code length
        total = np.stack([np.bincount(text_of, bits[:, c], texts) for c in range(k)], axis=1)
        masks = np.where(source >= 0, masks[np.maximum(source, 0)], 1 << total.argmin(axis=1)[cue_text])
        found = []
        for c in range(k):
            has = (masks >> c & 1).astype(bool)
            if not has.any():
                continue
            held = np.zeros(m)
            own = lang == c
            np.maximum.at(held, cue[own], sure_of[own])
            opens = has & (new_text | ~np.concatenate([[False], has[:-1]]))
            closes = has & np.concatenate([opens[1:] | ~has[1:] | new_text[1:], [True]])
            a, b = np.flatnonzero(opens), np.flatnonzero(closes)
            sums = np.concatenate([[0.0], np.cumsum(np.where(has, held, 0.0))])
            found.append((cue_text[a], np.full(len(a), c), cue_no[a] + 1, cue_no[b] + 1, b - a + 1, (sums[b + 1] - sums[a]) / (b - a + 1)))
        cols = [np.concatenate(x) for x in zip(*found)]
        return tuple(c.astype(t) for c, t in zip(cols, (np.int64, np.int64, np.int32, np.int32, np.int32, np.float64)))


_JUDGES: dict[str, Judge] = {}


def _judge(shared: Broadcast, mark: str) -> Judge:
    """This worker's judge of the model of that mark; it lives as long as the worker, so later tasks find the words of earlier ones."""
    if mark not in _JUDGES:
        _JUDGES.clear()
        _JUDGES[mark] = Judge(shared.value)
    return _JUDGES[mark]


def stretches(documents: DataFrame, key: str, text: str, model: Model, batch: int = 500) -> DataFrame:
    """(key, lang, first_cue, last_cue, cues, confidence): every maximal run of dialogue cues in a language.

    Cue numbers count the cues of the file from 1, whatever numbers it gives them; ``cues`` counts those with dialogue.
    A cue in two languages belongs to a run of each. Null, empty and cueless texts give no rows; keys may repeat or be
    null, each row is judged on its own; whole texts are read.
    """
    sc = documents.sparkSession.sparkContext
    shared = sc.broadcast(model)  # at most SAMPLES lines a language went in
    mark = model.mark()
    kind = documents.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = _judge(shared, mark)
        names = np.array(judge.model.classes, dtype=object)
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                text_no, lang, first, last, count, sure = judge.stretches(part.column(1).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(text_no)), pa.array(names[lang], pa.string()), pa.array(first), pa.array(last), pa.array(count), pa.array(sure)],
                    ["key", "lang", "first_cue", "last_cue", "cues", "confidence"],
                )

    out = documents.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, lang string, first_cue int, last_cue int, cues int, confidence double")
    return out.withColumnRenamed("key", key)


def _words(label: Column) -> Column:
    return F.filter(F.split(F.lower(label), r"[^\p{L}]+"), lambda x: x != "")


def label_code(label: Column, names: dict[str, str] | None = None) -> Column:
    """The two-letter code a label names, in any usual style, with or without region; null where it names none.

    ``names``: the codes and names of each language as words, by code; by default those of the twelve fixed languages.
    """
    codes = {name: code for code, words in (NAMES if names is None else names).items() for name in words.lower().split()}
    known = F.create_map(*(F.lit(x) for pair in codes.items() for x in pair)) if codes else F.create_map().cast("map<string,string>")
    parts = _words(label)
    # a code must come first ('en-GB'); a name may follow another word ('Brazilian Portuguese')
    first = F.try_element_at(known, F.get(parts, F.lit(0)))
    named = F.get(F.filter(F.transform(F.filter(parts, lambda x: F.length(x) > 3), lambda x: F.try_element_at(known, x)), lambda x: x.isNotNull()), F.lit(0))
    return F.coalesce(first, named)


def document_languages(documents: DataFrame, runs: DataFrame, key: str) -> DataFrame:
    """(key, lang, confidence, share, languages): the language with most cues of each document; null without dialogue.

    Ties go to the higher confidence, then to the code first in the alphabet. ``documents`` keys are taken as distinct.
    """
    per = runs.groupBy(key, "lang").agg(F.sum("cues").alias("n"), (F.sum(F.col("cues") * F.col("confidence")) / F.sum("cues")).alias("sure"))
    best = per.groupBy(key).agg(
        F.min(F.struct((-F.col("n")).alias("n"), (-F.col("sure")).alias("sure"), "lang")).alias("top"), F.sum("n").alias("total"), F.array_sort(F.collect_list("lang")).alias("languages")
    )
    return documents.select(key).join(best, key, "left").select(key, F.col("top.lang").alias("lang"), (-F.col("top.sure")).alias("confidence"), (-F.col("top.n") / F.col("total")).alias("share"), "languages")


def mislabelled(documents: DataFrame, runs: DataFrame, key: str, label: str, least: int = 5, names: dict[str, str] | None = None) -> DataFrame:
    """(key, lang): languages with at least ``least`` dialogue cues in a row that the document's label does not name.

    ``names`` as in ``label_code``; whatever they are, a label that begins with a language's own code names it.
    """
    long = runs.where(F.col("cues") >= least).select(key, "lang").distinct()
    named = documents.select(key, label_code(F.col(label), names).alias("named"), F.get(_words(F.col(label)), F.lit(0)).alias("code"))
    met = long.join(named, key)
    return met.where(~F.col("lang").eqNullSafe(F.coalesce("named", "code"))).select(key, "lang")
