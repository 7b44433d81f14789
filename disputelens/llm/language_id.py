"""Operator 5: language identification by cross-parsing entropy.

For every language a suffix automaton of labelled text is built. A text is
parsed greedily against it: the longest match from the current place is one
phrase, then the parse goes on behind it. The phrases needed, times the log of
the automaton's text length, over the characters parsed, estimate the cross
entropy; the language with the fewest phrases so normalised wins.

Only letters are parsed. Phrases do not reach over white space, so a word costs the same wherever it
stands: each worker keeps the phrase counts of the words it has met (a table
of bounded size), and texts are summed up word by word, whole.

Learning uses a bounded sample: per language the ``SAMPLE_DOCS`` documents
first by a hash of their text, their letters cut together at ``SAMPLE_CHARS`` characters per
language, before they are collected, for the ``LANGUAGES`` most frequent labels. The sample is found with a salted top-k, so no language is gathered
in one task. Broadcast: languages x ``SAMPLE_CHARS`` characters.

Defined results: a null text or one without a letter is ``und`` with score 0;
so is every text if nothing was learned; equal entropies go to the first
language by name; repeated rows are handled each on their own; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import pick, ship_package

SAMPLE_DOCS = 60  # per language
SAMPLE_CHARS = 30_000  # per language
SALTS = 64
LANGUAGES = 200  # the most frequent labels
KEPT_WORDS = 500_000
KEPT_CHARS = 64  # longer words seldom repeat and are not kept
UNDETERMINED = "und"


class SuffixAutomaton:
    """All substrings of a text; ``phrases(word)`` counts the greedy longest matches that make up a word."""

    def __init__(self, text: str):
        self.next: list[dict[str, int]] = [{}]
        link, length, last = [-1], [0], 0
        for c in text:
            new = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = new
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[p] + 1 == length[q]:
                    link[new] = q
                else:
                    twin = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = twin
                        p = link[p]
                    link[q] = link[new] = twin
            last = new

    def phrases(self, word: str) -> int:
        states, count, at = self.next, 0, 0
        n = len(word)
        while at < n:
            state, start = 0, at
            while at < n:
                to = states[state].get(word[at])
                if to is None:
                    break
                state = to
                at += 1
            if at == start:
                at += 1  # a character the language does not have
            count += 1
        return count


def learn(
    docs: DataFrame, sample_docs: int = SAMPLE_DOCS, sample_chars: int = SAMPLE_CHARS, languages: int = LANGUAGES
) -> dict[str, str]:
    """``{language: text}`` from documents with ``text`` and a non-null ``lang``, for the most frequent languages."""
    counted = pick(docs, "lang").na.drop().groupBy("lang").count().orderBy(F.desc("count"), "lang")
    known = [r["lang"] for r in counted.limit(languages).collect()]
    d = pick(docs, "text", "lang").filter(F.col("text").isNotNull() & F.col("lang").isin(known))
    d = d.select("lang", "text", F.xxhash64("text").alias("h"), (F.abs(F.xxhash64("text", F.lit(1))) % SALTS).alias("salt"))
    ids = d.select("lang", "h", "salt").distinct()
    salted = Window.partitionBy("lang", "salt").orderBy("h")
    whole = Window.partitionBy("lang").orderBy("h")
    top = ids.withColumn("r", F.row_number().over(salted)).filter(F.col("r") <= sample_docs)
    top = top.withColumn("r", F.row_number().over(whole)).filter(F.col("r") <= sample_docs).select("lang", "h")
    found = d.join(F.broadcast(top), ["lang", "h"])  # at most sample_docs rows per language
    cut = found.groupBy("lang", "h").agg(F.substring(F.min("text"), 1, sample_chars).alias("text"))
    cut = cut.withColumn("text", F.trim(F.regexp_replace("text", OTHERS, " ")))
    before = F.sum(F.length("text")).over(whole.rowsBetween(Window.unboundedPreceding, -1))
    cut = cut.withColumn("before", F.coalesce(before, F.lit(0))).filter(F.col("before") < sample_chars).select("lang", "h", "text")
    texts: dict[str, str] = {}
    for lang, _, text in sorted(tuple(r) for r in cut.collect()):  # under 2 * sample_chars characters per language
        have = texts.get(lang, "")
        texts[lang] = " ".join([have, *LETTERS(text.lower())]).strip()[:sample_chars]
    return texts


# runs of letters, the only characters parsed: marks and digits say nothing of a language
LETTERS = re.compile(r"[^\W\d_]+").findall
OTHERS = "[^\\p{L}\\p{Nl}\\p{No}]+"  # what stands between them, for Spark

_PARSERS: dict = {}


class Parser:
    """Phrase counts of words in all languages, and the best language of a text."""

    def __init__(self, texts: dict[str, str]):
        self.langs = sorted(texts)
        self.automata = [SuffixAutomaton(texts[k]) for k in self.langs]
        self.weights = [math.log2(max(2, len(texts[k]))) for k in self.langs]
        self.bits = 40  # one number holds a word's counts for all languages
        self.words: dict[str, int] = {}

    def word(self, word: str) -> int:
        runs = LETTERS(word)
        packed = sum(map(len, runs)) << (len(self.automata) * self.bits)
        for i, a in enumerate(self.automata):
            packed |= sum(map(a.phrases, runs)) << (i * self.bits)
        if len(self.words) < KEPT_WORDS and len(word) <= KEPT_CHARS:
            self.words[word] = packed
        return packed

    def best(self, text: str | None) -> tuple[str, float]:
        words = text.lower().split() if text else []
        known = self.words
        total = sum([known[w] if w in known else self.word(w) for w in words])
        letters = total >> (len(self.automata) * self.bits)
        if not letters or not self.langs:
            return UNDETERMINED, 0.0
        mask = (1 << self.bits) - 1
        entropy = [((total >> (i * self.bits)) & mask) * w / letters for i, w in enumerate(self.weights)]
        order = sorted(range(len(entropy)), key=lambda i: (entropy[i], self.langs[i]))
        first = entropy[order[0]]
        rest = [2.0 ** (-4 * (entropy[i] - first)) for i in order]
        return self.langs[order[0]], rest[0] / sum(rest)


def predict(docs: DataFrame, texts: dict[str, str], keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score``, the winner's share of the languages' likelihoods."""
    ship_package(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(texts)
    key = hashlib.md5(repr(sorted(texts.items())).encode()).hexdigest()
    d = pick(docs, *keep, "text")
    schema = d.select(*keep).withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema

    def parse(batches):
        from disputelens.llm import language_id as here

        parser = here.parser(key, sent.value)
        for batch in batches:
            found = [parser.best(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column(c) for c in keep]
            columns += [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*keep, "lang_pred", "score"])

    return d.mapInArrow(parse, schema)


def parser(key: str, texts: dict[str, str]) -> Parser:
    """The worker's parser, built once for each model."""
    if key not in _PARSERS:
        _PARSERS.clear()
        _PARSERS[key] = Parser(texts)
    return _PARSERS[key]
