"""Language identification by hyperdimensional profiles.

Every letter has a random vector of signs. A trigram's vector binds its letters'
vectors, each permuted (rotated) by its place, by multiplication; a text's
vector bundles (adds) its trigrams' vectors, and a language's prototype bundles
those of its training texts. A text is in the language whose prototype has the
largest cosine with it. Letters are lower-cased; all else is one blank between
words, which trigrams hold at a word's edges.

A task binds each distinct trigram of a step of texts once and bundles by one
product of the texts' trigram counts with these vectors. Training sums partial
bundles, one row per task and language, and covers all training texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.llm.common import keep_texts, map_texts, release, steps

DIMENSIONS = 1024
GRAM = 3
SEED = 11
UNKNOWN = "und"
#: Trigrams whose vectors are bound at once: bounds a step's memory.
BOUND_AT_ONCE = 4_096
#: Texts bundled at once.
TEXTS_AT_ONCE = 512


class Bundler:
    """Trigram counts and bundles of texts; keeps letters' vectors between steps."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = SEED):
        self.dimensions, self.seed = dimensions, seed
        self.number = np.full(0x110000, -1, np.int64)  # of a letter, by code point
        self.number[ord(" ")] = 0
        self.letters = 1
        self.rotated = np.zeros((GRAM, 64, dimensions), np.float32)
        self._draw(" ", 0)
        alphabetic = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
        self.blank = ~alphabetic

    def _draw(self, letter: str, number: int) -> None:
        signs = np.random.default_rng([self.seed, ord(letter)]).integers(0, 2, self.dimensions) * 2 - 1
        while number >= self.rotated.shape[1]:
            self.rotated = np.concatenate([self.rotated, np.zeros_like(self.rotated)], axis=1)
        for place in range(GRAM):
            self.rotated[place, number] = np.roll(signs, GRAM - 1 - place)

    def grams(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """The trigrams (as letters' numbers, 21 bits each) of all texts and the text of each."""
        texts = [f" {t.lower()} " if t else " " for t in texts]
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
        owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        codes = np.where(self.blank[codes], 32, codes)
        first = np.concatenate([[True], (codes[1:] != 32) | (codes[:-1] != 32)])
        codes, owner = codes[first], owner[first]
        numbers = self.number[codes]
        if (numbers < 0).any():
            for c in np.unique(codes[numbers < 0]).tolist():
                self._draw(chr(c), self.letters)
                self.number[c] = self.letters
                self.letters += 1
            numbers = self.number[codes]
        if len(codes) < GRAM:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        grams = numbers[:-2] << 42 | numbers[1:-1] << 21 | numbers[2:]
        middle = numbers[1:-1] != 0  # a blank at the edges at most
        return grams[middle], owner[1:-1][middle]

    def bound(self, grams: np.ndarray) -> np.ndarray:
        """Vectors of distinct trigrams."""
        places = (grams >> 42, grams >> 21 & 0x1FFFFF, grams & 0x1FFFFF)
        return self.rotated[0, places[0]] * self.rotated[1, places[1]] * self.rotated[2, places[2]]

    def bundles(self, grams: np.ndarray, owner: np.ndarray, owners: int) -> np.ndarray:
        """The sum of each owner's trigram vectors."""
        out = np.zeros((owners, self.dimensions), np.float32)
        if not len(grams):
            return out
        known = self.letters
        if known <= 128:  # few letters: number the trigrams without sorting
            compact = ((grams >> 42) * known + (grams >> 21 & 0x1FFFFF)) * known + (grams & 0x1FFFFF)
            held = np.zeros(known**3, bool)
            held[compact] = True
            distinct = np.flatnonzero(held)
            place = np.zeros(known**3, np.int64)
            place[distinct] = np.arange(len(distinct))
            at = place[compact]
            distinct = distinct // known**2 << 42 | distinct // known % known << 21 | distinct % known
        else:
            distinct, at = np.unique(grams, return_inverse=True)
        for start in range(0, len(distinct), BOUND_AT_ONCE):
            part = distinct[start : start + BOUND_AT_ONCE]
            inside = (at >= start) & (at < start + len(part)) if len(distinct) > BOUND_AT_ONCE else slice(None)
            counts = np.bincount(owner[inside] * len(part) + (at[inside] - start), minlength=owners * len(part))
            out += counts.reshape(owners, len(part)).astype(np.float32) @ self.bound(part)
        return out


def learn(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", dimensions: int = DIMENSIONS, seed: int = SEED) -> dict[str, np.ndarray]:
    """Each language's prototype, from all rows with a language.

    NULL languages and texts without letters teach nothing. What comes to the
    driver is a vector for each distinct language.
    """
    schema = "lang string, place int, value double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundler = Bundler(dimensions, seed)
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in steps(batch, "text"):
                langs = part.column("lang").dictionary_encode()
                names, codes = langs.dictionary.to_pylist(), langs.indices.to_numpy()
                grams, owner = bundler.grams(part.column("text").to_pylist())
                for name, row in zip(names, bundler.bundles(grams, codes[owner].astype(np.int64), len(names)), strict=True):
                    sums[name] = sums.get(name, 0) + row.astype(np.float64)
        for name, row in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(row)), pa.array(np.arange(len(row), dtype=np.int32)), pa.array(row)], names=["lang", "place", "value"])
        bundler = batch = part = None
        release()

    rows = docs.select(F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text")).where("lang is not null")
    total = rows.mapInArrow(run, schema).groupBy("lang", "place").agg(F.sum("value").alias("value"))
    profiles: dict[str, np.ndarray] = {}
    for r in total.collect():
        profiles.setdefault(r["lang"], np.zeros(dimensions))[r["place"]] = r["value"]
    return {name: row for name, row in sorted(profiles.items()) if row.any()}


def _identifier(profiles: dict[str, np.ndarray], seed: int) -> Callable[[], Callable[[pa.Array], tuple[list[str], np.ndarray]]]:
    """What a task runs: languages and cosines of an array of texts."""
    names = list(profiles)
    matrix = np.array([profiles[n] / np.linalg.norm(profiles[n]) for n in names], np.float32)
    dimensions = matrix.shape[1] if names else DIMENSIONS
    def make() -> Callable[[pa.Array], tuple[list[str], np.ndarray]]:
        bundler = Bundler(dimensions, seed)

        def some(texts: list[str | None]) -> tuple[list[str], np.ndarray]:
            grams, owner = bundler.grams(texts)
            rows = bundler.bundles(grams, owner, len(texts))
            length = np.sqrt((rows.astype(np.float64) ** 2).sum(1))
            if not names:
                return [UNKNOWN] * len(texts), np.zeros(len(texts))
            cosine = (rows @ matrix.T) / np.maximum(length, 1e-12)[:, None]
            best = cosine.argmax(1)
            known = np.bincount(owner, minlength=len(texts)) > 0
            score = np.where(known, np.clip(cosine.max(1), 0, 1), 0).astype(np.float64)
            return [names[b] if k else UNKNOWN for b, k in zip(best.tolist(), known.tolist(), strict=True)], score

        def work(part: pa.Array) -> tuple[list[str], np.ndarray]:
            texts = part.to_pylist()
            found = [some(texts[i : i + TEXTS_AT_ONCE]) for i in range(0, len(texts), TEXTS_AT_ONCE)]
            return [lang for langs, _ in found for lang in langs], np.concatenate([np.zeros(0), *(score for _, score in found)])

        return work

    return make


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", seed: int = SEED, drop_text: bool = False) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score``: the nearest profile and its cosine, held to 0 .. 1.

    NULL texts and texts without a letter (or no profiles at all) are ``und`` with
    score 0. Of equal cosines the first language by name wins. Columns of these
    names are replaced; others stay, and so do repeated rows. A very long text is a step of its
    own, read whole (about 60 bytes of memory a letter); an empty table gives no rows.
    """
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]
    identifier = _identifier(profiles, seed)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        work = identifier()

        def columns(part: pa.Array) -> list[pa.Array]:
            langs, score = work(part)
            return [pa.array(langs, pa.string()), pa.array(score, pa.float64())]

        return columns

    return map_texts(docs, text_col, fields, make, drop_text)


def keep_identified(docs: DataFrame, profiles: dict[str, np.ndarray], least: float, text_col: str = "text", seed: int = SEED) -> DataFrame:
    """The documents whose texts ``identify`` gives a language with a score of ``least`` or more, all columns as they are."""
    identifier = _identifier(profiles, seed)

    def make() -> Callable[[pa.Array], np.ndarray]:
        work = identifier()

        def keep(part: pa.Array) -> np.ndarray:
            langs, score = work(part)
            return np.array([lang != UNKNOWN for lang in langs], bool) & (score >= least)

        return keep

    return keep_texts(docs, text_col, make)
