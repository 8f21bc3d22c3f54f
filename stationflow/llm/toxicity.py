"""Toxicity by a counterfactually regularised classifier.

A logistic model over the presence of words in a whole text. Labelled sentences
that name a group are repeated with the group's term swapped for others of its
kind, and each change of score between a sentence and its swaps is penalised. So
a term's own weight is drawn to those of its kind, and a neutral mention isn't
held against a text because some toxic texts name that group.

The model is fitted on a bounded sample of labelled rows (``MAX_TRAIN``, drawn by
a hash of the id); scoring covers all texts, whole.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.llm.common import fold, keep_texts, map_texts, steps
from stationflow.llm.tokens import TOKEN_STEP, ChunkTable

#: Most labelled rows that the model is fitted on.
MAX_TRAIN = 10_000
#: A word has a weight if its log odds of being in a toxic text are off by so many standard errors.
LEAST_ERRORS = 3.0
#: Weight of the penalty on changes of score, and of that on weights.
COUNTERFACTUAL, RIDGE = 1.0, 1e-5
ROUNDS = 300
#: Distinct chunks whose features a task keeps: they are quickly found anew.
CHUNKS = 100_000

#: Terms that name groups, by kind, in English, German, French and Spanish.
TERMS = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy", "female", "male"),
    ("christian", "muslim", "jewish", "hindu", "buddhist", "atheist"),
    ("christians", "muslims", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino", "arab", "african", "european"),
    ("gay", "lesbian", "straight", "bisexual", "transgender"),
    ("immigrants", "refugees", "foreigners", "locals"),
    ("old", "young", "disabled", "deaf", "blind"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("christen", "muslime", "juden", "buddhisten", "atheisten"),
    ("schwarze", "weiße", "asiaten", "araber", "afrikaner", "europäer"),
    ("schwule", "lesben", "heterosexuelle", "bisexuelle"),
    ("einwanderer", "flüchtlinge", "ausländer", "einheimische"),
    ("alte", "junge", "behinderte", "gehörlose", "blinde"),
    ("femmes", "hommes", "filles", "garçons"),
    ("chrétiens", "musulmans", "juifs", "hindous", "bouddhistes", "athées"),
    ("noirs", "blancs", "asiatiques", "arabes", "africains", "européens"),
    ("lesbiennes", "homosexuels", "hétérosexuels", "bisexuels"),
    ("immigrés", "réfugiés", "étrangers", "habitants"),
    ("vieux", "jeunes", "handicapés", "sourds", "aveugles"),
    ("mujeres", "hombres", "niñas", "niños"),
    ("cristianos", "musulmanes", "judíos", "hindúes", "budistas", "ateos"),
    ("negros", "blancos", "asiáticos", "árabes", "africanos", "europeos"),
    ("lesbianas", "homosexuales", "heterosexuales", "bisexuales"),
    ("inmigrantes", "refugiados", "extranjeros", "vecinos"),
    ("viejos", "jóvenes", "discapacitados", "sordos", "ciegos"),
)

WORD = re.compile(r"[^\W_]+")
SENTENCE = re.compile(r"[.!?\n]+")


def feature(word: str) -> int:
    """A word's number, a hash of 31 bits."""
    return zlib.crc32(word.encode("utf-8")) >> 1


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def _chunk_features(chunks: list[str]) -> list[list[int]]:
    return [[feature(w) for w in WORD.findall(c)] for c in chunks]


class Swapper:
    """Counterfactual sentences: what a swap takes from a text's words and puts in."""

    def __init__(self, terms: tuple[tuple[str, ...], ...] = TERMS):
        self.kind = {t: kind for kind in reversed(terms) for t in kind}  # of two kinds the first
        self.any = re.compile(r"(?<![^\W_])(?:" + "|".join(sorted(map(re.escape, self.kind), key=len, reverse=True)) + r")(?![^\W_])")

    def changes(self, text: str) -> list[list[int]]:
        """The text's distinct changes: how many sentences have it, then its features, those that go
        negated (-1 - feature).

        A sentence's terms are swapped together, each for the next, second next ... term of its
        kind, until every other term has stood in its place.
        """
        low = text.lower()
        if not self.any.search(low):
            return []
        held = Counter(tuple(sorted(set(self.any.findall(sentence)))) for sentence in SENTENCE.split(low))
        out: Counter[tuple[int, ...]] = Counter()
        for terms, n in held.items():
            for shift in range(1, max((len(self.kind[t]) for t in terms), default=0)):
                new = {t: self.kind[t][(self.kind[t].index(t) + shift) % len(self.kind[t])] for t in terms}
                pairs = [(t, x) for t, x in new.items() if t != x]
                out[tuple([-1 - feature(t) for t, _ in pairs] + [feature(x) for _, x in pairs])] += n
        return [[n, *c] for c, n in sorted(out.items())]


@dataclass
class Model:
    """The weights of the words that have one, by ascending number."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def weight(self, word: str) -> float:
        hit = np.flatnonzero(self.words == feature(word))
        return float(self.weights[hit[0]]) if len(hit) else 0.0


def training_rows(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", max_train: int = MAX_TRAIN) -> DataFrame:
    """(id, label, features, changes) of a bounded sample of labelled texts outside the held-out fold.

    An id's label is the largest of its labels; of texts that share an id one is
    taken. Rows without an id or a label teach nothing.
    """
    known = labels.where(F.col(label_col).isNotNull() & (fold(id_col) != 0)).groupBy(id_col).agg(F.max(label_col).cast("int").alias("label"))
    # Of at most max_train rows of two numbers, so it may be sent to all.
    sample = known.orderBy(F.xxhash64(id_col), id_col).limit(max_train).withColumnRenamed(id_col, "id")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(F.broadcast(sample), "id")
    schema = T.StructType(
        [rows.schema["id"], T.StructField("label", T.IntegerType()), T.StructField("features", T.ArrayType(T.IntegerType())), T.StructField("changes", T.ArrayType(T.ArrayType(T.IntegerType())))]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        swapper = Swapper()
        for batch in batches:
            for part in steps(batch, "text"):
                texts = part.column("text").to_pylist()
                found = [sorted({feature(w) for w in words_of(t)}) for t in texts]
                changes = [swapper.changes(t) for t in texts]
                columns = [part.column("id"), part.column("label"), pa.array(found, pa.list_(pa.int32())), pa.array(changes, pa.list_(pa.list_(pa.int32())))]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    made = rows.select("id", "label", "text").mapInArrow(run, schema)
    one = F.min(F.struct("features", "label", "changes")).alias("one")
    return made.groupBy("id").agg(one).select("id", "one.*")


def fit(rows: DataFrame, counterfactual: float = COUNTERFACTUAL, ridge: float = RIDGE, rounds: int = ROUNDS) -> Model:
    """The model of at most ``MAX_TRAIN`` training rows (equal texts count once).

    Without rows every score is 0.5; with one label alone the bias carries it.
    """
    seen: dict[bytes, tuple[int, np.ndarray, list]] = {}
    sample = rows.select("label", "features", "changes").toArrow().combine_chunks()
    for i in range(sample.num_rows):
        features = sample["features"][i].values.to_numpy()
        label = max(sample["label"][i].as_py(), seen.get(features.tobytes(), (0,))[0])
        seen[features.tobytes()] = (label, features, sample["changes"][i].as_py())
    texts = [seen[k] for k in sorted(seen)]
    if not texts:
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), 0.0)
    y = np.array([t[0] for t in texts], float)
    n = len(y)
    flat = np.concatenate([t[1] for t in texts])
    owner = np.repeat(np.arange(n), [len(t[1]) for t in texts])
    times = np.array([c[0] for t in texts for c in t[2]], float)
    changes = [c[1:] for t in texts for c in t[2]]
    moved = np.array([f for c in changes for f in c], np.int64)
    sentence = np.repeat(np.arange(len(changes)), [len(c) for c in changes])
    sign = np.where(moved < 0, -1.0, 1.0)
    moved = np.where(moved < 0, -1 - moved, moved)

    numbers, at = np.unique(flat, return_inverse=True)
    toxic = np.bincount(at, y[owner], len(numbers)) + 0.5
    clean = np.bincount(at, 1 - y[owner], len(numbers)) + 0.5
    no_toxic, no_clean = y.sum() + 1 - toxic, n - y.sum() + 1 - clean
    odds = np.log(toxic * no_clean / (no_toxic * clean))
    told = np.abs(odds) >= LEAST_ERRORS * np.sqrt(1 / toxic + 1 / clean + 1 / no_toxic + 1 / no_clean)
    words = np.union1d(numbers[told], moved).astype(np.int32)
    size = len(words)
    place = np.searchsorted(words, flat)
    used = place < size
    used[used] = words[place[used]] == flat[used]
    flat, owner, moved = place[used], owner[used], np.searchsorted(words, moved)

    # A toxic text counts as many times as clean ones outnumber it, square-rooted.
    share = np.where(y > 0, np.sqrt(max(1.0, (n - y.sum()) / max(1.0, y.sum()))), 1.0)
    share /= share.mean()
    weights, bias = np.zeros(size), float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    # Adam on the mean loss: the step of each weight follows its own gradients.
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for k in range(1, rounds + 1):
        score = np.bincount(owner, weights[flat], n) + bias
        error = (1 / (1 + np.exp(-np.clip(score, -40, 40))) - y) * share
        gradient = np.bincount(flat, error[owner], size) / n + ridge * weights
        if len(changes):
            change = np.bincount(sentence, sign * weights[moved], len(changes)) * times
            gradient += 2 * counterfactual * np.bincount(moved, sign * change[sentence], size) / times.sum()
        whole = np.append(gradient, error.mean())
        first, second = 0.9 * first + 0.1 * whole, 0.999 * second + 0.001 * whole**2
        step = 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.999**k)) + 1e-9)
        weights -= step[:-1]
        bias -= step[-1]
    return Model(words, weights.astype(np.float32), float(bias))


def _scorer(model: Model) -> Callable[[], Callable[[pa.Array], np.ndarray]]:
    """What a task runs: scores of an array of texts."""
    words, weights, bias = model.words, model.weights, model.bias

    def make() -> Callable[[pa.Array], np.ndarray]:
        table = ChunkTable(_chunk_features, CHUNKS)

        def work(part: pa.Array) -> np.ndarray:
            features, lengths = table.encode(part)
            owner = np.repeat(np.arange(len(lengths), dtype=np.int64), lengths)
            total = np.full(len(lengths), bias)
            if len(words):
                at = np.minimum(np.searchsorted(words, features), len(words) - 1)
                known = words[at] == features
                pairs = np.unique(owner[known] * len(words) + at[known])
                total += np.bincount(pairs // len(words), weights[pairs % len(words)], len(lengths))
            return 1 / (1 + np.exp(-np.clip(total, -40, 40)))

        return work

    return make


def score(docs: DataFrame, model: Model, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """``docs`` with ``score`` (0 to 1) and ``predicted`` (1 where it is 0.5 or more).

    NULL, empty and wordless texts get the score of the bias. A word counts once
    a text, so repeated passages change nothing. Columns of these names are
    replaced; others stay, and so do repeated rows. A very long text is scored whole, a step
    of its own; an empty table gives no rows.
    """
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    scorer = _scorer(model)

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        work = scorer()

        def columns(part: pa.Array) -> list[pa.Array]:
            value = work(part)
            return [pa.array(value, pa.float64()), pa.array((value >= 0.5).astype(np.int32))]

        return columns

    return map_texts(docs, text_col, fields, make, drop_text, TOKEN_STEP)


def keep_clean(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """The documents that ``score`` predicts 0 for, all columns as they are."""
    scorer = _scorer(model)

    def make() -> Callable[[pa.Array], np.ndarray]:
        work = scorer()
        return lambda part: work(part) < 0.5

    return keep_texts(docs, text_col, make, TOKEN_STEP)
