"""Language-model scores of whole documents: a gated recurrent network with a class-factored softmax.

Counts first. Documents are cut into words in chunks of bounded size, each one row of a
stored table; a chunk's distinct words are shuffled once to be counted over all training
documents and once to bring the counts back. That gives the add-one base score,
and a second stored table holds every chunk as codes: the most frequent words (the
head, whose size is a parameter), the end of a document, and one code for all other words.

The network reads the codes of a document from its start to its end. Its output is factored
into classes of the head (the probability of the class, then of the word within it) and a
class for the tail, within which a word has its add-one share of the tail's counts. So
every word has a probability and the vocabulary may grow without bound.

Training is truncated backpropagation in numpy: documents lie one after another in lanes, the
state is carried from window to window and starts anew with each document, and gradients stop
at a window's start. All training documents are used, each in one of a fixed number of rounds. In
a round every task trains a copy of the parameters on its own rows, and the copies are averaged by
their tokens, in groups of bounded size. Scoring carries the state across windows in the same way, so a
document's log-likelihood is that of its whole text, whatever its length.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stationflow.llm.common import release, steps
from stationflow.session import cut_lineage

#: Bytes of text of a chunk (a longer single text makes a chunk of its own).
CHUNK_BYTES = 32_000_000
#: Words of the head; sizes of the embeddings and of the state; classes of the head.
HEAD = 1_024
EMBEDDING = 16
STATE = 16
CLASSES = 24
#: Each training document is seen once, in one of these rounds.
RATES = (0.02, 0.012, 0.006, 0.002)
#: Lanes and steps of a training window, and of a scoring window.
TRAIN_LANES, TRAIN_STEPS = 256, 16
LANES, STEPS = 512, 16
#: Tokens that a task works on at a time.
WORK = 4_000_000
#: Numbers of a block of parameters, and tasks whose blocks are averaged in one group.
BLOCK = 16_384
FAN = 32
CLIP = 1.0
#: In training a longer document starts anew after so many tokens.
PIECE = 2_048
END = 0


@dataclass
class Layout:
    """Codes: 0 is the end of a document, then the head's words by count, then the tail."""

    counts: np.ndarray  # of the end and the head's words
    tail_count: int
    classes: np.ndarray = field(init=False)  # where each class of codes begins, and the tail
    of: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        n = len(self.counts)
        share = np.cumsum(np.sqrt(self.counts + 1.0))
        number = np.minimum((share / share[-1] * CLASSES).astype(np.int64), CLASSES - 1)
        number = np.unique(number, return_inverse=True)[1]
        self.classes = np.append(np.searchsorted(number, np.arange(number[-1] + 1)), n)
        self.of = np.append(number, number[-1] + 1)

    @property
    def tail(self) -> int:
        return len(self.counts)


NAMES = ("embedding", "input", "bias", "recurrent", "class_weight", "class_bias", "word_weight", "word_bias")


def start(layout: Layout, seed: int = 11) -> dict[str, np.ndarray]:
    """Parameters whose output is the add-one unigram distribution of the codes."""
    rng = np.random.default_rng(seed)
    codes, classes = len(layout.counts) + 1, len(layout.classes)
    small = lambda *shape: rng.normal(0, 0.1, shape).astype(np.float32)
    p = np.log(np.append(layout.counts, layout.tail_count) + 1.0)
    of_class = np.log(np.bincount(layout.of, np.exp(p), classes))
    return {
        "embedding": small(codes, EMBEDDING) * 3,
        "input": small(EMBEDDING, 3 * STATE) * 2,
        "bias": np.zeros(3 * STATE, np.float32),
        "recurrent": small(STATE, 3 * STATE) * 2,
        "class_weight": small(STATE, classes) * 0.1,
        "class_bias": (of_class - of_class.max()).astype(np.float32),
        "word_weight": small(codes - 1, STATE) * 0.1,
        "word_bias": (p[:-1] - of_class[layout.of[:-1]]).astype(np.float32),
    }


def _sigmoid(x: np.ndarray) -> np.ndarray:
    x *= 0.5
    np.tanh(x, out=x)
    x *= 0.5
    x += 0.5
    return x


def _softmax(logits: np.ndarray, at: np.ndarray, shares: bool = True) -> np.ndarray:
    """Turns columns of logits into probabilities, in place; the logarithm of that of one row a column.
    (A column an item: numpy sums over rows fast.)"""
    logits -= logits.max(0)
    own = logits[at, np.arange(len(at))]
    np.exp(logits, out=logits)
    total = logits.sum(0)
    if shares:
        logits /= total
    return own - np.log(total)


class Network:
    """The gated recurrent network over windows of lanes (step, lane)."""

    def __init__(self, parameters: dict[str, np.ndarray], layout: Layout):
        self.p, self.layout = parameters, layout

    def states(self, codes: np.ndarray, fresh: np.ndarray, state: np.ndarray, keep: bool = False) -> tuple[np.ndarray, list]:
        """The state at each step before the step's token, given the token before it (``codes``);
        where ``fresh``, a document starts and the state is zero."""
        p, h = self.p, STATE
        steps_, lanes = codes.shape
        gates = (p["embedding"] @ p["input"] + p["bias"])[codes]
        made = np.empty((steps_, lanes, h), np.float32)
        trace, any_fresh = [], fresh.any(1)
        for t in range(steps_):
            before = state * ~fresh[t][:, None] if any_fresh[t] else state
            own = before @ p["recurrent"]
            zr = _sigmoid(gates[t, :, : 2 * h] + own[:, : 2 * h])
            z, r = zr[:, :h], zr[:, h:]
            n = np.tanh(gates[t, :, 2 * h :] + r * own[:, 2 * h :])
            state = n + z * (before - n)
            made[t] = state
            if keep:
                trace.append((before, own[:, 2 * h :], zr, n))
        return made, trace

    def _sorted(self, targets: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, slice]]]:
        """The targets' order by class; and first code, end and place in that order of each class
        that some target has, the tail's and single ones left out."""
        of = self.layout.of[targets]
        order = np.argsort(of, kind="stable")
        ends = np.searchsorted(of[order], np.arange(len(self.layout.classes))).tolist()
        bounds = self.layout.classes.tolist()
        classes = zip(bounds[:-1], bounds[1:], ends[:-1], ends[1:], strict=True)
        return order, [(first, end, slice(a, b)) for first, end, a, b in classes if end - first > 1 and b > a]

    def log_likelihood(self, h: np.ndarray, targets: np.ndarray) -> np.ndarray:
        """Natural logarithm of each target code's probability after state ``h``."""
        p = self.p
        order, classes = self._sorted(targets)
        y, columns = targets[order], np.ascontiguousarray(h[order].T)
        own = _softmax(p["class_weight"].T @ columns + p["class_bias"][:, None], self.layout.of[y], False)
        for first, end, at in classes:
            own[at] += _softmax(p["word_weight"][first:end] @ columns[:, at] + p["word_bias"][first:end, None], y[at] - first, False)
        found = np.empty(len(y), np.float64)
        found[order] = own
        return found

    def gradients(self, codes: np.ndarray, fresh: np.ndarray, targets: np.ndarray, state: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray, float]:
        """Gradients of the window's mean loss (targets of -1 don't count), the state after it, its summed loss."""
        p, size = self.p, STATE
        made, trace = self.states(codes, fresh, state, keep=True)
        used = targets.ravel() >= 0
        h, y = made.reshape(-1, size)[used], targets.ravel()[used]
        scale = np.float32(1 / max(1, len(y)))
        g = {n: np.zeros_like(v) for n, v in p.items()}
        order, classes = self._sorted(y)
        y, columns = y[order], np.ascontiguousarray(h[order].T)
        probability = p["class_weight"].T @ columns + p["class_bias"][:, None]
        loss = -float(_softmax(probability, self.layout.of[y]).sum())
        probability[self.layout.of[y], np.arange(len(y))] -= 1
        probability *= scale
        g["class_weight"], g["class_bias"] = columns @ probability.T, probability.sum(1)
        dh = p["class_weight"] @ probability
        for first, end, at in classes:
            weight = p["word_weight"][first:end]
            probability = weight @ columns[:, at] + p["word_bias"][first:end, None]
            loss -= float(_softmax(probability, y[at] - first).sum())
            probability[y[at] - first, np.arange(at.stop - at.start)] -= 1
            probability *= scale
            g["word_weight"][first:end], g["word_bias"][first:end] = probability @ columns[:, at].T, probability.sum(1)
            dh[:, at] += weight.T @ probability
        every = np.zeros((len(used), size), np.float32)
        every[np.flatnonzero(used)[order]] = dh.T
        every = every.reshape(made.shape)
        d_gates = np.empty((*codes.shape, 3 * size), np.float32)
        d_own = np.empty((codes.shape[1], 3 * size), np.float32)
        befores, d_owns = np.empty_like(made), np.empty_like(d_gates)
        back, recurrent, any_fresh = np.zeros_like(state), np.ascontiguousarray(p["recurrent"].T), fresh.any(1)
        for t in range(len(codes) - 1, -1, -1):
            before, own_n, zr, n = trace[t]
            z = zr[:, :size]
            d = every[t] + back
            dn = (d - d * z) * (1 - n * n)
            into = d_gates[t]
            into[:, size : 2 * size] = dn * own_n
            into[:, :size] = d * (before - n)
            into[:, : 2 * size] *= zr - zr * zr
            into[:, 2 * size :] = dn
            d_own[:, : 2 * size] = into[:, : 2 * size]
            np.multiply(dn, zr[:, size:], out=d_own[:, 2 * size :])
            befores[t], d_owns[t] = before, d_own
            back = d * z + d_own @ recurrent
            if any_fresh[t]:
                back *= ~fresh[t][:, None]
        g["recurrent"] = befores.reshape(-1, size).T @ d_owns.reshape(-1, 3 * size)
        flat = d_gates.reshape(-1, 3 * size)
        g["bias"] = flat.sum(0)
        ids = codes.ravel()
        g["input"] = p["embedding"][ids].T @ flat
        at = ids[:, None] * EMBEDDING + np.arange(EMBEDDING)
        of_token = flat @ p["input"].T
        g["embedding"] = np.bincount(at.ravel(), of_token.ravel(), p["embedding"].size).reshape(-1, EMBEDDING).astype(flat.dtype)
        return g, made[-1], loss


class Adam:
    """Steps of one task's copy of the parameters."""

    def __init__(self, parameters: dict[str, np.ndarray], rate: float):
        self.p, self.rate, self.n = parameters, rate, 0
        self.first = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.second = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, g: dict[str, np.ndarray]) -> None:
        self.n += 1
        norm = float(np.sqrt(sum(float((x * x).sum()) for x in g.values())))
        shrink = np.float32(min(1.0, CLIP / max(norm, 1e-12)))
        rate = np.float32(self.rate * np.sqrt(1 - 0.999**self.n) / (1 - 0.9**self.n) * min(1.0, self.n / 10))
        for k, v in self.p.items():
            x = g[k] * shrink
            m, s = self.first[k], self.second[k]
            m += np.float32(0.1) * (x - m)
            s += np.float32(0.001) * (x * x - s)
            v -= rate * m / (np.sqrt(s) + np.float32(1e-8))


class Lanes:
    """Documents one after another in lanes of about equal length, the longest lane first."""

    def __init__(self, lengths: np.ndarray, most: int):
        order = np.argsort(-lengths, kind="stable")
        # Not more lanes than the longest document leaves of equal length, so that none goes on alone.
        n = max(1, min(most, len(lengths), int(lengths.sum()) // max(1, int(lengths.max(initial=1)))))
        ends = [(0, lane) for lane in range(n)]  # a heap: the shortest lane takes the next document
        lane, at = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
        for i, size in zip(order.tolist(), lengths[order].tolist(), strict=True):
            end, own = ends[0]
            lane[i], at[i] = own, end
            heapq.heapreplace(ends, (end + size, own))
        total = np.zeros(n, np.int64)
        np.add.at(total, lane, lengths)
        rank = np.empty(n, np.int64)
        rank[np.argsort(-total, kind="stable")] = np.arange(n)
        self.lane, self.at, self.total = rank[lane], at, np.sort(total)[::-1]

    def windows(self, codes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, ...]]:
        """(token before, document starts, target, place among the codes) by windows of ``size`` steps, only of lanes
        that go on; targets beyond a lane's end are -1."""
        n = len(self.total)
        begins = np.cumsum(self.total) - self.total
        place = np.empty(int(self.total.sum()), np.int64)  # lane after lane
        to = np.repeat(begins[self.lane] + self.at - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        place[to] = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(int(lengths.sum()))
        head = np.zeros(len(codes), bool)
        head[starts] = True
        for t in range(0, int(self.total[0]), size):
            live = n if t == 0 else int(np.searchsorted(-self.total, -t))  # those longer than t
            step = t + np.arange(size)[:, None]
            inside = step < self.total[:live]
            own = place[np.minimum(begins[:live] + step, begins[:live] + self.total[:live] - 1)]
            targets = np.where(inside, codes[own], -1)
            fresh = head[own]
            yield np.where(fresh, END, codes[np.maximum(own - 1, 0)]), fresh, targets, own


def score_codes(network: Network, codes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Log10 probability of the codes of each document (its end is its last code)."""
    starts = np.cumsum(lengths) - lengths
    found = np.zeros(len(codes), np.float64)
    state = None
    for before, fresh, targets, own in Lanes(lengths, LANES).windows(codes, starts, lengths, STEPS):
        state = np.zeros((before.shape[1], STATE), np.float32) if state is None else state[: before.shape[1]]
        made, _ = network.states(before, fresh, state)
        state = made[-1]
        used = targets.ravel() >= 0
        found[own.ravel()[used]] = network.log_likelihood(made.reshape(-1, STATE)[used], targets.ravel()[used])
    return np.add.reduceat(found, starts) / np.log(10) if len(starts) else np.zeros(0)


def train_codes(network: Network, adam: Adam, codes: np.ndarray, lengths: np.ndarray) -> float:
    """One pass over documents; returns the summed loss."""
    loss, state = 0.0, None
    whole, rest = lengths // PIECE, lengths % PIECE
    pieces = np.where(rest > 0, whole + 1, whole)
    last = np.cumsum(pieces) - 1
    lengths = np.full(int(pieces.sum()), PIECE)
    lengths[last[rest > 0]] = rest[rest > 0]
    starts = np.cumsum(lengths) - lengths
    for before, fresh, targets, _ in Lanes(lengths, TRAIN_LANES).windows(codes, starts, lengths, TRAIN_STEPS):
        state = np.zeros((before.shape[1], STATE), np.float32) if state is None else state[: before.shape[1]]
        g, state, own = network.gradients(before, fresh, targets, state)
        adam.step(g)
        loss += own
    return loss


def _packed(places: np.ndarray) -> bytes:
    """Numbers below 2^32 as their lower halves and then their upper ones, which are mostly zero."""
    return (places & 0xFFFF).astype("<u2").tobytes() + (places >> 16).astype("<u2").tobytes()


def _unpacked(data: bytes) -> np.ndarray:
    halves = np.frombuffer(data, "<u2").reshape(2, -1).astype(np.int64)
    return halves[0] | halves[1] << 16


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of up to ``CHUNK_BYTES`` of text, from one batch or several."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        for part in steps(batch, "text", CHUNK_BYTES):
            own = pc.sum(pc.binary_length(part.column("text"))).as_py() or 0
            if held and size + own > CHUNK_BYTES:
                yield pa.concat_batches(held)
                held, size = [], 0
            held.append(part)
            size += own
    if held:
        yield pa.concat_batches(held)


def _chunks(docs: DataFrame) -> DataFrame:
    """Stored chunks of (id, text, learn): documents with their numbers of words, distinct words with
    their training counts, and each word of the texts as a place among those."""
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("id", T.ArrayType(docs.schema["id"].dataType)),
            T.StructField("learn", T.ArrayType(T.BooleanType())),
            T.StructField("n_words", T.ArrayType(T.LongType())),
            T.StructField("word", T.ArrayType(T.StringType())),
            T.StructField("n", T.ArrayType(T.LongType())),
            T.StructField("distinct", T.LongType()),
            T.StructField("places", T.BinaryType()),
        ]
    )

    def chunk(rows: pa.RecordBatch, number: int) -> pa.RecordBatch:
        lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(rows.column("text"), "")))
        lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
        words = lists.flatten().dictionary_encode()
        codes = words.indices.to_numpy().astype(np.int64)
        doc = np.repeat(np.arange(rows.num_rows), pc.list_value_length(lists).to_numpy())
        empty = pc.index(words.dictionary, "").as_py()  # white space at an edge leaves an empty word
        if empty >= 0:
            real = codes != empty
            codes, doc = codes[real], doc[real]
        # The chunk's frequent words come first, so most places are small.
        many = np.bincount(codes, minlength=len(words.dictionary))
        order = np.argsort(-many, kind="stable")[: int((many > 0).sum())]
        rank = np.empty(len(many), np.int64)
        rank[order] = np.arange(len(order))
        codes, distinct = rank[codes], words.dictionary.take(pa.array(order))
        learn = rows.column("learn").to_numpy(zero_copy_only=False).astype(bool)
        n = np.bincount(codes[learn[doc]], minlength=len(distinct))
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                one(rows.column("id")),
                one(pa.array(learn)),
                one(pa.array(np.bincount(doc, minlength=rows.num_rows))),
                one(distinct),
                one(pa.array(n)),
                pa.array([len(distinct)], pa.int64()),
                pa.array([_packed(codes)], pa.binary()),
            ],
            names=schema.names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for part in _gathered(batches):
            yield chunk(part, number)
            number += 1
        part = None
        release()

    return cut_lineage(docs.mapInArrow(run, schema), "chunks")


@dataclass
class Corpus:
    """Stored codes of all documents, and the counts of the training ones."""

    coded: DataFrame
    layout: Layout
    train_tokens: int


def read_corpus(docs: DataFrame, head: int = HEAD) -> Corpus:
    """Counts over all training rows of (id, text, learn), and every document as codes with its base score."""
    chunks = _chunks(docs)
    pairs = chunks.select(F.explode(F.arrays_zip("word", "n")).alias("x")).select("x.word", "x.n")
    words = cut_lineage(pairs.where("n > 0").groupBy("word").agg(F.sum("n").alias("c")), "words")
    found = words.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("v")).first()
    ends = chunks.agg(F.coalesce(F.sum(F.size(F.filter("learn", lambda x: x))), F.lit(0)).alias("n")).first()["n"]
    total, distinct = found["n"] + ends, found["v"] + (ends > 0)
    top = words.orderBy(F.desc("c"), "word").limit(head).collect()  # as many as the parameter says
    layout = Layout(np.array([ends, *[r["c"] for r in top]], np.float64), int(found["n"] - sum(r["c"] for r in top)))
    codes = docs.sparkSession.createDataFrame([(r["word"], i + 1) for i, r in enumerate(top)], "word string, code int")
    known = words.join(F.broadcast(codes), "word", "left")
    of = chunks.select(F.col("chunk").alias("of"), F.posexplode("word").alias("at", "word"))
    back = of.join(known, "word").select("of", "at", "c", "code")
    tail, tail_total, tail_words = layout.tail, layout.tail_count, found["v"] - len(top)
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("id", T.ArrayType(docs.schema["id"].dataType)),
            T.StructField("learn", T.ArrayType(T.BooleanType())),
            T.StructField("n_tokens", T.ArrayType(T.LongType())),
            T.StructField("n_known", T.ArrayType(T.LongType())),
            T.StructField("base_score", T.ArrayType(T.DoubleType())),
            T.StructField("tail_score", T.ArrayType(T.DoubleType())),
            T.StructField("codes", T.BinaryType()),
        ]
    )

    def code(left: pa.Table, right: pa.Table) -> pa.Table:
        order = right.column("at").to_numpy()
        size = left.column("distinct")[0].as_py()
        count, number = np.zeros(size + 1, np.int64), np.full(size + 1, tail, np.int64)
        count[order] = right.column("c").to_numpy()
        number[order] = pc.fill_null(right.column("code"), tail).to_numpy()
        count[size], number[size] = ends, END  # the end of a document, as the place after the last
        places = _unpacked(left.column("places")[0].as_py())
        words_of = left.column("n_words").combine_chunks().flatten().to_numpy()
        places = np.insert(places, np.cumsum(words_of), size)
        lengths = words_of + 1
        starts = np.cumsum(lengths) - lengths
        c, own = count[places], number[places]
        base = np.log10((c + 1.0) / (total + distinct + 1.0))
        rest = np.where(own == tail, np.log10((c + 1.0) / (tail_total + tail_words + 1.0)), 0.0)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), pa.array(x))
        return pa.Table.from_arrays(
            [
                left.column("chunk"),
                left.column("id"),
                left.column("learn"),
                one(lengths),
                one(np.add.reduceat((c > 0).astype(np.int64), starts)),
                one(np.add.reduceat(base, starts)),
                one(np.add.reduceat(rest, starts)),
                pa.array([own.astype("<u2").tobytes()], pa.binary()),
            ],
            names=schema.names,
        )

    coded = chunks.drop("word", "n").groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(code, schema)
    return Corpus(cut_lineage(coded, "coded"), layout, int(total))


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Each chunk of coded rows with its codes and its documents' lengths."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = batch.slice(i, 1)
            codes = np.frombuffer(row.column("codes")[0].as_py(), "<u2").astype(np.int64)
            yield row, codes, row.column("n_tokens").flatten().to_numpy()


def _average(left: list[tuple[float, np.ndarray]]) -> tuple[float, np.ndarray]:
    weight = sum(w for w, _ in left)
    return weight, sum((x.astype(np.float64) * w for w, x in left), np.zeros(1)) / max(weight, 1e-300)


def _round(corpus: Corpus, parameters: dict[str, np.ndarray], number: int, rounds: int, rate: float) -> dict[str, np.ndarray]:
    """One round over its share of the training documents: copies trained by tasks, averaged."""
    layout = corpus.layout
    schema = "task long, block int, weight double, numbers binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = {k: v.copy() for k, v in parameters.items()}
        network, adam = Network(own, layout), Adam(own, rate)
        held: list[tuple[np.ndarray, np.ndarray]] = []
        waiting = seen = 0

        def work() -> None:
            nonlocal held, waiting, seen
            lengths = np.concatenate([x for _, x in held])
            train_codes(network, adam, np.concatenate([x for x, _ in held]), lengths)
            seen += waiting
            held, waiting = [], 0

        for row, codes, lengths in _documents(batches):
            chosen = row.column("learn").flatten().to_numpy(zero_copy_only=False) & (np.arange(len(lengths)) % rounds == number)
            if not chosen.any():
                continue
            held.append((codes[np.repeat(chosen, lengths)], lengths[chosen]))
            waiting += int(lengths[chosen].sum())
            if waiting >= WORK:
                work()
        if waiting:
            work()
        if seen:
            flat = np.concatenate([own[k].ravel() for k in NAMES])
            task = TaskContext.get().partitionId()
            parts = [flat[i : i + BLOCK].tobytes() for i in range(0, len(flat), BLOCK)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([task] * len(parts), pa.int64()), pa.array(range(len(parts)), pa.int32()), pa.array([float(seen)] * len(parts)), pa.array(parts, pa.binary())],
                names=["task", "block", "weight", "numbers"],
            )
        release()

    def combine(rows: pa.Table) -> pa.Table:
        each = zip(rows.column("weight").to_pylist(), rows.column("numbers").to_pylist(), rows.column("task").to_pylist(), strict=True)
        weight, mean = _average([(w, np.frombuffer(x, "<f4")) for w, x, _ in sorted(each, key=lambda e: e[2])])
        first = rows.slice(0, 1)
        return pa.Table.from_arrays([first.column("task"), first.column("block"), pa.array([weight]), pa.array([mean.astype("<f4").tobytes()], pa.binary())], names=["task", "block", "weight", "numbers"])

    source = corpus.coded.select("learn", "n_tokens", "codes")
    tasks = source.rdd.getNumPartitions()
    rows = source.mapInArrow(run, schema)
    while tasks > 1:
        rows = rows.withColumn("task", F.floor(F.col("task") / FAN)).groupBy("task", "block").applyInArrow(combine, schema)
        tasks = -(-tasks // FAN)
    found = {r["block"]: np.frombuffer(r["numbers"], "<f4") for r in rows.collect()}  # the model's size
    if not found:
        return parameters
    flat = np.concatenate([found[i] for i in range(len(found))])
    made, at = {}, 0
    for k in NAMES:
        made[k] = flat[at : at + parameters[k].size].reshape(parameters[k].shape).copy()
        at += parameters[k].size
    return made


def train(corpus: Corpus, rates: tuple[float, ...] = RATES) -> dict[str, np.ndarray]:
    """The parameters after one pass over all training documents, a round a rate."""
    parameters = start(corpus.layout)
    for i, rate in enumerate(rates):
        parameters = _round(corpus, parameters, i, len(rates), rate)
    return parameters


def score(docs: DataFrame, learn: Column, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """One row per document: the id, ``n_tokens`` (words and one end), ``n_known`` (those seen in training rows),
    ``train_tokens``, ``base_score`` (add-one unigram log10 probability) and ``score`` (the network's).

    Training rows are those where ``learn`` is true. A-Z is lowered; words are what ASCII
    white space leaves. NULL, empty and blank texts are an end alone. A very long text is
    one sequence scored from its first word to its end, window by window (about 40 bytes of memory a byte of text).
    Repeated rows count and are returned each; rows of one id are rows of their own, NULL ids too.
    Without training rows the counts are zero and the network is the uniform start. Words of equal
    count enter the head in code point order. An empty table gives no rows. Other columns are left out. Training depends on how the
    rows are dealt to tasks, so two runs over differently split tables differ a little in ``score``, in nothing else.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.coalesce(learn, F.lit(False)).alias("learn"))
    corpus = read_corpus(rows, head)
    parameters, layout = train(corpus), corpus.layout
    out = T.StructType(
        [
            T.StructField("id", rows.schema["id"].dataType),
            T.StructField("n_tokens", T.LongType()),
            T.StructField("n_known", T.LongType()),
            T.StructField("base_score", T.DoubleType()),
            T.StructField("score", T.DoubleType()),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(parameters, layout)
        held: list[tuple[pa.RecordBatch, np.ndarray, np.ndarray]] = []

        def scored() -> pa.RecordBatch:
            made = score_codes(network, np.concatenate([x for _, x, _ in held]), np.concatenate([x for _, _, x in held]))
            flat = {n: pa.concat_arrays([row.column(n).flatten() for row, _, _ in held]) for n in ("id", "n_tokens", "n_known", "base_score", "tail_score")}
            made += flat.pop("tail_score").to_numpy()
            return pa.RecordBatch.from_arrays([*flat.values(), pa.array(made)], names=out.names)

        for one in _documents(batches):
            held.append(one)
            if sum(len(x) for _, x, _ in held) >= WORK:
                yield scored()
                held = []
        if held:
            yield scored()
        held, one = [], None
        release()

    columns = ["id", "n_tokens", "n_known", "base_score", "tail_score", "codes"]
    found = corpus.coded.select(*columns).mapInArrow(run, out)
    return found.select(F.col("id").alias(id_col), "n_tokens", "n_known", F.lit(corpus.train_tokens).cast("long").alias("train_tokens"), "base_score", "score")
