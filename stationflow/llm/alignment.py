"""Alignment of two tokenizers by products of sparse incidence matrices.

A document's tokens are rows of a token-byte incidence matrix in CSR form, built by
hand from the lengths of the tokens: A for the first vocabulary, B for the second.
The rows of A·Bᵀ, made by Gustavson's method (for each entry of a row of A the
matching row of Bᵀ, equal columns added up), are the overlap links: entry (i, j) is the
number of bytes that A's token i and B's token j share. Byte offsets where tokens of
both end cut the tokens into groups; the product of the two token-group incidence
matrices links the tokens that share a group.

An id pair's count is how many links of the corpus hold it. Documents are worked on
in chunks of bounded size, each one row of a stored table. Only a chunk's distinct
pairs are shuffled, once to be counted and once to bring the counts back.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from stationflow.llm.common import release, steps
from stationflow.llm.tokens import ChunkTable, byte_symbols
from stationflow.session import cut_lineage

#: Bytes of text of a chunk (a longer single text makes a chunk of its own).
CHUNK_BYTES = 4_000_000
SPACE = "▁"
#: How a byte-level vocabulary that ranks alone describe cuts a text into words.
WORDS = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Segments longer than this go through the library: matching a long run costs more than its length.
LONGEST = 1_000
#: Texts that can't be cut at each space: without the space some segment is empty, or the model takes a letter for a space.
UNCUT = "^ |  | $|" + SPACE
#: How chunks are stored: each is a row group of its own. The writer holds a row group, and the reader all rows of
#: one at once, so both hold one chunk and not all chunks of a task.
STORED = {"parquet.block.row.count.limit": "1"}
NUMBERS = ["n_a", "n_b", "n_groups", "n_links", "n_shared"]


class CSR:
    """A sparse matrix by rows: row i has columns ``indices[starts[i]:starts[i + 1]]``; ``width`` columns."""

    def __init__(self, starts: np.ndarray, indices: np.ndarray, width: int):
        self.starts, self.indices, self.width = starts, indices, width

    @classmethod
    def of_runs(cls, lengths: np.ndarray) -> CSR:
        """Rows of consecutive columns: token i covers the next ``lengths[i]`` bytes."""
        starts = np.concatenate([[0], np.cumsum(lengths)])
        return cls(starts, np.arange(starts[-1]), int(starts[-1]))

    @classmethod
    def of_labels(cls, labels: np.ndarray, width: int) -> CSR:
        """One column a row."""
        return cls(np.arange(len(labels) + 1), labels, width)

    def transposed(self) -> CSR:
        rows = np.repeat(np.arange(len(self.starts) - 1), np.diff(self.starts))
        order = np.argsort(self.indices, kind="stable")
        counts = np.bincount(self.indices, minlength=self.width)
        return CSR(np.concatenate([[0], np.cumsum(counts)]), rows[order], len(self.starts) - 1)

    def row_sizes(self, other: CSR) -> np.ndarray:
        """Symbolic half of the product: products that each row of ``self · other`` adds up."""
        sizes = np.concatenate([[0], np.cumsum(np.diff(other.starts)[self.indices])])
        return sizes[self.starts[1:]] - sizes[self.starts[:-1]]

    def times(self, other: CSR, step: int = 4_000_000) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Entries (row, column, value) of ``self · other`` by rows, some rows at a time:
        at most ``step`` products at once, or one row."""
        ends = np.cumsum(self.row_sizes(other))
        first, rows = 0, len(self.starts) - 1
        while first < rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + step, "right")))
            middle = self.indices[self.starts[first] : self.starts[last]]
            row = np.repeat(np.arange(first, last), np.diff(self.starts[first : last + 1]))
            many = other.starts[middle + 1] - other.starts[middle]
            stop = np.cumsum(many)
            at = np.repeat(other.starts[middle] - stop + many, many) + np.arange(stop[-1] if len(stop) else 0)
            row, column = np.repeat(row, many), other.indices[at]
            if len(row):
                # Equal columns of a row are added up; runs of bytes meet them in order, others are sorted.
                key = row * other.width + column
                if (key[1:] < key[:-1]).any():
                    key = np.sort(key)
                new = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
                yield key[new] // other.width, key[new] % other.width, np.diff(np.append(new, len(key)))
            first = last


class Strings:
    """Byte strings by id in one buffer."""

    def __init__(self, strings: list[bytes]):
        self.lengths = np.fromiter(map(len, strings), np.int64, len(strings))
        self.buffer = np.frombuffer(b"".join(strings), np.uint8)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def gather(self, ids: np.ndarray) -> np.ndarray:
        many = self.lengths[ids]
        stop = np.cumsum(many)
        return self.buffer[np.repeat(self.starts[ids] - stop + many, many) + np.arange(stop[-1] if len(stop) else 0)]


def by_ranks(path: str) -> tiktoken.Encoding | None:
    """A faster encoder for a byte-level vocabulary file whose ids follow its merges; None for any other file.

    It merges the adjacent pair whose joint bytes have the lowest id. The library merges the
    pair that stands first in the list; that is the same where the list is in id order and
    no token is made by two merges."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, level = spec["model"], spec["pre_tokenizer"] or {}
    plain = (
        model["type"] == "BPE"
        and not any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        and spec.get("normalizer") is None
        and spec.get("post_processor") is None
        and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, True)
    )
    if not plain:
        return None
    byte = {s: i for i, s in enumerate(byte_symbols())}
    made = [model["vocab"]["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    symbols = [model["vocab"].get(s, -1) for s in byte]
    if min(symbols) < 0 or made != sorted(set(made)) or made[0] < max(symbols):
        return None
    used = {*made, *symbols}
    ranks = {bytes(byte[c] for c in token): i for token, i in model["vocab"].items() if i in used}
    return tiktoken.Encoding("ranks", pat_str=WORDS, mergeable_ranks=ranks, special_tokens={})


class Segments(ChunkTable):
    """Ids of texts from those of their segments between single spaces, each distinct one encoded once."""

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        return pc.split_pattern(texts, " ")

    def _keys(self, chunks: list[str], texts: pa.Array) -> list[str]:
        return chunks


class Pair:
    """Both tokenizers, with every id's bytes."""

    def __init__(self, path_a: str, path_b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        self.a = Tokenizer.from_file(path_a)
        self.a.no_truncation()
        self.a.no_padding()
        self.a.encode_special_tokens = True
        self.ranks = by_ranks(path_a)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        byte = {s: i for i, s in enumerate(byte_symbols())}
        names = self.a.get_vocab()
        self.n_a, self.n_b = max(names.values()) + 1, self.b.get_piece_size()
        strings = [b""] * self.n_a
        for name, i in names.items():
            strings[i] = bytes(byte[c] for c in name) if all(c in byte for c in name) else name.encode("utf-8")
        self.bytes_a = Strings(strings)
        pieces = [self.b.id_to_piece(i) for i in range(self.n_b)]
        self.bytes_b = Strings([bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode("utf-8") for i, p in enumerate(pieces)])
        self.cut = self.ranks is not None and not any(SPACE in p.lstrip(SPACE) for p in pieces) and self.b.decode(self.b.encode(" a  b\u00a0c")) == " a  b\u00a0c"
        self.words_a, self.words_b = Segments(self._ids_a), Segments(self._ids_b)
        self.decimal = Strings([str(i).encode() + end for end in (b",", b"|", b";") for i in range(max(self.n_a, self.n_b))])

    def ids(self, texts: pa.Array) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Both tokenizers' ids of texts; no ids for NULL and empty ones.

        No word of the first crosses a space that follows another letter, and no piece of the second
        holds one, so a text is cut at single spaces and its segments are encoded with a space
        before each (the second adds its own). Other texts are encoded as a whole."""
        whole = pc.fill_null(pc.match_substring_regex(texts, UNCUT), False) if self.cut else pa.array(np.ones(len(texts), bool))
        cut = pc.if_else(whole, "", texts)
        found = []
        for table, encode in ((self.words_a, self._ids_a), (self.words_b, self._ids_b)):
            ids, lengths = table.encode(cut)
            parts = np.split(ids.astype(np.int64), np.cumsum(lengths)[:-1])
            for i in np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
                parts[i] = np.array(encode([texts[i].as_py() or ""])[0], np.int64)
            found.append(parts)
        return found[0], found[1]

    def _ids_a(self, texts: list[str]) -> list[list[int]]:
        library = lambda t: self.a.encode(" " + t, add_special_tokens=False).ids
        if self.ranks is None:
            return [library(t) if t else [] for t in texts]
        fast = self.ranks.encode_ordinary
        return [(fast(" " + t) if len(t) <= LONGEST else library(t)) if t else [] for t in texts]

    def _ids_b(self, texts: list[str]) -> list[list[int]]:
        return self.b.encode(texts, num_threads=1)


@lru_cache(maxsize=1)
def _pair(path_a: str, path_b: str) -> Pair:
    return Pair(path_a, path_b)


class Aligned:
    """The alignment of one text: ids, byte lengths, links and groups; all empty where
    the text is NULL or empty, or one side's bytes aren't those of a space and the text."""

    def __init__(self, pair: Pair, text: str | None, a: np.ndarray, b: np.ndarray):
        self.pair, self.a, self.b = pair, a, b
        whole = np.frombuffer((" " + text).encode("utf-8"), np.uint8) if text else np.zeros(0, np.uint8)
        for ids, strings in ((self.a, pair.bytes_a), (self.b, pair.bytes_b)):
            if int(strings.lengths[ids].sum()) != len(whole) or not np.array_equal(strings.gather(ids), whole):
                self.a = self.b = np.zeros(0, np.int64)
                break
        len_a, len_b = pair.bytes_a.lengths[self.a], pair.bytes_b.lengths[self.b]
        self.rows_a, self.rows_b = CSR.of_runs(len_a), CSR.of_runs(len_b)
        ends_a, ends_b = np.cumsum(len_a), np.cumsum(len_b)
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)  # tokens aren't empty, so ends differ
        self.n_groups = len(cuts)
        self.group_a, self.group_b = np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b)

    def links(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of A's and of B's tokens that overlap, and the bytes that they share."""
        parts = list(self.rows_a.times(self.rows_b.transposed()))
        return tuple(np.concatenate([np.zeros(0, np.int64), *(p[i] for p in parts)]) for i in range(3))

    def _groups(self) -> tuple[CSR, CSR]:
        return CSR.of_labels(self.group_a, self.n_groups), CSR.of_labels(self.group_b, self.n_groups).transposed()

    def n_shared(self) -> int:
        """Links between tokens that share a group, from the product's symbolic half (a token has one group, so no two products add up)."""
        a, b = self._groups()
        return int(a.row_sizes(b).sum())

    def shared(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Those links (places of A's and B's tokens, groups shared: 1), some rows at a time."""
        a, b = self._groups()
        return a.times(b)

    def groups_digest(self) -> str:
        """SHA-256 of the groups as ``a1,a2|b1;a3|b2,b3``; without tokens the empty text."""
        if not len(self.a):
            return ""
        size = len(self.pair.decimal.lengths) // 3
        # A's token stands behind B's tokens of earlier groups, B's behind A's of its group and earlier ones.
        text = np.empty(len(self.a) + len(self.b), np.int64)
        last_a, last_b = np.append(self.group_a[1:] != self.group_a[:-1], True), np.append(self.group_b[1:] != self.group_b[:-1], True)
        text[np.arange(len(self.a)) + np.searchsorted(self.group_b, self.group_a, "left")] = self.a + size * last_a
        text[np.arange(len(self.b)) + np.searchsorted(self.group_a, self.group_b, "right")] = self.b + 2 * size * last_b
        return hashlib.sha256(self.pair.decimal.gather(text)[:-1].tobytes()).hexdigest()


def _lists(arrays: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """One list (a chunk has one row) of all the arrays' numbers."""
    values = np.concatenate([np.zeros(0, np.int64), *arrays])
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), pa.array(values).cast(kind))


def _chunks(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Stored rows of aligned chunks of (id, text): the documents' columns, the chunk's distinct pairs with
    their links, and each document's distinct pairs as places among those."""
    id_type = docs.schema["id"].dataType
    schema = T.StructType(
        [
            T.StructField("chunk", T.LongType()),
            T.StructField("id", T.ArrayType(id_type)),
            *[T.StructField(n, T.ArrayType(T.LongType())) for n in NUMBERS],
            T.StructField("groups_sha256", T.ArrayType(T.StringType())),
            T.StructField("pair", T.ArrayType(T.LongType())),
            T.StructField("links", T.ArrayType(T.LongType())),
            T.StructField("doc_pairs", T.ArrayType(T.IntegerType())),
            T.StructField("place", T.ArrayType(T.IntegerType())),
            T.StructField("times", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair = _pair(path_a, path_b)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for part in steps(batch, "text", CHUNK_BYTES):
                yield chunk(pair, part, number)
                number += 1
        batch = part = None
        release()

    def chunk(pair: Pair, rows: pa.RecordBatch, number: int) -> pa.RecordBatch:
        texts = rows.column("text").to_pylist()
        ids = pair.ids(rows.column("text"))
        columns: dict[str, list[int]] = {n: [] for n in NUMBERS}
        digests: list[str] = []
        own: list[np.ndarray] = []
        times: list[np.ndarray] = []
        for text, a, b in zip(texts, *ids, strict=True):
            found = Aligned(pair, text, a, b)
            left, right, _ = found.links()
            pairs, n = np.unique(found.a[left] * pair.n_b + found.b[right], return_counts=True)
            own.append(pairs)
            times.append(n)
            digests.append(found.groups_digest())
            for name, value in zip(NUMBERS, (len(found.a), len(found.b), found.n_groups, len(left), found.n_shared()), strict=True):
                columns[name].append(value)
        every = np.concatenate([np.zeros(0, np.int64), *own])
        distinct, place = np.unique(every, return_inverse=True)
        links = np.bincount(place, np.concatenate([np.zeros(0, np.int64), *times]), len(distinct)).astype(np.int64)
        one = pa.array([0, rows.num_rows], pa.int32())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.ListArray.from_arrays(one, rows.column("id")),
                *[pa.ListArray.from_arrays(one, pa.array(columns[n], pa.int64())) for n in NUMBERS],
                pa.ListArray.from_arrays(one, pa.array(digests, pa.string())),
                _lists([distinct], pa.int64()),
                _lists([links], pa.int64()),
                pa.ListArray.from_arrays(one, pa.array([len(x) for x in own], pa.int32())),
                _lists([place], pa.int32()),
                _lists(times, pa.int32()),
            ],
            names=schema.names,
        )

    return cut_lineage(docs.mapInArrow(run, schema), "aligned", **STORED)


def pair_counts(chunks: DataFrame, n_b: int) -> DataFrame:
    """(pair, links, best): every id pair's links in the corpus, and whether no pair of its B id has more.

    A chunk's links are added up before they are shuffled, and an A id has a row a pair, so a
    B id has as many rows as the first vocabulary has ids at most."""
    rows = chunks.select(F.explode(F.arrays_zip("pair", "links")).alias("x")).select("x.pair", "x.links")
    counts = cut_lineage(rows.groupBy("pair").agg(F.sum("links").alias("links")), "pairs").withColumn("b", F.col("pair") % n_b)
    most = counts.groupBy("b").agg(F.max("links").alias("most"))
    return counts.join(most, "b").select("pair", "links", (F.col("links") == F.col("most")).alias("best"))


def align(docs: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: the id, ``n_a`` and ``n_b`` (tokens), ``n_groups``, ``n_links`` (overlapping
    token pairs), ``n_shared`` (token pairs of one group), ``n_best`` (links whose pair's count in all
    documents is the highest of its B id, ties included), ``count_sum`` (those counts over the
    document's links) and ``groups_sha256``.

    ``path_a`` is a byte-level vocabulary of the tokenizers library, given a space and the text;
    ``path_b`` a sentencepiece model that adds that space. Texts that are NULL or empty, or that one side doesn't
    give back byte for byte, have zeros and an empty ``groups_sha256``; they take no part in the counts.
    A very long text is a chunk of its own: about 100 bytes of memory a byte of text. Repeated rows
    count and are returned each; rows of one id are rows of their own, NULL ids too. An empty table gives no
    rows. Other columns are left out, whatever their names.
    """
    docs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    n_b = sentencepiece.SentencePieceProcessor(model_file=path_b).get_piece_size()
    chunks = _chunks(docs, path_a, path_b)
    of = chunks.select(F.col("chunk").alias("of"), F.posexplode("pair").alias("at", "pair"))
    back = of.join(pair_counts(chunks, n_b), "pair").select("of", "at", "links", "best")
    rows = chunks.drop("pair", "links")
    names = ["id", *NUMBERS, "groups_sha256", "n_best", "count_sum"]
    schema = T.StructType([T.StructField(n, T.StringType() if n == "groups_sha256" else T.LongType()) for n in names])
    schema["id"].dataType = docs.schema["id"].dataType

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        order = right.column("at").to_numpy()
        links, best = np.zeros(len(order), np.int64), np.zeros(len(order), bool)
        links[order] = right.column("links").to_numpy()
        best[order] = right.column("best").to_numpy()
        flat = {n: left.column(n).combine_chunks().flatten() for n in left.column_names if n != "chunk"}
        place, times = flat["place"].to_numpy(), flat["times"].to_numpy().astype(np.int64)
        ends = np.cumsum(flat["doc_pairs"].to_numpy())
        total = lambda x: np.diff(np.concatenate([[0], np.cumsum(x)])[np.concatenate([[0], ends])])
        made = {"n_best": pa.array(total(times * best[place])), "count_sum": pa.array(total(times * links[place]))}
        return pa.Table.from_arrays([(flat | made)[n] for n in names], names=names)

    found = rows.groupBy("chunk").cogroup(back.groupBy("of")).applyInArrow(finish, schema)
    return found.select(F.col("id").alias(id_col), *names[1:])
