"""Exact BPE encoding by backtracking over token matches, and decoding by an offset table.

Encoding: an Aho-Corasick automaton finds every vocabulary token in the word.
From the left the longest token is taken whose pair with the token before it is
*compatible* (merging both strings together gives exactly these two tokens).
Where no token fits, the last one is given up for its next shorter match; a
position from which the rest can't be reached is never entered again, so the
work is linear in the matches. A chain of compatible pairs is the one sequence
that the merges in rank order give.

Decoding: all token strings lie in one byte buffer; an offset table says where
each id's string starts, and a text is one gather over that buffer.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from stationflow.llm.common import map_texts
from stationflow.llm.tokens import BEYOND_LATIN, SPLIT, TOKEN_STEP, TextEncoder, byte_symbols, encoder

#: Stands for the end of a word in the automaton's alphabet (no byte symbol maps to it).
END = "\x00"
NEVER = 1 << 60


class BacktrackingBPE:
    """Exact merges of a BPE vocabulary with a word-end suffix, by token matches."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model["type"] != "BPE" or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
            raise ValueError("a plain BPE vocabulary is needed")
        self.suffix = model.get("end_of_word_suffix") or ""
        vocab: dict[str, int] = model["vocab"]
        n = max(vocab.values()) + 1
        self.left, self.right, self.made_at = [-1] * n, [-1] * n, [-1] * n
        self.rank: dict[tuple[int, int], int] = {}
        self.merged: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, (list, tuple)) else pair.split(" ")
            whole, x, y = vocab[a + b], vocab[a], vocab[b]
            self.rank[x, y] = rank
            if self.made_at[whole] >= 0:
                raise ValueError(f"two merges make {a + b!r}")
            self.left[whole], self.right[whole], self.made_at[whole] = x, y, rank
        self.pairs: dict[tuple[int, int], bool] = {}
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY)
        for token, i in vocab.items():
            # A token that its own merges don't give back can never appear.
            if self.made_at[i] < 0 or self.compatible(self.left[i], self.right[i], self.made_at[i]):
                key = token[: -len(self.suffix)] + END if self.suffix and token.endswith(self.suffix) else token
                self.automaton.add_word(key, (len(key), i))
        self.automaton.make_automaton()

    def _spine(self, token: int, side: list[int]) -> list[int]:
        """The tokens at one edge of ``token``, from its single symbol up to itself."""
        chain = [token]
        while self.made_at[chain[-1]] >= 0:
            chain.append(side[chain[-1]])
        return chain[::-1]

    def compatible(self, x: int, y: int, until: int = NEVER) -> bool:
        """Whether no merge before rank ``until`` crosses the border between ``x`` and ``y``.

        Both sides grow towards the border by their own merges, in rank order. At
        each state the two tokens that touch the border could merge; they do if
        that merge comes before the next merge of either side (of two equal
        merges the left one comes first).
        """
        known = self.pairs.get((x, y)) if until == NEVER else None
        if known is not None:
            return known
        a, b = self._spine(x, self.right), self._spine(y, self.left)
        i = j = 0
        good = True
        while True:
            next_a = self.made_at[a[i + 1]] if i + 1 < len(a) else NEVER
            next_b = self.made_at[b[j + 1]] if j + 1 < len(b) else NEVER
            crossing = self.rank.get((a[i], b[j]), NEVER)
            if crossing < until and crossing < next_a and crossing <= next_b:
                good = False
                break
            if next_a == next_b == NEVER:
                break
            if next_a <= next_b:
                i += 1
            else:
                j += 1
        if until == NEVER:
            if len(self.pairs) >= 2_000_000:
                self.pairs.clear()
            self.pairs[x, y] = good
        return good

    def encode(self, symbols: str) -> list[int]:
        """Token ids of one pre-token, given as its byte symbols (empty: none)."""
        if not symbols:
            return []
        text = symbols + END if self.suffix else symbols
        size = len(text)
        at: list[list[tuple[int, int]]] = [[] for _ in range(size)]
        for end, found in self.automaton.iter(text):
            at[end + 1 - found[0]].append(found)  # ends ascend, so the longest match of a start comes last
        ids: list[int] = []
        tried: list[int] = []  # matches of each taken token's start that are still untried
        starts: list[int] = []
        dead = bytearray(size + 1)
        pos, left = 0, len(at[0])
        while pos < size:
            here = at[pos]
            while left:
                left -= 1
                length, token = here[left]
                end = pos + length
                if not dead[end] and (not ids or self.compatible(ids[-1], token)):
                    ids.append(token)
                    tried.append(left)
                    starts.append(pos)
                    pos = end
                    left = len(at[pos]) if pos < size else 0
                    break
            else:
                if not ids:
                    raise ValueError(f"the vocabulary can't spell {symbols!r}")
                dead[pos] = 1
                ids.pop()
                pos, left = starts.pop(), tried.pop()
        return ids


def chunk_encoder(path: str) -> Callable[[TextEncoder], Callable[[list[str]], list[list[int]]]]:
    """A word encoder for ``TextEncoder`` that merges by backtracking. Special
    tokens and texts beyond Latin letters are cut by the library's own rules;
    every pre-token is encoded here."""

    def make(texts: TextEncoder) -> Callable[[list[str]], list[list[int]]]:
        bpe = BacktrackingBPE(path)
        symbol = byte_symbols()
        pre_tokens = regex.compile(SPLIT.replace("\\s", "\\p{White_Space}"))
        specials = regex.compile("(" + "|".join(map(regex.escape, sorted(texts.special, key=len, reverse=True))) + ")") if texts.special else None
        library = texts.library
        known: dict[str, list[int]] = {}

        def plain(chunk: str) -> list[int]:
            ids: list[int] = []
            if BEYOND_LATIN.search(chunk):
                pieces = [p for p, _ in library.pre_tokenizer.pre_tokenize_str(library.normalizer.normalize_str(chunk))]
            else:
                pieces = ["".join([symbol[b] for b in p.encode("utf-8")]) for p in pre_tokens.findall(chunk.lower())]
            for piece in pieces:
                found = known.get(piece)
                if found is None:
                    found = bpe.encode(piece)
                    if len(known) >= 100_000:
                        known.clear()
                    if len(piece) < 200:
                        known[piece] = found
                ids += found
            return ids

        def encode(chunk: str) -> list[int]:
            if specials is None or "<" not in chunk:
                return plain(chunk)
            ids: list[int] = []
            for part in specials.split(chunk):
                ids += [texts.special[part]] if part in texts.special else plain(part)
            return ids

        return lambda chunks: [encode(c) for c in chunks]

    return make


class OffsetTable:
    """Strings by id in one buffer; ``join`` gathers many, with ``sep`` between."""

    def __init__(self, strings: Iterable[bytes], sep: bytes = b" "):
        parts = [s + sep for s in strings]
        self.sep = len(sep)
        self.buffer = np.frombuffer(b"".join(parts), np.uint8)
        self.lengths = np.fromiter(map(len, parts), np.int64, len(parts))
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])

    def join(self, ids: np.ndarray, step: int = 500_000) -> Iterable[bytes]:
        """Pieces of the joined string, ``step`` ids at a time."""
        for first in range(0, len(ids), step):
            part = ids[first : first + step]
            lengths = self.lengths[part]
            ends = np.cumsum(lengths)
            where = np.repeat(self.starts[part] - (ends - lengths), lengths) + np.arange(ends[-1])
            made = self.buffer[where]
            yield made[: len(made) - self.sep].tobytes() if first + step >= len(ids) else made.tobytes()

    @classmethod
    def of_vocabulary(cls, texts: TextEncoder) -> OffsetTable:
        """Every id's token string, as decoding without a decoder joins them (a blank between)."""
        strings = [b""] * (max(texts.library.get_vocab().values()) + 1)
        for token, i in texts.library.get_vocab().items():
            strings[i] = token.encode("utf-8")
        return cls(strings)


def encode_decode(docs: DataFrame, path: str, text_col: str = "text", digests_only: bool = False) -> DataFrame:
    """``docs`` with ``n_tokens``, ``ids_sha256`` and ``decoded_sha256`` and, unless
    ``digests_only`` (which also drops the text), ``ids`` (array<int>) and ``decoded``.

    ``ids`` is what the tokenizers library gives for the whole text without added
    special tokens, ``decoded`` what it decodes them to, special tokens included.
    NULL and empty texts have no ids and decode to the empty text. Rows are
    independent, so ties and repeated rows just repeat. Columns of these names
    are replaced; others stay. A very long text is encoded whole, its digests piece by
    piece; an empty table gives no rows. A vocabulary file that names a decoder is refused.
    """
    with open(path, encoding="utf-8") as f:
        if json.load(f).get("decoder") is not None:
            raise ValueError("the offset table joins tokens with a blank; this vocabulary's decoder does something else")
    numbers = 1 << 17
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    if not digests_only:
        fields += [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]

    def make() -> Callable[[pa.Array], list[pa.Array]]:
        texts = encoder(path, "backtracking", chunk_encoder(path))
        tokens = OffsetTable.of_vocabulary(texts)
        decimal = OffsetTable(str(i).encode() for i in range(max(numbers, len(tokens.lengths))))

        def work(rows: pa.Array) -> list[pa.Array]:
            ids, lengths = texts.encode(rows)
            ends = np.cumsum(lengths)
            digests: list[list[str]] = [[], []]
            decoded: list[str] = []
            for end, n in zip(ends.tolist(), lengths.tolist(), strict=True):
                own = ids[end - n : end]
                for table, out in ((decimal, digests[0]), (tokens, digests[1])):
                    sha = hashlib.sha256()
                    for piece in table.join(own):
                        sha.update(piece)
                    out.append(sha.hexdigest())
                if not digests_only:
                    decoded.append(b"".join(tokens.join(own)).decode("utf-8"))
            made = [pa.array(lengths, pa.int64()), pa.array(digests[0], pa.string()), pa.array(digests[1], pa.string())]
            if not digests_only:
                offsets = np.concatenate([[0], ends]).astype(np.int32)
                made += [pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids, pa.int32())), pa.array(decoded, pa.string())]
            return made

        return work

    return map_texts(docs, text_col, fields, make, digests_only, TOKEN_STEP)
