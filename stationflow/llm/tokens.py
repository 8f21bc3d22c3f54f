"""Token ids of whole texts for a vocabulary file of the tokenizers library.

``TextEncoder`` gives what ``Tokenizer.encode(text, add_special_tokens=False)``
gives. Where the vocabulary's rules drop white space and never look across it,
a text is cut at white space, every distinct chunk is encoded once (kept in a
table of bounded size) and the ids of a step of texts are gathered with numpy. Chunks
of plain Latin letters are merged by ranks where the vocabulary allows it, others by the library.
A vocabulary with other rules is encoded text by text with the library.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
import tiktoken
from tokenizers import Tokenizer, normalizers

#: The rules of the vocabulary file under which a text may be cut at white space.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
#: Chunks kept; a full table is started anew, so memory stays bounded whatever the corpus holds.
MAX_CHUNKS = 200_000
#: Bytes of text that one step of a token operator works on.
TOKEN_STEP = 4_000_000
#: After a chunk longer than this the table is started anew.
LONGEST_KEPT = 5_000
#: Texts with a letter beyond these are lowered by the library, chunk by chunk.
BEYOND_LATIN = regex.compile("[^\\x00-\\u02ff]")
#: Put between chunks that one call encodes (it is beyond Latin letters here, so chunks that hold it go alone), and how many those are.
BORDER = "\x00"
AT_ONCE = 100
RANKED_AT_ONCE = 10_000
WHITE = regex.compile("\\p{White_Space}+")

Words = Callable[[list[str]], list[list[int]]]


def cut_at_white_space(spec: dict) -> bool:
    """Whether this vocabulary file's rules drop white space and match nothing across it."""
    try:
        split, levels = spec["pre_tokenizer"]["pretokenizers"]
        return (
            spec["normalizer"]["normalizers"] == NORMALIZERS
            and split["pattern"] == {"Regex": SPLIT}
            and (split["behavior"], split["invert"]) == ("Removed", True)
            and (levels["type"], levels["add_prefix_space"], levels["use_regex"]) == ("ByteLevel", False, False)
            and spec.get("post_processor") is None
            and not any(
                t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"] or WHITE.search(t["content"])
                for t in spec["added_tokens"]
            )
        )
    except (KeyError, TypeError, ValueError):
        return False


class _Numbers(dict):
    """Numbers keys in the order in which they are first asked for."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        self.new.append(key)
        return n


class ChunkTable:
    """Numbers (ids, features) of texts that are a function of their chunks between
    white space: each distinct chunk's are found once and gathered for all texts."""

    def __init__(self, words: Words, most: int | None = None):
        self.words, self.most = words, most or MAX_CHUNKS
        self._clear()

    def _clear(self) -> None:
        self.numbers = _Numbers()
        self.numbers.new = []
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int32)
        self.seen = np.zeros(0, np.int64)

    def _forget(self) -> None:
        """Keep the chunks of the most steps, half a table at most."""
        least = 2
        while (self.seen >= least).sum() > self.most // 2:
            least *= 2
        kept = self.seen >= least
        chunks = [c for c, k in zip(self.numbers, kept.tolist(), strict=True) if k]
        starts, lengths, ids = self.starts[kept], self.lengths[kept], self.ids
        self._clear()
        self.numbers.update(zip(chunks, range(len(chunks)), strict=True))
        ends = np.cumsum(lengths)
        self.ids = ids[np.repeat(starts - (ends - lengths), lengths) + np.arange(int(lengths.sum()))]
        self.starts, self.lengths, self.seen = ends - lengths, lengths, np.zeros(len(chunks), np.int64)

    def _found(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        found = self.words(chunks)
        lengths = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter(chain.from_iterable(found), np.int32, int(lengths.sum())), lengths

    def _learn(self) -> None:
        new, self.numbers.new = self.numbers.new, []
        ids, lengths = self._found(new)
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths = np.concatenate([self.lengths, lengths])
        self.ids = np.concatenate([self.ids, ids])
        self.seen = np.concatenate([self.seen, np.zeros(len(new), np.int64)])

    def _keys(self, chunks: list[str], texts: pa.Array) -> list[str]:
        """The chunks of ``texts``, lowered."""
        return [c.lower() for c in chunks]

    def _cut(self, texts: pa.Array) -> pa.ListArray:
        """Each text's chunks."""
        if pc.any(pc.match_substring_regex(texts, "[\x1c-\x1f]")).as_py():
            return pa.array([[c for c in WHITE.split(t) if c] for t in texts.to_pylist()], pa.list_(pa.string()))
        parts = pc.utf8_split_whitespace(texts)
        return parts.combine_chunks() if isinstance(parts, pa.ChunkedArray) else parts

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All numbers of the texts (NULL: none) one after another, and how many each text has."""
        texts = pc.fill_null(texts, "")
        lists = self._cut(texts)
        ends = lists.offsets.to_numpy()
        words = lists.values.slice(int(ends[0]), int(ends[-1] - ends[0])).dictionary_encode()
        ends = ends - ends[0]
        codes, distinct = words.indices.to_numpy(), self._keys(words.dictionary.to_numpy(zero_copy_only=False).tolist(), texts)
        used = pc.not_equal(words.dictionary, "").to_numpy(zero_copy_only=False)  # white space at an edge leaves empty chunks
        if len(self.numbers) > self.most:
            self._forget()
        numbers = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        if self.numbers.new:
            self._learn()
        self.seen[numbers] += 1
        lengths = np.where(used, self.lengths[numbers], 0)[codes]
        after = np.concatenate([[0], np.cumsum(lengths)])
        # Where each id stands in the table: its chunk's place, moved by how far the chunk has come.
        first = (self.starts[numbers][codes] - after[:-1]).astype(np.int32)
        ids = self.ids[np.repeat(first, lengths) + np.arange(after[-1], dtype=np.int32)]
        if (pc.max(pc.binary_length(words.dictionary)).as_py() or 0) > LONGEST_KEPT:
            self._clear()
        return ids, after[ends[1:]] - after[ends[:-1]]


#: In the texts that are merged by ranks: ends each word, and stands between chunks (neither is in a plain chunk).
WORD_END, CHUNK_END = "\x00", "\n"
PIECES = regex.compile(SPLIT.replace("\\s", "\\p{White_Space}"))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: printable Latin-1 bytes
    stand for themselves, the others for the code points from 256 on, in order."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def ranks_of_words(spec: dict) -> tiktoken.Encoding | None:
    """A faster merger for a vocabulary with word ends whose ids follow its merges; None for any other.

    A word is its bytes and ``WORD_END``. Tokens that end a word end with that byte, so the
    first merge of a word is that of its last byte, as in the library. Then the adjacent
    pair whose joint bytes have the lowest id is merged; the library merges the pair that stands first in
    the list, which is the same where the list is in id order and no token is made by two merges."""
    model = spec["model"]
    suffix = model.get("end_of_word_suffix")
    if model["type"] != "BPE" or not suffix or any(model.get(x) for x in ("dropout", "unk_token", "continuing_subword_prefix", "fuse_unk", "byte_fallback", "ignore_merges")):
        return None
    vocab, symbols = model["vocab"], byte_symbols()
    made = [vocab["".join(m if isinstance(m, list) else m.split(" "))] for m in model["merges"]]
    single = [vocab.get(s, -1) for s in symbols] + [vocab.get(s + suffix, -1) for s in symbols]
    if min(single) < 0 or made != sorted(set(made)) or made[0] < max(single):
        return None
    byte, used = {s: i for i, s in enumerate(symbols)}, {*made, *single}
    ranks = {}
    for token, i in vocab.items():
        if i in used:
            ends = token.endswith(suffix)
            ranks[bytes(byte[c] for c in (token[: -len(suffix)] if ends else token)) + WORD_END.encode() * ends] = i
    if len(ranks) != len(used):
        return None
    return tiktoken.Encoding("words", pat_str=f"[^{WORD_END}{CHUNK_END}]+{WORD_END}|{CHUNK_END}", mergeable_ranks=ranks, special_tokens={})


class TextEncoder(ChunkTable):
    """Ids of texts; ``words`` may replace the library for the chunks it is given."""

    def __init__(self, path: str, words: Callable[[TextEncoder], Words] | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a Spark task has one core
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.by_chunks = cut_at_white_space(spec)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = "|".join(map(re.escape, sorted(self.special, key=len, reverse=True)))
        self.odd = regex.compile("[^\\x01-\\u02ff]" + (f"|(?i:{self.names})" if self.names else ""))
        self.any_odd = True
        self.normalizer = self.library.normalizer
        self.border = self.library_ids([BORDER])[0]
        self.own = words is None
        self.ranks = ranks_of_words(spec) if self.own and self.by_chunks else None
        super().__init__(self.library_ids if words is None else words(self))

    def library_ids(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def _found(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Many chunks by one call: a border that is a token of its own stands between them."""
        if not self.own or len(self.border) != 1:
            return super()._found(chunks)
        odd = [i for i, c in enumerate(chunks) if self.odd.search(c)] if self.any_odd else []
        if odd:
            ids, lengths = super()._found([chunks[i] for i in odd])
            parts = dict(zip(odd, np.split(ids, np.cumsum(lengths)[:-1]), strict=True))
            plain_ids, plain = self._found([c for i, c in enumerate(chunks) if i not in parts])
            rest = iter(np.split(plain_ids, np.cumsum(plain)[:-1]))
            every = [parts[i] if i in parts else next(rest) for i in range(len(chunks))]
            return np.concatenate([np.zeros(0, np.int32), *every]), np.array([len(x) for x in every], np.int64)
        if self.ranks is not None:
            return self._by_ranks(chunks)
        joined = [f" {BORDER} ".join(chunks[i : i + AT_ONCE]) for i in range(0, len(chunks), AT_ONCE)]
        found: list[int] = []
        self.library.normalizer = normalizers.Sequence([])  # it would leave these chunks as they are
        try:
            parts = self.library_ids(joined)
        finally:
            self.library.normalizer = self.normalizer
        for part in parts:
            found += part
            found += self.border
        ids = np.array(found, np.int32)
        borders = np.flatnonzero(ids == self.border[0])
        return np.delete(ids, borders), np.diff(np.concatenate([[-1], borders])) - 1

    def _by_ranks(self, chunks: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Plain lowered chunks: cut into words by the file's rule, which are merged by ranks; a long chunk goes through the library."""
        long = {i for i, c in enumerate(chunks) if len(c) > LONGEST_KEPT}
        found: list[int] = []
        for i in range(0, len(chunks), RANKED_AT_ONCE):
            part = [c if j not in long else "" for j, c in enumerate(chunks[i : i + RANKED_AT_ONCE], i)] if long else chunks[i : i + RANKED_AT_ONCE]
            found += self.ranks.encode_ordinary(PIECES.sub("\\g<0>" + WORD_END, CHUNK_END.join(part)) + CHUNK_END)
        ids = np.array(found, np.int32)
        border = self.ranks.encode_ordinary(CHUNK_END)[0]
        ends = np.flatnonzero(ids == border)
        ids, lengths = np.delete(ids, ends), np.diff(np.concatenate([[-1], ends])) - 1
        if long:
            parts = np.split(ids, np.cumsum(lengths)[:-1])
            for i in long:
                parts[i] = np.array(self.library_ids([chunks[i]])[0], np.int32)
            ids, lengths = np.concatenate([np.zeros(0, np.int32), *parts]), np.array([len(x) for x in parts], np.int64)
        return ids, lengths

    def _keys(self, chunks: list[str], texts: pa.Array) -> list[str]:
        """The chunks, lowered where that can't change their ids."""
        odd = "[^\\x{1}-\\x{2ff}]" + (f"|{self.names}" if self.names else "")
        self.any_odd = pc.any(pc.match_substring_regex(texts, odd, ignore_case=True)).as_py()
        if not self.any_odd:
            return [c.lower() for c in chunks]
        odd_chunk = self.odd.search  # such a chunk goes through the whole normaliser
        return [c if odd_chunk(c) else c.lower() for c in chunks]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if self.by_chunks:
            return super().encode(texts)
        return super()._found([t or "" for t in texts.to_pylist()])


_ENCODERS: dict[tuple[str, str], TextEncoder] = {}


def encoder(path: str, kind: str = "library", words: Callable[[TextEncoder], Words] | None = None) -> TextEncoder:
    """The worker's encoder for a vocabulary file, kept between its tasks."""
    if (path, kind) not in _ENCODERS:
        _ENCODERS[path, kind] = TextEncoder(path, words)
    return _ENCODERS[path, kind]
