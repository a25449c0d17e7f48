"""Byte-pair encoding by dynamic programming over prefixes.

For every prefix of a piece there is exactly one token that can end its encoding. It is the one vocabulary match ending
there whose start is either 0 or a prefix whose own last token is compatible with it: two tokens are compatible if
merging the bytes of both by rank leaves exactly these two. Matches ending at each position come from a suffix automaton of
the vocabulary: it follows the longest suffix that is part of any token, and its suffix links lead to the tokens among the
suffixes, longest first; following the stored last tokens back from the end gives the ids. The work is linear in the piece,
however long it is.

Defined cases: a null text counts as empty and has no ids; a special token's string in a text becomes its id, as the
tokenizers library does by default; a very long text, even one without blanks, is encoded whole; a vocabulary that lacks a byte
of the text is an error; every row is encoded on its own, so repeated rows give equal results; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator
from functools import lru_cache
from itertools import chain

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from winlens.llm.common import table, text_rows

#: Fixed by the tokenizer: how the library cuts texts into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pieces up to this length are remembered, so many recent ones at most and as many older ones; both bound memory only.
CACHED_CHARS, CACHED_PIECES = 64, 300_000
NEVER = 1 << 60


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in the vocabulary file: printable Latin-1 as itself, the rest from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class SuffixAutomaton:
    """Minimal automaton of all parts of some words, built word by word, with the words that end at a state.

    follow[s] has the next state by byte; link[s] is the state of the longest suffix with other ends, size[s] the length of a state's
    longest string. A word is always the longest string of its state, as nothing longer ends where the word itself does, so word[s]
    is the one word of a state (-1: none), and shorter[s] the next state with a word among the suffixes (0: none).
    """

    def __init__(self, words: dict[bytes, int]):
        self.follow: list[dict[int, int]] = [{}]
        self.link, self.size = [-1], [0]
        ends = {}
        for w in words:
            at = 0
            for byte in w:
                at = self._grow(at, byte)
            ends[w] = at
        self.word, self.shorter = [-1] * len(self.link), [0] * len(self.link)
        for w, at in ends.items():
            self.word[at] = words[w]
        for at in sorted(range(1, len(self.link)), key=self.size.__getitem__):
            up = self.link[at]
            self.shorter[at] = up if self.word[up] >= 0 else self.shorter[up]
        #: Where a match of a state's full length begins to look for words.
        self.first = [at if w >= 0 else up for at, (w, up) in enumerate(zip(self.word, self.shorter, strict=True))]
        #: Length and number of all words that end where a state's longest string does, longest first; and of those that are shorter.
        self.whole: list[tuple[tuple[int, int], ...]] = [()] * len(self.link)
        for at in sorted(range(1, len(self.link)), key=self.size.__getitem__):
            shorter = self.whole[self.shorter[at]]
            self.whole[at] = ((self.size[at], self.word[at]), *shorter) if self.word[at] >= 0 else shorter
        self.part = [self.whole[up] for up in self.shorter]

    def _state(self, follow: dict[int, int], link: int, size: int) -> int:
        self.follow.append(follow)
        self.link.append(link)
        self.size.append(size)
        return len(self.link) - 1

    def _split(self, at: int, byte: int) -> int:
        """The state that byte leads to from at, without the longer strings that end there too."""
        to, size = self.follow[at][byte], self.size[at] + 1
        if self.size[to] == size:
            return to
        short = self._state(dict(self.follow[to]), self.link[to], size)
        self.link[to] = short
        while at >= 0 and self.follow[at].get(byte) == to:
            self.follow[at][byte] = short
            at = self.link[at]
        return short

    def _grow(self, at: int, byte: int) -> int:
        """The state of the word so far, one byte longer."""
        if byte in self.follow[at]:
            return self._split(at, byte)
        new = self._state({}, 0, self.size[at] + 1)
        while at >= 0 and byte not in self.follow[at]:
            self.follow[at][byte] = new
            at = self.link[at]
        if at >= 0:
            self.link[new] = self._split(at, byte)
        return new


class Recent(dict):
    """Ids by piece, made when first asked for. When there are too many, those not asked for since the last time are forgotten."""

    def __init__(self, make: Callable[[str], tuple[int, ...]]):
        super().__init__()
        self.make, self.older = make, {}

    def __missing__(self, text: str) -> tuple[int, ...]:
        ids = self.older.get(text)
        if ids is None:
            ids = self.make(text)
        if len(text) <= CACHED_CHARS:
            if len(self) >= CACHED_PIECES:
                self.older = dict(self)
                self.clear()
            self[text] = ids
        return ids


class PrefixBpe:
    """Encoder and decoder over the vocabulary and merges of a byte-level tokenizer file."""

    def __init__(self, spec: dict):
        to_byte = byte_alphabet()
        raw = lambda s: bytes(to_byte[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.text = {i: raw(s) for s, i in vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        self.text |= {i: s.encode() for s, i in self.special.items()}
        size = max(self.text) + 1
        self.born, self.left, self.right = [-1] * size, [0] * size, [0] * size
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            a_id, b_id, whole = vocab[a], vocab[b], vocab[a + b]
            self.rank[a_id << 32 | b_id] = rank
            if self.born[whole] < 0:
                self.born[whole], self.left[whole], self.right[whole] = rank, a_id, b_id
        self.matches = SuffixAutomaton({raw(s): i for s, i in vocab.items()})
        self.pieces = regex.compile(PIECES).findall
        self.cuts = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pairs: dict[int, bool] = {}
        self.cache = Recent(self.piece)

    def compatible(self, a: int, b: int) -> bool:
        """Do the bytes of a and b, merged by rank, end as these two tokens?

        Undo the later of the two tokens' merges again and again. The two sides that face each other in between existed
        together until the earlier of their own next merges; if they could have been merged before that, they were.
        """
        key = a << 32 | b
        known = self.pairs.get(key)
        if known is None:
            known, until_a, until_b = True, NEVER, NEVER
            while True:
                merge = self.rank.get(a << 32 | b)
                if merge is not None and merge < until_a and merge <= until_b:  # of equal ranks the left one goes first
                    known = False
                    break
                born_a, born_b = self.born[a], self.born[b]
                if born_a < 0 and born_b < 0:
                    break
                if born_a > born_b:
                    until_a, a = born_a, self.right[a]
                else:
                    until_b, b = born_b, self.left[b]
            if len(self.pairs) > 100_000:
                self.pairs.clear()
            self.pairs[key] = known
        return known

    def piece(self, text: str) -> tuple[int, ...]:
        raw = text.encode("utf-8", "surrogatepass")
        last: list[int] = [-1] * (len(raw) + 1)
        width = [0] * (len(raw) + 1)
        m, state, known = self.matches, 0, 0  # the longest suffix of the prefix that is part of a token, and its length
        follow, link, size, whole, part, judged = m.follow, m.link, m.size, m.whole, m.part, self.pairs.get
        for end, byte in enumerate(raw, 1):
            to = follow[state].get(byte)
            while to is None and state:
                state = link[state]
                known = size[state]
                to = follow[state].get(byte)
            if to is None:
                continue
            state, known = to, known + 1
            for wide, token in whole[to] if known == size[to] else part[to]:
                before = last[end - wide]
                if before >= 0:
                    fits = judged(before << 32 | token)
                    if fits is None:
                        fits = self.compatible(before, token)
                else:
                    fits = wide == end
                if fits:
                    last[end], width[end] = token, wide
                    break
        if last[len(raw)] < 0 and raw:
            raise ValueError("the vocabulary has no token for some byte of the text")
        ids, at = [], len(raw)
        while at:
            ids.append(last[at])
            at -= width[at]
        ids.reverse()
        return tuple(ids)

    def encode(self, text: str) -> list[int]:
        ids: list[int] = []
        for part in self.cuts.split(text) if self.cuts else [text]:
            if part in self.special:
                ids.append(self.special[part])
            else:
                ids.extend(chain.from_iterable(map(self.cache.__getitem__, self.pieces(part))))
        return ids

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.text.__getitem__, ids)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def encoder(spec: str) -> PrefixBpe:
    return PrefixBpe(json.loads(spec))


def read_spec(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", digest: bool = False) -> DataFrame:
    """doc_id and ids (array of int) with the decoded text; with digest=True counts and digests in place of both.

    The vocabulary file (about 1.5 MB, a fixed size) is read once where the driver runs and broadcast.
    """
    spec = docs.sparkSession.sparkContext.broadcast(read_spec(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = encoder(spec.value)
        names = list(map(str, range(max(bpe.text) + 1)))
        for batch in batches:
            doc_ids, texts = batch.column(0), batch.column(1).to_pylist()
            for at in range(0, max(1, len(texts)), 500):
                all_ids = [bpe.encode(t) for t in texts[at : at + 500]]
                cut = doc_ids.slice(at, 500)
                if digest:
                    sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
                    arrays = [cut, pa.array(map(len, all_ids), pa.int64()), pa.array([sha(",".join([names[i] for i in ids])) for ids in all_ids], pa.string()), pa.array([sha(bpe.decode(ids)) for ids in all_ids], pa.string())]
                    yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
                else:
                    yield pa.RecordBatch.from_arrays([cut, pa.array(all_ids, pa.list_(pa.int32())), pa.array(map(bpe.decode, all_ids), pa.string())], ["doc_id", "ids", "decoded"])

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" if digest else "doc_id long, ids array<int>, decoded string"
    return text_rows(docs, id_col, text_col).mapInArrow(run, schema)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op7_bpe(spark: SparkSession, sf_dir: str, path: str | None = None) -> DataFrame:
    return bpe_encode(table(spark, sf_dir, "documents"), path or default_path(), digest=True)
