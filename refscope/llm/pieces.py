"""SentencePiece encoding and decoding: an Aho-Corasick automaton of the pieces drives Viterbi."""

from __future__ import annotations

import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass, field, replace

import ahocorasick
import numpy as np
import pandas as pd
import sentencepiece
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from refscope.llm.common import bounded_batches

SPACE = "▁"
#: Cost of a character no piece covers, below the worst piece.
UNKNOWN_PENALTY = 10.0
_CACHE_ENTRIES, _CACHE_CHARS = 200_000, 48
_IDS = np.dtype("<i4")
_LONG = 10_000
#: A letter or digit, and any other character but the space mark.
_WORD, _OTHER = r"[^\W_]", rf"(?:(?!{SPACE})[\W_])"
_MOST_PIECES = 1_000_000


@dataclass
class Vocabulary:
    """Pieces of a model: text, score and kind (``normal``, ``byte``, ``unknown``, ``control``) by id."""

    pieces: tuple[str, ...]
    scores: tuple[float, ...]
    kinds: tuple[str, ...]
    prefix: bool = True
    #: Pieces that ``trimmed`` found to be on no best path; empty before.
    useless: tuple[bool, ...] = ()
    codec: Codec | None = field(default=None, repr=False, compare=False)


def load(model_file: str) -> Vocabulary:
    """The pieces of a model file, read on the driver; their number is bounded."""
    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    size = model.get_piece_size()
    if size > _MOST_PIECES:
        raise ValueError(f"{size} pieces are too many to send to every task")
    kinds = tuple(
        "byte" if model.is_byte(i) else "unknown" if model.is_unknown(i) else "control" if model.is_control(i) or model.is_unused(i) else "normal"
        for i in range(size)
    )
    prefix = model.encode("a", out_type=str)[0].startswith(SPACE)
    words = Vocabulary(tuple(map(model.id_to_piece, range(size))), tuple(map(model.get_score, range(size))), kinds, prefix)
    return trimmed(words)


def trimmed(words: Vocabulary) -> Vocabulary:
    """The vocabulary with its useless pieces marked: the automaton does without them, no id changes."""
    return replace(words, useless=Codec(words).useless(), codec=None)


class Codec:
    """Encodes and decodes single texts with one vocabulary."""

    def __init__(self, words: Vocabulary):
        self.words = words
        plain = [i for i, k in enumerate(words.kinds) if k == "normal" and words.pieces[i]]
        self.size = [len(p) for p in words.pieces]
        self.singles = {words.pieces[i] for i in plain if len(words.pieces[i]) == 1}
        self.unknown = min((words.scores[i] for i in plain), default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = words.kinds.index("unknown") if "unknown" in words.kinds else 0
        self.byte_ids = {int(words.pieces[i][3:-1], 16): i for i, k in enumerate(words.kinds) if k == "byte"}
        self.bytes_of = {i: b for b, i in self.byte_ids.items()}
        self.chunks = re.compile(self._chunks([words.pieces[i] for i in plain]))
        self.automaton = self._automaton(plain)
        if any(words.useless):
            self.automaton = self._automaton([i for i in plain if not words.useless[i]])
        # Ids of late chunks as packed bytes, in two bounded generations.
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        shown = {"normal": words.pieces.__getitem__, "byte": lambda i: chr(self.bytes_of[i]), "unknown": lambda i: " ⁇ "}
        self.texts = [shown.get(k, lambda i: "")(i) for i, k in enumerate(words.kinds)]
        self.partial = np.array([self.bytes_of.get(i, 0) > 127 for i in range(len(words.kinds))] or [False])

    def _automaton(self, ids: list[int]) -> ahocorasick.Automaton | None:
        found = ahocorasick.Automaton()
        for i in ids:
            found.add_word(self.words.pieces[i], (i, self.size[i], self.words.scores[i]))
        if not ids:
            return None
        found.make_automaton()
        return found

    def useless(self) -> tuple[bool, ...]:
        """Pieces on no best path: smaller pieces spell them with a better score."""
        scores, pieces = self.words.scores, self.words.pieces
        out = [False] * len(pieces)
        for i, kind in enumerate(self.words.kinds):
            if kind == "normal" and self.size[i] > 1 and self.singles.issuperset(pieces[i]):
                out[i] = sum(scores[p] for p in self.viterbi(pieces[i])) > scores[i]
        return tuple(out)

    @staticmethod
    def _chunks(pieces: list[str]) -> str:
        """Where every best path has a boundary, because no piece goes across."""

        def across(pattern: str) -> bool:
            return any(map(re.compile(pattern).search, pieces))

        if across(f"[^{SPACE}]{SPACE}"):
            return "(?s).+"
        if across(f"{_WORD}{_OTHER}|{_OTHER}{_WORD}"):
            return f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        return f"{SPACE}*{_WORD}+|{SPACE}*{_OTHER}+|{SPACE}+"

    def viterbi(self, chunk: str) -> list[int]:
        """Ids of the best path over ``chunk``, in one pass over the automaton's matches.

        Matches come by end, longer ones first (along the output links); each relaxes
        the best score at its end. Of equal scores the longer last piece stays.
        """
        n = len(chunk)
        # ``best[e]`` is the best score of a path that ends with character e; the last place is the empty path.
        if n < _LONG:
            best, last = [-np.inf] * n + [0.0], [-1] * n
        else:
            best, last = array("d", [-np.inf]) * n + array("d", [0.0]), array("q", [-1]) * n
        size = self.size
        if self.singles.issuperset(chunk):
            for end, (piece, length, score) in self.automaton.iter(chunk):
                value = best[end - length] + score
                if value > best[end]:
                    best[end], last[end] = value, piece
        else:
            matches = self.automaton.iter(chunk) if self.automaton else iter(())
            nothing = (n, None)
            end, found = next(matches, nothing)
            for at in range(n):
                single = False
                while end == at:
                    piece, length, score = found
                    value = best[at - length] + score
                    if value > best[at]:
                        best[at], last[at] = value, piece
                    single |= length == 1
                    end, found = next(matches, nothing)
                if not single and best[at - 1] + self.unknown > best[at]:
                    best[at], last[at] = best[at - 1] + self.unknown, -1
        ids: list[int] = []
        at = n
        while at:
            piece = last[at - 1]
            if piece >= 0:
                ids.append(piece)
                at -= size[piece]
            else:
                at -= 1
                raw = chunk[at].encode("utf-8", "replace")
                ids += [self.byte_ids[b] for b in reversed(raw)] if len(self.byte_ids) == 256 else [self.unknown_id]
        ids.reverse()
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        if not text:
            return np.empty(0, _IDS)
        chunks = self.chunks.findall((SPACE if self.words.prefix else "") + text.replace(" ", SPACE))
        found = list(map(self.known.get, chunks))
        if None in found:
            for at, packed in enumerate(found):
                if packed is None:
                    found[at] = self._remembered(chunks[at])
        return np.frombuffer(b"".join(found), _IDS)

    def _remembered(self, chunk: str) -> bytes:
        """Packed ids of a chunk; those of late chunks are kept, in two bounded generations."""
        packed = self.known.get(chunk) or self.older.get(chunk)
        if packed is None:
            packed = array("i", self.viterbi(chunk)).tobytes()
        if len(chunk) <= _CACHE_CHARS:
            if len(self.known) >= _CACHE_ENTRIES:
                self.known, self.older = {}, self.known
            self.known[chunk] = packed
        return packed

    def decode(self, ids: np.ndarray) -> str:
        """Text of ids: pieces one after another, bytes put together into characters."""
        if not self.partial[ids].any():
            text = "".join(map(self.texts.__getitem__, ids.tolist()))
        else:
            # Only bytes of characters beyond ASCII need their neighbours.
            out = bytearray()
            for i in ids.tolist():
                out += bytes([self.bytes_of[i]]) if i in self.bytes_of else self.texts[i].encode("utf-8", "surrogatepass")
            text = out.decode("utf-8", "replace")
        text = text.replace(SPACE, " ")
        return text[1:] if self.words.prefix and text.startswith(" ") else text


def codec_of(words: Vocabulary) -> Codec:
    """The codec of a vocabulary, made once and kept on it: in a worker as long as the vocabulary itself."""
    if words.codec is None:
        words.codec = Codec(words)
    return words.codec


class Tokenizer:
    """Column functions over one vocabulary, which every task gets once."""

    def __init__(self, spark: SparkSession, words: Vocabulary):
        bounded_batches(spark)
        self._sent = spark.sparkContext.broadcast(replace(words, codec=None))

    def encode(self, text: Column) -> Column:
        """Ids of whole texts; a null text has null, an empty one no ids."""
        sent = self._sent

        def run(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = codec_of(sent.value)
            for some in texts:
                yield pd.Series([None if t is None else codec.encode(t) for t in some])

        run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
        # Without this mark the encoder would run again for every column made from its ids.
        return F.pandas_udf(run, "array<int>").asNondeterministic()(text)

    def coded(self, text: Column) -> Column:
        """``struct(ids, decoded)``: ids of whole texts and what they decode to, in one pass."""
        sent = self._sent

        def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
            codec = codec_of(sent.value)
            for some in texts:
                ids = [None if t is None else codec.encode(t) for t in some]
                back = [None if x is None else codec.decode(x) for x in ids]
                yield pd.DataFrame({"ids": pd.Series(ids, dtype=object), "decoded": pd.Series(back, dtype=object)})

        run.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.DataFrame]}
        return F.pandas_udf(run, "ids array<int>, decoded string").asNondeterministic()(text)

    def decode(self, ids: Column) -> Column:
        """Texts of ids; null for null."""
        sent = self._sent

        def run(lists: Iterator[pd.Series]) -> Iterator[pd.Series]:
            codec = codec_of(sent.value)
            for some in lists:
                yield pd.Series([None if x is None else codec.decode(x) for x in some], dtype=object)

        run.__annotations__ = {"lists": Iterator[pd.Series], "return": Iterator[pd.Series]}
        return F.pandas_udf(run, "string").asNondeterministic()(ids)
