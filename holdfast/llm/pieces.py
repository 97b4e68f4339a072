"""SentencePiece encoding and decoding of whole texts, over a trie of marked words.

Spaces become the mark U+2581, one mark is put before the text, and the text falls into marked words, across
which no piece of the vocabulary reaches. The distinct unseen words of a batch are sorted, which lists
the trie of their characters depth first; the forward table of a word keeps the part that it shares with the word
before it, and only the rest is computed. For a unigram model the table holds the best score of each prefix
(Viterbi). The piece scores of a merging (BPE) model are merge ranks, and their sum doesn't name its encoding;
there the table holds the last piece of each prefix's encoding, the only one that agrees with the last piece
before it: two pieces agree if merging their joined text ends in just these two.

Characters outside the vocabulary are encoded as the byte pieces of their UTF-8 form.

NULL and empty texts have no ids. A mark that a text itself contains decodes to a space; otherwise decoding returns
the text. Rows are independent, so repeated rows, ties and NULL ids change nothing; an empty table gives an
empty result; only doc_id and text are read.
"""

from __future__ import annotations

import heapq
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from holdfast.llm.tables import map_batches, text_slices

MARK = "▁"
SIGN_EDGE = re.compile(rf"(?<=[^\W{MARK}])(?=[^\w{MARK}])|(?<=[^\w{MARK}])(?=.)", re.DOTALL)
PIECE, AGREES = "piece", "agrees"
WORD = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


@dataclass
class Vocabulary:
    ids: dict[str, int]
    scores: dict[str, float]
    pieces: list[str]
    bytes: dict[int, int]  # byte: id
    merging: bool

    @classmethod
    def load(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        every = range(model.get_piece_size())
        pieces = [model.id_to_piece(i) for i in every]
        usual = [i for i in every if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        scores = [model.get_score(i) for i in usual]
        return cls(
            {pieces[i]: i for i in usual}, {pieces[i]: s for i, s in zip(usual, scores)}, pieces,
            {int(pieces[i][3:5], 16): i for i in every if model.is_byte(i)}, all(s == int(s) for s in scores),
        )


class TrieEncoder:
    def __init__(self, vocabulary: Vocabulary, remembered: int = 500_000):
        self.v, self.remembered = vocabulary, remembered
        self.known: dict[str, bytes] = {}
        #: Neighbours inside some piece; a word can be cut between any others.
        self.joined = {p[k : k + 2] for p in vocabulary.ids for k in range(len(p) - 1)}
        self.root: dict = {}  # trie of the pieces: a node has its characters' nodes, and under PIECE the piece that ends there
        for piece in vocabulary.ids:
            node = self.root
            for c in piece:
                node = node.setdefault(c, {})
            node[PIECE], node[AGREES] = piece, {}
        self.packed = {p: np.array([i], "<u4").tobytes() for p, i in vocabulary.ids.items()}

    def merge(self, text: str) -> list[str]:
        """Merging from single characters: the highest score first, then the leftmost pair."""
        parts: list[str | None] = list(text)
        before, after = list(range(-1, len(parts) - 1)), list(range(1, len(parts) + 1))
        queue: list[tuple[float, int, str, str]] = []

        def offer(i: int, j: int) -> None:
            if 0 <= i and j < len(parts) and (score := self.v.scores.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-score, i, parts[i], parts[j]))

        for i in range(len(parts) - 1):
            offer(i, i + 1)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if parts[i] != left or j >= len(parts) or parts[j] != right:
                continue  # one of them has been merged since
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[i] < len(parts):
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def _agree(self, left: str, right: str) -> bool:
        return self.merge(left + right) == ([left, right] if left else [right])

    def _extend(self, word: str, table: list[tuple]) -> None:
        """Forward entries of the prefixes of word that table lacks: last piece, score, pieces begun and not ended."""
        root, merging, scores = self.root, self.v.merging, self.v.scores
        for end in range(len(table), len(word) + 1):
            c, last, best, begun = word[end - 1], None, -1e300, []
            for start, above in (*table[end - 1][2], (end - 1, root)):
                if (node := above.get(c)) is None:
                    continue
                begun.append((start, node))
                if (piece := node.get(PIECE)) is None:
                    continue
                left, total, _ = table[start]
                if not merging:
                    if total + scores[piece] > best:
                        last, best = piece, total + scores[piece]
                elif last is None:
                    agrees = node[AGREES]
                    if (found := agrees.get(left)) is None:
                        found = agrees[left] = self._agree(left, piece)
                    if found:
                        last, best = piece, 0.0
            if last is None:  # a character that no piece ends with here stands alone
                last, best = c, table[end - 1][1] - 1e6
            table.append((last, best, begun))

    def encode_words(self, words: set[str]) -> None:
        """Depth first through the trie: in sorted order, each word keeps the table of its common prefix."""
        table, last = [("", 0.0, ())], ""
        for word in sorted(words):
            shared = 0
            for a, b in zip(word, last):
                if a != b:
                    break
                shared += 1
            del table[shared + 1 :]
            self._extend(word, table)
            last, parts, end = word, [], len(word)
            while end:
                parts.append(table[end][0])
                end -= len(parts[-1])
            self.known[word] = self._packed(parts[::-1])

    def _packed(self, parts: list[str]) -> bytes:
        for part in parts:
            if part not in self.packed:
                self.packed[part] = np.array([self.v.bytes[b] for b in part.encode()], "<u4").tobytes()
        return b"".join([self.packed[part] for part in parts])

    def _split(self, word: str) -> list[str]:
        """Parts of a marked word between which no piece reaches; only beside signs are such places looked for."""
        parts, start = [], 0
        for k in [m.start() for m in SIGN_EDGE.finditer(word)]:
            if word[k - 1 : k + 1] not in self.joined:
                parts.append(word[start:k])
                start = k
        parts.append(word[start:])
        return parts

    def _marked(self, text: str | None) -> list[str]:
        if not text:
            return []
        words = text.split(" ")
        if MARK in text or "" in words:
            return WORD.findall(MARK + text.replace(" ", MARK))
        return [MARK + w for w in words]

    def ids(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.known) > self.remembered:
            self.known.clear()
        marked = [self._marked(text) for text in texts]
        new = set().union(*marked) - self.known.keys()
        cut = {word: self._split(word) for word in new}
        single, runs = set(), set()
        for parts in cut.values():
            for part in parts:
                if part not in self.known:
                    (runs if self.v.merging and part.startswith(MARK * 2) else single).add(part)
        self.encode_words(single)
        for part in runs:  # runs of marks have equal scores, so here the leftmost pair decides
            self.known[part] = self._packed(self.merge(part))
        for word, parts in cut.items():
            if len(parts) > 1:
                self.known[word] = b"".join([self.known[p] for p in parts])
        return [b"".join([self.known[w] for w in words]) for words in marked]

    def decode(self, packed: bytes) -> str:
        """Text of the ids: pieces joined, byte pieces read as UTF-8, the first mark dropped, the others spaces."""
        if not hasattr(self, "_forms"):
            of_byte = {i: bytes([b]) for b, i in self.v.bytes.items()}
            self._forms = [of_byte.get(i, p.encode()) for i, p in enumerate(self.v.pieces)]
        forms = self._forms
        text = b"".join([forms[i] for i in np.frombuffer(packed, "<u4").tolist()]).decode(errors="replace")
        return text.replace(MARK, " ")[1:]


_ENCODERS: dict[str, TrieEncoder] = {}


def encoder(path: str) -> TrieEncoder:
    """One per worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = TrieEncoder(Vocabulary.load(path))
    return _ENCODERS[path]


def encode(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id and ids, packed as little-endian unsigned 32-bit numbers."""

    def run(batch: pa.RecordBatch):
        own = encoder(model_path)
        for part in text_slices(batch):
            ids = own.ids(part.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(ids, pa.binary())], ["doc_id", "ids"])

    return map_batches(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), run, "doc_id bigint, ids binary")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """doc_id and text."""

    def run(batch: pa.RecordBatch):
        own = encoder(model_path)
        texts = [own.decode(ids or b"") for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return map_batches(encoded.select("doc_id", "ids"), run, "doc_id bigint, text string")


def digest(docs: DataFrame, model_path: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32, decoded_crc32 and round_trip: both directions over every text, ids not moved."""

    def run(batch: pa.RecordBatch):
        own = encoder(model_path)
        for part in text_slices(batch):
            texts = [t or "" for t in part.column("text").to_pylist()]
            ids = own.ids(texts)
            decoded = [own.decode(i) for i in ids]
            yield pa.RecordBatch.from_arrays([
                part.column("doc_id"), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array([zlib.crc32(i) for i in ids], pa.int64()),
                pa.array([zlib.crc32(d.encode()) for d in decoded], pa.int64()),
                pa.array([d == t.replace(MARK, " ") for d, t in zip(decoded, texts)]),
            ], ["doc_id", "n_tokens", "ids_crc32", "decoded_crc32", "round_trip"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return map_batches(rows, run, "doc_id bigint, n_tokens bigint, ids_crc32 bigint, decoded_crc32 bigint, round_trip boolean")
