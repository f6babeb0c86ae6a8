"""Token counts of a unigram vocabulary by dynamic programming over a shared trie.

A text is cut at ASCII white space into pre-tokens, each with the word mark in
front.  The distinct pre-tokens of a slice of texts that were not met before go into
a trie, as sorted strings: a node is a row where a prefix differs from the row
above.  Depth by depth every node gets its forward score, the best sum of piece
scores over all ways to write its prefix, and the number of tokens of that way.  So
a prefix is computed once, whatever number of pre-tokens share it; a pre-token's
count is read at its last node and kept for the task's later texts, ``MAX_KEPT`` of
them at most (then they are computed anew, which changes no result).

A character that no piece covers costs one token per UTF-8 byte and a score below
all pieces.  Ties go to the way with fewer tokens.

Defined cases: NULL, empty and blank texts have no token; bytes that are not
UTF-8 count as the replacement character; repeated rows count alike; other columns are
ignored; a missing key stays missing.  Pre-tokens beyond ``LONGEST_PATH`` characters are computed by
themselves, so that a huge one does not widen the trie.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from postarchive.llm.common import NO_ID, mix64, slices, utf8

MARK = "▁"
UNKNOWN_PENALTY = 10.0
MAX_KEPT = 500_000
LONGEST_PATH = 48
SLICE_BYTES = 4 << 20
TABLE_BITS = 20
BASE = 0x9E3779B97F4A7C15


def read_vocabulary(path: str) -> dict[str, float]:
    """Pieces and scores of a sentencepiece model; control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return {
        model.id_to_piece(i): model.get_score(i)
        for i in range(model.get_piece_size())
        if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
    }


class Pieces:
    """The vocabulary as an open hash table over 64-bit hashes of strings."""

    def __init__(self, vocabulary: dict[str, float]):
        self.vocabulary = vocabulary
        self.longest = max(map(len, vocabulary), default=1)
        self.unknown = min(vocabulary.values(), default=0.0) - UNKNOWN_PENALTY
        self.powers = np.array([pow(BASE, i, 1 << 64) for i in range(self.longest)], np.uint64)
        bits = max(TABLE_BITS, len(vocabulary).bit_length() + 3)
        self.shift = np.uint64(64 - bits)
        self.keys = np.zeros((1 << bits) + 64, np.uint64)
        self.scores = np.zeros((1 << bits) + 64)
        self.probes = 1
        powers = self.powers.tolist()
        hashes = [sum((ord(c) + 1) * powers[i] for i, c in enumerate(reversed(p))) % (1 << 64) for p in vocabulary]
        keys = mix64(np.array(hashes, np.uint64)) | np.uint64(1)  # 0 marks a free place
        homes = (keys >> self.shift).tolist()
        taken: set[int] = set()
        places = []
        for home in homes:
            at = home
            while at in taken:
                at += 1
            taken.add(at)
            places.append(at)
            self.probes = max(self.probes, at - home + 1)
        self.keys[places], self.scores[places] = keys, list(vocabulary.values())

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether each hash is a piece's, and its score."""
        keys = mix64(hashes) | np.uint64(1)
        at = (keys >> self.shift).astype(np.int64)
        hit = self.keys[at] == keys
        for _ in range(self.probes - 1):
            going = np.flatnonzero(~hit & (self.keys[at] != 0))
            if not len(going):
                break
            at[going] += 1
            hit[going] = self.keys[at[going]] == keys[going]
        return hit, self.scores[at]


class TrieCounter:
    """Counts tokens of pre-tokens; see the module's text."""

    def __init__(self, vocabulary: dict[str, float], max_kept: int = MAX_KEPT):
        self.pieces = Pieces(vocabulary)
        self.max_kept = max_kept
        self.counts: dict[bytes, int] = {}

    def alone(self, word: str) -> int:
        """The forward recursion of one pre-token."""
        vocabulary, longest = self.pieces.vocabulary, self.pieces.longest
        best = [(0.0, 0)]  # (score, minus the number of tokens)
        for end in range(1, len(word) + 1):
            ways = []
            for back in range(1, min(longest, end) + 1):
                score = vocabulary.get(word[end - back : end])
                if score is not None:
                    ways.append((best[-back][0] + score, best[-back][1] - 1))
            if word[end - 1] not in vocabulary:
                size = len(word[end - 1].encode("utf-8", "replace"))
                ways.append((best[-1][0] + self.pieces.unknown, best[-1][1] - size))
            best.append(max(ways))
        return -best[-1][1]

    def together(self, words: list[str]) -> np.ndarray:
        """The forward recursion of sorted distinct pre-tokens, a step for each trie node."""
        pieces, n = self.pieces, len(words)
        lengths = np.array([len(w) for w in words])
        depth = int(lengths.max())
        codes = np.array(words, f"<U{depth}").view(np.uint32).reshape(n, depth).T.copy()
        scores, tokens = np.zeros((depth + 1, n)), np.zeros((depth + 1, n), np.int64)
        as_above = np.ones(n, bool)
        as_above[0] = False
        for d in range(1, depth + 1):
            alive = lengths >= d
            as_above[1:] &= (codes[d - 1, 1:] == codes[d - 1, :-1]) & alive[1:] & alive[:-1]
            node = np.flatnonzero(alive & ~as_above)
            best, used = np.full(len(node), -np.inf), np.zeros(len(node), np.int64)
            h = np.zeros(len(node), np.uint64)
            for back in range(1, min(pieces.longest, d) + 1):
                h = h + (codes[d - back, node].astype(np.uint64) + np.uint64(1)) * pieces.powers[back - 1]
                hit, score = pieces.find(h)
                self.better(best, used, hit, scores[d - back, node] + score, tokens[d - back, node] + 1)
                if back == 1:
                    char = codes[d - 1, node]
                    size = 1 + (char >= 0x80) + (char >= 0x800) + (char >= 0x10000)
                    self.better(best, used, ~hit, scores[d - 1, node] + pieces.unknown, tokens[d - 1, node] + size)
            # Rows that share the prefix read the node's values from the row that has it first.
            first = np.zeros(n, np.int64)
            first[node] = np.arange(len(node))
            first = np.maximum.accumulate(first)
            scores[d], tokens[d] = best[first], used[first]
        return tokens[lengths, np.arange(n)]

    @staticmethod
    def better(best, used, may, score, count) -> None:
        take = may & ((score > best) | ((score == best) & (count < used)))
        best[take], used[take] = score[take], count[take]

    def add(self, words: set[bytes]) -> None:
        if len(self.counts) > self.max_kept:
            self.counts.clear()
        new = {raw: MARK + raw.decode("utf-8", "replace") for raw in words - self.counts.keys()}
        short = sorted({w for w in new.values() if len(w) <= LONGEST_PATH})
        found = dict(zip(short, self.together(short).tolist(), strict=True)) if short else {}
        for raw, word in new.items():
            count = found.get(word)
            self.counts[raw] = self.alone(word) if count is None else count


def count_tokens(docs: DataFrame, vocabulary: dict[str, float], key: str = "doc_id") -> DataFrame:
    """``key``, n_words, n_tokens of every row of ``docs`` (``key``, text).

    The texts go to Python and do not come back, so no task has to hold them meanwhile.
    """
    sent = docs.sparkSession.sparkContext.broadcast(vocabulary)  # a vocabulary file: of fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counter = TrieCounter(sent.value)
        for batch in batches:
            texts = list(batch["text"])
            words, tokens = [], []
            for a, b in slices(texts, SLICE_BYTES):
                cut = [text.split() for text in texts[a:b]]
                counter.add(set().union(*cut))
                words += map(len, cut)
                tokens += [sum(map(counter.counts.__getitem__, own)) for own in cut]
            yield pd.DataFrame({key: batch[key], "n_words": words, "n_tokens": tokens})

    rows = docs.select(F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias(key), utf8().alias("text"))
    counted = rows.mapInPandas(run, f"`{key}` long, n_words long, n_tokens long")
    return counted.withColumn(key, F.nullif(F.col(key), F.lit(NO_ID)))
