"""Word-piece token counts by a linear longest-match automaton.

The vocabulary is a trie with failure links. A node's failure link says where matching goes on when its next symbol is
missing: the greedy longest matches of the node's string are taken off its front, and the rest is a trie node again. How many
pieces that takes off is stored beside the link, so that counting adds numbers and builds no piece. Each symbol of a word is
read once; failures are paid for by symbols read before.

Words are lower-cased; a word is a run of letters, one digit, or a run of other signs, followed by an end mark. Symbols are UTF-8
bytes, and the vocabulary holds each byte with and without the mark, so that no word is unknown; with a vocabulary that lacks
some, such a word counts as one unknown token. Nothing is shuffled; the automaton, bounded by the vocabulary, is broadcast.
Defined cases: a null text is the empty one, with no words and no tokens.
"""

from __future__ import annotations

import itertools
import json
from collections import Counter, deque
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from marquee.llm.common import in_batches, rows_of, table, texts

END = 256
REMEMBERED = 200_000
LONG_TEXT = 4_000_000
WORDS = r"\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"


def byte_symbols() -> dict[str, int]:
    """The printable sign that stands for each byte in byte-level vocabularies: itself if printable, else the next free one."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def read_pieces(path: str, mark: str = "</w>") -> list[tuple[int, ...]]:
    """Vocabulary entries as symbol sequences; entries of other signs (special tokens) are left out."""
    with open(path, encoding="utf-8") as f:
        vocabulary = json.load(f)["model"]["vocab"]
    signs = byte_symbols()
    out = []
    for piece in vocabulary:
        body, end = (piece.removesuffix(mark), (END,)) if piece.endswith(mark) and piece != mark else (piece, ())
        if all(c in signs for c in body):
            out.append((*(signs[c] for c in body), *end))
    return out


class Automaton:
    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        self.next: list[dict[int, int]] = [{}]
        final = [False]
        for piece in pieces:
            at = 0
            for s in piece:
                if s not in self.next[at]:
                    self.next[at][s] = len(self.next)
                    self.next.append({})
                    final.append(False)
                at = self.next[at][s]
            final[at] = at != 0 or final[at]
        n = len(self.next)
        self.fail, self.popped = [-1] * n, [0] * n  # -1: no piece can be taken off
        queue = deque([0])
        while queue:
            up = queue.popleft()
            for s, at in self.next[up].items():
                queue.append(at)
                if final[at]:
                    self.fail[at], self.popped[at] = 0, 1
                    continue
                to, pops = self.fail[up], self.popped[up]
                while to >= 0 and s not in self.next[to]:
                    pops, to = pops + self.popped[to], self.fail[to]
                if to >= 0:
                    self.fail[at], self.popped[at] = self.next[to][s], pops

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of a word and its end mark; 0: it has none."""
        at = pieces = 0
        for s in itertools.chain(word, (END,)):
            while s not in self.next[at]:
                if self.fail[at] < 0 or at == 0:
                    return 0
                pieces += self.popped[at]
                at = self.fail[at]
            at = self.next[at][s]
        while at:
            if self.fail[at] < 0:
                return 0
            pieces += self.popped[at]
            at = self.fail[at]
        return pieces


def token_counts(spark: SparkSession, docs: DataFrame, path: str | None = None) -> DataFrame:
    """``doc_id``, ``n_words``, ``n_tokens``, ``n_unknown`` of each row, repeated rows included."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("word_bpe_49k.json")
    shared = spark.sparkContext.broadcast(Automaton(read_pieces(path)))
    schema = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_unknown", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton, split, known = shared.value, regex.compile(WORDS), {}

        def parts(text: str) -> Iterator[list[str]]:
            if len(text) <= LONG_TEXT:
                yield split.findall(text)
            else:
                found = (m.group() for m in split.finditer(text))
                while part := list(itertools.islice(found, 500_000)):
                    yield part

        def rows() -> Iterator[tuple]:
            for doc_id, text in rows_of(batches):
                words = tokens = unknown = 0
                for part in parts(text.lower()):
                    for w in set(part):
                        if w not in known:
                            known[w] = automaton.count(w.encode())
                    counts = Counter(map(known.__getitem__, part))
                    words += len(part)
                    unknown += counts[0]
                    tokens += counts[0] + sum(k * n for k, n in counts.items())
                    if len(known) > REMEMBERED:
                        known.clear()
                yield doc_id, words, tokens, unknown

        yield from in_batches(rows(), schema)

    return texts(docs).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(spark, table(spark, sf_dir, "documents"))
