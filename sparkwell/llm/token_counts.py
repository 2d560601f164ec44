"""Token counts: how many word pieces greedy longest-match would give, without building pieces.

A trie of the vocabulary has, for each node, a failure link and the number of pieces popped on the way along it (the
linear matching of Song et al., "Fast WordPiece Tokenization").  One walk over a word's characters adds up popped
counts: linear in the word's length whatever the pieces are.

A word (no white space as str.split has it) starts with START, which the vocabulary marks word beginnings with; a word
that pieces can't cover is one unknown token.

Defined cases: a null or empty text, or one of white space, has no words and no tokens; a null id stays null; repeated
rows each get a row; very long texts and words are walked whole; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwell.llm.common import slices, table

START, VOCABULARY = "▁", "piece_bpe_32k.model"


def pieces(path: str | None = None) -> list[str]:
    """The vocabulary's ordinary pieces (no control, unknown or byte pieces)."""
    import public_tokenizers
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    return [m.id_to_piece(i) for i in range(m.vocab_size()) if not (m.is_unknown(i) or m.is_control(i) or m.is_byte(i) or m.is_unused(i))]


class Automaton:
    """Children, failure link and popped count of each node of the trie; node 0 is the root."""

    def __init__(self, vocabulary: list[str]):
        self.next: list[dict[str, int]] = [{}]
        self.fail, self.pops = [-1], [0]
        whole = [False]
        for piece in vocabulary:
            node = 0
            for c in piece:
                if c not in self.next[node]:
                    self.next[node][c] = len(self.next)
                    self.next.append({})
                    self.fail.append(-1)
                    self.pops.append(0)
                    whole.append(False)
                node = self.next[node][c]
            whole[node] = node > 0
        queue = [0]
        for node in queue:
            for c, child in self.next[node].items():
                queue.append(child)
                if whole[child]:  # the string read so far is one piece
                    self.fail[child], self.pops[child] = 0, 1
                    continue
                # pop the parent's longest pieces, then see where c leads
                at, popped = self.fail[node], self.pops[node]
                while at >= 0 and c not in self.next[at]:
                    popped += self.pops[at]
                    at = self.fail[at]
                if at >= 0:
                    self.fail[child], self.pops[child] = self.next[at][c], popped

    def count(self, word: str) -> int:
        """Pieces of START + word by greedy longest match; 1 if they can't cover it."""
        step, fail, pops = self.next, self.fail, self.pops
        node, total = 0, 0
        for c in START + word:
            while (to := step[node].get(c)) is None:
                total += pops[node]
                node = fail[node]
                if node < 0:
                    return 1
            node = to
        while node > 0:
            total += pops[node]
            node = fail[node]
        return total if node == 0 else 1


class Counts(dict):
    """Word to its number of tokens, kept for a bounded number of words."""

    def __init__(self, automaton: Automaton, most: int = 500_000):
        self.automaton, self.most = automaton, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        n = self[word] = self.automaton.count(word)
        return n


def token_counts(docs: DataFrame, vocabulary: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: doc_id, n_words, n_tokens, longest (most tokens of a word)."""
    kind = docs.schema[id_col].dataType.simpleString()
    automaton = Automaton(pieces() if vocabulary is None else vocabulary)  # its size is the vocabulary's

    def run(batches):
        import pyarrow as pa

        counts = Counts(automaton)
        for batch in batches:
            for part in slices(batch, 1):
                n, words = [], []
                for t in part.column(1).to_pylist():
                    own = (t or "").split()
                    n.append(len(own))
                    words += map(counts.__getitem__, own)
                at = np.array(words, np.int64)
                ends = np.cumsum(n)
                total = np.concatenate([[0], np.cumsum(at)])
                tokens = total[ends] - total[ends - n]
                most = [int(at[e - k : e].max()) if k else 0 for e, k in zip(ends.tolist(), n)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), pa.array(tokens), pa.array(most, pa.int64())], ["doc_id", "n_words", "n_tokens", "longest"])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_words long, n_tokens long, longest long")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
