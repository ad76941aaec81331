"""Token counts: greedy longest-match word pieces counted by a linear automaton, without building the pieces.

The vocabulary's byte strings form a trie. A node whose string is a piece fails to the root and pops one token; any
other node follows its parent's failure links until one of them has the next byte, and the tokens popped on the way are
summed beforehand. Counting a word is then one walk over its bytes. A word is a run of characters other than
\\x20\\x09-\\x0D and is matched with one space before it, as pieces that begin a word have it. A word with a byte that no
piece covers counts as one unknown token.

Null and empty texts have no words and no tokens. Rows repeat as in the input, a null key stays null, an empty table
gives an empty result, and columns other than key and text are not read.
"""

from __future__ import annotations

import base64

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RANKS = "byte_bpe_50k.tiktoken"
#: Distinct words a worker remembers before it starts anew.
MEMORY = 400_000
_loaded: dict = {}


class Automaton:
    """Trie with failure links and popped-token counts."""

    def __init__(self, pieces):
        self.next: list[dict[int, int]] = [{}]
        ends = {0}
        order, depth = [], [0]
        for piece in sorted(set(pieces), key=len):
            node = 0
            for b in piece:
                if b not in self.next[node]:
                    self.next[node][b] = len(self.next)
                    order.append((depth[node] + 1, len(self.next), node, b))
                    depth.append(depth[node] + 1)
                    self.next.append({})
                node = self.next[node][b]
            ends.add(node)
        self.fail: list[int] = [-1] * len(self.next)
        self.popped: list[int] = [0] * len(self.next)
        for _, node, parent, b in sorted(order):  # shorter strings first
            if node in ends:
                self.fail[node], self.popped[node] = 0, 1
                continue
            at, n = self.fail[parent], self.popped[parent]
            while at >= 0 and b not in self.next[at]:
                n += self.popped[at]
                at = self.fail[at]
            if at >= 0:
                self.fail[node], self.popped[node] = self.next[at][b], n

    def count(self, word: bytes) -> int:
        """Pieces of the greedy longest match; 1 if it can't cover the word."""
        node, n, step, fail, popped = 0, 0, self.next, self.fail, self.popped
        for b in word:
            while b not in step[node]:
                if fail[node] < 0:
                    return 1
                n += popped[node]
                node = fail[node]
            node = step[node][b]
        while node:
            if fail[node] < 0:
                return 1
            n += popped[node]
            node = fail[node]
        return n


def automaton(path: str) -> Automaton:
    if path not in _loaded:
        with open(path, "rb") as lines:
            _loaded[path] = Automaton(base64.b64decode(x.split()[0]) for x in lines)
    return _loaded[path]


def count_tokens(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None) -> DataFrame:
    """(key, n_words, n_tokens): one row for each row of ``docs``. ``ranks``: lines of a base64 piece and a number."""
    import public_tokenizers

    path = str(ranks or public_tokenizers.path(RANKS))
    kind = docs.schema[key].dataType.simpleString()
    arrow = common.arrow_type(docs, key)

    def run(batches):
        machine, known = automaton(path), {}
        for keys, texts in common.rows(batches):
            n_words, n_tokens = [], []
            for t in texts:
                words = t.encode().split()
                total = 0
                for w in words:
                    n = known.get(w)
                    if n is None:
                        n = known[w] = machine.count(b" " + w)
                    total += n
                n_words.append(len(words))
                n_tokens.append(total)
            if len(known) > MEMORY:
                known.clear()
            yield pa.RecordBatch.from_arrays([pa.array(keys, arrow), pa.array(n_words, pa.int64()), pa.array(n_tokens, pa.int64())], names=["key", "n_words", "n_tokens"])

    return docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, n_words long, n_tokens long").withColumnRenamed("key", key)


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and word pieces of every document."""
    return count_tokens(common.table(spark, sf_dir, "documents"))
