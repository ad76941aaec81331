"""Byte-level BPE encoding and decoding by merge replay over many words at once.

A text is cut by the vocabulary's pattern and each match is merged by itself, so equal matches have equal ids wherever they
stand. A task gathers the distinct matches of a slice of its corpus that it hasn't met yet and lays their bytes out in one
line. An inverted index leads from each pair of neighbouring tokens, named by the rank of the token it would make, to the
places where it stands. Merges are then replayed in rank order: all places of the lowest rank are merged from left to
right, and only the two pairs that a merge touches are taken into the index. Where a merge opens a pair of a lower rank
than the one being replayed (a vocabulary may hold a token in two splits), that match is merged by itself, lowest rank
first. A match that is a token as a whole is that token.

Nothing is shuffled. Memory is bounded by the slice, by the matches remembered (``MATCHES`` and ``LETTERS``) and by the
longest text. Null and empty texts have no ids and decode to no bytes. Rows repeat as in the input, a null key stays null,
an empty table gives an empty result and columns other than key and text aren't read.
"""

from __future__ import annotations

import base64
import heapq
from bisect import bisect_right
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

RANKS = "byte_bpe_50k.tiktoken"
SLICE = 2_000_000
#: Bytes of distinct matches laid out at once.
LINE = 500_000
#: Matches, and characters of theirs, that a task remembers before it starts anew.
MATCHES, LETTERS = 300_000, 8_000_000
PAIRS = 1_000_000
_loaded: dict = {}


def _places(made: np.ndarray) -> dict[int, list[int]]:
    """Places by the rank at them, in order; -1 stands for none."""
    at = np.argsort(made, kind="stable")
    at = at[np.searchsorted(made[at], 0) :]
    ranks, heads = np.unique(made[at], return_index=True)
    return {r: p.tolist() for r, p in zip(ranks.tolist(), np.split(at, heads[1:]), strict=True)} if len(at) else {}


class Merges:
    """A vocabulary of byte strings with ranks, and the pairs of tokens that make a token."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.strings = {r: s for s, r in ranks.items()}
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.bytes_make = np.array([[ranks.get(bytes([a, b]), -1) for b in range(256)] for a in range(256)])
        self.pairs: dict[tuple[int, int], int] = {}

    def makes(self, left: int, right: int) -> int:
        """Rank of the token that two tokens make, -1 for none."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self.ranks.get(self.strings[left] + self.strings[right], -1)
        return found

    def alone(self, word: bytes) -> list[int]:
        """Ids of one match, the leftmost pair of the lowest rank merged first."""
        ids = self.single[list(word)].tolist()
        while len(ids) > 1:
            made = [self.makes(a, b) for a, b in zip(ids, ids[1:], strict=False)]
            rank = min((r for r in made if r >= 0), default=-1)
            if rank < 0:
                break
            at = made.index(rank)
            ids[at : at + 2] = [rank]
        return ids

    def replay(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each match (none of them empty)."""
        line = np.frombuffer(b"".join(words), np.uint8)
        starts = np.cumsum([0, *map(len, words)])
        first = self.bytes_make[line[:-1], line[1:]]
        first[starts[1:-1] - 1] = -1
        after, before = np.arange(1, len(line) + 1), np.arange(-1, len(line) - 1)
        before[starts[:-1]], after[starts[1:] - 1] = -1, -1
        token, after, before, starts = self.single[line].tolist(), after.tolist(), before.tolist(), starts.tolist()
        index = _places(first)
        queue, odd, pairs, makes = sorted(index), set(), self.pairs, self.makes
        while queue:
            rank = heapq.heappop(queue)
            for at in sorted(index.pop(rank)):
                to = after[at]
                if to < 0 or (pairs.get((token[at], token[to])) or makes(token[at], token[to])) != rank:
                    continue
                then, prior = after[to], before[at]
                token[at], token[to], after[at], after[to] = rank, -1, then, -1
                if then >= 0:
                    before[then] = at
                    new = pairs.get((rank, token[then]))
                    if new is None:
                        new = makes(rank, token[then])
                    if new > rank:
                        if new in index:
                            index[new].append(at)
                        else:
                            index[new] = [at]
                            heapq.heappush(queue, new)
                    elif new >= 0:
                        odd.add(bisect_right(starts, at) - 1)
                if prior >= 0:
                    new = pairs.get((token[prior], rank))
                    if new is None:
                        new = makes(token[prior], rank)
                    if new > rank:
                        if new in index:
                            index[new].append(prior)
                        else:
                            index[new] = [prior]
                            heapq.heappush(queue, new)
                    elif new >= 0:
                        odd.add(bisect_right(starts, at) - 1)
        out = [[t for t in token[a:b] if t >= 0] for a, b in zip(starts, starts[1:], strict=False)]
        for n in odd:
            out[n] = self.alone(words[n])
        return out

    def encode(self, matches: Iterable[str]) -> dict[str, bytes]:
        """Ids of distinct matches as little-endian 32-bit integers."""
        out, names, words, size = {}, [], [], 0

        def flush():
            for name, ids in zip(names, self.replay(words), strict=True):
                out[name] = np.array(ids, "<u4").tobytes()
            names.clear()
            words.clear()

        for name in matches:
            word = name.encode()
            whole = self.ranks.get(word)
            if whole is not None or not word:
                out[name] = whole.to_bytes(4, "little") if word else b""
                continue
            names.append(name)
            words.append(word)
            size += len(word)
            if size >= LINE:
                flush()
                size = 0
        if words:
            flush()
        return out


def merges(path: str) -> Merges:
    """The vocabulary of a file of lines with a base64 string and its rank, kept for the life of a worker."""
    if path not in _loaded:
        with open(path, "rb") as lines:
            _loaded[path] = Merges({base64.b64decode(a): int(b) for a, b in (x.split() for x in lines)})
    return _loaded[path]


def _place(ranks: str | None) -> str:
    import public_tokenizers

    return str(ranks or public_tokenizers.path(RANKS))


def encode(docs: DataFrame, key: str = "doc_id", text: str = "text", ranks: str | None = None, pattern: str | None = None) -> DataFrame:
    """(key, n_tokens, ids) for each row of ``docs``; ids are little-endian unsigned 32-bit integers."""
    import public_tokenizers

    path, pattern = _place(ranks), pattern or public_tokenizers.PATTERN

    def run(batches):
        import regex

        vocabulary, find, known, letters = merges(path), regex.compile(pattern).findall, {}, 0
        for batch in batches:
            for part in common.slices(batch, SLICE):
                cut = [find(t or "") for t in part.column(1).to_pylist()]
                distinct = set().union(*cut)
                fresh = distinct - known.keys()
                if len(known) + len(fresh) > MATCHES or letters > LETTERS:
                    known, fresh, letters = {}, distinct, 0
                letters += sum(map(len, fresh))
                known |= vocabulary.encode(fresh)
                ids = [b"".join(map(known.__getitem__, c)) for c in cut]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary())], names=["key", "n_tokens", "ids"])

    schema = f"key {docs.schema[key].dataType.simpleString()}, n_tokens long, ids binary"
    return docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text")).mapInArrow(run, schema).withColumnRenamed("key", key)


def decode(encoded: DataFrame, ids: str = "ids", ranks: str | None = None, name: str = "decoded") -> DataFrame:
    """``encoded`` with the bytes that ``ids`` stand for; null ids give null, an id that the vocabulary lacks is an error."""
    path, columns = _place(ranks), [c for c in encoded.columns if c != name]
    at = columns.index(ids)

    def run(batches):
        strings = merges(path).strings
        for batch in batches:
            for part in common.slices(batch, 4 * SLICE, at):
                out = [None if v is None else b"".join(map(strings.__getitem__, np.frombuffer(v, "<u4").tolist())) for v in part.column(at).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], names=[*columns, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.select(*columns).schema) + f", `{name}` binary"
    return encoded.select(*columns).mapInArrow(run, schema)


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and digests of ids and of decoded bytes of every document."""
    back = decode(encode(common.table(spark, sf_dir, "documents")))
    return back.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
