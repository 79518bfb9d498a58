"""Greedy word-piece token counts by a linear longest-match automaton."""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from nivo.llm.shared import packed, workers_find_package

#: Bytes a lockstep row covers before it ends with its word, and the length from which a row is walked alone.
STRIDE = 256
LONG = 8_192
BLANK = 0x20


def load(path: str) -> list[bytes]:
    """The pieces of a rank file (a base64 piece and a number per line)."""
    with open(path, "rb") as lines:
        return [base64.b64decode(line.split()[0]) for line in lines if line.strip()]


class Automaton:
    """Trie of the pieces with failure links, closed into one table of moves.

    Words are read with a leading blank, as the pieces that begin a word have it; a piece with a blank
    elsewhere never matches. A node is a piece's prefix that is read but not yet cut up. Its
    failure link is the node left after its longest pieces are taken off the front, and its
    popped count is how many those are. Where a node has no child for a byte, the pops are made
    until one has; the table holds the outcome, so that each byte is one look-up: the next
    node, and in the bits above ``shift`` the pieces popped. A blank pops all that is left and begins
    a word. Bytes that are not in the vocabulary are pieces of their own.
    """

    def __init__(self, pieces: list[bytes]):
        whole = {p for p in pieces if p and BLANK not in p[1:]} | {bytes([b]) for b in range(256)}
        children: list[dict[int, int]] = [{}]
        is_piece = [False]
        for piece in sorted(whole):
            node = 0
            for byte in piece:
                step = children[node].get(byte)
                if step is None:
                    step = len(children)
                    children[node][byte] = step
                    children.append({})
                    is_piece.append(False)
                node = step
            is_piece[node] = True
        fail, pops, order = [0] * len(children), [0] * len(children), [0]
        for node in order:  # By depth: a failure link leads to a shorter string.
            for byte, child in children[node].items():
                order.append(child)
                if is_piece[child]:
                    fail[child], pops[child] = 0, 1
                    continue
                at, count = fail[node], pops[node]
                while byte not in children[at]:
                    count += pops[at]
                    at = fail[at]
                fail[child], pops[child] = children[at][byte], count
        self.shift = (len(children) * 256 - 1).bit_length()
        rest = [0] * len(children)
        table = np.zeros((len(children), 256), np.uint64)
        most = 0
        for node in order:
            row = table[node]
            if node:
                rest[node] = pops[node] + rest[fail[node]]
                row[:] = table[fail[node]] + np.uint64(pops[node] << self.shift)
            for byte, child in children[node].items():
                row[byte] = child << 8
            row[BLANK] = (children[0][BLANK] << 8) | (rest[node] << self.shift)
            most = max(most, int(row.max()))
        kind = np.uint32 if most < 1 << 32 else np.uint64
        self.table = table.astype(kind).ravel()

    def count(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Words and pieces of each text; white space as ``bytes.split`` takes it."""
        split = [text.split() for text in texts]
        n_words = np.array([len(words) for words in split], np.int64)
        n_pieces = np.zeros(len(texts), np.int64)
        has = np.flatnonzero(n_words)
        if not len(has):
            return n_words, n_pieces
        stream = np.frombuffer(b" ".join([b"", *[b" ".join(split[i]) for i in has], b""]), np.uint8)
        del split
        blanks = np.flatnonzero(stream == BLANK)
        firsts = blanks[np.r_[0, np.cumsum(n_words[has])]]  # The blank before each text, and the last.
        marks = blanks[np.searchsorted(blanks, np.arange(0, len(stream) - 1, STRIDE))]
        cuts = np.unique(np.concatenate([firsts, marks]))
        starts, lengths = cuts[:-1], np.diff(cuts) + 1  # A row ends with the blank that begins the next.
        owner = np.searchsorted(firsts, starts, side="right") - 1
        pieces = np.zeros(len(starts), np.int64)
        for row in np.flatnonzero(lengths > LONG):
            pieces[row] = self._walk(stream[starts[row] : starts[row] + lengths[row]].tobytes())
        rows = np.flatnonzero(lengths <= LONG)
        rows = rows[np.argsort(-lengths[rows], kind="stable")]
        pieces[rows] = self._lockstep(stream, starts[rows], lengths[rows])
        n_pieces[has] = np.bincount(owner, weights=pieces, minlength=len(has)).astype(np.int64)
        return n_words, n_pieces

    def _lockstep(self, stream: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Rows of falling length walked side by side, a byte of each at a time."""
        kind = self.table.dtype.type
        mask, shift = kind((1 << self.shift) - 1), kind(self.shift)
        node, popped, at = np.zeros(len(starts), kind), np.zeros(len(starts), np.int64), starts.copy()
        active = len(starts)
        for step in range(int(lengths[0]) if active else 0):
            while active and lengths[active - 1] <= step:
                active -= 1
            move = self.table[node[:active].astype(np.int64) + stream[at[:active]]]
            popped[:active] += move >> shift
            node[:active] = move & mask
            at[:active] += 1
        return popped

    def _walk(self, row: bytes) -> int:
        node, popped, mask, table = 0, 0, (1 << self.shift) - 1, self.table
        for byte in row:
            move = int(table[node + byte])
            popped += move >> self.shift
            node = move & mask
        return popped


_built: dict[str, Automaton] = {}


def _automaton(pieces: list[bytes], digest: str) -> Automaton:
    """Built once per worker process."""
    if digest not in _built:
        _built.clear()
        _built[digest] = Automaton(pieces)
    return _built[digest]


#: Bytes of text that are walked at a time.
BATCH_BYTES = 16 << 20


def _counter(shared: Broadcast, digest: str):
    def count(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        automaton = _automaton(shared.value, digest)
        for column in columns:
            parts, held, size = [], [], 0
            for text in column:
                held.append(b"" if text is None else text.encode("utf-8", "surrogatepass"))
                size += len(held[-1])
                if size >= BATCH_BYTES:
                    parts.append(automaton.count(held))
                    held, size = [], 0
            parts.append(automaton.count(held))
            yield pd.DataFrame(
                {
                    "n_words": np.concatenate([words for words, _ in parts]),
                    "n_tokens": np.concatenate([pieces for _, pieces in parts]),
                }
            )

    return count


def counter(spark: SparkSession, path: str) -> "callable":
    """A column function: text -> struct of ``n_words`` and ``n_tokens``. The vocabulary file bounds the broadcast."""
    workers_find_package(spark)
    pieces = load(path)
    digest = hashlib.sha256(b"\n".join(pieces)).hexdigest()
    return F.pandas_udf(
        _counter(spark.sparkContext.broadcast(pieces), digest), "n_words long, n_tokens long"
    )


def count_tokens(docs: DataFrame, path: str, text: Column | None = None) -> DataFrame:
    """The rows with ``n_bytes``, ``n_words`` and ``n_tokens`` of their whole texts; no shuffle.

    A word is a run between ASCII white space; its pieces are the longest in the vocabulary, taken
    greedily from its beginning. Lengths only: no piece is ever built. NULL and blank texts
    have no words and no tokens (NULL: 0 bytes). Repeated rows are counted each, and an empty table gives
    no rows. Input columns with the names of the results are replaced.
    """
    body = F.col("text") if text is None else text
    count = counter(docs.sparkSession, path)
    return docs.select(
        packed(docs, "n_bytes", "n_words", "n_tokens").alias("row"),
        F.coalesce(F.octet_length(body), F.lit(0)).cast("long").alias("n_bytes"),
        count(body).alias("found"),
    ).select("row.*", "n_bytes", "found.n_words", "found.n_tokens")
