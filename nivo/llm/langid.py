"""Language identification by cross-parsing texts with suffix automata of labelled text."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nivo.llm.shared import packed, workers_find_package

#: Bounds of the labelled sample: symbols per language, and symbols that one row may add to it.
TRAIN_SYMBOLS = 40_000
ROW_SYMBOLS = 4_000
#: Labels that may be learned; more than these are refused.
MOST_LABELS = 200
#: Codes of a language: 0 is everything but letters, 1 a letter it lacks, then its letters by falling frequency but
#: for END, the end of a text. Moves of codes below SYMBOLS are a table, those of its rarer letters a sorted list.
SYMBOLS, END = 64, 63
#: A text is parsed in blocks of so many symbols, so many of them side by side; phrases go on over a block's end.
BLOCK, SLAB = 256, 1 << 14
#: Times that blocks are begun again side by side; those not settled then are parsed one after the other.
PASSES = 8
UNKNOWN = "und"
SEED = 41

_LETTER = np.array([chr(c).isalpha() for c in range(0x10000)])


def letters(text: str) -> np.ndarray:
    """Code points of the lower-cased text; 0 for a run of anything but letters."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    is_letter = _LETTER[np.minimum(points, 0xFFFF)]
    for at in np.flatnonzero(points > 0xFFFF):
        is_letter[at] = chr(points[at]).isalpha()
    points = np.where(is_letter, points, 0)
    return points[(points != 0) | np.r_[True, points[:-1] != 0]] if len(points) else points


def suffix_automaton(symbols: list[int]) -> list[dict[int, int]]:
    """Moves of the smallest automaton that reads exactly the substrings."""
    moves, link, longest, last = [{}], [-1], [0], 0
    for symbol in symbols:
        new = len(moves)
        moves.append({})
        longest.append(longest[last] + 1)
        link.append(0)
        at = last
        while at != -1 and symbol not in moves[at]:
            moves[at][symbol] = new
            at = link[at]
        if at != -1:
            target = moves[at][symbol]
            if longest[at] + 1 == longest[target]:
                link[new] = target
            else:
                copy = len(moves)
                moves.append(dict(moves[target]))
                longest.append(longest[at] + 1)
                link.append(link[target])
                while at != -1 and moves[at].get(symbol) == target:
                    moves[at][symbol] = copy
                    at = link[at]
                link[target] = link[new] = copy
        last = new
    return moves


def own_codes(symbols: np.ndarray, n: int) -> np.ndarray:
    """A language's code of each of the sample's ``n`` symbols, the last of which ends a text."""
    counts = np.bincount(symbols, minlength=n)
    held = np.flatnonzero(counts[2 : n - 1]) + 2
    held = held[np.argsort(-counts[held], kind="stable")]
    codes = np.arange(2, len(held) + 2)
    own = np.ones(n, np.int32)
    own[held] = codes + (codes >= END)
    own[0], own[n - 1] = 0, END
    return own.astype(np.min_scalar_type(int(own.max())))


@dataclass(frozen=True)
class Parser:
    """Moves of the greedy parse: next state times ``SYMBOLS``, and in bits 30 and up the phrases ended.

    Where the automaton cannot go on, a phrase ends and the next begins with the symbol at hand; a
    symbol that the labelled text lacks is a phrase by itself.
    """

    table: np.ndarray
    #: The moves by codes of SYMBOLS and up: state times ``width`` plus code, sorted, and next state times ``SYMBOLS``.
    width: int
    keys: np.ndarray
    targets: np.ndarray

    def moves(self, state: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        move = self.table.take(state + symbols, mode="clip")
        if len(self.keys):
            rare = np.flatnonzero(symbols >= SYMBOLS)
            if len(rare):
                code = symbols[rare].astype(np.int64)
                key = state[rare] // SYMBOLS * self.width + code
                spot = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                # The first state has a move by each of them; its keys are the codes.
                begin = self.targets[np.searchsorted(self.keys, code)] + np.uint32(1 << 30)
                move[rare] = np.where(self.keys[spot] == key, self.targets[spot], begin)
        return move

    def blocks(self, codes: np.ndarray, first: np.ndarray, carry: int) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that end in each block (a column of codes) and the state after it, as in a parse of whole texts.

        ``first`` marks the blocks that begin a text; the text that the first block may go on with is in
        state ``carry``. All blocks are parsed from the first state; then each one is begun again in the state that
        the block before it ends in, until it comes to a state it had at that place: from there on all is as it was.
        """
        steps, rows = codes.shape
        states, ended = np.empty((steps, rows), np.uint32), np.empty((steps, rows), np.uint8)
        mask = np.uint32((1 << 30) - 1)
        state = np.zeros(rows, np.int64)
        for at in range(steps):
            move = self.moves(state, codes[at])
            ended[at] = move >> 30
            states[at] = state[:] = move & mask
        entry = np.zeros(rows, np.int64)

        def before() -> np.ndarray:
            return np.where(first, 0, np.r_[carry, states[-1, :-1].astype(np.int64)])

        for _ in range(PASSES):
            found = before()
            again = np.flatnonzero(found != entry)
            state = entry[again] = found[again]
            for at in range(steps):
                if not len(again):
                    break
                move = self.moves(state, codes[at, again])
                ended[at, again] = move >> 30
                state = (move & mask).astype(np.int64)
                new = states[at, again] != state
                states[at, again] = state
                again, state = again[new], state[new]
        if (before() != entry).any():
            self._settle(codes, first, carry, entry, states, ended)
        return ended.sum(axis=0, dtype=np.int64), states[-1]

    def _settle(self, codes, first, carry, entry, states, ended) -> None:
        """Blocks in order, each from the state that the one before ends in; for texts of one long repetition."""
        for row in range(codes.shape[1]):
            state = 0 if first[row] else int(states[-1, row - 1]) if row else carry
            if state == entry[row]:
                continue
            for at, code in enumerate(codes[:, row].tolist()):
                if code < SYMBOLS:
                    move = int(self.table[state + code])
                else:
                    move = int(self.moves(np.array([state]), np.array([code]))[0])
                ended[at, row] = move >> 30
                state = move & ((1 << 30) - 1)
                if states[at, row] == state:
                    break
                states[at, row] = state


def parser(symbols: np.ndarray) -> Parser:
    moves = suffix_automaton(symbols.tolist())
    width = max(int(symbols.max(initial=0)) + 1, SYMBOLS)
    one = 1 << 30
    begin = np.full(SYMBOLS, one, np.uint32)
    for symbol, target in moves[0].items():
        if symbol < SYMBOLS:
            begin[symbol] = target * SYMBOLS
    begin[END] = 0
    table = np.empty((len(moves), SYMBOLS), np.uint32)
    table[:] = begin + np.uint32(one)
    table[0] = begin
    rare = {}
    for state, out in enumerate(moves):
        for symbol, target in out.items():
            if symbol < SYMBOLS:
                table[state, symbol] = target * SYMBOLS
            else:
                rare[state * width + symbol] = target * SYMBOLS
    keys = np.array(sorted(rare), np.int64)
    return Parser(table.ravel(), width, keys, np.array([rare[k] for k in keys.tolist()], np.uint32))


@dataclass(frozen=True)
class Sample:
    """What is learned from: all letters of the labelled texts, and each language's symbols.

    Symbol 0 is everything but letters, 1 a letter of none of the texts, then the letters.
    """

    alphabet: tuple[int, ...]
    texts: dict[str, bytes]

    @property
    def digest(self) -> str:
        return hashlib.sha256(repr((self.alphabet, sorted(self.texts.items()))).encode()).hexdigest()

    @property
    def kind(self) -> np.dtype:
        return _kind(self.alphabet)

    def codes(self, points: np.ndarray) -> np.ndarray:
        return _code_table(self.alphabet)[points]


_tables: dict[tuple[int, ...], np.ndarray] = {}


def _kind(alphabet: tuple[int, ...]) -> np.dtype:
    return np.min_scalar_type(len(alphabet) + 2)


def _code_table(alphabet: tuple[int, ...]) -> np.ndarray:
    if alphabet not in _tables:
        table = np.ones(0x110000, _kind(alphabet))
        table[0] = 0
        table[list(alphabet)] = np.arange(2, len(alphabet) + 2)
        _tables.clear()
        _tables[alphabet] = table
    return _tables[alphabet]


def sample_of(rows: list[tuple[str, str]], train_symbols: int = TRAIN_SYMBOLS) -> Sample:
    """The sample of labelled texts, in the order given, up to the bound per language."""
    held: dict[str, list[np.ndarray]] = {}
    for lang, text in rows:
        points = letters(text)
        if points.any():
            held.setdefault(lang, []).append(np.r_[points, np.uint32(0)])
    joined = {lang: np.concatenate(parts)[:train_symbols] for lang, parts in held.items()}
    found: set[int] = set()
    for points in joined.values():
        found.update(np.unique(points[points != 0]).tolist())
    sample = Sample(tuple(sorted(found)), {})
    sample.texts.update({lang: sample.codes(points).tobytes() for lang, points in sorted(joined.items())})
    return sample


class Model:
    """Parse tables of all languages, and the bits a phrase of each counts."""

    def __init__(self, sample: Sample):
        self.sample = sample
        self.languages = sorted(sample.texts)
        codes = [np.frombuffer(sample.texts[lang], sample.kind) for lang in self.languages]
        #: The sample's symbols, and one that ends a text.
        self.end = len(sample.alphabet) + 2
        self.own = [own_codes(symbols, self.end + 1) for symbols in codes]
        self.parsers = [parser(own[symbols]) for own, symbols in zip(self.own, codes)]
        self.bits = np.array([np.log2(max(len(symbols), 2)) for symbols in codes])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """Phrases per text and language; texts as symbols."""
        lengths = np.array([len(t) for t in texts], np.int64)
        blocks = -(-lengths // BLOCK)
        rows = int(blocks.sum())
        found = np.zeros((len(texts), len(self.languages)))
        if not rows:
            return found
        grid = np.full((rows, BLOCK), self.end, np.min_scalar_type(self.end))
        begin = np.cumsum(blocks) - blocks
        for text, row, size in zip(texts, begin, lengths):
            grid.reshape(-1)[row * BLOCK : row * BLOCK + size] = text
        owner = np.repeat(np.arange(len(texts)), blocks)
        first = np.r_[True, owner[1:] != owner[:-1]]
        last = np.r_[first[1:], True]
        carry = [0] * len(self.languages)
        for low in range(0, rows, SLAB):
            part = slice(low, low + SLAB)
            symbols = np.ascontiguousarray(grid[part].T)
            for at, (own, parse) in enumerate(zip(self.own, self.parsers)):
                count, state = parse.blocks(own[symbols], first[part], carry[at])
                carry[at] = int(state[-1])
                # A text that fills its last block ends a phrase with it.
                count += last[part] & (state != 0)
                found[:, at] += np.bincount(owner[part], weights=count, minlength=len(texts))
        return found

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and bits per symbol of each text."""
        points = [letters(text) if text else np.empty(0, np.uint32) for text in texts]
        known = np.array([bool(p.any()) for p in points], bool)
        symbols = [self.sample.codes(p) if ok else np.empty(0, self.sample.kind) for p, ok in zip(points, known)]
        if not self.languages or not known.any():
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
        sizes = np.maximum(np.array([len(s) for s in symbols]), 1)
        rates = self.phrases(symbols) * self.bits / sizes[:, None]
        best = rates.argmin(axis=1)  # Of equal ones, the first in code point order.
        least = rates[np.arange(len(texts)), best]
        if len(self.languages) > 1:
            second = np.partition(rates, 1, axis=1)[:, 1]
            score = 1 - least / np.maximum(second, 1e-12)
        else:
            score = np.ones(len(texts))
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, known)]
        return names, np.where(known, np.clip(score, 0, 1), 0.0), np.where(known, least, 0.0)


_models: dict[str, Model] = {}


def _model(sample: Sample, digest: str) -> Model:
    """Built once per worker process."""
    if digest not in _models:
        _models.clear()
        _models[digest] = Model(sample)
    return _models[digest]


#: Characters that are parsed at a time.
BATCH_CHARS = 4 << 20


def _predictor(shared: Broadcast, digest: str):
    def predict(columns: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        model = _model(shared.value, digest)
        for column in columns:
            parts, held, size = [], [], 0
            for text in column:
                held.append(text)
                size += len(text or "")
                if size >= BATCH_CHARS:
                    parts.append(model.predict(held))
                    held, size = [], 0
            parts.append(model.predict(held))
            yield pd.DataFrame(
                {
                    "lang": [lang for names, _, _ in parts for lang in names],
                    "score": np.concatenate([scores for _, scores, _ in parts]),
                    "bits": np.concatenate([bits for _, _, bits in parts]),
                }
            )

    return predict


def learn(
    labelled: DataFrame,
    text: str = "text",
    lang: str = "lang",
    key: str = "doc_id",
    train_symbols: int = TRAIN_SYMBOLS,
    row_symbols: int = ROW_SYMBOLS,
) -> Sample:
    """A bounded sample of the labelled rows: ``train_symbols`` per language, ``row_symbols`` of a row at most.

    Rows are drawn by a hash of their key at a rate that gives each language about twice the
    symbols needed, and twenty rows at least. Rows without text or label are not learned from.
    """
    rows = labelled.select(
        F.col(f"`{lang}`").alias("lang"),
        F.col(f"`{text}`").alias("text"),
        F.xxhash64(F.lit(SEED), F.col(f"`{key}`").cast("string")).alias("draw"),
    ).where("lang IS NOT NULL AND text IS NOT NULL AND text <> ''")
    share = F.least(F.length("text"), F.lit(row_symbols))
    sizes = rows.groupBy("lang").agg(F.sum(share).alias("symbols"), F.count(F.lit(1)).alias("rows"))
    # One row per label; more labels than this are no languages.
    found = sizes.limit(MOST_LABELS + 1).collect()
    if len(found) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    if not found:
        return Sample((), {})
    rates = F.create_map(
        *[
            F.lit(x)
            for row in found
            for x in (
                row["lang"],
                float(min(1.0, max(2 * train_symbols / row["symbols"], 20 / row["rows"]))),
            )
        ]
    )
    drawn = F.pmod(F.col("draw"), F.lit(1_000_000)) < rates[F.col("lang")] * 1_000_000
    # Twice the symbols wanted of at most MOST_LABELS languages: a few MB.
    sample = rows.where(drawn).select("lang", F.substring("text", 1, row_symbols).alias("text"), "draw")
    ordered = sorted((tuple(r) for r in sample.collect()), key=lambda r: (r[0], r[2], r[1]))
    return sample_of([(lang, text) for lang, text, _ in ordered], train_symbols)


def identify(docs: DataFrame, sample: Sample, text: Column | None = None) -> DataFrame:
    """The rows with ``lang_pred``, ``lang_score`` and ``lang_bits``, from their whole texts; no shuffle.

    Each language's labelled text is held as a suffix automaton. A text, reduced to lower-case
    letters and single blanks, is parsed greedily into the longest phrases that occur in the labelled text; a
    phrase counts log2 of the labelled text's length in bits, as it points into it. The
    language with the fewest bits per symbol wins, ``lang_bits``; the score is 1 less the ratio of the best and
    the second best. All letters of the sample are told apart; a letter that a language's text lacks is a
    phrase by itself. The sample (TRAIN_SYMBOLS symbols per language) is broadcast, and the automata
    are built once per worker.

    Texts that are NULL or without letters are ``und`` with score 0, as is everything if nothing
    was learned. Repeated rows have equal results; an empty table gives no rows. Input columns
    with the names of the results are replaced.
    """
    spark = docs.sparkSession
    workers_find_package(spark)
    body = F.col("text") if text is None else text
    predict = F.pandas_udf(
        _predictor(spark.sparkContext.broadcast(sample), sample.digest),
        "lang string, score double, bits double",
    )
    return docs.select(
        packed(docs, "lang_pred", "lang_score", "lang_bits").alias("row"), predict(body).alias("found")
    ).select(
        "row.*",
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("lang_score"),
        F.col("found.bits").alias("lang_bits"),
    )


def fold(key: str = "doc_id") -> Column:
    """0 to 4 by the CRC of the key's text; -1 where the key is NULL."""
    return F.coalesce(F.pmod(F.crc32(F.col(f"`{key}`").cast("string")), F.lit(5)), F.lit(-1))
