"""LM scoring by a hidden Markov language model.

A text is its words (white-space bounded, A-Z lower-cased) and one end token. A latent
state goes from token to token and emits the word: in state j word w has probability

    (n_j(w) + BETA p(w)) / (N_j + BETA),    p(w) = (c(w) + 1) / (N + V + 1)

n_j(w) is its expected count in the state, N_j their sum, c its count, N all training
tokens, V the distinct ones; a word that training hasn't seen has n_j = c = 0. So every state
is a distribution over the same events as the add-one unigrams, and a text's
probability is the sum over all state paths, exactly, by the scaled forward recursion.

Training, on the documents that aren't held out (crc32 of the id mod 7 is not 2):

1. Texts are written as BUCKETS hashed word classes, two bytes a token. On them, from random factors of
   classes that no text decides, rounds of a mixture of unigrams (each text in one
   state) and then Baum-Welch rounds run over all training texts, until the log likelihood a token
   rises by less than SETTLED or the rounds end. Every task gives expected counts (BUCKETS x STATES numbers, 32 KB a
   row, summed in two steps), and the driver takes the new parameters from them.
2. A last Baum-Welch round counts words themselves: a table of a row a word (c, n_j), summed by word.
   It grows with the corpus; no word is pooled with others.
3. BETA: states are only trusted as far as they carry over to other texts. The round keeps
   the counts of two halves of the texts apart; of a grid of values the one that
   gives each half the most likelihood by the other's counts is taken.

Scores: the HEAD most frequent words travel to the tasks; of the others, each block of
texts (of BLOCK_TOKENS or one longer text) is joined with the rows that it needs. Words travel
packed, a row for all of a part of the table, since a row a word costs more than its arithmetic.

Long texts: a text of over CHUNK tokens is cut into chunks, each run from every state at once; their
transfer matrices give the state vectors at all borders, and then chunks are independent of each
other. Neither the length of a loop nor what is held of a text at once (GROUP tokens) grows with the text.

Base score: add-one unigrams over training tokens, as the contract has it.

Words are known by 64-bit hashes. Defined results: null texts are empty and have the
end token alone; a null doc_id is not held out; repeated rows each count and each give a
row; without training texts every count is 0; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import NONSPACE, Block, blocks, free, stash, table

STATES = 8
BUCKETS = 1 << 15
HEAD = 32_768
MIXTURE_ROUNDS, CLASS_ROUNDS = 8, 5
#: Rise of the log likelihood a token (natural) below which rounds end.
SETTLED = 0.005
#: How many tokens the unigram counts for in a state's emissions while classes are trained.
PRIOR = 200.0
BETAS = [4.0**k for k in range(16)]
CHUNK = 2048
#: Tokens whose state vectors are held at once.
GROUP = 800_000
#: Tokens of the texts from which such groups are made: so many that texts of a group are alike in length.
HELD = 4_000_000
#: Tokens of the texts that meet the table of words together.
BLOCK_TOKENS = 4_000_000
#: Tokens of training for each partition of the table of words; and its partitions at most.
WORD_TOKENS, WORD_PARTS = 2_000_000, 20_000
#: Expected counts of a word below this share of its count go to its likeliest state, so that rows pack well.
LEAST = 1e-3
#: The end token's hash.
END = np.uint64(0x0E4D0E4D0E4D0E4D)
_PART = 1024


def held_out() -> Column:
    """Whether a document is held out."""
    return F.coalesce(F.pmod(F.crc32(F.encode(F.col("doc_id").cast("string"), "UTF-8")), F.lit(7)) == 2, F.lit(False))


def tokens_of(block: Block) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of the tokens, where each text's begin, with the end)."""
    return np.insert(block.word_hashes(), block.first[1:], END), block.first + np.arange(len(block) + 1)


def classes_of(h: np.ndarray) -> np.ndarray:
    return np.where(h == END, np.uint64(BUCKETS), h >> np.uint64(64 - int(BUCKETS).bit_length() + 1)).astype(np.uint16)


class Model:
    """Start and transition probabilities, and the emissions of symbols (a row each, by state)."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    def update(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray, unigram: np.ndarray, prior: float = PRIOR) -> Model:
        """New parameters from expected counts; emissions shrink towards the unigram."""
        norm = lambda x, axis=-1: x / x.sum(axis=axis, keepdims=True)
        return Model(norm(start + 0.1), norm(move + 0.1), norm(emit + prior * unigram[:, None], 0))


class Chunks:
    """Texts, one behind the other, in chunks of CHUNK symbols at most, and their forward and backward recursions.

    `starts` bounds the texts. Chunk r has the symbols a[r] to a[r] + n[r]; first tells whether a text begins there.
    """

    def __init__(self, m: Model, symbols: np.ndarray, starts: np.ndarray, chunk: int | None = None):
        chunk = chunk or CHUNK
        self.m, self.symbols = m, symbols
        # a small table is gathered state by state, in the caches
        self.by_state = np.ascontiguousarray(m.emit.T) if len(m.emit) <= 2 * BUCKETS else None
        many = -(-np.diff(starts) // chunk)
        self.texts, self.owner = len(many), np.repeat(np.arange(len(many)), many)
        inside = np.arange(len(self.owner)) - np.repeat(np.cumsum(many) - many, many)
        self.a = starts[:-1][self.owner] + inside * chunk
        self.n = np.minimum(chunk, starts[1:][self.owner] - self.a)
        self.first, self.long = inside == 0, many[self.owner] > 1
        # the state weights before each chunk, and those that what follows it gives its last state
        self.begin, self.final = np.tile(m.start, (len(self.a), 1)), np.ones((len(self.a), len(m.start)))
        # the last state vector of the chunk before
        self.before = np.zeros_like(self.final)

    def _groups(self, rows: np.ndarray, most: int) -> Iterator[np.ndarray]:
        """Runs of chunks with so many symbols at most (or one longer), of chunks alike in length: what a group costs beside its symbols is a loop over the longest."""
        rows = rows[np.argsort(-self.n[rows], kind="stable")]
        run = (np.cumsum(self.n[rows]) - 1) // max(most, 1)
        for g in np.split(rows, np.flatnonzero(np.diff(run)) + 1):
            if len(g):
                yield g

    def _steps(self, rows: np.ndarray):
        """How chunks are laid out: by step, the longest chunks first, so that each step of all of them is one slice.

        (the order of chunks, its inverse, where each step begins, its chunks, the chunk and the symbol of each place, the emissions: states by places)"""
        order = np.argsort(-self.n[rows], kind="stable")
        n, a = self.n[rows][order], self.a[rows][order]
        active = np.searchsorted(-n, -np.arange(int(n[0])), side="left")
        at = np.concatenate([[0], np.cumsum(active)])
        rank = np.arange(at[-1]) - np.repeat(at[:-1], active)
        flat = a[rank] + np.repeat(np.arange(len(active)), active)
        back = np.empty_like(order)
        back[order] = np.arange(len(order))
        # by state, so that sums and quotients over states run along the chunks
        e = np.take(self.by_state, self.symbols[flat], axis=1) if self.by_state is not None else np.ascontiguousarray(np.take(self.m.emit, self.symbols[flat], axis=0).T)
        return order, back, at, active, rank, flat, e

    def _forward(self, rows: np.ndarray, begin: np.ndarray, keep: bool = False):
        """(log probabilities, last state vectors) of chunks from these state weights before them; kept: also what the backward recursion needs."""
        order, back, at, active, rank, flat, e = self._steps(rows)
        scale, move = np.empty(e.shape[1], dtype=e.dtype), self.m.move.T.astype(e.dtype)
        alpha = np.empty_like(e) if keep else e
        for t, (a, k) in enumerate(zip(at.tolist(), active.tolist(), strict=False)):
            s = slice(a, a + k)
            x, c = alpha[:, s], scale[s]
            np.multiply(move @ before[:, :k] if t else begin[order].T, e[:, s], out=x, casting="same_kind")
            np.add.reduce(x, axis=0, out=c)
            x /= c
            before = x
        last = alpha[:, at[self.n[rows][order] - 1] + np.arange(len(order))].T
        logs = np.bincount(rank, weights=np.log(scale, dtype=float), minlength=len(order))
        out = logs[back], last[back]
        return (*out, (order, back, at, active, flat, alpha, scale, e)) if keep else out

    def _transfers(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Chunks' transfer matrices, from the state before a chunk (where a text begins, any) to its last, and the logarithms that were taken out of them."""
        order, back, at, active, rank, _, e = self._steps(rows)
        states, firsts = len(self.m.start), self.first[rows][order]
        scale, move = np.empty(e.shape[1], dtype=e.dtype), self.m.move.T.astype(e.dtype)
        # by last state, state before and chunk: an emission serves all states before, and one scale a chunk all of its matrix
        x = np.where(firsts, self.m.start[:, None, None], self.m.move.T[:, :, None]).astype(e.dtype)
        ends = np.empty_like(x)
        for t, (a, k) in enumerate(zip(at.tolist(), active.tolist(), strict=False)):
            s = slice(a, a + k)
            if k < x.shape[2]:
                ends[:, :, k : x.shape[2]] = x[:, :, k:]
                x = x[:, :, :k].copy()
            if t:
                x = (move @ x.reshape(states, -1)).reshape(x.shape)
            x *= e[:, None, s]
            np.add.reduce(x.reshape(-1, k), axis=0, out=scale[s])
            x /= scale[s]
        ends[:, :, : x.shape[2]] = x
        logs = np.bincount(rank, weights=np.log(scale, dtype=float), minlength=len(order))
        return logs[back], ends.transpose(2, 1, 0)[back].astype(float)

    def _borders(self) -> np.ndarray:
        """Begin and final vectors of the chunks of long texts, and their log probabilities."""
        logs, transfer = np.zeros(len(self.a)), {}
        for g in self._groups(np.flatnonzero(self.long), GROUP):
            logs[g], ways = self._transfers(g)
            transfer |= zip(g.tolist(), ways, strict=True)
        last = None
        for r in sorted(transfer):  # from left to right
            t = transfer[r]
            if self.first[r]:
                v = t[0]
            else:
                self.before[r], self.begin[r] = last, last @ self.m.move
                v = last @ t
            logs[r] += math.log(v.sum())
            last = v / v.sum()
        for r in sorted(transfer, reverse=True):
            if not self.first[r]:
                v = transfer[r] @ self.final[r]
                self.final[r - 1] = v / v.sum()
        return logs

    def logs(self) -> np.ndarray:
        """Log probability of each text."""
        logs = self._borders()
        for g in self._groups(np.flatnonzero(~self.long), GROUP):
            logs[g] = self._forward(g, self.begin[g])[0]
        return np.bincount(self.owner, weights=logs, minlength=self.texts)

    def expect(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, float]]:
        """Expected counts, by groups of chunks: (start, moves, the symbols' positions, their states (a row a state), log probability)."""
        states = len(self.m.start)
        self._borders()
        for g in self._groups(np.arange(len(self.a)), GROUP):
            logs, last, (order, back, at, active, flat, alpha, scale, e) = self._forward(g, self.begin[g], True)
            final = self.final[g] / (self.final[g] * last).sum(axis=1, keepdims=True)
            beta = np.ascontiguousarray(final[order].T.astype(e.dtype))  # of chunks that end before a step, still their final
            move = self.m.move.astype(e.dtype)
            moves = np.zeros((states, states))
            e /= scale
            n = 0
            for a, k in zip(at[-2::-1].tolist(), active[::-1].tolist(), strict=True):
                if n:
                    now = beta[:, :n] * e[:, a + k : a + k + n]
                    moves += alpha[:, a : a + n] @ now.T
                    np.matmul(move, now, out=beta[:, :n])
                alpha[:, a : a + k] *= beta[:, :k]
                n = k
            moves *= self.m.move
            first = alpha[:, : len(g)].T[back]
            later = np.flatnonzero(~self.first[g])  # from the chunk before
            moves += self.m.move * (self.before[g[later]].T @ (first[later] / np.maximum(self.begin[g[later]], 1e-300)))
            yield first[self.first[g]].sum(axis=0), moves, flat, alpha, float(logs.sum())


def starting_model(unigram: np.ndarray, states: int) -> Model:
    """States that stay; each emits the unigram, told apart by random factors."""
    move = np.full((states, states), 0.02 / max(states - 1, 1)) + np.eye(states) * (0.98 - 0.02 / max(states - 1, 1))
    emit = unigram[:, None] * np.exp(np.random.default_rng(11).normal(size=(len(unigram), states)))
    return Model(np.full(states, 1 / states), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=0))


def mixture(m: Model, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts where each text is in one state: texts by state, no moves, emissions; and the log likelihood."""
    states, n, symbols = len(m.start), np.diff(starts), symbols.astype(np.int64)
    logs = np.add.reduceat(np.take(np.log(np.maximum(m.emit, 1e-30)).astype(np.float32), symbols, axis=0), starts[:-1], axis=0, dtype=float) + np.log(m.start + 1e-9)
    top = logs.max(axis=1, keepdims=True)
    # kept soft, so that no state takes all
    share = np.exp((logs - top) / np.maximum(1, n[:, None] / 50))
    share /= share.sum(axis=1, keepdims=True)
    emit = np.stack([np.bincount(symbols, weights=np.repeat(share[:, j], n), minlength=len(m.emit)) for j in range(states)], axis=1)
    return share.sum(axis=0), np.zeros((states, states)), emit, float((top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))).sum())


def baum_welch(m: Model, symbols: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts over all state paths: starts, moves, emissions; and the log likelihood."""
    c = Chunks(m, symbols, starts)
    start, moves, emit, log = np.zeros(len(m.start)), np.zeros(m.move.shape), np.zeros(m.emit.shape), 0.0
    for s, v, span, states, p in c.expect():
        start, moves, log, seen = start + s, moves + v, log + p, symbols[span].astype(np.int64)
        for j in range(len(start)):
            emit[:, j] += np.bincount(seen, weights=states[j], minlength=len(emit))
    return start, moves, emit, log


_DENSE = "part int, sub int, v binary"


def _dense(total: tuple, sub: int) -> pa.Table:
    """Expected counts as rows of 32 KB."""
    parts = -(-len(total[2]) // _PART)
    small = np.concatenate([total[0], total[1].ravel(), [total[3]]])
    values = [small.tobytes(), *(total[2][i * _PART : (i + 1) * _PART].astype(np.float32).tobytes() for i in range(parts))]
    return pa.table({"part": pa.array(np.arange(-1, parts, dtype=np.int32)), "sub": pa.array(np.full(parts + 1, sub % 32, dtype=np.int32)), "v": pa.array(values, pa.binary())})


def _sum_dense(rows: DataFrame, states: int, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts from such rows."""
    parts = -(-size // _PART)

    def add(t: pa.Table) -> pa.Table:
        part = t["part"][0].as_py()
        kind = np.float64 if part < 0 else np.float32
        total = sum(np.frombuffer(x, dtype=kind).astype(np.float64) for x in t["v"].to_pylist())
        return pa.table({"part": pa.array([part], pa.int32()), "v": pa.array([total.astype(kind).tobytes()], pa.binary())})

    sums = rows.groupBy("part", "sub").applyInArrow(add, "part int, v binary").groupBy("part").applyInArrow(add, "part int, v binary")
    got = {r.part: r.v for r in sums.collect()}  # the size of the dense part
    if not got:
        return np.zeros(states), np.zeros((states, states)), np.zeros((size, states)), 0.0
    small = np.frombuffer(got[-1])
    emit = np.concatenate([np.frombuffer(got[i], dtype=np.float32).reshape(-1, states) for i in range(parts)]).astype(float) if size else np.zeros((0, states))
    return small[:states], small[states:-1].reshape(states, states), emit, float(small[-1])


def _round(encoded: DataFrame, m: Model, step, most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Expected counts of a step (mixture or baum_welch) over all rows of (symbols), of texts of so many tokens (or one longer) at once."""
    sent = encoded.sparkSession.sparkContext.broadcast(Model(m.start, m.move, m.emit.astype(np.float32)))

    def held(rows: Iterator[pa.RecordBatch]) -> Iterator[list[np.ndarray]]:
        texts, n = [], 0
        for x in (np.frombuffer(x.as_py(), dtype=np.uint16) for r in rows for x in r.column(0)):
            if texts and n + len(x) > most:
                yield texts
                texts, n = [], 0
            texts.append(x)
            n += len(x)
        if texts:
            yield texts

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, total = sent.value, None
        for texts in held(rows):
            got = step(m, np.concatenate(texts), np.concatenate([[0], np.cumsum([len(x) for x in texts])]))
            total = got if total is None else tuple(x + y for x, y in zip(total, got, strict=True))
        if total is not None:
            yield from _dense(total, TaskContext.get().partitionId()).to_batches()

    out = _sum_dense(encoded.select("symbols").mapInArrow(run, _DENSE), len(m.start), len(m.emit))
    sent.destroy()
    return out


def train_states(encoded: DataFrame, states: int) -> tuple[Model, int]:
    """A model of classes of words, from the texts in (symbols); and how many tokens these have."""
    size = BUCKETS + 1
    count = _round(encoded, Model(np.ones(1), np.ones((1, 1)), np.full((size, 1), 1 / size)), mixture, GROUP)[2][:, 0]
    unigram, tokens = (count + 1) / (count.sum() + size), max(count.sum(), 1)
    m = starting_model(unigram, states)
    for step, rounds, most in ((mixture, MIXTURE_ROUNDS, GROUP), (baum_welch, CLASS_ROUNDS, HELD)):
        last = -math.inf
        for _ in range(rounds):
            start, move, emit, log = _round(encoded, m, step, most)
            new = m.update(start, move, emit, unigram)
            m = Model(new.start, m.move if step is mixture else new.move, new.emit)
            if log / tokens - last < SETTLED:
                break
            last = log / tokens
    return m, round(count.sum())


def _encode(texts: DataFrame) -> DataFrame:
    """(symbols): the word classes of each text, two bytes a token."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, block in blocks(batch.column(0), NONSPACE):
                h, starts = tokens_of(block)
                symbols = classes_of(h)
                yield pa.RecordBatch.from_arrays([_cut(symbols, starts)], ["symbols"])

    return texts.select("text").mapInArrow(run, "symbols binary")


def _cut(rows: np.ndarray, at: np.ndarray) -> pa.Array:
    """Runs of rows, bounded by `at`, as binaries, without a Python object for each."""
    rows = np.ascontiguousarray(rows)
    return pa.Array.from_buffers(pa.binary(), len(at) - 1, [None, pa.py_buffer((at * (rows.nbytes // max(len(rows), 1))).astype(np.int32)), pa.py_buffer(rows)])


def _packed(n: np.ndarray) -> pa.Array:
    """Rows of numbers as binaries."""
    return _cut(np.asarray(n, dtype=np.float32), np.arange(len(n) + 1))


def unpacked(column: pa.ChunkedArray | pa.Array, states: int) -> np.ndarray:
    """The numbers of such rows, from the buffers (a Python object a row costs more than all that is done with it); a null is an error."""
    parts = [np.empty(0, dtype=np.uint8)]
    for x in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        if len(x):
            wide = np.int64 if pa.types.is_large_binary(x.type) else np.int32
            at = np.frombuffer(x.buffers()[1], dtype=wide)[x.offset : x.offset + len(x) + 1]
            parts.append(np.frombuffer(x.buffers()[2] or b"", dtype=np.uint8)[at[0] : at[-1]])
    return np.concatenate(parts).view(np.float32).reshape(len(column), states).astype(float)


def parts_of(tokens: int) -> int:
    """Parts of the table of words."""
    return min(WORD_PARTS, max(1, -(-tokens // WORD_TOKENS)))


def _dealt(h: np.ndarray, parts: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """How words are dealt to the parts of a table: their order by part, the parts that have any, and the bounds of each."""
    part = (h.view(np.uint64) >> np.uint64(24)) % np.uint64(parts)
    order = np.argsort(part, kind="stable")
    ids, first = np.unique(part[order], return_index=True)
    return order, pa.array(ids.astype(np.int32)), np.append(first, len(h))


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    """The numbers of a column of binaries, one row behind the other."""
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _clear(n: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Expected counts with the very small ones added to the largest."""
    small = n < LEAST * c[:, None]
    lost = np.where(small, n, 0).sum(axis=1)
    n = np.where(small, 0, n)
    n[np.arange(len(n)), n.argmax(axis=1)] += lost
    return n


def _merged(h: np.ndarray, *columns: np.ndarray) -> list[np.ndarray]:
    """Distinct h, and the columns summed by it."""
    order = np.argsort(h, kind="stable")
    h = h[order]
    at = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.empty(0, dtype=np.int64)
    return [h[at], *(np.add.reduceat(c[order], at, axis=0) if len(at) else c for c in columns)]


class Fitted:
    """A trained model: start and moves, and the table of words, (h, c, n; d, m: c and n of one half of the texts), with all that their probabilities need."""

    def __init__(self, start: np.ndarray, move: np.ndarray, words: DataFrame, totals: np.ndarray):
        """totals: sums of n, of m, of c, of d, and the number of words."""
        states = len(start)
        self.start, self.move, self.words = start, move, words
        self.state_n, self.half_n = totals[:states], totals[states : 2 * states]
        self.n, self.half, self.v = (round(x) for x in totals[2 * states :].tolist())
        self.beta = self._choose() if self.v else BETAS[0]

    def emissions(self, c: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Of words with these counts and expected counts (0: unknown)."""
        return emissions(c, n, self.law())

    def law(self) -> tuple[int, int, float, np.ndarray]:
        return self.n, self.v, self.beta, self.state_n

    def _choose(self) -> float:
        """Of BETAS the one under which the halves of the texts tell most of each other."""
        states, v = len(self.start), self.v
        sides = [(self.half_n, self.half), (self.state_n - self.half_n, self.n - self.half)]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(len(BETAS))
            for b in batches:
                c, d = b.column(0).to_numpy().astype(float), b.column(2).to_numpy().astype(float)
                every, one = unpacked(b.column(1), states), unpacked(b.column(3), states)
                two = np.maximum(every - one, 0)
                for own, other, count, (sums, size) in ((one, two, d, sides[0]), (two, one, c - d, sides[1])):
                    some = np.flatnonzero(other.any(axis=1))
                    own, other, p = own[some], other[some], (count[some] + 1) / (size + v + 1)
                    at, state = np.nonzero(other)  # few states of a word
                    own, other, p, sums = own[at, state], other[at, state], p[at], sums[state]
                    for i, beta in enumerate(BETAS):
                        out[i] += float((other * np.log((own + beta * p) / (sums + beta))).sum())
            yield pa.RecordBatch.from_arrays([pa.array(range(len(BETAS)), pa.int32()), pa.array(out)], ["i", "log"])

        got = {r.i: r.log for r in self.words.select("c", "n", "d", "m").mapInArrow(run, "i int, log double").groupBy("i").agg(F.sum("log").alias("log")).collect()}
        return BETAS[max(got, key=got.get)]


def emissions(c: np.ndarray, n: np.ndarray, law: tuple[int, int, float, np.ndarray]) -> np.ndarray:
    tokens, words, beta, state_n = law
    return (n + beta * ((c + 1.0) / (tokens + words + 1))[:, None]) / (state_n + beta)


def count_words(texts: DataFrame, m: Model, tokens: int) -> Fitted:
    """A Baum-Welch round over texts (doc_id, text) that counts words."""
    states = len(m.start)
    sent = texts.sparkSession.sparkContext.broadcast(Model(m.start, m.move, m.emit.astype(np.float32)))
    parts = parts_of(tokens)
    names = ["part", "h", "c2", "v", "small"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        held: dict[bool, list] = {True: [], False: []}
        size = {True: 0, False: 0}
        total = [np.zeros(states), np.zeros((states, states))]

        def words_of(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            """Distinct words, and which of them each is; no sort of all tokens."""
            got = pa.array(h.view(np.int64)).dictionary_encode()
            return got.dictionary.to_numpy(), got.indices.to_numpy()

        def add(n: np.ndarray, at: np.ndarray, gamma: np.ndarray) -> None:
            at = at.astype(np.int64)
            for j in range(states):
                n[j] += np.bincount(at, weights=gamma[j], minlength=n.shape[1])

        def rows(u: np.ndarray, c: np.ndarray, n: np.ndarray, half: bool) -> pa.RecordBatch:
            """A row a part of the table, not one a word."""
            order, ids, cuts = _dealt(u, parts)
            v = _clear(n.T[order], c[order]).astype(np.float32)
            return pa.RecordBatch.from_arrays([ids, *(_cut(x, cuts) for x in (u[order], 2 * c[order] + half, v)), pa.nulls(len(ids), pa.binary())], names)

        def give(half: bool) -> Iterator[pa.RecordBatch]:
            h = np.concatenate(held[half])
            starts = np.concatenate([[0], np.cumsum([len(x) for x in held[half]])])
            held[half], size[half] = [], 0
            whole = len(h) <= HELD  # of a longer text, each group's words are counted alone
            if whole:
                u, at = words_of(h)
                n = np.zeros((states, len(u)))
            for s, v, span, gamma, _ in Chunks(m, classes_of(h), starts).expect():
                total[0], total[1] = total[0] + s, total[1] + v
                if whole:
                    add(n, at[span], gamma)
                else:
                    u, at = words_of(h[span])
                    n = np.zeros((states, len(u)))
                    add(n, at, gamma)
                    yield rows(u, np.bincount(at), n, half)
            if whole:
                yield rows(u, np.bincount(at), n, half)

        for batch in batches:
            for a, _, block in blocks(batch.column(0), NONSPACE):
                h, starts = tokens_of(block)
                halves = batch.column(1).to_numpy(zero_copy_only=False)[a : a + len(block)].tolist()
                for half, x, y in zip(halves, starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    if held[half] and size[half] + y - x > HELD:
                        yield from give(half)
                    held[half].append(h[x:y])
                    size[half] += y - x
        for half in (True, False):
            if held[half]:
                yield from give(half)
        small = np.concatenate([total[0], total[1].ravel()]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId() % parts], pa.int32()), *(pa.nulls(1, pa.binary()) for _ in range(3)), pa.array([small], pa.binary())], names)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        empty = [np.empty(0, dtype=np.int64), np.empty((0, 2 * states + 2))]
        held, size, small = [empty], 0, np.zeros(states + states * states)
        for b in batches:
            for h, c2, v, own in zip(*(b.column(i) for i in range(1, 5)), strict=True):
                if own.is_valid:
                    small += np.frombuffer(own.as_buffer())
                    continue
                h, c2, n = (np.frombuffer(x.as_buffer(), dtype=kind) for x, kind in ((h, np.int64), (c2, np.int64), (v, np.float32)))
                n, half, c = n.reshape(-1, states), c2[:1] % 2, (c2 // 2)[:, None]
                held.append([h, np.concatenate([n, n * half, c, c * half], axis=1)])
                size += len(h)
                if size > 1 << 20:
                    held = [_merged(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))]
                    size = 0
        h, x = _merged(np.concatenate([x for x, _ in held]), np.concatenate([x for _, x in held]))
        for a in range(0, len(h), 1 << 16):
            y = x[a : a + (1 << 16)]
            c, d = y[:, 2 * states].astype(np.int64), y[:, 2 * states + 1].astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h[a : a + (1 << 16)]), pa.array(c), _packed(y[:, :states]), pa.array(d), _packed(y[:, states : 2 * states]), pa.nulls(len(y), pa.binary())], ["h", "c", "n", "d", "m", "totals"])
        totals = np.concatenate([small, x.sum(axis=0), [float(len(h))]]).tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([totals], pa.binary())], ["h", "c", "n", "d", "m", "totals"])

    half = F.pmod(F.xxhash64("text", "doc_id"), F.lit(2)) == 0
    rows = texts.select("text", half.alias("half")).mapInArrow(run, "part int, h binary, c2 binary, v binary, small binary")
    both = stash(rows.repartitionById(parts, "part").mapInArrow(merge, "h long, c long, n binary, d long, m binary, totals binary"), "words")
    got = [np.frombuffer(r.totals) for r in both.where("totals IS NOT NULL").select("totals").collect()]  # one a partition
    got = np.sum(got, axis=0) if got else np.zeros(3 * states + states * states + 3)
    sent.destroy()
    new = m.update(got[:states], got[states : states + states * states].reshape(states, states), m.emit, np.zeros(len(m.emit)))
    return Fitted(new.start, new.move, both.where("h IS NOT NULL").drop("totals"), got[states + states * states :])


def head_of(counts: DataFrame, most: int) -> Column:
    """Whether a row of (h, c) is among the most frequent words, by count and hash (of equal counts whole ranges of hashes, so that up to 1/4096 of those words may be left out); no
    table is sorted: bins of the count, of the bin that crosses the limit the counts, and of the count that crosses it ranges of the hash tell where the limit lies."""

    def crossing(rows: DataFrame, by: Column, room: int, down: bool) -> tuple[int | None, int]:
        """The value at which the words pass the limit (None if they don't), and how many it leaves room for."""
        for k, n in sorted(((r.k, r.n) for r in rows.groupBy(by.alias("k")).agg(F.count("*").alias("n")).collect()), reverse=down):
            if n > room:
                return k, room
            room -= n
        return None, room

    level, part = F.floor(F.log2("c") * 16).cast("int"), F.shiftright("h", 52)
    k, room = crossing(counts, level, most, True)  # about 1000 bins at most
    if k is None:
        return F.lit(True)
    at = counts.where(level == k)
    least, room = crossing(at, F.col("c"), room, True)
    last, _ = crossing(at.where(F.col("c") == least), part, room, False)  # 4096 ranges
    return (level > k) | ((level == k) & ((F.col("c") > least) | ((F.col("c") == least) & (part < last))))


def _lists(column: pa.ChunkedArray | pa.Array) -> list[np.ndarray]:
    """Rows of a list column as arrays."""
    out = []
    for x in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        o = x.offsets.to_numpy()
        out += [x.values.to_numpy()[a:b] for a, b in zip(o[:-1], o[1:], strict=True)]
    return out


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows of one block that lie behind each other."""
    held, last = [], None
    for batch in batches:
        bid = batch.column("bid").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(bid)) + 1).tolist(), len(bid)]
        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            if b > a:
                if held and bid[a] != last:
                    yield pa.Table.from_batches(held)
                    held = []
                held.append(batch.slice(a, b - a))
                last = bid[a]
    if held:
        yield pa.Table.from_batches(held)


def fit(docs: DataFrame, states: int = STATES) -> Fitted:
    """The model of the texts of docs (doc_id, text, held_out) that aren't held out."""
    train = docs.where(~F.col("held_out"))
    encoded = stash(_encode(train), "symbols")
    m, tokens = train_states(encoded, states)
    free(encoded)
    return count_words(train, m, tokens)


def score(docs: DataFrame, fitted: Fitted) -> DataFrame:
    """Per row of docs (doc_id, text, held_out): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    spark, states, law = docs.sparkSession, len(fitted.start), fitted.law()
    top = fitted.words.where(head_of(fitted.words, HEAD)).select("h", "c", "n").toArrow().sort_by("h")  # HEAD rows
    counts = top["c"].to_numpy()
    sent = spark.sparkContext.broadcast((top["h"].to_numpy().copy(), counts, fitted.emissions(counts, unpacked(top["n"], states)).astype(np.float32), fitted.start, fitted.move))
    names, id_type = ["doc_id", "held_out"], docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head = sent.value[0]
        bid, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            for a, b, block in blocks(batch.column(2), NONSPACE):
                h, starts = tokens_of(block)
                h = h.view(np.int64)
                found = pc.index_in(pa.array(h), value_set=pa.array(head))
                own, at = found.is_valid().to_numpy(zero_copy_only=False), found.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
                codes, rare, wide = [], [], []
                for x, y in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
                    code, other = at[x:y], ~own[x:y]
                    u, inverse = np.unique(h[x:y][other], return_inverse=True)
                    code[other] = -1 - inverse  # words that aren't in the head: places in the text's own list
                    wide.append(max(len(u), len(head)) > 32_768)
                    codes.append(code.astype(np.int32 if wide[-1] else np.int16).tobytes())
                    rare.append(u)
                if size and size + len(h) > BLOCK_TOKENS:
                    bid, size = bid + 1, 0
                size += len(h)
                per = np.concatenate([[0], np.cumsum([len(u) for u in rare])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(per), pa.array(np.concatenate(rare)))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).slice(a, b - a) for i in range(2)), pa.array(np.full(b - a, bid, dtype=np.int64)), pa.array(wide), pa.array(codes, pa.binary()), lists], ["doc_id", "held_out", "bid", "wide", "codes", "rare"])

    parts = 4 * parts_of(fitted.n)  # words and blocks meet by part, and a row has all words of a part

    def need(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _runs(batches):
            h = np.unique(np.concatenate(_lists(t["rare"])))
            order, ids, cuts = _dealt(h, parts)
            yield pa.RecordBatch.from_arrays([ids, pa.array(np.full(len(ids), t["bid"][0].as_py(), dtype=np.int64)), _cut(h[order], cuts)], ["part", "bid", "h"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            h = b.column(0).to_numpy()
            order, ids, cuts = _dealt(h, parts)
            n = unpacked(b.column(2), states).astype(np.float32)
            yield pa.RecordBatch.from_arrays([ids, *(_cut(x[order], cuts) for x in (h, b.column(1).to_numpy(), n))], ["part", "h", "c", "n"])

    def look(asked: pa.Table, words: pa.Table) -> pa.Table:
        """The rows of the words that blocks ask for, of one part."""
        own, c, n = _joined(words["h"], np.int64), _joined(words["c"], np.int64), _joined(words["n"], np.float32).reshape(-1, states)
        h = _joined(asked["h"], np.int64)
        found = pc.index_in(pa.array(h), value_set=pa.array(own))
        has = found.is_valid().to_numpy(zero_copy_only=False)
        at = found.drop_null().to_numpy()
        # how many of each block's are known
        ends = np.cumsum(pc.binary_length(asked["h"]).to_numpy() // 8)
        cuts = np.concatenate([[0], np.cumsum(has)])[np.concatenate([[0], ends])]
        return pa.table({"bid": asked["bid"], "h": _cut(h[has], cuts), "c": _cut(c[at], cuts), "n": _cut(n[at], cuts)})

    def meet(t: pa.Table, rows: pa.Table) -> pa.Table:
        head, counts, rates, start, move = sent.value
        if not t.num_rows:
            return pa.table({"doc_id": t["doc_id"], "held_out": t["held_out"], **{c: pa.array([], k) for c, k in (("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64()))}})
        rare = _lists(t["rare"])
        h = np.unique(np.concatenate(rare))
        c, n = np.zeros(len(h), dtype=np.int64), np.zeros((len(h), states))
        at = np.searchsorted(h, _joined(rows["h"], np.int64))
        c[at], n[at] = _joined(rows["c"], np.int64), _joined(rows["n"], np.float32).reshape(-1, states)
        emit, c = np.concatenate([rates, emissions(c, n, law).astype(np.float32)]), np.concatenate([counts, c])
        tokens = []
        for x, wide, u in zip(t["codes"].to_pylist(), t["wide"].to_pylist(), rare, strict=True):
            code = np.frombuffer(x, dtype=np.int32 if wide else np.int16).astype(np.int32)
            other = code < 0
            code[other] = len(head) + np.searchsorted(h, u)[-1 - code[other]]
            tokens.append(code)
        size = np.array([len(x) for x in tokens])
        starts, flat = np.concatenate([[0], np.cumsum(size)]), np.concatenate(tokens)
        logs = Chunks(Model(start, move, emit), flat, starts).logs() / math.log(10)
        # worked out by word, of which there are fewer than tokens
        known, base = (np.add.reduceat(x[flat], starts[:-1]) for x in ((c > 0).astype(np.int64), np.log10((c + 1.0) / (law[0] + law[1] + 1))))
        return pa.table({"doc_id": t["doc_id"], "held_out": t["held_out"], "n_tokens": pa.array(size.astype(np.int64)), "n_known": pa.array(known), "base_score": pa.array(base), "score": pa.array(logs)})

    encoded = stash(docs.select(*names, "text").mapInArrow(encode, f"doc_id {id_type}, held_out boolean, bid long, wide boolean, codes binary, rare array<long>"), "codes")
    asked = encoded.select("bid", "rare").mapInArrow(need, "part int, bid long, h binary")
    words = fitted.words.select("h", "c", "n").mapInArrow(pack, "part int, h binary, c binary, n binary")
    rows = asked.groupBy("part").cogroup(words.groupBy("part")).applyInArrow(look, "bid long, h binary, c binary, n binary")
    out = encoded.groupBy("bid").cogroup(rows.groupBy("bid")).applyInArrow(meet, f"doc_id {id_type}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return out.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(fitted.n).cast("long").alias("train_tokens"), "base_score", "score")


def lm_score(docs: DataFrame, states: int = STATES) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).withColumn("held_out", held_out())
    return score(docs, fit(docs, states))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score(table(spark, sf_dir, "documents"))
