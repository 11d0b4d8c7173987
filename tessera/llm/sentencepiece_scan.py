"""SentencePiece encoding and decoding by a max-plus parallel scan.

A text is encoded along a path of pieces. Paths have weights in the max-plus
semiring: of a unigram model the sum of the pieces' scores; of a BPE model 0 for
each pair of neighbours that the merges leave apart, and minus infinity for
others. (Merges never cross a border that the final pieces keep, so a sequence
of pieces is the BPE encoding exactly if each pair of neighbours is encoded to
itself: the one path of weight 0.) Either way the best path is what the
SentencePiece library returns; the library itself isn't called.

No piece has a space mark after another character, so a space mark that follows
one is always between two pieces: between such marks lie units. A unit's best path is found once
and remembered: of a short unit of a BPE model by its merges, else along the pieces.

Texts of over one chunk are split into chunks of `chunk` characters, wherever that is.
The states of a border are the pieces that may cross it or end there. Each chunk
yields a matrix: the best weight from each state of its first border to each of its last, the units
between with their weights. Matrices are multiplied (max-plus, associative) as a tree: of each block of BLOCK chunks to one,
then of the blocks of a text; going down again, blocks and then chunks get the states of their borders on the
best path. Then each chunk is backtraced on its own between its two states.
Only matrices meet in one task, never texts.

Defined results: null and empty texts have no tokens; a literal U+2581 counts as
a blank, as SentencePiece itself has it; repeated rows each give a row; other columns are ignored; a model with a piece that has a
space mark after another character raises ValueError. The model file is read on the driver's machine and sent to the tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from itertools import chain, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import stash, table

#: Characters of a chunk; a text of over twice as many bytes is cut.
CHUNK = 16384
#: Chunks whose matrices one task multiplies.
BLOCK = 64
#: Units that a worker remembers at least (twice as many at most: those met again since outlive the others), and the longest that it does.
MEMO, MEMO_LENGTH = 500_000, 64
#: Characters of a unit up to which a BPE model's merges are followed (their time grows with the square of the length).
MERGED = 64

MARK = "▁"
_UNIT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")
_START = re.compile(f"(?<=[^{MARK}]){MARK}")
_NO = float("-inf")

State = tuple[int, int, int]  # first character and end of the crossing piece, relative to the border, and its id
CLEAN: list[State] = [(0, 0, -1)]


class Model:
    """A SentencePiece model of type BPE or unigram, and the paths through its pieces."""

    def __init__(self, proto: bytes):
        from sentencepiece import sentencepiece_model_pb2 as pb

        m = pb.ModelProto()
        m.ParseFromString(proto)
        if any(MARK in p.piece.lstrip(MARK) for p in m.pieces):
            raise ValueError("a piece has a space mark after another character")
        self.unigram = m.trainer_spec.model_type == 1
        self.prefix = m.normalizer_spec.add_dummy_prefix
        self.score = [p.score for p in m.pieces]
        self.ids = {p.piece: i for i, p in enumerate(m.pieces) if p.type in (1, 4)}
        self.rank = {p.piece: p.score for p in m.pieces if p.type == 1}
        self.byte = {int(p.piece[3:-1], 16): i for i, p in enumerate(m.pieces) if p.type == 6}
        self.other = next((i for i, p in enumerate(m.pieces) if p.type == 2), 0)
        self.pieces = [p.piece for p in m.pieces]
        self.longest = max(map(len, self.ids))
        self.unknown = min((p.score for p in m.pieces if p.type == 1), default=0.0) - 10.0
        self.bytes = [bytes([int(p.piece[3:-1], 16)]) if p.type == 6 else b"" if p.type == 3 else p.piece.replace(MARK, " ").encode() if p.type != 2 else " ⁇ ".encode() for p in m.pieces]
        self.memo: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}

    def normal(self, text: str) -> str:
        return (MARK if self.prefix and text else "") + text.replace(" ", MARK)

    def merges(self, text: str) -> list[int]:
        """The pieces (ids, or minus the code point) that a BPE model's merges leave: always the best-ranked pair, the first of equals."""
        parts, rank = list(text), self.rank.get
        ranks = [rank(a + b, _NO) for a, b in pairwise(parts)]
        while ranks and (best := max(ranks)) != _NO:
            at = ranks.index(best)
            one = parts[at] = parts[at] + parts.pop(at + 1)
            del ranks[at]
            if at < len(ranks):
                ranks[at] = rank(one + parts[at + 1], _NO)
            if at:
                ranks[at - 1] = rank(parts[at - 1] + one, _NO)
        ids = self.ids
        return [ids[p] if p in ids else -ord(p) for p in parts]

    def path(self, unit: str) -> list[int]:
        """The pieces of the best path of a text that begins and ends between pieces."""
        if not self.unigram and len(unit) <= MERGED:
            return self.merges(unit)
        way, out = self.paths(unit, 0, CLEAN, len(unit), CLEAN)[1][0][0], []
        while way is not None:
            way, t = way
            out.append(t)
        return out[::-1]

    def _flat(self, path: list[int]) -> list[int]:
        """Ids, with characters that have no piece as their bytes; without byte pieces a run of them is one unknown."""
        if not path or min(path) >= 0:
            return path
        out: list[int] = []
        for i, t in enumerate(path):
            if t >= 0 or not self.byte:
                if t >= 0 or not (i and path[i - 1] < 0):
                    out.append(t if t >= 0 else self.other)
            else:
                out += [self.byte[b] for b in chr(-t).encode("utf-8", "surrogatepass")]
        return out

    def unit(self, unit: str) -> tuple[int, ...]:
        """Ids of a unit, remembered."""
        if (ids := self.memo.get(unit)) is None:
            if (ids := self.older.get(unit)) is None:
                ids = tuple(self._flat(self.path(unit)))
            if len(unit) <= MEMO_LENGTH:
                if len(self.memo) >= MEMO:
                    self.memo, self.older = {}, self.memo
                self.memo[unit] = ids
        return ids

    def units(self, text: str) -> list[tuple[int, ...]]:
        """Ids of the units of a normalised text that begins and ends between pieces."""
        units = _UNIT.findall(text)
        out = list(map(self.memo.get, units))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            out[i] = self.unit(units[i])
        return out

    def encode(self, text: str) -> list[int]:
        """Ids of a normalised text that begins and ends between pieces."""
        return list(chain.from_iterable(self.units(text)))

    def total(self, text: str) -> float:
        """The weight of the best path of a text that begins and ends between pieces."""
        if not self.unigram:
            return 0.0
        return float(sum(self.paths(u, 0, CLEAN, len(u), CLEAN)[0][0, 0] for u in _UNIT.findall(text)))

    def decode(self, ids: Sequence[int], first: bool = True) -> str:
        out = b"".join(map(self.bytes.__getitem__, ids))
        return (out[1:] if first and self.prefix and out[:1] == b" " else out).decode("utf-8", "replace")

    # A piece is known by its id, a character without a piece by minus its code point.

    def _name(self, t: int) -> str:
        return self.pieces[t] if t >= 0 else chr(-t)

    def starting(self, text: str, p: int, end: int) -> Iterator[tuple[int, int]]:
        """(end, piece) of the pieces at p that end at `end` at most."""
        for q in range(p + 1, min(end, p + self.longest) + 1):
            if (t := self.ids.get(text[p:q])) is not None:
                yield q, t
            elif q == p + 1:
                yield q, -ord(text[p])

    def weight(self, a: int, b: int) -> float:
        """Of piece b behind piece a (-1 and less than it: the text's or a unit's start)."""
        if self.unigram:
            return self.score[b] if b >= 0 else self.unknown
        if (a, b) not in self.pairs:
            if len(self.pairs) > MEMO:
                self.pairs.clear()
            self.pairs[a, b] = self.merges(self._name(b)) == [b] if a == -1 else self.merges(self._name(a) + self._name(b)) == [a, b]
        return 0.0 if self.pairs[a, b] else _NO

    def crossing(self, text: str, b: int) -> list[State]:
        """States of a border that is no unit's start: pieces that begin before b and end there or later."""
        return [(p - b, q - b, t) for p in range(max(0, b - self.longest), b) for q, t in self.starting(text, p, len(text)) if q >= b]

    def paths(self, text: str, a: int, entry: list[State], b: int, exits: list[State]) -> tuple[np.ndarray, list]:
        """Best weights from each entry state at a to each exit state at b, and the way back of each."""
        best: dict[int, dict[int, tuple[np.ndarray, list]]] = {}
        for i, (_, q, t) in enumerate(entry):
            v = np.full(len(entry), _NO)
            v[i] = 0.0
            at = best.setdefault(a + q, {})
            if t in at:
                np.maximum(at[t][0], v, out=at[t][0])
            else:
                at[t] = (v, [None] * len(entry))
        clean = exits == CLEAN
        limit = b if clean else len(text)
        out, back = np.full((len(entry), len(exits)), _NO), [[None] * len(exits) for _ in entry]
        found = {(b + s[0], b + s[1], s[2]): j for j, s in enumerate(exits)}

        def give(j: int, v: np.ndarray, ways: list) -> None:
            for i in np.flatnonzero(v > out[:, j]):
                out[i, j], back[i][j] = v[i], ways[i]

        for p in range(min(best, default=b), b + 1 if clean else b):
            for t, (v, ways) in best.pop(p, {}).items():
                if clean and p == b:
                    give(0, v, ways)
                    continue
                for q, u in self.starting(text, p, limit):
                    w = self.weight(t, u)
                    if w == _NO:
                        continue
                    nv = v + w
                    if not clean and q >= b:
                        if (j := found.get((p, q, u))) is not None:
                            give(j, nv, [(x, u) for x in ways])
                        continue
                    at = best.setdefault(q, {})
                    if u not in at:
                        at[u] = (np.full(len(entry), _NO), [None] * len(entry))
                    ov, ow = at[u]
                    for i in np.flatnonzero(nv > ov):
                        ov[i], ow[i] = nv[i], (ways[i], u)
        if not clean:  # an entry piece may reach over the whole chunk
            for (_, q, t), i in zip(entry, range(len(entry)), strict=True):
                if a + q >= b and (j := next((j for j, s in enumerate(exits) if s == (entry[i][0] + a - b, a + q - b, t)), None)) is not None:
                    out[i, j] = max(out[i, j], 0.0)
        return out, back

    def trace(self, way: object) -> list[int]:
        out: list[int] = []
        while way is not None:
            way, t = way
            out.append(t)
        return self._flat(out[::-1])


_models: dict[str, Model] = {}


def load(path: str, proto: bytes | None = None) -> Model:
    """The model of a file (or of its bytes, known by its path); a worker makes it once."""
    if path not in _models:
        if proto is None:
            with open(path, "rb") as f:
                proto = f.read()
        _models[path] = Model(proto)
    return _models[path]


def sent(spark: SparkSession, path: str):
    """What gives tasks the model of a file on the driver's machine."""
    with open(path, "rb") as f:
        proto = spark.sparkContext.broadcast(f.read())  # about 1 MB
    return lambda: load(path, proto.value)


def multiply(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The max-plus product."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


class Chunk:
    """A piece of a normalised text with what lies around it: text[0] is `back` characters before the chunk's start."""

    def __init__(self, model: Model, text: str, back: int, length: int, first: bool, last: bool):
        self.model, self.text = model, text
        self.a, self.b = (0 if first else back), (len(text) if last else back + length)
        self.entry = CLEAN if first else model.crossing(text, self.a)
        self.exits = CLEAN if last else model.crossing(text, self.b)
        # between the first and the last unit's start inside, units are encoded on their own
        starts = [m.start() for m in _START.finditer(text, self.a + (0 if first else model.longest), self.b)]
        self.head = self.a if first else starts[0] if starts else None
        self.tail = self.b if last else starts[-1] if starts else self.a if first else None

    def matrix(self) -> np.ndarray:
        if self.head is None or self.tail is None:
            return self.model.paths(self.text, self.a, self.entry, self.b, self.exits)[0]
        out = np.full((1, 1), self.model.total(self.text[self.head : self.tail]))
        if self.head != self.a:
            out = multiply(self.model.paths(self.text, self.a, self.entry, self.head, CLEAN)[0], out)
        return out if self.tail == self.b else multiply(out, self.model.paths(self.text, self.tail, CLEAN, self.b, self.exits)[0])

    def ids(self, i: int, j: int) -> tuple[list[int], str]:
        """Ids of the pieces that begin in the chunk, given the states of its borders; and their text."""
        m, (_, q, _), (_, r, _) = self.model, self.entry[i], self.exits[j]
        text = self.text[self.a + q : self.b + r]
        if self.head is None or self.tail is None:
            return m.trace(m.paths(self.text, self.a, [self.entry[i]], self.b, [self.exits[j]])[1][0][0]), text
        left = [] if self.head == self.a else m.trace(m.paths(self.text, self.a, [self.entry[i]], self.head, CLEAN)[1][0][0])
        right = [] if self.tail == self.b else m.trace(m.paths(self.text, self.tail, CLEAN, self.b, [self.exits[j]])[1][0][0])
        return left + m.encode(self.text[self.head : self.tail]) + right, text


def product(matrices: list[np.ndarray]) -> np.ndarray:
    """The max-plus product, as a tree."""
    while len(matrices) > 1:
        matrices = [multiply(*matrices[i : i + 2]) if i + 1 < len(matrices) else matrices[i] for i in range(0, len(matrices), 2)]
    return matrices[0]


def scan(matrices: list[np.ndarray], entry: int = 0, exit: int = 0) -> list[tuple[int, int]]:
    """The states (entry, exit) of each matrix on the best path between these states of the first and the last border."""
    right = [np.full(matrices[-1].shape[1], _NO)]
    right[0][exit] = 0.0
    for m in reversed(matrices[1:]):
        right.append((m + right[-1]).max(axis=1))
    out, state = [], entry
    for m, r in zip(matrices, reversed(right), strict=True):
        nxt = int(np.argmax(m[state] + r))
        out.append((state, nxt))
        state = nxt
    return out


_CHUNKS = "rid long, doc_id long, chunk int, n_chunks int, back int, length int, text string"
_ENCODED = "rid long, doc_id long, chunk int, n_chunks int, ids array<int>, text string"
_CHECKED = "rid long, doc_id long, chunk int, n_chunks int, n_tokens long, id_sum long, id_place_sum long, same boolean"


def _batch(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<int>": pa.list_(pa.int32()), "binary": pa.binary(), "array<double>": pa.list_(pa.float64())}
    fields = [f.split() for f in ddl.split(", ")]
    columns = zip(*rows, strict=True) if rows else [[] for _ in fields]
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _split(docs: DataFrame, model_path: str, chunk: int) -> DataFrame:
    """Giant texts, normalised and in overlapping chunks."""

    model_of = sent(docs.sparkSession, model_path)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            for rid, doc, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                t = model.normal(text)
                n = max(1, len(t) // chunk)
                for i in range(n):
                    a, b = i * chunk, len(t) if i == n - 1 else (i + 1) * chunk
                    back = min(a, model.longest)
                    yield _batch([(rid, doc, i, n, back, b - a, t[a - back : b + 2 * model.longest])], _CHUNKS)

    return docs.mapInArrow(split, _CHUNKS)


def _states(chunks: DataFrame, model_path: str) -> DataFrame:
    """(rid, chunk, entry, exit): the states of each chunk's borders on the best path of its text."""
    model_of = sent(chunks.sparkSession, model_path)
    _row = "rid long, block long, chunk int, height int, weights array<double>"

    def transfer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                m = Chunk(model, r["text"], r["back"], r["length"], r["chunk"] == 0, r["chunk"] == r["n_chunks"] - 1).matrix()
                rows.append((r["rid"], r["chunk"] // BLOCK, r["chunk"], m.shape[0], m.ravel().tolist()))
            yield _batch(rows, _row)

    def read(rows: pa.Table) -> list[np.ndarray]:
        return [np.asarray(w, dtype=float).reshape(h, -1) for h, w in zip(rows["height"].to_pylist(), rows["weights"].to_pylist(), strict=True)]

    def up(rows: pa.Table) -> pa.Table:
        m = product(read(rows.sort_by("chunk")))
        return pa.table({"rid": rows["rid"][:1], "block": rows["block"][:1], "height": pa.array([m.shape[0]], pa.int32()), "weights": pa.array([m.ravel().tolist()], pa.list_(pa.float64()))})

    def across(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("block")
        found = scan(read(rows))
        return pa.table({"rid": rows["rid"], "block": rows["block"], "entry": pa.array([x for x, _ in found], pa.int32()), "exit": pa.array([y for _, y in found], pa.int32())})

    def down(rows: pa.Table, ends: pa.Table) -> pa.Table:
        rows = rows.sort_by("chunk")
        found = scan(read(rows), ends["entry"][0].as_py(), ends["exit"][0].as_py()) if rows.num_rows else []
        return pa.table({"rid": rows["rid"], "chunk": rows["chunk"], "entry": pa.array([x for x, _ in found], pa.int32()), "exit": pa.array([y for _, y in found], pa.int32())})

    matrices = stash(chunks.mapInArrow(transfer, _row), "matrices")
    blocks = matrices.groupBy("rid", "block").applyInArrow(up, "rid long, block long, height int, weights array<double>")
    ends = blocks.groupBy("rid").applyInArrow(across, "rid long, block long, entry int, exit int")
    return matrices.groupBy("rid", "block").cogroup(ends.groupBy("rid", "block")).applyInArrow(down, "rid long, chunk int, entry int, exit int")


def _encoded(docs: DataFrame, model_path: str, chunk: int, finish, ddl: str) -> tuple[DataFrame, DataFrame]:
    """Rows of finish(model, rid, doc_id, chunk, n_chunks, ids, text): of each whole text, and of each chunk of the giant ones."""
    d = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    giant = F.coalesce(F.octet_length("text") > 2 * chunk, F.lit(False))

    model_of = sent(docs.sparkSession, model_path)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                rids, ids, texts = (c.slice(a, 256).to_pylist() for c in batch.columns)
                texts = [model.normal(t or "") for t in texts]
                yield _batch([finish(model, rid, doc, 0, 1, x, t) for rid, doc, x, t in zip(rids, ids, map(model.encode, texts), texts, strict=True)], ddl)

    def backtrace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                c = Chunk(model, r["text"], r["back"], r["length"], r["chunk"] == 0, r["chunk"] == r["n_chunks"] - 1)
                rows.append(finish(model, r["rid"], r["doc_id"], r["chunk"], r["n_chunks"], *c.ids(r["entry"], r["exit"])))
            yield _batch(rows, ddl)

    chunks = stash(_split(d.where(giant), model_path, chunk), "chunks")
    return d.where(~giant).mapInArrow(whole, ddl), chunks.join(_states(chunks, model_path), ["rid", "chunk"]).mapInArrow(backtrace, ddl)


def encode(docs: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """(rid, doc_id, chunk, n_chunks, ids, text): the ids of each text of docs (doc_id, text), a giant one in chunks, and the normalised text they stand for."""
    whole, chunks = _encoded(docs, model_path, chunk, lambda model, rid, doc, k, n, ids, text: (rid, doc, k, n, ids, text), _ENCODED)
    return whole.unionByName(chunks)


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(rid, doc_id, chunk, n_chunks, ids) -> (rid, doc_id, chunk, n_chunks, decoded). Pieces of bytes that lie in two chunks belong to a character that cannot be cut, so each chunk is whole."""
    ddl = "rid long, doc_id long, chunk int, n_chunks int, decoded string"
    model_of = sent(encoded.sparkSession, model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of()
        for batch in batches:
            yield _batch([(r["rid"], r["doc_id"], r["chunk"], r["n_chunks"], model.decode(r["ids"], r["chunk"] == 0)) for r in batch.to_pylist()], ddl)

    return encoded.select("rid", "doc_id", "chunk", "n_chunks", "ids").mapInArrow(run, ddl)


def round_trip(docs: DataFrame, model_path: str, chunk: int = CHUNK) -> DataFrame:
    """Per row of docs: doc_id, n_tokens, n_chunks, id_digest (the sum of (id + 1) times its place from 1), and whether decoding gives the text again."""

    def check(model: Model, rid: int, doc: int, k: int, n: int, ids: list[int], text: str) -> tuple:
        plain = text.replace(MARK, " ")
        plain = plain[1:] if k == 0 and model.prefix else plain
        x = np.asarray(ids, dtype=np.int64) + 1
        return rid, doc, k, n, len(ids), int(x.sum()), int((x * np.arange(1, len(x) + 1)).sum()), model.decode(ids, k == 0) == plain

    whole, chunks = _encoded(docs.select("doc_id", "text"), model_path, chunk, check, _CHECKED)
    one = whole.select("doc_id", "n_tokens", F.lit(1).cast("long").alias("n_chunks"), F.col("id_place_sum").alias("id_digest"), F.col("same").alias("round_trip"))
    # a giant text's chunks: places go on from one to the next
    many = chunks.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_list(F.struct("chunk", "n_tokens", "id_sum", "id_place_sum"))).alias("c"), F.sum("n_tokens").alias("n_tokens"), F.count("*").alias("n_chunks"), F.min("same").alias("round_trip"))
    digest = F.expr("aggregate(c, struct(0L AS n, 0L AS d), (a, x) -> struct(a.n + x.n_tokens AS n, a.d + x.id_place_sum + a.n * x.id_sum AS d), a -> a.d)")
    return one.unionByName(many.select("doc_id", "n_tokens", "n_chunks", digest.alias("id_digest"), "round_trip"))


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), default_model())
