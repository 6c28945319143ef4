"""A hashed maximum-entropy language model with a class-factored softmax.

P(token | context) = P(class | context) * P(cell | class, context) * P(token | cell).
Frequent tokens are classes of their own, the others are classed by their last
bytes; a class of those is dealt into cells by hash.  Both softmaxes have a bias
from the counts and hashed features of the context: the token before, the token
before that (a skip) and, for the class, the two together; the cell's features
are of the class as well.  Context words go by their identity, the frequent ones
in rows of their own, the others hashed into a table whose size follows the
number of distinct tokens up to a fixed bound.  Within a cell a token has its
smoothed share of the counts.  Two words together go by their last bytes where
they are not frequent.

The weights are trained by distributed gradient updates: each update is the
gradient over one slice of the training documents, scaled by the curvature of
each weight; the slices together are all training documents.  Gradients of tasks
are added up in a tree of bounded width, so that no task reads more than FAN of
them however many there are.  Token counts are exact and gathered from the whole
corpus, but that tokens are told apart by a 64-bit hash: two of n distinct ones
share one with chance n * n / 2 ** 65.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from neartide.llm import words
from neartide.llm.blocktable import Block, answered, block_table, cuts_of, gathered, pack, range_bits, rows_of, sent, unpack
from neartide.plans.storage import materialize

ENDINGS = 64  # classes of last bytes
CELLS = 16  # of a class of last bytes
SINGLES = 64  # frequent tokens that are classes of their own
KNOWN = 1024  # frequent tokens that are context features of their own
OTHERS = (64, 2048)  # least and greatest number of rows that other context words are hashed into
PAIRS = (4096, 8192)  # the same for two tokens together
CELL_ROWS = 8192  # hashed features of a class and a context word
CLASSES = SINGLES + ENDINGS
STEPS = 4
CELL_PRIOR = 6.0  # counts that hold a cell's weight at nothing
BATCH = 1024
CELL_BATCH = BATCH * CLASSES // CELLS
ADDED = 32 * BATCH  # rows of probabilities that are added up at once
TASK_BYTES = 16 << 20  # text of one gradient task
PIECE = 1 << 14  # numbers of one message of a gradient
FAN = 32  # gradients that one task adds up

END_KEY = np.uint64(0xFFFFFFFFFFFFFFFF)


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 5 == 1


class _Tokens:
    """A block's tokens in order, an end after each document: hashes and the classes of their last bytes."""

    def __init__(self, block: Block):
        buf = words.lowered(block.buf)
        starts, ends = words.spans(buf)
        doc = np.searchsorted(block.begins, starts, "right") - 1
        last = buf[ends - 1].astype(np.uint64) | (np.where(ends - starts > 1, buf[ends - 2], 0).astype(np.uint64) << np.uint64(8)) if len(starts) else np.empty(0, np.uint64)
        keys = words.hashes(buf, starts, ends)
        n = len(block.ids)
        count = np.bincount(doc, minlength=n)
        self.count = count + 1
        self.first = np.concatenate([[0], np.cumsum(self.count)[:-1]]) if n else np.empty(0, np.int64)
        self.keys, self.ending = np.empty(len(keys) + n, np.uint64), np.zeros(len(keys) + n, np.int64)
        where = np.arange(len(keys)) + doc
        self.keys[where], self.ending[where] = keys, (words.mix(last) % np.uint64(ENDINGS)).astype(np.int64)
        self.keys[self.first + count] = END_KEY
        self.doc = np.repeat(np.arange(n), self.count)
        self.held = np.array([held_out(None if e else int(k)) for k, e in zip(block.ids, block.null)], bool)


def _cell(keys: np.ndarray) -> np.ndarray:
    return (words.mix(keys ^ np.uint64(0x5BD1E995)) % np.uint64(CELLS)).astype(np.int64)


def _counted(block: Block) -> tuple[np.ndarray, ...]:
    """The distinct tokens, how often training documents have them, and the classes of their last bytes."""
    tokens = _Tokens(block)
    keys, index, inverse = np.unique(tokens.keys, return_index=True, return_inverse=True)
    return keys, np.bincount(inverse[~tokens.held[tokens.doc]], minlength=len(keys)).astype(np.uint64), tokens.ending[index].astype(np.uint64)


def _summed(top: int):
    def reduce(bucket: int, keys: np.ndarray, values: np.ndarray, blks: np.ndarray, bounds: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Kind 0: the answer to each block, its tokens' counts; 1: the range's most frequent tokens and their places; 2: types and tokens of each place, a class and cell."""
        names, index, inverse = np.unique(keys, return_index=True, return_inverse=True)
        total = np.zeros(len(names), np.int64)
        np.add.at(total, inverse, values[0].view(np.int64))
        mine = total[inverse]
        best = np.argsort(-total, kind="stable")[:top]
        best = best[total[best] > 0]
        place = values[1].view(np.int64)[index] * CELLS + _cell(names)
        types = np.bincount(place[total > 0], minlength=ENDINGS * CELLS)
        sums = np.bincount(place, weights=total, minlength=ENDINGS * CELLS).astype(np.int64)
        full = np.flatnonzero(types)
        a, b, c = len(blks), len(best), len(full)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([0] * a + [1] * b + [2] * c, pa.int8()), pa.array([*blks.tolist(), *[None] * (b + c)], pa.int64()), pa.array([bucket] * (a + b + c), pa.int32()),
                pa.array([pack(mine[i:j]) for i, j in zip(bounds[:-1], bounds[1:])] + [None] * (b + c), pa.binary()),
                pa.array([None] * a + names[best].view(np.int64).tolist() + [None] * c, pa.int64()), pa.array([None] * a + place[best].tolist() + full.tolist(), pa.int64()),
                pa.array([None] * a + total[best].tolist() + sums[full].tolist(), pa.int64()), pa.array([None] * (a + b) + types[full].tolist(), pa.int64()),
            ],
            names=["kind", "blk", "bucket", "a", "key", "place", "n", "types"],
        )

    return reduce


_COUNTS = "kind byte, blk long, bucket int, a binary, key long, place long, n long, types long"


def _log_softmax(weight: np.ndarray, features: np.ndarray, bias: np.ndarray) -> np.ndarray:
    x = weight[features[:, 0]]
    for f in range(1, features.shape[1]):
        x += weight[features[:, f]]
    x += bias
    x -= x.max(1, keepdims=True)
    x -= np.log(np.exp(x).sum(1, keepdims=True))
    return x


class _Softmax:
    """Probabilities from sums of ``active`` weights: products of exponentials told once, unless those could leave the range of a float."""

    def __init__(self, weight: np.ndarray, bias: np.ndarray, active: int):
        self.weight, self.bias = weight, bias
        self.products = active * float(np.abs(weight).max()) + float(np.abs(bias).max()) < 60
        if self.products:
            self.weight, self.bias = np.exp(weight), np.exp(bias)

    def _joined(self, features: np.ndarray, kind: np.ndarray | None) -> np.ndarray:
        """Numbers in proportion to the probabilities, or where they are no products the logarithms of such; ``kind`` names each row's bias."""
        join = np.multiply if self.products else np.add
        x = self.weight[features[:, 0]]
        for f in range(1, features.shape[1]):
            join(x, self.weight[features[:, f]], out=x)
        join(x, self.bias if kind is None else self.bias[kind], out=x)
        if not self.products:
            x -= x.max(1, keepdims=True)
        return x

    def _total(self, x: np.ndarray) -> np.ndarray:
        """Sums of the rows that ``_joined`` gave, which become numbers in proportion to the probabilities."""
        if not self.products:
            np.exp(x, out=x)
        return x @ np.ones(x.shape[1], x.dtype)

    @property
    def all(self) -> np.ndarray:
        """The probabilities that the biases alone give."""
        x = self.bias if self.products else np.exp(self.bias - self.bias.max(-1, keepdims=True))
        return x / x.sum(-1, keepdims=True)

    def rows(self, features: np.ndarray, times: np.ndarray | int = 1, kind: np.ndarray | None = None) -> np.ndarray:
        """The probabilities, times a number for each row."""
        x = self._joined(features, kind)
        total = self._total(x)
        x *= (times / total).astype(x.dtype)[:, None]
        return x

    def log_chosen(self, features: np.ndarray, row: np.ndarray, column: np.ndarray, kind: np.ndarray | None = None) -> np.ndarray:
        """Logarithms of the probabilities at the given places."""
        x = self._joined(features, kind)
        chosen = x[row, column].astype(np.float64)
        return (np.log(chosen) if self.products else chosen) - np.log(self._total(x).astype(np.float64))[row]


@dataclass
class Model:
    """Everything that scoring needs beside the counts; its size has a fixed bound."""

    known: np.ndarray  # the frequent tokens' hashes, rising
    rank: np.ndarray  # their ranks, 0 for the end
    others: int
    pairs: int
    bias: np.ndarray
    weight: np.ndarray
    cell_bias: np.ndarray
    cell_weight: np.ndarray
    place_tokens: np.ndarray
    place_types: np.ndarray
    n_tokens: int
    n_types: int

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        """The rank of each token, or KNOWN for others."""
        if not len(self.known):
            return np.full(len(keys), KNOWN)
        at = np.minimum(np.searchsorted(self.known, keys), len(self.known) - 1)
        return np.where(self.known[at] == keys, self.rank[at], KNOWN)

    @property
    def width(self) -> int:
        return KNOWN + self.others + 1

    def context(self, tokens: _Tokens, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The context words one and two places before each token, as rows."""
        own = self.others // ENDINGS  # rows that the other words of one ending are hashed into
        word = np.where(rank < KNOWN, rank, KNOWN + tokens.ending * own + (words.mix(tokens.keys ^ np.uint64(0x27D4EB2F)) % np.uint64(own)).astype(np.int64))
        before = KNOWN + self.others  # no token before
        one, two = np.full(len(word), before), np.full(len(word), before)
        one[1:], two[2:] = word[:-1], word[:-2]
        one[tokens.first] = two[tokens.first] = before
        two[tokens.first[tokens.count > 1] + 1] = before
        return one, two

    def features(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Rows of ``weight`` that are active in a context."""
        a, b = self._coarse(one), self._coarse(two)
        pair = (words.mix((a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)) % np.uint64(self.pairs)).astype(np.int64)
        return np.stack([one, self.width + two, 2 * self.width + pair], 1)

    def _coarse(self, word: np.ndarray) -> np.ndarray:
        """A row's word if it is frequent, else its ending, or no word at all."""
        return np.where(word < KNOWN, word, KNOWN + (word - KNOWN) // (self.others // ENDINGS))

    def cell_features(self, ending: np.ndarray, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """Rows of ``cell_weight`` that are active for a class of last bytes in a context."""
        of = lambda word, side: (words.mix(((word * 2 + side) * ENDINGS + ending).astype(np.uint64)) % np.uint64(CELL_ROWS)).astype(np.int64)
        return np.stack([of(one, 0), of(two, 1)], 1)


def _add(total: np.ndarray, features: np.ndarray, p: np.ndarray) -> None:
    for f in range(features.shape[1]):
        ids, rows = features[:, f], p
        if (ids[1:] < ids[:-1]).any():  # the first feature of contexts in order is in order too
            order = np.argsort(ids, kind="stable")
            ids, rows = ids[order], p[order]
        heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        if 2 * len(heads) > len(ids):  # few rows to add up: the second and later ones of a feature are added to its first
            first = rows[heads]
            later = np.flatnonzero(ids[1:] == ids[:-1]) + 1
            np.add.at(first, np.searchsorted(heads, later, "right") - 1, rows[later])
            total[ids[heads]] += first
        else:
            total[ids[heads]] += np.add.reduceat(rows, heads, axis=0)


def _add_wide(total: np.ndarray, features: np.ndarray, p: np.ndarray) -> None:
    """``_add`` for many long rows: those of a feature with several are brought together one feature after the other."""
    for f in range(features.shape[1]):
        order = np.argsort(features[:, f], kind="stable")
        ids = features[order, f]
        heads = np.flatnonzero(np.concatenate([[True], ids[1:] != ids[:-1]]))
        size = np.diff(np.append(heads, len(ids)))
        one, several = heads[size == 1], heads[size > 1]
        total[ids[one]] += p[order[one]]
        for i, a, b in zip(ids[several].tolist(), several.tolist(), (several + size[size > 1]).tolist()):
            total[i] += np.add.reduce(p[order[a:b]], 0)


_PIECES = "at int, part int, data binary"


def _gradient(table: DataFrame, model: Model, tasks: int) -> tuple[np.ndarray, ...]:
    """Observed and expected counts of every (feature, class) and (feature, cell) over the training documents of ``table``."""
    shapes = [model.weight.shape, model.weight.shape, model.cell_weight.shape, model.cell_weight.shape]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = np.zeros(sum(a * b for a, b in shapes), np.float32)
        seen, thought, cell_seen, cell_thought = _split(whole, shapes)
        began = False
        p = np.empty((ADDED, CLASSES), np.float32)
        flat = not model.weight.any() and not model.cell_weight.any()
        softmax, cells = _Softmax(model.weight, model.bias, 3), _Softmax(model.cell_weight, model.cell_bias, 2)
        for row in rows_of(batches):
            began = True
            tokens = _Tokens(Block(row))
            rank = model.ranks(tokens.keys)
            one, two = model.context(tokens, rank)
            use = np.flatnonzero(~tokens.held[tokens.doc])
            one, two, rank, ending = one[use], two[use], rank[use], tokens.ending[use]
            target = np.where(rank < SINGLES, rank, SINGLES + ending)
            if flat:
                features = model.features(one, two)
                for f in range(features.shape[1]):
                    seen.reshape(-1)[:] += np.bincount(features[:, f] * CLASSES + target, minlength=seen.size)
            else:
                # equal contexts have equal expectations: one row each, times how often it is seen
                key = one * model.width + two
                order = np.argsort(key)
                heads = np.flatnonzero(np.concatenate([[True], key[order[1:]] != key[order[:-1]]])[: len(key)])
                index, times = order[heads], np.diff(np.append(heads, len(key)))
                features = model.features(one[index], two[index])
                for f in range(features.shape[1]):
                    seen.reshape(-1)[:] += np.bincount(np.repeat(features[:, f], times) * CLASSES + target[order], minlength=seen.size)
                for i in range(0, len(index), ADDED):
                    some = features[i : i + ADDED]
                    for j in range(0, len(some), BATCH):
                        p[j : j + BATCH][: len(some) - j] = softmax.rows(some[j : j + BATCH], times[i + j : i + min(j + BATCH, ADDED)])
                    _add_wide(thought, some, p[: len(some)])
            rest = np.flatnonzero(rank >= SINGLES)
            ending, cell = ending[rest], _cell(tokens.keys[use[rest]])
            features = model.cell_features(ending, one[rest], two[rest])
            for f in range(features.shape[1]):
                cell_seen.reshape(-1)[:] += np.bincount(features[:, f] * CELLS + cell, minlength=cell_seen.size)
                if flat:
                    cell_thought += np.bincount(features[:, f] * ENDINGS + ending, minlength=CELL_ROWS * ENDINGS).reshape(CELL_ROWS, ENDINGS) @ cells.all
            for i in range(0, 0 if flat else len(rest), CELL_BATCH):
                _add(cell_thought, features[i : i + CELL_BATCH], cells.rows(features[i : i + CELL_BATCH], kind=ending[i : i + CELL_BATCH]))
        if flat:  # without weights all contexts expect the same
            thought += seen.sum(1, keepdims=True) * softmax.all
        if began:
            part, press = TaskContext.get().partitionId(), zstandard.ZstdCompressor(level=1)
            for i in range(0, len(whole), 16 * PIECE):
                pieces = [whole[j : j + PIECE] for j in range(i, min(i + 16 * PIECE, len(whole)), PIECE)]
                full = [n for n, piece in enumerate(pieces) if piece.any()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([i // PIECE + n for n in full], pa.int32()), pa.array([part] * len(full), pa.int32()), pa.array([press.compress(pieces[n].tobytes()) for n in full], pa.binary())], names=["at", "part", "data"]
                )

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The sum of each piece's messages of one group of FAN parts; rows come in order of piece and part."""
        key, held = None, None
        press, unpress = zstandard.ZstdCompressor(level=1), zstandard.ZstdDecompressor()

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([key[0]], pa.int32()), pa.array([key[1]], pa.int32()), pa.array([press.compress(held.astype(np.float32).tobytes())], pa.binary())], names=["at", "part", "data"])

        for row in rows_of(batches):
            mine = (row["at"], row["part"] // FAN)
            if mine != key:
                if key is not None:
                    yield done()
                key, held = mine, 0.0
            held = held + np.frombuffer(unpress.decompress(row["data"]), np.float32).astype(np.float64)
        if key is not None:
            yield done()

    sums = table.coalesce(tasks).mapInArrow(words.trimmed(run), _PIECES)
    while tasks > 1:
        sums = sums.repartition("at", F.floor(F.col("part") / FAN)).sortWithinPartitions("at", "part").mapInArrow(words.trimmed(total), _PIECES)
        tasks = -(-tasks // FAN)
    whole = np.zeros(sum(a * b for a, b in shapes), np.float32)
    for r in sums.toLocalIterator():
        piece = np.frombuffer(zstandard.ZstdDecompressor().decompress(r["data"]), np.float32)
        whole[r["at"] * PIECE : r["at"] * PIECE + len(piece)] += piece
    return _split(whole, shapes)


def _split(whole: np.ndarray, shapes: list[tuple[int, int]]) -> tuple[np.ndarray, ...]:
    ends = np.cumsum([a * b for a, b in shapes])
    return tuple(whole[e - a * b : e].reshape(a, b) for e, (a, b) in zip(ends, shapes))


def _rows(types: int, bounds: tuple[int, int]) -> int:
    """As many rows as a quarter of the types, a power of two within bounds."""
    return int(np.clip(1 << max(0, types // 4).bit_length(), *bounds))


def train(table: DataFrame, counts: DataFrame, steps: int = STEPS, rate: float = 0.8, prior: float = 4.0) -> Model:
    places = {r["place"]: (r["t"], r["n"]) for r in counts.where("kind = 2").groupBy("place").agg(F.sum("types").alias("t"), F.sum("n").alias("n")).collect()}
    top = counts.where("kind = 1").orderBy(F.desc("n"), "key").limit(KNOWN).select("key", "n", "place").collect()
    keys = np.array([r["key"] for r in top], np.int64).view(np.uint64)
    freq, place = np.array([r["n"] for r in top], np.int64), np.array([r["place"] for r in top], np.int64)
    lead = np.argsort(keys != END_KEY, kind="stable")  # the end comes first
    keys, freq, place = keys[lead], freq[lead], place[lead]
    tokens, types = np.zeros(ENDINGS * CELLS, np.int64), np.zeros(ENDINGS * CELLS, np.int64)
    for e, (t, n) in places.items():
        types[e], tokens[e] = t, n
    n_types, n_tokens = int(types.sum()), int(tokens.sum())
    np.add.at(tokens, place[:SINGLES], -freq[:SINGLES])
    np.add.at(types, place[:SINGLES], -1)
    of_class = np.zeros(CLASSES, np.int64)
    of_class[: len(freq[:SINGLES])] = freq[:SINGLES]
    of_class[SINGLES:] = tokens.reshape(ENDINGS, CELLS).sum(1)
    order = np.argsort(keys)
    bias = np.log((of_class + 0.5) / (of_class.sum() + 0.5 * CLASSES)).astype(np.float32)
    cell_tokens = tokens.reshape(ENDINGS, CELLS)
    cell_bias = np.log((cell_tokens + 0.5) / (cell_tokens.sum(1, keepdims=True) + 0.5 * CELLS)).astype(np.float32)
    others, pairs = _rows(n_types, OTHERS), _rows(n_types, PAIRS)
    weight = np.zeros((2 * (KNOWN + others + 1) + pairs, CLASSES), np.float32)
    model = Model(keys[order], np.arange(len(keys))[order], others, pairs, bias, weight, cell_bias, np.zeros((CELL_ROWS, CELLS), np.float32), tokens, types, n_tokens, n_types)
    present = sorted((r["slice"], r["size"]) for r in table.groupBy("slice").agg(F.sum("size").alias("size")).collect())
    for step in range(steps if present else 0):
        number, size = present[step % len(present)]
        seen, thought, cell_seen, cell_thought = _gradient(table.where(F.col("slice") == number), model, max(1, -(-size // TASK_BYTES)))
        for w, s, t in ((model.weight, seen, thought), (model.cell_weight, cell_seen, cell_thought)):
            move = (s - t - 0.01 * w) / (0.5 * (s + t) + (prior if w is model.weight else CELL_PRIOR))
            w += (rate * np.clip(move, -1.5, 1.5)).astype(np.float32) * (1.0 if step == 0 else 0.7)
    return model


def learned(docs: DataFrame, steps: int = STEPS) -> tuple[DataFrame, int, DataFrame, Model]:
    """The block table, the bits that name a hash range, the counts and the model of ``docs``."""
    table = block_table(docs, limit=4 << 20, slices=steps, tag="maxent")
    bits = range_bits(table, 20.0)
    counts = materialize(gathered(sent(table, bits, _counted), _summed(KNOWN), _COUNTS), "maxent-counts")
    return table, bits, counts, train(table, counts, steps)


def score(docs: DataFrame, steps: int = STEPS) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row of ``docs``.

    Scores are log10 probabilities of the whole text.  The documents for which
    crc32(doc_id) mod 5 is not 1 are learned from; a null doc_id counts as the
    empty string.  A null, empty or wordless text is one end; very long texts
    are scored whole.  Tokens never seen share the place of one more token, in
    all and in each cell, as in the base.  Frequent tokens that tie are ranked
    by their hash.  Repeated rows count as often as they are there; an empty table gives
    no rows; other columns are not read.
    """
    table, bits, counts, model = learned(docs, steps)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"

    def finish(block: Block, held: list[dict]) -> Iterator[pa.RecordBatch]:
        tokens = _Tokens(block)
        names, index, inverse = np.unique(tokens.keys, return_index=True, return_inverse=True)
        total, cuts = np.zeros(len(names), np.int64), cuts_of(names, bits)
        for h in held:
            total[cuts[h["bucket"]] : cuts[h["bucket"] + 1]] = unpack(h["a"]).view(np.int64)
        n_docs = len(block.ids)
        base = np.log10((total + 0.5) / (model.n_tokens + 0.5 * (model.n_types + 1)))
        rank, ending, cell = model.ranks(names), tokens.ending[index], _cell(names)
        place = ending * CELLS + cell
        within = np.log10((total + 0.5) / (model.place_tokens[place] + 0.5 * (model.place_types[place] + 1)))
        within[rank < SINGLES] = 0.0  # a class of one token has no room for others: they are classed by their ending
        target = np.where(rank < SINGLES, rank, SINGLES + ending)[inverse]
        one, two = model.context(tokens, rank[inverse])
        key = one * model.width + two
        order = np.argsort(key)
        new = np.concatenate([[True], key[order[1:]] != key[order[:-1]]])
        index, context = order[new], np.cumsum(new) - 1  # the contexts of the tokens in order
        starts = np.searchsorted(context, np.arange(0, len(index) + BATCH, BATCH))
        chosen = np.empty(len(target))
        softmax, cells = _Softmax(model.weight, model.bias, 3), _Softmax(model.cell_weight, model.cell_bias, 2)
        for i, (a, b) in enumerate(zip(starts[:-1], starts[1:])):
            at = index[i * BATCH : (i + 1) * BATCH]
            use = order[a:b]
            chosen[use] = softmax.log_chosen(model.features(one[at], two[at]), context[a:b] - i * BATCH, target[use])
        rest = np.flatnonzero(target >= SINGLES)
        for i in range(0, len(rest), CELL_BATCH):
            at = rest[i : i + CELL_BATCH]
            kind = target[at] - SINGLES
            chosen[at] += cells.log_chosen(model.cell_features(kind, one[at], two[at]), np.arange(len(at)), cell[inverse[at]], kind)
        per = lambda x: np.bincount(tokens.doc, weights=x, minlength=n_docs)
        yield pa.RecordBatch.from_arrays(
            [
                block.id_array(), pa.array(tokens.held), pa.array(tokens.count), pa.array(per(total[inverse] > 0).astype(np.int64)), pa.array([model.n_tokens] * n_docs, pa.int64()),
                pa.array(per(base[inverse])), pa.array(per(chosen / np.log(10) + within[inverse])),
            ],
            names=[f.split()[0] for f in schema.split(", ")],
        )

    return answered(table, counts.where("kind = 0").select("blk", "bucket", "a", F.lit(None).cast("binary").alias("b")), finish, schema)
