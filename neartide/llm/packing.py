"""Packing tokenised documents into as few sequences as possible by bin completion.

Lengths are whole numbers up to the capacity, so the packing problem is its
histogram: at most ``capacity`` numbers, whatever the corpus.  The histogram is
solved on the driver by branch and bound.  Each node takes the largest length
left and branches on undominated fillings of the room beside it, cuts branches
by the waste that a better solution could still afford, and starts from a
best-fit solution as incumbent.  Fillings are applied as often as the counts
allow first, then half as often and so on down to once, so the search is whole
when its nodes suffice and a solution is a list of fillings with multiplicities.  Pieces
are then ranked among those of their length and take the places of that rank.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from neartide.llm import words
from neartide.plans.storage import materialize

CAPACITY = 2048
MEMO = 1 << 19  # words of which a worker remembers the ids; the memory is bounded, the ids do not depend on it
WORDS = 1 << 15  # words after which it looks whether they are too many
NODES = 40_000  # of the search
STEPS = 1_000  # of the enumeration of fillings that count as a node
_END = b"\0\0\0\0"

_open: dict = {}


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# words of these characters only are split here; any other word goes through the whole tokenizer
_PLAIN = re.compile(r"[A-Za-z0-9À-ÖØ-öø-ÿ!\"#$%&()*+,\-./:;=>?@\[\\\]^_`{|}~]+")
_PARTS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_ASCII_PARTS = re.compile(rb"[a-z]+|[0-9]|[^a-z0-9]+")


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write characters that are not visible ASCII: a visible Latin-1 byte as itself, the n-th other byte as character 256 + n."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in visible]
    letter = {b: chr(b) for b in visible} | {b: chr(256 + n) for n, b in enumerate(others)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0x100) if chr(c) != letter.get(c) or c >= 0x80}


class _Encoder(dict):
    """The ids of words, found as they are asked for: the vocabulary never joins across ASCII white space.

    A word is cut where the tokenizer cuts it, into runs of letters, digits and
    runs of other signs.  Such a part is a word too and is remembered as one, so
    that case and punctuation do not make a word new.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # this memory is the cache
        self.letters = _byte_letters()

    def _merged(self, part: str) -> bytes:
        tokens = self.model.tokenize(part)
        return struct.pack(f"<{len(tokens)}I", *[t.id for t in tokens])

    def __missing__(self, word: bytes) -> bytes:
        if len(word) > 256:  # such words are rare and long: they are not remembered
            return self._whole(word)
        if word.isascii():
            low = word.lower()
            if low.isalpha():
                out = self._merged(low.decode()) if low == word else self[low]
            elif b"'" in low or b"<|" in low:
                out = self._whole(word)
            else:
                parts = _ASCII_PARTS.findall(low)
                out = b"".join([self[p] for p in parts]) if len(parts) > 1 else self._merged(low.decode().translate(self.letters))
        else:
            text = word.decode()
            if _PLAIN.fullmatch(text):
                parts = _PARTS.findall(text.lower())
                out = b"".join([self[p.encode()] for p in parts]) if len(parts) > 1 else self._merged(parts[0].translate(self.letters))
            else:
                out = self._whole(word)
        self[word] = out
        return out

    def _whole(self, word: bytes) -> bytes:
        ids = self.tokenizer.encode(word.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: bytes | None) -> bytes:
        """Little-endian unsigned 32-bit ids of a text, an id 0 at the end."""
        found = (text or b"").split()
        out = []
        for i in range(0, len(found), WORDS):
            if len(self) > MEMO:
                self.clear()
            out.append(b"".join(map(self.__getitem__, found[i : i + WORDS])))
        return b"".join(out) + _END


def encoder(path: str) -> _Encoder:
    if path not in _open:
        _open[path] = _Encoder(path)
    return _open[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """The pieces of every row of ``docs``: documents longer than ``capacity`` tokens are cut, no others."""
    schema = _PIECES + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, texts in words.blocks(batches, 1 << 20):
            rows = []
            encode = encoder(path).encode
            for k, text in zip(ids, texts):
                data = encode(text)
                for n, at in enumerate(range(0, len(data), 4 * capacity)):
                    part = data[at : at + 4 * capacity]
                    rows.append((k, n, at // 4, len(part) // 4, zlib.crc32(part), part) if with_ids else (k, n, at // 4, len(part) // 4, zlib.crc32(part)))
            types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[f.split()[0] for f in schema.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(words.trimmed(run), schema)


# ---- the search: a solution is a list of (lengths of one sequence, how many sequences)


def best_fit(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Longest first, each into the fullest sequence with room."""
    room: dict[int, list[list]] = defaultdict(list)
    open_rooms = np.zeros(capacity + 1, bool)
    for size in range(capacity, 0, -1):
        left = int(counts[size])
        while left:
            fit = np.flatnonzero(open_rooms[size:])
            if not len(fit):
                per = capacity // size
                for n, bins in ((per, left // per), (left % per, 1)):
                    if n and bins:
                        room[capacity - n * size].append([(size,) * n, bins])
                        open_rooms[capacity - n * size] = True
                break
            space = int(fit[0]) + size
            filling, bins = room[space].pop()
            if not room[space]:
                open_rooms[space] = False
            if bins > left:
                room[space].append([filling, bins - left])
                open_rooms[space] = True
                bins = left
            room[space - size].append([(*filling, size), bins])
            open_rooms[space - size] = True
            left -= bins
    return [(f, n) for same in room.values() for f, n in same]


def lower_bound(counts: np.ndarray, capacity: int) -> int:
    """The larger of the volume bound and, over some thresholds, the bound by items that cannot share."""
    size = np.arange(capacity + 1)
    total = int((counts * size).sum())
    bound = -(-total // capacity)
    above = np.cumsum(counts[::-1])[::-1]
    volume = np.concatenate([np.cumsum((counts * size)[::-1])[::-1], [0]])
    for k in range(0, capacity // 2 + 1):
        big = int(above[capacity - k + 1]) if k else 0
        half = int(above[capacity // 2 + 1]) - big
        middle_volume = int(volume[capacity // 2 + 1] - (volume[capacity - k + 1] if k else 0))
        small_volume = int(volume[max(k, 1)] - volume[capacity // 2 + 1])
        bound = max(bound, big + half + max(0, -(-(small_volume - (half * capacity - middle_volume)) // capacity)))
    return bound


def fillings(counts: np.ndarray, room: int, allowed: int, most: int = 3) -> list[tuple[int, ...]]:
    """The most promising fillings of ``room`` with waste up to ``allowed``, least waste first, then with the largest lengths; not all of them.

    A single length that fills the room dominates every other filling of it.
    """
    if room > 0 and counts[room] > 0:
        return [(room,)]
    sizes = np.flatnonzero(counts[: room + 1])[::-1]
    if not len(sizes):
        return [()] if room <= allowed else []
    below = np.zeros(room + 1, np.int64)  # the largest length of which there is one, at most this
    below[sizes] = sizes
    below = np.maximum.accumulate(below)
    found: dict[tuple[int, ...], int] = {}

    def put(filling: tuple[int, ...]) -> None:
        waste = room - sum(filling)
        if waste <= allowed:
            found.setdefault(tuple(sorted(filling, reverse=True)), waste)

    rest = room - sizes
    second = below[rest]
    fine = (second <= sizes) & ((second < sizes) | (counts[sizes] > 1))
    pair_waste = np.where(fine, rest - second, room)
    for i in np.argsort(pair_waste, kind="stable")[:2]:
        if fine[i]:
            put((int(sizes[i]), int(second[i])) if second[i] else (int(sizes[i]),))
    if pair_waste.min() > 0:
        for a in sizes[:48].tolist():
            inner = room - a
            own = sizes[sizes <= min(a, inner)]
            if not len(own):
                continue
            third = below[inner - own]
            need = (own == a).astype(int) + (third == a) + 1
            ok = (third <= own) & (counts[a] >= need) & ((third < own) | (counts[own] > 1 + (own == a)))
            if ok.any():
                waste = np.where(ok, inner - own - third, room)
                j = int(waste.argmin())
                put(tuple(x for x in (a, int(own[j]), int(third[j])) if x))
                if waste[j] == 0:
                    break
    greedy, left, space = [], counts, room
    copied = False
    while space > 0:
        x = int(below[space])
        while x and left[x] <= 0:
            x = int(below[x - 1]) if x > 1 else 0
        if not x:
            break
        if not copied:
            left, copied = left.copy(), True
        left[x] -= 1
        greedy.append(x)
        space -= x
    put(tuple(greedy))
    return sorted(found, key=lambda f: (found[f], [-x for x in f]))[:most]


def other_fillings(counts: np.ndarray, room: int, allowed: int) -> Iterator[tuple[int, ...] | None]:
    """Every filling of ``room`` with waste up to ``allowed`` in which no length left over could be added or take the place of a shorter one; None after each STEPS steps."""
    sizes = np.flatnonzero(counts[: room + 1])[::-1].tolist()
    left = [int(counts[x]) for x in sizes]
    volume = [0]  # of the lengths from each place on
    for x, n in zip(reversed(sizes), reversed(left)):
        volume.append(volume[-1] + x * n)
    volume.reverse()

    def dominated(taken: dict[int, int], waste: int) -> bool:
        spare = [x for x, n in zip(sizes, left) if n > taken.get(x, 0)]
        if spare and spare[-1] <= waste:
            return True
        return any(x < y <= x + waste for x in taken for y in spare) if waste else False

    steps = 0
    stack: list[tuple[int, int, tuple[int, ...]]] = [(0, room, ())]
    while stack:
        steps += 1
        if steps % STEPS == 0:
            yield None
        i, space, filling = stack.pop()
        while i < len(sizes) and sizes[i] > space:
            i += 1
        if i == len(sizes):
            if space <= allowed:
                taken: dict[int, int] = defaultdict(int)
                for x in filling:
                    taken[x] += 1
                if not dominated(taken, space):
                    yield filling
            continue
        if space - volume[i] > allowed:
            continue
        x = sizes[i]
        for n in range(0, min(left[i], space // x) + 1):  # the most of the largest length comes off the stack first
            stack.append((i + 1, space - n * x, filling + (x,) * n))


def _choices(state: np.ndarray, capacity: int, allowed: int) -> Iterator[tuple[tuple[int, ...], int] | None]:
    """(filling with the largest length left, multiplicity) in the order of the search; None where a node's worth of steps is spent."""
    largest = int(np.flatnonzero(state)[-1])
    room = capacity - largest
    rest = state.copy()
    rest[largest] -= 1

    def often(option: tuple[int, ...]) -> int:
        need: dict[int, int] = defaultdict(int)
        for x in (largest, *option):
            need[x] += 1
        times = min(int(state[x]) // n for x, n in need.items())
        waste = room - sum(option)
        return max(1, min(times, allowed // waste)) if waste else times

    first = fillings(rest, room, allowed)
    for option in first:
        yield (largest, *option), often(option)
    if first == [()] or (len(first) == 1 and first[0] == (room,)):
        return  # nothing fits, or one length fills the room: no other choice can be better
    for option in first:
        times = often(option)
        while times > 1:
            times //= 2
            yield (largest, *option), times
    known = set(first)
    for option in other_fillings(rest, room, allowed):
        if option is None:
            yield None
        elif option not in known:
            times = often(option)
            yield (largest, *option), times
            while times > 1:
                times //= 2
                yield (largest, *option), times


def solve(counts: np.ndarray, capacity: int, nodes: int = NODES) -> tuple[list[tuple[tuple[int, ...], int]], int]:
    """The best solution found and a lower bound on the number of sequences; the best there is if the search ends before its nodes do."""
    best = best_fit(counts, capacity)
    used = sum(n for _, n in best)
    bound = lower_bound(counts, capacity)
    sizes = np.arange(capacity + 1)
    total = int((counts * sizes).sum())
    if used == bound or not total:
        return best, bound

    def affordable(state: np.ndarray, bins: int) -> int:
        """Waste that a solution better than the incumbent can still afford."""
        return (used - 1 - bins) * capacity - int((state * sizes).sum())

    path: list[tuple[tuple[int, ...], int]] = []
    start = counts.astype(np.int64)
    stack = [(start, 0, _choices(start, capacity, affordable(start, 0)))] if affordable(start, 0) >= 0 else []
    while stack and nodes and used > bound:
        state, bins, choices = stack[-1]
        del path[len(stack) - 1 :]
        choice = next(choices, ())
        if choice == () or affordable(state, bins) < 0:
            stack.pop()
            continue
        nodes -= 1
        if choice is None:
            continue
        filling, times = choice
        path.append(choice)
        after = state.copy()
        for x in filling:
            after[x] -= times
        if not after.any():
            if bins + times < used:
                best, used = list(path), bins + times
        elif (allowed := affordable(after, bins + times)) >= 0:
            stack.append((after, bins + times, _choices(after, capacity, allowed)))
    return best, bound


# ---- places


def pack(pieces_table: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to a table with doc_id, piece, length and ids_crc32.

    Pieces of one length are interchangeable.  They are numbered in salted
    groups, so that a length that a third of all pieces have is spread out.
    """
    spark = pieces_table.sparkSession
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces_table.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect():  # at most ``capacity`` rows
        counts[r["length"]] = r["n"]
    total = int(counts.sum())
    solution, _ = solve(counts, capacity)
    ranges, given, base = [], np.zeros(capacity + 1, np.int64), 0
    for filling, times in solution:
        offset = 0
        for x in filling:
            ranges.append((x, int(given[x]), base, offset))
            given[x] += times
            offset += x
        base += times
    ranges.sort()
    table = np.array(ranges, np.int64).reshape(-1, 4)  # bounded by the capacity and the search's nodes, not the corpus
    code = (table[:, 0] << 48) | table[:, 1]

    salts = max(16, total // 250_000)
    salted = pieces_table.withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(salts)).cast("int"))
    sums = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = sums.select("length", "salt", (F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")).alias("before"))
    order = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32")
    ranked = salted.withColumn("n", F.row_number().over(order) - 1).join(before, ["length", "salt"]).withColumn("rank", F.col("before") + F.col("n")).drop("salt", "n", "before")
    names = pieces_table.columns

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = np.asarray(batch.column(len(names)))
            at = np.searchsorted(code, (np.asarray(batch.column(names.index("length"))) << 48) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(names)], pa.array(table[at, 2] + rank - table[at, 1]), pa.array(table[at, 3])], names=[*names, "sequence_id", "offset"]
            )

    schema = pieces_table.schema.add("sequence_id", "long").add("offset", "long")
    return ranked.select(*names, "rank").mapInArrow(words.trimmed(place), schema) if total else spark.createDataFrame([], schema)


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    A null or empty text is the single id 0.  Repeated rows are packed each on
    their own; a null doc_id stays null; an empty table gives no rows; other
    columns are not read.  Every document must be read whole to be tokenised.
    """
    return pack(materialize(pieces(docs, path or vocabulary_path(), capacity), "pieces"), capacity)
