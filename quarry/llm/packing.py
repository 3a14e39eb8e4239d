"""Sequence packing by shortest-pack-first over the length histogram.

Documents are tokenised, cut every ``CAPACITY`` ids, and counted by piece
length.  The histogram (at most CAPACITY bins, whatever the corpus) is packed
longest lengths first; each bin goes to the shortest open patterns, and
patterns carry counts, so the work follows the bins.  Pieces then find their pattern by their rank among pieces of their
length.
"""

from __future__ import annotations

import zlib
from bisect import insort
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.ranks import position_in_group
from quarry.llm.stage import read_table, staged
from quarry.llm.textops import chunks, find_words, hash_words, worker_cache

CAPACITY = 4096
END_ID = 2
#: Words whose ids a worker keeps (about 100 MB); beyond it the worker starts over.
CACHE_WORDS = 1_500_000
CHUNK = 1 << 20

SPACE, LETTER, DIGIT, MARK, ODD = range(5)


def _byte_classes() -> np.ndarray:
    """The tokenizer's own piece classes, by byte; ODD bytes leave the borders around them open."""
    c = np.full(256, ODD, np.int8)
    c[[0x20, *range(0x09, 0x0E)]] = SPACE
    c[0x41:0x5B] = c[0x61:0x7B] = LETTER
    c[0x30:0x3A] = DIGIT
    c[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = MARK  # not the apostrophe
    return c


def _odd_bytes(data: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Bytes whose white-space run must go to the tokenizer whole.

    Not odd are the Latin-1 letters (lead byte C3, neither the multiplication
    nor the division sign), which get the class of letters.
    """
    follow = np.zeros(len(data), bool)
    follow[1:] = data[:-1] == 0xC3
    letter = follow & (data >= 0x80) & (data < 0xC0) & (data != 0x97) & (data != 0xB7)
    lead = np.zeros(len(data), bool)
    lead[:-1] = letter[1:]
    kind[letter | lead] = LETTER
    odd = kind == ODD
    odd[:-1] |= (data[:-1] == 0x3C) & (data[1:] == 0x7C)  # special tokens are spelled <|...|>
    return odd


class WordIds:
    """Ids of texts from the ids of their words, each word asked of the tokenizer once.

    The tokenizer drops white space and treats runs of letters, single digits
    and runs of marks separately, so a text's ids are those of its pieces, one
    after another.  Pieces are looked up by a 64-bit hash.  Runs with other
    characters (apostrophes, control characters, scripts beyond Latin-1) are
    given to the tokenizer whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.model._resize_cache(0)  # each word is asked once
        self.classes = _byte_classes()
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in plain]
        # byte-level BPE spells each byte as one printable character
        self.spelled = {b: chr(256 + i) for i, b in enumerate(other)}
        self._reset()

    def _reset(self) -> None:
        self.hashes, self.entry = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.flat, self.used = np.zeros(1 << 16, np.uint32), 0
        self.start, self.length = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def piece(self, word: bytes) -> list[int]:
        if word.isascii():
            spelled = word.lower().decode()
        else:
            spelled = word.decode().lower().encode().decode("latin-1").translate(self.spelled)
        return [t.id for t in self.model.tokenize(spelled)]

    def run(self, run: bytes) -> list[int]:
        return self.tokenizer.encode(run.decode(), add_special_tokens=False).ids

    def _add(self, ids: list[list[int]]) -> np.ndarray:
        length = np.array([len(x) for x in ids], np.int64)
        new = np.fromiter(chain.from_iterable(ids), np.uint32, int(length.sum()))
        while self.used + len(new) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(len(self.flat), np.uint32)])
        self.flat[self.used : self.used + len(new)] = new
        entry = len(self.start) + np.arange(len(ids))
        self.start = np.concatenate([self.start, self.used + np.cumsum(length) - length])
        self.length = np.concatenate([self.length, length])
        self.used += len(new)
        return entry

    def _pieces(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(starts, ends, odd) of the pieces; an odd piece is a whole run."""
        kind = self.classes[data]
        odd = _odd_bytes(data, kind)
        border = np.ones(len(data) + 1, bool)
        border[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
        border[bounds] = True
        space = kind == SPACE
        if odd.any():
            starts, ends, _ = find_words(data, bounds, "space")
            whole = np.add.reduceat(odd, starts) > 0
            strange = np.zeros(len(data) + 1, np.int32)
            np.add.at(strange, starts[whole], 1)
            np.add.at(strange, ends[whole], -1)
            inside = np.cumsum(strange)[:-1] > 0
            border[:-1] &= ~inside
            border[starts[whole]] = True
            border[ends[whole]] = True
        else:
            inside = odd
        cut = np.flatnonzero(border)
        starts, ends = cut[:-1], cut[1:]
        words = ~space[starts]
        return starts[words], ends[words], inside[starts[words]]

    def ids(self, data: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts of a chunk, bounds of each text in them)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(bounds), np.int64)
        if len(self.start) > CACHE_WORDS:
            self._reset()
        starts, ends, odd = self._pieces(data, bounds)
        entry = np.zeros(len(starts), np.int64)
        plain = np.flatnonzero(~odd)
        h, at, back = np.unique(hash_words(data, starts[plain], ends[plain]), return_index=True, return_inverse=True)
        place = np.searchsorted(self.hashes, h)
        known = np.zeros(len(h), bool)
        if len(self.hashes):
            inside = place < len(self.hashes)
            known[inside] = self.hashes[place[inside]] == h[inside]
        own = np.zeros(len(h), np.int64)
        own[known] = self.entry[place[known]]
        fresh = np.flatnonzero(~known)
        raw = data.tobytes()
        spans = zip(starts[plain[at[fresh]]].tolist(), ends[plain[at[fresh]]].tolist(), strict=True)
        own[fresh] = self._add([self.piece(raw[a:b]) for a, b in spans])
        self.hashes = np.insert(self.hashes, place[fresh], h[fresh])
        self.entry = np.insert(self.entry, place[fresh], own[fresh])
        entry[plain] = own[back]
        if len(plain) < len(starts):
            strange = np.flatnonzero(odd)
            runs = [raw[a:b] for a, b in zip(starts[strange].tolist(), ends[strange].tolist(), strict=True)]
            distinct = {r: i for i, r in enumerate(dict.fromkeys(runs))}
            added = self._add([self.run(r) for r in distinct])
            entry[strange] = added[[distinct[r] for r in runs]]
        n = self.length[entry]
        total = np.concatenate([[0], np.cumsum(n)])
        out = self.flat[np.repeat(self.start[entry] - total[:-1], n) + np.arange(total[-1])]
        return out, total[np.searchsorted(starts, bounds)]


def _pieces(path: str, keep_ids: bool):
    def run(batches):
        words = worker_cache(f"ids-{path}", lambda: WordIds(path))
        end = np.array([END_ID], "<u4").tobytes()
        step = 4 * CAPACITY
        for batch in batches:
            row, start, length, crc, total, ids = [], [], [], [], [], []
            for lo, hi, data, bounds in chunks(batch.column("text"), CHUNK):
                flat, at = words.ids(data, bounds)
                for d in range(hi - lo):
                    out = flat[at[d] : at[d + 1]].astype("<u4").tobytes() + end
                    for begin in range(0, len(out), step):
                        piece = out[begin : begin + step]
                        row.append(lo + d)
                        start.append(begin // 4)
                        length.append(len(piece) // 4)
                        crc.append(zlib.crc32(piece))
                        total.append(len(out) // 4)
                        if keep_ids:
                            ids.append(piece)
            columns = [batch.column("doc_id").take(pa.array(row, pa.int64())), *(pa.array(x, pa.int64()) for x in (start, length, crc, total))]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if keep_ids:
                columns.append(pa.array(ids, pa.binary()))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[int]]]:
    """[(how many sequences, lengths in them)]: shortest-pack-first, longest lengths first.

    A bin goes to the open patterns with the most room, as many sequences of
    each as it needs; what no pattern has room for opens a new one.  Every
    count is used up exactly.
    """
    rooms: list[int] = []  # rooms that some open pattern has, ascending
    open_at: dict[int, list[tuple[int, list[int]]]] = {}
    done: list[tuple[int, list[int]]] = []

    def put(n: int, lengths: list[int], room: int) -> None:
        if room == 0:
            done.append((n, lengths))
            return
        if room not in open_at:
            open_at[room] = []
            insort(rooms, room)
        open_at[room].append((n, lengths))

    for length in sorted(counts, reverse=True):
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} does not fit into {capacity}")
        left = counts[length]
        while left:
            if not rooms or rooms[-1] < length:
                put(left, [length], capacity - length)
                break
            room = rooms[-1]
            n, lengths = open_at[room].pop()
            if not open_at[room]:
                del open_at[room]
                rooms.pop()
            used = min(n, left)
            if used < n:
                put(n - used, lengths, room)
            put(used, [*lengths, length], room - length)
            left -= used
    for room in rooms:
        done.extend(open_at[room])
    return done


def _slots(patterns: list[tuple[int, list[int]]]) -> dict[str, np.ndarray]:
    """For each (length, range of ranks): the first sequence and the offset there, sorted by (length, first rank)."""
    rows, taken, sequence = [], {}, 0
    for n, lengths in patterns:
        offset = 0
        for length in lengths:
            rows.append((length, taken.get(length, 0), sequence, offset))
            taken[length] = taken.get(length, 0) + n
            offset += length
        sequence += n
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 4)
    return {"key": (table[:, 0] << 48) + table[:, 1], "first": table[:, 1], "sequence": table[:, 2], "offset": table[:, 3]}


def pack(docs: DataFrame, tokenizer: str, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids).

    ``tokenizer`` is the path of a tokenizer file.  A null text counts as
    empty; every document ends with id END_ID, so none is without a piece.
    Repeated rows are packed each.  Other columns of ``docs`` are dropped.  An
    empty table gives no rows.
    """
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * keep_ids
    pieces = staged(docs.select("doc_id", "text").mapInArrow(_pieces(tokenizer, keep_ids), schema), "pieces", texts=True)
    counts = {r.length: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # CAPACITY rows at most
    slots = docs.sparkSession.sparkContext.broadcast(_slots(pack_histogram(counts)))
    ranked = position_in_group(pieces, ["length"], ["doc_id", "start", "ids_crc32"], "rank", rows=sum(counts.values()))
    fields = [f for f in pieces.schema.names]

    def place(batches):
        s = slots.value
        for batch in batches:
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = np.searchsorted(s["key"], (length << 48) + rank, side="right") - 1
            sequence = s["sequence"][at] + rank - s["first"][at]
            columns = [batch.column(n) for n in fields]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sequence, pa.int64()), pa.array(s["offset"][at], pa.int64())], names=[*fields, "sequence_id", "offset"])

    return ranked.mapInArrow(place, f"{schema}, sequence_id long, offset long")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_path())
