"""Benchmark decontamination with a generalised suffix automaton.

The normalised benchmark items go into one automaton over words.  Training
documents are streamed through it; at every word the automaton's state gives
the longest run of words, ending there, that occurs in some item.  Runs that
contain a window (ten item words, or a whole shorter item) are leaked spans.

A benchmark of any size is split into automata of a bounded number of words;
documents pass them one after another.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField, StructType

from quarry.llm.stage import read_table, staged
from quarry.llm.textops import OUT_ROWS, chunks, find_words, hash_words

WINDOW = 10
#: An automaton holds this many item words at most (about 100 MB in a worker).
MAX_WORDS = 100_000
#: Automata that one pass over the documents may hold.
PER_PASS = 2
ITEM_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


class SuffixAutomaton:
    """Generalised suffix automaton over integer words, with the items of its windows."""

    def __init__(self, items: list[tuple[str, list[int]]], window: int = WINDOW):
        self.window = window
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[list[tuple[int, str, int]]] = [[]]  # state -> (whole length of the prefix, item, item's length)
        whole: dict[int, list[tuple[int, str]]] = {}
        for name, words in items:
            last = 0
            for i, w in enumerate(words):
                last = self._extend(last, w, ends)
                if len(words) >= window and i >= window - 1:
                    ends[last].append((i + 1, name, len(words)))
            if words and len(words) < window:
                whole.setdefault(last, []).append((len(words), name))
        # names of the items in which a state's strings occur, from longer states to shorter ones
        names: list[set[str]] = [{n for _, n, _ in e} for e in ends]
        for s in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            if self.length[s] >= window and self.link[s] > 0:
                names[self.link[s]] |= names[s]
        self.names = {s: n for s, n in enumerate(names) if n and self.length[s] >= window}
        self.whole = whole
        # nearest state on the link chain (itself included) that ends a short item
        self.marked = [-1] * len(self.link)
        for s in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            self.marked[s] = s if s in whole else self.marked[self.link[s]] if self.link[s] >= 0 else -1
        # the state on the chain whose strings include length `window`
        self.home = [0] * len(self.link)
        for s in sorted((s for s in range(1, len(self.link)) if self.length[s] >= window), key=lambda s: self.length[s]):
            self.home[s] = s if self.length[self.link[s]] < window else self.home[self.link[s]]

    def plain(self) -> dict:
        """All fields as lists, dicts and sets, which any Python can unpickle."""
        return dict(vars(self))

    @classmethod
    def restored(cls, fields: dict) -> SuffixAutomaton:
        out = cls.__new__(cls)
        out.__dict__.update(fields)
        return out

    def _extend(self, last: int, w: int, ends: list) -> int:
        to = self.next[last].get(w)
        if to is not None:
            if self.length[to] == self.length[last] + 1:
                return to
            return self._clone(last, w, to, ends)
        new = self._state(self.length[last] + 1, {}, 0, ends)
        p = last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = new
            p = self.link[p]
        if p >= 0:
            to = self.next[p][w]
            self.link[new] = to if self.length[to] == self.length[p] + 1 else self._clone(p, w, to, ends)
        return new

    def _state(self, length: int, following: dict, link: int, ends: list) -> int:
        self.length.append(length)
        self.next.append(following)
        self.link.append(link)
        ends.append([])
        return len(self.length) - 1

    def _clone(self, p: int, w: int, to: int, ends: list) -> int:
        copy = self._state(self.length[p] + 1, dict(self.next[to]), self.link[to], ends)
        self.link[to] = copy
        while p >= 0 and self.next[p].get(w) == to:
            self.next[p][w] = copy
            p = self.link[p]
        return copy

    def scan(self, words: list[int], at: int, spans: list[tuple[int, int]], found: set[str]) -> None:
        """Stream words (the first is number ``at``); add leaked word spans and the items they belong to."""
        following, link, length, window = self.next, self.link, self.length, self.window
        state = run = 0
        for i, w in enumerate(words, at + 1):
            to = following[state].get(w)
            while to is None and state:
                state = link[state]
                run = length[state]
                to = following[state].get(w)
            if to is None:
                continue
            state, run = to, run + 1
            if run >= window:
                found |= self.names[self.home[state]]
                spans.append((i - run, i))
            s = self.marked[state]
            while s > 0:
                for n, name in self.whole[s]:
                    if n <= run:
                        found.add(name)
                        spans.append((i - n, i))
                s = self.marked[link[s]] if link[s] > 0 else -1


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            if hi > out[-1][1]:
                out[-1] = (out[-1][0], hi)
        else:
            out.append((lo, hi))
    return out


def _scanner(vocabulary: np.ndarray, automata: list[SuffixAutomaton], text: str):
    """Arrow batches -> the same batches with n_words, spans (word numbers) and items brought up to date."""
    shortest = min((min((n for v in a.whole.values() for n, _ in v), default=a.window) for a in automata), default=WINDOW)

    def run(batches):
        for batch in batches:
            n_words, spans, items = [], [], []
            old_spans, old_items = batch.column("spans").to_pylist(), batch.column("items").to_pylist()
            row = 0
            for _, _, data, bounds in chunks(batch.column(text)):
                starts, ends, first = find_words(data, bounds, "alnum")
                if len(vocabulary):
                    h = hash_words(data, starts, ends)
                    ids = np.minimum(np.searchsorted(vocabulary, h), len(vocabulary) - 1)
                    known = vocabulary[ids] == h
                else:
                    ids, known = np.zeros(len(starts), np.int64), np.zeros(len(starts), bool)
                # maximal runs of words that some item has; only they can hold a match
                edge = np.zeros(len(known) + 1, bool)
                edge[1:-1] = known[1:] != known[:-1]
                edge[0] = True
                edge[first] = True
                cut = np.flatnonzero(edge)
                cut = cut[cut < len(known)]
                stop = np.append(cut[1:], len(known))
                wanted = known[cut] & (stop - cut >= shortest) if len(cut) else np.zeros(0, bool)
                doc_of = np.searchsorted(first, cut[wanted], side="right") - 1
                hits: dict[int, tuple[list, set]] = {}
                for d, lo, hi in zip(doc_of.tolist(), cut[wanted].tolist(), stop[wanted].tolist(), strict=True):
                    word_ids = ids[lo:hi].tolist()
                    for a in automata:
                        s, f = hits.setdefault(d, ([], set()))
                        a.scan(word_ids, lo - int(first[d]), s, f)
                for d in range(len(bounds) - 1):
                    n_words.append(int(first[d + 1] - first[d]))
                    s, f = hits.get(d, ((), ()))
                    spans.append(_union([*((x["lo"], x["hi"]) for x in old_spans[row]), *s]))
                    items.append(sorted({*old_items[row], *f}))
                    row += 1
            out = {n: batch.column(n) for n in batch.schema.names}
            out["n_words"] = pa.array(n_words, pa.int64())
            out["spans"] = pa.array([[{"lo": a, "hi": b} for a, b in s] for s in spans], pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())])))
            out["items"] = pa.array(items, pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays(list(out.values()), names=list(out))

    return run


def _pieces(batches):
    """Items as runs of at most 4096 new words, each with the window - 1 words before it."""
    step = 4096
    for batch in batches:
        name, piece, text = [], [], []
        for item, t in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist(), strict=True):
            words = re.findall(ITEM_WORD, re.sub("[A-Z]+", lambda m: m[0].lower(), t or ""))
            for lo in range(0, len(words), step):
                part = words[max(0, lo - WINDOW + 1) : lo + step] if len(words) >= WINDOW else words
                name.append(item)
                piece.append(len(part))
                text.append(" ".join(part))
        yield pa.RecordBatch.from_arrays([pa.array(name, pa.string()), pa.array(piece, pa.int64()), pa.array(text, pa.string())], names=["item", "n", "words"])


def leaked_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", max_words: int = MAX_WORDS) -> DataFrame:
    """docs with n_words, spans (disjoint leaked word ranges) and items (ids as strings, sorted).

    All columns of ``docs`` are kept; they must not be named like the three new
    ones.  Null and empty texts have no words.  Items without words (null,
    empty) match nothing; items that repeat an id count as one; a null id is
    the empty string.  An empty benchmark leaves every document clean.
    """
    return _scanned(docs, benchmark, text, max_words)


def _scanned(docs: DataFrame, benchmark: DataFrame, text: str, max_words: int, finish=None) -> DataFrame:
    """leaked_spans; ``finish`` (a function of batches, with a column ``cut`` more) runs in the last pass, in the same worker."""
    clash = {"n_words", "spans", "items", *(["cut"] if finish else [])} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text")
    pieces = staged(items.mapInArrow(_pieces, "item string, n long, words string").distinct(), "benchmark")
    total = pieces.agg(F.sum("n")).first()[0] or 0
    parts = max(1, -(-2 * total // max_words))  # twice as many as needed: parts of a hash differ in size
    empty = "cast(array() as array<struct<lo: bigint, hi: bigint>>)"
    out = docs.selectExpr("*", "0L as n_words", f"{empty} as spans", "cast(array() as array<string>) as items")
    part = F.pmod(F.xxhash64("item", "words"), F.lit(parts))
    if pieces.groupBy(part).agg(F.sum("n").alias("n")).where(F.col("n") > max_words + 4096 + WINDOW).limit(1).count():
        raise ValueError(f"a part of the benchmark has more than {max_words} words")
    held: list[list] = []
    for p in range(parts):
        held.append(pieces.where(part == p).collect())
        if len(held) == PER_PASS or p == parts - 1:
            out = _pass(out, held, text, finish if p == parts - 1 else None)
            held = []
            if p < parts - 1:
                out = staged(out, "scanned", texts=True)
    return out


def _pass(docs: DataFrame, parts: list, text: str, finish=None) -> DataFrame:
    spark = docs.sparkSession
    sequences = [[(r.item, r.words.split(" ")) for r in own] for own in parts]
    distinct = sorted({w for part in sequences for _, words in part for w in words})
    if distinct:
        data = np.frombuffer("\n".join(distinct).encode(), np.uint8)
        starts, ends, _ = find_words(data, np.array([0, len(data)]), "alnum")
        hashes = hash_words(data, starts, ends)
    else:
        hashes = np.zeros(0, np.uint64)
    vocabulary = np.sort(hashes)
    number = dict(zip(distinct, np.searchsorted(vocabulary, hashes).tolist(), strict=True))
    automata = [SuffixAutomaton([(name, [number[w] for w in words]) for name, words in sorted(part)]) for part in sequences]
    # plain values: executors without this package cannot unpickle its classes from a broadcast
    held = spark.sparkContext.broadcast((vocabulary, [a.plain() for a in automata]))
    schema = StructType([*docs.schema.fields, *([StructField("cut", BooleanType())] if finish else [])])

    def run(batches):
        vocabulary, fields = held.value
        scanned = _scanner(vocabulary, [SuffixAutomaton.restored(f) for f in fields], text)(batches)
        yield from finish(scanned) if finish else scanned

    return docs.mapInArrow(run, schema)


def _cutter(min_words: int, max_share: float, text: str):
    def run(batches):
        for batch in batches:
            keep, texts = [], []
            spans = batch.column("spans").to_pylist()
            row = 0
            for _, _, data, bounds in chunks(batch.column(text)):
                starts, ends, first = find_words(data, bounds, "alnum")
                for d in range(len(bounds) - 1):
                    own = [(x["lo"], x["hi"]) for x in spans[row] if x["hi"] - x["lo"] >= min_words]
                    n = int(first[d + 1] - first[d])
                    share = sum(b - a for a, b in own) / n if n else 0.0
                    if share <= max_share:
                        keep.append(row)
                        at, parts = int(bounds[d]), []
                        for a, b in own:
                            parts.append(data[at : starts[first[d] + a]].tobytes())
                            at = int(ends[first[d] + b - 1])
                        parts.append(data[at : bounds[d + 1]].tobytes())
                        texts.append(b"".join(parts).decode() if own else None)
                    row += 1
            kept = batch.take(pa.array(keep, pa.int64()))
            old = kept.column(text)
            new = [o if n is None else n for o, n in zip(old.to_pylist(), texts, strict=True)]
            columns = {n: kept.column(n) for n in kept.schema.names}
            columns[text] = pa.array(new, old.type)
            columns["cut"] = pa.array([n is not None for n in texts], pa.bool_())
            out = pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
            yield from (out.slice(lo, OUT_ROWS) for lo in range(0, max(1, out.num_rows), OUT_ROWS))

    return run


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_words: int = 1, max_share: float = 0.5, max_words: int = MAX_WORDS) -> DataFrame:
    """docs without leaked spans of at least ``min_words`` words; a document of which more than ``max_share`` of the words are in such spans goes.

    The columns are those of ``docs``; ``n_chars``, if there, counts the new
    text.  Rows without a leak are unchanged, null texts included.
    """
    out = _scanned(docs, benchmark, "text", max_words, _cutter(min_words, max_share, "text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("cut"), F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    spans = leaked_spans(docs, read_table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["hi"] - s["lo"])
    return spans.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", F.array_sort("items")).cast("binary"), 256).alias("items_sha256"),
        (hit > 0).alias("contaminated"),
    )
