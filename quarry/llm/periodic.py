"""Periodic runs of words, found as maximal pairs of a suffix tree.

The words of a text are sorted by suffix (prefix doubling) and the LCP-interval
tree is walked from its leaves up.  Every interval keeps the positions of its
suffixes in order, each with the class of its left word.  When two lists meet in
an interval of depth l, neighbouring positions x < y whose left words differ are
a maximal pair: the l words from x and from y agree and neither side can be
extended.  If l >= 3 (y - x), the words x .. y + l repeat with period y - x, so
the pair is a run as it stands; no extension is tried.  Of the positions in one
interval only neighbours count: an occurrence between x and x + q would give the
run a smaller period.  Lists merge from the smaller into the larger, so a text
of n words costs about n log n steps, a text of one repeated word included.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.stage import read_table

#: A run has at least MIN_LENGTH words and MIN_EXPONENT periods.
MIN_LENGTH, MIN_EXPONENT = 6, 4
RUN = "struct<start:bigint,length:bigint,period:bigint>"
#: Texts are sorted together up to about this many words; a longer text alone.
CHUNK_WORDS, BLOCK = 200_000, 2000
SPACE = r"[ \t-\r]+"


class Positions:
    """A sorted list in blocks: neighbours and insertion cost a bisection and a short move."""

    def __init__(self, x: int):
        self.blocks, self.heads, self.n = [[x]], [x], 1

    def insert(self, x: int) -> tuple[int | None, int | None]:
        """Add ``x``; the positions before and after it."""
        b = max(0, bisect_left(self.heads, x) - 1)
        block = self.blocks[b]
        i = bisect_left(block, x)
        before = block[i - 1] if i else None
        after = block[i] if i < len(block) else self.heads[b + 1] if b + 1 < len(self.heads) else None
        block.insert(i, x)
        self.heads[b] = block[0]
        self.n += 1
        if len(block) > 2 * BLOCK:
            self.blocks[b : b + 1] = [block[:BLOCK], block[BLOCK:]]
            insort(self.heads, block[BLOCK])
        return before, after


def repeated_suffixes(a: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, group): suffixes that share their first ``depth`` words with another one, sorted.

    ``group`` numbers the sets that share those words.  ``a`` holds word ids
    from 0; the end counts as a word that differs from all others.
    """
    n = len(a)
    # rank[i]: place of the first suffix whose known prefix equals that of i
    rank = np.zeros(n + depth + 1, np.int64)
    order = np.argsort(a, kind="stable")
    rank[n:] = -1

    def settle(at: np.ndarray, base: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Ranks of the sorted suffixes ``at``; ``new`` marks those that differ from the one before. Returns the undecided."""
        first = np.flatnonzero(new)
        sizes = np.diff(np.append(first, len(at)))
        rank[at] = np.repeat(base[first], sizes)
        return at[np.repeat(sizes > 1, sizes)]

    value = a[order]
    live = settle(order, np.arange(n), np.append(True, value[1:] != value[:-1])) if n else order
    single = rank[:n].copy()
    known = 1

    def refine(live: np.ndarray, right: np.ndarray) -> np.ndarray:
        own = rank[live]
        by = np.lexsort((right, own))
        at, own, right = live[by], own[by], right[by]
        head = np.append(True, own[1:] != own[:-1])
        start = np.flatnonzero(head)
        base = own + np.arange(len(at)) - np.repeat(start, np.diff(np.append(start, len(at))))
        return settle(at, base, head | np.append(True, right[1:] != right[:-1]))

    while len(live) and known < depth:  # word by word, so that only repeated windows stay
        beyond = live + known
        live = refine(live, np.where(beyond < n, single[np.minimum(beyond, n - 1)], -1 - live))
        known += 1
    if not len(live):
        return live, live
    found, grams = live, rank[live].copy()
    while len(live):
        beyond = live + known
        live = refine(live, np.where(beyond < n, rank[np.minimum(beyond, n)], -1 - live))
        known *= 2
    by = np.argsort(rank[found], kind="stable")
    return found[by], grams[by]


def shared_lengths(a: list[int], sa: list[int], group: list[int]) -> list[int]:
    """The number of words each suffix shares with the one before it in its group; 0 for the first."""
    prev = {x: y for x, y, g, e in zip(sa[1:], sa, group[1:], group, strict=False) if g == e}
    plcp, n, h, last = {}, len(a), 0, -2
    for x in sorted(prev):
        h = h - 1 if last == x - 1 and h else 0  # a suffix loses at most one shared word to the next
        y = prev[x]
        top = n - max(x, y)
        while h < top and a[x + h] == a[y + h]:
            h += 1
        plcp[x], last = h, x
    return [plcp.get(x, 0) for x in sa]


def find_runs(a: np.ndarray, min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> list[tuple[int, int, int]]:
    """All (start, length, smallest period) with at least ``min_length`` words and ``min_exponent`` >= 3 periods, by start, then period."""
    if min_exponent < 3 or min_length < 2:
        raise ValueError("runs need an exponent of at least 3 and two words")
    reach = min_exponent - 1
    depth = max(min_length - max(1, min_length // min_exponent), 1)  # no run's pair shares fewer words
    sa, group = repeated_suffixes(a, depth)
    if not len(sa):
        return []
    words, sa, group = a.tolist(), sa.tolist(), group.tolist()
    found: dict[tuple[int, int], int] = {}

    def pair(x: int, y: int, depth: int) -> None:
        d = y - x
        if reach * d <= depth and d + depth >= min_length and (x == 0 or words[x - 1] != words[y - 1]):
            key = (x, d + depth)
            if d < found.get(key, d + 1):
                found[key] = d

    def merged(left: Positions, right: Positions, depth: int) -> Positions:
        if left.n < right.n:
            left, right = right, left
        last = None
        for block in right.blocks:
            for x in block:
                before, after = left.insert(x)
                if before is not None and before != last:  # two of one list met deeper in the tree
                    pair(before, x, depth)
                if after is not None:
                    pair(x, after, depth)
                last = x
        return left

    open_: list[tuple[int, Positions]] = []  # (depth shared with the next list, list)
    here = Positions(sa[0])
    for x, shared in zip([*sa[1:], -1], [*shared_lengths(words, sa, group)[1:], 0], strict=True):
        while open_ and open_[-1][0] >= max(shared, 1):
            depth, left = open_.pop()
            here = merged(left, here, depth)
        if shared:
            open_.append((shared, here))
        if x >= 0:
            here = Positions(x)
    return sorted((x, n, d) for (x, n), d in found.items())


def word_ids(words: list[bytes], offset: int) -> tuple[np.ndarray, int]:
    """Ids from ``offset`` of equal words, and the first free id."""
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, len(words))
    return ids + offset, offset + len(seen)


def _collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    if not runs:
        return b" ".join(words)
    keep = np.ones(len(words), bool)
    for start, length, period in runs:
        keep[start + period : start + length] = False
    return b" ".join([words[i] for i in np.flatnonzero(keep)])


def _scan(min_length: int, min_exponent: int):
    def run(batches):
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).cast(pa.large_binary())
            counts, runs, collapsed = [], [], []

            def flush(docs, ids):
                firsts = np.cumsum([0, *map(len, docs)])
                found: list[list] = [[] for _ in docs]
                # ids of different texts differ, so no run crosses from one to the next
                for start, length, period in find_runs(np.concatenate(ids), min_length, min_exponent):
                    d = int(np.searchsorted(firsts, start, side="right")) - 1
                    found[d].append((start - int(firsts[d]), length, period))
                for words, own in zip(docs, found, strict=True):
                    counts.append(len(words))
                    runs.append([{"start": s, "length": n, "period": p} for s, n, p in own])
                    collapsed.append(_collapse(words, own))

            docs, ids, held, free = [], [], 0, 0
            for text in texts:
                raw = text.as_py()
                docs.append(raw.split() if raw else [])
                own, free = word_ids(docs[-1], free)
                ids.append(own)
                held += len(own)
                if held >= CHUNK_WORDS:
                    flush(docs, ids)
                    docs, ids, held, free = [], [], 0, 0
            if docs:
                flush(docs, ids)
            columns = [batch.column(i) for i in range(batch.num_columns - 1)]
            run_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            extra = [pa.array(counts, pa.int64()), pa.array(runs, run_type), pa.array(collapsed, pa.binary()).cast(pa.string())]
            yield pa.RecordBatch.from_arrays([*columns, *extra], names=[*batch.schema.names[:-1], "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, keep: list[str], text: str = "text", min_length: int = MIN_LENGTH, min_exponent: int = MIN_EXPONENT) -> DataFrame:
    """``keep`` columns of docs plus n_words, runs (start, length, period; by start, then period) and collapsed.

    Words are runs without space and \\t..\\r, numbered from 0, compared byte by
    byte.  ``collapsed`` holds the words outside every run's repetitions, joined
    by one space.  Null, empty and blank texts have no words, no runs and an
    empty ``collapsed``.  Equal rows get equal results; other columns are not
    read; an empty table stays empty.  Each text is handled whole, a long one by
    one task in memory in proportion to its words.
    """
    clash = {"n_words", "runs", "collapsed"} & set(keep)
    if clash:
        raise ValueError(f"keep must not name {sorted(clash)}")
    kept = docs.select(*[F.col(_quoted(c)) for c in keep]).schema
    # plain names on the way through Arrow; the given ones may hold dots and back-ticks
    rows = docs.select(*[F.col(_quoted(c)).alias(f"k{i}") for i, c in enumerate(keep)], F.col(_quoted(text)).cast("string").alias("text"))
    schema = T.StructType([T.StructField(f"k{i}", f.dataType) for i, f in enumerate(kept.fields)])
    schema = schema.add("n_words", "long").add("runs", T.DataType.fromDDL(f"array<{RUN}>")).add("collapsed", "string")
    return rows.mapInArrow(_scan(min_length, min_exponent), schema).toDF(*keep, "n_words", "runs", "collapsed")


def _quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def planted(doc_id: Column, text: Column) -> Column:
    """The text whose words repeat from a place on, for a tenth of the ids; a null id or text stays as it is.

    With h = crc32 of the id's digits, g = floor(h / 10) and n words: if h ends
    in 0, each word from a = g % n on becomes word a + (i - a) % p, where
    p = 1 + floor((n - a) / (3 + g % 8)).
    """
    h = F.crc32(doc_id.cast("string").cast("binary"))
    words = F.filter(F.split(text, SPACE), lambda w: w != "")
    n, g = F.size(words).cast("long"), F.floor(h / 10)
    a = g % n
    p = 1 + F.floor((n - a) / (3 + g % 8))
    period = F.slice(words, (a + 1).cast("int"), p.cast("int"))
    tail = F.slice(F.flatten(F.array_repeat(period, F.ceil((n - a) / p).cast("int"))), 1, (n - a).cast("int"))
    whole = F.array_join(F.concat(F.when(a > 0, F.slice(words, 1, a.cast("int"))).otherwise(F.array().cast("array<string>")), tail), " ")
    return F.when((h % 10 == 0) & (n > 0), whole).otherwise(text)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    docs = docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs, ["doc_id"])
    longer = lambda best, r: F.when(r["length"] * best["period"] > best["length"] * r["period"], r).otherwise(best)
    best = F.when(F.size("runs") > 0, F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs"), F.lit(1))), F.col("runs")[0], longer))
    lines = F.transform("runs", lambda r: F.format_string("%d,%d,%d\n", r["start"], r["length"], r["period"]))
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("b"), F.array_join(lines, "").alias("lines"), "collapsed")
    return rows.select(
        "doc_id",
        "n_runs",
        F.col("b.start").alias("start"),
        F.col("b.length").alias("length"),
        F.col("b.period").alias("period"),
        F.expr("b.length * 1000 div b.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
