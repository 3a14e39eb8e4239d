"""Toxicity scores from a convolutional text classifier trained in numpy.

Words are hashed into two embedding tables; filters of several widths run over
the word sequence, each keeps its largest response in the text, and a logistic
layer scores the pooled responses.  All labelled rows that are not held out are
learnt from: they are dealt to shards, every shard trains a copy of the net for
an epoch, and the copies are averaged where they changed.  Scoring is one pass
over the documents with the filters folded into the tables, so a word costs two
table rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.llm.stage import read_table, staged
from quarry.llm.textops import OUT_ROWS, U64, chunks, find_words, hash_words

#: Labelled rows and characters of a shard, on average: what one task trains on at a time.
SHARD_ROWS, SHARD_CHARS = 8000, 1 << 26
#: Labels of at most so many rows are sent to the texts; more of them are joined by a shuffle.
SENT_LABELS = 4_000_000
#: Averaged weights cross the shuffle in so many pieces; logits of the calibration rows are counted by steps of 1 / LOGIT_STEPS.
PIECES, LOGIT_STEPS = 64, 1000
BUCKETS, DIM = 1 << 15, 8
FILTERS = {1: 8, 2: 4, 3: 4}
EPOCHS, BATCH, RATE, DECAY, DROP, SEED = 6, 16, 0.05, 1e-5, 0.1, 11
CUT = 0.3
#: A language needs this many calibration rows of either label for a threshold of its own.
LEAST_ROWS = 20


@dataclass
class ConvNet:
    tables: np.ndarray  # (2, BUCKETS, DIM)
    filters: dict[int, np.ndarray]  # width -> (width, 2 * DIM, filters)
    bias: dict[int, np.ndarray]
    out: np.ndarray
    shift: np.ndarray  # intercept
    scale: np.ndarray = field(default_factory=lambda: np.array([1.0, 0.0]))  # calibration of the logit

    def embed(self, h: np.ndarray) -> np.ndarray:
        return np.concatenate([self.tables[0][_bucket(h, 0)], self.tables[1][_bucket(h, 1)]], axis=1)

    def pooled(self, x: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        """(responses, place of each filter's largest response) for one text; x ends in zero rows for the widest filter."""
        n = len(x) - max(self.filters) + 1
        parts, places = [], []
        for w, f in self.filters.items():
            z = sum(x[k : k + n] @ f[k] for k in range(w)) + self.bias[w]
            at = z.argmax(0)
            parts.append(z[at, np.arange(z.shape[1])])
            places.append(at)
        return np.concatenate(parts), places

    def logit(self, h: np.ndarray) -> float:
        x = np.zeros((max(len(h), 1) + max(self.filters) - 1, 2 * DIM), np.float32)
        x[: len(h)] = self.embed(h)
        r, _ = self.pooled(x)
        return float(np.maximum(r, 0) @ self.out + self.shift[0])

    def score(self, logits: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.scale[0] * logits + self.scale[1], -30, 30)))

    def folded(self) -> list[np.ndarray]:
        """Both tables times every filter column: (BUCKETS, sum of width * filters) each."""
        columns = np.concatenate([f[k] for f in self.filters.values() for k in range(len(f))], axis=1)
        return [np.ascontiguousarray(self.tables[i] @ columns[i * DIM : (i + 1) * DIM], np.float32) for i in range(2)]


def _bucket(h: np.ndarray, table: int) -> np.ndarray:
    return ((h >> U64(32 * table)) & U64(BUCKETS - 1)).astype(np.int64)


def _word_rows(docs: list[np.ndarray], y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows with a word of the bucket, those of them with label 1) by table and bucket."""
    n, pos = np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS))
    for h, label in zip(docs, y, strict=True):
        for t in range(2):
            b = np.unique(_bucket(h, t))
            n[t, b] += 1
            pos[t, b] += label
    return n, pos


def _start(n: np.ndarray, pos: np.ndarray, rate: float, rng) -> ConvNet:
    """Small random filters and tables; one coordinate of each table starts at its words' association with the label."""
    tables = rng.normal(0, 0.05, (2, BUCKETS, DIM)).astype(np.float32)
    for t in range(2):
        tables[t, :, 0] = np.clip((pos[t] - rate * n[t]) / np.sqrt(rate * n[t] + 3), -2, 4) / 4
    filters, bias = {}, {}
    for w, n in FILTERS.items():
        f = rng.normal(0, 0.1, (w, 2 * DIM, n)).astype(np.float32)
        f[0, [0, DIM], : n // 2] += 1.0
        filters[w], bias[w] = f, np.zeros(n, np.float32)
    return ConvNet(tables, filters, bias, np.full(sum(FILTERS.values()), 0.3, np.float32), np.array([-3.0], np.float32))


def _flat(net: ConvNet) -> ConvNet:
    """The net whose every text scores the same."""
    net.out[:] = 0
    return net


def _rate_logit(rate: float) -> np.ndarray:
    return np.array([0.0, float(np.log((rate + 1e-4) / (1 - rate + 1e-4)))])


def _dense(net: ConvNet) -> list[np.ndarray]:
    return [net.out, net.shift, *net.filters.values(), *net.bias.values()]


def _epoch(net: ConvNet, grown: list[np.ndarray], grown_t: np.ndarray, docs: list[np.ndarray], y: np.ndarray, fit: np.ndarray, rng) -> None:
    """One pass over the rows ``fit``; the net and its sums of squared gradients change in place."""
    pad = max(FILTERS) - 1
    params = _dense(net)
    for lo in range(0, len(fit), BATCH):
        grads = [np.zeros_like(p) for p in params]
        touched: list[tuple[int, np.ndarray, np.ndarray]] = []
        batch = rng.permutation(fit)[:BATCH] if lo == 0 else fit[lo : lo + BATCH]
        for i in batch:
            h = docs[i]
            if len(h) > 1:
                h = h[rng.random(len(h)) >= DROP]
            x = np.zeros((max(len(h), 1) + pad, 2 * DIM), np.float32)
            x[: len(h)] = net.embed(h)
            r, places = net.pooled(x)
            a = np.maximum(r, 0)
            g = 1 / (1 + np.exp(-np.clip(a @ net.out + net.shift[0], -30, 30))) - y[i]
            grads[0] += g * a
            grads[1] += g
            back = g * net.out * (r > 0)
            at = 0
            for j, (w, f) in enumerate(net.filters.items()):
                d = back[at : at + f.shape[2]]
                at += f.shape[2]
                grads[2 + len(FILTERS) + j] += d
                for k in range(w):
                    rows = places[j] + k
                    grads[2 + j][k] += x[rows].T * d
                    inside = rows < len(h)
                    if inside.any():
                        dx = (f[k] * d).T[inside]
                        words = h[rows[inside]]
                        touched += [(t, _bucket(words, t), dx[:, t * DIM : (t + 1) * DIM]) for t in range(2)]
        for p, s, gr in zip(params, grown, grads, strict=True):
            gr = gr / len(batch) + DECAY * p
            s += gr * gr
            p -= RATE * gr / np.sqrt(s)
        for t in range(2):
            own = [(b, d) for u, b, d in touched if u == t]
            if own:
                b, back_to = np.unique(np.concatenate([b for b, _ in own]), return_inverse=True)
                gr = np.zeros((len(b), DIM), np.float32)
                np.add.at(gr, back_to, np.concatenate([d for _, d in own]))
                gr /= len(batch)
                grown_t[t, b] += (gr * gr).mean(1)
                net.tables[t, b] -= RATE * gr / np.sqrt(grown_t[t, b])[:, None]
    rng.shuffle(fit)


def _unlearnt(net: ConvNet) -> tuple[list[np.ndarray], np.ndarray]:
    return [np.full_like(p, 1e-4) for p in _dense(net)], np.full(net.tables.shape[:2], 1e-4, np.float32)


def _copy(net: ConvNet, scale: np.ndarray) -> ConvNet:
    return ConvNet(net.tables.copy(), {w: f.copy() for w, f in net.filters.items()}, {w: b.copy() for w, b in net.bias.items()}, net.out.copy(), net.shift.copy(), scale)


def train(docs: list[np.ndarray], labels: np.ndarray, epochs: int = EPOCHS, seed: int = SEED) -> tuple[ConvNet, np.ndarray, np.ndarray]:
    """(net, calibration rows, their scores) of rows in memory.  ``docs`` holds each text's word hashes.

    A fifth of the rows is kept out: the epoch with the least loss on them wins
    and their scores calibrate the logit.  Without rows of both labels the net
    scores everything with the label rate.
    """
    rng = np.random.default_rng(seed)
    y = np.asarray(labels, np.float32)
    order = rng.permutation(len(y))
    held, fit = order[: len(y) // 5], order[len(y) // 5 :]
    if not len(y) or y[fit].min(initial=1) == y[fit].max(initial=0) or len(held) < 2:
        net = _flat(_start(*_word_rows([], np.zeros(0)), 0.0, rng))
        net.scale = _rate_logit(float(y.mean()) if len(y) else 0.0)
        return net, held, net.score(np.zeros(len(held)))
    net = _start(*_word_rows([docs[i] for i in fit], y[fit]), y[fit].mean(), rng)
    grown, grown_t = _unlearnt(net)
    best, best_loss = None, np.inf
    for _ in range(epochs):
        _epoch(net, grown, grown_t, docs, y, fit, rng)
        z = np.array([net.logit(docs[i]) for i in held])
        scale, loss = _calibrate(z, y[held])
        if loss < best_loss:
            best_loss, best = loss, _copy(net, scale)
    z = np.array([best.logit(docs[i]) for i in held])
    return best, held, best.score(z)


def _calibrate(z: np.ndarray, y: np.ndarray, rows: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Slope and intercept of the logit by Newton steps with a weak prior at (1, 0); the mean loss.  An entry stands for ``rows`` rows."""
    rows = np.ones(len(z)) if rows is None else rows
    prior = np.array([1.0, 0.0])
    a = prior.copy()
    x = np.stack([z, np.ones_like(z)], 1)

    def loss(a):
        t = np.clip(x @ a, -30, 30)
        return float(np.average(np.logaddexp(0, t) - y * t, weights=rows))

    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ a, -30, 30)))
        g = x.T @ (rows * (p - y)) + (a - prior)
        hess = (x * (rows * p * (1 - p))[:, None]).T @ x + np.eye(2)
        a = a - np.linalg.solve(hess, g)
    if a[0] <= 0:
        a = prior
    return a, loss(a)


def language_thresholds(scores: np.ndarray, labels: np.ndarray, langs: list[str | None], rows: np.ndarray | None = None) -> dict[str | None, float]:
    """For each language the threshold with the best F1 on the calibration rows; None has the one for all languages.

    Thresholds stay in [0.2, 0.8]; ties go to the one nearest CUT.  A language
    with under LEAST_ROWS rows of a label takes the common threshold.  An entry
    stands for ``rows`` rows.
    """

    def best(s, y, n):
        grid = np.linspace(0.2, 0.8, 61)
        f1 = [2 * (y * n)[s >= t].sum() / max(1, n[s >= t].sum() + (y * n).sum()) for t in grid]
        top = [t for t, f in zip(grid, f1, strict=True) if f >= max(f1) - 1e-12]
        return float(min(top, key=lambda t: (abs(t - CUT), t)))

    y = np.asarray(labels)
    n = np.ones(len(y)) if rows is None else rows
    if min(n[y == 1].sum(), n[y == 0].sum()) < LEAST_ROWS:
        return {None: CUT}
    out: dict[str | None, float] = {None: best(scores, y, n)}
    for lang in sorted({x for x in langs if x is not None}):
        own = np.array([x == lang for x in langs])
        if min(n[own & (y == 1)].sum(), n[own & (y == 0)].sum()) >= LEAST_ROWS:
            out[lang] = best(scores[own], y[own], n[own])
    return out


def held_out(doc_id: Column) -> Column:
    """Rows of which no label is learnt: crc32 of the id's text leaves 2 modulo 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def word_hashes(texts: pa.Array) -> list[np.ndarray]:
    out = []
    for lo, hi, data, bounds in chunks(texts):
        starts, ends, first = find_words(data, bounds, "alnum")
        h = hash_words(data, starts, ends)
        out += [h[first[i] : first[i + 1]] for i in range(hi - lo)]
    return out


def _pack(key, rows):
    """One row of a shard: its texts' bucket pairs, ends, labels, languages and which rows calibrate."""
    texts = rows.column("text").combine_chunks()
    codes = [(_bucket(h, 0) | (_bucket(h, 1) << 15)).astype("<u4") for h in word_hashes(texts)]
    y, calibrates = rows.column("toxic").to_numpy(), rows.column("calibrates").to_numpy()
    at = rows.column("at").to_numpy()
    order = sorted(range(len(codes)), key=lambda i: (at[i], codes[i].tobytes(), y[i]))
    langs = rows.column("lang").to_pylist()
    return pa.table({
        "shard": pa.array([key[0].as_py()], pa.int32()),
        "words": pa.array([b"".join(codes[i].tobytes() for i in order)], pa.binary()),
        "ends": pa.array([np.cumsum([len(codes[i]) for i in order]).astype("<i8").tobytes()], pa.binary()),
        "y": pa.array([y[order].astype("<f4").tobytes()], pa.binary()),
        "calibrates": pa.array([calibrates[order].astype("?").tobytes()], pa.binary()),
        "langs": pa.array([[langs[i] for i in order]], pa.list_(pa.string())),
    })


def _shards(batches):
    """(shard, word hashes by row, labels, calibration flags, languages) of packed rows."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {c: batch.column(c)[i].as_py() for c in batch.schema.names}
            codes = np.frombuffer(row["words"], "<u4").astype(np.uint64)
            h = (codes & U64(BUCKETS - 1)) | ((codes >> U64(15)) << U64(32))
            ends = np.frombuffer(row["ends"], "<i8")
            docs = [h[lo:hi] for lo, hi in zip([0, *ends[:-1]], ends, strict=True)]
            yield row["shard"], docs, np.frombuffer(row["y"], "<f4"), np.frombuffer(row["calibrates"], "?"), row["langs"]


def _parts(total: np.ndarray, part: int):
    """A task's vector cut into PIECES rows."""
    pieces = np.array_split(total.astype("<f4"), PIECES)
    return pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([part] * PIECES, pa.int32()), pa.array([p.tobytes() for p in pieces], pa.binary())], names=["piece", "part", "v"])


def _added(key, rows):
    parts = sorted(zip(rows.column("part").to_pylist(), rows.column("v").to_pylist(), strict=True))
    total = sum(np.frombuffer(v, "<f4").astype("<f8") for _, v in parts)
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "v": pa.array([total.tobytes()], pa.binary())})


def _total(shards: DataFrame, run) -> np.ndarray:
    """The sum of the tasks' vectors, added piece by piece on the cluster; its length does not depend on the input."""
    parts = shards.mapInArrow(run, "piece int, part int, v binary")
    got = parts.groupBy("piece").applyInArrow(_added, "piece int, v binary").toArrow().sort_by("piece")
    return np.concatenate([np.frombuffer(v, "<f8") for v in got.column("v").to_pylist()]) if got.num_rows else np.zeros(0)


def _counter(batches):
    total, part = np.zeros(4 * BUCKETS + 3), None
    for part, docs, y, calibrates, _ in _shards(batches):
        own = [h for h, c in zip(docs, calibrates, strict=True) if not c]
        n, pos = _word_rows(own, y[~calibrates])
        total += np.concatenate([n.ravel(), pos.ravel(), [len(own), y[~calibrates].sum(), calibrates.sum()]])
    if part is not None:
        yield _parts(total, part)


def _plain(net: ConvNet) -> dict:
    return dict(vars(net))


def _trainer(state, epoch: int, seed: int):
    """Sums over a task's shards: table changes, shards that changed a bucket, its squared gradients, and by rows the other parameters."""

    def run(batches):
        total, part = 0.0, None
        for part, docs, y, calibrates, _ in _shards(batches):
            old, grown, grown_t = ConvNet(**state.value["net"]), [g.copy() for g in state.value["grown"]], state.value["grown_t"].copy()
            net = _copy(old, old.scale)
            fit = np.flatnonzero(~calibrates)
            rng = np.random.default_rng([seed, epoch, part])
            _epoch(net, grown, grown_t, docs, y, rng.permutation(fit), rng)
            changed = grown_t != state.value["grown_t"]
            dense = np.concatenate([p.ravel() for p in [*_dense(net), *grown]])
            tables = (net.tables - old.tables) * changed[:, :, None]
            total = total + np.concatenate([tables.ravel(), changed.ravel(), (grown_t - state.value["grown_t"]).ravel(), len(fit) * dense.astype(float), [len(fit)]])
        if part is not None:
            yield _parts(total, part)

    return run


def _averaged(net: ConvNet, grown: list[np.ndarray], grown_t: np.ndarray, total: np.ndarray) -> tuple[ConvNet, list[np.ndarray], np.ndarray]:
    """The net after an epoch: a bucket moves by the mean change of the shards that changed it, the rest is the mean by rows."""
    at = np.cumsum([net.tables.size, grown_t.size, grown_t.size])
    tables, changed, squares, rest = np.split(total, at)
    changed = np.maximum(changed.reshape(grown_t.shape), 1)
    new = _copy(net, net.scale)
    new.tables += (tables.reshape(net.tables.shape) / changed[:, :, None]).astype(np.float32)
    rest = rest[:-1] / max(rest[-1], 1)
    into, lo = [*_dense(new), *(g.copy() for g in grown)], 0
    for p in into:
        p[...] = rest[lo : lo + p.size].reshape(p.shape)
        lo += p.size
    return new, into[len(into) // 2 :], (grown_t + squares.reshape(grown_t.shape) / changed).astype(np.float32)


def _logits(model):
    def run(batches):
        net = ConvNet(**model.value)
        for _, docs, y, calibrates, langs in _shards(batches):
            own = np.flatnonzero(calibrates)
            z = [int(round(float(np.clip(net.logit(docs[i]), -30, 30)) * LOGIT_STEPS)) for i in own]
            yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()), pa.array([int(y[i]) for i in own], pa.int32()), pa.array([langs[i] for i in own], pa.string())], names=["z", "y", "lang"])

    return run


def _calibration(shards: DataFrame, net: ConvNet) -> tuple[np.ndarray, np.ndarray, list[str | None], np.ndarray]:
    """(logits, labels, languages, rows) of the calibration rows; logits are counted by steps, so their number is bounded."""
    got = shards.mapInArrow(_logits(_shipped(shards, net)), "z long, y int, lang string").groupBy("z", "y", "lang").count().toArrow()
    got = got.sort_by([("z", "ascending"), ("y", "ascending"), ("lang", "ascending")])
    return got.column("z").to_numpy() / LOGIT_STEPS, got.column("y").to_numpy().astype(float), got.column("lang").to_pylist(), got.column("count").to_numpy().astype(float)


def fit(docs: DataFrame, labels: DataFrame, epochs: int = EPOCHS, seed: int = SEED) -> tuple[ConvNet, dict[str | None, float]]:
    """(net, thresholds by language) from all labelled rows that are not held out, with their whole texts.

    A label other than 0 and 1, a null doc_id or a null text is not learnt from.
    A fifth of the rows, by a hash of doc_id, is not trained on: the epoch with
    the least loss on them wins, and they give the calibration and thresholds.
    """
    usable = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    n_labels = usable.count()
    size = docs.agg(F.count("text").alias("n"), F.sum(F.length("text")).alias("chars")).first()
    chars = (size["chars"] or 0) * min(1.0, n_labels / max(1, size["n"]))
    n_shards = max(1, -(-n_labels // SHARD_ROWS), int(-(-chars // SHARD_CHARS)))
    # the texts that have no label stay where they are
    rows = docs.where("text is not null").select("doc_id", "text", lang.alias("lang")).join(F.broadcast(usable) if n_labels <= SENT_LABELS else usable, "doc_id")
    at = F.xxhash64(F.col("doc_id").cast("string"))
    dealt = rows.select(F.pmod(at, F.lit(n_shards)).cast("int").alias("shard"), at.alias("at"), "text", F.col("toxic").cast("int").alias("toxic"), "lang",
                        (F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.lit("calibration")), F.lit(5)) == 0).alias("calibrates"))
    packed = dealt.groupBy("shard").applyInArrow(_pack, "shard int, words binary, ends binary, y binary, calibrates binary, langs array<string>")
    shards = staged(packed, "toxicity-shards", texts=True)

    rng = np.random.default_rng(seed)
    total = _total(shards, _counter)
    counts = total[: 4 * BUCKETS].reshape(2, 2, BUCKETS) if len(total) else np.zeros((2, 2, BUCKETS))
    n, positive, held = total[4 * BUCKETS :] if len(total) else (0, 0, 0)
    if not 0 < positive < n or held < 2:
        net = _flat(_start(np.zeros((2, BUCKETS)), np.zeros((2, BUCKETS)), 0.0, rng))
        z, y, langs, times = _calibration(shards, net)
        net.scale = _rate_logit(float((positive + (y * times).sum()) / (n + held)) if n + held else 0.0)
        return net, language_thresholds(net.score(z), y, langs, times)
    net = _start(counts[0], counts[1], positive / n, rng)
    grown, grown_t = _unlearnt(net)
    best = None
    for epoch in range(epochs):
        state = shards.sparkSession.sparkContext.broadcast({"net": _plain(net), "grown": grown, "grown_t": grown_t})
        net, grown, grown_t = _averaged(net, grown, grown_t, _total(shards, _trainer(state, epoch, seed)))
        z, y, langs, times = _calibration(shards, net)
        scale, loss = _calibrate(z, y, times)
        if best is None or loss < best[0]:
            best = loss, _copy(net, scale), (z, y, langs, times)
    _, net, (z, y, langs, times) = best
    return net, language_thresholds(net.score(z), y, langs, times)


def _scorer(model, text: str, keep: list[str]):
    def run(batches):
        net = ConvNet(**model.value)
        tables = net.folded()
        for batch in batches:
            scores = []
            for lo, hi, data, bounds in chunks(batch.column(text), 1 << 19):
                starts, ends, first = find_words(data, bounds, "alnum")
                h = hash_words(data, starts, ends)
                g = tables[0][_bucket(h, 0)]
                g += tables[1][_bucket(h, 1)]
                filled = np.flatnonzero(np.diff(first))
                logits = np.full(hi - lo, float(sum((np.maximum(b, 0) @ o) for b, o in zip(net.bias.values(), _cuts(net), strict=True))) + float(net.shift[0]))
                if len(filled):
                    total = np.full(len(filled), float(net.shift[0]))
                    column = 0
                    for (w, f), o in zip(net.filters.items(), _cuts(net), strict=True):
                        n = f.shape[2]
                        z = g[:, column : column + n].copy()
                        for k in range(1, w):
                            z[:-k] += np.where(_same_text(first, len(h), k)[:, None], g[k:, column + k * n : column + (k + 1) * n], 0)
                        column += w * n
                        z = np.maximum.reduceat(z, first[filled], axis=0) + net.bias[w]
                        total += np.maximum(z, 0) @ o
                    logits[filled] = total
                scores.append(net.score(logits))
            flat = np.concatenate(scores) if scores else np.zeros(0)
            out = pa.RecordBatch.from_arrays([*[batch.column(n) for n in keep], pa.array(flat, pa.float64())], names=[*keep, "score"])
            yield from (out.slice(lo, OUT_ROWS) for lo in range(0, max(1, out.num_rows), OUT_ROWS))

    return run


def _cuts(net: ConvNet) -> list[np.ndarray]:
    sizes = np.cumsum([f.shape[2] for f in net.filters.values()])[:-1]
    return np.split(net.out, sizes)


def _same_text(first: np.ndarray, n: int, k: int) -> np.ndarray:
    """Whether word i + k is in the text of word i, for i < n - k."""
    last = np.zeros(n + 1, np.int64)
    ends = first[1:-1]
    for back in range(k):
        at = ends - 1 - back
        last[at[at >= 0]] = 1
    return last[: n - k] == 0


def score(docs: DataFrame, net: ConvNet, keep: list[str]) -> DataFrame:
    """``keep`` columns of docs plus score (double, 0 to 1) of each whole text.

    Null, empty and wordless texts get the score of an empty text.  Rows with
    equal texts get equal scores.  No other column is read.
    """
    if "score" in keep or "text" in keep:
        raise ValueError("keep must not name text or score")
    schema = docs.select(*keep).schema.add("score", "double")
    return docs.select(*keep, "text").mapInArrow(_scorer(_shipped(docs, net), "text", keep), schema)


def _shipped(docs: DataFrame, net: ConvNet):
    """The net's fields as a broadcast: plain arrays, as executors without this package cannot unpickle its classes."""
    return docs.sparkSession.sparkContext.broadcast(_plain(net))


def threshold(lang: Column, thresholds: dict[str | None, float]) -> Column:
    """The decision threshold of a row's language."""
    out = None
    for name, t in thresholds.items():
        if name is not None:
            out = (F.when if out is None else out.when)(lang == name, F.lit(t))
    common = F.lit(thresholds[None])
    return common if out is None else out.otherwise(common)


def query(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    net, thresholds = fit(docs, read_table(spark, sf_dir, "labels"))
    scored = score(docs, net, ["doc_id", "lang"])
    limit = threshold(F.col("lang"), thresholds)
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
        limit.alias("threshold"),
        (F.col("score") >= limit).alias("rejected"),
    )


def reject(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score reaches their language's threshold; columns and other rows unchanged."""
    net, thresholds = fit(docs, labels)
    lang = F.col("lang") if "lang" in docs.columns else F.lit(None).cast("string")
    # plain names on the way; each text crosses to Python once, with its row
    quoted = [F.col("`" + c.replace("`", "``") + "`") for c in docs.columns]
    plain = [f"c{i}" for i in range(len(quoted))]
    packed = docs.select(*[c.alias(p) for c, p in zip(quoted, plain, strict=True)], lang.alias("lang"))
    keep = [*plain, "lang"]
    model = _shipped(docs, net)
    scored = packed.mapInArrow(_scorer(model, plain[docs.columns.index("text")], keep), StructType([*packed.schema.fields]).add("score", "double"))
    kept = scored.where(~(F.col("score") >= threshold(F.col("lang"), thresholds)))
    return kept.select(*plain).toDF(*docs.columns)
