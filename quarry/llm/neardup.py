"""Near-duplicate grouping with SuperMinHash signatures.

Every shingle draws, for each of M positions, a value rank + fraction; the
ranks of one shingle are a random permutation, so its values are spread evenly
over the positions (the correlated ranks of SuperMinHash) and the estimate has
less variance than with independent draws.  Ranks are taken in ascending
rounds and a document stops as soon as no later rank can lower its signature.

Signatures are cut into bands.  Texts with equal shingle sets are one node;
nodes that share a band are candidates.  Each node is first compared, on its
full set, with the centre of its buckets, then with its nearest node of another
group; links are grouped by union-find in between.  Buckets that still hold
several groups then compare all their nodes of different groups, in tiles, each
pair in the first band it shares, so no pair that shares a band is lost.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.components import components
from quarry.llm.stage import read_table, staged
from quarry.llm.textops import GOLDEN, U64, chunks, find_words, hash_words, mix64, shingle_hashes

WIDTH = 5
PERCENT = 75
#: 51 bands of 5 positions: a pair at similarity 0.75 shares none with probability 1e-6.
BANDS, ROWS = 51, 5
#: All positions serve the estimate.  Below AGREE, 4.7 standard deviations under 0.75, a pair is not compared on its sets.
POSITIONS, AGREE = 512, 0.66
SLICE, TILE, PROBES = 20_000, 1024, 500
#: Rows that go are sent to all tasks up to this many (two numbers each); more of them are joined by a shuffle.
SENT_ROWS = 200_000


def superminhash(x: np.ndarray, doc: np.ndarray, n_docs: int, positions: int) -> np.ndarray:
    """uint64[n_docs, positions]: rank << 32 | fraction, the least over each document's elements.

    A document without elements keeps the largest value everywhere.
    """
    sig = np.full(n_docs * positions, np.iinfo(np.uint64).max, np.uint64)
    # small sets need the most rounds; sorted by size they share few slices
    by_size = np.argsort(np.bincount(doc, minlength=n_docs)[doc], kind="stable")
    x, doc = x[by_size], doc[by_size]
    kind = np.uint8 if positions <= 256 else np.uint16
    for lo in range(0, len(x), SLICE):
        e, d = x[lo : lo + SLICE], doc[lo : lo + SLICE]
        perm = np.tile(np.arange(positions, dtype=kind), (len(e), 1))
        row = np.arange(len(e))
        for j in range(positions):
            u = mix64(e + U64((j + 1) * int(GOLDEN) & (1 << 64) - 1))
            k = j + (((u >> U64(32)) * U64(positions - j)) >> U64(32)).astype(np.int64)
            place = perm[row, k]
            perm[row, k] = perm[row, j]
            np.minimum.at(sig, d * positions + place, (u & U64(0xFFFFFFFF)) | U64(j << 32))
            if j + 1 < positions:
                own = np.unique(d)
                done = sig.reshape(n_docs, positions)[own].max(1) < U64((j + 1) << 32)
                if done.any():
                    live = ~np.isin(d, own[done])
                    e, d, row = e[live], d[live], row[live]
                    if not len(e):
                        break
    return sig.reshape(n_docs, positions)


def bands_of(sig: np.ndarray) -> np.ndarray:
    """int64[docs, BANDS]: one key for each band's values and place."""
    used = sig[:, : BANDS * ROWS].reshape(len(sig), BANDS, ROWS)
    acc = np.broadcast_to(mix64(np.arange(1, BANDS + 1, dtype=np.uint64) * GOLDEN), (len(sig), BANDS)).copy()
    for i in range(ROWS):
        acc = mix64(acc ^ used[:, :, i]) + GOLDEN
    return acc.view(np.int64)


def document_sets(texts: pa.Array):
    """Sorted distinct shingle hashes of each text, chunk by chunk: (lo, hi, list of arrays)."""
    for lo, hi, data, bounds in chunks(texts):
        starts, ends, first = find_words(data, bounds, "space")
        x, doc = shingle_hashes(hash_words(data, starts, ends), first, WIDTH)
        order = np.argsort(doc, kind="stable")
        x, cut = x[order], np.searchsorted(doc[order], np.arange(hi - lo + 1))
        yield lo, hi, [np.unique(x[cut[i] : cut[i + 1]]) for i in range(hi - lo)]


def _sketch(batches):
    for batch in batches:
        n, digest, bands, sketch = [], [], [], []
        for _, _, sets in document_sets(batch.column("text")):
            sizes = np.array([len(s) for s in sets])
            sig = superminhash(np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes), len(sets), POSITIONS)
            keys, small = bands_of(sig), (mix64(sig) & U64(0xFF)).astype(np.uint8)
            for i, s in enumerate(sets):
                n.append(len(s))
                digest.append(xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None)
                bands.append(keys[i] if len(s) else None)
                sketch.append(small[i].tobytes() if len(s) else None)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("text_key"), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sketch, pa.binary())],
            names=["doc_id", "text_key", "n", "digest", "bands", "sketch"],
        )


def _confirm(batches):
    """Rows sorted by (anchor, salt, role): the anchor's text, then its probes' -> links."""
    current, anchor = None, None
    for batch in batches:
        anchors, probes = batch.column("anchor").to_pylist(), batch.column("probe").to_pylist()
        out = []
        for lo, _, sets in document_sets(batch.column("text")):
            for i, s in enumerate(sets, lo):
                if probes[i] is None:
                    current, anchor = anchors[i], s
                    continue
                if current != anchors[i]:
                    raise ValueError(f"node {anchors[i]} has no text")
                small, large = (s, anchor) if len(s) < len(anchor) else (anchor, s)
                at = np.minimum(np.searchsorted(large, small), len(large) - 1)
                both = int((large[at] == small).sum())
                if 100 * both >= PERCENT * (len(s) + len(anchor) - both):
                    out.append((probes[i], anchors[i]))
        yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in out], pa.int64()), pa.array([b for _, b in out], pa.int64())], names=["a", "b"])


def _confirmed(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (probe, anchor) pairs that are links on their full sets; an anchor with many probes is dealt to several tasks."""
    salts = pairs.groupBy("anchor").agg(F.ceil(F.count(F.lit(1)) / PROBES).cast("int").alias("salts"))
    probe = pairs.join(salts, "anchor").select("anchor", F.pmod(F.xxhash64("probe"), "salts").cast("int").alias("salt"), "probe")
    probe = probe.join(texts.withColumnRenamed("node", "probe"), "probe").select("anchor", "salt", "probe", "text")
    first = salts.join(texts.withColumnRenamed("node", "anchor"), "anchor")
    first = first.select("anchor", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), F.lit(None).cast("long").alias("probe"), "text")
    dealt = first.unionByName(probe).repartition("anchor", "salt").sortWithinPartitions("anchor", "salt", F.col("probe").asc_nulls_first())
    return dealt.select("anchor", "probe", "text").mapInArrow(_confirm, "a long, b long")


def _tile_pairs(batches, nearest: bool = False):
    """Rows sorted by (key, i, j): pairs of different groups whose sizes and signatures allow a link.

    With ``nearest``, each node's pair with the best agreement in the tile only.
    """
    held: list = []

    def flush():
        if len(held) < 2:
            return []
        node, comp, n, side = (np.array([r[k] for r in held]) for k in range(4))
        cross = held[0][5] != held[0][6]
        sk = np.frombuffer(b"".join(r[4] for r in held), np.uint8).reshape(len(held), -1)
        bands = np.array([r[7] for r in held], np.int64)
        own = int(np.flatnonzero(bands[0] == at[0])[0])
        found = []
        best = np.full(len(held), AGREE - 1e-9)
        mate = np.full(len(held), -1)
        for a in range(len(held) - 1):
            rest = slice(a + 1, None)
            fits = (comp[rest] != comp[a]) & (100 * np.minimum(n[rest], n[a]) >= PERCENT * np.maximum(n[rest], n[a]))
            if cross:
                fits &= side[rest] != side[a]
            other = np.flatnonzero(fits) + a + 1
            if not nearest:  # in the first band that a pair shares
                other = other[~(bands[other, :own] == bands[a, :own]).any(1)]
            if len(other):
                agree = (sk[other] == sk[a]).mean(1)
                if nearest:
                    better = agree > best[other]
                    best[other[better]], mate[other[better]] = agree[better], a
                    top = agree.argmax()
                    if agree[top] > best[a]:
                        best[a], mate[a] = agree[top], other[top]
                else:
                    found.extend((int(max(node[a], node[b])), int(min(node[a], node[b])), float(g)) for b, g in zip(other[agree >= AGREE], agree[agree >= AGREE], strict=True))
        if nearest:
            found = [(int(node[a]), int(node[mate[a]]), float(best[a])) for a in np.flatnonzero(mate >= 0)]
        return found

    at = None
    for batch in batches:
        out = []
        c = [batch.column(x).to_pylist() for x in ("key", "i", "j", "node", "comp", "n", "side", "sketch", "bands")]
        for key, i, j, node, comp, n, side, sketch, bands in zip(*c, strict=True):
            if (key, i, j) != at:
                out += flush()
                held, at = [], (key, i, j)
            held.append((node, comp, n, side, sketch, i, j, bands))
        yield _pair_batch(out)
    yield _pair_batch(flush())


def _pair_batch(out: list) -> pa.RecordBatch:
    columns = [pa.array([p[k] for p in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.float64()))]
    return pa.RecordBatch.from_arrays(columns, names=["probe", "anchor", "agree"])


def _nearest_in_tiles(batches):
    yield from _tile_pairs(batches, nearest=True)


def _open_pairs(members: DataFrame, nodes: DataFrame, groups: DataFrame, nearest: bool) -> DataFrame:
    """(probe, anchor) of nodes that share a bucket, are in different groups and may be links: all, or each node's nearest."""
    labelled = members.select("key", "node", "size").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    open_keys = labelled.groupBy("key").agg(F.min("comp").alias("c0"), F.max("comp").alias("c1")).where("c0 <> c1").select("key")
    tiles = F.ceil(F.col("size") / TILE).cast("int")
    side = F.pmod(F.xxhash64("node"), tiles).cast("int")
    rest = labelled.join(open_keys, "key").select("key", "node", "comp", side.alias("side"), F.explode(F.sequence(F.lit(0), tiles - 1)).alias("other"))
    rest = rest.select("key", F.least("side", "other").alias("i"), F.greatest("side", "other").alias("j"), "node", "comp", "side").join(nodes.select("node", "n", "sketch", "bands"), "node")
    rest = rest.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    found = rest.select("key", "i", "j", "node", "comp", "n", "side", "sketch", "bands").mapInArrow(_nearest_in_tiles if nearest else _tile_pairs, "probe long, anchor long, agree double")
    if nearest:
        found = found.groupBy("probe").agg(F.max_by("anchor", "agree").alias("anchor"))
        found = found.select(F.greatest("probe", "anchor").alias("probe"), F.least("probe", "anchor").alias("anchor"))
    return found.select("probe", "anchor").distinct()


def _order():
    """Rows of a group in order: by doc_id, those without last, then by text."""
    return F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")


def _grouped(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, n and first, the least row of the group (null without a set), for every row of ``docs``."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("text_key"), "text")
    schema = "doc_id long, text_key long, n long, digest binary, bands array<long>, sketch binary"
    marked = staged(rows.mapInArrow(_sketch, schema), "sketches", texts=True)
    nodes = marked.where("n > 0").groupBy("digest").agg(
        F.min(_order()).alias("first"), F.min(F.struct(F.coalesce("doc_id", F.lit(-(1 << 63))), "text_key")).alias("of"), F.first("n").alias("n"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")
    )
    nodes = staged(nodes.withColumn("node", F.monotonically_increasing_id()), "nodes")

    entries = nodes.select("node", F.explode("bands").alias("key"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    shared = staged(entries.join(sizes, "key"), "shared")
    # a group's centre shares the most buckets; it is the best first partner
    ranked = shared.groupBy("node").agg(F.sum("size").alias("shares"))
    ranked = shared.join(ranked, "node").select("key", "node", "size", F.struct("shares", "node").alias("rank"))
    tops = ranked.groupBy("key").agg(F.max("rank").alias("top"))
    members = staged(ranked.join(tops, "key").select("key", "node", "size", "top"), "members")
    near = staged(members.groupBy("node").agg(F.max("top").alias("top")).select("node", F.col("top.node").alias("hub")), "near")
    wanted = near.select("node").join(nodes.select("node", "of"), "node").select("node", F.col("of.col1").alias("doc"), F.col("of.text_key").alias("text_key"))
    named = rows.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("doc"), "text_key", "text")
    # one row a node, made where the join leaves its rows: texts cross the shuffle once
    texts = named.join(wanted, ["doc", "text_key"]).dropDuplicates(["doc", "text_key", "node"])
    texts = staged(texts.select("node", "text"), "texts")

    pairs = near.select(F.col("node").alias("probe"), F.col("hub").alias("anchor")).where("probe <> anchor")
    links = staged(_confirmed(pairs, texts), "links", texts=True)
    groups = staged(components(links), "groups")
    for nearest in (True, False):
        more = staged(_open_pairs(members, nodes, groups, nearest), "pairs", texts=True)
        links = staged(_confirmed(more, texts), "links", texts=True)
        known = groups.select(F.col("node").alias("a"), F.col("comp").alias("b"))  # one edge a node says what the earlier links said
        groups = staged(components(links.unionByName(known)), "groups")

    names = nodes.select("node", "digest", "first").join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    least = names.groupBy("comp").agg(F.min("first").alias("first"))
    names = names.drop("first").join(least, "comp").select("digest", "first")
    return marked.select("doc_id", "text_key", "n", "digest").join(names, "digest", "left").drop("digest")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of ``docs`` (doc_id, text).

    Words are runs without ASCII white space, A-Z as a-z; a set holds the
    distinct runs of five words (a shorter text: the whole sequence).  Null,
    empty and blank texts have no set and stay alone.  Sets are compared as
    64-bit shingle hashes.  component_id is the smallest doc_id of the group
    and kept marks its row; a row without doc_id never gives its group a name
    and, where the group has no other, has a null component_id and is kept.
    Repeated rows get the same answer each.
    """
    out = _grouped(docs)
    component = F.when(F.col("n") > 0, F.col("first.doc_id")).otherwise(F.col("doc_id"))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), component.eqNullSafe(F.col("doc_id")).alias("kept"))


def query(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


def keep_one(docs: DataFrame) -> DataFrame:
    """One row of each group of docs: the one with the smallest doc_id, of several texts with that id the one of the least hash.

    Rows are told apart by doc_id and text, so a text of its own stays whatever
    its id; a row without doc_id stays only where its group has no other, and
    then once.  Of rows with equal doc_id and text one stays; without a set
    (null, empty and blank texts) only a doc_id makes them equal.
    """
    clash = {"_id", "_text_key"} & set(docs.columns)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    ours = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_key")
    goes = (F.col("n") > 0) & (ours != F.col("first"))
    pair = [F.col("doc_id").alias("_i"), F.col("text_key").alias("_k")]
    rows = _grouped(docs).where("n > 0 or doc_id is not null")
    pairs = staged(rows.groupBy(*pair).agg(F.max(F.coalesce(goes, F.lit(False))).alias("goes"), F.count(F.lit(1)).alias("n_rows")).where("goes or n_rows > 1"), "extra")
    same = F.col("_id").eqNullSafe(F.col("_i")) & (F.col("_text_key") == F.col("_k"))
    keyed = docs.withColumns({"_id": F.col("doc_id").cast("long"), "_text_key": F.xxhash64("text")})
    n = {r["goes"]: r["count"] for r in pairs.groupBy("goes").count().collect()}

    def named(goes: bool) -> DataFrame:
        """The pairs; while they are few, whole texts are neither sorted nor shuffled for them."""
        own = pairs.where(F.col("goes") == goes).select("_i", "_k")
        return F.broadcast(own) if n.get(goes, 0) <= SENT_ROWS else own

    stay = keyed.join(named(True), same, "left_anti")
    if n.get(False):
        once = stay.join(named(False), same, "left_semi").dropDuplicates(["_id", "_text_key"])
        stay = stay.join(named(False), same, "left_anti").unionByName(once)
    return stay.drop("_id", "_text_key")
