"""Personal data: formal identifiers by pattern, and terms that disclose them.

E-mail addresses, IP addresses, card and phone numbers are found by pattern;
each value is a protected entity.  The words near an entity are its context.
Over the whole corpus, the pointwise mutual information of term and entity and
the share of the term's documents that hold the entity in its context tell how
strongly the term gives the entity away.  Terms beyond both thresholds are
generalised together with the identifiers, wherever they stand: far from the
entity and in documents without it too.  Only co-occurrence is counted in the
context; a term that never stands near an entity does not disclose it.
"""

from __future__ import annotations

import re
from bisect import bisect_left

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from quarry.llm.stage import read_table, staged
from quarry.llm.textops import OUT_ROWS, chunks, find_words, hash_list, hash_words

KINDS = ("email", "ip", "card", "phone", "term")
#: Context: so many words on either side of an entity, within REACH characters.
NEAR, REACH = 10, 200
#: A term discloses an entity from SUPPORT common documents, SHARE of the term's documents and PART of the most mutual information that any term can have with the entity on.
SUPPORT, SHARE, PART = 3, 0.5, 0.5
#: Terms a task counts before it hands its counts on.
FLUSH = 1_000_000
#: Disclosing terms that one pass over the texts marks (8 MB); more of them are marked in further passes.
PASS_TERMS = 1_000_000

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]+")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# A run of digits that fails from its start fails from inside too.
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]+")
_WORD = re.compile("[A-Za-z\x80-\U0010ffff]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = ord(c) - 48
        total += n if i % 2 == 0 else n * 2 - 9 * (n > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of local part, @ and dotted domain, in linear time: each @ is tried once."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and _LOCAL.match(text, start - 1, start):
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            last = domain.end()
            out.append((start, last))
        at = text.find("@", max(at + 1, last))
    return out


def base_spans(text: str) -> list[tuple[int, int, int, str]]:
    """(start, end, kind number, value) of all base spans, by start, then kind."""
    out = [(a, b, 0, text[a:b].lower()) for a, b in emails(text)]
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m[0].split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            out.append((m.start(), m.end(), 1, ".".join(parts)))
    for m in _CARD.finditer(text):
        digits = "".join(_DIGITS.findall(m[0]))
        if 14 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), m.end(), 2, digits))
    for m in _PHONE.finditer(text):
        digits = "".join(_DIGITS.findall(m[0]))
        if 10 <= len(digits) <= 15:
            out.append((m.start(), m.end(), 3, digits))
    return sorted(out, key=lambda s: (s[0], s[2], s[1]))


def _key(text: str) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(text.encode()), "big", signed=True)


def _union(spans: list[tuple[int, int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the identifiers' union."""
    starts, ends = [], []
    for a, b, _, _ in spans:
        if ends and a <= ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def _outside(a: int, b: int, starts: list[int], ends: list[int]) -> bool:
    at = bisect_left(starts, b) - 1
    return at < 0 or ends[at] <= a


def context_terms(text: str, spans: list[tuple[int, int, int, str]]) -> list[tuple[int, str]]:
    """(entity key, term) of the words near each entity, none of them inside an identifier."""
    out: list[tuple[int, str]] = []
    starts, ends = _union(spans)
    for a, b, kind, value in spans:
        entity = _key(f"{KINDS[kind]}:{value}")
        lo, hi = max(0, a - REACH), min(len(text), b + REACH)
        before = [m for m in _WORD.finditer(text, lo, a) if m.start() > lo or lo == 0][-NEAR:]
        after = [m for m in _WORD.finditer(text, b, hi) if m.end() < hi or hi == len(text)][:NEAR]
        out += [(entity, m[0]) for m in before + after if _outside(m.start(), m.end(), starts, ends)]
    return out


SPAN = ArrayType(StructType([StructField("kind", LongType()), StructField("start", LongType()), StructField("end", LongType())]))
_SPAN = pa.list_(pa.struct([(n, pa.int64()) for n in ("kind", "start", "end")]))


def _texts(column):
    """(chunk, document's place in it, text) of the texts that may hold a base span: those with a digit or @."""
    for lo, hi, data, bounds in chunks(column):
        hot = np.flatnonzero(((data - np.uint8(48)) < 10) | (data == 64))
        some = np.searchsorted(hot, bounds[1:]) > np.searchsorted(hot, bounds[:-1])
        yield lo, hi, data, bounds, {int(d): data[bounds[d] : bounds[d + 1]].tobytes().decode() for d in np.flatnonzero(some)}


def _contexts(batches):
    """The (entity, term) pairs of each document with any."""
    near = pa.list_(pa.struct([(n, pa.int64()) for n in ("entity", "term")]))
    for batch in batches:
        found = []
        for *_, texts in _texts(batch.column("_text")):
            found += [t for text in texts.values() if (t := context_terms(text, base_spans(text)))]
        keys = iter(hash_list([w for t in found for _, w in t], "letters").view(np.int64).tolist())
        pairs = [[{"entity": e, "term": t} for e, t in sorted({(e, next(keys)) for e, _ in t})] for t in found]
        yield pa.RecordBatch.from_arrays([pa.array(pairs, near)], names=["near"])


def _marker(terms, first: bool, text_kept: bool):
    """Adds base and terms (``first``), or more terms: every word, outside identifiers, whose hash is in ``terms``."""

    def run(batches):
        known = terms.value
        for batch in batches:
            base = [] if first else batch.column("base").to_pylist()
            marks = [] if first else batch.column("terms").to_pylist()
            for lo, hi, data, bounds, texts in _texts(batch.column("_text")):
                if first:
                    held = [base_spans(texts[d]) if d in texts else [] for d in range(hi - lo)]
                    base += [[{"kind": k, "start": a, "end": b} for a, b, k, _ in s] for s in held]
                    marks += [[] for _ in held]
                else:
                    held = [[(s["start"], s["end"], s["kind"], "") for s in spans] for spans in base[lo:hi]]
                starts, ends, word = find_words(data, bounds, "letters")
                h = hash_words(data, starts, ends).view(np.int64)
                hit = np.flatnonzero(known[np.minimum(np.searchsorted(known, h), len(known) - 1)] == h) if len(known) else np.zeros(0, np.int64)
                if not len(hit):
                    continue
                doc = np.searchsorted(word, hit, side="right") - 1
                point = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])  # code points before each byte
                a, b = (point[x[hit]] - point[bounds[doc]] for x in (starts, ends))
                cut = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])).tolist() + [len(doc)]
                for x, y in zip(cut[:-1], cut[1:], strict=True):
                    d = int(doc[x])
                    union = _union(held[d])
                    new = [{"kind": KINDS.index("term"), "start": p, "end": q} for p, q in zip(a[x:y].tolist(), b[x:y].tolist(), strict=True) if _outside(p, q, *union)]
                    marks[lo + d] = sorted(marks[lo + d] + new, key=lambda s: s["start"])
            names = [n for n in batch.schema.names if n not in ("base", "terms") and (text_kept or n != "_text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(base, _SPAN), pa.array(marks, _SPAN)], names=[*names, "base", "terms"])

    return run


def _word_counts(batches):
    """In how many of a task's documents each word occurs, A-Z as a-z, by the word's hash."""
    held: list[np.ndarray] = []
    size = 0

    def flush():
        words, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(words), pa.array(n.astype(np.int64))], names=["term", "n"])

    for batch in batches:
        for lo, hi, data, bounds in chunks(batch.column("_text")):
            starts, ends, first = find_words(data, bounds, "letters")
            h = hash_words(data, starts, ends).view(np.int64)
            doc = np.repeat(np.arange(hi - lo), np.diff(first))
            order = np.argsort(h, kind="stable")  # documents stay in order within a word
            h, doc = h[order], doc[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
            held.append(h[new])
            size += len(held[-1])
            if size >= 4 * FLUSH:
                yield flush()
                held, size = [], 0
    if held:
        yield flush()


def disclosures(found: DataFrame, texts: DataFrame) -> DataFrame:
    """(entity, term) pairs in which the term discloses the entity, from corpus counts.

    ``found`` has near, the distinct (entity, term) pairs of each document with
    any; ``texts`` has _text, all documents.  A pair is common to a document
    where the term stands in the entity's context (NEAR words, REACH characters).  Counts are of documents.  With n documents, a pair
    passes with at least SUPPORT common documents, a share common / df(term) of
    at least SHARE, and mutual information log2(n * common / (df(term) *
    df(entity))) above 0 and at least PART of log2(n / df(entity)), which it
    has with a term that occurs with nothing else.  So neither a frequent
    entity nor a small table keeps a term from passing; an entity in the
    context of every document has no disclosing terms.
    """
    n = texts.count()
    pairs = found.select(F.explode("near").alias("p")).select("p.*")
    common = pairs.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("common")).where(F.col("common") >= SUPPORT)
    holds = found.select(F.explode(F.array_distinct(F.transform("near", lambda t: t["entity"]))).alias("entity")).groupBy("entity").agg(F.count(F.lit(1)).alias("df_entity"))
    words = texts.select("_text").mapInArrow(_word_counts, "term long, n long").groupBy("term").agg(F.sum("n").alias("df_term"))
    scored = common.join(words, "term").join(holds, "entity")
    bits = F.log2(F.lit(float(max(n, 1))) * F.col("common") / (F.col("df_term") * F.col("df_entity")))
    most = F.log2(F.lit(float(max(n, 1))) / F.col("df_entity"))
    enough = (bits > 0) & (bits >= PART * most - 1e-9)
    return scored.where((F.col("common") / F.col("df_term") >= SHARE) & enough).select("entity", "term")


def find_spans(docs: DataFrame, text: str = "text", keep: list[str] | None = None, text_kept: bool = False, pass_terms: int = PASS_TERMS) -> DataFrame:
    """``keep`` columns of docs (all but the text, if None) plus base and terms: arrays of (kind, start, end).

    Offsets are code points, ends exclusive; kinds are places in KINDS.  Every
    occurrence of a disclosing term is marked, in all documents.  Null and empty texts have no spans.  Repeated rows are found each, and count
    each as a document of the corpus.  ``keep`` must not name a new column.
    """
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    return _marked(docs, text, keep, text_kept, pass_terms)


def _marked(docs: DataFrame, text: str, keep: list[str], text_kept: bool, pass_terms: int, mask: bool = False) -> DataFrame:
    """find_spans; with ``mask`` the last pass replaces the spans in the same worker: ``keep``, _text and _changed."""
    clash = {"_text", "base", "terms", *(["_changed"] if mask else [])} & set(keep)
    if clash:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    spark = docs.sparkSession
    rows = docs.select(*keep, F.col(text).alias("_text"))
    found = staged(rows.select("_text").mapInArrow(_contexts, "near array<struct<entity: bigint, term: bigint>>"), "contexts", texts=True)
    reveals = staged(disclosures(found, rows).select("term").distinct(), "terms")
    passes = max(1, -(-reveals.count() // pass_terms))
    out = rows
    for i in range(passes):
        some = reveals.where(F.pmod(F.xxhash64("term"), F.lit(passes)) == i).toArrow()["term"].to_numpy()
        last = i == passes - 1
        schema = StructType([f for f in rows.schema if text_kept or not last or f.name != "_text"]).add("base", SPAN).add("terms", SPAN)
        run = _marker(spark.sparkContext.broadcast(np.sort(some)), i == 0, text_kept or not last)
        if last and mask:
            schema = StructType([f for f in rows.schema if f.name != "_text"]).add("_text", "string").add("_changed", "boolean")
            run = _then_masked(run)
        out = out.mapInArrow(run, schema)
        if not last:
            out = staged(out, "marked", texts=True)
    return out


def _spelled(spans):
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, (s["kind"] + 1).cast("int")), s["start"], s["end"])), ",")


def _by_start(spans):
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("a"), s["kind"].alias("b"), s["end"].alias("c"))))
    return F.transform(order, lambda s: F.struct(s["b"].alias("kind"), s["a"].alias("start"), s["c"].alias("end")))


def _then_masked(run):
    def both(batches):
        yield from _masker(run(batches))

    return both


def _masker(batches):
    for batch in batches:
        texts, changed = [], []
        for text, base, terms in zip(batch.column("_text").to_pylist(), batch.column("base").to_pylist(), batch.column("terms").to_pylist(), strict=True):
            if base or terms:
                at, parts = 0, []
                for s in sorted([*base, *terms], key=lambda s: (s["start"], s["kind"])):
                    if s["end"] <= at:
                        continue
                    parts.append(text[at : max(at, s["start"])])
                    parts.append(f"<{KINDS[s['kind']].upper()}>")
                    at = s["end"]
                text = "".join(parts) + text[at:]
            texts.append(text)
            changed.append(bool(base or terms))
        names = [n for n in batch.schema.names if n not in ("base", "terms", "_text")]
        out = pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string()), pa.array(changed, pa.bool_())], names=[*names, "_text", "_changed"])
        yield from (out.slice(lo, OUT_ROWS) for lo in range(0, max(1, out.num_rows), OUT_ROWS))


def sanitise(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; n_chars, if there, counts the new text.

    No row is dropped; rows without spans are unchanged.
    """
    keep = [c for c in docs.columns if c != "text"]
    out = _marked(docs, "text", keep, True, PASS_TERMS, mask=True)
    if "n_chars" in keep:
        out = out.withColumn("n_chars", F.when(F.col("_changed"), F.length("_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.drop("_changed").withColumnRenamed("_text", "text").select(*docs.columns)


def query(spark, sf_dir: str) -> DataFrame:
    found = find_spans(read_table(spark, sf_dir, "documents").select("doc_id", "text"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id",
        *[count(k) for k in range(4)],
        F.sha2(_spelled(_by_start(F.col("base"))).cast("binary"), 256).alias("base_sha256"),
        _spelled(_by_start(F.concat("base", "terms"))).alias("spans"),
        F.size("terms").cast("long").alias("n_term"),
    )
