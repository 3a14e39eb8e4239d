"""The llm operators on small tables: brute force, round trips and odd rows."""

import hashlib
import json
import random
import re
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quarry.llm import chat, decontam, licenses, neardup, packing, pii, sharding, token_counts, topk, toxicity
from quarry.llm.components import components
from quarry.llm.textops import hash_list

SYLLABLES = "ba ke li mo nu ra si to vu wa xe yo".split()


def words(n, seed):
    r = random.Random(seed)
    return [r.choice(SYLLABLES) + r.choice(SYLLABLES) + r.choice(SYLLABLES) for _ in range(n)]


@pytest.fixture(scope="module")
def docs(spark):
    base = [" ".join(words(60, i)) for i in range(30)]
    rows = [(i, t, "en", "s0", len(t)) for i, t in enumerate(base)]
    rows += [(100 + i, base[0], "en", "s1", len(base[0])) for i in range(6)]
    near = base[1].split()
    near[30] = "other"
    rows += [(200, " ".join(near), "de", "s1", 10), (201, " ".join(near[:59]), "de", "s1", 10)]
    rows += [(300, None, None, None, None), (301, "", "en", "s0", 0), (302, " \n", "en", "s0", 2), (303, "one two", "en", "s0", 7), (303, "one two", "en", "s0", 7)]
    rows += [(400, " ".join(words(30_000, 99)), "en", "s0", 1)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").cache()


def test_shards_move_only_into_the_new_one(docs):
    tree = sharding.HashTree((((1.0, 2.0), (1.0,)), ((3.0,),)))
    got = sharding.shard_table(docs.withColumn("n", F.lit(1)), tree, tree.grown(0, 1, 2.0)).collect()
    assert len(got) == docs.count()
    for r in got:
        assert r.grown_shard in (r.shard, 4) and 0 <= r.shard < 4
    slots = {}
    for r in got:
        slots.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    null = next(r for r in got if r.doc_id == 300)
    assert (null.size, null.text_crc32) == (16, 0)
    assert not sharding.shard_table(docs.limit(0), tree, tree.grown(1, 0)).count()


def test_shard_shares_follow_weights(spark):
    tree = sharding.HashTree((((1.0, 3.0), (2.0,)), ((2.0,),)))
    n = {r.shard: r["count"] for r in sharding.assign_shards(spark.range(8000).withColumnRenamed("id", "doc_id"), tree).groupBy("shard").count().collect()}
    for shard, share in enumerate((1 / 8, 3 / 8, 2 / 8, 2 / 8)):
        assert abs(n[shard] / 8000 - share) < 0.03


def test_topk_against_brute_force(spark):
    r = np.random.default_rng(1)
    v = r.integers(-3, 4, (300, 4))
    rows = [(i, [int(x) for x in v[i]]) for i in range(300)] + [(7, [int(x) for x in v[7]]), (900, None), (None, [1, 1, 1, 1])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    got = topk.exact_topk(df.where("vec_id % 50 = 0"), df, k=5, tile_queries=2, tile_rows=16, fan_in=3)
    out = {}
    for x in got.collect():
        out.setdefault(x.query_id, {})[x.rank] = (x.vec_id, x.score)
    for q in range(0, 300, 50):
        s = v @ v[q]
        want = sorted((i for i in range(300) if i != q), key=lambda i: (-s[i], i))[:5]
        assert [out[q][k + 1] for k in range(5)] == [(i, int(s[i])) for i in want]
    assert not topk.exact_topk(df.limit(0), df).count()
    q = spark.createDataFrame([(1, [0.5, None]), (2, [float("nan")]), (3, None), (4, [-0.001, 0.5])], "i int, e array<float>")
    assert [r.v for r in q.select(topk.quantised(F.col("e")).alias("v")).collect()] == [None, None, None, [-1, 128]]


def test_topk_keeps_rows_that_repeat_an_id(spark):
    rows = [(0, [1, 0]), (0, [0, 1]), (1, [5, 9]), (1, [9, 5]), (1, [9, 5]), (2, [7, 7])]
    df = spark.createDataFrame(rows, "vec_id long, v array<long>")
    for size in (1, 100):
        got = topk.exact_topk(df.where("vec_id = 0"), df, k=4, tile_rows=size, tile_queries=size, fan_in=2).collect()
        want = sorted(((-sum(a * b for a, b in zip(q, v, strict=True)), i) for j, q in rows if j == 0 for i, v in rows if i != 0))[:4]
        assert [(-x.score, x.vec_id) for x in sorted(got, key=lambda x: x.rank)] == want


def test_large_products_stay_exact():
    a = np.array([[1 << 30, 1], [3, 5]], np.int64)
    assert (topk._product(a, a) == a @ a.T).all()


def brute_leaks(text, items):
    pat = re.compile(decontam.ITEM_WORD)
    low = lambda t: pat.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, names = low(text), set(), set()
    for name, t in items:
        x = low(t)
        n = min(10, len(x))
        wins = {tuple(x[k : k + n]) for k in range(len(x) - n + 1)} if n else set()
        for k in range(len(w) - n + 1) if n else ():
            if tuple(w[k : k + n]) in wins:
                hit.update(range(k, k + n))
                names.add(str(name))
    return len(w), len(hit), sorted(names)


def test_leaks_against_brute_force(spark, docs):
    pool = docs.where("doc_id < 6").orderBy("doc_id").collect()
    items = [(1, " ".join(pool[0].text.split()[5:25])), (2, " ".join(pool[1].text.upper().split()[40:58])), (3, "One, TWO!"), (4, None), (5, "..."),
             (6, " ".join(pool[0].text.split()[15:35])), (6, " ".join(pool[0].text.split()[15:35])), (7, pool[2].text + " " + pool[3].text)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for size in (100_000, 60):
        got = decontam.leaked_spans(docs.drop("n_chars"), bench, max_words=size).collect()
        assert len(got) == docs.count()
        for r in got:
            assert (r.n_words, sum(s.hi - s.lo for s in r.spans), list(r["items"])) == brute_leaks(r.text, items)
    out = {r.doc_id: r for r in decontam.decontaminate(docs, bench).collect()}
    assert 2 not in out and 3 not in out and out[10].text == docs.where("doc_id = 10").first().text
    assert out[1].n_chars == len(out[1].text) and brute_leaks(out[1].text, items)[1] == 0
    assert not decontam.leaked_spans(docs, bench.limit(0)).where("size(spans) > 0").count()


def brute_groups(rows):
    sets = []
    for _, t in rows:
        w = (t or "").encode().lower().split()
        sets.append(frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(low.get(root(i), d), d)
    return [(d, len(sets[i]), low[root(i)]) for i, (d, _) in enumerate(rows)]


def test_near_duplicates_against_brute_force(spark, docs):
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    chain = words(80, 1234)
    for step in range(8):  # a chain whose ends are no link
        rows.append((1000 + step, " ".join(chain)))
        chain[step * 9] = f"changed{step}"
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = neardup.near_duplicates(df).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in got) == sorted(brute_groups(rows))
    assert all(r.kept == (r.doc_id == r.component_id) for r in got)
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} >= {0, 1, 300, 301, 302, 400}


def test_one_row_of_each_group_stays(spark):
    a, b, c, d, e = (" ".join(words(40, 700 + i)) for i in range(5))
    near = a.rsplit(" ", 1)[0] + " changed"
    rows = [(1, a, "x"), (7, near, "x"), (7, b, "x")]  # id 7: a near copy of 1, and a text of its own
    rows += [(2, c, "x"), (2, c, "x"), (3, c, "x")]  # the least row twice
    rows += [(None, d, "x"), (None, d, "x"), (None, a, "x")]  # without id
    rows += [(4, e, "x"), (4, e.upper(), "x")]  # one id, two spellings
    rows += [(8, None, "x"), (8, None, "x"), (9, "", "x"), (10, "", "x"), (None, None, "x"), (None, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = neardup.keep_one(df)
    assert got.columns == df.columns
    kept = [(r.doc_id, r.text.lower() if r.text else r.text) for r in got.collect()]
    want = [(1, a), (7, b), (2, c), (None, d), (4, e), (8, None), (9, ""), (10, ""), (None, None), (None, None)]
    assert sorted(kept, key=str) == sorted(want, key=str)


@pytest.mark.parametrize("sent", [0, 1000])
def test_few_near_duplicates_leave_without_sorting_texts(spark, monkeypatch, sent):
    monkeypatch.setattr(neardup, "SENT_ROWS", sent)
    a, b, c = (" ".join(words(40, 900 + i)) for i in range(3))
    rows = [(1, a), (7, a.rsplit(" ", 1)[0] + " changed"), (2, b), (2, b), (3, b), (None, b), (None, c), (4, None), (4, None)]
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert ("SortMergeJoin" in plan) == (sent == 0)
        assert sorted(map(tuple, got.collect()), key=str) == sorted([(1, a), (2, b), (None, c), (4, None)], key=str)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)


def test_texts_are_staged_in_small_batches(spark):
    from quarry.llm.stage import BATCH_KEY, TEXT_ROWS, staged

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], names=["n"])

    before = spark.conf.get(BATCH_KEY)
    got = [r.n for r in staged(spark.range(0, 5 * TEXT_ROWS, 1, 1).mapInArrow(sizes, "n long"), "sizes", texts=True).collect()]
    assert sum(got) == 5 * TEXT_ROWS and max(got) <= TEXT_ROWS
    assert spark.conf.get(BATCH_KEY) == before


def test_superminhash_estimates_similarity():
    r = np.random.default_rng(3)
    x = r.integers(0, 1 << 63, 400).astype(np.uint64)
    sig = neardup.superminhash(np.concatenate([x[:300], x[100:]]), np.repeat([0, 1], 300), 2, 512)
    assert abs((sig[0] == sig[1]).mean() - 0.5) < 0.1
    ranks = sig[0] >> np.uint64(32)
    assert ranks.max() < 512


def test_components(spark):
    edges = [(i + 1, i) for i in range(200)] + [(900, 901), (901, 905)]
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long").repartition(7)).collect()}
    assert {got[i] for i in range(201)} == {0} and {got[i] for i in (900, 901, 905)} == {900}


def test_packing_round_trip(spark, docs):
    from tokenizers import Tokenizer

    path = packing.tokenizer_path()
    odd = spark.createDataFrame([(900, "It's <|endoftext|> ÀÉ×x é́ a1b2 İ ﬁ…!", "en", "s", 1)], docs.schema)
    df = docs.unionByName(odd)
    rows = packing.pack(df, path, keep_ids=True).collect()
    t, texts, by = Tokenizer.from_file(path), {r.doc_id: r.text for r in df.collect()}, {}
    for r in rows:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by.setdefault(r.doc_id, {})[r.start] = r.ids
    for d, text in texts.items():
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        assert np.frombuffer(b"".join(by[d][k] for k in sorted(by[d])), "<u4").tolist() == ids
    seqs = {}
    for r in rows:
        seqs.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert sorted(seqs) == list(range(len(seqs)))
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= packing.CAPACITY


def test_histogram_packing_uses_every_count():
    r = random.Random(5)
    counts = {n: r.randint(1, 50) for n in r.sample(range(1, 4097), 300)}
    patterns = packing.pack_histogram(counts)
    used = {}
    for n, lengths in patterns:
        assert n > 0 and sum(lengths) <= 4096
        for x in lengths:
            used[x] = used.get(x, 0) + n
    assert used == counts
    total = sum(k * v for k, v in counts.items())
    assert total / (4096 * sum(n for n, _ in patterns)) > 0.93


def test_base_spans_and_disclosing_terms(spark):
    text = "Call +1 (555) 010-9999 or a.b+c@x-y.org; 10.0.0.256 10.0.0.25, 4111 1111 1111 1111, 4111111111111112, @a.b x@y"
    kinds = [(pii.KINDS[k], text[a:b]) for a, b, k, _ in pii.base_spans(text)]
    assert kinds == [("phone", "+1 (555) 010-9999"), ("email", "a.b+c@x-y.org"), ("ip", "10.0.0.25"), ("card", "4111 1111 1111 1111")]
    rows = [(i, f"the clerk Zarkolith wrote {words(3, i)[0]} to zed@x.org about {words(3, i + 50)[1]}") for i in range(5)]
    rows += [(10 + i, "the clerk wrote to some about " + " ".join(words(20, i))) for i in range(400)] + [(900, None), (901, ""), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in pii.find_spans(df).collect()}
    assert len(got) == 407 and got[0]["terms"][0].start == rows[0][1].index("Zarkolith") and len(got[0]["terms"]) == 1 and not got[20]["terms"]
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert "Zarkolith" not in clean[0] and "<TERM>" in clean[0] and "<EMAIL>" in clean[0] and clean[12] == rows[7][1] and clean[900] is None


def test_disclosing_terms_go_everywhere(spark):
    far = " ".join(words(60, 5))
    rows = [(i, f"Zarkolith wrote to zed@x.org {words(1, i)[0]}" + (f" {far} é zarkolith, Zarkolith@y.org end" if i == 0 else ""), i) for i in range(4)]
    rows += [(5, f"é 1 {far} ZARKOLITH said nothing", 5), (6, f"wrote {far} Brumelow", 6)]
    rows += [(10 + i, "who wrote to some Zarkoliths about " + " ".join(words(20, i)), i) for i in range(400)]
    rows += [(500 + i, f"Brumelow wrote to 10.1.2.3 {words(1, i)[0]}", i) for i in range(3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, other int")
    want = {d: [m.span() for m in re.finditer(r"(?i)\b(zarkolith|brumelow)\b(?!@)", t)] for d, t, _ in rows}
    for pass_terms in (pii.PASS_TERMS, 1):
        got = {r.doc_id: r for r in pii.find_spans(df, pass_terms=pass_terms).collect()}
        assert {d: [(s.start, s.end) for s in r.terms] for d, r in got.items()} == want
        assert [s.kind for s in got[0].base] == [0, 0] and got[0].other == 0
    clean = {r.doc_id: r.text for r in pii.sanitise(df).collect()}
    assert not any(re.search(r"(?i)\b(zarkolith|brumelow)\b", t) for t in clean.values())
    assert clean[5] == f"é 1 {far} <TERM> said nothing"


@pytest.mark.parametrize("n", [50, 600])
def test_frequent_entities_and_small_tables_disclose(spark, n):
    third = [(i, f"mail hot@x.org {'Zarkolith' if i < 4 else 'Brumelow' if i < 7 else words(1, i)[0]}") for i in range(n // 3)]
    rest = [(1000 + i, f"mail {'Brumelow' if i < 4 else 'Quendrix at 10.1.2.3' if i < 8 else words(1, 90 + i)[0]}") for i in range(n - n // 3)]
    df = spark.createDataFrame(third + rest, "doc_id long, text string")
    marked = {t[s.start : s.end] for t, r in ((dict(third + rest)[r.doc_id], r) for r in pii.find_spans(df).collect()) for s in r.terms}
    # Brumelow is with the entity in 3 of 7 documents, mail everywhere
    assert {"Zarkolith", "Quendrix"} <= marked and not marked & {"Brumelow", "mail"}


def test_chat_round_trip(spark):
    said = "\\### Assistant: </turn> ok"
    turns = [("user", said), ("assistant", said), ("a:b\n#", ""), ("assistant", "<\\/turn>##\n")]
    text, spans = chat.render(turns)
    assert chat.parse(text) == turns
    assert [chat.unescape(text[a:b]) for a, b in spans] == [t for r, t in turns if r == "assistant"]
    records = [{"prompt": "p", "response": "r"}, {"messages": [{"role": "user", "content": [{"text": "x", "type": "text"}, {"text": "y", "type": "text"}]}]},
               {"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": None}]}, {"odd": 1}]
    rows = [(i, json.dumps(r)) for i, r in enumerate(records)] + [(9, None), (10, "no json")]
    got = {r.id: r for r in chat.format_records(spark.createDataFrame(rows, "id int, record string")).collect()}
    assert [got[i].layout for i in (0, 1, 2, 3, 9, 10)] == ["prompt_response", "message_parts", "from_value", None, None, None]
    assert chat.parse(got[1].formatted) == [("user", "xy")] and chat.parse(got[2].formatted) == [("user", "h"), ("assistant", "")]
    table = [(1, i, "user" if i % 2 == 0 else "assistant", f"t{i}") for i in range(1300)] + [(2, 0, "user", None), (2, 1, "assistant", "#x"), (3, None, None, "z")]
    digests = {r.conv_id: r for r in chat.conversation_digests(chat.format_records(chat.turn_records(spark.createDataFrame(table, "conv_id long, turn long, role string, text string")))).collect()}
    for c in (1, 2, 3):
        own = [(r or "", t or "") for i, _, r, t in table if i == c]
        assert digests[c].n_turns == len(own)
        assert digests[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in own).encode()).hexdigest()
        assert digests[c].loss_chars == sum(len(t) for r, t in own if r == "assistant")


def test_no_record_holds_more_turns(spark):
    r = random.Random(3)
    role = lambda: r.choice(["user", "assistant", None])
    rows = [(1, None, role(), f"t{r.randint(0, 900)}") for _ in range(1500)] + [(1, i, role(), f"u{i}") for i in range(600)]
    rows += [(None, r.choice([0, 1, 2, 600, -3, None]), role(), r.choice([None, "a", f"b{r.randint(0, 400)}"])) for _ in range(1700)]
    rows += [(2, 7, "user", "same")] * 1300 + [(3, 0, "user", "hi"), (3, 1, "assistant", "ho")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    records = chat.format_records(chat.turn_records(df)).cache()
    sizes = [(r.conv_id, r.n_turns) for r in records.collect()]
    assert max(n for _, n in sizes) <= 512 and sorted(n for c, n in sizes if c == 2) == [276, 512, 512]
    digests = {r.conv_id: r for r in chat.conversation_digests(records).collect()}
    assert set(digests) == {None, 1, 2, 3}
    for c, got in digests.items():
        own = sorted((-1 if t is None else t, who or "", text or "") for d, t, who, text in rows if d == c)
        assert got.n_turns == len(own)
        assert got.turns_sha256 == hashlib.sha256("".join(f"{who}\n{text}\n" for _, who, text in own).encode()).hexdigest()


def test_token_ledger_commits_once(spark, scratch):
    doc = f"struct<{token_counts.IMAGE.replace(' ', ':').replace(',:', ',')}>"
    a, b = ("s", "en", "v1", 10, 50), ("s", "en", "v2", 12, 50)
    batch = lambda rows: spark.createDataFrame(rows, f"before {doc}, after {doc}")
    ledger = token_counts.TokenLedger(spark, scratch)
    assert not ledger.totals().count()
    assert ledger.commit("a", batch([(None, a), (None, a), (None, (None, None, "v1", None, None))]))
    assert ledger.commit("b", batch([(a, b)])) and not ledger.commit("b", batch([(a, b)]))
    assert ledger.commit("c", batch([(a, None), (None, None), (b, b)]))
    assert {tuple(r) for r in ledger.totals().collect()} == {("s", "en", "v2", 1, 12, 50), (None, None, "v1", 1, 0, 0)}
    with pytest.raises(ValueError):
        ledger.commit("x/y", batch([]))


def test_classifier_learns_planted_words():
    r = random.Random(4)
    texts, labels = [], []
    for i in range(600):
        w, bad = words(40, 7000 + i), i % 6 == 0
        if bad:
            w[r.randrange(40)] = r.choice(["vile", "rotten"])
        texts.append(hash_list(w, "alnum"))
        labels.append(int(bad))
    net, held, scores = toxicity.train(texts[:450], np.array(labels[:450]))
    s = net.score(np.array([net.logit(h) for h in texts[450:]]))
    y = np.array(labels[450:])
    assert ((s >= toxicity.CUT) == y).mean() > 0.95
    empty, _, _ = toxicity.train([], np.zeros(0))
    assert 0 <= empty.score(np.array([empty.logit(np.zeros(0, np.uint64))]))[0] < 0.01


def test_scores_of_odd_texts(spark, docs):
    net, _, _ = toxicity.train([hash_list(words(30, i) + (["vile"] if i % 4 == 0 else []), "alnum") for i in range(200)], np.array([int(i % 4 == 0) for i in range(200)]))
    got = toxicity.score(docs, net, ["doc_id", "text_len"] if "text_len" in docs.columns else ["doc_id"]).collect()
    by = {r.doc_id: r.score for r in got}
    assert len(got) == docs.count() and by[300] == by[301] == by[302] and all(0 <= r.score <= 1 for r in got)
    for r in docs.where("doc_id in (0, 5, 400)").collect():
        h = hash_list(r.text.split(), "alnum")
        assert abs(by[r.doc_id] - net.score(np.array([net.logit(h)]))[0]) < 1e-5


def test_patience_and_notices(spark):
    assert licenses.patience([1, 2, 3, 9, 4], [1, 2, 3, 4]) == [(0, 0), (1, 1), (2, 2), (4, 3)]
    mit = licenses.TEMPLATES["mit-header"]
    rows = [(1, "intro words here\nReleased under the MIT License.\nmore"), (2, "x " * 30 + mit.replace("free of charge", "at no charge") + " y" * 30), (3, None), (4, ""),
            (5, "All rights reserved. " * 3), (6, "the license of rights under version all"), (7, " ".join(words(5000, 2)))]
    got = {r.doc_id: r.notices for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [n.license for n in got[1]] == ["mit"] and [n.license for n in got[2]] == ["mit-header"] and got[2][0].coverage >= 0.9
    assert [n.license for n in got[5]] == ["all-rights-reserved"] * 3 and not got[3] and not got[4] and not got[6] and not got[7]


def brute_notices(words, templates, least=0.8):
    stretches = []
    for i, (name, t) in enumerate(templates):
        for a in range(len(words)):
            for b in range(a + 1, min(len(words), a + 2 * len(t)) + 1):
                pairs = licenses.patience(words[a:b], t)
                if len(pairs) / len(t) >= least and (pairs[0][0], pairs[-1][0]) == (0, b - a - 1):
                    stretches.append((-len(pairs), -len(pairs) / len(t), i, b - a, a, name))
    out, used = [], set()
    for _, c, _, size, a, name in sorted(stretches):
        if not used & set(range(a, a + size)):
            used |= set(range(a, a + size))
            out.append((name, -c, a, a + size))
    return sorted(out, key=lambda x: x[2])


def test_notices_against_brute_force():
    r = random.Random(7)
    templates = [("a", [0, 1, 2, 3, 4]), ("b", [5, 1, 2, 6, 2, 7, 8]), ("c", [9, 8, 7])]
    hits = 0
    for _ in range(300):
        text = [r.choice([*range(10), -1, -1]) for _ in range(r.randint(0, 25))]
        for _ in range(r.randint(0, 3)):
            t = [w for w in r.choice(templates)[1] if r.random() < 0.95]
            at = r.randint(0, len(text))
            text[at:at] = t
        want = brute_notices(text, templates)
        hits += len(want)
        assert licenses.notices(text, templates) == want
        at = np.flatnonzero(np.array(text) >= 0)
        starts = [licenses._starts(at, np.array(text, np.int64)[at], t, licenses._need(0.8, t)).tolist() for _, t in templates]
        assert licenses.notices(text, templates, starts=starts) == want
    assert hits > 200


def test_stray_words_do_not_hide_notices(spark):
    gpl = licenses.TEMPLATES["gpl-3.0-header"]
    far = "the of or it and to " * 10
    apart = gpl.replace("redistribute", "redistribute " + "blah " * 12)
    rows = [(1, "This code is released under the MIT license. You can find a copy of the full license."), (2, "This " + far + gpl), (3, apart), (4, "x"), (5, gpl + " " + far + "version")]
    got = {r.doc_id: r.notices for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [(n.license, n.coverage, n.start, n.end) for n in got[1]] == [("mit", 1.0, 3, 8)]
    n = len(re.findall(r"[A-Za-z0-9]+", gpl))
    assert [(x.license, x.coverage, x.start, x.end) for x in got[2]] == [("gpl-3.0-header", 1.0, 61, 61 + n)]
    assert [n.license for n in got[3]] == ["gpl-3.0-header"] and not got[4]
    assert [(x.license, x.coverage, x.start, x.end) for x in got[5]] == [("gpl-3.0-header", 1.0, 0, n)]


def test_pipeline_on_small_tables(spark, scratch):
    import corpus_pipeline

    texts = [" ".join(words(50, i)) for i in range(120)]
    toxic = set(range(0, 120, 6))
    docs = [(i, ("vile " if i in toxic else "") + t, "en", "s", len(t)) for i, t in enumerate(texts)]
    docs += [(500, texts[1], "en", "s", 1), (501, texts[2] + " mail me@x.org", "en", "s", 1), (502, None, None, None, None)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{scratch}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i in toxic)) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{scratch}/labels.parquet")
    spark.createDataFrame([(1, " ".join(texts[3].split()[:15]))], "item_id long, text string").write.parquet(f"{scratch}/benchmark.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "personal_data", "packing"]
    out = {r.doc_id for r in corpus_pipeline.run(spark, scratch).collect()}
    clean = set(range(120)) - toxic
    # a classifier of some 90 rows may err on a few
    assert len(clean - {2} - out) <= 5 and 500 not in out and 502 in out and len(out & {2, 501}) <= 1
    assert len(out & toxic) <= 5


def test_pipeline_gives_the_packed_ids(spark):
    import corpus_pipeline
    from tokenizers import Tokenizer

    texts = {i: " ".join(words(30, i)) for i in range(20)} | {50: None}
    df = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    tokenizer = Tokenizer.from_file(packing.tokenizer_path())
    rows = corpus_pipeline.sequences(spark, df, None).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        ids = np.frombuffer(r.ids, "<u4").tolist()
        assert ids == tokenizer.encode(texts[r.doc_id] or "", add_special_tokens=False).ids + [packing.END_ID]
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(ids) == r.length
