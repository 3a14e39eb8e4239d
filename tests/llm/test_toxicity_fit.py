"""The toxicity net learns from every labelled row, in shards."""

import random
import zlib

from quarry.llm import toxicity


def test_all_labelled_rows_count(spark, monkeypatch):
    """A word that only long labelled texts beyond any first rows carry is learnt, and every row is dealt to one shard."""
    monkeypatch.setattr(toxicity, "SHARD_ROWS", 400)
    r = random.Random(3)
    common = [f"w{i}" for i in range(300)]
    rows, labels = [], []
    for i in range(1600):
        bad = i % 8 == 0
        text = [r.choice(common) for _ in range(4200 if bad and i % 64 == 0 else 30)]
        if bad:
            text[r.randrange(len(text))] = "grim" if len(text) > 1000 else "vile"
        rows.append((i, " ".join(text), "en"))
        labels.append((i, int(bad)))
    docs = spark.createDataFrame(rows + [(5000, None, "en"), (5001, "w1 vile", None)], "doc_id long, text string, lang string")
    seen, kept = [], toxicity.staged

    def watched(df, name):
        out = kept(df, name)
        seen.extend(len(x) for x in (r.y for r in out.collect()))
        return out

    monkeypatch.setattr(toxicity, "staged", watched, raising=False)
    net, thresholds = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, toxic int"))
    learnt = [i for i in range(1600) if zlib.crc32(str(i).encode()) % 4 != 2]
    assert len(seen) > 1 and sum(seen) == 4 * len(learnt)
    by = {x.doc_id: x.score for x in toxicity.score(docs, net, ["doc_id"]).collect()}
    wrong = [i for i, y in labels if (by[i] >= thresholds[None]) != bool(y)]
    assert len(wrong) <= 24 and sum(by[i] >= thresholds[None] for i in range(0, 1600, 64)) >= 20
