"""The corpus pipeline, stage by stage, against plain computations; each stage on what the one before it kept."""

import random
import re
import uuid
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from keystrata.llm import toxicity
from keystrata.llm.common import BATCH_SETTING
from test_edges import cut_by_hand, spans_by_hand, text_keys
from tokenizers import Tokenizer

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans int, part int"


def lowered(text):
    return WORDS.findall((text or "").lower())


def grams(text):
    w = lowered(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def folder(spark):
    rnd = random.Random(21)
    words = lambda n: " ".join(f"w{rnd.randrange(500)}" for _ in range(n))
    passage, item = words(70), words(20)
    texts = [(i, words(rnd.choice([3, 40, 120])) + (" vilest slurs" if i % 6 == 0 else "")) for i in range(150)]
    texts += [(200 + i, texts[7 + i][1]) for i in range(5)]
    base = words(100).split()
    texts += [(300 + i, " ".join([*base[:40], f"own{i}", *base[41:]])) for i in range(4)]
    texts += [(400 + i, words(30) + " " + passage + " " + words(25)) for i in range(4)]
    texts += [(500 + i, words(60) + " " + item + " " + words(60)) for i in range(3)]
    texts += [(600, None), (601, ""), (None, words(20)), (None, None), (602, words(6000)), (603, words(30)), (603, words(90)), (604, words(64)), (604, words(64))]
    docs = spark.createDataFrame([(i, t, ("aa", "bb")[(i or 0) % 2], "s", len(t or ""), 1, 2) for i, t in texts], SCHEMA)
    path = f"file:///tmp/checkpoints/keystrata/pipeline-{uuid.uuid4().hex}"
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 6 == 0)) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, item.upper()), (2, None), (3, "one two")], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_each_stage(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, setting = docs.columns, spark.conf.get(BATCH_SETTING)
    stages = dict(corpus_pipeline.STAGES)
    assert [*stages] == ["toxicity", "near_dedup", "repeated_passages", "decontamination", "packing"]
    held = lambda df: Counter((r.doc_id, r.text) for r in df.collect())

    kept = stages["toxicity"](spark, docs, folder)
    chain = toxicity.fit_chain(docs, spark.read.parquet(f"{folder}/labels.parquet"))
    clean = Counter({r: n for r, n in held(docs).items() if chain.probabilities(set(toxicity.text_features(r[1] or "").tolist()))[-1] < chain.threshold})
    assert kept.columns == columns and held(kept) == clean and sum("vilest" in (t or "") for _, t in clean) == 0 and len(clean) > 130

    docs, sets, component = kept, {}, {}
    for i, t in clean:
        if i is not None:
            sets.setdefault(i, []).append(grams(t))
            component[i] = i
    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and component[a] != component[b] and any(x & y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                low, high = sorted((component[a], component[b]))
                component = {k: low if c == high else c for k, c in component.items()}
    single = Counter({r: n for r, n in clean.items() if r[0] is None or component[r[0]] == r[0]})
    kept = stages["near_dedup"](spark, docs, folder)
    assert kept.columns == columns and held(kept) == single and len(clean) - len(single) >= 6

    docs, cut = kept, stages["repeated_passages"](spark, kept, folder)
    texts = held(cut)
    assert cut.columns == columns and all(r.n_chars == len(r.text) for r in cut.where("text is not null").collect())
    assert texts == cut_by_hand(list(single.elements()), spans_by_hand(single, text_keys(docs)))
    assert len([r for r in single if r not in texts]) == 3

    kept = stages["decontamination"](spark, cut, folder)
    item = grams(spark.read.parquet(f"{folder}/benchmark.parquet").where("item_id = 1").first().text)
    expected = Counter({r: n for r, n in texts.items() if r[0] is None or 100 * len(item & grams(r[1])) < 80 * len(item)})
    assert kept.columns == columns and held(kept) == expected and len(texts) - len(expected) == 3

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = Counter()
    for (i, t), n in expected.items():
        own = np.asarray([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for at in range(0, len(own), 2048):
            ids[i, at // 2048, own[at : at + 2048].tobytes()] += n
    packed = stages["packing"](spark, kept, folder).collect()
    assert Counter((r.doc_id, r.piece, bytes(r.token_ids)) for r in packed) == ids
    spark.conf.set(BATCH_SETTING, setting)

    out = corpus_pipeline.run(spark, folder)
    assert Counter((r.doc_id, r.piece, bytes(r.token_ids)) for r in out.collect()) == ids and spark.conf.get(BATCH_SETTING) == setting
