"""The pipeline's stages against brute force, and on tables with awkward rows."""

from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from quarry.llm import common, cotraining, mixing, secrets

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, _s string"


@pytest.fixture(scope="module", autouse=True)
def one_network():
    """The network is fitted once for all tests of this module."""
    fit, held = secrets.fit, {}
    secrets.fit = lambda docs, **options: held.setdefault("net", None) or held.__setitem__("net", fit(docs, **options)) or held["net"]
    yield
    secrets.fit = fit


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(*r, "clash", "clash") for r in map(tuple, spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").limit(150).collect())]
    rows += [rows[0], rows[0], (None, None, None, None, None, None, None), (None, "no id", "en", "src0", 5, "", ""), (None, "no id", "en", "src0", 5, "", ""), (910001, "", "en", "src0", 0, "", ""), (910002, None, None, None, None, None, None)]
    rows += [(910003, "one text of an id", "en", "src0", 17, "", ""), (910003, "another text of the same id", "en", "src1", 27, "", ""), (910004, "word " * 30000 + " password = abcdefgh12345678", "en", None, None, "", "")]
    return spark.createDataFrame(rows, DOCS)


def shingles(t):
    w = (t or "").encode().lower().split()
    return frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()


def test_stages_by_brute_force(spark, odd):
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "dedup", "secrets", "mix", "pack"]
    kept = common.cut(stages["quality"](spark, odd, SF))
    model = cotraining.fit(odd, spark.read.parquet(f"{SF}/labels.parquet"))
    rows = odd.collect()
    score = model.score([np.stack([cotraining.text_view((r.text or "").encode()) for r in rows]), np.stack([model.meta.view(r.source, r.lang, r.n_chars) for r in rows])])[2]
    assert Counter(kept.collect()) == Counter(r for r, s in zip(rows, score) if s >= model.least)

    once = common.cut(stages["dedup"](spark, kept, SF))
    rows = [r for r in kept.collect() if r.doc_id is not None]
    sets = [shingles(r.text) for r in rows]
    low = [r.doc_id for r in rows]
    for _ in range(10):
        for a in range(len(rows)):
            for b in range(a):
                if rows[a].doc_id == rows[b].doc_id or sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * max(1, len(sets[a] | sets[b])):
                    low[a] = low[b] = min(low[a], low[b])
    want = {(r.doc_id, r.text) for r, g in zip(rows, low) if r.doc_id == g} | {(None, r.text) for r in kept.collect() if r.doc_id is None}
    got = Counter((r.doc_id, r.text) for r in once.collect())
    assert set(got) == want and max(got.values()) == 1

    hidden = common.cut(stages["secrets"](spark, once, SF))
    spans = {(r.doc_id, r.text): r["_quarry_s"].spans for r in secrets.with_secrets(once).collect()}
    want = Counter()
    for r in once.collect():
        t, out, at = r.text, "", 0
        for a, z in sorted((int(x.split(":")[1]), int(x.split(":")[2])) for x in spans[r.doc_id, r.text].split(",") if x):
            if a > at or not out and not at:
                out += t[at:a] + "[SECRET]"
            at = max(at, z)
        want[r.doc_id, None if t is None else out + t[at:]] += 1
    assert Counter((r.doc_id, r.text) for r in hidden.collect()) == want
    assert all(r.n_chars == (None if r.text is None else len(r.text)) for r in hidden.collect())

    mixed = common.cut(stages["mix"](spark, hidden, SF))
    m = mixing.mix(hidden).toPandas()
    assert Counter(r.source for r in mixed.collect()) == Counter({s if isinstance(s, str) else None: int(g.copies.sum()) for s, g in m.groupby("source", dropna=False) if g.copies.sum()})
    assert set(mixed.collect()) <= set(hidden.collect()) and max(Counter(mixed.collect()).values()) <= 3
    words = Counter()
    for r in mixed.collect():
        words[r.source] += len((r.text or "").encode().split())
    for s, g in m.groupby("source", dropna=False):
        assert abs(words[s if isinstance(s, str) else None] - g.target.iloc[0]) <= max(0.02 * g.target.iloc[0], g["size"].max())

    pieces = stages["pack"](spark, mixed, SF).toPandas()
    tk = tokenizers.Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert pieces.length.sum() == sum(len(tk.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert pieces.groupby("sequence_id").length.sum().max() <= 2048


def test_stages_on_empty_and_blank_tables(spark, odd):
    blank = spark.createDataFrame([(1, None, None, None, None, None, None), (2, "", None, "s", 0, None, None), (2, " \n", None, "s", 2, None, None)], DOCS)
    for docs in (odd.limit(0), blank):
        for name, stage in corpus_pipeline.STAGES:
            out = common.cut(stage(spark, docs, SF))
            assert out.count() <= docs.count()
            if name != "pack":
                assert out.columns == docs.columns
            if name in ("secrets", "pack"):
                assert out.count() == docs.count()


def test_checkpoints_need_a_shared_folder():
    class Context:
        getCheckpointDir = staticmethod(lambda: None)

    class Session:
        sparkContext = Context()
        conf = {}

    class Frame:
        sparkSession = Session()

    with pytest.raises(ValueError):
        common.cut(Frame())


def test_rows_of_a_hot_class(spark):
    """with_class() gives what a join gives, for classes of all sizes."""
    rows = spark.range(20_000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 777).alias("k"))
    classes = rows.groupBy("k").agg(F.count("*").alias("copies"), F.min("id").alias("least"))
    want = Counter(rows.join(classes, "k").select("id", "k", "least", "copies").collect())
    assert Counter(common.with_class(rows, classes, "k").select("id", "k", "least", "copies").collect()) == want
