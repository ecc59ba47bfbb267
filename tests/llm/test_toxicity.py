"""Toxicity: folding, exceptions, held-out accuracy, and awkward rows."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarry.llm import toxicity

DOCS = "doc_id long, text string, lang string, source string, toxic string, score string"
BAD = ["blorpface", "zgnark", "twillheim"]


def written(rng, n, words):
    return [str(w) for w in rng.choice(words, n)]


@pytest.fixture(scope="module")
def corpus(spark):
    """Toxic texts hold bad words at a rate of a fiftieth; clean ones hold one now and then, or an exception phrase."""
    rng = np.random.default_rng(3)
    plain = ["".join(rng.choice(list("abcdeghinorstu"), rng.integers(2, 9))) for _ in range(900)]
    rows, labels = [], []
    for i in range(1500):
        w, y = written(rng, int(rng.integers(30, 300)), plain), int(i % 5 == 0)
        for k in range(max(1, len(w) // 50) if y else int(rng.random() < 0.05)):
            w[rng.integers(len(w))] = BAD[rng.integers(3)] + ("", "s", "ish")[k % 3]
        if not y and i % 12 == 1:
            at = int(rng.integers(len(w)))
            w[at : at + 1] = ["kind", "zgnark"]  # an exception phrase that clean texts teach
        rows.append((i, " ".join(w), "en", "src", "clash", "clash"))
        if i < 1200:
            labels.append((i, None if i % 9 == 0 else 1, y))
    return spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows


def test_folding():
    fold = toxicity.Folder()
    want = fold("stupid idiot loser")
    for t in ("STUPID idiot! (Loser)", "5tup1d 1d10t l0s3r", "ѕtuріd іdіоt lоѕеr", "s̈tupíd idïot lösér", "$tup!d id|ot 1o$er!!", "stuuuupid idiooot loserrr", "st​upid id­iot l⁠oser", "stupid_idiot loser$$$", "ｓｔｕｐｉｄ 𝐢𝐝𝐢𝐨𝐭 loser"):
        assert fold(t) == want, t
    assert fold("12 3,5 $40 !! 99") == [] and fold(None) == [] and fold("") == []
    assert fold("thoner### to%%% ththwh$$$") == ["thoner", "to", "ththwh"]


def test_lexicon_and_exceptions():
    x = toxicity.Lexicon({"trash": 2.0, "ciown": 3.0, "as ": 1.0}, ["trash can", "clown fish"])
    words = toxicity.Folder()("Trash! the trash can, clown fish; clowns as assets trash")
    assert [(s, w) for _, w, s in x.hits(words)] == [("trash", 2.0), ("ciown", 3.0), ("as ", 1.0), ("trash", 2.0)]
    assert x.weigh(words) == (8.0, 4, 10)
    assert toxicity.Lexicon({}).hits(words) == []


def test_learns_entries_weights_and_exceptions(spark, corpus):
    docs, labels, rows = corpus
    lexicon, b = toxicity.fit(docs, labels)
    fold = toxicity.Folder()
    assert {fold(w)[0][:5] for w in BAD} <= {s[:5] for s in lexicon.weights} and len(lexicon.weights) < 12
    assert any("kind zgnark" in e for e in lexicon.exceptions)
    got = {r.doc_id: r for r in toxicity.toxicity(docs, labels).collect()}
    assert len(got) == len(rows)
    for r in got.values():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [i for i in got if got[i].held_out]
    y, p = np.array([i % 5 == 0 for i in held]), np.array([got[i].predicted == 1 for i in held])
    assert p[y].mean() > 0.9 and p[~y].mean() < 0.02
    # labels that are kept back don't matter
    flipped = labels.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.toxicity(docs, flipped).collect()} == {i: r.score for i, r in got.items()}
    # disguises and metadata change nothing
    other = docs.withColumn("text", F.translate("text", "oeai", "03аі")).withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("x")})
    lex = toxicity.weighing(lexicon)
    a, c = ({r.doc_id: r.h for r in d.select("doc_id", lex(F.col("text")).getField("hits").alias("h")).collect()} for d in (docs, other))
    assert a == c


def test_hot_copies_count_once(spark, corpus):
    docs, labels, rows = corpus
    text = " ".join(f"frobword{k} plainly" for k in range(40))
    copies = spark.createDataFrame([(10_000 + i, text + (f" tail{i}" if i % 2 else ""), "en", "s", "", "") for i in range(600)], DOCS)
    more = labels.unionByName(spark.createDataFrame([(10_000 + i, 1, 1) for i in range(600)], labels.schema))
    lexicon, _ = toxicity.fit(docs.unionByName(copies), more)
    assert not any(s.startswith("frob") for s in lexicon.weights)


def test_awkward_rows(spark, corpus):
    docs, labels, rows = corpus
    odd = [(None, None, None, None, None, None), (1, "", "en", None, "", ""), (2, " \t\n", "", "", "", ""), rows[5], rows[5], (3, "blorpface " * 40000, None, None, None, None), (4, "\U0001f600 é1 1é", "xx", "", "", "")]
    df = spark.createDataFrame(odd, DOCS)
    out = toxicity.toxicity(df, labels)
    assert out.count() == len(odd) and not out.where("score is null or predicted is null").head(1)
    none = labels.limit(0)
    assert {r.score for r in toxicity.toxicity(df, none).collect()} == {0.5}
    assert toxicity.toxicity(df.limit(0), labels).count() == 0
    bad = spark.createDataFrame([(5, None, None), (None, 1, 1), (5, 1, 1), (5, 1, 0), (6, 1, 7)], labels.schema)
    assert {r.score for r in toxicity.toxicity(docs, bad).collect()} == {0.5}


def test_held_out_accuracy(spark):
    """On the given tables: the labels that are kept back are met by the score."""
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = toxicity.toxicity(docs, labels).where("held_out").join(labels, "doc_id").select("score", "predicted", "toxic").toPandas()
    s, y = got.score.to_numpy(), got.toxic.to_numpy() == 1
    rank = got.score.rank().to_numpy()
    auc = (rank[y].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (~y).sum())
    assert auc > 0.95 and (s[y] >= 0.7).mean() > 0.88 and (s[~y] >= 0.7).mean() < 0.005
