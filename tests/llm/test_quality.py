import numpy as np
import pyarrow as pa
import pytest

from postflow.llm import quality, queries
from postflow.llm.support import read
from llm_fixtures import documents, odd_documents, importable  # noqa: F401

SF = "/root/testdata/sf0.1"
NAMES = {n: i for i, n in enumerate(quality.FEATURES)}


def test_statistics_against_plain_counting():
    texts = ["The the cat. Sat!!\nthe the\n\nTHE cat. sat!!", "", None, "a", "x | y | z 123", "é ü ", "\n\n", "one line\none line\nother"]
    got = quality.text_features(pa.array(texts))
    for row, text in zip(got, texts):
        data, words = (text or "").encode(), (text or "").lower().split()
        lines = [tuple(l.split()) for l in (text or "").lower().split("\n") if l.split()]
        n, w = max(len(data), 1), max(len(words), 1)
        want = {
            "log_bytes": np.log1p(len(data)), "log_words": np.log1p(len(words)),
            "upper_share": sum(65 <= b <= 90 for b in data) / n, "digit_share": sum(48 <= b <= 57 for b in data) / n,
            "exclaim_share": data.count(b"!") / n, "markup_share": data.count(b"|") / n,
            "bytes_a_word": sum(len(x.encode()) for x in words) / w,
            "distinct_word_share": len(set(words)) / w, "top_word_share": max([words.count(x) for x in words], default=0) / w,
            "repeated_word_share": sum(a == b for a, b in zip(words, words[1:])) / w,
            "distinct_pair_share": len(set(zip(words, words[1:]))) / max(len(words) - 1, 1),
            "log_lines": np.log1p(len(lines)), "distinct_line_share": len(set(lines)) / max(len(lines), 1),
            "words_a_line": len(words) / max(len(lines), 1),
        }
        for name, value in want.items():
            assert row[NAMES[name]] == pytest.approx(value), (text, name)


def test_statistics_do_not_depend_on_the_batch():
    texts = [f"word{i} " * (i % 7) + "\n" * (i % 3) for i in range(200)] + ["long text " * 150_000]
    together = quality.text_features(pa.array(texts))
    alone = np.concatenate([quality.text_features(pa.array([t])) for t in texts])
    assert np.allclose(together, alone)


def test_trees_learn_what_needs_two_splits():
    rng = np.random.default_rng(1)
    x = rng.random((3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 2] > 0.3)).astype(float)
    forest = quality.grow(x[:2000], y[:2000])
    assert ((forest.predict(x[2000:]) > 0.5) == y[2000:]).mean() > 0.97


def test_flat_walk_equals_node_by_node():
    rng = np.random.default_rng(2)
    x = rng.random((500, 3))
    forest = quality.grow(x, (x[:, 0] + x[:, 1] > 1).astype(float), quality.Boosting(trees=5, depth=3))
    for row, p in zip(x, forest.predict(x)):
        total = forest.base
        for t in range(5):
            node = 0
            while node < 7:
                node = 2 * node + 1 + int(row[forest.feature[t][node]] > forest.limit[t][node])
            total += forest.leaf[t][node - 7]
        assert p == pytest.approx(1 / (1 + np.exp(-total)))


@pytest.mark.parametrize("y", [[], [1, 1, 1], [0, 1]])
def test_too_little_to_learn(y):
    forest = quality.grow(np.zeros((len(y), 2)), np.array(y, float))
    assert ((0 < forest.predict(np.zeros((3, 2)))) & (forest.predict(np.zeros((3, 2))) < 1)).all()


def test_odd_rows(spark, odd_documents):
    labels = spark.createDataFrame([(3, 1), (4, 0), (4, 0), (5, None), (99, 1), (None, 1)], "doc_id long, quality int")
    forest = quality.fit_quality(odd_documents, labels)
    got = quality.score_quality(odd_documents, forest).collect()
    assert len(got) == odd_documents.count() and all(0 <= r["score"] <= 1 for r in got)
    assert quality.score_quality(odd_documents.where("false"), forest).count() == 0


def test_held_out_quality(spark):
    scored = queries.QUERIES["op9_quality"](spark, SF).join(read(spark, SF, "labels"), "doc_id").where("held_out").collect()
    bad = [r["score"] for r in scored if r["quality"] == 0]
    good = [r["score"] for r in scored if r["quality"] == 1]
    auc = np.mean([(np.array(good) > b).mean() + (np.array(good) == b).mean() / 2 for b in bad])
    kept = np.mean([s >= 0.3 for s in good])
    print("auc", auc, "kept", kept, "caught", np.mean([s < 0.3 for s in bad]))
    assert auc > 0.8 and kept > 0.97
