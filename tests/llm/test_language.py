import collections
import math

import numpy as np
import pytest

from postflow.llm import language, queries
from postflow.llm.support import read
from llm_fixtures import documents, odd_documents, importable  # noqa: F401

SF = "/root/testdata/sf0.01"


def brute(texts, text):
    """Code length of `text` by plain counting, method C, no exclusion."""
    seen = collections.defaultdict(collections.Counter)
    for t in texts:
        data = bytes(3) + t.lower().encode()
        for i in range(3, len(data)):
            for order in range(4):
                seen[data[i - order:i]][data[i]] += 1
    data, bits = bytes(3) + text.lower().encode(), 0.0
    for i in range(3, len(data)):
        for order in range(3, -1, -1):
            nexts = seen.get(data[i - order:i])
            if nexts is None:
                continue
            total, kinds = sum(nexts.values()), len(nexts)
            if data[i] in nexts:
                bits -= math.log2(nexts[data[i]] / (total + kinds))
                break
            bits -= math.log2(kinds / (total + kinds))
        else:
            bits += 8
    return bits


def test_code_lengths_against_brute_force(spark, documents):
    learned = {"aa": ["abab abba cab", "bab"], "bb": ["xyz abc", "zzz çé", "z"]}
    rows = [(i, t, lang) for i, (lang, t) in enumerate((lang, t) for lang, ts in learned.items() for t in ts)]
    model = language.fit_languages(documents(rows))
    assert model.languages == ["aa", "bb"]
    for text in ("abab", "a", "zab çq", "QQQ", "xyz abba cab çé" * 9):
        data = np.frombuffer(text.lower().encode(), np.uint8)
        got = model.code_lengths(data, np.array([0, len(data)]))[0]
        assert got == pytest.approx([brute(learned["aa"], text), brute(learned["bb"], text)], rel=1e-5)


def test_long_texts_are_sliced_without_a_seam(spark, documents):
    model = language.fit_languages(documents([(1, "the cat sat on the mat", "en"), (2, "le chat est là", "fr")]))
    text = ("the cat est là " * 200_000).encode()
    data = np.frombuffer(text, np.uint8)
    starts = np.array([0, 5, len(data)])
    got = model.code_lengths(data, starts)
    total = np.zeros(2)
    for a in range(5, len(data), 700_001):
        lead = min(3, a - 5)
        total += model._slice(data[a - lead:min(a + 700_001, len(data))], np.array([0, min(a + 700_001, len(data)) - a + lead]), lead)[0]
    assert len(data) > 2 << 20
    assert got[1] == pytest.approx(total, rel=1e-6)
    assert got[0] == pytest.approx(model.code_lengths(data[:5], np.array([0, 5]))[0], rel=1e-6)


def test_odd_rows(spark, odd_documents):
    model = language.fit_languages(odd_documents)
    got = {}
    for r in language.identify_languages(odd_documents, model).collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert {k for k, v in got.items() if v[0]["lang_pred"] == "und"} == {0, 1, 2, 7}
    assert all(r[0]["score"] == 0 and r[0]["bits_per_byte"] is None for k, r in got.items() if k in (0, 1, 2, 7))
    assert got[4][0]["lang_pred"] == "en" and len(got[6]) == 2
    assert all(0 <= r["score"] <= 1 for v in got.values() for r in v)
    assert language.identify_languages(odd_documents.where("false"), model).count() == 0


def test_nothing_learned(spark, odd_documents):
    model = language.fit_languages(odd_documents.where("false"))
    assert {r["lang_pred"] for r in language.identify_languages(odd_documents, model).collect()} == {"und"}


def test_fit_is_bounded(spark, documents):
    rows = [(i, f"word{i} " * 5, "en" if i % 3 else "fr") for i in range(60)]
    bounds = language.Bounds(texts=4)
    one = language.fit_languages(documents(rows), bounds=bounds)
    again = language.fit_languages(documents(rows[::-1]), bounds=bounds)
    assert one.languages == ["en", "fr"] and all((a == b).all() for a, b in zip(one.codes, again.codes))
    chosen = language._chosen(documents(rows), None, bounds, "doc_id").groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in chosen} == {"en": 4, "fr": 4}


def test_all_texts_are_learned(spark, documents):
    """More than any sample: each text's own word is known, one cut across pieces and rows without a key too."""
    rows = [(i if i % 2 else None, f"w{i:04}x", "en") for i in range(1000)] + [(5000, "ab" * (1 << 20) + "q!", "xx")]
    model = language.fit_languages(documents(rows))
    runs = lambda n: sum(language._find(model.codes[3], np.array([int.from_bytes(f"{i:04}".encode()) for i in range(n)], np.uint32))[1])
    assert runs(1000) == 1000
    one = language.fit_limits(documents(rows))[0]
    assert all((a == b).all() for a, b in zip(one.codes, model.codes))
    counts = language._all_sizes(language._counted(documents(rows), "lang").toArrow().to_pandas(), "lang")
    total = counts[counts["lang"] == "xx"].groupby("size")["n"].sum()
    assert list(total) == [(2 << 20) + 2] * 4
    assert counts[(counts["lang"] == "xx") & (counts["size"] == 3)].set_index("run")["n"][int.from_bytes(b"abab")] == (1 << 20) - 1


def test_every_language_is_learned(spark, documents):
    """Seventy languages that share the budget of texts, one of them with long texts only."""
    rng = np.random.default_rng(3)
    words = {f"l{n:02}": ["".join(chr(97 + c) for c in rng.integers(0, 26, 5)) for _ in range(6)] for n in range(70)}
    say = lambda lang, n: " ".join(words[lang][k] for k in rng.integers(0, 6, n))
    rows = [(1000 * i + j, say(lang, 300 if lang == "l69" else 20), lang) for i, lang in enumerate(words) for j in range(5)]
    bounds = language.Bounds(texts=400, text_bytes=1000, all_texts=140)
    chosen = language._chosen(documents(rows), None, bounds, "doc_id").groupBy("lang").count().collect()
    assert {r["lang"]: r["count"] for r in chosen} == {lang: 2 for lang in words}
    model = language.fit_languages(documents(rows), bounds=bounds)
    assert model.languages == sorted(words)
    tests = documents([(i, say(lang, 15), lang) for i, lang in enumerate(words)])
    found = language.identify_languages(tests, model).join(tests.select("doc_id", "lang"), "doc_id").collect()
    assert all(r["lang_pred"] == r["lang"] for r in found)


def test_held_out_accuracy(spark):
    found = queries.QUERIES["op3_language_id"](spark, SF).join(read(spark, SF, "documents"), "doc_id")
    held = found.where("held_out").select("lang", "lang_pred", "score").collect()
    right = sum(r["lang"] == r["lang_pred"] for r in held) / len(held)
    assert len(held) > 250 and right > 0.97
