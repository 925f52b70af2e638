"""The registered queries of the subpackage against SQL, and the pipeline against plain work stage by stage."""

import base64

import pytest

import __spark_entry__ as contract
import corpus_pipeline
from check_oracle import duck, normal
from conftest import plan_of
from postflow.llm import language, quality
from postflow.llm.queries import ORACLE, QUERIES
from postflow.llm.support import read, settle
from llm_fixtures import documents, odd_documents, importable  # noqa: F401

SF = "/root/testdata/sf0.001"
NATIVE = ["op1_chat_format", "op5_fingerprints", "op6_source_mix"]


def test_all_are_registered():
    assert [q.split("_")[0] for q in QUERIES] == [f"op{n}" for n in range(1, 14)]
    assert set(QUERIES) | {"pipeline"} <= set(contract.queries()) and set(ORACLE) <= set(contract.oracle_sql())


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_against_sql(spark, name):
    got, want = contract.queries()[name](spark, SF).toPandas(), duck(SF).execute(ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and len(got) and normal(got) == normal(want)


@pytest.mark.parametrize("name", NATIVE)
def test_native_plans_hold_no_python(spark, name):
    plan = plan_of(QUERIES[name](spark, SF))
    assert not any(word in plan for word in ("Python", "Arrow", "Pandas", "CartesianProduct"))


def test_stages_take_effect_one_after_another(spark):
    docs = settle(read(spark, SF, "documents"), "documents")
    for (name, stage), check in zip(corpus_pipeline.STAGES, CHECKS):
        out = settle(stage(spark, docs, SF), "stage")
        check(spark, docs, out)
        docs = out
    assert [tuple(sorted(r)) for r in [docs.columns]] == [tuple(sorted(["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]))]


def ids(df):
    return {r["doc_id"] for r in df.select("doc_id").collect()}


def same_columns(docs, out):
    assert out.schema.simpleString() == docs.schema.simpleString()
    assert out.count() == out.distinct().count()


def check_quality(spark, docs, out):
    same_columns(docs, out)
    scores = quality.score_quality(docs, quality.fit_quality(docs, read(spark, SF, "labels")))
    assert ids(out) == ids(scores.where("score >= 0.3")) and len(ids(out)) < docs.count()


def check_language(spark, docs, out):
    same_columns(docs, out)
    found = language.identify_languages(docs, language.fit_languages(docs))
    assert ids(out) == ids(found.where("lang_pred <> 'und' and score >= 0.5"))


def check_duplicates(spark, docs, out):
    from test_jaccard import brute

    same_columns(docs, out)
    want = brute([(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()])
    assert ids(out) == {c for _, c in want.values()} and len(ids(out)) < docs.count()


def check_mixture(spark, docs, out):
    same_columns(docs, out)
    size = lambda df: sum(-(-len(r["text"].encode()) // 4) for r in df.select("text").collect())
    assert ids(out) < ids(docs) and size(out) <= 0.9 * size(docs)


def check_packing(spark, docs, out):
    from test_packing import check_places, plain_pieces
    from postflow.llm.packing import Capacity

    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = out.collect()
    assert sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in got) == sorted(plain_pieces(rows, 1024))
    check_places(got, Capacity())


CHECKS = [check_quality, check_language, check_duplicates, check_mixture, check_packing]


def test_run_over_odd_and_empty_tables(spark, odd_documents, tmp_path):
    for name, rows in (("odd", odd_documents), ("empty", odd_documents.where("false"))):
        rows.write.parquet(str(tmp_path / name / "documents.parquet"))
        read(spark, SF, "labels").write.parquet(str(tmp_path / name / "labels.parquet"))
        got = corpus_pipeline.run(spark, str(tmp_path / name)).collect()
        assert bool(got) == (name == "odd")


FOREIGN = {
    -1: "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью",
    -2: "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    -3: "Wszyscy ludzie rodzą się wolni i równi w swojej godności i w swoich prawach. Są obdarzeni rozumem i sumieniem",
    -4: "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto",
    -5: "xq zvkpw jfgh qqlz wvbn xkcd pzzj mqvw hrtx gkkf zqjx vvwp kljq xzbn wqpf jjhx kvzq tzxw " * 3,
    -6: base64.b64encode(bytes(i * i * 7 % 251 for i in range(400))).decode(),
}


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])  # on sf0.001, with 17 texts of a language, limits are wider
def test_language_stage_tells_foreign_text_and_noise_from_real_documents(spark, sf):
    real = read(spark, f"/root/testdata/{sf}", "documents")
    strange = spark.createDataFrame([(i, t, None, "src0", len(t)) for i, t in FOREIGN.items()], real.schema)
    kept = ids(corpus_pipeline.language_id(spark, real.unionByName(strange), sf))
    found = language.identify_languages(real, language.fit_languages(real))
    assert kept == ids(found.where("lang_pred <> 'und' and score >= 0.5"))


def test_language_without_a_second_text_has_no_limit(spark, documents):
    docs = documents([(1, "one text of its own language", "xx"), (2, "one text of its own language", "xx")])
    assert language.fit_limits(docs)[1] == {}
    assert ids(corpus_pipeline.language_id(spark, docs, SF)) == {1, 2}


def test_duplicates_stage_keeps_rows_without_an_id_and_all_texts_of_an_id(spark, documents):
    text = lambda name: " ".join(f"{name}{i}" for i in range(60))
    docs = documents([
        (None, text("a")), (None, text("a") + " end"), (None, text("b")), (7, text("b") + " end"), (None, text("c")),
        (5, text("d")), (5, text("e")), (5, text("e")), (6, text("d") + " end"), (None, " "), (None, None),
    ])
    out = [(r["doc_id"], (r["text"] or "-")[:1]) for r in corpus_pipeline.ngram_jaccard_join(spark, docs, SF).collect()]
    assert sorted(out, key=str) == sorted([(None, "a"), (7, "b"), (None, "c"), (5, "d"), (5, "e"), (None, " "), (None, "-")], key=str)
