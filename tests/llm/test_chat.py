import hashlib
import random

from postflow.llm import chat
from pyspark.sql import functions as F
from llm_fixtures import importable  # noqa: F401

PARTS = "conv_id long, turn long, role string, parts array<struct<kind:string,text:string,ref:string,units:double>>, formatted string"


def back(df):
    done = chat.format_chat(df)
    return done.select(
        "*", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_masked(F.col("formatted"), F.col("turn_starts"), F.col("loss_mask")).alias("masked"),
    )


def text(value):
    return [("text", value, None, None)]


def test_round_trip_of_control_strings(spark):
    rng = random.Random(3)
    pieces = [*chat.CONTROL, chat.TURN, chat.SEP, chat.END, "\\", "\\l", "\\e", "\\b", "<", "[", "|", "é", "𝔘", "\n", " ok ", "</", "|>"]
    word = lambda: "".join(rng.choice(pieces) for _ in range(rng.randrange(12)))
    rows = [(c, t, rng.choice(["user", "assistant", word()]), text(word()), "x") for c in range(60) for t in range(rng.randrange(1, 5))]
    got = {r["conv_id"]: r for r in back(spark.createDataFrame(rows, PARTS)).collect()}
    for c in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == c]
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r[2], r[3][0][1]) for r in mine]
        assert got[c]["masked"] == "".join(r[3][0][1] for r in mine if r[2] == "assistant")
        for r in mine:
            for control in chat.CONTROL:
                if control != "<|":
                    assert control not in got[c]["formatted"]
        assert got[c]["formatted_chars"] == len(got[c]["formatted"])


def test_parts_become_placeholders_and_attachments(spark):
    rows = [
        (1, 0, "user", [("text", "see", None, None), ("image", None, "i.png", 2.0), ("text", "and", None, None), ("audio", None, "a.wav", 3.5)], "x"),
        (1, 1, "assistant", [("text", "a chart", None, None), ("document", None, "d.pdf", 0.1), ("text", "done", None, None)], "x"),
        (1, 2, "user", [("video", None, "v", 9.0)], "x"),
    ]
    r = back(spark.createDataFrame(rows, PARTS)).first()
    assert "see<|image|>and<|audio|>" in r["formatted"]
    assert [(a["ordinal"], a["turn"], a["kind"], a["ref"], a["tokens"]) for a in r["attachments"]] == [
        (0, 0, "image", "i.png", 512), (1, 0, "audio", "a.wav", 88), (2, 1, "document", "d.pdf", 60), (3, 2, "video", "v", 0)]
    assert r["expanded_tokens"] == 660
    for a in r["attachments"]:
        assert r["formatted"][a["start"]:].startswith(f"<|{a['kind']}|>")
    spans = [s for turn in r["loss_mask"] for s in turn]
    assert [r["formatted"][s["start"]:s["start"] + s["length"]] for s in spans] == ["a chart", "done"]
    assert r["masked"] == "a chartdone"
    assert [t["text"] for t in r["turns"]] == ["seeand", "a chartdone", ""]


def test_nulls_ties_and_repeats(spark):
    rows = [
        (1, None, None, None, "x"), (1, 5, "user", text(None), "x"), (1, 5, "assistant", text("b"), "x"),
        (1, 5, "assistant", text("b"), "x"), (None, 0, "assistant", text("lone"), "x"), (2, 0, "user", [], "x"),
        (3, 0, "assistant", [(None, "kindless", None, None)], "x"),
    ]
    got = {r["conv_id"]: r for r in back(spark.createDataFrame(rows, PARTS)).collect()}
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("", ""), ("assistant", "b"), ("assistant", "b"), ("user", "")]
    assert got[1]["masked"] == "bb" and got[None]["masked"] == "lone" and got[3]["masked"] == "kindless"
    assert got[2]["n_turns"] == 1 and got[2]["masked"] == ""
    assert chat.format_chat(spark.createDataFrame([], PARTS)).count() == 0


def test_long_conversation(spark):
    rows = [(1, t, "assistant" if t % 2 else "user", text(f"<|x{t}" * 200), "x") for t in range(2000)]
    r = back(spark.createDataFrame(rows, PARTS)).first()
    want = "".join(f"<|x{t}" * 200 for t in range(1, 2000, 2))
    assert hashlib.sha256(r["masked"].encode()).digest() == hashlib.sha256(want.encode()).digest()
