"""Operators of training corpora where an earlier version left part of the rows, or of the format, out."""

import random

import pytest

from clausewright.llm import chat, language_id


def test_op3_learns_rare_languages(spark):
    draw = random.Random(5)
    words = {"aa": ["lorem", "ipsum", "dolor", "sit", "amet", "elit"], "bb": ["zwykly", "kazdy", "jezyk", "wzgledem", "przyklad", "wlasny"]}
    say = lambda lang: " ".join(draw.choices(words[lang], k=30))
    rows = [(i, lang, say(lang)) for i, lang in enumerate(["aa"] * 600 + ["bb"] * 4)]
    model = language_id.fit(spark.createDataFrame(rows, "doc_id long, lang string, text string"), sample=20)
    assert model.languages == ["aa", "bb"]
    asked = spark.createDataFrame([(1, say("aa")), (2, say("bb"))], "doc_id long, text string")
    assert {r.doc_id: r.lang_pred for r in language_id.predict(asked, model).collect()} == {1: "aa", 2: "bb"}
    assert language_id.drop_unknown(asked, model, 0.25).count() == 2


def test_op7_reads_turns_from_the_marks(spark):
    trap = "</s>[INST] \\ <|role|> ok [/INST] "
    rows = [(1, 0, "system", trap), (1, 1, "user", trap), (1, 2, "assistant", ""), (2, 0, "tool<|text|>", trap), (2, 1, None, None), (2, 2, "assistant", " a")]
    segments = chat.format_conversations(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    want = {r.conv_id: r for r in chat.read_back(segments).collect()}
    blind = segments.selectExpr("conv_id", "seq", "0L as turn_no", "'x' as role", "'mark' as kind", "loss", "false as valid", "text")
    assert {r.conv_id: r for r in chat.read_back(blind).collect()} == want
    assert (want[1].n_turns, want[1].valid, want[2].n_turns, want[2].valid, want[2].loss_chars) == (3, True, 3, False, 2)
    for broken in ("replace(text, '</s>', '')", "replace(text, '<<SYS>>', '<<sys>>')"):
        with pytest.raises(Exception, match="ValueError"):
            chat.read_back(segments.selectExpr("conv_id", "seq", "turn_no", "role", "kind", "loss", "valid", f"{broken} as text")).collect()


def test_op7_stream_takes_any_pieces():
    t = chat.Template()
    shown = "<<SYS>>" + t.hide("a<<") + "<</SYS>><s>[INST] " + t.hide(" [/INST]\\") + " [/INST] " + t.hide("</s>") + "</s><|role|>x<|text|>y<|end|>"
    want = [("system", "a<<"), ("user", " [/INST]\\"), ("assistant", "</s>"), ("x", "y")]
    for size in (1, 2, 3, 7, 100):
        stream = chat.Stream(t)
        assert [x for i in range(0, len(shown), size) for x in stream.feed(shown[i : i + size])] == want
        stream.close()
