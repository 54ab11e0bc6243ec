"""Cases that every operator must take: ties, repeated rows, null ids, empty tables."""

import hashlib

from pagequarry.llm import chat_format

COLUMNS = "conv_id long, turn long, role string, text string"


def test_turns_that_tie_repeated_rows_and_the_null_conversation(spark):
    rows = [(1, 0, "user", "b"), (1, 0, "user", "a"), (1, 0, None, "z"), (1, None, "assistant", "first"), (2, 0, "user", "same"), (2, 0, "user", "same"), (2, 1, "assistant", "ok")]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", "y"), (None, 1, "assistant", None)]
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.format_segments(spark.createDataFrame(rows, COLUMNS).repartition(3))).collect()}
    # In the order of turn (null first), role (null first) and text (null first).
    wanted = {
        1: [("assistant", "first"), ("", "z"), ("user", "a"), ("user", "b")],
        2: [("user", "same"), ("user", "same"), ("assistant", "ok")],
        None: [("user", "x"), ("assistant", ""), ("assistant", "y")],
    }
    assert set(got) == set(wanted)
    for conversation, turns in wanted.items():
        r, loss = got[conversation], "".join(t for role, t in turns if role == "assistant")
        assert (r["n_turns"], r["turns_sha256"]) == (len(turns), hashlib.sha256("".join(f"{role}\n{t}\n" for role, t in turns).encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())


def test_the_pipeline_takes_an_empty_table(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.count() == 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)
