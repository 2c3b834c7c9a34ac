"""Sources, sinks and streams."""

import hashlib
import hmac
import json

import pytest
from parley.functions.stats import keyed_id
from parley.sources import readers, writers
from parley.streaming import incremental
from pyspark.sql import functions as F


def test_csv_with_line_breaks_and_missing_columns(spark, tmp_path):
    p = tmp_path / "v.csv"
    p.write_text('conv_id,speaker,vol_text,extra\n1,Therapist,"a\nb ""c""",x\n1,client,d,y\n')
    got = readers.read_volleys(spark, str(p)).orderBy("conv_vol_idx").collect()
    assert [r["vol_text"] for r in got] == ['a\nb "c"', "d"] and got[0]["conv_vol_idx"] == 0


def test_third_party_and_registry(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("conv_id,speaker,vol_text,label\n1,therapist,x,\"['CR', 'SR']\"\n1,patient,y,C\n3,patient,w,GI\n2,therapist,z,[]\n")
    got = {r["utt_text"]: r for r in readers.load_dataset(spark, "third_party", str(p)).collect()}
    assert (got["x"]["t1_label"], got["x"]["t2_label"]) == ("SRL", "CR") and got["y"]["speaker"] == "client" and got["z"]["t1_label"] is None and got["y"]["t1_label"] == "C" and got["w"]["t1_label"] is None
    with pytest.raises(ValueError):
        readers.load_dataset(spark, "nothing", str(p))


def test_experiment_metadata_and_paths(spark, tmp_path):
    (tmp_path / "run7").mkdir()
    (tmp_path / "run7" / "metadata.json").write_text(json.dumps({"parser_model": "p", "fine_tuning_enabled": False}))
    assert readers.read_experiments(spark, str(tmp_path)).first()["experiment_id"] == "run7"
    assert readers.first_existing(spark, [str(tmp_path / "no"), str(tmp_path / "run7")]).endswith("run7")
    with pytest.raises(FileNotFoundError):
        readers.first_existing(spark, [str(tmp_path / "no")])
    (tmp_path / "s.yaml").write_text("Q: questions\n")
    assert readers.read_specs(str(tmp_path / "s.yaml")) == {"Q": "questions"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "é"), (2, "b")], "k int, t string")
    writers.append_new(df, str(tmp_path / "a"), ["k"])
    writers.append_new(df, str(tmp_path / "a"), ["k"])
    assert spark.read.parquet(str(tmp_path / "a")).count() == 2
    writers.write_jsonl(df.coalesce(1), str(tmp_path / "j"))
    assert "é" in next((tmp_path / "j").glob("*.json")).read_text()
    writers.write_report(df, str(tmp_path / "r.json"))
    assert len(json.loads((tmp_path / "r.json").read_text())) == 2
    assert "k" in writers.text_table(df, ["k", "t"])


def test_keyed_ids(spark):
    got = spark.createDataFrame([("x",), (None,)], "v string").select(keyed_id(F.col("v"), b"key")).collect()
    assert got[0][0] == hmac.new(b"key", b"x", hashlib.sha256).hexdigest()
    assert got[1][0] is None


def test_annotating_a_stream_twice_changes_nothing(spark, tmp_path):
    turns = spark.createDataFrame([(1, 0, "user", "Hello. I try."), (1, 1, "assistant", "Good!")], "conv_id long, turn long, role string, text string")
    turns.write.parquet(str(tmp_path / "in"))
    for n in (1, 2):
        q = incremental.annotate_stream(spark, str(tmp_path / "in"), turns.schema, str(tmp_path / "out"), str(tmp_path / f"cp{n}"), lambda u: u.withColumn("code", F.lit("N")))
        q.awaitTermination(120)
        assert spark.read.parquet(str(tmp_path / "out")).count() == 3


def test_momentum_steps():
    m = incremental.Momentum(0.1)
    assert m.step(0.2, "R+") == pytest.approx(0.3) and m.step(0.2, None) == 0.2 and m.step(1.0, "N") == pytest.approx(0.9) and m.step(0, "TS-") == pytest.approx(-0.2)


def test_momentum_stream_goes_on_across_batches(spark, tmp_path):
    from parley.operators.trajectory import momentum

    rows = [(1, 0, "N"), (1, 1, "C+"), (2, 0, "R-"), (1, 2, "R+"), (1, 3, None), (2, 1, "TS-"), (1, 4, "O+")]
    shape = "conv_id long, conv_utt_idx long, code string"
    for n, part in enumerate((rows[:3], rows[3:])):
        spark.createDataFrame(part, shape).coalesce(1).write.parquet(str(tmp_path / "in" / f"b{n}"))
    store = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(store, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        stream = spark.readStream.schema(shape).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in" / "*"))
        q = incremental.stream_momentum(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out"))
        q.trigger(availableNow=True).start().awaitTermination(180)
    finally:
        spark.conf.unset(store)
    got = {(r[0], r[1]): round(r[2], 9) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = momentum(spark.createDataFrame(rows, shape), "code", tier="t2")
    assert got == {(r[0], r[1]): round(r[2], 9) for r in want.collect()}


def test_gold_labels_keep_their_place(spark, tmp_path):
    p = tmp_path / "m.csv"
    p.write_text("conv_id,speaker,corp_vol_idx,conv_vol_idx,corp_utt_idx,conv_utt_idx,utt_text,t1_label_GT,t2_label_GT\nb,client,1,0,2,0,x,C,C+\na,client,0,0,1,1,y,N,N\na,client,0,0,0,0,z,N,N\n")
    assert [r["utt_text"] for r in readers.read_manual(spark, str(p)).orderBy("row_pos").collect()] == ["z", "y", "x"]
    assert readers.load_dataset(spark, "manual_a", str(p)).count() == 3


def test_outcomes_predictions_and_annotations(spark, tmp_path):
    o, q, a = tmp_path / "o.csv", tmp_path / "q.csv", tmp_path / "a.csv"
    o.write_text("participant_id,status,pre_confidence,post_confidence,week_later_confidence\n1,low,2,3,4\n1,low,1,3,4\n2,high,5,,6\n")
    got = {r["participant_id"]: r for r in readers.read_outcomes(spark, str(o)).collect()}
    assert got["1"]["pre_confidence"] == 2 and got["2"]["post_confidence"] is None
    q.write_text("dataset,conv_id,speaker,utt_text,human_label,zero_shot_pred,fine_tuned_pred\nd,1,client,x,C,S,C\n")
    assert readers.read_predictions(spark, str(q)).first()["fine_tuned_pred"] == "C"
    a.write_text("conv_id,conv_utt_idx,speaker,utt_text,label_auto,expl_auto\n1,0,client,x,C+,because\n")
    assert readers.read_annotated(spark, str(a), "flat").first()["label_auto"] == "C+"
    with pytest.raises(ValueError):
        readers.read_annotated(spark, str(a), "other")
    found = {r["name"]: (r["present"], r["n_rows"]) for r in readers.check_presence(spark, {"o": str(o), "no": str(tmp_path / "no.csv")}).collect()}
    assert found == {"o": (True, 3), "no": (False, 0)}


def test_csv_sink_and_names(spark, tmp_path):
    from parley.operators.experiments import artifact_name

    rows = spark.createDataFrame([(1, 'a "b"\nc'), (2, None)], "conv_id long, vol_text string")
    named = writers.with_partition_path(rows, "d", None, "tiered")
    assert named.select("dataset", "subset", "structure").distinct().collect() == [("d", "all", "tiered")]
    writers.write_csv(rows, str(tmp_path / "out"))
    back = spark.read.csv(str(tmp_path / "out"), header=True, multiLine=True, escape='"').orderBy("conv_id").collect()
    assert [r["vol_text"] for r in back] == ['a "b"\nc', None]
    assert artifact_name("d", None, "flat", "org/p", "a", "all", 3) == "d_all_flat_p_a_all_3"


def test_codes_are_counted_in_windows(spark):
    rows = spark.createDataFrame([("2024-01-01 10:05:00", "C"), ("2024-01-01 10:55:00", "C"), ("2024-01-01 11:00:00", "S")], "at string, code string")
    got = incremental.windowed_codes(rows.select(F.to_timestamp("at").alias("ts"), "code")).collect()
    assert sorted((str(r["window"]["start"])[11:16], r["code"], r["n"]) for r in got) == [("10:00", "C", 2), ("11:00", "S", 1)]


def test_specs_reach_the_second_tier_prompt(spark):
    from parley.operators import prompts

    rows = spark.createDataFrame([("client", "I will stop", "", "C")], "speaker string, utt_text string, context string, t1 string")
    message = prompts.messages_t2(rows, "t1", {"C": "talk of change"}).first()["messages"][0]["content"]
    assert "Group: talk of change" in message


def test_prompts_are_tokenised_masked_and_padded(spark):
    import public_tokenizers
    from parley.operators import prompts
    from tokenizers import Tokenizer

    path = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(path)
    rows = spark.createDataFrame([("Say it. Code:", " SR\n"), ("word " * 50, " SR\n")], "prompt string, completion string")
    short, long = prompts.tokenised(rows, path, 50256, 12).collect()
    p, c = (tok.encode(x, add_special_tokens=False).ids for x in ("Say it. Code:", " SR\n"))
    assert short["input_ids"][: len(p + c) + 1] == [*p, *c, 50256] and short["labels"] == [-100] * len(p) + [*c, 50256] + [-100] * (12 - len(p + c) - 1)
    assert short["attention_mask"] == [1] * (len(p + c) + 1) + [0] * (12 - len(p + c) - 1)
    assert len(long["input_ids"]) == 12 and long["labels"] == [-100] * 12
