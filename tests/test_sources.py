import json

import pytest
from pyspark.sql import functions as F

from counterfair.operators import logs
from counterfair.session import broadcast_if_small, checkpoint_root, cut_lineage, is_small
from counterfair.sources import chat, lines, tables


def test_encoded_csv_names_from_header_or_caller(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text("a,b,y\n1,2,0\n3,4,1\n")
    df = tables.read_encoded_csv(spark, str(path))
    assert df.columns == ["a", "b", "y"] and sorted(map(tuple, df.collect())) == [(1, 2, 0), (3, 4, 1)]
    assert tables.read_encoded_csv(spark, str(path), ["x", "z", "label"]).columns == ["x", "z", "label"]


def test_raw_csv_strips_quotes_keeps_blanks_and_lowers(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('"Age";"Job.title";"y"\n"39";"Blue;Collar";""\n?;;"No"\n')
    rows = tables.read_raw_csv(spark, str(path), ";", lower=True)
    assert rows.columns == ["age", "job.title", "y"]
    assert tables.read_raw_csv(spark, str(path), ";").columns == ["Age", "Job.title", "y"]
    assert sorted(map(tuple, rows.collect())) == [("39", "blue;collar", ""), ("?", "", "no")]


def test_named_dataset(spark, tmp_path):
    from counterfair.sources.datasets import DATASETS

    path = tmp_path / "law.csv"
    path.write_text("race1,junk,bar_passed,gender,age\nwhite,1,pass,male,-41\nblack,2,fail,female,\n")
    df = tables.read_dataset(spark, str(path), DATASETS["lawschool"])
    assert df.columns == ["race1", "gender", "age", "bar_passed"] and df.count() == 2


def test_chat_file_with_text_and_object_content(spark, tmp_path):
    doc = {"messages": [{"role": "system", "content": "hi"}, {"role": "user", "content": {"Age": 39, "Sex": "Male"}}]}
    (tmp_path / "chat.json").write_text(json.dumps(doc, indent=4))
    rows = chat.read_chat_json(spark, str(tmp_path)).orderBy("pos").collect()
    assert [(r["pos"], r["role"]) for r in rows] == [(0, "system"), (1, "user")]
    assert rows[0]["content"] == "hi" and json.loads(rows[1]["content"]) == {"Age": 39, "Sex": "Male"}


@pytest.mark.parametrize("form", ["messages", "documents", "file"])
def test_chat_round_trip(spark, tmp_path, form):
    rows = [("a", 0, "system", "s"), ("a", 1, "user", '{"x": 1}'), ("b", 0, "user", "é\n\"q\"")]
    df = spark.createDataFrame(rows, "doc STRING, pos BIGINT, role STRING, content STRING")
    chat.write_chat_json(df, str(tmp_path / form), form)
    assert sorted(map(tuple, chat.read_chat_json(spark, str(tmp_path / form), form).collect())) == sorted(rows)
    system, user = chat.split_roles(df)
    assert (system.count(), user.count()) == (1, 2)


def test_tasks_put_the_file_of_each_document_in_place(spark, tmp_path, monkeypatch):
    from pyspark.sql import DataFrameWriter

    given, option = {}, DataFrameWriter.option
    monkeypatch.setattr(DataFrameWriter, "option", lambda w, k, v: given.update({k: v}) or option(w, k, v))
    rows = [(str(i), n, "user", f"{i} {n}") for i in range(30) for n in range(2)]
    df = spark.createDataFrame(rows, "doc STRING, pos BIGINT, role STRING, content STRING")
    chat.write_chat_json(df, str(tmp_path / "files"), "file")
    assert given["mapreduce.fileoutputcommitter.algorithm.version"] == 2
    assert len(list((tmp_path / "files").glob("part-*.json"))) == 30
    assert sorted(map(tuple, chat.read_chat_json(spark, str(tmp_path / "files"), "file").collect())) == sorted(rows)


def test_sectioned_csv(spark, tmp_path):
    (tmp_path / "s.csv").write_text("x,CF SEX,\nid,age,job\n1,39,a\n2,40,\"b,c\"\n\ny,CF RACE,\n3,41,d\n")
    rows = lines.read_sectioned_csv(spark, str(tmp_path), ["id", "age", "job"]).orderBy("line_no").collect()
    assert [(r["id"], r["job"], r["request"]) for r in rows] == [("1", "a", "SEX"), ("2", "b,c", "SEX"), ("3", "d", "RACE")]


LOG = """2025-03-21 04:45:02,998 - INFO - Restoring parameters, Failed to find a closest match for: early
2025-03-21 04:45:03,052 - INFO - M_INSTANCE CALL: 1
2025-03-21 04:45:03,052 - INFO - SAMPLE: [[0.0 1.0
  39.0]]
2025-03-21 04:45:03,053 - INFO - LLM RUN: 1
2025-03-21 04:45:04,351 - ERROR - FAILED TO CHANGE SENSITIVE PARAMETER.
2025-03-21 04:45:05,053 - INFO - LLM RUN: 2
2025-03-21 04:45:06,351 - ERROR - The generated counterfactual didn't sufficiently change the sensitive attribute 'sex'.
2025-03-21 04:45:07,053 - INFO - Finished generating Counter Factual Successfully. Tries: 3
2025-03-21 04:45:08,052 - INFO - M_INSTANCE CALL: 2
2025-03-21 04:45:09,053 - ERROR - The counterfactual generated is missing required columns or has invalid formatting.
2025-03-21 04:45:09,054 - ERROR - Encoding the generated counterfactual failed due to an invalid format or value.
2025-03-21 04:45:09,055 - CRITICAL - FAILED TO GENERATE COUNTER FACTUAL, MAX RETRIES HIT
2025-03-21 04:45:10,052 - INFO - M_INSTANCE CALL: 3
"""


@pytest.mark.parametrize("split_bytes", [None, 160])
def test_log_summary_on_both_message_generations(spark, tmp_path, split_bytes):
    for run in ("1_runs", "2_runs"):
        (tmp_path / run).mkdir()
        (tmp_path / run / "logfile.log").write_text(LOG)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if split_bytes:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(split_bytes))
    try:
        blocks = lines.read_blocks(spark, str(tmp_path))
        assert (blocks.select("file", "block").distinct().count() > 2) == bool(split_bytes)
        rows = logs.log_summary(blocks).orderBy("file", "call").collect()
        numbered = lines.read_run_log(spark, str(tmp_path)).orderBy("file", "line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [r["line"] for r in numbered] == LOG.splitlines() * 2
    assert [r["line_no"] for r in numbered] == list(range(1, 15)) * 2
    assert len(rows) == 6
    for r in rows[:3], rows[3:]:
        first, second, third = r
        assert (first["call_id"], first["tries"], first["failed_sensitive"], first["total_errors"]) == (1, 3, 2, 2)
        assert (first["had_error"], first["succeeded"], first["failed_match"]) == (1, 1, 0)
        assert (second["tries"], second["failed_features"], second["failed_encoding"], second["critical"]) == (None, 1, 1, 1)
        assert (second["total_errors"], second["succeeded"]) == (3, 0)
        assert (third["total_errors"], third["had_error"], third["succeeded"]) == (0, 0, 0)


def test_report_and_found_set_round_trip(spark, tmp_path):
    found = spark.createDataFrame([("d", 0, "local", 1, 2.5), ("d", 1, "global", 2, 3.5)], "dataset STRING, trial INT, phase STRING, x INT, elapsed DOUBLE")
    tables.write_found_set(found, str(tmp_path / "found"))
    back = tables.read_found_set(spark, str(tmp_path / "found")).select(*found.columns)
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, found.collect()))
    tables.write_report(found, str(tmp_path / "report"))
    assert spark.read.csv(str(tmp_path / "report"), header=True).columns == found.columns


def test_size_checks_and_checkpoint(spark):
    df = spark.range(10)
    assert is_small(df, 10) and not is_small(df, 9)
    small = broadcast_if_small(df, 10)
    assert "broadcast" in df.join(small, "id")._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in df.join(broadcast_if_small(df, 5), "id")._jdf.queryExecution().logical().toString().lower()
    kept = cut_lineage(df.withColumn("x", F.col("id") * 2))
    assert "Range" not in kept._jdf.queryExecution().executedPlan().toString()
    assert checkpoint_root(spark) and kept.agg(F.sum("x")).first()[0] == 90


ODD_TEXTS = ['plain', 'brace } in text', '"quoted" and {"a": [1, 2}', 'back\\slash \\" end\\', ']}, {"role": "x"}', "", "line\nbreak\t}", "é日本 😀 }", "{" * 40, '"' * 31]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("extra", [{}, {"doc": "named }"}])
def test_one_document_is_read_by_many_tasks(spark, tmp_path, indent, extra):
    import random

    rng = random.Random(5)
    content = [rng.choice(ODD_TEXTS) * rng.randint(1, 30) for _ in range(300)]
    content[7:9] = [{"a": {"b": ["}", {"c": 1}]}}, [1, {"x": "]"}]]
    messages = [{"role": rng.choice(["user", "system"]), "content": c} for c in content]
    text = json.dumps({**extra, "messages": messages, "tools": [{"name": "t"}, {"name": "u"}]}, indent=indent, ensure_ascii=False)
    (tmp_path / "a.json").write_text(text + "\n")
    (tmp_path / "b.json").write_text(json.dumps({"messages": messages[:3]}))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700")
    try:
        got = chat.read_chat_json(spark, str(tmp_path), "blocks")
        rows = got.collect()
        splits = spark.read.option("lineSep", "}").text(str(tmp_path / "a.json")).rdd.getNumPartitions()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert splits > 20
    name = extra.get("doc")
    mine = sorted((r["pos"], r["role"], r["content"]) for r in rows if (r["doc"] == name if name else r["doc"].endswith("a.json")))
    assert [m[:2] for m in mine] == [(i, m["role"]) for i, m in enumerate(messages)]
    for (_, _, c), m in zip(mine, messages):
        assert c == m["content"] if isinstance(m["content"], str) else json.loads(c) == m["content"]
    assert sum(r["doc"].endswith("b.json") for r in rows) == 3


def test_a_request_is_carried_over_split_borders(spark, tmp_path):
    body, want, request = ["id,age,job"], [], None
    for i in range(600):
        if i % 150 == 0:
            request = f"attr{i}"
            body.append(f",CF {request},")
        body.append(f"{i},{20 + i % 50},job{i % 7}")
        want.append((str(i), request))
    (tmp_path / "a.csv").write_text("\n".join(body) + "\n")
    log = [f"M_INSTANCE CALL: {i // 40}" if i % 40 == 0 else "FAILED TO CHANGE SENSITIVE PARAMETER." for i in range(400)]
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "run.log").write_text("\n".join(log) + "\n")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "500")
    try:
        rows = lines.read_sectioned_csv(spark, str(tmp_path / "a.csv"), ["id", "age", "job"])
        blocks = lines.read_blocks(spark, str(tmp_path / "logs"))
        got = [(r["id"], r["request"]) for r in rows.orderBy("line_no").collect()]
        calls = logs.log_summary(blocks).orderBy("call").collect()
        splits = blocks.select("block").distinct().count()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == want and splits > 10
    assert [(r["call_id"], r["failed_sensitive"]) for r in calls] == [(i, 39) for i in range(10)]
