"""Small hand-made rows for what the tables do not hold."""

import json

import pytest
from pyspark.sql import functions as F

from loomspark.functions import lossmask, metrics, policy, prompts, render, tokens, tools
from loomspark.operators import combine, expand, filters, normalize, packing, recipes, sampling
from loomspark.sources import catalog, sinks


def contents(df, *more):
    return [[(m["role"], m["content"]) for m in r["messages"]] for r in df.collect()]


def test_source_strings():
    s = catalog.Source.parse("hf::a/b:x/y#100")
    assert (s.hub, s.name, s.subsets, s.count) == ("hf", "a/b", ("x", "y"), 100)
    assert str(s) == "hf::a/b:x/y#100"
    assert catalog.Source.parse("/data/a#b.jsonl", lambda p: p == "/data/a#b.jsonl").name == "/data/a#b.jsonl"
    assert catalog.Source.parse("zz::a").hub is None


def test_catalog_and_subsets():
    c = catalog.Catalog()
    c.register_json('[{"name": "x/one", "path": "a.csv", "subsets": ["default", {"name": "noisy", "weak": true}]}, "x/two"]', "/base")
    assert c.find("one").path == "/base/a.csv" and c.find("x/two").name == "x/two" and c.find("three") is None
    with pytest.raises(ValueError):
        c.register(catalog.Entry("x/one"))
    e = c.find("one")
    assert [s.name for s in catalog.chosen_subsets(e, ())] == ["default"]
    assert [s.name for s in catalog.chosen_subsets(e, ("all",))] == ["default"]
    assert [s.name for s in catalog.chosen_subsets(e, ("noisy", "new"))] == ["noisy", "new"]


def test_file_formats(spark, tmp_path):
    (tmp_path / "a.csv").write_text("instruction,input,output\nadd,,3.3\n\"say \"\"x\"\"\",1,b\n")
    (tmp_path / "a.jsonl").write_text('{"query": "q", "response": "r", "system": "s", "history": [["a", "b"]]}\n{"query": "q2", "response": null}\n')
    (tmp_path / "a.json").write_text('[{"messages": [{"role": "user", "content": "x"}, {"role": "assistant", "content": "y"}]}]')
    (tmp_path / "a.txt").write_text("one\ntwo\n")
    csv = catalog.read_file(spark, str(tmp_path / "a.csv"))
    assert csv.where("input = ''").count() == 1
    assert contents(normalize.normalize(csv)) == [[("user", "add"), ("assistant", "3.3")], [("user", 'say "x"\n1'), ("assistant", "b")]]
    got = contents(normalize.normalize(catalog.read_file(spark, str(tmp_path / "a.jsonl"))))
    assert got == [[("system", "s"), ("user", "a"), ("assistant", "b"), ("user", "q"), ("assistant", "r")], [("user", "q2")]]
    assert contents(normalize.normalize(catalog.read_file(spark, str(tmp_path / "a.json"), array=True))) == [[("user", "x"), ("assistant", "y")]]
    assert contents(normalize.normalize(catalog.read_file(spark, str(tmp_path / "a.txt")))) == [[("assistant", "one")], [("assistant", "two")]]
    c = catalog.Catalog()
    c.register(catalog.Entry("t", str(tmp_path / "a.csv")))
    assert catalog.load_one(spark, "t#1", c).count() == 1


def test_messages_layouts(spark):
    rows = [([{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}, {"from": "function-call", "value": "{}"}, {"from": "observations", "value": "o"}], "sys")]
    df = spark.createDataFrame(rows, "conversations array<struct<from:string,value:string>>, system string")
    assert contents(normalize.normalize(df)) == [[("system", "sys"), ("user", "a"), ("assistant", "b"), ("tool_call", "{}"), ("tool_response", "o")]]
    df = spark.createDataFrame([('[{"role": "user", "content": "x"}]',), ("nothing",)], "messages string")
    assert contents(normalize.normalize(df)) == [[("user", "x")]]
    df = spark.createDataFrame([("[['q1', 'r1']]", "q", "r")], "history string, query string, response string")
    assert contents(normalize.normalize(df)) == [[("user", "q1"), ("assistant", "r1"), ("user", "q"), ("assistant", "r")]]
    df = spark.createDataFrame([("q", ["first", "second"])], "query string, response array<string>")
    assert contents(normalize.normalize(df)) == [[("user", "q"), ("assistant", "first")]]


def test_safe_rename_keeps_colliding_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Question int, prompt int, SYSTEM_PROMPT int")
    assert normalize.safe_rename(df, {"question": "query", "prompt": "query", "system_prompt": "system"}).columns == ["Question", "prompt", "system"]


def test_bad_rows(spark):
    rows = [([("user", "a", None)], "no"), ([("robot", "a", None)], "no"), ([], "no"), ([("user", None, None)], "no"), ([("user", "a", None), ("assistant", "same", None)], "same"), (None, "x")]
    df = spark.createDataFrame(rows, "messages array<struct<role:string,content:string,loss:double>>, rejected_response string")
    assert filters.drop_bad(df).count() == 1
    with pytest.raises(Exception, match="invalid messages"):
        filters.drop_bad(df, strict=True).collect()


def test_media_and_objects(spark):
    df = spark.createDataFrame([("q", "r", "a.png", "v.mp4")], "query string, response string, image string, video string")
    r = normalize.normalize(df).first()
    assert r["images"][0]["path"] == "a.png" and r["videos"] == ["v.mp4"]
    parts = spark.createDataFrame([([("text", "see ", None), ("image_url", None, "u")],)], "p array<struct<type:string,text:string,url:string>>")
    text, urls = normalize.parts_text(F.col("p"))
    assert tuple(parts.select(text, urls).first()) == ("see <image>", ["u"])


def test_preference_bundle(spark):
    df = spark.createDataFrame([("q", "r", "bad", None)], "query string, response string, rejected_response string, tools string")
    got = normalize.normalize(df)
    r = got.withColumn("rejected_messages", normalize.rejected_from_response(F.col("messages"), F.col("rejected_response")))
    b = normalize.preference_bundle(r).first()
    assert b["rejected"]["messages"][-1]["content"] == "bad" and b["chosen"]["messages"][-1]["content"] == "r"


def test_render_rounds(spark):
    rows = [([("system", "S"), ("user", "a"), ("assistant", "b"), ("tool", "t1"), ("tool", "t2"), ("assistant", "c"), ("user", "d")],)]
    df = spark.createDataFrame(rows, "m array<struct<role:string,content:string>>")
    text = df.select(render.rendered(F.col("m"))).first()[0]
    assert text == "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\na<|im_end|>\n<|im_start|>assistant\nbt1\nt2c<|im_end|>\n<|im_start|>user\nd<|im_end|>\n<|im_start|>assistant\n"
    calls = spark.createDataFrame([([("user", "q"), ("tool_call", "1"), ("tool_call", "2"), ("tool_response", "r")],)], "m array<struct<role:string,content:string>>")
    assert [tuple(x) for x in calls.select(render.merged_calls(F.col("m"))).first()[0]] == [("user", "q"), ("assistant", "1\n2"), ("tool", "r")]
    with pytest.raises(ValueError):
        render.Template("x", "no query")


def test_token_arrays(spark):
    df = spark.createDataFrame([([1, 9, 2, 3, 9, 4, 5], [1, -100, -100, 3, -100, -100, 5])], "t array<int>, l array<int>")
    r = df.select(
        tokens.truncated(F.col("t"), F.col("t"), 4, "right", [9]).alias("right"), tokens.truncated(F.col("t"), F.col("t"), 4, "left", [9]).alias("left"), tokens.expanded(F.col("t"), 9, [7, 7]).alias("wide"),
        tokens.split_on(F.col("t"), 9).alias("at"), tokens.find_all(F.col("t"), [9, 4]).alias("found"), tokens.without_stop(F.col("t"), [4, 5]).alias("cut"), tokens.open_suffix(F.col("l"), F.col("t"), [9, 2]).alias("open"),
    ).first()
    assert r["right"] == [1, 9, 2, 9] and r["left"] == [9, 9, 4, 5] and r["wide"] == [1, 7, 7, 2, 3, 7, 7, 4, 5]
    assert r["at"] == [1, 4] and r["found"] == [4] and r["cut"] == [1, 9, 2, 3, 9] and r["open"] == [1, 9, 2, 3, -100, -100, 5]
    rows, mask = tokens.unpacked(F.col("t"), F.array(F.lit(3), F.lit(4)), 5, F.lit(0))
    assert df.select(rows, mask).first()[0] == [[0, 0, 1, 9, 2], [0, 3, 9, 4, 5]]


def test_loss_weights(spark):
    df = spark.createDataFrame([("<think>\n\n</think>\nhi", "What is the value of x")], "r string, q string")
    w = [tuple(x) for x in df.select(lossmask.weighted(F.col("r"), "ignore_empty_think")).first()[0]]
    assert w == [("<think>\n\n</think>\n", 0.0), ("hi", 1.0)]
    q = [tuple(x) for x in df.select(lossmask.weighted(F.col("r"), "agentflan", F.col("q"))).first()[0]]
    assert q == [("<think>\n\n</think>\nhi", 3.0)]
    assert lossmask.parse_spec("last_round+hermes") == ("last_round", "hermes") and lossmask.parse_spec("all") == ("all", None)
    assert lossmask.is_binary("ignore_empty_think") and not lossmask.is_binary("react")


def test_tool_fallback_and_formatting(spark):
    df = spark.createDataFrame([("Action: f\nAction Input: {}\nObservation:",)], "t string")
    assert [tuple(c) for c in df.select(tools.tool_calls(F.col("t"), "hermes")).first()[0]] == [(" f\n", " {}\n")]
    qwen = spark.createDataFrame([("✿FUNCTION✿: f\n✿ARGS✿: {}\n✿RESULT✿",)], "t string")
    assert len(qwen.select(tools.tool_calls(F.col("t"), "qwen")).first()[0]) == 1
    text = df.select(tools.react_calls(F.array(F.lit("f")), F.array(F.lit("{}"))), tools.hermes_replies(F.array(F.lit("a"))), tools.described_tool(F.lit('{"name": "f", "description": "d"}')), tools.wrapped_tool(F.lit('{"name": "f"}'))).first()
    assert text[0] == "Action: f\nAction Input: {}\nObservation:" and text[1] == "<tool_response>\na\n</tool_response>" and text[2] == "f: d"
    assert json.loads(text[3])["type"] == "function"


def test_recipes(spark):
    one = lambda rows, schema: spark.createDataFrame(rows, schema)
    assert contents(recipes.titled_jokes(one([("12. joke", "more"), ("x", None)], "title string, abs string"))) == [[("assistant", " joke，more")], [("assistant", "x")]]
    assert contents(recipes.question_generation(one([("ans[SEP]ctx", "q?"), ("bad", "z")], "text1 string, text2 string")))[0][0][1].endswith("Answer: ans\nQuestion:")
    g = recipes.marked_history(one([("User:a Assistant:b", "User: c", "d"), ("User:a", "x", "y"), ("", "c", "d")], "instruction string, input string, output string"))
    assert contents(g) == [[("user", "a "), ("assistant", "b"), ("user", "c"), ("assistant", "d")], [("user", "c"), ("assistant", "d")]]
    x = recipes.json_tool_calls(one([("q", '[{"name": "f", "arguments": {"a": 1}}]', "[]")], "query string, answers string, tools string"))
    assert contents(x)[0][1][0] == "tool_call"
    h = recipes.human_or_model(one([("q", ["h"], ["c"])], "question string, human_answers array<string>, chatgpt_answers array<string>"))
    assert [m[1][1] for m in contents(h)] == ["Human", "ChatGPT"]
    law = recipes.law_chapters(one([("law", "t", "c1", None, "c3", "text")], "type string, title string, chapter1 string, chapter2 string, chapter3 string, response string"))
    assert contents(law) == [[("assistant", "law\nt\nc1c3text")]]
    code = recipes.code_answer(one([("# ask\n```python\nx\n```\n", "why"), ("no code", "z")], "code_with_problem string, explanation_only string"))
    assert contents(code) == [[("user", "ask\n"), ("assistant", "```python\nx\n```\n\nwhy")]]
    r = recipes.repaired_messages(one([("[{'from': 'user', 'value': 'a'} {'from': 'assistant', 'value': 'b'}]",), ("broken",)], "conversations string"))
    assert contents(r) == [[("user", "a"), ("assistant", "b")]]
    s = recipes.self_cognition(one([("I am {{NAME}}", "by {{AUTHOR}}", "zh")], "query string, response string, tag string"), ("甲", "A"), ("乙", "B"))
    assert contents(s) == [[("user", "I am 甲"), ("assistant", "by 乙")]]
    o = recipes.lettered_options(one([("q", ["a", "b"], "b")], "question string, options array<string>, answer string"))
    assert contents(o) == [[("user", "q\nA. a\nB. b"), ("assistant", "B")]]
    p = recipes.grounded_phrases(one([("a dog and cat", [(2, 5, [0.0]), (10, 13, [1.0])]), ("ab", [(0, 2, [0.0]), (1, 2, [1.0])])], "caption string, spans array<struct<start:int,end:int,box:array<double>>>"))
    assert contents(p)[0][1][1] == "a <ref-object><bbox> and <ref-object><bbox>" and p.count() == 1 and p.first()["objects"]["ref"] == ["dog", "cat"]
    n = recipes.sampled_negatives(one([(i, [f"a{i}"]) for i in range(20)], "k int, answers array<string>"), "k", "answers").collect()
    assert all(len(r["negatives"]) == 7 and not set(r["negatives"]) & set(r["answers"]) for r in n)


def test_sampling_edges(spark):
    df = spark.createDataFrame([(i,) for i in range(10)], "id int")
    assert sampling.sample(df, 0, "id").count() == 0 and sampling.sample(df, 25, "id").count() == 25
    assert sampling.split(df, 0, "id").where("part = 'val'").count() == 0 and sampling.split(df, 1, "id").where("part = 'val'").count() == 10
    with pytest.raises(ValueError):
        sampling.split(df, 1, "id", n=11)
    got = sampling.split(df, 0.01, "id", n=30).groupBy("part").count().collect()
    assert {r["part"]: r["count"] for r in got} == {"train": 29, "val": 1}
    assert [sampling.shard(df, "id", 3, i).count() for i in range(3)] == [3, 3, 4]
    bad = spark.createDataFrame([(i,) for i in range(100, 104)], "id int")
    assert sampling.topped_up(df, bad, F.col("id") % 2 == 0, "id", 7).count() == 7
    with pytest.raises(ValueError):
        sampling.topped_up(df, bad, F.col("id") % 2 == 0, "id", 8)
    assert filters.redraw(df, F.col("id") > 3, "id").count() == 10


def test_packing(spark):
    assert packing.best_fit([(1, 5), (2, 4), (3, 3), (4, 9)], 8) == [[(4, 9)], [(1, 5), (3, 3)], [(2, 4)]]
    df = spark.createDataFrame([(i, (i * 37) % 50 + 1) for i in range(300)], "id long, n long")
    for p in (packing.pack(df, "id", "n", 64, chunk=100), packing.pack_in_order(df, "id", "n", 64, chunk=100)):
        rows = p.collect()
        assert sorted(x for r in rows for x in r["members"]) == list(range(300)) and all(r["total"] <= 64 for r in rows)
    ids = df.limit(4).select("id", F.array_repeat(F.lit(1), 3).alias("ids"), F.array_repeat(F.lit(2), 3).alias("labels"))
    packs = packing.pack(ids.withColumn("n", F.lit(3).cast("long")), "id", "n", 6)
    m = packing.materialised_pack(packs, ids, "id", "ids", "labels").collect()
    assert all(r["position_ids"] == [0, 1, 2, 0, 1, 2] and len(r["labels"]) == 6 for r in m)


def test_overlap_and_rouge(spark):
    df = spark.createDataFrame([("the cat sat on mat".split(), "the cat on the mat".split())], "a array<string>, b array<string>")
    r = df.select(metrics.rouge_l(F.col("a"), F.col("b")), metrics.rouge_n(F.col("a"), F.col("b"), 1), metrics.bleu(F.col("a"), F.col("a"))).first()
    assert abs(r[0] - 0.8) < 1e-9 and abs(r[1] - 2 * 4 / 9) < 1e-9 and abs(r[2] - 1) < 1e-9


def test_importance_weights(spark):
    df = spark.createDataFrame([([0.5, 1.5, 3.0, 5.0], [1, 1, 1, 1])], "r array<double>, m array<int>")
    logs = F.transform("r", F.ln)
    t, m = df.select(policy.rollout_weights(logs, F.col("m"), "token_truncate"), policy.rollout_weights(logs, F.col("m"), "token_mask")).first()
    assert [round(x, 9) for x in t] == [0.5, 1.5, 2, 2] and [round(x, 9) for x in m] == [0.5, 1.5, 0, 0]


def test_resumable_batches(spark, tmp_path):
    df = spark.createDataFrame([(i, i // 4) for i in range(12)], "id int, batch int")
    path = str(tmp_path / "out")
    assert sinks.write_batches(df.where("batch < 2"), path, "batch") == [0, 1]
    assert sinks.write_batches(df, path, "batch") == [2]
    assert spark.read.parquet(path).count() == 12
    sinks.write_shards(df, str(tmp_path / "s"), 5, "id")
    assert sinks.lookup(spark, str(tmp_path / "s"), "id", [3, 7]).count() == 2
    sinks.write_jsonl(df.limit(2), str(tmp_path / "j"))
    sinks.write_jsonl(df.limit(2), str(tmp_path / "j"), append=True)
    assert catalog.read_jsonl(spark, str(tmp_path / "j")).count() == 4


def test_expand_and_combine(spark):
    df = spark.createDataFrame([(1, [1, 2, 3]), (2, [])], "id int, t array<int>")
    assert [r["t"] for r in expand.chunks(df, "t", 2).orderBy("id", "chunk").collect()] == [[1, 2], [3]]
    assert combine.concat([]) is None and combine.concat([df, df]).count() == 4
    assert expand.fan_out(df, F.transform("t", lambda x: F.struct(x.alias("v")))).count() == 3
    assert expand.repeated(df, 3).count() == 6 and sampling.epochs(df, 2).count() == 4


def test_stream_packer_and_take(spark, tmp_path):
    from loomspark.streaming import streams

    src = str(tmp_path / "in")
    spark.range(0, 40).selectExpr("id", "id % 9 + 1 as n").repartition(4).write.parquet(src)
    parts = []
    source = streams.read(spark, src, "id long, n long", files=1).withColumn("shard", F.col("id") % 2)
    checkpoint = str(tmp_path / "checkpoint")
    out = streams.run(streams.packed(source, "shard", "id", "n", 12), str(tmp_path / "rows"), checkpoint)
    bins = [list(zip(r["members"], r["lengths"], strict=True)) for r in out.unionByName(streams.packed_rest(spark, checkpoint)).collect()]
    assert sorted(i for b in bins for i, _ in b) == list(range(40)) and all(sum(n for _, n in b) <= 12 for b in bins)
    streams.each(streams.read(spark, src, "id long, n long", files=1), streams.Take(15, 5, "id", lambda df: parts.extend(df.collect())))
    assert len(parts) == 15 and sum(r["part"] == "val" for r in parts) == 5


def test_user_code(spark, tmp_path):
    from loomspark.functions import extend

    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c")], "id long, t string")
    fn = lambda r: None if r["id"] == 1 else [r, r] if r["id"] == 2 else 1 / 0
    assert [r["id"] for r in extend.row_transform(df, fn, "id long, t string").collect()] == [2, 2]
    (tmp_path / "mine.py").write_text("from loomspark.functions.extend import reward\n@reward('size')\ndef size(completions, id=None):\n    return [len(c) + i if i < 3 else None for c, i in zip(completions, id)]\n@reward('late')\nasync def late(completions, id=None):\n    return [0.5] * len(completions)\n")
    extend.load_file(str(tmp_path / "mine.py"))
    plus = extend.REWARDS["size"]
    assert plus(["ab"], id=[1]) == [3]
    extend.REWARDS["len"] = lambda completions, id=None: [float(len(c)) if i < 3 else None for c, i in zip(completions, id, strict=True)]
    got = extend.scored(df, ["len"], "t", ("id",)).orderBy("id").collect()
    assert [r["len"] for r in got] == [1.0, 1.0, None]
    assert extend.Mean("id").over(df) == 2.0 and extend.Mean("id", -1.0).over(df.limit(0)) == -1.0


def test_task_encoding(spark):
    from loomspark.functions import encode

    rows = [([("user", "q one", None), ("assistant", "a b c", None)], [[("user", "p")]], [[("user", "n1")], [("user", "n2")]])]
    df = spark.createDataFrame(rows, "messages array<struct<role:string,content:string,loss:double>>, positive_messages array<array<struct<role:string,content:string>>>, negative_messages array<array<struct<role:string,content:string>>>")
    assert encode.task_rows(df, "reranker").count() == 3
    e = encode.task_rows(df, "embedding").first()
    assert e["anchor_length"] > 0 and e["positive_length"] > 0 and len(e["negatives"]) == 2
    k = encode.task_rows(df.withColumn("kl_messages", F.col("messages")), "kto").first()
    assert k["kl_input_ids"] == k["completion_input_ids"]
    one = encode.task_rows(df, "causal_lm")
    assert encode.fitted(one, 3, "raise").count() == 0 and encode.fitted(one, 3, "left").first()["length"] == 3
    s = encode.sampled_documents(df.withColumn("id", F.lit(1)), "id", 1).first()
    assert len(s["positive_messages"]) == 1 and len(s["negative_messages"]) == 1
    a = encode.attached(df).first()
    assert [m["role"] for m in a["positive_messages"][0]] == ["user", "assistant", "user"]
    t = df.select(encode.with_token_answers(F.col("messages"), F.array(F.array(F.lit(1), F.lit(2)))).alias("m")).first()["m"]
    assert t[0]["ids"] is None and t[1]["ids"] == [1, 2]
    with pytest.raises(ValueError):
        encode.task_rows(df, "nothing")


def test_own_catalog_and_prompts(spark):
    from .compare import DATA

    c = catalog.register_tables(DATA, catalog.Catalog())
    assert catalog.load_one(spark, "tables/conversations", c).count() > 0
    train, val = catalog.load(spark, ["tables/documents#50"], 0.1, "doc_id", c)
    assert train.count() + val.count() == 50 and val.count() == 5 and "channel" in train.columns
    assert catalog.load(spark, [], catalog=c) == (None, None)
    e = catalog.configured(c, "benchmark", recipes.query_response, query="text", response="text")
    assert contents(e.transform(spark.createDataFrame([("x",)], "text string"))) == [[("user", "x"), ("assistant", "x")]]
    df = spark.range(400)
    p = {"grounding": {"en": ["e1", "e2"], "zh": ["z"]}}
    got = [r[0] for r in df.select(normalize.grounding_prompt("grounding", p, "id")).collect()]
    assert 0.7 < sum(g != "z" for g in got) / 400 < 0.9 and len(set(got)) == 3
    call = spark.createDataFrame([('{"a": "1"}',)], "a string").select(tools.coder_calls(F.array(F.lit("f")), F.array("a")).alias("t"))
    assert [tuple(x) for x in call.select(tools.tool_calls(F.col("t"), "qwen_coder")).first()[0]] == [("f", '{"a":"1"}')]


def test_ranks_over_many_ranges(spark):
    values = [float(i * 7919 % 3001) for i in range(5000)] + [float("inf"), float("-inf"), None, float("nan"), -0.5, -0.5]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, v double")
    got = {r["id"]: r["k"] for r in metrics.average_rank(df, "v", "k").collect()}
    fine = {i: v for i, v in enumerate(values) if v is not None and v == v}
    places: dict = {}
    for at, v in enumerate(sorted(fine.values()), 1):
        places.setdefault(v, []).append(at)
    assert got == {i: sum(places[v]) / len(places[v]) for i, v in fine.items()}
    assert metrics.average_rank(df.limit(0), "v", "k").count() == 0


def test_dense_ids_of_ties_and_nulls(spark):
    df = spark.createDataFrame([(5, "b"), (5, "a"), (1, None), (9, "c"), (2, "c")], "at long, v string")
    got = {(r["at"], r["v"]): r["group_id"] for r in combine.dense_ids(df, "v", "at").collect()}
    assert got == {(1, None): 0, (2, "c"): 1, (9, "c"): 1, (5, "a"): 2, (5, "b"): 3}
    assert combine.dense_ids(df.limit(0), "v", "at").count() == 0


def test_infonce_terms(spark):
    import numpy as np

    rng = np.random.default_rng(5)
    q, d = rng.normal(size=(2, 6, 4))
    q, d = q / np.linalg.norm(q, axis=1, keepdims=True), d / np.linalg.norm(d, axis=1, keepdims=True)
    df = spark.createDataFrame([(0, i, a.tolist(), b.tolist()) for i, (a, b) in enumerate(zip(q, d, strict=True))], "b int, k long, q array<double>, d array<double>")
    own = np.eye(6, dtype=bool)
    qd, qq, dd = q @ d.T, np.where(own, -np.inf, q @ q.T), np.where(own, -np.inf, d @ d.T)
    most = np.diag(qd)[:, None] + 0.1
    for margin, parts in ((None, [qd, qq, dd]), (0.1, [np.where(qd > most, -np.inf, qd), np.where(qq > most, -np.inf, qq), dd])):
        want = np.log(np.exp(np.concatenate(parts, 1) / 0.1).sum(1)) - np.diag(qd) / 0.1
        loss = metrics.infonce_loss(F.col("qd"), F.col("place"), 0.1, margin, F.col("qq"), F.col("place"), F.col("dd"))
        got = metrics.in_batches(df, "b", "q", "d", "k").select("k", loss.alias("loss")).orderBy("k").collect()
        assert np.allclose([r["loss"] for r in got], want)


def test_tool_prompts_of_odd_descriptions(spark):
    wrapped = {"type": "function", "function": {"name": "f", "description": 'say "a, b: c"', "parameters": {"k": ["x:y", 1.5, None], "中": {}}}}
    plain = {"name": "g", "name_for_model": "m", "name_for_human": "G", "description_for_model": "d", "parameters": "a: b,c"}
    none = {"name": "n", "parameters": {}}
    texts = [json.dumps(t, indent=1) for t in (wrapped, plain, none)]
    t = F.array(*map(F.lit, texts))
    dump = lambda x: json.dumps(x, ensure_ascii=False)
    row = spark.range(1).select(prompts.react_prompt(t).alias("react"), prompts.hermes_prompt(t, F.lit(None).cast("string")).alias("hermes"), prompts.toolbench_prompt(t).alias("bench"), prompts.youtu_prompt(t, F.lit("")).alias("youtu"), prompts.qwen_prompt(t, F.lit("S"), lang="zh").alias("qwen")).first()
    inner = wrapped["function"]
    assert f'What is the f API useful for? {inner["description"]} Parameters: {dump(inner["parameters"])} Format' in row["react"]
    assert "m: Call this tool to interact with the G API. What is the G API useful for? d Parameters: a: b,c Format" in row["react"]
    assert "useful for? None Parameters: {} Format" in row["react"] and "one of [f,m,n]\n" in row["react"]
    shown = [dump(wrapped), *(dump({"type": "function", "function": x}) for x in (plain, none))]
    assert row["hermes"].startswith("\n\n# Tools") and "<tools>\n" + "\n".join(shown) + "\n</tools>" in row["hermes"]
    assert row["bench"].endswith("APIs: " + dump([inner, plain, none]))
    assert row["youtu"].startswith("<|begin_of_tool_description|>") and "\n".join(f"```json\n{x}\n```" for x in shown) in row["youtu"]
    assert row["qwen"].startswith("S\n\n# 工具\n\n") and "### G\n\nm: d 输入参数：a: b,c 此工具的输入应为JSON对象。" in row["qwen"]
