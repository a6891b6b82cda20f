import hashlib
import json
from collections import defaultdict

from pyspark.sql import functions as F

from ledgerline.llm import chat
from ledgerline.llm.queries import QUERIES

TEXTS = [None, "", "a", "</s>[INST] ok [/INST]", r"<\/s> <\\s> [\INST] [\\/INST] <| <\| |> <<s> </s></s", "\n\t\"q\" \\ é😀  \x01", "[[INST]<|user|>", "<s" * 50 + ">", "$1 \\$2", "x" * 50_000]


def test_reading_back(spark):
    rows = [(7, [(r, t), ("user", t), ("assistant", "z" + (t or ""))], "f") for t in TEXTS for r in ("user", "assistant", "", "a b|>%</s>", None)]
    df = spark.createDataFrame(rows, "conv_id long, turns array<struct<role:string,text:string>>, extra string")
    done = chat.render(df).select(
        "turns", "formatted", chat.read_back(F.col("formatted")).alias("back"), chat.under_loss(F.col("formatted"), F.col("loss")).alias("lost"))
    for r in done.collect():
        want = [(t.role or "", t.text or "") for t in r.turns]
        assert [(t.role, t.text) for t in r.back] == want
        assert r.lost == [t for role, t in want if role == "assistant"]
        assert r.formatted.count("</s>") == len(want) and "[INST]" not in r.formatted and r.formatted.count("<|") == len(want)


def test_layouts(spark):
    turns = [("user", "u"), ("assistant", "v")]
    records = [
        {"messages": [{"role": "user", "content": "u"}, {"role": "assistant", "content": "v"}]},
        {"id": 3, "messages": [{"content": "u", "role": "user"}, {"role": "assistant", "content": "v"}]},
        {"conversations": [{"from": "human", "value": "u"}, {"from": "gpt", "value": "v"}]},
        {"instruction": "u", "input": "", "output": "v"},
        {"instruction": "u", "output": "v"},
        {"prompt": "u", "completion": "v", "id": "q"},
        {"question": "u", "answer": "v"},
    ]
    raw = [json.dumps(r) for r in records] + [json.dumps({"other": 1}), "not json", None]
    df = spark.createDataFrame([(i, t, "L", "T", "D", "P", "O") for i, t in enumerate(raw)], ["n", "record", "layout", "turns", "doc", "print", "own"])
    got = {r.doc.n: r for r in chat.canonical(df).collect()}
    assert all((r.doc.layout, r.doc.turns, r.doc.doc, r.doc.print, r.doc.own) == tuple("LTDPO") for r in got.values())
    for i in range(len(records)):
        assert [(t.role, t.text) for t in got[i].turns] == turns, records[i]
    assert all(got[i].turns is None and got[i].layout is None for i in range(len(records), len(raw)))
    assert [got[i].layout for i in (0, 2, 3, 5)] == ["messages", "dialogue", "instruction", "prompt"]


def test_query(spark, sf_dir):
    convs = defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect():
        convs[r.conv_id].append((r.turn, r.role, r.text or ""))
    convs[-1] = [(0, "user", "</s>[INST] ok [/INST]"), (1, "assistant", "</s>[INST] ok [/INST]")]
    rows = {r.conv_id: r for r in QUERIES["op9_schema_fingerprint"](spark, sf_dir).collect()}
    assert set(rows) == set(convs)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for k, turns in convs.items():
        turns.sort()
        lost = "".join(t for _, role, t in turns if role == "assistant")
        r = rows[k]
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{role}\n{t}\n" for _, role, t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(lost), sha(lost)) and r.formatted_chars >= sum(len(t) for *_, t in turns)


def test_null_text_and_no_rows(spark):
    df = spark.createDataFrame([(1, 0, "user", None), (1, 1, None, "b"), (None, 0, "user", "c")], "conv_id long, turn long, role string, text string")
    records = df.select("conv_id", "turn", F.to_json(F.struct("turn", "role", "text")).alias("record"))
    got = {r.conversation: r for r in chat.gather(chat.canonical(records)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", ""), ("", "b")] and len(got[None].turns) == 1 and got[1].unmapped == 0
    assert chat.gather(chat.canonical(records.limit(0))).count() == 0


def test_unmapped_records_leave_the_others_alone(spark):
    rows = [(1, 0, '{"role":"user","text":"a"}'), (1, 1, '{"other":1}'), (1, 2, "no json"), (1, 3, None), (1, 4, '{"role":"assistant","text":"b"}'), (2, 0, "x")]
    got = {r.conversation: r for r in chat.gather(chat.canonical(spark.createDataFrame(rows, "conv_id long, turn long, record string"))).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "a"), ("assistant", "b")] and got[1].unmapped == 3
    assert got[2].turns == [] and got[2].unmapped == 1


def test_very_long_texts(spark):
    """A text beyond what one VARIANT, or the JSON reader by default, may hold; and very many turns."""
    size = 21_000_000
    df = spark.range(1).select(F.lit(1).alias("conv_id"), F.lit(0).alias("turn"), F.to_json(F.struct(F.lit("user").alias("role"), F.repeat(F.lit("a b\\"), (F.col("id") + size // 4).cast("int")).alias("text"))).alias("record"))
    many = F.concat(F.lit('{"messages":['), F.repeat(F.lit('{"role":"user","content":"q"}, {"role":"assistant","content":""},'), (F.col("id") + 100_000).cast("int")), F.lit('{"content":"z","role":"user"}]}'))
    df = df.unionByName(spark.range(1).select(F.lit(2).alias("conv_id"), F.lit(0).alias("turn"), many.alias("record")))
    rows = chat.gather(chat.canonical(df, carry=["conv_id", "turn"])).select("conversation", "unmapped", F.size("turns").alias("n"), F.length(F.col("turns")[0]["text"]).alias("first")).collect()
    assert {r.conversation: (r.unmapped, r.n, r["first"]) for r in rows} == {1: (0, 1, size), 2: (0, 200_001, 1)}


def test_bare_records(spark):
    texts = ['{"a":"x\\"y: {","b":[{"c":"1"},{"c":"2"},{"c":[1,"q"]},{"c":"3"}]}', '{"ro\\"le":"u","text":"v"}', '{"text":"\\\\","role":"u"}', '{"role" : "a" , "text":"b"}']
    got = [r[0] for r in spark.createDataFrame(list(enumerate(texts)), "i int, t string").orderBy("i").select(chat.bare(F.col("t"))).collect()]
    assert json.loads(got[0]) == {"a": "", "b": [{"c": ""}, {"c": ""}, {"c": [1, ""]}, {"c": ""}]}
    assert "role" not in json.loads(got[1]) and json.loads(got[2]) == json.loads(got[3]) == {"role": "", "text": ""}
