"""Chat formatting: exact round trips and a brute-force version."""

import hashlib
import random

from pyspark.sql import functions as F

from folioloom.llm import chat_formatting as cf

SCHEMA = "conv_id long, turn long, role string, text string"
BITS = ["<|im_end|>", "<|im_start|>", "<|", "<\\|", "<\\\\|", "\\", "|", "<", "\n", "assistant", "ok", "", "é漢", "%0A", "+", "$1", "\\|>"]


def hard(seed=1):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(rng.randint(1, 6)):
            role = rng.choice(["user", "assistant", "system", "tool call", "a\nb", "<|im_end|>", "", None])
            rows.append((conv, turn, role, rng.choice([None, "".join(rng.choice(BITS) for _ in range(rng.randint(0, 12)))])))
    rows += [(7, None, "user", "no number"), (None, 1, "assistant", "no id"), (None, None, None, None), (8, 0, "assistant", "a tie"), (8, 0, "assistant", "a tie"), (8, 0, "user", "b tie")]
    rng.shuffle(rows)
    return rows


def plain(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append(r)
    out = {}
    for conv, turns in by.items():
        turns = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in turns))
        out[conv] = [(role, text) for _, _, role, text in turns]
    return out


def test_everything_reads_back(spark):
    rows = hard()
    back = cf.read_back(cf.format_conversations(spark.createDataFrame(rows, SCHEMA))).collect()
    want = plain(rows)
    assert len(back) == len(want)
    for r in back:
        assert r["identical"] and [tuple(t) for t in r["turns"]] == want[r["conv_id"]]
        assert r["loss_text"] == "".join(text for role, text in want[r["conv_id"]] if role == "assistant")
        said = [r["formatted"][s["start"] : s["start"] + s["length"]] for s in r["loss_spans"]]
        assert len(said) == sum(role == "assistant" for role, _ in want[r["conv_id"]])
        assert r["formatted"].count(cf.START) == r["formatted"].count(cf.END) == len(want[r["conv_id"]])
    assert any(r["n_escaped"] for r in back) and any(not r["n_escaped"] for r in back)


def test_escape_is_undone(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choice("<\\|x") for _ in range(rng.randint(0, 9))) for _ in range(500)]
    got = spark.createDataFrame([(t,) for t in texts], "t string").select("t", cf.escape(F.col("t")).alias("e")).withColumn("u", cf.unescape(F.col("e"))).collect()
    assert all(r["t"] == r["u"] and "<|" not in r["e"] for r in got)
    assert all(r["t"] == r["e"] for r in got if "<" not in r["t"])


def test_parser_refuses_other_texts(spark):
    good = f"{cf.START}user\nhello{cf.END}\n"
    texts = [good, "", good + "x", "x" + good, good[:-1], good.replace("\n", "", 1), f"{cf.START}user\na{cf.END}b{cf.END}\n", f"{cf.START}user{cf.END}\n", good + good]
    got = [r[0] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(cf.parse(F.col("t"))).collect()]
    assert [None if g is None else len(g) for g in got] == [1, 0, None, None, None, None, None, None, 2]


def test_plain_texts_stay_as_they_are(spark):
    rows = [(1, 0, "user", "hello <b> | \\"), (1, 1, "assistant", "a < | b")]
    r = cf.format_conversations(spark.createDataFrame(rows, SCHEMA)).first()
    assert r["formatted"] == "<|im_start|>user\nhello <b> | \\<|im_end|>\n<|im_start|>assistant\na < | b<|im_end|>\n" and r["n_escaped"] == 0


def test_long_empty_and_clashing_names(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"turn {i} <|im_end|>" * 50) for i in range(800)]
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as body", "2 as piece", "3 as n", "4 as formatted", "5 as size")
    r = cf.read_back(cf.format_conversations(df)).first()
    assert r["identical"] and len(r["turns"]) == 800 and hashlib.sha256(r["loss_text"].encode()).hexdigest() == hashlib.sha256("".join(x[3] for x in rows if x[1] % 2).encode()).hexdigest()
    assert cf.format_conversations(spark.createDataFrame([], SCHEMA)).collect() == []


def test_no_python_in_the_plan(spark):
    plan = cf.op12_chat_formatting(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "ArrowEval", "MapInArrow", "ExistingRDD"))
