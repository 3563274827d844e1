"""Chat formatting: layouts by fingerprint, a reversible template, digests against plain ones."""

import hashlib
import random
from collections import defaultdict

import duckdb
import pytest
from fragweave.llm import chat
from fragweave.llm.common import read
from pyspark.sql import functions as F

CONTROLS = chat.CHAT.controls


def plain_escape(text):
    out, k = "", 0
    while k < len(text):
        for c in CONTROLS:
            run = len(text[k + 1 :]) - len(text[k + 1 :].lstrip("\\")) if text[k] == c[0] else 0
            if text[k] == c[0] and text[k + 1 + run :].startswith(c[1:]):
                out += c[0] + "\\"
                break
        else:
            out += text[k]
        k += 1
    return out


def test_the_template_is_reversible(spark):
    rng = random.Random(4)
    bits = [*CONTROLS, *[c[:3] for c in CONTROLS], *[c[0] + "\\" + c[1:] for c in CONTROLS], *[c[0] + "\\\\" + c[1:] for c in CONTROLS], "\\", "<", "[", "é", "😀", "\n", "a b"]
    texts = ["", *bits, *["".join(rng.choice(bits) for _ in range(rng.randrange(1, 9))) for _ in range(1500)]]
    table = spark.createDataFrame([(t,) for t in texts], "t string")
    got = table.select("t", chat.CHAT.escaped(F.col("t")).alias("e")).withColumn("back", chat.CHAT.restored(F.col("e"))).collect()
    for t, e, back in got:
        assert back == t and e == plain_escape(t) and not any(c in e for c in CONTROLS)
    assert sum(r["e"] != r["t"] for r in got) > 1000


def test_overlapping_controls_are_an_error():
    for bad in ("|im", ">>", "\\x", "<"):
        with pytest.raises(ValueError):
            chat.Template(others=(bad,))


def digests(turns):
    """turns: (role, text) in order."""
    told = "".join(f"{r}\n{t}\n" for r, t in turns)
    loss = "".join(t for r, t in turns if r == "assistant")
    chars = sum(len(plain_escape(r)) + len(plain_escape(t)) + len("<|im_start|><|im_sep|><|im_end|>") for r, t in turns)
    return len(turns), hashlib.sha256(told.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest(), chars


def test_equals_plain_and_sql(spark, sf):
    rows = [tuple(r) for r in read(spark, sf, "conversations").collect()]
    rows += [(900, 0, "user", None), (900, 1, "assistant", "<s>\\<\\s>[/INST]"), (900, 1, None, "no role"), (None, 2, "assistant", "two"), (None, 1, "a<|im_sep|>\n", "<<SYS>>"), (901, 3, "user", ""), (901, None, "assistant", "last")]
    rows += [(902, 0, "assistant", "again")] * 5 + [(903, k, "assistant" if k % 2 else "user", f"turn {k} é") for k in range(600)] + [(904, 0, "assistant", "😀 words " * 60_000)]
    table = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "conv_id long, turn long, role string, text string, loss string, run int, h int").repartition(5)
    of = defaultdict(list)
    for c, t, r, x in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        of[c].append((t is None, t or 0, r or "", x or ""))
    want = {c: digests([t[2:] for t in sorted(own)]) for c, own in of.items()}
    got = [tuple(r) for r in chat.query(spark, table).collect()]
    assert {r[0]: r[1:] for r in got} == want and len(got) == len(want)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{sf}/conversations.parquet'")
    assert sorted(map(tuple, chat.query(spark, read(spark, sf, "conversations")).collect())) == sorted(con.execute(chat.digest_sql("conversations")).fetchall())


def test_the_mask_covers_assistants_alone(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "<s>"), (1, 2, "assistant", "[INST]!"), (1, 3, "assistant", "")]
    out = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).first()
    pieces = out["formatted"].split("<|im_end|>")[:-1]
    assert [(m["turn"], pieces[m["turn"]][m["start"] : m["start"] + m["length"]]) for m in out["loss"]] == [(2, "[\\INST]!"), (3, "")]


RECORDS = [
    ('{"prompt": "p", "response": "r", "id": 4, "meta": {"prompt": 1}}', "prompt_response", [("user", "p"), ("assistant", "r")]),
    ('{"prompt": "p", "completion": "c", "system": "s"}', "prompt_completion", [("system", "s"), ("user", "p"), ("assistant", "c")]),
    ('{"instruction": "i", "input": "n", "output": "o"}', "instruction", [("user", "i\n\nn"), ("assistant", "o")]),
    ('{"instruction": "i", "input": null, "output": "o"}', "instruction", [("user", "i"), ("assistant", "o")]),
    ('{"question": "q", "context": "c", "answer": "a"}', "question", [("user", "c\n\nq"), ("assistant", "a")]),
    ('{"messages": [{"role": "user", "content": "h"}, {"content": "no role", "tool": 1}, null]}', "messages", [("user", "h"), ("", "no role")]),
    ('{"conversations": [{"from": "human", "value": "h"}, {"from": "gpt", "value": "g"}, {"from": "x", "value": "y"}]}', "conversations", [("user", "h"), ("assistant", "g"), ("x", "y")]),
    ('{"system": "s", "messages": [{"role": "assistant", "content": ""}]}', "messages", [("system", "s"), ("assistant", "")]),
    ('{"prompt": "p", "response": "r", "output": "two layouts"}', None, None),
    ('{"messages": []}', None, None),
    ("{}", None, None),
    ("no json", None, None),
    (None, None, None),
]


def test_layouts_of_records(spark):
    table = spark.createDataFrame([(k, r[0], "x", "y") for k, r in enumerate(RECORDS)], "id long, record string, layout string, turns string")
    got = {r["conv_id"]: r for r in chat.records(table, "id", "record").collect()}
    for k, (_, layout, turns) in enumerate(RECORDS):
        assert got[k]["layout"] == layout and (got[k]["turns"] is None) == (turns is None)
        assert turns is None or [tuple(t) for t in got[k]["turns"]] == turns
    assert got[0]["fingerprint"] == chat.fingerprint(["response", "prompt"]) != got[1]["fingerprint"]
    flat = [tuple(r) for r in chat.canonical(table, "id", "record").orderBy("conv_id", "turn").collect()]
    assert flat == [(k, n, *t) for k, r in enumerate(RECORDS) for n, t in enumerate(r[2] or [])]


def test_layouts_of_tables(spark):
    table = spark.createDataFrame([(1, "i", None, "o")], "id long, instruction string, input string, output string")
    assert [tuple(r) for r in chat.canonical(table, "id").collect()] == [(1, 0, "user", "i"), (1, 1, "assistant", "o")]
    table = spark.createDataFrame([(1, [("user", "a"), ("assistant", None)])], "id long, messages array<struct<role: string, content: string>>")
    assert [tuple(r) for r in chat.canonical(table, "id").collect()] == [(1, 0, "user", "a"), (1, 1, "assistant", "")]
    with pytest.raises(ValueError, match="layout"):
        chat.canonical(spark.createDataFrame([(1, "x")], "id long, body string"), "id")


def test_registry_refuses_two_layouts_of_the_same_paths():
    with pytest.raises(ValueError, match="same paths"):
        chat.registry([chat.Layout("a", ("x", "y")), chat.Layout("b", ("x",), ("y",))])


def test_native_and_empty(spark, sf):
    conv = read(spark, sf, "conversations")
    plan = chat.formatted(chat.canonical(conv, "conv_id"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert [r["conv_id"] for r in chat.query(spark, conv.limit(0)).collect()] == [-7]
    assert chat.formatted(chat.canonical(conv.limit(0), "conv_id")).collect() == []
