"""Tool-call linking on hand-made chats, connected components, and the pipeline's contracts."""

import json
import random

import duckdb
import pytest

import corpus_pipeline
from pathweave.llm import tool_calls
from pathweave.llm.components import components
from pathweave.llm.oracle import ORACLES
from pathweave.llm.queries import QUERIES

SCHEMAS = [("w", "city", "string", True), ("w", "days", "integer", False), ("geo", "q", "string", True)]


@pytest.fixture(scope="module")
def schemas(spark):
    return spark.createDataFrame(SCHEMAS, "tool string, parameter string, type string, required boolean")


def formatted(spark, schemas, messages):
    rows = spark.createDataFrame(
        [(*m, "level", 3) for m in messages], "conv_id long, turn long, role string, text string, kind string, slot int"
    )
    return tool_calls.format_chats(rows, schemas).collect()


def test_calls_are_linked_ordered_and_validated(spark, schemas):
    asked = {
        "content": "let me",
        "tool_calls": [
            {"id": "b", "name": "w", "arguments": {"z": 1, "city": "X"}, "after": ["a", "nobody"]},
            {"id": "a", "name": "geo", "arguments": {"q": 5}},
        ],
    }
    rows = formatted(spark, schemas, [
        (1, 0, "user", "weather?"), (1, 1, "assistant", json.dumps(asked)),
        (1, 2, "tool", '{"tool_call_id":"b","content":"sunny"}'),
        (1, 3, "tool", '{"tool_call_id":"a","content":"here"}'), (1, 4, "tool", '{"tool_call_id":"zz"}'),
        (2, 3, "tool", '{"tool_call_id":"a"}'),
    ])
    mine = sorted((r for r in rows if r["conv_id"] == 1), key=lambda r: (r["slot"], r["level"], r["turn"], r["place"]))
    told = [json.loads(r["json"]) for r in mine]
    assert [(r["kind"], t.get("id")) for r, t in zip(mine, told)] == [
        ("message", None), ("message", None), ("call", "a"), ("result", "a"), ("call", "b"), ("result", "b"), ("result", "zz"),
    ]
    assert [r["status"] for r in mine] == ["message"] * 2 + ["linked"] * 4 + ["orphan"]
    assert [r["errors"] for r in mine][2:6] == ["type q", "", "unknown z", ""]
    assert mine[4]["json"] == (
        '{"after":["a","nobody"],"arguments":{"city":"X","z":1},"errors":["unknown z"],"id":"b","kind":"call",'
        '"name":"w","role":"assistant","status":"linked"}'
    )
    assert [r["status"] for r in rows if r["conv_id"] == 2] == ["orphan"]


def test_cycles_duplicates_and_bad_rows(spark, schemas):
    circle = [
        {"id": "p", "name": "w", "arguments": {}, "after": ["q"]},
        {"id": "q", "name": "nope", "arguments": [1], "after": ["p"]},
        {"id": "q", "name": "w", "arguments": {"city": "a"}},
        {"id": "r", "name": "w", "arguments": {"city": "a"}, "after": ["r"]},
    ]
    rows = formatted(spark, schemas, [
        (2, 0, "assistant", json.dumps({"tool_calls": circle})), (3, 0, None, None), (3, 1, "assistant", "{bad"),
        (3, 2, "assistant", ""), (3, 3, "tool", "x" * 100000), (None, None, "tool", '{"tool_call_id":"a"}'),
        (3, 3, "user", "same turn"), (3, 3, "user", "same turn"),
    ])
    calls = {(r["place"]): (r["status"], r["errors"], r["level"]) for r in rows if r["kind"] == "call"}
    assert calls == {
        1: ("cycle", "missing city", None), 2: ("cycle", "unknown tool", None),
        3: ("duplicate", "", 1), 4: ("cycle", "", None),
    }
    assert sum(r["kind"] == "message" for r in rows) == 7
    assert [json.loads(r["json"])["role"] for r in rows if r["conv_id"] == 3 and r["turn"] == 0] == ["unknown"]
    assert formatted(spark, schemas, []) == []


def test_long_chains_of_needs(spark, schemas):
    chain = [{"id": f"c{k}", "name": "w", "arguments": {"city": "a"}, "after": [f"c{k - 1}"]} for k in range(40)]
    rows = formatted(spark, schemas, [(1, 0, "assistant", json.dumps({"tool_calls": chain[::-1]}))])
    levels = {json.loads(r["json"])["id"]: r["level"] for r in rows if r["kind"] == "call"}
    assert levels == {f"c{k}": 2 * k + 1 for k in range(40)}


def test_levels_and_slots_of_random_needs(spark, schemas):
    random.seed(11)
    calls, needs, turns, answered = {}, {}, {}, {}
    messages = []
    for k in range(60):
        needs[k] = sorted(random.sample(range(k), min(k, random.choice([0, 1, 1, 1, 2]))))
        turns[k] = random.randrange(40)
        call = {"id": f"c{k}", "name": "w", "arguments": {"city": "a"}, "after": [f"c{j}" for j in needs[k]]}
        messages.append((1, turns[k], "assistant", json.dumps({"tool_calls": [call]})))
        if random.random() < 0.7:
            answered[k] = random.randrange(40)
            messages.append((1, answered[k], "tool", json.dumps({"tool_call_id": f"c{k}"})))
    level, slot = {}, {}
    for k in range(60):
        level[k] = max((level[j] + 2 for j in needs[k]), default=1)
        slot[k] = max([turns[k], *(max(slot[j], answered.get(j, 0)) for j in needs[k])])
    rows = formatted(spark, schemas, messages)
    got = {json.loads(r["json"])["id"]: (r["level"], r["slot"]) for r in rows if r["kind"] == "call"}
    assert got == {f"c{k}": (level[k], slot[k]) for k in range(60)}


def test_components(spark):
    random.seed(1)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(160)]
    edges += [(k, k + 1) for k in range(1000, 1060)] + [(2000, k) for k in range(2001, 2300)] + [(5, 5)]
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(root[a], root[b])
            changed |= root[a] != low or root[b] != low
            root[a] = root[b] = low
    assert got == {x: root[x] for e in edges if e[0] != e[1] for x in e}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_stages_keep_columns_and_take_effect(spark, documents, tmp_path):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    labels.write.parquet(str(tmp_path / "labels.parquet"))
    documents.write.parquet(str(tmp_path / "documents.parquet"))
    docs, counts = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        path = str(tmp_path / name)
        out.write.parquet(path)
        docs = spark.read.parquet(path)
        counts.append(docs.count())
    assert counts[0] < documents.count() and counts[1] < counts[0] and counts[2] < counts[1]
    assert counts[3] == counts[2]
    got = corpus_pipeline.run(spark, str(tmp_path))
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, got.select(columns).collect())) == sorted(map(tuple, pieces.select(columns).collect()))


def test_run_against_brute_force(spark, documents, tmp_path):
    """Every stage's decision from its definition, on what the stages before it kept."""
    from array import array
    from zlib import crc32

    from plain import linked_groups, quality_counts, secret_spans
    from tokenizers import Tokenizer

    from pathweave.llm import language_id, secret_tags
    from pathweave.llm.queries import tokenizer_file

    folder = str(tmp_path)
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    documents.write.parquet(f"{folder}/documents.parquet")
    given = spark.read.parquet(f"{folder}/documents.parquet")
    verdicts = language_id.predict(given, language_id.fit(given)).filter("not ambiguous").collect()
    named = {r["doc_id"] for r in verdicts}
    assert len(verdicts) > 100 and not named & {310, 311, 312, 313}
    rows = [(r["doc_id"], r["text"] or "") for r in given.collect() if r["doc_id"] in named]
    rows = [(d, t) for d, t in rows if (q := quality_counts(t))[0] >= 50 and 2 * q[4] <= q[0]]
    groups = linked_groups(rows, 5, 4, 5)
    rows = sorted({(d, t) for (d, t), (_, n, first, _) in zip(rows, groups) if n == 0 or d == first})
    tokenizer = Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))
    want = []
    for doc, text in rows:
        for start, _, end in reversed(secret_spans(text)):
            text = text[:start] + "[SECRET]" + text[end:]
        ids = tokenizer.encode(text, add_special_tokens=False).ids + [1]
        for k in range(0, len(ids), 4096):
            part = array("I", ids[k : k + 4096])
            want.append((doc, k // 4096, k, len(part), crc32(part.tobytes())))
    got = corpus_pipeline.run(spark, folder)
    assert sorted(tuple(r)[:5] for r in got.collect()) == sorted(want)
    assert secret_tags.KINDS[3] == "crf"


def test_native_operators_run_no_python(spark, monkeypatch):
    """No plan that a query writes on its way or returns holds a Python node or an RDD."""
    from pathweave.llm import components, personal_data, tool_calls

    seen = []

    def watched(module):
        write = module.materialise

        def materialise(df, *args):
            seen.append(df._jdf.queryExecution().toString())
            return write(df, *args)

        monkeypatch.setattr(module, "materialise", materialise)

    for module in (components, personal_data, tool_calls):
        watched(module)
    for name in ("op1_personal_data", "op5_tool_calls"):
        begin = len(seen)
        df = QUERIES[name](spark, "/root/testdata/sf0.001")
        seen.append(df._jdf.queryExecution().toString())
        assert len(seen) > begin + 3
    for plan in seen:
        assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "ExistingRDD", "PythonRDD"))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, name):
    folder = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for table in ("documents", "embeddings", "labels", "conversations"):
        db.execute(f"CREATE VIEW {table} AS FROM '{folder}/{table}.parquet'")
    df = QUERIES[name](spark, folder)
    columns = sorted(df.columns)
    found = db.execute(ORACLES[name])
    names = [c[0] for c in found.description]
    want = sorted((tuple(r[names.index(c)] for c in columns) for r in found.fetchall()), key=str)
    assert sorted(map(tuple, df.select(*columns).collect()), key=str) == want


def test_every_operator_is_registered():
    assert {name.split("_")[0] for name in QUERIES} == {f"op{n}" for n in range(1, 14)}
