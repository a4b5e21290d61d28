"""Walks over artifacts of any shape, parallel maps, strict schemas by row, blobs as files."""

from __future__ import annotations

import json
import os
import time

import pytest
from pyspark.sql import functions as F

from factloom.functions import schemas
from factloom.operators import parallel, walk
from factloom.sources import blobs
from factloom.sources.codec import seal

# walks


def every_node(value, path="$", name=None, depth=0):
    """The walk by recursion over parsed JSON."""
    kind = {dict: "OBJECT", list: "ARRAY", str: "STRING", bool: "BOOLEAN", type(None): "VOID"}.get(type(value), "NUMBER")
    yield path, name, depth, kind, value
    for key, own in value.items() if isinstance(value, dict) else enumerate(value) if isinstance(value, list) else ():
        yield from every_node(own, f"{path}.{key}" if isinstance(value, dict) else f"{path}[{key}]", key if isinstance(value, dict) else name, depth + 1)


def variants(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "k long, j string").select("k", F.try_parse_json("j").alias("v"))


def test_walk_over_odd_shapes(spark, tmp_path):
    deep = "f9"
    for _ in range(20):
        deep = {"a": [deep, {"fact_ids": ["g"]}]}
    texts = [json.dumps({"x": {"fact_ids": ["f1", "f2", 3, None, ["f3"]]}, "y": [{"baseline_fact_ids": ["f1"]}, 1.5, True], "fact_ids": "f4", "fact_id": "no"}), "[]", "{}", '"fact_ids"', "3", "null", None, "{broken", json.dumps(deep), '{"fact_ids": {"deeper": ["f5"], "also": "no"}}']
    found = walk.nodes(variants(spark, texts), ["k"], "v", f"file://{tmp_path}").cache()
    want = sorted((k, p, n or "", d) for k, t in enumerate(texts) if t and t != "{broken" for p, n, d, _, _ in every_node(json.loads(t)))
    assert sorted((r.k, r.path, r["name"] or "", r.depth) for r in found.collect()) == want
    refs = {(k, v) for k, t in enumerate(texts) if t and t != "{broken" for _, n, _, kind, v in every_node(json.loads(t)) if n in walk.REFERENCES and kind == "STRING"}
    assert sorted(map(tuple, walk.references(found, ["k"]).collect())) == sorted(refs)
    facts = spark.createDataFrame([(0, "f1"), (0, "f2"), (1, "f4")], "k long, fact_id string")
    assert sorted(map(tuple, walk.unknown_references(found, facts, ["k"]).collect())) == sorted(r for r in refs if r not in {(0, "f1"), (0, "f2")})


def test_walk_limits(spark, tmp_path):
    nest = lambda n: "[" * n + "]" * n
    assert walk.nodes(variants(spark, [nest(9)]), ["k"], "v", f"file://{tmp_path}", most=8).count() == 9
    with pytest.raises(ValueError, match="levels"):
        walk.nodes(variants(spark, [nest(10)]), ["k"], "v", f"file://{tmp_path}", most=8)
    assert walk.nodes(variants(spark, [None]), ["k"], "v", f"file://{tmp_path}").count() == 0


# parallel maps


def test_parallel_map(spark):
    def slow_or_wrong(n, text):
        if n % 7 == 3:
            raise ValueError(f"no {n}")
        if n % 50 == 5:
            time.sleep(3)
        if n % 11 == 4:
            return "not a number"
        return None if text is None else n + len(text)

    rows = spark.range(300, numPartitions=2).select(F.col("id").alias("n"), F.when(F.col("id") % 13 != 0, F.repeat(F.lit("x"), (F.col("id") % 4).cast("int"))).alias("text"), F.lit("kept").alias("value"))
    began = time.time()
    got = parallel.parallel_map(rows, slow_or_wrong, ["n", "text"], "long", width=6, deadline=0.4).collect()
    assert time.time() - began < 30
    assert [r.n for r in got] == list(range(300))
    for r in got:
        n = r.n
        error = f"ValueError: no {n}" if n % 7 == 3 else "timeout" if n % 50 == 5 else "type" if n % 11 == 4 else None
        assert (r.error, r.value) == (error, None if error or n % 13 == 0 else n + n % 4), r


def test_parallel_map_is_bounded(spark, tmp_path):
    def call(n):
        import threading

        own = f"{tmp_path}/{n}"
        open(own, "w").close()
        seen = len(os.listdir(tmp_path))
        time.sleep(0.01)
        os.remove(own)
        return seen if threading.current_thread().daemon else -1

    got = parallel.parallel_map(spark.range(120).coalesce(1).toDF("n"), call, ["n"], "int", width=3).collect()
    assert 1 <= max(r.value for r in got) <= 3 and min(r.value for r in got) >= 1
    with pytest.raises(Exception, match="do not end"):
        parallel.parallel_map(spark.range(20).coalesce(1).toDF("n"), lambda n: time.sleep(5), ["n"], "int", width=2, deadline=0.05, lost=3).collect()
    assert parallel.parallel_map(spark.range(0).toDF("n"), call, ["n"], "int").collect() == []


# strict schemas


def nested(levels):
    out = {"type": "string"}
    for _ in range(levels):
        out = {"type": "object", "properties": {"a": out}}
    return out


@pytest.mark.parametrize(
    "schema, code",
    [
        ({"type": "object", "properties": {"a": {"type": "string", "minLength": 3, "default": "x"}, "b": {"const": 3}}, "title": "T"}, None),
        ({"properties": {"a": {"$ref": "#/$defs/d"}}, "$defs": {"d": {"type": "array", "items": {"$ref": "#/$defs/d"}}}}, None),
        ({"type": "object", "properties": {}, "additionalProperties": True}, "open_object"),
        ({"type": "object", "properties": {"a": {"oneOf": []}}}, "unsupported"),
        ({"anyOf": {"type": "string"}}, "unsupported"),
        ({"description": "nothing else"}, "unsupported"),
        ({"type": "object", "properties": {"a": {"$ref": "#/$defs/lost"}}}, "unknown_reference"),
        (nested(10), None),
        (nested(11), "too_deep"),
        ({"type": "object", "properties": {f"p{k}": {"type": "null"} for k in range(5000)}}, None),
        ({"type": "object", "properties": {f"p{k}": {"type": "null"} for k in range(5001)}}, "too_many_properties"),
        ([], "unsupported"),
    ],
)
def test_strict_schema(schema, code):
    strict, said = schemas.rewritten(json.dumps(schema))
    assert said == code and (strict is None) == (code is not None)
    if code is None:
        assert schemas.rewritten(strict) == (strict, None)  # twice is as once


def test_strict_schemas_by_row(spark):
    schemas.register(spark)
    texts = [json.dumps({"type": "object", "properties": {"a": {"type": "integer", "minimum": 0}}}), "{", None, json.dumps(nested(4))]
    spark.createDataFrame([(k, t, "old") for k, t in enumerate(texts)], "k long, own string, code string").createOrReplaceTempView("given_schemas")
    got = spark.sql("select * from strict_schemas(table(given_schemas), column => 'own', levels => 3) order by k").collect()
    assert got[0].asDict() == {"k": 0, "own": texts[0], "strict": '{"type":"object","properties":{"a":{"type":"integer"}},"required":["a"],"additionalProperties":false}', "code": None}
    assert [(r.strict, r.code) for r in got[1:]] == [(None, "invalid_json"), (None, "invalid_json"), (None, "too_deep")]
    with pytest.raises(Exception, match="no column"):
        spark.sql("select * from strict_schemas(table(given_schemas), column => 'lost')").collect()


# blobs


def test_blobs_round_trip(spark, tmp_path):
    spark.dataSource.register(blobs.Blobs)
    folder = f"{tmp_path}/b"
    rows = [(f"n{k}", json.dumps({"k": k, "t": "é" * k})) for k in range(40)] + [(None, "null"), ("empty", "")]
    df = spark.createDataFrame(rows, "name string, json string").repartition(3)
    save = lambda df, mode, key="secret": df.write.format("factloom_blobs").option("key", key).mode(mode).save(folder)
    read = lambda key="secret": sorted(map(tuple, spark.read.format("factloom_blobs").option("key", key).load(folder).collect()), key=repr)
    save(df, "append")
    assert read() == sorted(((n, j, None) for n, j in rows), key=repr)
    assert {r[2] for r in read("other")} == {"bad_signature"}
    save(df.limit(2), "append")
    assert len(read()) == 44
    save(df.where("name = 'n3'"), "overwrite")
    assert read() == [("n3", rows[3][1], None)]
    # Broken lines are rows, and the others are whole.
    blob, signature, _ = seal("{}", b"secret")
    lines = [{"name": "ok", "blob": blob, "signature": signature}, {"name": "cut", "blob": blob[:-4], "signature": signature}, {"name": "no"}, [], {"name": "type", "blob": 3, "signature": signature}]
    with open(f"{folder}/more.blobs", "w") as out:
        out.write("\n".join(map(json.dumps, lines)) + "\n{broken")
    assert [r for r in read() if r[0] != "n3"] == sorted([("ok", "{}", None), ("cut", None, "bad_signature"), ("type", None, "invalid_blob"), ("no", None, "invalid_blob"), *[(None, None, "invalid_blob")] * 2], key=repr)


def test_a_failed_write_leaves_nothing(spark, tmp_path):
    spark.dataSource.register(blobs.Blobs)
    folder = f"{tmp_path}/b"
    big = spark.createDataFrame([(f"n{k}", "{}") for k in range(20)] + [("big", "x" * 3_000_000)], "name string, json string").repartition(4)
    with pytest.raises(Exception, match="report_too_large"):
        big.write.format("factloom_blobs").option("key", "k").mode("append").save(folder)
    assert spark.read.format("factloom_blobs").option("key", "k").load(folder).count() == 0
    assert not [f for f in os.listdir(folder) if not f.startswith(".")]
