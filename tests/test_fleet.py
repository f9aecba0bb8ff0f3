from __future__ import annotations

import json
from decimal import Decimal

from pyspark.sql import functions as F

from tidemark.functions import fleet as ff
from tidemark.operators import fleet


def column(spark, values, expression):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(values)], "n int, raw string")
    return [r.x for r in df.select("n", expression(F.col("raw")).alias("x")).orderBy("n").collect()]


def test_manifest_and_images(spark):
    text = "deployment ctl main r.io:5000/a/ctl:1,statefulset  hist  hist hist:2 ,,"
    declared = fleet.parse_manifest(spark.createDataFrame([(text,)], "manifest string"))
    rows = sorted(map(tuple, declared.collect()))
    assert rows == [
        ("deployment", "ctl", "main", "r.io:5000/a/ctl:1"),
        ("statefulset", "hist", "hist", "hist:2"),
    ]
    running = spark.createDataFrame(
        [("deployment", "ctl", "main", "r.io:5000/a/ctl:9")],
        "type string, name string, container string, image string",
    )
    got = {r.name: (r.running_image, r.problem) for r in fleet.image_mismatch(declared, running).collect()}
    assert got == {"ctl": ("r.io:5000/a/ctl:9", "mismatch"), "hist": (None, "missing")}
    assert fleet.image_mismatch(declared, declared).count() == 0


def test_image_parts(spark):
    got = column(spark, ["r.io:5000/team/app:v1.2", "app:3", "plain", "a/b/c:x-y_z"], ff.image_parts)
    assert [r and tuple(r) for r in got] == [
        ("r.io:5000", "team/app", "v1.2"),
        ("", "app", "3"),
        None,
        ("a", "b/c", "x-y_z"),
    ]


def test_retag(spark):
    releases = spark.createDataFrame([("r.io:5000/app:2",), ("plain:7",), ("bad",)], "image_ref string")
    refs = ["r.io:5000/app:1", "r.io:5000/app:2", "plain:6", "other:1", "plain", "r.io/app:1"]
    got = fleet.retag(spark.createDataFrame([(r,) for r in refs], "image_ref string"), releases).collect()
    assert {r.image_ref: r.new_ref for r in got} == {
        "r.io:5000/app:1": "r.io:5000/app:2",
        "r.io:5000/app:2": "r.io:5000/app:2",
        "plain:6": "plain:7",
        "other:1": "other:1",
        "plain": "plain",
        "r.io/app:1": "r.io/app:1",
    }
    assert {r.image_ref for r in got if r.changed} == {"r.io:5000/app:1", "plain:6"}


def test_retag_nodes(spark):
    releases = spark.createDataFrame([("r.io:5000/team/app:2",), ("tool:7",)], "image_ref string")
    rows = [
        (1, ("r.io:5000/team/app", None, "1")),
        (2, ("r.io:5000/", "/team/app", "1")),
        (3, (None, "tool", "6")),
        (4, ("r.io:5000", "tool", "6")),
        (5, ("r.io:5000", "team/app", "2")),
        (6, ("r.io:5000", "team/app", None)),
        (7, ("x.io", "other", "1")),
        (8, None),
    ]
    df = spark.createDataFrame(rows, "id int, image struct<registry:string,repository:string,tag:string>")
    got = {r.id: (r.image and r.image.tag, r.changed) for r in fleet.retag_nodes(df, releases).collect()}
    assert got == {
        1: ("2", True),
        2: ("2", True),
        3: ("7", True),
        4: ("7", True),
        5: ("2", False),
        6: (None, False),
        7: ("1", False),
        8: (None, False),
    }


def test_spark_memory(spark):
    raw = ["512m", "1g", "2G", "600", "10kb", "1t", "7b", "1.5g", "", "5Gi", None, "-1m"]
    got = column(spark, raw, ff.spark_memory)
    want = [512 * 2**20, 2**30, 2**31, 600 * 2**20, 10 * 2**10, 2**40, 7, None, None, None, None, None]
    assert got == [None if w is None else Decimal(w) for w in want]


def test_whole_numbers_compare_exactly(spark):
    schema = {"properties": {"n": {"default": 9_007_199_254_740_992}, "m": {"default": 1}, "f": {"default": 0.5}}}

    def found(text):
        df = spark.createDataFrame([("d", text)], "doc_id string, json string")
        return {r.path for r in fleet.config_drift(df, schema).collect()}

    assert found('{"n": 9007199254740992, "m": 1.0, "f": 0.5}') == set()
    assert found('{"n": 9007199254740993, "m": 1.5, "f": 1}') == {"n", "m", "f"}
    assert found('{"n": 123456789012345678901234567890, "m": 1e0}') == {"n"}


SCHEMA = {
    "properties": {
        "n": {"default": 1},
        "on": {"default": True},
        "text": {"default": "x"},
        "nothing": {"default": None},
        "file": {"default": "see my values.yaml file"},
        "box": {"default": {"a": 1}, "properties": {"a": {"default": 1}, "odd.key": {"default": 0}}},
        "list": {"items": {"properties": {"port": {"default": 80}}, "items": {"properties": {"z": {"default": 1}}}}},
        "free": {},
    }
}


def drift(spark, document):
    df = spark.createDataFrame([("d", json.dumps(document))], "doc_id string, json string")
    return {r.path: (r.expected, r.actual) for r in fleet.config_drift(df, SCHEMA).collect()}


def test_config_drift(spark):
    same = {"n": 1.0, "on": True, "text": "x", "nothing": None, "box": {"a": 1}, "list": [{"port": 80}]}
    assert drift(spark, same) == {}
    other = {
        "n": "1",
        "on": 1,
        "text": "y",
        "nothing": 0,
        "file": "anything",
        "box": {"a": 2, "odd.key": 5, "unknown": 9},
        "list": [{"port": 80}, {"port": 81}, [{"z": 2}]],
        "free": 3,
        "unknown": {"n": 2},
    }
    assert drift(spark, other) == {
        "n": ("1", '"1"'),
        "on": ("true", "1"),
        "text": ('"x"', '"y"'),
        "nothing": ("null", "0"),
        "box.a": ("1", "2"),
        "box.odd.key": ("0", "5"),
        "list.[1].port": ("80", "81"),
        "list.[2].[0].z": ("1", "2"),
    }
    assert drift(spark, {"n": None, "box": 3, "list": 4}) == {"n": ("1", "null"), "box": ('{"a": 1}', "3")}
    broken = spark.createDataFrame([("d", "{")], "doc_id string, json string")
    assert fleet.config_drift(broken, SCHEMA).count() == 0


def test_quantities(spark):
    raw = ["200m", "1500m", "600Mi", "1g", "6G", "3", "0.45", "bad", "", "1.5Ki", None, "2E", "7x"]
    got = column(spark, raw, ff.quantity)
    want = ["0.2", "1.5", str(600 * 2**20), str(2**30), "6000000000", "3", "0.45", None, None, "1536", None]
    want += [str(2 * 10**18), None]
    assert got == [w and Decimal(w) for w in want]


def test_capacity(spark):
    rows = [
        ("small", "ctl", "0.2", 400, 1, False, False),
        ("small", "hook", "0.2", 300, 2, False, False),
        ("small", "hist", "0.45", 1088, 1, True, False),
        ("large", "ctl", "3", 6000, 2, False, False),
    ]
    df = spark.createDataFrame(
        [(p, c, Decimal(x), *r) for p, c, x, *r in rows],
        "profile string, container string, cpu decimal(6,2), mem_mi int, n int, optional boolean, temporary boolean",
    )
    got = {(r.profile, r.optional): (float(r.cpu), r.mem_mi, r.containers) for r in fleet.profile_capacity(df).collect()}
    assert got[("small", False)] == (0.6, 1000, 3)
    assert got[("small", None)] == (1.05, 2088, 4)
    assert got[(None, None)] == (7.05, 14088, 6)


def test_uris_and_responses(spark):
    got = column(spark, ["s3a://b/x/y", "s3a://b/x/", "s3a://b", "hdfs://h/p"], ff.uri_parts)
    assert [tuple(r) for r in got] == [("b", "x/y"), ("b", "x"), ("b", ""), ("h", "p")]
    texts = ["* x\nHTTP/1.1 200 OK\nDate: 404", "HTTP/2 404", "no status 200", "HTTP/1.1 301 Moved"]
    assert column(spark, texts, ff.http_status) == [200, 404, None, 301]
    classes = column(spark, texts, lambda c: ff.status_class(ff.http_status(c)))
    assert classes == ["exists", "missing", "unknown", "unknown"]
