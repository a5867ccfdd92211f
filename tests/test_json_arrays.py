import json
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StringType, StructField, StructType

from casekit.sources import json_arrays

DEEP = StructType([StructField("x", StringType()), StructField("y", StructType([StructField("z", DoubleType())]))])
SCHEMA = StructType([StructField("a", StringType()), StructField("n", LongType()), StructField("list", ArrayType(StringType())), StructField("deep", DEEP)])


def record(rng):
    bits = ['"', "\\", "{", "}", "[", "]", ",", "é", "😀", "\n", "\t", "word ", ":", "null", "\\\\\"", "}}}", " "]
    text = lambda: "".join(rng.choices(bits, k=rng.randint(0, 12)))
    return {"a": text(), "n": rng.randint(-5, 5), "list": [text() for _ in range(rng.randint(0, 3))], "other": {"k": [{"q": text()}, [], {}]}, "deep": rng.choice([None, {"x": text(), "y": {"z": 1.5}}])}


def whole(spark, folder):
    """The same by parsing each file as one row."""
    files = spark.read.format("binaryFile").load(f"{folder}/*.json")
    rows = files.select("path", F.from_json(F.decode("content", "UTF-8"), f"array<{SCHEMA.simpleString()}>").alias("r"))
    return sorted(map(str, rows.select(F.element_at(F.split("path", "/"), -1).alias("f"), F.posexplode("r").alias("place", "r")).collect()))


def cut(spark, folder):
    df = json_arrays.read_json_arrays(spark, f"{folder}/*.json", SCHEMA)
    return sorted(map(str, df.select(F.element_at(F.split("path", "/"), -1).alias("f"), "place", F.col("record").alias("r")).collect()))


@pytest.fixture
def blocks(spark):
    """Sets the size of blocks in bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}

    def use(size):
        for n, v in zip(names, (size, 1)):
            spark.conf.set(n, str(v))

    yield use
    for n, v in before.items():
        spark.conf.set(n, v)


@pytest.mark.parametrize("size", [131, 700, 1 << 20])
def test_rows_do_not_depend_on_blocks(spark, tmp_path, blocks, size):
    rng = random.Random(size)
    for i in range(3):
        rows = [record(rng) for _ in range(rng.randint(1, 20))]
        rows.insert(rng.randint(0, len(rows)), None)
        (tmp_path / f"f +%{i}é.json").write_text(json.dumps(rows, ensure_ascii=bool(i % 2), indent=rng.choice([None, 2])), encoding="utf-8")
    want = whole(spark, tmp_path)
    blocks(size)
    assert cut(spark, tmp_path) == want and len(want) > 8


def test_a_record_over_many_blocks(spark, tmp_path, blocks):
    long = {"a": "x}{\"" * 3000, "n": 1, "list": [], "deep": None}
    (tmp_path / "f.json").write_text(json.dumps([{"n": 0}, long, {"n": 2}]))
    want = whole(spark, tmp_path)
    blocks(700)
    df = json_arrays.read_json_arrays(spark, f"{tmp_path}/*.json", SCHEMA)
    assert df.rdd.getNumPartitions() > 5 and cut(spark, tmp_path) == want and len(want) == 3


def test_empty_odd_and_broken_files(spark, tmp_path, blocks):
    for name, text in {"empty": "", "none": "[]", "blank": " \n", "one": ' {"n": 7, "a": "}"} ', "bom": '﻿[{"n": 1}]', "scalar": "12", "null": "null", "late": "\n" * 400 + '[{"n": 3}]'}.items():
        (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
    blocks(90)
    got = json_arrays.read_json_arrays(spark, f"{tmp_path}/*.json", SCHEMA).select(F.regexp_extract("path", r"(\w+)\.json$", 1), "place", "record.n", "record.a").collect()
    assert sorted(map(tuple, got)) == [("bom", 0, 1, None), ("late", 0, 3, None), ("one", 0, 7, "}")]
    (tmp_path / "wrong.json").write_text('[{"n": 1}, {"n": "x"}, 5, {"n": 4}]')
    rows = json_arrays.read_json_arrays(spark, f"{tmp_path}/wrong.json", SCHEMA).select("place", "record.n").collect()
    assert sorted(map(tuple, rows)) == [(0, 1), (1, None), (2, None), (3, 4)]


def test_groups_of_files_and_column_pruning(spark, tmp_path, blocks, monkeypatch):
    rng = random.Random(5)
    for i in range(6):
        (tmp_path / f"f{i}.json").write_text(json.dumps([record(rng) for _ in range(20)]))
    want = whole(spark, tmp_path)
    blocks(2000)
    monkeypatch.setattr(json_arrays, "BLOCKS_AT_ONCE", 10)
    assert cut(spark, tmp_path) == want
    plan = json_arrays.read_json_arrays(spark, f"{tmp_path}/*.json", SCHEMA).select("record.n")._jdf.queryExecution().optimizedPlan().toString()
    assert "StructField(n,LongType" in plan and "StructField(a,StringType" not in plan


def test_blocks_that_changed_are_an_error(spark, tmp_path, blocks):
    (tmp_path / "f.json").write_text(json.dumps([{"n": i} for i in range(300)]))
    blocks(500)
    df = json_arrays.read_json_arrays(spark, f"{tmp_path}/*.json", SCHEMA)
    blocks(300)
    with pytest.raises(Exception, match="other blocks"):
        df.collect()
