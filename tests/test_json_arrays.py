"""JSON documents read by byte ranges against the reader that takes a document in one task."""

from __future__ import annotations

import json
import random

import pytest

from tracemill.sources.files import read_json
from tracemill.sources.json_arrays import read_json_array

SCHEMA = "id long, t string, o struct<a: string, l: array<struct<b: long>>>"
TEXTS = ["", "plain", "}", "{", '"', "\\", '\\"}{', "{}" * 30, "a\nb\t}", "é漢😀}", '{"id": 1}', "x" * 400, "}" * 200, "\\\\}", "[,]"]


@pytest.fixture
def ranges(spark):
    """Sets how many bytes a range has."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, before)


def rows(df) -> list[str]:
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize("size", [350, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_same_as_in_one_task(spark, ranges, tmp_path, size, indent):
    rng = random.Random(size)
    for k in range(2):
        made = [{"id": 100 * k + i, "t": rng.choice(TEXTS) + rng.choice(TEXTS), "o": {"a": rng.choice(TEXTS), "l": [{"b": j} for j in range(i % 4)]}} for i in range(30)]
        made += [{}, {"id": None, "t": None}, made[0]]
        (tmp_path / f"{k}.json").write_text(json.dumps(made, indent=indent, ensure_ascii=bool(k)))
    want = rows(read_json(spark, str(tmp_path), SCHEMA))
    ranges(size)
    got = read_json_array(spark, str(tmp_path), SCHEMA)
    assert rows(got) == want and len(want) == 66
    assert size > 1000 or spark.read.option("lineSep", "}").text(str(tmp_path)).rdd.getNumPartitions() > 10


def test_empty_and_single(spark, tmp_path):
    for name, text in {"a": "[]", "b": "", "c": " [ ] \n", "d": '{"id": 7, "t": "}"}', "e": '{"id": 8}\n'}.items():
        (tmp_path / f"{name}.json").write_text(text)
    assert sorted(r["id"] for r in read_json_array(spark, str(tmp_path), SCHEMA).collect()) == [7, 8]


def test_a_record_that_does_not_parse_is_alone(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"id": 1}, {"id" 2}, {"id": 3}]')
    assert sorted(str(r["id"]) for r in read_json_array(spark, str(tmp_path), SCHEMA).collect()) == ["1", "3", "None"]
