"""Nested JSON in parts and numbered JSON lines, on files of many ranges."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tessera.sources import io, nested


@pytest.fixture
def small_ranges(spark):
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def odd_text(rng):
    return "".join(rng.choice(["a", "}", "{", '"', "\\", ",", "[", "]", ":", "é", "\n", " ", "\\}", '\\"', "\U0001f600"]) for _ in range(rng.randint(0, 60)))


def whole(rng):
    return {f"v{i}{odd_text(rng)}": {f"p{j}{odd_text(rng)}": rng.choice([{"x": odd_text(rng), "y": [{"z": odd_text(rng)}, []]}, {}, [odd_text(rng)], odd_text(rng), 3, None]) for j in range(rng.randint(0, 6))} for i in range(8)}


@pytest.mark.parametrize(("seed", "indent", "end"), [(1, None, ""), (2, 2, " \n\n")])
def test_members_equal_the_parser(spark, small_ranges, tmp_path, seed, indent, end):
    rng = random.Random(seed)
    data = whole(rng)
    path = tmp_path / "d.json"
    path.write_text(json.dumps(data, indent=indent, ensure_ascii=seed % 2 == 0) + end)
    assert nested._ranges(spark, str(path)).rdd.getNumPartitions() > 5
    got = sorted((r.outer, r.key, json.dumps(json.loads(r.value))) for r in nested.members(spark, str(path)).collect())
    assert got == sorted((v, p, json.dumps(x)) for v, ps in data.items() for p, x in ps.items())
    flat = sorted((r.key, json.dumps(json.loads(r.value))) for r in nested.members(spark, str(path), 1).collect())
    assert flat == sorted((v, json.dumps(ps)) for v, ps in data.items())


def test_several_files_and_repeated_names(spark, small_ranges, tmp_path):
    for k in range(3):
        (tmp_path / f"{k}.json").write_text('{"v": {"p": {"k": %d}, "p": {"k": 7}}, "v": {"q": {}}, "empty": {}}' % k)
    got = sorted((r.path[-6:], r.outer, r.key, r.value) for r in nested.members(spark, str(tmp_path)).collect())
    assert got == sorted(x for k in range(3) for x in [(f"{k}.json", "v", "p", '{"k": %d}' % k), (f"{k}.json", "v", "p", '{"k": 7}'), (f"{k}.json", "v", "q", "{}")])


@pytest.mark.parametrize("text", ['{"a": {"b": 1}', '{"a": {"b": "x}}', '{"a": 1}', '{"a": {"b": 1}}}', '{"a": [1]}', '{"a": {"b" 1}}', '{"a" {"b": 1}}', '{"a": {5}}'])
def test_broken_files_raise(spark, tmp_path, text):
    (tmp_path / "x.json").write_text(text)
    with pytest.raises(Exception, match="x.json"):
        nested.members(spark, str(tmp_path)).collect()


def test_parts_equal_the_reader_of_whole_files(spark, small_ranges, tmp_path):
    entry = lambda i: {"review": f"r{i}", "rebuttal": None, "aligned": [{"rebuttal_sentence": f"s{i} }}", "review_spans": ["a", "b"], "labels": {"filter_out": i % 2 == 0}}] * (i % 3)}
    (tmp_path / "d.json").write_text(json.dumps({f"v{v}": {f"p{p}": {f"r{r}": entry(r) for r in range(4)} for p in range(5)} for v in range(3)}))
    order = ["venue", "paper_id", "review_id", "pos"]
    want = io.dataset(spark, str(tmp_path)).orderBy(*order).collect()
    assert io.dataset_in_parts(spark, str(tmp_path)).orderBy(*order).collect() == want and len(want) > 60
    form = "map<string,struct<review:string>>"
    (tmp_path / "d.json").write_text('{"v": {"good": {"r": {"review": "x"}}, "bad": [1]}}')
    with pytest.raises(Exception, match="v / bad"):
        nested.parsed(nested.members(spark, str(tmp_path)), form).collect()
    listed = {r.key: r.error is None for r in nested.parsed(nested.members(spark, str(tmp_path)), form, strict=False).collect()}
    assert listed == {"good": True, "bad": False}


def test_json_lines_name_the_bad_line(spark, small_ranges, tmp_path):
    lines = ["" if i % 7 == 3 else json.dumps({"id": i, "t": "x" * (i % 50)}) for i in range(300)]
    (tmp_path / "a.jsonl").write_text("\n".join(lines) + "\n")
    rows = nested.numbered_json_lines(spark, str(tmp_path / "a.jsonl"), "id long, t string")
    assert rows.rdd.getNumPartitions() > 5
    got = sorted((r.line_no, r.value.id, len(r.value.t)) for r in rows.collect())
    assert got == [(i + 1, i, i % 50) for i in range(300) if i % 7 != 3]
    lines[233] = '{"id": 233, "t": '
    lines[244] = '{"id": "no number"}'
    (tmp_path / "b.jsonl").write_text("\n".join(lines))
    with pytest.raises(Exception, match=r"b.jsonl line (234|245): invalid JSON"):
        nested.numbered_json_lines(spark, str(tmp_path / "b.jsonl"), "id long, t string").collect()
    both = nested.numbered_json_lines(spark, str(tmp_path), "id long, t string", strict=False)
    bad = {(r.path[-7:], r.line_no) for r in both.where(F.col("error").isNotNull()).collect()}
    assert bad == {("b.jsonl", 234), ("b.jsonl", 245)} and both.count() == 2 * len([x for x in lines if x])
