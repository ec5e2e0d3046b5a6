"""format("nquads") beside read_nquads."""

import gzip
import random

import pytest
from pyspark.sql import functions as F

from quadframe.functions import terms as T
from quadframe.sources import datasource, nquads

X = T.XSD


@pytest.fixture(scope="module")
def lines():
    rng = random.Random(3)
    texts = ["a", "", "é\\u00e9 \\U0001F600", 'q\\"q', "b\\\\n", "tab\\tend", "line\\nbreak", "b\\bf\\f"]
    kinds = ["", "@EN-gb", f"^^<{X}string>", f"^^<{X}token>"]
    objects = [f'"{t}"{k}' for t in texts for k in kinds] + [f'"{v}"^^<{X}{k}>' for v in ("+007", "-0", "1.50", ".5", "5.", "x", "1", "true", "0.1234567890123456789") for k in ("integer", "decimal", "boolean", "double")]
    objects += [f'"2020-01-01T00:00:00.000Z"^^<{X}dateTime>', f'"2020-01-01T00:00:00.5Z"^^<{X}dateTime>', "<urn:o>", "_:b1", "_:ü.x"]
    out = [f"<urn:s{i % 7}> <urn:p{i % 3}> {o} {rng.choice(['', '<urn:g>', '<urn:h>', '_:g'])} ." for i, o in enumerate(objects)]
    return [*out, "", "  # a comment", "<urn:s> <urn:p> <urn:o> . # end\r", "<urn:s><urn:p>\"x\"."]


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


@pytest.mark.parametrize("size", [1 << 20, 40, 97])
def test_reads_as_the_text_scan_does(spark, tmp_path, lines, monkeypatch, size):
    datasource.register(spark)
    (tmp_path / "a.nq").write_text("\n".join(lines), encoding="utf-8", newline="")
    with gzip.open(tmp_path / "b.nq.gz", "wt", encoding="utf-8") as f:
        f.write("<urn:z> <urn:p0> \"zipped\" .\n")
    monkeypatch.setattr(datasource, "RANGE", size)
    reader = datasource.NQuadsReader(str(tmp_path))
    found = [tuple(r.values()) for part in reader.partitions() for batch in reader.read(part) for r in batch.to_pylist()]
    want = rows(nquads.parse_lines(spark.read.text(str(tmp_path))))
    assert sorted(found, key=str) == want
    assert rows(spark.read.format("nquads").load(str(tmp_path))) == want


def test_filters_reach_the_source(spark, tmp_path, lines):
    datasource.register(spark)
    (tmp_path / "a.nq").write_text("\n".join(lines), encoding="utf-8", newline="")
    every = nquads.parse_lines(spark.read.text(str(tmp_path)))
    df = spark.read.format("nquads").load(str(tmp_path))
    for condition in (F.col("p") == "<urn:p1>", F.col("g").isNull(), F.col("g").isin("<urn:g>", "<urn:h>") & (F.col("s") == "<urn:s2>"), F.col("o").startswith('"') & (F.col("p") == "<urn:p2>")):
        assert rows(df.where(condition)) == rows(every.where(condition))
    reader = datasource.NQuadsReader(str(tmp_path))
    from pyspark.sql.datasource import EqualTo, StringStartsWith

    other = StringStartsWith(("o",), '"')
    assert list(reader.pushFilters([EqualTo(("p",), "<urn:p1>"), other])) == [other] and reader.wanted == {"p": {"<urn:p1>"}}


def test_what_is_written_comes_back(spark, tmp_path, lines):
    datasource.register(spark)
    quads = nquads.parse_lines(spark.createDataFrame([(x,) for x in lines], "value string"))
    at = str(tmp_path / "out")
    quads.repartition(3).write.format("nquads").mode("append").save(at)
    assert rows(spark.read.format("nquads").load(at)) == rows(quads)
    quads.limit(5).coalesce(1).write.format("nquads").mode("overwrite").save(at)
    assert spark.read.format("nquads").load(at).count() == 5


def test_bad_lines_raise():
    for bad in ("<urn:s> <urn:p> .", '<urn:s> "p" <urn:o> .', "<urn:s> <urn:p> <urn:o>"):
        with pytest.raises(ValueError):
            datasource.parse_line(bad)
