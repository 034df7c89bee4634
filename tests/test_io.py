import bz2
import json

import pytest
from pyspark.sql import functions as F

from inkloom.plans import pipelines
from inkloom.sources import readers, schemas, writers
from inkloom.streaming.ingest import ingest, ingested

DUMP = """<mediawiki xmlns="http://example.org/export/">
<page><title>One</title><ns>0</ns><id>1</id>
 <revision><id>11</id><timestamp>2020-01-01T00:00:00Z</timestamp><contributor><username>Ann</username><id>7</id></contributor><text>First text of Ann.<ref>a</ref> </text></revision>
 <revision><id>12</id><timestamp>2020-01-02T00:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><comment>fix</comment><text>First text of Ann, longer now.</text></revision>
 <revision><id>13</id><timestamp>2020-01-03T00:00:00Z</timestamp><contributor><username>CleanBot</username><id>9</id></contributor><text>First text of Ann, longer now again.</text></revision>
 <revision><id>14</id><timestamp>2020-01-04T00:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><text></text></revision>
 <revision><id>15</id><timestamp>2020-01-05T00:00:00Z</timestamp><contributor><ip>1.2.3.4</ip></contributor><text>First text of Ann, longer now still.</text></revision>
</page>
<page><title>Talk:One</title><ns>1</ns><id>2</id><revision><id>21</id><timestamp>t</timestamp><text>x</text></revision></page>
</mediawiki>
"""


@pytest.fixture
def dump(tmp_path):
    path = tmp_path / "a.xml.bz2"
    path.write_bytes(bz2.compress(DUMP.encode()))
    return str(path)


def test_dump_to_scores(spark, dump):
    pages = readers.read_dump(spark, dump)
    revisions = pipelines.revisions_from_dump(pages, readers.read_names(spark, "/nowhere/bots.txt"))
    rows = {r.revision_id: r for r in revisions.collect()}
    assert sorted(rows) == [11, 12, 13, 15]
    assert rows[11].citation_count == 1 and rows[11].raw_text_len == len("First text of Ann.<ref>a</ref> ")
    assert rows[12].is_anonymous and rows[12].username == "1.2.3.4" and rows[13].is_bot
    assert (rows[12].parent_revision_id, rows[15].parent_revision_id) == (11, 13)
    histories = pipelines.page_histories(revisions)
    assert [r["revision_id"] for r in histories.first().revisions] == [11, 15]
    articles, authors = pipelines.scores(histories)
    a = articles.first()
    assert a.page_id == "1" and a.n_users == 2 and a.converged
    assert sum(r.score for r in authors.collect()) == pytest.approx(1, abs=1e-6)


def test_listing_and_resolution(spark, dump, tmp_path):
    assert [p.rpartition("/")[2] for p in readers.listed(spark, str(tmp_path))] == ["a.xml.bz2"]
    with pytest.raises(FileNotFoundError):
        readers.listed(spark, str(tmp_path), (".jsonl",))
    with pytest.raises(FileNotFoundError):
        readers.listed(spark, str(tmp_path / "none"))
    assert readers.resolved(spark, None, [str(tmp_path / "none"), dump]) == dump
    with pytest.raises(FileNotFoundError):
        readers.resolved(spark, str(tmp_path / "none"), [dump])


def test_malformed_lines_follow_the_policy(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    path.write_text('{"text": "a", "label": 1}\n\n{bad\n{"text": "b"}\n')
    schema = "text STRING, label INT"
    assert readers.read_jsonl(spark, str(path), schema, "skip").count() == 2
    counted = readers.read_jsonl(spark, str(path), schema, "count").cache()
    assert counted.where("_corrupt_record is not null").count() == 1
    with pytest.raises(Exception, match="MALFORMED|malformed|Malformed"):
        readers.read_jsonl(spark, str(path), schema).collect()


def test_examples_name_the_first_broken_rule(spark, tmp_path):
    path = tmp_path / "x.jsonl"
    lines = [
        {"text": "good one", "label": 1, "perplexity_score": 2.5},
        {"text": "quoted", "label": "1", "perplexity_score": 1},
        {"text": "cut", "label": 1.9, "perplexity_score": 1},
        {"text": "true", "label": True, "perplexity_score": 1},
        {"text": "%%", "label": 0, "perplexity_score": 1},
        {"label": 0},
        {"text": "inf", "label": 0, "perplexity_score": float("inf")},
        {"text": "bad", "label": 5, "perplexity_score": 1},
    ]
    path.write_text("\n".join(json.dumps(x) for x in lines) + "\n \n{oops\n")
    train = {r.source_line: r.rule for r in readers.parsed_examples(readers.numbered_lines(spark, str(path))).collect()}
    assert train == {1: None, 2: "bad_label", 3: "bad_label", 4: None, 5: "empty_text", 6: "missing_fields", 7: None, 8: "bad_label", 9: "blank", 10: "bad_json"}
    prompt = {r.source_line: r.rule for r in readers.parsed_examples(readers.numbered_lines(spark, str(path)), "prompting").collect()}
    assert prompt[2] is None and prompt[3] is None and prompt[7] == "bad_perplexity"
    rows, counts = readers.load_examples(spark, str(path))
    assert rows.count() == 3 and {r.rule: r.n for r in counts.collect()}["valid"] == 3


def test_line_numbers_of_many_partitions(spark, tmp_path):
    path = tmp_path / "many.txt"
    path.write_text("".join(f"{i}\n" for i in range(1, 5001)))
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = readers.numbered_lines(spark, str(path))
        assert rows.count() == 5000 and rows.where("cast(line as long) <> source_line").count() == 0
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_csv_round_trip_with_line_breaks_and_quotes(spark, tmp_path):
    rows = spark.createDataFrame([("1", 'a "q"\nb, c')], "id string, raw_text string")
    writers.write_csv(rows, str(tmp_path / "c"), "bzip2")
    back = readers.read_csv(spark, str(tmp_path / "c"), "id STRING, raw_text STRING", ("id", "raw_text"))
    assert [tuple(r) for r in back.collect()] == [("1", 'a "q"\nb, c')]
    with pytest.raises(ValueError, match="missing columns: other"):
        readers.read_csv(spark, str(tmp_path / "c"), "id STRING", ("other",))
    with pytest.raises(ValueError):
        writers.write_csv(rows.limit(0), str(tmp_path / "d"))


def test_writers_overwrite_and_null_non_finite_values(spark, tmp_path):
    rows = spark.createDataFrame([(1.0,), (float("nan"),), (float("inf"),)], "x double")
    for _ in range(2):
        writers.write_jsonl(rows, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 3
    assert [r.x for r in writers.null_for_non_finite(rows).collect()] == [1.0, None, None]
    writers.write_metrics(rows, str(tmp_path / "m"))
    assert spark.read.json(str(tmp_path / "m" / "json")).count() == 3


def test_names(spark, tmp_path):
    (tmp_path / "n.txt").write_text(" a \n\nb\na\n")
    assert sorted(r.value for r in readers.read_names(spark, str(tmp_path / "n.txt")).collect()) == ["a", "b"]


def test_ingestion_takes_each_file_once(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text('{"text": "a", "label": 1}\n')

    def run():
        return ingest(spark, str(source), "text STRING, label INT", str(tmp_path / "out"), str(tmp_path / "check"), log=str(tmp_path / "log"))

    assert run() == 1
    assert run() == 0
    (source / "b.jsonl").write_text('{"text": "b", "label": 0}\n')
    assert run() == 1
    assert sorted(r.text for r in ingested(spark, str(tmp_path / "out")).collect()) == ["a", "b"]
    assert spark.read.parquet(str(tmp_path / "log")).agg(F.sum("rows")).first()[0] == 2


def test_schemas_parse(spark):
    for ddl in (schemas.PAGE, schemas.REVISION, schemas.PAGE_HISTORY, schemas.ARTICLE_SCORES, schemas.AUTHOR_SCORES, schemas.LATEST, schemas.SENTENCE_PAGES, schemas.EXAMPLES):
        assert spark.createDataFrame([], ddl).columns
