import random

import pytest
from conftest import rows
from strata.sources import csv_blocks as B
from strata.sources import readers as R


def nasty(rng, n):
    """Records of a CSV file with quoted newlines, quotes, commas, carriage returns and stray quotes."""
    out = []
    for i in range(n):
        text = rng.choice(['plain', '"a\nb"', '"x,""y"",\r\nz"', '""', '', '5" pipe', 'it"s, ', '"\n\n\n"', '"' + "long\n" * 30 + '"',
                           '"""q"""', '"end"', ' "blank before', '"é\n日本"'])
        out.append(f"{i},{text if text != 'it' + chr(34) + 's, ' else 'it' + chr(34) + 's'},{rng.random():.3f}")
    return out


def both(spark, path, block, **how):
    return (R._scan_files(spark, path, R.ENCODINGS), B.read_blocks(spark, path, R.CSV_OPTIONS, block, **how))


@pytest.mark.parametrize("block,piece,end", [(97, 1 << 20, "\n"), (256, 1 << 20, "\r\n"), (97, 20, "\r\n"), (300, 0, "\n")])
def test_blocks_equal_the_reader_of_whole_files(spark, tmp_path, block, piece, end):
    rng = random.Random(block)
    for k in range(2):
        body = end.join(['id,"a ""text""",v', *nasty(rng, 120)]) + (end if k else "")
        (tmp_path / f"p{k}.csv").write_bytes(body.encode())
    whole, blocks = both(spark, str(tmp_path), block, piece_bytes=piece)
    assert whole.columns == blocks.columns
    assert rows(whole) == rows(blocks) and whole.count() == 240
    assert len({r["file_name"] for r in blocks.selectExpr("_metadata.file_name AS file_name").distinct().collect()}) > 1


def test_record_and_header_longer_than_blocks(spark, tmp_path):
    head = '"' + "name\n" * 40 + '",b'
    body = "\n".join([head, "1,2", '"' + "cell, with\n" * 90 + '",3', "4,5", "", '6,"x\n"'])
    (tmp_path / "t.csv").write_text(body)
    whole, blocks = both(spark, f"{tmp_path}/t.csv", 64)
    assert whole.columns == blocks.columns and rows(whole) == rows(blocks) and whole.count() == 4


def test_encodings_and_types_through_scan_csv(spark, tmp_path):
    text = "k,s,v\n" + "".join(f'{i},"é\n{i}",{i / 2}\n' for i in range(200)) + "200,NA,\n"
    (tmp_path / "l.csv").write_bytes(text.encode("latin-1"))
    (tmp_path / "u.csv").write_bytes(text.encode())
    for name in ("l", "u"):
        small = R.scan_csv(spark, f"{tmp_path}/{name}.csv")
        large = R.scan_csv(spark, f"{tmp_path}/{name}.csv", block_bytes=300)
        assert small.dtypes == large.dtypes == [("k", "bigint"), ("s", "string"), ("v", "double")]
        assert rows(small) == rows(large) and large.count() == 201
    with pytest.raises(ValueError):
        R.scan_csv(spark, f"{tmp_path}/l.csv", encodings=("utf-8",), block_bytes=300)
    assert rows(R.scan_csv(spark, str(tmp_path), block_bytes=300), "k", "s", "v") == rows(
        R.scan_csv(spark, str(tmp_path)), "k", "s", "v")


def test_settings_are_put_back(spark, tmp_path):
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    (tmp_path / "t.csv").write_text("a\n" + "1\n" * 500)
    assert R.scan_csv(spark, f"{tmp_path}/t.csv", block_bytes=100).count() == 500
    assert spark.conf.get("spark.sql.files.maxPartitionBytes") == before
    assert spark.conf.get("spark.sql.files.minPartitionNum", None) is None


def test_header_only_file_is_refused(spark, tmp_path):
    (tmp_path / "h.csv").write_text("a,b" + "c" * 200 + "\n")
    with pytest.raises(ValueError):
        R.scan_csv(spark, f"{tmp_path}/h.csv", block_bytes=50)


@pytest.mark.parametrize("line,out,inside", [
    (b"", False, True), (b"a,b", False, True), (b'"a', True, False), (b'a"', False, False), (b'a,"b', True, False),
    (b'"a""', True, False), (b'"a"",', True, False), (b'"a",b', False, False), (b'x,"a","', True, True), (b'"', True, False),
    (b'""', False, True), (b'5" x', False, False)])
def test_state_at_the_end_of_a_line(line, out, inside):
    assert B.ends_inside(line, False) is out
    assert B.ends_inside(line, True) is inside


def test_many_blocks_are_read_by_few_tasks(spark, tmp_path):
    n = 4 * spark.sparkContext.defaultParallelism
    lines = [f'{i},"text {i:05d}\nof two lines and some more that fills the block"' for i in range(20 * n)]
    (tmp_path / "p.csv").write_text("\n".join(["id,t", *lines]))
    whole, blocks = both(spark, str(tmp_path), 300)
    files = spark.read.format("binaryFile").load(str(tmp_path)).selectExpr("length div 300").first()[0]
    assert files > 3 * n  # so many blocks, of which each was a task and left a file of rows
    assert len([f for f in blocks.inputFiles()]) <= n + int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert rows(whole) == rows(blocks) and blocks.count() == 20 * n
