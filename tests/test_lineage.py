"""Paged scans: coordinates of rows, and every kind of fault."""

import gzip

import pytest

from quernstone.sources.lineage import MANIFEST, page_manifest, read_pages

COLUMNS = ["id", "name"]


@pytest.fixture
def pages(spark, tmp_path):
    texts = {1: "id\tname\n1\ta\n2\té\n", 2: "id\tname\n", 3: "id\tname\n3\t\n"}
    for k, text in texts.items():
        (tmp_path / f"p{k}.tsv.gz").write_bytes(gzip.compress(text.encode(), mtime=0))
    listed = spark.createDataFrame([(k, f"p{k}.tsv.gz") for k in texts], "page int, name string")
    # as it is before a page is spoilt
    return tmp_path, spark.createDataFrame(page_manifest(spark, str(tmp_path), listed).collect(), MANIFEST)


def test_rows_know_their_place(spark, pages):
    path, manifest = pages
    got = sorted(tuple(r) for r in read_pages(spark, str(path), manifest, COLUMNS).collect())
    assert got == [(1, 1, "1", "a"), (1, 2, "2", "é"), (3, 1, "3", "")]


def spoil(path, text=None, flip=False):
    at = path / "p1.tsv.gz"
    body = bytearray(at.read_bytes())
    if flip:
        body[4] ^= 1  # the time in the header: the text stays the same
        at.write_bytes(body)
    else:
        at.write_bytes(gzip.compress(text.encode(), mtime=0))


@pytest.mark.parametrize("text,message", [("id\tname\n1\ta\n", "1 rows, not 2"), ("id\tname\tmore\n1\ta\tx\n2\té\tx\n", "header"), ("id\tname\n1\ta\tx\n2\té\n", "row 1 has 3 cells"), ("id\tname\n1\ta\n2\té", "line feed"), ("id\tname\r\n1\ta\r\n2\té\r\n", "line feed")])
def test_faults_of_a_page_with_right_digests(spark, pages, text, message):
    path, manifest = pages
    spoil(path, text)
    listed = page_manifest(spark, str(path), manifest.select("page", "name"))
    with pytest.raises(Exception, match=message):
        read_pages(spark, str(path), listed.drop("rows").join(manifest.select("name", "rows"), "name"), COLUMNS).collect()


def test_flipped_bytes_and_files_that_do_not_match(spark, pages):
    path, manifest = pages
    with pytest.raises(Exception, match="the text's digest"):
        read_pages(spark, str(path), manifest.replace(manifest.first()["text_sha256"], "0" * 64), COLUMNS).collect()
    (path / "p4.tsv").write_text("id\tname\n")
    with pytest.raises(Exception, match="p4.tsv is not in the manifest"):
        read_pages(spark, str(path), manifest, COLUMNS).collect()
    (path / "p4.tsv").unlink()
    spoil(path, flip=True)
    with pytest.raises(Exception, match="the file's digest"):
        read_pages(spark, str(path), manifest, COLUMNS).collect()
    (path / "p1.tsv.gz").unlink()
    with pytest.raises(Exception, match="p1.tsv.gz is missing"):
        read_pages(spark, str(path), manifest, COLUMNS).collect()
