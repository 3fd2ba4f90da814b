"""Texts that the given tables don't hold: empty, blank, none."""

import pytest

from sparkloom.sources import files
from tests.test_larger_tables import same

ODD = [(1, "abc"), (2, ""), (3, None), (4, "  \n"), (5, "中\r\n\x00")]


@pytest.mark.parametrize("rows", [ODD, [(2, "")], [(3, None)]], ids=["mixed", "empty", "none"])
def test_every_document_has_its_text(spark, tmp_path, rows):
    same(spark, tmp_path, "scan_remote_parsers", documents=spark.createDataFrame(rows, "doc_id long, text string"))


def test_only_an_empty_file_passes_without_text():
    lost = lambda data, kind: [""]
    assert files.cascade(b"", "txt", [files.parsed], any) == [""]
    assert files.cascade(b"x", "txt", [lost, files.parsed], any) == ["x"]
    for data, provider in ((b"x", lost), (b"", lambda data, kind: []), (b"", lambda data, kind: ["made up"])):
        with pytest.raises(ValueError, match="rejected"):
            files.cascade(data, "txt", [provider], lambda pages: False)
