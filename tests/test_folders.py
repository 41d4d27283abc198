"""Tables that are folders of files give what single files give."""

import shutil
from pathlib import Path

import pytest

import oracle_check

SF_DIR = "/root/testdata/sf0.001"

pytestmark = pytest.mark.skipif(not Path(SF_DIR).exists(), reason="test tables are not here")


@pytest.fixture(scope="module")
def folders(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("folders")
    for file in Path(SF_DIR).glob("*.parquet"):
        if file.stem in ("documents", "part"):
            spark.read.parquet(str(file)).repartition(3).write.parquet(str(path / file.name))
        else:
            shutil.copy(file, path / file.name)
    return str(path)


@pytest.mark.parametrize("name", ["discover_files", "incremental_ingest", "incremental_pages"])
def test_equal(spark, folders, name):
    assert oracle_check.compare(spark, oracle_check.connect(SF_DIR), folders, name) is None
