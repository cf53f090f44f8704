import os

import pytest

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")


@pytest.fixture()
def frame(spark):
    from citeflow.llm.common import ship_code
    ship_code(spark)

    def make(rows, schema):
        return spark.createDataFrame(rows, schema)
    return make
