"""Structural patterns count as Python's Unicode regexes do; the scratch folder rule."""

import re

import pytest
from pyspark.sql import functions as F

from sievekit.functions import constants as K
from sievekit.functions.structural import counters
from sievekit import session as S


def test_structural_counts_equal_python_regexes(spark):
    texts = ["void 函数(int a) {", "*变量 变量[1] ñ->x", "class Été { template <T> for (a; for (", "int f(x) { if (a) while(b) #include <é> }"]
    df = spark.createDataFrame([(i, [(f"{i}.cpp", t)]) for i, t in enumerate(texts)],
                               "design_idx int, files array<struct<file_name:string,file_content:string>>")
    got = df.select("design_idx", *[v.alias(k) for k, v in counters(F.col("files")).items()]).collect()
    for row in got:
        for name, pattern in K.STRUCTURAL_PATTERNS:
            assert row[name] == len(list(re.finditer(pattern, texts[row.design_idx]))), (name, texts[row.design_idx])


class _Cluster:
    master = "spark://somewhere:7077"

    @staticmethod
    def getCheckpointDir():
        return None


class _Session:
    sparkContext = _Cluster()

    class conf:
        @staticmethod
        def get(key, default=None):
            return default


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        S.ensure_checkpoint_dir(_Session())


def test_round_tables_are_removed(spark):
    import os

    from sievekit.operators import dedup as D
    t = D._checkpoint(spark.range(3))
    assert os.path.isdir(t._scratch_path.removeprefix("file:"))
    D.release(t)
    assert not os.path.exists(t._scratch_path.removeprefix("file:"))
