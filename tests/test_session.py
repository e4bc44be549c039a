import os

import pytest

from lexlode.operators.graph import hops
from lexlode.session import clear_cuts, cut, discard, shared_dir, spread


def test_cut_and_discard(spark):
    df = cut(spark.range(5), "five")
    own = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}"
    assert df.count() == 5 and any(n.startswith("five-") for n in os.listdir(own))
    other = cut(df, "other")
    discard(df, spark.range(1))
    assert other.count() == 5 and not any(n.startswith("five-") for n in os.listdir(own))
    clear_cuts(spark)
    assert not os.path.exists(own)
    clear_cuts(spark)


def test_anchors_survive_hops(spark):
    anchors = cut(spark.createDataFrame([(1, "a")], "query_id long, label string"), "anchors")
    edges = spark.createDataFrame([("a", "b"), ("b", "c")], "node_a string, node_b string")
    assert hops(anchors, edges).count() == 3 and anchors.count() == 1


def test_spread(spark):
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        master = "spark://host:7077"

        def getConf(self):
            return Conf()

    class Session:
        sparkContext, conf = Context(), Conf()

    with pytest.raises(ValueError):
        shared_dir(Session())
