"""Work a part is done by many tasks, however few splits the table has."""

from loomshed.plans import sources
from loomshed.session import ship

SF = "/root/testdata/sf0.001"


def test_parts_are_dealt_out_before_their_frames_are_made(spark):
    ship(spark)
    assert sources.raw_frames(spark, SF).rdd.getNumPartitions() > 1
    assert sources.hash_chains(spark, SF).rdd.getNumPartitions() > 1
