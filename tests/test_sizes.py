"""Queries on rows far beyond those of the small tables."""

from gridloom.plans import registry


def part(spark, folder, keys):
    rows = [(k, f"n{k}", "b", f"t{k % 3}", 1 + k % 50, 900.0 + k % 1000) for k in keys]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int, p_retailprice double").write.parquet(f"{folder}/part.parquet")


def test_container_holds_rows_beyond_16_bits(spark, tmp_path):
    part(spark, tmp_path, [0, 819_174, 819_200, 1_199_999])
    got = registry.queries()["q_lstb_round_trip"](spark, str(tmp_path)).collect()
    assert sorted(r.row for r in got) == [0, 32_766, 32_768, 47_999]


def test_degrees_beyond_the_poles_come_back(spark, tmp_path):
    part(spark, tmp_path, [3, 154_999, 155_003, 155_030, 400_013, 605_001, 1_199_999])
    for r in registry.queries()["q_utm_inverse"](spark, str(tmp_path)).collect():
        assert (r.lat, r.lon) == (round(28 + r.cell_id // 25 * 0.01, 7), round(77 + r.cell_id % 25 * 0.01, 7))
