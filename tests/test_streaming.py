"""Records checked as they arrive."""

from hyperloom.operators import overlap, search, validate
from hyperloom.streaming import arrivals

SCHEMA = "id long, f1 string, f2 string, f3 string, f4 string, f5 string"


def test_arrivals(spark, tmp_path):
    stored = spark.createDataFrame([(i, str(i % 3), str(i % 4), "x", str(i), str(i)) for i in range(24)], SCHEMA)
    fresh = [(100 + i, str(i % 3), str(i % 4), "y", str(i), "z") for i in range(6)]
    spark.createDataFrame(fresh[:3], SCHEMA).write.parquet(f"{tmp_path}/in/a")
    spark.createDataFrame(fresh[3:], SCHEMA).write.parquet(f"{tmp_path}/in/b")
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = arrivals.watch(stream, stored, f"{tmp_path}/out", f"{tmp_path}/checkpoint")
    query.awaitTermination(120)
    got = {(r.id, r.match, r.k) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    both = stored.union(spark.createDataFrame(fresh, SCHEMA))
    want = {(r.j, r.i, r.k) for r in overlap.sharing_pairs(both, 2).where("i < 100 and j >= 100").collect()}
    assert got == want and got


def test_search(spark):
    table = spark.createDataFrame([("a", 1, [1, 1, 1, 1]), ("b", 1, [1, 1, 1, -1]), ("c", 2, [1, 1, 1, 1]), ("d", 1, [-1, -1, 1, 1])], "symbol_id string, seed int, vector array<int>")
    found = search.nearest(table, [1, 1, 1, 1], 2, "seed = 1").collect()
    assert [(r.symbol_id, round(r.distance, 12)) for r in found] == [("a", 0.0), ("b", 0.5)]


def test_rules(spark):
    vectors = spark.createDataFrame([(1, [1, 2]), (2, [1, 2]), (3, [1])], "id int, vector array<int>")
    got = {r.rule: r.violations for r in validate.vector_shapes(vectors, 2).union(validate.distinct_vectors(vectors, [])).union(validate.same_vectors(vectors, vectors, ["id"])).collect()}
    assert got == {"wrong_length": 1, "repeated_vectors": 1, "different": 0}
    codes = spark.createDataFrame([(0, 0), (1, 1), (2, 1), (4, 3)], "id int, c int")
    got = {r.rule: r.violations for r in validate.contiguous(codes, "id").union(validate.spanning(codes, {"c": 4})).union(validate.duplicates(codes, ["c"])).collect()}
    assert got == {"repeated": 0, "not_from_zero": 0, "gaps": 1, "c_span": 0, "duplicates": 1}
    curves = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "k string, x int")
    assert validate.complete_curves(curves, ["k"], "x", 2).first().violations == 1
