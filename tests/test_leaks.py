"""Every kind of leak is counted, and nothing else."""

from quernstone.operators.leaks import forbidden_columns, known_leaks, pattern_leaks


def test_patterns(spark):
    rows = [("P12345", None), ("Q9ABC1 x", "ghp_" + "a" * 20), ("xP12345", "bearer  abc.def"), ("A" * 50, "C:\\Users\\x"), ("A" * 49, "/home/x"), ("a" * 64, "0" * 63 + "g"), ("0" * 65, "authorization :"), ("AKIA" + "Z" * 16, "Cookie")]
    got = {(r["column"], r["rule"]): r["rows"] for r in pattern_leaks(spark.createDataFrame(rows, "a string, b string")).collect()}
    assert {k: n for k, n in got.items() if n} == {("a", "accession"): 2, ("a", "sequence"): 1, ("a", "row_hash"): 1, ("a", "secret"): 1, ("b", "secret"): 3, ("b", "private_path"): 2}
    assert len(got) == 10 and len(pattern_leaks(spark.createDataFrame(rows, "a string, b string"), ["b"], allow_hashes=True).collect()) == 4


def test_known_values(spark):
    secret = "ACDEFGHIKLMNPQRSTVWYACDEF"
    rows = [("see Item#7, or not", None), ("Item#77", "x" + secret + "y"), ("(Item#7) Item#7", "KK" + secret + "KK"), (secret[:-1], secret[:20] + "W"), (None, None), (secret + " Item#8|x", secret)]
    frame = spark.createDataFrame(rows, "a string, b string").repartition(3)
    names = spark.createDataFrame([("Item#7",), ("Item#7",), (None,), ("Item#8|x",)], "value string")
    sequences = spark.createDataFrame([(secret,), ("ACD",), (None,)], "value string")
    got = {(r["column"], r["rule"]): r["rows"] for r in known_leaks(frame, names, sequences).collect()}
    assert got == {("a", "known_name"): 3, ("a", "known_sequence"): 1, ("b", "known_name"): 0, ("b", "known_sequence"): 3}
    assert {r["rows"] for r in known_leaks(frame.limit(0), names, sequences).collect()} == {0}


def test_columns(spark):
    frame = spark.createDataFrame([(1, 2, 3)], "rows int, Accession int, more int")
    assert forbidden_columns(frame, ["rows", "Accession"]) == ["Accession", "more"]
