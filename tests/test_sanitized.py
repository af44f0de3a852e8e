from pyspark.sql import functions as F

from quillmark.operators import agent, chunking

NESTED = '{"a": {"api-key": "x", "b": [{"My-Password": 1, "c": 1.50}, [true, null]]}, "Access-Token": "y", " secret ": {"d": 1}, "n": 7, "s": "é{\\"password\\":1}", "t": true, "z": null}'


def test_secret_keys_go_at_any_depth(spark):
    rows = [(NESTED,), ('[{"cookie": 1, "k": 2}]',), ("{broken",), (None,), ("{}",)]
    got = [r[0] for r in spark.createDataFrame(rows, "j string").coalesce(1).select(agent.sanitized(F.col("j"))).collect()]
    assert got == ['{"a":{"b":[{"c":1.50},[true,null]]},"n":"7","s":"é{\\"password\\":1}","t":"true","z":null}', '[{"k":2}]', None, None, "{}"]


def test_a_nested_secret_does_not_change_the_fingerprint(spark):
    bodies = [('{"a": {"b": 1, "api-key": "x"}}',), ('{"a": {"b": 1, "api-key": "y"}}',), ('{"a": {"b": 2}}',)]
    got = [r[0] for r in spark.createDataFrame(bodies, "j string").coalesce(1).select(chunking.request_fingerprint(F.lit("m"), F.lit("e"), F.col("j"))).collect()]
    assert got[0] == got[1] != got[2]
