import pytest
from pyspark.sql import functions as F

from casekit.operators import models
from casekit.operators.batches import in_batches


def limited(k, seen, tokens=10**9, error=MemoryError):
    def call(batch):
        seen.append(len(batch))
        if len(batch) > k or len(batch) * max(map(len, batch)) > tokens:
            raise error("CUDA out of memory" if error is RuntimeError else "no")
        return [[len(t), t.count("a")] for t in batch]

    return call


@pytest.mark.parametrize("error", [MemoryError, RuntimeError])
def test_a_call_that_fails_above_k_texts_gives_the_whole_result(error):
    texts = ["a" * (i * 7 % 23) + "b" for i in range(100)]
    seen = []
    out = in_batches(limited(5, seen, error=error), texts, 64)
    assert [list(r) for r in out] == [[len(t), t.count("a")] for t in texts]
    assert seen[:5] == [64, 32, 16, 8, 4] and max(seen[5:]) <= 4 and len(seen) <= 4 + 25


def test_batches_by_tokens_and_long_texts():
    seen = []
    texts = ["x" * 4000, "y", "z" * 400, *["s"] * 50]
    out = in_batches(limited(100, seen, 4000), texts, 40, tokens=1000)
    assert [int(r[0]) for r in out] == [len(t) for t in texts] and seen == [1, 10, 40, 2]


def test_errors_that_halving_does_not_mend():
    with pytest.raises(MemoryError):
        in_batches(limited(0, []), ["a", "b"])
    with pytest.raises(RuntimeError, match="broken"):
        in_batches(lambda b: (_ for _ in ()).throw(RuntimeError("broken")), ["a", "b"])
    with pytest.raises(ValueError, match="1 results for 2"):
        in_batches(lambda b: [1], ["a", "b"])
    assert in_batches(lambda b: 1 / 0, []) == []


def test_predictors_and_encoders_on_spark(spark):
    def make():
        def predict(batch):
            if len(batch) > 3:
                raise MemoryError
            return [[float(len(t)), 1.0] for t in batch]

        return predict

    df = spark.createDataFrame([(i, "t" * i) for i in range(40)] + [(40, None)], "id int, t string").coalesce(1)
    got = {r.id: r.p for r in df.select("id", models.scored(F.col("t"), make).alias("p")).collect()}
    assert got == {i: [float(i % 40), 1.0] for i in range(41)}
    also = {r.id: r.p for r in models.score_texts(df, {"t": "p"}, make).collect()}
    assert also == got
