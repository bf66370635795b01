from collections import Counter

from pyspark.sql import functions as F

from slink.operators import values


def cells(spark):
    """Texts that share a head of 64 characters, tie in count, equal their head, or are null or empty."""
    head = "h" * 64
    texts = [head + tail for tail in ("", "b", "a", "c", "ä", "aa")] + [head] * 2 + [head + "twice"] * 2
    texts += ["x" * 1000 + str(i) for i in range(40)] + ["x" * 1000 + "7"] * 20 + ["short"] * 5 + ["", "", None, None, "ß" * 70]
    return texts, spark.createDataFrame([(t, "k") for t in texts], "text string, kind string").repartition(6)


def brute(texts, n):
    counted = Counter(t for t in texts if t is not None)
    return sorted(counted.items(), key=lambda e: (-e[1], e[0].encode()))[:n]


def test_top_whole_values_equal_a_full_count(spark):
    texts, df = cells(spark)
    for n in (1, 3, 6, 9, 30, 1000):
        found = values.top_whole_values({"t": df}, n).filter("column_name = 'TEXT'").orderBy("value_rank").collect()
        assert [(r["value"], r["n"]) for r in found] == brute(texts, n), n
        assert [r["value_rank"] for r in found] == list(range(1, len(found) + 1))
    assert values.top_whole_values({"t": df.limit(0)}, 3).count() == 0


def test_counting_by_digest_counts_the_same(spark):
    texts, df = cells(spark)
    counted = values.value_counts({"t": df}, 65, F.md5).filter("column_name = 'TEXT'")
    found = counted.select(F.coalesce("digest", F.md5("value")).alias("d"), "n", F.length("value").alias("chars")).collect()
    full = values.value_counts({"t": df}).filter("column_name = 'TEXT'").select(F.md5("value").alias("d"), "n").collect()
    assert sorted((r["d"], r["n"]) for r in found) == sorted((r["d"], r["n"]) for r in full)
    assert max(r["chars"] or 0 for r in found) <= 64


def test_no_long_text_is_a_shuffle_key(spark):
    """Rows are exchanged by column, head and digest; the texts read again are joined by broadcast."""
    _, df = cells(spark)
    plan = values.top_whole_values({"t": df}, 3)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]
    assert exchanges and not any("hashpartitioning(value" in line for line in exchanges)
    assert "BroadcastHashJoin" in plan
