from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logtable.functions import words
from logtable.functions.keccak import keccak256
from logtable.functions.signatures import SIGNATURES
from logtable.operators.ingest import seed_hash
from logtable.sources.assets import default_assets
from rows import word

UNSIGNED = [0, 7, 2**64 - 1, 2**64, 345020000000, 2**126 - 1, 2**128, 10**77, 2**255, 2**256 - 1]
SIGNED = [-1, -655000000, -(2**255), -(2**64), 1 - 2**64, -(2**64) - 1, 2**255 - 1, 0, 5, 2**64]


def decoded(spark, function, values):
    rows = spark.createDataFrame([(i, word(v)) for i, v in enumerate(values)], "i int, w string")
    return [r["v"] for r in rows.select("i", function(F.col("w")).alias("v")).orderBy("i").collect()]


def test_unsigned(spark):
    assert decoded(spark, words.uint256_text, UNSIGNED) == list(map(str, UNSIGNED))


def test_signed(spark):
    assert decoded(spark, words.int256_text, SIGNED) == list(map(str, SIGNED))


@settings(max_examples=4, deadline=None)
@given(st.lists(st.integers(0, 2**256 - 1), min_size=50, max_size=100))
def test_any_word(spark, values):
    assert decoded(spark, words.uint256_text, values) == list(map(str, values))
    signed = [v - (1 << 256) if v >> 255 else v for v in values]
    assert decoded(spark, words.int256_text, values) == list(map(str, signed))


def test_null_word_and_filter(spark):
    rows = spark.createDataFrame([(None,), (word(2**200),)], "w string")
    kept = rows.select(words.uint256_text(F.col("w")).alias("u"), words.int256_text(F.col("w")).alias("s"))
    assert sorted(map(tuple, kept.collect()), key=str) == [(str(2**200),) * 2, (None, None)]
    assert rows.filter(words.uint256_text(F.col("w")) == str(2**200)).count() == 1


def test_hex_checks(spark):
    texts = ["0x" + "ab" * 32, "0x" + "AB" * 32, "0x" + "zz" * 32, "ab" * 33, None, "0x"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    assert [r[0] for r in rows.select(words.is_prefixed_hex(F.col("t"), 64)).collect()] == [
        True, True, False, False, False, False,
    ]


def test_short_hash_and_companion(spark):
    rows = spark.createDataFrame([("0x" + "ab" * 32,), ("0x12345678901",), (str(2**200),)], "t string")
    out = rows.select(words.short_hash(F.col("t")), words.numeric_companion(F.col("t"))).collect()
    assert out[0][0] == "0xabab…abab" and out[1][0] == "0x12345678901" and out[2][1] is None


def test_keccak_against_known_values():
    for asset in default_assets():
        assert "0x" + keccak256(asset["symbol"].encode()).hex() == asset["asset_id"]
    for signature in SIGNATURES.values():
        text = f"{signature.name}({','.join(a.type for a in signature.arguments)})"
        assert "0x" + keccak256(text.encode()).hex() == signature.topic
    first = default_assets()[0]
    assert seed_hash(first["asset_id"], first["aggregator"]) == (
        "0xc6bdc9520b776c0bf62542ff173208bb006a8d252ade9cb755d5a05cf22b002d"
    )
    assert keccak256(b"a" * 300) != keccak256(b"a" * 301)
