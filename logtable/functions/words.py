"""256-bit EVM words as Spark columns: hex in, canonical base-10 text out, and back.

A *word* is 64 lowercase hex digits without the ``0x`` prefix. Values up to 2**256-1 do not fit
any Spark numeric type, so the canonical form is a base-10 string. Everything here is built-in
expression arithmetic, no UDF. Words below 2**64, nearly all there are, take a short path; the
full-range path is evaluated for the others only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HEX_DIGITS = "0123456789abcdef"
INVERTED_HEX_DIGITS = HEX_DIGITS[::-1]
ZERO_WORD = "0" * 64
ZERO_HASH = "0x" + ZERO_WORD

_LIMB = 10**9
_CHUNK_BITS = 28


def is_hex(text: Column, digits: int) -> Column:
    """True for exactly ``digits`` hex digits; never null, never an error."""
    ok = (F.length(text) == digits) & F.unhex(text).isNotNull()
    return F.coalesce(ok, F.lit(False))


def is_prefixed_hex(text: Column, digits: int) -> Column:
    """True for ``0x`` followed by exactly ``digits`` hex digits."""
    ok = F.startswith(text, F.lit("0x")) & is_hex(F.substr(text, F.lit(3)), digits)
    return F.coalesce(ok, F.lit(False))


def canonical_hex(text: Column) -> Column:
    return F.lower(text)


def topic_word(topic: Column) -> Column:
    return F.substr(topic, F.lit(3))


def data_word(data: Column, index: int) -> Column:
    """The ``index``-th 32-byte word of a ``0x``-prefixed data field."""
    return F.substr(data, F.lit(3 + 64 * index), F.lit(64))


def word_to_address(word: Column) -> Column:
    return F.concat(F.lit("0x"), F.right(word, F.lit(40)))


def word_to_hash(word: Column) -> Column:
    return F.concat(F.lit("0x"), word)


def _let(name: str, value: str, body: str) -> str:
    """SQL for ``body`` over a value that is computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _wide_sql(plus: int) -> str:
    """SQL lambda from a word to the base-10 text of its value plus ``plus``.

    Five 56-bit pieces become ten 28-bit chunks; these are weighted into nine base-10**9 limbs
    whose carries are settled last. A limb sum stays below 10 * 2**28 * 10**9 < 2**62, so bigint
    arithmetic never overflows.
    """
    spans = [(max(51 - 14 * i, 1), 65 - 14 * i - max(51 - 14 * i, 1)) for i in range(5)]
    pieces = [f"bigint(conv(substr(w, {start}, {length}), 16, 10))" for start, length in spans]
    mask = (1 << _CHUNK_BITS) - 1
    chunks = [f"p[{i // 2}] & {mask}L" if i % 2 == 0 else f"shiftright(p[{i // 2}], {_CHUNK_BITS})" for i in range(10)]
    chunks[0] = f"({chunks[0]}) + {plus}L"
    sums = []
    for k in range(9):
        weights = [(1 << (_CHUNK_BITS * i)) // _LIMB**k % _LIMB for i in range(10)]
        sums.append(" + ".join(f"c[{i}] * {weight}L" for i, weight in enumerate(weights) if weight))
    carry, limbs = "0L", []
    for k in range(9):
        total = f"(s[{k}] + {carry})"
        limbs.append(f"lpad(string({total} % {_LIMB}L), 9, '0')")
        carry = f"({total} div {_LIMB}L)"
    text = f"ltrim('0', concat({', '.join(reversed(limbs))}))"
    settled = _let("s", f"array({', '.join(sums)})", text)
    weighted = _let("c", f"array({', '.join(chunks)})", settled)
    return f"w -> {_let('p', f'array({", ".join(pieces)})', weighted)}"


def _wide_text(word: Column, plus: int = 0) -> Column:
    """Full-range path, for the rare words of 2**64 and above."""
    return F.get(F.call_function("transform", F.array(word), F.expr(_wide_sql(plus))), 0)


def _is_narrow(word: Column) -> Column:
    return F.startswith(word, F.lit("0" * 48))


def _low_text(word: Column) -> Column:
    return F.conv(F.right(word, F.lit(16)), 16, 10)


def uint256_text(word: Column) -> Column:
    """Unsigned word -> base-10 text. Values below 2**64 take a one-call fast path."""
    wide = F.when(word.isNotNull(), _wide_text(word))
    return F.when(_is_narrow(word), _low_text(word)).otherwise(wide)


def int256_text(word: Column) -> Column:
    """Two's-complement word -> signed base-10 text."""
    inverted = F.translate(word, HEX_DIGITS, INVERTED_HEX_DIGITS)
    low = _low_text(inverted).cast("decimal(20,0)") + F.lit(1)
    minus = F.lit("-")
    return (
        F.when(_is_narrow(word), _low_text(word))
        .when(F.startswith(word, F.lit("f" * 48)), F.concat(minus, low.cast("string")))
        .when(word < F.lit("8"), _wide_text(word))
        .when(word.isNotNull(), F.concat(minus, _wide_text(inverted, 1)))
    )


def short_hash(text: Column) -> Column:
    """Display form: first six characters, an ellipsis, last four; short strings unchanged."""
    short = F.concat(F.left(text, F.lit(6)), F.lit("…"), F.right(text, F.lit(4)))
    return F.when(F.length(text) < 14, text).otherwise(short)


def numeric_companion(text: Column) -> Column:
    """``decimal(38,0)`` where the value fits, null where it does not."""
    return text.try_cast("decimal(38,0)")
