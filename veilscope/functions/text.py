"""Expressions over text columns. Offsets count code points from 0, ends are exclusive."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import unicode_tables as U

#: A fragment longer than this shows its head and tail only.
FRAGMENT = 96
TAG_RUN = r"[\x{E0000}-\x{E007E}]*\x{E007F}|[\x{E0000}-\x{E007E}]+"
_TAG_CHARS = "".join(map(chr, range(0xE0020, 0xE007F))) + "".join(map(chr, [*range(0xE0000, 0xE0020), 0xE007F]))


def sha256(text: Column) -> Column:
    return F.sha2(F.encode(text, "UTF-8"), 256)


def raw_hex(text: Column) -> Column:
    return F.lower(F.hex(F.encode(text, "UTF-8")))


def odd(text: Column) -> Column:
    """The distinct characters of a text beyond printable ASCII, in one short string that classes are looked up in."""
    rest = F.regexp_replace(text, r"[ -~\t\n\r]+", "")
    return F.when(rest == "", rest).otherwise(F.array_join(F.array_distinct(F.split(rest, "")), ""))


def codepoint_name(cp: Column) -> Column:
    """U+ and at least four hexadecimal digits."""
    digits = F.hex(cp)
    return F.concat(F.lit("U+"), F.when(F.length(digits) < 4, F.lpad(digits, 4, "0")).otherwise(digits))


def human_projection(text: Column) -> Column:
    return F.regexp_replace(text, U.guarded(U.pattern("invisible")), "")


def tag_stripped(text: Column) -> Column:
    return F.regexp_replace(text, U.pattern("tags"), "")


def compact_skeleton(text: Column) -> Column:
    return F.translate(text, *U.COMPACT)


def decoded_tags(run: Column) -> Column:
    """The ASCII text of a run; characters without one are dropped."""
    return F.translate(run, _TAG_CHARS, "".join(map(chr, range(0x20, 0x7F))))


def lexical_units(text: Column) -> Column:
    """Words and single marks. Java's word class differs from Python's for some marks and number forms."""
    return F.regexp_extract_all(text, F.lit(r"(?U)(\w+|[^\w\s])"), F.lit(1))


def normalized(form: str):
    """An Arrow UDF for a normal form; Spark has none built in. Null stays null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize(form, t))

    return run


def skeleton(table: dict[str, str]):
    """An Arrow UDF: NFD, one look-alike for each character, NFD. Ignorable characters stay."""
    mapping = str.maketrans(table)

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: t if t is None else unicodedata.normalize("NFD", unicodedata.normalize("NFD", t).translate(mapping)))

    return run


def forms(table: dict[str, str]):
    """An Arrow UDF: normal forms and skeleton of a text at once. Null stays null; a caller gives it no ASCII texts."""
    mapping = str.maketrans({k: v for k, v in table.items() if len(k) == 1})
    own = {k: v for k, v in table.items() if k.isascii()}

    @F.pandas_udf("nfc string, nfkc string, skeleton string")
    def run(texts: pd.Series) -> pd.DataFrame:
        rows = [(None, None, None) if t is None else (unicodedata.normalize("NFC", t), unicodedata.normalize("NFKC", t), unicodedata.normalize("NFD", unicodedata.normalize("NFD", t).translate(mapping))) for t in texts]
        return pd.DataFrame(rows, columns=["nfc", "nfkc", "skeleton"], dtype=object)

    return run, own


def with_forms(docs: DataFrame, table: dict[str, str], text: Column) -> DataFrame:
    """docs with the struct `forms`: nfc, nfkc, skeleton. ASCII texts are their own normal forms and never go to Python."""
    run, own = forms(table)
    rows = docs.withColumn("forms", run(F.when(text.rlike(r"[^\x00-\x7F]"), text)))
    plain = mapped(text, own) if own else None
    parts = [F.coalesce(f"forms.{x}", text if x != "skeleton" or plain is None else plain).alias(x) for x in ("nfc", "nfkc", "skeleton")]
    return rows.withColumn("forms", F.struct(*parts))


def mapped(text: Column, table: dict[str, str]) -> Column:
    """text with each character of the table exchanged, all at once."""
    ones, more = {k: v for k, v in table.items() if len(v) == 1}, {k: v for k, v in table.items() if len(v) != 1}
    if any(c in more for v in table.values() for c in v):  # one after the other would exchange twice
        pairs = F.map_from_arrays(F.lit(list(table)), F.lit(list(table.values())))
        return F.array_join(F.transform(F.split(text, ""), lambda c: F.coalesce(F.try_element_at(pairs, c), c)), "")
    text = F.translate(text, "".join(ones), "".join(ones.values())) if ones else text
    for k, v in more.items():
        text = F.replace(text, F.lit(k), F.lit(v))
    return text


def _bind(value: Column, use) -> Column:
    """use(value), with the value computed once instead of in each of its uses."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _runs(most: Column) -> Column:
    """Powers of two that halve, from the largest that is no longer than `most`."""
    return F.transform(F.sequence(F.log2(F.greatest(most, F.lit(1))).cast("int"), F.lit(0), F.lit(-1)), lambda k: F.pow(F.lit(2), k).cast("int"))


def common_prefix(a: Column, b: Column) -> Column:
    """Length of the common prefix, in comparisons of halving runs rather than one for each character."""

    def longest(most: Column) -> Column:
        def step(at: Column, run: Column) -> Column:
            return F.when((run <= most - at) & (F.substr(a, at + 1, run) == F.substr(b, at + 1, run)), at + run).otherwise(at)

        return F.aggregate(_runs(most), F.lit(0), step)

    return _bind(F.least(F.length(a), F.length(b)), longest)


def common_suffix(a: Column, b: Column, prefix: Column) -> Column:
    """Length of the common suffix that does not overlap the prefix."""

    def longest(n: Column) -> Column:
        most = F.least(n["a"], n["b"]) - n["prefix"]

        def step(at: Column, run: Column) -> Column:
            same = F.substr(a, n["a"] - at - run + 1, run) == F.substr(b, n["b"] - at - run + 1, run)
            return F.when((run <= most - at) & same, at + run).otherwise(at)

        return F.aggregate(_runs(most), F.lit(0), step)

    return _bind(F.struct(F.length(a).alias("a"), F.length(b).alias("b"), prefix.alias("prefix")), longest)


def fragment(text: Column, start: Column, end: Column) -> Column:
    """The text from start to end, or its first and last characters around an ellipsis."""
    half = FRAGMENT // 2
    whole = F.substr(text, start + 1, end - start)
    cut = F.concat(F.substr(text, start + 1, F.lit(half)), F.lit("…"), F.substr(text, end - half + 1, F.lit(half)))
    return F.when(end - start <= FRAGMENT, whole).otherwise(cut)
