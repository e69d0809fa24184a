"""Fill-in-middle transformation (operator 12): each text is cut into a prefix, a middle and a suffix and written with sentinels so that
the middle comes last.

The cutting is one pyarrow.compute pipeline per batch: a mark is put behind each unit, texts are split there into list arrays, the lists
are flattened with their parents' indices, a unit's ordinal is its place less its list's first, units are filtered by role (before,
in or behind the middle), lists are rebuilt from each role and joined. Nothing loops over rows. Where the cuts lie and which form a text
takes is drawn from a hash of its id in Spark's own functions, so a rerun gives the same output; the batches only see two numbers a row.

Defined cases: a null or empty text has no units and stays plain, with an empty output; a text that holds one of the sentinels stays
plain, so that an output can always be read back; equal rows get equal outputs; a null id is hashed as an empty one; whole texts are cut,
whatever their length; an empty table gives an empty result; a column of `docs` that is called as a new one keeps its values and the
new one gets a free name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from mediagraph.llm import words

#: No UTF-8 text holds this byte, so it can mark the end of a unit.
MARK = b"\xff"
#: A run of ASCII letters, or one other code point, on UTF-8 bytes.
UNITS = rb"([A-Za-z]+|[\xc2-\xf4][\x80-\xbf]*|[\x00-\x7f])"
PARTS_TYPE = "struct<n: bigint, prefix: string, middle: string, suffix: string>"
RESULT_TYPE = "struct<n: bigint, form: string, prefix_chars: bigint, middle_chars: bigint, output: string>"


@dataclass(frozen=True)
class Sentinels:
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def __post_init__(self) -> None:
        marks = (self.prefix, self.suffix, self.middle)
        if not all(marks) or len(set(marks)) < 3 or any(first[0] in mark[1:] for first in marks for mark in marks):
            raise ValueError("sentinels must differ, and none may hold the first character of one further on")


def drawn(id_col: str, seed: int, group: int) -> Column:
    """One of the 8-digit groups of the hex SHA-256 of `<seed>:<id>` as an unsigned integer."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))
    return F.conv(F.substring(F.sha2(key, 256), 8 * group + 1, 8), 16, 10).cast("bigint")


def unit_lists(column: pa.Array) -> pa.ListArray:
    """Texts (null: empty) as lists of their units."""
    marked = pc.replace_substring_regex(pc.fill_null(column, "").cast(pa.large_binary()), UNITS, rb"\1" + MARK)
    # what stands behind the last mark is an empty string of its own: not a unit
    return pc.split_pattern(marked, MARK)


def joined_role(units: pa.Array, ordinal: pa.Array, parent: pa.Array, low: pa.Array, high: pa.Array) -> pa.Array:
    """Per row, its units with low <= ordinal < high, joined."""
    mine = pc.and_(pc.greater_equal(ordinal, pc.take(low, parent)), pc.less(ordinal, pc.take(high, parent)))
    at = pc.cumulative_sum(pc.subtract(high, low))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), at.cast(pa.int32())])
    lists = pa.ListArray.from_arrays(offsets, pc.filter(units, mine))
    return pc.binary_join(lists, pa.scalar(b"", pa.large_binary())).cast(pa.large_string()).cast(pa.string())


def cut_parts(texts: pa.Array, first: pa.Array, second: pa.Array) -> pa.StructArray:
    """Parts of each text: the cuts are `first` and `second` modulo its number of units and one."""
    lists = unit_lists(texts)
    n = pc.subtract(pc.list_value_length(lists), 1).cast(pa.int64())
    units, parent = pc.list_flatten(lists), pc.list_parent_indices(lists)
    starts = pc.take(lists.offsets, parent).cast(pa.int64())
    ordinal = pc.subtract(pc.subtract(pc.cumulative_sum(pa.repeat(pa.scalar(1, pa.int64()), len(units))), 1), starts)
    over = pc.add(n, 1)
    cuts = [pc.subtract(x, pc.multiply(pc.divide(x, over), over)) for x in (first, second)]
    low, high = pc.min_element_wise(*cuts), pc.max_element_wise(*cuts)
    none = pa.repeat(pa.scalar(0, pa.int64()), len(texts))
    parts = [joined_role(units, ordinal, parent, a, b) for a, b in ((none, low), (low, high), (high, n))]
    return pa.StructArray.from_arrays([n, *parts], ["n", "prefix", "middle", "suffix"])


def with_parts(docs: DataFrame, id_col: str, text: str, seed: int, keep: list[str], name: str) -> DataFrame:
    """`docs` with a struct of the units' number and the three parts."""
    given = docs.select(
        *[F.col(f"`{c}`") for c in keep], drawn(id_col, seed, 0).alias(f"{name}_a"), drawn(id_col, seed, 1).alias(f"{name}_b"), F.col(text).alias(f"{name}_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in words.slices(batch, most=1 << 20):
                *kept, a, b, texts = part.columns
                yield pa.RecordBatch.from_arrays([*kept, cut_parts(texts, a, b)], [*keep, name])

    schema = given.select(*[F.col(f"`{c}`") for c in keep]).schema.add(name, DataType.fromDDL(PARTS_TYPE))
    return given.mapInArrow(run, schema)


def filled_in_middle(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", seed: int = 1, percent: int = 90, spm_percent: int = 20,
    marks: Sentinels = Sentinels(), keep: list[str] | None = None, name: str = "fim",
) -> DataFrame:
    """`docs` (or its columns `keep`) with a struct `name`: n (units), form, prefix_chars, middle_chars (code points, null if plain), output.

    `percent` of the texts are transformed, and of those `spm_percent` with the suffix first; the rest is plain.
    """
    keep = docs.columns if keep is None else keep
    name = words.free_name([*keep, id_col, text], name)
    form = words.free_name([*keep, name], "form")
    whole = F.coalesce(F.col(text), F.lit(""))
    plain = (whole == "") | (drawn(id_col, seed, 2) % 100 >= percent)
    for mark in (marks.prefix, marks.suffix, marks.middle):
        plain = plain | whole.contains(mark)
    chosen = F.when(plain, "plain").when(drawn(id_col, seed, 3) % 100 < spm_percent, "spm").otherwise("psm")
    rows = with_parts(docs.withColumn(form, chosen), id_col, text, seed, [*keep, form], name)
    part, told = F.col(name), F.col(form)
    p, s, m = F.lit(marks.prefix), F.lit(marks.suffix), F.lit(marks.middle)
    output = (
        F.when(told == "plain", F.concat(part["prefix"], part["middle"], part["suffix"]))
        .when(told == "psm", F.concat(p, part["prefix"], s, part["suffix"], m, part["middle"]))
        .otherwise(F.concat(s, part["suffix"], p, part["prefix"], m, part["middle"]))
    )
    chars = lambda x: F.when(told != "plain", F.length(part[x]).cast("bigint"))
    result = F.struct(part["n"].alias("n"), told.alias("form"), chars("prefix").alias("prefix_chars"), chars("middle").alias("middle_chars"), output.alias("output"))
    return rows.select(*[F.col(f"`{c}`") for c in keep], result.alias(name))


def restored(output: Column, form: Column, marks: Sentinels = Sentinels()) -> Column:
    """The text that an output was made of. Sentinels can't occur elsewhere in it: texts that hold one stay plain, and as none holds the first
    character of one further on, none arises where a part meets a sentinel."""
    psm = F.split(output, f"\\Q{marks.suffix}\\E|\\Q{marks.middle}\\E", -1)
    spm = F.split(output, f"\\Q{marks.prefix}\\E|\\Q{marks.middle}\\E", -1)
    behind = lambda column, mark: F.substring(column, F.lit(len(mark) + 1), F.length(column))
    return (
        F.when(form == "plain", output)
        .when(form == "psm", F.concat(behind(psm[0], marks.prefix), psm[2], psm[1]))
        .otherwise(F.concat(spm[1], spm[2], behind(spm[0], marks.suffix)))
    )
