"""Fill-in-middle: a text is cut at two drawn places and told as prefix, suffix and middle, so that a model learns to fill gaps.

Each Arrow batch is registered in a DuckDB that lives in the task, and one SQL statement does the rest: cutting into units,
drawing, writing the three parts in their order, and rebuilding the text from what was written. No Python touches a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A unit is a word of ASCII letters, or any other code point.
UNIT = "[A-Za-z]+|[^A-Za-z]"
# What stands before prefix, suffix and middle. A text that holds one of them stays plain, so that any form can be read back.
MARKS = ("<P>", "<S>", "<M>")

FIELDS = "n long, form string, prefix_chars long, middle_chars long, output_sha256 string, restored_sha256 string, output string"

_SQL = """
WITH cut AS MATERIALIZED (
    SELECT row, text, regexp_extract_all(text, '{unit}') AS units, {draws} FROM batch
), placed AS MATERIALIZED (
    SELECT row, text, units, len(units) AS n, least(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS a, greatest(h1 % (len(units) + 1), h2 % (len(units) + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '{p}') OR contains(text, '{s}') OR contains(text, '{m}') OR h3 % 100 >= {fim_percent} THEN 'plain' WHEN h4 % 100 < {spm_percent} THEN 'spm' ELSE 'psm' END AS form
    FROM cut
), parts AS MATERIALIZED (
    SELECT row, text, n, form, CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, 1, a), '') END AS prefix,
        CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, a + 1, b), '') END AS middle,
        CASE WHEN form <> 'plain' THEN array_to_string(list_slice(units, b + 1, n), '') END AS suffix
    FROM placed
), told AS MATERIALIZED (
    SELECT row, n, form, length(prefix) AS prefix_chars, length(middle) AS middle_chars,
        CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '{p}' || prefix || '{s}' || suffix || '{m}' || middle ELSE '{s}' || suffix || '{p}' || prefix || '{m}' || middle END AS output
    FROM parts
), read AS MATERIALIZED (
    SELECT *, CASE form WHEN 'psm' THEN string_split(output, '{s}') WHEN 'spm' THEN string_split(output, '{p}') END AS halves FROM told
), split AS MATERIALIZED (
    SELECT *, CASE WHEN form <> 'plain' THEN substr(halves[1], 4) END AS first, string_split(halves[2], '{m}') AS rest FROM read
)
SELECT row, n, form, prefix_chars, middle_chars, sha256(output) AS output_sha256,
    sha256(CASE form WHEN 'plain' THEN output WHEN 'psm' THEN first || rest[2] || rest[1] ELSE rest[1] || rest[2] || first END) AS restored_sha256{output}
FROM split ORDER BY row
"""


def _sql(fim_percent: int, spm_percent: int, seed: int, with_output: bool) -> str:
    p, s, m = MARKS
    draws = ", ".join(f"('0x' || substr(digest, {8 * k + 1}, 8))::UBIGINT AS h{k + 1}" for k in range(4))
    source = f"(SELECT row, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(id, '')) AS digest FROM batch) AS batch"
    sql = _SQL.format(unit=UNIT, draws=draws, p=p, s=s, m=m, fim_percent=fim_percent, spm_percent=spm_percent, output=", output" if with_output else "")
    return sql.replace("FROM batch", f"FROM {source}", 1)


def _slices(text: pa.Array, most_bytes: int, most_rows: int = 2048) -> Iterator[tuple[int, int]]:
    """(start, length) of stretches of rows of about so many bytes; a longer text is alone in its stretch, whole."""
    upto = np.cumsum(pc.fill_null(pc.binary_length(text), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(text):
        end = int(np.searchsorted(upto, most_bytes + (upto[at - 1] if at else 0), "right"))
        end = min(max(end, at + 1), at + most_rows)
        yield at, end - at
        at = end


def _one(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def transform(docs: DataFrame, id_col: str = "doc_id", text: str = "text", fim_percent: int = 90, spm_percent: int = 20, seed: int = 1, with_output: bool = True, slice_bytes: int = 4 << 20) -> DataFrame:
    """(doc_id, n units, form, prefix_chars, middle_chars, output_sha256, restored_sha256, and output if asked for) of each row of docs.

    Of the rows fim_percent are cut, the others stay plain; of those spm_percent are told suffix first. The draws come from a
    hash of the seed and the id alone: rows of equal ids are cut alike, a null id draws like the empty text. A null text counts
    as empty; an empty text, and one that holds one of MARKS, stays plain. restored_sha256 is of the text that is read back out
    of output and form. A batch goes to DuckDB in slices of slice_bytes; a longer text is cut whole, alone in its slice. An
    empty table gives no rows; other columns aren't looked at.
    """
    sql = _sql(fim_percent, spm_percent, seed, with_output)
    fields = FIELDS if with_output else FIELDS.removesuffix(", output string")
    names = [f.split()[0] for f in fields.split(", ")]
    kind = dict(docs.dtypes)[id_col]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        db = duckdb.connect(config={"threads": 1, "temp_directory": ""})
        for batch in batches:
            for start, length in _slices(batch["text"], slice_bytes):
                own = batch.slice(start, length)
                db.register("batch", pa.table({"row": pa.array(np.arange(length)), "id": own["id"], "text": own["text"]}))
                found = db.sql(sql).to_arrow_table()
                db.unregister("batch")
                yield pa.RecordBatch.from_arrays([own["doc_id"], *(_one(found[c]) for c in names)], ["doc_id", *names])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(id_col).cast("string").alias("id"), F.col(text).alias("text"))
    return rows.mapInArrow(cut, f"doc_id {kind}, {fields}")


def restored(output: Column, form: Column) -> Column:
    """The text that an output of a form tells, by Spark's own functions: for those who read what was written."""
    p, s, m = (F.lit(x) for x in MARKS)
    after = lambda x, mark: F.substring_index(x, mark, -1)
    before = lambda x, mark: F.substring_index(x, mark, 1)
    prefix = F.when(form == "psm", F.substr(before(output, MARKS[1]), F.lit(4))).otherwise(before(after(output, MARKS[0]), MARKS[2]))
    suffix = F.when(form == "psm", before(after(output, MARKS[1]), MARKS[2])).otherwise(F.substr(before(output, MARKS[0]), F.lit(4)))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, after(output, MARKS[2]), suffix))
