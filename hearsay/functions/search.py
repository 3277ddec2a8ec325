"""Which of many strings are parts of which texts: one pass over the texts for each block of strings, whatever their number."""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

#: Strings, and characters of them, that one block may hold: what is sent to all tasks at a time.
BLOCK, BLOCK_CHARS = 50_000, 4_000_000


def _blocks(strings: DataFrame) -> Iterator[list[str]]:
    """Distinct strings in blocks; read block by block, so the driver holds one at a time."""
    block, chars = [], 0
    for row in strings.toLocalIterator():
        block.append(row[0])
        chars += len(row[0])
        if len(block) >= BLOCK or chars >= BLOCK_CHARS:
            yield block
            block, chars = [], 0
    if block:
        yield block


def parts_of(texts: DataFrame, text: str, strings: DataFrame, string: str) -> DataFrame:
    """The rows of texts without ``text``, with each distinct non-empty string (column ``string``) that it holds, once."""
    kept = [f for f in texts.schema.fields if f.name != text]
    schema = StructType([*kept, StructField(string, StringType())])
    names = [f.name for f in kept]
    found = None
    asked = strings.select(F.col(string)).filter(F.coalesce(F.length(string), F.lit(0)) > 0).distinct()
    for block in _blocks(asked):

        def work(batches: Iterator[pa.RecordBatch], block=block) -> Iterator[pa.RecordBatch]:
            machine = ahocorasick.Automaton()
            for s in block:
                machine.add_word(s, s)
            machine.make_automaton()
            for batch in batches:
                rows, hits = [], []
                for i, t in enumerate(batch.column(text).to_pylist()):
                    own = {s for _, s in machine.iter(t)} if t else ()
                    rows += [i] * len(own)
                    hits += sorted(own)
                if rows:
                    at = pa.array(rows, pa.int32())
                    yield pa.RecordBatch.from_arrays([*(batch.column(n).take(at) for n in names), pa.array(hits, pa.string())], names=[*names, string])

        own = texts.select(*names, text).mapInArrow(work, schema)
        found = own if found is None else found.unionAll(own)
    return texts.sparkSession.createDataFrame([], schema) if found is None else found
