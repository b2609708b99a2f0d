"""HTML main-text extraction with the tree-structured model of htmlmodel.

Defined results: a null or empty page, or one without content, gives the empty text; repeated rows are each extracted; an empty
table gives an empty result; columns named like the added ones are replaced. Pages are read whole, each by itself: no shuffle.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from .htmlmodel import TreeModel

SEPARATOR = "\n\n"


def main_text(model: TreeModel, page: str | None, least: float = 0.5) -> str:
    return SEPARATOR.join(t for t, p in model.blocks(page) if p > least)


def extract(pages: DataFrame, model: TreeModel | None = None, least: float = 0.5) -> DataFrame:
    """pages(html, ...) -> the other columns, text and n_chars."""
    held = pages.sparkSession.sparkContext.broadcast(model or TreeModel())
    others = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    base = pages.select(*others, "html")
    out = T.StructType([*[base.schema[c] for c in others], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])
    schema = to_arrow_schema(out)

    def run(batches):
        for b in batches:
            texts = [main_text(held.value, h, least) for h in b.column(len(others)).to_pylist()]
            kept = [b.column(i).cast(schema.field(i).type) for i in range(len(others))]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(texts, schema.field("text").type), pa.array(list(map(len, texts)), pa.int64())], schema=schema)

    return base.mapInArrow(run, out)
