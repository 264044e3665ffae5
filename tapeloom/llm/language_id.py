"""Language by compression: the language whose dictionary makes the text smallest.

A dictionary per language holds windows (512 code points) of a bounded sample of labelled texts: the ``PER_LANGUAGE`` documents of the
smallest hashes of doc_id, in that order, up to ``DICT_BYTES`` bytes. Letters are lowered first. A text is compressed in consecutive blocks of ``BLOCK`` bytes, each against every dictionary, and the sizes of its
blocks are added: what a dictionary saves is then a share of the text and not a fixed number of bytes. The score is how much smaller
the text gets than under the second-best dictionary, as a share of that; a document is rejected when the score is under
``MIN_MARGIN`` or its text has no letter.

Nulls: a null, empty or letterless text is ``und`` with score 0 and rejected; a null lang teaches nothing, a null doc_id is in no
fold and neither taught nor held out. Equal sizes go to the language with more learned documents, then to the smaller name,
with score 0. With nothing to learn from, every text is ``und``. Repeated rows each get their row. Extra columns stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import bucket_of, small_batches
from tapeloom.llm.zdict import compressors, raw_dictionary, sampled, text_window

PER_LANGUAGE, DICT_BYTES = 400, 112 << 10
#: Bytes of one block; a dictionary reaches over several blocks, so it helps the last byte of a text as much as the first.
BLOCK = 16 << 10
MIN_MARGIN = 0.002
UNKNOWN = "und"


def learn(docs: DataFrame, fold: int = 2, folds: int = 4, per_language: int = PER_LANGUAGE) -> dict[str, bytes]:
    """Dictionary per language, most frequent first, from documents outside the held-out fold."""
    rows = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & (bucket_of(F.col("doc_id"), folds) != fold))
    names = [r[0] for r in rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()]
    windows = sampled(rows.select("doc_id", "lang", F.lower(text_window(F.col("text"), F.col("doc_id"))).alias("w")), "lang", "doc_id", per_language)
    parts: dict[str, list[bytes]] = {n: [] for n in names}
    for r in windows.orderBy("lang", F.xxhash64("doc_id"), "doc_id", "w").collect():
        parts[r["lang"]].append(r["w"].encode())
    return {n: raw_dictionary(p, DICT_BYTES) for n, p in parts.items()}


def with_language(docs: DataFrame, dictionaries: dict[str, bytes]) -> DataFrame:
    """Adds lang_pred and score; a projection over the rows, texts are read whole."""
    names = list(dictionaries)
    schema = T.StructType([*(f for f in docs.schema.fields if f.name not in ("lang_pred", "score")), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = compressors(dictionaries)
        for b in small_batches(batches):
            langs, scores = [], []
            for t in b.column("text").to_pylist():
                if not t or not names or not any(map(str.isalpha, t)):
                    langs.append(UNKNOWN)
                    scores.append(0.0)
                    continue
                raw = memoryview(t.lower().encode())
                blocks = [raw[k : k + BLOCK] for k in range(0, len(raw), BLOCK)]
                sizes = [sum(len(tools[n].compress(x)) for x in blocks) for n in names]
                best = min(sizes)
                i = sizes.index(best)
                second = min(sizes[:i] + sizes[i + 1 :], default=2 * best)
                langs.append(names[i])
                scores.append((second - best) / second)
            keep = [f.name for f in schema.fields[:-2]]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], schema=pa.schema([*(b.schema.field(c) for c in keep), ("lang_pred", pa.string()), ("score", pa.float64())]))

    return docs.drop("lang_pred", "score").mapInArrow(predict, schema)


def accepted(score: str = "score", lang: str = "lang_pred", min_margin: float = MIN_MARGIN):
    return (F.col(lang) != UNKNOWN) & (F.col(score) >= min_margin)
