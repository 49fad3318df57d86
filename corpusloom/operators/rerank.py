"""Results in the order of an injected scorer, which each worker loads once."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

Scorer = Callable[[Sequence[str], Sequence[str]], Sequence[float | None]]
#: Pairs that a scorer gets at a time.
BATCH = 256
_LOADED: dict[str, Scorer] = {}


def word_overlap() -> Scorer:
    """A scorer without a model: the share of a query's different words that the content holds; null for a query without words."""

    def score(queries: Sequence[str], contents: Sequence[str]) -> list[float | None]:
        out = []
        for query, content in zip(queries, contents, strict=True):
            asked = set(query.lower().split())
            out.append(len(asked & set(content.lower().split())) / len(asked) if asked else None)
        return out

    return score


def scored(results: DataFrame, load: Callable[[], Scorer] | None, *, query: str = "query", content: str = "content", into: str = "rerank_score") -> DataFrame:
    """`results` with the scorer's value of each (query, content); null without a scorer, for a null query or content, and where it gives none or no number.

    `load` makes the scorer, once a worker; it is told from others by its module and name.
    """
    if load is None:
        return results.withColumn(into, F.lit(None).cast("double"))
    names = results.columns
    given = results.select(F.struct(*[F.col(f"`{c}`") for c in names]).alias("row"), F.col(query).cast("string").alias("query"), F.col(content).cast("string").alias("content"))
    key = f"{load.__module__}.{load.__qualname__}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = None
        for batch in batches:
            if scorer is None:
                scorer = _LOADED[key] = _LOADED.get(key) or load()
            for at in range(0, batch.num_rows, BATCH):
                part = batch.slice(at, BATCH)
                pairs = list(zip(part.column("query").to_pylist(), part.column("content").to_pylist(), strict=True))
                whole = [i for i, (q, c) in enumerate(pairs) if q is not None and c is not None]
                values: list[float | None] = [None] * len(pairs)
                for i, v in zip(whole, scorer([pairs[i][0] for i in whole], [pairs[i][1] for i in whole]) if whole else [], strict=True):
                    values[i] = float(v) if v is not None and v == v else None
                yield pa.RecordBatch.from_arrays([part.column("row"), pa.array(values, pa.float64())], ["row", into])

    out = given.mapInArrow(run, T.StructType([given.schema["row"], T.StructField(into, T.DoubleType())]))
    return out.select(*[F.col(f"row.`{c}`") for c in names], into)


def rerank(results: DataFrame, load: Callable[[], Scorer] | None, *, by: str = "query_id", rank: str = "rank", query: str = "query", content: str = "content") -> DataFrame:
    """`results` with `rerank_score` and `place` within each `by`: highest scores first, null ones last, equal ones by their `rank` before; without a scorer the order stays."""
    out = scored(results, load, query=query, content=content)
    return out.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last("rerank_score"), rank)))


def ranked_urls(urls: DataFrame, load: Callable[[], Scorer] | None, *, by: str = "query_id", least: float = 0.0, most: int = 10) -> DataFrame:
    """The `most` best URLs of each query (query, url, title, snippet) whose score is `least` at least, by score, then URL; without a scorer all have none and stay by URL."""
    text = F.concat_ws(" ", "title", "snippet", "url")
    out = scored(urls.withColumn("_text", text), load, content="_text", into="score").drop("_text")
    kept = out.where(F.col("score") >= least) if load is not None else out
    return kept.withColumn("place", F.row_number().over(Window.partitionBy(by).orderBy(F.desc_nulls_last("score"), "url"))).where(F.col("place") <= most)
