"""Exact vector search over cells: a query meets only the lists of vectors that can hold one of its best."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tidemill.operators.text import _Best, six_places
from tidemill.sources.folders import saved

#: Most cells, vectors behind one, and vectors of a list that a task takes at a time.
CELLS, BEHIND, PIECE = 256, 500, 20_000
#: Lists (a cell and a category each) whose sizes may be broadcast, some 30 bytes each.
LISTS = 500_000
#: Queries that meet a list at a time.
STRIP = 1_000


@dataclass(frozen=True)
class Cells:
    """Vectors in lists by nearest centre and category, and what bounds each list.

    ``rows``: ``cell, category, piece, vec_id, vector``; ``lists``: ``cell, category, n, pieces, radius`` (the largest
    distance of a vector from its centre); ``centres``: a row a cell."""

    rows: DataFrame
    lists: DataFrame
    centres: np.ndarray


def _norms(x: np.ndarray) -> np.ndarray:
    return np.sqrt((x * x).sum(axis=1))


def build_cells(corpus: DataFrame, cells: int = CELLS, behind: int = BEHIND) -> Cells:
    """Cells of ``corpus`` (``vec_id, vector``, maybe ``category``). Centres are vectors of the corpus, one of about
    ``behind`` by a hash of their ids, ``cells`` at most; all vectors are dealt to them in one pass. Null vectors are
    left out."""
    category = F.col("category").cast("string") if "category" in corpus.columns else F.lit(None).cast("string")
    some = corpus.where("vector is not null").select("vec_id", F.col("vector").cast("array<double>").alias("vector"), category.alias("category"))
    n = some.count()
    drawn = some.orderBy(F.xxhash64("vec_id", F.lit(1)), "vec_id").limit(max(1, min(cells, n // behind))).collect()
    centres = np.array([r["vector"] for r in drawn]) if drawn else np.zeros((1, 1))
    shared = corpus.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = shared.value
        half = (c * c).sum(axis=1) / 2
        for batch in batches:
            if not len(batch):
                continue
            x = np.stack(batch["vector"].to_numpy())
            at = np.argmax(x @ c.T - half, axis=1)  # the nearest one
            yield batch.assign(cell=at.astype(np.int32), far=_norms(x - c[at]))

    kind = some.schema["vec_id"].dataType.simpleString()
    placed = some.mapInPandas(place, f"vec_id {kind}, vector array<double>, category string, cell int, far double")
    placed = saved(placed)
    lists = placed.groupBy("cell", "category").agg(F.count("*").alias("n"), F.max("far").alias("radius"))
    lists = saved(lists.withColumn("pieces", F.ceil(F.col("n") / PIECE).cast("int")))
    sizes = lists.select(F.col("cell").alias("_c"), F.col("category").alias("_k"), "pieces")
    rows = placed.join(sizes, (F.col("cell") == F.col("_c")) & F.col("category").eqNullSafe(F.col("_k")))
    return Cells(rows.select("cell", "category", F.pmod(F.xxhash64("vec_id"), "pieces").cast("int").alias("piece"), "vec_id", "vector"), lists, centres)


def _met(index: Cells, queries: DataFrame, k: int, seen: bool) -> DataFrame:
    """(``qid, vector, cell, category, pieces``): the lists that each query meets. At first the nearest ones, until they
    hold ``k`` vectors; with ``seen``, where queries have the ``least`` score that still counts, all others that can hold
    it: no vector x of a list with centre c and radius r has q x over q c + |q| r."""
    table = index.lists.limit(LISTS + 1).toPandas()
    if len(table) > LISTS:
        raise ValueError(f"more than {LISTS} lists: take fewer cells or categories")
    shared = queries.sparkSession.sparkContext.broadcast((index.centres, table))
    kind = queries.schema["qid"].dataType.simpleString()

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        centres, lists = shared.value
        cell, n, radius = lists["cell"].to_numpy(), lists["n"].to_numpy(), lists["radius"].to_numpy()
        names = lists["category"].to_numpy(dtype=object)
        for batch in batches:
            if not len(batch) or not len(cell):
                continue
            x = np.stack(batch["vector"].to_numpy())
            near, size = x @ centres.T, _norms(x)
            for i, wanted in enumerate(batch["category"]):
                mine = np.arange(len(cell)) if wanted is None else np.flatnonzero(names == wanted)
                order = mine[np.argsort(-near[i, cell[mine]], kind="stable")]
                first = np.cumsum(n[order]) - n[order] < k
                if seen:
                    bound = near[i, cell[order]] + size[i] * radius[order]
                    chosen = order[~first & (bound >= batch["least"].iloc[i] - 1e-5)]
                else:
                    chosen = order[first]
                if len(chosen):
                    yield pd.DataFrame({"qid": batch["qid"].iloc[i], "vector": [x[i]] * len(chosen), "cell": cell[chosen], "category": names[chosen], "pieces": lists["pieces"].to_numpy()[chosen]})

    return queries.mapInPandas(choose, f"qid {kind}, vector array<double>, cell int, category string, pieces int")


def _scores(index: Cells, met: DataFrame, k: int) -> DataFrame:
    """(``qid, vec_id, score``): the best ``k`` of each piece of a list for each query that meets it."""
    kinds = f"qid {met.schema['qid'].dataType.simpleString()}, vec_id {index.rows.schema['vec_id'].dataType.simpleString()}, score double"

    def best(queries: pd.DataFrame, vectors: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({"qid": [], "vec_id": [], "score": []})]
        if len(queries) and len(vectors):
            x = np.stack(vectors["vector"].to_numpy()).T
            for lo in range(0, len(queries), STRIP):
                part, found = queries.iloc[lo : lo + STRIP], _Best(k)
                found.add(six_places(np.stack(part["vector"].to_numpy()) @ x), vectors["vec_id"].to_numpy())
                out.append(pd.DataFrame({"qid": part["qid"].to_numpy()[found.row], "vec_id": found.id, "score": found.score}))
        return pd.concat(out[1:] or out)

    # a list's key, where no category is one of its own
    key = F.when(F.col("category").isNull(), "-").otherwise(F.concat(F.lit("+"), "category")).alias("kept")
    asked = met.select("qid", "vector", "cell", key, F.explode(F.sequence(F.lit(0), F.col("pieces") - 1)).alias("piece"))
    held = index.rows.select("cell", key, "piece", "vec_id", "vector")
    return asked.groupBy("cell", "kept", "piece").cogroup(held.groupBy("cell", "kept", "piece")).applyInPandas(best, kinds)


def search(index: Cells, queries: DataFrame, k: int) -> tuple[DataFrame, DataFrame]:
    """The best ``k`` vectors of each query by dot product, ``qid, vec_id, score, rank``, and how many lists each query
    met, ``qid, met, lists``.

    Queries (``qid, vector``, maybe ``category``; a null one asks for all) first meet their nearest lists; the k-th best
    score there bounds what the others must hold, and only lists that can hold it are met after. A filter goes to the
    lists, so vectors of other categories aren't read. Lists are cut into pieces of bounded size, and a piece hands on
    its best k of each query."""
    category = F.col("category").cast("string") if "category" in queries.columns else F.lit(None).cast("string")
    asked = saved(queries.where("vector is not null").select("qid", F.col("vector").cast("array<double>").alias("vector"), category.alias("category")))
    order = W.partitionBy("qid").orderBy(F.desc("score"), "vec_id")
    first = saved(_met(index, asked, k, seen=False))
    near = saved(_scores(index, first, k).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k))
    least = near.groupBy("qid").agg(F.when(F.count("*") >= k, F.min("score")).otherwise(-1e300).alias("least"))
    rest = saved(_met(index, asked.join(least, "qid"), k, seen=True))
    found = near.drop("rank").unionByName(_scores(index, rest, k)).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    met = first.select("qid").unionByName(rest.select("qid")).groupBy("qid").agg(F.count("*").alias("met"))
    return found, met.withColumn("lists", F.lit(index.lists.count()))


