"""Messages that are keyword salad, link lists or product tags rather than sentences.

Neighbouring words are counted over all messages, which gives the pointwise mutual information (PMI) of
every pair. A line without the glue of sentences is salad if its words come in collocations that its own
message repeats excessively, or if it is incoherent: its mean PMI is below SALAD_FACTOR times the corpus
mean, as words that only such lists throw together have. (Lists of names, being rare words that keep
company, lie far above it.) Link lists and tags have few words or none to measure and are told by their
form. A message is a case if such lines outweigh its sentences and records and amount to LEAST_MASS words.

Null and empty texts are no cases. Copies get the same verdict. Empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import spread, written
from .mail import own_lines
from .page_lines import FUNCTION_WORDS, page

SALAD_FACTOR = 1.6
REPEATED = 0.3
LEAST_MASS = 8

_LINES = "doc_id long, line_no int, kind string, mass int, repeated float, glue float, words array<string>"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(d, i, k, m, r, sum(x in FUNCTION_WORDS for x in w) / max(1, len(w)), w) for d, t in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True) for i, (k, m, w, r) in enumerate(page(own_lines(t)))]
        kinds = [pa.int64(), pa.int32(), pa.string(), pa.int32(), pa.float32(), pa.float32(), pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array([x[j] for x in rows], kind) for j, kind in enumerate(kinds)], names=["doc_id", "line_no", "kind", "mass", "repeated", "glue", "words"])


def lines(documents: DataFrame) -> DataFrame:
    """One row for each own line of each message, with what it is and its folded words."""
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("text is not null and doc_id is not null")
    return spread(texts).mapInArrow(_read, _LINES)


def pairs(df: DataFrame, *keep: str) -> DataFrame:
    """(a, b) for every two neighbouring words of a line, with the columns ``keep``."""
    p = df.where("size(words) > 1").select(*keep, F.explode(F.expr("transform(sequence(1, size(words) - 1), i -> struct(words[i - 1] as a, words[i] as b))")).alias("p"))
    return p.select(*keep, "p.a", "p.b")


def associations(df: DataFrame) -> tuple[DataFrame, float]:
    """(a, b, pmi) from counts over all lines, and the mean PMI over all neighbouring words."""
    counts = written(pairs(df).groupBy("a", "b").agg(F.count("*").alias("n")), "pairs")
    total = counts.agg(F.sum("n")).first()[0] or 0
    first, second = counts.groupBy("a").agg(F.sum("n").alias("n_a")), counts.groupBy("b").agg(F.sum("n").alias("n_b"))
    pmi = counts.join(first, "a").join(second, "b").select("a", "b", "n", F.log(F.col("n") * F.lit(float(total)) / (F.col("n_a").cast("double") * F.col("n_b"))).alias("pmi"))
    pmi = written(pmi, "pmi")
    mean = pmi.agg(F.sum(F.col("n") * F.col("pmi")) / F.lit(float(max(1, total)))).first()[0] or 0.0
    return pmi.select("a", "b", "pmi"), mean


def scores(documents: DataFrame) -> DataFrame:
    """doc_id, listed (mass of salad, links and tags), plain (mass of sentences and records), pmi (mean over its open lines) and is_case."""
    df = written(lines(documents), "lines")
    pmi, mean = associations(df)
    unsure = df.where("kind = 'open'")
    coherence = pairs(unsure, "doc_id", "line_no").join(pmi, ["a", "b"]).groupBy("doc_id", "line_no").agg(F.avg("pmi").alias("pmi"))
    judged = unsure.select("doc_id", "line_no", "mass", "repeated", "glue").join(coherence, ["doc_id", "line_no"], "left")
    salad = (F.col("repeated") >= REPEATED) | ((F.col("glue") < 0.2) & (F.col("pmi") < SALAD_FACTOR * mean))
    open_mass = judged.select("doc_id", F.when(salad, F.col("mass")).otherwise(0).alias("listed"), F.when(salad, 0).otherwise(F.col("mass")).alias("plain"), F.lit(0).alias("noted"), "pmi")
    kind = F.col("kind")
    other = df.where("kind <> 'open'").select(
        "doc_id",
        F.when(kind.isin("link", "tag", "item") | ((kind == "short") & (F.col("repeated") >= 0.5)), F.col("mass")).otherwise(0).alias("listed"),
        F.when(kind.isin("sentence", "record"), F.col("mass")).otherwise(0).alias("plain"),
        F.when(kind == "noted", F.col("mass")).otherwise(0).alias("noted"),
        F.lit(None).cast("double").alias("pmi"),
    )
    docs = open_mass.union(other).groupBy("doc_id").agg(F.sum("listed").alias("listed"), F.sum("plain").alias("plain"), F.sum("noted").alias("noted"), F.avg("pmi").alias("pmi"))
    listed = F.col("listed") + F.when(F.col("plain") == 0, F.col("noted")).otherwise(0)
    return docs.select("doc_id", listed.alias("listed"), "plain", "pmi").withColumn("is_case", (F.col("listed") >= LEAST_MASS) & (F.col("listed") > F.col("plain")))
