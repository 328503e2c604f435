"""TF-IDF features in long form and as sparse vectors."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from caseloom.functions.text import term_frequencies, with_bigrams, word_tokens
from caseloom.operators.words import (
    Lookup, Splitter, Vocabulary, added_up, counted, lowered, neighbours, slices, slots, word_characters, word_codes,
)
from caseloom.session import cut_lineage, spread_by_key

# A task passes on its counts when it holds more than so many.
TASK_COUNTS = 1 << 20
# So many times max_features words are held in a task; if more are equally frequent, terms are counted by a shuffle.
MOST_WORDS = 8
# Slots in which the pairs of a hash are added up, and the parts in which these are.
PAIR_BITS = 22
PARTS = 64


def term_counts(docs: DataFrame, key: str, text: str = "text", bigrams: bool = True) -> DataFrame:
    """``(key, term, tf)``.

    Terms are counted inside each row. The texts are partitioned by ``key`` once, which all
    uses in one plan share; what later works per document needs no further shuffle.
    """
    tokens = word_tokens(F.coalesce(F.col(text), F.lit("")))
    terms = with_bigrams(tokens) if bigrams else tokens
    placed = spread_by_key(docs.select(key, text), key)
    counted = placed.select(key, terms.alias("terms")).select(key, term_frequencies(F.col("terms")).alias("e"))
    return counted.select(key, F.explode_outer("e").alias("e")).select(key, "e.term", "e.tf").where(
        F.col("term").isNotNull()
    )


def document_frequencies(counts: DataFrame) -> DataFrame:
    """``(term, df, total)``; copies of a frequent term are combined before the shuffle."""
    return counts.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("total"))


def smooth_idf(df: Column, n_docs: Column) -> Column:
    return F.log((F.lit(1.0) + n_docs) / (F.lit(1.0) + df)) + F.lit(1.0)


def vocabulary(
    counts: DataFrame, n_docs: int | Column, min_df: int = 2, max_features: int | None = 35_000
) -> DataFrame:
    """``(term, df, total, idf)`` of the most frequent terms found in ``min_df`` documents."""
    kept = document_frequencies(counts).where(F.col("df") >= min_df)
    if max_features is not None:
        kept = kept.orderBy(F.desc("total"), "term").limit(max_features)
    n = F.lit(n_docs) if isinstance(n_docs, int) else n_docs
    return kept.withColumn("idf", smooth_idf(F.col("df"), n))


def weights(
    counts: DataFrame, vocab: DataFrame, key: str, sublinear: bool = True, bounded: bool = True
) -> DataFrame:
    """``(key, term, weight)``, each document scaled to length 1.

    ``bounded`` says that the vocabulary was cut to ``max_features`` rows, and only then is it
    broadcast.
    """
    terms = vocab.select([c for c in ["term", "term_index", "idf"] if c in vocab.columns])
    known = counts.join(F.broadcast(terms) if bounded else terms, "term")
    tf = F.lit(1.0) + F.log("tf") if sublinear else F.col("tf").cast("double")
    raw = known.withColumn("raw", tf * F.col("idf"))
    length = F.sqrt(F.sum(F.col("raw") * F.col("raw")).over(Window.partitionBy(key)))
    return raw.withColumn("weight", F.col("raw") / length).drop("raw", "idf", "tf")


@F.udf(VectorUDT(), useArrow=True)
def _sparse(size, indices, values):
    return SparseVector(size, list(indices), list(values))


@dataclass
class TfidfModel:
    """A fitted vocabulary. ``transform`` gives index and value arrays per document."""

    terms: DataFrame  # term, term_index, df, total, idf; at most max_features rows
    size: int
    sublinear: bool = True

    def _lookup(self) -> Broadcast:
        """The terms with index and idf, bounded by ``max_features``, shipped once."""
        if not hasattr(self, "_shared"):
            spark = self.terms.sparkSession
            rows = self.terms.select("term", "term_index", "idf").toArrow().to_pydict()
            table = Vocabulary.of(rows["term"], rows["term_index"], rows["idf"], word_characters(spark))
            self._shared = spark.sparkContext.broadcast(table)
        return self._shared

    def weigher(self) -> Callable[[], Callable[[pa.Array], tuple[np.ndarray, ...]]]:
        """Makes, in a task, what gives ``indices, values`` of texts of lower case and the number of terms in each."""
        shared, sublinear = self._lookup(), self.sublinear

        def make() -> Callable[[pa.Array], tuple[np.ndarray, ...]]:
            look_up, idf = Lookup(shared.value), shared.value.idf

            def weigh(texts: pa.Array) -> tuple[np.ndarray, ...]:
                indices, counts, lengths = look_up(texts)
                values = idf[indices] * (1.0 + np.log(counts) if sublinear else counts)
                some = lengths[lengths > 0]
                if len(some):
                    squares = np.add.reduceat(values * values, np.cumsum(some) - some)
                    values = values / np.repeat(np.sqrt(squares), some)
                return indices, values, lengths

            return weigh

        return make

    def transform(self, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
        """Add ``indices``, ``values`` (of length 1) and ``n_known_terms`` to every document.

        A projection: terms are counted inside the row and looked up in the small vocabulary,
        so scoring shuffles nothing. A document without any known term gets an empty vector.
        """
        make = self.weigher()

        @F.arrow_udf("struct<indices: array<int>, values: array<double>>")
        def look_up(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
            weigh = make()
            for texts in batches:
                indices, values, lengths = weigh(texts)
                ends = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(x)) for x in (indices.astype(np.int32), values)]
                yield pa.StructArray.from_arrays(lists, ["indices", "values"])

        return docs.withColumn("_v", look_up(lowered(text))).withColumns(
            {
                "indices": F.col("_v.indices"),
                "values": F.col("_v.values"),
                "n_known_terms": F.size("_v.indices"),
            }
        ).drop("_v")

    def features(self, docs: DataFrame, key: str, text: str = "text") -> DataFrame:
        """``transform`` with a sparse ``features`` vector for MLlib."""
        return self.transform(docs, key, text).withColumn(
            "features", _sparse(F.lit(self.size), "indices", "values")
        )

    def most_frequent(self, max_features: int) -> TfidfModel:
        """The model that a smaller ``max_features`` gives, without counting the texts again."""
        if max_features >= self.size:
            return self
        return TfidfModel(*_numbered(self.terms.drop("term_index"), max_features), self.sublinear)

    def save(self, path: str) -> None:
        self.terms.withColumn("sublinear", F.lit(self.sublinear)).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> TfidfModel:
        stored = spark.read.parquet(path)
        head = stored.agg(F.count("*").alias("n"), F.bool_or("sublinear").alias("s")).head()
        return cls(stored.drop("sublinear"), head["n"], bool(head["s"]))


def fit_tfidf(
    docs: DataFrame,
    key: str,
    text: str = "text",
    min_df: int = 2,
    max_features: int = 35_000,
    sublinear: bool = True,
) -> TfidfModel:
    """The most frequent terms of the texts, words and pairs of neighbours.

    A pair is no more frequent than its words. So words are counted first, and then only pairs of words that
    are as frequent as the last of the ``max_features`` most frequent words. Of these only pairs are
    counted one by one whose hash is as frequent. Both leave out no pair that can be among the terms.
    """
    n_docs = docs.agg(F.count("*").alias("n")).scalar()
    lower = docs.select(lowered(text).alias("_text"))
    characters = word_characters(docs.sparkSession)
    words = cut_lineage(word_totals(lower, characters).where(F.col("df") >= min_df))
    top = words.orderBy(F.desc("total"), "term").limit(max_features)
    n_top, last = top.agg(F.count("*"), F.min("total")).head()
    least = last if n_top and n_top == max_features else 0
    # Words that are exactly as frequent as the last are the only ones beyond max_features.
    frequent = words.where(F.col("total") >= least).select("term").limit(MOST_WORDS * max_features + 1).toArrow()
    if len(frequent) > MOST_WORDS * max_features:
        vocab = vocabulary(term_counts(docs, key, text), n_docs, min_df, None)
    else:
        known = frequent["term"].combine_chunks().cast(pa.string())
        pairs = pair_totals(lower, characters, known, max(least, min_df)).where(F.col("df") >= min_df)
        found = words.where(F.col("total") >= least).union(pairs)
        vocab = found.withColumn("idf", smooth_idf(F.col("df"), F.lit(n_docs) if isinstance(n_docs, int) else n_docs))
    return TfidfModel(*_numbered(vocab, max_features), sublinear)


def word_totals(lower: DataFrame, characters: np.ndarray) -> DataFrame:
    """``(term, df, total)`` of the words of texts of lower case, added up in tasks before the shuffle."""

    def merged(parts: list[pa.Table]) -> pa.Table:
        sums = pa.concat_tables(parts).group_by("term", use_threads=False).aggregate([("df", "sum"), ("total", "sum")])
        return sums.select(["term", "df_sum", "total_sum"]).rename_columns(["term", "df", "total"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, parts, rows = Splitter(characters), [], 0
        for batch in batches:
            for texts in slices(batch["_text"]):
                words, lengths = split(texts)
                coded = words.dictionary_encode()
                codes, n = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), len(coded.dictionary)
                if not n:
                    continue
                distinct = counted(np.repeat(np.arange(len(lengths)), lengths), codes, n)[1]
                df, total = np.bincount(distinct, minlength=n), np.bincount(codes, minlength=n)
                parts.append(pa.table({"term": coded.dictionary, "df": df, "total": total}))
                rows += n
                if rows > 2 * TASK_COUNTS:
                    parts = [merged(parts)]
                    rows = len(parts[0])
                    if rows > TASK_COUNTS:
                        yield from parts[0].to_batches(max_chunksize=1 << 16)
                        parts, rows = [], 0
        if parts:
            yield from merged(parts).to_batches(max_chunksize=1 << 16)

    return _summed(lower.mapInArrow(count, "term string, df bigint, total bigint"), "term")


def pair_totals(lower: DataFrame, characters: np.ndarray, known: pa.Array, least: int) -> DataFrame:
    """``(term, df, total)`` of the pairs of neighbours that are both in ``known``, and are found ``least`` times or more.

    The first pass adds up how often the pairs of a hash are found; the second counts pairs of frequent hashes.
    """
    spark, n = lower.sparkSession, len(known)
    few = lower.coalesce(spark.sparkContext.defaultParallelism)

    def pairs_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
        split = Splitter(characters)
        for batch in batches:
            for texts in slices(batch["_text"]):
                words, lengths = split(texts)
                docs = np.repeat(np.arange(len(lengths)), lengths)
                yield *neighbours(word_codes(words, known), docs, n), len(lengths)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(1 << PAIR_BITS, np.int64)
        for _, pairs, _ in pairs_of(batches):
            total += np.bincount(slots(pairs, PAIR_BITS), minlength=len(total))
        for part, sums in enumerate(total.reshape(PARTS, -1)):
            if sums.any():
                yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([sums.tobytes()], pa.binary())})

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, numbers in zip(batch["part"].to_pylist(), batch["bits"]):
                sums[part] = sums.get(part, 0) + np.frombuffer(numbers.as_buffer(), np.int64)
        for part, numbers in sums.items():
            bits = np.packbits(numbers >= least).tobytes()
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "bits": pa.array([bits], pa.binary())})

    marked = few.mapInArrow(mark, "part int, bits binary").repartition(PARTS, "part").mapInArrow(combine, "part int, bits binary")
    # A bit per slot.
    frequent = np.zeros((PARTS, (1 << PAIR_BITS) // PARTS // 8), np.uint8)
    for row in marked.collect():
        frequent[row["part"]] = np.frombuffer(row["bits"], np.uint8)
    shared = spark.sparkContext.broadcast(frequent.reshape(-1))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted, parts, rows = np.unpackbits(shared.value).astype(bool), [], 0

        def batch_of(codes: np.ndarray, df: np.ndarray, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"code": codes, "df": df, "total": total})

        for docs, pairs, n_docs in pairs_of(batches):
            some = np.flatnonzero(wanted[slots(pairs, PAIR_BITS)])
            # Few pairs are left, so they are numbered for the sort by text and pair.
            codes, places = np.unique(pairs[some], return_inverse=True)
            doc, place, tf = counted(docs[some], places, max(len(codes), 1))
            totals = np.bincount(places, minlength=len(codes))
            parts.append((codes, np.bincount(place, minlength=len(codes)), totals))
            rows += len(codes)
            if rows > 2 * TASK_COUNTS:
                parts = [added_up(*map(np.concatenate, zip(*parts)))]
                rows = len(parts[0][0])
                if rows > TASK_COUNTS:
                    yield batch_of(*parts[0])
                    parts, rows = [], 0
        if parts:
            yield batch_of(*added_up(*map(np.concatenate, zip(*parts))))

    sums = _summed(lower.mapInArrow(count, "code bigint, df bigint, total bigint"), "code").where(F.col("total") >= least)

    def name(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch["code"].to_numpy()
            both = [known.take(pa.array(c)) for c in (codes // n, codes % n)] if len(codes) else [batch["code"].cast(pa.string())] * 2
            term = pc.binary_join_element_wise(*both, " ")
            yield pa.RecordBatch.from_arrays([term, batch["df"], batch["total"]], ["term", "df", "total"])

    return sums.mapInArrow(name, "term string, df bigint, total bigint")


def _summed(counts: DataFrame, key: str) -> DataFrame:
    return counts.groupBy(key).agg(F.sum("df").alias("df"), F.sum("total").alias("total"))


def _numbered(vocab: DataFrame, max_features: int) -> tuple[DataFrame, int]:
    """The most frequent terms with their places in order, and their number."""
    kept = vocab.orderBy(F.desc("total"), "term").limit(max_features)
    # The numbering window runs over at most max_features rows.
    numbered = kept.withColumn("term_index", F.row_number().over(Window.orderBy("term")) - 1)
    terms = cut_lineage(numbered)
    return terms, terms.count()
