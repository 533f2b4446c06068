"""Term counts, vocabularies and TF-IDF as long tables."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright import lexicons as lx
from casewright.functions import terms as tm
from casewright.functions.rows import struct_rows

SPELT_HASHES = 2_000      # n-grams that are picked out by a list of hashes; of more, all are spelt out
BROADCAST_ROWS = 200_000  # a vocabulary or model table up to this size is sent to every task


def _is_first(ordered: Column) -> Column:
    """For each element of a sorted array: it with 1 where a new value starts."""
    return F.transform(
        ordered,
        lambda t, i: F.struct(
            t.alias("term"),
            F.when((i > 0) & F.get(ordered, i - 1).eqNullSafe(t), 0).otherwise(1).alias("first"),
        ),
    )


def term_counts(docs: DataFrame, groups: Sequence[str], terms: str = "terms") -> DataFrame:
    """``count`` and document frequency ``df`` of every term within each group.

    The terms of a row are sorted in place, so that the first copy of a term
    can be told apart inside the row. One shuffle on (group, term), combined
    before it, then gives both numbers; no pass over (document, term) is needed.
    """
    exploded = (
        docs.select(*groups, F.sort_array(terms).alias("_terms"))
        .select(*groups, F.inline(_is_first(F.col("_terms"))))
    )
    return exploded.groupBy(*groups, "term").agg(
        F.count("*").alias("count"), F.sum("first").alias("df")
    )


def doc_term_arrays(docs: DataFrame, keep: Sequence[str], terms: str = "terms") -> DataFrame:
    """``(keep..., entries)``: the distinct terms of each row with ``tf``, in order, without a shuffle."""
    ordered = F.col("_terms")
    starts = F.filter(
        F.transform(ordered, lambda _, i: i),
        lambda i: (i == 0) | (F.get(ordered, i) != F.get(ordered, i - 1)),
    )
    runs = F.transform(
        F.col("_starts"),
        lambda p, k: F.struct(
            F.get(ordered, p).alias("term"),
            (F.coalesce(F.get(F.col("_starts"), k + 1), F.size(ordered)) - p).alias("tf"),
        ),
    )
    return (
        docs.select(*keep, F.sort_array(terms).alias("_terms"))
        .select(*keep, "_terms", starts.alias("_starts"))
        .select(*keep, runs.alias("entries"))
    )


def doc_term_counts(docs: DataFrame, keep: Sequence[str], terms: str = "terms") -> DataFrame:
    """``(keep..., term, tf)``, counted inside each row without a shuffle."""
    return doc_term_arrays(docs, keep, terms).select(*keep, F.inline("entries"))


def top_terms(
    counts: DataFrame, groups: Sequence[str], by: str, limit: int, term: str = "term"
) -> DataFrame:
    """Top terms per group with ``rank``; ties alphabetical.

    The rank filter lets Spark keep only ``limit`` rows per group and task
    before the shuffle.
    """
    order = Window.partitionBy(*groups).orderBy(F.desc(by), F.asc(term))
    ranked = counts.withColumn("rank", F.row_number().over(order))
    return ranked.filter(F.col("rank") <= limit)


def vocab_top_k(counts: DataFrame, min_df: int, max_features: int) -> DataFrame:
    """The most frequent terms among those in enough documents."""
    return (
        counts.filter(F.col("df") >= min_df)
        .orderBy(F.desc("count"), F.asc("term"))
        .limit(max_features)
    )


def _picked_ngrams(words: Column, n: int, hashes: Sequence[int]) -> Column:
    """The n-grams with one of the given hashes, in order; no other is spelt out."""
    placed = F.transform(tm.ngram_hashes(words, n), lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    picked = F.filter(placed, lambda x: x["h"].isin(list(hashes)))
    return F.transform(picked, lambda x: F.concat_ws(" ", *[F.get(words, x["i"] + k) for k in range(n)]))


def ngram_tables(
    docs: DataFrame,
    label: str = "label",
    tokens: str = "tokens",
    sizes: dict[int, str] | None = None,
    min_df: int = lx.NGRAM_MIN_DF,
    limit: int = 20,
) -> DataFrame:
    """Ranked n-grams per label and n, for all labels in one job.

    Every n-gram is first counted by its hash, a number instead of a string in the shuffle. The
    hashes that reach the count of the last rank, ties included, hold all winners; only their
    n-grams are then spelt out and counted again, which tells apart any that share a hash.
    """
    sizes = sizes or {1: "unigram", 2: "bigram", 3: "trigram"}

    def table(terms: dict[int, Column]) -> DataFrame:
        by_size = struct_rows(["type", "terms"], *[[F.lit(sizes[n]), c] for n, c in terms.items()])
        return docs.select(label, F.inline(by_size))

    words = F.col(tokens)
    hashed = term_counts(table({n: tm.ngram_hashes(words, n) for n in sizes}), [label, "type"]).filter(F.col("df") >= min_df)
    order = Window.partitionBy(label, "type").orderBy(F.desc("count"))
    winners = hashed.withColumn("rank", F.rank().over(order)).filter(F.col("rank") <= limit)
    found = winners.select("type", "term").distinct().limit(SPELT_HASHES + 1).collect()
    if len(found) > SPELT_HASHES:
        terms = {n: tm.ngrams(words, n) for n in sizes}
    else:
        wanted = {n: [r["term"] for r in found if r["type"] == name] for n, name in sizes.items()}
        terms = {n: _picked_ngrams(words, n, wanted[n]) for n in sizes}
    counts = term_counts(table(terms), [label, "type"]).filter(F.col("df") >= min_df)
    return top_terms(counts, [label, "type"], "count", limit).select(
        label, "type", "rank", F.col("term").alias("token"), "count"
    )


def cloud_frequencies(counts: DataFrame, groups: Sequence[str], limit: int) -> DataFrame:
    """Top terms with their frequency relative to the most frequent one."""
    top = top_terms(counts, groups, "count", limit)
    best = F.max("count").over(Window.partitionBy(*groups))  # at most `limit` rows per group
    return top.select(*groups, "term", "count", (F.col("count") / best).alias("frequency"))


def tfidf_fit(
    train_counts: DataFrame, n_docs: Column, min_df: int = lx.MIN_DF, max_features: int = lx.MAX_FEATURES
) -> DataFrame:
    """Vocabulary ``(term, count, df, idf)`` from the term counts of the training rows."""
    idf = F.ln((n_docs + 1) / (F.col("df") + 1)) + 1
    return vocab_top_k(train_counts, min_df, max_features).withColumn("idf", idf)


def with_index(vocabulary: DataFrame) -> DataFrame:
    """Number the vocabulary alphabetically from 0; it is bounded by its limit."""
    order = Window.partitionBy().orderBy("term")
    return vocabulary.withColumn("index", F.row_number().over(order) - 1)


def tfidf_transform(
    doc_counts: DataFrame, vocabulary: DataFrame, key: str, n_terms: int
) -> DataFrame:
    """Sub-linear TF-IDF with rows of length one; terms outside the vocabulary go.

    ``n_terms`` is the size of the vocabulary: it is broadcast up to a fixed
    size and joined by key beyond it.
    """
    vocab = F.broadcast(vocabulary) if n_terms <= BROADCAST_ROWS else vocabulary
    weighted = doc_counts.join(vocab, "term").withColumn(
        "_raw", (1 + F.ln("tf")) * F.col("idf")
    )
    norm = F.sqrt(F.sum(F.col("_raw") * F.col("_raw")).over(Window.partitionBy(key)))
    return weighted.withColumn("weight", F.col("_raw") / norm).drop("_raw", "count", "df", "idf")


VECTOR = "struct<type: tinyint, size: int, indices: array<int>, values: array<double>>"


def tfidf_rows(doc_terms: DataFrame, vocabulary: DataFrame, keep: Sequence[str], n_terms: int) -> DataFrame:
    """``(keep..., features)``: the weights of ``tfidf_transform`` as one sparse vector per row.

    ``doc_terms`` holds ``(keep..., entries)``. Terms are looked up in batches and the norm is
    taken inside the row, so no row moves. The vocabulary goes to every task; beyond
    ``BROADCAST_ROWS`` terms it is joined by term, and the rows are collected by key.
    """
    keep = list(keep)
    if n_terms > BROADCAST_ROWS:
        return _joined_rows(doc_terms, vocabulary, keep, n_terms)
    known = vocabulary.select("index", "term", "idf").orderBy("index").toArrow().combine_chunks()
    terms = known["term"].combine_chunks() if known.num_rows else pa.array([], pa.string())
    idf = known["idf"].to_numpy()
    # By the term alone, whatever else the entries hold.
    rows = doc_terms.select(*keep, F.transform("entries", lambda e: e["term"]).alias("_t"), F.transform("entries", lambda e: e["tf"]).alias("_f"))
    schema = ", ".join([f"`{c}` {doc_terms.schema[c].dataType.simpleString()}" for c in keep] + [f"features {VECTOR}"])

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            *kept, lists, counts = batch.columns
            n = batch.num_rows
            index = pc.index_in(lists.flatten(), value_set=terms)
            found = index.is_valid().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(n), lists.value_lengths().to_numpy())[found]
            at = index.filter(pa.array(found)).to_numpy()
            raw = (1 + np.log(counts.flatten().to_numpy()[found])) * idf[at]
            order = np.lexsort((at, row))
            row, at, raw = row[order], at[order], raw[order]
            norm = np.sqrt(np.bincount(row, raw * raw, minlength=n))
            bounds = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row, minlength=n))]), pa.int32())
            vector = pa.StructArray.from_arrays(
                [
                    pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, n_terms), pa.int32()),
                    pa.ListArray.from_arrays(bounds, pa.array(at, pa.int32())), pa.ListArray.from_arrays(bounds, pa.array(raw / norm[row])),
                ],
                ["type", "size", "indices", "values"],
            )
            yield pa.RecordBatch.from_arrays([*kept, vector], [*keep, "features"])

    return rows.mapInArrow(weigh, schema)


def _joined_rows(doc_terms: DataFrame, vocabulary: DataFrame, keep: list[str], n_terms: int) -> DataFrame:
    """The same by joins, for a vocabulary that is not sent to every task; ``keep[0]`` is the key."""
    key = keep[0]
    weights = tfidf_transform(doc_terms.select(key, F.inline("entries")), vocabulary, key, n_terms)
    entries = weights.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("index", "weight"))).alias("_e"))
    none = F.array().cast("array<struct<index: int, weight: double>>")
    told = doc_terms.select(*keep).join(entries, key, "left").withColumn("_e", F.coalesce("_e", none))
    vector = F.struct(
        F.lit(0).cast("tinyint").alias("type"), F.lit(n_terms).alias("size"),
        F.transform("_e", lambda e: e["index"]).alias("indices"), F.transform("_e", lambda e: e["weight"]).alias("values"),
    )
    return told.select(*keep, vector.alias("features"))


def vector_entries(rows: DataFrame, keep: Sequence[str], features: str = "features") -> DataFrame:
    """``(keep..., index, weight)`` of sparse vectors."""
    v = F.unwrap_udt(features)
    return rows.select(*keep, F.inline(F.arrays_zip(v["indices"].alias("index"), v["values"].alias("weight"))))


def with_terms(entries: DataFrame, vocabulary: DataFrame, n_terms: int) -> DataFrame:
    """Add the ``term`` of each ``index``."""
    names = vocabulary.select("index", "term")
    return entries.join(F.broadcast(names) if n_terms <= BROADCAST_ROWS else names, "index")


def class_mean_tfidf(
    entries: DataFrame, class_sizes: DataFrame, vocabulary: DataFrame, n_terms: int, label: str = "label"
) -> DataFrame:
    """Mean weight per class and term; documents without the term count as 0."""
    sums = entries.groupBy(label, "index").agg(F.sum("weight").alias("total"))
    # One row per class.
    return with_terms(sums, vocabulary, n_terms).join(F.broadcast(class_sizes), label).select(
        label, "term", "total", (F.col("total") / F.col("n")).alias("mean_weight")
    )


def stop_word_union(general: DataFrame, legal: DataFrame) -> DataFrame:
    return general.select("term").union(legal.select("term")).distinct()


def stop_word_anti_join(counts: DataFrame, stop_words: DataFrame) -> DataFrame:
    """Terms that are not stop words. The list is a few hundred rows."""
    return counts.join(F.broadcast(stop_words), "term", "left_anti")


def outcome_leaks(features: DataFrame, outcome_terms: Sequence[str]) -> DataFrame:
    """Features whose name contains an outcome term."""
    inside = [F.col("term").contains(t) for t in outcome_terms]
    found = F.array_compact(
        F.array(*[F.when(hit, F.lit(t)) for hit, t in zip(inside, outcome_terms)])
    )
    return features.withColumn("leaks", found).filter(F.size("leaks") > 0)
