"""Phrase counting and scoring: n-grams, TF-IDF, position, length and title factors.

Documents arrive as rows (corpus, doc_id, text[, title]). A corpus is one show.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dialoom.functions import phrases
from dialoom.functions import text as tx
from dialoom.operators.common import MET_TEXT, join_dimension, parallel, settle, spread_text, text_parts, top_k
from dialoom.params import KeyphraseParams
from dialoom.session import cut_lineage, stored

DOC = ("corpus", "doc_id")
HELD = 32 << 20  # bytes of terms that a task holds at once to list them


def tokenized(docs: DataFrame, params: KeyphraseParams = KeyphraseParams(), keep: bool = False) -> DataFrame:
    """(corpus, doc_id, tokens[, title_terms, title_len]), one row per document.

    Rows are spread by document here, once, while they are small. All later
    per-document counting then needs no further shuffle, and the branches that
    read the tokens again share this exchange instead of tokenising again.
    With keep they are written before, as text, for several plans that read and spread them.
    The words of a title travel before those of the text in one column, so that branches that
    do not read them share the exchange as well.
    """
    if params.include_title:
        # the title is put before the text only after both are lower case
        body = tx.with_title(F.col("title"), F.lower(F.col("text")))
        before = [F.array_join(tx.clean_words(tx.split_words(F.lower("title"))), "\n"), F.lit("\f")]
    else:
        body, before = F.col("text"), []
    words = F.concat(*before, F.array_join(tx.tokenize(tx.normalize_text(body)), "\n"))
    made = parallel(docs, *DOC).select(*DOC, words.alias("words"))
    spread = spread_text(stored(made, "words") if keep else made, docs, *DOC)

    def listed(words: Column) -> Column:
        return F.filter(F.split(words, "\n"), lambda w: w != "")

    if not params.include_title:
        return spread.select(*DOC, listed(F.col("words")).alias("tokens"))
    title = listed(F.substring_index("words", "\f", 1))
    return spread.select(
        *DOC, listed(F.substring_index("words", "\f", -1)).alias("tokens"),
        title_labels(title, params.gram_sizes).alias("title_terms"), F.size(title).alias("title_len"))


def segment_tokens(segments: DataFrame, params: KeyphraseParams = KeyphraseParams()) -> DataFrame:
    """(corpus, doc_id, tokens, own, before) of documents that come in segments (.., segment, text).

    No row holds a whole document. The tokens of a segment are followed by those that phrases beginning
    in it may need from the next ones; `own` counts those before that, `before` the tokens of all earlier
    segments. So every phrase is found once, at the place it has in the whole document.
    """
    if params.include_title:
        raise ValueError("segments have no titles")
    more = max(params.gram_sizes) - 1
    words = F.array_join(tx.tokenize(tx.normalize_text(F.col("text"))), "\n")
    split = (spread_text(segments.select(*DOC, "segment", "text"), segments, *DOC, "segment").select(*DOC, "segment", words.alias("words"))
             .select(*DOC, "segment", F.filter(F.split("words", "\n"), lambda w: w != "").alias("tokens"))
             .where(F.size("tokens") > 0))
    split = cut_lineage(split)
    # only sizes and first tokens of the segments meet per document; every one has a token at least
    document = Window.partitionBy(*DOC).orderBy("segment")
    ends = split.select(*DOC, "segment", F.size("tokens").cast("long").alias("own"), F.slice("tokens", 1, max(more, 1)).alias("first")).select(
        *DOC, "segment", "own",
        F.coalesce(F.sum("own").over(document.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.slice(F.flatten(F.collect_list("first").over(document.rowsBetween(1, max(more, 1)))), 1, more).alias("next"))
    return split.join(ends, [*DOC, "segment"]).select(*DOC, F.concat("tokens", "next").alias("tokens"), "own", "before")


def bare(tokens: DataFrame) -> DataFrame:
    """The tokens without titles."""
    return tokens.select(*DOC, "tokens", *[c for c in ("own", "before") if c in tokens.columns])


def grams(words: Column, size: int) -> Column:
    """All runs of `size` words joined by underscores, in order."""
    starts = F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - (size - 1))
                    ).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i, size), "_"))


def title_labels(words: Column, sizes: Sequence[int]) -> Column:
    return F.array_distinct(F.concat(*[
        F.transform(grams(words, n), tx.fold_possessive) if n > 1 else words for n in sizes]))


def word_windows(tokens: DataFrame, width: int) -> DataFrame:
    """One row per token position with the next words beside it: pos, w1..w<width>."""
    carried = [c for c in tokens.columns if c != "tokens"]
    shifted = tokens.select(*carried, *[
        (F.col("tokens") if i == 0 else F.slice("tokens", i + 1, F.greatest(F.size("tokens"), F.lit(1)))
         ).alias(f"w{i + 1}") for i in range(width)])
    zipped = F.arrays_zip(*[F.col(f"w{i + 1}") for i in range(width)])
    return (shifted.select(*carried, F.posexplode(zipped).alias("pos", "w"))
            .select(*carried, "pos", "w.*"))


def gram_rows(tokens: DataFrame, sizes: Sequence[int], stop_words: bool = False) -> DataFrame:
    """Every n-gram occurrence: (.., pos, size, term), possessives folded.

    Single words lose stop words and words of one or two letters; longer grams
    lose those with a stop word at either end when `stop_words` is set.
    """
    windows = word_windows(tokens, max(sizes))
    if "own" in tokens.columns:
        windows = windows.where("pos < own").withColumn("pos", (F.col("pos") + F.col("before")).cast("int")).drop("own", "before")
    carried = [c for c in windows.columns if not (c[0] == "w" and c[1:].isdigit())]
    options = []
    for n in sizes:
        words = [F.col(f"w{i + 1}") for i in range(n)]
        label = F.concat_ws("_", *words)
        if n == 1:
            keep = tx.boundary_ok("w1", "w1") & (F.length(words[0]) > 2)
        else:
            keep = words[-1].isNotNull()
            if stop_words:
                keep = keep & tx.boundary_ok("w1", f"w{n}")
            label = F.when(label.contains("_s"), tx.fold_possessive(label)).otherwise(label)
        options.append(F.struct(F.lit(n).alias("size"), F.when(keep, label).alias("term")))
    return windows.select(*carried, F.inline(F.array(*options))).where("term is not null")


def occurrences(tokens: DataFrame, params: KeyphraseParams = KeyphraseParams()) -> DataFrame:
    return gram_rows(tokens, params.gram_sizes, params.remove_stopwords)


def term_frequency(occ: DataFrame) -> DataFrame:
    return occ.groupBy(*DOC, "size", "term").agg(F.count("*").alias("tf"))


def term_table(occ: DataFrame, params: KeyphraseParams = KeyphraseParams()) -> DataFrame:
    """(corpus, doc_id, term, n, size, tf, first_pos) in one aggregation.

    Where two sizes give the same folded term, the longer one's numbers count.
    """
    sizes = params.gram_sizes
    per_size = [a for n in sizes for a in (
        F.count(F.when(F.col("size") == n, 1)).alias(f"tf{n}"),
        F.min(F.when(F.col("size") == n, F.col("pos") + 1)).alias(f"pos{n}"))]
    extra = []
    if "title_terms" in occ.columns:
        extra = [F.max(F.expr("array_contains(title_terms, term)")).alias("in_title"),
                 F.max("title_len").alias("title_len")]
    longest = F.coalesce(*[F.when(F.col(f"tf{n}") > 0, F.lit(n)) for n in reversed(sizes)])
    return occ.groupBy(*DOC, "term").agg(*per_size, *extra).select(
        *DOC, "term", (tx.count_underscores(F.col("term")) + 1).alias("n"),
        longest.alias("size"),
        F.coalesce(*[F.nullif(F.col(f"tf{n}"), F.lit(0)) for n in reversed(sizes)]).alias("tf"),
        F.coalesce(*[F.col(f"pos{n}") for n in reversed(sizes)]).alias("first_pos"),
        *(["in_title", "title_len"] if extra else []))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of a task as one sorted text per part and corpus."""
    def handed() -> Iterator[pa.RecordBatch]:
        distinct = pa.Table.from_batches(held).group_by(["part", "corpus", "term"], use_threads=False).aggregate([]).sort_by("term")
        lists = distinct.group_by(["part", "corpus"], use_threads=False).aggregate([("term", "list")])
        return iter(pa.table([lists["part"], lists["corpus"], pc.binary_join(lists["term_list"], "\n")],
                             names=["part", "corpus", "terms"]).to_batches())

    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(b.nbytes for b in held) >= HELD:
            yield from handed()
            held.clear()
    if held:
        yield from handed()


def distinct_terms(terms: DataFrame, docs: DataFrame) -> DataFrame:
    """(corpus, term, n), every term of a corpus once; terms are of the docs, not null and hold no line breaks.

    They leave a task as the sorted lines of one text per part and corpus, not as rows with their keys. Phrases
    that begin with the same two words lie in one part, so lines repeat those before, which compresses well.
    The parts are as many as the text asks for, so that the terms that meet in a task do not grow with the table.
    """
    parts = text_parts(docs, MET_TEXT)
    part = F.pmod(F.xxhash64("corpus", F.substring_index("term", "_", 2)), F.lit(parts)).cast("int")
    schema = f"part int, corpus {terms.schema['corpus'].dataType.simpleString()}, terms string"
    lists = terms.select(part.alias("part"), "corpus", "term").mapInArrow(_listed, schema).repartitionById(parts, F.col("part"))
    return (lists.select("part", "corpus", F.explode(F.split("terms", "\n")).alias("term")).distinct()
            .select("corpus", "term", (tx.count_underscores(F.col("term")) + 1).alias("n")))


def corpus_sizes(docs: DataFrame, settings: DataFrame | None = None) -> DataFrame:
    """(corpus, n_docs), with settings (show, term_len_decay) also `decay`, null where a show has none.

    A row per corpus, kept as a table: so its size is known, and the terms that meet it by corpus are
    neither taken for the smaller side nor shuffled to a task per corpus.
    """
    sizes = docs.groupBy("corpus").agg(F.count("*").alias("n_docs"))
    if settings is not None:
        sizes = sizes.join(settings.select(F.col("show").alias("corpus"), F.col("term_len_decay").alias("decay")), "corpus", "left")
    return stored(sizes, "sizes")


def document_frequency(tokens: DataFrame, params: KeyphraseParams = KeyphraseParams()) -> DataFrame:
    """(corpus, term, df) for terms of one or two words; longer ones count as unique.

    The tokens are already spread by document, so making a document's terms
    distinct stays local and only per-task counts are shuffled by term.
    """
    occ = gram_rows(bare(tokens), params.gram_sizes, params.remove_stopwords)
    return (occ.where(tx.count_underscores(F.col("term")) < 2)
            .groupBy(*DOC, "term").agg(F.lit(1).alias("one"))
            .groupBy("corpus", "term").agg(F.count("*").alias("df")))


def idf_column(n: Column, df: Column, n_docs: Column) -> Column:
    return F.when(n <= 2, F.ln(n_docs / df)).otherwise(F.ln(n_docs))


def idf_table(terms: DataFrame, df: DataFrame, sizes: DataFrame) -> DataFrame:
    """(corpus, term, idf) for every term of the corpus. Only short terms, whose frequency counts, meet it."""
    def of_corpus(rows: DataFrame) -> DataFrame:
        return rows.groupBy("corpus", "term").agg(F.first("n").alias("n"))

    return (join_dimension(_with_frequency(terms.select("corpus", "term", "n"), df, of_corpus), sizes, ["corpus"])
            .select("corpus", "term", idf_column(F.col("n"), F.col("df"), F.col("n_docs")).alias("idf")))


def _with_frequency(terms: DataFrame, df: DataFrame, made: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> DataFrame:
    """What is made of the terms, with df; that is null and not looked up for more than two words, which are not sorted for it."""
    short, long = made(terms.where("n <= 2")), made(terms.where("n > 2"))
    return short.join(df, ["corpus", "term"], "left").unionByName(long.withColumn("df", F.lit(None).cast("long")))


def with_tfidf(terms: DataFrame, df: DataFrame, sizes: DataFrame, apart: bool = True) -> DataFrame:
    """Add tfidf. The join on (corpus, term) may be hot; adaptive skew handling splits it.

    Long terms do without the join, at the price of reading the terms twice; not so where they are not
    to be read `apart`, as few rows of a costly plan.
    """
    sized = terms if "n_docs" in terms.columns else join_dimension(terms, sizes, ["corpus"])
    idf = idf_column(F.col("n"), F.col("df"), F.col("n_docs"))
    met = _with_frequency(sized, df) if apart else sized.join(df, ["corpus", "term"], "left")
    return met.withColumn("tfidf", F.col("tf") * idf).drop("df", "n_docs")


def subsumption_corrected(terms: DataFrame) -> DataFrame:
    """Take from each word's count the counts of the phrases that hold it.

    One aggregation: a phrase sends its count to its words, a term its own row to itself. The columns of
    that row travel one by one, so that they are summed up by hash and nothing is sorted.
    """
    rest = [c for c in terms.columns if c not in (*DOC, "term")]
    met = F.concat(F.array("term"), F.when(F.col("n") >= 2, F.split("term", "_")).otherwise(F.array().cast("array<string>")))
    itself = F.col("at") == 0
    held = F.sum(F.when(itself, F.lit(0)).otherwise(F.col("tf")).cast("long")).alias("held")
    own = [F.first(F.when(itself, F.col(c)), ignorenulls=True).alias(c) for c in rest]
    summed = (terms.select(*DOC, *rest, F.posexplode(met).alias("at", "met")).groupBy(*DOC, F.col("met").alias("term"))
              .agg(F.max(itself).alias("itself"), *own, held).where("itself"))
    return summed.withColumn("tf", F.when(F.col("n") == 1, F.col("tf") - F.col("held")).otherwise(F.col("tf"))).select(
        *terms.columns)


def first_position_factor(pos: Column, cutoff: int = 5000) -> Column:
    return F.ln(F.lit(500.0) + F.lit(float(cutoff)) / pos)


def length_factor(n: Column, decay: bool | Column = True) -> Column:
    if isinstance(decay, bool):
        return F.ln(n + F.lit(1.0)) if decay else n.cast("double")
    return F.when(decay, F.ln(n + F.lit(1.0))).otherwise(n.cast("double"))


def title_factor(n: Column, title_len: Column) -> Column:
    return ((n - 1) / title_len) * F.ln(n.cast("double")) + 1


def _score(terms: DataFrame, tfidf: Column, params: KeyphraseParams) -> Column:
    decay = F.coalesce("decay", F.lit(params.term_len_decay)) if "decay" in terms.columns else params.term_len_decay
    score = (tfidf * first_position_factor(F.col("first_pos"), params.position_cutoff)
             * length_factor(F.col("n"), decay))
    if params.include_title:
        score = score * F.when(F.col("in_title"), title_factor(F.col("n"), F.col("title_len"))
                               ).otherwise(1.0)
    return score


def with_score(terms: DataFrame, params: KeyphraseParams = KeyphraseParams()) -> DataFrame:
    kept = terms.where(F.col("first_pos") <= params.position_cutoff) if params.drop_after_cutoff else terms
    return kept.withColumn("score", _score(terms, F.col("tfidf"), params)).drop("decay")


def document_terms(tokens: DataFrame, params: KeyphraseParams = KeyphraseParams()) -> DataFrame:
    terms = term_table(occurrences(tokens, params), params)
    return subsumption_corrected(terms) if params.correct_subsum else terms


def scored_terms(docs: DataFrame, params: KeyphraseParams = KeyphraseParams()) -> DataFrame:
    tokens = tokenized(docs, params)
    weighted = with_tfidf(document_terms(tokens, params), document_frequency(tokens, params),
                          corpus_sizes(docs))
    return with_score(weighted, params)


def top_terms(scored: DataFrame, params: KeyphraseParams = KeyphraseParams()) -> DataFrame:
    order = [settle(F.col("score")).desc(), "n", "first_pos", "term"]
    return top_k(scored, DOC, order, params.take_top)


def contenders(terms: DataFrame, params: KeyphraseParams = KeyphraseParams()) -> DataFrame:
    """Terms that can still reach a document's top list, found without any shuffle.

    Long phrases have their final score already, as their idf is ln N. The score
    of a shorter term is at most what idf ln N would give it. So a shorter term
    below the document's k-th long phrase can never be listed; the same top list
    comes out, and far fewer rows go on to the join with the frequencies.
    """
    bound = settle(_score(terms, F.col("tf") * F.ln("n_docs"), params))
    doc = Window.partitionBy(*DOC)
    order = [(F.col("n") >= 3).desc(), F.col("bound").desc(), "n", "first_pos", "term"]
    last = F.max(F.when((F.col("place") == params.take_top) & (F.col("n") >= 3), F.col("bound")))
    kept = terms.where(F.col("first_pos") <= params.position_cutoff) if params.drop_after_cutoff else terms
    return (kept.withColumn("bound", bound)
            .withColumn("place", F.row_number().over(doc.orderBy(*order)))
            .withColumn("last", last.over(doc))
            .where(F.when(F.col("n") >= 3, F.col("place") <= params.take_top)
                   .otherwise(F.col("last").isNull() | (F.col("bound") >= F.col("last"))))
            .drop("bound", "place", "last"))


def _reaching(n: np.ndarray, tf: np.ndarray, first: np.ndarray, factor: np.ndarray | float, n_docs: int, decay: bool,
              params: KeyphraseParams) -> np.ndarray:
    """Which terms of a document contenders() may keep."""
    bound = tf * np.log(n_docs) * np.log(500.0 + params.position_cutoff / first) * (np.log(n + 1.0) if decay else n) * factor
    within = first <= params.position_cutoff if params.drop_after_cutoff else np.ones(len(n), bool)
    long = bound[(n >= 3) & within]
    if len(long) >= params.take_top:
        last = np.partition(long, -params.take_top)[-params.take_top]
        within &= bound >= last - 1e-7 * (1 + abs(last))
    return np.flatnonzero(within)


def _leading(lists: list[list[str]], titles: list[tuple[list[str], int]], n_docs: int, decay: bool, params: KeyphraseParams) -> list[tuple]:
    """(term, n, size, tf, first_pos[, in_title, title_len]) of the terms of one document that contenders() may keep."""
    counted = phrases.counted_terms(lists, params.gram_sizes, params.remove_stopwords)
    if not counted:
        return []
    terms = list(counted)
    size, tf, first = np.array(list(counted.values()), np.int64).T
    n = np.array([term.count("_") + 1 for term in terms])
    factor, entitled = 1.0, []
    if titles:
        held = [(set(words), length, None if len(lists) == 1 else phrases.counted_terms([tokens], params.gram_sizes, params.remove_stopwords))
                for (words, length), tokens in zip(titles, lists)]
        for term in terms:  # titles of the rows that hold the term
            rows = [(term in title, length) for title, length, own in held if own is None or term in own]
            entitled.append((any(x for x, _ in rows), max(length for _, length in rows)))
        within, length = np.array(entitled).T
        factor = np.where(within > 0, (n - 1) / np.maximum(length, 1) * np.log(n) + 1, 1.0)
    kept = _reaching(n, tf, first, factor, n_docs, decay, params).tolist()
    columns = [x.tolist() for x in (n, size, tf, first)]
    return [(terms[i], *(x[i] for x in columns), *(entitled[i] if entitled else ())) for i in kept]


def _leading_plain(held: phrases.Texts, doc: int, titles: list[tuple[list[str], int]], n_docs: int, decay: bool,
                   params: KeyphraseParams) -> tuple[np.ndarray, ...]:
    """(place among all words, n, tf, first_pos, in_title, title_len) of the terms of a plain document that contenders() may keep."""
    start = held.at[held.of[doc]]
    found = [held.phrases(doc, size, params.remove_stopwords) for size in params.gram_sizes]
    n = np.repeat(params.gram_sizes, [len(x[0]) for x in found])
    at, tf = (np.concatenate([x[i] for x in found]) for i in (1, 2))
    factor, within, length = 1.0, np.zeros(len(n), bool), 0
    if titles:
        (words, length), = titles
        within = np.concatenate([np.isin(x[0], held.numbers(words, size)) for x, size in zip(found, params.gram_sizes)])
        factor = np.where(within, (n - 1) / max(length, 1) * np.log(n) + 1, 1.0)
    kept = _reaching(n, tf, at - start + 1, factor, n_docs, decay, params)
    return at[kept], n[kept], tf[kept], at[kept] - start + 1, within[kept], np.full(len(kept), length)


def leading_terms(tokens: DataFrame, sizes: DataFrame, params: KeyphraseParams = KeyphraseParams()) -> DataFrame:
    """document_terms() with the sizes of their corpus, without what cannot reach the document's top list, as contenders().

    A kernel counts the terms of a document and leaves out those whose score is surely below that of its k-th long
    phrase, so that few terms become rows. Terms within rounding of that stay, which changes no list.
    """
    kinds = {"term": pa.string(), "n": pa.int32(), "size": pa.int32(), "tf": pa.int64(), "first_pos": pa.int32()}
    if params.include_title:
        kinds |= {"in_title": pa.bool_(), "title_len": pa.int32()}
    names = {pa.string(): "string", pa.int32(): "int", pa.int64(): "bigint", pa.bool_(): "boolean"}

    @F.arrow_udf("array<struct<" + ",".join(f"{c}:{names[kind]}" for c, kind in kinds.items()) + ">>")
    def leading(texts: pa.Array, n_docs: pa.Array, decay: pa.Array) -> pa.Array:
        rows = pc.list_flatten(texts)
        held = phrases.Texts(pa.ListArray.from_arrays(texts.offsets, rows.field("tokens")) if texts.offset == 0 else pa.array(
            [[of["tokens"] for of in row] for row in texts.to_pylist()], pa.list_(pa.list_(pa.string()))))
        plain = held.plain & held.numbered(max(params.gram_sizes))
        titles = [[]] * len(texts)
        if params.include_title:
            titles = [[(of["title_terms"] or [], of["title_len"] or 0) for of in row] for row in texts.to_pylist()]
        asked = list(zip(n_docs.to_pylist(), decay.to_pylist()))
        swift = [_leading_plain(held, doc, titles[doc], *asked[doc], params) for doc in np.flatnonzero(plain)]
        sizes = np.zeros(len(texts), np.int64)
        sizes[plain] = [len(x[0]) for x in swift]
        at, n, tf, first, within, length = (np.concatenate(x) for x in zip(*swift)) if swift else [np.empty(0, np.int64)] * 6
        order = np.argsort(n, kind="stable")  # the phrases are put together by size
        labels = [held.labels(at[n == size], size) for size in params.gram_sizes]
        terms = pa.concat_arrays(labels).take(pa.array(np.argsort(order)))
        others = [_leading(held.lists(doc), titles[doc], *asked[doc], params) for doc in np.flatnonzero(~plain).tolist()]
        sizes[~plain] = [len(x) for x in others]
        columns = list(zip(*[term for of in others for term in of])) or [[] for _ in kinds]
        slow = [pa.array(x, kind) for x, kind in zip(columns, kinds.values())]
        numbers = (n, n, tf, first, within.astype(bool), length)
        fast = [terms, *(pa.array(x, kind) for x, kind in zip(numbers, list(kinds.values())[1:]))]
        # rows of plain documents come first; they are put in the order of the documents
        doc = np.r_[np.repeat(np.flatnonzero(plain), sizes[plain]), np.repeat(np.flatnonzero(~plain), sizes[~plain])]
        sort = pa.array(np.argsort(doc, kind="stable"))
        found = pa.StructArray.from_arrays([pa.concat_arrays([x, y]).take(sort) for x, y in zip(fast, slow)], names=list(kinds))
        return pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)], pa.int32()), found)

    held = [F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens"), *(["title_terms", "title_len"] if params.include_title else [])]
    texts = tokens.groupBy(*DOC).agg(F.collect_list(F.struct(*held)).alias("texts"))
    sized = join_dimension(texts, sizes, ["corpus"])
    own = ["n_docs", *(["decay"] if "decay" in sizes.columns else [])]
    common = F.lit(params.term_len_decay)
    decay = F.coalesce("decay", common) if "decay" in sizes.columns else common
    return sized.select(*DOC, *own, F.inline(leading("texts", "n_docs", decay))).select(*DOC, *kinds, *own)


def contenders_of_few(terms: DataFrame, params: KeyphraseParams = KeyphraseParams()) -> DataFrame:
    """As contenders(), for few documents of any number of terms: no task gets the terms of one document.

    The long phrases are limited in every task before they meet; shorter terms meet their document's bound
    only. The terms are read twice.
    """
    bound = settle(_score(terms, F.col("tf") * F.ln("n_docs"), params))
    kept = terms.where(F.col("first_pos") <= params.position_cutoff) if params.drop_after_cutoff else terms
    kept = kept.withColumn("bound", bound)
    order = [F.col("bound").desc(), "n", "first_pos", "term"]
    long = top_k(kept.where("n >= 3"), DOC, order, params.take_top, "place")
    last = long.where(F.col("place") == params.take_top).select(*DOC, F.col("bound").alias("last"))
    short = kept.where("n < 3").join(last, list(DOC), "left").where("last IS NULL OR bound >= last")
    return short.drop("bound", "last").unionByName(long.drop("bound", "place"))


def keyphrase_candidates(docs: DataFrame, params: KeyphraseParams = KeyphraseParams(),
                         settings: DataFrame | None = None, tokens: DataFrame | None = None) -> DataFrame:
    """Each document's top terms by statistical score, with their rank.

    settings (show, term_len_decay) has what single corpora want otherwise; tokens are those of
    tokenized(), where they are kept already.
    """
    tokens = tokenized(docs, params) if tokens is None else tokens
    sizes = corpus_sizes(docs, settings)
    if "own" in tokens.columns:
        kept = contenders_of_few(stored(join_dimension(document_terms(tokens, params), sizes, ["corpus"]), "terms"), params)
    elif params.correct_subsum:
        kept = contenders(join_dimension(document_terms(tokens, params), sizes, ["corpus"]), params)
    else:
        kept = leading_terms(tokens, sizes, params)
    weighted = with_tfidf(kept, document_frequency(tokens, params), None, apart=False)
    return top_terms(with_score(weighted, params), params)
