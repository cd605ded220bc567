"""One registered query per operator, each over whole given tables."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from checks import config
from dialoom.functions import text as tx
from dialoom.operators import cooccurrence as co
from dialoom.operators import documents as dc
from dialoom.operators import names as nm
from dialoom.operators import pages as pg
from dialoom.operators import sentences as st
from dialoom.operators import similar as sm
from dialoom.operators import speakers as sp
from dialoom.operators import terms as tm
from dialoom.operators.centrality import rank_rows
from dialoom.params import KeyphraseParams, NameParams, RankParams, ShowParams
from dialoom.plans import results as rs
from dialoom.plans.keyphrases import keyphrases, segment_keyphrases
from dialoom.plans.summaries import dense_summaries, sentence_ranks, summaries, summary_length_choice
from dialoom.session import cut_lineage, ensure_checkpoint_dir, stored
from dialoom.sources import tables as tb

DOC = ["corpus", "doc_id"]
ROUNDS = RankParams(rounds=config.RANK_ROUNDS)
NAMES = NameParams(min_ratio=config.MIN_RATIO)
TITLED = KeyphraseParams(include_title=True)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def docs(spark, sf, prefix: str = "", title: bool = False) -> DataFrame:
    d = table(spark, sf, "documents")
    text = F.concat(F.lit(prefix), "text") if prefix else F.col("text")
    extra = [F.array_join(F.slice(F.split("text", " "), 1, 6), " ").alias("title")] if title else []
    return d.select(F.col("source").alias("corpus"), "doc_id", text.alias("text"), *extra)


def lines(spark, sf) -> DataFrame:
    """Conversation turns as script lines; the first word of a turn is its speaker."""
    season = (F.col("conv_id") % 7 + 1).cast("int")
    return table(spark, sf, "conversations").select(
        F.upper(F.regexp_extract("text", "^([^ .,]+)", 1)).alias("character_name"),
        F.col("text").alias("line"), F.col("text").alias("narration"),
        F.concat(F.lit("show "), F.col("conv_id") % 3).alias("show"),
        F.concat(F.lit("season "), season, F.lit(" episode "), "conv_id", F.lit(" talk "),
                 F.col("conv_id") % 10).alias("episode"),
        season.alias("season"), F.concat(F.lit("talk/"), "conv_id").alias("url"),
        (F.col("conv_id") * 1000 + F.col("turn")).alias("line_no"))


def aliases(spark) -> DataFrame:
    rows = [(s, json.dumps(config.ALIASES)) for s in config.SHOWS]
    return tb.alias_rows(spark.createDataFrame(rows, "show string, config string"))


def out(df: DataFrame, *cols, **rounded) -> DataFrame:
    """Whole numbers as bigint, scores rounded to the given digits."""
    df = df.select(*cols) if cols else df
    for name, digits in rounded.items():
        df = df.withColumn(name, F.round(name, digits))
    for field in df.schema:
        if isinstance(field.dataType, (T.IntegerType, T.ShortType)) and field.name != "season":
            df = df.withColumn(field.name, F.col(field.name).cast("bigint"))
    return df


def tokens(spark, sf, prefix: str = "") -> DataFrame:
    return tm.tokenized(docs(spark, sf, prefix))


def occ(spark, sf, prefix: str = "") -> DataFrame:
    return tm.occurrences(tokens(spark, sf, prefix))


def terms(spark, sf, prefix: str = "") -> DataFrame:
    return tm.term_table(occ(spark, sf, prefix))


def positions(spark, sf, mode: str = "exact"):
    d = docs(spark, sf)
    tokens = tm.tokenized(d, keep=True)
    top = cut_lineage(tm.keyphrase_candidates(d, tokens=tokens))
    return co.phrase_positions(tokens, top, KeyphraseParams(position_mode=mode)), top


def ranked_graph(spark, sf, measure: str = "pagerank") -> DataFrame:
    d = docs(spark, sf)
    tokens = tm.tokenized(d, keep=True)
    top = cut_lineage(tm.keyphrase_candidates(d, tokens=tokens))
    graphs = co.keyphrase_graphs(co.keyphrase_edges(d, top=top, tokens=tokens, packed=True), co.top_lists(top))
    return rank_rows(graphs, [*DOC, "top"], measure, ROUNDS).select(
        *DOC, (F.col("node") + 1).alias("node"), "rank")


def season_segments(spark, sf) -> DataFrame:
    """What is said in a season, as one document in short segments."""
    rows = lines(spark, sf).select(F.col("show").alias("corpus"), F.col("season").cast("bigint").alias("doc_id"), "line_no", "line")
    return dc.ordered_segments(rows, DOC, "line_no", tx.punctuate(F.col("line")), length=config.SEGMENT_LENGTH)


def sents(spark, sf) -> DataFrame:
    return st.distinct_sentences(docs(spark, sf))


def vectors(spark, sf) -> DataFrame:
    return stored(st.unit_vectors(st.sentence_weights(sents(spark, sf))), "sentence-vectors")


def aliased(spark, sf) -> DataFrame:
    return nm.apply_aliases(lines(spark, sf), aliases(spark))


def open_names(spark, sf) -> DataFrame:
    return nm.unresolved_names(aliased(spark, sf), aliases(spark))


def resolved(spark, sf) -> DataFrame:
    return nm.resolve_names(lines(spark, sf), aliases(spark), NAMES)


def turn_sentences(rows: DataFrame) -> DataFrame:
    """Every sentence of a line stands for a summary sentence of its episode."""
    return rows.select(
        "show", "episode", "line_no", F.posexplode(tx.sentences(F.col("line"))).alias("at", "sentence")).select(
        "show", "episode", (F.col("line_no") * 1000 + F.col("at")).alias("pos"), "sentence")


def all_results(spark, sf, kinds=rs.KINDS, settings=None) -> DataFrame:
    return rs.build_results(lines(spark, sf), aliases(spark), ShowParams(num_characters=config.TOP_NAMES),
                            naming=NAMES, ranking=ROUNDS, kinds=kinds, settings=settings)


def show_settings(spark) -> DataFrame:
    return spark.createDataFrame(list(config.SETTINGS), rs.SETTINGS)


def stored_results(spark, sf) -> str:
    """Results, written to the partitioned store and read back by the lookups."""
    path = _scratch(spark, "results")
    tb.put_results(all_results(spark, sf, ("seasons", "episode_text_similarity")), path)
    return path


def completed_results(spark, sf) -> DataFrame:
    """Half of the entities are stored, then all are asked for and read one show and kind after the other."""
    kinds = ("seasons", "episode_text_similarity")
    path, whole = _scratch(spark, "results"), cut_lineage(all_results(spark, sf, kinds))
    tb.put_results(whole.where(F.xxhash64("entity") % 2 == 0), path)
    tb.results_or_build(spark, path, whole, lambda missing: whole.join(missing, tb.ENTITY, "left_semi"))
    parts = [tb.get_results(spark, path, show, kind) for show in config.SHOWS for kind in kinds]
    return reduce(DataFrame.unionByName, parts)


def table_roundtrip(spark, sf) -> DataFrame:
    """A table made, filled in two steps, read and dropped."""
    name = f"lines_{uuid.uuid4().hex}"
    tb.create_table(spark, name)
    for part in (0, 1):
        tb.append_table(lines(spark, sf).where(F.col("line_no") % 2 == part), name)
    rows = cut_lineage(tb.check_schema(spark.table(name), tb.LINE_SCHEMA))
    tb.drop_table(spark, name)
    return rows


def stored_scan(spark, sf) -> DataFrame:
    """Lines stored once by the first source that works, then scanned by path with filters."""
    path = _scratch(spark, "stored-lines")

    def broken() -> DataFrame:
        raise OSError("no such source")

    tb.first_available(spark, path, broken, lambda: lines(spark, sf))
    return tb.scan_lines(spark, path, cols=["show", "episode", "season", "line_no"], show="show 1", seasons=[2, 4])


def told_lines(spark, sf) -> DataFrame:
    """Script lines of all pages, with show and season as constants."""
    pages = table(spark, sf, "pages").select("page_id", "url", "html", F.lit("pages").alias("show"), F.lit(1).alias("season"))
    return tb.check_schema(pg.script_lines(pages, r"example\.(?:com|net|org)/", ""), tb.LINE_SCHEMA)


def referring_pages(spark, sf) -> DataFrame:
    """Pages with a paragraph of references before, made of their number and size."""
    return table(spark, sf, "pages").select("page_id", F.concat(
        F.lit("<p>&#"), F.col("page_id") * 7919 % 70000, F.lit(";&#x"), F.hex(F.length("html") * 31 % 1200000), F.lit(";&#"),
        F.col("page_id") % 300, F.lit(";&eacute;&amp;lt;&nope;&lt&</p>"), "html").alias("html"))


def _scratch(spark, name: str) -> str:
    """A new path in the folder the driver and all executors share."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def season_results(spark, sf) -> DataFrame:
    return dc.season_index(lines(spark, sf)).select(
        "show", F.lit("seasons").alias("kind"), F.col("season_key").alias("entity"),
        F.lit(None).cast("int").alias("rank"), F.col("episode").alias("item"),
        F.col("first_line").cast("double").alias("score"))


def tsv_roundtrip(spark, sf) -> DataFrame:
    path = _scratch(spark, "lines")
    tb.append_tsv(lines(spark, sf), path)
    return tb.read_tsv(spark, path)


def lookup(spark, sf) -> DataFrame:
    stored = spark.read.schema(tb.RESULT_SCHEMA).parquet(stored_results(spark, sf))
    return stored.where("kind = 'episode_text_similarity'")


def page_lines(spark, sf) -> DataFrame:
    return table(spark, sf, "pages").select("page_id", F.posexplode(
        pg.split_lines(pg.page_text(F.col("html")))).alias("at", "line"))


def spelled(spark, sf) -> DataFrame:
    # the key by its remainder, as its square times a million leaves the range of long from 3,037,000 on
    key = F.col("l_orderkey") % 1000000007
    token = (key * key % 1000000007 * 1000003 % 1000000007 * F.col("l_partkey")).cast("string")
    return table(spark, sf, "lineitem").select(
        F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("i"), tx.number_words(token).alias("words"))


def scored(spark, sf) -> DataFrame:
    return tm.scored_terms(docs(spark, sf))


def idf(spark, sf) -> DataFrame:
    d = docs(spark, sf)
    tok = tm.tokenized(d)
    return tm.idf_table(tm.document_terms(tok), tm.document_frequency(tok), tm.corpus_sizes(d))


def gaps(spark, sf) -> DataFrame:
    window = Window.partitionBy(*DOC).orderBy("start", "rank")
    return positions(spark, sf)[0].select(
        *DOC, "rank", "start", "end", F.lead("start").over(window).alias("s2"),
        F.lead("end").over(window).alias("e2")).where("s2 is not null").withColumn(
        "gap", co.interval_gap(F.col("start"), F.col("end"), F.col("s2"), F.col("e2")))


def candidates(spark, sf) -> DataFrame:
    d = docs(spark, sf)
    ranked = sentence_ranks(d, ranking=ROUNDS)
    return st.candidate_similarity(st.unit_vectors(st.sentence_weights(st.distinct_sentences(d))), ranked,
                                   st.SummaryParams())


def lengths(spark, sf) -> DataFrame:
    d = docs(spark, sf)
    return summary_length_choice(d, sentence_ranks(d, ranking=ROUNDS))


def dense(spark, sf) -> DataFrame:
    """Vectors as sentences of their label, with the text of the document that has their number."""
    v = table(spark, sf, "embeddings").where("label IS NOT NULL").select(
        F.lit("labels").alias("corpus"), F.col("label").cast("bigint").alias("doc_id"), F.col("vec_id").alias("pos"), F.col("embedding").alias("v"))
    texts = table(spark, sf, "documents").select(F.col("doc_id").alias("pos"), F.col("text").alias("sentence"))
    return dense_summaries(v.drop("v").join(texts, "pos", "left"), v, ranking=ROUNDS)


def spoken(spark, sf) -> DataFrame:
    told = F.concat(F.initcap("role"), F.lit(" ("), "turn", F.lit("): "), "text")
    return table(spark, sf, "conversations").select("conv_id", "turn", told.alias("line")).select(
        "conv_id", "turn", pg.speaker(F.col("line")).alias("character_name"), pg.quote(F.col("line")).alias("quote"))


def punctuated(spark, sf) -> DataFrame:
    """Turns as they are, and with other endings put behind them."""
    end = F.when(F.col("turn") % 3 == 0, "").when(F.col("turn") % 3 == 1, " and").otherwise("?")
    return table(spark, sf, "conversations").select(
        "conv_id", "turn", tx.punctuate(F.concat("text", end)).alias("line"))


def slugs(spark, sf) -> DataFrame:
    name = F.col("p_name")
    return table(spark, sf, "part").select(
        "p_partkey", tx.url_slug(name).alias("slug"), tx.table_name(name).alias("table_name"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    edge = ["corpus", "doc_id", "src", "dst"]
    dim = [("href", h) for h in config.LINK_EXCLUDED]
    return {
        "scan_lines": lambda s, d: out(tb.select_lines(lines(s, d), ["show", "episode", "line_no", "character_name"])),
        "scan_season": lambda s, d: tb.select_lines(lines(s, d), seasons=[1, 3]),
        "sink_tsv_roundtrip": tsv_roundtrip,
        "embedding_cast": lambda s, d: out(table(s, d, "embeddings").select(
            "vec_id", F.posexplode(tb.decode_vector(F.col("embedding"))).alias("at", "element")), element=6),
        "lines_json": lambda s, d: pg.lines_json(lines(s, d), ["character_name", "season", "url"]),
        "sink_cleanup": lambda s, d: table(s, d, "documents").select(
            "doc_id", tb.sink_clean(F.concat(F.lit("it’s\t"), "text")).alias("text")),
        "page_links": lambda s, d: out(pg.page_links(table(s, d, "pages"))),
        "page_links_excluded": lambda s, d: out(pg.without_links(
            pg.page_links(table(s, d, "pages")), s.createDataFrame([(h,) for _, h in dim], "href string"))),
        "page_paragraphs": lambda s, d: out(table(s, d, "pages").select(
            "page_id", F.posexplode(pg.paragraphs(F.col("html"))).alias("at", "paragraph"))),
        "page_text": lambda s, d: table(s, d, "pages").select("page_id", pg.page_text(F.col("html")).alias("text")),
        "page_references": lambda s, d: referring_pages(s, d).select("page_id", pg.page_text(F.col("html")).alias("text")),
        "script_lines": lambda s, d: out(page_lines(s, d)),
        "page_script_lines": told_lines,
        "stored_scan": stored_scan,
        "table_roundtrip": table_roundtrip,
        "results_on_miss": lambda s, d: out(completed_results(s, d), score=6),
        "speaker_parse": spoken,
        "url_slug": lambda s, d: table(s, d, "pages").select(
            "page_id", pg.episode_slug(F.col("url"), r"example\.(?:com|net|org)/", "").alias("slug")),
        "lines_union": lambda s, d: lines(s, d).select("line_no", "narration").unionByName(
            page_lines(s, d).select((F.col("page_id") * 4294967296 + F.col("at")).alias("line_no"),
                                    F.col("line").alias("narration"))),
        "name_slug": slugs,
        "alias_resolve": lambda s, d: aliased(s, d).select("line_no", "character_name"),
        "stage_directions": lambda s, d: aliased(s, d).where("character_name = ''").select(
            "line_no", "character_name", "line", "narration"),
        "fuzzy_names": lambda s, d: out(nm.fuzzy_matches(open_names(s, d), aliases(s), NAMES),
                                        "show", "character_name", "canonical", "ratio"),
        "levenshtein_names": lambda s, d: out(nm.edit_matches(open_names(s, d), aliases(s), NameParams(
            min_ratio=config.EDIT_RATIO)), "show", "character_name", "canonical", "ratio", ratio=6),
        "partial_names": lambda s, d: nm.partial_matches(open_names(s, d), aliases(s)).select(
            "show", "character_name", "canonical"),
        "partial_ratio_names": lambda s, d: nm.partial_matches(open_names(s, d), aliases(s), NameParams(
            min_partial_ratio=config.PARTIAL_RATIO)).select("show", "character_name", "canonical"),
        "resolve_names": lambda s, d: resolved(s, d).select("line_no", "character_name", "line", "narration"),
        "punctuate": punctuated,
        "episode_docs": lambda s, d: dc.episode_documents(lines(s, d)).select("show", "episode", "text"),
        "episode_order": lambda s, d: dc.episode_order(lines(s, d)),
        "season_index": lambda s, d: dc.season_index(lines(s, d)),
        "top_speakers": lambda s, d: out(dc.top_speakers(lines(s, d), config.TOP_NAMES)),
        "character_docs": lambda s, d: dc.character_documents(lines(s, d), config.TOP_NAMES).select(
            "show", "character_name", "text"),
        "expand_contractions": lambda s, d: docs(s, d, config.PHRASE_PREFIX).select(
            "doc_id", tx.expand_contractions(F.lower("text")).alias("text")),
        "normalize_text": lambda s, d: docs(s, d, config.PHRASE_PREFIX).select(
            "doc_id", tx.normalize_text(F.col("text")).alias("text")),
        "title_prefix": lambda s, d: docs(s, d, title=True).select(
            "doc_id", tx.with_title(F.col("title"), F.col("text")).alias("text")),
        "tokenize": lambda s, d: docs(s, d, config.PHRASE_PREFIX).select("doc_id", F.array_join(F.filter(
            tx.split_words(tx.normalize_text(F.col("text"))), lambda w: w != ""), "|").alias("words")),
        "clean_tokens": lambda s, d: docs(s, d, config.PHRASE_PREFIX).select("doc_id", F.array_join(
            tx.clean_words(tx.split_words(tx.normalize_text(F.col("text")))), "|").alias("words")),
        "number_words": lambda s, d: out(spelled(s, d)),
        "stopword_filter": lambda s, d: out(occ(s, d), *DOC, "size", "pos", "term"),
        "short_filter": lambda s, d: out(occ(s, d).where("size = 1"), *DOC, "pos", "term"),
        "ngrams": lambda s, d: out(tokens(s, d).select(*DOC, F.posexplode(
            tm.grams(F.col("tokens"), 2)).alias("pos", "term"))),
        "possessive_fold": lambda s, d: out(tm.gram_rows(tokens(s, d, config.PHRASE_PREFIX), [3]), *DOC, "pos", "term"),
        "map_sorted": lambda s, d: out(occ(s, d).where("size = 1").groupBy("doc_id", "term").agg(
            F.count("*").alias("tf")).withColumn("rank", F.row_number().over(
                Window.partitionBy("doc_id").orderBy(F.col("tf").desc(), "term")))),
        "term_frequency": lambda s, d: out(tm.term_frequency(occ(s, d))),
        "term_union": lambda s, d: out(terms(s, d, config.PHRASE_PREFIX)),
        "idf": lambda s, d: out(idf(s, d), idf=6),
        "tfidf": lambda s, d: out(scored(s, d), *DOC, "term", "tfidf", tfidf=6),
        "subsumption": lambda s, d: tm.subsumption_corrected(terms(s, d)).select(*DOC, "term", "tf"),
        "first_position": lambda s, d: out(terms(s, d).withColumn("factor", tm.first_position_factor(F.col("first_pos"))),
                                           *DOC, "term", "first_pos", "factor", factor=6),
        "term_length": lambda s, d: out(tm.distinct_terms(terms(s, d), docs(s, d)).select(
            "*", tm.length_factor(F.col("n")).alias("decayed"), tm.length_factor(F.col("n"), False).alias("plain")),
            decayed=6),
        "title_boost": lambda s, d: out(tm.keyphrase_candidates(docs(s, d, title=True), TITLED),
                                        *DOC, "rank", "term", "score", score=6),
        "stat_score": lambda s, d: out(scored(s, d), *DOC, "term", "score", score=6),
        "keyphrase_topk": lambda s, d: out(tm.keyphrase_candidates(docs(s, d)), *DOC, "rank", "term", "score", score=6),
        "phrase_positions": lambda s, d: out(positions(s, d)[0], *DOC, "rank", "term", "start", "end"),
        "phrase_positions_contains": lambda s, d: out(positions(s, d, "contains")[0], *DOC, "rank", "term", "start", "end"),
        "interval_gap": lambda s, d: out(gaps(s, d), *DOC, "rank", "start", "gap"),
        "cooccurrence_edges": lambda s, d: out((lambda pt: co.cooccurrence_edges(pt[0], co.top_lists(pt[1])))(
            positions(s, d)), *edge, "w", w=6),
        "keyphrase_graph": lambda s, d: out(co.keyphrase_edges(docs(s, d)), *DOC, "src_term", "dst_term", "w", w=4),
        "pagerank": lambda s, d: out(ranked_graph(s, d), rank=6),
        "betweenness": lambda s, d: out(ranked_graph(s, d, "betweenness centrality"), rank=6),
        "load_centrality": lambda s, d: out(ranked_graph(s, d, "load centrality"), rank=6),
        "keyphrases": lambda s, d: out(keyphrases(docs(s, d), ranking=ROUNDS), *DOC, "rank", "term", "score", score=6),
        "segment_topk": lambda s, d: out(tm.keyphrase_candidates(
            season_segments(s, d).select(*DOC).distinct(), tokens=tm.segment_tokens(season_segments(s, d))),
            *DOC, "rank", "term", "score", score=6),
        "segment_keyphrases": lambda s, d: out(segment_keyphrases(season_segments(s, d), ranking=ROUNDS),
                                               *DOC, "rank", "term", "score", score=6),
        "sentences": lambda s, d: out(docs(s, d).select(*DOC, F.posexplode(
            tx.sentences(F.col("text"))).alias("at", "sentence"))),
        "sentence_distinct": lambda s, d: out(sents(s, d), *DOC, "pos", "sentence"),
        "sentence_vectors": lambda s, d: out(vectors(s, d), *DOC, "pos", "term", "u", u=6),
        "sentence_graph": lambda s, d: out(st.similar_sentences(vectors(s, d), 0.3), w=6),
        "pairwise_cosine": lambda s, d: out(st.similar_sentences(vectors(s, d), 0.6), w=6),
        "sentence_length_weight": lambda s, d: out(sents(s, d).withColumn(
            "weight", tx.sentence_length_weight(F.col("sentence"))), *DOC, "pos", "weight", weight=6),
        "sentence_rank": lambda s, d: out(sentence_ranks(docs(s, d), ranking=ROUNDS), *DOC, "pos", "rank", "score", score=6),
        "summary_candidates": lambda s, d: out(candidates(s, d), similarity=6),
        "summary_length": lambda s, d: out(lengths(s, d), loss=6),
        "summaries": lambda s, d: out(summaries(docs(s, d), ranking=ROUNDS), score=6),
        "summaries_dense": lambda s, d: out(dense(s, d), "doc_id", "ord", "pos", "score", score=6),
        "doc_vectors": lambda s, d: out(sm.doc_vectors(sm.content_words(docs(s, d))), *DOC, "term", "u", u=6),
        "similar_docs": lambda s, d: out(sm.similar_documents(docs(s, d)), sim=6),
        "similar_embeddings": lambda s, d: out(sm.similar_vectors(table(s, d, "embeddings").select(
            F.col("vec_id").alias("id"), F.col("embedding").alias("v"))), sim=6),
        "speaker_join": lambda s, d: out((lambda rows: sp.speaker_matches(turn_sentences(rows), rows))(cut_lineage(resolved(s, d))),
                                         "show", "episode", "pos", "line_no", "character_name"),
        "speaker_labels": lambda s, d: (lambda rows: sp.speaker_labels(turn_sentences(rows), rows))(cut_lineage(resolved(s, d))).select(
            "show", "episode", "pos", "label"),
        "all_results": lambda s, d: out(all_results(s, d), score=6),
        "all_results_by_show": lambda s, d: out(all_results(s, d, settings=show_settings(s)), score=6),
        "result_lookup": lambda s, d: out(lookup(s, d), "show", "entity", "rank", "item", "score", score=6),
        "result_shows": lambda s, d: rs.shows(season_results(s, d)),
        "result_entities": lambda s, d: rs.entities(season_results(s, d), "show 1", "seasons"),
        "result_episodes": lambda s, d: rs.season_episodes(season_results(s, d), "show 1", "2"),
        "result_episode": lambda s, d: out(rs.episode_page(all_results(s, d, rs.EPISODE_KINDS), "show 1", "season 2 episode 1 talk 1"), score=6),
        "result_character": lambda s, d: out(rs.character_page(all_results(s, d, rs.CHARACTER_KINDS), "show 1", "THE"), score=6),
    }
