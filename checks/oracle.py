"""The registered queries once more, as plain SQL for DuckDB over the same tables.

Each query is a list of named steps put together to one WITH statement. The SQL
takes the direct way (all pairs, naive unions) where the Spark job prunes.
"""

from __future__ import annotations

import re
from html.entities import name2codepoint

from dialoom.functions import wordlists as wl
from checks.config import (ALIAS_ROWS, EDIT_RATIO, LINK_EXCLUDED, MIN_RATIO, PARTIAL_RATIO, PHRASE_PREFIX,
                           RANK_ROUNDS, SETTINGS, TOP_NAMES)

BLANK = r"\s\x0B\x85\p{Z}"
WORD = r"\p{L}\p{N}_"


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fold(expr: str, rules) -> str:
    for pattern, full in rules:
        expr = f"replace({expr}, {q(pattern)}, {q(full)})"
    return expr


def expand(expr: str) -> str:
    return fold(fold(fold(expr, [("’", "'")]), wl.spaced_rules()), wl.apostrophe_rules())


def norm(expr: str) -> str:
    return f"regexp_replace({fold(expand(f'lower({expr})'), wl.RESIDUAL_RULES)}, '[ ]{{2,}}', ' ', 'g')"


def number(w: str) -> str:
    ones = "[" + ", ".join(map(q, wl.ONES)) + "]"
    tens = "['', '', " + ", ".join(map(q, wl.TENS)) + "]"

    def group(i: int) -> str:
        return f"CAST(substr(lpad({w}, {wl.NUMBER_DIGITS}, '0'), {wl.NUMBER_DIGITS - 2 - 3 * i}, 3) AS INTEGER)"

    def below(n: str) -> str:
        rest = f"({n} % 100)"
        small = (f"CASE WHEN {rest} = 0 THEN NULL WHEN {rest} < 20 THEN {ones}[{rest} + 1] ELSE "
                 f"{tens}[{rest} // 10 + 1] || CASE WHEN {rest} % 10 > 0 "
                 f"THEN '-' || {ones}[{rest} % 10 + 1] ELSE '' END END")
        return (f"concat_ws(' and ', CASE WHEN {n} >= 100 THEN {ones}[{n} // 100 + 1] || ' hundred' END, {small})")

    head = "concat_ws(', ', " + ", ".join(
        f"CASE WHEN {group(i)} > 0 THEN {below(group(i))} || ' {wl.SCALES[i - 1]}' END"
        for i in range(len(wl.SCALES), 0, -1)) + ")"
    last = group(0)
    return (f"CASE WHEN NOT regexp_matches({w}, '^[0-9]{{1,{wl.NUMBER_DIGITS}}}$') THEN {w} "
            f"WHEN {head} = '' AND {last} = 0 THEN 'zero' "
            f"WHEN {last} = 0 THEN {head} WHEN {head} = '' THEN {below(last)} "
            f"WHEN {last} < 100 THEN {head} || ' and ' || {below(last)} "
            f"ELSE {head} || ', ' || {below(last)} END")


def raw_words(expr: str) -> str:
    t = f"""regexp_replace({expr}, '([\\[\\](){{}}<>;@#$%&?!"*`«»“”„…]|--|\\.\\.+)', ' ', 'g')"""
    t = f"regexp_replace({t}, '[:,]([^0-9])', ' \\1', 'g')"
    t = (f"regexp_replace({t}, '(''(?:s|m|d|ll|re|ve)|n''t)([.,:''\"]*(?:[{BLANK}]|$))', ' \\1\\2', 'g')")
    cases = " ".join(f"WHEN {q(k)} THEN [{q(a)}, {q(b)}]" for k, (a, b) in wl.SPLIT_WORDS.items())
    return (f"flatten(list_transform(regexp_split_to_array({t}, '[{BLANK}]+'), "
            f"lambda w: CASE w {cases} ELSE [w] END))")


def clean(words: str) -> str:
    return (f"list_filter(list_transform({words}, lambda w: regexp_replace(w, '[^{WORD}]', '', 'g')), "
            "lambda w: w <> '')")


def tokens(expr: str) -> str:
    return f"list_transform({clean(raw_words(expr))}, lambda w: {number('w')})"


STOP = "(" + ", ".join(map(q, wl.STOP_WORDS)) + ")"


def boundary(first: str, last: str) -> str:
    return f"split_part({first}, '_', 1) NOT IN {STOP} AND split_part({last}, '_', -1) NOT IN {STOP}"


def folded(label: str) -> str:
    return f"regexp_replace(replace({label}, '_s_', 's_'), '_s$', 's')"


def underscores(term: str) -> str:
    return f"(length({term}) - length(replace({term}, '_', '')))"


DOCS = [("docs", "SELECT source AS corpus, doc_id, text FROM documents")]
TITLED = [("docs", "SELECT source AS corpus, doc_id, text, "
                   "array_to_string(string_split(text, ' ')[1:6], ' ') AS title FROM documents")]
PHRASED = [("docs", f"SELECT source AS corpus, doc_id, concat({q(PHRASE_PREFIX)}, text) AS text FROM documents")]


def token_steps(p: str = "", title: bool = False) -> list:
    text = "text"
    extra = ""
    if title:
        head = ("regexp_replace(CASE WHEN regexp_matches(lower(title), '[.|?!…]$') THEN lower(title) "
                "ELSE lower(title) || '.' END, '^season [^ ]* episode [^ ]* ', '')")
        text = f"{head} || ' ' || lower(text)"
        extra = ", title"
    steps = [(f"{p}normed", f"SELECT corpus, doc_id, {norm(text)} AS text{extra} FROM {p}docs"),
             (f"{p}toks", f"SELECT corpus, doc_id, {tokens('text')} AS tokens{extra} FROM {p}normed")]
    return steps


def gram_steps(p: str = "", sizes=(1, 2, 3)) -> list:
    words = ", ".join(f"tokens[pos + {i}] AS w{i}" for i in range(1, max(sizes) + 1))
    arms = []
    for n in sizes:
        label = " || '_' || ".join(f"w{i}" for i in range(1, n + 1))
        if n == 1:
            arms.append(f"SELECT corpus, doc_id, pos, 1::BIGINT AS size, w1 AS term FROM {p}placed "
                        f"WHERE {boundary('w1', 'w1')} AND length(w1) > 2")
        else:
            arms.append(f"SELECT corpus, doc_id, pos, {n}::BIGINT AS size, {folded(label)} AS term FROM {p}placed "
                        f"WHERE w{n} IS NOT NULL AND {boundary('w1', f'w{n}')}")
    return [(f"{p}spots", f"SELECT corpus, doc_id, tokens, unnest(range(len(tokens))) AS pos FROM {p}toks"),
            (f"{p}placed", f"SELECT corpus, doc_id, pos, {words} FROM {p}spots"),
            (f"{p}occ", " UNION ALL ".join(arms))]


def term_steps(p: str = "") -> list:
    return [(f"{p}terms", f"SELECT corpus, doc_id, term, {underscores('term')} + 1 AS n, size, count(*) AS tf, "
             f"min(pos) + 1 AS first_pos FROM {p}occ GROUP BY corpus, doc_id, term, size "
             "QUALIFY row_number() OVER (PARTITION BY corpus, doc_id, term ORDER BY size DESC) = 1"),
            (f"{p}freq", f"SELECT corpus, term, count(*) AS df FROM {p}terms WHERE n <= 2 GROUP BY ALL"),
            (f"{p}counts", f"SELECT corpus, count(*) AS n_docs FROM {p}docs GROUP BY corpus")]


def by_show(column: str, values: dict, usual: str) -> str:
    """A value per show, else the usual one."""
    arms = " ".join(f"WHEN {q(show)} THEN {value}" for show, value in values.items())
    return f"CASE {column} {arms} ELSE {usual} END" if arms else usual


def score_steps(p: str = "", title: bool = False, source: str = "terms", settings=()) -> list:
    decayed = "ln(n + 1.0::DOUBLE)"
    length = by_show("corpus", {s[0]: "n::DOUBLE" for s in settings if s[3] is False}, decayed)
    boost, join = "1.0", ""
    steps = []
    if title:
        words = clean(raw_words("lower(title)"))
        steps = [(f"{p}titles", f"SELECT corpus, doc_id, {words} AS tw FROM {p}toks"),
                 (f"{p}labels", f"SELECT corpus, doc_id, len(tw) AS t, list_distinct(list_concat(tw, "
                  f"list_transform(range(1, len(tw)), lambda i: {folded('''tw[i] || '_' || tw[i + 1]''')}), "
                  f"list_transform(range(1, len(tw) - 1), lambda i: "
                  f"{folded('''tw[i] || '_' || tw[i + 1] || '_' || tw[i + 2]''')}))) AS labels FROM {p}titles")]
        join = f"JOIN {p}labels l USING (corpus, doc_id)"
        boost = ("CASE WHEN list_contains(l.labels, term) THEN ((n - 1) / l.t::DOUBLE) "
                 "* ln(n::DOUBLE) + 1 ELSE 1.0 END")
    return steps + [
        (f"{p}idf", f"SELECT t.corpus, t.term, any_value(CASE WHEN n <= 2 THEN ln(n_docs::DOUBLE / df) "
         f"ELSE ln(n_docs::DOUBLE) END) AS idf FROM {p}terms t LEFT JOIN {p}freq f USING (corpus, term) "
         f"JOIN {p}counts USING (corpus) GROUP BY t.corpus, t.term"),
        (f"{p}scored", f"SELECT corpus, doc_id, term, n, size, tf, first_pos, tf * idf AS tfidf, "
         f"tf * idf * ln(500 + 5000.0::DOUBLE / first_pos) * {length} * {boost} AS score "
         f"FROM {p}{source} JOIN {p}idf USING (corpus, term) {join}"),
        (f"{p}top", "SELECT *, row_number() OVER (PARTITION BY corpus, doc_id ORDER BY round(score, 9) DESC, "
         f"n, first_pos, term) AS rank FROM {p}scored QUALIFY rank <= 50")]


def missing(a: str, b: str) -> str:
    return f"len(list_filter({a}, lambda w: NOT list_contains({b}, w)))"


def edge_steps(p: str = "") -> list:
    return [
        (f"{p}pos", f"SELECT o.corpus, o.doc_id, t.rank, t.term, o.pos AS s, o.pos + o.size - 1 AS e "
         f"FROM {p}occ o JOIN {p}top t USING (corpus, doc_id, term, size)"),
        (f"{p}ws", f"SELECT corpus, doc_id, rank, score, term, string_split(term, '_') AS ws FROM {p}top"),
        (f"{p}diff", f"SELECT a.corpus, a.doc_id, a.rank AS src, b.rank AS dst, a.score * b.score AS both, "
         f"a.term AS src_term, b.term AS dst_term, greatest({missing('a.ws', 'b.ws')}, {missing('b.ws', 'a.ws')}) AS f "
         f"FROM {p}ws a JOIN {p}ws b ON a.corpus = b.corpus AND a.doc_id = b.doc_id AND a.rank < b.rank"),
        (f"{p}gaps", f"SELECT a.corpus, a.doc_id, least(a.rank, b.rank) AS src, greatest(a.rank, b.rank) AS dst, "
         f"b.s - a.e AS d, count(*) AS c FROM {p}pos a JOIN {p}pos b ON a.corpus = b.corpus AND a.doc_id = b.doc_id "
         f"AND b.s > a.e AND b.s - a.e < 500 AND a.rank <> b.rank GROUP BY ALL"),
        (f"{p}edges", f"SELECT corpus, doc_id, src, dst, any_value(src_term) AS src_term, "
         f"any_value(dst_term) AS dst_term, any_value(both) AS both, sum(c * ln(500.0::DOUBLE / (d + f))) / sum(c) AS w "
         f"FROM {p}gaps JOIN {p}diff USING (corpus, doc_id, src, dst) GROUP BY corpus, doc_id, src, dst"),
        (f"{p}graph", f"SELECT corpus, doc_id, src, dst, src_term, dst_term, w * both AS w FROM {p}edges WHERE w > 0 AND both > 0")]


def rank_steps(p: str, nodes: str, graph: str, keys=("corpus", "doc_id")) -> list:
    """PageRank for a fixed number of rounds; nodes(keys, node, n), graph(keys, src, dst, w)."""
    k = ", ".join(keys)
    on = " AND ".join(f"a.{c} = b.{c}" for c in keys)
    ak = ", ".join(f"a.{c}" for c in keys)
    rk = ", ".join(f"r.{c}" for c in keys)
    ron = " AND ".join(f"r.{c} = l.{c}" for c in keys)
    return [
        (f"{p}both", f"SELECT {k}, src, dst, w FROM {graph} UNION ALL SELECT {k}, dst, src, w FROM {graph}"),
        (f"{p}out", f"SELECT {k}, src, sum(w) AS total FROM {p}both GROUP BY {k}, src"),
        (f"{p}lone", f"SELECT {ak}, a.node, a.n FROM {nodes} a WHERE NOT EXISTS "
         f"(SELECT 1 FROM {p}out b WHERE {on} AND b.src = a.node)"),
        (f"{p}links", f"SELECT {ak}, a.src, a.dst, a.w / b.total AS share FROM {p}both a JOIN {p}out b "
         f"ON {on} AND a.src = b.src UNION ALL SELECT {ak}, a.node, b.node, 1.0 / a.n FROM {p}lone a "
         f"JOIN {nodes} b ON {on} UNION ALL SELECT {k}, node, node, 0.0 FROM {nodes}"),
        (f"{p}walk0", f"SELECT {k}, node, n, 1.0::DOUBLE / n AS rank FROM {nodes}"),
        *[(f"{p}walk{i}", f"SELECT {rk}, l.dst AS node, r.n, 0.85::DOUBLE * sum(r.rank * l.share) + 0.15::DOUBLE / r.n "
           f"AS rank FROM {p}walk{i - 1} r JOIN {p}links l ON {ron} AND r.node = l.src GROUP BY {rk}, l.dst, r.n")
          for i in range(1, RANK_ROUNDS + 1)],
        (f"{p}ranks", f"SELECT {k}, node, rank FROM {p}walk{RANK_ROUNDS}")]


def keyphrase_steps(p: str = "", title: bool = False, settings=()) -> list:
    steps = (token_steps(p, title) + gram_steps(p) + term_steps(p) + score_steps(p, title, settings=settings) + edge_steps(p)
             + [(f"{p}nodes", f"SELECT corpus, doc_id, rank AS node, count(*) OVER (PARTITION BY corpus, doc_id) AS n "
                 f"FROM {p}top")])
    return steps + rank_steps(f"{p}k_", f"{p}nodes", f"{p}graph") + [
        (f"{p}keyphrases", f"SELECT t.corpus, t.doc_id, t.term, r.rank AS score, row_number() OVER "
         f"(PARTITION BY t.corpus, t.doc_id ORDER BY round(r.rank, 9) DESC, t.rank) AS rank "
         f"FROM {p}top t JOIN {p}k_ranks r ON t.corpus = r.corpus AND t.doc_id = r.doc_id AND t.rank = r.node")]


def sentence_list(text: str) -> str:
    return (f"list_filter(list_transform(regexp_split_to_array({text}, '[.|?!\\n…]'), "
            f"lambda s: regexp_replace(s, '^[{BLANK}]+|[{BLANK}]+$', '', 'g')), lambda s: s <> '')")


def sentence_steps(p: str = "") -> list:
    return [
        (f"{p}cut", f"SELECT corpus, doc_id, {sentence_list('text')} AS ss FROM {p}docs"),
        (f"{p}all_sents", f"SELECT corpus, doc_id, unnest(ss) AS sentence, unnest(range(len(ss))) AS at FROM {p}cut"),
        (f"{p}firsts", f"SELECT corpus, doc_id, sentence, min(at) AS at FROM {p}all_sents GROUP BY ALL"),
        (f"{p}sents", "SELECT corpus, doc_id, sentence, row_number() OVER (PARTITION BY corpus, doc_id ORDER BY at) - 1 "
         f"AS pos, count(*) OVER (PARTITION BY corpus, doc_id) AS n_sentences FROM {p}firsts")]


def vector_steps(p: str = "") -> list:
    return [
        (f"{p}sn", f"SELECT corpus, doc_id, pos, n_sentences, {norm('sentence')} AS text FROM {p}sents"),
        (f"{p}st", f"SELECT corpus, doc_id, pos, n_sentences, unnest({tokens('text')}) AS term FROM {p}sn"),
        (f"{p}tf", f"SELECT corpus, doc_id, pos, n_sentences, term, count(*) AS tf FROM {p}st "
         f"WHERE term NOT IN {STOP} GROUP BY ALL"),
        (f"{p}sw", "SELECT corpus, doc_id, pos, term, tf * (ln((1 + n_sentences) / (1 + count(*) OVER "
         f"(PARTITION BY corpus, doc_id, term))::DOUBLE) + 1) AS w FROM {p}tf"),
        (f"{p}sv", "SELECT corpus, doc_id, pos, term, w, w / sqrt(sum(w * w) OVER (PARTITION BY corpus, doc_id, pos)) "
         f"AS u FROM {p}sw"),
        (f"{p}sg", f"SELECT a.corpus, a.doc_id, a.pos AS src, b.pos AS dst, sum(a.u * b.u) AS w FROM {p}sv a "
         f"JOIN {p}sv b ON a.corpus = b.corpus AND a.doc_id = b.doc_id AND a.term = b.term AND a.pos < b.pos "
         "GROUP BY ALL HAVING round(sum(a.u * b.u), 9) >= 0.3")]


def length_weight(s: str) -> str:
    n = f"(len(regexp_extract_all({s}, '[{WORD}] [{WORD}]')) + 1)"
    return f"CASE WHEN {n} < 6 THEN 0.0 ELSE ln(({n} - 6) / 2.0::DOUBLE + 1) + 1 END"


def summary_steps(p: str = "") -> list:
    return (sentence_steps(p) + vector_steps(p)
            + [(f"{p}snodes", f"SELECT corpus, doc_id, pos AS node, n_sentences AS n FROM {p}sents")]
            + rank_steps(f"{p}s_", f"{p}snodes", f"{p}sg") + [
        (f"{p}valued", f"SELECT s.corpus, s.doc_id, s.pos, s.sentence, r.rank * {length_weight('s.sentence')} AS score "
         f"FROM {p}sents s JOIN {p}s_ranks r ON s.corpus = r.corpus AND s.doc_id = r.doc_id AND s.pos = r.node"),
        (f"{p}ordered", "SELECT *, row_number() OVER (PARTITION BY corpus, doc_id ORDER BY round(score, 9) DESC, pos) "
         f"AS place FROM {p}valued"),
        (f"{p}lead", f"SELECT *, place AS rank FROM {p}ordered WHERE place <= 18"),
        (f"{p}sizes", f"SELECT DISTINCT corpus, doc_id, n FROM {p}lead, unnest(range(4, 19)) AS g(n)"),
        (f"{p}mean", f"SELECT z.corpus, z.doc_id, z.n, v.term, sum(v.u) AS m FROM {p}sizes z JOIN {p}lead l "
         f"ON z.corpus = l.corpus AND z.doc_id = l.doc_id AND l.rank <= z.n JOIN {p}sv v "
         "ON v.corpus = l.corpus AND v.doc_id = l.doc_id AND v.pos = l.pos GROUP BY ALL"),
        (f"{p}whole", f"SELECT corpus, doc_id, term, sum(w) AS d FROM {p}sv GROUP BY ALL"),
        (f"{p}wlen", f"SELECT corpus, doc_id, sqrt(sum(d * d)) AS dl FROM {p}whole GROUP BY ALL"),
        (f"{p}csim", f"SELECT m.corpus, m.doc_id, m.n, sum(m.m * w.d) / (sqrt(sum(m.m * m.m)) * any_value(l.dl)) AS sim "
         f"FROM {p}mean m JOIN {p}whole w USING (corpus, doc_id, term) JOIN {p}wlen l USING (corpus, doc_id) GROUP BY ALL"),
        (f"{p}cand", f"SELECT corpus, doc_id, n, coalesce(sim, 0.0) AS sim FROM {p}sizes LEFT JOIN {p}csim USING (corpus, doc_id, n)"),
        (f"{p}best", f"SELECT corpus, doc_id, n, (1 - sim) * (1 - sim) + 0.001 * n AS loss FROM {p}cand "
         "QUALIFY row_number() OVER (PARTITION BY corpus, doc_id ORDER BY round(loss, 9), n) = 1"),
        (f"{p}summaries", f"SELECT l.corpus, l.doc_id, row_number() OVER (PARTITION BY l.corpus, l.doc_id ORDER BY l.pos) "
         f"AS ord, l.pos, l.sentence, l.score FROM {p}lead l JOIN {p}best b ON l.corpus = b.corpus "
         "AND l.doc_id = b.doc_id AND l.rank <= b.n")])


def dense_steps() -> list:
    """Summaries of labels from given vectors; the sums of leading vectors are taken place by place."""
    return [
        ("dsents", "SELECT 'labels' AS corpus, label::BIGINT AS doc_id, vec_id AS pos, embedding::DOUBLE[] AS v, d.text AS sentence, "
         "row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS node, count(*) OVER (PARTITION BY label) AS n "
         "FROM embeddings e LEFT JOIN documents d ON d.doc_id = e.vec_id WHERE label IS NOT NULL"),
        ("dgraph", "SELECT a.corpus, a.doc_id, a.node AS src, b.node AS dst, list_cosine_similarity(a.v, b.v) AS w FROM dsents a "
         "JOIN dsents b ON a.doc_id = b.doc_id AND a.node < b.node WHERE round(list_cosine_similarity(a.v, b.v), 9) >= 0.3"),
        ("dnodes", "SELECT corpus, doc_id, node, n FROM dsents"),
        *rank_steps("d_", "dnodes", "dgraph"),
        ("dvalued", f"SELECT s.doc_id, s.pos, s.v, r.rank * coalesce({length_weight('s.sentence')}, 1.0) AS score "
         "FROM dsents s JOIN d_ranks r USING (corpus, doc_id, node)"),
        ("dordered", "SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) AS place FROM dvalued"),
        ("dsizes", "SELECT DISTINCT doc_id, n FROM dvalued, unnest(range(4, 19)) AS g(n)"),
        ("dplaces", "SELECT doc_id, place, at, v[at] AS x FROM dordered, unnest(range(1, len(v) + 1)) AS g(at)"),
        ("dwhole", "SELECT doc_id, at, avg(x) AS d FROM dplaces GROUP BY ALL"),
        ("dmean", "SELECT z.doc_id, z.n, p.at, avg(p.x) AS m FROM dsizes z JOIN dplaces p ON z.doc_id = p.doc_id AND p.place <= z.n GROUP BY ALL"),
        ("dbest", "SELECT doc_id, n FROM (SELECT m.doc_id, m.n, sum(m * d) / sqrt(sum(m * m) * sum(d * d)) AS sim "
         "FROM dmean m JOIN dwhole w ON w.doc_id = m.doc_id AND w.at = m.at GROUP BY m.doc_id, m.n) "
         "QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY round((1 - sim) * (1 - sim) + 0.001 * n, 9), n) = 1")]


def doc_vector_steps(p: str = "") -> list:
    return token_steps(p) + [
        (f"{p}dterm", f"SELECT corpus, doc_id, unnest(tokens) AS term FROM {p}toks"),
        (f"{p}dtf", f"SELECT corpus, doc_id, term, count(*) AS tf FROM {p}dterm WHERE term NOT IN {STOP} "
         "AND length(term) > 2 GROUP BY ALL"),
        (f"{p}ddf", f"SELECT corpus, term, count(*) AS df FROM {p}dtf GROUP BY ALL"),
        (f"{p}dn", f"SELECT corpus, count(*) AS n_docs FROM {p}docs GROUP BY corpus"),
        (f"{p}dw", f"SELECT corpus, doc_id, term, tf * (ln((1 + n_docs) / (1 + df)::DOUBLE) + 1) AS w FROM {p}dtf "
         f"JOIN {p}ddf USING (corpus, term) JOIN {p}dn USING (corpus)"),
        (f"{p}dv", f"SELECT corpus, doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY corpus, doc_id)) AS u FROM {p}dw")]


def similar_steps(p: str = "", k: int = 10) -> list:
    return doc_vector_steps(p) + [
        (f"{p}dsim", f"SELECT a.corpus, a.doc_id, b.doc_id AS other, sum(a.u * b.u) AS sim FROM {p}dv a JOIN {p}dv b "
         "ON a.corpus = b.corpus AND a.term = b.term AND a.doc_id <> b.doc_id GROUP BY ALL"),
        (f"{p}low", f"SELECT corpus, doc_id AS other FROM {p}docs QUALIFY row_number() OVER "
         f"(PARTITION BY corpus ORDER BY doc_id) <= {2 * k + 1}"),
        (f"{p}unlike", f"SELECT d.corpus, d.doc_id, l.other, 0.0::DOUBLE AS sim FROM {p}docs d JOIN {p}low l "
         f"ON d.corpus = l.corpus AND d.doc_id <> l.other WHERE NOT EXISTS (SELECT 1 FROM {p}dsim s "
         "WHERE s.corpus = d.corpus AND s.doc_id = d.doc_id AND s.other = l.other)"),
        (f"{p}near", "SELECT corpus, doc_id, other, sim, row_number() OVER (PARTITION BY corpus, doc_id "
         f"ORDER BY round(sim, 9) DESC, other) AS rank FROM (SELECT * FROM {p}dsim UNION ALL SELECT * FROM {p}unlike) "
         f"QUALIFY rank <= {k}")]


# the sharp s has a two-letter capital in Java, as in Python
NAME = "upper(replace(regexp_extract(text, '^([^ .,]+)', 1), 'ß', 'SS'))"
LINES = [("lines", f"SELECT {NAME} AS character_name, text AS line, text AS narration, "
          "'show ' || (conv_id % 3) AS show, 'season ' || (conv_id % 7 + 1) || ' episode ' || conv_id || ' talk ' "
          "|| (conv_id % 10) AS episode, (conv_id % 7 + 1)::INTEGER AS season, 'talk/' || conv_id AS url, "
          "conv_id * 1000 + turn AS line_no FROM conversations")]
ALIASES = [("aliases", "SELECT * FROM (VALUES " + ", ".join(
    f"({q(s)}, {q(c)}, {o}, {q(a) if a is not None else 'NULL'})" for s, c, o, a in ALIAS_ROWS)
    + ") AS t(show, canonical, canon_ord, alias)"),
    ("canon", "SELECT show, canonical, min(canon_ord) AS canon_ord FROM aliases GROUP BY ALL"),
    ("amap", "SELECT show, alias AS character_name, arg_min(canonical, canon_ord) AS canonical FROM aliases "
     "WHERE alias IS NOT NULL GROUP BY ALL"),
    ("aliased", "SELECT coalesce(m.canonical, l.character_name) AS character_name, CASE WHEN m.canonical = '' "
     "THEN '' ELSE line END AS line, CASE WHEN m.canonical = '' THEN line ELSE narration END AS narration, "
     "l.show, episode, season, url, line_no FROM lines l LEFT JOIN amap m USING (show, character_name)"),
    ("open_names", "SELECT DISTINCT show, character_name FROM aliased a WHERE character_name <> '' AND NOT EXISTS "
     "(SELECT 1 FROM canon c WHERE c.show = a.show AND c.canonical = a.character_name)")]


def lcs(a: str, b: str) -> str:
    return (f"list_reduce(list_prepend(list_resize([]::INTEGER[], length({b}) + 1, 0), "
            f"list_transform(string_split({a}, ''), lambda c: [unicode(c)])), lambda row, c: "
            f"list_reduce(list_prepend([0], list_transform(range(1, length({b}) + 1), lambda j: [j::INTEGER])), "
            f"lambda done, j: list_append(done, CASE WHEN unicode(substr({b}, j[1], 1)) = c[1] THEN row[j[1]] + 1 "
            f"ELSE greatest(row[j[1] + 1], done[-1]) END)))[-1]")


def edits(a: str, b: str) -> str:
    """Edit distance in characters, one row of the table per character of a."""
    same = f"CASE WHEN unicode(substr({b}, j[1], 1)) = c[1] THEN 0 ELSE 1 END"
    return (f"list_reduce(list_prepend(range(0, length({b}) + 1)::INTEGER[], "
            f"list_transform(string_split({a}, ''), lambda c: [unicode(c)])), lambda row, c: "
            f"list_reduce(list_prepend([row[1] + 1], list_transform(range(1, length({b}) + 1), lambda j: [j::INTEGER])), "
            f"lambda done, j: list_append(done, least(row[j[1] + 1] + 1, done[-1] + 1, row[j[1]] + {same}))))[-1]")


RATIO = f"round(200.0::DOUBLE * {lcs('canonical', 'character_name')} / (length(canonical) + length(character_name)))::BIGINT"
HELD = ("(contains(character_name, canonical || ' ') OR contains(canonical || ' ', character_name) "
        "OR contains(character_name, ' ' || canonical) OR contains(' ' || canonical, character_name))")
PAIRS = [("pairs", "SELECT o.show, o.character_name, c.canonical, c.canon_ord FROM open_names o JOIN canon c "
          "ON o.show = c.show WHERE c.canonical <> ''"),
         ("fuzzy", f"SELECT *, {RATIO} AS ratio FROM pairs"),
         ("likely", f"SELECT show, character_name, arg_min(canonical, canon_ord) AS canonical FROM fuzzy "
          f"WHERE ratio >= {MIN_RATIO} OR {HELD} GROUP BY ALL"),
         ("resolved", "SELECT coalesce(m.canonical, a.character_name) AS character_name, line, narration, a.show, "
          "episode, season, url, line_no FROM aliased a LEFT JOIN likely m USING (show, character_name)")]
NAMED = LINES + ALIASES + PAIRS
#: The shorter of a name and a canonical name with a space, beside every window as long of the other.
SLIDING = NAMED + [
    ("variants", "SELECT *, canonical || ' ' AS v FROM pairs UNION ALL SELECT *, ' ' || canonical AS v FROM pairs"),
    ("sides", "SELECT show, character_name, canonical, CASE WHEN length(v) <= length(character_name) THEN v ELSE character_name END AS a, "
     "CASE WHEN length(v) <= length(character_name) THEN character_name ELSE v END AS b FROM variants"),
    ("windows", "SELECT show, character_name, canonical, a, substr(b, unnest(range(1, length(b) - length(a) + 2)), length(a)) AS w FROM sides")]


def punct(x: str) -> str:
    return f"CASE WHEN regexp_matches({x}, '[.|?!…]$') THEN {x} ELSE {x} || '.' END"


#: What is said in a season, as one text.
SEASONS = [*LINES, ("g_docs", f"SELECT show AS corpus, season::BIGINT AS doc_id, string_agg({punct('line')}, ' ' ORDER BY line_no) AS text "
                    "FROM lines GROUP BY show, season")]


def doc_steps(lines: str = "lines", settings=()) -> list:
    most = by_show("show", {s[0]: s[1] for s in settings if s[1] is not None}, str(TOP_NAMES))
    removed = by_show("show", {s[0]: f"[{', '.join(map(q, s[2]))}]::VARCHAR[]" for s in settings if s[2] is not None}, "['', 'MAN']")
    return [
        ("ep_docs", f"SELECT show, episode, string_agg({punct('line')}, ' ' ORDER BY line_no) AS text, "
         f"min(line_no) AS first FROM {lines} GROUP BY show, episode"),
        ("speakers", f"SELECT show, character_name, count(*) AS n_lines, min(line_no) AS first_line, row_number() OVER "
         f"(PARTITION BY show ORDER BY count(*) DESC, min(line_no)) AS rank FROM {lines} "
         f"WHERE NOT list_contains({removed}, character_name) GROUP BY show, character_name QUALIFY rank <= {most}"),
        ("char_docs", f"SELECT l.show, l.character_name, string_agg({punct('line')}, ' ' ORDER BY line_no) AS text, "
         f"min(line_no) AS first FROM {lines} l JOIN speakers s USING (show, character_name) GROUP BY ALL"),
        ("seasons", f"SELECT show, season_key, episode, min(line_no) AS first_line FROM (SELECT show, 'All' AS season_key, "
         f"episode, line_no FROM {lines} UNION ALL SELECT show, season::VARCHAR, episode, line_no FROM {lines}) GROUP BY ALL")]


def entries(pairs) -> str:
    return "MAP {" + ", ".join(f"{k}: {v}" for k, v in pairs) + "}"


def references(text: str) -> str:
    """Character references decoded, one row of a list per reference or stretch of text."""
    old = entries((n, q(bytes([n]).decode("cp1252"))) for n in range(128, 160) if n not in (129, 141, 143, 144, 157))
    names = entries([*((q(name), f"chr({point})") for name, point in name2codepoint.items()), (q("apos"), "chr(39)")])

    def of_number(n: str) -> str:
        return (f"coalesce({old}[{n}], CASE WHEN {n} BETWEEN 1 AND 55295 OR {n} BETWEEN 57344 AND 1114111 "
                f"THEN chr({n}::INTEGER) END, chr(65533))")

    decimal = "TRY_CAST(p[3:-2] AS BIGINT)"
    hexadecimal = "TRY_CAST('0x' || p[4:-2] AS BIGINT)"
    return (f"coalesce(list_aggregate(list_transform(regexp_extract_all({text}, '&(?:#[0-9]+|#[xX][0-9A-Fa-f]+|[A-Za-z][A-Za-z0-9]*);|[^&]+|&'), "
            f"lambda p: CASE WHEN NOT (starts_with(p, '&') AND ends_with(p, ';')) THEN p WHEN regexp_matches(p, '^&#[xX]') THEN {of_number(hexadecimal)} "
            f"WHEN starts_with(p, '&#') THEN {of_number(decimal)} ELSE coalesce({names}[p[2:-2]], p) END), 'string_agg', ''), '')")


def label_steps(summary: str, lines: str) -> list:
    """summary (show, episode, pos, sentence)."""
    squeeze = "regexp_replace({}, '[ ]{{2,}}', ' ', 'g')"
    return [
        ("said", f"SELECT s.show, s.episode, s.pos, s.sentence, l.character_name, l.line_no FROM {summary} s JOIN {lines} l "
         f"ON s.show = l.show AND s.episode = l.episode AND contains({squeeze.format('l.narration')}, {squeeze.format('s.sentence')})"),
        ("who", "SELECT show, episode, pos, CASE WHEN count(DISTINCT character_name) > 2 THEN string_agg(character_name, ', ' "
         "ORDER BY line_no) WHEN count(DISTINCT character_name) = 2 THEN string_agg(character_name, ' and ' ORDER BY line_no) "
         "ELSE min(character_name) END AS who FROM said GROUP BY ALL"),
        ("labelled", f"SELECT s.show, s.episode, s.pos, s.sentence, coalesce(who || ': ', '') || s.sentence AS label "
         f"FROM {summary} s LEFT JOIN who USING (show, episode, pos)")]


PARAS = [("bodies", r"SELECT page_id, url, regexp_extract_all(regexp_replace(html, '(<p(?:\s[^>]*)?>)', '</p>\1', 'g') || '</p>', "
          r"'(?s)<p(?:\s[^>]*)?>(.*?)</p>', 1) AS b FROM pages"),
         ("paras", "SELECT page_id, url, list_transform(b[1:greatest(len(b) - 1, 1)], lambda x: "
          + references("regexp_replace(x, '(?s)<[^>]*>', '', 'g')") + ") AS ps FROM bodies"),
         ("ptext", "SELECT page_id, url, array_to_string(ps, ' ') AS text FROM paras"),
         ("plines", "SELECT page_id, unnest(l) AS line, unnest(range(len(l))) AS at FROM (SELECT page_id, "
          "list_filter(string_split(text, chr(10)), lambda x: x <> '') AS l FROM ptext)")]
#: Pages with a paragraph of references before, made of their number and size.
REFERRING = ("SELECT page_id, url, '<p>&#' || (page_id * 7919 % 70000) || ';&#x' || printf('%X', length(html) * 31 % 1200000) || ';&#' || (page_id % 300) "
             "|| ';&eacute;&amp;lt;&nope;&lt&</p>' || html AS html FROM pages")
LINKS = [("tags", r"SELECT page_id, unnest(t) AS tag, unnest(range(len(t))) AS ord FROM (SELECT page_id, "
          r"regexp_extract_all(html, '<a\s[^>]*>') AS t FROM pages)"),
         ("links", "SELECT page_id, ord, regexp_extract(tag, 'href=\"([^\"]*)\"', 1) AS href FROM tags "
          "WHERE contains(tag, 'href=\"')")]


def speaker_sql(x: str) -> tuple[str, str]:
    hit = f"regexp_matches({x}, '(?s)^[A-Z].*: ')"
    name = (f"CASE WHEN {hit} THEN trim(upper(regexp_replace(regexp_extract(replace({x}, 'ß', 'SS'), "
            f"'(?s)^([A-Z].*?)(?::| \\()', 1), '(?s)[ ]*\\(.*\\)', '', 'g'))) ELSE '' END")
    return name, f"regexp_extract({x}, '(?s)^[A-Z].*: (.*)$', 1)"


def quoted_names(text: str) -> str:
    """Quote the column names that DuckDB reserves, outside string literals."""
    parts = re.split("('(?:[^']|'')*')", text)
    return "".join(p if i % 2 else re.sub(r"(?<![\"\w])(show|at|both)(?![\"\w])", r'"\1"', p)
                   for i, p in enumerate(parts))


def sql(steps: list, final: str) -> str:
    seen, parts = set(), []
    for name, body in steps:
        if name not in seen:
            seen.add(name)
            kept = "MATERIALIZED " if "walk" in name or "links" in name or name == "terms" else ""
            parts.append(f"{name} AS {kept}({body})")
    return quoted_names(("WITH " + ",\n".join(parts) + "\n" if parts else "") + final)


def result_steps(settings=()) -> list:
    longest = max([10, *[s[4] for s in settings if s[4]]])
    most = by_show("k.corpus", {s[0]: s[4] for s in settings if s[4] is not None}, "10")
    ep = [("e_docs", "SELECT show AS corpus, first AS doc_id, episode AS title, text FROM ep_docs")]
    ch = [("c_docs", "SELECT show AS corpus, first AS doc_id, character_name AS title, text FROM char_docs")]
    summ = [("e_sum", "SELECT s.corpus AS show, d.title AS episode, s.ord, s.pos, s.sentence, s.score FROM e_summaries s "
             "JOIN e_docs d USING (corpus, doc_id)")]
    rows = ("SELECT {p}.corpus AS show, '{kind}' AS kind, d.title AS entity, {rank}::INTEGER AS rank, {item} AS item, "
            "{score}::DOUBLE AS score FROM {frame} {p} JOIN {docs} d ON {p}.corpus = d.corpus AND {p}.doc_id = d.doc_id")
    arms = ["SELECT show, 'seasons' AS kind, season_key AS entity, NULL::INTEGER AS rank, episode AS item, "
            "first_line::DOUBLE AS score FROM seasons"]
    for p, docs, kind, near in (("e", "e_docs", "episode_keyphrases", "episode_text_similarity"),
                                ("c", "c_docs", "character_keyphrases", "character_dialogue_similarity")):
        arms.append(rows.format(p="k", kind=kind, rank="k.rank", item="k.term", score="k.score",
                                frame=f"{p}_keyphrases", docs=docs))
        arms.append(rows.format(p="k", kind=near, rank="k.rank", item="o.title", score="k.sim",
                                frame=f"{p}b_near", docs=docs)
                    + f" JOIN {docs} o ON k.corpus = o.corpus AND k.other = o.doc_id WHERE k.rank <= {most}")
    arms.append("SELECT s.show, 'episode_text_summarization', s.episode, s.ord::INTEGER, l.label, s.score "
                "FROM e_sum s JOIN labelled l USING (show, episode, pos)")
    return (NAMED + doc_steps("resolved", settings) + ep + ch
            + [("eb_docs", "SELECT * FROM e_docs"), ("cb_docs", "SELECT * FROM c_docs")]
            + keyphrase_steps("e_", True, settings) + keyphrase_steps("c_", settings=settings)
            + similar_steps("eb_", longest) + similar_steps("cb_", longest) + summary_steps("e_") + summ
            + label_steps("e_sum", "resolved") + [("results", " UNION ALL ".join(arms))])


def oracle_sql() -> dict[str, str]:
    tok = DOCS + token_steps()
    occ = tok + gram_steps()
    terms = occ + term_steps()
    top = terms + score_steps()
    edges = top + edge_steps()
    key = DOCS + keyphrase_steps()
    sents = DOCS + sentence_steps()
    vecs = sents + vector_steps()
    summ = DOCS + summary_steps()
    phr = PHRASED + token_steps()
    name, quoted = speaker_sql("line")
    docs = LINES + doc_steps()
    res = result_steps()
    seasons = docs + [("results", "SELECT show, 'seasons' AS kind, season_key AS entity, episode AS item, first_line AS score FROM seasons")]
    out = {
        # sources
        "scan_lines": sql(LINES, "SELECT show, episode, line_no, character_name FROM lines"),
        "scan_season": sql(LINES, "SELECT * FROM lines WHERE season IN (1, 3)"),
        "sink_tsv_roundtrip": sql(LINES, "SELECT * FROM lines"),
        "embedding_cast": "SELECT vec_id, unnest(range(len(embedding))) AS at, round(unnest(embedding)::DOUBLE, 6) AS element FROM embeddings",
        "lines_json": sql(LINES, "SELECT line_no, '{\"character_name\":\"' || character_name || '\",\"season\":' || season || ',\"url\":\"' || url || '\"}' AS json FROM lines"),
        "sink_cleanup": f"SELECT doc_id, translate({q('it’s' + chr(9))} || text, {q('’' + chr(9))}, {q(chr(39) + ' ')}) AS text FROM documents",
        # pages
        "page_links": sql(LINKS, "SELECT page_id, ord, href FROM links"),
        "page_links_excluded": sql(LINKS, f"SELECT page_id, ord, href FROM links WHERE href NOT IN ({', '.join(map(q, LINK_EXCLUDED))})"),
        "page_paragraphs": sql(PARAS, "SELECT page_id, unnest(ps) AS paragraph, unnest(range(len(ps))) AS at FROM paras"),
        "page_text": sql(PARAS, "SELECT page_id, text FROM ptext"),
        "page_references": sql([("pages", REFERRING), *PARAS], "SELECT page_id, text FROM ptext"),
        "script_lines": sql(PARAS, "SELECT page_id, at, line FROM plines"),
        "page_script_lines": sql(PARAS, f"SELECT {speaker_sql('line')[0]} AS character_name, {speaker_sql('line')[1]} AS line, "
                                 r"line AS narration, 'pages' AS show, lower(replace(regexp_extract(url, 'example\.(?:com|net|org)/(.*)', 1), '-', ' ')) AS episode, "
                                 "1::INTEGER AS season, url, page_id * 4294967296 + at AS line_no FROM plines JOIN pages USING (page_id)"),
        "stored_scan": sql(LINES, "SELECT show, episode, season, line_no FROM lines WHERE show = 'show 1' AND season IN (2, 4)"),
        "table_roundtrip": sql(LINES, "SELECT character_name, line, replace(replace(narration, '’', chr(39)), chr(9), ' ') AS narration, "
                               "show, episode, season, url, line_no FROM lines"),
        "results_on_miss": sql(res, "SELECT show, kind, entity, rank::BIGINT AS rank, item, round(score, 6) AS score FROM results "
                               "WHERE kind IN ('seasons', 'episode_text_similarity')"),
        "speaker_parse": sql([("l", "SELECT conv_id, turn, concat(upper(role[1]), role[2:], ' (', turn, '): ', text) AS line FROM conversations")],
                             f"SELECT conv_id, turn, {name} AS character_name, {quoted} AS quote FROM l"),
        "url_slug": r"SELECT page_id, lower(replace(regexp_extract(url, 'example\.(?:com|net|org)/(.*)', 1), '-', ' ')) AS slug FROM pages",
        "lines_union": sql(LINES + PARAS, "SELECT line_no, narration FROM lines UNION ALL SELECT page_id * 4294967296 + at, line FROM plines"),
        "name_slug": "SELECT p_partkey, replace(upper(s[1]) || lower(s[2:]), ' ', '-') AS slug, lower(replace(s, ' ', '_')) AS table_name "
                     "FROM (SELECT p_partkey, p_name AS s FROM part)",
        # names
        "alias_resolve": sql(LINES + ALIASES, "SELECT line_no, character_name FROM aliased"),
        "stage_directions": sql(LINES + ALIASES, "SELECT line_no, character_name, line, narration FROM aliased WHERE character_name = ''"),
        "fuzzy_names": sql(NAMED, f"SELECT show, character_name, canonical, ratio FROM fuzzy WHERE ratio >= {MIN_RATIO}"),
        "levenshtein_names": sql(NAMED, f"SELECT * FROM (SELECT show, character_name, canonical, round(100.0::DOUBLE * (1 - {edits('canonical', 'character_name')} / "
                                 f"greatest(length(canonical), length(character_name))::DOUBLE), 6) AS ratio FROM pairs) WHERE ratio >= {EDIT_RATIO}"),
        "partial_names": sql(NAMED, f"SELECT show, character_name, canonical FROM pairs WHERE {HELD}"),
        "resolve_names": sql(NAMED, "SELECT line_no, character_name, line, narration FROM resolved"),
        # documents
        "punctuate": f"SELECT conv_id, turn, {punct("text || CASE turn % 3 WHEN 0 THEN '' WHEN 1 THEN ' and' ELSE '?' END")} AS line FROM conversations",
        "episode_docs": sql(docs, "SELECT show, episode, text FROM ep_docs"),
        "episode_order": sql(docs, "SELECT show, episode, first AS first_line FROM ep_docs"),
        "season_index": sql(docs, "SELECT show, season_key, episode, first_line FROM seasons"),
        "partial_ratio_names": sql(SLIDING, "SELECT DISTINCT show, character_name, canonical FROM windows "
                                   f"WHERE round(100.0::DOUBLE * {lcs('a', 'w')} / length(a)) >= {PARTIAL_RATIO}"),
        "top_speakers": sql(docs, "SELECT show, character_name, n_lines, first_line, rank FROM speakers"),
        "character_docs": sql(docs, "SELECT show, character_name, text FROM char_docs"),
        # text
        "expand_contractions": sql(PHRASED, f"SELECT doc_id, {expand('lower(text)')} AS text FROM docs"),
        "normalize_text": sql(phr, "SELECT doc_id, text FROM normed"),
        "title_prefix": sql(TITLED, f"SELECT doc_id, regexp_replace({punct('lower(title)')}, '^season [^ ]* episode [^ ]* ', '') || ' ' || text AS text FROM docs"),
        "tokenize": sql(PHRASED + token_steps(), f"SELECT doc_id, array_to_string(list_filter({raw_words('text')}, lambda w: w <> ''), '|') AS words FROM normed"),
        "clean_tokens": sql(phr, f"SELECT doc_id, array_to_string({clean(raw_words('text'))}, '|') AS words FROM normed"),
        "number_words": sql([("w", "SELECT l_orderkey AS k, l_linenumber AS i, (l_orderkey * l_orderkey * 1000003 % 1000000007 * l_partkey)::VARCHAR AS token FROM lineitem")],
                            f"SELECT k, i::BIGINT AS i, {number('token')} AS words FROM w"),
        "stopword_filter": sql(occ, "SELECT corpus, doc_id, size, pos, term FROM occ"),
        "short_filter": sql(occ, "SELECT corpus, doc_id, pos, term FROM occ WHERE size = 1"),
        "ngrams": sql(tok + gram_steps(), "SELECT corpus, doc_id, pos, w1 || '_' || w2 AS term FROM placed WHERE w2 IS NOT NULL"),
        "possessive_fold": sql(PHRASED + token_steps() + gram_steps(), f"SELECT corpus, doc_id, pos, {folded('''w1 || '_' || w2 || '_' || w3''')} AS term FROM placed WHERE w3 IS NOT NULL"),
        "map_sorted": sql(occ, "SELECT doc_id, term, count(*) AS tf, row_number() OVER (PARTITION BY doc_id ORDER BY count(*) DESC, term) AS rank FROM occ WHERE size = 1 GROUP BY doc_id, term"),
        # phrases
        "term_frequency": sql(occ, "SELECT corpus, doc_id, size, term, count(*) AS tf FROM occ GROUP BY ALL"),
        "term_union": sql(PHRASED + token_steps() + gram_steps() + term_steps(), "SELECT corpus, doc_id, term, n, size, tf, first_pos FROM terms"),
        "idf": sql(top, "SELECT corpus, term, round(idf, 6) AS idf FROM idf"),
        "tfidf": sql(top, "SELECT corpus, doc_id, term, round(tfidf, 6) AS tfidf FROM scored"),
        "subsumption": sql(terms + [("held", "SELECT corpus, doc_id, unnest(string_split(term, '_')) AS term, tf FROM terms WHERE n >= 2"),
                                    ("held2", "SELECT corpus, doc_id, term, sum(tf) AS held FROM held GROUP BY ALL")],
                           "SELECT corpus, doc_id, t.term, CASE WHEN n = 1 THEN (tf - coalesce(held, 0))::BIGINT ELSE tf END AS tf FROM terms t LEFT JOIN held2 USING (corpus, doc_id, term)"),
        "first_position": sql(terms, "SELECT corpus, doc_id, term, first_pos, round(ln(500 + 5000.0::DOUBLE / first_pos), 6) AS factor FROM terms"),
        "term_length": sql(terms, "SELECT DISTINCT corpus, term, n, round(ln(n + 1.0::DOUBLE), 6) AS decayed, n::DOUBLE AS plain FROM terms"),
        "title_boost": sql(TITLED + token_steps(title=True) + gram_steps() + term_steps() + score_steps(title=True),
                           "SELECT corpus, doc_id, rank, term, round(score, 6) AS score FROM top"),
        "stat_score": sql(top, "SELECT corpus, doc_id, term, round(score, 6) AS score FROM scored"),
        "keyphrase_topk": sql(top, "SELECT corpus, doc_id, rank, term, round(score, 6) AS score FROM top"),
        "phrase_positions": sql(edges, "SELECT corpus, doc_id, rank, term, s AS start, e AS \"end\" FROM pos"),
        "phrase_positions_contains": sql(top + [
            ("words", "SELECT corpus, doc_id, rank, term, string_split(term, '_') AS ws FROM top"),
            ("w1", "SELECT corpus, doc_id, rank, term, len(ws) AS length, unnest(ws) AS word, unnest(range(len(ws))) AS at FROM words"),
            ("seen", "SELECT DISTINCT p.corpus, p.doc_id, p.w1 AS token, w.word FROM (SELECT DISTINCT corpus, doc_id, w1 FROM placed) p JOIN (SELECT DISTINCT corpus, doc_id, word FROM w1) w ON p.corpus = w.corpus AND p.doc_id = w.doc_id AND contains(p.w1, w.word)"),
            ("hit", "SELECT p.corpus, p.doc_id, w.rank, w.term, w.length, p.pos - w.at AS start, count(DISTINCT w.at) AS m FROM placed p JOIN seen s ON p.corpus = s.corpus AND p.doc_id = s.doc_id AND p.w1 = s.token JOIN w1 w ON w.corpus = s.corpus AND w.doc_id = s.doc_id AND w.word = s.word GROUP BY ALL")],
            "SELECT corpus, doc_id, rank, term, start, start + length - 1 AS \"end\" FROM hit WHERE m = length"),
        "interval_gap": sql(edges + [("spot", "SELECT corpus, doc_id, rank, s, e, lead(s) OVER w AS s2, lead(e) OVER w AS e2 FROM pos WINDOW w AS (PARTITION BY corpus, doc_id ORDER BY s, rank)")],
                            "SELECT corpus, doc_id, rank, s AS start, greatest(s2 - e, s - e2, 0) AS gap FROM spot WHERE s2 IS NOT NULL"),
        "cooccurrence_edges": sql(edges, "SELECT corpus, doc_id, src, dst, round(w, 6) AS w FROM edges"),
        "keyphrase_graph": sql(edges, "SELECT corpus, doc_id, src_term, dst_term, round(w, 4) AS w FROM graph"),
        "pagerank": sql(key, "SELECT corpus, doc_id, node, round(rank, 6) AS rank FROM k_ranks"),
        "keyphrases": sql(key, "SELECT corpus, doc_id, rank, term, round(score, 6) AS score FROM keyphrases"),
        # sentences
        "sentences": sql(sents, "SELECT corpus, doc_id, at, sentence FROM all_sents"),
        "sentence_distinct": sql(sents, "SELECT corpus, doc_id, pos, sentence FROM sents"),
        "sentence_vectors": sql(vecs, "SELECT corpus, doc_id, pos, term, round(u, 6) AS u FROM sv"),
        "sentence_graph": sql(vecs, "SELECT corpus, doc_id, src, dst, round(w, 6) AS w FROM sg"),
        "sentence_length_weight": sql(sents, f"SELECT corpus, doc_id, pos, round({length_weight('sentence')}, 6) AS weight FROM sents"),
        "sentence_rank": sql(summ, "SELECT corpus, doc_id, pos, place AS rank, round(score, 6) AS score FROM ordered"),
        "summary_candidates": sql(summ, "SELECT corpus, doc_id, n, round(sim, 6) AS similarity FROM cand"),
        "summary_length": sql(summ, "SELECT corpus, doc_id, n, round(loss, 6) AS loss FROM best"),
        "summaries": sql(summ, "SELECT corpus, doc_id, ord, pos, sentence, round(score, 6) AS score FROM summaries"),
        "segment_topk": sql(SEASONS + token_steps("g_") + gram_steps("g_") + term_steps("g_") + score_steps("g_"),
                            "SELECT corpus, doc_id, rank, term, round(score, 6) AS score FROM g_top"),
        "segment_keyphrases": sql(SEASONS + keyphrase_steps("g_"),
                                  "SELECT corpus, doc_id, rank, term, round(score, 6) AS score FROM g_keyphrases"),
        "summaries_dense": sql(dense_steps(), "SELECT o.doc_id, row_number() OVER (PARTITION BY o.doc_id ORDER BY o.pos) AS ord, o.pos, "
                               "round(o.score, 6) AS score FROM dordered o JOIN dbest b ON b.doc_id = o.doc_id AND o.place <= b.n"),
        # similarity
        "doc_vectors": sql(DOCS + doc_vector_steps(), "SELECT corpus, doc_id, term, round(u, 6) AS u FROM dv"),
        "pairwise_cosine": sql(vecs, "SELECT corpus, doc_id, src, dst, round(w, 6) AS w FROM sg WHERE round(w, 9) >= 0.6"),
        "similar_docs": sql(DOCS + similar_steps(), "SELECT corpus, doc_id, other, rank, round(sim, 6) AS sim FROM near"),
        "similar_embeddings": sql([("v", "SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings"),
                                   ("s", "SELECT a.id, b.id AS other, list_cosine_similarity(a.v, b.v) AS sim FROM v a JOIN v b ON a.id <> b.id")],
                                  "SELECT id, other, round(sim, 6) AS sim, row_number() OVER (PARTITION BY id ORDER BY round(sim, 9) DESC, other) AS rank FROM s QUALIFY rank <= 10"),
        # speakers
        "speaker_join": sql(NAMED + [("turn_sents", "SELECT show AS corpus, episode AS doc_id, line AS text FROM resolved")] + _turn_summary()
                            + label_steps("ts", "resolved"), "SELECT show, episode, pos, line_no, character_name FROM said"),
        "speaker_labels": sql(NAMED + _turn_summary() + label_steps("ts", "resolved"), "SELECT show, episode, pos, label FROM labelled"),
        # results
        "all_results": sql(res, "SELECT show, kind, entity, rank::BIGINT AS rank, item, round(score, 6) AS score FROM results"),
        "all_results_by_show": sql(result_steps(SETTINGS), "SELECT show, kind, entity, rank::BIGINT AS rank, item, round(score, 6) AS score FROM results"),
        "result_lookup": sql(res, "SELECT show, entity, rank::BIGINT AS rank, item, round(score, 6) AS score FROM results WHERE kind = 'episode_text_similarity'"),
        "result_shows": sql(seasons, "SELECT DISTINCT show FROM results"),
        "result_entities": sql(seasons, "SELECT DISTINCT entity FROM results WHERE show = 'show 1' AND kind = 'seasons'"),
        "result_episodes": sql(seasons, "SELECT item AS episode, score::DOUBLE AS score FROM results WHERE show = 'show 1' AND entity = '2'"),
        "result_episode": sql(res, "SELECT kind, rank::BIGINT AS rank, item, round(score, 6) AS score FROM results WHERE show = 'show 1' AND entity = 'season 2 episode 1 talk 1' "
                              "AND kind IN ('episode_keyphrases', 'episode_text_similarity', 'episode_text_summarization')"),
        "result_character": sql(res, "SELECT kind, rank::BIGINT AS rank, item, round(score, 6) AS score FROM results WHERE show = 'show 1' AND entity = 'THE' "
                                "AND kind IN ('character_keyphrases', 'character_dialogue_similarity')"),
    }
    return out


def _turn_summary() -> list:
    """Every sentence of a line stands for a summary sentence of its episode."""
    return [("tl", f"SELECT show, episode, line_no, {sentence_list('line')} AS ss FROM resolved"),
            ("ts", "SELECT show, episode, line_no * 1000 + at AS pos, sentence FROM (SELECT show, episode, line_no, "
             "unnest(ss) AS sentence, unnest(range(len(ss))) AS at FROM tl)")]
