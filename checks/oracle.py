"""The same results in SQL over the given tables, written apart from the Spark code."""

from __future__ import annotations

from checks.adapters import LEXICON, OPENINGS

WORD = r"'[\p{L}\p{N}]+'"
SLOTS = ("topic", "appearance", "type", "visual", "context", "text", "source")
SIGNALS = ("text", "semantic", "visual", "metadata", "clue")


def toks(col: str) -> str:
    return f"regexp_extract_all(lower({col}), {WORD})"


def _values(rows) -> str:
    def lit(v):
        return f"'{v}'" if isinstance(v, str) else str(v)

    return ", ".join("(" + ", ".join(lit(v) for v in r) + ")" for r in rows)


_opening = f"CASE (turn + conv_id % 3 * 4) % {len(OPENINGS)} " + " ".join(f"WHEN {i} THEN '{o}'" for i, o in enumerate(OPENINGS)) + " END"

# Named parts of the statements: name -> (parts it needs, SQL).
PARTS: dict[str, tuple[tuple[str, ...], str]] = {
    "items": ((), """SELECT coalesce(d.doc_id, e.vec_id) AS image_id, d.source, d.lang, d.text, e.embedding
        FROM documents d FULL JOIN embeddings e ON d.doc_id = e.vec_id"""),
    "tok": ((), f"SELECT doc_id AS image_id, unnest({toks('text')}) AS term FROM documents"),
    "post": (("tok",), "SELECT image_id, term, count(*) AS tf FROM tok GROUP BY ALL"),
    "docs": (("post",), "SELECT image_id, sum(tf) AS dl, count(*) AS n_terms FROM post GROUP BY 1"),
    "corpus": (("docs",), "SELECT count(*) AS n_docs, sum(dl) AS n_tokens, avg(dl) AS avg_dl FROM docs"),
    "terms": (("post", "corpus"), """SELECT term, count(*) AS df,
            ln(1 + (any_value(n_docs) - count(*) + 0.5) / (count(*) + 0.5)) AS bm_idf,
            ln((1.0 + any_value(n_docs)) / (1.0 + count(*))) + 1 AS idf
        FROM post, corpus GROUP BY term"""),
    "norms": (("post", "terms"), """SELECT image_id, sqrt(sum(pow((1 + ln(tf)) * idf, 2))) AS norm
        FROM post JOIN terms USING (term) GROUP BY 1"""),
    "weights": (("post", "terms", "norms"), """SELECT image_id, term, (1 + ln(tf)) * idf / norm AS w
        FROM post JOIN terms USING (term) JOIN norms USING (image_id)"""),
    "bm": (("post", "docs", "corpus"), """SELECT image_id, term,
            tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avg_dl)) AS bm
        FROM post JOIN docs USING (image_id), corpus"""),
    "unit": (("items",), """SELECT image_id, embedding::DOUBLE[] AS v FROM items WHERE len(embedding) = 64"""),
    "asked": ((), "SELECT conv_id * 1000 + turn AS query_id, conv_id, text FROM conversations WHERE role = 'user'"),
    "qterm": (("asked",), f"""SELECT query_id, term, count(*) AS tf
        FROM (SELECT query_id, unnest({toks('text')}) AS term FROM asked) GROUP BY ALL"""),
    "qterm2": (("asked",), f"""SELECT query_id, term, count(*) AS tf
        FROM (SELECT a.query_id, unnest({toks('b.text')}) AS term
              FROM asked a JOIN asked b USING (conv_id)) GROUP BY ALL"""),
    "qvec": (("asked",), """SELECT query_id, embedding::DOUBLE[] AS v
        FROM asked JOIN embeddings ON vec_id = conv_id"""),
    "qfilter": (("asked",), """SELECT query_id, 'lang' AS field, lang AS value FROM asked JOIN documents ON doc_id = conv_id
        UNION ALL SELECT query_id, 'source', source FROM asked JOIN documents ON doc_id = conv_id"""),
    "lexicon": ((), f"SELECT * FROM (VALUES {_values(LEXICON)}) AS t(phrase, slot, value)"),
    "first_norm": (("asked",), f"""SELECT query_id, ' ' || array_to_string({toks('text')}, ' ') || ' ' AS t
        FROM asked"""),
    "qclue": (("first_norm", "lexicon"), """SELECT query_id, slot, value FROM (
            SELECT query_id, slot, value, row_number() OVER (PARTITION BY query_id, slot
                ORDER BY length(phrase) DESC, phrase, value) AS n
            FROM first_norm JOIN lexicon ON contains(t, ' ' || phrase || ' ')) WHERE n = 1"""),
    "doc_norm": ((), f"""SELECT doc_id AS image_id, source, lang,
        ' ' || array_to_string({toks('text')}, ' ') || ' ' AS t FROM documents"""),
    "clue_value": (("qclue",), f"SELECT value, {toks('value')} AS words FROM (SELECT DISTINCT value FROM qclue)"),
    "clue_hit": (("clue_value", "tok", "items"), """SELECT value, image_id FROM
            (SELECT value, image_id, count(DISTINCT term) AS n, any_value(len(list_distinct(words))) AS need
             FROM clue_value JOIN tok ON list_contains(words, term) GROUP BY ALL) WHERE n = need
        UNION SELECT value, image_id FROM clue_value JOIN items
            ON lower(value) = lower(source) OR lower(value) = lower(lang)"""),
    "turns": ((), f"""SELECT conv_id, turn, role,
            CASE WHEN role = 'user' THEN ({_opening}) || text ELSE text END AS text FROM conversations"""),
    "said": (("turns",), r"""SELECT * EXCLUDE (low), low AS l, list_filter([
            CASE WHEN regexp_matches(low, '(^\W*|[.!?;,]\s*|\b(and|then|now|please|also|you)\s+)(summari[sz]e\b|(give|write|make|create)\b[^.!?]*\bsummary\b)') THEN 'summarize' END,
            CASE WHEN regexp_matches(low, '(^\W*|[.!?;,]\s*|\b(and|then|now|please|also|you)\s+)(remind\b|(set|create|add|make)\b[^.!?]*\breminder\b)') THEN 'reminder' END,
            CASE WHEN regexp_matches(low, '(^\W*|[.!?;,]\s*|\b(and|then|now|please|also|you)\s+)(schedule\b|(add|put)\b[^.!?]*\bcalendar\b)') THEN 'schedule' END,
            CASE WHEN regexp_matches(low, '(^\W*|[.!?;,]\s*|\b(and|then|now|please|also|you)\s+)(plan\b|(create|make|build|write|prepare|draw up|give)\b[^.!?]*\b(road ?map|plan)\b)') THEN 'roadmap' END
            ], lambda x: x IS NOT NULL) AS actions, low IS DISTINCT FROM lower(text) AS greeted
            FROM (SELECT *, regexp_replace(lower(text), '^\W*((hello|hi|hey|thanks|thank you|thx|ok|okay|sorry|great|cool|well|so|please)\b\W*)+', '') AS low FROM turns)"""),
    "labelled0": (("said",), r"""SELECT *, CASE WHEN role = 'user' THEN list_distinct([intent] || actions) END AS intents FROM (
            SELECT *, CASE WHEN role <> 'user' THEN NULL
            WHEN regexp_matches(l, '^\W*(why|explain why)\b') THEN 'why'
            WHEN regexp_matches(l, '^\W*(yes|confirm|go ahead)\b') THEN 'confirm'
            WHEN regexp_matches(l, '^\W*((can|could|would|will) you |please )*(find|show|search|look for|where (is|are))\b') THEN 'search'
            WHEN regexp_matches(l, '^\W*(no|the one|i (also )?remember|(it|they|there) (was|were|also|had))\b') THEN 'refine'
            WHEN len(actions) > 0 THEN actions[1]
            WHEN text IS NULL OR regexp_full_match(l, '\W*((what|who|whose|when|where|how|which|is|are|was|were|do|does|did|has|have|had|it|its|that|this|these|those|they|them|there|you|i|we|he|she|me|my|your|the|a|an|of|to|for|in|on|so|not|no|about|else|more|much|many|s)\b\W*)*') THEN 'out of scope'
            WHEN regexp_matches(l, '^\W*(what|who|whose|when|where|how|which|is|are|was|were|do|does|did|has|have|had)\b') THEN CASE
                WHEN regexp_full_match(l, '\W*(what(''s| is| was) (the |your |today''s )?(weather|time|date|day|name)( (like|today|now|tomorrow|here))*|what (can|do|are|did) you( do| mean| say| think| doing)*( for me)?|who (are|made|built) you|how (are|old are|do|does|did) (you|this|that|it)( do| doing| work| go| going| today)*|how(''s| is) it going|(are|is|do|did|does|was|were) (you|that|this|it|we)( (there|sure|ok|okay|right|all|a bot|human|real|done|it|help|work|understand|know|know that))+)\W*') THEN 'out of scope'
                ELSE 'search' END
            WHEN greeted THEN 'out of scope'
            ELSE 'search' END AS intent FROM said)"""),
    "labelled": (("labelled0",), """SELECT *, sum((intent IS NOT DISTINCT FROM 'search')::INT)
            OVER (PARTITION BY conv_id ORDER BY turn) AS segment FROM labelled0"""),
    "retrieving": (("labelled",), "SELECT * FROM labelled WHERE intent IN ('search', 'refine')"),
    "turn_norm": (("retrieving",), f"""SELECT conv_id, turn, segment,
            ' ' || array_to_string({toks('text')}, ' ') || ' ' AS t FROM retrieving"""),
    "clues": (("turn_norm", "lexicon"), """SELECT conv_id, turn, segment, slot, value FROM (
            SELECT *, row_number() OVER (PARTITION BY conv_id, turn, slot
                ORDER BY length(phrase) DESC, phrase, value) AS n
            FROM turn_norm JOIN lexicon ON contains(t, ' ' || phrase || ' ')) WHERE n = 1"""),
    "context": (("retrieving",), f"""SELECT DISTINCT t.conv_id, t.turn, s.term FROM retrieving t
            JOIN (SELECT conv_id, segment, turn, unnest({toks('text')}) AS term FROM retrieving) s
            ON s.conv_id = t.conv_id AND s.segment = t.segment AND s.turn <= t.turn"""),
    "user_state": (("labelled", "clues"), """SELECT t.conv_id, t.turn, c.slot, arg_max(c.value, c.turn) AS value
        FROM labelled t JOIN clues c ON c.conv_id = t.conv_id AND c.segment = t.segment AND c.turn <= t.turn
        WHERE t.role = 'user' GROUP BY ALL"""),
    "state": (("retrieving", "clues"), """SELECT t.conv_id, t.turn, c.slot, arg_max(c.value, c.turn) AS value
        FROM retrieving t JOIN clues c ON c.conv_id = t.conv_id AND c.segment = t.segment AND c.turn <= t.turn
        GROUP BY ALL"""),
    "turn_terms": (("context",), """SELECT conv_id::VARCHAR || ':' || turn::VARCHAR AS query_id, term, 1 AS tf
        FROM context"""),
    "status": ((), """SELECT user_id AS image_id, 'archive' AS source, event_type AS stage,
            CASE WHEN value > 10 THEN 'done' ELSE 'waiting' END AS state, ts AS seen_at, event_id FROM events"""),
    "last_status": (("status",), """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY image_id, stage
            ORDER BY seen_at DESC) AS n FROM status) WHERE n = 1"""),
}


def _weigh(name: str, source: str) -> None:
    """Query side of a text search, and its sums over the postings."""
    PARTS[f"{name}_raw"] = ((source, "terms", "corpus"), f"""SELECT query_id, term, df, bm_idf, coalesce(idf, ln(1.0 + n_docs) + 1) AS idf,
            (1 + ln(tf)) * coalesce(idf, ln(1.0 + n_docs) + 1) AS r
        FROM {source} LEFT JOIN terms USING (term), corpus""")
    PARTS[f"{name}_q"] = ((f"{name}_raw",), f"""SELECT query_id, term, bm_idf,
            r / sqrt(sum(r * r) OVER (PARTITION BY query_id)) AS wq, df FROM {name}_raw""")
    PARTS[f"{name}_sum"] = ((f"{name}_q", "bm", "weights"), f"""SELECT query_id, image_id,
            sum(bm * bm_idf) AS text, sum(w * wq) AS semantic
        FROM {name}_q JOIN bm USING (term) JOIN weights USING (image_id, term) GROUP BY ALL""")


def _top(source: str, score: str, k: int, by: str = "query_id") -> str:
    return f"""SELECT {by}, image_id, score, rank FROM (
        SELECT {by}, image_id, score, row_number() OVER (PARTITION BY {by} ORDER BY score DESC, image_id) AS rank
        FROM (SELECT {by}, image_id, round({score}, 6) AS score FROM {source})) WHERE rank <= {k}"""


PARTS["cosine"] = (("qvec", "unit"), """SELECT query_id, image_id, list_cosine_similarity(qvec.v, unit.v) AS score
    FROM qvec, unit""")
PARTS["meta_all"] = (("qfilter", "items"), """SELECT query_id, image_id, sum(hit) / count(hit) AS score FROM (
        SELECT query_id, image_id, CASE field WHEN 'lang' THEN lang = value ELSE source = value END::DOUBLE AS hit
        FROM qfilter, items) GROUP BY ALL""")
PARTS["clue_all"] = (("qclue", "clue_hit"), """SELECT query_id, image_id,
        count(*) / any_value(n) AS score
    FROM (SELECT *, count(*) OVER (PARTITION BY query_id) AS n FROM qclue) JOIN clue_hit USING (value)
    GROUP BY query_id, image_id""")


def _hybrid(name: str, terms: str, pairs: str | None = None) -> None:
    """Candidates and signals; with ``pairs`` those are the candidates."""
    _weigh(name, terms)
    if pairs is None:
        need = (f"{name}_sum", "cosine", "meta_all", "clue_all")
        body = " UNION ".join(
            f"SELECT query_id, image_id FROM {src} WHERE round({col}, 6) > 0"
            for src, col in ((f"{name}_sum", "text"), (f"{name}_sum", "semantic"), ("cosine", "score"),
                             ("meta_all", "score"), ("clue_all", "score"))
        )
        PARTS[f"{name}_pairs"] = (need, body)
    else:
        PARTS[f"{name}_pairs"] = ((pairs,), f"SELECT query_id, image_id FROM {pairs}")
    PARTS[f"{name}_scored0"] = (
        (f"{name}_pairs", f"{name}_sum", "docs", "cosine", "meta_all", "clue_all", "qclue"),
        f"""SELECT p.query_id, p.image_id,
            CASE WHEN d.image_id IS NOT NULL THEN coalesce(s.text, 0) END AS text,
            CASE WHEN d.image_id IS NOT NULL THEN coalesce(s.semantic, 0) END AS semantic,
            c.score AS visual, m.score AS metadata,
            CASE WHEN p.query_id IN (SELECT query_id FROM qclue) THEN coalesce(k.score, 0) END AS clue
        FROM {name}_pairs p LEFT JOIN {name}_sum s USING (query_id, image_id)
        LEFT JOIN docs d ON d.image_id = p.image_id
        LEFT JOIN cosine c ON c.query_id = p.query_id AND c.image_id = p.image_id
        LEFT JOIN meta_all m ON m.query_id = p.query_id AND m.image_id = p.image_id
        LEFT JOIN clue_all k ON k.query_id = p.query_id AND k.image_id = p.image_id""")
    PARTS[f"{name}_scored"] = ((f"{name}_scored0",), f"""SELECT query_id, image_id,
            round(text / max(text) OVER (PARTITION BY query_id), 6) AS text,
            round(CASE WHEN semantic IS NOT NULL THEN least(greatest(semantic, 0), 1) END, 6) AS semantic,
            round(CASE WHEN visual IS NOT NULL THEN least(greatest(visual, 0), 1) END, 6) AS visual,
            round(metadata, 6) AS metadata, round(clue, 6) AS clue FROM {name}_scored0""")
    total = " + ".join(f"coalesce({s}, 0)" for s in SIGNALS)
    PARTS[f"{name}_ranked"] = ((f"{name}_scored",), f"""SELECT * FROM (SELECT *, row_number() OVER (
            PARTITION BY query_id ORDER BY final DESC, image_id) AS rank
        FROM (SELECT *, round({total}, 6) AS final FROM {name}_scored)) WHERE rank <= 10""")


_hybrid("x", "qterm")
_hybrid("u", "qterm2")
_hybrid("r", "qterm2", "x_ranked")
PARTS["text_top"] = (("x_sum",), _top("x_sum", "text", 10))
_weigh("t", "turn_terms")
PARTS["turn_top"] = (("t_sum",), f"""SELECT split_part(query_id, ':', 1)::BIGINT AS conv_id,
        split_part(query_id, ':', 2)::BIGINT AS turn, image_id, rank FROM ({_top('t_sum', 'text', 10)})""")
PARTS["heavy"] = (("weights",), """SELECT image_id AS query_id, term, 1 AS tf FROM (
        SELECT *, row_number() OVER (PARTITION BY image_id ORDER BY round(w, 6) DESC, term) AS n FROM weights)
    WHERE n <= 5""")
_weigh("e", "heavy")
PARTS["explained"] = (("x_ranked",), " UNION ALL ".join(
    f"""SELECT query_id, image_id, rank, '{s}' AS signal, {s} AS score, 1.0::DOUBLE AS weight,
        round(CASE WHEN final > 0 THEN {s} / final END, 4) AS share FROM x_ranked WHERE {s} IS NOT NULL"""
    for s in SIGNALS))
PARTS["matched"] = (("x_ranked", "x_q", "bm"), """SELECT query_id, image_id, term, part, row_number() OVER (
        PARTITION BY query_id, image_id ORDER BY part DESC, term) AS place
    FROM (SELECT r.query_id, r.image_id, term, round(bm * bm_idf, 6) AS part
          FROM x_ranked r JOIN bm ON bm.image_id = r.image_id JOIN x_q USING (query_id, term))""")
PARTS["sentences"] = ((), """SELECT image_id, sentence, row_number() OVER (PARTITION BY image_id ORDER BY o) AS sno FROM (
        SELECT doc_id AS image_id, unnest(p) AS sentence, generate_subscripts(p, 1) AS o FROM (
            SELECT doc_id, list_filter(list_transform(regexp_split_to_array(text, '[.!?\\n]+'), lambda s: trim(s)),
                lambda s: s <> '') AS p FROM documents))""".replace("\\\\n", "\\n"))
PARTS["sentence_weight"] = (("sentences", "weights", "x_ranked"), f"""SELECT image_id, sno, round(avg(w), 6) AS weight
    FROM (SELECT image_id, sno, unnest({toks('sentence')}) AS term FROM sentences
          WHERE image_id IN (SELECT image_id FROM x_ranked))
    JOIN weights USING (image_id, term) GROUP BY ALL""")
PARTS["plan"] = (("x_ranked", "weights"), """SELECT query_id, step, topic, weight FROM (
        SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY weight DESC, topic) AS step FROM (
            SELECT query_id, term AS topic, round(sum(w), 6) AS weight
            FROM x_ranked JOIN weights USING (image_id) GROUP BY ALL)) WHERE step <= 5""")
PARTS["days"] = (("plan",), """SELECT query_id, step, topic,
        (DATE '2025-01-06' + (ntile(3) OVER (PARTITION BY query_id ORDER BY step) - 1)::INT)::DATE AS day FROM plan""")
PARTS["deadlines"] = ((), """SELECT o_orderkey AS image_id, o_orderdate::DATE AS day,
        strftime(o_orderdate, '%Y-%m-%d') AS found, 'Please pay by ' || strftime(o_orderdate, '%Y-%m-%d') AS context
    FROM orders
    UNION ALL SELECT o_orderkey, o_orderdate::DATE, strftime(o_orderdate, '%-d %B %Y'), 'Delivered ' || strftime(o_orderdate, '%-d %B %Y')
    FROM orders
    UNION ALL SELECT o_orderkey, o_orderdate::DATE, strftime(o_orderdate, '%d/%m/%Y'), 'Due ' || strftime(o_orderdate, '%d/%m/%Y')
    FROM orders WHERE day(o_orderdate) > 12 OR day(o_orderdate) = month(o_orderdate)""")
PARTS["proposals"] = (("deadlines", "days"), """SELECT
        sha256(kind || chr(31) || strftime(day, '%Y-%m-%d') || chr(31) || title || chr(31) || evidence) AS proposal_id,
        kind, day, title, evidence FROM (
        SELECT 'reminder' AS kind, day, context AS title, 'item ' || image_id || ': ' || found AS evidence FROM deadlines
        UNION SELECT 'event', day, topic, 'plan ' || query_id || ', step ' || step FROM days)""")



def tuned(grid) -> str:
    """Reciprocal rank of item conv_id for query conv_id under every weighting."""
    rows = [(i, *[float(g.get(s, 0.0)) for s in SIGNALS]) for i, g in enumerate(grid)]
    total = " + ".join(f"w_{s} * coalesce({s}, 0)" for s in SIGNALS)
    names = ", ".join(f"w_{s}" for s in SIGNALS)
    outs = ", ".join(f"any_value(w_{s}::DOUBLE) AS {s}" for s in SIGNALS)
    return f"""SELECT setting::BIGINT AS setting, {outs}, (SELECT count(*) FROM asked)::BIGINT AS queries,
            round(coalesce(sum(CASE WHEN image_id = query_id // 1000 THEN 1.0 / place END), 0) / (SELECT count(*) FROM asked), 6) AS mrr
        FROM (SELECT *, row_number() OVER (PARTITION BY setting, query_id ORDER BY final DESC, image_id) AS place
              FROM (SELECT *, round({total}, 6) AS final
                    FROM x_scored, (VALUES {_values(rows)}) AS g(setting, {names})))
        GROUP BY setting"""


# Parts that several others read: worked out once.
LARGE = ("tok", "post", "terms", "norms")


def sql(body: str, *needs: str) -> str:
    """``body`` with the parts it needs, in order."""
    order: list[str] = []

    def visit(name: str) -> None:
        if name not in order:
            for n in PARTS[name][0]:
                visit(n)
            order.append(name)

    for n in needs:
        visit(n)
    if not order:
        return body
    return "WITH " + ",\n".join(f"{n} AS {'MATERIALIZED ' if n in LARGE else ''}({PARTS[n][1]})" for n in order) + "\n" + body


COMMON = "image_id, source, uri, NULL::VARCHAR AS file_name, lang, NULL::VARCHAR AS day, n_chars::BIGINT AS n_chars, dims::BIGINT AS dims"
HIT = "query_id, image_id, score, rank::BIGINT AS rank"
SCORED = "query_id, image_id, text, semantic, visual, metadata, clue, final, rank::BIGINT AS rank"


def _fold(col: str) -> str:
    """Letters beyond ASCII mapped one to one to capitals, which lower-cased terms lack."""
    return f"translate({col}, 'áàâäãçéèêëíìîïñóòôöõúùûüß', 'ABCDEFGHIJKLMNOPQRSTUVWXY')"


def statements(grid) -> dict[str, str]:
    out: dict[str, str] = {}
    out["in1_scan_archive"] = """SELECT doc_id AS image_id, source, lang, n_chars, length(text)::BIGINT AS read_chars
        FROM documents"""
    out["in2_normalize"] = f"""SELECT {COMMON} FROM (
        SELECT doc_id AS image_id, source, NULL::VARCHAR AS uri, lang, length(text) AS n_chars, NULL AS dims FROM documents
        UNION ALL SELECT page_id + 1000000000, NULL, url, NULL, length(html), NULL FROM pages
        UNION ALL SELECT vec_id + 2000000000, NULL, NULL, NULL, NULL, len(embedding) FROM embeddings)"""
    out["in3_validate"] = """SELECT doc_id AS image_id, 'accepted' AS verdict, 1::BIGINT AS copies FROM documents
        UNION ALL SELECT doc_id, 'repeated id', 2 FROM documents WHERE source = 'src1'
        UNION ALL SELECT vec_id + 2000000000, CASE WHEN label = 3 THEN 'vector of wrong length' ELSE 'accepted' END, 1 FROM embeddings
        UNION ALL SELECT NULL, 'null id', count(*) FROM benchmark GROUP BY text
        UNION ALL SELECT doc_id + 3000000000, 'no text and no vector', 1 FROM labels"""
    out["in4_provenance_audit"] = """WITH n AS (SELECT (SELECT count(*) FROM documents) AS d, (SELECT count(*) FROM pages) AS p)
        SELECT 'source' AS field, d AS known, p AS unknown, 0::BIGINT AS invented FROM n
        UNION ALL SELECT 'uri', p, d, 0 FROM n UNION ALL SELECT 'file_info', 0, d + p, 0 FROM n
        UNION ALL SELECT 'ts', 0, d + p, 0 FROM n UNION ALL SELECT 'meta.lang', d, p, 0 FROM n"""
    out["in5_stream_ingest"] = sql("SELECT image_id, source, length(text)::BIGINT AS n_chars FROM items", "items")
    out["in6_land_source"] = f"""SELECT {COMMON} FROM (SELECT page_id + 1000000000 AS image_id, 'web export' AS source,
        url AS uri, NULL::VARCHAR AS lang, length(html) AS n_chars, NULL AS dims FROM pages)"""
    out["in7_status_rollup"] = sql("""SELECT source, stage, state, count(*) AS items FROM last_status
        GROUP BY ALL""", "last_status")
    out["in8_write_read_latest"] = sql("SELECT image_id, stage, state, event_id FROM last_status", "last_status")

    out["sg1_tokenize"] = sql("SELECT image_id, term FROM tok", "tok")
    out["sg2_postings"] = sql("SELECT image_id, dl::BIGINT AS dl, term, tf FROM post JOIN docs USING (image_id)", "docs")
    out["sg3_corpus_stats"] = sql("""SELECT term, df, round(bm_idf, 6) AS bm_idf, round(idf, 6) AS idf, n_docs,
        n_tokens::BIGINT AS n_tokens, round(avg_dl, 6) AS avg_dl FROM terms, corpus""", "terms")
    out["sg4_prepare_vectors"] = """SELECT image_id, round(norm, 6) AS norm, (i - 1)::BIGINT AS pos, round(v[i] / norm, 6) AS x FROM (
        SELECT vec_id AS image_id, v, sqrt(list_dot_product(v, v)) AS norm, unnest(range(1, 65)) AS i
        FROM (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings))"""
    out["sg5_tfidf"] = sql("SELECT image_id, term, round(w, 6) AS w FROM weights", "weights")
    out["sg6_fit_cells"] = sql("SELECT image_id, true AS nearest FROM unit", "unit")
    out["sg7_assemble"] = sql("""SELECT i.image_id, source, lang,
            round(CASE WHEN embedding IS NOT NULL THEN sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])) END, 6) AS norm,
            dl::BIGINT AS dl, n_terms, n_terms IS NOT NULL AS has_text, embedding IS NOT NULL AS has_vector, false AS has_ts
        FROM items i LEFT JOIN docs USING (image_id)""", "items", "docs")
    out["sg8_coverage"] = sql("""SELECT source, count(*) AS items, count(n_terms) AS with_text,
        count(embedding) AS with_vector, 0::BIGINT AS with_ts FROM items LEFT JOIN docs USING (image_id) GROUP BY source""", "items", "docs")
    out["sg9_facets"] = sql("""SELECT 'source' AS facet, source AS value, count(*) AS items FROM items GROUP BY ALL
        UNION ALL SELECT 'lang', lang, count(*) FROM items GROUP BY ALL
        UNION ALL SELECT 'has_vector', (embedding IS NOT NULL)::VARCHAR, count(*) FROM items GROUP BY ALL""", "items")

    out["rt1_text_search"] = sql(f"SELECT {HIT} FROM text_top", "text_top")
    out["rt2_phrase_match"] = sql(f"""SELECT DISTINCT query_id, image_id, phrase FROM
            (SELECT query_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase
             FROM (SELECT query_id, {toks('text')} AS w FROM asked))
        JOIN (SELECT DISTINCT image_id, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS phrase
             FROM (SELECT doc_id AS image_id, {toks('text')} AS w FROM documents)) USING (phrase)""", "asked")
    grams = "unnest(list_distinct(list_transform(range(1, greatest(length(term) - 1, 1)), lambda i: substr(term, i, 3)))) AS gram"
    out["rt3_fuzzy_terms"] = sql(f"""SELECT DISTINCT a.term AS query_term, b.term AS term
        FROM (SELECT term, {grams} FROM (SELECT DISTINCT term FROM qterm) WHERE length(term) >= 3) a
        JOIN (SELECT term, {grams} FROM terms WHERE length(term) >= 3) b USING (gram)
        WHERE abs(length(a.term) - length(b.term)) <= 1
          AND levenshtein({_fold('a.term')}, {_fold('b.term')}) <= 1""", "qterm", "terms")
    out["in5_search_as_it_arrives"] = out["rt1_text_search"]
    out["rt1_pruned"] = out["rt1_blocks"] = out["rt1_text_search"]
    out["rt4_semantic_search"] = sql(f"SELECT {HIT} FROM ({_top('x_sum', 'semantic', 10)})", "x_sum")
    out["rt4_pruned"] = out["rt4_semantic_search"]
    out["rt5_expand"] = sql("""SELECT query_id, term, tf::BIGINT AS tf, false AS added FROM qterm UNION ALL
        SELECT query_id, term, 1, true FROM (
            SELECT query_id, term, row_number() OVER (PARTITION BY query_id ORDER BY w DESC, term) AS n FROM (
                SELECT query_id, term, round(sum(w), 6) AS w FROM text_top JOIN weights USING (image_id)
                WHERE rank <= 5 AND (query_id, term) NOT IN (SELECT query_id, term FROM qterm) GROUP BY ALL))
        WHERE n <= 5""", "text_top", "weights", "qterm")
    exact = sql(f"SELECT {HIT} FROM ({_top('cosine', 'score', 10)})", "cosine")
    out["rt6_vector_search"] = exact
    out["rt7_ann_all_cells"] = exact
    out["rt8_metadata_filter"] = """SELECT doc_id AS image_id, lang, source FROM documents
        WHERE lang = 'en' AND source = 'src7'"""
    out["rt8_passing_pairs"] = sql("""SELECT query_id, t.image_id FROM text_top t JOIN documents d ON d.doc_id = t.image_id
        LEFT JOIN documents q ON q.doc_id = query_id // 1000
        WHERE q.doc_id IS NULL OR (d.lang = q.lang AND d.source = q.source)""", "text_top")
    out["rt9_metadata_score"] = sql("""SELECT query_id, image_id, round(m.score, 6) AS score
        FROM text_top JOIN meta_all m USING (query_id, image_id)""", "text_top", "meta_all")
    out["rt9_metadata_top"] = sql(f"SELECT {HIT} FROM ({_top('(SELECT * FROM meta_all WHERE score > 0)', 'score', 10)})", "meta_all")
    out["rt10_clue_score"] = sql("""SELECT t.query_id, t.image_id, round(coalesce(c.score, 0), 6) AS score
        FROM text_top t LEFT JOIN clue_all c USING (query_id, image_id)
        WHERE t.query_id IN (SELECT query_id FROM qclue)""", "text_top", "clue_all")
    out["rt10_clue_top"] = sql(f"SELECT {HIT} FROM ({_top('clue_all', 'score', 10)})", "clue_all")
    out["rt11_top_k"] = """SELECT query_id, image_id, score, rank::BIGINT AS rank FROM (
        SELECT o_custkey AS query_id, o_orderkey AS image_id, round(o_totalprice, 6) AS score, row_number() OVER (
            PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3"""
    out["rt12_hybrid_search"] = sql(f"SELECT {SCORED} FROM x_ranked", "x_ranked")
    out["rt13_rerank"] = sql(f"SELECT {SCORED} FROM r_ranked", "r_ranked")
    out["rt13_requery"] = sql(f"SELECT {SCORED} FROM u_ranked", "u_ranked")
    out["rt14_rank_delta"] = sql("""SELECT *, previous - rank AS moved FROM (SELECT conv_id, turn, image_id, rank,
        lag(rank) OVER (PARTITION BY conv_id, image_id ORDER BY turn) AS previous FROM turn_top)""", "turn_top")
    out["rt15_tune_weights"] = sql(tuned(grid), "x_scored", "asked")

    out["ex1_explain"] = sql("SELECT * REPLACE (rank::BIGINT AS rank) FROM explained", "explained")
    out["ex2_matched_terms"] = sql("SELECT * REPLACE (place::BIGINT AS place) FROM matched", "matched")
    out["ex3_why"] = sql("""SELECT query_id, image_id, rank::BIGINT AS rank, signal, CASE signal
            WHEN 'text' THEN 'Text matched: ' || (SELECT string_agg(term, ', ' ORDER BY place) FROM matched m
                WHERE m.query_id = e.query_id AND m.image_id = e.image_id AND place <= 3)
            WHEN 'semantic' THEN 'Wording is related: ' || printf('%.2f', score)
            WHEN 'visual' THEN 'Visual likeness to the query: ' || printf('%.2f', score)
            WHEN 'metadata' THEN 'Metadata matched: ' || (SELECT string_agg(field, ', ' ORDER BY field) FROM qfilter f, items i
                WHERE f.query_id = e.query_id AND i.image_id = e.image_id
                  AND f.value = CASE field WHEN 'lang' THEN i.lang ELSE i.source END)
            ELSE 'Remembered clues found: ' || (SELECT string_agg(slot || ' ' || value, ', ' ORDER BY slot || ' ' || value)
                FROM qclue c JOIN clue_hit h USING (value) WHERE c.query_id = e.query_id AND h.image_id = e.image_id) END AS line
        FROM explained e WHERE score > 0""", "explained", "matched", "qfilter", "items", "qclue", "clue_hit")
    behind = {
        "text": "SELECT query_id, image_id FROM x_sum",
        "semantic": "SELECT query_id, image_id FROM x_sum",
        "visual": "SELECT query_id, image_id FROM cosine",
        "metadata": "SELECT query_id, image_id FROM meta_all WHERE score > 0",
        "clue": "SELECT query_id, image_id FROM clue_all",
    }
    made = "SELECT DISTINCT query_id, image_id + 1 AS image_id FROM explained WHERE score > 0 AND signal = "
    out["ex4_forged_evidence"] = sql(
        """SELECT 'term' AS evidence, count(*) AS claims, count(*) FILTER (p.term IS NULL) AS ungrounded
        FROM matched m LEFT JOIN post p ON p.image_id = m.image_id + 1 AND p.term = m.term"""
        + "".join(
            f""" UNION ALL SELECT '{name}', count(*), count(*) FILTER ((query_id, image_id) NOT IN ({ground}))
        FROM ({made} '{name}') HAVING count(*) > 0"""
            for name, ground in behind.items()
        ),
        "explained", "matched", "post", "x_sum", "cosine", "meta_all", "clue_all",
    )
    out["ex4_grounding_audit"] = sql("""SELECT 'term' AS evidence, count(*) AS claims, 0::BIGINT AS ungrounded FROM matched
        UNION ALL SELECT signal, count(*), 0 FROM explained WHERE score > 0 GROUP BY signal""", "explained", "matched")

    out["cv1_label_intent"] = sql("SELECT conv_id, turn, role, intent FROM labelled0", "labelled0")
    out["cv2_segment_searches"] = sql("SELECT conv_id, turn, segment::BIGINT AS segment FROM labelled", "labelled")
    out["cv3_extract_clues"] = sql("SELECT conv_id, turn, segment::BIGINT AS segment, slot, value FROM clues", "clues")
    out["cv4_context"] = sql("SELECT conv_id, turn, term FROM context", "context")
    out["cv5_clue_state"] = sql("SELECT conv_id, turn, slot, value FROM user_state", "user_state")
    out["cv6_formulate"] = sql("""SELECT query_id, 'term' AS part, '' AS name, term AS value FROM turn_terms
        UNION ALL SELECT conv_id::VARCHAR || ':' || turn::VARCHAR, 'clue', slot, value FROM state""", "turn_terms", "state")
    out["cv7_triggered"] = sql("""SELECT intent, intent IN ('search', 'refine') AS retrieves, count(*) AS turns
        FROM labelled0 WHERE intent IS NOT NULL GROUP BY ALL""", "labelled0")
    out["cv8_bind_actions"] = sql("""SELECT conv_id, turn, intent,
            CASE WHEN made IS NOT NULL THEN conv_id::VARCHAR || ':' || made::VARCHAR END AS query_id,
            CASE WHEN intent = 'confirm' AND asked > made THEN asked END AS proposed_at
        FROM (SELECT conv_id, turn, unnest(intents) AS intent, made, asked FROM (SELECT conv_id, turn, intents,
                max(CASE WHEN intent IN ('search', 'refine') THEN turn END) OVER w AS made,
                max(CASE WHEN list_has_any(intents, ['reminder', 'schedule']) THEN turn END) OVER w AS asked
              FROM labelled0 WHERE role = 'user' WINDOW w AS (PARTITION BY conv_id ORDER BY turn)))
        WHERE intent IN ('why', 'summarize', 'roadmap', 'reminder', 'schedule', 'confirm')""", "labelled0")
    out["cv9_stream_context"] = out["cv5_clue_state"]
    out["cv9_live_answers"] = sql("""SELECT conv_id, turn, 'term' AS part, '' AS name, term AS value FROM context
        UNION ALL SELECT conv_id, turn, 'clue', slot, value FROM user_state""", "context", "user_state")

    out["ac1_summarize"] = sql("""SELECT query_id, pos::BIGINT AS pos, image_id, sentence, weight FROM (
            SELECT query_id, image_id, sno, weight, row_number() OVER (
                PARTITION BY query_id ORDER BY weight DESC, image_id, sno) AS pos
            FROM x_ranked JOIN sentence_weight USING (image_id)) JOIN sentences USING (image_id, sno)
        WHERE pos <= 3""", "sentence_weight", "x_ranked")
    out["ac2_roadmap"] = sql("SELECT query_id, step::BIGINT AS step, topic, weight FROM plan", "plan")
    out["ac3_schedule"] = sql("""SELECT query_id, step::BIGINT AS step, topic, strftime(day, '%Y-%m-%d') AS day
        FROM days""", "days")
    out["ac4_find_deadlines"] = sql("""SELECT image_id, strftime(day, '%Y-%m-%d') AS day, found, context
        FROM deadlines""", "deadlines")
    out["ac5_propose"] = sql("""SELECT proposal_id, kind, strftime(day, '%Y-%m-%d') AS day, title, evidence
        FROM proposals""", "proposals")
    out["ac6_confirmed"] = sql("""SELECT proposal_id, CASE WHEN day(day) <= 15 THEN 'confirmed' ELSE 'proposed' END AS state
        FROM proposals""", "proposals")
    out["ac7_create_events"] = sql("""SELECT proposal_id, kind, strftime(day, '%Y-%m-%d') AS day, title
        FROM proposals WHERE day(day) <= 15""", "proposals")

    out["ac7_streamed_events"] = out["ac7_create_events"]

    out["hi1_timeline"] = sql("""SELECT strftime(b, '%Y-%m') AS bucket, count(*) AS items FROM (
        SELECT date_trunc('month', ts) AS b FROM events UNION ALL SELECT NULL FROM items) GROUP BY ALL""", "items")
    out["hi2_history_summary"] = """SELECT user_id, event_type AS kind, count(*) AS events,
        strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM events GROUP BY ALL"""
    out["hi3_viewed_before"] = """SELECT a.event_id AS anchor_id, a.user_id, v.event_id
        FROM events a ASOF JOIN (SELECT * FROM events WHERE event_type = 'view') v
        ON a.user_id = v.user_id AND a.ts > v.ts WHERE a.event_type = 'purchase'"""
    out["ev1_evaluate"] = sql(f"""SELECT count(*) AS queries, count(rank) AS found,
            round(avg(coalesce(1.0 / rank, 0)), 6) AS mrr, round(avg((coalesce(rank, 0) = 1)::INT), 6) AS hit_at_1,
            round(avg((rank IS NOT NULL)::INT), 6) AS hit_at_k
        FROM docs d LEFT JOIN ({_top('e_sum', 'text', 10)}) t
            ON t.query_id = d.image_id AND t.image_id = d.image_id""", "e_sum", "docs")
    ablation = [{s: 1.0} for s in SIGNALS] + [dict.fromkeys(SIGNALS, 1.0)]
    names = " ".join(f"WHEN {i} THEN '{n}'" for i, n in enumerate((*SIGNALS, "all")))
    out["ev2_ablate"] = sql(
        f"SELECT CASE setting {names} END AS signals, queries, mrr FROM ({tuned(ablation)})", "x_scored", "asked")
    return out
